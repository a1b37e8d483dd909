"""Log probabilities of texts by prediction by partial matching over bytes.

The model is a trie of byte contexts: a node for every sequence of up to `order` bytes that a learning text holds, with how often
each byte follows it. A byte is predicted by the longest context that the trie knows: with count c of it among T
and q different followers, by (2c - 1) / 2T; if it never followed, the node's escape, q / 2T, is paid and the next
shorter context is asked, without the bytes that have just been ruled out (symbol exclusion). Below the empty context all bytes
that are left are alike. A text is held between edge bytes, which UTF-8 never has, so that its end is predicted, too.

The trie grows with the corpus and is a table, one row a node. Blocks of texts ask for the nodes that their bytes pass and for
the counts of their words, which the word model beside it needs; each block is scored by what it got.

Counts of all orders come from the longest sequences, each counted once a block before anything is shuffled. Followers
of a context also follow its shorter ones, so what is excluded at a node is a sum that depends on the longer context alone.

Defined cases: a null text is an empty one, which has one token, its end; rows that repeat are rows of their own, each of
which teaches; without learning texts every byte costs 1/256 and every word 1; only the named columns are read, so that others can't
clash; empty tables give no rows; a null key learns. Texts longer than a block make a block of their own and are scored piece by piece.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyvane.llm import lookup, shared
from tallyvane.llm.words import SPACED, utf8, words

#: Bytes of context at most, six or fewer: a sequence of that many and the next byte is an integer of 64 bits, led by a one.
ORDER = 5
#: The byte before and after every text.
EDGE = 0xFF
#: Bytes of text that are scored in one go, and that a block has.
PIECE_BYTES, BLOCK_BYTES = 2 << 20, 32 << 20
#: Kinds of keys that blocks hold: sequences, nodes, words.
SEQUENCE, NODE, WORD = 0, 1, 2

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def lowered(texts: list[bytes | None], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts, `order` edges before and one after each, A-Z in lower case; and where each text's first edge stands."""
    edge = bytes([EDGE])
    data = np.frombuffer(b"".join(edge * order + (t or b"") + edge for t in texts), np.uint8)
    sizes = np.fromiter((len(t or b"") + order + 1 for t in texts), np.int64, len(texts))
    return _LOWER[data], np.cumsum(sizes) - sizes


def sequences(data: np.ndarray, order: int) -> np.ndarray:
    """The `order` bytes before each byte from the first text's first on, and that byte, led by a one, as integers. Those that end
    in the edges before a text are no predictions."""
    n = max(len(data) - order, 0)
    out = np.ones(n, np.int64)
    for k in range(order + 1):
        out <<= 8
        out |= data[k : n + k]
    return out


def predicted(starts: np.ndarray, n: int, order: int) -> np.ndarray:
    """Of n sequences, which predict a byte or an end."""
    out = np.ones(n, bool)
    if order:
        pads = (starts[1:, None] - order + np.arange(order)).ravel()
        out[pads] = False
    return out


def shortened(keys: np.ndarray, length: int) -> np.ndarray:
    """Integers of the last `length` bytes of sequences."""
    return keys & ((1 << 8 * length) - 1) | (1 << 8 * length)


class Trie:
    """Nodes as arrays: pairs (context and follower, sorted), their counts; of each context total, followers and what the followers
    count in the context without its first byte."""

    def __init__(self, pairs: np.ndarray, counts: np.ndarray, order: int):
        by = np.argsort(pairs, kind="stable")
        self.pairs, self.counts, self.order = pairs[by], counts[by], order
        contexts = self.pairs >> 8
        first = np.flatnonzero(np.diff(contexts, prepend=-1))
        self.contexts = contexts[first]
        self.total = np.add.reduceat(self.counts, first) if len(first) else np.empty(0, np.int64)
        self.followers = np.diff(np.append(first, len(contexts)))
        inner = np.zeros(len(self.pairs), np.int64)
        for k in range(1, order + 1):
            a, b = np.searchsorted(self.pairs, [1 << 8 * (k + 1), 1 << 8 * (k + 2)]).tolist()
            inner[a:b] = self.counts[np.searchsorted(self.pairs, shortened(self.pairs[a:b], k))]
        self.excluded = np.add.reduceat(inner, first) if len(first) else np.empty(0, np.int64)

    def cost(self, keys: np.ndarray) -> np.ndarray:
        """log10 of the probability of the last byte of each sequence after the others; keys: sorted."""
        out = np.zeros(len(keys))
        left = np.arange(len(keys))
        if not len(self.pairs):
            return out - np.log10(256)
        gone, ruled = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)  # of the node before: counts and followers
        for k in range(self.order, -1, -1):
            pair = shortened(keys[left], k + 1)
            at = np.searchsorted(self.contexts, pair >> 8)
            known = at < len(self.contexts)
            known[known] = self.contexts[at[known]] == pair[known] >> 8
            at = np.where(known, at, 0)
            place = np.searchsorted(self.pairs, pair)
            hit = place < len(self.pairs)
            hit[hit] = self.pairs[place[hit]] == pair[hit]
            escape = np.where(known, self.followers[at] - ruled[left], 0)
            whole = 2 * np.where(known, self.total[at] - gone[left], 0)
            paid = np.where(hit, 2 * self.counts[np.where(hit, place, 0)] - 1, escape)
            open_ = whole > 0  # else the longer context has ruled out all that this one knows
            out[left[open_]] += np.log10(paid[open_] / whole[open_])
            gone[left] = np.where(known, self.excluded[at], 0)
            ruled[left] = np.where(known, self.followers[at], 0)
            left = left[~hit]
        out[left] -= np.log10(256 - ruled[left])
        return out


def held(blocks: DataFrame, order: int) -> DataFrame:
    """block, kind, key and n of what each block holds: sequences and words with how often its learning texts have them, and nodes that
    its texts pass. Written; a block that two tasks read has a row for each."""
    schema = "block bigint, kind tinyint, key bigint, n bigint"

    def counted(table):
        texts, learns = utf8(table.column("text").combine_chunks()), table.column("learns").to_numpy()
        data, starts = lowered(texts, order)
        keys = sequences(data, order)
        learn = np.repeat(learns, np.diff(np.append(starts, len(data))))[order:]
        good = predicted(starts, len(keys), order)
        found, at = np.unique(keys[good], return_inverse=True)
        cut = words(texts, SPACED, lower=True)
        word, of = np.unique(cut.hash.view(np.int64), return_inverse=True)
        return (found, np.bincount(at, learn[good], len(found)).astype(np.int64)), (word, np.bincount(of, learns[cut.text_of], len(word)).astype(np.int64))

    def told(block, parts):
        (found, times), (word, n) = (summed(side) for side in zip(*parts, strict=True))
        nodes, passed = found >> 8, []
        for k in range(order, -1, -1):
            nodes = np.unique(shortened(nodes, k))
            passed.append(nodes)
        passed = np.concatenate(passed)
        taught = times > 0
        for kind, keys, counts in ((SEQUENCE, found[taught], times[taught]), (NODE, passed, np.zeros(len(passed), np.int64)), (WORD, word, n)):
            for c in range(0, len(keys), 1 << 18):
                part = keys[c : c + (1 << 18)]
                yield pa.record_batch([np.full(len(part), block), np.full(len(part), kind, np.int8), part, counts[c : c + (1 << 18)]], ["block", "kind", "key", "n"])

    def run(batches):
        now, parts = None, []
        for block, table in lookup.pieces(batches):
            if parts and block != now:
                yield from told(now, parts)
                parts = []
            now = block
            parts.append(counted(table))
            shared.give_back()
        if parts:
            yield from told(now, parts)

    return shared.written(blocks.mapInArrow(run, schema), "held", "zstd")


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of all parts, and the sums of what they count."""
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def trie(holding: DataFrame, order: int) -> DataFrame:
    """key and followers (256 n + byte) of every node that learning texts have: a table that grows with them."""
    most = holding.filter(F.col("kind") == SEQUENCE).groupBy("key").agg(F.sum("n").alias("n"))
    mask = [(1 << 8 * k) - 1 for k in range(1, order + 2)]
    tails = F.array(*(F.col("key").bitwiseAND(F.lit(m).cast("long")).bitwiseOR(F.lit(m + 1).cast("long")) for m in mask))
    pairs = most.select(F.explode(tails).alias("pair"), "n").groupBy("pair").agg(F.sum("n").alias("n"))
    follower = F.shiftleft("n", 8).bitwiseOR(F.col("pair").bitwiseAND(F.lit(255).cast("long")))
    return pairs.groupBy(F.shiftright("pair", 8).alias("key")).agg(F.collect_list(follower).alias("followers"))  # 256 at most


def scored(docs: DataFrame, learns, *, key: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """Score every text by the texts for which the condition `learns` holds.

    Returns key, learns, n_tokens (words and an end), n_known (those that learning texts have), train_tokens, base_score (log10 by
    counts of words) and score (log10 of the probability of the text, lower-cased, as its bytes).
    """
    rows = docs.select(docs[key].alias("key"), F.coalesce(learns, F.lit(True)).alias("learns"), F.coalesce(docs[text], F.lit("")).alias("text"))
    blocks = lookup.dealt(rows, "text", PIECE_BYTES, BLOCK_BYTES)
    holding = held(blocks, order)
    counted = holding.filter(F.col("kind") == WORD).groupBy("key").agg(F.sum("n").alias("n")).filter("n > 0")
    ends = rows.agg(F.count_if("learns")).first()[0]
    known, total = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    distinct, total = known + (ends > 0), total + ends
    of_word = F.array(F.shiftleft("n", 8))
    told = shared.written(trie(holding, order).withColumn("kind", F.lit(NODE).cast("byte")).unionByName(counted.select("key", of_word.alias("followers"), F.lit(WORD).cast("byte").alias("kind"))), "trie", "zstd")
    answers = holding.filter(F.col("kind") != SEQUENCE).select("block", "kind", "key").join(told, ["kind", "key"])
    kind = docs.schema[key].dataType
    fields = [("key", kind), ("learns", T.BooleanType()), *((c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")), ("base_score", T.DoubleType()), ("score", T.DoubleType())]
    schema = T.StructType([T.StructField(*f) for f in fields])
    whole = total + distinct + 1  # N + 1 * (V + 1)

    def prepare(told: pa.Table):
        followers = told.column("followers").combine_chunks()
        sizes = np.diff(followers.offsets.to_numpy()) if len(told) else np.empty(0, np.int64)
        flat = followers.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        byte, n = flat & 255, flat >> 8
        keys = told.column("key").to_numpy().astype(np.int64)
        is_node = told.column("kind").to_numpy() == NODE
        spread = np.repeat(is_node, sizes)
        pairs, first = np.unique(np.repeat(keys, sizes)[spread] << 8 | byte[spread], return_index=True)
        word, of = np.unique(keys[~is_node], return_index=True)
        return Trie(pairs, n[spread][first], order), word, n[~spread][of]

    def run(table: pa.Table, made) -> pa.Table:
        nodes, word, times = made
        texts = utf8(table.column("text").combine_chunks())
        data, starts = lowered(texts, order)
        every = sequences(data, order)
        found, at = np.unique(every, return_inverse=True)
        costs = np.where(predicted(starts, len(every), order), nodes.cost(found)[at], 0.0)
        cut = words(texts, SPACED, lower=True)
        own = cut.hash.view(np.int64)
        at = np.searchsorted(word, own)
        hit = at < len(word)
        hit[hit] = word[at[hit]] == own[hit]
        c = np.zeros(len(own), np.int64)
        c[hit] = times[at[hit]]
        n, of = len(texts), cut.text_of
        tokens = np.bincount(of, minlength=n) + 1
        seen = np.bincount(of, hit, n).astype(np.int64) + (ends > 0)
        base = np.bincount(of, np.log10((c + 1) / whole), n) + np.log10((ends + 1) / whole)
        return pa.table([table.column("key"), table.column("learns"), tokens, seen, np.full(n, total), base, np.add.reduceat(costs, starts)], names=schema.names)

    return lookup.answered(blocks, answers, prepare, run, schema).withColumnRenamed("key", key)
