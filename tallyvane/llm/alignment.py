"""Alignment of two tokenizers' tokens over the same texts.

Both tokenizers' tokens of a batch of documents lie in byte ranges of the same text. pandas.merge_asof, keyed by document, finds
for the start of each token of one side the covering token of the other; both directions together are all pairs of
tokens that overlap. Where a token of each side begins at the same byte, tokens of both end at that byte, too: there a new group begins.

How often two ids are linked in the corpus is a table that grows with it. Documents' pairs of ids are put together in blocks of bounded
size, which ask for the counts of just the pairs they hold.

Defined cases: texts that are null or empty, or whose tokens don't spell them, have no tokens; strings of special tokens are plain text; rows
that repeat are documents of their own; only the named columns are read, so that others can't clash; empty tables give no
rows. The pairs of a long group are counted by distinct ids, slice by slice.
"""

from __future__ import annotations

import hashlib
import json
import re
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyvane.llm import lookup, shared
from tallyvane.llm.bpe import blocks
from tallyvane.llm.transducer import readable_bytes

#: Bytes of text that are aligned in one go.
BATCH_BYTES = 1 << 20
#: Bytes of packed pairs that a piece and a block of documents have.
PIECE_BYTES, BLOCK_BYTES = 1 << 20, 6 << 20
#: Parts of texts whose tokens a worker keeps, and characters of them. Bounds memory, never results.
MOST_PARTS, MOST_CHARACTERS = 200_000, 8 << 20
#: Where a text of parts can't be split at every space; and the spaces at which it still can.
UNEVEN, CUT = re.compile(r"\s | \s| $"), re.compile(r"(?<=\S)(?= +\S)")
#: A group with more links than this is counted by distinct ids.
LONG_GROUP = 1 << 16
#: A pair of ids is one integer: the first id, and the second in this many bits.
BITS = 20


class Tokenizers:
    """The two libraries, and the bytes that each id stands for."""

    def __init__(self, first: str, second: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_file(first)
        self.first.encode_special_tokens = True
        byte = readable_bytes()
        with open(first, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        self.first_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            self.first_bytes[k] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        self.second = sentencepiece.SentencePieceProcessor(model_file=second)
        pieces = [self.second.id_to_piece(k) for k in range(self.second.get_piece_size())]
        self.second_bytes = [bytes([int(p[3:5], 16)]) if self.second.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.names = [np.array([f"{k}," for k in range(len(side))] + [f"{k}{end}" for k in range(len(side))], object) for side, end in ((self.first_bytes, "|"), (self.second_bytes, ";"))]
        self.sizes = [np.array([len(x) for x in side], np.int64) for side in (self.first_bytes, self.second_bytes)]

        # A space after something else begins a piece on both sides, so what stands between such spaces can be encoded by itself.
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)
        self.forget()

    def forget(self) -> None:
        """known: the number of each part; of each number whether both sides spell it; ids of both sides, one part after another."""
        self.known: dict[str, int] = {}
        self.characters = 0
        self.spelled = np.empty(0, bool)
        self.ids = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in range(2)]

    def parts(self, text: str) -> list[str]:
        """The text cut at spaces after which encoding starts afresh, these left out."""
        if not self.cuts:
            return [text]
        if UNEVEN.search(f" {text}"):
            return [x[1:] for x in CUT.split(f" {text}")]
        return text.split(" ")

    def learn(self, parts: list[str]) -> None:
        """Encode parts, each with a space before it, and see whether both sides spell them."""
        spaced = [f" {p}" for p in parts]
        raw = [s.encode() for s in spaced]
        ones = self.apart(spaced, np.fromiter(map(len, raw), np.int64, len(raw)))
        twos = self.second.encode(parts, num_threads=1)
        both = ones, (np.fromiter(chain.from_iterable(twos), np.int64), np.fromiter(map(len, twos), np.int64, len(twos)))
        same = np.ones(len(parts), bool)
        for (flat, n), bytes_ in zip(both, (self.first_bytes, self.second_bytes), strict=True):
            tokens = list(map(bytes_.__getitem__, flat.tolist()))
            ends = np.cumsum(n).tolist()
            same &= [b"".join(tokens[i:j]) == r for i, j, r in zip([0, *ends[:-1]], ends, raw, strict=True)]
        self.known.update(zip(parts, range(len(self.known), len(self.known) + len(parts)), strict=True))
        self.spelled = np.concatenate([self.spelled, same])
        self.ids = [tuple(np.concatenate(pair) for pair in zip(old, new, strict=True)) for old, new in zip(self.ids, both, strict=True)]

    def apart(self, spaced: list[str], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first side's ids of parts, and how many each has. Parts are encoded many at a time, as they don't meet in a token, and told apart
        by their bytes; if these don't add up, one by one."""
        flat = np.concatenate([e.ids for e in self.first.encode_batch(["".join(spaced[k : k + 500]) for k in range(0, len(spaced), 500)], add_special_tokens=False)]).astype(np.int64)
        ends, wanted = np.cumsum(self.sizes[0][flat]), np.cumsum(size)
        last = np.searchsorted(ends, wanted)
        if len(ends) and ends[-1] == wanted[-1] and (ends[last] == wanted).all():
            return flat, np.diff(last + 1, prepend=0)
        one = [e.ids for e in self.first.encode_batch(spaced, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(one), np.int64), np.fromiter(map(len, one), np.int64, len(one))

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For both sides ids of all texts, and how many each text has; none where either side doesn't spell a space and the text."""
        parts = [self.parts(t) if t else [] for t in texts]
        sizes = np.fromiter(map(len, parts), np.int64, len(texts))
        flat = list(chain.from_iterable(parts))
        every = set(flat)
        new = every - self.known.keys()
        if len(self.known) + len(new) > MOST_PARTS or self.characters > MOST_CHARACTERS:
            self.forget()
            new = every
        if new:
            self.characters += sum(map(len, new))
            self.learn(list(new))
        at = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        text = np.repeat(np.arange(len(texts)), sizes)
        bad = np.bincount(text, ~self.spelled[at], len(texts)) > 0
        keep = ~bad[text]
        at, text = at[keep], text[keep]
        out = []
        for ids, n in self.ids:
            each = n[at]
            first = (np.cumsum(n) - n)[at]
            places = np.arange(each.sum()) + np.repeat(first - (np.cumsum(each) - each), each)
            out.append((ids[places], np.bincount(text, each, len(texts)).astype(np.int64)))
        return out


_loaded: dict[tuple[str, str], Tokenizers] = {}


def loaded(first: str, second: str) -> Tokenizers:
    """The tokenizers of this Python worker."""
    if (first, second) not in _loaded:
        _loaded[first, second] = Tokenizers(first, second)
    return _loaded[first, second]


def placed(flat: np.ndarray, n: np.ndarray, sizes: np.ndarray) -> pd.DataFrame:
    """doc, id, at, end and base of all tokens in order: at and end count bytes through all documents, base is where the document begins."""
    doc = np.repeat(np.arange(len(n)), n)
    end = np.cumsum(sizes[flat])
    base = np.concatenate([[0], end])[np.cumsum(n) - n]
    return pd.DataFrame({"doc": doc, "id": flat, "at": end - sizes[flat], "end": end, "base": base[doc]}, copy=False)


def covering(starts: pd.DataFrame, tokens: pd.DataFrame) -> pd.DataFrame:
    """For each token of `starts` the number and begin of the token of the same document that covers its first byte. Documents follow
    one another on one scale in both tables, as both sides spell the same bytes."""
    other = pd.DataFrame({"doc": tokens["doc"], "at": tokens["at"], "number": np.arange(len(tokens)), "from": tokens["at"]})
    return pd.merge_asof(starts[["doc", "at"]], other, on="at", by="doc")


def overlapping(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the tokens of all pairs that overlap, and the number of each token's group, counted through all documents."""
    of_a, of_b = covering(a, b), covering(b, a)
    begins = [found["from"].to_numpy() == found["at"].to_numpy() for found in (of_a, of_b)]
    later = ~begins[1]  # pairs that begin together are found from both sides
    x = np.concatenate([np.arange(len(a)), of_b["number"].to_numpy()[later]])
    y = np.concatenate([of_a["number"].to_numpy(), np.flatnonzero(later)])
    by = np.lexsort((y, x))
    return x[by].astype(np.int64), y[by].astype(np.int64), np.cumsum(begins[0]) - 1, np.cumsum(begins[1]) - 1


def linked(a: np.ndarray, b: np.ndarray, groups: tuple[np.ndarray, np.ndarray], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document and pair of ids in one integer, sorted, and how many links have it: of each group, whose document `doc` tells, all tokens of
    one side with all of the other."""
    n, parts = len(doc), []
    sizes = [np.bincount(g, minlength=n) for g in groups]
    first = [np.cumsum(s) - s for s in sizes]
    plain = sizes[0] * sizes[1] <= LONG_GROUP
    here = np.flatnonzero(plain[groups[0]])
    each = sizes[1][groups[0][here]]
    left = np.repeat(here, each)
    of = groups[0][left]
    right = np.arange(len(left)) - np.repeat(np.cumsum(each) - each, each) + first[1][of]
    parts.append(np.unique((doc[of] << BITS | a[left]) << BITS | b[right], return_counts=True))
    for g in np.flatnonzero(~plain).tolist():
        (x, nx), (y, ny) = (np.unique(ids[f[g] : f[g] + s[g]], return_counts=True) for ids, f, s in ((a, first[0], sizes[0]), (b, first[1], sizes[1])))
        parts.append((((doc[g] << BITS | x[:, None]) << BITS | y).ravel(), (nx[:, None] * ny).ravel()))
    if len(parts) == 1:
        return parts[0]
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    total = np.zeros(len(keys), np.int64)
    np.add.at(total, at, np.concatenate([k for _, k in parts]))
    return keys, total


def packed(values: np.ndarray) -> bytes:
    """Sorted or small integers in few bytes: differences, byte by byte of all, compressed."""
    return pa.compress(np.diff(values, prepend=0).view(np.uint8).reshape(-1, 8).T.tobytes(), "zstd", asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    """The n integers that packed() took."""
    planes = np.frombuffer(pa.decompress(data, n * 8, "zstd", asbytes=True), np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, n).T).view(np.int64).ravel())


def spelled(ids: tuple[np.ndarray, np.ndarray], groups: tuple[np.ndarray, np.ndarray], names: list[list[str]]) -> tuple[list[str], np.ndarray]:
    """What the groups' text is made of, a piece for each token, side by side in the order of groups, and where each token of the first side
    stands; names: of each side ids with a comma, then ids with the sign that ends that side of a group."""
    n = int(groups[0][-1]) + 1
    sizes = [np.bincount(g, minlength=n) for g in groups]
    before = [np.concatenate([[0], np.cumsum(s)]) for s in sizes]
    places = [np.arange(len(groups[0])) + before[1][groups[0]], np.arange(len(groups[1])) + before[0][groups[1] + 1]]
    out = np.empty(len(ids[0]) + len(ids[1]), object)
    for x, g, place, name in zip(ids, groups, places, names, strict=True):
        last = np.append(g[1:] != g[:-1], True)
        out[place] = name[x + last * (len(name) // 2)]
    return out.tolist(), places[0]


def _of_docs(texts, both):
    """One batch of documents: columns of aligned() without the key."""
    ids = both.encode(texts)
    n = [k for _, k in ids]
    a, b = (placed(*x, s) for x, s in zip(ids, both.sizes, strict=True))
    groups, links, kinds, overlaps = np.zeros((4, len(texts)), np.int64)
    digest, pairs, times = [""] * len(texts), [b""] * len(texts), [b""] * len(texts)
    if len(a):
        x, _, *of = overlapping(a, b)
        doc = a["doc"].to_numpy()
        overlaps = np.bincount(doc[x], minlength=len(texts))
        of_group = doc[np.flatnonzero(np.diff(of[0], prepend=-1))]
        groups = np.bincount(of_group, minlength=len(texts))
        flat = a["id"].to_numpy(), b["id"].to_numpy()
        keys, count = linked(*flat, of, of_group)
        cuts = np.searchsorted(keys, np.arange(len(texts) + 1) << 2 * BITS)
        keys &= (1 << 2 * BITS) - 1
        kinds = np.diff(cuts)
        text, places = spelled(flat, of, both.names)
        begins = np.concatenate([places, [len(text)]])[np.concatenate([[0], np.cumsum(n[0])])]
        for d in np.flatnonzero(groups).tolist():
            i, j = cuts[d], cuts[d + 1]
            pairs[d], times[d], links[d] = packed(keys[i:j]), packed(count[i:j]), count[i:j].sum()
            digest[d] = hashlib.sha256("".join(text[begins[d] : begins[d + 1]])[:-1].encode()).hexdigest()
    return [n[0], n[1], groups, links, overlaps, pa.array(digest, pa.string()), kinds, pa.array(pairs, pa.binary()), pa.array(times, pa.binary())]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_overlaps", "groups_sha256", "n_pairs", "pairs", "times"]


def _rows(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, T.StructType]:
    kinds = [T.LongType()] * 5 + [T.StringType(), T.LongType(), T.BinaryType(), T.BinaryType()]
    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), *(T.StructField(c, k) for c, k in zip(COLUMNS, kinds, strict=True))])
    return docs.select(docs[key].alias("key"), docs[text].alias("text")), schema


def _run(first: str, second: str, names: list[str]):
    def run(batches):
        both = loaded(first, second)
        for table in blocks(batches, "text", BATCH_BYTES):
            columns = _of_docs(table.column("text").to_pylist(), both)
            done = pa.Table.from_arrays([table.column("key"), *map(pa.array, columns)], names=names)
            shared.give_back()
            yield from done.combine_chunks().to_batches(max_chunksize=1000)

    return run


def aligned(docs: DataFrame, first: str, second: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, tokens of each side, groups, links, overlaps and the groups' digest; pairs: the n_pairs distinct pairs of linked ids, sorted, and
    times: links of each, both packed(). Each partition by itself."""
    rows, schema = _rows(docs, key, text)
    return rows.mapInArrow(_run(first, second, schema.names), schema).withColumnRenamed("key", key)


def overlaps(docs: DataFrame, first: str, second: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each pair of tokens that overlap: key, a and b (their numbers in the text), id_a, id_b, begin and end (bytes that they share,
    of the text after a space) and group (its number in the text)."""
    kind = docs.schema[key].dataType
    names = ["a", "b", "id_a", "id_b", "begin", "end", "group"]
    schema = T.StructType([T.StructField("key", kind), *(T.StructField(c, T.LongType()) for c in names)])

    def run(batches):
        both = loaded(first, second)
        for table in blocks(batches, "text", BATCH_BYTES):
            ids = both.encode(table.column("text").to_pylist())
            a, b = (placed(*x, s) for x, s in zip(ids, both.sizes, strict=True))
            if not len(a):
                continue
            x, y, group, _ = overlapping(a, b)
            doc = a["doc"].to_numpy()[x]
            before = [np.searchsorted(side["doc"].to_numpy(), doc) for side in (a, b)]
            base = a["base"].to_numpy()[x]
            begin = np.maximum(a["at"].to_numpy()[x], b["at"].to_numpy()[y]) - base
            end = np.minimum(a["end"].to_numpy()[x], b["end"].to_numpy()[y]) - base
            columns = [x - before[0], y - before[1], a["id"].to_numpy()[x], b["id"].to_numpy()[y], begin, end, group[x] - group[before[0]]]
            done = pa.Table.from_arrays([table.column("key").take(pa.array(doc)), *map(pa.array, columns)], names=schema.names)
            yield from done.combine_chunks().to_batches(max_chunksize=10_000)

    return docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(run, schema).withColumnRenamed("key", key)


def held(blocked: DataFrame) -> DataFrame:
    """block, pair and how many documents of the block have it. Written; a block that two tasks read has rows for each."""

    def told(block, parts):
        pair, n = np.unique(np.concatenate(parts), return_counts=True)
        for c in range(0, len(pair), 1 << 18):
            part = pair[c : c + (1 << 18)]
            yield pa.record_batch([np.full(len(part), block), part, n[c : c + (1 << 18)]], ["block", "pair", "n"])

    def run(batches):
        now, parts = None, []
        for block, table in lookup.pieces(batches):
            if parts and block != now:
                yield from told(now, parts)
                parts = []
            now = block
            parts += [unpacked(pairs, n) for n, pairs in zip(table.column("n_pairs").to_pylist(), table.column("pairs").to_pylist(), strict=True) if n]
        if parts:
            yield from told(now, parts)

    return shared.written(blocked.mapInArrow(run, "block bigint, pair bigint, n bigint"), "held")


def counted(holding: DataFrame) -> DataFrame:
    """pair, n: documents of the corpus that hold it linked, and best: whether no pair of the same first id has more."""
    total = holding.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("a", F.shiftright("pair", BITS))
    most = total.groupBy("a").agg(F.max("n").alias("most"))
    return total.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def summarised(docs: DataFrame, first: str, second: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """aligned() without pairs, and of its links n_best, whose pair is the commonest of its first id, and count_sum, of their pairs'
    counts."""
    rows, aligned_as = _rows(docs, key, text)
    blocked = lookup.dealt(rows, "pairs", PIECE_BYTES, BLOCK_BYTES, made=_run(first, second, aligned_as.names))
    holding = held(blocked)
    answers = holding.select("block", "pair").join(shared.written(counted(holding), "pairs"), "pair")
    kinds = [aligned_as[c] for c in ["key", *COLUMNS[:6]]]
    schema = T.StructType([*kinds, T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])

    def prepare(told: pa.Table):
        known, at = np.unique(told.column("pair").to_numpy(), return_index=True)
        return known, told.column("n").to_numpy()[at], told.column("best").to_numpy()[at]

    def run(table: pa.Table, made) -> pa.Table:
        known, n, best = made
        sums = np.zeros((2, len(table)), np.int64)
        for k, (size, pairs, times) in enumerate(zip(*(table.column(c).to_pylist() for c in ("n_pairs", "pairs", "times")), strict=True)):
            if size:
                at, links = np.searchsorted(known, unpacked(pairs, size)), unpacked(times, size)
                sums[:, k] = links[best[at]].sum(), (links * n[at]).sum()
        return pa.table([*(table.column(c) for c in ["key", *COLUMNS[:6]]), sums[0], sums[1]], names=schema.names)

    return lookup.answered(blocked, answers, prepare, run, schema).withColumnRenamed("key", key)
