"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The distinct words of a block of documents form one flat array of symbols. An inverted index maps the rank of a
mergeable pair to all positions where it stands. Ranks are replayed in ascending order; each replay rewrites every
position of the pair at once and looks up only the pairs of the touched neighbours, whose positions join the index.

Results of words are kept, for a partition's later blocks, in a cache of bounded size, so that these only replay words they
bring anew.

Defined cases: a null text counts as empty and has no ids, as an empty one; equal texts give equal rows; a text of any length is one row and a block of its
own; of equal pairs side by side the left one merges first; rows that repeat stay rows of their own; only the named columns are read, so that others can't clash; empty tables give no rows.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallyvane.llm.shared import give_back

#: Words whose ids a partition keeps; beyond it the cache starts anew. Bounds memory, never results.
CACHE_WORDS = 400_000
#: Bytes of text that one replay covers at least, if the partition has them.
BLOCK_BYTES = 4 << 20

OUT = T.StructType(
    [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("decoded", T.BinaryType()),
    ]
)


class MergeReplay:
    """Replays the merges of one rank file over blocks of words."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.token = [b""] * self.size
        for token, rank in ranks.items():
            self.token[rank] = token
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left * self.size + right)
                    values.append(rank)
        order = np.argsort(np.array(keys, dtype=np.int64))
        self.pair_key = np.array(keys, dtype=np.int64)[order]
        self.pair_rank = np.array(values, dtype=np.int64)[order]

    @classmethod
    def from_file(cls, path: str) -> MergeReplay:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair's merge, -1 where the pair can't merge."""
        key = left * self.size + right
        at = np.searchsorted(self.pair_key, key)
        at[at == len(self.pair_key)] = 0
        return np.where(self.pair_key[at] == key, self.pair_rank[at], -1)

    def encode_one(self, word: bytes) -> list[int]:
        """One word, always merging its leftmost pair of least rank: for words whose replay isn't monotone."""
        parts = [bytes([b]) for b in word]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], self.size), i) for i in range(len(parts) - 1))
            if rank == self.size:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers."""
        if not words:
            return []
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        n = int(ends[-1])
        # Position n is a guard on both sides; a symbol of -1 pairs with nothing.
        symbol = np.full(n + 1, -1, np.int64)
        symbol[:n] = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        following = np.arange(1, n + 2)
        before = np.arange(-1, n)
        following[n], before[0] = n, n
        nonempty = lengths > 0
        first, last = (ends - lengths)[nonempty], ends[nonempty] - 1
        following[last], before[first] = n, n
        index: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []
        irregular: list[np.ndarray] = []

        def note(places: np.ndarray, ranks: np.ndarray, least: int) -> None:
            good = ranks >= 0
            places, ranks = places[good], ranks[good]
            if not len(places):
                return
            if least > (low := ranks.min()) >= 0:
                irregular.append(places[ranks < least])
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            starts = [0, *cuts.tolist()]
            for rank, a, b in zip(ranks[starts].tolist(), starts, [*starts[1:], len(ranks)], strict=True):
                if rank in index:
                    index[rank].append(places[a:b])
                else:
                    index[rank] = [places[a:b]]
                    heapq.heappush(queue, rank)
            del low

        inner = np.flatnonzero(following[:n] < n)
        note(inner, self.rank_of(symbol[inner], symbol[following[inner]]), -1)
        while queue:
            rank = heapq.heappop(queue)
            lists = index.pop(rank)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            right = following[at]
            keep = (symbol[at] >= 0) & (symbol[right] >= 0)
            at, right = at[keep], right[keep]
            keep = self.rank_of(symbol[at], symbol[right]) == rank
            at, right = at[keep], right[keep]
            if not len(at):
                continue
            chained = np.zeros(len(at), bool)
            chained[1:] = right[:-1] == at[1:]
            if chained.any():  # a pair overlaps the next: every other one of such a chain merges
                order = np.arange(len(at))
                since = order - np.maximum.accumulate(np.where(chained, 0, order))
                at, right = at[since % 2 == 0], right[since % 2 == 0]
            beyond = following[right]
            symbol[at], symbol[right] = rank, -1
            following[at] = beyond
            before[beyond] = at
            previous = before[at]
            symbol[n] = -1
            for a, b in ((previous, at), (at, beyond)):
                real = (a < n) & (b < n)
                a, b = a[real], b[real]
                note(a, self.rank_of(symbol[a], symbol[b]), rank)
        alive = symbol[:n] >= 0
        ids = symbol[:n][alive].astype("<u4")
        bounds = np.concatenate([[0], np.cumsum(alive)])[np.concatenate([[0], ends])].tolist()
        out = [ids[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        if irregular:
            for w in np.unique(np.searchsorted(ends, np.concatenate(irregular), side="right")).tolist():
                out[w] = np.array(self.encode_one(words[w]), "<u4").tobytes()
        return out

    def decode(self, ids: bytes) -> bytes:
        """Bytes that the ids stand for."""
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_workers: dict[tuple[str, str], tuple[MergeReplay, object, dict[str, bytes]]] = {}


def _worker(path: str, pattern: str):
    """The replay, the compiled pattern and the cache of this Python worker."""
    if (path, pattern) not in _workers:
        import regex

        _workers[path, pattern] = (MergeReplay.from_file(path), regex.compile(pattern), {})
    return _workers[path, pattern]


def encode_texts(texts: list[str | None], path: str, pattern: str) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit integers; a null text counts as empty."""
    replay, split, cache = _worker(path, pattern)
    pieces = [split.findall(t) if t else [] for t in texts]
    fresh = list({p for words in pieces for p in words if p not in cache})
    if len(cache) + len(fresh) > CACHE_WORDS:
        cache.clear()
        fresh = list({p for words in pieces for p in words})
    cache.update(zip(fresh, replay.encode([p.encode() for p in fresh]), strict=True))
    return [b"".join(map(cache.__getitem__, words)) for words in pieces]


def blocks(batches: Iterator[pa.RecordBatch], column: str, size: int) -> Iterator[pa.Table]:
    """Batches cut, or put together, so that the texts of each table have about that many bytes; no text is cut."""
    held, have = [], 0
    for batch in batches:
        lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        block = (have + np.cumsum(lengths, dtype=np.int64)) // size
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(lengths)]
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if k or (len(block) and block[0] > 0 and held):
                if held:
                    yield pa.Table.from_batches(held)
                held, have = [], 0
            held.append(batch.slice(a, b - a))
        have += int(lengths[cuts[-2] :].sum())
    if held:
        yield pa.Table.from_batches(held)


def encode_decode(
    docs: DataFrame, path: str, pattern: str, *, key: str = "doc_id", text: str = "text", digests: bool = False
) -> DataFrame:
    """Encode every text and decode its ids again, in place: no shuffle, each partition by itself.

    Returns key, n_tokens, ids (BINARY, little-endian unsigned 32-bit integers) and decoded (BINARY). With `digests`,
    ids_sha256 and decoded_sha256 (lowercase hex) come in place of the two payloads, so that these needn't leave
    the task. Other columns of `docs` are left out, whatever their names.
    """
    kind = docs.schema[key].dataType
    last = [T.StructField(f"{n}_sha256", T.StringType()) for n in ("ids", "decoded")] if digests else OUT.fields[1:]
    schema = T.StructType([T.StructField("key", kind), OUT.fields[0], *last])

    def run(batches):
        replay = _worker(path, pattern)[0]
        for table in blocks(batches, "text", BLOCK_BYTES):
            give_back()
            ids = encode_texts(table.column("text").to_pylist(), path, pattern)
            counts = pa.array([len(x) // 4 for x in ids], pa.int64())
            if digests:
                payload = [
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(replay.decode(x)).hexdigest() for x in ids], pa.string()),
                ]
            else:
                payload = [pa.array(ids, pa.binary()), pa.array([replay.decode(x) for x in ids], pa.binary())]
            done = pa.Table.from_arrays([table.column("key"), counts, *payload], names=schema.names)
            yield from done.combine_chunks().to_batches(max_chunksize=10_000)
        _worker(path, pattern)[2].clear()
        give_back()

    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)
