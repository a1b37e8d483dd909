"""Token ids in binary shards with a minimal perfect hash index over the document keys.

Documents are range-partitioned and sorted by key; each partition becomes a shard of two files in a folder that all
executors reach: `<shard>.ids`, the raw ids of its documents one after the other (little-endian, unsigned, 16 bits where
the vocabulary allows, else 32), and `<shard>.idx`:

    header   8 bytes magic, then as unsigned 64-bit integers: bytes per id, documents, distinct keys, levels
    offsets  documents + 1 unsigned 64-bit integers: where each document's ids begin, in ids
    levels   for each level its number of 64-bit words (one unsigned 64-bit integer), then the words
    slots    for each distinct key: 32-bit fingerprint, 32-bit ordinal of its first document, 32-bit number of documents

A key's hash is tried on the levels in turn; the first level whose bit is set at the hash gives the slot: the number of
set bits before it. At each level about 60 per cent of the keys left find a bit of their own, so a look-up takes constant
time and the index about 3.5 bits a key besides the slots. A stored fingerprint tells keys that aren't there.

Distinct words are encoded by the library and known by a 64-bit hash from then on, so that a text is cut, looked up and written
in whole arrays. Two words of equal hash are the only way to err.

Defined cases: a null text counts as empty and has only the end id, an empty one likewise; rows without a key come first and are
found by the null key; rows of equal key, repeated ones too, keep one slot a shard and follow one another by a hash of their texts, then
by the texts, so that a key of many rows may go on in the next shard; very long texts are encoded in one piece, in memory that grows with the longest
text alone; only the key and the text are read, so that other columns can't clash; an empty table gives no shards and no rows.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyvane.llm import shared
from tallyvane.llm.bpe import blocks
from tallyvane.llm.words import SPACED, _hashes, mixed, utf8, words

MAGIC = b"TVSHARD1"
#: Bits of a level for each key that is left.
GAMMA = 2
#: Distinct words whose ids a worker keeps (beyond it the cache starts anew), bits of the table that finds the frequent ones at once.
CACHE_WORDS, TABLE_BITS = 1_500_000, 22
BLOCK_BYTES = 4 << 20


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys, 1_000_003) >> np.uint64(32)).astype(np.uint32)


class KeyIndex:
    """Minimal perfect hash of distinct 64-bit keys."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        counts = [np.bitwise_count(words).astype(np.int64) for words in levels]
        total = np.cumsum([0, *(c.sum() for c in counts)])
        self.before = [total[k] + np.cumsum(c) - c for k, c in enumerate(counts)]

    @classmethod
    def build(cls, keys: np.ndarray) -> KeyIndex:
        levels, left = [], keys.astype(np.uint64)
        while len(left):
            words = max(1, -(-GAMMA * len(left) // 64))
            at = (mixed(left, len(levels)) % np.uint64(words * 64)).astype(np.int64)
            alone = np.bincount(at, minlength=words * 64) == 1
            bits = np.packbits(alone, bitorder="little").view("<u8")
            levels.append(bits.astype(np.uint64))
            left = left[~alone[at]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 where no level has it. Whether it is there, only its fingerprint tells."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        keys = keys.astype(np.uint64)
        for level, (words, before) in enumerate(zip(self.levels, self.before, strict=True)):
            if not len(left):
                break
            at = (mixed(keys[left], level) % np.uint64(len(words) * 64)).astype(np.int64)
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            low = word & ((np.uint64(1) << bit) - np.uint64(1))
            out[left[hit]] = (before[at >> 6] + np.bitwise_count(low))[hit]
            left = left[~hit]
        return out


class ShardIndex:
    """The index file of a shard."""

    def __init__(self, width: int, offsets: np.ndarray, keys: KeyIndex, slots: np.ndarray):
        self.width, self.offsets, self.keys, self.slots = width, offsets, keys, slots

    @classmethod
    def build(cls, hashes: np.ndarray, offsets: np.ndarray, width: int) -> ShardIndex:
        """hashes: of each document's key, equal ones side by side."""
        first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
        keys = KeyIndex.build(hashes[first])
        slots = np.zeros((len(first), 3), np.uint32)
        at = keys.slots(hashes[first])
        slots[at, 0], slots[at, 1] = fingerprint(hashes[first]), first
        slots[at, 2] = np.diff(np.append(first, len(hashes)))
        return cls(width, offsets, keys, slots)

    def to_bytes(self) -> bytes:
        head = np.array([self.width, len(self.offsets) - 1, len(self.slots), len(self.keys.levels)], "<u8")
        levels = [np.concatenate([[np.uint64(len(w))], w]).astype("<u8").tobytes() for w in self.keys.levels]
        return b"".join([MAGIC, head.tobytes(), self.offsets.astype("<u8").tobytes(), *levels, self.slots.astype("<u4").tobytes()])

    @classmethod
    def from_bytes(cls, data: bytes) -> ShardIndex:
        if data[:8] != MAGIC:
            raise ValueError("not a shard index")
        width, docs, distinct, levels = map(int, np.frombuffer(data, "<u8", 4, 8))
        offsets, at, found = np.frombuffer(data, "<u8", docs + 1, 40).astype(np.int64), 40 + 8 * (docs + 1), []
        for _ in range(levels):
            n = int(np.frombuffer(data, "<u8", 1, at)[0])
            found.append(np.frombuffer(data, "<u8", n, at + 8))
            at += 8 * (n + 1)
        return cls(width, offsets, KeyIndex(found), np.frombuffer(data, "<u4", 3 * distinct, at).reshape(distinct, 3))

    def ordinals(self, hashes: np.ndarray, repeat: np.ndarray) -> np.ndarray:
        """Ordinal of the repeat-th document of each key; -1 where the shard doesn't have it."""
        slot = self.keys.slots(hashes)
        if not len(self.slots):
            return slot
        row = self.slots[np.maximum(slot, 0)]
        there = (slot >= 0) & (row[:, 0] == fingerprint(hashes)) & (repeat < row[:, 2])
        return np.where(there, row[:, 1].astype(np.int64) + repeat, -1)


def _bytes(*parts) -> np.ndarray:
    found = np.zeros(256, bool)
    for part in parts:
        found[list(part)] = True
    return found


#: Marks, and what may stand before marks at a word's end: letters and digits, and second bytes of Latin-1 letters.
MARKS, ASCII_BEFORE = _bytes(b".,!?;:$%&*#|"), _bytes(range(0x61, 0x7B), range(0x30, 0x3A))
LATIN_BEFORE = _bytes(range(0x80, 0x97), range(0x98, 0xB7), range(0xB8, 0xC0))


def pieces(texts: list[bytes]):
    """Bytes of the texts in lower case, begin and end of each piece, and for each text the number of its first piece, and of all at
    last. Pieces are words that white space ends, without marks at their ends where a letter or digit is before them, and those marks."""
    w = words(texts, SPACED, lower=True, hashed=False)
    at = np.arange(len(w.data), dtype=np.int64)
    last = np.maximum.accumulate(np.where(MARKS[w.data], -1, at))[w.end - 1] if len(w.end) else w.end
    before = w.data[np.maximum(last, 0)]
    letter = ASCII_BEFORE[before] | (LATIN_BEFORE[before] & (last > w.begin) & (w.data[np.maximum(last - 1, 0)] == 0xC3))
    parted = (last >= w.begin) & (last < w.end - 1) & letter
    shift = np.concatenate([[0], np.cumsum(parted)])
    place = np.arange(len(w.begin)) + shift[:-1]
    begin, end = np.empty((2, len(w.begin) + int(shift[-1])), np.int64)
    begin[place], end[place] = w.begin, np.where(parted, last + 1, w.end)
    begin[place[parted] + 1], end[place[parted] + 1] = last[parted] + 1, w.end[parted]
    return w.data, begin, end, w.first + shift[w.first]


class Encoder:
    """Ids of texts by the tokenizers library, each with the end id.

    The vocabulary file's own rules make white space a border that no token crosses, lower-case, and part letters or digits from
    marks after them; so pieces are encoded once and their ids joined. A text that may hold a special string ("<|") is encoded whole.
    """

    def __init__(self, path: str, width: int, end: int):
        from tokenizers import Tokenizer

        self.library, self.kind, self.end = Tokenizer.from_file(path), f"<u{width}", end
        self.clear()

    def clear(self) -> None:
        """Forget all pieces; the first entry is the end id."""
        self.hash, self.entry = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.pool, self.begin, self.count = np.array([self.end], self.kind), np.zeros(1, np.int64), np.ones(1, np.int64)
        self.near, self.near_entry = np.zeros(1 << TABLE_BITS, np.uint64), np.full(1 << TABLE_BITS, -1, np.int64)

    def add(self, hashes: np.ndarray, fresh: list[str]) -> None:
        ids = [f.ids for a in range(0, len(fresh), 4096) for f in self.library.encode_batch_fast(fresh[a : a + 4096], add_special_tokens=False)]
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        begin = len(self.pool) + np.cumsum(count) - count
        self.pool = np.concatenate([self.pool, *(np.array(x, self.kind) for x in ids)])
        entry = len(self.begin) + np.arange(len(ids))
        self.begin, self.count = np.concatenate([self.begin, begin]), np.concatenate([self.count, count])
        at = np.searchsorted(self.hash, hashes)
        self.hash, self.entry = np.insert(self.hash, at, hashes), np.insert(self.entry, at, entry)

    def entries(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, anew: bool = False) -> np.ndarray:
        """The entry of each piece."""
        hashes = _hashes(data, begin, end)
        slot = (hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        out = np.where(self.near[slot] == hashes, self.near_entry[slot], -1)
        left = np.flatnonzero(out < 0)
        distinct, one, where = np.unique(hashes[left], return_index=True, return_inverse=True)
        at = np.searchsorted(self.hash, distinct)
        new = np.flatnonzero(np.concatenate([self.hash, [np.uint64(0)]])[at] != distinct) if len(self.hash) else np.arange(len(distinct))
        if len(new):
            if len(self.hash) + len(new) > CACHE_WORDS and len(self.hash) and not anew:
                self.clear()
                return self.entries(data, begin, end, anew=True)
            some = left[one[new]]
            self.add(distinct[new], [data[a:b].tobytes().decode() for a, b in zip(begin[some].tolist(), end[some].tolist(), strict=True)])
        found = self.entry[np.searchsorted(self.hash, distinct)]
        out[left] = found[where]
        slot = (distinct >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        self.near[slot], self.near_entry[slot] = distinct, found
        return out

    def encode(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and how many each has."""
        whole = [k for k, t in enumerate(texts) if t and b"<|" in t]
        entry, first = self._known([None if t and b"<|" in t else t for t in texts])
        begin, count, pool = self.begin, self.count, self.pool
        if whole:
            ids = [np.array(self.library.encode(texts[k].decode(), add_special_tokens=False).ids, self.kind) for k in whole]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            entry = np.insert(entry, first[whole], len(begin) + np.arange(len(ids)))
            first = first + np.concatenate([np.searchsorted(whole, np.arange(len(texts))), [len(whole)]])
            begin, count = np.concatenate([begin, len(pool) + np.cumsum(sizes) - sizes]), np.concatenate([count, sizes])
            pool = np.concatenate([pool, *ids])
        entry = np.insert(entry, first[1:], 0)
        n = count[entry]
        before = np.cumsum(n) - n
        flat = pool[np.repeat(begin[entry] - before, n) + np.arange(int(n.sum()))]
        return flat, np.add.reduceat(n, first[:-1] + np.arange(len(texts))) if texts else n

    def _known(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        data, begin, end, first = pieces(texts)
        return self.entries(data, begin, end), first


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, width: int, end: int) -> Encoder:
    """This worker's encoder."""
    if (path, width, end) not in _encoders:
        _encoders[path, width, end] = Encoder(path, width, end)
    return _encoders[path, width, end]


def _open(uri: str):
    return pyarrow.fs.FileSystem.from_uri(uri)


def write(docs: DataFrame, folder: str, path: str, *, end: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode all texts into shards under `folder`; the table of what the shards hold.

    One row per document (key, hash, shard, stem, repeat: which of the rows of that key), and one per shard with
    a null repeat and n_ids, the number of its ids. A task that runs again writes files of another name; only the files that
    the table names count.
    """
    from tokenizers import Tokenizer

    width = 2 if Tokenizer.from_file(path).get_vocab_size() < 1 << 16 else 4
    kind = docs.schema[key].dataType
    schema = T.StructType(
        [
            T.StructField("key", kind),
            T.StructField("hash", T.LongType()),
            T.StructField("shard", T.IntegerType()),
            T.StructField("stem", T.StringType()),
            T.StructField("repeat", T.LongType()),
            T.StructField("n_ids", T.LongType()),
        ]
    )

    def run(batches):
        shard = TaskContext.get().partitionId()
        stem = f"{folder}/{shard:06d}-{uuid.uuid4().hex}"
        out, hashes, lengths, last, seen = None, [], [], None, 0
        arrow = None
        for table in blocks(batches, "text", BLOCK_BYTES):
            if not len(table):
                continue
            if out is None:
                fs, name = _open(stem)
                fs.create_dir(name.rpartition("/")[0], recursive=True)
                out = fs.open_output_stream(f"{name}.ids")
                arrow = table.schema.field("key").type
            ids, n = encoder(path, width, end).encode(utf8(table.column("text").combine_chunks()))
            out.write(ids.tobytes())
            lengths.append(n)
            h = table.column("hash").to_numpy()
            # Which of the rows of its key each row is; a run may go on from the block before.
            new = np.concatenate([[last is None or h[0] != last], h[1:] != h[:-1]])
            order = np.arange(len(h))
            begin = np.maximum.accumulate(np.where(new, order, -1))
            repeat = np.where(begin < 0, order + seen, order - begin)
            last, seen = h[-1], int(repeat[-1]) + 1
            hashes.append(h)
            done = [table.column("key").combine_chunks(), pa.array(h), pa.array(np.full(len(h), shard, np.int32)), pa.array([stem] * len(h)), pa.array(repeat), pa.nulls(len(h), pa.int64())]
            yield pa.RecordBatch.from_arrays(done, names=schema.names)
        if out is not None:
            out.close()
            offsets = np.concatenate([[0], np.cumsum(np.concatenate(lengths))])
            index = ShardIndex.build(np.concatenate(hashes), offsets, width)
            with fs.open_output_stream(f"{name}.idx") as f:
                f.write(index.to_bytes())
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, arrow), pa.nulls(1, pa.int64()), pa.array([shard], pa.int32()), pa.array([stem]), pa.nulls(1, pa.int64()), pa.array([int(offsets[-1])], pa.int64())],
                names=schema.names,
            )

    rows = docs.select(docs[key].alias("key"), docs[text].alias("text")).withColumn("hash", F.xxhash64("key"))
    sorted_rows = rows.repartitionByRange("key", F.xxhash64("text")).sortWithinPartitions("key", F.xxhash64("text"), "text")
    return shared.written(sorted_rows.mapInArrow(run, schema), "token-shards")


def read(table: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """Look every document of a written table up in its shard's index and read its ids from the shard.

    Returns key, start (ids of all documents before it), n_tokens and ids_crc32 (of the ids as little-endian unsigned
    32-bit integers).
    """
    kind = table.schema["key"].dataType
    schema = T.StructType(
        [
            T.StructField("key", kind),
            T.StructField("shard", T.IntegerType()),
            T.StructField("first", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids_crc32", T.LongType()),
        ]
    )

    def run(batches):
        stem, index, payload = None, None, None
        for batch in batches:
            stems = batch.column("stem").to_pylist()
            cuts = [0, *(k for k in range(1, len(stems)) if stems[k] != stems[k - 1]), len(stems)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if stems[a] != stem:
                    stem = stems[a]
                    fs, name = _open(stem)
                    with fs.open_input_stream(f"{name}.idx") as f:
                        index = ShardIndex.from_bytes(f.read())
                    payload = fs.open_input_file(f"{name}.ids")
                part = batch.slice(a, b - a)
                at = index.ordinals(part.column("hash").to_numpy(), part.column("repeat").to_numpy())
                if (at < 0).any():
                    raise ValueError(f"{stem} lacks a document that was written to it")
                first, width = index.offsets[at], index.width
                n = index.offsets[at + 1] - first
                crc = []
                for x, length in zip(first.tolist(), n.tolist(), strict=True):
                    ids = np.frombuffer(payload.read_at(length * width, x * width), f"<u{width}")
                    crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), part.column("shard"), pa.array(first), pa.array(n), pa.array(crc, pa.int64())], names=schema.names
                )

    found = table.filter(F.col("repeat").isNotNull()).mapInArrow(run, schema)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = table.filter(F.col("repeat").isNull()).select("shard", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    return found.join(shards, "shard").select(
        F.col("key").alias(key), (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32"
    )
