"""Benchmark decontamination by an FM-index over each shard of the training texts.

A window is 10 consecutive words of a benchmark item, or all words of a shorter item. The items are prepared once, in
blocks of bounded size that lie in the shared folder; a task loads one block at a time, so that any number of items can be
searched for. A shard is a block of texts of one partition. Its words become symbols: numbers of the block's vocabulary.
Only runs of such words at least as long as the shortest window can hold a window; these runs, with separators, are
the text that the shard's FM-index is built over. All windows are searched backwards at once through the ranks of its
wavelet matrix, occurrences are located by sampled suffix positions, and overlapping ones merge to spans.

Defined cases: null texts, null items and texts without words have no words, no hits and no windows; an item of null id
counts for hits and is named by an empty string; items of equal text are all named; equal texts give equal rows; with no items nothing is contaminated; very
long texts are a block, and so a shard, of their own; rows that repeat stay rows of their own; only the named columns are read, so that others can't clash; empty tables give no rows.
"""

from __future__ import annotations

import io
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyvane.llm import shared
from tallyvane.llm.bpe import blocks
from tallyvane.llm.fm_index import FMIndex
from tallyvane.llm.words import ALNUM, utf8, words

#: Words of a window.
WINDOW = 10
#: Bytes of benchmark texts in a prepared block.
ITEM_BLOCK = 8 << 20
#: Bytes of training text in a shard.
SHARD_BYTES = 6 << 20

SPANS = T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())]))


class Items:
    """The windows of a block of benchmark items. `names` are the items' ids as strings; the k-th window's symbols stand
    at the right end of row k of `patterns`; owners of window k are owner[bounds[k]:bounds[k + 1]]."""

    def __init__(self, names: list[str], texts: list[bytes | None]):
        w = words(texts, ALNUM, lower=True)
        vocabulary, symbols = np.unique(w.hash, return_inverse=True)
        symbols = symbols + 1
        count = np.diff(w.first)
        per_item = np.where(count >= WINDOW, count - WINDOW + 1, (count > 0).astype(np.int64))
        owner = np.repeat(np.arange(len(names)), per_item)
        offset = np.arange(len(owner)) - np.repeat(np.cumsum(per_item) - per_item, per_item)
        begin = w.first[:-1][owner] + offset
        length = np.minimum(count[owner], WINDOW)
        column = np.arange(WINDOW)[None, :] - (WINDOW - length)[:, None]
        rows = np.where(column >= 0, symbols[np.minimum(begin[:, None] + np.maximum(column, 0), max(0, len(symbols) - 1))] if len(symbols) else 0, 0)
        self.patterns, window = np.unique(rows, axis=0, return_inverse=True) if len(rows) else (rows.reshape(0, WINDOW), np.zeros(0, np.int64))
        pairs = np.unique(np.stack([window.ravel(), owner], 1), axis=0)
        self.owner = pairs[:, 1]
        self.bounds = np.searchsorted(pairs[:, 0], np.arange(len(self.patterns) + 1))
        self.names, self.vocabulary = names, vocabulary
        self._prepare()

    def _prepare(self):
        self.lengths = (self.patterns > 0).sum(1)
        self.least = int(self.lengths.min()) if len(self.lengths) else 0
        self.maybe = np.zeros(1 << 18, bool)  # whether any word of the vocabulary has these low bits
        self.maybe[(self.vocabulary & np.uint64((1 << 18) - 1)).astype(np.int64)] = True

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, patterns=self.patterns, owner=self.owner, bounds=self.bounds, vocabulary=self.vocabulary, names=np.array(self.names, dtype=np.str_))
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Items:
        self, found = cls.__new__(cls), np.load(io.BytesIO(data))
        self.patterns, self.owner, self.bounds, self.vocabulary = (found[k] for k in ("patterns", "owner", "bounds", "vocabulary"))
        self.names = found["names"].tolist()
        self._prepare()
        return self

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each word in the vocabulary; 0 of others."""
        out = np.zeros(len(hashes), np.int64)
        some = np.flatnonzero(self.maybe[(hashes & np.uint64((1 << 18) - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocabulary, hashes[some]), len(self.vocabulary) - 1)
        out[some] = np.where(self.vocabulary[at] == hashes[some], at + 1, 0)
        return out

    def occurrences(self, hashes: np.ndarray, text_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First word and window of every occurrence of a window in the shard that these words are."""
        nothing = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(self.patterns) or not len(hashes):
            return nothing
        symbols = self.symbols(hashes)
        known = symbols > 0
        new = np.concatenate([[True], (known[1:] != known[:-1]) | (text_of[1:] != text_of[:-1])])
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(symbols)))
        run = known[begin] & (size >= self.least)
        begin, size = begin[run], size[run]
        if not len(begin):
            return nothing
        # Runs one after the other, a separator after each.
        start = np.cumsum(size + 1) - size - 1
        text = np.zeros(int((size + 1).sum()), np.int64)
        where = np.full(len(text), -1, np.int64)
        inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        place, source = np.repeat(start, size) + inner, np.repeat(begin, size) + inner
        text[place], where[place] = symbols[source], source
        index = FMIndex(text, len(self.vocabulary) + 1)
        low, high = index.search(self.patterns, self.lengths)
        count = np.maximum(0, high - low)
        hit = np.repeat(np.arange(len(low)), count)
        rows = np.repeat(low, count) + np.arange(len(hit)) - np.repeat(np.cumsum(count) - count, count)
        return where[index.locate(rows)], hit


@lru_cache(maxsize=2)
def _load(uri: str) -> Items:
    fs, name = pyarrow.fs.FileSystem.from_uri(uri)
    with fs.open_input_stream(name) as f:
        return Items.from_bytes(f.read())


def prepare(items: DataFrame, *, key: str = "item_id", text: str = "text") -> list[str]:
    """Write the items' windows as blocks into the shared folder; the blocks' paths."""
    folder = shared.folder(items.sparkSession, "benchmark-windows")

    def run(batches):
        for table in blocks(batches, "text", ITEM_BLOCK):
            uri = f"{folder}/{uuid.uuid4().hex}"
            fs, name = pyarrow.fs.FileSystem.from_uri(uri)
            fs.create_dir(name.rpartition("/")[0], recursive=True)
            with fs.open_output_stream(name) as f:
                f.write(Items(table.column("key").to_pylist(), utf8(table.column("text"))).to_bytes())
            yield pa.RecordBatch.from_arrays([pa.array([uri])], names=["uri"])

    rows = items.select(F.coalesce(items[key].cast("string"), F.lit("")).alias("key"), items[text].alias("text"))
    return sorted(r.uri for r in rows.mapInArrow(run, "uri string").collect())  # one path for each 8 MB of items


def find(texts: list[bytes | None], paths: list[str]):
    """The words of the texts, for each word whether it is in a hit, and for each text the names of items hit."""
    w = words(texts, ALNUM, lower=True)
    text_of = w.text_of
    depth = np.zeros(len(w.begin) + 1, np.int64)
    names: list[set[str]] = [set() for _ in texts]
    for path in paths:
        items = _load(path)
        begin, window = items.occurrences(w.hash, text_of)
        np.add.at(depth, begin, 1)
        np.add.at(depth, begin + items.lengths[window], -1)
        pairs = np.unique(text_of[begin] * len(items.patterns) + window)
        for pair in pairs.tolist():
            text, k = divmod(pair, len(items.patterns))
            names[text].update(items.names[o] for o in items.owner[items.bounds[k] : items.bounds[k + 1]].tolist())
    return w, np.cumsum(depth[:-1]) > 0, names


def search(docs: DataFrame, paths: list[str], *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Hits of every text: key, n_words, spans (of hit words, from begin to before end) and items (their ids as strings,
    sorted). No shuffle: each partition by itself."""
    kind = docs.schema[key].dataType
    schema = T.StructType(
        [
            T.StructField("key", kind),
            T.StructField("n_words", T.LongType()),
            T.StructField("spans", SPANS),
            T.StructField("items", T.ArrayType(T.StringType())),
        ]
    )
    pair = pa.struct([("begin", pa.int64()), ("end", pa.int64())])

    def run(batches):
        for table in blocks(batches, "text", SHARD_BYTES):
            w, hit, names = find(utf8(table.column("text").combine_chunks()), paths)
            first = w.first
            edge = np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))
            # A span ends with its text, too.
            cut = np.zeros(len(edge), bool)
            cut[first[1:-1]] = True
            begin = np.flatnonzero((edge == 1) | (cut & np.append(hit, False)))
            end = np.flatnonzero((edge == -1) | (cut & np.concatenate([[False], hit])))
            begin, end = begin[begin < len(hit)], end[end > 0]
            owner = np.searchsorted(first, begin, side="right") - 1
            offsets = np.searchsorted(owner, np.arange(len(first))).astype(np.int32)
            base = first[owner]
            spans = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(begin - base), pa.array(end - base)], fields=list(pair)))
            done = pa.Table.from_arrays([table.column("key"), pa.array(np.diff(first)), spans, pa.array([sorted(n) for n in names], pa.list_(pa.string()))], names=schema.names)
            yield from done.combine_chunks().to_batches(max_chunksize=10_000)

    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


def remove(docs: DataFrame, paths: list[str], *, text: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, with every hit span cut from the text: from its first word's first byte to its last
    word's last. Texts without hits stay as they are."""

    at = docs.columns.index(text)

    def run(batches):
        for table in blocks(batches, text, SHARD_BYTES):
            column = table.column(at)
            texts = utf8(column.combine_chunks())
            bases = np.cumsum([0, *(len(t) + 1 if t else 1 for t in texts)])
            w, hit, _ = find(texts, paths)
            for k in np.unique(w.text_of[hit]).tolist():
                inside = hit[w.first[k] : w.first[k + 1]]
                edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
                begin = w.begin[w.first[k] : w.first[k + 1]][np.flatnonzero(edge == 1)]
                end = w.end[w.first[k] : w.first[k + 1]][np.flatnonzero(edge == -1) - 1]
                base = bases[k]
                whole, kept, last = texts[k], [], 0
                for b, e in zip((begin - base).tolist(), (end - base).tolist(), strict=True):
                    kept.append(whole[last:b])
                    last = e
                texts[k] = b"".join([*kept, whole[last:]])
            new = pa.array(texts, pa.binary()).cast(column.type)
            yield from table.set_column(at, table.schema.field(at), pa.chunked_array([new])).to_batches()

    return docs.mapInArrow(run, docs.schema)
