"""Substring deduplication with an FM-index per shard.

A window is 20 consecutive words of one text. Every window has a minimizer: the least hash of its 16 five-word shingles.
Equal windows have equal minimizers, so a segment, which is a longest run of windows of equal minimizer with all their
words, goes to the shard that the minimizer's hash names, and all equal windows meet in one shard. A block of texts sends
each distinct segment once per shard, with the places where it stands, so that a passage that many texts share counts
little. A shard keeps segments whose minimizer stands in two distinct ones or twice in one; all others hold no repeat.

Over these distinct segments the shard builds an FM-index. Its symbols are numbers of five-word shingles, laid out at a
stride of five, so that a window is four symbols; the segments are streamed against it, every position at once, and the
backward search through the wavelet matrix gives the rows of each position's match of threshold length. A window is
removed if any of its rows stands earlier: in a smaller doc_id, or in the same document with an earlier start. What is
removed goes back to the texts as intervals of words.

Defined cases: a null text has no words; a null doc_id comes before all others; rows of equal doc_id count as one document,
so of two such rows a window is removed only where it starts later; the rows, repeated ones too, stay apart in the result; a text without
words, empty ones included, loses nothing; very long texts are cut into segments like all others; rows travel in a struct, so that no name of theirs
clashes; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyvane.llm.bpe import blocks
from tallyvane.llm.fm_index import FMIndex
from tallyvane.llm.shared import give_back
from tallyvane.llm.words import SPACED, mixed, utf8, windows, words

#: Words of a window, of a shingle, and shingles of a window.
WINDOW, SHINGLE = 20, 5
SHINGLES = WINDOW - SHINGLE + 1
#: Bytes of text whose segments are put together before they are sent.
BLOCK_BYTES = 4 << 20
#: Rows whose words are taken out at a time.
SLICE_ROWS = 1000
#: Bytes of text for each shard at most, about.
SHARD_BYTES = 64 << 20
#: The place of a null doc_id in the order of documents.
NULL_DOC = -(2**63)


def ragged(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ..., of the given sizes, one range after the other."""
    ends = np.cumsum(size)
    return np.repeat(begin - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)


def minimizers(shingle: np.ndarray) -> np.ndarray:
    """Least of each 16 consecutive hashes."""
    least, width = shingle, 1
    while width < SHINGLES:
        least, width = np.minimum(least[:-width], least[width:]), width * 2
    return least


def segments(texts: list[bytes | None]):
    """Segments of the texts: text, first word, number of windows, minimizer, whether that stands in it twice; and the
    segment's words, one space between them."""
    w = words(texts, SPACED)
    n = len(w.begin) - WINDOW + 1
    if n <= 0:
        return None
    text_of = w.text_of
    shingle = windows(w.hash, SHINGLE)
    least = minimizers(shingle)
    inside = w.left()[:n] >= WINDOW
    new = np.concatenate([[True], (least[1:] != least[:-1]) | (text_of[1:n] != text_of[: n - 1])])
    begin = np.flatnonzero(new & inside)
    if not len(begin):
        return None
    stop = np.flatnonzero(np.concatenate([new[1:] | ~inside[1:], [True]]) & inside) + 1
    size = stop - begin
    spans = size + SHINGLES - 1
    hits = shingle[ragged(begin, spans)] == np.repeat(least[begin], spans)
    double = np.add.reduceat(hits, np.cumsum(spans) - spans, dtype=np.int64) > 1
    # The words with one space between them, and where each begins there.
    keep = SPACED[w.data].copy()
    keep[w.end] = True
    flat = w.data[keep]
    length = w.end - w.begin + 1
    place = np.cumsum(length) - length
    flat[place + length - 1] = 0x20
    return w, text_of, begin, size, least[begin], double, flat.tobytes(), place, place + length - 1


def pack(shards: int, texts, order: np.ndarray, digest: np.ndarray):
    """For each shard the block's segments as one compressed row of bytes."""
    found = segments(texts)
    if found is None:
        return
    w, text_of, begin, size, least, double, flat, place, stop = found
    shard = (mixed(least, 11) % np.uint64(shards)).astype(np.int64)
    by = np.argsort(shard, kind="stable")
    at, end = place[begin].tolist(), stop[begin + size + WINDOW - 2].tolist()
    start = begin - w.first[text_of[begin]]
    text = text_of[begin]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(shard[by])) + 1, [len(by)]]).tolist()
    squeeze = zstandard.ZstdCompressor(level=5)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        own = by[a:b]
        number: dict[bytes, int] = {}
        place_of = np.fromiter((number.setdefault(flat[at[k] : end[k]], len(number)) for k in own.tolist()), np.int64, len(own))
        one = np.empty(len(number), np.int64)
        one[place_of] = own
        docs, doc = np.unique(text[own], return_inverse=True)
        parts = [
            np.array([len(number), len(own), len(docs)], "<i8"),
            order[docs].astype("<i8"),
            digest[docs].astype("<i8"),
            least[one].astype("<u8"),
            double[one].astype("<u1"),
            np.fromiter(map(len, number), "<u4", len(number)),
            place_of.astype("<u4"),
            doc.astype("<u4"),
            start[own].astype("<u4"),
        ]
        yield int(shard[own[0]]), squeeze.compress(b"".join([*(p.tobytes() for p in parts), *number]))


def unpack(blob: bytes):
    data = zstandard.ZstdDecompressor().decompress(blob)
    at = 24
    n, m, d = np.frombuffer(data, "<i8", 3).tolist()

    def take(kind, count):
        nonlocal at
        out = np.frombuffer(data, kind, count, at)
        at += out.nbytes
        return out

    fields = [take("<i8", d), take("<i8", d), take("<u8", n), take("<u1", n), take("<u4", n), take("<u4", m), take("<u4", m), take("<u4", m)]
    return fields, data[at:]


def repeats(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a shard: order and digest of the document, first word and end of every interval to remove."""
    nothing = tuple(np.zeros(0, np.int64) for _ in range(4))
    opened = [unpack(b) for b in blobs]
    least = np.concatenate([f[2] for f, _ in opened])
    double = np.concatenate([f[3] for f, _ in opened]).astype(bool)
    _, group, count = np.unique(least, return_inverse=True, return_counts=True)
    # A block's segments are distinct; of several blocks they needn't be. A segment that stands in many places counts too.
    shift = np.cumsum([0, *(len(f[2]) for f, _ in opened)])
    seg = np.concatenate([f[5] + s for (f, _), s in zip(opened, shift[:-1], strict=True)]).astype(np.int64)
    places = np.bincount(seg, minlength=len(least))
    live = double | (np.bincount(group, places)[group] > 1)
    number: dict[bytes, int] = {}
    to = np.full(len(least), -1, np.int64)
    for (f, body), s in zip(opened, shift[:-1].tolist(), strict=True):
        stop = np.cumsum(f[4].astype(np.int64))
        for k in np.flatnonzero(live[s : s + len(f[2])]).tolist():
            to[s + k] = number.setdefault(body[stop[k] - f[4][k] : stop[k]], len(number))
    order = np.concatenate([f[0][f[6]] for f, _ in opened])
    digest = np.concatenate([f[1][f[6]] for f, _ in opened])
    start = np.concatenate([f[7] for f, _ in opened]).astype(np.int64)
    del opened
    seg = to[seg]
    some = seg >= 0
    if not some.any():
        return nothing
    seg, order, digest, start = seg[some], order[some], digest[some], start[some]
    least_of = np.empty(len(number), np.uint64)
    least_of[to[live]] = least[live]
    double_of = np.zeros(len(number), bool)
    double_of[to[live]] = double[live]
    # Places of each distinct segment in the order of documents: all but the first lose all their words.
    by = np.lexsort((start, order, seg))
    seg, order, digest, start = seg[by], order[by], digest[by], start[by]
    new = np.concatenate([[True], seg[1:] != seg[:-1]])
    head = np.flatnonzero(new)
    rank = np.unique(order, return_inverse=True)[1]
    first = (rank[head] << 32) + start[head]
    length = np.fromiter((b.count(b" ") + 1 for b in number), np.int64, len(number))
    later = (rank << 32) + start > first[seg]
    out = [(order[later], digest[later], start[later], start[later] + length[seg[later]])]
    # Only segments that share a minimizer with another distinct one, or hold it twice, can repeat in part.
    shared = np.unique(least_of, return_inverse=True, return_counts=True)
    part = np.flatnonzero(double_of | (shared[2][shared[1]] > 1))
    if len(part):
        bodies = list(number)
        gone = partly([bodies[k] for k in part.tolist()], first[part])
        del bodies
        which, begin, end = gone
        # Rows of equal doc_id and start stand for the first place together.
        at_first = np.flatnonzero(~later)
        row_begin = np.searchsorted(seg[at_first], part[which])
        rows = np.searchsorted(seg[at_first], part[which], side="right") - row_begin
        source = at_first[ragged(row_begin, rows)]
        begin, end = np.repeat(begin, rows), np.repeat(end, rows)
        out.append((order[source], digest[source], start[source] + begin, start[source] + end))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def partly(bodies: list[bytes], first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segment, first word and end of the runs of windows that also start earlier; first: place of each segment."""
    w = words(bodies, SPACED)
    text_of, left = w.text_of, w.left()
    blocks_of = WINDOW // SHINGLE
    shingle = windows(w.hash, SHINGLE)
    n = len(shingle)
    symbol = np.unique(shingle, return_inverse=True)[1] + 1
    size = int(symbol.max()) + 1
    whole = left[:n] >= SHINGLE
    # Each segment five times: the shingles from its first word on at a stride of five, from its second on, and so on.
    count = np.maximum(0, np.diff(w.first) - SHINGLE + 1)
    lanes = np.repeat(np.arange(len(bodies)), SHINGLE)
    offset = np.tile(np.arange(SHINGLE), len(bodies))
    steps = np.maximum(0, -(-(count[lanes] - offset) // SHINGLE))
    inner = ragged(np.zeros(len(steps), np.int64), steps)
    source = np.repeat(w.first[lanes] + offset, steps) + SHINGLE * inner
    at = np.repeat(np.cumsum(steps + 1) - steps - 1, steps) + inner
    text = np.zeros(int((steps + 1).sum()), np.int64)
    text[at] = np.where(whole[source], symbol[source], 0)
    key = np.full(len(text) + 1, np.iinfo(np.int64).max)
    key[at] = first[text_of[source]] + source - w.first[text_of[source]]
    index = FMIndex(text, size, depth=blocks_of)
    ask = np.flatnonzero(left >= WINDOW)
    patterns = symbol[ask[:, None] + SHINGLE * np.arange(blocks_of)[None, :]]
    low, high = index.search(patterns, np.full(len(ask), blocks_of), least=2)
    ask, low, high = ask[high > low], low[high > low], high[high > low]
    if not len(ask):
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    # Rows of a full match are disjoint or the same for two windows: the earliest place of each.
    rows, same = np.unique(low, return_inverse=True)
    top = np.empty(len(rows), np.int64)
    top[same] = high
    # One more place behind the last row, as the last range ends there.
    placed = np.append(key[index.order], np.iinfo(np.int64).max)
    earliest = np.minimum.reduceat(placed, np.stack([rows, top], 1).ravel())[::2]
    own = first[text_of[ask]] + ask - w.first[text_of[ask]]
    ask = ask[earliest[same] < own]
    if not len(ask):
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    fresh = np.concatenate([[True], (ask[1:] != ask[:-1] + 1) | (text_of[ask[1:]] != text_of[ask[:-1]])])
    begin = ask[fresh]
    end = ask[np.concatenate([np.flatnonzero(fresh)[1:] - 1, [len(ask) - 1]])] + WINDOW
    return text_of[begin], begin - w.first[text_of[begin]], end - w.first[text_of[begin]]


def find(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Intervals of words to remove: doc (the key's place in the order of documents), digest (hash of the text) and
    gone, an array of (begin, end); they may overlap."""
    # A shard is one group of a task: their number follows the texts' bytes, so that it keeps its size.
    size = docs.agg(F.sum(F.octet_length(docs[text]).cast("long")).alias("n")).first().n or 0
    shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // SHARD_BYTES)
    rows = docs.filter(docs[text].isNotNull()).select(
        F.coalesce(docs[key].cast("long"), F.lit(NULL_DOC)).alias("doc"), F.xxhash64(docs[text]).alias("digest"), docs[text].alias("text")
    )

    def send(batches):
        for table in blocks(batches, "text", BLOCK_BYTES):
            give_back()
            order, digest = table.column("doc").to_numpy(), table.column("digest").to_numpy()
            for shard, blob in pack(shards, utf8(table.column("text").combine_chunks()), order, digest):
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([blob], pa.binary())], names=["shard", "blob"])

    def meet(table: pa.Table) -> pa.Table:
        give_back()
        found = repeats(table.column("blob").to_pylist())
        return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in found], names=["doc", "digest", "begin", "end"])

    sent = rows.mapInArrow(send, "shard int, blob binary")
    met = sent.groupBy("shard").applyInArrow(meet, "doc long, digest long, begin long, end long")
    # No more intervals of a text than it has words.
    return met.groupBy("doc", "digest").agg(F.collect_list(F.struct("begin", "end")).alias("gone"))


def joined(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Each row of `docs` as a struct, with the intervals to remove from its text."""
    gone = find(docs, key=key, text=text).withColumnsRenamed({"doc": "gone_doc", "digest": "gone_digest"})
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    rows = rows.withColumns({"doc": F.coalesce(F.col("row")[key].cast("long"), F.lit(NULL_DOC)), "digest": F.xxhash64(F.col("row")[text])})
    on = (F.col("doc") == F.col("gone_doc")) & (F.col("digest") == F.col("gone_digest"))
    return rows.join(gone, on, "left").select("row", "gone")


def slices(batches):
    """Batches of fewer rows, and what the one before has left given back."""
    for batch in batches:
        for k in range(0, len(batch), SLICE_ROWS):
            give_back()
            yield batch.slice(k, SLICE_ROWS)


def removed(texts: list[bytes | None], gone: pa.Array):
    """The words of the texts, and for each whether it is removed."""
    w = words(texts, SPACED, hashed=False)
    size = np.diff(gone.offsets.to_numpy()) if gone.null_count == 0 else gone.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = gone.flatten()
    base = np.repeat(w.first[:-1], size)
    depth = np.zeros(len(w.begin) + 1, np.int64)
    np.add.at(depth, base + flat.field("begin").to_numpy(), 1)
    np.add.at(depth, base + flat.field("end").to_numpy(), -1)
    return w, np.cumsum(depth[:-1]) > 0


def digests(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of `docs`: key, n_words, n_removed, and kept_sha256 of the kept words, one space between them."""
    schema = T.StructType(
        [
            T.StructField("key", docs.schema[key].dataType),
            T.StructField("n_words", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField("kept_sha256", T.StringType()),
        ]
    )

    def run(batches):
        for batch in slices(batches):
            texts = utf8(batch.column("text"))
            w, out = removed(texts, batch.column("gone"))
            counts = np.concatenate([[0], np.cumsum(out)])
            sha = []
            for k, t in enumerate(texts):
                own = (t or b"").split() if t is None or not out[w.first[k] : w.first[k + 1]].any() else None
                if own is None:
                    own = np.array(t.split(), object)[~out[w.first[k] : w.first[k + 1]]]
                sha.append(hashlib.sha256(b" ".join(own)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(np.diff(w.first)), pa.array(counts[w.first[1:]] - counts[w.first[:-1]]), pa.array(sha, pa.string())], names=schema.names
            )

    rows = joined(docs.select(docs[key].alias("key"), docs[text].alias("text")), "key", "text").select("row.key", "row.text", "gone")
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


def remove(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, with removed words cut from the text: each run of them from its first byte to
    before the next kept word."""
    fields = docs.schema

    def run(batches):
        at = fields.names.index(text)
        for batch in slices(batches):
            rows = batch.column("row").flatten()
            texts = utf8(rows[at])
            w, out = removed(texts, batch.column("gone"))
            base = np.cumsum([0, *(len(t) + 1 if t else 1 for t in texts)])
            for k in np.unique(w.text_of[out]).tolist():
                a, b = int(w.first[k]), int(w.first[k + 1])
                edge = np.diff(np.concatenate([[False], out[a:b], [False]]).astype(np.int8))
                whole, last, kept = texts[k], 0, []
                for x, y in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
                    kept.append(whole[last : w.begin[a + x] - base[k]])
                    last = int(w.begin[a + y] - base[k]) if a + y < b else len(whole)
                texts[k] = b"".join([*kept, whole[last:]])
            rows[at] = pa.array(texts, pa.binary()).cast(rows[at].type)
            yield pa.RecordBatch.from_arrays(rows, names=fields.names)

    return joined(docs, key, text).mapInArrow(run, fields)
