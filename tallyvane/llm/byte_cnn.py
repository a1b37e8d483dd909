"""Language identification by a byte convolutional network.

A text is cut into windows of fixed length, the whole text from its first byte to its last. Filters of several widths
slide over a window's bytes; each filter's greatest response and a softmax over the learned languages give the window's
chances. The mean of its windows' log chances, weighted by their letters, decides the text. Training is plain numpy on a
bounded sample of labelled texts, by gradients that pass through the maxima.

A filter's responses to all pairs of bytes are tabulated before texts are scored, so that a filter of four bytes is two
look-ups; batches of windows go through together.

Defined cases: a text that is null or has no letter is `und` with score 0; so is every text if no labelled text exists; rows
without a key are never learned from and not held out; equal texts get equal rows; equal chances go to the language that comes first; very long
texts are scored whole, in windows of fixed length, a block of texts at a time; rows that repeat stay rows of their own; only the named columns are read, so that others can't clash; empty tables give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyvane.llm.bpe import blocks
from tallyvane.llm.words import mixed, utf8

#: Labelled texts of each language, and windows of each text, that the network is trained on at most: those that come first by a hash
#: of key and place, wherever they are in the text.
TEXTS_PER_LANGUAGE, WINDOWS_PER_TEXT = 250, 2
#: Labelled texts in all: those of 200 languages.
MOST_TEXTS = 50_000
#: Bytes of a window; widths of filters, and filters of each.
LENGTH, WIDTHS, FILTERS = 192, (2, 3, 4), 12
#: Passes over the sample.
PASSES = 14
BLOCK_BYTES = 1 << 20

UNKNOWN = "und"


def byte_classes() -> np.ndarray:
    """ASCII letters regardless of case, digits, other ASCII characters as one, and every byte of other characters."""
    kind = np.zeros(256, np.int64)
    for k, letter in enumerate(b"abcdefghijklmnopqrstuvwxyz"):
        kind[letter] = kind[letter - 32] = 2 + k
    kind[0x30:0x3A] = 1
    kind[0x80:] = 28 + np.arange(128)
    return kind


CLASS = byte_classes()
CLASSES = 156
LETTER = (CLASS >= 2) & (np.arange(256) < 0xC0) & (np.arange(256) < 0x80) | (np.arange(256) >= 0xC0)


def cut(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of the texts' classes, one row each, padded by class 0; number of the first window of each text, and of all;
    letters of each window, about (a byte that begins a character outside ASCII counts as one)."""
    size = np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts))
    n = np.maximum(1, -(-size // LENGTH))
    first = np.concatenate([[0], np.cumsum(n)])
    data = np.frombuffer(b"".join((t or b"").ljust(k * LENGTH, b"\0") for t, k in zip(texts, n.tolist(), strict=True)), np.uint8)
    rows = data.reshape(-1, LENGTH)
    return CLASS[rows], first, LETTER[rows].sum(1)


@dataclass
class Network:
    """filters: for each width an array (width, CLASSES, FILTERS); dense and bias: from all filters to the languages."""

    languages: list[str]
    filters: list[np.ndarray]
    dense: np.ndarray
    bias: np.ndarray

    @classmethod
    def train(cls, windows: np.ndarray, labels: np.ndarray, languages: list[str], rate: float = 0.02, batch: int = 64) -> Network:
        gen = np.random.default_rng(17)
        params = [gen.normal(0, 0.3, (w, CLASSES, FILTERS)).astype(np.float32) for w in WIDTHS]
        params += [gen.normal(0, 0.3, (len(WIDTHS) * FILTERS, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32)]
        mean, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        turn = 0
        column = np.arange(FILTERS)[None, :]
        for _ in range(PASSES):
            order = gen.permutation(len(windows))
            for a in range(0, len(order), batch):
                x, y = windows[order[a : a + batch]], labels[order[a : a + batch]]
                row = np.arange(len(x))[:, None]
                peaks, values = [], []
                for w, f in zip(WIDTHS, params, strict=False):
                    m = LENGTH - w + 1
                    response = sum(f[j][x[:, j : j + m]] for j in range(w))
                    peak = response.argmax(1)
                    peaks.append(peak)
                    values.append(response[row, peak, column])
                top = np.concatenate(values, 1)
                hidden = np.maximum(top, 0)
                logit = hidden @ params[-2] + params[-1]
                chance = np.exp(logit - logit.max(1, keepdims=True))
                chance /= chance.sum(1, keepdims=True)
                chance[np.arange(len(y)), y] -= 1
                chance /= len(y)
                down = (chance @ params[-2].T) * (top > 0)
                slopes = []
                for k, (w, f) in enumerate(zip(WIDTHS, params, strict=False)):
                    g = np.zeros_like(f)
                    own = down[:, k * FILTERS : (k + 1) * FILTERS]
                    for j in range(w):
                        np.add.at(g[j], (x[row, peaks[k] + j], np.broadcast_to(column, own.shape)), own)
                    slopes.append(g)
                slopes += [hidden.T @ chance, chance.sum(0)]
                turn += 1
                for p, g, m1, m2 in zip(params, slopes, mean, square, strict=True):
                    m1 += 0.1 * (g - m1)
                    m2 += 0.01 * (g * g - m2)
                    p -= rate * (m1 / (1 - 0.9**turn)) / (np.sqrt(m2 / (1 - 0.99**turn)) + 1e-7)
        return cls(languages, params[: len(WIDTHS)], params[-2], params[-1])

    def tabulate(self) -> None:
        """Responses to pairs of bytes: for each width, tables for bytes 0-1, 2-3 and so on; a last odd byte has its own."""
        self.tables = []
        for f in self.filters:
            own = []
            for j in range(0, len(f), 2):
                own.append((f[j][:, None] + f[j + 1][None, :]).reshape(-1, FILTERS) if j + 1 < len(f) else f[j])
            self.tables.append(own)

    def log_chances(self, windows: np.ndarray) -> np.ndarray:
        """Log chance of each language for each window."""
        if not hasattr(self, "tables"):
            self.tabulate()
        pair = windows[:, :-1] * CLASSES + windows[:, 1:]
        out = np.empty((len(windows), len(WIDTHS) * FILTERS), np.float32)
        for a in range(0, len(windows), 256):  # a batch's responses stay in the processor's cache
            x, two = windows[a : a + 256], pair[a : a + 256]
            for k, (w, tables) in enumerate(zip(WIDTHS, self.tables, strict=True)):
                m = LENGTH - w + 1
                response = tables[0][two[:, :m]]
                for t, table in enumerate(tables[1:], 1):
                    response += table[(two if 2 * t + 1 < w else x)[:, 2 * t : 2 * t + m]]
                out[a : a + 256, k * FILTERS : (k + 1) * FILTERS] = response.max(1)
        logit = np.maximum(out, 0) @ self.dense + self.bias
        logit -= logit.max(1, keepdims=True)
        return logit - np.log(np.exp(logit).sum(1, keepdims=True))

    def predict(self, texts: list[bytes | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        if not self.languages or not texts:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        windows, first, letters = cut(texts)
        weight = letters + 1e-3
        whole = np.add.reduceat(self.log_chances(windows) * weight[:, None], first[:-1]) / np.add.reduceat(weight, first[:-1])[:, None]
        chance = np.exp(whole - whole.max(1, keepdims=True))
        chance /= chance.sum(1, keepdims=True)
        best = chance.argmax(1)
        found, score = [self.languages[k] for k in best.tolist()], chance.max(1).astype(float)
        some = np.add.reduceat(letters, first[:-1]) > 0
        for k, t in enumerate(texts):
            if not t or not (some[k] and has_letter(t)):
                found[k], score[k] = UNKNOWN, 0.0
        return found, score


def has_letter(text: bytes) -> bool:
    if text.isascii():
        return text.lower() != text.upper()
    return any(c.isalpha() for c in text.decode())


def held_out(key) -> F.Column:
    """Whether a row is left out of learning: crc32 of its key, as text, is 1 modulo 3."""
    return F.coalesce(F.crc32(key.cast("string")) % 3 == 1, F.lit(False))


def trained(docs: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "lang") -> Network:
    """The network trained on the texts of each language that come first by a hash of their keys."""
    known = docs.filter(docs[key].isNotNull() & docs[label].isNotNull() & docs[text].isNotNull() & ~held_out(docs[key]))
    names = known.select(known[key].alias("key"), known[label].alias("label"))
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("key"), "key"))
    some = names.withColumn("rank", rank).filter(F.col("rank") <= TEXTS_PER_LANGUAGE).select("key").distinct()
    some = F.broadcast(some.orderBy(F.xxhash64("key"), "key").limit(MOST_TEXTS))
    rows = known.select(known[key].alias("key"), known[text].alias("text"), known[label].alias("label")).join(some, "key")

    def choose(batches):
        for table in blocks(batches, "text", BLOCK_BYTES):
            windows, first, letters = cut(utf8(table.column("text").combine_chunks()))
            some = np.flatnonzero(letters > LENGTH // 8)
            owner = np.searchsorted(first, some, side="right") - 1
            place = some - first[owner]
            by = np.lexsort((mixed(table.column("hash").to_numpy()[owner].view(np.uint64) + place.astype(np.uint64), 3), owner))
            some, owner, place = some[by], owner[by], place[by]
            first_few = np.arange(len(owner)) - np.searchsorted(owner, owner) < WINDOWS_PER_TEXT
            some, owner, place = some[first_few], owner[first_few], place[first_few]
            rows = [table.column(c).combine_chunks().take(pa.array(owner)) for c in ("label", "hash")]
            bytes_ = pa.array([w.tobytes() for w in windows[some].astype(np.uint8)], pa.binary())
            yield pa.RecordBatch.from_arrays([*rows, pa.array(place, pa.int64()), bytes_], names=["label", "hash", "place", "window"])

    chosen = rows.select("text", "label", F.xxhash64("key").alias("hash")).mapInArrow(choose, "label string, hash long, place long, window binary")
    sample = chosen.orderBy("label", "hash", "place", "window").limit(MOST_TEXTS * WINDOWS_PER_TEXT).toArrow()
    labels = sample.column("label").to_pylist()
    languages = sorted(set(labels))
    if not languages:
        return Network([], [], np.zeros((0, 0)), np.zeros(0))
    windows = np.frombuffer(b"".join(sample.column("window").to_pylist()), np.uint8).reshape(-1, LENGTH).astype(np.int64)
    number = {name: k for k, name in enumerate(languages)}
    return Network.train(windows, np.array([number[x] for x in labels], np.int64), languages)


def identify(docs: DataFrame, network: Network, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred and score of every text: no shuffle, each partition by itself."""
    fields = [("key", docs.schema[key].dataType), ("lang_pred", T.StringType()), ("score", T.DoubleType())]
    schema = T.StructType([T.StructField(*f) for f in fields])

    def run(batches):
        for table in blocks(batches, "text", BLOCK_BYTES):
            found, score = network.predict(utf8(table.column("text").combine_chunks()))
            done = pa.Table.from_arrays([table.column("key"), pa.array(found, pa.string()), pa.array(score, pa.float64())], names=schema.names)
            yield from done.combine_chunks().to_batches()

    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)
