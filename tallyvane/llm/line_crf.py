"""Quality rules by line labelling: a linear-chain conditional random field marks lines as content or boilerplate.

The field is trained in numpy on a bounded sample of labelled documents, by gradient ascent on the likelihood of whole
line sequences. Only the documents' labels teach it: lines of good ones are content unless they repeat an earlier line or have no words,
lines of bad ones are boilerplate. Viterbi decoding finds the most likely
labels of all lines of a text; the share of words on content lines decides whether it is kept, after the plain base rules.

Defined cases: a null text counts as empty: no words, so the base rules fail it; equal texts give equal rows; with no
labelled sample the field has no weights and calls every line content, so that only the base rules decide; equally likely labels of a
line are boilerplate; very long texts are labelled whole, all lines of a block of texts at a time; rows that repeat stay rows of their own; only the named columns are read, so that others can't clash; empty tables give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyvane.llm.bpe import blocks
from tallyvane.llm.words import SPACED, Words, mixed, utf8, windows, words
from tallyvane.llm.words import _hashes as span_hashes

#: Labelled documents that the field is trained on at most, and lines of each that training reads.
SAMPLE, SAMPLE_LINES = 800, 40
#: Least share of words on content lines in a text that is kept.
CONTENT = 0.5
#: Fewest words, and most per cent of repeated words, that the base rules let pass.
LEAST_WORDS, MOST_REPEATED = 50, 50
BLOCK_BYTES = 4 << 20

BOILERPLATE, CONTENT_LINE = 0, 1
CUES = ["License", "license", "License.", "Copyright", "copyright", "(c)", "rights", "reserved.", "Cookie", "cookies", "Subscribe", "Share", "Login"]


def byte_kind(characters: str) -> np.ndarray:
    kind = np.zeros(256, bool)
    kind[[ord(c) for c in characters]] = True
    return kind


SYMBOL = byte_kind("#*$%&|<>")
DIGIT = byte_kind("0123456789")
UPPER = byte_kind("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
LOWER = byte_kind("abcdefghijklmnopqrstuvwxyz")
STOP = byte_kind(".!?:;\"')")
PIPE = byte_kind("|")
BANG = byte_kind("!")


@dataclass
class Lines:
    """Lines of a block of texts: first of each text (and the number of all), words on each, whether it equals an earlier
    one of its text, and its features, one row of booleans each."""

    words: Words
    first: np.ndarray
    n_words: np.ndarray
    repeated: np.ndarray
    features: np.ndarray
    symbols: np.ndarray


def lines(texts: list[bytes | None]) -> Lines:
    w = words(texts, SPACED)
    end = np.flatnonzero(w.data == 0x0A)
    begin = np.concatenate([[0], end[:-1] + 1])
    last = np.cumsum([len(t) + 1 if t else 1 for t in texts]) - 1
    first = np.concatenate([[0], np.searchsorted(end, last, side="right")]).astype(np.int64)
    text_of = np.repeat(np.arange(len(texts)), np.diff(first))

    def count(kind):
        sums = np.concatenate([[0], np.cumsum(kind[w.data], dtype=np.int64)])
        return sums[end] - sums[begin]

    n_words = np.bincount(np.searchsorted(end, w.begin), minlength=len(end))
    name = span_hashes(w.data, begin, end) ^ mixed(text_of, 3)
    earliest = np.unique(name, return_index=True, return_inverse=True)
    repeated = (earliest[1][earliest[2]] != np.arange(len(end))) & (n_words > 0)
    size = np.maximum(end - begin, 1)
    symbols, digits, upper, lower, pipes, bangs = (count(k) for k in (SYMBOL, DIGIT, UPPER, LOWER, PIPE, BANG))
    cues = words([c.encode() for c in CUES], SPACED).hash
    cue = np.bincount(np.searchsorted(end, w.begin[np.isin(w.hash, cues)]), minlength=len(end)) > 0
    stops = STOP[w.data[np.maximum(end - 1, 0)]] & (end > begin)
    per_word = size / np.maximum(n_words, 1)
    place = np.arange(len(end)) - first[text_of]
    features = np.stack(
        [
            np.ones(len(end), bool),
            repeated,
            n_words == 0,
            (n_words >= 1) & (n_words <= 2),
            (n_words >= 3) & (n_words <= 6),
            (n_words >= 7) & (n_words <= 30),
            n_words > 30,
            symbols == 0,
            (symbols > 0) & (symbols <= 0.02 * size),
            (symbols > 0.02 * size) & (symbols <= 0.08 * size),
            symbols > 0.08 * size,
            stops,
            digits > 0.2 * size,
            upper > 0.5 * (upper + lower) + 1,
            pipes >= 2,
            bangs > 0.3 * n_words + 1,
            cue,
            per_word < 3.5,
            (per_word >= 3.5) & (per_word <= 14),
            per_word > 14,
            place == 0,
            place == np.diff(first)[text_of] - 1,
        ],
        axis=1,
    )
    total = np.concatenate([[0], np.cumsum(symbols)])
    return Lines(w, first, n_words, repeated, features, total[first[1:]] - total[first[:-1]])


@dataclass
class Field:
    """weights: of each feature for the content label against boilerplate; moves: of each label after each."""

    weights: np.ndarray
    moves: np.ndarray

    def decode(self, found: Lines) -> np.ndarray:
        """Most likely label of each line, by Viterbi decoding of every text's lines side by side."""
        gain = np.zeros((len(found.features), 2))
        gain[:, CONTENT_LINE] = found.features @ self.weights
        size = np.diff(found.first)
        order = np.argsort(-size, kind="stable")
        start, size = found.first[:-1][order], size[order]
        back = np.zeros((len(gain), 2), np.int8)
        best = gain[start].copy()
        at_end = np.zeros(len(start), np.int64)
        left = len(start)
        for step in range(1, int(size[0]) if len(size) else 0):
            while left and size[left - 1] <= step:
                left -= 1
            here = start[:left] + step
            through = best[:left, :, None] + self.moves[None]
            back[here] = through.argmax(1)
            best[:left] = through.max(1) + gain[here]
        at_end = best.argmax(1)
        label = np.zeros(len(gain), np.int8)
        now = at_end.copy()
        # Backwards: the texts whose last line it is join at each step.
        for step in range(int(size[0]) - 1 if len(size) else -1, -1, -1):
            live = np.searchsorted(-size, -step, side="left")
            here = start[:live] + step
            label[here] = now[:live]
            now[:live] = back[here, now[:live]]
        return label

    @classmethod
    def train(cls, features: list[np.ndarray], labels: list[np.ndarray], rounds: int = 100, rate: float = 0.2, decay: float = 2e-3) -> Field:
        """Gradient ascent on the mean log-likelihood of the sequences, with forward and backward sums over all at once."""
        kept = [k for k, x in enumerate(labels) if len(x)]
        width = features[0].shape[1] if features else 22
        self = cls(np.zeros(width), np.zeros((2, 2)))
        if not kept:
            self.weights[0] = 1.0
            return self
        longest = max(len(labels[k]) for k in kept)
        x = np.concatenate([features[k] for k in kept]).astype(float)
        y = np.zeros((len(kept), longest), np.int64)
        there = np.zeros((len(kept), longest), bool)
        for row, k in enumerate(kept):
            n = len(labels[k])
            y[row, :n], there[row, :n] = labels[k], True
        pair = there[:, 1:]
        seen_w = x.T @ (y[there] == CONTENT_LINE)
        seen_m = np.zeros((2, 2))
        np.add.at(seen_m, (y[:, :-1][pair], y[:, 1:][pair]), 1)
        total = there.sum()
        mean, square = np.zeros(width + 4), np.zeros(width + 4)
        for turn in range(1, rounds + 1):
            gain = np.zeros((len(kept), longest, 2))
            gain[there, CONTENT_LINE] = x @ self.weights
            forward, backward = gain.copy(), np.zeros_like(gain)
            for k in range(1, longest):
                forward[:, k] += np.logaddexp.reduce(forward[:, k - 1, :, None] + self.moves[None], axis=1)
            for k in range(longest - 2, -1, -1):
                onward = np.logaddexp.reduce(self.moves[None] + (gain[:, k + 1] + backward[:, k + 1])[:, None, :], axis=2)
                backward[:, k] = np.where(there[:, k + 1, None], onward, 0)
            chance = forward + backward
            norm = np.logaddexp.reduce(chance, axis=2)
            content = np.exp(chance[:, :, CONTENT_LINE] - norm)[there]
            both = forward[:, :-1, :, None] + self.moves[None, None] + (gain[:, 1:] + backward[:, 1:])[:, :, None, :]
            both = np.exp(both - np.logaddexp.reduce(both, axis=(2, 3), keepdims=True)) * pair[:, :, None, None]
            slope = np.concatenate([seen_w - x.T @ content, (seen_m - both.sum((0, 1))).ravel()]) / total
            slope -= decay * np.concatenate([self.weights, self.moves.ravel()])
            mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
            step = rate * (mean / (1 - 0.9**turn)) / (np.sqrt(square / (1 - 0.99**turn)) + 1e-8)
            self.weights += step[:width]
            self.moves += step[width:].reshape(2, 2)
        return self


def trained(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality") -> Field:
    """The field trained on the SAMPLE labelled documents that come first by a hash of their keys."""
    some = labels.select(labels[key].alias("key"), labels[label].alias("good")).dropna().orderBy(F.xxhash64("key"), "good").limit(SAMPLE)
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text")).dropna().join(some, "key")
    sample = rows.orderBy(F.xxhash64("key"), "key", "text").limit(SAMPLE).toArrow()
    texts, good = utf8(sample.column("text").combine_chunks()) if len(sample) else [], np.array(sample.column("good").to_pylist(), bool)
    features, labels_ = [], []
    if texts:
        found = lines(texts)
        plain = ~found.repeated & (found.n_words > 0)
        for k in range(len(texts)):
            own = slice(int(found.first[k]), int(min(found.first[k + 1], found.first[k] + SAMPLE_LINES)))
            features.append(found.features[own])
            labels_.append((plain[own] & good[k]).astype(np.int64))
    return Field.train(features, labels_)


SCORES = T.StructType(
    [
        *(T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        T.StructField("base_failed", T.BooleanType()),
        T.StructField("content_share", T.DoubleType()),
        T.StructField("kept", T.BooleanType()),
    ]
)


def measures(texts: list[bytes | None], field: Field) -> list[np.ndarray]:
    """The columns of SCORES for each text."""
    found = lines(texts)
    w = found.words
    n = np.diff(w.first)
    text_of = w.text_of

    def per_text(values, of, size):
        return np.bincount(of, values, minlength=size).astype(np.int64)

    leads = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80, dtype=np.int64)])
    chars = per_text(leads[w.end] - leads[w.begin], text_of, len(texts))
    three = windows(w.hash, 3)
    inside = np.flatnonzero(w.left()[: len(three)] >= 3)
    name = three[inside] ^ mixed(text_of[inside], 4)
    _, same, count = np.unique(name, return_inverse=True, return_counts=True)
    twice = np.zeros(len(w.begin) + 2, bool)
    at = inside[count[same] > 1]
    for k in range(3):
        twice[at + k] = True
    repeat = per_text(twice[: len(text_of)], text_of, len(texts))
    line_text = np.repeat(np.arange(len(texts)), np.diff(found.first))
    content = per_text(found.n_words * (field.decode(found) == CONTENT_LINE), line_text, len(texts))
    share = content / np.maximum(n, 1)
    failed = (n < LEAST_WORDS) | (100 * repeat > MOST_REPEATED * n)
    return [n, chars, found.symbols, per_text(found.repeated, line_text, len(texts)), repeat, failed, share, ~failed & (share >= CONTENT)]


def score(docs: DataFrame, field: Field, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The measures and the verdict of every text: no shuffle, each partition by itself."""
    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), *SCORES.fields])

    def run(batches):
        for table in blocks(batches, "text", BLOCK_BYTES):
            columns = measures(utf8(table.column("text").combine_chunks()), field)
            done = pa.Table.from_arrays([table.column("key"), *map(pa.array, columns)], names=schema.names)
            yield from done.combine_chunks().to_batches()

    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


def keep(docs: DataFrame, field: Field, *, text: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, whose texts are kept."""

    def run(batches):
        for table in blocks(batches, text, BLOCK_BYTES):
            kept = measures(utf8(table.column(text).combine_chunks()), field)[-1]
            yield from table.filter(pa.array(kept)).to_batches()

    return docs.mapInArrow(run, docs.schema)
