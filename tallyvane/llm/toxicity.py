"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

A text's terms are its lower-cased words and their beginnings of four and six bytes, so that stems count whatever follows
them. The vocabulary is every term that two texts or more of a bounded sample of labelled texts hold. A vector's weights are (1 + ln tf) *
idf * relevance, at length one: idf = ln((1 + N) / (1 + df)) counts the examples, relevance is 1 and grows with how far the label
changes a term's share of texts (RELEVANCE times what the absolute log ratio has over 1, for terms of SUPPORT examples or
more). With a relevance of 1 throughout, neighbours follow the subject of a text and say little of its tone (README has figures).

Examples lie in an inverted index cut into blocks of BLOCK examples, those with the same frequent terms side by side; each term keeps its
greatest weight in every block that has it. A query bounds each block by these, opens blocks by falling bound, and stops when no
closed block can reach the k-th nearest found: postings of closed blocks are never touched, and the k nearest are exact.

Votes are weighted by the square of the cosine and shrunk to the prior. A part of the sample, left out of the index, of idf and
of relevance, maps the log odds of votes to chances by logistic regression, each class weighted by how it was sampled. The nearest examples
are the evidence.

Defined cases: null texts, empty ones and those without a term of the vocabulary have no neighbours and no evidence; their score is the
chance of a vote at the prior. Rows without a key or label are never learned from; a document labelled twice is toxic if any label says so;
with no labels every score is 0; equal cosines (to 12 digits) go by the example's key; equal texts get equal rows; very long texts
are scored whole, a block of texts at a time; columns other than key and text are not read, so that none can clash; empty tables
give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyvane.llm.bpe import blocks
from tallyvane.llm.words import ALNUM, _hashes, hash_of, utf8, words

#: Labelled texts that are learned from at most: toxic ones and others.
TOXIC_EXAMPLES, OTHER_EXAMPLES = 600, 1000
#: One of so many sampled texts calibrates the votes and isn't in the index.
CALIBRATE = 4
#: Bytes of the beginnings that are terms.
STEMS = (4, 6)
#: Growth of a term's relevance, and examples that must hold a term whose relevance isn't 1.
RELEVANCE, SUPPORT = 2.0, 5
#: Neighbours that vote, examples of a block, and weight of the prior.
NEIGHBOURS, BLOCK, SHRINK = 15, 16, 0.02
#: Blocks that a query opens first, and how many times as many are open after each later step at most.
FIRST_BLOCKS, GROWTH = 16, 4
#: The most frequent terms, whose postings lie as rows of weights of all examples of each block.
ROW_TERMS = 256
#: Frequent terms whose presence orders the examples.
ORDER_TERMS = 24
#: Distinct vectors whose result a worker keeps.
CACHE = 20_000
#: Bits of the table that finds terms by their hashes.
TABLE_BITS = 21
BLOCK_BYTES = 4 << 20
EVIDENCE = T.ArrayType(T.StructType([T.StructField("example", T.LongType()), T.StructField("cosine", T.DoubleType()), T.StructField("toxic", T.IntegerType())]))


def terms(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of every occurrence of a term."""
    w = words(texts, ALNUM, lower=True)
    text_of = w.text_of
    owner, name = [text_of], [w.hash]
    for n in STEMS:
        some = np.flatnonzero(w.end - w.begin > n)
        owner.append(text_of[some])
        name.append(_hashes(w.data, w.begin[some], w.begin[some] + n))
    return np.concatenate(owner), np.concatenate(name)


def spans(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... (count[0] of them), begin[1], ..."""
    before = np.cumsum(count) - count
    return np.repeat(begin - before, count) + np.arange(int(count.sum()))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Intercept and slope (not negative) of the chance of y by x; a little is added to either class, so that both stay finite."""
    x, y = np.concatenate([x, [x.mean(), x.mean()]]), np.concatenate([y, [0.0, 1.0]])
    weight = np.concatenate([weight / weight.mean(), [0.5, 0.5]])
    a, b = 0.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        v = weight * np.maximum(p * (1 - p), 1e-9)
        gradient = np.array([(weight * (y - p)).sum(), (weight * (y - p) * x).sum() - 1e-3 * b])
        step = np.linalg.solve(np.array([[v.sum(), (v * x).sum()], [(v * x).sum(), (v * x * x).sum() + 1e-3]]), gradient)
        step *= min(1.0, 4 / np.abs(step).max()) if step.any() else 1.0
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-10:
            break
    return float(a), float(max(b, 0.0))


@dataclass
class Neighbours:
    """The vocabulary and the examples' block-max inverted index."""

    vocabulary: np.ndarray  # hashes of the terms, ascending
    value: np.ndarray  # idf * relevance of each
    keys: np.ndarray
    toxic: np.ndarray
    prior: float
    line: tuple[float, float] = (-np.inf, 0.0)

    def __post_init__(self):
        slot = (self.vocabulary >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        self.table = np.full(1 << TABLE_BITS, -1, np.int32)
        self.table[slot] = np.arange(len(slot))
        self.crowded = np.bincount(slot, minlength=1 << TABLE_BITS) > 1
        self.opened = 0  # postings looked at, but for rows

    def build(self, example: np.ndarray, term: np.ndarray, weight: np.ndarray) -> None:
        """Index the examples' vectors; postings lie by term, then by example, so by block."""
        by = np.lexsort((example, term))
        self.example, self.weight, term = example[by], weight[by], term[by]
        self.blocks = -(-max(1, len(self.keys)) // BLOCK)
        group = term * self.blocks + self.example // BLOCK
        self.begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
        self.count = np.diff(np.append(self.begin, len(group)))
        self.block = group[self.begin] % self.blocks
        self.most = np.maximum.reduceat(self.weight, self.begin) if len(group) else np.zeros(0)
        self.groups = np.searchsorted(group[self.begin] // self.blocks, np.arange(len(self.vocabulary) + 1))
        # The lists of the most frequent terms are rows; bounds of their blocks stay as those of all others.
        often = np.argsort(-np.bincount(term, minlength=len(self.vocabulary)), kind="stable")[:ROW_TERMS]
        self.column = np.full(len(self.vocabulary), -1)
        self.column[often] = np.arange(len(often))
        self.rows = np.zeros((len(often), self.blocks, BLOCK))
        at = self.column[term]
        some = at >= 0
        self.rows[at[some], self.example[some] // BLOCK, self.example[some] % BLOCK] = self.weight[some]
        self.count[some[self.begin]] = 0

    def vectors(self, owner: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, term and weight of the texts' unit vectors, by text, then by term."""
        if not len(self.vocabulary):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        slot = (name >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        at = self.table[slot]
        there = (at >= 0) & (self.vocabulary[at] == name)
        rest = np.flatnonzero(~there & self.crowded[slot])
        at[rest] = np.minimum(np.searchsorted(self.vocabulary, name[rest]), len(self.vocabulary) - 1)
        there[rest] = self.vocabulary[at[rest]] == name[rest]
        pair, tf = np.unique(owner[there] * len(self.vocabulary) + at[there], return_counts=True)
        text, term = np.divmod(pair, len(self.vocabulary))
        weight = (1 + np.log(tf)) * self.value[term]
        some = weight > 0
        text, term, weight = text[some], term[some], weight[some]
        norm = np.sqrt(np.bincount(text, weight**2))
        return text, term, weight / norm[text] if len(text) else weight

    def nearest(self, term: np.ndarray, weight: np.ndarray, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of greatest positive cosine, and their cosines; equal ones by key."""
        n = self.groups[term + 1] - self.groups[term]
        group, q = spans(self.groups[term], n), np.repeat(weight, n)
        block = self.block[group]
        bound = np.bincount(block, q * self.most[group], self.blocks) * (1 + 1e-9)
        order = np.argsort(-bound, kind="stable")
        falling = -bound[order]
        often = self.column[term] >= 0
        column, row = self.column[term[often]], weight[often]
        sparse = self.count[group] > 0
        group, block, q = group[sparse], block[sparse], q[sparse]
        found, cosine, done = np.zeros(0, np.int64), np.zeros(0), 0
        while True:
            least = cosine[-1] if len(cosine) == k else 0.0
            stop = int(np.searchsorted(falling, -least, side="right" if least else "left"))
            stop = min(stop, max(FIRST_BLOCKS, GROWTH * done))
            if stop <= done:
                break
            open_ = np.zeros(self.blocks, bool)
            open_[order[done:stop]] = True
            own = np.flatnonzero(open_[block])
            n = self.count[group[own]]
            posting = spans(self.begin[group[own]], n)
            self.opened += len(posting)
            score = np.bincount(self.example[posting], np.repeat(q[own], n) * self.weight[posting], self.blocks * BLOCK).astype(float).reshape(self.blocks, BLOCK)
            some = order[done:stop]
            if len(row):
                score[some] += (row @ self.rows[np.ix_(column, some)].reshape(len(row), -1)).reshape(-1, BLOCK)
            score = score.ravel()
            floor = max(cosine[-1] if len(cosine) == k else 0.0, np.partition(score, -k)[-k] if len(score) > k else 0.0)
            hit = np.flatnonzero((score > 0) & (score >= floor - 1e-12))
            found, cosine = np.concatenate([found, hit]), np.concatenate([cosine, np.round(score[hit], 12)])
            some = np.flatnonzero(cosine > 0)
            best = some[np.lexsort((self.keys[found[some]], -cosine[some]))[:k]]
            found, cosine, done = found[best], cosine[best], stop
        return found, cosine

    def vote(self, found: np.ndarray, cosine: np.ndarray) -> float:
        weight = cosine**2
        return float((weight @ self.toxic[found] + SHRINK * self.prior) / (weight.sum() + SHRINK))

    def chance(self, vote: float) -> float:
        """Chance by the log odds of a vote."""
        if not len(self.keys):
            return 0.0
        vote = min(max(vote, 1e-6), 1 - 1e-6)
        return float(1 / (1 + np.exp(-np.clip(self.line[0] + self.line[1] * np.log(vote / (1 - vote)), -700, 700))))

    def score(self, texts: list[bytes | None], cache: dict):
        """Chance and evidence of each text."""
        text, term, weight = self.vectors(*terms(texts))
        cut = np.searchsorted(text, np.arange(len(texts) + 1)).tolist()
        nothing = self.chance(self.vote(np.zeros(0, np.int64), np.zeros(0)))
        chances, evidence = np.full(len(texts), nothing), [[] for _ in texts]
        if len(cache) > CACHE:
            cache.clear()
        for k in np.unique(text).tolist():
            own = slice(cut[k], cut[k + 1])
            key = hash_of(np.concatenate([term[own].view(np.uint64), weight[own].view(np.uint64)]))
            if key not in cache:
                found, cosine = self.nearest(term[own], weight[own])
                told = [{"example": e, "cosine": c, "toxic": y} for e, c, y in zip(self.keys[found[:3]].tolist(), cosine[:3].tolist(), self.toxic[found[:3]].tolist(), strict=True)]
                cache[key] = self.chance(self.vote(found, cosine)), told
            chances[k], evidence[k] = cache[key]
        return chances, evidence


def counted(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of every occurrence of a term that may be in the vocabulary, some texts at a time."""
    out, first, size = [], 0, 0
    for k, t in enumerate([*texts, None]):
        size += len(t or b"")
        if k == len(texts) or size > BLOCK_BYTES:
            owner, name = terms(texts[first : k + 1])
            out.append((owner.astype(np.int32) + np.int32(first), name))
            first, size = k + 1, 0
    return np.concatenate([x for x, _ in out]).astype(np.int64), np.concatenate([x for _, x in out])


def learned(texts: list[bytes | None], keys: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> Neighbours:
    """From sampled texts; weight: how many texts of its class each stands for."""
    aside = np.arange(len(texts)) % CALIBRATE == CALIBRATE - 1
    examples, others = np.flatnonzero(~aside), np.flatnonzero(aside)
    owner, name = counted([texts[k] for k in examples])
    vocabulary, at = np.unique(name, return_inverse=True)
    pair = np.unique(owner * max(1, len(vocabulary)) + at)
    doc, at = np.divmod(pair, max(1, len(vocabulary)))
    y, n = toxic[examples], len(examples)
    df, in_toxic = np.bincount(at, minlength=len(vocabulary)), np.bincount(at, y[doc], minlength=len(vocabulary))
    n_toxic = int(y.sum())
    ratio = np.log((in_toxic + 0.5) / (n_toxic + 1)) - np.log((df - in_toxic + 0.5) / (n - n_toxic + 1))
    relevance = 1 + RELEVANCE * np.where(df >= SUPPORT, (np.abs(ratio) - 1).clip(0), 0)
    # Examples with the same frequent terms lie side by side, so that blocks differ in what they can reach.
    often = np.argsort(-df, kind="stable")[:ORDER_TERMS]
    place = np.full(len(vocabulary), -1)
    place[often] = np.arange(len(often))
    bits = np.zeros(n, np.int64)
    some = place[at] >= 0
    np.bitwise_or.at(bits, doc[some], np.int64(1) << (ORDER_TERMS - 1 - place[at[some]]))
    by = np.lexsort((keys[examples], bits, y))
    number = np.empty(n, np.int64)
    number[by] = np.arange(n)
    kept = df >= 2
    prior = float((weight * toxic).sum() / max(weight.sum(), 1e-9))
    self = Neighbours(vocabulary[kept], (np.log((1 + n) / (1 + df)) * relevance)[kept], keys[examples][by], y[by], prior)
    text, term, value = self.vectors(owner, name)
    self.build(number[text], term, value)
    if len(others):
        text, term, value = self.vectors(*counted([texts[k] for k in others]))
        cut = np.searchsorted(text, np.arange(len(others) + 1)).tolist()
        votes = np.array([self.vote(*self.nearest(term[a:b], value[a:b])) for a, b in zip(cut[:-1], cut[1:], strict=True)]).clip(1e-6, 1 - 1e-6)
        self.line = logistic(np.log(votes / (1 - votes)), toxic[others].astype(float), weight[others])
    return self


def held_out(key) -> F.Column:
    """Whether a row is left out of learning: crc32 of its key, as text, is 0 modulo 5."""
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False))


def trained(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Neighbours:
    """Learn from the labelled texts of each class that come first by a hash of their keys."""
    known = labels.select(labels[key].cast("long").alias("key"), labels[label].cast("int").alias("toxic")).dropna()
    known = known.filter(~held_out(F.col("key"))).groupBy("key").agg(F.max("toxic").alias("toxic"))
    sizes = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    rank = F.row_number().over(Window.partitionBy("toxic").orderBy(F.xxhash64("key"), "key"))
    most = F.when(F.col("toxic") == 1, TOXIC_EXAMPLES).otherwise(OTHER_EXAMPLES)
    # Ranks stop at a constant, so that each partition passes on no more than so many rows of a class.
    first = known.withColumn("rank", rank).filter(F.col("rank") <= max(TOXIC_EXAMPLES, OTHER_EXAMPLES))
    some = F.broadcast(first.filter(F.col("rank") <= most).drop("rank"))  # no more keys than there are examples
    rows = docs.select(docs[key].cast("long").alias("key"), docs[text].alias("text")).join(some, "key")
    sample = rows.orderBy(F.xxhash64("key"), "key", "text").limit(TOXIC_EXAMPLES + OTHER_EXAMPLES).toArrow()
    toxic = np.array(sample.column("toxic").to_pylist(), np.int64)
    if not len(toxic):
        return learned([], np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    weight = np.array([sizes.get(c, 1) for c in (0, 1)])[toxic] / np.maximum(np.bincount(toxic, minlength=2), 1)[toxic]
    return learned(utf8(sample.column("text").combine_chunks()), sample.column("key").to_numpy(), toxic, weight)


def score(docs: DataFrame, model: Neighbours, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score, predicted and evidence (the three nearest examples) of every text. The model, of bounded size, is
    broadcast; no shuffle: each partition by itself."""
    fields = [("key", docs.schema[key].dataType), ("score", T.DoubleType()), ("predicted", T.IntegerType()), ("evidence", EVIDENCE)]
    schema = T.StructType([T.StructField(*f) for f in fields])
    shared_model = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("example", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))

    def run(batches):
        cache: dict = {}
        for table in blocks(batches, "text", BLOCK_BYTES):
            chances, evidence = shared_model.value.score(utf8(table.column("text").combine_chunks()), cache)
            done = pa.Table.from_arrays([table.column("key"), pa.array(chances), pa.array((chances >= 0.5).astype(np.int32)), pa.array(evidence, kind)], names=schema.names)
            yield from done.combine_chunks().to_batches()

    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)
