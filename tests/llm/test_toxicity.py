import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tallyvane.llm import queries, toxicity

rng = random.Random(9)
GOOD = [f"word{k}" for k in range(60)]
BAD = ["zqidiot", "zqfool", "vexla"]


def text(toxic):
    words = rng.choices(GOOD, k=rng.randint(5, 60))
    for _ in range(rng.randint(1, 4) if toxic else 0):
        words.insert(rng.randrange(len(words)), rng.choice(BAD) + rng.choice(["", "s", "ería"]))
    return " ".join(words).title()


def sample(n):
    toxic = np.array([k % 3 == 0 for k in range(n)]).astype(np.int64)
    return [text(t).encode() for t in toxic], np.arange(n) * 10, toxic, np.where(toxic == 1, 1.0, 5.0)


def bag(text):
    """Terms of a text and how often each occurs."""
    found = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text or b""))
    return Counter(x for w in found for x in (w, *(w[:n] for n in toxicity.STEMS if len(w) > n)))


def brute(texts, keys, toxic, weight, queries):
    """(score, [(example, cosine, toxic)]) of each query, by all cosines."""
    aside = [k % toxicity.CALIBRATE == toxicity.CALIBRATE - 1 for k in range(len(texts))]
    inside = [k for k, x in enumerate(aside) if not x]
    bags = [bag(texts[k]) for k in inside]
    df = Counter(t for b in bags for t in b)
    df_toxic = Counter(t for b, k in zip(bags, inside) if toxic[k] for t in b)
    n, n_toxic = len(inside), sum(int(toxic[k]) for k in inside)

    def value(t):
        ratio = math.log((df_toxic[t] + 0.5) / (n_toxic + 1)) - math.log((df[t] - df_toxic[t] + 0.5) / (n - n_toxic + 1))
        return math.log((1 + n) / (1 + df[t])) * (1 + toxicity.RELEVANCE * (max(0, abs(ratio) - 1) if df[t] >= toxicity.SUPPORT else 0))

    def vector(b):
        v = {t: (1 + math.log(c)) * value(t) for t, c in b.items() if df[t] >= 2 and value(t) > 0}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    examples = [vector(b) for b in bags]
    prior = float((weight * toxic).sum() / weight.sum())

    def nearest(v):
        all_ = [(round(sum(x * e.get(t, 0) for t, x in v.items()), 12), int(keys[k]), int(toxic[k])) for e, k in zip(examples, inside)]
        return sorted(((c, key, y) for c, key, y in all_ if c > 0), key=lambda r: (-r[0], r[1]))[: toxicity.NEIGHBOURS]

    def odds(v):
        top = nearest(v)
        vote = (sum(c * c * y for c, _, y in top) + toxicity.SHRINK * prior) / (sum(c * c for c, _, _ in top) + toxicity.SHRINK)
        vote = min(max(vote, 1e-6), 1 - 1e-6)
        return math.log(vote / (1 - vote)), top

    rest = [k for k, x in enumerate(aside) if x]
    a, b = toxicity.logistic(np.array([odds(vector(bag(texts[k])))[0] for k in rest]), toxic[rest].astype(float), weight[rest])
    out = []
    for q in queries:
        x, top = odds(vector(bag(q)))
        out.append((1 / (1 + math.exp(-(a + b * x))), [(key, c, y) for c, key, y in top[:3]]))
    return out


def test_nearest_against_all_cosines():
    texts, keys, toxic, weight = sample(600)
    model = toxicity.learned(texts, keys, toxic, weight)
    n = len(model.keys)
    dense = np.zeros((n, len(model.vocabulary)))
    t, term, value = model.vectors(*toxicity.terms([texts[int(k) // 10] for k in model.keys]))
    dense[t, term] = value
    for query in [text(k % 2) for k in range(150)]:
        _, term, value = model.vectors(*toxicity.terms([query.encode()]))
        exact = dense[:, term] @ value
        found, cosine = model.nearest(term, value)
        top = np.sort(exact[exact > 0])[::-1][: toxicity.NEIGHBOURS]
        assert np.allclose(cosine, top, atol=1e-11)
        assert np.allclose(exact[found], cosine, atol=1e-11)


def test_closed_blocks_are_not_touched(monkeypatch):
    """Postings of blocks that share only a few words with the query stay closed once enough near examples are found."""
    monkeypatch.setattr(toxicity, "ROW_TERMS", 1)
    monkeypatch.setattr(toxicity, "FIRST_BLOCKS", 2)
    base = [f"a{k}xy" for k in range(30)]
    texts = [" ".join(base if k % 10 == 0 else [*rng.sample(base, 1), *rng.choices([f"b{k}xy" for k in range(80)], k=29)]).encode() for k in range(1200)]
    model = toxicity.learned(texts, np.arange(1200), np.arange(1200) % 7 // 6, np.ones(1200))
    _, term, value = model.vectors(*toxicity.terms([texts[0]]))
    group = toxicity.spans(model.groups[term], model.groups[term + 1] - model.groups[term])
    model.opened = 0
    model.nearest(term, value)
    assert 0 < model.opened < model.count[group].sum() * 0.9


def test_score_against_brute_force():
    texts, keys, toxic, weight = sample(300)
    texts += [None, b"", b"zzz", texts[3], b"word1 word2 " * 40000]
    keys, toxic, weight = np.append(keys, [7, 8, 9, 5, 6]), np.append(toxic, [0, 0, 1, 1, 0]), np.append(weight, [1.0] * 5)
    queries = [*texts[:60], None, b"", b"unknown", b"|||", *texts[-3:]]
    chances, evidence = toxicity.learned(texts, keys, toxic, weight).score(queries, {})
    for (chance, top), got, told in zip(brute(texts, keys, toxic, weight, queries), chances, evidence, strict=True):
        assert got == pytest.approx(chance, abs=1e-9)
        assert [(e["example"], e["toxic"]) for e in told] == [(k, y) for k, _, y in top]
        assert [e["cosine"] for e in told] == pytest.approx([c for _, c, _ in top], abs=1e-9)


def test_query_against_brute_force(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).dropna()
    known = docs.join(labels, "doc_id").filter("crc32(cast(doc_id as string)) % 5 <> 0").orderBy(F.xxhash64("doc_id"), "doc_id").select("doc_id", "text", "toxic").collect()
    every = docs.select("doc_id", "text").orderBy("doc_id").collect()
    texts, keys = [r.text.encode() for r in known], np.array([r.doc_id for r in known])
    toxic, weight = np.array([r.toxic for r in known], np.int64), np.ones(len(known))
    got = {r.doc_id: r for r in queries.op2_toxicity(spark, sf_dir).collect()}
    assert len(got) == len(every)
    for row, (chance, top) in zip(every, brute(texts, keys, toxic, weight, [(r.text or "").encode() for r in every])):
        found = got[row.doc_id]
        assert found.score == pytest.approx(chance, abs=1e-9)
        assert found.predicted == int(found.score >= 0.5)
        assert found.held_out == (zlib.crc32(str(row.doc_id).encode()) % 5 == 0)
        assert [e.example for e in found.evidence] == [k for k, _, _ in top]


def test_logistic_is_the_likeliest_line():
    x = np.array([-2.0, -1, 0, 1, 2, 3, 4, 5])
    y = np.array([0.0, 0, 1, 0, 1, 0, 1, 1])
    a, b = toxicity.logistic(x, y, np.ones(8))
    p = 1 / (1 + np.exp(-(a + b * np.append(x, [x.mean()] * 2))))
    left = np.append(y, [0.0, 1.0]) - p
    left[-2:] *= 0.5
    assert abs(left.sum()) < 1e-6
    assert b > 0
    assert toxicity.logistic(x, 1 - y, np.ones(8))[1] == 0


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.trained(docs, labels)
    rows = toxicity.score(docs, model).join(labels, "doc_id").select("doc_id", "score", "predicted", "toxic", "evidence")
    return rows.collect()


def test_held_out_accuracy_and_calibration(found):
    held = [r for r in found if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([r.predicted == r.toxic for r in held]) > 0.97
    toxic = [r for r in held if r.toxic]
    assert np.mean([r.predicted for r in toxic]) > 0.85
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    assert abs(np.mean([r.score for r in held]) - np.mean([r.toxic for r in held])) < 0.03
    assert len({round(r.score, 9) for r in found}) > 1000
    assert all(r.evidence for r in found)
    examples = Counter(e.example for r in found for e in r.evidence)
    assert examples and not any(zlib.crc32(str(e).encode()) % 5 == 0 for e in examples)


def test_odd_rows_and_no_labels(spark):
    docs = spark.createDataFrame([(1, None, 3), (2, "", 3), (None, "x", 1), (4, "idiot " * 2000, 0), (4, "idiot " * 2000, 0)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(None, 1, 1), (1, None, None), (2, 0, 1), (4, 0, 0), (4, 0, 1)], "doc_id long, quality int, toxic int")
    for table in (labels, labels.limit(0)):
        rows = toxicity.score(docs, toxicity.trained(docs, table)).collect()
        assert len(rows) == 5
        assert all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(docs.limit(0), toxicity.trained(docs, labels)).collect() == []
