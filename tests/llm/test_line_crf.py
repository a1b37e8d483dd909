import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from tallyvane.llm import line_crf
from tallyvane.llm.words import SEGMENT

rng = random.Random(11)


def text(n_lines):
    vocab = ["the", "été", "a###", "x|y", "Of.", "12"]
    rows = [" ".join(rng.choices(vocab, k=rng.randint(0, 12))) for _ in range(n_lines)]
    return "\n".join(rng.choice(rows) if rng.random() < 0.3 else r for r in rows)


TEXTS = [None, "", "\n\n", "a b a b a b", " x\n x\nx", "same line here\n" * 30] + [text(rng.randint(1, 25)) for _ in range(60)]


def base(t):
    t = t or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    three = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    count = Counter(three)
    covered = {k + j for k, w in enumerate(three) if count[w] > 1 for j in range(3)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered), failed


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in enumerate(TEXTS)], "doc_id long, text string, kept int, n_words string").repartition(3)
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(0, len(TEXTS), 2)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_base_rules_against_brute_force(tables):
    docs, labels = tables
    field = line_crf.trained(docs, labels)
    rows = {r.doc_id: r for r in line_crf.score(docs, field).collect()}
    for k, t in enumerate(TEXTS):
        r = rows[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(t)
        assert r.kept == (not r.base_failed and r.content_share >= line_crf.CONTENT)
    kept = line_crf.keep(docs, field)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {k for k, r in rows.items() if r.kept}


def test_viterbi_against_all_label_sequences():
    gen = np.random.default_rng(2)
    texts = [("\n".join(rng.choice(["a b c.", "##", "", "A B", "x"]) for _ in range(rng.randint(1, 7)))).encode() for _ in range(30)] + [None, b""]
    found = line_crf.lines(texts)
    field = line_crf.Field(gen.normal(size=found.features.shape[1]), gen.normal(size=(2, 2)))
    label = field.decode(found)
    for k in range(len(texts)):
        own = slice(found.first[k], found.first[k + 1])
        gain = found.features[own] @ field.weights

        def value(seq, gain=gain):
            return sum(g for g, s in zip(gain, seq) if s) + sum(field.moves[a, b] for a, b in itertools.pairwise(seq))

        best = max(value(s) for s in itertools.product((0, 1), repeat=len(gain)))
        assert value(label[own].tolist()) == pytest.approx(best)


def test_training_raises_the_likelihood_and_separates():
    gen = np.random.default_rng(4)
    features, labels = [], []
    for _ in range(80):
        y = (np.cumsum(gen.random(12) < 0.2) % 2).astype(int)
        x = np.stack([np.ones(12, bool), (gen.random(12) < 0.9) == (y == 1)], 1)
        features.append(x)
        labels.append(y)
    field = line_crf.Field.train(features, labels)
    assert field.weights[1] > 1
    assert field.moves[0, 0] + field.moves[1, 1] > field.moves[0, 1] + field.moves[1, 0] + 1


def test_empty_tables(tables):
    docs, labels = tables
    field = line_crf.trained(docs.limit(0), labels.limit(0))
    assert line_crf.score(docs.limit(0), field).collect() == []
    assert all(r.kept == (not r.base_failed) for r in line_crf.score(docs, field).collect())


@pytest.mark.parametrize("last", [b"", b"\nabc", None])
def test_empty_line_at_the_border_of_a_segment(last):
    texts = [b"a" * (SEGMENT - 1) + b"\n\nabc\nabc", last, b"x"]
    found = line_crf.lines(texts)
    rows = [line for t in texts for line in (t or b"").split(b"\n")]
    assert found.n_words.tolist() == [len(r.split()) for r in rows]
    assert found.repeated.tolist()[:4] == [False, False, False, True]
    again = line_crf.lines([b"a" * (SEGMENT - 1), *([None, b""] * 3), b"abc\nabc"])
    assert again.repeated.tolist() == [False] * 8 + [True]


def test_verdicts_on_documents_held_out(spark):
    """Documents that the field hasn't seen: good ones that the base rules pass are kept, bad ones aren't."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").dropna(subset=["quality"])
    seen = labels.filter("doc_id % 3 <> 0")
    field = line_crf.trained(docs, seen)
    rows = line_crf.score(docs.join(labels.filter("doc_id % 3 = 0"), "doc_id").select("doc_id", "text"), field).join(labels, "doc_id").collect()
    good, bad = ([r for r in rows if r.quality == q] for q in (1, 0))
    assert len(good) > 500
    assert np.mean([r.kept for r in good if not r.base_failed]) > 0.97
    assert np.mean([r.kept for r in good]) > 0.93
    assert np.mean([r.kept for r in bad]) < 0.05
