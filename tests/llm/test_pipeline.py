import random
import re

import numpy as np
import pytest
from test_decontaminate import WORD, brute as brute_hits, lowered
from test_jaccard_join import brute as brute_groups
from test_line_crf import base
from test_substring_dedup import brute as brute_repeats

import corpus_pipeline

SPACED = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(6)
    vocab = [f"w{k}é" for k in range(3000)]
    say = lambda n: rng.choices(vocab, k=n)
    bench = [(k, " ".join(say(30))) for k in range(5)] + [(None, None)]
    shared = say(70)
    rows, labels = [], []
    for k in range(70):
        words = say(rng.randint(20, 120))
        if k % 4 == 0:
            words = words[:40] + shared + words[40:]
        if k % 5 == 0:
            words = words[:30] + bench[k % 3][1].split() + words[30:]
        text = "".join(w + rng.choice([" ", " ", ".\n"]) for w in words)
        if k % 9 == 0:
            text = "\n".join(w + "###$$$" for w in words)
        rows.append((k, text))
        if k % 6 == 0:
            rows.append((k + 500, text.replace(words[3], "other", 1)))
        labels.append((k, 0 if k % 9 == 0 else 1, 0))
    rows += [(1000, None), (1001, ""), (rows[2][0], rows[2][1]), (None, rows[4][1])]
    top = tmp_path_factory.mktemp("sf")
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(4).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return str(top), bench


def rows_of(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_stages_against_brute_force(spark, folder):
    top, bench = folder
    docs = spark.read.parquet(f"{top}/documents.parquet")
    now, columns = rows_of(docs), docs.columns
    out = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, top)
        assert docs.columns == columns
        docs.write.parquet(f"{top}/{name.replace(' ', '-')}")
        docs = spark.read.parquet(f"{top}/{name.replace(' ', '-')}")
        out[name] = rows_of(docs)
        assert all(r.n_chars == len(r.text) for r in docs.collect())

    kept = out["quality rules"]
    assert set(kept) <= {r for r in now if not base(r[1])[-1]}
    assert sum("###" in (t or "") for _, t in kept) <= 1 and len(kept) > 40

    once = sorted(set(kept), key=repr)
    groups = {}
    for (doc, text), (_, _, comp) in zip(once, [next(x for x in brute_groups(once) if x[0] == repr(d)) for d, _ in once]):
        groups.setdefault(comp, []).append((doc is not None, doc or 0, text))
    assert out["n-gram Jaccard join"] == sorted(((d if known else None, t) for known, d, t in map(min, groups.values())), key=repr)

    split = lambda rows: sorted(((d, re.findall(SPACED, t)) for d, t in rows), key=repr)
    given = out["n-gram Jaccard join"]
    left = sorted(((d, [w for w, g in zip(words, gone) if not g]) for (d, _), (words, gone) in zip(given, brute_repeats(given))), key=repr)
    assert split(out["substring dedup"]) == left

    given = out["substring dedup"]
    expected = []
    for d, t in given:
        _, hit, _ = brute_hits(t, bench)
        expected.append((d, [w for w, h in zip(re.findall(WORD, lowered(t)), hit) if not h]))
    got = sorted(((d, re.findall(WORD, lowered(t))) for d, t in out["benchmark decontamination"]), key=repr)
    assert got == sorted(expected, key=repr)

    last = corpus_pipeline.run(spark, top).collect()
    assert sorted(((r.doc_id, bytes(r.decoded).decode()) for r in last), key=repr) == out["benchmark decontamination"]
    assert all(r.n_tokens == len(np.frombuffer(r.ids, "<u4")) for r in last)


@pytest.mark.parametrize("empty", [False, True])
def test_clashing_names_and_empty_tables(spark, folder, tmp_path, empty):
    """Columns named as the stages' own, and a table without rows."""
    top, _ = folder
    names = ["own", "row", "first", "first_digest", "gone", "digest", "spans", "node"]
    docs = spark.read.parquet(f"{top}/documents.parquet").filter("doc_id < 20")
    for name in names:
        docs = docs.withColumn(name, docs.doc_id)
    docs = docs.limit(0) if empty else docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        columns = docs.columns
        out = stage(spark, docs, top)
        assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    rows = docs.collect()
    assert bool(rows) is not empty
    assert all(r[name] == r.doc_id for r in rows for name in names)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, top).count() == len(rows)
