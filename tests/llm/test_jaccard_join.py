import random
import re

import numpy as np
import pytest
from tallyvane.llm import jaccard_join
from tallyvane.llm.components import components


def brute(rows):
    """n_shingles and component_id of every row."""
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set()))
    top = list(range(len(rows)))

    def find(k):
        while top[k] != k:
            k = top[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                top[find(a)] = find(b)
    least = {}
    for k, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(k)] = min(least.get(find(k), doc), doc)
    return sorted(((repr(d), len(sets[k]), repr(least.get(find(k)))) for k, (d, _) in enumerate(rows)))


@pytest.mark.parametrize("seed", range(2))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    vocab = [f"w{k}é" for k in range(500)]
    say = lambda n: rng.choices(vocab, k=n)
    passage = say(60)
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A\tb"), (None, "a b"), (None, None), (6, "a b c"), (9, "a a a a a a a a a a")]
    doc = 10
    for group in range(14):
        base = say(rng.choice([5, 6, 7, 9, 12, 30, 90, 110, 130, 380, 420, 600]))
        if group % 3 == 0:
            base = base[: len(base) // 2] + passage + base[len(base) // 2 :]
        for _ in range(rng.choice([1, 2, 4, 20, 30])):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 55))):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            if rng.random() < 0.3:
                words = words + say(max(1, len(words) // 9))
            if rng.random() < 0.3:
                base = words  # chains
            rows.append((doc, rng.choice([" ", "\n"]).join(words)))
            doc += rng.choice([1, 1, 0])
    rng.shuffle(rows)
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, node int, n int").repartition(5)
    got = sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id)) for r in jaccard_join.join(docs).collect())
    assert got == brute(rows)


def test_groups_leave_a_prefix():
    """Sets of a class of sizes get their prefix from the groups alone, up to chance."""
    rng = np.random.default_rng(3)
    for low, high, share in jaccard_join.TIERS:
        for n in range(low, min(high, 3000), 7):
            step = int(np.searchsorted(jaccard_join.STEPS, n, side="right")) - 1
            c = rng.binomial(n, share)
            count = np.bincount(rng.integers(0, jaccard_join.groups_of(share, step), c))
            if (count - 1).clip(0).sum() < jaccard_join.prefix(n):
                assert abs(c - share * n) > 2 * (share * (1 - share) * n) ** 0.5, n


def test_similar_sizes_are_of_neighbouring_classes():
    for n in range(1, 5000):
        a, b = np.searchsorted(jaccard_join.STEPS, [n, n * 5 // 4], side="right")
        assert b - a <= 1


def test_components(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(40)] + [(100 + rng.randint(0, 30), 100 + rng.randint(0, 30)) for _ in range(25)] + [(7, 7), (500, 500)]
    top = {}
    find = lambda k: k if top.setdefault(k, k) == k else find(top[k])
    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            top[b] = a
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: find(k) for k in top}


def test_sets_short_of_a_prefix(spark, monkeypatch):
    """With parts of the range that hold less than a prefix, tiers look at the whole of it."""
    monkeypatch.setattr(jaccard_join, "TIERS", ((4, 125, 0.1), (100, 500, 0.02), (400, 1 << 60, 0.02)))
    rng = random.Random(5)
    rows = []
    for n in (40, 150, 480):
        base = [f"w{rng.random()}" for _ in range(n)]
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join([*base[:-2], "x", "y"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id)) for r in jaccard_join.join(docs).collect()) == brute(rows)


@pytest.mark.parametrize("changes", [4, 9])
def test_groups_of_changed_copies(spark, changes):
    """Copies of a text, too different to be all similar to it; long texts; rows that repeat; the query's columns."""
    rng = random.Random(changes)
    base = [f"w{k}" for k in range(160)]
    rows = [(0, " ".join(base)), (0, " ".join(base))]
    for k in range(300):
        words = list(base)
        for _ in range(rng.randint(1, changes)):
            words[rng.randrange(160)] = rng.choice("abcdefgh")
        rows.append((k + 1, " ".join(words[: rng.choice([160, 160, 130])])))
    long_ = [str(rng.randrange(5000)) for _ in range(30_000)]
    rows += [(900, " ".join(long_)), (901, " ".join([*long_[:29_000], *map(str, range(100))]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id)) for r in jaccard_join.join(docs).collect()) == brute(rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.join(docs).collect() == []


def shuffled(spark, first=0):
    """Bytes shuffled by the stages from `first` on, and the number after the last one."""
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark._jvm
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    own = [(s.stageId(), s.shuffleWriteBytes()) for s in (stages.apply(k) for k in range(stages.size())) if s.stageId() >= first]
    return sum(x for _, x in own), max((k for k, _ in own), default=first - 1) + 1


def test_sets_that_are_ruled_out_are_not_shuffled(spark):
    """Texts that share a passage with one other and aren't similar to it: no table is small enough to be broadcast, as with large inputs,
    and yet few sets meet whole."""
    rng = random.Random(7)
    rows = []
    for k in range(300):
        passage = [f"p{k}-{j}" for j in range(200)]
        for side in range(2):
            rows.append((2 * k + side, " ".join([*passage, *(f"{side}-{rng.random()}" for _ in range(400 if k else 4))])))
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2), "doc_id long, text string")
    before, threshold = shuffled(spark)[1], spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(docs).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert found == {d: (200 if d < 2 else 596, 0 if d < 2 else d) for d, _ in rows}
    whole = 8 * sum(n for n, _ in found.values())
    assert shuffled(spark, before)[0] < 0.8 * whole


def test_numbers_packed():
    for width in (1, 4, 5, 8):
        numbers = np.random.default_rng(width).integers(0, 2 ** (8 * width) - 1, 1000, np.uint64, endpoint=True)
        blob = b"ab" + jaccard_join.packed(numbers, width) + b"c"
        assert len(blob) == 3 + 1000 * width
        assert (jaccard_join.unpacked(blob, 2, 1000, width) == numbers).all()


def test_quarters_rule_out_no_similar_sets(spark):
    """Also where tokens of a set are equal in the bits that are sent; sets that have too little in common are left out."""
    rows = [(1, [5], 40, 40), (2, [5], 40, 40), (3, [5, 6], 40, 40), (0, [7, 8, *range(100, 138)], 40, 40)]
    tokens = spark.createDataFrame(rows, "node long, part array<int>, q int, n int")
    pairs = spark.createDataFrame([(1, 2), (2, 3), (0, 1), (0, 3)], "a long, b long")
    assert sorted(map(tuple, jaccard_join.possible(tokens, pairs).collect())) == [(1, 2), (2, 3)]


def test_no_needed_node_is_left_out(spark):
    rows = spark.range(-3000, 3000).withColumnRenamed("id", "node")
    keys = rows.filter("node % 10 = 0")
    kept = {r.node for r in jaccard_join.passing(rows, keys).collect()}
    assert kept >= set(range(-3000, 3000, 10))
    assert len(kept) < 1200
