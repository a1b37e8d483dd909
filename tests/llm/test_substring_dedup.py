import hashlib
import random
import re

import numpy as np
import pytest
from tallyvane.llm import substring_dedup

WORD = r"[^\x20\x09-\x0D]+"


def brute(rows):
    """For each row its words and whether each is removed."""
    split = [(re.findall(WORD, t or "")) for _, t in rows]
    place = lambda k, a: (rows[k][0] is not None, rows[k][0] or 0, a)
    first = {}
    for k, words in enumerate(split):
        for a in range(len(words) - 19):
            window = tuple(words[a : a + 20])
            first[window] = min(first.get(window, place(k, a)), place(k, a))
    out = []
    for k, words in enumerate(split):
        gone = [False] * len(words)
        for a in range(len(words) - 19):
            if first[tuple(words[a : a + 20])] < place(k, a):
                gone[a : a + 20] = [True] * 20
        out.append((words, gone))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed, monkeypatch):
    if seed == 2:
        monkeypatch.setattr(substring_dedup, "SHARD_BYTES", 5000)  # more shards than partitions
    rng = random.Random(seed)
    vocab = [f"w{k}é" for k in range(400)] + ["a", "b"]
    say = lambda n: rng.choices(vocab, k=n)
    passages = [say(n) for n in (19, 20, 21, 25, 70, 120)] + [["a"] * 45, ["a", "b"] * 30, (say(3) * 20)]
    rows = [(1, None), (2, ""), (3, " \n"), (None, " ".join(passages[4])), (None, None)]
    for k in range(60):
        words = [w for _ in range(rng.randint(1, 5)) for w in rng.choice([say(rng.randint(0, 60)), rng.choice(passages)])]
        text = "".join(w + rng.choice([" ", "\n", "  ", "\t"]) for w in words)
        rows.append((100 - k, text))
        if k % 5 == 0:
            rows += [(200 + k, text)] * 2 + [(200 + k, " ".join(words[3:]))]
    rows.append((300, " ".join(say(30_000) + passages[5])))
    docs = spark.createDataFrame([(d, t, "x", [1]) for d, t in rows], "doc_id long, text string, digest string, gone array<int>").repartition(5)
    expected = sorted((repr(d), len(w), sum(g), hashlib.sha256(" ".join(x for x, y in zip(w, g) if not y).encode()).hexdigest()) for (d, _), (w, g) in zip(rows, brute(rows)))
    got = sorted((repr(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.digests(docs).collect())
    assert got == expected
    cleaned = substring_dedup.remove(docs)
    assert cleaned.columns == docs.columns
    left = sorted((repr(r.doc_id), hashlib.sha256(" ".join(re.findall(WORD, r.text or "")).encode()).hexdigest()) for r in cleaned.collect())
    assert left == sorted((d, h) for d, _, _, h in expected)


@pytest.mark.parametrize("turn", range(40))
def test_last_row_of_the_suffix_order(turn):
    """Two segments that share one window of 20 words; whichever of its shingles is the shard's greatest symbol, only the
    later window is removed."""
    rng = random.Random(turn)
    say = lambda n: [f"v{rng.randrange(10**9)}" for _ in range(n)]
    passage = say(20)
    texts = [say(3) + passage + say(2), say(1) + passage + say(4)]
    bodies = [" ".join(t).encode() for t in texts]
    for first in ([0, 1 << 32], [1 << 32, 0]):
        later = int(first[1] > first[0])
        at = 3 if later == 0 else 1
        found = substring_dedup.partly(bodies, np.array(first))
        assert [x.tolist() for x in found] == [[later], [at], [at + 20]]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup.digests(docs).collect() == []
