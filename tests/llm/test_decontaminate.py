import random
import re

import pytest
from tallyvane.llm import decontaminate

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(text, items):
    """Number of words, spans of hit words, names of items."""
    words = re.findall(WORD, lowered(text))
    hit, names = [False] * len(words), set()
    for name, item in items:
        own = re.findall(WORD, lowered(item))
        size = min(10, len(own))
        for a in range(len(own) - size + 1 if own else 0):
            for b in range(len(words) - size + 1):
                if words[b : b + size] == own[a : a + size]:
                    hit[b : b + size] = [True] * size
                    names.add("" if name is None else str(name))
    return len(words), hit, sorted(names)


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(5)
    vocab = ["the", "of", "Ét", "x9", "a", "on"]
    say = lambda n: " ".join(rng.choices(vocab, k=n))
    items = [(k, say(rng.choice([0, 3, 4, 9, 10, 11, 30]))) for k in range(8)] + [(77, None), (None, "zz yy xx"), (5, say(12)), (10, "tail of it")]
    texts = [None, "", "...", "a", "zz yy xx", "ZZ,yy\nXX zz yy xx", "tail of", "it tail of it"]
    for _ in range(40):
        parts = [rng.choice([say(rng.randint(0, 40)), rng.choice(items)[1] or "", "new words here"]) for _ in range(rng.randint(1, 5))]
        texts.append(rng.choice([" ", "\n", ", "]).join(parts))
    return items, texts + texts[:5]


def test_against_brute_force(spark, cases):
    items, texts = cases
    docs = spark.createDataFrame([(k, t, "spans", k) for k, t in enumerate(texts)], "doc_id long, text string, items string, key long").repartition(3)
    paths = decontaminate.prepare(spark.createDataFrame(items, "item_id long, text string").repartition(2))
    got = {r.doc_id: r for r in decontaminate.search(docs, paths).collect()}
    for k, text in enumerate(texts):
        n, hit, names = brute(text, items)
        mine = [False] * n
        for span in got[k].spans:
            mine[span.begin : span.end] = [True] * (span.end - span.begin)
        assert (got[k].n_words, mine, got[k]["items"]) == (n, hit, names)
    cleaned = decontaminate.remove(docs, paths).collect()
    assert len(cleaned) == len(texts)
    for row in cleaned:
        _, hit, _ = brute(texts[row.doc_id], items)
        left = [w for w, h in zip(re.findall(WORD, lowered(texts[row.doc_id])), hit) if not h]
        assert re.findall(WORD, lowered(row.text)) == left
        assert any(hit) or row.text == texts[row.doc_id]


def test_no_items_and_no_texts(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    paths = decontaminate.prepare(spark.createDataFrame([], "item_id long, text string"))
    row = decontaminate.search(docs, paths).collect()[0]
    assert (row.n_words, row.spans, row["items"]) == (3, [], [])
    assert decontaminate.search(docs.limit(0), paths).collect() == []
