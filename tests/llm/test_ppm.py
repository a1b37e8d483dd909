"""Prediction by partial matching against a slow trie of dictionaries."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from tallyvane.llm import ppm, queries

SF = "/root/testdata/sf0.001"
ORDER = ppm.ORDER


def lower(text):
    return bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())


def trained(texts, order):
    trie = defaultdict(Counter)
    for t in texts:
        data = b"\xff" * order + lower(t) + b"\xff"
        for i in range(order, len(data)):
            for k in range(order + 1):
                trie[data[i - k : i]][data[i]] += 1
    return trie


def log_probability(trie, text, order):
    data, out = b"\xff" * order + lower(text) + b"\xff", 0.0
    for i in range(order, len(data)):
        gone = set()
        for k in range(order, -1, -1):
            node = {b: n for b, n in trie.get(data[i - k : i], {}).items() if b not in gone}
            if not node:
                continue
            whole = 2 * sum(node.values())
            if data[i] in node:
                out += math.log10((2 * node[data[i]] - 1) / whole)
                break
            out += math.log10(len(node) / whole)
            gone |= set(node)
        else:
            out -= math.log10(256 - len(gone))
    return out


def expected(rows, order):
    """rows: (key, learns, text)"""
    learn = [t for _, ok, t in rows if ok]
    trie, counts = trained(learn, order), Counter()
    for t in learn:
        counts.update(words(t))
    total = sum(counts.values())
    out = []
    for key, ok, t in rows:
        tokens = words(t)
        base = sum(math.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in tokens)
        out.append((key, ok, len(tokens), sum(counts[w] > 0 for w in tokens), total, round(base, 6), round(log_probability(trie, t, order), 6)))
    return out


def words(text):
    return [*re.findall(rb"[^\x20\x09-\x0D]+", lower(text)), None]


def got(rows, order, spark):
    docs = spark.createDataFrame([(k, t, t, 5) for k, _, t in rows], "doc_id int, text string, key string, block int")
    good = [k for k, ok, _ in rows if ok]
    found = ppm.scored(docs, F.col("doc_id").isin(good), order=order).collect()
    return sorted((r.doc_id, r.learns, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in found)


@pytest.mark.parametrize("order", [0, 1, 3, 5])
def test_small_texts(spark, order):
    rows = [(1, True, "Abra cadabra"), (2, True, None), (3, False, ""), (4, True, "abra\tABRA  é"), (4, True, "abra\tABRA  é"), (5, False, "zebra 日本"), (6, False, None), (7, True, "x" * 3000)]
    assert got(rows, order, spark) == sorted(expected(rows, order))


def test_nothing_to_learn_from_and_no_rows(spark):
    rows = [(1, False, "ab c"), (2, False, None)]
    assert got(rows, 2, spark) == sorted(expected(rows, 2))
    assert got([], 2, spark) == []


def test_pieces_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(ppm, "PIECE_BYTES", 40)
    monkeypatch.setattr(ppm, "BLOCK_BYTES", 100)
    rows = [(k, k % 3 > 0, f"one {k} two {k * k} " * (k % 5)) for k in range(60)]
    assert got(rows, 3, spark) == sorted(expected(rows, 3))


def test_query_against_brute_force(spark):
    rows = [(r.doc_id, zlib.crc32(str(r.doc_id).encode()) % 7 != 2, r.text) for r in queries.documents(spark, SF).collect()]
    want = sorted(expected(rows, ORDER))
    found = queries.op12_text_likelihood(spark, SF).collect()
    have = sorted((r.doc_id, not r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in found)
    assert have == want
