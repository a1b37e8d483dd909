"""The conversation trie against a dictionary of prefixes."""

import hashlib
import random
import re
import zlib

import pytest
from tallyvane.llm import prefix_trie, queries

SF = "/root/testdata/sf0.001"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def expected(rows):
    """rows: (conv_id, turn, role, text)"""
    original = {}
    for c, turn, role, text in rows:
        if c is not None:
            original.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    for turns in original.values():
        turns.sort()
    built = {}
    for c, turns in original.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(t[2:] for t in original.get(c - c % 20, [])[:h] + turns[h:])
    members, children, ending = {}, {}, {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
            if d:
                children.setdefault(turns[: d - 1], set()).add(turns[:d])
        ending.setdefault(turns, []).append(c)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        own = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        below = children.get(p, ())
        leaves[p] = sum(leaves[x] for x in below) or 1
        saved[p] = (len(members[p]) - 1) * own + sum(saved[x] for x in below)
    out = []
    for p, of in members.items():
        digest = hashlib.sha256(",".join(map(str, sorted(ending.get(p, [])))).encode()).hexdigest()
        out.append((min(of), len(p), min(members[p[:-1]]) if p else None, len(of), len(children.get(p, ())), leaves[p], saved[p], digest))
    return sorted(out)


def got(spark, rows):
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, part string, depth int")
    found = prefix_trie.trie(*prefix_trie.rebuilt(*prefix_trie.numbered(table)))
    assert found.columns == COLUMNS
    return sorted(map(tuple, found.collect()))


def some(n, seed, long=0):
    r = random.Random(seed)
    rows = [(c, t if r.random() < 0.9 else None, r.choice(["user", None, "bot"]), r.choice(["a b", "", None, "c", "d e f"])) for c in r.sample(range(3 * n), n) for t in range(r.choice([0, 1, 2, 3, 5]))]
    return rows + [(7, t, "user", f"w{t % 3}") for t in range(long)] + [(8, t, "user", f"w{t % 3}") for t in range(long)] + rows[:5] + [(None, 1, "user", "lost")]


@pytest.mark.parametrize("case", [(30, 1, 0), (60, 2, 40)])
def test_against_dictionary(spark, monkeypatch, case):
    # Small shards, short queues: totals cross shards, queues spill, and long conversations are cut.
    monkeypatch.setattr(prefix_trie, "SHARD_NODES", 10)
    monkeypatch.setattr(prefix_trie, "LEVELS", 3)
    monkeypatch.setattr(prefix_trie, "CHUNK_BYTES", 6)
    rows = some(*case)
    assert got(spark, rows) == expected(rows)


def test_no_rows(spark):
    assert got(spark, []) == []


def test_queue_spills():
    queue, r = prefix_trie.Queue(most=50), random.Random(3)
    items = [(r.randrange(100), k) for k in range(2000)]
    for x in items[:1500]:
        queue.push(x)
    out = [queue.pop() for _ in range(300)]
    for x in items[1500:]:
        queue.push(x)
    assert queue.runs
    rest = []
    while queue.least() is not None:
        rest.append(queue.pop())
    assert out == sorted(items[:1500])[:300] and rest == sorted(set(items) - set(out))


def test_query_against_dictionary(spark):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    assert sorted(map(tuple, queries.op11_conversation_trie(spark, SF).select(COLUMNS).collect())) == expected(rows)
