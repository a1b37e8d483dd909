import hashlib
import random

import duckdb
import pytest
from tallyvane.llm import queries, warc_fixity
from tallyvane.llm.warc_fixity import FANOUT

SCHEMA = "page_id long, url string, html string, offset int"


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(4)
    rows = [(k, rng.choice([None, "", f"http://é/{k}"]), rng.choice([None, "", "<p>é\r\n\r\n</p>" * rng.randint(0, 9)]), 1) for k in range(1400) if k % 5]
    rows += [(None, "u", "b", 1)] * 2 + [(7, "again", "x", 1)] * 2
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_rendered_files_parse_back(spark, pages, tmp_path):
    rows = warc_fixity.layout(warc_fixity.render(pages)).collect()
    records = {}
    for r in warc_fixity.render(pages).collect():
        records.setdefault(hashlib.sha256(r.record.encode()).hexdigest(), r.record.encode())
    files = {}
    for r in sorted(rows, key=lambda r: (r.file, r.ordinal)):
        data = files.setdefault(r.file, bytearray())
        assert (len(data), len(records[r.digest])) == (r.offset, r.length)
        data += records[r.digest]
    for name, data in files.items():
        (tmp_path / f"{name}.warc").write_bytes(data)
        assert all(h["content-length"] == str(len(body)) for _, _, h, body in warc_fixity.parse(bytes(data)))
    found = {(int(r.file.rpartition("/")[2][:-5]), r.ordinal): (r.offset, r.length, r.digest) for r in warc_fixity.read(spark, str(tmp_path)).collect()}
    assert found == {(r.file, r.ordinal): (r.offset, r.length, r.digest) for r in rows}


def brute_root(rows):
    files = {}
    for r in sorted(rows, key=lambda r: (r.file, r.ordinal)):
        files.setdefault(r.file, []).append(hashlib.sha256(f"{r.ordinal}:{r.offset}:{r.length}:{r.digest}".encode()).hexdigest())
    join = lambda xs: hashlib.sha256("".join(xs).encode()).hexdigest()
    deep = max(map(len, files.values()))
    now = {}
    for name, level in files.items():
        n = deep
        while n > 1 or n == deep == 1:
            level, n = [join(level[k : k + FANOUT]) for k in range(0, len(level), FANOUT)], -(-n // FANOUT) if n > 1 else 0
        now[name + 1] = level[0]
    n = max(now) + 1
    while n > 1:
        parents = {}
        for place in sorted(now):
            parents.setdefault(place // FANOUT, []).append(now[place])
        now, n = {k: join(v) for k, v in parents.items()}, -(-n // FANOUT)
    return now[0]


def test_root_and_damage_against_brute_force(spark, pages):
    good = warc_fixity.layout(warc_fixity.render(pages))
    rows = good.collect()
    assert warc_fixity.root(good) == brute_root(rows)
    assert warc_fixity.damaged(good, good).collect() == []
    rng = random.Random(8)
    other = []
    for r in rows:
        x = rng.random()
        if x < 0.02:
            other.append((r.file, r.ordinal, r.key, r.offset, r.length, "0" * 64))
        elif x < 0.04:
            other.append((r.file, r.ordinal, r.key, r.offset + 5, r.length, r.digest))
        elif x > 0.06:
            other.append(tuple(r))
    other += [(3, 900, None, 1, 1, "f" * 64), (12, 0, None, 0, 1, "f" * 64)]
    replica = spark.createDataFrame(other, good.schema)
    a, b = {(r.file, r.ordinal): tuple(r)[3:] for r in rows}, {r[:2]: r[3:] for r in other}
    expected = {(k, "missing" if k not in b else "extra" if k not in a else "moved" if a[k][1:] == b[k][1:] else "changed") for k in {*a, *b} if a.get(k) != b.get(k)}
    assert {((r.file, r.ordinal), r.kind) for r in warc_fixity.damaged(good, replica).collect()} == expected
    nothing = good.limit(0)
    assert warc_fixity.root(nothing) is None
    assert warc_fixity.damaged(nothing, nothing).collect() == []
    assert {r.kind for r in warc_fixity.damaged(good, nothing).collect()} == {"missing"}


def test_query_against_sql(spark):
    got = sorted(map(tuple, queries.op6_fixity_audit(spark, "/root/testdata/sf0.01").collect()))
    sql = queries.OP6_SQL.replace("FROM pages", "FROM '/root/testdata/sf0.01/pages.parquet'")
    assert got and got == sorted(duckdb.sql(sql).fetchall())
