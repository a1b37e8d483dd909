"""Every registered query of the engine on a small table, held against its SQL."""

import duckdb
import pytest

from tallyvane.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def cell(v):
    if isinstance(v, float):
        return f"{v:.5f}"
    if isinstance(v, (list, tuple)):
        return str([cell(x) for x in v])
    return str(v)


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query(spark, oracle, name):
    got = registry.queries()[name](spark, SF)
    columns = sorted(got.columns)
    rows = sorted(tuple(cell(r[c]) for c in columns) for r in got.collect())
    assert rows
    sql = registry.oracle_sql().get(name)
    if sql:
        found = oracle.sql(sql)
        assert sorted(found.columns) == columns
        at = [found.columns.index(c) for c in columns]
        assert sorted(tuple(cell(r[k]) for k in at) for r in found.fetchall()) == rows
