"""All queries of the engine itself, by name, with the SQL that must return the same rows."""

from __future__ import annotations

from tallyvane.plans import deal_queries, finance_queries, memo_queries, operation_queries, page_queries, search_queries

_MODULES = [search_queries, page_queries, finance_queries, operation_queries, memo_queries, deal_queries]


def flagship(spark, sf_dir):
    return search_queries.retrieval_recall(spark, sf_dir)


def queries() -> dict:
    return {name: query for m in _MODULES for name, (query, _) in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in _MODULES for name, (_, sql) in m.QUERIES.items() if sql}
