"""The driver's contract: every query has a name, its SQL belongs to a query, and the flagship gives rows."""

import re

import __spark_entry__ as entry


def test_names_and_sql():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and all(map(callable, queries.values()))
    assert all(re.fullmatch(r"[a-z0-9_]+", name) for name in queries)


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "source", "score", "share", "rank", "copies"] and df.count() > 0
