"""All queries of the core, gathered from the modules of this package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillfind.plans import catalog_queries, content_queries, corpus_queries, feed_queries, index_queries, ladder_queries, search_queries

MODULES = (feed_queries, catalog_queries, search_queries, corpus_queries, content_queries, ladder_queries, index_queries)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in m.oracle_sql().items()}


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return search_queries.flagship(spark, sf)
