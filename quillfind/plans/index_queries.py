"""Queries of the index's upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillfind.functions import vectors as V
from quillfind.operators import index as I
from quillfind.operators import model
from quillfind.operators import replication as R
from quillfind.plans.search_queries import SPACES


def _t(s, d, name):
    return s.read.parquet(f"{d}/{name}.parquet")


def _labelled(s, d):
    """Clusters with the hashed embedding of their label in place of their vector."""
    return _t(s, d, "clusters").where("length(label) > 0").select("id", V.hashed_embedding(F.col("label"), 64).alias("vector"), "member_count", "changed_sweep")


def queries() -> dict:
    return {
        "adopt_keyed": lambda s, d: I.adopted(_t(s, d, "fragments"), _t(s, d, "vocabulary_rows")),
        "envelope_df": lambda s, d: I.document_frequencies(_t(s, d, "vocabulary_rows"), _t(s, d, "fragments")),
        "embedding_stage": lambda s, d: I.embedded(model.search_rows_of(_t(s, d, "fragments")), _t(s, d, "embedding_cache"), "hash-64", 64).select("id", "digest", "fresh", F.size("vector").alias("dims")),
        "stale_vectors": lambda s, d: I.stale_vectors(_t(s, d, "embedding_cache"), "hash-64", 64),
        "cluster_merges": lambda s, d: I.merges(_labelled(s, d), 0),
        "log_authority": lambda s, d: I.authorised(R.entries(_t(s, d, "sync_log"))).groupBy("kind", "allowed").agg(F.count("*").alias("n")),
        "log_hosts": lambda s, d: R.hosts_with_stewards(R.entries(_t(s, d, "sync_log")).where("NOT gone")).select("host", F.size("stewards").alias("n"), F.array_join("stewards", ",").alias("stewards")),
    }


def oracle_sql() -> dict[str, str]:
    acc = """e AS (SELECT origin, epoch, seq, key, max(CASE WHEN tombstone IS NULL THEN coalesce(json_extract_string(record, '$.record') IN ('source_gone', 'stewardship_withdrawn'), false) ELSE tombstone END) AS gone, max(json_extract_string(record, '$.record') COLLATE "C") AS kind
 FROM sync_log WHERE regexp_matches(origin, '\\S') AND regexp_matches(key, '\\S') AND epoch > 0 AND seq > 0 GROUP BY 1, 2, 3, 4)"""
    norm = f"lower(trim(regexp_replace(text, '{SPACES}', ' ', 'g')))"
    return {
        "adopt_keyed": f"""WITH k AS (SELECT id AS fragment, regexp_extract(mimetype, '^text/x-derived-([a-z]+)', 1) AS kind, {norm} AS normalized FROM fragments WHERE source IS NULL AND length(trim(text, ' ')) > 0 AND id NOT IN (SELECT fragment FROM vocabulary_rows WHERE fragment IS NOT NULL))
 SELECT fragment, CASE WHEN kind IN ('term', 'identifier', 'entity', 'alias', 'facet') THEN kind ELSE 'term' END AS kind, normalized FROM k""",
        "envelope_df": f"WITH v AS (SELECT fragment, lower(trim(regexp_replace(normalized, '{SPACES}', ' ', 'g'))) AS normalized FROM vocabulary_rows WHERE origin = 'envelope') SELECT normalized, count(DISTINCT source) AS document_frequency FROM v JOIN fragments f ON f.id = v.fragment WHERE normalized <> '' AND source IS NOT NULL GROUP BY 1",
        "embedding_stage": "WITH k AS (SELECT DISTINCT digest FROM embedding_cache WHERE model = 'hash-64' AND dimensions = 64 AND len(vector) = 64) SELECT id, sha256(text) AS digest, sha256(text) NOT IN (SELECT digest FROM k) AS fresh, 64 AS dims FROM fragments WHERE length(trim(text, ' ')) > 0",
        "stale_vectors": "SELECT id FROM embedding_cache WHERE NOT coalesce(model = 'hash-64' AND dimensions = 64 AND len(vector) = 64, false)",
        "log_authority": f"""WITH {acc}, a AS (SELECT *, regexp_extract(key, '^(?:node|stewardship):([^/]+)', 1) AS own FROM e)
 SELECT kind, NOT coalesce(kind IN ('node', 'stewardship', 'stewardship_withdrawn'), false) OR own = '' OR own = origin AS allowed, count(*) AS n FROM a GROUP BY 1, 2""",
        "log_hosts": f"""WITH {acc}, d AS (SELECT DISTINCT substring(key, 6) AS host, origin FROM e WHERE NOT gone AND key LIKE 'host:%') SELECT host, CAST(count(*) AS INT) AS n, string_agg(origin, ',' ORDER BY origin COLLATE "C") AS stewards FROM d GROUP BY host""",
    }
