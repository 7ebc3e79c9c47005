"""Queries over the replicated change log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillfind.operators import changefeed

_ACCEPTED = """
  SELECT *, CASE WHEN tombstone IS NULL
                 THEN coalesce(json_extract_string(record, '$.record') IN ('source_gone', 'stewardship_withdrawn'), false)
                 ELSE tombstone END AS gone
  FROM sync_log
  WHERE regexp_matches(origin, '\\S') AND regexp_matches(key, '\\S') AND epoch > 0 AND seq > 0
"""


def _log(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/sync_log.parquet")


def queries() -> dict:
    return {
        "p1_found": lambda s, d: changefeed.current_state(_log(s, d)),
        "p1_watermark": lambda s, d: changefeed.watermarks(_log(s, d)),
        "p1_committed": lambda s, d: changefeed.current_state(_log(s, d), complete=None),
    }


def oracle_sql() -> dict[str, str]:
    newest = f"""WITH a AS ({_ACCEPTED}),
 n AS (SELECT * FROM a WHERE (origin, epoch) IN (SELECT (origin, max(epoch)) FROM a GROUP BY origin)),
 d AS (SELECT DISTINCT origin, epoch, seq FROM n),
 r AS (SELECT *, row_number() OVER (PARTITION BY origin, epoch ORDER BY seq) AS rn FROM d),
 w AS (SELECT origin, epoch, max(seq) AS last_seq, coalesce(max(seq) FILTER (WHERE seq = rn), 0) AS watermark
       FROM r GROUP BY origin, epoch)"""
    stand = """SELECT origin, epoch, seq, key FROM (
   SELECT origin, epoch, key, max(seq) FILTER (WHERE NOT gone) AS seq, max(seq) FILTER (WHERE gone) AS gs
   FROM {rows} GROUP BY origin, epoch, key) WHERE seq > coalesce(gs, 0)"""
    return {
        "p1_found": f"{newest} {stand.format(rows='n')}",
        "p1_watermark": f"{newest} SELECT origin, epoch, last_seq, watermark FROM w",
        "p1_committed": f"{newest}, h AS (SELECT n.* FROM n JOIN w USING (origin, epoch) WHERE n.seq <= w.watermark) {stand.format(rows='h')}",
    }
