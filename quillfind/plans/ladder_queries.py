"""Queries of the discovery ladder: scan, stand-ins and connectors' rendering of what was found."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillfind.functions import text as X
from quillfind.operators import ladder as L
from quillfind.operators import transforms as T


def _t(s, d, name):
    return s.read.parquet(f"{d}/{name}.parquet")


def _summaries(s, d):
    trees = T.subtrees(_t(s, d, "documents"))
    roots = _t(s, d, "documents").select(F.col("doc_id").alias("source"), (F.col("doc_id") * 1000).alias("root"))
    return L.summaries(T.fragments_of(trees), T.edges_of(trees), roots)


def queries() -> dict:
    return {
        "scan_lines": lambda s, d: L.scan(_t(s, d, "documents"), 2, 4, "doc_id"),
        "fetch_bytes": lambda s, d: L.fetch_bytes(_t(s, d, "documents"), 10, 90, "doc_id").withColumn("content", F.hex("content")),
        "scan_stand_in": lambda s, d: L.stand_ins(_t(s, d, "fragments")).select("source", "id"),
        "source_summaries": _summaries,
        "entity_anchors": lambda s, d: T.anchors(_t(s, d, "fragments").where("source IS NOT NULL").select("source", F.lit("museum").alias("needle"), (-F.col("source")).alias("input")).distinct(), _t(s, d, "fragments").select("source", "id", "text")),
        "span_containment": lambda s, d: T.deepest(_points(s, d), _spans(s, d)),
        "mime_patterns": lambda s, d: _t(s, d, "fragments").select("id", X.matches_pattern(F.col("mimetype"), "text/*").alias("text"), X.has_essence(F.col("mimetype"), "text/markdown").alias("markdown"), X.parameter(F.col("mimetype"), "variant").alias("variant")),
    }


def _spans(s, d):
    return _t(s, d, "fragments").where("extent.unit = 'lines' AND source IS NOT NULL").select("source", "id", F.col("extent.first_pos").alias("first"), F.col("extent.last_pos").alias("last")).where("first <= last")


def _points(s, d):
    """The middle line of every fragment that has lines."""
    return _spans(s, d).select("source", F.floor((F.col("first") + F.col("last")) / 2).alias("at")).distinct()


def oracle_sql() -> dict[str, str]:
    line = "CASE WHEN string_split(text, chr(10))[-1] = '' THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END"
    return {
        "fetch_bytes": "SELECT doc_id AS id, CAST(10 AS BIGINT) AS first, CAST(least(90, octet_length(encode(text))) AS BIGINT) AS \"end\", substr(hex(encode(text)), 21, 160) AS content FROM documents WHERE octet_length(encode(text)) > 10",
        "scan_lines": f"SELECT doc_id AS id, 2 AS first, CAST(least(4, len({line})) AS INT) AS last, array_to_string(list_transform(({line})[2:4], lambda x: regexp_replace(x, '\\r$', '')), chr(10)) AS content FROM documents WHERE len({line}) >= 2",
        "scan_stand_in": "SELECT source, arg_max(id, struct_pack(a := length(text), b := id)) AS id FROM fragments WHERE length(text) > 0 AND source IS NOT NULL AND mimetype NOT LIKE 'text/x-derived-%' GROUP BY source",
        "entity_anchors": """WITH f AS (SELECT * FROM fragments WHERE source IS NOT NULL), m AS (SELECT DISTINCT source, 'museum' AS needle, id FROM f WHERE contains(lower(text), 'museum'))
 SELECT * FROM m UNION ALL SELECT DISTINCT source, 'museum', -source FROM f WHERE source NOT IN (SELECT source FROM m)""",
        "span_containment": """WITH s AS (SELECT source, id, extent.first_pos AS f, extent.last_pos AS l FROM fragments WHERE extent.unit = 'lines' AND source IS NOT NULL AND extent.first_pos <= extent.last_pos),
 p AS (SELECT DISTINCT source, CAST(floor((f + l) / 2) AS BIGINT) AS at_line FROM s)
 SELECT p.source, at_line AS "at", arg_min(id, struct_pack(a := l - f, b := id)) AS id FROM p JOIN s ON s.source = p.source AND at_line BETWEEN f AND l GROUP BY 1, 2""",
        "mime_patterns": """SELECT id, lower(trim(string_split(mimetype, ';')[1])) LIKE 'text/%' AS text, mimetype = 'text/markdown' OR mimetype LIKE 'text/markdown;%' AS markdown, nullif(trim(regexp_extract(mimetype, '(?i);\\s*variant\\s*=\\s*"?([^;"]*)"?', 1)), '') AS variant FROM fragments""",
    }
