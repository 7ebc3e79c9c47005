"""Queries over transforms, summaries and rendered records."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillfind.operators import transforms as T
from quillfind.sources import render


def _t(s, d, name):
    return s.read.parquet(f"{d}/{name}.parquet")


def _documents(s, d):
    return _t(s, d, "documents")


def queries() -> dict:
    return {
        "subtree_plan": lambda s, d: T.subtrees(_documents(s, d)),
        "subtree_fragments": lambda s, d: T.fragments_of(T.subtrees(_documents(s, d))),
        "subtree_edges": lambda s, d: T.edges_of(T.subtrees(_documents(s, d))),
        "section_counts": lambda s, d: T.subtrees(_documents(s, d)).groupBy("source").agg(F.count("*").alias("fragments"), F.count_if(F.col("mimetype") == "text/uri-list").alias("links")),
        "shape_stamps": lambda s, d: T.stamps(_documents(s, d)),
        "summarize": lambda s, d: T.summarized(_documents(s, d)),
        "keywords": lambda s, d: T.keyworded(_documents(s, d)),
        "call_transcripts": lambda s, d: render.transcripts(_t(s, d, "sentences")),
        "contact_cards": lambda s, d: render.cards(_t(s, d, "call_parties")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "shape_stamps": """WITH m AS (SELECT doc_id, lower(trim(string_split(coalesce(mimetype, 'application/octet-stream'), ';')[1])) AS m FROM documents),
 n AS (SELECT doc_id, concat_ws('|', CASE WHEN m = 'inode/directory' THEN 'directory' END, CASE WHEN m LIKE 'text/%' AND m NOT LIKE 'text/x-derived-%' AND m <> 'text/uri-list' THEN 'sections' END, CASE WHEN m LIKE 'text/%' OR m = 'message/rfc822' THEN 'summary' END, 'v1') AS x FROM m)
 SELECT doc_id, sha256(x) AS stamp FROM n""",
        "call_transcripts": """SELECT call_id, string_agg('[' || lpad(CAST(CAST(floor(greatest(start_secs, 0) / 60) AS INT) AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(floor(greatest(start_secs, 0)) AS INT) % 60 AS VARCHAR), 2, '0') || '] channel ' || coalesce(CAST(channel AS VARCHAR), '?') || ': ' || text, chr(10) ORDER BY start_secs, sentence_id) AS transcript, count(*) AS lines
 FROM sentences WHERE start_secs IS NOT NULL AND text IS NOT NULL GROUP BY call_id""",
        "contact_cards": "SELECT call_id, channel, 'Name: ' || display_name || chr(10) || 'Role: ' || party_role AS card FROM call_parties",
    }
