"""Queries of the training-data operators, and their SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillfind.llm import bpe, cuts, leakage, mailnew, neighbours, pairs, splitter, termcount, transcripts


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    return transcripts.turns(_read(spark, sf, "sentences"), _read(spark, sf, "call_parties"), resets=None)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return _turns(spark, sf).select("call_id", "turn_no", "channel", "first_sentence_id", "last_sentence_id")


def p2_turns(spark: SparkSession, sf: str) -> DataFrame:
    return _turns(spark, sf)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return termcount.marked(_read(spark, sf, "vocabulary_rows")).where("mark IS NOT NULL").select("normalized", "mark")


def p3_frequencies(spark: SparkSession, sf: str) -> DataFrame:
    return termcount.marked(_read(spark, sf, "vocabulary_rows"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.defective(_read(spark, sf, "selected_questions"), _read(spark, sf, "answers"), _read(spark, sf, "documents"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    cache = _read(spark, sf, "embedding_cache").select("id", "vector", F.coalesce("dimensions", F.lit(-1)).alias("dims"))
    clusters = _read(spark, sf, "clusters").select("id", "vector", F.size("vector").alias("dims"))
    return neighbours.pairs(neighbours.nearest(cache.union(clusters), dimensions="dims"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return mailnew.written_lines(_read(spark, sf, "fragments"))


def p6_lines(spark: SparkSession, sf: str) -> DataFrame:
    return mailnew.body_lines_by_origin(_read(spark, sf, "fragments"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return splitter.split_oversized(_read(spark, sf, "fragments")).where("piece_no = 1").select("id")


def p7_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return splitter.split_oversized(_read(spark, sf, "fragments"))


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.encode(_read(spark, sf, "documents"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaked(_read(spark, sf, "documents"), _read(spark, sf, "eval_items"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return cuts.cut_documents(_read(spark, sf, "documents")).where("cut").select("doc_id")


def p10_sources(spark: SparkSession, sf: str) -> DataFrame:
    return cuts.share_by_source(_read(spark, sf, "documents"))


def queries() -> dict:
    return {
        "p2_found": p2_found,
        "p2_turns": p2_turns,
        "p3_found": p3_found,
        "p3_frequencies": p3_frequencies,
        "p4_found": p4_found,
        "p5_found": p5_found,
        "p6_found": p6_found,
        "p6_lines": p6_lines,
        "p7_found": p7_found,
        "p7_pieces": p7_pieces,
        "p8_ids": p8_ids,
        "p9_found": p9_found,
        "p10_found": p10_found,
        "p10_sources": p10_sources,
    }


def oracle_sql() -> dict[str, str]:
    # nfc twice: lower case may leave letters that compose with a mark after them
    blank = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
    counted = rf"""
WITH v AS (SELECT fragment, trim(regexp_replace(nfc_normalize(lower(nfc_normalize(normalized))), '{blank}', ' ', 'g')) AS normalized
           FROM vocabulary_rows WHERE normalized IS NOT NULL),
 w AS (SELECT * FROM v WHERE normalized <> ''),
 n AS (SELECT count(DISTINCT fragment) AS total FROM w),
 c AS (SELECT normalized, count(*) AS n_rows, count(DISTINCT fragment) AS document_frequency FROM w GROUP BY normalized),
 m AS (SELECT c.*, CASE WHEN document_frequency <= 1 THEN 'rare' WHEN document_frequency > total * 0.05 THEN 'common' END AS mark FROM c, n)
"""
    return {
        "p3_found": counted + "SELECT normalized, mark FROM m WHERE mark IS NOT NULL",
        "p3_frequencies": counted + "SELECT normalized, n_rows, document_frequency, mark FROM m",
        "p7_found": "SELECT id FROM fragments WHERE octet_length(encode(text)) > 3200",
    }
