"""The index's tables as views over the corpus tables, with explicit columns and deterministic ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillfind.functions import text as X

EXTENT = T.StructType([T.StructField("unit", T.StringType()), T.StructField("first_pos", T.LongType()), T.StructField("last_pos", T.LongType())])

#: Closed lists of the model.
VOCABULARY_KINDS = ("term", "identifier", "entity", "alias", "facet")
VOCABULARY_ORIGINS = ("mined", "extracted", "grounded", "envelope")
SEED_CHANNELS = ("prose", "lexical", "vector", "exact", "cluster")
ROW_KINDS = ("prose", "summary", "entry", *VOCABULARY_KINDS, "other")


def sources_of(documents: DataFrame) -> DataFrame:
    """One row per source: address, envelope and index bookkeeping. Times in seconds since 1970."""
    text = F.col("text")
    deep = text.isNotNull() & (F.length(F.trim(text)) > 0)
    return documents.select(
        F.col("doc_id").alias("id"),
        "host",
        "locator",
        F.concat(F.lit("disc://"), F.col("host"), F.lit("/"), F.col("locator")).alias("address"),
        F.col("source").alias("source_type"),
        F.col("mimetype").alias("content_type"),
        F.col("lang"),
        F.unix_seconds("modified").alias("modified"),
        F.unix_seconds("observed").alias("observed"),
        F.sha2(text, 256).alias("digest"),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("raw_bytes"),
        text.isNotNull().alias("indexed"),
        F.when(deep, F.sha2(F.coalesce("mimetype", F.lit("")), 256)).alias("shape_stamp"),
        text.alias("text"),
    )


def deep_indexed():
    """Indexed, and stamped with the shape of its transforms."""
    return F.col("indexed") & F.col("shape_stamp").isNotNull()


def role_of(mimetype, keyed):
    """Which full-text index a fragment goes to: summaries, lexical rows (keyed or derived), or content."""
    return F.when(mimetype.startswith(f"{X.DERIVED}summary"), "summary").when(keyed | mimetype.startswith(X.DERIVED), "lexical").otherwise("content")


def search_rows_of(fragments: DataFrame) -> DataFrame:
    """(id, source, role, text) of every fragment with text: the prose and the lexical index are scored apart."""
    return fragments.where(F.length(F.trim("text")) > 0).select(
        "id", "source", role_of(F.col("mimetype"), F.col("source").isNull()).alias("role"), "text"
    )


def relations_of(fragments: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(src, kind, dst), always from input to output: a source contains its fragments, a fragment mentions its values."""
    contains = fragments.where("source IS NOT NULL").select(
        F.concat(F.lit("s"), F.col("source").cast("string")).alias("src"), F.lit("contains").alias("kind"), F.concat(F.lit("f"), F.col("id").cast("string")).alias("dst")
    )
    value = X.normalize_spelling(F.col("normalized"))
    mentions = (
        vocabulary.where(F.length(value) > 0)
        .select(F.concat(F.lit("f"), F.col("fragment").cast("string")).alias("src"), F.lit("mentions").alias("kind"), F.concat(F.lit("v"), value).alias("dst"))
        .distinct()
    )
    return contains.union(mentions)
