"""Retrieval metrics and observability."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def scored(run: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, ndcg, map, recall, precision) at k of each judged query.

    run: (query_id, id, rank). qrels: (query_id, id, grade > 0). Gain is linear, the discount
    is log2(rank + 1). A query without relevant rows is left out; one without results scores 0.
    """
    judged = qrels.where("grade > 0").groupBy("query_id", "id").agg(F.max("grade").alias("grade"))
    hits = run.where(F.col("rank") <= k).join(judged, ["query_id", "id"]).select("query_id", "rank", "grade")
    so_far = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    per_hit = hits.withColumn("found", F.count("*").over(so_far))
    got = per_hit.groupBy("query_id").agg(F.sum(F.col("grade") / F.log2(F.col("rank") + 1)).alias("dcg"), F.sum(F.col("found") / F.col("rank")).alias("ap"), F.count("*").alias("hits"))
    order = Window.partitionBy("query_id").orderBy(F.desc("grade"), "id")
    ideal = judged.withColumn("rank", F.row_number().over(order)).groupBy("query_id").agg(
        F.sum(F.when(F.col("rank") <= k, F.col("grade") / F.log2(F.col("rank") + 1))).alias("idcg"), F.count("*").alias("relevant")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return ideal.join(got, "query_id", "left").select(
        "query_id",
        (zero("dcg") / F.col("idcg")).alias("ndcg"),
        (zero("ap") / F.least(F.col("relevant"), F.lit(k))).alias("map"),
        (F.coalesce("hits", F.lit(0)) / F.col("relevant")).alias("recall"),
        (F.coalesce("hits", F.lit(0)) / F.lit(k)).alias("precision"),
    )


def averaged(scores: DataFrame) -> DataFrame:
    """The mean of each metric over the queries, in one row."""
    return scores.agg(*(F.avg(c).alias(c) for c in scores.columns if c != "query_id"), F.count("*").alias("queries"))


def retrieval(run: DataFrame, gold: DataFrame, k: int = 8) -> DataFrame:
    """One row: document recall and hit rate in percent, MRR, and queries; gold: (query_id, ids)."""
    wanted = gold.where(F.size("ids") > 0).select("query_id", F.explode(F.array_distinct("ids")).alias("id"), F.size(F.array_distinct("ids")).alias("n"))
    found = wanted.join(run.where(F.col("rank") <= k).select("query_id", "id", "rank"), ["query_id", "id"], "left")
    each = found.groupBy("query_id").agg(F.count("rank").alias("hits"), F.max("n").alias("n"), F.min("rank").alias("first"))
    return each.agg(
        F.avg(100.0 * F.col("hits") / F.col("n")).alias("recall"), F.avg(F.when(F.col("hits") > 0, 100.0).otherwise(0.0)).alias("hit"),
        F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"), F.count("*").alias("queries"),
    )


def attribution(entries: DataFrame, gold: DataFrame) -> DataFrame:
    """(channel, hit, n, mass): how much of what each channel brought went to wanted sources and to others."""
    wanted = gold.select("query_id", F.explode("ids").alias("source")).distinct().withColumn("hit", F.lit(True))
    named = entries.join(wanted, ["query_id", "source"], "left")
    return named.groupBy("channel", F.coalesce("hit", F.lit(False)).alias("hit")).agg(F.count("*").alias("n"), F.sum(F.col("seed") + F.col("walked")).alias("mass"))


def phases(timed: DataFrame, phase: str, value: str, bins: int = 1024) -> DataFrame:
    """(phase, n, median, p95, most): p95 is the nearest rank.

    The values of a phase are counted in bins of equal width; only the bins that hold the
    wanted ranks are put in order.
    """
    v = timed.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(F.col(phase).alias("phase"), F.col(value).alias("v"))
    spans = v.groupBy(F.coalesce(F.col("phase").cast("string"), F.lit("")).alias("_p"), F.col("phase").isNull().alias("_null")).agg(F.count("*").alias("n"), F.min("v").alias("_lo"), F.max("v").alias("most"))
    width = F.col("most") - F.col("_lo")
    bin_ = F.when(width > 0, F.least(F.floor((F.col("v") - F.col("_lo")) / width * bins), F.lit(bins - 1))).otherwise(F.lit(0)).alias("_bin")
    placed = v.withColumn("_p", F.coalesce(F.col("phase").cast("string"), F.lit(""))).withColumn("_null", F.col("phase").isNull()).join(spans, ["_p", "_null"]).select("phase", "_p", "_null", "v", "n", "most", bin_)
    keys = ["_p", "_null"]
    counts = placed.groupBy(*keys, "_bin").agg(F.count("*").alias("_c"), F.max("n").alias("n"))
    until = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_bin")) - F.col("_c")
    wanted = F.array(F.floor((F.col("n") + 1) / 2), F.ceil((F.col("n") + 1) / 2), F.ceil(0.95 * F.col("n")))
    held = counts.withColumn("_until", until).where(F.exists(wanted, lambda r: (r > F.col("_until")) & (r <= F.col("_until") + F.col("_c")))).select(*keys, "_bin", "_until")
    rank = F.col("_until") + F.row_number().over(Window.partitionBy(*keys, "_bin").orderBy("v"))
    ranked = placed.join(held, [*keys, "_bin"]).withColumn("i", rank)
    middle = (F.col("i") == F.floor((F.col("n") + 1) / 2)) | (F.col("i") == F.ceil((F.col("n") + 1) / 2))
    return ranked.groupBy("phase").agg(
        F.max("n").alias("n"), F.avg(F.when(middle, F.col("v"))).alias("median"), F.max(F.when(F.col("i") == F.ceil(0.95 * F.col("n")), F.col("v"))).alias("p95"), F.max("most").alias("most")
    )
