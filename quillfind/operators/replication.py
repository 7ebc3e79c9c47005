"""The replicated log as a table: compaction, version vectors, deltas, and the materialized roster."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillfind.operators.changefeed import _withdraws, accepted

#: Fixed value: entries of one delta at most.
DELTA = 2000
#: Seconds of a block of deliveries.
BLOCK_SECS = 3600


def entries(log: DataFrame) -> DataFrame:
    """(origin, epoch, seq, key, gone, kind): accepted entries, deliveries of one identity assembled to one."""
    rows = accepted(log).select("origin", "epoch", "seq", "key", _withdraws("tombstone", "record", ("source_gone", "stewardship_withdrawn")).alias("gone"), F.get_json_object("record", "$.record").alias("kind"))
    return rows.groupBy("origin", "epoch", "seq", "key").agg(F.max("gone").alias("gone"), F.max("kind").alias("kind"))


def compacted(log: DataFrame) -> DataFrame:
    """(origin, epoch, key, seq): of each key of an epoch only its last entry is held."""
    return accepted(log).groupBy("origin", "epoch", "key").agg(F.max("seq").alias("seq"))


def positions(log: DataFrame) -> DataFrame:
    """(origin, epoch, seq): the high-water mark of every epoch."""
    return accepted(log).groupBy("origin", "epoch").agg(F.max("seq").alias("seq"))


def version_vector(log: DataFrame) -> DataFrame:
    """(origin, epoch, seq): the highest sequence of the newest epoch of each origin."""
    marks = positions(log)
    return marks.groupBy("origin").agg(F.max(F.struct("epoch", "seq")).alias("m")).select("origin", "m.epoch", "m.seq")


def counts(log: DataFrame) -> DataFrame:
    """(origin, n): accepted rows of each origin."""
    return accepted(log).groupBy("origin").agg(F.count("*").alias("n"))


def delta(log: DataFrame, vector: DataFrame, limit: int | None = None) -> DataFrame:
    """(origin, epoch, seq, key): held entries that a vector lacks: of a newer epoch, or the same one and a larger sequence."""
    held = compacted(log)
    known = vector.select("origin", F.col("epoch").alias("_e"), F.col("seq").alias("_s"))
    newest = version_vector(log).select("origin", "epoch")
    lacking = (
        held.join(newest, ["origin", "epoch"], "left_semi")
        .join(known, "origin", "left")
        .where(F.col("_e").isNull() | (F.col("epoch") > F.col("_e")) | ((F.col("epoch") == F.col("_e")) & (F.col("seq") > F.col("_s"))))
        .select("origin", "epoch", "seq", "key")
    )
    return lacking if limit is None else lacking.orderBy("origin", "seq", "key").limit(min(limit, DELTA))


def applied(log: DataFrame, order: str = "arrived") -> DataFrame:
    """(origin, applied, skipped, refused): how a node that reads the deliveries in order of arrival takes each.

    An entry is applied if the node lacks it: of a newer epoch than any before, or of the
    same epoch and beyond the sequence reached. A gap that is filled later is lost: the
    position has moved on. The highest position before a row is a running maximum, taken
    within blocks of time and then over the blocks, so an origin is many groups.
    """
    whole = F.coalesce(F.length(F.trim("origin")) > 0, F.lit(False)) & F.coalesce(F.length(F.trim("key")) > 0, F.lit(False)) & F.coalesce(F.col("epoch") > 0, F.lit(False)) & F.coalesce(F.col("seq") > 0, F.lit(False))
    block = F.coalesce(F.floor(F.col(order).cast("double") / BLOCK_SECS), F.lit(-(1 << 40)))  # nulls come first
    place = F.when(F.col("_whole"), F.struct("epoch", "seq"))
    told = log.select("origin", "epoch", "seq", order, "key", F.coalesce("tombstone", F.lit(False)).alias("tombstone"), F.coalesce("record", F.lit("")).alias("record")).withColumn("_whole", whole).withColumn("_block", block)
    tops = told.groupBy("origin", "_block").agg(F.max(place).alias("_top"))
    earlier = Window.partitionBy("origin").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(F.coalesce("origin", F.lit("")).alias("_o"), F.col("origin").isNull().alias("_null"), "_block", F.max("_top").over(earlier).alias("_before"))
    inside = Window.partitionBy("origin", "_block").orderBy(order, "epoch", "seq", "key", "tombstone", "record").rowsBetween(Window.unboundedPreceding, -1)
    met = told.withColumn("_o", F.coalesce("origin", F.lit(""))).withColumn("_null", F.col("origin").isNull()).join(tops, ["_o", "_null", "_block"])
    at = F.greatest("_before", F.max(place).over(inside))
    taken = F.col("_whole") & (F.col("_at").isNull() | (F.struct("epoch", "seq") > F.col("_at")))
    return met.withColumn("_at", at).groupBy("origin").agg(F.count_if(taken).alias("applied"), F.count_if(F.col("_whole") & ~taken).alias("skipped"), F.count_if(~F.col("_whole")).alias("refused"))


def materialized(state: DataFrame) -> DataFrame:
    """(kind, origin, n): what stands of each kind of record; node and stewardship records only from the node they describe."""
    return state.groupBy("kind", "origin").agg(F.count("*").alias("n"))


def roster(state: DataFrame, expelled: DataFrame) -> DataFrame:
    """(node) that stand and aren't expelled."""
    return state.where("kind = 'node'").select(F.col("origin").alias("node")).distinct().join(expelled, "node", "left_anti")


def hosts_with_stewards(state: DataFrame) -> DataFrame:
    """(host, stewards): each host with the origins that stand for it, in order. A host has as many rows as stewards."""
    return state.where(F.col("key").startswith("host:")).groupBy(F.substring("key", 6, 1000).alias("host")).agg(F.array_sort(F.collect_set("origin")).alias("stewards"))
