"""Applying a feed of inserts, updates and withdrawals (problem 1).

A change is identified by (origin, epoch, seq). All rows with one identity are the
deliveries of one transaction; they are assembled by aggregation, so repeats and any
order of arrival make no difference. Keys don't conflict with each other, so the
replay of one (origin, key) is one hash-aggregated group: partial results are combined
before the shuffle, and a hot origin or key costs one row per input partition.

Of an origin only the newest epoch counts. What is exposed ends at the committed
watermark of (origin, epoch): the last sequence up to which none is missing. A gap holds
back what is behind it until it is filled, or closed by evidence: a completeness mark
(origin, epoch, upto) says that nothing below `upto` is still to come, as a compacted log
never fills its gaps. The marks of a log that has been read whole are its last sequences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillfind.functions.session import present, written

#: Kinds of records that withdraw their key when the tombstone is null.
WITHDRAWING = ("source_gone", "stewardship_withdrawn")

#: Sequences per block in the search for the first gap.
GAP_BLOCK = 4096
#: Watermarks that are sent to all tasks at most; more are joined.
SENT = 1 << 18


def _withdraws(tombstone: str, record: str, kinds: tuple[str, ...]) -> Column:
    kind = F.get_json_object(F.col(record), "$.record")
    return F.when(F.col(tombstone).isNull(), F.coalesce(kind.isin(*kinds), F.lit(False))).otherwise(F.col(tombstone))


def accepted(log: DataFrame, origin: str = "origin", epoch: str = "epoch", seq: str = "seq", key: str = "key") -> DataFrame:
    """Rows with a whole identity: origin and key not blank, epoch and seq positive."""
    return log.where(present(F.col(origin)) & present(F.col(key)) & (F.col(epoch) > 0) & (F.col(seq) > 0))


def positions(log: DataFrame, origin: str = "origin", epoch: str = "epoch", seq: str = "seq", key: str = "key") -> DataFrame:
    """(origin, epoch, upto): the last sequence of the newest epoch of each origin: the completeness marks of a log read whole."""
    last = accepted(log, origin, epoch, seq, key).groupBy(F.col(origin).alias("origin"), F.col(epoch).alias("epoch")).agg(F.max(F.col(seq)).alias("upto"))
    # one row for each epoch here
    return last.groupBy("origin").agg(F.max(F.struct("epoch", "upto")).alias("m")).select("origin", "m.epoch", "m.upto")


def watermarks(log: DataFrame, origin: str = "origin", epoch: str = "epoch", seq: str = "seq", key: str = "key", complete: DataFrame | str | None = None) -> DataFrame:
    """(origin, epoch, last_seq, watermark) of the newest epoch of each origin.

    watermark is the last sequence of the unbroken run 1, 2, 3 ...; 0 if 1 is missing.
    Sequences up to the mark of `complete` (origin, epoch, upto) count as present; "read"
    takes as marks what `positions` tells of the log. The first gap is found by counts of blocks of sequences: an
    origin's sequences are never brought together, only its blocks are.
    """
    heads = positions(log, origin, epoch, seq, key).withColumnRenamed("upto", "last_seq")
    if isinstance(complete, str):
        if complete != "read":
            raise ValueError(f"complete is a DataFrame, 'read' or None, not {complete!r}")
        complete = positions(log, origin, epoch, seq, key)
    if complete is None:
        heads = heads.withColumn("upto", F.lit(0).cast("long"))
    else:
        marks = complete.groupBy("origin", "epoch").agg(F.max("upto").alias("upto"))
        heads = heads.join(marks, ["origin", "epoch"], "left").withColumn("upto", F.greatest(F.lit(0), F.least(F.coalesce("upto", F.lit(0)), "last_seq")).cast("long"))
    rows = accepted(log, origin, epoch, seq, key).select(F.col(origin).alias("origin"), F.col(epoch).alias("epoch"), F.col(seq).alias("seq"))
    beyond = rows.join(heads.where("upto < last_seq").select("origin", "epoch", "upto"), ["origin", "epoch"]).where("seq > upto")
    seqs = beyond.select("origin", "epoch", (F.col("seq") - F.col("upto")).alias("seq")).distinct()
    block = F.floor((F.col("seq") - 1) / GAP_BLOCK).alias("block")
    # within a block the unbroken run from its start ends where seq stops being its own rank
    runs = (
        seqs.groupBy("origin", "epoch", block)
        .agg(F.array_sort(F.collect_list("seq")).alias("held"))
        .withColumn("base", F.col("block") * GAP_BLOCK)
        .withColumn("run", F.size(F.filter("held", lambda x, i: x == F.col("base") + i + 1)).cast("long"))
        .drop("held")
    )
    # a block that is not full ends the run; the first such block decides
    first_broken = F.min(F.when(F.col("run") < GAP_BLOCK, F.struct("block", "run")))
    reached = runs.groupBy("origin", "epoch").agg(first_broken.alias("broken"), F.collect_set(F.when(F.col("run") == GAP_BLOCK, F.col("block"))).alias("full")).select("origin", "epoch", _watermark().alias("run"))
    return heads.join(reached, ["origin", "epoch"], "left").select("origin", "epoch", "last_seq", (F.col("upto") + F.coalesce("run", F.lit(0))).alias("watermark"))


def _watermark() -> Column:
    """The number of leading full blocks, then the run inside the block that follows them."""
    lead = F.size(F.filter(F.array_sort("full"), lambda x, i: x == i)).cast("long")
    inside = F.when(F.col("broken.block") == lead, F.col("broken.run")).otherwise(F.lit(0))
    return lead * GAP_BLOCK + F.coalesce(inside, F.lit(0))


def assembled(
    log: DataFrame,
    origin: str = "origin",
    epoch: str = "epoch",
    seq: str = "seq",
    key: str = "key",
    tombstone: str = "tombstone",
    record: str = "record",
    withdrawing: tuple[str, ...] = WITHDRAWING,
    payload: bool = False,
) -> DataFrame:
    """(origin, epoch, seq, key, gone[, record]): the transactions of the accepted rows, each of its keys once, whatever was delivered how often.

    If deliveries disagree, the withdrawal wins; of differing records the greatest text stays.
    """
    rows = accepted(log, origin, epoch, seq, key).select(
        F.col(origin).alias("origin"),
        F.col(epoch).alias("epoch"),
        F.col(seq).alias("seq"),
        F.col(key).alias("key"),
        _withdraws(tombstone, record, withdrawing).alias("gone"),
        *([F.col(record).alias("record")] if payload else []),
    )
    said = [F.max(F.when(~F.col("gone"), F.col("record"))).alias("record")] if payload else []
    return rows.groupBy("origin", "epoch", "seq", "key").agg(F.max("gone").alias("gone"), *said)


def current_state(
    log: DataFrame,
    origin: str = "origin",
    epoch: str = "epoch",
    seq: str = "seq",
    key: str = "key",
    tombstone: str = "tombstone",
    record: str = "record",
    withdrawing: tuple[str, ...] = WITHDRAWING,
    complete: DataFrame | str | None = "read",
    payload: bool = False,
) -> DataFrame:
    """(origin, epoch, seq, key[, record]): the entries that stand once the feed is applied.

    State is exposed up to the committed watermark of each origin; `complete` closes gaps as
    in `watermarks`. Rows whose origin or key is null or blank, or whose epoch or seq is null
    or not positive, are refused. Per (origin, key) of the newest epoch the largest seq decides.
    A null tombstone is decided by the kind of the record; a record that is null or no
    JSON withdraws nothing. If deliveries of one sequence disagree, the withdrawal wins;
    of differing records the greatest text stays. An empty log gives no rows; other
    columns are ignored.
    """
    rows = assembled(log, origin, epoch, seq, key, tombstone, record, withdrawing, payload)
    # only the newest epoch of an origin has a watermark; there is one row for each origin
    marks = written(watermarks(log, origin, epoch, seq, key, complete).select("origin", "epoch", "watermark"), "watermarks")
    if marks.limit(SENT + 1).count() <= SENT:
        marks = F.broadcast(marks)
    rows = rows.join(marks, ["origin", "epoch"]).where("seq <= watermark").drop("watermark")
    # longs only: the aggregate stays in hash maps and combines before the shuffle
    folded = rows.groupBy("origin", "key", "epoch").agg(
        F.max(F.when(~F.col("gone"), F.col("seq"))).alias("seq"),
        F.max(F.when(F.col("gone"), F.col("seq"))).alias("gone_seq"),
        *([F.max(F.when(~F.col("gone"), F.struct("seq", "record"))).getField("record").alias("record")] if payload else []),
    )
    standing = folded.where(F.col("seq") > F.coalesce("gone_seq", F.lit(0)))
    out = ["origin", "epoch", "seq", "key", *(["record"] if payload else [])]
    return standing.select(*out)
