"""The replicated log as a stream: state by micro-batches, and per-origin positions held in state."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillfind.operators.changefeed import WITHDRAWING, _withdraws, accepted
from quillfind.sources import sinks

LOG = "origin string, epoch long, seq long, key string, tombstone boolean, record string, arrived timestamp"


def folded(log: DataFrame) -> DataFrame:
    """(origin, key, epoch, seq, gone_seq): the mergeable state of the log; folding folds again gives the same."""
    rows = accepted(log).select("origin", "key", "epoch", "seq", _withdraws("tombstone", "record", WITHDRAWING).alias("gone"))
    return rows.groupBy("origin", "key", "epoch").agg(F.max(F.when(~F.col("gone"), F.col("seq"))).alias("seq"), F.max(F.when(F.col("gone"), F.col("seq"))).alias("gone_seq"))


def merged(state: DataFrame, more: DataFrame) -> DataFrame:
    return state.unionByName(more).groupBy("origin", "key", "epoch").agg(F.max("seq").alias("seq"), F.max("gone_seq").alias("gone_seq"))


def standing(state: DataFrame) -> DataFrame:
    """(origin, epoch, seq, key) that stand in the newest epoch of each origin."""
    newest = state.groupBy("origin").agg(F.max("epoch").alias("epoch"))
    return state.join(newest, ["origin", "epoch"], "left_semi").where(F.col("seq") > F.coalesce("gone_seq", F.lit(0))).select("origin", "epoch", "seq", "key")


def keep_state(stream: DataFrame, root: str, keep: int = 2):
    """A streaming query that folds every micro-batch into a new published version of the state.

    A version holds the number of the batch that made it; a batch that is delivered again
    after a failure is not folded twice. (Folding twice would change nothing either: the
    state takes maxima.) The newest `keep` versions stay, so a reader of the one before the
    newest isn't cut off.
    """

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        state = folded(batch)
        if sinks.versions(spark, root):
            done = sinks.snapshot(spark, root, "batch").first()[0]
            if done >= number:
                return
            state = merged(sinks.snapshot(spark, root, "state"), state)
        sinks.publish({"state": state, "batch": spark.range(number, number + 1)}, root)
        sinks.prune(spark, root, keep)

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", os.path.join(root, "_progress")).trigger(availableNow=True).start()


def read_stream(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    return spark.readStream.schema(LOG).option("maxFilesPerTrigger", files).parquet(path)


def _usable(rows: pd.DataFrame, origin) -> np.ndarray:
    """Which rows of an origin have a whole identity."""
    named = rows["key"].map(lambda k: isinstance(k, str) and bool(k.strip())).to_numpy(bool)
    return named & (rows["epoch"] > 0).to_numpy(bool) & (rows["seq"] > 0).to_numpy(bool) & (isinstance(origin, str) and bool(origin.strip()))


def applied_stream(stream: DataFrame) -> DataFrame:
    """(origin, applied, skipped, refused) of each micro-batch; the position of an origin is held in state.

    Rows of a micro-batch are taken in order of arrival, epoch and sequence, as arrays: the
    size of a micro-batch is bounded by the source's trigger. An entry at or before the
    position is skipped, so a gap filled later is lost, as the log's protocol has it;
    `committed_stream` holds gaps instead.
    """

    def take(key: tuple, chunks: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat([c[["epoch", "seq", "key", "arrived"]] for c in chunks]).sort_values(["arrived", "epoch", "seq"])
        good = _usable(rows, key[0])
        epoch, seq = (rows[c].to_numpy()[good].astype(np.int64) for c in ("epoch", "seq"))
        at = state.get if state.exists else (0, 0)
        # places in order, so that the highest one so far is a running maximum
        places = np.unique(np.r_[np.array([at], np.int64), np.stack([epoch, seq], 1)], axis=0, return_inverse=True)
        rank = places[1].ravel()
        before = np.maximum.accumulate(rank)[:-1]
        applied = int((rank[1:] > before).sum())
        state.update(tuple(int(x) for x in places[0][rank.max()]))
        yield pd.DataFrame({"origin": [key[0]], "applied": [applied], "skipped": [int(good.sum()) - applied], "refused": [int((~good).sum())]})

    picked = stream.select("origin", "epoch", "seq", "key", "arrived")
    return picked.groupBy("origin").applyInPandasWithState(take, "origin string, applied long, skipped long, refused long", "epoch long, seq long", "append", "NoTimeout")


def committed_stream(stream: DataFrame) -> DataFrame:
    """(origin, epoch, watermark, held) of each micro-batch: sequences beyond a gap are held in state until it is filled.

    State is the watermark of the newest epoch and the ranges of sequences beyond it, so it
    grows with the gaps, not with the entries. Repeats and any order of arrival make no
    difference to the watermark. An older epoch is dropped. held: ranges beyond the watermark.
    """

    def take(key: tuple, chunks: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        epoch, mark, first, last = state.get if state.exists else (0, 0, [], [])
        seen: dict[int, list] = {}
        for rows in chunks:
            good = rows[_usable(rows, key[0])]
            for e, seqs in good.groupby("epoch")["seq"]:
                if e >= epoch:
                    seen.setdefault(int(e), []).append(np.unique(seqs.to_numpy(np.int64)))
        if seen and max(seen) > epoch:
            epoch, mark, first, last = max(seen), 0, [], []
        new = np.unique(np.concatenate(seen.get(epoch, []) or [np.empty(0, np.int64)]))
        begin = np.r_[new[:1], new[1:][np.diff(new) > 1]] if len(new) else new
        end = np.r_[new[:-1][np.diff(new) > 1], new[-1:]] if len(new) else new
        spans = sorted([(0, mark), *zip(first, last), *zip(begin.tolist(), end.tolist())])
        joined = [list(spans[0])]
        for a, b in spans[1:]:
            if a <= joined[-1][1] + 1:
                joined[-1][1] = max(b, joined[-1][1])
            else:
                joined.append([a, b])
        mark = joined[0][1]
        first, last = [int(a) for a, _ in joined[1:]], [int(b) for _, b in joined[1:]]
        state.update((int(epoch), int(mark), first, last))
        yield pd.DataFrame({"origin": [key[0]], "epoch": [epoch], "watermark": [mark], "held": [len(first)]})

    picked = stream.select("origin", "epoch", "seq", "key")
    return picked.groupBy("origin").applyInPandasWithState(
        take, "origin string, epoch long, watermark long, held long", "epoch long, watermark long, first array<long>, last array<long>", "append", "NoTimeout"
    )
