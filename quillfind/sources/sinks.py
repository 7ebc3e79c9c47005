"""Sinks: versioned snapshots, ranking runs and line checkpoints."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm.org.apache.hadoop.fs.Path


def versions(spark: SparkSession, root: str) -> list[int]:
    """Versions that were published, in order."""
    fs, p, _ = _hadoop(spark, root)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".done") and n[:-5].isdigit())


def publish(tables: dict[str, DataFrame], root: str) -> int:
    """Write all tables of a new version, and its mark last: readers see all of a version or nothing of it."""
    spark = next(iter(tables.values())).sparkSession
    version = (versions(spark, root) or [0])[-1] + 1
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(os.path.join(root, f"v={version}", name))
    fs, p, path = _hadoop(spark, os.path.join(root, f"{version}.done"))
    fs.create(p, False).close()
    return version


def prune(spark: SparkSession, root: str, keep: int = 2) -> list[int]:
    """Delete all but the newest versions, the mark of each before its tables; what was deleted."""
    if keep < 1:
        raise ValueError("one version is kept at least")
    old = versions(spark, root)[:-keep]
    for version in old:
        for name in (f"{version}.done", f"v={version}"):
            fs, p, _ = _hadoop(spark, os.path.join(root, name))
            fs.delete(p, True)
    return old


def snapshot(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    """A table of the newest version, or a given one."""
    known = versions(spark, root)
    if not known or version is not None and version not in known:
        raise FileNotFoundError(f"no published version {version or ''} in {root}")
    return spark.read.parquet(os.path.join(root, f"v={version or known[-1]}", name))


def write_run(results: DataFrame, path: str, tag: str = "quillfind") -> None:
    """Rankings as lines `query Q0 document rank score tag`."""
    line = F.concat_ws(" ", F.col("query_id").cast("string"), F.lit("Q0"), F.col("id").cast("string"), F.col("rank").cast("string"), F.format_string("%.6f", F.col("score").cast("double")), F.lit(tag))
    results.select(line.alias("value")).write.mode("overwrite").text(path)


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, id, rank, score) of a run."""
    f = F.split("value", " ")
    return spark.read.text(path).select(f[0].alias("query_id"), f[2].alias("id"), f[3].cast("int").alias("rank"), f[4].cast("double").alias("score"))


def write_lines(rows: DataFrame, path: str) -> None:
    """One JSON object a line."""
    rows.write.mode("overwrite").json(path)
