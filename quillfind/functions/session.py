"""Session settings, the shared folder for cut lineage, and size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Column
from pyspark.sql import functions as F


def build_session(name: str = "quillfind", cpus: str | int = 8, shuffle: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the tests and the benchmark use."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", shuffle)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Where none is configured one is made, on a local master only: other machines couldn't read it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quillfind-")
        spark.conf.set("spark.checkpoint.dir", found)
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a write to the shared folder; survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Tables this process has written, by application.
_WRITTEN: dict[str, list[str]] = {}


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to parquet in the shared folder and read it back: a columnar cut of the lineage. `forget` deletes it."""
    path = os.path.join(shared_dir(df.sparkSession), f"{name}-{uuid.uuid4().hex}")
    _WRITTEN.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def forget(spark: SparkSession) -> int:
    """Delete the tables written so far, once the results that read them have been taken; how many there were."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    return len(paths)


def few(df: DataFrame, most: int = 1 << 28) -> bool:
    """Whether it is a table of at most `most` bytes in at most half as many files as there are cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    files = len(df._jdf.inputFiles()) if size <= most else cores
    return 0 < 2 * files <= cores


def spread(df: DataFrame, most: int = 1 << 28) -> DataFrame:
    """A table of at most `most` bytes in few files, spread over all cores; any other as it is.

    For work on each row that a scan of few files would leave to few tasks.
    """
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if few(df, most) else df


def small(df: DataFrame, limit: int) -> list | None:
    """All rows if there are at most `limit`, else None: the size check before a broadcast."""
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def present(column: Column) -> Column:
    """Neither null nor made of blanks only (any Unicode blank)."""
    return column.isNotNull() & column.rlike(r"(?U)[^\s\p{Zs}\p{Zl}\p{Zp}\p{Cf}]")
