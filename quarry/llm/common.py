"""Helpers shared by the corpus operators."""

from __future__ import annotations

import gc
import re
import tempfile
from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a one-column key table may be broadcast (8 bytes a row); beyond it joins shuffle.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder. Only in local mode (tests) a temporary folder takes its place; a cluster without one is an error."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not re.match(r"local(\[|$)", sc.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quarry-ckpt-"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid4().hex}"


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of ours that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, folder: str | None = None, compression: str | None = None) -> DataFrame:
    """The rows written once as Parquet in the shared folder and read again: smaller than a checkpoint, and columns stay apart."""
    folder = folder or shared_folder(df.sparkSession, "stored")
    df.write.parquet(folder, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of finished steps (it acts on the driver's garbage collection, once Python holds no plan of them)."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting the rows; a larger table keeps the shuffle join."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def renamed(rows: DataFrame, column: str, table: DataFrame, into: str, limit: int = BROADCAST_ROWS, hot: int = 100_000) -> DataFrame:
    """rows with `into` from table(key, value) (one row a key, lineage cut) where `column` is the key; null where none is.

    However many rows share a value of `column`, no task gets them all: a table counted small is broadcast; else the values
    that more than max(hot, a ten-thousandth of the rows) share are at most 10,000, go by broadcast, and the others by a shuffle."""
    table = table.toDF("__key", into)
    key = F.col(column) == F.col("__key")
    if table.limit(limit + 1).count() <= limit:
        return rows.join(F.broadcast(table), key, "left").drop("__key")
    rows = stored(rows)
    counts = rows.groupBy(F.col(column).alias("__hot")).count()
    total = rows.count()
    heavy = cut(counts.where((F.col("count") > max(hot, total // 10_000)) & F.col("__hot").isNotNull()).select("__hot"))
    some = F.broadcast(cut(heavy.join(table, F.col("__key") == F.col("__hot"), "left").select(F.col("__hot").alias("__key"), into)))
    of_heavy = rows.join(some, key).drop("__key")
    others = rows.join(F.broadcast(heavy), F.col(column) == F.col("__hot"), "left_anti")
    return of_heavy.unionByName(others.join(table, key, "left").drop("__key"))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, parts)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows and bytes, as texts can be long, unless the session sets its own. Results do not depend on them."""
    for key, usual, value in (("maxRecordsPerBatch", ("10000", None), "1000"), ("maxBytesPerBatch", ("-1", None), str(16 << 20))):
        key = f"spark.sql.execution.arrow.{key}"
        if spark.conf.get(key, None) in usual:
            spark.conf.set(key, value)
