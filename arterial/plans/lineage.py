"""Cutting lineage by tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Whether Spark deletes a query's shuffle files when it ends, and not only
#: when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only
    where that is unset and everything runs in one process on one machine, as
    in tests, is it a temporary one; a cluster must name its own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = f"file://{tempfile.mkdtemp(prefix='arterial-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def _filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends in files
    that survive the loss of any executor. The files go when the JVM ends, or
    before that by ``discard``; what the write shuffled goes at its end."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/arterial/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path, compression="zstd")
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    fs, where = _filesystem(spark, path)
    fs.deleteOnExit(where)
    back = spark.read.schema(df.schema).parquet(path)
    back._arterial_path = path
    return back


def written(df: DataFrame, label: str) -> DataFrame:
    """df itself, if it is what ``materialize`` gave; else written now."""
    return df if hasattr(df, "_arterial_path") else materialize(df, label)


def discard(*tables: DataFrame | None) -> None:
    """Delete what ``materialize`` wrote, once nothing reads it any more."""
    for df in tables:
        path = getattr(df, "_arterial_path", None)
        if path:
            fs, where = _filesystem(df.sparkSession, path)
            fs.delete(where, True)


def finished(df: DataFrame, label: str, *tables: DataFrame | None) -> DataFrame:
    """df, written, after which the tables that it was made of are deleted."""
    out = materialize(df, label)
    discard(*tables)
    return out
