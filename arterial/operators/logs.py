"""Convergence logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_change(log: DataFrame) -> DataFrame:
    """log (run_id, iter, gap) with the gap before and the relative change,
    which is 1 in a run's first row."""
    before = F.lag("gap").over(Window.partitionBy("run_id").orderBy("iter"))
    out = log.withColumn("gap_before", before)
    return out.withColumn("change", F.coalesce(F.try_divide(F.abs(F.col("gap_before") - F.col("gap")), F.col("gap_before")), F.lit(1.0)))


def first_passage(log: DataFrame, levels: list[float]) -> DataFrame:
    """run_id, level, iter at which the gap first is below the level, and the
    seconds until then where the log has them."""
    rows = log.withColumn("level", F.explode(F.array(*(F.lit(x) for x in levels))))
    if "seconds" in log.columns:
        until = Window.partitionBy("run_id").orderBy("iter").rowsBetween(Window.unboundedPreceding, 0)
        rows = log.withColumn("so_far", F.sum("seconds").over(until)).withColumn("level", F.explode(F.array(*(F.lit(x) for x in levels))))
        return rows.filter("gap < level").groupBy("run_id", "level").agg(F.min("iter").alias("iter"), F.min_by("so_far", "iter").alias("seconds"))
    return rows.filter("gap < level").groupBy("run_id", "level").agg(F.min("iter").alias("iter"))


def summary(log: DataFrame) -> DataFrame:
    return log.groupBy("run_id").agg(F.max("iter").alias("iterations"), F.min("gap").alias("least_gap"), F.sum("seconds").alias("seconds"))
