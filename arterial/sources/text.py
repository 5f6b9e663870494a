"""Readers of network, demand, flow and log files: blank-separated columns,
no header, blank lines and # comments skipped. An empty file gives no rows; a
cell that is absent or does not parse raises, naming its row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NETWORK = "u int, v int, capacity double, t0 double"
DEMAND = "o int, d int, demand double"
LOG = "iter int, gap double, rel_change double, seconds double"


def _rows(spark: SparkSession, path: str) -> DataFrame:
    """file, block (where its split begins), at and cells of the rows that are
    neither blank nor comments. Files are read in splits of any number."""
    read = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    bare = F.trim(F.regexp_replace(F.regexp_replace("value", r"#.*", ""), r"[\t\r]+", " "))
    return read.select("file", "block", "at", bare.alias("row")).filter("row != ''").select("file", "block", "at", F.split("row", r"\s+").alias("cells"))


def numbered_rows(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 0, over rows that are neither blank nor comments) and
    cells. Lines are counted in each split; the splits' counts tell where a
    split's lines begin, so no file is read by one task."""
    rows = _rows(spark, path)
    inside = F.row_number().over(Window.partitionBy("file", "block").orderBy("at")) - 1
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = rows.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n")).select("file", "block", F.coalesce(before, F.lit(0)).alias("begin"))
    return rows.withColumn("inside", inside).join(starts, ["file", "block"]).select("file", (F.col("inside") + F.col("begin")).cast("int").alias("line"), "cells")


def _typed(rows: DataFrame, schema: str, *more: str) -> DataFrame:
    """Columns of the cells; a cell that is absent or does not parse raises."""
    out = []
    for i, (name, kind) in enumerate(c.strip().split(" ") for c in schema.split(",")):
        value = F.get("cells", F.lit(i)).try_cast(kind)
        wrong = F.raise_error(F.concat(F.lit(f"column {name} does not parse in: "), F.array_join("cells", " ")))
        out.append(F.when(value.isNotNull(), value).otherwise(wrong.cast(kind)).alias(name))
    return rows.select(*more, *out)


def read_network(spark: SparkSession, path: str, scenario_id: str = "0", last_wins: bool = False) -> DataFrame:
    """Links with arc_id = line number. Parallel links stay, unless last_wins."""
    rows = _typed(numbered_rows(spark, path), NETWORK, "line")
    if last_wins:
        latest = F.row_number().over(Window.partitionBy("u", "v").orderBy(F.desc("line")))
        rows = rows.withColumn("_n", latest).filter("_n = 1").drop("_n")
    return rows.select(F.lit(scenario_id).alias("scenario_id"), F.col("line").alias("arc_id"), "u", "v", "capacity", "t0")


def read_seven_columns(spark: SparkSession, path: str, scenario_id: str = "0") -> DataFrame:
    """Links from rows ``id u v 1 capacity 1 t0``."""
    rows = _typed(_rows(spark, path), "id int, u int, v int, k1 int, capacity double, k2 int, t0 double")
    return rows.select(F.lit(scenario_id).alias("scenario_id"), (F.col("id") - 1).alias("arc_id"), "u", "v", "capacity", "t0")


def with_free_flow(arcs: DataFrame) -> DataFrame:
    """Links with flow 0 and cost t0."""
    return arcs.withColumns({"x": F.lit(0.0), "cost": F.col("t0")})


def read_demand(spark: SparkSession, path: str, scenario_id: str = "0", last_wins: bool = False) -> DataFrame:
    """Demand by pair; rows of one pair add up, or the last one counts."""
    pair = [F.lit(scenario_id).alias("scenario_id"), "o", "d"]
    if last_wins:
        rows = _typed(numbered_rows(spark, path), DEMAND, "file", "line")
        return rows.groupBy("o", "d").agg(F.max_by("demand", F.struct("file", "line")).alias("demand")).select(*pair, "demand")
    return _typed(_rows(spark, path), DEMAND).groupBy("o", "d").agg(F.sum("demand").alias("demand")).select(*pair, "demand")


def read_scenarios(spark: SparkSession, pattern: str, name: str = r"OD_(\d+)\.txt$") -> DataFrame:
    """Demand of many files; the scenario is taken from the file's name."""
    rows = _typed(_rows(spark, pattern), DEMAND, "file")
    rows = rows.withColumn("scenario_id", F.regexp_extract("file", name, 1))
    return rows.groupBy("scenario_id", "o", "d").agg(F.sum("demand").alias("demand"))


def read_observed_flow(spark: SparkSession, path: str) -> DataFrame:
    """arc_id and the first column of each line."""
    return _typed(numbered_rows(spark, path), "x_hat double", "line").withColumnRenamed("line", "arc_id")


def read_matrix(spark: SparkSession, path: str, columns: int) -> DataFrame:
    return _typed(numbered_rows(spark, path), ", ".join(f"c{i} double" for i in range(columns)), "line")


def read_log(spark: SparkSession, pattern: str, name: str = r"_(\d+)\.txt$") -> DataFrame:
    rows = _typed(_rows(spark, pattern), LOG, "file")
    return rows.select(F.regexp_extract("file", name, 1).alias("run_id"), "iter", "gap", "rel_change", "seconds")


def count_rows(spark: SparkSession, path: str) -> int:
    """Lines that hold anything but blanks."""
    return spark.read.text(path).filter(F.trim("value") != "").count()


def count_files(spark: SparkSession, path: str) -> int:
    return spark.read.format("binaryFile").load(path).select("path").count()


def nested_demand(od: DataFrame) -> DataFrame:
    """One row per origin with its (d, demand) pairs in order of d."""
    pairs = F.array_sort(F.collect_list(F.struct("d", "demand")))
    return od.groupBy("scenario_id", "o").agg(pairs.alias("targets"))
