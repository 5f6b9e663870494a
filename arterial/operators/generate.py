"""Random demand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def spacings(cuts: DataFrame, total: float) -> DataFrame:
    """cuts (scenario_id, cut in 0..total, distinct) with part: how far each
    cut is from the one before, and a last row that closes the total."""
    closed = cuts.select("scenario_id", "cut").unionByName(cuts.select("scenario_id", F.lit(total).alias("cut")).distinct())
    order = Window.partitionBy("scenario_id").orderBy("cut")
    return closed.withColumn("part", F.col("cut") - F.lag("cut", 1, 0.0).over(order))


def random_demand(spark: SparkSession, scenarios: int, pairs: int, total: float, labels: int, seed: int = 0) -> DataFrame:
    """``pairs`` distinct pairs o != d of labels 1.. in each scenario, whose
    demands are the spacings of uniform cuts of ``total``. Candidate pairs are
    numbered through, so that a random order of numbers without repeats, not
    sampling until success, gives distinct ones."""
    if pairs > labels * (labels - 1):
        raise ValueError("more pairs than there are")
    tries = min(labels * (labels - 1), 4 * pairs + 20)
    uniform = lambda salt: (F.pmod(F.xxhash64("scenario_id", "i", F.lit(seed), F.lit(salt)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    base = spark.range(scenarios).select(F.col("id").cast("string").alias("scenario_id"))
    drawn = base.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))))
    if tries == labels * (labels - 1):  # all pairs, in random order
        number: Column = F.col("i").cast("long")
    else:
        number = F.floor(uniform(1) * (labels * (labels - 1))).cast("long")
    drawn = drawn.withColumns({"pair": number, "r": uniform(2)}).groupBy("scenario_id", "pair").agg(F.min("r").alias("r"))
    ranked = drawn.withColumn("k", F.row_number().over(Window.partitionBy("scenario_id").orderBy("r"))).filter(F.col("k") <= pairs)
    o = F.floor(F.col("pair") / (labels - 1)).cast("int") + 1
    d0 = F.pmod(F.col("pair"), F.lit(labels - 1)).cast("int") + 1
    chosen = ranked.withColumn("o", o).withColumn("d", F.when(d0 >= F.col("o"), d0 + 1).otherwise(d0))
    cuts = base.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(pairs - 1)))) if pairs > 1 else base.limit(0).withColumn("i", F.lit(0))
    parts = spacings(cuts.withColumn("cut", uniform(3) * total).unionByName(base.select("scenario_id", F.lit(0).alias("i"), F.lit(total).alias("cut")).limit(0)), total)
    if pairs == 1:
        parts = base.withColumns({"cut": F.lit(total), "part": F.lit(total)})
    parts = parts.withColumn("k", F.row_number().over(Window.partitionBy("scenario_id").orderBy("cut")))
    return chosen.join(parts, ["scenario_id", "k"]).select("scenario_id", "o", "d", F.col("part").alias("demand"))


def all_distinct(frame: DataFrame, column: str, digits: int = 12) -> DataFrame:
    """scenario_id, distinct: whether a column has no value twice."""
    both = frame.groupBy("scenario_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.round(column, digits)).alias("m"))
    return both.select("scenario_id", (F.col("n") == F.col("m")).alias("distinct"))


def random_matrix(spark: SparkSession, nodes: int, least: int, most: int, seed: int = 0, scenario_id: str = "0") -> DataFrame:
    """Demand from each label 0.. to between 1 and a tenth of the labels, with
    whole volumes from least to most; never to itself. Draws that meet again
    add up, as duplicate rows of demand do."""
    uniform = lambda *salt: (F.pmod(F.xxhash64(*salt, F.lit(seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    below = lambda n, *salt: F.floor(uniform(*salt) * n).cast("int")
    if nodes < 2:
        return spark.createDataFrame([], "scenario_id string, o int, d int, demand double")
    starts = spark.range(nodes).select(F.col("id").cast("int").alias("o"))
    drawn = starts.withColumn("k", F.explode(F.sequence(F.lit(0), below(max(1, nodes // 10), "o", F.lit(1)))))
    ends = below(nodes - 1, "o", "k", F.lit(2))
    rows = drawn.select("o", F.when(ends >= F.col("o"), ends + 1).otherwise(ends).alias("d"), (least + below(most - least + 1, "o", "k", F.lit(3))).cast("double").alias("demand"))
    return rows.groupBy(F.lit(scenario_id).alias("scenario_id"), "o", "d").agg(F.sum("demand").alias("demand"))
