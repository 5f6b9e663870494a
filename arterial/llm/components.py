"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arterial.llm.common import discard, materialize


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """node, component (its smallest node) for every node of edges (a, b).

    Each round hangs every node's larger neighbours, then its smaller ones, on
    the smallest of them, until only stars are left; the distance to the centre
    halves in a round. Minima are aggregated before the shuffle, and a node of
    many edges meets one row in each join, so it can be split. Every round is
    written to the shared folder.
    """

    def hung(pairs: DataFrame, least: DataFrame, onto: list) -> DataFrame:
        # least is written: a join with an aggregate in its own stage is not split
        return pairs.join(least, "a").select(*onto).filter("a != b").distinct()

    def only_stars(pairs: DataFrame) -> bool:
        ends = pairs.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
        ends = ends.unionByName(pairs.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up + down > 1").isEmpty()

    current = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), label)
    while not only_stars(current):
        # every node's neighbours larger than it hang on the least of it and them
        both = current.select("a", "b").unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), label)
        large = materialize(hung(both.filter("b > a"), least, [F.col("b").alias("a"), F.col("m").alias("b")]), label)
        # every node and its smaller neighbours hang on the least of those
        discard(least)
        least = materialize(large.groupBy("a").agg(F.min("b").alias("m")), label)
        small = hung(large, least, [F.col("b").alias("a"), F.col("m").alias("b")]).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        small = materialize(small, label)
        for done in (current, large, least):
            discard(done)
        current = small
    stars = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
