"""Sums over links and pairs: total time, gap, objectives, balances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arterial.functions import cost as C


def _link() -> tuple[Column, Column, Column]:
    return F.col("t0"), F.col("x"), F.col("capacity")


def with_cost(flow: DataFrame) -> DataFrame:
    return flow.withColumn("cost", C.bpr(*_link()))


def total_time(flow: DataFrame) -> DataFrame:
    """scenario_id, tstt."""
    return flow.groupBy("scenario_id").agg(F.sum(C.total_time_term(*_link())).alias("tstt"))


def beckmann(flow: DataFrame) -> DataFrame:
    return flow.groupBy("scenario_id").agg(F.sum(C.beckmann_term(*_link())).alias("beckmann"))


def skim(od: DataFrame, spt: DataFrame) -> DataFrame:
    """Demand with the distance of each reachable pair."""
    return od.join(spt.withColumnRenamed("node", "d"), ["scenario_id", "o", "d"]).select("scenario_id", "o", "d", "demand", "dist")


def shortest_total(od: DataFrame, spt: DataFrame) -> DataFrame:
    """scenario_id, sptt."""
    return skim(od.filter("demand > 0"), spt).groupBy("scenario_id").agg(F.sum(F.col("demand") * F.col("dist")).alias("sptt"))


def relative_gap(flow: DataFrame, od: DataFrame, spt: DataFrame) -> DataFrame:
    """scenario_id, tstt, sptt, gap; gap 0 where nothing travels."""
    both = total_time(flow).join(shortest_total(od, spt), "scenario_id", "left").fillna(0.0, ["sptt"])
    return both.withColumn("gap", F.when(F.col("tstt") > 0, 1 - F.col("sptt") / F.col("tstt")).otherwise(F.lit(0.0)))


def efficiency(flow: DataFrame) -> DataFrame:
    """Mean of x t0 / t over links."""
    each = F.col("x") * F.col("t0") / C.bpr(*_link())
    return flow.groupBy("scenario_id").agg((F.sum(each) / F.count(F.lit(1))).alias("efficiency"))


def congested_pairs(times: DataFrame, reference: DataFrame, ratio: float = 3.0) -> DataFrame:
    """Pairs whose time is more than ratio times the reference time."""
    ref = reference.select("scenario_id", "o", "d", F.col("dist").alias("ref"))
    return times.join(ref, ["scenario_id", "o", "d"]).filter(F.col("dist") > ratio * F.col("ref"))


def net_supply(od: DataFrame) -> DataFrame:
    """scenario_id, o, node, g: what each origin's commodity leaves at a node."""
    signed = F.explode(F.array(F.struct(F.col("o").alias("node"), F.col("demand").alias("g")), F.struct(F.col("d").alias("node"), (-F.col("demand")).alias("g"))))
    rows = od.filter("demand > 0").select("scenario_id", "o", signed.alias("s"))
    return rows.groupBy("scenario_id", "o", "s.node").agg(F.sum("s.g").alias("g"))


def imbalance(oflow: DataFrame) -> DataFrame:
    """scenario_id, o, node, out_minus_in of flows by origin, in one pass."""
    signed = F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("x").alias("s")), F.struct(F.col("v").alias("node"), (-F.col("x")).alias("s"))))
    return oflow.select("scenario_id", "o", signed.alias("e")).groupBy("scenario_id", "o", "e.node").agg(F.sum("e.s").alias("out_minus_in"))


def primal_residual(oflow: DataFrame, od: DataFrame) -> DataFrame:
    both = imbalance(oflow).join(net_supply(od), ["scenario_id", "o", "node"], "full").fillna(0.0, ["out_minus_in", "g"])
    return both.withColumn("residual", F.col("out_minus_in") - F.col("g"))


def link_prices(arcs: DataFrame, values: DataFrame) -> DataFrame:
    """scenario_id, o, arc_id, at_tail, at_head, difference of a value by
    origin and node (scenario_id, o, node, value), 0 where there is none."""
    side = lambda end, name: values.select("scenario_id", "o", F.col("node").alias(end), F.col("value").alias(name))
    each = arcs.select("scenario_id", "arc_id", "u", "v").join(values.select("scenario_id", "o").distinct(), "scenario_id")
    both = each.join(side("u", "at_tail"), ["scenario_id", "o", "u"], "left").join(side("v", "at_head"), ["scenario_id", "o", "v"], "left").fillna(0.0, ["at_tail", "at_head"])
    return both.select("scenario_id", "o", "arc_id", "at_tail", "at_head", (F.col("at_tail") - F.col("at_head")).alias("difference"))


def at_least(od: DataFrame, least: float = 1.0) -> DataFrame:
    """Demand without the pairs under ``least``, and without pairs o = d."""
    return od.filter((F.col("demand") >= least) & (F.col("o") != F.col("d")))


def half_squared_error(flow: DataFrame, observed: DataFrame) -> DataFrame:
    """Half the squared distance to observed flows, by link."""
    both = flow.join(observed, "arc_id")
    return both.groupBy("scenario_id").agg((F.sum(F.pow(F.col("x_hat") - F.col("x"), 2)) / 2).alias("half_sse"))


def demand_entropy(od: DataFrame) -> DataFrame:
    return od.groupBy("scenario_id").agg(F.sum(C.entropy_term(F.col("demand"))).alias("entropy"))


def estimation_objective(od: DataFrame, flow: DataFrame, observed: DataFrame, weight: float) -> DataFrame:
    """entropy + weight * half_sse."""
    both = demand_entropy(od).join(half_squared_error(flow, observed), "scenario_id")
    return both.withColumn("objective", F.col("entropy") + weight * F.col("half_sse"))


def gradient_norm(frame: DataFrame, column: str) -> DataFrame:
    return frame.groupBy("scenario_id").agg(F.sqrt(F.sum(F.pow(column, 2))).alias("norm"))


def largest_change(old: DataFrame, new: DataFrame) -> DataFrame:
    """Largest relative change of any link's flow."""
    both = old.select("scenario_id", "arc_id", F.col("x").alias("a")).join(new.select("scenario_id", "arc_id", F.col("x").alias("b")), ["scenario_id", "arc_id"])
    return both.groupBy("scenario_id").agg(F.max(C.relative_change(F.col("a"), F.col("b"))).alias("change"))


def line_search(flow: DataFrame, direction: DataFrame, shrink: float = 0.9, slope: float = 0.2, trials: int = 175) -> DataFrame:
    """Armijo's rule in one pass: the first step shrink^k that lowers the
    Beckmann objective enough. Every link meets all trial steps in its own row;
    one aggregation gives all objectives."""
    step = F.pow(F.lit(shrink), F.col("k").cast("double"))
    pair = flow.join(direction.select("scenario_id", "arc_id", F.col("x").alias("y")), ["scenario_id", "arc_id"])
    tried = pair.select("*", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("k")).withColumn("s", step)
    moved = F.col("x") + F.col("s") * (F.col("y") - F.col("x"))
    sums = tried.groupBy("scenario_id", "k").agg(
        F.first("s").alias("step"),
        F.sum(C.beckmann_term(F.col("t0"), moved, F.col("capacity"))).alias("objective"),
        F.sum(C.beckmann_term(*_link())).alias("before"),
        F.sum(C.bpr(*_link()) * (F.col("y") - F.col("x"))).alias("slope"),
    )
    good = sums.filter(F.col("objective") <= F.col("before") + slope * F.col("step") * F.col("slope"))
    return good.groupBy("scenario_id").agg(F.max_by(F.struct("k", "step", "objective"), "step").alias("s")).select("scenario_id", "s.k", "s.step", "s.objective")
