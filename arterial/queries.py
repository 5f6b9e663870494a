"""Registered queries of the assignment operators, over a network derived from
the driver's whole tables: links between nations by part number, demand by
order number, all pairs of different ends. Capacity is a twentieth of the
summed quantity, so that links congest.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arterial import grid
from arterial.functions import cost as C
from arterial.operators import generate, graph, logs, metrics
from arterial.plans import scenarios, solvers
from arterial.plans.lineage import materialize, shared_dir
from arterial.sources import sinks, text

SHRINK = 20.0


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 600 links whatever the tables' size: quantities are summed
    before anything is numbered."""
    items = _table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_partkey") % 25).cast("int").alias("v"), "l_quantity")
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    buyers = _table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("u"))
    sold = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(buyers, F.col("o_custkey") == F.col("c_custkey"))
    arcs = sold.filter("u != v").groupBy("u", "v").agg(F.sum("l_quantity").alias("q"), F.count(F.lit(1)).alias("n"))
    number = F.row_number().over(Window.orderBy("u", "v")) - 1
    return arcs.select(F.lit("0").alias("scenario_id"), number.alias("arc_id"), "u", "v", (F.col("q") / SHRINK).alias("capacity"), (1 + F.col("n") % 7).cast("double").alias("t0"))


def demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").select("o_custkey", (F.col("o_orderkey") % 25).cast("int").alias("d"))
    buyers = _table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("o"))
    pairs = orders.join(buyers, F.col("o_custkey") == F.col("c_custkey")).filter("o != d")
    return pairs.groupBy("o", "d").agg(F.count(F.lit(1)).cast("double").alias("demand")).select(F.lit("0").alias("scenario_id"), "o", "d", "demand")


def loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links with made-up flows between half and two and a half capacities."""
    return links(spark, sf_dir).withColumn("x", F.col("capacity") * (1 + F.col("arc_id") % 5) / 2)


def _parts(spark: SparkSession, sf_dir: str, cost: str = "t0"):
    arcs, od = materialize(links(spark, sf_dir), "links"), materialize(demand(spark, sf_dir), "demand")
    return arcs, od, graph.shortest_paths(arcs, graph.origins(od), cost)


def _aon(spark: SparkSession, sf_dir: str):
    arcs, od, spt = _parts(spark, sf_dir)
    oflow = materialize(graph.tree_flows(od, spt, arcs), "oflow")
    flow = materialize(metrics.with_cost(graph.arc_flows(arcs, oflow)), "flow")
    return arcs, od, spt, oflow, flow


def _r(column: str | Column, digits: int = 6) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, digits)


def arc_scan(spark, sf):
    return links(spark, sf).select("arc_id", "u", "v", _r("capacity").alias("capacity"), "t0")


def od_scan(spark, sf):
    return demand(spark, sf).select("o", "d", "demand")


def od_nested(spark, sf):
    n = text.nested_demand(demand(spark, sf))
    return n.select("o", F.size("targets").alias("n_targets"), F.aggregate("targets", F.lit(0.0), lambda a, t: a + t["demand"]).alias("total"), F.array_join(F.transform("targets", lambda t: t["d"].cast("string")), ",").alias("ds"))


def _by_link(value: Callable[..., Column], name: str):
    def query(spark, sf):
        return loaded(spark, sf).select("arc_id", _r(value(F.col("t0"), F.col("x"), F.col("capacity")), 9).alias(name))

    return query


def node_set(spark, sf):
    return graph.nodes(links(spark, sf)).select("node")


def node_degree(spark, sf):
    return graph.degrees(links(spark, sf)).select("node", "n_out", "n_in")


def max_node(spark, sf):
    return graph.max_node(links(spark, sf)).select("max_node")


def distinct_origins(spark, sf):
    return graph.origins(demand(spark, sf)).select("o")


def parallel_arcs(spark, sf):
    arcs = links(spark, sf)
    return graph.parallel_arcs(arcs.unionByName(arcs.withColumn("arc_id", F.col("arc_id") + 600))).select("u", "v", "n")


def sssp_freeflow(spark, sf):
    _, _, spt = _parts(spark, sf)
    return spt.select("o", "node", "dist", F.coalesce("pred_arc", F.lit(-1)).alias("pred_arc"))


def reverse_reachability(spark, sf):
    arcs = materialize(links(spark, sf), "links")
    return graph.reaching(arcs, graph.nodes(arcs).withColumnRenamed("node", "target")).select("target", "node")


def od_skim(spark, sf):
    _, od, spt = _parts(spark, sf)
    return metrics.skim(od, spt).select("o", "d", "demand", "dist")


def sptt(spark, sf):
    _, od, spt = _parts(spark, sf)
    return metrics.shortest_total(od, spt).select(_r("sptt").alias("sptt"))


def tstt(spark, sf):
    return metrics.total_time(loaded(spark, sf)).select(_r("tstt", 4).alias("tstt"))


def aon_flow(spark, sf):
    *_, flow = _aon(spark, sf)
    return flow.select("arc_id", _r("x").alias("x"), _r("cost").alias("cost"))


def path_links(spark, sf):
    arcs, od, spt = _parts(spark, sf)
    return graph.walks(od, spt, arcs).select("o", "d", "arc_id", "step", "demand")


def relative_gap(spark, sf):
    _, od, _, _, flow = _aon(spark, sf)
    spt = graph.shortest_paths(flow, graph.origins(od), "cost")
    return metrics.relative_gap(flow, od, spt).select(_r("tstt", 4).alias("tstt"), _r("sptt", 4).alias("sptt"), _r("gap", 8).alias("gap"))


def reduced_cost(spark, sf):
    arcs, _, spt = _parts(spark, sf)
    return graph.reduced_costs(arcs, spt, "t0").select("o", "arc_id", _r("reduced").alias("reduced"))


def disequilibrated_arcs(spark, sf):
    _, _, spt, oflow, flow = _aon(spark, sf)
    return graph.disequilibrated(flow, oflow, spt).select("o", "arc_id", _r("x").alias("x"), _r("reduced").alias("reduced"))


def semi_reachable_od(spark, sf):
    arcs, od = materialize(links(spark, sf), "links"), demand(spark, sf)
    spt = graph.shortest_paths(arcs, graph.origins(od))
    return od.join(spt.select("scenario_id", "o", F.col("node").alias("d")), ["scenario_id", "o", "d"], "left_semi").select("o", "d", "demand")


def anti_new_arcs(spark, sf):
    arcs, _, spt, oflow, _ = _aon(spark, sf)
    return graph.new_bush_arcs(arcs, spt, graph.pruned_bush(oflow, spt)).select("o", "arc_id")


def bush_union(spark, sf):
    arcs, _, spt, oflow, _ = _aon(spark, sf)
    return graph.improved_bush(arcs, spt, graph.pruned_bush(oflow, spt)).select("o", "arc_id")


def net_supply(spark, sf):
    return metrics.net_supply(demand(spark, sf)).select("o", "node", "g")


def node_imbalance(spark, sf):
    arcs, _, _, oflow, _ = _aon(spark, sf)
    return metrics.imbalance(oflow.join(arcs, ["scenario_id", "arc_id"])).select("o", "node", _r("out_minus_in").alias("out_minus_in"))


def primal_residual(spark, sf):
    arcs, od, _, oflow, _ = _aon(spark, sf)
    half = oflow.join(arcs, ["scenario_id", "arc_id"]).withColumn("x", F.col("x") / 2)
    return metrics.primal_residual(half, od).select("o", "node", _r("residual").alias("residual"))


def _spread(spark, sf):
    """Made-up flows by origin on all links."""
    arcs = links(spark, sf)
    return arcs, arcs.withColumn("o", F.explode(F.array(*map(F.lit, range(4))))).select("scenario_id", "o", "arc_id", ((F.col("arc_id") * 7 + F.col("o") * 3) % 11).cast("double").alias("x"))


def split_fraction(spark, sf):
    return graph.split_fractions(*_spread(spark, sf)).select("o", "arc_id", _r("fraction").alias("fraction"))


def argmax_pred(spark, sf):
    return graph.busiest_predecessor(*_spread(spark, sf)).select("o", "v", "arc_id")


def conflict_pairs(spark, sf):
    return graph.conflicts(links(spark, sf)).select("a", "b")


def _pas(spark, sf):
    ids = lambda *ks: F.array(*((F.col("arc_id") + k) % 100 for k in ks))
    return links(spark, sf).select("scenario_id", F.col("arc_id").alias("pas_id"), (F.col("arc_id") % 4).alias("o"), ids(3, 1).alias("s1"), ids(2, 7, 5).alias("s2"))


def pas_key(spark, sf):
    return graph.pas_keys(_pas(spark, sf)).select("pas_id", "pas_key")


def pas_dedup(spark, sf):
    slow = links(spark, sf).filter("t0 >= 7").select("scenario_id", F.col("arc_id").alias("pas_id"))
    known = graph.pas_keys(_pas(spark, sf).join(slow, ["scenario_id", "pas_id"], "left_semi"))
    return graph.new_pas(_pas(spark, sf), known).select("pas_key")


def path_cost_bottleneck(spark, sf):
    pas = _pas(spark, sf)
    sides = pas.select("scenario_id", "pas_id", "o", F.explode(F.array(F.struct(F.lit(1).alias("side"), F.col("s1").alias("path")), F.struct(F.lit(2).alias("side"), F.col("s2").alias("path")))).alias("s")).select("scenario_id", "pas_id", "o", "s.side", "s.path")
    out = graph.segment_sums(sides, loaded(spark, sf), _spread(spark, sf)[1])
    return out.select("pas_id", "side", _r("cost").alias("cost"), _r("slope").alias("slope"), "bottleneck")


def armijo_one_pass(spark, sf):
    flow = loaded(spark, sf)
    toward = flow.withColumn("x", F.col("capacity") / 2)
    return metrics.line_search(flow, toward).select("k", _r("step").alias("step"), _r("objective", 4).alias("objective"))


def largest_change(spark, sf):
    flow = loaded(spark, sf)
    return metrics.largest_change(flow, flow.withColumn("x", F.col("x") + F.col("arc_id"))).select(_r("change").alias("change"))


def efficiency(spark, sf):
    return metrics.efficiency(loaded(spark, sf)).select(_r("efficiency").alias("efficiency"))


def congested_od(spark, sf):
    arcs, od, spt = _parts(spark, sf)
    slow = graph.shortest_paths(arcs.withColumn("cost", F.col("t0") * (1 + F.col("arc_id") % 6)), graph.origins(od), "cost")
    return metrics.congested_pairs(metrics.skim(od, slow), metrics.skim(od, spt), 3.0).select("o", "d", "dist", "ref")


def patience(spark, sf):
    log = links(spark, sf).select("scenario_id", F.col("arc_id").alias("step"), (F.col("t0") / 7).alias("congested"))
    return scenarios.patience(log, 0.7).select("step", "hits")


def entropy(spark, sf):
    return metrics.demand_entropy(demand(spark, sf)).select(_r("entropy").alias("entropy"))


def _observed(spark, sf):
    return links(spark, sf).select("arc_id", F.col("capacity").alias("x_hat"))


def half_sse(spark, sf):
    return metrics.half_squared_error(loaded(spark, sf), _observed(spark, sf)).select(_r("half_sse", 4).alias("half_sse"))


def ode_objective(spark, sf):
    out = metrics.estimation_objective(demand(spark, sf), loaded(spark, sf), _observed(spark, sf), 0.5)
    return out.select(_r("objective", 4).alias("objective"))


def small_volumes(spark, sf):
    return metrics.at_least(demand(spark, sf), 20.0).select("o", "d", "demand")


def volume_spacings(spark, sf):
    cuts = links(spark, sf).select(F.col("u").cast("string").alias("scenario_id"), F.col("arc_id").cast("double").alias("cut"))
    return generate.spacings(cuts, 1000.0).select("scenario_id", "cut", "part")


def _log(spark, sf):
    return links(spark, sf).select(F.col("u").alias("run_id"), F.col("v").alias("iter"), (1 / (1 + F.col("v") + F.col("u"))).alias("gap"), F.col("t0").alias("seconds"))


def gap_lag(spark, sf):
    return logs.with_change(_log(spark, sf)).select("run_id", "iter", _r("change").alias("change"))


def first_passage(spark, sf):
    return logs.first_passage(_log(spark, sf), [0.1, 0.05]).select("run_id", "level", "iter", "seconds")


def _solver(method: str, system: bool = False, **options):
    def query(spark, sf):
        out = solvers.assign(links(spark, sf), demand(spark, sf), method, system, **options)
        return out.select("arc_id", "u", "v", "capacity", "t0", "x", "cost", (F.col("x") / F.col("capacity")).alias("load"))

    return query


def fw_relational(spark, sf):
    arcs, od = materialize(links(spark, sf), "links"), materialize(demand(spark, sf), "demand")
    return solvers.frank_wolfe_relational(arcs, od).select("arc_id", "x", "cost")


def ue_log(spark, sf):
    return solvers.convergence(links(spark, sf), demand(spark, sf), "pas", target=1e-8)


def oflow_by_pas(spark, sf):
    return solvers.assign_by_origin(links(spark, sf), demand(spark, sf), "pas", target=1e-8).select("o", "arc_id", "x")


def warm_start(spark, sf):
    """Equilibrium from the flows by origin of a looser one, objective only."""
    arcs, od = materialize(links(spark, sf), "links"), materialize(demand(spark, sf), "demand")
    loose = materialize(solvers.assign_by_origin(arcs, od, "bush", target=1e-2), "loose")
    return solvers.assign(arcs, od, "bush", start=loose, target=1e-6).select("arc_id", "x", "cost")


def percolation(spark, sf):
    """Demand is raised by 20 a pair and step, as fits the tables' counts of
    orders; the run ends by its own rules."""
    return scenarios.percolation(links(spark, sf), demand(spark, sf), growth=20.0, target=1e-3)


def od_estimation(spark, sf):
    return scenarios.estimate_demand(links(spark, sf), demand(spark, sf), _observed(spark, sf), weight=1e-3, target=1e-4).select("o", "d", "demand")


def edge_coloring(spark, sf):
    return solvers.edge_colours(links(spark, sf)).select("arc_id", F.col("colour").alias("color"))


def topo_order(spark, sf):
    """Levels of the nodes in each origin's free-flow tree."""
    arcs, _, spt = _parts(spark, sf)
    return graph.levels(spt, arcs).select("o", "node", "level")


def random_od(spark, sf):
    out = generate.random_demand(spark, 100, 10, 300.0, 1000, seed=1)
    return out.groupBy("scenario_id").agg(F.countDistinct("o", "d").alias("pairs"), _r(F.sum("demand")).alias("total"), F.min("demand").alias("least")).select("scenario_id", "pairs", "total", (F.col("least") > 0).alias("positive"))


def known_equilibria(spark, sf):
    """Total time and objective by all methods on the network whose equilibria
    are known: to a tenth by the exact ones, to hundreds by the others."""
    arcs = spark.createDataFrame([r for q in grid.EQUILIBRIA for r in grid.links(f"{q:g}")], grid.LINKS)
    od = spark.createDataFrame([r for q in grid.EQUILIBRIA for r in grid.pairs(q, f"{q:g}")], grid.PAIRS)
    parts = []
    for method, system, target, digits in (("pas", False, 1e-11, 1), ("bush", False, 1e-11, 1), ("pas", True, 1e-11, 1), ("bush", True, 1e-11, 1), ("fw", False, 1e-5, -2), ("admm", False, 1e-7, -2)):
        out = solvers.assign(arcs, od, method, system, target=target)
        both = metrics.total_time(out).join(metrics.beckmann(out), "scenario_id")
        parts.append(both.select("scenario_id", F.lit(method).alias("method"), F.lit(system).alias("system"), _r("tstt", digits).alias("tstt"), _r("beckmann", digits).alias("beckmann")))
    return functools.reduce(DataFrame.unionByName, parts)


def _folder(spark, name):
    return f"{shared_dir(spark)}/arterial/{name}-{uuid.uuid4().hex}"


def network_round_trip(spark, sf):
    """Links written as a network file and read back."""
    path = _folder(spark, "network")
    sinks.write_network(links(spark, sf), path)
    return text.read_network(spark, path).select("arc_id", "u", "v", _r("capacity").alias("capacity"), "t0")


def demand_round_trip(spark, sf):
    """Demand written by scenario and read back, file by file."""
    path = _folder(spark, "demand")
    sinks.write_demand(demand(spark, sf), path)
    return text.read_scenarios(spark, f"{path}/*", r"scenario_id=([^/]*)/").select("scenario_id", "o", "d", "demand")


def flow_round_trip(spark, sf):
    """Flows written by link and read back as a matrix of three columns."""
    path = _folder(spark, "flow")
    sinks.write_flow(loaded(spark, sf), path)
    return text.read_matrix(spark, path, 3).select(F.col("c0").cast("int").alias("u"), F.col("c1").cast("int").alias("v"), _r("c2").alias("x"))


def log_round_trip(spark, sf):
    """Convergence logs written by run and read back."""
    path = _folder(spark, "log")
    sinks.write_log(logs.with_change(_log(spark, sf)).withColumnRenamed("change", "rel_change"), path)
    return text.read_log(spark, f"{path}/*", r"run_id=([^/]*)/").select("run_id", "iter", _r("gap").alias("gap"), _r("rel_change").alias("rel_change"), "seconds")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    plain = (
        arc_scan, od_scan, od_nested, node_set, node_degree, max_node, distinct_origins, parallel_arcs, sssp_freeflow, reverse_reachability,
        od_skim, sptt, tstt, aon_flow, path_links, relative_gap, reduced_cost, disequilibrated_arcs, semi_reachable_od, anti_new_arcs, bush_union,
        net_supply, node_imbalance, primal_residual, split_fraction, argmax_pred, conflict_pairs, pas_key, pas_dedup, path_cost_bottleneck,
        armijo_one_pass, largest_change, efficiency, congested_od, patience, entropy, half_sse, ode_objective, small_volumes, volume_spacings,
        gap_lag, first_passage, fw_relational, ue_log, oflow_by_pas, percolation, od_estimation, edge_coloring, topo_order, random_od,
        warm_start, known_equilibria, network_round_trip, demand_round_trip, flow_round_trip, log_round_trip,
    )
    out = {f.__name__: f for f in plain}
    out |= {
        "bpr_cost": _by_link(C.bpr, "cost"),
        "bpr_derivative": _by_link(C.bpr_derivative, "slope"),
        "marginal_cost": _by_link(C.marginal_cost, "cost"),
        "beckmann_terms": _by_link(C.beckmann_term, "term"),
        "ue_pas": _solver("pas", target=1e-8),
        "ue_bush": _solver("bush", target=1e-6),
        "ue_fw": _solver("fw", target=1e-3),
        "so_fw": _solver("fw", system=True, target=1e-3),
        "ue_admm": _solver("admm", target=1e-3, rho=None),
    }
    return out
