"""Assignment of demand to links: every scenario by one method.

``assign`` solves scenarios side by side, each in one task, by the sequential
methods of ``kernels``: a scenario's links and demand must fit a worker.
``frank_wolfe_relational`` keeps one network in DataFrames throughout, for
networks that do not fit.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arterial.functions import cost as C
from arterial.operators import graph, kernels, metrics
from arterial.plans.lineage import discard, materialize

FLOWS = "scenario_id string, arc_id int, u int, v int, capacity double, t0 double, x double, cost double"
BY_ORIGIN = "scenario_id string, o int, arc_id int, x double"
LOG = "scenario_id string, algorithm string, iter int, gap double, rel_change double, seconds double"


def network_of(arcs: pd.DataFrame, od: pd.DataFrame, **options) -> kernels.Network:
    return kernels.Network.of(*(arcs[c].to_numpy() for c in ("u", "v", "capacity", "t0")), *(od[c].to_numpy() for c in ("o", "d", "demand")), **options)


def _solved(arcs: pd.DataFrame, od: pd.DataFrame, method: str, system: bool, skip: bool, options: dict):
    arcs = arcs.sort_values("arc_id").reset_index(drop=True)
    start = None
    if "start_arc" in od:
        start, od = od[od["start_arc"].notna()], od[od["start_arc"].isna()]
    net = network_of(arcs, od, system=system, skip=skip)
    if start is not None and len(start):
        place, link = {int(n): i for i, n in enumerate(net.labels)}, {int(a): i for i, a in enumerate(arcs["arc_id"])}
        flows: kernels.Flows = {}
        for o, a, x in zip(start["o"], start["start_arc"], start["demand"]):
            if int(o) in place and int(a) in link:
                flows.setdefault(place[int(o)], np.zeros(len(arcs)))[link[int(a)]] += x
        options = {**options, "start": kernels.continued(net, flows)}
    return arcs, net, *kernels.METHODS[method](net, **options)


def _grouped(arcs: DataFrame, od: DataFrame, run: Callable, schema: str) -> DataFrame:
    """A scenario's links and demand by one call; without links it gives no rows."""
    columns = [c.split()[0] for c in schema.split(", ")]

    def guarded(a: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        return run(a, q) if len(a) else pd.DataFrame(columns=columns)

    return arcs.groupBy("scenario_id").cogroup(od.groupBy("scenario_id")).applyInPandas(guarded, schema)


def _with_start(od: DataFrame, start: DataFrame | None, method: str) -> DataFrame:
    """Demand rows, and rows of the flows by origin (scenario_id, o, arc_id, x)
    that the solver goes on from."""
    if method not in kernels.METHODS:
        raise ValueError(f"method must be one of {sorted(kernels.METHODS)}")
    if start is None:
        return od
    if method not in ("pas", "bush"):
        raise ValueError("only pas and bush go on from flows")
    rows = start.select("scenario_id", "o", F.lit(None).cast("int").alias("d"), F.col("x").alias("demand"), F.col("arc_id").alias("start_arc"))
    return od.select("scenario_id", "o", "d", "demand", F.lit(None).cast("int").alias("start_arc")).unionByName(rows)


def assign(arcs: DataFrame, od: DataFrame, method: str = "pas", system: bool = False, skip_unreachable: bool = False, start: DataFrame | None = None, **options) -> DataFrame:
    """Link flows and costs at user equilibrium, or at least total time.

    method is one of fw, pas, bush, admm. Pairs without a path raise, unless
    they are skipped. A scenario without demand has no flow, one without links
    no rows. pas and bush can go on from ``start``, flows by origin as
    ``assign_by_origin`` gives them; what demand has beyond them is loaded on
    the shortest ways."""

    def run(a: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        a, net, flows, _ = _solved(a, q, method, system, skip_unreachable, options)
        x = np.sum([*flows.values(), np.zeros(len(a))], axis=0)
        net.system = False
        return a.assign(x=x, cost=net.cost(x))[["scenario_id", "arc_id", "u", "v", "capacity", "t0", "x", "cost"]]

    return _grouped(arcs, _with_start(od, start, method), run, FLOWS)


def assign_by_origin(arcs: DataFrame, od: DataFrame, method: str = "pas", system: bool = False, skip_unreachable: bool = False, start: DataFrame | None = None, **options) -> DataFrame:
    """Flows by origin; links without an origin's flow are left out."""

    def run(a: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        a, net, flows, _ = _solved(a, q, method, system, skip_unreachable, options)
        ids, parts = a["arc_id"].to_numpy(), []
        for o, x in flows.items():
            at = np.flatnonzero(x > 0)
            parts.append(pd.DataFrame({"scenario_id": a["scenario_id"].iloc[0], "o": int(net.labels[o]), "arc_id": ids[at], "x": x[at]}))
        return pd.concat(parts) if parts else pd.DataFrame(columns=["scenario_id", "o", "arc_id", "x"])

    return _grouped(arcs, _with_start(od, start, method), run, BY_ORIGIN)


def convergence(arcs: DataFrame, od: DataFrame, method: str = "pas", system: bool = False, skip_unreachable: bool = False, start: DataFrame | None = None, **options) -> DataFrame:
    """The iterations' gaps, relative changes and CPU seconds of each scenario."""

    def run(a: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        *_, log = _solved(a, q, method, system, skip_unreachable, options)
        out = pd.DataFrame(log, columns=["iter", "gap", "rel_change", "seconds"])
        return out.assign(scenario_id=a["scenario_id"].iloc[0], algorithm=method)[["scenario_id", "algorithm", "iter", "gap", "rel_change", "seconds"]]

    return _grouped(arcs, _with_start(od, start, method), run, LOG)


def frank_wolfe_relational(arcs: DataFrame, od: DataFrame, target: float = 1e-2, max_iter: int = 20, system: bool = False) -> DataFrame:
    """Frank-Wolfe over DataFrames: trees, loading and the line search are
    joins and aggregations; a round is written before the next begins. Returns
    links with x and cost."""
    alpha = C.ALPHA * (1 + C.BETA) if system else C.ALPHA
    cost = C.bpr(F.col("t0"), F.col("x"), F.col("capacity"), alpha)
    sources = materialize(graph.origins(od), "origins")
    spt = graph.shortest_paths(arcs, sources, "t0")
    lost = graph.unreachable(od, spt).limit(20).collect()
    if lost:
        raise kernels.Unreachable(f"no path for {[(r.o, r.d) for r in lost]}")
    flow = materialize(graph.all_or_nothing(arcs, od, spt), "flow")
    for _ in range(max_iter):
        priced = flow.withColumn("cost", cost)
        spt = graph.shortest_paths(priced, sources, "cost")
        least = metrics.shortest_total(od, spt)
        total = priced.groupBy("scenario_id").agg(F.sum(F.col("x") * F.col("cost")).alias("tstt"))
        gap = total.join(least, "scenario_id").agg(F.max(1 - F.col("sptt") / F.col("tstt"))).first()[0]
        if gap is None or gap < target:
            break
        best = graph.all_or_nothing(arcs, od, spt).select("scenario_id", "arc_id", F.col("x").alias("y"))
        pair = materialize(flow.join(best, ["scenario_id", "arc_id"]), "pair")
        steps = best_steps(pair, alpha)
        moved = pair.join(steps, "scenario_id").withColumn("x", F.col("x") + F.col("step") * (F.col("y") - F.col("x")))
        new = materialize(moved.select(*flow.columns), "flow")
        discard(flow, pair, spt)
        flow = new
    return flow.withColumn("cost", C.bpr(F.col("t0"), F.col("x"), F.col("capacity")))


def best_steps(pair: DataFrame, alpha: float = C.ALPHA, trials: int = 256) -> DataFrame:
    """scenario_id, step: the best of equally spaced steps, all in one pass."""
    tried = pair.select("*", F.explode(F.sequence(F.lit(0), F.lit(trials))).alias("k")).withColumn("s", F.col("k") / trials)
    moved = F.col("x") + F.col("s") * (F.col("y") - F.col("x"))
    sums = tried.groupBy("scenario_id", "k").agg(F.sum(C.beckmann_term(F.col("t0"), moved, F.col("capacity"), alpha)).alias("f"))
    return sums.groupBy("scenario_id").agg((F.min_by("k", "f") / trials).alias("step"))


def multipliers_relational(arcs: DataFrame, od: DataFrame, rounds: int = 100, rho: float = 0.01, eps: float = 1e-9) -> DataFrame:
    """Alternating directions over DataFrames: scenario_id, o, arc_id, x after
    ``rounds`` rounds, or less where flows and balances no longer change. Links
    of one colour share no node, so a colour's flows by origin take their
    projected Newton steps in one pass of joins; balances and multipliers are
    rows by origin and node. Nothing is held whole by a task: this is for
    networks beyond the one-task solver, which needs far less time for small
    ones. Links are coloured by ``edge_colours``."""
    key = ["scenario_id", "o", "node"]
    links = materialize(arcs.select("scenario_id", "arc_id", "u", "v", "capacity", "t0").join(edge_colours(arcs), ["scenario_id", "arc_id"]), "coloured")
    colours = links.agg(F.max("colour")).first()[0]
    wanted = materialize(metrics.net_supply(od), "supply")
    each = links.join(graph.origins(od), "scenario_id").select("scenario_id", "o", "arc_id", F.lit(0.0).alias("x"))
    flow = materialize(each, "flows")
    state = materialize(wanted.select(*key, "g", F.lit(0.0).alias("balance"), F.lit(0.0).alias("dual")), "state")
    for _ in range(rounds):
        moved = 0.0
        for colour in range((-1 if colours is None else colours) + 1):
            own = links.filter(F.col("colour") == colour)
            price = F.col("dual") + rho * (F.col("balance") - F.col("g"))
            ends = metrics.link_prices(own, state.select(*key, price.alias("value")))
            now = flow.join(own.select("scenario_id", "arc_id", "u", "v", "capacity", "t0"), ["scenario_id", "arc_id"])
            total = now.groupBy("scenario_id", "arc_id").agg(F.sum("x").alias("total"))
            args = (F.col("t0"), F.col("total"), F.col("capacity"))
            curve = C.bpr_derivative(*args) + 2 * rho
            step = F.when(curve < eps, 0.0).otherwise((C.bpr(*args) + F.coalesce("difference", F.lit(0.0))) / curve)
            both = now.join(total, ["scenario_id", "arc_id"]).join(ends.select("scenario_id", "o", "arc_id", "difference"), ["scenario_id", "o", "arc_id"], "left")
            new = both.select("scenario_id", "o", "arc_id", "u", "v", F.greatest(F.col("x") - step, F.lit(0.0)).alias("x"), F.col("x").alias("was"))
            new = materialize(new, "stepped")
            change = metrics.imbalance(new.select("scenario_id", "o", "u", "v", (F.col("x") - F.col("was")).alias("x")))
            after = state.join(change, key, "full").fillna(0.0, ["g", "balance", "dual", "out_minus_in"])
            last, state = state, materialize(after.select(*key, "g", (F.col("balance") + F.col("out_minus_in")).alias("balance"), "dual"), "state")
            rest = flow.join(new.select("scenario_id", "o", "arc_id"), ["scenario_id", "o", "arc_id"], "left_anti")
            old, flow = flow, materialize(rest.unionByName(new.select("scenario_id", "o", "arc_id", "x")), "flows")
            moved = max(moved, new.agg(F.max(F.abs(F.col("x") - F.col("was")))).first()[0] or 0.0)
            discard(last, old, new)
        last, state = state, materialize(state.withColumn("dual", F.col("dual") + rho * (F.col("balance") - F.col("g"))), "state")
        discard(last)
        off = state.agg(F.max(F.abs(F.col("balance") - F.col("g")))).first()[0] or 0.0
        if max(moved, off) < 1e-6:
            break
    discard(links, wanted, state)
    return flow


def edge_colours(arcs: DataFrame) -> DataFrame:
    """scenario_id, arc_id, colour: in order of arc_id, the least colour that no
    link at either end has; one task a scenario, with two numbers a link."""

    def paint(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("arc_id")
        return pdf.assign(colour=kernels.colours(pdf["u"].to_numpy(), pdf["v"].to_numpy()))[["scenario_id", "arc_id", "colour"]]

    return arcs.select("scenario_id", "arc_id", "u", "v").groupBy("scenario_id").applyInPandas(paint, "scenario_id string, arc_id int, colour int")
