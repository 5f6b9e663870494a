"""Scenario analyses: congestion percolation and demand estimation.

Scenarios run side by side, each in one task. Pairs o = d and pairs without
demand take no part; pairs without a path raise, unless they are skipped. A
scenario without links gives no rows, one without demand a single step without
flow, or no demand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arterial.operators import kernels
from arterial.plans.lineage import materialize
from arterial.plans.solvers import _grouped, network_of

#: What a percolation run gives, by name; the columns of each.
OUTPUTS = {
    "steps": "scenario_id string, step int, congested double, efficiency double, n_removed int, total_demand double",
    "flows": "scenario_id string, step int, arc_id int, x double, cost double",
    "removed": "scenario_id string, step int, arc_id int, o int, node int",
    "last_demand": "scenario_id string, o int, d int, demand double",
}
EVENTS = "kind string, scenario_id string, step int, arc_id int, a int, b int, x double, y double, z double"
BLOCKED = 1e10


def _run(arcs: pd.DataFrame, od: pd.DataFrame, growth: float, ratio: float, share: float, patience: int, max_steps: int, target: float, skip: bool) -> Iterator[tuple]:
    """Events of one scenario: (kind, step, arc_id, a, b, x, y, z)."""
    arcs = arcs.sort_values("arc_id").reset_index(drop=True)
    od = od[(od["demand"] > 0) & (od["o"] != od["d"])].groupby(["o", "d"], as_index=False)["demand"].sum()
    ids, times, hits = arcs["arc_id"].tolist(), arcs["t0"].to_numpy(float).copy(), 0
    net = network_of(arcs, od, skip=skip)
    label = net.labels.tolist()
    kept = {(label[o], label[d]) for o, own in net.demand.items() for d in own}
    od = od[np.array([p in kept for p in zip(od["o"], od["d"])], bool)]
    reference = {o: net.tree(o, net.cost(net.capacity))[0] for o in net.demand}
    for step in range(max_steps):
        net = network_of(arcs.assign(t0=times), od)
        flows, _ = kernels.bushes(net, target)
        x = np.sum([*flows.values(), np.zeros(len(arcs))], axis=0)
        cost = net.cost(x)
        slow, gone = 0, set()
        for o, own in net.demand.items():
            dist, pred = net.tree(o, cost)
            for d in own:
                if dist[d] > ratio * reference[o][d]:
                    slow += 1
                    for a in net.path(pred, d):
                        gone.add(a)
                        yield "removed", step, ids[a], label[o], label[d], None, None, None
        new = [a for a in gone if times[a] < BLOCKED]
        congested = slow / len(od) if len(od) else 0.0
        efficiency = float((x * net.t0 / np.where(cost > 0, cost, 1)).mean())
        yield "steps", step, None, len(new), None, congested, efficiency, float(od["demand"].sum())
        for a, i in enumerate(ids):
            yield "flows", step, i, None, None, float(x[a]), float(cost[a]), None
        times[new] = BLOCKED
        od = od.assign(demand=od["demand"] + growth)
        hits += congested > share
        if hits > patience or slow == len(od):
            break
    for o, d, q in zip(od["o"], od["d"], od["demand"]):
        yield "last_demand", None, None, int(o), int(d), float(q), None, None


def percolation_outputs(
    arcs: DataFrame, od: DataFrame, growth: float = 0.05, ratio: float = 3.0, share: float = 0.98, patience: int = 10, max_steps: int = 200, target: float = 1e-4, skip_unreachable: bool = False
) -> dict[str, DataFrame]:
    """The frames of ``OUTPUTS``: each step raises all demand by ``growth`` and
    blocks the links on the path of any pair that takes more than ``ratio``
    times its time at full capacity; ``removed`` names the links with the pair.
    A run ends after more than ``patience`` steps in which more than ``share``
    of the pairs are congested, or when all are."""

    def run(a: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        rows = [(e[0], a["scenario_id"].iloc[0], *e[1:]) for e in _run(a, q, growth, ratio, share, patience, max_steps, target, skip_unreachable)]
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in EVENTS.split(", ")])
        return out.astype({c: "Int32" for c in ("step", "arc_id", "a", "b")} | {c: "float64" for c in "xyz"})

    events = materialize(_grouped(arcs, od, run, EVENTS), "percolation")
    of = lambda kind, *columns: events.filter(F.col("kind") == kind).select("scenario_id", *columns)
    named = lambda c, name: F.col(c).alias(name)
    return {
        "steps": of("steps", "step", named("x", "congested"), named("y", "efficiency"), named("a", "n_removed"), named("z", "total_demand")),
        "flows": of("flows", "step", "arc_id", "x", named("y", "cost")),
        "removed": of("removed", "step", "arc_id", named("a", "o"), named("b", "node")),
        "last_demand": of("last_demand", named("a", "o"), named("b", "d"), named("x", "demand")),
    }


def percolation(arcs: DataFrame, od: DataFrame, **options) -> DataFrame:
    """The steps of ``percolation_outputs``."""
    return percolation_outputs(arcs, od, **options)["steps"]


def removed_links(arcs: DataFrame, od: DataFrame, **options) -> DataFrame:
    """scenario_id, step, arc_id: when a percolation run first removes a link."""
    return percolation_outputs(arcs, od, **options)["removed"].groupBy("scenario_id", "arc_id").agg(F.min("step").alias("step")).select("scenario_id", "step", "arc_id")


def patience(log: DataFrame, share: float = 0.98) -> DataFrame:
    """log with hits: steps so far with more than ``share`` congested."""
    run = Window.partitionBy("scenario_id").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return log.withColumn("hits", F.sum(F.when(F.col("congested") > share, 1).otherwise(0)).over(run))


def estimate_demand(
    arcs: DataFrame, prior: DataFrame, observed: DataFrame, weight: float = 1.0, rate: float = 0.01, rounds: int = 10, least: float = 1.0, target: float = 1e-6, skip_unreachable: bool = False
) -> DataFrame:
    """scenario_id, o, d, demand after ``rounds`` gradient steps on entropy
    plus weight times half the squared error of link flows; pairs that fall
    under ``least`` are dropped. observed is (arc_id, x_hat) of all scenarios."""
    links = arcs.join(observed, "arc_id", "left")

    def run(a: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        a = a.sort_values("arc_id").reset_index(drop=True)
        q = q[(q["demand"] >= least) & (q["o"] != q["d"])].copy()
        seen = a["x_hat"].notna().to_numpy()
        for _ in range(rounds):
            if not len(q):
                break
            net = network_of(a, q, skip=skip_unreachable)
            flows, _ = kernels.bushes(net, target)
            x = np.sum([*flows.values(), np.zeros(len(a))], axis=0)
            error = np.where(seen, x - a["x_hat"].fillna(0).to_numpy(), 0.0)
            place = {int(label): i for i, label in enumerate(net.labels)}
            slope = []
            for o, d, v in zip(q["o"], q["d"], q["demand"]):
                own, use = flows.get(place.get(int(o), -1)), 0.0
                if own is not None and int(d) in place:  # else no path: only entropy counts
                    used = set(np.flatnonzero(own > 0).tolist())
                    use = float(kernels.link_use(net, used, own, place[int(o)], place[int(d)]) @ error)
                slope.append(np.log10(v) + weight * use)
            q = q.assign(demand=q["demand"] - rate * np.array(slope))
            q = q[q["demand"] >= least]
        return q[["scenario_id", "o", "d", "demand"]]

    return _grouped(links, prior, run, "scenario_id string, o int, d int, demand double")
