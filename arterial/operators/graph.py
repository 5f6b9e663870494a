"""Trees, paths and bushes as relational operators.

Links may be broadcast by Spark where their table is small; nothing here asks
for it. Loops end when nothing changes and write each round to the shared
folder. Ties are broken by the smaller arc_id. Empty tables give empty results;
links whose ends or cost are null lead nowhere.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arterial.functions import cost as C
from arterial.operators import kernels
from arterial.plans.lineage import discard, finished, materialize


def nodes(arcs: DataFrame) -> DataFrame:
    ends = F.explode(F.array("u", "v")).alias("node")
    return arcs.select("scenario_id", ends).distinct()


def origins(od: DataFrame) -> DataFrame:
    return od.filter("demand > 0").select("scenario_id", "o").distinct()


def degrees(arcs: DataFrame) -> DataFrame:
    ends = F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("out")), F.struct(F.col("v").alias("node"), F.lit(0).alias("out"))))
    each = arcs.select("scenario_id", ends.alias("e"))
    return each.groupBy("scenario_id", "e.node").agg(F.sum("e.out").alias("n_out"), F.sum(1 - F.col("e.out")).alias("n_in"))


def max_node(arcs: DataFrame) -> DataFrame:
    """scenario_id, max_node: the largest label at any end."""
    return arcs.groupBy("scenario_id").agg(F.max(F.greatest("u", "v")).alias("max_node"))


def subgraph(arcs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The links whose scenario_id and arc_id are in chosen."""
    return arcs.join(chosen.select("scenario_id", "arc_id"), ["scenario_id", "arc_id"], "left_semi")


def broken_bush_arcs(bush: DataFrame, arcs: DataFrame) -> DataFrame:
    """Rows of a bush (scenario_id, o, arc_id, u, v) whose link the network
    lacks or has between other ends. A sound bush has none."""
    ends = arcs.select("scenario_id", "arc_id", F.col("u").alias("from"), F.col("v").alias("to"))
    both = bush.join(ends, ["scenario_id", "arc_id"], "left")
    return both.filter(~(F.col("u").eqNullSafe(F.col("from")) & F.col("v").eqNullSafe(F.col("to")))).select(*bush.columns)


def parallel_arcs(arcs: DataFrame) -> DataFrame:
    return arcs.groupBy("scenario_id", "u", "v").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


#: Links up to which a network goes to every task whole, some 10 MB; beyond it
#: trees and loading are joins. Both ways give the same rows.
TASK_LINKS = 200_000
#: Rounds after which the labels' parts become one again.
FOLD = 6

TREE = "scenario_id string, o int, node int, dist double, pred_arc int"


def _small(links: DataFrame, limit: int) -> list | None:
    """The rows of links, if they are not more than the limit."""
    rows = links.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def shortest_paths(arcs: DataFrame, sources: DataFrame, cost: str = "t0") -> DataFrame:
    """scenario_id, o, node, dist, pred_arc of the tree of each origin, a node
    only where it is reached. Costs must not be negative. Without origins there
    are no rows; an origin without links is its own tree."""
    links = arcs.select("scenario_id", "arc_id", "u", "v", F.col(cost).cast("double").alias("c"))
    small = _small(links, TASK_LINKS)
    if small is None:
        return relaxed(links.withColumnRenamed("u", "node"), sources)
    by: dict[str, list] = {}
    for r in sorted(small, key=lambda r: r.arc_id):
        by.setdefault(r.scenario_id, []).append((r.u, r.v, r.arc_id, r.c))

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[str, dict[int, list]] = {}
        for batch in batches:
            for scenario, o in zip(*(c.to_pylist() for c in batch.columns)):
                if scenario not in out:
                    out[scenario] = {}
                    for link in by.get(scenario, ()):
                        out[scenario].setdefault(link[0], []).append(link[1:])
                dist, pred = kernels.dijkstra(out[scenario], o)
                columns = [[scenario] * len(dist), [o] * len(dist), list(dist), list(dist.values()), [pred.get(n) for n in dist]]
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["scenario_id", "o", "node", "dist", "pred_arc"])

    return materialize(sources.select("scenario_id", F.col("o").cast("int")).mapInArrow(trees, TREE), "trees")


def relaxed(links: DataFrame, sources: DataFrame, rounds: int | None = None) -> DataFrame:
    """The labels of ``shortest_paths`` by min-plus rounds, for links (node, v,
    arc_id, c and perhaps o) of any number: only nodes whose label fell send new
    ones, a round writes only those, and every few rounds the parts written
    become one. More than ``rounds`` rounds raise: a cycle gets ever cheaper."""
    key = ["scenario_id", "o", "node"]
    links = links.filter("v is not null and c is not null")
    fresh = materialize(sources.select("scenario_id", "o", F.col("o").alias("node"), F.lit(0.0).alias("dist"), F.lit(None).cast("int").alias("pred_arc")), "labels")
    parts, n = [fresh], 0
    best = F.min(F.struct("dist", F.coalesce("pred_arc", F.lit(-1)).alias("p"))).alias("b")

    def folded() -> DataFrame:
        both = functools.reduce(DataFrame.unionByName, parts)
        return both.groupBy(*key).agg(best).select(*key, "b.dist", F.nullif(F.col("b.p"), F.lit(-1)).alias("pred_arc"))

    while not fresh.isEmpty():
        sent = fresh.join(links, [c for c in ("scenario_id", "o", "node") if c in links.columns])
        sent = sent.select("scenario_id", "o", F.col("v").alias("node"), (F.col("dist") + F.col("c")).alias("dist"), F.col("arc_id").alias("pred_arc"))
        new = sent.groupBy(*key).agg(best).select(*key, "b.dist", F.col("b.p").alias("pred_arc"))
        old = folded().select(*key, F.col("dist").alias("had"), F.coalesce("pred_arc", F.lit(-1)).alias("by"))
        # at equal distance an old label stays, unless the new link comes first
        lower = F.col("had").isNull() | (F.struct("dist", "pred_arc") < F.struct(F.col("had").alias("dist"), F.col("by").alias("pred_arc")))
        fresh = materialize(new.join(old, key, "left").filter(lower).select(*fresh.columns), "labels")
        parts.append(fresh)
        n += 1
        if rounds is not None and n > rounds:
            discard(*parts)
            raise ValueError("the links have a cycle that gets ever cheaper")
        if len(parts) > FOLD:
            one = materialize(folded(), "labels")
            discard(*parts[:-1])
            parts = [one, fresh]
    return finished(folded(), "trees", *parts)


def _tree_links(spt: DataFrame, arcs: DataFrame) -> DataFrame:
    """scenario_id, o, node, pred_arc, u: each node's link in its tree."""
    ends = arcs.select("scenario_id", F.col("arc_id").alias("pred_arc"), "u")
    return spt.filter("pred_arc is not null").join(ends, ["scenario_id", "pred_arc"]).select("scenario_id", "o", "node", "pred_arc", "u")


def walks(od: DataFrame, spt: DataFrame, arcs: DataFrame) -> DataFrame:
    """scenario_id, o, d, demand, arc_id, step: the links of each pair's path,
    from the destination back, of any length; pairs without a path give none."""
    tree = materialize(_tree_links(spt, arcs), "tree")
    pair = ["scenario_id", "o", "d", "demand"]
    at = materialize(od.filter("demand > 0").select(*pair, F.col("d").alias("node")), "walk")
    parts, step = [], 1
    while not at.isEmpty():
        walked = materialize(at.join(tree, ["scenario_id", "o", "node"]).select(*pair, F.col("pred_arc").alias("arc_id"), F.lit(step).alias("step"), F.col("u").alias("node")), "walk")
        discard(*([at] if step == 1 else []))
        parts.append(walked)
        at, step = walked, step + 1
    if not parts:
        return od.limit(0).select(*pair, F.lit(0).alias("arc_id"), F.lit(0).alias("step"))
    return finished(functools.reduce(DataFrame.unionByName, parts).drop("node"), "walks", tree, *parts)


def tree_flows(od: DataFrame, spt: DataFrame, arcs: DataFrame) -> DataFrame:
    """scenario_id, o, arc_id, x of all-or-nothing loading, without expanding
    paths: demand is pushed towards the origin. Demand that the tree does not
    reach is not loaded."""
    key = ["scenario_id", "o", "node"]
    tree = _tree_links(spt, arcs)
    moving = od.filter("demand > 0 and o != d").groupBy("scenario_id", "o", F.col("d").alias("node")).agg(F.sum("demand").alias("q"))
    if _small(arcs.select("arc_id"), TASK_LINKS) is not None:  # then a tree fits a task

        def push(a: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
            if not len(a) or not len(q):
                return pd.DataFrame(columns=["scenario_id", "o", "arc_id", "x"])
            flow = kernels.push_up(dict(zip(a["node"].tolist(), zip(a["u"].tolist(), a["pred_arc"].tolist()))), dict(zip(q["node"].tolist(), q["q"].tolist())))
            return pd.DataFrame({"scenario_id": a["scenario_id"].iloc[0], "o": a["o"].iloc[0], "arc_id": list(flow), "x": list(flow.values())})

        return tree.groupBy("scenario_id", "o").cogroup(moving.groupBy("scenario_id", "o")).applyInPandas(push, "scenario_id string, o int, arc_id int, x double")
    tree = materialize(tree, "tree")
    moving = materialize(moving, "moving")
    parts = []
    while not moving.isEmpty():
        step = materialize(moving.join(tree, key).select("scenario_id", "o", "q", "u", F.col("pred_arc").alias("arc_id")), "step")
        parts.append(step)
        discard(moving)
        moving = materialize(step.groupBy("scenario_id", "o", F.col("u").alias("node")).agg(F.sum("q").alias("q")), "moving")
    if not parts:
        return od.limit(0).select("scenario_id", "o", F.lit(0).alias("arc_id"), F.col("demand").alias("x"))
    out = functools.reduce(DataFrame.unionByName, parts).groupBy("scenario_id", "o", "arc_id").agg(F.sum("q").alias("x"))
    return finished(out, "tree-flows", moving, tree, *parts)


def arc_flows(arcs: DataFrame, oflow: DataFrame) -> DataFrame:
    """All links with the sum x of their flows over origins."""
    total = oflow.groupBy("scenario_id", "arc_id").agg(F.sum("x").alias("x"))
    return arcs.join(total, ["scenario_id", "arc_id"], "left").fillna(0.0, ["x"])


def all_or_nothing(arcs: DataFrame, od: DataFrame, spt: DataFrame) -> DataFrame:
    return arc_flows(arcs, tree_flows(od, spt, arcs))


def unreachable(od: DataFrame, spt: DataFrame) -> DataFrame:
    reached = spt.select("scenario_id", "o", F.col("node").alias("d"))
    return od.filter("demand > 0").join(reached, ["scenario_id", "o", "d"], "left_anti")


def reduced_costs(arcs: DataFrame, spt: DataFrame, cost: str = "cost") -> DataFrame:
    """scenario_id, o, arc_id, reduced: for links whose two ends are reached."""
    tail = spt.select("scenario_id", "o", F.col("node").alias("u"), F.col("dist").alias("dist_u"))
    head = spt.select("scenario_id", "o", F.col("node").alias("v"), F.col("dist").alias("dist_v"))
    both = arcs.join(tail, ["scenario_id", "u"]).join(head, ["scenario_id", "o", "v"])
    return both.select("scenario_id", "o", "arc_id", C.reduced_cost(F.col(cost), F.col("dist_u"), F.col("dist_v")).alias("reduced"))


def disequilibrated(arcs: DataFrame, oflow: DataFrame, spt: DataFrame, eps: float = 1e-9) -> DataFrame:
    """Links that carry an origin's flow at a positive reduced cost."""
    used = oflow.filter(F.col("x") > eps)
    return used.join(reduced_costs(arcs, spt), ["scenario_id", "o", "arc_id"]).filter(F.col("reduced") > eps)


def new_bush_arcs(arcs: DataFrame, spt: DataFrame, bush: DataFrame) -> DataFrame:
    """Links outside the bush that lead away from the origin."""
    tail = spt.select("scenario_id", "o", F.col("node").alias("u"), F.col("dist").alias("dist_u"))
    head = spt.select("scenario_id", "o", F.col("node").alias("v"), F.col("dist").alias("dist_v"))
    able = arcs.join(tail, ["scenario_id", "u"]).join(head, ["scenario_id", "o", "v"]).filter("dist_u < dist_v")
    return able.select("scenario_id", "o", "arc_id").join(bush, ["scenario_id", "o", "arc_id"], "left_anti")


def pruned_bush(oflow: DataFrame, spt: DataFrame) -> DataFrame:
    """Links with flow, and those of the shortest tree."""
    used = oflow.filter("x > 0").select("scenario_id", "o", "arc_id")
    return used.unionByName(spt.filter("pred_arc is not null").select("scenario_id", "o", F.col("pred_arc").alias("arc_id"))).distinct()


def improved_bush(arcs: DataFrame, spt: DataFrame, bush: DataFrame) -> DataFrame:
    return bush.select("scenario_id", "o", "arc_id").unionByName(new_bush_arcs(arcs, spt, bush))


def busiest_predecessor(arcs: DataFrame, oflow: DataFrame) -> DataFrame:
    """scenario_id, o, v, arc_id: the incoming link with most of the origin's flow."""
    each = oflow.filter("x > 0").join(arcs.select("scenario_id", "arc_id", "v"), ["scenario_id", "arc_id"])
    return each.groupBy("scenario_id", "o", "v").agg(F.max_by("arc_id", F.struct("x", -F.col("arc_id"))).alias("arc_id"))


def split_fractions(arcs: DataFrame, oflow: DataFrame) -> DataFrame:
    """Each link's share of the origin's flow into its head."""
    each = oflow.filter("x > 0").join(arcs.select("scenario_id", "arc_id", "v"), ["scenario_id", "arc_id"])
    total = each.groupBy("scenario_id", "o", "v").agg(F.sum("x").alias("into"))
    both = each.join(total, ["scenario_id", "o", "v"])
    return both.select("scenario_id", "o", "arc_id", F.try_divide("x", "into").alias("fraction"))


def conflicts(arcs: DataFrame) -> DataFrame:
    """scenario_id, a, b: pairs a < b of links that share a node. Links meet by
    an equi-join on their ends, so only links of one node meet."""
    ends = arcs.select("scenario_id", F.col("arc_id"), F.explode(F.array("u", "v")).alias("node"))
    left, right = ends.withColumnRenamed("arc_id", "a"), ends.withColumnRenamed("arc_id", "b")
    return left.join(right, ["scenario_id", "node"]).filter("a < b").select("scenario_id", "a", "b").distinct()


def reaching(arcs: DataFrame, targets: DataFrame) -> DataFrame:
    """scenario_id, target, node: nodes from which a target can be reached."""
    back = arcs.select("scenario_id", F.col("v").alias("node"), F.col("u").alias("before")).distinct()
    found = materialize(targets.select("scenario_id", "target", F.col("target").alias("node"), F.lit(0).alias("hop")), "reaching")
    hop = 0
    while not found.filter(F.col("hop") == hop).isEmpty():
        step = found.filter(F.col("hop") == hop).join(back, ["scenario_id", "node"]).select("scenario_id", "target", F.col("before").alias("node")).distinct()
        new = step.join(found, ["scenario_id", "target", "node"], "left_anti").withColumn("hop", F.lit(hop + 1))
        both = materialize(found.unionByName(new), "reaching")
        discard(found)
        found, hop = both, hop + 1
    return found.drop("hop")


def pas_keys(pas: DataFrame) -> DataFrame:
    """pas with pas_key: its two segments, each sorted, in order, and the origin."""
    one, two = F.array_sort("s1"), F.array_sort("s2")
    ordered = F.when(one <= two, F.array(one, two)).otherwise(F.array(two, one))
    return pas.withColumn("pas_key", F.concat_ws("|", F.col("o").cast("string"), *(F.array_join(ordered[i], ",") for i in (0, 1))))


def dead_pas(pas: DataFrame, oflow: DataFrame, eps: float = 1e-9) -> DataFrame:
    """pas (scenario_id, o, s1, s2) of which neither segment has the origin's
    flow on all its links."""
    sides = F.explode(F.array(F.struct(F.lit(1).alias("side"), F.col("s1").alias("path")), F.struct(F.lit(2).alias("side"), F.col("s2").alias("path")))).alias("s")
    each = pas_keys(pas).select("scenario_id", "o", "pas_key", sides).select("scenario_id", "o", "pas_key", "s.side", F.explode("s.path").alias("arc_id"))
    own = each.join(oflow.select("scenario_id", "o", "arc_id", "x"), ["scenario_id", "o", "arc_id"], "left")
    least = own.groupBy("scenario_id", "pas_key", "side").agg(F.min(F.coalesce("x", F.lit(0.0))).alias("least"))
    dead = least.groupBy("scenario_id", "pas_key").agg(F.max("least").alias("most")).filter(F.col("most") < eps)
    return pas_keys(pas).join(dead, ["scenario_id", "pas_key"], "left_semi").select(*pas.columns)


def new_pas(pas: DataFrame, known: DataFrame) -> DataFrame:
    return pas_keys(pas).join(known.select("scenario_id", "pas_key"), ["scenario_id", "pas_key"], "left_anti").dropDuplicates(["scenario_id", "pas_key"])


def segment_sums(segments: DataFrame, flow: DataFrame, oflow: DataFrame) -> DataFrame:
    """Cost, slope and least origin flow of each segment (scenario_id, pas_id,
    side, o, path of arc_ids), in one aggregation."""
    each = segments.select("scenario_id", "pas_id", "side", "o", F.explode("path").alias("arc_id"))
    both = each.join(flow, ["scenario_id", "arc_id"]).join(oflow.select("scenario_id", "o", "arc_id", F.col("x").alias("own")), ["scenario_id", "o", "arc_id"], "left")
    args = (F.col("t0"), F.col("x"), F.col("capacity"))
    return both.groupBy("scenario_id", "pas_id", "side").agg(
        F.sum(C.bpr(*args)).alias("cost"), F.sum(C.bpr_derivative(*args)).alias("slope"), F.min(F.coalesce("own", F.lit(0.0))).alias("bottleneck")
    )


def bush_labels(arcs: DataFrame, bush: DataFrame, sources: DataFrame, cost: str = "t0") -> DataFrame:
    """scenario_id, o, node, low, short_arc, high, long_arc over the links of
    each origin's bush (scenario_id, o, arc_id and perhaps x): the shortest
    distance, and the longest over links with flow where the bush has x. Nodes
    that only links without flow reach have no high. A cycle raises."""
    both = bush.join(arcs.select("scenario_id", "arc_id", F.col("u").alias("node"), "v", F.col(cost).alias("c")), ["scenario_id", "arc_id"])
    used = both.filter("x > 0") if "x" in bush.columns else both
    rounds = nodes(arcs).groupBy("scenario_id").count().agg(F.max("count")).first()[0] or 0
    low = relaxed(both, sources, rounds)
    # the longest way in a graph without cycles is the shortest one of turned costs
    high = relaxed(used.withColumn("c", -F.col("c")), sources, rounds)
    out = low.select("scenario_id", "o", "node", F.col("dist").alias("low"), F.col("pred_arc").alias("short_arc"))
    more = high.select("scenario_id", "o", "node", (F.lit(0.0) - F.col("dist")).alias("high"), F.col("pred_arc").alias("long_arc"))
    return finished(out.join(more, ["scenario_id", "o", "node"], "left"), "bush-labels", low, high)


def trails(tree: DataFrame, ends: DataFrame) -> DataFrame:
    """scenario_id, o, end, node, step, arc_id: the nodes on the way back from
    each end (scenario_id, o, end) along tree (scenario_id, o, node, pred_arc,
    u), with the link that leaves the node towards the end (null at step 0)."""
    at = materialize(ends.select("scenario_id", "o", "end", F.col("end").alias("node"), F.lit(0).alias("step"), F.lit(None).cast("int").alias("arc_id")), "trail")
    parts, step = [at], 0
    while not at.isEmpty():
        step += 1
        back = at.select("scenario_id", "o", "end", "node").join(tree, ["scenario_id", "o", "node"])
        at = materialize(back.select("scenario_id", "o", "end", F.col("u").alias("node"), F.lit(step).alias("step"), F.col("pred_arc").alias("arc_id")), "trail")
        parts.append(at)
    return finished(functools.reduce(DataFrame.unionByName, parts), "trails", *parts)


def divergences(arcs: DataFrame, labels: DataFrame) -> DataFrame:
    """scenario_id, o, node, divergence: where the shortest and the longest way
    to a node last parted, for nodes that the two enter by different links."""
    ends = labels.filter("short_arc != long_arc").select("scenario_id", "o", F.col("node").alias("end"))
    by = lambda c: trails(_tree_links(labels.withColumnRenamed(c, "pred_arc"), arcs), ends).filter("step > 0")
    short, long = by("short_arc"), by("long_arc")
    meet = short.select("scenario_id", "o", "end", "node").join(long, ["scenario_id", "o", "end", "node"])
    first = meet.groupBy("scenario_id", "o", "end").agg(F.min_by("node", "step").alias("divergence"))
    return finished(first.withColumnRenamed("end", "node"), "divergences", short, long)


def paired_segments(arcs: DataFrame, spt: DataFrame, oflow: DataFrame, links: DataFrame, eps: float = 1e-9) -> DataFrame:
    """scenario_id, o, arc_id, s1, s2 for links (scenario_id, o, arc_id): from
    where the two part to the link's head, along the tree, and by the origin's
    busiest links back from the link until they meet the tree's way. Links from
    which those end or turn in a circle first give no row."""
    key = ["scenario_id", "o", "arc_id"]
    ends = arcs.select("scenario_id", "arc_id", "u", "v")
    asked = materialize(links.select(*key).join(ends, ["scenario_id", "arc_id"]), "asked-links")
    tree = trails(_tree_links(spt, arcs), asked.select("scenario_id", "o", F.col("v").alias("end")).distinct())
    busiest = busiest_predecessor(arcs, oflow.filter(F.col("x") > eps)).withColumnRenamed("arc_id", "by").join(ends.select("scenario_id", F.col("arc_id").alias("by"), "u"), ["scenario_id", "by"])
    busiest = materialize(busiest.select("scenario_id", "o", F.col("v").alias("node"), "by", F.col("u").alias("before")), "busiest")
    at = materialize(asked.select(*key, F.col("v").alias("end"), F.col("u").alias("node"), F.array("arc_id").alias("s2"), F.array("v").alias("seen")), "back")
    way = tree.filter("step > 0").select("scenario_id", "o", "end", "node", "step")
    met, rounds = [], [at]
    while not at.isEmpty():
        met.append(materialize(at.join(way, ["scenario_id", "o", "end", "node"]).select(*key, "end", "step", "s2"), "met"))
        rest = at.join(way, ["scenario_id", "o", "end", "node"], "left_anti").filter(~F.array_contains("seen", F.col("node")))
        step = rest.join(busiest, ["scenario_id", "o", "node"])
        at = materialize(step.select(*key, "end", F.col("before").alias("node"), F.concat(F.array("by"), "s2").alias("s2"), F.concat("seen", F.array("node")).alias("seen")), "back")
        rounds.append(at)
    if not met:
        return links.limit(0).select(*key, F.array("arc_id").alias("s1"), F.array("arc_id").alias("s2"))
    two = functools.reduce(DataFrame.unionByName, met)
    on_way = tree.filter("step > 0").select("scenario_id", "o", "end", F.col("step").alias("k"), F.col("arc_id").alias("link"))
    one = two.join(on_way, ["scenario_id", "o", "end"]).filter("k <= step").groupBy(*key).agg(F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("k"), "link"))).alias("s1"))
    out = two.select(*key, "s2").join(one, key).select(*key, F.transform("s1", lambda x: x["link"]).alias("s1"), "s2")
    return finished(out, "paired-segments", asked, tree, busiest, *rounds, *met)


def link_use(arcs: DataFrame, oflow: DataFrame, od: DataFrame) -> DataFrame:
    """scenario_id, o, d, arc_id, p: the share of a pair's trips that uses a
    link where trips part as the origin's flow does. Shares are pushed back
    from the destination, a link a round; flows by origin must have no cycle."""
    ends = arcs.select("scenario_id", "arc_id", "u", F.col("v").alias("node"))
    split = materialize(split_fractions(arcs, oflow).join(ends, ["scenario_id", "arc_id"]), "split")
    pair = ["scenario_id", "o", "d"]
    rounds = nodes(arcs).groupBy("scenario_id").count().agg(F.max("count")).first()[0] or 0
    at = materialize(od.filter("demand > 0 and o != d").select(*pair, F.col("d").alias("node"), F.lit(1.0).alias("mass")).distinct(), "mass")
    parts, tables = [], [split, at]
    while not at.isEmpty():
        if len(parts) > rounds:
            raise ValueError("flows of an origin have a cycle")
        step = materialize(at.filter("node != o").join(split, ["scenario_id", "o", "node"]).select(*pair, "arc_id", "u", (F.col("mass") * F.col("fraction")).alias("p")), "shares")
        at = materialize(step.groupBy(*pair, F.col("u").alias("node")).agg(F.sum("p").alias("mass")), "mass")
        parts.append(step)
        tables += [step, at]
    if not parts:
        return od.limit(0).select(*pair, F.lit(0).alias("arc_id"), F.lit(0.0).alias("p"))
    out = functools.reduce(DataFrame.unionByName, parts).groupBy(*pair, "arc_id").agg(F.sum("p").alias("p"))
    return finished(out, "link-use", *tables)


def levels(spt: DataFrame, arcs: DataFrame) -> DataFrame:
    """scenario_id, o, node, level: links on each node's way in its tree, which
    is a topological order of it."""
    ends = spt.select("scenario_id", "o", F.col("node").alias("end"))
    out = trails(_tree_links(spt, arcs), ends)
    return out.groupBy("scenario_id", "o", F.col("end").alias("node")).agg(F.max("step").alias("level"))
