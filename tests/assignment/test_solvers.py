"""Kernels, solvers and analyses: agreement, balances and known equilibria."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from arterial.operators import generate, graph, kernels, metrics
from arterial.plans import scenarios, solvers
from arterial.sources import sinks, text

from .conftest import LINKS, PAIRS, grid, pairs


def network(demand, **options):
    u, v, c, t = zip(*[r[2:] for r in grid()])
    return kernels.Network.of(np.array(u), np.array(v), c, t, *zip(*demand), **options)


PAIR_LIST = [p[1:] for p in pairs(500.0)]


@pytest.mark.parametrize("system", [False, True])
def test_methods_agree(system):
    found = {}
    for method, target in (("pas", 1e-10), ("bush", 1e-9), ("fw", 1e-3), ("admm", 1e-6)):
        if method == "admm" and system:  # its step is set for equilibrium costs
            continue
        net = network(PAIR_LIST, system=system)
        flows, log = kernels.METHODS[method](net, target)
        x = np.sum(list(flows.values()), axis=0)
        found[method] = x
        assert log[-1][1] < target and all(g > -1e-9 for _, g, *_ in log) and log[0][2] == 1.0
        assert (x >= 0).all()
        for o, own in flows.items():
            balance = np.zeros(25)
            np.add.at(balance, net.tail, own)
            np.add.at(balance, net.head, -own)
            want = np.zeros(25)
            for d, q in net.demand[o].items():
                want[o] += q
                want[d] -= q
            assert np.allclose(balance, want, atol=1e-5 if method != "admm" else 1.0)
    assert np.allclose(found["pas"], found["bush"], atol=0.05)
    assert network(PAIR_LIST, system=system).objective(found["fw"]) == pytest.approx(network(PAIR_LIST, system=system).objective(found["pas"]), rel=1e-3)
    assert system or np.allclose(found["pas"], found["admm"], atol=0.5)


def test_equilibrium_is_not_cheaper_than_the_optimum():
    total = []
    for system in (False, True):
        net = network(PAIR_LIST, system=system)
        x = np.sum(list(kernels.paired_segments(net)[0].values()), axis=0)
        net.system = False
        total.append(float((x * net.cost(x)).sum()))
    assert total[0] > total[1]


#: Demand of each pair, total time and objective at equilibrium,
#: total time and objective at the optimum, and flow of the first links at equilibrium.
KNOWN = [
    (500.0, 151820.523030, 97334.402737, 137654.079540, 100765.509673, [65.9879, 65.9879, 65.9879, 315.0446, 249.0566, 315.0445, 367.9013, 52.8567]),
    (600.0, 234492.085571, 131593.832671, 223791.286503, 133853.230233, [88.4294, 88.4294, 88.4294, 430.6515, 342.2221, 430.6515, 485.5965, 54.9450]),
]


@pytest.mark.parametrize("demand, tstt, objective, so_tstt, so_objective, first", KNOWN)
def test_known_equilibria(spark, arcs, demand, tstt, objective, so_tstt, so_objective, first):
    od = spark.createDataFrame(pairs(demand), PAIRS)
    flow = solvers.assign(arcs, od, "pas").cache()
    assert metrics.total_time(flow).first().tstt == pytest.approx(tstt, rel=1e-6)
    assert metrics.beckmann(flow).first().beckmann == pytest.approx(objective, rel=1e-6)
    assert [r.x for r in flow.orderBy("arc_id").limit(8).collect()] == pytest.approx(first, abs=1e-3)
    best = solvers.assign(arcs, od, "pas", system=True)
    assert metrics.total_time(best).first().tstt == pytest.approx(so_tstt, rel=1e-6)
    assert metrics.beckmann(best).first().beckmann == pytest.approx(so_objective, rel=1e-5)


def test_known_loading(arcs, od):
    """Fixed values of all-or-nothing loading at free-flow times."""
    spt = graph.shortest_paths(arcs, graph.origins(od))
    assert metrics.shortest_total(od, spt).first().sptt == pytest.approx(64610.0)
    aon = graph.all_or_nothing(arcs, od, spt)
    assert aon.filter("x > 0").count() == 22
    gap = metrics.relative_gap(aon, od, graph.shortest_paths(metrics.with_cost(aon), graph.origins(od), "cost")).first()
    assert (gap.tstt, gap.sptt, gap.gap) == (pytest.approx(1134254.0972), pytest.approx(128931.7188), pytest.approx(0.886329, abs=1e-6))


def test_multipliers_by_iteration():
    """Eight colours, and the iterations that first pass a gap."""
    net = network(PAIR_LIST)
    assert kernels.colours(net.tail, net.head).max() == 7
    _, log = kernels.multipliers(net, 1e-4)
    assert [next(i for i, g, *_ in log if g < level) for level in (1e-2, 1e-4)] == [73, 159]


def test_relational_trees_equal_dijkstra(arcs, od):
    spt = graph.shortest_paths(arcs, graph.origins(od))
    net = network(PAIR_LIST)
    got = {(r.o, r.node): (r.dist, r.pred_arc) for r in spt.collect()}
    for o in net.demand:
        dist, pred = net.tree(o, net.t0)
        for i, label in enumerate(net.labels.tolist()):
            d, p = got[int(net.labels[o]), label]
            assert d == pytest.approx(dist[i]) and (p is None) == (pred[i] < 0)
    flow = {r.arc_id: r.x for r in graph.all_or_nothing(arcs, od, spt).collect()}
    assert np.allclose([flow[a] for a in range(80)], np.sum(list(net.load(net.t0).values()), axis=0))
    walked = graph.walks(od, spt, arcs).groupBy("arc_id").agg(F.sum("demand").alias("x")).collect()
    assert all(flow[r.arc_id] == r.x for r in walked) and len(walked) == sum(x > 0 for x in flow.values())


def test_relational_frank_wolfe_lowers_the_objective(arcs, od):
    start = graph.all_or_nothing(arcs, od, graph.shortest_paths(arcs, graph.origins(od)))
    out = solvers.frank_wolfe_relational(arcs, od, max_iter=2)
    assert metrics.beckmann(out).first()[1] < metrics.beckmann(start).first()[1] / 2
    assert metrics.imbalance(out.withColumn("o", F.lit(0))).agg(F.sum(F.abs("out_minus_in"))).first()[0] < 1e-6


def test_scenarios_side_by_side(spark, arcs, od):
    more = arcs.unionByName(arcs.withColumn("scenario_id", F.lit("1")))
    pairs = od.unionByName(od.withColumns({"scenario_id": F.lit("1"), "demand": F.col("demand") * 0.1}))
    out = solvers.assign(more, pairs, "bush", target=1e-6).groupBy("scenario_id").agg(F.sum("x").alias("x")).collect()
    assert {r.scenario_id for r in out} == {"0", "1"} and len({round(r.x) for r in out}) == 2
    by_origin = solvers.assign_by_origin(arcs, od, "pas", target=1e-6)
    assert by_origin.select("o").distinct().count() == 4
    assert solvers.convergence(arcs, od, "pas", target=1e-6).filter("gap < 1e-6").count() == 1
    with pytest.raises(ValueError):
        solvers.assign(arcs, od, "other")


def test_unreachable_and_empty(spark, arcs):
    lost = spark.createDataFrame([("0", 1, 99, 5.0), ("0", 1, 2, 5.0)], PAIRS)
    with pytest.raises(Exception, match="no path"):
        solvers.assign(arcs, lost).collect()
    assert solvers.assign(arcs, lost, skip_unreachable=True).agg(F.sum("x")).first()[0] > 0
    none = spark.createDataFrame([], PAIRS)
    assert solvers.assign(arcs, none).agg(F.sum("x")).first()[0] == 0
    assert kernels.Network.of(np.array([1]), np.array([2]), [0.0], [2.0], [1], [2], [3.0]).cost(np.array([3.0])).tolist() == [2.0]
    assert spark.createDataFrame([], LINKS).count() == 0


def test_colours_and_orders():
    net = network(PAIR_LIST)
    c = kernels.colours(net.tail, net.head)
    for k in range(c.max() + 1):
        ends = np.concatenate([net.tail[c == k], net.head[c == k]])
        assert len(set(ends.tolist())) == len(ends)
    with pytest.raises(ValueError, match="cycle"):
        kernels.topological_order(net, {0, int(np.flatnonzero((net.tail == net.head[0]) & (net.head == net.tail[0]))[0])}, int(net.tail[0]))


def test_percolation(spark, arcs, od):
    out = scenarios.percolation_outputs(arcs, od, growth=200.0, target=1e-2)
    steps = out["steps"].orderBy("step").collect()
    n = len(steps)
    assert [s.step for s in steps] == list(range(n)) and steps[-1].congested == 1.0 and all(s.congested < 1.0 for s in steps[:-1])
    assert steps[1].total_demand - steps[0].total_demand == pytest.approx(200.0 * 12)
    assert {(r.o, r.d, r.demand) for r in out["last_demand"].collect()} == {(r.o, r.d, 500.0 + 200.0 * n) for r in od.collect()}
    assert out["flows"].groupBy("step").count().filter("count = 80").count() == n
    removed = out["removed"].collect()
    assert len({(r.step, r.o, r.node) for r in removed if r.step == n - 1}) == 12
    assert scenarios.removed_links(arcs, od, growth=200.0, target=1e-2).count() == sum(s.n_removed for s in steps) == len({r.arc_id for r in removed})
    # a share that is passed from the first step on: the run ends by patience
    few = scenarios.percolation(arcs, od, growth=0.0, share=-1.0, patience=2, ratio=1e9, target=1e-2)
    assert few.count() == 3


def test_analyses_of_odd_scenarios(spark, arcs, od):
    """No links, no demand, pairs o = d, pairs without a path."""
    lone = spark.createDataFrame([("links", i, u, v, c, t) for _, i, u, v, c, t in grid()], LINKS)
    more = od.unionByName(spark.createDataFrame([("0", 3, 3, 50.0), ("no links", 1, 2, 5.0)], PAIRS))
    steps = scenarios.percolation(arcs.unionByName(lone), more, growth=500.0, max_steps=2, target=1e-2).collect()
    assert {s.scenario_id for s in steps} == {"0", "links"}
    assert [(s.congested, s.total_demand) for s in steps if s.scenario_id == "links"] == [(0.0, 0.0)]
    seen = arcs.select("arc_id", F.lit(10.0).alias("x_hat"))
    est = scenarios.estimate_demand(arcs.unionByName(lone), more, seen, rounds=1, target=1e-2)
    assert est.count() == 12 and est.filter("o = d").count() == 0
    lost = od.unionByName(spark.createDataFrame([("0", 7, 99, 5.0)], PAIRS))
    with pytest.raises(Exception, match="no path"):
        scenarios.percolation(arcs, lost, max_steps=1).collect()
    assert scenarios.percolation(arcs, lost, max_steps=1, target=1e-2, skip_unreachable=True).first().total_demand == 6000.0
    assert scenarios.estimate_demand(arcs, lost, seen, rounds=1, target=1e-2, skip_unreachable=True).count() == 13
    assert solvers.assign(arcs.limit(0), od).count() == 0


def test_demand_estimation_moves_towards_the_counts(spark, arcs, od):
    seen = solvers.assign(arcs, od, "bush", target=1e-6).select("arc_id", F.col("x").alias("x_hat"))
    prior = od.withColumn("demand", F.lit(420.0))
    out = scenarios.estimate_demand(arcs, prior, seen, weight=1.0, rate=0.05, rounds=8)
    error = lambda q: metrics.half_squared_error(solvers.assign(arcs, q, "bush", target=1e-6), seen).first()[1]
    assert error(out) < error(prior) / 2


def test_link_use_sums_to_one():
    net = network(PAIR_LIST)
    flows, _ = kernels.bushes(net, 1e-6)
    o, own = next(iter(flows.items()))
    used = set(np.flatnonzero(own > 0).tolist())
    for d in net.demand[o]:
        use = kernels.link_use(net, used, own, o, d)
        assert use[net.out[o]].sum() == pytest.approx(1) and use[net.into[d]].sum() == pytest.approx(1)


def test_random_demand(spark):
    out = generate.random_demand(spark, 20, 10, 300.0, 50, seed=4).cache()
    by = out.groupBy("scenario_id").agg(F.count("*").alias("n"), F.sum("demand").alias("q"), F.min("demand").alias("least"), F.countDistinct("o", "d").alias("pairs")).collect()
    assert len(by) == 20 and all(r.n == r.pairs == 10 and abs(r.q - 300) < 1e-9 and r.least > 0 for r in by)
    assert out.filter("o = d or o < 1 or d < 1 or o > 50 or d > 50").count() == 0
    assert sorted(map(str, out.collect())) == sorted(map(str, generate.random_demand(spark, 20, 10, 300.0, 50, seed=4).collect()))
    assert generate.random_demand(spark, 2, 6, 5.0, 3).count() == 12 and generate.random_demand(spark, 2, 1, 5.0, 3).count() == 2
    assert generate.all_distinct(out, "demand").filter("not distinct").count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "net.txt").write_text("# links\n1 2  300 3.5\n\n2 1 300 3.5 # back\n1 2 100 9\n")
    (tmp_path / "OD_3.txt").write_text("1 2 5\n1 2 6\n2 1 x\n")
    (tmp_path / "log_7.txt").write_text("1 0.5 1.0 2\n2 0.05 0.9 3\n")
    arcs = text.read_network(spark, f"{tmp_path}/net.txt")
    assert [(r.arc_id, r.u, r.capacity) for r in arcs.orderBy("arc_id").collect()] == [(0, 1, 300.0), (1, 2, 300.0), (2, 1, 100.0)]
    assert text.read_network(spark, f"{tmp_path}/net.txt", last_wins=True).count() == 2
    with pytest.raises(Exception, match="does not parse"):
        text.read_scenarios(spark, f"{tmp_path}/OD_*.txt").collect()
    (tmp_path / "OD_3.txt").write_text("1 2 5\n1 2 6\n2 1 0\n")
    assert {(r.scenario_id, r.o, r.d, r.demand) for r in text.read_scenarios(spark, f"{tmp_path}/OD_*.txt").collect()} == {("3", 1, 2, 11.0), ("3", 2, 1, 0.0)}
    assert {(r.o, r.d, r.demand) for r in text.read_demand(spark, f"{tmp_path}/OD_3.txt", last_wins=True).collect()} == {(1, 2, 6.0), (2, 1, 0.0)}
    assert [(r.run_id, r.iter, r.gap) for r in text.read_log(spark, f"{tmp_path}/log_*.txt").orderBy("iter").collect()] == [("7", 1, 0.5), ("7", 2, 0.05)]
    assert text.count_rows(spark, f"{tmp_path}/net.txt") == 4 and text.count_files(spark, str(tmp_path)) == 3
    od = text.read_demand(spark, f"{tmp_path}/OD_3.txt")
    sinks.write_demand(od, f"{tmp_path}/out")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/out").collect()) == ["1 2 11.000000", "2 1 0.000000"]
    sinks.write_flow(text.with_free_flow(arcs), f"{tmp_path}/flow")
    assert spark.read.text(f"{tmp_path}/flow").count() == 3
    assert text.read_matrix(spark, f"{tmp_path}/net.txt", 4).count() == 3


def test_streamed_demand(spark, tmp_path):
    from arterial.streaming.demand import windowed_demand

    rows = [("2024-01-01 00:01:00", 1, 2), ("2024-01-01 00:02:00", 1, 2), ("2024-01-01 00:20:00", 2, 1), ("2024-01-01 00:21:00", 2, 2)]
    trips = spark.createDataFrame(rows, "ts string, o int, d int").withColumn("ts", F.to_timestamp("ts"))
    trips.write.parquet(f"{tmp_path}/trips")
    stream = windowed_demand(spark.readStream.schema(trips.schema).parquet(f"{tmp_path}/trips"))
    q = stream.writeStream.outputMode("append").format("memory").queryName("demand").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = {(r.scenario_id, r.o, r.d, r.demand) for r in windowed_demand(trips).collect()}
    assert batch == {("2024-01-01 00:00:00", 1, 2, 2.0), ("2024-01-01 00:15:00", 2, 1, 1.0)}
    assert {(r.scenario_id, r.o, r.d, r.demand) for r in spark.sql("select * from demand").collect()} <= batch


def test_large_way_equals_small_way(spark, arcs, od, monkeypatch):
    """Trees and loading by joins give the rows of the one-task way."""
    sources = graph.origins(od)
    spt = graph.shortest_paths(arcs, sources)
    small = (sorted(map(str, spt.collect())), sorted((r.o, r.arc_id, r.x) for r in graph.tree_flows(od, spt, arcs).collect()))
    monkeypatch.setattr(graph, "TASK_LINKS", 3)
    joined = graph.shortest_paths(arcs, sources)
    assert (sorted(map(str, joined.select(*spt.columns).collect())), sorted((r.o, r.arc_id, r.x) for r in graph.tree_flows(od, joined, arcs).collect())) == small
    assert graph.shortest_paths(arcs.limit(0), sources).count() == 4 and graph.shortest_paths(arcs, sources.limit(0)).count() == 0
    assert graph.tree_flows(od.limit(0), spt, arcs).count() == graph.walks(od.limit(0), spt, arcs).count() == 0


def test_bush_operators_equal_the_kernels(spark, arcs, od):
    net = network(PAIR_LIST)
    flows, _ = kernels.bushes(net, 1e-3)
    label = net.labels.tolist()
    oflow = spark.createDataFrame([("0", label[o], a, float(x)) for o, f in flows.items() for a, x in enumerate(f) if x > 0], "scenario_id string, o int, arc_id int, x double")
    labels = graph.bush_labels(arcs, oflow, graph.origins(od))
    got = {(r.o, r.node): r for r in labels.collect()}
    parted = {(r.o, r.node): r.divergence for r in graph.divergences(arcs, labels).collect()}
    checked = 0
    for o, own in flows.items():
        bush = set(np.flatnonzero(own > 0).tolist())
        low, high, short, long = kernels.bush_labels(net, bush, kernels.topological_order(net, bush, o), net.t0.tolist())
        for v, name in enumerate(label):
            if np.isfinite(low[v]):
                r = got[label[o], name]
                assert (r.low, r.high) == (pytest.approx(low[v]), pytest.approx(high[v]))
                if r.short_arc is not None and r.short_arc != r.long_arc and (r.short_arc, r.long_arc) == (short[v], long[v]):
                    one, _ = kernels.segments_at(net, short, long, v)
                    if one:
                        assert parted[label[o], name] == label[int(net.tail[one[-1]])]
                        checked += 1
    assert checked > 5
    use = {(r.o, r.d, r.arc_id): r.p for r in graph.link_use(arcs, oflow, od).collect()}
    for o, own in flows.items():
        for d in net.demand[o]:
            want = kernels.link_use(net, set(np.flatnonzero(own > 0).tolist()), own, o, d)
            assert all(use.get((label[o], label[d], a), 0.0) == pytest.approx(p) for a, p in enumerate(want))
    with pytest.raises(ValueError, match="cycle"):
        graph.bush_labels(arcs, graph.origins(od).join(arcs, "scenario_id").select("scenario_id", "o", "arc_id"), graph.origins(od))


def test_paired_segments_equal_the_kernel(spark, arcs, od):
    net = network(PAIR_LIST)
    flows, _ = kernels.frank_wolfe(net, 1e-9, 3)
    label, x = net.labels.tolist(), np.sum(list(flows.values()), axis=0)
    cost = net.cost(x)
    oflow = spark.createDataFrame([("0", label[o], a, float(f)) for o, own in flows.items() for a, f in enumerate(own) if f > 0], "scenario_id string, o int, arc_id int, x double")
    priced = spark.createDataFrame([(*r, float(c)) for r, c in zip(grid(), cost)], LINKS + ", cost double")
    spt = graph.shortest_paths(priced, graph.origins(od), "cost")
    want = {}
    for o, own in flows.items():
        _, pred = net.tree(o, cost)
        for a in np.flatnonzero(own > 1e-9).tolist():
            if pred[net.head[a]] != a:
                want[label[o], a] = kernels.find_pas(net, own.tolist(), pred, a)
    asked = spark.createDataFrame([("0", o, a) for o, a in want], "scenario_id string, o int, arc_id int")
    found = graph.paired_segments(arcs, spt, oflow, asked)
    got = {(r.o, r.arc_id): (tuple(r.s1), tuple(r.s2)) for r in found.collect()}
    assert got == {k: v for k, v in want.items() if v} and len(got) > 5
    pas = found.select("scenario_id", "o", "s1", "s2")
    assert graph.dead_pas(pas, oflow).count() == 0 and graph.dead_pas(pas, oflow.limit(0)).count() == pas.count()


def test_small_relational_operators(spark, arcs, od):
    assert graph.max_node(arcs).first().max_node == 25
    bush = arcs.filter("u < 4").withColumn("o", F.lit(1)).select("scenario_id", "o", "arc_id", "u", "v")
    assert graph.broken_bush_arcs(bush, arcs).count() == 0 and graph.broken_bush_arcs(bush.withColumn("v", F.col("u")), arcs).count() == bush.count()
    assert graph.subgraph(arcs, bush).count() == bush.count()
    prices = metrics.link_prices(arcs, graph.nodes(arcs).select("scenario_id", F.lit(1).alias("o"), "node", F.col("node").cast("double").alias("value")))
    assert prices.join(arcs, ["scenario_id", "arc_id"]).filter("difference != u - v or at_tail != u").count() == 0 and prices.count() == 80
    assert metrics.at_least(od, 501.0).count() == 0 and metrics.at_least(od).count() == 12
    matrix = generate.random_matrix(spark, 40, 3, 7, seed=2).collect()
    assert {r.o for r in matrix} == set(range(40)) and all(r.o != r.d and 0 <= r.d < 40 and r.demand >= 3 for r in matrix)
    assert generate.random_matrix(spark, 1, 3, 7).count() == 0


def test_warm_start_and_logs(spark, arcs, od):
    first = solvers.assign_by_origin(arcs, od, "bush", target=1e-8)
    more = od.withColumn("demand", F.lit(600.0))
    cold = solvers.convergence(arcs, more, "bush", target=1e-6)
    warm = solvers.convergence(arcs, more, "bush", start=first, target=1e-6)
    assert warm.columns[-1] == "seconds" and warm.filter("seconds < 0").count() == 0
    assert warm.first().gap < cold.first().gap
    x = lambda frame: np.array([r.x for r in frame.orderBy("arc_id").collect()])
    less = od.withColumn("demand", F.lit(400.0))
    for q in (more, less):
        assert np.allclose(x(solvers.assign(arcs, q, "bush", start=first, target=1e-9)), x(solvers.assign(arcs, q, "bush", target=1e-9)), atol=0.1)
    with pytest.raises(ValueError, match="go on"):
        solvers.assign(arcs, od, "fw", start=first)


def test_relational_multipliers_equal_the_kernel(spark):
    links = spark.createDataFrame([("0", i, u, v, 10.0, t) for i, (u, v, t) in enumerate([(1, 2, 1.0), (2, 4, 1.0), (1, 3, 1.2), (3, 4, 1.0), (1, 4, 2.5)])], LINKS)
    demand = spark.createDataFrame([("0", 1, 4, 20.0)], PAIRS)
    got = {r.arc_id: r.x for r in solvers.multipliers_relational(links, demand, rounds=2, rho=0.1).collect()}
    rows = links.toPandas()
    net = kernels.Network.of(*(rows[c] for c in ("u", "v", "capacity", "t0")), [1], [4], [20.0])
    flows, _ = kernels.multipliers(net, 0.0, 2, rho=0.1)
    assert [got[a] for a in range(5)] == pytest.approx(flows[0].tolist())
