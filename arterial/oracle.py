"""The queries' SQL for DuckDB, on the same tables."""

from __future__ import annotations

from arterial import grid

ARCS = """
arcs AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY u, v) - 1 AS INTEGER) AS arc_id, u, v, q / 20.0 AS capacity, CAST(1 + n % 7 AS DOUBLE) AS t0
  FROM (SELECT c_nationkey AS u, CAST(l_partkey % 25 AS INTEGER) AS v, CAST(sum(l_quantity) AS DOUBLE) AS q, count(*) AS n
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        WHERE l_partkey % 25 <> c_nationkey
        GROUP BY c_nationkey, l_partkey % 25))"""
OD = """
od AS MATERIALIZED (
  SELECT c_nationkey AS o, CAST(o_orderkey % 25 AS INTEGER) AS d, CAST(count(*) AS DOUBLE) AS demand
  FROM orders JOIN customer ON o_custkey = c_custkey
  WHERE c_nationkey <> o_orderkey % 25
  GROUP BY c_nationkey, o_orderkey % 25)"""
LOADED = "flow AS (SELECT *, capacity * (1 + arc_id % 5) / 2 AS x FROM arcs)"
SPREAD = "spread AS (SELECT k.o, arc_id, v, CAST((arc_id * 7 + k.o * 3) % 11 AS DOUBLE) AS x FROM arcs, (SELECT unnest(range(4)) AS o) k)"
BPR = "t0 * (1 + 0.15 * pow(x / capacity, 4))"
BECKMANN = "x * t0 * (1 + 0.03 * pow(x / capacity, 4))"


def with_(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


def tree(name: str, links: str, cost: str, hops: int = 24) -> str:
    """CTEs name (o, node, dist) and name_pred (o, node, arc_id) by rounds of min-plus."""
    out = [f"{name}0 AS MATERIALIZED (SELECT DISTINCT o, o AS node, CAST(0 AS DOUBLE) AS dist FROM od)"]
    for i in range(hops):
        out.append(
            f"{name}{i + 1} AS MATERIALIZED (SELECT o, node, min(dist) AS dist FROM (SELECT * FROM {name}{i} UNION ALL "
            f"SELECT h.o, a.v, h.dist + a.{cost} FROM {name}{i} h JOIN {links} a ON a.u = h.node) GROUP BY o, node)"
        )
    out.append(f"{name} AS MATERIALIZED (SELECT * FROM {name}{hops})")
    out.append(
        f"{name}_pred AS MATERIALIZED (SELECT hv.o, hv.node, min(a.arc_id) AS arc_id FROM {name} hu JOIN {links} a ON a.u = hu.node "
        f"JOIN {name} hv ON hv.o = hu.o AND hv.node = a.v AND hv.dist = hu.dist + a.{cost} WHERE hv.node <> hv.o GROUP BY hv.o, hv.node)"
    )
    return ",\n".join(out)


SPT = tree("spt", "arcs", "t0", 12)
WALK = """
walk AS (
  SELECT o, d, demand, d AS node, CAST(NULL AS INTEGER) AS arc_id, 0 AS step FROM od
  UNION ALL
  SELECT w.o, w.d, w.demand, a.u, a.arc_id, w.step + 1 FROM walk w JOIN spt_pred p ON p.o = w.o AND p.node = w.node JOIN arcs a ON a.arc_id = p.arc_id),
oflow AS MATERIALIZED (SELECT o, arc_id, sum(demand) AS x FROM walk WHERE step > 0 GROUP BY o, arc_id)"""
AON = f"""
aon AS MATERIALIZED (
  SELECT *, {BPR} AS cost FROM (SELECT a.*, coalesce(f.x, 0) AS x FROM arcs a LEFT JOIN (SELECT arc_id, sum(x) AS x FROM oflow GROUP BY arc_id) f USING (arc_id)))"""
NET = with_(ARCS, OD)
TREE = with_(ARCS, OD, SPT)
FLOW = with_(ARCS, OD, SPT, WALK, AON)
REDUCED = "red AS (SELECT s.o, a.arc_id, a.u, a.v, a.t0 + s.dist - h.dist AS reduced, s.dist AS du, h.dist AS dv FROM arcs a JOIN spt s ON s.node = a.u JOIN spt h ON h.o = s.o AND h.node = a.v)"
BUSH = "bush AS (SELECT o, arc_id FROM oflow UNION SELECT o, arc_id FROM spt_pred), added AS (SELECT o, arc_id FROM red WHERE du < dv EXCEPT SELECT o, arc_id FROM bush)"
IMBALANCE = "imb AS (SELECT o, node, sum(s) AS s FROM (SELECT f.o, a.u AS node, f.x AS s FROM oflow f JOIN arcs a USING (arc_id) UNION ALL SELECT f.o, a.v, -f.x FROM oflow f JOIN arcs a USING (arc_id)) GROUP BY o, node)"
SUPPLY = "sup AS (SELECT o, node, sum(g) AS g FROM (SELECT o, o AS node, demand AS g FROM od UNION ALL SELECT o, d, -demand FROM od) GROUP BY o, node)"
PAS = """
pas AS (SELECT arc_id AS pas_id, arc_id % 4 AS o, [(arc_id + 3) % 100, (arc_id + 1) % 100] AS s1, [(arc_id + 2) % 100, (arc_id + 7) % 100, (arc_id + 5) % 100] AS s2 FROM arcs),
keyed AS (SELECT pas_id, CASE WHEN list_sort(s1) <= list_sort(s2)
    THEN concat_ws('|', o, array_to_string(list_sort(s1), ','), array_to_string(list_sort(s2), ','))
    ELSE concat_ws('|', o, array_to_string(list_sort(s2), ','), array_to_string(list_sort(s1), ',')) END AS pas_key FROM pas)"""
LOG = "log AS (SELECT u AS run_id, v AS iter, 1.0::DOUBLE / (1 + v + u) AS gap, t0 AS seconds FROM arcs)"


def known_equilibria() -> str:
    """Fixed values, rounded as the query rounds them."""
    rows = []
    for q, (tstt, objective, best_tstt, best_objective) in grid.EQUILIBRIA.items():
        rows += [(f"{q:g}", m, "false", tstt, objective) for m in ("pas", "bush")]
        rows += [(f"{q:g}", m, "true", best_tstt, best_objective) for m in ("pas", "bush")]
        rows += [(f"{q:g}", m, "false", round(tstt, -2), round(objective, -2)) for m in ("fw", "admm")]
    values = ", ".join(f"('{s}', '{m}', {system}, CAST({t} AS DOUBLE), CAST({b} AS DOUBLE))" for s, m, system, t, b in rows)
    return f"SELECT * FROM (VALUES {values}) x(scenario_id, method, system, tstt, beckmann)"


def oracle_sql() -> dict[str, str]:
    by_link = lambda value, name: with_(ARCS, LOADED) + f"SELECT arc_id, round({value}, 9) AS {name} FROM flow"
    return {
        "arc_scan": NET + "SELECT arc_id, u, v, round(capacity, 6) AS capacity, t0 FROM arcs",
        "od_scan": NET + "SELECT o, d, demand FROM od",
        "od_nested": NET + "SELECT o, CAST(count(*) AS INTEGER) AS n_targets, sum(demand) AS total, string_agg(CAST(d AS VARCHAR), ',' ORDER BY d) AS ds FROM od GROUP BY o",
        "bpr_cost": by_link(BPR, "cost"),
        "bpr_derivative": by_link("t0 * 0.15 * 4 * pow(x / capacity, 3) / capacity", "slope"),
        "marginal_cost": by_link("t0 * (1 + 0.75 * pow(x / capacity, 4))", "cost"),
        "beckmann_terms": by_link(BECKMANN, "term"),
        "node_set": NET + "SELECT u AS node FROM arcs UNION SELECT v FROM arcs",
        "node_degree": NET + "SELECT node, CAST(sum(o) AS BIGINT) AS n_out, CAST(sum(1 - o) AS BIGINT) AS n_in FROM (SELECT u AS node, 1 AS o FROM arcs UNION ALL SELECT v, 0 FROM arcs) GROUP BY node",
        "max_node": NET + "SELECT max(greatest(u, v)) AS max_node FROM arcs",
        "distinct_origins": NET + "SELECT DISTINCT o FROM od",
        "parallel_arcs": NET + "SELECT u, v, count(*) AS n FROM (SELECT u, v FROM arcs UNION ALL SELECT u, v FROM arcs) GROUP BY u, v HAVING count(*) > 1",
        "sssp_freeflow": TREE + "SELECT o, node, dist, coalesce(arc_id, -1) AS pred_arc FROM spt LEFT JOIN spt_pred USING (o, node)",
        "reverse_reachability": with_(
            ARCS, "back AS (SELECT t AS target, t AS node FROM (SELECT u AS t FROM arcs UNION SELECT v FROM arcs) UNION SELECT b.target, a.u FROM back b JOIN arcs a ON a.v = b.node)"
        ) + "SELECT target, node FROM back",
        "od_skim": TREE + "SELECT od.o, d, demand, dist FROM od JOIN spt ON spt.o = od.o AND node = d",
        "sptt": TREE + "SELECT round(sum(demand * dist), 6) AS sptt FROM od JOIN spt ON spt.o = od.o AND node = d",
        "tstt": with_(ARCS, LOADED) + f"SELECT round(sum(x * {BPR}), 4) AS tstt FROM flow",
        "aon_flow": FLOW + "SELECT arc_id, round(x, 6) AS x, round(cost, 6) AS cost FROM aon",
        "path_links": FLOW + "SELECT o, d, arc_id, step, demand FROM walk WHERE step > 0",
        "relative_gap": with_(ARCS, OD, SPT, WALK, AON, tree("far", "aon", "cost"))
        + "SELECT round(t, 4) AS tstt, round(s, 4) AS sptt, round(1 - s / t, 8) AS gap FROM (SELECT sum(x * cost) AS t FROM aon), (SELECT sum(demand * dist) AS s FROM od JOIN far ON far.o = od.o AND node = d)",
        "reduced_cost": with_(ARCS, OD, SPT, REDUCED) + "SELECT o, arc_id, round(reduced, 6) AS reduced FROM red",
        "disequilibrated_arcs": with_(ARCS, OD, SPT, WALK, AON)
        + "SELECT s.o, a.arc_id, round(f.x, 6) AS x, round(a.cost + s.dist - h.dist, 6) AS reduced FROM aon a JOIN oflow f USING (arc_id) JOIN spt s ON s.o = f.o AND s.node = a.u JOIN spt h ON h.o = f.o AND h.node = a.v WHERE f.x > 1e-9 AND a.cost + s.dist - h.dist > 1e-9",
        "semi_reachable_od": with_(
            ARCS, OD, "fwd AS (SELECT DISTINCT o, o AS node FROM od UNION SELECT f.o, a.v FROM fwd f JOIN arcs a ON a.u = f.node)"
        ) + "SELECT o, d, demand FROM od WHERE EXISTS (SELECT 1 FROM fwd WHERE fwd.o = od.o AND fwd.node = od.d)",
        "anti_new_arcs": with_(ARCS, OD, SPT, WALK, REDUCED, BUSH) + "SELECT o, arc_id FROM added",
        "bush_union": with_(ARCS, OD, SPT, WALK, REDUCED, BUSH) + "SELECT o, arc_id FROM bush UNION ALL SELECT o, arc_id FROM added",
        "net_supply": with_(OD, SUPPLY) + "SELECT o, node, g FROM sup",
        "node_imbalance": with_(ARCS, OD, SPT, WALK, IMBALANCE) + "SELECT o, node, round(s, 6) AS out_minus_in FROM imb",
        "primal_residual": with_(ARCS, OD, SPT, WALK, IMBALANCE, SUPPLY) + "SELECT o, node, round(coalesce(s, 0) / 2 - coalesce(g, 0), 6) AS residual FROM imb FULL JOIN sup USING (o, node)",
        "split_fraction": with_(ARCS, SPREAD) + "SELECT CAST(o AS INTEGER) AS o, arc_id, round(x / sum(x) OVER (PARTITION BY o, v), 6) AS fraction FROM spread WHERE x > 0",
        "argmax_pred": with_(ARCS, SPREAD) + "SELECT CAST(o AS INTEGER) AS o, v, arg_max(arc_id, x * 1000 - arc_id) AS arc_id FROM spread WHERE x > 0 GROUP BY o, v",
        "conflict_pairs": NET + "SELECT a.arc_id AS a, b.arc_id AS b FROM arcs a JOIN arcs b ON a.arc_id < b.arc_id AND (a.u = b.u OR a.u = b.v OR a.v = b.u OR a.v = b.v)",
        "pas_key": with_(ARCS, PAS) + "SELECT pas_id, pas_key FROM keyed",
        "pas_dedup": with_(ARCS, PAS) + "SELECT DISTINCT pas_key FROM keyed WHERE pas_key NOT IN (SELECT pas_key FROM keyed JOIN arcs ON arc_id = pas_id WHERE t0 >= 7)",
        "path_cost_bottleneck": with_(ARCS, LOADED, SPREAD, PAS)
        + f"SELECT pas_id, side, round(sum(cost), 6) AS cost, round(sum(slope), 6) AS slope, min(own) AS bottleneck FROM (SELECT s.pas_id, s.side, {BPR} AS cost, t0 * 0.15 * 4 * pow(f.x / capacity, 3) / capacity AS slope, coalesce(w.x, 0) AS own FROM (SELECT pas_id, o, 1 AS side, unnest(s1) AS arc_id FROM pas UNION ALL SELECT pas_id, o, 2, unnest(s2) FROM pas) s JOIN flow f USING (arc_id) LEFT JOIN spread w ON w.o = s.o AND w.arc_id = s.arc_id) GROUP BY pas_id, side".replace(BPR, BPR.replace("x /", "f.x /")),
        "armijo_one_pass": with_(ARCS, LOADED)
        + "SELECT k, round(step, 6) AS step, round(f, 4) AS objective FROM (SELECT CAST(k AS INTEGER) AS k, first(s) AS step, sum((x + s * (y - x)) * t0 * (1 + 0.03 * pow((x + s * (y - x)) / capacity, 4))) AS f, sum("
        + BECKMANN + ") AS f0, sum(" + BPR + " * (y - x)) AS slope FROM (SELECT flow.*, capacity / 2 AS y, k, pow(CAST(0.9 AS DOUBLE), k) AS s FROM flow, (SELECT unnest(range(175)) AS k)) GROUP BY k) WHERE f <= f0 + CAST(0.2 AS DOUBLE) * step * slope ORDER BY k LIMIT 1",
        "largest_change": with_(ARCS, LOADED) + "SELECT round(max(abs(arc_id) / (abs(x) + 1)), 6) AS change FROM flow",
        "efficiency": with_(ARCS, LOADED) + f"SELECT round(sum(x * t0 / ({BPR})) / count(*), 6) AS efficiency FROM flow",
        "congested_od": with_(ARCS, OD, SPT, "slow AS MATERIALIZED (SELECT *, t0 * (1 + arc_id % 6) AS cost FROM arcs)", tree("far", "slow", "cost"))
        + "SELECT od.o, d, far.dist, spt.dist AS ref FROM od JOIN far ON far.o = od.o AND far.node = d JOIN spt ON spt.o = od.o AND spt.node = d WHERE far.dist > 3 * spt.dist",
        "patience": NET + "SELECT arc_id AS step, CAST(sum(CASE WHEN t0 / 7 > 0.7 THEN 1 ELSE 0 END) OVER (ORDER BY arc_id) AS BIGINT) AS hits FROM arcs",
        "entropy": with_(OD) + "SELECT round(sum(demand * log10(demand)), 6) AS entropy FROM od",
        "half_sse": with_(ARCS, LOADED) + "SELECT round(sum(pow(capacity - x, 2)) / 2, 4) AS half_sse FROM flow",
        "ode_objective": with_(ARCS, OD, LOADED) + "SELECT round((SELECT sum(demand * log10(demand)) FROM od) + 0.5 * (SELECT sum(pow(capacity - x, 2)) / 2 FROM flow), 4) AS objective",
        "small_volumes": with_(OD) + "SELECT o, d, demand FROM od WHERE demand >= 20",
        "volume_spacings": NET
        + "SELECT scenario_id, cut, cut - lag(cut, 1, 0) OVER (PARTITION BY scenario_id ORDER BY cut) AS part FROM (SELECT CAST(u AS VARCHAR) AS scenario_id, CAST(arc_id AS DOUBLE) AS cut FROM arcs UNION SELECT CAST(u AS VARCHAR), 1000.0 FROM arcs)",
        "topo_order": with_(ARCS, OD, SPT, "lvl AS (SELECT DISTINCT o, o AS node, 0 AS level FROM od UNION ALL SELECT l.o, p.node, l.level + 1 FROM lvl l JOIN spt_pred p ON p.o = l.o JOIN arcs a ON a.arc_id = p.arc_id AND a.u = l.node)")
        + "SELECT o, node, level FROM lvl",
        "edge_coloring": with_(
            ARCS,
            "near AS MATERIALIZED (SELECT a.arc_id, list(b.arc_id) FILTER (b.arc_id IS NOT NULL) AS others FROM arcs a LEFT JOIN arcs b ON b.arc_id < a.arc_id AND (a.u = b.u OR a.u = b.v OR a.v = b.u OR a.v = b.v) GROUP BY a.arc_id)",
            "painted AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS INTEGER[]) AS colors UNION ALL SELECT n + 1, list_append(colors, CAST(list_min(list_filter(range(100), "
            "lambda k: NOT list_contains(list_transform(coalesce(others, CAST([] AS INTEGER[])), lambda i: colors[i + 1]), k))) AS INTEGER)) FROM painted JOIN near ON arc_id = n)",
            "full_list AS (SELECT colors FROM painted ORDER BY n DESC LIMIT 1)",
        )
        + "SELECT arc_id, colors[arc_id + 1] AS color FROM arcs, full_list",
        "random_od": "SELECT CAST(s AS VARCHAR) AS scenario_id, CAST(10 AS BIGINT) AS pairs, CAST(300 AS DOUBLE) AS total, true AS positive FROM (SELECT unnest(range(100)) AS s)",
        "known_equilibria": known_equilibria(),
        "network_round_trip": NET + "SELECT arc_id, u, v, round(capacity, 6) AS capacity, t0 FROM arcs",
        "demand_round_trip": NET + "SELECT '0' AS scenario_id, o, d, demand FROM od",
        "flow_round_trip": with_(ARCS, LOADED) + "SELECT u, v, round(x, 6) AS x FROM flow",
        "log_round_trip": with_(ARCS, LOG) + "SELECT CAST(run_id AS VARCHAR) AS run_id, iter, round(gap, 6) AS gap, round(coalesce(abs(p - gap) / p, 1), 6) AS rel_change, seconds FROM (SELECT *, lag(gap) OVER (PARTITION BY run_id ORDER BY iter) AS p FROM log)",
        "gap_lag": with_(ARCS, LOG) + "SELECT run_id, iter, round(coalesce(abs(p - gap) / p, 1), 6) AS change FROM (SELECT *, lag(gap) OVER (PARTITION BY run_id ORDER BY iter) AS p FROM log)",
        "first_passage": with_(ARCS, LOG)
        + "SELECT run_id, level, min(iter) AS iter, arg_min(so_far, iter) AS seconds FROM (SELECT *, sum(seconds) OVER (PARTITION BY run_id ORDER BY iter) AS so_far FROM log), (SELECT unnest([CAST(0.1 AS DOUBLE), CAST(0.05 AS DOUBLE)]) AS level) WHERE gap < level GROUP BY run_id, level",
    }
