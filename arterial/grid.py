"""A small network on which equilibria are known, for queries and tests.

Fixed values: the 5 x 5 grid. Free-flow times of its two-way links, by their
smaller and then their larger node; and the links of capacity 200, all others
having 300. Every pair of four nodes has one demand.
"""

from __future__ import annotations

SIDE = 5
TIMES = """
3.72 3.72 5.4 4.02 3.3 1.37 4.98 3.09 4.59 4.17 4.32 4.02 4.11 5.55 1.41 4.53 4.11 3.42 1.23 4.35
1.85 5.49 1.89 2.15 1.03 5.46 6.09 3.09 5.58 4.5 4.02 5.94 1.79 2.97 5.85 4.05 5.76 4.44 5.1 3
"""
NARROW = {(3, 8), (8, 13), (11, 12), (12, 13), (13, 14), (13, 18), (14, 15), (18, 23)}
#: Capacities are equal both ways but for this link.
WIDE = {(15, 14)}
ENDS = (7, 9, 17, 19)

#: Demand of each pair; total time and objective at equilibrium,
#: total time at the optimum and objective there, to a tenth.
EQUILIBRIA = {
    500.0: (151820.5, 97334.4, 137654.1, 100765.5),
    600.0: (234492.1, 131593.8, 223791.3, 133853.2),
}

LINKS = "scenario_id string, arc_id int, u int, v int, capacity double, t0 double"
PAIRS = "scenario_id string, o int, d int, demand double"


def links(scenario: str = "0") -> list[tuple]:
    rows, times = [], iter(map(float, TIMES.split()))
    for n in range(1, SIDE * SIDE + 1):
        for m in (n + 1 if n % SIDE else None, n + SIDE if n + SIDE <= SIDE * SIDE else None):
            if m:
                t = next(times)
                for a, b in ((n, m), (m, n)):
                    rows.append((a, b, 200.0 if (n, m) in NARROW and (a, b) not in WIDE else 300.0, t))
    return [(scenario, i, *r) for i, r in enumerate(sorted(rows))]


def pairs(demand: float, scenario: str = "0") -> list[tuple]:
    return [(scenario, o, d, demand) for o in ENDS for d in ENDS if o != d]
