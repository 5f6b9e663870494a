"""Sequential solvers of one scenario in numpy, for use in grouped operators.

A scenario is small (a network and its demand); scenarios run in parallel. All
solvers return flows by origin and a log of (iteration, gap, relative change,
CPU seconds of the iteration).
"""

from __future__ import annotations

import heapq
import time
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np

from arterial.functions.cost import ALPHA, BETA

EPS = 1e-9


class Unreachable(ValueError):
    """Pairs without a path."""


def dijkstra(out: dict[int, list[tuple[int, int, float]]], origin: int) -> tuple[dict[int, float], dict[int, int]]:
    """Distance and incoming link of the nodes reached, by label, from links
    (head, arc_id, cost) by tail; of equal ways, by the smaller arc_id."""
    dist, pred, done = {origin: 0.0}, {}, set()
    heap = [(0.0, origin)]
    while heap:
        at, u = heapq.heappop(heap)
        if u in done:
            continue
        done.add(u)
        for v, arc, cost in out.get(u, ()):
            if v is None or cost is None:
                continue
            new, had = at + cost, dist.get(v)
            if had is None or new < had or (new == had and v not in done and arc < pred[v]):
                dist[v], pred[v] = new, arc
                heapq.heappush(heap, (new, v))
    return dist, pred


def push_up(tree: dict[int, tuple[int, int]], demand: dict[int, float]) -> dict[int, float]:
    """Flow of each link of a tree, node to (tail, link), under the demand."""
    waits: dict[int, int] = {}
    for u, _ in tree.values():
        waits[u] = waits.get(u, 0) + 1
    mass, flow = dict(demand), {}
    ready = [n for n in tree if n not in waits]
    while ready:
        n = ready.pop()
        if n not in tree:
            continue
        u, arc = tree[n]
        if q := mass.get(n, 0.0):
            flow[arc] = q
            mass[u] = mass.get(u, 0.0) + q
        waits[u] -= 1
        if not waits[u]:
            ready.append(u)
    return flow


@dataclass
class Network:
    """Links with ends as places 0.., and demand by origin place."""

    tail: np.ndarray
    head: np.ndarray
    capacity: np.ndarray
    t0: np.ndarray
    demand: dict[int, dict[int, float]]
    labels: np.ndarray
    alpha: float = ALPHA
    beta: float = BETA
    system: bool = False
    out: list[list[int]] = field(init=False)
    into: list[list[int]] = field(init=False)

    def __post_init__(self) -> None:
        n = len(self.labels)
        self.caps, self.t0s, self.tails = self.capacity.tolist(), self.t0.tolist(), self.tail.tolist()
        self.factor = self.alpha * (1 + self.beta) if self.system else self.alpha
        self.out, self.into = [[] for _ in range(n)], [[] for _ in range(n)]
        for a, (u, v) in enumerate(zip(self.tail.tolist(), self.head.tolist())):
            self.out[u].append(a)
            self.into[v].append(a)

    @staticmethod
    def of(u, v, capacity, t0, o, d, demand, skip: bool = False, **options) -> Network:
        """From plain columns. Pairs without a path raise, or are left out."""
        labels, places = np.unique(np.concatenate([u, v]), return_inverse=True)
        at = {int(label): i for i, label in enumerate(labels)}
        pairs: dict[int, dict[int, float]] = {}
        lost = []
        for a, b, q in zip(o, d, demand):
            if q > 0 and a != b:
                if int(a) in at and int(b) in at:
                    own = pairs.setdefault(at[int(a)], {})
                    own[at[int(b)]] = own.get(at[int(b)], 0.0) + float(q)
                else:
                    lost.append((int(a), int(b)))
        net = Network(places[: len(u)], places[len(u) :], np.asarray(capacity, float), np.asarray(t0, float), pairs, labels, **options)
        for a in sorted(pairs):
            dist, _ = net.tree(a, net.t0)
            for b in [b for b in pairs[a] if not np.isfinite(dist[b])]:
                lost.append((int(labels[a]), int(labels[b])))
                del pairs[a][b]
        if lost and not skip:
            raise Unreachable(f"no path for {lost[:20]}")
        net.demand = {a: q for a, q in sorted(pairs.items()) if q}
        return net

    def cost(self, x: np.ndarray, arcs=slice(None)) -> np.ndarray:
        a = self.alpha * (1 + self.beta) if self.system else self.alpha
        cap = self.capacity[arcs]
        s = np.divide(x, cap, out=np.zeros_like(x), where=cap > 0)
        return self.t0[arcs] * (1 + a * s**self.beta)

    def slope(self, x: np.ndarray, arcs=slice(None)) -> np.ndarray:
        a = self.alpha * (1 + self.beta) if self.system else self.alpha
        cap = self.capacity[arcs]
        s = np.divide(x, cap, out=np.zeros_like(x), where=cap > 0)
        return np.divide(self.t0[arcs] * a * self.beta * s ** (self.beta - 1), cap, out=np.zeros_like(x), where=cap > 0)

    def objective(self, x: np.ndarray) -> float:
        a = self.alpha * (1 + self.beta) if self.system else self.alpha
        s = np.divide(x, self.capacity, out=np.zeros_like(x), where=self.capacity > 0)
        return float((x * self.t0 * (1 + a / (self.beta + 1) * s**self.beta)).sum())

    def tree(self, origin: int, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Dijkstra: distance and incoming link of every node (-1: none)."""
        dist, pred = np.full(len(self.labels), np.inf), np.full(len(self.labels), -1)
        dist[origin] = 0.0
        heap, done = [(0.0, origin)], set()
        costs, heads = cost.tolist(), self.head.tolist()
        while heap:
            at, u = heapq.heappop(heap)
            if u in done:
                continue
            done.add(u)
            for a in self.out[u]:
                v, new = heads[a], at + costs[a]
                if new < dist[v] or (new == dist[v] and v not in done and a < pred[v]):
                    dist[v], pred[v] = new, a
                    heapq.heappush(heap, (new, v))
        return dist, pred

    def path(self, pred: np.ndarray, node: int) -> list[int]:
        """Links from the root of the tree to the node."""
        out = []
        while pred[node] >= 0:
            out.append(int(pred[node]))
            node = int(self.tail[pred[node]])
        return out[::-1]

    def load(self, cost: np.ndarray) -> dict[int, np.ndarray]:
        """All-or-nothing flows by origin."""
        out = {}
        for o, own in self.demand.items():
            _, pred = self.tree(o, cost)
            out[o] = np.zeros(len(self.t0))
            for d, q in own.items():
                out[o][self.path(pred, d)] += q
        return out

    def gap(self, x: np.ndarray) -> float:
        c = self.cost(x)
        total = float((x * c).sum())
        if total <= 0:
            return 0.0
        least = sum(q * float(dist[d]) for o, own in self.demand.items() for dist in (self.tree(o, c)[0],) for d, q in own.items())
        return 1 - least / total


Flows = dict[int, np.ndarray]


class Log(list):
    """Rows (iteration, gap, relative change, seconds)."""

    def __init__(self) -> None:
        super().__init__()
        self.at = time.process_time()

    def note(self, i: int, gap: float) -> None:
        before = self[-1][1] if self else None
        change = 1.0 if before is None else abs(before - gap) / before if before else 0.0
        now = time.process_time()
        self.append((i, gap, change, now - self.at))
        self.at = now


def _total(net: Network, flows: Flows) -> np.ndarray:
    return np.sum([*flows.values(), np.zeros(len(net.t0))], axis=0)


def frank_wolfe(net: Network, target: float = 1e-4, max_iter: int = 1000) -> tuple[Flows, Log]:
    """Conjugate directions: each target point is mixed with the last one so
    that the direction is conjugate to the last; exact line search by bisection
    of the objective's slope."""
    flows, log = net.load(net.cost(np.zeros(len(net.t0)))), Log()
    last: Flows | None = None
    for i in range(1, max_iter + 1):
        x = _total(net, flows)
        log.note(i, net.gap(x))
        if log[-1][1] < target:
            break
        best = net.load(net.cost(x))
        if last is not None:
            h, y, s = net.slope(x), _total(net, best), _total(net, last)
            up, down = ((s - x) * h * (y - x)).sum(), ((s - x) * h * (y - s)).sum()
            mix = min(max(up / down, 0.0), 0.99) if down else 0.0
            best = {o: mix * last[o] + (1 - mix) * f for o, f in best.items()}
        d = _total(net, best) - x
        if (net.cost(x) * d).sum() > 0:
            if last is None:
                raise ArithmeticError("the direction does not descend")
            last = None  # a mix of directions may lead up: the next one is not mixed
            continue
        low, high = 0.0, 1.0
        for _ in range(50):
            mid = (low + high) / 2
            low, high = (mid, high) if (net.cost(x + mid * d) * d).sum() < 0 else (low, mid)
        flows = {o: f + low * (best[o] - f) for o, f in flows.items()}
        last = None if low > 0.999 else best
    return flows, log


def find_pas(net: Network, own: Sequence[float], pred: np.ndarray, arc: int) -> tuple[tuple[int, ...], tuple[int, ...]] | None:
    """The two segments that end at the link's head: along the tree, and back
    from the link along the origin's busiest links until they meet the tree."""
    head = int(net.head[arc])
    tree = net.path(pred, head)
    place = {int(net.tail[a]): i for i, a in enumerate(tree)}
    back, node, seen = [arc], int(net.tail[arc]), {head}
    while node not in place:
        if node in seen:
            return None
        seen.add(node)
        a = max(net.into[node], key=lambda a: (own[a], -a), default=-1)
        if a < 0 or own[a] <= EPS:
            return None
        back.append(a)
        node = int(net.tail[a])
    return tuple(tree[place[node] :]), tuple(back[::-1])


def shift_pas(net: Network, x: list[float], cost: list[float], own: list[float], s1: Sequence[int], s2: Sequence[int], steps: int = 1) -> float:
    """At most ``steps`` Newton steps from the dearer segment to the cheaper
    one, each clamped to what the origin has there; what the first moves.
    Segments are a few links long: plain numbers are faster here than arrays."""
    first = _newton(net, x, cost, own, s1, s2)
    for _ in range(steps - 1):
        if _newton(net, x, cost, own, s1, s2) <= 1e-3 * first:
            break
    return first


def _newton(net: Network, x: list[float], cost: list[float], own: list[float], s1: Sequence[int], s2: Sequence[int]) -> float:
    gain = sum([cost[i] for i in s2]) - sum([cost[i] for i in s1])
    a, b = (s1, s2) if gain >= 0 else (s2, s1)
    room = min([own[i] for i in b])
    if room <= 0 or gain == 0:
        return 0.0
    cap, t0, alpha, beta = net.caps, net.t0s, net.factor, net.beta
    curve = sum([t0[i] * alpha * beta * (x[i] / cap[i]) ** (beta - 1) / cap[i] for s in (a, b) for i in s if cap[i] > 0])
    move = room if curve <= 0 else min(abs(gain) / curve, room)
    for s, step in ((a, move), (b, -move)):
        for i in s:
            x[i] = max(x[i] + step, 0.0)
            own[i] = max(own[i] + step, 0.0)
            cost[i] = t0[i] * (1 + alpha * (x[i] / cap[i]) ** beta) if cap[i] > 0 else t0[i]
    return move


def paired_segments(net: Network, target: float = 1e-10, max_iter: int = 100, sweeps: int = 20, start: Flows | None = None) -> tuple[Flows, Log]:
    first = start or net.load(net.cost(np.zeros(len(net.t0))))
    flows = {o: f.tolist() for o, f in first.items()}
    log = Log()
    pas: dict[tuple, None] = {}
    arrays = lambda: {o: np.array(f) for o, f in flows.items()}
    x = _total(net, first).tolist()
    for i in range(1, max_iter + 1):
        for o, own in flows.items():
            now = net.cost(np.array(x))
            dist, pred = net.tree(o, now)
            cost, reduced, held = now.tolist(), now + dist[net.tail] - dist[net.head], np.array(own)
            # from small tails on, and from large heads of one tail
            for arc in sorted(np.flatnonzero((held > EPS) & (reduced > EPS)).tolist(), key=lambda a: (net.tails[a], -net.head[a])):
                if own[arc] > EPS and (found := find_pas(net, own, pred, arc)):
                    pas[(o, *found)] = None
                    shift_pas(net, x, cost, own, *found)
        cost = net.cost(np.array(x)).tolist()
        for _ in range(sweeps):
            for o, s1, s2 in list(pas):
                own = flows[o]
                if max(min([own[a] for a in s1]), min([own[a] for a in s2])) < EPS:
                    del pas[(o, s1, s2)]
                else:
                    shift_pas(net, x, cost, own, s1, s2)
        total = _total(net, arrays())
        x = total.tolist()
        log.note(i, net.gap(total))
        if log[-1][1] < target:
            break
    return arrays(), log


def topological_order(net: Network, arcs: set[int], origin: int) -> list[int]:
    """Nodes of a bush, origin first; raises if it has a cycle."""
    need = {}
    for a in arcs:
        need[int(net.head[a])] = need.get(int(net.head[a]), 0) + 1
    order, ready = [], [origin]
    while ready:
        u = ready.pop()
        order.append(u)
        for a in net.out[u]:
            if a in arcs:
                v = int(net.head[a])
                need[v] -= 1
                if not need[v]:
                    ready.append(v)
    if any(need.values()):
        raise ValueError("the bush has a cycle")
    return order


def bush_labels(net: Network, arcs: set[int], order: list[int], cost: list[float], own: list[float] | None = None):
    """Shortest and longest distance with incoming links over a bush; with own
    flows, the longest goes over links with flow only."""
    n, tail = len(net.labels), net.tails
    low, high = [np.inf] * n, [-np.inf] * n
    short, long = [-1] * n, [-1] * n
    low[order[0]] = high[order[0]] = 0.0
    for v in order[1:]:
        for a in net.into[v]:
            if a in arcs:
                u = tail[a]
                if low[u] + cost[a] < low[v]:
                    low[v], short[v] = low[u] + cost[a], a
                if (own is None or own[a] > 0) and high[u] + cost[a] > high[v]:
                    high[v], long[v] = high[u] + cost[a], a
    return low, high, short, long


def segments_at(net: Network, short: list[int], long: list[int], node: int) -> tuple[list[int], list[int]]:
    """Links of the shortest and the longest path since they last parted."""
    on_short, v = {node: 0}, node
    one: list[int] = []
    while short[v] >= 0:
        one.append(short[v])
        v = net.tails[short[v]]
        on_short[v] = len(one)
    two: list[int] = []
    v = node
    while long[v] >= 0:
        two.append(long[v])
        v = net.tails[long[v]]
        if v in on_short:
            return one[: on_short[v]], two
    return [], []


def bushes(net: Network, target: float = 1e-10, max_iter: int = 500, inner: int = 6, steps: int = 4, start: Flows | None = None) -> tuple[Flows, Log]:
    first = dict(start or net.load(net.cost(np.zeros(len(net.t0)))))
    base = net.cost(_total(net, start or {}))
    log = Log()
    arcs: dict[int, set[int]] = {}
    for o, own in first.items():
        _, pred = net.tree(o, base)
        way = {int(a) for a in pred if a >= 0}
        arcs[o] = way | set(np.flatnonzero(own > 0).tolist())
        try:
            topological_order(net, arcs[o], o)
        except ValueError:  # the flows to start from go round: this origin begins anew
            arcs[o], first[o] = way, np.zeros(len(net.t0))
            for d, q in net.demand[o].items():
                first[o][net.path(pred, d)] += q
    flows = {o: f.tolist() for o, f in first.items()}
    x = _total(net, first).tolist()
    tail, head = net.tail.tolist(), net.head.tolist()
    for i in range(1, max_iter + 1):
        for o, own in flows.items():
            bush, cost = arcs[o], net.cost(np.array(x)).tolist()
            _, _, short, _ = bush_labels(net, bush, topological_order(net, bush, o), cost)
            keep = {a for a in short if a >= 0}
            bush = {a for a in bush if own[a] > 0 or a in keep}
            _, high, _, _ = bush_labels(net, bush, topological_order(net, bush, o), cost)
            # links that would shorten the longest way; such a bush has no cycle
            bush |= {a for a, c in enumerate(cost) if high[tail[a]] > -np.inf and high[tail[a]] + c < high[head[a]] - 1e-14}
            arcs[o] = bush
            order = topological_order(net, bush, o)
            for _ in range(inner):
                moved = 0.0
                _, _, short, long = bush_labels(net, bush, order, cost, own)
                for v in reversed(order):
                    s1, s2 = segments_at(net, short, long, v)
                    if s1 and s2 and s1 != s2 and sum([cost[a] for a in s2]) > sum([cost[a] for a in s1]):
                        moved = max(moved, shift_pas(net, x, cost, own, s1, s2, steps))
                for a, f in enumerate(own):
                    if 0 < f < 1e-13:
                        own[a] = 0.0
                if moved < 1e-12:
                    break
        total = _total(net, {o: np.array(f) for o, f in flows.items()})
        x = total.tolist()
        log.note(i, net.gap(total))
        if log[-1][1] < target:
            break
    return {o: np.array(f) for o, f in flows.items()}, log


def colours(tail: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Greedy colouring: in order, the least colour free at both ends."""
    taken: dict[int, set[int]] = {}
    out = []
    for u, v in zip(tail.tolist(), head.tolist()):
        used = taken.setdefault(u, set()) | taken.setdefault(v, set())
        c = next(c for c in range(len(used) + 1) if c not in used)
        taken[u].add(c)
        taken[v].add(c)
        out.append(c)
    return np.array(out, int)


def multipliers(net: Network, target: float = 1e-4, max_iter: int = 1000, rho: float | None = 0.01) -> tuple[Flows, Log]:
    """Alternating directions: all links of one colour share no node, so they
    take their projected Newton steps at once; the gap is of absolute value.
    The penalty rho weighs flows against costs; None sets it to five times the
    links' mean cost slope at capacity."""
    starts = list(net.demand)
    g = np.zeros((len(starts), len(net.labels)))
    for i, o in enumerate(starts):
        for d, q in net.demand[o].items():
            g[i, o] += q
            g[i, d] -= q
    x, dual, bal = np.zeros((len(starts), len(net.t0))), np.zeros_like(g), np.zeros_like(g)
    if rho is None:
        rho = 5 * float(np.mean(net.slope(net.capacity))) if len(net.t0) else 1.0
    colour = colours(net.tail, net.head)
    blocks = [np.flatnonzero(colour == k) for k in range(colour.max(initial=-1) + 1)]
    log = Log()
    for i in range(1, max_iter + 1):
        for a in blocks:
            u, v, total = net.tail[a], net.head[a], x[:, a].sum(axis=0)
            price = dual[:, u] - dual[:, v] + rho * ((bal - g)[:, u] - (bal - g)[:, v])
            curve = net.slope(total, a) + 2 * rho
            step = np.where(curve < EPS, 0.0, (net.cost(total, a) + price) / np.maximum(curve, EPS))
            new = np.maximum(x[:, a] - step, 0)
            change = new - x[:, a]
            x[:, a] = new
            bal[:, u] += change
            bal[:, v] -= change
        dual += rho * (bal - g)
        log.note(i, abs(net.gap(x.sum(axis=0))))
        if log[-1][1] < target and np.abs(bal - g).max(initial=0) < 1e-2 * max(1.0, np.abs(g).max(initial=0)):
            break
    return {o: x[i] for i, o in enumerate(starts)}, log


def link_use(net: Network, arcs: set[int], own: np.ndarray, origin: int, target: int) -> np.ndarray:
    """Probability that a trip from the origin to the target uses each link:
    flow shares are multiplied back from the target, nodes in reverse order."""
    use, reach = np.zeros(len(net.t0)), np.zeros(len(net.labels))
    reach[target] = 1.0
    # links that a rounding rest of flow leaves apart from the others take no part
    seen, todo = {origin}, [origin]
    while todo:
        for a in net.out[todo.pop()]:
            if a in arcs and int(net.head[a]) not in seen:
                seen.add(int(net.head[a]))
                todo.append(int(net.head[a]))
    arcs = {a for a in arcs if net.tails[a] in seen}
    for v in reversed(topological_order(net, arcs, origin)):
        into = [a for a in net.into[v] if a in arcs]
        total = own[into].sum() if into else 0.0
        if reach[v] and total > 0 and v != origin:
            for a in into:
                use[a] = reach[v] * own[a] / total
                reach[net.tail[a]] += use[a]
    return use


def continued(net: Network, start: Flows) -> Flows:
    """Flows to go on from: those of ``start``, and on the shortest ways what
    demand has beyond them. Origins of which some demand fell begin anew."""
    fresh: Flows = {}
    cost = net.cost(_total(net, {o: f for o, f in start.items() if o in net.demand}))
    for o, own in net.demand.items():
        flow = start.get(o)
        _, pred = net.tree(o, cost)
        if flow is not None:
            arrived = np.bincount(net.head, flow, len(net.labels)) - np.bincount(net.tail, flow, len(net.labels))
            arrived[o] = 0.0
            more = {d: own.get(d, 0.0) - float(arrived[d]) for d in {*own, *np.flatnonzero(np.abs(arrived) > 1e-7).tolist()}}
        if flow is None or min(more.values()) < -1e-6:
            flow, more = np.zeros(len(net.t0)), own
        fresh[o] = flow.astype(float)
        for d, q in more.items():
            if q > 0:
                fresh[o][net.path(pred, d)] += q
    return fresh


METHODS = {"fw": frank_wolfe, "pas": paired_segments, "bush": bushes, "admm": multipliers}
