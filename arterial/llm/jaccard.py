"""N-gram Jaccard join by signature trees.

A document's set holds its distinct n-word shingles (lower-cased A-Z); with
fewer words the whole sequence is its one shingle. Two documents link when
their sets' Jaccard similarity reaches num / den, where shingles are told apart by hashes of 64 bits.

1. Routing. Two sets of at most u shingles that link differ in at most d of
   them, d = 2u (den - num) / (den + num). Shingles are dealt by hash into more
   than d groups, so linked sets agree in some whole group, whose content gives
   a key. Sizes are cut into classes; a set takes part in its own class and, if
   it can link upwards, in the next. Very frequent shingles (by counts of all
   documents, in a table of fixed size) are left out of the groups: that keeps
   the guarantee and stops common passages from linking everything. As linked
   sets agree in several groups, a set leaves out one less than that, those
   with the fewest shingles: by chance, unlike sets agree in such groups. The
   fullest group in which two sets agree is left out by neither. Groups without
   a rare shingle are not used; sets that would need them are dealt into groups
   again with all their shingles, so one of these is what two such sets share.
   Of the sets that share a key, all hang on the smallest: no pairs are made.
   Keys, and later the clusters' texts, are shuffled in several rounds.
2. Clusters. Connected components of these edges hold every link. Equal sets
   (by a 128-bit digest) are one member.
3. Signature trees. A cluster's members, by size, are leaves of a tree whose
   nodes hold the OR of their token bitmaps and the range of sizes. Two nodes
   are compared from the roots down; a pair whose largest possible overlap is
   too small for its sizes, or whose members are all linked already, is left.
   Pairs of leaves are counted one by one. Clusters beyond ``CLUSTER`` members
   or ``CLUSTER_SHINGLES`` shingles are dealt into blocks, and each pair of
   blocks of matching sizes is a tree join of its own.

Null and empty texts, and texts of
white space, have an empty set, link with nothing and are their own component.
Rows that repeat a doc_id are one document; a null doc_id is one larger than
all others and shown as null. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arterial.llm.common import bitmaps, discard, finished, in_bitmaps, materialize, numbered, slices
from arterial.llm.components import connected_components

#: Bins of the table of shingle counts.
BINS = 1 << 18
#: Partitions that add up tables of counts for the driver.
COUNT_PARTITIONS = 16
#: Keys that one part holds, about.
PART_KEYS = 2_000_000
LEAST_PARTS = 64
#: Highest bytes of a key that are written: so many tell the keys of a part
#: apart but for a few, and keys that coincide add a candidate, no link.
KEY_BYTES = 5
#: Keys that a task gathers before it hands them on.
HELD_KEYS = 1_000_000
#: How often a set without enough full groups is dealt anew by another hash.
TURNS = 4
#: Keys and texts are shuffled a part at a time: so many rounds each.
ROUNDS = 4
#: Members of a cluster, or of a pair of blocks, that one tree join takes, and
#: their shingles: a task holds no more texts than have about so many words.
CLUSTER, CLUSTER_SHINGLES = 2_000, 4_000_000
#: Members of a leaf, and children of a node.
LEAF, FAN = 24, 6
NO_ID = np.iinfo(np.int64).max

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted 64-bit hashes of the text's distinct shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    m = min(n, len(h))
    if not m:
        return h
    out = np.full(len(h) - m + 1, m, np.uint64)
    for j in range(m):
        out = _mixed(out * _A + h[j : len(out) + j])
    return np.unique(out)


@dataclass(frozen=True)
class Rule:
    """Similarity num / den over n-word shingles, and its size classes."""

    n: int = 3
    num: int = 90
    den: int = 100

    def links(self, a: int, b: int, both: int) -> bool:
        return self.den * both >= self.num * (a + b - both)

    def class_starts(self, largest: int) -> list[int]:
        starts = [1]
        while starts[-1] <= largest:
            starts.append(max(starts[-1] + 1, self._grown(starts[-1]) + 1))
        return starts

    def _grown(self, size: int) -> int:
        """The widest class from a size: three steps of the similarity where it
        is high; one below 0.85, where wide classes would leave groups empty."""
        step = 3 if self.num * 100 >= self.den * 85 else 1
        return size * self.den**step // self.num**step

    def groups(self, top: int) -> tuple[int, int]:
        """Groups of a class of sizes up to top, and how many of them two
        linked sets agree in at least."""
        d = 2 * top * (self.den - self.num) // (self.den + self.num)
        spare = 1 if not d else 2 + max(min(2, d // 4), d * (self.den - self.num) // self.den)
        return d + spare, spare


def frequent_bins(docs: DataFrame, rule: Rule) -> tuple[np.ndarray, int]:
    """Which bins hold a frequent shingle, by counts over all documents; and
    the number of all shingles. A bin stands out if it is eight deviations
    above the middle one."""

    def tables(totals: np.ndarray) -> pa.RecordBatch:
        packed = zstandard.ZstdCompressor(level=1).compress(totals.tobytes())
        return pa.RecordBatch.from_arrays([pa.array([packed], pa.binary())], ["counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(BINS, np.int64)
        for batch in slices(batches):
            found = [shingles(t, rule.n) for t in batch.column(0).to_pylist()]
            if found:
                totals += np.bincount((np.concatenate(found) % np.uint64(BINS)).astype(np.int64), minlength=BINS)
        yield tables(totals)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(BINS, np.int64)
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                totals += np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.int64)
        yield tables(totals)

    rows = docs.select("text").mapInArrow(count, "counts binary").repartition(COUNT_PARTITIONS).mapInArrow(add, "counts binary")
    totals = np.zeros(BINS, np.int64)
    for r in rows.collect():
        totals += np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(r.counts)), np.int64)
    middle = float(np.median(totals))
    return totals > middle + 8 * max(middle, 16) ** 0.5, int(totals.sum())


def routing_keys(s: np.ndarray, rule: Rule, starts: list[int], rare: np.ndarray) -> np.ndarray:
    """Keys of a set s by its rare members; linked sets share one at least."""
    size = len(s)
    own = int(np.searchsorted(starts, size, "right")) - 1
    classes = [own]
    if rule.den * size >= rule.num * starts[own + 1]:
        classes.append(own + 1)
    out = []
    strong = _mixed(s + _A)
    for c in classes:
        top = starts[c + 1] - 1 if c + 1 < len(starts) else rule._grown(starts[c])
        k, agreeing = rule.groups(top)
        used = k - agreeing + 1
        for turn in range(TURNS):
            full, content = _fullest(_mixed(strong + np.uint64(turn)) if turn else strong[rare], k, used)
            lacking = used - len(full)
            if lacking and turn == TURNS - 1:  # two such sets may agree in empty groups alone
                empty = np.setdiff1d(np.arange(k), full)[-lacking:]
                full, content = np.append(full, empty), np.append(content, np.zeros(lacking, np.uint64))
            out.append(_mixed(content + _mixed(full.astype(np.uint64) + np.uint64((turn << 56) + (c << 32)) + _C)))
            if not lacking:
                break
    return np.concatenate(out)


def _fullest(strong: np.ndarray, k: int, used: int) -> tuple[np.ndarray, np.ndarray]:
    """Of k groups the numbers and contents of at most ``used`` that are not
    empty: those with the most members, in an order that the content fixes."""
    group = ((strong >> np.uint64(32)) % np.uint64(k)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    full, first, size = np.unique(group[order], return_index=True, return_counts=True)
    content = np.add.reduceat(_mixed(strong[order]), first) if len(full) else strong[:0]
    if len(full) > used:
        most = np.lexsort((full, content, size))[-used:]
        full, content = full[most], content[most]
    return full, content


ROUTED = "doc_id long, n long, digest binary, part int, keys binary, ids binary"


def _routed(docs: DataFrame, rule: Rule, frequent: np.ndarray, parts: int) -> DataFrame:
    """Rows of documents (doc_id, n, digest) and rows of keys by part. Of a
    task's documents that share a key, the smallest hands it on, and the others
    hang on that one: such edges are rows of part -1."""
    bits = np.packbits(frequent).tobytes()
    starts = rule.class_starts(1 << 34)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
        keys: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        held = 0
        press = zstandard.ZstdCompressor(level=1).compress

        def handed() -> pa.RecordBatch:
            key, owner = np.concatenate(keys), np.concatenate(owners)
            key, least, edges = hung(key, owner)
            part = (key % np.uint64(parts)).astype(np.int64)
            order = np.lexsort((least, part))  # runs of one owner, which take no room compressed
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            key, least = key[order], least[order]
            rows = [(p, _short(key[b:e]), press(least[b:e].tobytes())) for p, (b, e) in enumerate(zip(cuts, cuts[1:])) if e > b]
            rows.append((-1, edges[0].tobytes(), press(edges[1].tobytes())))
            p, k, i = zip(*rows)
            none = [None] * len(rows)
            return record(none, none, none, p, k, i)

        def record(doc_id, n, digest, part, key, ids) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((doc_id, n, digest, part, key, ids), kinds)], ["doc_id", "n", "digest", "part", "keys", "ids"])

        for batch in slices(batches):
            ids, sizes, digests = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s = shingles(text, rule.n)
                ids.append(doc_id)
                sizes.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                if len(s):
                    own = routing_keys(s, rule, starts, ~common[(s % np.uint64(BINS)).astype(np.int64)])
                    keys.append(own)
                    owners.append(np.full(len(own), NO_ID if doc_id is None else doc_id, np.int64))
                    held += len(own)
            none = [None] * len(ids)
            yield record(ids, sizes, digests, none, none, none)
            if held >= HELD_KEYS:
                yield handed()
                keys.clear(), owners.clear()
                held = 0
        if held:
            yield handed()

    return docs.select("doc_id", "text").mapInArrow(run, ROUTED)


def hung(key: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the smallest owner of each, and distinct edges (rows of a
    2-row array) from the other owners to it."""
    order = np.lexsort((owner, key))
    key, owner = key[order], owner[order]
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    least = owner[first][np.cumsum(first) - 1]
    other = owner != least
    edges = np.unique(np.stack([owner[other], least[other]], 1), axis=0) if other.any() else np.zeros((0, 2), np.int64)
    return key[first], owner[first], edges.T.copy()


def _short(key: np.ndarray) -> bytes:
    return key.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - KEY_BYTES :].tobytes()


def _long(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // KEY_BYTES, 8), np.uint8)
    out[:, :KEY_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, KEY_BYTES)
    return out.view("<u8").ravel()


def _edge_table(a: np.ndarray, b: np.ndarray) -> dict[str, pa.Array]:
    return {"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())}


def _part_edges(group: pa.Table) -> pa.Table:
    keys = [_long(k) for k in group["keys"].to_pylist()]
    open_ = zstandard.ZstdDecompressor().decompress
    ids = [np.frombuffer(open_(i), np.int64) for i in group["ids"].to_pylist()]
    return pa.table(_edge_table(*hung(np.concatenate(keys), np.concatenate(ids))[2]))


def _task_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    open_ = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for a, b in zip(*(c.to_pylist() for c in batch.columns)):
            yield pa.RecordBatch.from_pydict(_edge_table(np.frombuffer(a, np.int64), np.frombuffer(open_(b), np.int64)))


class Tree:
    """A signature tree over sets, in order of size: each level's nodes hold
    the OR of the bitmaps below, the range of sizes, and the largest number of
    tokens that share a bit of their own set's bitmap."""

    def __init__(self, sets: list[np.ndarray], bits: int):
        self.sets = sets
        self.size = np.array([len(s) for s in sets], np.int64)
        maps = np.zeros((len(sets), bits // 8), np.uint8)
        for row, s in zip(maps, sets):
            bit = np.zeros(bits, bool)
            bit[(s % np.uint64(bits)).astype(np.int64)] = True
            row[:] = np.packbits(bit)
        excess = self.size - np.bitwise_count(maps).sum(axis=1)
        self.levels = []
        low = high = self.size
        width = LEAF
        while True:
            at = np.arange(0, len(low), width)
            maps = np.bitwise_or.reduceat(maps, at, axis=0)
            low, high, excess = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(excess, at)
            self.levels.append((maps, low, high, excess))
            width = FAN
            if len(low) == 1:
                break

    def members(self, level: int, node: int) -> tuple[int, int]:
        span = LEAF * FAN**level
        return node * span, min(len(self.sets), (node + 1) * span)


class Forest:
    """Union-find whose roots are the smallest members."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)


class Pairs:
    """In a forest's place: notes every link, and takes none as known."""

    def __init__(self) -> None:
        self.found: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        return i

    def join(self, i: int, j: int) -> None:
        self.found.append((i, j))


def tree_join(tree: Tree, other: Tree, rule: Rule, forest: Forest | Pairs, shift: int = 0) -> None:
    """Join in the forest what links between two trees (or within one, if they
    are the same); members of the other count from ``shift``."""
    same = tree is other
    todo = [(len(tree.levels) - 1, 0, len(other.levels) - 1, 0)]
    while todo:
        i, x, j, y = todo.pop()
        maps, low, high, excess = tree.levels[i]
        maps2, low2, high2, excess2 = other.levels[j]
        if rule.den * high[x] < rule.num * low2[y] or rule.den * high2[y] < rule.num * low[x]:
            continue
        most = int(np.bitwise_count(maps[x] & maps2[y]).sum()) + min(int(excess[x]), int(excess2[y]))
        if not rule.links(int(low[x]), int(low2[y]), min(most, int(high[x]), int(high2[y]))):
            continue
        a, b = tree.members(i, x), other.members(j, y)
        root = forest.root(a[0])
        if all(forest.root(k) == root for k in range(*a)) and all(forest.root(shift + k) == root for k in range(*b)):
            continue
        if i == j == 0:
            _leaves(tree, other, a, b, rule, forest, shift, same and x == y)
        elif i >= j:
            for child in range(x * FAN, min(len(tree.levels[i - 1][1]), (x + 1) * FAN)):
                if i == j:
                    for second in range(y * FAN, min(len(other.levels[j - 1][1]), (y + 1) * FAN)):
                        if not same or second >= child:
                            todo.append((i - 1, child, j - 1, second))
                else:
                    todo.append((i - 1, child, j, y))
        else:
            todo += [(i, x, j - 1, second) for second in range(y * FAN, min(len(other.levels[j - 1][1]), (y + 1) * FAN))]


def _leaves(tree: Tree, other: Tree, a: tuple[int, int], b: tuple[int, int], rule: Rule, forest: Forest | Pairs, shift: int, within: bool) -> None:
    tokens = np.concatenate(other.sets[b[0] : b[1]])
    owner = np.repeat(np.arange(b[1] - b[0]), other.size[b[0] : b[1]])
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    for i in range(*a):
        root = forest.root(i)
        rest = [k for k in range(i + 1 if within else b[0], b[1]) if forest.root(shift + k) != root]
        if not rest:
            continue
        s = tree.sets[i]
        begin, end = np.searchsorted(tokens, s, "left"), np.searchsorted(tokens, s, "right")
        count = end - begin
        at = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())
        both = np.bincount(owner[at], minlength=b[1] - b[0])
        for k in rest:
            if rule.links(len(s), int(other.size[k]), int(both[k - b[0]])):
                forest.join(i, shift + k)


def _grown(sets: list[np.ndarray]) -> int:
    largest = max(map(len, sets))
    return min(1 << 16, max(256, 1 << (4 * largest - 1).bit_length()))


def link_members(ids: list[int], texts: list[str], left: list[bool], right: list[bool], rule: Rule, every: bool = False) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links between the members marked left
    and those marked right, or all these links."""
    sets = [shingles(t, rule.n) for t in texts]
    order = sorted(range(len(ids)), key=lambda i: (len(sets[i]), ids[i]))
    sides = [[i for i in order if side[i] and len(sets[i])] for side in (left, right)]
    if not all(sides):
        return []
    whole = sides[0] == sides[1]
    bits = _grown(sets)
    trees = [Tree([sets[i] for i in s], bits) for s in (sides[:1] if whole else sides)]
    members = sides[0] if whole else sides[0] + sides[1]
    forest = Pairs() if every else Forest(len(members))
    tree_join(trees[0], trees[-1], rule, forest, 0 if whole else len(sides[0]))
    if every:
        return [(ids[members[i]], ids[members[j]]) for i, j in forest.found]
    return [(ids[members[i]], ids[members[forest.root(i)]]) for i in range(len(members)) if forest.root(i) != i]


def _cluster_links(rows: DataFrame, rule: Rule, every: bool) -> DataFrame:
    """Edges from rows (task, doc_id, text, left, right), sorted by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held = None, []
        edges: list[tuple[int, int]] = []

        def joined() -> list[tuple[int, int]]:
            return link_members(*map(list, zip(*held)), rule, every) if len(held) > 1 else []

        for batch in batches:
            for t, doc_id, text, left, right in zip(*(c.to_pylist() for c in batch.columns)):
                if t != task:
                    edges += joined()
                    task, held = t, []
                held.append((doc_id, text, left, right))
            yield made(edges)
            edges = []
        yield made(joined())

    def made(edges: list[tuple[int, int]]) -> pa.RecordBatch:
        a, b = zip(*edges) if edges else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return rows.select("task", "doc_id", "text", "left", "right").mapInArrow(run, "a long, b long")


def _size_class(rule: Rule) -> float:
    return float(np.log(rule.den / rule.num)) * 1.0001  # no rounding parts sizes that can link by two levels


def _linked(docs: DataFrame, rule: Rule, cluster: int, shingle_limit: int, every: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents (doc_id, n, digest), distinct sets (digest, rep, n) and edges
    (a, b) between representatives; all written."""
    frequent, total = frequent_bins(docs, rule)
    share = 2 * (rule.den - rule.num) / (rule.den + rule.num)
    parts = max(LEAST_PARTS, int(2 * share * total) // PART_KEYS)
    routed = materialize(_routed(docs, rule, frequent, parts), "routed")
    edges = routed.filter("part = -1").select("keys", "ids").mapInArrow(_task_edges, "a long, b long")
    by_round = []
    for r in range(ROUNDS):
        own = routed.filter(f"part >= 0 and part % {ROUNDS} = {r}").select("part", "keys", "ids")
        by_round.append(materialize(own.groupBy("part").applyInArrow(_part_edges, "a long, b long").distinct(), "part-edges"))
        edges = edges.unionByName(by_round[-1])
    clusters = materialize(connected_components(edges, "candidates"), "clusters")
    discard(*by_round)
    known = materialize(routed.filter("part is null").select(F.coalesce("doc_id", F.lit(int(NO_ID))).alias("doc_id"), "n", "digest"), "sets")
    discard(routed)
    # written, so that the join with the documents of a much copied set can be split
    sets = materialize(known.filter("n > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n")), "distinct-sets")
    members = materialize(sets.select(F.col("rep").alias("node"), "n").join(clusters, "node"), "members")
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("held")).filter("m > 1")
    # members and their tasks: a cluster is one, or a pair of its blocks is
    chosen = members.join(sizes, "component")
    fits = (F.col("m") <= cluster) & (F.col("held") <= shingle_limit)
    small = chosen.filter(fits).select("node", F.array(F.col("component")).alias("task"), F.lit(True).alias("left"), F.lit(True).alias("right"))
    # sizes that can link lie in one level or in neighbours, so a larger cluster is cut by levels, and a level into blocks;
    # a task is (component, level, block, level or next, block), and a member goes to those of its level and of both next to it
    level = F.floor(F.log(F.col("n").cast("double")) / _size_class(rule)).cast("int").alias("level")
    parted = materialize(chosen.filter(~fits).select("node", "n", "component", level), "parted")
    held = parted.groupBy("component", "level").agg(F.count(F.lit(1)).alias("in_level"), F.sum("n").alias("words"))
    held = held.withColumn("blocks", F.least(F.col("in_level"), F.greatest(F.ceil(F.col("in_level") * 2 / cluster), F.ceil(F.col("words") * 2 / shingle_limit))).cast("int"))
    held = materialize(held.drop("words"), "levels")
    beside = lambda by, name: held.select("component", (F.col("level") - by).alias("level"), F.col("blocks").alias(name))
    around = held.join(beside(1, "above"), ["component", "level"], "left").join(beside(-1, "below"), ["component", "level"], "left")
    around = materialize(around.fillna(0, ["above", "below"]), "levels")
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    count = lambda c: F.filter(F.sequence(F.lit(0), F.greatest(c, F.lit(1)) - 1), lambda o: o < c)
    task = lambda *at: F.array(F.col("component"), *(x.cast("long") for x in at)).alias("task")
    side = lambda at, left, right: F.struct(at, (left if isinstance(left, Column) else F.lit(left)).alias("left"), (right if isinstance(right, Column) else F.lit(right)).alias("right"))
    own, up, down = F.col("level"), F.col("level") + 1, F.col("level") - 1
    there = F.explode(
        F.concat(
            F.transform(count(F.when(F.col("in_level") > 1, F.col("blocks")).otherwise(0)), lambda o: side(task(own, F.least(mine, o), own, F.greatest(mine, o)), mine <= o, mine >= o)),
            F.transform(count(F.col("above")), lambda o: side(task(own, mine, up, o), True, False)),
            F.transform(count(F.col("below")), lambda o: side(task(down, o, own, mine), False, True)),
        )
    )
    large = parted.join(around, ["component", "level"]).select("node", there.alias("t")).select("node", "t.task", "t.left", "t.right")
    tasks = materialize(small.unionByName(large), "tasks")
    texts = docs.select(F.coalesce("doc_id", F.lit(int(NO_ID))).alias("doc_id"), "text")
    by_round = []
    for r in range(ROUNDS):
        own = tasks.filter(F.pmod(F.xxhash64("task"), F.lit(ROUNDS)) == r)
        # where bitmaps can tell them, only texts that have a task are shuffled
        wanted = bitmaps(own, "node")
        some = in_bitmaps(texts, "doc_id", wanted) if wanted else texts
        # members grow with the documents: no size at which they would be broadcast
        rows = some.join(own.withColumnRenamed("node", "doc_id").hint("merge"), "doc_id")
        dealt = rows.repartition("task").sortWithinPartitions("task")
        by_round.append(finished(_cluster_links(dealt, rule, every), "round-links", wanted))
    links = by_round[0]
    for more in by_round[1:]:
        links = links.unionByName(more)
    links = finished(links, "links", *by_round)
    discard(members, clusters, parted, held, around, tasks)
    return known, sets, links


def _shown(c: Column) -> Column:
    return F.nullif(c, F.lit(int(NO_ID)))


def link_components(docs: DataFrame, rule: Rule = Rule(), cluster: int = CLUSTER, shingle_limit: int = CLUSTER_SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs."""
    known, sets, links = _linked(docs, rule, cluster, shingle_limit, every=False)
    linked = materialize(connected_components(links, "linked"), "linked")
    out = known.join(sets.select("digest", "rep"), "digest", "left").join(linked.withColumnRenamed("node", "rep"), "rep", "left")
    own = F.least(F.coalesce("component", "rep", "doc_id"), F.coalesce("rep", "doc_id"))
    out = out.select(_shown(F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"), _shown(own).alias("component_id"))
    return finished(out, "linked-documents", known, sets, links, linked)


def link_pairs(docs: DataFrame, rule: Rule = Rule(), cluster: int = CLUSTER, shingle_limit: int = CLUSTER_SHINGLES) -> tuple[DataFrame, DataFrame]:
    """Every link: doc_id, n_shingles, representative, n_links of each row of
    docs, where n_links counts all other documents that it links with, copies
    too; and the pairs (a, b) of representatives whose sets link. The
    representative is the smallest doc_id of equal sets."""
    known, sets, links = _linked(docs, rule, cluster, shingle_limit, every=True)
    ids = known.filter("n > 0").select("doc_id", "digest").distinct()
    copies = materialize(ids.groupBy("digest").agg(F.count(F.lit(1)).alias("copies")).join(sets.select("digest", "rep"), "digest"), "copies")
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(copies.select(F.col("rep").alias("b"), "copies"), "b").groupBy("a").agg(F.sum("copies").alias("others"))
    sums = materialize(copies.join(others.withColumnRenamed("a", "rep"), "rep", "left"), "link-counts")
    n_links = F.coalesce(F.col("copies") - 1 + F.coalesce("others", F.lit(0)), F.lit(0)).cast("long")
    out = known.join(sums, "digest", "left").select(
        _shown(F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"), _shown(F.coalesce("rep", "doc_id")).alias("representative"), n_links.alias("n_links")
    )
    pairs = finished(links.select(_shown(F.col("a")).alias("a"), _shown(F.col("b")).alias("b")), "link-pairs", links)
    return finished(out, "link-members", known, sets, copies, sums), pairs


def drop_near_duplicates(docs: DataFrame, rule: Rule) -> DataFrame:
    """The rows of docs of which each component keeps one, with the smallest
    doc_id (null last). Every row is a document of its own here, so of repeated
    rows one stays, and rows of one doc_id with other texts are apart."""
    rows, own = numbered(docs)
    linked = link_components(rows.select(F.col(own).alias("doc_id"), "text"), rule)
    ids = rows.select(F.col(own).alias("_own"), F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(own).alias("own")).alias("id"))
    first = ids.join(linked, F.col("_own") == linked["doc_id"]).groupBy("component_id").agg(F.min("id").alias("id"))
    stays = materialize(first.select(F.col("id.own").alias(own)), "rows-that-stay")
    # numbers alone tell the rows that go; their bitmaps are broadcast whatever Spark's threshold, so that no text is shuffled
    gone = materialize(rows.select(own).join(stays, own, "left_anti"), "rows-that-go")
    discard(linked, stays)
    bits = bitmaps(gone, own)
    kept = in_bitmaps(rows, own, bits, inside=False) if bits else rows.join(gone, own, "left_anti")
    return finished(kept.select(*docs.columns), "kept-rows", rows, gone, bits)
