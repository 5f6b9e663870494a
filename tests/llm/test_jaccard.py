"""The Jaccard join against brute force."""

import random
import re
import time

import numpy as np
import pytest

from arterial.llm import jaccard
from arterial.llm.components import connected_components
from arterial.llm.jaccard import NO_ID, Rule

from arterial.llm.common import bitmaps, in_bitmaps
from arterial.plans.lineage import discard, materialize

from .conftest import rows_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets_of(text, n):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(docs, rule):
    sets = [sets_of(t, rule.n) for _, t in docs]
    ids = [NO_ID if i is None else i for i, _ in docs]
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and rule.den * len(a & b) >= rule.num * len(a | b):
                x, y = root(ids[i]), root(ids[j])
                up[max(x, y)] = min(x, y)
    show = lambda i: None if i == NO_ID else i
    return sorted(((show(i), len(s), show(root(i))) for i, s in zip(ids, sets)), key=str)


def near_copies(rng, n=130):
    """Chains of near copies at all similarities around the thresholds."""
    out = []
    for _ in range(n // 10):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([1, 2, 4, 9, 12, 20, 40, 90, 250]))]
        for _ in range(10):
            words = list(words)
            for _ in range(rng.randrange(0, 1 + max(1, len(words) // 40)) if words else 0):
                at = rng.randrange(len(words) or 1)
                words[at : at + rng.randrange(2)] = [f"x{rng.randrange(10**6)}"] * rng.randrange(2)
            out.append(" ".join(words))
    return out


@pytest.fixture(scope="module")
def docs(spark, hard):
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = near_copies(rng)
    texts += [" ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(30, 90))) + " " + passage for _ in range(40)]
    rng.shuffle(texts)
    more = spark.createDataFrame([(2000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return hard.select("doc_id", "text").unionByName(more).repartition(5)


@pytest.mark.parametrize("rule, cluster", [(Rule(3, 90, 100), 6), (Rule(5, 80, 100), 2000)])
def test_components(docs, rule, cluster):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.link_components(docs, rule, cluster).collect()), key=str)
    want = brute(rows_of(docs), rule)
    assert got == want
    assert 20 < len({c for _, _, c in want}) < len(want) - 50


def test_nothing(empty):
    assert jaccard.link_components(empty).count() == 0
    assert [f.count() for f in jaccard.link_pairs(empty)] == [0, 0]


def test_all_pairs(spark):
    """Every link, from clusters whole and cut by members and by shingles."""
    rng = random.Random(11)
    texts = near_copies(rng, 120)
    rows = [(i, t) for i, t in enumerate(texts + texts[:30])] + [(900, None), (901, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    rule = Rule()
    sets = {i: sets_of(t, 3) for i, t in rows}
    linked = {i: {j for j in sets if j != i and sets[i] and sets[j] and rule.links(len(sets[i]), len(sets[j]), len(sets[i] & sets[j]))} for i in sets}
    first = {i: min([i, *(j for j in linked[i] if sets[j] == sets[i])]) for i in sets}
    want = {(min(a, b), max(a, b)) for a in linked for b in linked[a] if first[a] == a and first[b] == b}
    for limits in ((1000, 10**6), (6, 10**6), (1000, 300)):
        members, pairs = jaccard.link_pairs(docs, rule, *limits)
        got = [(min(r.a, r.b), max(r.a, r.b)) for r in pairs.collect()]
        assert len(got) == len(set(got)) and set(got) == want
        assert {(r.doc_id, r.n_shingles, r.representative, r.n_links) for r in members.collect()} == {(i, len(sets[i]), first[i], len(linked[i])) for i in sets}
    left = jaccard.drop_near_duplicates(docs.unionByName(docs), rule)
    assert left.count() == len({c for _, _, c in brute(rows, rule)}) + 2  # texts without words link with nothing


@pytest.mark.parametrize("rule", [Rule(), Rule(5, 80, 100), Rule(3, 1, 2)])
def test_linked_sets_share_a_key(rule):
    rng = np.random.default_rng(8)
    starts = rule.class_starts(1 << 34)
    shared = 0
    for trial in range(400):
        size = int(rng.integers(1, 200))
        s = rng.integers(0, 1 << 63, size).astype(np.uint64)
        drop, add = rng.integers(0, 1 + size // 8, 2)
        t = np.unique(np.concatenate([s[drop:], rng.integers(0, 1 << 63, add).astype(np.uint64)]))
        s = np.unique(s)
        both = len(np.intersect1d(s, t))
        if len(t) and rule.links(len(s), len(t), both):
            shared += 1
            share = rng.choice([0.0, 0.5, 1.0])  # of shingles that count as frequent
            rare = lambda x: (x % np.uint64(1000)).astype(float) >= share * 1000
            assert np.intersect1d(jaccard.routing_keys(s, rule, starts, rare(s)), jaccard.routing_keys(t, rule, starts, rare(t))).size
    assert shared > 50


@pytest.mark.parametrize("share", [0.5, 0.9, 1.0])
def test_unlike_sets_share_hardly_a_key(share):
    """Sets with few rare shingles hung together by the groups they had none in."""
    rng = np.random.default_rng(4)
    rule = Rule(5, 80, 100)
    starts = rule.class_starts(1 << 34)
    common = rng.integers(0, 1 << 63, 3).astype(np.uint64)
    keys = []
    for _ in range(300):
        s = np.unique(np.append(rng.integers(0, 1 << 63, int(rng.integers(60, 140))).astype(np.uint64), common))
        keys.append(np.unique(jaccard.routing_keys(s, rule, starts, (s % np.uint64(1000)).astype(float) >= share * 1000)))
    keys = np.concatenate(keys)
    assert len(keys) - len(np.unique(keys)) < len(keys) / 100


def test_rounds(spark, docs, monkeypatch):
    """Keys and texts are shuffled a part at a time, with the same links."""
    labels, write = [], jaccard.materialize
    monkeypatch.setattr(jaccard, "materialize", lambda df, label: labels.append(label) or write(df, label))
    monkeypatch.setattr(jaccard, "ROUNDS", 3)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.link_components(docs, Rule(), 6).collect()), key=str)
    assert got == brute(rows_of(docs), Rule())
    assert labels.count("part-edges") == 3


def test_tree_join_finds_all_links():
    rng = random.Random(3)
    texts = near_copies(rng, 400)
    rule = Rule()
    sets = [sets_of(t, 3) for t in texts]
    n = len(texts)
    want = list(range(n))

    def root(i):
        while want[i] != i:
            i = want[i]
        return i

    for i in range(n):
        for j in range(i):
            if sets[i] and sets[j] and rule.links(len(sets[i]), len(sets[j]), len(sets[i] & sets[j])):
                a, b = root(i), root(j)
                want[max(a, b)] = min(a, b)
    edges = jaccard.link_members(list(range(n)), texts, [True] * n, [True] * n, rule)
    got = jaccard.Forest(n)
    for a, b in edges:
        got.join(a, b)
    assert [got.root(i) for i in range(n)] == [root(i) for i in range(n)]


def test_connected_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(7, 7), (5, 4), (4, 5)]
    up = {}

    def root(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: root(i) for i in up}


def test_bitmaps_tell_numbers(spark):
    ids = [None, 0, 1, 7, 8, -1, -9, 32_767, 32_768, 32_769, 1 << 33, (1 << 33) + 5, NO_ID, -NO_ID - 1]
    rows = spark.createDataFrame([(i, "t") for i in [*ids, 2, 9, -8, (1 << 33) + 4]], "id long, bucket string")
    bits = bitmaps(spark.createDataFrame([(i,) for i in ids], "id long"), "id")
    assert {r.id for r in in_bitmaps(rows, "id", bits).collect()} == {*ids} - {None}
    assert sorted(r.id or 0 for r in in_bitmaps(rows, "id", bits, inside=False).collect()) == [-8, 0, 2, 9, (1 << 33) + 4]
    assert bitmaps(rows, "id", most=2) is None


def test_short_keys():
    key = np.array([0, 1 << 24, (1 << 64) - 1, 0x123456789ABCDEF0], np.uint64)
    assert jaccard._long(jaccard._short(key)).tolist() == (key >> np.uint64(24)).tolist()


def _shuffle_files(spark) -> int:
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).getName().startswith("shuffle_") for i in range(files.size()))


def test_a_written_table_leaves_no_shuffle_behind(spark):
    mixed = spark.range(1_000).repartition(7, "id")
    before = _shuffle_files(spark)
    made = materialize(mixed, "mixed")
    for _ in range(50):  # files go in the background
        if _shuffle_files(spark) <= before:
            break
        time.sleep(0.1)
    assert _shuffle_files(spark) <= before
    assert made.count() == 1_000
    discard(made)


def test_kept_rows_are_not_shuffled_beyond_the_broadcast_threshold(spark, docs, monkeypatch):
    """At 6 GB the rows that go were more than Spark broadcasts by itself."""
    plans, write = {}, jaccard.finished

    def noted(df, label, *tables):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, label, *tables)

    monkeypatch.setattr(jaccard, "finished", noted)
    rule = Rule(n=2, num=50, den=100)
    with_threshold = sorted(map(str, jaccard.drop_near_duplicates(docs, rule).collect()))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        without = sorted(map(str, jaccard.drop_near_duplicates(docs, rule).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert without == with_threshold
    assert "BroadcastHashJoin" in plans["kept-rows"] and "hashpartitioning" not in plans["kept-rows"]
