"""Exact dedup, decontamination and language identification."""

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from arterial.llm import decontaminate, exact_dedup, language

from .conftest import rows_of


@pytest.mark.parametrize("block", [4096, 1000])
def test_exact_dedup(hard, block):
    docs = rows_of(hard)
    groups = {}
    for doc_id, text in docs:
        groups.setdefault(text or "", []).append(doc_id)
    key = lambda i: (i is not None, i or 0)
    want = Counter()
    for doc_id, text in docs:
        own = groups[text or ""]
        want[doc_id, max(own, key=key), len(own), hashlib.sha256((text or "").encode()).hexdigest()] += 1
    got = exact_dedup.duplicate_groups(hard, block).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    left = exact_dedup.drop_duplicates(hard, block)
    assert left.columns == hard.columns and left.select("text").distinct().count() == len(groups)


def test_blocks_with_one_hash(spark, hard, monkeypatch):
    """Names come from content even where hashes collide."""
    want = sorted(map(str, exact_dedup.duplicate_groups(hard, 2000).collect()))
    weak = F.xxhash64
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda c: F.pmod(weak(c), F.lit(7)))
    assert sorted(map(str, exact_dedup.duplicate_groups(hard, 2000).collect())) == want


def test_exact_dedup_of_nothing(empty):
    assert exact_dedup.duplicate_groups(empty).count() == 0


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(docs, items, window=13, share=20):
    out = Counter()
    phrases = {}
    for item, text in items:
        w = WORD.findall(lowered(text))
        for i in range(max(1, len(w) - window + 1)) if w else ():
            phrases.setdefault(tuple(w[i : i + window]), set()).add(item)
    for doc_id, text in docs:
        w = WORD.findall(lowered(text))
        hit, found = set(), set()
        for p, owners in phrases.items():
            for i in range(len(w) - len(p) + 1):
                if tuple(w[i : i + len(p)]) == p:
                    hit.update(range(i, i + len(p)))
                    found |= owners
        sha = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out[doc_id, len(w), len(hit), len(found), sha, bool(hit) and share * len(hit) >= len(w)] += 1
    return out


def benchmark_rows(docs):
    texts = [t for _, t in docs if t and 20 < len(t) < 4000]
    rows = [(i, " ".join(t.split()[3:40]).upper()) for i, t in enumerate(texts[:12])]
    return rows + [(100, None), (101, "  ... "), (102, "alpha1 zeta2"), (103, rows[0][1]), (9, "日本語")]


@pytest.mark.parametrize("size, windows", [(4 << 20, 200_000), (300, 20), (1, 1)])
def test_contamination(spark, hard, monkeypatch, size, windows):
    """One block, and many: long items are cut, and repeated rows stay apart."""
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
    monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", windows)
    docs = [(i, t) for i, t in rows_of(hard) if len(t or "") < 50_000]
    some = hard.filter("text is null or length(text) < 50000")
    items = benchmark_rows(docs)
    if size == 1:  # a block for each window
        items = items[:2] + items[-4:]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.contamination(some, bench).collect())
    want = brute(docs, items)
    assert got == want and max(got.values()) > 1
    left = decontaminate.drop_contaminated(some, bench)
    assert any(k[5] for k in want) and left.columns == hard.columns
    assert left.count() == sum(n for k, n in want.items() if not k[5])


def test_contamination_of_nothing(spark, hard, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(empty, none).count() == 0
    assert decontaminate.contamination(hard, none).filter("n_hit > 0").count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a x b x x c"), (2, "c b a"), (3, "a b"), (4, "b c")], "doc_id long, text string")
    index = decontaminate.build_index(docs)
    found = decontaminate.proximity_matches(index, [b"a", b"b", b"c"], 4).collect()
    assert [(r.doc_id, r.begin, r.end) for r in found] == [(2, 0, 3)]
    found = decontaminate.proximity_matches(index, [b"a", b"c"], 6).collect()
    assert sorted((r.doc_id, r.begin, r.end) for r in found) == [(1, 0, 6), (2, 0, 3)]
    assert decontaminate.proximity_matches(index, [b"a", b"nowhere"], 6).count() == 0


def test_language(spark, hard, empty):
    rows = [(i, t, l) for i, (t, l) in enumerate([("the cat and the dog in the house", "en"), ("der hund und die katze in dem haus", "de"), ("the house of the king", "en"), ("das haus und der garten", "de")] * 5)]
    docs = spark.createDataFrame(rows + [(90, None, None), (91, "12 !", "en"), (92, "", None)], "doc_id long, text string, lang string")
    profiles = language.learn_profiles(docs)
    assert list(profiles) == ["de", "en"]
    found = {r.doc_id: r for r in language.identify(docs, profiles).collect()}
    assert all(found[i].lang_pred == l and 0 < found[i].score <= 1 for i, _, l in rows)
    assert all((found[i].lang_pred, found[i].score) == ("und", 0) for i in (90, 91, 92))
    assert language.identify(hard, profiles).count() == hard.count()
    assert language.identify(empty, profiles).count() == 0 and language.learn_profiles(empty) == {}
    assert {r.lang_pred for r in language.identify(docs, {}).collect()} == {"und"}


def test_ngrams_against_a_plain_count():
    texts = ["Ab ba", None, "", "x1y", "éé日"]
    who, gram, n = language.ngrams(texts)
    got = Counter({(int(a), int(b)): int(c) for a, b, c in zip(who, gram, n)})
    want = Counter()
    table = language._symbols()
    for i, t in enumerate(texts):
        s = [0]
        for c in t or "":
            v = int(table[ord(c)])
            if v or s[-1]:
                s.append(v)
        s += [0] * (s[-1] != 0)
        for j in range(len(s)):
            if s[j]:
                want[i, 1 << 36 | s[j]] += 1
            if j + 1 < len(s):
                want[i, 2 << 36 | s[j] << 12 | s[j + 1]] += 1
            if 0 < j < len(s) - 1 and s[j]:
                want[i, 3 << 36 | s[j - 1] << 24 | s[j] << 12 | s[j + 1]] += 1
    assert got == want


def test_exact_dedup_keeps_one_of_repeated_rows(spark):
    """Repeated rows that win their group, short and of several blocks."""
    long = "x" * 9_000
    rows = [(5, "a"), (5, "a"), (5, "a"), (2, "a"), (7, long), (7, long), (1, long), (None, None), (None, ""), (3, "b")]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, row int, _row int").repartition(3)
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.duplicate_groups(docs).collect())
    assert got == Counter({(5, 5, 4, True): 1, (5, 5, 4, False): 2, (2, 5, 4, False): 1, (7, 7, 3, True): 1, (7, 7, 3, False): 1, (1, 7, 3, False): 1, (None, None, 2, True): 1, (None, None, 2, False): 1, (3, 3, 1, True): 1})
    left = exact_dedup.drop_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in left.collect()) == [(0, ""), (3, "b"), (5, "a"), (7, long)]


def test_names_are_places_in_one_sorted_list(spark):
    keys = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("left"), (F.col("id") % 3).alias("right"))
    for n in ("3", "11"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        named = sorted((r.left, r.right, r.name) for r in exact_dedup._sorted_names(keys, "test").collect())
        assert [n for *_, n in named] == list(range(1000))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
