"""Substring dedup against brute force."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from arterial.llm import substring

from .conftest import rows_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, window):
    split = [WORD.findall(t or "") for _, t in docs]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = Counter()
    for (doc_id, _), w in zip(docs, split):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[doc_id, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("window, gram, shard_bytes, shard_words", [(35, 8, 4 << 20, 400_000), (6, 3, 2_000, 300)])
def test_substring_dedup(spark, hard, monkeypatch, window, gram, shard_bytes, shard_words):
    """One shard and automaton, and many."""
    monkeypatch.setattr(substring, "SHARD_BYTES", shard_bytes)
    monkeypatch.setattr(substring, "SHARD_WORDS", shard_words)
    rng = np.random.default_rng(4)
    pool = [[f"w{x}" for x in rng.integers(0, 5000, 60)] for _ in range(6)]
    rows = []
    for i in range(60):  # passages of many documents, in parts, between other words
        words = [f"u{x}" for x in rng.integers(0, 10**6, 40)]
        for p in rng.integers(0, 6, 2):
            b = rng.integers(0, 20)
            words[10:10] = pool[p][b : b + rng.integers(20, 60)]
        rows.append((1000 + i, " ".join(words)))
    docs = hard.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    got = substring.kept_digest(docs, window, gram).collect()
    want = brute(rows_of(docs), window)
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == want
    assert sum(k[2] for k in want) > 100


def test_words_go_only_by_the_automaton(spark, monkeypatch):
    """Without what the automaton finds nothing is removed; with a passage of
    its own, every occurrence of that."""
    text = " ".join(f"w{i}" for i in range(90))
    docs = spark.createDataFrame([(1, f"{text} a b"), (2, f"c {text}"), (3, "c d")], "doc_id long, text string")
    split = [substring.words_of(f"{text} a b"), substring.words_of("c d a b")]
    assert [g.sum() for g in substring._covered(split, [])] == [0, 0]
    assert [np.flatnonzero(g).tolist() for g in substring._covered(split, [b"a b", b"w3 w4"])] == [[3, 4, 90, 91], [2, 3]]
    passages, some = substring.recurring(substring.numbered(docs)[0])
    found = {bytes(r["words"]).decode() for r in passages.collect()}
    assert found and all(p in text and len(p.split()) >= 35 for p in found) and "lo" in some.columns
    assert {r.doc_id: r.n_removed for r in substring.kept_digest(docs).collect()} == {1: 90, 2: 90, 3: 0}


def test_nothing(empty):
    assert substring.kept_digest(empty).count() == 0


def test_segments_cover_all_windows():
    rng = np.random.default_rng(3)
    lengths = [0, 3, 50, 200, 34, 35]
    hashes = rng.integers(0, 40, sum(lengths)).astype(np.uint64)
    text, lo, hi, anchor, seg, self = substring.segments(lengths, hashes, 35, 8)
    per = Counter()
    for t, a, b in zip(text.tolist(), lo.tolist(), hi.tolist()):
        per[t] += b - a + 1
    assert per == {i: n - 34 for i, n in enumerate(lengths) if n >= 35}


def test_automaton_equals_a_plain_search():
    rng = np.random.default_rng(5)
    words = [b"w%d" % i for i in rng.integers(0, 3000, 6000)]
    passages = [words[i : i + n] for i, n in zip(rng.integers(0, 5900, 400).tolist(), rng.integers(1, 60, 400).tolist())]
    text = [w for i in rng.integers(0, 5900, 40).tolist() for w in [*words[i : i + 90], b"elsewhere"]]
    want = np.zeros(len(text), bool)
    for p in passages:
        for at in range(len(text) - len(p) + 1):
            if text[at : at + len(p)] == p:
                want[at : at + len(p)] = True
    assert len({w for p in passages for w in p}) > substring.SECOND and 0 < want.sum() < len(text)
    assert (substring.Automaton(passages).covered(text) == want).all()
