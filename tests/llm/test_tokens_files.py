"""Encoder, wavelet matrix, packing: exact round trips."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from arterial.llm import packing, wavelet
from arterial.llm.tokens import Encoder, encoder

from .conftest import hard_texts, rows_of


def plain_ids(text):
    return np.array(encoder().tokenizer.encode(text, add_special_tokens=False).ids, "<u4")


def test_encoder_equals_the_library():
    texts = [t or "" for t in hard_texts()] + ["it's I'll 'twas", "<|endoftext|> a", "x<|endoftext|>\nb", "a\x1cb", " \n a", "12 3.4%", "naïve x", "A, b!! c### d"]
    small = Encoder("byte_bpe_50k.json", memo_words=5)
    for enc in (encoder(), encoder(), small):
        for text, ids in zip(texts, enc.encode(texts)):
            assert ids == plain_ids(text).tobytes(), text[:40]


def test_encoder_takes_arrow_columns():
    texts = [None, "", "a  b", "one two\nthree", None, "\n\n", "x" * 9000 + " y" * 300_000, "last"]
    for column in (pa.array(texts), pa.array(["cut", *texts]).slice(1), pa.array(texts, pa.large_string())):
        assert encoder().encode(column) == [plain_ids(t or "").tobytes() for t in texts]
    assert encoder().encode([]) == []


def test_distinct_words_go_to_the_model_together():
    """One call a word made op7 miss its budget of CPU seconds."""

    class Counted:
        def __init__(self, speller):
            self.speller, self.words = speller, []

        def encode_batch_fast(self, texts, **options):
            self.words.append(sum(t.count("Ċ") + 1 for t in texts))
            return self.speller.encode_batch_fast(texts, **options)

    def word(i):
        return "".join(chr(ord("a") + i // 26**k % 26) for k in range(4)) + "éß"[i % 2]

    texts = [" ".join(word(i) + ",."[i % 2 :] for i in range(at, at + 5000)) for at in range(0, 30_000, 2500)]
    for memo, calls in ((400_000, [20_000, 12_500]), (0, [20_000, 12_500] * 2)):
        enc = Encoder("byte_bpe_50k.json", memo_words=memo)
        enc.speller = Counted(enc.speller)
        for _ in range(2):
            assert enc.encode(texts) == [plain_ids(t).tobytes() for t in texts]
        # 32,500 words after a space, and the first of each text without one
        assert [n // 100 for n in enc.speller.words] == [n // 100 for n in calls]


@pytest.mark.parametrize("n, top", [(0, 1), (1, 0), (5, 3), (3000, 50_000), (140_000, 9), (2000, 100_000)])
def test_wavelet_matrix(n, top):
    ids = np.random.default_rng(n).integers(0, top + 1, n).astype(np.uint32)
    w = wavelet.WaveletMatrix(wavelet.WaveletMatrix.build(ids))
    assert (w.decode() == ids).all() and len(w.decode()) == n
    for i in range(0, n, max(1, n // 9)):
        s = int(ids[i])
        at = np.flatnonzero(ids == s)
        assert w.access(i) == s
        assert w.rank(s, i) == (at < i).sum() and w.count(s) == len(at)
        assert w.select(s, len(at) // 2) == at[len(at) // 2]
    assert w.rank(top + 12345, n) == 0
    if 0 < n < 100:
        assert w.occurrences(int(ids[0])) == np.flatnonzero(ids == ids[0]).tolist()


def test_shards_round_trip(spark, hard, empty):
    shards = wavelet.write_shards(hard, shard_tokens=2000)
    assert shards.count() > 3
    got = sorted((r.start, r.n_tokens, r.ids_crc32, r.doc_id) for r in wavelet.read_documents(shards).collect())
    start = 0
    for (at, n, crc, doc_id), (_, text) in zip(got, sorted(rows_of(hard), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))):
        ids = np.append(plain_ids(text or ""), 0).astype("<u4")
        assert (at, n, crc) == (start, len(ids), zlib.crc32(ids.tobytes())), doc_id
        start += n
    assert len(got) == hard.count()
    assert wavelet.read_documents(wavelet.write_shards(empty)).count() == 0


def test_shards_stay_and_are_looked_up(spark, hard, tmp_path):
    path = (tmp_path / "tokens").as_uri()
    shards = wavelet.write_shards(hard, path, shard_tokens=2000)
    assert shards.count() > 3
    again = wavelet.open_shards(spark, path)
    docs = sorted(rows_of(hard), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    ids, owner, offset = [], [], []
    for doc_id, text in docs:
        own = [*plain_ids(text or "").tolist(), 0]
        ids += own
        owner += [doc_id] * len(own)
        offset += range(len(own))
    some = [0, 3, 3, len(ids) - 1, len(ids), *range(100, len(ids), 997)]
    got = wavelet.ids_at(again, spark.createDataFrame([(p,) for p in some], "place long")).collect()
    assert sorted(map(tuple, got)) == sorted((p, ids[p]) for p in some if p < len(ids))
    symbols = [0, ids[50], ids[50], 49_999]
    assert {r.id: r.n for r in wavelet.counts(again, symbols).collect()} == {s: ids.count(s) for s in symbols}
    found = sorted(((r.id, r.place, r.doc_id, r.offset) for r in wavelet.occurrences(again, symbols).collect()), key=str)
    assert found == sorted(((x, i, owner[i], offset[i]) for i, x in enumerate(ids) if x in symbols), key=str)


def check_packing(rows, docs, capacity):
    by_seq, by_doc = {}, {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    want = {}
    for doc_id, text in docs:
        ids = np.append(plain_ids(text or ""), 0).astype("<u4")
        n, first = len(ids), len(ids) % capacity or capacity
        cuts = [0, n] if n <= capacity else [0, *range(first, n + 1, capacity)]
        want.setdefault(doc_id, []).extend((i, b, e - b, zlib.crc32(ids[b:e].tobytes())) for i, (b, e) in enumerate(zip(cuts, cuts[1:])))
    assert {k: sorted(v) for k, v in by_doc.items()} == {k: sorted(v) for k, v in want.items()}
    return len(by_seq)


def test_packing(spark, hard, empty):
    rows = packing.pack_documents(hard, capacity=512).collect()
    n = check_packing(rows, rows_of(hard), 512)
    assert n <= packing.lower_bound(np.array([r.length for r in rows]), 512) + 1
    # many small partitions with gaps, merged in rounds
    again = packing.pack(packing.token_pieces(hard, 512), 512, per_partition=30).collect()
    assert check_packing(again, rows_of(hard), 512) <= n + 3
    assert packing.pack_documents(empty).count() == 0


def test_packing_where_no_round_can_close_bins(spark, monkeypatch):
    """Two pieces of 600 to 999 leave every sequence open, so nothing gets
    fewer: no group may hold all. Repeated rows and clashing names are kept."""
    sizes = []
    best = packing.best_fit_decreasing
    monkeypatch.setattr(packing, "lower_bound", lambda lengths, capacity=0: sizes.append(len(lengths)) or 0)
    rows = [(1, 0, 600 + i * 7 % 400, "g", i) for i in range(4000)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, length long, group string, row long")
    monkeypatch.setattr(packing, "PIECES_PER_PARTITION", 0)
    packed = packing.pack(pieces, 2048, per_partition=250)
    assert packed.columns == [*pieces.columns, "sequence_id", "offset"]
    got = packed.collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(rows)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in parts) <= 2048 and sorted(parts)[-1][0] == sum(n for _, n in sorted(parts)[:-1]) for parts in by.values())
    assert len(by) < 1.1 * len(best(np.array([r[2] for r in rows]), 2048)[2])
    assert packing.next_groups(64, 10**6, 1000) == 64 and packing.next_groups(64, 5000, 1000) == 8 and packing.next_groups(2, 0, 10) == 1


def test_lower_bound_is_one():
    rng = np.random.default_rng(1)
    for _ in range(60):
        lengths = rng.integers(1, 65, rng.integers(1, 60))
        bins, offsets, free = packing.best_fit_decreasing(lengths, 64)
        assert packing.lower_bound(lengths, 64) <= len(free)
        for b in range(len(free)):
            own = sorted(zip(offsets[bins == b], lengths[bins == b]))
            assert all(o == sum(x for _, x in own[:i]) for i, (o, _) in enumerate(own))
            assert sum(x for _, x in own) == 64 - free[b]
    assert packing.lower_bound(np.array([33] * 10), 64) == 10
    assert packing.lower_bound(np.array([22] * 9), 64) == 5  # at most two to a bin
