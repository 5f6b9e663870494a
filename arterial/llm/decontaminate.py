"""Benchmark decontamination by a distributed positional inverted index.

The documents are indexed once, in shards: for every term of its documents a
shard stores the term's ascending word positions. The test items come in blocks
of bounded bytes and windows, each written as a row of its own; the driver holds
one block at a time, and every shard looks all its phrases up. A phrase is
looked up from the term that is rarest in the shard: the term's positions, less
its place in the phrase, are intersected with those of the next rarest until
none is left or all terms have agreed. What the blocks find is merged by row.

Words are runs of ASCII letters and digits and of characters beyond ASCII, with
A-Z in lower case. Null text has no words. Items without words, or with null
text, are found nowhere; rows that repeat an item_id are one item; an item with
null id hits words and is not listed. A document without words has no hits.
Every row of documents is judged for itself, repeated ones too. Empty tables
give empty, or all-clean, results.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arterial.llm.common import bitmaps, discard, finished, in_bitmaps, materialize, numbered, slices

#: Words of a window.
WINDOW = 13
#: Bytes of words, and windows, of a block of items.
BLOCK_BYTES, BLOCK_WINDOWS = 4 << 20, 200_000
#: Bytes of text in a shard.
SHARD_BYTES = 8 << 20
#: A document is contaminated if 1 in so many of its words is hit.
SHARE = 20

_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)

SHARD = "rows array<long>, doc_ids array<long>, begins array<long>, n_words array<long>, terms binary, ends binary, places binary"
FOUND = "row long, spans array<struct<begin: long, end: long>>, items array<long>"

Item = tuple[int | None, bytes]


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split() if text else []


def build_index(docs: DataFrame, gap: int = WINDOW, row: Column | None = None) -> DataFrame:
    """One row per shard, written to the shared folder: its documents with the
    place of their first word, and the places of each term. ``gap`` places
    between two documents keep phrases from running over. Rows of docs get a
    number, unless ``row`` has it."""

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SHARD_BYTES):
            numbers: dict[bytes, int] = {}
            parts, begins, counts, at = [], [], [], 0
            for text in batch.column(2).to_pylist():
                words = words_of(text)
                for w in set(words).difference(numbers):
                    numbers[w] = len(numbers)
                parts.append(np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words)))
                begins.append(at)
                counts.append(len(words))
                at += len(words) + gap
            ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
            places = (np.arange(len(ids)) + gap * np.repeat(np.arange(len(counts)), counts)).astype(np.uint32)
            order = np.argsort(ids.astype(np.uint16) if len(numbers) < 1 << 16 else ids, kind="stable")
            ends = np.cumsum(np.bincount(ids, minlength=len(numbers)))
            row = [
                batch.column(0).to_pylist(),
                batch.column(1).to_pylist(),
                begins,
                counts,
                b" ".join(numbers),
                ends.astype(np.uint32).tobytes(),
                places[order].tobytes(),
            ]
            kinds = [pa.list_(pa.int64())] * 4 + [pa.binary()] * 3
            names = ["rows", "doc_ids", "begins", "n_words", "terms", "ends", "places"]
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names)

    number = F.monotonically_increasing_id() if row is None else row
    return materialize(docs.select(number.alias("row"), "doc_id", "text").mapInArrow(shard, SHARD), "positional-index")


class Shard:
    """A shard's postings, opened for look-ups."""

    def __init__(self, rows, doc_ids, begins, n_words, terms, ends, places):
        self.rows, self.doc_ids = rows, doc_ids
        self.begins, self.n_words = np.array(begins, np.int64), np.array(n_words, np.int64)
        self.number = {t: i for i, t in enumerate(terms.split())}
        # a last number stands for terms that the shard lacks
        self.to = np.append(np.frombuffer(ends, np.uint32).astype(np.int64), 0)
        self.size = np.append(np.diff(self.to[:-1], prepend=0), 0)
        self.places = np.frombuffer(places, np.uint32).astype(np.int64)

    def numbers(self, terms: list[bytes]) -> np.ndarray:
        lacking = len(self.number)
        return np.array([self.number.get(t, lacking) for t in terms], np.int64)

    def postings(self, term: int) -> np.ndarray:
        return self.places[self.to[term] - self.size[term] : self.to[term]]

    def phrase(self, terms: np.ndarray) -> np.ndarray:
        """Where the phrase starts, by its terms from the rarest on."""
        order = np.argsort(self.size[terms], kind="stable")
        starts = self.postings(terms[order[0]]) - order[0]
        for o in order[1:]:
            if not len(starts):
                break
            other = self.postings(terms[o]) - o
            at = np.searchsorted(other, starts)
            at[at == len(other)] = 0
            starts = starts[other[at] == starts] if len(other) else starts[:0]
        return starts

    def near(self, terms: np.ndarray, within: int) -> list[tuple[int, int]]:
        """The shortest spans of at most ``within`` words, each ending at its
        last term, that hold all the terms."""
        some = [self.postings(t) for t in terms.tolist()]
        if not all(map(len, some)):
            return []
        place = np.concatenate(some)
        which = np.repeat(np.arange(len(terms)), [len(x) for x in some])
        order = np.argsort(place, kind="stable")
        seen, spans = [-1] * len(terms), []
        for p, w in zip(place[order].tolist(), which[order].tolist()):
            seen[w] = p
            first = min(seen)
            if first >= 0 and p - first < within and self.document(first) == self.document(p):
                spans.append((first, p + 1))
        return spans

    def document(self, place: int) -> int:
        return int(np.searchsorted(self.begins, place, "right")) - 1


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            yield Shard(*row)


class Phrases:
    """The distinct windows of a block of items, with the items of each."""

    def __init__(self, items: list[Item], window: int):
        owners: dict[tuple[bytes, ...], set[int]] = {}
        for item, joined in items:
            words = joined.split()
            for i in range(max(1, len(words) - window + 1)):
                owners.setdefault(tuple(words[i : i + window]), set()).update(() if item is None else (item,))
        numbers: dict[bytes, int] = {}
        width = max(map(len, owners), default=1)
        self.sizes = [len(p) for p in owners]
        self.items = list(owners.values())
        # a phrase shorter than the others is filled up with its own first term
        self.grid = np.array([[numbers.setdefault(w, len(numbers)) for w in p] + [numbers[p[0]]] * (width - len(p)) for p in owners], np.int64).reshape(-1, width)
        self.terms = list(numbers)


def phrase_matches(index: DataFrame, items: list[Item], window: int = WINDOW) -> DataFrame:
    """row, spans (word ranges that the items' windows cover, merged) and items
    (ids of those found) of every indexed document with a match."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(items, window)
        for shard in _opened(batches):
            n = len(shard.rows)
            cover = np.zeros(int(shard.begins[-1] + shard.n_words[-1]) + 1 if n else 1, np.int32)
            found: dict[int, set[int]] = {}
            local = shard.numbers(phrases.terms)[phrases.grid]
            for w in np.flatnonzero((shard.size[local] > 0).all(axis=1)).tolist():
                size = phrases.sizes[w]
                starts = shard.phrase(local[w, :size])
                if len(starts):
                    np.add.at(cover, starts, 1)
                    np.add.at(cover, starts + size, -1)
                    for d in np.unique(np.searchsorted(shard.begins, starts, "right") - 1).tolist():
                        found.setdefault(d, set()).update(phrases.items[w])
            hit = np.flatnonzero(np.diff((np.cumsum(cover) > 0).astype(np.int8), prepend=0, append=0))
            spans: dict[int, list[dict]] = {d: [] for d in found}
            for b, e in hit.reshape(-1, 2).tolist():
                d = shard.document(b)
                base = int(shard.begins[d])
                spans[d].append({"begin": b - base, "end": e - base})
            kinds = [pa.int64(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])), pa.list_(pa.int64())]
            columns = [[shard.rows[d] for d in spans], list(spans.values()), [sorted(found[d]) for d in spans]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["row", "spans", "items"])

    return index.mapInArrow(find, FOUND)


def proximity_matches(index: DataFrame, terms: list[bytes], within: int) -> DataFrame:
    """doc_id, begin, end: spans of at most ``within`` words with all terms."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _opened(batches):
            rows = [(shard.doc_ids[d], b - int(shard.begins[d]), e - int(shard.begins[d])) for b, e in shard.near(shard.numbers(terms), within) for d in (shard.document(b),)]
            columns = list(zip(*rows)) if rows else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "begin", "end"])

    return index.mapInArrow(find, "doc_id long, begin long, end long")


def item_blocks(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """block, items: the items with words in blocks of at most BLOCK_BYTES of
    words and BLOCK_WINDOWS windows, written. An item of more is cut into parts
    that overlap by a window less a word, so no window is lost or new."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[Item] = []
        n_bytes = n_windows = 0

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(block)], pa.binary())], ["items"])

        for batch in slices(batches):
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                begin = 0
                while begin < len(words):
                    end, size = begin, 0
                    while end < len(words) and end - begin < BLOCK_WINDOWS + window - 1 and (size < BLOCK_BYTES or end - begin < window):
                        size += len(words[end]) + 1
                        end += 1
                    if block and (n_bytes + size > BLOCK_BYTES or n_windows + end - begin > BLOCK_WINDOWS):
                        yield closed()
                        block, n_bytes, n_windows = [], 0, 0
                    block.append((item, b" ".join(words[begin:end])))
                    n_bytes, n_windows = n_bytes + size, n_windows + end - begin
                    begin = len(words) if end == len(words) else end - window + 1
        if block:
            yield closed()

    rows = benchmark.select("item_id", "text").filter(F.col("text").isNotNull())
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # as few tasks as blocks are needed: each task's last block is not full
    dealt = rows.coalesce(1 + size // BLOCK_BYTES)
    return materialize(dealt.mapInArrow(cut, "items binary").select(F.monotonically_increasing_id().alias("block"), "items"), "item-blocks")


def _matches(docs: DataFrame, benchmark: DataFrame, window: int, row: Column | None = None) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """The index, row with spans and items of the documents that any item hits,
    and the tables that these are read from."""
    index = build_index(docs, window, row)
    blocks = item_blocks(benchmark, window)
    found: DataFrame | None = None
    tables = [index, blocks]
    for b in sorted(r.block for r in blocks.select("block").collect()):
        items = pickle.loads(blocks.filter(F.col("block") == b).first().items)
        tables.append(materialize(phrase_matches(index, items, window), "phrase-matches"))
        found = tables[-1] if found is None else found.unionByName(tables[-1])
    if found is None:
        found = index.select("rows").sparkSession.createDataFrame([], FOUND)
    merged = found.groupBy("row").agg(
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")
    )
    return index, merged, tables


def _judged(index: DataFrame, merged: DataFrame, share: int) -> DataFrame:
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("to"), F.lit(0).cast("long").alias("n")),
        lambda a, s: F.struct(
            F.greatest(a["to"], s["end"]).alias("to"),
            (a["n"] + F.greatest(s["end"] - F.greatest(a["to"], s["begin"]), F.lit(0))).alias("n"),
        ),
        lambda a: a["n"],
    )
    each = index.select(F.explode(F.arrays_zip("rows", "doc_ids", "n_words")).alias("d")).select(F.col("d.rows").alias("row"), F.col("d.doc_ids").alias("doc_id"), "d.n_words")
    out = each.join(merged, "row", "left")
    items = F.coalesce("items", F.array().cast("array<long>"))
    names = F.array_join(F.array_sort(F.transform(items, lambda i: i.cast("string"))), ",")
    return out.select(
        "row",
        "doc_id",
        "n_words",
        F.coalesce(covered, F.lit(0).cast("long")).alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"),
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row."""
    index, merged, tables = _matches(docs, benchmark, window)
    return finished(_judged(index, merged, share).drop("row"), "contamination", *tables)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns."""
    rows, own = numbered(docs)
    index, merged, tables = _matches(rows, benchmark, window, F.col(own))
    bad = materialize(_judged(index, merged, share).filter("contaminated").select(F.col("row").alias(own)), "contaminated-rows")
    discard(*tables)
    bits = bitmaps(bad, own)
    clean = in_bitmaps(rows, own, bits, inside=False) if bits else rows.join(bad, own, "left_anti")
    return finished(clean.select(*docs.columns), "clean-rows", rows, bad, bits)
