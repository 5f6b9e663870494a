"""Substring dedup by repeated-phrase automata.

A window is a fixed number of consecutive words of one document; it recurs if
its words also start anywhere else. Every word that a recurring window covers
is removed.

1. Anchors. Each window has an anchor: the smallest hash among its k-word
   grams, so equal windows have equal anchors. Neighbouring windows of one
   anchor make a segment, and one row stands for all of them.
2. Confirmation. An anchor that occurs once confirms nothing. If all segments
   of an anchor are equal, all their windows recur. Else one example of each
   different segment is taken apart into windows, and these are counted. Runs
   of recurring windows are passages, written with their words: one table of
   the distinct passages of the corpus.
3. Automata. Documents are dealt to shards of bounded bytes. A shard gets the
   passages that can occur in it, those of a segment that some document of it
   has, each once however often it occurs there. An Aho-Corasick automaton is
   compiled from them, word by word, and all documents of the shard are
   streamed through it whole. What it finds is removed; where passages occur is
   known from nothing else. Sending every document through every passage of the
   corpus would find the same and grow with the square of the corpus.

Step 2 compares hashes of 64 bits, of windows within an anchor of 64 bits; step
3 compares words.

Null text has no words; a text shorter than a window keeps all its words. Every
row is a document of its own, so repeated rows remove each other's words. A
null doc_id is an id like others. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arterial.llm.common import discard, finished, materialize, numbered, slices

#: Words of a window, and of the grams that anchor it.
WINDOW, GRAM = 35, 8

_ODD = np.uint64(0x9E3779B97F4A7C15)
_EVEN_OUT = np.uint64(0xBF58476D1CE4E5B9)
_powers: list[np.ndarray] = []


def words_of(text: str | None) -> list[bytes]:
    """Runs of bytes other than space and \\t \\n \\v \\f \\r."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _EVEN_OUT
    return x ^ (x >> np.uint64(29))


class Prefix:
    """Hashes of any stretch of words, from running sums of word hashes times
    powers of an odd number."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes) + 1
        if not _powers or len(_powers[0]) < n:
            inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
            size = max(n, 1 << 19)
            _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, f, np.uint64)])) for f in (_ODD, inverse)]
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * _powers[0][: n - 1])])

    def stretch(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        size = (end - begin).astype(np.uint64)
        return _mixed((self.sums[end] - self.sums[begin]) * _powers[1][begin] + size * _EVEN_OUT).view(np.int64)


def _sliding(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """best over x[i : i + width], for every i where that is whole."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = best(x[:-step], x[step:])
        have += step
    return x


def segments(lengths: list[int], hashes: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """For texts laid end to end: text, first and last window start (in words
    of the text), anchor, segment hash, and whether the segment may hold its
    anchor more than once."""
    empty = np.zeros(0, np.int64)
    if len(hashes) < window:
        return empty, empty, empty, empty, empty, empty.astype(bool)
    grams = np.zeros(len(hashes) - gram + 1, np.uint64)
    factor = 1
    for j in range(gram):
        factor = factor * int(_ODD) % (1 << 64)
        grams += hashes[j : len(grams) + j] * np.uint64(factor)
    grams = _mixed(grams)
    width = window - gram + 1
    least = _sliding(grams, width, np.minimum)
    ends = np.cumsum(np.array(lengths, np.int64))
    text = np.repeat(np.arange(len(lengths)), lengths)[: len(least)]
    valid = np.arange(len(least)) + window <= ends[text]
    # grams that are the least of some window
    low = np.where(valid, least, 0)
    padded = np.concatenate([np.zeros(width - 1, np.uint64), low, np.zeros(width - 1, np.uint64)])
    chosen = np.flatnonzero((grams == _sliding(padded, width, np.maximum)) & (grams > 0))
    value = grams[chosen]
    order = np.argsort(value, kind="stable")
    close = (value[order][1:] == value[order][:-1]) & (np.diff(chosen[order]) <= 2 * width)
    near = np.zeros(len(chosen), bool)
    near[order[1:][close]] = near[order[:-1][close]] = True
    # runs of windows with one anchor
    starts = np.flatnonzero(valid)
    if not len(starts):
        return empty, empty, empty, empty, empty, empty.astype(bool)
    new = np.ones(len(starts), bool)
    new[1:] = (least[starts[1:]] != least[starts[:-1]]) | (np.diff(starts) > 1) | (text[starts[1:]] != text[starts[:-1]])
    lo = starts[new]
    hi = starts[np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)]
    anchor = least[lo]
    at = np.searchsorted(chosen, lo)
    while True:
        wrong = value[at] != anchor
        if not wrong.any():
            break
        at[wrong] += 1
    base = (ends - np.array(lengths, np.int64))[text[lo]]
    seg = Prefix(hashes).stretch(lo, hi + window)
    return text[lo], lo - base, hi - base, anchor.view(np.int64), seg, near[at]


OCCURRENCES = "row long, lo int, hi int, anchor long, seg long, self boolean"


def _occurrences(rows: DataFrame, window: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            split = [words_of(t) for t in batch.column(1).to_pylist()]
            hashes = hashes_of([w for words in split for w in words])
            text, lo, hi, anchor, seg, self = segments([len(w) for w in split], hashes, window, gram)
            columns = [batch.column(0).take(pa.array(text, pa.int64())), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), pa.array(anchor), pa.array(seg), pa.array(self)]
            yield pa.RecordBatch.from_arrays(columns, ["row", "lo", "hi", "anchor", "seg", "self"])

    return rows.select("row", "text").mapInArrow(run, OCCURRENCES)


def _examples(texts: DataFrame, window: int) -> DataFrame:
    """anchor, seg, n, whole, words of each segment of which a text is the
    example; the words are joined by a space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for text, segs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                columns = [pa.array([s[k] for s in segs]) for k in ("anchor", "seg", "n", "whole")]
                columns.append(pa.array([b" ".join(words[s["lo"] : s["hi"] + window]) for s in segs], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, ["anchor", "seg", "n", "whole", "words"])

    return texts.select("text", "segs").mapInArrow(run, "anchor long, seg long, n long, whole boolean, words binary")


def _windows(examples: DataFrame, window: int) -> DataFrame:
    """anchor, seg, place, hash, n of each window of the example segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "words"):
            split = [w.split() for w in batch.column(3).to_pylist()]
            lengths = np.array([len(w) for w in split], np.int64)
            sizes = lengths - window + 1
            place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            begin = np.repeat(np.cumsum(lengths) - lengths, sizes) + place
            hashes = Prefix(hashes_of([w for words in split for w in words])).stretch(begin, begin + window)
            owner = pa.array(np.repeat(np.arange(len(split)), sizes))
            columns = [batch.column(0).take(owner), batch.column(1).take(owner), pa.array(place, pa.int32()), pa.array(hashes), batch.column(2).take(owner)]
            yield pa.RecordBatch.from_arrays(columns, ["anchor", "seg", "place", "hash", "n"])

    return examples.select("anchor", "seg", "n", "words").mapInArrow(run, "anchor long, seg long, place int, hash long, n long")


def _runs(partly: DataFrame, window: int) -> DataFrame:
    """anchor, seg, words of each run of recurring windows in a segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "words"):
            out: tuple[list, list, list] = ([], [], [])
            for anchor, seg, joined, places in zip(*(c.to_pylist() for c in batch.columns)):
                words, at = joined.split(), np.sort(np.array(places, np.int64))
                ends = np.append(np.flatnonzero(np.diff(at) > 1), len(at) - 1)
                for b, e in zip(at[np.append(0, ends[:-1] + 1)].tolist(), at[ends].tolist()):
                    for column, value in zip(out, (anchor, seg, b" ".join(words[b : e + window]))):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["anchor", "seg", "words"])

    return partly.select("anchor", "seg", "words", "places").mapInArrow(run, "anchor long, seg long, words binary")


def recurring(rows: DataFrame, window: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """The recurring passages of rows (row, text), anchor, seg, words, one of
    each segment that differs; and row, anchor, seg of the rows' segments of
    recurring anchors. Both are written."""
    found = materialize(_occurrences(rows, window, gram), "segments")
    anchors = found.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("n"), F.min("seg").alias("least"), F.max("seg").alias("most"), F.max("self").alias("self")
    )
    again = materialize(anchors.filter("n > 1 or self").select("anchor", F.expr("n > 1 and least = most").alias("whole")), "recurring-anchors")
    some = materialize(found.join(again, "anchor").select("row", "lo", "hi", "anchor", "seg", "whole"), "recurring-segments")
    discard(found, again)
    # of each different segment one example is taken
    segs = some.groupBy("anchor", "seg").agg(F.count(F.lit(1)).alias("n"), F.max("whole").alias("whole"), F.min(F.struct("row", "lo", "hi")).alias("e"))
    by_row = segs.groupBy("e.row").agg(F.collect_list(F.struct("anchor", "seg", "n", "whole", "e.lo", "e.hi")).alias("segs"))
    examples = materialize(_examples(rows.select("row", "text").join(by_row, "row"), window), "examples")
    mixed = examples.filter("not whole")
    windows = materialize(_windows(mixed, window), "windows")
    counted = windows.groupBy("anchor", "hash").agg(F.sum("n").alias("total")).filter("total > 1").select("anchor", "hash")
    # written: a join with an aggregate in its own stage could not split a common passage's rows
    counted = materialize(counted, "counted-windows")
    places = windows.join(counted, ["anchor", "hash"]).groupBy("anchor", "seg").agg(F.collect_set("place").alias("places"))
    places = materialize(places, "recurring-places")
    discard(windows, counted)
    whole = examples.filter("whole").select("anchor", "seg", "words")
    passages = materialize(whole.unionByName(_runs(mixed.join(places, ["anchor", "seg"]), window)), "passages")
    discard(examples, places)
    return passages, some


#: Second letters of words. The automaton looks through a node's children one by one.
SECOND = 512


class _Letters(dict):
    """Two letters of its own for each word that is asked for. No first letter
    is a second one, so an occurrence begins with a word."""

    def __missing__(self, word: bytes) -> str:
        first, second = divmod(len(self), SECOND)
        self[word] = letters = chr(1 + SECOND + first) + chr(1 + second)
        return letters


class _Known(dict):
    """The same letters; two that no passage has for any other word."""

    def __missing__(self, word: bytes) -> str:
        return "\0\0"


class Automaton:
    """An Aho-Corasick automaton over words: a word is two letters to it."""

    def __init__(self, passages: list[list[bytes]]):
        import ahocorasick

        letters = _Letters()
        self.machine = ahocorasick.Automaton()
        for words in passages:
            self.machine.add_word("".join(map(letters.__getitem__, words)), len(words))
        self.letters = _Known(letters)
        self.any = bool(passages)
        if self.any:
            self.machine.make_automaton()

    def covered(self, words: list[bytes]) -> np.ndarray:
        """Which words an occurrence of any passage covers."""
        change = np.zeros(len(words) + 1, np.int64)
        if self.any:
            found = list(self.machine.iter("".join(map(self.letters.__getitem__, words))))
            if found:
                last, sizes = np.array(found, np.int64).T
                ends = last // 2 + 1
                np.subtract.at(change, ends, 1)
                np.add.at(change, ends - sizes, 1)
        return np.cumsum(change[:-1]) > 0


#: Passages' words in one automaton; the letters of a shard must stay below the code points.
SHARD_WORDS = 400_000
#: Bytes of documents in a shard, about.
SHARD_BYTES = 4 << 20


def _covered(split: list[list[bytes]], passages: list[bytes]) -> list[np.ndarray]:
    """Which words of the texts an occurrence of any passage covers. As many
    automata as the passages need are compiled one after another."""
    gone = [np.zeros(len(words), bool) for words in split]
    part: list[list[bytes]] = []
    size = 0
    for i, passage in enumerate(passages):
        part.append(passage.split())
        size += len(part[-1])
        if size >= SHARD_WORDS or i == len(passages) - 1:
            machine = Automaton(part)
            for words, own in zip(split, gone):
                own |= machine.covered(words)
            part, size = [], 0
    return gone


def _removed(shards: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept from rows (shard, words, doc_id, text)
    sorted by shard; a shard's passages, with words, come before its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: int | None = None
        passages: dict[bytes, None] = {}
        ids: list[int | None] = []
        texts: list[str | None] = []
        held = 0

        def done() -> pa.RecordBatch:
            split = [words_of(t) for t in texts]
            rows = []
            for words, gone in zip(split, _covered(split, list(passages))):
                removed = int(gone.sum())
                kept = [words[i] for i in np.flatnonzero(~gone).tolist()] if removed else words
                rows.append((len(words), removed, b" ".join(kept)))
            n, removed, kept = zip(*rows)
            columns = [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept"])

        for batch in slices(batches):
            for own, words, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                # a shard of more than its share, as by a very long text, goes in parts
                if ids and (own != shard or held > 2 * SHARD_BYTES):
                    yield done()
                    ids, texts, held = [], [], 0
                if own != shard:
                    shard, passages = own, {}
                if words is not None:
                    passages[words] = None
                else:
                    ids.append(doc_id)
                    texts.append(text)
                    held += len(text or "")
        if ids:
            yield done()

    return shards.select("shard", "words", "doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept binary")


def _streamed(docs: DataFrame, window: int, gram: int) -> tuple[DataFrame, list[DataFrame]]:
    """doc_id, n_words, n_removed, kept, and the tables that this is read from."""
    rows, _ = numbered(docs.select("doc_id", "text"))
    passages, some = recurring(rows, window, gram)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shard = F.pmod(F.xxhash64("row"), F.lit(1 + size // SHARD_BYTES)).alias("shard")
    # written, so that the shards of a common passage can be split among tasks
    asked = materialize(some.select(shard, "anchor", "seg").distinct(), "asked-segments")
    discard(some)
    none = lambda kind: F.lit(None).cast(kind)
    sent = asked.join(passages, ["anchor", "seg"]).select("shard", "words", none("long").alias("doc_id"), none("string").alias("text"))
    read = rows.select(shard, none("binary").alias("words"), "doc_id", "text")
    dealt = sent.unionByName(read).repartition("shard").sortWithinPartitions("shard", F.col("words").isNull())
    return _removed(dealt), [rows, passages, asked]


def remove_recurring(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words kept, joined by a space)."""
    out, tables = _streamed(docs, window, gram)
    return finished(out.withColumn("kept", F.col("kept").cast("string")), "kept-words", *tables)


def kept_digest(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    out, tables = _streamed(docs, window, gram)
    return finished(out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")), "kept-digests", *tables)
