"""Language identification by rank-order profiles.

A profile lists the most frequent character n-grams (one to three letters, with
word ends) in order. The distance of a document to a language is the sum over
the document's own most frequent n-grams of how far out of place each stands in
the language's list; one that is not listed is as far out as the list is long.
Profiles are counted over all training rows.

A null text, or one without a letter, gives ``und`` and score 0; so does any
text where nothing could be learned. Ties go to the first language by name.
Rows with null lang teach nothing; rows with null doc_id are scored and teach
nothing. Repeated rows are counted and scored each for itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arterial.llm.common import slices

#: N-grams of a profile.
PROFILE = 300
#: Distinct n-grams that a task gathers before it adds them up.
GATHERED = 1_000_000
#: Partitions that give their most frequent n-grams to the driver.
TOP_PARTITIONS = 16

UNDETERMINED = "und"
_letters: list[np.ndarray] = []


def _symbols() -> np.ndarray:
    """A table from code point to a 12-bit symbol of its small letter; 0 where
    there is no letter. Letters beyond the first 4096 code points share the
    upper half of the symbols."""
    if not _letters:
        out = np.zeros(0x110000, np.uint16)
        for cp in range(0x110000):
            c = chr(cp)
            if c.isalpha():
                low = ord(c.lower()[0])
                out[cp] = low if low < 4096 else 2048 + low % 2048
        _letters.append(out)
    return _letters[0]


def ngrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text index, n-gram and count, ordered by the two."""
    codes, owners = [], []
    table = _symbols()
    for i, t in enumerate(texts):
        if t:
            s = table[np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)]
            codes += [np.zeros(1, np.uint16), s]
            owners.append((i, len(s) + 1))
    codes.append(np.zeros(1, np.uint16))
    s = np.concatenate(codes).astype(np.int64)
    who = np.repeat(np.array([o for o, _ in owners] + [0], np.int64), np.array([n for _, n in owners] + [1]))
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] > 0) | (s[:-1] > 0)  # one sign for a word end
    s, who = s[keep], who[keep]
    one = s > 0
    two = one[:-1] | one[1:]
    three = one[1:-1]
    who = who << 38
    grams = np.concatenate(
        [
            (who | (1 << 36) | s)[one],
            (np.maximum(who[:-1], who[1:] * one[1:]) | (2 << 36) | (s[:-1] << 12) | s[1:])[two] if len(s) > 1 else s[:0],
            (who[1:-1] | (3 << 36) | (s[:-2] << 24) | (s[1:-1] << 12) | s[2:])[three] if len(s) > 2 else s[:0],
        ]
    )
    grams.sort()
    first = np.flatnonzero(np.diff(grams, prepend=-1))
    counts = np.diff(first, append=len(grams))
    grams = grams[first]
    return grams >> 38, grams & ((1 << 38) - 1), counts


def count_ngrams(docs: DataFrame) -> DataFrame:
    """lang, gram, n over all rows of docs whose lang is not null."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs: dict[str, int] = {}
        keys, counts, held = [], [], 0

        def added() -> tuple[np.ndarray, np.ndarray]:
            key = np.concatenate(keys)
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.diff(key, prepend=-1))
            return key[first], np.add.reduceat(np.concatenate(counts)[order], first) if len(first) else key[:0]

        for batch in slices(batches):
            own = np.array([langs.setdefault(x, len(langs)) for x in batch.column(1).to_pylist()], np.int64)
            who, gram, n = ngrams(batch.column(0).to_pylist())
            keys.append(own[who] << 38 | gram if len(who) else gram)
            counts.append(n)
            held += len(gram)
            if held > GATHERED:
                key, n = added()
                keys, counts, held = [key], [n], 0
        if keys:
            key, n = added()
            names = np.array(list(langs), object)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[key >> 38] if len(key) else [], pa.string()), pa.array(key & ((1 << 38) - 1), pa.int64()), pa.array(n, pa.int64())],
                ["lang", "gram", "n"],
            )

    rows = docs.filter(F.col("lang").isNotNull()).select("text", "lang")
    return rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn_profiles(docs: DataFrame, size: int = PROFILE) -> dict[str, list[int]]:
    """The ``size`` most frequent n-grams of each language, in order. Only they
    come to the driver: each of a few partitions sends its own most frequent."""

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, list[tuple[int, int]]] = {}
        for batch in batches:
            for lang, gram, n in zip(*(c.to_pylist() for c in batch.columns)):
                best.setdefault(lang, []).append((-n, gram))
            for lang, rows in best.items():
                best[lang] = sorted(rows)[:size]
        rows = [(lang, gram, -n) for lang, some in best.items() for n, gram in some]
        lang, gram, n = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(gram, pa.int64()), pa.array(n, pa.int64())], ["lang", "gram", "n"])

    found: dict[str, list[tuple[int, int]]] = {}
    for lang, gram, n in count_ngrams(docs).coalesce(TOP_PARTITIONS).mapInArrow(top, "lang string, gram long, n long").collect():
        found.setdefault(lang, []).append((-n, gram))
    return {lang: [g for _, g in sorted(found[lang])[:size]] for lang in sorted(found)}


def identify(docs: DataFrame, profiles: dict[str, list[int]], size: int = PROFILE) -> DataFrame:
    """doc_id, lang_pred, score (1 - distance / the largest possible one)."""
    langs = list(profiles)
    grams = np.unique(np.array([g for p in profiles.values() for g in p], np.int64))
    ranks = np.full((len(grams) + 1, len(langs)), size, np.int32)
    for j, p in enumerate(profiles.values()):
        ranks[np.searchsorted(grams, np.array(p, np.int64)), j] = np.arange(len(p))
    absent = len(grams)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            who, gram, n = ngrams(batch.column(1).to_pylist())
            pred, value = [UNDETERMINED] * batch.num_rows, np.zeros(batch.num_rows)
            begins = np.flatnonzero(np.diff(who, prepend=-1))
            tops, lens = [], []
            for b, e in zip(begins.tolist(), [*begins[1:].tolist(), len(who)]):
                c = n[b:e]
                if e - b > size:
                    # all that reach the size-th count, so that ties fall by n-gram
                    at = np.flatnonzero(c >= np.partition(c, e - b - size)[e - b - size])
                else:
                    at = np.arange(e - b)
                at = at[np.argsort(-c[at], kind="stable")][:size]
                tops.append(at + b)
                lens.append(len(at))
            if tops and langs:
                lens = np.array(lens)
                starts = np.cumsum(lens) - lens
                mine = gram[np.concatenate(tops)]
                rank = np.arange(len(mine)) - np.repeat(starts, lens)
                at = np.minimum(np.searchsorted(grams, mine), absent - 1)
                there = ranks[np.where(grams[at] == mine, at, absent)]
                out = np.where(there < size, np.abs(there - rank[:, None]), size)
                distance = np.add.reduceat(out, starts, axis=0)
                best = distance.argmin(axis=1)
                value[who[begins]] = 1 - distance[np.arange(len(best)), best] / (lens * size)
                for i, j in zip(who[begins].tolist(), best.tolist()):
                    pred[i] = langs[j]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(value, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(score, "doc_id long, lang_pred string, score double")


def held_out(modulus: int, remainder: int) -> Column:
    """Whether crc32(doc_id as text) leaves the remainder; false for null."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(False))
