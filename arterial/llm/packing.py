"""Best-fit packing with certified bin counts.

Texts become token ids with an end id; one longer than a sequence is cut, the
first piece taking what is left over. Pieces are dealt to partitions, which
pack them best fit decreasing. A dual-feasible function f maps fractions of a
sequence to fractions so that any set that fits sums to at most 1; the largest
sum of f over the pieces is a lower bound of the bins. A partition whose bins
meet its bound is certified and closed but for its emptiest one. One with a gap
closes its full bins and passes the pieces of the others on; these are dealt
anew among fewer partitions, and best fit decreasing runs again, until one
partition is left or what is left is too much for half as many.

Null text counts as empty: one piece, the end id. Rows that repeat a doc_id are
packed each for itself. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arterial.llm.common import finished, materialize, slices
from arterial.llm.tokens import END_ID, SLICE_BYTES, VOCABULARY, encoder

#: Tokens of a sequence.
CAPACITY = 2048
#: Pieces that one partition packs at a time.
PIECES_PER_PARTITION = 50_000
#: Partitions whose gaps meet in one of the next round.
MERGE = 8

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(vocabulary), np.array([END_ID], dtype="<u4").tobytes()
        for batch in slices(batches, limit=SLICE_BYTES):
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1))):
                ids += end
                n = len(ids) // 4
                begins = [0] if n <= capacity else [*([0] if n % capacity else []), *range(n % capacity, n, capacity)]
                for piece, (b, e) in enumerate(zip(begins, [*begins[1:], n])):
                    rows.append((doc_id, piece, b, e - b, zlib.crc32(ids[4 * b : 4 * e])))
            columns = list(zip(*rows)) if rows else [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])
        enc.forget()

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """The largest bound of two families of dual-feasible functions: f_e, which
    raises pieces over capacity - e to a whole and drops those under e, and the
    rounding function u_k(x) = floor((k + 1) x) / k where (k + 1) x is not whole."""
    if not len(lengths):
        return 0
    counts = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    sizes = np.arange(capacity + 1, dtype=np.int64)
    weight = counts * sizes
    best = -(-int(weight.sum()) // capacity)
    many, heavy = np.cumsum(counts), np.cumsum(weight)
    e = np.arange(1, capacity // 2 + 1)
    whole = many[capacity] - many[capacity - e]
    between = heavy[capacity - e] - heavy[e - 1]
    best = max(best, int((whole + -(-between // capacity)).max()))
    for k in range(1, 21):
        scaled = (k + 1) * sizes
        f = np.where(scaled % capacity == 0, sizes * k, scaled // capacity * capacity)  # times k * capacity
        best = max(best, -(-int((counts * f).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each piece, and what each bin has free."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set if a bin has r free
    free: list[int] = []
    for at, length in zip(order.tolist(), lengths[order].tolist()):
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(free)
            free.append(capacity)
        bins[at], offsets[at] = b, capacity - room
        left = free[b] = room - length
        if left:
            open_bins[left].append(b)
            rooms |= 1 << left
    return bins, offsets, np.array(free, np.int64)


def _packer(columns: dict[str, str], capacity: int, last: bool, base: int) -> Callable[[pa.Table], pa.Table]:
    """Packs a group of pieces; those that it passes on get a null sequence."""

    def run(group: pa.Table) -> pa.Table:
        lengths = group["length"].to_numpy().astype(np.int64)
        bins, offsets, free = best_fit_decreasing(lengths, capacity)
        if last:
            passed = np.zeros(len(bins), bool)
        elif len(free) > lower_bound(lengths, capacity):
            passed = free[bins] > 0
        else:  # certified, but for what rounding up leaves in the emptiest bin
            passed = (bins == free.argmax()) & (free.max() > 0)
        ids = base + (group[columns["group"]][0].as_py() << 28) + bins
        for name, values in ((columns["sequence"], pa.array(ids, pa.int64(), mask=passed)), (columns["offset"], pa.array(offsets, pa.int64()))):
            group = group.set_column(group.schema.get_field_index(name), name, values)
        return group

    return run


def next_groups(groups: int, left: int, per_partition: int) -> int:
    """Groups of the next round, so that none is to hold more than
    ``per_partition`` pieces; as many as now where less than half would do no
    longer, which ends the rounds."""
    wanted = max(-(-groups // MERGE), -(-left // per_partition), 1)
    return wanted if 2 * wanted <= groups else groups


def pack(pieces: DataFrame, capacity: int = CAPACITY, per_partition: int = PIECES_PER_PARTITION) -> DataFrame:
    """The pieces with sequence_id and offset. pieces may have further columns
    beside length; all are kept.

    Every round deals the pieces that are left to groups of equal expected size
    by the hash of a row number, so that no group depends on ids or on what
    other groups passed on. Where best fit leaves too much for fewer groups
    (lengths of which no set fills a sequence), the groups close all bins: no
    group ever holds much more than ``per_partition`` pieces."""
    names = pieces.columns
    lower = [c.lower() for c in names]
    free = lambda c: c if c not in lower else free(f"_{c}")
    columns = {c: free(c) for c in ("row", "group", "sequence", "offset")}
    row, group, sequence, offset = columns.values()
    none = F.lit(None).cast("long")
    source = materialize(pieces.withColumn(row, F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-source.count() // per_partition))
    last, level, closed, done = groups == 1, 0, [], [source]
    while True:
        key = F.pmod(F.xxhash64(row, F.lit(level)), F.lit(groups)).cast("long")
        dealt = source.select(*names, row, key.alias(group), none.alias(sequence), none.alias(offset))
        # the grouped function holds its group's pieces only, a bounded number
        packed = materialize(dealt.groupBy(group).applyInArrow(_packer(columns, capacity, last, level << 56), dealt.schema), "packed")
        done.append(packed)
        closed.append(packed.filter(F.col(sequence).isNotNull()))
        if last:
            break
        source = packed.filter(F.col(sequence).isNull())
        was, groups = groups, next_groups(groups, source.count(), per_partition)
        last, level = groups in (1, was), level + 1
    out = closed[0]
    for more in closed[1:]:
        out = out.unionByName(more)
    out = out.select(*names, F.col(sequence).alias("sequence_id"), F.col(offset).alias("offset"))
    return finished(out, "sequences", *done)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(token_pieces(docs, capacity, vocabulary), capacity)
