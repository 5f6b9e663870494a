"""Token output as one wavelet matrix per shard.

A wavelet matrix stores a sequence of ids as bit-planes, the highest bit first;
after each plane the ids are parted stably by that bit. With counts of ones
before each block of a plane, an id is read at any place, its occurrences up to
a place are counted (rank) and its k-th occurrence is found (select), in as
many steps as an id has bits. A shard's file is a header, a directory and the
planes' blocks, each compressed for itself, so that a look-up opens one block a
plane. Files are kept as binary values in a Parquet container, with the shard's
documents beside them: Spark writes and reads it in any store. Named a path,
they stay there, and ``open_shards`` opens them again; ``ids_at``, ``counts``
and ``occurrences`` look ids up in them without decoding any.

Documents are written in ascending doc_id order; null ids come first, and rows
that repeat an id follow each other in the order of their texts. Null text
counts as empty: the end id alone. An empty table gives no file and no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arterial.llm.common import materialize, slices
from arterial.llm.tokens import END_ID, SLICE_BYTES, VOCABULARY, encoder

#: Ids of a shard, about: a shard ends with the document that reaches it.
SHARD_TOKENS = 1_000_000
#: Bytes of a block of a plane.
BLOCK_BYTES = 16_384
MAGIC = b"WVMX0001"
HEADER = struct.Struct("<8sQII")

SHARD = "part int, shard int, n_tokens long, doc_ids array<long>, starts array<long>, file binary"


def _parting(bit: np.ndarray, zeros: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray, slice, slice]]:
    """For spans of a plane: where in the span its zeros and its ones are, and
    the runs of the next plane that they go to."""
    zero, one = 0, zeros
    for at in range(0, len(bit), 8 * BLOCK_BYTES):
        span = slice(at, at + 8 * BLOCK_BYTES)
        low, high = np.flatnonzero(~bit[span]), np.flatnonzero(bit[span])
        yield span, low, high, slice(zero, zero + len(low)), slice(one, one + len(high))
        zero, one = zero + len(low), one + len(high)


class WaveletMatrix:
    """Reads a file made by ``build``."""

    def __init__(self, file: bytes):
        magic, self.n, self.bits, self.blocks = HEADER.unpack_from(file)
        if magic != MAGIC:
            raise ValueError("not a wavelet matrix file")
        at = HEADER.size
        self.zeros = np.frombuffer(file, "<u8", self.bits, at).astype(np.int64)
        at += 8 * self.bits
        cells = self.bits * self.blocks
        self.ones = np.frombuffer(file, "<u8", cells, at).reshape(self.bits, self.blocks).astype(np.int64)
        at += 8 * cells
        self.ends = np.frombuffer(file, "<u8", cells, at).astype(np.int64)
        self.file, self.base = file, at + 8 * cells
        self._open: dict[int, np.ndarray] = {}

    @staticmethod
    def build(ids: np.ndarray) -> bytes:
        n, bits = len(ids), max(1, int(ids.max()).bit_length() if len(ids) else 1)
        x = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        blocks = -(-n // (8 * BLOCK_BYTES))
        zeros, ones, ends, out, total = [], [], [], [], 0
        press = zstandard.ZstdCompressor(level=1)
        for level in range(bits - 1, -1, -1):
            bit = (x >> level) & 1 != 0
            plane = np.packbits(bit, bitorder="little").tobytes()
            counts = np.array([np.count_nonzero(bit[at : at + 8 * BLOCK_BYTES]) for at in range(0, n, 8 * BLOCK_BYTES)], np.int64)
            ones.append(np.cumsum(counts) - counts)
            for b in range(blocks):
                out.append(press.compress(plane[b * BLOCK_BYTES : (b + 1) * BLOCK_BYTES]))
                total += len(out[-1])
                ends.append(total)
            zeros.append(n - int(counts.sum()))
            parted = np.empty_like(x)
            for span, low, high, zero, one in _parting(bit, zeros[-1]):
                parted[zero], parted[one] = x[span].take(low), x[span].take(high)
            x = parted
        head = [HEADER.pack(MAGIC, n, bits, blocks), np.array(zeros, "<u8").tobytes(), np.array(ones, "<u8").tobytes(), np.array(ends, "<u8").tobytes()]
        return b"".join(head + out)

    def _block(self, level: int, block: int, keep: bool = True) -> np.ndarray:
        cell = level * self.blocks + block
        bits = self._open.get(cell)
        if bits is None:
            begin = int(self.ends[cell - 1]) if cell else 0
            raw = zstandard.ZstdDecompressor().decompress(self.file[self.base + begin : self.base + int(self.ends[cell])])
            bits = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")
            if keep:
                self._open[cell] = bits
        return bits

    def _rank1(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block, rest = divmod(i, 8 * BLOCK_BYTES)
        if block == self.blocks:
            return self.n - int(self.zeros[level])
        return int(self.ones[level, block]) + int(self._block(level, block)[:rest].sum())

    def _bit(self, level: int, i: int) -> int:
        block, rest = divmod(i, 8 * BLOCK_BYTES)
        return int(self._block(level, block)[rest])

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.bits):
            one = self._bit(level, i)
            before = self._rank1(level, i)
            i = int(self.zeros[level]) + before if one else i - before
            value = value << 1 | one
        return value

    def _range(self, symbol: int, i: int) -> tuple[int, int]:
        """Where the symbol's run starts below the last plane, and where its
        occurrences among the first i ids end."""
        first = 0
        for level in range(self.bits):
            a, b = self._rank1(level, first), self._rank1(level, i)
            if symbol >> (self.bits - 1 - level) & 1:
                first, i = int(self.zeros[level]) + a, int(self.zeros[level]) + b
            else:
                first, i = first - a, i - b
        return first, i

    def rank(self, symbol: int, i: int) -> int:
        """Occurrences of the symbol among the first i ids."""
        if symbol < 0 or symbol.bit_length() > self.bits:
            return 0
        first, end = self._range(symbol, i)
        return end - first

    def count(self, symbol: int, begin: int = 0, end: int | None = None) -> int:
        return self.rank(symbol, self.n if end is None else end) - self.rank(symbol, begin)

    def _select(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) such bit of a plane."""
        before = self.ones[level] if bit else np.arange(self.blocks) * 8 * BLOCK_BYTES - self.ones[level]
        block = int(np.searchsorted(before, k, "right")) - 1
        return block * 8 * BLOCK_BYTES + int(np.flatnonzero(self._block(level, block) == bit)[k - int(before[block])])

    def select(self, symbol: int, k: int) -> int:
        """Place of the symbol's k-th occurrence, from 0."""
        if not 0 <= k < self.rank(symbol, self.n):
            raise IndexError(k)
        i = self._range(symbol, self.n)[0] + k
        for level in range(self.bits - 1, -1, -1):
            if symbol >> (self.bits - 1 - level) & 1:
                i = self._select(level, 1, i - int(self.zeros[level]))
            else:
                i = self._select(level, 0, i)
        return i

    def occurrences(self, symbol: int) -> list[int]:
        return [self.select(symbol, k) for k in range(self.rank(symbol, self.n))]

    def decode(self) -> np.ndarray:
        """All ids, by undoing the partings from the last plane up."""
        x = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for level in range(self.bits - 1, -1, -1):
            plane = [self._block(level, b, keep=False) for b in range(self.blocks)]
            bit = (np.concatenate(plane)[: self.n] if plane else np.zeros(0, np.uint8)).view(bool)
            up = np.empty_like(x)
            mark = x.dtype.type(1 << (self.bits - 1 - level))
            for span, low, high, zero, one in _parting(bit, int(self.zeros[level])):
                up[span][low], up[span][high] = x[zero], x[one] | mark
            x = up
        return x


def write_shards(docs: DataFrame, path: str | None = None, vocabulary: str = VOCABULARY, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode, write the shards' files in doc_id order, and open them again.
    Without a path they are kept in the shared folder while the session lasts."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(vocabulary), np.array([END_ID], "<u4").tobytes()
        part, shard = TaskContext.get().partitionId(), 0
        ids, docs_in, starts, n = [], [], [], 0

        def closed() -> pa.RecordBatch:
            file = WaveletMatrix.build(np.frombuffer(b"".join(ids), "<u4"))
            row = [part, shard, n, docs_in, starts, file]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], ["part", "shard", "n_tokens", "doc_ids", "starts", "file"])

        for batch in slices(batches, limit=SLICE_BYTES):
            for doc_id, own in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1))):
                ids += [own, end]
                docs_in.append(doc_id)
                starts.append(n)
                n += len(own) // 4 + 1
                if n >= shard_tokens:
                    yield closed()
                    ids, docs_in, starts, n = [], [], [], 0
                    shard += 1
        enc.forget()
        if n:
            yield closed()

    rows = docs.select("doc_id", "text")
    shards = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(write, SHARD)
    if path is None:
        return materialize(shards, "wavelet-shards")
    shards.write.parquet(path)  # files are compressed already; an existing path raises
    return open_shards(docs.sparkSession, path)


def open_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHARD).parquet(path)


def shard_bases(shards: DataFrame) -> DataFrame:
    """part, shard, base: ids before each shard. The driver gets one number a
    partition of the writing job."""
    sizes = shards.select("part", "shard", "n_tokens")
    parts = sorted((r.part, r.n) for r in sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    before, rows = 0, []
    for part, n in parts:
        rows.append((part, before))
        before += n
    offsets = shards.sparkSession.createDataFrame(rows, "part int, part_base long")
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    own = sizes.withColumn("own", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return own.join(offsets, "part").select("part", "shard", (F.col("part_base") + F.col("own")).alias("base"))


def read_documents(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, shard, n, doc_ids, starts, file in zip(*(c.to_pylist() for c in batch.columns)):
                ids = WaveletMatrix(file).decode().astype("<u4").tobytes()
                ends = [*starts[1:], n]
                columns = [
                    pa.array(doc_ids, pa.int64()),
                    pa.array([part] * len(doc_ids), pa.int32()),
                    pa.array([shard] * len(doc_ids), pa.int32()),
                    pa.array(starts, pa.int64()),
                    pa.array([e - b for b, e in zip(starts, ends)], pa.int64()),
                    pa.array([zlib.crc32(ids[4 * b : 4 * e]) for b, e in zip(starts, ends)], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "shard", "at", "n_tokens", "ids_crc32"])

    rows = shards.mapInArrow(read, "doc_id long, part int, shard int, at long, n_tokens long, ids_crc32 long")
    return rows.join(shard_bases(shards), ["part", "shard"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def _placed(found: DataFrame, shards: DataFrame) -> DataFrame:
    """found (part, shard, at, ..) with at as place among the ids of all shards."""
    both = found.join(shard_bases(shards), ["part", "shard"])
    return both.withColumn("place", F.col("base") + F.col("at")).drop("part", "shard", "at", "base")


def ids_at(shards: DataFrame, places: DataFrame) -> DataFrame:
    """place, id: the ids at the places (a column of that name, from 0) of all
    documents laid end to end; places beyond the end give no row, and places
    that repeat one each. A place meets the shards of its part of the sequence
    by their bases: places are dealt to buckets as long as the longest shard."""
    bases = materialize(shard_bases(shards).join(shards.select("part", "shard", "n_tokens"), ["part", "shard"]), "shard-bases")
    width = bases.agg(F.max("n_tokens")).first()[0]
    if width is None:
        return places.select("place", F.lit(0).alias("id")).limit(0)
    bucket = lambda c: F.floor(F.col(c) / width) if isinstance(c, str) else F.floor(c / width)
    covers = bases.withColumn("bucket", F.explode(F.sequence(bucket("base"), bucket(F.col("base") + F.col("n_tokens") - 1))))
    wanted = places.select("place", bucket("place").alias("bucket")).join(covers, "bucket")
    inside = wanted.filter("place >= base and place < base + n_tokens").select("part", "shard", (F.col("place") - F.col("base")).alias("at"))
    # distinct places by shard, so that a shard's file meets each of them once
    lists = inside.distinct().groupBy("part", "shard").agg(F.collect_list("at").alias("ats"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, shard, file, ats in zip(*(c.to_pylist() for c in batch.columns)):
                matrix = WaveletMatrix(file)
                columns = [[part] * len(ats), [shard] * len(ats), ats, [matrix.access(i) for i in ats]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.int64()))], ["part", "shard", "at", "id"])

    asked = shards.join(lists, ["part", "shard"]).select("part", "shard", "file", "ats")
    found = _placed(asked.mapInArrow(read, "part int, shard int, at long, id long"), shards)
    return places.select("place").join(found, "place").select("place", "id")


def _looked_up(shards: DataFrame, symbols: list[int], places: bool) -> DataFrame:
    """part, shard, id, and n or the places in the shard, of each symbol."""
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64()]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, shard, file in zip(*(c.to_pylist() for c in batch.columns)):
                matrix = WaveletMatrix(file)
                for s in dict.fromkeys(symbols):
                    found = matrix.occurrences(s) if places else [matrix.count(s)]
                    columns = [[part] * len(found), [shard] * len(found), [s] * len(found), found]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["part", "shard", "id", "at"])

    return shards.select("part", "shard", "file").mapInArrow(look, "part int, shard int, id long, at long")


def counts(shards: DataFrame, symbols: list[int]) -> DataFrame:
    """id, n: how often each id occurs in all documents."""
    return _looked_up(shards, symbols, False).groupBy("id").agg(F.sum("at").alias("n"))


def occurrences(shards: DataFrame, symbols: list[int]) -> DataFrame:
    """id, doc_id, offset, place: every occurrence of the ids, with its place in
    its document and among the ids of all."""
    found = _looked_up(shards, symbols, True)

    def owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, shard, doc_ids, starts, ids, ats in zip(*(c.to_pylist() for c in batch.columns)):
                begins = np.array(starts, np.int64)
                own = np.searchsorted(begins, np.array(ats, np.int64), "right") - 1
                n = len(ats)
                columns = [[part] * n, [shard] * n, ids, [doc_ids[i] for i in own], np.array(ats, np.int64) - begins[own], ats]
                kinds = [pa.int32(), pa.int32()] + [pa.int64()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["part", "shard", "id", "doc_id", "offset", "at"])

    # of one shard, so no more than it has ids
    lists = found.groupBy("part", "shard").agg(F.collect_list("id").alias("ids"), F.collect_list("at").alias("ats"))
    rows = shards.join(lists, ["part", "shard"]).select("part", "shard", "doc_ids", "starts", "ids", "ats")
    return _placed(rows.mapInArrow(owners, "part int, shard int, id long, doc_id long, offset long, at long"), shards)
