"""Reading tables, cutting lineage and slicing Arrow batches, for all operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arterial.plans.lineage import discard, finished, materialize, shared_dir

__all__ = ["SLICE_BYTES", "bitmaps", "discard", "finished", "in_bitmaps", "materialize", "numbered", "shared_dir", "slices", "table"]

#: Bytes of text that one Python step takes from an Arrow batch at a time.
SLICE_BYTES = 2 << 20
#: Bitmaps, of 4 kB and 32,768 numbers each, that are broadcast at most.
BITMAPS = 8_192


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _apart(name: str, df: DataFrame) -> str:
    """The name, or one like it, that no column of df has."""
    while name in [c.lower() for c in df.columns]:
        name = f"_{name}"
    return name


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs, written with a number of its own for each row, and the name of
    that column, which none of docs has."""
    name = _apart("row", docs)
    return materialize(docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def bitmaps(ids: DataFrame, column: str, most: int | None = None) -> DataFrame | None:
    """The numbers of a column as bitmaps (bucket, bits), written; or None if
    they lie in too many buckets to be broadcast."""
    spread = ids.select(F.bitmap_bucket_number(column).alias("bucket"), F.bitmap_bit_position(column).alias("bit")).filter("bucket is not null")
    if spread.select("bucket").distinct().count() > (BITMAPS if most is None else most):
        return None
    return materialize(spread.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")), "bitmaps")


def in_bitmaps(rows: DataFrame, column: str, bits: DataFrame, inside: bool = True) -> DataFrame:
    """The rows whose number is in the bitmaps, or those whose number is not;
    they stay where they are, so nothing of them is shuffled."""
    theirs = _apart("bitmap", rows)
    place = F.bitmap_bit_position(column)
    octet = F.conv(F.hex(F.substring(F.col(theirs)["bits"], (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = F.coalesce(F.getbit(octet, (place % 8).cast("int")) == 1, F.lit(False))
    own = F.broadcast(bits.select(F.struct("bucket", "bits").alias(theirs)))
    joined = rows.join(own, F.bitmap_bucket_number(column) == F.col(theirs)["bucket"], "left")
    return joined.filter(found if inside else ~found).select(*rows.columns)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice holds about ``limit`` bytes of ``column``
    or one row, whichever is more."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        begin = total = 0
        for row, size in enumerate(sizes):
            if row > begin and total + size > limit:
                yield batch.slice(begin, row - begin)
                begin, total = row, 0
            total += int(size)
        if batch.num_rows > begin:
            yield batch.slice(begin)
