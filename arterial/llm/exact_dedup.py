"""Exact dedup by deterministic block naming.

A text is cut into blocks of a fixed number of bytes. The distinct blocks are
sorted, and a block's place in the whole sorted list gives it an integer name.
Then adjacent names are paired and the distinct pairs sorted and named, again
and again, until each text has one name. Two texts of equally many blocks have
one name exactly when they are equal: names stand for content, not for a hash
of it. Lists are sorted over range partitions, and the partitions' lengths tell
where each begins, so names do not depend on the number of partitions.

Blocks are sorted by a 64-bit hash first, which also carries a name back to
where its block occurs. Hashes that two blocks share are looked for: such
blocks are sorted and matched by content.

Every row is a document of its own. Null text counts as empty, and equals the
empty text. Of a group, the row with the largest doc_id stays, and just one of
several rows that repeat it; null is smaller than all ids. An empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arterial.llm.common import discard, finished, materialize, numbered

#: Bytes of a block.
BLOCK_BYTES = 4096
#: Stands for the missing right half of the last pair.
NO_NAME = -1


def _blocks(block_bytes: int) -> Column:
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    last = F.floor(F.greatest(F.octet_length(text) - 1, F.lit(0)) / block_bytes).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * block_bytes + 1, F.lit(block_bytes)))


def _sorted_names(keys: DataFrame, label: str) -> DataFrame:
    """Keys with their place in the sorted list of all as name; written."""
    by = keys.columns
    placed = keys.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("place", F.monotonically_increasing_id())
    placed = materialize(placed, label)
    part = F.shiftright("place", 33)
    # one number a partition comes to the driver, and is broadcast back
    sizes = placed.groupBy(part.alias("part")).count().orderBy("part").collect()
    starts, before = [], 0
    for part_number, n in sizes:
        starts.append((part_number, before))
        before += n
    begin = F.broadcast(keys.sparkSession.createDataFrame(starts, "part long, begin long"))
    name = F.col("begin") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    named = placed.join(begin, part == F.col("part")).select(*by, name.alias("name"))
    named._arterial_path = placed._arterial_path
    return named


def _placed(docs: DataFrame, row: Column, block_bytes: int) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    each = docs.select(row.alias("row"), "doc_id", F.sha2(text, 256).alias("text_sha256"), _blocks(block_bytes).alias("blocks"))
    cut = each.select("row", "doc_id", "text_sha256", F.size("blocks").alias("n_blocks"), F.posexplode("blocks").alias("pos", "block"))
    return cut.withColumn("h", F.xxhash64("block"))


def identities(docs: DataFrame, block_bytes: int = BLOCK_BYTES, row: str | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """row, doc_id, text_sha256, n_blocks, name of each row of docs, where
    (n_blocks, name) is the text's identity and row a number of its own (that
    of the column ``row``, if named); and the tables that this is read from."""
    placed = _placed(docs, F.col(row) if row else F.monotonically_increasing_id(), block_bytes)
    occurrence = ["row", "doc_id", "text_sha256", "n_blocks", "pos"]
    names = _sorted_names(placed.select("h", "block").distinct().select("h"), "block-names")
    shared = names.groupBy("h").count().filter("count > 1").select("h")
    if shared.isEmpty():
        named = placed.select(*occurrence, "h").join(names, "h")
    else:  # two blocks of one hash: these are matched by content
        if not row:  # each row is read twice, and must keep its number
            docs, row = numbered(docs)
            placed = _placed(docs, F.col(row), block_bytes)
        shared = materialize(shared, "shared-hashes")
        again = placed.join(shared, "h", "left_semi")
        own = _sorted_names(again.select("h", "block").distinct(), "shared-names")
        plain = placed.join(shared, "h", "left_anti").join(names, "h").select(*occurrence, "name")
        named = plain.unionByName(again.join(own, ["h", "block"]).select(*occurrence, (-2 - F.col("name")).alias("name")))
    named = materialize(named.select(*occurrence, "name"), "named-blocks")
    discard(names)
    whole = named.filter("n_blocks = 1")
    rest = named.filter("n_blocks > 1")
    width = rest.agg(F.max("n_blocks")).first()[0] or 1
    key = ["row", "doc_id", "text_sha256", "n_blocks"]
    half = F.col("pos") % 2
    last: DataFrame | None = None
    while width > 1:
        pairs = rest.groupBy(*key, F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(
            F.max(F.when(half == 0, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(half == 1, F.col("name"))), F.lit(NO_NAME).cast("long")).alias("right"),
        )
        pairs = materialize(pairs, "pairs")
        pair_names = _sorted_names(pairs.select("left", "right").distinct(), "pair-names")
        rest = materialize(pairs.join(pair_names, ["left", "right"]).select(*occurrence, "name"), "named-pairs")
        discard(pairs, pair_names, last)
        last = rest
        width = (width + 1) // 2
    return whole.unionByName(rest).drop("pos"), [named, *([last] if last else [])]


def _groups(docs: DataFrame, block_bytes: int, row: str | None = None) -> tuple[DataFrame, list[DataFrame]]:
    each, tables = identities(docs, block_bytes, row)
    # written: a join with an aggregate in its own stage could not split a large group's rows
    groups = each.groupBy("n_blocks", "name").agg(F.max(F.struct("doc_id", "row")).alias("stays"), F.count(F.lit(1)).alias("group_size"))
    groups = materialize(groups, "groups")
    return each.join(groups, ["n_blocks", "name"]), [groups, *tables]


def duplicate_groups(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of docs."""
    joined, tables = _groups(docs, block_bytes)
    out = joined.select("doc_id", F.col("stays.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("stays.row")).alias("kept"), "text_sha256")
    return finished(out, "duplicate-groups", *tables)


def drop_duplicates(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs that stay, with all their columns: one of each group."""
    rows, own = numbered(docs)
    joined, tables = _groups(rows, block_bytes, own)
    stays = materialize(joined.filter("row = stays.row").select(F.col("row").alias(own)), "rows-that-stay")
    discard(*tables)
    return finished(rows.join(stays, own, "left_semi").select(*docs.columns), "kept-rows", rows, stays)
