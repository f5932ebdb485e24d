"""Contiguous balanced shards from global byte-size prefix sums.

Rows are ordered by id. A range sort fixes their order, each partition's total gives where it begins in
the whole, and a row goes to the shard in which its first byte falls when the total is cut at equal
targets. No task sees more than its partition; only one row per partition meets in one place.

Defined cases: a null text has no bytes; a null id comes last; rows that repeat an id are ordered by
size and checksum, and equal rows take the places of each other; an empty table gives no rows. A row
larger than a target leaves shards after it empty. Other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsieve.llm.common import cut, keyed

ROW_OVERHEAD = 8


def assign_shards(
    docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", number_col: str | None = None
) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``first_byte`` (of all), ``shard`` and ``slot`` (gapless in the shard).

    With ``number_col``, a column that tells rows apart, rows come in its order and it is kept as ``number``.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    order = [F.col("doc_id").asc_nulls_last(), F.col("size"), F.col("text_crc32")]
    number = [] if number_col is None else [F.col(number_col).cast("long").alias("number")]
    order = [F.col("number")] if number else order
    slim = docs.select(
        *number,
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    ranged = cut(
        slim.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    )
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = totals.select(  # a row for each partition
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("part_byte"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("part_row"),
        F.sum("bytes").over(everything).alias("total"),
    )
    within = Window.partitionBy("part").orderBy(*order)
    placed = (
        ranged.join(F.broadcast(starts), "part")
        .withColumn("ahead", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("first_byte", F.col("part_byte") + F.coalesce("ahead", F.lit(0)))
        .withColumn("place", F.col("part_row") + F.row_number().over(within) - 1)
        .withColumn("shard", F.expr(f"cast((cast(first_byte as decimal(38, 0)) * {int(shards)}) div total as int)"))
        .drop("ahead", "part", "part_byte", "part_row", "total")
    )
    placed = cut(placed)
    firsts = placed.groupBy("shard").agg(F.min("place").alias("shard_place"))  # a row for each shard
    return placed.join(F.broadcast(firsts), "shard").select(
        *(["number"] if number else []), "doc_id", "size", "text_crc32", "first_byte", "shard", (F.col("place") - F.col("shard_place")).alias("slot")
    )


def write_shards(docs: DataFrame, path: str, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the input rows as Parquet under ``shard=N`` folders, in slot order, and returns the assignment.

    Each row finds its shard by a key of its own (``keyed``), so null and repeated ids are written once each.
    """
    rows = keyed(docs, id_col, text_col, whole=True)
    placed = cut(assign_shards(rows, shards, "doc_id", "text", number_col="key"))
    where = placed.select(F.col("number").alias("key"), "shard", "slot")
    (
        rows.join(where, "key")
        .repartitionByRange("shard", "slot")
        .sortWithinPartitions("shard", "slot")
        .select("row", "slot", "shard")
        .write.mode("overwrite")
        .partitionBy("shard")
        .parquet(path)
    )
    return placed.drop("number")
