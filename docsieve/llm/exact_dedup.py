"""Exact deduplication by heavy-hitter split.

Texts are equal when identical after each run of blanks has become one space. Misra-Gries summaries of
all partitions find the digests that may be frequent; an exact count verifies them, and the verified
winners (fewer than ``1 / share`` of them, whatever the input) are broadcast, so that the copies of
frequent texts go on the map side. What remains, no digest of which has more than ``share`` of all rows,
is shuffled by digest. ``share`` is 1/512 or, with many shuffle partitions, a quarter of a partition's, so
that a group fits a task whatever the number of rows; 2^19 winners of 48 bytes at most are broadcast.

Defined cases: a null text is an empty one, and empty texts equal each other. A null id is larger than
any other. Of rows that repeat both id and normalised text one stays, in every run the same: the least by a hash of all columns.
Texts are hashed whole, however long. An empty table gives an empty result. Other
columns of the input, of whatever name, are carried in ``row``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsieve.llm.common import cut

SHARE = 1 / 512
LEAST_SHARE = 1 / (1 << 19)


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digested(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``digest`` (SHA-256 of the normalised text) and the whole input row as ``row``."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("digest"),
        F.struct("*").alias("row"),
    )


def misra_gries(digests: DataFrame, counters: int) -> DataFrame:
    """``digest`` and ``least``, for each partition: a digest on m of the n rows has m - n / counters at least.

    A batch's exact counts are added to the summary; beyond ``counters`` entries, the count of the
    largest entry that must go is taken from all.
    """

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, counts = np.zeros(0, "V32"), np.zeros(0, np.int64)
        for batch in batches:
            raw = b"".join(batch.column(0).to_pylist())
            keys = np.concatenate((names.view("S32"), np.frombuffer(raw, "S32")))
            weights = np.concatenate((counts, np.ones(len(keys) - len(counts), np.int64)))
            keys, where = np.unique(keys, return_inverse=True)
            totals = np.bincount(where, weights, len(keys)).astype(np.int64)
            if len(keys) > counters:
                totals -= np.partition(totals, len(totals) - counters - 1)[len(totals) - counters - 1]
            names, counts = keys[totals > 0].view("V32"), totals[totals > 0]
        yield pa.RecordBatch.from_arrays(
            [pa.array([bytes(x) for x in names.view("V32")], pa.binary()), pa.array(counts)], ["digest", "least"]
        )

    return digests.select("digest").mapInArrow(summarise, "digest binary, least long")


def frequent(digests: DataFrame, share: float | None = None) -> DataFrame:
    """Each digest with more than ``share`` of all rows, with ``keep_id`` and ``group_size``; bounded by 1 / share."""
    n = digests.count()
    if share is None:
        partitions = int(digests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        share = max(min(SHARE, 1 / (4 * partitions)), LEAST_SHARE)
    counters = int(np.ceil(2 / share))
    floor = n * share - n / counters  # what the summaries leave of a frequent digest at least
    maybe = (
        misra_gries(digests, counters)
        .groupBy("digest")
        .agg(F.sum("least").alias("least"))
        .where(F.col("least") >= F.lit(floor))
        .select("digest")
    )
    # At most n / floor = 2 / share candidates of 32 bytes: a bound that doesn't depend on the input.
    return (
        digests.join(F.broadcast(maybe), "digest")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where(F.col("group_size") > F.lit(n * share))
    )


def resolve(rows: DataFrame, winners: DataFrame) -> DataFrame:
    """Adds ``keep_id``, ``group_size`` and ``kept`` to rows with ``doc_id``, ``digest`` and ``number``, unique and fixed.

    Rows that repeat a frequent text's smallest id (or all have none) are told apart by ``number``; the least,
    found by a grouped minimum, is broadcast with the winners.
    """
    heavy = F.broadcast(winners.select("digest", F.col("keep_id").alias("heavy_id"), F.col("group_size").alias("heavy_size")))
    marked = rows.join(heavy, "digest", "left")
    first = marked.where("heavy_size IS NOT NULL AND doc_id <=> heavy_id").groupBy("digest").agg(F.min("number").alias("first"))
    frequent_rows = marked.where("heavy_size IS NOT NULL").join(F.broadcast(first), "digest")
    group = Window.partitionBy("digest")
    rest = (
        marked.where("heavy_size IS NULL")
        .withColumn("place", F.row_number().over(group.orderBy(F.col("doc_id").asc_nulls_last(), "number")))
        .withColumn("keep_id", F.min("doc_id").over(group))
        .withColumn("group_size", F.count(F.lit(1)).over(group))
        .withColumn("kept", F.col("place") == 1)
    )
    columns = [c for c in rows.columns if c != "number"] + ["keep_id", "group_size", "kept"]
    return rest.select(columns).unionByName(
        frequent_rows.withColumns({"keep_id": F.col("heavy_id"), "group_size": F.col("heavy_size"), "kept": F.col("number") == F.col("first")}).select(columns)
    )


def numbered(rows: DataFrame) -> DataFrame:
    """``doc_id`` and ``digest``, with a number of each row that is fixed in a checkpoint."""
    return cut(rows.select("doc_id", "digest", F.monotonically_increasing_id().alias("number")))


def told_apart(rows: DataFrame) -> Column:
    """A value that orders rows of one id and digest alike in every run: rows that share it are equal in all columns."""
    plain = not any(kind in rows.schema["row"].dataType.simpleString() for kind in ("map<", "variant"))
    return F.xxhash64(*([f"row.`{c}`" for c in rows.schema["row"].dataType.names] if plain else [F.to_json("row")]))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float | None = None) -> DataFrame:
    """One input row of each group of equal texts, that with the smallest id, with its columns as they were."""
    rows = digested(docs, id_col, text_col)
    slim = cut(rows.select("doc_id", "digest"))
    heavy = cut(frequent(slim, share)).select("digest", F.col("keep_id").alias("heavy_id"), F.lit(True).alias("heavy"))
    left = rows.join(F.broadcast(heavy), "digest", "left").where("heavy IS NULL OR doc_id <=> heavy_id")
    tie = told_apart(rows)
    order = Window.partitionBy("digest").orderBy(F.col("doc_id").asc_nulls_last(), tie)
    first = F.row_number().over(order)
    firsts = slim.join(F.broadcast(heavy), "digest").where("doc_id <=> heavy_id").groupBy("digest").count()
    if (firsts.agg(F.max("count").alias("most")).first()["most"] or 1) == 1:
        return left.withColumn("place", first).where("place = 1").select("row.*")
    # Rows repeat a frequent text's id (or none has one): each task sends one of them.
    one = left.where("heavy").groupBy("digest").agg(F.min_by("row", tie).alias("row")).select("row.*")
    rest = left.where("heavy IS NULL").withColumn("place", first).where("place = 1")
    return rest.select("row.*").unionByName(one)


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float | None = None) -> DataFrame:
    """A row for each input row: ``doc_id``, ``digest``, ``keep_id``, ``group_size`` and ``kept``."""
    slim = numbered(digested(docs, id_col, text_col))
    return resolve(slim, cut(frequent(slim, share)))
