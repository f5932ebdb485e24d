"""Helpers that the training-data operators share: inputs, row keys, checkpoints and Arrow batches."""

from __future__ import annotations

import gc
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a temporary one is set, but only for a local master."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="docsieve-checkpoint-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The rows of ``df``, written once to the shared checkpoint folder; later jobs read them there."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def let_go(spark: SparkSession) -> None:
    """Has the shuffles removed of tables that nothing names any more, as those that were cut.

    Spark's cleaner removes them when the driver's JVM has collected them, which it does seldom for want of memory alone.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def joinable(df: DataFrame, most: int = 100_000) -> DataFrame:
    """``df`` (rows of a few numbers, already cut), to be broadcast if it has ``most`` rows or fewer, else shuffled."""
    return F.broadcast(df) if df.count() <= most else df


def marked(rows: DataFrame, wanted: DataFrame, *keys: str, words: int = 1 << 18) -> DataFrame:
    """``rows`` with ``maybe``: true of all that have the keys of a row of ``wanted``, and of few others.

    The keys are noted as bits of ``words`` 64-bit words, which are broadcast, however many keys there are.
    """
    place = F.pmod(F.xxhash64(*keys), F.lit(64 * words))
    at = {"word": F.shiftright(place, 6), "bit": place.bitwiseAND(63).cast("int")}
    bits = wanted.select(*[c.alias(n) for n, c in at.items()]).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    found = rows.withColumn("at", F.struct(*[c.alias(n) for n, c in at.items()])).join(F.broadcast(bits), F.col("at.word") == F.col("word"), "left")
    return found.select(*rows.columns, F.coalesce(F.expr("getbit(bits, at.bit)") == 1, F.lit(False)).alias("maybe"))


def sifted(rows: DataFrame, wanted: DataFrame, *keys: str) -> DataFrame:
    """The rows that may have the keys of a row of ``wanted``, before a join that shuffles them. (Rows have no column ``maybe``, nor ``at``.)"""
    return marked(rows, wanted, *keys).where("maybe").drop("maybe")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Two columns, ``doc_id`` and ``text``; a null text is an empty one."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """``key``, ``doc_id`` and ``text``, where ``key`` is unique, not null, and ordered as ``doc_id``.

    The key is the id itself where ids are unique and present. A table with null or repeated ids gets
    keys by a range sort over (id, text), nulls last, fixed in a checkpoint: every row is then a
    document of its own. With ``whole``, the input row comes along as ``row``.
    """
    slim = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        *([F.struct("*").alias("row")] if whole else []),
    )
    worst = slim.groupBy("doc_id").count().agg(
        F.max("count").alias("most"), F.max(F.col("doc_id").isNull()).alias("gap")
    ).first()
    if worst["most"] is None or (worst["most"] == 1 and not worst["gap"]):
        # The filter changes nothing here; with it, joins of either kind share one shuffle of the texts.
        return slim.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("key"), *slim.columns)
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), F.col("text")]
    ranged = slim.repartitionByRange(*order).sortWithinPartitions(*order)
    return cut(ranged.select(F.monotonically_increasing_id().alias("key"), *slim.columns))


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have ``limit`` bytes at most, or one row each beyond it."""
    lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    at, total = 0, 0
    for i, n in enumerate(lengths):
        if i > at and total + n > limit:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += int(n)
    if at < len(lengths):
        yield batch.slice(at)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts of a column in one array, and the offsets of the texts."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema
    )


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(os.environ.get("DOCSIEVE_TOKENIZER", "byte_bpe_50k.json"))
