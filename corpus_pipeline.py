"""Corpus pipeline: toxicity, exact deduplication, near-duplicate join, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. Rows with null texts are kept as empty documents by the first stages (one of them by the
exact deduplication) and end as a sequence of the end id alone. A row with a null or repeated id is a
document of its own. Texts are read whole, however long; one must fit a Python worker. Other columns, of
whatever names, come along unchanged until the last stage, which returns its own. An empty table gives an
empty one at every stage; without labels nothing is toxic, and without benchmark items nothing leaks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.llm import decontamination, exact_dedup, jaccard_join, packing, toxicity
from docsieve.llm.common import default_tokenizer, table

#: Near duplicates share 80 % of their five-word shingles.
NEAR = jaccard_join.Rule(k=5, percent=80)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain doesn't reject; it is trained on the labelled ones of ``docs``."""
    return toxicity.remove_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.exact_dedup(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each connected group of near duplicates, that with the least id."""
    return jaccard_join.one_of_each(docs, NEAR)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The plan of the sequences: each piece's place in its document and its sequence, with a checksum of its ids."""
    found = packing.pieces(docs, default_tokenizer())
    return packing.numbered(
        found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    )


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: The classifier, the connected groups and the token ids aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
