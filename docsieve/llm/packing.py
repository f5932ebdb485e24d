"""Packing by power-of-two decomposition.

A document of n tokens becomes pieces whose lengths are the powers of two in n (with as many of the
greatest length as fit), longest first. A sequence is one piece: none crosses documents, and as each has
the length of its bucket, none is padded. Sequences are numbered by bucket, so that a run of numbers is
a batch of equal lengths.

Token ids come as those of the given byte-level BPE file: the plain texts are merged with that file's
vocabulary by tiktoken, and texts with other than Latin letters, control characters or the name of a
special token by the tokenizers library itself.

Defined cases: a null or empty text is one piece of the end id alone; a null or repeated id is a
document of its own, its pieces carrying that id; an empty table gives no rows; very long texts give
many pieces of the greatest length. Other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsieve.llm.common import chunks, cut, joinable, texts

MAX_LENGTH = 2048
END_ID = 1
# The split pattern of byte-level BPE, and the bytes that it writes as themselves.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
UNUSUAL = re.compile("[^\t\n\x20-\x7e\xa1-ɏ]")


def decompose(n: int, longest: int = MAX_LENGTH) -> list[int]:
    """Lengths of a document's pieces, longest first."""
    return [longest] * (n // longest) + [1 << b for b in range(longest.bit_length() - 2, -1, -1) if n % longest >> b & 1]


def plain_byte_level(spec: dict) -> bool:
    """Whether a tokenizer file says no more than byte-level BPE whose merges are in the order of their ids.

    Only then do the ranks of the vocabulary and ``SPLIT`` give the file's ids.
    """
    split, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    special = {t["content"] for t in spec.get("added_tokens", [])}
    vocab = {t: i for t, i in model.get("vocab", {}).items() if t not in special}
    merges = [m if isinstance(m, list) else m.split(" ") for m in model.get("merges", [])]
    made = [vocab.get("".join(m)) for m in merges]
    return (
        split.get("type") == "ByteLevel"
        and not split.get("add_prefix_space")
        and split.get("use_regex", True)
        and spec.get("normalizer") is None
        and model.get("type") == "BPE"
        and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        and None not in made
        and all(a < b for a, b in zip(made, made[1:]))
        and len(vocab) == 256 + len(set(made))
    )


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    """A function from texts to their lists of ids, by the file at ``path``."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    import tiktoken
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if not plain_byte_level(spec):
        return lambda batch: [e.ids for e in exact.encode_batch(batch, add_special_tokens=False)]
    special = {t["content"] for t in spec.get("added_tokens", [])}
    others = iter(range(256, 512))
    byte_of = {chr(b if b in PRINTED else next(others)): b for b in range(256)}
    ranks = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    quick = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(batch: list[str]) -> list[list[int]]:
        out = []
        for text in batch:
            if UNUSUAL.search(text) or any(s in text for s in special):
                out.append(exact.encode(text, add_special_tokens=False).ids)
            else:
                out.append(quick.encode_ordinary(text))
        return out

    return encode


def pieces(docs: DataFrame, tokenizer: str, longest: int = MAX_LENGTH, end_id: int = END_ID) -> DataFrame:
    """``doc_id``, ``start``, ``length``, ``ids`` (little-endian 32-bit) and ``doc_tokens`` of each piece."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64())]
    )

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for whole in batches:
            for batch in chunks(whole):
                rows: tuple[list, ...] = ([], [], [], [], [])
                for doc, ids in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text").to_pylist())):
                    raw, at, n = np.array([*ids, end_id], "<u4").tobytes(), 0, len(ids) + 1
                    for length in decompose(n, longest):
                        for column, value in zip(rows, (doc, at, length, raw[4 * at : 4 * (at + length)], n)):
                            column.append(value)
                        at += length
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema)], schema=schema)

    return texts(docs).mapInArrow(cut_up, "doc_id long, start long, length long, ids binary, doc_tokens long")


def numbered(rows: DataFrame) -> DataFrame:
    """Adds ``sequence_id``, gapless over all pieces with equal lengths in a row, and ``offset``.

    Each partition's count of each length gives where its numbers begin: a row for each partition meets in
    the task of a length, and a row for each length in one place.
    """
    rows = cut(rows.withColumn("part", F.spark_partition_id()))
    counts = cut(rows.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")))
    totals = counts.groupBy("length").agg(F.sum("n").alias("all"))  # a row for each length
    longer = Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    lengths = totals.select("length", F.coalesce(F.sum("all").over(longer), F.lit(0)).alias("begin"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.join(F.broadcast(lengths), "length").select(
        "length", "part", (F.col("begin") + F.coalesce(F.sum("n").over(before), F.lit(0))).alias("first")
    )
    within = Window.partitionBy("part", "length").orderBy("doc_id", "start")
    return (
        rows.join(joinable(cut(starts)), ["length", "part"])
        .withColumn("sequence_id", F.col("first") + F.row_number().over(within) - 1)
        .withColumn("offset", F.lit(0).cast("long"))
        .drop("part", "first")
    )


def pack(docs: DataFrame, tokenizer: str, longest: int = MAX_LENGTH, end_id: int = END_ID) -> DataFrame:
    """The sequences of ``docs`` with their ids."""
    return numbered(pieces(docs, tokenizer, longest, end_id))
