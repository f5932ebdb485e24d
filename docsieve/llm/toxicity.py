"""Toxicity by classifier chains.

Categories are predicted one after another by logistic models. The model of a category also reads the
probabilities of the categories before it; in training these are out-of-fold predictions, so that a model
never learns from a probability whose model has seen the same row. Features are chosen anew for each fold,
without its rows, so these haven't seen it either.

Features are the presence of words (A-Z in lower case) and of their first ``STEM`` bytes, hashed into
buckets; those that tell toxic rows from others by their likelihood ratio on the training rows are kept,
``MAX_FEATURES`` at most. The chain is fitted on a bounded sample of the labelled documents (``MAX_TRAIN``,
those whose ids have the least hashes, one of each text); all documents are scored over their whole texts
in one pass without a shuffle.

Defined cases: null and empty texts have no words and get the base rates; labels that repeat an id, and
those of equal texts, count by their maximum; those with a null id or label, or of no document, aren't
used; without a row of either class for a category its probability is its base rate, and without labelled
rows it is 0, so that nothing is rejected. Repeated rows get equal scores, an empty table none. Texts are scored whole,
however long; other columns, whatever their names, are not read by the scoring and are kept as they are by the filter.
Of features that tell as much, those with the least hash are taken.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.llm.common import chunks, cut, flat, texts
from docsieve.llm.hashing import LOWER, Rolling, byte_values, mix, word_spans

MAX_TRAIN = 20_000
FOLDS = 5
BUCKETS = 1 << 22
STEM = 6
MAX_FEATURES = 256
LEAST_RATIO = 25.0  # of chi-squared with one degree of freedom: one word in two million by chance
LEAST_ROWS = 4
THRESHOLD = 0.5
#: In the order of the chain; the last decides.
CATEGORIES = ("toxic_prose", "toxic_junk", "toxic")
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def word_buckets(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """For each distinct (text, bucket) of words and stems: the text's number in the batch and the bucket."""
    raw, offsets = flat(batch.column("text"))
    low = LOWER[raw]
    starts, ends, first = word_spans(low, offsets, _WORD)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rolling, stems = Rolling(byte_values(low)), np.minimum(ends, starts + STEM)
    hashes = np.concatenate((rolling.ranges(starts, ends), mix(rolling.ranges(starts, stems))))
    doc = np.tile(np.repeat(np.arange(batch.num_rows), np.diff(first)), 2)
    both = np.unique(doc * BUCKETS + (hashes % np.uint64(BUCKETS)).astype(np.int64))
    return both // BUCKETS, both % BUCKETS


def training_rows(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> DataFrame:
    """``text_hash``, ``toxic``, ``quality`` and ``buckets`` of the sampled labelled documents' texts, ``most`` at most."""
    rows = labels.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"), F.col("quality").cast("int").alias("quality")
    )
    sample = (
        rows.where("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.least(F.max("toxic"), F.lit(1)).alias("toxic"), F.coalesce(F.max("quality"), F.lit(1)).alias("quality"))
        .join(texts(docs).select("doc_id"), "doc_id", "left_semi")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)  # of three numbers each: small enough to broadcast, whatever the input
    )

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole):
                doc, bucket = word_buckets(batch)
                split = np.searchsorted(doc, np.arange(batch.num_rows + 1))
                hashes = [hashlib.blake2b((t or "").encode(), digest_size=8).hexdigest() for t in batch.column("text").to_pylist()]
                buckets = pa.ListArray.from_arrays(pa.array(split, pa.int32()), pa.array(bucket, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes), batch.column("toxic"), batch.column("quality"), buckets],
                    ["text_hash", "toxic", "quality", "buckets"],
                )

    return (
        texts(docs)
        .join(F.broadcast(sample), "doc_id")
        .mapInArrow(features, "text_hash string, toxic int, quality int, buckets array<int>")
        .groupBy("text_hash")
        .agg(F.max("toxic").alias("toxic"), F.max("quality").alias("quality"), F.first("buckets").alias("buckets"))
    )


def category_labels(toxic: np.ndarray, quality: np.ndarray) -> dict[str, np.ndarray]:
    """Of each category, the 0/1 labels."""
    return {"toxic_prose": toxic & (quality > 0), "toxic_junk": toxic & (quality <= 0), "toxic": toxic}


def telling_buckets(rows: DataFrame, folds: int = FOLDS) -> list[list[int]]:
    """The buckets whose presence tells toxic training rows from others, ``MAX_FEATURES`` at most.

    One list for each fold, from the rows of the others, and last that of all rows. The measure is twice the
    log-likelihood ratio of two binomial counts against one common rate.
    """
    parts = [F.col("fold") != k for k in range(folds)] + [F.lit(True)]
    each = rows.select("toxic", "fold", F.explode("buckets").alias("bucket"))

    def sums(part: Column, i: int) -> list[Column]:
        pos, neg = F.sum(F.when(part, F.col("toxic"))), F.sum(F.when(part, 1 - F.col("toxic")))
        return [F.coalesce(x, F.lit(0)).cast("double").alias(f"{n}{i}") for n, x in (("pos", pos), ("neg", neg))]

    both = [c for i, part in enumerate(parts) for c in sums(part, i)]
    totals, counts = rows.agg(*both).first(), cut(each.groupBy("bucket").agg(*both).where(F.col(f"pos{folds}") + F.col(f"neg{folds}") >= LEAST_ROWS))
    chosen = []
    for i in range(folds + 1):
        n_pos, n_neg = totals[f"pos{i}"], totals[f"neg{i}"]
        if not n_pos or not n_neg:
            chosen.append([])
            continue
        ratio = likelihood_ratio(F.col(f"pos{i}"), F.col(f"neg{i}"), n_pos, n_neg).alias("ratio")
        best = counts.where(F.col(f"pos{i}") + F.col(f"neg{i}") >= LEAST_ROWS).select("bucket", ratio).where(F.col("ratio") >= LEAST_RATIO)
        chosen.append(sorted(r["bucket"] for r in best.orderBy(F.desc("ratio"), "bucket").limit(MAX_FEATURES).collect()))
    return chosen


def likelihood_ratio(pos: Column, neg: Column, n_pos: float, n_neg: float) -> Column:
    rate = (pos + neg) / (n_pos + n_neg)

    def term(count, expected):
        return F.when(count > 0, count * F.log(count / expected)).otherwise(0.0)

    return 2 * (
        term(pos, n_pos * rate) + term(neg, n_neg * rate)
        + term(n_pos - pos, n_pos * (1 - rate)) + term(n_neg - neg, n_neg * (1 - rate))
    )


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 40) -> np.ndarray:
    """Weights, the intercept last, by Newton's method with a ridge on all but the intercept."""
    x1 = np.column_stack((x, np.ones(len(x))))
    w, penalty = np.zeros(x1.shape[1]), np.full(x1.shape[1], ridge)
    penalty[-1] = 1e-6
    rate = min(max(y.mean(), 1e-4), 1 - 1e-4) if len(y) else 1e-4
    w[-1] = np.log(rate / (1 - rate))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        v = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((x1 * v[:, None]).T @ x1 + np.diag(penalty), x1.T @ (y - p) - penalty * w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-4:
            break
    return w


def predict(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


@dataclass
class Chain:
    """A fitted chain: the kept buckets, and for each category its weights (features, earlier ones, intercept)."""

    buckets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    rates: dict[str, float] = field(default_factory=dict)

    def scores(self, x: np.ndarray) -> dict[str, np.ndarray]:
        out: dict[str, np.ndarray] = {}
        for name in CATEGORIES:
            if name in self.weights:
                earlier = [out[c] for c in CATEGORIES[: CATEGORIES.index(name)]]
                out[name] = predict(np.column_stack((x, *earlier)), self.weights[name])
            else:
                out[name] = np.full(len(x), self.rates.get(name, 0.0))
        return out


def fit_chain(rows: list, buckets: list[list[int]]) -> Chain:
    """Fits on collected training rows with the kept ones of their buckets; the sample's bound limits both.

    ``buckets`` are those of each fold and, last, of all rows, as ``telling_buckets`` returns them.
    """
    rows = sorted(rows, key=lambda r: r["text_hash"])
    toxic = np.array([r["toxic"] > 0 for r in rows], bool)
    quality = np.array([r["quality"] for r in rows], int)
    chain = Chain(np.array(buckets[-1], np.int64))
    if not rows:
        return chain
    names = np.unique(np.concatenate([np.asarray(b, np.int64) for b in buckets]))
    x = np.zeros((len(rows), len(names)))
    for i, r in enumerate(rows):
        x[i, np.searchsorted(names, r["buckets"])] = 1
    columns = [np.searchsorted(names, b) for b in buckets]
    fold = np.array([r["fold"] for r in rows])
    out_of_fold: list[np.ndarray] = []
    for name, y in category_labels(toxic, quality).items():
        y = y.astype(float)
        chain.rates[name] = float(y.mean())
        own = np.full(len(y), y.mean())
        if 0 < y.sum() < len(y):
            for k, chosen in enumerate(columns[:-1]):
                seen = fold != k
                if 0 < y[seen].sum() < seen.sum():
                    inputs = np.column_stack((x[:, chosen], *out_of_fold))
                    own[~seen] = predict(inputs[~seen], fit_logistic(inputs[seen], y[seen]))
            chain.weights[name] = fit_logistic(np.column_stack((x[:, columns[-1]], *out_of_fold)), y)
        out_of_fold.append(own)
    return chain


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN, folds: int = FOLDS) -> Chain:
    rows = cut(training_rows(docs, labels, most)).withColumn("fold", F.pmod(F.xxhash64("text_hash"), F.lit(folds)).cast("int"))
    buckets = telling_buckets(rows, folds)
    every = sorted({b for some in buckets for b in some})
    kept = F.array_intersect("buckets", F.array(*map(F.lit, every))) if every else F.array().cast("array<int>")
    return fit_chain(rows.select("text_hash", "toxic", "quality", "fold", kept.alias("buckets")).collect(), buckets)


def score(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, a probability ``p_`` of each category, and ``toxic``: the last one is at ``threshold`` or above."""
    names = [f"p_{c}" for c in CATEGORIES]

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole):
                p = text_scores(batch, chain)
                columns = [pa.array(p[c]) for c in CATEGORIES]
                flags = pa.array(p[CATEGORIES[-1]] >= threshold)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, flags], ["doc_id", *names, "toxic"])

    return texts(docs).mapInArrow(rate, "doc_id long, " + ", ".join(f"{n} double" for n in names) + ", toxic boolean")


def text_scores(batch: pa.RecordBatch, chain: Chain) -> dict[str, np.ndarray]:
    doc, bucket = word_buckets(batch)
    x = np.zeros((batch.num_rows, len(chain.buckets)))
    if len(chain.buckets):
        where = np.minimum(np.searchsorted(chain.buckets, bucket), len(chain.buckets) - 1)
        hit = chain.buckets[where] == bucket
        x[doc[hit], where[hit]] = 1
    return chain.scores(x)


def remove_toxic(docs: DataFrame, chain: Chain, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The input rows that the chain doesn't reject, with their columns as they were, in one pass."""
    columns = docs.columns

    def flagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, text_col):
                one = pa.RecordBatch.from_arrays([batch.column(text_col)], ["text"])
                keep = text_scores(one, chain)[CATEGORIES[-1]] < threshold
                yield batch.filter(pa.array(keep))

    return docs.select(columns).mapInArrow(flagged, docs.schema)
