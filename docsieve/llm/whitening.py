"""Embedding whitening by matrix-free block subspace iteration.

Each entry c becomes the whole number x = floor(64 * c) + 1000000. The sums S of all x are exact, rows are
centred before anything is multiplied, and the covariance V is never formed: each Spark pass computes
X'(XQ) over the centred rows for a block Q of directions, a row of ``d x block`` doubles for each partition,
which are added in a few tasks. Between passes the driver holds matrices of the vectors' dimension only: QR
makes the block orthonormal, Rayleigh-Ritz turns it to the eigenvectors, and the residual of each of the k
pairs, ``|V u - e u|``, says how far it is from one. Passes go on until all k residuals are within
``TOLERANCE`` of the largest eigenvalue. Where they shrink too slowly, as in a flat spectrum, the block is
doubled by the residuals themselves; as wide as the vectors, it holds the eigenvectors after one pass, so
that the iteration ends for every input.

Defined cases: a vector that is null, or holds null or non-finite entries, is dropped; the dimension is the
largest length of any vector, and a shorter one lacks entries, as if they were null. Entries whose x is
beyond 2^52 in size count as 2^52. A null id stays null; repeated ids are rows of their own; equal vectors count
as often as they occur. Directions without variance (those beyond the rank: one vector, all vectors equal,
fewer vectors than components) have no whitened value, and no rows. An empty table, or one without a usable vector, gives no
rows. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPONENTS = 32
SCALE, SHIFT = 64.0, 1_000_000
#: A component is certified when its residual is at most this share of the largest eigenvalue.
TOLERANCE = 1e-13
#: The block is doubled where the residuals' shrinking says that more passes than these are still needed.
PATIENCE = 12
#: Entries of vectors that are taken at once, and bytes of partial sums that are brought to the driver at most, but for one sum.
ENTRIES, GATHERED = 1 << 20, 1 << 27
LARGEST = float(1 << 52)


@dataclass(frozen=True)
class Moments:
    """``n`` vectors with the exact sums ``n * mean + rest`` of each dimension, 0 <= rest < n."""

    n: int
    mean: np.ndarray
    rest: np.ndarray

    @property
    def dimension(self) -> int:
        return len(self.mean)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> list[int]:
        """Of each row the sum over dimensions of (n * x - S) ** 2, exactly: n * x - S = n * (x - mean) - rest."""
        y = x - self.mean
        largest = int(np.abs(y).max(initial=0))
        if largest * max(largest, self.n) * self.dimension >= 1 << 62:
            y = y.astype(object)
        squares, mixed = (y * y).sum(1).tolist(), (y * self.rest).sum(1).tolist()
        own = sum(r * r for r in self.rest.tolist())
        return [self.n * self.n * a - 2 * self.n * b + own for a, b in zip(squares, mixed)]


@dataclass(frozen=True)
class Basis:
    """Unit ``vectors`` (a column each) of the covariance with falling ``values``, its ``trace``, the ``residuals`` and the passes taken."""

    vectors: np.ndarray
    values: np.ndarray
    trace: float
    residuals: np.ndarray
    passes: int


def entries(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    return embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))


def usable(batch: pa.RecordBatch, dimension: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and x of the vectors of a batch that are whole and finite, some at a time."""
    step = max(1, ENTRIES // max(dimension, 1))
    for low in range(0, batch.num_rows, step):
        part = batch.slice(low, step)
        lengths = part.column("vector").value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
        part = part.filter(pa.array(lengths == dimension))
        values = part.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dimension)
        fine = np.isfinite(values).all(1)  # a null entry is no number here
        x = np.clip(np.floor(SCALE * values[fine]) + SHIFT, -LARGEST, LARGEST).astype(np.int64)
        yield part.column("vec_id").filter(pa.array(fine)), x


def moments(vectors: DataFrame) -> Moments | None:
    """Number and exact sums of all usable vectors; None where there are none."""
    dimension = vectors.agg(F.max(F.size("vector")).alias("most")).first()["most"]
    if not dimension or dimension < 1:
        return None

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dimension
        for batch in batches:
            for _, x in usable(batch, dimension):
                n += len(x)
                high, low = (x >> 26).sum(0).tolist(), (x & ((1 << 26) - 1)).sum(0).tolist()
                total = [t + (a << 26) + b for t, a, b in zip(total, high, low)]
        if n:
            sums = pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(range(dimension), pa.int32()), pa.array([n] * dimension, pa.int64()), sums], ["at", "n", "total"])

    found = vectors.mapInArrow(add, "at int, n long, total decimal(38,0)").groupBy("at").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
    if not found:
        return None
    n = int(found[0]["n"])
    parts = [divmod(int(r["total"]), n) for r in sorted(found, key=lambda r: r["at"])]
    return Moments(n, np.array([p[0] for p in parts], np.int64), np.array([p[1] for p in parts], np.int64))


def summed(vectors: DataFrame, fit: Moments, of: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The sum over all chunks of centred rows of ``of`` (a matrix of the given shape).

    Each partition adds its own, a few tasks add those of the partitions, and the driver adds the tasks'. What
    it gets is bounded by the shape, whatever the number of vectors.
    """
    size = shape[0] * shape[1] * 8
    slots = max(1, min(16, GATHERED // size))

    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for _, x in usable(batch, fit.dimension):
                total += of(fit.centred(x))
        slot = TaskContext.get().partitionId() % slots
        yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["slot", "block"])

    def slot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for block in batch.column("block"):
                total += np.frombuffer(block.as_buffer()).reshape(shape)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["block"])

    added = vectors.mapInArrow(partition, "slot int, block binary").repartition(slots, "slot").mapInArrow(slot, "block binary")
    return sum((np.frombuffer(r["block"]).reshape(shape) for r in added.toLocalIterator()), np.zeros(shape))


def subspace(vectors: DataFrame, fit: Moments, k: int = COMPONENTS, block: int | None = None, seed: int = 0) -> Basis:
    """The k leading eigenvectors of the covariance of the usable vectors (fewer where its rank is less)."""
    d = fit.dimension
    k = min(k, d)
    width = min(d, max(k, block or k + max(8, k // 2)))
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, width)))[0]
    passes, full, before = 0, 0, np.inf
    while True:
        b = q.shape[1]

        def product(c: np.ndarray, q: np.ndarray = q) -> np.ndarray:
            return np.vstack([c.T @ (c @ q), np.full((1, q.shape[1]), (c * c).sum())])

        got = summed(vectors, fit, product, (d + 1, b)) / fit.n
        y, trace = got[:d], float(got[d, 0])
        passes, full = passes + 1, full + (b == d)
        small = q.T @ y
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        u, vu = q @ turn, y @ turn
        residual = vu - u * values
        sizes = np.linalg.norm(residual, axis=0)
        limit, worst = TOLERANCE * max(values[0], 0.0), float(sizes[:k].max())
        # A block of full width is exact but for rounding; its second pass is as near as doubles come.
        if worst <= limit or full == 2:
            rank = int((values[:k] > max(values[0], 0.0) * d * 1e-14).sum())
            return Basis(u[:, :rank], values[:rank], trace, sizes[:rank], passes)
        rate = worst / before
        slow = rate >= 1 or (rate > 0 and np.log(limit / worst) / np.log(rate) > PATIENCE)
        before = worst
        if b < d and passes > 2 and slow:
            more = min(b, d - b)
            fresh = residual[:, :more] / np.maximum(sizes[:more], 1e-300)
            q, before = np.linalg.qr(np.hstack([u, fresh]))[0], np.inf
        else:
            q = np.linalg.qr(vu)[0]


def whiten(embeddings: DataFrame, k: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding", block: int | None = None) -> DataFrame:
    """A row for each usable vector and component: the deviation from the mean, the whitened coordinate and the component's share.

    ``vec_id``, ``component`` (from 1, by falling eigenvalue), ``n``, ``deviation`` (decimal, exact), ``whitened``,
    ``explained``, ``residual`` (relative to the largest eigenvalue), ``passes`` and ``identity_error``, the largest entry
    of the whitened rows' covariance less the identity, from a pass of its own.
    """
    vectors = entries(embeddings, id_col, vector_col)
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, residual double, passes int, identity_error double"
    fit = moments(vectors)
    basis = subspace(vectors, fit, k, block) if fit else None
    found = len(basis.values) if basis else 0
    if not found:
        return embeddings.sparkSession.createDataFrame([], schema)
    scaled = basis.vectors / np.sqrt(basis.values)

    def products(c: np.ndarray) -> np.ndarray:
        z = c @ scaled
        return np.vstack([z.T @ z, z.sum(0)[None]])

    total = summed(vectors, fit, products, (found + 1, found)) / fit.n
    error = float(np.abs(total[:found] - np.outer(total[found], total[found]) - np.eye(found)).max())
    explained, residuals = basis.values / basis.trace, basis.residuals / basis.values[0]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, x in usable(batch, fit.dimension):
                rows = len(ids)
                deviations = pa.array([Decimal(v) for v in fit.deviations(x)], pa.decimal128(38, 0))
                again = pa.array(np.repeat(np.arange(rows), found))
                columns = [
                    ids.take(again), pa.array(np.tile(np.arange(1, found + 1, dtype=np.int32), rows)), pa.array(np.full(rows * found, fit.n)),
                    deviations.take(again), pa.array((fit.centred(x) @ scaled).ravel()), pa.array(np.tile(explained, rows)),
                    pa.array(np.tile(residuals, rows)), pa.array(np.full(rows * found, basis.passes, np.int32)), pa.array(np.full(rows * found, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])

    return vectors.mapInArrow(project, schema)
