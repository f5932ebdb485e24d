"""Periodic runs of words: heavy/light lag counting.

A run is a stretch of consecutive words with smallest period q (words q apart are identical), at least three
periods and ``LEAST`` words long, that no neighbouring word extends. Its words match those q further on at
``length - q`` places in a row, so a lag can only have a run if it has ``max(LEAST - q, 2 q)`` matches at all.
The matches of each lag are counted exactly: the words that occur often by an FFT autocorrelation of their
places, a transform for each and one back for all; the others by the differences of their places, pair by
pair. Lags are then taken in rising order. The matches that a run already found explains at the multiples of
its period are taken off; only lags with enough left are probed, at places that a run can't step over, and
only those where a probe holds are scanned for islands of matches. (A pair of words lies in runs of two
periods q and q / m at once only if these are one run, so that what is taken off never hides another run.)

Documents are rows of their own: no shuffle, and a long document is one task's work, its cost about
n^1.5 for the counting. Defined cases: a null text has no words; a text of fewer words than ``LEAST`` has no
run; texts are taken whole; a null or repeated id is carried along; an empty table gives no rows; other
columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.llm.common import chunks, texts

LEAST, PERIODS = 24, 3
#: Places of a stretch that are probed, one after another, before a lag is scanned.
PROBES = 16
SCHEMA = "doc_id long, n_words long, starts array<long>, lengths array<long>, periods array<long>, kept string"


def needed(lag: np.ndarray | int):
    """Matches in a row that a run of this period has at least."""
    return np.maximum(LEAST - lag, (PERIODS - 1) * lag)


def quick_size(n: int) -> int:
    """The least 2^a 3^b 5^c from n on, a size of which transforms are quick."""
    best, five = 1 << max(n - 1, 1).bit_length(), 1
    while five < best:
        three = five
        while three < best:
            best = min(best, three << max(-(-n // three) - 1, 0).bit_length())
            three *= 3
        five *= 5
    return best


def lag_counts(codes: np.ndarray, lags: int) -> np.ndarray:
    """For each lag up to ``lags`` the number of places whose word equals that so many words on; 0 at lag 0."""
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    times = np.bincount(codes)
    # A transform costs as much as the pairs of a word of about so many places.
    limit = max(8, int(0.4 * np.sqrt(2 * n * np.log2(n))))
    heavy = np.flatnonzero(times > limit)
    counts = np.zeros(lags + 1, np.int64)
    if len(heavy):
        size = quick_size(n + lags + 1)  # lags don't reach around
        power = np.zeros(size // 2 + 1)
        for word in heavy.tolist():
            spectrum = np.fft.rfft(codes == word, size)
            power += spectrum.real**2 + spectrum.imag**2
        counts += np.rint(np.fft.irfft(power, size)[: lags + 1]).astype(np.int64)
    places = order[(times <= limit)[codes[order]]]
    own = codes[places]
    for step in range(1, limit):
        if step & (step - 1) == 0:  # words with fewer places have no further pairs
            more = times[own] > step
            places, own = places[more], own[more]
        if len(own) <= step:
            break
        gap = (places[step:] - places[:-step])[own[step:] == own[:-step]]
        counts += np.bincount(gap[gap <= lags], minlength=lags + 1)
    counts[0] = 0
    return counts


def islands(codes: np.ndarray, lag: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all stretches of places whose word equals that ``lag`` words on."""
    edges = np.diff(np.concatenate(([0], (codes[lag:] == codes[:-lag]).view(np.int8), [0])))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def may_hold(codes: np.ndarray, lag: int) -> bool:
    """Whether some stretch of places, one of those that a run of this lag must cover, matches at all its probes."""
    width = max(int(needed(lag)) // 2, 1)
    at = np.arange(0, len(codes) - lag - width + 1, width)
    for i in np.unique(np.linspace(0, width - 1, PROBES).astype(np.int64)).tolist():
        at = at[codes[at + i] == codes[at + i + lag]]
        if not len(at):
            return False
    return True


def is_power(block: np.ndarray) -> bool:
    """Whether a block of words is a shorter one, repeated."""
    n = len(block)
    rest, divisor = n, 2
    while rest > 1:
        if divisor * divisor > rest:
            divisor = rest
        if rest % divisor == 0:
            step = n // divisor
            if np.array_equal(block[step:], block[:-step]):
                return True
            while rest % divisor == 0:
                rest //= divisor
        divisor += 1
    return False


def find_runs(codes: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of each run of a sequence of words' numbers, by start, then period."""
    n = len(codes)
    lags = n // PERIODS
    if n < LEAST or not lags:
        return []
    left = lag_counts(codes, lags)
    need = needed(np.arange(lags + 1))
    found = []
    for lag in np.flatnonzero(left >= need).tolist():
        if not lag or left[lag] < need[lag] or not may_hold(codes, lag):
            continue
        begin, end = islands(codes, lag)
        enough = end - begin >= need[lag]
        for a, b in zip(begin[enough].tolist(), end[enough].tolist()):
            if not is_power(codes[a : a + lag]):
                length = b - a + lag
                found.append((a, length, lag))
                multiples = np.arange(2 * lag, min(length, lags + 1), lag)
                left[multiples] -= length - multiples
    return sorted(found, key=lambda run: (run[0], run[2]))


def periodic_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: Callable[[int | None, int], np.ndarray | None] | None = None
) -> DataFrame:
    """``doc_id``, ``n_words``, its runs as ``starts``, ``lengths`` and ``periods``, and ``kept``, of each document.

    ``kept`` are the words that no run contains after its first period, joined by single spaces. ``order`` gives,
    for an id and a number of words, the words to take in place of the text's own (None: as they are).
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole):
                out: list[list] = [[], [], [], [], []]
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                    words = text.encode().split()  # at blanks and the controls 9 to 13
                    taken = order(doc, len(words)) if order and words else None
                    if taken is not None:
                        words = [words[i] for i in taken.tolist()]
                    runs = []
                    if len(words) >= LEAST:
                        numbers: dict[bytes, int] = {}
                        runs = find_runs(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int32, len(words)))
                    gone = np.zeros(len(words), bool)
                    for start, length, period in runs:
                        gone[start + period : start + length] = True
                    kept = [words[i] for i in np.flatnonzero(~gone).tolist()] if runs else words
                    columns = [list(c) for c in zip(*runs)] or [[], [], []]
                    for column, value in zip(out, [len(words), *columns, b" ".join(kept).decode()]):
                        column.append(value)
                lists = [pa.array(c, pa.list_(pa.int64())) for c in out[1:4]]
                arrays = [batch.column("doc_id"), pa.array(out[0], pa.int64()), *lists, pa.array(out[4], pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in SCHEMA.split(", ")])

    return texts(docs, id_col, text_col).mapInArrow(find, SCHEMA)


def rotated(doc_id: int | None, n: int) -> np.ndarray | None:
    """The order of words that the query asks for: every tenth document, by the checksum of its id, repeats a stretch to its end."""
    if doc_id is None:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate((np.arange(a), a + np.arange(n - a) % p))


def summaries(found: DataFrame) -> DataFrame:
    """Numbers and digests of the runs: the one with the greatest length by period, all as lines, and the words that stay."""
    runs = F.arrays_zip("starts", "lengths", "periods")
    lines = F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["starts"], r["lengths"], r["periods"]), F.lit("\n")))
    # Exact: lengths by periods are compared by cross products of whole numbers.
    better = lambda a, b: (a["lengths"] * b["periods"] > b["lengths"] * a["periods"]) | (
        (a["lengths"] * b["periods"] == b["lengths"] * a["periods"]) & (F.struct(a["starts"], a["periods"]) < F.struct(b["starts"], b["periods"]))
    )
    best = F.reduce(runs, F.get(runs, F.lit(0)), lambda a, b: F.when(better(b, a), b).otherwise(a)).alias("best")
    return found.select(
        "doc_id", F.size("starts").cast("long").alias("n_runs"), best, F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("kept", 256).alias("collapsed_sha256")
    ).select(
        "doc_id", "n_runs", F.col("best.starts").alias("start"), F.col("best.lengths").alias("length"), F.col("best.periods").alias("period"),
        F.expr("best.lengths * 1000 div best.periods").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
