"""Windows that recur: what the two substring deduplications share.

A window is a fixed number of consecutive units (bytes or words) of one document. Each window is
represented by its anchor, the gram with the least hash in it, so that equal windows have equal anchors at
equal places. Documents that are whole copies are set aside. One pass over the others emits the anchors
(a row for each chunk of documents that holds one), a grouped count tells those that occur twice or more,
and each document gets the list of its own.

Anchors say where to look; they decide nothing. The windows around them are compared, first within a chunk
of documents, then in the tasks to which they are routed by anchor. Windows of an anchor with more than
``HOT`` occurrences are routed one by one, by their own hash, and in two rounds: first each of ``SALTS``
parts of the documents finds its earliest copy of the window, then these meet. So neither a phrase nor a
single window that a third of all documents hold gathers in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.llm import exact_dedup
from docsieve.llm.common import chunks, cut, flat
from docsieve.llm.hashing import SPACE_WORDS, anchor_runs, byte_values, mix, range_hashes, signed, word_spans

HOT = 20_000
SALTS = 256
ALL = -1
PIECES = "route long, home long, key long, start long, count int, off int, bytes binary"
_PIECES = pa.schema(
    [("route", pa.int64()), ("home", pa.int64()), ("key", pa.int64()), ("start", pa.int64())]
    + [("count", pa.int32()), ("off", pa.int32()), ("bytes", pa.binary())]
)


@dataclass(frozen=True)
class Unit:
    """What windows are made of: their length and their anchors' in units, and whether these are words.

    ``chunk`` bounds the bytes of text that are taken at once, but for a longer text, which is a chunk alone.
    """

    window: int
    gram: int
    words: bool
    chunk: int


class Sequence:
    """The units of all texts of a chunk, with the runs of windows that share an anchor.

    ``locate`` gives, for the sequence, a number for each unit at which an anchor may stand, and 0 for others
    (``kinds``); without it, every gram may be one.
    """

    def __init__(self, batch: pa.RecordBatch, unit: Unit, locate: Callable[[Sequence], np.ndarray] | None = None):
        self.raw, self.offsets = flat(batch.column("text"))
        if unit.words:
            self.starts, self.ends, self.bounds = word_spans(self.raw, self.offsets, SPACE_WORDS)
            hashes = range_hashes(lambda a, b: byte_values(self.raw[a:b]), self.starts, self.ends)
            self.values = lambda a, b: hashes[a:b]
        else:
            self.bounds = self.offsets
            self.values = lambda a, b: byte_values(self.raw[a:b])
        self.kinds = locate(self) if locate else None
        self.first, self.count, self.place, self.anchor = anchor_runs(self.values, unit.gram, self.bounds, unit.window, self.kinds)
        self.doc = np.searchsorted(self.bounds, self.first, "right") - 1

    def windows(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Run and start of each window of the chosen runs, in the order of the chunk."""
        counts = self.count[chosen]
        run = np.repeat(chosen, counts)
        inner = np.arange(len(run)) - np.repeat(np.cumsum(counts) - counts, counts)
        return run, self.first[run] + inner


def whole_copies(docs: DataFrame) -> DataFrame:
    """``key`` of each document whose whole text stands earlier; each of its windows does, then."""
    slim = exact_dedup.numbered(docs.select(F.col("key").alias("doc_id"), F.unhex(F.sha2("text", 256)).alias("digest")))
    found = exact_dedup.resolve(slim, cut(exact_dedup.frequent(slim)))
    return cut(found.where(~F.col("kept")).select(F.col("doc_id").alias("key")))


def without(docs: DataFrame, copies: DataFrame) -> DataFrame:
    """The documents that aren't copies. (An anti-join would go below the projection, to a shuffle of its own.)"""
    marked = docs.join(copies.withColumn("copied", F.lit(True)), "key", "left")
    return marked.where("copied IS NULL").select(docs.columns)


def grouped_keys(values: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Where each distinct value stands first, that row's key, and the keys of the other rows (null if there are none)."""
    order = np.argsort(values, kind="stable")
    ordered, keys = values[order], keys[order]
    new = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(order) else np.zeros(0, np.int64)
    size = np.diff(np.append(new, len(ordered)))
    rest = np.ones(len(ordered), bool)
    rest[new] = False
    offsets = pa.array(np.append(0, np.cumsum(size - 1)).astype(np.int32), mask=np.append(size == 1, False))
    return order[new], keys[new], pa.ListArray.from_arrays(offsets, pa.array(keys[rest], pa.int64()))


def recurring(rows: DataFrame, *by: str) -> DataFrame:
    """``by``, ``times`` and ``key`` of each document with a value of ``by`` that occurs twice or more.

    ``rows`` have ``by``, ``key`` and ``more``, the keys of further occurrences in the same chunk. They are
    dealt out once; the count reads the same shuffle, a row for each value, and is joined to it in order, so
    that no group is held in memory.
    """
    dealt = rows.repartition(*by)
    count = F.sum(F.lit(1) + F.size(F.coalesce("more", F.array().cast("array<long>"))))
    # The count reads ``key`` too; without it, it would get a shuffle of its own.
    times = dealt.groupBy(*by).agg(count.alias("times"), F.max("key").alias("some")).where("times > 1 AND some IS NOT NULL")
    keys = F.explode(F.concat(F.array("key"), F.coalesce("more", F.array().cast("array<long>"))))
    return dealt.join(times, list(by)).select(*by, "times", keys.alias("key"))


def recurring_anchors(docs: DataFrame, unit: Unit) -> DataFrame:
    """``key`` of each document with anchors that occur twice or more, and these: ``cold`` and ``hot``."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, limit=unit.chunk):
                found = Sequence(batch, unit)
                if len(found.anchor):
                    at, keys, more = grouped_keys(found.anchor, batch.column("key").to_numpy()[found.doc])
                    yield pa.RecordBatch.from_arrays([pa.array(signed(found.anchor[at])), pa.array(keys), more], ["anchor", "key", "more"])

    rows = recurring(docs.mapInArrow(emit, "anchor long, key long, more array<long>"), "anchor")
    return rows.groupBy("key").agg(
        F.collect_set(F.when(F.col("times") <= HOT, F.col("anchor"))).alias("cold"),
        F.collect_set(F.when(F.col("times") > HOT, F.col("anchor"))).alias("hot"),
    )


def known(batch: pa.RecordBatch, column: str, anchors: np.ndarray) -> np.ndarray:
    """Which of the anchors are in the lists of a column of this chunk."""
    listed = batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    return np.isin(anchors, listed)


def cut_pieces(
    found: Sequence, chosen: np.ndarray, hot: np.ndarray, keys: np.ndarray, unit: Unit,
    again_in_chunk: Callable[[np.ndarray, np.ndarray], np.ndarray], text_of: Callable[[np.ndarray, np.ndarray], list[bytes]],
) -> pa.RecordBatch:
    """The windows of the chosen runs, cut into pieces that go elsewhere and such that are settled here (``off`` -1).

    ``hot`` says of each run whether its windows are routed one by one; ``keys`` has each text's key.
    ``again_in_chunk`` gets runs and starts of windows in order of occurrence and says which stand earlier;
    ``text_of`` gives the bytes from one unit to another.
    """
    run, start = found.windows(chosen)
    order = np.lexsort((start, keys[found.doc[run]]))
    again = np.zeros(len(run), bool)
    again[order] = again_in_chunk(run[order], start[order])
    alone = hot[run] & ~again
    breaks = np.ones(len(run), bool)
    breaks[1:] = (run[1:] != run[:-1]) | (again[1:] != again[:-1]) | alone[1:] | alone[:-1]
    at = np.flatnonzero(breaks)
    count = np.diff(np.append(at, len(run)))
    run, start, again, alone = run[at], start[at], again[at], alone[at]
    key = keys[found.doc[run]]
    home = found.anchor[run].copy()
    home[alone] ^= range_hashes(found.values, start[alone], start[alone] + unit.window)
    route = np.where(alone, mix(home ^ mix((key % SALTS).astype(np.uint64) + np.uint64(1))), home)
    route = np.where(again, mix(home + start.astype(np.uint64)), route)  # only passing through
    off = np.where(again, -1, np.maximum(found.place[run] - start, 0))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(signed(route)),
            pa.array(signed(np.where(alone, home, route))),
            pa.array(key),
            pa.array(start - found.bounds[found.doc[run]]),
            pa.array(count, pa.int32()),
            pa.array(off, pa.int32()),
            pa.array(text_of(start, np.where(again, start, start + count - 1 + unit.window)), pa.binary()),
        ],
        schema=_PIECES,
    )


def blocks(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= least:
            yield pa.Table.from_batches(held)
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held)


def settle(pieces: DataFrame, find: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]], block: int = 1 << 13) -> DataFrame:
    """Runs ``key``, ``start``, ``count`` of windows that also start earlier, in two rounds of comparing pieces."""
    for last in (False, True):
        ranged = pieces.repartition("route").sortWithinPartitions("route", "key", "start")
        pieces = ranged.mapInArrow(_round(find, block, last), PIECES)
    return pieces.select("key", "start", F.col("count").cast("long").alias("count"))


def _round(find: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]], block: int, last: bool):
    """Pieces meet by route, ordered by document and start.

    ``find`` gets a block of them and returns, for the windows that stand earlier in the block, piece and
    number in the piece, in order. Of a route that goes on in the next block, the pieces with a window's
    first occurrence are carried along. What is settled passes on; so do, but for the last round, the pieces
    that have still to meet others at home.
    """

    def runs(rows: pa.Table, piece: np.ndarray, inner: np.ndarray) -> pa.RecordBatch:
        key, start = (np.asarray(rows.column(c)).astype(np.int64) for c in ("key", "start"))
        new = np.ones(len(piece), bool)
        new[1:] = (piece[1:] != piece[:-1]) | (inner[1:] != inner[:-1] + 1)
        at = np.flatnonzero(new)
        key, start, count = key[piece[at]], start[piece[at]] + inner[at], np.diff(np.append(at, len(piece)))
        route = signed(mix(key.view(np.uint64) + start.view(np.uint64)))
        off = np.full(len(at), -1)
        empty = pa.array([b""] * len(at), pa.binary())
        return pa.RecordBatch.from_arrays([*(pa.array(x, f.type) for x, f in zip((route, route, key, start, count, off), _PIECES)), empty], schema=_PIECES)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried: pa.Table | None = None
        for rows in blocks(batches, block):
            settled = np.asarray(rows.column("off")) < 0
            yield from rows.filter(pa.array(settled)).cast(_PIECES).to_batches()
            rows = rows.filter(pa.array(~settled))
            if not rows.num_rows:
                continue
            old = 0
            if carried is not None:
                carried = carried.filter(pa.array(np.asarray(carried.column("route")) == rows.column("route")[0].as_py()))
                old = carried.num_rows
                rows = pa.concat_tables([carried, rows])
            rows = rows.combine_chunks()
            piece, inner = find(rows)
            yield runs(rows, piece[piece >= old], inner[piece >= old])
            route, home = (np.asarray(rows.column(c)) for c in ("route", "home"))
            lost = np.bincount(piece, minlength=len(route)) >= np.asarray(rows.column("count"))
            onward = ~lost & (route != home)
            onward[:old] = False
            if not last and onward.any():
                here = rows.filter(pa.array(onward))
                yield from here.set_column(0, "route", here.column("home")).cast(_PIECES).to_batches()
            carried = rows.filter(pa.array((route == route[-1]) & ~lost))

    return stream


def per_document(docs: DataFrame, again: DataFrame, copies: DataFrame) -> DataFrame:
    """Each document with ``starts`` and ``counts`` of its windows that stand earlier, null where there are none.

    A count of ``ALL`` stands for all windows of a copy.
    """
    copied = copies.select("key", F.lit(0).cast("long").alias("start"), F.lit(ALL).cast("long").alias("count"))
    runs = again.unionByName(copied).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "count"))).alias("runs"))
    return docs.join(runs, "key", "left").select(
        "doc_id", "text", F.col("runs.start").alias("starts"), F.col("runs.count").alias("counts")
    )


def covered(n: int, starts: list[int], counts: list[int], window: int) -> np.ndarray:
    """Which of n units a window of the runs covers."""
    if counts[0] == ALL:
        return np.full(n, n >= window)
    edges = np.zeros(n + 1, np.int32)
    a = np.asarray(starts, np.int64)
    np.add.at(edges, a, 1)
    np.add.at(edges, a + np.asarray(counts, np.int64) - 1 + window, -1)
    return np.cumsum(edges[:-1]) > 0
