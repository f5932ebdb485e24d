"""Line deduplication with keep bitmaps.

A line's key is the line with the blanks stripped at both ends and A-Z lower-cased. Each line goes, as two
hashes (128 bits), the document's key and its place, to a range of (hash, document, place), ordered so within
it; texts don't travel. A range holds whole lines in order, so that a hash's lines are streamed one after
another: its first line is the first occurrence, and its documents are counted where they change. As
documents and places are part of the range, a line that a third of all documents hold is spread over many
tasks. What a range can't settle alone, the hashes at its two borders, is settled from a row for each of
them, which says how many documents of the hash it holds, and the first and the last. The decisions come
back as one compressed bitmap for each document: bit i is set if line i stays.

Defined cases: a null text is an empty one, and an empty text has one empty line. Lines whose key is shorter
than ``least`` code points always stay; so, with the default of 1, do blank ones. The last line of a text
that ends in a line break is an empty one. A row with a null or repeated id is a document of its own, in the
order of id (nulls last) and text. An empty table gives no rows. Texts are split whole, however long; one
must fit a Python worker. Other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsieve.llm.common import batch_of, chunks, cut, keyed

DOCUMENTS = 10
LEAST = 1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\x0c\r"
#: What the streams say of a line: it goes, or the whole of its hash has still to be counted.
GOES, OPEN, BORDER = 0, 1, 2
_SETTLED = pa.schema(
    [("kind", pa.int8()), ("part", pa.int32()), ("high", pa.int64()), ("low", pa.int64()), ("key", pa.int64()), ("pos", pa.int32())]
    + [("last", pa.int64()), ("documents", pa.int64())]
)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def hashed_lines(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``high``, ``low``, ``key`` and ``pos`` of each line whose key has ``least`` code points or more."""
    lines = docs.select("key", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keys = lines.select("key", "pos", line_key(F.col("line")).alias("line")).where(F.length("line") >= least)
    # The seed of the second hash is the first constant's own, so that the two have nothing in common.
    return keys.select(F.xxhash64("line").alias("high"), F.xxhash64(F.lit("line"), F.col("line")).alias("low"), "key", "pos")


@dataclass
class Run:
    """The lines of one hash in a range that were sent on already: ``documents`` of them, the first and the last one."""

    kind: int
    hash: tuple[int, int]
    first: int
    last: int
    documents: int


class Range:
    """Streams the ordered lines of one range; holds the state of the last hash alone."""

    def __init__(self, part: int, documents: int, keep_first: bool):
        self.part, self.documents, self.keep_first = part, documents, keep_first
        self.run: Run | None = None
        self.held: pa.Table | None = None
        self.begun = False

    def rows(self, kind: int, high, low, key, pos, first) -> pa.RecordBatch:
        """Lines; ``last`` is 1 for the range's first line of its hash, and ``documents`` isn't used."""
        n = len(key)
        columns = (np.full(n, kind), np.full(n, self.part), high, low, key, pos, first.astype(np.int64), np.zeros(n, np.int64))
        return batch_of(_SETTLED, *columns)

    def border(self, run: Run) -> pa.RecordBatch:
        return batch_of(_SETTLED, [BORDER], [self.part], [run.hash[0]], [run.hash[1]], [run.first], [-1], [run.last], [run.documents])

    def block(self, table: pa.Table) -> Iterator[pa.RecordBatch]:
        if self.held is not None:
            table, self.held = pa.concat_tables([self.held, table]), None
        high, low, key, pos = (table.column(c).to_numpy() for c in ("high", "low", "key", "pos"))
        new = np.ones(len(key), bool)
        new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        fresh = new.copy()
        fresh[1:] |= key[1:] != key[:-1]
        at = np.flatnonzero(new)
        end = np.append(at[1:], len(key))
        count = np.add.reduceat(fresh.astype(np.int64), at)
        names = [(int(high[i]), int(low[i])) for i in (at[0], at[-1])]
        goes = np.zeros(len(key), bool)
        start = 0  # the first run that isn't settled
        if self.run and self.run.hash == names[0]:
            run = self.run
            run.documents += int(count[0]) - (int(key[0]) == run.last)
            run.last = int(key[end[0] - 1])
            part = slice(0, end[0])
            yield self.rows(run.kind, high[part], low[part], key[part], pos[part], np.zeros(end[0], bool))
            start = 1
        elif not self.begun:  # the range's first hash may have begun before it
            self.run = Run(OPEN, names[0], int(key[0]), int(key[end[0] - 1]), int(count[0]))
            part = slice(0, end[0])
            yield self.rows(OPEN, high[part], low[part], key[part], pos[part], new[part])
            start = 1
        self.begun = True
        if start == len(at):
            return
        if self.run:
            if self.run.kind == OPEN:
                yield self.border(self.run)
            self.run = None
        many = count >= self.documents
        many[:start] = False
        goes = np.repeat(many, end - at)
        if self.keep_first:
            goes &= ~new
        yield self.rows(GOES, high[goes], low[goes], key[goes], pos[goes], new[goes])
        last = slice(int(at[-1]), len(key))
        if many[-1]:  # further lines of it go, too, wherever they stand
            self.run = Run(GOES, names[1], int(key[last.start]), int(key[-1]), int(count[-1]))
        else:
            self.held = table.slice(last.start)

    def end(self) -> Iterator[pa.RecordBatch]:
        """The last hash may go on in the next range."""
        if self.held is not None:
            high, low, key, pos = (self.held.column(c).to_numpy() for c in ("high", "low", "key", "pos"))
            yield self.rows(OPEN, high, low, key, pos, np.arange(len(key)) == 0)
            self.run = Run(OPEN, (int(high[0]), int(low[0])), int(key[0]), int(key[-1]), len(np.unique(key)))
        if self.run:
            yield self.border(self.run)


def settle_ranges(lines: DataFrame, documents: int, keep_first: bool) -> DataFrame:
    """The lines that go (``GOES``), those that hang on their hash's other ranges (``OPEN``), and what these must know (``BORDER``).

    A border's row has its range's number as ``part``, the first and last document of its hash there as ``key``
    and ``last``, and how many these are: at most two rows for each range.
    """

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Range(TaskContext.get().partitionId(), documents, keep_first)
        for batch in batches:
            if batch.num_rows:
                yield from own.block(pa.Table.from_batches([batch]))
        yield from own.end()

    order = ["high", "low", "key", "pos"]
    ranged = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    return ranged.mapInArrow(stream, "kind byte, part int, high long, low long, key long, pos int, last long, documents long")


def dropped_lines(docs: DataFrame, documents: int = DOCUMENTS, least: int = LEAST, keep_first: bool = False) -> DataFrame:
    """``key`` and ``pos`` of each line that goes."""
    settled = cut(settle_ranges(hashed_lines(docs, least), documents, keep_first))
    # A document whose lines of a hash lie in two ranges was counted in both.
    before = F.lag("last").over(Window.partitionBy("high", "low").orderBy("part"))
    borders = settled.where(F.col("kind") == BORDER).withColumn("again", F.coalesce((before == F.col("key")).cast("long"), F.lit(0)))
    totals = borders.groupBy("high", "low").agg((F.sum("documents") - F.sum("again")).alias("total"), F.min("part").alias("least"))
    # Two rows for each range at most, however many lines there are.
    open_lines = settled.where(F.col("kind") == OPEN).drop("documents").join(F.broadcast(totals), ["high", "low"])
    goes = F.col("total") >= documents
    if keep_first:
        goes &= (F.col("part") != F.col("least")) | (F.col("last") == 0)
    return settled.where(F.col("kind") == GOES).select("key", "pos").unionByName(open_lines.where(goes).select("key", "pos"))


def packed(n: int, dropped: np.ndarray) -> bytes:
    """The compressed bitmap of n lines: bit i (the lowest first) is set if line i stays."""
    keep = np.ones(n, bool)
    keep[dropped] = False
    return zlib.compress(np.packbits(keep, bitorder="little").tobytes())


def unpacked(keep: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=n, bitorder="little").astype(bool)


def bitmaps(rows: DataFrame, documents: int = DOCUMENTS, least: int = LEAST, keep_first: bool = False) -> DataFrame:
    """``keep_bitmaps`` of rows with ``key``, ``doc_id`` and ``text``, with the ``key``."""
    dropped = dropped_lines(rows, documents, least, keep_first).groupBy("key").agg(F.collect_list("pos").alias("dropped"))
    breaks = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    slim = rows.select("key", "doc_id", (breaks + 1).cast("long").alias("n_lines"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("dropped")
            sizes = lists.value_lengths().fill_null(0)
            values, ends = lists.flatten().to_numpy(), np.cumsum(sizes.to_numpy())
            parts = zip(batch.column("n_lines").to_pylist(), ends.tolist(), sizes.to_pylist())
            keep = [packed(n, values[end - size : end]) for n, end, size in parts]
            columns = [batch.column("key"), batch.column("doc_id"), batch.column("n_lines"), sizes.cast(pa.int64()), pa.array(keep, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "doc_id", "n_lines", "n_dropped", "keep"])

    return slim.join(dropped, "key", "left").mapInArrow(pack, "key long, doc_id long, n_lines long, n_dropped long, keep binary")


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **rule) -> DataFrame:
    """``doc_id``, ``n_lines``, ``n_dropped`` and ``keep`` (see ``unpacked``) of each document.

    ``documents``: a line goes if this many documents hold it; ``least``: code points of a key that counts;
    ``keep_first``: its first occurrence, by document and place, stays.
    """
    return bitmaps(keyed(docs, id_col, text_col), **rule).drop("key")


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **rule) -> DataFrame:
    """``doc_id``, ``n_lines``, ``n_dropped`` and ``kept``, the lines that stay joined by line breaks, of each document."""
    rows = keyed(docs, id_col, text_col)
    maps = bitmaps(rows, **rule).drop("doc_id")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole):
                kept = batch.column("text").to_pylist()
                for i, (n, gone, keep) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("n_lines", "n_dropped", "keep")))):
                    if gone:
                        lines, stays = kept[i].split("\n"), unpacked(keep, n)
                        kept[i] = "\n".join(lines[j] for j in np.flatnonzero(stays).tolist())
                columns = [batch.column(c) for c in ("doc_id", "n_lines", "n_dropped")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(kept, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept"])

    return rows.join(maps, "key").mapInArrow(apply, "doc_id long, n_lines long, n_dropped long, kept string")
