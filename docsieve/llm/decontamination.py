"""Benchmark decontamination: a BM25 index of the test items, searched by block-max WAND.

Every training passage is a query. The passages that an item is held against are windows of twice its number
of words, rounded up to a power of two (``MIN_WORDS`` at least), each half overlapping the next, so that no
item can fall between two; items with equal windows share an index. BM25 impacts are divided
by the item's score against itself; a passage retrieves every item with a share of ``THRESHOLD`` or more.

The index keeps, for each term, its items in order with impacts, in blocks with their largest impact. For
a chunk of documents, sums of block maxima bound the score of each passage in each block at once; blocks
below the threshold are skipped, and passages with a live block are searched document-at-a-time, with
pivots by the terms' maxima and deep skips by the block maxima. A retrieved item is a leak if the passage
holds at least ``OVERLAP`` of its question and of its answer (the last sentence that has words): of their
five-word shingles, or of their words, less one for each edit (a word replaced, left out or put in) at the
best place. As one edit can be more than that of a short part, an item is a leak too if the whole of it
stands there with one word replaced, left out or put in, if that is no more than 1 - ``OVERLAP`` of its
words; a part's only word may be replaced, not left out. So a question before another answer of one word
counts, and a question alone doesn't. Items that one such edit can bring below ``THRESHOLD`` lower the bound
of their index, and count below ``THRESHOLD`` only if the whole of them stands there so.

Indexes are broadcast in parts of about ``MOST_ITEMS`` items, by a hash of their ids, ``AT_ONCE`` parts for each pass
over the documents; statistics are those of all items, and the result doesn't depend on the parts. Defined cases: null or empty texts and items have no terms and never match; items with a null
id are kept under that id; items with equal texts are all reported; a row with a repeated id is searched
on its own, and the best match of each (id, item) is reported; of passages that match alike the first counts;
texts are searched whole, however long; other columns, whatever their names, are not read by the search and are
kept as they are by the filter; an empty table on either side gives no rows.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.llm.common import chunks, cut, flat, texts
from docsieve.llm.hashing import LOWER, Rolling, byte_values, signed, word_spans

K1, B = 1.2, 0.75
THRESHOLD = 0.5
OVERLAP = 0.8
SHINGLE = 5
MIN_WORDS = 64
MOST_ITEMS = 10_000
AT_ONCE = 8
BLOCKS = 512
COMMON = 0.1
_LETTER = re.compile(r"[0-9A-Za-z\u0080-\U0010ffff]")
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
TYPES = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, first_word long"


def hashed_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and where each text's begin."""
    raw, offsets = flat(column)
    low = LOWER[raw]
    starts, ends, first = word_spans(low, offsets, _WORD)
    return Rolling(byte_values(low)).ranges(starts, ends), first


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    return np.unique(Rolling(words).grams(min(k, len(words)))) if len(words) else np.zeros(0, np.uint64)


def question_and_answer(text: str) -> tuple[str, str]:
    """The item before its last sentence with words, and that; the whole for both if there is one such sentence."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+", text.strip()) if _LETTER.search(p)]
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text, text)


@dataclass
class Index:
    """Postings of a bounded number of items, all impacts relative to the item's own score."""

    items: list[int | None]
    terms: np.ndarray  # sorted hashes
    begin: np.ndarray  # of each term's postings
    doc: np.ndarray  # items by number, ascending in each term
    impact: np.ndarray
    width: int  # of a block, in items
    block_begin: np.ndarray  # of each term's blocks
    block: np.ndarray
    block_max: np.ndarray
    term_max: np.ndarray
    common: np.ndarray  # of each term: in many items; bounded once for each block, not searched for
    common_max: np.ndarray  # of each block: the common terms' maxima together
    words: int  # of half a passage
    question: list[tuple[int, np.ndarray]]  # words in a shingle (fewer than five if there are fewer), and the shingles
    answer: list[tuple[int, np.ndarray]]
    ordered: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # words of question, answer and the whole
    least: list[float]  # of each item, the least score with one word replaced


def build(items: list[tuple[int | None, str]], df: dict[int, int], n_items: int, mean_length: float, half: int) -> Index:
    """The index of the given items, of ``half`` words at most; ``df`` has each term's number of items among all ``n_items``."""
    words, first = hashed_words(pa.array([t for _, t in items], pa.string()))
    triples, least = [], []
    for i in range(len(items)):
        own = words[first[i] : first[i + 1]]
        terms, tf = np.unique(own, return_counts=True)
        counts = np.array([df.get(int(t), 1) for t in signed(terms)], float)
        idf = np.log1p((n_items - counts + 0.5) / (counts + 0.5))
        impact = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(own) / max(mean_length, 1)))
        impact /= max(impact.sum(), 1e-12)
        least.append(1 - float(impact[tf == 1].max(initial=0.0)))
        triples += [(t, i, w) for t, w in zip(terms.tolist(), impact.tolist())]
    triples.sort()
    term = np.array([t for t, _, _ in triples], np.uint64)
    doc = np.array([d for _, d, _ in triples], np.int64)
    impact = np.array([w for _, _, w in triples], float)
    terms, begin = np.unique(term, return_index=True)
    begin = np.append(begin, len(term)).astype(np.int64)
    owner = np.repeat(np.arange(len(terms)), np.diff(begin))
    width = max(1, -(-len(items) // BLOCKS))
    blocks = -(-len(items) // width)
    cell, cell_begin = np.unique(owner * blocks + doc // width, return_index=True)
    block_max = np.maximum.reduceat(impact, cell_begin) if len(cell) else np.zeros(0)
    block_begin = np.searchsorted(cell // max(blocks, 1), np.arange(len(terms) + 1))
    common = np.diff(begin) > COMMON * len(items) + 1
    often = common[cell // max(blocks, 1)] if len(cell) else np.zeros(0, bool)
    parts = [question_and_answer(t) for _, t in items]
    return Index(
        [i for i, _ in items], terms, begin, doc, impact, width, block_begin, cell % max(blocks, 1), block_max,
        np.maximum.reduceat(impact, begin[:-1]) if len(terms) else np.zeros(0), common,
        np.bincount((cell % max(blocks, 1))[often], block_max[often], blocks) if blocks else np.zeros(0),
        half, [_shingles_of(q) for q, _ in parts], [_shingles_of(a) for _, a in parts],
        [tuple(hashed_words(pa.array([t], pa.string()))[0] for t in (*p, text)) for p, (_, text) in zip(parts, items)], least,
    )


def _shingles_of(text: str) -> tuple[int, np.ndarray]:
    words = hashed_words(pa.array([text], pa.string()))[0]
    return min(SHINGLE, len(words)), shingles(words, SHINGLE)


def edits_in(part: np.ndarray, text: np.ndarray) -> int:
    """The least number of words replaced, left out or put in between ``part`` and any stretch of ``text``."""
    at = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for word in part:
        below = row + 1
        below[1:] = np.minimum(below[1:], row[:-1] + (text != word))
        row = np.minimum.accumulate(below - at) + at
    return int(row.min())


def one_edit(question: np.ndarray, answer: np.ndarray, whole: np.ndarray, text: np.ndarray) -> bool:
    """Whether the whole item stands in the text with one edit at most that leaves no part without a word."""
    n = len(whole)
    if n <= len(text) and (np.lib.stride_tricks.sliding_window_view(text, n) != whole).sum(axis=1).min() <= 1:
        return True
    # A word put in between never empties a part; one left out does if it is the only one.
    if min(len(question), len(answer)) > 1:
        return edits_in(whole, text) <= 1
    stretches = np.lib.stride_tricks.sliding_window_view(text, n + 1) if n < len(text) else np.zeros((0, n + 1), text.dtype)
    before = np.cumprod(stretches[:, :-1] == whole, axis=1).sum(axis=1)
    behind = np.cumprod((stretches[:, 1:] == whole)[:, ::-1], axis=1).sum(axis=1)
    return bool((before + behind >= n).any())


class Cursor:
    """A term's postings, walked in the order of items."""

    __slots__ = ("at", "block_at", "block_end", "end", "index", "top")

    def __init__(self, index: Index, term: int):
        self.index, self.top = index, float(index.term_max[term])
        self.at, self.end = int(index.begin[term]), int(index.begin[term + 1])
        self.block_at, self.block_end = int(index.block_begin[term]), int(index.block_begin[term + 1])

    def seek(self, item: int) -> None:
        self.at += int(np.searchsorted(self.index.doc[self.at : self.end], item))

    def block_bound(self, item: int) -> float:
        """The largest impact in the block of ``item``, 0 if the term isn't in it."""
        block = item // self.index.width
        while self.block_at < self.block_end and self.index.block[self.block_at] < block:
            self.block_at += 1
        here = self.block_at < self.block_end and self.index.block[self.block_at] == block
        return float(self.index.block_max[self.block_at]) if here else 0.0


def block_max_wand(index: Index, terms: list[int], threshold: float) -> list[tuple[int, float]]:
    """All items (by number) whose score is at the threshold or above, with their scores."""
    doc, impact, found = index.doc, index.impact, []
    slack = 1e-9  # sums in another order may differ so much
    cursors = [Cursor(index, t) for t in terms]
    while True:
        cursors = sorted((c for c in cursors if c.at < c.end), key=lambda c: doc[c.at])
        bound, pivot = 0.0, -1
        for i, c in enumerate(cursors):
            bound += c.top
            if bound >= threshold - slack:
                pivot = i
                break
        if pivot < 0:
            return found
        item = int(doc[cursors[pivot].at])
        while pivot + 1 < len(cursors) and doc[cursors[pivot + 1].at] == item:
            pivot += 1
        if sum(c.block_bound(item) for c in cursors[: pivot + 1]) < threshold - slack:
            # No item of this block before the next cursor's can reach the threshold.
            step = (item // index.width + 1) * index.width
            if pivot + 1 < len(cursors):
                step = min(step, int(doc[cursors[pivot + 1].at]))
            for c in cursors[: pivot + 1]:
                c.seek(step)
        elif doc[cursors[0].at] == item:
            score = 0.0
            for c in cursors[: pivot + 1]:
                score += float(impact[c.at])
                c.at += 1
            if score >= threshold - slack:
                found.append((item, score))
        else:
            for c in cursors[:pivot]:
                if doc[c.at] < item:
                    c.seek(item)


def leaks(batch: pa.RecordBatch, index: Index, threshold: float, overlap: float, column: str = "text") -> list[tuple]:
    """Row, item, score, question and answer overlap and first word of the best verified match of each row and item."""
    words, first = hashed_words(batch.column(column))
    if not len(index.terms) or not len(words):
        return []
    term = np.minimum(np.searchsorted(index.terms, words), len(index.terms) - 1)
    known = index.terms[term] == words
    # Halves of passages, numbered over all texts of the chunk.
    count = np.diff(first)
    halves = -(-count // index.words)
    half_begin = np.append(0, np.cumsum(halves))
    at = np.flatnonzero(known & ~index.common[term])
    text = np.searchsorted(first, at, "right") - 1
    half = half_begin[text] + (at - first[text]) // index.words
    once = np.unique(half * len(index.terms) + term[at])  # a term counts once in a half
    half, own = once // len(index.terms), once % len(index.terms)
    size = (index.block_begin[1:] - index.block_begin[:-1])[own]
    cell = np.repeat(index.block_begin[own], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    blocks = len(index.common_max)
    bound = np.bincount(np.repeat(half, size) * blocks + index.block[cell], index.block_max[cell], int(half_begin[-1]) * blocks)
    bound = bound.reshape(-1, blocks)
    last = np.zeros(len(bound), bool)
    last[half_begin[1:][halves > 0] - 1] = True
    both = bound.copy()
    both[:-1][~last[:-1]] += bound[1:][~last[:-1]]
    best: dict[tuple[int, int], tuple] = {}
    edited = [len(own[2]) * (1 - overlap) >= 1 - 1e-9 for own in index.ordered]  # one edit is little enough
    reach = min([threshold, *(least for least, e in zip(index.least, edited) if e)])
    for p in np.flatnonzero((both + index.common_max >= reach - 1e-9).any(axis=1)).tolist():
        row = int(np.searchsorted(half_begin, p, "right")) - 1
        a = int(first[row]) + (p - int(half_begin[row])) * index.words
        b = min(a + 2 * index.words, int(first[row + 1]))
        terms = np.unique(term[a:b][known[a:b]]).tolist()
        hits = block_max_wand(index, terms, reach)
        if not hits:
            continue
        text_shingles: dict[int, np.ndarray] = {}

        def held(k: int, part: np.ndarray) -> float:
            if k not in text_shingles:
                text_shingles[k] = shingles(words[a:b], k) if b - a >= k else np.zeros(0, np.uint64)
            return float(np.isin(part, text_shingles[k]).mean()) if len(part) else 0.0

        def in_order(share: float, part: np.ndarray) -> float:
            """The larger of the share of shingles and that of words without edits, this where it may be enough."""
            if share >= overlap or not len(part) or np.isin(part, words[a:b]).mean() < overlap:
                return share
            return max(share, 1 - edits_in(part, words[a:b]) / len(part))

        for item, score in hits:
            if score <= best.get((row, item), (-1.0,))[0]:
                continue
            question, answer, whole = index.ordered[item]
            q = in_order(held(*index.question[item]), question)
            r = in_order(held(*index.answer[item]), answer)
            leak = score >= threshold - 1e-9 and min(q, r) >= overlap
            if not leak and edited[item] and np.isin(whole, words[a:b], invert=True).sum() <= 1:
                leak = one_edit(question, answer, whole, words[a:b])
            if leak:
                best[row, item] = (score, q, r, a - int(first[row]))
    return [(row, item, *found) for (row, item), found in best.items()]


def indexes(items: DataFrame, most: int = MOST_ITEMS) -> Iterator[Index]:
    """The indexes of all items, in parts of about ``most``; each is small enough to be broadcast."""
    rows = items.select(F.col("item_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = cut(texts(rows).withColumn("at", F.xxhash64("doc_id", "text")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole):
                words, first = hashed_words(batch.column("text"))
                lengths = np.diff(first)
                item = np.repeat(np.arange(len(lengths)), lengths)
                order = np.lexsort((words, item))
                words, item = words[order], item[order]
                new = np.append(True, (words[1:] != words[:-1]) | (item[1:] != item[:-1])) if len(words) else np.zeros(0, bool)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("at").take(pa.array(item[new])), pa.array(signed(words[new])), pa.array(lengths[item[new]])],
                    ["at", "term", "length"],
                )

    n = rows.count()
    if not n:
        return
    found = cut(rows.mapInArrow(count, "at long, term long, length long"))
    df = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    lengths = found.select("at", "length").distinct()
    mean = lengths.agg(F.avg("length").alias("mean")).first()["mean"] or 1.0
    half = F.greatest(F.lit(MIN_WORDS), F.expr("shiftleft(1, cast(ceil(log2(length)) as int))"))
    placed = cut(rows.join(lengths, "at").withColumn("half", half))  # items without words match nothing
    for size, some in sorted((r["half"], r["count"]) for r in placed.groupBy("half").count().collect()):  # a row for each power of two
        parts = -(-some // most)
        for part in range(parts):
            here = placed.where((F.col("half") == size) & (F.pmod("at", F.lit(parts)) == part))
            own = df.join(found.join(here.select("at"), "at", "left_semi").select("term").distinct(), "term").collect()
            chosen = sorted(((r["doc_id"], r["text"]) for r in here.collect()), key=lambda x: (x[0] is None, x[0], x[1]))
            if chosen:
                yield build(chosen, {r["term"]: r["df"] for r in own}, n, mean, size)


def passes(items: DataFrame) -> Iterator[list[Index]]:
    """``AT_ONCE`` indexes at a time."""
    rest = indexes(items)
    while group := list(itertools.islice(rest, AT_ONCE)):
        yield group


def find_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """A row for each document and item of which it holds the question and the answer, or the whole but for one word.

    See ``TYPES``.
    """
    rows, found = texts(docs), None
    for group in passes(items):
        shared = docs.sparkSession.sparkContext.broadcast(group)
        part = rows.mapInArrow(_searcher(shared, threshold, overlap), TYPES)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], TYPES)
    return found


def _searcher(shared, threshold: float, overlap: float):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole):
                hits = [(row, index.items[i], *rest) for index in shared.value for row, i, *rest in leaks(batch, index, threshold, overlap)]
                row, item, *rest = zip(*hits) if hits else [()] * 6
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(item, pa.int64())]
                    + [pa.array(c, pa.float64()) for c in rest[:3]]
                    + [pa.array(rest[3], pa.int64())],
                    ["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "first_word"],
                )

    return search


def remove_leaks(
    docs: DataFrame, items: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP
) -> DataFrame:
    """The input rows that hold no item, with their columns as they were; no shuffle."""
    schema = docs.schema
    for group in passes(items):
        shared = docs.sparkSession.sparkContext.broadcast(group)

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in chunks(whole, text_col):
                    keep = np.ones(batch.num_rows, bool)
                    for index in shared.value:
                        keep[[h[0] for h in leaks(batch, index, threshold, overlap, text_col)]] = False
                    yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(clean, schema)
    return docs
