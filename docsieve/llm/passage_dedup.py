"""Substring deduplication by words: repeated-phrase automata.

Phrases of ``GRAM`` words that anchor windows are the candidates; hashes of them tell which may recur. Those
are gathered as strings, and a grouped count of the strings confirms the phrases that occur twice or more.
The table of confirmed phrases is dealt to shards, one for each chunk of documents (the phrases that anchor a
window of one of them), so that a shard is bounded by its chunk and not by the corpus; each shard is compiled to
an Aho-Corasick automaton, and all documents (but whole copies of others, which go as a whole) are streamed,
whole, through theirs. What was winnowed before plays no part from there on: the occurrences are the automaton's
hits, at whatever place, a window is one to look at if it holds a hit, and of several it goes by the one with the
least hash. Equal windows go by the same one: the phrase that anchors them is confirmed, in both shards, and has
the least hash of all their phrases. The words of windows that meet are compared, and each that also starts earlier
(smaller id, or same document and earlier start) is one whose words go.

Defined cases: a null text has no words; texts of fewer words than a window keep all; a row with a null
or repeated id is a document of its own, in the order of id (nulls last) and text; an empty table gives
no rows; long texts are hashed in blocks; other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.llm import repeats
from docsieve.llm.common import chunks, keyed
from docsieve.llm.hashing import Rolling, mix
from docsieve.llm.repeats import (
    PIECES,
    Sequence,
    Unit,
    covered,
    cut_pieces,
    grouped_keys,
    known,
    per_document,
    recurring,
    recurring_anchors,
    settle,
    whole_copies,
    without,
)

WINDOW = 20
GRAM = 8


def joined_words(found: Sequence):
    """A function from first words and ends of stretches to their words, joined by single blanks."""
    raw = found.raw.tobytes()
    starts, ends = found.starts, found.ends

    def text_of(a: np.ndarray, b: np.ndarray) -> list[bytes]:
        # Empty stretches are those of windows that are settled already.
        low, high = starts[np.minimum(a, len(starts) - 1)], ends[np.maximum(b, 1) - 1]
        return [b" ".join(raw[i:j].split()) if m < n else b"" for i, j, m, n in zip(low.tolist(), high.tolist(), a.tolist(), b.tolist())]

    return text_of


def candidate_phrases(docs: DataFrame, unit: Unit) -> DataFrame:
    """``phrase`` (its words joined by blanks), ``key`` and ``more`` of the anchors that may recur, once for each chunk."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, limit=unit.chunk):
                found = Sequence(batch, unit)
                chosen = np.flatnonzero(known(batch, "hot", found.anchor) | known(batch, "cold", found.anchor))
                if len(chosen):
                    place = found.place[chosen]
                    phrases = pa.array(joined_words(found)(place, place + unit.gram), pa.binary()).dictionary_encode()
                    at, keys, more = grouped_keys(phrases.indices.to_numpy(), batch.column("key").to_numpy()[found.doc[chosen]])
                    yield pa.RecordBatch.from_arrays([phrases.take(pa.array(at)).cast(pa.binary()), pa.array(keys), more], ["phrase", "key", "more"])

    return docs.mapInArrow(emit, "phrase binary, key long, more array<long>")


def confirmed_phrases(docs: DataFrame, unit: Unit) -> DataFrame:
    """``key`` of each document with phrases that recur as strings, and these: ``cold`` and ``hot``."""
    rows = recurring(candidate_phrases(docs, unit), "phrase")
    return rows.groupBy("key").agg(
        F.collect_set(F.when(F.col("times") <= repeats.HOT, F.col("phrase"))).alias("cold"),
        F.collect_set(F.when(F.col("times") > repeats.HOT, F.col("phrase"))).alias("hot"),
    )


def compiled(shard: dict[bytes, bool]):
    """The Aho-Corasick automaton of a shard's phrases; it tells of each occurrence its length and whether it is hot."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for phrase, hot in shard.items():
        # Latin-1: a character for each byte, so that places are places of bytes. Words stand between blanks.
        automaton.add_word(f" {phrase.decode('latin-1')} ", (len(phrase) + 1, hot))
    automaton.make_automaton()
    return automaton


def located(automaton, found: Sequence) -> np.ndarray:
    """Streams all texts of a chunk through the automaton: of each word, 1 if a phrase starts there, 2 if it is hot."""
    hit = np.zeros(len(found.starts), np.int8)
    text_of = joined_words(found)
    lengths = found.ends - found.starts + 1
    a, b = found.bounds[:-1], found.bounds[1:]
    for first, end, text in zip(a.tolist(), b.tolist(), text_of(a, b)):
        ends, kinds = [], []
        for at, (size, hot) in automaton.iter(f" {text.decode('latin-1')} "):
            ends.append(at - size)
            kinds.append(1 + hot)
        if ends:
            at = np.cumsum(lengths[first:end]) - lengths[first:end]
            hit[first + np.searchsorted(at, np.asarray(ends))] = kinds
    return hit


def window_pieces(docs: DataFrame, unit: Unit) -> DataFrame:
    """Pieces with their words, of all windows around the phrases that the automata locate."""

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, limit=unit.chunk):
                shard = dict.fromkeys(batch.column("cold").flatten().to_pylist(), False)
                shard |= dict.fromkeys(batch.column("hot").flatten().to_pylist(), True)
                if not shard:
                    continue
                automaton = compiled(shard)
                found = Sequence(batch, unit, lambda s: located(automaton, s))
                chosen = np.arange(len(found.first))
                if not len(chosen):
                    continue
                hot = found.kinds[found.place] == 2
                raw, starts, ends = found.raw.tobytes(), found.starts.tolist(), found.ends.tolist()
                words = pa.array([raw[a:b] for a, b in zip(starts, ends)], pa.binary()).dictionary_encode().indices.to_numpy()
                del raw, starts, ends

                def again(run: np.ndarray, start: np.ndarray) -> np.ndarray:
                    return repeated(words, start, np.zeros(len(start), np.int64), unit.window)

                yield cut_pieces(found, chosen, hot, batch.column("key").to_numpy(), unit, again, joined_words(found))

    return docs.mapInArrow(locate, PIECES)


def repeated(words: np.ndarray, at: np.ndarray, group: np.ndarray, window: int) -> np.ndarray:
    """Of windows (by their first words, in order of occurrence), whether an earlier one of the group has the same words.

    ``words`` are numbers of words. Hashes bring the windows together; their words are compared.
    """
    if not len(at):
        return np.zeros(0, bool)
    hashes = Rolling(mix(words.astype(np.uint64))).ranges(at, at + window) ^ mix(group.astype(np.uint64))
    _, lead, which = np.unique(hashes, return_index=True, return_inverse=True)
    lead = lead[which]
    again = lead != np.arange(len(at))
    same = group == group[lead]
    for k in range(window):
        same &= words[at + k] == words[at[lead] + k]
    for h in np.unique(which[~same]):  # other words with the same hash
        seen: set[tuple] = set()
        for i in np.flatnonzero(which == h).tolist():
            own = (int(group[i]), *words[at[i] : at[i] + window].tolist())
            again[i] = own in seen
            seen.add(own)
    return again


def earlier(window: int):
    """What ``settle`` asks of a block: the windows whose words stand earlier in it."""

    def find(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        count = np.asarray(rows.column("count")).astype(np.int64)
        words = pa.array(b" ".join(rows.column("bytes").to_pylist()).split(), pa.binary()).dictionary_encode().indices.to_numpy()
        piece = np.repeat(np.arange(len(count)), count)
        inner = np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count)
        size = count + window - 1
        at = (np.cumsum(size) - size)[piece] + inner
        again = repeated(words, at, np.asarray(rows.column("route"))[piece], window)
        return piece[again], inner[again]

    return find


def remove_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed`` and ``kept``, the kept words joined by spaces, of each document."""
    unit = Unit(window, gram, True, 1 << 19)
    rows = keyed(docs, id_col, text_col)
    copies = whole_copies(rows)
    own = without(rows, copies)
    phrases = confirmed_phrases(rows.join(recurring_anchors(own, unit), "key"), unit)
    empty = F.array().cast("array<binary>")
    sharded = own.join(phrases, "key", "left").withColumns({c: F.coalesce(c, empty) for c in ("cold", "hot")})
    again = settle(window_pieces(sharded, unit), earlier(window))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole):
                n_words, n_removed, kept = [], [], []
                columns = (batch.column(c).to_pylist() for c in ("text", "starts", "counts"))
                for text, starts, counts in zip(*columns):
                    words = text.encode().split()  # at blanks and the controls 9 to 13
                    n_words.append(len(words))
                    if starts:
                        gone = covered(len(words), starts, counts, window)
                        words = [words[i] for i in np.flatnonzero(~gone).tolist()]
                    n_removed.append(n_words[-1] - len(words))
                    kept.append(b" ".join(words).decode())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())],
                    ["doc_id", "n_words", "n_removed", "kept"],
                )

    return per_document(rows, again, copies).mapInArrow(keep, "doc_id long, n_words long, n_removed long, kept string")
