"""Substring deduplication by bytes: deep-shallow suffix sorting.

The suffixes that can share ``WINDOW`` bytes with another are those around anchors that recur in the
corpus; those of one anchor, at one place relative to it, are a group. Multikey quicksort orders the groups
by eight bytes at a time to a shallow depth: each group is split around a pivot into less, equal and more,
and the equal part goes on to the next eight bytes. The groups that are still tied at ``SHALLOW`` bytes have
long common prefixes; a blind trie orders each of them to the window's end. Suffixes that tie over the
whole window are occurrences of one string, byte for byte: the earliest (smaller id, or same document and
earlier start) stays, and the bytes of the others go. The sort decides within a chunk of documents first,
then in the tasks where the chunks' windows meet; only whole copies of a document are set aside before, by
their SHA-256.

Defined cases: a null text is empty; texts shorter than a window stay whole; a row with a null or
repeated id is a document of its own, in the order of id (nulls last) and text; an empty table gives no
rows; long texts are hashed in blocks; other columns of the input, whatever their names, are not read. Bytes are judged without regard to characters, so what is left may
not be valid UTF-8: ``kept`` is binary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docsieve.llm.common import chunks, keyed
from docsieve.llm.hashing import mix
from docsieve.llm.repeats import (
    PIECES,
    Sequence,
    Unit,
    covered,
    cut_pieces,
    known,
    per_document,
    recurring_anchors,
    settle,
    whole_copies,
    without,
)

WINDOW = 100
GRAM = 32
SHALLOW = 40


class BlindTrie:
    """A trie of equal-length strings that stores branching places only.

    A node is (place, children by byte, some string below); a leaf's place is the length and its children
    are None. ``insert`` returns the first string that ties with this one over the whole length.
    """

    def __init__(self, strings: list[bytes]):
        self.strings, self.root = strings, None
        self.numbers = [int.from_bytes(s, "big") for s in strings]

    def insert(self, i: int) -> int:
        s = self.strings[i]
        leaf = (len(s), None, i)
        if self.root is None:
            self.root = leaf
            return i
        node = self.root
        while node[1] is not None:  # blindly, to some string that may share the longest prefix
            node = node[1].get(s[node[0]]) or (len(s), None, node[2])
        near = node[2]
        differs = self.numbers[i] ^ self.numbers[near]
        if not differs:
            return near
        place = len(s) - (differs.bit_length() + 7) // 8
        above, node = None, self.root
        while node[0] < place:
            above, node = node, node[1][s[node[0]]]
        if node[0] == place:
            node[1][s[place]] = leaf
            return i
        inner = (place, {self.strings[near][place]: node, s[place]: leaf}, near)
        if above is None:
            self.root = inner
        else:
            above[1][s[above[0]]] = inner
        return i


def shallow_sort(text: np.ndarray, at: np.ndarray, group: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of suffixes within their groups by ``depth`` bytes, all groups at a time.

    A group is split around the word of eight bytes in its middle; its equal part goes on to the next word.
    A suffix that is alone leaves. Returns the suffixes (as indices) that are tied over the depth, and their groups.
    """
    words = np.ndarray(max(len(text) - 7, 0), ">u8", text.tobytes(), strides=(1,))
    chosen = np.argsort(group, kind="stable")
    group = group[chosen]
    done = np.zeros(len(chosen), np.int64)
    out, seen = [(chosen[:0], np.zeros(0, np.int64))], 0
    while len(chosen):
        begin = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        size = np.diff(np.append(begin, len(group)))
        number = np.repeat(np.arange(len(begin)), size)
        at_end = done[begin] >= depth
        tied = (at_end & (size > 1))[number]
        out.append((chosen[tied], number[tied] + seen))
        seen += len(begin)
        active = (~at_end & (size > 1))[number]
        middle = np.repeat(begin + size // 2, size)[active]
        word = words[at[chosen] + np.minimum(done, depth - 8)].astype(np.uint64)
        side = (word[active] > word[middle]).astype(np.int64) - (word[active] < word[middle])
        part = number[active] * 3 + side + 1
        order = np.argsort(part, kind="stable")
        chosen, done = chosen[active][order], (done[active] + 8 * (side == 0))[order]
        group = part[order]
    return tuple(np.concatenate(x) for x in zip(*out))


def tied_suffixes(text: np.ndarray, at: np.ndarray, group: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Of suffixes in order of occurrence, whether an earlier one of the group has the same ``window`` bytes."""
    again = np.zeros(len(at), bool)
    shallow = min(SHALLOW, window // 8 * 8)
    chosen, group = shallow_sort(text, at, group, shallow)
    if not len(chosen):
        return again
    raw = text.tobytes()
    deep = [raw[a + shallow : a + window] for a in at[chosen].tolist()]
    ends = np.append(np.flatnonzero(group[1:] != group[:-1]) + 1, len(chosen)).tolist()
    tied, begin = [], 0
    for end in ends:
        trie = BlindTrie(deep[begin:end])
        tied += [trie.insert(i) != i for i in range(end - begin)]
        begin = end
    again[chosen] = tied
    return again


def earlier(window: int):
    """What ``settle`` asks of a block: the windows that stand earlier in it, found by sorting their suffixes."""

    def find(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        count, off, route = (np.asarray(rows.column(c)) for c in ("count", "off", "route"))
        pieces = rows.column("bytes").to_pylist()
        length = np.array([len(x) for x in pieces], np.int64)
        n = count.astype(np.int64)
        piece = np.repeat(np.arange(len(n)), n)
        inner = np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n)
        at = (np.cumsum(length) - length)[piece] + inner
        # One group for each route and place of the anchor; a chance meeting of two only compares more.
        group = mix(route.astype(np.int64).view(np.uint64)[piece] + mix((off[piece] - inner).astype(np.uint64)))
        again = tied_suffixes(np.frombuffer(b"".join(pieces), np.uint8), at, group, window)
        return piece[again], inner[again]

    return find


def suffix_pieces(docs: DataFrame, unit: Unit) -> DataFrame:
    """Pieces with their bytes, of all windows around anchors that recur."""

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, limit=unit.chunk):
                found = Sequence(batch, unit)
                hot = known(batch, "hot", found.anchor)
                chosen = np.flatnonzero(hot | known(batch, "cold", found.anchor))
                if not len(chosen):
                    continue
                raw = found.raw.tobytes()

                def tied(run: np.ndarray, start: np.ndarray) -> np.ndarray:
                    group = mix(found.anchor[run] + mix((found.place[run] - start).astype(np.uint64)))
                    return tied_suffixes(found.raw, start, group, unit.window)

                def text_of(a: np.ndarray, b: np.ndarray) -> list[bytes]:
                    return [raw[i:j] for i, j in zip(a.tolist(), b.tolist())]

                yield cut_pieces(found, chosen, hot, batch.column("key").to_numpy(), unit, tied, text_of)

    return docs.mapInArrow(locate, PIECES)


def remove_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept`` (binary) of each document."""
    unit = Unit(window, gram, False, 1 << 18)
    rows = keyed(docs, id_col, text_col)
    copies = whole_copies(rows)
    found = recurring_anchors(without(rows, copies), unit)
    again = settle(suffix_pieces(rows.join(found, "key"), unit), earlier(window))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole):
                n_bytes, n_removed, n_spans, kept = [], [], [], []
                columns = (batch.column(c).to_pylist() for c in ("text", "starts", "counts"))
                for text, starts, counts in zip(*columns):
                    raw, spans = text.encode(), 0
                    n_bytes.append(len(raw))
                    if starts and raw:
                        gone = covered(len(raw), starts, counts, window)
                        spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
                        raw = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                    n_removed.append(n_bytes[-1] - len(raw))
                    n_spans.append(spans)
                    kept.append(raw)
                counts3 = [pa.array(c, pa.int64()) for c in (n_bytes, n_removed, n_spans)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), *counts3, pa.array(kept, pa.binary())],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
                )

    types = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    return per_document(rows, again, copies).mapInArrow(keep, types)
