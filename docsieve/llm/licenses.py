"""License scan by fuzzy short-notice search.

A notice of n bytes may be met with k edits. Cut into k + 1 pieces, one of them must stand there unchanged
(pigeonhole), so exact searches for the pieces find every candidate; the regex library's bounded-error
matching then verifies the place and counts the edits; what the best match leaves of the place is searched
again, so stacked notices are all found. Words and the exact base phrases are found in the same pass, which
needs no shuffle.

Texts are searched as UTF-8 bytes with A-Z in lower case; edits count bytes. Defined cases: a null text is
empty and gives a row without findings; texts are searched whole, however long; repeated rows give repeated
results; an empty table gives none; other columns of the input, whatever their names, are not read. Of notices
that overlap the one with fewer edits counts, and of equal ones all do.
"""

from __future__ import annotations

import bisect
import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docsieve.llm.common import chunks, flat, texts
from docsieve.llm.hashing import LOWER, word_spans

# The base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Short notices of public licenses and their labels.
NOTICES = (
    ("licensed under the apache license, version 2.0", "apache-2.0"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted, free of charge, to any person obtaining a copy", "mit"),
    ("licensed under the gnu general public license, version 3", "gpl-3.0"),
    ("licensed under the gnu general public license, version 2", "gpl-2.0"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("subject to the terms of the mozilla public license", "mpl"),
    ("redistribution and use in source and binary forms, with or without modification", "bsd"),
    ("licensed under cc by-nc 4.0", "cc-by-nc"),
    ("licensed under cc by-sa 4.0", "cc-by-sa"),
    ("licensed under cc by 4.0", "cc-by"),
    ("creative commons attribution 4.0 international", "cc-by"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("permission to use, copy, modify, and/or distribute this software for any purpose", "isc"),
    ("neither the name of the copyright holder nor the names of its contributors", "bsd"),
    ("this software is provided 'as-is', without any express or implied warranty", "zlib"),
    ("boost software license - version 1.0", "boost"),
    ("eclipse public license", "epl"),
    ("cc0 1.0 universal", "cc0"),
    ("all rights reserved", "reserved"),
)
BYTES_PER_EDIT = 12
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
TYPES = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, "
    "labels array<string>, score double, spans array<struct<label: string, start: long, end: long, edits: int>>"
)
_SPAN = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())])
_SCHEMA = pa.schema(
    [(n, pa.int64()) for n in ("doc_id", "n_words", "n_base", "first_word", "last_word")]
    + [("base_labels", pa.list_(pa.string())), ("labels", pa.list_(pa.string())), ("score", pa.float64()), ("spans", pa.list_(_SPAN))]
)


def edits_of(notice: bytes) -> int:
    return len(notice) // BYTES_PER_EDIT


def cut_notice(notice: bytes, edits: int) -> list[tuple[int, bytes]]:
    """The notice in edits + 1 pieces, with their places."""
    at = [len(notice) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(at, at[1:])]


@functools.lru_cache(maxsize=4)
def compiled(notices: tuple[tuple[str, str], ...]):
    """Verifying patterns, and for each seed the (notice, place of the piece) that it stands for."""
    import regex

    patterns, seeds = [], {}
    for i, (text, _) in enumerate(notices):
        raw = text.encode()
        k = edits_of(raw)
        patterns.append(regex.compile(b"(?b)(?:" + regex.escape(raw, special_only=True) + b"){e<=%d}" % k))
        for place, piece in cut_notice(raw, k):
            seeds.setdefault(piece, []).append((i, place))
    return patterns, seeds


def places(raw: bytes, piece: bytes) -> Iterator[int]:
    at = raw.find(piece)
    while at >= 0:
        yield at
        at = raw.find(piece, at + 1)


def notice_spans(raw: bytes, pattern, windows: list[tuple[int, int]], least: int) -> list[tuple[int, int, int]]:
    """Start, end and edits of the notices in the windows, none over another: fewest edits first, then leftmost.

    What a found notice leaves of a window is searched again, on both sides, until nothing is found.
    """
    heap: list[tuple[int, int, int, int, int]] = []
    taken: list[tuple[int, int, int]] = []  # in order; they don't overlap

    def search(a: int, b: int) -> None:
        if b - a >= least and (m := pattern.search(raw, a, b)):
            heapq.heappush(heap, (sum(m.fuzzy_counts), m.start(), m.end(), a, b))

    for a, b in windows:
        search(a, b)
    while heap:
        edits, start, end, a, b = heapq.heappop(heap)
        low = high = bisect.bisect(taken, (start,))
        while low and taken[low - 1][1] > start:
            low -= 1
        while high < len(taken) and taken[high][0] < end:
            high += 1
        if low == high:
            taken.insert(low, (start, end, edits))
            search(a, start)
            search(end, b)
        else:  # the window's parts beside what was found since
            for left, right, _ in taken[low:high]:
                search(a, left)
                a = max(a, right)
            search(a, b)
    return taken


def fuzzy_spans(raw: bytes, offsets: np.ndarray, notices: tuple[tuple[str, str], ...]) -> dict[int, list[tuple]]:
    """For each text (by its number) with verified notices: label, start, end and edits of each, in bytes."""
    return {doc: list(dict.fromkeys(h[:4] for h in hits)) for doc, hits in sized_spans(raw, offsets, notices).items()}


def sized_spans(raw: bytes, offsets: np.ndarray, notices: tuple[tuple[str, str], ...]) -> dict[int, list[tuple]]:
    """As ``fuzzy_spans``, with the bytes of the notice itself."""
    patterns, seeds = compiled(notices)
    sizes = [len(text.encode()) for text, _ in notices]
    windows: dict[tuple[int, int], set[tuple[int, int]]] = {}
    for piece, uses in seeds.items():
        for at in places(raw, piece):
            doc = int(np.searchsorted(offsets, at, "right")) - 1
            low, high = int(offsets[doc]), int(offsets[doc + 1])
            for i, place in uses:
                k = edits_of(notices[i][0].encode())
                windows.setdefault((doc, i), set()).add((max(low, at - place - k), min(high, at - place + sizes[i] + k)))
    found: dict[int, list[tuple]] = {}
    for (doc, i), spans in windows.items():
        k = edits_of(notices[i][0].encode())
        merged: list[list[int]] = []
        for a, b in sorted(spans):
            # Seeds of one notice lie within 2k bytes; no window grows beyond that, however many notices are stacked.
            if merged and a <= merged[-1][0] + 2 * k:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        base = int(offsets[doc])
        for start, end, edits in notice_spans(raw, patterns[i], merged, sizes[i] - k):
            found.setdefault(doc, []).append((notices[i][1], start - base, end - base, edits, sizes[i]))
    return {doc: best_spans(hits) for doc, hits in found.items()}


def best_spans(hits: list[tuple]) -> list[tuple]:
    """The spans that don't overlap one with fewer edits: of notices that differ in a digit, the nearest."""
    hits = sorted(set(hits), key=lambda h: (h[1], h[2], h[0]))
    out, at = [], 0
    while at < len(hits):  # a cluster of overlapping spans at a time
        end, high = at + 1, hits[at][2]
        while end < len(hits) and hits[end][1] < high:
            high = max(high, hits[end][2])
            end += 1
        cluster = hits[at:end]
        out += [h for h in cluster if not any(o[3] < h[3] and o[1] < h[2] and h[1] < o[2] for o in cluster)]
        at = end
    return out


def base_places(raw: bytes, starts, ends, first, phrases: dict[str, str]) -> dict[int, list[tuple[int, str]]]:
    """For each text with a base phrase: the word at which it starts, and its label."""
    found: dict[int, list[tuple[int, str]]] = {}
    for phrase, label in phrases.items():
        words = [w.encode() for w in phrase.split()]
        rare = max(range(len(words)), key=lambda i: len(words[i]))
        for at in places(raw, words[rare]):
            at_word = int(np.searchsorted(starts, at)) - rare
            if at_word < 0 or at_word + len(words) > len(starts) or starts[at_word + rare] != at:
                continue
            doc = int(np.searchsorted(first, at_word, "right")) - 1
            if at_word + len(words) <= first[doc + 1] and all(
                raw[starts[at_word + j] : ends[at_word + j]] == w for j, w in enumerate(words)
            ):
                found.setdefault(doc, []).append((at_word - int(first[doc]), label))
    return found


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: tuple[tuple[str, str], ...] = NOTICES) -> DataFrame:
    """Words, base phrases, labels and verified notice spans of each document; see ``TYPES``.

    ``score`` is 1 where a base phrase stands, else the best share, of any notice that was met, of its own bytes that needed no edit.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole):
                raw, offsets = flat(batch.column("text"))
                low = LOWER[raw]
                starts, ends, first = word_spans(low, offsets, _WORD)
                data = low.tobytes()
                fuzzy, base = sized_spans(data, offsets, notices), base_places(data, starts, ends, first, phrases)
                n = batch.num_rows
                counts, firsts, lasts, scores = [0] * n, [None] * n, [None] * n, [0.0] * n
                base_labels: list[list[str]] = [[] for _ in range(n)]
                labels: list[list[str]] = [[] for _ in range(n)]
                spans: list[list[dict]] = [[] for _ in range(n)]
                for doc, hits in base.items():
                    at = [a for a, _ in hits]
                    counts[doc], firsts[doc], lasts[doc], scores[doc] = len(hits), min(at), max(at), 1.0
                    base_labels[doc] = sorted({label for _, label in hits})
                for doc, hits in fuzzy.items():
                    spans[doc] = [dict(zip(("label", "start", "end", "edits"), h)) for h in sorted({h[:4] for h in hits})]
                    scores[doc] = max(scores[doc], *(1 - h[3] / h[4] for h in hits))
                for doc in {*base, *fuzzy}:
                    labels[doc] = sorted({*base_labels[doc], *(s["label"] for s in spans[doc])})
                columns = (batch.column("doc_id"), np.diff(first), counts, firsts, lasts, base_labels, labels, scores, spans)
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, _SCHEMA)], schema=_SCHEMA
                )

    return texts(docs).mapInArrow(search, TYPES)
