"""The registered queries against brute force, column by column, on the smallest tables."""

import base64
import collections
import hashlib
import re
import zlib

import numpy as np
import pytest

from docsieve.llm import queries
from docsieve.llm.common import default_tokenizer

from .test_dedup import brute_join, brute_windows

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect())


def rows(spark, name):
    return queries.QUERIES[name](spark, FOLDER).collect()


def test_op1(spark, docs):
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(default_tokenizer())
    ids = {d: [*exact.encode(t, add_special_tokens=False).ids, 1] for d, t in docs}
    got, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows(spark, "op1_packing"):
        piece = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(piece) == r["length"] and r["ids_crc32"] == zlib.crc32(np.array(piece, "<u4").tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])
        got[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for d, own in ids.items():
        ends = [0]
        for start, length in sorted(got[d]):
            assert start == ends[-1]
            ends.append(start + length)
        assert ends[-1] == len(own)
    assert sorted(sequences) == list(range(len(sequences)))
    for pieces in sequences.values():
        total = 0
        for offset, length in sorted(pieces):
            assert offset == total
            total += length
        assert total <= 2048 and total & (total - 1) == 0  # a power of two needs no padding


def test_op2(spark, docs):
    gone = brute_windows([(d, t.encode()) for d, t in docs], 100)
    want = set()
    for d, t in docs:
        raw, flags = t.encode(), gone[d]
        kept = bytes(b for b, g in zip(raw, flags) if not g)
        spans = len(re.findall("1+", "".join("01"[g] for g in flags)))
        want.add((d, len(raw), sum(flags), spans, hashlib.sha256(kept).hexdigest()))
    assert {tuple(r) for r in rows(spark, "op2_suffix_dedup")} == want


def test_op3(spark, docs):
    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    got = {r["doc_id"]: r for r in rows(spark, "op3_licenses")}
    for d, t in docs:
        words = word.findall(t.encode().translate(low))
        at = [(i, label) for p, label in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.encode().split()]
        r = got[d]
        want = (len(words), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at})))
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == want
        assert {*filter(None, r["base_labels"].split(","))} <= {*filter(None, r["labels"].split(","))} and 0 <= r["score"] <= 1
        assert r["labels"] == ",".join(sorted(set(filter(None, r["labels"].split(",")))))


def test_op5(spark, docs):
    from docsieve.llm import jaccard_join

    want = brute_join(docs, jaccard_join.Rule(3, 90))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in rows(spark, "op5_jaccard_join")} == want


def test_op6(spark, docs):
    got = rows(spark, "op6_sharding")
    assert {(r["doc_id"], r["size"], r["text_crc32"], r["law"], r["grown_shard"]) for r in got} == {(d, len(t.encode()) + 8, zlib.crc32(t.encode()), "bytes", None) for d, t in docs}
    total, first = sum(r["size"] for r in got), 0
    shards = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: r["doc_id"]):
        assert r["shard"] == first * queries.SHARDS // total  # the shard in which its first byte falls
        shards[r["shard"]].append(r["slot"])
        first += r["size"]
    assert all(slots == list(range(len(slots))) for slots in shards.values()) and set(shards) <= set(range(24))


def test_op9(spark, docs):
    split = {d: re.findall(rb"[^\x20\x09-\x0D]+", t.encode()) for d, t in docs}
    gone = brute_windows(list(split.items()), 20)
    want = {(d, len(w), sum(gone[d]), hashlib.sha256(b" ".join(x for x, g in zip(w, gone[d]) if not g)).hexdigest()) for d, w in split.items()}
    assert {tuple(r) for r in rows(spark, "op9_passage_dedup")} == want


def test_op10(spark):
    pages = [(r["page_id"], (r["html"] or "").encode()) for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()]
    winner = {}
    for i, raw in pages:
        winner[raw] = max(winner.get(raw, i), i)
    want = {
        (i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if winner[raw] == i else "revisit", None if winner[raw] == i else winner[raw])
        for i, raw in pages
    }
    got = rows(spark, "op10_warc")
    assert {(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got} == want
    assert all(r["intact"] is not False for r in got)
