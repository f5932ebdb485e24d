"""Values of the license scan and of exact deduplication against brute force."""

import random

import numpy as np

from docsieve.llm import exact_dedup, jaccard_join, licenses, queries
from docsieve.llm.hashing import LOWER

from . import fixtures
from .test_dedup import brute_join

FOLDER = "/root/testdata/sf0.001"


def least_edits(notice: bytes, raw: bytes) -> int:
    """The edit distance of the notice from the nearest stretch of the text, by the whole table of distances."""
    text = np.frombuffer(raw, np.uint8)
    at = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)  # a stretch may begin anywhere
    for i, c in enumerate(notice, 1):
        row = np.minimum(np.append(i, row[:-1] + (text != c)), row + 1)
        row = np.minimum.accumulate(row - at) + at
    return int(row.min())


def edited(r, text: str, n: int) -> str:
    out = list(text)
    for _ in range(n):
        i = r.randrange(2, len(out) - 2)
        out[i : i + 1] = r.choice([["#"], [], [out[i], "#"]])
    return "".join(out)


def test_score_is_that_of_the_notice_that_was_met(spark):
    r = random.Random(8)
    rows, at = [], 0
    for text, _ in licenses.NOTICES:
        k = licenses.edits_of(text.encode())
        for n in range(k + 2):
            for _ in range(3):
                rows.append((at, "plain words before " + edited(r, text, n) + " and plain words behind"))
                at += 1
    got = {x["doc_id"]: x for x in licenses.scan(fixtures.table(spark, rows)).collect()}
    checked = 0
    for doc, text in rows:
        raw = LOWER[np.frombuffer(text.encode(), np.uint8)].tobytes()
        met = [(label, len(t.encode()), d) for t, label in licenses.NOTICES if (d := least_edits(t.encode(), raw)) <= licenses.edits_of(t.encode())]
        labels = {label for label, _, _ in met}
        x = got[doc]
        assert set(x["labels"]) - set(x["base_labels"]) <= labels
        if not x["base_labels"] and len(met) == 1:
            label, size, d = met[0]
            assert x["labels"] == [label] and abs(x["score"] - (1 - d / size)) < 1e-12
            assert [(s["label"], s["edits"]) for s in x["spans"]] == [(label, d)]
            checked += 1
        elif not met and not x["base_labels"]:
            assert x["labels"] == [] and x["score"] == 0 and x["spans"] == []
    assert checked > 100


def test_op3_on_its_table(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    seen = 0
    for x in queries.QUERIES["op3_licenses"](spark, FOLDER).collect():
        raw = LOWER[np.frombuffer(texts[x["doc_id"]].encode(), np.uint8)].tobytes() if texts[x["doc_id"]] else b""
        base, labels = ({*filter(None, x[c].split(","))} for c in ("base_labels", "labels"))
        for s in x["spans"]:
            sizes = [len(t.encode()) for t, label in licenses.NOTICES if label == s["label"] and least_edits(t.encode(), raw[s["start"] : s["end"]]) == s["edits"] <= licenses.edits_of(t.encode())]
            assert sizes
            seen += 1
        assert labels == base | {s["label"] for s in x["spans"]}
        met = {label: 1 - d / len(t.encode()) for t, label in licenses.NOTICES if raw and (d := least_edits(t.encode(), raw)) <= licenses.edits_of(t.encode())}
        assert labels - base <= set(met)
        assert x["score"] == 1 if base else abs(x["score"] - max(met.values(), default=0)) < 1e-12
    assert seen > 5


def test_the_row_that_stays_is_fixed(spark):
    """Rows that share id and normalised text, but not the rest: the same one stays however the table is dealt."""
    rows = [(i % 3, "alpha" + " " * (i % 5 + 1) + "beta", f"lang {i}", "s", None, *["x"] * 7) for i in range(60)]
    rows += [(None, "gamma\t" * (i % 4), f"g {i}", None, i, *["y"] * 7) for i in range(40)]
    found = set()
    for n, share in ((1, None), (4, 0.2), (7, 0.2), (9, 0.01)):
        docs = spark.createDataFrame(rows, fixtures.DOCS).repartition(n)
        found.add(tuple(sorted(map(str, exact_dedup.exact_dedup(docs, share=share).collect()))))
    assert len(found) == 1 and len(next(iter(found))) == 5


def test_a_large_group_and_a_token_in_all_sets(spark):
    """Thousands of near copies of one text beside others that share a phrase with all."""
    r = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    base = [r.choice(words) for _ in range(80)]
    docs = []
    for i in range(1500):
        copy = list(base)
        copy[r.randrange(80)] = f"x{r.randrange(40)}"
        docs.append((i, "common phrase here " + " ".join(copy)))
    docs += [(5000 + i, "common phrase here " + " ".join(r.choice(words) for _ in range(60))) for i in range(200)]
    rule = jaccard_join.Rule(5, 80)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard_join.jaccard_join(fixtures.table(spark, docs).repartition(6), rule).collect()}
    want = {d: v[:2] for d, v in brute_join(docs, rule).items()}
    assert got == want
