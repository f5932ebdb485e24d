import collections
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from docsieve.llm import decontamination, licenses, packing, sharding, toxicity, warc
from docsieve.llm.common import default_tokenizer

from . import fixtures


def test_decompose():
    for n in (1, 2, 3, 2047, 2048, 2049, 5000):
        parts = packing.decompose(n)
        assert sum(parts) == n and all(p & (p - 1) == 0 and p <= 2048 for p in parts)
        assert sorted(set(p for p in parts if p < 2048)) == sorted(p for p in parts if p < 2048)


def test_packing(spark):
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(default_tokenizer())
    got = collections.defaultdict(list)
    for r in packing.pack(fixtures.table(spark), default_tokenizer()).collect():
        got[r["doc_id"]].append(r)
    for doc, text in fixtures.texts():
        ids = np.array(exact.encode(text or "", add_special_tokens=False).ids + [1], "<u4").tobytes()
        rows = sorted(got[doc], key=lambda r: r["start"])
        assert b"".join(bytes(r["ids"]) for r in rows) == ids
        assert all(r["doc_tokens"] * 4 == len(ids) and r["offset"] == 0 for r in rows)
    numbers = sorted((r["sequence_id"], -r["length"]) for rows in got.values() for r in rows)
    assert [n for n, _ in numbers] == list(range(len(numbers)))
    assert [x for _, x in numbers] == sorted(x for _, x in numbers)  # equal lengths side by side
    assert packing.pack(fixtures.odd(spark), default_tokenizer()).where("length > 0").count() >= 7
    assert packing.pack(fixtures.empty(spark), default_tokenizer()).count() == 0


def test_quick_ids_are_the_exact_ones():
    from tokenizers import Tokenizer

    exact, r = Tokenizer.from_file(default_tokenizer()), random.Random(1)
    letters = "abcdefghij éèüßñÄÖ0123456789  \n\t.,;:!?'\"-_()[]{}<>/\\|@#$%^&*~`ſȺ"
    batch = ["".join(r.choice(letters) for _ in range(r.randint(0, 200))) for _ in range(300)] + ["it's WE'LL 'd  \n\n x", "x" * 5000]
    assert packing.encoder(default_tokenizer())(batch) == [e.ids for e in exact.encode_batch(batch, add_special_tokens=False)]


@pytest.mark.parametrize("shards", [1, 5, 24])
def test_sharding(spark, shards):
    rows = sharding.assign_shards(fixtures.table(spark).repartition(5), shards).collect()
    text = {d: (t or "").encode() for d, t in fixtures.texts()}
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == {d: (len(t) + 8, zlib.crc32(t)) for d, t in text.items()}
    total, at = sum(len(t) + 8 for t in text.values()), 0
    slots = collections.defaultdict(int)
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        shard = at * shards // total
        assert (r["first_byte"], r["shard"], r["slot"]) == (at, shard, slots[shard])
        slots[shard] += 1
        at += r["size"]


def test_sharding_odd_and_written(spark, tmp_path):
    assert sharding.assign_shards(fixtures.empty(spark), 3).count() == 0
    rows = sharding.assign_shards(fixtures.odd(spark), 2).collect()
    assert sorted((r["shard"], r["slot"]) for r in rows) == [(s, i) for s in (0, 1) for i in range(sum(r["shard"] == s for r in rows))]
    sharding.write_shards(fixtures.table(spark), str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(fixtures.texts())


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate({c: c + 32 for c in range(65, 91)}))


def test_license_scan(spark):
    rows = fixtures.texts() + [
        (50, "Released under the MLT Licence."),
        (51, "x Licensed  under the Apache License, Version 2.0 y all rights reserved, ALL RIGHTS reserved"),
        (52, "general public licenses; occ by"),
        (53, "This work is licensed under the GNU General Public License, version 3."),
    ]
    got = {r["doc_id"]: r for r in licenses.scan(fixtures.table(spark, rows)).collect()}
    for doc, text in rows:
        w = words(text or "")
        base = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        r = got[doc]
        assert (r["n_words"], r["n_base"]) == (len(w), len(base))
        assert r["first_word"] == min((i for i, _ in base), default=None) and r["last_word"] == max((i for i, _ in base), default=None)
        assert r["base_labels"] == sorted({label for _, label in base}) and set(r["base_labels"]) <= set(r["labels"])
        assert 0 <= r["score"] <= 1
    assert got[50]["labels"] == ["mit"] and got[50]["spans"][0]["edits"] == 2
    assert "apache-2.0" in got[51]["labels"] and got[51]["n_base"] == 2
    assert got[53]["labels"] == ["gpl", "gpl-3.0"]
    assert got[52]["labels"] == []
    assert licenses.scan(fixtures.empty(spark)).count() == 0 and licenses.scan(fixtures.odd(spark)).count() == 7


def test_seeds_find_every_notice_within_the_edits():
    import regex

    r = random.Random(2)
    for text, label in licenses.NOTICES:
        raw, k = text.encode(), licenses.edits_of(text.encode())
        for _ in range(30):
            changed = bytearray(raw)
            for _ in range(r.randint(0, k)):
                at = r.randrange(len(changed))
                kind = r.randrange(3)
                changed[at : at + (kind != 1)] = b"q" * (kind != 0)
            page = b"lead in " + bytes(changed) + b" and on"
            want = regex.search(b"(?b)(?:" + regex.escape(raw, special_only=True) + b"){e<=%d}" % k, page)
            found = licenses.fuzzy_spans(page, np.array([0, len(page)]), ((text, label),))
            assert want and found[0][0][3] == sum(want.fuzzy_counts)


def test_stacked_notices_with_falling_edits_are_all_found():
    r = random.Random(3)
    for text, label in licenses.NOTICES:
        k, page, want = licenses.edits_of(text.encode()), b"", []
        for edits in range(k, -1, -1):
            changed = bytearray(text.encode())
            for at in r.sample(range(1, len(changed) - 1), edits):
                changed[at] = ord("Q")
            want.append((label, len(page), len(page) + len(changed), edits))
            page += bytes(changed) + b"\n"
        assert licenses.fuzzy_spans(page, np.array([0, len(page)]), ((text, label),)) == {0: want}
    page = b"licensd undr the gnu general public license, version 3\nlicensed under the gnu general public license, version 2"
    assert [(h[0], h[3]) for h in licenses.fuzzy_spans(page, np.array([0, len(page)]), licenses.NOTICES)[0]] == [("gpl-3.0", 2), ("gpl-2.0", 0)]


def test_repeated_near_notices_take_linear_time():
    import time

    took = []
    for n in (200, 1600):
        raw = b"licensed under the gnu general public license, versoin 7 " * n
        began = time.process_time()
        found = licenses.fuzzy_spans(raw, np.array([0, len(raw)]), licenses.NOTICES)[0]
        took.append(time.process_time() - began)
        assert len(found) >= n
    assert took[1] < 30 * took[0]  # eight times the text; by the square, 64 times


def labelled(spark, n=1200):
    r, bad = random.Random(4), ["grub", "slime", "muck"]
    rows, labels = [], []
    for i in range(n):
        w = [f"w{r.randrange(300)}" for _ in range(40)]
        toxic = i % 5 == 0
        if toxic:
            w[3] = r.choice(bad)
        rows.append((i, " ".join(w)))
        labels.append((i, int(r.random() < 0.8), int(toxic)))
    return fixtures.table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


def test_toxicity_on_held_out_rows(spark):
    docs, labels, rows = labelled(spark)
    chain = toxicity.train(docs, labels.where("doc_id % 3 <> 0"))
    held = {i: t for i, _, t in rows if i % 3 == 0}
    got = {r["doc_id"]: r["toxic"] for r in toxicity.score(docs, chain).where("doc_id % 3 = 0").collect()}
    assert sum(got[i] == bool(t) for i, t in held.items()) / len(held) > 0.98
    kept = toxicity.remove_toxic(docs, chain)
    assert kept.columns == docs.columns and kept.count() == toxicity.score(docs, chain).where("NOT toxic").count()


def test_toxicity_edges(spark):
    docs = fixtures.table(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.score(docs, toxicity.train(docs, none)).where("toxic").count() == 0
    odd = spark.createDataFrame([(1, None, 1), (1, 0, 0), (None, 1, 1), (2, 1, None)], "doc_id long, quality int, toxic int")
    chain = toxicity.train(docs, odd)
    assert toxicity.remove_toxic(fixtures.empty(spark), chain).count() == 0
    assert toxicity.score(fixtures.odd(spark), chain).count() == 7


def test_out_of_fold_chain_feeds_later_categories():
    rows = [{"text_hash": f"{i:04d}", "toxic": int(i % 4 == 0), "quality": int(i % 8 != 0), "buckets": [5] if i % 4 == 0 else [], "fold": i % 3} for i in range(200)]
    chain = toxicity.fit_chain(rows, [[5]] * 4)
    assert [len(chain.weights[c]) for c in toxicity.CATEGORIES] == [2, 3, 4]
    p = chain.scores(np.array([[1.0], [0.0]]))["toxic"]
    assert p[0] > 0.5 > p[1]


def test_features_of_a_fold_come_from_the_others(spark):
    """A word that only one fold's toxic rows hold is no feature for that fold."""
    rows = [(f"{i:04d}", int(i % 2 == 0), 1, ([7] if i % 2 == 0 and i % 5 == 0 else []) + ([9] if i % 2 == 0 else [3]), i % 5) for i in range(400)]
    frame = spark.createDataFrame(rows, "text_hash string, toxic int, quality int, buckets array<int>, fold int")
    assert toxicity.telling_buckets(frame) == [[3, 9], *[[3, 7, 9]] * 5]


def test_labels_of_equal_texts_count_by_their_maximum_and_others_not_at_all(spark):
    docs = fixtures.table(spark, [(1, "same text"), (2, "same text"), (3, "other")])
    labels = spark.createDataFrame([(1, 0, 0), (2, 1, 1), *((i, 1, 1) for i in range(100, 200))], "doc_id long, quality int, toxic int")
    for parts in (1, 3):
        got = toxicity.training_rows(docs.repartition(parts), labels.repartition(parts), most=2).collect()
        assert [(r["toxic"], r["quality"]) for r in got] == [(1, 1)]


def test_the_chain_scores_what_its_weights_say(spark):
    """Brute force: presence of words and stems, one logistic model after another."""
    docs, labels, _ = labelled(spark)
    chain = toxicity.train(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs, chain).collect()}
    for doc, text in [(r["doc_id"], r["text"]) for r in docs.collect()]:
        held = {int(b) for w in words(text or "") for x in {w, w.encode()[: toxicity.STEM].decode("utf-8", "ignore")} for b in toxicity.word_buckets(pa.record_batch([pa.array([x])], ["text"]))[1]}
        x, earlier = [float(b in held) for b in chain.buckets.tolist()], []
        for name in toxicity.CATEGORIES:
            w = chain.weights.get(name)
            z = None if w is None else sum(a * b for a, b in zip([*x, *earlier, 1.0], w))
            earlier.append(chain.rates[name] if w is None else 1 / (1 + np.exp(-np.clip(z, -30, 30))))
            assert abs(got[doc][f"p_{name}"] - earlier[-1]) < 1e-6, (doc, name)
        assert got[doc]["toxic"] == (earlier[-1] >= toxicity.THRESHOLD)


def test_block_max_wand_is_exhaustive():
    r = random.Random(6)
    vocabulary = [f"t{i}" for i in range(60)]
    items = [(i, " ".join(r.choice(vocabulary[: 10 + i % 50]) for _ in range(r.randint(1, 30)))) for i in range(80)]
    df = collections.Counter(int(h) for _, t in items for h in set(decontamination.signed(decontamination.hashed_words(pa.array([t]))[0]).tolist()))
    index = decontamination.build(items, df, len(items), 15.0, 64)
    dense = np.zeros((len(index.terms), len(items)))
    for t in range(len(index.terms)):
        span = slice(index.begin[t], index.begin[t + 1])
        dense[t, index.doc[span]] = index.impact[span]
    assert np.allclose(dense.sum(axis=0), 1)
    for threshold in (0.2, 0.5, 0.9):
        for _ in range(40):
            terms = sorted(r.sample(range(len(index.terms)), r.randint(1, 30)))
            scores = dense[terms].sum(axis=0)
            got = dict(decontamination.block_max_wand(index, terms, threshold))
            assert set(got) == set(np.flatnonzero(scores >= threshold - 1e-9))
            assert all(abs(got[i] - scores[i]) < 1e-9 for i in got)


def test_decontamination(spark, monkeypatch):
    r = random.Random(8)
    vocabulary = [f"v{i}" for i in range(400)]

    def prose(n):
        return " ".join(r.choice(vocabulary) for _ in range(n))

    items = [(i, f"{prose(r.randint(5, 30))}. {prose(r.randint(1, 12))}.") for i in range(30)] + [(30, ""), (31, None), (None, prose(20))]
    docs = [(i, prose(r.randint(0, 400))) for i in range(60)]
    docs += [(100 + i, f"{prose(r.randint(0, 300))} {t.upper()} {prose(r.randint(0, 90))}") for i, t in items if t and i is not None]
    docs += [(200, items[3][1].split(".")[0]), (201, None), (202, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for most in (10_000, 7):
        monkeypatch.setattr(decontamination.indexes, "__defaults__", (most,))
        got = {(x["doc_id"], x["item_id"]) for x in decontamination.find_leaks(fixtures.table(spark, docs), bench).collect()}
        want = set()
        for d, text in docs:
            for i, item in items:
                q, a = decontamination.question_and_answer(item or "")
                inside = [len(words(p)) and " ".join(words(p)) in " ".join(words(text or "")) for p in (q, a)]
                want |= {(d, i)} if all(inside) and " ".join(words(item)) in " ".join(words(text or "")) else set()
        assert want <= got and {d for d, _ in got} == {d for d, _ in want}
        kept = decontamination.remove_leaks(fixtures.table(spark, docs), bench)
        assert sorted(x["doc_id"] for x in kept.collect()) == sorted({d for d, _ in docs} - {d for d, _ in want})
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.find_leaks(fixtures.table(spark), none).count() == 0
    assert decontamination.remove_leaks(fixtures.odd(spark), none).count() == 7
    assert decontamination.remove_leaks(fixtures.empty(spark), bench).count() == 0


def word_edits(part, text):
    """Least edits between ``part`` and any stretch of ``text``, by the textbook's table."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(part, 1):
        below = [i]
        for j, x in enumerate(text, 1):
            below.append(min(row[j] + 1, below[j - 1] + 1, row[j - 1] + (w != x)))
        row = below
    return min(row)


def brute_leaks(docs, items, threshold=0.5, overlap=0.8):
    """BM25 shares, overlaps and edits of every item against every passage."""
    known = [(i, t, words(t)) for i, t in items if t is not None and words(t)]
    n, mean = len(items), sum(len(w) for _, _, w in known) / len(known)
    df = collections.Counter(x for _, _, w in known for x in set(w))
    out = {}
    for i, text, w in known:
        tf = collections.Counter(w)
        impact = {x: np.log1p((n - df[x] + 0.5) / (df[x] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(w) / mean)) for x, c in tf.items()}
        total, half = sum(impact.values()), 64
        while half < len(w):
            half *= 2
        parts = [words(p) for p in decontamination.question_and_answer(text)]
        for row, (d, doc) in enumerate(docs):
            own = words(doc or "")
            for a in range(0, max(len(own), 1), half):
                passage = own[a : a + 2 * half]
                score = sum(impact[x] for x in set(passage) if x in impact) / total
                shares = []
                for p in parts:
                    k = min(5, len(p))
                    grams = {tuple(p[j : j + k]) for j in range(len(p) - k + 1)}
                    held = {tuple(passage[j : j + k]) for j in range(len(passage) - k + 1)}
                    shares.append(max(len(grams & held) / len(grams), 1 - word_edits(p, passage) / len(p)))
                leak = score >= threshold - 1e-9 and min(shares) >= overlap
                if not leak and len(w) * (1 - overlap) >= 1 - 1e-9 and word_edits(w, passage) <= 1:
                    # A part's only word may be replaced, not left out.
                    shorter = [w[:j] + w[j + 1 :] for j in range(len(w))]
                    inside = lambda x: any(passage[j : j + len(x)] == x for j in range(len(passage) - len(x) + 1))
                    only_left_out = min(map(len, parts)) == 1 and any(map(inside, shorter))
                    swapped = any(sum(x != y for x, y in zip(w, passage[j : j + len(w)])) <= 1 for j in range(len(passage) - len(w) + 1))
                    put_in = any(inside(w[:j] + [passage[m]] + w[j:]) for j in range(1, len(w)) for m in range(len(passage)))
                    leak = not only_left_out or swapped or put_in
                if leak and score > out.get((d, i), (-1,))[0]:
                    out[d, i] = (score, a)
    return out


def test_decontamination_against_brute_force(spark, monkeypatch):
    """Long and short items, whole and changed, in parts of any size: the same rows."""
    r = random.Random(12)
    vocabulary = [f"v{i}" for i in range(150)]

    def prose(n):
        return " ".join(r.choice(vocabulary) for _ in range(n))

    items = [(i, f"{prose(r.randint(2, 25))}. {prose(r.randint(1, 9))}.") for i in range(12)] + [(12, f"{prose(70)}. {prose(10)}."), (13, None)]
    docs = [(i, prose(r.randint(0, 150))) for i in range(6)]
    for i, t in items[:13]:
        for edits in (0, 1, 3):
            w = t.split()
            for _ in range(edits):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            docs.append((100 * (i + 1) + edits, f"{prose(r.randint(0, 70))} {' '.join(w)} {prose(r.randint(0, 70))}"))
    want = brute_leaks(docs, items)
    assert len(want) > 13
    bench = spark.createDataFrame(items, "item_id long, text string")
    for most, at_once in ((10_000, 8), (3, 2)):
        monkeypatch.setattr(decontamination.indexes, "__defaults__", (most,))
        monkeypatch.setattr(decontamination, "AT_ONCE", at_once)
        got = {(x["doc_id"], x["item_id"]): x for x in decontamination.find_leaks(fixtures.table(spark, docs), bench).collect()}
        assert got.keys() == want.keys()
        assert all(abs(got[k]["score"] - v[0]) < 1e-6 for k, v in want.items())


def test_items_with_one_word_changed_are_leaks():
    r = random.Random(9)
    vocabulary = [f"v{i}" for i in range(400)]

    def prose(n):
        return " ".join(r.choice(vocabulary) for _ in range(n))

    items = [(i, f"{prose(4 + i)}. {prose(1 + i % 7)}.") for i in range(28)] + [(28, f"{prose(9)}. {prose(6)}. . ."), (29, prose(5))]
    df = collections.Counter(w for _, t in items for w in set(decontamination.signed(decontamination.hashed_words(pa.array([t]))[0]).tolist()))
    index = decontamination.build(items, df, len(items), 20.0, 64)
    docs, want = [], set()
    for i, text in items:
        plain = words(text)
        changed = [plain[:at] + ["other"] + plain[at + 1 :] for at in range(len(plain))]
        changed += [plain[:at] + ["other"] + plain[at:] for at in range(len(plain))]
        if 1 + i % 7 > 1:
            changed += [plain[:at] + plain[at + 1 :] for at in range(len(plain))]
        for found in (plain, *changed):
            want.add((len(docs), i))
            docs.append(f"{prose(r.randint(0, 90))} {' '.join(found)} {prose(r.randint(0, 90))}")
        if i < 28:
            docs += [text.split(".")[0], text.split(".")[1], prose(200), " ".join(r.sample(plain, len(plain)))]
    got = decontamination.leaks(pa.record_batch([pa.array(docs)], ["text"]), index, 0.5, 0.8)
    assert {(row, item) for row, item, *_ in got} == want


PAGES = [(1, "http://a/1", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "http://a/ b\r\n", None), (4, "u", ""), (5, "u", "é" * 5000)]
PAGES += [(None, "u", "<p>x</p>"), (6, "u", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n"), (6, "u", "other"), (7, "u", "seven"), (7, "u", "seven")]


@pytest.mark.parametrize(("roll", "least", "heavy", "shard"), [(32 << 20, 0, 9, 1 << 20), (1, 0, 1, 1 << 20), (700, 6, 0, 2000), (700, 0, 1, 2000)])
def test_warc_round_trip(spark, tmp_path, monkeypatch, roll, least, heavy, shard):
    """With all shared payloads broadcast, some, and none; with one shard and several."""
    monkeypatch.setattr(warc.decide, "__defaults__", (heavy,))
    monkeypatch.setattr(warc, "SHARD_BYTES", shard)
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)
    path = f"file://{tmp_path}/out"
    files = warc.write_archives(pages, path, min_bytes=least, roll_bytes=roll)
    rows = warc.read_archives(spark, path).collect()
    assert len(rows) == len(PAGES) and all(r["intact"] is not False for r in rows)
    winner = {}
    for i, _, html in PAGES:
        raw = (html or "").encode()
        if len(raw) >= least:
            winner[raw] = max(winner.get(raw, -1), i if i is not None else -1)
    want = collections.Counter()
    for i, _, html in PAGES:
        raw = (html or "").encode()
        again = raw in winner and winner[raw] != i
        want[i, len(raw), warc.base32(__import__("hashlib").sha1(raw).digest()), "revisit" if again else "response", winner[raw] if again else None] += 1
    assert collections.Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows) == want
    assert {bytes(r["payload"]) for r in rows if r["record_type"] == "response"} == {(h or "").encode() for _, _, h in PAGES}
    assert (files.count() > 3) == (roll < 1000)
    names = sorted(p.name for p in (tmp_path / "out").glob("*.gz"))
    assert names == sorted(r["name"] for r in files.collect())
    first = {p.name: p.read_bytes() for p in (tmp_path / "out").glob("*.gz")}
    warc.write_archives(pages.repartition(1), f"file://{tmp_path}/again", min_bytes=least, roll_bytes=roll)
    assert {p.name: p.read_bytes() for p in (tmp_path / "again").glob("*.gz")} == first


def test_warc_of_no_pages(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archives(pages, f"file://{tmp_path}/none")
    assert warc.read_archives(spark, f"file://{tmp_path}/none").count() == 0
