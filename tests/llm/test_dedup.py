import pathlib
import time
import collections
import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docsieve.llm import exact_dedup, jaccard_join, passage_dedup, suffix_dedup
from docsieve.llm.components import components

from . import fixtures


def brute_windows(rows, window):
    """What goes of (id, units) rows in order: a flag for each unit."""
    seen, out = set(), {}
    for doc, units in rows:
        gone = [False] * len(units)
        for i in range(len(units) - window + 1):
            w = tuple(units[i : i + window])
            if w in seen:
                gone[i : i + window] = [True] * window
            seen.add(w)
        out[doc] = gone
    return out


def test_passages_across_chunks_without_ansi(spark):
    rows = [(i, f"{' '.join(f'own{i}x{j}' for j in range(30))} {fixtures.PASSAGE}") for i in range(4)]
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        docs = fixtures.table(spark, rows).repartitionByRange(4, "doc_id")
        assert sorted(r["n_removed"] for r in passage_dedup.remove_passages(docs).collect()) == [0, 60, 60, 60]
        assert sorted(r["n_removed"] > 0 for r in suffix_dedup.remove_substrings(docs).collect()) == [False, True, True, True]
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")


def test_exact_dedup(spark):
    groups = collections.defaultdict(list)
    for doc, text in fixtures.texts():
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(doc)
    want = {d: (min(g), len(g), d == min(g), hashlib.sha256(t.encode()).digest()) for t, g in groups.items() for d in g}
    for share in (1 / 512, 1 / 20):  # with the latter, some texts are heavy hitters
        got = exact_dedup.duplicate_groups(fixtures.table(spark), share=share).collect()
        assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], bytes(r["digest"])) for r in got} == want
        kept = exact_dedup.exact_dedup(fixtures.table(spark), share=share)
        assert kept.columns == fixtures.table(spark).columns
        assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, v in want.items() if v[2])


def test_exact_dedup_heavy_hitters_are_found(spark):
    rows = fixtures.table(spark, [(i, "hot" if i % 3 == 0 else f"text {i}") for i in range(3000)]).repartition(7)
    slim = exact_dedup.digested(rows).select("doc_id", "digest")
    found = exact_dedup.frequent(slim, 1 / 10).collect()
    assert [(r["keep_id"], r["group_size"]) for r in found] == [(0, 1000)]
    assert exact_dedup.exact_dedup(rows, share=1 / 10).count() == 2001


def test_exact_dedup_of_frequent_rows_without_ids(spark):
    rows = fixtures.table(spark, [(None, "hot")] * 300 + [(5, "warm")] * 200 + [(i, f"text {i}") for i in range(500)]).repartition(5)
    assert exact_dedup.exact_dedup(rows, share=1 / 10).count() == 502
    got = exact_dedup.duplicate_groups(rows, share=1 / 10).where("group_size > 1")
    counts = {(r["keep_id"], r["group_size"], r["kept"]): r["count"] for r in got.groupBy("keep_id", "group_size", "kept").count().collect()}
    assert counts == {(None, 300, True): 1, (None, 300, False): 299, (5, 200, True): 1, (5, 200, False): 199}


@pytest.mark.parametrize("window", [100, 24])
def test_suffix_dedup(spark, window):
    rows = [(d, (t or "").encode()) for d, t in fixtures.texts()]
    gone = brute_windows(rows, window)
    got = {r["doc_id"]: r for r in suffix_dedup.remove_substrings(fixtures.table(spark), window=window, gram=min(32, window // 2)).collect()}
    for doc, raw in rows:
        flags = "".join("01"[g] for g in gone[doc])
        kept = bytes(b for b, g in zip(raw, gone[doc]) if not g)
        want = (len(raw), sum(gone[doc]), len(re.findall("1+", flags)), kept)
        assert (got[doc]["n_bytes"], got[doc]["n_removed"], got[doc]["n_spans"], bytes(got[doc]["kept"])) == want, doc


def test_multikey_quicksort_ties_over_the_depth():
    r = np.random.default_rng(4)
    text = r.integers(97, 99, 3000).astype(np.uint8)
    at, group = r.integers(0, 2900, 800), r.integers(0, 3, 800).astype(np.uint64)
    chosen, tied = suffix_dedup.shallow_sort(text, at, group, 16)
    want = collections.defaultdict(list)
    for i in range(800):
        want[int(group[i]), text[at[i] : at[i] + 16].tobytes()].append(i)
    got = collections.defaultdict(list)
    for i, g in zip(chosen.tolist(), tied.tolist()):
        got[g].append(i)
    assert sorted(got.values()) == sorted(v for v in want.values() if len(v) > 1)


def test_nothing_is_removed_without_the_methods_own_decision(spark, monkeypatch):
    """With a sort that ties nothing, and an automaton without phrases, all but whole copies stays."""
    monkeypatch.setattr(suffix_dedup, "tied_suffixes", lambda text, at, group, window=100: np.zeros(len(at), bool))
    docs = fixtures.table(spark).where("doc_id in (24, 25, 26)").repartition(1)
    find = suffix_dedup.earlier(100)
    rows = pa.table({"route": [1, 1], "off": [3, 3], "count": [1, 1], "bytes": [b"x" * 100] * 2})
    assert not len(find(rows)[0]) and docs.count() == 3
    batch = pa.record_batch([pa.array([fixtures.PASSAGE] * 2)], ["text"])
    from docsieve.llm.repeats import Sequence, Unit

    found = Sequence(batch, Unit(20, 8, True, 1 << 20))
    phrase = " ".join(fixtures.PASSAGE.split()[5:13]).encode()
    assert np.flatnonzero(passage_dedup.located(passage_dedup.compiled({phrase: False}), found)).tolist() == [5, 65]
    assert not passage_dedup.located(passage_dedup.compiled({b"another phrase": False}), found).any()


def test_windows_are_only_those_around_what_the_automata_report(spark):
    from docsieve.llm.repeats import Unit

    unit = Unit(20, 8, True, 1 << 20)
    rows = fixtures.table(spark, [(1, fixtures.PASSAGE), (2, f"own words {fixtures.PASSAGE}")]).select("doc_id", "text")
    keys = rows.select(F.col("doc_id").alias("key"), "text").repartition(1)
    none = F.array().cast("array<binary>")
    assert passage_dedup.window_pieces(keys.withColumns({"cold": none, "hot": none}), unit).count() == 0
    found = passage_dedup.confirmed_phrases(keys.join(passage_dedup.recurring_anchors(keys, unit), "key"), unit)
    phrases = sorted({bytes(p) for r in found.collect() for p in r["cold"]})
    words = fixtures.PASSAGE.split()
    assert phrases and all(p.decode() in fixtures.PASSAGE and len(p.split()) == 8 for p in phrases)
    one = F.array(F.lit(bytearray(phrases[0])))
    at = words.index(phrases[0].split()[0].decode())
    pieces = passage_dedup.window_pieces(keys.withColumns({"cold": one, "hot": none}), unit).where("key = 1").collect()
    assert pieces and all(at - 12 <= p["start"] and p["start"] + p["count"] - 1 <= at for p in pieces)


def test_occurrences_come_from_the_automata_alone(spark, monkeypatch):
    """Run as a whole with automata that report nothing, the deduplication removes whole copies only; with one phrase, its windows only."""
    docs = [(1, f"{fixtures.PASSAGE} one"), (2, f"two {fixtures.PASSAGE}"), (3, f"{fixtures.PASSAGE} one"), (4, "short text")]

    def removed():
        return {r["doc_id"]: r["n_removed"] for r in passage_dedup.remove_passages(fixtures.table(spark, docs)).collect()}

    assert removed() == {1: 0, 2: 60, 3: 61, 4: 0}
    located = passage_dedup.located
    with monkeypatch.context() as m:
        m.setattr(passage_dedup, "located", lambda automaton, found: np.zeros(len(found.starts), np.int8))
        assert removed() == {1: 0, 2: 0, 3: 61, 4: 0}

    def only_first(automaton, found):
        hit = located(automaton, found)
        for a, b in zip(found.bounds[:-1].tolist(), found.bounds[1:].tolist()):
            places = np.flatnonzero(hit[a:b])
            hit[a + places[1:]] = 0
        return hit

    with monkeypatch.context() as m:
        m.setattr(passage_dedup, "located", only_first)
        some = removed()
        assert some[3] == 61 and 0 < some[2] < 60


def test_windows_with_one_hash_and_other_words_are_told_apart(monkeypatch):
    monkeypatch.setattr(passage_dedup, "mix", lambda x: np.zeros(len(x), np.uint64))
    words = np.array([1, 2, 3, 1, 2, 4, 1, 2, 3])
    got = passage_dedup.repeated(words, np.array([0, 3, 6]), np.zeros(3, np.int64), 3)
    assert got.tolist() == [False, False, True]


@pytest.mark.parametrize("words", [True, False])
def test_long_texts_are_hashed_in_blocks(monkeypatch, words):
    from docsieve.llm import hashing, repeats

    text = " ".join(f"w{i * 7919 % 1000}" for i in range(4000))
    batch = pa.record_batch([pa.array([text, "", text[500:]])], ["text"])
    unit = repeats.Unit(20, 8, words, 1 << 20)

    def windows():
        found = repeats.Sequence(batch, unit)
        run, start = found.windows(np.arange(len(found.first)))
        return dict(zip(start.tolist(), zip(found.anchor[run].tolist(), found.place[run].tolist())))

    whole = windows()
    monkeypatch.setattr(hashing, "BLOCK", 333)
    assert windows() == whole


def test_blind_trie_ties_are_equal_strings():
    import random

    r = random.Random(3)
    strings = [bytes(r.choice(b"ab") for _ in range(6)) for _ in range(300)]
    trie, first = suffix_dedup.BlindTrie(strings), {}
    for i, s in enumerate(strings):
        assert trie.insert(i) == first.setdefault(s, i)


def test_passage_dedup(spark):
    rows = [(d, re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for d, t in fixtures.texts()]
    gone = brute_windows(rows, 20)
    got = {r["doc_id"]: r for r in passage_dedup.remove_passages(fixtures.table(spark)).collect()}
    for doc, words in rows:
        kept = b" ".join(w for w, g in zip(words, gone[doc]) if not g).decode()
        assert (got[doc]["n_words"], got[doc]["n_removed"], got[doc]["kept"]) == (len(words), sum(gone[doc]), kept), doc


def test_hot_anchors_are_routed_by_window(spark, monkeypatch):
    from docsieve.llm import repeats

    monkeypatch.setattr(repeats, "HOT", 2)
    monkeypatch.setattr(repeats, "SALTS", 2)
    test_passage_dedup(spark)
    test_suffix_dedup(spark, 100)


def brute_join(rows, rule):
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    sets = {}
    for d, t in rows:
        w = (t or "").encode().translate(low).split()
        sets[d] = {tuple(w)} if 0 < len(w) < rule.k else {tuple(w[i : i + rule.k]) for i in range(len(w) - rule.k + 1)}
    links = {a: {b for b in sets if b != a and sets[a] and sets[b] and rule.linked(len(sets[a]), len(sets[b]), len(sets[a] & sets[b]))} for a in sets}
    out = {}
    for a in sets:
        reach, todo = {a}, [a]
        while todo:
            new = links[todo.pop()] - reach
            reach |= new
            todo += new
        out[a] = (len(sets[a]), min(reach), len(links[a]))
    return out


@pytest.mark.parametrize(("near", "block", "rule"), [(0.3, 256, (3, 90)), (0.0, 3, (3, 90)), (9.0, 2, (5, 80)), (0.3, 4, (1, 60))])
def test_jaccard_join(spark, monkeypatch, near, block, rule):
    """With a leader wherever there is a list, with none, and in between."""
    import random

    monkeypatch.setattr(jaccard_join, "NEAR_LEADER", near)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    r, rows = random.Random(5), fixtures.texts()
    base = rows[20][1].split()
    for i in range(40):  # near copies of a text, and of each other, more or less
        w = list(base)
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = f"new{r.randrange(5)}"
        rows.append((100 + i, " ".join(w)))
    rule = jaccard_join.Rule(*rule)
    got = jaccard_join.jaccard_join(fixtures.table(spark, rows), rule).collect()
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"], x["n_links"]) for x in got} == brute_join(rows, rule)
    kept = jaccard_join.one_of_each(fixtures.table(spark, rows), rule)
    assert sorted(x["doc_id"] for x in kept.collect()) == sorted(d for d, v in brute_join(rows, rule).items() if v[1] == d)


def test_position_blocks_skip_what_cannot_link():
    r = np.random.default_rng(2)
    rule = jaccard_join.Rule(3, 90)
    rows = []
    for t in r.integers(0, 4, 600).tolist():
        lo = int(r.integers(5, 80))
        hi = lo + int(r.integers(0, 3)) * int(r.integers(0, 2))
        pos = int(r.integers(0, rule.prefix(lo)))
        rows.append((t, lo, max(hi, pos + 1 + hi - pos - 1), pos, hi))
    rows.sort()
    t = dict(zip(jaccard_join.ORDERED, np.array(rows).T))
    want = set()
    for i, (ti, li, ri, pi, hi) in enumerate(rows):
        for j in range(i + 1, 600):
            tj, lj, rj, pj, _ = rows[j]
            bound = min(pi, pj) + 1 + min(ri - pi - 1, rj - pj - 1)
            if ti == tj and 100 * hi >= 90 * lj and bound >= rule.overlap(li, lj):
                want.add((i, j))
    got = [p for a, b in jaccard_join.unskipped(t, rule, 0, most=50) for p in zip(a.tolist(), b.tolist())]
    assert set(got) == want and len(got) == len(want)
    in_size = sum(rows[i][0] == rows[j][0] and 100 * rows[i][4] >= 90 * rows[j][1] for i in range(600) for j in range(i + 1, 600))
    assert len(got) < 0.9 * in_size  # so many pairs that the lists' order by size alone leaves
    assert {p for p in got if p[1] >= 300} == {p for a, b in jaccard_join.unskipped(t, rule, 300) for p in zip(a.tolist(), b.tolist())}


def test_pairs_of_a_long_list_are_held_in_parts():
    """The pairs of a list grow with its square, and so did what a task held of them."""
    r = np.random.default_rng(4)
    m, rule = 400, jaccard_join.Rule(5, 80)
    t = {"token": r.integers(0, 2, m), "lo": np.full(m, 40), "hi": np.full(m, 40), "pos": r.integers(0, 4, m), "reach": np.full(m, 40)}
    t |= {"class": r.integers(0, 300, m), "group": np.zeros(m, np.int64), "grouped": np.zeros(m, bool)}
    t = {c: v[np.lexsort([t[o] for o in jaccard_join.ORDERED][::-1])] for c, v in t.items()}
    parts = list(jaccard_join.met_pairs(t, rule, 0, most=1000))
    assert len(parts) > 10 and max(p.shape[1] for p in parts) < 3000
    whole = list(jaccard_join.met_pairs(t, rule, 0, most=1 << 40))
    assert len(whole) == 1

    def pairs(found):
        return {(x, y) for p in found for x, y in zip(p[0].tolist(), p[1].tolist())}

    met = list(jaccard_join.unskipped(t, rule, 0))
    want = {tuple(sorted(p)) for a, b in met for p in zip(t["class"][a].tolist(), t["class"][b].tolist()) if p[0] != p[1]}
    assert pairs(parts) == pairs(whole) == want


def test_members_are_answered_through_their_leader(spark):
    """A group's members have no entries in the lists that their leader heads, and links beyond the group are derived."""
    r = np.random.default_rng(3)
    base = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(int(r.integers(0, 9))):
            w[int(r.integers(0, 400))] = f"n{int(r.integers(0, 50))}"
        rows.append((i, " ".join(w)))
    far = list(base)
    far[::26] = [f"z{i}" for i in range(len(far[::26]))]  # near some members only
    rows += [(100 + k, " ".join([*far[: 400 - k], *(f"q{k}{j}" for j in range(k))])) for k in range(4)]
    rule = jaccard_join.Rule(3, 80)
    docs = fixtures.table(spark, rows)
    from docsieve.llm.common import keyed

    keys = keyed(docs)
    order = jaccard_join.order_of(jaccard_join.survey(keys, rule))
    lists = jaccard_join.shared_lists(jaccard_join.postings(keys, rule, order), rule).cache()
    led = jaccard_join.leaders(lists, rule)
    entries = jaccard_join.grouped_entries(lists, led)
    assert led.count() > 30 and entries.count() < lists.count() / 4
    got = jaccard_join.jaccard_join(docs, rule).collect()
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"], x["n_links"]) for x in got} == brute_join(rows, rule)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (300, 200), (7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 200: 100, 300: 100}


@pytest.mark.parametrize(
    ("run", "rows"),
    [
        (exact_dedup.duplicate_groups, 7),
        (exact_dedup.exact_dedup, 4),
        (suffix_dedup.remove_substrings, 7),
        (passage_dedup.remove_passages, 7),
        (jaccard_join.jaccard_join, 7),
        (jaccard_join.one_of_each, 4),
    ],
)
def test_odd_and_empty_tables(spark, run, rows):
    assert run(fixtures.odd(spark)).count() == rows
    assert run(fixtures.empty(spark)).count() == 0


def test_repeated_rows_are_documents_in_order(spark):
    got = passage_dedup.remove_passages(fixtures.odd(spark)).where("n_words = 60").collect()
    assert sorted(r["n_removed"] for r in got) == [0, 60]


def test_jaccard_join_keeps_no_dead_shuffles(spark, monkeypatch):
    """Where nothing is small enough to broadcast, the shuffles of tables that were cut don't pile up; the links are the same."""
    texts = [" ".join(f"w{g}x{(i * 7) % (40 + g)}" if i != j else f"v{j}" for i in range(60)) for g in range(6) for j in range(8)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted(jaccard_join.jaccard_join(docs).collect())
    places = [str(d) for d in spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs()]

    def kept():
        return {int(f.name.split("_")[1]) for d in places for f in pathlib.Path(d).rglob("shuffle_*.data")}

    last, left, made, ended = max(kept()), [], [], jaccard_join.components

    def at_the_end(edges):
        now, until = kept() or {0}, time.time() + 5
        made.append(max(max(now) - last, 0))
        while 4 * len({i for i in now if i > last}) > made[0] and time.time() < until:
            time.sleep(0.1)
            now = kept() or {0}
        left.append(len({i for i in now if i > last}))
        return ended(edges)

    monkeypatch.setattr(jaccard_join, "joinable", lambda df: df)
    monkeypatch.setattr(jaccard_join, "components", at_the_end)
    assert sorted(jaccard_join.jaccard_join(docs).collect()) == want
    assert any(row["n_links"] for row in want)
    assert 4 * left[0] <= made[0], (left, made)


def test_only_texts_that_are_read_are_shuffled(spark, monkeypatch):
    """Where the wanted classes, or the rows that go, are too many to broadcast, the other texts stay where they are."""
    import random

    r = random.Random(9)
    texts = ["".join(r.choices("abcdefghijklmnop ", k=2000)) for _ in range(300)]
    docs = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "key long, doc_id long, text string")
    classes = spark.createDataFrame([(i, 1, None, False, True, i) for i in range(0, 300, 60)], "class long, size long, leader long, leads boolean, met boolean, key long")
    none = np.zeros(0, np.uint64)
    order = jaccard_join.Order(none, np.zeros(0, np.float32), 0.0, none)
    places = [str(d) for d in spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs()]

    def moved(run):
        def there():
            return {f.name: f.stat().st_size for d in places for f in pathlib.Path(d).rglob("shuffle_*.data")}

        before = there()
        return run(), sum(v for k, v in there().items() if k not in before)

    monkeypatch.setattr(jaccard_join, "joinable", lambda df: df)
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sets, size = moved(lambda: jaccard_join.token_sets(docs, classes, jaccard_join.Rule(), order).collect())
        assert sorted(row["class"] for row in sets) == list(range(0, 300, 60))
        assert size < 600_000 / 4  # of 2,000 bytes each, these hold about half when compressed
        twice = docs.unionByName(docs.limit(4).selectExpr("key + 1000 AS key", "doc_id + 1000 AS doc_id", "text")).cache()
        twice.count()
        monkeypatch.setattr(jaccard_join, "joined", lambda rows, rule: twice.selectExpr("key", "key % 1000 AS component_key"))
        kept, size = moved(lambda: jaccard_join.one_of_each(twice).collect())
        assert sorted(row["doc_id"] for row in kept) == list(range(300))
        assert size < 600_000 / 4
        twice.unpersist()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)
