"""Whitening, line deduplication and periodic runs against brute force, and the cases that they define."""

import collections
import fractions
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from docsieve.llm import line_dedup, periodic_runs, queries, whitening

from . import fixtures

FOLDER = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int, vector string, component string, n string, at string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1, "x", "x", "x", "x") for i, v in rows], VECTORS).repartition(3)


def brute_whitening(rows, k):
    """By a dense eigenvalue decomposition, with whole numbers where results are exact."""
    d = max((len(v) for _, v in rows if v is not None), default=0)
    fine = [(i, v) for i, v in rows if v is not None and len(v) == d and all(c is not None and np.isfinite(np.float32(c)) for c in v)]
    x = np.array([[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for _, v in fine], object)
    n, total = len(x), x.sum(0)
    deviation = ((n * x - total) ** 2).sum(1)
    centred = np.array(x - total // n, float) - np.array(total % n, float) / n
    values, turn = np.linalg.eigh(centred.T @ centred / n)
    values, turn = values[::-1][:k], turn[:, ::-1][:, :k]
    return [i for i, _ in fine], deviation, centred @ turn / np.sqrt(values), values / ((centred**2).sum() / n)


def check_whitening(found, rows, k):
    ids, deviation, whitened, explained = brute_whitening(rows, k)
    got = collections.defaultdict(dict)
    for r in found.collect():
        got[r["vec_id"]][r["component"]] = r
    assert sorted(got) == sorted(ids) and all(sorted(g) == list(range(1, k + 1)) for g in got.values())
    ours = np.array([[got[i][c]["whitened"] for c in range(1, k + 1)] for i in ids])
    signs = np.sign((ours * whitened).sum(0))
    assert np.abs(ours * signs - whitened).max() < 1e-6
    for i, want in zip(ids, deviation):
        assert all(r["deviation"] == want and r["n"] == len(ids) for r in got[i].values())
    some = got[ids[0]]
    assert np.allclose([some[c]["explained"] for c in range(1, k + 1)], explained, rtol=1e-9)
    assert len({r["identity_error"] for g in got.values() for r in g.values()}) == 1 and some[1]["identity_error"] < 1e-9
    return some[1]


def test_op11(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    check_whitening(queries.QUERIES["op11_whitening"](spark, FOLDER), rows, 32)


def test_iteration_certifies_steep_and_flat_spectra(spark):
    r = np.random.default_rng(3)
    scales = 8.0 * 0.7 ** np.arange(40)
    steep = [(i, v) for i, v in enumerate(r.standard_normal((400, 40)) * scales)]
    one = check_whitening(whitening.whiten(vectors(spark, steep), 5, block=8), steep, 5)
    assert one["passes"] > 2 and one["residual"] <= whitening.TOLERANCE
    flat = [(i, v) for i, v in enumerate(r.standard_normal((400, 40)))]
    assert check_whitening(whitening.whiten(vectors(spark, flat), 5, block=8), flat, 5)["residual"] < 1e-12


def test_whitening_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1, 2, 3]), (None, [4, 0, 1]), (2, [1, 2, 3]), (2, [0, 5, -3]), (3, None), (4, [1, None, 2]), (5, [nan, 1, 1]), (6, [inf, 0, 0]), (7, []), (8, [1, 2])]
    kept = [(i, v) for i, v in rows if i in (1, None, 2)]
    got = whitening.whiten(vectors(spark, rows), 32).collect()
    want = brute_whitening(kept, 2)
    assert sorted((str(r["vec_id"]), int(r["deviation"])) for r in got) == sorted((str(i), int(d)) for i, d in zip(want[0], want[1]) for _ in range(2))
    assert whitening.whiten(vectors(spark, [(1, [2, 2]), (2, [2, 2])])).count() == 0  # no variance
    assert whitening.whiten(vectors(spark, [(1, None)])).count() == 0
    assert whitening.whiten(vectors(spark, [])).count() == 0
    huge = [(i, [(-1) ** i * 1e9 * (i + 1), i]) for i in range(6)]
    assert {int(r["deviation"]) for r in whitening.whiten(vectors(spark, huge)).collect()} == set(brute_whitening(huge, 2)[1])


def brute_lines(docs, documents=10, least=1, keep_first=False):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    found = collections.defaultdict(set)
    for at, (_, text) in enumerate(docs):
        for line in text.split("\n"):
            found[key(line)].add(at)
    seen, out = set(), []
    for doc, text in docs:
        kept, lines = [], text.split("\n")
        for line in lines:
            k = key(line)
            common = len(k) >= least and len(found[k]) >= documents
            if not common or (keep_first and k not in seen):
                kept.append(line)
            seen.add(k)
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_op12(spark):
    docs = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect())
    want = {(d, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for d, n, gone, kept in brute_lines(docs)}
    assert {tuple(r) for r in queries.QUERIES["op12_line_dedup"](spark, FOLDER).collect()} == want


@pytest.mark.parametrize("partitions", [1, 7, 40])
@pytest.mark.parametrize("keep_first", [False, True])
def test_lines_over_many_ranges(spark, partitions, keep_first):
    """A line in most documents, often repeated, is spread over ranges; lines with just enough documents and one too few."""
    r = random.Random(5)
    docs = []
    for i in range(300):
        lines = [f"own {i} {j}" for j in range(3)] + ["  Very COMMON\t"] * r.randint(0, 4) + ["", " "]
        lines += [f"line {j}" for j in range(60) if r.random() < 0.033] + ["ÄÖ", "äö"] * (i % 37 == 0)
        r.shuffle(lines)
        docs.append((i, "\n".join(lines)))
    docs += [(300, ""), (301, "\n"), (302, "very common"), (303, "\r\nVERY common\r\nx")]
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = line_dedup.drop_lines(fixtures.table(spark, docs), keep_first=keep_first).collect()
        assert sorted(tuple(x) for x in got) == brute_lines(docs, keep_first=keep_first)
        assert len({x[2] for x in brute_lines(docs, keep_first=keep_first)}) > 3
        maps = line_dedup.keep_bitmaps(fixtures.table(spark, docs), keep_first=keep_first).collect()
        for x in maps:
            lines = docs[x["doc_id"]][1].split("\n")
            stays = line_dedup.unpacked(x["keep"], x["n_lines"])
            assert len(lines) == x["n_lines"] == len(stays) and int((~stays).sum()) == x["n_dropped"]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_line_streams_in_small_batches():
    """Whatever the batches and ranges, the streams' decisions are those of the whole."""
    import pyarrow as pa

    r = random.Random(11)
    rows = sorted((h, h + 1, r.randint(0, 30), p) for h in range(12) for p in range(r.choice([1, 5, 80])))
    schema = pa.schema([("high", pa.int64()), ("low", pa.int64()), ("key", pa.int64()), ("pos", pa.int32())])
    for keep_first in (False, True):
        for _ in range(60):
            own = line_dedup.Range(3, 6, keep_first)
            at, out = 0, []
            while at < len(rows):
                n = r.randint(1, 40)
                out += own.block(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[at : at + n]), schema)], schema=schema))
                at += n
            out += own.end()
            got = [x for b in out for x in b.to_pylist()]
            edge = {rows[0][0], rows[-1][0]}
            documents = collections.defaultdict(set)
            for h, _, key, _ in rows:
                documents[h].add(key)
            first = {}
            for row in rows:
                first.setdefault(row[0], row)
            want = {row for row in rows if row[0] != rows[0][0] and len(documents[row[0]]) >= 6 and not (keep_first and first[row[0]] == row)}
            assert {(x["high"], x["low"], x["key"], x["pos"]) for x in got if x["kind"] == line_dedup.GOES} == want
            borders = {x["high"]: (x["key"], x["last"], x["documents"]) for x in got if x["kind"] == line_dedup.BORDER}
            assert borders == {h: (min(documents[h]), max(documents[h]), len(documents[h])) for h in edge}
            opened = {(x["high"], x["low"], x["key"], x["pos"]) for x in got if x["kind"] == line_dedup.OPEN}
            assert opened == {row for row in rows if row[0] in edge} - {row for row in rows if row[0] != rows[0][0] and len(documents[row[0]]) >= 6}


def test_line_cases(spark):
    assert line_dedup.drop_lines(fixtures.empty(spark)).count() == 0
    odd = sorted(map(str, line_dedup.drop_lines(fixtures.odd(spark), documents=3).collect()))
    want = [(None, 1, 1, ""), (None, 1, 0, ""), (1, 1, 1, ""), (1, 1, 1, ""), (1, 1, 0, "gamma"), (2, 1, 0, fixtures.PASSAGE), (2, 1, 0, fixtures.PASSAGE)]
    assert odd == sorted(f"Row(doc_id={d}, n_lines={n}, n_dropped={g}, kept={k!r})" for d, n, g, k in want)
    docs = [(d, t or "") for d, t in fixtures.texts()]
    assert sorted(tuple(x) for x in line_dedup.drop_lines(fixtures.table(spark), documents=2).collect()) == brute_lines(docs, 2)


def brute_runs(words):
    """By the definition: for each lag, stretches of words that match; a period must be the smallest one."""
    n, out = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(24, 3 * q) and not any(all(words[m] == words[m + p] for m in range(i, i + length - p)) for p in range(1, q)):
                out.append((i, length, q))
            i = j
    return sorted(out, key=lambda x: (x[0], x[2]))


def numbers(words):
    known = {}
    return np.array([known.setdefault(w, len(known)) for w in words], np.int32)


def cases():
    r = random.Random(2)
    yield ["a"] * 500
    yield ["a"] * 23
    yield ["a"] * 24
    yield list("ab" * 100 + "c" + "abab" * 30 + "ab")
    yield list("abc" * 7) + list("abc") + list("xyzxy" * 12)
    for size in (1, 2, 3, 20):
        yield [r.randint(0, size) for _ in range(700)]
    for _ in range(60):
        words = []
        while len(words) < 400:
            block = [r.randint(0, 3) for _ in range(r.randint(1, 30))]
            words += block * r.choice([1, 1, 2, 3, 4, 9]) + block[: r.randint(0, len(block))]
        yield words
    fib = ["a"], ["a", "b"]
    while len(fib[1]) < 600:
        fib = fib[1], fib[1] + fib[0]
    yield fib[1] * 4


def test_runs_against_the_definition():
    found = 0
    for words in cases():
        want = brute_runs(words)
        assert periodic_runs.find_runs(numbers(words)) == want
        found += len(want)
    assert found > 100


def test_lag_counts_are_exact():
    r = random.Random(3)
    for n, size in ((30, 2), (1000, 3), (1000, 100), (5000, 40), (5000, 4000)):
        codes = numbers([min(r.randint(0, size), r.randint(0, size)) for _ in range(n)])
        lags = n // 3
        want = [0] + [int((codes[q:] == codes[:-q]).sum()) for q in range(1, lags + 1)]
        assert periodic_runs.lag_counts(codes, lags).tolist() == want


def test_one_word_of_many_places_is_quick():
    assert periodic_runs.find_runs(np.zeros(1_000_000, np.int32)) == [(0, 1_000_000, 1)]
    codes = np.random.default_rng(1).integers(0, 2, 200_000).astype(np.int32)
    assert all(length >= 3 * q for _, length, q in periodic_runs.find_runs(codes))


def digests(doc, words):
    runs = brute_runs(words)
    best = min(runs, key=lambda x: (-fractions.Fraction(x[1], x[2]), x[0], x[2])) if runs else None
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    lines = "".join(f"{a},{n},{q}\n" for a, n, q in runs)
    one = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc, len(runs), *one, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def altered(doc, text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    h = zlib.crc32(str(doc).encode())
    g, n = h // 10, len(words)
    if doc is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def test_op13(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect() if len(r["text"] or "") < 10_000]
    got = {r["doc_id"]: tuple(r) for r in queries.QUERIES["op13_periodic_runs"](spark, FOLDER).collect()}
    want = {d: digests(d, altered(d, t)) for d, t in docs}
    assert {d: got[d] for d in want} == want
    assert sum(x[1] > 0 for x in want.values()) > 5


def test_run_cases(spark):
    made = periodic_runs.summaries(periodic_runs.periodic_runs(fixtures.odd(spark)))
    want = [digests(d, (t or "").encode().split()) for d, t in [(None, "alpha beta"), (None, None), *[(1, "alpha beta")] * 2, (1, "gamma"), *[(2, fixtures.PASSAGE)] * 2]]
    assert sorted(map(str, (tuple(x) for x in made.collect()))) == sorted(map(str, want))
    assert periodic_runs.periodic_runs(fixtures.empty(spark)).count() == 0
    long = "many words here " * 40_000 + "and an end"
    row = periodic_runs.periodic_runs(fixtures.table(spark, [(1, long), (2, "x " * 30)])).orderBy("doc_id").collect()
    assert row[0]["kept"] == "many words here and an end" and (row[0]["starts"], row[0]["lengths"], row[0]["periods"]) == ([0], [120_000], [3])
    assert row[1]["kept"] == "x" and row[1]["n_words"] == 30
