"""Folds, spans, schemas, lexicons, layouts, sections and small-sample statistics, by value."""

import json
import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from docsieve.functions import spans, stats
from docsieve.functions import text as tx
from docsieve.operators import layout, lexicon, sections
from docsieve.operators import matching as mt
from docsieve.operators.folds import ordered_fold
from docsieve.sources import archives as ar
from docsieve.sources import schemas as sm

# --- folds ---


def test_fold_follows_the_order_of_each_key(spark):
    r = random.Random(1)
    rows = [(k, i, r.randint(0, 9)) for k in (1, 2, None) for i in range(200)]
    r.shuffle(rows)

    def step(total, value):
        total[0] = total[0] * 3 % 1000 + value
        return total[0]

    got = ordered_fold(spark.createDataFrame(rows, "k int, i int, v int").repartition(5), ["k"], ["i"], ["v"], lambda: [0], step, "out", "long").collect()
    want, states = set(), {}
    for k, i, v in sorted(rows, key=lambda x: (str(x[0]), x[1])):
        states[k] = states.get(k, 0) * 3 % 1000 + v
        want.add((k, i, v, states[k]))
    assert {tuple(x) for x in got} == want
    assert ordered_fold(spark.createDataFrame([], "k int, i int, v int"), ["k"], ["i"], ["v"], list, step, "out", "long").count() == 0


def near(a, b, c, d):
    return min(b, d) - max(a, c) >= 0.3 * min(b - a, d - c)


def test_seeds_are_those_of_a_plain_loop(spark):
    r = random.Random(2)
    names = ["acme", "acme corp", "blue", "red", "red hot"]
    alike = {("acme", "acme corp"), ("red", "red hot")} | {(n, n) for n in names}
    alike |= {(b, a) for a, b in alike}
    rows = []
    for i in range(900):
        start = 24000 + r.randint(0, 60)
        rows.append((i % 3, i, r.choice(names), r.choice("FOP"), start, start + r.randint(1, 30)))
    want, seeds = set(), {}
    for own, i, name, source, a, b in rows:
        held = seeds.setdefault(own, [])
        hit = next((s[0] for s in held if (name, s[1]) in alike and s[2] != source and near(s[3], s[4], a, b)), None)
        if hit is None:
            held.append((i, name, source, a, b))
        want.add((i, i if hit is None else hit))
    df = spark.createDataFrame(rows, "owner int, ordinal int, company string, source string, start_m int, end_m int")
    pairs = spark.createDataFrame(list(alike), "x string, y string").select(mt.name_key("x").alias("a"), mt.name_key("y").alias("b"))
    got = mt.seed_groups(df, "owner", "ordinal", ["company"], pairs, near, "source")
    assert {(x["ordinal"], x["seed"]) for x in got.collect()} == want and len({s for _, s in want}) > 20


def test_an_owner_of_a_million_rows(spark):
    """One key's rows are streamed, with as much state as it has seeds."""
    i = F.col("id")
    rows = spark.range(1_000_000).select(
        F.lit(1).alias("owner"), i.alias("ordinal"), F.concat(F.lit("firm "), (i % 50).cast("string")).alias("company"), F.element_at(F.array(*map(F.lit, "FOP")), (F.floor(i / 2400) % 3 + 1).cast("int")).alias("source"),
        (24000 + i % 480).cast("int").alias("start_m"), (24006 + i % 480).cast("int").alias("end_m"),
    )
    names = rows.select(mt.name_key("company").alias("a")).distinct()
    got = mt.seed_groups(rows, "owner", "ordinal", ["company"], names.withColumn("b", F.col("a")), near, "source")
    out = got.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("seed").alias("seeds"), F.max(F.col("seed") > F.col("ordinal")).alias("later")).first()
    assert out["n"] == 1_000_000 and out["seeds"] < 340_000 and not out["later"]


# --- spans ---


def test_date_ranges_have_their_places():
    find = spans.written_ranges([re.compile(p, re.ASCII) for p in spans.FORMS], 2002)
    text = "Jan 1999 - Mar 2001 then 1999 - 2001, 1999 - 2001, and before that (1997 - 98), after \n\t1990-91 and never (1999 - 95) but Sept. 1998 – Present"
    got = find(text)
    assert [(r["form"], r["low"], r["high"], r["range"]) for r in got] == [
        (1, 1999, 2001, "Jan 1999 - Mar 2001"), (1, 1999, 2001, "1999 - 2001"), (1, 1999, 2001, "1999 - 2001"), (2, 1997, 1998, "(1997 - 98)"), (3, 1990, 1991, "1990-91"), (1, 1998, 2002, "Sept. 1998 – Present"),
    ]
    assert all(text[r["at"] : r["stop"]].strip() == r["range"] for r in got)
    assert find("") == [] and [r["form"] for r in find("see (2000 - 01)(2001 - 02)")] == [2]  # the second is too near


def test_ranges_of_odd_texts(spark):
    rows = spark.createDataFrame([(1, None), (2, "naïve 😀 1990 - 1991"), (3, "x" * 200_000 + " 1990 - 1991")], "i int, text string")
    got = {r["i"]: [(x["at"], x["stop"]) for x in r["ranges"]] for r in spans.with_ranges(rows, "text", 2002).collect()}
    assert got == {1: [], 2: [(8, 19)], 3: [(200_001, 200_012)]}


# --- schemas ---

PART = sm.Record((("name", sm.Text(least=1)), ("size", sm.Number(least=0, nullable=True)), ("tags", sm.Items(sm.Items(sm.Text())))), from_text="name", made=(("tags", None),))
WHOLE = sm.Record((("id", sm.Number()), ("kind", sm.Text(one_of=("a", "b"))), ("open", sm.Flag()), ("parts", sm.Items(PART, 1)), ("place", sm.Record((("city", sm.Text(nullable=True)),)))))


def plain_errors(value, kind, path=""):
    """The same rules over Python's values; a field that isn't there is a KeyError's ``...``."""
    if value is ...:
        return [f"{path}: missing"]
    if value is None:
        return [] if kind.nullable else [f"{path}: is null"]
    if isinstance(kind, sm.Text):
        bad = "expected text" if not isinstance(value, str) else "too short" if len(value) < kind.least else f"not one of {', '.join(kind.one_of)}" if kind.one_of and value not in kind.one_of else None
    elif isinstance(kind, sm.Number):
        bad = "expected number" if isinstance(value, bool) or not isinstance(value, (int, float)) else "too small" if kind.least is not None and value < kind.least else None
    elif isinstance(kind, sm.Flag):
        bad = None if isinstance(value, bool) else "expected flag"
    elif isinstance(kind, sm.Items):
        if not isinstance(value, list):
            return [f"{path}: expected list"]
        return ([f"{path}: too short"] if len(value) < kind.least else []) + [e for i, v in enumerate(value) for e in plain_errors(v, kind.of, f"{path}[{i}]")]
    else:
        if not isinstance(value, dict):
            return [f"{path}: expected record"]
        return [e for n, k in kind.fields for e in plain_errors(value.get(n, ...), k, f"{path}.{n}" if path else n)]
    return [f"{path}: {bad}"] if bad else []


def made(r, depth=0):
    kinds = [None, True, 0, -2, 3.5, "", "a", "7 apples", [], {}]
    if depth < 4 and r.random() < 0.6:
        if r.random() < 0.5:
            return [made(r, depth + 1) for _ in range(r.randint(0, 3))]
        return {n: made(r, depth + 1) for n in r.sample(["id", "kind", "open", "parts", "place", "city", "name", "size", "tags"], r.randint(0, 6))}
    return r.choice(kinds)


def records():
    r = random.Random(6)
    good = {"id": 1, "kind": "a", "open": True, "parts": [{"name": "n", "size": None, "tags": [["x"], []]}], "place": {"city": None}}
    out = [good, {**good, "parts": []}, {**good, "parts": [{"name": "n", "size": -1, "tags": [["x", 1], "y"]}]}, {**good, "parts": ["text", {"name": "", "size": "3 m", "tags": None}]}, {}]
    out += [{n: made(r, 1) for n in ("id", "kind", "open", "parts", "place") if r.random() < 0.9} for _ in range(150)]
    return out


def test_errors_of_nested_records(spark):
    rows = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(records())] + [(998, "nope"), (999, None)], "i int, json string")
    got = {r["i"]: r["e"] for r in rows.select("i", sm.errors(F.col("json"), WHOLE).alias("e")).collect()}
    want = {i: plain_errors(x, WHOLE) for i, x in enumerate(records())}
    assert {i: got[i] for i in want} == want
    assert got[998] == got[999] == ["not JSON"] and want[0] == [] and want[1] == ["parts: too short"] and want[2][-2:] == ["parts[0].tags[0][1]: expected text", "parts[0].tags[1]: expected list"]


def test_repaired_records_keep_to_the_schema(spark):
    rows = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(records())], "i int, json string")
    got = rows.select("i", sm.repaired(F.col("json"), WHOLE).alias("r"), sm.errors(sm.repaired_json(F.col("json"), WHOLE), WHOLE).alias("left"))
    out = {r["i"]: r for r in got.collect()}
    assert out[0]["left"] == [] and out[3]["r"]["parts"][0]["name"] == "text" and out[3]["r"]["parts"][0]["tags"] == [] and out[3]["r"]["parts"][1]["size"] == 3.0
    assert out[4]["r"]["id"] == 0.0 and out[4]["r"]["parts"] == [] and out[4]["r"]["place"]["city"] is None
    mended = ("expected number", "expected list", "expected record", "is null", "missing")
    forms = [e for r in out.values() for e in r["left"] if e.endswith(mended)]
    # What may stay: texts and flags that aren't there, which nobody can make up.
    assert all(re.search(r"(kind|open|name|\]): (is null|missing)$", e) for e in forms)


# --- lexicons ---


def test_lexicon_takes_the_first_place(spark):
    lex = lexicon.Lexicon("l", "b/x: machine learning, spark\na/y: machines, learning\na/z: go", "none")
    rows = spark.createDataFrame([(1, "Machine-Learning with Spark"), (2, "deep learning machine"), (3, "GO!"), (4, "gopher"), (5, None), (6, ""), (7, "machine tool learning"), (1, "Machine-Learning with Spark")], "i int, t string")
    got = sorted((r["i"], r["label"], r["d"]) for r in lexicon.labelled(rows, "t", lex, detail="d").collect())
    assert got == [(1, "b", "x"), (1, "b", "x"), (2, "a", "y"), (3, "a", "z"), (4, "none", None), (5, "none", None), (6, "none", None), (7, "a", "y")]


def test_a_lexicon_of_thousands_is_one_join(spark):
    words = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in ("lum", "ner", "pix", "rod", "tan")]
    entries = [(f"{x} {y}", f"label {i % 40}", "", i) for i, (x, y) in enumerate((x, y) for x in words for y in words[:40])]
    table = spark.createDataFrame(entries, "phrase string, label string, detail string, place int")
    r = random.Random(1)
    text = " ".join(r.choice(words) for _ in range(3000))
    found = lexicon.hits(spark.createDataFrame([(1, text)], "i int, t string"), ["i"], "t", table)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "RLIKE" not in plan and "bal" not in plan
    tokens = text.split()
    known = {p for p, *_ in entries}
    want = {}
    for at, pair in enumerate(map(" ".join, zip(tokens, tokens[1:])), 1):
        if pair in known:
            want.setdefault(pair, at)
    assert {r["phrase"]: r["at"] for r in found.collect()} == want and len(want) > 100


# --- layouts and sections ---


def test_columns_of_pages(spark):
    rows, n = [], 0
    for page, edges in ((1, (40, 340)), (2, (40, 90)), (3, (40,))):
        for line in range(12):
            for edge in edges:
                n += 1
                rows.append((page, n, edge + line % 4, 100, line * 12 + edge % 3))
    rows += [(4, 900 + i, 40 + 300 * (i % 2), 50, 10 * i) for i in range(4)]  # too few lines
    lined = layout.text_lines(spark.createDataFrame(rows, "page int, item int, x int, width int, y int"))
    starts = layout.columns(lined, 612)
    assert {r["page"]: r["starts"] for r in starts.collect()} == {1: [30.0, 330.0], 2: [0.0], 3: [0.0], 4: [0.0]}
    first = [r for r in layout.in_reading_order(lined, starts).orderBy("place").collect() if r["page"] == 1]
    assert [r["col"] for r in first] == [0] * 12 + [1] * 12 and [r["line"] for r in first[:12]] == sorted(r["line"] for r in first[:12])


def test_sections_get_their_notes(spark):
    lines = [("Name", None, ""), ("EXPERIENCE", "experience", ""), ("Acme Ltd", None, "c"), ("- built", None, ""), ("BSc Arts", None, "e"), ("Nurse (1999 - 2001)", None, "h"), ("Cook (2001 - 2002)", None, "h"), ("EDUCATION", "education", ""), ("Driver (1990 - 1991)", None, "h"), ("Diploma (1990 - 1991)", None, "hx")]
    rows = [(1, i, line, s, "h" in f, False, "x" in f or "e" in f, "e" in f, "c" in f) for i, (line, s, f) in enumerate(lines)] + [(2, 1, "just text (1999 - 2000)", None, True, False, False, False, False)]
    df = spark.createDataFrame(rows, "owner int, pos int, line string, section string, header boolean, date_only boolean, excused boolean, education boolean, company boolean")
    got = {r["owner"]: r for r in sections.annotated(df).collect()}
    assert got[1]["text"].split("\n") == [
        "Name", "EXPERIENCE", sections.BELOW, sections.ELSEWHERE + "Driver (1990 - 1991)]", sections.TITLELESS, "Acme Ltd", "- built", sections.EDUCATION + "BSc Arts", "Nurse (1999 - 2001)", "Cook (2001 - 2002)",
        "EDUCATION", sections.DISPLACED + "Driver (1990 - 1991)", "Diploma (1990 - 1991)",
    ]
    assert (got[1]["n_headers"], got[1]["n_displaced"]) == (2, 1) and got[2]["text"] == "just text (1999 - 2000)"


# --- letters and statistics ---


@pytest.mark.parametrize("text", ["Việt Nam, Đà Nẵng", "Ελληνικά Άθήνα ΐ", "é ñ Å ﬁ ø ß", "ガ 가나다", "İstanbul ё й", "हिन्दी की", ""])
def test_marks_go_in_all_scripts(spark, text):
    import duckdb

    got = spark.createDataFrame([(text,)], "t string").select(tx.without_marks("t").alias("x")).first()["x"]
    by_hand = unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.category(c).startswith("M")))
    assert got == by_hand == duckdb.execute("SELECT strip_accents(?)", [text]).fetchone()[0]


def test_incomplete_beta_at_known_values():
    cases = [
        (0.5, 0.5, 0.5, 0.5), (0.25, 0.5, 0.5, 1 / 3), (0.3, 1, 1, 0.3), (0.3, 2, 1, 0.09), (0.3, 1, 3, 1 - 0.7**3), (0.5, 7, 7, 0.5), (0.0, 2, 3, 0.0), (1.0, 2, 3, 1.0),
        (0.4, 2, 3, 0.5248), (0.9, 0.5, 1, 0.9**0.5), (0.9, 1, 0.5, 1 - 0.1**0.5), (0.5, 5000.5, 5000.5, 0.5),
    ]
    x, a, b, want = map(np.array, zip(*cases))
    assert np.abs(stats.beta_cdf(x, a, b) - want).max() < 1e-9
    # The sum of binomial chances, for whole shapes.
    from math import comb

    for n, k, p in ((40, 7, 0.2), (400, 90, 0.25), (12, 1, 0.01)):
        tail = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1))
        assert stats.beta_cdf(np.array([p]), np.array([k]), np.array([n - k + 1]))[0] == pytest.approx(tail, abs=1e-11)


def test_p_values(spark):
    # Fixed values of Student's and F tables: t = 2.228 with 10 degrees is 5 %, F(3, 10) = 3.708 is 5 %, F(1, 10) = 10.044 is 1 %.
    rows = spark.createDataFrame([(2.228139**2, 1, 10), (3.708265, 3, 10), (10.044289, 1, 10), (3.841459, 1, 10_000), (0.0, 1, 10), (float("inf"), 1, 10), (None, 1, 10)], "f double, a int, b int")
    got = [r["p"] for r in rows.select(stats.f_pvalue(F.col("f"), F.col("a"), F.col("b")).alias("p")).collect()]
    assert got[:6] == pytest.approx([0.05, 0.05, 0.01, 0.05, 1.0, 0.0], abs=2e-6) and got[6] is None


def test_two_groups_at_their_edges(spark):
    rows = [("few", 0, 1.0), ("few", 1, 2.0), ("few", 1, 3.0), ("same", 0, 1.0), ("same", 0, 1.0), ("same", 1, 1.0), ("same", 1, 1.0), ("apart", 0, 1.0), ("apart", 0, 1.0), ("apart", 1, 2.0), ("apart", 1, 2.0)]
    rows += [("usual", g, v) for g, v in ((0, 1.0), (0, 2.0), (0, 3.0), (1, 2.0), (1, 4.0), (1, 6.0))]
    got = {r["k"]: (r["f"], round(r["p_value"], 6)) for r in stats.two_groups(spark.createDataFrame(rows, "k string, g int, v double"), ["k"], F.col("g") == 1, "v").collect()}
    assert got["few"] == (0.0, 1.0) and got["same"] == (0.0, 1.0) and got["apart"] == (float("inf"), 0.0)
    assert got["usual"] == (pytest.approx(2.4), pytest.approx(0.196262, abs=2e-6))


# --- archives ---


def test_cells_beyond_the_header(spark):
    text = 'Name,Year\nA,1,extra,"more, cells"\nB\n,,\n'
    rows = spark.createDataFrame([("z", "positions.csv", "ok", text)], "archive string, member string, verdict string, text string")
    got = [r["record"] for r in ar.csv_rows(rows, "positions.csv").collect()]
    assert got == [{"name": "A", "year": "1", "extra": "extra,more, cells"}, {"name": "B", "year": ""}]


def test_damaged_members_have_a_verdict(spark, tmp_path):
    import zipfile

    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("skills.csv", "name\n" + "python\n" * 500)
        z.writestr("profile.csv", "name\nx\n")
    raw = bytearray(path.read_bytes())
    raw[45:60] = b"\xff" * 15  # within the first member's data
    path.write_bytes(raw)
    got = {r["member"]: (r["verdict"], r["text"] is None) for r in ar.read_archives(spark, str(tmp_path)).collect()}
    assert got == {"skills.csv": ("damaged", True), "profile.csv": ("ok", False)}


def test_small_archives_need_no_file_each(spark, tmp_path):
    files = spark.createDataFrame([(f"{i}.zip", m, f"Name\n{m}{i}\n") for i in range(30) for m in ("skills.csv", "Profile.csv")] + [("e.zip", "x.exe", "x")], "archive string, member string, text string")
    ar.packed(files).write.parquet(str(tmp_path / "t"))
    assert len(list((tmp_path / "t").glob("*.parquet"))) < 31
    read = ar.unpacked(spark.read.parquet(str(tmp_path / "t")))
    got = {(r["archive"], r["kind"], r["record"]["name"]) for r in ar.csv_records(read, "skills.csv", "profile.csv").collect()}
    assert got == {(f"{i}.zip", m.lower(), f"{m}{i}") for i in range(30) for m in ("skills.csv", "Profile.csv")}
    assert {r["verdict"] for r in read.where("archive = 'e.zip'").collect()} == {"not allowed"}
    assert ar.write_archives(files, str(tmp_path / "z")).count() == 31
    assert sorted(ar.read_archives(spark, str(tmp_path / "z")).collect()) == sorted(read.collect())
