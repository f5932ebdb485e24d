import pytest
from pyspark.sql import functions as F

from docsieve.functions import rules, stats
from docsieve.functions import text as tx
from docsieve.operators import evidence as ev
from docsieve.operators import matching as mt
from docsieve.operators import temporal as tm
from docsieve.sources import tables as src
from docsieve.streaming import events as stream


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


ROLES = "owner int, ordinal int, start_m int, end_m int"


def test_islands_touch_nest_and_stand_apart(spark):
    rows = [(1, 1, 0, 5), (1, 2, 5, 9), (1, 3, 6, 7), (1, 4, 12, 12), (2, 5, 3, 4)]
    got = tm.covered_months(spark.createDataFrame(rows, ROLES)).orderBy("owner").collect()
    assert [tuple(r) for r in got] == [(1, 2, 9), (2, 1, 1)]


@pytest.mark.parametrize(("gap", "n"), [(2, 0), (3, 1), (4, 1)])
def test_gaps_of_three_months(spark, gap, n):
    assert tm.gaps(spark.createDataFrame([(1, 1, 0, 5), (1, 2, 5 + gap, 20)], ROLES)).count() == n


def test_gap_behind_a_long_role_compares_with_the_row_before(spark):
    assert tm.gaps(spark.createDataFrame([(1, 1, 0, 30), (1, 2, 2, 4), (1, 3, 9, 12)], ROLES)).count() == 1


def test_union_coverage(spark):
    rows = spark.createDataFrame([(1, 1, 0, 4), (1, 2, 2, 6), (1, 3, 8, 20)], ROLES)
    windows = spark.createDataFrame([(1, 0, 10), (2, 0, 10)], "owner int, low int, high int")
    got = {r["owner"]: r["share"] for r in tm.union_coverage(rows, windows).collect()}
    assert got == {1: 0.8, 2: 0.0}


@pytest.mark.parametrize(
    ("text", "start", "end"),
    [("Mar 2020", 3, 3), ("2020", 1, 12), ("2020-07", 7, 7), ("11/2020", 11, 11), ("September 2020", 9, 9), ("garbage", None, None), (" Jan 2020\n", 1, 1)],
)
def test_parse_role_date(spark, text, start, end):
    for side, month in ((False, start), (True, end)):
        assert one(spark, tm.parse_role_date(F.lit(text), side, F.lit(1))) == (None if month is None else 2020 * 12 + month)


def test_parse_short_years_and_present(spark):
    assert one(spark, tm.parse_role_date(F.lit("May 49"), False, F.lit(1))) == 2049 * 12 + 5
    assert one(spark, tm.parse_role_date(F.lit("May '50"), False, F.lit(1))) == 1950 * 12 + 5
    assert one(spark, tm.parse_role_date(F.lit("Present"), True, F.lit(77))) == 77


def test_career_start_after_a_gap(spark):
    rows = spark.createDataFrame([(1, 1, 2000 * 12 + 1, 0), (1, 2, 2003 * 12 + 1, 0), (2, 3, 2000 * 12 + 1, 0), (2, 4, 2002 * 12 + 12, 0)], ROLES)
    assert {r["owner"]: r["career_start"] for r in tm.career_start(rows).collect()} == {1: 2003, 2: 2000}


@pytest.mark.parametrize(("roles", "impact", "valid", "depth", "want"), [(0, False, False, False, "claimed"), (0, False, False, True, "exists"), (1, True, False, False, "exists"), (1, True, False, True, "strong"), (2, False, True, False, "strong"), (2, False, False, True, "exists")])
def test_verdict(spark, roles, impact, valid, depth, want):
    row = spark.createDataFrame([(roles, impact, valid, depth)], "n_roles int, has_impact boolean, has_validation boolean, has_depth boolean")
    assert row.select(ev.verdict().alias("v")).first()["v"] == want


@pytest.mark.parametrize(("met", "total", "want"), [(0, 0, "competitive"), (179, 200, "strong fit"), (3, 4, "good fit"), (1, 2, "partial fit"), (0, 3, "stretch")])
def test_position_rounds_half_up(spark, met, total, want):
    assert one(spark, ev.position(F.lit(met), F.lit(total))) == want


def test_rules_take_the_first_match(spark):
    r = rules.Rules([("b", "first"), ("a", "second")], "none")
    assert [one(spark, r.first(F.lit(x))) for x in ("ab", "A", "", "zz")] == ["first", "second", "none", "none"]
    assert one(spark, r.first(F.lit(None).cast("string"))) == "none"
    assert one(spark, r.every(F.lit("ab"))) == ["first", "second"]


def test_text(spark):
    assert one(spark, tx.words(F.lit("  A-b, c!\n"))) == ["a", "b", "c"] and one(spark, tx.words(F.lit(""))) == []
    assert one(spark, tx.ngrams(F.array(*map(F.lit, "abca")), 3)) == ["a b c", "b c a"]
    assert one(spark, tx.ngrams(F.array(F.lit("a")), 3)) == []
    assert one(spark, tx.similarity(F.lit(""), F.lit(""))) == 1.0
    assert one(spark, tx.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))) is None


def test_jaro_winkler():
    assert round(stats.jaro_winkler("thompson", "thomson"), 3) == 0.975
    assert stats.jaro_winkler("", "a") == 0 and stats.jaro_winkler("", "") == 1 and round(stats.jaro_winkler("martha", "marhta"), 4) == 0.9611


def test_beta_interval(spark):
    rows = spark.createDataFrame([(0, 8), (5, 10), (8, 8)], "s long, n long")
    got = [r["ci"] for r in rows.select(stats.beta_interval("s", "n").alias("ci")).collect()]
    assert (round(got[0]["low"], 4), round(got[0]["high"], 4)) == (0.0028, 0.3363)
    assert abs(got[1]["low"] + got[1]["high"] - 1) < 1e-6 and round(1 - got[2]["low"], 4) == 0.3363


def test_anova_of_equal_groups(spark):
    rows = spark.createDataFrame([("k", g, v) for g, vs in (("a", [1, 2, 3]), ("b", [2, 3, 7])) for v in vs], "k string, g string, v int")
    got = stats.anova(rows, ["k"], "g", "v").first()
    assert (got["df1"], got["df2"]) == (1, 4) and abs(got["f"] - 1.5) < 1e-9


@pytest.mark.parametrize(("order", "groups"), [([1, 2, 3], {1: 1, 2: 1, 3: 3}), ([2, 1, 3], {2: 2, 1: 2, 3: 2})])
def test_greedy_groups_compare_with_the_seed_only(spark, order, groups):
    """1 ~ 2 and 2 ~ 3, but not 1 ~ 3."""
    rows = spark.createDataFrame([(0, i, x) for i, x in enumerate(order)], "owner int, i int, x int")
    alike = spark.createDataFrame([(a, b) for a in (1, 2, 3) for b in (1, 2, 3) if abs(a - b) <= 1], "x int, y int").select(mt.name_key("x").alias("a"), mt.name_key("y").alias("b"))
    got = mt.seed_groups(rows, "owner", "i", ["x"], alike).collect()
    assert {r["x"]: order[r["seed"]] for r in got} == groups


def test_overlaps_are_found_once(spark):
    a = spark.createDataFrame([(1, 1, 0, 40)], "owner int, a int, a_start int, a_end int")
    b = spark.createDataFrame([(1, 2, 5, 30), (1, 3, 40, 41), (2, 4, 0, 9)], "owner int, b int, b_start int, b_end int")
    assert [r["b"] for r in mt.overlapping(a, b, "owner").collect()] == [2]


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Name , Start Date\n"x ""y""",1\n"two\nlines",2\n,\n')
    rows = src.normalised_headers(src.read_csv_quoted(spark, str(tmp_path / "a.csv")), {"name": ["title", "name"], "start": ["start_date"], "none": ["nothing"]})
    assert sorted(tuple(r) for r in rows.collect()) == [('two\nlines', "2", None), ('x "y"', "1", None)]
    (tmp_path / "b.csv").write_text('Category,Resume\nIT,"a, b"\nHR,c\n')
    assert sorted(tuple(r) for r in src.read_csv_two_columns(spark, str(tmp_path / "b.csv"), "Category", "Resume").collect()) == [("HR", "c"), ("IT", "a, b")]
    (tmp_path / "c.jsonl").write_text('{"a": 1}\nnot json\n{"a": 2}\n')
    assert sorted(r["a"] for r in src.read_json_lines(spark, str(tmp_path / "c.jsonl"), "a int").collect()) == [1, 2]
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "p-1.json").write_text('{"id": "one",\n "tags": ["x"]}')
    (tmp_path / "docs" / "other.txt").write_text("[]")
    assert src.read_json_documents(spark, str(tmp_path / "docs"), "id string, tags array<string>", "p-*.json").count() == 1
    frame = spark.createDataFrame([(1, 'a"b'), (2, "c")], "owner int, v string")
    src.write_tsv(frame, str(tmp_path / "tsv"))
    assert any('"a""b"' in p.read_text() for p in (tmp_path / "tsv").glob("*.csv"))
    src.rebuild_partitions(frame, str(tmp_path / "parts"), "owner")
    src.rebuild_partitions(spark.createDataFrame([(2, "new")], "owner int, v string"), str(tmp_path / "parts"), "owner")
    assert sorted(r["v"] for r in spark.read.parquet(str(tmp_path / "parts")).collect()) == ['a"b', "new"]


def test_upsert_and_validation(spark):
    old, new = (spark.createDataFrame(r, "k int, v string") for r in ([(1, "a"), (2, "b")], [(2, "c"), (3, "d")]))
    assert sorted(tuple(r) for r in src.upsert(old, new, ["k"]).collect()) == [(1, "a"), (2, "c"), (3, "d")]
    good, bad = src.validated(old, small=F.col("k") < 2, known=F.when(F.col("k") == 1, True))
    assert good.count() == 1 and bad.first()["broken"] == ["small", "known"]


def test_streams_give_what_batches_give(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    rows = stream.read_stream(spark, str(tmp_path / "in"))
    stream.write_once(stream.distinct_events(rows, "40 days"), str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == events.count()
    query = stream.tumbling_counts(rows, "1 day", "40 days").writeStream.outputMode("complete").format("memory").queryName("counts")
    query.option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination()
    want = {tuple(r)[:3] for r in stream.tumbling_counts(events, "1 day").collect()}
    assert {tuple(r)[:3] for r in spark.table("counts").collect()} == want


def test_anchors_depend_on_the_one_before(spark):
    from docsieve.operators import layout

    rows = spark.createDataFrame([(1, i, y) for i, y in enumerate([0, 2, 4, 5, 30])], "page int, i int, y int")
    got = layout.anchored(rows, "page", ["i"], "y", 3).orderBy("i").collect()
    assert [r["anchor"] for r in got] == [0, 0, 4, 4, 30]


def test_beta_under(spark):
    got = spark.range(1).select(stats.beta_under(F.lit(0.5), F.lit(3.0), F.lit(3.0)).alias("x")).first()["x"]
    assert abs(got - 0.5) < 1e-9
