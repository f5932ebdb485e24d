"""Each clause of the matching, grounding and scoring rules by a case of its own."""

import zipfile

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docsieve.functions import grounding as gr
from docsieve.functions import lexicons as lx
from docsieve.functions import text as tx
from docsieve.operators import matching as mt
from docsieve.operators import names as nm
from docsieve.operators import scoring as sc
from docsieve.plans import domain as d
from docsieve.plans import matching_queries as mq
from docsieve.plans import ground_queries, registry, score_queries  # noqa: F401
from docsieve.sources import archives as ar
from docsieve.sources.tables import Tables

from .oracle import same


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lit(*values):
    return [F.lit(v) for v in values]


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [("K8s", "kubernetes", True), ("Java", "JavaScript", False), ("Machine Learning", "ML", True), ("Python", "python 3", True), ("Go", "Google", False), ("R", "R Studio", False), ("React Native", "react", True), ("SQL", "Excel", False)],
)
def test_skills_match(spark, a, b, want):
    assert one(spark, nm.skills_match(*lit(a, b))) is want and one(spark, nm.skills_match(*lit(b, a))) is want
    left, right = (spark.createDataFrame([(x,)], "name string") for x in (a, b))
    assert nm.name_matches(left, right).count() == int(want)


def test_exact_names_come_first(spark):
    names = spark.createDataFrame([("Kubernetes admin",), ("k8s",)], "name string")
    got = nm.name_matches(spark.createDataFrame([("Kubernetes",)], "name string"), names).orderBy(F.desc("exact")).collect()
    assert [(r["b"], r["exact"]) for r in got] == [("k8s", True), ("Kubernetes admin", False)]


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [("Acme, Inc.", "ACME inc", True), ("Acme", "Acme Labs", True), ("Blue River North", "North Blue Lake River", True), ("IBM", "International Business Machines", True), ("Globex", "Initech", False)],
)
def test_companies_match(spark, a, b, want):
    assert one(spark, nm.companies_match(*lit(a, b))) is want


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [("Project Manager", "Project Management", True), ("Data Analyst", "Senior Data Analyst", True), ("House Officer", "Medical Officer", False), ("Lead Nurse Care", "Lead Care Teacher", True), ("Cook", "Driver", False), ("", "Driver", False)],
)
def test_titles_match(spark, a, b, want):
    assert one(spark, nm.titles_match(*lit(a, b))) is want


@pytest.mark.parametrize(("b", "want"), [((10, 20), True), ((18, 40), False), ((17, 27), True), ((21, 21), False), ((-30, 3), False), ((-30, 6), True)])
def test_dates_agree(spark, b, want):
    assert one(spark, nm.dates_agree(*lit(0, 20, *b))) is want


def test_share_context(spark):
    assert one(spark, nm.share_context(*lit("Cook", "Acme Labs", "Driver", "Labs (North)"))) is True
    assert one(spark, nm.share_context(*lit("Head Cook", "A B", "Head Cook", "C D"))) is True
    assert one(spark, nm.share_context(*lit("Cook", "UPS", "Cook", "IBM"))) is False


def test_contained_in_either_direction(spark):
    a = spark.createDataFrame([("alphabet",), ("be",)], "a string")
    b = spark.createDataFrame([("bet",), ("x",), ("alphabets",)], "b string")
    assert {tuple(r) for r in nm.either_contains(a, b, "a", "b").collect()} == {("alphabet", "bet"), ("alphabet", "alphabets"), ("be", "bet"), ("be", "alphabets")}


@pytest.mark.parametrize(
    ("value", "how", "start"),
    [("ab", "exact", 0), ("SENIOR engineer", "exact", 8), ("https://acme.example/", "url", 31), ("CSEP", "spaced", 44), ("2019", "year", None), ("café, engineer", "fuzzy", None), ("Été; Paris", "normalised", None), ("enginear", "fuzzy", None), ("senyor enginear", "fuzzy", None), ("engineer acme paris csep senior", "none", None), ("paris ete engineer senior acmeexample", "words", None), ("zzzzzz", "none", None)],
)
def test_grounding_cascade(spark, value, how, start):
    source = "Café is senior engineer, sites acme.example - C S E P (2018-19) été, Paris"
    row = spark.createDataFrame([(value, source)], "v string, s string").withColumns({"low": F.lower("s"), "norm": gr.normalised(F.col("s")), "u": tx.without_marks(F.trim("v"))})
    got = row.select(gr.grounded(F.col("v"), F.col("u"), F.col("low"), F.col("norm"), gr.source_words(F.col("norm"))).alias("g")).first()["g"]
    assert got["how"] == how
    if how in ("exact", "url", "spaced") and len(value) > 2:
        assert got["start"] == source.lower().index({"url": "acme.example", "spaced": "c s e p"}.get(how, value.lower()))
        assert source.lower()[got["start"] : got["end"]] == {"url": "acme.example", "spaced": "c s e p"}.get(how, value.lower())


LONG = "worked at acme with python and sql for many years, cut cost by 30% over 2019 and led 4 teams"


def test_checks_of_generated_texts(spark):
    def score(c):
        return tuple(one(spark, c))[:2]

    source, short = F.lit(LONG), F.lit("short")
    words = F.array(*lit("python", "cobol"))
    assert score(sc.no_fabrication(words, source)) == (0.5, False) and score(sc.no_fabrication(words, short)) == (1.0, True)
    assert score(sc.metrics_kept(source, F.lit("by 30% and 4 teams"))) == (0.75, True) and score(sc.metrics_kept(F.lit("none"), short)) == (1.0, True)
    assert score(sc.word_count(F.lit("a b c d"), 3)) == (pytest.approx(2 / 3), False)
    bullets = F.array(*lit("Led a team", "Responsible for x", "Acme Labs: Built y", "(remote) co-authored z", "Co-led it"))
    assert score(sc.action_verbs(bullets)) == (0.8, True) and score(sc.action_verbs(F.array().cast("array<string>"))) == (1.0, True)
    assert score(sc.no_new_technologies(F.array(*lit("used Python", "and Docker")), source)) == (0.5, False)
    assert score(sc.structure(*lit("", "Acme", "Cook", "2019"), words, bullets)) == (0.85, False)
    assert score(sc.facts_kept(F.lit("Acme Corp"), F.lit(2019), source)) == (1.0, True) and score(sc.facts_kept(F.lit("Globex"), F.lit(2018), source)) == (0.0, False)
    asked = F.array(*lit("5 years of experience with python", "cobol and fortran", "strong knowledge"))
    assert score(sc.requirements_covered(asked, F.array(*lit("sql")), source, F.lit("python only"))) == (pytest.approx(0.7), True)


def test_checks_of_parsed_postings(spark):
    def fuzzy(a, b):
        return tuple(one(spark, sc.fuzzy_field(F.lit(a).cast("string"), F.lit(b).cast("string"), 0.4)))[:2]

    assert fuzzy(None, None) == (1.0, True) and fuzzy("x", "") == (0.5, True) and fuzzy("", "x") == (0.0, False) and fuzzy("A", "a") == (1.0, True) and fuzzy("acme corp", "Acme") == (0.9, True)
    assert round(fuzzy("thompson", "thomson")[0], 3) == 0.975
    years = [tuple(one(spark, sc.numeric_field(F.lit(a).cast("int"), F.lit(b).cast("int"))))[:2] for a, b in ((3, 3), (3, 4), (3, 5), (None, 3), (None, None))]
    assert years == [(1.0, True), (0.8, True), (0.0, False), (0.0, False), (1.0, True)]
    want, got = (F.array(*[F.struct(F.lit(a).alias("text"), F.lit(b).alias("type")) for a, b in x]) for x in ([("python data work", "preferred"), ("nursing care", "must-have"), ("unseen topic", "hard")], [("python data", "hard"), ("nursing", "required")]))
    assert tuple(one(spark, sc.types_right(want, got)))[:2] == (0.75, False)
    texts = [F.transform(x, lambda i: i["text"]) for x in (want, got)]
    assert tuple(one(spark, sc.found_share(*texts, 0.4)))[0] == pytest.approx(2 / 3)


def test_seniority_reads_training_first(spark):
    titles = {"Senior Trainee": "senior", "Trainee": "entry", "Apprentice Electrician": "entry", "Chief Nurse": "director", "Head Teacher": "lead", "Data Analyst": "mid", "Baker": "mid", "Senior Baker": "senior"}
    assert {x: one(spark, lx.SENIORITY.first(F.lit(x))) for x in titles} == titles


def test_archives_are_guarded(spark, tmp_path):
    for name, files in {"a.zip": {"x/Skills.csv": "Name\nPython\n\n", "evil.exe": "x"}, "b.zip": {"skills.csv": "Name\n" + "y" * 2000}}.items():
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            for member, text in files.items():
                z.writestr(member, text)
    (tmp_path / "c.zip").write_bytes(b"no archive")
    got = ar.read_archives(spark, str(tmp_path), most_member=1000)
    assert {(r["archive"], r["member"], r["verdict"]) for r in got.collect()} == {("a.zip", "Skills.csv", "ok"), ("a.zip", "evil.exe", "not allowed"), ("b.zip", "skills.csv", "too large"), ("c.zip", None, "not an archive")}
    assert [r["record"] for r in ar.csv_rows(got, "skills.csv").collect()] == [{"name": "Python"}]
    assert {r["verdict"] for r in ar.read_archives(spark, str(tmp_path), most_archive=1500).where("archive = 'b.zip'").collect()} == {"archive too large"}


def test_seed_groups_keep_the_first_seed(spark):
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate([5, 9, 7, 6])], "owner int, i int, x int")
    alike = spark.createDataFrame([(a, b) for a in (5, 6, 7, 9) for b in (5, 6, 7, 9) if abs(a - b) <= 2], "x int, y int").select(mt.name_key("x").alias("a"), mt.name_key("y").alias("b"))
    got = mt.seed_groups(rows, "owner", "i", ["x"], alike).collect()
    assert {r["x"]: r["seed"] for r in got} == {5: 0, 9: 1, 7: 0, 6: 0}


def test_a_keyword_meets_one_node(spark):
    """What an owner's names find is settled once for each owner: no row for each node that a keyword matches."""
    t = Tables(spark, "/root/testdata/sf0.001")
    keys = d.keywords(t)
    got = mq.keyword_nodes(t, keys, "kw")
    assert 0 < got.count() == got.select("app", "req", "part", "pos").distinct().count()
    assert mq.requirement_nodes(t).count() == keys.select("app", "req", "part").distinct().count()


def test_tasks_grow_in_number_not_in_size(spark):
    from docsieve.sources.tables import dealt

    rows = spark.range(1000)
    assert dealt(rows, 1000, "id", most=10).rdd.getNumPartitions() == 100
    assert dealt(rows, 1000, "id", most=10).count() == 1000 == dealt(rows, 1000, "id").count()


@pytest.mark.parametrize("name", ["agg_industry_argmax", "jn_metric_attach", "jn_domain_overlap", "jn_anti_fabricated"])
def test_tasks_are_dealt_by_number(spark, name):
    """Adaptive execution merges tasks that are dealt by columns alone, by their bytes, so that one gets ever more slim rows."""
    from docsieve.plans.registry import QUERIES
    from docsieve.sources.tables import dealt

    assert dealt(spark.range(1000), 1000, "id").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    import __spark_entry__  # noqa: F401

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "REPARTITION_BY_COL" not in plan


@pytest.mark.parametrize("name", ["sc_readiness", "agg_scorecards", "agg_baseline_report", "sc_variant", "sc_compare", "sc_pretest", "sc_cv_scorecard", "sc_risk_tag"])
def test_results_of_checks_are_not_shuffled_one_by_one(spark, name):
    """The eight results of an application are grouped where they are made, by tasks that are dealt by number; sc_pretest deals them once, by run."""
    import __spark_entry__  # noqa: F401
    from docsieve.plans import score_queries as sq
    from docsieve.plans.registry import QUERIES

    made = sq.cv_scores(Tables(spark, "/root/testdata/sf0.001"))
    by_app = made.groupBy("app").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in by_app.split("Generate explode")[0] and "REPARTITION_BY_NUM" in by_app
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


JD_QUERIES = ["sc_jd_scorecard", "sc_trial_all", "sc_jd_title", "sc_jd_years_min", "fn_fuzzy_field"]


@pytest.mark.parametrize("name", JD_QUERIES)
def test_fields_of_postings_are_compared_once_a_pair(spark, name):
    """Texts of fields are compared in a table of their distinct pairs, not in the pass over the postings, and keywords aren't taken apart to be grouped again."""
    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "jaro_winkler" not in plan and "levenshtein" not in plan and "inline(kws" not in plan


@pytest.mark.parametrize("name", JD_QUERIES)
def test_odd_postings_are_as_the_sql(spark, tmp_path, name):
    """An order of two customers, rows that are repeated, no part, one part in several lines, a line without order."""
    orders = [(1, 7), (1, 8), (2, 7), (3, None), (6, 9), (44, 9), (90, 1)]
    lines = [(1, 5, 1), (1, 5, 1), (1, 12, 2), (1, 28, 3), (2, None, 1), (2, 8, 2), (3, 9, 1), (3, 10, 1), (3, 9, 2), (6, None, 1), (44, 13, 1), (44, 1, 2), (77, 3, 1), (90, 7, 1)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    for table in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    same(spark, con, str(tmp_path), registry.QUERIES[name], registry.SQL[name])


def test_items_are_compared_once_a_pair(monkeypatch):
    """A word is looked for once a pair of texts, however many postings have both; nulls are never found, items without words always are."""
    looked = []

    class Text(str):
        def lower(self):
            return self

        def __contains__(self, word):
            looked.append(word)
            return super().__contains__(word)

    coded = sc.coded
    monkeypatch.setattr(sc, "coded", lambda lists: (*(c := coded(lists))[:2], [x if x is None else Text(x) for x in c[2]]))
    items, others = pa.array([["know sql"], None, ["know sql", None, "to"]] * 1000), pa.array([["sql, and know it", None], ["x"], ["nothing"]] * 1000)
    assert sc.found_shares(items, others, True).to_pylist() == [1.0, 1.0, 1 / 3] * 1000
    assert len(looked) == 2


def test_requirements_that_are_taken_apart_before(spark):
    asked, source = F.array(F.lit("3+ years of experience with sql"), F.lit("experience with go")), F.lit("a source of more than fifty letters that says sql and not the other")
    words, terms = F.transform(asked, sc.topic_words), F.array(F.lit("sql"))
    row = spark.range(1).select(sc.words_covered(words, terms, source, F.lit("sql")).alias("a"), sc.requirements_covered(asked, terms, source, F.lit("sql")).alias("b")).first()
    assert row["a"] == row["b"]


@pytest.mark.parametrize(
    "text",
    ["\nAlpha Beta gamma delta", "\x0b Alpha Beta gamma", "　 Alpha Beta gamma delta", "\x01Alpha Beta gamma delta", "İİİİ b c d", "Alpha　 Beta gamma delta", "a b " + "z" * 1500, "A\x85B c"],
)
def test_grounding_of_odd_texts_is_as_the_sql(spark, tmp_path, text):
    """Blanks other than spaces, the vertical tab, a control that parts nothing, letters that two would lower, long words, edits counted in bytes."""
    spark.createDataFrame([(0, text), (1, text)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("fn_ground_value", "fn_ground_document", "fn_field_exists", "agg_grounding_report"):
        same(spark, con, str(tmp_path), registry.QUERIES[name], registry.SQL[name])


def test_archives_of_customers_without_items_are_as_the_sql(spark, tmp_path):
    """Of orders without items: alone, beside others, and of a customer that the table doesn't have."""
    from docsieve.plans import file_queries  # noqa: F401

    con = duckdb.connect()
    tables = {
        "customer": ("SELECT c FROM (VALUES (1), (2), (3), (4)) v(c)", "c_custkey long"),
        "orders": ("SELECT o, c, TIMESTAMP '1997-05-01', '1-URGENT', 'O' FROM (VALUES (10, 1), (11, 1), (20, 2), (21, 2), (40, 4), (90, 9)) v(o, c)", "o_orderkey long, o_custkey long, o_orderdate timestamp, o_orderpriority string, o_orderstatus string"),
        "lineitem": ("SELECT o, p, n, 'R', 45.0::DOUBLE, 0.09::DOUBLE FROM (VALUES (10, 5, 1), (10, 6, 2), (40, 7, 1), (90, 5, 1)) v(o, p, n)", "l_orderkey long, l_partkey long, l_linenumber int, l_returnflag string, l_quantity double, l_discount double"),
        "part": ("SELECT p, 'a b c' FROM (VALUES (5), (6)) v(p)", "p_partkey long, p_name string"),
    }
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(con.execute(rows).fetchall(), schema).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    same(spark, con, str(tmp_path), registry.QUERIES["src_zip_detect"], registry.SQL["src_zip_detect"])
