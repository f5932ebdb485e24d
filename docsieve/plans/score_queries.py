"""Scorecards of generated texts and of parsed postings, over the derived tables, with their DuckDB SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsieve.functions import stats
from docsieve.operators import scoring as sc
from docsieve.plans import domain as d
from docsieve.plans.registry import query
from docsieve.plans.text_queries import s_beta_ci, s_f_pvalue, s_two_groups
from docsieve.sources import tables as src
from docsieve.sources.tables import Tables, dealt

OPENERS = ("Led", "Built", "Improved", "Responsible for", "co-authored", "Acme Labs: Designed")
#: What was generated for an application (``made_`` columns) beside its role's own text (``source``).
CV = f"""{d.with_tables('facts', 'roles', 'keywords')},
f AS (SELECT DISTINCT role_id AS app, line, node FROM facts),
src AS (SELECT r.ordinal AS app, r.company, r.title, (r.start_m - 1) // 12 AS yr, lower(r.company || ' ' || r.title || ' ' || CAST((r.start_m - 1) // 12 AS VARCHAR) || ' ' || coalesce(string_agg(f.node || ' cut cost by ' || f.line || '0%', '; ' ORDER BY f.line, f.node) FILTER (f.line <> 3), '')) AS source,
  coalesce(list({d.sql_chosen(OPENERS, 'f.line + r.ordinal')} || ' ' || f.node || ' and cut cost by ' || f.line || '0%' ORDER BY f.line, f.node) FILTER (f.node IS NOT NULL AND f.line <> 5), []) AS bullets
  FROM roles r LEFT JOIN f ON f.app = r.ordinal GROUP BY r.ordinal, r.company, r.title, r.start_m),
asked AS (SELECT app, list('3+ years of experience with ' || kw ORDER BY req, part, pos) AS reqs, list_sort(list(DISTINCT lower(kw))) AS wanted FROM keywords GROUP BY app),
own AS (SELECT app, list_sort(list(DISTINCT lower(node))) AS own FROM f WHERE line <= 5 GROUP BY app),
cv AS (SELECT s.app, s.source, s.bullets, s.title, coalesce(a.reqs, []) AS reqs, CASE WHEN s.app % 3 = 0 THEN coalesce(a.wanted, []) ELSE coalesce(o.own, []) END AS skills,
  CASE WHEN s.app % 9 = 0 THEN '' ELSE s.title END AS summary, CASE WHEN s.app % 6 = 0 THEN {d.sql_chosen(d.COMPANIES, 's.app')} WHEN s.app % 4 = 0 THEN s.company || ', Berlin' ELSE s.company END AS company,
  CASE WHEN s.app % 7 = 0 THEN NULL WHEN s.app % 5 = 0 THEN s.yr + 3 ELSE s.yr END AS yr FROM src s LEFT JOIN asked a USING (app) LEFT JOIN own o USING (app)),
c AS (SELECT *, lower(summary || ' ' || company || ' ' || title || ' ' || array_to_string(skills, ' ') || ' ' || array_to_string(bullets, ' ')) AS made FROM cv)"""


def generated(t: Tables) -> DataFrame:
    many = t.lineitem.count()
    # Small parts, as the checks take their time and the last ones keep all others waiting.
    f = dealt(d.facts(t).select(F.col("role_id").alias("app"), "line", "node"), many, "app", most=50_000).distinct()
    bullet = F.concat_ws(" ", d.chosen(OPENERS, F.col("line") + F.col("app")), "node", F.concat(F.lit("and cut cost by "), F.col("line").cast("string"), F.lit("0%")))
    said = F.concat(F.col("node"), F.lit(" cut cost by "), F.col("line").cast("string"), F.lit("0%"))

    def ordered(when: Column, value: Column) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("line", "node", value.alias("v"))))), lambda x: x["v"])

    each = f.groupBy("app").agg(
        ordered(F.col("line") != 3, said).alias("said"), ordered(F.col("line") != 5, bullet).alias("bullets"),
        F.array_sort(F.collect_set(F.when(F.col("line") <= 5, F.lower("node")))).alias("own"),
    )
    # Requirements are taken apart once a distinct keyword, not once a row.
    text, kw = F.concat(F.lit("3+ years of experience with "), F.col("name")), F.col("name").alias("kw")
    apart = src.lookup(d.keyword_names(t).select(kw, sc.topic_words(text).alias("words"), sc.technologies(text, 100).alias("terms")))
    asked = d.keywords(t).join(apart, "kw", "left").groupBy("app").agg(F.array_sort(F.collect_list(F.struct("req", "part", "pos", "words", "terms"))).alias("l"), F.array_sort(F.collect_set(F.lower("kw"))).alias("wanted"))
    terms = F.slice(F.array_distinct(F.flatten(F.transform("l", lambda x: x["terms"]))), 1, 15)
    asked = asked.select("app", "wanted", F.transform("l", lambda x: x["words"]).alias("req_words"), terms.alias("req_terms"))
    roles = d.roles(t).select(F.col("ordinal").alias("app"), "company", "title", F.floor((F.col("start_m") - 1) / 12).alias("yr"))
    rows = roles.join(each, "app", "left").join(asked, "app", "left")
    none, app = F.array().cast("array<string>"), F.col("app")
    req_words = F.coalesce("req_words", F.array().cast("array<array<string>>")).alias("req_words")
    source = F.lower(F.concat(F.concat_ws(" ", "company", "title", F.col("yr").cast("string")), F.lit(" "), F.array_join(F.coalesce("said", none), "; ")))
    made_company = F.when(app % 6 == 0, d.chosen(d.COMPANIES, app)).when(app % 4 == 0, F.concat("company", F.lit(", Berlin"))).otherwise(F.col("company"))
    out = rows.select(
        "app", source.alias("source"), F.coalesce("bullets", none).alias("bullets"), "title", req_words, F.coalesce("req_terms", none).alias("req_terms"),
        F.when(app % 3 == 0, F.coalesce("wanted", none)).otherwise(F.coalesce("own", none)).alias("skills"), F.when(app % 9 == 0, "").otherwise(F.col("title")).alias("summary"),
        made_company.alias("company"), F.when(app % 7 == 0, None).when(app % 5 == 0, F.col("yr") + 3).otherwise(F.col("yr")).alias("yr"),
    )
    made = F.lower(F.concat_ws(" ", "summary", "company", "title", F.array_join("skills", " "), F.array_join("bullets", " ")))
    return bound(out.withColumn("made", made), "app")


def bound(rows: DataFrame, key: str) -> DataFrame:
    """The rows with their columns computed: a generator keeps them from being computed anew wherever a check names them.

    The key stands beside it, so that rows that are dealt by it aren't dealt again.
    """
    return rows.select(key, F.inline(F.array(F.struct(*[c for c in rows.columns if c != key]))))


def alternation(words) -> str:
    return "|".join(words)


def s_words(x: str) -> str:
    fill = ", ".join(f"'{w}'" for w in sc.FILLER)
    return f"list_filter(list_transform(regexp_split_to_array({x}, '[\\s/,()]+'), lambda w: lower(regexp_replace(w, '[^a-zA-Z0-9+#.-]', '', 'g'))), lambda w: length(w) > 2 AND w NOT IN ({fill}) AND NOT regexp_matches(w, '^[0-9]+[-+]?$'))"


def s_addressed(req: str, text: str) -> str:
    words = s_words(req)
    hits = f"len(list_filter({words}, lambda w: contains({text}, w)))"
    return f"(CASE WHEN len({words}) = 0 THEN TRUE WHEN len({words}) <= 2 THEN {hits} >= 1 ELSE {hits} >= 2 END)"


def s_held(term: str, text: str, cut: str = "[\\s/,()-]+") -> str:
    return f"(contains({text}, {term}) OR len(list_filter(regexp_split_to_array({term}, '{cut}'), lambda w: length(w) > 2 AND contains({text}, w))) > 0)"


def s_share(part: str, whole: str) -> str:
    return f"(CASE WHEN {whole} > 0 THEN ({part}) / ({whole}) ELSE 1.0 END)"


def s_numbers(x: str) -> str:
    return "list_distinct(list_concat(" + ", ".join(f"regexp_extract_all(lower({x}), '{p}')" for p in sc.NUMBERS) + "))"


def s_technologies(x: str, most: int = 15) -> str:
    # In order of occurrence: DuckDB's list_distinct has no order of its own.
    found = f"regexp_extract_all(lower({x}), '\\b({alternation(sc.TECHNOLOGIES)})\\b')"
    return f"list_filter({found}, lambda v, i: list_position({found}, v) = i)[1:{most}]"


SHORT = f"length(source) < {sc.LEAST_SOURCE}"
TERMS = s_technologies("array_to_string(reqs, ' ')")
ASKED = f"list_filter(reqs, lambda r: {SHORT} OR {s_addressed('r', 'source')})"
KNOWN = f"list_filter({TERMS}, lambda x: {SHORT} OR {s_held('x', 'source')})"
COVER = f"""CASE WHEN len({ASKED}) + len({KNOWN}) > 0 THEN {s_share(f"len(list_filter({ASKED}, lambda r: {s_addressed('r', 'made')}))", f"len({ASKED})")} * 0.7 + {s_share(f"len(list_filter({KNOWN}, lambda x: {s_held('x', 'made')}))", f"len({KNOWN})")} * 0.3 ELSE 1.0 END"""
BULLET_TECH = s_technologies("array_to_string(bullets, ' \n ')", 100)
SKILL_CUT = "[\\s/,()]+"
IN_SOURCE = f"list_filter(skills, lambda s: {s_held('s', 'source', SKILL_CUT)})"
BOTH_NUMBERS = f"len(list_intersect({s_numbers('source')}, {s_numbers('made')}))"
VERB_LIST = ", ".join(f"'{v}'" for v in sc.VERBS)
FIRST_WORD = "regexp_replace(lower(regexp_split_to_array(regexp_replace(regexp_replace(trim(b), '^[A-Z][A-Za-z .&''()-]*:\\s+', ''), '^\\([^)]+\\)[:,]?\\s+', ''), '\\s')[1]), '[^a-z-]', '', 'g')"
VERB = f"({FIRST_WORD} IN ({VERB_LIST}) OR replace({FIRST_WORD}, '-', '') IN ({VERB_LIST}) OR regexp_replace({FIRST_WORD}, '^co-', '') IN ({VERB_LIST}))"
MISSING = "(CAST(summary = '' AS INT) + CAST(coalesce(company, '') = '' AS INT) + CAST(coalesce(title, '') = '' AS INT) + CAST(yr IS NULL AS INT) + CAST(len(skills) = 0 AS INT) + CAST(len(bullets) = 0 AS INT))"
CORE = "trim(regexp_replace(trim(regexp_replace(lower(company), '\\s*[,–-].*$', '')), '\\s+(corp|corporation|inc|llc|ltd|limited|gmbh|plc|co)\\.?$', ''))"
KNOWN_COMPANY = f"((length(trim(lower(company))) >= 3 AND contains(source, trim(lower(company)))) OR (length({CORE}) >= 3 AND contains(source, {CORE})))"
#: Of each check: its SQL score, what passes, and whether it is a gate.
CV_CHECKS = {
    "requirements": (COVER, "score >= 0.55", False),
    "no_fabrication": (f"CASE WHEN {SHORT} THEN 1.0 ELSE {s_share(f'len({IN_SOURCE})', 'len(skills)')} END", "score >= 0.85", True),
    "metrics": (s_share(BOTH_NUMBERS, f"len({s_numbers('source')})"), "score >= 0.3", False),
    "word_count": ("CASE WHEN len(regexp_split_to_array(made, '\\s+')) <= 800 THEN 1.0 ELSE greatest(0.0, 1 - (len(regexp_split_to_array(made, '\\s+')) - 800) / 800) END", "score = 1", False),
    "no_fab_tech": (f"CASE WHEN {SHORT} THEN 1.0 ELSE {s_share(f'len(list_filter({BULLET_TECH}, lambda x: contains(source, x)))', f'len({BULLET_TECH})')} END", "score >= 1", True),
    "action_verbs": (s_share(f"len(list_filter(bullets, lambda b: {VERB}))", "len(bullets)"), "score >= 0.5", False),
    "structure": (f"greatest(0.0, 1 - {MISSING} * 0.15)", "score = 1", False),
    "facts": (f"CASE WHEN {SHORT} THEN 1.0 ELSE (CAST({KNOWN_COMPANY} AS INT) + CAST(coalesce(contains(source, CAST(yr AS VARCHAR)), FALSE) AS INT)) / (CASE WHEN yr IS NULL THEN 1 ELSE 2 END) END", "score >= 0.85", True),
}
CHECKS = CV + ", checks AS (" + " UNION ALL ".join(f"SELECT app, '{n}' AS check_name, score, {p} AS passed, {str(h).upper()} AS hard FROM (SELECT app, CAST({s} AS DOUBLE) AS score FROM c)" for n, (s, p, h) in CV_CHECKS.items()) + ")"


def cv_checks() -> dict[str, Column]:
    source, made, bullets, skills = (F.col(c) for c in ("source", "made", "bullets", "skills"))
    year = F.coalesce(F.col("yr").cast("string"), F.lit(""))
    return {
        "requirements": sc.words_covered(F.col("req_words"), F.col("req_terms"), source, made),
        "no_fabrication": sc.no_fabrication(skills, source),
        "metrics": sc.metrics_kept(source, made),
        "word_count": sc.word_count(made),
        "no_fab_tech": sc.no_new_technologies(bullets, source),
        "action_verbs": sc.action_verbs(bullets),
        "structure": sc.structure(F.col("summary"), F.col("company"), F.col("title"), year, skills, bullets),
        "facts": sc.facts_kept(F.col("company"), F.col("yr"), source),
    }


def long_checks(rows: DataFrame, checks: dict[str, Column], *keys: str) -> DataFrame:
    """A row for each key and check: ``check_name``, ``score``, ``passed`` and ``hard``."""
    named = F.array(*[F.struct(F.lit(n).alias("check_name"), c.alias("r")) for n, c in checks.items()])
    return rows.select(*keys, F.explode(named).alias("x")).select(*keys, "x.check_name", "x.r.score", "x.r.passed", "x.r.hard")


def cv_scores(t: Tables) -> DataFrame:
    return long_checks(generated(t), cv_checks(), "app")


def _one_check(name: str, check: str) -> None:
    def build(t: Tables) -> DataFrame:
        return long_checks(generated(t), {check: cv_checks()[check]}, "app").select("app", F.round("score", 6).alias("score"), "passed")

    query(name, f"{CHECKS} SELECT app, round(score, 6) AS score, passed FROM checks WHERE check_name = '{check}'")(build)


for _check in CV_CHECKS:
    _one_check(f"sc_{_check}", _check)


@query("sc_cv_scorecard", f"{CHECKS} SELECT app, check_name, round(score, 6) AS score, passed FROM checks")
def sc_cv_scorecard(t: Tables) -> DataFrame:
    return cv_scores(t).select("app", "check_name", F.round("score", 6).alias("score"), "passed")


GATED = "bool_and(passed OR NOT hard) AND avg(score) FILTER (NOT hard) >= 0.5"


@query("agg_gate_result", f"{CHECKS} SELECT app, {GATED} AS passed, round(avg(score), 6) AS mean FROM checks GROUP BY app")
def agg_gate_result(t: Tables) -> DataFrame:
    """All gates pass and the others' mean is 0.5 or more; beside it the mean of all."""
    return cv_scores(t).groupBy("app").agg(gate().alias("passed"), F.round(F.avg("score"), 6).alias("mean"))


def gate() -> Column:
    return F.bool_and(F.col("passed") | ~F.col("hard")) & (F.avg(F.when(~F.col("hard"), F.col("score"))) >= 0.5)


@query(
    "agg_scorecards",
    f"""{CHECKS}, p AS (SELECT app, avg(CAST(passed AS INT)) >= 0.75 AS ok FROM checks GROUP BY app), n AS (SELECT check_name, round(avg(score), 6) AS mean, count(*) FILTER (NOT passed) AS n_failed FROM checks GROUP BY check_name)
    SELECT n.*, (SELECT count(*) FILTER (ok) FROM p) AS pairs_ok, (SELECT avg(CAST(ok AS INT)) >= 0.7 FROM p) AS passed FROM n""",
)
def agg_scorecards(t: Tables) -> DataFrame:
    """A pair passes with three quarters of its checks, all with 70 % of the pairs; each check's mean and failures."""
    ok = F.avg(F.col("passed").cast("int")) >= 0.75
    sums = tallied(cv_scores(t), ok, F.lit(None))
    total = sums.where("check_name IS NULL").select(F.col("n_passed").alias("pairs_ok"), (F.col("n_passed") / (F.col("n_passed") + F.col("n_failed")) >= 0.7).alias("passed"))
    each = sums.where("check_name IS NOT NULL").select("check_name", F.round(F.col("s") / F.col("n"), 6).alias("mean"), "n_failed")
    return each.join(F.broadcast(total))


def tallied(checks: DataFrame, ok: Column, mean: Column, *by: Column) -> DataFrame:
    """Sums of each check, and of the pairs (``check_name`` null: whether they are ``ok``, and their ``mean``), in one pass.

    ``n_passed``, ``n_failed``, and of the scores ``n``, ``s`` and ``q``, their number, sum and sum of squares. Few rows, computed once.
    """
    result = F.struct("check_name", "score", "passed")
    pairs = checks.groupBy("app").agg(F.collect_list(result).alias("l"), ok.alias("ok"), mean.cast("double").alias("mean"))
    pair = F.struct(F.lit(None).cast("string").alias("check_name"), F.col("mean").alias("score"), F.col("ok").alias("passed"))
    rows = pairs.select(*by, F.inline(F.concat("l", F.array(pair))))
    score, passed = F.col("score"), F.col("passed")
    keys = ["check_name", *[c for c in rows.columns if c not in ("check_name", "score", "passed")]]
    return src.computed(rows.groupBy(*keys).agg(
        F.count_if(passed).alias("n_passed"), F.count_if(~passed).alias("n_failed"), F.count(score).alias("n"), F.sum(score).alias("s"), F.sum(score * score).alias("q"),
    ))


@query("sc_readiness", f"{CHECKS} SELECT app, coalesce(string_agg(check_name, ',' ORDER BY check_name) FILTER (NOT passed AND hard), '') AS blockers, coalesce(string_agg(check_name, ',' ORDER BY check_name) FILTER (NOT passed AND NOT hard), '') AS warnings, count(*) FILTER (NOT passed AND hard) = 0 AS ready FROM checks GROUP BY app")
def sc_readiness(t: Tables) -> DataFrame:
    def failed(hard: Column) -> Column:
        return F.concat_ws(",", F.array_sort(F.collect_list(F.when(~F.col("passed") & hard, F.col("check_name")))))

    hard = F.col("hard")
    return cv_scores(t).groupBy("app").agg(failed(hard).alias("blockers"), failed(~hard).alias("warnings"), (F.count_if(~F.col("passed") & hard) == 0).alias("ready"))


@query(
    "agg_failure_breakdown",
    f"""{CHECKS} SELECT CASE WHEN app % 5 = 0 THEN 'holdout' ELSE 'train' END AS split, check_name, count(*) FILTER (NOT passed) AS n_failed, round(avg(score), 6) AS mean, round(avg(CAST(passed AS INT)), 6) AS pass_rate
    FROM checks GROUP BY GROUPING SETS ((split, check_name), (split))""",
)
def agg_failure_breakdown(t: Tables) -> DataFrame:
    rows = cv_scores(t).withColumn("split", F.when(F.col("app") % 5 == 0, "holdout").otherwise("train"))
    n, mean, rate = F.count_if(~F.col("passed")), F.round(F.avg("score"), 6), F.round(F.avg(F.col("passed").cast("int")), 6)
    return rows.groupingSets([[F.col("split"), F.col("check_name")], [F.col("split")]], "split", "check_name").agg(n.alias("n_failed"), mean.alias("mean"), rate.alias("pass_rate"))


# --- postings: what was parsed against what was expected ---

JD = f"""{d.with_tables('keywords')},
items AS (SELECT app, req, part, string_agg(kw, ' and ' ORDER BY pos) AS both_kw, min(kw) AS one_kw FROM keywords GROUP BY app, req, part),
jd AS (SELECT app, list(struct_pack("text" := 'Experience with ' || both_kw, "type" := CASE WHEN part % 3 = 0 THEN 'preferred' ELSE 'must-have' END) ORDER BY req, part) AS expected,
  coalesce(list(struct_pack("text" := CASE WHEN part % 4 = 0 THEN 'Solid ' || one_kw || ' practice' WHEN part % 7 = 0 THEN 'Own transport' ELSE 'Experience with ' || both_kw END, "type" := CASE WHEN part % 5 = 0 THEN 'required' WHEN part % 3 = 0 THEN 'optional' ELSE 'hard' END) ORDER BY req, part) FILTER (part % 6 <> 1), []) AS parsed FROM items GROUP BY app),
j AS (SELECT app, expected, parsed, {d.sql_chosen(d.COMPANIES, 'app')} AS want_company, CASE WHEN app % 11 = 0 THEN NULL ELSE {d.sql_chosen(d.COMPANIES, 'app + app % 3')} END AS company, {d.sql_chosen(d.TITLES, 'app')} AS want_title, {d.sql_chosen(d.TITLES, 'app + app % 2')} AS title,
  ([{', '.join(f"'{x}'" for x in ('Berlin, Germany', 'Berlin', 'Remote', 'Bern', ''))}])[app % 5 + 1] AS want_location, ([{', '.join(f"'{x}'" for x in ('Berlin, Germany', 'Berlin', 'Remote', 'Bern', ''))}])[(app * 3) % 5 + 1] AS location,
  CASE WHEN app % 8 = 0 THEN NULL ELSE app % 6 END AS want_min, CASE WHEN app % 9 = 0 THEN NULL ELSE app % 6 + app % 3 END AS min_years, app % 6 + 4 AS want_max, CASE WHEN app % 5 = 0 THEN NULL ELSE app % 6 + 4 - app % 2 END AS max_years FROM jd)"""
PLACES = ("Berlin, Germany", "Berlin", "Remote", "Bern", "")


#: The fields that are compared as texts, with the least score that passes.
FUZZY = {"company": 0.4, "title": 0.4, "location": 0.45}


def posting_fields(a: Column) -> dict[str, Column]:
    """What was parsed of a posting's fields, and expected (``want_`` columns)."""
    return {
        "want_min": F.when(a % 8 != 0, a % 6), "min_years": F.when(a % 9 != 0, a % 6 + a % 3), "want_max": a % 6 + 4, "max_years": F.when(a % 5 != 0, a % 6 + 4 - a % 2),
        "want_company": d.chosen(d.COMPANIES, a), "company": F.when(a % 11 != 0, d.chosen(d.COMPANIES, a + a % 3)),
        "want_title": d.chosen(d.TITLES, a), "title": d.chosen(d.TITLES, a + a % 2), "want_location": d.chosen(PLACES, a), "location": d.chosen(PLACES, a * 3),
    }


def similar_fields(t: Tables) -> DataFrame:
    """Values that were parsed and expected of a field, compared once a distinct pair, as postings have few."""
    of = posting_fields(F.col("o_orderkey"))
    pair = [F.struct(F.lit(n).alias("field"), F.lit(least).alias("least"), *_pair(of, n)) for n, least in FUZZY.items()]
    pairs = t.orders.select(F.inline(F.array(*pair))).distinct()
    return src.lookup(pairs.select("field", "value", "wanted", sc.fuzzy_field(F.col("value"), F.col("wanted"), F.col("least")).alias("r")))


def _pair(of: dict[str, Column], name: str) -> list[Column]:
    return [F.coalesce(of[c], F.lit("")).alias(alias) for c, alias in ((name, "value"), (f"want_{name}", "wanted"))]


def with_similar(rows: DataFrame, t: Tables, *names: str) -> DataFrame:
    """The postings with the results (``company_r`` and so on) of the named fields."""
    similar, of = similar_fields(t), posting_fields(F.col("app"))
    for n in names:
        value, wanted = _pair(of, n)
        found = similar.where(F.col("field") == n).select("value", "wanted", F.col("r").alias(f"{n}_r"))
        rows = rows.withColumns({"value": value, "wanted": wanted}).join(found, ["value", "wanted"], "left").drop("value", "wanted")
    return rows


def postings(t: Tables) -> DataFrame:
    """The requirements of each posting, ``expected`` and ``parsed``, in order."""
    # A part is asked for once an owner; a number stands for the owners.
    items = d.requirements(t).groupBy("app", "req", "part").agg(F.count(F.lit(1)).cast("int").alias("n"))
    n, part, (one, two) = F.col("n"), F.col("part"), d.asked_words(F.col("part"))
    named = F.concat(F.lit("Experience with "), F.repeat(F.concat(one, F.lit(" and ")), n), F.repeat(F.concat(two, F.lit(" and ")), n - 1), two)
    both = F.when(part.isNotNull(), named)
    want = F.struct(both.alias("text"), F.when(part % 3 == 0, "preferred").otherwise("must-have").alias("type"))
    text = F.when(part % 4 == 0, F.concat(F.lit("Solid "), F.least(one, two), F.lit(" practice"))).when(part % 7 == 0, "Own transport").otherwise(both)
    got = F.struct(text.alias("text"), F.when(part % 5 == 0, "required").when(part % 3 == 0, "optional").otherwise("hard").alias("type"))
    said = bound(items.select("app", F.col("req").isNull().alias("last"), "req", "part", want.alias("want"), F.when(part % 6 != 1, got).alias("got")), "app")
    rows = said.groupBy("app").agg(F.sort_array(F.collect_list(F.struct("last", "req", "part", "want", "got"))).alias("l"))
    return bound(rows.select("app", F.col("l")["want"].alias("expected"), F.array_compact(F.col("l")["got"]).alias("parsed")), "app")


def s_similar(pairs: str) -> str:
    """``sims`` (p, e, jw): Jaro-Winkler of the pairs of a table, the matching done by a fold over the first text's letters."""
    window = "greatest(0, greatest(length(p), length(e)) // 2 - 1)"
    free = f"list_filter(range(greatest(1, i - {window}), least(length(e), i + {window}) + 1), lambda j: e[j] = p[i] AND NOT list_contains(acc, j))[1]"
    same = " + ".join(f"CASE WHEN least(length(p), length(e)) >= {i} AND left(p, {i}) = left(e, {i}) THEN 1 ELSE 0 END" for i in range(1, 5))
    return f"""folded AS (SELECT p, e, list_reduce(list_prepend([]::BIGINT[], list_transform(range(1, length(p) + 1), lambda i: [i])), lambda acc, x: list_append(acc, coalesce({free.replace('p[i]', 'p[x[1]]').replace('i - ', 'x[1] - ').replace('i + ', 'x[1] + ')}, 0))) AS m FROM {pairs}),
matched AS (SELECT p, e, list_transform(list_filter(range(1, length(p) + 1), lambda i: m[i] > 0), lambda i: p[i]) AS x, list_transform(list_sort(list_filter(m, lambda v: v > 0)), lambda j: e[j]) AS y FROM folded),
jaro AS (SELECT p, e, CASE WHEN len(x) = 0 THEN 0.0 ELSE (len(x) / length(p) + len(x) / length(e) + (len(x) - len(list_filter(range(1, len(x) + 1), lambda k: x[k] <> y[k])) / 2) / len(x)) / 3 END AS j FROM matched),
sims AS (SELECT p, e, j + ({same}) * 0.1 * (1 - j) AS jw FROM jaro)"""


def s_fuzzy(parsed: str, expected: str, threshold: float) -> tuple[str, str]:
    p, e = (f"trim(lower(coalesce({x}, '')))" for x in (parsed, expected))
    words = [f"list_distinct(list_filter(regexp_split_to_array({x}, '[\\s,/-]+'), lambda w: length(w) >= 2))" for x in (p, e)]
    common = f"coalesce(len(list_intersect({words[0]}, {words[1]})) / nullif(len(list_distinct(list_concat({words[0]}, {words[1]}))), 0), 0)"
    best = f"greatest({common}, 1 - levenshtein({p}, {e}) / greatest(length({p}), length({e})), jw_{parsed})"
    score = f"CASE WHEN {p} = '' AND {e} = '' THEN 1.0 WHEN {e} = '' THEN 0.5 WHEN {p} = '' THEN 0.0 WHEN {p} = {e} THEN 1.0 WHEN contains({p}, {e}) OR contains({e}, {p}) THEN 0.9 ELSE {best} END"
    return score, f"{e} = '' OR ({p} <> '' AND (contains({p}, {e}) OR contains({e}, {p}) OR {best} >= {threshold}))"


def s_numeric(p: str, e: str) -> tuple[str, str]:
    score = f"CASE WHEN {p} IS NULL AND {e} IS NULL THEN 1.0 WHEN {p} IS NULL OR {e} IS NULL THEN 0.0 WHEN {p} = {e} THEN 1.0 WHEN abs({p} - {e}) <= 1 THEN 0.8 ELSE 0.0 END"
    return score, f"{score} >= 0.8"


def s_item(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({x}), '[\\s/,()]+'), lambda w: length(w) > 3)"


def s_shares(item: str, text: str, any_of_two: bool = True) -> str:
    words = s_item(item)
    hits = f"len(list_filter({words}, lambda w: contains(lower({text}), w)))"
    return f"(CASE WHEN len({words}) <= 2 THEN {hits} >= 1 ELSE {hits} >= 2 END)" if any_of_two else f"({hits} >= least(len({words}), 2))"


def s_found(items: str, others: str, threshold: float, any_of_two: bool = True) -> tuple[str, str]:
    met = f"list_filter({items}, lambda i: len({s_item('i')}) = 0 OR len(list_filter({others}, lambda o: {s_shares('i', 'o', any_of_two)})) > 0)"
    score = s_share(f"len({met})", f"len({items})")
    return score, f"{score} >= {threshold}"


def s_type(x: str) -> str:
    low = f"regexp_replace(lower({x}), '[\\s-]', '_', 'g')"
    must, nice = (", ".join(f"'{w}'" for w in words) for words in (sc.MUST, sc.NICE))
    return f"(CASE WHEN {low} IN ({must}) THEN 'must_have' WHEN {low} IN ({nice}) THEN 'nice_to_have' ELSE {low} END)"


TEXTS = {c: f"list_transform({c}, lambda z: z.text)" for c in ("expected", "parsed")}
HIT = f"list_filter(parsed, lambda p: {s_shares('e.text', 'p.text')})[1]"
MATCHED = f"list_filter(expected, lambda e: {HIT} IS NOT NULL)"
RIGHT = f"list_sum(list_transform({MATCHED}, lambda e: CASE WHEN {s_type(HIT + '.type')} = {s_type('e.type')} THEN 1.0 WHEN {s_type(HIT + '.type')} = 'must_have' AND {s_type('e.type')} = 'nice_to_have' THEN 0.5 ELSE 0.0 END))"
TYPE_SCORE = f"CASE WHEN len({MATCHED}) > 0 THEN CAST({RIGHT} AS DOUBLE) / len({MATCHED}) ELSE 1.0 END"
JD_CHECKS = {
    "company": s_fuzzy("company", "want_company", 0.4),
    "title": s_fuzzy("title", "want_title", 0.4),
    "location": s_fuzzy("location", "want_location", 0.45),
    "years_min": s_numeric("min_years", "want_min"),
    "years_max": s_numeric("max_years", "want_max"),
    "req_recall": s_found(TEXTS["expected"], TEXTS["parsed"], 0.4),
    "req_precision": s_found(TEXTS["parsed"], TEXTS["expected"], 0.85),
    "req_types": (TYPE_SCORE, f"{TYPE_SCORE} >= 0.8"),
    "resp_recall": s_found(TEXTS["expected"], TEXTS["parsed"], 0.45, False),
}
NORMAL = "trim(lower(coalesce({0}, '')))"
FIELDS = ("company", "title", "location")
JD += (
    ", pairs AS (" + " UNION ".join(f"SELECT {NORMAL.format(c)} AS p, {NORMAL.format('want_' + c)} AS e FROM j" for c in FIELDS) + "), " + s_similar("pairs")
    + ", k AS (SELECT j.*, " + ", ".join(f"{c}_sim.jw AS jw_{c}" for c in FIELDS) + " FROM j "
    + " ".join(f"JOIN sims {c}_sim ON {c}_sim.p = {NORMAL.format(c)} AND {c}_sim.e = {NORMAL.format('want_' + c)}" for c in FIELDS) + ")"
)
JD_SCORES = JD + ", checks AS (" + " UNION ALL ".join(f"SELECT app, '{n}' AS check_name, CAST({s} AS DOUBLE) AS score, {p} AS passed FROM k" for n, (s, p) in JD_CHECKS.items()) + ")"


def jd_checks() -> dict[str, Column]:
    parsed, expected, of = F.col("parsed"), F.col("expected"), posting_fields(F.col("app"))
    return {n: F.col(f"{n}_r") for n in FUZZY} | {
        "years_min": sc.numeric_field(of["min_years"], of["want_min"]),
        "years_max": sc.numeric_field(of["max_years"], of["want_max"]),
        "req_recall": sc.found_share(expected["text"], parsed["text"], 0.4),
        "req_precision": sc.found_share(parsed["text"], expected["text"], 0.85),
        "req_types": sc.types_right(expected, parsed),
        "resp_recall": sc.found_share(expected["text"], parsed["text"], 0.45, any_of_two=False),
    }


def jd_scores(t: Tables, *names: str) -> DataFrame:
    """The named checks of each posting, or all; requirements are read only where a check needs them."""
    checks = {n: c for n, c in jd_checks().items() if n in (names or JD_CHECKS)}
    rows = postings(t) if any(n.startswith("re") for n in checks) else d.requirements(t).select("app").distinct()
    fuzzy = [n for n in FUZZY if n in checks]
    return long_checks(with_similar(rows, t, *fuzzy) if fuzzy else rows, checks, "app")


def _jd_check(name: str) -> None:
    def build(t: Tables) -> DataFrame:
        return jd_scores(t, name).select("app", F.round("score", 6).alias("score"), "passed")

    query(f"sc_jd_{name}", f"{JD_SCORES} SELECT app, round(score, 6) AS score, passed FROM checks WHERE check_name = '{name}'")(build)


for _check in JD_CHECKS:
    _jd_check(_check)


@query("sc_jd_scorecard", f"{JD_SCORES} SELECT app, round(avg(score), 6) AS mean, count(*) FILTER (passed) AS n_passed, avg(CAST(passed AS INT)) >= 0.75 AS passed FROM checks GROUP BY app")
def sc_jd_scorecard(t: Tables) -> DataFrame:
    passed = F.col("passed").cast("int")
    return jd_scores(t).groupBy("app").agg(F.round(F.avg("score"), 6).alias("mean"), F.count_if("passed").alias("n_passed"), (F.avg(passed) >= 0.75).alias("passed"))


@query(
    "agg_baseline_report",
    f"""{CHECKS.replace('WITH ', 'WITH RECURSIVE ', 1)}, pr AS (SELECT app, app % 2 = 1 AS baseline, {GATED} AS ok, avg(score) FILTER (NOT hard) AS mean FROM checks GROUP BY app),
    each AS (SELECT app % 2 = 1 AS baseline, check_name, round(avg(score), 6) AS mean, count(*) FILTER (NOT passed) AS n_failed FROM checks GROUP BY ALL),
    one AS (SELECT 0 AS z, count(*) FILTER (baseline) AS n, count(*) FILTER (baseline AND ok) AS s, avg(CAST(ok AS INT)) FILTER (baseline) AS base_rate, avg(CAST(ok AS INT)) FILTER (NOT baseline) AS top_rate FROM pr),
    {s_beta_ci('one', 'z')}, zero AS (SELECT 0 AS z, baseline, mean FROM pr), {s_two_groups('zero', 'z', 'baseline', 'mean')}
    SELECT c.check_name, c.mean AS ceiling_mean, b.mean AS baseline_mean, b.n_failed, o.s AS n_passed, o.n AS n_pairs, round(100 * (o.top_rate - o.base_rate), 4) AS gap_pp, round(ci.low, 6) AS ci_low, round(ci.high, 6) AS ci_high,
      round(fs.f, 4) AS f, round({s_f_pvalue('fs.f', '(fs.n - 2)')}, 6) AS p_value, CASE WHEN o.base_rate > 0.9 THEN 'high' WHEN o.base_rate > 0.5 THEN 'moderate' ELSE 'low' END AS level
    FROM each c JOIN each b ON b.check_name = c.check_name AND b.baseline AND NOT c.baseline, one o, ci, fs""",
)
def agg_baseline_report(t: Tables) -> DataFrame:
    """Two groups of pairs, ceiling and baseline: each check's means and failures; the pass rates' gap, the baseline's
    credible interval, and whether the mean scores differ, by an analysis of variance."""
    soft = F.avg(F.when(~F.col("hard"), F.col("score")))
    sums = tallied(cv_scores(t), gate(), soft, (F.col("app") % 2 == 1).alias("base"))
    base, pairs = F.col("base"), sums.where("check_name IS NULL").withColumn("k", F.lit(0)).withColumn("all", F.col("n_passed") + F.col("n_failed"))

    def of(which: Column, name: str) -> Column:
        return F.coalesce(F.sum(F.when(which, F.col(name))), F.lit(0))

    def rate(which: Column) -> Column:
        return of(which, "n_passed") / F.nullif(of(which, "all"), F.lit(0))

    one = pairs.groupBy("k").agg(of(base, "all").alias("n_pairs"), of(base, "n_passed").alias("n_passed"), rate(base).alias("base_rate"), rate(~base).alias("top_rate"))
    one = one.withColumn("ci", stats.beta_interval("n_passed", "n_pairs"))
    grouped = pairs.groupBy("k").agg(*[of(which, name).alias(f"{name}{i}") for i, which in ((1, ~base), (2, base)) for name in "nsq"])
    apart = stats.groups_apart(grouped, ["k"]).select("k", F.round("f", 4).alias("f"), F.round("p_value", 6).alias("p_value"))
    level = F.when(F.col("base_rate") > 0.9, "high").when(F.col("base_rate") > 0.5, "moderate").otherwise("low")
    total = one.join(F.broadcast(apart), "k").select(
        "n_passed", "n_pairs", F.round(100 * (F.col("top_rate") - F.col("base_rate")), 4).alias("gap_pp"), F.round("ci.low", 6).alias("ci_low"),
        F.round("ci.high", 6).alias("ci_high"), "f", "p_value", level.alias("level"),
    )
    mean = {n: F.round(F.sum(F.when(which, F.col("s"))) / F.sum(F.when(which, F.col("n"))), 6).alias(n) for n, which in (("ceiling_mean", ~base), ("baseline_mean", base))}
    means = sums.where("check_name IS NOT NULL").groupBy("check_name").agg(*mean.values(), of(base, "n_failed").alias("n_failed"))
    return means.join(F.broadcast(total))


RUNS = f"{CHECKS}, runs AS (SELECT app // 50 AS run, {GATED} AS gate, avg(score) AS mean, count(*) FILTER (passed) AS n_passed FROM checks GROUP BY run), s AS (SELECT run, mean, n_passed, gate, lag(mean) OVER w AS old_mean, lag(n_passed) OVER w AS old_n, lag(gate) OVER w AS old_gate FROM runs WINDOW w AS (ORDER BY run))"


@query(
    "sc_compare",
    f"""{RUNS} SELECT run, CASE WHEN NOT gate AND old_gate THEN 'incumbent' WHEN gate AND NOT old_gate THEN 'candidate' WHEN mean - old_mean > 0.01 THEN 'candidate' WHEN old_mean - mean > 0.01 THEN 'incumbent'
    WHEN n_passed > old_n THEN 'candidate' WHEN n_passed < old_n THEN 'incumbent' WHEN mean - old_mean > 0.02 THEN 'candidate' ELSE 'incumbent' END AS winner FROM s WHERE old_mean IS NOT NULL""",
)
def sc_compare(t: Tables) -> DataFrame:
    """Each run of fifty applications against the one before: gate, mean, number of passes; the incumbent wins ties."""
    score, soft, each = F.col("score"), F.when(~F.col("hard"), F.col("score")), "app"
    sums = {"s": F.sum(score), "m": F.count(score), "soft_s": F.sum(soft), "soft_m": F.count(soft), "n": F.count_if("passed")}
    pairs = cv_scores(t).groupBy(each).agg(F.bool_and(F.col("passed") | ~F.col("hard")).alias("ok"), *[c.alias(n) for n, c in sums.items()])
    runs = pairs.groupBy(F.floor(F.col(each) / 50).alias("run")).agg(F.bool_and("ok").alias("ok"), *[F.sum(n).alias(n) for n in sums])
    runs = runs.select("run", (F.col("ok") & (F.col("soft_s") / F.col("soft_m") >= 0.5)).alias("gate"), (F.col("s") / F.col("m")).alias("mean"), "n")
    w = Window.orderBy("run")  # a row for each run
    s = runs.select("run", "gate", "mean", "n", *[F.lag(c).over(w).alias(f"old_{c}") for c in ("gate", "mean", "n")]).where("old_mean IS NOT NULL")
    gain, new, old = F.col("mean") - F.col("old_mean"), F.col("gate"), F.col("old_gate")
    rules = [(~new & old, "incumbent"), (new & ~old, "candidate"), (gain > 0.01, "candidate"), (gain < -0.01, "incumbent"), (F.col("n") > F.col("old_n"), "candidate"), (F.col("n") < F.col("old_n"), "incumbent"), (gain > 0.02, "candidate")]
    first = reduce(lambda done, rule: done.when(*rule), rules[1:], F.when(*rules[0]))
    return s.select("run", first.otherwise("incumbent").alias("winner"))


@query("sc_trial_all", f"{JD_SCORES} SELECT app, check_name, round(score, 6) AS score, passed FROM checks")
def sc_trial_all(t: Tables) -> DataFrame:
    return jd_scores(t).select("app", "check_name", F.round("score", 6).alias("score"), "passed")


@query(
    "fn_fuzzy_field",
    f"{JD} SELECT app, round({s_fuzzy('title', 'want_title', 0.4)[0]}, 6) AS score FROM k",
)
def fn_fuzzy_field(t: Tables) -> DataFrame:
    return jd_scores(t, "title").select("app", F.round("score", 6).alias("score"))


PAIR = f"{d.with_tables('roles')}, pairs AS (SELECT DISTINCT a.title AS p, b.title AS e FROM (SELECT DISTINCT title FROM roles) a JOIN (SELECT DISTINCT title FROM roles) b ON a.title <= b.title)"


@query("fn_jaro_winkler", f"{PAIR}, {s_similar('pairs')} SELECT p AS a, e AS b, round(jw, 6) AS sim FROM sims")
def fn_jaro_winkler(t: Tables) -> DataFrame:
    """Every pair of the few distinct titles."""
    names = d.roles(t).select("title").distinct()
    pairs = names.select(F.col("title").alias("a")).join(names.select(F.col("title").alias("b")), F.col("a") <= F.col("b"))
    return pairs.select("a", "b", F.round(stats.jaro_winkler_udf("a", "b"), 6).alias("sim"))
