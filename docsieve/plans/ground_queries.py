"""Values of parsed documents held against the documents' own texts, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.functions import grounding as gr
from docsieve.plans.registry import query
from docsieve.sources.tables import Tables

#: A parsed document of each text: fields with paths, of which some are changed, some empty, some made up.
PARSED = """src AS (SELECT doc_id, coalesce(text, '') || CASE WHEN doc_id % 2 = 0 THEN chr(10) || 'C S E P (2018 - 19)' ELSE '' END AS source, regexp_split_to_array(trim(coalesce(text, '')), '\\s+') AS w FROM documents),
v AS (SELECT doc_id, source, coalesce(w[1], '') AS a, coalesce(w[2], '') AS b, coalesce(w[3], '') AS c, coalesce(w[4], '') AS d FROM src),
fields AS (SELECT doc_id, source, unnest([
  {'path': 'name', 'value': lower(a || ' ' || b || ' ' || c)}, {'path': 'links[0]', 'value': 'https://' || b || '/'}, {'path': 'links[1]', 'value': 'present'},
  {'path': 'certificates[0].name', 'value': 'CSEP'}, {'path': 'certificates[0].year', 'value': '2019'}, {'path': 'roles[0].title', 'value': a || ' - ' || b || ','},
  {'path': 'roles[0].company', 'value': 'x' || substr(c, 2)}, {'path': 'roles[1].title', 'value': d || ' ' || b || ' ' || a}, {'path': 'roles[1].company', 'value': 'qqqqqqqq wwwwwwww'},
  {'path': 'skills[0]', 'value': 'ab'}, {'path': 'skills[1]', 'value': ''}, {'path': 'years_total', 'value': '7'}], recursive := true) FROM v)"""


def parsed_fields(t: Tables) -> DataFrame:
    """``doc_id``, ``source`` and its normal forms, and ``fields``, all of a document's paths and values, with these without marks.

    A document stays one row, so that its text isn't repeated for each field; a generator keeps the forms from
    being computed anew wherever a check names them.
    """
    text = F.coalesce("text", F.lit(""))
    more = F.when(F.col("doc_id") % 2 == 0, "\nC S E P (2018 - 19)").otherwise("")
    src = t.documents.select("doc_id", F.concat(text, more).alias("source"), F.slice(F.split(gr.trimmed_of(text), f"{gr.SPACE}+"), 1, 4).alias("w"))
    a, b, c, d = (F.coalesce(F.try_element_at("w", F.lit(i)), F.lit("")) for i in (1, 2, 3, 4))
    values = {
        "name": gr.lowered(F.concat_ws(" ", a, b, c)), "links[0]": F.concat(F.lit("https://"), b, F.lit("/")), "links[1]": F.lit("present"),
        "certificates[0].name": F.lit("CSEP"), "certificates[0].year": F.lit("2019"), "roles[0].title": F.concat(a, F.lit(" - "), b, F.lit(",")),
        "roles[0].company": F.concat(F.lit("x"), F.substr(c, F.lit(2))), "roles[1].title": F.concat_ws(" ", d, b, a), "roles[1].company": F.lit("qqqqqqqq wwwwwwww"),
        "skills[0]": F.lit("ab"), "skills[1]": F.lit(""), "years_total": F.lit("7"),
    }
    listed = src.withColumn("value", F.array(*values.values())).withColumn("path", F.array(*map(F.lit, values)))
    marked = listed.withColumn("unmarked", gr.all_without_marks(F.transform("value", gr.trimmed_of))).withColumn("norm", gr.normalised(F.col("source")))
    forms = F.struct(
        "source", gr.lowered(F.col("source")).alias("low"), "norm", gr.verified(F.col("source")).alias("plain"), gr.source_words(F.col("norm")).alias("words"),
        F.arrays_zip("path", "value", "unmarked").alias("fields"),
    )
    return marked.select("doc_id", F.inline(F.array(forms)))


def s_plain(x: str, accents: bool) -> str:
    low = f"lower({x})" if accents else f"lower(strip_accents({x}))"
    marks = gr.MARKS.replace("'", "''")
    return f"trim(regexp_replace(regexp_replace(regexp_replace({low}, '[-–—/\\\\]', ' ', 'g'), '{marks}', '', 'g'), '\\s+', ' ', 'g'))"


def s_all_words(value: str, source: str) -> str:
    words = f"list_filter(string_split({value}, ' '), lambda w: length(w) >= 3)"
    return f"(len({words}) >= 2 AND len(list_filter({words}, lambda w: NOT contains({source}, w))) = 0)"


NORMS = f"""{PARSED}, n AS (SELECT doc_id, path, value, trim(value) AS t, lower(trim(value)) AS low, source, lower(source) AS src_low, {s_plain('value', True)} AS plain, {s_plain('trim(value)', False)} AS norm FROM fields),
s AS (SELECT doc_id, norm AS src_norm, plain AS src_plain, list_distinct(list_filter(string_split(norm, ' '), lambda w: length(w) >= 3)) AS words FROM (SELECT DISTINCT doc_id, {s_plain('source', False)} AS norm, {s_plain('source', True)} AS plain FROM fields)),
f AS (SELECT n.*, src_norm, src_plain, words, regexp_replace(regexp_replace(low, '^https?://', ''), '/$', '') AS url, trim(regexp_replace(low, '(.)', '\\1 ', 'g')) AS apart, string_split(norm, ' ') AS parts FROM n JOIN s USING (doc_id))"""
NEAR = "len(list_filter(words, lambda w: levenshtein({0}, w) <= 2)) > 0"
EARLY = """length(t) < 3 OR contains(src_low, low) OR (starts_with(low, 'http') AND contains(src_low, url)) OR (length(t) <= 20 AND NOT contains(t, ' ') AND contains(src_low, apart)) OR (regexp_matches(t, '^[0-9]{4}$') AND regexp_matches(src_low, '[0-9]{4}\\s*[-–—]\\s*' || right(t, 2) || '([^0-9]|$)')) OR contains(src_norm, norm)"""
HOW = f"""CASE WHEN length(t) < 3 OR contains(src_low, low) THEN 'exact' WHEN starts_with(low, 'http') AND contains(src_low, url) THEN 'url' WHEN length(t) <= 20 AND NOT contains(t, ' ') AND contains(src_low, apart) THEN 'spaced'
 WHEN regexp_matches(t, '^[0-9]{{4}}$') AND regexp_matches(src_low, '[0-9]{{4}}\\s*[-–—]\\s*' || right(t, 2) || '([^0-9]|$)') THEN 'year' WHEN contains(src_norm, norm) THEN 'normalised'
 WHEN length(t) >= 5 AND length(norm) <= 40 AND ((len(parts) = 1 AND {NEAR.format('norm')}) OR (len(parts) BETWEEN 2 AND 4 AND len(list_filter(parts, lambda p: length(p) >= 3 AND NOT {NEAR.format('p')})) = 0)) THEN 'fuzzy'
 WHEN {s_all_words('norm', 'src_norm')} THEN 'words' ELSE 'none' END"""
FOUND = f"{NORMS}, g AS (SELECT doc_id, path, value, low, url, apart, t, src_low, {HOW} AS how FROM f)"
TEXT = "CASE how WHEN 'exact' THEN low WHEN 'url' THEN url WHEN 'spaced' THEN apart END"


def grounded_fields(t: Tables) -> DataFrame:
    low, norm, words = F.col("low"), F.col("norm"), F.col("words")
    hits = F.transform("fields", lambda f: F.struct(f["path"].alias("path"), f["value"].alias("value"), gr.grounded(f["value"], f["unmarked"], low, norm, words).alias("hit")))
    return parsed_fields(t).select("doc_id", F.inline(hits))


@query(
    "fn_ground_value",
    f"""WITH {FOUND} SELECT doc_id, path, how, CASE WHEN length(t) < 3 THEN 0 ELSE strpos(src_low, {TEXT}) - 1 END AS start, CASE WHEN length(t) < 3 THEN 0 ELSE strpos(src_low, {TEXT}) - 1 + length({TEXT}) END AS "end" FROM g""",
)
def fn_ground_value(t: Tables) -> DataFrame:
    return grounded_fields(t).select("doc_id", "path", "hit.how", "hit.start", "hit.end")


@query(
    "fn_field_exists",
    f"WITH {NORMS} SELECT doc_id, path, length(t) < 3 OR contains(src_low, lower(value)) OR contains(src_plain, plain) OR {s_all_words('plain', 'src_plain')} AS held FROM f",
)
def fn_field_exists(t: Tables) -> DataFrame:
    low, plain = F.col("low"), F.col("plain")
    held = F.transform("fields", lambda f: F.struct(f["path"].alias("path"), gr.field_exists(f["value"], low, plain).alias("held")))
    return parsed_fields(t).select("doc_id", F.inline(held))


#: Empty values and words for now aren't looked for; totals are derived, not read.
VERDICT_SQL = "CASE WHEN trim(value) = '' OR low IN ('present', 'current', 'now') THEN 'skipped' WHEN path = 'years_total' THEN 'derived' WHEN how = 'none' THEN 'ungrounded' ELSE 'grounded' END"


def verdicts(t: Tables) -> DataFrame:
    trimmed = gr.trimmed_of(F.col("value"))
    low = gr.lowered(trimmed)
    skipped = (trimmed == "") | low.isin("present", "current", "now")
    state = F.when(skipped, "skipped").when(F.col("path") == "years_total", "derived").when(F.col("hit.how") == "none", "ungrounded").otherwise("grounded")
    return grounded_fields(t).select("doc_id", "path", "value", "hit.how", state.alias("verdict"))


@query("fn_ground_document", f"WITH {FOUND} SELECT doc_id, path, value, how, {VERDICT_SQL} AS verdict FROM g")
def fn_ground_document(t: Tables) -> DataFrame:
    return verdicts(t)


@query(
    "agg_grounding_report",
    f"""WITH {FOUND}, x AS (SELECT doc_id, {VERDICT_SQL} AS verdict FROM g) SELECT doc_id, count(*) AS total, count(*) FILTER (verdict = 'grounded') AS n_grounded, count(*) FILTER (verdict IN ('skipped', 'derived')) AS n_skipped,
    count(*) FILTER (verdict = 'ungrounded') = 0 AS passed, coalesce(round(100 * count(*) FILTER (verdict = 'grounded') / nullif(count(*) FILTER (verdict IN ('grounded', 'ungrounded')), 0), 1), 100.0) AS rate FROM x GROUP BY doc_id""",
)
def agg_grounding_report(t: Tables) -> DataFrame:
    good, bad = F.count_if(F.col("verdict") == "grounded"), F.count_if(F.col("verdict") == "ungrounded")
    return verdicts(t).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("total"), good.alias("n_grounded"), F.count_if(F.col("verdict").isin("skipped", "derived")).alias("n_skipped"),
        (bad == 0).alias("passed"), F.coalesce(F.round(100 * good / F.nullif(good + bad, F.lit(0)), 1), F.lit(100.0)).alias("rate"),
    )
