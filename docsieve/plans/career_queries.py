"""Evidence, degrees, dates, sections, samples and graphs over the derived tables, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsieve.functions import grounding as gr
from docsieve.functions import lexicons as lx
from docsieve.operators import lexicon as lex
from docsieve.operators import names as nm
from docsieve.operators import scoring as sc
from docsieve.operators import temporal as tm
from docsieve.plans import domain as d
from docsieve.plans.matching_queries import FIXES, fixes, keyword_nodes
from docsieve.plans.profile_queries import DEGREE, DEGREES, FIELD, KINDS, sectioned
from docsieve.plans.registry import APPLICATIONS, LINES, query
from docsieve.plans.report_queries import DEPTH, MERGED, NODE_WORDS, RANK, TITLE_DOMAIN, merged
from docsieve.plans.score_queries import CHECKS, CV, IN_SOURCE, JD_SCORES, KNOWN_COMPANY, SHORT, cv_scores, generated, jd_scores, s_numbers, s_share
from docsieve.plans.standins import applications, lines
from docsieve.sources import tables as src
from docsieve.sources.tables import Tables

# --- evidence ---

LISTED = f"listed AS (SELECT DISTINCT c_custkey AS owner, {d.sql_chosen(d.SKILLS, 'c_custkey * 5 + i * 7')} AS node FROM customer CROSS JOIN (VALUES (0), (1), (2)) v(i))"


def listed_skills(t: Tables) -> DataFrame:
    """Skills that a customer lists, whether or not any role shows them."""
    each = F.explode(F.array(*[d.chosen(d.SKILLS, F.col("c_custkey") * 5 + i * 7) for i in range(3)]))
    return t.customer.select(F.col("c_custkey").alias("owner"), each.alias("node")).distinct()


@query("flt_weak_claims", f"{d.with_tables('nodes')}, {LISTED} SELECT l.owner, l.node FROM listed l LEFT JOIN nodes n USING (owner, node) WHERE coalesce(n_roles, 0) = 0 AND NOT coalesce(has_impact, FALSE) AND NOT coalesce(has_validation, FALSE)")
def flt_weak_claims(t: Tables) -> DataFrame:
    """Listed skills without any role, impact or validation."""
    rows = listed_skills(t).join(d.nodes(t), ["owner", "node"], "left")
    none = F.lit(False)
    return rows.where((F.coalesce("n_roles", F.lit(0)) == 0) & ~F.coalesce("has_impact", none) & ~F.coalesce("has_validation", none)).select("owner", "node")


S_LAST = "CASE WHEN bool_or(r.ordinal % 8 = 0) THEN 'present' ELSE max(((r.end_m - 1) // 12) || '-' || lpad(CAST((r.end_m - 1) % 12 + 1 AS VARCHAR), 2, '0')) END"


@query(
    "agg_evidence_summary",
    f"""{d.with_tables('facts', 'roles')} SELECT f.owner, node, CAST(sum(months) AS BIGINT) AS total_months, count(DISTINCT role_id) AS n_roles, bool_or(impact) AS has_impact, bool_or(validated) AS has_validation, bool_or(depth) AS has_depth,
    count(DISTINCT role_id) > 0 AS has_roles, {S_LAST} AS last_used, count(*) AS n_evidence FROM facts f JOIN roles r ON r.ordinal = f.role_id GROUP BY f.owner, node""",
)
def agg_evidence_summary(t: Tables) -> DataFrame:
    """Each node's months, roles, kinds of evidence, and when it was last used: an open role's "present" wins."""
    end = F.col("end_m")
    written = F.concat(F.floor((end - 1) / 12).cast("string"), F.lit("-"), F.lpad(((end - 1) % 12 + 1).cast("string"), 2, "0"))
    spans = d.roles(t).select(F.col("ordinal").alias("role_id"), written.alias("until"), (F.col("ordinal") % 8 == 0).alias("open"))
    roles = F.countDistinct("role_id")
    return d.facts(t).join(spans, "role_id").groupBy("owner", "node").agg(
        F.sum("months").cast("long").alias("total_months"), roles.alias("n_roles"), F.bool_or("impact").alias("has_impact"), F.bool_or("validated").alias("has_validation"),
        F.bool_or("depth").alias("has_depth"), (roles > 0).alias("has_roles"), F.when(F.bool_or("open"), "present").otherwise(F.max("until")).alias("last_used"), F.count(F.lit(1)).alias("n_evidence"),
    )


@query(
    "agg_domain_maturity",
    f"""{d.with_tables('facts', 'roles')}, tr AS (SELECT DISTINCT owner, company, {TITLE_DOMAIN.sql('title')} AS domain FROM roles), b AS (SELECT tr.owner, tr.domain, f.node, bool_or(f.depth) AS has_depth, count(*) AS n FROM tr JOIN facts f ON f.owner = tr.owner AND f.company = tr.company GROUP BY tr.owner, tr.domain, f.node),
    m AS (SELECT owner, domain, avg(CAST(has_depth AS INT)) AS coverage, avg(n) AS density, count(*) AS n_nodes FROM b GROUP BY owner, domain)
    SELECT owner, domain, n_nodes, CASE WHEN coverage >= 0.6 AND density >= 3 THEN 'rich' WHEN coverage >= 0.3 OR density >= 2 THEN 'medium' ELSE 'thin' END AS level FROM m""",
)
def agg_domain_maturity(t: Tables) -> DataFrame:
    """Of each domain of an owner's trajectory: a node belongs to it by a role at one of its companies."""
    trajectory = d.roles(t).select("owner", "company", TITLE_DOMAIN.first(F.col("title")).alias("domain")).distinct()
    own = d.facts(t).groupBy("owner", "company", "node").agg(F.bool_or("depth").alias("deep"), F.count(F.lit(1)).alias("n"))
    nodes = trajectory.join(own, ["owner", "company"]).groupBy("owner", "domain", "node").agg(F.bool_or("deep").alias("deep"), F.sum("n").alias("n"))
    m = nodes.groupBy("owner", "domain").agg(F.avg(F.col("deep").cast("int")).alias("c"), F.avg("n").alias("density"), F.count(F.lit(1)).alias("n_nodes"))
    level = F.when((F.col("c") >= 0.6) & (F.col("density") >= 3), "rich").when((F.col("c") >= 0.3) | (F.col("density") >= 2), "medium").otherwise("thin")
    return m.select("owner", "domain", "n_nodes", level.alias("level"))


S_SUMMARY_LEVEL = "CASE WHEN n_roles >= 3 AND total_months >= 60 AND (has_impact OR has_validation OR has_depth) THEN 'expert' WHEN n_roles >= 2 OR total_months >= 24 THEN 'proficient' WHEN n_roles >= 1 THEN 'applied' ELSE 'mentioned' END"
S_SUMMARY_SCORE = "least(n_roles * 15, 45) + least(total_months / 2, 30) + CASE WHEN has_impact THEN 10 ELSE 0 END + CASE WHEN has_validation THEN 8 ELSE 0 END + CASE WHEN has_depth THEN 5 ELSE 0 END"


@query("agg_depth_from_summary", f"{d.with_tables('nodes')} SELECT owner, node, {S_SUMMARY_SCORE} AS score, {S_SUMMARY_LEVEL} AS level FROM nodes")
def agg_depth_from_summary(t: Tables) -> DataFrame:
    """The levels and points of ``agg_depth``, from a node's summary alone: its months aren't a union, and titles aren't seen."""
    n, m = F.col("n_roles"), F.col("total_months")
    proof = F.col("has_impact") | F.col("has_validation") | F.col("has_depth")
    level = F.when((n >= 3) & (m >= 60) & proof, "expert").when((n >= 2) | (m >= 24), "proficient").when(n >= 1, "applied").otherwise("mentioned")
    bonus = [F.when(F.col(c), v).otherwise(0) for c, v in (("has_impact", 10), ("has_validation", 8), ("has_depth", 5))]
    score = F.least(n * 15, F.lit(45)) + F.least(m / 2, F.lit(30)) + bonus[0] + bonus[1] + bonus[2]
    return d.nodes(t).select("owner", "node", score.alias("score"), level.alias("level"))


@query(
    "agg_profile_stats",
    f"""{d.with_tables('facts', 'nodes', 'roles', 'certs')}, {NODE_WORDS}, r AS (SELECT owner, CAST(floor((max(end_m) - min(start_m)) / 12.0 + 0.5) AS BIGINT) AS years, count(*) AS n_roles FROM roles GROUP BY owner),
    n AS (SELECT n.owner, count(*) FILTER ({lx.TIER.sql('n.node')} = 'core_skill') AS n_core_skills, sum(n_evidence) AS n_evidence, count(DISTINCT coalesce(b.label, 'general')) AS n_domains FROM nodes n LEFT JOIN by_words b ON b.name = n.node GROUP BY n.owner), c AS (SELECT owner, count(*) AS n_certificates FROM certs GROUP BY owner)
    SELECT owner, years, n_roles, n_core_skills, CAST(n_evidence AS BIGINT) AS n_evidence, n_domains, coalesce(n_certificates, 0) AS n_certificates FROM r JOIN n USING (owner) LEFT JOIN c USING (owner)""",
)
def agg_profile_stats(t: Tables) -> DataFrame:
    """An owner's years, roles, core skills, points of evidence, domains and certificates."""
    one = F.count(F.lit(1))
    r = d.roles(t).groupBy("owner").agg(F.floor((F.max("end_m") - F.min("start_m")) / 12.0 + 0.5).alias("years"), one.alias("n_roles"))
    placed = lex.labelled(d.nodes(t), "node", lx.DOMAIN_WORDS, "domain")
    n = placed.groupBy("owner").agg(F.count_if(lx.TIER.first(F.col("node")) == "core_skill").alias("n_core_skills"), F.sum("n_evidence").alias("n_evidence"), F.countDistinct("domain").alias("n_domains"))
    c = d.certs(t).groupBy("owner").agg(one.alias("n_certificates"))
    return r.join(n, "owner").join(c, "owner", "left").withColumn("n_certificates", F.coalesce("n_certificates", F.lit(0)))


@query(
    "agg_dashboard",
    f"""WITH {APPLICATIONS}, f AS (SELECT user_id, count(*) AS total, count(*) FILTER (stage <> 'saved') AS applied, count(*) FILTER (stage IN ('interview', 'offer')) AS interviews, count(*) FILTER (stage = 'offer') AS offers FROM applications GROUP BY user_id),
    g AS (SELECT user_id, gap, count(*) AS n FROM applications WHERE gap IS NOT NULL GROUP BY user_id, gap), p AS (SELECT user_id, string_agg(gap || ':' || n, ',' ORDER BY n DESC, gap) AS patterns FROM (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, gap) <= 3) GROUP BY user_id)
    SELECT f.*, CAST(floor(100.0 * interviews / nullif(applied, 0) + 0.5) AS BIGINT) AS interview_pct, CAST(floor(100.0 * offers / nullif(applied, 0) + 0.5) AS BIGINT) AS offer_pct, coalesce(patterns, '') AS patterns FROM f LEFT JOIN p USING (user_id)""",
)
def agg_dashboard(t: Tables) -> DataFrame:
    """The funnel of each user with rounded shares, and its three most frequent gaps."""
    rows, stage = applications(t), F.col("stage")
    f = rows.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(stage != "saved").alias("applied"), F.count_if(stage.isin("interview", "offer")).alias("interviews"), F.count_if(stage == "offer").alias("offers")
    )
    g = rows.where("gap IS NOT NULL").groupBy("user_id", "gap").agg(F.count(F.lit(1)).alias("n"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("minus"), "gap")))
    top = g.groupBy("user_id").agg(F.array_join(F.transform(F.slice(ranked, 1, 3), lambda x: F.concat_ws(":", x["gap"].cast("string"), (-x["minus"]).cast("string"))), ",").alias("patterns"))

    def pct(c: str) -> Column:
        return F.floor(100.0 * F.col(c) / F.nullif(F.col("applied"), F.lit(0)) + 0.5).alias(f"{c.removesuffix('s')}_pct")

    return f.join(top, "user_id", "left").select(*f.columns, pct("interviews"), pct("offers"), F.coalesce("patterns", F.lit("")).alias("patterns"))


# --- degrees ---

S_DEGREES = f"held AS (SELECT c_custkey AS owner, i, {d.sql_chosen(DEGREES, 'c_custkey + i * 2')} AS name FROM customer CROSS JOIN (VALUES (0), (1), (2)) v(i)), dg AS (SELECT owner, i, name, {DEGREE.sql('name')} AS degree, CASE {DEGREE.sql('name')} {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {v}' for k, v in RANK.items())} END AS rank FROM held)"
TERMINAL = ("PhD", "Master")


def degrees(t: Tables) -> DataFrame:
    """Three degrees of each customer with their kind and rank."""
    each = t.customer.select(F.col("c_custkey").alias("owner"), F.explode(F.array(*map(F.lit, range(3)))).alias("i"))
    named = each.withColumn("name", d.chosen(DEGREES, F.col("owner") + F.col("i") * 2)).withColumn("degree", DEGREE.first(F.col("name")))
    return named.withColumn("rank", nm.pick({k: str(v) for k, v in RANK.items()}, F.col("degree"), F.lit("0")).cast("int"))


@query("agg_terminal_degree", f"WITH {S_DEGREES} SELECT owner, name, degree FROM dg QUALIFY row_number() OVER (PARTITION BY owner ORDER BY rank DESC, i) = 1")
def agg_terminal_degree(t: Tables) -> DataFrame:
    """The degree of the highest rank, the first of equal ones."""
    first = degrees(t).groupBy("owner").agg(F.max_by(F.struct("name", "degree"), F.struct("rank", -F.col("i"))).alias("d"))
    return first.select("owner", "d.name", "d.degree")


@query("flt_terminal_degree", f"WITH {S_DEGREES} SELECT owner, i, name FROM dg WHERE degree IN {TERMINAL}")
def flt_terminal_degree(t: Tables) -> DataFrame:
    """Degrees that end a course of study: masters and doctorates, by what their names say."""
    return degrees(t).where(F.col("degree").isin(*TERMINAL)).select("owner", "i", "name")


# --- dates ---

NOW_M, LONGEST = 24024, 600
FAULTS = f"""{d.with_tables('roles')}, f AS (SELECT owner, ordinal, CASE WHEN ordinal % 19 = 0 THEN end_m - 700 WHEN ordinal % 13 = 0 THEN end_m ELSE start_m END AS s, CASE WHEN ordinal % 13 = 0 AND ordinal % 19 <> 0 THEN start_m WHEN ordinal % 17 = 0 THEN {NOW_M} + ordinal % 4 ELSE end_m END AS e,
  CASE WHEN ordinal % 7 = 0 THEN 0 ELSE end_m - start_m END AS said FROM roles)"""


@query(
    "fn_validate_dates",
    f"""{FAULTS}, found AS (SELECT owner, ordinal, unnest([CASE WHEN e < s THEN 'reversed' END, CASE WHEN e > {NOW_M} + 1 THEN 'future' END, CASE WHEN e - s > {LONGEST} THEN 'too long' END, CASE WHEN said = 0 AND e > s THEN 'no duration' END]) AS issue,
      CASE WHEN said = 0 AND e > s THEN e - s END AS mended FROM f) SELECT owner, ordinal, issue, mended FROM found WHERE issue IS NOT NULL""",
)
def fn_validate_dates(t: Tables) -> DataFrame:
    """Roles that end before they start, end in the future (with a month's grace), last over 600 months, or say no duration, which is mended."""
    n = F.col("ordinal")
    s = F.when(n % 19 == 0, F.col("end_m") - 700).when(n % 13 == 0, F.col("end_m")).otherwise(F.col("start_m"))
    e = F.when((n % 13 == 0) & (n % 19 != 0), F.col("start_m")).when(n % 17 == 0, NOW_M + n % 4).otherwise(F.col("end_m"))
    rows = d.roles(t).select("owner", "ordinal", s.alias("s"), e.alias("e"), F.when(n % 7 == 0, 0).otherwise(F.col("end_m") - F.col("start_m")).alias("said"))
    silent = (F.col("said") == 0) & (F.col("e") > F.col("s"))
    found = F.array(F.when(F.col("e") < F.col("s"), "reversed"), F.when(F.col("e") > NOW_M + 1, "future"), F.when(F.col("e") - F.col("s") > LONGEST, "too long"), F.when(silent, "no duration"))
    return rows.select("owner", "ordinal", F.explode(found).alias("issue"), F.when(silent, F.col("e") - F.col("s")).alias("mended")).where("issue IS NOT NULL")


# --- lines and sections ---


@query(
    "win_repeated_lines",
    f"""WITH {LINES}, c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, line) AS n, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) AS k, count(*) OVER (PARTITION BY doc_id) AS total FROM lines),
    f AS (SELECT doc_id, pos, line, total >= 20 AND n >= 3 AND length(line) BETWEEN 4 AND 79 AND k > 1 AS gone FROM c)
    SELECT doc_id, count(*) FILTER (gone) AS n_gone, md5(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_md5 FROM f GROUP BY doc_id""",
)
def win_repeated_lines(t: Tables) -> DataFrame:
    """In texts of twenty lines or more, lines of 4 to 79 letters that occur three times stay once; the text that is left, as a digest."""
    same = Window.partitionBy("doc_id", "line")
    total = lines(t).groupBy("doc_id").agg(F.count(F.lit(1)).alias("total"))
    c = lines(t).withColumns({"n": F.count(F.lit(1)).over(same), "k": F.row_number().over(same.orderBy("pos"))}).join(total, "doc_id")
    gone = (F.col("total") >= 20) & (F.col("n") >= 3) & F.length("line").between(4, 79) & (F.col("k") > 1)
    kept = F.array_sort(F.collect_list(F.when(~F.col("gone"), F.struct("pos", "line"))))
    out = c.withColumn("gone", gone).groupBy("doc_id").agg(F.count_if("gone").alias("n_gone"), kept.alias("l"))
    return out.select("doc_id", "n_gone", F.md5(F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("kept_md5"))


@query(
    "win_section_bounds",
    f"""{KINDS}, a AS (SELECT owner, min(pos) FILTER (section = 'experience') AS first_pos FROM s GROUP BY owner) SELECT a.owner, first_pos, min(pos) AS end_pos FROM a JOIN s ON s.owner = a.owner AND s.pos > first_pos AND section IS NOT NULL AND section <> 'experience' GROUP BY a.owner, first_pos""",
)
def win_section_bounds(t: Tables) -> DataFrame:
    """The first title of the experience section, and the first one of another section behind it."""
    titles = sectioned(t).where("section IS NOT NULL").select("owner", "pos", "section")
    first = titles.where("section = 'experience'").groupBy("owner").agg(F.min("pos").alias("first_pos"))
    later = titles.join(first, "owner").where("pos > first_pos AND section <> 'experience'")
    return later.groupBy("owner", "first_pos").agg(F.min("pos").alias("end_pos"))


POSTING_HEADS = ((0, "About the team"), (1, "- We are kind"), (2, "What you bring:"), (900_000, "Benefits:"), (900_001, "- Lunch"), (900_002, "Requirements"), (900_003, "- A driving licence"))
ASKS, OTHER_HEAD = "^(requirements|qualifications|what you bring|you have):?$", "^(about .*|benefits|we offer|how to apply|responsibilities|what you will do):?$"
POSTING = f"""{d.with_tables('keywords')}, pl AS (SELECT app, pos, line FROM (SELECT DISTINCT app FROM keywords), (VALUES {', '.join(f"({p}, '{x}')" for p, x in POSTING_HEADS)}) v(pos, line)
  UNION ALL SELECT app, 10 + req * 1000 + pos AS pos, CASE WHEN part % 4 = 0 THEN '• ' ELSE '- ' END || kw || ' in practice' AS line FROM keywords),
fl AS (SELECT *, last_value(CASE WHEN regexp_matches(lower(line), '{ASKS}') THEN TRUE WHEN regexp_matches(lower(line), '{OTHER_HEAD}') THEN FALSE END IGNORE NULLS) OVER (PARTITION BY app ORDER BY pos, line) AS inside FROM pl)"""


@query("win_requirements_section", f"{POSTING} SELECT app, pos, trim(regexp_replace(line, '^[-•*]\\s+', '')) AS requirement FROM fl WHERE inside AND regexp_matches(line, '^[-•*]\\s+')")
def win_requirements_section(t: Tables) -> DataFrame:
    """A posting's bullets between a title that asks for something and the next other title."""
    keys = d.keywords(t)
    heads = F.array(*[F.struct(F.lit(p).cast("long").alias("pos"), F.lit(x).alias("line")) for p, x in POSTING_HEADS])
    bullet = F.concat(F.when(F.col("part") % 4 == 0, "• ").otherwise("- "), "kw", F.lit(" in practice"))
    rows = keys.select("app").distinct().select("app", F.inline(heads)).unionByName(keys.select("app", (10 + F.col("req") * 1000 + F.col("pos")).cast("long").alias("pos"), bullet.alias("line")))
    low = F.lower("line")
    told = F.when(low.rlike(ASKS), True).when(low.rlike(OTHER_HEAD), False)
    inside = F.last(told, ignorenulls=True).over(Window.partitionBy("app").orderBy("pos", "line"))
    found = src.dealt(rows, 2 * t.lineitem.count(), "app").withColumn("inside", inside).where(F.col("inside") & F.col("line").rlike(r"^[-•*]\s+"))
    return found.select("app", "pos", F.trim(F.regexp_replace("line", r"^[-•*]\s+", "")).alias("requirement"))


@query("fn_norm_verify", f"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '[-–—/\\\\]', ' ', 'g'), '{gr.MARKS.replace(chr(39), chr(39) * 2)}', '', 'g'), '\\s+', ' ', 'g'))) AS norm FROM documents")
def fn_norm_verify(t: Tables) -> DataFrame:
    """Lower case, dashes as blanks, punctuation dropped; the text as a digest."""
    return t.documents.select("doc_id", F.md5(gr.verified(F.col("text"))).alias("norm"))


LETTERS = "\\b[A-Za-z](?: [A-Za-z]){3,}\\b"
SPACED = ("S P A R K and data", "a b c", "I am A B C D E", "P M P - C K A S x y", "no runs here")


@query("fn_spaced_words", f"WITH x AS (SELECT ordinal, said, regexp_extract_all(said, '{LETTERS}') AS runs FROM ({d.with_tables('roles')} SELECT ordinal, {d.sql_chosen(SPACED, 'ordinal')} || ' ' || title AS said FROM roles)) SELECT ordinal, list_reduce(runs, lambda t, r: replace(t, r, replace(r, ' ', '')), said) AS joined, len(runs) AS n_runs FROM x")
def fn_spaced_words(t: Tables) -> DataFrame:
    """Runs of four single letters or more become words."""
    said = F.concat_ws(" ", d.chosen(SPACED, F.col("ordinal")), "title")
    rows = d.roles(t).select("ordinal", said.alias("said")).withColumn("runs", F.regexp_extract_all("said", F.lit(f"({LETTERS})"), 1))
    joined = F.reduce("runs", F.col("said"), lambda text, run: F.replace(text, run, F.replace(run, F.lit(" "), F.lit(""))))
    return rows.select("ordinal", joined.alias("joined"), F.size("runs").cast("long").alias("n_runs"))


# --- checkpoints and samples ---

EVERY, PATIENCE, MOST = 5, 10, 100


@query(
    "win_checkpoint",
    f"""WITH r AS (SELECT event_id, user_id, value, row_number() OVER w AS i, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    b AS (SELECT *, max(CASE WHEN before IS NULL OR value > before THEN i END) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS best_at FROM r)
    SELECT event_id, user_id, greatest(before, value) AS best, i % {EVERY} = 0 AS validates, CASE WHEN i >= {MOST} THEN 'limit' WHEN i - best_at >= {PATIENCE} THEN 'no progress' END AS stops FROM b""",
)
def win_checkpoint(t: Tables) -> DataFrame:
    """Of each step of a loop: the best so far, whether it is validated (each fifth), and why it would stop: a limit, or ten steps without progress."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    r = t.events.select("event_id", "user_id", "value", F.row_number().over(order).alias("i"), F.max("value").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    better = F.col("before").isNull() | (F.col("value") > F.col("before"))
    so_far = Window.partitionBy("user_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    b = r.withColumn("best_at", F.max(F.when(better, F.col("i"))).over(so_far))
    stops = F.when(F.col("i") >= MOST, "limit").when(F.col("i") - F.col("best_at") >= PATIENCE, "no progress")
    return b.select("event_id", "user_id", F.greatest("before", "value").alias("best"), (F.col("i") % EVERY == 0).alias("validates"), stops.alias("stops"))


def s_draw(key: str, weight: str) -> str:
    return f"-ln((CAST('0x' || left(md5(CAST({key} AS VARCHAR)), 12) AS BIGINT) + 0.5) / 281474976710656.0) / {weight}"


def draw(key: Column, weight: Column) -> Column:
    """An exponential draw with the weight as its rate, from a hash of the key: the least draws are a weighted sample without replacement."""
    u = (F.conv(F.left(F.md5(key.cast("string")), F.lit(12)), 16, 10).cast("long") + 0.5) / float(1 << 48)
    return -F.log(u) / weight


@query("smp_weighted", f"SELECT c_custkey, round({s_draw('c_custkey', 'greatest(c_acctbal, 1.0)')}, 9) AS draw FROM customer ORDER BY {s_draw('c_custkey', 'greatest(c_acctbal, 1.0)')}, c_custkey LIMIT 100")
def smp_weighted(t: Tables) -> DataFrame:
    """A hundred customers, drawn by their balance without replacement; the same ones in every run."""
    key = draw(F.col("c_custkey"), F.greatest(F.col("c_acctbal"), F.lit(1.0)))
    return t.customer.orderBy(key, "c_custkey").limit(100).select("c_custkey", F.round(key, 9).alias("draw"))


@query(
    "smp_weighted_or_fixed",
    f"""WITH p AS (SELECT o_custkey % 2 AS half, o_orderkey AS pair, CASE WHEN o_orderkey % 7 = 0 AND o_custkey % 2 = 1 THEN 3.0 ELSE 1.0 END AS w FROM orders), n AS (SELECT half, bool_or(w > 1) AS weighted FROM p GROUP BY half)
    SELECT half, pair, weighted FROM p JOIN n USING (half) QUALIFY row_number() OVER (PARTITION BY half ORDER BY CASE WHEN weighted THEN {s_draw('pair', 'w')} ELSE 0 END, pair) <= 10""",
)
def smp_weighted_or_fixed(t: Tables) -> DataFrame:
    """Ten pairs of each half: a weighted draw if any has a weight, else the first."""
    weight = F.when((F.col("o_orderkey") % 7 == 0) & (F.col("o_custkey") % 2 == 1), 3.0).otherwise(1.0)
    p = t.orders.select((F.col("o_custkey") % 2).alias("half"), F.col("o_orderkey").alias("pair"), weight.alias("w"))
    both = p.join(F.broadcast(p.groupBy("half").agg(F.bool_or(F.col("w") > 1).alias("weighted"))), "half")
    place = F.row_number().over(Window.partitionBy("half").orderBy(F.when(F.col("weighted"), draw(F.col("pair"), F.col("w"))).otherwise(0), "pair"))
    return both.withColumn("place", place).where("place <= 10").select("half", "pair", "weighted")


# --- scores ---

#: What a check's failure risks; checks that aren't listed count as medium.
RISKS = {"no_fabrication": "high", "no_fab_tech": "high", "facts": "high", "requirements": "medium", "word_count": "low", "structure": "low"}


@query("sc_risk_tag", f"{CHECKS}, risks(check_name, risk) AS (VALUES {', '.join(f'({chr(39)}{k}{chr(39)}, {chr(39)}{v}{chr(39)})' for k, v in RISKS.items())}) SELECT app, check_name, passed, coalesce(risk, 'medium') AS risk FROM checks LEFT JOIN risks USING (check_name)")
def sc_risk_tag(t: Tables) -> DataFrame:
    """Each result of a check with the risk that the table gives it."""
    risk = nm.pick(RISKS, F.col("check_name"), F.lit("medium"))
    return cv_scores(t).select("app", "check_name", "passed", risk.alias("risk"))


S_FACTS = f"(CASE WHEN {SHORT} THEN 1.0 ELSE (CAST({KNOWN_COMPANY} AS INT) + CAST(coalesce(contains(source, CAST(yr AS VARCHAR)), FALSE) AS INT)) / (CASE WHEN yr IS NULL THEN 1 ELSE 2 END) END)"


@query(
    "sc_degrade",
    f"""{CV}, bad AS (SELECT app, source, company, list_append(skills, 'underwater basketry') AS skills, regexp_replace(made, '[0-9]', '', 'g') AS made, yr + 37 AS yr FROM c),
    a AS (SELECT app, {s_share(f'len({IN_SOURCE})', 'len(skills)')} AS skills, {s_share(f"len(list_intersect({s_numbers('source')}, {s_numbers('made')}))", f"len({s_numbers('source')})")} AS numbers, {S_FACTS} AS facts FROM c),
    b AS (SELECT app, {s_share(f'len({IN_SOURCE})', 'len(skills)')} AS skills, {s_share(f"len(list_intersect({s_numbers('source')}, {s_numbers('made')}))", f"len({s_numbers('source')})")} AS numbers, {S_FACTS} AS facts FROM bad)
    SELECT app, round(a.skills, 6) AS skills_before, round(b.skills, 6) AS skills_after, round(a.numbers, 6) AS numbers_before, round(b.numbers, 6) AS numbers_after, round(a.facts, 6) AS facts_before, round(b.facts, 6) AS facts_after FROM a JOIN b USING (app)""",
)
def sc_degrade(t: Tables) -> DataFrame:
    """Checks must see what was spoilt: a skill that isn't there, erased digits, a year that is wrong."""
    source, made, skills, yr, company = (F.col(c) for c in ("source", "made", "skills", "yr", "company"))

    def scores(skills: Column, made: Column, yr: Column, suffix: str) -> list[Column]:
        held = sc.share(sc.counted(skills, lambda s: sc.skill_held(s, source)), F.size(skills))
        return [F.round(c, 6).alias(f"{n}_{suffix}") for n, c in (("skills", held), ("numbers", sc.metrics_kept(source, made)["score"]), ("facts", sc.facts_kept(company, yr, source)["score"]))]

    spoilt = scores(F.array_append(skills, F.lit("underwater basketry")), F.regexp_replace(made, "[0-9]", ""), yr + 37, "after")
    return generated(t).select("app", *scores(skills, made, yr, "before"), *spoilt)


@query(
    "sc_trial_arrays",
    f"""{JD_SCORES}, w AS (SELECT app, max(score) FILTER (check_name = 'req_recall') AS r, max(score) FILTER (check_name = 'req_precision') AS p, max(score) FILTER (check_name = 'req_types') AS ty, max(score) FILTER (check_name = 'resp_recall') AS re FROM checks GROUP BY app)
    SELECT app, round(r, 6) AS recall, round(p, 6) AS precision, round(ty, 6) AS types, round(re, 6) AS responsibilities, round(2 * r * p / nullif(r + p, 0), 6) AS f1, round((r + p + ty + re) / 4, 6) AS arrays FROM w""",
)
def sc_trial_arrays(t: Tables) -> DataFrame:
    """Of each posting the recall and precision of requirements, their types and responsibilities, and what they come to together."""

    def one(name: str) -> Column:
        return F.max(F.when(F.col("check_name") == name, F.col("score")))

    w = jd_scores(t).groupBy("app").agg(one("req_recall").alias("r"), one("req_precision").alias("p"), one("req_types").alias("ty"), one("resp_recall").alias("re"))
    r, p = F.col("r"), F.col("p")
    out = {"recall": r, "precision": p, "types": F.col("ty"), "responsibilities": F.col("re"), "f1": 2 * r * p / F.nullif(r + p, F.lit(0.0)), "arrays": (r + p + F.col("ty") + F.col("re")) / 4}
    return w.select("app", *[F.round(c, 6).alias(n) for n, c in out.items()])


# --- matching ---

ROLE_DOMAINS = f"words_of AS (SELECT DISTINCT title AS name FROM roles), {lex.s_labels('words_of', 'name', 'name', lx.DOMAIN_WORDS, 'of_title')}"


@query(
    "jn_eligibility_semi",
    f"""{d.with_tables('certs', 'nodes', 'keywords', 'roles')}, pairs AS (SELECT k.kw, c.cert FROM (SELECT DISTINCT kw FROM keywords) k JOIN (SELECT DISTINCT cert FROM certs) c ON {d.s_skills('c.cert', 'k.kw')}),
    skill AS (SELECT k.kw, n.node FROM (SELECT DISTINCT kw FROM keywords) k JOIN (SELECT DISTINCT node FROM nodes) n ON {d.s_skills('n.node', 'k.kw')}), {ROLE_DOMAINS},
    of_kw AS (SELECT kw, arg_min(label, place) AS domain FROM (SELECT kw, unnest({lex.s_tokens('kw')}) AS w FROM (SELECT DISTINCT kw FROM keywords)), domain_words WHERE phrase = w GROUP BY kw),
    has_domain AS (SELECT DISTINCT r.owner, o.label AS domain FROM roles r JOIN of_title o ON o.name = r.title)
    SELECT app, req, part, coalesce(bool_or(c.cert IS NOT NULL), FALSE) AS by_cert, coalesce(bool_or(h.domain IS NOT NULL), FALSE) AS by_domain, coalesce(bool_or(n.node IS NOT NULL), FALSE) AS by_node,
      CASE WHEN bool_or(c.cert IS NOT NULL OR h.domain IS NOT NULL OR n.node IS NOT NULL) THEN 'pass' ELSE 'fail' END AS status
    FROM keywords k LEFT JOIN (SELECT DISTINCT p.kw, c.owner, c.cert FROM pairs p JOIN certs c ON c.cert = p.cert) c ON c.kw = k.kw AND c.owner = k.owner
    LEFT JOIN (SELECT DISTINCT s.kw, n.owner, n.node FROM skill s JOIN nodes n ON n.node = s.node) n ON n.kw = k.kw AND n.owner = k.owner
    LEFT JOIN (SELECT o.kw, h.owner, h.domain FROM of_kw o JOIN has_domain h ON h.domain = o.domain) h ON h.kw = k.kw AND h.owner = k.owner GROUP BY app, req, part""",
)
def jn_eligibility_semi(t: Tables) -> DataFrame:
    """A requirement passes if any of its keywords matches a certificate, a domain (by a single word of the lexicon) or a node of the owner."""
    keys, certs = d.keywords(t), d.certs(t)
    words, table = keys.select("kw").distinct(), lx.DOMAIN_WORDS.table(t.spark)
    cert = nm.name_matches(words.select(F.col("kw").alias("name")), certs.select(F.col("cert").alias("name")).distinct()).select(F.col("a").alias("kw"), F.col("b").alias("cert"))
    yes = F.lit(True)
    by_cert = cert.join(certs, "cert").select("owner", "kw").distinct().withColumn("c", yes)
    by_node = keyword_nodes(t, keys.select("owner", "kw").distinct(), "kw").select("owner", "kw").distinct().withColumn("n", yes)
    asked = lex.hits(words, ["kw"], "kw", table, most=1).groupBy("kw").agg(F.min_by("label", "place").alias("domain"))
    has = lex.labelled(d.roles(t).select("owner", "title").distinct(), "title", lx.DOMAIN_WORDS, "domain").where("domain <> 'general'").select("owner", "domain").distinct()
    by_domain = asked.join(has, "domain").select("owner", "kw", yes.alias("d"))
    rows = keys.join(by_cert, ["owner", "kw"], "left").join(by_domain, ["owner", "kw"], "left").join(by_node, ["owner", "kw"], "left")
    any_of = {n: F.coalesce(F.bool_or(c), F.lit(False)) for n, c in (("by_cert", "c"), ("by_domain", "d"), ("by_node", "n"))}
    flags = rows.groupBy("app", "req", "part").agg(*[c.alias(n) for n, c in any_of.items()])
    return flags.withColumn("status", F.when(F.col("by_cert") | F.col("by_domain") | F.col("by_node"), "pass").otherwise("fail"))


SIGNALS = f"sg AS (SELECT owner, node, n_roles >= 2 AND has_impact AS fits FROM nodes), wanted AS (SELECT DISTINCT s_suppkey AS jd, {d.sql_chosen(d.SKILLS, 's_suppkey * 3 + i')} AS skill FROM supplier CROSS JOIN (VALUES (0), (1), (2), (3)) v(i))"


@query(
    "jn_outcome_context",
    f"""{d.with_tables('roles', 'nodes')}, {SIGNALS}, asked AS (SELECT s_suppkey AS jd, {d.sql_chosen(d.TITLES, 's_suppkey * 7')} AS title, s_nationkey AS industry FROM supplier),
    past AS (SELECT r.owner, r.ordinal, r.title, c_nationkey AS industry, r.end_m FROM roles r JOIN customer ON c_custkey = r.owner),
    ten AS (SELECT a.jd, p.ordinal, p.owner FROM asked a JOIN past p ON p.industry = a.industry OR {d.s_titles('a.title', 'p.title')} QUALIFY row_number() OVER (PARTITION BY a.jd ORDER BY p.end_m DESC, p.ordinal DESC) <= 10)
    SELECT t.jd, t.ordinal, coalesce((SELECT string_agg(DISTINCT s.node, ',' ORDER BY s.node) FROM sg s JOIN wanted w ON w.jd = t.jd AND w.skill = s.node WHERE s.owner = t.owner AND s.fits), '') AS niche FROM ten t""",
)
def jn_outcome_context(t: Tables) -> DataFrame:
    """The last ten applications of a posting's industry, or with a title like its own, each with its owner's proven nodes that the posting names."""
    key = F.col("s_suppkey")
    asked = t.supplier.select(key.alias("jd"), d.chosen(d.TITLES, key * 7).alias("wanted"), F.col("s_nationkey").alias("industry"))
    people = t.customer.select(F.col("c_custkey").alias("owner"), F.col("c_nationkey").alias("industry"))
    past = d.roles(t).join(people, "owner").select("owner", "ordinal", "title", "industry", "end_m")
    latest = [F.desc("end_m"), F.desc("ordinal")]

    def last(by: str) -> DataFrame:  # ten of each industry or title are all that can count
        return past.withColumn("at", F.row_number().over(Window.partitionBy(by).orderBy(*latest))).where("at <= 10").drop("at")

    # Titles meet by the first letters of a word, and then by all rules; distinct ones only.
    def stems(rows: DataFrame, c: str) -> DataFrame:
        words = F.transform(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != ""), lambda w: F.left(w, F.lit(5)))
        return rows.select(c).distinct().select(c, F.explode(F.array_distinct(words)).alias("stem"))

    met = stems(asked, "wanted").join(stems(past, "title"), "stem").select("wanted", "title").distinct()
    titles = met.where(nm.titles_match(F.col("wanted"), F.col("title")))
    same = asked.join(last("industry"), "industry").select("jd", "ordinal", "owner", "end_m")
    like = asked.join(titles, "wanted").join(last("title"), "title").select("jd", "ordinal", "owner", "end_m")
    both = same.unionByName(like).distinct()
    ten = both.withColumn("at", F.row_number().over(Window.partitionBy("jd").orderBy(*latest))).where("at <= 10").select("jd", "ordinal", "owner")
    wanted = t.supplier.select(key.alias("jd"), F.explode(F.array(*[d.chosen(d.SKILLS, key * 3 + i) for i in range(4)])).alias("node")).distinct()
    proven = d.nodes(t).where("n_roles >= 2 AND has_impact").select("owner", "node")
    niche = ten.select("jd", "owner").distinct().join(wanted, "jd").join(proven, ["owner", "node"]).groupBy("jd", "owner").agg(F.array_join(F.array_sort(F.collect_set("node")), ",").alias("niche"))
    return ten.join(niche, ["jd", "owner"], "left").select("jd", "ordinal", F.coalesce("niche", F.lit("")).alias("niche"))


# --- graphs and profiles ---


@query(
    "agg_graph_builder",
    f"""{DEPTH.replace(d.with_tables('facts', 'roles'), d.with_tables('facts', 'roles', 'certs'), 1)}, {NODE_WORDS},
    sk AS (SELECT f.owner, 'skill' AS kind, lower(f.node) AS key, min(f.node) AS name, {lx.TIER.sql('min(f.node)')} AS tier, count(DISTINCT role_id) AS n_roles, bool_or(impact) AS has_impact, CAST(count(*) AS BIGINT) AS n, CAST(sum(f.months) AS BIGINT) AS months, count(*) FILTER (impact) AS n_metrics FROM facts f GROUP BY f.owner, lower(f.node)),
    held AS (SELECT s.owner, s.key, count(DISTINCT c.cert_id) AS n_certs FROM sk s JOIN certs c ON c.owner = s.owner AND contains(lower(c.cert), s.key) GROUP BY s.owner, s.key),
    dm AS (SELECT owner, 'domain' AS kind, dom AS key, dom AS name, 'core_skill' AS tier, count(DISTINCT role_id) AS n_roles, FALSE AS has_impact, count(DISTINCT role_id) AS n, CAST(0 AS BIGINT) AS months, CAST(0 AS BIGINT) AS n_metrics FROM (SELECT owner, role_id, {TITLE_DOMAIN.sql('title')} AS dom FROM facts) GROUP BY owner, dom),
    ce AS (SELECT owner, 'certificate' AS kind, lower(cert) AS key, min(cert) AS name, {lx.CERT_TIER.sql('min(cert)')} AS tier, 0 AS n_roles, FALSE AS has_impact, count(*) AS n, CAST(0 AS BIGINT) AS months, CAST(0 AS BIGINT) AS n_metrics FROM certs c WHERE NOT EXISTS (SELECT 1 FROM sk WHERE sk.owner = c.owner AND contains(lower(c.cert), sk.key)) GROUP BY owner, lower(cert)),
    al AS (SELECT * FROM sk UNION ALL SELECT * FROM dm UNION ALL SELECT * FROM ce)
    SELECT a.owner, a.kind, a.name, a.tier, CASE a.kind WHEN 'skill' THEN coalesce(b.label, 'general') WHEN 'domain' THEN a.name ELSE 'general' END AS domain, a.n_roles, a.has_impact, a.months, a.n_metrics, coalesce(h.n_certs, 0) AS n_certs, a.n + coalesce(h.n_certs, 0) AS n,
      row_number() OVER (PARTITION BY a.owner ORDER BY a.n + coalesce(h.n_certs, 0) DESC, a.kind, a.key) AS place FROM al a LEFT JOIN held h ON a.kind = 'skill' AND h.owner = a.owner AND h.key = a.key LEFT JOIN by_words b ON b.name = a.name""",
)
def agg_graph_builder(t: Tables) -> DataFrame:
    """Nodes of skills (with domain, metrics, months and the certificates that name them), of domains, and of certificates that no skill holds, in the order of their evidence."""
    facts, certs = d.facts(t), d.certs(t).withColumn("c", F.lower("cert"))
    one, zero = F.count(F.lit(1)), F.lit(0).cast("long")
    skills = facts.groupBy("owner", F.lower("node").alias("key")).agg(
        F.min("node").alias("name"), F.countDistinct("role_id").alias("n_roles"), F.bool_or("impact").alias("has_impact"), one.alias("n"), F.sum("months").cast("long").alias("months"), F.count_if("impact").alias("n_metrics")
    )
    held = certs.join(nm.contained(certs, skills, "c", "key"), "c").join(skills.select("owner", "key"), ["owner", "key"]).select("owner", "key", "cert_id").distinct()
    n_certs = held.groupBy("owner", "key").agg(F.count(F.lit(1)).alias("n_certs"))
    placed = lex.labelled(skills, "name", lx.DOMAIN_WORDS, "domain").join(n_certs, ["owner", "key"], "left").withColumn("n_certs", F.coalesce("n_certs", zero))
    columns = ["owner", "kind", "key", "name", "tier", "domain", "n_roles", "has_impact", "months", "n_metrics", "n_certs", "n"]
    of_skills = placed.withColumns({"kind": F.lit("skill"), "tier": lx.TIER.first(F.col("name")), "n": F.col("n") + F.col("n_certs")}).select(columns)
    domains = facts.groupBy("owner", TITLE_DOMAIN.first(F.col("title")).alias("key")).agg(F.countDistinct("role_id").alias("n_roles"))
    none = {"has_impact": F.lit(False), "months": zero, "n_metrics": zero, "n_certs": zero}
    of_domains = domains.withColumns({"kind": F.lit("domain"), "name": F.col("key"), "tier": F.lit("core_skill"), "domain": F.col("key"), "n": F.col("n_roles"), **none}).select(columns)
    alone = certs.join(held.select("cert_id").distinct(), "cert_id", "left_anti").groupBy("owner", F.col("c").alias("key")).agg(F.min("cert").alias("name"), one.alias("n"))
    of_certs = alone.withColumns({"kind": F.lit("certificate"), "tier": lx.CERT_TIER.first(F.col("name")), "domain": F.lit("general"), "n_roles": zero, **none}).select(columns)
    place = F.row_number().over(Window.partitionBy("owner").orderBy(F.desc("n"), "kind", "key")).cast("long")
    return of_skills.unionByName(of_domains).unionByName(of_certs).withColumn("place", place).drop("key")


ROLE_BULLETS = "rb AS (SELECT role_id, string_agg('Led ' || node || ' and cut cost by ' || line || '0%', ' ; ' ORDER BY line, node) AS bullets FROM (SELECT DISTINCT role_id, line, node FROM facts) GROUP BY role_id)"


@query(
    "agg_to_parsed",
    f"""{MERGED}, skills AS ({d.TABLES['skills']}), facts AS ({d.TABLES['facts']}), {ROLE_BULLETS}, {lx.TECHNOLOGIES.sql()}, {lex.s_hits('rb', 'role_id', 'bullets', 'technologies', 'hit')},
    tech AS (SELECT role_id, string_agg(phrase, ',' ORDER BY pos, place) FILTER (k <= 15) AS technologies, arg_min(label, place) AS kind FROM (SELECT *, row_number() OVER (PARTITION BY role_id ORDER BY pos, place) AS k FROM hit) GROUP BY role_id)
    SELECT f.owner, f.ordinal, f.title, f.company, coalesce(technologies, '') AS technologies, coalesce(kind, 'other') AS kind, coalesce(array_to_string(list_sort({s_numbers('bullets')}), ';'), '') AS metrics
    FROM fin f LEFT JOIN rb ON rb.role_id = f.ordinal LEFT JOIN tech t ON t.role_id = f.ordinal""",
)
def agg_to_parsed(t: Tables) -> DataFrame:
    """Merged roles in a parsed profile's shape: their bullets are scanned for known terms, the kind of the first by the lexicon, and metrics."""
    said = F.concat(F.lit("Led "), "node", F.lit(" and cut cost by "), F.col("line").cast("string"), F.lit("0%"))
    rows = d.facts(t).select("role_id", "line", "node").distinct().groupBy("role_id").agg(F.array_sort(F.collect_list(F.struct("line", "node", said.alias("s")))).alias("l"))
    bullets = rows.select(F.col("role_id").alias("ordinal"), F.array_join(F.transform("l", lambda x: x["s"]), " ; ").alias("bullets"))
    hits = lex.hits(bullets, ["ordinal"], "bullets", lx.TECHNOLOGIES.table(t.spark))
    listed = F.slice(F.array_sort(F.collect_list(F.struct("at", "place", "phrase"))), 1, 15)
    tech = hits.groupBy("ordinal").agg(F.array_join(F.transform(listed, lambda x: x["phrase"]), ",").alias("technologies"), F.min_by("label", "place").alias("kind"))
    whole = merged(t).join(bullets, "ordinal", "left").join(tech, "ordinal", "left")
    metrics = F.coalesce(F.array_join(F.array_sort(sc.numbers(F.col("bullets"))), ";"), F.lit(""))
    return whole.select("owner", "ordinal", "title", "company", F.coalesce("technologies", F.lit("")).alias("technologies"), F.coalesce("kind", F.lit("other")).alias("kind"), metrics.alias("metrics"))


FIELD_OF = f"{FIELD.sql('name')}"


@query(
    "agg_merge_profile",
    f"""{MERGED}, {FIXES}, {S_DEGREES},
    dated AS (SELECT f.* EXCLUDE (start_m), CASE WHEN contains(lower(f.title || ' ' || f.company), m.said) OR contains(m.said, left(lower(f.title || ' ' || f.company), 20)) THEN m.new_start ELSE f.start_m END AS start_m FROM fin f JOIN moved m USING (owner)),
    named AS (SELECT t.owner, t.ordinal, x.fixed FROM dated t JOIN fixes x ON x.owner = t.owner AND (t.start_m - 1) // 12 >= p0 AND (t.start_m - 1) // 12 < p1 QUALIFY row_number() OVER (PARTITION BY t.owner, t.ordinal ORDER BY x.ordinal) = 1),
    good AS (SELECT owner, start_m AS a, end_m AS b FROM dated WHERE end_m > start_m), far AS (SELECT *, max(b) OVER (PARTITION BY owner ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM good),
    num AS (SELECT *, sum(CASE WHEN a <= r THEN 0 ELSE 1 END) OVER (PARTITION BY owner ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM far), tot AS (SELECT owner, CAST(sum(b - a) AS BIGINT) AS total_months FROM (SELECT owner, k, min(a) AS a, max(b) AS b FROM num GROUP BY owner, k) GROUP BY owner),
    one AS (SELECT owner, i, name FROM dg QUALIFY row_number() OVER (PARTITION BY owner, degree, {FIELD_OF} ORDER BY i) = 1), edu AS (SELECT owner, string_agg(name, '; ' ORDER BY i) AS education FROM one GROUP BY owner)
    SELECT t.owner, t.ordinal, origin, coalesce(n.fixed, t.title) AS title, company, start_m, end_m, alt_titles, n_sources, row_number() OVER (PARTITION BY t.owner ORDER BY end_m DESC, t.ordinal) AS place, coalesce(total_months, 0) AS total_months, coalesce(education, '') AS education
    FROM dated t LEFT JOIN named n ON n.owner = t.owner AND n.ordinal = t.ordinal LEFT JOIN tot ON tot.owner = t.owner LEFT JOIN edu ON edu.owner = t.owner""",
)
def agg_merge_profile(t: Tables) -> DataFrame:
    """The merged timeline of each owner, latest first: titles and starts as corrected, other titles and sources of each role,
    the months that all roles cover together, and the degrees, of each kind and field the first."""
    key = F.col("c_custkey")
    moved = t.customer.select(key.alias("owner"), F.lower(d.chosen(d.COMPANIES, key * 3 + 1)).alias("said"), (24000 + key % 12).alias("new_start"))
    text = F.lower(F.concat_ws(" ", "title", "company"))
    said = F.contains(text, F.col("said")) | F.contains(F.col("said"), F.left(text, F.lit(20)))
    dated = src.computed(merged(t).join(moved, "owner").withColumn("start_m", F.when(said, F.col("new_start")).otherwise(F.col("start_m"))).drop("said", "new_start"))
    yr = F.floor((F.col("start_m") - 1) / 12)
    met = dated.select("owner", "ordinal", yr.alias("yr")).join(fixes(t).withColumnRenamed("ordinal", "at"), "owner").where("yr >= p0 AND yr < p1")
    named = met.groupBy("owner", "ordinal").agg(F.min_by("fixed", "at").alias("fixed"))
    total = tm.covered_months(dated.where("end_m > start_m").select("owner", "start_m", "end_m")).select("owner", F.col("covered").alias("total_months"))
    first = degrees(t).groupBy("owner", "degree", FIELD.first(F.col("name")).alias("field")).agg(F.min(F.struct("i", "name")).alias("f"))
    education = first.groupBy("owner").agg(F.array_join(F.transform(F.array_sort(F.collect_list("f")), lambda x: x["name"]), "; ").alias("education"))
    whole = dated.join(named, ["owner", "ordinal"], "left").join(total, "owner", "left").join(education, "owner", "left")
    place = F.row_number().over(Window.partitionBy("owner").orderBy(F.desc("end_m"), "ordinal")).cast("long")
    return whole.select(
        "owner", "ordinal", "origin", F.coalesce("fixed", "title").alias("title"), "company", "start_m", "end_m", "alt_titles", "n_sources", place.alias("place"),
        F.coalesce("total_months", F.lit(0)).alias("total_months"), F.coalesce("education", F.lit("")).alias("education"),
    )
