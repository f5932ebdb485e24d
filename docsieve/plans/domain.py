"""The domain's tables, derived from the stand-ins: skills, roles with companies and titles, evidence and requirements.

A part stands for a skill, an order for a role and an application of its customer, a line item for a piece of
evidence and a requirement. Names come from our own lists, by the keys; each table exists as a DataFrame and
as a DuckDB expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsieve.operators import names as nm
from docsieve.plans.standins import roles as plain_roles
from docsieve.sources.tables import Tables, dealt

# Our own lists of names.
SKILLS = (
    "Python", "python", "PySpark", "Spark", "Apache Spark", "K8s", "Kubernetes", "JS", "JavaScript", "TypeScript", "React",
    "React Native", "SQL", "PostgreSQL", "Postgres", "Data Analysis", "Machine Learning", "ML", "Deep Learning",
    "Project Management", "Agile Project Management", "Risk Management", "Nursing", "Patient Care", "Critical Care Nursing",
    "Budgeting", "Financial Modelling", "Excel", "Microsoft Excel", "Public Speaking", "Teaching", "Curriculum Design",
    "Welding", "Electrical Wiring", "Supply Chain", "Supply Chain Planning", "Customer Service", "Negotiation", "First Aid",
    "Java", "Go", "Docker",
)
COMPANIES = (
    "Acme Corp", "Acme Corporation", "ACME", "International Business Machines", "IBM", "IBM Research", "Blue River Health Ltd",
    "Blue River Healthcare", "Northwind Traders", "Northwind Trading Co", "Saint Mary Hospital", "St Mary Hospital",
    "United Parcel Service", "UPS", "Globex Inc", "Initech LLC", "Initech", "City College", "City College of Arts", "Umbrella Group",
)
TITLES = (
    "Senior Software Engineer", "Software Engineer", "Software Engineering Lead", "Software Developer", "Staff Nurse",
    "Registered Nurse", "Nurse Manager", "Project Manager", "Senior Project Manager", "Project Management Intern",
    "Data Analyst", "Data Analysis Trainee", "Teacher", "Head Teacher", "Electrician", "Apprentice Electrician",
    "Director of Operations", "Operations Manager", "Customer Service Representative", "Chief Executive Officer",
)
CERTIFICATES = (
    "Certified Kubernetes Administrator", "CKA", "Project Management Professional", "PMP", "Registered Nurse License",
    "First Aid Certificate", "Teaching License", "AWS Certified Developer", "Certified Welding Inspector", "Diploma in Budgeting",
    "Bachelor of Science in Nursing", "Volunteer First Responder", "Master of Data Analysis", "Chartered Accountant",
)


def chosen(values: tuple[str, ...], key: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


def sql_chosen(values: tuple[str, ...], key: str) -> str:
    listed = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"([{listed}])[({key}) % {len(values)} + 1]"


# --- the same rules in DuckDB's words ---

STOPS = "('the','and','of','to','in','is','for','on','with','that','at','it','an','was','as')"


def s_norm(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


def s_canon(x: str) -> str:
    cases = " ".join(f"WHEN '{a}' THEN '{c}'" for a, c in nm.ALIASES.items())
    return f"CASE lower(trim({x})) {cases} ELSE lower(trim({x})) END"


def s_whole(needle: str, text: str) -> str:
    return f"(length({needle}) >= 2 AND regexp_matches({text}, '(^|[^a-z0-9])' || regexp_escape({needle}) || '($|[^a-z0-9])'))"


def s_skills(a: str, b: str) -> str:
    x, y = f"({s_canon(a)})", f"({s_canon(b)})"
    return f"({x} = {y} OR {s_whole(x, y)} OR {s_whole(y, x)})"


def s_sig(x: str) -> str:
    return f"list_distinct(list_filter(string_split({s_norm(x)}, ' '), lambda w: length(w) > 1 AND w NOT IN {STOPS}))"


def s_companies(a: str, b: str) -> str:
    x, y, p, q = s_norm(a), s_norm(b), s_sig(a), s_sig(b)
    short = " OR ".join(f"((contains({x}, '{s}') OR contains({y}, '{s}')) AND (contains({x}, '{e}') OR contains({y}, '{e}')))" for s, e in nm.ABBREVIATIONS.items())
    return f"({x} = {y} OR contains({x}, {y}) OR contains({y}, {x}) OR coalesce(len(list_intersect({p}, {q})) / nullif(len(list_distinct(list_concat({p}, {q}))), 0), 0) >= 0.5 OR {short})"


def s_stem(a: str, b: str) -> str:
    n = f"least(length({a}), length({b}))"
    return f"CASE WHEN {n} < 5 THEN {a} = {b} ELSE left({a}, least({n}, 6)) = left({b}, least({n}, 6)) END"


def s_stems_in(p: str, q: str) -> str:
    return f"len(list_filter({p}, lambda w: len(list_filter({q}, lambda v: {s_stem('w', 'v')})) > 0))"


def s_titles(a: str, b: str) -> str:
    p, q = s_sig(a), s_sig(b)
    one, two = s_stems_in(p, q), s_stems_in(q, p)
    return f"""({s_norm(a)} = {s_norm(b)} OR (len({p}) > 0 AND len({q}) > 0 AND (CASE WHEN len({p}) <= len({q}) THEN {one} = len({p}) ELSE {two} = len({q}) END
        OR greatest({one}, {two}) / greatest(len({p}), len({q})) > 0.5)))"""


def s_long(x: str, n: int) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(lower({x}), '[\\s,()/]+'), lambda w: length(w) >= {n}))"


def s_context(a: str, b: str) -> str:
    both = [s_long(f"{r}.title || ' ' || {r}.company", 3) for r in (a, b)]
    return f"(len(list_intersect({s_long(a + '.company', 4)}, {s_long(b + '.company', 4)})) > 0 OR len(list_intersect({both[0]}, {both[1]})) >= 2)"


def s_dates(a: str, b: str) -> str:
    o = f"(least({a}.end_m, {b}.end_m) - greatest({a}.start_m, {b}.start_m))"
    return f"({o} >= -6 AND {o} >= 0.3 * least({a}.end_m - {a}.start_m, {b}.end_m - {b}.start_m))"


_PLAIN = sql_chosen(SKILLS, "p_partkey // 3")
SKILL_SQL = f"CASE p_partkey % 3 WHEN 0 THEN {_PLAIN} WHEN 1 THEN split_part(p_name, ' ', 1) || ' ' || {_PLAIN} ELSE {_PLAIN} || ' ' || split_part(p_name, ' ', 2) END"
COMPANY_SQL = sql_chosen(COMPANIES, "o_custkey * 3 + o_orderkey % 4")
TITLE_SQL = sql_chosen(TITLES, "o_custkey + o_orderkey % 5")
#: Tables by name; each may use those before it.
TABLES = {
    "skills": f"SELECT p_partkey, {SKILL_SQL} AS name FROM part",
    "names": "SELECT DISTINCT name FROM skills",
    "facts": f"""SELECT o_custkey AS owner, name AS node, o_orderkey AS role_id, l_linenumber AS line, {COMPANY_SQL} AS company, {TITLE_SQL} AS title,
        l_returnflag = 'R' AS impact, l_quantity >= 45 AS validated, l_discount >= 0.09 AS depth, l_linenumber AS months
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN skills ON p_partkey = l_partkey""",
    "nodes": """SELECT owner, node, count(DISTINCT role_id) AS n_roles, bool_or(impact) AS has_impact, bool_or(validated) AS has_validation, bool_or(depth) AS has_depth,
        CAST(sum(months) AS BIGINT) AS total_months, count(*) AS n_evidence, row_number() OVER (PARTITION BY owner ORDER BY node) AS place FROM facts GROUP BY owner, node""",
    "keywords": f"""SELECT DISTINCT o_orderkey AS app, o_custkey AS owner, l_linenumber AS req, l_partkey AS part, pos,
        CASE pos WHEN 1 THEN {sql_chosen(SKILLS, 'l_partkey * 5 + 1')} ELSE {sql_chosen(SKILLS, 'l_partkey * 11 + 4')} END AS kw
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey CROSS JOIN (VALUES (1), (2)) v(pos)""",
    "roles": f"""SELECT o_custkey AS owner, o_orderkey AS ordinal, o_orderstatus AS source, {COMPANY_SQL} AS company, {TITLE_SQL} AS title,
        year(o_orderdate) * 12 + month(o_orderdate) AS start_m, year(o_orderdate) * 12 + month(o_orderdate) + max(l_linenumber) AS end_m
        FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey, o_orderkey, o_orderstatus, o_orderdate""",
    "certs": f"SELECT s_suppkey * 7 + i AS cert_id, s_suppkey AS owner, {sql_chosen(CERTIFICATES, 's_suppkey * 3 + i * 5')} AS cert FROM supplier CROSS JOIN (VALUES (0), (1), (2)) v(i)",
}


def with_tables(*wanted: str, recursive: bool = False) -> str:
    """The WITH clause of the named tables and those that they use."""
    needs = {"names": ["skills"], "facts": ["skills"], "nodes": ["skills", "facts"]}
    all_wanted = {x for w in wanted for x in [w, *needs.get(w, [])]}
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join(f"{name} AS ({sql})" for name, sql in TABLES.items() if name in all_wanted)


def skills(t: Tables) -> DataFrame:
    plain, word = chosen(SKILLS, F.floor(F.col("p_partkey") / 3)), F.split("p_name", " ")
    kind = F.col("p_partkey") % 3
    name = F.when(kind == 0, plain).when(kind == 1, F.concat_ws(" ", word[0], plain)).otherwise(F.concat_ws(" ", plain, word[1]))
    return t.part.select("p_partkey", name.alias("name"))


def names(t: Tables) -> DataFrame:
    return skills(t).select("name").distinct()


def _company_title(orderkey: str = "o_orderkey", custkey: str = "o_custkey") -> list[Column]:
    o, c = F.col(orderkey), F.col(custkey)
    return [chosen(COMPANIES, c * 3 + o % 4).alias("company"), chosen(TITLES, c + o % 5).alias("title")]


def facts(t: Tables) -> DataFrame:
    joined = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).join(skills(t), F.col("p_partkey") == F.col("l_partkey"))
    return joined.select(
        F.col("o_custkey").alias("owner"), F.col("name").alias("node"), F.col("o_orderkey").alias("role_id"), F.col("l_linenumber").alias("line"),
        *_company_title(), (F.col("l_returnflag") == "R").alias("impact"), (F.col("l_quantity") >= 45).alias("validated"),
        (F.col("l_discount") >= 0.09).alias("depth"), F.col("l_linenumber").alias("months"),
    )


def nodes(t: Tables) -> DataFrame:
    # Dealt by owner once, which does for the distinct count, the groups and the places.
    grouped = dealt(facts(t), t.lineitem.count(), "owner").groupBy("owner", "node").agg(
        F.countDistinct("role_id").alias("n_roles"), F.bool_or("impact").alias("has_impact"), F.bool_or("validated").alias("has_validation"),
        F.bool_or("depth").alias("has_depth"), F.sum("months").cast("long").alias("total_months"), F.count(F.lit(1)).alias("n_evidence"),
    )
    return grouped.withColumn("place", F.row_number().over(Window.partitionBy("owner").orderBy("node")).cast("long"))


def asked_words(part: Column) -> list[Column]:
    """The two keywords of a part, in order."""
    return [chosen(SKILLS, k) for k in (part * 5 + 1, part * 11 + 4)]


def asked(part: Column) -> Column:
    """The two keywords of a part, each with its place (``pos``)."""
    return F.array(*[F.struct(F.lit(i).alias("pos"), kw.alias("kw")) for i, kw in enumerate(asked_words(part), 1)])


def requirements(t: Tables) -> DataFrame:
    """The requirements (``app``, ``req``, ``part``), each with its keywords in ``kws``."""
    rows = dealt(t.lineitem, t.lineitem.count(), "l_orderkey").join(t.orders, F.col("o_orderkey") == F.col("l_orderkey"))
    rows = rows.select(F.col("o_orderkey").alias("app"), F.col("o_custkey").alias("owner"), F.col("l_linenumber").alias("req"), F.col("l_partkey").alias("part")).distinct()
    return rows.select("app", "owner", "req", "part", asked(F.col("part")).alias("kws"))


def keywords(t: Tables) -> DataFrame:
    """The keywords of requirements (``app``, ``req``, ``part``) in order (``pos``)."""
    return requirements(t).select("app", "owner", "req", "part", F.inline("kws"))


def keyword_names(t: Tables) -> DataFrame:
    """The distinct keywords, without the orders that they are asked for in."""
    return t.lineitem.select(F.inline(asked(F.col("l_partkey")))).select(F.col("kw").alias("name")).distinct()


def roles(t: Tables) -> DataFrame:
    named = plain_roles(t).select("owner", "ordinal", "source", *_company_title("ordinal", "owner"), "start_m", "end_m")
    return named


def certs(t: Tables) -> DataFrame:
    rows = t.supplier.select(F.col("s_suppkey").alias("owner"), F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("i"))
    key = F.col("owner")
    return rows.select((key * 7 + F.col("i")).alias("cert_id"), "owner", chosen(CERTIFICATES, key * 3 + F.col("i") * 5).alias("cert"))
