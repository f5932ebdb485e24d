"""Cleaning and extraction over the lines of derived profiles, with their DuckDB SQL.

A customer's profile has a head with contacts, a section of roles with dates and bullets, and one of
education, with the artefacts that extraction from pages leaves behind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsieve.functions import grounding as gr
from docsieve.functions import lexicons as lx
from docsieve.functions import spans as sp
from docsieve.functions import text as tx
from docsieve.functions.rules import Rules
from docsieve.operators import lexicon as lex
from docsieve.operators import names as nm
from docsieve.operators import scoring as sc
from docsieve.operators import sections as sn
from docsieve.plans import domain as d
from docsieve.plans.matching_queries import credential, first_of, keyword_nodes, s_credential
from docsieve.plans.registry import query
from docsieve.plans.score_queries import s_addressed, s_fuzzy, s_held, s_numbers, s_similar
from docsieve.sources.tables import Tables

MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
DEGREES = ("Bachelor of Science in Nursing", "MSc Data Analysis", "Master of Business Administration", "B.Sc. Computer Science", "Diploma in Education", "PhD in Physics")
HEADS = ("Profile of Person {0}", "person{0}@mail.example, +49 30 555 {0} | https://www.linkedin.example/in/p{0} | http://p{0}.example/work", "E X P E R I E N C E", "Page 1 of 2", "12")
TAIL = ("EDUCATION", "{degree}, City College, 2008 - 12", "• “Skills”:  Python,   SQL ﬁnance", "References on request")
OPENING = 2_000_000_000


def s_month(m: str) -> str:
    return f"{d.sql_chosen(MONTHS, m + ' - 1 + 12')} || ' ' || CAST(({m} - 1) // 12 AS VARCHAR)"


def month_text(m: Column) -> Column:
    return F.concat_ws(" ", d.chosen(MONTHS, m - 1 + 12), F.floor((m - 1) / 12).cast("string"))


def s_fixed(lines: tuple[str, ...], base: int) -> str:
    degree = d.sql_chosen(DEGREES, "c_custkey")
    each = ", ".join("{'pos': " + str(base + i) + ", 'line': " + "'" + x.replace("'", "''").replace("{degree}", f"' || {degree} || '").replace("{0}", "' || c_custkey || '") + "'}" for i, x in enumerate(lines))
    return f"SELECT c_custkey AS owner, unnest([{each}], recursive := true) FROM customer"


LINES = f"""{d.with_tables('facts', 'roles')}, lines AS ({s_fixed(HEADS, 0)}
  UNION ALL SELECT owner, ordinal * 1000 + 100, title || ', ' || company || ' (' || {s_month('start_m')} || ' - ' || CASE WHEN ordinal % 8 = 0 THEN 'Present' ELSE {s_month('end_m')} END || ')' FROM roles
  UNION ALL SELECT owner, role_id * 1000 + 110 + line * 10, '- ' || CASE WHEN line = 7 THEN 'see' ELSE 'Led ' || min(node) || ' and cut cost by ' || line || '0%' END FROM facts GROUP BY owner, role_id, line
  UNION ALL {s_fixed(TAIL, OPENING)})"""


def profile_lines(t: Tables) -> DataFrame:
    """``owner``, ``pos`` and ``line``."""

    def fixed(lines: tuple[str, ...], base: int) -> DataFrame:
        key = F.col("c_custkey")

        def filled(x: str) -> Column:
            out = F.replace(F.lit(x), F.lit("{0}"), key.cast("string"))
            return F.replace(out, F.lit("{degree}"), d.chosen(DEGREES, key))

        each = F.array(*[F.struct(F.lit(base + i).cast("long").alias("pos"), filled(x).alias("line")) for i, x in enumerate(lines)])
        return t.customer.select(key.alias("owner"), F.inline(each))

    end = F.when(F.col("ordinal") % 8 == 0, "Present").otherwise(month_text(F.col("end_m")))
    head = F.concat(F.concat_ws(", ", "title", "company"), F.lit(" ("), month_text(F.col("start_m")), F.lit(" - "), end, F.lit(")"))
    heads = d.roles(t).select("owner", (F.col("ordinal") * 1000 + 100).alias("pos"), head.alias("line"))
    facts = d.facts(t).groupBy("owner", "role_id", "line").agg(F.min("node").alias("node"))
    said = F.when(F.col("line") == 7, "see").otherwise(F.concat(F.lit("Led "), "node", F.lit(" and cut cost by "), F.col("line").cast("string"), F.lit("0%")))
    bullets = facts.select("owner", (F.col("role_id") * 1000 + 110 + F.col("line") * 10).alias("pos"), F.concat(F.lit("- "), said).alias("line"))
    return fixed(HEADS, 0).unionByName(heads).unionByName(bullets).unionByName(fixed(TAIL, OPENING))


def profile_texts(t: Tables) -> DataFrame:
    each = F.array_sort(F.collect_list(F.struct("pos", "line")))
    return profile_lines(t).groupBy("owner").agg(each.alias("l")).select("owner", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))


TEXTS = f"{LINES}, texts AS (SELECT owner, string_agg(line, chr(10) ORDER BY pos) AS text FROM lines GROUP BY owner)"


# --- cleaning ---

PAGE = "^ *[0-9]{1,3} *$|^ *(?:page|Page) [0-9]+(?: (?:of|/) [0-9]+)? *$"


@query("fn_page_artifacts", f"{LINES} SELECT owner, string_agg(replace(line, chr(12), ''), chr(10) ORDER BY pos) AS text FROM lines WHERE NOT regexp_matches(line, '{PAGE}') GROUP BY owner")
def fn_page_artifacts(t: Tables) -> DataFrame:
    """Bare page numbers, page lines and form feeds go."""
    kept = F.filter(F.split(F.replace("text", F.lit("\f"), F.lit("")), "\n"), lambda x: ~x.rlike(PAGE))
    return profile_texts(t).select("owner", F.array_join(kept, "\n").alias("text"))


def joined_if_spaced(line: Column) -> Column:
    """A line of five parts or more, of which over 60 % are single letters, is one word."""
    parts = F.split(F.trim(line), " +")
    letters = F.size(F.filter(parts, lambda x: x.rlike("^[A-Za-z]$")))
    return F.when((F.size(parts) >= 5) & (letters > 0.6 * F.size(parts)), F.array_join(parts, "")).otherwise(line)


S_PARTS = "regexp_split_to_array(trim(line), ' +')"
S_JOINED = f"CASE WHEN len({S_PARTS}) >= 5 AND len(list_filter({S_PARTS}, lambda x: regexp_matches(x, '^[A-Za-z]$'))) > 0.6 * len({S_PARTS}) THEN array_to_string({S_PARTS}, '') ELSE line END"


@query("fn_spaced_lines", f"{LINES} SELECT owner, pos, {S_JOINED} AS line FROM lines")
def fn_spaced_lines(t: Tables) -> DataFrame:
    return profile_lines(t).select("owner", "pos", joined_if_spaced(F.col("line")).alias("line"))


def s_repaired(x: str) -> str:
    for bad, good in tx.REPAIRS:
        x = f"replace({x}, '{bad.replace(chr(39), chr(39) * 2)}', '{good.replace(chr(39), chr(39) * 2)}')"
    return x


CLEAN = f"""{LINES}, fixed AS (SELECT owner, pos, {s_repaired('line')} AS line FROM lines), kept AS (SELECT owner, pos, {S_JOINED} AS line FROM fixed WHERE NOT regexp_matches(line, '{PAGE}')),
clean AS (SELECT owner, trim(regexp_replace(regexp_replace(regexp_replace(string_agg(line, chr(10) ORDER BY pos), '[ \t]+', ' ', 'g'), ' \n', '\n', 'g'), '\n{{4,}}', '\n\n\n', 'g')) AS text FROM kept GROUP BY owner)"""


def cleaned(t: Tables) -> DataFrame:
    """Encoding, page artefacts, spaced lines and blanks, in this order."""
    kept = F.filter(F.split(tx.repaired(F.col("text")), "\n"), lambda x: ~x.rlike(PAGE))
    lines = F.transform(kept, joined_if_spaced)
    return profile_texts(t).select("owner", F.length("text").alias("before"), F.trim(tx.single_spaced(F.array_join(lines, "\n"))).alias("text"))


@query("fn_normalize_pipeline", f"{CLEAN}, b AS (SELECT owner, length(string_agg(line, chr(10) ORDER BY pos)) AS n FROM lines GROUP BY owner) SELECT owner, text, CAST(floor((n - length(text)) / 4) AS BIGINT) AS saved FROM clean JOIN b USING (owner)")
def fn_normalize_pipeline(t: Tables) -> DataFrame:
    """The text after all steps, and a quarter of the letters saved."""
    return cleaned(t).select("owner", "text", F.floor((F.col("before") - F.length("text")) / 4).alias("saved"))


SECTIONS = ("experience", "education", "skills", "references", "summary", "projects")


@query(
    "fn_quality",
    f"""{CLEAN}, all_texts AS (SELECT 'p' || owner AS id, text FROM clean UNION ALL SELECT 'd' || doc_id, coalesce(text, '') FROM documents),
    m AS (SELECT id, length(text) AS n, {' + '.join(f"CAST(contains(lower(text), '{s}') AS INT)" for s in SECTIONS)} AS sections, len(regexp_extract_all(text, '[^A-Za-zÀ-ÿ0-9\\s.,;:()%@/+&''\"|-]')) / greatest(length(text), 1) AS garbled, len(regexp_extract_all(text, '\\S+')) / greatest(length(text), 1) AS density FROM all_texts)
    SELECT id, CASE WHEN n < 100 OR garbled > 0.3 THEN 'failed' WHEN density < 0.05 THEN 'scanned' WHEN garbled > 0.1 OR sections = 0 OR density > 0.35 THEN 'poor' ELSE 'good' END AS quality, sections FROM m""",
)
def fn_quality(t: Tables) -> DataFrame:
    """By length, section words, garbled letters and words a letter; of profiles and of documents."""
    profiles = cleaned(t).select(F.concat(F.lit("p"), F.col("owner").cast("string")).alias("id"), "text")
    docs = t.documents.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    n = F.length("text")
    sections = F.size(F.filter(F.array(*map(F.lit, SECTIONS)), lambda s: F.contains(F.lower("text"), s)))
    garbled = F.regexp_count("text", F.lit("[^A-Za-zÀ-ÿ0-9\\s.,;:()%@/+&'\"|-]")) / F.greatest(n, F.lit(1))
    density = F.regexp_count("text", F.lit(r"\S+")) / F.greatest(n, F.lit(1))
    m = profiles.unionByName(docs).select("id", n.alias("n"), sections.alias("sections"), garbled.alias("g"), density.alias("w"))
    g, w = F.col("g"), F.col("w")
    quality = F.when((F.col("n") < 100) | (g > 0.3), "failed").when(w < 0.05, "scanned").when((g > 0.1) | (F.col("sections") == 0) | (w > 0.35), "poor").otherwise("good")
    return m.select("id", quality.alias("quality"), "sections")


@query("fn_norm_diacritics", "SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents(text)), '[-–—/\\\\]', ' ', 'g'), '{0}', '', 'g'), '\\s+', ' ', 'g'))) AS norm FROM documents".format(gr.MARKS.replace("'", "''")))
def fn_norm_diacritics(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(gr.normalised(F.col("text"))).alias("norm"))


# --- lines ---

SECTION = Rules([("^(work )?experience$|^employment$", "experience"), ("^education$|^studies$", "education"), ("^(key )?skills$", "skills"), ("^references( on request)?$", "references")], "")
RANGE = "((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) [0-9]{4}|[0-9]{4}) *[-–] *((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) [0-9]{4}|Present|[0-9]{4}|[0-9]{2})"
KINDS = f"{LINES}, k AS (SELECT owner, pos, {S_JOINED} AS line FROM lines), s AS (SELECT owner, pos, line, CASE WHEN length(trim(line)) <= 60 THEN nullif({SECTION.sql('trim(line)')}, '') END AS section FROM k)"


def sectioned(t: Tables) -> DataFrame:
    line = F.trim("line")
    section = F.when(F.length(line) <= 60, F.nullif(SECTION.first(line), F.lit("")))
    return fn_spaced_lines(t).withColumn("section", section)


@query("fn_section_detect", f"{KINDS} SELECT owner, pos, section FROM s WHERE section IS NOT NULL")
def fn_section_detect(t: Tables) -> DataFrame:
    """Lines of sixty letters or fewer that are a section's title."""
    return sectioned(t).where("section IS NOT NULL").select("owner", "pos", "section")


@query(
    "win_section_fill",
    f"{KINDS} SELECT owner, pos, coalesce(last_value(section IGNORE NULLS) OVER (PARTITION BY owner ORDER BY pos), 'head') AS section FROM s",
)
def win_section_fill(t: Tables) -> DataFrame:
    """Each line's section: the last title above it."""
    w = Window.partitionBy("owner").orderBy("pos")
    return sectioned(t).select("owner", "pos", F.coalesce(F.last("section", ignorenulls=True).over(w), F.lit("head")).alias("section"))


@query("fn_role_header", f"{LINES} SELECT owner, pos, trim(regexp_replace(line, ' *\\(?{RANGE}\\)?', '')) AS header, regexp_matches(line, '^ *\\(?{RANGE}\\)? *$') AS date_only FROM lines WHERE length(line) BETWEEN 10 AND 120 AND regexp_matches(line, '{RANGE}') AND NOT starts_with(line, '-')")
def fn_role_header(t: Tables) -> DataFrame:
    """Lines of 10 to 120 letters with a date range: their text without it, and whether there is no other."""
    line = F.col("line")
    rows = profile_lines(t).where(F.length(line).between(10, 120) & line.rlike(RANGE) & ~line.startswith("-"))
    header = F.trim(F.regexp_replace(line, rf" *\(?{RANGE}\)?", ""))
    return rows.select("owner", "pos", header.alias("header"), line.rlike(rf"^ *\(?{RANGE}\)? *$").alias("date_only"))


EDU, CERT, NOT_EDU = r"\b(bachelor|master|diploma|phd|msc|b\.sc|degree)\b", r"\b(certified|certificate|license)\b", r"\b(nurse manager|hospital|ltd|gmbh)\b"


@query("fn_edu_cert_line", f"{LINES} SELECT owner, pos, CASE WHEN regexp_matches(lower(line), '{EDU}') THEN 'education' ELSE 'certificate' END AS kind FROM lines WHERE (regexp_matches(lower(line), '{EDU}') OR regexp_matches(lower(line), '{CERT}')) AND NOT regexp_matches(lower(line), '{NOT_EDU}')")
def fn_edu_cert_line(t: Tables) -> DataFrame:
    low = F.lower("line")
    rows = profile_lines(t).where((low.rlike(EDU) | low.rlike(CERT)) & ~low.rlike(NOT_EDU))
    return rows.select("owner", "pos", F.when(low.rlike(EDU), "education").otherwise("certificate").alias("kind"))


#: Lines that stand where they shouldn't, for some profiles: a company and a degree before any role, roles behind education.
STRAY = ((40, "Blue River Health Ltd", 5), (50, "Master of Arts, City College", 4), (OPENING + 10, "Visiting Teacher, Saint Mary Hospital (Mar 1999 - May 1999)", 3), (OPENING + 11, "Night Nurse, UPS (Jan 1998 - Feb 1998)", 6), (OPENING + 12, "1997 - 1998", 2))
COMPANY_LINE = r"\b(corp|inc|llc|ltd|group|hospital|college)\b[^0-9]*$"
IS_HEADER = "length(line) BETWEEN 10 AND 120 AND regexp_matches(line, '{0}') AND NOT starts_with(line, '-')".format(RANGE)


def strayed(t: Tables) -> DataFrame:
    """Lines with titles of sections and the flags that ``sections.annotated`` reads."""
    more = F.filter(F.array(*[F.when(F.col("c_custkey") % k == 0, F.struct(F.lit(p).cast("long").alias("pos"), F.lit(x).alias("line"))) for p, x, k in STRAY]), lambda x: x.isNotNull())
    stray = t.customer.select(F.col("c_custkey").alias("owner"), F.inline(more))
    line, low = F.col("line"), F.lower("line")
    rows = sectioned(t).select("owner", "pos", "line", "section").unionByName(stray.withColumn("section", F.lit(None).cast("string")))
    told = ~low.rlike(NOT_EDU)
    return rows.withColumns({
        "header": F.length(line).between(10, 120) & line.rlike(RANGE) & ~line.startswith("-"), "date_only": line.rlike(rf"^ *\(?{RANGE}\)? *$"),
        "education": low.rlike(EDU) & told, "excused": (low.rlike(EDU) | low.rlike(CERT)) & told, "company": low.rlike(COMPANY_LINE),
    })


@query(
    "fn_preprocess",
    f"""{KINDS}, stray AS (SELECT c_custkey AS owner, pos, line FROM customer, (VALUES {', '.join(f"({p}, '{x}', {k})" for p, x, k in STRAY)}) v(pos, line, k) WHERE c_custkey % k = 0),
    al AS (SELECT owner, pos, line, section FROM s UNION ALL SELECT owner, pos, line, NULL FROM stray),
    f AS (SELECT owner, line, section, row_number() OVER (PARTITION BY owner ORDER BY pos) AS i, {IS_HEADER} AS header, regexp_matches(line, '^ *\\(?{RANGE}\\)? *$') AS date_only, regexp_matches(lower(line), '{EDU}') AND NOT regexp_matches(lower(line), '{NOT_EDU}') AS edu,
      (regexp_matches(lower(line), '{EDU}') OR regexp_matches(lower(line), '{CERT}')) AND NOT regexp_matches(lower(line), '{NOT_EDU}') AS excused, regexp_matches(lower(line), '{COMPANY_LINE}') AS company FROM al),
    g AS (SELECT *, min(i) FILTER (section = 'experience') OVER (PARTITION BY owner) AS start FROM f), h AS (SELECT *, coalesce(min(i) FILTER (section <> 'experience' AND i > start) OVER (PARTITION BY owner), 1e9) AS stop FROM g),
    m AS (SELECT *, coalesce(i > start AND i < stop, FALSE) AS inside, coalesce(i < start OR i >= stop, FALSE) AND header AND NOT date_only AND NOT excused AS away FROM h),
    o AS (SELECT owner, min(start) AS start, count(*) FILTER (inside AND header) AS n_headers, count(*) FILTER (away) AS n_displaced, min(i) FILTER (inside AND header) AS first_header, min(i) FILTER (inside AND trim(line) <> '') AS first_content,
      string_agg(trim(line), '; ' ORDER BY i) FILTER (away) AS titles, arg_min(company AND NOT header, i) FILTER (inside AND trim(line) <> '') AS titleless FROM m GROUP BY owner),
    lines_out AS (SELECT owner, CAST(i AS DOUBLE) AS place, CASE WHEN away THEN '{sn.DISPLACED}' || line WHEN inside AND edu AND NOT contains(line, '[') THEN '{sn.EDUCATION}' || line ELSE line END AS line FROM m
      UNION ALL SELECT owner, start + 0.1, '{sn.BELOW}' FROM o WHERE n_headers >= 2 AND first_header > start + 3 UNION ALL SELECT owner, start + 0.2, '{sn.ELSEWHERE}' || titles || ']' FROM o WHERE n_displaced > 0
      UNION ALL SELECT owner, first_content - 0.5, '{sn.TITLELESS.replace("'", "''")}' FROM o WHERE n_headers > 0 AND titleless)
    SELECT owner, string_agg(line, chr(10) ORDER BY place) AS text, min(n_headers) AS n_headers, min(n_displaced) AS n_displaced FROM lines_out JOIN o USING (owner) GROUP BY owner""",
)
def fn_preprocess(t: Tables) -> DataFrame:
    """The text with marks before displaced titles and education, and notes inserted where a section begins and before a block without title."""
    return sn.annotated(strayed(t))


JOURNALS = "(Journal of|Annals of|Proceedings of|Review of)"


@query("fn_unglue_titles", f"SELECT ordinal, regexp_replace(said, '([a-z.])({JOURNALS[1:-1]})', '\\1\n\\2', 'g') AS unglued FROM ({d.with_tables('roles')} SELECT ordinal, 'Studies of ' || lower(title) || {d.sql_chosen(('Journal of Work', 'Annals of Care', ' in Review of Books', ''), 'ordinal')} AS said FROM roles)")
def fn_unglue_titles(t: Tables) -> DataFrame:
    """A line break before a journal's name that is glued to the word before."""
    tail = d.chosen(("Journal of Work", "Annals of Care", " in Review of Books", ""), F.col("ordinal"))
    said = F.concat(F.lit("Studies of "), F.lower("title"), tail)
    return d.roles(t).select("ordinal", F.regexp_replace(said, f"([a-z.]){JOURNALS}", "$1\n$2").alias("unglued"))


@query("fn_clean_title", f"{LINES} SELECT owner, pos, trim(regexp_replace(regexp_replace(regexp_replace(line, '^[•*# -]+', ''), ' *\\(?{RANGE}\\)? *$', ''), '(?i)^(experience|education|skills): *', '')) AS title FROM lines WHERE pos >= 100")
def fn_clean_title(t: Tables) -> DataFrame:
    """Without bullets, date ranges at the end and section words."""
    title = F.regexp_replace(F.regexp_replace("line", "^[•*# -]+", ""), rf" *\(?{RANGE}\)? *$", "")
    title = F.trim(F.regexp_replace(title, "(?i)^(experience|education|skills): *", ""))
    return profile_lines(t).where("pos >= 100").select("owner", "pos", title.alias("title"))


GARBAGE = "^[^A-Za-z]*$|^(see|page|references?)\\b"


@query("fn_filter_bullets", f"{LINES} SELECT owner, pos, substr(line, 3) AS bullet FROM lines WHERE starts_with(line, '- ') AND length(substr(line, 3)) BETWEEN 15 AND 500 AND NOT regexp_matches(lower(substr(line, 3)), '{GARBAGE}')")
def fn_filter_bullets(t: Tables) -> DataFrame:
    bullet = F.substring("line", 3, 100_000)
    rows = profile_lines(t).where(F.col("line").startswith("- ")).select("owner", "pos", bullet.alias("bullet"))
    return rows.where(F.length("bullet").between(15, 500) & ~F.lower("bullet").rlike(GARBAGE))


STOPLIST = ("etc", "various", "skills", "references")


@query(
    "fn_verify_skills",
    f"""{d.with_tables('skills')}, s AS (SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'in ' || name WHEN 1 THEN name || '.,' WHEN 2 THEN '12' WHEN 3 THEN 'etc' WHEN 4 THEN name || ' and some more long words behind it' ELSE name END AS raw FROM skills),
    c AS (SELECT p_partkey, trim(regexp_replace(raw, '^[ .,;:•-]+|[ .,;:•-]+$', '', 'g')) AS skill FROM s)
    SELECT p_partkey, skill, length(skill) >= 2 AND len(string_split(skill, ' ')) <= 6 AND NOT regexp_matches(skill, '^[0-9 .,%]+$') AND lower(skill) NOT IN ({', '.join(f"'{w}'" for w in STOPLIST)}) AND NOT regexp_matches(lower(skill), '^(in|of|with|for|led|managed) ') AS accepted FROM c""",
)
def fn_verify_skills(t: Tables) -> DataFrame:
    """Trimmed of punctuation; short, long, numeric and stop words go, and what begins with a preposition or verb."""
    k, name = F.col("p_partkey") % 7, F.col("name")
    raw = F.when(k == 0, F.concat(F.lit("in "), name)).when(k == 1, F.concat(name, F.lit(".,"))).when(k == 2, "12").when(k == 3, "etc").when(k == 4, F.concat(name, F.lit(" and some more long words behind it"))).otherwise(name)
    rows = d.skills(t).select("p_partkey", F.trim(F.regexp_replace(raw, "^[ .,;:•-]+|[ .,;:•-]+$", "")).alias("skill"))
    s, low = F.col("skill"), F.lower("skill")
    good = (F.length(s) >= 2) & (F.size(F.split(s, " ")) <= 6) & ~s.rlike("^[0-9 .,%]+$") & ~low.isin(*STOPLIST) & ~low.rlike("^(in|of|with|for|led|managed) ")
    return rows.select("p_partkey", "skill", good.alias("accepted"))


# --- contacts and numbers ---


def s_all(pattern: str, column: str = "text", group: int = 0) -> str:
    return f"regexp_extract_all({column}, '{pattern.replace(chr(39), chr(39) * 2)}', {group})"


PHONES = f"list_filter(list_transform({s_all(tx.PHONE)}, lambda p: trim(p)), lambda p: length(regexp_replace(p, '[^0-9]', '', 'g')) BETWEEN 7 AND 15)"
PROFILE_URL = "linkedin|github"


def s_distinct(values: str) -> str:
    return f"array_to_string(list_sort(list_distinct({values})), ',')"


@query(
    "fn_contact",
    f"""{TEXTS}, all_texts AS (SELECT 'p' || owner AS id, text FROM texts UNION ALL SELECT 'd' || doc_id, coalesce(text, '') FROM documents)
    SELECT id, {s_distinct(s_all(tx.EMAIL))} AS emails, {s_distinct(PHONES)} AS phones, {s_distinct(f"list_filter({s_all(tx.URL)}, lambda u: regexp_matches(u, '{PROFILE_URL}'))")} AS profiles,
    list_filter({s_all(tx.URL)}, lambda u: NOT regexp_matches(u, '{PROFILE_URL}'))[1] AS portfolio FROM all_texts""",
)
def fn_contact(t: Tables) -> DataFrame:
    """E-mail addresses, phones of 7 to 15 digits, profile URLs, and the first other URL."""
    profiles = profile_texts(t).select(F.concat(F.lit("p"), F.col("owner").cast("string")).alias("id"), "text")
    docs = t.documents.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.coalesce("text", F.lit("")).alias("text"))

    def found(pattern: str) -> Column:
        return F.regexp_extract_all("text", F.lit(f"({pattern})"), 1)

    def listed(values: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(values)), ",")

    phones = F.filter(F.transform(found(tx.PHONE), lambda p: F.trim(p)), lambda p: F.length(F.regexp_replace(p, "[^0-9]", "")).between(7, 15))
    urls = found(tx.URL)
    mine, others = F.filter(urls, lambda u: u.rlike(PROFILE_URL)), F.filter(urls, lambda u: ~u.rlike(PROFILE_URL))
    return profiles.unionByName(docs).select("id", listed(found(tx.EMAIL)).alias("emails"), listed(phones).alias("phones"), listed(mine).alias("profiles"), F.try_element_at(others, F.lit(1)).alias("portfolio"))


@query("fn_redact_pii", f"{TEXTS} SELECT owner, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '{tx.EMAIL}', '[e-mail]', 'g'), '{tx.URL.replace(chr(39), chr(39) * 2)}', '[link]', 'g'), '{tx.PHONE}', '[phone]', 'g'), 'Person ([0-9])[0-9]*', 'P. \\1', 'g') AS masked FROM texts")
def fn_redact_pii(t: Tables) -> DataFrame:
    """E-mail addresses, links and phones are masked, names cut to initials."""
    masked = F.col("text")
    for pattern, by in ((tx.EMAIL, "[e-mail]"), (tx.URL, "[link]"), (tx.PHONE, "[phone]"), ("Person ([0-9])[0-9]*", "P. $1")):
        masked = F.regexp_replace(masked, pattern, by)
    return profile_texts(t).select("owner", masked.alias("masked"))


@query("fn_metrics", f"{TEXTS} SELECT owner, array_to_string(list_sort({s_numbers('text')}), ';') AS numbers FROM texts")
def fn_metrics(t: Tables) -> DataFrame:
    return profile_texts(t).select("owner", F.array_join(F.array_sort(sc.numbers(F.col("text"))), ";").alias("numbers"))


BASIC_NUMBERS = "[0-9]+%|[$][0-9][0-9,.]*|[0-9]+ (?:people|projects|teams)"


@query("fn_metrics_basic", f"{LINES} SELECT owner, pos, array_to_string({s_all(BASIC_NUMBERS, 'line')}, ';') AS metrics FROM lines WHERE regexp_matches(line, '{BASIC_NUMBERS}')")
def fn_metrics_basic(t: Tables) -> DataFrame:
    found = F.regexp_extract_all("line", F.lit(f"({BASIC_NUMBERS})"), 1)
    return profile_lines(t).where(F.col("line").rlike(BASIC_NUMBERS)).select("owner", "pos", F.array_join(found, ";").alias("metrics"))


@query("agg_achievements", f"{LINES} SELECT owner, pos // 1000 AS role_id, pos, unnest({s_all(BASIC_NUMBERS, 'line')}) AS metric, substr(line, 3) AS said FROM lines WHERE starts_with(line, '- ')")
def agg_achievements(t: Tables) -> DataFrame:
    """A row for each metric of a role's bullets."""
    rows = profile_lines(t).where(F.col("line").startswith("- "))
    found = F.explode(F.regexp_extract_all("line", F.lit(f"({BASIC_NUMBERS})"), 1))
    return rows.select("owner", F.floor(F.col("pos") / 1000).alias("role_id"), "pos", found.alias("metric"), F.substring("line", 3, 100_000).alias("said"))


@query("fn_tech_terms", f"{TEXTS}, {lx.TECHNOLOGIES.sql()}, {lex.s_hits('texts', 'owner', 'text', 'technologies', 'tech')}, placed AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY pos, place) AS k FROM tech) SELECT t.owner, coalesce(string_agg(phrase, ',' ORDER BY k) FILTER (k <= 15), '') AS terms, count(phrase) AS n_terms FROM texts t LEFT JOIN placed p ON p.owner = t.owner GROUP BY t.owner")
def fn_tech_terms(t: Tables) -> DataFrame:
    """Distinct technologies in the order of their first mention, fifteen at most, and how many there are."""
    texts = profile_texts(t)
    found = lex.hits(texts, ["owner"], "text", lx.TECHNOLOGIES.table(t.spark)).groupBy("owner").agg(F.array_sort(F.collect_list(F.struct("at", "place", "phrase"))).alias("l"))
    rows = texts.select("owner").join(found, "owner", "left")
    terms = F.coalesce(F.array_join(F.transform(F.slice("l", 1, 15), lambda x: x["phrase"]), ","), F.lit(""))
    return rows.select("owner", terms.alias("terms"), F.coalesce(F.size("l"), F.lit(0)).cast("long").alias("n_terms"))


@query("fn_term_match", f"{TEXTS}, q AS (SELECT owner, lower(text) AS text, lower({d.sql_chosen(('CI/CD', 'Machine Learning', 'astro-physics', 'data (big)', 'Go'), 'owner')}) AS term FROM texts) SELECT owner, term, {s_held('term', 'text')} AS matched FROM q")
def fn_term_match(t: Tables) -> DataFrame:
    """A term, or any part of it of three letters or more, stands in the text."""
    term = F.lower(d.chosen(("CI/CD", "Machine Learning", "astro-physics", "data (big)", "Go"), F.col("owner")))
    rows = profile_texts(t).select("owner", F.lower("text").alias("text"), term.alias("term"))
    return rows.select("owner", "term", sc.term_held(F.col("term"), F.col("text")).alias("matched"))


NEEDS = ("5+ years of experience with Python and SQL", "Strong knowledge", "Critical care nursing, patient care or first aid", "Welding", "Degree in astronomy, cosmology and optics")


@query("fn_topic_addressed", f"{TEXTS}, q AS (SELECT owner, lower(text) AS text, {d.sql_chosen(NEEDS, 'owner')} AS need FROM texts) SELECT owner, need, {s_addressed('need', 'text')} AS addressed FROM q")
def fn_topic_addressed(t: Tables) -> DataFrame:
    rows = profile_texts(t).select("owner", F.lower("text").alias("text"), d.chosen(NEEDS, F.col("owner")).alias("need"))
    return rows.select("owner", "need", sc.addressed(F.col("need"), F.col("text")).alias("addressed"))


# --- dates ---


NOW = 2002
COURSES = ("Course (2008 - 12)", "Course\t1999 - 01\tand\t1996 - 98", "Since 2001 – Present, before (1997 - 95)", "Sept. 1999-Current and Mon 1990 — 1991", "Nothing (1998-99), twice (1998-99)")


def dated_texts(t: Tables) -> DataFrame:
    """Profiles with a line of dates in other forms at their end."""
    return profile_texts(t).select("owner", F.concat_ws("\n", "text", d.chosen(COURSES, F.col("owner"))).alias("text"))


def s_forms() -> str:
    """Places from the lengths of what lies between the matches and of the matches; the last form's lookahead is a letter more."""
    forms = [f.replace("(?![0-9])", "(?:[^0-9]|$)").replace("'", "''") for f in sp.FORMS]
    each = " UNION ALL ".join(
        f"SELECT owner, text, {i} AS form, string_split_regex(text, '{f}') AS gap, regexp_extract_all(text, '{f}') AS hit, regexp_extract_all(text, '{f}', 1) AS low, regexp_extract_all(text, '{f}', 2) AS high FROM dated"
        for i, f in enumerate(forms, 1)
    )
    tail = "CASE WHEN form = 3 THEN regexp_replace(h, '[^0-9]$', '') ELSE h END"
    return f"""{TEXTS}, dated AS (SELECT owner, text || chr(10) || {d.sql_chosen(COURSES, 'owner').replace(chr(92) + 't', chr(9))} AS text FROM texts), each AS ({each}),
    placed AS (SELECT owner, text, form, i, hit[i] AS h, CAST(list_sum(list_transform(gap[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hit[1:i - 1], lambda x: length(x))), 0) AS INT) AS place, CAST(low[i] AS INT) AS low, high[i] AS last FROM each, unnest(range(1, len(hit) + 1)) u(i)),
    read AS (SELECT owner, text, form, place, {tail} AS raw, low, CASE WHEN length(last) = 2 THEN low // 100 * 100 + CAST(last AS INT) WHEN regexp_matches(last, '^[0-9]') THEN CAST(last AS INT) ELSE {NOW} END AS high, length(last) = 2 AS short FROM placed),
    good AS (SELECT * FROM read WHERE NOT short OR high BETWEEN low AND {NOW + 1}),
    ranges AS (SELECT owner, text, form, place, place + length(raw) AS stop, trim(raw, chr(9) || ' ') AS range, low, high FROM good g WHERE form = 1 OR NOT EXISTS (SELECT 1 FROM good o WHERE o.owner = g.owner AND abs(o.place - g.place) < {sp.NEAR} AND (o.form < g.form OR (o.form = g.form AND o.place < g.place))))"""


DATED = s_forms()


def date_ranges(t: Tables) -> DataFrame:
    return sp.with_ranges(dated_texts(t), "text", NOW)


@query("fn_date_ranges", f"{DATED} SELECT owner, place, stop, form, range, low, high, greatest(1, (high - low) * 12) AS months FROM ranges")
def fn_date_ranges(t: Tables) -> DataFrame:
    """Every date range of a text with its place (letters from 0), by four forms; near ones are one range."""
    months = F.greatest(F.lit(1), (F.col("high") - F.col("low")) * 12)
    return date_ranges(t).select("owner", F.inline("ranges")).select("owner", F.col("at").alias("place"), "stop", "form", "range", "low", "high", months.alias("months"))


YEARS = "([12][0-9]{3}) *[-–] *([12][0-9]{3}|[0-9]{2})"


@query(
    "fn_date_range_line",
    f"""{LINES}, r AS (SELECT owner, pos, regexp_extract(line, '{YEARS}', 1) AS low, regexp_extract(line, '{YEARS}', 2) AS high FROM lines WHERE regexp_matches(line, '{YEARS}')) SELECT owner, pos, CAST(low AS INT) AS low, CAST(CASE WHEN length(high) = 2 THEN left(low, 2) || high ELSE high END AS INT) AS high FROM r""",
)
def fn_date_range_line(t: Tables) -> DataFrame:
    """The first range of years of a line; two digits at its end are of the same century."""
    low, high = F.regexp_extract("line", YEARS, 1), F.regexp_extract("line", YEARS, 2)
    rows = profile_lines(t).where(F.col("line").rlike(YEARS))
    return rows.select("owner", "pos", low.cast("int").alias("low"), F.when(F.length(high) == 2, F.concat(F.left(low, F.lit(2)), high)).otherwise(high).cast("int").alias("high"))


BEFORE, AFTER = 300, 800


@query(
    "win_date_range_context",
    f"""{DATED}, n AS (SELECT *, lead(place) OVER (PARTITION BY owner ORDER BY place) AS following FROM ranges)
    SELECT owner, place, range, substring(text, greatest(0, place - {BEFORE}) + 1, place - greatest(0, place - {BEFORE})) AS before, substring(text, stop + 1, greatest(0, coalesce(following, least(length(text), place + {AFTER})) - stop)) AS after FROM n""",
)
def win_date_range_context(t: Tables) -> DataFrame:
    """What stands before each date range, up to 300 letters, and behind it, up to the next range or 800 letters from its start."""
    ranges = F.col("ranges")
    following = F.slice(F.concat(F.transform(ranges, lambda r: r["at"]), F.array(F.lit(None).cast("int"))), 2, F.greatest(F.size(ranges), F.lit(1)))
    rows = date_ranges(t).where(F.size(ranges) > 0).select("owner", "text", F.inline(F.arrays_zip(ranges.alias("r"), following.alias("following"))))
    at, stop = F.col("r.at"), F.col("r.stop")
    low = F.greatest(F.lit(0), at - BEFORE)
    end = F.coalesce("following", F.least(F.length("text"), at + AFTER))
    return rows.select(
        "owner", at.alias("place"), F.col("r.range").alias("range"), F.substring(F.col("text"), low + 1, at - low).alias("before"),
        F.substring(F.col("text"), stop + 1, F.greatest(F.lit(0), end - stop)).alias("after"),
    )


ASKS = ("At least 5 years experience", "3+ years of experience", "2-4 years' experience", "experience of years", "10 YEARS EXPERIENCE required")
YEARS_ASKED = "([0-9]{1,2})\\+?(?: *- *[0-9]+)? *years?'?(?: of)? experience"


ASKED_SQL = YEARS_ASKED.replace("'", "''")


@query("fn_years_required", f"SELECT s_suppkey, CAST(nullif(regexp_extract(lower({d.sql_chosen(ASKS, 's_suppkey')}), '{ASKED_SQL}', 1), '') AS INT) AS years FROM supplier")
def fn_years_required(t: Tables) -> DataFrame:
    asked = F.lower(d.chosen(ASKS, F.col("s_suppkey")))
    return t.supplier.select("s_suppkey", F.nullif(F.regexp_extract(asked, YEARS_ASKED, 1), F.lit("")).cast("int").alias("years"))


@query("fn_staleness", "SELECT o_custkey, date_diff('day', CAST(max(o_orderdate) AS DATE), DATE '2001-12-31') AS days, date_diff('day', CAST(max(o_orderdate) AS DATE), DATE '2001-12-31') >= 90 AS stale FROM orders GROUP BY o_custkey")
def fn_staleness(t: Tables) -> DataFrame:
    """Days since the last rotation, 90 of which make it stale."""
    days = F.datediff(F.lit("2001-12-31").cast("date"), F.max("o_orderdate").cast("date"))
    return t.orders.groupBy("o_custkey").agg(days.cast("long").alias("days"), (days >= 90).alias("stale"))


@query("agg_export_experience", f"{d.with_tables('roles')} SELECT owner, CAST(floor((max(CASE WHEN ordinal % 8 = 0 THEN 24024 ELSE end_m END) - min(start_m)) / 12.0 + 0.5) AS BIGINT) AS years FROM roles GROUP BY owner")
def agg_export_experience(t: Tables) -> DataFrame:
    """From the first start to the last end, an open end being now (January 2002), in rounded years."""
    end = F.when(F.col("ordinal") % 8 == 0, 24024).otherwise(F.col("end_m"))
    return d.roles(t).groupBy("owner").agg(F.floor((F.max(end) - F.min("start_m")) / 12.0 + 0.5).alias("years"))


# --- names ---

DEGREE = Rules([("doctor|phd", "PhD"), ("master|msc|mba", "Master"), ("bachelor|b\\.sc", "Bachelor"), ("diploma", "Diploma")], "other")
FIELD = Rules([("business admin", "business"), ("computer|software", "computing"), ("nurs", "nursing"), ("data|analy", "data"), ("educat|teach", "education"), ("physic", "physics")], "general")


@query("fn_norm_degree_field", f"WITH g AS (SELECT c_custkey, {d.sql_chosen(DEGREES, 'c_custkey')} AS name FROM customer) SELECT c_custkey, {DEGREE.sql('name')} AS degree, {FIELD.sql('name')} AS field FROM g")
def fn_norm_degree_field(t: Tables) -> DataFrame:
    rows = t.customer.select("c_custkey", d.chosen(DEGREES, F.col("c_custkey")).alias("name"))
    return rows.select("c_custkey", DEGREE.first(F.col("name")).alias("degree"), FIELD.first(F.col("name")).alias("field"))


@query("fn_norm_credential", f"{d.with_tables('certs')} SELECT cert_id, {s_credential('cert')} AS key FROM certs")
def fn_norm_credential(t: Tables) -> DataFrame:
    return d.certs(t).select("cert_id", credential(F.col("cert")).alias("key"))


ACRONYM = "\\b([A-Z]{2,5})\\b"


@query(
    "fn_norm_cert",
    f"""{d.with_tables('certs')}, n AS (SELECT cert_id, regexp_extract(cert, '{ACRONYM}', 1) AS short, regexp_extract(cert, '\\b(?:in|of) ([A-Za-z]+)$', 1) AS field, cert FROM certs)
    SELECT cert_id, lower(CASE WHEN short <> '' AND field <> '' THEN short || ' ' || field WHEN short <> '' THEN short ELSE array_to_string(string_split(cert, ' ')[1:3], ' ') END) AS key FROM n""",
)
def fn_norm_cert(t: Tables) -> DataFrame:
    """The acronym, with the field if there is one; else the first three words."""
    short, field = F.regexp_extract("cert", ACRONYM, 1), F.regexp_extract("cert", r"\b(?:in|of) ([A-Za-z]+)$", 1)
    three = F.array_join(F.slice(F.split("cert", " "), 1, 3), " ")
    key = F.when((short != "") & (field != ""), F.concat_ws(" ", short, field)).when(short != "", short).otherwise(three)
    return d.certs(t).select("cert_id", F.lower(key).alias("key"))


TITLE_WORDS = (("sr", "senior"), ("jr", "junior"), ("mgr", "manager"), ("eng", "engineer"), ("dept", "department"))
RAW_TITLES = ("Sr. Eng.", "Jr. Mgr", "Dept Head", "Sr Project Manager", "Engineer")


def s_titled(x: str) -> str:
    out = f"regexp_replace(lower({x}), '[.]', '', 'g')"
    for a, b in TITLE_WORDS:
        out = f"regexp_replace({out}, '\\b{a}\\b', '{b}', 'g')"
    return f"trim({out})"


S_PLAIN = "trim(regexp_replace({0}, '\\b(" + "|".join(nm.LEGAL_FORMS) + ")\\b.*$', ''))"


@query("fn_norm_company_title", f"{d.with_tables('roles')} SELECT ordinal, {S_PLAIN.format(d.s_norm('company'))} AS company, {s_titled(d.sql_chosen(RAW_TITLES, 'ordinal'))} AS title FROM roles")
def fn_norm_company_title(t: Tables) -> DataFrame:
    """Companies without legal forms; abbreviations of titles written out."""
    title = F.regexp_replace(F.lower(d.chosen(RAW_TITLES, F.col("ordinal"))), "[.]", "")
    for a, b in TITLE_WORDS:
        title = F.regexp_replace(title, rf"\b{a}\b", b)
    return d.roles(t).select("ordinal", nm.without_legal_form(F.col("company")).alias("company"), F.trim(title).alias("title"))


CORES = ("Acme Corp., Berlin", "Blue River (North) Ltd", "Initech – Labs", "UPS", "Globex; Paris")


@query("fn_company_core", f"WITH c AS (SELECT s_suppkey, {d.sql_chosen(CORES, 's_suppkey')} AS name FROM supplier) SELECT s_suppkey, trim(regexp_replace(lower(name), '[^a-z0-9 ]', '', 'g')) AS plain, trim(regexp_split_to_array(lower(name), '[,(–;-]')[1]) AS core FROM c")
def fn_company_core(t: Tables) -> DataFrame:
    """The name without punctuation, and what stands before a dash, comma or bracket."""
    low = F.lower(d.chosen(CORES, F.col("s_suppkey")))
    return t.supplier.select("s_suppkey", F.trim(F.regexp_replace(low, "[^a-z0-9 ]", "")).alias("plain"), F.trim(F.element_at(F.split(low, "[,(–;-]"), 1)).alias("core"))


FILES = ("Copy of my_cv.pdf", "cv (2).docx", "final-cv.v3.pdf", "Copy (3) of report", "plain")


@query("fn_short_name", f"WITH f AS (SELECT s_suppkey, {d.sql_chosen(FILES, 's_suppkey')} AS name FROM supplier) SELECT s_suppkey, trim(regexp_replace(regexp_replace(regexp_replace(name, '\\.[A-Za-z0-9]+$', ''), '^Copy( \\([0-9]+\\))? of ', ''), ' \\([0-9]+\\)$', '')) AS name FROM f")
def fn_short_name(t: Tables) -> DataFrame:
    """Without extension and marks of copies."""
    name = F.regexp_replace(F.regexp_replace(d.chosen(FILES, F.col("s_suppkey")), r"\.[A-Za-z0-9]+$", ""), r"^Copy( \([0-9]+\))? of ", "")
    return t.supplier.select("s_suppkey", F.trim(F.regexp_replace(name, r" \([0-9]+\)$", "")).alias("name"))


HOLDERS = ("N/A", "tbd", "Company Name", "your name here", "-", "Acme", "unknown", "Lorem ipsum")
HOLDER = r"^(n/?a|tbd|none|null|unknown|company name|your name( here)?|lorem ipsum|[.-]*)$"


@query("fn_placeholder", f"SELECT s_suppkey, regexp_matches(lower(trim({d.sql_chosen(HOLDERS, 's_suppkey')})), '{HOLDER}') AS placeholder FROM supplier")
def fn_placeholder(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey", F.lower(F.trim(d.chosen(HOLDERS, F.col("s_suppkey")))).rlike(HOLDER).alias("placeholder"))


# --- scores of fields ---

PLACES = ("Berlin, Germany", "Berlin", "Remote", "Bern, Switzerland", "", "Munich; Berlin", "Remote (Germany)", "Berlim")
PLACE_PAIRS = f"pl AS (SELECT s_suppkey * 8 + i AS id, lower(trim({d.sql_chosen(PLACES, 's_suppkey')})) AS p, lower(trim({d.sql_chosen(PLACES, 's_suppkey + i')})) AS e FROM supplier CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6), (7)) v(i))"
S_CITY = "trim(regexp_split_to_array({0}, '[,;(]')[1])"
S_SIM = "CASE WHEN greatest(length({0}), length({1})) = 0 THEN 1.0 ELSE 1 - levenshtein({0}, {1}) / greatest(length({0}), length({1})) END"


@query(
    "fn_location_score",
    f"""WITH {PLACE_PAIRS} SELECT id, round(CASE WHEN p = '' AND e = '' THEN 1.0 WHEN e = '' THEN 0.5 WHEN p = '' THEN 0.0 WHEN p = e THEN 1.0 WHEN contains(p, 'remote') AND contains(e, 'remote') THEN 1.0 WHEN contains(p, 'remote') OR contains(e, 'remote') THEN 0.2
    WHEN {S_CITY.format('p')} = {S_CITY.format('e')} THEN 0.9 WHEN {S_SIM.format(S_CITY.format('p'), S_CITY.format('e'))} >= 0.8 THEN 0.8 WHEN contains(p, {S_CITY.format('e')}) OR contains(e, {S_CITY.format('p')}) THEN 0.7 ELSE {S_SIM.format('p', 'e')} END, 6) AS score FROM pl""",
)
def fn_location_score(t: Tables) -> DataFrame:
    """Empty and remote places first, then equal or near cities, one of several cities, else the edit distance."""
    k = F.col("s_suppkey")
    rows = t.supplier.select(k, F.explode(F.array(*map(F.lit, range(8)))).alias("i"))
    rows = rows.select((k * 8 + F.col("i")).alias("id"), F.lower(F.trim(d.chosen(PLACES, k))).alias("p"), F.lower(F.trim(d.chosen(PLACES, k + F.col("i")))).alias("e"))
    p, e = F.col("p"), F.col("e")
    a, b = (F.trim(F.element_at(F.split(c, "[,;(]"), 1)) for c in (p, e))
    remote = [F.contains(c, F.lit("remote")) for c in (p, e)]
    score = (
        F.when((p == "") & (e == ""), 1.0).when(e == "", 0.5).when(p == "", 0.0).when(p == e, 1.0).when(remote[0] & remote[1], 1.0).when(remote[0] | remote[1], 0.2)
        .when(a == b, 0.9).when(tx.similarity(a, b) >= 0.8, 0.8).when(F.contains(p, b) | F.contains(e, a), 0.7).otherwise(tx.similarity(p, e))
    )
    return rows.select("id", F.round(score, 6).alias("score"))


COMPANY_PAIRS = f"{d.with_tables('roles')}, c AS (SELECT DISTINCT company AS n FROM roles), cp AS (SELECT a.n AS a, b.n AS b, {d.s_norm('a.n')} AS p, {d.s_norm('b.n')} AS e FROM c a JOIN c b ON a.n <= b.n)"
S_INITIALS = "array_to_string(list_transform(string_split({0}, ' '), lambda w: left(w, 1)), '')"
S_COMMON = f"coalesce(len(list_intersect({d.s_sig('a')}, {d.s_sig('b')})) / nullif(len(list_distinct(list_concat({d.s_sig('a')}, {d.s_sig('b')}))), 0), 0)"


@query(
    "fn_company_score",
    f"""{COMPANY_PAIRS} SELECT a, b, round(CASE WHEN p = e THEN 1.0 WHEN contains(p, e) OR contains(e, p) THEN 0.9 WHEN {S_INITIALS.format('p')} = e OR {S_INITIALS.format('e')} = p THEN 0.85
    WHEN {S_PLAIN.format('p')} = {S_PLAIN.format('e')} THEN 0.85 ELSE greatest({S_COMMON}, {S_SIM.format('p', 'e')}) END, 6) AS score FROM cp""",
)
def fn_company_score(t: Tables) -> DataFrame:
    """Equal, contained, initials, the same but for the legal form, else common words or the edit distance; of the few names."""
    names = d.roles(t).select("company").distinct()
    pairs = names.select(F.col("company").alias("a")).join(names.select(F.col("company").alias("b")), F.col("a") <= F.col("b"))
    p, e = tx.basic(F.col("a")), tx.basic(F.col("b"))

    def initials(x: Column) -> Column:
        return F.array_join(F.transform(F.split(x, " "), lambda w: F.left(w, F.lit(1))), "")

    common = F.coalesce(tx.jaccard(tx.significant(F.col("a")), tx.significant(F.col("b"))), F.lit(0.0))
    plain = nm.without_legal_form(F.col("a")) == nm.without_legal_form(F.col("b"))
    score = F.when(p == e, 1.0).when(F.contains(p, e) | F.contains(e, p), 0.9).when((initials(p) == e) | (initials(e) == p), 0.85).when(plain, 0.85).otherwise(F.greatest(common, tx.similarity(p, e)))
    return pairs.select("a", "b", F.round(score, 6).alias("score"))


STRINGS = f"st AS (SELECT id, p AS got, e AS want FROM pl), pairs AS (SELECT DISTINCT p, e FROM pl), {s_similar('pairs')}, k AS (SELECT st.*, sims.jw AS jw_got FROM st JOIN sims ON sims.p = got AND sims.e = want)"


@query("fn_string_field_score", f"WITH {PLACE_PAIRS}, {STRINGS} SELECT id, round({s_fuzzy('got', 'want', 0.5)[0]}, 6) AS score, {s_fuzzy('got', 'want', 0.5)[1]} AS passed FROM k")
def fn_string_field_score(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    rows = t.supplier.select(k, F.explode(F.array(*map(F.lit, range(8)))).alias("i"))
    rows = rows.select((k * 8 + F.col("i")).alias("id"), F.lower(F.trim(d.chosen(PLACES, k))).alias("p"), F.lower(F.trim(d.chosen(PLACES, k + F.col("i")))).alias("e"))
    return rows.select("id", sc.fuzzy_field(F.col("p"), F.col("e"), 0.5).alias("r")).select("id", F.round("r.score", 6).alias("score"), "r.passed")


# --- postings and certificates as texts ---

POST = f"""{d.with_tables('roles')}, post AS (SELECT ordinal, CASE ordinal % 3 WHEN 0 THEN 'Company: ' || company || chr(10) || 'Job title: ' || title || chr(10) || 'Location: Berlin' WHEN 1 THEN company || ' is hiring a ' || title || ' in Munich.' ELSE 'We look for a ' || title || '.' END || chr(10) || {d.sql_chosen(('3-5 years experience', 'at least 4 years', '7+ years', 'no years named'), 'ordinal')} AS text FROM roles)"""
FIELD_PATTERNS = {
    "company": ("Company: ([^\n]+)", "([A-Z][A-Za-z ]+?) is hiring", None),
    "title": ("Job title: ([^\n]+)", "hiring an? ([A-Z][A-Za-z ]+?) in ", "look for an? ([A-Z][A-Za-z ]+)\\."),
    "location": ("Location: ([^\n]+)", " in ([A-Z][a-z]+)\\.", None),
}
RANGES = "([0-9]+) *- *([0-9]+) years"
LEAST = "(?:at least )?([0-9]+)\\+? years"


def s_first(patterns: tuple) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract(text, '{p}', 1), '')" for p in patterns if p) + ")"


@query("fn_jd_fields", f"{POST} SELECT ordinal, {', '.join(f'{s_first(p)} AS {n}' for n, p in FIELD_PATTERNS.items())}, CAST(coalesce(nullif(regexp_extract(text, '{RANGES}', 1), ''), nullif(regexp_extract(text, '{LEAST}', 1), '')) AS INT) AS years_min, CAST(nullif(regexp_extract(text, '{RANGES}', 2), '') AS INT) AS years_max FROM post")
def fn_jd_fields(t: Tables) -> DataFrame:
    """Company, title, place and range of years of a posting, by patterns in the order of their confidence."""
    n = F.col("ordinal")
    head = F.when(n % 3 == 0, F.concat(F.lit("Company: "), "company", F.lit("\nJob title: "), "title", F.lit("\nLocation: Berlin")))
    head = head.when(n % 3 == 1, F.concat("company", F.lit(" is hiring a "), "title", F.lit(" in Munich."))).otherwise(F.concat(F.lit("We look for a "), "title", F.lit(".")))
    text = F.concat_ws("\n", head, d.chosen(("3-5 years experience", "at least 4 years", "7+ years", "no years named"), n))
    rows = d.roles(t).select("ordinal", text.alias("text"))

    def first(*patterns: str | None, group: int = 1) -> Column:
        return F.coalesce(*[F.nullif(F.regexp_extract("text", p, group), F.lit("")) for p in patterns if p])

    years = {"years_min": F.coalesce(first(RANGES), first(LEAST)).cast("int"), "years_max": first(RANGES, group=2).cast("int")}
    return rows.select("ordinal", *[first(*p).alias(name) for name, p in FIELD_PATTERNS.items()], *[c.alias(name) for name, c in years.items()])


CERT_TEXT = f"""{d.with_tables('certs')}, ct AS (SELECT cert_id, CASE cert_id % 3 WHEN 0 THEN 'This is to certify that Person ' || owner || ' has completed ' || cert || chr(10) || 'Issued by Northwind Institute on 12 Mar 2019' WHEN 1 THEN cert || ' | City College | 2018-05-04' ELSE 'Notes about ' || cert END AS text FROM certs)"""
PATTERNS = {"name": ("has completed ([^\n]+)", "^([^|\n]+) \\|"), "issuer": ("Issued by ([^\n]+?) on ", "\\| ([^|\n]+) \\|"), "issued": ("on ([0-9]{1,2} [A-Z][a-z]{2} [0-9]{4})", "([0-9]{4}-[0-9]{2}-[0-9]{2})")}
INDICATORS = ("certify", "completed", "issued by", "college", "license")


@query(
    "fn_certificate",
    f"""{CERT_TEXT}, x AS (SELECT cert_id, {', '.join(f'{s_first(p)} AS {n}' for n, p in PATTERNS.items())}, {' + '.join(f"CAST(contains(lower(text), '{w}') AS INT)" for w in INDICATORS)} AS hits FROM ct)
    SELECT cert_id, name, issuer, issued, hits >= 2 AS is_certificate, round((CAST(name IS NOT NULL AS INT) + CAST(issuer IS NOT NULL AS INT) + CAST(issued IS NOT NULL AS INT)) / 3, 6) AS confidence FROM x QUALIFY row_number() OVER (PARTITION BY coalesce(name, CAST(cert_id AS VARCHAR)), issuer ORDER BY cert_id) = 1""",
)
def fn_certificate(t: Tables) -> DataFrame:
    """Name, issuer and date in two formats, how many were found, and whether two words tell a certificate; one of each name and issuer."""
    n = F.col("cert_id")
    long = F.concat(F.lit("This is to certify that Person "), F.col("owner").cast("string"), F.lit(" has completed "), "cert", F.lit("\nIssued by Northwind Institute on 12 Mar 2019"))
    text = F.when(n % 3 == 0, long).when(n % 3 == 1, F.concat("cert", F.lit(" | City College | 2018-05-04"))).otherwise(F.concat(F.lit("Notes about "), "cert"))
    rows = d.certs(t).select("cert_id", text.alias("text"))
    fields = {name: F.coalesce(*[F.nullif(F.regexp_extract("text", p, 1), F.lit("")) for p in patterns]) for name, patterns in PATTERNS.items()}
    hits = F.size(F.filter(F.array(*map(F.lit, INDICATORS)), lambda w: F.contains(F.lower("text"), w)))
    x = rows.select("cert_id", *[c.alias(name) for name, c in fields.items()], (hits >= 2).alias("is_certificate"))
    known = sum((F.col(c).isNotNull().cast("int") for c in ("issuer", "issued")), F.col("name").isNotNull().cast("int"))
    keyed = x.withColumns({"confidence": F.round(known / 3, 6), "key": F.coalesce("name", n.cast("string"))})
    return first_of(keyed, ["key", "issuer"], "cert_id").drop("key")


DATE_FORMS = ("12 Mar 2019", "2018-05-04", "March 2017", "undated")
FORMS = ("([0-9]{1,2} [A-Z][a-z]{2} [0-9]{4})", "([0-9]{4}-[0-9]{2}-[0-9]{2})", "([A-Z][a-z]+ [0-9]{4})")


@query("fn_cert_date_name", f"WITH c AS (SELECT s_suppkey, 'Awarded to Anna Person ' || s_suppkey || ' on ' || {d.sql_chosen(DATE_FORMS, 's_suppkey')} AS text FROM supplier) SELECT s_suppkey, {s_first(FORMS)} AS issued, nullif(regexp_extract(text, 'Awarded to ([A-Z][a-z]+ [A-Z][a-z]+)', 1), '') AS recipient FROM c")
def fn_cert_date_name(t: Tables) -> DataFrame:
    text = F.concat(F.lit("Awarded to Anna Person "), F.col("s_suppkey").cast("string"), F.lit(" on "), d.chosen(DATE_FORMS, F.col("s_suppkey")))
    rows = t.supplier.select("s_suppkey", text.alias("text"))
    issued = F.coalesce(*[F.nullif(F.regexp_extract("text", p, 1), F.lit("")) for p in FORMS])
    return rows.select("s_suppkey", issued.alias("issued"), F.nullif(F.regexp_extract("text", "Awarded to ([A-Z][a-z]+ [A-Z][a-z]+)", 1), F.lit("")).alias("recipient"))


BROKEN = ('Here it is: {{"k": {0}, "l": [1, 2,],}} thanks', '```json\n{{"k": {0}}}\n```', '{{"k": {0},}}', 'nothing here')


@query("fn_json_repair", "SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS INTEGER) END AS k, CASE WHEN event_id % 4 = 0 THEN 2 END AS n FROM events")
def fn_json_repair(t: Tables) -> DataFrame:
    """Fences, words around the outermost braces and commas before a close go; what then doesn't parse is null."""
    k = F.get_json_object("props", "$.k")
    raw = F.element_at(F.array(*[F.replace(F.lit(b.format("@")), F.lit("@"), k) for b in BROKEN]), (F.col("event_id") % 4 + 1).cast("int"))
    body = F.regexp_extract(F.regexp_replace(raw, "```[a-z]*", ""), r"(?s)(\{.*\})", 1)
    fixed = F.from_json(F.regexp_replace(body, r",\s*([\]}])", "$1"), "k int, l array<int>")
    return t.events.select("event_id", fixed.alias("j")).select("event_id", "j.k", F.when(F.col("j.l").isNotNull(), F.size("j.l")).alias("n"))


# --- questions ---


@query(
    "fn_gap_questions",
    f"""{d.with_tables('nodes')}, q AS (SELECT owner, node, unnest([CASE WHEN n_roles = 0 THEN {{'rank': 1, 'question': 'Where did you use ' || node || '?'}} END, CASE WHEN NOT has_impact THEN {{'rank': 2, 'question': 'What did ' || node || ' change?'}} END,
      CASE WHEN NOT has_validation THEN {{'rank': 3, 'question': 'Who can vouch for ' || node || '?'}} END, CASE WHEN n_roles = 1 AND total_months < 3 THEN {{'rank': 4, 'question': 'Did you use ' || node || ' elsewhere?'}} END]) AS x FROM nodes)
    SELECT owner, node, x.rank AS rank, x.question AS question FROM q WHERE x IS NOT NULL QUALIFY row_number() OVER (PARTITION BY owner ORDER BY x.rank, node) <= 5""",
)
def fn_gap_questions(t: Tables) -> DataFrame:
    """One to four templates by what a node lacks, the five of highest priority for each owner."""
    node = F.col("node")

    def ask(when: Column, rank: int, before: str, after: str) -> Column:
        return F.when(when, F.struct(F.lit(rank).alias("rank"), F.concat(F.lit(before), node, F.lit(after)).alias("question")))

    asked = F.array(
        ask(F.col("n_roles") == 0, 1, "Where did you use ", "?"), ask(~F.col("has_impact"), 2, "What did ", " change?"),
        ask(~F.col("has_validation"), 3, "Who can vouch for ", "?"), ask((F.col("n_roles") == 1) & (F.col("total_months") < 3), 4, "Did you use ", " elsewhere?"),
    )
    rows = d.nodes(t).select("owner", "node", F.inline(F.filter(asked, lambda x: x.isNotNull())))
    place = F.row_number().over(Window.partitionBy("owner").orderBy("rank", "node"))
    return rows.withColumn("place", place).where("place <= 5").drop("place")


@query(
    "jn_jd_questions",
    f"""{d.with_tables('nodes', 'keywords')}, w AS (SELECT app, owner, kw, min(CASE WHEN part % 2 = 0 THEN 0 ELSE 1 END) AS rank FROM keywords GROUP BY app, owner, kw),
    pairs AS (SELECT k.kw, n.node FROM (SELECT DISTINCT kw FROM w) k JOIN (SELECT DISTINCT node FROM nodes) n ON {d.s_skills('n.node', 'k.kw')}),
    m AS (SELECT w.app, w.kw, w.rank, n.node, n.has_validation, n.has_depth, n.has_impact FROM w JOIN pairs USING (kw) JOIN nodes n ON n.owner = w.owner AND n.node = pairs.node QUALIFY row_number() OVER (PARTITION BY w.app, w.kw ORDER BY n.place) = 1)
    SELECT app, kw, node FROM m WHERE NOT has_validation AND NOT (has_depth AND has_impact) QUALIFY row_number() OVER (PARTITION BY app ORDER BY rank, kw) <= 3""",
)
def jn_jd_questions(t: Tables) -> DataFrame:
    """Distinct skills of a posting, hard ones first, with a node that is worth a question; three for each."""
    rank = F.when(F.col("part") % 2 == 0, 0).otherwise(1)
    wanted = d.keywords(t).groupBy("app", "owner", "kw").agg(F.min(rank).alias("rank"))
    met = keyword_nodes(t, wanted, "kw", d.keyword_names(t)).where("NOT has_validation AND NOT (has_depth AND has_impact)")
    place = F.row_number().over(Window.partitionBy("app").orderBy("rank", "kw"))
    return met.withColumn("at", place).where("at <= 3").select("app", "kw", "node")
