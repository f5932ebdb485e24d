"""Text functions, classifiers, dates, similarity and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsieve.functions import stats
from docsieve.functions import text as tx
from docsieve.operators import temporal as tm
from docsieve.plans.registry import LINES, NODES, ROLES, query
from docsieve.plans.standins import lines, nodes, roles
from docsieve.sources.tables import Tables

BASIC = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
WORDS = f"list_filter(string_split({BASIC}, ' '), lambda w: w <> '')"
STOPS = ", ".join(f"'{w}'" for w in tx.STOP)
SIGNIFICANT = f"list_distinct(list_filter({WORDS}, lambda w: length(w) > 1 AND w NOT IN ({STOPS})))"


def chained(expression: str) -> str:
    for bad, good in tx.REPAIRS:
        expression = f"replace({expression}, '{bad.replace(chr(39), chr(39) * 2)}', '{good.replace(chr(39), chr(39) * 2)}')"
    return expression


def count_sql(pattern: str, column: str = "text") -> str:
    return f"len(regexp_extract_all({column}, '{pattern.replace(chr(39), chr(39) * 2)}'))"


# --- normalising and words ---


@query("fn_norm_basic", f"SELECT doc_id, md5({BASIC.format('text')}) AS norm FROM documents")
def fn_norm_basic(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(tx.basic(F.col("text"))).alias("norm"))


@query("fn_sig_words", f"SELECT doc_id, len({SIGNIFICANT.format('text')}) AS n FROM documents")
def fn_sig_words(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.size(tx.significant(F.col("text"))).cast("long").alias("n"))


@query("fn_extract_words", "SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[ ,()/\n]+'), lambda w: length(w) >= 4)) AS n FROM documents")
def fn_extract_words(t: Tables) -> DataFrame:
    found = F.filter(F.split("text", "[ ,()/\n]+"), lambda w: F.length(w) >= 4)
    return t.documents.select("doc_id", F.size(found).cast("long").alias("n"))


@query(
    "fn_stem_match",
    "SELECT a.p_partkey, left(a.p_name, CASE WHEN length(a.p_name) < 5 THEN length(a.p_name) ELSE 6 END) = left(b.p_name, CASE WHEN length(a.p_name) < 5 THEN length(b.p_name) ELSE 6 END) AS same_stem "
    "FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1",
)
def fn_stem_match(t: Tables) -> DataFrame:
    b = t.part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"))
    short = F.length("p_name") < 5
    a_stem = F.left("p_name", F.when(short, F.length("p_name")).otherwise(6))
    b_stem = F.left("other", F.when(short, F.length("other")).otherwise(6))
    return t.part.join(b, "p_partkey").select("p_partkey", (a_stem == b_stem).alias("same_stem"))


@query("fn_fix_encoding", f"SELECT doc_id, md5({chained('text')}) AS fixed FROM documents")
def fn_fix_encoding(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(tx.repaired(F.col("text"))).alias("fixed"))


@query(
    "fn_whitespace",
    "SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), ' \n', '\n', 'g'), '\n{4,}', '\n\n\n', 'g')) AS spaced FROM documents",
)
def fn_whitespace(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(tx.single_spaced(F.col("text"))).alias("spaced"))


@query(
    "fn_column_flag",
    f"WITH {LINES} SELECT doc_id, count(*) > 30 AND count(*) FILTER (length(trim(line)) BETWEEN 1 AND 34) > 0.7 * count(*) FILTER (trim(line) <> '') AS columned FROM lines GROUP BY doc_id",
)
def fn_column_flag(t: Tables) -> DataFrame:
    size = F.length(F.trim("line"))
    narrow, filled = F.count_if(size.between(1, 34)), F.count_if(size > 0)
    return lines(t).groupBy("doc_id").agg(((F.count(F.lit(1)) > 30) & (narrow > 0.7 * filled)).alias("columned"))


@query("fn_flatten_doc", "SELECT conv_id, CAST(sum(length(coalesce(text, ''))) + count(*) - 1 AS BIGINT) AS n_chars FROM conversations GROUP BY conv_id")
def fn_flatten_doc(t: Tables) -> DataFrame:
    turns = F.sort_array(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))))
    return t.conversations.groupBy("conv_id").agg(F.length(F.concat_ws(" ", turns["text"])).cast("long").alias("n_chars"))


@query("fn_template", f"WITH {NODES} SELECT owner, node, 'Used ' || node || ' in ' || n_roles || ' roles over ' || total_months || ' months.' AS sentence FROM nodes")
def fn_template(t: Tables) -> DataFrame:
    sentence = F.format_string("Used %s in %d roles over %d months.", "node", "n_roles", "total_months")
    return nodes(t).select("owner", "node", sentence.alias("sentence"))


# --- similarity and statistics ---

PAIRS = """pairs AS (SELECT p_partkey, p_name AS a, lead(p_name) OVER (ORDER BY p_partkey) AS b FROM part QUALIFY b IS NOT NULL)"""


def name_pairs(t: Tables) -> DataFrame:
    """Each part's name and that of the part with the next key (keys are gapless)."""
    b = t.part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("b"))
    return t.part.select("p_partkey", F.col("p_name").alias("a")).join(b, "p_partkey")


@query("fn_levenshtein", f"WITH {PAIRS} SELECT p_partkey, levenshtein(a, b) AS d FROM pairs")
def fn_levenshtein(t: Tables) -> DataFrame:
    return name_pairs(t).select("p_partkey", F.levenshtein("a", "b").cast("long").alias("d"))


LEV = "CASE WHEN greatest(length(a), length(b)) = 0 THEN 1.0 ELSE 1 - levenshtein(a, b) / greatest(length(a), length(b)) END"


@query("fn_lev_sim", f"WITH {PAIRS} SELECT p_partkey, round({LEV}, 6) AS sim FROM pairs")
def fn_lev_sim(t: Tables) -> DataFrame:
    return name_pairs(t).select("p_partkey", F.round(tx.similarity(F.col("a"), F.col("b")), 6).alias("sim"))


JACCARD = "len(list_intersect({0}, {1})) / nullif(len(list_distinct(list_concat({0}, {1}))), 0)"


@query("set_word_overlap", f"WITH {PAIRS}, w AS (SELECT p_partkey, {SIGNIFICANT.format('a')} AS x, {SIGNIFICANT.format('b')} AS y FROM pairs) SELECT p_partkey, round({JACCARD.format('x', 'y')}, 6) AS overlap FROM w")
def set_word_overlap(t: Tables) -> DataFrame:
    share = tx.jaccard(tx.significant(F.col("a")), tx.significant(F.col("b")))
    return name_pairs(t).select("p_partkey", F.round(share, 6).alias("overlap"))


GRAMS = "list_distinct(list_transform(generate_series(1, len({0}) - 2), lambda i: {0}[i] || ' ' || {0}[i + 1] || ' ' || {0}[i + 2]))"


@query(
    "set_ngram_jaccard",
    f"""WITH w AS (SELECT conv_id, turn, {WORDS.format("text")} AS w FROM conversations WHERE text IS NOT NULL), g AS (SELECT conv_id, turn, CASE WHEN len(w) >= 3 THEN {GRAMS.format('w')} ELSE [] END AS g FROM w)
    SELECT a.conv_id, a.turn, round({JACCARD.format('a.g', 'b.g')}, 6) AS drift FROM g a JOIN g b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1""",
)
def set_ngram_jaccard(t: Tables) -> DataFrame:
    g = t.conversations.where("text IS NOT NULL").select("conv_id", "turn", tx.ngrams(tx.words(F.col("text")), 3).alias("g"))
    b = g.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("g").alias("h"))
    return g.join(b, ["conv_id", "turn"]).select("conv_id", "turn", F.round(tx.jaccard(F.col("g"), F.col("h")), 6).alias("drift"))


@query("fn_title_overlap", f"WITH {PAIRS}, w AS (SELECT p_partkey, {WORDS.format('a')} AS x, {WORDS.format('b')} AS y FROM pairs) SELECT p_partkey, {JACCARD.format('x', 'y')} >= 0.5 AS overlaps FROM w")
def fn_title_overlap(t: Tables) -> DataFrame:
    share = tx.jaccard(tx.words(F.col("a")), tx.words(F.col("b")))
    return name_pairs(t).select("p_partkey", (share >= 0.5).alias("overlaps"))


@query("fn_drift", f"WITH {PAIRS}, s AS (SELECT p_partkey, {LEV} AS s FROM pairs) SELECT p_partkey, CASE WHEN s >= 0.6 THEN 'none' WHEN s >= 0.4 THEN 'mild' ELSE 'severe' END AS drift FROM s")
def fn_drift(t: Tables) -> DataFrame:
    s = tx.similarity(F.col("a"), F.col("b"))
    return name_pairs(t).select("p_partkey", F.when(s >= 0.6, "none").when(s >= 0.4, "mild").otherwise("severe").alias("drift"))


@query(
    "fn_anova",
    """WITH p AS (SELECT event_type, CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END AS g, count(*) AS n, sum(value) AS s, sum(value * value) AS q FROM events GROUP BY ALL),
    t AS (SELECT event_type, sum(n) AS n, sum(s) AS s, sum(q) AS q, count(*) AS k, sum(s * s / n) AS b FROM p GROUP BY event_type)
    SELECT event_type, k - 1 AS df1, CAST(n - k AS BIGINT) AS df2, round(((b - s * s / n) / (k - 1)) / ((q - b) / (n - k)), 5) AS f FROM t""",
)
def fn_anova(t: Tables) -> DataFrame:
    rows = t.events.withColumn("g", F.when(F.col("user_id") % 2 == 0, "a").otherwise("b"))
    return stats.anova(rows, ["event_type"], "g", "value").withColumn("f", F.round("f", 5))


def s_beta(x: str, a: str, b: str, terms: int = 300) -> str:
    """The regularised incomplete beta function: its continued fraction, folded from its far end, on the side where it converges."""

    def lower(x: str, a: str, b: str) -> str:
        top = f"CASE WHEN j % 2 = 0 THEN j / 2 * ({b} - j / 2) ELSE -({a} + (j - 1) / 2) * ({a} + {b} + (j - 1) / 2) END"
        fraction = f"list_reduce(list_transform(range({terms}, 0, -1), lambda j: CAST(j AS DOUBLE)), lambda t, j: 1 + ({top}) * {x} / (({a} + j - 1) * ({a} + j) * t), CAST(1 AS DOUBLE))"
        return f"exp({a} * ln({x}) + {b} * ln(1 - {x}) + lgamma({a} + {b}) - lgamma({a}) - lgamma({b})) / ({a} * {fraction})"

    return f"(CASE WHEN {x} > ({a} + 1) / ({a} + {b} + 2) THEN 1 - {lower(f'(1 - {x})', b, a)} ELSE {lower(x, a, b)} END)"


def s_normal_tail(z: str) -> str:
    t = f"(1 / (1 + 0.3275911 * {z} / sqrt(2)))"
    series = "0.0"
    for c in (1.061405429, -1.453152027, 1.421413741, -0.284496736, 0.254829592):
        series = f"({series} + {c}) * {t}"
    return f"({series} * exp(-{z} * {z} / 2) / 2)"


def s_f_pvalue(f: str, df2: str) -> str:
    """With one degree of freedom above."""
    x, half = f"({df2} / ({df2} + {f}))", f"({df2} / 2.0)"
    return f"(CASE WHEN {f} <= 0 THEN 1.0 WHEN isinf({f}) THEN 0.0 WHEN {df2} >= {stats.MANY} THEN 2 * {s_normal_tail(f'sqrt({f})')} ELSE {s_beta(x, half, '0.5')} END)"


def s_two_groups(rows: str, keys: str, second: str, value: str) -> str:
    """CTEs ``sums``, ``spread`` and ``fs`` (keys, n, gain, f)."""
    side = [f"count({value}) FILTER ({w}) AS n{i}, sum({value}) FILTER ({w}) AS s{i}, sum({value} * {value}) FILTER ({w}) AS q{i}" for i, w in ((1, f"NOT ({second})"), (2, second))]
    return f"""sums AS (SELECT {keys}, {', '.join(side)} FROM {rows} GROUP BY {keys}),
    spread AS (SELECT {keys}, n1, n2, n1 + n2 AS n, s2 / nullif(n2, 0) - s1 / nullif(n1, 0) AS gain, q1 - s1 * s1 / n1 + q2 - s2 * s2 / n2 AS within FROM sums),
    fs AS (SELECT {keys}, n, gain, CAST(CASE WHEN n1 < 2 OR n2 < 2 THEN 0 WHEN within <= 1e-12 THEN CASE WHEN abs(gain) > 1e-12 THEN 'inf' ELSE 0 END ELSE gain * gain * n1 * n2 / n / (within / (n - 2)) END AS DOUBLE) AS f FROM spread)"""


FEW_EVENTS = "ev AS (SELECT user_id, event_id % 2 = 1 AS odd, value FROM events)"


@query("fn_f_pvalue", f"WITH {FEW_EVENTS}, {s_two_groups('ev', 'user_id', 'odd', 'value')} SELECT user_id, n, round(f, 5) AS f, round({s_f_pvalue('f', '(n - 2)')}, 6) AS p_value FROM fs")
def fn_f_pvalue(t: Tables) -> DataFrame:
    """Of each user whether the values of odd and even events differ; users have few events and many."""
    rows = t.events.withColumn("value", F.col("value").cast("double"))
    found = stats.two_groups(rows, ["user_id"], F.col("event_id") % 2 == 1, "value")
    return found.select("user_id", "n", F.round("f", 5).alias("f"), F.round("p_value", 6).alias("p_value"))


PURCHASES = "b AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS s, count(*) AS n FROM events GROUP BY user_id)"


def s_beta_ci(rows: str, keys: str, s: str = "s", n: str = "n") -> str:
    """CTEs ``halving`` and ``ci`` (keys, s, n, low, high): both ends by 45 halvings."""
    step = s_beta("((lo + hi) / 2)", f"(1.0 + {s})", f"(1.0 + {n} - {s})", 120)
    return f"""halving AS (SELECT {keys}, {s}, {n}, p, 0 AS k, CAST(0 AS DOUBLE) AS lo, CAST(1 AS DOUBLE) AS hi FROM {rows}, (VALUES (0.025), (0.975)) v(p)
      UNION ALL SELECT {keys}, {s}, {n}, p, k + 1, CASE WHEN under THEN (lo + hi) / 2 ELSE lo END, CASE WHEN under THEN hi ELSE (lo + hi) / 2 END FROM (SELECT *, {step} < p AS under FROM halving) WHERE k < 45),
    ci AS (SELECT {keys}, {s}, {n}, max(lo) FILTER (p = 0.025) AS low, max(lo) FILTER (p = 0.975) AS high FROM halving WHERE k = 45 GROUP BY {keys}, {s}, {n})"""


@query("fn_beta_ci", f"WITH RECURSIVE {PURCHASES}, {s_beta_ci('b', 'user_id')} SELECT user_id, s, n, round(low, 6) AS low, round(high, 6) AS high FROM ci")
def fn_beta_ci(t: Tables) -> DataFrame:
    s = t.events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("s"), F.count(F.lit(1)).alias("n"))
    ci = stats.beta_interval("s", "n")
    return s.select("user_id", "s", "n", ci.alias("ci")).select("user_id", "s", "n", F.round("ci.low", 6).alias("low"), F.round("ci.high", 6).alias("high"))


@query("fn_beta_inc", f"WITH {PURCHASES} SELECT user_id, round({s_beta('0.5', '(0.5 + s)', '(0.5 + n - s)')}, 6) AS under_half, round({s_beta('0.1', '(0.5 + s)', '(0.5 + n - s)')}, 6) AS under_tenth FROM b")
def fn_beta_inc(t: Tables) -> DataFrame:
    """The chances that a user's true share of purchases is under a half, and under a tenth, after s of n, with shapes from a half on."""
    s = t.events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("s"), F.count(F.lit(1)).alias("n"))
    a, b = 0.5 + F.col("s"), 0.5 + F.col("n") - F.col("s")
    return s.select("user_id", *[F.round(stats.beta_under(F.lit(x), a, b), 6).alias(name) for x, name in ((0.5, "under_half"), (0.1, "under_tenth"))])


@query("fn_numeric_tol", "SELECT p_partkey, CASE WHEN abs(p_size - 25) = 0 THEN 1.0 WHEN abs(p_size - 25) <= 1 THEN 0.8 ELSE 0.0 END AS score FROM part")
def fn_numeric_tol(t: Tables) -> DataFrame:
    d = F.abs(F.col("p_size") - 25)
    return t.part.select("p_partkey", F.when(d == 0, 1.0).when(d <= 1, 0.8).otherwise(0.0).alias("score"))


HALVES = "h AS (SELECT user_id, avg(CAST(event_type = 'purchase' AS INT)) FILTER (ts < TIMESTAMP '2024-01-15') AS a, avg(CAST(event_type = 'purchase' AS INT)) FILTER (ts >= TIMESTAMP '2024-01-15') AS b FROM events GROUP BY user_id)"


def halves(t: Tables) -> DataFrame:
    """The share of purchases before and after the middle of the month."""
    hit, early = (F.col("event_type") == "purchase").cast("int"), F.col("ts") < F.lit("2024-01-15").cast("timestamp")
    return t.events.groupBy("user_id").agg(F.avg(F.when(early, hit)).alias("a"), F.avg(F.when(~early, hit)).alias("b"))


@query("fn_regression", f"WITH {HALVES} SELECT user_id, round(100 * (b - a), 4) AS change_pp, abs(b - a) >= 0.02 AS meaningful FROM h")
def fn_regression(t: Tables) -> DataFrame:
    d = F.col("b") - F.col("a")
    return halves(t).select("user_id", F.round(100 * d, 4).alias("change_pp"), (F.abs(d) >= 0.02).alias("meaningful"))


@query("fn_overfit", f"WITH {HALVES} SELECT user_id, CASE WHEN a - b >= 0.25 THEN 'severe' WHEN a - b >= 0.15 THEN 'mild' ELSE 'none' END AS overfit FROM h")
def fn_overfit(t: Tables) -> DataFrame:
    d = F.col("a") - F.col("b")
    return halves(t).select("user_id", F.when(d >= 0.25, "severe").when(d >= 0.15, "mild").otherwise("none").alias("overfit"))


@query("fn_years_verdict", "SELECT p_partkey, CASE WHEN p_size - 25 > 1 THEN 'exceeds' WHEN p_size >= 25 THEN 'meets' WHEN p_size >= 24 THEN 'close' WHEN p_size >= 23 THEN 'short' ELSE 'major' END AS verdict FROM part")
def fn_years_verdict(t: Tables) -> DataFrame:
    d = F.col("p_size") - 25
    verdict = F.when(d > 1, "exceeds").when(d >= 0, "meets").when(d >= -1, "close").when(d >= -2, "short").otherwise("major")
    return t.part.select("p_partkey", verdict.alias("verdict"))


# --- dates ---

ORDINAL = "(year(o_orderdate) * 12 + month(o_orderdate))"


def written_dates(t: Tables) -> DataFrame:
    """Order dates as people write them, in five ways by key."""
    d = F.col("o_orderdate")
    ways = ["MMM yyyy", "yyyy", "yyyy-MM", "MM/yyyy", "MMM ''yy"]
    text = F.when(F.col("way") == 0, F.date_format(d, ways[0]))
    for i, w in enumerate(ways[1:], 1):
        text = text.when(F.col("way") == i, F.date_format(d, w))
    return t.orders.withColumn("way", F.col("o_orderkey") % 5).select("o_orderkey", "way", d, text.alias("written"))


@query(
    "fn_parse_role_date",
    f"SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 1 THEN year(o_orderdate) * 12 + 1 ELSE {ORDINAL} END AS start_m, CASE WHEN o_orderkey % 5 = 1 THEN year(o_orderdate) * 12 + 12 ELSE {ORDINAL} END AS end_m FROM orders",
)
def fn_parse_role_date(t: Tables) -> DataFrame:
    now = F.lit(2024 * 12 + 1)
    start, end = (tm.parse_role_date(F.col("written"), side, now) for side in (False, True))
    return written_dates(t).select("o_orderkey", start.alias("start_m"), end.alias("end_m"))


@query("fn_parse_months", f"SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 1 THEN year(o_orderdate) * 12 + 1 ELSE {ORDINAL} END AS month_no FROM orders")
def fn_parse_months(t: Tables) -> DataFrame:
    parsed = tm.parse_role_date(F.col("written"), True, F.lit(0), year_only="january")
    return written_dates(t).select("o_orderkey", parsed.alias("month_no"))


@query("fn_parse_export_date", "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m') WHEN 1 THEN strftime(o_orderdate, '%Y') END AS month FROM orders")
def fn_parse_export_date(t: Tables) -> DataFrame:
    """'Mon YYYY' as 'YYYY-MM' and a bare year as itself; null for other forms, which an export doesn't have."""
    text = F.col("written")
    number = tm.month_number(F.regexp_extract(text, "^([A-Za-z]{3,9}) [0-9]{4}$", 1))
    month = F.format_string("%s-%02d", F.regexp_extract(text, "([0-9]{4})$", 1), number)
    return written_dates(t).select("o_orderkey", F.when(number.isNotNull(), month).when(text.rlike("^[0-9]{4}$"), text).alias("month"))


@query("fn_months_between", f"WITH {ROLES} SELECT ordinal, end_m - start_m AS signed_months, greatest(0, 24 - (end_m - start_m)) AS left_months FROM roles")
def fn_months_between(t: Tables) -> DataFrame:
    d = F.col("end_m") - F.col("start_m")
    return roles(t).select("ordinal", d.alias("signed_months"), F.greatest(F.lit(0), 24 - d).alias("left_months"))


@query("fn_extract_year", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 4 THEN year(o_orderdate) END AS yr FROM orders")
def fn_extract_year(t: Tables) -> DataFrame:
    """The first plausible year of four digits; null where there is none."""
    year = F.nullif(F.regexp_extract("written", "((19|20)[0-9]{2})", 1), F.lit("")).cast("int")
    return written_dates(t).select("o_orderkey", year.alias("yr"))


@query("fn_date_in_text", "SELECT doc_id, regexp_matches(text, '(19|20)[0-9][0-9]') AS has_year FROM documents")
def fn_date_in_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.col("text").rlike("(19|20)[0-9][0-9]").alias("has_year"))


@query("fn_duration_text", "SELECT p_partkey, p_size AS total FROM part")
def fn_duration_text(t: Tables) -> DataFrame:
    """'N years M months' as months, from texts made of a number of months."""
    text = F.format_string("%d years %d months", F.floor(F.col("p_size") / 12), F.col("p_size") % 12)
    years, rest = (F.regexp_extract(text, f"([0-9]+) {u}", 1).cast("int") for u in ("year", "month"))
    return t.part.select("p_partkey", (years * 12 + rest).alias("total"))


@query("fn_evidence_decay", "SELECT user_id, max(ts) FILTER (event_type = 'signup') >= TIMESTAMP '2024-01-20' AS answered_lately FROM events GROUP BY user_id")
def fn_evidence_decay(t: Tables) -> DataFrame:
    last = F.max(F.when(F.col("event_type") == "signup", F.col("ts")))
    return t.events.groupBy("user_id").agg((last >= F.lit("2024-01-20").cast("timestamp")).alias("answered_lately"))


# --- classifiers: rules in order ---


@query("cls_verdict", f"WITH {NODES} SELECT owner, node, CASE WHEN (n_roles >= 2 AND (has_impact OR has_validation)) OR (n_roles >= 1 AND has_depth AND has_impact) THEN 'strong' WHEN n_roles >= 1 OR has_depth THEN 'exists' ELSE 'claimed' END AS verdict FROM nodes")
def cls_verdict(t: Tables) -> DataFrame:
    from docsieve.operators.evidence import verdict

    return nodes(t).select("owner", "node", verdict().alias("verdict"))


@query("cls_skip_answer", "SELECT conv_id, turn, length(trim(text)) < 5 OR regexp_matches(lower(text), '^(skip|no|none|pass)$') AS skipped FROM conversations WHERE text IS NOT NULL")
def cls_skip_answer(t: Tables) -> DataFrame:
    skip = (F.length(F.trim("text")) < 5) | F.lower("text").rlike("^(skip|no|none|pass)$")
    return t.conversations.where("text IS NOT NULL").select("conv_id", "turn", skip.alias("skipped"))


@query(
    "win_item_lengths",
    "SELECT lang, doc_id, n_chars - avg(n_chars) OVER (PARTITION BY lang) > 0 AS above_mean FROM documents",
)
def win_item_lengths(t: Tables) -> DataFrame:
    mean = F.avg("n_chars").over(Window.partitionBy("lang"))
    return t.documents.select("lang", "doc_id", (F.col("n_chars") - mean > 0).alias("above_mean"))
