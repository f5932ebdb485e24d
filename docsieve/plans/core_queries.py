"""Scans, sinks, filters, projections, aggregates, windows, sorts, samples and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsieve.operators import evidence as ev
from docsieve.operators import temporal as tm
from docsieve.plans.registry import APPLICATIONS, EVIDENCE, NODES, ROLES, query
from docsieve.plans.standins import applications, evidence, nodes, roles
from docsieve.sources import tables as src
from docsieve.sources.tables import Tables

# --- scans, sources and sinks ---


@query("src_table_select", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def src_table_select(t: Tables) -> DataFrame:
    return t.orders.where("o_orderstatus = 'F'").select("o_orderkey", "o_orderpriority", "o_totalprice")


@query("src_select_alias", "SELECT o_orderkey AS id, o_orderstatus AS outcome FROM orders")
def src_select_alias(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("outcome"))


@query("src_count_head", "SELECT count(*) AS n FROM lineitem")
def src_count_head(t: Tables) -> DataFrame:
    return t.lineitem.agg(F.count(F.lit(1)).alias("n"))


@query("src_single", "SELECT c_custkey, c_name FROM customer WHERE c_custkey = 7")
def src_single(t: Tables) -> DataFrame:
    """One row is asked for; two are looked at, so that a second would show."""
    return t.customer.where("c_custkey = 7").select("c_custkey", "c_name").limit(2)


@query("src_limit_recent", "SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def src_limit_recent(t: Tables) -> DataFrame:
    return t.events.orderBy(F.desc("ts"), F.desc("event_id")).limit(20).select("event_id", "user_id")


@query(
    "src_feedback_export",
    "SELECT event_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-02-15' - INTERVAL 30 DAY "
    "ORDER BY ts DESC, event_id DESC LIMIT 1000",
)
def src_feedback_export(t: Tables) -> DataFrame:
    recent = t.events.where(F.col("ts") >= F.lit("2024-01-16").cast("timestamp"))
    return recent.orderBy(F.desc("ts"), F.desc("event_id")).limit(1000).select("event_id", "event_type")


@query(
    "src_response_cache",
    "SELECT conv_id, turn, left(sha256(text), 16) AS cache_key FROM conversations WHERE text IS NOT NULL",
)
def src_response_cache(t: Tables) -> DataFrame:
    key = F.left(F.sha2("text", 256), F.lit(16)).alias("cache_key")
    return t.conversations.where("text IS NOT NULL").select("conv_id", "turn", key)


@query(
    "sink_upsert",
    "SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN 'UPSERTED' ELSE c_mktsegment END AS segment FROM customer",
)
def sink_upsert(t: Tables) -> DataFrame:
    old = t.customer.select("c_custkey", "c_name", F.col("c_mktsegment").alias("segment"))
    return src.upsert(old, old.where("c_custkey % 3 = 0").withColumn("segment", F.lit("UPSERTED")), ["c_custkey"])


@query(
    "sink_update",
    "SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'O' THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders",
)
def sink_update(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_orderpriority", "o_orderstatus")
    urgent = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "O")
    return src.updated(rows, urgent, o_orderstatus=F.lit("X")).drop("o_orderpriority")


@query(
    "sink_append_array",
    "SELECT user_id, count(*) + 1 AS n_signals FROM events WHERE event_type = 'purchase' GROUP BY user_id",
)
def sink_append_array(t: Tables) -> DataFrame:
    """A signal is appended to each owner's array; the array is only made where it is asked for."""
    held = t.events.where("event_type = 'purchase'").groupBy("user_id").agg(F.collect_list("value").alias("signals"))
    return held.select("user_id", F.size(F.array_append("signals", F.lit(0.0))).cast("long").alias("n_signals"))


@query("sink_delete_predicate", "SELECT conv_id, turn FROM conversations WHERE NOT (role = 'user' AND turn = 0)")
def sink_delete_predicate(t: Tables) -> DataFrame:
    return t.conversations.where("NOT (role = 'user' AND turn = 0)").select("conv_id", "turn")


@query(
    "sink_snapshot",
    "SELECT o_custkey AS owner, count(*) AS n_rows, CAST(sum(o_orderkey) AS BIGINT) AS key_sum FROM orders GROUP BY o_custkey",
)
def sink_snapshot(t: Tables) -> DataFrame:
    """The owner's rows as one JSON value, read again."""
    frozen = t.orders.groupBy(F.col("o_custkey").alias("owner")).agg(
        F.to_json(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))).alias("snapshot")
    )
    rows = F.from_json("snapshot", "array<struct<o_orderkey: bigint, o_orderstatus: string>>")
    total = F.aggregate(F.transform(rows, lambda r: r["o_orderkey"]), F.lit(0).cast("long"), lambda a, x: a + x)
    return frozen.select("owner", F.size(rows).cast("long").alias("n_rows"), total.alias("key_sum"))


@query(
    "sink_tsv",
    """SELECT n_nationkey, concat_ws(chr(9), '"' || CAST(n_nationkey AS VARCHAR) || '"', '"' || replace(n_name, '"', '""') || '"') AS line FROM nation""",
)
def sink_tsv(t: Tables) -> DataFrame:
    return t.nation.select("n_nationkey", src.tsv_line(F.col("n_nationkey"), F.col("n_name")).alias("line"))


# --- filters and projections ---


@query(
    "flt_eq_neq_in",
    "SELECT event_id FROM events WHERE event_type IN ('click', 'purchase') AND user_id <> 8 AND value > 5",
)
def flt_eq_neq_in(t: Tables) -> DataFrame:
    return t.events.where(F.col("event_type").isin("click", "purchase") & (F.col("user_id") != 8) & (F.col("value") > 5)).select("event_id")


@query("flt_null", "SELECT count(*) FILTER (text IS NULL) AS n_null, count(*) FILTER (text IS NOT NULL) AS n_rest FROM documents")
def flt_null(t: Tables) -> DataFrame:
    return t.documents.agg(F.count_if(F.col("text").isNull()).alias("n_null"), F.count_if(F.col("text").isNotNull()).alias("n_rest"))


@query("flt_not_eq", "SELECT event_id FROM events WHERE NOT (event_type = 'error')")
def flt_not_eq(t: Tables) -> DataFrame:
    return t.events.where(~(F.col("event_type") == "error")).select("event_id")


@query("flt_range_ts", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20 00:00:00'")
def flt_range_ts(t: Tables) -> DataFrame:
    return t.events.where(F.col("ts") >= F.lit("2024-01-20").cast("timestamp")).select("event_id")


@query("flt_rls", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 42")
def flt_rls(t: Tables) -> DataFrame:
    """Every table that an owner sees goes through one predicate."""

    def owned(rows: DataFrame, column: str, owner: int) -> DataFrame:
        return rows.where(F.col(column) == owner)

    return owned(t.orders, "o_custkey", 42).select("o_orderkey", "o_totalprice")


@query(
    "flt_check",
    "SELECT p_partkey, concat_ws(',', CASE WHEN NOT p_size BETWEEN 1 AND 40 THEN 'size' END, "
    "CASE WHEN p_type NOT IN ('ECONOMY', 'SMALL', 'LARGE', 'PROMO') THEN 'type' END) AS broken FROM part "
    "WHERE NOT (p_size BETWEEN 1 AND 40 AND p_type IN ('ECONOMY', 'SMALL', 'LARGE', 'PROMO'))",
)
def flt_check(t: Tables) -> DataFrame:
    _, rejected = src.validated(
        t.part, size=F.col("p_size").between(1, 40), type=F.col("p_type").isin("ECONOMY", "SMALL", "LARGE", "PROMO")
    )
    return rejected.select("p_partkey", F.concat_ws(",", "broken").alias("broken"))


@query("flt_regex_ci", "SELECT p_partkey FROM part WHERE regexp_matches(p_name, '(?i)(RED|blue).*(ring|BOLT)')")
def flt_regex_ci(t: Tables) -> DataFrame:
    return t.part.where(F.col("p_name").rlike("(?i)(RED|blue).*(ring|BOLT)")).select("p_partkey")


@query(
    "prj_backfill_rules",
    "SELECT p_partkey, CASE WHEN p_name LIKE '%ring%' THEN 'license' WHEN p_name LIKE '%gear%' THEN 'certification' "
    "WHEN p_size > 25 THEN 'education' ELSE 'core_skill' END AS tier FROM part",
)
def prj_backfill_rules(t: Tables) -> DataFrame:
    tier = (
        F.when(F.col("p_name").contains("ring"), "license")
        .when(F.col("p_name").contains("gear"), "certification")
        .when(F.col("p_size") > 25, "education")
        .otherwise("core_skill")
    )
    return t.part.select("p_partkey", tier.alias("tier"))


@query("prj_value_rename", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'closed' ELSE event_type END AS outcome FROM events")
def prj_value_rename(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.col("event_type").alias("outcome")).na.replace({"error": "closed"}, subset=["outcome"])


@query("flt_validated", f"WITH {NODES} SELECT owner, node FROM nodes WHERE has_validation")
def flt_validated(t: Tables) -> DataFrame:
    return nodes(t).where("has_validation").select("owner", "node")


@query("flt_repeated", f"WITH {NODES} SELECT owner, node, n_roles FROM nodes WHERE n_roles >= 2")
def flt_repeated(t: Tables) -> DataFrame:
    return nodes(t).where("n_roles >= 2").select("owner", "node", "n_roles")


@query("prj_whitelist", "SELECT c_custkey, c_mktsegment FROM customer")
def prj_whitelist(t: Tables) -> DataFrame:
    allowed = ("c_custkey", "c_mktsegment", "c_notes")
    return t.customer.select(*[c for c in t.customer.columns if c in allowed])


@query(
    "flt_search_nested",
    f"WITH {EVIDENCE} SELECT owner, node FROM evidence GROUP BY owner, node "
    "HAVING contains(lower(node), '#7') OR bool_or(contains(lower(domain), 'promo'))",
)
def flt_search_nested(t: Tables) -> DataFrame:
    held = evidence(t).groupBy("owner", "node").agg(F.collect_set("domain").alias("domains"))
    found = F.lower("node").contains("#7") | F.exists("domains", lambda d: F.lower(d).contains("promo"))
    return held.where(found).select("owner", "node")


@query(
    "flt_search_multi",
    "SELECT p_partkey FROM part WHERE (contains(p_name, 'red') OR contains(p_brand, '#1')) AND p_type = 'PROMO'",
)
def flt_search_multi(t: Tables) -> DataFrame:
    hit = F.col("p_name").contains("red") | F.col("p_brand").contains("#1")
    return t.part.where(hit & (F.col("p_type") == "PROMO")).select("p_partkey")


@query("flt_palette", "SELECT n_nationkey FROM nation WHERE contains(lower(n_name), '2') OR CAST(n_nationkey AS VARCHAR) = '7'")
def flt_palette(t: Tables) -> DataFrame:
    hit = F.lower("n_name").contains("2") | (F.col("n_nationkey").cast("string") == "7")
    return t.nation.where(hit).select("n_nationkey")


@query(
    "prj_kanban",
    f"WITH {APPLICATIONS} SELECT event_id, CASE WHEN stage = 'offer' THEN 'offers' WHEN stage = 'interview' THEN 'interviews' "
    "WHEN stage = 'applied' AND value >= 10 THEN 'active' WHEN stage = 'closed' THEN 'archive' ELSE 'backlog' END AS board FROM applications",
)
def prj_kanban(t: Tables) -> DataFrame:
    stage = F.col("stage")
    board = (
        F.when(stage == "offer", "offers")
        .when(stage == "interview", "interviews")
        .when((stage == "applied") & (F.col("value") >= 10), "active")
        .when(stage == "closed", "archive")
        .otherwise("backlog")
    )
    return applications(t).select("event_id", board.alias("board"))


@query(
    "prj_cv_counts",
    "SELECT o_custkey AS owner, count(*) AS n_roles, count(*) FILTER (o_orderstatus = 'F') AS n_done FROM orders GROUP BY o_custkey",
)
def prj_cv_counts(t: Tables) -> DataFrame:
    held = t.orders.groupBy(F.col("o_custkey").alias("owner")).agg(F.collect_list("o_orderstatus").alias("states"))
    done = F.filter("states", lambda s: s == "F")
    return held.select("owner", F.coalesce(F.size("states"), F.lit(0)).cast("long").alias("n_roles"), F.size(done).cast("long").alias("n_done"))


@query(
    "prj_remaining_quota",
    "SELECT o_custkey AS owner, greatest(0, 12 - count(*)) AS remaining, count(*) >= 12 AS at_limit FROM orders GROUP BY o_custkey",
)
def prj_remaining_quota(t: Tables) -> DataFrame:
    n = F.count(F.lit(1))
    return t.orders.groupBy(F.col("o_custkey").alias("owner")).agg(
        F.greatest(F.lit(0), 12 - n).cast("long").alias("remaining"), (n >= 12).alias("at_limit")
    )


# --- aggregates ---


@query(
    "agg_primary_domain",
    f"""WITH {EVIDENCE}, s AS (SELECT owner, domain, CAST(sum(n_months) AS BIGINT) AS weight FROM evidence WHERE domain <> 'STANDARD' GROUP BY owner, domain)
    SELECT owner, domain, weight FROM s QUALIFY row_number() OVER (PARTITION BY owner ORDER BY weight DESC, domain) = 1""",
)
def agg_primary_domain(t: Tables) -> DataFrame:
    return ev.primary(evidence(t).where("domain <> 'STANDARD'"), "owner", "domain", "n_months")


@query(
    "agg_maturity",
    f"""WITH {NODES}, m AS (SELECT owner, avg(CAST(has_depth AS DOUBLE)) AS coverage, avg(n_evidence) AS density FROM nodes GROUP BY owner)
    SELECT owner, round(coverage, 6) AS coverage, round(density, 6) AS density,
    CASE WHEN coverage >= 0.6 AND density >= 3 THEN 'rich' WHEN coverage >= 0.3 OR density >= 2 THEN 'medium' ELSE 'thin' END AS level FROM m""",
)
def agg_maturity(t: Tables) -> DataFrame:
    m = ev.maturity(nodes(t), "owner")
    return m.withColumns({c: F.round(c, 6) for c in ("coverage", "density")})


@query("agg_last_enrichment", f"WITH {EVIDENCE} SELECT owner, max(month_no) FILTER (validated) AS last_validated FROM evidence GROUP BY owner")
def agg_last_enrichment(t: Tables) -> DataFrame:
    return evidence(t).groupBy("owner").agg(F.max(F.when(F.col("validated"), F.col("month_no"))).alias("last_validated"))


DEPTH = """CAST(least(n_roles * 10, 40) + least(floor(total_months / 6) * 5, 30) + CASE WHEN has_impact THEN 20 ELSE 0 END
           + CASE WHEN has_validation THEN 10 ELSE 0 END AS BIGINT)"""
LEVEL = "CASE WHEN score >= 80 THEN 'expert' WHEN score >= 60 THEN 'advanced' WHEN score >= 40 THEN 'applied' ELSE 'foundational' END"


ISLANDS = f"""{ROLES},
reach AS (SELECT *, max(end_m) OVER (PARTITION BY owner ORDER BY start_m, end_m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM roles),
numbered AS (SELECT *, sum(CASE WHEN start_m <= r THEN 0 ELSE 1 END) OVER (PARTITION BY owner ORDER BY start_m, end_m ROWS UNBOUNDED PRECEDING) AS island FROM reach),
islands AS (SELECT owner, CAST(island AS BIGINT) AS island, min(start_m) AS start_m, max(end_m) AS end_m FROM numbered GROUP BY owner, island)"""


@query("win_islands", f"WITH {ISLANDS} SELECT * FROM islands")
def win_islands(t: Tables) -> DataFrame:
    return tm.islands(roles(t))


@query(
    "agg_interval_union",
    f"WITH {ISLANDS} SELECT owner, count(*) AS n_islands, CAST(sum(end_m - start_m) AS BIGINT) AS covered FROM islands GROUP BY owner",
)
def agg_interval_union(t: Tables) -> DataFrame:
    return tm.covered_months(roles(t))


@query(
    "agg_union_coverage",
    f"""WITH {ROLES}, w AS (SELECT owner, min(start_m) + 6 AS low, min(start_m) + 42 AS high FROM roles GROUP BY owner),
    c AS (SELECT r.owner, greatest(start_m, low) AS s, least(end_m, high) AS e FROM roles r JOIN w ON w.owner = r.owner WHERE least(end_m, high) > greatest(start_m, low)),
    k AS (SELECT *, max(e) OVER (PARTITION BY owner ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM c),
    n AS (SELECT *, sum(CASE WHEN s <= r THEN 0 ELSE 1 END) OVER (PARTITION BY owner ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM k),
    u AS (SELECT owner, i, max(e) - min(s) AS m FROM n GROUP BY owner, i)
    SELECT w.owner, round(coalesce(sum(m), 0) / 36.0, 6) AS share FROM w LEFT JOIN u ON u.owner = w.owner GROUP BY w.owner""",
)
def agg_union_coverage(t: Tables) -> DataFrame:
    r = roles(t)
    windows = r.groupBy("owner").agg((F.min("start_m") + 6).alias("low"), (F.min("start_m") + 42).alias("high"))
    return tm.union_coverage(r, windows).select("owner", F.round("share", 6).alias("share"))


FUNNEL = """count(*) AS total, count(*) FILTER (stage <> 'saved') AS applied, count(*) FILTER (stage IN ('interview', 'offer')) AS interviews,
    count(*) FILTER (stage = 'offer') AS offers"""


def funnel(rows: DataFrame, *keys: str) -> DataFrame:
    stage = F.col("stage")
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(stage != "saved").alias("applied"),
        F.count_if(stage.isin("interview", "offer")).alias("interviews"),
        F.count_if(stage == "offer").alias("offers"),
    )


@query("agg_funnel", f"WITH {APPLICATIONS} SELECT user_id, {FUNNEL} FROM applications GROUP BY user_id")
def agg_funnel(t: Tables) -> DataFrame:
    return funnel(applications(t), "user_id")


@query(
    "agg_evidence_tag_counts",
    f"""WITH {EVIDENCE}, k AS (SELECT owner, unnest(['impact', 'validated', 'depth']) AS tag, unnest([count(*) FILTER (impact), count(*) FILTER (validated), count(*) FILTER (depth)]) AS n FROM evidence GROUP BY owner)
    SELECT owner, tag, n FROM k WHERE n > 0""",
)
def agg_evidence_tag_counts(t: Tables) -> DataFrame:
    tags = ("impact", "validated", "depth")
    counts = evidence(t).groupBy("owner").agg(*[F.count_if(c).alias(c) for c in tags])
    return counts.unpivot(["owner"], list(tags), "tag", "n").where("n > 0")


POSITION = """CASE WHEN total = 0 THEN 'competitive' WHEN floor(100.0 * met / total + 0.5) >= 90 THEN 'strong fit' WHEN floor(100.0 * met / total + 0.5) >= 75 THEN 'good fit'
    WHEN floor(100.0 * met / total + 0.5) >= 50 THEN 'partial fit' ELSE 'stretch' END"""


@query(
    "agg_position",
    f"WITH {NODES}, p AS (SELECT owner, count(*) AS total, count(*) FILTER (has_impact) AS met FROM nodes GROUP BY owner) SELECT owner, met, total, {POSITION} AS label FROM p",
)
def agg_position(t: Tables) -> DataFrame:
    p = nodes(t).groupBy("owner").agg(F.count(F.lit(1)).alias("total"), F.count_if("has_impact").alias("met"))
    return p.withColumn("label", ev.position(F.col("met"), F.col("total")))


@query(
    "agg_nested_parse_flatten",
    f"WITH {EVIDENCE} SELECT owner, len(list_distinct(list_concat(list(node), list(domain)))) AS n_terms FROM evidence GROUP BY owner",
)
def agg_nested_parse_flatten(t: Tables) -> DataFrame:
    held = evidence(t).groupBy("owner").agg(F.collect_set("node").alias("a"), F.collect_set("domain").alias("b"))
    return held.select("owner", F.size(F.array_union("a", "b")).cast("long").alias("n_terms"))


@query(
    "agg_cluster",
    """WITH g AS (SELECT c_mktsegment, c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS place,
    count(*) OVER (PARTITION BY c_mktsegment, c_nationkey) AS n FROM customer) SELECT c_mktsegment, c_nationkey, c_custkey, place, n FROM g WHERE place <= 3 AND n >= 5""",
)
def agg_cluster(t: Tables) -> DataFrame:
    keys = ["c_mktsegment", "c_nationkey"]
    counted = t.customer.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where("n >= 5")
    best = ev.top_k(counted, keys, [F.desc("c_acctbal"), F.col("c_custkey")], 3)
    return best.select(*keys, "c_custkey", F.col("place").cast("long").alias("place"), "n")


@query(
    "agg_mutation_stats",
    "SELECT event_type, count(*) AS total, count(*) FILTER (value >= 10) AS kept, round(count(*) FILTER (value >= 10) / count(*) + CASE WHEN count(*) < 1500 THEN 0.1 ELSE 0 END, 6) AS score FROM events GROUP BY event_type",
)
def agg_mutation_stats(t: Tables) -> DataFrame:
    total, kept = F.count(F.lit(1)), F.count_if(F.col("value") >= 10)
    bonus = F.when(total < 1500, 0.1).otherwise(0.0)
    return t.events.groupBy("event_type").agg(total.alias("total"), kept.alias("kept"), F.round(kept / total + bonus, 6).alias("score"))


@query(
    "agg_percentile_interp",
    """SELECT event_type, round(quantile_cont(value, 0.10), 6) AS p10, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50,
    round(quantile_cont(value, 0.75), 6) AS p75, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean FROM events GROUP BY event_type""",
)
def agg_percentile_interp(t: Tables) -> DataFrame:
    cuts = {"p10": 0.10, "p25": 0.25, "p50": 0.5, "p75": 0.75}
    return t.events.groupBy("event_type").agg(
        *[F.round(F.percentile("value", p), 6).alias(n) for n, p in cuts.items()],
        F.min("value").alias("least"),
        F.max("value").alias("most"),
        F.round(F.avg("value"), 6).alias("mean"),
    )


NEAREST = """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
    SELECT event_type, value AS {name} FROM r WHERE i = CAST(floor(n * {p}) AS BIGINT)"""


def nearest(rows: DataFrame, key: str, value: str, tie: str, share: float) -> DataFrame:
    """The value at index floor(n * share) of each group, counted from 0."""
    w = Window.partitionBy(key)
    placed = rows.withColumn("i", F.row_number().over(w.orderBy(value, tie)) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    return placed.where(F.col("i") == F.floor(F.col("n") * share))


@query("agg_percentile_nearest", NEAREST.format(name="p10", p="0.10"))
def agg_percentile_nearest(t: Tables) -> DataFrame:
    return nearest(t.events, "event_type", "value", "event_id", 0.10).select("event_type", F.col("value").alias("p10"))


@query("agg_p95_latency", NEAREST.format(name="p95", p="0.95"))
def agg_p95_latency(t: Tables) -> DataFrame:
    return nearest(t.events, "event_type", "value", "event_id", 0.95).select("event_type", F.col("value").alias("p95"))


# --- windows ---


@query(
    "win_timeline_gaps",
    f"""WITH {ROLES}, n AS (SELECT *, lead(start_m) OVER (PARTITION BY owner ORDER BY start_m, end_m, ordinal) AS next_start FROM roles)
    SELECT owner, ordinal, end_m, next_start, next_start - end_m AS gap FROM n WHERE next_start - end_m >= 3""",
)
def win_timeline_gaps(t: Tables) -> DataFrame:
    return tm.gaps(roles(t)).select("owner", "ordinal", "end_m", "next_start", "gap")


@query(
    "win_career_start",
    f"""WITH {ROLES}, y AS (SELECT DISTINCT owner, CAST(floor((start_m - 1) / 12) AS INTEGER) AS yr FROM roles), l AS (SELECT *, lag(yr) OVER (PARTITION BY owner ORDER BY yr) AS b FROM y)
    SELECT owner, coalesce(min(yr) FILTER (yr - b >= 3), min(yr)) AS career_start FROM l GROUP BY owner""",
)
def win_career_start(t: Tables) -> DataFrame:
    return tm.career_start(roles(t))


@query(
    "win_keep_first",
    f"WITH {ROLES} SELECT owner, title, ordinal FROM roles QUALIFY row_number() OVER (PARTITION BY owner, title ORDER BY start_m, ordinal) = 1",
)
def win_keep_first(t: Tables) -> DataFrame:
    return ev.top_k(roles(t), ["owner", "title"], [F.col("start_m"), F.col("ordinal")], 1).select("owner", "title", "ordinal")


@query(
    "win_keep_longest",
    "SELECT p_brand, p_name, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY length(p_name) DESC, p_partkey) = 1",
)
def win_keep_longest(t: Tables) -> DataFrame:
    return ev.top_k(t.part, ["p_brand"], [F.desc(F.length("p_name")), F.col("p_partkey")], 1).select("p_brand", "p_name", "p_partkey")


@query(
    "win_cross_role_first",
    f"WITH {EVIDENCE} SELECT owner, node, role_id, line FROM evidence QUALIFY row_number() OVER (PARTITION BY owner, node ORDER BY month_no, role_id, line, domain) = 1",
)
def win_cross_role_first(t: Tables) -> DataFrame:
    order = [F.col(c) for c in ("month_no", "role_id", "line", "domain")]
    return ev.top_k(evidence(t), ["owner", "node"], order, 1).select("owner", "node", "role_id", "line")


STREAK = """WITH m AS (SELECT event_id, user_id, ts, event_type, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS since FROM events)
    SELECT event_id, user_id, CAST(sum(CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, since ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS streak FROM m"""


@query("win_streak", STREAK)
def win_streak(t: Tables) -> DataFrame:
    found = tm.streaks(t.events, ["user_id"], [F.col("ts"), F.col("event_id")], F.col("event_type") == "purchase")
    return found.select("event_id", "user_id", "streak")


@query(
    "win_last_n_top_k",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS recent FROM events), k AS (SELECT * FROM r WHERE recent <= 20)
    SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS place FROM k QUALIFY place <= 5""",
)
def win_last_n_top_k(t: Tables) -> DataFrame:
    recent = ev.top_k(t.events, ["user_id"], [F.desc("ts"), F.desc("event_id")], 20).drop("place")
    best = ev.top_k(recent, ["user_id"], [F.desc("value"), F.col("event_id")], 5)
    return best.select("user_id", "event_id", F.col("place").cast("long").alias("place"))


@query(
    "win_item_spacing",
    """WITH g AS (SELECT event_id, user_id, epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM events)
    SELECT event_id, user_id, CASE WHEN d IS NULL OR d < 3600 THEN 'none' WHEN d < 86400 THEN 'space' ELSE 'wide' END AS spacing FROM g""",
)
def win_item_spacing(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    at = F.col("ts").cast("timestamp")
    d = (F.unix_micros(at) - F.lag(F.unix_micros(at)).over(w)) / 1e6
    spacing = F.when(d.isNull() | (d < 3600), "none").when(d < 86400, "space").otherwise("wide")
    return t.events.select("event_id", "user_id", spacing.alias("spacing"))


@query(
    "win_topk_per_group",
    "SELECT c_mktsegment, c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey, c_acctbal DESC, c_custkey) <= 3",
)
def win_topk_per_group(t: Tables) -> DataFrame:
    order = [F.col("c_nationkey"), F.desc("c_acctbal"), F.col("c_custkey")]
    return ev.top_k(t.customer, ["c_mktsegment"], order, 3).select("c_mktsegment", "c_custkey")


@query(
    "win_split_assign",
    """WITH p AS (SELECT c_custkey, c_mktsegment, (row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1) / count(*) OVER (PARTITION BY c_mktsegment) AS s FROM customer)
    SELECT c_custkey, CASE WHEN s < 0.6 THEN 'train' WHEN s < 0.8 THEN 'validation' ELSE 'held_out' END AS split FROM p""",
)
def win_split_assign(t: Tables) -> DataFrame:
    w = Window.partitionBy("c_mktsegment")
    s = (F.row_number().over(w.orderBy("c_custkey")) - 1) / F.count(F.lit(1)).over(w)
    return t.customer.select("c_custkey", F.when(s < 0.6, "train").when(s < 0.8, "validation").otherwise("held_out").alias("split"))


@query(
    "win_resume_enrich",
    "SELECT c_custkey FROM customer WHERE c_custkey >= 100 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') ORDER BY c_custkey LIMIT 25",
)
def win_resume_enrich(t: Tables) -> DataFrame:
    done = t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.where("c_custkey >= 100").join(done, "c_custkey", "left_anti").orderBy("c_custkey").limit(25).select("c_custkey")


# --- sorts, limits, samples ---


@query(
    "srt_nodes",
    f"WITH {NODES} SELECT owner, node, row_number() OVER (PARTITION BY owner ORDER BY has_validation DESC, n_roles DESC, total_months DESC, has_impact DESC, node) AS place FROM nodes",
)
def srt_nodes(t: Tables) -> DataFrame:
    order = [F.desc("has_validation"), F.desc("n_roles"), F.desc("total_months"), F.desc("has_impact"), F.col("node")]
    return nodes(t).select("owner", "node", F.row_number().over(Window.partitionBy("owner").orderBy(*order)).cast("long").alias("place"))


@query(
    "srt_depth_view",
    f"WITH {NODES}, d AS (SELECT *, {DEPTH} AS score FROM nodes) SELECT owner, node, row_number() OVER (PARTITION BY owner ORDER BY score DESC, n_evidence DESC, total_months DESC, node) AS place FROM d",
)
def srt_depth_view(t: Tables) -> DataFrame:
    w = Window.partitionBy("owner").orderBy(F.desc("score"), F.desc("n_evidence"), F.desc("total_months"), "node")
    return nodes(t).withColumn("score", ev.depth_score()).select("owner", "node", F.row_number().over(w).cast("long").alias("place"))


@query(
    "srt_chrono",
    f"WITH {ROLES} SELECT owner, ordinal, row_number() OVER (PARTITION BY owner ORDER BY coalesce(start_m, 0), ordinal) AS place FROM roles",
)
def srt_chrono(t: Tables) -> DataFrame:
    w = Window.partitionBy("owner").orderBy(F.coalesce("start_m", F.lit(0)), "ordinal")
    return roles(t).select("owner", "ordinal", F.row_number().over(w).cast("long").alias("place"))


@query(
    "srt_questions",
    f"WITH {NODES} SELECT owner, node FROM nodes QUALIFY row_number() OVER (PARTITION BY owner ORDER BY has_depth DESC, n_roles DESC, node) <= 3",
)
def srt_questions(t: Tables) -> DataFrame:
    return ev.top_k(nodes(t), ["owner"], [F.desc("has_depth"), F.desc("n_roles"), F.col("node")], 3).select("owner", "node")


@query(
    "srt_priority_fixed",
    "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderkey LIMIT 5",
)
def srt_priority_fixed(t: Tables) -> DataFrame:
    rank = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(2)
    return t.orders.orderBy(rank, F.desc("o_totalprice"), "o_orderkey").limit(5).select("o_orderkey", "o_orderpriority")


@query(
    "lim_adaptive",
    f"""WITH {NODES}, m AS (SELECT owner, avg(n_evidence) AS density FROM nodes GROUP BY owner), p AS (SELECT owner, node, row_number() OVER (PARTITION BY owner ORDER BY n_roles DESC, node) AS k FROM nodes)
    SELECT p.owner, node FROM p JOIN m ON m.owner = p.owner WHERE k <= CASE WHEN density >= 2 THEN 3 WHEN density >= 1.3 THEN 5 ELSE 6 END""",
)
def lim_adaptive(t: Tables) -> DataFrame:
    w = Window.partitionBy("owner")
    density = F.avg("n_evidence").over(w)
    most = F.when(density >= 2, 3).when(density >= 1.3, 5).otherwise(6)
    placed = nodes(t).withColumn("most", most).withColumn("k", F.row_number().over(w.orderBy(F.desc("n_roles"), "node")))
    return placed.where("k <= most").select("owner", "node")


@query("lim_caps", f"WITH {NODES} SELECT owner, node FROM nodes QUALIFY row_number() OVER (PARTITION BY owner ORDER BY total_months DESC, node) <= 6")
def lim_caps(t: Tables) -> DataFrame:
    return ev.top_k(nodes(t), ["owner"], [F.desc("total_months"), F.col("node")], 6).select("owner", "node")


@query("smp_deterministic", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 50")
def smp_deterministic(t: Tables) -> DataFrame:
    return t.customer.orderBy("c_custkey").limit(50).select("c_custkey")


@query(
    "smp_longest_and_median",
    """WITH r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents)
    SELECT lang, doc_id, k = 1 AS longest FROM r WHERE k = 1 OR k = CAST(floor(n / 2) AS BIGINT) + 1""",
)
def smp_longest_and_median(t: Tables) -> DataFrame:
    w = Window.partitionBy("lang")
    r = t.documents.select("lang", "doc_id", F.row_number().over(w.orderBy(F.desc("n_chars"), "doc_id")).alias("k"), F.count(F.lit(1)).over(w).alias("n"))
    return r.where((F.col("k") == 1) | (F.col("k") == F.floor(F.col("n") / 2) + 1)).select("lang", "doc_id", (F.col("k") == 1).alias("longest"))


# --- sets ---


@query("set_union_bag", "SELECT s_nationkey AS nation FROM supplier UNION ALL SELECT c_nationkey FROM customer")
def set_union_bag(t: Tables) -> DataFrame:
    return t.supplier.select(F.col("s_nationkey").alias("nation")).unionByName(t.customer.select(F.col("c_nationkey").alias("nation")))


@query("set_union_distinct", "SELECT s_nationkey AS nation FROM supplier UNION SELECT c_nationkey FROM customer")
def set_union_distinct(t: Tables) -> DataFrame:
    return t.supplier.select(F.col("s_nationkey").alias("nation")).union(t.customer.select("c_nationkey")).distinct()


@query("set_intersect", "SELECT l_partkey AS part FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A'")
def set_intersect(t: Tables) -> DataFrame:
    part = t.lineitem.select("l_returnflag", F.col("l_partkey").alias("part"))
    return part.where("l_returnflag = 'R'").select("part").intersect(part.where("l_returnflag = 'A'").select("part"))


@query("set_except", "SELECT p_partkey AS part FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def set_except(t: Tables) -> DataFrame:
    returned = t.lineitem.where("l_quantity > 45").select(F.col("l_partkey").alias("part"))
    return t.part.select(F.col("p_partkey").alias("part")).subtract(returned)


@query("set_dedup_ci", "SELECT lower(p_name) AS k, min(p_partkey) AS first_part, count(*) AS n FROM part GROUP BY lower(p_name)")
def set_dedup_ci(t: Tables) -> DataFrame:
    return t.part.groupBy(F.lower("p_name").alias("k")).agg(F.min("p_partkey").alias("first_part"), F.count(F.lit(1)).alias("n"))


@query(
    "set_jaccard",
    f"""WITH {NODES}, s AS (SELECT owner, list(node) AS a FROM nodes GROUP BY owner)
    SELECT x.owner, round(len(list_intersect(x.a, y.a)) / nullif(len(list_distinct(list_concat(x.a, y.a))), 0), 6) AS jaccard FROM s x JOIN s y ON y.owner = x.owner + 1""",
)
def set_jaccard(t: Tables) -> DataFrame:
    s = nodes(t).groupBy("owner").agg(F.collect_set("node").alias("a"))
    y = s.select((F.col("owner") - 1).alias("owner"), F.col("a").alias("b"))
    share = F.size(F.array_intersect("a", "b")) / F.nullif(F.size(F.array_union("a", "b")), F.lit(0))
    return s.join(y, "owner").select("owner", F.round(share, 6).alias("jaccard"))
