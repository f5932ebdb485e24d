"""Joins and matching, merges, validation, scorecards and state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsieve.functions import text as tx
from docsieve.operators import evidence as ev
from docsieve.operators import matching as mt
from docsieve.plans.registry import NODES, query
from docsieve.plans.standins import nodes, roles
from docsieve.plans.text_queries import SIGNIFICANT
from docsieve.sources import tables as src
from docsieve.sources.tables import Tables
from docsieve.streaming import events as stream

# --- joins ---


@query("jn_hash_lookup", "SELECT l_orderkey, l_linenumber, l_partkey, p_name FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity > 48")
def jn_hash_lookup(t: Tables) -> DataFrame:
    joined = t.lineitem.where("l_quantity > 48").join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    return joined.select("l_orderkey", "l_linenumber", "l_partkey", "p_name")


@query("jn_left_default", "SELECT d.doc_id, coalesce(l.w, 1.0) AS weight FROM documents d LEFT JOIN (SELECT doc_id, 0.5 + quality AS w FROM labels) l ON l.doc_id = d.doc_id")
def jn_left_default(t: Tables) -> DataFrame:
    weights = t.labels.select("doc_id", (0.5 + F.col("quality")).alias("w"))
    return t.documents.join(weights, "doc_id", "left").select("doc_id", F.coalesce("w", F.lit(1.0)).alias("weight"))


@query("jn_file_pairing", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def jn_file_pairing(t: Tables) -> DataFrame:
    """Documents without a label: the missing side of the pairing."""
    return t.documents.join(t.labels, "doc_id", "left_anti").select("doc_id")


# Our own lexicon: other names of parts.
ALIASES = [("red widget", "widget"), ("blue widget", "widget"), ("small ring", "ring"), ("hot gear", "gear")]
ALIAS_SQL = "CASE lower(trim(p_name)) " + " ".join(f"WHEN '{a}' THEN '{c}'" for a, c in ALIASES) + " ELSE lower(trim(p_name)) END"


@query("jn_alias_canonical", f"SELECT p_partkey, {ALIAS_SQL} AS canonical FROM part")
def jn_alias_canonical(t: Tables) -> DataFrame:
    aliases = t.spark.createDataFrame(ALIASES, "alias string, canonical string")
    return mt.canonical(t.part.select("p_partkey", "p_name"), "p_name", aliases).select("p_partkey", "canonical")


def names(t: Tables) -> DataFrame:
    return t.part.groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("ordinal"))


# A requirement: a brand that the next owner has used most.
REQUIREMENTS = f"""{NODES}, reqs AS (SELECT owner - 1 AS owner, node AS keyword, row_number() OVER (PARTITION BY owner ORDER BY total_months DESC, node) AS req FROM nodes QUALIFY req <= 5)"""


def requirements(t: Tables) -> DataFrame:
    top = ev.top_k(nodes(t), ["owner"], [F.desc("total_months"), F.col("node")], 5)
    return top.select((F.col("owner") - 1).alias("owner"), F.col("node").alias("keyword"), F.col("place").cast("long").alias("req"))


def overlaps(t: Tables) -> DataFrame:
    r = roles(t)
    a = r.select("owner", F.col("ordinal").alias("a"), F.col("start_m").alias("a_start"), F.col("end_m").alias("a_end"), F.col("source").alias("a_source"))
    b = r.select("owner", F.col("ordinal").alias("b"), F.col("start_m").alias("b_start"), F.col("end_m").alias("b_end"), F.col("source").alias("b_source"))
    shared = F.least("a_end", "b_end") - F.greatest("a_start", "b_start")
    return mt.overlapping(a, b, "owner").where("a < b").withColumn("shared", shared)


@query(
    "jn_jd_similarity",
    f"""WITH w AS (SELECT item_id, {SIGNIFICANT.format('text')} AS k FROM benchmark), p AS (SELECT a.item_id AS a, b.item_id AS b, len(list_intersect(a.k, b.k)) / least(len(a.k), len(b.k)) AS s FROM w a JOIN w b ON a.item_id <> b.item_id AND len(list_intersect(a.k, b.k)) > 0)
    SELECT a, b, round(s, 6) AS similarity FROM p QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) = 1""",
)
def jn_jd_similarity(t: Tables) -> DataFrame:
    w = t.benchmark.select("item_id", tx.significant(F.col("text")).alias("k"))
    a = w.select(F.col("item_id").alias("a"), F.col("k").alias("ka"), F.size("k").alias("na"))
    b = w.select(F.col("item_id").alias("b"), F.col("k").alias("kb"), F.size("k").alias("nb"))
    shared = mt.share_a_word(a, b, "ka", "kb", ["a", "na", "b", "nb"]).where("a <> b")
    s = shared.withColumn("s", F.col("n_shared") / F.least("na", "nb"))
    return mt.first_match(s, ["a"], [F.desc("s"), F.col("b")]).select("a", "b", F.round("s", 6).alias("similarity"))


@query("jn_industry_block", "SELECT c_custkey, coalesce(s.n, 0) AS n_suppliers, CASE WHEN s.n IS NULL THEN 'unknown' ELSE 'matched' END AS block FROM customer LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY s_nationkey) s ON s_nationkey = c_nationkey")
def jn_industry_block(t: Tables) -> DataFrame:
    s = t.supplier.where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.count(F.lit(1)).alias("n"))
    joined = t.customer.join(s, "c_nationkey", "left")
    return joined.select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_suppliers"), F.when(F.col("n").isNull(), "unknown").otherwise("matched").alias("block"))


@query(
    "jn_greedy_one_to_one",
    "WITH c AS (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS i FROM customer), s AS (SELECT s_suppkey, s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS i FROM supplier) SELECT c_custkey, s_suppkey FROM c JOIN s ON s_nationkey = c_nationkey AND s.i = c.i",
)
def jn_greedy_one_to_one(t: Tables) -> DataFrame:
    c = t.customer.select("c_custkey", F.col("c_nationkey").alias("nation"), F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")).alias("i"))
    s = t.supplier.select("s_suppkey", F.col("s_nationkey").alias("nation"), F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")).alias("i"))
    return c.join(s, ["nation", "i"]).select("c_custkey", "s_suppkey")


# Our own rules: who has the first brand would be expected to have the second.
EXPECTED = [("Brand#1", "Brand#2"), ("Brand#3", "Brand#4"), ("Brand#5", "Brand#6")]
EXPECTED_SQL = "expected(node, want) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in EXPECTED) + ")"


@query("jn_contradiction_pairs", "SELECT a.o_orderkey AS a, b.o_orderkey AS b FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderdate = b.o_orderdate AND a.o_orderkey < b.o_orderkey AND a.o_orderstatus <> b.o_orderstatus")
def jn_contradiction_pairs(t: Tables) -> DataFrame:
    o = t.orders.select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus")
    b = o.select("o_custkey", "o_orderdate", F.col("o_orderkey").alias("b"), F.col("o_orderstatus").alias("other"))
    pairs = o.withColumnRenamed("o_orderkey", "a").join(b, ["o_custkey", "o_orderdate"])
    return pairs.where("a < b AND o_orderstatus <> other").select("a", "b")


# --- validation and repair ---


@query("val_request", "SELECT c_custkey FROM customer WHERE length(c_name) >= 3 AND c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal BETWEEN 0 AND 9000")
def val_request(t: Tables) -> DataFrame:
    valid, _ = src.validated(
        t.customer, name=F.length("c_name") >= 3, segment=F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), balance=F.col("c_acctbal").between(0, 9000)
    )
    return valid.select("c_custkey")


# --- state over time ---


@query("st_recent_30d", "SELECT user_id, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-02-15' - INTERVAL 30 DAY GROUP BY user_id")
def st_recent_30d(t: Tables) -> DataFrame:
    return t.events.where(F.col("ts") >= F.lit("2024-01-16").cast("timestamp")).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("st_rate_limit", "WITH g AS (SELECT event_id, user_id, epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM events) SELECT user_id, count(*) FILTER (d < 600) AS n_too_soon FROM g GROUP BY user_id")
def st_rate_limit(t: Tables) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    d = at - F.lag(at).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return t.events.select("user_id", d.alias("d")).groupBy("user_id").agg(F.count_if(F.col("d") < 600).alias("n_too_soon"))


@query("ext_tumbling_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY hour, event_type")
def ext_tumbling_counts(t: Tables) -> DataFrame:
    """An extension: the batch form of the streaming counts."""
    return stream.tumbling_counts(t.events, "1 hour").select(F.col("start").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    "ext_session_windows",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, min(ts) AS began, count(*) AS n FROM s GROUP BY user_id, k""",
)
def ext_session_windows(t: Tables) -> DataFrame:
    return stream.sessions(t.events, "2 hours").select("user_id", F.col("start").alias("began"), "n")
