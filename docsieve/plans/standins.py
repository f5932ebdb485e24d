"""DataFrames of the stand-ins that ``registry`` describes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.operators import evidence as ev
from docsieve.sources.tables import Tables, dealt


def roles(t: Tables) -> DataFrame:
    start = (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("start_m")
    length = t.lineitem.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("len"))
    joined = t.orders.join(length, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(
        F.col("o_custkey").alias("owner"),
        F.col("o_orderkey").alias("ordinal"),
        F.col("o_orderpriority").alias("title"),
        F.col("o_orderstatus").alias("source"),
        start,
        (F.year("o_orderdate") * 12 + F.month("o_orderdate") + F.col("len")).alias("end_m"),
    )


def evidence(t: Tables) -> DataFrame:
    joined = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).join(
        t.part, F.col("p_partkey") == F.col("l_partkey")
    )
    return joined.select(
        F.col("o_custkey").alias("owner"),
        F.col("p_brand").alias("node"),
        F.col("p_type").alias("domain"),
        F.col("o_orderkey").alias("role_id"),
        F.col("l_linenumber").alias("line"),
        F.col("l_linenumber").alias("n_months"),
        (F.col("l_returnflag") == "R").alias("impact"),
        (F.col("l_quantity") >= 45).alias("validated"),
        (F.col("l_discount") >= 0.09).alias("depth"),
        (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("month_no"),
    )


def nodes(t: Tables) -> DataFrame:
    return ev.summaries(dealt(evidence(t), t.lineitem.count(), "owner"))


def applications(t: Tables) -> DataFrame:
    stage = (
        F.when(F.col("event_type") == "view", "saved")
        .when(F.col("event_type") == "click", "applied")
        .when(F.col("event_type") == "signup", "interview")
        .when(F.col("event_type") == "purchase", "offer")
        .otherwise("closed")
    )
    gap = F.get_json_object("props", "$.k").cast("int")
    return t.events.select("event_id", "user_id", "ts", "value", gap.alias("gap"), stage.alias("stage"))


def lines(t: Tables) -> DataFrame:
    cut = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return cut.select("doc_id", (F.col("at") + 1).cast("long").alias("pos"), "line")
