"""The registered queries: each a function of the tables, with its DuckDB SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docsieve.sources.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Stand-ins for the domain's tables: an order is a role of its customer, from its month on, as many months
#: as its largest line number; a line item is evidence of a brand (the skill) of a part type (its domain).
ROLES = """
roles AS (
  SELECT o_custkey AS owner, o_orderkey AS ordinal, o_orderpriority AS title, o_orderstatus AS source,
         year(o_orderdate) * 12 + month(o_orderdate) AS start_m,
         year(o_orderdate) * 12 + month(o_orderdate) + max(l_linenumber) AS end_m
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey
  GROUP BY o_custkey, o_orderkey, o_orderpriority, o_orderstatus, o_orderdate
)"""
EVIDENCE = """
evidence AS (
  SELECT o_custkey AS owner, p_brand AS node, p_type AS domain, o_orderkey AS role_id, l_linenumber AS line,
         l_linenumber AS n_months, l_returnflag = 'R' AS impact, l_quantity >= 45 AS validated,
         l_discount >= 0.09 AS depth, year(o_orderdate) * 12 + month(o_orderdate) AS month_no
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey
)"""
NODES = (
    EVIDENCE
    + """,
nodes AS (
  SELECT owner, node, CAST(sum(n_months) AS BIGINT) AS total_months, count(DISTINCT role_id) AS n_roles,
         bool_or(impact) AS has_impact, bool_or(validated) AS has_validation, bool_or(depth) AS has_depth,
         max(month_no) AS last_used, count(*) AS n_evidence
  FROM evidence GROUP BY owner, node
)"""
)
VERDICT = """
CASE WHEN (n_roles >= 2 AND (has_impact OR has_validation)) OR (n_roles >= 1 AND has_depth AND has_impact) THEN 'strong'
     WHEN n_roles >= 1 OR has_depth THEN 'exists' ELSE 'claimed' END"""
APPLICATIONS = """
applications AS (
  SELECT event_id, user_id, ts, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS gap,
         CASE event_type WHEN 'view' THEN 'saved' WHEN 'click' THEN 'applied' WHEN 'signup' THEN 'interview'
                         WHEN 'purchase' THEN 'offer' ELSE 'closed' END AS stage
  FROM events
)"""
LINES = """
lines AS (
  SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
)"""


def query(name: str, sql: str | None = None):
    """Registers a query under an id that no other has."""

    def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if sql:
            SQL[name] = sql
        return build

    return register
