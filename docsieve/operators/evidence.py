"""Evidence: summaries of nodes, verdicts, maturity and depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def summaries(evidence: DataFrame, *keys: str) -> DataFrame:
    """Per owner and node: months, distinct roles, what kinds of evidence there are, and when it was last used."""
    return evidence.groupBy(*(keys or ("owner", "node"))).agg(
        F.sum("n_months").cast("long").alias("total_months"),
        F.countDistinct("role_id").alias("n_roles"),
        F.bool_or("impact").alias("has_impact"),
        F.bool_or("validated").alias("has_validation"),
        F.bool_or("depth").alias("has_depth"),
        F.max("month_no").alias("last_used"),
        F.count(F.lit(1)).alias("n_evidence"),
    )


def verdict() -> Column:
    """Strong: two roles with impact or validation, or one with depth and impact; exists: a role or depth."""
    proof = F.col("has_impact") | F.col("has_validation")
    strong = ((F.col("n_roles") >= 2) & proof) | ((F.col("n_roles") >= 1) & F.col("has_depth") & F.col("has_impact"))
    return (
        F.when(strong, "strong").when((F.col("n_roles") >= 1) | F.col("has_depth"), "exists").otherwise("claimed")
    )


def position(met: Column, total: Column) -> Column:
    """The share of requirements that are met, rounded to a whole percentage, as a label."""
    share = F.floor(100.0 * met / F.nullif(total, F.lit(0)) + 0.5)
    return (
        F.when(total == 0, "competitive")
        .when(share >= 90, "strong fit")
        .when(share >= 75, "good fit")
        .when(share >= 50, "partial fit")
        .otherwise("stretch")
    )


def maturity(nodes: DataFrame, *keys: str) -> DataFrame:
    """Coverage (nodes with depth), density (evidence a node) and the level that they give."""
    coverage = F.avg(F.col("has_depth").cast("double"))
    density = F.avg("n_evidence")
    level = (
        F.when((F.col("coverage") >= 0.6) & (F.col("density") >= 3), "rich")
        .when((F.col("coverage") >= 0.3) | (F.col("density") >= 2), "medium")
        .otherwise("thin")
    )
    return nodes.groupBy(*keys).agg(coverage.alias("coverage"), density.alias("density")).withColumn("level", level)


def depth_score() -> Column:
    """Capped sum of roles, years, impact and validation."""
    return (
        F.least(F.col("n_roles") * 10, F.lit(40))
        + F.least(F.floor(F.col("total_months") / 6) * 5, F.lit(30))
        + F.when(F.col("has_impact"), 20).otherwise(0)
        + F.when(F.col("has_validation"), 10).otherwise(0)
    ).cast("long")


def depth_level(score: Column) -> Column:
    return (
        F.when(score >= 80, "expert").when(score >= 60, "advanced").when(score >= 40, "applied").otherwise("foundational")
    )


def primary(rows: DataFrame, owner: str, name: str, weight: str, order: list[Column] | None = None) -> DataFrame:
    """The name with the largest total weight of each owner; ties go to the first by ``order``, else by name."""
    totals = rows.groupBy(owner, name).agg(F.sum(weight).cast("long").alias("weight"))
    best = Window.partitionBy(owner).orderBy(F.desc("weight"), *(order or [F.col(name)]))
    return totals.withColumn("place", F.row_number().over(best)).where("place = 1").drop("place")


def top_k(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group, with their ``place``."""
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return placed.where(F.col("place") <= k)
