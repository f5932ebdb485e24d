"""Intervals of months: islands, gaps, coverage and overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(rows: DataFrame, owner: str = "owner", start: str = "start_m", end: str = "end_m") -> DataFrame:
    """Intervals that overlap or touch, merged: one row an island."""
    order = Window.partitionBy(owner).orderBy(start, end)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    marked = rows.withColumn("reach", F.max(end).over(before)).withColumn(
        "new", F.when(F.col(start) <= F.col("reach"), 0).otherwise(1)
    )
    numbered = marked.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(owner, "island").agg(F.min(start).alias(start), F.max(end).alias(end))


def covered_months(rows: DataFrame, owner: str = "owner") -> DataFrame:
    """Islands and the months that they cover together, of each owner."""
    return islands(rows, owner).groupBy(owner).agg(
        F.count(F.lit(1)).alias("n_islands"), F.sum(F.col("end_m") - F.col("start_m")).cast("long").alias("covered")
    )


def gaps(rows: DataFrame, least: int = 3, owner: str = "owner") -> DataFrame:
    """From a row's end to the start of the next by start, ``least`` months or more."""
    order = Window.partitionBy(owner).orderBy("start_m", "end_m", "ordinal")
    following = rows.withColumn("next_start", F.lead("start_m").over(order))
    return following.withColumn("gap", F.col("next_start") - F.col("end_m")).where(F.col("gap") >= least)


def union_coverage(rows: DataFrame, windows: DataFrame, owner: str = "owner") -> DataFrame:
    """The share of each owner's window [low, high] that its intervals cover."""
    clipped = (
        rows.join(windows, owner)
        .withColumn("start_m", F.greatest("start_m", "low"))
        .withColumn("end_m", F.least("end_m", "high"))
        .where("end_m > start_m")
    )
    covered = covered_months(clipped, owner).select(owner, "covered")
    return windows.join(covered, owner, "left").withColumn(
        "share", F.coalesce("covered", F.lit(0)) / F.nullif(F.col("high") - F.col("low"), F.lit(0))
    )


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return F.least(a_end, b_end) - F.greatest(a_start, b_start)


def streaks(rows: DataFrame, keys: list[str], order: list[Column], kept: Column) -> DataFrame:
    """``streak``: how many rows in a row, this one included, since the last one that was kept."""
    w = Window.partitionBy(*keys).orderBy(*order)
    marked = rows.withColumn("since", F.sum(F.when(kept, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    within = Window.partitionBy(*keys, "since").orderBy(*order)
    return marked.withColumn("streak", F.sum(F.when(kept, 0).otherwise(1)).over(within)).drop("since")


def career_start(rows: DataFrame, owner: str = "owner", least_gap: int = 3) -> DataFrame:
    """The first start year after the first gap of ``least_gap`` years between distinct start years, else the first."""
    years = rows.select(owner, F.floor((F.col("start_m") - 1) / 12).cast("int").alias("yr")).distinct()
    w = Window.partitionBy(owner).orderBy("yr")
    after = years.withColumn("before", F.lag("yr").over(w))
    return after.groupBy(owner).agg(
        F.coalesce(F.min(F.when(F.col("yr") - F.col("before") >= least_gap, F.col("yr"))), F.min("yr")).alias("career_start")
    )


# The first letters of the months' names.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def month_number(name: Column) -> Column:
    """1 to 12 by the first three letters, else null."""
    place = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.left(name, F.lit(3))))
    return F.nullif(place.cast("int"), F.lit(0))


def parse_role_date(text: Column, as_end: bool, as_of: Column, year_only: str = "by_side", pivot: int = 50) -> Column:
    """A role's date as year * 12 + month: 'Mon YYYY', 'YYYY', 'YYYY-MM', 'MM/YYYY', 'Mon YY' or a word for now.

    ``year_only`` says what a bare year means: January for a start and December for an end (``by_side``),
    or always January (``january``).
    """
    s = F.lower(F.regexp_replace(text, r"^\s+|\s+$", ""))

    def group(pattern: str, i: int) -> Column:
        return F.nullif(F.regexp_extract(s, pattern, i), F.lit(""))

    named, short = r"^([a-z]{3,9})\.? +([0-9]{4})$", r"^([a-z]{3,9})\.? +'?([0-9]{2})$"
    iso, slash, year = r"^([0-9]{4})-([0-9]{1,2})$", r"^([0-9]{1,2})/([0-9]{4})$", r"^([0-9]{4})$"
    two = group(short, 2).cast("int")
    century = F.when(two < pivot, 2000).otherwise(1900)
    bare = 12 if as_end and year_only == "by_side" else 1
    return F.coalesce(
        F.when(s.isin("present", "current", "now", "ongoing", "today"), as_of),
        group(named, 2).cast("int") * 12 + month_number(group(named, 1)),
        group(iso, 1).cast("int") * 12 + group(iso, 2).cast("int"),
        group(slash, 2).cast("int") * 12 + group(slash, 1).cast("int"),
        (century + two) * 12 + month_number(group(short, 1)),
        group(year, 1).cast("int") * 12 + bare,
    )
