"""Reading order of positioned items: lines, peaks of edges and columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsieve.operators.folds import ordered_fold


def anchored(rows: DataFrame, key: str, order: list[str], value: str, width: float, out: str = "anchor") -> DataFrame:
    """In order, a row whose value is more than ``width`` from the last anchor becomes the next anchor."""

    def step(last: list[float], here: float) -> float:
        if not last or abs(here - last[0]) > width:
            last[:] = [float(here)]
        return last[0]

    return ordered_fold(rows, [key], order, [value], list, step, out, "double")


BIN, PEAK_SHARE, MERGE, GAP_SHARE = 10, 0.05, 30, 0.25
LEAST_LINES, LEAST_ITEMS = 5, 10


def text_lines(items: DataFrame, page: str = "page", y: str = "y", x: str = "x", item: str = "item", width: float = 3) -> DataFrame:
    """The items with ``line``, the height of their line's first item, from which they are no more than ``width``."""
    return anchored(items, page, [y, x, item], y, width, "line")


def edge_peaks(items: DataFrame, page: str, x: str, width: int = BIN, share: float = PEAK_SHARE) -> DataFrame:
    """Bins of left edges with ``share`` of a page's items or more: 1 / share of them at most."""
    bins = items.groupBy(page, (F.floor(F.col(x) / width) * width).alias("edge")).agg(F.count(F.lit(1)).alias("n"))
    totals = items.groupBy(page).agg(F.count(F.lit(1)).alias("total"))
    return bins.join(totals, page).where(F.col("n") >= share * F.col("total")).drop("total")


def columns(lined: DataFrame, page_width: float, page: str = "page", x: str = "x") -> DataFrame:
    """``page`` and ``starts``, the left borders of its columns in order, of items with their ``line``.

    Peaks of left edges that are not further than ``MERGE`` from the last kept one are indents of its column. A
    page has several columns if the first two are a quarter of its width or more apart; one with few lines or items has one.
    """
    merged = anchored(edge_peaks(lined, page, x), page, ["edge"], "edge", MERGE, "start").groupBy(page).agg(F.array_sort(F.collect_set("start")).alias("found"))
    size = lined.groupBy(page).agg(F.countDistinct("line").alias("n_lines"), F.count(F.lit(1)).alias("n_items"))
    several = (F.col("n_lines") >= LEAST_LINES) & (F.col("n_items") >= LEAST_ITEMS) & (F.size("found") >= 2) & (F.get("found", F.lit(1)) - F.get("found", F.lit(0)) >= GAP_SHARE * page_width)
    starts = F.when(several, F.transform("found", lambda s: s - BIN)).otherwise(F.array(F.lit(0.0)))
    return size.join(merged, page, "left").select(page, starts.alias("starts"))


def in_reading_order(lined: DataFrame, starts: DataFrame, page: str = "page", x: str = "x", width: str = "width", item: str = "item") -> DataFrame:
    """The items with ``col``, the last column that starts at or before their centre (else the first), and ``place`` on the page.

    Columns are read one after another, each line by line. The borders come as one short array for each page.
    """
    centre = F.col(x) + F.col(width) / 2
    placed = lined.join(starts, page).withColumn("col", F.greatest(F.size(F.filter("starts", lambda s: s <= centre)) - 1, F.lit(0))).drop("starts")
    return placed.withColumn("place", F.row_number().over(Window.partitionBy(page).orderBy("col", "line", x, item)).cast("long"))
