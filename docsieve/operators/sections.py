"""Marks and notes in a document's lines: role titles that stand outside their section, education within it, odd layouts.

Each document's lines meet as one ordered array, as they become one text again. Notes are inserted between lines by
fractional places, so that no line has to be numbered anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DISPLACED, EDUCATION = "[displaced] ", "[education] "
ELSEWHERE = "[note: titles of roles that stand elsewhere and belong here: "
TITLELESS = "[note: the title of this block's role may stand further on]"
BELOW = "[layout: titles stand below their bullets]"


def _bound(rows: DataFrame) -> DataFrame:
    """The rows with their columns computed once: a generator keeps them from being computed anew within lambdas."""
    return rows.select(F.inline(F.array(F.struct(*rows.columns))))


def _first(items: Column, good) -> Column:
    """The place of the first item that is good, from 1, else null."""
    return F.nullif(F.array_position(F.transform(items, good), True), F.lit(0))


def annotated(lines: DataFrame, key: str = "owner", section: str = "experience") -> DataFrame:
    """``key``, ``text``, ``n_headers`` and ``n_displaced`` of lines with ``pos``, ``line``, ``section`` (of a title, else null) and the
    flags ``header``, ``date_only``, ``excused`` (education or certificate), ``education`` and ``company``.

    The section reaches from its title to the next other one. A role's header outside it is marked and listed in a note
    behind the title; education within it is marked. A company line before any header gets a note, as its title
    comes later; and if two headers or more are there and the first one comes late, so does the section.
    """
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("header", "date_only", "excused", "education", "company")]
    held = lines.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "line", "section", *flags))).alias("items"))
    found = _bound(held.withColumn("start", _first(F.col("items"), lambda x: F.coalesce(x["section"] == section, F.lit(False)))))
    n = F.size("items")

    def after(x: Column, i: Column) -> Column:
        return F.coalesce((x["section"] != section) & (i + 1 > F.col("start")), F.lit(False))

    ended = _bound(found.withColumn("stop", F.coalesce(_first(F.col("items"), after), n + 1)))
    start, stop = F.col("start"), F.col("stop")

    def inside(i: Column) -> Column:
        return F.coalesce((i + 1 > start) & (i + 1 < stop), F.lit(False))

    def displaced(x: Column, i: Column) -> Column:
        return F.coalesce((i + 1 < start) | (i + 1 >= stop), F.lit(False)) & x["header"] & ~x["date_only"] & ~x["excused"]

    first_header = _first(F.col("items"), lambda x, i: inside(i) & x["header"])
    first_content = _first(F.col("items"), lambda x, i: inside(i) & (F.trim(x["line"]) != ""))
    known = _bound(
        ended.withColumns({
            "first_header": first_header, "first_content": first_content,
            "n_headers": F.size(F.filter("items", lambda x, i: inside(i) & x["header"])),
            "away": F.transform(F.filter("items", displaced), lambda x: F.trim(x["line"])),
        })
    )
    opening = F.get("items", F.col("first_content").cast("int") - 1)
    titleless = (F.col("n_headers") > 0) & opening["company"] & ~opening["header"]
    late = (F.col("n_headers") >= 2) & (F.col("first_header") > F.col("start") + 3)

    def note(when: Column, place: Column, text: Column | str) -> Column:
        return F.when(when, F.struct(place.cast("double").alias("place"), (F.lit(text) if isinstance(text, str) else text).alias("line")))

    def marked(x: Column, i: Column) -> Column:
        line = F.when(displaced(x, i), F.concat(F.lit(DISPLACED), x["line"])).when(inside(i) & x["education"] & ~F.contains(x["line"], F.lit("[")), F.concat(F.lit(EDUCATION), x["line"]))
        return F.struct((i + 1).cast("double").alias("place"), line.otherwise(x["line"]).alias("line"))

    notes = F.array(
        note(late, start + 0.1, BELOW), note(F.size("away") > 0, start + 0.2, F.concat(F.lit(ELSEWHERE), F.array_join("away", "; "), F.lit("]"))),
        note(titleless, F.col("first_content") - 0.5, TITLELESS),
    )
    whole = F.array_sort(F.concat(F.transform("items", marked), F.filter(notes, lambda x: x.isNotNull())))
    return known.select(key, F.array_join(F.transform(whole, lambda x: x["line"]), "\n").alias("text"), F.col("n_headers").cast("long").alias("n_headers"), F.size("away").cast("long").alias("n_displaced"))
