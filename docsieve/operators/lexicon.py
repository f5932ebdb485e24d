"""Lexicons as tables: phrases with labels and priorities, met with texts by a join on runs of words.

A text becomes its runs of one to ``most`` words, each joined to the phrases by equality, so that a lexicon of
thousands of phrases costs one hash join and no pattern of its own for each. Words are compared in lower case and
without a plural's s. Of several phrases that stand in a text the one with the least place wins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.functions import text as tx

MOST_WORDS = 3


def singular(word: Column) -> Column:
    return F.when((F.length(word) > 3) & word.endswith("s") & ~word.endswith("ss"), F.left(word, F.length(word) - 1)).otherwise(word)


def _singular(word: str) -> str:
    return word[:-1] if len(word) > 3 and word.endswith("s") and not word.endswith("ss") else word


@dataclass(frozen=True)
class Lexicon:
    """``lines``: ``label: phrase, phrase`` or ``label/detail: phrase, phrase``, in order of priority; ``default`` where none stands."""

    name: str
    lines: str
    default: str

    def entries(self) -> list[tuple[str, str, str, int]]:
        """(phrase, label, detail, place); a phrase that is listed twice counts where it stands first."""
        out: dict[str, tuple[str, str, str, int]] = {}
        for line in filter(None, map(str.strip, self.lines.splitlines())):
            head, phrases = line.split(":")
            label, _, detail = head.partition("/")
            for phrase in phrases.split(","):
                plain = " ".join(map(_singular, phrase.lower().split()))
                out.setdefault(plain, (plain, label.strip(), detail.strip(), len(out)))
        return list(out.values())

    def labels(self) -> list[str]:
        return list(dict.fromkeys(e[1] for e in self.entries()))

    def table(self, spark: SparkSession) -> DataFrame:
        """The lexicon as a local relation, the size of which the planner knows when it chooses the join."""
        rows = ", ".join(f"('{p}', '{a}', '{b}', {i})" for p, a, b, i in self.entries())
        return spark.sql(f"SELECT * FROM VALUES {rows} AS lexicon(phrase, label, detail, place)")

    def sql(self) -> str:
        """The lexicon as a CTE of its name."""
        rows = ", ".join(f"('{p}', '{a}', '{b}', {i})" for p, a, b, i in self.entries())
        return f"{self.name}(phrase, label, detail, place) AS (VALUES {rows})"


def word_runs(text: Column, most: int = MOST_WORDS) -> Column:
    """Array of (``at``, ``phrase``): all runs of up to ``most`` words, with the number of their first word."""

    def runs(words: Column) -> Column:
        at = F.when(F.size(words) > 0, F.sequence(F.lit(1), F.size(words))).otherwise(F.array().cast("array<int>"))
        each = F.transform(at, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(most), F.size(words) - i + 1)), lambda n: F.struct(i.alias("at"), F.array_join(F.slice(words, i, n), " ").alias("phrase"))))
        return F.flatten(each)

    # The words are bound once, as the one element that the outer step maps.
    return F.flatten(F.transform(F.array(F.transform(tx.words(text), singular)), runs))


def hits(rows: DataFrame, keys: list[str], text: str, lexicon: DataFrame, most: int = MOST_WORDS) -> DataFrame:
    """A row for each key and phrase of the lexicon that stands in its text: ``label``, ``detail``, ``place``, ``at`` (first word)."""
    runs = rows.select(*keys, F.inline(word_runs(F.col(text), most)))
    return runs.join(lexicon, "phrase").groupBy(*keys, "phrase", "label", "detail", "place").agg(F.min("at").alias("at"))


def labelled(rows: DataFrame, text: str, lexicon: Lexicon, out: str = "label", detail: str | None = None, table: DataFrame | None = None) -> DataFrame:
    """The rows with the label (and detail) of the first phrase that stands in their text, else the default.

    Distinct texts are looked up once. ``table`` is a lexicon's table of the user's own, in place of the given one's.
    """
    names = rows.select(F.col(text).alias("_text")).where("_text IS NOT NULL").distinct()
    found = hits(names, ["_text"], "_text", table if table is not None else lexicon.table(rows.sparkSession))
    first = found.groupBy("_text").agg(F.min(F.struct("place", "label", "detail")).alias("_first"))
    joined = rows.join(first, F.col(text) == F.col("_text"), "left").withColumn(out, F.coalesce("_first.label", F.lit(lexicon.default)))
    if detail:
        joined = joined.withColumn(detail, F.col("_first.detail"))
    return joined.drop("_text", "_first")


# --- the same in DuckDB's words ---


def s_tokens(x: str) -> str:
    norm = f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"
    return f"list_transform(list_filter(string_split({norm}, ' '), lambda w: w <> ''), lambda w: CASE WHEN length(w) > 3 AND right(w, 1) = 's' AND right(w, 2) <> 'ss' THEN left(w, -1) ELSE w END)"


def s_hits(source: str, keys: str, text: str, lexicon: str, out: str, most: int = MOST_WORDS) -> str:
    """CTEs that end in ``out``: the keys, phrase, label, detail, place and ``pos`` of each phrase that stands in a text."""
    sizes = ", ".join(f"({n})" for n in range(1, most + 1))
    return f"""{out}_words AS (SELECT {keys}, {s_tokens(text)} AS w FROM {source}),
    {out}_runs AS (SELECT {keys}, i AS pos, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM {out}_words, unnest(range(1, len(w) + 1)) u(i), (VALUES {sizes}) v(n) WHERE i + n - 1 <= len(w)),
    {out} AS (SELECT {keys}, phrase, label, detail, place, min(pos) AS pos FROM {out}_runs JOIN {lexicon} USING (phrase) GROUP BY {keys}, phrase, label, detail, place)"""


def s_labels(source: str, key: str, text: str, lexicon: Lexicon, out: str) -> str:
    """CTEs that end in ``out``: the key, ``label`` and ``detail`` of the first phrase of each text that has one."""
    return f"{lexicon.sql()}, {s_hits(source, key, text, lexicon.name, f'{out}_all')}, {out} AS (SELECT {key}, arg_min(label, place) AS label, arg_min(detail, place) AS detail FROM {out}_all GROUP BY {key})"
