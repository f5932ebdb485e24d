"""Text as columns: normalising, words, cleaning, contacts and quality. Patterns keep to what RE2 also reads."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Ligatures, quotes, dashes, bullets and blanks that extraction leaves behind.
REPAIRS = [("ﬁ", "fi"), ("ﬂ", "fl"), ("“", '"'), ("”", '"'), ("‘", "'"), ("’", "'"), ("–", "-"), ("—", "-"), ("•", "-"), ("\u00a0", " "), ("\u200b", "")]
STOP = ("the", "and", "of", "to", "in", "is", "for", "on", "with", "that", "at", "it", "an", "was", "as")
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}"
PHONE = r"[+]?[0-9][0-9 ().-]{6,18}[0-9]"
URL = r"https?://[^ \n\t<>)\"']+"


def basic(text: Column) -> Column:
    """Lower case, other than letters and digits as single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def bare(text: pa.Array) -> pa.Array:
    """Letters without their marks, in any script: decomposed, marks taken off, composed again."""
    apart = pc.replace_substring_regex(pc.utf8_normalize(text, form="NFD"), r"\p{M}", "")
    # Arrow's own NFC leaves what was taken apart as it is.
    return pa.array([None if x is None else unicodedata.normalize("NFC", x) for x in apart.to_pylist()], pa.string())


@F.arrow_udf(T.StringType())
def without_marks(text: pa.Array) -> pa.Array:
    """``bare`` of a column."""
    return bare(text)


def without_accents(text: Column) -> Column:
    return basic(without_marks(text))


def words(text: Column) -> Column:
    """The words of the basic form; none of an empty text."""
    return F.filter(F.split(basic(text), " "), lambda w: w != "")


def significant(text: Column) -> Column:
    """Distinct words of two letters or more that aren't stop words."""
    return F.array_distinct(F.filter(words(text), lambda w: (F.length(w) > 1) & ~w.isin(*STOP)))


def repaired(text: Column) -> Column:
    for bad, good in REPAIRS:
        text = F.replace(text, F.lit(bad), F.lit(good))
    return text


def single_spaced(text: Column) -> Column:
    """Single blanks, no blanks at line ends, at most three line breaks in a row."""
    text = F.regexp_replace(text, "[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(text, " \n", "\n"), "\n{4,}", "\n\n\n")


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def count_of(text: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(f"({pattern})"), 1)).cast("long")


def similarity(a: Column, b: Column) -> Column:
    """1 - distance / length of the longer; 1 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0))


def ngrams(tokens: Column, n: int) -> Column:
    """Distinct runs of n tokens.

    The tokens are bound once, as the one element that the outer step maps; named in the inner step, they would be
    computed anew for each run.
    """

    def runs(bound: Column) -> Column:
        at = F.when(F.size(bound) >= n, F.sequence(F.lit(1), F.size(bound) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(at, lambda i: F.array_join(F.slice(bound, i, n), " ")))

    return F.flatten(F.transform(F.array(tokens), runs))
