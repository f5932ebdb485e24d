"""Matching of names: aliases, whole words, stems, abbreviations and substrings.

Comparisons are made between the distinct names of either side, with joins on a word or on the first letters
of the part that must be contained; facts are joined to the pairs by equal names afterwards.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.functions import text as tx

# Our own lexicons: other writings of skills, legal forms and short names of companies.
ALIASES = {"k8s": "kubernetes", "js": "javascript", "postgres": "postgresql", "ml": "machine learning", "apache spark": "spark", "microsoft excel": "excel", "ts": "typescript"}
LEGAL_FORMS = ("corp", "corporation", "inc", "llc", "ltd", "limited", "gmbh", "plc", "co")
ABBREVIATIONS = {"ibm": "international business machines", "ups": "united parcel service", "nhs": "national health service"}


def pick(table: dict[str, str], key: Column, default: Column) -> Column:
    """The value of a small lexicon for a key, as a literal map."""
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), default)


def canonical(name: Column) -> Column:
    """The alias table's name, else the trimmed lower-case one."""
    key = F.lower(F.trim(name))
    return pick(ALIASES, key, key)


def stands_in(needle: Column, text: Column) -> Column:
    """Whether two letters or more stand in the text as whole words."""
    padded = [F.concat(F.lit(" "), tx.basic(c), F.lit(" ")) for c in (needle, text)]
    return (F.length(needle) >= 2) & F.contains(padded[1], padded[0])


def skills_match(a: Column, b: Column) -> Column:
    x, y = canonical(a), canonical(b)
    return (x == y) | stands_in(x, y) | stands_in(y, x)


def name_matches(a: DataFrame, b: DataFrame) -> DataFrame:
    """``a``, ``b`` and ``exact`` of the matching names of two tables of distinct names (``name``).

    Equal after aliases (``exact``), or either stands in the other as whole words: found by its first word.
    """

    def side(rows: DataFrame, out: str) -> DataFrame:
        known = canonical(F.col("name"))
        return rows.select(F.col("name").alias(out), known.alias(f"{out}_known"), tx.words(known).alias(f"{out}_words"))

    x, y = side(a, "a"), side(b, "b")
    exact = x.join(y, F.col("a_known") == F.col("b_known")).select("a", "b", F.lit(True).alias("exact"))

    def within(short: DataFrame, long: DataFrame, s: str, t: str) -> DataFrame:
        words = long.withColumn("word", F.explode(F.array_distinct(f"{t}_words")))
        met = words.join(short.withColumn("word", F.try_element_at(f"{s}_words", F.lit(1))), "word")
        return met.where(stands_in(F.col(f"{s}_known"), F.col(f"{t}_known"))).select("a", "b", F.lit(False).alias("exact"))

    both = exact.unionByName(within(x, y, "a", "b")).unionByName(within(y, x, "b", "a"))
    return both.groupBy("a", "b").agg(F.max("exact").alias("exact"))


def contained(long: DataFrame, short: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs of distinct texts ``a`` of one table that hold texts ``b`` of another; joined on their first three letters."""
    at = F.sequence(F.lit(1), F.length(a))
    grams = F.flatten(F.transform(at, lambda i: F.array(*[F.substring(F.col(a), i, F.lit(n)) for n in (1, 2, 3)])))
    held = long.select(a).distinct().where(F.length(a) > 0).withColumn("gram", F.explode(F.array_distinct(grams)))
    keyed = short.select(b).distinct().where(F.length(b) > 0).withColumn("gram", F.left(b, F.lit(3)))
    return held.join(keyed, "gram").where(F.contains(a, b)).select(a, b)


def either_contains(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    return contained(left, right, a, b).unionByName(contained(right, left, b, a).select(a, b)).distinct()


def without_legal_form(company: Column) -> Column:
    return F.trim(F.regexp_replace(tx.basic(company), rf"\b({'|'.join(LEGAL_FORMS)})\b.*$", ""))


def companies_match(a: Column, b: Column) -> Column:
    """Equal when normalised, one within the other, half of all words common, or an abbreviation and its expansion."""
    x, y = tx.basic(a), tx.basic(b)
    short = [(F.contains(x, F.lit(s)) | F.contains(y, F.lit(s))) & (F.contains(x, F.lit(e)) | F.contains(y, F.lit(e))) for s, e in ABBREVIATIONS.items()]
    common = F.coalesce(tx.jaccard(tx.significant(a), tx.significant(b)), F.lit(0.0)) >= 0.5
    return (x == y) | F.contains(x, y) | F.contains(y, x) | common | reduce(Column.__or__, short)


def company_matches(names: DataFrame) -> DataFrame:
    """``a`` < ``b`` of the matching ones among distinct ``company`` names.

    Candidates share a word, the first letters of what one must hold, or an abbreviation's entry; then all rules apply.
    """
    keyed = names.withColumn("norm", tx.basic(F.col("company")))
    expanded = [F.when(F.contains("norm", F.lit(s)) | F.contains("norm", F.lit(e)), F.lit(f"={s}")) for s, e in ABBREVIATIONS.items()]
    keys = F.filter(F.concat(tx.words(F.col("company")), F.array(*expanded)), lambda k: k.isNotNull())
    blocks = keyed.withColumn("key", F.explode(F.array_distinct(keys)))
    a, b = blocks.select(F.col("company").alias("a"), "key"), blocks.select(F.col("company").alias("b"), "key")
    within = either_contains(keyed.select(F.col("norm").alias("p")), keyed.select(F.col("norm").alias("q")), "p", "q")
    by_text = within.join(keyed.select(F.col("norm").alias("p"), F.col("company").alias("a")), "p").join(keyed.select(F.col("norm").alias("q"), F.col("company").alias("b")), "q")
    ordered = by_text.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = a.join(b, "key").select("a", "b").unionByName(ordered).where("a < b").distinct()
    return pairs.where(companies_match(F.col("a"), F.col("b")))


def context_matches(names: DataFrame) -> DataFrame:
    """``a``, ``b`` (structs of ``title`` and ``company``) of the distinct ones that share a context, each with itself too where it does."""
    named = names.select(F.struct("title", "company").alias("a"), long_words(F.concat_ws(" ", "title", "company"), 3).alias("words")).withColumn("word", F.explode("words"))
    met = named.select("a", "word").join(named.select(F.col("a").alias("b"), "word"), "word").select("a", "b").distinct()
    return met.where(share_context(F.col("a.title"), F.col("a.company"), F.col("b.title"), F.col("b.company")))


def stem_match(a: Column, b: Column) -> Column:
    """The first six letters (or all of a shorter word) are equal; words under five letters must be equal."""
    n = F.least(F.length(a), F.length(b))
    return F.when(n < 5, a == b).otherwise(F.left(a, F.least(n, F.lit(6))) == F.left(b, F.least(n, F.lit(6))))


def stems_in(a: Column, b: Column) -> Column:
    """How many words of ``a`` have a stem in ``b``."""
    return F.size(F.filter(a, lambda w: F.exists(b, lambda v: stem_match(w, v))))


def titles_match(a: Column, b: Column) -> Column:
    """Equal, the shorter one's stems all in the longer, or more than half of the longer one's words in common by stems."""
    x, y = tx.significant(a), tx.significant(b)
    smaller = F.when(F.size(x) <= F.size(y), stems_in(x, y)).otherwise(stems_in(y, x))
    share = F.greatest(stems_in(x, y), stems_in(y, x)) / F.greatest(F.size(x), F.size(y))
    some = (F.size(x) > 0) & (F.size(y) > 0)
    return (tx.basic(a) == tx.basic(b)) | (some & ((smaller == F.least(F.size(x), F.size(y))) | (share > 0.5)))


def long_words(text: Column, least: int) -> Column:
    """Distinct lower-case words of ``least`` letters or more, cut at blanks, commas, brackets and slashes."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[\s,()/]+"), lambda w: F.length(w) >= least))


def share_context(title_a: Column, company_a: Column, title_b: Column, company_b: Column) -> Column:
    """A company word of four letters in common, or two words of title and company of three."""
    words = [long_words(F.concat_ws(" ", t, c), 3) for t, c in ((title_a, company_a), (title_b, company_b))]
    return F.arrays_overlap(long_words(company_a, 4), long_words(company_b, 4)) | (F.size(F.array_intersect(*words)) >= 2)


def dates_agree(a_start: Column, a_end: Column, b_start: Column, b_end: Column, tolerance: int = 6) -> Column:
    """Intervals of months overlap by 30 % of the shorter, and are apart by no more than ``tolerance``."""
    overlap = F.least(a_end, b_end) - F.greatest(a_start, b_start)
    return (overlap >= -tolerance) & (overlap >= 0.3 * F.least(a_end - a_start, b_end - b_start))
