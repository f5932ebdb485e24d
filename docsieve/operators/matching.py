"""Matching rows by names, words and intervals, with joins on shared keys instead of comparisons of all pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsieve.operators.folds import ordered_fold


def canonical(rows: DataFrame, name: str, aliases: DataFrame, out: str = "canonical") -> DataFrame:
    """The alias table's (``alias``, ``canonical``) name, else the trimmed lower-case one; the table is a small lexicon."""
    key = F.lower(F.trim(F.col(name)))
    known = aliases.select(F.col("alias").alias("_alias"), F.col("canonical").alias("_canonical"))
    joined = rows.join(F.broadcast(known), key == F.col("_alias"), "left")
    return joined.withColumn(out, F.coalesce("_canonical", key)).drop("_alias", "_canonical")


def share_a_word(left: DataFrame, right: DataFrame, left_words: str, right_words: str, keys: list[str]) -> DataFrame:
    """Pairs of rows with a common word, and how many: joined on the words, counted per pair."""
    a = left.select(*[c for c in left.columns if c in keys], F.explode(F.array_distinct(left_words)).alias("word"))
    b = right.select(*[c for c in right.columns if c in keys], F.explode(F.array_distinct(right_words)).alias("word"))
    return a.join(b, "word").groupBy(*keys).agg(F.count(F.lit(1)).alias("n_shared"))


def first_match(pairs: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first of each key's matches."""
    placed = pairs.withColumn("_place", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    return placed.where("_place = 1").drop("_place")


def overlapping(a: DataFrame, b: DataFrame, owner: str, bucket: int = 12) -> DataFrame:
    """Pairs of one owner's intervals (``a_*``, ``b_*`` columns) that overlap, found in buckets of months.

    Each interval goes to the buckets that it touches; a pair is reported in the first bucket that both touch.
    """

    def dealt(rows: DataFrame, p: str) -> DataFrame:
        low, high = F.floor(F.col(f"{p}_start") / bucket), F.floor((F.col(f"{p}_end") - 1) / bucket)
        return rows.withColumn("bucket", F.explode(F.sequence(low, F.greatest(low, high))))

    met = dealt(a, "a").join(dealt(b, "b"), [owner, "bucket"])
    first = F.floor(F.greatest("a_start", "b_start") / bucket)
    return met.where((F.col("a_start") < F.col("b_end")) & (F.col("b_start") < F.col("a_end")) & (F.col("bucket") == first)).drop("bucket")


def alike_lists(pairs: DataFrame) -> DataFrame:
    """``name`` and ``alike``, the sorted keys of the names that it matches, of pairs (``a``, ``b``) of keys of distinct names."""
    return pairs.groupBy(F.col("a").alias("_name")).agg(F.array_sort(F.collect_set("b")).alias("_alike"))


class Seeds:
    """The seeds of one owner, by name, what they must differ in, and the years that they touch."""

    def __init__(self):
        self.of: dict[tuple, list[tuple]] = {}
        self.kinds: dict[int, set] = {}
        self.n = 0

    def place(self, near: Callable | None, apart: bool, first, name: int, alike: list[int] | None, kind, low: int, high: int):
        """The first seed that a row is similar to, else the row's own, as it becomes one. Empty intervals touch their first year."""
        years = range(low // 12, max(low, high) // 12 + 1) if near else (None,)
        best = None
        for other in alike or ():
            for group in self.kinds.get(other, ()):
                if apart and group == kind:
                    continue
                for year in years:
                    for n, seed, a, b in self.of.get((other, group, year), ()):
                        if best is not None and n > best[0]:
                            break  # those that follow came later
                        if near is None or near(a, b, low, high):
                            best = (n, seed)
                            break
        if best is not None:
            return best[1]
        self.kinds.setdefault(name, set()).add(kind)
        for year in years:
            self.of.setdefault((name, kind, year), []).append((self.n, first, low, high))
        self.n += 1
        return first


def seed_groups(
    rows: DataFrame, owner: str, order: str, names: list[str], pairs: DataFrame, near: Callable | None = None, apart: str | None = None, group: str = "seed"
) -> DataFrame:
    """Greedy groups in a fixed order: a row joins the first group whose seed it is similar to, else it seeds one.

    An ordered fold whose state is the owner's seeds. A row is similar to a seed whose names its own match (``pairs``
    of ``name_key``), whose ``start_m`` and ``end_m`` are ``near`` its own (of intervals that touch), and whose ``apart``
    column differs. Returns the rows, each with its seed's ``order`` column as ``group``.
    """
    keyed = rows.withColumn("_name", name_key(*names)).join(alike_lists(pairs), "_name", "left")
    kind = [apart] if apart else ["_name"]

    def step(state: Seeds, first, name, alike, other, low=0, high=0):
        return state.place(near, apart is not None, first, name, alike, other if apart else None, low, high)

    using = [order, "_name", "_alike", *kind, *(["start_m", "end_m"] if near else [])]
    kinds = dict(rows.dtypes)[order].replace("bigint", "long")
    return ordered_fold(keyed, [owner], [order], using, Seeds, step, group, kinds).drop("_name", "_alike")


def name_key(*names: str) -> Column:
    """A 64-bit key of a name, or of several together."""
    return F.xxhash64(*names)


def bucketed_pairs(rows: DataFrame, owner: str, columns: list[str], slack: int = 0, bucket: int = 12) -> DataFrame:
    """Pairs ``a``, ``b`` (structs, ``a.ordinal < b.ordinal``) of one owner's rows whose intervals are no more than ``slack`` apart.

    Met in buckets of months that both touch; a pair is kept in the first of them.
    """
    own = F.struct(*columns)
    low, high = F.col("start_m") - slack, F.greatest("start_m", "end_m")
    dealt = rows.select(owner, own.alias("r"), F.explode(F.sequence(F.floor(low / bucket), F.floor(high / bucket))).alias("bucket"))
    a, b = dealt.withColumnRenamed("r", "a"), dealt.withColumnRenamed("r", "b")
    first = F.floor((F.greatest("a.start_m", "b.start_m") - slack) / bucket)
    return a.join(b, [owner, "bucket"]).where("a.ordinal < b.ordinal").where(F.col("bucket") == first).drop("bucket")
