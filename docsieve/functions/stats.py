"""Small-sample statistics: variance analysis from sums, and what needs numbers that Spark lacks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def anova(rows: DataFrame, keys: list[str], group: str, value: str) -> DataFrame:
    """One-way analysis of variance of ``value`` between groups, from counts, sums and sums of squares."""
    v = F.col(value).cast("double")
    parts = rows.groupBy(*keys, group).agg(F.count(v).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q"))
    total = parts.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.count(F.lit(1)).alias("groups"),
        F.sum(F.col("s") * F.col("s") / F.col("n")).alias("between_raw"),
    )
    between = F.col("between_raw") - F.col("s") * F.col("s") / F.col("n")
    within = F.col("q") - F.col("between_raw")
    return total.select(
        *keys, (F.col("groups") - 1).alias("df1"), (F.col("n") - F.col("groups")).alias("df2"),
        (between / F.nullif(F.col("groups") - 1, F.lit(0)) / F.nullif(within / (F.col("n") - F.col("groups")), F.lit(0.0))).alias("f"),
    )


def jaro_winkler(a: str, b: str, boost: float = 0.1) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free, left = list(b), []
    taken = [False] * len(b)
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and free[j] == c:
                taken[j] = True
                left.append(c)
                break
    right = [c for c, t in zip(b, taken) if t]
    m = len(left)
    if not m:
        return 0.0
    swaps = sum(x != y for x, y in zip(left, right)) / 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + prefix * boost * (1 - jaro)


@F.pandas_udf(T.DoubleType())
def jaro_winkler_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else jaro_winkler(x, y) for x, y in zip(a, b)], dtype="float64")


def _tail_fraction(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The continued fraction of the incomplete beta function, from its far end; as many terms as the largest shape asks for."""
    terms = 60 + int(8 * np.sqrt(max(a.max(initial=1.0), b.max(initial=1.0))))
    t = np.ones(len(x))
    for j in range(terms, 0, -1):
        m = j // 2
        top = m * (b - m) if j % 2 == 0 else -(a + m) * (a + b + m)
        t = 1 + top * x / ((a + j - 1) * (a + j) * t)
    return t


def beta_cdf(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function for all a, b > 0.

    Its continued fraction converges quickly below the mean; above it, the other tail is taken from one.
    """
    x, a, b = np.broadcast_arrays(*(np.asarray(v, float) for v in (x, a, b)))
    x, a, b = x.ravel(), a.ravel(), b.ravel()
    upper = x > (a + 1) / (a + b + 2)
    y, p, q = np.where(upper, 1 - x, x), np.where(upper, b, a), np.where(upper, a, b)
    norm = np.array([math.lgamma(v + w) - math.lgamma(v) - math.lgamma(w) for v, w in zip(p, q)])
    inside = (y > 0) & (y < 1)
    safe = np.where(inside, y, 0.5)
    part = np.exp(norm + p * np.log(safe) + q * np.log1p(-safe)) / (p * _tail_fraction(safe, p, q))
    part = np.where(inside, np.clip(part, 0, 1), np.where(y <= 0, 0.0, 1.0))
    return np.where(upper, 1 - part, part)


@F.pandas_udf(T.StructType([T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())]))
def beta_interval(successes: pd.Series, trials: pd.Series) -> pd.DataFrame:
    """The central 95 % of Beta(1 + s, 1 + n - s), by bisection for all rows at once."""
    a, b = 1.0 + successes.to_numpy(float), 1.0 + (trials - successes).to_numpy(float)

    def quantile(p: float) -> np.ndarray:
        low, high = np.zeros(len(a)), np.ones(len(a))
        for _ in range(50):
            mid = (low + high) / 2
            under = beta_cdf(mid, a, b) < p
            low, high = np.where(under, mid, low), np.where(under, high, mid)
        return (low + high) / 2

    return pd.DataFrame({"low": quantile(0.025), "high": quantile(0.975)})


def normal_tail(z: Column) -> Column:
    """The upper tail of the normal distribution, by a rational approximation of the error function."""
    # Coefficients 7.1.26 of Abramowitz and Stegun's handbook.
    p, coefficients = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + p * x)
    series = F.lit(0.0)
    for c in reversed(coefficients):
        series = (series + c) * t
    upper = series * F.exp(-x * x) / 2
    return F.when(z >= 0, upper).otherwise(1 - upper)


@F.pandas_udf(T.DoubleType())
def beta_under(x: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    """The share of Beta(a, b), for a, b > 0, that lies under x."""
    return pd.Series(beta_cdf(x.to_numpy(float), a.to_numpy(float), b.to_numpy(float)))


@F.pandas_udf(T.DoubleType())
def _f_tail(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    known = f.notna()
    out = pd.Series(np.nan, index=f.index)
    v, m, n = (c[known].to_numpy(float) for c in (f, df1, df2))
    out[known] = beta_cdf(n / (n + m * v), n / 2, m / 2)
    return out


#: From this many degrees of freedom on, one degree above, the normal tail stands for Student's.
MANY = 30


def f_pvalue(f: Column, df1: Column, df2: Column) -> Column:
    """The chance of an F as large or larger: the normal tail with one and many degrees, else by the incomplete beta function."""
    normal = (df1 == 1) & (df2 >= MANY)
    open_case = (f > 0) & (f < float("inf")) & ~normal
    exact = _f_tail(F.when(open_case, f), df1, df2)
    return F.when(f <= 0, 1.0).when(f == float("inf"), 0.0).when(normal, 2 * normal_tail(F.sqrt(f))).otherwise(exact)


def two_groups(rows: DataFrame, keys: list[str], second: Column, value: str) -> DataFrame:
    """Whether two groups differ: ``n``, ``gain`` (the second's mean less the first's), ``f``, ``p_value`` for each of the keys.

    A group of fewer than two values tells nothing (F 0, p 1). Without any spread within the groups, means that
    differ are beyond doubt (F infinite, p 0).
    """
    return groups_apart(rows.groupBy(*keys).agg(*group_sums(second, value)), keys)


def group_sums(second: Column, value: str) -> list[Column]:
    """Numbers (``n1``, ``n2``), sums (``s``) and sums of squares (``q``) of both groups' values."""
    v = F.col(value).cast("double")

    def parts(when: Column, name: str) -> list[Column]:
        chosen = F.when(when, v)
        return [F.count(chosen).alias(f"n{name}"), F.sum(chosen).alias(f"s{name}"), F.sum(chosen * chosen).alias(f"q{name}")]

    return [*parts(~second, "1"), *parts(second, "2")]


def groups_apart(p: DataFrame, keys: list[str]) -> DataFrame:
    """``two_groups`` of rows that hold the groups' sums."""
    n, few = F.col("n1") + F.col("n2"), (F.col("n1") < 2) | (F.col("n2") < 2)
    mean = [F.col(f"s{i}") / F.nullif(F.col(f"n{i}"), F.lit(0)) for i in (1, 2)]
    within = F.col("q1") - F.col("s1") * mean[0] + F.col("q2") - F.col("s2") * mean[1]
    gain = mean[1] - mean[0]
    between = gain * gain * F.col("n1") * F.col("n2") / F.nullif(n, F.lit(0))
    none = within <= 1e-12
    ratio = F.when(few, 0.0).when(none, F.when(F.abs(gain) > 1e-12, float("inf")).otherwise(0.0)).otherwise(between / F.nullif(F.when(~none, within) / F.nullif(n - 2, F.lit(0)), F.lit(0.0)))
    found = p.select(*keys, n.alias("n"), gain.alias("gain"), ratio.alias("f"))
    return found.withColumn("p_value", f_pvalue(F.col("f"), F.lit(1), F.col("n") - 2))
