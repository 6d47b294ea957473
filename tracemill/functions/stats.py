"""Statistics that reports share. Where several definitions exist they stay apart, each under its own name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def percentile_linear(c: Column, p: float) -> Column:
    """By linear interpolation; null without values."""
    return F.percentile(c, F.lit(p / 100))


def median_or_zero(c: Column) -> Column:
    return F.coalesce(F.median(c), F.lit(0.0))


def percentile_floor(c: Column, q: float) -> Column:
    """The sorted values' item int(n * q)."""
    s = F.array_sort(F.collect_list(c))
    return F.get(s, F.least(F.floor(F.size(s) * F.lit(q)), F.size(s) - 1).cast("int"))


def percentile_nearest(c: Column, q: float) -> Column:
    """The sorted values' item round(q * (n - 1)), a half rounded to even."""
    s = F.array_sort(F.collect_list(c))
    return F.get(s, F.bround((F.size(s) - 1) * F.lit(q)).cast("int"))


def ratio(part: Column, whole: Column) -> Column:
    """0 if the whole is 0."""
    return F.when(whole == 0, 0.0).otherwise(part / whole)


def percent(part: Column, whole: Column) -> Column:
    """Null if the whole is 0."""
    return F.when(whole != 0, 100.0 * part / whole)


def share_text(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, "n/a").otherwise(F.concat(F.format_string("%.1f", 100.0 * part / whole), F.lit("%")))


def wilson_lower_bound(successes: Column, total: Column, z: float) -> Column:
    """Of a share of successes; 0 without trials, never below 0."""
    n, p = total.cast("double"), successes / total
    low = (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    return F.when(total == 0, 0.0).otherwise(F.greatest(F.lit(0.0), low))


def jaccard(a: Column, b: Column) -> Column:
    """0 for two empty sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def recency_weight(ts: Column, now: Column, half_life_s: float) -> Column:
    """0.5 to the age in half-lives, an age below 0 counting as 0; 1 if there is no half-life."""
    if half_life_s <= 0:
        return F.lit(1.0)
    return F.pow(F.lit(0.5), F.greatest(F.lit(0.0), now - ts) / half_life_s)


def total_variation(a: DataFrame, b: DataFrame, key: str, share: str) -> DataFrame:
    """Half the sum of the differences of two distributions, over the keys of either."""
    both = a.select(key, F.col(share).alias("x")).join(b.select(key, F.col(share).alias("y")), key, "full_outer")
    return both.agg((0.5 * F.sum(F.abs(F.coalesce("x", F.lit(0.0)) - F.coalesce("y", F.lit(0.0))))).alias("tvd"))
