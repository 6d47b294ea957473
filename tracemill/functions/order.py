"""Exact order statistics of columns of any length: no task sorts or holds a whole group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tracemill.plans import shared

#: Quantiles that a first pass estimates, with a tenth of their distance as error; the wanted value is within two of them.
GRID, GROUPS = 512, 10_000


def at_floor(q: float) -> Callable[[Column], Column]:
    """The place int(n * q) among n sorted values, from 0."""
    return lambda n: F.least(F.floor(n * F.lit(q)), n - 1)


def at_nearest(q: float) -> Callable[[Column], Column]:
    """The place round(q * (n - 1)), a half rounded to even."""
    return lambda n: F.bround((n - 1) * F.lit(q)).cast("long")


def order_statistics(df: DataFrame, group: list[str], picks: dict[str, tuple[str, Callable[[Column], Column]]]) -> DataFrame:
    """One row per group of df: its columns, and for each pick (column, place) the value at that place of its sorted values.

    Nulls and NaNs don't count; a pick without values is null; a null in group is a value like any other, and no group
    columns make one group. A first pass estimates quantiles by a mergeable sketch, whose error is known, so two of them
    bracket the wanted place; a second counts what is below the bracket and, value by value, what is in it; only those
    distinct values of a bracket, some GRID-th part of a group, come into order. Ties are one value with a count.
    """
    spark = df.sparkSession
    root = shared.folder(spark, "order")
    one = group or ["o_all"]
    key = F.to_json(F.struct(*one), {"ignoreNullFields": "false"})
    value = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    base = df if group else df.withColumn("o_all", F.lit(0))
    rows = shared.written(base.select(*one, key.alias("o_key"), *[value(c).alias(f"o_v{i}") for i, (c, _) in enumerate(picks.values())]), f"{root}/values")
    sketch = [F.struct(F.count(f"o_v{i}").alias("n"), F.percentile_approx(f"o_v{i}", [k / GRID for k in range(GRID + 1)], 10 * GRID).alias("q")).alias(f"o_s{i}") for i in range(len(picks))]
    seen = Observation()
    found = rows.groupBy("o_key", *one).agg(*sketch)
    brackets = []
    for i, (_, place) in enumerate(picks.values()):
        n = F.col(f"o_s{i}")["n"]
        k = place(n).cast("long")
        step = F.floor(k * F.lit(float(GRID)) / n)
        q = F.col(f"o_s{i}")["q"]
        low, high = F.get(q, F.greatest(step - 2, F.lit(0)).cast("int")), F.get(q, F.least(step + 3, F.lit(GRID)).cast("int"))
        # at the ends there is nothing to leave out
        brackets.append(F.when(n > 0, F.struct(k.alias("k"), F.when(step > 2, low).alias("low"), F.when(step + 3 < GRID, high).alias("high"))).alias(f"o_b{i}"))
    groups = shared.written(found.select("o_key", *one, *brackets).observe(seen, F.count(F.lit(1)).alias("n")), f"{root}/brackets")
    small = F.broadcast if seen.get["n"] <= GROUPS else lambda x: x
    j = rows.join(small(groups.drop(*one)), "o_key")
    b = lambda i: F.col(f"o_b{i}")
    v = lambda i: F.col(f"o_v{i}")
    under = lambda i: F.coalesce(v(i) < b(i)["low"], F.lit(False))
    within = lambda i: v(i).isNotNull() & ~under(i) & F.coalesce(v(i) <= b(i)["high"], F.lit(True))
    below = j.groupBy("o_key").agg(*[F.count_if(under(i)).alias(f"o_n{i}") for i in range(len(picks))])
    inside = j.select("o_key", F.explode(F.array_compact(F.array(*[F.when(within(i), F.struct(F.lit(i).alias("pick"), v(i).alias("value"))) for i in range(len(picks))]))).alias("x"))
    ties = inside.groupBy("o_key", "x.pick", "x.value").agg(F.count("*").alias("m"))
    upto = F.sum("m").over(Window.partitionBy("o_key", "pick").orderBy("value"))
    place_of = F.element_at(F.array(*[F.col(f"o_b{i}")["k"] - F.col(f"o_n{i}") for i in range(len(picks))]), F.col("pick") + 1)
    ranked = ties.withColumn("upto", upto).join(below.join(groups, "o_key"), "o_key").where(F.col("upto") > place_of)
    best = ranked.groupBy("o_key").agg(*[F.min(F.when(F.col("pick") == i, F.col("value"))).alias(name) for i, name in enumerate(picks)])
    return groups.join(best, "o_key", "left").select(*group, *[F.col(n) for n in picks])
