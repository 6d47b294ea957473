"""Running values over the rows of a group in their order, for groups of any size: no group is one task's work."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tracemill.plans import shared


@dataclass(frozen=True)
class Running:
    """A value for each row: of kind sum, max or last (not null) over the rows up to it, or lag, that of the row before it."""

    kind: str
    column: str

    def within(self, w: WindowSpec) -> Column:
        to_here = w.rowsBetween(Window.unboundedPreceding, 0)
        c = self.column
        return {"sum": lambda: F.sum(c).over(to_here), "max": lambda: F.max(c).over(to_here), "last": lambda: F.last(c, ignorenulls=True).over(to_here), "lag": lambda: F.lag(c).over(w)}[self.kind]()

    def total(self, order: Column) -> Column:
        """Of a whole part of a group; order is a struct of what its rows are sorted by."""
        c = F.col(self.column)
        if self.kind == "lag":
            return F.max_by(c, order)
        return {"sum": F.sum(c), "max": F.max(c), "last": F.max_by(c, F.when(c.isNotNull(), order))}[self.kind]

    def before(self, total: str, w: WindowSpec) -> Column:
        """Of all parts of the group that come before one; w orders the parts."""
        earlier = w.rowsBetween(Window.unboundedPreceding, -1)
        return {"sum": lambda: F.sum(total).over(earlier), "max": lambda: F.max(total).over(earlier), "last": lambda: F.last(total, ignorenulls=True).over(earlier), "lag": lambda: F.lag(total).over(w)}[self.kind]()

    def onto(self, before: Column, here: Column, first: Column) -> Column:
        return {"sum": F.when(here.isNull(), before).otherwise(F.coalesce(before, F.lit(0)) + here), "max": F.greatest(before, here), "last": F.coalesce(here, before), "lag": F.when(first, before).otherwise(here)}[self.kind]


def running(df: DataFrame, group: str, order: list[str], values: dict[str, Running]) -> DataFrame:
    """df with the running values, by name, and nth, the place of a row in its group from 1 on.

    group is a column without nulls; order are columns of which nulls come first; rows equal in them come in any order,
    but each has its place. Rows are dealt by ranges of (group, order) into a table, so a group is as many tasks' as it
    needs; within a task's part of a group a window adds up, and what the parts before it come to is joined: only the first
    and last group of a range have such parts, so that are two rows a range. df has no columns s_part, s_place or nth.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    root = shared.folder(spark, "scan")
    # their places in a table part equal rows
    raw = shared.written(df, f"{root}/rows")
    keys = [F.col(group), *[F.col(c).asc_nulls_first() for c in order], F.col("s_place")]
    dealt = raw.withColumn("s_place", F.monotonically_increasing_id()).repartitionByRange(parts, *keys)
    table = shared.written(dealt.withColumn("s_part", F.spark_partition_id()), f"{root}/dealt")
    ends = table.groupBy("s_part").agg(F.min(group).alias("a"), F.max(group).alias("z")).select("s_part", F.explode(F.array_distinct(F.array("a", "z"))).alias(group))
    by = F.struct(*order, "s_place")
    totals = table.join(F.broadcast(ends), ["s_part", group], "left_semi").groupBy("s_part", group).agg(F.count(F.lit(1)).alias("s_n"), *[v.total(by).alias(f"s_t_{k}") for k, v in values.items()])
    by_part = Window.partitionBy(group).orderBy("s_part")
    ahead = totals.select("s_part", group, F.coalesce(F.sum("s_n").over(by_part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("s_n"), *[v.before(f"s_t_{k}", by_part).alias(f"s_b_{k}") for k, v in values.items()])
    ahead = shared.written(ahead, f"{root}/ahead")
    here = Window.partitionBy("s_part", group).orderBy(*[F.col(c).asc_nulls_first() for c in order], "s_place")
    local = table.withColumns({"nth": F.row_number().over(here).cast("long"), **{f"s_h_{k}": v.within(here) for k, v in values.items()}})
    joined = local.join(F.broadcast(ahead), ["s_part", group], "left")
    made = [v.onto(F.col(f"s_b_{k}"), F.col(f"s_h_{k}"), F.col("nth") == 1).alias(k) for k, v in values.items()]
    return joined.select(*df.columns, *made, (F.col("nth") + F.coalesce("s_n", F.lit(0))).alias("nth"))
