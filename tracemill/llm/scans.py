"""Running numbers and totals within groups of any size, without a group ever being one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.common import Workspace


def running(work: Workspace, df: DataFrame, group: str, order: list[Column], sums: tuple[str, ...] = (), xors: tuple[str, ...] = ()) -> DataFrame:
    """df with nth (1, 2, ... in its group), and run_<c> for the columns of sums and xors: their running value, this row's included.

    group names a column without nulls; df has no columns nth, r_part, r_place, low, high. Rows are dealt by ranges of (group, order), so a group of any size is spread; rows
    that are equal in both are parted by their place in a table written first, and numbered in any order. Only the first
    and last groups of a range can go on in another one: their totals, two rows a range, are brought to the ranges after.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    raw = work.write(df)
    keys = [F.col(group), *order, F.col("r_place")]
    dealt = raw.withColumn("r_place", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).withColumn("r_part", F.spark_partition_id())
    table = work.write(dealt)
    work.forget(raw)
    edges = table.groupBy("r_part").agg(F.min(group).alias("low"), F.max(group).alias("high")).withColumn(group, F.explode(F.array_distinct(F.array("low", "high")))).select("r_part", group)
    # two rows a range
    totals = table.join(F.broadcast(edges), ["r_part", group], "left_semi").groupBy("r_part", group)
    totals = totals.agg(F.count(F.lit(1)).alias("t_nth"), *[F.sum(c).alias(f"t_{c}") for c in sums], *[F.bit_xor(c).alias(f"t_{c}") for c in xors])
    earlier = Window.partitionBy(group).orderBy("r_part").rowsBetween(Window.unboundedPreceding, -1)
    over = lambda w, c, name: (F.bit_xor(name) if c in xors else F.sum(name)).over(w)
    before = work.write(totals.select("r_part", group, *[F.coalesce(over(earlier, c, f"t_{c}"), F.lit(0)).alias(f"b_{c}") for c in ("nth", *sums, *xors)]))
    here = Window.partitionBy("r_part", group).orderBy(*order, "r_place").rowsBetween(Window.unboundedPreceding, 0)
    local = table.withColumn("nth", F.row_number().over(here).cast("long")).withColumns({f"run_{c}": over(here, c, c) for c in (*sums, *xors)})
    local = local.join(F.broadcast(before), ["r_part", group], "left")

    def onto(c: str, value: str) -> Column:
        ahead = F.coalesce(F.col(f"b_{c}"), F.lit(0))
        return F.col(value).bitwiseXOR(ahead.cast("long")) if c in xors else F.col(value) + ahead

    return local.select(*df.columns, onto("nth", "nth").alias("nth"), *[onto(c, f"run_{c}").alias(f"run_{c}") for c in (*sums, *xors)])
