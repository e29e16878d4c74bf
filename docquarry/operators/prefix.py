"""Running totals over groups of any size: no group is one task's work."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquarry.sources.shared import stash


def running_total(df: DataFrame, by: str, order: tuple[str, ...], value: str, into: str) -> DataFrame:
    """df with `into`: the total of `value` over the rows of the same `by` that come before in `order`; 0 for the first.

    In two steps: rows are dealt by ranges of (by, order), so a large group lies in many partitions; each partition gives one total per
    group, and the totals before it are added to the running totals within it.  Meant for narrow tables: rows are written once and shuffled twice.
    """
    dealt = stash(df.repartitionByRange(by, *order).withColumn("_part", F.spark_partition_id()), "dealt")
    before = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition of a group
    totals = dealt.groupBy(by, "_part").agg(F.sum(value).alias("_total"))
    totals = totals.select(by, "_part", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = dealt.withColumn("_within", F.coalesce(F.sum(value).over(within), F.lit(0))).join(totals, [by, "_part"])
    return joined.withColumn(into, F.col("_before") + F.col("_within")).drop("_part", "_within", "_before")
