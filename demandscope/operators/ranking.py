"""Places within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from demandscope.session import stage


def rank_within(rows: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """Add the place of each row in its group, from 1; ``order`` must be a total order of the group.

    Rows are dealt by ranges of (group, order), so a large group is sorted by many tasks. The counts of the ranges give
    each range its first place.
    """
    dealt = stage(rows.repartitionByRange(*group, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    firsts = dealt.groupBy(*group, "_range").agg(F.count("*").alias("_n")).select(
        *group, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = F.row_number().over(Window.partitionBy(*group, "_range").orderBy(*order))
    return dealt.withColumn("_inside", inside).join(firsts, [*group, "_range"]).withColumn(
        name, (F.col("_first") + F.col("_inside")).cast("int")).drop("_range", "_inside", "_first")
