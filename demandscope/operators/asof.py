"""As-of joins: each row with the last state of its key that was known at its time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from demandscope.session import stage


def asof_join(rows: DataFrame, states: DataFrame, key: list[str], row_time: str, state_time: str,
              columns: list[str]) -> DataFrame:
    """``rows`` with ``columns`` of the newest state of the same key at or before ``row_time``; null where there is none.

    States of equal time are ordered by ``columns``, the last counts. Both sides are put in one order of (key, time) and dealt by
    ranges of it, so a key with a large part of all rows lies in many ranges: inside a range the last state goes on by a
    window, and each range takes over the last state of the ranges of its key before it. Rows with a null key or
    time have no state; states with one are nobody's.
    """
    state = F.struct(F.col(state_time).alias("_at"), *columns)
    left = rows.select(*rows.columns, F.col(row_time).alias("_time"), F.lit(1).alias("_side")).withColumn("_row", F.struct(*rows.columns))
    right = states.filter(F.col(state_time).isNotNull()).select(*key, F.col(state_time).alias("_time"), F.lit(0).alias("_side"), state.alias("_state"))
    both = left.select(*key, "_time", "_side", "_row").unionByName(right, allowMissingColumns=True)
    # a state comes before a row of its time; among equal rows any order will do
    order = [*key, "_time", "_side", "_state"]
    dealt = stage(both.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "asof")
    inside = Window.partitionBy(*key, "_range").orderBy("_time", "_side", "_state").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ends = dealt.groupBy(*key, "_range").agg(F.max("_state").alias("_last")).select(
        *key, "_range", F.max("_last").over(earlier).alias("_before"))  # a later range has later states
    seen = dealt.withColumn("_here", F.max("_state").over(inside)).filter(F.col("_side") == 1)
    same = [F.col(f"s.{k}").eqNullSafe(F.col(f"e.{k}")) for k in [*key, "_range"]]
    joined = seen.alias("s").join(ends.alias("e"), same, "left")
    found = F.when(F.col("s._time").isNotNull(), F.coalesce("s._here", "e._before"))
    known = joined.select("s._row", F.when(F.forall(F.array(*(F.col(f"s.{k}").isNotNull() for k in key)), lambda k: k), found).alias("_found"))
    return known.select("_row.*", *(F.col("_found")[c].alias(c) for c in columns))
