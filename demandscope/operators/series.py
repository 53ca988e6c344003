"""Trends from stored history: daily metrics, suggestion places, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from demandscope import labels
from demandscope.functions.scalar import direction, install_estimate, round_half_up, signed_percent

ITEM = ["track_id", "storefront"]


def newest_rows(rows: DataFrame, key: list[str], order: list[Column], n: int) -> DataFrame:
    """The newest ``n`` rows per key.

    The filter on the row number lets Spark cut each key to ``n`` rows before the
    shuffle, so a key that owns a third of the log costs its task no more than others.
    """
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("_place", place).filter(F.col("_place") <= n)


def latest(rows: DataFrame, key: list[str], stamp: str, *ties: str) -> DataFrame:
    """Newest row per key, by partial aggregation."""
    payload = [c for c in rows.columns if c not in key]
    order = F.struct(F.col(stamp), *[F.col(t) for t in ties]) if ties else F.col(stamp)
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*payload), order).alias("_row"))
    return best.select(*key, *[F.col("_row")[c].alias(c) for c in payload])


def review_delta(metrics: DataFrame, days: int = 7, depth: int = 30) -> DataFrame:
    """Review gain per ``days``, from the newest and oldest of the last ``depth`` readings."""
    ends = newest_rows(metrics, ITEM, [F.desc("day")], depth).groupBy(*ITEM).agg(
        F.count("*").alias("readings"),
        F.datediff(F.max("day"), F.min("day")).alias("span"),
        (F.coalesce(F.max_by("rating_count", "day"), F.lit(0))
         - F.coalesce(F.min_by("rating_count", "day"), F.lit(0))).alias("gain"))
    known = (F.col("readings") >= 2) & (F.col("span") >= 2)
    weekly = F.when(known, (F.col("gain") / F.col("span") * days).cast("bigint"))
    return ends.select(*ITEM, weekly.alias("weekly_review_delta"),
                       install_estimate(weekly).alias("est_monthly_installs"))


def traffic_trend(metrics: DataFrame, window: int = 7, depth: int = 40) -> DataFrame:
    """Review velocity in the newest window against the one before it."""
    newest = F.max("day").over(Window.partitionBy(*ITEM))
    rows = newest_rows(metrics, ITEM, [F.desc("day")], depth).withColumn("_newest", newest)
    age = F.datediff("_newest", "day")
    recent, prior = age < window, age.between(window, window * 2)
    count = F.coalesce("rating_count", F.lit(0))

    def part(mask: Column, name: str) -> list[Column]:
        day = F.when(mask, F.col("day"))
        return [
            F.count(day).alias(f"n_{name}"), F.datediff(F.max(day), F.min(day)).alias(f"span_{name}"),
            (F.max_by(count, day) - F.min_by(count, day)).alias(f"gain_{name}")]

    ends = rows.groupBy(*ITEM).agg(F.count("*").alias("n"), *part(recent, "new"), *part(prior, "old"))
    known = ((F.col("n") >= 4) & (F.col("n_new") >= 2) & (F.col("n_old") >= 2)
             & (F.col("span_new") > 0) & (F.col("span_old") > 0))
    new, old = F.col("gain_new") / F.col("span_new"), F.col("gain_old") / F.col("span_old")
    return ends.select(
        *ITEM, F.when(known, new).alias("velocity_new"), F.when(known, old).alias("velocity_old"),
    ).select(
        *ITEM,
        F.when(F.col("velocity_new").isNull(), labels.NONE)
        .otherwise(direction(F.col("velocity_old"), F.col("velocity_new"))).alias("arrow"),
        F.when(F.col("velocity_old") > 0, signed_percent(
            (F.col("velocity_new") - F.col("velocity_old")) / F.col("velocity_old") * 100)).alias("label"),
        round_half_up(F.col("velocity_old"), 3).alias("velocity_old"),
        round_half_up(F.col("velocity_new"), 3).alias("velocity_new"))


def demand_trend(suggestions: DataFrame, depth: int = 20) -> DataFrame:
    """Move of a term's autocomplete place; a smaller place is better."""
    key = ["term", "storefront"]
    rows = newest_rows(suggestions, key, [F.desc("seen_at"), F.asc("position")], depth)
    newest, oldest = F.min("_place"), F.max("_place")
    ends = rows.groupBy(*key).agg(
        F.count("*").alias("n"),
        F.min_by("position", "_place").alias("new_position"),
        F.max_by("position", "_place").alias("old_position"),
        F.max("seen_at").alias("_new_at"), F.min("seen_at").alias("_old_at"))
    known = (F.col("n") >= 2) & (F.col("_new_at") != F.col("_old_at"))
    new, old = F.col("new_position"), F.col("old_position")
    arrow = F.when(~known, labels.NONE).when(new == old, labels.FLAT).when(
        new < old, labels.UP).otherwise(labels.DOWN)
    return ends.select(*key, arrow.alias("arrow"), "old_position", "new_position",
                       F.when(known & (new != old), F.concat(F.lit("#"), new.cast("string"))).alias("label"))


def score_trend(scores: DataFrame, depth: int = 30, dead_band: float = 3.0) -> DataFrame:
    """Move of a keyword's own score over its last ``depth`` scorings."""
    key = ["term", "storefront"]
    rows = newest_rows(scores, key, [F.desc("scored_at"), F.desc("score")], depth)
    ends = rows.groupBy(*key).agg(
        F.count("*").alias("n"), F.min_by("score", "_place").alias("new_score"),
        F.max_by("score", "_place").alias("old_score"))
    moved = F.col("new_score") - F.col("old_score")
    arrow = (
        F.when(F.col("n") < 2, labels.NONE).when(F.abs(moved) < dead_band, labels.FLAT)
        .when(moved > 0, labels.UP).otherwise(labels.DOWN))
    return ends.select(*key, arrow.alias("arrow"), "old_score", "new_score")


def decay_alerts(metrics: DataFrame, apps: DataFrame, as_of: Column, days: int = 30,
                 min_readings: int = 3, min_drop: float = 0.3) -> DataFrame:
    """Items whose rating fell by ``min_drop`` between the ends of the last ``days`` days."""
    ends = (
        metrics.filter(F.col("day") >= F.date_sub(as_of, days)).groupBy(*ITEM)
        .agg(F.count("*").alias("readings"), F.min_by("rating", "day").alias("rating_first"),
             F.max_by("rating", "day").alias("rating_last"))
        .filter((F.col("readings") >= min_readings) & (F.col("rating_first") != 0)
                & (F.col("rating_last") != 0)
                & (F.col("rating_first") - F.col("rating_last") >= min_drop))
    )
    return ends.join(apps.select(*ITEM, "title"), ITEM).select(
        *ITEM, "title", "readings", "rating_first", "rating_last")


def history_length(rows: DataFrame, stamp: str, as_of: Column) -> DataFrame:
    """Days and whole weeks since the first record; zero for an empty table."""
    first = F.min(F.col(stamp).cast("date"))
    days = F.greatest(F.coalesce(F.datediff(F.first(as_of), first), F.lit(0)), F.lit(0))
    return rows.agg(days.alias("history_days"), F.floor(days / 7).cast("int").alias("history_weeks"))


def chosen_trend(keys: DataFrame, demand: DataFrame, traffic: DataFrame) -> DataFrame:
    """The demand arrow when it is known, else the leader's traffic arrow, else none.

    ``keys`` holds ``term, storefront, leader_id``.
    """
    d = demand.select("term", "storefront", F.col("arrow").alias("_demand"))
    t = traffic.select(F.col("track_id").alias("leader_id"), "storefront", F.col("arrow").alias("_traffic"))
    known = lambda c: F.when(F.col(c) != labels.NONE, F.col(c))
    return (
        keys.join(d, ["term", "storefront"], "left").join(t, ["leader_id", "storefront"], "left")
        .withColumn("trend", F.coalesce(known("_demand"), known("_traffic"), F.lit(labels.NONE)))
        .drop("_demand", "_traffic")
    )


def leader_series(lists: DataFrame, metrics: DataFrame) -> DataFrame:
    """The daily series of each list's first item."""
    leaders = lists.select("term", "storefront", F.try_element_at("apps", F.lit(1))["track_id"].alias("track_id"))
    return leaders.join(metrics, ITEM)
