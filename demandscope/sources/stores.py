"""Stores: logs that only grow, and the keyed tables that follow from them.

Snapshots, features, scores, facts, verdicts and sightings are appended under the name of the batch that brings them.
Writing a batch again replaces it, so a job that is started anew changes nothing. Keyed tables are aggregations over a log;
where one is kept, ``tables.publish`` writes it as a new version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from demandscope.config import HUMAN_STATUSES
from demandscope.operators.series import latest
from demandscope.sources import tables

KEY = ["term", "storefront"]


def append_batch(rows: DataFrame, root: str, log: str, batch: str) -> None:
    """Add a batch to a log, or write it again."""
    rows.write.mode("overwrite").parquet(f"{root}/{log}/batch={batch}")


def read_log(spark: SparkSession, root: str, log: str) -> DataFrame:
    """All batches of a log, with the name of each as ``batch``."""
    return spark.read.option("basePath", f"{root}/{log}").schema(
        spark.read.parquet(f"{root}/{log}").schema).parquet(f"{root}/{log}")


def _listed(snapshots: DataFrame) -> DataFrame:
    """The items of all snapshots, those without an id left out."""
    return snapshots.select("term", "storefront", "taken_at", F.explode("apps").alias("app")).filter(
        F.coalesce(F.col("app.track_id"), F.lit(0)) != 0)


def items_of(snapshots: DataFrame) -> DataFrame:
    """One row per (item, storefront): the newest title, the genre of the first sighting, the last sighting.

    Of snapshots of one time the one with the greater term counts as the newer.
    """
    seen = _listed(snapshots).select(F.col("app.track_id").alias("track_id"), "storefront", F.col("app.title").alias("title"),
                                     F.col("app.primary_genre").alias("primary_genre"), F.col("taken_at").alias("updated_at"), "term")
    return merge_items(seen.limit(0), seen, ["updated_at", "term"]).drop("term")


def merge_items(stored: DataFrame, seen: DataFrame, order: list[str]) -> DataFrame:
    """Item rows onto the stored ones: title and time of the newest, genre of the first."""
    return tables.last_wins(stored, seen, ["track_id", "storefront"], order, first_wins=["primary_genre"])


def metrics_of(snapshots: DataFrame) -> DataFrame:
    """One reading per (item, storefront, day), of the day's last snapshot."""
    seen = _listed(snapshots).select(
        F.col("app.track_id").alias("track_id"), "storefront", F.col("taken_at").cast("date").alias("day"),
        F.col("app.rating").alias("rating"), F.col("app.rating_count").alias("rating_count"), "taken_at", "term")
    return tables.last_wins(seen.limit(0), seen, ["track_id", "storefront", "day"], ["taken_at", "term"]).drop("taken_at", "term")


def merge_keywords(stored: DataFrame, sightings: DataFrame, order: list[str]) -> DataFrame:
    """Keyword sightings onto the stored keywords.

    Rows have ``term, storefront, source, suggest_pos, first_seen, last_seen`` and the columns of ``order``. The source and the
    first sighting stay, the best place is kept, the last sighting moves.
    """
    return tables.last_wins(stored, sightings, KEY, order, first_wins=["source", "first_seen"], smallest=["suggest_pos"])


def store_scores(rescored: DataFrame, root: str, batch: str, at: Column) -> None:
    """A feature row of each keyword, and a score row of those that no person has decided on."""
    append_batch(rescored.select(*KEY, at.alias("computed_at"), "coherence", "stale_share", "top1_reviews", "top1_name_match",
                                 "in_metadata_share"), root, "features", batch)
    append_batch(rescored.filter("append_score").select(
        *KEY, at.alias("scored_at"), "score", "verdict", "gates_failed", "notes"), root, "scores", batch)


def with_status(keywords: DataFrame, scores: DataFrame) -> DataFrame:
    """Keywords with their newest score; its verdict is the status, unless a person set one."""
    newest = latest(scores.select(*KEY, "scored_at", "score", "verdict"), KEY, "scored_at", "score")
    human = F.col("status").isin(*HUMAN_STATUSES)
    return keywords.join(newest, KEY, "left").withColumn(
        "status", F.when(human, F.col("status")).otherwise(F.coalesce("verdict", "status"))).drop("verdict", "scored_at")


def newest_verdicts(log: DataFrame) -> DataFrame:
    """The verdict of each keyword that was stored last (``judged_at``)."""
    return latest(log, KEY, "judged_at", "category", "note")


def load_facts(keywords: DataFrame, facts: DataFrame, min_popularity: float) -> DataFrame:
    """Keywords that measured facts confirm: new and queued ones become validated."""
    loaded = facts.filter(F.col("popularity") >= min_popularity).select(*KEY).distinct().withColumn("_loaded", F.lit(True))
    moved = F.col("_loaded") & F.col("status").isin("queued", "new")
    return keywords.join(loaded, KEY, "left").withColumn(
        "status", F.when(moved, "in_astro").otherwise(F.col("status"))).drop("_loaded")
