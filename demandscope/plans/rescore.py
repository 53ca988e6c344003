"""Feature, gate and score jobs over ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from demandscope.config import HUMAN_STATUSES, LIVE_STATUSES, STOREFRONTS, THRESHOLDS as T
from demandscope.functions.text import looks_like_brand
from demandscope.operators import lexicon
from demandscope.operators.features import with_features
from demandscope.operators.scoring import with_score
from demandscope.operators.series import latest, newest_rows
from demandscope.operators.variants import variant_heads

KEY = ["term", "storefront"]


def latest_lists(snapshots: DataFrame) -> DataFrame:
    """The newest list of every (term, storefront)."""
    return latest(snapshots, KEY, "taken_at")


def scored(keyword_lists: DataFrame) -> DataFrame:
    return with_score(with_features(keyword_lists))


def with_review_growth(keyword_lists: DataFrame, deltas: DataFrame) -> DataFrame:
    """Add the leader's weekly review delta and the monthly installs estimated from it (see ``series.review_delta``)."""
    leader = F.try_element_at("apps", F.lit(1))["track_id"]
    growth = deltas.select(F.col("track_id").alias("_leader"), "storefront", F.col("weekly_review_delta").alias(
        "top1_weekly_review_delta"), "est_monthly_installs")
    return keyword_lists.withColumn("_leader", leader).join(growth, ["_leader", "storefront"], "left").drop("_leader")


def rescore(keyword_lists: DataFrame) -> DataFrame:
    """Recompute features and scores; statuses set by people stay.

    Rows carry ``status`` before and ``status_after``; ``append_score`` marks the rows
    that get a new score row (all of them get a new feature row).
    """
    human = F.col("status").isin(*HUMAN_STATUSES)
    return scored(keyword_lists).select(
        "*", F.when(human, F.col("status")).otherwise(F.col("verdict")).alias("status_after"),
        (~human).alias("append_score"))


def status_changes(rescored: DataFrame) -> DataFrame:
    """Counts by status before and after."""
    return rescored.groupBy("status", "status_after").agg(F.count("*").alias("n"))


def promoted(rescored: DataFrame) -> DataFrame:
    """Keywords that enter the queue, best first."""
    return rescored.filter(F.col("append_score") & (F.col("status_after") == "queued")
                           & (F.col("status") != "queued")).select(*KEY, "status", "score").orderBy(
        F.desc("score"), "term", "storefront")


def gate_counts(scores: DataFrame) -> DataFrame:
    """How many lists failed each gate, and how many got each verdict."""
    gates = scores.select(F.explode("gates_failed").alias("name")).withColumn("kind", F.lit("gate"))
    verdicts = scores.select(F.col("verdict").alias("name"), F.lit("verdict").alias("kind"))
    return gates.unionByName(verdicts).groupBy("kind", "name").agg(F.count("*").alias("n"))


def enrich(candidates: DataFrame, snapshots: DataFrame, known: DataFrame) -> DataFrame:
    """Competition side of measured terms (``term, country, popularity``).

    Unknown storefronts and terms that already have a list are counted by ``outcome`` instead
    of scored. The brand outcome rests on name similarity alone.
    """
    stores = F.create_map(*[F.lit(x) for key, lang in STOREFRONTS for x in (key, lang)])
    base = candidates.select("term", F.lower("country").alias("storefront"), "popularity").withColumn(
        "lang", stores[F.col("storefront")])
    had = known.select(*KEY, F.lit(True).alias("had_list")).distinct()
    joined = base.join(had, KEY, "left").join(latest_lists(snapshots).select(*KEY, "apps"), KEY, "left").select(
        *KEY, "popularity", "lang", "had_list", F.coalesce("apps", F.array().cast(snapshots.schema["apps"].dataType)).alias("apps"),
        F.lit(None).cast("int").alias("suggest_pos"))
    outcome = (
        F.when(~stores[F.col("storefront")].isNotNull(), "unknown_store")
        .when(F.col("had_list"), "already_had_list")
        .when(F.size("apps") == 0, "empty_list")
        .when(F.col("top1_name_match") >= T.brand_suspect, "brand")
        .otherwise(F.col("verdict")))
    return scored(joined).withColumn("outcome", outcome)


def tracked_items(keyword_lists: DataFrame, depth: int = 3) -> DataFrame:
    """Distinct ids of the first items of every live keyword's list."""
    ids = F.transform(F.slice("apps", 1, depth), lambda a: a["track_id"])
    return (
        keyword_lists.filter(F.col("status").isin(*LIVE_STATUSES))
        .select("storefront", F.explode(ids).alias("track_id"))
        .filter(F.col("track_id") != 0).distinct()
    )


def heads_of(best: DataFrame) -> DataFrame:
    """The heads (storefront, term) of the spelling groups of placed terms."""
    return variant_heads(best).select("storefront", F.col("head").alias("term")).distinct()


def budgeted_heads(heads: DataFrame, best: DataFrame, max_snapshots: int) -> DataFrame:
    """Heads by best place, cut to a budget per storefront: ``term, storefront, position, kw_type``.

    Brand queries are kept, marked, and not snapshotted.
    """
    placed = heads.join(best, ["storefront", "term"], "left")
    budget = newest_rows(placed, ["storefront"], [F.coalesce("position", F.lit(99)), F.asc("term")], max_snapshots)
    return budget.select("term", "storefront", "position",
                         F.when(looks_like_brand(F.col("term")), "BRAND").alias("kw_type"))


def collection_heads(suggestions: DataFrame, max_snapshots: int) -> DataFrame:
    """Terms to snapshot per storefront: variant heads by best place, cut to a budget."""
    best = lexicon.best_positions(suggestions)
    return budgeted_heads(heads_of(best), best, max_snapshots)
