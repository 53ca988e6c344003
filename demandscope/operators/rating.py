"""Star rating: five independent checks, counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from demandscope import labels
from demandscope.config import THRESHOLDS as T


def _half_even(value: Column) -> Column:
    return F.bround(value, 0).cast("int").cast("string")


def signals() -> Column:
    """Array of (key, met, evidence) from a feature row with ``cluster_size``."""
    pos, meta = F.col("suggest_pos"), F.col("in_metadata_share")
    stale, relevance = F.col("stale_share"), F.col("top1_relevance")
    reviews = F.coalesce(F.col("top1_reviews"), F.lit(0))
    coherence, no_local = F.col("coherence"), F.col("no_localization_share")
    false = F.lit(False)

    demand = F.coalesce(pos <= 3, false) | F.coalesce(meta >= 0.5, false)
    demand_text = (
        F.when(F.coalesce(pos, F.lit(0)) != 0, F.concat(F.lit(labels.TOLD_PLACE), pos.cast("string")))
        .when(meta.isNotNull(), F.concat(F.lit(labels.TOLD_METADATA), _half_even(meta * 10), F.lit("/10")))
        .otherwise(labels.TOLD_NOTHING))
    vague = F.coalesce(relevance < 0.6, false)
    room = F.coalesce(stale >= 0.4, false) | vague
    room_text = F.concat(
        _half_even(F.coalesce(stale, F.lit(0.0)) * 10), F.lit(labels.TOLD_STALE),
        F.when(vague, labels.TOLD_NO_LEADER).otherwise(""))
    market_text = F.when(
        reviews >= 1000,
        F.concat(F.floor(reviews / 1000).cast("string"), F.lit(labels.TOLD_THOUSANDS))
    ).otherwise(F.concat(reviews.cast("string"), F.lit(labels.TOLD_REVIEWS)))
    clean = F.coalesce(coherence >= 0.5, false) | F.coalesce(no_local >= 0.6, false)
    clean_text = F.coalesce(
        F.concat(F.lit(labels.TOLD_COHERENCE), _half_even(coherence * 100), F.lit("%")), F.lit(labels.TOLD_NOTHING))
    rows = [
        (labels.SIGNAL_DEMAND, demand, demand_text),
        (labels.SIGNAL_ROOM, room, room_text),
        (labels.SIGNAL_MARKET, reviews.between(3_000, 300_000), market_text),
        (labels.SIGNAL_CLUSTER, F.col("cluster_size") >= 2,
         F.concat(F.col("cluster_size").cast("string"), F.lit(labels.TOLD_QUERIES))),
        (labels.SIGNAL_CLEAN, clean, clean_text),
    ]
    return F.array(*[
        F.struct(F.lit(k).alias("key"), met.alias("met"), text.alias("evidence"))
        for k, met, text in rows])


def with_rating(rows: DataFrame) -> DataFrame:
    """Add ``stars, flags, reason, missing`` to feature rows with ``cluster_size``."""
    met = F.filter(F.col("signals"), lambda s: s["met"])
    missing = F.transform(F.filter(F.col("signals"), lambda s: ~s["met"]), lambda s: s["key"])
    told = F.array_join(F.transform(met, lambda s: F.concat(s["key"], F.lit(": "), s["evidence"])), ", ")
    flags = F.array_compact(F.array(
        F.when(F.coalesce(F.col("top1_name_match"), F.lit(0.0)) >= T.brand_suspect, F.lit(labels.FLAG_BRAND)),
        F.when(F.coalesce(F.col("stale_share"), F.lit(0.0)) >= 0.5, F.lit(labels.FLAG_STALE)),
    ))
    return (
        rows.withColumn("signals", signals())
        .withColumns({
            "stars": F.greatest(F.lit(1), F.least(F.lit(5), F.size(met))),
            "flags": flags,
            "missing": F.array_join(missing, ", "),
            "reason": F.concat(
                F.when(told == "", labels.REASON_NONE).otherwise(told),
                F.when(F.size(missing) > 0, F.concat(
                    F.lit(labels.REASON_MISSING), F.array_join(missing, ", "))).otherwise("")),
        })
        .drop("signals")
    )
