"""Features of a ranked result list, computed inside the row.

A list holds at most ten items of interest, so everything is an array expression: no
explode, no shuffle. ``lists`` needs ``term, storefront, lang, apps, suggest_pos``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from demandscope.config import LIST_DEPTH, THRESHOLDS as T
from demandscope.functions.similarity import name_match_of, name_parts, token_set_ratio_of, token_sets
from demandscope.functions.text import content_tokens, let, singularize, tokens


def top(apps: Column, depth: int) -> Column:
    return F.slice(apps, 1, depth)


def app_text(app: Column) -> Column:
    return F.lower(F.concat(F.coalesce(app["title"], F.lit("")), F.lit(" "),
                            F.coalesce(app["subtitle"], F.lit(""))))


def fingerprint(apps: Column, depth: int = LIST_DEPTH) -> Column:
    """Distinct ids of the first items; null and zero ids do not count."""
    ids = F.transform(top(apps, depth), lambda a: a["track_id"])
    return F.array_distinct(F.filter(ids, lambda i: i.isNotNull() & (i != 0)))


def leader_id(apps: Column) -> Column:
    return F.try_element_at(apps, F.lit(1))["track_id"]


def share(items: Column, predicate) -> Column:
    """Share of items meeting a predicate; 0 for an empty list."""
    return F.size(F.filter(items, predicate)) / F.greatest(F.size(items), F.lit(1))


def median_of(values: Column) -> Column:
    """Median of a short array without nulls; null when it is empty."""
    def middle(ordered: Column) -> Column:
        half = (F.size(ordered) / 2).cast("int")
        upper = F.try_element_at(ordered, half + 1)
        lower = F.try_element_at(ordered, F.greatest(half, F.lit(1)))
        return F.when(F.size(ordered) % 2 == 1, upper).otherwise((lower + upper) / 2)

    return let(F.sort_array(values), middle)


def coherence(term: Column, texts: Column) -> Column:
    """Share of items whose tokens hold all but one of the query's content tokens, in the singular.

    At least one token is always required, so a two-token query needs one. A singular begins with the letter of
    its plural, so only tokens that begin like one of the query are looked at.
    """
    initial = lambda t: F.substring(t, 1, 1)

    def covered(query: Column, initials: Column) -> Column:
        needed = F.greatest(F.size(query) - 1, F.lit(1))
        return share(texts, lambda text: F.size(F.array_intersect(query, F.transform(F.filter(
            text, lambda t: F.array_contains(initials, initial(t))), singularize))) >= needed)

    return let(F.array_distinct(content_tokens(term)), lambda query: let(
        F.transform(query, initial), lambda initials: covered(query, initials)))


def in_metadata_share(term: Column, texts: Column) -> Column:
    return let(tokens(term), lambda query: share(texts, lambda text: F.arrays_overlap(query, text)))


def is_game(app: Column) -> Column:
    return (F.coalesce(app["primary_genre"], F.lit("")) == "Games") | F.coalesce(
        F.array_contains(app["genres"], "Games"), F.lit(False))


def with_features(lists: DataFrame) -> DataFrame:
    """Add the feature columns of every (term, storefront) list."""
    ten = top(F.col("apps"), 10)
    five = top(F.col("apps"), 5)
    three = top(F.col("apps"), 3)
    first = F.try_element_at(F.col("apps"), F.lit(1))
    term = F.col("term")

    known_ratings = F.filter(F.transform(three, lambda a: a["rating"]), lambda r: r.isNotNull())
    known_reviews = F.filter(
        F.transform(three, lambda a: a["rating_count"].cast("double")), lambda r: r.isNotNull())
    known_ages = F.filter(F.transform(five, lambda a: a["age_days"]), lambda d: d.isNotNull())
    leader_text = F.when(F.size("apps") > 0, app_text(first)).otherwise("")

    # what several expressions need has a projection of its own, so that it is worked out once
    split = lists.withColumns({
        "_texts": F.transform(ten, lambda a: tokens(app_text(a))),
        "_name": name_parts(term, first["title"]), "_sets": token_sets(term, leader_text)})
    return split.select(
        *[F.col(c) for c in lists.columns],
        median_of(known_ratings).alias("top3_rating_median"),
        F.coalesce(median_of(known_reviews), F.lit(0)).cast("bigint").alias("top3_reviews_median"),
        F.coalesce(first["rating_count"], F.lit(0)).cast("bigint").alias("top1_reviews"),
        share(ten, lambda a: F.coalesce(a["days_since_update"] > T.stale_days, F.lit(False)))
        .alias("stale_share"),
        share(ten, lambda a: F.coalesce(a["rating"], F.lit(0.0)) < T.weak_rating).alias("weak_share"),
        share(ten, lambda a: F.coalesce(a["rating_count"], F.lit(0)) < T.thin_reviews)
        .alias("thin_share"),
        F.array_min(known_ages).alias("youngest_top5_age_days"),
        share(five, lambda a: ~F.coalesce(F.exists(
            a["languages"], lambda x: F.lower(x) == F.lower(F.col("lang"))), F.lit(False)))
        .alias("no_localization_share"),
        share(ten, is_game).alias("games_share"),
        first["seller"].alias("top1_seller"),
        F.when(F.size("apps") > 0, name_match_of(F.col("_name"))).otherwise(0.0)
        .alias("top1_name_match"),
        F.size(F.filter(ten, lambda a: a["is_monetized"])).alias("monetized_count"),
        F.size(F.filter(ten, lambda a: a["is_paid"])).alias("paid_count"),
        coherence(term, F.col("_texts")).alias("coherence"),
        F.when(F.size("apps") > 0, token_set_ratio_of(F.col("_sets")) / 100).otherwise(0.0)
        .alias("top1_relevance"),
        in_metadata_share(term, F.col("_texts")).alias("in_metadata_share"),
    )
