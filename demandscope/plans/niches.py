"""From the stored queue to niches: load, cluster, merge, hide, route, rate, order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from demandscope import labels
from demandscope.config import THRESHOLDS as T
from demandscope.functions.scalar import round_half_up, score_band, short_count, tenths
from demandscope.functions.similarity import brand_signal
from demandscope.functions.text import eligible_head, words
from demandscope.operators import graph, lexicon
from demandscope.operators.rating import with_rating
from demandscope.operators.replies import with_defaults
from demandscope.operators.scoring import factor_map, headline_reason
from demandscope.operators.series import chosen_trend, newest_rows
from demandscope.session import stage

KEY = ["term", "storefront"]


def queue(scored_keywords: DataFrame, limit: int | None = None) -> DataFrame:
    """Queued keywords with their newest score, features and list; with a limit the best ones, best first."""
    queued = scored_keywords.filter(F.col("status") == "queued")
    return queued if limit is None else queued.orderBy(F.desc("score"), "term", "storefront").limit(limit)


def queue_json(queued: DataFrame) -> DataFrame:
    """The machine-readable queue."""
    return queued.select("term", "storefront", "score", "notes", factor_map().alias("factors"))


def niche_clusters(queued: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row per niche head, and every niche's variants in long form.

    Clustering runs within a storefront; afterwards one head term keeps one row.
    """
    queued = stage(queued, "queue")
    members = stage(graph.cluster_members(queued.select(*KEY, "apps")), "members")
    heads = graph.niche_heads(members, queued.select("storefront", "term", "score"))
    merged = stage(graph.merge_storefronts(heads), "merged")
    niches = merged.join(queued.drop("score"), KEY)
    shown = merged.select(
        F.col("term").alias("head"), "storefront",
        F.col("variants_from"), F.col("variants_cluster"))
    variants = (
        shown.join(members.select(F.col("storefront").alias("variants_from"),
                                  F.col("cluster_id").alias("variants_cluster"), "term"),
                   ["variants_from", "variants_cluster"])
        .filter(F.col("term") != F.col("head"))
        .join(queued.select(F.col("storefront").alias("variants_from"), "term", "score"), ["variants_from", "term"])
        .select("head", "storefront", F.col("term").alias("variant"), "score")
    )
    return niches, variants


def with_verdicts(niches: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Attach stored model verdicts and derive brand, junk and route.

    A brand is one by name similarity or by verdict; a brand that is also junk is a brand.
    """
    known = with_defaults(verdicts).select(*KEY, "category", "niche_name")
    by_name = F.coalesce(F.col("top1_name_match"), F.lit(0.0)) >= T.brand_suspect
    by_model = F.coalesce(F.col("category") == "brand", F.lit(False))
    junk = F.coalesce(F.col("category").isin("too_broad", "junk"), F.lit(False))
    return niches.join(known, KEY, "left").withColumns({
        "is_brand": by_name | by_model,
        "is_junk": junk,
        "is_broad": ~eligible_head(F.col("term")),
        "route": F.when(by_name | by_model, "brand").when(junk, "junk").otherwise("niche"),
        "display_name": F.coalesce(F.nullif("niche_name", F.lit("")), F.col("term")),
    })


def niche_table(niches: DataFrame, verdicts: DataFrame, hidden: DataFrame, since: Column) -> DataFrame:
    """Every niche not hidden by a decision, as one row with its evidence."""
    leader = F.try_element_at("apps", F.lit(1))
    rated = with_rating(with_verdicts(niches.join(hidden.select("term"), "term", "left_anti"), verdicts))
    fresh = F.coalesce(F.col("first_seen") > since, F.lit(False))
    return rated.select(
        *KEY, "route", "display_name", "stars", "score", score_band(F.col("score")).alias("band"),
        "cluster_size", F.array_join("markets", ", ").alias("markets"), fresh.alias("is_new"), "is_broad",
        "suggest_pos", tenths(F.col("in_metadata_share")).alias("in_metadata"),
        tenths(F.col("stale_share")).alias("stale"),
        short_count(F.coalesce(leader["rating_count"], F.lit(0))).alias("leader_reviews"),
        leader["title"].alias("leader_title"), leader["rating"].alias("leader_rating"),
        leader["track_id"].alias("leader_id"),
        F.array_join("flags", " ").alias("flags"), "missing", "reason", headline_reason().alias("why"))


def ordered_niches(table: DataFrame, limit: int) -> DataFrame:
    """New ones first, then stars, then score."""
    return table.filter(F.col("route") == "niche").orderBy(
        F.desc("is_new"), F.desc("stars"), F.desc("score"), "term", "storefront").limit(limit)


def brand_leads(table: DataFrame, limit: int = 8) -> DataFrame:
    return table.filter(F.col("route") == "brand").orderBy(F.desc("score"), "term", "storefront").limit(limit)


def weekly_niches(table: DataFrame, limit: int) -> DataFrame:
    """The weekly report's niches: everything that is not a brand; junk stays in."""
    return table.filter(F.col("route") != "brand").orderBy(
        F.desc("stars"), F.desc("score"), "term", "storefront").limit(limit)


def with_trend(table: DataFrame, demand: DataFrame, traffic: DataFrame) -> DataFrame:
    """The niche table with ``trend``: the arrow of the demand for its term, else that of its leader's traffic."""
    return chosen_trend(table, demand, traffic)


def alert_lines(alerts: DataFrame) -> DataFrame:
    """Decay alerts as lines of the report, the largest fall first."""
    one = lambda c: round_half_up(F.col(c), 1).cast("string")
    return alerts.select(
        "track_id", "storefront", (F.col("rating_first") - F.col("rating_last")).alias("fall"), F.concat(
            "title", F.lit(" ("), F.upper("storefront"), F.lit(")"), F.lit(labels.ALERT_RATING), one("rating_first"),
            F.lit(" → "), one("rating_last"), F.lit(labels.ALERT_CHANCE)).alias("line"))


def weekly_report(table: DataFrame, alerts: DataFrame, n_niches: int = 30, n_alerts: int = 5) -> DataFrame:
    """The weekly report as rows of (section, place, line): its niches, then the alerts."""
    niches = newest_rows(table.filter(F.col("route") != "brand").withColumn("_all", F.lit(1)), ["_all"], [
        F.desc("stars"), F.desc("score"), F.asc("term"), F.asc("storefront")], n_niches).select(
        F.lit("niche").alias("section"), F.col("_place").alias("place"), F.concat_ws(
            " | ", F.repeat(F.lit("★"), F.col("stars").cast("int")), "display_name", F.upper("storefront"), F.col("trend")).alias("line"))
    lines = newest_rows(alert_lines(alerts).withColumn("_all", F.lit(1)), ["_all"], [
        F.desc(round_half_up(F.col("fall"), 6)), F.asc("track_id"), F.asc("storefront")], n_alerts)
    return niches.unionByName(lines.select(F.lit("alert").alias("section"), F.col("_place").alias("place"), "line"))


def route_counts(table: DataFrame) -> DataFrame:
    return table.groupBy("route").agg(F.count("*").alias("n"), F.count_if("is_new").alias("n_new"))


def idea_list(niches: DataFrame, verdicts: DataFrame, hidden: DataFrame, popularity: DataFrame,
              measured_only: bool = False, only_source: str | None = None) -> DataFrame:
    """Ideas with measured popularity and provenance; likely brands in a section of their own."""
    leader = F.try_element_at("apps", F.lit(1))
    visible = with_verdicts(niches.join(hidden.select("term"), "term", "left_anti"), verdicts).filter(~F.col("is_junk"))
    sized = visible.join(popularity.select("term", F.col("country").alias("storefront"), "popularity"), KEY, "left")
    if measured_only:
        sized = sized.filter(F.col("popularity").isNotNull())
    if only_source:
        sized = sized.filter(F.col("source") == only_source)
    signal = brand_signal(F.col("term"), leader["title"], leader["seller"])
    rated = with_rating(sized.withColumn("_signal", signal))
    brand = (F.col("_signal") != "") | F.col("is_brand")
    return rated.select(
        F.when(brand, "brand").otherwise("idea").alias("section"), *KEY, "popularity", "source",
        "stars", "score", "cluster_size",
        F.when(brand, F.coalesce(F.nullif("_signal", F.lit("")), F.lit(labels.BRAND_BY_TITLE))).alias("brand_why"),
        leader["title"].alias("leader_title"))


def ordered_ideas(ideas: DataFrame, limit: int = 40) -> DataFrame:
    """Measured ones first by size, then stars."""
    return ideas.filter(F.col("section") == "idea").orderBy(
        F.desc_nulls_last("popularity"), F.desc("stars"), "term", "storefront").limit(limit)


def seeds(niches: DataFrame, verdicts: DataFrame, limit: int = 5) -> DataFrame:
    """Best usable niches, one per term, to ask a generator for neighbours of."""
    usable = with_rating(with_verdicts(niches, verdicts).filter(F.col("route") == "niche"))
    return usable.select(*KEY, "stars", "score", "apps").orderBy(
        F.desc("stars"), F.desc("score"), "term", "storefront").limit(limit)


def unjudged(niches: DataFrame, verdicts: DataFrame, limit: int) -> DataFrame:
    """Niches without a verdict, best score first."""
    return niches.join(verdicts.select(*KEY), KEY, "left_anti").orderBy(
        F.desc("score"), "term", "storefront").limit(limit)


def export_rows(niches: DataFrame, variants: DataFrame) -> DataFrame:
    """The eleven export columns per niche; ``варианты`` lists all variants, best first."""
    leader = F.try_element_at("apps", F.lit(1))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("low"), "variant")))
    listed = variants.groupBy(F.col("head").alias("term"), "storefront").agg(
        F.array_join(F.transform(ranked, lambda r: r["variant"]), ", ").alias("listed"))
    stale = F.concat((F.col("stale_share") * 10).cast("int").cast("string"), F.lit("/10"))
    return with_rating(niches).join(listed, KEY, "left").select(
        F.col("stars").alias("звёзды"), F.upper("storefront").alias("магазин"), F.col("term").alias("ниша"),
        F.col("cluster_size").alias("запросов"), "score", leader["title"].alias("лидер"),
        leader["rating"].alias("рейтинг"), leader["rating_count"].alias("отзывы"), stale.alias("устарело"),
        F.array_join("flags", " ").alias("флаги"), F.coalesce("listed", F.lit("")).alias("варианты"))


def dossiers(heads: DataFrame, suggestions: DataFrame, n_suggestions: int = 25, n_tokens: int = 20,
             shared_by: Sequence[str] | None = None) -> DataFrame:
    """Evidence per head term: result lines, related suggestions, common metadata tokens.

    ``shared_by`` names the storefronts that have all suggestions in common; they are searched once for all of these.
    """
    heads = stage(heads, "dossier-heads")
    asking = heads
    if shared_by is not None:
        asking, suggestions = (rows.withColumn("storefront", F.lit("")) for rows in (
            heads.filter(F.col("storefront").isin(*shared_by)), suggestions))
    line = lambda a, i: F.concat_ws(
        " | ", (i + 1).cast("string"), a["title"].substr(1, 48), F.coalesce(a["rating"], F.lit(0.0)).cast("string"),
        F.coalesce(a["rating_count"], F.lit(0)).cast("string"),
        F.coalesce(F.floor(a["days_since_update"] / 30).cast("string"), F.lit("n/a")))
    related = lexicon.related_suggestions(asking, suggestions).filter(F.col("place") <= n_suggestions).groupBy(
        "storefront", "token").agg(F.array_sort(F.collect_list(F.struct("place", "suggestion"))).alias("related"))
    if shared_by is not None:
        related = related.withColumn("storefront", F.explode(words(shared_by)))
    common = newest_rows(lexicon.metadata_tokens(heads), KEY, [F.desc("n"), F.asc("token")], n_tokens).groupBy(*KEY).agg(
        F.array_sort(F.collect_list(F.struct("_place", "token"))).alias("common"))
    names = lambda c, f: F.coalesce(F.array_join(F.transform(c, lambda r: r[f]), ", "), F.lit(""))
    return (
        heads.withColumn("token", F.lower(F.split_part("term", F.lit(" "), F.lit(1))))
        .join(related, ["storefront", "token"], "left").join(common, KEY, "left")
        .select(*KEY, F.array_join(F.transform(F.slice("apps", 1, 10), line), "\n").alias("result_lines"),
                names("related", "suggestion").alias("suggestions"), names("common", "token").alias("metadata_tokens"))
    )


def fact_sheet(members: DataFrame, facts: DataFrame, keyword_lists: DataFrame) -> DataFrame:
    """Per cluster term: type, measured popularity and difficulty, and the leader's title."""
    newest = facts.groupBy(*KEY).agg(F.max_by(F.struct("popularity", "difficulty"), "loaded_at").alias("f"))
    leader = keyword_lists.select(*KEY, F.try_element_at("apps", F.lit(1))["title"].alias("top1"))
    return members.join(newest, KEY).join(leader, KEY, "left").select(
        "storefront", "cluster_id", "term", F.when(F.col("term") == F.col("cluster_id"), "HEAD").otherwise("BODY").alias("kw_type"),
        F.col("f.popularity").alias("popularity"), F.col("f.difficulty").alias("difficulty"), "top1")
