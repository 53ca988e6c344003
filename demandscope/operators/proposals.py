"""Proposed queries: exclusion, demand check, outcome bookkeeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from demandscope.functions.text import tokens
from demandscope.operators.containment import first_containing
from demandscope.operators.series import newest_rows


def exclusions(keywords: DataFrame, proposals: DataFrame) -> DataFrame:
    """Known terms and every query ever proposed, rejected ones included."""
    return keywords.select(F.col("term").alias("query"), "storefront").unionByName(
        proposals.select("query", "storefront")).distinct()


def without_known(proposed: DataFrame, keywords: DataFrame, proposals: DataFrame) -> DataFrame:
    return proposed.join(exclusions(keywords, proposals), ["query", "storefront"], "left_anti")


def with_outcomes(proposals: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Overlay the newest outcome (``query, storefront, status, checked_at, note``)."""
    key = ["query", "storefront"]
    newest = outcomes.groupBy(*key).agg(
        F.max(F.struct("checked_at", "status", "note")).alias("_o"))
    joined = proposals.drop("checked_at", "note").join(newest, key, "left")
    return joined.select(
        *[c for c in proposals.columns if c not in ("status", "checked_at", "note")],
        F.coalesce("_o.status", "status").alias("status"),
        F.col("_o.checked_at").alias("checked_at"), F.col("_o.note").alias("note"))


def hit_rate(proposals: DataFrame) -> DataFrame:
    """Count and share per status."""
    counts = proposals.groupBy("status").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))  # a row per status
    return counts.select("status", "n", (F.col("n") / total).alias("share"))


def demand_check(proposals: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Place of the first suggestion that equals or extends the query, per probed prefix.

    ``suggestions`` were landed for the prefix equal to the query, so this is an equi-join.
    Suggestions are first cut to the earliest fitting one per prefix.
    """
    per_prefix = suggestions.groupBy("storefront", F.col("prefix").alias("query")).agg(
        F.count("*").alias("n_suggestions"),
        F.min(F.when(F.col("term").startswith(F.col("prefix")), F.col("position"))).alias("demand_position"))
    return proposals.join(per_prefix, ["query", "storefront"], "left")


def verification_status(has_list: Column, gates: Column, verdict: Column) -> Column:
    """Outcome of a proposal from its demand place, its list and its score."""
    return (
        F.when(F.col("demand_position").isNull(), "no_demand")
        .when(~has_list, "incoherent")
        .when(verdict == "rejected", "gated")
        .otherwise("accepted")
    )


def related_exclusions(seeds: DataFrame, excluded: DataFrame, limit: int = 40) -> DataFrame:
    """Per seed, the first excluded queries (alphabetically) that contain one of its words."""
    key = ["term", "storefront"]
    wanted = seeds.select(*key, F.explode(F.array_distinct(tokens(F.col("term")))).alias("token"))
    known = excluded.select("storefront", "query").distinct()
    per_word = wanted.join(first_containing(wanted, known, "query", ["query"], limit), ["storefront", "token"]).select(
        *key, "query").distinct()  # at most ``limit`` for each word of the seed
    return newest_rows(per_word, key, [F.asc("query")], limit).select(
        *key, "query", F.col("_place").alias("place"))


def generator_input(seeds: DataFrame, related: DataFrame) -> DataFrame:
    """Text handed to a query generator: the niche, its first titles, what to leave out."""
    key = ["term", "storefront"]
    avoid = related.groupBy(*key).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("place", "query"))), lambda r: r["query"]).alias("avoid"))
    titles = F.transform(F.slice("apps", 1, 5), lambda a: F.concat(
        F.lit('  - "'), F.translate(a["title"].substr(1, 60), "\n", " "), F.lit('"')))
    text = F.array_join(F.array_compact(F.flatten(F.array(
        F.array(F.concat(F.lit('Known niche: "'), F.col("term"), F.lit('"')),
                F.concat(F.lit("Storefront: "), F.upper("storefront"))),
        titles,
        F.array(F.when(F.size("avoid") > 0, F.concat(
            F.lit("Already known, do not repeat: "), F.array_join("avoid", ", "))))))), "\n")
    return seeds.join(avoid, key, "left").select(*key, text.alias("model_input"))
