"""A collection pass: from the suggestions of a round to scored heads and counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from demandscope.operators import lexicon
from demandscope.plans import rescore as RS
from demandscope.session import Staged, stage

KEY = ["term", "storefront"]


def snapshot_heads(budget: DataFrame, lists: DataFrame) -> DataFrame:
    """Scores of the heads that are not brands and whose list is not empty."""
    asked = budget.filter(F.col("kw_type").isNull()).select(*KEY, F.col("position").alias("suggest_pos"))
    return RS.scored(asked.join(lists, KEY).filter(F.size("apps") > 0))


def collection_pass(suggestions: DataFrame, ledger: DataFrame, lists_of, max_snapshots: int = 60) -> tuple[DataFrame, DataFrame]:
    """(scored heads, counters) of one pass over all storefronts.

    Suggestions become terms with their best place, spelling variants one head each; the first ``max_snapshots`` heads of a
    storefront are looked up, brands aside. ``lists_of`` takes the heads and gives ``term, storefront, lang, apps`` for those
    that have a list. ``ledger`` (prefix, storefront) holds what was probed before; objects found next to the roots that it
    lacks are the frontier of the next pass. Counters are (storefront, counter, n): suggestions, after_dedup, new_verbs,
    new_probes, brand, empty_serp, each verdict, and gate_<name> for each gate; one that did not occur has no row.
    """
    best = stage(lexicon.best_positions(suggestions), "best")
    heads = stage(RS.heads_of(best), "collected-heads")
    budget = stage(RS.budgeted_heads(heads, best, max_snapshots), "budget")
    lists = lists_of(budget.filter(F.col("kw_type").isNull()))
    scored = Staged(snapshot_heads(budget, lists), "collected", n=F.count(F.lit(1))).df
    verbs = lexicon.discover_verbs(best, min_distinct=2)
    objects = lexicon.harvest_objects(suggestions).groupBy("storefront", "token").agg(F.sum("n").alias("n"))
    probes = lexicon.open_probes(objects, ledger)
    asked = budget.filter(F.col("kw_type").isNull())

    def count(rows: DataFrame, name) -> DataFrame:
        return rows.groupBy("storefront", name.alias("counter")).agg(F.count("*").alias("n"))

    parts = [
        count(best, F.lit("suggestions")), count(heads, F.lit("after_dedup")), count(verbs, F.lit("new_verbs")),
        count(probes, F.lit("new_probes")), count(budget.filter(F.col("kw_type") == "BRAND"), F.lit("brand")),
        count(asked.join(scored.select(*KEY), KEY, "left_anti"), F.lit("empty_serp")), count(scored, F.col("verdict")),
        count(scored.select("storefront", F.explode("gates_failed").alias("gate")), F.concat(F.lit("gate_"), "gate"))]
    counters = parts[0]
    for more in parts[1:]:
        counters = counters.unionByName(more)
    return scored, counters
