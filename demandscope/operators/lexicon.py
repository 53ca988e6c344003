"""Suggestion corpus: best places, harvested objects, discovered verbs, next probes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from demandscope.config import BROAD_TERMS, REPROBE_AFTER_DAYS, STOPWORDS, probe_suffixes, seed_order
from demandscope.functions.text import root_matches, singularize, tokens
from demandscope.operators.containment import first_containing
from demandscope.session import stage


def best_positions(suggestions: DataFrame) -> DataFrame:
    """Best place per (storefront, term), counting only whole-word matches of the root."""
    return (
        suggestions.filter(root_matches(F.col("prefix"), F.col("term")))
        .groupBy("storefront", "term").agg(F.min("position").alias("position"))
    )


def _meaningful(token: Column) -> Column:
    return (F.length(token) >= 3) & ~token.rlike(r"^\d+$")


def harvest_objects(suggestions: DataFrame) -> DataFrame:
    """Objects next to each root: tokens that are neither the root nor stopwords, counted.

    The same term reached through several probes of a root counts once.
    """
    pairs = (
        suggestions.filter(root_matches(F.col("prefix"), F.col("term")))
        .select("storefront", "prefix", "term").distinct()
    )
    own = pairs.withColumn("own", tokens(F.col("prefix")))  # below the explode: once a term, not once a token
    return (
        own.select("storefront", "prefix", "own", F.explode(tokens(F.col("term"))).alias("raw"))
        .filter(~F.col("raw").isin(*STOPWORDS) & ~F.array_contains("own", F.col("raw")))
        .select("storefront", "prefix", singularize(F.col("raw")).alias("token"))
        .filter(_meaningful(F.col("token")))
        .groupBy("storefront", "prefix", "token").agg(F.count("*").alias("n"))
    )


def token_frequency(suggestions: DataFrame) -> DataFrame:
    """Token counts over every stored suggestion, repeats included.

    Each distinct raw token is counted before it is made singular, so the string
    rules run once per vocabulary entry rather than once per occurrence.
    """
    raw = (
        suggestions.select("storefront", F.explode(tokens(F.col("term"))).alias("raw"))
        .groupBy("storefront", "raw").agg(F.count("*").alias("n"))
    )
    return (
        raw.select("storefront", singularize(F.col("raw")).alias("token"), "n")
        .filter(_meaningful(F.col("token")) & ~F.col("token").isin(*STOPWORDS))
        .groupBy("storefront", "token").agg(F.sum("n").alias("n"))
    )


def discover_verbs(suggestions: DataFrame, min_distinct: int = 3) -> DataFrame:
    """Leading tokens of at least ``min_distinct`` different terms, per storefront."""
    known = [v for v, _ in seed_order()]
    # a row of one entry keeps the first token: filters are pushed below the distinct, and would cut it out again each
    head = F.explode(F.array(F.struct(F.regexp_extract("term", r"\S+", 0).alias("raw")))).alias("head")
    return (
        suggestions.select("storefront", "term", head).select("storefront", "term", "head.raw")
        .filter(F.col("term").rlike(r"\S\s+\S")).distinct()
        .select("storefront", singularize(F.col("raw")).alias("verb"))
        .filter(~F.col("verb").isin(*STOPWORDS) & ~F.col("verb").isin(*known) & (F.length("verb") >= 3))
        .groupBy("storefront", "verb").agg(F.count("*").alias("n_terms"))
        .filter(F.col("n_terms") >= min_distinct)
    )


def verb_evidence(discoveries: DataFrame) -> DataFrame:
    """How many runs found each verb (``verb, run_id``)."""
    return discoveries.groupBy("verb").agg(F.count_distinct("run_id").alias("evidence"))


def promotable_verbs(evidence: DataFrame, min_evidence: int = 2) -> DataFrame:
    return evidence.filter(F.col("evidence") >= min_evidence)


def probe_ledger(suggestions: DataFrame) -> DataFrame:
    """Per (prefix, storefront): when last probed and how many terms that probe gave."""
    per_probe = suggestions.groupBy("prefix", "storefront", "seen_at").agg(
        F.count_distinct("term").alias("yield_count"))
    return per_probe.groupBy("prefix", "storefront").agg(
        F.max("seen_at").alias("probed_at"), F.max_by("yield_count", "seen_at").alias("yield_count"))


def next_probes(objects: DataFrame, ledger: DataFrame, limit: int, min_count: int = 2) -> DataFrame:
    """Most frequent objects of one storefront that were not probed yet."""
    return (
        objects.filter((F.col("n") >= min_count) & ~F.col("token").isin(*BROAD_TERMS, *STOPWORDS))
        .join(ledger.select(F.col("prefix").alias("token")), "token", "left_anti")
        .orderBy(F.desc("n"), "token").limit(limit)
    )


def open_probes(objects: DataFrame, ledger: DataFrame, min_count: int = 2) -> DataFrame:
    """All objects (storefront, token, n) that their storefront's ledger does not have yet."""
    return objects.filter((F.col("n") >= min_count) & ~F.col("token").isin(*BROAD_TERMS, *STOPWORDS)).join(
        ledger.select("storefront", F.col("prefix").alias("token")), ["storefront", "token"], "left_anti")


def stalest(ledger: DataFrame, as_of: Column, limit: int, min_age_days: int = REPROBE_AFTER_DAYS) -> DataFrame:
    """Longest-unprobed prefixes older than the cut-off."""
    cutoff = as_of - F.make_dt_interval(F.lit(min_age_days))
    return (
        ledger.filter(F.col("probed_at") < cutoff).orderBy("probed_at", "prefix").limit(limit)
    )


def seed_table(ledger: DataFrame) -> DataFrame:
    """The seed verbs with their order, as a DataFrame."""
    return ledger.sparkSession.createDataFrame(seed_order(), "verb string, place int")


def plan_roots(ledger: DataFrame, evidence: DataFrame, objects: DataFrame, as_of: Column, n: int,
               min_age_days: int = REPROBE_AFTER_DAYS) -> DataFrame:
    """The next ``n`` roots of one storefront.

    Filled from fresh seeds, promotable verbs, frontier objects, then stale prefixes. Each
    tier is cut to ``n`` before the union, so the final ordering sees a few rows.
    Broad terms leave the plan after the cut (a removed term is not replaced), except
    when fresh seeds fill it alone, or when no seed is fresh and stale prefixes are needed.
    """
    done = ledger.select(F.col("prefix").alias("root"))
    fresh = (
        seed_table(ledger).select(F.col("verb").alias("root"), F.col("place").cast("bigint").alias("place"))
        .join(done, "root", "left_anti").orderBy("place").limit(n).withColumn("tier", F.lit(1)))
    verbs = (
        promotable_verbs(evidence)
        .select(F.col("verb").alias("root"), (-F.col("evidence")).alias("place"))
        .join(done, "root", "left_anti").orderBy("place", "root").limit(n).withColumn("tier", F.lit(2)))
    frontier = next_probes(objects, ledger, 3 * n).select(
        F.col("token").alias("root"), (-F.col("n")).alias("place"), F.lit(3).alias("tier"))
    stale = stalest(ledger, as_of, 3 * n, min_age_days).select(
        F.col("prefix").alias("root"), F.unix_timestamp("probed_at").alias("place"), F.lit(4).alias("tier"))
    pool = fresh.unionByName(verbs).unionByName(frontier).unionByName(stale)
    filled = (
        pool.groupBy("root").agg(F.min(F.struct("tier", "place")).alias("m"))
        .select("root", "m.tier", "m.place").orderBy("tier", "place", "root").limit(n)
    )
    whole = Window.partitionBy(F.lit(1))  # at most n rows
    count = lambda tiers: F.count(F.when(F.col("tier").isin(*tiers), 1)).over(whole)
    return (
        filled.withColumns({"_fresh": count([1]), "_before_stale": count([1, 2, 3])})
        .filter((F.col("_fresh") >= n) | ((F.col("_fresh") == 0) & (F.col("_before_stale") < n))
                | ~F.col("root").isin(*BROAD_TERMS))
        .drop("_fresh", "_before_stale")
    )


def probe_prefixes(roots: DataFrame, deep: bool = False) -> DataFrame:
    """Every prefix to probe: the root with each suffix."""
    suffixes = F.array(*[F.lit(s) for s in probe_suffixes(deep)])
    return roots.select("root", F.explode(suffixes).alias("suffix")).select(
        "root", F.concat("root", "suffix").alias("prefix"))


def metadata_tokens(lists: DataFrame) -> DataFrame:
    """Token counts over titles and subtitles of each list.

    An item is in many lists, so its text is cut into tokens once and its counts are joined to the lists.
    """
    text = F.lower(F.concat(F.coalesce("a.title", F.lit("")), F.lit(" "), F.coalesce("a.subtitle", F.lit(""))))
    entries = stage(lists.select("term", "storefront", F.explode("apps").alias("a")).select(
        "term", "storefront", text.alias("text")), "metadata-texts")
    split = tokens(F.translate("text", ":-", "  "))
    bare = F.transform(split, lambda raw: F.regexp_replace(raw, r"^[.,!()&]+|[.,!()&]+$", ""))
    counts = (
        entries.select("text").distinct().select("text", F.explode(F.transform(bare, singularize)).alias("token"))
        .filter((F.length("token") > 2) & ~F.col("token").isin(*STOPWORDS))
        .groupBy("text", "token").agg(F.count("*").alias("n"))
    )
    return entries.join(counts.hint("merge"), "text").groupBy("term", "storefront", "token").agg(F.sum("n").alias("n"))


def related_suggestions(terms: DataFrame, suggestions: DataFrame, limit: int = 30) -> DataFrame:
    """Suggestions containing a term's first token, best places first."""
    wanted = stage(terms.select("storefront", F.lower(F.try_element_at(tokens(F.col("term")), F.lit(1))).alias("token"))
                   .filter(F.col("token").isNotNull()).distinct(), "wanted")
    asked = suggestions.join(wanted.select("storefront").distinct(), "storefront", "left_semi")
    best = stage(asked.groupBy("storefront", F.col("term").alias("suggestion")).agg(
        F.min("position").alias("position")), "suggestions")
    return first_containing(wanted, best, "suggestion", ["position", "suggestion"], limit).select(
        "storefront", "token", "suggestion", "position", "place")
