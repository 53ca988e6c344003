"""Fixpoints over link tables: clusters, variant groups, cross-storefront merge."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from demandscope.functions.text import eligible_head
from demandscope.operators.features import fingerprint
from demandscope.operators.overlap import cluster_links
from demandscope.session import Staged

NODE = ["storefront", "term"]


def _written(edges: DataFrame) -> Staged:
    """Edges on shared storage, with their number and an order-free checksum."""
    checksum = F.sum(F.xxhash64("storefront", "u", "v").cast("decimal(38,0)"))
    return Staged(edges, "edges", n=F.count(F.lit(1)), checksum=checksum)


def components(links: DataFrame) -> DataFrame:
    """Connected components of (storefront, a, b) links: each linked term with its smallest member.

    Alternates the large-star and small-star steps of Kiveris et al. (2014): every round
    is a grouped minimum and a join, and the edge table turns into stars in a
    logarithmic number of rounds. Each round is written to shared storage.
    """
    edges = _written(links.filter(F.col("a") != F.col("b")).select(
        "storefront", F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    settled = False
    while not settled:
        moved = _written(_small_star(_large_star(edges.df)))
        settled = moved.metrics == edges.metrics
        edges.drop()
        edges = moved
    stars = edges.df
    roots = stars.select("storefront", F.col("v").alias("term")).distinct()
    return stars.select("storefront", F.col("u").alias("term"), F.col("v").alias("root")).unionByName(
        roots.withColumn("root", F.col("term")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is attached to the node's smallest neighbour."""
    both = edges.unionByName(edges.select("storefront", F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = both.groupBy("storefront", "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (
        both.filter(F.col("v") > F.col("u")).join(lowest.hint("merge"), ["storefront", "u"])
        .select("storefront", F.col("v").alias("u"), F.col("m").alias("v"))
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are attached to the smallest of them."""
    down = edges.select("storefront", F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    lowest = down.groupBy("storefront", "u").agg(F.min("v").alias("m"))
    moved = down.join(lowest.hint("merge"), ["storefront", "u"]).select("storefront", F.col("v").alias("u"), F.col("m").alias("v"))
    kept = lowest.select("storefront", "u", F.col("m").alias("v"))
    return moved.unionByName(kept).filter(F.col("u") != F.col("v")).distinct()


def cluster_members(lists: DataFrame, hot_degree: int = 200) -> DataFrame:
    """Single-linkage clusters within each storefront, in long form.

    ``cluster_id`` is the smallest linked term. Terms without links, with an empty list, or
    that are too broad to link stand alone.
    """
    linked = components(cluster_links(lists, hot_degree=hot_degree))
    return (
        lists.select(*NODE).join(linked.hint("merge"), NODE, "left")
        .select(*NODE, F.coalesce("root", "term").alias("cluster_id"))
    )


def cluster_heads(members: DataFrame, lists: DataFrame) -> DataFrame:
    """Size and head of each cluster: eligible first, then the widest list, then the text."""
    width = lists.select(*NODE, F.size(fingerprint(F.col("apps"))).alias("width"))
    rank = F.struct(
        (~eligible_head(F.col("term"))).alias("broad"), (-F.col("width")).alias("width"), F.col("term"))
    return members.join(width.hint("merge"), NODE).groupBy("storefront", "cluster_id").agg(
        F.count("*").alias("n_members"), F.min(rank).alias("_h")).select(
        "storefront", "cluster_id", F.col("_h.term").alias("head"), "n_members")


def cluster_items(members: DataFrame, lists: DataFrame) -> DataFrame:
    """The union of the fingerprints of each cluster, one row per item."""
    items = lists.select(*NODE, F.explode(fingerprint(F.col("apps"))).alias("item"))
    return members.join(items.hint("merge"), NODE).select("storefront", "cluster_id", "item").distinct()


def niche_heads(members: DataFrame, scores: DataFrame) -> DataFrame:
    """Per cluster the reported head: eligible first, then score, then text; with its size.

    ``scores`` holds ``storefront, term, score``.
    """
    rank = F.struct(
        (~eligible_head(F.col("term"))).alias("broad"), (-F.col("score")).alias("low"), F.col("term"))
    return members.join(scores, NODE).groupBy("storefront", "cluster_id").agg(
        F.count("*").alias("cluster_size"), F.min(rank).alias("_h")).select(
        "storefront", "cluster_id", F.col("_h.term").alias("term"),
        (-F.col("_h.low")).alias("score"), "cluster_size")


def merge_storefronts(heads: DataFrame) -> DataFrame:
    """One row per head term: the best-scored storefront keeps it, the others become markets.

    ``variants_from`` and ``cluster_id_variants`` name the widest cluster, whose members are
    shown as variants; between equal widths the better-scored one.
    """
    order = F.struct((-F.col("score")).alias("low"), F.col("storefront"))
    widest = F.struct((-F.col("cluster_size")).alias("narrow"), (-F.col("score")).alias("low"), F.col("storefront"))
    payload = F.struct("storefront", "cluster_id", "score", "cluster_size")
    return heads.groupBy("term").agg(
        F.min_by(payload, order).alias("best"), F.min_by(payload, widest).alias("wide"),
        F.array_sort(F.collect_set(F.upper("storefront"))).alias("markets"),
    ).select(
        "term", "best.storefront", "best.cluster_id", "best.score",
        F.col("wide.cluster_size").alias("cluster_size"),
        F.col("wide.storefront").alias("variants_from"), F.col("wide.cluster_id").alias("variants_cluster"),
        "markets")
