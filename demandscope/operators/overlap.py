"""Similarity of ranked lists by shared items, and the links that clustering needs.

Overlap is |A & B| / min(|A|, |B|) over the ids of the first ten items. Two terms are linked
at an overlap of 0.60, or at 0.30 when their first items are the same.

``overlap_pairs`` reports linked pairs of distinct lists. ``cluster_links`` only has to connect
the same terms, so it never enumerates the pairs of a crowd:

* lists with identical items (and leader) are folded onto one representative first;
* if the rarest item that two lists share is found in at most ``hot_degree`` lists, an ordinary join on it finds them;
* otherwise they share hot items only, and are tied through *subset keys*: a list of at least m items
  emits the c-element subsets of its hot items, c being the overlap required when the smaller list has m
  items. Two lists with the same key, one of them having exactly m items, are linked by
  definition, so every key ties its members to one of its m-item lists. That is linear
  in the number of lists, whatever their popularity, and it combines map-side. Lists without hot items emit nothing.
"""

from __future__ import annotations

import json
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from demandscope.config import LIST_DEPTH, THRESHOLDS as T
from demandscope.functions.text import links_allowed
from demandscope.operators.features import fingerprint, leader_id
from demandscope.session import stage

NODE = ["storefront", "term"]


def fingerprints(lists: DataFrame) -> DataFrame:
    """(storefront, term) with the sorted item ids, their number, and the first item."""
    return lists.select(
        *NODE, F.array_sort(fingerprint(F.col("apps"))).alias("items"),
        leader_id(F.col("apps")).alias("leader")).withColumn("size", F.size("items"))


def needed(size: Column, overlap: float) -> Column:
    """Shared items that make ``overlap`` when the smaller list has ``size`` items.

    Tabulated from the division itself, so the comparison is the one of the definition.
    """
    table = [_needed(m, overlap) for m in range(1, LIST_DEPTH + 1)]
    return F.array(*[F.lit(c) for c in table])[size - 1]


def _needed(size: int, overlap: float) -> int:
    return next(c for c in range(1, size + 1) if c / size >= overlap)


def _ranked_items(prints: DataFrame) -> DataFrame:
    """Each list with its items ordered from the rarest in the storefront to the commonest; ``met`` has a bit for each size of the lists with the item."""
    long = prints.select(*NODE, "size", F.explode("items").alias("item"))
    degrees = long.groupBy("storefront", "item").agg(
        F.count("*").alias("degree"), F.expr("bit_or(shiftleft(1, size))").alias("met"))
    placed = (
        long.join(degrees.hint("merge"), ["storefront", "item"])
        .groupBy(*NODE).agg(F.array_sort(F.collect_list(F.struct("degree", "item", "met"))).alias("ranked"))
    )
    return prints.join(placed.hint("merge"), NODE)


def _sizes(prints: DataFrame) -> DataFrame:
    """The list sizes of each storefront, ten at most."""
    return prints.groupBy("storefront").agg(F.array_sort(F.collect_set("size")).alias("sizes"))


def _prefix_rows(ranked: DataFrame, overlap: float, same_leader: bool, max_degree: int | None) -> tuple[DataFrame, DataFrame]:
    """What the smaller and the larger lists send into the join, under (storefront, item, size of the smaller one).

    With c shared items needed, the first size - c + 1 items of both lists (in one global order, the rarest first) have
    one in common. As c depends on the smaller size m, a list sends m with each item, and only the items that it
    needs for this m. An item of one list only, or of no list of size m, meets nothing and is not sent.
    """
    leader = ["leader"] if same_leader else []

    def rows(m: Column, name: str) -> DataFrame:
        side = ranked.select("storefront", *leader, F.col("term").alias(name), F.col("items").alias(f"items_{name}"),
                             F.col("size").alias(f"size_{name}"), "ranked", m.alias("m")).select(
            "storefront", *leader, name, f"items_{name}", f"size_{name}", "m", F.explode(F.slice(
                "ranked", F.lit(1), F.col(f"size_{name}") - needed(F.col("m"), overlap) + 1)).alias("entry"))
        side = side.filter((F.col("entry.degree") > 1) & F.expr("entry.met & shiftleft(1, m) != 0"))
        if max_degree is not None:
            side = side.filter(F.col("entry.degree") <= max_degree)
        return side.withColumn("item", F.col("entry.item")).drop("entry")

    return rows(F.col("size"), "small"), rows(F.explode(F.filter("sizes", lambda m: m <= F.col("size"))), "large")


def _candidates(ranked: DataFrame, overlap: float, same_leader: bool, max_degree: int | None) -> DataFrame:
    """Pairs that reach ``overlap``, found through their rarest items; ``ranked`` lists have the sizes of their storefront."""
    small, large = _prefix_rows(ranked, overlap, same_leader, max_degree)
    common = F.size(F.array_intersect("items_small", "items_large"))
    # both sides are many times their file, by whose size Spark would broadcast them
    return (
        small.join(large.hint("merge"), ["storefront", "item", "m"] + (["leader"] if same_leader else []))
        .filter((F.col("size_large") > F.col("m")) | (F.col("small") < F.col("large")))
        .filter(common >= needed(F.col("m"), overlap))
        .select("storefront", F.least("small", "large").alias("a"), F.greatest("small", "large").alias("b"),
                common.alias("n_common"), F.col("m").alias("n_smaller"))
        .distinct()
    )


def _linkable(prints: DataFrame) -> DataFrame:
    return prints.filter((F.col("size") > 0) & links_allowed(F.col("term")))


def _fold(lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct lists under their smallest term, with ranked items, and the copies (storefront, a, b) of each."""
    prints = stage(
        _linkable(fingerprints(lists)).withColumn(
            "lead_key", F.coalesce(F.col("leader").cast("string"), F.lit(""))), "fingerprints")
    same = ["storefront", "items", "lead_key"]
    distinct = stage(prints.groupBy(*same).agg(
        F.min("term").alias("term"), F.first("leader").alias("leader"), F.first("size").alias("size")), "folded")
    # spread: the rows made of a list are hundreds of times its size
    ranked = _ranked_items(distinct).join(_sizes(distinct), "storefront").repartition(
        2 * lists.sparkSession.sparkContext.defaultParallelism)
    folded = stage(ranked.withColumn("id", F.monotonically_increasing_id()), "ranked-lists")
    copies = (
        prints.select(*same, F.col("term").alias("b"), "size")
        .join(folded.select(*same, F.col("term").alias("a")).hint("merge"), same).filter(F.col("a") != F.col("b"))
        .select("storefront", "a", "b", "size", (F.col("lead_key") != "").alias("led"))
    )
    return folded, copies


def overlap_pairs(lists: DataFrame, overlap: float = T.cluster_overlap,
                  leader_overlap: float = T.same_leader_min_overlap) -> DataFrame:
    """Linked pairs with their overlap and whether the leader is shared.

    Identical lists are one list here: each copy is paired once, with the smallest term that
    has the list, and only that term is paired with other lists. The pairs of a copy
    follow from it, and a crowd of copies adds rows in proportion to its size.
    """
    folded, copies = _fold(lists)
    close = _candidates(folded, overlap, same_leader=False, max_degree=None)
    led = _candidates(folded.filter(F.col("leader").isNotNull()), leader_overlap,
                      same_leader=True, max_degree=None)
    tagged = close.withColumn("_led", F.lit(0)).unionByName(led.withColumn("_led", F.lit(1)))
    pairs = tagged.groupBy("storefront", "a", "b", "n_common", "n_smaller").agg(F.max("_led").alias("_led")).select(
        "storefront", "a", "b", "n_common", (F.col("n_common") / F.col("n_smaller")).alias("overlap"),
        (F.col("_led") == 1).alias("same_leader"))
    return pairs.unionByName(copies.select(
        "storefront", "a", "b", F.col("size").alias("n_common"), F.lit(1.0).alias("overlap"),
        F.col("led").alias("same_leader")))


def _subset_links(folded: DataFrame, hot_degree: int, overlap: float, same_leader: bool) -> DataFrame:
    """Star links between lists that share enough hot items for ``overlap``."""
    # number of hot items -> every (m, places of a subset that an m-list requires); a constant of the plan
    table = {
        hot: [{"m": m, "places": [i + 1 for i in places]} for m in range(1, LIST_DEPTH + 1)
              for places in combinations(range(hot), _needed(m, overlap))]
        for hot in range(1, LIST_DEPTH + 1)
    }
    options = F.from_json(F.lit(json.dumps(table)),
                          "map<string, array<struct<m: int, places: array<int>>>>")
    hot = F.array_sort(F.transform(F.filter("ranked", lambda r: r["degree"] > hot_degree), lambda r: r["item"]))
    crowd = folded.withColumn("hot", hot).filter(F.size("hot") > 0)
    if same_leader:  # a leader that is not hot is a shared item by which the ordinary join finds the pair
        crowd = crowd.filter(~F.array_contains("items", F.col("leader")) | F.array_contains("hot", F.col("leader")))
    own = F.filter(options[F.size("hot").cast("string")], lambda o: (o["m"] <= F.col("size")) & F.array_contains("sizes", o["m"]))
    # 128 bits stand for storefront, size and items (and leader): rows of fixed width are sorted and grouped faster than arrays
    keys = ["key", "check"]
    what = ["storefront", "leader", "s"] if same_leader else ["storefront", "s"]
    holds = F.array_contains("hot", F.col("leader"))

    def rows(chosen: Column) -> DataFrame:
        subsets = F.transform(chosen, lambda o: F.struct(
            o["m"].alias("m"), F.transform(o["places"], lambda i: F.element_at("hot", i)).alias("items")))
        if same_leader:
            subsets = F.filter(subsets, lambda s: ~holds | F.array_contains(s["items"], F.col("leader")))
        return crowd.select("storefront", "id", "leader", F.explode(subsets).alias("s")).select(
            F.xxhash64(*what).alias("key"), F.xxhash64(F.lit(1), *what).alias("check"), "id")

    keyed = rows(own)
    anchors = rows(F.filter(own, lambda o: o["m"] == F.col("size"))).groupBy(*keys).agg(F.min("id").alias("a"))
    stars = keyed.join(anchors.hint("merge"), keys).filter(F.col("id") != F.col("a")).select(
        "a", F.col("id").alias("b")).distinct()
    names = folded.select("id", "storefront", "term")
    return (
        stars.join(names.select(F.col("id").alias("a"), "storefront", F.col("term").alias("anchor")).hint("merge"), "a")
        .join(names.select(F.col("id").alias("b"), "term").hint("merge"), "b")
        .select("storefront", F.col("anchor").alias("a"), F.col("term").alias("b"))
    )


def cluster_links(lists: DataFrame, overlap: float = T.cluster_overlap,
                  leader_overlap: float = T.same_leader_min_overlap,
                  hot_degree: int = 200) -> DataFrame:
    """Links (storefront, a, b) that connect exactly the terms single linkage connects."""
    folded, copies = _fold(lists)
    leaders = folded.filter(F.col("leader").isNotNull())
    return (
        copies.select("storefront", "a", "b")
        .unionByName(_candidates(folded, overlap, False, hot_degree).select("storefront", "a", "b"))
        .unionByName(_candidates(leaders, leader_overlap, True, hot_degree).select("storefront", "a", "b"))
        .unionByName(_subset_links(folded, hot_degree, overlap, same_leader=False))
        .unionByName(_subset_links(leaders, hot_degree, leader_overlap, same_leader=True))
    )
