import random

import pytest
from pyspark.sql import functions as F

from demandscope.operators import graph, overlap, variants
from demandscope.plans.niches import niche_clusters
from demandscope.session import Staged
from tests.brute import close, greedy_heads, link_groups, linked

LISTS = "storefront string, term string, apps array<struct<track_id: bigint>>"


def lists_of(spark, table):
    return spark.createDataFrame([(sf, t, [(i,) for i in ids]) for (sf, t), ids in table.items()], LISTS)


def random_lists(seed, n, universe, hub_share):
    """Lists of 1..10 items; a hub item opens many of them, some are exact copies."""
    rng = random.Random(seed)
    table = {}
    for k in range(n):
        sf = rng.choice(["us", "gb"])
        if table and rng.random() < 0.3:
            ids = list(rng.choice([v for v in table.values()]))
            if rng.random() < 0.5:
                ids[-1] = rng.randrange(universe)
        else:
            ids = rng.sample(range(universe), rng.choice([1, 2, 3, 5, 7, 8, 9, 10, 10, 10, 10]))
            if rng.random() < hub_share:
                ids[0] = 1
        table[(sf, f"term {k:03d}")] = list(dict.fromkeys(ids))
    table[("us", "fitness")] = [1, 2, 3]
    table[("us", "empty one")] = []
    return table


@pytest.mark.parametrize("seed, hub_share, hot_degree", [(1, 0.2, 1000), (2, 0.6, 3), (3, 0.9, 0), (4, 0.4, 8)])
def test_clusters_equal_brute_force(spark, seed, hub_share, hot_degree):
    table = random_lists(seed, 90, 40, hub_share)
    got = {(r.storefront, r.term): r.cluster_id for r in graph.cluster_members(
        lists_of(spark, table), hot_degree=hot_degree).collect()}
    expected = {}
    for sf in ("us", "gb"):
        terms = [t for s, t in table if s == sf]
        roots = link_groups(terms, lambda a, b: "fitness" not in (a, b) and linked(table[sf, a], table[sf, b]))
        expected |= {(sf, t): r for t, r in roots.items()}
    assert got == expected


def test_exploded_sides_are_not_broadcast(spark):
    """Their files are small, but the rows made of them need not fit the driver."""
    table = lists_of(spark, random_lists(7, 30, 20, 0.4))
    terms = table.select("storefront", "term")
    for rows in (variants.fuzzy_pairs(terms), variants.variant_heads(terms), overlap.overlap_pairs(table),
                 overlap.cluster_links(table, hot_degree=3)):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan or "Join" not in plan
        assert "BroadcastHashJoin" not in plan


def test_items_that_meet_nothing_are_not_sent(spark):
    """Ten items, five of them in no other list; the one short list has other items."""
    table = {("us", "long a"): [1, 2, 3, 4, 5, 11, 12, 13, 14, 15], ("us", "long b"): [1, 2, 3, 4, 5, 21, 22, 23, 24, 25],
             ("us", "short c"): [31], ("us", "short d"): [5, 32]}
    folded, _ = overlap._fold(lists_of(spark, table))
    small, large = overlap._prefix_rows(folded, 0.6, False, None)
    assert {r.item for r in small.collect()} | {r.item for r in large.collect()} <= {1, 2, 3, 4, 5}
    assert not large.filter("m < 10").count()  # the short lists' first items are in no other list


@pytest.mark.parametrize("seed", [5, 6])
def test_pairs_equal_brute_force(spark, seed):
    table = random_lists(seed, 80, 40, 0.4)
    got = {(r.storefront, r.a, r.b) for r in overlap.overlap_pairs(lists_of(spark, table)).collect()}
    keys = [k for k in table if k[1] != "fitness" and table[k]]
    shape = lambda k: (k[0], frozenset(i for i in table[k][:10] if i), table[k][0])
    first = {k: min(o for o in keys if shape(o) == shape(k)) for k in keys}
    assert got == {(x[0], x[1], y[1]) for x in keys for y in keys
                   if x[0] == y[0] and x[1] < y[1] and linked(table[x], table[y])
                   and first[x] == x and first[y] in (x, y)}


def test_components_of_long_chains(spark):
    chain = [("us", f"n{i:03d}", f"n{i + 1:03d}") for i in range(120)] + [("gb", "n000", "x")]
    got = graph.components(spark.createDataFrame(chain, "storefront string, a string, b string")).collect()
    assert len(got) == 123 and {r.root for r in got} == {"n000"}


def test_hub_links_stay_linear(spark):
    """A third of all lists share one hub and six items: links must not grow quadratically."""
    table = {("us", f"crowd {k:04d}"): [1, 2, 3, 4, 5, 6, 1000 + k, 2000 + k, 3000 + k, 4000 + k] for k in range(400)}
    links = overlap.cluster_links(lists_of(spark, table), hot_degree=20)
    assert links.count() < 400 * 12
    assert graph.components(links).select("root").distinct().count() == 1


def test_hub_lists_are_spread(spark):
    """The rows made of crowded lists come from as many tasks as there are cores, and the lists are worked out once."""
    table = {("us", f"crowd {k:04d}"): [1, 2, 3, 4, 5, 6, 1000 + k, 2000 + k, 3000 + k, 4000 + k] for k in range(100)}
    folded, _ = overlap._fold(lists_of(spark, table))
    assert folded.select("id").distinct().count() == folded.count() == 100
    assert folded.select(F.spark_partition_id().alias("p")).distinct().count() >= spark.sparkContext.defaultParallelism


def random_terms(seed, n):
    rng = random.Random(seed)
    words = ["noise", "meter", "metre", "scan", "scanner", "documents", "photo", "compress", "pdf", "x", "image"]
    out = set()
    while len(out) < n:
        term = " ".join(rng.choice(words) for _ in range(rng.randint(1, 4)))
        if rng.random() < 0.6:
            at = rng.randrange(len(term))
            term = term[:at] + rng.choice(["", "a", "e", " "]) + term[at + rng.randint(0, 1):]
        out.add(" ".join(term.split()) or "x")
    return sorted(out)


@pytest.mark.parametrize("seed", [7, 8, 9])
def test_variants_equal_brute_force(spark, seed):
    terms = random_terms(seed, 110)
    df = spark.createDataFrame([("us", t) for t in terms], "storefront string, term string")
    squashed = {r.term: r.squashed for r in variants.squashed_terms(df).collect()}
    got = {r.term: r.head for r in variants.variant_heads(df).collect()}
    assert got == greedy_heads(terms, lambda a, b: close(squashed[a], squashed[b]))
    pairs = {(r.a, r.b) for r in variants.fuzzy_pairs(df).collect()}
    assert pairs == {(a, b) for a in terms for b in terms if a < b and squashed[a] != squashed[b]
                     and close(squashed[a], squashed[b])}


@pytest.mark.parametrize("seed, crowd", [(10, 2), (11, 8)])
def test_crowded_keys_are_cut_further(spark, seed, crowd):
    """Half of the forms share eight letters: few pairs of them meet, and none of the close ones is lost."""
    rng = random.Random(seed)
    tail = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    forms = sorted({("opening-" if k % 2 else "") + tail(8 + k % 3) for k in range(300)}
                   | {t.replace("meter", "metre") + tail(k % 2) for k in range(2) for t in map(squashed_plain, random_terms(seed, 60))})
    near = rng.sample([f for f in forms if f.startswith("opening-")], 40)
    forms = sorted({*forms, *(f[:9] + f[10:] for f in near), *(f[:12] + "k" + f[13:] for f in near)})
    df = spark.createDataFrame([("us", f) for f in forms], "storefront string, squashed string")
    met = variants._meetings(*variants._sides(df, 88), crowd)
    assert met.count() < len(forms) * 40 < 150 * 150
    got = [tuple(sorted((r.longer, r.shorter))) for r in variants.close_forms(df, crowd=crowd).collect()]
    assert len(got) == len(set(got)) and set(got) == {
        (a, b) for a in forms for b in forms if a < b and close(a, b)}


def squashed_plain(term):
    return term.replace(" ", "")


def test_spelling_variants_collapse(spark):
    df = spark.createDataFrame([("us", t) for t in ("noise meter", "noisemeter", "noise metre", "decibel meter")],
                               "storefront string, term string")
    heads = {r.head for r in variants.variant_heads(df).collect()}
    assert heads == {"noisemeter", "decibel meter"}


def test_rounds_hold_linked_terms_only(spark, monkeypatch):
    sizes = []

    def counted(df, label, **metrics):
        if label == "heads":
            sizes.append(df.count())
        return Staged(df, label, **metrics)

    monkeypatch.setattr(variants, "Staged", counted)
    df = spark.createDataFrame([("us", t) for t in ("noise meter", "noisemeter", "decibel meter", "scan pdf", "-", "to do", "s s")],
                               "storefront string, term string")
    heads = {r.term: r.head for r in variants.variant_heads(df).collect()}
    assert heads == {"noise meter": "noisemeter", "noisemeter": "noisemeter", **{t: t for t in ("decibel meter", "scan pdf", "-", "to do", "s s")}}
    assert sizes and set(sizes) == {2}


def test_cross_storefront_merge(spark):
    heads = spark.createDataFrame([
        ("us", "c1", "resize image", 40.0, 2), ("gb", "c2", "resize image", 55.0, 1), ("ca", "c3", "resize image", 30.0, 3),
        ("us", "c4", "scan pdf", 20.0, 1)], "storefront string, cluster_id string, term string, score double, cluster_size long")
    rows = {r.term: r for r in graph.merge_storefronts(heads).collect()}
    top = rows["resize image"]
    assert (top.storefront, top.score, top.cluster_size, top.variants_from) == ("gb", 55.0, 3, "ca")
    assert top.markets == ["CA", "GB", "US"]


def test_niches_prefer_specific_heads(spark):
    rows = [("us", "translate", 90.0, [1, 2, 3, 4, 5]), ("us", "translate voice", 50.0, [1, 2, 3, 4, 6]),
            ("us", "scan pdf", 10.0, [9, 8, 7])]
    df = spark.createDataFrame([(sf, t, s, [(i,) for i in ids]) for sf, t, s, ids in rows],
                               "storefront string, term string, score double, apps array<struct<track_id: bigint>>")
    niches, rest = niche_clusters(df)
    assert {(r.term, r.cluster_size) for r in niches.collect()} == {("translate voice", 2), ("scan pdf", 1)}
    assert [(r.head, r.variant) for r in rest.collect()] == [("translate voice", "translate")]


def test_needed_items_follow_the_division():
    assert [overlap._needed(m, 0.6) for m in range(1, 11)] == [1, 2, 2, 3, 3, 4, 5, 5, 6, 6]
    assert [overlap._needed(m, 0.3) for m in range(1, 11)] == [1, 1, 1, 2, 2, 2, 3, 3, 3, 3]


def test_no_hidden_limits(spark):
    df = lists_of(spark, {("us", "a b"): [1, 2, 3], ("us", "c d"): [1, 2, 9]})
    assert overlap.overlap_pairs(df).filter(F.col("same_leader")).count() == 1
