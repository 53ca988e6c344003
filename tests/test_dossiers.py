"""Dossiers over suggestions that storefronts share, and the search for few and for many tokens."""

import pytest
from pyspark.sql import functions as F

from demandscope.operators import containment
from demandscope.plans import niches as N

APPS = "array<struct<title: string, subtitle: string, rating: double, rating_count: bigint, days_since_update: int>>"
LINES = "term string, position int, storefront string"


def _heads(spark):
    rows = [(t, sf, [("Red Bolts: app", "simple bolts", 4.0, 7, 40)]) for t in ("bolt 1", "cab 2", "ring 3") for sf in ("us", "gb", "zz")]
    return spark.createDataFrame(rows, f"term string, storefront string, apps {APPS}")


def test_shared_suggestions_are_those_of_each_storefront(spark):
    lines = spark.createDataFrame([("a bolt", 2, "xx"), ("Bolts b", 1, "xx"), ("a bolt", 1, "yy"), ("scab", 3, "xx"), (None, 1, "xx")], LINES)
    copied = lines.withColumn("storefront", F.explode(F.array(F.lit("us"), F.lit("gb"))))
    shared = N.dossiers(_heads(spark), lines, shared_by=("us", "gb")).collect()
    assert sorted(shared) == sorted(N.dossiers(_heads(spark), copied).collect())
    assert {(r.term, r.storefront): r.suggestions for r in shared}["bolt 1", "us"] == "Bolts b, a bolt"
    assert {r.suggestions for r in shared if r.storefront == "zz"} == {""}


def test_heads_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    heads = _heads(spark)
    lines = spark.createDataFrame([("a bolt", 2, "us")], LINES)
    N.dossiers(heads.mapInArrow(count, heads.schema), lines).collect()
    assert made.value == 9


@pytest.mark.parametrize("few", [0, 2, 64])
def test_few_and_many_tokens_find_the_same(spark, monkeypatch, few):
    monkeypatch.setattr(containment, "FEW", few)
    wanted = spark.createDataFrame([("us", "bo"), ("us", "%a"), ("gb", "b"), ("us", "")], "storefront string, token string")
    texts = spark.createDataFrame([("us", "1%a x"), ("us", "BOb"), ("gb", "ab b"), ("gb", "c"), ("us", None)], "storefront string, text string")
    got = containment.first_containing(wanted, texts, "text", ["text"], 3).select("storefront", "token", "text").collect()
    assert sorted(map(tuple, got)) == [("gb", "b", "ab b"), ("us", "%a", "1%a x"), ("us", "bo", "BOb")]
