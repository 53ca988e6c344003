"""As-of joins and the choice of storefronts."""

import random

import pytest

from demandscope.operators.asof import asof_join
from demandscope.operators.storefronts import chosen_storefronts


@pytest.mark.parametrize(("seed", "hot"), [(1, 0.2), (2, 0.9)])
def test_asof_equals_brute_force(spark, seed, hot):
    rng = random.Random(seed)
    key = lambda: "h" if rng.random() < hot else rng.choice(["a", "b", None])
    time = lambda: rng.choice([None, *range(40)])
    rows = [(i, key(), time()) for i in range(300)]
    states = [(key(), time(), rng.choice([None, 1, 2, 3]), rng.choice("xy")) for _ in range(200)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # keep a key in several ranges
    try:
        got = asof_join(spark.createDataFrame(rows + rows[:5], "id int, k string, t int"),
                        spark.createDataFrame(states, "k string, t int, v int, w string"), ["k"], "t", "t", ["v", "w"]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    expected = []
    for i, k, t in rows + rows[:5]:
        past = [s for s in states if k is not None and t is not None and s[0] == k and s[1] is not None and s[1] <= t]
        last = max(past, key=lambda s: (s[1], s[2] is not None, s[2] or 0, s[3]), default=(None,) * 4)
        expected.append((i, k, t, *last[2:]))
    assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)


def test_no_states(spark):
    rows = spark.createDataFrame([(1, "a", 1)], "id int, k string, t int")
    none = spark.createDataFrame([], "k string, s int, v int")
    assert [tuple(r) for r in asof_join(rows, none, ["k"], "t", "s", ["v"]).collect()] == [(1, "a", 1, None)]
    assert asof_join(rows.limit(0), none, ["k"], "t", "s", ["v"]).count() == 0


def test_storefronts_keep_the_known_order(spark):
    asked = [(1, " GB, us,gb,xx,Q "), (2, "xx"), (3, ""), (4, None)]
    got = chosen_storefronts(spark.createDataFrame(asked, "request_id int, stores string")).collect()
    assert {tuple(r) for r in got} == {(1, 0, "us", "en", "q,xx"), (1, 1, "gb", "en", "q,xx"), (2, 0, "us", "en", "xx"),
                                       (3, 0, "us", "en", ""), (4, 0, "us", "en", "")}
