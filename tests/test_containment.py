"""The first texts that contain a word, against brute force."""

import random

import pytest

from demandscope.operators.containment import first_containing


@pytest.mark.parametrize(("seed", "limit", "head"), [(1, 1, 2), (2, 3, 5), (3, 1000, 2), (4, 4, 100)])
def test_first_texts_equal_brute_force(spark, seed, limit, head):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 7)))
    texts = {(sf, " ".join(word() for _ in range(rng.randint(1, 5)))): rng.randint(1, 4) for sf in ("us", "gb") for _ in range(60)}
    texts["us", "ABCA cab"] = 1
    wanted = [(sf, t) for sf in ("us", "gb") for t in ["a", "ab", "abc", "cabc", "zzz", "", "abcabcabcabc", *(word() for _ in range(6))]]
    got = first_containing(
        spark.createDataFrame(wanted * 2, "storefront string, token string"),
        spark.createDataFrame([(sf, n, t) for (sf, t), n in texts.items()], "storefront string, n int, text string"),
        "text", ["n", "text"], limit, head).collect()
    expected = set()
    for sf, token in set(wanted):
        hits = sorted((n, t) for (s, t), n in texts.items() if s == sf and token and token in t.lower())
        expected |= {(sf, token, n, t, i + 1) for i, (n, t) in enumerate(hits[:limit])}
    assert {(r.storefront, r.token, r.n, r.text, r.place) for r in got} == expected and len(got) == len(expected)


def test_no_rows(spark):
    none = spark.createDataFrame([], "storefront string, token string")
    assert first_containing(none, spark.createDataFrame([("us", "a b")], "storefront string, text string"), "text", ["text"], 3).count() == 0
