from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from demandscope.operators import popularity as P

START = date(2023, 1, 1)
W = "WEEKLY_SUN_SAT"
SCHEMA = "term string, country string, genre string, period date, granularity string, rank_in_genre int, pop_1to100 int"


def week(i):
    return START + timedelta(days=7 * i)


def table(spark, series, country="us"):
    """series: term -> {week: rank}"""
    return spark.createDataFrame(
        [(t, country, "UTIL", week(i), W, r, 50) for t, points in series.items() for i, r in points.items()], SCHEMA)


def ladder(weeks, last=65):
    steady = {i: 200 for i in range(weeks)}
    climb = steady | {last - 4: 300, last - 3: 250, last - 2: 200, last - 1: 150, last: 100}
    sink = steady | {last - 1: 100, last: 180}
    return {"flat": steady, "climb": climb, "sink": sink, "fresh": {last: 40}, "flicker": {last - 2: 90, last: 80}}


def test_movement_entrants_and_climbs(spark):
    pop = table(spark, ladder(66)).cache()
    periods = P.period_list(pop, W)
    assert len(periods) == 66
    moves = {r.term: r for r in P.rank_movement(pop, periods, W).collect()}
    assert {t: r.delta for t, r in moves.items()} == {"climb": 50, "sink": -80}
    assert moves["climb"].strength == "рост" and moves["sink"].strength == "падение"
    assert [r.term for r in P.new_entrants(pop, periods, W).collect()] == ["fresh"]
    [climb] = P.sustained_climb(pop, periods, W).collect()
    assert (climb.term, climb.delta, climb.weeks_rising, climb.strength) == ("climb", 200, 4, "устойчивый рост")


def test_absence_is_judged_in_all_countries(spark):
    here = table(spark, {"fresh": {9: 10}, "old": {i: 5 for i in range(10)}})
    pop = here.union(table(spark, {"fresh": {8: 400}}, "gb"))
    assert P.new_entrants(pop, P.period_list(pop, W), W, ["us"]).count() == 0


def test_short_history_gives_nothing(spark):
    pop = table(spark, {"a": {0: 1}})
    periods = P.period_list(pop, W)
    assert P.rank_movement(pop, periods, W).count() == 0
    assert P.new_entrants(pop, periods, W).count() == 0
    assert P.sustained_climb(pop, periods, W).count() == 0


def test_seasonality_is_three_valued(spark):
    last = 65
    year = last - 52
    again = {i: 200 for i in range(66)} | {year - 4: 300, year: 120, last - 4: 300, last: 100}
    first = {i: 200 for i in range(66)} | {last - 4: 300, last: 100}
    other = {i: 200 for i in range(66)} | {year - 4: 100, year: 300, last: 100}
    young = {last - 1: 300, last: 100}
    pop = table(spark, {"again": again, "first": first, "other": other, "young": young})
    periods = P.period_list(pop, W)
    moves = P.rank_movement(pop, periods, W)
    got = {r.term: r.seasonal for r in P.with_seasonality(moves, pop, periods, W).collect()}
    assert got == {"again": True, "first": False, "other": False, "young": None}
    short = pop.filter(F.col("period") > F.lit(week(13)))
    late = P.period_list(short, W)
    assert {r.seasonal for r in P.with_seasonality(P.rank_movement(short, late, W), short, late, W).collect()} == {None}


def test_nearest_period_prefers_the_earlier():
    days = [date(2024, 1, 1), date(2024, 1, 11)]
    assert P.nearest_period(days, date(2024, 1, 6)) == days[0]
    assert P.nearest_period(days, date(2024, 2, 1)) is None


def test_band_and_adoption(spark):
    rows = [("chatgpt", 95), ("pdf editor", 55), ("calorie tracker", 45), ("rare", 20), ("known", 60)]
    pop = spark.createDataFrame([(t, "us", "UTIL", START, W, 1, p) for t, p in rows], SCHEMA)
    got = [(r.term, r.popularity) for r in P.band_candidates(pop, START, W, ["US"], 45, 65, 2).collect()]
    assert got == [("known", 60), ("pdf editor", 55)]
    keywords = spark.createDataFrame([("known", "us"), ("rare", "gb")], "term string, storefront string")
    assert {r.term for r in P.adopt_terms(pop, keywords, ["us"], 50).collect()} == {"chatgpt", "pdf editor"}


def test_trending_keeps_the_first_source(spark):
    pop = table(spark, ladder(66))
    rows = P.trending_candidates(pop, P.period_list(pop, W), W, None, 10).collect()
    assert [(r.term, r.tier) for r in rows] == [("fresh", 1), ("climb", 2), ("sink", 3)]


def test_tails_skip_known_keywords(spark):
    terms = ["be my eyes – helping the blind", "eyes two: helping the blind", "neateat - meal planner"]
    pop = spark.createDataFrame([(t, "us", "UTIL", START, W, 1, 1) for t in terms], SCHEMA)
    keywords = spark.createDataFrame([("meal planner", "us")], "term string, storefront string")
    [row] = P.tail_candidates(pop, keywords, W, None, 10).collect()
    assert (row.tail, row.origin) == ("helping the blind", "be my eyes – helping the blind")


@pytest.mark.parametrize("keep, n", [(True, 2), (False, 1)])
def test_lookup_of_absent_terms(spark, keep, n):
    pop = table(spark, {"a": {0: 1}})
    terms = spark.createDataFrame([("a",), ("b",)], "term string")
    assert P.lookup(pop, terms, ["us"], START, START, W, keep_unknown=keep).count() == n
