"""Movement in periodic popularity rankings.

Rows are keyed by ``term, country, genre, period, granularity`` and carry
``rank_in_genre`` and ``pop_1to100``. The table is meant to be partitioned by
``granularity, period``: every operator first settles on a handful of periods (a few dates
fetched to the driver) so the filters on them are literals and prune partitions.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from demandscope import labels
from demandscope.functions.text import descriptor_tail, words

KEY = ["term", "country", "genre"]
_NEVER = date(1970, 1, 1)  # stands for a period that is not there


def _scope(pop: DataFrame, granularity: str, countries: Sequence[str] | None = None) -> DataFrame:
    rows = pop.filter(F.col("granularity") == granularity)
    return rows.filter(F.col("country").isin([c.lower() for c in countries])) if countries else rows


def period_table(pop: DataFrame, granularity: str) -> DataFrame:
    """The distinct periods of one granularity."""
    return _scope(pop, granularity).select("period").distinct()


def period_list(pop: DataFrame, granularity: str) -> list[date]:
    """Stored periods, oldest first. One date per week or month ever collected."""
    return [r.period for r in period_table(pop, granularity).orderBy("period").collect()]


def strength(delta: Column, is_new: Column, rising: Column, tracked: Column) -> Column:
    return (
        F.when(is_new, labels.STRENGTH_NEW)
        .when((tracked >= 4) & (rising >= tracked - 1), labels.STRENGTH_SUSTAINED)
        .when(delta >= 50, labels.STRENGTH_UP)
        .when(delta <= -50, labels.STRENGTH_DOWN)
        .otherwise(labels.STRENGTH_STABLE)
    )


def _movement_columns(rows: DataFrame) -> DataFrame:
    return rows.select(
        *KEY,
        F.col("rank_now").cast("int"), F.col("rank_before").cast("int"),
        F.col("popularity").cast("int"), F.col("delta").cast("int"),
        F.col("weeks_rising").cast("int"), F.col("weeks_tracked").cast("int"), "is_new",
        strength(F.col("delta"), F.col("is_new"), F.col("weeks_rising"), F.col("weeks_tracked"))
        .alias("strength"),
    )


def _empty(pop: DataFrame) -> DataFrame:
    return pop.filter(F.lit(False))


def rank_movement(pop: DataFrame, periods: Sequence[date], granularity: str,
                  countries: Sequence[str] | None = None, lookback: int = 1,
                  min_delta: int = 30) -> DataFrame:
    """Rank change between the newest period and the one ``lookback`` stored periods earlier.

    One pass over two partitions: both ranks meet in a single aggregation, no self-join.
    """
    rows = _scope(pop, granularity, countries).filter(F.col("rank_in_genre").isNotNull())
    if len(periods) < lookback + 1:
        rows, now, before = _empty(rows), _NEVER, _NEVER
    else:
        now, before = periods[-1], periods[-(lookback + 1)]
    at = lambda p, c: F.max(F.when(F.col("period") == F.lit(p), F.col(c)))
    both = (
        rows.filter(F.col("period").isin(now, before))
        .groupBy(*KEY)
        .agg(at(now, "rank_in_genre").alias("rank_now"), at(before, "rank_in_genre").alias("rank_before"),
             at(now, "pop_1to100").alias("popularity"))
        .withColumn("delta", F.col("rank_before") - F.col("rank_now"))
        .filter(F.abs("delta") >= min_delta)
    )
    return _movement_columns(both.select("*", F.lit(0).alias("weeks_rising"),
                                         F.lit(0).alias("weeks_tracked"), F.lit(False).alias("is_new")))


def new_entrants(pop: DataFrame, periods: Sequence[date], granularity: str,
                 countries: Sequence[str] | None = None, absent: int = 3) -> DataFrame:
    """Rows of the newest period whose term is absent from the ``absent`` periods before it.

    Absence is judged by term alone, in every country and genre.
    """
    every = _scope(pop, granularity)
    newest = _scope(pop, granularity, countries)
    if len(periods) < absent + 1:
        newest, prior, now = _empty(newest), [_NEVER], _NEVER
    else:
        now, prior = periods[-1], list(periods[-(absent + 1):-1])
    seen = every.filter(F.col("period").isin(prior)).select("term").distinct()
    fresh = newest.filter(F.col("period") == F.lit(now)).join(seen, "term", "left_anti")
    return _movement_columns(fresh.select(
        *KEY, F.col("rank_in_genre").alias("rank_now"), F.lit(None).alias("rank_before"),
        F.col("pop_1to100").alias("popularity"), F.lit(0).alias("delta"),
        F.lit(0).alias("weeks_rising"), F.lit(0).alias("weeks_tracked"), F.lit(True).alias("is_new")))


def sustained_climb(pop: DataFrame, periods: Sequence[date], granularity: str,
                    countries: Sequence[str] | None = None, window: int = 4,
                    min_total_gain: int = 60) -> DataFrame:
    """Terms present in all of the last ``window + 1`` periods that rose in all but one step.

    The span is a fixed list of dates, so each rank becomes a column of one aggregation.
    """
    rows = _scope(pop, granularity, countries).filter(F.col("rank_in_genre").isNotNull())
    if len(periods) < window + 1:
        rows, span = _empty(rows), [_NEVER] * (window + 1)
    else:
        span = list(periods[-(window + 1):])
    ranks = [F.max(F.when(F.col("period") == F.lit(p), F.col("rank_in_genre"))).alias(f"r{i}")
             for i, p in enumerate(span)]
    wide = rows.filter(F.col("period").isin(span)).groupBy(*KEY).agg(
        *ranks, F.max(F.when(F.col("period") == F.lit(span[-1]), F.col("pop_1to100"))).alias("pop"))
    steps = [F.when(F.col(f"r{i + 1}") < F.col(f"r{i}"), 1).otherwise(0) for i in range(window)]
    rising = steps[0]
    for step in steps[1:]:
        rising = rising + step
    complete = wide.dropna(subset=[f"r{i}" for i in range(window + 1)]).select(
        *KEY, F.col(f"r{window}").alias("rank_now"), F.col("r0").alias("rank_before"),
        F.coalesce("pop", F.lit(0)).alias("popularity"),
        (F.col("r0") - F.col(f"r{window}")).alias("delta"), rising.alias("weeks_rising"),
        F.lit(window).alias("weeks_tracked"), F.lit(False).alias("is_new"))
    return _movement_columns(complete.filter(
        (F.col("delta") >= min_total_gain) & (F.col("weeks_rising") >= window - 1)))


def nearest_period(periods: Sequence[date], target: date, tolerance: int = 14) -> date | None:
    """The stored period closest to ``target``; the earlier one wins a tie."""
    if not periods:
        return None
    best = min(periods, key=lambda p: abs((p - target).days))
    return best if abs((best - target).days) <= tolerance else None


def with_seasonality(moves: DataFrame, pop: DataFrame, periods: Sequence[date], granularity: str,
                     span_days: int = 28) -> DataFrame:
    """Add ``seasonal``: did the same move happen a year ago? Null means it cannot be told.

    All movements are checked by one join with last year's two periods.
    """
    unknown = F.lit(None).cast("boolean")
    if len(periods) < 2:
        return moves.withColumn("seasonal", unknown)
    end = nearest_period(periods, periods[-1] - timedelta(days=364))
    start = nearest_period(periods, periods[-1] - timedelta(days=364 + span_days))
    if end is None or start is None or end == start:
        return moves.withColumn("seasonal", unknown)
    at = lambda p: F.max(F.when(F.col("period") == F.lit(p), F.col("rank_in_genre")))
    last_year = (
        _scope(pop, granularity).filter(F.col("period").isin(start, end))
        .groupBy(*KEY).agg((at(start) - at(end)).alias("_then"))
    )
    then, now = F.col("_then"), F.col("delta")
    same = (then > 0) == (now > 0)
    comparable = F.abs(then) >= F.greatest(F.abs(now) * 0.5, F.lit(30))
    flag = F.when((now == 0) | then.isNull(), unknown).when(then == 0, False).otherwise(same & comparable)
    return moves.join(last_year, KEY, "left").withColumn("seasonal", flag).drop("_then")


def trending_candidates(pop: DataFrame, periods: Sequence[date], granularity: str,
                        countries: Sequence[str] | None, limit: int, min_delta: int = 30,
                        min_total_gain: int = 60) -> DataFrame:
    """Newcomers, then sustained climbs, then movers; the first source wins per (term, country)."""
    parts = [
        new_entrants(pop, periods, granularity, countries).select(
            "*", F.lit(1).alias("tier"), F.col("rank_now").alias("place")),
        sustained_climb(pop, periods, granularity, countries, min_total_gain=min_total_gain).select(
            "*", F.lit(2).alias("tier"), (-F.col("delta")).alias("place")),
        rank_movement(pop, periods, granularity, countries, min_delta=min_delta).select(
            "*", F.lit(3).alias("tier"), (-F.col("delta")).alias("place")),
    ]
    pool = parts[0].unionByName(parts[1]).unionByName(parts[2])
    first = F.struct("tier", "place", "genre", F.coalesce("popularity", F.lit(0)).alias("popularity"))
    return (
        pool.groupBy("term", "country").agg(F.min(first).alias("m"))
        .select("term", "country", "m.popularity", "m.tier", "m.place", "m.genre")
        .orderBy("tier", "place", "term", "country", "genre").limit(limit)
    )


def band_candidates(pop: DataFrame, newest: date | None, granularity: str,
                    countries: Sequence[str] | None, low: int, high: int, limit: int) -> DataFrame:
    """Best popularity per (term, country) in the newest period, inside a band, largest first."""
    rows = _scope(pop, granularity, countries).filter(F.col("pop_1to100").between(low, high))
    rows = rows.filter(F.col("period") == F.lit(newest)) if newest else _empty(rows)
    return (
        rows.groupBy("term", "country").agg(F.max("pop_1to100").cast("int").alias("popularity"))
        .orderBy(F.desc("popularity"), "term", "country").limit(limit)
    )


def newest_popularity(pop: DataFrame, newest: date | None, granularity: str) -> DataFrame:
    """(term, country) -> popularity in the newest period; a missing row means unknown."""
    rows = _scope(pop, granularity)
    rows = rows.filter(F.col("period") == F.lit(newest)) if newest else _empty(rows)
    return rows.groupBy("term", "country").agg(F.max("pop_1to100").cast("int").alias("popularity"))


def adopt_terms(pop: DataFrame, keywords: DataFrame, countries: Sequence[str],
                min_popularity: int) -> DataFrame:
    """Terms that ever reached a popularity and are not keywords yet (any granularity)."""
    eligible = pop.filter((F.col("pop_1to100") >= min_popularity) & F.col("country").isin(*countries))
    best = eligible.groupBy("term", F.col("country").alias("storefront")).agg(
        F.max("pop_1to100").cast("int").alias("popularity"))
    return best.join(keywords.select("term", "storefront"), ["term", "storefront"], "left_anti")


def tail_candidates(pop: DataFrame, keywords: DataFrame, granularity: str,
                    countries: Sequence[str] | None, limit: int) -> DataFrame:
    """Needs named by the descriptive half of branded terms, not yet keywords.

    ``origin`` is the first term (alphabetically) that yields the tail.
    """
    named = (
        _scope(pop, granularity, countries).select("term", "country").distinct()
        .withColumn("tail", descriptor_tail(F.col("term"))).filter(F.col("tail").isNotNull())
    )
    known = keywords.select(F.col("term").alias("tail"), F.col("storefront").alias("country"))
    return (
        named.groupBy("tail", "country").agg(F.min("term").alias("origin"))
        .join(known, ["tail", "country"], "left_anti")
        .orderBy("tail", "country").limit(limit)
    )


def resume_plan(periods: DataFrame, genres: Sequence[str], pop: DataFrame, granularity: str) -> DataFrame:
    """(period, genre) pairs still to be pulled; what any country has counts as pulled."""
    stored = _scope(pop, granularity).select("period", "genre").distinct()
    wanted = periods.select("period", F.explode(words(genres)).alias("genre"))
    return wanted.join(stored, ["period", "genre"], "left_anti")


def stored_statistics(pop: DataFrame) -> DataFrame:
    return pop.agg(
        F.count("*").alias("n_rows"), F.count_distinct("term").alias("n_terms"),
        F.count_distinct("period").alias("n_periods"),
        F.min("period").alias("first_period"), F.max("period").alias("last_period"))


def largest_lists(pop: DataFrame, limit: int = 12) -> DataFrame:
    return (
        pop.groupBy("genre", "country").agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "genre", "country").limit(limit)
    )


def term_history(pop: DataFrame, term: str, granularity: str) -> DataFrame:
    return (
        _scope(pop, granularity).filter(F.col("term") == term.strip().lower())
        .select("country", "genre", "period", "rank_in_genre", "pop_1to100")
        .orderBy("country", "genre", "period")
    )


def ranked_scan(pop: DataFrame, countries: Sequence[str], genre: str, start: date, end: date,
                granularity: str, max_rows: int) -> DataFrame:
    """A genre's list for a period range, by rank, up to ``max_rows`` shared by all countries."""
    rows = _scope(pop, granularity, countries).filter(
        (F.col("genre") == genre) & F.col("period").between(F.lit(start), F.lit(end)))
    order = Window.partitionBy("genre", "period").orderBy(
        F.asc_nulls_last("rank_in_genre"), "country", "term")
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= max_rows)


def lookup(pop: DataFrame, terms: DataFrame, countries: Sequence[str], start: date, end: date,
           granularity: str, keep_unknown: bool = False) -> DataFrame:
    """Rows of the given terms. Absent is not zero: ``keep_unknown`` keeps them with nulls."""
    rows = _scope(pop, granularity, countries).filter(
        F.col("period").between(F.lit(start), F.lit(end)))
    return terms.select("term").distinct().join(rows, "term", "left" if keep_unknown else "inner")


def weekly_view(pop: DataFrame, periods: Sequence[date], granularity: str,
                countries: Sequence[str] | None, min_delta: int = 30) -> DataFrame:
    """Entrants, rising and falling terms in one table, movers marked for seasonality."""
    entrants = new_entrants(pop, periods, granularity, countries).select(
        F.lit("entrant").alias("section"), "*", F.lit(None).cast("boolean").alias("seasonal"))
    moves = with_seasonality(
        rank_movement(pop, periods, granularity, countries, min_delta=min_delta),
        pop, periods, granularity)
    moved = moves.select(
        F.when(F.col("delta") > 0, "rising").otherwise("falling").alias("section"), "*")
    return entrants.unionByName(moved)


def monthly_view(pop: DataFrame, periods: Sequence[date], granularity: str,
                 countries: Sequence[str] | None, min_total_gain: int = 60) -> DataFrame:
    """Sustained climbs, split into fresh and seasonal; unknown counts as fresh."""
    items = with_seasonality(
        sustained_climb(pop, periods, granularity, countries, min_total_gain=min_total_gain),
        pop, periods, granularity)
    seasonal = F.coalesce(F.col("seasonal"), F.lit(False))
    return items.select(F.when(seasonal, "seasonal").otherwise("fresh").alias("section"), "*")
