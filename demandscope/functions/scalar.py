"""Small numeric, date and formatting expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from demandscope import labels
from demandscope.config import THRESHOLDS


def round_half_up(value: Column, digits: int) -> Column:
    """Half-up rounding on the double itself, so every engine agrees on ties."""
    unit = float(10 ** digits)
    return F.floor(value * unit + 0.5) / unit


def age_in_days(stamp: Column, as_of: Column) -> Column:
    """Whole 24-hour days between two timestamps, never negative; null when unknown."""
    seconds = F.unix_timestamp(as_of) - F.unix_timestamp(stamp)
    # greatest() ignores nulls, so the unknown case is kept apart
    return F.when(seconds.isNotNull(), F.greatest(F.floor(seconds / 86400), F.lit(0)).cast("int"))


def parse_stamp(text: Column) -> Column:
    """ISO timestamp (``Z`` or offset, else UTC); null when it does not parse."""
    return F.try_to_timestamp(text)


def apple_epoch(seconds: Column) -> Column:
    """Seconds since 2001-01-01 UTC as a timestamp."""
    return F.timestamp_seconds(seconds + F.lit(978_307_200))


def install_estimate(weekly_delta: Column) -> Column:
    """Monthly installs implied by the leader's weekly review gain; null stays null."""
    weekly = weekly_delta * THRESHOLDS.review_to_install_multiplier
    return (weekly * 4.33).cast("bigint")


def direction(old: Column, new: Column, band: float = 0.15) -> Column:
    """Arrow for a change, flat inside a relative dead band."""
    change = (new - old) / F.abs(old)
    return (
        F.when(old <= 0, F.when(new <= 0, labels.FLAT).otherwise(labels.UP))
        .when(change > band, labels.UP)
        .when(change < -band, labels.DOWN)
        .otherwise(labels.FLAT)
    )


def score_band(score: Column) -> Column:
    return (
        F.when(score >= 60, labels.BAND_STRONG)
        .when(score >= 35, labels.BAND_MEDIUM)
        .otherwise(labels.BAND_WEAK)
    )


def short_count(n: Column) -> Column:
    """``12k`` from a thousand up, the plain number below."""
    return F.when(n >= 1000, F.concat((n / 1000).cast("bigint").cast("string"), F.lit("k"))).otherwise(
        n.cast("string"))


def tenths(share: Column) -> Column:
    """A share as ``n/10``."""
    return F.concat(F.floor(share * 10 + 0.5).cast("string"), F.lit("/10"))


def signed_percent(value: Column) -> Column:
    whole = F.floor(F.abs(value) + 0.5).cast("bigint")
    sign = F.when(value < 0, "-").otherwise("+")
    return F.concat(sign, whole.cast("string"), F.lit("%"))


def key_of_largest(names: list[str], values: list[Column]) -> Column:
    """Name of the largest value; the first one wins a tie."""
    ranked = F.array(*[
        F.struct(v.alias("value"), F.lit(-i).alias("place"), F.lit(n).alias("name"))
        for i, (n, v) in enumerate(zip(names, values))
    ])
    return F.array_max(ranked)["name"]
