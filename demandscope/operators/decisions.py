"""Reviewer decisions: an append-only log in which the last word per term counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from demandscope.config import DECISION_VERDICTS, LATER_DAYS

CLEAR = "clear"


def split_by_vocabulary(decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected decisions by their verdict."""
    known = F.col("verdict").isin(*DECISION_VERDICTS)
    return decisions.filter(known), decisions.filter(~F.coalesce(known, F.lit(False)))


def for_known_terms(decisions: DataFrame, keywords: DataFrame) -> DataFrame:
    """Decisions about terms that are keywords in any storefront."""
    return decisions.join(keywords.select("term").distinct(), "term", "left_semi")


def undo(terms: DataFrame, at: Column) -> DataFrame:
    """Decisions that clear the given terms; append them to the log."""
    return terms.select("term", F.lit("all").alias("storefront"), at.alias("decided_at"),
                        F.lit(CLEAR).alias("verdict"), F.lit("").alias("reason"))


def last_decisions(decisions: DataFrame) -> DataFrame:
    """The last decision per term; equal times are settled by verdict."""
    last = F.max(F.struct("decided_at", "verdict"))
    return decisions.groupBy("term").agg(last.alias("_d")).select("term", "_d.verdict", "_d.decided_at")


def hidden_terms(decisions: DataFrame, as_of: Column, later_days: int = LATER_DAYS) -> DataFrame:
    """Terms that stay out of the lists, with the verdict that hides them.

    An expired ``later`` shows the term again, even after an earlier ``skip``.
    """
    expired = (F.col("verdict") == "later") & (
        F.col("decided_at") < as_of - F.make_dt_interval(F.lit(later_days)))
    return last_decisions(decisions).filter(~expired & (F.col("verdict") != CLEAR)).select("term", "verdict")


def summary(decisions: DataFrame) -> DataFrame:
    """Distinct terms per verdict over the whole log."""
    return (
        decisions.filter(F.col("verdict") != CLEAR).groupBy("verdict")
        .agg(F.count_distinct("term").alias("n_terms"))
    )


def reviewed(decisions: DataFrame, as_of: Column) -> DataFrame:
    """Hidden terms with the number of terms that ever got the same verdict."""
    return hidden_terms(decisions, as_of).join(summary(decisions), "verdict").orderBy("term")
