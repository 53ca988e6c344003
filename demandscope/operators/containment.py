"""The first texts that contain a word, inside one of their own words."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from demandscope.operators.ranking import rank_within
from demandscope.operators.series import newest_rows
from demandscope.session import Staged, stage

GRAM = 3   # letters by which tokens and words meet
HEAD = 64  # texts that a token meets first, for each text wanted
FEW = 64   # tokens up to which every text is asked for each of them before its words are listed


def _grams(word: str, k: int):
    """The different stretches of ``k`` letters of a column; none of a shorter word."""
    last = F.length(word) - (k - 1)
    return F.when(last >= 1, F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.col(word).substr(i, F.lit(k))))).otherwise(
        F.array().cast("array<string>"))


def holding_words(wanted: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(storefront, word, token): the words of the vocabulary that have a wanted ``token`` inside.

    A token meets the words on its rarest stretch of three letters (a shorter token on itself). A token with a
    stretch that no word has is in no word.
    """
    tokens = wanted.select("storefront", "token").distinct().filter(F.col("token") != "")
    own = F.when(F.length("token") < GRAM, F.array("token")).otherwise(_grams("token", GRAM))
    asked = stage(tokens.select("storefront", "token", F.explode(own).alias("_gram")), "token-grams")
    grams = vocabulary.select("storefront", "word", F.explode(F.array_distinct(F.concat(
        *(_grams("word", k) for k in range(1, GRAM + 1))))).alias("_gram"))
    met = stage(grams.join(asked.select("storefront", "_gram").distinct(), ["storefront", "_gram"], "left_semi"), "word-grams")
    counts = met.groupBy("storefront", "_gram").agg(F.count("*").alias("_n"))
    rarest = asked.join(counts, ["storefront", "_gram"], "left").groupBy("storefront", "token").agg(
        F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("_n"), "_gram")).alias("_best")).select(
        "storefront", "token", F.col("_best._gram").alias("_gram"))
    return rarest.join(met, ["storefront", "_gram"]).filter(F.col("word").contains(F.col("token"))).select(
        "storefront", "word", "token")


def _with_any(rows: DataFrame, column: Column, few: list[str] | None) -> DataFrame:
    """The rows that have one of a few tokens in a column; all rows when there are more."""
    return rows if few is None else rows.filter(reduce(Column.__or__, (column.contains(t) for t in few), F.lit(False)))


def _few(tokens: DataFrame) -> list[str] | None:
    """The different tokens, if they are few."""
    found = [r.token for r in tokens.select("token").distinct().limit(FEW + 1).collect()]
    return [t for t in found if t] if len(found) <= FEW else None


def _first_of(tokens: DataFrame, numbered: DataFrame, text: str, limit: int) -> DataFrame:
    """(storefront, token, _number, _place): the first ``limit`` of the numbered texts for each token.

    Each word keeps only its first ``limit`` texts, which suffices: a text that is among the first of a token is among
    the first of the word that holds the token. So what meets a token is ``limit`` rows for each such word.
    """
    few = _few(tokens)
    holding = _with_any(numbered, F.lower(text), few)
    parts = _with_any(holding.select("storefront", "_number", F.explode(F.array_distinct(F.split(F.lower(text), " "))).alias("word")),
                      F.col("word"), few)
    words = stage(holding_words(tokens, parts.select("storefront", "word").distinct()), "holding-words")
    listed = parts.join(words.select("storefront", "word").distinct(), ["storefront", "word"], "left_semi")
    ahead = newest_rows(listed, ["storefront", "word"], [F.asc("_number")], limit).drop("_place")
    united = ahead.join(words, ["storefront", "word"]).select("storefront", "token", "_number").distinct()
    return newest_rows(united, ["storefront", "token"], [F.asc("_number")], limit)


def first_containing(wanted: DataFrame, texts: DataFrame, text: str, order: list[str], limit: int,
                     head: int = HEAD) -> DataFrame:
    """(storefront, token, ``order``, place): for each ``token`` (no spaces in it) the first ``limit`` texts with it somewhere.

    ``texts`` has one row per (storefront, ``text``), compared in lower case; ``order`` names columns that sort them, the
    text itself last. Texts are numbered in their order first, so only numbers are joined and compared. A token is looked
    for in the first ``head * limit`` texts, then in ``head`` times as many, at last in all; it is done as soon as it has
    ``limit`` texts. So a token that most words hold meets the words of a few texts, and what goes on to more texts is rare.
    """
    ranked = rank_within(texts.select("storefront", *order), ["storefront"], [F.asc(c) for c in order], "_number")
    numbered = Staged(ranked, "numbered-texts", last=F.max("_number"))
    left = stage(wanted.select("storefront", "token").distinct(), "tokens")
    first, reach = [], head * limit
    while reach < (numbered.metrics["last"] or 0):
        hits = stage(_first_of(left, numbered.df.filter(F.col("_number") <= reach), text, limit), "first-texts")
        done = hits.filter(F.col("_place") == limit).select("storefront", "token")
        first.append(hits.join(done, ["storefront", "token"], "left_semi"))
        left = stage(left.join(done, ["storefront", "token"], "left_anti"), "tokens")
        reach *= head
    first.append(_first_of(left, numbered.df, text, limit))
    return reduce(DataFrame.unionByName, first).join(numbered.df, ["storefront", "_number"]).select(
        "storefront", "token", *order, F.col("_place").alias("place"))
