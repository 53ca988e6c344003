"""Model input columns and the validation of model replies.

The model itself is the user's: hand these columns to any service and feed the reply
text back. Replies are data, checked against fixed vocabularies.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from demandscope.config import REPLY_CATEGORIES, REPLY_INTENTS
from demandscope.functions.scalar import round_half_up
from demandscope.functions.text import strip, tokens


def reply_json(reply: Column) -> Column:
    """The JSON text inside a reply: reasoning and code fences removed, else the outer span."""
    bare = strip(F.regexp_replace(
        F.regexp_replace(reply, r"(?s)<think>.*?</think>", ""), r"```(?:json)?", ""))
    span = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(bare).isNotNull() & bare.rlike(r"^\s*[\{\[]"), bare).when(
        (span != "") & F.try_parse_json(span).isNotNull(), span)


def parse_verdicts(replies: DataFrame) -> DataFrame:
    """Replies (``term, storefront, reply``) to verdict columns plus ``accepted``."""
    field = lambda name: F.get_json_object("_json", f"$.{name}")
    has = lambda name: F.array_contains(F.json_object_keys("_json"), name)
    category = F.lower(strip(field("category")))
    intent = F.lower(strip(field("intent")))
    confidence = F.expr("try_cast(get_json_object(_json, '$.confidence') as double)")
    accepted = F.coalesce(
        F.col("_json").startswith("{") & category.isin(*REPLY_CATEGORIES) & has("intent") & has("confidence"),
        F.lit(False))
    return (
        replies.withColumn("_json", reply_json(F.col("reply")))
        .withColumn("accepted", accepted)
        .select(
            "term", "storefront", "accepted",
            F.when(F.col("accepted"), category).alias("category"),
            F.when(F.col("accepted"), F.when(intent.isin(*REPLY_INTENTS), intent)
                   .otherwise("transactional")).alias("intent"),
            F.when(F.col("accepted"), F.when(confidence.isNull(), 0.5).otherwise(
                F.greatest(F.lit(0.0), F.least(confidence, F.lit(1.0))))).alias("confidence"),
            F.when(F.col("accepted"), F.coalesce(F.nullif(field("niche_name"), F.lit("")), F.col("term"))
                   .substr(1, 60)).alias("niche_name"),
            F.when(F.col("accepted"), F.coalesce(field("note"), F.lit("")).substr(1, 200)).alias("note"))
    )


def with_defaults(verdicts: DataFrame) -> DataFrame:
    """Stored verdicts with the defaults readers rely on."""
    text = lambda c, d: F.coalesce(F.nullif(F.col(c), F.lit("")), d).alias(c)
    return verdicts.select(
        "term", "storefront", text("category", F.lit("niche")), text("intent", F.lit("transactional")),
        text("monetization", F.lit("unclear")), text("niche_name", F.col("term")),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("note", F.lit("")).alias("note"))


def parse_proposals(replies: DataFrame, limit: int = 8) -> DataFrame:
    """Proposal replies (``source_term, storefront, reply``) to the first usable queries.

    Usable: two words or more, at most 60 characters, not repeated within the reply. All of
    it happens inside the reply's row.
    """
    ideas = F.from_json(F.get_json_object("_json", "$.ideas"), "array<struct<query: string, why: string>>")
    trimmed = F.transform(ideas, lambda i: F.struct(
        F.lower(strip(i["query"])).alias("query"),
        F.coalesce(i["why"], F.lit("")).substr(1, 160).alias("why")))
    usable = F.filter(trimmed, lambda i: (F.size(tokens(i["query"])) >= 2) & (F.length(i["query"]) <= 60))
    first = lambda i, at: F.array_position(F.col("_queries"), i["query"]) == at + 1
    return (
        replies.withColumn("_json", reply_json(F.col("reply")))
        .withColumn("_ideas", usable)
        .withColumn("_queries", F.transform("_ideas", lambda i: i["query"]))
        .select("source_term", "storefront", F.posexplode(
            F.slice(F.filter("_ideas", first), 1, limit)).alias("_p", "i"))
        .select("source_term", "storefront", (F.col("_p") + 1).alias("place"), "i.query", "i.why")
    )


def one_line(text: Column, limit: int) -> Column:
    return F.translate(F.coalesce(text, F.lit("?")).substr(1, limit), "\n", " ")


def price_text(price: Column) -> Column:
    return F.when(price > 0, F.concat(F.lit("paid $"), F.format_string("%.2f", price), F.lit(" upfront"))) \
        .otherwise("free to download")


def classifier_input(niches: DataFrame) -> DataFrame:
    """One text per niche head: its first six results and what is known about it.

    Needs ``term, storefront, apps, top1_name_match, variants`` (an array).
    """
    six = F.slice("apps", 1, 6)
    line = lambda a, i: F.concat(
        F.lit("  "), (i + 1).cast("string"), F.lit('. "'), one_line(a["title"], 70), F.lit('" by '),
        one_line(a["seller"], 40), F.lit(" — "), F.format_string("%.1f", F.coalesce(a["rating"], F.lit(0.0))),
        F.lit(" stars, "), F.coalesce(a["rating_count"], F.lit(0)).cast("string"), F.lit(" ratings, "),
        price_text(a["price"]))
    paid = F.size(F.filter(six, lambda a: F.coalesce(a["price"] > 0, F.lit(False))))
    others = F.slice("variants", 1, 6)
    text = F.array_join(F.array_compact(F.flatten(F.array(
        F.array(F.concat(F.lit('Query: "'), F.col("term"), F.lit('"')),
                F.concat(F.lit("Storefront: "), F.upper("storefront"))),
        F.transform(six, line),
        F.array(
            F.concat(F.lit("Of the top "), F.size(six).cast("string"), F.lit(", "), paid.cast("string"),
                     F.lit(" charge upfront.")),
            F.concat(F.lit("Name similarity between the query and result #1: "),
                     round_half_up(F.col("top1_name_match") * 100, 0).cast("int").cast("string"), F.lit("/100.")),
            F.when(F.size(others) > 0, F.concat(
                F.lit("Other queries with the same results: "),
                F.array_join(F.transform(others, lambda v: F.concat(F.lit('"'), v, F.lit('"'))), ", "))),
        )))), "\n")
    return niches.select("term", "storefront", paid.alias("n_paid"), text.alias("model_input"))


def apply_model(inputs: DataFrame, score_batch: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> DataFrame:
    """Run a user's own classifier over Arrow batches; it yields ``term, storefront, reply``."""
    return inputs.mapInPandas(score_batch, "term string, storefront string, reply string")


def labelled_lists(cases: DataFrame) -> DataFrame:
    """A three-item list per labelled case (``query, title, seller, rating, reviews``)."""
    item = lambda title, seller, rating, count: F.struct(
        title.alias("title"), seller.alias("seller"), rating.alias("rating"),
        count.cast("bigint").alias("rating_count"), F.lit(0.0).alias("price"))
    part = lambda d, least: F.greatest(F.floor(F.col("reviews") / d), F.lit(least))
    return cases.select("query", "expected", F.array(
        item(F.col("title"), F.col("seller"), F.col("rating"), F.col("reviews")),
        item(F.lit("Another App"), F.lit("Someone Else"), F.lit(4.2), part(20, 100)),
        item(F.lit("Third Option"), F.lit("Third Dev"), F.lit(4.0), part(60, 50))).alias("apps"))


def evaluate(results: DataFrame, majority: str) -> DataFrame:
    """Hits per expected class, and totals against always answering ``majority``.

    ``results`` holds ``expected, got``. The verdict column compares the total with that
    baseline and with 80 percent.
    """
    table = results.groupBy("expected", "got").agg(F.count("*").alias("n"))
    right = F.sum(F.when(F.col("expected") == F.col("got"), F.col("n")).otherwise(0))
    rows = table.rollup("expected").agg(
        F.sum("n").alias("n_cases"), right.alias("n_hits"),
        F.sum(F.when(F.col("expected") == majority, F.col("n")).otherwise(0)).alias("n_majority"))
    conclusion = (
        F.when(F.col("expected").isNotNull(), None)
        .when(F.col("n_hits") <= F.col("n_majority"), "no better than the majority class")
        .when(F.col("n_hits") >= F.col("n_cases") * 0.8, "separates the classes")
        .otherwise("partly useful"))
    return rows.select(
        F.coalesce("expected", F.lit("(all)")).alias("expected"), "n_cases", "n_hits",
        F.when(F.col("expected").isNull(), F.col("n_majority")).alias("n_majority"),
        conclusion.alias("conclusion"))
