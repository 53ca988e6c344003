"""Readers of landed files and the reshaping of their records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from demandscope.functions.scalar import age_in_days, parse_stamp
from demandscope.functions.text import normalize_term, strip
from demandscope.schemas import RAW_APP, RAW_POPULARITY


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Landed JSON lines with a declared schema; a malformed record stops the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_app_records(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, RAW_APP)


def read_popularity(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, RAW_POPULARITY)


def flatten_apps(raw: DataFrame, taken_at: Column) -> DataFrame:
    """Raw app records to the fields the features use; ages are as of the snapshot."""
    description = strip(F.coalesce("description", F.lit("")))
    paid = F.coalesce(F.col("price") > 0, F.lit(False))
    updated = parse_stamp(F.col("currentVersionReleaseDate"))
    released = parse_stamp(F.col("releaseDate"))
    no_strings = F.array().cast("array<string>")
    return raw.select(
        F.col("trackId").alias("track_id"), F.col("bundleId").alias("bundle_id"),
        strip(F.coalesce("trackName", F.lit(""))).alias("title"),
        F.substring_index(description, "\n", 1).substr(1, 120).alias("subtitle"),
        F.col("sellerName").alias("seller"),
        F.coalesce("genres", no_strings).alias("genres"), F.col("primaryGenreName").alias("primary_genre"),
        F.col("averageUserRating").alias("rating"),
        F.coalesce("userRatingCount", F.lit(0)).cast("bigint").alias("rating_count"),
        "price", paid.alias("is_paid"),
        F.coalesce(F.array_contains("advisories", "In-App Purchases"), F.lit(False)).alias("has_iap"),
        paid.alias("is_monetized"),
        updated.alias("updated_at"), released.alias("released_at"),
        age_in_days(updated, taken_at).alias("days_since_update"),
        age_in_days(released, taken_at).alias("age_days"),
        F.coalesce("languageCodesISO2A", no_strings).alias("languages"),
        F.col("contentAdvisoryRating").alias("content_rating"),
    )


def decode_suggestions(landed: DataFrame) -> DataFrame:
    """Suggestion payloads (``payload`` JSON text) to one row per usable suggestion.

    Accepted: an object with ``hints``, one with ``suggestions``, or a bare list; entries
    are strings or objects with ``term``. The place counts dropped entries too.
    """
    payload = F.try_parse_json("payload")
    strings = "array<string>"
    # an array element that is an object comes back as its JSON text
    listed = F.coalesce(
        F.when(F.col("payload").rlike(r"^\s*\["), F.from_json("payload", strings)),
        F.from_json(F.get_json_object("payload", "$.hints"), strings),
        F.from_json(F.get_json_object("payload", "$.suggestions"), strings),
    )
    term = F.when(
        F.col("entry").startswith("{"), F.get_json_object("entry", "$.term")
    ).otherwise(F.col("entry"))
    return (
        landed.filter(payload.isNotNull())
        .select(*[c for c in landed.columns if c != "payload"],
                F.posexplode(listed).alias("_at", "entry"))
        .select("*", normalize_term(term).alias("term"), (F.col("_at") + 1).alias("position"))
        .filter(F.length("term") > 2)
        .drop("_at", "entry")
    )


def parse_popularity(raw: DataFrame, granularity: str, pulled_at: Column) -> DataFrame:
    """Popularity records to table rows; rows without a term are dropped."""
    period = F.coalesce(F.nullif("week", F.lit("")), F.nullif("month", F.lit("")))
    return raw.select(
        strip(F.lower("searchTerm")).alias("term"), F.lower("countryOrRegion").alias("country"),
        F.coalesce("genre", F.lit("")).alias("genre"), F.try_to_date(period).alias("period"),
        F.lit(granularity).alias("granularity"),
        F.col("rankInGenre").alias("rank_in_genre"), F.col("searchPopularityInGenre").alias("pop_in_genre"),
        F.col("searchPopularity1to100").alias("pop_1to100"), F.col("searchPopularity1to5").alias("pop_1to5"),
        pulled_at.alias("pulled_at"),
    ).filter(F.coalesce("term", F.lit("")) != "")


def find_column(columns: list[str], *patterns: str) -> str | None:
    """First column containing a pattern; earlier patterns win."""
    return next((c for p in patterns for c in columns if p in c.lower()), None)


# Name fragments of the columns of an exported fact table.
FACT_PATTERNS = {
    "term": ("keyword", "term", "name", "text"),
    "popularity": ("popularity", "volume", "traffic"),
    "difficulty": ("difficulty", "competition"),
    "rank": ("currentrank", "rank", "position"),
    "storefront": ("store", "country"),
}


def project_facts(rows: DataFrame, loaded_at: Column, storefront: str = "us") -> DataFrame:
    """Ground-truth facts from any table, its columns found by name fragments."""
    found = {name: find_column(rows.columns, *p) for name, p in FACT_PATTERNS.items()}
    if found["term"] is None:
        raise ValueError(f"no column names a term: {rows.columns}")
    pick = lambda n: F.col(f"`{found[n]}`") if found[n] else F.lit(None)
    return rows.select(
        strip(F.lower(pick("term").cast("string"))).alias("term"),
        strip(F.lower(F.coalesce(pick("storefront").cast("string"), F.lit(storefront)))).alias("storefront"),
        loaded_at.alias("loaded_at"),
        pick("popularity").cast("double").alias("popularity"),
        pick("difficulty").cast("double").alias("difficulty"), pick("rank").cast("int").alias("rank"),
    ).filter(F.coalesce("term", F.lit("")) != "")
