"""The registered queries: each runs one operator family over the driver's tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from demandscope.functions import calendar
from demandscope.functions.similarity import brand_signal, name_match, token_set_ratio
from demandscope.functions.scalar import apple_epoch, round_half_up
from demandscope.functions.text import (
    content_tokens, descriptor_tail, eligible_head, is_giant, links_allowed, looks_like_brand,
    normalize_term, root_matches, singularize, squash, title_head, tokens,
)
from demandscope.operators import (
    asof, decisions as D, graph, lexicon, overlap, popularity as P, proposals as PR, replies as R,
    series as S, storefronts, variants,
)
from demandscope.operators.features import fingerprint, leader_id, with_features
from demandscope.operators.rating import with_rating
from demandscope.operators.scoring import FACTORS, headline_reason
from demandscope.plans import bindings as B, collect as C, niches as N, rescore as RS
from demandscope.session import stage, staging_root
from demandscope.sources import landing, stores, tables
from demandscope.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

GENRES = ("economy", "large", "medium", "promo", "small", "standard", "luxury")


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def _events_as_of() -> Column:
    return F.lit(B.EVENTS_AS_OF).cast("timestamp")


def _stored(pop: DataFrame, granularity: str) -> tuple[DataFrame, list[date]]:
    """A popularity table as it would be stored, and its periods."""
    kept = stage(pop, "popularity")
    return kept, P.period_list(kept, granularity)


def _text(column: str, sep: str = ",") -> Column:
    return F.array_join(column, sep).alias(column)


def _r6(column: str) -> Column:
    return round_half_up(F.col(column), 6).alias(column)


# --- popularity ---------------------------------------------------------------------------

@query
def rank_movement(spark, sf):
    pop, periods = _stored(B.popularity(spark, sf), "MONTHLY")
    return P.rank_movement(pop, periods, "MONTHLY", min_delta=10).orderBy(F.desc("delta"), *P.KEY)


@query
def rank_movement_by_genre(spark, sf):
    pop, periods = _stored(B.popularity_by_genre(spark, sf), "QUARTERLY")
    return P.rank_movement(pop, periods, "QUARTERLY", ["ASIA", "Europe"], lookback=2, min_delta=10)


@query
def new_entrants(spark, sf):
    pop, periods = _stored(B.popularity_fine(spark, sf), "MONTHLY")
    return P.new_entrants(pop, periods, "MONTHLY", ["asia", "europe", "america"]).orderBy("rank_now", *P.KEY)


@query
def sustained_climb(spark, sf):
    pop, periods = _stored(B.popularity(spark, sf), "MONTHLY")
    return P.sustained_climb(pop, periods, "MONTHLY", min_total_gain=10)


@query
def seasonality(spark, sf):
    pop, periods = _stored(B.popularity(spark, sf), "MONTHLY")
    moves = P.rank_movement(pop, periods, "MONTHLY", min_delta=5)
    return P.with_seasonality(moves, pop, periods, "MONTHLY").select(*P.KEY, "delta", "seasonal")


@query
def weekly_trend_view(spark, sf):
    pop, periods = _stored(B.popularity_by_genre(spark, sf), "QUARTERLY")
    return P.weekly_view(pop, periods, "QUARTERLY", None, min_delta=10).select(
        "section", *P.KEY, "rank_now", "delta", "seasonal")


@query
def monthly_trend_view(spark, sf):
    pop, periods = _stored(B.popularity_by_genre(spark, sf), "QUARTERLY")
    return P.monthly_view(pop, periods, "QUARTERLY", None, min_total_gain=10).select(
        "section", *P.KEY, "rank_now", "delta", "weeks_rising", "seasonal")


@query
def trending_union(spark, sf):
    pop, periods = _stored(B.popularity_by_genre(spark, sf), "QUARTERLY")
    return P.trending_candidates(pop, periods, "QUARTERLY", None, limit=40, min_delta=10, min_total_gain=10).select(
        "term", "country", "popularity", "tier")


@query
def term_history(spark, sf):
    return P.term_history(B.popularity(spark, sf), " Red Widget ", "MONTHLY")


@query
def distinct_periods(spark, sf):
    return P.period_table(B.popularity_by_genre(spark, sf), "QUARTERLY")


@query
def popularity_statistics(spark, sf):
    return P.stored_statistics(B.popularity_by_genre(spark, sf))


@query
def largest_lists(spark, sf):
    return P.largest_lists(B.popularity_by_genre(spark, sf))


@query
def popularity_band(spark, sf):
    pop, periods = _stored(B.popularity_by_genre(spark, sf), "QUARTERLY")
    return P.band_candidates(pop, periods[-1] if periods else None, "QUARTERLY", None, 45, 65, 200)


@query
def adopt_terms(spark, sf):
    keywords = B.keywords(spark, sf).select(
        F.concat(F.lit("part "), F.col("first_part").cast("string")).alias("term"),
        F.when(F.col("storefront") == "us", "asia").otherwise("europe").alias("storefront"))
    return P.adopt_terms(B.popularity_fine(spark, sf), keywords, ["asia", "europe"], 95)


@query
def resume_plan(spark, sf):
    pop = B.popularity_by_genre(spark, sf)
    last = B.table(spark, sf, "orders").agg(F.max(F.col("o_orderdate").cast("date")).alias("d"))
    quarters = last.select(F.explode(calendar.completed_months(F.col("d"), 24)).alias("p")).select(
        F.trunc("p.period_start", "quarter").alias("period")).distinct()
    return P.resume_plan(quarters, GENRES, pop, "QUARTERLY")


@query
def completed_weeks(spark, sf):
    """Orders per completed Sunday-to-Saturday week before the newest order."""
    orders = B.table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("d"))
    weekly = orders.groupBy(calendar.week_start(F.col("d")).alias("period_start")).agg(F.count("*").alias("n"))
    weeks = orders.agg(F.max("d").alias("d")).select(
        F.explode(calendar.completed_weeks(F.col("d"), 26)).alias("w")).select("w.period_start", "w.period_end")
    return weeks.join(weekly, "period_start", "left").select(
        "period_start", "period_end", F.coalesce("n", F.lit(0)).alias("n"))


@query
def completed_months(spark, sf):
    orders = B.table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("d"))
    monthly = orders.groupBy(F.trunc("d", "month").alias("period_start")).agg(F.count("*").alias("n"))
    months = orders.agg(F.max("d").alias("d")).select(
        F.explode(calendar.completed_months(F.col("d"), 13)).alias("m")).select("m.period_start", "m.period_end")
    return months.join(monthly, "period_start", "left").select(
        "period_start", "period_end", F.coalesce("n", F.lit(0)).alias("n"))


@query
def ranked_scan(spark, sf):
    return P.ranked_scan(B.popularity_by_genre(spark, sf), ["asia", "africa"], "promo", date(1999, 1, 1),
                         date(2000, 12, 31), "QUARTERLY", 25).select("term", "country", "period", "rank_in_genre", "place")


@query
def popularity_lookup(spark, sf):
    wanted = B.table(spark, sf, "part").select(F.col("p_name").alias("term")).filter(
        F.col("term").startswith("hot")).distinct().union(spark.createDataFrame([("unheard of",)], "term string"))
    return P.lookup(B.popularity(spark, sf), wanted, ["asia"], date(2000, 1, 1), date(2000, 12, 31), "MONTHLY",
                    keep_unknown=True).select("term", "country", "period", "rank_in_genre", "pop_1to100")


def _raw_popularity(spark, sf):
    return _raw_popularity_of(B.table(spark, sf, "part"))


def _raw_popularity_of(parts):
    part = F.col("p_partkey")
    return parts.select(
        F.when(part % 10 == 9, " ").otherwise(F.concat(F.lit(" "), F.initcap("p_name"))).alias("searchTerm"),
        F.when(part % 2 == 0, "US").otherwise("GB").alias("countryOrRegion"), F.col("p_type").alias("genre"),
        F.when(part % 3 == 0, F.date_add(F.lit(date(2001, 1, 7)), (part % 4 * 7).cast("int")).cast("string"))
        .otherwise("").alias("week"),
        F.when(part % 3 == 1, "2001-02-01").alias("month"), (part % 500 + 1).cast("int").alias("rankInGenre"),
        F.lit(None).cast("int").alias("searchPopularityInGenre"), F.col("p_size").alias("searchPopularity1to100"),
        (F.col("p_size") % 5 + 1).cast("int").alias("searchPopularity1to5"))


@query
def popularity_parse(spark, sf):
    parsed = landing.parse_popularity(_raw_popularity(spark, sf), "WEEKLY_SUN_SAT", F.lit(B.AS_OF).cast("timestamp"))
    return parsed.groupBy("term", "country", "genre", "period").agg(
        F.count("*").alias("n"), F.min("rank_in_genre").alias("best_rank"), F.max("pop_1to5").alias("pop_1to5"))


@query
def popularity_upsert(spark, sf):
    parsed = landing.parse_popularity(
        _raw_popularity(spark, sf), "WEEKLY_SUN_SAT",
        F.lit(B.AS_OF).cast("timestamp") + F.make_dt_interval(F.lit(0), F.col("rankInGenre")))
    early, late = F.col("rank_in_genre") <= 250, F.col("rank_in_genre") > 250
    return tables.last_wins(parsed.filter(early), parsed.filter(late),
                            ["term", "country", "genre", "period", "granularity"],
                            ["pulled_at", "pop_1to100"]).select(
        "term", "country", "genre", "period", "pop_1to100",
        F.date_diff(F.col("pulled_at").cast("date"), F.lit(B.AS_OF)).alias("pulled_day"))


@query
def descriptor_tails(spark, sf):
    """Titles as branded terms; the tail, and the first title it came from."""
    named = B.table(spark, sf, "pages").select(
        "page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title")).withColumn(
        "term", F.lower(F.concat(F.array_join(F.slice(F.split("title", " "), 1, 2), " "),
                                 F.element_at(F.array(*[F.lit(s) for s in (" - ", ": ", " – ", ", ", " ")]),
                                              (F.col("page_id") % 5 + 1).cast("int")),
                                 F.array_join(F.slice(F.split("title", " "), F.lit(3), F.size(F.split("title", " "))), " "))))
    return named.withColumn("tail", descriptor_tail(F.col("term"))).filter(F.col("tail").isNotNull()).groupBy(
        "tail").agg(F.min_by("term", F.struct("page_id", "term")).alias("origin"), F.count("*").alias("n"))


@query
def tail_candidates(spark, sf):
    """Supplier titles as popular terms; tails that are not keywords yet."""
    terms = B.items(spark, sf).select(
        F.lower("title").alias("term"), F.lit("us").alias("country"), F.lit("WEEKLY_SUN_SAT").alias("granularity"))
    known = B.table(spark, sf, "part").filter(F.col("p_partkey") % 2 == 0).select(
        F.col("p_name").alias("term"), F.lit("us").alias("storefront"))
    return P.tail_candidates(terms, known, "WEEKLY_SUN_SAT", ["us"], 500)


# --- text and lexicon ---------------------------------------------------------------------

@query
def term_normalize(spark, sf):
    lines = B.table(spark, sf, "documents").select("lang", F.explode(F.split("text", "\n")).alias("raw"))
    return lines.select("lang", normalize_term(F.col("raw")).alias("term")).groupBy("lang", "term").agg(
        F.count("*").alias("n"))


@query
def token_forms(spark, sf):
    """Distinct tokens of normalised suggestions with their singular."""
    return B.suggestions(spark, sf).select(F.explode(tokens(F.col("term"))).alias("token")).groupBy("token").agg(
        F.count("*").alias("n")).select("token", singularize(F.col("token")).alias("singular"), "n")


@query
def term_flags(spark, sf):
    """Predicates and token forms of every keyword and suggestion term."""
    words = B.keywords(spark, sf).select("term").union(B.suggestions(spark, sf).select("term")).union(
        B.titles(spark, sf).select("term")).distinct()
    term = F.col("term")
    return words.select(
        "term", looks_like_brand(term).alias("brand_hint"), eligible_head(term).alias("can_lead"),
        links_allowed(term).alias("can_link"), squash(term).alias("squashed"),
        F.array_join(content_tokens(term), " ").alias("content"))


@query
def seller_flags(spark, sf):
    return B.items(spark, sf).select(
        "track_id", is_giant(F.col("seller")).alias("giant"), F.trim(title_head(F.col("title"))).alias("head"))


@query
def decode_suggestions(spark, sf):
    return landing.decode_suggestions(B.payloads(spark, sf)).groupBy("storefront", "term").agg(
        F.count("*").alias("n"), F.min("position").alias("position"))


@query
def root_match(spark, sf):
    """Whole-word root matches between the lines of a turn and the turn's first word."""
    rows = B.table(spark, sf, "conversations").select(
        "conv_id", "turn", F.lower(F.split_part(normalize_term(F.col("text")), F.lit(" "), F.lit(1))).alias("root"),
        F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    return rows.select("conv_id", "turn", "line", root_matches(F.col("root"), normalize_term(F.col("raw"))).alias("matches"))


@query
def best_positions(spark, sf):
    return lexicon.best_positions(B.suggestions(spark, sf))


@query
def harvest_objects(spark, sf):
    return lexicon.harvest_objects(B.suggestions(spark, sf))


@query
def token_frequency(spark, sf):
    return lexicon.token_frequency(B.suggestions(spark, sf))


@query
def discover_verbs(spark, sf):
    return lexicon.discover_verbs(B.suggestions(spark, sf), min_distinct=2)


def _evidence(spark, sf):
    runs = B.suggestion_rows(spark, sf).select(
        "storefront", "term", (F.col("doc_id") % 7).alias("run_id"))
    found = F.struct("storefront", "run_id")
    per_run = lexicon.discover_verbs(runs.select(found.alias("storefront"), "term"), min_distinct=2)
    return lexicon.verb_evidence(per_run.select("verb", F.col("storefront.run_id").alias("run_id")))


@query
def promotable_verbs(spark, sf):
    return lexicon.promotable_verbs(_evidence(spark, sf))


@query
def probe_ledger(spark, sf):
    return lexicon.probe_ledger(B.suggestions(spark, sf)).select(
        "prefix", "storefront", F.col("probed_at").cast("date").alias("probed_on"), "yield_count")


def _frontier(spark, sf):
    """Ledger and objects of all suggestions, as those of one storefront."""
    rows = B.suggestions(spark, sf).withColumn("storefront", F.lit("all"))
    return lexicon.probe_ledger(rows).select("prefix", "probed_at", "yield_count"), lexicon.token_frequency(rows).select("token", "n")


@query
def frontier_top(spark, sf):
    ledger, objects = _frontier(spark, sf)
    return lexicon.next_probes(objects, ledger, 50)


@query
def stalest_prefixes(spark, sf):
    ledger, _ = _frontier(spark, sf)
    return lexicon.stalest(ledger, F.lit(date(2024, 2, 15)).cast("timestamp"), 30).select("prefix")


@query
def plan_roots(spark, sf):
    ledger, objects = _frontier(spark, sf)
    ledger = stage(ledger, "ledger")  # every tier of the plan reads it
    return lexicon.plan_roots(ledger, _evidence(spark, sf), objects, F.lit(date(2024, 4, 15)).cast("timestamp"), 120)


@query
def probe_prefixes(spark, sf):
    roots = B.suggestions(spark, sf).select(F.col("prefix").alias("root")).distinct()
    return lexicon.probe_prefixes(roots, deep=True)


@query
def metadata_tokens(spark, sf):
    return lexicon.metadata_tokens(B.lists(spark, sf))


@query
def related_suggestions(spark, sf):
    heads = B.titles(spark, sf).select("term", F.lit("en").alias("storefront")).filter(F.col("term") != "")
    return lexicon.related_suggestions(heads, B.suggestions(spark, sf))


# --- features, gates, score, rating --------------------------------------------------------

def _features(spark, sf):
    return with_features(B.keyword_lists(spark, sf))


def _scored(spark, sf):
    return RS.rescore(B.keyword_lists(spark, sf))


@query
def list_features(spark, sf):
    return _features(spark, sf).select(
        "term", "storefront", _r6("top3_rating_median"), "top3_reviews_median", "top1_reviews",
        _r6("stale_share"), _r6("weak_share"), _r6("thin_share"), "youngest_top5_age_days",
        _r6("no_localization_share"), _r6("games_share"), "top1_seller", "monetized_count", "paid_count",
        _r6("coherence"), _r6("in_metadata_share"))


@query
def leader_similarity(spark, sf):
    return _features(spark, sf).select("term", "storefront", _r6("top1_name_match"), _r6("top1_relevance"))


@query
def fingerprints(spark, sf):
    return B.lists(spark, sf).select("term", "storefront", F.array_join(
        F.array_sort(fingerprint(F.col("apps"))), ",").alias("items"), leader_id(F.col("apps")).alias("leader"))


@query
def failed_gates(spark, sf):
    return _scored(spark, sf).select("term", "storefront", _text("gates_failed"), "verdict")


@query
def niche_score(spark, sf):
    return _scored(spark, sf).select("term", "storefront", *FACTORS, "score", "verdict", _text("notes", "; "))


@query
def star_rating(spark, sf):
    rated = with_rating(_features(spark, sf).withColumn("cluster_size", F.coalesce("suggest_pos", F.lit(1)) % 3))
    return rated.select("term", "storefront", "stars", _text("flags", " "), "missing", "reason")


@query
def rescore_changes(spark, sf):
    return RS.status_changes(_scored(spark, sf))


@query
def rescore_promoted(spark, sf):
    return RS.promoted(_scored(spark, sf))


@query
def gate_counts(spark, sf):
    return RS.gate_counts(_scored(spark, sf))


@query
def flatten_apps(spark, sf):
    return landing.flatten_apps(B.raw_apps(spark, sf), F.lit(B.AS_OF).cast("timestamp")).select(
        "track_id", "bundle_id", "title", "subtitle", "seller", _text("genres"), "primary_genre", "rating",
        "rating_count", "price", "is_paid", "has_iap", "is_monetized", "days_since_update", "age_days",
        _text("languages"), "content_rating")


@query
def enrich_outcomes(spark, sf):
    wanted = B.keywords(spark, sf).select("term", F.upper("storefront").alias("country"), F.col("suggest_pos").alias("popularity"))
    # lists are on record for two keywords in three; one in five was already known
    lists = B.lists(spark, sf).join(B.keywords(spark, sf).select("term", "storefront", "first_part"), ["term", "storefront"])
    snapshots = lists.filter(F.col("first_part") % 3 != 0).select("term", "storefront", "taken_at", "apps")
    known = lists.filter(F.col("first_part") % 5 == 0)
    return RS.enrich(wanted, snapshots, known).groupBy("storefront", "outcome").agg(F.count("*").alias("n"))


@query
def review_growth(spark, sf):
    return RS.with_review_growth(B.keyword_lists(spark, sf), S.review_delta(B.metrics(spark, sf), depth=20)).select(
        "term", "storefront", "top1_weekly_review_delta", "est_monthly_installs")


@query
def newest_snapshots(spark, sf):
    """The newest of several yearly snapshots of each keyword, and the one before it, by their items."""
    history = stage(B.list_history(spark, sf), "history")
    newest = RS.latest_lists(history)
    known = asof.asof_join(newest.withColumn("until", F.date_sub("taken_at", 1)), history.select(
        "term", "storefront", F.col("taken_at").alias("before"), F.col("apps").alias("apps_before")), ["term", "storefront"],
        "until", "before", ["before", "apps_before"])
    items = lambda c: F.array_join(F.transform(c, lambda a: a["track_id"].cast("string")), ",")
    return known.select("term", "storefront", "taken_at", items("apps").alias("items"), "before", items("apps_before").alias("items_before"))


@query
def decision_context(spark, sf):
    """The last place at which a keyword was seen in the autocomplete before each decision on it."""
    return asof.asof_join(B.decisions(spark, sf).filter(F.col("verdict").isin("go", "no_go")),
                          B.sightings(spark, sf).filter(F.col("position") <= 6), ["term", "storefront"], "decided_at", "seen_at",
                          ["position"]).select("term", "storefront", "reason", "verdict", "position")


@query
def storefront_choice(spark, sf):
    """Lists of storefronts that customers ask for, some unknown, some empty."""
    asked = B.table(spark, sf, "customer").select(F.col("c_custkey").alias("request_id"), F.when(
        F.col("c_custkey") % 7 != 0, F.concat_ws(",", F.lit(" GB"), F.substring("c_name", -2, 2), F.element_at(
            F.array(*[F.lit(x) for x in ("us", "de", "FR ", "zz", "")]), (F.col("c_custkey") % 5 + 1).cast("int")))).alias("stores"))
    odd = asked.withColumn("stores", F.when(F.col("request_id") % 3 == 0, F.regexp_replace("stores", "GB|us", "xx")).otherwise(F.col("stores")))
    return storefronts.chosen_storefronts(odd)


@query
def tracked_items(spark, sf):
    return RS.tracked_items(B.keyword_lists(spark, sf))


# --- names and brands ----------------------------------------------------------------------

@query
def name_matches(spark, sf):
    return B.titles(spark, sf).select("page_id", round_half_up(
        name_match(F.col("term"), F.col("title")), 6).alias("match"))


@query
def brand_signals(spark, sf):
    pairs = B.keyword_lists(spark, sf).withColumn("first", F.try_element_at("apps", F.lit(1))).select(
        F.concat_ws(" ", F.split_part("first.title", F.lit(" "), F.lit(1)), F.when(
            F.col("first.track_id") % 2 == 0, F.split_part("first.title", F.lit(" "), F.lit(2)))).alias("name"),
        F.col("first.title").alias("title"), F.col("first.seller").alias("seller")).distinct()
    return pairs.select("name", "title", brand_signal(F.lower("name"), F.col("title"), F.col("seller")).alias("why"))


@query
def token_set_relevance(spark, sf):
    """Titles of pages against the first sentence of the page with the same number."""
    return B.titles(spark, sf).select("page_id", round_half_up(
        token_set_ratio(F.lower("term"), F.lower("title")), 4).alias("ratio"))


# --- series ---------------------------------------------------------------------------------

@query
def metric_upsert(spark, sf):
    """Readings to one row per (item, storefront, day): the last one wins."""
    raw = B.readings(spark, sf)
    shape = raw.select("track_id", "storefront", "day", F.col("value").alias("rating"), "event_id", "ts")
    merged = tables.last_wins(shape.filter(F.col("event_id") % 2 == 0), shape.filter(F.col("event_id") % 2 == 1),
                              ["track_id", "storefront", "day"], ["ts", "event_id"])
    return merged.select("track_id", "storefront", "day", "rating", "event_id")


@query
def app_dimension(spark, sf):
    """Item rows seen in lists over time: newest title, first genre; zero ids skipped."""
    seen = B.table(spark, sf, "lineitem").filter(F.col("l_suppkey") != 0).select(
        F.col("l_suppkey").alias("track_id"), F.lit("us").alias("storefront"),
        F.concat(F.lit("title "), F.col("l_partkey").cast("string")).alias("title"),
        F.concat(F.lit("genre "), F.col("l_linenumber").cast("string")).alias("primary_genre"),
        F.col("l_shipdate").cast("date").alias("updated_at"), F.col("l_orderkey").alias("order_no"),
        F.col("l_linenumber").alias("line_no"))
    early = F.col("order_no") % 2 == 0
    return stores.merge_items(seen.filter(early), seen.filter(~early), ["updated_at", "order_no", "line_no", "title", "primary_genre"]).select(
        "track_id", "storefront", "title", "primary_genre", "updated_at")


def _snapshot_log(spark, sf):
    """Yearly snapshots, appended batch by batch, one of them twice, and read back."""
    root = f"{staging_root(spark)}/demandscope/store-{uuid.uuid4().hex}"
    history = stage(B.list_history(spark, sf), "history")
    even = F.year("taken_at") % 2 == 0
    for batch, rows in (("even", even), ("odd", ~even), ("odd", ~even)):
        stores.append_batch(history.filter(rows), root, "snapshots", batch)
    return stores.read_log(spark, root, "snapshots").drop("batch")


@query
def item_store(spark, sf):
    return stores.items_of(_snapshot_log(spark, sf))


@query
def metric_store(spark, sf):
    return stores.metrics_of(_snapshot_log(spark, sf))


@query
def score_store(spark, sf):
    """Rescored keywords appended to the logs of features and scores, and the keyword table that follows."""
    root = f"{staging_root(spark)}/demandscope/store-{uuid.uuid4().hex}"
    stores.store_scores(stage(_scored(spark, sf), "rescored"), root, "first", F.lit(B.AS_OF).cast("timestamp"))
    features = stores.read_log(spark, root, "features").select("term", "storefront", _r6("coherence"))
    return stores.with_status(B.keywords(spark, sf).select("term", "storefront", "status"), stores.read_log(spark, root, "scores")).join(
        features, ["term", "storefront"])


@query
def verdict_store(spark, sf):
    """Verdicts stored twice; of keywords judged again the later one counts."""
    first = _verdicts(spark, sf).withColumn("judged_at", F.lit(B.AS_OF).cast("timestamp"))
    again = first.filter(F.length("term") % 2 == 0).withColumns({
        "category": F.lit("niche"), "judged_at": F.col("judged_at") + F.make_dt_interval(F.length("storefront"))})
    root = f"{staging_root(spark)}/demandscope/store-{uuid.uuid4().hex}"
    stores.append_batch(first, root, "verdicts", "first")
    stores.append_batch(again, root, "verdicts", "again")
    return stores.newest_verdicts(stores.read_log(spark, root, "verdicts")).select("term", "storefront", "category", "confidence", "note")


@query
def review_delta(spark, sf):
    return S.review_delta(B.metrics(spark, sf), depth=20)


@query
def traffic_trend(spark, sf):
    return S.traffic_trend(B.metrics(spark, sf))


@query
def demand_trend(spark, sf):
    return S.demand_trend(B.suggestions(spark, sf))


def _score_log(spark, sf):
    """Yearly scorings: a part name's share of orders that were large."""
    return B.table(spark, sf, "orders").groupBy(
        F.col("o_orderpriority").alias("term"), (F.col("o_custkey") % 50).cast("string").alias("storefront"),
        F.trunc(F.col("o_orderdate").cast("date"), "year").alias("scored_at")).agg(
        F.count("*").alias("n"), F.count_if(F.col("o_totalprice") > 250000).alias("large")).select(
        "term", "storefront", "scored_at", (F.col("large") * 100.0 / F.col("n")).alias("score"))


@query
def score_trend(spark, sf):
    return S.score_trend(_score_log(spark, sf), depth=5).select(
        "term", "storefront", "arrow", _r6("old_score"), _r6("new_score"))


@query
def decay_alerts(spark, sf):
    return S.decay_alerts(B.metrics(spark, sf), B.item_titles(spark, sf), F.lit(B.EVENTS_AS_OF), days=20,
                          min_drop=0.1)


@query
def history_length(spark, sf):
    return S.history_length(B.readings(spark, sf), "ts", F.lit(date(2024, 3, 5)))


@query
def leader_series(spark, sf):
    return S.leader_series(B.lists(spark, sf), B.metrics(spark, sf)).groupBy("term", "storefront", "track_id").agg(
        F.count("*").alias("n_days"), F.max("rating_count").alias("rating_count"))


@query
def chosen_trend(spark, sf):
    """Demand arrow, else the traffic arrow of the item numbered like the document's first line."""
    keys = B.suggestion_rows(spark, sf).groupBy("term", "storefront").agg(F.min("doc_id").alias("leader_id"))
    traffic = S.traffic_trend(B.metrics(spark, sf)).drop("storefront")
    traffic = traffic.withColumn("storefront", F.explode(F.array(*[F.lit(r) for r in ("en", "de", "fr", "es")])))
    return S.chosen_trend(keys, S.demand_trend(B.suggestions(spark, sf)), traffic).select(
        "term", "storefront", "trend")


# --- lifecycle ------------------------------------------------------------------------------

@query
def keyword_upsert(spark, sf):
    """Suggestions as keyword sightings: best place and last sighting move, the source does not."""
    seen = B.suggestion_rows(spark, sf).select(
        "term", "storefront", F.when(F.col("doc_id") % 2 == 0, "suggest").otherwise("asa").alias("source"),
        F.when(F.col("line") % 4 != 0, F.col("position")).alias("suggest_pos"),
        F.col("seen_at").alias("first_seen"), F.col("seen_at").alias("last_seen"), "doc_id", "line")
    stored = F.col("doc_id") % 3 == 0
    rows = stores.merge_keywords(seen.filter(stored), seen.filter(~stored), ["last_seen", "doc_id", "line"])
    return rows.select("term", "storefront", "source", "suggest_pos", F.col("first_seen").cast("date").alias("first_seen"),
                       F.col("last_seen").cast("date").alias("last_seen"))


@query
def decision_log(spark, sf):
    """Accepted decisions about known terms, per verdict and month."""
    log = B.decisions(spark, sf).withColumn("verdict", F.when(
        F.col("reason").cast("bigint") % 10 == 0, "maybe").otherwise(F.col("verdict")))
    accepted, rejected = D.split_by_vocabulary(log)
    live = B.keywords(spark, sf).filter(F.col("status").isin("queued", "watchlist"))
    kept = D.for_known_terms(accepted, live).select("verdict", F.lit("accepted").alias("kind"))
    return kept.union(rejected.select("verdict", F.lit("rejected").alias("kind"))).groupBy("kind", "verdict").agg(
        F.count("*").alias("n"))


@query
def hidden_terms(spark, sf):
    return D.hidden_terms(B.decisions(spark, sf), _events_as_of(), later_days=1)


@query
def decision_undo(spark, sf):
    log = B.decisions(spark, sf)
    cleared = D.undo(B.keywords(spark, sf).filter(F.col("source") == "asa").select("term").distinct(),
                     F.lit(date(2024, 1, 30)).cast("timestamp"))
    return D.hidden_terms(log.unionByName(cleared), _events_as_of(), later_days=1)


@query
def decision_summary(spark, sf):
    return D.summary(B.decisions(spark, sf))


@query
def reviewed_list(spark, sf):
    return D.reviewed(B.decisions(spark, sf), _events_as_of())


def _fact_rows(spark, sf):
    return landing.project_facts(B.facts(spark, sf), F.lit(B.AS_OF).cast("timestamp"))


@query
def facts_load(spark, sf):
    """Loaded facts move queued and new keywords to the validated status."""
    root = f"{staging_root(spark)}/demandscope/store-{uuid.uuid4().hex}"
    stores.append_batch(_fact_rows(spark, sf), root, "facts", "first")
    return stores.load_facts(B.keywords(spark, sf), stores.read_log(spark, root, "facts"), 25).select("term", "storefront", "status")


@query
def facts_projection(spark, sf):
    return _fact_rows(spark, sf).groupBy("term", "storefront").agg(
        F.count("*").alias("n"), F.max("popularity").alias("popularity"), F.min("difficulty").alias("difficulty"),
        F.count("rank").alias("n_ranked"))


@query
def verdict_replies(spark, sf):
    return R.parse_verdicts(B.verdict_replies(spark, sf))


def _verdicts(spark, sf):
    parsed = R.parse_verdicts(B.verdict_replies(spark, sf)).filter("accepted")
    return parsed.select("term", "storefront", "category", "intent", F.lit(None).cast("string").alias("monetization"),
                         "niche_name", "confidence", "note")


@query
def verdict_defaults(spark, sf):
    gaps = _verdicts(spark, sf).select(
        "term", "storefront", F.when(F.length("term") % 3 != 0, F.col("category")).alias("category"), "intent",
        "monetization", F.when(F.length("term") % 2 == 0, F.col("niche_name")).alias("niche_name"),
        F.when(F.length("term") % 5 != 0, F.col("confidence")).alias("confidence"), "note")
    return R.with_defaults(gaps)


@query
def proposal_replies(spark, sf):
    return R.parse_proposals(B.proposal_replies(spark, sf))


@query
def proposal_exclusions(spark, sf):
    proposed = R.parse_proposals(B.proposal_replies(spark, sf)).select("query", "storefront").distinct()
    keywords = B.titles(spark, sf).select("term", F.lit("us").alias("storefront"))
    earlier = B.table(spark, sf, "conversations").select(F.explode(F.split("text", "[.\n]")).alias("sentence")).select(
        normalize_term(F.col("sentence")).alias("query"), F.lit("us").alias("storefront"))
    return PR.without_known(proposed, keywords, earlier)


@query
def proposal_inserts(spark, sf):
    """First-wins insert of proposed queries, then outcomes on top."""
    proposed = R.parse_proposals(B.proposal_replies(spark, sf)).select(
        "query", "storefront", "source_term", "why", "place", F.lit("pending").alias("status"),
        F.lit(None).cast("timestamp").alias("checked_at"), F.lit(None).cast("string").alias("note"))
    first, later = proposed.filter(F.col("place") == 1), proposed.filter(F.col("place") > 1)
    unique = tables.insert_if_absent(first.limit(0), first, ["query", "storefront"], ["place", "source_term"])
    stored = tables.insert_if_absent(unique, later, ["query", "storefront"], ["place", "source_term"])
    outcomes = stored.filter(F.length("query") % 2 == 0).select(
        "query", "storefront", F.when(F.length("query") > 12, "accepted").otherwise("no_demand").alias("status"),
        F.lit(B.AS_OF).cast("timestamp").alias("checked_at"), F.col("why").alias("note"))
    return PR.with_outcomes(stored, outcomes).select("query", "storefront", "source_term", "why", "status", "note")


def _checked(spark, sf):
    proposals = B.proposals(spark, sf)
    landed = B.suggestion_rows(spark, sf).select(
        F.when(F.col("doc_id") % 3 != 0, F.array_join(F.slice(tokens(F.col("term")), 1, 2), " ")).otherwise(
            F.col("term")).alias("prefix"), "term", "position", "storefront")
    return PR.demand_check(proposals, landed)


@query
def demand_check(spark, sf):
    return _checked(spark, sf).select("query", "storefront", F.coalesce("n_suggestions", F.lit(0)).alias("n_suggestions"),
                                      "demand_position")


@query
def proposal_verification(spark, sf):
    """Outcome of each proposal, its list being the one of the part numbered like its document."""
    part = B.keyword_text(B.table(spark, sf, "part")).select("p_partkey", "term", F.col("storefront").alias("store"))
    scored = RS.scored(B.keyword_lists(spark, sf)).select(
        "term", F.col("storefront").alias("store"), "gates_failed", F.col("verdict").alias("list_verdict"))
    joined = _checked(spark, sf).join(part, F.col("first_doc") == F.col("p_partkey"), "left").join(
        scored, ["term", "store"], "left")
    status = PR.verification_status(F.col("list_verdict").isNotNull(), F.col("gates_failed"), F.col("list_verdict"))
    return joined.select("query", "storefront", status.alias("status"))


@query
def proposal_hit_rate(spark, sf):
    return PR.hit_rate(proposal_verification(spark, sf)).select("status", "n", _r6("share"))


@query
def related_exclusions(spark, sf):
    seeds = B.keywords(spark, sf).filter(F.col("suggest_pos") <= 2).select("term", "storefront").withColumn(
        "term", F.split_part("term", F.lit(" "), F.lit(2))).distinct()
    excluded = B.keywords(spark, sf).select(F.col("term").alias("query"), "storefront")
    return PR.related_exclusions(seeds, excluded)


@query
def generator_input(spark, sf):
    seeds = B.keyword_lists(spark, sf, F.col("suggest_pos") == 1).select("term", "storefront", "apps")
    excluded = B.keywords(spark, sf).filter(F.col("source") == "asa").select(F.col("term").alias("query"), "storefront")
    return PR.generator_input(seeds, PR.related_exclusions(seeds, excluded, limit=5))


@query
def labelled_lists(spark, sf):
    """Labelled cases from documents: one list per case."""
    cases = B.table(spark, sf, "documents").join(B.table(spark, sf, "labels"), "doc_id").select(
        F.concat(F.lit("q"), F.col("doc_id").cast("string")).alias("query"),
        F.when(F.col("quality") == 1, "niche").otherwise("junk").alias("expected"), F.col("source").alias("title"),
        F.col("lang").alias("seller"), F.lit(4.5).alias("rating"), (F.col("n_chars") * 11).alias("reviews"))
    return R.labelled_lists(cases).select("query", "expected", F.explode("apps").alias("a")).select(
        "query", "expected", "a.title", "a.seller", "a.rating", "a.rating_count")


@query
def classifier_evaluation(spark, sf):
    results = B.table(spark, sf, "documents").join(B.table(spark, sf, "labels"), "doc_id").select(
        F.when(F.col("toxic") == 1, "brand").when(F.col("quality") == 1, "niche").otherwise("junk").alias("expected"),
        F.when(F.col("n_chars") % 7 == 0, "brand").when(F.col("n_chars") > 300, "niche").otherwise("junk").alias("got"))
    return R.evaluate(results, "niche")


@query
def job_state(spark, sf):
    """Keyed state: the last event time per event type."""
    rows = B.table(spark, sf, "events").select(
        F.col("event_type").alias("key"), F.col("event_id").cast("string").alias("value"), "ts", "event_id")
    return tables.last_wins(rows.filter(F.col("event_id") % 3 == 0), rows.filter(F.col("event_id") % 3 != 0), ["key"],
                            ["ts", "event_id"]).select("key", "value")


@query
def external_times(spark, sf):
    """Seconds since 2001 as timestamps."""
    return B.table(spark, sf, "orders").select(
        "o_orderkey", apple_epoch(F.col("o_orderkey") * 3600).cast("date").alias("day"))


# --- similarity and graph --------------------------------------------------------------------

@query
def overlap_pairs(spark, sf):
    return overlap.overlap_pairs(B.document_lists(spark, sf)).select(
        "storefront", "a", "b", "n_common", _r6("overlap"), "same_leader")


@query
def overlap_pairs_of_lists(spark, sf):
    return overlap.overlap_pairs(B.lists(spark, sf)).select(
        "storefront", "a", "b", "n_common", _r6("overlap"), "same_leader")


@query
def overlap_clusters(spark, sf):
    return graph.cluster_members(stage(B.document_lists(spark, sf), "lists"))


@query
def crowd_clusters(spark, sf):
    """Clusters of lists whose items are the commonest tokens, far above the hot degree."""
    return graph.cluster_members(stage(B.document_lists(spark, sf, common=True), "lists"), hot_degree=20)


@query
def cluster_heads(spark, sf):
    lists = stage(B.lists(spark, sf, ["track_id"]), "lists")
    return graph.cluster_heads(graph.cluster_members(lists), lists)


@query
def cluster_items(spark, sf):
    lists = stage(B.document_lists(spark, sf), "lists")
    return graph.cluster_items(graph.cluster_members(lists), lists).groupBy("storefront", "cluster_id").agg(
        F.count("*").alias("n_items"))


@query
def fuzzy_pairs(spark, sf):
    return variants.fuzzy_pairs(B.suggestions(spark, sf, opening=3)).select("storefront", "a", "b", _r6("ratio"))


@query
def variant_heads(spark, sf):
    return variants.variant_heads(B.suggestions(spark, sf, opening=3))


@query
def collection_heads(spark, sf):
    return RS.collection_heads(B.suggestions(spark, sf, opening=3), max_snapshots=60)


def _collected(spark, sf):
    ledger = lexicon.probe_ledger(B.suggestions(spark, sf)).filter(F.length("prefix") % 2 == 0)
    return C.collection_pass(B.suggestions(spark, sf, opening=3), ledger, lambda heads: B.lists_for(spark, sf, heads), 60)


@query
def collection_counters(spark, sf):
    return _collected(spark, sf)[1]


@query
def collection_scores(spark, sf):
    return _collected(spark, sf)[0].select("term", "storefront", "suggest_pos", "score", "verdict")


# --- niches ----------------------------------------------------------------------------------

def _queue(spark, sf, limit=None):
    return N.queue(RS.scored(B.keyword_lists(spark, sf, F.col("status") == "queued")), limit)


def _hidden(spark, sf):
    return D.hidden_terms(B.decisions(spark, sf), _events_as_of(), later_days=1)


def _table(spark, sf):
    niches, _ = N.niche_clusters(_queue(spark, sf))
    return N.niche_table(niches, _verdicts(spark, sf), _hidden(spark, sf), F.lit(date(2001, 7, 1)).cast("timestamp"))


@query
def queue_top(spark, sf):
    return _queue(spark, sf, limit=50).select("term", "storefront", "score", "suggest_pos")


@query
def queue_json(spark, sf):
    rows = N.queue_json(_queue(spark, sf, limit=50))
    return rows.select("term", "storefront", "score", F.element_at("notes", 1).alias("first_note"),
                       F.col("factors")["weakness"].alias("weakness"), F.col("factors")["market"].alias("market"))


@query
def merged_niches(spark, sf):
    niches, _ = N.niche_clusters(_queue(spark, sf))
    return niches.select("term", "storefront", "score", "cluster_size", _text("markets"), "variants_from")


@query
def niche_variants(spark, sf):
    _, rest = N.niche_clusters(_queue(spark, sf))
    return rest


@query
def niche_table(spark, sf):
    return _table(spark, sf).drop("why", "missing", "reason", "leader_id", "leader_title")


@query
def niche_order(spark, sf):
    return N.ordered_niches(_table(spark, sf), 40).select("term", "storefront", "stars", "score", "is_new")


@query
def brand_leads(spark, sf):
    return N.brand_leads(_table(spark, sf)).select("term", "storefront", "score", "leader_title")


@query
def weekly_niches(spark, sf):
    return N.weekly_niches(_table(spark, sf), 30).select("term", "storefront", "stars", "score", "route")


def _niche_evidence(spark, sf):
    return N.with_trend(_table(spark, sf), S.demand_trend(B.sightings(spark, sf)), S.traffic_trend(B.metrics(spark, sf)))


@query
def niche_evidence(spark, sf):
    """The trend arrow, the headline reason and the missing signals of every shown niche."""
    return _niche_evidence(spark, sf).select("term", "storefront", "trend", "why", "missing")


@query
def weekly_report(spark, sf):
    alerts = S.decay_alerts(B.metrics(spark, sf), B.item_titles(spark, sf), F.lit(B.EVENTS_AS_OF), days=20, min_drop=0.1)
    return N.weekly_report(_niche_evidence(spark, sf), alerts)


@query
def headline_reasons(spark, sf):
    return _scored(spark, sf).select("term", "storefront", headline_reason().alias("why"))


@query
def route_counts(spark, sf):
    return N.route_counts(_table(spark, sf))


def _popularity_of_terms(spark, sf):
    """The measured popularity of keywords, from the newest period of their ranking; months are ranked apart, so only that one is."""
    ordered = B.keyword_orders(spark, sf)
    newest = ordered.agg(F.max("period").alias("period")).first().period
    return P.newest_popularity(B.keyword_popularity(ordered.filter(F.col("period") == newest)), newest, "WEEKLY_SUN_SAT")


@query
def idea_list(spark, sf):
    niches, _ = N.niche_clusters(_queue(spark, sf))
    return N.idea_list(niches, _verdicts(spark, sf), _hidden(spark, sf), _popularity_of_terms(spark, sf))


@query
def measured_ideas(spark, sf):
    niches, _ = N.niche_clusters(_queue(spark, sf))
    ideas = N.idea_list(niches, _verdicts(spark, sf), _hidden(spark, sf), _popularity_of_terms(spark, sf),
                        measured_only=True, only_source="suggest")
    return N.ordered_ideas(ideas, 40).select("term", "storefront", "popularity", "stars")


@query
def generation_seeds(spark, sf):
    niches, _ = N.niche_clusters(_queue(spark, sf))
    return N.seeds(niches, _verdicts(spark, sf)).select("term", "storefront", "stars", "score")


@query
def unjudged_niches(spark, sf):
    niches, _ = N.niche_clusters(_queue(spark, sf))
    return N.unjudged(niches, _verdicts(spark, sf), 30).select("term", "storefront", "score")


@query
def queue_csv(spark, sf):
    niches, rest = N.niche_clusters(_queue(spark, sf))
    return N.export_rows(niches, rest)


@query
def dossiers(spark, sf):
    heads = _queue(spark, sf, limit=50).select("term", "storefront", "apps")
    return N.dossiers(heads, B.suggestions(spark, sf), shared_by=("us", "gb", "de", "fr"))


@query
def fact_sheet(spark, sf):
    lists = stage(B.lists(spark, sf, ["track_id", "title"]), "lists")
    facts = _fact_rows(spark, sf).groupBy("term", "storefront", "loaded_at").agg(
        F.max("popularity").alias("popularity"), F.max("difficulty").alias("difficulty"))
    return N.fact_sheet(graph.cluster_members(lists), facts, lists)


@query
def classifier_input(spark, sf):
    rows = _features(spark, sf).withColumn("variants", F.filter(
        F.array("top1_seller", F.split_part("term", F.lit(" "), F.lit(1))), lambda v: v != "Google LLC"))
    return R.classifier_input(rows)


# --- streams ---------------------------------------------------------------------------------

def _stream(spark, sf, name):
    return ingest.table_stream(spark, sf, name, B.table(spark, sf, name).schema)


def _stream_folders(spark):
    base = f"{staging_root(spark)}/demandscope/stream-{uuid.uuid4().hex}"
    return f"{base}/table", f"{base}/checkpoint"


@query
def stream_daily_metrics(spark, sf):
    """One reading per item and day from the event stream."""
    readings = _stream(spark, sf, "events").select(
        F.col("user_id").alias("track_id"), F.lit("us").alias("storefront"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("reading_id"), F.col("value").alias("rating"), F.lit(1).alias("rating_count"))
    table, checkpoint = _stream_folders(spark)
    ingest.upsert_daily_metrics(readings, table, checkpoint).awaitTermination()
    return spark.read.parquet(table).select("track_id", "storefront", "day", "rating")


@query
def stream_suggestions(spark, sf):
    """Payload files landed continuously in the suggestion table."""
    documents = _stream(spark, sf, "documents")
    table, checkpoint = _stream_folders(spark)
    decoded = landing.decode_suggestions(B.payloads_of(documents)).select("storefront", "term", "position")
    ingest.append_stream(decoded, table, checkpoint, "storefront").awaitTermination()
    return spark.read.parquet(table).groupBy("storefront", "term").agg(
        F.count("*").alias("n"), F.min("position").alias("position"))


@query
def stream_popularity(spark, sf):
    """Popularity rows streamed twice into a keyed table; the replay changes nothing."""
    table, checkpoint = _stream_folders(spark)
    parsed = landing.parse_popularity(
        _raw_popularity_of(_stream(spark, sf, "part")), "WEEKLY_SUN_SAT",
        F.lit(B.AS_OF).cast("timestamp") + F.make_dt_interval(F.lit(0), F.col("rankInGenre")))
    for run in ("first", "replay"):
        ingest.upsert_popularity(parsed, table, f"{checkpoint}-{run}").awaitTermination()
    return spark.read.parquet(table).select("term", "country", "genre", "period", "pop_1to100")
