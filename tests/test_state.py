"""Series, decisions, replies, proposals, merges, landing and streams."""

import json
import shutil
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from demandscope.functions.calendar import completed_months, completed_weeks
from demandscope.operators import decisions as D, lexicon, proposals as PR, replies as R, series as S
from demandscope.schemas import METRIC, POPULARITY, RAW_APP
from demandscope.plans import collect
from demandscope.sources import landing, stores, tables
from demandscope.streaming import ingest

DAY = date(2024, 3, 1)
NOW = datetime(2024, 3, 1)


def metrics(spark, series):
    return spark.createDataFrame(
        [(i, "us", DAY - timedelta(days=ago), rating, count) for i, points in series.items() for ago, rating, count in points], METRIC)


def test_review_delta_needs_two_days(spark):
    df = metrics(spark, {1: [(10, 4.0, 100), (0, 4.0, 200)], 2: [(1, 4.0, 1), (0, 4.0, 9)], 3: [(0, 4.0, 5)],
                         4: [(10, 4.0, 205), (0, 4.0, 100)]})
    got = {r.track_id: (r.weekly_review_delta, r.est_monthly_installs) for r in S.review_delta(df).collect()}
    assert got == {1: (70, 13639), 2: (None, None), 3: (None, None), 4: (-73, -14224)}


def test_traffic_trend_compares_windows(spark):
    speeding = [(14, 4.0, 0), (8, 4.0, 60), (6, 4.0, 80), (0, 4.0, 200)]
    got = {r.track_id: (r.arrow, r.label) for r in S.traffic_trend(metrics(
        spark, {1: speeding, 2: speeding[:3], 3: [(14, 4.0, 5), (8, 4.0, 5), (6, 4.0, 5), (0, 4.0, 5)]})).collect()}
    assert got == {1: ("↑", "+100%"), 2: ("·", None), 3: ("→", None)}


def test_demand_trend_lower_is_better(spark):
    rows = [("a", 8, 10), ("a", 2, 0), ("b", 2, 10), ("b", 8, 0), ("c", 3, 10), ("c", 3, 0), ("d", 1, 0), ("d", 2, 0)]
    df = spark.createDataFrame([("p", t, p, "us", NOW - timedelta(days=d)) for t, p, d in rows],
                               "prefix string, term string, position int, storefront string, seen_at timestamp")
    assert {r.term: r.arrow for r in S.demand_trend(df).collect()} == {"a": "↑", "b": "↓", "c": "→", "d": "·"}


def test_decay_alerts(spark):
    apps = spark.createDataFrame([(i, "us", f"app {i}") for i in range(1, 5)], "track_id long, storefront string, title string")
    df = metrics(spark, {1: [(20, 4.8, 1), (10, 4.5, 1), (0, 4.2, 1)], 2: [(20, 4.5, 1), (10, 4.5, 1), (0, 4.5, 1)],
                         3: [(40, 4.9, 1), (10, 4.1, 1), (0, 4.0, 1)], 4: [(20, 4.7, 1), (10, 4.6, 1), (0, 4.4, 1)]})
    # 4.7 - 4.4 is just below 0.3 in doubles
    assert [r.track_id for r in S.decay_alerts(df, apps, F.lit(DAY)).collect()] == [1]


def test_decisions_expire_and_undo(spark):
    log = [("a", "skip", 30), ("b", "later", 3), ("c", "skip", 40), ("c", "later", 20), ("d", "later", 30), ("d", "skip", 1)]
    df = spark.createDataFrame([(t, "us", NOW - timedelta(days=d), v, "") for t, v, d in log],
                               "term string, storefront string, decided_at timestamp, verdict string, reason string")
    as_of = F.lit(NOW)
    hidden = {r.term: r.verdict for r in D.hidden_terms(df, as_of).collect()}
    assert hidden == {"a": "skip", "b": "later", "d": "skip"}  # c: the expired snooze cancels the skip
    undone = df.unionByName(D.undo(spark.createDataFrame([("a",)], "term string"), as_of))
    assert "a" not in {r.term for r in D.hidden_terms(undone, as_of).collect()}
    assert {r.verdict: r.n_terms for r in D.summary(undone).collect()} == {"skip": 3, "later": 3}


def test_verdict_replies(spark):
    good = {"category": "Niche", "intent": "transactional", "confidence": 0.9, "niche_name": "x", "note": ""}
    cases = [
        json.dumps(good), "```json\n" + json.dumps(good) + "\n```", "<think>{no}</think> Sure: " + json.dumps(good) + " ok?",
        json.dumps(good | {"category": "maybe"}), json.dumps({"category": "niche"}), "nothing", "[1, 2]",
        json.dumps(good | {"confidence": "high", "intent": "buy", "niche_name": ""}), json.dumps(good | {"confidence": 7}), None]
    df = spark.createDataFrame([(f"t{i}", "us", c) for i, c in enumerate(cases)], "term string, storefront string, reply string")
    rows = [r for r in R.parse_verdicts(df).orderBy("term").collect()]
    assert [r.accepted for r in rows] == [True, True, True, False, False, False, False, True, True, False]
    assert (rows[7].confidence, rows[7].intent, rows[7].niche_name) == (0.5, "transactional", "t7")
    assert rows[8].confidence == 1.0


def test_proposal_replies_dedupe_before_the_cap(spark):
    ideas = [{"query": q, "why": "w"} for q in ["One", " Two Words ", "two words", "x" * 61 + " y"] + [f"q number {i}" for i in range(9)]]
    df = spark.createDataFrame([("t", "us", json.dumps({"ideas": ideas})), ("u", "us", "none")],
                               "source_term string, storefront string, reply string")
    rows = R.parse_proposals(df).orderBy("place").collect()
    assert [r.query for r in rows] == ["two words"] + [f"q number {i}" for i in range(7)]


def test_demand_check_and_status(spark):
    proposals = spark.createDataFrame([("scan pdf", "us"), ("peel fruit", "us"), ("none", "us")], "query string, storefront string")
    landed = spark.createDataFrame([("scan pdf", "scanner", 1, "us"), ("scan pdf", "scan pdf free", 2, "us"),
                                    ("peel fruit", "peel", 1, "us")], "prefix string, term string, position int, storefront string")
    got = {r.query: (r.n_suggestions, r.demand_position) for r in PR.demand_check(proposals, landed).collect()}
    assert got == {"scan pdf": (2, 2), "peel fruit": (1, None), "none": (None, None)}


def test_merges(spark):
    shape = "k string, source string, pos int, seen int, status string"
    old = spark.createDataFrame([("a", "suggest", 5, 1, "queued"), ("b", "asa", None, 1, "new")], shape)
    new = spark.createDataFrame([("a", "asa", 3, 2, "new"), ("b", "llm", 7, 2, "new"), ("c", "asa", 1, 2, "new")], shape)
    rows = {r.k: tuple(r) for r in tables.last_wins(old, new, ["k"], ["seen"], ["source"], ["pos"]).collect()}
    assert rows == {"a": ("a", "suggest", 3, 2, "new"), "b": ("b", "asa", 7, 2, "new"), "c": ("c", "asa", 1, 2, "new")}
    kept = {r.k: r.source for r in tables.insert_if_absent(old, new, ["k"], ["seen"]).collect()}
    assert kept == {"a": "suggest", "b": "asa", "c": "asa"}


def test_published_tables_and_exports(spark, tmp_path):
    root = str(tmp_path / "t")
    tables.publish(spark.range(3), root)
    again = tables.read_published(spark, root).union(spark.range(3, 5))
    tables.publish(again, root)
    assert tables.read_published(spark, root).count() == 5
    for n in range(10):  # numbers go on past one digit, and the newest is read
        tables.publish(spark.range(n), root)
    assert tables.read_published(spark, root).count() == 9
    tables.export_csv(spark.range(2), str(tmp_path / "csv"))
    tables.export_json(spark.range(2), str(tmp_path / "json"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    tables.append(spark.range(2).withColumn("p", F.lit("x")), str(tmp_path / "log"), "p")
    tables.append(spark.range(2).withColumn("p", F.lit("y")), str(tmp_path / "log"), "p")
    tables.overwrite_partitions(spark.range(7).withColumn("p", F.lit("y")), str(tmp_path / "log"), "p")
    assert spark.read.parquet(str(tmp_path / "log")).groupBy("p").count().orderBy("p").collect() == [("x", 2), ("y", 7)]


def test_app_records_from_json(spark, tmp_path):
    raw = {"trackId": 1, "trackName": " Noise\n", "description": "First line\nSecond", "price": 1.5, "releaseDate": "2024-01-01T12:00:00Z",
           "currentVersionReleaseDate": "bad", "advisories": ["In-App Purchases"]}
    (tmp_path / "a.json").write_text(json.dumps(raw))
    [row] = landing.flatten_apps(landing.read_app_records(spark, str(tmp_path)), F.lit(datetime(2024, 1, 3))).collect()
    assert (row.title, row.subtitle, row.is_paid, row.has_iap, row.rating_count) == ("Noise", "First line", True, True, 0)
    assert (row.age_days, row.days_since_update, row.genres) == (1, None, [])  # 36 hours are one day
    assert set(RAW_APP.replace("\n", " ").split()) >= {"trackId"}


def test_suggestion_payload_shapes(spark):
    payloads = ['{"hints": [{"term": "Scan PDF"}, "scan qr", {"x": 1}]}', '{"suggestions": ["ab", {"term": "scan to pdf"}]}',
                '["scan", {"term": "scan barcode"}]', '{"other": []}', "broken", "7"]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "id int, payload string")
    got = {(r.id, r.term, r.position) for r in landing.decode_suggestions(df).collect()}
    assert got == {(0, "scan pdf", 1), (0, "scan qr", 2), (1, "scan to pdf", 2), (2, "scan", 1), (2, "scan barcode", 2)}


def test_facts_by_column_names(spark):
    df = spark.createDataFrame([(" Noise Meter ", "GB", 40.0), ("", "US", 1.0)], "ZKeyword string, ZStore string, ZVolume double")
    [row] = landing.project_facts(df, F.lit(NOW)).collect()
    assert (row.term, row.storefront, row.popularity, row.difficulty) == ("noise meter", "gb", 40.0, None)


def test_calendar(spark):
    day = F.lit(date(2024, 5, 15))
    row = spark.range(1).select(completed_weeks(day, 2).alias("w"), completed_months(day, 2).alias("m")).first()
    assert [tuple(p) for p in row.w] == [(date(2024, 4, 28), date(2024, 5, 4)), (date(2024, 5, 5), date(2024, 5, 11))]
    assert [tuple(p) for p in row.m] == [(date(2024, 3, 1), date(2024, 3, 31)), (date(2024, 4, 1), date(2024, 4, 30))]


def test_lexicon_rounds(spark):
    rows = [("scan", "scan pdf", 1), ("scan", "scan pdfs to word", 2), ("scan", "scanner app", 3), ("scan", "scan 123", 4),
            ("unzip", "unzip files", 1), ("unzip", "unzip file", 2)]
    df = spark.createDataFrame([(p, t, n, "us", NOW) for p, t, n in rows],
                               "prefix string, term string, position int, storefront string, seen_at timestamp")
    assert {(r.term) for r in lexicon.best_positions(df).collect()} == {t for _, t, _ in rows} - {"scanner app"}
    assert {(r.token, r.n) for r in lexicon.harvest_objects(df).collect()} == {("pdf", 2), ("word", 1), ("file", 2)}
    assert [r.verb for r in lexicon.discover_verbs(df.union(df.select(
        F.lit("peel"), F.explode(F.array(*[F.lit(f"peel {x}") for x in "abc"])), F.lit(1), F.lit("us"), F.lit(NOW)))).collect()] == ["peel"]


def test_root_plan_paths(spark):
    ledger = lambda names, ago: spark.createDataFrame(
        [(n, NOW - timedelta(days=ago)) for n in names], "prefix string, probed_at timestamp")
    evidence = spark.createDataFrame([("peel", 3), ("once", 1)], "verb string, evidence long")
    objects = spark.createDataFrame([("pdf", 9), ("photo", 50), ("qr", 1)], "token string, n long")
    every = [v for v, _ in lexicon.seed_order()]
    plan = lambda led, n: [r.root for r in lexicon.plan_roots(led, evidence, objects, F.lit(NOW), n).orderBy(
        "tier", "place", "root").collect()]
    assert plan(ledger(["scan"], 1), 2) == ["convert", "compress"]
    mixed = plan(ledger([v for v in every if v not in ("test", "trim")], 30), 5)
    assert mixed[:3] == ["trim", "peel", "pdf"] and "test" not in mixed
    spent = plan(ledger([*every, "peel", "pdf"], 30), 70)
    assert "test" in spent and len(spent) == len(every) + 2
    assert plan(ledger([*every, "peel", "pdf"], 2), 5) == []


def test_daily_metric_stream_takes_late_rows(spark, tmp_path):
    shape = "track_id long, storefront string, ts timestamp, reading_id long, rating double, rating_count long"
    day = datetime(2024, 1, 1)
    batches = [[(1, day.replace(hour=9), 1, 4.0, 10)], [(1, day.replace(hour=8), 2, 1.0, 1), (1, day + timedelta(days=1), 3, 4.1, 20)],
               [(1, day + timedelta(days=9), 4, 4.2, 30)]]
    for rows in batches:
        spark.createDataFrame([(t, "us", ts, i, r, c) for t, ts, i, r, c in rows], shape).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        ingest.upsert_daily_metrics(ingest.file_stream(spark, str(tmp_path / "in"), shape), str(tmp_path / "out"),
                                    str(tmp_path / "check")).awaitTermination()
    got = {(r.day, r.rating_count) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(date(2024, 1, 1), 10), (date(2024, 1, 2), 20), (date(2024, 1, 10), 30)}


def test_popularity_stream_keeps_null_periods(spark, tmp_path):
    for n, term in enumerate("ab"):
        spark.createDataFrame([(term, "us", "U", None, "W", 1, 1, 1, 1, NOW)], POPULARITY).write.parquet(str(tmp_path / f"in{n}"))
        ingest.upsert_popularity(ingest.file_stream(spark, str(tmp_path / f"in{n}"), POPULARITY), str(tmp_path / "out"),
                                 str(tmp_path / f"check{n}")).awaitTermination()
    assert {(r.term, r.period) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("a", None), ("b", None)}


def test_popularity_stream_is_idempotent(spark, tmp_path):
    rows = [("a", "us", "U", DAY, "W", r, r, r, 1, NOW + timedelta(hours=r)) for r in (1, 2)] + [("b", "us", "U", DAY, "W", 5, 5, 5, 1, NOW)]
    spark.createDataFrame(rows, POPULARITY).write.parquet(str(tmp_path / "in"))
    for run in "xy":
        stream = ingest.file_stream(spark, str(tmp_path / "in"), POPULARITY)
        ingest.upsert_popularity(stream, str(tmp_path / "out"), str(tmp_path / run)).awaitTermination()
    assert {(r.term, r.rank_in_genre) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("a", 2), ("b", 5)}


@pytest.mark.parametrize("parts", [1, 3])
def test_stream_reads_a_table_of_one_file_or_of_many(spark, tmp_path, parts):
    rows = spark.range(10)
    rows.repartition(parts).write.parquet(str(tmp_path / "parts"))
    files = sorted((tmp_path / "parts").glob("part-*.parquet"))
    table = tmp_path / "in" / "documents.parquet"
    if parts == 1:
        table.parent.mkdir()
        shutil.copy(files[0], table)
    else:
        shutil.copytree(tmp_path / "parts", table)
    (tmp_path / "in" / "labels.parquet").mkdir()
    shutil.copy(files[0], tmp_path / "in" / "labels.parquet" / "part-0.parquet")
    stream = ingest.table_stream(spark, str(tmp_path / "in"), "documents", rows.schema)
    ingest.append_stream(stream, str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(10))


def test_batch_that_dies_during_the_overwrite_loses_nothing(spark, tmp_path, monkeypatch):
    """The second batch deletes the stored partition and dies before it is written again."""
    def land(rows):
        spark.createDataFrame(rows, POPULARITY).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        ingest.upsert_popularity(ingest.file_stream(spark, str(tmp_path / "in"), POPULARITY), str(tmp_path / "out"),
                                 str(tmp_path / "check")).awaitTermination()

    row = lambda term, rank, hour: (term, "us", "U", DAY, "W", rank, rank, rank, 1, NOW + timedelta(hours=hour))
    land([row("a", 1, 0), row("b", 2, 0), row("c", 3, 0)])
    run()
    land([row("a", 9, 1), row("d", 4, 1)])
    true = ingest.tables.overwrite_partitions

    def dies(df, path, *partition_by):
        for part in (tmp_path / "out").glob("granularity=W/*"):
            shutil.rmtree(part)
        raise RuntimeError("killed")

    monkeypatch.setattr(ingest.tables, "overwrite_partitions", dies)
    with pytest.raises(Exception, match="killed"):
        run()
    assert not list((tmp_path / "out").glob("granularity=W/*"))
    monkeypatch.setattr(ingest.tables, "overwrite_partitions", true)
    run()
    assert {(r.term, r.rank_in_genre) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("a", 9), ("b", 2), ("c", 3), ("d", 4)}
    assert [p.name for p in (tmp_path / "check-upserts").iterdir()] == ["batch-1"]


def test_stores_follow_from_their_logs(spark, tmp_path):
    shape = "term string, storefront string, taken_at timestamp, apps array<struct<track_id: bigint, title: string, primary_genre: string, rating: double, rating_count: bigint>>"
    snaps = [("a", "us", NOW, [(1, "old", "g1", 4.0, 10), (None, "x", "y", 1.0, 1), (0, "x", "y", 1.0, 1)]),
             ("b", "us", NOW, [(1, "mid", "g2", 4.1, 11)]), ("a", "us", NOW + timedelta(days=1), [(1, "new", "g3", 4.2, 12)])]
    for batch, rows in (("1", snaps[:2]), ("2", snaps[2:]), ("2", snaps[2:])):  # a batch that is written again changes nothing
        stores.append_batch(spark.createDataFrame(rows, shape), str(tmp_path), "snapshots", batch)
    log = stores.read_log(spark, str(tmp_path), "snapshots").drop("batch")
    assert log.count() == 3
    assert [tuple(r) for r in stores.items_of(log).select("track_id", "title", "primary_genre", "updated_at").collect()] == [
        (1, "new", "g1", NOW + timedelta(days=1))]
    assert {(r.day, r.rating_count) for r in stores.metrics_of(log).collect()} == {(DAY, 11), (DAY + timedelta(days=1), 12)}
    keywords = spark.createDataFrame([("a", "us", "new"), ("b", "us", "go"), ("c", "us", "queued")], "term string, storefront string, status string")
    scores = spark.createDataFrame([("a", "us", NOW, 1.0, "rejected"), ("a", "us", NOW + timedelta(1), 2.0, "queued"), ("b", "us", NOW, 3.0, "queued")],
                                   "term string, storefront string, scored_at timestamp, score double, verdict string")
    assert {(r.term, r.status, r.score) for r in stores.with_status(keywords, scores).collect()} == {
        ("a", "queued", 2.0), ("b", "go", 3.0), ("c", "queued", None)}


def test_collection_pass_counts(spark):
    rows = [("scan", t, n, "us", NOW) for n, t in enumerate(("scan pdf", "scan pdfs", "scan google maps", "scan card"), 1)]
    df = spark.createDataFrame(rows, "prefix string, term string, position int, storefront string, seen_at timestamp")
    ledger = spark.createDataFrame([("card", "us")], "prefix string, storefront string")
    app = ("track_id bigint, title string, subtitle string, seller string, primary_genre string, genres array<string>, rating double, "
           "rating_count bigint, price double, is_paid boolean, is_monetized boolean, days_since_update int, age_days int, languages array<string>")
    shelf = spark.createDataFrame([("scan pdf", [(1, "Scan PDF files", "", "S", "Work", ["Work"], 4.0, 5000, 0.0, False, False, 900, 900, ["EN"])])],
                                  f"term string, apps array<struct<{app.replace(' ', ': ').replace(':  ', ' ').replace(',: ', ', ')}>>")
    scored, counters = collect.collection_pass(df, ledger, lambda heads: heads.select("term", "storefront", F.lit("en").alias("lang")).join(shelf, "term"), 60)
    got = {r.counter: r.n for r in counters.collect()}
    assert [r.term for r in scored.collect()] == ["scan pdf"]
    assert (got["suggestions"], got["after_dedup"], got["empty_serp"] + got.get("brand", 0)) == (4, 3, 2)
    assert got["new_probes"] == 1 and sum(got.get(v, 0) for v in ("queued", "watchlist", "rejected")) == 1  # pdf, twice
