"""Feed life cycle and request rates against sequential folds; streaming equals batch."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.operators import feeds as FE
from millrace.operators.throttle import request_counts, request_rates
from millrace.plans.ingest import discover_sources
from millrace.plans.interest import apply_feedback
from millrace.streaming.jobs import preference_writer, weekly_topic_counts
from tests.test_feedback import make_log

NOW = datetime(2024, 1, 31)
FEED_SCHEMA = (
    "domain string, feed_url string, status string, article_count long, last_attempted_at timestamp, enabled boolean, "
    "consecutive_failures int, consecutive_empty_fetches int, consecutive_no_new_entries int"
)


def test_life_cycle_equals_fold(spark):
    rng = random.Random(11)
    feeds, runs = [], []
    for i in range(12):
        start = (rng.randrange(3), rng.randrange(9), rng.randrange(28))
        status = "disabled" if i == 7 else "found"
        feeds.append((f"s{i}", f"u{i % 9}", status, 1, NOW, status == "found", *start))
    for run in range(60):
        for u in range(10):
            if rng.random() < 0.8:
                ok = rng.random() < (0.5 if u % 4 == 0 else 0.93)
                entries = rng.choice([0, 0, 0, 0, 3]) if u % 4 == 1 else rng.choice([0, 2, 5])
                new = rng.choice([0] * 30 + [1]) if u % 4 == 2 else rng.choice([0, 1])
                runs.append((f"u{u}", run, ok, entries, new, rng.random() < 0.2))
    want = {}
    for domain, url, status, _, _, enabled, f, e, n in feeds:
        for u, _, ok, entries, new, scoped in runs:
            if u != url or status == "disabled":
                continue
            if ok:
                f = 0
                e = 0 if entries else e + 1
                if e >= 10:
                    status, enabled = "disabled", False
            else:
                f += 1
                if f >= 3:
                    status, enabled = "disabled", False
            if ok and not scoped and status != "disabled":
                n = 0 if new else n + 1
                if n >= 30:
                    status, enabled = "disabled", False
        want[domain] = (status, enabled, f, e, n)
    got = FE.apply_runs(
        spark.createDataFrame(feeds, FEED_SCHEMA),
        spark.createDataFrame(runs, "feed_url string, run_id long, succeeded boolean, entry_count long, new_entry_count long, scoped boolean"),
    )
    rows = {
        r["domain"]: (r["status"], r["enabled"], r["consecutive_failures"], r["consecutive_empty_fetches"], r["consecutive_no_new_entries"])
        for r in got.collect()
    }
    assert rows == want
    assert {v[0] for v in want.values()} == {"found", "disabled"}


def test_discovery_round(spark):
    feeds = spark.createDataFrame(
        [
            ("old.example", "https://old.example/f", "found", 3, NOW - timedelta(days=90), True, 0, 0, 4),
            ("cool.example", None, "not_found", 2, NOW - timedelta(days=5), False, 0, 0, 0),
            ("back.example", "https://back.example/f", "disabled", 2, NOW - timedelta(days=31), False, 3, 1, 2),
        ],
        FEED_SCHEMA,
    )
    domains = ["old.example", "cool.example", "back.example", "none.example", "gone.example"]
    articles = spark.createDataFrame(list(enumerate(domains)), "article_id long, source_domain string")
    owned = spark.createDataFrame([(1, i, "good") for i in range(5)], "user_id long, article_id long, origin string")
    page = '<html><head><link rel="alternate" type="application/atom+xml" href="/f"></head></html>'
    homes = spark.createDataFrame(
        [("back.example", "https://back.example/", page), ("none.example", "https://none.example/", page)], "domain string, url string, html string"
    )
    status = spark.createDataFrame([("https://back.example/f", True), ("https://none.example/f", False)], "feed_url string, succeeded boolean")
    got = {r["domain"]: r for r in discover_sources(owned, articles, feeds, homes, status, F.lit(NOW)).collect()}
    assert {d: r["status"] for d, r in got.items()} == {
        "old.example": "found", "cool.example": "not_found", "back.example": "found",
        "none.example": "not_found", "gone.example": "fetch_failed",
    }
    assert got["back.example"]["consecutive_failures"] == 0 and got["back.example"]["enabled"]
    assert got["old.example"]["consecutive_no_new_entries"] == 4
    assert got["cool.example"]["last_attempted_at"] == NOW - timedelta(days=5)


def request_log(spark):
    rng = random.Random(4)
    rows, at = [], {}
    for i in range(900):
        key = "hot" if rng.random() < 0.4 else f"k{rng.randrange(5)}"
        at[key] = at.get(key, NOW) + timedelta(seconds=rng.choice([0, 1, 1, 2, 3, 30, 61]))
        rows.append((key, i, at[key]))
    return rows, spark.createDataFrame(rows, "key string, event_id long, at timestamp")


def test_request_rates_equal_a_scan(spark):
    rows, df = request_log(spark)
    want = {i: sum(k == key and timedelta(0) <= at - t < timedelta(seconds=60) for k, _, t in rows) for key, i, at in rows}
    got = {r["event_id"]: (r["recent"], r["over_limit"]) for r in request_rates(df, 5, 60).collect()}
    assert got == {i: (n, n > 5) for i, n in want.items()} and any(o for _, o in got.values())


@pytest.fixture
def streams(spark, tmp_path):
    def as_stream(batches, schema):
        for i, part in enumerate(batches):
            part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    return as_stream


def test_request_counts_stream(spark, streams, tmp_path):
    rows, df = request_log(spark)
    parts = [df.filter(F.col("event_id") < 450), df.filter(F.col("event_id") >= 450)]
    stream = request_counts(streams(parts, df.schema), 60, "1 day")
    query = stream.writeStream.format("memory").queryName("requests").outputMode("complete").option(
        "checkpointLocation", str(tmp_path / "cp")
    ).start()
    query.processAllAvailable()
    query.stop()
    want = {(r.key, r.window_start): r.requests for r in request_counts(df, 60).collect()}
    assert {(r.key, r.window_start): r.requests for r in spark.table("requests").collect()} == want
    assert sum(want.values()) == len(rows)


def test_weekly_counts_and_preferences_stream(spark, streams, tmp_path):
    log = make_log(8, n=200)
    schema = "seq long, user_id long, article_id long, op string, action string, created_at timestamp"
    events = spark.createDataFrame(log, schema)
    articles = spark.createDataFrame([(a, [f"t{a % 3}"], f"d{a % 4}") for a in range(12)], "article_id long, topics array<string>, source_domain string")
    owned = spark.createDataFrame([(0, 1, "manual", 1.0, NOW)], "user_id long, article_id long, origin string, interest_weight double, created_at timestamp")
    stream = streams([events.filter("seq < 90"), events.filter("seq >= 90")], events.schema)

    weekly = weekly_topic_counts(stream, articles)
    query = weekly.writeStream.format("memory").queryName("weekly").outputMode("complete").option("checkpointLocation", str(tmp_path / "w")).start()
    query.processAllAvailable()
    query.stop()
    total = spark.table("weekly").agg(F.sum("positive_count"), F.sum("negative_count")).first()
    posts = [r for r in log if r[3] == "post"]
    assert tuple(total) == (sum(r[4] != "bad" for r in posts), sum(r[4] == "bad" for r in posts))
    assert all(r["week"].weekday() == 0 for r in spark.table("weekly").collect())

    folder = str(tmp_path / "state")
    writer = preference_writer(spark, articles, owned, folder)
    query = stream.writeStream.foreachBatch(writer).option("checkpointLocation", str(tmp_path / "p")).start()
    query.processAllAvailable()
    query.stop()
    want = apply_feedback(events, owned, articles)
    for name, frame in want.items():
        stored = spark.read.parquet(f"{folder}/{name}").select(*frame.columns)
        assert sorted(map(tuple, stored.collect()), key=repr) == sorted(map(tuple, frame.collect()), key=repr), name
