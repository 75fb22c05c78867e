"""Stored layouts: pruned reads, dropped partitions, tag postings and table functions."""

import re
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from millrace.sources.layout import articles_with_tags, purge_days, purge_runs, read_since, write_by_day, write_tag_index
from millrace.sources.sinks import write_run
from millrace.sources.table_functions import register_table_functions
from tests.test_ranking import small_inputs

NOW = datetime(2024, 1, 31, 12)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_windows_read_their_days_only(spark, tmp_path):
    rows = [(i, NOW - timedelta(hours=7 * i) if i % 3 else None, NOW - timedelta(hours=7 * i + 1)) for i in range(40)] + [(99, None, None)]
    articles = spark.createDataFrame(rows, "article_id long, published_at timestamp, fetched_at timestamp")
    path = str(tmp_path / "a")
    write_by_day(articles, path)
    start = F.lit(NOW) - F.make_dt_interval(F.lit(3))
    got = read_since(spark, path, start)
    want = {i for i, p, f in rows if (p or f) and (p or f) >= NOW - timedelta(days=3)}
    assert {r.article_id for r in got.collect()} == want and got.columns == articles.columns
    plan = plan_of(got)
    assert "PartitionFilters: [isnotnull(day" in plan and "Exchange" not in plan


def test_retention_drops_days(spark, tmp_path):
    rows = [(i, NOW - timedelta(hours=5 * i)) for i in range(50)] + [(99, None)]
    path = str(tmp_path / "l")
    cutoff = NOW - timedelta(days=4, hours=3)
    write_by_day(spark.createDataFrame(rows, "log_id long, created_at timestamp"), path, F.col("created_at"))
    assert purge_days(spark, path, cutoff, F.col("created_at")) == len({t.date() for _, t in rows if t and t.date() < cutoff.date()})
    kept = {i for i, t in rows if t is None or t >= cutoff}
    assert {r.log_id for r in spark.read.parquet(path).collect()} == kept
    assert purge_days(spark, path, cutoff, F.col("created_at")) == 0  # again: nothing changes
    assert {r.log_id for r in spark.read.parquet(path).collect()} == kept
    assert purge_days(spark, str(tmp_path / "none"), cutoff, F.col("created_at")) == 0


def test_retention_drops_runs_with_their_rows(spark, tmp_path):
    from dataclasses import replace

    from millrace.config import DEFAULT
    from millrace.plans.discover import discover_feed

    users = spark.createDataFrame([(1,)], "user_id long")
    feed = discover_feed(users, small_inputs(spark), F.lit(NOW), replace(DEFAULT, max_age_days=400), size=3).feed
    path = str(tmp_path / "runs")
    times = {"a": NOW - timedelta(days=3), "b": NOW - timedelta(hours=3), "c": NOW - timedelta(hours=1), "d": NOW + timedelta(days=1)}
    for run, at in times.items():
        write_run(feed, path, run, F.lit(at))
    assert purge_runs(spark, path, NOW - timedelta(hours=2)) == 1
    for name in ("runs", "recommendations"):
        assert {r.run_id for r in spark.read.parquet(f"{path}/{name}").select("run_id").distinct().collect()} == {"c", "d"}


def test_tag_postings_meet_without_a_shuffle(spark, tmp_path):
    tags = {i: [f"t{k}" for k in range(6) if i % (k + 1) == 0] for i in range(60)}
    rows = spark.createDataFrame([(i, [*t, *t], ["x"] if i % 2 else None) for i, t in tags.items()], "article_id long, topics array<string>, technologies array<string>")
    write_tag_index(rows, "tags_of_test", str(tmp_path / "t"), buckets=4)
    for wanted in (["t1"], ["t1", "t2"], ["t1", "t2", "t4", "t1"], ["t1", "none"], []):
        found = articles_with_tags(spark, "tags_of_test", "topics", wanted)
        assert {r.article_id for r in found.collect()} == {i for i, t in tags.items() if set(wanted) <= set(t)}
        assert "Exchange" not in plan_of(found) and "slot" in plan_of(found)
    assert articles_with_tags(spark, "tags_of_test", "technologies", ["x"]).count() == 30
    assert re.search(r"PartitionFilters: \[[^]]*slot", plan_of(articles_with_tags(spark, "tags_of_test", "topics", ["t1"])))
    spark.sql("DROP TABLE tags_of_test")


def test_table_functions(spark):
    register_table_functions(spark)
    lists = spark.createDataFrame([(1, "no\n* [a](https://a.example/x_(y)), b\r\nhttps://b.example."), (2, ""), (3, None)], "list_id long, content string")
    rows = spark.sql("SELECT l.list_id, t.line_number, t.url FROM {lists} l, LATERAL url_lines(l.content) t", lists=lists).collect()
    assert sorted(tuple(r) for r in rows) == [(1, 2, "https://a.example/x_(y)"), (1, 3, "https://b.example")]
    page = "".join(f'<link rel="alternate" type="application/rss+xml" href="/f{k % 7}">' for k in range(9))
    pages = spark.createDataFrame([("https://a.example/", page), (None, page), ("https://b.example/", None)], "url string, html string")
    links = spark.sql("SELECT p.url, t.* FROM {pages} p, LATERAL feed_links(p.url, p.html) t", pages=pages).collect()
    assert [(r.position, r.feed_url) for r in sorted(links, key=lambda r: r.position)] == [(k + 1, f"https://a.example/f{k}") for k in range(5)]
