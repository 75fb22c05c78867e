"""Stateful streams against the batch jobs, over random splits into batches and a restart."""

import random
from datetime import datetime

from millrace.config import DEFAULT
from millrace.operators import feedback as FB
from millrace.operators import preferences as P
from millrace.operators.feeds import apply_runs
from millrace.streaming.feeds import EVENTS as FEED_EVENTS
from millrace.streaming.feeds import FEED, feed_changes
from millrace.streaming.preferences import OWNED, FeedbackTables, start_feedback_streams
from millrace.streaming.state_table import StateTable
from tests.test_feedback import START, make_log

NOW = datetime(2024, 1, 31)
EVENTS = "seq long, user_id long, article_id long, op string, action string, created_at timestamp"


def as_tuples(df, columns):
    return {tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*columns).collect()}


def test_feedback_streams_equal_the_batch_jobs(spark, tmp_path):
    log = make_log(5, n=260)
    topics = {a: sorted({f"t{a % 3}", f"t{a % 5}"}) for a in range(12)}
    articles = spark.createDataFrame([(a, t, f"d{a % 4}") for a, t in topics.items()], "article_id long, topics array<string>, source_domain string")
    base = [(0, 1, "manual", 1.0, START), (0, 2, "read_full", 0.2, START), (1, 3, "clicked", 0.1, START), (0, 4, "good", 0.8, START), (9, 9, "saved", 0.5, START)]
    owned = spark.createDataFrame(base, OWNED)
    rng = random.Random(2)
    cuts = [0, *sorted(rng.sample(range(1, len(log)), 2)), len(log)]
    source, folder = str(tmp_path / "in"), str(tmp_path / "state")
    tables = FeedbackTables.at(spark, folder)
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        part = log[a:b]
        rng.shuffle(part)  # order inside a batch does not matter
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(source)
        # A new query on the same checkpoint each time: the state survives restarts.
        stream = spark.readStream.schema(EVENTS).parquet(source)
        for query in start_feedback_streams(stream, articles, owned, folder, availableNow=True):
            query.awaitTermination()
        events = spark.createDataFrame(log[:b], EVENTS)
        want = {
            "opinions": (FB.latest_feedback(events), ["user_id", "article_id", "action", "created_at"]),
            "owned": (FB.apply_feedback_to_owned(events, owned), ["user_id", "article_id", "origin", "interest_weight", "created_at"]),
            "topics": (P.topic_preferences(events, articles), ["user_id", "topic", "positive_weight", "negative_weight", "effective_weight"]),
            "sources": (P.source_preferences(events, articles), ["user_id", "source_domain", "positive_weight", "negative_weight", "effective_weight"]),
        }
        if k != 1:  # the middle batch is judged with the last one
            for name, (frame, columns) in want.items():
                assert as_tuples(getattr(tables, name).read(), columns) == as_tuples(frame, columns), (k, name)
        if k == 0:
            tables.opinions.compact()
            tables.owned.compact()
    assert len(as_tuples(tables.sources.read(), ["user_id", "source_domain"])) > 5


def test_state_table_keeps_the_newest_row(spark, tmp_path):
    table = StateTable(spark, str(tmp_path / "t"), "k long, v string", ["k"])
    schema = "k long, v string, removed boolean"
    assert table.read().count() == 0
    table.compact()
    batches = [[(1, "a", False), (2, "b", False)], [(2, None, True), (3, "c", False)], [(1, "d", False), (2, "e", False)]]
    state = {}
    for i, rows in enumerate(batches):
        table.append(spark.createDataFrame([(9, "lost", False)], schema), i)
        table.append(spark.createDataFrame(rows, schema), i)  # a repeated batch replaces itself
        for k, v, removed in rows:
            state.pop(k, None) if removed else state.__setitem__(k, v)
        assert {r.k: r.v for r in table.read().collect()} == state
        if i == 1:
            table.compact()
            assert {r.k: r.v for r in table.read().collect()} == state
    table.compact()
    assert {r.k: r.v for r in table.read().collect()} == state and table._folders("changes", "batch=") == []


def test_feed_stream_equals_the_batch_job_and_retries(spark, tmp_path):
    rng = random.Random(3)
    feeds, events, seq = [], [], 0
    for i in range(10):
        start = (rng.randrange(3), rng.randrange(9), rng.randrange(28))
        status = "disabled" if i == 7 else "not_found" if i == 8 else "found"
        feeds.append((f"s{i}", f"u{i}", status, 1, START, status == "found", *start))
    for run in range(50):
        for i in range(11):  # s10 is unknown
            if rng.random() < 0.8:
                ok = rng.random() < (0.5 if i % 4 == 0 else 0.95)
                entries = rng.choice([0, 0, 0, 0, 3]) if i % 4 == 1 else rng.choice([0, 2, 5])
                new = rng.choice([0] * 30 + [1]) if i % 4 == 2 else rng.choice([0, 1])
                events.append((seq, f"s{i}", START, ok, entries, new, rng.random() < 0.2, None, None, None))
                seq += 1
    table = spark.createDataFrame(feeds, FEED)
    runs = spark.createDataFrame(events, FEED_EVENTS).selectExpr("concat('u', substr(domain, 2)) AS feed_url", "seq AS run_id", "succeeded", "entry_count", "new_entry_count", "scoped")
    names = ["status", "enabled", "consecutive_failures", "consecutive_empty_fetches", "consecutive_no_new_entries"]
    want = {r.domain: tuple(r[n] for n in names) for r in apply_runs(table, runs).collect()}
    source, seen, due = str(tmp_path / "in"), {}, set()

    def collect(batch, batch_id):
        for r in batch.collect():
            seen[r.domain] = r
            if r.due:
                due.add(r.domain)

    def advance(part, settings):
        rng.shuffle(part)
        spark.createDataFrame(part, FEED_EVENTS).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(FEED_EVENTS).parquet(source)
        query = feed_changes(stream, table, settings).writeStream.foreachBatch(collect).outputMode("update")
        query.option("checkpointLocation", str(tmp_path / "c")).trigger(once=True).start().awaitTermination(100)

    cut = rng.randrange(100, 300)
    advance(events[:cut], DEFAULT.feeds)
    advance(events[cut:], DEFAULT.feeds)  # a restart
    got = {d: tuple(r[n] for n in names) for d, r in seen.items()}
    assert all(got.get(d, tuple(f[i] for i in (2, 5, 6, 7, 8))) == want[d] for d, f in ((f[0], f) for f in feeds))
    assert "s10" not in seen and {v[0] for v in want.values()} >= {"found", "disabled"}
    # All attempts lie more than thirty days back, so every closed domain has come due by now; a find starts it afresh.
    advance([(seq, "s7", NOW, None, None, None, None, "found", "u7", 4), (seq + 1, "s9", NOW, True, 1, 1, False, None, None, None)], DEFAULT.feeds)
    assert {"s7", "s8"} <= due and not any(want[d][0] == "found" for d in due - {"s7"})
    assert seen["s7"].status == "found" and seen["s7"].enabled and seen["s7"].consecutive_failures == 0
