"""Related articles over the whole pool."""

import random
from dataclasses import replace
from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalog.ranking import CFG, inputs, part_of
from catalog.views import Views
from millrace.config import DEFAULT
from millrace.operators import scoring as S
from millrace.operators.fronts import front_pairs
from millrace.operators.preferences import source_preferences
from millrace.operators.related import _first
from millrace.plans import discover
from millrace.plans.discover import FeedInputs, related_articles
from tests.test_ranking import NOW, small_inputs


def test_whole_pool_equals_a_cap_nobody_meets_without_a_row_per_pair(spark, monkeypatch):
    base, rng = small_inputs(spark), random.Random(5)
    vectors = [(i, [rng.random() - 0.5 for _ in range(2 if i == 8 else 3)]) for i in range(60) if i % 3]
    vectors = spark.createDataFrame(vectors, "article_id long, embedding array<float>")
    articles = base.articles.drop("embedding").join(vectors, "article_id", "left")
    owned = spark.createDataFrame(
        [(u, i, ("clicked", "read_full", "good")[i % 3], 0.1, NOW - timedelta(days=i)) for u in (1, 2, 3) for i in range(u, 60, 4)],
        "user_id long, article_id long, origin string, interest_weight double, created_at timestamp",
    )
    liking = spark.createDataFrame([(1, "d2", 2.0), (2, "d1", -9.0), (3, "d0", 1.0)], "user_id long, source_domain string, effective_weight double")
    inputs = FeedInputs(articles, owned, base.feedback, base.registry, liking)
    runs = spark.createDataFrame([(1, 1, 1), (2, 2, 2), (3, 3, 8), (4, 3, 9)], "run_id long, user_id long, article_id long")

    def best(cfg):
        rows = related_articles(runs, inputs, F.lit(NOW), cfg, size=6).select("run_id", "article_id", "rank", "total", "interest_similarity", "novelty").collect()
        return {(r[0], r[1]): r[2:] for r in rows}

    want = best(replace(DEFAULT, max_candidates=1000))

    def no_pairs(*_args, **_more):
        raise AssertionError("a row per run and article")

    monkeypatch.setattr(S, "select_candidates", no_pairs)
    got = best(replace(DEFAULT, vector_tile_rows=16))
    assert got.keys() == want.keys() and len({run for run, _ in got}) == 4
    for key, values in want.items():
        assert got[key] == pytest.approx(values, abs=1e-8), key


def test_equal_totals_keep_the_first_ids_only():
    found = _first(np.array([0.5] * 1000 + [-np.inf, 0.7]), np.arange(1002)[::-1], 3)
    assert {1001, 999, 998} <= set(found) and len(found) <= 6


def test_capped_runs_write_only_what_can_be_among_their_best(spark, monkeypatch):
    base, rng = small_inputs(spark), random.Random(7)
    vectors = [(i, [rng.random() - 0.5 for _ in range(2 if i == 8 else 3)]) for i in range(60) if i % 3]
    articles = base.articles.drop("embedding").join(spark.createDataFrame(vectors, "article_id long, embedding array<float>"), "article_id", "left")
    owned = spark.createDataFrame(
        [(u, i, ("clicked", "read_full", "good")[i % 3], 0.1, NOW - timedelta(days=i)) for u in (1, 2, 3) for i in range(u, 60, 4)],
        "user_id long, article_id long, origin string, interest_weight double, created_at timestamp",
    )
    liking = spark.createDataFrame([(1, "d2", 2.0), (2, "d1", -9.0), (3, "d0", 1.0)], "user_id long, source_domain string, effective_weight double")
    tables = FeedInputs(articles, owned, base.feedback, base.registry, liking)
    runs = spark.createDataFrame([(1, 1, 1), (2, 2, 2), (3, 3, 8), (4, 3, 9), (5, 4, 7)], "run_id long, user_id long, article_id long")
    cfg = replace(DEFAULT, max_candidates=25)
    shown = ["run_id", "article_id", "rank", "candidate_position", "total", "interest_similarity", "novelty", "source_preference", "is_read", "has_vector"]

    def best():
        found = related_articles(runs, tables, F.lit(NOW), cfg, size=6).select(*shown)
        return found, {r[:4]: r[4:] for r in map(tuple, found.collect())}

    def all_pairs(rows, front, limit, _best, cfg):
        return front_pairs(rows, front.drop("fixed", "authority"), front.count(), limit, cfg)

    with monkeypatch.context() as whole:
        whole.setattr(discover, "front_best", all_pairs)
        _, want = best()

    def no_pairs(*_args, **_more):
        raise AssertionError("a row per run and candidate")

    monkeypatch.setattr(discover, "front_pairs", no_pairs)
    found, got = best()
    assert got.keys() == want.keys() and len(got) == 30
    for key, values in want.items():
        assert got[key] == pytest.approx(values, abs=1e-8), key
    # The function that compares the totals of a run is called once for it.
    assert found._jdf.queryExecution().executedPlan().toString().split("Final Plan")[-1].split("Initial Plan")[0].count("ArrowEvalPython") == 1


def test_views_of_a_part_are_those_of_all_activity(spark):
    folder = "/root/testdata/sf0.001"
    whole, rows = Views(spark, folder), {}
    users = spark.range(0, 15, 3).select(F.col("id").alias("user_id"))
    articles = spark.range(0, 200, 3).select(F.col("id").alias("article_id"))
    for key, some in (("user_id", users), ("article_id", articles)):
        part = part_of(Views(spark, folder), some, key)
        for name in ("article_feedback", "user_articles"):
            rows[name] = sorted(map(tuple, getattr(part, name).collect()))
            assert rows[name] == sorted(map(tuple, getattr(whole, name).join(some, key, "left_semi").select(*getattr(part, name).columns).collect()))
            assert rows[name]
    part = part_of(Views(spark, folder), users, "user_id")
    liked = inputs(part).source_preferences
    all_liked = source_preferences(whole.feedback_events, whole.articles, CFG).join(users, "user_id", "left_semi").select(*liked.columns)
    assert sorted(map(tuple, liked.collect())) == sorted(map(tuple, all_liked.collect()))
    assert liked.count()


def test_preferences_replay_the_log_once(spark):
    v = Views(spark, "/root/testdata/sf0.001")
    plan = source_preferences(v.feedback_events, v.articles, CFG)._jdf.queryExecution().optimizedPlan().toString()
    assert "max_by" not in plan
