"""Runs without a candidate cap: pairs are written last."""

import random
from dataclasses import replace
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from millrace.config import DEFAULT
from millrace.operators import diagnostics as G, scoring as S
from millrace.operators.compose import compose_feed
from millrace.plans import discover, interest as plans
from millrace.operators.whole_runs import WholeRuns
from millrace.plans.discover import FeedInputs, discover_feed
from millrace.plans.interest import fill_record
from tests.test_ranking import NOW, small_inputs

SIZE = 20
CFG = replace(DEFAULT, vector_tile_rows=16, composition=replace(DEFAULT.composition, strong_interest_min_similarity=0.8, exploration_min_novelty=0.6))


def mixed_inputs(spark):
    """Vectors of two widths, many hidden neighbours, liked domains, and articles opened before."""
    base, rng = small_inputs(spark, 150), random.Random(11)
    vectors = [(i, [rng.random() - 0.5 for _ in range(2 if i % 31 == 8 else 3)]) for i in range(150) if i % 3]
    articles = base.articles.withColumn("source_domain", F.concat(F.lit("d"), F.col("article_id") % 41)).drop("embedding").join(spark.createDataFrame(vectors, "article_id long, embedding array<float>"), "article_id", "left")
    origins = ("clicked", "read_full", "good", "manual")
    owned = spark.createDataFrame(
        [(u, i, origins[(i + u) % 4], 0.1, NOW - timedelta(days=i)) for u in (1, 2, 3) for i in range(u, 60, 3 + u)],
        "user_id long, article_id long, origin string, interest_weight double, created_at timestamp",
    )
    feedback = spark.createDataFrame([(u, i, "bad", NOW) for u in (2, 3) for i in range(70, 150, 9 * u)], "user_id long, article_id long, action string, created_at timestamp")
    liking = spark.createDataFrame([(1, "d2", 2.0), (2, "d1", -9.0), (3, "d0", 1.0), (3, "elsewhere", 1.0)], "user_id long, source_domain string, effective_weight double")
    return FeedInputs(articles, owned, feedback, base.registry, liking)


@pytest.fixture(scope="module")
def both(spark):
    """The run of whole rows, and the one that joins pairs with their features."""
    users = spark.createDataFrame([(1,), (2,), (3,), (4,)], "user_id long")
    inputs = mixed_inputs(spark)
    with pytest.MonkeyPatch.context() as plain:
        plain.setattr(discover, "whole_runs", lambda *_: None)
        pairs = discover_feed(users, inputs, F.lit(NOW), CFG, size=SIZE)
        want = {(r.user_id, r.article_id): r.asDict() for r in pairs.ranked.collect()}
    return discover_feed(users, inputs, F.lit(NOW), CFG, size=SIZE), pairs, want


def test_feed_candidates_are_what_the_feed_of_all_candidates_picks(spark, both, monkeypatch):
    whole, pairs, want = both
    slots = ["user_id", "article_id", "slot", "backfilled", "feed_rank"]
    feed = sorted(map(tuple, compose_feed(pairs.ranked, SIZE, CFG).select(*slots).collect()))
    assert len({r[2] for r in feed}) == 4 and len({r[0] for r in feed}) == 4
    few = whole.whole.feed_candidates(SIZE)
    assert {(r.user_id, r.article_id): r["rank"] for r in few.collect()} == {(u, a): want[u, a]["rank"] for u, a, *_ in feed}

    def no_pairs(*_args, **_more):
        raise AssertionError("pairs are joined with their features")

    for step in ("candidate_features", "select_candidates"):
        monkeypatch.setattr(S, step, no_pairs)
    assert sorted(map(tuple, whole.picks.select(*slots).collect())) == feed
    assert sorted(map(tuple, whole.feed.select(*slots).collect())) == feed
    assert {r.user_id: (r.eligible, r.truncated) for r in whole.report.collect()} == {r.user_id: (r.eligible, r.truncated) for r in pairs.report.collect()}


def test_whole_runs_rank_and_score_like_joined_pairs(both):
    whole, _, want = both
    assert {(r.user_id, r.article_id): r["rank"] for r in whole.ranks.collect()} == {key: r["rank"] for key, r in want.items()}
    for frame in (whole.ranked, whole.scored):
        got = {(r.user_id, r.article_id): r.asDict() for r in frame.collect()}
        assert got.keys() == want.keys()
        for key, row in got.items():
            assert {n: row.get(n) for n in row} == {n: v if not isinstance(v, float) else pytest.approx(v, abs=1e-9) for n, v in want[key].items() if n in row}, key
        missing = set(next(iter(want.values()))) - set(next(iter(got.values())))
        assert missing <= {"rank"}


def test_ranks_are_written_without_a_shuffle_or_a_checkpoint_of_pairs(both, monkeypatch):
    whole, _, _ = both
    monkeypatch.setattr(S, "rank_unbounded", lambda *_: pytest.fail("pairs are ordered by Spark"))
    plan = whole.ranks._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and not any(step in plan for step in ("Exchange", "Sort", "Window"))


def test_pages_and_fill_record_read_the_picks_alone(both, monkeypatch):
    whole, pairs, _ = both
    fill = {r.slot: tuple(r) for r in fill_record(pairs).collect()}

    class Unread:
        def __get__(self, *_):
            raise AssertionError("scores of all candidates are read")

    for name in ("scored", "ranked"):
        monkeypatch.setattr(WholeRuns, name, Unread())
    assert {r.slot: tuple(r) for r in fill_record(whole).collect()} == fill
    shown = [r.feed_rank for r in whole.picks.filter(F.col("feed_rank").between(11, 20)).collect()]
    assert sorted(shown) == sorted(list(range(11, 21)) * 4)


def test_diagnostics_of_whole_runs_are_counted_in_their_tasks(both, monkeypatch):
    whole, pairs, _ = both
    jobs = (plans.novelty_distribution, plans.threshold_sweep, plans.slot_divergence, lambda run, _cfg: G.spearman(run.spread, "novelty", "interest_similarity", "n"))
    want = [[r.asDict() for r in job(pairs, CFG).collect()] for job in jobs]
    assert want[0][0]["candidate_count"] > 400 and want[2][0]["diversity_count"] > 0

    class Unread:
        def __get__(self, *_):
            raise AssertionError("a row per candidate is written")

    for name in ("scored", "ranked"):
        monkeypatch.setattr(WholeRuns, name, Unread())
    for job, rows in zip(jobs, want, strict=True):
        got = [r.asDict() for r in job(replace(whole, scored=None), CFG).collect()]
        assert got == [{n: v if not isinstance(v, float) else pytest.approx(v, abs=1e-9) for n, v in row.items()} for row in rows]


def test_similarities_of_whole_runs_are_written_once(both):
    whole, pairs, want = both
    similar = whole.whole.similar
    got = {(r.user_id, r.article_id): r.asDict() for r in similar.collect()}
    assert got.keys() == {key for key, r in want.items() if r["has_vector"]}
    for key, row in got.items():
        assert row == {n: want[key][n] if want[key][n] is None or n in S.PAIR else pytest.approx(want[key][n], abs=1e-9) for n in row}, key
    plan = similar._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and not any(step in plan for step in ("Exchange", "Join"))
