"""Runs with a candidate cap write their pairs last."""

from dataclasses import replace

from pyspark.sql import functions as F

from millrace.config import DEFAULT
from millrace.operators import scoring as S
from millrace.plans.discover import discover_feed
from tests.test_ranking import NOW, small_inputs


def test_capped_scores_move_no_pairs(spark, monkeypatch):
    def no_pairs(*_args, **_more):
        raise AssertionError("pairs are joined with their features")

    monkeypatch.setattr(S, "candidate_features", no_pairs)
    users = spark.createDataFrame([(1,), (2,), (3,)], "user_id long")
    run = discover_feed(users, small_inputs(spark), F.lit(NOW), replace(DEFAULT, max_candidates=25), size=10)
    totals = run.scored.select("user_id", "article_id", "total")
    plan = totals._jdf.queryExecution().executedPlan().toString()
    # Nothing is dealt anew above the explode that writes the pairs, which is the first one in the plan.
    assert "Exchange hashpartitioning" not in plan[: plan.index("Generate posexplode(shown")]
    assert {r["user_id"]: r["count"] for r in totals.groupBy("user_id").count().collect()} == {1: 25, 2: 25, 3: 25}
