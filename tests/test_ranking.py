"""Scoring and composition against plain Python, and the shape of the plans."""

import random
from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.config import DEFAULT, SLOTS
from millrace.functions.vectors import cosine
from millrace.functions import weights as W
from millrace.operators import scoring as S
from millrace.operators.compose import compose_feed, feed_shortlist, slot_fill, slot_quotas
from millrace.operators.profile import cluster_count
from millrace.operators.similarity import profile_features
from millrace.plans.discover import FeedInputs, discover_feed

NOW = datetime(2024, 1, 31)


def compose(rows, size, cfg):
    """Sequential composition of one run; rows in rank order."""
    quotas, used, picked = slot_quotas(size, cfg.composition), set(), {s: [] for s in SLOTS}

    def slot(r):
        if r["interest_similarity"] >= cfg.composition.strong_interest_min_similarity:
            return SLOTS[0]
        if r["is_primary_source"]:
            return SLOTS[1]
        return SLOTS[2] if r["novelty"] >= cfg.composition.exploration_min_novelty else SLOTS[3]

    for name in SLOTS:
        for r in rows:
            if slot(r) != name or len(picked[name]) >= quotas[name]:
                continue
            if name == "diversity" and r["source_domain"] in used:
                continue
            picked[name].append((r["article_id"], False))
            used.add(r["source_domain"])
    taken = {a for items in picked.values() for a, _ in items}
    spare = [r["article_id"] for r in rows if r["article_id"] not in taken]
    for name in SLOTS:
        while len(picked[name]) < quotas[name] and spare:
            picked[name].append((spare.pop(0), True))
    return {a: (name, b) for name, items in picked.items() for a, b in items}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_composition_equals_sequential_rule(spark, seed):
    rng = random.Random(seed)
    cfg, size = DEFAULT, 20
    rows = []
    for user in range(6):
        n = rng.choice([3, 15, 60])
        for rank in range(1, n + 1):
            rows.append((user, rank * 7 + user, rank, f"d{rng.randrange(6)}", rng.random() < 0.3, rng.random() * 0.8, rng.random()))
    names = ["user_id", "article_id", "rank", "source_domain", "is_primary_source", "interest_similarity", "novelty"]
    df = spark.createDataFrame(rows, names)
    feed = compose_feed(df, size, cfg)
    got = {}
    for r in feed.collect():
        got.setdefault(r["user_id"], {})[r["article_id"]] = (r["slot"], r["backfilled"])
    dicts = [dict(zip(names, r)) for r in rows]
    want = {u: compose([r for r in dicts if r["user_id"] == u], size, cfg) for u in range(6)}
    assert got == want
    users = spark.range(7).withColumnRenamed("id", "user_id")
    fill = slot_fill(feed, users, size, cfg).filter("user_id = 6").collect()
    assert len(fill) == 4 and all(r["selected"] == 0 for r in fill)


def test_slot_quotas_use_half_even_rounding():
    assert slot_quotas(100) == {"strong_interest": 55, "primary_source": 25, "exploration": 15, "diversity": 5}
    assert sum(slot_quotas(10).values()) == 10
    assert sum(slot_quotas(1).values()) == 1


def test_cluster_count():
    c = DEFAULT.clustering
    assert [cluster_count(n, c) for n in (0, 1, 2, 3, 5, 6, 24, 100)] == [0, 1, 1, 1, 1, 2, 8, 8]


def test_scalar_rules(spark):
    now = F.lit(NOW)
    row = (
        spark.range(1)
        .select(
            W.freshness(now, F.lit(NOW + timedelta(days=1)), 7).alias("future"),
            W.freshness(now, F.lit(NOW - timedelta(days=7)), 7).alias("old"),
            W.freshness(now, F.lit(NOW - timedelta(days=3, hours=12)), 7).alias("half"),
            W.recency_decay(F.lit(30.0), 30.0).alias("decay"),
            W.authority_gate(F.lit(0.0), DEFAULT).alias("gate0"),
            W.authority_gate(F.lit(0.35), DEFAULT).alias("gate1"),
            W.source_preference_factor(F.lit(100.0), DEFAULT).alias("liked"),
            W.source_preference_factor(F.lit(-100.0), DEFAULT).alias("disliked"),
            W.bad_similarity_penalty(F.lit(1.0), DEFAULT).alias("bad1"),
            W.bad_similarity_penalty(F.lit(0.69), DEFAULT).alias("bad0"),
            W.bad_similarity_penalty(F.lit(None).cast("double"), DEFAULT).alias("bad_none"),
            W.bad_similarity_penalty(F.lit(1.0), replace(DEFAULT, bad_min_similarity=1.0)).alias("no_span"),
            W.confidence(F.lit(False), F.lit(False), F.lit(False), DEFAULT).alias("floor"),
            S.source_topic_match(F.array(F.lit(" OpenX ")), F.array(F.lit("openx")), 0.5).alias("equal"),
            S.source_topic_match(F.array(F.lit("go")), F.array(F.lit("Golang")), 0.5).alias("part"),
            S.source_topic_match(F.array(F.lit(" ")), F.array(F.lit("x")), 0.5).alias("blank"),
            S.source_topic_match(F.lit(None).cast("array<string>"), F.array(F.lit("x")), 0.5).alias("none"),
            cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0))).alias("lengths"),
            cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("zero"),
        )
        .first()
    )
    assert row.asDict() == pytest.approx(
        dict(
            future=1, old=0, half=0.5, decay=0.5, gate0=0.2, gate1=1, liked=1.5, disliked=0.5, bad1=0.5, bad0=0,
            bad_none=0, no_span=0.5, floor=0.3, equal=1, part=0.5, blank=0, none=0, lengths=0, zero=0,
        )
    )


def test_profile_features_edge_cases(spark):
    cands = spark.createDataFrame(
        [(1, 1, [1.0, 0.0]), (1, 2, [0.0, 1.0]), (1, 3, [1.0]), (1, 4, None), (2, 1, [1.0, 0.0])],
        "user_id long, article_id long, embedding array<double>",
    )
    profile = spark.createDataFrame(
        [(1, "interest", 1, [1.0, 0.0], 1.0), (1, "interest", 2, [0.0, 1.0], -1.0), (1, "bad", 1, [0.0, 1.0], 1.0)],
        "user_id long, kind string, position int, vector array<double>, weight double",
    )
    for single in (True, False):
        rows = {(r[0], r[1]): r for r in profile_features(cands, profile, DEFAULT, single_block=single).collect()}
        assert set(rows) == {(1, 1), (1, 2), (1, 3), (2, 1)}
        # Weights cancel out: plain mean of the top similarities.
        assert rows[1, 1]["interest_similarity"] == pytest.approx(0.5)
        assert rows[1, 3]["interest_similarity"] == 0.0
        assert rows[2, 1]["interest_similarity"] == 0.0 and rows[2, 1]["bad_similarity"] is None
        assert rows[1, 2]["bad_similarity"] == pytest.approx(1.0)
        assert rows[1, 1]["neighbor_similarity"] == pytest.approx(0.0)
        assert rows[1, 3]["neighbor_similarity"] is None and rows[2, 1]["neighbor_similarity"] is None
        assert rows[1, 1]["centroid_similarity"] is None


def small_inputs(spark, n=60):
    articles = spark.range(n).select(
        F.col("id").alias("article_id"),
        F.concat(F.lit("d"), F.col("id") % 7).alias("source_domain"),
        F.concat(F.lit("title "), "id").alias("title"),
        F.lit(None).cast("string").alias("translated_title"),
        F.lit("text").alias("summary"),
        F.array(F.lit("go")).alias("topics"),
        F.array(F.lit("rust")).alias("technologies"),
        F.lit("completed").alias("analysis_status"),
        (F.lit(0.2) + (F.col("id") % 5) * 0.2).alias("source_authority"),
        (F.col("id") % 5 == 4).alias("is_primary_source"),
        F.lit(0.5).alias("technical_quality"),
        (F.lit(NOW) - F.make_dt_interval(F.col("id").cast("int") % 10)).alias("published_at"),
        F.lit(NOW).alias("fetched_at"),
        F.lit(0.0).alias("duplicate_penalty"),
        (F.col("id") % 13 == 0).alias("is_dead"),
        F.when(F.col("id") % 3 != 0, F.transform(F.sequence(F.lit(1), F.lit(4)), lambda k: F.sin(F.col("id") * k).cast("float"))).alias("embedding"),
    )
    owned = spark.createDataFrame(
        [(1, 1, "manual", 1.0, NOW), (1, 2, "good", 0.8, NOW), (2, 4, "clicked", 0.1, NOW)],
        "user_id long, article_id long, origin string, interest_weight double, created_at timestamp",
    )
    feedback = spark.createDataFrame([(1, 5, "bad", NOW), (2, 7, "good", NOW)], "user_id long, article_id long, action string, created_at timestamp")
    registry = spark.createDataFrame([("Go", "d1", None)], "entity_name string, domain string, github_org string")
    liking = spark.createDataFrame([(1, "d2", 2.0)], "user_id long, source_domain string, effective_weight double")
    return FeedInputs(articles, owned, feedback, registry, liking)


def test_discover_feed_rules(spark):
    inputs = small_inputs(spark)
    users = spark.createDataFrame([(1,), (2,), (3,)], "user_id long")
    run = discover_feed(users, inputs, F.lit(NOW), replace(DEFAULT, max_candidates=25), size=10)
    ranked = run.ranked.collect()
    seen = {(r["user_id"], r["article_id"]) for r in ranked}
    assert not seen & {(1, 1), (1, 2), (1, 5)}  # owned or Bad
    assert {r["article_id"] for r in ranked}.isdisjoint({0, 13, 26, 39, 52})  # dead
    assert all(r["article_id"] % 10 <= 7 for r in ranked)  # older than seven days
    assert {u for u, _ in seen} == {1, 2, 3}
    per_user = {u: sum(1 for x, _ in seen if x == u) for u in (1, 2, 3)}
    assert per_user == {1: 25, 2: 25, 3: 25}
    report = {r["user_id"]: (r["eligible"], r["truncated"]) for r in run.report.collect()}
    alive = [i for i in range(60) if i % 13 and i % 10 <= 7]
    assert report == {1: (len(alive) - 3, len(alive) - 28), 2: (len(alive), len(alive) - 25), 3: (len(alive), len(alive) - 25)}
    read = [r for r in ranked if (r["user_id"], r["article_id"]) == (2, 4)]
    assert all(r["is_read"] and r["read_penalty"] == 0.3 for r in read)
    assert run.feed.groupBy("user_id").count().filter("count != 10").isEmpty()
    # A user without any history has no vectors to compare: neutral novelty.
    assert all(r["novelty"] == 0.5 for r in ranked if r["user_id"] == 3)


def test_no_products_in_plans(spark):
    inputs = small_inputs(spark)
    features = S.candidate_features(
        spark.createDataFrame([(1, 3, 1)], "user_id long, article_id long, candidate_position int"),
        inputs.articles,
        inputs.user_articles,
        inputs.registry,
        inputs.source_preferences,
        spark.createDataFrame(
            [(1, 3, 0.1, 0.1, 0.1, 0.1)],
            "user_id long, article_id long, interest_similarity double, bad_similarity double, centroid_similarity double, neighbor_similarity double",
        ),
    )
    frames = [
        S.score(features, F.lit(NOW), DEFAULT),
        inputs.articles.join(S.exclusions(inputs.feedback, inputs.user_articles), "article_id", "left_anti"),
    ]
    for df in frames:
        plan = df._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "LeftAnti" in frames[1]._jdf.queryExecution().toString()


def test_filters_reach_the_scan(spark, tmp_path):
    small_inputs(spark).articles.write.parquet(str(tmp_path / "a"))
    df = spark.read.parquet(str(tmp_path / "a")).filter(~F.col("is_dead") & (F.col("source_domain") == "d1")).select("article_id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "EqualTo(source_domain," in plan and "embedding" not in plan


def test_group_limit_before_the_shuffle(spark):
    from millrace.operators.feedback import recency_cut

    df = small_inputs(spark).user_articles
    plan = recency_cut(df, 200)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_runs_are_replaced_and_read_by_page(spark, tmp_path):
    from millrace.operators.filters import ArticleFilter
    from millrace.operators.scoring import REASON_FIELDS
    from millrace.sources.sinks import latest_runs, read_page, write_run

    names = ["user_id", "article_id", "feed_rank", *REASON_FIELDS]
    rows = [tuple([u, 10 * u + k, k] + [float(k)] * len(REASON_FIELDS)) for u in (1, 2) for k in (1, 2, 3)]
    schema = ", ".join(f"{n} {'long' if n in ('user_id', 'article_id') else 'int' if n == 'feed_rank' else 'double'}" for n in names)
    feed, path = spark.createDataFrame(rows, schema), str(tmp_path / "store")
    early, late = (F.lit(f"2024-01-0{d} 00:00:00").cast("timestamp") for d in (1, 2))
    for run_id, at, fingerprint in (("a", early, "x"), ("b", late, "x"), ("c", late, "y"), ("b", late, "x")):
        write_run(feed, path, run_id, at, fingerprint=fingerprint)
    newest = {(r.user_id, r.fingerprint): r.run_id for r in latest_runs(spark.read.parquet(f"{path}/runs")).collect()}
    assert newest == {(1, "x"): "b", (2, "x"): "b", (1, "y"): "c", (2, "y"): "c"}
    stored = spark.read.parquet(f"{path}/recommendations")
    assert stored.count() == 18 and stored.filter("reasons.summary is null").count() == 0
    assert sorted((r.user_id, r["rank"]) for r in read_page(stored, "b", 2, 2).collect()) == [(1, 3), (2, 3)]
    assert ArticleFilter().fingerprint() == ArticleFilter(topics=()).fingerprint() != ArticleFilter(query="x").fingerprint()


def test_default_scores_every_candidate_and_the_whole_history(spark):
    from millrace.operators.feedback import recency_cut
    from millrace.operators.profile import bad_vectors

    times = F.lit(NOW) - F.make_dt_interval(F.lit(0), F.lit(0), F.col("id").cast("int"))
    pool = spark.range(600).select(F.col("id").alias("article_id"), times.alias("published_at"))
    users = spark.createDataFrame([(1,), (2,)], "user_id long")
    hidden = spark.createDataFrame([(1, 3)], "user_id long, article_id long")
    chosen, report = S.select_candidates(users, pool, hidden, DEFAULT.max_candidates)
    got = {(r.user_id, r.article_id): r.candidate_position for r in chosen.collect()}
    assert len(got) == 1199 and got[2, 599] == 600 and got[1, 599] == 599 and got[1, 2] == 3 and got[1, 4] == 4
    assert [r.truncated for r in report.collect()] == [0, 0]
    history = pool.select(F.lit(1).cast("long").alias("user_id"), "article_id", F.col("published_at").alias("created_at"))
    kept = recency_cut(history, DEFAULT.max_profile_articles).collect()
    assert len(kept) == 600 and all(r.position == r.article_id + 1 for r in kept)
    vectors = pool.select("article_id", F.array(F.lit(1.0)).alias("embedding"))
    assert bad_vectors(history.withColumn("action", F.lit("bad")), vectors, DEFAULT).count() == 600


@pytest.mark.parametrize("limit", [None, 7, 25])
def test_candidates_are_written_without_a_sort_of_pairs(spark, monkeypatch, limit):
    monkeypatch.setattr(S, "BLOCK_PLACES", 8, raising=False)
    times = F.when(F.col("id") % 9 != 0, F.lit(NOW) - F.make_dt_interval(F.col("id").cast("int") % 5))
    pool = spark.range(30).select(F.col("id").alias("article_id"), times.alias("published_at"))
    users = spark.createDataFrame([(u,) for u in range(5)], "user_id long")
    rng = random.Random(8)
    pairs = {(1, a) for a in range(30)} | {(2, rng.randrange(40)) for _ in range(9)} | {(3, 29), (3, 0), (3, 5), (9, 4)}
    chosen, report = S.select_candidates(users, pool, spark.createDataFrame(sorted(pairs), "user_id long, article_id long"), limit)
    order = [r.article_id for r in pool.orderBy(*S.candidate_order()).collect()]
    want, left = {}, {}
    for user in range(5):
        seen = [a for a in order if (user, a) not in pairs]
        left[user] = (len(seen), max(0, len(seen) - (limit or 30)))
        want.update({(user, a): k for k, a in enumerate(seen[:limit], 1)})
    assert {(r.user_id, r.article_id): r.candidate_position for r in chosen.collect()} == want
    assert {r.user_id: (r.eligible, r.truncated) for r in report.collect()} == left
    # Nothing follows the join with the blocks of the pool but the output of pairs.
    last = chosen._jdf.queryExecution().executedPlan().toString().split("Join")[0]
    assert "Generate posexplode" in last and not any(step in last for step in ("Exchange", "Window", "Sort"))


def test_feed_of_the_shortlist_equals_the_feed_of_all_candidates(spark):
    rng, size = random.Random(4), 10
    rows = [(user, i, round(rng.random(), 2), f"d{rng.randrange(300)}", rng.random() < share, rng.random() * 0.8, rng.random())
            for user, share in ((1, 0.3), (2, 0.0)) for i in range(2000)]
    names = ["user_id", "article_id", "total", "source_domain", "is_primary_source", "interest_similarity", "novelty"]
    scored = spark.createDataFrame(rows, names)
    few = feed_shortlist(scored, size)

    def feed(candidates):
        shown = compose_feed(S.rank(candidates), size).select("user_id", "article_id", "slot", "backfilled", "feed_rank")
        return sorted(tuple(r) for r in shown.collect())

    assert few.count() <= 2 * 9 * size  # 4,000 candidates
    assert feed(scored.join(few, ["user_id", "article_id"], "left_semi")) == feed(scored)


def test_uncapped_job_equals_a_cap_nobody_meets(spark):
    inputs = small_inputs(spark)
    users = spark.createDataFrame([(1,), (2,), (3,)], "user_id long")
    names = ["user_id", "article_id", "rank", "total", "interest_similarity", "bad_similarity", "novelty"]

    def rows(cfg):
        run = discover_feed(users, inputs, F.lit(NOW), cfg, size=10)
        ranked = {(r[0], r[1]): r[2:] for r in run.ranked.select(*names).collect()}
        return ranked, sorted(tuple(r) for r in run.feed.select("user_id", "article_id", "slot", "feed_rank").collect())

    whole, feed = rows(replace(DEFAULT, vector_tile_rows=16))
    capped, other = rows(replace(DEFAULT, max_candidates=1000, max_profile_articles=200, max_bad_articles=100))
    assert whole.keys() == capped.keys() and feed == other
    for key, values in whole.items():
        assert values == pytest.approx(capped[key], abs=1e-8), key
