"""Interest jobs: clusters, feedback application, dashboards, ranking diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.config import DEFAULT, EngineConfig
from millrace.operators import dashboards as D
from millrace.operators import diagnostics as G
from millrace.operators import feedback as FB
from millrace.operators import preferences as P
from millrace.operators import profile as PR
from millrace.plans.discover import FeedRun
from millrace.session import materialize
from millrace.sources.sinks import replace_users


def rebuild_interest_clusters(
    users: DataFrame,
    user_articles: DataFrame,
    feedback: DataFrame,
    articles: DataFrame,
    now: Column,
    cfg: EngineConfig = DEFAULT,
    path: str | None = None,
) -> DataFrame:
    """Fresh clusters of the given users; with ``path`` they replace the stored ones."""
    keep = users.select("user_id").distinct()
    mine = [df.join(keep, "user_id", "left_semi") for df in (user_articles, feedback)]
    weighted = PR.weighted_interest(mine[0], mine[1], articles, now, cfg)
    members = materialize(PR.assign_clusters(weighted, cfg.clustering))
    clusters = materialize(PR.interest_clusters(members, cfg.clustering))
    if path is not None:
        replace_users(clusters, keep, path)
    return clusters


def apply_feedback(
    events: DataFrame, owned: DataFrame, articles: DataFrame, cfg: EngineConfig = DEFAULT
) -> dict[str, DataFrame]:
    """All state that follows from a feedback log."""
    return {
        "article_feedback": FB.latest_feedback(events),
        "user_articles": FB.apply_feedback_to_owned(events, owned, cfg),
        "topic_preferences": P.topic_preferences(events, articles, cfg),
        "source_preferences": P.source_preferences(events, articles, cfg),
    }


def interest_summary(
    user_articles: DataFrame,
    feedback: DataFrame,
    topic_preferences: DataFrame,
    articles: DataFrame,
    cfg: EngineConfig = DEFAULT,
) -> dict[str, DataFrame]:
    """The summary dashboard of every user, one frame per panel."""
    limit = cfg.summary_limit
    return {
        "genres": D.genre_interest(feedback, articles, limit),
        "feedback_ratio": D.feedback_ratio(feedback, ("user_id",)),
        "technologies": D.technology_counts(feedback, articles, limit),
        "primary_ratio": D.primary_ratio(feedback, articles),
        "content_types": D.content_type_counts(feedback, articles, limit),
        "difficulties": D.difficulty_counts(feedback, articles, limit),
        "suppressed_topics": P.suppressed_topics(topic_preferences, limit),
        "origins": FB.origin_counts(FB.interest_population(user_articles, feedback), cfg.max_profile_articles),
    }


def interest_timeline(
    user_articles: DataFrame, feedback: DataFrame, articles: DataFrame, now: Column, weeks: int = DEFAULT.timeline_weeks
) -> DataFrame:
    """Weekly buckets of every user."""
    timeline = D.topic_timeline(feedback, articles, now, weeks)
    return D.timeline_buckets(timeline, D.weekly_additions(user_articles, now, weeks))


def novelty_distribution(run: FeedRun, cfg: EngineConfig = DEFAULT) -> DataFrame:
    return G.novelty_distribution(run.scored, cfg.composition) if run.whole is None else G.run_novelty_distribution(run.whole, cfg.composition)


def threshold_sweep(run: FeedRun, cfg: EngineConfig = DEFAULT) -> DataFrame:
    return G.threshold_sweep(run.scored, cfg.composition) if run.whole is None else G.run_threshold_sweep(run.whole, cfg.composition)


def slot_divergence(run: FeedRun, cfg: EngineConfig = DEFAULT) -> DataFrame:
    return G.slot_divergence(run.scored, cfg.composition) if run.whole is None else G.run_slot_divergence(run.whole, cfg.composition)


def fill_record(run: FeedRun) -> DataFrame:
    """Quota, selected, backfilled and fill rate per slot over all users of a feed run; reads the composed feed alone."""
    quota, selected = F.sum("quota"), F.sum("selected")
    return run.slots.groupBy("slot").agg(
        quota.alias("quota"), selected.alias("selected"), F.sum("backfilled").alias("backfilled"),
        F.coalesce(F.try_divide(selected, quota), F.lit(0.0)).alias("fill_rate"),
    )


def ranking_diagnostics(
    run: FeedRun,
    cfg: EngineConfig = DEFAULT,
    articles: DataFrame | None = None,
    clusters: tuple[DataFrame, DataFrame] | None = None,
    body_limit: int = 12_000,
) -> dict[str, DataFrame]:
    """Distribution, sweep, correlation, divergence and slot fill of a feed run; with ``articles`` also body lengths,
    with ``clusters`` (members, clusters) also cluster sizes."""
    record = {
        "novelty_distribution": novelty_distribution(run, cfg),
        "threshold_sweep": threshold_sweep(run, cfg),
        "rank_correlation": G.spearman(run.spread, "novelty", "interest_similarity", "n"),
        "slot_divergence": slot_divergence(run, cfg),
        "slot_fill": fill_record(run),
    }
    if articles is not None:
        record["body_lengths"] = G.body_length_stats(articles, body_limit)
    if clusters is not None:
        record["cluster_sizes"] = PR.cluster_sizes(*clusters)
    return record
