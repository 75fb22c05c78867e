"""Topic and source preferences learned from the feedback log.

The rule is path dependent: positive weight grows with every Good or Save post, also repeats; the
negative weight is recomputed only when a Bad arrives or an opinion is removed.  Replaying a key
event by event would put a hot key into one task, so the replay is decomposed:

* positive weight is a count;
* negative weight is the recent-window rule applied to the opinions *as of* the last event that
  triggered a recomputation, found with one ``max`` and re-aggregated from the log up to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.config import DEFAULT, DecaySettings, EngineConfig
from millrace.functions.weights import negative_weight, source_effective, topic_effective
from millrace.operators.distributed import ordered_lag, running_total, top_per_key
from millrace.operators.feedback import is_positive, latest_feedback
from millrace.session import materialize


def topic_keys(articles: DataFrame) -> DataFrame:
    """(article_id, key) per topic."""
    return articles.select("article_id", F.explode(F.array_distinct("topics")).alias("key"))


def source_keys(articles: DataFrame) -> DataFrame:
    """(article_id, key) with the source domain as key."""
    return articles.select("article_id", F.col("source_domain").alias("key"))


def recent_actions(feedback: DataFrame, keys: DataFrame, window: int) -> DataFrame:
    """Newest ``window`` opinions per (user, key): time descending, article id descending."""
    order = [F.col("created_at").desc(), F.col("article_id").desc()]
    return top_per_key(feedback.join(keys, "article_id"), ["user_id", "key"], order, window)


def snapshot_negative_weights(feedback: DataFrame, keys: DataFrame, settings: DecaySettings) -> DataFrame:
    """Negative weight per (user, key) if it were recomputed now from the current opinions."""
    recent = recent_actions(feedback, keys, settings.recent_window)
    bad = recent.groupBy("user_id", "key").agg(F.count_if(F.col("action") == "bad").alias("bad_count"))
    return bad.withColumn("negative_weight", negative_weight(F.col("bad_count"), settings))


def effective_events(events: DataFrame) -> DataFrame:
    """Drop deletes that found no opinion, and flag posts that created one (``opens``)."""
    rows = ordered_lag(events, ["user_id", "article_id"], ["seq"], ["op"])
    had_opinion = F.coalesce(F.col("prev_op") == "post", F.lit(False))
    return (
        rows.filter((F.col("op") == "post") | had_opinion)
        .withColumn("opens", (F.col("op") == "post") & ~had_opinion)
        .drop("prev_op")
    )


def learn_preferences(
    events: DataFrame, keys: DataFrame, settings: DecaySettings, effective: Column, cfg: EngineConfig = DEFAULT
) -> DataFrame:
    """Preference rows after the whole log: (user_id, key, positive, negative, effective)."""
    log = materialize(effective_events(events).join(keys, "article_id"))
    group = ["user_id", "key"]
    trigger = (F.col("action") == "bad") | (F.col("op") == "delete")
    totals = log.groupBy(*group).agg(
        (
            F.count_if(F.col("action") == "good") * F.lit(cfg.feedback.good)
            + F.count_if(F.col("action") == "save") * F.lit(cfg.feedback.save)
        ).alias("positive_weight"),
        F.count_if(is_positive()).alias("gains"),
        F.max(F.when(trigger, F.col("seq"))).alias("last_trigger"),
    )
    triggered = totals.filter(F.col("last_trigger").isNotNull()).select(*group, "last_trigger")
    as_of = log.join(triggered, group).filter(F.col("seq") <= F.col("last_trigger"))
    opinions = latest_feedback(as_of, extra_keys=("key",))
    order = [F.col("created_at").desc(), F.col("article_id").desc()]
    recent = top_per_key(opinions, group, order, settings.recent_window)
    negative = (
        recent.groupBy(*group)
        .agg(F.count_if(F.col("action") == "bad").alias("bad_count"))
        .select(*group, negative_weight(F.col("bad_count"), settings).alias("negative_weight"))
    )
    # One row per key for three readers: the log is replayed once.
    joined = materialize(
        totals.join(negative, group, "left").withColumn("negative_weight", F.coalesce("negative_weight", F.lit(0.0)))
    )
    silent = joined.filter((F.col("gains") == 0) & (F.col("negative_weight") == 0)).select(*group)
    written = _once_penalised(log, silent, settings)
    return (
        joined.join(written.withColumn("written", F.lit(True)), group, "left")
        .filter((F.col("gains") > 0) | (F.col("negative_weight") > 0) | F.col("written"))
        .select(*group, "positive_weight", "negative_weight", effective.alias("effective_weight"))
    )


def _once_penalised(log: DataFrame, silent: DataFrame, settings: DecaySettings) -> DataFrame:
    """Keys with Bad opinions only whose weight is back at zero but once was not: their row stays.

    All opinions of such a key are Bad, so it was penalised when the number of open opinions
    reached the threshold: a running sum of opened minus removed opinions.
    """
    group = ["user_id", "key"]
    change = F.when(F.col("opens"), 1).when(F.col("op") == "delete", -1).otherwise(0)
    steps = log.join(silent, group).select(*group, "seq", "article_id", change.alias("change"))
    order = [F.col(c) for c in (*group, "seq", "article_id")]
    running = running_total(steps, order, "change")
    level = F.col("total_before") + F.col("change")
    peaks = running.groupBy(*group).agg(
        F.max(level).alias("peak"), F.min_by("total_before", F.struct("seq", "article_id")).alias("base")
    )
    threshold = settings.bad_threshold
    if settings.recent_window < threshold:
        return peaks.select(*group).limit(0)
    return peaks.filter(F.col("peak") - F.col("base") >= threshold).select(*group)


def topic_preferences(events: DataFrame, articles: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    effective = topic_effective(F.col("positive_weight"), F.col("negative_weight"))
    return learn_preferences(events, topic_keys(articles), cfg.topic_decay, effective, cfg).withColumnRenamed(
        "key", "topic"
    )


def source_preferences(events: DataFrame, articles: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    effective = source_effective(F.col("positive_weight"), F.col("negative_weight"))
    return learn_preferences(events, source_keys(articles), cfg.source_decay, effective, cfg).withColumnRenamed(
        "key", "source_domain"
    )


def suppressed_topics(preferences: DataFrame, limit: int = DEFAULT.summary_limit) -> DataFrame:
    """Topics with a negative weight, strongest suppression first, ``limit`` per user."""
    order = [F.col("negative_weight").desc(), F.col("topic").asc()]
    return top_per_key(preferences.filter(F.col("negative_weight") > 0), ["user_id"], order, limit)


def topic_list(preferences: DataFrame, page: int, size: int) -> DataFrame:
    """One page of every user's topics by effective weight, equal weights by name.  A user has one row per topic."""
    first = (page - 1) * size + 1
    ranked = top_per_key(preferences, ["user_id"], [F.desc("effective_weight"), F.col("topic").asc()], first + size - 1)
    return ranked.filter(F.col("position") >= first)
