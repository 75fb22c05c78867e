"""Structured Streaming: windowed interest counters and preference learning."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.config import DEFAULT, EngineConfig
from millrace.operators import feedback as FB
from millrace.operators import preferences as P
from millrace.sources.sinks import BUCKETS, replace_users
from millrace.session import materialize

LATE = "7 days"


def weekly_topic_counts(events: DataFrame, articles: DataFrame, lateness: str = LATE) -> DataFrame:
    """Positive and negative posts per topic and Monday week on a live feedback stream.

    ``articles`` is a static table; rows later than the watermark are dropped (and counted by the
    query's progress metrics).  Windows of seven days start on Thursday 1970-01-01, hence the shift.
    """
    posts = events.filter(F.col("op") == "post").withWatermark("created_at", lateness)
    topics = articles.select("article_id", "topics")
    rows = posts.join(topics, "article_id").select("created_at", "action", F.explode("topics").alias("topic"))
    counts = rows.groupBy(F.window("created_at", "7 days", startTime="4 days"), "topic").agg(
        F.count_if(FB.is_positive()).alias("positive_count"),
        F.count_if(F.col("action") == "bad").alias("negative_count"),
    )
    return counts.select(F.col("window.start").alias("week"), "topic", "positive_count", "negative_count")


def preference_writer(
    spark: SparkSession,
    articles: DataFrame,
    owned: DataFrame,
    folder: str,
    cfg: EngineConfig = DEFAULT,
    after: Callable[[DataFrame], None] | None = None,
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function that keeps opinions, owned articles and preferences up to date.

    Each batch is appended to the feedback log under its batch id (a replay overwrites itself), then
    the users it touches are recomputed from the log and replaced in the state tables, so results
    equal the batch job and survive restarts.  ``after`` gets the touched users, e.g. to rebuild
    their interest clusters.
    """
    log_path = f"{folder}/feedback_log"

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = materialize(batch.withColumns({"batch_id": F.lit(batch_id), "bucket": F.pmod(F.xxhash64("user_id"), F.lit(BUCKETS)).cast("int")}))
        if rows.isEmpty():
            return
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id", "bucket").parquet(log_path)
        users = materialize(rows.select("user_id", "bucket").distinct())
        log = spark.read.parquet(log_path).filter(F.col("batch_id") <= batch_id)
        touched = F.broadcast(users.select("bucket").distinct())  # at most BUCKETS rows
        mine = log.join(touched, "bucket", "left_semi").join(users.select("user_id"), "user_id", "left_semi")
        mine = materialize(mine.drop("batch_id", "bucket"))
        base = owned.join(users.select("user_id"), "user_id", "left_semi")
        results = {
            "article_feedback": FB.latest_feedback(mine),
            "user_articles": FB.apply_feedback_to_owned(mine, base, cfg),
            "topic_preferences": P.topic_preferences(mine, articles, cfg),
            "source_preferences": P.source_preferences(mine, articles, cfg),
        }
        for name, frame in results.items():
            replace_users(frame, users, f"{folder}/{name}")
        if after is not None:
            after(users.select("user_id"))

    return write
