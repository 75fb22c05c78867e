"""Interest dashboards: counts per user over opinions and owned articles.

Feedback holds one row per (user, article); every count is a map-side combined aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.config import ACTIONS, DEFAULT, DIFFICULTIES, OWNED_ORIGINS
from millrace.operators.distributed import top_per_key
from millrace.operators.feedback import is_positive


def with_articles(rows: DataFrame, articles: DataFrame, *columns: str) -> DataFrame:
    """Attach the named article columns; the rest of the article is pruned at the scan."""
    return rows.join(articles.select("article_id", *columns), "article_id")


def domain_counts(user_articles: DataFrame, articles: DataFrame) -> DataFrame:
    """Registered articles per source domain."""
    rows = user_articles.filter(F.col("origin").isin(*OWNED_ORIGINS)).select("user_id", "article_id")
    return (
        with_articles(rows, articles, "source_domain")
        .filter(F.col("source_domain") != "")
        .groupBy("user_id", "source_domain")
        .agg(F.count("*").alias("article_count"))
        .orderBy("user_id", F.desc("article_count"), "source_domain")
    )


def feedback_ratio(feedback: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts per action; without ``by`` exactly one row, also for an empty table."""
    return feedback.groupBy(*by).agg(
        *[F.count_if(F.col("action") == name).alias(f"{name}_count") for name in ACTIONS]
    )


def genre_interest(feedback: DataFrame, articles: DataFrame, limit: int = DEFAULT.summary_limit) -> DataFrame:
    """Positive and negative opinions per genre."""
    counts = (
        with_articles(feedback, articles, "domain")
        .groupBy("user_id", "domain")
        .agg(
            F.count_if(is_positive()).alias("positive_count"),
            F.count_if(F.col("action") == "bad").alias("negative_count"),
        )
    )
    order = [F.desc("positive_count"), F.asc_nulls_last("domain")]
    return top_per_key(counts, ["user_id"], order, limit)


def _liked_counts(rows: DataFrame, column: str, limit: int) -> DataFrame:
    counts = rows.groupBy("user_id", column).agg(F.count("*").alias("article_count"))
    return top_per_key(counts, ["user_id"], [F.desc("article_count"), F.asc_nulls_last(column)], limit)


def technology_counts(feedback: DataFrame, articles: DataFrame, limit: int = DEFAULT.summary_limit) -> DataFrame:
    liked = with_articles(feedback.filter(is_positive()), articles, "technologies")
    rows = liked.select("user_id", F.explode("technologies").alias("technology"))
    return _liked_counts(rows, "technology", limit)


def primary_ratio(feedback: DataFrame, articles: DataFrame) -> DataFrame:
    liked = with_articles(feedback.filter(is_positive()), articles, "is_primary_source")
    return liked.groupBy("user_id").agg(
        F.count_if("is_primary_source").alias("primary_count"),
        F.count_if(~F.col("is_primary_source")).alias("secondary_count"),
    )


def content_type_counts(feedback: DataFrame, articles: DataFrame, limit: int = DEFAULT.summary_limit) -> DataFrame:
    liked = with_articles(feedback.filter(is_positive()), articles, "content_type")
    return _liked_counts(liked, "content_type", limit)


def difficulty_counts(feedback: DataFrame, articles: DataFrame, limit: int = DEFAULT.summary_limit) -> DataFrame:
    """Counts per difficulty with the display position: beginner to advanced, unknown last."""
    liked = with_articles(feedback.filter(is_positive()), articles, "difficulty")
    counts = _liked_counts(liked, "difficulty", limit)
    known = F.array(*[F.lit(d) for d in DIFFICULTIES])
    place = F.coalesce(F.array_position(known, F.col("difficulty")), F.lit(0))
    return counts.withColumn("display_order", F.when(place > 0, place).otherwise(len(DIFFICULTIES) + 1))


def week_start(moment: Column) -> Column:
    """Monday 00:00 UTC of the week (the session time zone is pinned to UTC)."""
    return F.date_trunc("week", moment)


def since_weeks(now: Column, weeks: int) -> Column:
    return now - F.expr(f"INTERVAL {int(weeks) * 7} DAYS")


def topic_timeline(feedback: DataFrame, articles: DataFrame, now: Column, weeks: int) -> DataFrame:
    recent = feedback.filter(F.col("created_at") >= since_weeks(now, weeks))
    return (
        with_articles(recent, articles, "topics")
        .select("user_id", week_start(F.col("created_at")).alias("week"), "action", F.explode("topics").alias("topic"))
        .groupBy("user_id", "week", "topic")
        .agg(
            F.count_if(is_positive()).alias("positive_count"),
            F.count_if(F.col("action") == "bad").alias("negative_count"),
        )
    )


def weekly_additions(user_articles: DataFrame, now: Column, weeks: int) -> DataFrame:
    recent = user_articles.filter(F.col("created_at") >= since_weeks(now, weeks))
    return recent.groupBy("user_id", week_start(F.col("created_at")).alias("week")).agg(
        F.count("*").alias("interest_article_count")
    )


def weekly_totals(timeline: DataFrame) -> DataFrame:
    """Sum over topics: an opinion on an article with two topics counts twice."""
    return timeline.groupBy("user_id", "week").agg(
        F.sum("positive_count").alias("positive_total"), F.sum("negative_count").alias("negative_total")
    )


def timeline_buckets(timeline: DataFrame, additions: DataFrame) -> DataFrame:
    """One row per user and week with either kind of data: additions, and the topics in order.

    The list is bounded by the topics a user touched in a week.
    """
    topics = timeline.groupBy("user_id", "week").agg(
        F.sort_array(F.collect_list(F.struct("topic", "positive_count", "negative_count"))).alias("topics")
    )
    empty = F.array().cast(topics.schema["topics"].dataType)
    return topics.join(additions, ["user_id", "week"], "full").select(
        "user_id",
        "week",
        F.coalesce("interest_article_count", F.lit(0)).alias("interest_article_count"),
        F.coalesce("topics", empty).alias("topics"),
    )


def page_counts(rows: DataFrame, by: list[str], page_size: int) -> DataFrame:
    """Row and page totals (zero pages for an empty group list)."""
    total = rows.groupBy(*by).agg(F.count("*").alias("total"))
    return total.withColumn("pages", F.ceil(F.col("total") / F.lit(page_size)).cast("long"))
