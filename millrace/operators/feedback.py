"""Feedback log to current opinions and owned articles, by combinable aggregates only.

The log is append-only: ``(seq, user_id, article_id, op, action, created_at)`` with op post/delete.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.config import DEFAULT, EngineConfig, ORIGINS, POSITIVE_ACTIONS, READ_ORIGINS
from millrace.functions.weights import lookup
from millrace.operators.distributed import rank_per_key, top_per_key

PAIR = ["user_id", "article_id"]


def latest_feedback(events: DataFrame, extra_keys: tuple[str, ...] = ()) -> DataFrame:
    """Current opinion per pair: latest action, and the time of the first post after the last delete.

    Changing the action keeps the first time.
    """
    keys = [*extra_keys, *PAIR]
    cuts = events.filter(F.col("op") == "delete").groupBy(*keys).agg(F.max("seq").alias("cut"))
    alive = (
        events.filter(F.col("op") == "post")
        .join(cuts, keys, "left")
        .filter(F.col("cut").isNull() | (F.col("seq") > F.col("cut")))
    )
    return alive.groupBy(*keys).agg(
        F.max_by("action", "seq").alias("action"),
        F.min_by("created_at", "seq").alias("created_at"),
    )


def merge_owned(rows: DataFrame) -> DataFrame:
    """One owned row per pair: the strongest origin wins, the earliest time stays."""
    strength = F.struct("interest_weight", F.negate(origin_position("origin")))
    return rows.groupBy(*PAIR).agg(
        F.max_by("origin", strength).alias("origin"),
        F.max("interest_weight").alias("interest_weight"),
        F.min("created_at").alias("created_at"),
    )


def origin_position(column: str) -> Column:
    return lookup(F.col(column), {name: i for i, name in enumerate(ORIGINS)}, len(ORIGINS))


def apply_feedback_to_owned(events: DataFrame, owned: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Owned articles after a feedback log, starting from ``owned``.

    Good and Save insert or strengthen a row (time kept); Bad and delete remove rows whose origin
    is good or saved.  The sequential rule has a closed form: only what happened before and after
    the last removal matters, so no group is replayed row by row.
    """
    weight = F.when(F.col("action") == "good", cfg.feedback.good).when(F.col("action") == "save", cfg.feedback.save)
    log = events.select(*PAIR, "seq", "op", "action", "created_at", weight.alias("gain"))
    removal = (F.col("op") == "delete") | (F.col("action") == "bad")
    cuts = log.groupBy(*PAIR).agg(F.max(F.when(removal, F.col("seq"))).alias("cut"))
    after_cut = F.col("cut").isNull() | (F.col("seq") > F.col("cut"))
    effect = (
        log.join(cuts, PAIR)
        .groupBy(*PAIR)
        .agg(
            F.max("cut").alias("cut"),
            F.max(F.when(~after_cut, F.col("gain"))).alias("gain_before"),
            F.max(F.when(after_cut, F.col("gain"))).alias("gain_after"),
            F.min_by("created_at", F.when(after_cut & F.col("gain").isNotNull(), F.col("seq"))).alias("first_after"),
        )
    )
    from_feedback = F.col("origin").isin("good", "saved")
    overwritten = F.coalesce(F.col("gain_before") > F.col("interest_weight"), F.lit(False))
    removed = F.col("cut").isNotNull() & (from_feedback | overwritten)
    kept = F.col("origin").isNotNull() & ~F.coalesce(removed, F.lit(False))
    stronger = F.col("gain_after").isNotNull() & (~kept | (F.col("gain_after") > F.col("interest_weight")))
    gained_origin = F.when(F.col("gain_after") == cfg.feedback.good, "good").otherwise("saved")
    return (
        owned.join(effect, PAIR, "full")
        .filter(kept | F.col("gain_after").isNotNull())
        .select(
            *PAIR,
            F.when(stronger, gained_origin).otherwise(F.col("origin")).alias("origin"),
            F.when(stronger, F.col("gain_after")).otherwise(F.col("interest_weight")).alias("interest_weight"),
            F.when(kept, F.col("created_at")).otherwise(F.col("first_after")).alias("created_at"),
        )
    )


def interest_population(user_articles: DataFrame, feedback: DataFrame) -> DataFrame:
    """Articles that shape a profile: owned or read rows, filled up with Good opinions.

    The owned row wins for origin and time.
    """
    owned = user_articles.filter(F.col("origin").isin(*ORIGINS)).select(*PAIR, "origin", "created_at")
    good = feedback.filter(F.col("action") == "good").select(*PAIR, F.col("created_at").alias("good_at"))
    return owned.join(good, PAIR, "full").select(
        *PAIR,
        F.coalesce("origin", F.lit("good")).alias("origin"),
        F.coalesce("created_at", "good_at").alias("created_at"),
    )


def recency_cut(population: DataFrame, limit: int | None) -> DataFrame:
    """Newest ``limit`` articles per user (None: all, with their position); equal times keep the smaller id."""
    order = [F.col("created_at").desc(), F.col("article_id").asc()]
    if limit is None:
        return rank_per_key(population, ["user_id"], order).withColumn("position", F.col("position").cast("int"))
    return top_per_key(population, ["user_id"], order, limit)


def origin_counts(population: DataFrame, limit: int | None) -> DataFrame:
    """Articles per origin after the recency cut, zero for absent origins."""
    cut = recency_cut(population, limit)
    return cut.groupBy("user_id").agg(
        *[F.count_if(F.col("origin") == name).alias(f"{name}_count") for name in ORIGINS]
    )


def read_flags(user_articles: DataFrame) -> DataFrame:
    """Pairs the user has opened."""
    return user_articles.filter(F.col("origin").isin(*READ_ORIGINS)).select(*PAIR).distinct()


def is_positive(column: str = "action") -> Column:
    return F.col(column).isin(*POSITIVE_ACTIONS)
