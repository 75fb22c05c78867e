"""Predicates and filters.  All are plain columns, so Catalyst can push them to the scan."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.config import OWNED_ORIGINS

SEARCH_COLUMNS = ("title", "translated_title", "summary")


def days_before(now: Column, days: int) -> Column:
    return now - F.expr(f"INTERVAL {int(days)} DAYS")


def filter_recent(rows: DataFrame, now: Column, days: int) -> DataFrame:
    """Published within ``days`` (inclusive); unknown dates drop out, the future stays."""
    return rows.filter(F.col("published_at") >= days_before(now, days))


def effective_date() -> Column:
    return F.coalesce("published_at", "fetched_at")


def within_age(now: Column, days: int) -> Column:
    return effective_date() >= days_before(now, days)


def published_between(start: Column, end: Column) -> Column:
    return effective_date().between(start, end)


def alive() -> Column:
    return ~F.col("is_dead")


def text_search(query: Column, columns: Sequence[str] = SEARCH_COLUMNS) -> Column:
    """Case-insensitive substring of any column; pattern characters are plain text."""
    needle = F.lower(query)
    hit = F.lit(False)
    for name in columns:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(name)), needle), F.lit(False))
    return hit


def has_all_tags(column: str, tags: Sequence[str]) -> Column:
    """The array holds every given tag."""
    wanted = F.array(*[F.lit(t) for t in tags])
    return F.size(F.array_except(wanted, F.col(column))) == 0


def host_in_domain(host: Column, domain: str) -> Column:
    """Host equals the domain or lies below it, never a mere text suffix."""
    return (F.lower(host) == domain.lower()) | F.lower(host).endswith("." + domain.lower())


def has_embedding(column: str = "embedding") -> Column:
    return F.col(column).isNotNull()


def needs_analysis(summary: str, analyzed_hash: str, body_hash: str = "body_hash") -> Column:
    return F.col(summary).isNull() | ~F.col(analyzed_hash).eqNullSafe(F.col(body_hash))


def needs_embedding(embedding: str, embedded_hash: str, body_hash: str = "body_hash") -> Column:
    return F.col(embedding).isNull() | ~F.col(embedded_hash).eqNullSafe(F.col(body_hash))


def needs_judgement(judged_hash: str, body_hash: str = "body_hash") -> Column:
    """Rows without a hash are always judged again."""
    return F.col(body_hash).isNull() | ~F.col(judged_hash).eqNullSafe(F.col(body_hash))


@dataclass(frozen=True)
class ArticleFilter:
    """Optional conditions on articles, all combined with AND."""

    query: str | None = None
    topics: tuple[str, ...] = ()
    technologies: tuple[str, ...] = ()
    published_from: Column | None = None
    published_to: Column | None = None
    source_domain: str | None = None
    max_age_days: int | None = None

    def fingerprint(self) -> str:
        """Hash of the conditions: runs with the same one answer the same question."""
        stated = {f.name: str(getattr(self, f.name)) for f in fields(self) if getattr(self, f.name) not in (None, ())}
        return hashlib.sha256(json.dumps(stated, sort_keys=True).encode()).hexdigest()

    def condition(self) -> Column:
        test = F.lit(True)
        if self.query:
            test = test & text_search(F.lit(self.query))
        if self.topics:
            test = test & has_all_tags("topics", self.topics)
        if self.technologies:
            test = test & has_all_tags("technologies", self.technologies)
        if self.published_from is not None:
            test = test & (effective_date() >= self.published_from)
        if self.published_to is not None:
            test = test & (effective_date() <= self.published_to)
        if self.source_domain:
            test = test & (F.col("source_domain") == self.source_domain)
        return test


@dataclass(frozen=True)
class InterestFilter:
    """Conditions of the owned-article list."""

    origins: tuple[str, ...] | None = None
    query: str | None = None
    topics: tuple[str, ...] = ()
    technologies: tuple[str, ...] = ()
    domain: str | None = None
    category: str | None = None
    source_domain: str | None = None
    language: str | None = None
    registered_from: Column | None = None
    registered_to: Column | None = None
    is_primary_source: bool | None = None


def interest_list(user_articles: DataFrame, articles: DataFrame, spec: InterestFilter) -> DataFrame:
    """Owned articles under ``spec``; asking only for origins that are never listed gives no rows."""
    allowed = [o for o in OWNED_ORIGINS if spec.origins is None or o in spec.origins]
    test = ArticleFilter(
        query=spec.query, topics=spec.topics, technologies=spec.technologies, source_domain=spec.source_domain
    ).condition()
    for name in ("domain", "category", "language", "is_primary_source"):
        wanted = getattr(spec, name)
        if wanted is not None:
            test = test & (F.col(name) == wanted)
    owned = user_articles.filter(F.col("origin").isin(allowed) if allowed else F.lit(False))
    if spec.registered_from is not None:
        owned = owned.filter(F.col("created_at") >= spec.registered_from)
    if spec.registered_to is not None:
        owned = owned.filter(F.col("created_at") <= spec.registered_to)
    return owned.join(articles.filter(test), "article_id")


def failed_jobs(jobs: DataFrame, job_type: str, error_contains: str | None = None) -> DataFrame:
    """Failed jobs of a type, oldest first; the error text is matched literally, case-sensitive."""
    rows = jobs.filter((F.col("status") == "failed") & (F.col("type") == job_type))
    if error_contains:
        rows = rows.filter(F.contains("last_error", F.lit(error_contains)))
    return rows.orderBy("created_at", "job_id")


def failed_job_breaker(failed: DataFrame, limit: int = 50) -> DataFrame:
    """One row: number of failed jobs and whether it trips the circuit breaker."""
    total = failed.agg(F.count("*").alias("failed_count"))
    return total.withColumn("over_limit", F.lit(limit > 0) & (F.col("failed_count") > limit))


def drop_expired(rows: DataFrame, moment: str, now: Column, days: int) -> DataFrame:
    """Retention: rows strictly older than ``days`` go."""
    return rows.filter(F.col(moment) >= days_before(now, days))


def drop_expired_runs(
    runs: DataFrame, recommendations: DataFrame, now: Column, days: int
) -> tuple[DataFrame, DataFrame]:
    """Runs inside the retention period and, cascading, their rows."""
    kept = drop_expired(runs, "generated_at", now, days)
    return kept, recommendations.join(kept.select("run_id"), "run_id", "left_semi")


def bodies_for_measurement(articles: DataFrame, least: int, count: int, longer: bool = False) -> DataFrame:
    """The ``count`` shortest bodies of at least ``least`` characters (``longer``: of more), with their length.

    Lengths are compared first; only the chosen bodies are read.
    """
    sizes = articles.filter(F.col("body").isNotNull()).select("article_id", F.length("body").cast("long").alias("body_length"))
    enough = F.col("body_length") > least if longer else F.col("body_length") >= least
    chosen = sizes.filter(enough).orderBy("body_length", "article_id").limit(count)
    return articles.select("article_id", "canonical_url", "body").join(F.broadcast(chosen), "article_id")  # ``count`` rows
