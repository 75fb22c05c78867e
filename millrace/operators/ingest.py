"""Crawl steps on candidate articles: scope, first occurrence, anti joins, novelty, cap, queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.config import DEFAULT, QUERY_SUFFIXES
from millrace.functions.urls import normalize_url, url_host
from millrace.operators.distributed import first_per_key
from millrace.operators.filters import host_in_domain

ACTIVE_STATUSES = ("pending", "fetching")


def scope_to_domain(candidates: DataFrame, domain: str | None) -> DataFrame:
    """Keep one site and its sub-domains; no domain keeps everything."""
    if domain is None:
        return candidates
    return candidates.filter(host_in_domain(url_host("url"), domain))


def first_by_url(candidates: DataFrame) -> DataFrame:
    """First arrival per normalised URL: collector order, then feed or query, then position."""
    keyed = candidates.withColumn("normalized_url", normalize_url("url"))
    return first_per_key(keyed, ["normalized_url"], F.struct(*arrival()))


def arrival() -> list[Column]:
    document = F.coalesce("feed_url", "source_hint", F.lit("")).alias("document")
    return [F.col("source_order"), document, F.col("position"), F.col("url")]


def not_stored(candidates: DataFrame, articles: DataFrame) -> DataFrame:
    stored = articles.select(F.col("canonical_url").alias("normalized_url"))
    return candidates.join(stored, "normalized_url", "left_anti")


def not_in_flight(candidates: DataFrame, jobs: DataFrame) -> DataFrame:
    """Drop URLs a pending or running fetch already covers; ``jobs``: (url, status)."""
    active = jobs.filter(F.col("status").isin(*ACTIVE_STATUSES)).select(normalize_url("url").alias("normalized_url"))
    return candidates.join(active, "normalized_url", "left_anti")


def new_entries_per_feed(feed_status: DataFrame, candidates: DataFrame) -> DataFrame:
    """Surviving candidates per successfully read feed, zeros kept (before the cap)."""
    counts = candidates.filter(F.col("feed_url").isNotNull()).groupBy("feed_url").agg(F.count("*").alias("new_entry_count"))
    good = feed_status.filter("succeeded").select("feed_url")
    return good.join(counts, "feed_url", "left").select("feed_url", F.coalesce("new_entry_count", F.lit(0)).alias("new_entry_count"))


def newest(candidates: DataFrame, limit: int | None) -> DataFrame:
    """Newest candidates first, unknown dates last; arrival order decides ties.  No ``limit``: all, in any order."""
    if limit is None:
        return candidates
    if limit <= 0:
        return candidates.limit(0)
    return candidates.orderBy(F.desc_nulls_last("published_at"), *arrival()).limit(limit)


def interest_terms(articles: DataFrame, limit: int = DEFAULT.interest_source_articles) -> DataFrame:
    """One row: distinct topics and technologies of the newest analysed articles in first-seen order."""
    latest = (
        articles.filter(F.col("analysis_status") == "completed")
        .select("article_id", "fetched_at", "topics", "technologies")
        .orderBy(F.desc("fetched_at"), "article_id")
        .limit(limit)
    )
    # At most `limit` articles: ordering them inside one array is bounded.
    packed = latest.agg(
        F.sort_array(
            F.collect_list(
                F.struct(F.negate(F.unix_micros("fetched_at")).alias("age"), "article_id", "topics", "technologies")
            )
        ).alias("a")
    )
    return packed.select(
        F.array_distinct(F.flatten("a.topics")).alias("topics"),
        F.array_distinct(F.flatten("a.technologies")).alias("technologies"),
    )


def search_queries(terms: DataFrame, language: Column | None = None, limit: int = DEFAULT.max_queries) -> DataFrame:
    """Search queries per row of (topics, technologies): Japanese, English, then the source language."""

    def clean(tags: Column) -> Column:
        return F.filter(F.transform(tags, lambda t: F.trim(t)), lambda t: F.length(t) > 0)

    topics, technologies = clean(F.col("topics")), clean(F.col("technologies"))
    by_technology = F.size(technologies) > 0
    subjects = F.when(by_technology, technologies).otherwise(topics)
    helper = F.when(by_technology, F.coalesce(F.get(topics, F.lit(0)), F.lit(""))).otherwise("")

    def phrases(suffixes: Column) -> Column:
        def phrase(subject: Column, suffix: Column) -> Column:
            return F.array_join(F.filter(F.array(subject, helper, suffix), lambda w: F.length(w) > 0), " ")

        return F.flatten(F.transform(subjects, lambda s: F.transform(suffixes, lambda x: phrase(s, x))))

    parts = [phrases(F.array(*[F.lit(x) for x in words])) for words in QUERY_SUFFIXES.values()]
    if language is not None:
        primary = F.lower(F.split_part(F.trim(language), F.lit("-"), F.lit(1)))
        extra = F.coalesce(F.length(primary) > 0, F.lit(False)) & ~primary.isin(*QUERY_SUFFIXES)
        parts.append(F.when(extra, phrases(F.array(F.lit("")))).otherwise(F.array().cast("array<string>")))
    queries = F.slice(F.array_distinct(F.concat(*parts)), 1, limit)
    return terms.withColumn("queries", queries)
