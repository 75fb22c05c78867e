"""Crawl, page and source-discovery jobs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.config import DEFAULT, EngineConfig
from millrace.functions.urls import normalize_url
from millrace.operators import feeds as FE
from millrace.operators import ingest as I
from millrace.operators.classify import classify_sources
from millrace.operators.dashboards import domain_counts
from millrace.operators.filters import filter_recent
from millrace.session import materialize
from millrace.sources.documents import union_candidates
from millrace.sources.pages import extract_articles, feed_links


@dataclass(frozen=True)
class CrawlRun:
    """URLs to fetch, new entries per feed, and the counters of the crawl."""

    enqueued: DataFrame
    new_entries: DataFrame
    counters: DataFrame


def ingest_candidates(
    sources: list[DataFrame],
    articles: DataFrame,
    jobs: DataFrame,
    feed_status: DataFrame,
    now: Column,
    cfg: EngineConfig = DEFAULT,
    source_domain: str | None = None,
) -> CrawlRun:
    """Union, recent, scope, first URL, not stored, not in flight, count news, cap."""
    collected = materialize(union_candidates(sources))
    fresh = I.scope_to_domain(filter_recent(collected, now, cfg.freshness_days), source_domain)
    unseen = materialize(I.not_in_flight(I.not_stored(I.first_by_url(fresh), articles), jobs))
    enqueued = materialize(I.newest(unseen, cfg.max_crawl_candidates))
    totals = collected.agg(F.count("*").alias("collected")).withColumn("_one", F.lit(1))
    kept = enqueued.agg(F.count("*").alias("enqueued")).withColumn("_one", F.lit(1))
    counters = totals.join(kept, "_one").select("collected", (F.col("collected") - F.col("enqueued")).alias("excluded"), "enqueued")
    return CrawlRun(enqueued, I.new_entries_per_feed(feed_status, unseen), counters)


def ingest_pages(pages: DataFrame, articles: DataFrame, registry: DataFrame, fetched_at: Column) -> tuple[DataFrame, DataFrame]:
    """New articles from landed pages (page_id, url, html), and the pages that gave none.

    Known URLs are skipped before parsing; among new pages the first of a canonical URL wins.
    """
    # Which pages are read and which articles win is settled on ids and URLs; html and body move once each.
    stored = materialize(articles.select("canonical_url").distinct())
    named = pages.select("page_id", normalize_url("url").alias("canonical_url"))
    firsts = named.join(stored, "canonical_url", "left_anti").groupBy("canonical_url").agg(F.min("page_id").alias("page_id"))
    extracted = materialize(extract_articles(pages.join(firsts.select("page_id"), "page_id", "left_semi")))
    good = extracted.filter(F.col("error_reason").isNull()).select("page_id", "canonical_url").join(stored, "canonical_url", "left_anti")
    winners = good.groupBy("canonical_url").agg(F.min("page_id").alias("page_id")).select("page_id")
    best = extracted.join(winners, "page_id", "left_semi")
    kinds = classify_sources(best.select(F.col("canonical_url").alias("url")), registry)
    joined = best.withColumnRenamed("url", "original_url").join(
        kinds.select(F.col("url").alias("canonical_url"), "host", "entity_name", "source_type", "source_authority", "is_primary_source"),
        "canonical_url",
    )
    result = joined.withColumnRenamed("host", "source_domain").withColumns(
        {"fetched_at": fetched_at, "analysis_status": F.lit("pending")}
    )
    return result.drop("error_reason"), extracted.filter(F.col("error_reason").isNotNull()).select("page_id", "url", "error_reason")


def discover_sources(
    user_articles: DataFrame,
    articles: DataFrame,
    feeds: DataFrame,
    home_pages: DataFrame,
    feed_status: DataFrame,
    now: Column,
    cfg: EngineConfig = DEFAULT,
) -> DataFrame:
    """Feed table after one discovery round over the best registered domains.

    ``home_pages``: (domain, url, html) landed by the fetcher; ``feed_status``: (feed_url, succeeded).
    A domain without page is fetch_failed, without a working feed link not_found.
    """
    ranked = domain_counts(user_articles, articles).groupBy("source_domain").agg(F.sum("article_count").alias("article_count"))
    targets = materialize(FE.discovery_targets(ranked, feeds, now, cfg.feeds)).withColumnRenamed("source_domain", "domain")
    pages = home_pages.join(targets, "domain", "left_semi")
    links = feed_links(pages, cfg.feeds.links_per_domain).join(feed_status.filter("succeeded").select("feed_url"), "feed_url", "left_semi")
    first = links.groupBy("domain").agg(F.min_by("feed_url", "position").alias("feed_url"))
    landed = pages.select("domain").distinct().withColumn("landed", F.lit(True))
    status = F.when(F.col("feed_url").isNotNull(), "found").when(F.col("landed"), "not_found").otherwise("fetch_failed")
    results = targets.join(first, "domain", "left").join(landed, "domain", "left").withColumn("status", status)
    return FE.record_discovery(feeds, results, now)

