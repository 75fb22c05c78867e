"""The same results from stored layouts and table functions."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

from pyspark.sql import functions as F

import catalog.crawl  # noqa: F401  (its SQL views are used below)
import catalog.interest  # noqa: F401
from catalog.crawl import home_pages, known_urls, url_lists
from catalog.registry import register
from catalog.views import NOW, Views, now
from millrace.operators.filters import alive, days_before
from millrace.operators.vector_index import build_index, search_index
from millrace.session import ensure_checkpoint_dir
from millrace.sources.layout import articles_with_tags, purge_days, read_since, write_by_day, write_tag_index
from millrace.sources.table_functions import register_table_functions
from millrace.sources.url_list import screen_registrations


def _folder(v: Views, name: str) -> str:
    """A new folder beside the checkpoints."""
    ensure_checkpoint_dir(v.spark)
    return f"{v.spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


@register(
    "age_window_by_day",
    f"""SELECT article_id FROM articles
    WHERE NOT is_dead AND coalesce(published_at, fetched_at) >= TIMESTAMP '{NOW}' - INTERVAL 7 DAYS""",
    ("articles",),
)
def _(v: Views):
    path = _folder(v, "by-day")
    write_by_day(v.articles.select("article_id", "is_dead", "published_at", "fetched_at"), path)
    return read_since(v.spark, path, days_before(now(), 7)).filter(alive()).select("article_id")


@register(
    "log_retention_by_day",
    f"""SELECT log_id FROM operation_logs WHERE created_at >= TIMESTAMP '{NOW}' - INTERVAL 14 DAYS - INTERVAL 7 HOURS""",
    ("operation_logs",),
)
def _(v: Views):
    """The cutoff lies inside a day: older days are dropped, that day is written again."""
    path = _folder(v, "logs")
    write_by_day(v.operation_logs.select("log_id", "created_at"), path, F.col("created_at"))
    purge_days(v.spark, path, datetime.fromisoformat(NOW) - timedelta(days=14, hours=7), F.col("created_at"))
    return v.spark.read.schema("log_id long, created_at timestamp, day date").parquet(path).select("log_id")


@register(
    "tag_index_match",
    """SELECT article_id FROM articles WHERE list_has_all(topics, ['topic3', 'topic5'])
    UNION ALL SELECT article_id FROM articles WHERE list_has_all(technologies, ['tech2'])""",
    ("articles",),
)
def _(v: Views):
    name = f"tag_index_{uuid.uuid4().hex}"
    write_tag_index(v.articles, name, _folder(v, "tags"))
    both = articles_with_tags(v.spark, name, "topics", ["topic3", "topic5"])
    return both.unionAll(articles_with_tags(v.spark, name, "technologies", ["tech2"]))


@register(
    "url_lines_lateral",
    """SELECT page_id AS list_id, unnest([2, 3, 4]) AS line_number,
      unnest([url, url, 'ftp://x.example/' || page_id]) AS url,
      unnest([CASE WHEN normal_url IN (SELECT normal_url FROM normal_urls WHERE page_id % 3 = 0) THEN 'duplicate' ELSE 'created' END,
        'duplicate', 'bad_scheme']) AS status
    FROM normal_urls""",
    ("normal_urls",),
)
def _(v: Views):
    register_table_functions(v.spark)
    lines = v.spark.sql("SELECT l.list_id, t.* FROM {lists} l, LATERAL url_lines(l.content) t", lists=url_lists(v))
    return screen_registrations(lines, known_urls(v)).select("list_id", "line_number", "url", "status")


@register(
    "home_feed_links_lateral",
    """SELECT page_id AS domain, CAST(1 AS INT) AS position,
      regexp_extract(url, '^([A-Za-z]+://[^/?#]+)', 1) || '/feed/' || page_id || '.xml' AS feed_url
    FROM pages WHERE url LIKE 'https://%'""",
)
def _(v: Views):
    register_table_functions(v.spark)
    return v.spark.sql("SELECT CAST(p.domain AS BIGINT) AS domain, t.* FROM {pages} p, LATERAL feed_links(p.url, p.html) t", pages=home_pages(v))


@register(
    "vector_index_topk",
    """WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings ORDER BY vec_id LIMIT 1)
    SELECT a.article_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), q.v), 6) AS similarity
    FROM articles a CROSS JOIN q WHERE a.embedding IS NOT NULL AND NOT a.is_dead
    ORDER BY list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), q.v) DESC, a.article_id LIMIT 10""",
    ("articles",),
)
def _(v: Views):
    index = build_index(v.articles.filter(alive()).select("article_id", "embedding"), _folder(v, "vectors"))
    query = v.table("embeddings").orderBy("vec_id").select("embedding").first()["embedding"]
    return search_index(v.spark, index, query, 10)[0].withColumn("similarity", F.round("similarity", 6))
