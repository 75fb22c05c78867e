"""Explicit schemas of the working sets (never inferred)."""

from __future__ import annotations

from pyspark.sql import types as T

VECTOR = T.ArrayType(T.FloatType())
TAGS = T.ArrayType(T.StringType())


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


CANDIDATE_ARTICLE = _schema(
    url=T.StringType(),
    title=T.StringType(),
    published_at=T.TimestampType(),
    collector_name=T.StringType(),
    source_hint=T.StringType(),
    feed_url=T.StringType(),
)

ARTICLE = _schema(
    article_id=T.LongType(),
    canonical_url=T.StringType(),
    original_url=T.StringType(),
    source_domain=T.StringType(),
    title=T.StringType(),
    translated_title=T.StringType(),
    summary=T.StringType(),
    body=T.StringType(),
    body_hash=T.StringType(),
    language=T.StringType(),
    published_at=T.TimestampType(),
    fetched_at=T.TimestampType(),
    topics=TAGS,
    technologies=TAGS,
    domain=T.StringType(),
    category=T.StringType(),
    content_type=T.StringType(),
    difficulty=T.StringType(),
    source_type=T.StringType(),
    source_authority=T.DoubleType(),
    is_primary_source=T.BooleanType(),
    technical_quality=T.DoubleType(),
    is_dead=T.BooleanType(),
    analysis_status=T.StringType(),
    duplicate_penalty=T.DoubleType(),
    embedding=VECTOR,
)

USER_ARTICLE = _schema(
    user_id=T.LongType(),
    article_id=T.LongType(),
    origin=T.StringType(),
    interest_weight=T.DoubleType(),
    created_at=T.TimestampType(),
)

FEEDBACK_EVENT = _schema(
    seq=T.LongType(),
    user_id=T.LongType(),
    article_id=T.LongType(),
    op=T.StringType(),
    action=T.StringType(),
    created_at=T.TimestampType(),
)

ARTICLE_FEEDBACK = _schema(
    user_id=T.LongType(),
    article_id=T.LongType(),
    action=T.StringType(),
    created_at=T.TimestampType(),
)

SOURCE_RULE = _schema(
    entity_name=T.StringType(),
    domain=T.StringType(),
    path_pattern=T.StringType(),
    github_org=T.StringType(),
    source_type=T.StringType(),
    authority_score=T.DoubleType(),
    verified=T.BooleanType(),
)

DISCOVERED_FEED = _schema(
    domain=T.StringType(),
    feed_url=T.StringType(),
    status=T.StringType(),
    article_count=T.LongType(),
    last_attempted_at=T.TimestampType(),
    enabled=T.BooleanType(),
    consecutive_failures=T.IntegerType(),
    consecutive_empty_fetches=T.IntegerType(),
    consecutive_no_new_entries=T.IntegerType(),
)

FEED_RUN = _schema(
    feed_url=T.StringType(),
    run_id=T.LongType(),
    run_at=T.TimestampType(),
    succeeded=T.BooleanType(),
    entry_count=T.LongType(),
    new_entry_count=T.LongType(),
    scoped=T.BooleanType(),
)
