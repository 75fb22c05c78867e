"""Feed-shaped views over the shared test tables, defined twice: in Spark and in SQL.

The two definitions must stay equal line by line; every registered query builds on them.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.config import AUTHORITY_BY_TYPE, EngineConfig, SOURCE_TIERS
from millrace.operators.feedback import latest_feedback, merge_owned
from millrace.session import materialize

NOW = "2024-01-31 00:00:00"
EPOCH_2024 = 1704067200  # 2024-01-01 00:00:00 UTC

# The vectors of the test tables are near-orthogonal, so similarity thresholds are lowered here.
CATALOG_CONFIG = EngineConfig(
    max_age_days=60, bad_min_similarity=0.2, max_candidates=500, max_profile_articles=200, max_bad_articles=100
)

SOURCE_TYPES = tuple(SOURCE_TIERS)
SCORES = (1.0, 0.95, 0.9, 0.75, 0.6, 0.45, 0.35, 0.2)


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def pick(values: tuple, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def stamp(column: Column) -> Column:
    """Timestamps leave the catalog as text, so both engines print the same value."""
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")


class Views:
    """Lazy Spark views for one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self.config = CATALOG_CONFIG

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def n_docs(self) -> int:
        return self.table("documents").count()  # answered from the file footers

    @cached_property
    def n_pages(self) -> int:
        return self.table("pages").count()

    @cached_property
    def articles(self) -> DataFrame:
        d = F.col("doc_id")
        minutes = (d * 7919) % 43200
        pages = self.table("pages").select("page_id", "url")
        labels = self.table("labels").select("doc_id", "quality")
        vectors = self.table("embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
        authority = pick(SCORES, F.regexp_extract("source", r"(\d+)", 1).cast("int") % 8)
        return (
            self.table("documents")
            .join(labels, "doc_id", "left")
            .join(vectors, "doc_id", "left")
            .withColumn("page_id", d % self.n_pages)
            .join(pages, "page_id")
            .select(
                d.alias("article_id"),
                F.col("url").alias("canonical_url"),
                F.col("url").alias("original_url"),
                F.regexp_extract(F.lower("url"), r"^[a-z]+://([^/:?#]+)", 1).alias("source_domain"),
                F.substring_index("text", "\n", 1).alias("title"),
                F.lit(None).cast("string").alias("translated_title"),
                F.col("text").alias("summary"),
                F.col("text").alias("body"),
                F.sha2("text", 256).alias("body_hash"),
                F.col("lang").alias("language"),
                F.when(d % 23 != 0, F.timestamp_seconds(EPOCH_2024 + minutes * 60)).alias("published_at"),
                F.timestamp_seconds(EPOCH_2024 + minutes * 60 + 3600).alias("fetched_at"),
                F.array_distinct(
                    F.array(F.concat(F.lit("topic"), d % 7), F.concat(F.lit("topic"), d % 11))
                ).alias("topics"),
                F.when(d % 4 == 0, F.array().cast("array<string>"))
                .otherwise(F.array(F.concat(F.lit("tech"), d % 5)))
                .alias("technologies"),
                F.when(d % 13 != 0, F.concat(F.lit("dom"), d % 6)).alias("domain"),
                F.concat(F.lit("cat"), d % 9).alias("category"),
                F.when(d % 17 != 0, pick(("concept", "implementation", "research", "news"), d % 4)).alias(
                    "content_type"
                ),
                F.when(d % 19 != 0, pick(("beginner", "intermediate", "advanced"), d % 3)).alias("difficulty"),
                pick(SOURCE_TYPES, d % 15).alias("source_type"),
                authority.alias("source_authority"),
                (authority >= 0.9).alias("is_primary_source"),
                F.when(F.col("quality") == 1, 0.8).when(F.col("quality") == 0, 0.3).otherwise(0.5).alias(
                    "technical_quality"
                ),
                (d % 29 == 0).alias("is_dead"),
                F.when(d % 10 == 0, F.lit("pending")).otherwise(F.lit("completed")).alias("analysis_status"),
                F.when(d % 31 == 0, 0.6).otherwise(0.0).alias("duplicate_penalty"),
                "embedding",
            )
        )

    @cached_property
    def activity(self) -> DataFrame:
        """Events with the article they concern: every user circles around some forty articles."""
        e = F.col("event_id")
        article = (F.col("user_id") * 97 + ((e * 7919) % 37) * 13) % self.n_docs
        return self.table("events").select(
            "event_id",
            "user_id",
            article.alias("article_id"),
            "event_type",
            "value",
            F.col("ts").cast("timestamp").alias("ts"),
        )

    @cached_property
    def feedback_events(self) -> DataFrame:
        kind = F.col("event_type")
        action = F.when(kind == "purchase", "good").when(kind == "signup", "save").when(kind == "error", "bad")
        delete = F.col("event_id") % 50 == 0
        return self.activity.filter(kind.isin("purchase", "signup", "error")).select(
            F.col("event_id").alias("seq"),
            "user_id",
            "article_id",
            F.when(delete, "delete").otherwise("post").alias("op"),
            F.when(~delete, action).alias("action"),
            F.col("ts").alias("created_at"),
        )

    @cached_property
    def article_feedback(self) -> DataFrame:
        return materialize(latest_feedback(self.feedback_events))

    @cached_property
    def user_articles(self) -> DataFrame:
        act = self.activity
        seen = act.filter(F.col("event_type").isin("view", "click")).select(
            "user_id",
            "article_id",
            F.when(F.col("event_type") == "view", "read_full").otherwise("clicked").alias("origin"),
            F.when(F.col("event_type") == "view", 0.2).otherwise(0.1).alias("interest_weight"),
            F.col("ts").alias("created_at"),
        )
        manual = act.filter(F.col("event_id") % 40 == 1).select(
            "user_id",
            "article_id",
            F.lit("manual").alias("origin"),
            F.lit(1.0).alias("interest_weight"),
            F.col("ts").alias("created_at"),
        )
        opinion = self.article_feedback.filter(F.col("action").isin("good", "save")).select(
            "user_id",
            "article_id",
            F.when(F.col("action") == "good", "good").otherwise("saved").alias("origin"),
            F.when(F.col("action") == "good", 0.8).otherwise(0.5).alias("interest_weight"),
            "created_at",
        )
        return materialize(merge_owned(seen.unionByName(manual).unionByName(opinion)))

    @cached_property
    def source_registry(self) -> DataFrame:
        suffix = F.regexp_extract(F.lower("url"), r"^[a-z]+://(?:[^/:?#.]+\.)*([^/:?#.]+\.[^/:?#.]+\.[^/:?#.]+)", 1)
        size = F.length("domain")
        hosts = self.table("pages").select(suffix.alias("domain")).distinct().filter(size % 5 != 0)
        name = (
            F.when(size % 3 == 0, F.concat(F.lit("topic"), size % 7))
            .when(size % 3 == 1, F.lit("tech"))
            .otherwise(F.substring_index("domain", ".", 1))
        )
        score = pick(tuple(AUTHORITY_BY_TYPE[t] for t in SOURCE_TYPES), size % 15)
        none = F.lit(None).cast("string")
        base = hosts.select(
            name.alias("entity_name"),
            "domain",
            none.alias("path_pattern"),
            none.alias("github_org"),
            pick(SOURCE_TYPES, size % 15).alias("source_type"),
            score.alias("authority_score"),
            (size % 2 == 0).alias("verified"),
        )
        english = base.filter(size % 2 == 0).withColumns(
            {"path_pattern": F.lit("/EN"), "source_type": F.lit("official_blog"), "authority_score": F.lit(0.9)}
        )
        any_page = base.filter(size % 4 == 1).withColumns(
            {"path_pattern": F.lit("/*/*"), "source_type": F.lit("tech_media"), "authority_score": F.lit(0.45)}
        )
        french = base.filter(size % 3 != 2).withColumns(
            {
                "github_org": F.lit("fr"),
                "source_type": F.lit("official_github_release"),
                "authority_score": F.lit(0.9),
            }
        )
        return base.unionByName(english).unionByName(any_page).unionByName(french)

    @cached_property
    def feed_runs(self) -> DataFrame:
        whole = F.floor("value")
        return self.activity.select(
            F.concat(F.lit("https://feed"), "user_id", F.lit(".example/rss")).alias("feed_url"),
            F.col("event_id").alias("run_id"),
            F.col("ts").alias("run_at"),
            (F.col("value") >= 10).alias("succeeded"),
            (whole % 4).alias("entry_count"),
            (whole % 3).alias("new_entry_count"),
            (F.col("event_id") % 9 == 0).alias("scoped"),
        )

    @cached_property
    def operation_logs(self) -> DataFrame:
        e = F.col("event_id")
        failed = F.col("event_type") == "error"
        return self.activity.select(
            e.alias("log_id"),
            F.col("event_type").alias("operation"),
            ((e % 5 + 1) * 2000).alias("input_length"),
            (~failed).alias("ok"),
            F.col("value").alias("seconds"),
            F.when(failed, pick(("Timeout", "RateLimit", "BadJson"), e % 3)).alias("exception_type"),
            F.when(failed, F.concat(F.lit("call_"), e % 7, F.lit("% lost"))).alias("last_error"),
            F.col("ts").alias("created_at"),
        )


# ---------------------------------------------------------------------------------------------
# The same views in SQL
# ---------------------------------------------------------------------------------------------


def _case(values: tuple, index: str) -> str:
    branches = " ".join(
        f"WHEN {i} THEN {v!r}" if isinstance(v, str) else f"WHEN {i} THEN CAST({v} AS DOUBLE)"
        for i, v in enumerate(values)
    )
    return f"CASE {index} {branches} END"


_AUTHORITY = _case(SCORES, "CAST(regexp_extract(d.source, '(\\d+)', 1) AS INT) % 8")

SQL_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "articles": (
        (),
        f"""
        SELECT d.doc_id AS article_id, p.url AS canonical_url, p.url AS original_url,
          regexp_extract(lower(p.url), '^[a-z]+://([^/:?#]+)', 1) AS source_domain,
          split_part(d.text, chr(10), 1) AS title, CAST(NULL AS VARCHAR) AS translated_title,
          d.text AS summary, d.text AS body, sha256(d.text) AS body_hash, d.lang AS language,
          CASE WHEN d.doc_id % 23 <> 0 THEN TIMESTAMP '2024-01-01'
            + to_minutes((d.doc_id * 7919) % 43200) END AS published_at,
          TIMESTAMP '2024-01-01' + to_minutes((d.doc_id * 7919) % 43200 + 60) AS fetched_at,
          CASE WHEN d.doc_id % 7 = d.doc_id % 11 THEN ['topic' || (d.doc_id % 7)]
            ELSE ['topic' || (d.doc_id % 7), 'topic' || (d.doc_id % 11)] END AS topics,
          CASE WHEN d.doc_id % 4 = 0 THEN CAST([] AS VARCHAR[])
            ELSE ['tech' || (d.doc_id % 5)] END AS technologies,
          CASE WHEN d.doc_id % 13 <> 0 THEN 'dom' || (d.doc_id % 6) END AS domain,
          'cat' || (d.doc_id % 9) AS category,
          CASE WHEN d.doc_id % 17 <> 0 THEN
            {_case(("concept", "implementation", "research", "news"), "d.doc_id % 4")} END AS content_type,
          CASE WHEN d.doc_id % 19 <> 0 THEN
            {_case(("beginner", "intermediate", "advanced"), "d.doc_id % 3")} END AS difficulty,
          {_case(SOURCE_TYPES, "d.doc_id % 15")} AS source_type,
          {_AUTHORITY} AS source_authority,
          {_AUTHORITY} >= 0.9 AS is_primary_source,
          CAST(CASE l.quality WHEN 1 THEN 0.8 WHEN 0 THEN 0.3 ELSE 0.5 END AS DOUBLE) AS technical_quality,
          d.doc_id % 29 = 0 AS is_dead,
          CASE WHEN d.doc_id % 10 = 0 THEN 'pending' ELSE 'completed' END AS analysis_status,
          CAST(CASE WHEN d.doc_id % 31 = 0 THEN 0.6 ELSE 0.0 END AS DOUBLE) AS duplicate_penalty,
          e.embedding AS embedding
        FROM documents d
        LEFT JOIN labels l ON l.doc_id = d.doc_id
        LEFT JOIN embeddings e ON e.vec_id = d.doc_id
        JOIN pages p ON p.page_id = d.doc_id % (SELECT count(*) FROM pages)""",
    ),
    "activity": (
        (),
        """
        SELECT event_id, user_id,
          (user_id * 97 + ((event_id * 7919) % 37) * 13) % (SELECT count(*) FROM documents) AS article_id,
          event_type, value, ts
        FROM events""",
    ),
    "feedback_events": (
        ("activity",),
        """
        SELECT event_id AS seq, user_id, article_id,
          CASE WHEN event_id % 50 = 0 THEN 'delete' ELSE 'post' END AS op,
          CASE WHEN event_id % 50 <> 0 THEN CASE event_type WHEN 'purchase' THEN 'good'
            WHEN 'signup' THEN 'save' ELSE 'bad' END END AS action,
          ts AS created_at
        FROM activity WHERE event_type IN ('purchase', 'signup', 'error')""",
    ),
    "article_feedback": (
        ("feedback_events",),
        """
        SELECT f.user_id, f.article_id, arg_max(f.action, f.seq) AS action, min(f.created_at) AS created_at
        FROM feedback_events f
        LEFT JOIN (SELECT user_id, article_id, max(seq) AS cut FROM feedback_events
                   WHERE op = 'delete' GROUP BY 1, 2) x
          ON x.user_id = f.user_id AND x.article_id = f.article_id
        WHERE f.op = 'post' AND f.seq > coalesce(x.cut, -1)
        GROUP BY f.user_id, f.article_id""",
    ),
    "user_articles": (
        ("activity", "article_feedback"),
        """
        SELECT user_id, article_id, arg_max(origin, w) AS origin, max(w) AS interest_weight,
          min(created_at) AS created_at
        FROM (
          SELECT user_id, article_id, CASE event_type WHEN 'view' THEN 'read_full' ELSE 'clicked' END AS origin,
            CAST(CASE event_type WHEN 'view' THEN 0.2 ELSE 0.1 END AS DOUBLE) AS w, ts AS created_at
          FROM activity WHERE event_type IN ('view', 'click')
          UNION ALL
          SELECT user_id, article_id, 'manual', CAST(1.0 AS DOUBLE), ts FROM activity WHERE event_id % 40 = 1
          UNION ALL
          SELECT user_id, article_id, CASE action WHEN 'good' THEN 'good' ELSE 'saved' END,
            CAST(CASE action WHEN 'good' THEN 0.8 ELSE 0.5 END AS DOUBLE), created_at
          FROM article_feedback WHERE action IN ('good', 'save'))
        GROUP BY user_id, article_id""",
    ),
    "registry_base": (
        (),
        f"""
        SELECT CASE length(domain) % 3 WHEN 0 THEN 'topic' || (length(domain) % 7) WHEN 1 THEN 'tech'
            ELSE split_part(domain, '.', 1) END AS entity_name, domain,
          CAST(NULL AS VARCHAR) AS path_pattern, CAST(NULL AS VARCHAR) AS github_org,
          {_case(SOURCE_TYPES, "length(domain) % 15")} AS source_type,
          {_case(tuple(AUTHORITY_BY_TYPE[t] for t in SOURCE_TYPES), "length(domain) % 15")} AS authority_score,
          length(domain) % 2 = 0 AS verified
        FROM (SELECT DISTINCT regexp_extract(lower(url),
                '^[a-z]+://(?:[^/:?#.]+[.])*([^/:?#.]+[.][^/:?#.]+[.][^/:?#.]+)', 1) AS domain FROM pages)
        WHERE length(domain) % 5 <> 0""",
    ),
    "source_registry": (
        ("registry_base",),
        """
        SELECT * FROM registry_base
        UNION ALL SELECT entity_name, domain, '/EN', github_org, 'official_blog', CAST(0.9 AS DOUBLE), verified
          FROM registry_base WHERE length(domain) % 2 = 0
        UNION ALL SELECT entity_name, domain, '/*/*', github_org, 'tech_media', CAST(0.45 AS DOUBLE), verified
          FROM registry_base WHERE length(domain) % 4 = 1
        UNION ALL SELECT entity_name, domain, path_pattern, 'fr', 'official_github_release',
            CAST(0.9 AS DOUBLE), verified
          FROM registry_base WHERE length(domain) % 3 <> 2""",
    ),
    "feed_runs": (
        ("activity",),
        """
        SELECT 'https://feed' || user_id || '.example/rss' AS feed_url, event_id AS run_id, ts AS run_at,
          value >= 10 AS succeeded, CAST(floor(value) AS BIGINT) % 4 AS entry_count,
          CAST(floor(value) AS BIGINT) % 3 AS new_entry_count, event_id % 9 = 0 AS scoped
        FROM activity""",
    ),
    "operation_logs": (
        ("activity",),
        f"""
        SELECT event_id AS log_id, event_type AS operation, (event_id % 5 + 1) * 2000 AS input_length,
          event_type <> 'error' AS ok, value AS seconds,
          CASE WHEN event_type = 'error' THEN
            {_case(("Timeout", "RateLimit", "BadJson"), "event_id % 3")} END AS exception_type,
          CASE WHEN event_type = 'error' THEN 'call_' || (event_id % 7) || '% lost' END AS last_error,
          ts AS created_at
        FROM activity""",
    ),
}


def add_sql_view(name: str, needs: tuple[str, ...], sql: str) -> None:
    SQL_VIEWS[name] = (needs, sql)


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the views it uses, dependencies first."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        needs, _ = SQL_VIEWS[name]
        for need in needs:
            visit(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    if not ordered:
        return sql
    views = ",\n".join(f"{n} AS MATERIALIZED ({SQL_VIEWS[n][1]})" for n in ordered)
    body = sql.lstrip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {views},\n{body[len('WITH RECURSIVE '):]}"
    if body.upper().startswith("WITH "):
        return f"WITH {views},\n{body[len('WITH '):]}"
    return f"WITH {views}\n{body}"
