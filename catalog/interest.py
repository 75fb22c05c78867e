"""Dashboards, opinions, owned articles and preferences."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import register
from catalog.views import CATALOG_CONFIG, NOW, Views, add_sql_view, now, stamp
from millrace.config import DEFAULT
from millrace.operators import dashboards as D
from millrace.operators import feedback as FB
from millrace.operators import filters as FL
from millrace.operators import preferences as P
from millrace.operators.distributed import ordered_index

WEEKS = 12
TS = "'%Y-%m-%d %H:%M:%S.%f'"
AF = ("article_feedback", "articles")


@register(
    "domain_counts",
    """SELECT u.user_id, a.source_domain, count(*) AS article_count
    FROM user_articles u JOIN articles a USING (article_id)
    WHERE u.origin IN ('manual', 'good', 'saved') AND a.source_domain <> '' GROUP BY 1, 2""",
    ("user_articles", "articles"),
)
def _(v: Views):
    return D.domain_counts(v.user_articles, v.articles)


@register(
    "feedback_ratio",
    """SELECT count_if(action = 'good') AS good_count, count_if(action = 'bad') AS bad_count,
      count_if(action = 'save') AS save_count FROM article_feedback""",
    ("article_feedback",),
)
def _(v: Views):
    return D.feedback_ratio(v.article_feedback)


@register(
    "genre_interest",
    """SELECT * FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY positive_count DESC, domain ASC NULLS LAST) AS position
      FROM (SELECT f.user_id, a.domain, count_if(f.action IN ('good', 'save')) AS positive_count,
              count_if(f.action = 'bad') AS negative_count
            FROM article_feedback f JOIN articles a USING (article_id) GROUP BY 1, 2))
    WHERE position <= 20""",
    AF,
)
def _(v: Views):
    return D.genre_interest(v.article_feedback, v.articles)


@register(
    "technology_counts",
    """SELECT * FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY article_count DESC, technology) AS position
      FROM (SELECT user_id, technology, count(*) AS article_count
            FROM (SELECT f.user_id, unnest(a.technologies) AS technology
                  FROM article_feedback f JOIN articles a USING (article_id) WHERE f.action <> 'bad')
            GROUP BY 1, 2))
    WHERE position <= 20""",
    AF,
)
def _(v: Views):
    return D.technology_counts(v.article_feedback, v.articles)


@register(
    "primary_ratio",
    """SELECT f.user_id, count_if(a.is_primary_source) AS primary_count,
      count_if(NOT a.is_primary_source) AS secondary_count
    FROM article_feedback f JOIN articles a USING (article_id) WHERE f.action <> 'bad' GROUP BY 1""",
    AF,
)
def _(v: Views):
    return D.primary_ratio(v.article_feedback, v.articles)


def _liked_sql(column: str, extra: str = "") -> str:
    return f"""SELECT *{extra} FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY article_count DESC, {column} ASC NULLS LAST) AS position
      FROM (SELECT f.user_id, a.{column}, count(*) AS article_count
            FROM article_feedback f JOIN articles a USING (article_id) WHERE f.action <> 'bad' GROUP BY 1, 2))
    WHERE position <= 20"""


@register("content_type_counts", _liked_sql("content_type"), AF)
def _(v: Views):
    return D.content_type_counts(v.article_feedback, v.articles)


@register(
    "difficulty_counts",
    _liked_sql(
        "difficulty",
        """, CASE difficulty WHEN 'beginner' THEN 1 WHEN 'intermediate' THEN 2
        WHEN 'advanced' THEN 3 ELSE 4 END AS display_order""",
    ),
    AF,
)
def _(v: Views):
    return D.difficulty_counts(v.article_feedback, v.articles).withColumn(
        "display_order", F.col("display_order").cast("int")
    )


add_sql_view(
    "timeline",
    AF,
    f"""SELECT user_id, week, topic, count_if(action IN ('good', 'save')) AS positive_count,
      count_if(action = 'bad') AS negative_count
    FROM (SELECT f.user_id, date_trunc('week', f.created_at) AS week, f.action, unnest(a.topics) AS topic
          FROM article_feedback f JOIN articles a USING (article_id)
          WHERE f.created_at >= TIMESTAMP '{NOW}' - to_days({7 * WEEKS}))
    GROUP BY 1, 2, 3""",
)
add_sql_view(
    "additions",
    ("user_articles",),
    f"""SELECT user_id, date_trunc('week', created_at) AS week, count(*) AS interest_article_count
    FROM user_articles WHERE created_at >= TIMESTAMP '{NOW}' - to_days({7 * WEEKS}) GROUP BY 1, 2""",
)


def _timeline(v: Views):
    return D.topic_timeline(v.article_feedback, v.articles, now(), WEEKS)


def _additions(v: Views):
    return D.weekly_additions(v.user_articles, now(), WEEKS)


@register(
    "topic_timeline",
    f"""SELECT user_id, strftime(CAST(week AS TIMESTAMP), {TS}) AS week, topic, positive_count, negative_count FROM timeline""",
    ("timeline",),
)
def _(v: Views):
    return _timeline(v).withColumn("week", stamp(F.col("week")))


@register(
    "weekly_additions",
    f"SELECT user_id, strftime(CAST(week AS TIMESTAMP), {TS}) AS week, interest_article_count FROM additions",
    ("additions",),
)
def _(v: Views):
    return _additions(v).withColumn("week", stamp(F.col("week")))


@register(
    "weekly_totals",
    f"""SELECT user_id, strftime(CAST(week AS TIMESTAMP), {TS}) AS week,
      CAST(sum(positive_count) AS BIGINT) AS positive_total, CAST(sum(negative_count) AS BIGINT) AS negative_total
    FROM timeline GROUP BY user_id, week""",
    ("timeline",),
)
def _(v: Views):
    return D.weekly_totals(_timeline(v)).withColumn("week", stamp(F.col("week")))


@register(
    "timeline_merge",
    f"""SELECT coalesce(t.user_id, a.user_id) AS user_id,
      strftime(CAST(coalesce(t.week, a.week) AS TIMESTAMP), {TS}) AS week,
      coalesce(a.interest_article_count, 0) AS interest_article_count, coalesce(t.topics, '') AS topics
    FROM (SELECT user_id, week, string_agg(topic || ':' || positive_count || ':' || negative_count, ','
            ORDER BY topic) AS topics FROM timeline GROUP BY 1, 2) t
    FULL JOIN additions a ON a.user_id = t.user_id AND a.week = t.week""",
    ("timeline", "additions"),
)
def _(v: Views):
    text = F.array_join(
        F.transform("topics", lambda t: F.concat_ws(":", t["topic"], t["positive_count"], t["negative_count"])), ","
    )
    return D.timeline_buckets(_timeline(v), _additions(v)).withColumns(
        {"week": stamp(F.col("week")), "topics": text}
    )


add_sql_view(
    "population",
    ("user_articles", "article_feedback"),
    """SELECT coalesce(u.user_id, g.user_id) AS user_id, coalesce(u.article_id, g.article_id) AS article_id,
      coalesce(u.origin, 'good') AS origin, coalesce(u.created_at, g.created_at) AS created_at
    FROM user_articles u
    FULL JOIN (SELECT * FROM article_feedback WHERE action = 'good') g
      ON g.user_id = u.user_id AND g.article_id = u.article_id""",
)
add_sql_view(
    "recent_population",
    ("population",),
    """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, article_id)
      AS position FROM population) WHERE position <= 200""",
)


@register(
    "population_merge",
    f"SELECT user_id, article_id, origin, strftime(created_at, {TS}) AS created_at FROM population",
    ("population",),
)
def _(v: Views):
    return FB.interest_population(v.user_articles, v.article_feedback).withColumn(
        "created_at", stamp(F.col("created_at"))
    )


@register(
    "recency_cut",
    "SELECT user_id, article_id, origin, CAST(position AS INT) AS position FROM recent_population",
    ("recent_population",),
)
def _(v: Views):
    population = FB.interest_population(v.user_articles, v.article_feedback)
    return FB.recency_cut(population, CATALOG_CONFIG.max_profile_articles).drop("created_at")


@register(
    "origin_counts",
    "SELECT user_id, "
    + ", ".join(
        f"count_if(origin = '{o}') AS {o}_count" for o in ("manual", "good", "saved", "read_full", "clicked")
    )
    + " FROM recent_population GROUP BY 1",
    ("recent_population",),
)
def _(v: Views):
    population = FB.interest_population(v.user_articles, v.article_feedback)
    return FB.origin_counts(population, CATALOG_CONFIG.max_profile_articles)


@register(
    "latest_feedback",
    f"SELECT user_id, article_id, action, strftime(created_at, {TS}) AS created_at FROM article_feedback",
    ("article_feedback",),
)
def _(v: Views):
    return v.article_feedback.withColumn("created_at", stamp(F.col("created_at")))


add_sql_view(
    "base_owned",
    ("activity",),
    """SELECT user_id, article_id, arg_max(origin, w) AS origin, max(w) AS w, min(ts) AS created_at FROM (
      SELECT user_id, article_id, CASE event_type WHEN 'view' THEN 'read_full' ELSE 'clicked' END AS origin,
        CAST(CASE event_type WHEN 'view' THEN 0.2 ELSE 0.1 END AS DOUBLE) AS w, ts
      FROM activity WHERE event_type IN ('view', 'click')
      UNION ALL SELECT user_id, article_id, 'manual', CAST(1.0 AS DOUBLE), ts FROM activity WHERE event_id % 40 = 1)
    GROUP BY 1, 2""",
)


def _base_owned(v: Views):
    act = v.activity
    seen = act.filter(F.col("event_type").isin("view", "click"))
    view = F.col("event_type") == "view"
    rows = seen.select(
        "user_id",
        "article_id",
        F.when(view, "read_full").otherwise("clicked").alias("origin"),
        F.when(view, 0.2).otherwise(0.1).alias("interest_weight"),
        F.col("ts").alias("created_at"),
    ).unionByName(
        act.filter(F.col("event_id") % 40 == 1).select(
            "user_id",
            "article_id",
            F.lit("manual").alias("origin"),
            F.lit(1.0).alias("interest_weight"),
            F.col("ts").alias("created_at"),
        )
    )
    return FB.merge_owned(rows)


@register(
    "owned_after_feedback",
    f"""WITH gains AS (
      SELECT *, CASE action WHEN 'good' THEN 0.8 WHEN 'save' THEN 0.5 END AS gain FROM feedback_events),
    cuts AS (SELECT user_id, article_id, max(CASE WHEN op = 'delete' OR action = 'bad' THEN seq END) AS cut
      FROM gains GROUP BY 1, 2),
    effect AS (SELECT g.user_id, g.article_id, max(c.cut) AS cut,
        max(CASE WHEN g.seq < c.cut THEN gain END) AS before,
        max(CASE WHEN g.seq > coalesce(c.cut, -1) THEN gain END) AS after,
        min(CASE WHEN g.seq > coalesce(c.cut, -1) AND gain IS NOT NULL THEN created_at END) AS first_after
      FROM gains g JOIN cuts c ON c.user_id = g.user_id AND c.article_id = g.article_id GROUP BY 1, 2),
    joined AS (SELECT coalesce(b.user_id, e.user_id) AS user_id, coalesce(b.article_id, e.article_id) AS article_id,
        b.origin, b.w, b.created_at, e.after, e.first_after,
        b.origin IS NOT NULL AND NOT coalesce(e.cut IS NOT NULL AND e.before > b.w, false) AS kept
      FROM base_owned b FULL JOIN effect e ON e.user_id = b.user_id AND e.article_id = b.article_id)
    SELECT user_id, article_id,
      CASE WHEN after IS NOT NULL AND (NOT kept OR after > w)
        THEN CASE WHEN after > 0.6 THEN 'good' ELSE 'saved' END ELSE origin END AS origin,
      CAST(CASE WHEN after IS NOT NULL AND (NOT kept OR after > w) THEN after ELSE w END AS DOUBLE) AS interest_weight,
      strftime(CASE WHEN kept THEN created_at ELSE first_after END, {TS}) AS created_at
    FROM joined WHERE kept OR after IS NOT NULL""",
    ("base_owned", "feedback_events"),
)
def _(v: Views):
    return FB.apply_feedback_to_owned(v.feedback_events, _base_owned(v)).withColumn(
        "created_at", stamp(F.col("created_at"))
    )


add_sql_view(
    "topic_keys", ("articles",), "SELECT article_id, unnest(topics) AS key FROM articles"
)
add_sql_view("source_keys", ("articles",), "SELECT article_id, source_domain AS key FROM articles")


def _recent_sql(keys: str) -> str:
    return f"""SELECT * FROM (SELECT f.user_id, k.key, f.article_id, f.action, row_number() OVER (
        PARTITION BY f.user_id, k.key ORDER BY f.created_at DESC, f.article_id DESC) AS position
      FROM article_feedback f JOIN {keys} k USING (article_id)) WHERE position <= 5"""


@register("recent_actions_topic", _recent_sql("topic_keys"), ("article_feedback", "topic_keys"))
def _(v: Views):
    return P.recent_actions(v.article_feedback, P.topic_keys(v.articles), 5).drop("created_at")


@register(
    "negative_weights",
    f"""SELECT user_id, key, bad_count, CASE WHEN bad_count >= 3 THEN round((bad_count - 2) * 0.2e0, 6)
        ELSE 0e0 END AS negative_weight
    FROM (SELECT user_id, key, count_if(action = 'bad') AS bad_count FROM ({_recent_sql("topic_keys")}) GROUP BY 1, 2)""",
    ("article_feedback", "topic_keys"),
)
def _(v: Views):
    snapshot = P.snapshot_negative_weights(v.article_feedback, P.topic_keys(v.articles), DEFAULT.topic_decay)
    return snapshot.withColumn("negative_weight", F.round("negative_weight", 6))


def _learn_sql(keys: str, name: str, step: str, effective: str) -> str:
    """Sequential rule in SQL: window functions find the state at the last recomputation."""
    return f"""WITH ordered AS (SELECT *, lag(op) OVER (PARTITION BY user_id, article_id ORDER BY seq) AS prev
      FROM feedback_events),
    log AS (SELECT o.*, k.key, o.op = 'post' AND coalesce(prev, 'delete') = 'delete' AS opens
      FROM ordered o JOIN {keys} k USING (article_id) WHERE o.op = 'post' OR prev = 'post'),
    totals AS (SELECT user_id, key, count_if(action = 'good') * 0.8e0 + count_if(action = 'save') * 0.5e0 AS positive,
        max(CASE WHEN op = 'delete' OR action = 'bad' THEN seq END) AS trigger FROM log GROUP BY 1, 2),
    past AS (SELECT l.* FROM log l JOIN totals t ON t.user_id = l.user_id AND t.key = l.key WHERE l.seq <= t.trigger),
    cuts AS (SELECT user_id, key, article_id, max(seq) AS cut FROM past WHERE op = 'delete' GROUP BY 1, 2, 3),
    state AS (SELECT p.user_id, p.key, p.article_id, arg_max(p.action, p.seq) AS action, min(p.created_at) AS created_at
      FROM past p LEFT JOIN cuts c ON c.user_id = p.user_id AND c.key = p.key AND c.article_id = p.article_id
      WHERE p.op = 'post' AND p.seq > coalesce(c.cut, -1) GROUP BY 1, 2, 3),
    recent AS (SELECT *, row_number() OVER (PARTITION BY user_id, key ORDER BY created_at DESC, article_id DESC) AS pos
      FROM state),
    neg AS (SELECT user_id, key, CASE WHEN count_if(action = 'bad') >= 3
        THEN (count_if(action = 'bad') - 2) * {step} ELSE 0e0 END AS negative
      FROM recent WHERE pos <= 5 GROUP BY 1, 2),
    levels AS (SELECT user_id, key, sum(CASE WHEN opens THEN 1 WHEN op = 'delete' THEN -1 ELSE 0 END) OVER (
        PARTITION BY user_id, key ORDER BY seq) AS level FROM log),
    peaks AS (SELECT user_id, key, max(level) AS peak FROM levels GROUP BY 1, 2),
    rows AS (SELECT t.user_id, t.key, t.positive, coalesce(n.negative, 0e0) AS negative, p.peak
      FROM totals t LEFT JOIN neg n ON n.user_id = t.user_id AND n.key = t.key
      JOIN peaks p ON p.user_id = t.user_id AND p.key = t.key)
    SELECT user_id, key AS {name}, round(positive, 6) AS positive_weight, round(negative, 6) AS negative_weight,
      round({effective}, 6) AS effective_weight
    FROM rows WHERE positive > 0 OR negative > 0 OR peak >= 3"""


TOPIC_PREF_SQL = _learn_sql("topic_keys", "topic", "0.2e0", "positive / (1e0 + negative)")
SOURCE_PREF_SQL = _learn_sql("source_keys", "source_domain", "1e0", "positive - negative")


def _rounded(df):
    names = ("positive_weight", "negative_weight", "effective_weight")
    return df.withColumns({n: F.round(n, 6) for n in names})


@register("topic_preferences", TOPIC_PREF_SQL, ("feedback_events", "topic_keys"))
def _(v: Views):
    return _rounded(P.topic_preferences(v.feedback_events, v.articles))


@register("source_preferences", SOURCE_PREF_SQL, ("feedback_events", "source_keys"))
def _(v: Views):
    return _rounded(P.source_preferences(v.feedback_events, v.articles))


add_sql_view("topic_pref", ("feedback_events", "topic_keys"), TOPIC_PREF_SQL)
add_sql_view("source_pref", ("feedback_events", "source_keys"), SOURCE_PREF_SQL)


@register(
    "suppressed_topics",
    """SELECT user_id, topic, negative_weight, effective_weight, position FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY negative_weight DESC, topic) AS position
      FROM topic_pref WHERE negative_weight > 0) WHERE position <= 20""",
    ("topic_pref",),
)
def _(v: Views):
    return P.suppressed_topics(_rounded(P.topic_preferences(v.feedback_events, v.articles))).drop("positive_weight")


# --- filters ---------------------------------------------------------------------------------


@register(
    "text_search",
    """SELECT article_id FROM articles
    WHERE contains(lower(title), 'the_%') OR contains(lower(coalesce(translated_title, '')), 'the_%')
      OR contains(lower(summary), 'the_%') OR contains(lower(summary), 'license')""",
    ("articles",),
)
def _(v: Views):
    hits = FL.text_search(F.lit("the_%")) | FL.text_search(F.lit("LICENSE"), ("summary",))
    return v.articles.filter(hits).select("article_id")


@register(
    "tag_filter",
    """SELECT article_id FROM articles
    WHERE list_has_all(topics, ['topic3', 'topic5']) OR list_has_all(technologies, ['tech2'])""",
    ("articles",),
)
def _(v: Views):
    hit = FL.has_all_tags("topics", ["topic3", "topic5"]) | FL.has_all_tags("technologies", ["tech2"])
    return v.articles.filter(hit).select("article_id")


@register(
    "age_window",
    f"""SELECT article_id FROM articles
    WHERE NOT is_dead AND coalesce(published_at, fetched_at) >= TIMESTAMP '{NOW}' - INTERVAL 7 DAYS""",
    ("articles",),
)
def _(v: Views):
    return v.articles.filter(FL.alive() & FL.within_age(now(), 7)).select("article_id")


@register(
    "published_range",
    """SELECT article_id, source_domain FROM articles
    WHERE coalesce(published_at, fetched_at) BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'
      AND source_domain LIKE '%.example.net'""",
    ("articles",),
)
def _(v: Views):
    window = FL.published_between(F.lit("2024-01-05").cast("timestamp"), F.lit("2024-01-20").cast("timestamp"))
    return v.articles.filter(window & F.col("source_domain").endswith(".example.net")).select(
        "article_id", "source_domain"
    )


@register(
    "fresh_candidates",
    f"""SELECT article_id FROM articles WHERE published_at >= TIMESTAMP '{NOW}' - INTERVAL 7 DAYS""",
    ("articles",),
)
def _(v: Views):
    return FL.filter_recent(v.articles, now(), 7).select("article_id")


@register(
    "interest_list",
    """SELECT u.user_id, u.article_id, u.origin, row_number() OVER (
        PARTITION BY u.user_id ORDER BY u.created_at DESC, u.article_id DESC) AS position
    FROM user_articles u JOIN articles a USING (article_id)
    WHERE u.origin IN ('manual', 'good') AND a.language = 'en' AND a.domain IS NOT NULL
      AND u.created_at >= TIMESTAMP '2024-01-03' AND NOT a.is_primary_source""",
    ("user_articles", "articles"),
)
def _(v: Views):
    spec = FL.InterestFilter(
        origins=("manual", "good", "clicked"),
        language="en",
        registered_from=F.lit("2024-01-03").cast("timestamp"),
        is_primary_source=False,
    )
    rows = FL.interest_list(v.user_articles, v.articles.filter(F.col("domain").isNotNull()), spec)
    order = [F.col("created_at").desc(), F.col("article_id").desc()]
    # Positions from the global order: a user with a third of all rows is spread over tasks.
    placed = ordered_index(rows, F.col("user_id"), *order, name="place")
    first = placed.groupBy("user_id").agg(F.min("place").alias("first"))
    return placed.join(first, "user_id").select("user_id", "article_id", "origin", (F.col("place") - F.col("first") + 1).alias("position"))


@register(
    "incremental_work",
    """SELECT article_id, NOT (analysis_status = 'completed' AND coalesce(prev_hash = body_hash, false)) AS needs_analysis,
      NOT (embedding IS NOT NULL AND coalesce(prev_hash = body_hash, false)) AS needs_embedding
    FROM (SELECT *, CASE article_id % 3 WHEN 0 THEN body_hash WHEN 1 THEN 'old' END AS prev_hash FROM articles)""",
    ("articles",),
)
def _(v: Views):
    a = F.col("article_id") % 3
    rows = v.articles.withColumn("prev_hash", F.when(a == 0, F.col("body_hash")).when(a == 1, "old"))
    rows = rows.withColumn("summary", F.when(F.col("analysis_status") == "completed", F.col("summary")))
    return rows.select(
        "article_id",
        FL.needs_analysis("summary", "prev_hash").alias("needs_analysis"),
        FL.needs_embedding("embedding", "prev_hash").alias("needs_embedding"),
    )


@register(
    "page_counts",
    """SELECT user_id, count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages
    FROM user_articles GROUP BY 1""",
    ("user_articles",),
)
def _(v: Views):
    return D.page_counts(v.user_articles, ["user_id"], 20)


@register(
    "topic_list",
    """SELECT user_id, topic, position FROM (SELECT user_id, topic, row_number() OVER (
        PARTITION BY user_id ORDER BY effective_weight DESC, topic) AS position FROM topic_pref) WHERE position BETWEEN 6 AND 10""",
    ("topic_pref",),
)
def _(v: Views):
    # Weights are rounded like the SQL view's, so that equal ones tie alike.
    return P.topic_list(_rounded(P.topic_preferences(v.feedback_events, v.articles)), 2, 5).select("user_id", "topic", "position")


@register(
    "body_selection",
    """SELECT article_id, length(body) AS body_length FROM articles WHERE length(body) >= 1000
    ORDER BY body_length, article_id LIMIT 25""",
    ("articles",),
)
def _(v: Views):
    return FL.bodies_for_measurement(v.articles, 1000, 25).select("article_id", "body_length")
