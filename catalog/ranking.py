"""Profiles, similarities, scores, feeds and ranking diagnostics."""

from __future__ import annotations

import re
import uuid
from dataclasses import replace

from pyspark.sql import functions as F

import catalog.interest  # noqa: F401  (its SQL views are used below)
from catalog.registry import register
from catalog.views import CATALOG_CONFIG, NOW, SQL_VIEWS, Views, add_sql_view, now
from millrace.config import DEFAULT, REASON_CLOSING, REASON_PHRASES
from millrace.operators import diagnostics as G
from millrace.operators import profile as PR
from millrace.operators import scoring as S
from millrace.operators.feedback import read_flags
from millrace.operators.neighbors import bad_similarities, pool_features
from millrace.operators.preferences import source_preferences
from millrace.operators.similarity import neighbor_similarity, profile_features, similar_by_vector
from millrace.operators.whole_runs import whole_runs
from millrace.plans.discover import FeedInputs, candidate_pool, discover_feed, related_articles
from millrace.operators.filters import ArticleFilter
from millrace.plans.interest import fill_record, novelty_distribution, slot_divergence, threshold_sweep
from millrace.session import ensure_checkpoint_dir, materialize
from millrace.sources.sinks import latest_runs, read_page, write_run

# One cluster per user makes the centroid the mean vector, which SQL can state.
CAPPED = replace(
    CATALOG_CONFIG,
    clustering=replace(DEFAULT.clustering, max_clusters=1),
    composition=replace(DEFAULT.composition, strong_interest_min_similarity=0.2, exploration_min_novelty=0.7),
)
CFG = replace(CAPPED, max_candidates=None, max_profile_articles=None, max_bad_articles=None)
FEED_SIZE = 40
PLACES = 6


def inputs(v: Views) -> FeedInputs:
    if not hasattr(v, "_source_preferences"):
        v._source_preferences = materialize(source_preferences(v.feedback_events, v.articles, CFG))
    return FeedInputs(v.articles, v.user_articles, v.article_feedback, v.source_registry, v._source_preferences)


def part_of(v: Views, rows, key: str) -> Views:
    """The views over the activity of the users, or with the articles, in ``rows``: opinions, owned articles and preferences belong to a
    user and an article, so they are those of all activity.  Whole views are taken where they have been written."""
    if "user_articles" in v.__dict__:
        return v
    part = Views(v.spark, v.sf_dir)
    part.n_docs, part.n_pages = v.n_docs, v.n_pages
    part.activity = v.activity.join(rows, key, "left_semi")
    return part


def users(v: Views):
    return v.user_articles.select("user_id").distinct()


def run(v: Views, cfg=CFG):
    """The discover job, once per Views object and settings."""
    name = "_run" if cfg is CFG else "_run_capped"
    if not hasattr(v, name):
        setattr(v, name, discover_feed(users(v), inputs(v), now(), cfg, size=FEED_SIZE))
    return getattr(v, name)


# Views that depend on a cut, and the cuts.  Queries read the SQL without them; those named ``_capped`` show the setting.
_CUT_VIEWS = ("recent_population", "weighted", "candidates", "vectors", "interest_sim", "bad_sim", "centroids", "novelties",
              "scored", "slotted", "composed")
_CUTS = re.compile(r"\s*WHERE (?:position <= 200|position <= 500|k <= 100|k <= 500)(?!\d)")


def _uncapped_sql(sql: str) -> str:
    return re.sub(rf"\b({'|'.join(_CUT_VIEWS)})\b", r"\1_uncapped", _CUTS.sub("", sql))


def _uncapped_view(name: str) -> str:
    if name not in _CUT_VIEWS:
        return name
    if f"{name}_uncapped" not in SQL_VIEWS:
        needs, sql = SQL_VIEWS[name]
        add_sql_view(f"{name}_uncapped", tuple(_uncapped_view(n) for n in needs), _uncapped_sql(sql))
    return f"{name}_uncapped"


def register_open(name: str, sql: str, views: tuple[str, ...]):
    """Register ``build(views)`` with its SQL freed of all cuts."""
    return register(name, _uncapped_sql(sql), tuple(_uncapped_view(n) for n in views))


def register_both(name: str, sql: str, views: tuple[str, ...]):
    """Register ``build(views, cfg)`` without any cut and, as ``name_capped``, with the cuts its SQL states."""

    def wrap(build):
        register_open(name, sql, views)(lambda v: build(v, CFG))
        register(f"{name}_capped", sql, views)(lambda v: build(v, CAPPED))
        return build

    return wrap


def rounded(df, *names: str):
    return df.withColumns({n: F.round(n, PLACES) for n in names})


add_sql_view(
    "weighted",
    ("recent_population", "articles"),
    f"""SELECT r.user_id, r.article_id, r.origin, r.position, a.topics, a.embedding,
      CASE r.origin WHEN 'manual' THEN 1e0 WHEN 'good' THEN 0.8e0 WHEN 'saved' THEN 0.5e0
        WHEN 'read_full' THEN 0.2e0 ELSE 0.1e0 END
      * CASE WHEN r.created_at >= TIMESTAMP '{NOW}' THEN 1e0 ELSE pow(0.5e0,
          (epoch_us(TIMESTAMP '{NOW}') - epoch_us(r.created_at)) / 86400e6 / 30e0) END
      * greatest(0.3e0, CASE WHEN a.embedding IS NOT NULL THEN 0.4e0 ELSE 0e0 END
        + CASE WHEN len(a.topics) > 0 THEN 0.3e0 ELSE 0e0 END
        + CASE WHEN a.analysis_status = 'completed' THEN 0.3e0 ELSE 0e0 END) AS weight
    FROM recent_population r JOIN articles a USING (article_id)""",
)
add_sql_view(
    "pool",
    ("articles",),
    f"""SELECT *, row_number() OVER (ORDER BY published_at DESC NULLS LAST, article_id) AS place FROM articles
    WHERE NOT is_dead AND coalesce(published_at, fetched_at) >= TIMESTAMP '{NOW}' - INTERVAL 60 DAYS""",
)
add_sql_view(
    "excluded",
    ("article_feedback", "user_articles"),
    """SELECT user_id, article_id FROM article_feedback WHERE action = 'bad'
    UNION SELECT user_id, article_id FROM user_articles WHERE origin IN ('manual', 'good', 'saved')""",
)
add_sql_view(
    "candidates",
    ("pool", "excluded", "user_articles"),
    """SELECT user_id, article_id, position FROM (
      SELECT u.user_id, p.article_id, row_number() OVER (PARTITION BY u.user_id ORDER BY p.place) AS position
      FROM (SELECT DISTINCT user_id FROM user_articles) u CROSS JOIN pool p
      WHERE NOT EXISTS (SELECT 1 FROM excluded x WHERE x.user_id = u.user_id AND x.article_id = p.article_id))
    WHERE position <= 500""",
)
add_sql_view(
    "vectors",
    ("candidates", "articles"),
    """SELECT c.user_id, c.article_id, CAST(a.embedding AS DOUBLE[]) AS v
    FROM candidates c JOIN articles a USING (article_id) WHERE a.embedding IS NOT NULL""",
)
add_sql_view(
    "pair_cosine",
    ("articles",),
    """WITH e AS (SELECT article_id, CAST(embedding AS DOUBLE[]) AS v FROM articles WHERE embedding IS NOT NULL)
    SELECT a.article_id AS a, b.article_id AS b, list_cosine_similarity(a.v, b.v) AS s FROM e a CROSS JOIN e b""",
)
add_sql_view(
    "interest_sim",
    ("vectors", "weighted", "pair_cosine"),
    """SELECT user_id, article_id, CASE WHEN sum(weight) = 0 THEN avg(s) ELSE sum(s * weight) / sum(weight) END
      AS interest_similarity
    FROM (SELECT c.user_id, c.article_id, p.s, w.weight, row_number() OVER (
            PARTITION BY c.user_id, c.article_id ORDER BY p.s DESC, w.position) AS k
          FROM vectors c JOIN weighted w ON w.user_id = c.user_id AND w.embedding IS NOT NULL
          JOIN pair_cosine p ON p.a = c.article_id AND p.b = w.article_id)
    WHERE k <= 3 GROUP BY 1, 2""",
)
add_sql_view(
    "bad_sim",
    ("vectors", "article_feedback", "pair_cosine"),
    """SELECT c.user_id, c.article_id, max(p.s) AS bad_similarity
    FROM vectors c
    JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, article_id) AS k
          FROM article_feedback WHERE action = 'bad') WHERE k <= 100) f ON f.user_id = c.user_id
    JOIN pair_cosine p ON p.a = c.article_id AND p.b = f.article_id
    GROUP BY 1, 2""",
)
add_sql_view(
    "centroids",
    ("weighted",),
    """SELECT user_id, list(m ORDER BY i) AS v FROM (
      SELECT user_id, i, avg(x) AS m FROM (
        SELECT user_id, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS i
        FROM weighted WHERE embedding IS NOT NULL) GROUP BY 1, 2) GROUP BY 1""",
)
add_sql_view(
    "novelties",
    ("vectors", "centroids", "pair_cosine"),
    """SELECT c.user_id, c.article_id, list_cosine_similarity(c.v, m.v) AS centroid_similarity,
      n.neighbor_similarity
    FROM vectors c LEFT JOIN centroids m ON m.user_id = c.user_id
    LEFT JOIN (SELECT x.user_id, x.article_id, max(p.s) AS neighbor_similarity
               FROM vectors x JOIN vectors y ON y.user_id = x.user_id AND y.article_id <> x.article_id
               JOIN pair_cosine p ON p.a = x.article_id AND p.b = y.article_id GROUP BY 1, 2) n
      ON n.user_id = c.user_id AND n.article_id = c.article_id""",
)
add_sql_view(
    "names",
    ("source_registry",),
    """SELECT domain AS source_domain, list_distinct(list(lower(trim(name)))) AS names FROM (
      SELECT domain, entity_name AS name FROM source_registry
      UNION ALL SELECT domain, github_org FROM source_registry WHERE github_org IS NOT NULL) GROUP BY 1""",
)
add_sql_view(
    "matches",
    ("articles", "names"),
    """SELECT a.article_id, coalesce(max(CASE WHEN t.tag = n.name THEN 1e0
        WHEN contains(t.tag, n.name) OR contains(n.name, t.tag) THEN 0.5e0 ELSE 0e0 END), 0e0) AS source_article_match
    FROM articles a
    LEFT JOIN (SELECT article_id, lower(trim(unnest(list_concat(topics, technologies)))) AS tag FROM articles) t
      ON t.article_id = a.article_id
    LEFT JOIN (SELECT source_domain, unnest(names) AS name FROM names) n ON n.source_domain = a.source_domain
    GROUP BY 1""",
)
_W = {n: f"{getattr(DEFAULT.weights, n)}e0" for n in S.COMPONENTS}
add_sql_view(
    "scored",
    ("candidates", "articles", "interest_sim", "bad_sim", "novelties", "matches", "source_pref", "user_articles"),
    f"""WITH joined AS (
      SELECT c.user_id, c.article_id, a.source_domain, a.is_primary_source,
        coalesce(i.interest_similarity, 0e0) AS interest_similarity, a.source_authority, m.source_article_match,
        CASE WHEN coalesce(a.published_at, a.fetched_at) >= TIMESTAMP '{NOW}' THEN 1e0 ELSE greatest(0e0,
          1e0 - (epoch_us(TIMESTAMP '{NOW}') - epoch_us(coalesce(a.published_at, a.fetched_at))) / 86400e6 / 60e0) END
          AS freshness,
        a.technical_quality,
        CASE WHEN n.centroid_similarity IS NULL THEN 0.5e0
          ELSE least(greatest(least(1e0 - n.centroid_similarity, 1e0), 0e0),
            greatest(least(1e0 - coalesce(n.neighbor_similarity, -1e0), 1e0), 0e0)) END AS novelty,
        least(1.5e0, greatest(0.5e0, 1e0 + 0.15e0 * coalesce(s.effective_weight, 0e0))) AS source_preference_factor,
        a.duplicate_penalty,
        CASE WHEN coalesce(u.origin, '') IN ('read_full', 'clicked') THEN 0.3e0 ELSE 0e0 END AS read_penalty,
        CASE WHEN b.bad_similarity >= 0.2e0 THEN 0.5e0 * least(1e0, (b.bad_similarity - 0.2e0) / 0.8e0) ELSE 0e0 END
          AS bad_similarity_penalty
      FROM candidates c JOIN articles a USING (article_id)
      LEFT JOIN interest_sim i ON i.user_id = c.user_id AND i.article_id = c.article_id
      LEFT JOIN bad_sim b ON b.user_id = c.user_id AND b.article_id = c.article_id
      LEFT JOIN novelties n ON n.user_id = c.user_id AND n.article_id = c.article_id
      LEFT JOIN matches m ON m.article_id = c.article_id
      LEFT JOIN source_pref s ON s.user_id = c.user_id AND s.source_domain = a.source_domain
      LEFT JOIN user_articles u ON u.user_id = c.user_id AND u.article_id = c.article_id),
    gated AS (SELECT *, CASE WHEN interest_similarity >= 0.35e0 THEN 1e0
        ELSE 0.2e0 + 0.8e0 * greatest(0e0, least(1e0, interest_similarity / 0.35e0)) END AS authority_gate_factor
      FROM joined),
    parts AS (SELECT *, interest_similarity * {_W["interest_similarity"]} AS c0,
        source_authority * {_W["source_authority"]} * authority_gate_factor * source_preference_factor AS c1,
        source_article_match * {_W["source_article_match"]} AS c2, freshness * {_W["freshness"]} AS c3,
        technical_quality * {_W["technical_quality"]} AS c4, novelty * {_W["novelty"]} AS c5 FROM gated),
    totals AS (SELECT *, round(c0 + c1 + c2 + c3 + c4 + c5 - duplicate_penalty - read_penalty
      - bad_similarity_penalty, 9) AS total FROM parts)
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY total DESC, CAST(article_id AS VARCHAR)) AS rank
    FROM totals""",
)


@register_both(
    "effective_interest",
    "SELECT user_id, article_id, origin, round(weight, 6) AS weight FROM weighted",
    ("weighted",),
)
def _(v: Views, cfg):
    rows = PR.weighted_interest(v.user_articles, v.article_feedback, v.articles, now(), cfg)
    return rounded(rows, "weight").select("user_id", "article_id", "origin", "weight")


@register_both(
    "not_bad_not_owned",
    "SELECT user_id, article_id, CAST(position AS INT) AS candidate_position FROM candidates",
    ("candidates",),
)
def _(v: Views, cfg):
    pool = candidate_pool(v.articles, now(), cfg)
    excluded = S.exclusions(v.article_feedback, v.user_articles)
    return S.select_candidates(users(v), pool, excluded, cfg.max_candidates)[0]


@register(
    "candidate_truncation",
    """SELECT user_id, eligible, greatest(eligible - 500, 0) AS truncated FROM (
      SELECT u.user_id, count(*) AS eligible FROM (SELECT DISTINCT user_id FROM user_articles) u CROSS JOIN pool p
      WHERE NOT EXISTS (SELECT 1 FROM excluded x WHERE x.user_id = u.user_id AND x.article_id = p.article_id)
      GROUP BY 1)""",
    ("pool", "excluded", "user_articles"),
)
def _(v: Views):
    pool = candidate_pool(v.articles, now(), CAPPED)
    excluded = S.exclusions(v.article_feedback, v.user_articles)
    return S.select_candidates(users(v), pool, excluded, CAPPED.max_candidates)[1]


@register(
    "read_flags",
    """SELECT DISTINCT user_id, article_id FROM user_articles WHERE origin IN ('read_full', 'clicked')""",
    ("user_articles",),
)
def _(v: Views):
    return read_flags(v.user_articles)


@register(
    "entity_lookup",
    """SELECT source_domain, array_to_string(list_sort(names), ',') AS entity_names FROM names""",
    ("names",),
)
def _(v: Views):
    return S.entity_names(v.source_registry).withColumn("entity_names", F.array_join("entity_names", ","))


@register(
    "source_topic_match",
    "SELECT article_id, source_article_match FROM matches",
    ("matches",),
)
def _(v: Views):
    rows = v.articles.join(S.entity_names(v.source_registry), "source_domain", "left")
    match = S.source_topic_match(F.col("entity_names"), F.concat("topics", "technologies"), 0.5)
    return rows.select("article_id", match.alias("source_article_match"))


@register_both(
    "interest_similarity",
    """SELECT c.user_id, c.article_id, round(coalesce(i.interest_similarity, 0e0), 6) AS interest_similarity
    FROM vectors c LEFT JOIN interest_sim i ON i.user_id = c.user_id AND i.article_id = c.article_id""",
    ("vectors", "interest_sim"),
)
def _(v: Views, cfg):
    return rounded(_features(v, cfg), "interest_similarity").select("user_id", "article_id", "interest_similarity")


def _features(v: Views, cfg=CFG):
    name = "_tiled" if cfg is CFG else "_tiled_capped"
    if not hasattr(v, name):
        whole = _whole(v, cfg, lambda: PR.build_profiles(v.user_articles, v.article_feedback, v.articles, now(), cfg))
        setattr(v, name, materialize(_tiled_features(v, cfg)) if whole is None else whole.similar)
    return getattr(v, name)


def _whole(v: Views, cfg, profile, neighbors: bool = True):
    """All users over the whole pool for their similarities alone: nothing opened, no liked domain."""
    if cfg.max_candidates is not None:
        return None
    front = materialize(candidate_pool(v.articles, now(), cfg).select(*S.ARTICLE_COLUMNS, "embedding"))
    excluded = S.exclusions(v.article_feedback, v.user_articles)
    liked = v.spark.createDataFrame([], "user_id long, source_domain string, effective_weight double")
    small = replace(cfg, vector_tile_rows=128)  # on purpose: several blocks must give the same result
    return whole_runs(users(v), front, excluded, profile(), excluded.limit(0), liked, v.source_registry, now(), small, neighbors)


def _tiled_features(v: Views, cfg):
    pool = candidate_pool(v.articles, now(), cfg)
    excluded = S.exclusions(v.article_feedback, v.user_articles)
    chosen, _report = S.select_candidates(users(v), pool, excluded, cfg.max_candidates, positions=False)
    profile = PR.build_profiles(v.user_articles, v.article_feedback, v.articles, now(), cfg)
    if cfg.max_candidates is None:
        # Small tiles on purpose here and below: several blocks must give the same result.
        found = pool_features(chosen, pool, excluded, profile, users(v), replace(cfg, vector_tile_rows=128))
        return found.filter(F.col("interest_similarity").isNotNull())
    vectors = chosen.join(v.articles.select("article_id", "embedding"), "article_id")
    return profile_features(vectors, profile, replace(cfg, vector_tile_rows=128))


@register_both(
    "bad_penalty",
    """SELECT c.user_id, c.article_id, round(CASE WHEN b.bad_similarity >= 0.2e0
        THEN 0.5e0 * least(1e0, (b.bad_similarity - 0.2e0) / 0.8e0) ELSE 0e0 END, 6) AS bad_similarity_penalty
    FROM vectors c LEFT JOIN bad_sim b ON b.user_id = c.user_id AND b.article_id = c.article_id""",
    ("vectors", "bad_sim"),
)
def _(v: Views, cfg):
    penalty = S.bad_similarity_penalty(F.col("bad_similarity"), cfg)
    pool = candidate_pool(v.articles, now(), cfg).select("article_id", "published_at", "embedding")
    excluded = S.exclusions(v.article_feedback, v.user_articles)
    bad = PR.bad_vectors(v.article_feedback, v.articles, cfg)
    whole = _whole(v, cfg, lambda: PR.bad_profile(bad), neighbors=False)
    rows = bad_similarities(users(v), pool, excluded, bad, cfg) if whole is None else whole.similar
    rows = rows.withColumn("bad_similarity_penalty", penalty)
    return rounded(rows, "bad_similarity_penalty").select("user_id", "article_id", "bad_similarity_penalty")


@register_both(
    "novelty",
    """SELECT user_id, article_id, round(centroid_similarity, 6) AS centroid_similarity,
      round(neighbor_similarity, 6) AS neighbor_similarity FROM novelties""",
    ("novelties",),
)
def _(v: Views, cfg):
    names = ("centroid_similarity", "neighbor_similarity")
    return rounded(_features(v, cfg), *names).select("user_id", "article_id", *names)


SCORE_COLUMNS = (
    "interest_similarity",
    "source_article_match",
    "freshness",
    "novelty",
    "authority_gate_factor",
    "source_preference_factor",
    "read_penalty",
    "bad_similarity_penalty",
    "total",
)


@register_both(
    "candidate_scores",
    "SELECT user_id, article_id, "
    + ", ".join(c if c == "total" else f"round({c}, 6) AS {c}" for c in SCORE_COLUMNS)
    + " FROM scored",
    ("scored",),
)
def _(v: Views, cfg):
    # The total already carries nine places; rounding twice would disagree on halves.
    return rounded(run(v, cfg).scored, *SCORE_COLUMNS[:-1]).select("user_id", "article_id", *SCORE_COLUMNS)


@register_both("candidate_ranks", "SELECT user_id, article_id, CAST(rank AS BIGINT) AS rank FROM scored", ("scored",))
def _(v: Views, cfg):
    return run(v, cfg).ranks.withColumn("rank", F.col("rank").cast("long"))


_PHRASES = [REASON_PHRASES[n] for n in S.COMPONENTS]


@register_open(
    "reason_top2",
    f"""SELECT user_id, article_id, first.a || '、' || second.b || '{REASON_CLOSING}' AS summary FROM (
      SELECT user_id, article_id, t[1] AS first, t[2] AS second FROM (
        SELECT user_id, article_id, list_sort([{", ".join(
          f"{{'k': -c{i}, 'p': {i}, 'a': '{a}', 'b': '{b}'}}" for i, (a, b) in enumerate(_PHRASES))}]) AS t
        FROM scored))""",
    ("scored",),
)
def _(v: Views):
    return S.with_reasons(run(v).scored).select("user_id", "article_id", F.col("reasons.summary").alias("summary"))


# Shares of 40 by the default ratios 55, 25, 15 and 5 per cent.
_QUOTA = {"strong_interest": 22, "primary_source": 10, "exploration": 6, "diversity": 2}
_QUOTA_CASE = " ".join(f"WHEN '{s}' THEN {q}" for s, q in _QUOTA.items())
add_sql_view(
    "slotted",
    ("scored",),
    f"""SELECT *, row_number() OVER (PARTITION BY user_id, slot ORDER BY rank) AS slot_rank,
      CASE slot {_QUOTA_CASE} END AS quota
    FROM (SELECT *, CASE WHEN interest_similarity >= 0.2 THEN 'strong_interest' WHEN is_primary_source
        THEN 'primary_source' WHEN novelty >= 0.7 THEN 'exploration' ELSE 'diversity' END AS slot FROM scored)""",
)
add_sql_view(
    "composed",
    ("slotted",),
    f"""WITH regular AS (SELECT * FROM slotted WHERE slot <> 'diversity' AND slot_rank <= quota),
    one AS (SELECT *, row_number() OVER (PARTITION BY user_id, source_domain ORDER BY rank) AS k FROM slotted s
      WHERE slot = 'diversity' AND NOT EXISTS (SELECT 1 FROM regular r
        WHERE r.user_id = s.user_id AND r.source_domain = s.source_domain)),
    diverse AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rank) AS j FROM one WHERE k = 1),
    picked AS (SELECT user_id, article_id, slot, rank FROM regular
      UNION ALL SELECT user_id, article_id, slot, rank FROM diverse WHERE j <= {_QUOTA["diversity"]}),
    counts AS (SELECT user_id, {", ".join(f"count_if(slot = '{s}') AS n{i}" for i, s in enumerate(_QUOTA))}
      FROM picked GROUP BY 1),
    spare AS (SELECT s.user_id, s.article_id, s.rank, row_number() OVER (PARTITION BY s.user_id ORDER BY s.rank) AS k
      FROM scored s WHERE NOT EXISTS (SELECT 1 FROM picked p
        WHERE p.user_id = s.user_id AND p.article_id = s.article_id)),
    gaps AS (SELECT user_id, {", ".join(
      " + ".join(f"({q} - n{i})" for i, q in list(enumerate(_QUOTA.values()))[: k + 1]) + f" AS e{k}"
      for k in range(4))} FROM counts),
    extra AS (SELECT s.user_id, s.article_id, s.rank, CASE {" ".join(
      f"WHEN s.k <= g.e{k} THEN '{s}'" for k, s in enumerate(_QUOTA))} END AS slot
      FROM spare s JOIN gaps g ON g.user_id = s.user_id)
    SELECT user_id, article_id, slot, rank, false AS backfilled FROM picked
    UNION ALL SELECT user_id, article_id, slot, rank, true FROM extra WHERE slot IS NOT NULL""",
)


@register_both(
    "feed_slots",
    """SELECT user_id, article_id, slot, backfilled, CAST(row_number() OVER (PARTITION BY user_id ORDER BY rank) AS INT)
      AS feed_rank FROM composed""",
    ("composed",),
)
def _(v: Views, cfg):
    return run(v, cfg).picks.select("user_id", "article_id", "slot", "backfilled", "feed_rank")


@register_open(
    "latest_page",
    """SELECT user_id, article_id, feed_rank FROM (SELECT user_id, article_id,
        CAST(row_number() OVER (PARTITION BY user_id ORDER BY rank) AS INT) AS feed_rank FROM composed)
    WHERE feed_rank BETWEEN 21 AND 40""",
    ("composed",),
)
def _(v: Views):
    # Page 2 of 20: pages are range reads of the stored rank.
    return run(v).picks.filter(F.col("feed_rank").between(21, 40)).select("user_id", "article_id", "feed_rank")


@register_open(
    "stored_run",
    """SELECT user_id, 'discover' AS mode, sha256('{}') AS fingerprint, article_id, rank FROM (SELECT user_id, article_id,
        CAST(row_number() OVER (PARTITION BY user_id ORDER BY rank) AS INT) AS rank FROM composed) WHERE rank <= 10""",
    ("composed",),
)
def _(v: Views):
    """Two runs are written and the newer one is read back, page 1 of 10."""
    ensure_checkpoint_dir(v.spark)
    path = f"{v.spark.sparkContext.getCheckpointDir()}/run-{uuid.uuid4().hex}"
    for run_id, hours in (("a", 2), ("b", 1)):
        write_run(run(v).feed, path, run_id, now() - F.expr(f"INTERVAL {hours} HOURS"), fingerprint=ArticleFilter().fingerprint())
    newest = latest_runs(v.spark.read.parquet(f"{path}/runs"))
    page = read_page(v.spark.read.parquet(f"{path}/recommendations"), "b", 1, 10)
    return newest.join(page, ["user_id", "run_id"]).select("user_id", "mode", "fingerprint", "article_id", "rank")


@register_open(
    "fill_record",
    f"""SELECT q.slot, q.quota * n AS quota, selected, backfilled, round(coalesce(selected / nullif(q.quota * n, 0), 0), 6) AS fill_rate
    FROM (VALUES {", ".join(f"('{s}', {q})" for s, q in _QUOTA.items())}) q(slot, quota)
    CROSS JOIN (SELECT count(DISTINCT user_id) AS n FROM user_articles)
    LEFT JOIN (SELECT slot, count(*) AS selected, count_if(backfilled) AS backfilled FROM composed GROUP BY 1) USING (slot)""",
    ("composed", "user_articles"),
)
def _(v: Views):
    return rounded(fill_record(run(v)), "fill_rate")


@register_open(
    "slot_fill",
    f"""SELECT u.user_id, q.slot, q.quota, count(c.article_id) AS selected, count_if(coalesce(c.backfilled, false))
      AS backfilled, CASE WHEN q.quota = 0 THEN 0e0 ELSE round(count(c.article_id) / q.quota, 6) END AS fill_rate
    FROM (SELECT DISTINCT user_id FROM user_articles) u
    CROSS JOIN (VALUES {", ".join(f"('{s}', {q})" for s, q in _QUOTA.items())}) q(slot, quota)
    LEFT JOIN composed c ON c.user_id = u.user_id AND c.slot = q.slot GROUP BY 1, 2, 3""",
    ("composed", "user_articles"),
)
def _(v: Views):
    return rounded(run(v).slots, "fill_rate")


@register_open(
    "novelty_distribution",
    f"""SELECT count(*) AS candidate_count, round(min(novelty), 6) AS min_novelty,
      round(quantile_cont(novelty, 0.25), 6) AS p25, round(quantile_cont(novelty, 0.5), 6) AS p50,
      round(quantile_cont(novelty, 0.75), 6) AS p75, round(quantile_cont(novelty, 0.95), 6) AS p95,
      round(max(novelty), 6) AS max_novelty, count_if(novelty >= 1) AS saturated_count,
      count_if(novelty >= 0.7) AS above_threshold_count,
      round(count_if(novelty >= 1) / count(*), 6) AS saturated_ratio FROM scored""",
    ("scored",),
)
def _(v: Views):
    names = ("min_novelty", "p25", "p50", "p75", "p95", "max_novelty", "saturated_ratio")
    return rounded(novelty_distribution(run(v), CFG), *names)


@register_open(
    "threshold_sweep",
    """SELECT t / 10e0 AS threshold, count_if(novelty >= t / 10e0) AS exploration_count,
      count_if(novelty < t / 10e0) AS diversity_count
    FROM range(11) r(t) CROSS JOIN scored WHERE interest_similarity < 0.2 AND NOT is_primary_source GROUP BY 1""",
    ("scored",),
)
def _(v: Views):
    return threshold_sweep(run(v), CFG)


@register_both(
    "rank_correlation",
    """WITH r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2e0 AS rx,
        rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2e0 AS ry
      FROM (SELECT round(novelty, 9) AS x, round(interest_similarity, 9) AS y FROM scored))
    SELECT count(*) AS candidate_count, round(corr(rx, ry), 6) AS correlation FROM r""",
    ("scored",),
)
def _(v: Views, cfg):
    rows = run(v, cfg).spread.select(F.round("novelty", 9).alias("novelty"), F.round("interest_similarity", 9).alias("s"), "n")
    return rounded(G.spearman(rows, "novelty", "s", "n"), "correlation")


@register_open(
    "slot_divergence",
    """SELECT count(*) AS excluded_count, count_if(novelty < 0.7) AS diversity_count,
      round(count_if(novelty < 0.7) / count(*), 6) AS diversity_ratio
    FROM scored WHERE interest_similarity < 0.2 AND NOT is_primary_source""",
    ("scored",),
)
def _(v: Views):
    return rounded(slot_divergence(run(v), CFG), "diversity_ratio")


@register(
    "body_lengths",
    """SELECT count(*) AS article_count, min(n) AS min_length, max(n) AS max_length,
      CAST(round_even(quantile_cont(n, 0.5), 0) AS BIGINT) AS median_length, count_if(n > 12000) AS truncated_count,
      round(count_if(n > 12000) / count(*), 6) AS truncated_ratio, 12000 AS "limit"
    FROM (SELECT length(body) AS n FROM articles)""",
    ("articles",),
)
def _(v: Views):
    return rounded(G.body_length_stats(v.articles, 12000), "truncated_ratio")


@register(
    "latency_stats",
    """WITH kinds AS (SELECT input_length, string_agg(kind || ':' || n, ',' ORDER BY n DESC, kind) AS failure_breakdown
      FROM (SELECT input_length, exception_type AS kind, count(*) AS n FROM operation_logs WHERE NOT ok GROUP BY 1, 2)
      GROUP BY 1)
    SELECT l.input_length, count_if(ok) AS samples, min(CASE WHEN ok THEN seconds END) AS min_seconds,
      max(CASE WHEN ok THEN seconds END) AS max_seconds,
      round(quantile_cont(CASE WHEN ok THEN seconds END, 0.5), 6) AS median_seconds,
      count_if(NOT ok) AS failures, coalesce(any_value(k.failure_breakdown), '') AS failure_breakdown
    FROM operation_logs l LEFT JOIN kinds k USING (input_length) GROUP BY 1""",
    ("operation_logs",),
)
def _(v: Views):
    text = F.array_join(F.transform("failure_breakdown", lambda k: F.concat_ws(":", k["kind"], k["n"])), ",")
    return rounded(G.latency_stats(v.operation_logs), "median_seconds").withColumn("failure_breakdown", text)


@register(
    "agreement",
    """WITH other AS (SELECT article_id AS other_id, (article_id * 7 + 1) % (SELECT count(*) FROM articles) AS article_id
      FROM articles),
    pairs AS (SELECT l.*, r.domain AS rd, r.category AS rc, r.content_type AS rt, r.difficulty AS rf,
        r.topics AS rtop, r.technologies AS rtech, r.technical_quality AS rq
      FROM articles r JOIN other o ON o.other_id = r.article_id JOIN articles l ON l.article_id = o.article_id)
    SELECT count(*) AS compared_count,
      round(count_if(domain IS NOT DISTINCT FROM rd) / count(*), 6) AS domain_match_rate,
      round(count_if(category IS NOT DISTINCT FROM rc) / count(*), 6) AS category_match_rate,
      round(count_if(content_type IS NOT DISTINCT FROM rt) / count(*), 6) AS content_type_match_rate,
      round(count_if(difficulty IS NOT DISTINCT FROM rf) / count(*), 6) AS difficulty_match_rate,
      round(median(CASE WHEN len(list_distinct(list_concat(topics, rtop))) = 0 THEN 1e0 ELSE
        len(list_intersect(topics, rtop)) / len(list_distinct(list_concat(topics, rtop))) END), 6)
        AS topics_jaccard_median,
      round(median(CASE WHEN len(list_distinct(list_concat(technologies, rtech))) = 0 THEN 1e0 ELSE
        len(list_intersect(technologies, rtech)) / len(list_distinct(list_concat(technologies, rtech))) END), 6)
        AS technologies_jaccard_median,
      round(median(abs(technical_quality - rq)), 6) AS quality_difference_median
    FROM pairs""",
    ("articles",),
)
def _(v: Views):
    shifted = v.articles.withColumn("article_id", (F.col("article_id") * 7 + 1) % v.n_docs)
    result = G.analysis_agreement(v.articles, shifted)
    return rounded(result, *[c for c in result.columns if c != "compared_count"])


@register(
    "vector_topk",
    """WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings ORDER BY vec_id LIMIT 1)
    SELECT a.article_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), q.v), 6) AS similarity
    FROM articles a CROSS JOIN q WHERE a.embedding IS NOT NULL AND NOT a.is_dead
    ORDER BY list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), q.v) DESC, a.article_id LIMIT 10""",
    ("articles",),
)
def _(v: Views):
    query = v.table("embeddings").orderBy("vec_id").select("embedding").first()["embedding"]
    return rounded(similar_by_vector(v.articles, query, 10), "similarity")


add_sql_view(
    "article_runs",
    ("user_articles", "articles"),
    """SELECT u.user_id, max(u.article_id) AS source_id FROM user_articles u JOIN articles a USING (article_id)
    WHERE u.origin IN ('manual', 'good') AND a.embedding IS NOT NULL GROUP BY 1""",
)


@register_both(
    "related_articles",
    f"""WITH ranked AS (SELECT r.user_id, r.source_id, p.article_id, p.place FROM article_runs r CROSS JOIN pool p
      WHERE p.article_id <> r.source_id AND NOT EXISTS (SELECT 1 FROM excluded x
        WHERE x.user_id = r.user_id AND x.article_id = p.article_id)),
    chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY place) AS k FROM ranked)
      WHERE k <= 500),
    embedded AS (SELECT c.user_id, c.article_id FROM chosen c JOIN articles a USING (article_id)
      WHERE a.embedding IS NOT NULL),
    near AS (SELECT x.user_id, x.article_id, max(p.s) AS s FROM embedded x
      JOIN embedded y ON y.user_id = x.user_id AND y.article_id <> x.article_id
      JOIN pair_cosine p ON p.a = x.article_id AND p.b = y.article_id GROUP BY 1, 2),
    f AS (SELECT c.user_id, c.article_id, coalesce(p.s, 0e0) AS sim, a.source_authority AS auth,
        m.source_article_match AS match, a.technical_quality AS quality, a.duplicate_penalty AS dup,
        CASE WHEN coalesce(a.published_at, a.fetched_at) >= TIMESTAMP '{NOW}' THEN 1e0 ELSE greatest(0e0,
          1e0 - (epoch_us(TIMESTAMP '{NOW}') - epoch_us(coalesce(a.published_at, a.fetched_at))) / 86400e6 / 60e0) END
          AS fresh,
        CASE WHEN a.embedding IS NULL THEN 0.5e0 ELSE least(greatest(least(1e0 - p.s, 1e0), 0e0),
          greatest(least(1e0 - coalesce(n.s, -1e0), 1e0), 0e0)) END AS novelty,
        least(1.5e0, greatest(0.5e0, 1e0 + 0.15e0 * coalesce(s.effective_weight, 0e0))) AS pref,
        CASE WHEN coalesce(u.origin, '') IN ('read_full', 'clicked') THEN 0.3e0 ELSE 0e0 END AS seen
      FROM chosen c JOIN articles a USING (article_id)
      LEFT JOIN pair_cosine p ON p.a = c.article_id AND p.b = c.source_id
      LEFT JOIN near n ON n.user_id = c.user_id AND n.article_id = c.article_id
      LEFT JOIN matches m ON m.article_id = c.article_id
      LEFT JOIN source_pref s ON s.user_id = c.user_id AND s.source_domain = a.source_domain
      LEFT JOIN user_articles u ON u.user_id = c.user_id AND u.article_id = c.article_id),
    t AS (SELECT user_id, article_id, round(sim * 0.35e0 + auth * 0.3e0 * pref * CASE WHEN sim >= 0.35e0 THEN 1e0
        ELSE 0.2e0 + 0.8e0 * greatest(0e0, least(1e0, sim / 0.35e0)) END + match * 0.1e0 + fresh * 0.1e0
        + quality * 0.1e0 + novelty * 0.05e0 - dup - seen, 9) AS total FROM f)
    SELECT user_id AS run_id, article_id, total, CAST(rank AS INT) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY total DESC, CAST(article_id AS VARCHAR)) AS rank FROM t)
    WHERE rank <= 20""",
    ("article_runs", "pool", "excluded", "articles", "pair_cosine", "matches", "source_pref", "user_articles"),
)
def _(v: Views, cfg):
    # Read by every branch below: joined once.
    articles = materialize(v.articles.select(*S.ARTICLE_COLUMNS, "is_dead", "embedding"))
    embedded = articles.filter(F.col("embedding").isNotNull()).select("article_id")
    owned = part_of(v, embedded, "article_id").user_articles.filter(F.col("origin").isin("manual", "good"))
    runs = materialize(
        owned.join(embedded, "article_id")
        .groupBy("user_id")
        .agg(F.max("article_id").alias("article_id"))
        .withColumn("run_id", F.col("user_id"))
    )
    mine = part_of(v, runs.select("user_id"), "user_id")
    tables = replace(inputs(mine), articles=articles)
    related = related_articles(runs, tables, now(), cfg)
    return related.select("run_id", "article_id", "total", "rank")


@register(
    "neighbor_similarity",
    """WITH live AS (SELECT article_id FROM articles WHERE embedding IS NOT NULL AND NOT is_dead)
    SELECT CAST(0 AS BIGINT) AS user_id, p.a AS article_id, round(max(p.s), 6) AS neighbor_similarity
    FROM pair_cosine p JOIN live x ON x.article_id = p.a JOIN live y ON y.article_id = p.b
    WHERE p.a <> p.b GROUP BY 2""",
    ("pair_cosine", "articles"),
)
def _(v: Views):
    """All living articles as one run without a cap: the tiled path."""
    run_rows = v.articles.filter(F.col("embedding").isNotNull() & ~F.col("is_dead"))
    rows = run_rows.select(F.lit(0).cast("long").alias("user_id"), "article_id", "embedding")
    return rounded(neighbor_similarity(rows, replace(CFG, vector_tile_rows=512)), "neighbor_similarity")


@register("interest_clusters")
def _(v: Views):
    """Cluster ids differ between k-means implementations: checked by invariants in the tests."""
    weighted = PR.weighted_interest(v.user_articles, v.article_feedback, v.articles, now(), CFG)
    members = PR.assign_clusters(weighted, CATALOG_CONFIG.clustering)
    clusters = PR.interest_clusters(members, CATALOG_CONFIG.clustering)
    return clusters.select("user_id", "place", "label", F.round("weight", 6).alias("weight"), "article_count")


@register_open(
    "mean_cluster",
    """SELECT user_id, count(*) AS article_count, 1e0 AS weight FROM weighted WHERE embedding IS NOT NULL GROUP BY 1""",
    ("weighted",),
)
def _(v: Views):
    weighted = PR.weighted_interest(v.user_articles, v.article_feedback, v.articles, now(), CFG)
    clusters = PR.interest_clusters(PR.assign_clusters(weighted, CFG.clustering), CFG.clustering)
    sizes = PR.cluster_sizes(weighted.filter(F.col("embedding").isNotNull()), clusters)
    return sizes.join(clusters.select("user_id", "place", F.round("weight", 6).alias("weight")), ["user_id", "place"]).select(
        "user_id", "article_count", "weight"
    )


GROUPS = 4


def _grouped(v: Views):
    """Weighted articles with one unit vector per remainder of the id, of users with twelve articles that show them all.

    Four groups of equal points are what every k-means finds, so SQL can name the clusters.
    """
    group = F.col("article_id") % GROUPS
    vector = F.transform(F.sequence(F.lit(0), F.lit(GROUPS - 1)), lambda i: F.when(i == group, 1.0).otherwise(0.0))
    rows = materialize(PR.weighted_interest(v.user_articles, v.article_feedback, v.articles, now(), CFG).drop("embedding")).withColumn("embedding", vector)
    full = rows.groupBy("user_id").agg(F.count("*").alias("n"), F.count_distinct(group).alias("groups"))
    return materialize(rows.join(full.filter((F.col("n") >= 3 * GROUPS) & (F.col("groups") == GROUPS)).select("user_id"), "user_id", "left_semi"))


_GROUP_SQL = f"""WITH g AS (SELECT *, article_id % {GROUPS} AS g FROM weighted),
    m AS (SELECT * FROM g WHERE user_id IN (SELECT user_id FROM g GROUP BY 1 HAVING count(*) >= {3 * GROUPS} AND count(DISTINCT g) = {GROUPS})),
    t AS (SELECT user_id, g, topic, row_number() OVER (PARTITION BY user_id, g ORDER BY n DESC, topic) AS k
      FROM (SELECT user_id, g, topic, count(*) AS n FROM (SELECT user_id, g, unnest(topics) AS topic FROM m) GROUP BY 1, 2, 3)),
    l AS (SELECT user_id, g, string_agg(topic, ' / ' ORDER BY k) AS label FROM t WHERE k <= 3 GROUP BY 1, 2),
    s AS (SELECT user_id, g, sum(weight) AS w, count(*) AS n FROM m GROUP BY 1, 2)
    SELECT user_id, label, round(w / sum(w) OVER (PARTITION BY user_id), 6) AS weight, n AS article_count,
      CAST(row_number() OVER (PARTITION BY user_id ORDER BY round(w, 9) DESC, label) AS INT) AS place
    FROM s LEFT JOIN l USING (user_id, g)"""


def _group_clusters(v: Views, **settings):
    clustering = replace(DEFAULT.clustering, max_clusters=GROUPS, **settings)
    members = materialize(PR.assign_clusters(_grouped(v), clustering))
    named = PR.interest_clusters(members, clustering)
    label = F.when(F.size("topics") > 0, F.col("label"))
    return named.select("user_id", label.alias("label"), F.round("weight", 6).alias("weight"), "article_count", "place")


@register_open("separated_clusters", _GROUP_SQL, ("weighted",))
def _(v: Views):
    return _group_clusters(v)


@register_open("separated_clusters_all_tasks", _GROUP_SQL, ("weighted",))
def _(v: Views):
    """Every user with more than twenty articles is clustered by all tasks together."""
    return _group_clusters(v, local_rows=20)


@register_open(
    "separated_cluster_sizes",
    f"""WITH g AS (SELECT *, article_id % {GROUPS} AS g FROM weighted),
    m AS (SELECT * FROM g WHERE user_id IN (SELECT user_id FROM g GROUP BY 1 HAVING count(*) >= {3 * GROUPS} AND count(DISTINCT g) = {GROUPS})),
    s AS (SELECT user_id, g, count(*) AS n FROM m GROUP BY 1, 2)
    SELECT user_id, list(n ORDER BY n) AS sizes FROM s GROUP BY 1""",
    ("weighted",),
)
def _(v: Views):
    rows = _grouped(v)
    clusters = PR.interest_clusters(materialize(PR.assign_clusters(rows, replace(DEFAULT.clustering, max_clusters=GROUPS))))
    sizes = PR.cluster_sizes(rows, clusters)
    return sizes.groupBy("user_id").agg(F.array_sort(F.collect_list("article_count")).alias("sizes"))
