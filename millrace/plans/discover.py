"""Feed generation jobs: the personalised feed of many users, and articles related to one article."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.config import DEFAULT, EngineConfig
from millrace.operators import scoring as S
from millrace.operators.compose import COMPOSED_COLUMNS, compose_feed, feed_shortlist, ranked_shortlist, slot_fill
from millrace.operators.distributed import broadcast_if_small, fits_broadcast, ordered_index, top_per_key
from millrace.operators.filters import ArticleFilter, alive, within_age
from millrace.operators.feedback import read_flags
from millrace.operators.fronts import front_best, front_pairs, user_rows
from millrace.operators.neighbors import dominant_widths, pool_similarities, run_neighbors
from millrace.operators.profile import article_profile, build_profiles
from millrace.operators.related import related_candidates, run_constants
from millrace.operators.similarity import profile_features
from millrace.operators.whole_runs import WholeRuns, whole_runs
from millrace.session import materialize


@dataclass(frozen=True)
class FeedInputs:
    """Tables a feed job reads (see ``millrace.schemas``)."""

    articles: DataFrame
    user_articles: DataFrame
    feedback: DataFrame
    registry: DataFrame
    source_preferences: DataFrame


@dataclass(frozen=True)
class FeedRun:
    """Frames of one job, each computed when it is first asked for.

    ``scored``: every candidate with its score; ``chosen``: those of given (user_id, article_id) pairs.
    """

    scored: DataFrame
    chosen: Callable[[DataFrame], DataFrame]
    users: DataFrame
    report: DataFrame
    size: int
    cfg: EngineConfig
    whole: WholeRuns | None = None

    @cached_property
    def ranked(self) -> DataFrame:
        """Scored candidates with their rank among all candidates of the run."""
        if self.whole is not None:
            return self.whole.ranked
        return self.scored if "rank" in self.scored.columns else S.rank_unbounded(materialize(self.scored))

    @property
    def ranks(self) -> DataFrame:
        """(user_id, article_id, rank) of every candidate."""
        return self.ranked.select(*S.PAIR, "rank") if self.whole is None else self.whole.ranks

    @property
    def spread(self) -> DataFrame:
        """(novelty, interest_similarity, n) of all candidates."""
        return self.scored.select("novelty", "interest_similarity", F.lit(1).cast("long").alias("n")) if self.whole is None else self.whole.spread

    @cached_property
    def picks(self) -> DataFrame:
        """The composed feed with its slots and ranks; columns of the score may be missing."""
        if self.whole is not None:
            few = materialize(self.whole.feed_candidates(self.size).select(*S.PAIR, "rank", *COMPOSED_COLUMNS))
            return materialize(compose_feed(few, self.size, self.cfg))
        if "rank" not in self.scored.columns:
            return self.feed
        return materialize(compose_feed(materialize(ranked_shortlist(self.scored, self.size, self.cfg)), self.size, self.cfg))

    @cached_property
    def feed(self) -> DataFrame:
        """The composed feed.  Only candidates that can be picked are ordered: no run is ranked as a whole."""
        if self.whole is not None:
            few = materialize(self.whole.feed_candidates(self.size))
            return materialize(compose_feed(few, self.size, self.cfg).drop("rank"))
        if "rank" in self.scored.columns:
            full = self.chosen(self.picks.select(*S.PAIR))
            more = [c for c in full.columns if c in S.PAIR or c not in self.picks.columns]
            return materialize(self.picks.drop("rank").join(full.select(*more), S.PAIR))
        few = materialize(feed_shortlist(self.scored, self.size, self.cfg))
        return materialize(compose_feed(S.rank(self.chosen(few).drop("rank")), self.size, self.cfg).drop("rank"))

    @cached_property
    def slots(self) -> DataFrame:
        return slot_fill(self.picks, self.users, self.size, self.cfg)


def candidate_pool(
    articles: DataFrame, now: Column, cfg: EngineConfig = DEFAULT, spec: ArticleFilter = ArticleFilter()
) -> DataFrame:
    """Living articles in the age window under the filter (the filter's own age wins)."""
    days = spec.max_age_days if spec.max_age_days is not None else cfg.max_age_days
    return articles.filter(alive() & within_age(now, int(days)) & spec.condition())


# All candidates with their scores, those of given pairs, and the truncation report.
Scored = tuple[DataFrame, Callable[[DataFrame], DataFrame], DataFrame]


def _ranked(
    runs: DataFrame,
    pool: DataFrame,
    excluded: DataFrame,
    profile: DataFrame,
    inputs: FeedInputs,
    now: Column,
    cfg: EngineConfig,
    best: int | None = None,
) -> Scored:
    """``best``: the caller reads no more than so many of a run and the profiles hold no Bad opinions; other rows may be missing."""
    if cfg.max_candidates is None:
        return _ranked_pool(runs, pool, excluded, profile, inputs, now, cfg)
    seen = _ranked_front(runs, pool, excluded, profile, inputs, now, cfg, best) if cfg.max_candidates <= cfg.vector_tile_rows else None
    if seen is not None:
        return seen
    chosen, report = S.select_candidates(runs, pool, excluded, cfg.max_candidates)
    chosen = materialize(chosen)
    # All users meet the same front of the pool: cut the article table to it once.  It has few rows,
    # each needed by very many users, so it is broadcast if its counted size allows.
    ids = chosen.select("article_id").distinct()
    front = materialize(inputs.articles.select(*S.ARTICLE_COLUMNS, "embedding").join(ids, "article_id", "left_semi"))
    size = front.count()
    vectors = chosen.join(broadcast_if_small(front.select("article_id", "embedding"), size), "article_id")
    similarities = profile_features(vectors, profile, cfg, single_block=cfg.max_candidates <= cfg.vector_tile_rows)
    features = S.candidate_features(
        chosen, front, inputs.user_articles, inputs.registry, inputs.source_preferences, similarities, size, cfg.partial_match_score
    )
    # Ranked rows feed several windows and joins: run the Python stage once.
    ranked = materialize(S.rank(S.score(features, now, cfg)))
    return ranked, lambda pairs: ranked.join(pairs, S.PAIR, "left_semi"), report


def _ranked_front(
    runs: DataFrame,
    pool: DataFrame,
    excluded: DataFrame,
    profile: DataFrame,
    inputs: FeedInputs,
    now: Column,
    cfg: EngineConfig,
    best: int | None = None,
) -> Scored | None:
    """Runs with a cap that one task can hold; nothing if the part of the pool that they reach is too large to broadcast."""
    runs = materialize(runs.select("user_id").distinct())  # ids, read by every branch below
    ranked = ordered_index(pool.select("article_id", "published_at"), *S.candidate_order(), name="place").select("article_id", "place")
    total, limit = ranked.count(), cfg.max_candidates
    hidden = materialize(excluded.join(runs, "user_id", "left_semi").join(ranked, "article_id").select("user_id", "place").distinct())
    counts = hidden.groupBy("user_id").agg(F.count("*").alias("hidden"))
    longest = min(total, limit + (counts.agg(F.max("hidden")).first()[0] or 0))
    places = ranked.filter(F.col("place") < longest)
    front = materialize(pool.select(*S.ARTICLE_COLUMNS, "embedding").join(F.broadcast(places) if longest <= S.BLOCK_PLACES else places, "article_id"))
    if not fits_broadcast(front, longest):
        return None
    known = materialize(S.article_features(front, inputs.registry, cfg.partial_match_score).join(front.select("article_id", "place", "embedding"), "article_id"))
    near = F.broadcast(front.select("article_id", "place"))
    # Few of the opened articles are in the front: these are found before anything is shuffled.
    opened = read_flags(inputs.user_articles.join(near, "article_id", "left_semi")).join(runs, "user_id", "left_semi").join(near, "article_id")
    domains = F.broadcast(front.select("source_domain").distinct())
    liked = inputs.source_preferences.join(runs, "user_id", "left_semi").join(domains, "source_domain", "left_semi")
    rows = user_rows(runs, hidden, profile.join(runs, "user_id", "left_semi"), opened, liked)
    if best is None:
        pairs = front_pairs(rows, known, total, limit, cfg)
    else:
        pairs = front_best(rows, materialize(run_constants(known, now, cfg)), limit, best, cfg)
    scored = S.rank(S.score(pairs, now, cfg))
    left = F.lit(total) - F.coalesce("hidden", F.lit(0))
    report = runs.join(counts, "user_id", "left").select(
        "user_id", left.cast("long").alias("eligible"), F.greatest(left - F.lit(limit), F.lit(0)).cast("long").alias("truncated")
    )
    return scored, lambda pairs: scored.join(pairs, S.PAIR, "left_semi"), report


def _ranked_pool(
    runs: DataFrame,
    pool: DataFrame,
    excluded: DataFrame,
    profile: DataFrame,
    inputs: FeedInputs,
    now: Column,
    cfg: EngineConfig,
) -> Scored:
    """Every run ranks the whole pool but what it excludes: neighbours are looked up in the pool's lists."""
    front = materialize(pool.select(*S.ARTICLE_COLUMNS, "embedding"))
    chosen, report = S.select_candidates(runs, front, excluded, None, positions=False)
    hidden = excluded.join(runs, "user_id", "left_semi")
    attach = pool_similarities(front, hidden, profile, runs, cfg, keep=True)
    size = front.count()

    def scored(pairs: DataFrame) -> DataFrame:
        features = S.candidate_features(
            attach(pairs), front, inputs.user_articles, inputs.registry, inputs.source_preferences, article_rows=size, partial=cfg.partial_match_score
        )
        return S.score(features, now, cfg)

    none = F.lit(None).cast("int").alias("candidate_position")
    return scored(chosen), lambda pairs: scored(pairs.select(*S.PAIR, none)), report


def discover_feed(
    users: DataFrame,
    inputs: FeedInputs,
    now: Column,
    cfg: EngineConfig = DEFAULT,
    spec: ArticleFilter = ArticleFilter(),
    size: int | None = None,
) -> FeedRun:
    """Personalised feed for every row of ``users`` (user_id)."""
    users = users.select("user_id").distinct()
    mine = [
        df.join(users, "user_id", "left_semi") for df in (inputs.user_articles, inputs.feedback)
    ]
    profile = build_profiles(mine[0], mine[1], inputs.articles, now, cfg)
    excluded = S.exclusions(mine[1], mine[0])
    pool = candidate_pool(inputs.articles, now, cfg, spec)
    if cfg.max_candidates is None:
        front = materialize(pool.select(*S.ARTICLE_COLUMNS, "embedding"))
        whole = whole_runs(users, front, excluded, profile, read_flags(mine[0]), inputs.source_preferences, inputs.registry, now, cfg)
        if whole is not None:
            left = F.lit(front.count()) - F.size("hidden")
            report = whole.rows.select("user_id", left.cast("long").alias("eligible"), F.lit(0).cast("long").alias("truncated"))
            return FeedRun(whole.scored, lambda pairs: whole.scored.join(pairs, S.PAIR, "left_semi"), users, report, size or cfg.feed_size, cfg, whole)
    scored, chosen, report = _ranked(users, pool, excluded, profile, inputs, now, cfg)
    return FeedRun(scored, chosen, users, report, size or cfg.feed_size, cfg)


def related_articles(
    runs: DataFrame, inputs: FeedInputs, now: Column, cfg: EngineConfig = DEFAULT, size: int | None = None
) -> DataFrame:
    """Best articles for each source article; ``runs``: (run_id, user_id, article_id).

    The source vector is the whole profile; Bad opinions do not take part, there is no composition.
    """
    runs = materialize(runs.select("run_id", "user_id", "article_id"))  # read by every branch below
    sources = runs.join(inputs.articles.select("article_id", "embedding"), "article_id")
    profile = article_profile(sources.select(F.col("run_id").alias("user_id"), "article_id", "embedding"))

    def per_run(df: DataFrame, *columns: str) -> DataFrame:
        joined = df.join(runs.select("run_id", "user_id"), "user_id")
        return joined.select(F.col("run_id").alias("user_id"), *columns)

    # Users without a run leave before anything is grouped.
    users = runs.select("user_id").distinct()
    mine = [df.join(users, "user_id", "left_semi") for df in (inputs.feedback, inputs.user_articles)]
    personal = S.exclusions(*mine)
    itself = runs.select(F.col("run_id").alias("user_id"), "article_id")
    excluded = per_run(personal, "article_id").union(itself).distinct()
    shifted = FeedInputs(
        inputs.articles,
        per_run(inputs.user_articles, "article_id", "origin"),
        per_run(inputs.feedback, "article_id", "action", "created_at"),
        inputs.registry,
        per_run(inputs.source_preferences, "source_domain", "effective_weight"),
    )
    run_keys = runs.select(F.col("run_id").alias("user_id"))
    pool = candidate_pool(inputs.articles, now, cfg)
    size = size or cfg.related_size
    if cfg.max_candidates is None:
        scored = _related_pool(run_keys, profile, pool, excluded, shifted, now, cfg, size)
    else:
        scored, _, _ = _ranked(run_keys, pool, excluded, profile, shifted, now, cfg, size)
    best = top_per_key(scored.drop("rank"), ["user_id"], S.rank_order(), size, "rank")
    return best.withColumnRenamed("user_id", "run_id")


def _related_pool(
    runs: DataFrame,
    profile: DataFrame,
    pool: DataFrame,
    excluded: DataFrame,
    inputs: FeedInputs,
    now: Column,
    cfg: EngineConfig,
    size: int,
) -> DataFrame:
    """Scores of all articles that can be among the best ``size`` of a run over the whole pool.  No run meets the pool row by row."""
    front = materialize(pool.select(*S.ARTICLE_COLUMNS, "embedding"))
    rows = front.count()
    vectors = front.filter(F.col("embedding").isNotNull()).select("article_id", "embedding")
    hidden = materialize(excluded.join(runs, "user_id", "left_semi").join(front.select("article_id"), "article_id", "left_semi").select(*S.PAIR))
    usual, special = run_neighbors(vectors, hidden.join(vectors.select("article_id"), "article_id", "left_semi"), cfg.vector_tile_rows)
    width, widths = dominant_widths(vectors, hidden, runs)
    alone = run_constants(S.article_features(front, inputs.registry, cfg.partial_match_score), now, cfg)
    known = alone.select("article_id", "source_domain", "fixed", "authority").join(vectors, "article_id", "left").join(usual, "article_id", "left")

    def listed(df: DataFrame, value: Column | str, name: str) -> DataFrame:
        return df.groupBy("user_id").agg(F.collect_list(value).alias(name))

    lists = {
        "hidden": listed(hidden, "article_id", "hidden"),
        "opened": listed(read_flags(inputs.user_articles), "article_id", "opened"),
        "liked": listed(inputs.source_preferences, F.struct(F.col("source_domain").alias("domain"), F.col("effective_weight").alias("weight")), "liked"),
        "moved": listed(special, F.struct("article_id", "near"), "moved"),
    }
    own = profile.filter(F.col("kind") == "interest").select("user_id", "vector")
    all_runs = runs.join(own, "user_id", "left").withColumn("vector", F.coalesce("vector", F.array().cast("array<double>")))
    all_runs = all_runs.withColumn("width", F.lit(width).cast("int")) if widths is None else all_runs.join(widths, "user_id", "left")
    for name, lacking in lists.items():
        all_runs = all_runs.join(lacking, "user_id", "left").withColumn(name, F.coalesce(name, F.array().cast(lacking.schema[name].dataType)))
    few = materialize(related_candidates(materialize(all_runs), materialize(known), size, cfg))
    few = few.withColumns({"candidate_position": F.lit(None).cast("int"), "bad_similarity": F.lit(None).cast("double")})
    features = S.candidate_features(
        few, front, inputs.user_articles, inputs.registry, inputs.source_preferences, article_rows=rows, partial=cfg.partial_match_score
    )
    return S.score(features, now, cfg)
