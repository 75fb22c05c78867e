"""Candidate selection, scoring and ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.config import DEFAULT, EngineConfig, OWNED_ORIGINS, REASON_CLOSING, REASON_PHRASES
from millrace.functions.weights import (
    authority_gate,
    bad_similarity_penalty,
    clamp,
    freshness,
    source_preference_factor,
)
from millrace.operators.distributed import broadcast_if_small, ordered_index, rank_per_key
from millrace.operators.feedback import read_flags
from millrace.session import materialize

PAIR = ["user_id", "article_id"]
ARTICLE_COLUMNS = (
    "article_id",
    "source_domain",
    "topics",
    "technologies",
    "source_authority",
    "is_primary_source",
    "technical_quality",
    "published_at",
    "fetched_at",
    "duplicate_penalty",
)


def exclusions(feedback: DataFrame, user_articles: DataFrame) -> DataFrame:
    """Pairs a user must not be shown: opinions Bad, or articles already owned."""
    bad = feedback.filter(F.col("action") == "bad").select(*PAIR)
    owned = user_articles.filter(F.col("origin").isin(*OWNED_ORIGINS)).select(*PAIR)
    return bad.union(owned).distinct()


def candidate_order() -> list[Column]:
    """Raw publication date, unknown last, then id."""
    return [F.col("published_at").desc_nulls_last(), F.col("article_id").asc()]


BLOCK_PLACES = 4096  # of the pool's order, in one row
ROWS_A_TASK = 2_000_000  # pairs that one task writes


def select_candidates(
    users: DataFrame, pool: DataFrame, excluded: DataFrame, limit: int | None, positions: bool = True
) -> tuple[DataFrame, DataFrame]:
    """First ``limit`` pool articles of each user in candidate order, and the truncation report.

    The pool is ranked once and packed in blocks.  What a user sees are the gaps between their hidden places, so a
    candidate's position is its place less the hidden ones before it: pairs are written out of gaps and blocks, and are
    neither sorted, nor shuffled, nor joined.  A user's row holds their hidden places.  ``None`` keeps the whole pool of every
    user; without ``positions`` its rows are not numbered.
    """
    ranked = ordered_index(pool.select("article_id", "published_at"), *candidate_order(), name="place")
    total = ranked.count()
    hidden = excluded.join(users, "user_id", "left_semi").join(ranked.select("article_id", "place"), "article_id")
    places = hidden.groupBy("user_id").agg(F.array_sort(F.collect_set("place")).alias("hidden"))
    per_user = materialize(
        users.join(places, "user_id", "left").select("user_id", F.coalesce("hidden", F.array().cast("array<long>")).alias("hidden"))
    )
    bound = total if limit is None else limit
    reach = F.least(F.lit(bound) + F.size("hidden"), F.lit(total))
    # Nobody looks further than the longest reach.
    longest, pairs = per_user.agg(F.max(reach), F.sum(reach)).first()
    block = F.floor(F.col("place") / F.lit(BLOCK_PLACES))
    blocks = (
        ranked.filter(F.col("place") < (longest or 0))
        .groupBy(block.alias("block"))
        .agg(F.array_sort(F.collect_list(F.struct("place", "article_id"))).alias("rows"))
        .select("block", F.col("rows.article_id").alias("ids"))
    )
    blocks = broadcast_if_small(blocks, -(-(longest or 0) // BLOCK_PLACES))
    gaps = F.transform(
        F.concat("hidden", F.array(F.lit(total).cast("long"))),
        lambda place, i: F.struct(
            F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get("hidden", i - 1) + 1).alias("start"),
            F.least(place, F.lit(bound).cast("long") + i).alias("end"),
            i.alias("skipped"),
        ),
    )
    open_gaps = per_user.select("user_id", F.explode(F.filter(gaps, lambda g: g["start"] < g["end"])).alias("g")).select("user_id", "g.*")
    block_of = [F.floor(c / F.lit(BLOCK_PLACES)) for c in (F.col("start"), F.col("end") - 1)]
    pieces = (
        open_gaps.withColumn("block", F.explode(F.sequence(*block_of)))
        .withColumn("base", F.col("block") * BLOCK_PLACES)
        .select("user_id", "block", "base", "skipped", F.greatest("start", "base").alias("start"), F.least("end", F.col("base") + BLOCK_PLACES).alias("end"))
        # Few bytes become very many pairs: their number decides the tasks.
        .repartition(max(1, -(-(pairs or 0) // ROWS_A_TASK)), "user_id", "block")
    )
    part = F.slice("ids", (F.col("start") - F.col("base") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    visible = pieces.join(blocks, "block").select("user_id", "start", "skipped", F.posexplode(part).alias("i", "article_id"))
    position = (F.col("start") + F.col("i") + 1 - F.col("skipped")).cast("int")
    if limit is None and not positions:
        position = F.lit(None).cast("int")
    report = per_user.select(
        "user_id",
        (F.lit(total) - F.size("hidden")).cast("long").alias("eligible"),
        F.greatest(F.lit(total) - F.size("hidden") - F.lit(bound), F.lit(0)).cast("long").alias("truncated"),
    )
    return visible.select(*PAIR, position.alias("candidate_position")), report


def entity_names(registry: DataFrame) -> DataFrame:
    """Entity and organisation names per exact domain."""
    names = registry.select("domain", F.explode(F.array("entity_name", "github_org")).alias("name"))
    return (
        names.filter(F.col("name").isNotNull())
        .groupBy(F.col("domain").alias("source_domain"))
        .agg(F.sort_array(F.collect_set("name")).alias("entity_names"))
    )


def source_topic_match(names: Column, tags: Column, partial: float) -> Column:
    """1.0 if a source name equals a tag, ``partial`` if one contains the other, else 0.0."""

    def clean(values: Column) -> Column:
        texts = F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda s: F.lower(F.trim(s)))
        return F.filter(texts, lambda s: F.length(s) > 0)

    names, tags = clean(names), clean(tags)
    equal = F.arrays_overlap(names, tags)
    contained = F.exists(names, lambda n: F.exists(tags, lambda t: F.contains(n, t) | F.contains(t, n)))
    return F.when(equal, 1.0).when(contained, float(partial)).otherwise(0.0)


def article_features(articles: DataFrame, registry: DataFrame, partial: float = DEFAULT.partial_match_score) -> DataFrame:
    """What the score needs of an article alone."""
    match = source_topic_match(F.col("entity_names"), F.concat("topics", "technologies"), partial)
    narrow = articles.select(*ARTICLE_COLUMNS).join(entity_names(registry), "source_domain", "left")
    return narrow.withColumn("source_article_match", match).drop("entity_names", "topics", "technologies")


def candidate_features(
    chosen: DataFrame,
    articles: DataFrame,
    user_articles: DataFrame,
    registry: DataFrame,
    preferences: DataFrame,
    similarities: DataFrame | None = None,
    article_rows: int | None = None,
    partial: float = DEFAULT.partial_match_score,
) -> DataFrame:
    """Join every input of the score to the chosen (user, article) pairs.

    ``similarities``: their similarity columns, unless ``chosen`` carries these already.
    The match of source and tags belongs to the article: it is computed before articles meet users, and its arrays stay behind.
    ``article_rows``: counted size of ``articles``, if the caller knows it to be small.
    """
    narrow = article_features(articles, registry, partial)
    if article_rows is not None:
        narrow = broadcast_if_small(narrow, article_rows)
    liking = preferences.select("user_id", "source_domain", F.col("effective_weight").alias("source_preference"))
    seen = read_flags(user_articles).withColumn("is_read", F.lit(True))
    rows = chosen if similarities is None else chosen.join(similarities, PAIR, "left")
    return (
        rows.join(narrow, "article_id")
        .join(liking, ["user_id", "source_domain"], "left")
        .join(seen, PAIR, "left")
        .withColumns(
            {
                "source_preference": F.coalesce("source_preference", F.lit(0.0)),
                "is_read": F.coalesce("is_read", F.lit(False)),
                "is_bad": F.lit(False),
                "has_vector": F.col("interest_similarity").isNotNull(),
                "interest_similarity": F.coalesce("interest_similarity", F.lit(0.0)),
            }
        )
    )


COMPONENTS = tuple(REASON_PHRASES)


def score(features: DataFrame, now: Column, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Full breakdown and total.  Column expressions only: one projection, one codegen stage."""
    own = clamp(F.lit(1.0) - F.col("centroid_similarity"))
    near = clamp(F.lit(1.0) - F.col("neighbor_similarity"))
    measured = F.when(F.col("neighbor_similarity").isNull(), own).otherwise(F.least(own, near))
    novelty = F.when(F.col("centroid_similarity").isNull(), cfg.novelty_default).otherwise(measured)
    base = features.withColumns(
        {
            "source_authority": clamp(F.col("source_authority")),
            "technical_quality": clamp(F.col("technical_quality")),
            "freshness": freshness(now, F.coalesce("published_at", "fetched_at"), cfg.max_age_days),
            "novelty": novelty,
            "authority_gate_factor": authority_gate(F.col("interest_similarity"), cfg),
            "source_preference_factor": source_preference_factor(F.col("source_preference"), cfg),
            "bad_penalty": F.when(F.col("is_bad"), cfg.bad_penalty).otherwise(0.0),
            "read_penalty": F.when(F.col("is_read"), cfg.read_penalty).otherwise(0.0),
            "bad_similarity_penalty": bad_similarity_penalty(F.col("bad_similarity"), cfg),
        }
    )
    parts = {}
    for name in COMPONENTS:
        part = F.col(name) * F.lit(getattr(cfg.weights, name))
        if name == "source_authority":
            part = part * F.col("authority_gate_factor") * F.col("source_preference_factor")
        parts[f"{name}_contribution"] = part
    scored = base.withColumns(parts)
    gains = sum((F.col(f"{n}_contribution") for n in COMPONENTS[1:]), F.col(f"{COMPONENTS[0]}_contribution"))
    losses = ("bad_penalty", "duplicate_penalty", "read_penalty", "bad_similarity_penalty")
    total = gains
    for name in losses:
        total = total - F.col(name)
    # Nine places: tasks may add in different orders, ranks must not depend on the last bits.
    return scored.withColumn("total", F.round(total, 9))


def rank_order() -> list[Column]:
    """Total descending, then the id in text order."""
    return [F.col("total").desc(), F.col("article_id").cast("string").asc()]


def rank(scored: DataFrame, name: str = "rank") -> DataFrame:
    """Rank inside each run.  Only for runs bounded by a candidate cap (``max_candidates``)."""
    return scored.withColumn(name, F.row_number().over(Window.partitionBy("user_id").orderBy(*rank_order())))


def rank_unbounded(scored: DataFrame, name: str = "rank") -> DataFrame:
    """Rank inside each run when runs have no cap: global order, then offset of the run."""
    return rank_per_key(scored, ["user_id"], rank_order(), name)


def reason_summary() -> Column:
    """Sentence naming the two largest contributions; declaration order decides ties."""
    entries = [
        F.struct(
            F.negate(F.col(f"{name}_contribution")).alias("key"),
            F.lit(i).alias("place"),
            F.lit(REASON_PHRASES[name][0]).alias("joined"),
            F.lit(REASON_PHRASES[name][1]).alias("closing"),
        )
        for i, name in enumerate(COMPONENTS)
    ]
    top = F.array_sort(F.array(*entries))
    return F.concat(top[0]["joined"], F.lit("、"), top[1]["closing"], F.lit(REASON_CLOSING))


REASON_FIELDS = (
    *COMPONENTS,
    "authority_gate_factor",
    "source_preference_factor",
    *[f"{n}_contribution" for n in COMPONENTS],
    "bad_penalty",
    "duplicate_penalty",
    "read_penalty",
    "bad_similarity_penalty",
    "total",
)


def with_reasons(scored: DataFrame) -> DataFrame:
    """Pack the breakdown and its summary sentence into the ``reasons`` struct."""
    fields = [F.col(name).alias(name) for name in REASON_FIELDS]
    return scored.withColumn("reasons", F.struct(*fields, reason_summary().alias("summary")))
