"""Similarity of candidates to a profile and to each other, and vector search.

Candidates of a run are cut into blocks of bounded size; the profile rows of the run (its
whole history unless profile cuts are set) go to each of its blocks.  One task multiplies one block, so memory per
task grows with one history only, and a run with very many candidates is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.config import DEFAULT, EngineConfig
from millrace.functions.vectors import cosine_matrix, cosine_to, unit_rows
from millrace.operators.distributed import part_count

ROWS_AT_ONCE, COLUMNS_AT_ONCE = 256, 8192  # of a pair of parts

FEATURES = (
    "user_id long, article_id long, interest_similarity double, bad_similarity double, "
    "centroid_similarity double, neighbor_similarity double"
)


def _weighted_top(similarities: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """Weighted mean of the k largest similarities per row; earlier profile rows win ties."""
    order = np.argsort(-similarities, axis=1, kind="stable")[:, :k]
    top = np.take_along_axis(similarities, order, axis=1)
    weight = weights[order]
    total = weight.sum(axis=1)
    plain = top.mean(axis=1)
    return np.where(total == 0, plain, (top * weight).sum(axis=1) / np.where(total == 0, 1.0, total))


def _block_features(vectors: list, profile: pd.DataFrame, top_k: int) -> dict[str, np.ndarray]:
    kinds = {kind: part.sort_values("position") for kind, part in profile.groupby("kind")}
    n = len(vectors)
    interest, bad, centroid = np.zeros(n), np.full(n, np.nan), np.full(n, np.nan)
    if "interest" in kinds:
        part = kinds["interest"]
        interest = _weighted_top(cosine_matrix(vectors, list(part["vector"])), part["weight"].to_numpy(), top_k)
    if "bad" in kinds:
        bad = cosine_matrix(vectors, list(kinds["bad"]["vector"])).max(axis=1)
    if "centroid" in kinds:
        centroid = cosine_matrix(vectors, list(kinds["centroid"]["vector"])).max(axis=1)
    return {"interest_similarity": interest, "bad_similarity": bad, "centroid_similarity": centroid}


def _neighbors(vectors: list) -> np.ndarray:
    """Largest cosine to another member of the same block."""
    sims = cosine_matrix(vectors, vectors)
    np.fill_diagonal(sims, -np.inf)
    return sims.max(axis=1)


def profile_features(
    candidates: DataFrame, profile: DataFrame, cfg: EngineConfig = DEFAULT, single_block: bool = False
) -> DataFrame:
    """Interest, Bad, centroid and neighbour similarity of candidates that carry a vector.

    ``candidates``: (user_id, article_id, embedding); user_id is the run key.  ``single_block``
    says the caller has cut every run below the tile size, so neighbours are found in the same pass
    and the data is shuffled once.  Otherwise blocks are formed here and neighbours come from
    :func:`neighbor_similarity`.
    """
    embedded = candidates.filter(F.col("embedding").isNotNull()).select("user_id", "article_id", "embedding")
    if single_block:
        left = _dominant_width(embedded).withColumn("block", F.lit(0))
        right = profile.withColumn("block", F.lit(0))
    else:
        tile = cfg.vector_tile_rows
        runs = embedded.groupBy("user_id").agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("blocks"))
        left = (
            embedded.join(runs, "user_id")
            .withColumn("block", F.pmod(F.xxhash64("article_id"), F.col("blocks")).cast("int"))
            .withColumn("comparable", F.lit(False))
            .drop("blocks")
        )
        right = (
            profile.join(runs, "user_id")
            .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .drop("blocks")
        )

    top_k = cfg.top_k

    def run(cands: pd.DataFrame, prof: pd.DataFrame) -> pd.DataFrame:
        if not len(cands):
            return pd.DataFrame(columns=[c.split()[0] for c in FEATURES.split(", ")])
        vectors = list(cands["embedding"])
        out = {"user_id": cands["user_id"].to_numpy(), "article_id": cands["article_id"].to_numpy()}
        out.update(_block_features(vectors, prof, top_k))
        neighbor = np.full(len(vectors), np.nan)
        chosen = np.flatnonzero(cands["comparable"].to_numpy())
        if len(chosen) > 1:
            neighbor[chosen] = _neighbors([vectors[i] for i in chosen])
        out["neighbor_similarity"] = neighbor
        return pd.DataFrame(out)

    keys = ["user_id", "block"]
    features = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, FEATURES)
    names = ["interest_similarity", "bad_similarity", "centroid_similarity", "neighbor_similarity"]
    features = features.select(
        "user_id", "article_id", *[F.when(~F.isnan(n), F.col(n)).alias(n) for n in names]
    )
    if single_block:
        return features
    near = neighbor_similarity(embedded, cfg)
    return features.drop("neighbor_similarity").join(near, ["user_id", "article_id"], "left")


def _dominant_width(embedded: DataFrame) -> DataFrame:
    """Flag the vectors of the most common length per run; the others have no neighbours."""
    widths = embedded.groupBy("user_id", F.size("embedding").alias("width")).agg(F.count("*").alias("n"))
    common = widths.groupBy("user_id").agg(F.max_by("width", F.struct("n", F.negate("width"))).alias("width"))
    return (
        embedded.join(common, "user_id")
        .withColumn("comparable", F.size("embedding") == F.col("width"))
        .drop("width")
    )


def neighbor_tiles(rows: DataFrame, tile: int) -> DataFrame:
    """``rows`` (user_id, article_id, embedding) once for every pair of parts (low, high) of its run that it is in."""
    size = F.max(F.size("embedding")) * F.lit(4)
    runs = rows.groupBy("user_id").agg(part_count(F.count("*"), size, tile).alias("blocks"))
    block = F.pmod(F.xxhash64("article_id"), F.col("blocks")).cast("int")
    return (
        rows.join(runs, "user_id")
        .withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
        .drop("blocks", "other")
    )


def neighbor_similarity(embedded: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Largest cosine of each candidate to another candidate of its run, for runs of any size.

    Runs are cut into a bounded number of parts; a task multiplies one pair of parts, some rows at a time, and returns
    one maximum per row, so no pair ever leaves a task.
    """
    tiles = neighbor_tiles(_dominant_width(embedded).filter("comparable").drop("comparable"), cfg.vector_tile_rows)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        matrix = unit_rows(np.stack(frame["embedding"].to_numpy()).astype(np.float64))
        low = (frame["block"] == frame["low"]).to_numpy()
        inside = frame["low"].iloc[0] == frame["high"].iloc[0]
        rows = np.flatnonzero(low)
        others = rows if inside else np.flatnonzero(~low)
        best = np.full(len(frame), -np.inf)
        for start in range(0, len(rows), ROWS_AT_ONCE):
            x = rows[start : start + ROWS_AT_ONCE]
            for first in range(0, len(others), COLUMNS_AT_ONCE):
                y = others[first : first + COLUMNS_AT_ONCE]
                sims = matrix[x] @ matrix[y].T
                if inside:
                    sims[x[:, None] == y[None, :]] = -np.inf
                best[x] = np.maximum(best[x], sims.max(axis=1))
                if not inside:
                    best[y] = np.maximum(best[y], sims.max(axis=0))
        return pd.DataFrame(
            {"user_id": frame["user_id"], "article_id": frame["article_id"], "neighbor_similarity": best}
        )

    maxima = tiles.groupBy("user_id", "low", "high").applyInPandas(
        run, "user_id long, article_id long, neighbor_similarity double"
    )
    best = maxima.groupBy("user_id", "article_id").agg(F.max("neighbor_similarity").alias("neighbor_similarity"))
    return best.filter(F.col("neighbor_similarity") > float("-inf"))


def similar_by_vector(
    articles: DataFrame, query: Sequence[float], limit: int = 10, exclude: Sequence[int] = ()
) -> DataFrame:
    """Nearest living articles to one vector: an Arrow scan and a per-task top-k heap."""
    rows = articles.filter(F.col("embedding").isNotNull() & ~F.col("is_dead")).select("article_id", "embedding")
    if exclude:
        rows = rows.filter(~F.col("article_id").isin(list(exclude)))
    scored = rows.select("article_id", cosine_to(query)("embedding").alias("similarity"))
    return scored.orderBy(F.desc("similarity"), "article_id").limit(limit)


def similar_to_article(articles: DataFrame, article_id: int, limit: int = 10) -> DataFrame:
    """Nearest articles to a stored article, without itself; no rows if it has no vector."""
    row = articles.filter(F.col("article_id") == article_id).select("embedding").first()
    if row is None or row["embedding"] is None:
        return articles.select("article_id", F.lit(0.0).alias("similarity")).limit(0)
    return similar_by_vector(articles, row["embedding"], limit, [article_id])
