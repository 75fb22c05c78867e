"""k-means of users whose articles do not fit one task.

Seeding is k-means|| (Bahmani et al. 2012): a few passes draw candidates with odds in proportion to their squared distance to
those already drawn, every point counts for its nearest candidate, and the few weighted candidates are clustered by seeded
k-means++.  Lloyd's steps are aggregates: a task adds up counts and vectors per (user, cluster), and only these sums are
shuffled.  Draws depend on hashes of user and article, so a repeated task draws the same points.  All passes serve
as many users as have ``CENTRE_BYTES`` of centres, which are broadcast: at most k vectors a user and a few dozen candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.config import Clustering
from millrace.session import materialize

CENTRE_BYTES = 16 << 20
ROUNDS = 5
OVERSAMPLING = 2  # candidates drawn per round, as a multiple of k
STILL = 1e-9


def squared_gaps(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances through one matrix product."""
    norms = (points**2).sum(1)[:, None] + (centers**2).sum(1)[None, :]
    return np.maximum(norms - 2.0 * points @ centers.T, 0.0)


def weighted_lloyd(points: np.ndarray, weights: np.ndarray, k: int, settings: Clustering) -> np.ndarray:
    """Centres of a small weighted point set: the best of several seeded k-means++ runs."""
    rng, best = np.random.default_rng(settings.seed), None
    for _ in range(settings.restarts if k > 1 else 1):
        centers = points[[rng.choice(len(points), p=weights / weights.sum())]]
        while len(centers) < k:
            odds = squared_gaps(points, centers).min(1) * weights
            centers = np.vstack([centers, points[rng.choice(len(points), p=odds / odds.sum()) if odds.sum() > 0 else rng.integers(len(points))]])
        for _ in range(settings.max_iterations):
            labels = squared_gaps(points, centers).argmin(1)
            member = np.zeros((k, len(points)))
            member[labels, np.arange(len(points))] = weights
            mass = member.sum(1)
            moved = np.where(mass[:, None] > 0, member @ points / np.where(mass > 0, mass, 1.0)[:, None], centers)
            if np.abs(moved - centers).max() <= STILL:
                break
            centers = moved
        inertia = (squared_gaps(points, centers).min(1) * weights).sum()
        if best is None or inertia < best[0] - 1e-12:
            best = (inertia, centers)
    return best[1]


def _batches(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[int, pd.DataFrame, np.ndarray]]:
    for frame in frames:
        for user, part in frame.groupby("user_id", sort=False):
            yield int(user), part, np.array(part["embedding"].tolist(), dtype=np.float64)


def _draws(vectors: DataFrame, chosen: dict[int, np.ndarray], counts: dict[int, int], turn: int, seed: int) -> dict[int, np.ndarray]:
    """Rows of one round of k-means||, about ``OVERSAMPLING * k`` a user."""
    shared = vectors.sparkSession.sparkContext.broadcast(chosen)

    def gaps(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for user, part, points in _batches(frames):
            yield pd.DataFrame({"user_id": part["user_id"], "article_id": part["article_id"], "gap": squared_gaps(points, shared.value[user]).min(1)})

    measured = materialize(vectors.mapInPandas(gaps, "user_id long, article_id long, gap double"))
    rates = measured.groupBy("user_id").agg(F.sum("gap").alias("cost"))
    wanted = vectors.sparkSession.createDataFrame([(user, float(OVERSAMPLING * k)) for user, k in counts.items()], "user_id long, wanted double")
    rates = rates.join(F.broadcast(wanted), "user_id")
    odds = F.try_divide(F.col("gap") * F.col("wanted"), F.col("cost"))
    uniform = F.pmod(F.xxhash64(F.lit(seed), F.lit(turn), "user_id", "article_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    picked = measured.join(F.broadcast(rates), "user_id").filter(uniform < odds).select("user_id", "article_id")
    found: dict[int, list] = {}
    for row in vectors.join(picked, ["user_id", "article_id"], "left_semi").select("user_id", "embedding").toLocalIterator():
        found.setdefault(row.user_id, []).append(row.embedding)
    return {user: np.vstack([centers, np.array(found[user], dtype=np.float64)]) if user in found else centers for user, centers in chosen.items()}


def _sums(vectors: DataFrame, centers: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """{user: (points per centre, their sum)}: a task returns one row per user and centre."""
    shared = vectors.sparkSession.sparkContext.broadcast(centers)

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sizes = {user: np.zeros(len(c)) for user, c in shared.value.items()}
        totals = {user: np.zeros(c.shape) for user, c in shared.value.items()}
        seen = set()
        for user, _part, points in _batches(frames):
            seen.add(user)
            labels = squared_gaps(points, shared.value[user]).argmin(1)
            sizes[user] += np.bincount(labels, minlength=len(sizes[user]))
            np.add.at(totals[user], labels, points)
        rows = [(user, i, sizes[user][i], totals[user][i].tolist()) for user in sorted(seen) for i in np.flatnonzero(sizes[user])]
        yield pd.DataFrame(rows, columns=["user_id", "cluster", "n", "total"])

    def merge(key, frame):
        return pd.DataFrame([(*key, frame["n"].sum(), np.array(frame["total"].tolist()).sum(0).tolist())], columns=["user_id", "cluster", "n", "total"])

    schema = "user_id long, cluster int, n double, total array<double>"
    # A group has one row per task.
    rows = vectors.mapInPandas(add, schema).groupBy("user_id", "cluster").applyInPandas(merge, schema).collect()
    out = {user: (np.zeros(len(c)), np.zeros(c.shape)) for user, c in centers.items()}
    for row in rows:
        out[row.user_id][0][row.cluster] = row.n
        out[row.user_id][1][row.cluster] = row.total
    return out


def fit_centers(vectors: DataFrame, counts: dict[int, int], settings: Clustering) -> dict[int, np.ndarray]:
    """{user: centres} for ``vectors`` (user_id, article_id, embedding of one width per user); ``counts``: k of each user."""
    order = F.xxhash64(F.lit(settings.seed), F.lit(-1), "user_id", "article_id")
    first = vectors.groupBy("user_id").agg(F.min_by("embedding", F.struct(order, F.col("article_id"))).alias("embedding")).collect()
    chosen = {r.user_id: np.array([r.embedding], dtype=np.float64) for r in first}
    for turn in range(ROUNDS):
        chosen = _draws(vectors, chosen, counts, turn, settings.seed)
    weighed = _sums(vectors, chosen)
    centers = {user: weighted_lloyd(points, np.maximum(weighed[user][0], 1e-9), counts[user], settings) for user, points in chosen.items()}
    moving = dict(centers)
    for _ in range(settings.max_iterations):
        part = vectors if len(moving) == len(centers) else _of_users(vectors, list(moving))
        for user, (sizes, totals) in _sums(part, moving).items():
            moved = np.where(sizes[:, None] > 0, totals / np.maximum(sizes, 1.0)[:, None], centers[user])
            if np.abs(moved - centers[user]).max() <= STILL:
                moving.pop(user)
            centers[user] = moved
        moving = {user: centers[user] for user in moving}
        if not moving:
            break
    return centers


def _of_users(rows: DataFrame, users: list[int]) -> DataFrame:
    ids = rows.sparkSession.createDataFrame([(user,) for user in users], "user_id long")
    return rows.join(F.broadcast(ids), "user_id", "left_semi")


def users_at_once(most_clusters: int, width: int) -> int:
    """Users whose centres and candidates fit ``CENTRE_BYTES``, so that passes over small users are few."""
    return max(1, CENTRE_BYTES // (8 * max(1, width) * (1 + ROUNDS * OVERSAMPLING * most_clusters)))


def common_width(points: DataFrame) -> DataFrame:
    """Rows whose vector has the user's most frequent width, the smaller one on ties."""
    widths = points.groupBy("user_id", F.size("embedding").alias("width")).agg(F.count("*").alias("n"))
    best = widths.groupBy("user_id").agg(F.max_by("width", F.struct("n", F.negate("width"))).alias("width"))
    return points.join(F.broadcast(best), "user_id").filter(F.size("embedding") == F.col("width")).drop("width")


def large_user_clusters(points: DataFrame, counts: dict[int, int], settings: Clustering, schema: str) -> list[DataFrame]:
    """Cluster members of the users in ``counts`` (at most one per ``local_rows`` rows), some users at a time.

    ``points``: (user_id, article_id, weight, topics, embedding) of these users, one width each.
    """
    users, out = sorted(counts), []
    width = points.select(F.max(F.size("embedding"))).first()[0] or 1
    step = users_at_once(max(counts.values(), default=1), width)
    for start in range(0, len(users), step):
        some = users[start : start + step]
        mine = materialize(_of_users(points, some).select("user_id", "article_id", "weight", "topics", "embedding"))
        centers = fit_centers(mine.select("user_id", "article_id", "embedding"), {u: counts[u] for u in some}, settings)
        shared = points.sparkSession.sparkContext.broadcast(centers)

        def label(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for user, part, vectors in _batches(frames):
                labels = squared_gaps(vectors, shared.value[user]).argmin(1)
                found = part[["user_id", "article_id"]].assign(cluster=labels.astype("int32"), weight=part["weight"], topics=part["topics"])
                yield found.assign(centroid=[shared.value[user][i].tolist() for i in labels])

        out.append(mine.mapInPandas(label, schema))
    return out
