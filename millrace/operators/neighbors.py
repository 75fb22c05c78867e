"""Neighbour lists of the article pool, and similarities of many users to it, without one vector per user and article.

Neighbours.  The pool's vectors are compared with each other once, tile by tile; every article keeps its k most similar
articles of equal width.  A run's neighbour similarity is then a look-up: the first article of the list that the run does not
hide.  Runs that hide the first one are found by joining hidden pairs with list entries.  Where a run hides a whole
list, the lists of those articles alone are computed again, four times as long, until every run is served.

Profiles.  Blocks of pool vectors meet blocks of profile rows of many users; a task multiplies one block of each and returns
numbers.  Pool vectors are copied once per block of profile rows and profile rows once per block of the pool, so no vector
is ever attached to a (user, article) row.  A user with more profile rows than a block holds is dealt over several blocks,
whose best lists of ``top_k`` entries are merged; nobody's history is gathered in one task.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.config import DEFAULT, EngineConfig
from millrace.functions.vectors import cosine_matrix, unit_rows
from millrace.operators.distributed import broadcast_if_small, part_count, top_per_key
from millrace.operators.scoring import select_candidates
from millrace.operators.similarity import profile_features
from millrace.session import materialize

PAIR = ["user_id", "article_id"]
FIRST_LIST = 8  # neighbours kept per article at first
ROWS_AT_ONCE = 64  # of a pair of parts
GROWTH = 4
LISTS = "article_id long, neighbor_id long, similarity double"


def _blocks(rows: int, size: int) -> int:
    return max(1, -(-rows // size))


def _largest(sims: np.ndarray, k: int) -> np.ndarray:
    """Columns of the ``k`` largest values of each row in falling order, earlier columns first among equals."""
    n = sims.shape[1]
    if n <= 4 * k:
        return np.argsort(-sims, axis=1, kind="stable")[:, :k]
    least = np.partition(sims, n - k, axis=1)[:, n - k]
    order = np.empty((len(sims), k), dtype=np.int64)
    for i, bar in enumerate(least):
        found = np.flatnonzero(sims[i] >= bar)
        order[i] = found[np.argsort(-sims[i, found], kind="stable")[:k]]
    return order


def neighbor_lists(vectors: DataFrame, k: int, tile: int, wanted: DataFrame | None = None) -> DataFrame:
    """(article_id, position, neighbor_id, similarity): the ``k`` nearest articles of equal width, ties by id.

    ``wanted`` (article_id) restricts the lists, not the articles in them.  Each task multiplies two of a bounded number of
    parts and returns at most k entries per row; entries of all parts meet in a group limit.
    """
    rows = vectors.filter(F.size("embedding") > 0).withColumn("width", F.size("embedding"))
    counts = rows.groupBy("width").agg(F.count("*").alias("n"))
    tiles = part_count(F.col("n"), 4 * F.col("width"), tile)
    dealt = rows.join(F.broadcast(counts.select("width", tiles.alias("tiles"))), "width").withColumn(
        "tile", F.pmod(F.xxhash64("article_id"), F.col("tiles")).cast("int")
    )
    every = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    left = dealt if wanted is None else dealt.join(wanted, "article_id", "left_semi")
    left = left.select("width", "tile", every.alias("other"), "article_id", "embedding")
    # New names throughout: both sides come from one table.
    names = {"width": "r_width", "tile": "r_other", "article_id": "r_id", "embedding": "r_vector"}
    right = dealt.select(*[F.col(c).alias(n) for c, n in names.items()], every.alias("r_tile"))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"article_id": [], "neighbor_id": [], "similarity": []})
        b = b.sort_values("r_id")
        ids, others = a["article_id"].to_numpy(), b["r_id"].to_numpy()
        rows = unit_rows(np.stack(a["embedding"].to_numpy()).astype(np.float64))
        columns = unit_rows(np.stack(b["r_vector"].to_numpy()).astype(np.float64)).T
        out = []
        for start in range(0, len(ids), ROWS_AT_ONCE):
            mine = ids[start : start + ROWS_AT_ONCE]
            sims = rows[start : start + ROWS_AT_ONCE] @ columns
            sims[mine[:, None] == others[None, :]] = -np.inf
            order = _largest(sims, k)
            top = np.take_along_axis(sims, order, axis=1)
            kept = (top > -np.inf).ravel()
            out.append(pd.DataFrame({"article_id": np.repeat(mine, order.shape[1])[kept], "neighbor_id": others[order].ravel()[kept], "similarity": top.ravel()[kept]}))
        return pd.concat(out)

    found = left.groupBy("width", "tile", "other").cogroup(right.groupBy("r_width", "r_tile", "r_other")).applyInPandas(run, LISTS)
    return top_per_key(found, ["article_id"], [F.desc("similarity"), F.col("neighbor_id")], k)


def _first_open(hidden: DataFrame, lists: DataFrame, k: int) -> DataFrame:
    """(user_id, article_id, similarity, short) of the pairs whose first list entries are hidden from the user.

    ``similarity`` is that of the first entry left; ``short`` tells that the list has none left but more articles exist.
    """
    blocked = (
        hidden.select("user_id", F.col("article_id").alias("neighbor_id"))
        .join(lists.select("article_id", "neighbor_id", "position"), "neighbor_id")
        .groupBy(*PAIR)
        .agg(F.array_sort(F.collect_list("position")).alias("blocked"))  # at most k positions
        .filter(F.col("blocked")[0] == 1)
    )
    # Positions are 1, 2, 3 ...: the first one that differs from its index is open.
    indexed = F.transform("blocked", lambda p, i: p - i - 1)
    run = F.size(F.filter(indexed, lambda d: d == 0))
    entries = lists.select("article_id", F.col("position").alias("open"), "similarity")
    lengths = lists.groupBy("article_id").agg(F.max("position").alias("length"))
    return (
        blocked.select(*PAIR, (run + 1).alias("open"))
        .join(entries, ["article_id", "open"], "left")
        .join(lengths, "article_id")
        .select(*PAIR, "similarity", (F.col("similarity").isNull() & (F.col("length") >= k)).alias("short"))
    )


def run_neighbors(vectors: DataFrame, hidden: DataFrame, tile: int, first: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Neighbour similarity of every run: (article_id, near) for runs that do not hide the nearest article, and
    (user_id, article_id, near) for the pairs of those that do; ``near`` is null where a run has no other article of the width.

    ``hidden``: the (user_id, article_id) pairs that a run does not show, distinct.
    """
    k = first or FIRST_LIST
    lists = materialize(neighbor_lists(vectors, k, tile))
    usual = lists.filter("position = 1").select("article_id", F.col("similarity").alias("near"))
    found = materialize(_first_open(hidden, lists, k))
    served = found.filter(~F.col("short"))
    short = found.filter("short").select(*PAIR)
    while not short.isEmpty():
        k *= GROWTH
        lists = materialize(neighbor_lists(vectors, k, tile, short.select("article_id").distinct()))
        again = materialize(_first_open(hidden, lists, k).join(short, PAIR, "left_semi"))
        served = served.unionByName(again.filter(~F.col("short")))
        short = again.filter("short").select(*PAIR)
    return usual, served.select(*PAIR, F.col("similarity").alias("near"))


def dominant_widths(vectors: DataFrame, hidden: DataFrame, users: DataFrame) -> tuple[int | None, DataFrame | None]:
    """The width whose vectors take part in neighbour search: one number if all runs agree at once, else (user_id, width)."""
    widths = [(r["width"], r["n"]) for r in vectors.groupBy(F.size("embedding").alias("width")).agg(F.count("*").alias("n")).collect()]
    if len(widths) < 2:
        return (widths[0][0] if widths else None), None
    # A few widths of one pool, each less what the run hides of it.
    all_widths = F.explode(F.array(*[F.struct(F.lit(w).alias("width"), F.lit(n).cast("long").alias("n")) for w, n in widths])).alias("w")
    lost = hidden.join(vectors.select("article_id", F.size("embedding").alias("width")), "article_id").groupBy("user_id", "width").agg(F.count("*").alias("lost"))
    left = users.select("user_id", all_widths).select("user_id", "w.*").join(lost, ["user_id", "width"], "left")
    counted = left.withColumn("n", F.col("n") - F.coalesce("lost", F.lit(0)))
    return None, counted.groupBy("user_id").agg(F.max_by("width", F.struct("n", F.negate("width"))).alias("width"))


SIMILARITIES = "user_id long, article_id long, interest double, bad_similarity double, centroid_similarity double, tops array<struct<similarity double, position int, weight double>>"


def _top_entries(sims: np.ndarray, part: pd.DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k largest similarities per row with position and weight; earlier profile rows win ties."""
    order = np.argsort(-sims, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(sims, order, axis=1), part["position"].to_numpy()[order], part["weight"].to_numpy()[order]


def profile_similarities(vectors: DataFrame, profile: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """(user_id, article_id, interest_similarity, bad_similarity, centroid_similarity) of every pool vector and every user
    with profile rows; null where the user has no rows of the kind."""
    tile, top_k = cfg.vector_tile_rows, cfg.top_k
    sizes = materialize(profile.groupBy("user_id").agg(F.count("*").alias("n")))
    total, largest = sizes.agg(F.sum("n"), F.max("n")).first()
    pool_blocks, groups = _blocks(vectors.count(), tile), _blocks(total or 0, 2 * tile)
    every_block = F.explode(F.sequence(F.lit(0), F.lit(pool_blocks - 1))).alias("block")
    every_group = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group")
    left = vectors.select(every_group, F.pmod(F.xxhash64("article_id"), F.lit(pool_blocks)).cast("int").alias("block"), "article_id", "embedding")

    def similarities(rows: DataFrame, split: bool) -> DataFrame:
        def run(pool: pd.DataFrame, prof: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(pool) and len(prof):
                prof = prof.sort_values(["user_id", "kind", "position"], kind="stable").reset_index(drop=True)
                ids, n = pool["article_id"].to_numpy(), len(pool)
                sims = cosine_matrix(list(pool["embedding"]), list(prof["vector"]))
                for user, mine in prof.groupby("user_id", sort=False):
                    row = {"user_id": np.full(n, user), "article_id": ids, "interest": np.full(n, np.nan), "bad_similarity": np.full(n, np.nan),
                           "centroid_similarity": np.full(n, np.nan), "tops": [None] * n}
                    for kind, part in mine.groupby("kind", sort=False):
                        block = sims[:, part.index[0] : part.index[-1] + 1]
                        if kind != "interest":
                            row[f"{kind}_similarity"] = block.max(axis=1)
                            continue
                        top, position, weight = _top_entries(block, part, top_k)
                        if split:
                            row["tops"] = [[{"similarity": s, "position": p, "weight": w} for s, p, w in zip(*three, strict=True)] for three in zip(top.tolist(), position.tolist(), weight.tolist(), strict=True)]
                        else:
                            whole = weight.sum(axis=1)
                            row["interest"] = np.where(whole == 0, top.mean(axis=1), (top * weight).sum(axis=1) / np.where(whole == 0, 1.0, whole))
                    out.append(pd.DataFrame(row))
            return pd.concat(out) if out else pd.DataFrame(columns=[c.split()[0] for c in SIMILARITIES.split(", ")[:5]] + ["tops"])

        key = ["block", "group"]
        return left.groupBy(*key).cogroup(rows.groupBy(*key)).applyInPandas(run, SIMILARITIES)

    def clean(df: DataFrame) -> DataFrame:
        return df.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in ("interest", "bad_similarity", "centroid_similarity")})

    names = [*PAIR, F.col("interest").alias("interest_similarity"), "bad_similarity", "centroid_similarity"]
    dealt = profile.join(sizes, "user_id")
    part = F.pmod(F.xxhash64("kind", "position"), F.ceil(F.col("n") / F.lit(2 * tile)))
    group = F.pmod(F.xxhash64("user_id", F.when(F.col("n") <= 2 * tile, F.lit(0)).otherwise(part)), F.lit(groups)).cast("int")
    dealt = dealt.select(every_block, group.alias("group"), "user_id", "kind", "position", "vector", "weight", "n")
    whole = clean(similarities(dealt.filter(F.col("n") <= 2 * tile).drop("n"), False)).select(*names)
    if (largest or 0) <= 2 * tile:
        return whole
    parts = clean(similarities(dealt.filter(F.col("n") > 2 * tile).drop("n"), True))
    merged = parts.groupBy(*PAIR).agg(
        F.max("bad_similarity").alias("bad_similarity"), F.max("centroid_similarity").alias("centroid_similarity"), F.flatten(F.collect_list("tops")).alias("tops")
    )
    ordered = F.transform("tops", lambda t: F.struct(F.negate(t["similarity"]).alias("key"), t["position"].alias("position"), t["weight"].alias("weight")))
    best = F.slice(F.array_sort(ordered), 1, top_k)

    def total_of(value):
        return F.aggregate("best", F.lit(0.0), lambda s, t: s + value(t))

    plain = total_of(lambda t: -t["key"]) / F.size("best")
    weight = total_of(lambda t: t["weight"])
    interest = F.when(F.size("best") == 0, None).when(weight == 0, plain).otherwise(total_of(lambda t: -t["key"] * t["weight"]) / F.nullif(weight, F.lit(0.0)))
    return whole.unionByName(merged.withColumn("best", best).withColumn("interest", interest).select(*names))


def pool_features(
    chosen: DataFrame, pool: DataFrame, hidden: DataFrame, profile: DataFrame, users: DataFrame, cfg: EngineConfig = DEFAULT
) -> DataFrame:
    """``chosen`` (user_id, article_id, ...) with the four similarities; null for articles without a vector.

    Every run of ``users`` shows the whole ``pool`` (article_id, embedding) but its ``hidden`` pairs.
    """
    return pool_similarities(pool, hidden, profile, users, cfg)(chosen)


def pool_similarities(
    pool: DataFrame, hidden: DataFrame, profile: DataFrame, users: DataFrame, cfg: EngineConfig = DEFAULT, keep: bool = False
) -> Callable[[DataFrame], DataFrame]:
    """What :func:`pool_features` adds, for any number of sets of pairs; ``keep`` if there is more than one."""
    vectors = materialize(pool.filter(F.col("embedding").isNotNull()).select("article_id", "embedding"))
    hidden = materialize(hidden.join(vectors.select("article_id"), "article_id", "left_semi").select(*PAIR).distinct())
    usual, special = run_neighbors(vectors, hidden, cfg.vector_tile_rows)
    width, widths = dominant_widths(vectors, hidden, users)
    known = vectors.select("article_id", F.size("embedding").alias("width")).join(usual, "article_id", "left")
    known = broadcast_if_small(known, vectors.count())
    similar = profile_similarities(vectors, profile, cfg)
    similar = materialize(similar) if keep else similar
    moved = special.withColumnRenamed("near", "left_near").withColumn("moved", F.lit(True))

    def attach(chosen: DataFrame) -> DataFrame:
        rows = chosen.join(known, "article_id", "left").join(similar, PAIR, "left").join(moved, PAIR, "left")
        near = F.when(F.col("moved"), F.col("left_near")).otherwise(F.col("near"))
        if widths is None:
            near = F.when(F.col("width") == width, near) if width is not None else F.lit(None).cast("double")
        else:
            rows = rows.join(widths.withColumnRenamed("width", "run_width"), "user_id", "left")
            near = F.when(F.col("width") == F.col("run_width"), near)
        has_vector = F.col("width").isNotNull()
        return rows.select(
            *[F.col(c) for c in chosen.columns],
            F.when(has_vector, F.coalesce("interest_similarity", F.lit(0.0))).alias("interest_similarity"),
            F.when(has_vector, F.col("bad_similarity")).alias("bad_similarity"),
            F.when(has_vector, F.col("centroid_similarity")).alias("centroid_similarity"),
            F.when(has_vector, near).alias("neighbor_similarity"),
        )

    return attach


def bad_similarities(
    users: DataFrame, pool: DataFrame, excluded: DataFrame, bad: DataFrame, cfg: EngineConfig = DEFAULT
) -> DataFrame:
    """(user_id, article_id, bad_similarity) of every candidate with a vector; null for users without a Bad vector.

    ``pool``: (article_id, published_at, embedding); ``bad``: (user_id, position, embedding).  No other similarity is computed.
    Candidates of users without a Bad vector are written as they are chosen.
    """
    bad = materialize(bad.join(users, "user_id", "left_semi").select("user_id", "position", "embedding"))
    judging = bad.select("user_id").distinct()
    others = users.join(judging, "user_id", "left_anti")
    vector, one = F.col("embedding").cast("array<double>").alias("vector"), F.lit(1.0).alias("weight")
    own = F.col("user_id").alias("user_id")  # a new column: candidates come from the same table
    profile = bad.select(own, F.lit("bad").alias("kind"), F.col("position").cast("int").alias("position"), vector, one)
    vectors = materialize(pool.filter(F.col("embedding").isNotNull()).select("article_id", "published_at", "embedding"))
    none = F.lit(None).cast("double").alias("bad_similarity")
    if cfg.max_candidates is None:
        rest, _ = select_candidates(others, vectors, excluded, None, positions=False)
        hidden = excluded.join(judging, "user_id", "left_semi").join(vectors.select("article_id"), "article_id", "left_semi")
        measured = profile_similarities(vectors.select("article_id", "embedding"), profile, cfg).join(hidden, PAIR, "left_anti")
        return rest.select(*PAIR, none).unionByName(measured.select(*PAIR, "bad_similarity"))
    known = broadcast_if_small(vectors.select("article_id"), vectors.count())
    rest, mine = (select_candidates(some, pool, excluded, cfg.max_candidates)[0].join(known, "article_id", "left_semi") for some in (others, judging))
    mine = mine.join(vectors.select("article_id", "embedding"), "article_id")
    measured = profile_features(mine, profile, cfg, single_block=cfg.max_candidates <= cfg.vector_tile_rows)
    return rest.select(*PAIR, none).unionByName(measured.select(*PAIR, "bad_similarity"))
