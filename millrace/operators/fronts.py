"""Runs with a candidate cap: everybody sees the front of the pool only, so pairs are written last and never shuffled.

The first places of the pool, as many as the longest run reaches, are few: they are broadcast with their vectors and scores.  A user is
one row with what is hidden, opened and liked, and with the profile; similarities of its candidates are arrays by vector of the front.
Pairs are written out of that row, where all of a user's pairs share a task: ranks need a sort, but no exchange.  If only the best few
of a run are asked for, totals are compared inside the row, and no other pair is written.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.config import DEFAULT, EngineConfig
from millrace.functions.vectors import unit_rows
from millrace.functions.weights import source_preference_factor
from millrace.operators.related import _first, run_totals
from millrace.operators.similarity import _weighted_top

KINDS = ("interest", "bad", "centroid")
SIMILAR = "struct<interest: array<double>, bad: array<double>, centroid: array<double>, near: array<double>>"
BEST = "array<struct<place: bigint, position: int, interest: double, centroid: double, near: double>>"
USERS_AT_ONCE = 512  # whose arrays are built together


def _cosines(profile: list[np.ndarray], front: dict[int, tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """Cosine of profile vectors to the vectors of the front; 0.0 where widths differ."""
    out = np.zeros((len(profile), n))
    widths = np.array([len(v) for v in profile])
    for width in np.unique(widths):
        if width in front:
            rows = np.flatnonzero(widths == width)
            columns, matrix = front[width]
            out[np.ix_(rows, columns)] = unit_rows(np.array([profile[i] for i in rows])) @ matrix.T
    return out


def _nearest(shown: np.ndarray, widths: np.ndarray, front: dict[int, tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """Largest cosine to another shown vector of the width most of them have, the smaller width on ties."""
    near = np.full(n, np.nan)
    found, counts = np.unique(widths[shown], return_counts=True)
    if len(found):
        columns, matrix = front[int(found[counts.argmax()])]
        inside = np.flatnonzero(np.isin(columns, shown, assume_unique=True))
        if len(inside) > 1:
            sims = matrix[inside] @ matrix[inside].T
            np.fill_diagonal(sims, -np.inf)
            near[columns[inside]] = sims.max(axis=1)
    return near


def _by_width(vectors: list[np.ndarray], places: list[int]) -> tuple[np.ndarray, np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Widths and places of the vectors of the front, and the columns and unit vectors of each width."""
    widths, at = np.array([len(v) for v in vectors], dtype=np.int64), np.array(places, dtype=np.int64)
    by_width = {
        int(w): (np.flatnonzero(widths == w), unit_rows(np.array([vectors[i] for i in np.flatnonzero(widths == w)], dtype=np.float64)))
        for w in np.unique(widths) if w > 0
    }
    return widths, at, by_width


def front_similarities(vectors: list[np.ndarray], places: list[int], cfg: EngineConfig = DEFAULT):
    """Arrow UDF (reach, hidden places, profile) -> similarities of a user to every vector of the front below ``reach``.

    ``vectors`` and their ``places`` in the pool's order are those of the front; entries of hidden places are not to be read.
    """
    shared, top_k = _by_width(vectors, places), cfg.top_k

    @F.arrow_udf(SIMILAR)
    def similar(reach: pa.Array, hidden: pa.Array, kinds: pa.Array, positions: pa.Array, weights: pa.Array, profile: pa.Array) -> pa.Array:
        widths, at, front = shared
        parts = []
        for start in range(0, len(reach), USERS_AT_ONCE):
            lists: dict[str, list] = {name: [] for name in (*KINDS, "near")}
            for i in range(start, min(start + USERS_AT_ONCE, len(reach))):
                n = int(np.searchsorted(at, reach[i].as_py()))
                kind = np.array(kinds[i].as_py())
                rows = profile[i].values
                own = [np.asarray(rows[j].values, dtype=np.float64) for j in range(len(rows))]
                sims = _cosines(own, front, len(at))[:, :n]
                order = np.argsort(np.asarray(positions[i].values), kind="stable")
                of = {name: order[kind[order] == name] if len(kind) else order for name in KINDS}
                lists["interest"].append(_weighted_top(sims[of["interest"]].T, np.asarray(weights[i].values)[of["interest"]], top_k) if len(of["interest"]) else np.zeros(n))
                for name in KINDS[1:]:
                    lists[name].append(sims[of[name]].max(axis=0) if len(of[name]) else np.full(n, np.nan))
                shown = np.flatnonzero((widths[:n] > 0) & ~np.isin(at[:n], np.asarray(hidden[i].values)))
                lists["near"].append(_nearest(shown, widths, front, len(at))[:n])
            arrays = []
            for name in (*KINDS, "near"):
                offsets = np.concatenate([[0], np.cumsum([len(a) for a in lists[name]])]).astype(np.int32)
                flat = np.concatenate(lists[name]) if lists[name] else np.zeros(0)
                arrays.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, mask=np.isnan(flat))))
            parts.append(pa.StructArray.from_arrays(arrays, names=[*KINDS, "near"]))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.struct([(n, pa.list_(pa.float64())) for n in (*KINDS, "near")]))

    return similar


def user_rows(
    users: DataFrame, hidden: DataFrame, profile: DataFrame, opened: DataFrame, liked: DataFrame, moved: DataFrame | None = None, parts: int | None = None
) -> DataFrame:
    """One row per user: hidden places and opened places (sorted), profile as four arrays, weight by liked domain, ``moved`` neighbours.

    All facts meet in one exchange by user, of ``parts`` tasks if these are given.
    """
    none = {"hidden": "long", "opened": "long", "domain": "string", "liking": "double", "kind": "string", "position": "int", "weight": "double", "vector": "array<double>",
            "article": "long", "near": "double"}

    def facts(df: DataFrame, **columns: Column | str) -> DataFrame:
        return df.select("user_id", *[
            (F.col(columns[c]) if isinstance(columns.get(c), str) else columns.get(c, F.lit(None))).cast(t).alias(c) for c, t in none.items()
        ])

    rows = (
        facts(users)
        .unionByName(facts(hidden, hidden="place"))
        .unionByName(facts(opened, opened="place"))
        .unionByName(facts(liked, domain="source_domain", liking="effective_weight"))
        .unionByName(facts(profile, kind="kind", position="position", weight="weight", vector="vector"))
    )
    if moved is not None:
        rows = rows.unionByName(facts(moved, article="article_id", near="near"))
    rows = rows if parts is None else rows.repartition(parts, "user_id")
    row = F.collect_list(F.when(F.col("kind").isNotNull(), F.struct("kind", "position", "weight", "vector")))
    domains = F.collect_list(F.when(F.col("domain").isNotNull(), F.struct("domain", "liking")))
    return rows.groupBy("user_id").agg(
        F.array_sort(F.collect_set("hidden")).alias("hidden"), F.array_sort(F.collect_set("opened")).alias("opened"),
        F.map_from_entries(domains).alias("liked"), row.alias("profile"),
        F.collect_list(F.when(F.col("article").isNotNull(), F.struct(F.col("article").alias("article_id"), "near"))).alias("moved"),
    )


def best_of_front(front: list[dict], limit: int, best: int, cfg: EngineConfig = DEFAULT):
    """Arrow UDF (hidden places, opened places, liked domains and their factors, profile) -> the candidates that can be among the
    first ``best`` of a run.

    ``front``: rows by place, from place 0, with name (the id as text), source_domain, embedding, fixed and authority.
    """
    embedded = [i for i, r in enumerate(front) if r["embedding"] is not None]
    widths, at, by_width = _by_width([np.array(front[i]["embedding"], dtype=np.float64) for i in embedded], embedded)
    names = np.empty(len(front), dtype=np.int64)
    names[sorted(range(len(front)), key=lambda i: front[i]["name"])] = np.arange(len(front))
    fixed, authority = (np.array([r[c] for r in front], dtype=np.float64) for c in ("fixed", "authority"))
    domains: dict[str, list[int]] = {}
    for i, r in enumerate(front):
        domains.setdefault(r["source_domain"], []).append(i)
    shared, top_k, usual = (widths, at, by_width, names, fixed, authority, domains), cfg.top_k, {}

    def of_run(hidden, opened, liked, factors, kinds, positions, weights, profile) -> list[np.ndarray]:
        widths, at, by_width, names, fixed, authority, domains = shared
        total = len(names)
        seen = np.ones(total, dtype=bool)
        seen[hidden[hidden < total]] = False
        shown = np.flatnonzero(seen)[:limit]
        reach = int(shown[-1]) + 1 if len(shown) else 0
        n = int(np.searchsorted(at, reach))
        order = np.argsort(positions, kind="stable")
        rows = {name: order[kinds[order] == name] for name in ("interest", "centroid")}
        cosines = _cosines(profile, by_width, len(at))[:, :n]
        interest, centroid, near = np.full(total, np.nan), np.full(total, np.nan), np.full(total, np.nan)
        interest[at[:n]] = _weighted_top(cosines[rows["interest"]].T, weights[rows["interest"]], top_k) if len(rows["interest"]) else 0.0
        if len(rows["centroid"]):
            centroid[at[:n]] = cosines[rows["centroid"]].max(axis=0)
        left = np.flatnonzero((widths[:n] > 0) & seen[at[:n]])
        if len(left) == np.count_nonzero(widths[:n] > 0):  # nothing compared is hidden: as for all such runs
            if n not in usual:
                usual.clear()
                usual[n] = _nearest(left, widths, by_width, len(at))[:n]
            near[at[:n]] = usual[n]
        else:
            near[at[:n]] = _nearest(left, widths, by_width, len(at))[:n]
        factor = np.ones(total)
        for domain, value in zip(liked, factors, strict=True):
            factor[domains.get(domain, [])] = value
        totals = run_totals(np.nan_to_num(interest), centroid, near, fixed, authority, factor, cfg)
        totals[opened[opened < total]] -= cfg.read_penalty
        found = np.sort(_first(totals[shown], names[shown], best))
        kept = shown[found]
        return [kept, found + 1, interest[kept], centroid[kept], near[kept]]

    kinds_of = [pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.float64()]
    fields = [pa.field(name, kind) for name, kind in zip(("place", "position", "interest", "centroid", "near"), kinds_of, strict=True)]

    @F.arrow_udf(BEST)
    def first(
        hidden: pa.Array, opened: pa.Array, liked: pa.Array, factors: pa.Array, kinds: pa.Array, positions: pa.Array, weights: pa.Array, profile: pa.Array
    ) -> pa.Array:
        found = []
        for i in range(len(hidden)):
            numbers = [np.asarray(a[i].values, dtype=t) for a, t in ((hidden, np.int64), (opened, np.int64), (positions, np.int64), (weights, np.float64))]
            vectors = profile[i].values
            own = [np.asarray(vectors[j].values, dtype=np.float64) for j in range(len(vectors))]
            texts = np.array(kinds[i].as_py(), dtype=object)
            found.append(of_run(numbers[0], numbers[1], liked[i].as_py(), factors[i].as_py(), texts, numbers[2], numbers[3], own))
        offsets = np.concatenate([[0], np.cumsum([len(r[0]) for r in found])]).astype(np.int32)
        columns = []
        for j, kind in enumerate(kinds_of):
            flat = np.concatenate([r[j] for r in found]) if found else np.zeros(0)
            columns.append(pa.array(flat, kind, mask=np.isnan(flat)))
        return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(columns, fields=fields))

    return first


def front_best(rows: DataFrame, front: DataFrame, limit: int, best: int, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """The pairs of :func:`front_pairs` that can be among the first ``best`` of a run without Bad opinions in its profile.

    ``front`` has the columns of :func:`millrace.operators.related.run_constants`, too.
    """
    ordered = front.select("place", F.col("article_id").cast("string").alias("name"), "source_domain", "embedding", "fixed", "authority").orderBy("place")
    first = best_of_front([r.asDict() for r in ordered.collect()], limit, best, cfg)
    factors = F.transform(F.map_values("liked"), lambda w: source_preference_factor(w, cfg))
    profile = [F.col("profile")[n] for n in ("kind", "position", "weight", "vector")]
    found = rows.select("user_id", "opened", "liked", first("hidden", "opened", F.map_keys("liked"), factors, *profile).alias("found"))
    # Outer: the filter that Spark infers for a plain explode would run the function a second time.
    pairs = found.select("user_id", "opened", "liked", F.explode_outer("found").alias("f")).select("user_id", "opened", "liked", "f.*")
    return pairs.join(F.broadcast(front.drop("fixed", "authority")), "place").select(
        "user_id",
        *[c for c in front.columns if c not in ("place", "embedding", "fixed", "authority")],
        F.col("position").alias("candidate_position"),
        F.coalesce("interest", F.lit(0.0)).alias("interest_similarity"),
        F.lit(None).cast("double").alias("bad_similarity"),
        F.col("centroid").alias("centroid_similarity"),
        F.col("near").alias("neighbor_similarity"),
        F.coalesce(F.try_element_at("liked", F.col("source_domain")), F.lit(0.0)).alias("source_preference"),
        F.array_contains("opened", F.col("place")).alias("is_read"),
        F.lit(False).alias("is_bad"),
        F.col("embedding").isNotNull().alias("has_vector"),
    )


def front_pairs(rows: DataFrame, front: DataFrame, total: int, limit: int, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """All pairs of the users in ``rows`` (see :func:`user_rows`) with everything the score reads.

    ``front``: the pool's first articles with ``place``, ``embedding`` and the columns of
    :func:`millrace.operators.scoring.article_features`, small enough for every task.
    """
    embedded = front.filter(F.col("embedding").isNotNull()).select("place", "embedding").orderBy("place").collect()
    similar = front_similarities([np.array(r["embedding"], dtype=np.float64) for r in embedded], [r["place"] for r in embedded], cfg)
    slots = {r["place"]: i for i, r in enumerate(embedded)}
    spark = front.sparkSession
    numbered = spark.createDataFrame(pd.DataFrame({"place": list(slots), "slot": list(slots.values())}, dtype="int64"), "place long, slot int")
    known = F.broadcast(front.drop("embedding").join(F.broadcast(numbered), "place", "left"))
    gaps = F.transform(
        F.concat("hidden", F.array(F.lit(total).cast("long"))),
        lambda place, i: F.struct(
            F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get("hidden", i - 1) + 1).alias("start"),
            F.least(place, F.lit(limit).cast("long") + i).alias("end"),
        ),
    )
    gaps = F.filter(gaps, lambda g: g["start"] < g["end"])
    shown = F.flatten(F.transform(gaps, lambda g: F.sequence(g["start"], g["end"] - 1)))
    # Behind the last place shown nothing takes part, not even as a neighbour.
    reach = F.coalesce(F.array_max(gaps["end"]), F.lit(0).cast("long"))
    arrays = similar(reach, F.col("hidden"), *[F.col("profile")[n] for n in ("kind", "position", "weight", "vector")])
    # A step of its own: beside the explode, the function would run once per pair.
    measured = rows.select("user_id", "opened", "liked", arrays.alias("s"), shown.alias("shown"))
    pairs = measured.select("user_id", "opened", "liked", "s", F.posexplode("shown").alias("i", "place")).join(known, "place")
    names = {"interest": "interest_similarity", "bad": "bad_similarity", "centroid": "centroid_similarity", "near": "neighbor_similarity"}
    similarities = {name: F.when(F.col("slot").isNotNull(), F.get(F.col("s")[kind], F.col("slot"))) for kind, name in names.items()}
    return pairs.withColumns(
        {
            "candidate_position": (F.col("i") + 1).cast("int"),
            **similarities,
            "source_preference": F.coalesce(F.try_element_at("liked", F.col("source_domain")), F.lit(0.0)),
            "is_read": F.array_contains("opened", F.col("place")),
            "is_bad": F.lit(False),
            "has_vector": F.col("slot").isNotNull(),
        }
    ).withColumn("interest_similarity", F.coalesce("interest_similarity", F.lit(0.0))).drop("i", "place", "slot", "s", "opened", "liked")
