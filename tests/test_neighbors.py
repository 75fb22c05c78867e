"""Neighbour lists and profile blocks against comparisons of all pairs, hot users included."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.config import DEFAULT
from millrace.functions.vectors import cosine_matrix
from millrace.operators import neighbors as N
from millrace.operators.distributed import PARTS
from millrace.operators.profile import assign_clusters, interest_clusters
from millrace.operators.similarity import neighbor_tiles, profile_features

VECTORS = "article_id long, embedding array<double>"
PROFILE = "user_id long, kind string, position int, vector array<double>, weight double"


def unit(v):
    n = np.linalg.norm(v)
    return np.array(v) / n if n else np.array(v)


def brute_near(vectors, hidden, user):
    """{article: largest cosine to another article that the user sees, among vectors of the run's common width}"""
    seen = {a: v for a, v in vectors.items() if v is not None and (user, a) not in hidden}
    counts = {}
    for v in seen.values():
        counts[len(v)] = counts.get(len(v), 0) + 1
    width = max(counts, key=lambda w: (counts[w], -w), default=None)
    same = {a: unit(v) for a, v in seen.items() if len(v) == width}
    return {a: max((float(v @ w) for b, w in same.items() if b != a), default=None) for a, v in same.items()}


def pool_of(rng, n, widths=(3,)):
    vectors = {i: rng.normal(size=rng.choice(widths)).tolist() for i in range(n)}
    vectors[n] = None
    vectors[n + 1] = [0.0] * widths[0]
    vectors[n + 2] = list(vectors[0])  # equal vectors
    return vectors


@pytest.mark.parametrize("widths", [(3,), (3, 3, 4)])
def test_neighbours_equal_all_pairs_for_any_hidden_set(spark, monkeypatch, widths):
    monkeypatch.setattr(N, "FIRST_LIST", 2)
    rng = np.random.default_rng(len(widths))
    vectors = pool_of(rng, 40, widths)
    users = [1, 2, 3, 4]
    hidden = {(1, a) for a in range(0, 40, 2)} | {(2, a) for a in range(38)} | {(3, a) for a in vectors if a != 7}
    if len(widths) > 1:  # the common width of user 4 is the pool's rare one
        hidden |= {(4, a) for a, v in vectors.items() if v is not None and len(v) == 3 and a > 5}
    chosen = [(u, a) for u in users for a in vectors if (u, a) not in hidden]
    found = N.pool_features(
        spark.createDataFrame(chosen, "user_id long, article_id long"), spark.createDataFrame(list(vectors.items()), VECTORS),
        spark.createDataFrame(sorted(hidden) * 2, "user_id long, article_id long"), spark.createDataFrame([], PROFILE),
        spark.createDataFrame([(u,) for u in users], "user_id long"), replace(DEFAULT, vector_tile_rows=8),
    ).collect()
    assert sorted((r.user_id, r.article_id) for r in found) == sorted(chosen)
    for user in users:
        want = brute_near(vectors, hidden, user)
        for r in (r for r in found if r.user_id == user):
            assert r.neighbor_similarity == (None if want.get(r.article_id) is None else pytest.approx(want[r.article_id], abs=1e-9))
            assert r.interest_similarity == (None if vectors[r.article_id] is None else 0.0) and r.bad_similarity is None


def test_a_hot_user_is_split_and_equals_the_one_task_result(spark):
    rng = np.random.default_rng(4)
    vectors = pool_of(rng, 30, (4,))
    profile = []
    for user, n in ((1, 200), (2, 5), (3, 60), (4, 0)):  # user 1 holds most rows
        for kind, share in (("interest", n), ("bad", n // 3), ("centroid", min(n, 2))):
            profile += [(user, kind, p + 1, rng.normal(size=4).tolist(), float(rng.choice([0.0, 0.5, 1.0]))) for p in range(share)]
    profile += [(5, "interest", p, [1.0, 0.0, 0.0, 0.0], w) for p, w in ((1, 1.0), (2, -1.0), (3, 0.0))]  # ties, weights that cancel out
    users = spark.createDataFrame([(u,) for u in range(1, 6)], "user_id long")
    chosen = [(u, a) for u in range(1, 6) for a in vectors]
    pool = spark.createDataFrame(list(vectors.items()), VECTORS)
    rows = spark.createDataFrame(chosen, "user_id long, article_id long")
    none = rows.limit(0)
    profile_rows = spark.createDataFrame(profile, PROFILE)
    names = ["interest_similarity", "bad_similarity", "centroid_similarity", "neighbor_similarity"]

    def by_pair(df):
        return {(r.user_id, r.article_id): [r[n] for n in names] for r in df.filter("interest_similarity is not null").select("user_id", "article_id", *names).collect()}

    got = by_pair(N.pool_features(rows, pool, none, profile_rows, users, replace(DEFAULT, vector_tile_rows=8)))
    want = by_pair(profile_features(rows.join(pool, "article_id"), profile_rows, DEFAULT, single_block=True))
    assert got.keys() == want.keys()
    for pair, values in want.items():
        assert got[pair] == pytest.approx(values, abs=1e-9), pair


def test_largest_columns_keep_the_order_of_a_full_sort():
    sims = np.round(np.random.default_rng(8).normal(size=(30, 200)), 1)  # many equal values
    sims[:, 7] = -np.inf
    assert (N._largest(sims, 8) == np.argsort(-sims, axis=1, kind="stable")[:, :8]).all()


def test_rows_sent_for_neighbours_do_not_grow_with_the_square(spark):
    rows = spark.range(1000).select(F.lit(1).cast("long").alias("user_id"), F.col("id").alias("article_id"), F.array(F.rand(3), F.rand(4)).alias("embedding"))
    # Tiles of two rows would send every row 500 times.
    assert neighbor_tiles(rows, 2).count() <= PARTS * 1000


def test_lists_are_cut_and_ordered(spark):
    vectors = {i: [np.cos(i / 10), np.sin(i / 10)] for i in range(20)}
    lists = N.neighbor_lists(spark.createDataFrame([(i, [float(x) for x in v]) for i, v in vectors.items()], VECTORS), 3, 4).collect()
    assert len(lists) == 60
    for a in vectors:
        mine = sorted((r.position, r.neighbor_id) for r in lists if r.article_id == a)
        near = sorted((abs(a - b), b) for b in vectors if b != a)[:3]
        assert {b for _, b in mine} <= {b for b in vectors if abs(a - b) <= near[-1][0]} and [p for p, _ in mine] == [1, 2, 3]


def test_large_users_are_clustered_together(spark):
    rng = np.random.default_rng(0)
    rows = []
    for user, n in ((1, 900), (2, 30), (3, 301)):  # user 1 holds most rows
        for i in range(n):
            middle = np.eye(8)[i % 8] * 10
            rows.append((user, i, i + 1, 1.0 + i % 8, [f"t{i % 8}"], (middle + rng.normal(0, 0.05, 8)).tolist()))
    rows.append((1, 10_000, 10_001, 1.0, [], [1.0]))  # another width
    rows.append((3, 10_000, 10_001, 1.0, [], None))
    schema = "user_id long, article_id long, position int, weight double, topics array<string>, embedding array<double>"
    points = spark.createDataFrame(rows, schema)
    together = assign_clusters(points, replace(DEFAULT.clustering, local_rows=100))
    alone = assign_clusters(points, replace(DEFAULT.clustering, local_rows=10**6))

    def partition(members):
        groups = {}
        for r in members.select("user_id", "cluster", "article_id").collect():
            groups.setdefault((r.user_id, r.cluster), set()).add(r.article_id)
        return {(u, frozenset(g)) for (u, _), g in groups.items()}

    def shown(members):
        return sorted((r.user_id, r.place, r.label, round(r.weight, 9), r.article_count, [round(x, 6) for x in r.centroid]) for r in interest_clusters(members).collect())

    assert partition(together) == partition(alone) and len(partition(together)) == 24
    assert shown(together) == shown(alone)


def test_equal_points_of_a_large_user(spark):
    points = spark.createDataFrame([(1, i, i + 1, 0.0, ["x"], [1.0, 2.0]) for i in range(50)], "user_id long, article_id long, position int, weight double, topics array<string>, embedding array<double>")
    clusters = interest_clusters(assign_clusters(points, replace(DEFAULT.clustering, local_rows=10))).collect()
    assert sum(r.article_count for r in clusters) == 50 and all(r.centroid == [1.0, 2.0] for r in clusters)


def test_index_search_equals_a_scan_and_reads_less(spark, tmp_path):
    from millrace.operators.similarity import similar_by_vector
    from millrace.operators.vector_index import build_index, search_index

    rng = np.random.default_rng(6)
    middles = rng.normal(size=(12, 8)) * 4
    rows = [(i, (middles[i % 12] + rng.normal(0, 0.3, 8)).tolist()) for i in range(600)]
    rows += [(1000, [0.0] * 8), (1001, [1.0, 2.0]), (1002, None), (1003, list(rows[5][1])), (1004, list(rows[5][1]))]
    table = spark.createDataFrame(rows, VECTORS)
    index = build_index(table, str(tmp_path / "i"), cells=12, sample=300)
    assert sum(index.sizes) == 602 and index.odd == 2
    living = table.withColumn("is_dead", F.lit(False))
    probes = [rows[5][1], (middles[3] * 2).tolist(), rng.normal(size=8).tolist(), (-middles[0]).tolist(), [0.0] * 8, [1.0]]
    for n, query in enumerate(probes):
        for limit, exclude in ((5, ()), (3, (5, 1003))):
            got, read = search_index(spark, index, query, limit, exclude)
            want = similar_by_vector(living, query, limit, exclude).collect()
            assert [(r.article_id, pytest.approx(r.similarity, abs=1e-9)) for r in got.collect()] == [(r.article_id, r.similarity) for r in want], n
            if n < 2:
                assert read < 200
    assert search_index(spark, index, probes[0], 700)[0].count() == 604
    empty = build_index(table.limit(0), str(tmp_path / "e"))
    assert search_index(spark, empty, probes[0], 3)[0].count() == 0


@pytest.mark.parametrize(("limit", "tile"), [(None, 8), (None, 2048), (7, 2048), (7, 4)])
def test_bad_similarities_need_no_other_similarity(spark, monkeypatch, limit, tile):
    for step in ("run_neighbors", "neighbor_lists"):
        monkeypatch.setattr(N, step, lambda *_: pytest.fail("neighbours are not asked for"))
    rng = np.random.default_rng(12)
    vectors = {i: rng.normal(size=4).tolist() if i % 3 else None for i in range(30)}
    pool = spark.createDataFrame([(i, 100 - i, x) for i, x in vectors.items()], "article_id long, published_at long, embedding array<float>")
    users = spark.createDataFrame([(u,) for u in range(4)], "user_id long")
    disliked = {0: [1, 4], 1: [2], 9: [5]}
    bad = spark.createDataFrame([(u, k, vectors[a]) for u, own in disliked.items() for k, a in enumerate(own)], "user_id long, position int, embedding array<float>")
    hidden = [(u, a) for u, own in disliked.items() for a in own] + [(2, 7), (2, 0)]
    excluded = spark.createDataFrame(hidden, "user_id long, article_id long")
    cfg = replace(DEFAULT, max_candidates=limit, vector_tile_rows=tile)
    got = {(r.user_id, r.article_id): r.bad_similarity for r in N.bad_similarities(users, pool, excluded, bad, cfg).collect()}
    want = {}
    for u in range(4):
        for a in [a for a in range(30) if (u, a) not in hidden][:limit]:
            if vectors[a] is not None:
                want[u, a] = cosine_matrix([vectors[a]], [vectors[b] for b in disliked[u]]).max() if u in disliked else None
    assert got.keys() == want.keys()
    assert all(got[k] is None if w is None else got[k] == pytest.approx(w, abs=1e-6) for k, w in want.items())
