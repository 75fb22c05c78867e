"""k-means invariants and cluster labels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.config import DEFAULT
from millrace.operators.profile import assign_clusters, cluster_sizes, interest_clusters, lloyd

SCHEMA = "user_id long, article_id long, position int, weight double, topics array<string>, embedding array<float>"


def test_lloyd_separates_groups():
    rng = np.random.default_rng(0)
    points = np.vstack([rng.normal(c * 10, 0.1, size=(20, 4)) for c in range(4)])
    labels, centers = lloyd(points, 4, DEFAULT.clustering)
    groups = [set(labels[i * 20 : i * 20 + 20]) for i in range(4)]
    assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 4
    for k in range(4):
        assert centers[k] == pytest.approx(points[labels == k].mean(0))
    again, _ = lloyd(points, 4, DEFAULT.clustering)
    assert (again == labels).all()


def test_clusters_of_users(spark):
    rows = []
    for i in range(12):
        side = [1.0, 0.0] if i < 6 else [0.0, 1.0]
        rows.append((1, i, i + 1, 1.0 if i < 6 else 3.0, ["b", "a"] if i < 6 else ["z"], side))
    rows += [(2, 1, 1, 0.0, [], [1.0, 0.0]), (3, 1, 1, 1.0, ["x"], None)]
    members = assign_clusters(spark.createDataFrame(rows, SCHEMA))
    clusters = interest_clusters(members)
    got = {(r["user_id"], r["place"]): r for r in clusters.collect()}
    assert {u for u, _ in got} == {1, 2}
    first, second = got[1, 1], got[1, 2]
    assert first["label"] == "z" and first["weight"] == pytest.approx(0.75)
    assert second["topics"] == ["a", "b"] and second["label"] == "a / b" and second["weight"] == pytest.approx(0.25)
    assert sum(r["weight"] for (u, _), r in got.items() if u == 1) == pytest.approx(1.0)
    alone = got[2, 1]
    assert alone["label"].endswith("#0") and alone["weight"] == 1.0
    sizes = cluster_sizes(spark.createDataFrame(rows, SCHEMA).filter(F.col("embedding").isNotNull()), clusters)
    assert {(r["user_id"], r["place"]): r["article_count"] for r in sizes.collect()} == {
        k: r["article_count"] for k, r in got.items()
    }


def test_small_users_share_a_pass():
    from millrace.operators.kmeans import CENTRE_BYTES, users_at_once

    assert users_at_once(4, 4) > 1500  # 64 before
    assert users_at_once(10, 1024) * 101 * 1024 * 8 <= CENTRE_BYTES
    assert users_at_once(10**6, 10**6) == 1
