"""Global orders and running totals against plain Python, with one key holding a third of the rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import distributed as D


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    data = [(i, "hot" if i % 3 == 0 else f"k{rng.randrange(40)}", rng.randrange(50)) for i in range(1500)]
    rng.shuffle(data)
    return data, spark.createDataFrame(data, "id long, key string, value long").repartition(4)


def test_ordered_index(rows):
    data, df = rows
    got = {r["id"]: r["row_index"] for r in D.ordered_index(df, F.col("key"), F.col("id").desc()).collect()}
    want = sorted(data, key=lambda r: (r[1], -r[0]))
    assert got == {r[0]: i for i, r in enumerate(want)}


def test_running_total(rows):
    data, df = rows
    got = {r["id"]: r["total_before"] for r in D.running_total(df, [F.col("key"), F.col("id")], "value").collect()}
    total, want = 0, {}
    for i, _, value in sorted(data, key=lambda r: (r[1], r[0])):
        want[i] = total
        total += value
    assert got == want


def test_ordered_lag(rows):
    data, df = rows
    got = {r["id"]: r["prev_value"] for r in D.ordered_lag(df, ["key"], ["id"], ["value"]).collect()}
    last, want = {}, {}
    for i, key, value in sorted(data):
        want[i] = last.get(key)
        last[key] = value
    assert got == want


def test_exact_percentiles(rows):
    data, df = rows
    fractions = {"p0": 0.0, "p37": 0.37, "p50": 0.5, "p100": 1.0}
    row = D.exact_percentiles(df, "value", fractions).first()
    for name, f in fractions.items():
        assert row[name] == pytest.approx(np.percentile([r[2] for r in data], f * 100))
    by_key = {r["key"]: r["p37"] for r in D.exact_percentiles(df, "value", {"p37": 0.37}, ["key"]).collect()}
    for key, value in by_key.items():
        assert value == pytest.approx(np.percentile([r[2] for r in data if r[1] == key], 37))


def test_average_ranks(spark):
    df = spark.createDataFrame([(10.0,), (20.0,), (20.0,), (30.0,)], "v double")
    got = {r["value"]: r["average_rank"] for r in D.average_ranks(D.value_counts(df, "v")).collect()}
    assert got == {10.0: 1.0, 20.0: 2.5, 30.0: 4.0}


def test_first_per_key(rows):
    data, df = rows
    got = {r["key"]: r["id"] for r in D.first_per_key(df, ["key"], F.struct("value", "id")).collect()}
    want = {}
    for i, key, value in data:
        want[key] = min(want.get(key, (value, i)), (value, i))
    assert got == {k: v[1] for k, v in want.items()}
