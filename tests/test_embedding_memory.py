"""Embedding hands vectors on in small batches, however many rows an Arrow batch has."""

import numpy as np
from pyspark.sql import functions as F

from millrace.plans.enrich import DIMENSIONS, ROWS_OUT, embed_changed


def test_vectors_leave_in_small_batches(spark):
    rows = spark.range(3000, numPartitions=1).select(
        F.col("id").alias("article_id"), F.lit("t").alias("title"), F.col("id").cast("string").alias("body"), F.lit("h").alias("body_hash"),
        F.lit(None).cast("array<float>").alias("embedding"), F.lit(None).cast("string").alias("embedded_body_hash"),
    )

    def embedder(texts):
        import gc

        alive = sum(len(o) for o in gc.get_objects() if isinstance(o, list) and len(o) > 1000 and all(isinstance(t, str) and t.startswith("t\n\n") for t in o))
        return np.full((len(texts), DIMENSIONS), float(alive))

    got = embed_changed(rows, embedder).select("article_id", F.size("embedding").alias("n"), F.get("embedding", F.lit(0)).alias("alive")).collect()
    assert len(got) == 3000 and {r.n for r in got} == {DIMENSIONS} and len({r.article_id for r in got}) == 3000
    assert {r.alive for r in got} == {0.0}  # 3,000 texts of the batch in one list before
    assert ROWS_OUT * DIMENSIONS * 8 <= 4 << 20
