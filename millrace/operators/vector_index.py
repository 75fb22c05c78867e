"""Vector index: inverted lists by coarse centroid, searched exactly.

Centroids are fitted on a bounded sample; every vector is filed under its nearest one, in a partition of its own, and each cell keeps
the widest angle of its members.  A search reads the cells around the query until they hold enough vectors, which gives an angle
that the k best cannot exceed; by the triangle inequality only cells that reach into that angle can hold better ones, and those
are read too.  The result is that of a full scan.  Where the data does not separate, so many cells are read that it is one.

Vectors that are zero or of another width than the index have similarity 0 and a cell of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.config import DEFAULT
from millrace.functions.vectors import cosine_to, stack, unit_rows
from millrace.operators.profile import lloyd

SAMPLE = 5_000  # vectors the centroids are fitted on
MAX_CELLS = 256
ODD_CELL = -1
SLACK = 1e-6  # angles are compared with this tolerance


@dataclass(frozen=True)
class VectorIndex:
    """Cells of a stored index: centroid (unit), widest angle and size of each; ODD_CELL has no centroid."""

    path: str
    width: int
    cells: tuple[int, ...]
    centroids: np.ndarray
    angles: tuple[float, ...]
    sizes: tuple[int, ...]
    odd: int


def build_index(articles: DataFrame, path: str, cells: int | None = None, sample: int = SAMPLE) -> VectorIndex:
    """Index all vectors of ``articles`` (article_id, embedding) under ``path``; ``cells``: their number, by default about the
    square root of the count, at most ``MAX_CELLS``."""
    spark = articles.sparkSession
    rows = articles.filter(F.col("embedding").isNotNull()).select("article_id", F.col("embedding").cast("array<double>").alias("embedding"))
    total = rows.count()
    widths = rows.groupBy(F.size("embedding").alias("width")).agg(F.count("*").alias("n"))
    top = widths.orderBy(F.desc("n"), "width").first()
    width = top["width"] if top else 0
    share = min(1.0, sample / max(total, 1))
    drawn = rows.filter((F.size("embedding") == width) & (F.pmod(F.xxhash64("article_id"), F.lit(1 << 30)) <= int(share * (1 << 30))))
    vectors = [r.embedding for r in drawn.select("embedding").limit(2 * sample).collect()]
    points = unit_rows(np.array(vectors, dtype=np.float64).reshape(len(vectors), width))
    points = points[np.linalg.norm(points, axis=1) > 0]
    count = min(len(points), cells or min(MAX_CELLS, max(1, int(math.sqrt(total)))))
    settings = replace(DEFAULT.clustering, restarts=1, max_iterations=20)
    centroids = unit_rows(lloyd(points, count, settings)[1]) if count else np.zeros((0, width))
    shared = spark.sparkContext.broadcast(centroids)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, angle = np.full(len(batch), ODD_CELL, dtype=np.int32), np.full(len(batch), math.pi / 2)
            usable, matrix = stack(batch.column("embedding"), width)
            if len(usable) and len(shared.value):
                unit = unit_rows(matrix)
                sims = np.clip(unit @ shared.value.T, -1.0, 1.0)
                best = sims.argmax(1)
                fine = np.linalg.norm(matrix, axis=1) > 0
                cell[usable[fine]] = best[fine]
                angle[usable[fine]] = np.arccos(sims[np.arange(len(best)), best])[fine]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(angle)], names=["article_id", "embedding", "cell", "angle"])

    filed = rows.mapInArrow(file, "article_id long, embedding array<double>, cell int, angle double")
    filed.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(path)
    stats = spark.read.schema("article_id long, angle double, cell int").parquet(path).groupBy("cell").agg(F.max("angle").alias("angle"), F.count("*").alias("n")).collect()
    kept = sorted(r for r in stats if r["cell"] != ODD_CELL)
    odd = sum(r["n"] for r in stats if r["cell"] == ODD_CELL)
    ids = tuple(r["cell"] for r in kept)
    return VectorIndex(path, width, ids, centroids[list(ids)] if ids else centroids[:0], tuple(r["angle"] for r in kept), tuple(r["n"] for r in kept), odd)


def _best(spark: SparkSession, index: VectorIndex, cells: Sequence[int], query: Sequence[float], limit: int, exclude: Sequence[int]) -> list:
    rows = spark.read.schema("article_id long, embedding array<double>, cell int").parquet(index.path).filter(F.col("cell").isin(list(cells)))
    if exclude:
        rows = rows.filter(~F.col("article_id").isin(list(exclude)))
    scored = rows.select("article_id", cosine_to(query)("embedding").alias("similarity"))
    return scored.orderBy(F.desc("similarity"), "article_id").limit(limit).collect()


def search_index(spark: SparkSession, index: VectorIndex, query: Sequence[float], limit: int = 10, exclude: Sequence[int] = ()) -> tuple[DataFrame, int]:
    """(article_id, similarity) of the ``limit`` most similar vectors, ties by id, and the number of vectors read."""
    target = np.asarray(query, dtype=np.float64)
    schema = "article_id long, similarity double"
    norm = np.linalg.norm(target)
    if norm == 0 or len(target) != index.width:
        away = np.full(len(index.cells), 0.0)  # everything has similarity 0: read all
    else:
        away = np.arccos(np.clip(index.centroids @ (target / norm), -1.0, 1.0))
    reach = away - np.array(index.angles)  # no member is nearer than this
    order, sizes = np.argsort(away, kind="stable"), np.array(index.sizes)
    held = np.cumsum(sizes[order]) if len(order) else np.zeros(0)
    first = order[: int(np.searchsorted(held, limit + len(exclude))) + 1].tolist()
    found = _best(spark, index, [index.cells[i] for i in first], query, limit, exclude) if first else []
    bound = math.acos(min(1.0, max(-1.0, found[-1].similarity))) if len(found) == limit else math.pi
    rest = [i for i in range(len(reach)) if i not in set(first) and reach[i] <= bound + SLACK]
    more = [index.cells[i] for i in rest]
    if index.odd and bound + SLACK >= math.pi / 2:
        more.append(ODD_CELL)
    if more:
        found += _best(spark, index, more, query, limit, exclude)
    best = sorted(((r.article_id, r.similarity) for r in found), key=lambda r: (-r[1], r[0]))[:limit]
    read = int(sizes[first].sum() + sizes[rest].sum()) + (index.odd if ODD_CELL in more else 0)
    return spark.createDataFrame(best, schema), read
