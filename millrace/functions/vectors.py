"""Vector maths: JVM expression for single pairs, Arrow kernels for scans, numpy for task-local blocks."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def cosine(left: Column, right: Column) -> Column:
    """Cosine of two array columns; unequal length, empty, zero norm or null gives 0.0."""

    def dot(a: Column, b: Column) -> Column:
        products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)

    norms = F.sqrt(dot(left, left)) * F.sqrt(dot(right, right))
    comparable = (F.size(left) == F.size(right)) & (F.size(left) > 0)
    return F.when(comparable & (norms > 0), dot(left, right) / norms).otherwise(F.lit(0.0))


def cosine_to(query: Sequence[float]):
    """Arrow UDF: cosine of every vector of a column to one query vector."""
    target = np.asarray(query, dtype=np.float64)
    norm = float(np.linalg.norm(target))

    @F.arrow_udf("double")
    def similarity(vectors: pa.Array) -> pa.Array:
        out = np.zeros(len(vectors))
        usable, matrix = stack(vectors, len(target))
        if norm > 0 and len(usable):
            norms = np.linalg.norm(matrix, axis=1)
            safe = np.where(norms > 0, norms, 1.0)
            out[usable] = np.where(norms > 0, matrix @ target / (safe * norm), 0.0)
        return pa.array(out, mask=np.asarray(vectors.is_null()))

    return similarity


def stack(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and matrix of the vectors with ``width`` elements (no per-row Python)."""
    lengths = np.asarray(vectors.value_lengths().fill_null(-1))
    usable = np.flatnonzero(lengths == width)
    if width == 0 or not len(usable):
        return usable[:0], np.zeros((0, width))
    flat = vectors.take(pa.array(usable)).flatten()
    return usable, np.asarray(flat, dtype=np.float64).reshape(-1, width)


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; zero rows stay zero."""
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms == 0, 1.0, norms)


def by_width(vectors: Sequence) -> dict[int, list[int]]:
    """Positions of the non-null vectors per length."""
    groups: dict[int, list[int]] = {}
    for position, vector in enumerate(vectors):
        if vector is not None:
            groups.setdefault(len(vector), []).append(position)
    return groups


def cosine_matrix(left: Sequence, right: Sequence) -> np.ndarray:
    """Pairwise cosine of two bounded lists; pairs of unequal length get 0.0."""
    out = np.zeros((len(left), len(right)))
    right_groups = by_width(right)
    for width, rows in by_width(left).items():
        columns = right_groups.get(width, [])
        if width == 0 or not columns:
            continue
        a = unit_rows(np.array([left[i] for i in rows], dtype=np.float64))
        b = unit_rows(np.array([right[j] for j in columns], dtype=np.float64))
        out[np.ix_(rows, columns)] = a @ b.T
    return out
