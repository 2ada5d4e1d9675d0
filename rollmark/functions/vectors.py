"""Vector expressions on array columns. Elements are cast to double before arithmetic."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

NORM_FLOOR = 1e-10


def as_double(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(as_double(left), as_double(right), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def euclidean(left: Column, right: Column) -> Column:
    squares = F.zip_with(as_double(left), as_double(right), lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda total, x: total + x))


def norm(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))


def normalise(vector: Column) -> Column:
    """Unit vector for storage; the norm is floored so that zero vectors stay finite."""
    size = F.greatest(norm(vector), F.lit(NORM_FLOOR))
    return F.transform(as_double(vector), lambda x: x / size)


def normalise_query(vector: Column) -> Column:
    """Unit vector for search; a zero vector is left as it is."""
    size = norm(vector)
    return F.when(size > 0, F.transform(as_double(vector), lambda x: x / size)).otherwise(as_double(vector))


def is_finite(vector: Column) -> Column:
    bad = [float("inf"), float("-inf")]
    return F.forall(as_double(vector), lambda x: x.isNotNull() & ~F.isnan(x) & ~x.isin(*bad))


def _pair_arrays(left: pa.Array, right: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows where both vectors exist and are equally long, and their flat double elements."""
    sizes, others = pc.list_value_length(left), pc.list_value_length(right)
    usable = pc.fill_null(pc.equal(sizes, others), False)
    sides = [side.filter(usable).flatten().to_numpy(zero_copy_only=False).astype(np.float64) for side in (left, right)]
    return usable.to_numpy(zero_copy_only=False), sides[0], sides[1]


def _reduced(left: pa.Array, right: pa.Array, terms: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple:
    usable, a, b = _pair_arrays(left, right)
    sizes = pc.list_value_length(left).to_numpy(zero_copy_only=False)[usable].astype(np.int64)
    sums = np.zeros(len(sizes))
    full = sizes > 0
    if full.any():
        starts = np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
        sums[full] = np.add.reduceat(terms(a, b), starts)
    out = np.zeros(len(left))
    out[usable] = sums
    return out, ~usable


@F.arrow_udf(T.DoubleType())
def batch_dot(left: pa.Array, right: pa.Array) -> pa.Array:
    """Dot products of two vector columns, a batch at a time; NULL for missing or unequal vectors."""
    sums, missing = _reduced(left, right, np.multiply)
    return pa.array(sums, mask=missing)


@F.arrow_udf(T.DoubleType())
def batch_euclidean(left: pa.Array, right: pa.Array) -> pa.Array:
    """Euclidean distances of two vector columns, a batch at a time."""
    sums, missing = _reduced(left, right, lambda a, b: (a - b) ** 2)
    return pa.array(np.sqrt(sums), mask=missing)


def score(left: Column, right: Column, metric: str) -> Column:
    """Cosine similarity of unit vectors (dot product) or Euclidean distance.

    Lambda functions on arrays are interpreted element by element; Arrow batches are many
    times faster for long pair tables.
    """
    if metric == "cosine":
        return batch_dot(left, right)
    if metric == "euclidean":
        return batch_euclidean(left, right)
    raise ValueError(f"unknown metric: {metric!r}")


def centroids(members: DataFrame, group_col: str = "identity", vector_col: str = "embedding") -> DataFrame:
    """Mean vector per group, renormalised unless it is zero.

    Elements are averaged by (group, index) with map-side combine, so a hot group sends one
    partial row per index and task, not its members.
    """
    averaged = (
        members.select(group_col, F.posexplode(as_double(F.col(vector_col))).alias("pos", "x"))
        .groupBy(group_col, "pos")
        .agg(F.avg("x").alias("x"))
    )
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda e: e["x"])
    return averaged.groupBy(group_col).agg(normalise_query(ordered).alias(vector_col))


def vector_report(vectors: DataFrame, dim: int, vector_col: str = "embedding", tolerance: float = 1e-4) -> DataFrame:
    """One-row sanity report: dimension, finiteness, unit norms, and that vectors differ."""
    v = F.col(vector_col)
    size = norm(v)
    return vectors.where(v.isNotNull()).agg(
        F.count(F.lit(1)).alias("vectors"),
        F.count_if(F.size(v) != dim).alias("wrong_dimension"),
        F.count_if(~is_finite(v)).alias("non_finite"),
        F.coalesce(F.bool_and(F.abs(size - 1.0) <= tolerance), F.lit(False)).alias("unit_norm"),
        F.min(size).alias("min_norm"),
        F.max(size).alias("max_norm"),
        (F.min(F.xxhash64(v)) != F.max(F.xxhash64(v))).alias("distinct_vectors"),
    )


def split_by_dimension(vectors: DataFrame, dim: int, vector_col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """Rows of the right dimension, and the others for quarantine."""
    fits = F.coalesce(F.size(F.col(vector_col)) == dim, F.lit(False))
    return vectors.where(fits), vectors.where(~fits)
