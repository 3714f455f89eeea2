"""Operator 12: centroid clustering with exact integer dot products that follow the centroids' changes."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cityflow.llm.common import discard, settle, ship

STATE = "vec_id long, vector array<int>, dots array<long>, cluster int, distance long"


def largest(dims: int) -> int:
    """Integer components lie below this in absolute value, so that products and distances fit 64 bits."""
    return math.isqrt(2**60 // dims)


def _integers(vectors: DataFrame, dims: int, factor: int) -> DataFrame:
    """(vec_id, vector) of the rows that are kept."""
    fits = F.forall("embedding", lambda x: F.coalesce(F.abs(x) * factor < largest(dims) - 1, F.lit(False)))
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    whole = F.transform("embedding", lambda x: F.floor(x * factor).cast("int")).alias("vector")
    return rows.where((F.size("embedding") == dims) & fits).select("vec_id", whole)


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    ends = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel(), kind))


def _followed(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, change: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The state after the centroids' change: products move by the changed components only, then the nearest
    centroid is looked up again."""
    lengths = (centroids * centroids).sum(1)
    moved = [(c, np.flatnonzero(row)) for c, row in enumerate(change) if row.any()]
    for batch in batches:
        if not batch.num_rows:
            continue
        vectors = _matrix(batch.column("vector"), np.int64)
        if "dots" in batch.schema.names:
            dots = _matrix(batch.column("dots"), np.int64)
        else:
            dots = np.zeros((len(vectors), len(centroids)), np.int64)
        for c, parts in moved:
            dots[:, c] += vectors[:, parts] @ change[c, parts]
        far = lengths - 2 * dots
        cluster = far.argmin(1)  # the first of equals
        distance = far[np.arange(len(far)), cluster] + (vectors * vectors).sum(1)
        columns = [
            batch.column("vec_id"),
            _lists(vectors, pa.int32()),
            _lists(dots, pa.int64()),
            pa.array(cluster, pa.int32()),
            pa.array(distance, pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["vec_id", "vector", "dots", "cluster", "distance"])


def _means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid's new place: the floor of the exact mean of its vectors; without vectors it stays.

    Sums are added up in the tasks first: a cluster that holds most vectors arrives as one row a task.
    """
    sums = [F.sum(F.element_at("vector", i + 1).cast("long")).alias(f"s{i}") for i in range(centroids.shape[1])]
    out = centroids.copy()
    for row in state.groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect():  # a row for each centroid
        out[row[0]] = [s // row[1] for s in row[2:]]
    return out


def clustered(vectors: DataFrame, k: int, rounds: int, dims: int, factor: int = 256, salt: str = "2") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector of (vec_id, embedding)
    that is kept: those of exactly ``dims`` components, none null or non-finite.

    Components become floor(factor * x). Centroids start as the ``k`` kept vectors of smallest
    sha256(``salt``:vec_id) in hexadecimal, in that order (all of them, if there are fewer; equal ids by
    their vectors; a null id is never one). Each round assigns all vectors to the nearest centroid (squared
    Euclidean distance; ties to the smaller number) and moves each centroid to the floor of the exact mean
    of its vectors; one without vectors stays. After the last round vectors are assigned once more; if no centroid
    moves any more, the rounds left change nothing and are not run. Vectors with an integer component of
    ``largest(dims)`` or more (2**27 for 64) are not kept, since their distances may not fit a long. An inertia that does not fit is null.
    Repeated rows are vectors of their own, extra columns are ignored; an empty table gives no rows.

    Vectors and their integer products with all centroids are kept in a table; a round reads it, adds
    what the changed components make of each product, and writes the next one. Only centroids, sums and counts,
    k rows each, reach the driver and go back to the tasks.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = _integers(vectors, dims, factor)
    chosen = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    first = rows.where("vec_id is not null").orderBy(chosen, "vector").limit(k).collect()
    centroids = np.array([r.vector for r in first], np.int64).reshape(-1, dims)
    if not len(centroids):
        kinds = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return spark.createDataFrame([], kinds)
    state, change = rows, centroids
    for step in range(rounds + 1):
        follow = lambda it, c=centroids, d=change: _followed(it, c, d)
        held, state = state, settle(state.mapInArrow(follow, STATE), "centroid-state")
        if step:
            discard(held)
        if step == rounds:
            break
        moved = _means(state, centroids)
        change = moved - centroids
        if not change.any():
            break
        centroids = moved
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    inertias = state.groupBy("cluster").agg(wide("distance").alias("n")).collect()
    total = sum(int(r.n) for r in inertias)
    fits = lambda n: int(n) if n < 2**63 else None
    named = [
        (r.cluster, fits(r.n), fits(total), hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest())
        for r in inertias
    ]
    names = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(names), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
