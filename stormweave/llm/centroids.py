"""Operator 11, centroid clustering with Ptolemaic pivots.

Vectors become integers, so distances are exact. The first centroids are the pivots, each paired with the one farthest
from it; each vector's distances to them are computed once and written beside it. Ptolemy's inequality, valid in
Euclidean space, bounds the distance of a vector x and a centroid c from below for every pair of pivots p, q:

    d(x, c) >= |d(x, p) d(c, q) - d(x, q) d(c, p)| / d(p, q)

The numerator is lowered and the denominator raised by more than floating point can have lost, so a centroid is ruled
out only if it is farther than the best one known, and ties survive. The survivors are measured exactly, in integers.
In the first round the bounds are all but exact; later they are as good as clusters are compact and centroids stay near.

A round is one pass over the written table. Each task adds up its vectors per centroid and hands on one row per
centroid; Spark adds those by centroid and component. The driver holds the centroids and pivots only: 2 x
clusters x components numbers, whatever the data. A third of all vectors in one cluster is a third of every task's batch and one row of its sums.

Defined results: vectors that are null, have another number of components or hold a null, NaN or infinite entry are left
out; null ids count as the largest hash; ties among seeds go by the components; repeated rows count each; with fewer
vectors than clusters each starts one; an empty table gives an empty result. Components are limited to +-2^27, far
beyond any embedding, which keeps squared distances below 2^63; a total beyond a long is null. Other columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormweave.session import materialize

COMPONENTS, SCALE, CLUSTERS, ROUNDS = 64, 64, 16, 3
#: Largest absolute value of a component as an integer.
LIMIT = 1 << 27
#: More than the relative rounding error of a bound's products and roots, which is some 2^-51.
_SLACK = 2.0**-48


class Clusters(NamedTuple):
    """`assigned` (vec_id, cluster, distance, checked: centroids measured exactly) and the final centroids."""

    assigned: DataFrame
    centroids: np.ndarray


def whole_vectors(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """vec_id and integer components `x` of the vectors that are kept."""
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    limited = F.transform(
        "embedding",
        lambda c: F.floor(F.greatest(F.least(c.cast("double") * scale, F.lit(float(LIMIT))), F.lit(float(-LIMIT)))).cast("int"),
    )
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return own.filter((F.size("embedding") == components) & finite).select("vec_id", limited.alias("x"))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of `a` (int64) to one vector or to rows of their own."""
    gap = a - b
    return np.einsum("ij,ij->i", gap, gap)


def to_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.stack([squared(x, p) for p in pivots], axis=1).astype(np.float64))


def pivots_of(seeds: np.ndarray) -> np.ndarray:
    """The different seeds."""
    return np.unique(seeds, axis=0)


def pivot_pairs(pivots: np.ndarray) -> list[tuple[int, int, float]]:
    """Each pivot with the one farthest from it, and how far they are apart."""
    apart = np.stack([np.sqrt(squared(pivots, p).astype(np.float64)) for p in pivots])
    far = apart.argmax(axis=1)
    return sorted({(min(p, q), max(p, q), float(apart[p, q])) for p, q in enumerate(far.tolist()) if p != q})


def lower_bounds(x_pivots: np.ndarray, c_pivots: np.ndarray, pairs: list[tuple[int, int, float]]) -> np.ndarray:
    """For each vector and centroid, a number that is never above their squared distance."""
    bound = np.zeros((len(x_pivots), len(c_pivots)))
    for p, q, apart in pairs:
        one, two = np.outer(x_pivots[:, p], c_pivots[:, q]), np.outer(x_pivots[:, q], c_pivots[:, p])
        np.maximum(bound, (np.abs(one - two) - _SLACK * (one + two)) / (apart * (1 + _SLACK)), out=bound)
    return bound * bound * (1 - _SLACK)


def nearest(x: np.ndarray, x_pivots: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, ...]:
    """Number of the nearest centroid (ties: the smallest), exact squared distance, and centroids measured, of each vector."""
    bound = lower_bounds(x_pivots, to_pivots(centroids, pivots), pivot_pairs(pivots))
    label = bound.argmin(axis=1)
    first = label.copy()
    best = squared(x, centroids[label])
    checked = np.ones(len(x), np.int32)
    for c in range(len(centroids)):
        rows = np.flatnonzero((bound[:, c] <= best) & (first != c))
        if len(rows):
            found = squared(x[rows], centroids[c])
            checked[rows] += 1
            better = (found < best[rows]) | ((found == best[rows]) & (c < label[rows]))
            label[rows[better]], best[rows[better]] = c, found[better]
    return label, best, checked


def _matrix(column: pa.Array, rows: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1).astype(kind, copy=False)


def _batches(task: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    return lambda batches: task(b for b in batches if b.num_rows)


def _with_pivots(kept: DataFrame, pivots: np.ndarray) -> DataFrame:
    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = to_pivots(_matrix(b.column("x"), b.num_rows, np.int64), pivots)
            offsets = np.arange(b.num_rows + 1, dtype=np.int32) * found.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("x"), lists], ["vec_id", "x", "to_pivots"])

    return kept.mapInArrow(_batches(measure), "vec_id long, x array<int>, to_pivots array<double>")


def _sums(measured: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> DataFrame:
    """cluster, component, n and total: what a round moves the centroids to."""

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
        for b in batches:
            x = _matrix(b.column("x"), b.num_rows, np.int64)
            label, _, _ = nearest(x, _matrix(b.column("to_pivots"), b.num_rows, np.float64), centroids, pivots)
            count += np.bincount(label, minlength=len(centroids))
            for c in np.unique(label):
                total[c] += x[label == c].sum(axis=0)
        full = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict(
            {"cluster": pa.array(full, pa.int32()), "n": pa.array(count[full], pa.int64()),
             "total": pa.array([row.tolist() for row in total[full]], pa.list_(pa.int64()))}
        )

    parts = measured.select("x", "to_pivots").mapInArrow(_batches(add), "cluster int, n long, total array<long>")
    each = parts.select("cluster", "n", F.posexplode("total").alias("component", "total"))
    return each.groupBy("cluster", "component").agg(
        F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")
    )


def cluster(
    vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, components: int = COMPONENTS, scale: int = SCALE
) -> Clusters:
    """Exact rounds of nearest-centroid assignment; runs jobs when called and writes the vectors with their pivot distances."""
    kept = whole_vectors(vectors, components, scale)
    order = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256).asc_nulls_last()
    # Bounded by the number of clusters.
    seeds = np.array([r.x for r in kept.orderBy(order, "x").limit(clusters).collect()], np.int64).reshape(-1, components)
    spark = vectors.sparkSession
    if not len(seeds):
        return Clusters(spark.createDataFrame([], "vec_id long, cluster int, distance long, checked int"), seeds)
    fixed = pivots_of(seeds)
    measured = materialize(_with_pivots(kept, fixed), "pivot-distances")
    centroids = seeds
    for _ in range(rounds):
        moved = centroids.copy()
        # One row per cluster and component.
        for r in _sums(measured, centroids, fixed).collect():
            moved[r.cluster, r.component] = int(r.total) // r.n
        centroids = moved

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x_pivots = _matrix(b.column("to_pivots"), b.num_rows, np.float64)
            label, best, checked = nearest(_matrix(b.column("x"), b.num_rows, np.int64), x_pivots, centroids, fixed)
            columns = [b.column("vec_id"), pa.array(label, pa.int32()), pa.array(best), pa.array(checked)]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance", "checked"])

    found = measured.mapInArrow(_batches(assign), "vec_id long, cluster int, distance long, checked int")
    return Clusters(materialize(found, "assigned"), centroids)


def digest(found: Clusters) -> DataFrame:
    """Every vector with its cluster, the inertia of that and of all, and the hash of the final centroid."""
    spark = found.assigned.sparkSession
    names = [(n, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for n, c in enumerate(found.centroids.tolist())]
    named = spark.createDataFrame(names, "cluster int, centroid_sha256 string")
    sums = found.assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inside"))
    # One row per cluster.
    all_of_them = sums.agg(F.sum("inside")).scalar()
    per_cluster = sums.join(named, "cluster").select(
        "cluster", F.col("inside").try_cast("long").alias("cluster_inertia"),
        all_of_them.try_cast("long").alias("inertia"), "centroid_sha256",
    )
    return found.assigned.drop("checked").join(F.broadcast(per_cluster), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
