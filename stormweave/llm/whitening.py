"""Operator 12, whitening of embeddings with block matrices.

Components become integers, and each distinct vector counts once in the fit. The distinct vectors are written and centred,
and every task takes them as blocks of rows. The scatter matrix is the sum over all blocks of the block's transpose times
the block, so a task holds one block, and a small square and the sums of its rows are all it passes on. The driver decomposes that
square (components x components, whatever the number of vectors); then blocks of the input's rows are multiplied by the
whitening matrix, so no row has to look its projection up.

Defined results: rows with a null vector, or one that holds a null, NaN or infinite entry, are left out; shorter vectors
are filled up with zeros to the longest; components of the integers are limited to +-2^30; repeated rows get one result each. Only
components of positive variance are returned, so vectors without any variance, and empty tables, give an empty result.
A deviation beyond a long is null. Each component's sign makes the largest entry of its vector positive. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormweave.session import materialize

SCALE, COMPONENTS = 256, 4
LIMIT = 1 << 30
#: Most rows of a block: 8 MB at 256 dimensions.
BLOCK_ROWS = 4096
#: A component with less variance than this share of the largest counts as none.
_FLAT = 1e-12
RESULT = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
)


class Fit(NamedTuple):
    """Mean, and the kept eigenvalues with their unit vectors as columns."""

    n: int
    total: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def whole_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and integer components `x`, all of one length, of the rows that are kept."""
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    limited = F.transform(
        "embedding",
        lambda c: F.floor(F.greatest(F.least(c.cast("double") * scale, F.lit(float(LIMIT))), F.lit(float(-LIMIT)))).cast("int"),
    )
    rows = materialize(own.filter(F.col("embedding").isNotNull() & finite).select("vec_id", limited.alias("x")), "whole-vectors")
    low, width = rows.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if low == width:
        return rows
    return rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(0), F.lit(width) - F.size("x"))))


def _blocks(batches: Iterable[pa.RecordBatch], block_rows: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Blocks of at most `block_rows` rows, and their vectors as the rows of an integer matrix."""
    for batch in batches:
        for start in range(0, batch.num_rows, block_rows):
            block = batch.slice(start, block_rows)
            yield block, block.column("x").flatten().to_numpy().astype(np.int64).reshape(block.num_rows, -1)


def _summed(rows: DataFrame, of_block: Callable[[np.ndarray], np.ndarray], kind: str, block_rows: int) -> list:
    """Sum over all blocks of the numbers that `of_block` gives for one; a task passes on its own sum, places 0 and on."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(of_block(x) for _, x in _blocks(batches, block_rows))
        if np.ndim(total):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["at", "value"])

    # Sums of a task fit a long, those of all tasks need not.
    value = F.col("value").cast("decimal(38,0)") if kind == "long" else F.col("value")
    sums = rows.select("x").mapInArrow(run, f"at long, value {kind}").groupBy("at").agg(F.sum(value).alias("total"))
    return [t for _, t in sorted(sums.collect())]


def fit_components(distinct: DataFrame, components: int = COMPONENTS, block_rows: int = BLOCK_ROWS) -> Fit:
    """The fit to distinct vectors; the first sum is their number, the others are those of their dimensions."""
    n, *total = [int(t) for t in _summed(distinct, lambda x: np.append(len(x), x.sum(axis=0)), "long", block_rows)] or [0]
    if not total or n < 2:
        return Fit(n, total, np.zeros(0), np.zeros((len(total), 0)), 0.0)
    mean = np.array([t / n for t in total])

    def scatter(x: np.ndarray) -> np.ndarray:
        centred = x - mean
        return (centred.T @ centred).ravel()

    covariance = np.reshape(_summed(distinct, scatter, "double", block_rows), (len(total), len(total))) / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > _FLAT * values.max()]
    vectors = vectors[:, order]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))])
    return Fit(n, total, values[order], vectors, float(np.trace(covariance)))


def deviations(x: np.ndarray, fit: Fit) -> pa.Array:
    """Sum over dimensions of (n x - total)^2 of each row, exact; null beyond a long."""
    # Longs wrap around, so the sum is right but for multiples of 2^64, and doubles tell whether there are any.
    wrapped = np.array([(t + (1 << 63)) % (1 << 64) - (1 << 63) for t in fit.total], np.int64)
    exact = ((fit.n * x - wrapped) ** 2).sum(axis=1)
    rough = ((float(fit.n) * x - np.array(fit.total, float)) ** 2).sum(axis=1)
    return pa.array(exact, mask=(exact < 0) | (rough > 1.5 * 2.0**63))


def project(rows: DataFrame, fit: Fit, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The rows with `deviation` and `whitened`, the coordinates on the components, in place of `x`."""
    weights = fit.vectors / np.sqrt(fit.values)
    mean = np.array([t / fit.n for t in fit.total])
    others = [c for c in rows.columns if c != "x"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, x in _blocks(batches, block_rows):
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * weights.shape[1])
            whitened = pa.ListArray.from_arrays(offsets, pa.array(((x - mean) @ weights).ravel()))
            columns = [*[block.column(c) for c in others], deviations(x, fit), whitened]
            yield pa.RecordBatch.from_arrays(columns, [*others, "deviation", "whitened"])

    kept = "".join(f"`{n}` {t}, " for n, t in rows.select(*others).dtypes)
    return rows.mapInArrow(run, f"{kept}deviation long, whitened array<double>")


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """A row for each kept row and component, numbered by falling variance; runs jobs when called."""
    rows = whole_vectors(vectors, scale)
    distinct = materialize(rows.select("x").distinct(), "distinct-vectors")
    fit = fit_components(distinct, components, block_rows)
    if not len(fit.values):
        return vectors.sparkSession.createDataFrame([], RESULT)
    c = len(fit.values)
    pairs = [(i, j) for i in range(c) for j in range(i, c)]
    spread = project(distinct, fit, block_rows).agg(*[F.covar_pop(F.get("whitened", i), F.get("whitened", j)) for i, j in pairs]).first()
    error = max(abs(v - (i == j)) for v, (i, j) in zip(spread, pairs, strict=True))
    explained = F.array(*[F.lit(float(e / fit.trace)) for e in fit.values])
    return (
        project(rows, fit, block_rows)
        .select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
        .select(
            "vec_id", (F.col("at") + 1).alias("component"), F.lit(fit.n).cast("long").alias("n"), "deviation", "whitened",
            F.get(explained, F.col("at")).alias("explained"), F.lit(float(error)).alias("identity_error"),
        )
    )
