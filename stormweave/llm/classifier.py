"""Operator 7, quality classifier: a linear hinge-loss model on n-gram indicators scaled by log-count ratios.

Features of a text are the set of its words and word pairs and of their shapes (runs of letters, capitals, digits and
each symbol), hashed to `BUCKETS` places. The model is fitted on a bounded sample of labelled rows: log-count ratios
of the two classes scale the indicators, dual coordinate descent solves the hinge-loss problem, and the weights are
drawn towards their mean as support vectors on naive Bayes features are. Only feature sets of the sample reach the
driver, at most `SAMPLE_ROWS` rows. Scoring reads every whole text once, in Arrow batches, without an exchange.

Inputs of a score are words of the text, nothing else. Defined results: null and empty texts get the score of a text
without features; labels that are null are ignored, of repeated labels the lowest counts; with labels of one class
only, or none, all scores are 1, 0 or 0.5; repeated rows are scored one by one; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormweave.llm import ngrams
from stormweave.llm.words import texts

BUCKETS = 1 << 20
#: Labelled rows a model is fitted on at most.
SAMPLE_ROWS = 4000
_BITS = 20
_SALTS = [np.uint64(s) for s in (0x0, 0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0)]


def features(joined: bytes, lengths: np.ndarray) -> np.ndarray:
    """Distinct (text << bits | feature) of a chunk, sorted."""
    words = ngrams.hash_words(ngrams.folded(joined, ngrams.SPACES), lengths)
    shape = ngrams.folded(joined, ngrams.SHAPES)
    change = np.ones(len(shape), bool)
    np.not_equal(shape[1:], shape[:-1], out=change[1:])
    change |= shape == 32
    ends = np.concatenate([[0], np.cumsum(change)])[np.concatenate([[0], np.cumsum(lengths)])]
    shapes = ngrams.hash_words(shape[change], np.diff(ends))
    pairs, at = ngrams.grams(words, 2)
    shape_pairs, _ = ngrams.grams(shapes, 2)
    same = (words.hashes[at] == words.hashes[at + 1]).astype(np.uint64)
    owner = words.owner.astype(np.uint64)
    keys = []
    for salt, hashes, of in (
        (_SALTS[0], words.hashes, owner),
        (_SALTS[1], pairs, owner[at]),
        (_SALTS[2], shapes.hashes, owner),
        (_SALTS[3], shape_pairs + same, owner[at]),
    ):
        keys.append((of << np.uint64(_BITS)) | (ngrams.mix(hashes ^ salt) >> np.uint64(64 - _BITS)))
    return np.unique(np.concatenate(keys))


@dataclass(frozen=True)
class Model:
    """Weight of each feature and the bias."""

    weights: np.ndarray
    bias: float

    def margins(self, joined: bytes, lengths: np.ndarray) -> np.ndarray:
        keys = features(joined, lengths)
        owner, feature = (keys >> np.uint64(_BITS)).astype(np.int64), (keys & np.uint64(BUCKETS - 1)).astype(np.int64)
        return self.bias + np.bincount(owner, self.weights[feature], minlength=len(lengths))


def fit(rows: Sequence[np.ndarray], labels: np.ndarray, cost: float = 1.0, rounds: int = 12, blend: float = 0.25) -> Model:
    """Fit on feature sets; `labels` holds 0 and 1."""
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(BUCKETS, np.float32), 0.0 if not len(labels) else 40.0 if labels[0] == 1 else -40.0)
    counts = np.ones((2, BUCKETS))
    for row, label in zip(rows, labels, strict=True):
        counts[int(label), row] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    seen = counts.sum(axis=0) > 2
    ratio[~seen] = 0.0
    weights, bias = _dual_coordinate_descent(rows, np.where(labels == 1, 1.0, -1.0), ratio, cost, rounds)
    level = np.abs(weights[seen]).mean()
    weights = (1 - blend) * level * np.sign(weights) + blend * weights
    # Scaled to the sample: a typical margin of a correct row is 1.
    margins = np.array([(weights[row] * ratio[row]).sum() for row in rows]) + bias
    # The blended weights need a threshold of their own: midway between the classes' near quartiles.
    high, low = np.quantile(margins[labels == 1], 0.1), np.quantile(margins[labels == 0], 0.9)
    width = max(np.median(np.abs(margins - (high + low) / 2)), 1e-9)
    return Model((3 * weights * ratio / width).astype(np.float32), float(3 * (bias - (high + low) / 2) / width))


def _dual_coordinate_descent(
    rows: Sequence[np.ndarray], signs: np.ndarray, ratio: np.ndarray, cost: float, rounds: int
) -> tuple[np.ndarray, float]:
    """Hinge loss with an L2 penalty: one dual variable per row, moved within [0, cost] in turn."""
    weights, bias = np.zeros(BUCKETS), 0.0
    values = [ratio[row] for row in rows]
    norms = np.array([v @ v + 1.0 for v in values])
    dual = np.zeros(len(rows))
    order = np.random.default_rng(7)
    for _ in range(rounds):
        largest = 0.0
        for i in order.permutation(len(rows)):
            row, value, sign = rows[i], values[i], signs[i]
            slope = sign * (weights[row] @ value + bias) - 1
            new = min(max(dual[i] - slope / norms[i], 0.0), cost)
            if new != dual[i]:
                step = (new - dual[i]) * sign
                weights[row] += step * value
                bias += step
                largest = max(largest, abs(new - dual[i]) * norms[i])
                dual[i] = new
        if largest < 1e-3:
            break
    return weights, bias


def held_out(doc_id: Column) -> Column:
    """Rows that are never learnt from."""
    return F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model of `labels.quality`, from at most `sample_rows` labelled rows in the order of a hash of their id."""
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
        .filter(F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample_rows)
    )
    sample = texts(docs).join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).select("label", "text")

    def extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = []
            for _, _, joined, lengths in ngrams.chunks(batch.column(1).to_pylist()):
                keys = features(joined, lengths)
                bounds = np.searchsorted(keys, np.arange(1, len(lengths), dtype=np.uint64) << np.uint64(_BITS))
                sets += np.split((keys & np.uint64(BUCKETS - 1)).astype(np.int32), bounds)
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int32()))], ["label", "features"])

    found = sample.mapInArrow(extract, "label int, features array<int>").toArrow()
    order = sorted(
        ((y, np.array(x, np.int64)) for y, x in zip(found["label"].to_pylist(), found["features"].to_pylist(), strict=True)),
        key=lambda r: (len(r[1]), r[1].tobytes(), r[0]),
    )
    return fit([x for _, x in order], np.array([y for y, _ in order], int))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score in [0, 1] and predicted class of each text."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))  # of fixed size

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [Model(*shared.value).margins(j, n) for _, _, j, n in ngrams.chunks(batch.column(1).to_pylist())]
            if parts:
                scores = 1 / (1 + np.exp(-np.clip(np.concatenate(parts), -40, 40)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))],
                    ["doc_id", "score", "predicted"],
                )

    return texts(docs).mapInArrow(run, "doc_id bigint, score double, predicted int")
