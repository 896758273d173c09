"""Operator 1, benchmark decontamination by greedy string tiling.

Texts and benchmark items are compared as words (letters and digits, lower-cased). Windows of `SEED` words are
fingerprinted by a rolling hash; a window of a document that is also a window of an item is a seed. For each document
and item with enough seeds, maximal matches are read off the seeds along their diagonals (Karp-Rabin: equal
fingerprints of consecutive windows extend a match word by word), the longest match whose words are unmarked in both
texts is marked as a tile, matches it overlaps are cut back, and so on until none of `SEED` words is left. Tiles may
stand in any order, so reordered passages add up: a document is contaminated by an item if tiles cover `COVERAGE` of it.

Documents are read once, whole; a bit table of fixed size holds the item windows, so only seeds leave the scan. A window
that very many documents hold (a prompt, a notice) brings no pair about: of each item as many of its most frequent
windows are set aside as cover less than `COVERAGE` of its words, so a document that holds no other window of the item
can't be contaminated by it, and documents meet items on the other windows only. The pairs that met then get all their
seeds back, those set aside too, by joins whose smaller side Spark chooses by size: a benchmark of any size works. A
group is the seeds of one document with one item.

Defined results: null and empty texts and items match nothing, nor do items shorter than `SEED` words; items with a null
id have the null as their id; repeated document rows give repeated rows; empty tables give an empty result; no other
columns are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormweave.llm import ngrams
from stormweave.llm.bits import BitTable
from stormweave.llm.words import texts
from stormweave.session import materialize

#: Words of a seed, which is the shortest match; share of an item's words that tiles must cover.
SEED, COVERAGE = 5, 0.6


def tiles(at: np.ndarray, item_at: np.ndarray, seed: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy tiles (start in the text, start in the item, length) from the positions of common windows.

    A heap holds the maximal matches, longest first. The one on top is marked if it is free; if marked words cut it,
    its longest free stretches go back on the heap. So every tile is the longest match left, as in the original
    rounds, and each match is looked at again only when something cut it.
    """
    order = np.lexsort((at, item_at - at))
    i, j = at[order], item_at[order]
    joined = (np.diff(i) == 1) & (np.diff(j - i) == 0)
    starts = np.flatnonzero(np.r_[True, ~joined])
    ends = np.r_[starts[1:], len(i)] - 1
    heap = [(-int(i[e] - i[s]) - seed, int(i[s]), int(j[s])) for s, e in zip(starts, ends, strict=True)]
    heapq.heapify(heap)
    text_marks, item_marks = set(), set()
    found = []
    while heap:
        length, a, b = heapq.heappop(heap)
        length = -length
        free, run = [], 0
        for k in range(length + 1):
            if k < length and a + k not in text_marks and b + k not in item_marks:
                run += 1
            else:
                if run >= seed:
                    free.append((k - run, run))
                run = 0
        if free == [(0, length)]:
            found.append((a, b, length))
            text_marks.update(range(a, a + length))
            item_marks.update(range(b, b + length))
        else:
            for skip, rest in free:
                heapq.heappush(heap, (-rest, a + skip, b + skip))
    return found


def _windows(rows: DataFrame, seed: int, schema: str, table=None) -> DataFrame:
    """(id, body, words, window, position) of windows of `seed` words; only those in the bit table if one is given."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        for batch in batches:
            for low, _, joined, lengths in ngrams.chunks(batch.column(2).to_pylist()):
                words = ngrams.hash_words(ngrams.folded(joined, ngrams.LETTERS), lengths)
                window, at = ngrams.grams(words, seed)
                if table is not None:
                    maybe = BitTable(table.value).test(window)
                    window, at = window[maybe], at[maybe]
                count = np.bincount(words.owner, minlength=len(lengths))
                of = words.owner[at]
                first = np.cumsum(count) - count
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(of + low)),
                        batch.column(1).take(pa.array(of + low)),
                        pa.array(count[of]),
                        pa.array(window.view(np.int64)),
                        pa.array(at - first[of]),
                    ],
                    names,
                )

    return rows.mapInArrow(scan, schema)


def _meeting(item_windows: DataFrame, hits: DataFrame, kind: str, seed: int, coverage: float) -> DataFrame:
    """(window, item_id, item_body, item_words): the windows on which documents meet an item.

    The windows of an item that documents hold are taken by falling frequency while their union covers less than
    `coverage` of the item; all after these are for meeting.
    """
    frequency = hits.groupBy("window").agg(F.count("*").alias("frequency"))
    held = item_windows.join(frequency, "window").select("window", "item_id", "item_body", "item_words", "item_at", "frequency")

    def rarer(rows: pa.Table) -> pa.Table:
        at, frequent = rows.column("item_at").to_numpy(), rows.column("frequency").to_numpy()
        words = rows.column("item_words")[0].as_py()
        covered, total = np.zeros(words, bool), 0
        order = np.lexsort((at, -frequent))
        for k, place in enumerate(at[order]):
            here = covered[place : place + seed]
            total += int(seed - here.sum())
            if total / words >= coverage:
                return rows.take(pa.array(order[k:])).drop_columns(["item_at", "frequency"])
            here[:] = True
        return rows.slice(0, 0).drop_columns(["item_at", "frequency"])

    schema = f"window long, item_id {kind}, item_body long, item_words long"
    # A group holds the windows of one benchmark item.
    return held.groupBy("item_id", "item_body").applyInArrow(rarer, schema).distinct()


def overlaps(docs: DataFrame, items: DataFrame, seed: int = SEED, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, body (hash of the text), item_id, covered words, item words, coverage, tiles, longest tile.

    One row per document text and item with a coverage of at least `coverage`.
    """
    bench = items.select(F.col("item_id"), F.xxhash64(F.col("text").cast("string")).alias("body"), F.col("text").cast("string").alias("text"))
    kind = bench.schema["item_id"].dataType.simpleString()
    item_windows = materialize(
        _windows(bench, seed, f"item_id {kind}, item_body long, item_words long, window long, item_at long"), "bench-windows"
    )
    table = BitTable.of(item_windows, "window").share(docs.sparkSession)
    rows = texts(docs).select("doc_id", F.xxhash64("text").alias("body"), "text")
    hits = _windows(rows, seed, "doc_id long, body long, words long, window long, at long", table)
    # A row of repeated documents counts once here; their rows come back when the result is joined.
    hits = materialize(hits.select("doc_id", "body", "window", "at").distinct(), "bench-hits")
    item = ["item_id", "item_body", "item_words"]
    meeting = _meeting(item_windows, hits, kind, seed, coverage)
    met = materialize(hits.join(meeting, "window").select("doc_id", "body", *item).distinct(), "bench-met")
    windows = item_windows.select(*[F.col(c).alias(f"_{c}") for c in item], "window", "item_at")
    of_item = F.col("item_id").eqNullSafe(F.col("_item_id")) & (F.col("item_body") == F.col("_item_body"))
    wanted = met.join(windows, of_item).select("doc_id", "body", *item, "window", "item_at")
    of_doc = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("body") == F.col("_body")) & (F.col("window") == F.col("_window"))
    places = hits.select(F.col("doc_id").alias("_doc_id"), F.col("body").alias("_body"), F.col("window").alias("_window"), "at")
    seeds = wanted.join(places, of_doc).select("doc_id", "body", *item, "at", "item_at")
    pairs = seeds.groupBy("doc_id", "body", *item).agg(
        F.collect_set(F.struct("at", "item_at")).alias("seeds"), F.count_distinct("item_at").alias("distinct")
    )
    # n different windows cover at most n * seed words of the item.
    pairs = pairs.filter(F.col("distinct") * seed / F.col("item_words") >= coverage)

    def tile(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for seeds_ in batch.column(5):
                both = seeds_.values.flatten()
                found.append(tiles(both[0].to_numpy(), both[1].to_numpy(), seed))
            lengths = [[n for _, _, n in f] for f in found]
            covered = np.array([sum(n) for n in lengths], np.int64)
            size = batch.column(4).to_numpy()
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(k) for k in (0, 1, 2, 4)],
                    pa.array(covered),
                    pa.array(covered / np.maximum(size, 1)),
                    pa.array([len(n) for n in lengths], pa.int64()),
                    pa.array([max(n) for n in lengths], pa.int64()),
                ],
                ["doc_id", "body", "item_id", "item_words", "covered", "coverage", "n_tiles", "longest_tile"],
            )

    tiled = pairs.drop("distinct").mapInArrow(
        tile,
        f"doc_id long, body long, item_id {kind}, item_words long, covered long, coverage double, n_tiles long, longest_tile long",
    )
    return tiled.filter(F.col("coverage") >= coverage)


def clean(docs: DataFrame, items: DataFrame, seed: int = SEED, coverage: float = COVERAGE) -> DataFrame:
    """The rows of `docs`, all columns, that no item contaminates."""
    bad = materialize(overlaps(docs, items, seed, coverage).select(F.col("doc_id").alias("d"), F.col("body").alias("b")).distinct(), "contaminated")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    text = F.col("row")["text"].cast("string")
    left = rows.join(bad, F.col("row")["doc_id"].cast("long").eqNullSafe(F.col("d")) & (F.xxhash64(text) == F.col("b")), "left_anti")
    return left.select("row.*")
