"""The most similar reports of each report: exact cosines of all that are near in space and time, a bounded rank.

Reports with one vector, cell and half hour are a group, as in `dedup.semantic_pairs`, and groups are neighbours if they
lie near in space and time. All groups of a neighbourhood are compared. Where a cell and window hold very many, their groups are
dealt to parts and whoever looks into the cell looks into each part, so the comparisons of a hot cell are spread over tasks;
the result does not depend on it.

`exact=False` asks for buckets instead. Where a cell and window hold many groups, each
group is put into a bucket by leading bits of its signature in each of TABLES tables, as many bits as leave some CROWD
groups to a bucket. A group looks into its own bucket and into those it would be in if its least certain bits were
other ones. What meets is compared by whole signatures first, inside the join, so vectors are fetched and multiplied only for pairs
that are likely near. So a hot cell costs its groups times a constant, not their square. Buckets can miss a neighbour, and they are
made for cosines of some 0.9 and more. Groups hold different vectors, but
many vectors that differ by next to nothing still share their buckets.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stormweave.functions.spatial import GRID, HexGrid
from stormweave.operators.dedup import _in_time, _looks, _semantic_groups, _with_cosines
from stormweave.session import materialize

#: Groups of a cell and window that are compared in one part.
PART = 2000
#: Tables, bits of a table in the 64-bit signature, groups a bucket should hold, buckets looked into per table.
TABLES, BITS, CROWD, PROBES = 4, 16, 8, 9
#: Signatures of vectors at a cosine of 0.9 differ in 9.2 bits, with a deviation of 2.8; unrelated ones in 32.
MOST_BITS = 21
_SEED = 2024
#: Sets of bits to turn, by their rank of uncertainty, the likeliest first.
_TURNS = ((), (0,), (1,), (2,), (0, 1), (3,), (0, 2), (4,), (1, 2), (5,), (0, 3), (6,))


def _margins(column: pa.Array, dimensions: int) -> np.ndarray:
    """Signed distances of the vectors to the hyperplanes; shorter vectors are filled up with zeros."""
    vectors = np.zeros((len(column), dimensions), np.float32)
    for row, vector in enumerate(column.to_pylist()):
        vectors[row, : len(vector)] = [v or 0.0 for v in vector]
    planes = np.random.default_rng(_SEED).normal(size=(dimensions, TABLES * BITS)).astype(np.float32)
    return vectors @ planes


def _signed(bits: np.ndarray) -> np.ndarray:
    weights = np.left_shift(np.uint64(1), np.arange(bits.shape[1], dtype=np.uint64))
    return (bits.astype(np.uint64) * weights).sum(axis=1, dtype=np.uint64).view(np.int64)


def signatures(groups: DataFrame, dimensions: int) -> DataFrame:
    """The rows with `signature` and, per table, the ranks of bits by uncertainty in `order`; the vectors are dropped."""
    others = [c for c in groups.columns if c != "embedding"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                margins = _margins(b.column("embedding"), dimensions)
                order = np.abs(margins).reshape(b.num_rows, TABLES, BITS).argsort(axis=2).astype(np.int8)
                offsets = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * TABLES * BITS)
                lists = pa.ListArray.from_arrays(offsets, pa.array(order.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(c) for c in others], pa.array(_signed(margins > 0)), lists], [*others, "signature", "order"]
                )

    schema = ", ".join(f"`{n}` {t}" for n, t in groups.select(*others).dtypes)
    return groups.mapInArrow(run, f"{schema}, signature long, order array<tinyint>")


def _keys(rows: DataFrame, probe: bool) -> DataFrame:
    """Rows once per bucket they are in, or look into; `bits` says how many bits count in their cell and window."""
    mask = F.expr("shiftleft(1L, bits) - 1")

    def of_table(table: int):
        own = F.shiftrightunsigned("signature", table * BITS).bitwiseAND(mask)
        # The bits that count, the least certain first.
        doubtful = F.filter(F.slice("order", table * BITS + 1, BITS), lambda b: b < F.col("bits"))

        def turned(ranks: tuple[int, ...]):
            key = own
            for rank in ranks:
                key = key.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.get(doubtful, rank).cast("int")))
            return F.when(F.size(doubtful) > max(ranks, default=-1), F.struct(F.lit(table).alias("table"), key.alias("key")))

        return [turned(t) for t in (_TURNS[:PROBES] if probe else _TURNS[:1])]

    several = F.array_compact(F.array(*[key for table in range(TABLES) for key in of_table(table)]))
    return rows.withColumn("at", F.explode(several)).select("*", "at.*").drop("at", "order")


def semantic_neighbours(
    reports: DataFrame,
    top_k: int = 5,
    min_cosine: float = 0.9,
    window_hours: float = 6.0,
    k: int = 1,
    grid: HexGrid = GRID,
    bucket_minutes: int = 30,
    crowd: int = CROWD,
    exact: bool = True,
    vectors: DataFrame | None = None,
) -> DataFrame:
    """(report_id, neighbour, cosine, rank): the most similar groups of each group, each named by its first report.

    Cosines are compared to six decimals; among equal ones the smaller id comes first. `dedup.semantic_copies` says
    which group a report belongs to. Reports without a vector or a cell are in none. Vectors may come in a table of their
    own, `vectors` (vector_id, embedding), with their ids in `reports`.

    Ids and times meet, and a pair of vectors is multiplied once. Without `exact` groups in crowded places meet by signatures only.
    """
    window = round(window_hours * 3_600_000_000)
    span = window + bucket_minutes * 60_000_000
    own = vectors is None
    _, groups, known, _ = _semantic_groups(reports.filter(F.col("embedding").isNotNull()) if own else reports, grid, bucket_minutes, vectors)
    slim = groups.select(
        "representative", "cell", "first_us", "last_us", F.floor(F.col("first_us") / F.lit(span)).alias("wide"),
        F.col("representative" if own else "vector").alias("vector"),
    )
    # Crowded cells and windows. Many cells are as many rows, so how it is joined is left to its measured size.
    sizes = slim.groupBy("cell", "wide").agg(F.count("*").alias("groups"))
    crowded = materialize(sizes.filter(F.col("groups") > (PART if exact else 4 * crowd)), "crowded")
    looking = _looks(slim, k)
    right = slim.select(
        "cell", "wide", F.col("representative").alias("report_b"), F.col("first_us").alias("first_b"), F.col("vector").alias("vector_b")
    )
    pair = ["report_a", "report_b", "vector_a", "vector_b"]
    calm = right.join(crowded, ["cell", "wide"], "left_anti")
    met = looking.hint("merge").join(calm, ["cell", "wide"]).filter(_in_time(window)).select(*pair)
    if exact and not crowded.isEmpty():
        parts = crowded.select("cell", "wide", F.ceil(F.col("groups") / F.lit(PART)).alias("parts"))
        into_all = looking.join(parts, ["cell", "wide"]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
        in_one = right.join(parts, ["cell", "wide"]).withColumn("part", F.pmod(F.xxhash64("report_b"), "parts"))
        hot = into_all.drop("parts").hint("merge").join(in_one.drop("parts"), ["cell", "wide", "part"]).filter(_in_time(window))
        met = met.unionByName(hot.select(*pair))
    elif not crowded.isEmpty():
        dimensions = known.agg(F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()[0]
        signed = materialize(signatures(known, dimensions), "signatures")
        needed = F.least(F.lit(BITS), F.ceil(F.log2(F.col("groups") / F.lit(4 * crowd))) + 2).cast("int").alias("bits")
        counting = crowded.select("cell", "wide", needed)

        def keyed(rows: DataFrame, side: str) -> DataFrame:
            of_side = signed.withColumnsRenamed({"vector": f"vector_{side}"})
            keys = _keys(rows.join(counting, ["cell", "wide"]).join(of_side, f"vector_{side}"), probe=side == "a")
            return keys.withColumnRenamed("signature", f"signature_{side}").drop("bits")

        likely = F.bit_count(F.col("signature_a").bitwiseXOR(F.col("signature_b"))) <= MOST_BITS
        hot = keyed(looking, "a").hint("merge").join(keyed(right, "b"), ["cell", "wide", "table", "key"]).filter(_in_time(window) & likely)
        met = met.unionByName(hot.select(*pair).distinct())
    pairs = _with_cosines(met, known).withColumn("cosine", F.round("cosine", 6)).filter(F.col("cosine") >= min_cosine)
    ways = [F.struct(F.col(a).alias("report_id"), F.col(b).alias("neighbour")) for a, b in (("report_a", "report_b"), ("report_b", "report_a"))]
    each = pairs.select(F.explode(F.array(*ways)).alias("link"), "cosine").select("link.*", "cosine")
    order = Window.partitionBy("report_id").orderBy(F.desc("cosine"), "neighbour")
    # Spark keeps at most `top_k` rows of a report per task before it shuffles them.
    return each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k)
