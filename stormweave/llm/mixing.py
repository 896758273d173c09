"""Operator 5, mixing sources to target weights by the cube method.

Every document has an inclusion expectation `target / size of its source`, between 0 and 2. Its whole part is taken
for sure; the fractional parts are rounded by balanced sampling: in groups of documents of one source, expectations
move along the null space of the constraints (sum of words, number of documents), each move settling one document at
0 or 1 and keeping both totals exactly, until no more than two documents per group are open. The open ones of many
groups meet again in the next round, so a source of any size ends with a landing of at most two documents, which are
rounded to the nearest total. Long documents settle first, so the last ones are short.

Groups have a bounded number of documents, so a hot source is cut into many groups of a salt; only ids and sizes are
shuffled, never texts. Each round's table is written to the shared folder. Draws are seeded by hashes of the
group's rows, so reruns agree. Targets are found by sums over the table of sources: the excess over twice a source's size is
reshared until none is above, a few passes whatever the number of sources.

Defined results: a null or empty text has size 0 and takes 0 words; a null source is a source of its own, ranked last;
repeated rows (same id) are documents of their own; an empty table gives an empty result; no other columns are read.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stormweave.llm.words import texts, words
from stormweave.session import materialize

#: Weights of the sources by rank, repeating; share of all words the mix has; the most a source is repeated.
WEIGHTS, SHARE, MOST = (3.0, 1.0, 2.0), 1.5, 2.0
#: Documents of a group of the flight phase.
GROUP_ROWS = 1024
_STATE = "doc_id long, source string, size long, key long, source_size long, target double, p double, times int"


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, number of words and a hash of the row of each document."""
    slim = texts(docs, F.col("source").cast("string").alias("source"))
    size = F.size(words(F.col("text"))).cast("long")
    return slim.select("doc_id", "source", size.alias("size"), F.xxhash64("doc_id", "text").alias("key"))


def _ranked(sources: DataFrame) -> DataFrame:
    """Rank of each source by code point, null last: counts per range partition, then ranks within the partitions."""
    order = [F.col("source").asc_nulls_last()]
    parts = max(1, int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 4)
    placed = materialize(
        sources.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()).sortWithinPartitions(*order), "mix-placed"
    )
    # One row for each range partition: bounded by the number of partitions.
    before, total = {}, 0
    for row in placed.groupBy("part").count().orderBy("part").collect():
        before[row["part"]] = total
        total += row["count"]
    offsets = F.create_map(*[F.lit(x) for kv in before.items() for x in kv]) if before else F.create_map(F.lit(0), F.lit(0))
    rank = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1 + offsets[F.col("part")]
    return placed.select("source", "source_size", rank.alias("rank"))


def targets(sized: DataFrame) -> DataFrame:
    """source, source_size, target: SHARE of all words dealt by weight, at most MOST times a source's size."""
    sources = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    weighted = materialize(_ranked(sources).select("source", "source_size", weight.alias("weight")), "mix-sources")
    cap = F.col("source_size") * MOST
    total = SHARE * (weighted.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:
        open_ = F.col("weight") * level < cap
        full, share = weighted.agg(F.sum(F.when(~open_, cap).otherwise(0.0)), F.sum(F.when(open_, F.col("weight")).otherwise(0.0))).first()
        raised = (total - full) / share if share else level
        if raised <= level:
            break
        level = raised
    return weighted.select("source", "source_size", F.least(F.col("weight") * F.lit(float(level)), cap).alias("target"))


def flight(sizes_: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move fractional expectations within the null space of (words, documents) until at most two stay fractional.

    Each step moves along the projection of the longest open document onto the null space, so that it settles first
    and all the others share what it gives or takes. The two possible moves end where a document reaches 0 or 1 and
    are drawn so that expectations stay right. The last open documents are the shortest ones.
    """
    p = p.copy()
    open_ = np.flatnonzero((p > 0) & (p < 1))
    open_ = open_[np.argsort(-sizes_[open_], kind="stable")]
    while len(open_):
        now, size = p[open_], sizes_[open_]
        centred = size - size.mean()
        spread = centred @ centred
        # How much of each single move the null space holds; three documents or more always leave some.
        free = 1 - 1 / len(open_) - (centred**2 / spread if spread > 0 else 0.0)
        leads = np.flatnonzero(np.broadcast_to(free, len(open_)) > 1e-9)
        if not len(leads):
            break
        lead = leads[0]
        move = np.full(len(open_), -1.0 / len(open_))
        move[lead] += 1.0
        if spread > 0:
            move -= centred * (centred[lead] / spread)
        move[np.abs(move) < 1e-12] = 0.0
        rises, falls = move > 0, move < 0
        to_one, to_zero = (1 - now) / np.abs(np.where(move, move, 1)), now / np.abs(np.where(move, move, 1))
        up = min(to_one[rises].min(initial=np.inf), to_zero[falls].min(initial=np.inf))
        down = min(to_zero[rises].min(initial=np.inf), to_one[falls].min(initial=np.inf))
        now = now + move * (up if rng.random() * (up + down) < down else -down)
        now[now < 1e-9], now[now > 1 - 1e-9] = 0.0, 1.0
        p[open_] = now
        open_ = open_[(now > 0) & (now < 1)]
    return p


def land(sizes_: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Round the last open documents (two at most) so that the words come nearest to their expectation."""
    open_ = [int(i) for i in np.flatnonzero((p > 0) & (p < 1))]
    wanted = float(sum(sizes_[i] * p[i] for i in open_))
    best = min(range(1 << len(open_)), key=lambda m: (abs(sum(sizes_[i] for j, i in enumerate(open_) if m >> j & 1) - wanted), m))
    p = p.copy()
    for j, i in enumerate(open_):
        p[i] = float(best >> j & 1)
    return p


def _round(open_: DataFrame, groups: Column, last: bool) -> DataFrame:
    def settle(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["order", "doc_id", "size"], kind="stable")
        size, p = group["size"].to_numpy(float), group["p"].to_numpy(float)
        p = flight(size, p, np.random.default_rng(int(group["order"].sum()) & (1 << 63) - 1))
        if last:
            p = land(size, p)
        return group.assign(p=p)[[x.split()[0] for x in _STATE.split(", ")]]

    salted = open_.withColumns({"order": F.xxhash64("key", F.lit("order")), "group": groups})
    return salted.groupBy("source", "group").applyInPandas(settle, _STATE)


def cube(expected: DataFrame) -> DataFrame:
    """The rows of `expected` (doc_id, source, size, key, source_size, target, p) with the number of times each is taken."""
    whole = F.floor(F.col("p") + 1e-12)
    start = expected.withColumns({"p": F.greatest(F.col("p") - whole, F.lit(0.0)), "times": whole.cast("int")})
    state = materialize(start.select(*[x.split()[0] for x in _STATE.split(", ")]), "mix-start")
    fractional = (F.col("p") > 0) & (F.col("p") < 1)
    settled = state.filter(~fractional)
    for level in itertools.count(1):
        open_ = state.filter(fractional)
        groups = materialize(open_.groupBy("source").agg(F.ceil(F.count("*") / GROUP_ROWS).alias("groups")), "mix-groups")
        most = groups.agg(F.max("groups")).first()[0]
        if most is None:
            break
        keyed = open_.join(groups.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
        group = F.pmod(F.xxhash64("key", F.lit(level)), F.col("groups"))
        state = materialize(_round(keyed, group, last=most == 1), f"mix-round{level}")
        settled = settled.unionByName(state.filter(~fractional))
    return settled.withColumn("times", (F.col("times") + F.col("p").cast("int")).cast("long"))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, words taken and times taken of each document."""
    sized = materialize(sizes(docs), "mix-sizes")
    goal = materialize(targets(sized), "mix-targets").withColumnRenamed("source", "s")
    rows = sized.join(goal, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rows = rows.withColumn("p", F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0)))
    # A document without words adds nothing and needs no rounding.
    taken = cube(rows.withColumn("p", F.when(F.col("size") > 0, F.col("p")).otherwise(0.0)))
    return taken.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "times"
    )
