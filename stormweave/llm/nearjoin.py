"""Operator 4, n-gram Jaccard join by banded MinHash, in place of an LSH forest, with exact verification.

Texts are sets of 5-word shingles. Texts with the same set are folded first, so copies are one node with a count.
Each node gets `TREES` MinHash label sequences. Two nodes with similarity s share a prefix of length d in a sequence with
chance s^d. The longest prefix at which pairs at the threshold meet in at least one sequence with the target recall is
computed once per run, and only its labels are made; the nodes with one prefix, met by equality, are a bucket. There are no tries:
the threshold is fixed, and pairs that longer prefixes would find share this one too.

A bucket's nodes are compared by 64-byte sketches, in blocks: a bucket of any size is cut into square cells of bounded
size, and a cell emits no pairs but a spanning forest of its similar nodes. Connected nodes form candidate groups.
Groups are verified exactly on their shingle sets, again in cells, which count the links of each node and emit a
spanning forest of true links only; those give the classes. So all pairs within a group are checked, none listed.

No cell, key or group grows with the data: hot buckets and groups become more cells. Tables between the steps lie in the
shared folder. Shingles are compared as 64-bit hashes; two different sets are taken for copies, or two shingles for
equal, with a chance below n^2 / 2^65 for n of them.

Defined results: a text of one to four words has its whole word sequence as its only shingle; a null or empty text has
no shingles, no links and a class of its own; repeated rows are copies of each other; an empty table gives an empty
result; no columns but `doc_id` and `text` are read. The class id is the smallest doc_id of the class, null if all are null.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from fractions import Fraction
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormweave.llm import ngrams
from stormweave.llm.bits import BitTable
from stormweave.llm.scan import per_groups
from stormweave.llm.words import texts
from stormweave.session import materialize

SHINGLE, THRESHOLD = 5, 0.8
#: Trees of the forest, labels of a tree, and the recall wanted for a pair exactly at the threshold.
TREES, LABELS, RECALL = 20, 6, 0.9999
#: Bytes of a sketch. Nodes pass as similar down to five standard deviations below the share that pairs at the
#: threshold agree in, so verification misses one pair in some three million.
SKETCH, DEVIATIONS = 64, 5.0
#: Nodes and shingles of one side of a cell.
CELL_NODES, CELL_SHINGLES = 512, 400_000

_rng = np.random.default_rng(20240229)
_XOR = _rng.integers(0, 1 << 32, TREES * LABELS, dtype=np.uint32)
_ODD = _rng.integers(0, 1 << 31, TREES * LABELS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def prefix_length(threshold: float, trees: int = TREES, labels: int = LABELS, recall: float = RECALL) -> int:
    """The longest prefix at which pairs at the threshold meet with the wanted recall, shortening from the whole label."""
    for length in range(labels, 1, -1):
        if 1 - (1 - threshold**length) ** trees >= recall:
            return length
    return 1


def shingles(joined: bytes, lengths: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of the texts of a chunk, sorted by text, and their number per text."""
    words = ngrams.hash_words(ngrams.folded(joined, ngrams.SPACES), lengths)
    grams, at = ngrams.grams(words, n)
    owner = words.owner[at]
    count = np.bincount(words.owner, minlength=len(lengths))
    first = np.cumsum(count) - count
    short = np.flatnonzero((count > 0) & (count < n))
    whole = np.zeros(len(short), np.uint64)
    for k in range(n - 1):
        more = count[short] > k
        at_ = np.minimum(first[short] + k, max(len(words.hashes) - 1, 0))
        whole = np.where(more, ngrams.mix(whole * np.uint64(31) + words.hashes[at_] + np.uint64(k + 1)), whole)
    grams, owner = np.concatenate([grams, whole]), np.concatenate([owner, short])
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    keep = np.ones(len(grams), bool)
    keep[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    return grams[keep], np.bincount(owner[keep], minlength=len(lengths))


def set_hashes(grams: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(ngrams.mix(grams ^ np.uint64(0x5851F42D4C957F2D)))])
    ends = np.cumsum(count)
    return ngrams.mix(total[ends] - total[ends - count] + count.astype(np.uint64))


def min_hashes(grams: np.ndarray, count: np.ndarray, labels: int) -> np.ndarray:
    """The smallest hash of each non-empty set under each permutation, one row per permutation."""
    starts = (np.cumsum(count) - count)[count > 0]
    low = (grams >> np.uint64(32)).astype(np.uint32)
    out = np.empty((labels, len(starts)), np.uint32)
    for k in range(labels):
        out[k] = np.minimum.reduceat((low ^ _XOR[k]) * _ODD[k], starts)
    return out


def _nodes(docs: DataFrame, prefix: int) -> DataFrame:
    """A row per document: doc_id, node (hash of its set), size of the set, bucket keys and sketch; nulls for no shingles."""
    labels = TREES * prefix

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, joined, lengths in ngrams.chunks(batch.column(1).to_pylist()):
                grams, count = shingles(joined, lengths)
                full = np.flatnonzero(count)
                nodes = set_hashes(grams, count).view(np.int64)
                if len(full):
                    least = min_hashes(grams, count, labels).reshape(TREES, prefix, -1)
                    keys = np.zeros((TREES, len(full)), np.uint64)
                    for k in range(prefix):
                        keys = ngrams.mix(keys * np.uint64(31) + least[:, k])
                    keys = ngrams.mix(keys + np.arange(TREES, dtype=np.uint64)[:, None]).T
                    # Bytes of labels that spread well: the smallest values themselves are small.
                    sketch = (ngrams.mix(least.reshape(labels, -1)[:SKETCH].astype(np.uint64)) >> np.uint64(56)).astype(np.uint8).T
                else:
                    keys, sketch = np.zeros((0, TREES), np.uint64), np.zeros((0, SKETCH), np.uint8)
                none = pa.array(count == 0)
                at = np.zeros(len(count), np.int64)
                at[full] = np.arange(len(full))
                index = pa.array(at, mask=count == 0)
                key_lists = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel().view(np.int64)), TREES).cast(pa.list_(pa.int64()))
                sketches = pa.array([x.tobytes() for x in np.ascontiguousarray(sketch)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(low, high - low),
                        pa.array(nodes, mask=none.to_numpy(zero_copy_only=False)),
                        pa.array(count, pa.int64()),
                        key_lists.take(index),
                        sketches.take(index),
                    ],
                    ["doc_id", "node", "size", "keys", "sketch"],
                )

    return texts(docs).mapInArrow(scan, "doc_id long, node long, size long, keys array<long>, sketch binary")


def _cells(rows: DataFrame, key: str, sides: str) -> DataFrame:
    """Copies of rows for the cells of their group: a group of n sides has cells (i, j) with i <= j < n.

    A row of side s is in (s, s) and in every cell with another side, so each pair of rows is in one cell where it
    counts: in (s, s) if both are of side s, else in the cell of their two sides.
    """
    side = F.pmod(F.xxhash64("node", F.lit(4)), F.col(sides))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col(sides) - 1))
    spread = rows.withColumn("side", side).withColumn("other", other)
    return spread.withColumns({"i": F.least("side", "other"), "j": F.greatest("side", "other")}).drop("other", sides)


def _forest(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of a boolean matrix of links: each part's nodes hang on its first one, part by part."""
    n = len(links)
    seen = np.zeros(n, bool)
    a, b = [], []
    for root in range(n):
        if seen[root]:
            continue
        seen[root] = True
        front = np.array([root])
        while len(front):
            reached = np.flatnonzero(links[front].any(axis=0) & ~seen)
            seen[reached] = True
            a.append(np.full(len(reached), root))
            b.append(reached)
            front = reached
    return np.concatenate(a), np.concatenate(b)


def _alike(threshold: float, batch: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
    """Spanning forests of similar sketches within each cell of a bucket."""
    nodes, side = batch.column("node").to_numpy(), batch.column("side").to_numpy()
    i, j = batch.column("i").to_numpy(), batch.column("j").to_numpy()
    sketches = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(len(nodes), -1)
    width = sketches.shape[1]
    least = math.floor(width * threshold - DEVIATIONS * math.sqrt(width * threshold * (1 - threshold)))
    sizes = np.diff(starts, append=len(nodes))
    # Most buckets hold two nodes: all of them at once.
    two = starts[sizes == 2]
    close = (sketches[two] == sketches[two + 1]).sum(axis=1) >= least
    a, b = [nodes[two[close]]], [nodes[two[close] + 1]]
    for start, size in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
        part = slice(start, start + size)
        own, s = sketches[part], side[part]
        same = np.zeros((size, size), np.int16)
        for k in range(own.shape[1]):
            same += own[:, k, None] == own[None, :, k]
        links = same >= least
        if i[start] != j[start]:
            links &= s[:, None] != s[None, :]
        x, y = _forest(links)
        a.append(nodes[part][x])
        b.append(nodes[part][y])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])


def _verifier(threshold: float):
    ratio = Fraction(threshold).limit_denominator(10_000)

    def links(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """Which of n sets, given as (value, owner) with distinct pairs, have the wanted similarity."""
        size = np.bincount(owner, minlength=n)
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        new = np.r_[True, values[1:] != values[:-1]]
        rank = np.cumsum(new) - 1
        shared = np.bincount(rank)[rank] > 1  # a shingle of one set only is in no intersection
        owner, rank = owner[shared], rank[shared]
        common = np.zeros((n, n), np.float32)
        if len(rank):
            rank = np.cumsum(np.r_[False, rank[1:] != rank[:-1]])
            for low in range(0, int(rank[-1]) + 1, 4096):
                a, b = np.searchsorted(rank, [low, low + 4096])
                held = np.zeros((n, min(4096, int(rank[-1]) + 1 - low)), np.float32)
                held[owner[a:b], rank[a:b] - low] = 1
                common += held @ held.T
        common = common.astype(np.int64)
        union = size[:, None] + size[None, :] - common
        return (common * ratio.denominator >= ratio.numerator * union) & (common > 0)

    def verify(batch: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        nodes, side = batch.column("node").to_numpy(), batch.column("side").to_numpy()
        copies = batch.column("copies").to_numpy()
        i, j = batch.column("i").to_numpy(), batch.column("j").to_numpy()
        lists = batch.column("shingles")
        offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
        a, b, n_links = [], [], []
        for start, end in zip(starts, np.append(starts[1:], len(nodes)), strict=True):
            # The scan of each part of the table brings a node that has copies there.
            own, at = np.unique(nodes[start:end], return_index=True)
            at += start
            pieces = [values[offsets[k] : offsets[k + 1]] for k in at]
            linked = links(np.concatenate(pieces), np.repeat(np.arange(len(at)), [len(p) for p in pieces]), len(at))
            np.fill_diagonal(linked, False)
            if i[start] != j[start]:
                linked &= side[at][:, None] != side[at][None, :]
            weight = linked @ copies[at]
            some = np.flatnonzero(weight)
            x, y = _forest(linked)
            a += [own[some], own[x]]
            b += [own[some], own[y]]
            n_links += [weight[some], np.zeros(len(x), np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (a, b, n_links)], ["a", "b", "links"])

    return verify


def keep_first(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of `docs`, all columns, of each class: the one with the smallest id, of repeated ones the first text."""
    found = materialize(near_duplicates(docs, threshold), "near-classes")
    first = found.filter(F.col("doc_id").eqNullSafe(F.col("class_id")))
    of_class = first.filter(F.col("node").isNotNull()).groupBy("part").agg(F.first("doc_id").alias("d"), F.min("node").alias("n"))
    sizes = first.groupBy(F.col("node").alias("n")).agg(F.count("*").alias("rows"))
    alone = first.filter(F.col("node").isNull()).select(F.col("doc_id").alias("d"), F.col("node").alias("n"), F.lit(1).alias("rows"))
    chosen = materialize(of_class.join(sizes, "n").select("d", "n", "rows").unionByName(alone.distinct()), "near-chosen")
    named = _named(docs)
    same = F.col("doc_id").eqNullSafe(F.col("d")) & F.col("node").eqNullSafe(F.col("n"))
    single = chosen.filter("rows = 1")
    kept = named.join(single, same, "left_semi").select("row.*")
    repeated = chosen.filter("rows > 1")
    if not repeated.isEmpty():
        again = named.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "node"])
        kept = kept.unionByName(again.select("row.*"))
    return kept


def _named(docs: DataFrame) -> DataFrame:
    """row (all columns as a struct), doc_id and node of each row."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))

    @F.pandas_udf("long")
    def node(text: pd.Series) -> pd.Series:
        found = []
        for _, _, joined, lengths in ngrams.chunks(text.tolist()):
            grams, count = shingles(joined, lengths)
            hashes = set_hashes(grams, count).view(np.int64)
            found += [int(h) if c else None for h, c in zip(hashes, count, strict=True)]
        return pd.Series(found, index=text.index, dtype="Int64")

    return rows.select("row", F.col("row")["doc_id"].cast("long").alias("doc_id"), node(F.col("row")["text"].cast("string")).alias("node"))


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node and shingles of the documents whose node may be wanted, once per scanned batch."""
    table = BitTable.of(wanted, "node").share(docs.sparkSession)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[int] = set()
            for _, _, joined, lengths in ngrams.chunks(batch.column(1).to_pylist()):
                grams, count = shingles(joined, lengths)
                nodes = set_hashes(grams, count)
                ends = np.cumsum(count)
                chosen = [k for k in BitTable(table.value).test(nodes).tolist() if count[k] and not (nodes[k] in seen or seen.add(nodes[k]))]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(nodes[chosen].view(np.int64)),
                        pa.array([grams[ends[k] - count[k] : ends[k]].view(np.int64) for k in chosen], pa.list_(pa.int64())),
                    ],
                    ["node", "shingles"],
                )

    return texts(docs).mapInArrow(scan, "node long, shingles array<long>")


def components(edges: DataFrame) -> DataFrame:
    """node and group (a node that names the part) of the connected parts of `edges` (a, b).

    Every round hooks each node to its smallest neighbour, or itself, and contracts the edges; ids are hashes, so a
    constant share of the open nodes goes each round and soon few edges are left. The hooks are composed at the end.
    """

    def proper(pairs: DataFrame) -> DataFrame:
        return pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    rounds: list[DataFrame] = []
    open_ = materialize(proper(edges), "near-edges")
    while not open_.isEmpty():
        both = open_.unionByName(open_.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
        hooks = materialize(hooks.select("node", F.least("node", "least").alias("up")), "near-hooks")
        rounds.append(hooks)
        left = hooks.withColumnsRenamed({"node": "a", "up": "a_up"})
        right = hooks.withColumnsRenamed({"node": "b", "up": "b_up"})
        open_ = materialize(proper(open_.join(left, "a").join(right, "b").select(F.col("a_up").alias("a"), F.col("b_up").alias("b"))), "near-edges")
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("group")).limit(0)
    labels = rounds[-1].withColumnRenamed("up", "group")
    for hooks in reversed(rounds[:-1]):
        named = labels.withColumnsRenamed({"node": "up"})
        labels = hooks.join(named, "up", "left").select("node", F.coalesce("group", "up").alias("group"))
    return labels


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, node (hash of the shingle set, null if empty), part (node that names the class), class_id and n_links of each row.

    n_links is the number of other rows with a similarity of at least `threshold`, copies included.
    """
    rows = materialize(_nodes(docs, prefix_length(threshold)), "near-nodes")
    folded = rows.filter(F.col("node").isNotNull()).groupBy("node")
    folds = materialize(folded.agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"), F.first("size").alias("size")), "near-folds")
    # Bucket keys and sketches are functions of the node; those of one of its rows do.
    labelled = rows.filter(F.col("node").isNotNull()).dropDuplicates(["node"]).select("node", "keys", "sketch")
    labelled = materialize(labelled, "near-labels")
    keyed = labelled.select("node", F.explode("keys").alias("key"))
    crowd = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    crowd = crowd.select("key", F.ceil(F.col("n") / CELL_NODES).alias("sides"))
    met = _cells(keyed.join(crowd, "key"), "key", "sides").join(labelled.select("node", "sketch"), "node")
    alike = per_groups(met, ["key", "i", "j"], partial(_alike, threshold), "a long, b long")
    edges = materialize(alike.distinct(), "near-alike")
    groups = materialize(components(edges), "near-groups")
    members = groups.join(folds.select("node", "copies", "size"), "node")
    cells = members.groupBy("group").agg(
        F.ceil(F.greatest(F.count("*") / CELL_NODES, F.sum("size") / CELL_SHINGLES)).alias("sides")
    )
    members = members.join(cells, "group").select("node", "group", "copies", "sides")
    placed = _cells(_sets(docs, groups).join(members, "node"), "group", "sides")
    found = materialize(per_groups(placed, ["group", "i", "j"], _verifier(threshold), "a long, b long, links long"), "near-links")
    links = found.filter("links > 0").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    true_edges = found.filter("links = 0").select("a", "b").distinct()
    parts = components(true_edges)
    all_ = folds.join(parts, "node", "left").join(links, "node", "left").withColumn("group", F.coalesce("group", "node"))
    classes = all_.groupBy("group").agg(F.min("first_doc").alias("class_id"))
    facts = all_.join(classes, "group").select(
        F.col("node").alias("n"), F.col("group").alias("part"), "class_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    return rows.select("doc_id", "node").join(facts, F.col("node") == F.col("n"), "left").select(
        "doc_id",
        "node",
        "part",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )
