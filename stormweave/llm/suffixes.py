"""Operator 3, exact substring dedup on merged Burrows-Wheeler transforms.

A byte is removed if a 50-byte string that covers it also starts in a document with a smaller id. To find those
strings without one sort of all suffixes, the work is cut by content:

1. Every 50-byte window has an anchor, the smallest hash among its 16-byte grams; equal windows have equal anchors, and
   neighbouring windows mostly share one. Anchors seen once cannot hold a repeated window and go.
2. Runs of windows under a remaining anchor are pieces of text. Equal pieces of a scanned batch become one row with
   its smallest and largest document, before anything is shuffled. An anchor of very many runs (a line a third of the
   documents share) is replaced by the windows themselves, so its differing surroundings spread over all tasks.
3. The different pieces of an anchor meet in a lot of bounded size. The lot is cut into shards, each shard gets its
   own Burrows-Wheeler transform (suffixes sorted to 50 bytes, the five bytes before each as its symbol), and the
   transforms are merged by refining their interleave: round h reads the symbols in the current interleave and deals
   the shard numbers stably by symbol, which orders all suffixes by their first h symbols; where a boundary appears in
   round h the common prefix is h - 1. After ten rounds, or 50 bytes, the intervals without a boundary are the repeated
   strings, and the smallest document of each is their owner.
4. What each piece loses goes back to the places of the piece; documents that lose nothing are not shuffled.

Defined results: null texts are empty; matches never cross rows; rows of one id do not remove from each other; a null id is
smaller than all others; an empty table gives an empty result; no columns but `doc_id` and `text` are read. A text of any
length is scanned whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormweave.llm import ngrams
from stormweave.llm.bits import BitTable
from stormweave.llm.scan import per_groups
from stormweave.session import materialize

#: Bytes of a repeated string and of an anchor gram; runs of an anchor beyond which its windows stand for themselves.
LENGTH, GRAM, HOT = 50, 16, 5000
#: Bytes of a shard with a transform of its own, and of a lot that is merged at once; bytes of a symbol of a transform.
SHARD, LOT, SYMBOL = 1 << 15, 1 << 16, 5
_LOWEST = -(1 << 63)
_WINDOW = LENGTH - GRAM + 1
_bytes = np.random.default_rng(50).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_odd = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def anchors(raw: np.ndarray) -> np.ndarray:
    """The anchor of the window at each position."""
    h = _bytes[raw]
    for k, odd in enumerate(_odd):  # hashes of 2, 4, 8 and 16 bytes
        step = 1 << k
        h = h[:-step] * odd + h[step:]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    step = 1
    while step * 2 <= _WINDOW:
        h = np.minimum(h[:-step], h[step:])
        step *= 2
    if step < _WINDOW:
        h = np.minimum(h[: -(_WINDOW - step)], h[_WINDOW - step :])
    return ngrams.mix(h)  # least values crowd at the low end; a bit table wants them spread


def runs(joined: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: first window, end, anchor and index of the text. Texts end with a blank of their own."""
    raw = np.frombuffer(joined, np.uint8)
    ends = np.cumsum(lengths)
    if len(raw) < LENGTH + 1:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), none
    m = anchors(raw)
    first, last = ends - lengths, ends - 1 - LENGTH  # the last window that ends within the text
    some = last >= first
    step = np.zeros(len(m) + 2, np.int8)
    step[first[some]] += 1
    step[last[some] + 1] -= 1
    valid = np.cumsum(step, dtype=np.int8)[: len(m)] > 0
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (m[1:] != m[:-1])
    edge = new.copy()
    edge[1:] |= ~valid[1:] & valid[:-1]
    edges = np.append(np.flatnonzero(edge), len(m))
    starts = np.flatnonzero(new)
    return starts, edges[np.searchsorted(edges, starts) + 1], m[starts], np.searchsorted(ends, starts, side="right")


def _slim(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST)).alias("doc"), F.xxhash64(text).alias("body"), text.alias("text"), F.col("doc_id").cast("long").alias("doc_id")
    )


def _repeated_anchors(docs: DataFrame) -> DataFrame:
    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, joined, lengths in ngrams.chunks(batch.column(0).to_pylist()):
                start, end, anchor, _ = runs(joined, lengths)
                weight = (end - start - 1) // _WINDOW + 1
                order = np.argsort(anchor)
                anchor, weight = anchor[order], weight[order]
                first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]]) if len(anchor) else order
                total = np.add.reduceat(weight, first) if len(first) else weight
                yield pa.RecordBatch.from_arrays([pa.array(anchor[first].view(np.int64)), pa.array(total)], ["anchor", "n"])

    found = _slim(docs).select("text").mapInArrow(scan, "anchor long, n long")
    return found.groupBy("anchor").agg(F.sum("n").alias("n")).filter("n > 1")


def _pieces_of(joined: bytes, lengths: np.ndarray, marked: BitTable, hot: BitTable):
    """Pieces under marked anchors: routing key, content hash, first byte, end and text index of each."""
    start, end, anchor, owner = runs(joined, lengths)
    chosen = marked.test(anchor)
    start, end, anchor, owner = start[chosen], end[chosen], anchor[chosen], owner[chosen]
    alone = np.zeros(len(start), bool)
    alone[hot.test(anchor)] = True
    many = (end - start)[alone]
    singles = np.repeat(start[alone] - (np.cumsum(many) - many), many) + np.arange(many.sum())
    first = np.concatenate([start[~alone], singles])
    last = np.concatenate([end[~alone] + LENGTH - 1, singles + LENGTH])
    raw = np.frombuffer(joined, np.uint8)
    power, inverse = ngrams._power_tables(len(raw) + 1)
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw + np.uint64(1)) * power[: len(raw)])])
    content = ngrams.mix((prefix[last] - prefix[first]) * inverse[first] + (last - first).astype(np.uint64))
    key = np.concatenate([anchor[~alone], ngrams.mix(content[len(start) - alone.sum() :] + np.uint64(1))])
    return key, content, first, last, np.concatenate([owner[~alone], np.repeat(owner[alone], many)])


def _fold(key: np.ndarray, content: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by key and content, and where each distinct pair starts in it."""
    order = np.lexsort((content, key))
    k, c = key[order], content[order]
    return order, np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (c[1:] != c[:-1])]) if len(k) else order


def _pieces(docs: DataFrame, marked, hot) -> DataFrame:
    """key, content, first and last document, and the bytes of distinct pieces of each batch."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = BitTable(marked.value), BitTable(hot.value)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            parts, piece = [], []
            for low, _, joined, lengths in ngrams.chunks(batch.column(1).to_pylist()):
                key, content, first, last, owner = _pieces_of(joined, lengths, *tables)
                order, start = _fold(key, content)
                if not len(start):
                    continue
                of = ids[owner + low][order]
                one = order[start]
                piece += [joined[a:b] for a, b in zip(first[one].tolist(), last[one].tolist(), strict=True)]
                parts.append((key[one], content[one], np.minimum.reduceat(of, start), np.maximum.reduceat(of, start)))
            if parts:
                key, content, least, most = (np.concatenate(x) for x in zip(*parts, strict=True))
                order, start = _fold(key, content)
                one = order[start]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key[one].view(np.int64)),
                        pa.array(content[one].view(np.int64)),
                        pa.array(np.minimum.reduceat(least[order], start)),
                        pa.array(np.maximum.reduceat(most[order], start)),
                        pa.array([piece[k] for k in one.tolist()], pa.binary()),
                    ],
                    ["key", "content", "least", "most", "piece"],
                )

    return _slim(docs).select("doc", "text").mapInArrow(scan, "key long, content long, least long, most long, piece binary")


def sort_shard(symbols: np.ndarray) -> np.ndarray:
    """Positions of a cyclic shard in the order of their first LENGTH symbols, by ranks of ever longer prefixes."""
    key = np.zeros(len(symbols), np.uint64)
    for k in range(7):
        key = (key << np.uint64(9)) | np.roll(symbols, -k).astype(np.uint64)
    known, width = 7, max(len(symbols).bit_length(), 1)
    while True:
        order = np.argsort(key)
        ordered = key[order]
        rank = np.empty(len(key), np.uint64)
        rank[order] = np.cumsum(np.r_[False, ordered[1:] != ordered[:-1]])
        if known >= LENGTH:
            return order
        # As many ranks as a key holds, two at least; the last one may overlap the one before.
        key, reached = rank, known
        for _ in range(64 // width - 1):
            step = min(reached, LENGTH - known)
            key = (key << np.uint64(width)) | np.roll(rank, -step)
            reached = step + known
        known = reached


def merge_transforms(transforms: list[np.ndarray], rounds: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """The merged order of the suffixes of several transforms, and the length of each one's prefix in common with the one before.

    Suffixes are numbered shard by shard in the order of their shard. Prefixes are told apart up to `rounds` symbols:
    a length of `rounds` means at least that. A symbol may stand for several bytes; lengths are in symbols.
    """
    known, symbols = np.unique(np.concatenate(transforms), return_inverse=True)
    # Sixteen bits are sorted by digits.
    symbols = symbols.astype(np.uint16 if len(known) <= 1 << 16 else np.uint32)
    sizes = [len(t) for t in transforms]
    shard = np.repeat(np.arange(len(sizes), dtype=np.uint8 if len(sizes) < 256 else np.uint16), sizes)
    numbers = np.arange(len(symbols), dtype=np.int32)
    interleave = numbers.copy()
    boundary = np.zeros(len(symbols), bool)
    boundary[0] = True
    common = np.full(len(symbols), rounds, np.int16)
    common[0] = 0
    for h in range(1, rounds + 1):
        before = symbols.take(interleave)
        order = before.argsort(kind="stable")
        block = boundary.cumsum(dtype=np.int32).take(order)
        before = before.take(order)
        now = np.empty(len(symbols), bool)
        now[0] = True
        np.not_equal(block[1:], block[:-1], out=now[1:])
        now[1:] |= before[1:] != before[:-1]
        # The shards' suffixes in their own order take the places that the shard numbers went to.
        if len(sizes) > 1:
            shard = shard.take(order)
            interleave[shard.argsort(kind="stable")] = numbers
        common[now & ~boundary] = h - 1
        boundary = now
    return interleave, common


def transform(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The SYMBOL bytes before each suffix of a cyclic shard as one number, for the suffixes in the given order."""
    symbols = np.zeros(len(text), np.uint64)
    for k in range(SYMBOL, 0, -1):
        symbols = (symbols << np.uint64(9)) | np.roll(text, k).astype(np.uint64)
    return symbols[order]


def repeated(pieces: list[bytes], owners: np.ndarray) -> list[list[tuple[int, int]]]:
    """For each piece, ranges of its windows that are also windows of a piece with a smaller owner."""
    shards, size, held = [], 0, []
    for k, piece in enumerate(pieces):
        held.append(k)
        size += len(piece) + 1
        if size >= SHARD:
            shards.append(held)
            size, held = 0, []
    if held:
        shards.append(held)
    transforms, places, of, left = [], [], [], []
    for members in shards:
        text = np.frombuffer(b"\0".join(pieces[k] for k in members) + b"\0", np.uint8).astype(np.uint16) + np.uint16(1)
        lengths = np.array([len(pieces[k]) + 1 for k in members])
        ends = np.cumsum(lengths)
        text[ends - 1] = 0
        order = sort_shard(text)
        transforms.append(transform(text, order))
        piece = np.repeat(np.arange(len(members)), lengths)
        places.append(order - (ends - lengths)[piece][order])
        left.append((ends - 1)[piece][order] - order)
        of.append(np.array(members)[piece][order])
    merged, common = merge_transforms(transforms, LENGTH // SYMBOL)
    place, piece = np.concatenate(places)[merged], np.concatenate(of)[merged]
    whole = np.concatenate(left)[merged] >= LENGTH
    start = np.flatnonzero(common < LENGTH // SYMBOL)
    owner = np.where(whole, owners[piece], np.iinfo(np.int64).max)
    least = np.repeat(np.minimum.reduceat(owner, start), np.diff(start, append=len(owner)))
    gone = whole & (owner > least)
    piece, place = piece[gone], place[gone]
    order = np.lexsort((place, piece))
    piece, place = piece[order], place[order]
    out: list[list[tuple[int, int]]] = [[] for _ in pieces]
    if len(piece):
        first = np.flatnonzero(np.r_[True, (piece[1:] != piece[:-1]) | (place[1:] != place[:-1] + 1)])
        for a, b in zip(first.tolist(), np.append(first[1:], len(piece)).tolist(), strict=True):
            out[piece[a]].append((int(place[a]), int(place[b - 1]) + 1))
    return out


_LOSSES = "key long, content long, owner long, ranges array<struct<low: int, high: int>>"
_RANGES = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))


def _losses(batch: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
    """Per distinct piece of whole key groups: its owner, and the windows that even the owner loses."""
    key, content = batch.column("key").to_numpy(), batch.column("content").to_numpy()
    order, first = _fold(key, content)
    one = order[first]
    least = np.minimum.reduceat(batch.column("least").to_numpy()[order], first)
    most = np.maximum.reduceat(batch.column("most").to_numpy()[order], first)
    key, content = key[one], content[one]
    group = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(group, append=len(key))
    ranges: list[list] = [[] for _ in key]
    lot: list[int] = []
    size = 0
    pieces = batch.column("piece")

    def merge() -> None:
        for k, found in zip(lot, repeated([pieces[int(one[k])].as_py() for k in lot], least[lot]), strict=True):
            ranges[k] = [{"low": a, "high": b} for a, b in found]

    width = pa.compute.binary_length(pieces).to_numpy()
    # Pieces of one document alone take nothing from each other.
    several = (sizes > 1) & (np.minimum.reduceat(least, group) < np.maximum.reduceat(most, group)) if len(key) else sizes > 1
    for g, n in zip(group[several].tolist(), sizes[several].tolist(), strict=True):
        lot += range(g, g + n)
        size += int(width[one[g : g + n]].sum()) + n
        if size >= LOT:
            merge()
            lot, size = [], 0
    if lot:
        merge()
    keep = np.flatnonzero((most > least) | np.array([bool(r) for r in ranges]))
    return pa.RecordBatch.from_arrays(
        [pa.array(key[keep]), pa.array(content[keep]), pa.array(least[keep]), pa.array([ranges[k] for k in keep], _RANGES)],
        ["key", "content", "owner", "ranges"],
    )


def _places(docs: DataFrame, marked, hot, lost) -> DataFrame:
    """key, content and the places (document, first byte, end) of each distinct piece of a chunk that may lose something."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, losing = (BitTable(marked.value), BitTable(hot.value)), BitTable(lost.value)
        for batch in batches:
            ids, bodies = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for low, _, joined, lengths in ngrams.chunks(batch.column(2).to_pylist()):
                found = _pieces_of(joined, lengths, *tables)
                chosen = losing.test(found[1])
                key, content, first, last, owner = (x[chosen] for x in found)
                order, start = _fold(key, content)
                begin = (np.cumsum(lengths) - lengths)[owner]
                columns = [ids[owner + low], bodies[owner + low], (first - begin).astype(np.int32), (last - begin).astype(np.int32)]
                names = ["doc", "body", "low", "high"]
                structs = pa.StructArray.from_arrays([pa.array(c[order]) for c in columns], names)
                lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(order)).astype(np.int32)), structs)
                one = order[start]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[one].view(np.int64)), pa.array(content[one].view(np.int64)), lists], ["key", "content", "places"]
                )

    return _slim(docs).select("doc", "body", "text").mapInArrow(
        scan, "key long, content long, places array<struct<doc: long, body: long, low: int, high: int>>"
    )


def removed_ranges(docs: DataFrame) -> DataFrame:
    """doc (id, null as the lowest), body (hash of the text) and byte ranges to remove, which may overlap."""
    spark = docs.sparkSession
    repeats = materialize(_repeated_anchors(docs), "suffix-anchors")
    marked = BitTable.of(repeats, "anchor").share(spark)
    hot = BitTable.of(repeats.filter(F.col("n") > HOT), "anchor").share(spark)
    losses = materialize(per_groups(_pieces(docs, marked, hot), ["key"], _losses, _LOSSES), "suffix-losses")
    lost = BitTable.of(losses, "content").share(spark)
    met = _places(docs, marked, hot, lost).join(losses, ["key", "content"]).select("owner", "ranges", F.explode("places").alias("p"))
    # All of a piece goes where its owner has a smaller id; the owner itself loses the listed windows.
    whole = F.array(F.struct(F.lit(0).alias("low"), (F.col("p.high") - F.col("p.low") - LENGTH + 1).alias("high")))
    lost = F.explode(F.when(F.col("p.doc") > F.col("owner"), whole).otherwise(F.col("ranges"))).alias("r")
    spans = met.select("p", lost).select(
        F.col("p.doc").alias("doc"),
        F.col("p.body").alias("body"),
        F.struct((F.col("p.low") + F.col("r.low")).alias("low"), (F.col("p.low") + F.col("r.high") + LENGTH - 1).alias("high")).alias("span"),
    )
    return spans.groupBy("doc", "body").agg(F.collect_set("span").alias("spans"))


_RESULT = "doc_id long, n_bytes long, spans array<struct<low: long, high: long>>, kept binary"


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    arrow = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))
    for batch in batches:
        spans_out, kept, sizes = [], [], []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            sizes.append(len(raw))
            merged: list[list[int]] = []
            if spans.is_valid and len(spans):
                pairs = spans.values.flatten()
                low, high = pairs[0].to_numpy(), pairs[1].to_numpy()
                order = np.argsort(low, kind="stable")
                for a, b in zip(low[order].tolist(), high[order].tolist(), strict=True):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
            bounds = [0, *(x for m in merged for x in m), len(raw)]
            kept.append(b"".join(raw[a:b] for a, b in zip(bounds[::2], bounds[1::2], strict=True)))
            spans_out.append([{"low": a, "high": b} for a, b in merged])
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans_out, arrow), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "spans", "kept"],
            )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, the maximal removed byte ranges and the remaining bytes of each row of `docs`."""
    ranges = materialize(removed_ranges(docs).withColumn("row", F.xxhash64("doc", "body")), "suffix-ranges")
    table = BitTable.of(ranges, "row").share(docs.sparkSession)

    def part(wanted: bool) -> DataFrame:
        def choose(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                maybe = np.zeros(batch.num_rows, bool)
                maybe[BitTable(table.value).test(batch.column("row").to_numpy().view(np.uint64))] = True
                yield batch.filter(pa.array(maybe == wanted))

        rows = _slim(docs).withColumn("row", F.xxhash64("doc", "body"))
        return rows.mapInArrow(choose, rows.schema)

    # Texts are shuffled only where something may have to be cut out.
    hit = part(True).join(ranges.drop("row"), ["doc", "body"], "left").select("doc_id", "text", "spans").mapInArrow(_cut, _RESULT)
    text = F.col("text").cast("binary")
    none = F.array().cast("array<struct<low: bigint, high: bigint>>")
    rest = part(False).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), none.alias("spans"), text.alias("kept"))
    return hit.unionByName(rest)


def digest(found: DataFrame) -> DataFrame:
    length = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["high"] - s["low"])
    return found.select(
        "doc_id", "n_bytes", length.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
