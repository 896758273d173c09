"""Duplicates: by key, by perceptual hash and by embedding; connected incidents."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stormweave.functions.spatial import GRID, HexGrid, k_ring
from stormweave.session import materialize

HASH_BITS = 64


def keep_first(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row per key in the given order.

    Spark cuts every map task down to one row per key before the shuffle, so a hot key does not gather.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(window)).filter("_rank = 1").drop("_rank")


# --- Hamming neighbours -------------------------------------------------------------------------------------


def hash_from_hex(text: Column) -> Column:
    """16 hex digits to a signed 64-bit value; null for any other text."""
    digits = F.when(text.rlike("^[0-9a-fA-F]{16}$"), text)
    high = F.conv(F.substring(digits, 1, 8), 16, 10).cast("bigint")
    low = F.conv(F.substring(digits, 9, 8), 16, 10).cast("bigint")
    return F.shiftleft(high, 32).bitwiseOR(low)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def is_duplicate(hash_a: Column, hash_b: Column, max_distance: int = 5) -> Column:
    """Perceptual duplicates for two hex hashes: equal length and few differing bits."""
    bits = hamming(hash_from_hex(hash_a), hash_from_hex(hash_b)) <= max_distance
    filled = (F.length(hash_a) > 0) & (F.length(hash_a) == F.length(hash_b))
    return F.coalesce(filled & F.coalesce(bits, hash_a == hash_b), F.lit(False))


def _bands(count: int, bits: int = HASH_BITS) -> list[tuple[int, int]]:
    """(shift, width) of bands that split the bits as evenly as possible."""
    widths = [bits // count + (1 if i < bits % count else 0) for i in range(count)]
    return [(sum(widths[:i]), width) for i, width in enumerate(widths)]


def _masked(shift_widths: list[tuple[int, int]]) -> Column:
    """The hash with only the given bands left."""
    mask = sum(((1 << width) - 1) << shift for shift, width in shift_widths)
    return F.col("hash").bitwiseAND(F.lit(mask - (1 << 64) if mask >= 1 << 63 else mask))


def _cut(free: list[tuple[int, int]], pieces: int) -> list[list[tuple[int, int]]]:
    """Split the bits of some bands into so many groups of about the same size."""
    bits = [(shift + i, 1) for shift, width in free for i in range(width)]
    return [bits[i::pieces] for i in range(pieces)]


def _split_crowded(keyed: DataFrame, layout: list, chosen: list, max_distance: int, crowd: int) -> DataFrame:
    """Give members of crowded buckets finer keys.

    In a bucket the chosen bands are equal, so all differing bits lie in the others. Cut into one group of bits
    more than bits may differ, some group is equal too, and its bits extend the key.
    """
    counts = keyed.groupBy("combination", "bits").count()
    crowded = materialize(counts.filter(F.col("count") > crowd).drop("count"), "crowded")
    arms = []
    for number, combination in enumerate(chosen):
        free = [band for i, band in enumerate(layout) if i not in combination]
        parts = [
            F.struct(F.lit(g + 1).alias("sub"), _masked(group).alias("sub_bits"))
            for g, group in enumerate(_cut(free, max_distance + 1))
        ]
        arms.append(F.when(F.col("combination") == number, F.array(*parts)))
    finer = keyed.join(crowded, ["combination", "bits"], "left_semi").select(
        "hash", "combination", "bits", F.explode(F.coalesce(*arms)).alias("part")
    )
    return keyed.join(crowded, ["combination", "bits"], "left_anti").unionByName(
        finer.select("hash", "combination", "bits", "part.sub", "part.sub_bits")
    )


def hamming_pairs(
    hashes: DataFrame, column: str = "hash", max_distance: int = 5, bands: int | None = None, crowd: int = 1_000
) -> DataFrame:
    """Pairs of distinct hash values within the distance: (hash_a, hash_b, distance), hash_a < hash_b.

    Exact by the pigeonhole principle: with `b` bands and at most `d` differing bits, some `b - d` bands are
    equal, so hashes meet in a bucket of that band combination: a hash is copied C(b, d) times, 56 with 8 bands, and a
    key has 64 (b - d) / b bits. More bands suit more distinct hashes; by default their number follows from the number of
    hashes, so that a bucket of evenly spread ones holds a few. Members of buckets with more than `crowd` values get
    longer keys, which changes no pair. Copies of a value are folded before pairing and come back with `copies_of`, so a
    much-copied image costs one row. A dense cluster has as many pairs as it has: `hash_classes` lists none.

    Keys are generated, and Catalyst takes them to be as few as the hashes, so merge joins are asked for: otherwise all
    copies would pass through the driver as a broadcast.
    """
    values = materialize(hashes.select(F.col(column).alias("hash")).filter("hash is not null").distinct(), "hashes")
    if bands is None:
        n, bands = values.count(), max_distance + 1
        while n > 16 * 2 ** (HASH_BITS * (bands - max_distance) // bands) and bands < 2 * max_distance + 2:
            bands += 1
    layout = _bands(bands)
    chosen = list(combinations(range(bands), bands - max_distance))
    keys = [
        F.struct(F.lit(number).alias("combination"), _masked([layout[i] for i in combination]).alias("bits"))
        for number, combination in enumerate(chosen)
    ]
    keyed = values.select("hash", F.explode(F.array(*keys)).alias("key")).select(
        "hash", "key.*", F.lit(0).alias("sub"), F.lit(0).cast("bigint").alias("sub_bits")
    )
    keyed = _split_crowded(keyed, layout, chosen, max_distance, crowd)
    left = keyed.withColumnRenamed("hash", "hash_a")
    right = keyed.withColumnRenamed("hash", "hash_b")
    distance = hamming(F.col("hash_a"), F.col("hash_b"))
    return (
        left.hint("merge").join(right, ["combination", "bits", "sub", "sub_bits"])
        .filter((F.col("hash_a") < F.col("hash_b")) & (distance <= max_distance))
        .select("hash_a", "hash_b", distance.alias("distance"))
        .distinct()
    )


#: Bit groups of each level of `hash_classes`: bits dealt round in strides, so that levels cut across each other.
_STRIDES = (1, 9, 17, 27, 39, 51, 59, 5, 13, 23)


def _groups_of_bits(level: int, pieces: int) -> list[list[tuple[int, int]]]:
    dealt = [(_STRIDES[level] * i + level) % HASH_BITS for i in range(HASH_BITS)]
    size = HASH_BITS / pieces
    return [[(bit, 1) for bit in dealt[round(g * size) : round((g + 1) * size)]] for g in range(pieces)]


def _split(rows: DataFrame, level: int, radius: int) -> DataFrame:
    """Rows once per group of bits of the level, with the group's bits added to their bucket.

    Two values with at most `radius` differing bits are equal in one of `radius + 1` groups, so they meet again.
    """
    parts = [
        F.struct((F.col("path") * (radius + 1) + g).alias("path"), F.xxhash64("bits", F.lit(g), _masked(bits)).alias("bits"))
        for g, bits in enumerate(_groups_of_bits(level, radius + 1))
    ]
    return rows.select("hash", "label", F.explode(F.array(*parts)).alias("part")).select("hash", "label", "part.*")


def _mixed(rows: DataFrame, name: str) -> DataFrame:
    """Rows of buckets that hold more than one class so far, with the size of the bucket."""
    sizes = rows.groupBy("path", "bits").agg(F.count("*").alias("size"), F.min("label").alias("low"), F.max("label").alias("high"))
    several = sizes.filter("low <> high").select("path", "bits", "size")
    return materialize(rows.hint("merge").join(several, ["path", "bits"]), name)


def _linked(labels: DataFrame, radius: int, crowd: int) -> DataFrame:
    """`labels` (hash, label) with the classes joined that have values within the radius of each other."""
    rows = labels.withColumns({"path": F.lit(0).cast("bigint"), "bits": F.lit(0).cast("bigint")})
    links = []
    for level in range(len(_STRIDES)):
        rows = _mixed(_split(rows, level, radius), f"buckets-{radius}-{level}")
        last = level == len(_STRIDES) - 1
        near = rows if last else rows.filter(F.col("size") <= crowd)
        other = near.select("path", "bits", F.col("hash").alias("hash_b"), F.col("label").alias("label_b"))
        close = (F.col("label") < F.col("label_b")) & (hamming(F.col("hash"), F.col("hash_b")) <= radius)
        links.append(near.join(other, ["path", "bits"]).filter(close).select(F.col("label").alias("a"), F.col("label_b").alias("b")).distinct())
        rows = rows.filter(F.col("size") > crowd)
        if last or rows.isEmpty():
            break
    every = links[0]
    for more in links[1:]:
        every = every.unionByName(more)
    every = materialize(every, f"links-{radius}")
    nodes = every.select(F.col("a").alias("node")).unionByName(every.select(F.col("b").alias("node")))
    joined = connected_groups(nodes, every).withColumnsRenamed({"node": "label", "group": "joined"})
    return labels.join(joined, "label", "left").select("hash", F.coalesce("joined", "label").alias("label"))


def hash_classes(hashes: DataFrame, column: str = "hash", max_distance: int = 5, crowd: int = 256) -> DataFrame:
    """(hash, class_id, copies): values connected by steps of at most `max_distance` bits share a class.

    The class is the smallest of its values. Buckets by groups of bits, as in `hamming_pairs`, but a bucket whose values
    are in one class already is dropped, and a crowded one is cut by further groups of bits. Where crowds exist, classes
    are first joined at smaller radii: values that crowd within a few bits have much closer neighbours among each other,
    so by the time the full radius is looked at they are one class and their buckets are gone. No pairs are listed.
    """
    counted = hashes.select(F.col(column).alias("hash")).filter("hash is not null").groupBy("hash").agg(F.count("*").alias("copies"))
    values = materialize(counted, "hash-values")
    labels = values.select("hash", F.col("hash").alias("label"))
    start = labels.withColumns({"path": F.lit(0).cast("bigint"), "bits": F.lit(0).cast("bigint")})
    crowded = _split(start, 0, max_distance).groupBy("path", "bits").count().filter(F.col("count") > crowd)
    if not crowded.isEmpty():
        for radius in range(1, max_distance):
            labels = materialize(_linked(labels, radius, crowd), f"labels-{radius}")
    found = _linked(labels, max_distance, crowd)
    return values.join(found, "hash").select("hash", F.col("label").alias("class_id"), "copies")


def copies_of(hashes: DataFrame, column: str = "hash") -> DataFrame:
    """Hash values that occur more than once, with the number of copies."""
    return hashes.groupBy(F.col(column).alias("hash")).agg(F.count("*").alias("copies")).filter("copies > 1")


# --- semantic neighbours ------------------------------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision; the cosine for unit vectors."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0).cast("double"), lambda total, x: total + x)


def _semantic_groups(
    reports: DataFrame, grid: HexGrid, bucket_minutes: int, vectors: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame, str]:
    """Reports with the key of their group (cell, time bucket, vector), the groups with their first report and span, the
    vectors by `vector`, and the name of the vector's column in the key.

    With a table of `vectors` (vector_id, embedding) reports bring the `vector_id`, and equal vectors go by one id; so no
    report carries its vector. Without one a group's vector goes by its first report.
    """
    by = "embedding"
    if vectors is not None:
        by, known = "vector", vectors.filter(F.col("embedding").isNotNull())
        named = materialize(known.groupBy("embedding").agg(F.min("vector_id").alias("vector")), "vectors")
        reports = reports.join(known.join(named, "embedding").select("vector_id", "vector"), "vector_id")
    located = reports.withColumn("cell", grid.cell(F.col("latitude"), F.col("longitude"))).filter("cell is not null")
    bucket = F.floor(F.unix_micros("timestamp") / F.lit(bucket_minutes * 60_000_000))
    keyed = located.withColumn("bucket", bucket).select("report_id", "timestamp", "cell", "bucket", by)
    groups = keyed.groupBy("cell", "bucket", by).agg(
        F.min(F.struct("timestamp", "report_id")).alias("first"), F.max(F.unix_micros("timestamp")).alias("last_us")
    )
    groups = groups.select(
        "cell", "bucket", by, F.col("first.report_id").alias("representative"),
        F.unix_micros("first.timestamp").alias("first_us"), "last_us",
    )
    groups = materialize(groups, "semantic-groups")
    if vectors is None:
        return keyed, groups, groups.select(F.col("representative").alias("vector"), "embedding"), by
    return keyed, groups, named, by


def semantic_copies(reports: DataFrame, grid: HexGrid = GRID, bucket_minutes: int = 30) -> DataFrame:
    """(report_id, representative): reports with a vector, cell and time bucket in common stand for each other."""
    keyed, groups, _, by = _semantic_groups(reports, grid, bucket_minutes)
    return keyed.join(groups, ["cell", "bucket", by]).select("report_id", "representative")


def _looks(slim: DataFrame, k: int) -> DataFrame:
    """Groups once per cell and window they look into: cells that hold groups, at most k steps away, in two windows."""
    cells = materialize(slim.select("cell").distinct(), "semantic-cells")
    near = cells.select("cell", F.explode(k_ring(F.col("cell"), k)).alias("near"))
    near = near.join(cells.select(F.col("cell").alias("near")), "near")
    left = slim.join(near, "cell").select(
        F.col("near").alias("cell"), F.explode(F.array(F.col("wide"), F.col("wide") + 1)).alias("wide"),
        F.col("representative").alias("report_a"), F.col("first_us").alias("first_a"), F.col("last_us").alias("last_a"),
        F.col("vector").alias("vector_a"),
    )
    return left


def _in_time(window: int) -> Column:
    """Whether group b begins after group a, and within the window of a's last report."""
    gap = F.col("first_b") - F.col("first_a")
    later = (gap > 0) | ((gap == 0) & (F.col("report_a") < F.col("report_b")))
    return later & (F.col("first_b") - F.col("last_a") <= window)


def _with_cosines(met: DataFrame, vectors: DataFrame) -> DataFrame:
    """Pairs with `cosine`, computed once per pair of vectors; vectors are fetched for those alone."""
    low, high = F.least("vector_a", "vector_b"), F.greatest("vector_a", "vector_b")
    pairs = materialize(met.withColumns({"low": low, "high": high}).drop("vector_a", "vector_b"), "semantic-met")
    cosines = (
        pairs.select("low", "high").distinct()
        .join(vectors.withColumnsRenamed({"vector": "low", "embedding": "vector_a"}), "low")
        .join(vectors.withColumnsRenamed({"vector": "high", "embedding": "vector_b"}), "high")
        .select("low", "high", dot(F.col("vector_a"), F.col("vector_b")).alias("cosine"))
    )
    return pairs.join(cosines, ["low", "high"]).drop("low", "high")


def semantic_pairs(
    reports: DataFrame,
    min_cosine: float = 0.9,
    window_hours: float = 6.0,
    k: int = 1,
    grid: HexGrid = GRID,
    bucket_minutes: int = 30,
    vectors: DataFrame | None = None,
) -> DataFrame:
    """Pairs of reports near in space and time whose embeddings agree: (report_a, report_b, cosine).

    Identical vectors of one cell and time bucket are a group, see `semantic_copies`. The pairs are those of a group's
    first report with each of its copies, and those of the first reports of two groups that have any reports within
    the window of each other. So copies cost a row each and every report has its links, by itself or by its group.

    Groups meet by cell and window-wide time bucket with ids and times only; vectors are fetched for what met. Vectors may
    come in a table of their own, `vectors` (vector_id, embedding), with their ids in `reports`.
    """
    window = round(window_hours * 3_600_000_000)
    span = window + bucket_minutes * 60_000_000
    keyed, groups, known, by = _semantic_groups(reports, grid, bucket_minutes, vectors)
    vector = F.col("representative" if vectors is None else "vector").alias("vector")
    slim = groups.select("representative", "cell", "first_us", "last_us", F.floor(F.col("first_us") / F.lit(span)).alias("wide"), vector)
    right = slim.select(
        "cell", "wide", F.col("representative").alias("report_b"), F.col("first_us").alias("first_b"), F.col("vector").alias("vector_b")
    )
    met = _looks(slim, k).hint("merge").join(right, ["cell", "wide"]).filter(_in_time(window))
    copies = keyed.join(groups.select("cell", "bucket", by, "representative"), ["cell", "bucket", by])
    of_copies = copies.filter(F.col("report_id") != F.col("representative")).select(
        F.col("representative").alias("report_a"), F.col("report_id").alias("report_b"),
        vector.alias("vector_a"), vector.alias("vector_b"),
    )
    both = met.select("report_a", "report_b", "vector_a", "vector_b").unionByName(of_copies)
    return _with_cosines(both, known).filter(F.col("cosine") >= min_cosine).select("report_a", "report_b", "cosine")


# --- connected incidents ------------------------------------------------------------------------------------


def connected_groups(nodes: DataFrame, edges: DataFrame, node: str = "node") -> DataFrame:
    """Smallest node id of each connected part: (node, group). `edges` has columns `a` and `b`.

    Every round links each node's neighbours to its smallest known label and follows labels of labels, so the
    number of rounds grows with the logarithm of the longest path rather than with its length.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = materialize(both.filter("a <> b").distinct(), "links")
    labels = materialize(nodes.select(F.col(node).alias("node"), F.col(node).alias("group")).distinct(), "groups-0")
    round_no = 0
    while True:
        round_no += 1
        heard = (
            links.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("group").alias("heard"))
        )
        lowered = labels.join(heard, "node", "left").select(
            "node", "group", F.least("group", F.coalesce("heard", "group")).alias("new")
        )
        # Hook: the old label of a node learns the node's new label; then jump to the label's own label.
        hooks = lowered.groupBy(F.col("group").alias("node")).agg(F.min("new").alias("hook"))
        hooked = lowered.join(hooks, "node", "left").select(
            "node", "group", F.least("new", F.coalesce("hook", "new")).alias("new")
        )
        parents = hooked.select(F.col("node").alias("new"), F.col("new").alias("jump"))
        jumped = hooked.join(parents, "new", "left").select(
            "node", "group", F.least("new", F.coalesce("jump", "new")).alias("new")
        )
        step = materialize(jumped, f"groups-{round_no}")
        labels = step.select("node", F.col("new").alias("group"))
        if step.filter(F.col("new") != F.col("group")).isEmpty():
            return labels


def _islands(covered: DataFrame, place: list[str], span: int) -> tuple[DataFrame, DataFrame]:
    """Islands of each place, and which of them each row of `covered` is in.

    An island is a stretch of time in which some incident of the place is open or was within the last `span`. Rows of
    one bucket of that width belong together anyway, so a hot place is first reduced to its buckets, by an aggregate
    with map-side combine, and only those are swept in order of time against the running maximum of their ends.
    """
    keyed = covered.withColumn("bucket", F.floor(F.col("first_us") / F.lit(span)))
    buckets = keyed.groupBy(*place, "bucket").agg(F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"))
    order = Window.partitionBy(*place).orderBy("bucket")
    so_far = F.max("last_us").over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.coalesce(F.col("first_us") > so_far + F.lit(span), F.lit(True))
    numbered = buckets.withColumn("start_us", F.max(F.when(starts, F.col("first_us"))).over(order))
    # No incident id sorts behind this name, so a group is named by an incident.
    name = F.concat_ws(":", F.lit("\U0010ffff"), *[F.col(c).cast("string") for c in [*place, "start_us"]])
    named = materialize(numbered.withColumn("island", name).select(*place, "bucket", "start_us", "last_us", "island"), "island-buckets")
    islands = named.groupBy(*place, "island", "start_us").agg(F.max("last_us").alias("end_us"))
    return islands, keyed.join(named.select(*place, "bucket", "island"), [*place, "bucket"])


def _island_links(islands: DataFrame, kind: list[str], span: int, k: int) -> DataFrame:
    """Pairs (a, b) of islands of neighbouring cells that overlap.

    For each pair of cells the islands of both are swept together. Islands of one cell are disjoint, so an island can
    only overlap the last one of the other cell that began before it, or ones that begin later and find it themselves.
    """
    around = islands.withColumn("near", F.explode(k_ring(F.col("cell"), k))).filter("near <> cell")
    sides = around.select(
        *kind, F.least("cell", "near").alias("low"), F.greatest("cell", "near").alias("high"),
        (F.col("cell") < F.col("near")).alias("is_low"), "island", "start_us", "end_us",
    )
    before = Window.partitionBy(*kind, "low", "high").orderBy("start_us", "is_low").rowsBetween(Window.unboundedPreceding, -1)
    here = F.struct("island", "end_us")

    def last(side: Column) -> Column:
        return F.last(F.when(side, here), ignorenulls=True).over(before)

    other = F.when(F.col("is_low"), last(~F.col("is_low"))).otherwise(last(F.col("is_low")))
    swept = sides.withColumn("other", other).filter(F.col("other.end_us") + F.lit(span) >= F.col("start_us"))
    return swept.select(F.col("island").alias("a"), F.col("other.island").alias("b"))


def touching_links(incidents: DataFrame, window_hours: float = 6.0, k: int = 1, same_category: bool = True) -> DataFrame:
    """Links (a, b) that connect incidents whose covered cells touch while both are open.

    Incidents are linked to the islands of their cells, and islands of neighbouring cells to each other: a link per
    incident and covered cell, and at most one per island and neighbouring cell, however many incidents are open at once.
    """
    span = round(window_hours * 3_600_000_000)
    kind = ["event_category"] if same_category else []
    covered = incidents.select(
        "incident_id", *kind, F.unix_micros("first_reported_at").alias("first_us"),
        F.unix_micros("last_updated_at").alias("last_us"), F.explode(F.array_distinct("cells")).alias("cell"),
    )
    islands, placed = _islands(covered, [*kind, "cell"], span)
    of_incidents = placed.select(F.col("incident_id").alias("a"), F.col("island").alias("b"))
    return of_incidents.unionByName(_island_links(islands, kind, span, k))


def touching_incidents(
    incidents: DataFrame, window_hours: float = 6.0, k: int = 1, same_category: bool = True
) -> DataFrame:
    """Group incidents whose covered cells touch while both are open: (incident_id, group)."""
    links = materialize(touching_links(incidents, window_hours, k, same_category), "touching")
    own = incidents.select(F.col("incident_id").alias("node"))
    groups = connected_groups(own.unionByName(links.select(F.col("b").alias("node"))), links)
    return groups.join(own, "node", "left_semi").withColumnRenamed("node", "incident_id")
