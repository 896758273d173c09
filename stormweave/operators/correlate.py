"""Grouping reports into incidents.

The rule is sequential: in time order, a report joins the earliest-created incident whose seed cell is within
`k` steps, whose latest report is at most `window` old and whose category accepts the report's; otherwise it
opens an incident. Three facts make it a distributed job with the same outcome:

* Reports of one (cell, category) whose gaps never exceed the window all go the way of the first of them: its
  incident is still open and no earlier-created one can have come back. So reports collapse to *runs*, found by
  a map-side aggregate per window-wide time bucket. However many reports a hot cell has, it has at most one
  bucket row per window of time.
* An incident is open exactly until the latest end of its runs plus the window, and a (cell, category) has at
  most one open incident. So replaying runs needs one small record per (cell, category).
* A run depends only on earlier runs within `2k` cells whose incidents may still be open. So runs are replayed per
  block, a square tile of cells and a slice of time, with a halo of neighbours around it and, before it, the runs that
  reach into the slice or end shortly before it. If every block saw the runs of other blocks decided as their owners
  decided them, all decisions are those of the sequential rule; blocks that did not are replayed with their
  neighbours' decisions given, until nothing changes. An incident that stays open over many slices hands its opener on
  from slice to slice, one round each; everything else agrees at once.

Rows are streamed through a block in time order, so memory is bounded by the cells of a tile, not by its rows, and the
history of a busy tile is spread over as many tasks as it has slices.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stormweave import rules
from stormweave.functions import identity, text
from stormweave.functions.spatial import GRID, HexGrid, axial_q, axial_r, ring_offsets
from stormweave.session import materialize

#: A block's slice of time, and how long before it runs are replayed with it: a few times the window.
SLICE_HOURS, HALO_HOURS = 336.0, 72.0

_SEQ_SPAN = 10**19
#: Columns that correlation never reads and that are large.
HEAVY = ("text", "raw_payload", "media_items")
#: Reports with different values of `_apart` never meet; 0 for all unless a caller asks for it.
_PLACE = ["_apart", "cell", "category_no"]
_RUN = [*_PLACE, "run_us"]
_LEADER = ["lead_cell", "lead_category_no", "lead_us", "lead_seq"]


def arrival(report_id: Column) -> Column:
    """The number that breaks ties in time: ids that are plain numbers count arrivals, others are ordered by their hash."""
    hashed = F.xxhash64(report_id).bitwiseAND(F.lit(0x7FFF_FFFF_FFFF_FFFF))
    return F.when(report_id.rlike("^(0|[1-9][0-9]{0,17})$"), report_id.try_cast("bigint")).otherwise(hashed)


def with_features(reports: DataFrame, grid: HexGrid = GRID) -> DataFrame:
    """Add `event_category`, `is_negated`, `cell` and a non-negative `seq` that breaks ties in time (see `arrival`).

    Columns already present are kept, so observations with numeric readings can bring their own; reports whose text has
    been dropped must bring what is read from it.
    """
    wanted: dict[str, Column] = {
        "event_category": text.event_category(F.col("text")),
        "is_negated": text.is_negated(F.col("text")),
        "cell": grid.cell(F.col("latitude"), F.col("longitude")),
        "seq": arrival(F.col("report_id")),
    }
    added: dict[str, Column] = {}
    for name, column in wanted.items():
        if name not in reports.columns:
            added[name] = column
        elif name != "seq" and (name == "cell" or "text" in reports.columns):
            added[name] = F.coalesce(F.col(name), column)
    return reports.withColumns(added)


def _category_number(category: Column, categories: list[str]) -> Column:
    return F.array_position(F.array(*[F.lit(c) for c in categories]), category).cast("int")


def _order_key(ts: Column, seq: Column) -> Column:
    """(time, seq) as one decimal: an ordered value a hash aggregate can hold in place."""
    micros = F.unix_micros(ts).cast("decimal(17,0)")
    return micros * F.lit(Decimal(_SEQ_SPAN)).cast("decimal(20,0)") + seq.cast("decimal(19,0)")


def drop_leading_negations(featured: DataFrame) -> DataFrame:
    """Drop negated reports that come before the first report that is not negated."""
    first = (
        featured.filter(~F.col("is_negated"))
        .agg(F.min(_order_key(F.col("timestamp"), F.col("seq"))).alias("first"))
        .scalar()
    )
    return featured.filter(_order_key(F.col("timestamp"), F.col("seq")) >= first)


def _drop_leading_negations_apart(slim: DataFrame) -> DataFrame:
    """`drop_leading_negations` among the reports of each value of `_apart`; `_single` marks the only report of its value."""
    key = _order_key(F.col("timestamp"), F.col("seq"))
    parts = slim.groupBy("_apart").agg(F.min(F.when(~F.col("is_negated"), key)).alias("_first"), F.count("*").alias("_reports"))
    kept = slim.join(parts, "_apart").filter(key >= F.col("_first"))
    return kept.withColumn("_single", F.col("_reports") == 1).drop("_first", "_reports")


def _micros(window_hours: float) -> int:
    return round(window_hours * 3_600_000_000)


def session_buckets(
    rows: DataFrame, keys: list[str], window_hours: float = 6.0, carry: str | None = None
) -> DataFrame:
    """One row per (keys, bucket) with the run it belongs to: `run_us`, `run_seq`, `run_end_us`.

    `carry` names a numeric column whose value in the run's first row is wanted too, as `run_<carry>`.

    Rows need `timestamp` and `seq`. A run breaks where consecutive rows are more than the window apart. Rows
    of one bucket are always in one run, so the window functions see buckets and never the rows themselves.
    """
    span = _micros(window_hours)
    key = _order_key(F.col("timestamp"), F.col("seq"))
    carried = [] if carry is None else [F.min_by(F.col(carry), key).alias("first_carry")]
    buckets = (
        rows.withColumn("bucket", F.floor(F.unix_micros("timestamp") / F.lit(span)))
        .groupBy(*keys, "bucket")
        .agg(
            F.min(key).alias("first_key"),
            F.max(F.unix_micros("timestamp")).alias("last_us"),
            *carried,
        )
        .withColumn("first_us", F.expr(f"cast(first_key div {_SEQ_SPAN} as bigint)"))
        .withColumn("first_seq", (F.col("first_key") % F.lit(Decimal(_SEQ_SPAN)).cast("decimal(20,0)")).cast("bigint"))
        .drop("first_key")
    )
    in_time = Window.partitionBy(*keys).orderBy("bucket")
    gap = F.col("first_us") - F.lag("last_us").over(in_time)
    started = buckets.withColumn("starts", F.coalesce(gap > span, F.lit(True)))
    numbered = started.withColumn("run_us", F.max(F.when(F.col("starts"), F.col("first_us"))).over(in_time))
    of_run = Window.partitionBy(*keys, "run_us")
    return numbered.select(
        *keys,
        "bucket",
        "run_us",
        F.max(F.when(F.col("starts"), F.col("first_seq"))).over(of_run).alias("run_seq"),
        F.max("last_us").over(of_run).alias("run_end_us"),
        *([] if carry is None else [F.max(F.when(F.col("starts"), F.col("first_carry"))).over(of_run).alias(f"run_{carry}")]),
    )


def number_sessions(rows: DataFrame, keys: list[str], window_hours: float = 6.0) -> DataFrame:
    """Every row with the start and number (from 1) of its session within `keys`; a row with a null key is one of its own."""
    keyed = F.lit(True)
    for key in keys:
        keyed = keyed & F.col(key).isNotNull()
    alone = rows.filter(~keyed).withColumns({"session_no": F.lit(1), "session_start": F.col("timestamp")})
    rows = rows.filter(keyed)
    buckets = session_buckets(rows, keys, window_hours)
    by_start = Window.partitionBy(*keys).orderBy("run_us")
    numbered = buckets.select(*keys, "bucket", "run_us", F.dense_rank().over(by_start).alias("session_no"))
    in_sessions = (
        rows.withColumn("bucket", F.floor(F.unix_micros("timestamp") / F.lit(_micros(window_hours))))
        .join(numbered, [*keys, "bucket"])
        .withColumn("session_start", F.timestamp_micros("run_us"))
        .drop("bucket", "run_us")
    )
    return in_sessions.unionByName(alone)


# --- exact first-match rule ---------------------------------------------------------------------------------


_BLOCK = ["tile", "slice", "_apart"]
_GIVEN = {"given_cell": -1, "given_category_no": -1, "given_us": -1, "given_seq": -1}


def _replay(k: int, span: int, accepts: dict[int, tuple[int, ...]], categories: int):
    """Streaming replay of runs sorted by (block, time); the state is one record per (cell, category)."""
    offsets = ring_offsets(k)
    # For each report category, the incident categories that accept it.
    takers = {c: [i for i in range(1, categories + 1) if c in accepts.get(i, (i,))] for c in range(1, categories + 1)}
    columns = [*_BLOCK, "cell", "category_no", "run_us", "run_seq", "run_end_us", "is_given", *_GIVEN]

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block_now = None
        state: dict[tuple[int, int], list] = {}
        for batch in batches:
            decided: list[tuple[int, int, int, int]] = []
            for *block, cell, category, start, seq, end, given, g_cell, g_cat, g_us, g_seq in zip(
                *(batch[c].tolist() for c in columns), strict=True
            ):
                if block != block_now:
                    block_now, state = block, {}
                if given:
                    # The owner's decision, whose opener may lie outside what this block sees.
                    key, opener = (g_cell, g_cat), (g_us, g_seq, g_cell, g_cat)
                    best = state.get(key)
                    if best is None or best[0] != opener:
                        best = state[key] = [opener, end]
                else:
                    best = None
                    for offset in offsets:
                        for taker in takers[category]:
                            record = state.get((cell + offset, taker))
                            if record is not None and start - record[1] <= span and (best is None or record[0] < best[0]):
                                best = record
                    if best is None:
                        best = state[(cell, category)] = [(start, seq, cell, category), end]
                if end > best[1]:
                    best[1] = end
                decided.append(best[0])
            out = batch[[*_BLOCK, "owned", "near", "cell", "category_no", "run_us", "run_seq", "run_end_us"]].copy()
            for position, name in enumerate(("lead_us", "lead_seq", "lead_cell", "lead_category_no")):
                out[name] = [d[position] for d in decided]
            yield out

    schema = (
        "tile long, slice long, _apart long, owned boolean, near boolean, cell long, category_no int, run_us long, run_seq long,"
        " run_end_us long, lead_us long, lead_seq long, lead_cell long, lead_category_no int"
    )
    return decide, schema


def _placed(runs: DataFrame, k: int, tile_cells: int, halo_cells: int, span: int, slice_us: int, halo_us: int) -> DataFrame:
    """Runs copied to their own block, to every tile whose halo they lie in and to the slices they can still matter in.

    `near` marks the copies a block's own decisions may depend on; the others only help it to see those right.
    """
    q, r = axial_q(F.col("cell")), axial_r(F.col("cell"))

    def tiles(axis: Column) -> Column:
        return F.sequence(
            F.floor((axis - halo_cells) / F.lit(tile_cells)), F.floor((axis + halo_cells) / F.lit(tile_cells))
        )

    def outside(axis: Column, tile: Column) -> Column:
        low = tile * tile_cells
        return F.greatest(low - axis, axis - (low + tile_cells - 1), F.lit(0))

    own = F.floor(F.col("run_us") / F.lit(slice_us))
    last = F.floor((F.col("run_end_us") + span + halo_us) / F.lit(slice_us))
    placed = (
        runs.withColumn("tq", F.explode(tiles(q)))
        .withColumn("tr", F.explode(tiles(r)))
        .withColumn("depth", F.greatest(outside(q, F.col("tq")), outside(r, F.col("tr"))))
        .withColumn("slice", F.explode(F.sequence(own, last)))
    )
    reaches = F.col("run_end_us") + span >= F.col("slice") * slice_us
    return placed.select(
        *runs.columns,
        (F.col("tq") * F.lit(1 << 24) + F.col("tr")).alias("tile"),
        "slice",
        ((F.col("depth") == 0) & (F.col("slice") == own)).alias("owned"),
        ((F.col("depth") <= 2 * k) & reaches).alias("near"),
    )


def assign_runs(
    runs: DataFrame,
    categories: list[str],
    compatible: dict[str, tuple[str, ...]],
    window_hours: float,
    k: int,
    tile_cells: int,
    halo_cells: int,
    slice_hours: float = SLICE_HOURS,
    halo_hours: float = HALO_HOURS,
) -> DataFrame:
    """Each run with the run that opened its incident (itself for an opener); `fixed` runs open their own."""
    if halo_cells < 2 * k:
        raise ValueError("the halo must reach 2k cells")
    number = {c: i for i, c in enumerate(categories, start=1)}
    accepts = {
        number[c]: tuple(number[a] for a in accepted if a in number) for c, accepted in compatible.items() if c in number
    }
    span = _micros(window_hours)
    decide, schema = _replay(k, span, accepts, len(categories))
    placed = _placed(runs, k, tile_cells, halo_cells, span, _micros(slice_hours), _micros(halo_hours))

    def replay(rows: DataFrame, label: str) -> DataFrame:
        in_order = rows.repartition(*_BLOCK).sortWithinPartitions(*_BLOCK, "run_us", "run_seq")
        return materialize(in_order.mapInPandas(decide, schema), label)

    # Open incidents of earlier batches are runs that are known to have opened their own incident.
    own_key = dict(zip(_GIVEN, [*_RUN[1:], "run_seq"], strict=True))
    first = {c: F.when(F.col("fixed"), F.col(own_key[c])).otherwise(F.lit(no)) for c, no in _GIVEN.items()}
    seen = replay(placed.withColumns({"is_given": F.col("fixed"), **first}), "replay-0")
    owner = seen.filter("owned").select(*_RUN, "run_seq", "run_end_us", *_LEADER)

    def differs(a: str, b: str) -> Column:
        return (F.struct(*[f"{a}{c}" for c in _LEADER]) != F.struct(*[f"{b}{c}" for c in _LEADER]))

    ours = owner.select(*_RUN, *[F.col(c).alias(f"own_{c}") for c in _LEADER])
    stale = seen.filter("near and not owned").join(ours, _RUN).filter(differs("", "own_")).select(*_BLOCK).distinct()
    round_no = 0
    while not stale.isEmpty():
        round_no += 1
        given = owner.select(*_RUN, *[F.col(c).alias(g) for c, g in zip(_LEADER, _GIVEN, strict=True)])
        again = placed.join(stale, _BLOCK, "left_semi").join(given, _RUN).withColumn("is_given", ~F.col("owned") | F.col("fixed"))
        seen = replay(again, f"replay-{round_no}")
        fresh = seen.filter("owned").select(*_RUN, "run_seq", "run_end_us", *_LEADER)
        previous = owner.select(*_RUN, *[F.col(c).alias(f"old_{c}") for c in _LEADER])
        changed = fresh.join(previous, _RUN).filter(differs("", "old_"))
        changed = materialize(changed.select(*_RUN, "run_seq", "run_end_us", *_LEADER), f"changed-{round_no}")
        if changed.isEmpty():
            break
        owner = materialize(owner.join(changed.select(*_RUN), _RUN, "left_anti").unionByName(changed), f"owner-{round_no}")
        # A block must be replayed again when a run that matters to it got another decision in this round.
        stale = placed.filter("near and not owned").join(changed.select(*_RUN), _RUN, "left_semi").select(*_BLOCK).distinct()
    return owner


def correlate_exact(
    reports: DataFrame,
    window_hours: float = 6.0,
    k: int = 1,
    compatible: dict[str, tuple[str, ...]] = rules.COMPATIBLE,
    taxonomy: dict[str, tuple[str, ...]] = rules.TAXONOMY,
    grid: HexGrid = GRID,
    tile_cells: int = 64,
    halo_cells: int | None = None,
    id_chars: int = 12,
    open_incidents: DataFrame | None = None,
    slice_hours: float = SLICE_HOURS,
    halo_hours: float = HALO_HOURS,
    apart: str | None = None,
) -> DataFrame:
    """Reports that belong to an incident, with `incident_id`, `incident_category` and `opens`.

    Reports that differ in the column `apart` are correlated as if they came in batches of their own (values are told
    apart by a 64-bit hash). Incidents of two batches may have one id; the first report of them all then opens it. A
    batch of one report has nothing to be replayed against: what is left of it opens an incident of its own.

    `open_incidents` (`incident_id`, `event_category`, `cells` with the seed cell first, `first_reported_at`,
    `last_updated_at`) may be joined like incidents of this batch; nothing is then dropped as a leading negation. They
    are older than incidents of this batch; `first_seq`, the number of their first report, orders those of one moment.

    Report ids must be unique (see `dedup.keep_first`). Runs jobs when called: the features are written to the shared
    folder with all columns but the heavy ones (HEAVY), and members are made of those; only callers that pass heavy
    columns in have them joined to the result by report id.
    """
    categories = [*taxonomy, rules.OTHER]
    featured = with_features(reports, grid)
    part = F.lit(0).cast("bigint") if apart is None else F.xxhash64(apart)
    slim = materialize(featured.drop(*HEAVY).withColumn("_apart", part), "features")
    if open_incidents is not None:
        kept = slim
    else:
        kept = drop_leading_negations(slim) if apart is None else materialize(_drop_leading_negations_apart(slim), "parts")
    members = assign_reports(
        kept.withColumn("category_no", _category_number(F.col("event_category"), categories)),
        categories, compatible, window_hours, k, tile_cells, 2 * k + 6 if halo_cells is None else halo_cells, id_chars,
        open_incidents, slice_hours, halo_hours,
    )
    if apart is not None:
        first = F.min(F.when(F.col("opens"), _order_key(F.col("timestamp"), F.col("seq")))).alias("_first")
        opener = members.groupBy("incident_id").agg(first)
        opens = F.col("opens") & (_order_key(F.col("timestamp"), F.col("seq")) == F.col("_first"))
        members = members.join(opener, "incident_id").withColumn("opens", opens).drop("_first")
    heavy = [c for c in HEAVY if c in reports.columns]
    return members.join(reports.select("report_id", *heavy), "report_id") if heavy else members


def assign_reports(
    kept: DataFrame,
    categories: list[str],
    compatible: dict[str, tuple[str, ...]],
    window_hours: float,
    k: int,
    tile_cells: int,
    halo_cells: int,
    id_chars: int = 12,
    open_incidents: DataFrame | None = None,
    slice_hours: float = SLICE_HOURS,
    halo_hours: float = HALO_HOURS,
) -> DataFrame:
    """The rows of `kept`, which have a category number, with their incident's id and category and whether they open it."""
    columns = [c for c in kept.columns if c not in ("category_no", "_apart", "_single")]
    # Without a cell nothing ever matches: every report is an incident of its own, told apart by its id. With one, the
    # only report of its batch has none to match.
    single = F.col("_single") & (F.col("category_no") > 0) if "_single" in kept.columns else F.lit(False)
    by_itself = F.col("cell").isNull() | F.coalesce(single, F.lit(False))
    place = F.coalesce(F.col("cell").cast("string"), F.concat_ws("_", F.lit("None"), "report_id"))
    alone = kept.filter(by_itself).select(
        *columns,
        identity.incident_id(F.col("event_category"), place, F.col("timestamp"), id_chars).alias("incident_id"),
        F.col("event_category").alias("incident_category"),
        F.lit(True).alias("opens"),
    )
    located = kept.filter(~by_itself)
    if "_single" in kept.columns and located.isEmpty():
        return alone
    buckets = materialize(session_buckets(located, _PLACE, window_hours), "buckets")
    runs = buckets.groupBy(*_RUN).agg(F.max("run_seq").alias("run_seq"), F.max("run_end_us").alias("run_end_us"))
    runs = runs.withColumn("fixed", F.lit(False))
    if open_incidents is not None:
        # Below all numbers of reports, in the order of their own.
        older = F.lit(-1).cast("bigint")
        if "first_seq" in open_incidents.columns:
            older = F.coalesce(F.col("first_seq") + F.lit(-(1 << 63)), older)
        earlier = open_incidents.filter(F.size("cells") > 0).select(
            F.lit(0).cast("bigint").alias("_apart"),
            F.get("cells", 0).alias("cell"),
            _category_number(F.col("event_category"), categories).alias("category_no"),
            F.unix_micros("first_reported_at").alias("run_us"),
            older.alias("run_seq"),
            F.unix_micros("last_updated_at").alias("run_end_us"),
            F.lit(True).alias("fixed"),
            "incident_id",
        )
        runs = runs.unionByName(earlier.drop("incident_id"))
    owner = assign_runs(runs, categories, compatible, window_hours, k, tile_cells, halo_cells, slice_hours, halo_hours)
    led = buckets.select(*_RUN, "bucket").join(owner.select(*_RUN, *_LEADER), _RUN).drop("run_us")
    names = F.array(*[F.lit(c) for c in categories])
    category = F.element_at(names, F.col("lead_category_no"))
    opened_at = F.timestamp_micros("lead_us")
    made_id = identity.incident_id(category, F.col("lead_cell").cast("string"), opened_at, id_chars)
    if open_incidents is not None:
        known = earlier.select(
            F.col("cell").alias("lead_cell"), F.col("category_no").alias("lead_category_no"),
            F.col("run_us").alias("lead_us"), F.col("run_seq").alias("lead_seq"), F.col("incident_id").alias("known_id"),
        )
        led = led.join(known, _LEADER, "left")
        made_id = F.coalesce("known_id", made_id)
    # Named once per bucket, not once per report.
    led = led.withColumns({"incident_id": made_id, "incident_category": category})
    in_cells = (
        located.withColumn("bucket", F.floor(F.unix_micros("timestamp") / F.lit(_micros(window_hours))))
        .join(led, [*_PLACE, "bucket"])
        .select(
            *columns,
            "incident_id",
            "incident_category",
            ((F.unix_micros("timestamp") == F.col("lead_us")) & (F.col("seq") == F.col("lead_seq"))).alias("opens"),
        )
    )
    return in_cells.unionByName(alone)


# --- set-based variant --------------------------------------------------------------------------------------


def category_families(compatible: dict[str, tuple[str, ...]] = rules.COMPATIBLE) -> dict[str, str]:
    """Category to family: the connected parts of the compatibility map, named by the alphabetically first member."""
    family = {c: c for c in compatible}
    changed = True
    while changed:
        changed = False
        for category, accepted in compatible.items():
            for other in accepted:
                low = min(family[category], family.get(other, other))
                for member in (category, other):
                    if family.get(member) != low:
                        family[member], changed = low, True
    return family


def family_of(category: Column, compatible: dict[str, tuple[str, ...]] = rules.COMPATIBLE) -> Column:
    pairs = [F.lit(x) for pair in category_families(compatible).items() for x in pair]
    return F.coalesce(F.element_at(F.create_map(*pairs), category), category)


def correlate_session(
    reports: DataFrame,
    window_hours: float = 6.0,
    compatible: dict[str, tuple[str, ...]] = rules.COMPATIBLE,
    grid: HexGrid = GRID,
    id_chars: int = 12,
) -> DataFrame:
    """One incident per cell, category family and session; same columns as `correlate_exact`.

    No neighbour search and no sequence: a plain aggregate and join, and the form that streams.
    """
    categories = list(compatible)
    featured = with_features(reports, grid).withColumn("family", family_of(F.col("event_category"), compatible))
    located = featured.filter(F.col("cell").isNotNull())
    numbered = located.withColumn("category_no", _category_number(F.col("event_category"), categories))
    buckets = session_buckets(numbered, ["cell", "family"], window_hours, carry="category_no")
    joined = located.withColumn("bucket", F.floor(F.unix_micros("timestamp") / F.lit(_micros(window_hours)))).join(
        buckets, ["cell", "family", "bucket"]
    )
    own = [F.col(c) for c in featured.columns if c != "family"]
    names = F.array(*[F.lit(c) for c in categories])
    in_cells = joined.select(
        *own,
        identity.incident_id(
            F.col("family"), F.col("cell").cast("string"), F.timestamp_micros("run_us"), id_chars
        ).alias("incident_id"),
        F.element_at(names, F.col("run_category_no")).alias("incident_category"),
        ((F.unix_micros("timestamp") == F.col("run_us")) & (F.col("seq") == F.col("run_seq"))).alias("opens"),
    )
    alone = featured.filter(F.col("cell").isNull()).select(
        *own,
        identity.incident_id(
            F.col("family"), F.concat_ws("_", F.lit("None"), "report_id"), F.col("timestamp"), id_chars
        ).alias("incident_id"),
        F.col("event_category").alias("incident_category"),
        F.lit(True).alias("opens"),
    )
    return in_cells.unionByName(alone)
