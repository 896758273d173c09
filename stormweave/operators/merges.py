"""Merging incoming rows into existing tables, and assembling documents from tables.

The merges are pure functions of (existing, incoming). `sources.tables` applies them to the touched day
partitions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stormweave.operators.dedup import keep_first
from stormweave.session import materialize

TIMELINE_KEY = ["incident_id", "timestamp", "event_type", "description", "report_id"]


def insert_absent(existing: DataFrame, incoming: DataFrame, key: str | list[str] = "report_id") -> DataFrame:
    """Incoming rows whose key is not there yet (J8); append them."""
    return incoming.join(existing.select(key), key, "left_anti")


def missing_reports(reports: DataFrame, *references: DataFrame) -> DataFrame:
    """Placeholder rows for referenced but unknown reports.

    Each reference has `report_id` and may have `source` and `timestamp`, of which the earliest referenced wins.
    """
    wanted = None
    for priority, reference in enumerate(references):
        known = set(reference.columns)
        part = reference.filter(F.col("report_id").isNotNull()).select(
            "report_id",
            (F.col("source") if "source" in known else F.lit("system")).alias("source"),
            (F.col("timestamp") if "timestamp" in known else F.lit(None).cast("timestamp")).alias("timestamp"),
            F.lit(priority).alias("_priority"),
        )
        wanted = part if wanted is None else wanted.unionByName(part)
    first = keep_first(wanted, ["report_id"], [F.col("_priority"), F.col("timestamp"), F.col("source")])
    stubs = first.select(
        "report_id",
        "source",
        F.lit("stub").alias("source_type"),
        F.coalesce("timestamp", F.current_timestamp()).alias("timestamp"),
        F.concat(F.lit("Report "), "report_id", F.lit(" pending detailed payload")).alias("text"),
    )
    return insert_absent(reports, stubs)


def upsert_rows(existing: DataFrame, incoming: DataFrame, key: str = "report_id") -> DataFrame:
    """Full-row upsert, the incoming row wins and so upgrades a placeholder."""
    kept = existing.join(incoming.select(key), key, "left_anti")
    return kept.unionByName(incoming, allowMissingColumns=True)


def replace_children(
    existing: DataFrame, incoming: DataFrame, touched: DataFrame, key: list[str], surrogate: str | None = None
) -> DataFrame:
    """Reconcile child rows of the touched incidents.

    Children of other incidents stay. Those of touched incidents become exactly the incoming ones; rows found
    again by natural key keep their surrogate id, the rest are orphans and go.
    """
    kept = existing.join(touched.select("incident_id").distinct(), "incident_id", "left_anti")
    fresh = keep_first(incoming, key, [F.col(c) for c in key])
    if surrogate is not None:
        # Null-safe equality: a timeline entry need not have a report.
        old = existing.select(*[F.col(c).alias(f"_{c}") for c in key], F.col(surrogate))
        same = F.lit(True)
        for c in key:
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        fresh = fresh.drop(surrogate).join(old, same, "left").drop(*[f"_{c}" for c in key])
        fresh = fresh.withColumn(surrogate, F.coalesce(surrogate, _natural_id(key)))
    return kept.unionByName(fresh, allowMissingColumns=True)


def _natural_id(key: list[str]) -> Column:
    """Surrogate derived from the natural key, so that reruns give the same id."""
    return F.substring(F.sha2(F.to_json(F.struct(*key)), 256), 1, 16)


def upsert_incidents(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Replace scalars; an incoming row without a summary keeps the stored verification columns."""
    verification = [
        "verification_status", "overall_confidence", "supporting_count", "contradicting_count", "supporting_sources",
        "contradicting_sources", "verification_explanation", "verification_updated_at",
    ]
    old = existing.select("incident_id", *[F.col(c).alias(f"_{c}") for c in verification], F.lit(True).alias("_known"))
    joined = incoming.join(old, "incident_id", "left")
    keep_old = F.col("verification_status").isNull() & F.col("_known")
    # The status decides for all columns, so it is replaced last.
    for c in [*verification[1:], verification[0]]:
        joined = joined.withColumn(c, F.when(keep_old, F.col(f"_{c}")).otherwise(F.col(c)))
    return upsert_rows(existing, joined.select(*existing.columns), "incident_id")


def merge_preserving(existing: DataFrame, incoming: DataFrame, added: DataFrame | None = None) -> DataFrame:
    """New incidents are added; of known ones only the last update and the report count move, edits stay.

    `added` has one row per report that joins a known incident (`incident_id`), see `merge_members`.
    """
    moved = incoming.select("incident_id", F.col("last_updated_at").alias("_last"))
    kept = existing.join(moved, "incident_id", "left").withColumn(
        "last_updated_at", F.coalesce("_last", "last_updated_at")
    )
    if added is not None:
        growth = added.groupBy("incident_id").agg(F.count("*").alias("_added"))
        kept = kept.join(growth, "incident_id", "left").withColumn(
            "report_count", F.col("report_count") + F.coalesce("_added", F.lit(0))
        )
    kept = kept.select(*existing.columns)
    return kept.unionByName(insert_absent(existing, incoming, "incident_id"), allowMissingColumns=True)


#: States that only an operator sets.
_EDITED_STATES = ("ESCALATING", "RESOLVED")


def merge_refreshing(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """New incidents are added; known ones take all computed columns of the incoming row.

    Kept are the title, the first report's time and a state that only an operator sets.
    """
    kept = existing.select(
        "incident_id", F.col("title").alias("_title"), F.col("state").alias("_state"), F.col("first_reported_at").alias("_first")
    )
    state = F.when(F.col("_state").isin(*_EDITED_STATES), F.col("_state")).otherwise(F.col("state"))
    fresh = incoming.join(kept, "incident_id", "left").withColumns(
        {"title": F.coalesce("_title", "title"), "state": state, "first_reported_at": F.coalesce("_first", "first_reported_at")}
    )
    return upsert_rows(existing, fresh.select(*existing.columns), "incident_id")


def count_members(incidents: DataFrame, members: DataFrame) -> DataFrame:
    """Incidents with the number of their stored members; those without given members keep their count."""
    counts = members.groupBy("incident_id").agg(F.count_distinct("report_id").alias("_count"))
    counted = incidents.join(counts, "incident_id", "left").withColumn("report_count", F.coalesce("_count", "report_count"))
    return counted.select(*incidents.columns)


def merge_members(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Set union of an incident's report ids, as rows (U2): what has to be appended."""
    pairs = existing.select("incident_id", "report_id")
    return incoming.dropDuplicates(["incident_id", "report_id"]).join(pairs, ["incident_id", "report_id"], "left_anti")


def append_timeline(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Timeline entries that are not there yet by natural key; earlier ones are never touched."""
    fresh = incoming.dropDuplicates(TIMELINE_KEY).alias("new")
    old = existing.select(*TIMELINE_KEY).alias("old")
    same = F.lit(True)
    for c in TIMELINE_KEY:
        same = same & F.col(f"new.{c}").eqNullSafe(F.col(f"old.{c}"))
    return fresh.join(old, same, "left_anti")


def union_ids(a: Column, b: Column) -> Column:
    """Set union of two id arrays, sorted."""
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_union(F.coalesce(a, none), F.coalesce(b, none)))


def orphans(existing: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Keys stored for the incoming incidents that the incoming rows no longer have."""
    touched = existing.join(incoming.select("incident_id").distinct(), "incident_id", "left_semi")
    return touched.select(*key).join(incoming.select(*key), key, "left_anti")


# --- referential actions ------------------------------------------------------------------------------------


def cascade_delete(children: DataFrame, deleted_incidents: DataFrame) -> DataFrame:
    """Children without those of deleted incidents."""
    return children.join(deleted_incidents.select("incident_id"), "incident_id", "left_anti")


def null_deleted_reports(children: DataFrame, deleted_reports: DataFrame) -> DataFrame:
    """Children with references to deleted reports emptied."""
    gone = deleted_reports.select("report_id", F.lit(True).alias("_gone")).distinct()
    return (
        children.join(gone, "report_id", "left")
        .withColumn("report_id", F.when(F.col("_gone").isNull(), F.col("report_id")))
        .drop("_gone")
        .select(*children.columns)
    )


# --- documents ----------------------------------------------------------------------------------------------


def number_rows(rows: DataFrame, key: str, order: list[str], name: str = "n") -> DataFrame:
    """Number rows 1, 2, ... per key in the given order without gathering a key in one task.

    Rows are range-partitioned by key and order and written with their range; a key's ranges are counted, and
    only ranges, never rows of different ranges, are numbered together.
    """
    ranged = materialize(
        rows.repartitionByRange(F.col(key), *order).withColumn("_range", F.spark_partition_id()), "ranged"
    )
    counts = ranged.groupBy(key, "_range").agg(F.count("*").alias("_count"))
    before = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(key, "_range", F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(key, "_range").orderBy(*order)
    return (
        ranged.withColumn("_row", F.row_number().over(within))
        .join(starts, [key, "_range"])
        .withColumn(name, F.col("_start") + F.col("_row"))
        .drop("_range", "_row", "_start")
    )


def collect_parts(children: DataFrame, order: list[str], fields: list[str], name: str, part_size: int) -> DataFrame:
    """(incident_id, part, array) of child structs in order: part p holds children p * part_size + 1 and on.

    Only children of incidents that need several parts are numbered; those of the others are part 0 as they are.
    """
    counts = children.groupBy("incident_id").agg(F.count("*").alias("_count"))
    large = materialize(counts.filter(F.col("_count") > part_size).select("incident_id"), "large-incidents")
    first = F.lit(0).cast("bigint")
    if large.isEmpty():
        parted = children.withColumn("part", first)
    else:
        numbered = number_rows(children.join(large, "incident_id", "left_semi"), "incident_id", order)
        parted = numbered.withColumn("part", F.floor((F.col("n") - 1) / F.lit(part_size))).drop("n")
        parted = children.join(large, "incident_id", "left_anti").withColumn("part", first).unionByName(parted)
    entry = F.struct(*order, F.struct(*fields).alias("entry"))
    return parted.groupBy("incident_id", "part").agg(
        F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["entry"]).alias(name)
    )


def assemble(
    incidents: DataFrame, members: DataFrame, evidence: DataFrame, timeline: DataFrame, part_size: int = 10_000
) -> DataFrame:
    """Incident documents with report ids, evidence and time-ordered timeline.

    The unit is a page of an incident: (incident_id, part), parts numbered from 0, with up to `part_size` entries of
    each kind; the parts of an incident hold all of them. Call it on a page of incidents: children of others are cut
    away before anything is grouped.
    """
    page = incidents.select("incident_id")

    def of_page(children: DataFrame) -> DataFrame:
        return children.join(page, "incident_id", "left_semi")

    ids = collect_parts(of_page(members), ["timestamp", "report_id"], ["report_id"], "_ids", part_size)
    items = collect_parts(
        of_page(evidence), ["timestamp", "evidence_id"], [c for c in evidence.columns if c != "incident_id"],
        "evidence_items", part_size,
    )
    entries = collect_parts(
        of_page(timeline), ["timestamp", "event_type", "report_id"],
        [c for c in timeline.columns if c != "incident_id"], "timeline", part_size,
    )
    children = ids.join(items, ["incident_id", "part"], "full").join(entries, ["incident_id", "part"], "full")
    joined = incidents.join(children, "incident_id", "left")
    return joined.withColumns(
        {
            "part": F.coalesce("part", F.lit(0).cast("bigint")),
            "report_ids": F.coalesce(F.transform("_ids", lambda e: e["report_id"]), F.array().cast("array<string>")),
            "evidence_items": F.coalesce("evidence_items", F.from_json(F.lit("[]"), items.schema["evidence_items"].dataType)),
            "timeline": F.coalesce("timeline", F.from_json(F.lit("[]"), entries.schema["timeline"].dataType)),
        }
    ).drop("_ids")
