"""Continuous jobs: correlate, store and announce, with or without memory of earlier batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from stormweave import rules
from stormweave.functions.identity import iso_utc
from stormweave.functions.spatial import GRID, HexGrid
from stormweave.operators import correlate, incidents
from stormweave.operators.incidents import IncidentTables
from stormweave.schemas import columns
from stormweave.session import materialize, temporary_stages
from stormweave.sources.tables import Tables, utc_day
from stormweave.streaming.memory import OPEN_DDL, OpenIncidents

UPDATED = "incident.updated"
POLL_SECONDS = {"grid_points": 300, "rss": 180}


def change_events(updated: DataFrame, at: Column | None = None) -> DataFrame:
    """`incident.updated` envelopes."""
    moment = F.current_timestamp() if at is None else at
    plain = [c for c in updated.columns if c != "day"]
    return updated.select(
        F.lit(UPDATED).alias("event"),
        "incident_id",
        moment.alias("timestamp"),
        F.to_json(
            F.struct(F.lit(UPDATED).alias("event"), "incident_id", iso_utc(moment).alias("timestamp"),
                     F.struct(*plain).alias("incident"))
        ).alias("value"),
    )


def pipeline_handler(
    tables: Tables, feed_path: str, as_of: Column | None = None, remember: bool = False, window_hours: float = 6.0, **options
) -> Callable[[DataFrame, int], None]:
    """Handler for one batch: correlate, insert reports, merge incidents, then announce.

    The result of a batch is settled before it is merged, and the merge can be repeated, so an attempt that failed at
    any point is made good by the next one. Events are written only after the tables, under the batch id, so a
    repeated batch replaces its own events. With `remember`, reports may join open incidents of earlier batches (R4),
    which are kept beside the tables; reports that came before are left out.
    With `apart="report_id"` among the options each report triggers a correlation of its own, however many came together (R3).
    """
    memory = OpenIncidents(tables.spark, f"{tables.folder.rstrip('/')}/_open")

    def handle(reports: DataFrame, batch_id: int) -> None:
        # A new log counts its batches from 0 again, so the ids of the reports are part of a batch's name.
        mark = reports.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("report_id")), F.lit(0))).first()
        name = f"{batch_id}-{mark[0]}-{mark[1] & (1 << 64) - 1:x}"
        before = memory.before(name) if remember else None
        result = tables.pending(name)
        if result is None:
            fresh = tables.fresh_reports(name, reports) if remember else reports
            tables.add_reports(fresh)
            # Taken from the store: an earlier attempt may have got as far as that.
            days = fresh.select(utc_day(F.col("timestamp")).alias("day"))
            source = tables.of_days("reports", days).join(fresh.select("report_id"), "report_id", "left_semi")
            if source.isEmpty():
                return
            if remember:
                result = continue_incidents(source, tables, as_of, window_hours, before=before, **options)
            else:
                source = source.drop("day", "event_category", "cell")
                result = incidents.detect_incidents(source, as_of, window_hours=window_hours, **options)
            result = tables.settle(name, result)
        updated = tables.merge_incidents(result, refresh=remember)
        if remember:
            # A window more than needed, for reports that come a little late.
            memory.keep(name, before, result.incidents, 2 * window_hours)
        change_events(updated, as_of).select("value").write.mode("overwrite").text(f"{feed_path}/batch={batch_id}")

    return handle


def correlate_stream(
    stream: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str
) -> DataStreamWriter:
    """Stream writer that hands batches of validated reports to a handler (R3, R4); each batch's stages are deleted after it."""

    def process(batch: DataFrame, batch_id: int) -> None:
        with temporary_stages(batch.sparkSession):
            handler(materialize(batch, "micro-batch"), batch_id)

    return stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)


def continue_incidents(
    reports: DataFrame,
    tables: Tables,
    as_of: Column | None = None,
    window_hours: float = 6.0,
    k: int = 1,
    before: DataFrame | None = None,
    **options,
) -> IncidentTables:
    """Correlate a batch with the incidents still open before it.

    Batches are taken to arrive in time order. Stored incidents that got reports are scored again over all theirs, read
    from the days of those. `before` are the remembered open incidents; without them the store is searched once.
    """
    moment = F.current_timestamp() if as_of is None else as_of
    featured = correlate.with_features(reports.drop("day", "event_category", "cell")).drop(*correlate.HEAVY)
    featured = materialize(featured, "batch")
    reach = F.expr(f"INTERVAL {round(window_hours * 3600)} SECONDS")
    low = featured.agg(F.min("timestamp")).first()[0]
    everything = tables.read("incidents") if before is None else before
    stored = everything.filter(F.col("last_updated_at") >= F.lit(low).cast("timestamp") - reach)
    if before is not None:
        # Deleted meanwhile: not open any more. Only the days of open incidents are looked at.
        stored = stored.join(tables.of_days("incidents", stored).select("incident_id"), "incident_id", "left_semi")
    stored = materialize(stored.select(*columns(OPEN_DDL)), "open-incidents")
    held = tables.of_days("incident_members", stored).join(stored.select("incident_id", "first_reported_at"), "incident_id")
    held = materialize(held.select("incident_id", "report_id", "timestamp", "first_reported_at"), "open-members")
    # Of incidents opened at one moment the one whose first report has the smaller number was created earlier.
    opened = held.filter(F.col("timestamp") == F.col("first_reported_at")).groupBy("incident_id").agg(
        F.min(correlate.arrival(F.col("report_id"))).alias("first_seq")
    )
    # Leading negated reports are dropped only while there is no incident at all.
    start = None if before is None and everything.isEmpty() else materialize(stored.join(opened, "incident_id", "left"), "opened")
    found = correlate.correlate_exact(featured, window_hours=window_hours, k=k, open_incidents=start, **options)
    found = materialize(found, "found")
    fresh = found.join(stored.select("incident_id"), "incident_id", "left_anti")
    matched = found.join(stored.select("incident_id"), "incident_id", "left_semi").select("incident_id", "report_id")

    touched = stored.join(matched.select("incident_id").distinct(), "incident_id", "left_semi")
    openings = touched.select("incident_id", F.col("event_category").alias("incident_category"), "first_reported_at")
    old = held.join(touched.select("incident_id"), "incident_id", "left_semi").select("incident_id", "report_id", "timestamp")
    old = materialize(old, "old-members")
    old_ids = old.select("incident_id", "report_id").unionByName(matched.select("incident_id", "report_id"))
    # Only days of the members are read.
    days = old.select("timestamp").union(featured.select("timestamp")).select(utc_day(F.col("timestamp")).alias("day"))
    known = tables.of_days("reports", days).drop("day", "event_category", "cell")
    rejoined = correlate.with_features(known.join(old_ids.distinct(), "report_id")).join(openings, "incident_id")
    # The opener is the first report at the incident's first time.
    first = rejoined.filter(F.col("timestamp") == F.col("first_reported_at")).groupBy("incident_id").agg(
        F.min("seq").alias("first_seq")
    )
    rejoined = (
        rejoined.join(first, "incident_id")
        .withColumn(
            "opens", (F.col("timestamp") == F.col("first_reported_at")) & (F.col("seq") == F.col("first_seq"))
        )
        .drop("first_reported_at", "first_seq")
    )
    members = rejoined.drop(*correlate.HEAVY).unionByName(fresh, allowMissingColumns=True)
    return incidents.from_members(materialize(members, "members"), moment)


# --- streaming sessions -------------------------------------------------------------------------------------


def stream_sessions(
    stream: DataFrame, window_hours: float = 6.0, grid: HexGrid = GRID, lateness: str | None = None
) -> DataFrame:
    """Set-based incidents on a stream: one session per cell and category family.

    A report without a cell is a session of its own, as in the batch form. A session closes, and is emitted, once the
    watermark has passed its end. Reports later than `lateness` behind the newest are dropped by the watermark;
    `route_late` keeps them.
    """
    delay = f"{round(window_hours * 3600)} seconds"
    featured = correlate.with_features(stream.drop("seq"), grid)
    featured = featured.withColumn("alone", F.when(F.col("cell").isNull(), F.col("report_id")))
    family = correlate.family_of(F.col("event_category"), rules.COMPATIBLE)
    # A session window joins rows whose gap is at most the gap duration.
    session = F.session_window("timestamp", delay)
    return (
        featured.withColumn("family", family)
        .withWatermark("timestamp", lateness or delay)
        .groupBy("cell", "family", "alone", session.alias("session"))
        .agg(
            F.count("*").alias("reports"),
            F.min("timestamp").alias("first_reported_at"),
            F.max("timestamp").alias("last_updated_at"),
            F.count_if("is_negated").alias("contradicting"),
        )
        .select("cell", "family", "first_reported_at", "last_updated_at", "reports", "contradicting")
    )


def late_reports(batch: DataFrame, newest_before: Column, window_hours: float = 6.0) -> DataFrame:
    """Reports of a batch that lie behind the watermark of the batches before it, for the late table."""
    reach = F.expr(f"INTERVAL {round(window_hours * 3600)} SECONDS")
    return batch.filter(F.col("timestamp") < newest_before - reach)


def route_late(path: str, handler: Callable[[DataFrame, int], None] | None = None, window_hours: float = 6.0):
    """Batch function for `foreachBatch` that keeps late reports in a table of their own.

    The newest time so far is one row, in a version per batch of which the last two are kept: a batch reads the one of
    the batch before and replaces its own when repeated. Late reports, those behind the watermark of the batches before,
    are written under the batch's id. All reports of the batch go on to `handler`.
    """

    def process(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        java_path = spark._jvm.org.apache.hadoop.fs.Path

        def clock(number: int) -> str:
            return f"{path}/newest/batch={number}"

        def files(number: int):
            return java_path(clock(number)).getFileSystem(spark._jsc.hadoopConfiguration())

        with temporary_stages(spark):
            settled = materialize(batch, "routed-batch")
            before = None
            if batch_id > 0 and files(batch_id).exists(java_path(clock(batch_id - 1))):
                before = spark.read.schema("newest timestamp").parquet(clock(batch_id - 1)).first()["newest"]
            late = late_reports(settled, F.lit(before).cast("timestamp"), window_hours) if before else settled.limit(0)
            late.write.mode("overwrite").parquet(f"{path}/late/batch={batch_id}")
            newest = F.greatest(F.max("timestamp"), F.lit(before).cast("timestamp"))
            settled.agg(newest.alias("newest")).write.mode("overwrite").parquet(clock(batch_id))
            if handler is not None:
                handler(settled, batch_id)
            files(batch_id).delete(java_path(clock(batch_id - 2)), True)

    return process
