"""The four tables as Parquet, partitioned by day, with merges that rewrite only the days they touch.

Reports are partitioned by the day of the report, incidents and their children by the day the incident was first
reported. A merge reads the touched days, writes the result to the shared folder and then overwrites those
partitions, so it never reads what it overwrites.

Every merge can be repeated after a failure at any of its writes and then gives the same tables: children are written
before the incidents that count them, appends add only what is not there, an incident's report count is the number of
its stored members, and a row that moves to another day leaves its old day in the same step that is found again by id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stormweave.functions.identity import utc_day
from stormweave.operators import merges
from stormweave.operators.incidents import IncidentTables
from stormweave.schemas import EVIDENCE_DDL, INCIDENT_DDL, MEMBER_DDL, REPORT_DDL, TIMELINE_DDL, columns
from stormweave.session import materialize
from stormweave.sources.idindex import DayIndex

_DDL = {
    "reports": REPORT_DDL,
    "incidents": INCIDENT_DDL,
    "incident_members": MEMBER_DDL,
    "evidence_items": EVIDENCE_DDL,
    "incident_timeline": TIMELINE_DDL,
}
_CHILDREN = ("incident_members", "evidence_items", "incident_timeline")
STUB = "stub"
_STUB_DDL = "report_id string, day date"
EVIDENCE_KEY = ["incident_id", "report_id"]


@dataclass(frozen=True)
class Tables:
    """Tables below one folder."""

    spark: SparkSession
    folder: str

    def path(self, table: str) -> str:
        return f"{self.folder.rstrip('/')}/{table}"

    def read(self, table: str) -> DataFrame:
        """A table with its `day` partition column; empty before the first write."""
        schema = f"{_DDL[table]}, day date"
        if not self._exists(self.path(table)):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path(table))

    def append(self, table: str, rows: DataFrame) -> None:
        # Rebalanced by day: a day of many rows is split over tasks and files, days of few rows share a task.
        spread = rows.select(*columns(_DDL[table]), "day").hint("rebalance", "day")
        spread.write.mode("append").partitionBy("day").parquet(self.path(table))

    def overwrite_days(self, table: str, rows: DataFrame) -> None:
        """Replace the day partitions present in `rows`; the rows are settled first, the days by Spark."""
        settled = materialize(rows.select(*columns(_DDL[table]), "day"), f"merge-{table}")
        (
            settled.hint("rebalance", "day")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("day")
            .parquet(self.path(table))
        )

    def of_days(self, table: str, days: DataFrame) -> DataFrame:
        """Rows of the given days; the semi-join prunes partitions at run time."""
        return self.read(table).join(days.select("day").distinct(), "day", "left_semi")

    # --- reports

    def add_reports(self, reports: DataFrame) -> DataFrame:
        """Insert reports that are not there yet (J8); gives back what was added.

        A report id contains its time, so a repeated report falls on the same day and only that day is read. A
        placeholder of the same id, on whatever day, gives way to the report.
        """
        dated = reports.withColumn("day", utc_day(F.col("timestamp")))
        existing = self.of_days("reports", materialize(dated.select("day").distinct(), "days")).filter(F.col("source_type") != STUB)
        new = materialize(merges.insert_absent(existing, dated.dropDuplicates(["report_id"])), "new-reports")
        self.append("reports", new)
        self._drop_stubs(reports)
        return new

    def fresh_reports(self, batch: str, reports: DataFrame) -> DataFrame:
        """Those reports of a batch that the store did not have when the batch was first tried."""
        path = self._pending(batch, "fresh")
        if not self._exists(f"{path}/_SUCCESS"):
            incoming = reports.dropDuplicates(["report_id"]).withColumn("day", utc_day(F.col("timestamp")))
            existing = self.of_days("reports", incoming).filter(F.col("source_type") != STUB)
            merges.insert_absent(existing, incoming).drop("day").write.mode("overwrite").parquet(path)
        return self.spark.read.schema(reports.schema).parquet(path)

    def _drop_stubs(self, reports: DataFrame) -> None:
        """Remove placeholders of reports that are stored by now.

        Only days that ever got a placeholder of one of these ids are read.
        """
        if not self._exists(self._stub_days()):
            return
        ids = reports.select("report_id")
        noted = self.spark.read.schema(_STUB_DDL).parquet(self._stub_days()).join(ids, "report_id", "left_semi")
        of_them = self.of_days("reports", materialize(noted, "noted-stubs")).filter(F.col("source_type") == STUB).join(ids, "report_id", "left_semi")
        gone = materialize(of_them.select("report_id", "source_type", "day"), "stubs")
        if not gone.isEmpty():
            left = self.of_days("reports", gone).join(gone, ["report_id", "source_type"], "left_anti")
            self._rewrite("reports", left, gone)

    def upsert_reports(self, reports: DataFrame) -> None:
        """Full-row upsert (J10): days of the stored versions are rewritten too, for times may have changed."""
        incoming = materialize(reports.withColumn("day", utc_day(F.col("timestamp"))), "incoming-reports")
        stored_days = self.read("reports").join(incoming.select("report_id"), "report_id", "left_semi").select("day")
        days = materialize(stored_days.union(incoming.select("day")).distinct(), "days")
        merged = merges.upsert_rows(self.of_days("reports", days), incoming.select(*columns(REPORT_DDL), "day"))
        self._rewrite("reports", merged, days)

    def add_stubs(self, *references: DataFrame) -> None:
        """Placeholders for reports that are referenced but unknown."""
        stubs = merges.missing_reports(self.read("reports").select("report_id"), *references)
        known = set(stubs.columns)
        typed = self.spark.createDataFrame([], REPORT_DDL).unionByName(
            stubs.select(*[c for c in columns(REPORT_DDL) if c in known]), allowMissingColumns=True
        )
        placed = materialize(typed.withColumn("day", utc_day(F.col("timestamp"))), "placeholders")
        # Noted first: a note without a placeholder does no harm.
        placed.select("report_id", "day").write.mode("append").parquet(self._stub_days())
        self.append("reports", placed)

    def _stub_days(self) -> str:
        return self.path("_stub_days")

    # --- incidents

    @property
    def incident_days(self) -> DayIndex:
        """Where incidents are stored; made from the table where a store has none yet."""
        index = DayIndex(self.spark, self.path("_incident_days"), "incident_id")
        if not index.exists() and self._exists(self.path("incidents")):
            index.note(self.read("incidents").select("incident_id", "day"))
        return index

    def _stored(self, incidents: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(incident_id, day) of those incidents that are stored, and what the index has noted of them."""
        noted = materialize(self.incident_days.days(incidents), "noted-days")
        stored = self.of_days("incidents", noted).join(noted.select("incident_id").distinct(), "incident_id", "left_semi")
        return stored.select("incident_id", "day"), noted

    def _placed(self, incidents: DataFrame, moving: bool = False) -> DataFrame:
        """incident_id, day and stored_day: an incident is found by its id wherever it is stored.

        The day it will be stored on, its own if it is `moving`, is noted.
        """
        own = materialize(incidents.select("incident_id", utc_day(F.col("first_reported_at")).alias("day")), "own-days")
        stored, noted = self._stored(own)
        placed = materialize(own.join(stored.withColumnRenamed("day", "stored_day"), "incident_id", "left"), "placed")
        day = F.col("day") if moving else F.coalesce("stored_day", "day")
        self.incident_days.note(placed.select("incident_id", day.alias("day")).join(noted, ["incident_id", "day"], "left_anti"))
        return placed

    def merge_incidents(self, batch: IncidentTables, refresh: bool = False) -> DataFrame:
        """Merge that preserves edits (J12); gives back the stored incidents of the batch.

        Of known incidents the last update and the report count move; with `refresh` all computed columns do (R4).
        """
        placed = self._placed(batch.incidents)
        days = materialize(placed.select("incident_id", F.coalesce("stored_day", "day").alias("day")), "batch-days")
        for table, rows, fresh in (
            ("incident_members", batch.members, merges.merge_members),
            ("incident_timeline", batch.timeline, merges.append_timeline),
            ("evidence_items", batch.evidence, _new_evidence),
        ):
            # What is there is read from the files listed now, so the rows need not be settled to be appended.
            self.append(table, fresh(self.of_days(table, days), rows.join(days, "incident_id")))
        members = self.of_days("incident_members", days).join(days.select("incident_id"), "incident_id", "left_semi")
        stored, incoming = self.of_days("incidents", days), batch.incidents.join(days, "incident_id")
        merged = (merges.merge_refreshing if refresh else merges.merge_preserving)(stored, incoming)
        self.overwrite_days("incidents", merges.count_members(merged, members))
        return self.of_days("incidents", days).join(days.select("incident_id"), "incident_id", "left_semi")

    def replace_incidents(self, batch: IncidentTables) -> DataFrame:
        """Upsert that replaces scalars and reconciles children."""
        placed = self._placed(batch.incidents, moving=True)
        touched = placed.select("incident_id", "day")
        days = materialize(touched.select("day").union(placed.filter("stored_day IS NOT NULL").select("stored_day")).distinct(), "touched-days")
        has_summary = materialize(
            batch.incidents.filter(F.col("verification_status").isNotNull()).select("incident_id"), "with-summary"
        )
        moved = touched.withColumnRenamed("day", "_day")
        for table, rows, key, of in (
            ("incident_members", batch.members, ["incident_id", "report_id"], touched),
            ("evidence_items", batch.evidence, EVIDENCE_KEY, has_summary),
            ("incident_timeline", batch.timeline, merges.TIMELINE_KEY, touched),
        ):
            existing = self.of_days(table, days).join(moved, "incident_id", "left")
            existing = existing.withColumn("day", F.coalesce("_day", "day")).drop("_day")
            self._rewrite(table, merges.replace_children(existing, rows.join(touched, "incident_id"), of, key), days)
        merged = merges.upsert_incidents(self.of_days("incidents", days), batch.incidents.join(touched, "incident_id"))
        self._rewrite("incidents", merged, days)
        return self.of_days("incidents", touched).join(touched.select("incident_id"), "incident_id", "left_semi")

    def delete_incidents(self, incidents: DataFrame) -> None:
        """Delete incidents with their children."""
        doomed = materialize(self._stored(incidents)[0], "doomed")
        for table in (*_CHILDREN, "incidents"):
            left = merges.cascade_delete(self.of_days(table, doomed), doomed)
            self._rewrite(table, left, doomed)

    def _rewrite(self, table: str, rows: DataFrame, days: DataFrame) -> None:
        """Rewrite days; the ones left without rows lose their partition folder."""
        settled = materialize(rows.select(*columns(_DDL[table]), "day"), f"rewrite-{table}")
        emptied = days.select("day").distinct().join(settled.select("day").distinct(), "day", "left_anti")
        self.overwrite_days(table, settled)
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        files = path(self.path(table)).getFileSystem(self.spark._jsc.hadoopConfiguration())
        # One row per emptied day: bounded by the calendar, not by the data.
        for row in emptied.collect():
            files.delete(path(f"{self.path(table)}/day={row['day'].isoformat()}"), True)


    # --- results of a batch that are not merged yet

    def _pending(self, batch: str, part: str = "") -> str:
        return f"{self.folder.rstrip('/')}/_pending/batch={batch}{'/' + part if part else ''}"

    def _exists(self, path: str) -> bool:
        probe = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return probe.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(probe)

    def pending(self, batch: str) -> IncidentTables | None:
        """The settled result of a batch, if an earlier attempt came that far."""
        if not self._exists(self._pending(batch, "settled/_SUCCESS")):
            return None
        return IncidentTables(*[self.spark.read.schema(_DDL[t]).parquet(self._pending(batch, t)) for t in ("incidents", *_CHILDREN)])

    def settle(self, batch: str, result: IncidentTables) -> IncidentTables:
        """Write a batch's result before any of it is merged, so that a repeated attempt merges the same; older ones go."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder.rstrip('/')}/_pending")
        files = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        # What this batch found fresh must outlast a failure in here.
        for entry in files.listStatus(root) if files.exists(root) else []:
            if entry.getPath().getName() != f"batch={batch}":
                files.delete(entry.getPath(), True)
        for table, rows in zip(("incidents", *_CHILDREN), result, strict=True):
            rows.select(*columns(_DDL[table])).write.mode("overwrite").parquet(self._pending(batch, table))
        self.spark.range(1).write.mode("overwrite").parquet(self._pending(batch, "settled"))
        return self.pending(batch)


def _new_evidence(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    # The short evidence id may collide; the pair it is made of does not.
    return merges.insert_absent(existing, incoming.dropDuplicates(EVIDENCE_KEY), EVIDENCE_KEY)
