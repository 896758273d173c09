"""What a correlating stream remembers between its batches: the incidents that are still open.

A report can only join an incident that got a report within the window, so a batch needs the open incidents and nothing
of the history. They are kept as a small table of versions, one per batch: a version follows from the one before and the
batch's settled result alone, an incident leaves when its window has passed, and a repeated batch replaces its own
version. The tables of the store are not read for it. Decisions of neighbouring cells depend on each other across any
key that rows could be grouped by, so the exact rule cannot run inside a keyed operator of the stream; it runs on the
whole batch with these incidents as its start.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stormweave.functions.identity import utc_day

OPEN_DDL = (
    "incident_id string, event_category string, cells array<bigint>, first_reported_at timestamp, last_updated_at timestamp, day date"
)


@dataclass(frozen=True)
class OpenIncidents:
    """Versions of the open incidents below one folder; the newest two are kept."""

    spark: SparkSession
    folder: str

    def _files(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[tuple[int, str]]:
        """(number, batch name) of the complete versions, oldest first."""
        where, files = self._files(self.folder)
        if not files.exists(where):
            return []
        names = [s.getPath().getName() for s in files.listStatus(where)]
        complete = [n for n in names if files.exists(self._files(f"{self.folder}/{n}/_SUCCESS")[0])]
        return sorted((int(n.split("-", 1)[0]), n.split("-", 1)[1]) for n in complete)

    def _path(self, number: int, name: str) -> str:
        return f"{self.folder}/{number:012d}-{name}"

    def before(self, name: str) -> DataFrame | None:
        """Incidents open before the batch; None if nothing has been remembered yet."""
        earlier = [v for v in self.versions() if v[1] != name]
        return self.spark.read.schema(OPEN_DDL).parquet(self._path(*earlier[-1])) if earlier else None

    def keep(self, name: str, before: DataFrame | None, result: DataFrame, hours: float) -> None:
        """The version after the batch: incidents of `result` and of before whose last report is at most `hours` old."""
        fresh = result.withColumn("day", utc_day(F.col("first_reported_at"))).select("incident_id", "event_category", "cells", "first_reported_at", "last_updated_at", "day")
        both = fresh if before is None else fresh.unionByName(before.join(fresh.select("incident_id"), "incident_id", "left_anti"))
        newest = both.agg(F.max("last_updated_at")).first()[0]
        reach = F.expr(f"INTERVAL {round(hours * 3600)} SECONDS")
        rows = both.filter(F.col("last_updated_at") >= F.lit(newest).cast("timestamp") - reach) if newest else both.limit(0)
        known = self.versions()
        number = known[-1][0] + (known[-1][1] != name) if known else 0
        rows.write.mode("overwrite").parquet(self._path(number, name))
        for old, label in known:
            if old < number - 1:
                where, files = self._files(self._path(old, label))
                files.delete(where, True)
