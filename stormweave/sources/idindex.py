"""An index from ids to the days they are stored on, so that a merge reads neither all ids nor all days.

A note (id, day) says that a row with this id may be stored on this day. Notes are written before the rows they speak of
and are never taken back: the table itself decides, a note only tells which of its days to read. So a merge that breaks
off and is repeated finds its notes, and a note without a row does no harm.

Notes lie in `BUCKETS` folders by a hash of the id; looking ids up reads the folders of these ids only. Each merge adds
files to the folders it touches; `compact` writes them anew as one file a folder, into a generation of its own that
counts once it is complete.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of an index; part of its path, so an index with another number is made anew.
BUCKETS = 256


def bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


@dataclass(frozen=True)
class DayIndex:
    """Notes of one table below `folder`; `key` is the column of its ids."""

    spark: SparkSession
    folder: str
    key: str

    @property
    def _root(self) -> str:
        return f"{self.folder.rstrip('/')}/buckets={BUCKETS}"

    def _files(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _generations(self) -> list[int]:
        """Complete generations in order."""
        root, files = self._files(self._root)
        names = [e.getPath().getName() for e in files.listStatus(root)] if files.exists(root) else []
        numbers = sorted(int(n.removeprefix("generation=")) for n in names if n.startswith("generation="))
        return [n for n in numbers if files.exists(self._files(f"{self._path(n)}/_SUCCESS")[0])]

    def _path(self, generation: int) -> str:
        return f"{self._root}/generation={generation}"

    def exists(self) -> bool:
        return bool(self._generations())

    def _notes(self) -> DataFrame:
        schema = f"`{self.key}` string, day date, bucket int"
        complete = self._generations()
        if not complete:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self._path(complete[-1]))

    def days(self, ids: DataFrame) -> DataFrame:
        """(id, day): the days on which rows of these ids may be stored."""
        # At most one number for each folder of the index, whatever the number of ids.
        of = [r[0] for r in ids.select(bucket(F.col(self.key))).distinct().collect()]
        notes = self._notes().filter(F.col("bucket").isin(of))
        return notes.join(ids.select(self.key), self.key, "left_semi").select(self.key, "day").distinct()

    def note(self, rows: DataFrame) -> None:
        """Add notes (id, day)."""
        complete = self._generations()
        self._write(rows, self._path(complete[-1] if complete else 1), "append" if complete else "overwrite")

    def compact(self) -> None:
        """One file for each folder; earlier generations go once the new one is complete."""
        complete = self._generations()
        if not complete:
            return
        self._write(self._notes(), self._path(complete[-1] + 1), "overwrite")
        for n in complete:
            place, files = self._files(self._path(n))
            files.delete(place, True)

    def _write(self, rows: DataFrame, path: str, mode: str) -> None:
        placed = rows.select(self.key, "day", bucket(F.col(self.key)).alias("bucket")).distinct()
        placed.repartition("bucket").sortWithinPartitions("bucket", self.key).write.mode(mode).partitionBy("bucket").parquet(path)
