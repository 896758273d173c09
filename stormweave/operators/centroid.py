"""Incident positions rounded after every report, as the reference does it.

The position after report `n` is the rounded mean of the previous position and the report, so the result depends
on the order of reports. For an incident of any size it is still found in parallel: its reports are cut into
parts by arrival number; the first part is a plain fold, every later part is folded for all positions it might
start from. Positions are multiples of 0.0001 degrees inside the incident's extent, a few hundred per axis, so a
part is a small table. Neighbouring tables are composed into one, some FAN at a time, until an incident has one left, so
no row holds more than FAN tables however many reports there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormweave.operators.merges import number_rows
from stormweave.session import materialize

_STEP = 10_000
#: Tables composed into one in a round.
FAN = 16


def _rounded(values: np.ndarray) -> np.ndarray:
    """Round to four decimals as Python does, which looks at the exact value where it is close to a tie."""
    scaled = values * _STEP
    out = np.rint(scaled) / _STEP
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-4):
        out[i] = round(float(values[i]), 4)
    return out


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Stream parts in arrival order; the state is one table of positions per axis."""
    key: tuple | None = None
    tables: list[np.ndarray] = []
    starts: list[int] = []

    def finished() -> pd.DataFrame:
        return pd.DataFrame(
            {"incident_id": [key[0]], "part": [key[1]], "lat_start": [starts[0]], "lat_table": [tables[0]],
             "lon_start": [starts[1]], "lon_table": [tables[1]]}
        )

    for batch in batches:
        done = []
        columns = ("incident_id", "part", "n", "latitude", "longitude", "lat_low", "lat_high", "lon_low", "lon_high")
        for incident, part, n, lat, lon, *extent in zip(*(batch[c].tolist() for c in columns), strict=True):
            if (incident, part) != key:
                if key is not None:
                    done.append(finished())
                key = (incident, part)
                if n == 1:
                    starts, tables = [0, 0], [np.array([lat]), np.array([lon])]
                    continue
                bounds = [int(np.floor(b * _STEP)) - 1 if i % 2 == 0 else int(np.ceil(b * _STEP)) + 1 for i, b in enumerate(extent)]
                starts = [bounds[0], bounds[2]]
                tables = [np.arange(bounds[0], bounds[1] + 1) / _STEP, np.arange(bounds[2], bounds[3] + 1) / _STEP]
            tables = [_rounded((table * (n - 1) + x) / n) for table, x in zip(tables, (lat, lon), strict=True)]
        if done:
            yield pd.concat(done, ignore_index=True)
    if key is not None:
        yield finished()


def running_centroid(members: DataFrame, part_size: int = 10_000) -> DataFrame:
    """(incident_id, latitude, longitude) of incidents whose reports have coordinates."""
    located = members.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).select(
        "incident_id", "timestamp", "seq", F.col("latitude").cast("double"), F.col("longitude").cast("double")
    )
    return _by_parts(located, part_size)


def _by_parts(located: DataFrame, part_size: int) -> DataFrame:
    numbered = number_rows(located, "incident_id", ["timestamp", "seq"]).withColumn(
        "part", F.floor((F.col("n") - 1) / F.lit(part_size))
    )
    extent = numbered.groupBy("incident_id").agg(
        F.min("latitude").alias("lat_low"), F.max("latitude").alias("lat_high"),
        F.min("longitude").alias("lon_low"), F.max("longitude").alias("lon_high"),
    )
    schema = (
        "incident_id string, part long, lat_start long, lat_table array<double>, lon_start long, lon_table array<double>"
    )
    parts = (
        numbered.join(extent, "incident_id")
        .repartition("incident_id", "part")
        .sortWithinPartitions("incident_id", "part", "n")
        .mapInPandas(_fold, schema)
    )

    parts = materialize(parts, "centroid-parts")
    last = parts.agg(F.coalesce(F.max("part"), F.lit(0))).first()[0]
    while last > 0:
        parts = materialize(_composed(parts), "centroid-parts")
        last //= FAN
    return parts.select(
        "incident_id", F.element_at("lat_table", 1).alias("latitude"), F.element_at("lon_table", 1).alias("longitude")
    )


def _composed(parts: DataFrame) -> DataFrame:
    """FAN neighbouring parts of an incident as one: where each start of the first ends after the last."""
    axes = [f"{axis}_{what}" for axis in ("lat", "lon") for what in ("start", "table")]
    in_order = F.sort_array(F.collect_list(F.struct("part", *axes)))
    grouped = parts.groupBy("incident_id", F.floor(F.col("part") / FAN).alias("part")).agg(in_order.alias("run"))

    def through(axis: str) -> Column:
        def step(table: Column, part: Column) -> Column:
            def end(position: Column) -> Column:
                index = F.round(position * _STEP).cast("int") - part[f"{axis}_start"].cast("int") + 1
                return F.element_at(part[f"{axis}_table"], F.greatest(index, F.lit(1)))

            return F.transform(table, end)

        return F.aggregate(F.slice("run", 2, FAN), F.get("run", 0)[f"{axis}_table"], step)

    first = F.get("run", 0)
    return grouped.select(
        "incident_id", "part", *[c.alias(n) for n, c in (
            ("lat_start", first["lat_start"]), ("lat_table", through("lat")),
            ("lon_start", first["lon_start"]), ("lon_table", through("lon")),
        )],
    )
