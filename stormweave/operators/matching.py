"""Reports against incidents that already exist: spatial equi-joins with interval and category residuals.

All three joins put a time bucket next to the place in the join key. A hot place is thereby cut into windows of
time, and a report meets only incidents whose last update lies in its own or an adjacent window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormweave import rules
from stormweave.functions.spatial import k_ring
from stormweave.operators.evidence import accepted_categories

_BOX = 0.2


def _bucket(ts: str, span: int) -> Column:
    return F.floor(F.unix_micros(ts) / F.lit(span))


def _placed(incidents: DataFrame, places: dict[str, Column], span: int) -> DataFrame:
    """Incidents copied to their places and to the time buckets around their last update; copies leave the cells behind."""
    base = incidents.select(
        "incident_id", "event_category", "first_reported_at", "last_updated_at", "latitude", "longitude", "cells"
    ).withColumnsRenamed(
        {"event_category": "_category", "last_updated_at": "_last", "first_reported_at": "_first",
         "latitude": "_latitude", "longitude": "_longitude", "cells": "_cells"}
    )
    at = _bucket("_last", span)
    placed = base.withColumn("_bucket", F.explode(F.sequence(at - 1, at + 1)))
    for name, place in places.items():
        placed = placed.withColumn(name, F.explode(place))
    return placed.drop("_cells")


def _first_match(reports: DataFrame, placed: DataFrame, keys: list[str], span: int, residual: Column) -> DataFrame:
    """(report_id, incident_id) of the earliest-created matching incident of each report.

    Reports keep their side narrow; ties in creation time go to the smaller id. The minimum combines on the map
    side, so candidates of one report need not meet in one place first.

    The copies of `placed` are made by generators, which Catalyst takes to be as small as the file they read; a merge join
    is asked for, so that no side passes through the driver.
    """
    accepted = F.array_contains(accepted_categories(F.col("_category"), rules.COMPATIBLE), F.col("event_category"))
    gap = F.abs(F.unix_micros("timestamp") - F.unix_micros("_last")) <= span
    narrow = reports.withColumn("_bucket", _bucket("timestamp", span)).select(
        "report_id", "timestamp", "event_category", "latitude", "longitude", "_bucket", *[k for k in keys]
    )
    matches = narrow.join(placed.hint("merge"), [*keys, "_bucket"]).filter(accepted & gap & residual)
    return (
        matches.groupBy("report_id")
        .agg(F.min(F.struct("_first", "incident_id")).alias("first"))
        .select("report_id", F.col("first.incident_id").alias("incident_id"))
    )


def match_seed_cell(reports: DataFrame, incidents: DataFrame, window_hours: float = 6.0, k: int = 1) -> DataFrame:
    """By the incident's seed cell, the first of its cells."""
    span = round(window_hours * 3_600_000_000)
    placed = _placed(incidents, {"cell": k_ring(F.get("_cells", 0), k)}, span)
    return _first_match(reports, placed, ["cell"], span, F.lit(True))


def match_any_cell(reports: DataFrame, incidents: DataFrame, window_hours: float = 6.0, k: int = 1) -> DataFrame:
    """By any cell the incident covers."""
    span = round(window_hours * 3_600_000_000)
    around = F.array_distinct(F.flatten(F.transform("_cells", lambda c: k_ring(c, k))))
    return _first_match(reports, _placed(incidents, {"cell": around}, span), ["cell"], span, F.lit(True))


def match_box(
    reports: DataFrame, incidents: DataFrame, window_hours: float = 6.0, degrees: float = _BOX
) -> DataFrame:
    """By latitude and longitude differences of at most `degrees` (J3): tiles of that size, 3 x 3 per incident."""
    span = round(window_hours * 3_600_000_000)

    def tile(c: str) -> Column:
        return F.floor(F.col(c) / F.lit(degrees))

    places = {
        "_x": F.sequence(tile("_longitude") - 1, tile("_longitude") + 1),
        "_y": F.sequence(tile("_latitude") - 1, tile("_latitude") + 1),
    }
    located = incidents.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    near = (F.abs(F.col("latitude") - F.col("_latitude")) <= degrees) & (
        F.abs(F.col("longitude") - F.col("_longitude")) <= degrees
    )
    tiled = reports.withColumns({"_x": tile("longitude"), "_y": tile("latitude")})
    return _first_match(tiled, _placed(located, places, span), ["_x", "_y"], span, near)
