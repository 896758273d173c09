"""From reports to scored incidents in one call."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormweave.operators import correlate, dedup, evidence
from stormweave.operators.centroid import running_centroid
from stormweave.schemas import INCIDENT_DDL, columns
from stormweave.session import materialize


class IncidentTables(NamedTuple):
    """The incidents and their child tables; an incident's reports are `members` rows."""

    incidents: DataFrame
    members: DataFrame
    evidence: DataFrame
    timeline: DataFrame


def from_members(members: DataFrame, as_of: Column, centroid: str = "mean") -> IncidentTables:
    """Roll up and score incidents whose reports are known.

    `centroid` is "mean", the exact mean position, which needs no order and no extra pass, or "running" for a position
    rounded after every report in their order.
    """
    rolled = evidence.rolled_and_tallied(members)
    if centroid == "running":
        positions = running_centroid(members).withColumnsRenamed({"latitude": "_lat", "longitude": "_lon"})
        rolled = (
            rolled.join(positions, "incident_id", "left")
            .withColumns({"latitude": F.coalesce("_lat", "latitude"), "longitude": F.coalesce("_lon", "longitude")})
            .drop("_lat", "_lon")
        )
    scored = evidence.score_tallied(rolled, as_of)
    return IncidentTables(
        scored.select(*columns(INCIDENT_DDL)),
        members.select("incident_id", "report_id", "timestamp"),
        evidence.evidence_items(members),
        evidence.timeline(members),
    )


def detect_incidents(
    reports: DataFrame,
    as_of: Column | None = None,
    window_hours: float = 6.0,
    k: int = 1,
    exact: bool = True,
    centroid: str = "mean",
    **options,
) -> IncidentTables:
    """Features, correlation and evidence scoring of a batch of reports (C4).

    `exact=False` takes the set-based sessions instead of the sequential rule. Repeated report ids are reduced
    to their earliest report first.
    """
    moment = F.current_timestamp() if as_of is None else as_of
    order = [F.col("timestamp"), *([F.col("seq")] if "seq" in reports.columns else [])]
    # What is read from the text is read in the scan; the text itself is never shuffled.
    featured = correlate.with_features(reports).drop(*correlate.HEAVY)
    unique = dedup.keep_first(featured, ["report_id"], order)
    if exact:
        members = correlate.correlate_exact(unique, window_hours=window_hours, k=k, **options)
    else:
        members = correlate.correlate_session(unique, window_hours=window_hours, **options)
    # Everything below reads the membership several times.
    return from_members(materialize(members, "members"), moment, centroid)
