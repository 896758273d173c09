"""Incident listing: filters, orders, pages and the numbers of the situation report."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormweave.functions.identity import day_bounds, utc_day
from stormweave.functions.spatial import within_km
from stormweave.operators.merges import number_rows
from stormweave.schemas import INCIDENT_SEVERITIES, VERIFICATION_STATUSES


def _instant(value: dt.datetime | Column) -> Column:
    if isinstance(value, Column):
        return value
    if value.tzinfo is None:
        raise ValueError("time bounds need a time zone")
    return F.lit(value.astimezone(dt.timezone.utc).isoformat()).cast("timestamp")


def reported_between(
    incidents: DataFrame, start: dt.datetime | Column | None = None, end: dt.datetime | Column | None = None
) -> DataFrame:
    """First reported in the range, both ends included (F1)."""
    first = F.col("first_reported_at")
    stored = "day" in incidents.columns  # of a stored table: the UTC day prunes partitions
    if start is not None:
        incidents = incidents.filter(first >= _instant(start))
        incidents = incidents.filter(F.col("day") >= utc_day(_instant(start))) if stored else incidents
    if end is not None:
        incidents = incidents.filter(first <= _instant(end))
        incidents = incidents.filter(F.col("day") <= utc_day(_instant(end))) if stored else incidents
    return incidents


def reported_on(incidents: DataFrame, day: dt.date) -> DataFrame:
    """First reported on a UTC day, as a range so that it is pushed down and prunes day partitions (F2)."""
    start, end = day_bounds(F.lit(day.isoformat()))
    first = F.col("first_reported_at")
    in_day = incidents.filter((first >= start) & (first < end))
    return in_day.filter(F.col("day") == F.lit(day)) if "day" in incidents.columns else in_day


def with_category(incidents: DataFrame, category: str) -> DataFrame:
    return incidents.filter(F.col("event_category") == category.upper().strip())


def with_severity(incidents: DataFrame, severity: str) -> DataFrame:
    if severity not in INCIDENT_SEVERITIES:
        raise ValueError(f"unknown severity {severity!r}")
    return incidents.filter(F.col("severity") == severity)


def with_status(incidents: DataFrame, status: str) -> DataFrame:
    if status not in VERIFICATION_STATUSES:
        raise ValueError(f"unknown verification status {status!r}")
    return incidents.filter(F.col("verification_status") == status)


def in_place(incidents: DataFrame, city: str | None = None, state: str | None = None) -> DataFrame:
    """Case-insensitive substring of city and state; `%` and `_` act as wildcards."""
    if city:
        incidents = incidents.filter(F.col("city").ilike(f"%{city.strip()}%"))
    if state:
        incidents = incidents.filter(F.col("state_name").ilike(f"%{state.strip()}%"))
    return incidents


def near(
    incidents: DataFrame, latitude: float | None, longitude: float | None, radius_km: float = 10.0
) -> DataFrame:
    """Within a radius of a point."""
    if latitude is None and longitude is None:
        return incidents
    if latitude is None or longitude is None:
        raise ValueError("latitude and longitude go together")
    if not (-90.0 <= latitude <= 90.0 and -180.0 <= longitude <= 180.0 and 0.0 < radius_km <= 1000.0):
        raise ValueError("point or radius out of range")
    return incidents.filter(within_km(F.col("latitude"), F.col("longitude"), latitude, longitude, radius_km))


def by_id(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Point lookup; placeholder reports stay hidden."""
    found = rows.filter(F.col(key) == value)
    return found.filter(F.col("source_type") != "stub") if key == "report_id" else found


def active(incidents: DataFrame) -> DataFrame:
    return incidents.filter(F.col("state") != "RESOLVED")


def mappable(incidents: DataFrame) -> DataFrame:
    return incidents.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())


# --- orders and pages ---------------------------------------------------------------------------------------


def newest_first(incidents: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page, newest first, ties by id."""
    if not 1 <= limit <= 500 or offset < 0:
        raise ValueError("limit must be 1 to 500 and offset not negative")
    return incidents.orderBy(F.desc("first_reported_at"), "incident_id").offset(offset).limit(limit)


def newest_after(
    incidents: DataFrame, limit: int = 50, after: tuple[dt.datetime, str] | None = None, days: int | None = None
) -> DataFrame:
    """The page of `newest_first` that follows an incident, given by its time and id.

    Nothing before the page is read again, so page ten thousand costs what the first does. Where the table has a `day`
    partition column, days after that of `after` are not read at all, and with `days` only that many up to it.
    """
    if not 1 <= limit <= 500:
        raise ValueError("limit must be 1 to 500")
    rows = incidents
    if after is not None:
        moment, incident_id = after
        at = F.lit(moment)
        rows = rows.filter((F.col("first_reported_at") < at) | ((F.col("first_reported_at") == at) & (F.col("incident_id") > incident_id)))
        if "day" in incidents.columns:
            # The day of the store is that of UTC.
            last = moment.astimezone(dt.timezone.utc).date() if moment.tzinfo else moment.date()
            rows = rows.filter(F.col("day") <= F.lit(last))
            if days is not None:
                rows = rows.filter(F.col("day") > F.lit(last - dt.timedelta(days=days)))
    return rows.orderBy(F.desc("first_reported_at"), "incident_id").limit(limit)


def top_priority(incidents: DataFrame, n: int = 3) -> DataFrame:
    return incidents.orderBy(F.desc_nulls_last("priority_score"), "incident_id").limit(n)


def severity_rank(severity: Column) -> Column:
    """0 for the most severe; 4 for a value unknown."""
    rank = F.lit(4)
    for position, name in enumerate(reversed(INCIDENT_SEVERITIES)):
        rank = F.when(severity == name, F.lit(position)).otherwise(rank)
    return rank


def _sort_key(order: str) -> Column:
    return {
        "time": -F.unix_micros("last_updated_at"),
        "severity": severity_rank(F.col("severity")),
        "confidence": -F.coalesce("overall_confidence", F.lit(0.0)),
    }[order]


def sorted_by(incidents: DataFrame, order: str = "time") -> DataFrame:
    """By recency, severity or confidence, a missing confidence counting as 0."""
    return incidents.orderBy(_sort_key(order), "incident_id")


def ranked_by(incidents: DataFrame, order: str = "time") -> DataFrame:
    """All incidents with their `position` (from 1) in an order of `sorted_by`, found by ranges and not in one task."""
    keyed = incidents.withColumns({"_order": F.lit(order), "_key": _sort_key(order)})
    return number_rows(keyed, "_order", ["_key", "incident_id"], "position").drop("_order", "_key")


def list_incidents(
    incidents: DataFrame,
    *,
    start: dt.datetime | None = None,
    end: dt.datetime | None = None,
    day: dt.date | None = None,
    category: str | None = None,
    severity: str | None = None,
    status: str | None = None,
    city: str | None = None,
    state: str | None = None,
    latitude: float | None = None,
    longitude: float | None = None,
    radius_km: float = 10.0,
    limit: int = 50,
    offset: int = 0,
) -> DataFrame:
    """All listing filters together, then one page."""
    rows = near(incidents, latitude, longitude, radius_km)
    rows = reported_between(rows, start, end)
    rows = reported_on(rows, day) if day is not None else rows
    rows = with_category(rows, category) if category else rows
    rows = with_severity(rows, severity) if severity is not None else rows
    rows = with_status(rows, status) if status is not None else rows
    return newest_first(in_place(rows, city, state), limit, offset)


# --- situation numbers --------------------------------------------------------------------------------------


def dashboard_counts(incidents: DataFrame) -> DataFrame:
    return incidents.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("state") != "RESOLVED").alias("active"),
        F.count_if(F.col("severity") == "HIGH").alias("high"),
        F.count_if(F.col("severity") == "CRITICAL").alias("critical"),
    )


def situation_summary(incidents: DataFrame) -> DataFrame:
    return incidents.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("severity") == "CRITICAL").alias("critical"),
        F.count_if(F.col("severity") == "HIGH").alias("high"),
        F.count_if(F.col("verification_status") == "SUPPORTED").alias("verified"),
    )


def consistency_audit(incidents: DataFrame) -> DataFrame:
    """Share of supporting evidence in percent, 0 when there is none, and incidents to look at."""
    none = F.lit(0).cast("bigint")
    totals = incidents.agg(
        F.coalesce(F.sum(F.col("supporting_count") + F.col("contradicting_count")), none).alias("total_evidence"),
        F.coalesce(F.sum("supporting_count"), none).alias("supporting_evidence"),
        F.count_if(F.col("verification_status").isin("UNVERIFIED", "CONTRADICTED")).alias("flagged"),
    )
    share = F.try_divide(F.col("supporting_evidence") * 100.0, F.col("total_evidence"))
    return totals.withColumn("consistency_percent", F.coalesce(F.round(share, 1), F.lit(0.0)))
