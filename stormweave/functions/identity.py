"""Time parsing and deterministic identifiers."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from stormweave.functions.binding import bind

_ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?([zZ]|[+-]\d{2}:?\d{2})?)?$"
_OFFSET = r"[T ]\d{2}:\d{2}.*([zZ]|[+-]\d{2}:?\d{2})$"
_DATE_ONLY = r"^\d{4}-\d{2}-\d{2}$"

# Zone names of mail dates and month names.
_ZONES = {
    "UT": "+00:00", "UTC": "+00:00", "GMT": "+00:00", "Z": "+00:00",
    "AST": "-04:00", "ADT": "-03:00", "EST": "-05:00", "EDT": "-04:00", "CST": "-06:00", "CDT": "-05:00",
    "MST": "-07:00", "MDT": "-06:00", "PST": "-08:00", "PDT": "-07:00",
}
_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_MAIL = (
    r"(?i)^(?:[a-z]+\s*,?\s+|[a-z]+,)?(\d{1,2})[ -]([a-z]{3})[a-z]*[ -](\d{4}|\d{2})\s+"
    r"(\d{1,2}):(\d{2})(?::(\d{2}))?(?:\s+([+-]\d{4}|[a-z]+))?(?:\s*\(.*\))?$"
)


def has_offset(text: Column) -> Column:
    return F.trim(text).rlike(_OFFSET)


def utc_timestamp(text: Column, assume_utc_if_naive: bool = False) -> Column:
    """ISO text to a timestamp; null when malformed, or when it has no offset and none is assumed.

    The offset is spelled out before the cast, so the result does not depend on the session time zone.
    """
    def parsed(raw: Column) -> Column:
        dated = F.when(raw.rlike(_DATE_ONLY), F.concat(raw, F.lit("T00:00"))).otherwise(raw)
        # Spark wants seconds and a colon in the offset.
        clock = F.regexp_replace(dated, r"^(.{10})[T ](\d{2}:\d{2})(?!:)", "$1T$2:00")
        offset = F.regexp_replace(clock, r"([+-]\d{2})(\d{2})$", "$1:$2")
        full = F.when(has_offset(raw), offset)
        if assume_utc_if_naive:
            full = full.otherwise(F.concat(clock, F.lit("Z")))
        return F.when(raw.rlike(_ISO), full.try_cast("timestamp"))

    return bind(F.trim(text), parsed)


def rss_timestamp(text: Column) -> Column:
    """RFC 822 / 1123 dates, else ISO; a missing or unknown zone is UTC."""
    zones = F.from_json(F.lit(json.dumps(_ZONES)), "map<string,string>")

    def offset(zone: Column) -> Column:
        numeric = F.when(zone.rlike(r"^[+-]\d{4}$"), F.regexp_replace(zone, r"(\d{2})(\d{2})$", "$1:$2"))
        return F.coalesce(numeric, F.element_at(zones, zone), F.lit("+00:00"))

    def year(text: Column) -> Column:
        short = F.when(text < "69", F.concat(F.lit("20"), text)).otherwise(F.concat(F.lit("19"), text))
        return F.when(F.length(text) == 2, short).otherwise(text)

    def mail(raw: Column) -> Column:
        def part(i: int) -> Column:
            return F.regexp_extract(raw, _MAIL, i)

        month = F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), F.lower(part(2)))
        seconds = F.coalesce(F.nullif(part(6), F.lit("")), F.lit("00"))
        iso = F.concat(
            bind(part(3), year), F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-"), F.lpad(part(1), 2, "0"),
            F.lit("T"), F.lpad(part(4), 2, "0"), F.lit(":"), part(5), F.lit(":"), seconds, bind(F.upper(part(7)), offset),
        )
        return F.when(raw.rlike(_MAIL), iso.try_cast("timestamp"))

    return bind(F.trim(text), lambda raw: F.coalesce(mail(raw), utc_timestamp(raw, assume_utc_if_naive=True)))


def observation_timestamp(date: Column, time: Column) -> Column:
    """Observation time from separate date and time texts, midnight when the time is missing."""
    clock = F.coalesce(F.nullif(F.trim(time), F.lit("")), F.lit("00:00:00"))
    joined = F.when(date.contains("T"), date).otherwise(F.concat_ws("T", date, clock))
    return F.when(date.isNotNull(), utc_timestamp(joined, assume_utc_if_naive=True))


def iso_utc(ts: Column) -> Column:
    """`2024-01-01T00:00:00+00:00`, with microseconds only when there are any."""
    def written(utc: Column) -> Column:
        text = F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        return F.concat(F.regexp_replace(text, r"\.000000$", ""), F.lit("+00:00"))

    return bind(F.to_utc_timestamp(ts, F.current_timezone()), written)


def _digest(text: Column, chars: int) -> Column:
    return F.substring(F.sha2(text, 256), 1, chars)


def report_id(source: Column, source_id: Column, ts: Column) -> Column:
    return F.concat(F.lit("rep_"), source, F.lit("_"), _digest(F.concat_ws(":", source, source_id, iso_utc(ts)), 16))


def incident_id(category: Column, place: Column, ts: Column, chars: int = 12) -> Column:
    """Id from category, seed cell and first time. Raise `chars` beyond some millions of incidents."""
    return F.concat(
        F.lit("inc_"), F.lower(category), F.lit("_"), _digest(F.concat_ws("_", category, place, iso_utc(ts)), chars)
    )


def evidence_id(report: Column, incident: Column, chars: int = 10) -> Column:
    return F.concat(F.lit("ev_"), _digest(F.concat_ws("_", report, incident), chars))


def age_hours(ts: Column, as_of: Column) -> Column:
    return (F.unix_micros(as_of) - F.unix_micros(ts)) / F.lit(3_600_000_000.0)


def day_bounds(day: Column) -> tuple[Column, Column]:
    """First instant of a UTC day and of the next one."""
    start = F.concat(day.cast("string"), F.lit("T00:00:00Z")).try_cast("timestamp")
    return start, start + F.expr("INTERVAL 24 HOURS")


def utc_day(ts: Column) -> Column:
    return F.to_date(F.to_utc_timestamp(ts, F.current_timezone()))
