"""Incident roll-up and evidence scoring over (report, incident) membership.

Everything is grouped by incident in two steps, first by (incident, source, ...) with primitive buffers that
combine on the map side, then over those few rows. A hot incident therefore never gathers its reports anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stormweave import rules
from stormweave.functions import identity, text
from stormweave.functions.binding import staged

_EXACT = "decimal(24,12)"
HIGH_FROM_START = ("FLOOD", "CYCLONE")
FAST_RISING = ("WATERLOGGING", "THUNDERSTORM", "LIGHTNING")


def _lookup(table: dict[str, float], key: Column, default: float) -> Column:
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), F.lit(default))


# --- weights and compatibility ------------------------------------------------------------------------------


def source_weight(source: Column, source_type: Column, weights: dict[str, float] = rules.SOURCE_WEIGHTS) -> Column:
    """Reliability of a source as an expression over a fixed vocabulary."""
    weight = _lookup(weights, F.lower(source), rules.DEFAULT_WEIGHT)
    return F.when(source_type == "official", F.greatest(weight, F.lit(rules.OFFICIAL_FLOOR))).otherwise(weight)


def with_source_weights(reports: DataFrame, weights: DataFrame) -> DataFrame:
    """Reliability from a caller's table (source, weight); Catalyst broadcasts it when it is small enough."""
    looked_up = reports.join(
        weights.select(F.lower("source").alias("_source"), F.col("weight").alias("_weight")),
        F.lower("source") == F.col("_source"),
        "left",
    )
    weight = F.coalesce("_weight", F.lit(rules.DEFAULT_WEIGHT))
    official = F.when(F.col("source_type") == "official", F.greatest(weight, F.lit(rules.OFFICIAL_FLOOR)))
    return looked_up.withColumn("source_weight", official.otherwise(weight)).drop("_source", "_weight")


def accepted_categories(
    category: Column, compatible: dict[str, tuple[str, ...]] = rules.COMPATIBLE
) -> Column:
    """Categories an incident accepts; only its own when the map does not know it."""
    parts: list[Column] = []
    for name, accepted in compatible.items():
        parts += [F.lit(name), F.array(*[F.lit(a) for a in accepted])]
    return F.coalesce(F.element_at(F.create_map(*parts), category), F.array(category))


def with_accepted_categories(incidents: DataFrame, compatibility: DataFrame) -> DataFrame:
    """The same from a caller's table (event_category, accepts)."""
    joined = incidents.join(compatibility, "event_category", "left")
    return joined.withColumn("accepts", F.coalesce("accepts", F.array("event_category")))


# --- roll-up ------------------------------------------------------------------------------------------------


def severity(reports: Column, category: Column) -> Column:
    """Severity for a number of reports, in closed form."""
    high_first = F.when(reports >= 3, "CRITICAL").otherwise("HIGH")
    fast = F.when(reports >= 4, "CRITICAL").when(reports >= 2, "HIGH").otherwise("MODERATE")
    plain = F.when(reports >= 5, "CRITICAL").when(reports >= 3, "HIGH").otherwise("MODERATE")
    return F.when(category.isin(*HIGH_FROM_START), high_first).when(category.isin(*FAST_RISING), fast).otherwise(plain)


def density_priority(reports: Column, category: Column) -> Column:
    """Priority from report density alone; 50 for a single report."""
    base = F.when(category.isin("CYCLONE", "FLOOD"), 65.0).when(category.isin(*FAST_RISING), 55.0).otherwise(40.0)
    grown = F.least(F.round(base + F.least(reports * 7.5, F.lit(30.0)), 1), F.lit(99.0))
    return F.when(reports > 1, grown).otherwise(F.lit(50.0))


def title(category: Column, city: Column, state: Column, latitude: Column, longitude: Column) -> Column:
    """`Heavy Rain Alert in Place`: city, else state, else coordinates, else unknown."""
    point = F.when(
        latitude.isNotNull() & longitude.isNotNull(), F.format_string("(%.2f, %.2f)", latitude, longitude)
    )
    place = F.coalesce(text.first_filled(city, state), point, F.lit("Unknown Location"))
    return F.concat(F.initcap(F.replace(category, F.lit("_"), F.lit(" "))), F.lit(" Alert in "), place)


def _optional(members: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in members.columns else F.lit(None).cast(kind).alias(name)


def roll_up(members: DataFrame) -> DataFrame:
    """One row per incident from its member reports.

    Place and title come from the opening report. The position is the mean of the members' coordinates to four
    decimals, summed exactly so that it does not depend on partitioning; `centroid.running_centroid` gives the
    reference's position, which is rounded after every report.
    """
    # Members are summed by cell first, in tasks before the shuffle; an incident has a few cells, however many reports.
    per_cell = members.groupBy("incident_id", "cell").agg(*_place_sums())
    return _opened(members, per_cell.groupBy("incident_id").agg(*_place_totals()))


def _place_sums() -> list[Column]:
    """Times, number and coordinates of the members of one cell."""
    return [
        F.min("timestamp").alias("seen"),
        F.max("timestamp").alias("last"),
        F.count("*").alias("reports"),
        *[agg for axis in ("latitude", "longitude") for agg in (
            F.sum(F.col(axis).cast(_EXACT)).alias(f"{axis}_sum"), F.count(axis).alias(f"{axis}_count")
        )],
    ]


def _place_totals() -> list[Column]:
    """The same over the rows of one incident; a cell counts from its first row on."""

    def mean(axis: str) -> Column:
        counted = F.sum(f"{axis}_count")
        return F.try_divide(F.sum(f"{axis}_sum"), counted.cast("decimal(18,0)")).cast("double").alias(f"mean_{axis}")

    arrivals = F.sort_array(F.collect_list(F.when(F.col("cell").isNotNull(), F.struct("seen", "cell"))))
    return [
        F.min("seen").alias("first_reported_at"),
        F.max("last").alias("last_updated_at"),
        F.sum("reports").alias("report_count"),
        mean("latitude"),
        mean("longitude"),
        F.array_distinct(F.transform(arrivals, lambda c: c["cell"])).alias("cells"),
    ]


def _opened(members: DataFrame, stats: DataFrame, *further: str) -> DataFrame:
    """Place and title of the opening report put to the sums of its incident, of which `further` columns are kept too."""
    openers = members.filter("opens").select(
        "incident_id",
        F.col("incident_category").alias("event_category"),
        F.col("latitude").alias("seed_latitude"),
        F.col("longitude").alias("seed_longitude"),
        _optional(members, "city"),
        _optional(members, "district"),
        _optional(members, "state").alias("state_name"),
        F.coalesce(text.first_filled(_optional(members, "country")), F.lit("India")).alias("country"),
    )
    count, category = F.col("report_count"), F.col("event_category")

    def position(axis: str) -> Column:
        return F.when(count == 1, F.col(f"seed_{axis}")).otherwise(F.round(f"mean_{axis}", 4)).alias(axis)

    return (
        openers.join(stats, "incident_id")
        .select(
            "incident_id",
            title(
                category, F.col("city"), F.col("state_name"), F.col("seed_latitude"), F.col("seed_longitude")
            ).alias("title"),
            "event_category",
            F.lit("REPORTED").alias("state"),
            severity(count, category).alias("severity"),
            density_priority(count, category).alias("priority_score"),
            density_priority(count, category).alias("density_priority"),
            position("latitude"),
            position("longitude"),
            "cells",
            "city",
            "district",
            "state_name",
            "country",
            "first_reported_at",
            "last_updated_at",
            "report_count",
            *further,
        )
    )


def covered_cells(members: DataFrame) -> DataFrame:
    """Distinct cells of an incident in order of arrival; at most a k-ring of them per incident."""
    first = (
        members.filter(F.col("cell").isNotNull())
        .groupBy("incident_id", "cell")
        .agg(F.min("timestamp").alias("seen"))
    )
    ordered = F.sort_array(F.collect_list(F.struct("seen", "cell")))
    return first.groupBy("incident_id").agg(F.transform(ordered, lambda c: c["cell"]).alias("cells"))


def timeline(members: DataFrame) -> DataFrame:
    """One entry per member report, with the severity the incident had on its arrival.

    Severity no longer changes after the fifth report, so only the first five of an incident are ranked, and
    that ranking is cut before the shuffle.
    """
    in_order = Window.partitionBy("incident_id").orderBy("timestamp", "seq")
    early = (
        members.select("incident_id", "report_id", "timestamp", "seq")
        .withColumn("n", F.row_number().over(in_order))
        .filter("n <= 5")
        .select("report_id", "n")
    )
    n = F.coalesce("n", F.lit(5))
    return members.join(early, "report_id", "left").select(
        "incident_id",
        "timestamp",
        F.when(F.col("opens"), "incident_created").otherwise("report_correlated").alias("event_type"),
        F.when(
            F.col("opens"), F.concat(F.lit("Incident created from initial "), "source", F.lit(" report."))
        ).otherwise(F.concat(F.lit("Correlated supporting report from "), "source", F.lit("."))).alias("description"),
        F.lit(None).cast("string").alias("previous_state"),
        F.when(F.col("opens"), F.lit("REPORTED")).alias("new_state"),
        F.lit(None).cast("string").alias("previous_severity"),
        severity(n, F.col("incident_category")).alias("new_severity"),
        "report_id",
    )


# --- evidence -----------------------------------------------------------------------------------------------


def join_reports(incidents: DataFrame, reports: DataFrame) -> DataFrame:
    """Incidents with a `report_ids` array to their known reports; ids without a report fall away."""
    ids = incidents.select(
        "incident_id", F.col("event_category").alias("incident_category"), F.explode("report_ids").alias("report_id")
    )
    return ids.join(reports, "report_id")


def _relationship() -> Column:
    return F.when(F.col("is_negated"), "CONTRADICTING").otherwise("SUPPORTING")


def evidence_items(members: DataFrame) -> DataFrame:
    """One evidence row per member report."""
    weight = source_weight(F.col("source"), F.col("source_type"))
    return members.select(
        identity.evidence_id(F.col("report_id"), F.col("incident_id")).alias("evidence_id"),
        "incident_id",
        "report_id",
        "source",
        "source_type",
        _relationship().alias("relationship"),
        weight.alias("confidence_score"),
        weight.alias("source_reliability_weight"),
        text.evidence_reasoning(F.col("source"), F.col("is_negated")).alias("reasoning"),
        F.col("incident_category").alias("extracted_event"),
        text.first_filled(_optional(members, "city"), _optional(members, "state")).alias("extracted_location"),
        F.coalesce(_optional(members, "media_urls", "array<string>"), F.array().cast("array<string>")).alias(
            "media_proof_urls"
        ),
        "timestamp",
    )


def tally(evidence: DataFrame) -> DataFrame:
    """Counts, weight sums and distinct sources per incident and side (A1, A3).

    Relationships other than SUPPORTING and CONTRADICTING count for neither side but add to the weight.
    """
    per_source = evidence.groupBy("incident_id", "source", "relationship").agg(
        F.count("*").alias("items"), *_side_sums(F.col("source_reliability_weight"))
    )
    return per_source.groupBy("incident_id").agg(*_side_totals("items"))


def _side_sums(weight: Column) -> list[Column]:
    """Weight and standing of the evidence of one source and side."""
    return [
        F.sum(weight.cast(_EXACT)).alias("weight"),
        F.bool_or((F.col("source_type") == "official") | (F.lower("source") == "imd")).alias("official"),
    ]


def _side_totals(items: str) -> list[Column]:
    """The same over the rows of one incident; `items` names their number of evidence items."""
    supports, contradicts = F.col("relationship") == "SUPPORTING", F.col("relationship") == "CONTRADICTING"
    nothing = F.lit(0).cast("bigint")

    def sources(side: Column) -> Column:
        return F.sort_array(F.collect_set(F.when(side, F.col("source"))))

    return [
        F.coalesce(F.sum(F.when(supports, F.col(items))), nothing).alias("supporting_count"),
        F.coalesce(F.sum(F.when(contradicts, F.col(items))), nothing).alias("contradicting_count"),
        F.sum(items).alias("evidence_count"),
        F.coalesce(F.sum(F.when(supports, F.col("weight"))), F.lit(0)).cast("double").alias("supporting_weight"),
        F.sum("weight").cast("double").alias("total_weight"),
        sources(supports).alias("supporting_sources"),
        sources(contradicts).alias("contradicting_sources"),
        F.coalesce(F.bool_or(F.when(supports, F.col("official"))), F.lit(False)).alias("has_official"),
    ]


_TALLIED = (
    "supporting_count", "contradicting_count", "evidence_count", "supporting_weight", "total_weight",
    "supporting_sources", "contradicting_sources", "has_official",
)


def rolled_and_tallied(members: DataFrame) -> DataFrame:
    """`roll_up` of the members with the `tally` of their evidence items, from one pass over them.

    Members are summed by cell, source and side at once, so they are shuffled once for both and what is left is grouped
    by incident once.
    """
    keys = ["incident_id", "cell", "source", _relationship().alias("relationship")]
    groups = members.groupBy(*keys).agg(*_place_sums(), *_side_sums(source_weight(F.col("source"), F.col("source_type"))))
    return _opened(members, groups.groupBy("incident_id").agg(*_place_totals(), *_side_totals("reports")), *_TALLIED)


def confidence(
    supporting_weight: Column, total_weight: Column, supporting_count: Column, distinct_sources: Column
) -> Column:
    """Mean supporting weight times supporting share, plus a bonus for further sources (A2)."""
    mean = F.when(supporting_count > 0, supporting_weight / supporting_count).otherwise(F.lit(0.0))
    bonus = F.when(distinct_sources > 1, (distinct_sources - 1) * 0.08).otherwise(F.lit(0.0))
    raw = mean * (supporting_weight / total_weight) + bonus
    clamped = F.least(F.greatest(raw, F.lit(0.15)), F.lit(0.98))
    return F.when(total_weight > 0, F.round(clamped, 2)).otherwise(F.lit(0.30))


def _stance(official: Column, conf: Column, supporting: Column, contradicting: Column) -> tuple[Column, ...]:
    refuted = (contradicting > supporting) & (contradicting > 1)
    backed = official | ((conf >= 0.65) & (supporting >= 2))
    return refuted, backed, supporting >= 1


def verification_status(official: Column, conf: Column, supporting: Column, contradicting: Column) -> Column:
    refuted, backed, single = _stance(official, conf, supporting, contradicting)
    return (
        F.when(refuted, "CONTRADICTED").when(backed, "SUPPORTED").when(single, "PENDING_REVIEW").otherwise("UNVERIFIED")
    )


def incident_state(official: Column, conf: Column, supporting: Column, contradicting: Column) -> Column:
    refuted, backed, _ = _stance(official, conf, supporting, contradicting)
    return F.when(refuted, "DE_ESCALATING").when(backed, "VERIFIED").otherwise("REPORTED")


def explanation(
    official: Column, conf: Column, supporting: Column, contradicting: Column, sources: Column
) -> Column:
    refuted, backed, single = _stance(official, conf, supporting, contradicting)
    n, m = supporting.cast("string"), contradicting.cast("string")
    against = F.concat(
        F.lit("Incident contradicts ground reality. "), m, F.lit(" contradicting report(s) outweigh "), n,
        F.lit(" supporting report(s)."),
    )
    feed = F.when(official, "official meteorological feed").otherwise("multi-source reports")
    percent = F.floor(conf * 100).cast("string")
    for_it = F.concat(
        F.lit("Verified by "), feed, F.lit(" across "), n, F.lit(" report(s) ("), F.array_join(sources, ", "),
        F.lit(") with "), percent, F.lit("% confidence."),
    )
    waiting = F.concat(
        F.lit("Single report from "),
        F.coalesce(F.get(sources, 0), F.lit("unknown")),
        F.lit(". Awaiting further multi-source verification."),
    )
    return (
        F.when(refuted, against)
        .when(backed, for_it)
        .when(single, waiting)
        .otherwise("Unverified incident. Awaiting reports.")
    )


def priority(
    severity_level: Column,
    category: Column,
    conf: Column,
    reports: Column,
    distinct_sources: Column,
    last_updated_at: Column,
    as_of: Column,
) -> Column:
    """Product of severity, event weight, confidence, volume, diversity and recency (A5)."""
    base = _lookup(rules.SEVERITY_BASE, severity_level, 45.0)
    weight = _lookup(rules.EVENT_WEIGHTS, F.upper(category), 1.0)
    idle = F.greatest(F.lit(0.0), identity.age_hours(last_updated_at, as_of) - 6.0)
    recency = F.greatest(F.lit(0.70), F.lit(1.0) - idle * 0.01)
    volume = F.lit(1.0) + F.log(F.greatest(reports, F.lit(1))) * 0.12
    diversity = F.lit(1.0) + (distinct_sources - 1) * 0.10
    raw = base * weight * (F.lit(0.4) + conf * 0.6) * volume * diversity * recency
    return F.round(F.least(F.greatest(raw, F.lit(10.0)), F.lit(99.0)), 1)


def score(incidents: DataFrame, evidence: DataFrame, as_of: Column) -> DataFrame:
    """Incidents with verification columns, state and priority from their evidence (A1-A5).

    Incidents without evidence keep what they had. `as_of` replaces the wall clock.
    """
    return score_tallied(incidents.join(tally(evidence), "incident_id", "left"), as_of)


def score_tallied(tallied: DataFrame, as_of: Column) -> DataFrame:
    """`score` of incidents that have the columns of `tally`, null without evidence."""
    kept = [c for c in ("state", "priority_score") if c in tallied.columns]
    joined = tallied.withColumnsRenamed({c: f"_old_{c}" for c in kept})
    sources = F.size("supporting_sources")
    # Read by every column below, so it is computed once.
    sure = confidence(F.col("supporting_weight"), F.col("total_weight"), F.col("supporting_count"), sources)
    scored = staged(joined, {"overall_confidence": F.when(F.col("evidence_count").isNotNull(), sure)})
    known = F.col("evidence_count").isNotNull()
    stance = (F.col("has_official"), F.col("overall_confidence"), F.col("supporting_count"), F.col("contradicting_count"))
    new_priority = priority(
        F.col("severity"), F.col("event_category"), F.col("overall_confidence"), F.col("evidence_count"), sources,
        F.col("last_updated_at"), as_of,
    )

    def or_old(new: Column, name: str) -> Column:
        return F.when(known, new).otherwise(F.col(f"_old_{name}")) if name in kept else F.when(known, new)

    none = F.array().cast("array<string>")
    return scored.select(
        *[c for c in tallied.columns if c not in (*kept, *_TALLIED)],
        or_old(incident_state(*stance), "state").alias("state"),
        or_old(new_priority, "priority_score").alias("priority_score"),
        F.when(known, verification_status(*stance)).otherwise("UNVERIFIED").alias("verification_status"),
        "overall_confidence",
        F.coalesce("supporting_count", F.lit(0).cast("bigint")).alias("supporting_count"),
        F.coalesce("contradicting_count", F.lit(0).cast("bigint")).alias("contradicting_count"),
        F.coalesce("supporting_sources", none).alias("supporting_sources"),
        F.coalesce("contradicting_sources", none).alias("contradicting_sources"),
        F.when(known, explanation(*stance, F.col("supporting_sources")))
        .otherwise("Insufficient multi-source evidence to verify incident.")
        .alias("verification_explanation"),
        F.when(known, as_of).alias("verification_updated_at"),
    )
