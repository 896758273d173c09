"""Situation-report exports and the JSON backup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormweave.functions.identity import iso_utc
from stormweave.functions.text import first_filled
from stormweave.operators.contracts import nest_summary
from stormweave.operators.merges import assemble


def _percent(digits: int) -> Column:
    return F.round(F.coalesce("overall_confidence", F.lit(0.8)) * 100, digits)


def situation_report(incidents: DataFrame) -> DataFrame:
    """Eleven-column situation report with defaults for missing values."""
    return incidents.select(
        F.col("incident_id").alias("Incident ID"),
        F.col("title").alias("Title"),
        F.col("event_category").alias("Category"),
        F.col("severity").alias("Severity"),
        F.round("priority_score", 1).alias("Priority Score"),
        F.coalesce("verification_status", F.lit("UNVERIFIED")).alias("Verification Status"),
        _percent(1).alias("Confidence %"),
        F.col("report_count").alias("Reports Count"),
        first_filled(F.col("city"), F.lit("Unknown")).alias("City"),
        first_filled(F.col("state_name"), F.lit("India")).alias("State"),
        iso_utc(F.col("last_updated_at")).alias("Last Updated"),
    )


def dashboard_report(incidents: DataFrame) -> DataFrame:
    """Ten-column variant: one location column and whole percents."""
    return incidents.select(
        F.col("incident_id").alias("Incident ID"),
        F.col("title").alias("Title"),
        F.col("event_category").alias("Category"),
        F.col("severity").alias("Severity"),
        F.col("priority_score").alias("Priority Score"),
        F.coalesce("verification_status", F.lit("UNVERIFIED")).alias("Status"),
        _percent(0).cast("int").alias("Trust %"),
        F.col("report_count").alias("Reports Count"),
        F.concat_ws(", ", F.nullif("city", F.lit("")), F.nullif("state_name", F.lit(""))).alias("Location"),
        iso_utc(F.col("last_updated_at")).alias("Last Updated"),
    )


def write_csv(report: DataFrame, path: str, one_file: bool = False) -> None:
    """CSV with a header; `path` may be any file system Spark knows. One file only when asked for."""
    (report.coalesce(1) if one_file else report).write.mode("overwrite").option("escape", '"').csv(path, header=True)


def backup(incidents: DataFrame, members: DataFrame, evidence: DataFrame, timeline: DataFrame) -> DataFrame:
    """All incidents as nested documents (S13); write it with `.write.json`."""
    nested = nest_summary(assemble(incidents, members, evidence, timeline))
    return nested.withColumn(
        "verification_summary", F.col("verification_summary").withField("evidence_items", F.col("evidence_items"))
    ).drop("evidence_items")
