"""Schemas and enumerations of the data model."""

from __future__ import annotations

from pyspark.sql import types as T


def columns(ddl: str) -> list[str]:
    """Column names of a DDL schema; needs a running session."""
    return T.StructType.fromDDL(ddl).fieldNames()

SCHEMA_VERSION = "1.0"

# Enumerations of the data model.
VERIFICATION_STATUSES = ("SUPPORTED", "VERIFIED", "UNVERIFIED", "CONTRADICTED", "PENDING_REVIEW")
EVIDENCE_RELATIONSHIPS = ("SUPPORTING", "CORROBORATING", "CONTRADICTING", "NEUTRAL")
INCIDENT_STATES = ("REPORTED", "VERIFIED", "ESCALATING", "DE_ESCALATING", "RESOLVED")
INCIDENT_SEVERITIES = ("LOW", "MODERATE", "HIGH", "CRITICAL")

MEDIA_ITEM = "struct<url:string,media_type:string,caption:string,source_metadata:string>"

# Free-form JSON (raw payload, media metadata) stays JSON text; `parse_json` turns it into VARIANT on demand.
REPORT_DDL = f"""
    report_id string, source string, source_type string, source_id string,
    timestamp timestamp, received_at timestamp, text string,
    latitude double, longitude double, cell bigint,
    city string, district string, state string, country string,
    event_category string, url string,
    media_urls array<string>, media_items array<{MEDIA_ITEM}>, hashtags array<string>,
    language string, raw_payload string, schema_version string
"""

EVIDENCE_DDL = """
    evidence_id string, incident_id string, report_id string, source string, source_type string,
    relationship string, confidence_score double, source_reliability_weight double, reasoning string,
    extracted_event string, extracted_location string, media_proof_urls array<string>, timestamp timestamp
"""

TIMELINE_DDL = """
    incident_id string, timestamp timestamp, event_type string, description string,
    previous_state string, new_state string, previous_severity string, new_severity string, report_id string
"""

# Incidents are flat rows; reports, evidence and timeline hang off them as child tables, so a busy incident
# never has to fit in one row.
INCIDENT_DDL = """
    incident_id string, title string, event_category string, state string, severity string,
    priority_score double, density_priority double, latitude double, longitude double, cells array<bigint>,
    city string, district string, state_name string, country string,
    first_reported_at timestamp, last_updated_at timestamp, report_count bigint,
    verification_status string, overall_confidence double, supporting_count bigint, contradicting_count bigint,
    supporting_sources array<string>, contradicting_sources array<string>,
    verification_explanation string, verification_updated_at timestamp
"""

MEMBER_DDL = "incident_id string, report_id string, timestamp timestamp"
