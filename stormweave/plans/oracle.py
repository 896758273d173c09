"""Building blocks of the reference SQL: the same views and rules, written independently for DuckDB."""

from __future__ import annotations

import math

from stormweave import rules
from stormweave.functions.spatial import GRID
from stormweave.plans.views import SOURCES, TEXTS


def dbl(value: float) -> str:
    return f"CAST('{value!r}' AS DOUBLE)"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def iso(ts: str) -> str:
    return (
        f"(strftime({ts}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond({ts}) % 1000000 <> 0 THEN '.' ||"
        f" lpad(CAST(microsecond({ts}) % 1000000 AS VARCHAR), 6, '0') ELSE '' END || '+00:00')"
    )


def category(text: str) -> str:
    """Category by counting keywords: overrides first, then the largest count, ties in taxonomy order."""
    counts = {
        name: "(" + " + ".join(f"CAST(contains(lower({text}), {quoted(k)}) AS INT)" for k in words) + ")"
        for name, words in rules.TAXONOMY.items()
    }
    cases = [f"WHEN {counts[name]} > 0 THEN '{name}'" for name in rules.OVERRIDES]
    cases.append(f"WHEN greatest({', '.join(counts.values())}) = 0 THEN 'OTHER'")
    cases += [f"WHEN {c} = greatest({', '.join(counts.values())}) THEN '{name}'" for name, c in counts.items()]
    return "CASE " + " ".join(cases) + " ELSE 'OTHER' END"



def with_cell(source: str, alias: str, latitude: str = "latitude", longitude: str = "longitude") -> str:
    """CTEs that end in `alias`: the source with `aq`, `ar` and `cell`."""
    c1, c2, c3 = dbl(math.sqrt(3.0) / 3.0), dbl(1.0 / 3.0), dbl(2.0 / 3.0)
    return f"""
{alias}_xy AS (SELECT *, {longitude} * {dbl(GRID.kx)} AS gx, {latitude} * {dbl(GRID.ky)} AS gy FROM {source}),
{alias}_qr AS (SELECT *, gx * {c1} - gy * {c2} AS gq, gy * {c3} AS gr FROM {alias}_xy),
{alias}_s AS (SELECT *, floor(gq + 0.5e0) AS rq, floor(gr + 0.5e0) AS rr, floor((-gq - gr) + 0.5e0) AS rs,
  -gq - gr AS gs FROM {alias}_qr),
{alias}_r AS (SELECT *,
  CASE WHEN abs(rq-gq) > abs(rr-gr) AND abs(rq-gq) > abs(rs-gs) THEN -rr - rs ELSE rq END AS aqd,
  CASE WHEN abs(rq-gq) > abs(rr-gr) AND abs(rq-gq) > abs(rs-gs) THEN rr
       WHEN abs(rr-gr) > abs(rs-gs) THEN -rq - rs ELSE rr END AS ard FROM {alias}_s),
{alias} AS (SELECT * EXCLUDE (gx, gy, gq, gr, gs, rq, rr, rs, aqd, ard), CAST(aqd AS BIGINT) AS aq, CAST(ard AS BIGINT) AS ar,
  (CAST(aqd AS BIGINT) + 1048576) * 2097152 + CAST(ard AS BIGINT) + 1048576 AS cell FROM {alias}_r)"""


def _by_user(values: list[str]) -> str:
    return "CASE user_id % 4 " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


_TEXT = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {quoted(v)}" for k, v in TEXTS.items()) + " END"
_FAMILY = (
    "CASE WHEN event_category IN ('HEATWAVE', 'FOG', 'OTHER') THEN event_category ELSE 'CYCLONE' END"
)

REPORTS = f"""
reports AS (SELECT event_id AS seq, CAST(event_id AS VARCHAR) AS report_id, user_id, value, props,
  {_by_user([s for s, _ in SOURCES])} AS source, {_by_user([t for _, t in SOURCES])} AS source_type,
  CAST(user_id AS VARCHAR) AS source_id, ts, {_TEXT} AS text,
  8e0 + ((user_id // 5) % 50) * 0.5e0 AS latitude,
  70e0 + (user_id // 250) * 1e0 + (user_id % 5) * 0.012e0 AS longitude,
  CASE WHEN user_id % 7 <> 0 THEN 'City ' || (user_id // 5) END AS city,
  CASE WHEN user_id % 3 <> 0 THEN 'State ' || (user_id // 250) END AS state, 'India' AS country
  FROM events)"""

FEATURES = f"""{REPORTS}, {with_cell("reports", "placed")},
feat AS (SELECT *, {category("text")} AS event_category, text LIKE 'No flood%' AS is_negated FROM placed)"""

_WEIGHT = (
    "CASE lower(source) "
    + " ".join(f"WHEN '{s}' THEN {round(w * 100)}" for s, w in rules.SOURCE_WEIGHTS.items())
    + " ELSE 50 END"
)

MEMBERS = f"""{FEATURES},
fam AS (SELECT *, {_FAMILY} AS family,
  CASE WHEN source_type = 'official' THEN greatest({_WEIGHT}, 90) ELSE {_WEIGHT} END AS w FROM feat),
gaps AS (SELECT *, lag(ts) OVER (PARTITION BY cell, family ORDER BY ts, seq) AS prev FROM fam),
numbered AS (SELECT *, CAST(sum(CASE WHEN prev IS NULL OR ts - prev > INTERVAL 6 HOUR THEN 1 ELSE 0 END)
  OVER (PARTITION BY cell, family ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_no FROM gaps),
spans AS (SELECT *, min(ts) OVER s AS session_start,
  first_value(event_category) OVER (PARTITION BY cell, family, session_no ORDER BY ts, seq) AS incident_category,
  row_number() OVER (PARTITION BY cell, family, session_no ORDER BY ts, seq) AS n
  FROM numbered WINDOW s AS (PARTITION BY cell, family, session_no)),
members AS (SELECT *, 'inc_' || lower(family) || '_' ||
  substr(sha256(family || '_' || cell || '_' || {iso("session_start")}), 1, 12) AS incident_id, n = 1 AS opens FROM spans)"""

def _accepts(incident: str, report: str) -> str:
    arms = [f"({incident} = '{c}' AND {report} IN ({', '.join(map(quoted, accepted))}))" for c, accepted in rules.COMPATIBLE.items()]
    return f"({' OR '.join(arms)})"


def exact_members(reports: str = "TRUE") -> str:
    """The sequential rule, report by report, as a recursion; ends in `members` like MEMBERS.

    Rows of cells lie further apart than an incident reaches, so each row of five users is walked by itself. The state
    is the list of open incidents in the order of their creation.
    """
    features = FEATURES.replace("FROM events)", f"FROM events WHERE {reports})")
    return f"""RECURSIVE {features},
firsts AS (SELECT ts AS t0, seq AS s0 FROM feat WHERE NOT is_negated ORDER BY ts, seq LIMIT 1),
queue AS (SELECT f.*, user_id // 5 AS lane, row_number() OVER (PARTITION BY user_id // 5 ORDER BY ts, seq) AS step
  FROM feat f, firsts WHERE ts > t0 OR (ts = t0 AND seq >= s0)),
walk AS (
  SELECT DISTINCT lane, 0::BIGINT AS step, CAST([] AS STRUCT(no BIGINT, q BIGINT, r BIGINT, kind VARCHAR, since TIMESTAMP, cell BIGINT, last TIMESTAMP)[]) AS open_,
    CAST(NULL AS STRUCT(no BIGINT, q BIGINT, r BIGINT, kind VARCHAR, since TIMESTAMP, cell BIGINT, last TIMESTAMP)) AS hit FROM queue
  UNION ALL
  SELECT lane, step, CASE WHEN hit IS NULL
      THEN list_append(alive, {{'no': step, 'q': aq, 'r': ar, 'kind': event_category, 'since': ts, 'cell': cell, 'last': ts}})
      ELSE list_transform(alive, lambda i: CASE WHEN i.no = hit.no
        THEN {{'no': i.no, 'q': i.q, 'r': i.r, 'kind': i.kind, 'since': i.since, 'cell': i.cell, 'last': ts}} ELSE i END) END,
    coalesce(hit, {{'no': step, 'q': aq, 'r': ar, 'kind': event_category, 'since': ts, 'cell': cell, 'last': ts}})
  FROM (SELECT *, list_filter(alive, lambda i: (abs(i.q - aq) + abs(i.r - ar) + abs(i.q - aq + i.r - ar)) // 2 <= 1
      AND {_accepts("i.kind", "event_category")})[1] AS hit
    FROM (SELECT o.*, list_filter(w.open_, lambda i: o.ts - i.last <= INTERVAL 6 HOUR) AS alive
      FROM walk w JOIN queue o ON o.lane = w.lane AND o.step = w.step + 1))),
weighed AS (SELECT *, CASE WHEN source_type = 'official' THEN greatest({_WEIGHT}, 90) ELSE {_WEIGHT} END AS w FROM queue),
members AS (SELECT o.*, 'inc_' || lower(hit.kind) || '_' || substr(sha256(hit.kind || '_' || hit.cell || '_' || {iso("hit.since")}), 1, 12) AS incident_id,
  hit.kind AS incident_category, hit.no = o.step AS opens,
  row_number() OVER (PARTITION BY o.lane, hit.no ORDER BY o.ts, o.seq) AS n
  FROM weighed o JOIN walk v ON v.lane = o.lane AND v.step = o.step)"""


_SEVERITY = """CASE WHEN event_category IN ('FLOOD', 'CYCLONE') THEN CASE WHEN {n} >= 3 THEN 'CRITICAL' ELSE 'HIGH' END
  WHEN event_category IN ('WATERLOGGING', 'THUNDERSTORM', 'LIGHTNING')
    THEN CASE WHEN {n} >= 4 THEN 'CRITICAL' WHEN {n} >= 2 THEN 'HIGH' ELSE 'MODERATE' END
  ELSE CASE WHEN {n} >= 5 THEN 'CRITICAL' WHEN {n} >= 3 THEN 'HIGH' ELSE 'MODERATE' END END"""


def severity(n: str, category_column: str = "event_category") -> str:
    return _SEVERITY.format(n=n).replace("event_category", category_column)


def _mean(axis: str) -> str:
    """Mean to four decimals in whole micro-degrees, so that ties round the same way everywhere."""
    total = f"CAST(sum(CAST(round({axis} * 1e6) AS BIGINT)) AS BIGINT)"
    return f"CASE WHEN count(*) = 1 THEN any_value({axis}) ELSE ((2 * {total} + 100 * count(*)) // (200 * count(*))) / 1e4 END"


ROLLED = f"""{MEMBERS},
stats AS (SELECT incident_id, min(ts) AS first_reported_at, max(ts) AS last_updated_at, count(*) AS report_count,
  {_mean("latitude")} AS latitude, {_mean("longitude")} AS longitude FROM members GROUP BY incident_id),
rolled AS (SELECT incident_id, m.incident_category AS event_category, m.city, m.state AS state_name, m.country, m.cell,
  s.first_reported_at, s.last_updated_at, s.report_count, s.latitude, s.longitude,
  {severity("s.report_count", "m.incident_category")} AS severity,
  CASE WHEN s.report_count = 1 THEN 50e0 ELSE least(round(
    CASE WHEN m.incident_category IN ('CYCLONE', 'FLOOD') THEN 65e0
         WHEN m.incident_category IN ('WATERLOGGING', 'THUNDERSTORM', 'LIGHTNING') THEN 55e0 ELSE 40e0 END
    + least(s.report_count * 7.5e0, 30e0), 1), 99e0) END AS density_priority,
  array_to_string(list_transform(string_split(lower(m.incident_category), '_'),
    lambda w: upper(w[1]) || w[2:]), ' ') || ' Alert in ' ||
    coalesce(m.city, m.state, printf('(%.2f, %.2f)', m.latitude, m.longitude)) AS title
  FROM stats s JOIN (SELECT * FROM members WHERE opens) m USING (incident_id))"""

_EVENT_WEIGHT = (
    "CASE event_category " + " ".join(f"WHEN '{c}' THEN {dbl(w)}" for c, w in rules.EVENT_WEIGHTS.items()) + " ELSE 1e0 END"
)
_BASE = "CASE severity " + " ".join(f"WHEN '{s}' THEN {dbl(v)}" for s, v in rules.SEVERITY_BASE.items()) + " END"

INCIDENTS = f"""{ROLLED},
tallied AS (SELECT incident_id, count(*) FILTER (NOT is_negated) AS supporting_count,
  count(*) FILTER (is_negated) AS contradicting_count, count(*) AS evidence_count,
  coalesce(sum(w) FILTER (NOT is_negated), 0) / 100e0 AS sw, sum(w) / 100e0 AS tw,
  count(DISTINCT source) FILTER (NOT is_negated) AS ds,
  coalesce(string_agg(DISTINCT source, ', ' ORDER BY source) FILTER (NOT is_negated), '') AS supporting_sources,
  coalesce(string_agg(DISTINCT source, ', ' ORDER BY source) FILTER (is_negated), '') AS contradicting_sources,
  coalesce(bool_or(source_type = 'official' OR lower(source) = 'imd') FILTER (NOT is_negated), false) AS has_official
  FROM members GROUP BY incident_id),
sure AS (SELECT *, CAST(round(CAST(CAST(least(greatest((CASE WHEN supporting_count > 0 THEN sw / supporting_count ELSE 0e0 END) * (sw / tw)
  + CASE WHEN ds > 1 THEN (ds - 1) * 0.08e0 ELSE 0e0 END, 0.15e0), 0.98e0) AS VARCHAR) AS DECIMAL(20, 17)), 2) AS DOUBLE) AS overall_confidence FROM tallied),
judged AS (SELECT *, CASE WHEN contradicting_count > supporting_count AND contradicting_count > 1 THEN 'CONTRADICTED'
  WHEN has_official OR (overall_confidence >= 0.65e0 AND supporting_count >= 2) THEN 'SUPPORTED'
  WHEN supporting_count >= 1 THEN 'PENDING_REVIEW' ELSE 'UNVERIFIED' END AS verification_status FROM sure),
inc AS (SELECT *, CASE verification_status WHEN 'CONTRADICTED' THEN 'DE_ESCALATING' WHEN 'SUPPORTED' THEN 'VERIFIED'
    ELSE 'REPORTED' END AS state,
  round(least(greatest({_BASE} * {_EVENT_WEIGHT} * (0.4e0 + overall_confidence * 0.6e0)
    * (1e0 + ln(greatest(evidence_count, 1)) * 0.12e0) * (1e0 + (ds - 1) * 0.1e0)
    * greatest(0.7e0, 1e0 - greatest(0e0, epoch_us(TIMESTAMP '2024-02-01') / 3.6e9 - epoch_us(last_updated_at) / 3.6e9 - 6e0) * 0.01e0),
    10e0), 99e0), 1) AS priority_score
  FROM rolled JOIN judged USING (incident_id))"""


def exact_incidents(reports: str = "TRUE") -> str:
    """INCIDENTS over the members of the sequential rule."""
    return INCIDENTS.replace(MEMBERS, exact_members(reports))


def select(base: str, body: str) -> str:
    """A query over the blocks; a body that starts with a comma adds blocks of its own."""
    return f"WITH {base}{'' if body.startswith(',') else chr(10)}{body}"
