"""Correlation against an independent sequential fold, and the documented cases."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from stormweave import rules
from stormweave.functions.spatial import axial_q, axial_r
from stormweave.operators import correlate, evidence, incidents
from stormweave.operators.centroid import running_centroid

START = dt.datetime(2024, 7, 1, tzinfo=dt.timezone.utc)
SCHEMA = "report_id string, seq bigint, timestamp timestamp, text string, latitude double, longitude double, source string, source_type string"
TEXT = {
    "RAIN": "rain", "FLOOD": "flood", "WATERLOGGING": "waterlogged", "THUNDERSTORM": "thunder", "LIGHTNING": "bijli",
    "STRONG_WIND": "gale", "CYCLONE": "cyclone", "HEATWAVE": "garmi", "FOG": "kohra", "HAILSTORM": "olay",
}


def frame(spark, rows):
    return spark.createDataFrame(
        [(str(i), i, ts, text, lat, lon, "twitter", "social_media") for i, (ts, text, lat, lon) in enumerate(rows)], SCHEMA
    )


def fold(rows, k=1, window=6 * 3_600_000_000):
    """(us, seq, q, r, category, negated, id) rows in order; earliest-created matching incident wins."""
    found, assigned = [], {}
    for us, _seq, q, r, category, neg, rid in sorted(rows, key=lambda x: x[:2]):
        if neg and not found:
            continue
        match = None
        for incident in found:
            if q is None or incident["q"] is None:
                continue
            dq, dr = incident["q"] - q, incident["r"] - r
            near = (abs(dq) + abs(dr) + abs(dq + dr)) // 2 <= k
            if near and category in rules.COMPATIBLE[incident["category"]] and us - incident["last"] <= window:
                match = incident
                break
        if match is None:
            match = {"n": len(found), "q": q, "r": r, "category": category, "last": us}
            found.append(match)
        match["last"] = max(match["last"], us)
        assigned[rid] = match["n"]
    return assigned


def same_grouping(spark, reports, k=1, **options):
    rows = (
        correlate.with_features(reports)
        .select(
            F.unix_micros("timestamp").alias("us"), "seq", axial_q(F.col("cell")).alias("q"), axial_r(F.col("cell")).alias("r"),
            "event_category", "is_negated", "report_id",
        )
        .collect()
    )
    expected = fold([tuple(r) for r in rows], k)
    found = correlate.correlate_exact(reports, k=k, **options).collect()
    assert {r["report_id"] for r in found} == set(expected)
    groups = {}
    for r in found:
        groups.setdefault(expected[r["report_id"]], set()).add(r["incident_id"])
    assert all(len(ids) == 1 for ids in groups.values())
    assert len(set.union(*groups.values())) == len(groups)
    assert sum(r["opens"] for r in found) == len(groups)


def random_rows(seed, n=400, cells=6, hours=60):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        ts = START + dt.timedelta(minutes=rng.randrange(hours * 60))
        text = "no reports of rain" if rng.random() < 0.1 else TEXT[rng.choice(list(TEXT))]
        lat, lon = (None, None) if rng.random() < 0.05 else (19.0 + rng.randrange(cells) * 0.013, 73.0 + rng.randrange(cells) * 0.013)
        rows.append((ts, text, lat, lon))
    return rows


@pytest.mark.parametrize(
    ("seed", "options"),
    [
        (1, {}),
        (2, {"tile_cells": 2, "halo_cells": 2}),
        (3, {"tile_cells": 1, "halo_cells": 3}),
        (4, {"k": 2, "tile_cells": 3, "halo_cells": 4}),
        (5, {"slice_hours": 7, "halo_hours": 0}),
        (6, {"tile_cells": 2, "halo_cells": 2, "slice_hours": 5, "halo_hours": 12}),
    ],
)
def test_exact_equals_sequential_fold(spark, seed, options):
    same_grouping(spark, frame(spark, random_rows(seed)), **options)


def test_hot_cell_and_long_chain(spark):
    """Most reports in one cell, and a chain of reports that keeps one incident open for days."""
    hot = [(START + dt.timedelta(minutes=i), "rain", 19.0, 73.0) for i in range(600)]
    chain = [(START + dt.timedelta(hours=5 * i), "flood", 19.013, 73.0) for i in range(30)]
    same_grouping(spark, frame(spark, hot + chain), tile_cells=1, halo_cells=2)


def test_incidents_open_over_many_slices(spark):
    """An incident that outlives its slice is handed on; a run may be longer than a slice, too."""
    hot = [(START + dt.timedelta(minutes=7 * i), "rain", 19.0, 73.0) for i in range(600)]
    chain = [(START + dt.timedelta(hours=5 * i), "flood", 19.013, 73.0) for i in range(15)]
    pauses = [(START + dt.timedelta(hours=9 * i), "waterlogged", 19.013, 73.013) for i in range(8)]
    same_grouping(spark, frame(spark, hot + chain + pauses), tile_cells=2, halo_cells=2, slice_hours=12, halo_hours=6)


def test_a_year_of_one_tile_is_many_blocks(spark):
    runs = spark.range(0, 365 * 4).select(
        F.lit(0).cast("long").alias("_apart"), correlate.GRID.cell(F.lit(19.0), F.lit(73.0)).alias("cell"), F.lit(1).alias("category_no"),
        (F.col("id") * 21_600_000_001).alias("run_us"), F.lit(0).cast("long").alias("run_seq"),
        (F.col("id") * 21_600_000_001 + 1000).alias("run_end_us"), F.lit(False).alias("fixed"),
    )
    hour = 3_600_000_000
    placed = correlate._placed(runs, 1, 64, 8, 6 * hour, round(correlate.SLICE_HOURS) * hour, 24 * hour)
    own = placed.join(placed.filter("owned").select("tile").distinct(), "tile", "left_semi")
    sizes = [r["count"] for r in own.groupBy("slice").count().collect()]
    assert len(sizes) >= 26 and max(sizes) < 80


def test_reports_apart_never_meet(spark):
    rows = [(START, "rain", 19.0, 73.0), (START, "no rain", 19.0, 73.0), (START, "rain", 19.0, 73.0), (START + dt.timedelta(minutes=5), "rain", 19.0, 73.0)]
    found = correlate.correlate_exact(frame(spark, rows), apart="report_id").orderBy("seq").collect()
    assert [r.seq for r in found] == [0, 2, 3] and [r.opens for r in found] == [True, False, True]
    assert found[0].incident_id == found[1].incident_id != found[2].incident_id


def test_a_batch_of_one_report_is_not_replayed(spark, monkeypatch):
    rows = [(START, "no rain", 19.0, 73.0), (START, "rain", 19.0, 73.0), (START, "rain", 19.0, 73.0), (START, "rain", None, None)]
    rows += [(START + dt.timedelta(hours=1), "no rain", 19.0, 73.0)]
    reports = frame(spark, rows).withColumn("batch", F.when(F.col("seq") < 2, "a").when(F.col("seq") == 4, "a").otherwise(F.col("report_id")))
    replay, seen = correlate.assign_runs, []
    monkeypatch.setattr(correlate, "assign_runs", lambda runs, *more: seen.append(runs.count()) or replay(runs, *more))
    found = correlate.correlate_exact(reports, apart="batch").orderBy("seq").collect()
    # The batch of three loses its leading negation and keeps two reports of one run; only they are replayed.
    assert [r.seq for r in found] == [1, 2, 3, 4] and seen == [1]
    assert found[0].incident_id == found[1].incident_id == found[3].incident_id != found[2].incident_id
    correlate.correlate_exact(reports, apart="report_id").collect()
    assert seen == [1]


def grouped(spark, rows, **options):
    found = correlate.correlate_exact(frame(spark, rows), **options).groupBy("incident_id").count().collect()
    return sorted(r["count"] for r in found)


def test_documented_cases(spark):
    noon = START + dt.timedelta(hours=12)
    half = noon + dt.timedelta(minutes=30)
    assert grouped(spark, [(noon, "heavy rain", 28.6280, 77.3649), (half, "waterlogging", 28.6350, 77.3700)]) == [2]
    assert grouped(spark, [(noon, "rain", 28.61, 77.20), (noon, "rain", 19.07, 72.87)]) == [1, 1]
    assert grouped(spark, [(noon, "rain", 28.61, 77.20), (noon + dt.timedelta(hours=12), "rain", 28.61, 77.20)]) == [1, 1]
    assert grouped(spark, [(noon, "rain", 28.61, 77.20), (half, "heatwave", 28.61, 77.20)]) == [1, 1]
    edge = dt.timedelta(hours=6)
    assert grouped(spark, [(noon, "rain", 28.61, 77.20), (noon + edge, "rain", 28.61, 77.20)]) == [2]
    over = edge + dt.timedelta(microseconds=1)
    assert grouped(spark, [(noon, "rain", 28.61, 77.20), (noon + over, "rain", 28.61, 77.20)]) == [1, 1]
    # A cyclone takes in rain, rain does not take in a cyclone.
    assert grouped(spark, [(noon, "cyclone", 28.61, 77.20), (half, "rain", 28.61, 77.20)]) == [2]
    assert grouped(spark, [(noon, "rain", 28.61, 77.20), (half, "cyclone", 28.61, 77.20)]) == [1, 1]


def test_no_coordinates_never_match_and_leading_negations_drop(spark):
    noon = START
    rows = [(noon, "rain", None, None), (noon, "rain", None, None)]
    assert grouped(spark, rows) == [1, 1]
    only_negated = [(noon, "no flood here", 28.61, 77.20), (noon, "false alarm", 28.61, 77.20)]
    assert grouped(spark, only_negated) == []
    later = [*only_negated, (noon + dt.timedelta(hours=1), "flood", 28.61, 77.20), (noon + dt.timedelta(hours=9), "no flood", 28.61, 77.20)]
    assert grouped(spark, later) == [1, 1]


def scored(spark, rows, **options):
    reports = spark.createDataFrame(
        [(str(i), i, ts, text, lat, lon, s, t) for i, (ts, text, lat, lon, s, t) in enumerate(rows)], SCHEMA
    )
    return incidents.detect_incidents(reports, F.lit("2024-07-01T02:00:00Z").cast("timestamp"), **options)


def test_evidence_cases(spark):
    later = START + dt.timedelta(minutes=30)
    support = scored(
        spark,
        [(START, "heavy flooding", 28.61, 77.2, "imd", "official"), (later, "flood water", 28.61, 77.2, "twitter", "social_media")],
    ).incidents.collect()
    assert len(support) == 1
    row = support[0]
    assert (row.verification_status, row.state, row.supporting_count) == ("SUPPORTED", "VERIFIED", 2)
    assert row.overall_confidence == 0.86  # (0.95 + 0.60) / 2 + 0.08, rounded half up
    assert row.severity == "HIGH" and row.density_priority == 80.0 and row.title == "Flood Alert in (28.61, 77.20)"
    against = scored(
        spark,
        [(START, "flood", 28.61, 77.2, "citizen_app", "citizen"), (later, "No flood", 28.61, 77.2, "imd", "official")],
    )
    row = against.incidents.first()
    assert (row.supporting_count, row.contradicting_count) == (1, 1) and row.overall_confidence <= 0.5
    assert {r.relationship for r in against.evidence.collect()} == {"SUPPORTING", "CONTRADICTING"}
    assert [r.event_type for r in against.timeline.orderBy("timestamp").collect()] == ["incident_created", "report_correlated"]


def test_severity_and_density_follow_the_steps(spark):
    """Closed forms against the step-by-step rule."""
    order = ["MODERATE", "HIGH", "CRITICAL"]

    def stepwise(category, n):
        severity = "HIGH" if category in ("FLOOD", "CYCLONE") else "MODERATE"
        score = 50.0
        base = 65.0 if category in ("CYCLONE", "FLOOD") else 55.0 if category in evidence.FAST_RISING else 40.0
        for count in range(2, n + 1):
            score = min(round(base + min(count * 7.5, 30.0), 1), 99.0)
            if count >= 5 or score >= 85.0:
                severity = "CRITICAL"
            elif count >= 3 or score >= 70.0:
                severity = "HIGH"
        assert severity in order
        return severity, score

    cases = [(c, n) for c in rules.COMPATIBLE for n in range(1, 9)]
    rows = spark.createDataFrame(cases, "c string, n bigint").select(
        "c", "n", evidence.severity(F.col("n"), F.col("c")).alias("s"), evidence.density_priority(F.col("n"), F.col("c")).alias("d")
    )
    assert all((r.s, r.d) == stepwise(r.c, r.n) for r in rows.collect())


@pytest.mark.parametrize("part_size", [10_000, 7])
def test_running_centroid(spark, part_size):
    rng = random.Random(5)
    rows = [
        (f"i{rng.randrange(3)}", i, START + dt.timedelta(seconds=i // 2), 19 + rng.random() * 0.03, 73 + rng.random() * 0.03)
        for i in range(200)
    ]
    expected = {}
    for incident, _seq, _ts, lat, lon in rows:
        n, a, b = expected.get(incident, (0, 0.0, 0.0))
        n += 1
        expected[incident] = (1, lat, lon) if n == 1 else (n, round((a * (n - 1) + lat) / n, 4), round((b * (n - 1) + lon) / n, 4))
    members = spark.createDataFrame(rows, "incident_id string, seq bigint, timestamp timestamp, latitude double, longitude double")
    found = {r.incident_id: (r.latitude, r.longitude) for r in running_centroid(members, part_size).collect()}
    assert found == {i: v[1:] for i, v in expected.items()}


def test_session_variant_merges_at_exactly_six_hours(spark):
    rows = [(START + dt.timedelta(hours=6 * i), "rain", 28.61, 77.2) for i in range(4)]
    rows += [(START + dt.timedelta(hours=25), "garmi", 28.61, 77.2), (START, "rain", None, None)]
    found = correlate.correlate_session(frame(spark, rows)).groupBy("incident_id").count().collect()
    assert sorted(r["count"] for r in found) == [1, 1, 4]


def test_incidents_are_rolled_up_and_tallied_in_one_pass(spark):
    rows = [(START + dt.timedelta(minutes=7 * i), ("heavy rain", "no rain", "rain")[i % 3], 19.0 + i % 4 * 0.01, 73.0) for i in range(40)]
    reports = frame(spark, rows).withColumns({
        "source": F.element_at(F.array(*map(F.lit, ("imd", "twitter", "news_rss"))), F.expr("int(seq div 2 % 3 + 1)")),
        "source_type": F.expr("CASE seq div 2 % 3 WHEN 0 THEN 'official' WHEN 1 THEN 'social_media' END"),
    })
    members = correlate.correlate_exact(reports, apart="source")
    members = members.unionByName(members.filter("seq = 3").withColumns({"incident_id": F.lit("inc_nowhere"), "cell": F.lit(None).cast("long"), "opens": F.lit(True)}))
    now = F.lit(START + dt.timedelta(days=1))
    made = incidents.from_members(members, now).incidents
    apart = evidence.score(evidence.roll_up(members), evidence.evidence_items(members), now).select(*made.columns)
    assert sorted(made.collect(), key=lambda r: r.incident_id) == sorted(apart.collect(), key=lambda r: r.incident_id)
    # One pass to sum, one to bring incidents together, one for the openers.
    plans = [df._jdf.queryExecution().sparkPlan().toString() for df in (made, apart)]
    assert plans[0].count("ObjectHashAggregate") < plans[1].count("ObjectHashAggregate") and plans[0].count("Join") < plans[1].count("Join")
