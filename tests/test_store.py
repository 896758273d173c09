"""The store under failures: a batch that breaks off at any write and is repeated gives the same tables."""

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

from stormweave.operators import dedup, incidents, merges
from stormweave.operators.incidents import IncidentTables
from stormweave.schemas import REPORT_DDL
from stormweave.session import materialize, shared_folder, temporary_stages
from stormweave.sources.idindex import bucket
from stormweave.sources.tables import STUB, Tables
from stormweave.streaming import jobs, log

AS_OF = "2024-08-01T00:00:00Z"


def reports(spark, rows):
    """(report_id, time, text) rows at one place as canonical reports."""
    raw = spark.createDataFrame(rows, "report_id string, t string, text string").select(
        "report_id", F.col("t").cast("timestamp").alias("timestamp"), "text", F.lit("imd").alias("source"),
        F.lit("official").alias("source_type"), F.lit(28.61).alias("latitude"), F.lit(77.2).alias("longitude"),
    )
    return spark.createDataFrame([], REPORT_DDL).unionByName(raw, allowMissingColumns=True)


ROWS = [
    ("1", "2024-07-01T21:00:00Z", "waterlogging"), ("2", "2024-07-01T22:00:00Z", "waterlogging"), ("3", "2024-07-02T01:00:00Z", "waterlogging"),
    ("4", "2024-07-02T02:00:00Z", "waterlogging"), ("5", "2024-07-03T00:00:00Z", "heatwave"),
]


def state(store):
    rows = {
        "incidents": ["incident_id", "day", "severity", "report_count", "verification_status", "priority_score"],
        "incident_members": ["incident_id", "report_id", "day"],
        "evidence_items": ["incident_id", "report_id", "day"],
        "incident_timeline": ["incident_id", "report_id", "description", "day"],
        "reports": ["report_id", "source_type", "day"],
    }
    return {t: sorted(map(repr, store.read(t).select(*c).collect())) for t, c in rows.items()}


class Broken(Exception):
    pass


def failing_at(monkeypatch, n):
    """Let the n-th write of a table fail, after it is done or before, in turn."""
    done = {"n": 0}
    plain = DataFrameWriter.parquet

    def write(self, path, *args, **kwargs):
        done["n"] += 1
        if done["n"] == n and n % 2:
            raise Broken
        plain(self, path, *args, **kwargs)
        if done["n"] == n:
            raise Broken

    monkeypatch.setattr(DataFrameWriter, "parquet", write)
    return done


@pytest.mark.parametrize("remember", [False, True])
def test_repeated_batches_give_the_same_tables(spark, folder, monkeypatch, remember):
    moment = F.lit(AS_OF).cast("timestamp")
    first, second = reports(spark, ROWS[:2]), reports(spark, ROWS[2:])

    def run(name, breaks=()):
        store = Tables(spark, f"{folder}/{name}")
        handler = jobs.pipeline_handler(store, f"{folder}/{name}-feed", moment, remember)
        handler(first, 0)
        for n in breaks:
            with monkeypatch.context() as patched:
                failing_at(patched, n)
                try:
                    handler(second, 1)
                except Broken:
                    pass
        with monkeypatch.context() as patched:
            done = failing_at(patched, 0)
            handler(second, 1)
        return store, done["n"]

    whole, writes = run("whole")
    expected = state(whole)
    found = {r.event_category: (r.severity, r.report_count) for r in whole.read("incidents").collect()}
    if remember:
        # Scored again with the reports that joined: four reports of waterlogging are critical.
        assert found["WATERLOGGING"] == ("CRITICAL", 4)
    assert writes > 10
    # One run that breaks off again and again, each attempt getting further, before or after a write in turn.
    store, _ = run("broken", range(2, writes + 1, 7))
    assert state(store) == expected


def batch_of(spark, rows):
    return incidents.detect_incidents(reports(spark, rows), F.lit(AS_OF).cast("timestamp"))


def test_an_incident_that_moves_a_day_is_stored_once(spark, folder):
    store = Tables(spark, f"{folder}/tables")
    made = batch_of(spark, ROWS[:2])
    made = IncidentTables(*[materialize(t, "made") for t in made])
    for merge in (store.merge_incidents, store.replace_incidents):
        merge(made)
        earlier = made.incidents.withColumn("first_reported_at", F.col("first_reported_at") - F.expr("INTERVAL 1 DAY"))
        merge(made._replace(incidents=earlier))
        assert store.read("incidents").count() == 1
        assert store.read("incident_members").count() == 2 and store.read("evidence_items").count() == 2
    assert [str(r.day) for r in store.read("incidents").collect()] == ["2024-06-30"]
    assert {str(r.day) for r in store.read("incident_members").collect()} == {"2024-06-30"}
    # Without a summary the evidence stays, and moves along.
    bare = made.incidents.withColumn("verification_status", F.lit(None).cast("string"))
    store.replace_incidents(IncidentTables(bare, made.members.limit(1), made.evidence.limit(0), made.timeline))
    assert store.read("incident_members").count() == 1 and store.read("evidence_items").count() == 2
    assert {str(r.day) for r in store.read("evidence_items").collect()} == {"2024-07-01"}


def test_a_report_takes_the_place_of_its_stub(spark, folder):
    store = Tables(spark, f"{folder}/tables")
    wanted = spark.createDataFrame([("1",), ("9",)], "report_id string")
    store.add_stubs(wanted)
    store.add_stubs(wanted)
    assert sorted((r.report_id, r.source_type) for r in store.read("reports").collect()) == [("1", STUB), ("9", STUB)]
    for _ in range(2):
        store.add_reports(reports(spark, ROWS[:1]))
        assert sorted((r.report_id, r.source_type) for r in store.read("reports").collect()) == [("1", "official"), ("9", STUB)]
    store.upsert_reports(reports(spark, [("9", "2024-07-05T00:00:00Z", "fog")]))
    assert sorted((r.report_id, r.source_type) for r in store.read("reports").collect()) == [("1", "official"), ("9", "official")]


def test_refresh_keeps_what_an_operator_set(spark):
    made = batch_of(spark, ROWS[:2]).incidents
    stored = made.withColumns({"title": F.lit("Mine"), "state": F.lit("RESOLVED"), "severity": F.lit("LOW")})
    row = merges.merge_refreshing(stored, made).first()
    assert (row.title, row.state, row.severity) == ("Mine", "RESOLVED", made.first().severity)


def test_stages_are_deleted(spark):
    path = spark._jvm.org.apache.hadoop.fs.Path
    with temporary_stages(spark):
        rows = materialize(spark.range(3), "gone")
        where = path(rows.inputFiles()[0])
        files = where.getFileSystem(spark._jsc.hadoopConfiguration())
        assert files.exists(where) and shared_folder(spark) in str(where)
    assert not files.exists(where)
    assert materialize(spark.range(3), "kept").count() == 3


def test_dead_letters_are_driven_again_up_to_the_limit(spark, folder):
    good = log.messages(reports(spark, ROWS[:1]))
    bad = spark.createDataFrame([("9-1", "x", "{", "s")], log.MESSAGE_DDL)
    taken = []

    def handler(rows: DataFrame, batch: int) -> None:
        taken.append((batch, sorted(r.report_id for r in rows.collect())))
        if len(taken) == 1:
            raise Broken

    reports_, letters = log.split_batch(good.unionByName(bad))
    assert [r.retries for r in letters.collect()] == ["1"] and reports_.count() == 1
    # One letter holds a payload that is right by now.
    repaired = letters.unionByName(
        log.dead_letters(good.select(F.struct("*").alias("message"), F.array(F.lit("handler_failed")).alias("errors")))
    )
    second = log.redrive_once(repaired, handler, f"{folder}/rounds", 1)
    assert taken == [(-1, ["1"]), (-1, ["1"])]  # the failed attempt was repeated
    third = log.redrive_once(second, handler, f"{folder}/rounds", 2)
    assert [r.retries for r in second.collect()] == ["2"] and [r.retries for r in third.collect()] == ["3"]
    assert log.redrive_once(third, handler, f"{folder}/rounds", 3).count() == 0  # tried often enough


def test_copies_of_a_vector_are_linked(spark):
    rows = [(f"r{k}", f"2024-07-01T00:0{k}:00Z", [1.0, 0.0]) for k in range(3)] + [("s", "2024-07-01T01:02:00Z", [1.0, 0.1])]
    frame = spark.createDataFrame(rows, "report_id string, t string, embedding array<float>").select(
        "report_id", F.col("t").cast("timestamp").alias("timestamp"), "embedding", F.lit(28.6).alias("latitude"), F.lit(77.2).alias("longitude")
    )
    # r2 alone is within the hour of s; its group stands for it.
    pairs = {(r.report_a, r.report_b) for r in dedup.semantic_pairs(frame, 0.9, window_hours=1.0).collect()}
    assert pairs == {("r0", "r1"), ("r0", "r2"), ("r0", "s")}
    assert {r.report_id: r.representative for r in dedup.semantic_copies(frame).collect()} == {"r0": "r0", "r1": "r0", "r2": "r0", "s": "s"}


def test_sessions_keep_reports_without_a_cell(spark):
    from stormweave.operators import correlate

    featured = correlate.with_features(reports(spark, ROWS[:1]).unionByName(
        reports(spark, ROWS[1:2]).withColumns({"latitude": F.lit(None).cast("double"), "longitude": F.lit(None).cast("double")})
    ))
    numbered = correlate.number_sessions(featured, ["cell", "event_category"])
    assert sorted((r.report_id, r.session_no, r.session_start == r.timestamp) for r in numbered.collect()) == [("1", 1, True), ("2", 1, True)]


def test_lookup_tables_are_joined_without_shuffling_reports(spark):
    from stormweave import rules
    from stormweave.operators import evidence
    from stormweave.plans.views import reports_view
    from stormweave.sources import feeds

    from conftest import SF_DIR

    view = reports_view(spark, SF_DIR)
    joined = [
        evidence.with_source_weights(view, rules.weight_table(spark)),
        evidence.with_accepted_categories(view.withColumn("event_category", F.upper("text")), rules.compatibility_table(spark)),
        feeds.with_city(view, rules.city_table(spark)),
    ]
    for frame in joined:
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan


def test_time_ranges_prune_days(spark, folder):
    import datetime as dt

    from stormweave.operators import filters

    store = Tables(spark, f"{folder}/tables")
    store.merge_incidents(batch_of(spark, ROWS))
    found = filters.reported_between(store.read("incidents"), start=dt.datetime(2024, 7, 2, tzinfo=dt.timezone.utc))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "day" in plan.split("PartitionFilters")[1].split("]")[0]
    assert [r.event_category for r in found.collect()] == ["HEATWAVE"]


def test_incidents_are_found_in_the_folders_of_their_ids(spark, folder):
    store = Tables(spark, f"{folder}/tables")
    made = IncidentTables(*[materialize(t, "made") for t in batch_of(spark, ROWS)])
    store.merge_incidents(made)
    stored = {(r.incident_id, r.day) for r in store.read("incidents").select("incident_id", "day").collect()}
    assert len(stored) == 2
    for incident_id, day in stored:
        one = spark.createDataFrame([(incident_id,)], "incident_id string")
        found = store.incident_days.days(one)
        assert [tuple(r) for r in found.collect()] == [(incident_id, day)]
        # The folders are cut before the scan, to that of the id.
        plan = found._jdf.queryExecution().executedPlan().toString()
        kept = spark.range(1).select(bucket(F.lit(incident_id))).first()[0]
        assert f"= {kept})" in plan.split("PartitionFilters")[1].split("]")[0]
    assert store.incident_days.days(spark.createDataFrame([("none",)], "incident_id string")).count() == 0


def test_index_of_days_is_made_compacted_and_repeated(spark, folder):
    store = Tables(spark, f"{folder}/tables")
    made = IncidentTables(*[materialize(t, "made") for t in batch_of(spark, ROWS)])
    ids = made.incidents.select("incident_id")
    store.merge_incidents(made)
    notes = sorted(map(tuple, store.incident_days.days(ids).collect()))
    assert len(notes) == 2
    store.incident_days.compact()
    assert sorted(map(tuple, store.incident_days.days(ids).collect())) == notes
    assert store.incident_days._generations() == [2]
    # A generation that was not completed does not count, nor does what it holds.
    spark.createDataFrame([("x", 1)], "incident_id string, bucket int").write.partitionBy("bucket").parquet(f"{store.incident_days._path(3)}/part")
    assert sorted(map(tuple, store.incident_days.days(ids).collect())) == notes
    # A store from before the index: made from the table, so that incidents that move are still found.
    older = Tables(spark, f"{folder}/older")
    older.append("incidents", store.read("incidents"))
    moved = made.incidents.withColumn("first_reported_at", F.col("first_reported_at") - F.expr("INTERVAL 1 DAY"))
    older.replace_incidents(made._replace(incidents=moved))
    assert older.read("incidents").count() == 2
    # Notes without a row do no harm: an incident may be deleted and come back.
    older.delete_incidents(ids)
    assert older.read("incidents").count() == 0
    older.merge_incidents(made)
    assert older.read("incidents").count() == 2
