"""Faults that show on larger tables only: plans, coordinates and work that must not grow."""

import pytest

from conftest import SF_DIR
from test_queries import plain
from stormweave.operators import dedup
from stormweave.plans.catalogue import ORACLES, QUERIES


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["j2_match_seed_cell", "j3_match_box", "j4_match_any_cell"])
def test_copies_of_incidents_are_not_broadcast(spark, name):
    plan = plan_of(QUERIES[name](spark, SF_DIR))
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_keys_of_hashes_are_not_broadcast(spark):
    from pyspark.sql import functions as F

    hashes = spark.range(200).select(F.xxhash64("id").alias("hash"))
    assert "SortMergeJoin [combination#" in plan_of(dedup.hamming_pairs(hashes))


FAR = (
    "d1_message_handler d2_rejected_counts f6_radius g2_supplied_cell s7_valid_messages p1_unknown_fields p1_validate_reports"
    " r2_dead_letters x15_report_json d2_source_mappings p2_validate_incidents r1_continuous_job s3_social_reports u1_union_sources"
)


@pytest.fixture(scope="module")
def far(spark, tmp_path_factory):
    """Every second event is of users that the map puts beyond 180 degrees, as in large tables."""
    import duckdb

    folder = tmp_path_factory.mktemp("far")
    sql = duckdb.connect()
    moved = f"SELECT * REPLACE (CASE WHEN event_id % 2 = 1 THEN user_id + 89990 ELSE user_id END AS user_id) FROM '{SF_DIR}/events.parquet'"
    sql.execute(f"COPY ({moved}) TO '{folder}/events.parquet' (FORMAT parquet)")
    sql.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    return str(folder), sql


@pytest.mark.parametrize("name", FAR.split())
def test_users_beyond_the_date_line_equal_sql(spark, far, name):
    folder, sql = far
    frame = QUERIES[name](spark, folder)
    found = sorted((tuple(plain(v) for v in row) for row in frame.collect()), key=repr)
    cursor = sql.execute(ORACLES[name])
    order = [[d[0] for d in cursor.description].index(c) for c in frame.columns]
    assert found == sorted((tuple(plain(row[i]) for i in order) for row in cursor.fetchall()), key=repr)


def test_the_world_still_ends_at_180_degrees(spark):
    from stormweave.operators import contracts

    bad = spark.sql("SELECT '1' AS report_id, 'a' AS source, 'b' AS source_type, now() AS timestamp, 'x' AS text, 1D AS latitude, 180.5D AS longitude, CAST(NULL AS bigint) AS cell")
    assert contracts.validate_reports(bad).first()["errors"] == ["longitude_out_of_range"]


def test_incidents_are_made_without_evidence_and_timeline_tables(spark, tmp_path):
    from stormweave.plans import incident_queries

    events = f"{tmp_path}/events.parquet"
    spark.read.parquet(f"{SF_DIR}/events.parquet").write.parquet(events)
    assert incident_queries.inc(spark, str(tmp_path)).count() > 0
    assert {name for _, folder, name in incident_queries._STORED if folder == str(tmp_path)} == {"members", "incidents"}


def test_a_union_of_ids_is_one_row_per_incident(spark):
    from stormweave.plans.incident_queries import inc

    found = QUERIES["u2_union_of_ids"](spark, SF_DIR)
    assert found.columns == ["incident_id", "report_ids"] and found.count() == inc(spark, SF_DIR).count()


def test_texts_are_dealt_before_they_are_hashed(spark):
    from stormweave.plans.report_queries import text_hashes

    plan = plan_of(text_hashes(spark, SF_DIR))
    # A file of one row group is read by one task; words are made behind the shuffle, and not shuffled once more.
    assert plan.count("Exchange") == 1 and plan.index("Generate explode") < plan.index("Exchange hashpartitioning(doc_id")


def test_a_bit_of_a_text_hash_is_set_by_more_than_half_of_the_words(spark, tmp_path):
    import hashlib

    from stormweave.plans.report_queries import text_hashes

    texts = ["one two", "one", "a b c a", " ", None, " ".join(f"w{i}" for i in range(70_000))]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    wanted = {}
    for number, text in enumerate(texts):
        hashes = [int(hashlib.md5(w.encode()).hexdigest()[:16], 16) for w in set((text or "").split())]
        total = sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))
        wanted |= {number: total - (1 << 64) if total >> 63 else total} if hashes else {}
    assert {r["doc_id"]: r["hash"] for r in text_hashes(spark, str(tmp_path)).collect()} == wanted


def test_news_documents_are_dealt_before_they_are_parsed(spark):
    plan = plan_of(QUERIES["s5_news_json"](spark, SF_DIR))
    assert plan.count("Exchange hashpartitioning(report_id") == 1
    assert plan.index("Generate ") < plan.index("Exchange hashpartitioning(report_id")
