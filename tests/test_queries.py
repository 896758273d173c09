"""Registered queries against their SQL on the small tables, and the plans that matter."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from conftest import SF_DIR
from stormweave.plans.catalogue import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for name in TABLES.split():
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return value


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sql, name):
    frame = QUERIES[name](spark, SF_DIR)
    names = frame.columns
    found = sorted((tuple(plain(v) for v in row) for row in frame.collect()), key=repr)
    cursor = sql.execute(ORACLES[name])
    given = [d[0] for d in cursor.description]
    assert sorted(given) == sorted(names)
    order = [given.index(n) for n in names]
    expected = sorted((tuple(plain(row[i]) for i in order) for row in cursor.fetchall()), key=repr)
    assert found == expected


def test_every_oracle_has_a_query_and_the_entry_runs(spark):
    assert set(ORACLES) <= set(QUERIES)
    top = entry_point.entry(spark)
    assert top.count() == 100 and "priority_score" in top.columns


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_filters_reach_the_scan(spark):
    from stormweave.operators import filters
    from stormweave.plans.incident_queries import inc

    # Plans cut long lists of pushed filters; show them whole.
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    plan = plan_of(filters.near(inc(spark, SF_DIR), 9.2, 70.3, 50.0).select("incident_id"))
    assert "GreaterThanOrEqual(latitude" in plan and "LessThanOrEqual(longitude" in plan
    assert "title" not in plan.split("ReadSchema")[1]
    plan = plan_of(filters.newest_first(inc(spark, SF_DIR), 10))
    assert "TakeOrderedAndProject" in plan


def test_no_cross_joins_and_hash_aggregates(spark):
    from stormweave.operators import correlate
    from stormweave.plans.views import reports_view

    featured = correlate.with_features(reports_view(spark, SF_DIR))
    plan = plan_of(correlate.session_buckets(featured, ["cell", "event_category"]))
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "CartesianProduct" not in plan


def test_a_page_by_continuation_reads_its_days_only(spark, folder):
    import datetime as dt

    from stormweave.operators import filters
    from stormweave.plans.incident_queries import inc, stored
    from stormweave.sources.tables import Tables

    made = stored(spark, SF_DIR)
    store = Tables(spark, folder)
    store.merge_incidents(made._replace(members=made.members.select("incident_id", "report_id", "timestamp")))
    after = (dt.datetime(2024, 1, 20, 5, tzinfo=dt.timezone.utc), "")
    page = filters.newest_after(store.read("incidents"), 10, after, days=2)
    pruned = plan_of(page).split("PartitionFilters: [")[1].split("]")[0]
    assert "<= 2024-01-20" in pruned and "> 2024-01-18" in pruned and page.count() == 10
    whole = filters.newest_first(inc(spark, SF_DIR).filter(F.col("first_reported_at") < F.lit(after[0])), 10)
    assert [r.incident_id for r in page.collect()] == [r.incident_id for r in whole.collect()]
