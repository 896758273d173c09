"""Sources, validation, tables, streams and duplicates."""

import datetime as dt
import json
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stormweave.functions import identity
from stormweave.functions.spatial import GRID, ring_offsets
from stormweave.operators import contracts, dedup, merges, neighbours
from stormweave.plans.views import reports_view
from stormweave.schemas import REPORT_DDL
from stormweave.session import materialize
from stormweave.sources import export, feeds, images
from stormweave.sources.tables import Tables
from stormweave.streaming import jobs, log

from conftest import SF_DIR

AS_OF = "2024-02-01T00:00:00Z"


def documents(spark, *texts):
    return spark.createDataFrame([(t if isinstance(t, str) else json.dumps(t),) for t in texts], "value string")


def test_stations(spark):
    station = {"station_id": "42182", "station": "Safdarjung", "obs_date": "2024-07-01", "obs_time_utc": "03:00:00",
               "temperature": 31.5, "humidity": 80, "wind_speed": 12, "rainfall_24h": 0.0, "latitude": 28.58, "longitude": 77.2}
    bare = {"station": "Colaba", "obs_date": "2024-07-01T06:00:00"}
    found = feeds.station_reports(documents(spark, {"data": [station]}, [bare], bare, {"status": "down"}, {**station, "longitude": None}))
    good = contracts.accepted(found).orderBy("source_id").collect()
    assert [r.source_id for r in good] == ["42182", "Colaba", "Colaba"]
    assert good[0].text == (
        "IMD Current Weather observation for Safdarjung: Temperature 31.5°C, Relative Humidity 80%, Rainfall (24h) 0.0 mm, Wind Speed 12 km/h."
    )
    assert good[0].event_category == "OTHER" and good[0].cell is not None and good[1].cell is None
    assert [r.is_negated for r in good] == [False] * 3
    assert {e for r in contracts.rejected(found).collect() for e in r.errors} >= {"malformed_document", "partial_coordinates"}
    literal = feeds.station_reports(documents(spark, bare), reference_mode=True).first()
    assert (literal.event_category, literal.is_negated) == ("RAIN", True)


def test_feed_documents(spark):
    rss = """<rss version="2.0"><channel><language>en</language>
      <item><title>Heavy rain</title><description><![CDATA[<p>In &amp; around</p>]]></description><link>http://n/1</link>
        <guid>g1</guid><pubDate>Mon, 01 Jul 2024 10:00:00 +0530</pubDate></item>
      <item><title>Heavy rain again</title><guid>g1</guid><pubDate>Mon, 01 Jul 2024 10:00:00 +0530</pubDate></item>
      <item><title>Cricket</title><guid>g2</guid><pubDate>Mon, 01 Jul 2024 10:00:00 GMT</pubDate></item>
      <item><title>Flood</title><guid>g3</guid></item></channel></rss>"""
    found = feeds.rss_reports(documents(spark, rss, "<rss><broken"))
    good = contracts.accepted(found).collect()
    assert [(r.text, r.source_id, r.url, r.latitude) for r in good] == [("Heavy rain. In & around", "g1", "http://n/1", None)]
    assert good[0].timestamp == dt.datetime(2024, 7, 1, 4, 30)
    assert contracts.rejected(found).count() == 2
    everything = contracts.accepted(feeds.rss_reports(documents(spark, rss), only_relevant=False))
    assert {r.source_id for r in everything.collect()} == {"g1", "g2"}


def test_news_ids_recur_across_documents(spark):
    item = "<item><title>{} rain</title><guid>g1</guid><pubDate>Mon, 01 Jul 2024 10:00:00 GMT</pubDate></item>"
    feeds_ = ["<rss><channel>" + "".join(item.format(w) for w in words) + "</channel></rss>" for words in (("Heavy", "More"), ("Light",), ("Light",))]
    found = feeds.rss_reports(documents(spark, *feeds_)).collect()
    assert sorted(r.text for r in found) == ["Heavy rain", "Light rain", "Light rain"] and len({r.report_id for r in found}) == 1
    news = {"guid": "n1", "pubDate": "Mon, 01 Jul 2024 10:00:00 GMT"}
    listed = [{"items": [{**news, "title": "Heavy rain"}, {**news, "title": "More rain"}]}, [{**news, "title": "Light rain"}]]
    found = feeds.news_json_reports(documents(spark, *listed)).collect()
    assert sorted(r.text for r in found) == ["Heavy rain", "Light rain", "More rain"]


def test_messages_round_trip_and_rejects(spark):
    reports = reports_view(spark, SF_DIR)
    sent = reports.limit(50).withColumn("payload", contracts.report_json(reports)).select("payload")
    assert contracts.accepted(contracts.reports_from_json(sent)).count() == 50
    base = {"report_id": "r", "source": "x", "source_type": "s", "timestamp": "2024-07-01T00:00:00+05:30", "text": "rain"}
    bad = [
        base,
        {**base, "timestamp": "2024-07-01T00:00:00"},
        {**base, "surprise": 1},
        {**base, "latitude": 1.0},
        {**base, "latitude": 95.0, "longitude": 1.0},
        {**base, "cell": 5},
        {k: v for k, v in base.items() if k != "text"},
        "{",
    ]
    errors = contracts.reports_from_json(documents(spark, *bad), "value").select("errors").collect()
    assert [set(r.errors) for r in errors] == [
        set(), {"naive_or_malformed_timestamp", "missing_timestamp"}, {"unknown_fields"}, {"partial_coordinates"},
        {"latitude_out_of_range"}, {"cell_without_coordinates"}, {"missing_text"},
        {"malformed_payload", "missing_report_id", "missing_source", "missing_source_type", "missing_timestamp", "missing_text"},
    ]


def test_report_ids_are_stable(spark):
    row = spark.range(1).select(
        identity.report_id(F.lit("imd"), F.lit("s1"), F.lit("2024-07-01T05:30:00+05:30").cast("timestamp")).alias("id")
    )
    import hashlib

    assert row.first().id == "rep_imd_" + hashlib.sha256(b"imd:s1:2024-07-01T00:00:00+00:00").hexdigest()[:16]


def test_hamming_pairs_equal_brute_force(spark):
    rng = random.Random(3)
    values = {rng.getrandbits(64) for _ in range(150)}
    for v in list(values)[:60]:
        for flips in (1, 3, 5, 6):
            values.add(v ^ sum(1 << b for b in rng.sample(range(64), flips)))
    # A crowd that shares its low half, so that some buckets get split.
    values |= {rng.getrandbits(32) << 32 for _ in range(150)}
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    expected = {
        (a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if bin((a ^ b) & (2**64 - 1)).count("1") <= 5
    }
    frame = spark.createDataFrame([(v,) for v in signed] * 2, "hash bigint")
    for options in ({}, {"bands": 8}, {"crowd": 20}):
        found = {(r.hash_a, r.hash_b) for r in dedup.hamming_pairs(frame, **options).collect()}
        assert found == expected
    assert dedup.copies_of(frame).count() == len(signed)


def plain_classes(values, distance=5):
    left, found = set(values), {}
    while left:
        group, todo = set(), [left.pop()]
        while todo:
            v = todo.pop()
            group.add(v)
            near = {w for w in left if bin((v ^ w) & (2**64 - 1)).count("1") <= distance}
            left -= near
            todo += near
        found |= dict.fromkeys(group, min(group))
    return found


@pytest.mark.parametrize("crowd", [256, 8])
def test_hash_classes_equal_those_of_the_pairs(spark, crowd):
    rng = random.Random(4)
    flip = lambda v, n: v ^ sum(1 << b for b in rng.sample(range(64), n))
    values = {rng.getrandbits(64) for _ in range(40)}
    for v in list(values)[:15]:
        chain = v
        for n in (1, 5, 5, 6, 3, 5):
            chain = flip(chain, n)
            values.add(chain)
    ball = rng.getrandbits(64)
    values |= {flip(ball, rng.choice((2, 3, 5))) for _ in range(120)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    rows = [(v,) for v in [*signed, *signed[:7], None]]
    found = dedup.hash_classes(spark.createDataFrame(rows, "hash bigint"), crowd=crowd).collect()
    assert {r.hash: r.class_id for r in found} == plain_classes(signed) and len(found) == len(signed)
    assert sum(r.copies for r in found) == len(rows) - 1


def test_a_dense_cluster_of_hashes_lists_no_pairs(spark):
    rng = random.Random(6)
    ball = rng.getrandbits(63)
    values = {ball}
    while len(values) < 20_000:
        values.add(ball ^ sum(1 << b for b in rng.sample(range(63), rng.choice((2, 3, 4)))))
    found = dedup.hash_classes(spark.createDataFrame([(v,) for v in values], "hash bigint"))
    assert found.select("class_id").distinct().count() == 1


def test_touching_links_of_a_hot_cell_are_few(spark):
    rng = random.Random(8)
    start = dt.datetime(2024, 7, 1, tzinfo=dt.timezone.utc)
    rows = []
    for i in range(400):
        cell = 10**6 * 7 + rng.choice([0, 0, 0, 1, 2, 50])
        first = start + dt.timedelta(hours=rng.randrange(400))
        cells = [cell, cell + 1] if rng.random() < 0.1 else [cell]
        rows.append((f"i{i:03d}", rng.choice("ab"), first, first + dt.timedelta(hours=rng.randrange(8)), cells))
    frame = spark.createDataFrame(rows, "incident_id string, event_category string, first_reported_at timestamp, last_updated_at timestamp, cells array<bigint>")
    near = {d for d in ring_offsets(1)}
    limit = dt.timedelta(hours=6)
    for same in (True, False):
        left, expected = {r[0]: r for r in rows}, {}
        while left:
            group, todo = [], [left.pop(min(left))]
            while todo:
                a = todo.pop()
                group.append(a[0])
                hit = [
                    b for b in left.values()
                    if (not same or a[1] == b[1]) and a[2] <= b[3] + limit and b[2] <= a[3] + limit
                    and any(x - y in near for x in a[4] for y in b[4])
                ]
                for b in hit:
                    todo.append(left.pop(b[0]))
            expected |= dict.fromkeys(group, min(group))
        found = {r.incident_id: r.group for r in dedup.touching_incidents(frame, same_category=same).collect()}
        assert found == expected
    hot = spark.range(5000).select(
        F.format_string("i%05d", "id").alias("incident_id"), F.lit("a").alias("event_category"), F.lit(start).alias("first_reported_at"),
        F.lit(start + dt.timedelta(hours=1)).alias("last_updated_at"), F.array(F.lit(7_000_000) + F.col("id") % 2).alias("cells"),
    )
    assert dedup.touching_links(hot).count() <= 5010
    assert dedup.touching_incidents(hot).select("group").distinct().count() == 1


def test_neighbours_of_a_hot_cell(spark):
    """Buckets find nearly all of what comparing everything finds, and without its pairs."""
    rng = np.random.default_rng(1)
    n = 2500
    centres = rng.normal(size=(n // 20, 64))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    vectors = centres[rng.integers(0, len(centres), n)] + rng.normal(size=(n, 64)) * rng.choice([0.02, 0.035, 0.05], n)[:, None]
    vectors = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32).tolist()
    start = dt.datetime(2024, 7, 1, tzinfo=dt.timezone.utc)
    rows = [(f"r{i:05d}", start + dt.timedelta(seconds=int(s)), 19.0, 73.0, v) for i, (s, v) in enumerate(zip(rng.integers(0, 21_600, n), vectors, strict=True))]
    rows += [("zero", start, 19.0, 73.0, [0.0] * 64), ("none", start, 19.0, 73.0, None), ("nowhere", start, None, 73.0, vectors[0])]
    frame = spark.createDataFrame(rows, "report_id string, timestamp timestamp, latitude double, longitude double, embedding array<float>").repartition(8)
    found = {(r.report_id, r.neighbour): r.cosine for r in neighbours.semantic_neighbours(frame).collect()}
    exact = {(r.report_id, r.neighbour): r.cosine for r in neighbours.semantic_neighbours(frame, exact=True).collect()}
    assert len(found.keys() & exact.keys()) >= 0.97 * len(exact) > n
    assert max(Counter(a for a, _ in found).values()) <= 5 and min(found.values()) >= 0.9
    assert neighbours.semantic_neighbours(frame.limit(0)).count() == 0


def test_neighbours_do_not_depend_on_the_crowd_of_a_cell(spark, monkeypatch):
    """Each report of a hot cell has its three most similar ones of all, however little similar, in one part or in many."""
    rng = np.random.default_rng(3)
    n = 300
    vectors = rng.normal(size=(n, 64)).astype(np.float32)
    start = dt.datetime(2024, 7, 1, tzinfo=dt.timezone.utc)
    rows = [(f"r{i:03d}", start + dt.timedelta(seconds=60 * i), 19.0, 73.0, v.tolist()) for i, v in enumerate(vectors)]
    frame = spark.createDataFrame(rows, "report_id string, timestamp timestamp, latitude double, longitude double, embedding array<float>")
    wide = vectors.astype(float)
    cosines = np.round(wide @ wide.T, 6)
    expected = set()
    for i in range(n):
        best = sorted((-c, j) for j, c in enumerate(cosines[i]) if j != i and c >= 0.1)[:3]
        expected |= {(f"r{i:03d}", f"r{j:03d}", rank) for rank, (_, j) in enumerate(best, 1)}

    def found(**options):
        return {(r.report_id, r.neighbour, r.rank) for r in neighbours.semantic_neighbours(frame, top_k=3, min_cosine=0.1, **options).collect()}

    assert found() == expected and len(expected) == 3 * n
    monkeypatch.setattr(neighbours, "PART", 50)
    assert found() == expected
    # Buckets are made for similar vectors; what they find is near, and not all of it.
    assert 0 < len({(a, b) for a, b, _ in found(exact=False)} & {(a, b) for a, b, _ in expected}) < len(expected)


def test_buckets_find_most_neighbours_of_a_hot_cell(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(50, 64))
    vectors = centres[rng.integers(0, 50, 1000)] + rng.normal(size=(1000, 64)) * 0.2
    vectors = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32).tolist()
    start = dt.datetime(2024, 7, 1, tzinfo=dt.timezone.utc)
    rows = [(f"r{i:04d}", start + dt.timedelta(seconds=20 * i), 19.0, 73.0, v) for i, v in enumerate(vectors)]
    frame = spark.createDataFrame(rows, "report_id string, timestamp timestamp, latitude double, longitude double, embedding array<float>").repartition(8)
    near = {(r.report_id, r.neighbour) for r in neighbours.semantic_neighbours(frame, exact=False).collect()}
    exact = {(r.report_id, r.neighbour) for r in neighbours.semantic_neighbours(frame).collect()}
    assert len(near & exact) >= 0.97 * len(exact) > 1000


def test_vectors_in_a_table_of_their_own(spark):
    """Reports with the ids of their vectors have the neighbours and pairs they have with the vectors; none of them is shuffled with a vector."""
    rng = np.random.default_rng(2)
    known = [(f"v{i}", rng.normal(size=64).astype(np.float32).tolist()) for i in range(30)]
    known += [("same", known[0][1]), ("unset", None)]
    start = dt.datetime(2024, 7, 1, tzinfo=dt.timezone.utc)
    ids = [known[i][0] for i in rng.integers(0, len(known), 4000)]
    rows = [(f"r{i}", start + dt.timedelta(seconds=int(s)), 19.0 + i % 20, 73.0 + i % 3 * 0.012, v) for i, (s, v) in enumerate(zip(rng.integers(0, 2_000_000, 4000), ids, strict=True))]
    reports = materialize(spark.createDataFrame(rows, "report_id string, timestamp timestamp, latitude double, longitude double, vector_id string").repartition(4), "reports")
    vectors = materialize(spark.createDataFrame(known, "vector_id string, embedding array<float>"), "given-vectors")
    carrying = reports.join(vectors, "vector_id")

    def written() -> float:
        return spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()

    before = written()
    apart = neighbours.semantic_neighbours(reports, min_cosine=0.1, vectors=vectors).collect()
    moved = written() - before
    assert sorted(apart) == sorted(neighbours.semantic_neighbours(carrying, min_cosine=0.1).collect()) and len(apart) > 1000
    assert moved < 4000 * 256
    pairs = dedup.semantic_pairs(reports, 0.1, vectors=vectors).collect()
    assert sorted(pairs) == sorted(dedup.semantic_pairs(carrying.filter("embedding IS NOT NULL"), 0.1).collect()) and len(pairs) > 1000


def test_hash_comparison(spark):
    pairs = [("0f0f0f0f0f0f0f0f", "0f0f0f0f0f0f0f00", True), ("0f0f0f0f0f0f0f0f", "f0f0f0f0f0f0f0f0", False), ("ff", "ff0", False), ("", "", False), ("zz", "zz", True)]
    frame = spark.createDataFrame(pairs, "a string, b string, same boolean")
    found = frame.select("same", dedup.is_duplicate(F.col("a"), F.col("b")).alias("found")).collect()
    assert all(r.same == r.found for r in found)


def test_gradient_hash():
    rows, columns = 16, 18
    falling = bytes(255 - 14 * x for _ in range(rows) for x in range(columns))
    assert images.gradient_hash(rows, columns, 1, falling) == -1
    assert images.gradient_hash(rows, columns, 1, falling[::-1]) == 0
    assert images.gradient_hash(2, 2, 3, b"") is None


def test_connected_groups(spark):
    nodes = spark.createDataFrame([(f"n{i:03d}",) for i in range(60)], "node string")
    chain = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(39)] + [("n050", "n055"), ("n055", "n041")]
    found = {r.node: r.group for r in dedup.connected_groups(nodes, spark.createDataFrame(chain, "a string, b string")).collect()}
    assert all(found[f"n{i:03d}"] == "n000" for i in range(40))
    assert found["n050"] == found["n055"] == found["n041"] == "n041" and found["n059"] == "n059"


def test_numbering_by_ranges(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.8 else f"k{i % 5}", i) for i in range(2000)]
    found = merges.number_rows(spark.createDataFrame(rows, "key string, v int").repartition(8), "key", ["v"]).collect()
    expected = {}
    for key, value in sorted(rows):
        expected.setdefault(key, []).append(value)
    assert all(expected[r.key][r.n - 1] == r.v for r in found) and len(found) == 2000


def full(reports):
    empty = reports.sparkSession.createDataFrame([], REPORT_DDL)
    return contracts.accepted(contracts.validate_reports(empty.unionByName(reports.drop("seq"), allowMissingColumns=True)))


def test_parts_hold_all_children(spark):
    ids = spark.createDataFrame([("a", f"r{i:02d}", i) for i in range(25)] + [("b", "r99", 0)], "incident_id string, report_id string, s long")
    members = ids.withColumn("timestamp", F.timestamp_seconds("s")).drop("s")
    evidence = members.withColumn("evidence_id", F.col("report_id"))
    timeline = members.withColumn("event_type", F.lit("x"))
    nested = merges.assemble(ids.select("incident_id").distinct(), members, evidence, timeline, part_size=10).collect()
    assert sorted((r.incident_id, r.part, len(r.report_ids), len(r.timeline)) for r in nested) == [
        ("a", 0, 10, 10), ("a", 1, 10, 10), ("a", 2, 5, 5), ("b", 0, 1, 1),
    ]


def test_stream_equals_batch_and_survives_redelivery(spark, folder):
    """The continuous job over a log, started again with nothing new and once more with a repeated file."""
    reports = full(reports_view(spark, SF_DIR).filter("seq < 300"))
    log.publish(reports, f"{folder}/log")
    spark.createDataFrame([("9-1", "bad", "{", "x")], log.MESSAGE_DDL).write.mode("append").json(f"{folder}/log")
    store = Tables(spark, f"{folder}/tables")
    moment = F.lit(AS_OF).cast("timestamp")

    def run():
        handler = jobs.pipeline_handler(store, f"{folder}/feed", moment)
        job = log.consume(log.stream_log(spark, f"{folder}/log"), handler, f"{folder}/dead", f"{folder}/checkpoint")
        job.trigger(availableNow=True).start().awaitTermination()

    run()
    first = {tuple(r) for r in store.read("incidents").select("incident_id", "report_count", "priority_score").collect()}
    assert store.read("reports").count() == 300 and len(first) > 10
    dead = spark.read.parquet(f"{folder}/dead").collect()
    assert [r.original_msg_id for r in dead] == ["9-1"] and "malformed_payload" in dead[0].error
    run()
    log.publish(reports, f"{folder}/log")
    run()
    again = {tuple(r) for r in store.read("incidents").select("incident_id", "report_count", "priority_score").collect()}
    assert again == first and store.read("reports").count() == 300
    assert store.read("evidence_items").count() == store.read("incident_members").count()
    feed = spark.read.text(f"{folder}/feed").select(F.get_json_object("value", "$.incident_id").alias("i"))
    assert feed.distinct().count() == len(first)
    path = f"{folder}/csv"
    export.write_csv(export.situation_report(store.read("incidents")), path)
    assert spark.read.csv(path, header=True).count() == len(first)


def test_state_is_carried_over_batches(spark, folder):
    """Two batches with memory give the incidents of one batch when the second continues the first."""
    rows = [("1", "2024-07-01T00:00:00Z", "flood"), ("2", "2024-07-01T01:00:00Z", "heavy rain"), ("3", "2024-07-01T03:00:00Z", "rain"), ("4", "2024-07-01T20:00:00Z", "rain")]
    raw = spark.createDataFrame(rows, "report_id string, t string, text string").select(
        "report_id", F.col("t").cast("timestamp").alias("timestamp"), "text", F.lit("imd").alias("source"),
        F.lit("official").alias("source_type"), F.lit(28.61).alias("latitude"), F.lit(77.2).alias("longitude"),
    )
    reports = full(raw)
    store = Tables(spark, f"{folder}/tables")
    handler = jobs.pipeline_handler(store, f"{folder}/feed", F.lit(AS_OF).cast("timestamp"), remember=True)
    handler(reports.filter("report_id < '3'"), 0)
    handler(reports.filter("report_id >= '3'"), 1)
    found = store.read("incidents").orderBy("first_reported_at").collect()
    assert [(r.event_category, r.report_count) for r in found] == [("FLOOD", 3), ("RAIN", 1)]
    store.delete_incidents(store.read("incidents").filter("event_category = 'RAIN'"))
    assert store.read("incidents").count() == 1 and store.read("incident_members").count() == 3


def test_streaming_sessions_equal_batch(spark, folder):
    from stormweave.operators import correlate

    reports = reports_view(spark, SF_DIR).drop("seq", "media_urls")
    reports.coalesce(1).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(reports.schema).parquet(f"{folder}/in")
    sessions = jobs.stream_sessions(stream)
    expected = correlate.correlate_session(reports_view(spark, SF_DIR)).select("incident_id").distinct().count()
    state = sessions.writeStream.format("memory").queryName("sessions_now").outputMode("complete")
    state.trigger(availableNow=True).start().awaitTermination()
    assert spark.table("sessions_now").count() == expected


def test_two_batches_with_memory_equal_one(spark, folder):
    """The job with memory over two halves of the time gives the incidents of the exact rule over all of it."""
    from stormweave.operators import correlate

    whole = reports_view(spark, SF_DIR)
    expected = {(r.incident_id, r["count"]) for r in correlate.correlate_exact(whole.drop("seq")).groupBy("incident_id").count().collect()}
    reports = full(whole)
    store = Tables(spark, f"{folder}/tables")
    handler = jobs.pipeline_handler(store, f"{folder}/feed", F.lit(AS_OF).cast("timestamp"), remember=True)
    middle = F.lit("2024-01-16T00:00:00Z").cast("timestamp")
    handler(reports.filter(F.col("timestamp") < middle), 0)
    handler(reports.filter(F.col("timestamp") >= middle), 1)
    assert {(r.incident_id, r.report_count) for r in store.read("incidents").collect()} == expected


def test_reports_of_one_moment_come_in_the_order_of_their_numbers(spark, folder):
    """Who opens an incident, and which of two incidents of one moment a later batch joins, follows from the ids."""
    # At each latitude a rain and a flood of one place and moment; they accept each other, so the first one names the incident.
    rows = [(str(10 + n), 10.0 + n, 73.0, "heavy rain") for n in range(8)] + [(str(2 + n), 10.0 + n, 73.0, "flood") for n in range(8)]
    # Two incidents of one moment, two cells apart, and a report of the next batch in the cell between them.
    east = math.sqrt(3) / GRID.kx
    rows += [(str(200 + n), 20.0 + n, 73.0, "heavy rain") for n in range(8)] + [(str(100 + n), 20.0 + n, 73.0 + 2 * east, "heavy rain") for n in range(8)]
    rows += [(str(300 + n), 20.0 + n, 73.0 + east, "heavy rain") for n in range(8)]
    raw = spark.createDataFrame(rows, "report_id string, latitude double, longitude double, text string").select(
        "*", F.lit("2024-07-01T00:00:00Z").cast("timestamp").alias("timestamp"), F.lit("imd").alias("source"), F.lit("official").alias("source_type"),
    )
    late = F.col("report_id").cast("int") >= 300
    reports = full(raw.withColumn("timestamp", F.when(late, F.lit("2024-07-01T01:00:00Z").cast("timestamp")).otherwise(F.col("timestamp"))))
    store = Tables(spark, f"{folder}/tables")
    handler = jobs.pipeline_handler(store, f"{folder}/feed", F.lit(AS_OF).cast("timestamp"), remember=True)
    handler(reports.filter(~late), 0)
    handler(reports.filter(late), 1)
    members = {}
    for r in store.read("incident_members").collect():
        members.setdefault(r.incident_id, set()).add(int(r.report_id))
    together = [{2 + n, 10 + n} for n in range(8)] + [{100 + n, 300 + n} for n in range(8)] + [{200 + n} for n in range(8)]
    assert sorted(map(sorted, members.values())) == sorted(map(sorted, together))
    assert Counter(r.event_category for r in store.read("incidents").collect()) == {"FLOOD": 8, "RAIN": 16}


def test_only_incidents_of_several_parts_are_numbered(spark, monkeypatch):
    children = spark.range(40).select(
        F.when(F.col("id") < 25, "large").otherwise(F.concat(F.lit("small"), F.col("id") % 3)).alias("incident_id"), F.col("id").alias("n_th")
    )
    number, seen = merges.number_rows, []
    monkeypatch.setattr(merges, "number_rows", lambda rows, *more: seen.append(rows.count()) or number(rows, *more))
    found = {(r.incident_id, r.part): [e.n_th for e in r.entries] for r in merges.collect_parts(children, ["n_th"], ["n_th"], "entries", 10).collect()}
    assert seen == [25] and [found["large", p] for p in range(3)] == [list(range(10)), list(range(10, 20)), list(range(20, 25))]
    assert [found[f"small{k}", 0] for k in range(3)] == [[i for i in range(25, 40) if i % 3 == k] for k in range(3)] and len(found) == 6
    assert merges.collect_parts(children, ["n_th"], ["n_th"], "entries", 25).count() == 4 and seen == [25]
