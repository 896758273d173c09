"""The corpus pipeline: every stage on its own input against plain versions."""

from __future__ import annotations

import collections

import duckdb
import pytest
from test_operators import DOCS, SF, odd, plain_lines, plain_near, plain_targets, plain_tiling  # noqa: F401  (odd is a fixture)

import corpus_pipeline
from stormweave.llm import tiling
from stormweave.llm.lines import MIN_DOCS
from stormweave.llm.queries import ORACLES, QUERIES

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Rows of `documents` and of each stage's result."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs.collect())
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs.collect())
    return out


def ids(rows):
    return sorted(r.doc_id for r in rows)


def test_stages_are_in_order():
    assert list(STAGES) == ["quality_rules", "line_dedup", "near_duplicates", "decontamination", "mixing"]


def test_quality_stage(steps):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    kept = {i for (i,) in con.sql(f"SELECT doc_id FROM ({ORACLES['op2_quality_rules']}) WHERE kept").fetchall()}
    assert sorted(steps[1]) == sorted(r for r in steps[0] if r.doc_id in kept) and len(steps[1]) < len(steps[0])


def test_line_stage(steps):
    rows = sorted((r.doc_id, r.text) for r in steps[1])
    want = {i: t for (i, old), t in zip(rows, plain_lines(rows, MIN_DOCS), strict=True) if t == old or t.split()}
    assert {r.doc_id: r.text for r in steps[2]} == want
    assert all(r.n_chars == len(r.text) for r in steps[2])


def test_near_duplicate_stage(steps):
    rows = [(r.doc_id, r.text) for r in steps[2]]
    classes = {i: c for (i, _), (c, _) in zip(rows, plain_near(rows, 0.8), strict=True)}
    assert ids(steps[3]) == sorted(set(classes.values()))


def test_decontamination_stage(spark, steps):
    import re

    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t.lower())
    items = [fold(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = set()
    for r in steps[3]:
        text = fold(r.text)
        grams = {tuple(text[k : k + 5]) for k in range(len(text) - 4)}
        for item in items:
            if any(tuple(item[k : k + 5]) in grams for k in range(len(item) - 4)):
                if sum(plain_tiling(text, item, tiling.SEED)) >= tiling.COVERAGE * len(item):
                    bad.add(r.doc_id)
    assert bad and ids(steps[4]) == [i for i in ids(steps[3]) if i not in bad]


def test_mixing_stage(steps):
    source = {r.doc_id: r.source for r in steps[4]}
    sizes = collections.Counter()
    for r in steps[5]:
        sizes[source[r.doc_id]] += r.size
    assert ids(steps[5]) == ids(steps[4])
    assert all(abs(r.target - plain_targets(sizes)[source[r.doc_id]]) < 1e-6 and r.taken <= 2 * r.size for r in steps[5])


def test_run_equals_its_stages(spark, steps):
    assert sorted(QUERIES["pipeline"](spark, SF).collect()) == sorted(steps[5])


def test_stages_take_odd_and_empty_tables(spark, odd):  # noqa: F811
    benchmark_of = SF
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, odd, benchmark_of)
        rows = made.collect()
        assert name == "mixing" or made.columns == odd.columns
        assert len(rows) <= odd.count()
        assert stage(spark, spark.createDataFrame([], DOCS), benchmark_of).count() == 0
