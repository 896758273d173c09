"""The registered queries of this subpackage: each operator over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from stormweave.llm import centroids, classifier, licences, lines, mixing, nearjoin, oracles, pii, quality, rendering, secrets, suffixes, tiling, whitening

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_greedy_tiling")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tiling.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "item_words", "covered", "coverage", "n_tiles", "longest_tile")


@query("op2_quality_rules", oracles.QUALITY)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query("op3_suffix_merge")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(suffixes.remove_repeats(table(spark, sf_dir, "documents")))


@query("op4_lsh_forest_join")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearjoin.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


@query("op5_cube_mix")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@query("op6_license_scan")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.digest(licences.scan_licences(table(spark, sf_dir, "documents")))


@query("op7_quality_classifier")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = classifier.train(docs, table(spark, sf_dir, "labels"))
    scored = classifier.score(docs, model)
    return scored.select("doc_id", classifier.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query("op8_line_templates")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digest(lines.drop_recurring(table(spark, sf_dir, "documents")))


@query("op9_pii_anchors")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_personal_data(table(spark, sf_dir, "documents")))


@query("op10_html_layout")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendering.extract_text(table(spark, sf_dir, "pages"))


@query("op11_ptolemaic_pivots", oracles.CENTROIDS)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.digest(centroids.cluster(table(spark, sf_dir, "embeddings")))


@query("op12_block_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query("op13_credential_links", oracles.SECRETS)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(table(spark, sf_dir, "documents")))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
