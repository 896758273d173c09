"""The report log: publish, consume with dead letters, replay.

A log is any streaming source of (msg_id, report_id, payload, source): a folder of JSON lines here, a Kafka topic
in production. The checkpoint of the consuming query is its acknowledgement.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter

from stormweave.functions.spatial import GRID, HexGrid
from stormweave.operators import contracts
from stormweave.session import materialize, temporary_stages

MESSAGE_DDL = "msg_id string, report_id string, payload string, source string"
DEAD_LETTER_DDL = "original_msg_id string, error string, retries string, original_payload string"
MAX_RETRIES = 3


def messages(reports: DataFrame, at: Column | None = None) -> DataFrame:
    """Reports as log messages (S8). Ids are `millis-sequence`, ordered by time and unique within a batch."""
    millis = F.unix_millis(F.current_timestamp() if at is None else at)
    return reports.select(
        F.concat(millis.cast("string"), F.lit("-"), F.monotonically_increasing_id().cast("string")).alias("msg_id"),
        "report_id",
        contracts.report_json(reports).alias("payload"),
        "source",
    )


def publish(reports: DataFrame, path: str) -> None:
    messages(reports).write.mode("append").json(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MESSAGE_DDL).json(path)


def stream_log(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """The log as a stream (S7); `files_per_batch` bounds a micro-batch."""
    reader = spark.readStream.schema(MESSAGE_DDL)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)


def stream_kafka(spark: SparkSession, servers: str, topic: str, per_batch: int | None = None) -> DataFrame:
    """The same from Kafka; the connector comes with the cluster."""
    reader = (
        spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
        .option("startingOffsets", "earliest")
    )
    if per_batch is not None:
        reader = reader.option("maxOffsetsPerTrigger", per_batch)
    return reader.load().select(
        F.concat_ws("-", F.unix_millis("timestamp").cast("string"), F.col("offset").cast("string")).alias("msg_id"),
        F.col("key").cast("string").alias("report_id"),
        F.col("value").cast("string").alias("payload"),
        F.lit(topic).alias("source"),
    )


def id_parts(msg_id: Column) -> tuple[Column, Column]:
    """Millis and sequence of a message id as numbers; a missing sequence is 0."""
    parts = F.split(msg_id, "-")
    return F.get(parts, 0).try_cast("bigint"), F.coalesce(F.get(parts, 1).try_cast("bigint"), F.lit(0).cast("bigint"))


def replay(log: DataFrame, start_id: str = "0-0", count: int | None = 100) -> DataFrame:
    """Messages from a start id on, inclusive, in id order (S9). `count` None replays everything."""
    millis, seq = id_parts(F.col("msg_id"))
    start_millis, start_seq = id_parts(F.lit(start_id))
    later = (millis > start_millis) | ((millis == start_millis) & (seq >= start_seq))
    ordered = log.filter(later & F.col("payload").isNotNull() & (F.col("payload") != "")).orderBy(millis, seq)
    return ordered if count is None else ordered.limit(count)


def dead_letters(failed: DataFrame, retries: Column | int = 1) -> DataFrame:
    """Rejected messages, with what was sent as `message`, in the shape of the dead-letter table (R2)."""
    attempts = retries if isinstance(retries, Column) else F.lit(retries)
    return failed.select(
        F.col("message.msg_id").alias("original_msg_id"),
        F.array_join("errors", "; ").alias("error"),
        attempts.cast("string").alias("retries"),
        F.to_json(F.col("message").dropFields("msg_id")).alias("original_payload"),
    )


def redrive(dead: DataFrame, max_retries: int = MAX_RETRIES) -> DataFrame:
    """Dead letters that may be tried again, as messages with their `attempts`."""
    fields = F.from_json("original_payload", "report_id string, payload string, source string")
    return dead.filter(F.col("retries").cast("int") < max_retries).select(
        F.col("original_msg_id").alias("msg_id"),
        fields["report_id"].alias("report_id"),
        fields["payload"].alias("payload"),
        fields["source"].alias("source"),
        F.col("retries").cast("int").alias("attempts"),
    )


def split_batch(batch: DataFrame, grid: HexGrid = GRID) -> tuple[DataFrame, DataFrame]:
    """(valid reports, dead letters) of a batch of messages."""
    message = F.struct(*[c for c in ("msg_id", "report_id", "payload", "source") if c in batch.columns])
    checked = contracts.reports_from_json(batch.withColumn("message", message), grid=grid)
    attempts = F.col("attempts") + 1 if "attempts" in batch.columns else 1
    return contracts.accepted(checked).drop("message", "payload", "msg_id", "attempts"), dead_letters(contracts.rejected(checked), attempts)


def attempt_handler(handler: Callable[[DataFrame, int], None], reports: DataFrame, batch_id: int, max_retries: int) -> None:
    for attempt in range(1, max_retries + 1):
        try:
            handler(reports, batch_id)
            return
        except Exception:
            if attempt == max_retries:
                raise


def redrive_once(
    letters: DataFrame,
    handler: Callable[[DataFrame, int], None],
    dead_letter_path: str,
    round_no: int,
    max_retries: int = MAX_RETRIES,
    grid: HexGrid = GRID,
) -> DataFrame:
    """Try dead letters again (R2); gives back those that fail again, with one retry more.

    Letters tried `max_retries` times are not tried again. A round's letters are written under its number, so a
    repeated round replaces its own. The handler gets the round as a negative batch number.
    """
    spark, path = letters.sparkSession, f"{dead_letter_path}/round={round_no}"
    with temporary_stages(spark):
        reports, dead = split_batch(materialize(redrive(letters, max_retries), "redriven"), grid)
        attempt_handler(handler, reports, -round_no, max_retries)
        dead.write.mode("overwrite").parquet(path)
    return spark.read.schema(DEAD_LETTER_DDL).parquet(path)


def consume(
    stream: DataFrame,
    handler: Callable[[DataFrame, int], None],
    dead_letter_path: str,
    checkpoint: str,
    max_retries: int = MAX_RETRIES,
    grid: HexGrid = GRID,
) -> DataStreamWriter:
    """Stream writer that hands valid reports to `handler` and routes the rest to the dead-letter table.

    A payload that does not parse will not parse on a retry either, so it is routed at once. A handler that
    fails is tried again up to `max_retries` times; then the query fails, nothing is acknowledged and a
    restart takes up the batch. Dead letters are written under the batch id, so a repeated batch replaces its own.
    """

    def process(batch: DataFrame, batch_id: int) -> None:
        with temporary_stages(batch.sparkSession):
            settled = materialize(batch, "micro-batch")
            reports, dead = split_batch(settled, grid)
            dead.write.mode("overwrite").parquet(f"{dead_letter_path}/batch={batch_id}")
            attempt_handler(handler, reports, batch_id, max_retries)

    return stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)


def once_per_id(stream: DataFrame, delay: str = "6 hours") -> DataFrame:
    """Drop re-delivered reports within the watermark (R5); the merge drops those that come later still."""
    return stream.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(["report_id"])
