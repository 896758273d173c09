"""Session settings and materialisation in the cluster's shared folder."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """Session for tests and benchmarks on one machine; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("stormweave")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder for materialised stages: `spark.checkpoint.dir`, or a temporary one in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    folder = tempfile.mkdtemp(prefix="spark-stormweave-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


_STAGES: ContextVar[list[str] | None] = ContextVar("stages", default=None)


@contextlib.contextmanager
def temporary_stages(spark: SparkSession) -> Iterator[None]:
    """Delete what `materialize` writes within the block when it ends; for jobs that leave their results in tables."""
    held: list[str] = []
    token = _STAGES.set(held)
    try:
        yield
    finally:
        _STAGES.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path
        for folder in held:
            where = path(folder)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a stage to the shared folder and read it back.

    The written table cuts the lineage, survives the loss of executors, stays columnar for later
    readers and gives Catalyst a measured size to choose joins by.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stormweave/{label}-{uuid.uuid4().hex}"
    if (held := _STAGES.get()) is not None:
        held.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
