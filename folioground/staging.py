"""Where jobs cut their lineage: written tables in the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CONF = "spark.checkpoint.dir"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def with_settings(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Session settings that hold within."""
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value is not None else spark.conf.unset(key)


def shuffles_dropped(spark: SparkSession):
    """Within, the shuffle files of a written table go when it is there, not when the driver next collects garbage."""
    return with_settings(spark, {_CLEANUP: "true"})


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder named by the cluster; a scratch folder only for local masters."""
    configured = spark.conf.get(_CONF, None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_CONF} to a shared folder before running on a cluster")
    own = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set(_CONF, own)
    return own


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/folioground/{uuid.uuid4().hex}/{name}"


def stage_table(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once and return it read back, so later passes prune columns from
    parquet and a lost executor never replays the work that made it."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    # Texts and vectors take about two thirds of the room that Spark's default codec leaves them.
    writer = df.write.mode("overwrite").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with shuffles_dropped(spark):
        writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
