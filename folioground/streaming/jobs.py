"""Structured Streaming forms: ingestion, windowed audit counts, sessions, duplicate drop."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from folioground.operators import chunking as K
from folioground.sources.tables import bucket_of, has_files, overwrite_buckets, replace_rows, stored_under
from folioground.staging import stage_table


def read_files(spark: SparkSession, folder: str, schema: StructType, pattern: str = "*.parquet",
               files_per_batch: int = 1000) -> DataFrame:
    return (spark.readStream.schema(schema).option("pathGlobFilter", pattern)
            .option("maxFilesPerTrigger", files_per_batch).parquet(folder))


def read_table(spark: SparkSession, folder: str, schema: StructType, table: str, files_per_batch: int = 1000) -> DataFrame:
    """The files of one table as a stream, whether the table is one file or a folder of files."""
    # A stream takes a single file only by a pattern.
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
            .parquet(f"{folder}/{table}.parque[t]"))


def ingest_stream(pages: DataFrame, chunk_path: str, vector_path: str, checkpoint: str,
                  embedder: Callable[[Column], Column], page_path: str | None = None) -> StreamingQuery:
    """Pages arriving in files become chunks and vectors.

    A batch stores its pages, each in the place of an earlier reading of it, and makes the chunks of the versions
    it touches from all their stored pages. So a version may arrive in any number of files and batches, and a
    batch replayed after a lost driver leaves the tables as they were.
    """
    page_path = page_path or f"{chunk_path.rstrip('/')}_pages"

    def batch(rows: DataFrame, _: int) -> None:
        arrived = stage_table(rows.withColumn("bucket", bucket_of("version_id")), "arrived")
        versions = arrived.select("version_id").distinct()
        if has_files(rows.sparkSession, page_path):
            held = stored_under(arrived, page_path).join(versions, "version_id", "left_semi").select(*arrived.columns)
            arrived = replace_rows(held, arrived, ["version_id", "page_number"])
        whole = stage_table(arrived.select(*rows.columns), "whole_versions")
        overwrite_buckets(whole, page_path, "version_id")
        chunks = stage_table(K.chunk_documents(whole), "made_chunks")
        overwrite_buckets(chunks, chunk_path, "version_id")
        overwrite_buckets(chunks.select("vector_id", "version_id", embedder(F.col("chunk_text")).alias("values")),
                          vector_path, "version_id")

    return (pages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def daily_action_counts(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events per action and day; in a stream, rows later than the watermark are dropped."""
    return (events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "action")
            .agg(F.count("*").alias("n_events"))
            .select(F.col("w.start").alias("day"), "action", "n_events"))


def search_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of a user's events with no pause of ``gap`` or more."""
    return (events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "user_id")
            .agg(F.count("*").alias("n_events"))
            .select("user_id", F.col("s.start").alias("session_start"), "n_events"))


def first_copies(uploads: DataFrame, late: str = "1 day") -> DataFrame:
    """First row of each content hash; in a stream, state is kept for the watermark only."""
    if uploads.isStreaming:
        return uploads.withWatermark("ts", late).dropDuplicatesWithinWatermark(["file_hash"])
    rest = [c for c in uploads.columns if c != "file_hash"]
    return (uploads.groupBy("file_hash").agg(F.min_by(F.struct(*rest), F.struct("ts", "upload_id")).alias("r"))
            .select("file_hash", "r.*"))


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now into a parquet table and read it back."""
    spark = stream.sparkSession
    (stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint)
     .option("path", path).trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(stream.schema).parquet(path)
