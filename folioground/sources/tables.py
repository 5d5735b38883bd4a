"""Reading and writing the engine's tables: fixed schemas, idempotent writes, append logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from folioground import constants as C, schemas
from folioground.functions import text as X


def scan(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table with its declared schema; columns and filters reach the files."""
    return spark.read.schema(schemas.TABLES[table]).parquet(path)


def replace_rows(existing: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``existing`` under any incoming key make way for the incoming rows."""
    return existing.join(incoming.select(*key).distinct(), key, "left_anti").unionByName(incoming)


def overwrite_buckets(incoming: DataFrame, path: str, key: str, buckets: int = 64) -> None:
    """Rewrite only the key buckets the batch touches; running it twice changes nothing.

    The buckets it touches, at most ``buckets`` numbers, become a partition filter, so the others stay unread
    and unwritten. The kept rows are staged before the overwrite, which may then be retried.
    """
    from folioground.staging import stage_table
    spark = incoming.sparkSession
    bucketed = stage_table(incoming.withColumn("bucket", bucket_of(key, buckets)), "incoming")
    merged = bucketed
    if has_files(spark, path):
        held = stored_under(bucketed, path)
        merged = stage_table(replace_rows(held, bucketed.select(*held.columns), [key]), "replaced")
    (merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("bucket").parquet(path))


def bucket_of(key: str, buckets: int = 64) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def stored_under(bucketed: DataFrame, path: str) -> DataFrame:
    """Rows of a bucketed table in the buckets that ``bucketed`` has rows in; no others are read."""
    touched = [r[0] for r in bucketed.select("bucket").distinct().collect()]  # at most as many as there are buckets
    return bucketed.sparkSession.read.parquet(path).filter(F.col("bucket").isin(touched))


def has_files(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p)


def insert_if_absent(existing: DataFrame, incoming: DataFrame, key: list[str], order: str) -> DataFrame:
    """Keep what is there; add incoming keys not there yet, the first one of a batch."""
    rest = [c for c in incoming.columns if c not in (*key, order)]
    first = incoming.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("r")).select(*key, "r.*")
    return existing.unionByName(first.select(*existing.columns).join(existing.select(*key), key, "left_anti"))


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def upsert_sessions(existing: DataFrame, asked: DataFrame) -> DataFrame:
    """One session per token: the first question with the token creates it."""
    first = asked.groupBy("session_token").agg(
        F.min("asked_at").alias("created_at"), F.min_by("collection_id", "asked_at").alias("collection_id"))
    new = first.join(existing.select("session_token"), "session_token", "left_anti")
    return existing.unionByName(new.select(*existing.columns))


def persisted_citations(answers: DataFrame, citations: DataFrame, documents: DataFrame) -> DataFrame:
    """Citations of logged answers whose document is in the catalog."""
    return (citations.join(answers.select("query_id", "qa_id"), "query_id")
            .join(documents.select("document_id"), "document_id", "left_semi"))


def upload_verdicts(uploads: DataFrame, collections: DataFrame, limit: int = C.MAX_UPLOAD_BYTES) -> DataFrame:
    """Every upload with the first reason against it; rejected uploads stay as rows."""
    known = collections.select("collection_id", F.lit(True).alias("known"))
    size = F.col("file_size_bytes")
    reason = (
        F.when(~X.strip(F.lower("filename")).endswith(".pdf"), "INVALID_EXTENSION")
        .when(size > limit, "FILE_TOO_LARGE").when(size == 0, "FILE_EMPTY")
        .when(~F.col("is_official_source_confirmed"), "SOURCE_NOT_CONFIRMED")
        .when(F.col("known").isNull(), "COLLECTION_NOT_FOUND"))
    return (uploads.join(known, "collection_id", "left")
            .select("upload_id", "filename", size, "collection_id", reason.isNull().alias("accepted"), reason.alias("reason")))


def decode_payload(encoded: Column) -> Column:
    """Base64 text to bytes; null where it is not base64."""
    return F.try_to_binary(encoded, F.lit("base64"))


def typed_metadata(rows: DataFrame) -> DataFrame:
    """Key and value rows with one column per type, null where the value does not fit."""
    v, kind = F.col("meta_value"), F.col("data_type")
    return rows.select(
        "document_id", "meta_key", "data_type",
        F.when(kind == "integer", v.try_cast("bigint")).alias("int_value"),
        F.when(kind == "date", v.try_cast("date")).alias("date_value"),
        F.when(kind == "boolean", v.try_cast("boolean")).alias("bool_value"),
        F.when(kind == "json", F.when(F.try_parse_json(v).isNotNull(), v)).alias("json_value"),
        F.when(kind == "string", v).alias("text_value"))
