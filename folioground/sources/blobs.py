"""Stored files as a distributed source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

PDF_HEADER = "%PDF-"


def scan_blobs(spark: SparkSession, root: str, pattern: str = "*.pdf") -> DataFrame:
    return (spark.read.format("binaryFile").option("pathGlobFilter", pattern)
            .option("recursiveFileLookup", True).load(root))


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def header_reason(content: Column) -> Column:
    """Why a file cannot be a PDF, else null."""
    return (
        F.when(content.isNull() | (F.length(content) == 0), "File is empty (0 bytes).")
        .when(F.substring(content, 1, 5) != F.lit(PDF_HEADER).cast("binary"),
              "Invalid PDF file: Missing '%PDF-' header signature."))
