"""Ingestion: page readings to pages, chunks, payload and vectors, with status and audit rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from folioground import constants as C
from folioground.functions import text as X, vectors as VX
from folioground.operators import catalog, chunking as K, index as I
from folioground.staging import stage_table


def process_pages(readings: DataFrame) -> DataFrame:
    """Canonical text and flags per page from native text and an optional OCR reading.

    ``readings``: version_id, document_id, page_number, native_text, ocr_text and optionally
    ocr_confidence, requires_review, review_reason. OCR counts only on scanned pages.
    """
    have = readings.columns
    opt = lambda name, kind: (F.col(name) if name in have else F.lit(None).cast(kind))
    scanned = X.is_scanned(F.col("native"))
    on_scan = lambda c: F.when(F.col("is_scanned"), c)
    return (
        readings.withColumn("native", X.clean_structure(F.coalesce("native_text", F.lit(""))))
        .withColumn("is_scanned", scanned)
        .withColumn("ocr", X.clean_structure(F.coalesce(on_scan(F.col("ocr_text")), F.lit(""))))
        .withColumn("merged", X.merge_clean_texts(F.col("native"), F.col("ocr")))
        .select("version_id", "document_id", "page_number", F.col("merged.raw_text").alias("raw_text"),
                F.nullif("native", F.lit("")).alias("native_text"), on_scan(F.col("ocr_text")).alias("ocr_text"),
                F.col("merged.extraction_method").alias("extraction_method"),
                on_scan(opt("ocr_confidence", "double")).alias("ocr_confidence"), "is_scanned",
                F.coalesce(on_scan(opt("requires_review", "boolean")), F.lit(False)).alias("requires_review"),
                on_scan(opt("review_reason", "string")).alias("review_reason"),
                X.word_count(F.col("merged.raw_text")).alias("word_count")))


def mark_failed_pages(pages: DataFrame, failures: DataFrame) -> DataFrame:
    """Pages that could not be chunked become FAILED rows for review."""
    bad = failures.select("version_id", "page_number", "error", F.col("chunk_text").alias("note"))
    failed = F.col("error").isNotNull()
    return (
        pages.join(bad, ["version_id", "page_number"], "left")
        .withColumn("raw_text", F.when(failed, F.col("note")).otherwise(F.col("raw_text")))
        .withColumn("extraction_method", F.when(failed, "FAILED").otherwise(F.col("extraction_method")))
        .withColumn("requires_review", failed | F.col("requires_review"))
        .withColumn("review_reason", F.coalesce("error", "review_reason"))
        .withColumn("word_count", F.when(failed, 0).otherwise(F.col("word_count")))
        .drop("error", "note"))


def ingest(readings: DataFrame, documents: DataFrame, versions: DataFrame,
           embedder: Callable[[Column], Column] | None = None, max_words: int = C.CHUNK_MAX_WORDS,
           overlap: int = C.CHUNK_OVERLAP_WORDS, pack=K.pack_page) -> dict[str, DataFrame]:
    """All tables a run of ingestion produces; the caller writes them.

    Page text is packed once into a staged table; chunk rows then move once, to their numbers.
    """
    merged = process_pages(readings)
    local = stage_table(K.chunk_pages(merged, max_words, overlap, pack), "ingest_chunks")
    pages = mark_failed_pages(merged, local.filter(F.col("error").isNotNull()))
    chunks = K.describe_chunks(K.number_chunks(local.filter(F.col("error").isNull())))
    done = (
        catalog.page_counts(pages, "version_id")
        .join(local.filter(F.col("error").isNull()).groupBy("version_id").agg(F.count("*").alias("chunks_count")),
              "version_id", "left").withColumn("chunks_count", F.coalesce("chunks_count", F.lit(0))))
    ready = versions.join(done.select("version_id", F.col("n_pages").cast("int").alias("found_pages")), "version_id", "left")
    new_versions = ready.withColumn(
        "status", F.when(F.col("found_pages").isNotNull(), C.ACTIVE).otherwise(F.col("status"))).withColumn(
        "total_pages", F.coalesce("found_pages", "total_pages")).select(*versions.columns)
    processed = versions.join(done.select("version_id"), "version_id", "left_semi").select("document_id").distinct()
    new_documents = documents.join(processed.withColumn("processed", F.lit(True)), "document_id", "left").withColumn(
        "status", F.when(F.col("processed"), C.ACTIVE).otherwise(F.col("status"))).select(*documents.columns)
    payload = I.chunk_payload(chunks, new_documents, new_versions)
    out = {"pages": pages, "chunks": chunks, "summary": done, "payload": payload,
           "versions": new_versions, "documents": new_documents,
           "audit": catalog.audit_rows(done, "DOC_PROCESS_COMPLETED", "versions", "version_id",
                                       "n_pages", "n_native", "n_ocr", "n_failed", "chunks_count")}
    if embedder is not None:
        out["vectors"] = I.vector_records(payload, embedder)
    return out


def reprocess(selected: DataFrame, readings: DataFrame, documents: DataFrame, versions: DataFrame,
              **options) -> dict[str, DataFrame]:
    """Ingest the newest version of the selected documents again."""
    newest = catalog.latest_versions(versions.join(selected.select("document_id").distinct(), "document_id", "left_semi"))
    again = readings.join(newest.select("version_id"), "version_id", "left_semi")
    return ingest(again, documents, versions, **options)


def default_embedder(dim: int = C.EMBEDDING_DIM):
    return VX.hashing_embedder(dim)
