"""Ingestion as a state machine: every requested version ends in one outcome, with its job row, statuses and audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folioground import constants as C
from folioground.operators import catalog
from folioground.plans.ingest import ingest
from folioground.staging import stage_table

MAX_ATTEMPTS = 3
BACKOFF_SECONDS = 0.5
#: What each outcome makes of a job, of its version and document, and of the audit log (null: left as it is, or no row).
TRANSITIONS = {
    "unknown": ("FAILED", 100, C.FAILED, "DOC_PROCESS_FAILED"),
    "missing_file": ("FAILED", 100, C.FAILED, "DOC_PROCESS_FAILED"),
    "invalid_file": ("FAILED", 100, C.FAILED, None),
    "exhausted": ("FAILED", 100, C.FAILED, "DOC_PROCESS_FAILED"),
    "retry": ("RUNNING", 45, None, None),
    "done": ("COMPLETED", 100, C.ACTIVE, "DOC_PROCESS_COMPLETED"),
}


def _after(field: int, kind: str) -> Column:
    """A field of the transition of ``outcome``."""
    rule = F.lit(None).cast(kind)
    for name, row in TRANSITIONS.items():
        rule = F.when(F.col("outcome") == name, F.lit(row[field]).cast(kind)).otherwise(rule)
    return rule


def job_outcomes(requests: DataFrame, documents: DataFrame, versions: DataFrame, files: DataFrame,
                 max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """One row for each requested (document_id, version_id): outcome, error, attempt, wait before the next, job_seq.

    ``requests``: document_id, version_id, storage_key, job_seq, and optionally attempt (1 where null) and read_error, a
    passing fault that the reader met. ``files``: storage_key and reason, null for a sound file (``header_reason`` over
    ``scan_blobs``); a key without a row is a missing file. Of several requests for one version the one with the highest
    (job_seq, attempt, storage_key) counts. A null key is a missing file; null or unmatched ids are an unknown document or version.
    """
    opt = lambda name, kind: F.col(name) if name in requests.columns else F.lit(None).cast(kind)
    order = F.struct("job_seq", F.coalesce(opt("attempt", "int"), F.lit(1)).alias("attempt"), "storage_key", opt("read_error", "string").alias("read_error"))
    last = requests.groupBy("document_id", "version_id").agg(F.max(order).alias("r")).select("document_id", "version_id", "r.*")
    known_document = documents.select("document_id", F.lit(True).alias("has_document")).distinct()
    known_version = versions.select("version_id", F.lit(True).alias("has_version")).distinct()
    # A file that several rows describe is sound only if all of them say so.
    held = files.groupBy("storage_key").agg(F.min("reason").alias("reason"), F.lit(True).alias("has_file"))
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("None"))
    outcome = (
        F.when(F.col("has_document").isNull() | F.col("has_version").isNull(), "unknown").when(F.col("has_file").isNull(), "missing_file")
        .when(F.col("read_error").isNotNull() & (F.col("attempt") < max_attempts), "retry").when(F.col("read_error").isNotNull(), "exhausted")
        .when(F.col("reason").isNotNull(), "invalid_file").otherwise("done"))
    error = (
        F.when(F.col("outcome") == "unknown", F.concat(F.lit("Document "), text("document_id"), F.lit(" or Version "), text("version_id"), F.lit(" not found in database.")))
        .when(F.col("outcome") == "missing_file", F.concat(F.lit("Document file missing in storage: "), text("storage_key")))
        .when(F.col("outcome") == "exhausted", F.concat(F.lit(f"Document processing failed after {max_attempts} attempts: "), "read_error"))
        .when(F.col("outcome") == "retry", F.col("read_error")).when(F.col("outcome") == "invalid_file", F.col("reason")))
    wait = F.when(F.col("outcome") == "retry", F.lit(BACKOFF_SECONDS) * F.pow(F.lit(2.0), F.col("attempt") - 1))
    return (
        last.join(known_document, "document_id", "left").join(known_version, "version_id", "left").join(held, "storage_key", "left")
        .withColumn("outcome", outcome)
        .select("document_id", "version_id", "storage_key", "outcome", error.alias("error_message"), "attempt", wait.alias("retry_after_seconds"), "job_seq"))


def job_rows(outcomes: DataFrame, jobs: DataFrame, summaries: DataFrame) -> DataFrame:
    """The job rows a run changes: the newest job of each version goes on, a version without one gets a job.

    An unknown document or version gets no new job. ``jobs``: job_id, document_id, version_id, created_seq. ``summaries``:
    version_id and summary_json of the versions that are done. Jobs of other versions are not read beyond their keys.
    """
    touched = jobs.join(outcomes.select("document_id", "version_id"), ["document_id", "version_id"], "left_semi")
    held = catalog.latest_jobs(touched.select("document_id", "version_id", "job_id", "created_seq"), "document_id", "version_id")
    made = F.concat_ws("-", F.lit("job"), "version_id", F.col("job_seq").cast("string"))
    return (
        outcomes.join(held, ["document_id", "version_id"], "left").join(summaries, "version_id", "left")
        .filter((F.col("outcome") != "unknown") | F.col("job_id").isNotNull())
        .select(F.coalesce("job_id", made).alias("job_id"), "document_id", "version_id", _after(0, "string").alias("status"),
                _after(1, "int").alias("progress_percent"), F.coalesce("created_seq", "job_seq").alias("created_seq"), "error_message",
                F.when(F.col("outcome") == "done", F.col("summary_json")).alias("summary_json")))


def _with_status(rows: DataFrame, key: str, decided: DataFrame) -> DataFrame:
    """Rows with the status that ``decided`` (key, new_status, ...) gives; all others as they were."""
    return rows.join(decided, key, "left").withColumn("status", F.coalesce("new_status", "status")).drop("new_status")


def run_jobs(requests: DataFrame, documents: DataFrame, versions: DataFrame, jobs: DataFrame, files: DataFrame,
             readings: DataFrame, max_attempts: int = MAX_ATTEMPTS, **options) -> dict[str, DataFrame]:
    """All tables of an ingestion run that may fail for some versions; the caller writes them.

    The outcomes are written once and route everything else: only readings of versions that are done are cleaned,
    chunked and embedded (``options`` as of ``ingest``), failed versions keep the pages they had. A document takes the
    status of its request with the highest job_seq, of equal ones the larger version id. Versions get ``error_message``.
    """
    outcomes = stage_table(job_outcomes(requests, documents, versions, files, max_attempts), "job_outcomes")
    done = outcomes.filter("outcome = 'done'")
    out = ingest(readings.join(done.select("version_id"), "version_id", "left_semi"), documents, versions, **options)
    counts = stage_table(done.select("document_id", "version_id", "attempt").join(out["summary"], "version_id", "left"), "job_counts")
    zero = lambda c, name: F.coalesce(c, F.lit(0)).cast("bigint").alias(name)
    # No version's page is lost silently: a sound file without a single reading counts zero pages.
    summary = F.to_json(F.struct(
        zero("n_pages", "total_pages"), zero("n_native", "native_text_pages"), zero("n_ocr", "ocr_pages"), zero("n_failed", "failed_pages"),
        zero("n_low", "low_confidence_pages"), zero("n_scanned", "scanned_pages"), zero("chunks_count", "chunks_count"), F.col("attempt").alias("execution_attempts")))
    summaries = counts.select("version_id", summary.alias("summary_json"))
    status = _after(2, "string")
    decided = outcomes.filter("outcome <> 'retry'").groupBy("version_id").agg(
        F.max_by(F.struct(status.alias("new_status"), F.col("error_message").alias("found_error")), "job_seq").alias("d")).select("version_id", "d.*")
    old_error = F.col("error_message") if "error_message" in versions.columns else F.lit(None).cast("string")
    error = F.when(F.col("new_status").isNotNull(), F.col("found_error")).otherwise(old_error)
    totals = counts.select("version_id", F.coalesce("n_pages", F.lit(0)).cast("int").alias("found_pages"))
    new_versions = (
        versions.join(decided, "version_id", "left").withColumn("error_message", error).drop("found_error")
        .withColumn("status", F.coalesce("new_status", "status")).drop("new_status").join(totals, "version_id", "left")
        .withColumn("total_pages", F.coalesce("found_pages", "total_pages")).drop("found_pages"))
    by_document = outcomes.filter("outcome <> 'retry'").groupBy("document_id").agg(
        F.max_by(status, F.struct("job_seq", "version_id")).alias("new_status"))
    noted = outcomes.join(summaries, "version_id", "left").withColumn("action", _after(3, "string")).filter("action is not null")
    audit = noted.select("action", F.lit("documents").alias("entity_type"), F.col("document_id").cast("string").alias("entity_id"),
                         F.when(F.col("outcome") == "done", F.col("summary_json")).otherwise(F.to_json(F.struct(F.col("error_message").alias("error")))).alias("details"))
    return out | {"outcomes": outcomes, "jobs": job_rows(outcomes, jobs, summaries), "versions": new_versions,
                  "documents": _with_status(documents, "document_id", by_document), "audit": audit}
