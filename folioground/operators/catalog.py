"""Versions, duplicates, listings and lifecycle of documents and collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folioground import constants as C
from folioground.functions import access as A, text as X

SALTS = 16


def duplicate_warnings(documents: DataFrame, salts: int = SALTS) -> DataFrame:
    """Documents whose content an earlier, not deleted document already holds.

    The earliest holder per hash is found by a combining aggregation; only hashes held twice go
    into the join, spread over salted keys since one text may have a third of all copies.
    """
    live = documents.filter(F.col("status") != C.DELETED)
    held = (live.groupBy("file_hash")
            .agg(F.min(F.struct("document_id", "scheme_name")).alias("first"), F.count("*").alias("copies"))
            .filter("copies > 1").select("file_hash", "first.*", "copies")
            .toDF("file_hash", "original_id", "original_scheme", "copies")
            .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))))
    warning = F.format_string(
        "Duplicate warning: An existing document '%s' (ID: %s) shares the identical content hash.",
        "original_scheme", F.col("original_id").cast("string"))
    return (
        live.withColumn("salt", F.pmod(F.xxhash64("document_id"), F.lit(salts)).cast("int"))
        .join(held, ["file_hash", "salt"]).filter(F.col("document_id") != F.col("original_id"))
        .select("document_id", "file_hash", "original_id", "copies", warning.alias("duplicate_warning")))


def latest_versions(versions: DataFrame) -> DataFrame:
    """Newest version of each document, combined before the shuffle."""
    rest = [c for c in versions.columns if c != "document_id"]
    return (versions.groupBy("document_id")
            .agg(F.max_by(F.struct(*rest), "version_number").alias("v")).select("document_id", "v.*"))


def list_documents(documents: DataFrame, versions: DataFrame, include_archived: bool = False,
                   collection_id: str | None = None) -> DataFrame:
    shown = documents.filter(F.col("status") != C.DELETED)
    if not include_archived:
        shown = shown.filter(F.col("status") != C.ARCHIVED)
    if collection_id:
        shown = shown.filter(F.col("collection_id") == collection_id)
    newest = latest_versions(versions.select("document_id", "version_number", "total_pages", "file_size_bytes"))
    d = shown.select("document_id", "collection_id", F.col("scheme_name").alias("title"), "department",
                     "state_or_district", F.coalesce("language", F.lit("en")).alias("language"), "status", "file_hash",
                     F.col("version_number").alias("own_version"))
    known = F.col("version_number").isNotNull()
    return d.join(newest, "document_id", "left").select(
        *[c for c in d.columns if c != "own_version"],
        F.coalesce("version_number", "own_version").alias("current_version"),
        F.when(known, F.col("total_pages")).otherwise(1).alias("total_pages"),
        F.when(known, F.col("file_size_bytes")).otherwise(0).alias("file_size_bytes"))


def version_history(versions: DataFrame, documents: DataFrame) -> DataFrame:
    """Versions of the asked documents, newest first: a range sort, so a long history is split."""
    return (versions.join(documents.select("document_id").distinct(), "document_id", "left_semi")
            .orderBy("document_id", F.desc("version_number")))


def list_collections(collections: DataFrame, documents: DataFrame, departments: DataFrame) -> DataFrame:
    """Active collections with document counts, a row per kind of viewer who may list them.

    Viewers are the fixed roles, ANONYMOUS, and OWNER for private collections, so the listing of a
    user is the rows of the user's role plus the OWNER rows with that owner. Its size follows the
    collections, never users times collections.
    """
    counts = (documents.filter(F.col("status") != C.DELETED).groupBy("collection_id")
              .agg(F.count("*").alias("n")))
    listing = [r for r, perms in C.ROLE_PERMISSIONS.items() if set(perms) & set(C.LISTING_ACCESS)]
    viewers = F.when(F.col("is_private"), A.text_array([*listing, "OWNER"])).otherwise(
        A.text_array([*C.ROLE_PERMISSIONS, "ANONYMOUS"]))
    return (
        collections.filter("is_active").join(counts, "collection_id", "left")
        .join(departments.select("department_id", F.col("department_name").alias("department")), "department_id", "left")
        .select(F.explode(viewers).alias("viewer"), "collection_id", "name", "slug", "department", "is_private",
                "owner_user_id", F.coalesce("n", F.lit(0)).alias("total_documents")))


def conflict_members(documents: DataFrame, collection_id: str | None = None, salts: int = SALTS) -> DataFrame:
    """Active documents that share collection and scheme with another one: a row per document.

    The whole result stays in rows, however many documents one scheme has.
    """
    active = documents.filter(F.col("status") == C.ACTIVE)
    if collection_id:
        active = active.filter(F.col("collection_id") == collection_id)
    key = ["collection_id", "scheme_key"]
    keyed = active.withColumn("scheme_key", X.strip(F.lower("scheme_name")))
    groups = (keyed.groupBy(*key).agg(F.count("*").alias("active_documents")).filter("active_documents > 1")
              .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))))
    return (keyed.withColumn("salt", F.pmod(F.xxhash64("document_id"), F.lit(salts)).cast("int"))
            .join(groups, [*key, "salt"]).select(*key, "active_documents", "document_id", "version_number"))


def conflict_warnings(documents: DataFrame, collection_id: str | None = None) -> DataFrame:
    """One warning per conflicting group, with its count. The documents and versions it is about are the rows
    of ``conflict_members``, however many they are."""
    active = documents.filter(F.col("status") == C.ACTIVE)
    if collection_id:
        active = active.filter(F.col("collection_id") == collection_id)
    groups = active.groupBy("collection_id", X.strip(F.lower("scheme_name")).alias("scheme_key")).agg(
        F.count("*").alias("active_documents"), F.min(F.struct("document_id", "scheme_name")).alias("first")).filter("active_documents > 1")
    message = F.concat(
        F.lit("Warning: "), F.col("active_documents").cast("string"), F.lit(" active documents appear to cover scheme '"),
        "first.scheme_name", F.lit("' in the same collection. Consider archiving the superseded version to prevent ambiguous citations."))
    return groups.select("collection_id", F.col("first.scheme_name").alias("scheme_name"), "active_documents", message.alias("message"))


def add_versions(documents: DataFrame, versions: DataFrame, incoming: DataFrame) -> dict[str, DataFrame]:
    """New versions of known documents: repeated numbers are rejected, newer ones move the document.

    ``incoming``: version_id, document_id, version_number, file_hash, file_size_bytes, effective_date, seq.
    """
    key = ["document_id", "version_number"]
    known = incoming.join(documents.select("document_id", F.col("effective_date").alias("own_date")), "document_id", "left")
    rest = [c for c in known.columns if c not in key]
    first = known.groupBy(*key).agg(F.min_by(F.struct(*rest), "seq").alias("r")).select(*key, "r.*")
    taken = versions.select(*key).distinct().withColumn("exists", F.lit(True))
    judged = (
        known.join(first.select("version_id", "seq").withColumn("is_first", F.lit(True)), ["version_id", "seq"], "left")
        .join(taken, key, "left").join(documents.select("document_id").withColumn("has_document", F.lit(True)), "document_id", "left")
        .withColumn("reason", F.when(F.col("has_document").isNull(), "DOCUMENT_NOT_FOUND")
                    .when(F.col("exists") | F.col("is_first").isNull(), "VERSION_EXISTS")))
    accepted = judged.filter(F.col("reason").isNull()).select(
        "version_id", *key, "file_hash", "file_size_bytes",
        F.lit(1).alias("total_pages"), F.lit(C.ACTIVE).alias("status"),
        F.coalesce("effective_date", "own_date").alias("effective_date"))
    newest = (accepted.groupBy("document_id")
              .agg(F.max_by(F.struct("version_number", "file_hash", "effective_date"), "version_number").alias("n")))
    newer = F.coalesce(F.col("n.version_number") > F.col("version_number"), F.lit(False))
    promoted = documents.join(newest, "document_id", "left")
    for c in ("file_hash", "effective_date", "version_number"):
        promoted = promoted.withColumn("new_" + c, F.when(newer, F.col("n." + c)).otherwise(F.col(c)))
    promoted = promoted.drop("n", "file_hash", "effective_date", "version_number").withColumnsRenamed(
        {"new_" + c: c for c in ("file_hash", "effective_date", "version_number")}).select(*documents.columns)
    return {"versions": versions.unionByName(accepted.select(*versions.columns)), "documents": promoted,
            "accepted": accepted, "rejected": judged.filter(F.col("reason").isNotNull()).select("version_id", *key, "reason"),
            "audit": audit_rows(accepted, "DOC_VERSION_CREATED", "document_versions", "version_id")}


def audit_rows(rows: DataFrame, action: Column | str, table: str, entity: str, *details: str) -> DataFrame:
    """Append-only audit records of a change."""
    act = F.lit(action) if isinstance(action, str) else action
    noted = [F.col(c) for c in details] or [F.col(entity)]
    return rows.select(act.alias("action"), F.lit(table).alias("entity_type"),
                       F.col(entity).cast("string").alias("entity_id"), F.to_json(F.struct(*noted)).alias("details"))


def audit_records(audit: DataFrame, user_id: Column, created_at: Column) -> DataFrame:
    """Audit rows as the log declares them: who did it, and when."""
    return audit.select(user_id.cast("string").alias("user_id"), "action", "entity_type", "entity_id", "details", created_at.cast("timestamp_ntz").alias("created_at"))


def change_status(documents: DataFrame, versions: DataFrame, actions: DataFrame) -> dict[str, DataFrame]:
    """Archive, restore or delete documents; archive and restore reach all versions.

    ``actions``: document_id, action in ARCHIVE / RESTORE / DELETE, one row per document.
    """
    status = (F.when(F.col("action") == "ARCHIVE", C.ARCHIVED).when(F.col("action") == "RESTORE", C.ACTIVE)
              .when(F.col("action") == "DELETE", C.DELETED))
    wanted = actions.select("document_id", "action", status.alias("to_status"))
    touched = documents.join(wanted, "document_id", "left")
    moved = touched.withColumn("previous_status", F.col("status")).withColumn(
        "status", F.coalesce("to_status", "status"))
    changed = moved.filter(F.col("to_status").isNotNull())
    cascade = F.when(F.col("action") != "DELETE", F.col("to_status"))
    reached = versions.join(wanted, "document_id", "left").withColumn(
        "status", F.coalesce(cascade, F.col("status"))).select(*versions.columns)
    name = (F.when(F.col("action") == "ARCHIVE", "DOC_ARCHIVE").when(F.col("action") == "RESTORE", "DOC_RESTORE")
            .otherwise("DOC_DELETE"))
    return {"documents": moved.select(*documents.columns), "versions": reached,
            "audit": audit_rows(changed, name, "documents", "document_id", "scheme_name", "previous_status", "status")}


def deactivate_collections(collections: DataFrame, ids: DataFrame) -> dict[str, DataFrame]:
    gone = collections.join(ids.select("collection_id").distinct().withColumn("gone", F.lit(True)), "collection_id", "left")
    after = gone.withColumn("is_active", F.when(F.col("gone"), F.lit(False)).otherwise(F.col("is_active")))
    return {"collections": after.select(*collections.columns),
            "audit": audit_rows(after.filter("gone"), "COLLECTION_DELETED", "document_collections", "collection_id", "name", "slug")}


def create_collections(collections: DataFrame, incoming: DataFrame) -> DataFrame:
    """Accepted new collections: slugs already in use, or repeated in the batch, are left out."""
    rest = [c for c in incoming.columns if c != "slug"]
    first = incoming.groupBy("slug").agg(F.min_by(F.struct(*rest), "seq").alias("r")).select("slug", "r.*")
    return first.join(collections.select("slug"), "slug", "left_anti")


def page_previews(requests: DataFrame, pages: DataFrame) -> DataFrame:
    """Asked pages with their text, or a stand-in row while a page is missing.

    ``pages``: document_id, page_number, raw_text and the reading columns; the smallest version wins.
    """
    key = ["document_id", "page_number"]
    wanted = requests.select(*key).distinct()
    rest = [c for c in pages.columns if c not in key]
    held = (pages.join(wanted, key, "left_semi").groupBy(*key)
            .agg(F.min(F.struct("version_id", *[c for c in rest if c != "version_id"])).alias("p")))
    missing = F.col("p").isNull()
    return requests.join(held, key, "left").select(
        *requests.columns,
        F.when(missing, F.concat(F.lit("Official scheme circular excerpt from page "), F.col("page_number").cast("string"), F.lit(".")))
        .otherwise(X.truncate(F.col("p.raw_text"), 1000, "")).alias("text_preview"),
        F.coalesce("p.extraction_method", F.lit("NATIVE")).alias("extraction_method"),
        F.coalesce("p.word_count", F.lit(0)).alias("word_count"), missing.alias("is_stand_in"))


def page_counts(pages: DataFrame, key: str = "document_id") -> DataFrame:
    method = F.coalesce("extraction_method", F.lit("NATIVE"))
    return pages.groupBy(key).agg(
        F.count("*").alias("n_pages"), F.count_if(method == "NATIVE").alias("n_native"),
        F.count_if(method.isin("OCR", "HYBRID")).alias("n_ocr"), F.count_if(method == "FAILED").alias("n_failed"),
        F.count_if(F.coalesce("requires_review", F.lit(False))).alias("n_low"),
        F.count_if(F.coalesce("is_scanned", F.lit(False))).alias("n_scanned"))


def latest_jobs(jobs: DataFrame, *key: str) -> DataFrame:
    rest = [c for c in jobs.columns if c not in key]
    return jobs.groupBy(*key).agg(F.max_by(F.struct(*rest), "created_seq").alias("j")).select(*key, "j.*")


def processing_summary(documents: DataFrame, jobs: DataFrame, pages: DataFrame) -> DataFrame:
    """Latest job of each document with its recorded counts, else counts from the pages."""
    j = latest_jobs(jobs, "document_id").select(
        "document_id", "job_id", F.col("status").alias("job_status"), "progress_percent",
        F.from_json("summary_json", "total_pages bigint, native_text_pages bigint, ocr_pages bigint, "
                    "failed_pages bigint, low_confidence_pages bigint, scanned_pages bigint").alias("s"))
    d = documents.select("document_id", "status").join(page_counts(pages), "document_id", "left").join(j, "document_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    or_one = lambda c: F.greatest(zero(c), F.lit(1).cast("bigint"))
    direct = F.col("job_id").isNull()
    native = F.when(direct, or_one("n_native")).otherwise(zero("n_native"))
    return d.select(
        "document_id", F.coalesce("job_id", F.lit("job-direct")).alias("job_id"), F.coalesce("job_status", "status").alias("status"),
        F.when(direct, F.when(F.col("status") == C.ACTIVE, 100).otherwise(0)).otherwise(F.col("progress_percent")).alias("progress_percent"),
        F.coalesce("s.total_pages", or_one("n_pages")).alias("total_pages"),
        F.coalesce("s.native_text_pages", native).alias("native_text_pages"),
        F.coalesce("s.ocr_pages", zero("n_ocr")).alias("ocr_pages"),
        F.coalesce("s.failed_pages", F.lit(0)).cast("bigint").alias("failed_pages"),
        F.coalesce("s.low_confidence_pages", zero("n_low")).alias("low_confidence_pages"),
        F.coalesce("s.scanned_pages", zero("n_scanned")).alias("scanned_pages"))
