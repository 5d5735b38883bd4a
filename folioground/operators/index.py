"""The search index: chunk payloads, postings, vectors, and their upkeep."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from folioground import constants as C
from folioground.functions import text as X
from folioground.staging import stage_table

IN_TEXT, IN_NORMALIZED, IN_HEADING, IN_SCHEME, IN_DEPARTMENT = 1, 2, 4, 8, 16


def version_attributes(documents: DataFrame, versions: DataFrame) -> DataFrame:
    """What the payload says of each version and its document."""
    v = versions.select("version_id", "document_id", "version_number", F.col("status").alias("version_status"),
                        F.col("effective_date").alias("version_date"))
    d = documents.select("document_id", "collection_id", "scheme_name", "department",
                         "state_or_district", "language", F.col("status").alias("document_status"),
                         F.col("effective_date").alias("document_date"))
    return v.join(d, "document_id")


def chunk_payload(chunks: DataFrame, documents: DataFrame, versions: DataFrame,
                  model: str = C.EMBEDDING_MODEL, dim: int = C.EMBEDDING_DIM) -> DataFrame:
    """Chunk rows with every attribute search filters on or shows."""
    # Attributes meet first, among catalog rows; the chunk text then moves once and is not sorted: the rows of the catalog
    # are the side that is held, a few hundred bytes each.
    return payload_rows(chunks.drop("document_id").join(version_attributes(documents, versions).hint("shuffle_hash"), "version_id"), model, dim)


def payload_rows(chunks: DataFrame, model: str = C.EMBEDDING_MODEL, dim: int = C.EMBEDDING_DIM) -> DataFrame:
    """The payload of chunks that have the attributes of their versions."""
    place = X.split_location(F.col("state_or_district"))
    active = (F.col("document_status") == C.ACTIVE) & (F.col("version_status") == C.ACTIVE)
    archived = (F.col("document_status") == C.ARCHIVED) | (F.col("version_status") == C.ARCHIVED)
    # Chunks may come without their search text; its compatible form then stands in for it, made where the text has arrived
    # unless it comes along.
    searched = next((c for c in ("normalized_text", "compat_text") if c in chunks.columns), X.compat_text(F.col("chunk_text")).alias("compat_text"))
    return (
        chunks.select(
            "vector_id", X.namespace(F.col("collection_id")).alias("namespace"), "collection_id",
            "document_id", "version_id", "version_number", "page_number",
            F.coalesce("page_range", F.col("page_number").cast("string")).alias("page_range"),
            "chunk_index", "section_heading", "scheme_name", "department",
            place["state"].alias("state"), place["district"].alias("district"),
            F.coalesce(F.nullif("state_or_district", F.lit("")), F.lit("National")).alias("state_or_district"),
            "language", X.date_text(F.col("version_date"), F.col("document_date")).alias("effective_date"),
            active.alias("active"), archived.alias("is_historical"), "document_status", "version_status",
            F.lit(model).alias("embedding_model"), F.lit(dim).alias("embedding_dimension"),
            _snippet().alias("snippet"), "chunk_text", searched))


def _snippet() -> Column:
    return X.truncate(X.strip(F.coalesce("chunk_text", F.lit(""))), 950)


def stored_texts(payload: DataFrame) -> DataFrame:
    """A payload of chunks without search text, as it is written: each text once."""
    return payload.drop("snippet")


def with_derived_texts(stored: DataFrame) -> DataFrame:
    """What ``stored_texts`` left out, made by built-in expressions for those who read it."""
    return stored.withColumns({"snippet": _snippet(), "normalized_text": X.fold_for_search(F.coalesce("compat_text", "chunk_text"))})


def searchable(payload: DataFrame) -> DataFrame:
    return payload.filter(F.col("document_status") != C.DELETED)


def vector_records(payload: DataFrame, embedder: Callable[[Column], Column]) -> DataFrame:
    """Embed the chunk texts; the vector table keeps only what vector search filters on."""
    return searchable(payload).select(
        "vector_id", "namespace", "collection_id", "version_id", "page_number", "scheme_name",
        "department", "language", "active", "embedding_model",
        embedder(F.col("chunk_text")).alias("values"))


def texts_to_embed(payload: DataFrame) -> DataFrame:
    """``vector_records`` with the text in place of its vector, for searches that embed where they compare."""
    return searchable(payload).select(
        "vector_id", "namespace", "collection_id", "version_id", "page_number", "scheme_name",
        "department", "language", "active", "embedding_model", F.col("chunk_text").alias("text"))


# ---- upkeep ---------------------------------------------------------------------

def incompatible_vectors(vectors: DataFrame, dim: int = C.EMBEDDING_DIM,
                         model: str = C.EMBEDDING_MODEL) -> DataFrame:
    """Vectors of another size or model, with the reason."""
    size = F.size("values")
    reason = (
        F.when(F.col("values").isNotNull() & (size != dim), "DIMENSION_MISMATCH")
        .when(F.nullif("embedding_model", F.lit("")) != model, "MODEL_MISMATCH"))
    return (vectors.select("vector_id", "embedding_model", size.alias("found_dimension"),
                           reason.alias("reason"))
            .filter(F.col("reason").isNotNull()))


def upsert_vectors(existing: DataFrame, incoming: DataFrame, order: str = "seq") -> DataFrame:
    """Last write wins per (namespace, vector_id); within a batch the highest ``order``."""
    key = ["namespace", "vector_id"]
    rest = [c for c in incoming.columns if c not in (*key, order)]
    latest = (incoming.groupBy(*key)
              .agg(F.max_by(F.struct(*rest), F.col(order)).alias("r"))
              .select(*key, "r.*"))
    kept = existing.join(latest.select(*key), key, "left_anti")
    return kept.unionByName(latest.select(*existing.columns))


def delete_vectors(vectors: DataFrame, namespace: str | None = None, ids: DataFrame | None = None,
                   where: dict[str, object] | None = None, delete_all: bool = False) -> DataFrame:
    """What is left after a delete in one namespace: everything, else ids, else equal metadata.

    An empty table of ids is as good as none.
    """
    target = F.col("namespace") == (namespace or C.NAMESPACE_PREFIX)
    if delete_all:
        return vectors.filter(~target)
    if ids is not None and not ids.isEmpty():
        doomed = ids.select("vector_id", F.lit(namespace or C.NAMESPACE_PREFIX).alias("namespace")).distinct()
        return vectors.join(doomed, ["namespace", "vector_id"], "left_anti")
    if where:
        hit = target
        for column, value in where.items():
            hit = hit & F.col(column).eqNullSafe(F.lit(value))
        return vectors.filter(~hit)
    return vectors


def index_chunks(chunks: DataFrame, existing: DataFrame, collection_id: Column,
                 dim: int = C.EMBEDDING_DIM, model: str = C.EMBEDDING_MODEL) -> DataFrame:
    """Chunk rows that may lack id, vector, model or size become vector records and are upserted.

    Raises nothing itself: callers check ``incompatible_vectors`` on the batch first.
    """
    made = X.vector_id(F.col("version_id"), F.coalesce("page_number", F.lit(1)),
                       F.coalesce("chunk_index", F.lit(0)))
    records = chunks.select(
        F.coalesce(F.nullif("vector_id", F.lit("")), made).alias("vector_id"),
        X.namespace(collection_id).alias("namespace"),
        F.coalesce("values", F.array_repeat(F.lit(0.0).cast("float"), dim)).alias("values"),
        F.coalesce("embedding_model", F.lit(model)).alias("embedding_model"),
        F.coalesce("embedding_dimension", F.lit(dim)).alias("embedding_dimension"), "seq")
    return upsert_vectors(existing, records)


def gated_upsert(chunks: DataFrame, existing: DataFrame, collection_id: Column, embedder: Callable[[Column], Column],
                 dim: int = C.EMBEDDING_DIM, model: str = C.EMBEDDING_MODEL) -> tuple[DataFrame, DataFrame]:
    """Vectors after the upsert, and what was refused with the reason.

    ``chunks`` are as in ``index_chunks`` with ``chunk_text`` and ``batch``; a chunk without a vector is embedded. A vector
    of another size or model, or without a place, keeps its whole batch out: its rows are refused for their own
    reason, the others of the batch as ``BATCH_REFUSED``. Both tables come from one written pass, so nothing is embedded twice.
    """
    missing = F.col("version_id").isNull() & F.coalesce(F.col("vector_id") == "", F.lit(True))
    made = X.vector_id(F.col("version_id"), F.coalesce("page_number", F.lit(1)), F.coalesce("chunk_index", F.lit(0)))
    records = chunks.select(
        "batch", "seq", F.when(~missing, F.coalesce(F.nullif("vector_id", F.lit("")), made)).alias("vector_id"), X.namespace(collection_id).alias("namespace"),
        F.when(F.col("values").isNotNull(), F.col("values")).otherwise(embedder(F.coalesce("chunk_text", F.lit("")))).alias("values"),
        F.coalesce("embedding_model", F.lit(model)).alias("embedding_model"), F.coalesce("embedding_dimension", F.lit(dim)).alias("embedding_dimension"),
        F.when(missing, "NO_IDENTITY").alias("reason"))
    reason = (F.when(F.col("reason").isNotNull(), F.col("reason"))
              .when((F.size("values") != dim) | (F.col("embedding_dimension") != dim), "DIMENSION_MISMATCH")
              .when(F.col("embedding_model") != model, "MODEL_MISMATCH"))
    judged = stage_table(records.withColumn("reason", reason), "judged_vectors")
    spoilt = judged.where("reason IS NOT NULL").select("batch").distinct()
    accepted = judged.join(spoilt, "batch", "left_anti").drop("reason", "batch")
    refused = (judged.join(spoilt, "batch", "left_semi")
               .select("batch", "vector_id", "embedding_model", F.size("values").alias("found_dimension"), F.coalesce("reason", F.lit("BATCH_REFUSED")).alias("reason")))
    return upsert_vectors(existing, accepted), refused


def reindex_scope(chunks: DataFrame, documents: DataFrame, versions: DataFrame,
                  collections: DataFrame, collection_id: str | None = None,
                  version_id: str | None = None) -> DataFrame:
    """Payload of what a re-index touches: one version, one collection, or everything active."""
    if version_id is not None:
        return chunk_payload(chunks.filter(F.col("version_id") == version_id), documents, versions)
    live = chunk_payload(chunks, documents.filter(F.col("status") == C.ACTIVE),
                         versions.filter(F.col("status") == C.ACTIVE))
    if collection_id is not None:
        return live.filter(F.col("collection_id") == collection_id)
    return live.join(collections.filter("is_active").select("collection_id"), "collection_id", "left_semi")


def reindex_summary(payload: DataFrame) -> DataFrame:
    """Documents, versions and vectors per collection. Two exact counts in two levels, so a
    collection with most of the rows is counted by many tasks."""
    per_version = payload.groupBy("collection_id", "document_id", "version_id").agg(F.count("*").alias("n"))
    per_document = per_version.groupBy("collection_id", "document_id").agg(
        F.count("*").alias("v"), F.sum("n").alias("n"))
    return per_document.groupBy("collection_id").agg(
        F.count("*").alias("documents_count"), F.sum("v").alias("versions_reindexed"),
        F.sum("n").alias("total_vectors_indexed"))


def purge_versions(vectors: DataFrame, chunks: DataFrame, version_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drop the vectors of some versions and clear ``indexed_at`` of their chunks."""
    wanted = version_ids.select("version_id").distinct()
    doomed = chunks.join(wanted, "version_id", "left_semi").select("vector_id").distinct()
    left = vectors.join(doomed, "vector_id", "left_anti")
    marked = chunks.join(wanted.withColumn("purged", F.lit(True)), "version_id", "left")
    cleared = marked.withColumn(
        "indexed_at", F.when(F.col("purged").isNull(), F.col("indexed_at"))).drop("purged")
    return left, cleared


def index_statistics(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("namespace").agg(
        F.count("*").alias("vectors_count"), F.min(F.size("values")).alias("min_dimension"),
        F.max(F.size("values")).alias("max_dimension"))
