"""From a table of questions to citations and grounded, validated answers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from folioground import constants as C
from folioground.functions import access as A, text as X
from folioground.operators import citations as CI, fusion, grounding as G, keyword as KW, knn, understanding as U
from folioground.operators.search_index import SearchIndex
from folioground.staging import stage_table


def judge_requests(requests: DataFrame, collections: DataFrame, users: DataFrame) -> DataFrame:
    """Every request with the first reason against running it; rejected requests stay as rows.

    ``requests``: query_id, query, collection_id, user_id, include_historical and filters.
    """
    rooms = collections.select("collection_id", "is_private", "is_active", "owner_user_id")
    # Anonymous requests get a key of their own each, so they do not all meet in one task.
    who = users.select(F.col("user_id").cast("string").alias("who"), A.role_permissions(F.col("role")).alias("permissions"))
    key = F.coalesce(F.col("user_id").cast("string"), F.concat(F.lit("anonymous-"), F.col("query_id").cast("string")))
    asked = F.length(F.coalesce("query", F.lit("")))
    archived = F.col("include_archived") if "include_archived" in requests.columns else F.lit(False)
    history = F.coalesce("include_historical", F.lit(False)) | F.coalesce(archived, F.lit(False))
    reason = (
        F.when(asked < 3, "QUERY_TOO_SHORT").when(asked > 500, "QUERY_TOO_LONG")
        .when(X.strip(F.coalesce("collection_id", F.lit(""))) == "", "COLLECTION_REQUIRED")
        .when(F.col("is_active").isNull() | ~F.col("is_active"), "COLLECTION_NOT_FOUND")
        .when(~A.may_read(F.col("is_private"), F.col("owner_user_id"), F.col("user_id"), F.col("permissions")),
              "FORBIDDEN_COLLECTION")
        .otherwise(A.history_denied(history, F.col("permissions"))))
    return (
        requests.withColumn("who", key).join(who, "who", "left").drop("who").withColumn("permissions", F.coalesce("permissions", A.text_array([])))
        .join(rooms, "collection_id", "left").withColumn("reject_reason", reason)
        .drop("is_private", "is_active", "owner_user_id"))


def request_options(queries: DataFrame, limit: int = C.DEFAULT_LIMIT) -> DataFrame:
    """Requests with every option of their own set: ``include_archived`` counts as history, ``scheme_name`` stands in for
    ``scheme``, ``active_only`` is true unless it is false, and ``limit`` is the default where it is null or 0."""
    have = lambda name, kind: F.col(name) if name in queries.columns else F.lit(None).cast(kind)
    filled = {
        "include_historical": F.coalesce("include_historical", F.lit(False)) | F.coalesce(have("include_archived", "boolean"), F.lit(False)),
        "scheme": F.coalesce(F.nullif("scheme", F.lit("")), have("scheme_name", "string")),
        "active_only": F.coalesce(have("active_only", "boolean"), F.lit(True)),
        "limit": F.coalesce(F.nullif(have("limit", "int"), F.lit(0)), F.lit(limit))}
    return queries.withColumns(filled)


def hybrid_search(queries: DataFrame, payload: DataFrame, index: SearchIndex,
                  vectors: DataFrame, embedder: Callable[[Column], Column], limit: int = C.DEFAULT_LIMIT,
                  page_merge: str = "last", embed: Callable[[list[str]], np.ndarray] | None = None) -> DataFrame:
    """Citations per query: keyword and vector retrieval, merge, fuse, gate, rank.

    ``queries`` may have the options of ``request_options``, each of its own row; ``active_only`` false lets inactive
    text of the vector side in without history. With ``embed``, the rows of ``vectors`` have texts (``knn.nearest``).
    """
    own = "limit" in queries.columns
    queries = request_options(queries, limit)
    pool = F.col("limit") * 3 if own else limit * 3
    kw = KW.normalized_scores(KW.keyword_search(queries, index, payload, pool))
    # Archived text stays out of vector search too, unless history is asked for.
    active = F.when(F.col("active_only") & ~F.col("include_historical"), F.lit("true"))
    asked = queries.filter(X.strip(F.col("query")) != "").select(
        "query_id", X.namespace(F.col("collection_id")).alias("namespace"), embedder(X.strip(F.col("query"))).alias("values"),
        F.nullif("scheme", F.lit("")).alias("f_scheme"), F.nullif("department", F.lit("")).alias("f_department"),
        F.nullif("language", F.lit("")).alias("f_language"), active.alias("f_active"), "limit")
    near = knn.nearest(asked, vectors, pool, {
        "f_scheme": "scheme_name", "f_department": "department", "f_language": "language", "f_active": "active"}, embed)
    kw, near = stage_table(kw, "keyword_hits"), stage_table(near, "vector_hits")
    # A few rows per query from here on: only they meet the payload again.
    wanted = kw.select("vector_id").union(near.select("vector_id")).distinct()
    place = stage_table(payload.drop("normalized_text").join(wanted, "vector_id", "left_semi"), "candidate_payload")
    spot = place.select("vector_id", "version_id", "page_number")
    merged = fusion.merge_candidates(kw.join(spot, "vector_id"), near.join(spot, "vector_id"), page_merge)
    facts = queries.select(
        "query_id", F.col("collection_id").alias("r_collection_id"), F.col("scheme").alias("r_scheme"),
        F.col("department").alias("r_department"), F.col("state_or_district").alias("r_location"),
        F.col("language").alias("r_language"), F.col("active_only").alias("r_active_only"),
        F.col("include_historical").alias("r_historical"), F.col("limit").alias("r_limit"))
    shown = merged.join(place.drop("version_id", "page_number"), "vector_id").join(facts, "query_id")
    # A page found by its vector alone shows the stored snippet, as its record holds no more.
    text = F.when(F.col("in_keyword"), F.col("chunk_text")).otherwise(F.col("snippet"))
    state = F.when(F.col("in_keyword"), F.col("is_historical")).otherwise(~F.col("active"))
    kept = fusion.post_filters(shown.withColumn("chunk_text", text).withColumn("is_historical", state))
    return fusion.citations(fusion.final_rank(fusion.fused_scores(kept), F.col("r_limit") if own else limit))


def answer(requests: DataFrame, collections: DataFrame, users: DataFrame, documents: DataFrame, versions: DataFrame,
           pages: DataFrame, payload: DataFrame, index: SearchIndex, vectors: DataFrame,
           embedder: Callable[[Column], Column], limit: int = C.DEFAULT_LIMIT,
           embed: Callable[[list[str]], np.ndarray] | None = None) -> dict[str, DataFrame]:
    """Answers, citations and checks for a table of requests, in one job.

    With ``embed``, the rows of ``vectors`` have texts, as in ``hybrid_search``.
    ``requests`` given, cited and final are what ``answer_log.run_facts`` takes for the log of the run.
    """
    understood = U.understand(requests).withColumn(
        "state_or_district", U.fill_location(F.col("state_or_district"), F.col("understood_location")))
    judged = stage_table(judge_requests(understood, collections, users), "judged_requests")
    run = judged.filter(F.col("reject_reason").isNull())
    cited = stage_table(hybrid_search(run, payload, index, vectors, embedder, limit, embed=embed), "citations")
    given = stage_table(G.grounded_answers(run, cited), "answers")
    to_check = cited.join(given.filter("not is_refusal").select("query_id"), "query_id", "left_semi")
    checked = stage_table(CI.validate_citations(
        to_check.withColumn("citation_index", F.col("rank") - 1), run, documents, versions, pages, collections,
        to_check), "checked_citations")
    final = CI.reconcile(given.filter("not is_refusal"), to_check, checked)
    out = (
        judged.select("query_id", "query", "collection_id", "reject_reason", "information_type",
                      "follow_up_question", "is_safe_to_answer")
        .join(given, "query_id", "left").join(final.drop("has_unsupported_claims").withColumnRenamed(
            "grounding_verified", "reconciled"), "query_id", "left")
        .select("query_id", "query", "collection_id", "reject_reason", "information_type",
                F.coalesce("final_answer", "answer").alias("answer"), "is_refusal", "refusal_reason",
                F.coalesce("reconciled", "grounding_verified").alias("grounding_verified"), "verification_warning",
                "total_citations", "valid_citations", "invalid_citations", "follow_up_question", "is_safe_to_answer"))
    valid = to_check.join(checked.filter("is_valid").select("query_id", (F.col("citation_index") + 1).alias("rank")),
                          ["query_id", "rank"], "left_semi")
    return {"answers": out, "citations": valid, "checked": checked, "requests": run, "given": given, "cited": to_check, "final": final}
