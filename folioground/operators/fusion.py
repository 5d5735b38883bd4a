"""Merging keyword and vector candidates, scoring, gating and the final rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from folioground import constants as C
from folioground.functions import text as X


def merge_candidates(keyword: DataFrame, vector: DataFrame, page_merge: str = "last") -> DataFrame:
    """One candidate row per keyword hit and per page found by vectors alone.

    ``keyword``: query_id, vector_id, version_id, page_number, kw_score, kw_rank.
    ``vector``: query_id, vector_id, version_id, page_number, vec_score, vec_rank.
    The best keyword hit of a page takes the vector score of that page: the lowest-ranked one with
    ``page_merge='last'``, the highest with ``'best'``. Both sides hold a few rows per query.
    """
    page = ["query_id", "version_id", "page_number"]
    pick = F.max_by if page_merge == "last" else F.min_by
    per_page = vector.groupBy(*page).agg(
        pick("vec_score", "vec_rank").alias("vec_score"),
        F.min_by("vector_id", "vec_rank").alias("vec_vector_id"), F.min("vec_rank").alias("vec_rank"))
    first_on_page = Window.partitionBy(*page).orderBy("kw_rank")
    ranked = keyword.withColumn("page_pos", F.row_number().over(first_on_page))
    firsts = ranked.filter("page_pos = 1").drop("page_pos")
    rest = ranked.filter("page_pos > 1").drop("page_pos")
    joined = firsts.join(per_page, page, "full_outer").select(
        *page, F.coalesce("vector_id", "vec_vector_id").alias("vector_id"),
        F.coalesce("kw_score", F.lit(0.0)).alias("kw_score"), "kw_rank",
        F.coalesce("vec_score", F.lit(0.0)).alias("vec_score"), "vec_rank",
        F.col("kw_score").isNotNull().alias("in_keyword"), F.col("vec_score").isNotNull().alias("in_vector"))
    others = rest.select(
        *page, "vector_id", "kw_score", "kw_rank", F.lit(0.0).alias("vec_score"),
        F.lit(None).cast("int").alias("vec_rank"), F.lit(True).alias("in_keyword"), F.lit(False).alias("in_vector"))
    return joined.unionByName(others)


def post_filters(candidates: DataFrame) -> DataFrame:
    """Filters repeated on the merged candidates; ``r_`` columns are what the request asked for."""
    asks = lambda c: F.nullif(F.col(c), F.lit(""))
    inside = lambda held, wanted: asks(wanted).isNull() | F.contains(F.lower(held), F.lower(wanted))
    absent_or = lambda held, cond: F.nullif(F.col(held), F.lit("")).isNull() | cond
    active_only = F.coalesce("r_active_only", F.lit(True)) & ~F.coalesce("r_historical", F.lit(False))
    return candidates.filter(
        (F.col("collection_id") == F.col("r_collection_id"))
        & inside("scheme_name", "r_scheme") & inside("department", "r_department")
        & absent_or("state_or_district", inside("state_or_district", "r_location"))
        & (asks("r_language").isNull()
           | absent_or("language", F.lower("language") == F.lower("r_language")))
        & ~(active_only & F.col("is_historical")))


def fused_scores(candidates: DataFrame, threshold: float = C.SCORE_THRESHOLD) -> DataFrame:
    """Blend, prefer active versions, round, explain, and drop what stays under the gate."""
    kw, vec = F.col("kw_score"), F.col("vec_score")
    blend = (
        F.when(F.col("in_keyword") & F.col("in_vector"), F.lit(0.5) * kw + F.lit(0.5) * vec + F.lit(0.10))
        .when(F.col("in_keyword"), F.least(F.lit(0.92), F.lit(0.45) + F.lit(0.45) * kw)).otherwise(vec))
    boosted = F.when(~F.col("is_historical") & (blend >= 0.35), F.least(F.lit(1.0), blend + F.lit(0.05))).otherwise(blend)
    similarity = X.fixed(vec, 2)
    reason = (
        F.when(F.col("in_keyword") & F.col("in_vector"), F.concat(
            F.lit("Hybrid Match: Exact keyword match + Semantic similarity ("), similarity, F.lit(")")))
        .when(F.col("in_keyword"), "Keyword Match: Exact term/phrase match in document text")
        .otherwise(F.concat(F.lit("Semantic Match: High vector similarity ("), similarity, F.lit(")"))))
    return (
        candidates.withColumn("score", X.exact_round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), boosted)), 4))
        .withColumn("retrieval_reason", reason).filter(F.col("score") >= threshold))


def final_rank(scored: DataFrame, limit: int | Column = C.DEFAULT_LIMIT) -> DataFrame:
    """Score, then active before archived, then newer version; ties keep the retrieval order."""
    order = Window.partitionBy("query_id").orderBy(
        F.desc("score"), F.asc("is_historical"), F.desc("version_number"),
        F.asc_nulls_last("kw_rank"), F.asc_nulls_last("vec_rank"), F.asc("vector_id"))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def citations(ranked: DataFrame) -> DataFrame:
    """Ranked candidates as citation rows."""
    return ranked.select(
        "query_id", "rank", "document_id",
        X.document_title(F.col("scheme_name"), F.col("version_number")).alias("document_title"),
        "version_id", "version_number", "page_number", "page_range", "section_heading",
        X.truncate(F.col("chunk_text"), 400).alias("excerpt"), "score", "retrieval_reason",
        F.when(F.col("is_historical"), C.ARCHIVED).otherwise(C.ACTIVE).alias("status"),
        "is_historical", "department", "state_or_district", "language", "effective_date")
