"""What an answer run leaves behind: sessions, answers, kept citations, claims and reports, written from one table of facts.

A run writes a folder of its own in each table (``run_id=...``). Writing it again replaces that folder, so a run that is
repeated leaves the tables as they were, and no other run is read or rewritten, but for the session tokens.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from folioground.operators import citations as CI, grounding as G
from folioground.sources import tables as S
from folioground.staging import stage_table

TABLES = ("sessions", "answers", "citations", "claims", "reports")


def run_facts(requests: DataFrame, given: DataFrame, citations: DataFrame, checked: DataFrame, final: DataFrame,
              run_id: str) -> DataFrame:
    """One row for each request that ran, with its citations, claims and report as arrays.

    ``requests``: query_id, query, collection_id, session_token, asked_at. ``given``: query_id, answer, is_refusal and
    grounding_verified before the citations were checked. ``citations``: what was cited, with rank and score;
    ``checked`` their validation; ``final`` what ``reconcile`` made of both. A request has a handful of citations and
    statements, so the arrays stay short. Refusals have no report, citations or claims. A token that is null or empty
    is no session; a request without a row in ``given`` did not run and has no facts.
    """
    supported = citations.join(
        checked.filter("is_valid").select("query_id", (F.col("citation_index") + 1).alias("rank")), ["query_id", "rank"], "left_semi")
    shown = supported.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(
        "rank", "document_id", "page_number", "document_title", "excerpt", "score"))).alias("citations"))
    ends = final.filter("valid_citations > 0").select("query_id", F.col("final_answer").alias("answer"))
    said = G.check_claims(ends, supported).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(
        "claim_idx", "statement", "document_title", "page_number", "verified", "overlap"))).alias("claims"))
    messages = CI.validation_details(checked)
    warnings = F.concat("messages", F.when(F.col("verification_warning").isNotNull(), F.array("verification_warning")).otherwise(F.array().cast("array<string>")))
    report = final.join(messages, "query_id").select(
        "query_id", "final_answer", F.col("grounding_verified").alias("end_verified"), "verification_warning",
        F.struct("total_citations", "valid_citations", "invalid_citations", "has_unsupported_claims",
                 warnings.alias("warnings"), "details").alias("report"))
    asked = requests.select("query_id", "query", "collection_id", F.nullif("session_token", F.lit("")).alias("session_token"), "asked_at")
    return (
        asked.join(given.select("query_id", "answer", "is_refusal", "grounding_verified"), "query_id")
        .join(report, "query_id", "left").join(shown, "query_id", "left").join(said, "query_id", "left")
        .select(F.concat(F.lit(run_id + ":"), F.col("query_id").cast("string")).alias("qa_id"), "query_id", "session_token",
                "asked_at", "collection_id", F.col("query").alias("question"), F.coalesce("final_answer", "answer").alias("answer"),
                "is_refusal", F.coalesce("end_verified", "grounding_verified").alias("grounding_verified"),
                "verification_warning", "report", "citations", "claims"))


def new_sessions(facts: DataFrame, held: DataFrame | None) -> DataFrame:
    """Sessions that the run creates: of each token not held yet, its first question (of equal times the smaller id)."""
    first = F.min(F.struct("asked_at", "query_id", "collection_id"))
    created = (facts.filter(F.col("session_token").isNotNull()).groupBy("session_token").agg(first.alias("f"))
               .select("session_token", F.col("f.collection_id").alias("collection_id"), F.col("f.asked_at").alias("created_at")))
    return created if held is None else created.join(held.select("session_token"), "session_token", "left_anti")


def log_tables(facts: DataFrame, documents: DataFrame, held_sessions: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables of ``TABLES``. Citations stay where their document is in the catalog."""
    cited = facts.select("qa_id", F.inline("citations"))
    return {
        "sessions": new_sessions(facts, held_sessions),
        "answers": facts.select("qa_id", "session_token", "collection_id", "question", "answer", "is_refusal",
                                "grounding_verified", "verification_warning", "asked_at"),
        "citations": cited.withColumnRenamed("score", "confidence_score").join(
            documents.select("document_id"), "document_id", "left_semi"),
        "claims": facts.select("qa_id", F.inline("claims")),
        "reports": facts.filter("report is not null").select("qa_id", "report.*")}


def write_run(facts: DataFrame, documents: DataFrame, root: str, run_id: str) -> dict[str, int]:
    """Write every table of a run below ``root`` and return its counts. May be repeated; one writer at a time.

    The facts are written once and all tables read that copy; the counts come with that write (``observe``).
    """
    if not re.fullmatch(r"[A-Za-z0-9_-]+", run_id):
        raise ValueError("run_id takes letters, digits, - and _")
    seen = Observation("answer_run")
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c)).otherwise(0)
    counted = facts.observe(
        seen, F.count(F.lit(1)).alias("answers"), F.count_if("is_refusal").alias("refusals"), n(size("citations")).alias("supported_citations"),
        n("report.invalid_citations").alias("rejected_citations"), n(size("claims")).alias("claims"))
    kept = stage_table(counted, "answer_facts")
    spark, place = facts.sparkSession, f"{root}/sessions"
    held = read_log(spark, root, "sessions").filter(F.col("run_id") != run_id) if S.has_files(spark, place) else None
    for name, table in log_tables(kept, documents, held).items():
        table.write.mode("overwrite").parquet(f"{root}/{name}/run_id={run_id}")
    return {k: int(v) for k, v in seen.get.items()}


def read_log(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A log table with ``run_id``, by which it is partitioned (as text)."""
    rows = spark.read.option("basePath", f"{root}/{table}").parquet(f"{root}/{table}")
    return rows.withColumn("run_id", F.col("run_id").cast("string"))
