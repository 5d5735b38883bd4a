"""Histories, quality and usage reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def newest(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The ``n`` newest rows: each task keeps its own best ``n`` first."""
    return rows.orderBy(*[F.desc(c) for c in order]).limit(n)


def status_counts(documents: DataFrame) -> DataFrame:
    return documents.groupBy("collection_id", "status").agg(F.count("*").alias("n_documents"))


def helpfulness(feedback: DataFrame, answers: DataFrame) -> DataFrame:
    """Share of positive ratings per collection, over ratings of logged answers only."""
    rated = feedback.join(answers.select("qa_id", "collection_id"), "qa_id")
    return rated.groupBy("collection_id").agg(
        F.count("*").alias("n_ratings"), F.round(F.avg(F.when(F.col("rating") == 1, 1.0).otherwise(0.0)), 6).alias("helpful_rate"))


def service_levels(answers: DataFrame) -> DataFrame:
    """Refusal rate and exact 95th percentile of latency per collection.

    Latencies are counted per value first, so the percentile sees distinct values with counts.
    """
    counted = answers.groupBy("collection_id", "latency_ms").agg(
        F.count("*").alias("n"), F.count_if("is_refusal").alias("refused"))
    return counted.groupBy("collection_id").agg(
        F.sum("n").alias("n_answers"), F.round(F.sum("refused") / F.sum("n"), 6).alias("refusal_rate"),
        F.round(F.percentile("latency_ms", 0.95, F.col("n")), 4).alias("latency_p95"))


def ingestion_success(latest_jobs: DataFrame) -> DataFrame:
    return latest_jobs.agg(
        F.count("*").alias("n_jobs"),
        F.round(F.avg(F.when(F.col("status") == "COMPLETED", 1.0).otherwise(0.0)), 6).alias("success_rate"))


def citation_accuracy(report: DataFrame) -> DataFrame:
    return report.agg(
        F.sum("total_citations").alias("total_citations"), F.sum("valid_citations").alias("valid_citations"),
        F.round(F.sum("valid_citations") / F.sum("total_citations"), 6).alias("citation_accuracy"))


def audit_rollup(events: DataFrame, day: Column) -> DataFrame:
    """Counts by action and day with subtotals and the grand total."""
    return (events.withColumn("day", day).rollup("action", "day")
            .agg(F.count("*").alias("n_events"), F.round(F.sum("value"), 2).alias("total_value")))
