"""OCR word tables to page readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from folioground import constants as C
from folioground.functions import text as X


def ocr_pages(words: DataFrame, threshold: float = C.OCR_REVIEW_BELOW) -> DataFrame:
    """Aggregate (version_id, page_number, pos, word, conf) rows to one reading per page.

    The words of one page image are the bounded unit collected here.
    """
    word = X.strip(F.col("word"))
    kept = (word != "") & (F.col("conf") != -1)
    # Blank and unread words drop out, yet a page of nothing else still gets its empty reading.
    pages = (
        words.groupBy("version_id", "page_number")
        .agg(F.array_sort(F.collect_list(F.when(kept, F.struct("pos", word.alias("w"))))).alias("ws"),
             F.avg(F.when(kept, F.col("conf").cast("double"))).alias("mean_conf"))
        .select("version_id", "page_number",
                F.array_join(F.col("ws.w"), " ").alias("ocr_text"),
                F.size("ws").alias("word_count"), "mean_conf"))
    conf = F.coalesce("mean_conf", F.when(F.col("ocr_text") != "", C.OCR_DEFAULT_CONFIDENCE).otherwise(0.0))
    return (
        pages.withColumn("exact_conf", conf)
        .withColumn("requires_review", F.col("exact_conf") < threshold)
        .withColumn("review_reason", F.when(
            F.col("requires_review"),
            F.concat(F.lit("Low OCR confidence ("), X.fixed(F.col("exact_conf"), 1), F.lit(f"% < {threshold}%)"))))
        .withColumn("ocr_confidence", X.exact_round(F.col("exact_conf"), 2))
        .drop("mean_conf", "exact_conf"))
