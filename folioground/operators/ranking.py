"""BM25, reciprocal-rank fusion and retrieval evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from folioground.functions import text as X
from folioground.operators.keyword import top_k
from folioground.operators.search_index import ACTIVE, HISTORICAL, KEY, SearchIndex
from folioground.staging import stage_table


#: Parts in which the postings of one split are scored, and the share of blocks that are scored first.
PARTS_PER_SPLIT = 4
FLOOR_BLOCKS = 16


def bm25(queries: DataFrame, index: SearchIndex, k: int, k1: float = 1.2, b: float = 0.75, within: bool = False) -> DataFrame:
    """Top ``k`` chunks per query by BM25 over normalised words, from the stored counts.

    Over all chunks of the index; ``within``, over the collection of each query alone, without deleted chunks and, unless
    history is asked for, without inactive ones, statistics included.
    """
    history = F.coalesce("include_historical", F.lit(False)) if within else F.lit(True)
    asked = stage_table(queries.select("query_id", "collection_id", history.alias("history"), F.explode(F.array_distinct(X.words(
        X.normalize_for_search(F.col("query"))))).alias("word")), "bm25_terms")
    counts, totals = index.word_counts(asked, within), index.collection_totals(within)
    sums = lambda p: F.col(f"{p}_active") + F.when(F.col("history"), F.col(f"{p}_historical")).otherwise(0) + (F.lit(0) if within else F.col(f"{p}_deleted"))
    # Totals of everything are one row: scalar subqueries, no join.
    known = asked.join(counts, ["collection_id", "word"] if within else "word")
    known = known.join(totals, "collection_id") if within else known.withColumns({c: totals.select(c).scalar() for c in totals.columns})
    n, d = F.col("n_docs"), F.col("df")
    weighted = (
        known.select("query_id", "collection_id", "history", "word", sums("df").alias("df"), sums("docs").alias("n_docs"), sums("words").alias("n_words"))
        .where("df > 0").withColumn("idf", F.log(F.lit(1.0) + (n - d + F.lit(0.5)) / (d + F.lit(0.5)))).withColumn("avgdl", F.col("n_words") / n))
    weighted = stage_table(weighted if within else weighted.drop("collection_id"), "bm25_weights")
    keys = ["collection_id", "word"] if within else ["word"]
    postings = (index.within("postings", asked) if within else index.table("postings")).select(*KEY, "word", "entries")
    postings = postings.join(weighted.select(*keys).distinct(), keys, "left_semi")
    live = index.live_chunks().groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct("at", "vector_id"))).alias("live"))  # some tens of chunks
    tf, dl = F.col("tf"), F.col("dl")
    part = F.col("idf") * (tf * F.lit(k1 + 1)) / (tf + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * dl / F.col("avgdl")))
    spread = PARTS_PER_SPLIT * postings.rdd.getNumPartitions()

    def scored(held: DataFrame) -> DataFrame:
        """Every chunk with a word of a query. Blocks are brought together as they are stored; a query's row for
        each chunk is made and summed there, and never shuffled."""
        told = held.repartition(spread, *KEY).join(weighted, keys).select("query_id", *KEY, "history", "idf", "avgdl", F.inline("entries")).where("tf > 0")
        if within:
            told = told.where((F.col("state") == ACTIVE) | F.col("history") & (F.col("state") == HISTORICAL))
        sums = told.groupBy("query_id", *KEY, "at").agg(F.round(F.sum(part), 6).alias("bm25"))
        return (sums.join(live.hint("shuffle_hash"), KEY).select("query_id", F.try_element_at("live", F.col("at")).alias("vector_id"), "bm25")
                .where("vector_id IS NOT NULL"))

    # The k-th best score among some blocks is a floor for all: what is below it need not be sorted. Sums may differ in their last digit.
    some = F.pmod(F.xxhash64(*KEY), F.lit(FLOOR_BLOCKS)) == 0
    floors = stage_table(top_k(scored(postings.where(some)), "bm25", k).where(F.col("rank") == k).select("query_id", (F.col("bm25") - 2e-6).alias("floor")), "bm25_floors")
    reach = scored(postings).join(floors, "query_id", "left").where(F.col("floor").isNull() | (F.col("bm25") >= F.col("floor")))
    return top_k(reach.drop("floor"), "bm25", k)


def reciprocal_rank_fusion(left: DataFrame, right: DataFrame, k: int, constant: int = 60) -> DataFrame:
    """Fuse two rankings (query_id, vector_id, rank) by the sum of 1 / (constant + rank)."""
    share = F.lit(1.0) / (F.lit(constant) + F.col("rank"))
    both = left.select("query_id", "vector_id", "rank").unionByName(right.select("query_id", "vector_id", "rank"))
    fused = both.groupBy("query_id", "vector_id").agg(F.round(F.sum(share), 8).alias("rrf"))
    return top_k(fused, "rrf", k)


def retrieval_quality(results: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """hit@k and page precision against known (query_id, document_id) pairs."""
    known = truth.select("query_id", "document_id").distinct().withColumn("relevant", F.lit(1))
    per_query = (
        results.filter(F.col("rank") <= k).join(known, ["query_id", "document_id"], "left")
        .groupBy("query_id").agg(F.coalesce(F.sum("relevant"), F.lit(0)).alias("found"), F.count("*").alias("shown")))
    return (
        known.select("query_id").distinct().join(per_query, "query_id", "left")
        .agg(F.count("*").alias("n_queries"),
             F.round(F.avg(F.when(F.coalesce("found", F.lit(0)) > 0, 1.0).otherwise(0.0)), 6).alias("hit_at_k"),
             F.round(F.coalesce(F.sum("found") / F.sum("shown"), F.lit(0.0)), 6).alias("page_precision")))
