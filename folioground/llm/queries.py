"""Queries of the training-data operators, each over its whole table, and their SQL forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioground.llm import balls, binary, caps, jaccard, language, licenses, packing, pieces, pivots, quality, revisits, sharding, sql, tokens, whitening

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    if form := getattr(sql, fn.__name__.upper(), None):
        ORACLES[fn.__name__] = form
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op6_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=24)


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged, _ = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *quality.COUNTS, "base_failed", "kept", "rule")


@query
def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op5_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokens.vocabulary_path(), end=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "loss_tokens")


@query
def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary.token_output(table(spark, sf_dir, "documents"), tokens.vocabulary_path(), end=2)


@query
def op3_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))[0]


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


@query
def op4_spherical_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caps.near_vectors(table(spark, sf_dir, "embeddings"))


@query
def op7_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = revisits.resolve(revisits.crawl_of_pages(table(spark, sf_dir, "pages")))
    lines = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "; ")
    return found.withColumn("headers", F.when(F.col("headers").isNotNull(), lines))


@query
def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = tokens.vocabulary_path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    encoded = pieces.encode(docs, model, ["doc_id", "text_crc32"]).withColumn("ids_crc32", F.crc32("ids"))
    decoded = pieces.decode(encoded, model, ["doc_id", "text_crc32", "n_pieces", "ids_crc32"])
    decoded_crc = F.crc32(F.col("text").cast("binary"))
    return decoded.select("doc_id", "n_pieces", "ids_crc32", decoded_crc.alias("decoded_crc32"), (decoded_crc == F.col("text_crc32")).alias("round_trip"))


@query
def op11_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=16)


@query
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balls.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)
