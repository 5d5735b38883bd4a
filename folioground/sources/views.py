"""Adapter views: the given tables seen as the engine's tables (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from folioground.functions import text as X

LINES_PER_PAGE = 8


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def read_texts(spark: SparkSession, sf_dir: str, table: str, key: str) -> DataFrame:
    """A table whose rows cost work. A parquet row group is one task however it is split, so a
    small input is spread by key; one with several splits per core is left alone."""
    df, cores = read(spark, sf_dir, table), spark.sparkContext.defaultParallelism
    return df.repartition(2 * cores, key) if df.rdd.getNumPartitions() < 4 * cores else df


def _source_no(source: Column) -> Column:
    return F.substring(source, 4, 9).cast("int")


def _effective(doc_id: Column) -> Column:
    day = F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")) + F.make_dt_interval(days=(doc_id % 365).cast("int"))
    return F.when(doc_id % 9 != 0, day)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    return read_texts(spark, sf_dir, "documents", "doc_id").select(
        d.alias("document_id"), F.col("source").alias("collection_id"),
        F.concat(F.lit("Scheme "), "source", F.lit("-"), (d % 7).cast("string")).alias("scheme_name"),
        F.concat(F.lit("Department "), (_source_no(F.col("source")) % 4).cast("string")).alias("department"),
        F.when(d % 3 == 0, "National / All States").when(d % 3 == 1, "Maharashtra - Pune")
        .otherwise("Karnataka").alias("state_or_district"),
        F.col("lang").alias("language"), (1 + d % 3).cast("int").alias("version_number"),
        F.when(d % 11 == 0, "DELETED").when(d % 11 == 1, "ARCHIVED").when(d % 11 == 2, "FAILED")
        .when(d % 11 == 3, "PROCESSING").otherwise("ACTIVE").alias("status"),
        F.sha2("text", 256).alias("file_hash"), _effective(d).alias("effective_date"))


def document_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last version of every document with its whole text."""
    d = F.col("doc_id")
    return read_texts(spark, sf_dir, "documents", "doc_id").select(
        d.alias("document_id"),
        F.concat_ws(":", d.cast("string"), (1 + d % 3).cast("string")).alias("version_id"), "text")


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions 1..n of each document; only the last shares the document's status."""
    d, k = F.col("doc_id"), F.col("k")
    last = k == 1 + d % 3
    lines = F.size(F.split("text", "\n"))
    pages = F.when(last, F.floor((lines + LINES_PER_PAGE - 1) / LINES_PER_PAGE)).otherwise(1).cast("int")
    status = (F.when(~last, "ARCHIVED").when(d % 11 == 0, "DELETED").when(d % 11 == 1, "ARCHIVED")
              .when(d % 11 == 2, "FAILED").when(d % 11 == 3, "PROCESSING").otherwise("ACTIVE"))
    return (
        read_texts(spark, sf_dir, "documents", "doc_id")
        .withColumn("k", F.explode(F.sequence(F.lit(1).cast("bigint"), 1 + d % 3)))
        .select(F.concat_ws(":", d.cast("string"), k.cast("string")).alias("version_id"),
                d.alias("document_id"), k.cast("int").alias("version_number"),
                F.sha2(F.when(last, F.col("text")).otherwise(F.concat(k.cast("string"), "text")), 256).alias("file_hash"),
                (F.col("n_chars") * k).alias("file_size_bytes"),
                F.when(d % 10 != 0, pages).alias("total_pages"), status.alias("status"),
                F.when(k % 2 == 1, _effective(d)).alias("effective_date")))


def cut_pages(texts: DataFrame) -> DataFrame:
    """Pages of eight lines. The split is done inside the row, so nothing is shuffled."""
    cut = F.transform(
        F.sequence(F.lit(0), F.floor((F.size("lines") - 1) / LINES_PER_PAGE).cast("int")),
        lambda i: F.array_join(F.slice("lines", i * LINES_PER_PAGE + 1, LINES_PER_PAGE), "\n"))
    return (
        texts.withColumn("lines", F.split("text", "\n"))
        .select("version_id", "document_id", F.posexplode(cut).alias("pos", "raw_text"))
        .select("version_id", "document_id", (F.col("pos") + 1).alias("page_number"), "raw_text"))


def passage_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages without their search text. They are cut where the documents lie, which costs little."""
    d = F.col("doc_id")
    texts = read(spark, sf_dir, "documents").select(
        d.alias("document_id"), F.concat_ws(":", d.cast("string"), (1 + d % 3).cast("string")).alias("version_id"), "text")
    return _passages(cut_pages(texts))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_pages(document_texts(spark, sf_dir))


def page_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Native and OCR reading of each page."""
    d, raw = F.col("document_id"), F.col("raw_text")
    first5 = F.array_join(F.slice(X.words(raw), 1, 5), " ")
    return pages(spark, sf_dir).select(
        "version_id", "document_id", "page_number",
        F.when(d % 5 == 0, first5).otherwise(raw).alias("native_text"),
        F.when(d % 4 != 1, raw).alias("ocr_text"))


def ocr_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each page image with a confidence from -1 to 100."""
    return (
        pages(spark, sf_dir)
        .select("version_id", "page_number", "document_id",
                F.posexplode(X.words(F.col("raw_text"))).alias("pos", "word"))
        .withColumn("conf", (F.col("pos") * 37 + F.col("document_id") * 11) % 102 - 1))


def collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _source_no(F.col("collection_id"))
    return (
        read(spark, sf_dir, "documents").select(F.col("source").alias("collection_id")).distinct()
        .select("collection_id", F.concat(F.lit("Collection "), n.cast("string")).alias("name"),
                F.concat(F.lit("slug-"), n.cast("string")).alias("slug"),
                (n % 4).cast("int").alias("department_id"),
                (n % 5 == 0).alias("is_private"), (n % 10 != 9).alias("is_active"),
                n.cast("bigint").alias("owner_user_id")))


def departments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Departments 0 to 2; collections of the fourth have no department row."""
    return (collections(spark, sf_dir).select("department_id").distinct().filter("department_id < 3")
            .withColumn("department_name", F.concat(F.lit("Department "), F.col("department_id").cast("string"))))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = F.col("c_mktsegment")
    role = (F.when(seg == "AUTOMOBILE", "SYSTEM_ADMIN").when(seg == "BUILDING", "SCHEME_ADMIN")
            .when(seg == "FURNITURE", "HELPDESK").when(seg == "HOUSEHOLD", "CITIZEN"))
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), role.alias("role"))


def bench_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark passage as a whole, asked in turn of each collection."""
    i = F.col("item_id")
    q = F.array_join(X.words(F.col("text")), " ")
    return read(spark, sf_dir, "benchmark").select(
        i.alias("query_id"),
        F.when(i % 4 == 3, F.concat(F.lit('"'), q, F.lit('"'))).otherwise(q).alias("query"),
        F.concat(F.lit("src"), (i % 20).cast("string")).alias("collection_id"),
        (i % 8 == 1).alias("include_historical"),
        F.when(i % 5 == 2, "scheme src").alias("scheme"), F.lit(None).cast("string").alias("department"),
        F.when(i % 10 == 4, "pune").alias("state_or_district"), F.when(i % 5 == 1, "EN").alias("language"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    text = (
        F.when(k % 6 == 0, F.concat(F.lit("Am I eligible for the old age pension, I am "), (18 + k % 80).cast("string"), F.lit(" years old")))
        .when(k % 6 == 1, "What documents are required for a house loan in Pune city for ews woman")
        .when(k % 6 == 2, F.concat(F.lit("Am I eligible for kisan support, annual income below "), (1 + k % 9).cast("string"), F.lit(" lakh")))
        .when(k % 6 == 3, F.concat(F.lit("How much subsidy for disabled weaver with "), (40 + k % 60).cast("string"), F.lit("% disability in Bihar village")))
        .when(k % 6 == 4, "What is the last date for student scholarship in tamil nadu")
        .otherwise("check application status"))
    return read(spark, sf_dir, "customer").select(
        k.alias("query_id"), text.alias("query"),
        F.concat(F.lit("src"), (k % 20).cast("string")).alias("collection_id"), k.alias("user_id"))


def stored_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_texts(spark, sf_dir, "embeddings", "vec_id").select(
        F.col("vec_id").cast("string").alias("vector_id"),
        F.concat(F.lit("ns:"), F.col("label").cast("string")).alias("namespace"),
        F.col("embedding").alias("values"), F.col("label").alias("label"))


def qa_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user turn answered by the assistant in the very next turn."""
    turns = read(spark, sf_dir, "conversations")
    asked = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    given = turns.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return asked.join(given, ["conv_id", "turn"]).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("qa_id"), "conv_id", "question", "answer",
        F.concat(F.lit("src"), (F.col("conv_id") % 20).cast("string")).alias("collection_id"),
        (100 + (F.length("question") * 7) % 4000).alias("latency_ms"),
        (F.length("answer") % 7 == 0).alias("is_refusal"))


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "labels").select(
        (F.col("doc_id") * 1000).alias("qa_id"), F.col("doc_id").alias("user_id"),
        F.when(F.col("quality") == 1, 1).otherwise(-1).alias("rating"))


def audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id",
        F.col("event_type").alias("action"), "value", F.col("props").alias("metadata_json"))


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    return read(spark, sf_dir, "documents").select(
        d.alias("upload_id"),
        F.concat(d.cast("string"), F.when(d % 13 == 0, ".txt").otherwise(".PDF")).alias("filename"),
        F.when(d % 23 == 0, 0).otherwise(F.col("n_chars") * 4096).alias("file_size_bytes"),
        (d % 17 != 0).alias("is_official_source_confirmed"),
        F.when(d % 19 == 0, "unknown").otherwise(F.col("source")).alias("collection_id"),
        F.base64(F.col("text").cast("binary")).alias("content_base64"))


def applicants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("applicant_id"),
        F.when(F.col("c_custkey") % 11 != 0, F.round(F.col("c_acctbal") * 100, 0)).alias("annual_income"),
        F.when(F.col("c_custkey") % 13 != 0, (F.col("c_custkey") % 7) / F.lit(2.0)).alias("landholding_hectares"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two processing jobs for two documents of three, the later one with a summary."""
    d, k = F.col("doc_id"), F.col("k")
    return (
        read(spark, sf_dir, "documents").filter(d % 3 != 0)
        .withColumn("k", F.explode(F.array(F.lit(1), F.lit(2))))
        .select(F.concat(F.lit("job-"), d.cast("string"), F.lit("-"), k.cast("string")).alias("job_id"),
                d.alias("document_id"),
                F.concat_ws(":", d.cast("string"), (1 + d % 3).cast("string")).alias("version_id"),
                F.when((k == 2) & (d % 5 == 0), "FAILED").when(k == 2, "COMPLETED")
                .otherwise("QUEUED").alias("status"),
                (k * 50).alias("progress_percent"), k.alias("created_seq"),
                F.when((k == 2) & (d % 2 == 0), F.to_json(F.struct(
                    (d % 9 + 1).alias("total_pages"), (d % 4).alias("ocr_pages")))).alias("summary_json")))


def doc_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed key and value rows of documents; some values do not fit their type."""
    d = F.col("doc_id")
    kinds = F.array(*[F.lit(x) for x in ("integer", "date", "boolean", "json", "string")])
    value = (
        F.when(F.col("data_type") == "integer", F.when(d % 7 == 0, "n/a").otherwise(F.col("n_chars").cast("string")))
        .when(F.col("data_type") == "date", F.concat(F.lit("2024-"), F.lpad((d % 14 + 1).cast("string"), 2, "0"), F.lit("-15")))
        .when(F.col("data_type") == "boolean", F.when(d % 2 == 0, "true").otherwise("false"))
        .when(F.col("data_type") == "json", F.concat(F.lit('{"k": '), (d % 10).cast("string"), F.lit("}")))
        .otherwise(F.col("source")))
    return (read(spark, sf_dir, "documents")
            .withColumn("data_type", F.explode(kinds))
            .select(d.alias("document_id"), F.concat(F.lit("key_"), "data_type").alias("meta_key"),
                    value.alias("meta_value"), "data_type"))


def page_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every meaningful page as one passage: the corpus for queries checked against plain SQL."""
    found = _passages(pages(spark, sf_dir))
    return found.withColumn("normalized_text", X.normalize_for_search(F.col("chunk_text")))


def _passages(pages: DataFrame) -> DataFrame:
    raw, d = F.col("raw_text"), F.col("document_id")
    return pages.filter(X.is_meaningful(raw)).select(
        X.vector_id(F.col("version_id"), F.col("page_number"), F.col("page_number") - 1).alias("vector_id"),
        "version_id", "document_id", "page_number", F.col("page_number").cast("string").alias("page_range"),
        (F.col("page_number") - 1).alias("chunk_index"),
        F.when(d % 6 == 0, F.array_join(F.slice(X.words(raw), 1, 3), " ")).alias("section_heading"),
        raw.alias("chunk_text"))
