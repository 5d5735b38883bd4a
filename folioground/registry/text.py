"""Queries over page text: cleaning, line kinds, blocks, readings, chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioground import constants as C
from folioground.functions import text as X
from folioground.operators import chunking as K, ocr
from folioground.plans import ingest as P
from folioground.registry.base import query
from folioground.registry.packing_sql import CHUNK_ID, chunk_rows, packed_sql
from folioground.registry.retrieval import staged
from folioground.registry.sql_views import NOT_WS, WS, fold, meaningful, n_words, strip, with_views, words
from folioground.sources import views as V
from folioground.staging import stage_table


def clean_sql(x: str) -> str:
    """Strip each line, keep one blank line in a row: line lists instead of one pattern chain."""
    lines = f"list_transform(string_split(regexp_replace({x}, '\\r\\n?', chr(10), 'g'), chr(10)), lambda l: {strip('l')})"
    return (f"coalesce({strip(f'regexp_replace(array_to_string({lines}, chr(10)), chr(10) || chr(10) || chr(10) || chr(10) || {chr(39)}*{chr(39)}, chr(10) || chr(10), {chr(39)}g{chr(39)})')}, '')"
            .replace("chr(10) || chr(10) || chr(10) || chr(10) || '*'", "'\\n{3,}'"))


def numbered_chunks(spark, sf_dir, of_version=None):
    """Chunks with their numbers; the packed text is written once for all that read it."""
    local = staged(spark, sf_dir, "page_chunks", lambda: stage_table(K.chunk_pages(V.pages(spark, sf_dir)), "page_chunks"))
    return K.number_chunks(local.filter(F.col("error").isNull()), of_version=of_version)


def chunks(spark, sf_dir):
    return staged(spark, sf_dir, "chunks", lambda: stage_table(K.describe_chunks(numbered_chunks(spark, sf_dir)), "chunks"))


@query("search_normalisation", f"select doc_id, sha256({fold('text')}) as folded_hash, length({fold('text')}) as folded_length from documents")
def search_normalisation(spark, sf_dir):
    t = V.read_texts(spark, sf_dir, "documents", "doc_id").select("doc_id", X.normalize_for_search(F.col("text")).alias("t"))
    return t.select("doc_id", F.sha2("t", 256).alias("folded_hash"), F.length("t").cast("bigint").alias("folded_length"))


@query("structure_cleaning", with_views("v_pages", body=f"""
select version_id, page_number, sha256(c) as clean_hash, length(c) as clean_length from (
 select version_id, page_number, {clean_sql("replace(raw_text, ' ', chr(10) || '  ')")} as c from v_pages)"""))
def structure_cleaning(spark, sf_dir):
    spaced = F.replace(F.col("raw_text"), F.lit(" "), F.lit("\n  "))
    return (V.pages(spark, sf_dir).withColumn("c", X.clean_structure(spaced))
            .select("version_id", "page_number", F.sha2("c", 256).alias("clean_hash"), F.length("c").cast("bigint").alias("clean_length")))


@query("word_and_token_counts", f"""
select doc_id, {n_words('text')} as word_count, greatest(1, cast(floor({n_words('text')} * 1.3e0) as int)) as token_count from documents""")
def word_and_token_counts(spark, sf_dir):
    n = X.word_count(F.col("text"))
    return V.read_texts(spark, sf_dir, "documents", "doc_id").select(
        "doc_id", n.cast("bigint").alias("word_count"), X.token_estimate(n).alias("token_count"))


@query("text_truncation", with_views("v_pages", body="""
select version_id, page_number, case when length(raw_text) > 400 then substr(raw_text, 1, 400) || '...' else raw_text end as excerpt,
 length(case when length(raw_text) > 950 then substr(raw_text, 1, 950) || '...' else raw_text end) as snippet_length,
 length(substr(raw_text, 1, 1000)) as preview_length from v_pages"""))
def text_truncation(spark, sf_dir):
    r = F.col("raw_text")
    return V.pages(spark, sf_dir).select(
        "version_id", "page_number", X.truncate(r, 400).alias("excerpt"), F.length(X.truncate(r, 950)).cast("bigint").alias("snippet_length"),
        F.length(X.truncate(r, 1000, "")).cast("bigint").alias("preview_length"))


@query("location_split", with_views("v_documents", body=f"""
select document_id, case when contains(l, '/') then trim(substr(l, 1, strpos(l, '/') - 1))
  when contains(l, '-') and not contains(l, 'All') then trim(substr(l, 1, strpos(l, '-') - 1)) else l end as state,
 case when contains(l, '/') then trim(substr(l, strpos(l, '/') + 1))
  when contains(l, '-') and not contains(l, 'All') then trim(substr(l, strpos(l, '-') + 1)) else 'All' end as district
from (select document_id, coalesce(case when document_id % 13 = 0 then null else state_or_district end, 'National') as l from v_documents)"""))
def location_split(spark, sf_dir):
    place = X.split_location(F.when(F.col("document_id") % 13 != 0, F.col("state_or_district")))
    return V.documents(spark, sf_dir).select("document_id", place["state"].alias("state"), place["district"].alias("district"))


@query("keys_and_titles", with_views("v_pages", "v_documents", body="""
select version_id || ':' || page_number || ':' || (page_number - 1) as vector_id, 'corpus:' || d.collection_id as namespace,
 'page-artifacts/' || document_id || '/v' || d.version_number || '/pages/page-' || lpad(cast(page_number as varchar), 3, '0') || '.webp' as artifact_key,
 'raw-documents/' || d.collection_id || '/' || document_id || '.pdf' as storage_key,
 d.scheme_name || ' (v' || d.version_number || ')' as title from v_pages join v_documents d using (document_id)"""))
def keys_and_titles(spark, sf_dir):
    d = V.documents(spark, sf_dir).select("document_id", "collection_id", "version_number", "scheme_name")
    return V.pages(spark, sf_dir).join(d, "document_id").select(
        X.vector_id(F.col("version_id"), F.col("page_number"), F.col("page_number") - 1).alias("vector_id"),
        X.namespace(F.col("collection_id")).alias("namespace"),
        X.page_artifact_key(F.col("document_id"), F.col("version_number"), F.col("page_number")).alias("artifact_key"),
        X.storage_key(F.col("collection_id"), F.concat(F.col("document_id").cast("string"), F.lit(".pdf"))).alias("storage_key"),
        X.document_title(F.col("scheme_name"), F.col("version_number")).alias("title"))


@query("iso_date_parse", """
select doc_id, try_cast(replace(case doc_id % 4 when 0 then '2024-01-' || lpad(cast(doc_id % 40 as varchar), 2, '0')
  when 1 then '2024-02-03T04:05:06Z' when 2 then 'n/a' else '2024-03-0' || (doc_id % 9 + 1) || ' 10:00:00' end, 'Z', '') as timestamp) as parsed from documents""")
def iso_date_parse(spark, sf_dir):
    d = F.col("doc_id")
    raw = (F.when(d % 4 == 0, F.concat(F.lit("2024-01-"), F.lpad((d % 40).cast("string"), 2, "0"))).when(d % 4 == 1, "2024-02-03T04:05:06Z")
           .when(d % 4 == 2, "n/a").otherwise(F.concat(F.lit("2024-03-0"), (d % 9 + 1).cast("string"), F.lit(" 10:00:00"))))
    return V.read(spark, sf_dir, "documents").select("doc_id", X.parse_iso_date(raw).cast("timestamp_ntz").alias("parsed"))


@query("scanned_page_detection", with_views("v_readings", body=f"""
select version_id, page_number, {n_words('native_text')} as native_words, {n_words('native_text')} < 15 as is_scanned from v_readings"""))
def scanned_page_detection(spark, sf_dir):
    n = F.col("native_text")
    return V.page_readings(spark, sf_dir).select(
        "version_id", "page_number", X.word_count(n).cast("bigint").alias("native_words"), X.is_scanned(n).alias("is_scanned"))


_OCR_WORDS = f"""select version_id, page_number, document_id, unnest(ws) as word, unnest(generate_series(0, len(ws) - 1)) as pos
 from (select *, {words('raw_text')} as ws from v_pages) where len(ws) > 0"""


@query("ocr_page_confidence", with_views("v_pages", extra={
    "o_words": _OCR_WORDS,
    "o_conf": "select *, (pos * 37 + document_id * 11) % 102 - 1 as conf from o_words",
    "o_agg": """select version_id, page_number, string_agg(word, ' ' order by pos) filter (where conf <> -1) as t,
      count(*) filter (where conf <> -1) as n, avg(conf) filter (where conf <> -1) as c from o_conf group by all"""},
    body="""select version_id, page_number, coalesce(t, '') as ocr_text, n as word_count,
 cast(printf('%.2f', coalesce(c, 0)) as double) as ocr_confidence, coalesce(c, 0) < 70 as requires_review,
 case when coalesce(c, 0) < 70 then printf('Low OCR confidence (%.1f%% < 70.0%%)', coalesce(c, 0)) end as review_reason from o_agg"""))
def ocr_page_confidence(spark, sf_dir):
    return ocr.ocr_pages(V.ocr_words(spark, sf_dir)).withColumn("word_count", F.col("word_count").cast("bigint"))


@query("native_ocr_merge", with_views("v_readings", extra={
    "m": f"select version_id, page_number, {clean_sql(chr(99) + 'oalesce(native_text, ' + chr(39) * 2 + ')')} as n, {clean_sql('coalesce(ocr_text, ' + chr(39) * 2 + ')')} as o from v_readings",
    "p": f"""select *, case when n <> '' and o <> '' then case when lower(n) = lower(o) then 'NATIVE'
       when {n_words('n')} >= 15 then 'NATIVE' when contains(lower(o), lower(n)) and {n_words('o')} > {n_words('n')} then 'OCR'
       when contains(lower(n), lower(o)) then 'NATIVE' else 'HYBRID' end when n <> '' then 'NATIVE' when o <> '' then 'OCR' else 'NATIVE' end as extraction_method from m"""},
    body="""select version_id, page_number, extraction_method,
 sha256(case when extraction_method = 'OCR' then o when extraction_method = 'HYBRID' then n || chr(10) || chr(10) || o else n end) as text_hash from p"""))
def native_ocr_merge(spark, sf_dir):
    m = X.merge_native_ocr(F.col("native_text"), F.col("ocr_text"))
    return V.page_readings(spark, sf_dir).withColumn("m", m).select(
        "version_id", "page_number", F.col("m.extraction_method").alias("extraction_method"), F.sha2("m.raw_text", 256).alias("text_hash"))


def _sql_pattern(p: str) -> str:
    return p.replace("'", "''")


HEADING_SQL = ("(s <> '' and length(s) <= 120 and (" + " or ".join(f"regexp_matches(s, '{_sql_pattern(p)}')" for p in C.HEADING_PATTERNS)
               + f" or (regexp_matches(s, '\\p{{Lu}}') and not regexp_matches(s, '[\\p{{Ll}}\\p{{Lt}}]') and {n_words('s')} <= 8 and length(s) >= 4)))")
TABLE_SQL = f"regexp_matches(s, '{_sql_pattern(C.TABLE_LINE)}')"
# Lines of the corpus are prose, so a share of them is dressed up as headings, rows and fields.
DRESSED_SQL = f"""select version_id, page_number, line_no, case line_no % 8
   when 1 then 'SECTION ' || line_no || ': ' || line when 3 then '| ' || line || ' |' when 4 then '' when 5 then 'Fee: ' || line
   when 6 then upper(replace(substr({strip('line')}, 1, 20), 'ß', 's')) else line end as line from v_lines"""


def dressed_pages(spark, sf_dir):
    """Pages whose lines are dressed up as headings, table rows, blanks and fields."""
    def dress(line, i):
        k = i % 8
        return (F.when(k == 1, F.concat(F.lit("SECTION "), i.cast("string"), F.lit(": "), line)).when(k == 3, F.concat(F.lit("| "), line, F.lit(" |")))
                .when(k == 4, "").when(k == 5, F.concat(F.lit("Fee: "), line))
                .when(k == 6, F.upper(F.replace(F.substring(X.strip(line), 1, 20), F.lit("ß"), F.lit("s")))).otherwise(line))
    p = V.pages(spark, sf_dir)
    return p.withColumn("raw_text", F.array_join(F.transform(F.split("raw_text", "\n"), dress), "\n"))


_LINES = {"dressed": DRESSED_SQL, "l": f"select *, {strip('line')} as s from dressed",
          "kinds": f"select *, case when {HEADING_SQL} then 'HEADING' when {TABLE_SQL} then 'TABLE' else 'PARAGRAPH' end as kind from l where s <> ''"}


@query("line_kinds", with_views("v_lines", extra=_LINES, body="select version_id, page_number, cast(line_no as int) as line_no, kind from kinds"))
def line_kinds(spark, sf_dir):
    return K.page_lines(dressed_pages(spark, sf_dir)).select("version_id", "page_number", "line_no", "kind")


@query("line_blocks", with_views("v_lines", extra={
    **_LINES,
    "b1": "select *, lag(kind) over w as pk, line_no - lag(line_no) over w > 1 as gap from kinds window w as (partition by version_id, page_number order by line_no)",
    "b2": """select *, sum(case when pk is null or kind = 'HEADING' or pk = 'HEADING' or pk <> kind or (kind = 'PARAGRAPH' and gap) then 1 else 0 end)
      over w as block_no, last_value(case when kind = 'HEADING' then trim(ltrim(s, '#')) end ignore nulls) over w as heading from b1
      window w as (partition by version_id, page_number order by line_no rows unbounded preceding)"""},
    body=f"""select version_id, page_number, cast(block_no as bigint) as block_no, min(kind) as kind, min(heading) as heading, count(*) as n_lines,
 sha256({strip("string_agg(case when kind = 'HEADING' then s else regexp_replace(line, '" + WS + "+$', '') end, chr(10) order by line_no)")}) as text_hash
from b2 group by version_id, page_number, block_no"""))
def line_blocks(spark, sf_dir):
    return K.line_blocks(dressed_pages(spark, sf_dir)).withColumn("text_hash", F.sha2("block_text", 256)).drop("block_text")


@query("meaningful_pages", with_views("v_pages", body=f"select version_id, page_number, {meaningful('raw_text')} as is_meaningful from v_pages"))
def meaningful_pages(spark, sf_dir):
    return V.pages(spark, sf_dir).select("version_id", "page_number", X.is_meaningful(F.col("raw_text")).alias("is_meaningful"))


_PLAIN_LINES = {"page_line": "select version_id, page_number, line_no, line from v_lines"}


def chunk_sql(body: str, size: int = C.CHUNK_MAX_WORDS, overlap: int = C.CHUNK_OVERLAP_WORDS, lines: str | None = None) -> str:
    """``body`` over the chunks of all pages, or of the lines that a query gives."""
    return packed_sql(body, {"page_line": lines} if lines else _PLAIN_LINES, size, overlap, HEADING_SQL, TABLE_SQL)


@query("page_chunks", chunk_sql(chunk_rows()))
def page_chunks(spark, sf_dir):
    return chunks(spark, sf_dir)


@query("page_chunks_carried_headings", chunk_sql(chunk_rows("carried"), lines=DRESSED_SQL))
def page_chunks_carried_headings(spark, sf_dir):
    return K.chunk_documents(dressed_pages(spark, sf_dir), carry_headings=True)


@query("oversize_pieces", chunk_sql(chunk_rows(), size=60, overlap=10))
def oversize_pieces(spark, sf_dir):
    """Small chunks, so that blocks are cut at sentences and word windows."""
    return K.chunk_documents(V.pages(spark, sf_dir), max_words=60, overlap=10)


@query("chunk_packing_rules", chunk_sql("""
select version_id, page_number, count(*) as n_chunks, cast(sum(length(t)) as bigint) as n_chars, min(sha256(t)) as min_hash, max(sha256(t)) as max_hash
from chunk group by version_id, page_number"""))
def chunk_packing_rules(spark, sf_dir):
    h = F.sha2("chunk_text", 256)
    return chunks(spark, sf_dir).groupBy("version_id", "page_number").agg(
        F.count("*").alias("n_chunks"), F.sum(F.length("chunk_text")).alias("n_chars"), F.min(h).alias("min_hash"), F.max(h).alias("max_hash"))


@query("document_processing_summary", with_views("v_readings", extra={
    "m": f"select version_id, {n_words('native_text')} < 15 as scanned, native_text as n, case when {n_words('native_text')} < 15 then coalesce(ocr_text, '') else '' end as o from v_readings",
    "p": f"""select *, case when {strip('n')} <> '' and {strip('o')} <> '' then case when lower({strip('n')}) = lower({strip('o')}) then 'NATIVE'
       when contains(lower(o), lower(n)) and {n_words('o')} > {n_words('n')} then 'OCR' when contains(lower(n), lower(o)) then 'NATIVE' else 'HYBRID' end
       when {strip('n')} <> '' then 'NATIVE' when {strip('o')} <> '' then 'OCR' else 'NATIVE' end as method from m"""},
    body="""select version_id, count(*) as n_pages, count(*) filter (where method = 'NATIVE') as n_native,
 count(*) filter (where method in ('OCR', 'HYBRID')) as n_ocr, count(*) filter (where scanned) as n_scanned from p group by version_id"""))
def document_processing_summary(spark, sf_dir):
    from folioground.operators.catalog import page_counts
    return page_counts(P.process_pages(V.page_readings(spark, sf_dir)), "version_id").select(
        "version_id", "n_pages", "n_native", "n_ocr", "n_scanned")


@query("failed_pages_kept", with_views("v_pages", body="""
select version_id, page_number, 'FAILED' as extraction_method, true as requires_review,
 'Page extraction error: unreadable page' as review_reason from v_pages where contains(raw_text, '|')"""))
def failed_pages_kept(spark, sf_dir):
    """A packer that refuses some pages: they stay as rows for review and the job goes on."""
    def refuse(text, max_words, overlap):
        if "|" in text:
            raise ValueError("unreadable page")
        return K.pack_page(text, max_words, overlap)
    merged = P.process_pages(V.pages(spark, sf_dir).withColumnRenamed("raw_text", "native_text").withColumn("ocr_text", F.lit(None).cast("string")))
    local = stage_table(K.chunk_pages(merged, pack=refuse), "refused")
    done = P.mark_failed_pages(merged, local.filter(F.col("error").isNotNull()))
    return done.filter("extraction_method = 'FAILED'").select("version_id", "page_number", "extraction_method", "requires_review", "review_reason")


@query("chunk_offsets_and_numbers", chunk_sql(f"select {CHUNK_ID}, version_id, page_number, chunk_index, cast(start as int) as start_char_offset, cast(stop as int) as end_char_offset from chunk", size=25, overlap=5))
def chunk_offsets_and_numbers(spark, sf_dir):
    """Offsets in the page and numbers in the version of many short chunks."""
    return K.chunk_documents(V.pages(spark, sf_dir), max_words=25, overlap=5).select(
        "vector_id", "version_id", "page_number", "chunk_index", "start_char_offset", "end_char_offset")
