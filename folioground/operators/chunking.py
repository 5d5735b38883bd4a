"""Page text to chunks: line blocks, packing, document-wide numbering, heading carry-over."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from folioground import constants as C
from folioground.functions import text as X
from folioground.staging import stage_table

PAGES_PER_BUCKET = 1024


# ---- lines and blocks as relations -------------------------------------------

def page_lines(pages: DataFrame) -> DataFrame:
    """One row per non-blank line of a page with its kind."""
    line = X.strip(F.col("line"))
    kind = (F.when(X.is_heading(F.col("stripped")), "HEADING")
            .when(X.is_table_line(F.col("stripped")), "TABLE").otherwise("PARAGRAPH"))
    return (
        pages.select("version_id", "page_number",
                     F.posexplode(F.split("raw_text", "\n")).alias("line_no", "line"))
        .withColumn("stripped", line)
        .filter(F.col("stripped") != "")
        .withColumn("kind", kind))


def line_blocks(pages: DataFrame) -> DataFrame:
    """Group the lines of each page into heading, table and paragraph blocks.

    A page is the bounded unit here: both windows and the regrouping stay inside one page.
    """
    by_page = Window.partitionBy("version_id", "page_number").orderBy("line_no")
    running = by_page.rowsBetween(Window.unboundedPreceding, 0)
    before, gap = F.lag("kind").over(by_page), F.col("line_no") - F.lag("line_no").over(by_page) > 1
    starts = (before.isNull() | (F.col("kind") == "HEADING") | (before == "HEADING")
              | (before != F.col("kind")) | ((F.col("kind") == "PARAGRAPH") & gap))
    lines = (
        page_lines(pages)
        .withColumn("starts", starts.cast("int"))
        .withColumn("block_no", F.sum("starts").over(running))
        .withColumn("heading", F.last(
            F.when(F.col("kind") == "HEADING", X.heading_text(F.col("stripped"))),
            ignorenulls=True).over(running)))
    kept = F.when(F.col("kind") == "HEADING", F.col("stripped")).otherwise(
        F.rtrim(F.col("line"), F.lit(X.WS_CHARS)))
    return (
        lines.groupBy("version_id", "page_number", "block_no")
        .agg(F.min("kind").alias("kind"), F.min("heading").alias("heading"),
             F.count("*").alias("n_lines"),
             F.array_sort(F.collect_list(F.struct("line_no", kept.alias("t")))).alias("ls"))
        .withColumn("block_text", X.strip(F.array_join(F.col("ls.t"), "\n")))
        .drop("ls"))


# ---- packing one page ---------------------------------------------------------

_HEADINGS = [re.compile(p) for p in C.HEADING_PATTERNS]
_TABLE = re.compile(C.TABLE_LINE)
_SENTENCE_GAP = re.compile(r"(?<=[.!?])\s+")


def _reads_as_heading(line: str) -> bool:
    if not line or len(line) > 120:
        return False
    if any(p.match(line) for p in _HEADINGS):
        return True
    return line.isupper() and len(line) >= 4 and len(line.split()) <= 8


def _blocks(text: str) -> Iterator[tuple[str, str, str | None]]:
    """(kind, text, heading) in page order. A blank line ends a paragraph, not a table."""
    run: list[str] = []
    run_kind, heading, gap = "", None, False
    for line in text.split("\n"):
        bare = line.strip()
        if not bare:
            gap = True
            continue
        kind = ("HEADING" if _reads_as_heading(bare)
                else "TABLE" if _TABLE.match(bare) else "PARAGRAPH")
        if run and (kind != run_kind or (gap and kind == "PARAGRAPH")):
            yield run_kind, "\n".join(run).strip(), heading
            run = []
        gap = False
        if kind == "HEADING":
            heading = bare.lstrip("#").strip()
            yield kind, bare, heading
        else:
            run.append(line.rstrip())
            run_kind = kind
    if run:
        yield run_kind, "\n".join(run).strip(), heading


def _oversize_pieces(text: str, size: int) -> Iterator[str]:
    """Sentences of a block; sentences above the size are cut into word windows."""
    for sentence in filter(None, (s.strip() for s in _SENTENCE_GAP.split(text))):
        tokens = sentence.split()
        if len(tokens) <= size:
            yield sentence
        else:
            for at in range(0, len(tokens), size):
                yield " ".join(tokens[at:at + size])


def _meaningful(text: str) -> bool:
    return (len(text.split()) >= C.CHUNK_MIN_WORDS
            and sum(map(str.isalnum, text)) >= C.CHUNK_MIN_ALNUM)


class _PagePacker:
    """Greedy packing of one page's blocks with an overlapping tail."""

    def __init__(self, max_words: int, overlap: int):
        self.max_words, self.overlap = max_words, overlap
        self.tokens: list[str] = []
        self.pieces: list[str] = []
        self.heading: str | None = None
        self.next_start = 0
        self.rows: list[dict] = []

    def room_for(self, n: int) -> bool:
        return not self.tokens or len(self.tokens) + n <= self.max_words

    def take(self, piece: str, tokens: list[str]) -> None:
        self.pieces.append(piece)
        self.tokens += tokens

    def close(self) -> None:
        if not self.tokens:
            return
        body = "\n\n".join(self.pieces).strip()
        tail: list[str] = []
        if _meaningful(body):
            compat = unicodedata.normalize("NFKC", body)
            end = self.next_start + len(body)
            self.rows.append({
                "idx_in_page": len(self.rows), "section_heading": self.heading,
                "chunk_text": body, "compat_text": None if compat == body else compat,
                "start_char_offset": self.next_start, "end_char_offset": end})
            self.next_start = end + 1
            if 0 < self.overlap < len(self.tokens):
                tail = self.tokens[-self.overlap:]
        self.tokens, self.pieces = list(tail), [" ".join(tail)] if tail else []

    def feed(self, kind: str, text: str, heading: str | None) -> None:
        self.heading = heading or self.heading
        tokens = text.split()
        if kind == "HEADING":
            self.take(text, tokens)
            return
        if not self.room_for(len(tokens)):
            self.close()
        if len(tokens) <= self.max_words:
            self.take(text, tokens)
            return
        for piece in _oversize_pieces(text, self.max_words):
            piece_tokens = piece.split()
            if not self.room_for(len(piece_tokens)):
                self.close()
            self.take(piece, piece_tokens)
            if len(self.tokens) >= self.max_words:
                self.close()


def pack_page(text: str | None, max_words: int = C.CHUNK_MAX_WORDS,
              overlap: int = C.CHUNK_OVERLAP_WORDS) -> list[dict]:
    packer = _PagePacker(max_words, overlap)
    for block in _blocks(text or ""):
        packer.feed(*block)
    packer.close()
    return packer.rows


# ---- packing a table of pages ---------------------------------------------------

_LOCAL = T.StructType([
    T.StructField("version_id", T.StringType()), T.StructField("page_number", T.IntegerType()),
    T.StructField("idx_in_page", T.IntegerType()), T.StructField("section_heading", T.StringType()),
    T.StructField("chunk_text", T.StringType()), T.StructField("compat_text", T.StringType()),
    T.StructField("start_char_offset", T.IntegerType()),
    T.StructField("end_char_offset", T.IntegerType()), T.StructField("error", T.StringType())])


def chunk_pages(pages: DataFrame, max_words: int = C.CHUNK_MAX_WORDS,
                overlap: int = C.CHUNK_OVERLAP_WORDS,
                pack: Callable[..., list[dict]] = pack_page) -> DataFrame:
    """Chunks numbered inside their page. Pages are independent, so nothing is shuffled.

    A page that cannot be packed yields one row with ``error`` set; the job goes on.
    """
    columns = [f.name for f in _LOCAL]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), X.ROWS_AT_ONCE):
                part, out = batch.iloc[at: at + X.ROWS_AT_ONCE], []
                for version, page, text in zip(part.version_id, part.page_number, part.raw_text):
                    try:
                        rows = pack(text, max_words, overlap)
                    except Exception as failure:  # one bad page must not fail the job
                        rows = [{"idx_in_page": -1, "error": f"Page extraction error: {failure}",
                                 "chunk_text": f"Extraction failed for page {page}."}]
                    out += [{"version_id": version, "page_number": page, **r} for r in rows]
                frame = pd.DataFrame(out, columns=columns).astype(object)
                yield frame.where(frame.notna(), None)

    return pages.select("version_id", "page_number", "raw_text").mapInPandas(run, _LOCAL)


def number_chunks(local: DataFrame, carry_headings: bool = False, of_version: DataFrame | None = None) -> DataFrame:
    """Give page-local chunks their document-wide index and, if asked, carry headings over pages.

    Columns of ``of_version``, by version_id, come along with the page totals, so the text moves once for both.
    ``local`` must be cheap to read twice (a staged table). Running totals go over page
    summaries in two levels, buckets of pages and pages of a bucket, so no task ever holds all
    rows of a large version; the chunk text itself moves once, on the unique page key.
    """
    per_page = (
        local.groupBy("version_id", "page_number")
        .agg(F.count("*").alias("n"),
             F.max_by("section_heading", F.when(F.col("section_heading").isNotNull(),
                                                F.col("idx_in_page"))).alias("last_heading"))
        .withColumn("bucket", F.floor(F.col("page_number") / PAGES_PER_BUCKET)))
    earlier = (Window.unboundedPreceding, -1)
    over_buckets = Window.partitionBy("version_id").orderBy("bucket").rowsBetween(*earlier)
    over_pages = Window.partitionBy("version_id", "bucket").orderBy("page_number").rowsBetween(*earlier)
    buckets = (
        per_page.groupBy("version_id", "bucket")
        .agg(F.sum("n").alias("bn"),
             F.max_by("last_heading", F.when(F.col("last_heading").isNotNull(),
                                             F.col("page_number"))).alias("bh"))
        .select("version_id", "bucket",
                F.coalesce(F.sum("bn").over(over_buckets), F.lit(0)).alias("bucket_start"),
                F.last("bh", ignorenulls=True).over(over_buckets).alias("bucket_heading")))
    starts = (
        per_page
        .withColumn("in_bucket", F.coalesce(F.sum("n").over(over_pages), F.lit(0)))
        .withColumn("page_heading", F.last("last_heading", ignorenulls=True).over(over_pages))
        .join(buckets, ["version_id", "bucket"])
        .select("version_id", "page_number",
                (F.col("bucket_start") + F.col("in_bucket")).alias("page_start"),
                F.coalesce("page_heading", "bucket_heading").alias("carried")))
    if of_version is not None:
        starts = starts.join(of_version, "version_id").hint("shuffle_hash")  # rows of pages are held, the texts are not sorted
    heading = (F.coalesce("section_heading", "carried") if carry_headings
               else F.col("section_heading"))
    return (
        local.join(starts, ["version_id", "page_number"])
        .withColumn("chunk_index", (F.col("page_start") + F.col("idx_in_page")).cast("int"))
        .withColumn("section_heading", heading)
        .drop("page_start", "carried"))


def _identified(numbered: DataFrame, *more: Column | str) -> DataFrame:
    return numbered.select(
        X.vector_id(F.col("version_id"), F.col("page_number"), F.col("chunk_index")).alias("vector_id"),
        "version_id", "page_number", F.col("page_number").cast("string").alias("page_range"),
        "chunk_index", "section_heading", "chunk_text", *more)


def chunk_texts(numbered: DataFrame, *more: str) -> DataFrame:
    """Numbered chunks with what their search text is derived from, each text once, and some columns of their version."""
    return _identified(numbered, "compat_text", *more)


def describe_chunks(numbered: DataFrame) -> DataFrame:
    """Search text, counts, page range and vector id of numbered chunks."""
    n = X.word_count(F.col("chunk_text"))
    return _identified(
        numbered,
        X.fold_for_search(F.coalesce("compat_text", "chunk_text")).alias("normalized_text"),
        n.alias("word_count"), X.token_estimate(n).alias("token_count"),
        "start_char_offset", "end_char_offset")


def chunk_documents(pages: DataFrame, max_words: int = C.CHUNK_MAX_WORDS,
                    overlap: int = C.CHUNK_OVERLAP_WORDS, carry_headings: bool = False) -> DataFrame:
    """Pages to finished chunks. The packed text is written once and read by both passes."""
    local = stage_table(chunk_pages(pages, max_words, overlap), "page_chunks")
    return describe_chunks(number_chunks(local.filter(F.col("error").isNull()), carry_headings))


def register_chunk_text(spark) -> None:
    """SQL table function ``chunk_text(text, max_words, overlap)`` for LATERAL use."""

    class ChunkText:
        def eval(self, text: str, max_words: int, overlap: int):
            for r in pack_page(text, max_words, overlap):
                yield r["idx_in_page"], r["section_heading"], r["chunk_text"]

    udtf = F.udtf(ChunkText, returnType="idx_in_page int, section_heading string, chunk_text string")
    spark.udtf.register("chunk_text", udtf)
