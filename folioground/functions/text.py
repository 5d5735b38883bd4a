"""Column expressions over page and line text."""

from __future__ import annotations

import unicodedata
from typing import Iterator

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from folioground import constants as C

# White space as Unicode text processing counts it, as a character class and as characters.
WS = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
NOT_WS = r"[^\t-\r\x1c-\x20\x{85}\p{Z}]"
WS_CHARS = "".join(
    chr(c) for c in [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680,
                     *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WS_CHARS))


def words(text: Column) -> Column:
    """Whitespace-delimited words of a text, in order."""
    return F.regexp_extract_all(text, F.lit(NOT_WS + "+"), F.lit(0))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(NOT_WS + "+")), F.lit(0))


def token_estimate(n_words: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(n_words * F.lit(1.3)).cast("int"))


#: Rows that leave a Python function together, so its memory follows them and not the batch it is given.
ROWS_AT_ONCE = 256


@F.pandas_udf(T.StringType())
def _nfkc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        for at in range(0, len(texts), ROWS_AT_ONCE):
            yield texts.iloc[at: at + ROWS_AT_ONCE].map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(text: Column) -> Column:
    """Compatibility normal form. ASCII is already normal, so only other texts go to Python."""
    return F.coalesce(_nfkc(F.when(F.octet_length(text) != F.length(text), text)), text)


def compat_text(text: Column) -> Column:
    """The compatibility normal form where it is another text, else null."""
    normal = _nfkc(F.when(F.octet_length(text) != F.length(text), text))
    return F.when(normal != text, normal)


#: Characters that search text does not keep.
NOT_SEARCHED = r"[^\p{L}\p{N}_\t-\r\x1c-\x20\x{85}\p{Z}.,\-%/:;]"


#: What it keeps besides blanks.
SEARCHED = r"[\p{L}\p{N}_.,\-%/:;]"


def fold_for_search(text: Column) -> Column:
    """Lower case, keep word characters and ``. , - % / : ;``, one blank between words."""
    kept = F.regexp_replace(F.lower(text), NOT_SEARCHED, " ")
    return F.coalesce(strip(F.regexp_replace(kept, WS + "+", " ")), F.lit(""))


def search_word_count(text: Column) -> Column:
    """The words of ``fold_for_search``, counted in one pass: runs of what it keeps and is no blank."""
    return F.coalesce(F.regexp_count(F.lower(text), F.lit(SEARCHED + "+")), F.lit(0))


def normalize_for_search(text: Column) -> Column:
    return fold_for_search(nfkc(text))


def clean_structure(text: Column) -> Column:
    """Unix line ends, stripped lines, at most one blank line in a row."""
    unix = F.regexp_replace(text, r"\r\n?", "\n")
    lines = F.transform(F.split(unix, "\n"), strip)
    joined = F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n")
    return F.coalesce(strip(joined), F.lit(""))


def truncate(text: Column, limit: int, mark: str = "...") -> Column:
    cut = F.substring(text, 1, limit)
    if mark:
        cut = F.concat(cut, F.lit(mark))
    return F.when(F.length(text) > limit, cut).otherwise(text)


def exact_round(value: Column, digits: int) -> Column:
    """Round by the exact binary value, true ties to the even digit.

    Near a midpoint the error of ``value * 2 * 10^digits`` decides. It is found without loss by
    splitting the value into a 24-bit head and its rest, whose products are exact.
    """
    steps = F.lit(float(2 * 10 ** digits))
    head = value.cast("float").cast("double")
    k = F.rint(value * steps)
    off = (head * steps - k) + (value - head) * steps
    down, up = (k - 1) / 2, (k + 1) / 2
    tie = F.when(off > 0, up).when(off < 0, down).otherwise(F.when(down % 2 == 0, down).otherwise(up))
    near = (F.abs(off) < 1e-6) & (k % 2 != 0)
    return F.when(near, tie).otherwise(F.rint(value * F.lit(float(10 ** digits)))) / F.lit(float(10 ** digits))


def fixed(value: Column, digits: int) -> Column:
    """Text with a fixed number of decimals, rounded exactly."""
    return F.format_string(f"%.{digits}f", exact_round(value, digits))


def is_upper(text: Column) -> Column:
    return text.rlike(r"\p{Lu}") & ~text.rlike(r"[\p{Ll}\p{Lt}]")


def is_heading(line: Column) -> Column:
    """A stripped line that reads like a section heading."""
    by_pattern = F.lit(False)
    for pattern in C.HEADING_PATTERNS:
        by_pattern = by_pattern | line.rlike("(?U)" + pattern)
    short_caps = is_upper(line) & (word_count(line) <= 8) & (F.length(line) >= 4)
    return (line != "") & (F.length(line) <= 120) & (by_pattern | short_caps)


def is_table_line(line: Column) -> Column:
    return line.rlike("(?U)" + C.TABLE_LINE)


def heading_text(line: Column) -> Column:
    return strip(F.ltrim(line, F.lit("#")))


def is_meaningful(text: Column) -> Column:
    letters = F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))
    return (word_count(text) >= C.CHUNK_MIN_WORDS) & (letters >= C.CHUNK_MIN_ALNUM)


def content_words(text: Column) -> Column:
    """Distinct lower-case words of three characters or more, stop words removed."""
    found = F.regexp_extract_all(F.lower(text), F.lit("(?U)" + C.CONTENT_WORD), F.lit(0))
    return F.array_except(F.array_distinct(found), F.array(*[F.lit(w) for w in C.STOPWORDS]))


def all_words(text: Column) -> Column:
    """Distinct lower-case words of three characters or more."""
    return F.array_distinct(
        F.regexp_extract_all(F.lower(text), F.lit("(?U)" + C.CONTENT_WORD), F.lit(0)))


def is_scanned(native_text: Column) -> Column:
    return word_count(native_text) < C.MIN_NATIVE_WORDS


def merge_native_ocr(native: Column, ocr: Column) -> Column:
    """struct(raw_text, extraction_method) from two readings of one page."""
    n, o = clean_structure(F.coalesce(native, F.lit(""))), clean_structure(F.coalesce(ocr, F.lit("")))
    return merge_clean_texts(n, o)


def merge_clean_texts(n: Column, o: Column) -> Column:
    n_low, o_low = F.lower(n), F.lower(o)

    def pick(text: Column, method: str) -> Column:
        return F.struct(text.alias("raw_text"), F.lit(method).alias("extraction_method"))

    both = (
        F.when(n_low == o_low, pick(n, "NATIVE"))
        .when(word_count(n) >= C.MIN_NATIVE_WORDS, pick(n, "NATIVE"))
        .when(F.contains(o_low, n_low) & (word_count(o) > word_count(n)), pick(o, "OCR"))
        .when(F.contains(n_low, o_low), pick(n, "NATIVE"))
        .otherwise(pick(clean_structure(F.concat(n, F.lit("\n\n"), o)), "HYBRID")))
    return (
        F.when((n != "") & (o != ""), both)
        .when(n != "", pick(n, "NATIVE"))
        .when(o != "", pick(o, "OCR"))
        .otherwise(pick(F.lit(""), "NATIVE")))


def split_location(location: Column) -> Column:
    """struct(state, district) of a free-form place text."""
    raw = F.coalesce(F.nullif(location, F.lit("")), F.lit("National"))
    slash, dash = F.split(raw, "/", 2), F.split(raw, "-", 2)

    def pair(a: Column, b: Column) -> Column:
        return F.struct(a.alias("state"), b.alias("district"))

    return (
        F.when(F.contains(raw, F.lit("/")), pair(strip(F.get(slash, F.lit(0))), strip(F.get(slash, F.lit(1)))))
        .when(F.contains(raw, F.lit("-")) & ~F.contains(raw, F.lit("All")),
              pair(strip(F.get(dash, F.lit(0))), strip(F.get(dash, F.lit(1)))))
        .otherwise(pair(raw, F.lit("All"))))


def vector_id(version_id: Column, page_number: Column, chunk_index: Column) -> Column:
    return F.concat_ws(":", version_id, page_number.cast("string"), chunk_index.cast("string"))


def namespace(collection_id: Column, prefix: str = C.NAMESPACE_PREFIX) -> Column:
    given = F.nullif(collection_id.cast("string"), F.lit(""))
    return F.when(given.isNotNull(), F.concat(F.lit(prefix + ":"), given)).otherwise(F.lit(prefix))


def page_artifact_key(document_id: Column, version_number: Column, page_number: Column) -> Column:
    return F.format_string("page-artifacts/%s/v%d/pages/page-%03d.webp",
                           document_id.cast("string"), version_number, page_number)


def storage_key(slug: Column, filename: Column) -> Column:
    return F.concat(F.lit("raw-documents/"), slug, F.lit("/"), filename)


def document_title(scheme_name: Column, version_number: Column) -> Column:
    return F.concat(scheme_name, F.lit(" (v"),
                    F.coalesce(version_number, F.lit(1)).cast("string"), F.lit(")"))


def date_text(version_date: Column, document_date: Column) -> Column:
    return F.date_format(F.coalesce(version_date, document_date), "yyyy-MM-dd HH:mm:ss")


def parse_iso_date(text: Column) -> Column:
    """ISO date or date-time, ``Z`` accepted; anything else is null."""
    return F.try_to_timestamp(F.regexp_replace(strip(text), "Z$", "+00:00"))
