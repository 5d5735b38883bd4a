"""Page text and chunking: hand-made facts, invariants on the corpus, and a brute-force check."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from folioground.functions import text as X
from folioground.operators import chunking as K, ocr
from folioground.plans import ingest as P
from folioground.sources import views as V
from folioground.staging import stage_table


def values(spark, texts, *exprs):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [tuple(r)[1:] for r in df.select("i", *[e(F.col("t")).alias(f"c{k}") for k, e in enumerate(exprs)]).orderBy("i").collect()]


HEADINGS = {
    "3. Wells and pumps": True, "SECTION 12: COLOURS OF BOATS": True, "### Where to queue": True, "LAMPS AND OIL": True,
    "Documents Required:": True, "The ferry leaves when the tide is high enough for it, and waits for nobody.": False,
    "ELIGIBILITY: x": True, "abc": False, "": False, "A" * 121: False, "Clause 7 - scope": True, "NOTE": True, "ABC": False,
}


def test_headings_agree_in_sql_and_kernel(spark):
    got = values(spark, list(HEADINGS), X.is_heading)
    assert [g[0] for g in got] == list(HEADINGS.values())
    assert [K._reads_as_heading(h) for h in HEADINGS] == list(HEADINGS.values())


def test_table_lines(spark):
    lines = ["| a | b |", "Income limit: 3 lakh", "- Age limit: 60", "plain words only", "a | b"]
    want = [True, True, True, False, False]
    assert [g[0] for g in values(spark, lines, X.is_table_line)] == want
    assert [bool(K._TABLE.match(x)) for x in lines] == want


def test_search_normalisation(spark):
    raw = "RULE 4: Boatmen's «Night-Shift» pay = 75%; see /b/7.2, page 3: OK? $5 #tag @home"
    got = values(spark, [raw], X.normalize_for_search)
    assert got[0][0] == "rule 4: boatmen s night-shift pay 75%; see /b/7.2, page 3: ok 5 tag home"
    rest = values(spark, ["ﬁne １２ café ok", "", None], X.normalize_for_search)
    assert [r[0] for r in rest] == ["fine 12 café ok", "", ""]


def test_structure_cleaning(spark):
    messy = "  Tide table \r\n\r\n\r\nlow at six\t\n\n \n\nhigh at noon"
    got = values(spark, [messy, "\n\n  a  \n \n\t\nb\r", None], X.clean_structure)
    assert [g[0] for g in got] == ["Tide table\n\nlow at six\n\nhigh at noon", "a\n\nb", ""]


def test_native_ocr_merge(spark):
    long = "Nets are dried on the north wall from eight until ten, and on the south wall from two until the evening bell."
    pairs = [(long, long, long, "NATIVE"), ("", "Stamp of the harbour, red ink.", "Stamp of the harbour, red ink.", "OCR"),
             ("Pier two", "pier two Ropes are counted at dawn", "pier two Ropes are counted at dawn", "OCR"),
             ("Pier two and its ropes", "pier TWO", "Pier two and its ropes", "NATIVE"), ("left part", "right part", "left part\n\nright part", "HYBRID"),
             (None, None, "", "NATIVE"), (long, "something else entirely", long, "NATIVE")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, n string, o string, t string, m string")
    got = df.withColumn("x", X.merge_native_ocr(F.col("n"), F.col("o"))).orderBy("i").collect()
    assert [(r.x.raw_text, r.x.extraction_method) for r in got] == [(p[2], p[3]) for p in pairs]


def test_meaningful(spark):
    texts = ["five plain words stand here", "only two", " \t ", "+++ ~~~ ,,, ;;; ===", "7 8 9", "v w x y z"]
    assert [g[0] for g in values(spark, texts, X.is_meaningful)] == [True, False, False, False, False, False]


def test_location_dates_and_rounding(spark):
    got = values(spark, ["Maharashtra - Pune", "National / All States", "All - India", "Goa", None], lambda c: X.split_location(c))
    assert [(g[0].state, g[0].district) for g in got] == [
        ("Maharashtra", "Pune"), ("National", "All States"), ("All - India", "All"), ("Goa", "All"), ("National", "All")]
    dates = values(spark, ["2024-05-01", "2024-05-01T10:00:00Z", "soon", None], X.parse_iso_date)
    assert [str(d[0]) for d in dates] == ["2024-05-01 00:00:00", "2024-05-01 10:00:00", "None", "None"]
    numbers = [0.125, 0.375, 49.65, 49.25, 0.15, 2.675, 1.005, 0.0, 0.89375, 12.345]
    df = spark.createDataFrame([(float(x),) for x in numbers], "x double")
    for digits in (1, 2, 4):
        got = [r[0] for r in df.select(X.exact_round(F.col("x"), digits)).collect()]
        assert got == [round(x, digits) for x in numbers]


TIDES = ("MOORING FEES\nFees are due on arrival of the boat.\n| Length | Day | Week |\n| up to 6 m | 4 | 20 |\n| up to 9 m | 7 | 35 |\n"
         "| longer | 12 | 60 |\n\nLate boats pay at the bell.")


def test_table_rows_stay_together():
    rows = K.pack_page(TIDES, 200)
    assert len(rows) == 1
    table = "| Length | Day | Week |\n| up to 6 m | 4 | 20 |\n| up to 9 m | 7 | 35 |\n| longer | 12 | 60 |"
    assert table in rows[0]["chunk_text"] and rows[0]["section_heading"] == "MOORING FEES"


def test_headings_reach_their_chunks():
    text = "SECTION 7: ROPES\n\none two three four five six seven.\n\nSECTION 8: NETS\n\neight nine ten eleven twelve thirteen fourteen."
    rows = K.pack_page(text, 12, 0)
    # A heading read before an overflow belongs to the chunk that is closed by it.
    assert [(r["section_heading"], r["chunk_text"]) for r in rows] == [
        ("SECTION 8: NETS", "SECTION 7: ROPES\n\none two three four five six seven.\n\nSECTION 8: NETS"), ("SECTION 8: NETS", "eight nine ten eleven twelve thirteen fourteen.")]


@pytest.mark.parametrize("size,overlap,spans", [
    (10, 0, [(i, i + 10) for i in range(0, 80, 10)]),  # the last three words are too few
    (7, 2, [(i, min(i + 7, 83)) for i in range(0, 83, 7)]),  # so are tails of two words
    (25, 9, [(0, 25), (16, 25), (25, 50), (41, 50), (50, 75), (66, 83)])])  # a tail that no full window fits behind is closed alone
def test_windows_of_one_long_sentence(size, overlap, spans):
    words = [f"rope{i:03d}" for i in range(83)]
    got = [r["chunk_text"].split() for r in K.pack_page(" ".join(words), size, overlap)]
    assert got == [words[i:j] for i, j in spans]


def test_dropped_chunk_leaves_no_overlap():
    rows = K.pack_page("! ! ! ! ! !\n\nReal sentence with enough words to be kept here.", 6, 2)
    assert [r["chunk_text"] for r in rows] and not any("!" in r["chunk_text"] for r in rows)


def test_blank_pages_give_nothing():
    assert K.pack_page("") == [] and K.pack_page("  \n ") == [] and K.pack_page(None) == []


def test_corpus_invariants(spark, sf_dir):
    pages = {(r.version_id, r.page_number): r.raw_text for r in V.pages(spark, sf_dir).collect()}
    chunks = K.chunk_documents(V.pages(spark, sf_dir), 80, 10).collect()
    assert len({c.vector_id for c in chunks}) == len(chunks)
    by_version = {}
    for c in chunks:
        words, page = c.chunk_text.split(), pages[c.version_id, c.page_number].split()
        assert set(words) <= set(page) and c.word_count == len(words)
        by_version.setdefault(c.version_id, []).append((c.chunk_index, c.page_number))
    for got in by_version.values():
        got.sort()
        assert [i for i, _ in got] == list(range(len(got)))
        assert [p for _, p in got] == sorted(p for _, p in got)


def test_numbers_over_many_buckets(spark, monkeypatch):
    """Two-level totals agree with plain counting when pages fill several buckets."""
    monkeypatch.setattr(K, "PAGES_PER_BUCKET", 3)
    rows = [("v", p, i, f"H{p}" if p % 4 == 0 else None) for p in range(1, 20) for i in range(p % 3)]
    local = spark.createDataFrame(rows, "version_id string, page_number int, idx_in_page int, section_heading string")
    got = [(r.page_number, r.idx_in_page, r.chunk_index, r.section_heading)
           for r in K.number_chunks(local, carry_headings=True).orderBy("chunk_index").collect()]
    heading, want = None, []
    for n, (_, p, i, h) in enumerate(rows):
        heading = h or heading
        want.append((p, i, n, h or heading))
    assert got == want


def test_no_shuffle_before_numbering(spark, sf_dir):
    plan = K.chunk_pages(V.cut_pages(spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr(
        "cast(doc_id as string) version_id", "doc_id document_id", "text")))._jdf.queryExecution().toString()
    assert "Exchange" not in plan


def test_bad_page_does_not_stop_the_job(spark):
    pages = spark.createDataFrame([("v", 1, 1, "good page with quite enough words in it"), ("v", 1, 2, "boom")],
                                  "version_id string, document_id long, page_number int, native_text string").withColumn("ocr_text", F.lit(None).cast("string"))

    def pack(text, m, o):
        if text == "boom":
            raise ValueError("torn")
        return K.pack_page(text, m, o)
    merged = P.process_pages(pages)
    local = stage_table(K.chunk_pages(merged, pack=pack), "t")
    done = {r.page_number: r for r in P.mark_failed_pages(merged, local.filter("error is not null")).collect()}
    assert done[2].extraction_method == "FAILED" and done[2].requires_review and "torn" in done[2].review_reason
    assert done[1].extraction_method == "NATIVE"


def test_ocr_readings(spark):
    rows = [("v", 1, 0, "Hello", 90), ("v", 1, 1, "  ", 95), ("v", 1, 2, "world", 51), ("v", 1, 3, "lost", -1), ("v", 2, 0, "", 10)]
    got = {r.page_number: r for r in ocr.ocr_pages(spark.createDataFrame(rows, "version_id string, page_number int, pos int, word string, conf int")).collect()}
    assert (got[1].ocr_text, got[1].ocr_confidence, got[1].requires_review) == ("Hello world", 70.5, False)
    assert (got[2].ocr_text, got[2].ocr_confidence, got[2].word_count) == ("", 0.0, 0)
    assert got[2].review_reason == "Low OCR confidence (0.0% < 70.0%)"


@pytest.mark.parametrize("text", ["One. Two! Three? Four", "no stop here", "A.B. c"])
def test_sentence_pieces(text):
    assert list(K._oversize_pieces(text, 100)) == [s for s in re.split(r"(?<=[.!?])\s+", text) if s]


def test_python_functions_give_rows_back_in_parts():
    """A batch of any size leaves the text functions a few rows at a time: memory follows these, not the batch."""
    from folioground.functions import vectors as VX
    texts = pd.Series([f"ﬁle {i} of the scheme" if i % 3 else None for i in range(1000)])
    made = list(X._nfkc.func(iter([texts])))
    assert max(map(len, made)) <= 256
    assert [t for m in made for t in m] == [f"file {i} of the scheme" if i % 3 else None for i in range(1000)]
    vectors = list(VX.hashing_embedder(16).func(iter([texts])))
    assert max(map(len, vectors)) <= 256
    assert np.array_equal(np.stack([v for m in vectors for v in m]), VX._hash_batch(texts, 16))

    class Pages:
        def select(self, *columns):
            return self

        def mapInPandas(self, run, schema):
            return run

    pages = pd.DataFrame({"version_id": "v", "page_number": range(1000), "raw_text": "some words of a page that is long enough to be kept as one chunk of text " * 3})
    parts = list(K.chunk_pages(Pages())(iter([pages])))
    assert max(p.page_number.nunique() for p in parts) <= 256
    assert [n for p in parts for n in p.page_number] == list(range(1000))


def test_sql_of_packing_closes_a_chunk_once():
    """A block that has no room beside the tail of the chunk before it is taken all the same: no chunk of the tail alone."""
    import duckdb

    import __spark_entry__ as entry
    text = "\n\n".join(" ".join(f"{name}{i}" for i in range(340)) for name in ("first", "second", "third"))
    con = duckdb.connect()
    con.execute("create table documents as select 3::bigint as doc_id, ? as text, 'en' as lang, 'src1' as source, 1::bigint as n_chars", [text])
    got = con.execute(entry.oracle_sql()["chunk_packing_rules"]).fetchall()
    rows = K.pack_page(text)
    assert [(r[2], r[3]) for r in got] == [(len(rows), sum(len(r["chunk_text"]) for r in rows))] and len(rows) == 3
