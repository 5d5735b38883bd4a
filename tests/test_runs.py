"""Whole runs on small inputs: the log of an answer run and ingestion that fails for some versions."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from folioground import constants as C
from folioground.operators import citations as CI, grounding as G
from folioground.plans import answer_log as L, jobs as JB
from folioground.staging import stage_path, stage_table
from folioground.streaming import jobs as J

ASKED = "query_id int, query string, collection_id string, session_token string, asked_at int"
PASSAGE = "query_id int, rank int, document_id int, document_title string, version_id string, page_number int, section_heading string, excerpt string, score double"
CHECK = "query_id int, citation_index int, document_id int, document_title string, page_number int, is_valid boolean, error_reason string"
TITLE, TEXT = "Orchard Rules (v1)", "Every orchard near the lake keeps four rows of walnut trees along its northern fence."


def facts_of(spark, run_id, asked, marks, checks, refused=()):
    """Facts of a run whose answers quote the first passage of each question; ``refused`` ones have none."""
    marks = spark.createDataFrame(marks, PASSAGE)
    checks = spark.createDataFrame(checks, CHECK)
    answers = G.extractive_answers(marks)
    given = answers.select("query_id", "answer", F.lit(False).alias("is_refusal"), F.lit(True).alias("grounding_verified"))
    none = spark.createDataFrame([(q, C.NO_ANSWER_PLAIN, True, True) for q in refused], "query_id int, answer string, is_refusal boolean, grounding_verified boolean")
    final = stage_table(CI.reconcile(answers, marks, checks), "final")
    return L.run_facts(spark.createDataFrame(asked, ASKED), given.unionByName(none), marks, checks, final, run_id)


def mark(q, rank, document=1, page=2):
    return (q, rank, document, TITLE, "v", page, None, TEXT, 0.75)


def check(q, at, ok=True, document=1):
    return (q, at, document, TITLE, 2, ok, None if ok else "INVALID_PAGE_NUMBER")


def dump(spark, root):
    return {t: sorted(map(str, L.read_log(spark, root, t).drop("run_id").toJSON().collect())) for t in L.TABLES}


def first_run(spark):
    asked = [(1, "which trees", "lake", "ann", 5), (2, "which fence", "hill", "ann", 4), (3, "what else", "lake", "", 1),
             (4, "how many rows", "lake", "bob", 9), (5, "never ran", "lake", "cat", 1)]
    marks = [mark(1, 1), mark(1, 2), mark(2, 1, document=-1), mark(4, 1)]
    checks = [check(1, 0), check(1, 1, ok=False), check(2, 0, document=-1), check(4, 0, ok=False)]
    return facts_of(spark, "one", asked, marks, checks, refused=[3])


def test_log_of_a_run_and_its_replay(spark):
    root, docs = stage_path(spark, "log"), spark.createDataFrame([(1,)], "document_id int")
    counts = L.write_run(first_run(spark), docs, root, "one")
    assert counts == {"answers": 4, "refusals": 1, "supported_citations": 2, "rejected_citations": 2, "claims": 2}
    before = dump(spark, root)
    assert L.write_run(first_run(spark), docs, root, "one") == counts and dump(spark, root) == before
    sessions = {r.session_token: (r.collection_id, r.created_at) for r in L.read_log(spark, root, "sessions").collect()}
    assert sessions == {"ann": ("hill", 4), "bob": ("lake", 9)}  # the first question; no session for an empty token
    answers = {r.qa_id: r for r in L.read_log(spark, root, "answers").collect()}
    assert set(answers) == {"one:1", "one:2", "one:3", "one:4"}
    assert answers["one:3"].session_token is None and answers["one:3"].is_refusal
    assert answers["one:4"].answer == C.NO_ANSWER_BAD_CITATIONS and not answers["one:4"].is_refusal
    # Question 2 cites a document that is not in the catalog: supported, but not kept.
    assert [(r.qa_id, r.rank) for r in L.read_log(spark, root, "citations").collect()] == [("one:1", 1)]
    reports = {r.qa_id: r for r in L.read_log(spark, root, "reports").collect()}
    assert set(reports) == {"one:1", "one:2", "one:4"}
    assert [d.is_valid for d in reports["one:1"].details] == [True, False] and reports["one:1"].has_unsupported_claims
    assert [w.split(" ")[0] for w in reports["one:1"].warnings] == ["Citation", "Notice:"]
    assert list(reports["one:2"].warnings) == [] and not reports["one:2"].has_unsupported_claims
    assert reports["one:4"].warnings[-1] == C.WARN_NO_CITATION


def test_second_run_keeps_sessions_and_first_run_may_be_written_again(spark):
    root, docs = stage_path(spark, "log"), spark.createDataFrame([(1,)], "document_id int")
    L.write_run(first_run(spark), docs, root, "one")
    second = facts_of(spark, "two", [(1, "which trees", "road", "ann", 1), (2, "how many", "road", "dan", 2)], [mark(1, 1)], [check(1, 0)], refused=[2])
    L.write_run(second, docs, root, "two")
    both = dump(spark, root)
    L.write_run(first_run(spark), docs, root, "one")
    assert dump(spark, root) == both
    held = {(r.session_token, r.collection_id, r.run_id) for r in L.read_log(spark, root, "sessions").collect()}
    assert held == {("ann", "hill", "one"), ("bob", "lake", "one"), ("dan", "road", "two")}


def test_empty_run(spark):
    root, docs = stage_path(spark, "log"), spark.createDataFrame([], "document_id int")
    nothing = facts_of(spark, "none", [], [], [])
    assert set(L.write_run(nothing, docs, root, "none").values()) == {0}
    assert all(rows == [] for rows in dump(spark, root).values())
    with pytest.raises(ValueError):
        L.write_run(nothing, docs, root, "../up")


def test_strict_answers_refuse_without_passages(spark):
    got = G.strict_answers(spark.createDataFrame([(1,), (2,)], "query_id int"), spark.createDataFrame([mark(1, 3)], PASSAGE))
    rows = {r.query_id: r for r in got.collect()}
    assert TEXT in rows[1].answer and not rows[1].is_refusal
    assert rows[2].answer == C.NO_ANSWER_NO_PASSAGE and rows[2].is_refusal


# ---- ingestion ------------------------------------------------------------------------------

REQUEST = "document_id int, version_id string, storage_key string, job_seq int, attempt int, read_error string"
DOCS = [(i, "col", "Lake Rules", "Dept", "Karnataka", "en", "ACTIVE" if i == 6 else "PROCESSING", None) for i in range(1, 8)]
DOC = "document_id int, collection_id string, scheme_name string, department string, state_or_district string, language string, status string, effective_date timestamp_ntz"
VERSION = "version_id string, document_id int, version_number int, total_pages int, status string, effective_date timestamp_ntz"
PAGE = "\n".join(["Rules of the Lake", "", "Boats without a lamp stay at the pier after sunset on every day of the year."])


def ingestion(spark, requests, jobs=(), files=None, **options):
    versions = [(f"{i}:{n}", i, n, 1, "PROCESSING", None) for i in range(1, 8) for n in (1, 2)]
    files = files if files is not None else [("a", None), ("bad", "File is empty (0 bytes).")]
    readings = [(f"{i}:{n}", i, 1, PAGE, None) for i in range(1, 7) for n in (1, 2)]
    return JB.run_jobs(
        spark.createDataFrame(requests, REQUEST), spark.createDataFrame(DOCS, DOC), spark.createDataFrame(versions, VERSION),
        spark.createDataFrame(list(jobs), "job_id string, document_id int, version_id string, created_seq int, status string"),
        spark.createDataFrame(files, "storage_key string, reason string"),
        spark.createDataFrame(readings, "version_id string, document_id int, page_number int, native_text string, ocr_text string"), **options)


RUN = [(1, "1:1", "a", 1, None, None), (2, "2:1", "gone", 2, 1, None), (3, "3:1", "bad", 3, 1, None), (4, "4:1", "a", 4, 2, "lost link"),
       (5, "5:1", "a", 5, 3, "lost link"), (9, "9:1", "a", 6, 1, None), (6, "6:1", None, 7, 1, None), (6, "6:2", "a", 8, 1, None),
       (7, "7:1", "a", 9, 1, None), (1, "1:1", "a", 0, 1, "an older request"), (None, None, None, None, None, None)]


def test_every_request_ends_in_one_outcome(spark):
    out = ingestion(spark, RUN, jobs=[("old", 4, "4:1", 1, "QUEUED"), ("new", 4, "4:1", 2, "QUEUED"), ("lost", 9, "9:1", 1, "QUEUED"), ("other", 2, "2:2", 1, "QUEUED")])
    got = {r.version_id: r for r in out["outcomes"].collect()}
    assert {k: v.outcome for k, v in got.items()} == {
        "1:1": "done", "2:1": "missing_file", "3:1": "invalid_file", "4:1": "retry", "5:1": "exhausted", "9:1": "unknown",
        "6:1": "missing_file", "6:2": "done", "7:1": "done", None: "unknown"}
    assert got["4:1"].retry_after_seconds == 1.0 and got["5:1"].error_message == "Document processing failed after 3 attempts: lost link"
    jobs = {r.job_id: r for r in out["jobs"].collect()}
    assert {k: (j.status, j.progress_percent) for k, j in jobs.items()} == {
        "job-1:1-1": ("COMPLETED", 100), "job-2:1-2": ("FAILED", 100), "job-3:1-3": ("FAILED", 100), "new": ("RUNNING", 45), "job-5:1-5": ("FAILED", 100),
        "lost": ("FAILED", 100), "job-6:1-7": ("FAILED", 100), "job-6:2-8": ("COMPLETED", 100), "job-7:1-9": ("COMPLETED", 100)}
    assert json.loads(jobs["job-1:1-1"].summary_json) == {
        "total_pages": 1, "native_text_pages": 1, "ocr_pages": 0, "failed_pages": 0, "low_confidence_pages": 0, "scanned_pages": 0, "chunks_count": 1, "execution_attempts": 1}
    assert json.loads(jobs["job-7:1-9"].summary_json)["total_pages"] == 0  # a sound file without a reading
    assert jobs["job-3:1-3"].summary_json is None and jobs["job-3:1-3"].error_message == "File is empty (0 bytes)."


def test_statuses_chunks_and_audit_follow_the_outcomes(spark):
    out = ingestion(spark, RUN)
    documents = {r.document_id: r.status for r in out["documents"].collect()}
    assert documents == {1: "ACTIVE", 2: "FAILED", 3: "FAILED", 4: "PROCESSING", 5: "FAILED", 6: "ACTIVE", 7: "ACTIVE"}  # 6: its later version is done
    versions = {r.version_id: (r.status, r.error_message) for r in out["versions"].collect()}
    assert len(versions) == 14 and versions["1:1"] == ("ACTIVE", None) and versions["1:2"] == ("PROCESSING", None)
    assert versions["6:1"][0] == "FAILED" and versions["6:2"][0] == "ACTIVE" and versions["4:1"] == ("PROCESSING", None)
    assert {r.version_id for r in out["chunks"].select("version_id").collect()} == {"1:1", "6:2"}
    audit = sorted((r.action[12:], r.entity_id) for r in out["audit"].filter("entity_id is not null").collect())
    assert audit == sorted([("COMPLETED", "1"), ("COMPLETED", "6"), ("COMPLETED", "7"), ("FAILED", "2"), ("FAILED", "5"), ("FAILED", "6"), ("FAILED", "9")])


def test_empty_ingestion(spark):
    out = ingestion(spark, [])
    assert out["jobs"].isEmpty() and out["audit"].isEmpty() and out["chunks"].isEmpty()
    assert {r.status for r in out["documents"].collect()} == {"PROCESSING", "ACTIVE"}


# ---- duplicate drop in event time -------------------------------------------------------------

def test_copies_in_a_stream_are_dropped_within_the_watermark(spark):
    """Files out of order: a copy within a day is dropped, a late row too, and a hash whose state has gone counts as new."""
    folder, out, state = (stage_path(spark, n) for n in ("arrivals", "copies", "copies_state"))
    schema = "ts timestamp, upload_id int, file_hash string"
    day = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d)
    arrivals = [[(day(0), 1, "a"), (day(0.2), 2, "a")], [(day(10), 3, "b")], [(day(10), 4, "a"), (day(1), 5, "c")], [(day(10.5), 6, "b"), (day(9.5), 7, "d")],
                [(day(13), 8, "e")], [(day(13), 9, "b")]]
    seen = []
    for rows in arrivals:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = J.read_files(spark, folder, spark.createDataFrame([], schema).schema)
        now = sorted(r.file_hash for r in J.run_to_table(J.first_copies(stream), out, state).collect())
        seen.append("".join(now))
    assert seen == ["a", "ab", "aab", "aabd", "aabde", "aabbde"]
