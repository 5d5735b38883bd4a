"""Question understanding, grounding, citation checks, catalog and streaming on small inputs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from folioground import constants as C
from folioground.functions import vectors as VX
from folioground.operators import catalog as D, citations as CI, eligibility as EL, grounding as G, index as I, understanding as U
from folioground.plans import answer as PA, ingest as P
from folioground.sources import tables as S, views as V
from folioground.staging import stage_path
from folioground.streaming import jobs as J

FACTS = [
    ("scheme_category", "we want a pmay house on our plot", "housing"), ("scheme_category", "drip kit for kisan with two acres of crop", "agriculture"),
    ("scheme_category", "which hospital takes the ayushman card", "healthcare"), ("scheme_category", "my pension has not come since June", "pension"),
    ("scheme_category", "days worked under mgnrega this year", "employment"), ("scheme_category", "second lpg refill at home", "energy"),
    ("beneficiary_type", "bus pass of senior citizens", "senior_citizen"), ("beneficiary_type", "money for a widow next door", "widow"),
    ("beneficiary_type", "our shg wants to buy two goats", "shg"), ("beneficiary_type", "sugar quota of a bpl family", "bpl_family"),
    ("age", "he turned 67 years old in March", 67), ("age", "my uncle aged 74 lives alone", 74), ("age", "age: 38 as on the form", 38),
    ("age", "a 19 yo cousin in the hostel", 19), ("age", "only people above 62 may come", 62), ("age", "where is the block office", None),
    ("age", "income under 3 lakh", 3), ("age", "aged 999 but under 40", 40),
    ("gender", "a lady from the next lane", "female"), ("gender", "a man from our lane", "male"),
    ("gender", "transgender identity card office", "transgender"), ("gender", "which bank opens the account", None),
    ("income_range", "we hold the yellow bpl card", "BPL"), ("income_range", "seat in the ews list", "EWS"),
    ("income_range", "all of us together earn below 3 lakh", "<= Rs. 300,000"), ("max_income", "yearly income under 1.5 lakhs", 150000.0),
    ("max_income", "his salary 18000 is paid late", 18000.0), ("max_income", "when does the camp open", None), ("max_income", "under 3 lakh only", 300000.0),
    ("occupation", "the farmer behind the canal", "farmer"), ("occupation", "a street vendor at the bus stand", "street_vendor"),
    ("occupation", "our asha worker is on leave", "healthcare_worker"),
    ("understood_location", "a flat in Varanasi, Uttar Pradesh", "Varanasi, Uttar Pradesh"), ("understood_location", "a well for our village in Maharashtra", "Maharashtra"),
    ("locality", "a well for our village in Maharashtra", "rural"), ("locality", "a tap in the slum near Pune", "urban"),
    ("disability_status", "hearing aid for divyangjan", "PwD / Divyangjan"), ("disability_status", "my son has 55% disability", "PwD (55% benchmark disability)"),
    ("disability_status", "library card of the school", None),
    ("profile_terms", "she is a widow, 70 years old, a farmer and holds a bpl card", ["bpl", "farmer", "senior-citizen", "widow"]),
    ("information_type", "is my sister eligible this year", "eligibility"), ("information_type", "what amount will reach us", "benefit"),
    ("information_type", "list the documents to bring", "documents"), ("information_type", "tell me how to apply from home", "process"),
    ("information_type", "is there a deadline in May", "deadline"), ("information_type", "give the helpline of the office", "contact"),
    ("information_type", "where do I track my file", "status"), ("information_type", "", "general"), ("is_safe_to_answer", None, True),
    ("missing_field", "Is my brother eligible for PMAY, and am I eligible?", "annual_income"), ("missing_field", "am I eligible for a pension", "age"),
    ("missing_field", "am I eligible for kisan money", "farmer_status_and_landholding"), ("missing_field", "am I eligible", "scheme_name_or_category"),
    ("missing_field", "at 71 years old, am I eligible for a pension", None), ("missing_field", "which documents does PMAY ask for", None),
    ("is_safe_to_answer", "how does one apply for kisan money", True),
]


def test_question_facts(spark):
    df = spark.createDataFrame([(i, q) for i, (_, q, _) in enumerate(FACTS)], "i int, query string")
    got = U.understand(df).orderBy("i").collect()
    assert [(f, q, r[f]) for (f, q, _), r in zip(FACTS, got)] == FACTS


def test_hints_hide_nothing(spark, monkeypatch):
    """Parts that a pattern needs are looked for first: the fields are those of the patterns alone, and plain texts meet few patterns."""
    words = ["trans  man", "third gender", "gram  panchayat", "tehsil", "municipality", "slums", "economically weaker section", "aay", "aays", "locomotor", "hearing impaired", "best", "sc", "toll-free",
             "pm-kisan", "salary of rs. 4,500.5", "earnings 3 crore", "income ,", "up to .5 lac", "less than inr 2 lakhs", "lakh", "age: 300", "i am 44", "over ٣٣", "aged 9yo", "goa", "goat", "jammu and kashmir", "Chandigarh", "40% disability"]
    df = spark.createDataFrame([(i, f"{a} x {b}") for i, (a, b) in enumerate((a, b) for a in words for b in words)], "i int, query string").coalesce(1)
    want = {r.i: r for r in U.understand(df).collect()}
    monkeypatch.setattr(U, "holds", lambda q, parts: q.isNotNull())
    monkeypatch.setattr(U, "may_hold", lambda w, keywords: w.isNotNull())
    monkeypatch.setattr(U, "has_digit", lambda q: q.isNotNull())
    got = {r.i: r for r in U.understand(df).collect()}
    assert got == want and len({r.age for r in want.values()}) > 2 and len({r.max_income for r in want.values()}) > 5


PASSAGE = "query_id int, rank int, document_id int, document_title string, version_id string, page_number int, section_heading string, excerpt string, score double"
TITLE = "Canal Water Rules (v2)"
TEXT = "Each registered plot gets nine hours of canal water on every second Tuesday of the dry months."


def verdicts(spark, answers, passages):
    a = spark.createDataFrame(list(enumerate(answers)), "query_id int, answer string")
    p = spark.createDataFrame([(i, *x) for i in range(len(answers)) for x in passages], PASSAGE)
    return [(r.grounded, r.n_claims) for r in G.answer_verdicts(a, G.check_claims(a, p)).orderBy("query_id").collect()]


def test_claims(spark):
    shown = [(1, 1, TITLE, "v", 4, None, TEXT, 0.92)]
    good = f"Under {TITLE}, Page 4: {TEXT} [Source: {TITLE}, Page 4]."
    bad = "Owners may moreover borrow silver bicycles from the harbour museum until midnight."
    wrong_page = f"Each registered plot gets canal water [Source: {TITLE}, Page 9]."
    got = verdicts(spark, [good, bad, wrong_page, good + " " + bad, "Note: nothing.", "Based on official scheme papers plots dry."], shown)
    assert [g for g, _ in got] == [True, False, False, False, False, True] and got[0][1] > 0 and got[4][1] == 0


def test_repeated_title_and_page_uses_last_words(spark):
    shown = [(1, 1, "T", "v", 1, None, "alpha beta gamma", 0.9), (2, 2, "T", "v", 1, None, "delta epsilon zeta", 0.8)]
    got = verdicts(spark, ["Delta epsilon zeta [Source: T, Page 1].", "Alpha beta gamma [Source: T, Page 1]."], shown)
    assert [g for g, _ in got] == [True, False]


def test_sufficiency(spark):
    p = spark.createDataFrame([(1, 1, 1, "Housing Guide", "v", 1, None, "rural housing grants", 0.9), (2, 1, 1, "X", "v", 1, None, "rural housing", 0.30),
                               (3, 1, 1, "X", "v", 1, None, "nothing alike", 0.9), (4, 1, 1, "X", "v", 1, None, "t", 0.9)], PASSAGE)
    q = spark.createDataFrame([(1, "rural housing"), (2, "rural housing"), (3, "scholarship deadline tomorrow"), (4, "is it on"), (5, "rural housing")], "query_id int, query string")
    got = {r.query_id: r.reason for r in G.evidence_sufficiency(q, p).collect()}
    assert got == {1: "SUFFICIENT", 2: "RELEVANCE_BELOW_THRESHOLD (0.30 < 0.45)", 3: "KEYWORD_OVERLAP_TOO_LOW (0.00 < 0.20)", 4: "SUFFICIENT", 5: "NO_PASSAGES_RETRIEVED"}


def test_citation_reasons(spark):
    docs = spark.createDataFrame([(1, "open", "Scheme One", "ACTIVE"), (2, "room", "Scheme Two", "ACTIVE"), (3, "open", "Scheme Three", "ARCHIVED")], "document_id int, collection_id string, scheme_name string, status string")
    vers = spark.createDataFrame([("1:1", 1, 1, 3, "ACTIVE"), ("1:0", 1, 0, 3, "ARCHIVED"), ("2:1", 2, 1, 2, "ACTIVE"), ("3:1", 3, 1, None, "ARCHIVED")],
                                 "version_id string, document_id int, version_number int, total_pages int, status string")
    pages = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "document_id int, page_number int")
    rooms = spark.createDataFrame([("open", False, 9), ("room", True, 9)], "collection_id string, is_private boolean, owner_user_id int")
    asks = [(0, "open", None, [], False), (1, "room", None, [], False), (2, "room", 9, [], False), (3, "open", 5, ["docs:archive"], True), (4, "open", 5, ["docs:archive"], False)]
    req = spark.createDataFrame(asks, "query_id int, collection_id string, user_id int, permissions array<string>, include_historical boolean")
    text = "rural housing grants are paid yearly"
    rows = [  # query, index, document, title, version, page, excerpt, reason
        (0, 0, 1, "Scheme One (v1)", "1:1", 1, text, None), (0, 1, 77, "No such thing", None, 1, text, "DOCUMENT_NOT_FOUND"), (0, 2, 2, "Scheme Two", "2:1", 1, text, "WRONG_COLLECTION"),
        (0, 3, 77, "eme on", None, 1, text, None), (0, 4, 1, "Scheme One", "1:0", 1, text, "UNAUTHORIZED_ARCHIVED_DOCUMENT"), (0, 5, 1, "Scheme One", "1:1", 0, text, "INVALID_PAGE_NUMBER"),
        (0, 6, 1, "Scheme One", "1:1", 3, text, None), (0, 7, 1, "Scheme One", "1:1", 4, text, "INVALID_PAGE_NUMBER"), (0, 8, 1, "Scheme One", "1:1", 1, "zebra quartz", "NOT_IN_RETRIEVED_EVIDENCE"),
        (0, 9, 1, "Scheme One", "1:1", 1, "is at on", None), (1, 0, 2, "Scheme Two", "2:1", 1, text, "UNAUTHORIZED_PRIVATE_COLLECTION"), (2, 0, 2, "Scheme Two", "2:1", 1, text, None),
        (3, 0, 3, "Scheme Three", "3:1", 1, text, None), (3, 1, 3, "Scheme Three", "3:1", 2, text, "INVALID_PAGE_NUMBER"), (4, 0, 3, "Scheme Three", "3:1", 1, text, "UNAUTHORIZED_ARCHIVED_DOCUMENT")]
    cites = spark.createDataFrame([r[:7] for r in rows], "query_id int, citation_index int, document_id int, document_title string, version_id string, page_number int, excerpt string")
    shown = spark.createDataFrame([(q, 1, d, "t", "v", 1, None, text, 0.9) for q, d in ((0, 1), (1, 2), (2, 2), (3, 3), (4, 3))], PASSAGE)
    got = {(r.query_id, r.citation_index): r.error_reason for r in CI.validate_citations(cites, req, docs, vers, pages, rooms, shown).collect()}
    assert got == {(r[0], r[1]): r[7] for r in rows}


def test_archived_text_needs_the_right_under_either_name(spark):
    rooms = spark.createDataFrame([("open", False, True, 9)], "collection_id string, is_private boolean, is_active boolean, owner_user_id int")
    people = spark.createDataFrame([(1, "viewer"), (2, "super_admin")], "user_id int, role string")
    asks = [(0, 1, None, True), (1, 1, True, None), (2, 1, None, None), (3, 1, False, False)]
    r = spark.createDataFrame([(q, "boat fees", "open", u, h, a) for q, u, h, a in asks], "query_id int, query string, collection_id string, user_id int, include_historical boolean, include_archived boolean")
    got = {x.query_id: x.reject_reason for x in PA.judge_requests(r, rooms, people).collect()}
    assert got[0] == got[1] is not None and got[2] is None and got[3] is None
    o = {x.query_id: (x.include_historical, x.limit, x.active_only) for x in PA.request_options(r.withColumn("scheme", F.lit("")).withColumn("limit", F.col("query_id"))).collect()}
    assert o == {0: (True, C.DEFAULT_LIMIT, True), 1: (True, 1, True), 2: (False, 2, True), 3: (False, 3, True)}


def test_gated_upsert(spark):
    """A batch with one bad vector is kept out whole; others are embedded where they lack a vector and win over what is there."""
    rows = [("a", 1, "v:1", 1, 0, "reed boats", None, None, None, None), ("a", 2, "v:1", 1, 0, "reed rafts", None, None, None, None), ("a", 1, None, 2, 1, None, [0.5] * 8, None, None, "own"),
            ("b", 1, "w:1", 1, 0, "tar", [1.0] * 3, None, None, None), ("b", 1, "w:1", 1, 1, "oil", None, None, None, ""), ("c", 1, "x:1", 1, 0, "sail", None, "other", None, None),
            ("d", 1, "y:1", 1, 0, "mast", None, None, 9, None), ("e", 1, None, 1, 0, "keel", None, None, None, "")]
    c = spark.createDataFrame([(b, s, v, p, i, t, x, m, d, n) for b, s, v, p, i, t, x, m, d, n in rows], "batch string, seq int, version_id string, page_number int, chunk_index int, chunk_text string, "
                              "values array<float>, embedding_model string, embedding_dimension int, vector_id string")
    old = spark.createDataFrame([("v:1:1:0", "corpus:col", [9.0] * 8, "m", 8), ("kept", "corpus:col", [9.0] * 8, "m", 8)], "vector_id string, namespace string, values array<float>, embedding_model string, embedding_dimension int")
    embed = VX.hashing_embedder(8)
    vectors, refused = I.gated_upsert(c, old, F.lit("col"), embed, 8, "m")
    got = {r.vector_id: r["values"] for r in vectors.collect()}
    rafts = spark.createDataFrame([("reed rafts",)], "t string").select(embed(F.col("t"))).first()[0]
    assert got == {"kept": [9.0] * 8, "own": [0.5] * 8, "v:1:1:0": rafts}
    assert {(r.batch, r.vector_id, r.reason) for r in refused.collect()} == {
        ("b", "w:1:1:0", "DIMENSION_MISMATCH"), ("b", "w:1:1:1", "BATCH_REFUSED"), ("c", "x:1:1:0", "MODEL_MISMATCH"), ("d", "y:1:1:0", "DIMENSION_MISMATCH"), ("e", None, "NO_IDENTITY")}


def test_hash_groups_with_many_copies(spark):
    rows = [(i, "same" if i % 3 else f"h{i}", f"S{i}", "DELETED" if i == 1 else "ACTIVE") for i in range(60)]
    docs = spark.createDataFrame(rows, "document_id int, file_hash string, scheme_name string, status string")
    got = {r.document_id: r.original_id for r in D.duplicate_warnings(docs, salts=4).collect()}
    assert got == {i: 2 for i, h, _, _ in rows if h == "same" and i > 2}


def test_conflicts_keep_every_member(spark):
    docs = spark.createDataFrame([(i, "c", " Scheme A" if i % 2 else "scheme a", i, "ACTIVE") for i in range(30)] + [(99, "c", "Other", 1, "ACTIVE")],
                                 "document_id int, collection_id string, scheme_name string, version_number int, status string")
    assert D.conflict_members(docs).count() == 30
    warning = D.conflict_warnings(docs).collect()
    assert [(w.scheme_name, w.active_documents) for w in warning] == [("scheme a", 30)] and "30 active documents" in warning[0].message


def test_upload_order_of_reasons(spark):
    rows = [(1, "a.PDF ", 10, True, "c"), (2, "a.txt", 0, False, "x"), (3, "a.pdf", C.MAX_UPLOAD_BYTES + 1, False, "x"), (4, "a.pdf", 0, False, "x"), (5, "a.pdf", 1, False, "x"), (6, "a.pdf", 1, True, "x")]
    up = spark.createDataFrame(rows, "upload_id int, filename string, file_size_bytes long, is_official_source_confirmed boolean, collection_id string")
    got = {r.upload_id: r.reason for r in S.upload_verdicts(up, spark.createDataFrame([("c",)], "collection_id string")).collect()}
    assert got == {1: None, 2: "INVALID_EXTENSION", 3: "FILE_TOO_LARGE", 4: "FILE_EMPTY", 5: "SOURCE_NOT_CONFIRMED", 6: "COLLECTION_NOT_FOUND"}


def test_bucket_overwrite_is_idempotent(spark):
    path = stage_path(spark, "t")
    first = spark.range(100).selectExpr("cast(id % 10 as string) as version_id", "id")
    again = spark.createDataFrame([("3", -1), ("new", -2)], "version_id string, id long")
    S.overwrite_buckets(first, path, "version_id", 8)
    for _ in range(2):
        S.overwrite_buckets(again, path, "version_id", 8)
    got = spark.read.parquet(path)
    assert got.count() == 92 and got.filter("version_id = '3'").select("id").collect()[0][0] == -1


def test_screening(spark):
    a = spark.createDataFrame([(1, 250000.0, 1.5), (2, 300001.0, 0.0), (3, None, None)], "applicant_id int, annual_income double, landholding_hectares double")
    s = EL.screen(a, EL.default_rules(spark))
    assert {(r.applicant_id, r.rule_id, r.eligible) for r in s.collect()} == {(1, "income-ews", True), (1, "land-holding", True), (2, "income-ews", False)}
    assert {r.applicant_id: (r.n_eligible, r.n_ineligible) for r in EL.screening_summary(a, s).collect()} == {1: (2, 0), 2: (0, 1), 3: (0, 0)}


def test_stream_equals_batch_and_replay_changes_nothing(spark, sf_dir):
    schema = V.read(spark, sf_dir, "documents").schema
    paths = [stage_path(spark, n) for n in ("c", "v")]
    embed = VX.hashing_embedder(32)
    for _ in range(2):
        d = J.read_files(spark, sf_dir, schema, "documents.parquet")
        pages = V.cut_pages(d.selectExpr("concat_ws(':', doc_id, 1 + doc_id % 3) as version_id", "doc_id as document_id", "text"))
        J.ingest_stream(pages, *paths, stage_path(spark, "s"), embed).awaitTermination()
    from folioground.operators.chunking import chunk_documents
    want = {(r.vector_id, r.chunk_text) for r in chunk_documents(V.pages(spark, sf_dir)).collect()}
    got = [(r.vector_id, r.chunk_text) for r in spark.read.parquet(paths[0]).collect()]
    assert len(got) == len(want) and set(got) == want and spark.read.parquet(paths[1]).count() == len(want)


def test_a_version_may_arrive_over_files_and_batches(spark):
    text = "\n".join(f"Line {i} of a page that says what number {i} means in some words more." for i in range(80))
    rows = [("7:1", 7, n, f"Page {n}\n{text}") for n in (1, 2, 3)] + [("8:1", 8, 1, text)]
    pages = spark.createDataFrame(rows, "version_id string, document_id long, page_number int, raw_text string")
    folder, state = stage_path(spark, "pg"), stage_path(spark, "s")
    paths = [stage_path(spark, n) for n in ("c", "v")]
    for part in (pages.filter("page_number = 2"), pages.filter("page_number <> 2"), pages.filter("page_number = 3")):
        part.coalesce(1).write.mode("append").parquet(folder)
        J.ingest_stream(J.read_files(spark, folder, pages.schema, files_per_batch=1), *paths, state, VX.hashing_embedder(8)).awaitTermination()
    from folioground.operators.chunking import chunk_documents
    want = {(r.vector_id, r.chunk_text) for r in chunk_documents(pages).collect()}
    got = [(r.vector_id, r.chunk_text) for r in spark.read.parquet(paths[0]).collect()]
    assert len(got) == len(want) and set(got) == want
    assert {r.vector_id for r in spark.read.parquet(paths[1]).collect()} == {v for v, _ in want}


def test_untouched_buckets_keep_their_files(spark):
    path = stage_path(spark, "pruned")
    rows = spark.range(64).selectExpr("cast(id as string) as version_id", "id")
    S.overwrite_buckets(rows, path, "version_id", 8)
    files = lambda: {r[0] for r in spark.read.parquet(path).selectExpr("input_file_name()").distinct().collect()}
    before, one = files(), rows.filter("id = 5")
    S.overwrite_buckets(one, path, "version_id", 8)
    assert len({f.rsplit("/", 2)[1] for f in before ^ files()}) == 1 and spark.read.parquet(path).count() == 64
    plan = S.stored_under(one.withColumn("bucket", S.bucket_of("version_id", 8)), path)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket", "bucket") and "PartitionFilters: []" not in plan


def test_late_events_are_dropped(spark):
    folder, out = stage_path(spark, "ev"), stage_path(spark, "out")
    at = lambda *a: dt.datetime(2024, 1, *a)
    state = stage_path(spark, "st")
    ev = "event_id long, ts timestamp, user_id long, action string"
    for batch in ([(1, at(1, 10), 1, "view"), (2, at(3, 10), 1, "view")], [(3, at(1, 12), 1, "view"), (4, at(5, 1), 1, "view")]):
        spark.createDataFrame(batch, ev).coalesce(1).write.mode("append").parquet(folder)
        stream = J.daily_action_counts(J.read_files(spark, folder, spark.createDataFrame([], ev).schema))
        got = J.run_to_table(stream, out, state)
    assert {(str(r.day)[:10], r.n_events) for r in got.collect()} == {("2024-01-01", 1), ("2024-01-03", 1)}


def test_answers_stay_in_their_collection(spark, sf_dir):
    from folioground.registry import flows
    out = flows.answer_tables(spark, sf_dir)
    a = {r.query_id: r for r in out["answers"].collect()}
    assert len(a) == V.bench_queries(spark, sf_dir).count()
    room = {r.document_id: r.collection_id for r in V.documents(spark, sf_dir).collect()}
    cites = out["citations"].collect()
    assert cites and all(room[c.document_id] == a[c.query_id].collection_id and a[c.query_id].reject_reason is None for c in cites)
    for r in a.values():
        assert (r.answer is None) == (r.reject_reason is not None)
        if r.is_refusal:
            assert C.NO_ANSWER in r.answer
        elif r.reject_reason is None:
            assert r.answer.startswith("Under ") or C.NO_ANSWER in r.answer


def test_registry_covers_inventory():
    from folioground.registry import load
    queries, oracles = load()
    assert set(oracles) <= set(queries) and len(queries) > 110 and len(oracles) > 100


def test_answers_embed_where_they_compare(spark, sf_dir, monkeypatch):
    """No stored vector reaches the search of an answer run; its texts are those of the payload."""
    from folioground.plans import answer as PA
    from folioground.registry import flows
    seen, nearest = [], PA.knn.nearest
    monkeypatch.setattr(PA.knn, "nearest", lambda queries, vectors, *a: seen.append((vectors.columns, a[-1])) or nearest(queries, vectors, *a))
    assert flows.answer_tables(spark, sf_dir)["answers"].count() == V.bench_queries(spark, sf_dir).count()
    assert len(seen) == 1 and "text" in seen[0][0] and "values" not in seen[0][0] and seen[0][1] is not None
