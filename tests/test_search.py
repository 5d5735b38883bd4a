"""Matching, postings, nearest vectors and fusion against brute force on small inputs."""

import hashlib
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from folioground.functions import text as X, vectors as VX
from folioground.operators import fusion, keyword as KW, knn, matching as M, ranking, search_index as SI
from folioground.registry import retrieval as R
from folioground.staging import stage_path, stage_table


def test_substring_pairs_brute_force(spark):
    rnd = random.Random(7)
    hay = {"".join(rnd.choice("abc-") for _ in range(rnd.randint(1, 130))) for _ in range(120)}
    needles = {"".join(rnd.choice("abc-") for _ in range(rnd.randint(1, 9))) for _ in range(60)}
    needles |= {h[3:40] for h in hay if len(h) > 45} | {"zzz", "é"}
    hay |= {"café crème", "x" * 39 + "needle" + "y" * 60}
    needles |= {"needle", "x" * 39 + "needle" + "y" * 10}
    got = M.substring_pairs(spark.createDataFrame([(n,) for n in needles], "needle string"), spark.createDataFrame([(h,) for h in hay], "haystack string"))
    assert {tuple(r) for r in got.collect()} == {(n, h) for n in needles for h in hay if n in h}


def test_passage_pairs_brute_force(spark):
    rnd = random.Random(3)
    words = ["alpha", "beta", "gam", "delta", "of", "the"]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(3, 60))) for _ in range(40)]
    needles = [" ".join(t.split()[2:2 + n]) for t in texts for n in (1, 2, 4, 5, 7)] + [t[3:40] for t in texts] + ["absent words are never found here"]
    needles = sorted({n for n in needles if n.strip()})
    got = M.passage_pairs(spark.createDataFrame(list(enumerate(needles)), "needle_id int, needle string"),
                          spark.createDataFrame(list(enumerate(texts)), "haystack_id int, haystack string"))
    assert {tuple(r) for r in got.collect()} == {(i, j) for i, n in enumerate(needles) for j, t in enumerate(texts) if n in t}


def brute_vector(text, dim):
    v = [0.0] * dim
    for t, tok in enumerate(text.strip().lower().split()):
        h = hashlib.sha256(tok.encode()).hexdigest()
        for i in range(0, 16, 2):
            v[(int(h[i:i + 2], 16) * 31 + t * 7) % dim] += (int(h[i], 16) - 7.5) / 10.0
    n = math.sqrt(sum(x * x for x in v))
    return [round(x / n, 6) for x in v] if n else v


def test_feature_hash_matches_definition(spark):
    texts = ["Rural housing subsidy", "café CAFÉ café", "", "   ", None, "one " * 50]
    embed = VX.hashing_embedder(128)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(embed(F.col("t"))).collect()]
    for t, v in zip(texts, got):
        assert np.allclose(v, brute_vector(t or "", 128), atol=1e-6) and len(v) == 128


def test_feature_hash_memory_follows_a_stripe():
    """Whole batches of long texts, hashed in stripes: the same rows, in little more than the result takes."""
    import tracemalloc
    rnd = random.Random(2)
    texts = pd.Series([" ".join(f"w{rnd.randrange(5000)}" for _ in range(400)) for _ in range(1500)] + [None, "", " "])
    tracemalloc.start()
    got = VX._hash_batch(texts, 1536)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * got.nbytes  # 16 times and more when the batch was hashed at once
    for i in (0, 777, 1499, 1501, 1502):
        assert np.allclose(got[i], brute_vector(texts[i] or "", 1536), atol=1e-6)


def test_cosine_edges(spark):
    rows = [([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 0.0], [-1.0, 0.0], 0.0), ([1.0], [1.0, 0.0], 0.0), ([0.0, 0.0], [1.0, 1.0], 0.0), ([], [], 0.0), (None, [1.0], 0.0)]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>, want double")
    assert all(r[0] == r[1] for r in df.select(VX.cosine(F.col("a"), F.col("b")), "want").collect())


@pytest.mark.parametrize("block", [8192, 7])
def test_nearest_blocks_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(knn, "VECTORS_PER_BLOCK", block)
    monkeypatch.setattr(knn, "QUERIES_PER_BLOCK", 3)
    rng = np.random.default_rng(5)
    # One namespace holds most vectors; some vectors are equal, one has another size.
    vecs = [(f"v{i:03d}", "big" if i % 4 else "small", [float(x) for x in rng.integers(-2, 3, 4)], "AB"[i % 2]) for i in range(60)]
    vecs += [("odd", "big", [1.0], None), ("zero", "big", [0.0] * 4, None)]
    qs = [(i, "big" if i % 3 else "small", [float(x) for x in rng.integers(-2, 3, 4)], [None, "a", "b"][i % 3]) for i in range(10)]
    q = spark.createDataFrame(qs, "query_id long, namespace string, values array<float>, want string")
    v = spark.createDataFrame(vecs, "vector_id string, namespace string, values array<float>, tag string")

    def cos(a, b):
        n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return round(max(0.0, min(1.0, sum(x * y for x, y in zip(a, b)) / n if n else 0.0)), 4)
    want = set()
    for qi, ns, a, f in qs:
        found = sorted((-cos(a, b), vid) for vid, n, b, t in vecs if n == ns and len(b) == 4 and (f is None or t is None or f == t.lower()))[:5]
        want |= {(qi, vid, -s, r + 1) for r, (s, vid) in enumerate(found)}
    got = knn.nearest(q, v, 5, {"want": "tag"}).select("query_id", "vector_id", "vec_score", "vec_rank").collect()
    assert {tuple(r) for r in got} == want


def test_long_vectors_make_small_blocks(spark, monkeypatch):
    """A block holds a number of values, so its memory does not follow the length of a vector."""
    v = spark.createDataFrame([(f"v{i:03d}", "n", [float(i % 7), 1.0, float(i % 3)]) for i in range(40)], "vector_id string, namespace string, values array<float>")
    q = spark.createDataFrame([(1, "n", [1.0, 1.0, 0.0])], "query_id long, namespace string, values array<float>")
    want = sorted(map(tuple, knn.nearest(q, v, 5).collect()))
    monkeypatch.setattr(knn, "VALUES_PER_BLOCK", 12)
    got = knn.nearest(q, v, 5)
    assert sorted(map(tuple, got.collect())) == want


def test_namespaces_prune_partitions(spark):
    """Only buckets of the namespaces that are asked for are opened, found out at run time."""
    v = spark.createDataFrame([(f"v{i:03d}", f"n{i % 12}", [float(i % 5), 1.0]) for i in range(120)], "vector_id string, namespace string, values array<float>")
    path = stage_path(spark, "vectors")
    knn.write_vectors(v, path, 16)
    q = spark.createDataFrame([(1, "n3", [1.0, 1.0]), (2, "n7", [0.0, 1.0]), (3, "none", [1.0, 0.0])], "query_id long, namespace string, values array<float>")
    found = knn.nearest_stored(q, path, 4, buckets=16)
    assert "dynamicpruning" in found._jdf.queryExecution().toString()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, knn.nearest(q, v, 4).collect()))


DOCS = [(1, "PM-KISAN Benefit", "Department of Agriculture"), (2, "Rural Housing", "Housing Board"), (3, "Old Age Pension", "Social Welfare")]


def corpus(spark):
    rnd = random.Random(11)
    words = ["PM-KISAN", "6000", "rural", "housing", "the", "in", "a", "b", "café", "EWS", "old-age", "(note)", "sub_sidy", "100%"]
    rows = []
    for i in range(40):
        text = " ".join(rnd.choice(words) for _ in range(rnd.randint(2, 12))) + (" exact phrase here" if i % 9 == 0 else "")
        d = DOCS[i % 3]
        status = "DELETED" if i % 13 == 0 else "ARCHIVED" if i % 5 == 0 else "ACTIVE"
        rows.append((f"c{i:02d}", "col", d[0], f"{d[0]}:1", i // 3, i, "HEAD rural" if i % 4 == 0 else None, d[1], d[2], "Maharashtra - Pune" if i % 2 else None, "en", status == "ACTIVE", status, text))
    p = spark.createDataFrame(rows, "vector_id string, collection_id string, document_id long, version_id string, chunk_index int, page_number int, section_heading string, scheme_name string, department string, "
                                    "state_or_district string, language string, active boolean, document_status string, chunk_text string")
    from folioground.functions.text import normalize_for_search
    p = p.withColumn("normalized_text", normalize_for_search(F.col("chunk_text")))
    return p


QUERIES = ['PM-KISAN 6000', '"exact phrase" rural', 'the', 'a b', '"rural hous"', 'kisan benefit', 'hous pens', 'EWS (note)', '"old-age" "the"', '""', 'café sub_sidy 100%',
           'rural housing', 'e', 'department', '"a"', 'zzzz', 'PM-KISAN PM-KISAN']


def brute_scores(query, rows, historical):
    import re
    import unicodedata
    fold = lambda t: re.sub(r"\s+", " ", re.sub(r"[^\w\s\.,\-%/:;]", " ", unicodedata.normalize("NFKC", t).lower())).strip()
    q = query.strip()
    phrases = re.findall(r'"([^"]*)"', q)
    raw = [t for t in re.sub(r'"[^"]*"', " ", q).split() if len(t) > 1]
    norm = [t for t in fold(q).split() if len(t) > 1]
    out = {}
    for r in rows:
        if r.document_status == "DELETED" or not (historical or r.active):
            continue
        text, nt, scheme, head, dep = r.chunk_text.lower(), r.normalized_text, r.scheme_name.lower(), (r.section_heading or "").lower(), r.department.lower()
        live = [p.strip().lower() for p in phrases if p.strip()]
        if live:
            ok = all(p in text or p in nt or p in scheme for p in live)
        elif raw or norm:
            ok = any(t.lower() in text or t.lower() in nt or t.lower() in head or t.lower() in scheme or t.lower() in dep for t in raw) or any(t in nt for t in norm)
        else:
            ok = q.lower() in text or (fold(q) and fold(q) in nt) or q.lower() in scheme
        if not ok:
            continue
        s = 3.0 * (q.lower() in scheme) + sum(2.5 if p.lower() in text else 2.0 if p.lower() in nt else 0.0 for p in phrases)
        s += sum(1.5 for t in raw if t.lower() in head) + sum((t in nt or t in text) + 1.5 * (t in scheme) for t in norm) + 2.0 * (q.lower() in text)
        out[r.vector_id] = round(s, 2)
    return out


def asked(spark):
    q = spark.createDataFrame([(i, t, "col", i % 2 == 0) for i, t in enumerate(QUERIES)], "query_id int, query string, collection_id string, include_historical boolean")
    return q.select("*", *[F.lit(None).cast("string").alias(c) for c in ("scheme", "department", "state_or_district", "language")])


@pytest.fixture(scope="module")
def stored(spark):
    """The corpus, and an index of it with small blocks whose first batch held other texts of two documents."""
    p = corpus(spark).cache()
    before = p.withColumns({c: F.when(F.col("document_id") < 3, F.concat(F.lit("kisan zzzz rural "), F.col(c))).otherwise(F.col(c)) for c in ("chunk_text", "normalized_text")})
    index = SI.build(before, stage_path(spark, "index"), buckets=3, block=4)
    for _ in range(2):  # a batch that is run again changes nothing
        index.add(p.filter("document_id < 3"), 2)
    return p, SI.SearchIndex.open(spark, index.path)


def brute_all(p):
    rows = p.collect()
    return {i: brute_scores(t, rows, i % 2 == 0) for i, t in enumerate(QUERIES) if t != '""'}


def test_keyword_scores_brute_force(spark, stored):
    p, index = stored
    got = {}
    for r in KW.keyword_scores(asked(spark), index, p).collect():
        got.setdefault(r.query_id, {})[r.vector_id] = r.match_score
    for i, want in brute_all(p).items():
        assert got.get(i, {}) == want, QUERIES[i]


@pytest.mark.parametrize("blocks", [1, 64])
def test_pruned_search_brute_force(spark, stored, monkeypatch, blocks):
    """With one block first, others are ruled out by their bounds; the best stay the best. A limit may differ by row."""
    p, index = stored
    monkeypatch.setattr(KW, "FIRST_BLOCKS", blocks)
    q = asked(spark).withColumn("most", F.col("query_id") % 4 + 1)
    got = {}
    for r in KW.keyword_search(q, index, p, F.col("most")).collect():
        got.setdefault(r.query_id, []).append((r.kw_rank, r.vector_id, r.match_score))
    for i, scores in brute_all(p).items():
        want = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[: i % 4 + 1]
        assert [x[1:] for x in sorted(got.get(i, []))] == want, QUERIES[i]


@pytest.mark.parametrize("blocks", [1, 64])
def test_search_by_bounds_brute_force(spark, stored, monkeypatch, blocks):
    p, index = stored
    monkeypatch.setattr(KW, "FIRST_BLOCKS", blocks)
    got = {}
    for r in KW.keyword_search(asked(spark), index, p, 3, by_bounds=True).collect():
        got.setdefault(r.query_id, []).append((r.kw_rank, r.vector_id, r.match_score))
    for i, scores in brute_all(p).items():
        assert [x[1:] for x in sorted(got.get(i, []))] == sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:3], QUERIES[i]


def test_search_reads_no_postings_and_small_slices(spark, stored, monkeypatch):
    """A search needs the chunks of the index alone; slices of three chunks give what one slice does."""
    p, index = stored
    light = SI.build(p, stage_path(spark, "light"), buckets=3, block=4, words=False)
    assert light.table("postings").isEmpty() and light.table("grams").isEmpty()
    want = {tuple(r) for r in KW.keyword_scores(asked(spark), index, p).collect()}
    monkeypatch.setattr(KW, "CHUNKS_PER_SLICE", 3)
    monkeypatch.setattr(KW, "_STRIPE", 2)
    got = [tuple(r) for r in KW.keyword_scores(asked(spark), light, p).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_only_the_best_leave_a_slice(spark, stored):
    """A search with a limit takes no more than that from a slice; a query without one keeps all."""
    p, index = stored
    own = F.when(F.col("query_id") % 3 > 0, F.col("query_id") % 3)
    parsed = KW._with_mode(KW.parse_queries(asked(spark).withColumn("most", own)))
    got = {}
    for r in KW._exact(parsed, index, p).collect():
        got.setdefault(r.query_id, []).append((r.vector_id, r.match_score))
    for i, scores in brute_all(p).items():
        best = sorted(scores.items(), key=lambda x: (-x[1], x[0]))
        assert sorted(got.get(i, [])) == sorted(best[: i % 3 or None]), QUERIES[i]


def test_block_bounds_hold(spark, stored):
    """No candidate scores more than its block is said to reach, and no block with a candidate is left out."""
    p, index = stored
    facts, terms, spelled = KW._asking(asked(spark), index)
    bounds = {(r.query_id, r.batch, r.block): r.at_most for r in KW._block_bounds(index, spelled, terms, facts).collect()}
    place = {r.vector_id: (r.batch, r.block) for r in index.live_chunks().collect()}
    for i, scores in brute_all(p).items():
        for vector, score in scores.items():
            assert score <= bounds[(i, *place[vector])]


def test_statistics_after_a_replaced_batch(spark, stored):
    p, index = stored
    want, totals = {}, {}
    for r in p.collect():
        state = 2 if r.document_status == "DELETED" else 0 if r.active else 1
        ws = r.normalized_text.split()
        totals[state] = totals.get(state, 0) + len(ws)
        for w in set(ws):
            want.setdefault(w, [0, 0, 0])[state] += 1
    got = {r.word: [r.df_active, r.df_historical, r.df_deleted] for r in index.table("words").groupBy("word").agg(*(F.sum(c).alias(c) for c in ("df_active", "df_historical", "df_deleted"))).collect()}
    assert {w: n for w, n in got.items() if any(n)} == want
    t = index.collection_totals().first()
    assert [t.words_active, t.words_historical, t.words_deleted] == [totals[k] for k in range(3)] and t.docs_active + t.docs_historical + t.docs_deleted == p.count()
    assert index.live_chunks().count() == p.count()


def test_words_with_brute_force(spark, stored):
    index = stored[1]
    words = {r.word for r in index.table("vocabulary").collect()}
    terms = {"a", "ru", "sub", "kisan", "hous", "old-age", "(note)", "zzzzz", "é", "00%", "absent-from-all"} | {w[1:] for w in words if len(w) > 1}
    got = [tuple(r) for r in index.words_with(spark.createDataFrame([(t,) for t in terms], "term string")).collect()]
    assert len(got) == len(set(got)) and set(got) == {(t, w) for t in terms for w in words if t in w}


def test_search_reads_its_buckets_and_tokenises_nothing(spark, stored):
    p, index = stored
    plan = index.within("postings", asked(spark))._jdf.queryExecution().toString()
    assert "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    found = ranking.bm25(asked(spark), index, 5, within=True)
    plan = found._jdf.queryExecution().toString()
    assert "chunk_text" not in plan and "normalized_text" not in plan


def test_bm25_brute_force(spark, stored):
    p, index = stored
    rows, got = p.collect(), {}
    for r in ranking.bm25(asked(spark), index, 5, within=True).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vector_id, r.bm25))
    for i, t in enumerate(QUERIES):
        seen = [(r.vector_id, r.normalized_text.split()) for r in rows if r.document_status != "DELETED" and (i % 2 == 0 or r.active)]
        n, avgdl, scores = len(seen), sum(len(ws) for _, ws in seen) / len(seen), {}
        for term in set(spark.createDataFrame([(t,)], "q string").select(X.words(X.normalize_for_search(F.col("q")))).first()[0]):
            df = sum(term in ws for _, ws in seen)
            for vector, ws in seen:
                if tf := ws.count(term):
                    scores[vector] = scores.get(vector, 0) + math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ws) / avgdl))
        want = sorted(((v, round(s, 6)) for v, s in scores.items()), key=lambda x: (-x[1], x[0]))[:5]
        assert [(v, pytest.approx(s, abs=2e-6)) for _, v, s in sorted(got.get(i, []))] == want


def test_bm25_floors_change_nothing(spark, stored, monkeypatch):
    """Floors from all of the blocks, from half of them or from none change nothing."""
    p, index = stored
    want = sorted(map(tuple, ranking.bm25(asked(spark), index, 2).collect()))
    for some in (1, 2, 10 ** 9):
        monkeypatch.setattr(ranking, "FLOOR_BLOCKS", some)
        assert sorted(map(tuple, ranking.bm25(asked(spark), index, 2).collect())) == want


def test_top_k_is_limited_before_the_shuffle(spark):
    df = spark.range(100).selectExpr("id % 5 as query_id", "cast(id as string) as vector_id", "id * 1.0d as s")
    assert "WindowGroupLimit" in KW.top_k(df, "s", 3)._jdf.queryExecution().toString()


def test_no_cross_product(spark, stored):
    p, index = stored
    plan = KW.keyword_scores(asked(spark), index, p)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def merged(spark, kw, vec, how="last"):
    k = spark.createDataFrame(kw, "query_id int, vector_id string, version_id string, page_number int, kw_score double, kw_rank int")
    v = spark.createDataFrame(vec, "query_id int, vector_id string, version_id string, page_number int, vec_score double, vec_rank int")
    return {r.vector_id: r for r in fusion.merge_candidates(k, v, how).collect()}




@pytest.mark.parametrize("how,want", [("last", 0.3), ("best", 0.9)])
def test_page_merge_modes(spark, how, want):
    kw = [(1, "k1", "v", 1, 1.0, 1), (1, "k2", "v", 1, 0.8, 2), (1, "k3", "v", 2, 0.5, 3)]
    vec = [(1, "x1", "v", 1, 0.9, 1), (1, "x2", "v", 9, 0.7, 2), (1, "x3", "v", 1, 0.3, 3), (1, "x4", "v", 9, 0.2, 4)]
    got = merged(spark, kw, vec, how)
    assert set(got) == {"k1", "k2", "k3", "x2"}
    assert got["k1"].vec_score == want and got["k1"].in_vector and not got["k2"].in_vector and not got["k3"].in_vector
    assert got["x2"].vec_score == (0.2 if how == "last" else 0.7) and not got["x2"].in_keyword


def test_fusion_scores(spark):
    rows = [("both", 1.0, 0.6, True, True, False), ("kw", 1.0, 0.0, True, False, False), ("weak", 0.0, 0.0, True, False, False), ("old", 0.0, 0.0, True, False, True),
            ("vec", 0.0, 0.47, False, True, False), ("low", 0.0, 0.30, False, True, False), ("oldvec", 0.0, 0.49, False, True, True)]
    df = spark.createDataFrame(rows, "vector_id string, kw_score double, vec_score double, in_keyword boolean, in_vector boolean, is_historical boolean")
    got = {r.vector_id: r for r in fusion.fused_scores(df).collect()}
    assert {k: v.score for k, v in got.items()} == {"both": 0.95, "kw": 0.95, "weak": 0.5, "vec": 0.52}
    assert got["both"].retrieval_reason == "Hybrid Match: Exact keyword match + Semantic similarity (0.60)"
    assert got["vec"].retrieval_reason == "Semantic Match: High vector similarity (0.47)"


def test_final_rank_prefers_active_then_newer(spark):
    rows = [(1, "a", 0.8, True, 3, 1, None), (1, "b", 0.8, False, 1, 2, None), (1, "c", 0.8, False, 2, None, 1), (1, "d", 0.9, True, 1, None, 2), (1, "e", 0.8, False, 2, 3, None)]
    df = spark.createDataFrame(rows, "query_id int, vector_id string, score double, is_historical boolean, version_number int, kw_rank int, vec_rank int")
    assert [r.vector_id for r in fusion.final_rank(df, 4).orderBy("rank").collect()] == ["d", "e", "c", "b"]


def test_reciprocal_rank_fusion(spark):
    l = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query_id int, vector_id string, rank int")
    r = spark.createDataFrame([(1, "b", 1), (1, "c", 2)], "query_id int, vector_id string, rank int")
    got = [(x.vector_id, x.rrf) for x in ranking.reciprocal_rank_fusion(l, r, 3).orderBy("rank").collect()]
    assert got == [("b", round(1 / 62 + 1 / 61, 8)), ("a", round(1 / 61, 8)), ("c", round(1 / 62, 8))]


def test_payload_does_not_sort_its_texts(spark, sf_dir):
    from folioground.operators import index as I
    from folioground.sources import views as V
    p = I.chunk_payload(V.page_passages(spark, sf_dir), V.documents(spark, sf_dir), V.versions(spark, sf_dir))
    top = p._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=shuffle_hash" in top


def test_written_tables_leave_no_shuffle_files(spark):
    files = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}
    before = files()
    kept = stage_table(spark.range(5000).groupBy((F.col("id") % 700).alias("k")).agg(F.collect_list("id").alias("ids")), "kept")
    assert not files() - before
    assert kept.selectExpr("sum(size(ids))").first()[0] == 5000


def test_vectors_are_written_once(spark, sf_dir):
    path = R.passage_vector_store(spark, sf_dir)
    assert all(path in f for f in R.passage_vectors(spark, sf_dir).inputFiles())

def test_payload_holds_each_text_once(spark, sf_dir):
    """Snippet and search text are not written but derived; they are what a payload of passages with search text has."""
    from folioground.operators import index as I
    from folioground.sources import views as V
    p = R.passage_payload(spark, sf_dir)
    written = spark.read.parquet(*{f.rsplit("/", 1)[0] for f in p.inputFiles()}).columns
    assert "chunk_text" in written and not {"snippet", "normalized_text"} & set(written)
    texts = ["vector_id", "snippet", "chunk_text", "normalized_text"]
    whole = I.chunk_payload(V.page_passages(spark, sf_dir), V.documents(spark, sf_dir), V.versions(spark, sf_dir))
    assert sorted(map(tuple, p.select(texts).collect())) == sorted(map(tuple, whole.select(texts).collect()))


def test_search_text_is_derived_where_texts_arrive(spark, stored):
    """The search text of a payload that derives it does not move, and the scores are those of one that holds it."""
    from folioground.operators import index as I
    p, index = stored
    odd = p.withColumn("chunk_text", F.concat(F.col("chunk_text"), F.lit(" ﬁnal Ⅳ kisan’s ")))
    held = odd.withColumn("normalized_text", X.normalize_for_search(F.col("chunk_text")))
    derived = I.with_derived_texts(odd.drop("normalized_text").withColumn("compat_text", X.compat_text(F.col("chunk_text"))))
    found = KW.keyword_scores(asked(spark), index, derived)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, KW.keyword_scores(asked(spark), index, held).collect()))
    below = found._jdf.queryExecution().optimizedPlan().toString().partition("RepartitionByExpression")[2]
    assert "compat_text" in below and "regexp_replace(lower(coalesce(compat_text" not in below

def test_texts_are_embedded_where_they_are_compared(spark, monkeypatch):
    """Vectors given as texts have the neighbours that stored vectors have, in several blocks and with null and empty texts."""
    rows = [(f"v{i}", f"ns{i % 2}", None if i == 7 else " " * (i == 8) or f"word{i % 5} and{i} kisan{i % 3}") for i in range(40)]
    texts = spark.createDataFrame(rows, "vector_id string, namespace string, text string")
    embed = VX.hashing_embedder()
    vectors = texts.withColumn("values", embed(F.col("text"))).drop("text")
    q = vectors.where("vector_id in ('v1', 'v2', 'v9', 'v20')").withColumnRenamed("vector_id", "query_id")
    monkeypatch.setattr(knn, "VALUES_PER_BLOCK", 6 * 1536)
    monkeypatch.setattr(knn, "QUERIES_PER_BLOCK", 1)
    want = sorted(map(tuple, knn.nearest(q, vectors, 5).collect()))
    found = knn.nearest(q, texts, 5, embed=VX.hash_texts)
    assert len(want) == 20 and sorted(map(tuple, found.collect())) == want


def test_search_words_are_counted_without_the_search_text(spark):
    """Counted on the text, as many as its search text has, of every kind of character that the rules know."""
    rnd = random.Random(5)
    odd = "aZ09_.,-%/:;!?()\t\n\x0b\x1c\x1f\x20\x85\xa0\u1680\u180e\u2003\u200b\u2028\u3000éßİΣσﬁⅣ²٣\u0301हिन्दी漢😀𝐀\ufeff’"
    texts = [None, "", " ", "Σ Σ", *("".join(rnd.choice(odd) for _ in range(rnd.randint(1, 40))) for _ in range(600))]
    t = spark.createDataFrame([(x,) for x in texts], "t string")
    got = t.select("t", X.search_word_count(F.col("t")).alias("n"), X.word_count(X.fold_for_search(F.col("t"))).alias("want")).collect()
    assert len({r.want for r in got}) > 5 and all(r.n == r.want for r in got)


def test_totals_need_no_postings(spark, sf_dir, monkeypatch):
    """Totals of two batches come from their chunks; words stay unwritten until a query reads them."""
    monkeypatch.setattr(R, "_STAGED", {})
    written, write = [], SI.SearchIndex._write
    monkeypatch.setattr(SI.SearchIndex, "_write", lambda self, df, name: written.append(name) or write(self, df, name))
    got = {r.collection_id: (r.live, r.n_words) for r in R.index_totals(spark, sf_dir).collect()}
    p = R.passage_payload(spark, sf_dir).withColumn("w", F.size(X.words(F.col("normalized_text"))))
    want = p.groupBy("collection_id").agg(F.count_if(F.col("document_status") != "DELETED").alias("live"), F.sum("w").alias("n"))
    assert got == {r.collection_id: (r.live, r.n) for r in want.collect()}
    assert written.count("totals") == 3 and written.count("postings") == written.count("words") == 1  # the empty tables and two batches


def test_packed_chunks_are_written_once_and_no_vector_is(spark, sf_dir, monkeypatch):
    """The payload made with one move of the text is that of two, and search by texts finds what stored vectors find."""
    from folioground.operators import index as I
    from folioground.plans.answer import hybrid_search
    from folioground.registry import flows, text as RT
    from folioground.sources import views as V
    monkeypatch.setattr(R, "_STAGED", {})
    payload, index, texts = flows.index_tables(spark, sf_dir)
    written = set(spark.read.parquet(*{f.rsplit("/", 1)[0] for f in payload.inputFiles()}).columns)
    assert "chunk_text" in written and not {"snippet", "normalized_text", "values"} & written
    assert "values" not in texts.columns and set(texts.inputFiles()) == set(payload.inputFiles())
    whole = stage_table(I.chunk_payload(RT.chunks(spark, sf_dir), V.documents(spark, sf_dir), V.versions(spark, sf_dir)), "whole")
    assert sorted(map(str, payload.select(whole.columns).collect())) == sorted(map(str, whole.collect()))
    vectors = stage_table(I.vector_records(whole, VX.hashing_embedder()), "vectors")
    asked_ = V.bench_queries(spark, sf_dir)
    want = hybrid_search(asked_, whole, SI.build(whole, stage_path(spark, "whole_index"), words=False), vectors, VX.hashing_embedder())
    got = flows.hybrid_search_chunks(spark, sf_dir).select(want.columns)
    assert want.count() > 0 and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
