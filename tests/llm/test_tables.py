"""Vectors, revisits and the pipeline against brute force."""

import math

import numpy as np
from pyspark.sql import functions as F

from folioground.llm import caps, quality, revisits, tokens

import corpus_pipeline


def test_links_of_odd_vectors(spark):
    r = np.random.Generator(np.random.PCG64(11))
    centres = r.standard_normal((12, 24))
    vectors = [list(map(float, c + 0.08 * r.standard_normal(24))) for c in centres for _ in range(8)] + [list(map(float, x)) for x in r.standard_normal((60, 24))]
    vectors += [vectors[0]] * 5 + [None, [], [0.0] * 24, [float("nan")] + [1.0] * 23, [float("inf")] * 24, [1.0, None], [1.0], [2.0], [-1.0], [1e300, 1e300], [1e-300, 1e-300]]
    rows = [(i, v, "own", 1) for i, v in enumerate(vectors)] + [(None, vectors[9], "own", 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, node string, n_links int").repartition(4)
    able = {i: np.array(v, float) / np.max(np.abs(np.array(v, float))) for i, (_, v, *_) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and any(v)}
    links = {i: set() for i in range(len(rows))}
    for i, a in able.items():
        for j, b in able.items():
            if i != j and len(a) == len(b) and (a @ b) / math.sqrt((a @ a) * (b @ b)) >= 0.9:
                links[i].add(j)
    want, true = [], sum(map(len, links.values()))
    for i, (vec_id, *_) in enumerate(rows):
        reach, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - reach:
                reach.add(j)
                todo.append(j)
        least = min((rows[j][0] for j in reach if rows[j][0] is not None), default=None)
        want.append((vec_id, len(links[i]), least, vec_id == least))
    got = [(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in caps.near_vectors(df).collect()]
    found = {g[0]: g for g in got}
    assert len(got) == len(rows) and all(found[w[0]][1] <= w[1] for w in want)
    assert sum(g[1] for g in got) >= 0.9 * true
    assert sum(found[w[0]] == w for w in want) >= 0.97 * len(want)
    assert caps.near_vectors(df.where("false")).count() == 0


def test_recall_at_the_limit():
    """Pairs at a cosine of just 0.9 share a filter nearly always, at any number of filters."""
    r = np.random.Generator(np.random.PCG64(3))
    for count in (20, 120, 400):
        a, n = r.standard_normal((2, 300, 64))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        n -= (n * a).sum(axis=1, keepdims=True) * a
        b = 0.9 * a + math.sqrt(0.19) * n / np.linalg.norm(n, axis=1, keepdims=True)
        met = [bool(set(x) & set(y)) for x, y in zip(caps.list_decode(a, count, caps.LISTED), caps.list_decode(b, count, caps.LISTED))]
        assert np.mean(met) >= 0.95


def test_canonical_urls(spark):
    pairs = [("HTTP://User@WWW.Example.COM:80/A/b/?utm_source=x&b=2&a=1#frag", "example.com/A/b?a=1&b=2"), ("https://example.com:443", "example.com"), ("http://e.org/?ref=1", "e.org"),
             ("http://e.org/p?", "e.org/p"), ("not a url", "not a url"), ("", ""), (None, None), ("https://e.org:8080/x//", "e.org:8080/x")]
    got = spark.createDataFrame(pairs, "url string, want string").select(revisits.canonical_url(F.col("url")).alias("got"), "want").collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_odd_revisits(spark):
    h = {"Content-Type": "text/html", "Date": "1", "ETag": "a"}
    rows = [(1, "http://a.org/x", 10, "response", '"v1"', 5, "d1", h), (2, "http://www.a.org/x#f", 20, "revisit", 'W/"v1"', None, None, {"date": "2", "Content-Length": "0"}),
            (3, "http://a.org/x", 30, "revisit", '"v2"', 5, None, None), (4, "http://a.org/x", 40, "revisit", None, 5, None, {}), (5, "http://a.org/x", 50, "revisit", None, None, None, {}),
            (6, "http://b.org/x", 5, "revisit", '"v1"', None, None, {}), (7, None, 60, "revisit", '"v1"', None, None, {}), (8, "http://a.org/x", None, "revisit", '"v1"', 5, None, {}),
            (9, "http://a.org/x", 45, "response", None, 7, "d9", None), (10, "http://a.org/x", 46, "revisit", None, 7, None, {}), (10, "http://a.org/x", 46, "revisit", None, 7, None, {}),
            (11, "http://a.org/x", None, "response", None, 7, "d11", {}), (12, "http://a.org/x", 1, "revisit", None, 7, None, {})]
    df = spark.createDataFrame(rows, "record_id bigint, url string, time bigint, kind string, etag string, last_modified bigint, digest string, headers map<string,string>")
    got = sorted((r["record_id"], r["outcome"], r["refers_to"], r["digest"], r["headers"]) for r in revisits.resolve(df.withColumn("part", F.lit(1)).withColumn("full", F.lit(2)).repartition(3)).collect())
    assert [g[:4] for g in got] == [(2, "resolved", 1, "d1"), (3, "validator_mismatch", None, None), (4, "resolved", 1, "d1"), (5, "no_validator", None, None), (6, "no_earlier", None, None),
                                    (7, "no_earlier", None, None), (8, "no_earlier", None, None), (10, "resolved", 9, "d9"), (10, "resolved", 9, "d9"), (12, "no_earlier", None, None)]
    assert got[0][4] == {"content-type": "text/html", "etag": "a", "date": "2"} and got[7][4] == {}
    assert revisits.resolve(df.where("false")).count() == 0


def test_a_hot_url_spans_partitions(spark):
    df = spark.range(4000).select(F.col("id").alias("record_id"), F.lit("http://a.org/").alias("url"), F.col("id").alias("time"), F.when(F.col("id") % 1500 == 3, "response").otherwise("revisit").alias("kind"),
                                  F.lit('"v"').alias("etag"), F.lit(None).cast("bigint").alias("last_modified"), F.lit("d").alias("digest"), F.lit(None).cast("map<string,string>").alias("headers"))
    got = revisits.resolve(df).where("outcome = 'resolved'").select((F.col("refers_to") == F.floor((F.col("record_id") - 3) / 1500) * 1500 + 3).alias("ok")).groupBy("ok").count().collect()
    assert [(r["ok"], r["count"]) for r in got] == [(True, 4000 - 3 - 3)]


def test_pipeline_keeps_clean_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    good = corpus_pipeline.good_documents(spark, docs, sf_dir).persist()
    assert good.columns == docs.columns
    assert good.subtract(docs).isEmpty()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    clean = quality.text_statistics(docs.join(labels.where("quality = 1"), "doc_id"), ["doc_id"]).where(~quality.base_failed())
    lost = clean.join(good, "doc_id", "left_anti").count()
    assert lost <= 0.01 * clean.count()
    known = corpus_pipeline.known_languages(spark, good, sf_dir).persist()
    assert known.columns == docs.columns and known.count() >= 0.99 * good.count()
    pieces = corpus_pipeline.training_sequences(spark, known, sf_dir)
    assert {r[0] for r in pieces.select("doc_id").distinct().collect()} == {r[0] for r in known.select("doc_id").collect()}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "language identification", "near duplicates", "packing"]


def test_run_against_brute_force_classes_and_pieces(spark, sf_dir, tmp_path):
    """Near duplicates and packing of ``run`` over null and repeated rows; the kept rows of the first two stages are its own."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(150)
    odd = docs.limit(1).union(docs.limit(2).withColumn("doc_id", F.lit(None).cast("bigint"))).union(docs.limit(1).withColumn("text", F.lit(None).cast("string")))
    docs.union(odd).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    known = corpus_pipeline.known_languages(spark, corpus_pipeline.good_documents(spark, docs, str(tmp_path)).persist(), str(tmp_path))
    rows = [(r["doc_id"], r["text"]) for r in known.select("doc_id", "text").collect()]
    sets = [frozenset(zip(*(w[i:] for i in range(5)))) for w in ((t or "").lower().split() for _, t in rows)]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    least = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in group}
    encoder = tokens.encoder(tokens.vocabulary_path()).tokenizer
    texts = dict(rows)
    got = {}
    for r in sorted(corpus_pipeline.run(spark, str(tmp_path)).collect(), key=lambda r: r["start"]):
        got.setdefault(r["doc_id"], []).extend(np.frombuffer(r["ids"], "<u4").tolist())
    assert set(got) == set(least.values()) and len(rows) > len(got) > 20
    assert all(ids == [*encoder.encode(texts[i], add_special_tokens=False).ids, 1] for i, ids in got.items())
