"""Pivot search, whitening and ranked lexical search against brute force."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioground.llm import balls, pivots, whitening

VECTORS = "vec_id bigint, embedding array<double>, label int"


@pytest.fixture(scope="module")
def vectors(spark):
    """Clusters, copies, ties and every kind of odd vector, with columns of clashing names."""
    r = np.random.Generator(np.random.PCG64(5))
    centres = r.standard_normal((6, 12))
    values = [list(map(float, c + 0.1 * r.standard_normal(12))) for c in centres for _ in range(40)]
    values += [values[3]] * 60 + [None, [], [0.0] * 12, [float("nan")] + [1.0] * 11, [float("inf")] * 12, [1.0, None], [1.0], [2.0], [-1.0], [2.0], [-0.0, 1e-9], [1e6] * 12]
    rows = [(i, v, 1) for i, v in enumerate(values)] + [(None, values[9], 1), (50, values[50], 2), (50, values[51], 2)]
    df = spark.createDataFrame(rows, VECTORS)
    return rows, df.select("*", *(F.lit(f"own {c}").alias(c) for c in ("key", "row", "x", "size", "rank", "score", "ask", "block", "query", "n", "at", "whitened", "component"))).repartition(4)


def usable(v):
    return v is not None and None not in v and all(map(math.isfinite, v))


def test_pivot_search(vectors, monkeypatch):
    rows, df = vectors
    x = [[math.floor(256 * c) for c in v] if usable(v) else None for _, v, _ in rows]
    want = []
    for i, (key, _, _) in enumerate(rows):
        if key is None or key % 10 or x[i] is None:
            continue
        scores = [(-sum(a * b for a, b in zip(x[i], x[j])), rows[j][0] is None, rows[j][0] or 0) for j in range(len(rows)) if j != i and x[j] is not None and len(x[j]) == len(x[i])]
        want += [(key, rank + 1, None if null else other, -s) for rank, (s, null, other) in enumerate(sorted(scores)[:5])]
    asks = F.col("vec_id") % 10 == 0
    for block in (16384, 16):  # one block, and many
        monkeypatch.setattr(pivots, "BLOCK", block)
        monkeypatch.setattr(pivots, "PAGE", 4 if block == 16 else 8192)
        got = [tuple(r) for r in pivots.top_k(df, asks).collect()]
        by = lambda r: (r[0], r[1], r[3], r[2] or -1)
        # Rows with one id hold one rank twice: compare as a whole.
        assert sorted(got, key=by) == sorted(want, key=by)
    empty = pivots.top_k(df.where("false"), asks)
    assert empty.count() == 0 and empty.columns == ["query_id", "rank", "vec_id", "score"]


def test_bounds_eliminate():
    """Candidates whose bound is too low are not evaluated."""
    r = np.random.Generator(np.random.PCG64(1))
    x = np.concatenate([np.full((50, 8), 200), np.full((5000, 8), -200)]) + r.integers(-9, 9, (5050, 8))
    chosen = pivots.choose_pivots(x, 8)
    far = pivots.distances(x, chosen)
    block = pivots.Block(list(range(len(x))), np.arange(len(x)), x, far)

    class Counting:
        seen = 0

        def __getitem__(self, rows):
            Counting.seen += len(rows)
            return x[rows].astype(float)

        def __len__(self):
            return len(x)

    block.x = Counting()
    best = block.best(x[0], far[0], None, 5, own=0)
    scores = x @ x[0]
    assert sorted(block.scores) == sorted(scores[[j for j in np.argsort(-scores, kind="stable") if j][:5]].tolist()) and len(best) == 5
    assert Counting.seen <= 64 + 512


def test_whitening(vectors, spark):
    rows, df = vectors
    rows = [r for r in rows if r[1] != [1e6] * 12]  # its deviation is no 64-bit integer and raises
    df = df.where(F.coalesce(F.try_element_at("embedding", F.lit(1)) != 1e6, F.lit(True)))
    of_length = {}
    for key, v, _ in rows:
        if usable(v):
            of_length.setdefault(len(v), []).append((key, [math.floor(64 * c) + 1_000_000 for c in v]))
    got = whitening.whiten(df).collect()
    assert len(got) == sum(min(16, size) * len(own) for size, own in of_length.items())
    for size, own in of_length.items():
        if not size:
            continue
        x = np.array([v for _, v in own], object)
        fit = np.array(sorted({tuple(v) for _, v in own}), object)
        n, total = len(fit), fit.sum(axis=0)
        centred = ((n * fit - total) / n).astype(float)
        covariance = centred.T @ centred / n
        values, axes = np.linalg.eigh(covariance)
        values, axes = values[::-1], axes[:, ::-1]
        alive = values[: min(16, size)] > 1e-12 * values[0]
        deviations = ((n * x - total) ** 2).sum(axis=1)
        per_row = {}
        for r in got:
            per_row.setdefault((r["vec_id"], r["n"], r["deviation"]), []).append(r)
        for (key, v), deviation in zip(own, deviations):
            mine = sorted(per_row[(key, n, deviation)], key=lambda r: r["component"])[:: max(1, sum(o == (key, v) for o in own))]
            if not any(m["n"] == n for m in mine):
                continue
            for i in range(min(16, size)):
                same = [r for r in per_row[(key, n, deviation)] if r["component"] == i + 1]
                assert same and (same[0]["whitened"] is None) == (not alive[i])
                if alive[i]:
                    assert same[0]["explained"] == pytest.approx(values[i] / np.trace(covariance), rel=1e-6, abs=1e-12)
                    assert same[0]["identity_error"] < 1e-4
                    if np.min(np.abs(np.delete(values, i) - values[i]), initial=np.inf) > 1e-3 * values[i]:
                        want = abs(float(((n * np.array(v, object) - total) / n).astype(float) @ axes[:, i]) / math.sqrt(values[i]))
                        assert any(abs(r["whitened"]) == pytest.approx(want, abs=1e-6) for r in same)
    empty = whitening.whiten(df.where("false"))
    assert empty.count() == 0 and [c for c, _ in empty.dtypes] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_whitening_of_what_does_not_vary(spark):
    got = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)], VECTORS)).collect()
    assert {(r["vec_id"], r["component"]) for r in got} == {(1, 1), (1, 2), (2, 1), (2, 2)}
    assert all((r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) == (1, 0, None, None, None) for r in got)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranked(docs, items, k):
    held = [(key, words(text)) for key, text in docs]
    n_docs, total = sum(bool(w) for _, w in held), sum(len(w) for _, w in held)
    df = {}
    for _, w in held:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        scores = []
        for key, w in held:
            m = 10 + 90 * len(w) * n_docs // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * w.count(t) // (1000 * w.count(t) + 8 * m)) for t in set(words(text)) if t in df and t in w)
            if s > 0:
                scores.append((-s, key is None, key or 0))
        out += [(item, rank + 1, None if null else key, -s) for rank, (s, null, key) in enumerate(sorted(scores)[:k])]
    return out


def test_ranked_search(spark, docs, no_docs, rows, monkeypatch):
    texts = [(r[0], r[1]) for r in rows]
    items = [(1, "the of An re der die das"), (2, None), (None, "under the MIT license, and " + rows[13][1][:300]), (2, "MIT mit Licence 12 34"), (3, "notaword anywhereatall"), (4, "é ß ü x" + "x" * 20), (5, rows[11][1][:2000])]
    asked = spark.createDataFrame(items, "item_id int, text string").select("*", F.lit("own").alias("row"), F.lit(7).alias("score"))
    by = lambda r: (r[0] is None, r[0] or 0, r[1], -r[3], r[2] is None, r[2] or 0)
    want = sorted(ranked(texts, items, 10), key=by)
    assert len(want) > 30
    for tree, leaf, block in ((1 << 20, 16, 1 << 18), (3000, 2, 40)):  # one tree of one block; many small trees, several blocks of items
        monkeypatch.setattr(balls, "TREE", tree)
        monkeypatch.setattr(balls, "LEAF", leaf)
        monkeypatch.setattr(balls, "ITEM_TERMS", block)
        got = balls.search(docs.select("*", F.lit(1).alias("term"), F.lit(2).alias("rank"), F.lit(3).alias("item")), asked).collect()
        assert sorted(map(tuple, got), key=by) == want
    for d, i in ((no_docs, asked), (docs, asked.where("false")), (docs.where("doc_id = 0"), asked)):
        empty = balls.search(d, i)
        assert empty.count() == 0 and empty.columns == ["item_id", "rank", "doc_id", "score"]


def test_bounds_hold_and_prune():
    """No score below a node exceeds its bound, and far leaves are not scored."""
    r = np.random.Generator(np.random.PCG64(9))
    texts = [" ".join(f"{'abcd'[i % 4]}{r.integers(0, 60 if j % 3 else 3000)}" for j in range(60)) for i in range(400)]
    data = np.frombuffer(" ".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
    offsets[-1] = len(data)
    doc, term, tf, _ = balls.term_counts(data, offsets)
    value = 1_000_000_000 * tf // (1000 * tf + 800)
    tree = balls.build_tree(doc, term, value, len(texts)) | {"keys": None}
    tree["keys"] = tree["order"].tolist()
    picked = np.concatenate([r.choice(np.unique(term), 10, replace=False) for _ in range(6)])
    items = balls.Items(np.repeat(np.arange(6), 10), picked, r.integers(1, 9000, 60))
    dense = np.zeros((len(texts), 6), np.int64)
    for i, (at, weights) in enumerate(items.of):
        for w, x in zip(at, weights):
            held = term == items.vocabulary[w]
            dense[doc[held], i] += x * value[held]
    bounds, below = items.bounds(tree), {}
    for node in range(len(tree["children"]) - 1, -1, -1):
        low, high = tree["spans"][node]
        below[node] = tree["order"][low:high].tolist() if low >= 0 else [d for c in tree["children"][node] if c >= 0 for d in below[int(c)]]
        assert (dense[below[node]].max(axis=0) <= bounds[node]).all()
    assert sorted(below[0]) == list(range(len(texts)))
    best = [[] for _ in range(6)]
    scored = balls.search_tree(tree, items, best, 3, np.ones(6, np.int64))
    assert scored < 6 * (tree["spans"][:, 0] >= 0).sum()
    for i in range(6):
        want = sorted(((-s, d) for d, s in enumerate(dense[:, i]) if s > 0))[:3]
        assert [(-s, d) for s, d in best[i]] == want
