"""Near-duplicate vectors by spherical-cap filters.

Filters are directions of a structured random code: a direction is one codeword of each half of the dimensions, so B
codewords a half stand for B * B directions. A vector passes the filters whose direction it exceeds a threshold with.
These are list-decoded: the inner products with the codewords of one half are searched, sorted, for what each codeword
of the other half leaves to reach. Vectors are joined on shared filters and every pair in a filter is verified by its
cosine in double precision; a pair that shares several filters counts in the first. Two vectors that are close pass
many of the same filters, so few pairs are missed (recall is measured in the tests); no pair below the limit is linked.

The number of filters follows the number of vectors, so that a filter holds as many at every size. A filter that holds
more is worked on in pairs of blocks of bounded size. Only counts of links and the tree of each block's links leave a
task, never the pairs. Equal vectors are one class with a weight first.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing and stay;
vectors of different length are compared with their like only; a null vec_id keeps its row, and is not a
``component_id`` unless nothing else is there (then null); repeated rows link with each other and count each; an empty
table gives no rows; columns other than the named ones are ignored, whatever they are called.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from folioground.llm.base import components, staged

#: Independent codes, each after a rotation of its own; filters of each that a vector is expected to pass; vectors that a
#: filter is expected to hold; and rows of a block.
CODES, LISTED, HELD, BLOCK = 5, 16, 64, 1024
SEED = 7


def _stored(v: np.ndarray) -> bytes:
    """Little-endian components, a byte for their width before them: single precision where that is exact."""
    with np.errstate(over="ignore"):
        short = v.astype("<f4")
    return b"\x04" + short.tobytes() if (short == v).all() else b"\x08" + v.astype("<f8").tobytes()


def _read(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<f4" if raw[0] == 4 else "<f8", offset=1).astype(np.float64)


def _classes(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, node, unit): ``node`` names equal vectors, ``unit`` is the vector as doubles; both null where it cannot link."""
    kind = dict(vectors.dtypes)[key]

    def run(batches):
        for batch in batches:
            nodes, kept = [], []
            for x in batch.column(1):
                values = x.values
                v = None if values is None or len(values) == 0 or values.null_count else np.asarray(values, np.float64)
                ok = v is not None and np.isfinite(v).all() and v.any()
                nodes.append(hashlib.blake2b((v + 0.0).astype("<f8").tobytes(), digest_size=16).digest() if ok else None)
                kept.append(_stored(v) if ok else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.binary()), pa.array(kept, pa.binary())], ["key", "node", "vector"])

    return vectors.select(F.col(key), F.col(vector).cast("array<double>")).mapInArrow(run, f"key {kind}, node binary, vector binary")


@lru_cache(maxsize=16)
def _codewords(dimensions: int, count: int, code: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A rotation and the unit codewords of both halves, by a fixed generator."""
    rng = np.random.Generator(np.random.PCG64([SEED, dimensions, count, code]))
    rotation, halves = np.linalg.qr(rng.standard_normal((dimensions, dimensions)))[0], []
    for d in (dimensions - dimensions // 2, dimensions // 2):
        c = rng.standard_normal((count, d)) if d else np.zeros((count, 0))
        halves.append(c / np.maximum(np.sqrt((c * c).sum(axis=1, keepdims=True)), 1e-300))
    return rotation, halves[0], halves[1]


@lru_cache(maxsize=16)
def _threshold(dimensions: int, count: int, listed: float) -> float:
    """Sum of both halves' inner products that a random direction exceeds with ``listed`` filters of a code on average.

    By bisection over a fixed sample of directions, as the tails of a sphere are lighter than normal ones.
    """
    rng = np.random.Generator(np.random.PCG64([SEED, dimensions]))
    x = rng.standard_normal((100, dimensions))
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    _, first, second = _codewords(dimensions, count, 0)
    half = dimensions - dimensions // 2
    a, b = x[:, :half] @ first.T, np.sort(x[:, half:] @ second.T, axis=1)
    low, high = 0.0, 2.0
    for _ in range(30):
        middle = (low + high) / 2
        passed = sum(int((count - np.searchsorted(b[i], middle - a[i])).sum()) for i in range(len(x)))
        low, high = (middle, high) if passed > listed * len(x) else (low, middle)
    return low


def list_decode(units: np.ndarray, count: int, listed: float) -> list[np.ndarray]:
    """Sorted numbers of all filters (``count`` * ``count`` in each code) that each unit vector exceeds."""
    d = units.shape[1]
    half = d - d // 2
    threshold = _threshold(d, count, listed)
    out: list[list[np.ndarray]] = [[] for _ in units]
    for code in range(CODES):
        rotation, first, second = _codewords(d, count, code)
        turned = units @ rotation
        a, b = turned[:, :half] @ first.T, turned[:, half:] @ second.T
        order = np.argsort(-b, axis=1, kind="stable")
        for i in range(len(units)):
            falling = b[i, order[i]]
            enough = np.searchsorted(-falling, a[i] - threshold, "right")  # codewords of the second half for each of the first
            rows = np.repeat(np.arange(count), enough)
            within = np.arange(len(rows)) - np.repeat(np.cumsum(enough) - enough, enough)
            out[i].append(np.sort(code * count * count + rows * count + order[i, within]))
    return [np.concatenate(x) for x in out]


def _number(count: int) -> str:
    """How the numbers of filters are stored."""
    return "<i4" if CODES * count * count < 1 << 31 else "<i8"


def _filtered(classes: DataFrame, count: int) -> DataFrame:
    """A row for each class and filter it passes, with the vector and its whole list."""
    number = _number(count)

    def run(batches):
        for batch in batches:
            for low in range(0, len(batch), 500):
                part = batch.slice(low, 500)
                nodes, raws, weights = (part.column(i).to_pylist() for i in range(3))
                by_length: dict[int, list[int]] = {}
                for i, raw in enumerate(raws):
                    by_length.setdefault(len(raw) // raw[0], []).append(i)
                for d, rows in by_length.items():
                    x = np.array([_read(raws[i]) for i in rows])
                    x = x / np.abs(x).max(axis=1, keepdims=True)
                    lists = list_decode(x / np.sqrt((x * x).sum(axis=1, keepdims=True)), count, LISTED)
                    lengths = [len(f) for f in lists]
                    which = np.repeat(np.array(rows), lengths)
                    flat = np.concatenate(lists)
                    take = pa.array(which)
                    stored = pa.array([f.astype(number).tobytes() for f in lists], pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(flat), d, np.int32)), pa.array(flat), part.column(0).take(take), part.column(1).take(take), part.column(2).take(take), stored.take(pa.array(np.repeat(np.arange(len(rows)), lengths)))],
                        ["d", "filter", "node", "vector", "weight", "list"])

    return classes.select("node", "vector", "weight").mapInArrow(run, "d int, filter bigint, node binary, vector binary, weight bigint, list binary")


def _runs(batches, keys: int):
    """Rows of equal first ``keys`` columns of a sorted stream, as one table each."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        columns = [np.array(batch.column(i)) for i in range(keys)]
        change = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
        for low, high in zip([0, *change], [*change, len(batch)]):
            now = tuple(c[low] for c in columns)
            if last is not None and now != last:
                yield last, pa.Table.from_batches(held)
                held = []
            last = now
            held.append(batch.slice(low, high - low))
    if held:
        yield last, pa.Table.from_batches(held)


def _linked(rows: pa.Table, number: int, i: int, j: int, least: float, stored: str):
    """(node, links, root) of the rows of one block pair that have links which count in this filter."""
    nodes, blocks = rows.column("node").to_pylist(), np.array(rows.column("block"))
    weights = np.array(rows.column("weight"))
    x = np.array([_read(raw) for raw in rows.column("vector").to_pylist()])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    norms = np.sqrt((x * x).sum(axis=1))
    a = np.flatnonzero(blocks == i)
    b = a if i == j else np.flatnonzero(blocks == j)
    close = (x[a] @ x[b].T) / (norms[a][:, None] * norms[b][None, :]) >= least
    if i == j:
        close = np.triu(close, 1)
    if not close.any():
        return [], [], []
    used_a, used_b = np.flatnonzero(close.any(axis=1)), np.flatnonzero(close.any(axis=0))
    before = [np.frombuffer(raw, stored) for raw in rows.column("list").to_pylist()]
    before = [f[f < number] for f in before]
    seen, index = np.unique(np.concatenate(before), return_inverse=True)
    lengths = np.array([len(f) for f in before])
    member = np.zeros((len(nodes), len(seen)), np.float32)
    member[np.repeat(np.arange(len(nodes)), lengths), index] = 1
    pairs = close[np.ix_(used_a, used_b)] & ~(member[a[used_a]] @ member[b[used_b]].T > 0)
    p, q = np.nonzero(pairs)
    p, q = a[used_a][p], b[used_b][q]
    links = np.bincount(p, weights=weights[q], minlength=len(nodes)) + np.bincount(q, weights=weights[p], minlength=len(nodes))
    root = np.arange(len(nodes))
    while True:  # the smallest row that links reach, within the block pair
        was = root.copy()
        np.minimum.at(root, p, root[q])
        np.minimum.at(root, q, root[p])
        root = root[root]
        if (root == was).all():
            break
    out = np.flatnonzero(links)
    return [nodes[k] for k in out], links[out].astype(np.int64), [nodes[root[k]] for k in out]


def near_vectors(vectors: DataFrame, least: float = 0.9, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, n_links, component_id, kept) of every row: links at a cosine of ``least`` or more."""
    rows = staged(_classes(vectors, key, vector), "vectors")
    able = rows.where("node is not null")
    classes = staged(able.groupBy("node").agg(F.count("*").alias("weight"), F.first("vector").alias("vector"), F.min("key").alias("least")), "vector_classes")
    count = max(8, math.ceil(math.sqrt(classes.count() * LISTED / HELD)))
    passed = _filtered(classes, count)
    stored = _number(count)
    # Filters that hold more than a block; the others are one block each.
    large = staged(passed.groupBy("d", "filter").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK), "large_filters")
    blocks = F.coalesce(F.ceil(F.col("n") / BLOCK).cast("int"), F.lit(1))
    dealt = passed.join(large, ["d", "filter"], "left").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    met = dealt.select("d", "filter", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"), "block", "node", "vector", "weight", "list")
    met = met.select("d", "filter", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "vector", "weight", "list")

    def run(batches):
        for (_, number, i, j), table in _runs(batches, 4):
            nodes, links, roots = _linked(table, number, i, j, least, stored)
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(links, pa.int64()), pa.array(roots, pa.binary())], ["node", "links", "root"])

    pairs = ["d", "filter", "i", "j"]
    found = staged(met.repartition(*pairs).sortWithinPartitions(*pairs).mapInArrow(run, "node binary, links bigint, root binary"), "vector_links")
    of = components(found.select(F.col("node").alias("u"), F.col("root").alias("v"))).withColumnRenamed("component", "of")
    linked = classes.join(found.groupBy("node").agg(F.sum("links").alias("links")), "node", "left").join(of, "node", "left").withColumn("of", F.coalesce("of", "node"))
    ids = linked.groupBy("of").agg(F.min("least").alias("component_id"))
    facts = linked.join(ids, "of").select("node", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    out = rows.join(facts, "node", "left").select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.when(F.col("node").isNull(), F.col("key")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))
