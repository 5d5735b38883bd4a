"""Exact nearest vectors inside a namespace, computed block against block."""

from __future__ import annotations

from collections.abc import Callable, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from folioground import constants as C
from folioground.staging import shuffles_dropped

VECTORS_PER_BLOCK = 8192
QUERIES_PER_BLOCK = 8192
#: Values of a block of vectors, 16 MB in doubles; long vectors make blocks of fewer rows.
VALUES_PER_BLOCK = 1 << 21
NAMESPACE_BUCKETS = 64
_STRIPE = 128


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def _unit(m: np.ndarray) -> np.ndarray:
    length = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def _passing(queries: pa.Table, vectors: pa.Table, filters: Mapping[str, str]) -> np.ndarray:
    """Which (query, vector) pairs pass the metadata filters; an absent value on either side passes."""
    ok = np.ones((queries.num_rows, vectors.num_rows), dtype=bool)
    for wanted, held in filters.items():
        both = pd.concat([queries[wanted].to_pandas(), vectors[held].to_pandas()], ignore_index=True)
        codes = pd.factorize(both)[0]
        q, v = codes[:queries.num_rows, None], codes[None, queries.num_rows:]
        ok &= (q == v) | (q < 0) | (v < 0)
    return ok


def nearest(queries: DataFrame, vectors: DataFrame, k: int | Column,
            filters: Mapping[str, str] | None = None, embed: Callable[[list[str]], np.ndarray] | None = None, dim: int = C.EMBEDDING_DIM) -> DataFrame:
    """(query_id, vector_id, vec_score, vec_rank): the ``k`` most similar vectors of each query (a number, or a column of
    ``queries``).

    ``queries`` has query_id, namespace, values; ``vectors`` has vector_id, namespace, values.
    With ``embed`` they have a text instead of values, which it turns into rows of ``dim`` numbers in the task that compares them,
    again for each block of queries: a vector takes several times the room of its text, so vectors are neither stored nor moved.
    ``filters`` maps a query column to a vector column compared as lower-case text.
    A namespace is cut into blocks of bounded size by id hash, so a namespace with a third of all
    vectors spreads over as many tasks as it needs; each block pair is one matrix product that
    returns at most ``k`` rows per query, never its pairs.
    """
    filters = dict(filters or {})
    q_sizes = queries.groupBy("namespace").agg(
        F.ceil(F.count("*") / QUERIES_PER_BLOCK).cast("int").alias("q_blocks"))
    values = F.sum(F.size("values")) if embed is None else F.count("*") * dim
    v_sizes = vectors.groupBy("namespace").agg(
        F.ceil(F.greatest(F.count("*") / VECTORS_PER_BLOCK, values / VALUES_PER_BLOCK)).cast("int").alias("v_blocks"))
    grid = q_sizes.join(v_sizes, "namespace")
    grid = grid if embed is None else F.broadcast(grid)  # a row a namespace that is asked for; the texts wait where they lie

    def place(df: DataFrame, key: str, own: str, other: str, names: list[str], *more: Column, given: str = "values") -> DataFrame:
        hashed = F.pmod(F.xxhash64(key), F.col(own + "_blocks")).cast("int")
        spread = F.explode(F.sequence(F.lit(0), F.col(other + "_blocks") - 1))
        texts = [F.lower(F.col(n).cast("string")).alias(n) for n in names]
        rows, size = (df.filter(F.size("values") > 0), F.size("values")) if given == "values" else (df, F.lit(dim))
        return (rows.join(grid, "namespace")
                .select(F.col("namespace").alias("namespace"), size.alias("dim"),
                        hashed.alias(own + "_block"), spread.alias(other + "_block"),
                        F.col(key).alias(key), F.col(given).alias(given), *texts, *more))

    most = (k if isinstance(k, Column) else F.lit(k)).cast("int").alias("most")
    q = place(queries, "query_id", "q", "v", list(filters), most)
    v = place(vectors, "vector_id", "v", "q", list(filters.values()), given="values" if embed is None else "text")
    id_type = queries.schema["query_id"].dataType.simpleString()

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows and right.num_rows:
            right = right.sort_by("vector_id")
            held = _matrix(right["values"]) if embed is None else embed(right["text"].to_pylist()).astype(np.float64)
            lq, rv = _unit(_matrix(left["values"])), _unit(held)
            ok = _passing(left, right, filters) if filters else None
            wanted = left["most"].to_numpy()
        picked_q, picked_v, scores = [], [], []
        for at in range(0, left.num_rows if right.num_rows else 0, _STRIPE):
            s = np.round(np.clip(lq[at:at + _STRIPE] @ rv.T, 0.0, 1.0), 4)
            if ok is not None:
                s[~ok[at:at + _STRIPE]] = -1.0
            n = max(1, min(int(wanted[at:at + _STRIPE].max()), s.shape[1]))
            floor = -np.partition(-s, n - 1, axis=1)[:, n - 1]
            for row in range(s.shape[0]):
                near = np.flatnonzero((s[row] >= floor[row]) & (s[row] >= 0))
                best = near[np.argsort(-s[row, near], kind="stable")[:max(0, wanted[at + row])]]
                picked_q.append(np.full(len(best), at + row))
                picked_v.append(best)
                scores.append(s[row, best])
        take = lambda parts: np.concatenate(parts).astype(np.int64) if parts else np.array([], np.int64)
        return pa.table({
            "query_id": left["query_id"].take(pa.array(take(picked_q))),
            "vector_id": right["vector_id"].take(pa.array(take(picked_v))),
            "vec_score": pa.array(np.concatenate(scores) if scores else np.array([], float)),
            "most": left["most"].take(pa.array(take(picked_q)))})

    keys = ["namespace", "dim", "q_block", "v_block"]
    partial = q.groupBy(*keys).cogroup(v.groupBy(*keys)).applyInArrow(
        block, f"query_id {id_type}, vector_id string, vec_score double, most int")
    order = Window.partitionBy("query_id").orderBy(F.desc("vec_score"), F.asc("vector_id"))
    ranked = partial.withColumn("vec_rank", F.row_number().over(order))
    return ranked.filter(F.col("vec_rank") <= (F.col("most") if isinstance(k, Column) else k)).drop("most")


def write_vectors(vectors: DataFrame, path: str, buckets: int = NAMESPACE_BUCKETS) -> None:
    """Vectors in partitions by a bucket of their namespace, so a search opens those of its namespaces alone."""
    bucket = F.pmod(F.xxhash64("namespace"), F.lit(buckets)).cast("int")
    # Files of a bucket follow its rows: a large namespace is written by many tasks.
    with shuffles_dropped(vectors.sparkSession):
        vectors.withColumn("bucket", bucket).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("bucket").parquet(path)


def nearest_stored(queries: DataFrame, path: str, k: int | Column, filters: Mapping[str, str] | None = None, buckets: int = NAMESPACE_BUCKETS) -> DataFrame:
    """``nearest`` over a table of ``write_vectors``: the namespaces of the queries prune its partitions at run time."""
    bucket = F.pmod(F.xxhash64("namespace"), F.lit(buckets)).cast("int")
    asked = queries.select(bucket.alias("bucket")).where(F.col("bucket") >= 0).distinct()
    held = queries.sparkSession.read.parquet(path)
    # At most ``buckets`` numbers are broadcast.
    return nearest(queries, held.join(F.broadcast(asked), "bucket", "left_semi").drop("bucket"), k, filters)
