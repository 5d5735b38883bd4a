"""Exact top-k inner products by pivot-table elimination.

Vectors become integers, ``floor(scale * component)``. A table holds, for every vector, its distances to a few pivots.
For a query q and a vector x, ``d = max over pivots of |d(q, p) - d(x, p)|`` is a lower bound of their distance, and
``(|q|^2 + |x|^2 - d^2) / 2`` an upper bound of their inner product. The zero vector is one of the pivots, so the bound
is never above ``|q| * |x|``. Candidates are evaluated in the order of their bounds until no bound left reaches the
k-th best score. Distances are kept in single precision; bounds are widened by more than that can err, and scores are
integer sums, so results are exact.

Vectors lie in cells by their nearest pivot, cells in blocks of about ``BLOCK`` rows by a hash of the row. A query is
first searched in its own block, which gives a score that its k best reach; blocks whose ranges of distances cannot
reach that score are eliminated before any vector moves; what is left is searched in pairs of a block and a chunk of
queries. Only the k best of a query and block leave a task. Pivots are fitted on ``SAMPLE`` rows at most (the least by
hash), everything else covers every row.

Defined cases: vectors that are null or hold null or non-finite components take no part, as query or candidate;
vectors of different length are compared with their like only; a null key is a candidate (last among equal scores)
but no query; repeated rows are candidates each, and a repeated query row is answered each time; equal scores go by
key; an empty vector scores 0 with its like; an empty table gives no rows; columns other than the named ones are
ignored, whatever they are called. A vector whose squared length exceeds 2^62 raises, as its scores are no 64-bit sums.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from folioground.llm.base import staged

#: Pivots of a vector length; rows they are chosen from; rows of a block; blocks whose queries share a chunk; block
#: ranges of one page.
PIVOTS, SAMPLE, BLOCK, CHUNK_BLOCKS, PAGE = 16, 2000, 16384, 16, 8192

_EXACT = float(1 << 53)
_ERR = 2.0 ** -23


def _integers(vectors: DataFrame, key: str, vector: str, asks: Column, scale: float) -> DataFrame:
    """(row, key, ask, size, x): little-endian 64-bit integers of every vector that takes part."""
    kind = dict(vectors.dtypes)[key]

    def run(batches):
        for batch in batches:
            keep, sizes, kept = [], [], []
            for i, x in enumerate(batch.column(3)):
                values = x.values
                if values is None or values.null_count:
                    continue
                v = np.floor(np.asarray(values, np.float64) * scale)
                if not np.isfinite(np.asarray(values, np.float64)).all():
                    continue
                if not (v * v).sum() < 2.0 ** 62:
                    raise ArithmeticError("a vector is too long for 64-bit scores")
                keep.append(i)
                sizes.append(len(v))
                kept.append(v.astype("<i8").tobytes())
            own = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), own.column(2), pa.array(sizes, pa.int32()), pa.array(kept, pa.binary())], ["row", "key", "ask", "size", "x"])

    named = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.coalesce(asks, F.lit(False)).alias("ask"), F.col(vector).cast("array<double>").alias("x"))
    return named.mapInArrow(run, f"row bigint, key {kind}, ask boolean, size int, x binary")


def _matrix(raw, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw), "<i8").reshape(len(raw), size)


def choose_pivots(rows: np.ndarray, count: int) -> np.ndarray:
    """The zero vector, then the row farthest from all chosen before, as long as there is one that is not chosen."""
    x = rows.astype(np.float64)
    chosen, far = [np.zeros(x.shape[1])], (x * x).sum(axis=1)
    while len(chosen) < count and len(x) and far.max() > 0:
        chosen.append(x[int(far.argmax())])
        far = np.minimum(far, ((x - chosen[-1]) ** 2).sum(axis=1))
    return np.array(chosen)


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Single-precision distances of rows to pivots; zero where they would not be accurate (and no bound is drawn)."""
    x = x.astype(np.float64)
    squares, held = (x * x).sum(axis=1), (pivots * pivots).sum(axis=1)
    d = np.sqrt(np.maximum(squares[:, None] + held[None, :] - 2 * (x @ pivots.T), 0)).astype(np.float32)
    d[4 * squares >= _EXACT] = 0
    return d


def _with_distances(vectors: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Rows with distances to the pivots of their length and the nearest pivot as ``cell``."""
    kind = dict(vectors.dtypes)["key"]

    def run(batches):
        for batch in batches:
            sizes = np.asarray(batch.column(3))
            raw = batch.column(4).to_pylist()
            far, cell = [b""] * len(raw), np.zeros(len(raw), np.int32)
            for size in np.unique(sizes):
                own = np.flatnonzero(sizes == size)
                d = distances(_matrix([raw[i] for i in own], int(size)), pivots.get(int(size), np.zeros((1, int(size)))))
                cell[own] = d.argmin(axis=1)
                for i, row in zip(own, d):
                    far[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(far, pa.binary()), pa.array(cell)], ["row", "key", "ask", "size", "x", "far", "cell"])

    return vectors.mapInArrow(run, f"row bigint, key {kind}, ask boolean, size int, x binary, far binary, cell int")


class Block:
    """Rows of a block as they are searched."""

    def __init__(self, keys: list, rows: np.ndarray, x: np.ndarray, far: np.ndarray):
        self.keys, self.rows, self.far = keys, rows, far
        self.norm = (x.astype(np.float64) ** 2).sum(axis=1)
        self.small = bool(4 * self.norm.max(initial=0) < _EXACT)
        self.x = x.astype(np.float64) if self.small else x
        self.furthest = float(far.max(initial=0))

    def best(self, q: np.ndarray, far: np.ndarray, floor: int | None, k: int, own: int = -1) -> list[int]:
        """Places of the k best rows for a query, of those that reach ``floor``; ``own`` is left out."""
        norm = float((q.astype(np.float64) ** 2).sum())
        exact = self.small and 4 * norm < _EXACT
        q = q.astype(np.float64) if exact else q
        x = self.x if exact or not self.small else self.x.astype(np.int64)
        if exact:
            low = np.abs(self.far - far).max(axis=1).astype(np.float64) - (self.furthest + float(far.max())) * _ERR - 1e-6
            bound = (norm + self.norm - np.maximum(low, 0) ** 2) / 2 + 2
        else:
            bound = np.full(len(x), np.inf)
        if own >= 0:
            bound[own] = -np.inf
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > -np.inf]
        places, scores, at, run = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 64
        while at < len(order):
            take = order[at: at + run]
            if floor is not None:
                take = take[: int(np.searchsorted(-bound[take], -float(floor), "right"))]
                if not len(take):
                    break
            s = (x @ q)[take] if 4 * len(take) > len(x) else x[take] @ q
            at, run = at + run, run * 8
            places, scores = np.concatenate([places, take]), np.concatenate([scores, s.astype(np.int64)])
            if len(scores) >= k:
                kth = int(-np.partition(-scores, k - 1)[k - 1])
                floor = kth if floor is None else max(floor, kth)
            if floor is not None:
                held = scores >= floor
                places, scores = places[held], scores[held]
        by = sorted(range(len(places)), key=lambda i: (-scores[i], self.keys[places[i]] is None, self.keys[places[i]] or 0, self.rows[places[i]]))
        self.scores = [int(scores[i]) for i in by[:k]]
        return [int(places[i]) for i in by[:k]]


def _packed(rows: DataFrame, k: int) -> DataFrame:
    """A row for each block: its vectors, the ranges of their distances, and what its own queries find in it."""
    kind = dict(rows.dtypes)["key"]
    found = f"array<struct<key:{kind}, row:bigint, score:bigint>>"
    schema = f"block string, chunk string, size int, keys array<{kind}>, rows array<bigint>, x binary, far binary, low binary, high binary, longest double, small boolean, asks array<struct<place:int, floor:bigint, found:{found}>>"

    def run(table: pa.Table) -> pa.Table:
        size, cell, part = (table.column(c)[0].as_py() for c in ("size", "cell", "part"))
        table = table.sort_by("row")
        keys, ids = table.column("key").to_pylist(), table.column("row").to_numpy()
        x = _matrix(table.column("x").to_pylist(), size)
        raw = b"".join(table.column("far").to_pylist())
        far = np.frombuffer(raw, np.float32).reshape(len(ids), -1)
        block, asks = Block(keys, ids, x, far), []
        for place in np.flatnonzero(table.column("ask").to_numpy()):
            best = block.best(x[place], far[place], None, k, own=int(place))
            asks.append({"place": int(place), "floor": block.scores[-1] if len(best) == k else None, "found": [{"key": keys[p], "row": int(ids[p]), "score": s} for p, s in zip(best, block.scores)]})
        values = [f"{size}:{cell}:{part}", f"{size}:{cell}:{part // CHUNK_BLOCKS}", size, keys, ids.tolist(), x.tobytes(), raw, far.min(axis=0).tobytes(), far.max(axis=0).tobytes(), float(np.sqrt(block.norm.max())), block.small, asks]
        return pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip(values, arrow)], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string
    arrow = to_arrow_schema(_parse_datatype_string(schema))
    return rows.groupBy("size", "cell", "part").applyInArrow(run, schema)


def _queries(blocks: DataFrame) -> DataFrame:
    """A row for each query: its vector, distances, the score it has reached and the block it was searched in."""
    kind = dict(blocks.dtypes)["keys"][6:-1]

    def run(batches):
        for batch in batches:
            for b in batch.to_pylist():
                x = np.frombuffer(b["x"], "<i8").reshape(len(b["keys"]), b["size"])
                far = np.frombuffer(b["far"], np.float32).reshape(len(b["keys"]), -1)
                at = [a["place"] for a in b["asks"]]
                yield pa.RecordBatch.from_arrays([
                    pa.array([b["rows"][i] for i in at], pa.int64()), pa.array([b["block"]] * len(at), pa.string()), pa.array([b["chunk"]] * len(at), pa.string()), pa.array([b["size"]] * len(at), pa.int32()),
                    pa.array([x[i].tobytes() for i in at], pa.binary()), pa.array([far[i].tobytes() for i in at], pa.binary()), pa.array([a["floor"] for a in b["asks"]], pa.int64())], ["query", "home", "chunk", "size", "x", "far", "floor"])

    some = blocks.where(F.size("asks") > 0).select("block", "chunk", "size", "keys", "rows", "x", "far", F.transform("asks", lambda a: F.struct(a["place"].alias("place"), a["floor"].alias("floor"))).alias("asks"))
    return some.mapInArrow(run, "query bigint, home string, chunk string, size int, x binary, far binary, floor bigint")


def _reaching(queries: DataFrame, blocks: DataFrame, pages: int) -> DataFrame:
    """Queries with each block, other than their own, whose ranges of distances may reach the score they have."""
    schema = "block string, query bigint, chunk string, size int, x binary, far binary, floor bigint"

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(left) and len(right):
            size = left.column("size")[0].as_py()
            names = np.array(left.column("block").to_pylist())
            low, high = (np.frombuffer(b"".join(left.column(c).to_pylist()), np.float32).reshape(len(names), -1) for c in ("low", "high"))
            longest, small = left.column("longest").to_numpy(), left.column("small").to_numpy()
            for q in right.to_pylist():
                x, far = _matrix([q["x"]], size)[0].astype(np.float64), np.frombuffer(q["far"], np.float32)
                norm = float((x * x).sum())
                d = np.maximum(low - far, far - high).max(axis=1).astype(np.float64)
                d = np.maximum(d - (float(high.max()) + float(far.max())) * _ERR - 1e-6, 0)
                bound = np.minimum((norm + longest ** 2 - d * d) / 2, np.sqrt(norm) * longest) * (1 + 1e-12) + 2
                may = names != q["home"]
                if q["floor"] is not None and 4 * norm < _EXACT:
                    may &= ~small | (bound >= q["floor"])
                out += [(b, q["query"], q["of"], size, q["x"], q["far"], q["floor"]) for b in names[may]]
        return pa.Table.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(arrow)], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string
    arrow = to_arrow_schema(_parse_datatype_string(schema))
    ranges = blocks.select("block", "size", "low", "high", "longest", "small", F.pmod(F.xxhash64("block"), F.lit(pages)).alias("page"))
    groups = queries.select("size", "chunk").distinct()
    left = ranges.join(groups, "size")  # each page of ranges meets each chunk of queries
    right = queries.withColumn("page", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(pages - 1).cast("long"))))
    right = right.select("query", "home", F.col("chunk").alias("of"), F.col("size").alias("long"), "x", "far", "floor", F.col("page").alias("on"))
    return left.groupBy("size", "page", "chunk").cogroup(right.groupBy("long", "on", "of")).applyInArrow(run, schema)


def _searched(reaching: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """(query, key, row, score): the k best of each block for the queries that may reach it."""
    kind = dict(blocks.dtypes)["keys"][6:-1]
    schema = f"query bigint, key {kind}, row bigint, score bigint"

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for b in left.to_pylist():
            n = len(b["keys"])
            block = Block(b["keys"], np.array(b["rows"]), np.frombuffer(b["x"], "<i8").reshape(n, b["size"]), np.frombuffer(b["far"], np.float32).reshape(n, -1))
            for q in right.to_pylist():
                best = block.best(_matrix([q["x"]], b["size"])[0], np.frombuffer(q["far"], np.float32), q["floor"], k)
                out += [(q["query"], b["keys"][p], b["rows"][p], s) for p, s in zip(best, block.scores)]
        return pa.Table.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(arrow)], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string
    arrow = to_arrow_schema(_parse_datatype_string(schema))
    left = blocks.select("block", "size", "keys", "rows", "x", "far").join(reaching.select("block", "chunk").distinct(), "block")
    right = reaching.select(F.col("block").alias("in"), F.col("chunk").alias("of"), "query", "x", "far", "floor")
    return left.groupBy("block", "chunk").cogroup(right.groupBy("in", "of")).applyInArrow(run, schema)


def top_k(vectors: DataFrame, asks: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: float = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest integer inner products of each row that ``asks`` names, among all
    other rows; equal scores by ascending key. See the module's text for the defined cases."""
    whole = staged(_integers(vectors, key, vector, asks, scale), "integer_vectors")
    sample = whole.select("size", "x").orderBy(F.xxhash64("x"), "row").limit(SAMPLE).collect()
    pivots: dict[int, np.ndarray] = {}
    for size in {r["size"] for r in sample}:
        pivots[size] = choose_pivots(_matrix([bytes(r["x"]) for r in sample if r["size"] == size], size), PIVOTS)
    table = staged(_with_distances(whole, pivots), "pivot_table")
    # Cells by length: at most PIVOTS for each length of the sample, one for any other.
    counts = table.groupBy("size", "cell").agg(F.count("*").alias("held"))
    dealt = table.join(counts, ["size", "cell"]).withColumn("part", F.pmod(F.xxhash64("row"), F.ceil(F.col("held") / BLOCK))).drop("held")
    blocks = staged(_packed(dealt, k), "pivot_blocks")
    queries = staged(_queries(blocks), "pivot_queries")
    pages = max(1, -(-blocks.count() // PAGE))
    reaching = staged(_reaching(queries, blocks, pages), "pivot_pairs")
    home = blocks.select("rows", F.explode("asks").alias("ask")).select(F.expr("rows[ask.place]").alias("query"), F.explode("ask.found").alias("f")).select("query", "f.key", "f.row", "f.score")
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("key"), "row")
    ranked = home.unionByName(_searched(reaching, blocks, k)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    asked = whole.where("ask").select(F.col("row").alias("query"), F.col("key").alias("query_id"))
    return ranked.join(asked, "query").select("query_id", "rank", F.col("key").alias("vec_id"), "score")
