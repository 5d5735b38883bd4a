"""Whitening of embeddings through distributed block matrices.

Vectors become integers, ``floor(scale * component) + shift``. The fit is over each distinct vector once: centred rows,
``(n * x - S) / n`` with exact integer numerators, are indexed into a BlockMatrix; its transpose times itself is the
scatter, whose eigenvectors are found on the driver (a matrix of the vectors' length, at most ``MAX_SIZE``, whatever the
number of rows). A BlockMatrix of all rows times the whitening matrix projects them, and the whitened fit rows,
multiplied with themselves in the same way, give the error against the identity. Multiplications are split along the
rows, so no task holds more than ``SPLIT`` blocks of ``ROWS`` rows.

Defined cases: vectors that are null or hold null or non-finite components are dropped; vectors of different length
are fitted and projected by length (at most ``MAX_LENGTHS`` of them, more raise); components without variance (one
distinct row, or fewer rows than dimensions) have a null ``whitened`` and count in no ``identity_error``, which is null
where no component has variance; ``explained`` is null where nothing varies; equal eigenvalues give any orthonormal
basis of their space, the same for all rows; a null vec_id and repeated rows keep their rows; an empty vector has no
component; an empty table gives no rows; columns other than the named ones are ignored, whatever they are called. A
component beyond 64-bit integers, or a ``deviation`` beyond them, raises.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from folioground.llm.base import staged

#: Rows of a block; blocks of one split of a product; longest vector; number of lengths.
ROWS, SPLIT, MAX_SIZE, MAX_LENGTHS = 1024, 32, 4096, 64

_SCHEMA = "vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def _numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` written with a dense ``at`` from 0: partition and place are written first, bases are prefix sums of counts."""
    placed = staged(df.withColumn("_id", F.monotonically_increasing_id()), name)
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each written partition
    bases = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return placed.withColumn("_part", part).join(F.broadcast(bases), "_part").withColumn("at", F.col("_base") + place).drop("_id", "_part", "_base")


def _sums(fit: DataFrame, size: int) -> tuple[int, list[int]]:
    """Number of rows and exact sums of each dimension, added up in tasks first."""
    def run(batches):
        n, total = 0, np.zeros(size, object)
        for batch in batches:
            x = np.asarray(batch.column(0).flatten(), np.int64).reshape(-1, size)
            for low in range(0, len(x), 1024):
                part = x[low: low + 1024]
                safe = np.abs(part.astype(np.float64)).max(initial=0) < 2.0 ** 52
                total += part.sum(axis=0).astype(object) if safe else part.astype(object).sum(axis=0)
            n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, size), pa.int32()), pa.array([str(v) for v in [n, *total]], pa.string())], ["d", "s"])

    rows = fit.select("x").mapInArrow(run, "d int, s string").groupBy("d").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    by = {r["d"]: int(r["s"]) for r in rows}
    return by.get(-1, 0), [by.get(d, 0) for d in range(size)]


def _centred(rows: DataFrame, n: int, sums: list[int]) -> DataFrame:
    """(at, centred): ``(n * x - S) / n``, the numerator an exact integer."""
    size = len(sums)
    whole = np.array(sums, object)
    safe = all(abs(s) < 1 << 62 for s in sums)

    def run(batches):
        for batch in batches:
            x = np.asarray(batch.column(1).flatten(), np.int64).reshape(-1, size)
            if safe and n * int(np.abs(x.astype(np.float64)).max(initial=0) + 1) < 1 << 62:
                c = (n * x - whole.astype(np.int64)) / n
            else:
                c = ((n * x.astype(object) - whole) / n).astype(np.float64)
            offsets = pa.array(np.arange(len(c) + 1, dtype=np.int32) * size)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(c.ravel()))], ["at", "centred"])

    return rows.select("at", "x").mapInArrow(run, "at bigint, centred array<double>")


def _blocks(centred: DataFrame, count: int, size: int) -> BlockMatrix:
    vectors = MLUtils.convertVectorColumnsFromML(centred.select(F.col("at").alias("index"), array_to_vector("centred").alias("vector")), "vector")
    return IndexedRowMatrix(vectors, count, size).toBlockMatrix(ROWS, size)


def _times(left: BlockMatrix, right: BlockMatrix, splits: int = 1) -> BlockMatrix:
    """A product whose inner dimension is dealt to ``splits`` groups of tasks, each adding up what it has."""
    java = left._java_matrix_wrapper._java_model.multiply(right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(java, left.rowsPerBlock, right.colsPerBlock)


def _gram(matrix: BlockMatrix, count: int) -> np.ndarray:
    """Transpose times itself, of the vectors' length squared."""
    splits = max(1, -(-count // (ROWS * SPLIT)))
    return _times(matrix.transpose(), matrix, splits).toLocalMatrix().toArray()


def _local(spark: SparkSession, matrix: np.ndarray) -> BlockMatrix:
    rows, columns = matrix.shape
    block = ((0, 0), DenseMatrix(rows, columns, matrix.ravel(order="F").tolist()))
    return BlockMatrix(spark.sparkContext.parallelize([block], 1), rows, columns)


def _one_length(rows: DataFrame, size: int, components: int) -> DataFrame:
    spark = rows.sparkSession
    fit = _numbered(rows.select("x").distinct(), "whitening_fit")
    n, sums = _sums(fit, size)
    centred = _blocks(_centred(fit, n, sums), n, size)
    covariance = _gram(centred, n) / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")
    values, vectors, trace = values[order], vectors[:, order], float(np.trace(covariance))
    kept = min(components, size)
    alive = [i for i in range(kept) if values[i] > max(1e-12 * values[0], 0)]
    scale = np.array([1 / np.sqrt(values[i]) if i in alive else 0.0 for i in range(kept)])
    whitening = _local(spark, vectors[:, :kept] * scale)
    seen = _gram(_times(centred, whitening), n) / n
    error = max((abs(seen[i, j] - (i == j)) for i in alive for j in alive), default=None)

    count = rows.count()
    projected = callMLlibFunc("getIndexedRows", _times(_blocks(_centred(rows, n, sums), count, size), whitening).toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    projected = MLUtils.convertVectorColumnsToML(projected, "vector").select(F.col("index").alias("at"), vector_to_array("vector").alias("whitened"))
    total = F.array(*(F.lit(s).cast("decimal(38,0)") for s in sums))
    gaps = F.zip_with("x", total, lambda x, s: F.lit(n).cast("decimal(19,0)") * x.cast("decimal(19,0)") - s)
    longs = F.transform(gaps, lambda g: g.cast("bigint"))
    deviation = F.aggregate(longs, F.lit(0).cast("bigint"), lambda a, g: a + g * g)
    # One small struct a component: what is the same for all rows stays literal.
    shares = F.array(*(F.lit(float(values[i]) / trace if trace > 0 else None).cast("double") for i in range(kept)))
    living = F.array(*(F.lit(i in alive) for i in range(kept)))
    wide = rows.select("at", "vec_id", deviation.alias("deviation")).join(projected, "at")
    tall = wide.select("vec_id", "deviation", F.posexplode("whitened").alias("i", "w"))
    return tall.select("vec_id", (F.col("i") + 1).alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation", F.when(F.get(living, F.col("i")), F.col("w")).alias("whitened"),
                       F.get(shares, F.col("i")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 16, scale: float = 64, shift: int = 1_000_000) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): every vector on the first ``components``
    principal directions, each of unit variance over the distinct vectors. See the module's text for the defined cases."""
    given = F.col(vector).cast("array<double>")
    fine = F.forall(given, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    x = F.transform(given, lambda c: F.floor(c * F.lit(float(scale))).cast("bigint") + F.lit(shift))
    rows = staged(vectors.select(F.col(key).alias("vec_id"), F.when(fine, x).alias("x")).where("x IS NOT NULL"), "whitening_rows")
    sizes = [r[0] for r in rows.select(F.size("x")).distinct().limit(MAX_LENGTHS + 1).collect()]
    if len(sizes) > MAX_LENGTHS or any(s > MAX_SIZE for s in sizes):
        raise ValueError(f"more than {MAX_LENGTHS} vector lengths, or one above {MAX_SIZE}")
    out = vectors.sparkSession.createDataFrame([], _SCHEMA.format(kind=dict(rows.dtypes)["vec_id"]))
    for size in sorted(s for s in sizes if s):
        own = _numbered(rows.where(F.size("x") == size), "whitening_numbered")
        out = out.unionByName(_one_length(own, size, components))
    return out
