"""Helpers of the training-data operators: written tables, words of whole texts, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from folioground.staging import stage_path, with_settings

#: While a table is written: shuffle files go when the job has ended, and Python gets few rows at a time.
_SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


def shuffles_dropped(spark: SparkSession):
    """Within, the shuffle files of a job go when it has ended, and batches to Python are small."""
    return with_settings(spark, _SETTINGS)


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back; its shuffle files are dropped at once."""
    with shuffles_dropped(df.sparkSession):
        path = stage_path(df.sparkSession, name)
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def unused(columns: list[str], *names: str) -> list[str]:
    """``names``, each with as many underscores before it as it takes to be none of ``columns`` (case does not count)."""
    taken, found = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


def drop_staged(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.staged_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


# -- words ------------------------------------------------------------------------------------------------------

#: Bytes of text that one pass of numpy works on; a longer text is worked on alone and whole.
CHUNK = 1 << 20
_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_R_INV = np.uint64(pow(int(_R), -1, 1 << 64))
_VALUES = np.random.Generator(np.random.PCG64(20240501)).integers(1, 1 << 63, 256, dtype=np.uint64)  # a fixed rule, not data
_VALUES[65:91] = _VALUES[97:123]  # A-Z count as a-z
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}

#: Bytes of a word: all but white space; and digits, letters and bytes of other alphabets.
NOT_BLANK = np.array([b != 0x20 and not 0x09 <= b <= 0x0D for b in range(256)])
ALNUM = np.array([0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)])


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        for name, r in (("up", _R), ("down", _R_INV)):
            steps = np.full(max(n, CHUNK + 1), r, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, end to end, and the place of each row in them; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1]
    bytes_ = np.frombuffer(data, np.uint8)[at[0]: at[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return bytes_, at - at[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts together have about ``limit`` bytes."""
    low = 0
    while low < len(offsets) - 1:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield low, high
        low = high


class Words:
    """Words of some whole texts: starts and ends in bytes, a 64-bit hash of each (A-Z folded), and ``first``, the
    number of words before each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray):
        self.data = data
        mask = is_word[data]
        start, end = mask.copy(), mask.copy()
        start[1:] &= ~mask[:-1]
        end[:-1] &= ~mask[1:]
        edges = offsets[(offsets > 0) & (offsets < len(data))]
        start[edges] = mask[edges]
        end[edges - 1] = mask[edges - 1]
        self.start, self.end = np.flatnonzero(start), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.start, offsets)
        up, down = _powers(len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.multiply(_VALUES[data], up, out=sums[1:])
        np.cumsum(sums[1:], out=sums[1:])
        self.hash = mixed((sums[self.end] - sums[self.start]) * down[self.start] if len(self.start) else np.zeros(0, np.uint64))


_ORDER = mixed(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each ``k`` consecutive word hashes; windows that cross texts are the caller's to leave out."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n] * _ORDER[0]
    for i in range(1, k):
        out = out + words[i: i + n] * _ORDER[i]
    return mixed(out + np.uint64(k))


# -- components -------------------------------------------------------------------------------------------------

#: About how many links one task joins; more links go to more tasks.
LINKS = 1 << 18


def _forest(u: pa.Array, v: pa.Array) -> tuple[pa.Array, pa.Array]:
    """One link for each node, to the smallest node that these links reach; none for those smallest nodes."""
    nodes = pc.unique(pa.concat_arrays([u, v]))
    nodes = nodes.take(pc.sort_indices(nodes))
    a, b = (pc.index_in(x, nodes).to_numpy(zero_copy_only=False) for x in (u, v))
    root = np.arange(len(nodes))
    while (apart := root[a] != root[b]).any():
        a, b = root[a[apart]], root[b[apart]]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while ((up := root[root]) != root).any():
            root = up
    below = root != np.arange(len(nodes))
    return nodes.filter(pa.array(below)), nodes.take(pa.array(root[below]))


def _joined_links(batches):
    held, size = [], 0
    for batch in batches:
        held.append(batch.select(["u", "v"]))
        size += len(batch)
        if size >= LINKS:
            held = [_joined(held)]
            size = len(held[0])
            if size > LINKS // 2:  # these links share few nodes, more of them would only take memory
                yield held.pop()
                size = 0
    if size:
        yield _joined(held)


def _joined(links: list[pa.RecordBatch]) -> pa.RecordBatch:
    u, v = (pa.concat_arrays([b.column(i) for b in links]) for i in (0, 1))
    return pa.RecordBatch.from_arrays(list(_forest(u, v)), ["u", "v"])


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component) of every node of the links (u, v), of any type that has an order: the smallest node that links reach.

    Tasks first join about ``LINKS`` links each on their own, which leaves one for a node and task. Where they are several, large
    and small star steps follow in turn, each a minimum by node and a join, until every node has one link, to a node that has none itself. Nodes with many links are pre-aggregated by the minimum and split by skew handling in the join.
    """
    every = staged(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "links")
    tasks = 1 + every.count() // LINKS
    now = staged(every.coalesce(tasks).mapInArrow(_joined_links, every.schema), "joined_links")
    drop_staged(every)
    if tasks == 1:
        return _components_of(now)
    done, now = [now], now.distinct()
    for _ in range(rounds):
        now = staged(now, "links")
        drop_staged(*done)
        ends = now.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(now.select("v", F.lit(0), F.lit(1)))
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").isEmpty():
            break
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = staged(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large_star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        done = [now, large]
        now = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
    else:
        raise RuntimeError("the links did not settle")
    return _components_of(now)


def _components_of(now: DataFrame) -> DataFrame:
    """Nodes with one link each, to a node that has none, and those nodes."""
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
