"""Token ids as flat binary files with 64-bit document offsets, memory-mapped when read.

``part-NNNNN.bin`` holds the ids of one range of documents end to end as little-endian unsigned integers, of 16
bits when the vocabulary allows it and of 32 otherwise. ``part-NNNNN.idx`` holds 64-bit offsets in ids, one more than
documents, counted over the whole output: a partition's base is the prefix sum of the counts of those before it.
``manifest`` (Parquet) names the parts in order with their bases, ``keys`` (Parquet) the keys in order.

Documents are dealt to parts by ranges of (key, input partition), so a key that a third of the rows have is split,
and sorted within parts by (key, input partition, text). A part is written under a name of the attempt and renamed,
so a task that runs again, or twice, leaves the same files.

Defined cases: a null text is empty and yields the end id alone; null keys come first; equal rows stand side by
side, one entry each; an empty table writes a manifest without parts and reads back without rows; columns other than the named ones
are ignored, whatever they are called.
"""

from __future__ import annotations

import posixpath
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from folioground.llm.base import shuffles_dropped, staged
from folioground.llm.tokens import encoder, with_end
from folioground.staging import stage_path


def _at(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _put(path: str, pieces: Iterator[bytes]) -> None:
    """Write a file under another name and rename it when it is whole."""
    fs, name = _at(path)
    fs.create_dir(posixpath.dirname(name), recursive=True)
    own = f"{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as out:
        for piece in pieces:
            out.write(piece)
    fs.move(own, name)


def mapped(path: str, dtype: str) -> np.ndarray:
    """A file as an array: memory-mapped where it is local or mounted, read otherwise."""
    fs, name = _at(path)
    if isinstance(fs, pafs.LocalFileSystem):
        with pa.memory_map(name) as f:
            return np.frombuffer(f.read_buffer(), dtype)
    with fs.open_input_file(name) as f:
        return np.frombuffer(f.read(), dtype)


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end: int, key: str = "doc_id", text: str = "text") -> None:
    """Write the ids of all whole texts, ``end`` after each, in ascending order of ``key``."""
    spark, kind = docs.sparkSession, dict(docs.dtypes)[key]

    def run(batches):
        tool = encoder(vocabulary)
        dtype = np.dtype("<u2") if max(tool.tokenizer.get_vocab_size(), end + 1) <= 1 << 16 else np.dtype("<u4")
        part, keys, counts = TaskContext.get().partitionId(), [], []

        def pieces():
            for batch in batches:
                for low in range(0, len(batch), 1000):
                    rows = batch.slice(low, 1000)
                    ids, offsets = with_end(*tool.encode(rows.column(1)), end)
                    keys.append(rows.column(0))
                    counts.append(np.diff(offsets))
                    yield ids.astype(dtype).tobytes()

        _put(f"{path}/part-{part:05d}.bin", pieces())
        offset = 0
        for k, n in zip(keys, counts):
            starts = offset + np.cumsum(n) - n
            offset += int(n.sum())
            yield pa.RecordBatch.from_arrays([k, pa.array(np.full(len(k), part, np.int32)), pa.array(starts), pa.array(n), pa.array([dtype.str] * len(k))], ["key", "part", "start", "n", "dtype"])

    dealt = docs.select(F.col(key), F.col(text), F.spark_partition_id().alias("_from"))
    ordered = dealt.repartitionByRange(F.col(key).asc_nulls_first(), F.col("_from")).sortWithinPartitions(F.col(key).asc_nulls_first(), "_from", text)
    entries = staged(ordered.mapInArrow(run, f"key {kind}, part int, start bigint, n bigint, dtype string"), "entries")
    sums = entries.groupBy("part").agg(F.sum("n").alias("ids"), F.count("*").alias("documents"), F.first("dtype").alias("dtype"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row for each part
    with shuffles_dropped(spark):
        sums.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0))).coalesce(1).write.parquet(f"{path}/manifest")
    bases = spark.read.parquet(f"{path}/manifest").select("part", "base")

    def index(batches):
        for batch in batches:
            for part, base, starts, last in zip(*(c.to_pylist() for c in batch.columns)):
                _put(f"{path}/part-{part:05d}.idx", iter([(np.array([*starts, last], np.int64) + base).astype("<i8").tobytes()]))
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32())], ["part"])

    # A part's offsets are bounded by the size of the part.
    offsets = entries.groupBy("part").agg(F.array_sort(F.collect_list("start")).alias("starts"), F.max(F.col("start") + F.col("n")).alias("last"))
    with shuffles_dropped(spark):
        offsets.join(bases, "part").select("part", "base", "starts", "last").mapInArrow(index, "part int").write.format("noop").mode("overwrite").save()
        entries.select("key", "part", "start").write.parquet(f"{path}/keys")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document, from the files: one task maps one part at a time."""
    manifest, keys = spark.read.parquet(f"{path}/manifest"), spark.read.parquet(f"{path}/keys")
    kind = dict(keys.dtypes)["key"]

    def run(batches):
        for batch in batches:
            for part, dtype, base, names in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3)):
                offsets, ids = mapped(f"{path}/part-{part:05d}.idx", "<i8"), mapped(f"{path}/part-{part:05d}.bin", dtype)
                cuts = offsets - base
                crcs = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(cuts[:-1], cuts[1:])]
                yield pa.RecordBatch.from_arrays([names.values, pa.array(offsets[:-1]), pa.array(np.diff(offsets)), pa.array(crcs, pa.int64())], ["key", "start", "n_tokens", "ids_crc32"])

    # Keys of a part in order; nulls stay, as they are wrapped.
    order = F.transform(F.array_sort(F.collect_list(F.struct("start", "key"))), lambda x: x["key"]).alias("keys")
    parts = manifest.select("part", "dtype", "base").join(keys.groupBy("part").agg(order), "part").repartition("part")
    return parts.select("part", "dtype", "base", "keys").mapInArrow(run, f"key {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_output(docs: DataFrame, vocabulary: str, end: int, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the files, by default below the shared checkpoint folder, and read them back."""
    path = path or stage_path(docs.sparkSession, "tokens")
    write_token_files(docs, path, vocabulary, end, key, text)
    return read_token_files(docs.sparkSession, path).withColumnRenamed("key", key)
