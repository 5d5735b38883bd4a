"""Sharding by jump consistent hashing, with built-in expressions only.

A key's shard follows from the key and the shard count alone; there is no ring table. Going from n to
n + 1 shards moves a key either nowhere or into shard n.

Defined cases: a null key counts as key 0; rows with equal keys (a hot key, repeated rows) share a shard, and
their slots are dealt by input partition, so no task numbers more rows than one input partition holds; a null
text has size 8 and the checksum of no bytes; an empty table gives no rows; columns of the input other than the
named ones are ignored, whatever they are called.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from folioground.llm.base import unused
from folioground.staging import stage_table

#: Multiplier of the generator in the published algorithm.
MULTIPLIER = 2862933555777941757
_LOW, _HIGH = 22, 20
_MASK, _TOP = (1 << _LOW) - 1, (1 << _HIGH) - 1
_M0, _M1, _M2 = MULTIPLIER & _MASK, (MULTIPLIER >> _LOW) & _MASK, MULTIPLIER >> 2 * _LOW


def key_bits(column: str, kind: str) -> Column:
    """64 stable bits of a key: integers stand for themselves, other types are hashed."""
    if kind in ("bigint", "int", "smallint", "tinyint"):
        return F.coalesce(F.col(column).cast("bigint"), F.lit(0).cast("bigint"))
    return F.coalesce(F.when(F.col(column).isNotNull(), F.xxhash64(column)), F.lit(0).cast("bigint"))


def _jump(state: Column, n: int) -> Column:
    """One jump. The 64-bit product modulo 2^64 is made from limbs of 22, 22 and 20 bits, so that nothing overflows."""
    def moved(s: Column) -> Column:
        return F.struct(s["j"].alias("was"), (s["k0"] * _M0 + 1).alias("p0"), s["k0"].alias("k0"), s["k1"].alias("k1"), s["k2"].alias("k2"), s["shard"].alias("shard"), s["hit"].alias("hit"))

    def carried(s: Column) -> Column:
        return F.struct(s["was"].alias("was"), s["p0"].alias("p0"), s["shard"].alias("shard"), s["hit"].alias("hit"),
                        (s["k0"] * _M1 + s["k1"] * _M0 + F.shiftright(s["p0"], _LOW)).alias("p1"),
                        (s["k0"] * _M2 + s["k1"] * _M1 + s["k2"] * _M0).alias("p2"))

    def landed(s: Column) -> Column:
        k0, k1 = s["p0"].bitwiseAND(_MASK), s["p1"].bitwiseAND(_MASK)
        k2 = (s["p2"] + F.shiftright(s["p1"], _LOW)).bitwiseAND(_TOP)
        top = F.shiftleft(k2, 11) + F.shiftright(k1, 11)
        j = F.floor((s["was"] + 1) * (F.lit(float(1 << 31)) / (top + 1))).cast("bigint")
        return F.struct(j.alias("j"), k0.alias("k0"), k1.alias("k1"), k2.alias("k2"), F.when(s["was"] < n, s["was"]).otherwise(s["shard"]).alias("shard"), (s["hit"] | (s["was"] == n)).alias("hit"))

    def let(value: Column, fn) -> Column:
        return F.transform(F.array(value), fn)[0]

    return let(let(moved(state), carried), landed)


def _jumps(key: Column, shards: int) -> Column:
    """Struct (j, ..., shard, hit): all jumps up to ``shards``; ``shard`` is the last place below ``shards``, ``hit`` is set
    when place ``shards`` was visited too.

    A key makes about ln(shards) jumps. The first steps are done for every row; the rows that still jump then
    go through a loop as long as the shard count, which bounds the number of jumps.
    """
    zero = F.lit(0).cast("bigint")
    start = F.struct(zero.alias("j"), key.bitwiseAND(_MASK).alias("k0"), F.shiftrightunsigned(key, _LOW).bitwiseAND(_MASK).alias("k1"),
                     F.shiftrightunsigned(key, 2 * _LOW).alias("k2"), zero.alias("shard"), F.lit(False).alias("hit"))

    def step(s: Column, _: Column) -> Column:
        return F.when(s["j"] <= shards, _jump(s, shards)).otherwise(s)

    usual = min(shards + 1, 4 + 2 * math.ceil(math.log(shards + 1)))
    some = F.aggregate(F.sequence(F.lit(1), F.lit(usual)), start, step)
    return F.transform(F.array(some), lambda s: F.when(s["j"] > shards, s).otherwise(
        F.aggregate(F.sequence(F.lit(1), F.lit(shards + 1)), s, step)))[0]


def jump_shards(df: DataFrame, key: str, shards: int) -> DataFrame:
    """``df`` with ``shard`` for ``shards`` shards and ``grown_shard`` for one more.

    The sequence of jumps is the same for every shard count: a key's shard is the last place below the count.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    kept = [c for c in df.columns if c not in ("shard", "grown_shard", "_jumps")]
    walked = df.select(*kept, _jumps(key_bits(key, dict(df.dtypes)[key]), shards).alias("_jumps"))
    return walked.select(*kept, F.col("_jumps.shard").cast("int").alias("shard"),
                         F.when(F.col("_jumps.hit"), F.lit(shards)).otherwise(F.col("_jumps.shard")).cast("int").alias("grown_shard"))


def numbered(df: DataFrame, group: str, slot: str) -> DataFrame:
    """``df`` with a gapless number from 0 within each ``group``, in input order.

    Rows are counted by group and input partition; the prefix sums of these counts are the bases, and the window
    only spans the rows of a group in one input partition. The table is written first: places must not change
    when a lost task runs again.
    """
    kept = df.columns
    placed = stage_table(df.withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id()}), "placed")
    counts = placed.groupBy(group, "_part").agg(F.count("*").alias("_n"))
    before = W.partitionBy(group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    bases = counts.select(group, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    order = F.row_number().over(W.partitionBy(group, "_part").orderBy("_place"))
    return placed.withColumn("_order", order).join(bases, [group, "_part"]).select(*kept, (F.col("_base") + F.col("_order") - 1).alias(slot))


def shard_documents(docs: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Shard, slot and size of every row: (key, size, text_crc32, law, shard, slot, grown_shard)."""
    body = F.coalesce(F.col(text), F.lit(""))
    facts = docs.select(F.col(key), (F.octet_length(body) + 8).cast("bigint").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    out = numbered(jump_shards(facts, key, shards), "shard", "slot")
    return out.select(key, "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("bigint"), "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int = 24, key: str = "doc_id") -> str:
    """Write the whole rows as Parquet, a folder for each shard, and return the name of the folder column.

    Rows go to files where they lie: nothing is shuffled. The folder column is ``shard``, or ``_shard`` where the rows
    have a column of that name, which stays. Null keys share one shard; an empty table has no folders.
    """
    folder, = unused(docs.columns, "shard")
    placed = _jumps(key_bits(key, dict(docs.dtypes)[key]), shards)
    docs.withColumn(folder, placed["shard"].cast("int")).write.partitionBy(folder).parquet(path)
    return folder
