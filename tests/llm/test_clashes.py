"""Columns named as the operators name theirs, and empty tables, in each pipeline stage and in sharded files."""

import pytest
from pyspark.sql import functions as F

from folioground.llm import jaccard, sharding
from folioground.staging import stage_path

import corpus_pipeline

OWN = ["_kept", "_chosen", "_set", "_empty", "_group", "_least", "__SET", "_jumps", "grown_shard", "score", "key"]


def clashing(df):
    return df.select("*", *(F.lit(f"own {c}").alias(c) for c in OWN if c not in df.columns))


def test_one_of_each_with_clashing_names(spark):
    words = [f"w{i}" for i in range(60)]
    copy = words[:30] + ["other"] + words[31:]
    rows = [(1, " ".join(words)), (2, " ".join(copy)), (3, "short"), (None, None), (None, ""), (1, " ".join(reversed(words))), (3, "short"), (4, "")]
    df = clashing(spark.createDataFrame(rows, "doc_id bigint, text string"))
    got = jaccard.one_of_each(df)
    assert got.columns == df.columns
    kept = sorted((r.doc_id or 0, r.text or "") for r in got.collect())
    assert kept == sorted([(1, " ".join(words)), (1, " ".join(reversed(words))), (3, "short"), (0, ""), (0, ""), (4, "")])
    assert {r["_kept"] for r in got.collect()} == {"own _kept"}


def test_shards_keep_a_column_named_shard(spark):
    df = spark.createDataFrame([(i, f"mine {i}") for i in range(40)] + [(None, "none")], "doc_id bigint, shard string")
    path = stage_path(spark, "shards")
    assert sharding.write_shards(df, path, 5) == "_shard"
    back = spark.read.parquet(path)
    placed = {r.doc_id: r.shard for r in sharding.jump_shards(df.select("doc_id"), "doc_id", 5).collect()}
    assert {r.doc_id: (r.shard, r["_shard"]) for r in back.collect()} == {i: (f"mine {i}" if i is not None else "none", s) for i, s in placed.items()}


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES, ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_an_empty_table_with_clashing_names(spark, sf_dir, name, stage):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("false")
    assert stage(spark, clashing(docs), sf_dir).count() == 0
