"""Streams over tables of one file and of many."""

import shutil

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import SMALL


@pytest.fixture(params=["one file", "a folder"])
def stored_as(request, spark, tmp_path):
    """Thirty documents, some of them copies that come days later, as either kind of table."""
    d = spark.read.parquet(f"{SMALL}/documents.parquet").where("length(text) < 2000").orderBy("doc_id").limit(30)
    d = d.unionByName(d.where("doc_id % 3 = 0").withColumn("doc_id", F.col("doc_id") + 100000))
    folder = tmp_path / "made"
    d.repartition(1 if request.param == "one file" else 3).write.parquet(str(folder))
    if request.param == "one file":
        shutil.copy(next(folder.glob("part-*.parquet")), tmp_path / "documents.parquet")
    else:
        folder.rename(tmp_path / "documents.parquet")
    return str(tmp_path)


def test_first_copies_of_any_table(spark, stored_as):
    got = [r.file_hash for r in entry.queries()["first_content_copies_stream"](spark, stored_as).collect()]
    want = spark.read.parquet(f"{stored_as}/documents.parquet").select(F.sha2("text", 256)).distinct().collect()
    assert sorted(got) == sorted(r[0] for r in want)


def test_ingest_of_any_table(spark, stored_as):
    got = entry.queries()["ingest_stream"](spark, stored_as)
    assert got.count() > 0 and got.where("n_values <> 1536").count() == 0
