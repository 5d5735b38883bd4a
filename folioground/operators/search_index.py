"""A stored search index: postings in blocks with what a block can reach, a gram dictionary, and statistics.

Tables below one folder, each in partitions by ``batch`` (and, for the large ones, ``bucket`` of the collection):

* ``chunks``: every chunk with its block, its place there, its state, length and the attributes filters look at;
* ``postings``: a row for each word of a block, with the places where active and where any live chunk of the block has
  it (what the block can reach at most), and an entry for each chunk: place, state, places, count, length;
* ``words``, ``totals``: documents of each word, documents and words of each collection, by state, as signed changes;
* ``vocabulary``, ``grams``, ``gram_counts``: every word once, the words that hold a substring of one to three
  characters, and how many they are;
* ``removed``: versions whose chunks of earlier batches no longer count.

A batch only adds rows. Writing it again replaces its own partitions and looks at earlier batches alone, so a job that
failed half-way may be run again. Searches read the buckets of the collections they ask for.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from folioground import constants as C
from folioground.functions import text as X
from folioground.operators.index import IN_DEPARTMENT, IN_HEADING, IN_NORMALIZED, IN_SCHEME, IN_TEXT
from folioground.staging import shuffles_dropped

ACTIVE, HISTORICAL, DELETED = 0, 1, 2
GRAM = 3
KEY = ["batch", "collection_id", "block"]

_ENTRY = "struct<at:int, state:int, bits:int, tf:int, dl:int>"
SCHEMAS = {
    "chunks": "collection_id string, block bigint, at int, vector_id string, version_id string, state int, dl int, scheme_name string, department string, state_or_district string, language string, batch int, bucket int",
    "postings": f"collection_id string, block bigint, word string, active_places int, live_places int, entries array<{_ENTRY}>, batch int, bucket int",
    "words": "collection_id string, word string, df_active bigint, df_historical bigint, df_deleted bigint, batch int",
    "totals": "collection_id string, docs_active bigint, docs_historical bigint, docs_deleted bigint, words_active bigint, words_historical bigint, words_deleted bigint, batch int",
    "vocabulary": "word string, batch int",
    "grams": "gram string, word string, batch int",
    "gram_counts": "gram string, n bigint, batch int",
    "removed": "version_id string, batch int",
    "settings": "buckets int, block int",
}


def _grams(word: str, sizes: list[int]) -> Column:
    """Distinct substrings of the given sizes."""
    def of(n: int) -> Column:
        starts = F.when(F.length(word) >= n, F.sequence(F.lit(1), F.length(word) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substr(F.col(word), i, F.lit(n)))

    return F.array_distinct(F.concat(*map(of, sizes)))


def _by_state(prefix: str, value) -> list[Column]:
    return [F.sum(value(state)).cast("bigint").alias(f"{prefix}_{name}") for name, state in (("active", ACTIVE), ("historical", HISTORICAL), ("deleted", DELETED))]


def _block_postings(chunks: pa.Table) -> pa.Table:
    """Postings of the chunks of one block, some tens of chunks."""
    chunks = chunks.sort_by("vector_id")
    n = chunks.num_rows
    at, words, bits = [], [], []
    for name, bit in (("_text", IN_NORMALIZED), *((f"_in_{b}", b) for b in (IN_TEXT, IN_HEADING, IN_SCHEME, IN_DEPARTMENT))):
        lists = chunks[name].combine_chunks()
        at.append(pc.list_parent_indices(lists).to_numpy())
        words.append(pc.list_flatten(lists))
        bits.append(np.full(len(words[-1]), bit))
    coded = pa.concat_arrays(words).dictionary_encode()
    code, at, bits = coded.indices.to_numpy().astype(np.int64), np.concatenate(at).astype(np.int64), np.concatenate(bits)
    of_chunk, row = np.unique(code * max(n, 1) + at, return_inverse=True)
    found = np.zeros(len(of_chunk), np.int64)
    np.bitwise_or.at(found, row, bits)
    tf = np.bincount(row, weights=bits == IN_NORMALIZED, minlength=len(of_chunk))
    code, at = of_chunk // max(n, 1), of_chunk % max(n, 1)
    state = chunks["state"].to_numpy()[at]
    starts = np.flatnonzero(np.diff(code, prepend=-1))
    reach = lambda states: pa.array(np.bitwise_or.reduceat(np.where(np.isin(state, states), found, 0), starts) if len(starts) else [], pa.int32())
    whole = lambda a: pa.array(a, pa.int32())
    entries = pa.ListArray.from_arrays(whole(np.append(starts, len(code))), pa.StructArray.from_arrays(
        [whole(at), whole(state), whole(found), whole(tf.astype(np.int64)), whole(chunks["dl"].to_numpy()[at])], ["at", "state", "bits", "tf", "dl"]))
    same = lambda name: chunks[name].take(pa.array(np.zeros(len(starts), np.int64))).combine_chunks()
    return pa.table({
        "collection_id": same("collection_id"), "block": same("block"), "word": coded.dictionary.take(pa.array(code[starts])), "active_places": reach([ACTIVE]),
        "live_places": reach([ACTIVE, HISTORICAL]), "entries": entries, "batch": same("batch"), "bucket": same("bucket")})


@dataclass(frozen=True)
class SearchIndex:
    spark: SparkSession
    path: str
    buckets: int
    block: int

    @staticmethod
    def create(spark: SparkSession, path: str, buckets: int = 8, block: int = 32) -> "SearchIndex":
        """An empty index: ``buckets`` partitions of collections, blocks of about ``block`` chunks."""
        spark.createDataFrame([(buckets, block)], SCHEMAS["settings"]).write.mode("overwrite").parquet(f"{path}/settings")
        index = SearchIndex(spark, path, buckets, block)
        for name in SCHEMAS.keys() - {"settings"}:
            index._write(spark.createDataFrame([], SCHEMAS[name]), name)
        return index

    @staticmethod
    def open(spark: SparkSession, path: str) -> "SearchIndex":
        return SearchIndex(spark, path, *spark.read.schema(SCHEMAS["settings"]).parquet(f"{path}/settings").first())

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.path}/{name}")

    def _write(self, df: DataFrame, name: str) -> None:
        columns = [c.split()[0] for c in SCHEMAS[name].replace(_ENTRY, "entry").split(", ")]
        by = [c for c in ("batch", "bucket") if c in columns]
        with shuffles_dropped(self.spark):
            df.select(*columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{self.path}/{name}")

    def bucket_of(self, collection: str = "collection_id") -> Column:
        return F.pmod(F.xxhash64(collection), F.lit(self.buckets)).cast("int")

    # -- writing --------------------------------------------------------------------------------------------

    def add(self, payload: DataFrame, batch: int) -> None:
        """Index the chunks of ``payload``; their versions replace what earlier batches hold of them."""
        self.add_chunks(payload, batch)
        self.add_words(payload, batch)

    def add_chunks(self, payload: DataFrame, batch: int) -> None:
        """The chunks alone, which keyword search reads, and the totals of collections, which come from them; ``add_words`` makes
        the rest from the same rows. No text is moved."""
        at = (F.row_number().over(Window.partitionBy("collection_id", "block").orderBy("vector_id")) - 1).alias("at")
        light = [f.split()[0] for f in SCHEMAS["chunks"].split(", ") if f.split()[0] != "at"]
        self._write(self._dealt(payload, batch).select(*light).select("*", at), "chunks")
        self._remove_earlier(payload, batch)
        self._total(batch)

    def add_words(self, payload: DataFrame, batch: int) -> None:
        """Postings, documents of each word and grams of a batch whose chunks are written."""
        self._write(self._postings(self._dealt(payload, batch)), "postings")
        self._count(batch)
        self._spell(batch)

    def _dealt(self, payload: DataFrame, batch: int) -> DataFrame:
        """Rows of a payload with their state, length and block."""
        status = F.when(F.col("document_status") == C.DELETED, DELETED).when(F.col("active"), ACTIVE).otherwise(HISTORICAL)
        sizes = F.broadcast(payload.groupBy("collection_id").agg(F.ceil(F.count("*") / self.block).alias("_blocks")))  # a row a collection
        run = F.floor(F.coalesce("chunk_index", F.lit(0)) / self.block)
        # Where the search text is derived, its words are counted on the text it comes from.
        length = X.search_word_count(F.coalesce("compat_text", "chunk_text")) if "compat_text" in payload.columns else X.word_count(F.col("normalized_text"))
        # Runs of a version's chunks stay together; a large collection has as many blocks as it needs.
        return (payload.join(sizes, "collection_id").withColumn("block", F.pmod(F.xxhash64("version_id", run), F.col("_blocks")))
                .withColumns({"state": status, "dl": length, "batch": F.lit(batch), "bucket": self.bucket_of()}))

    def _postings(self, dealt: DataFrame) -> DataFrame:
        """Words of a chunk are counted in its row; one shuffle then brings the chunks of a block together."""
        once = lambda c: F.array_distinct(X.words(F.lower(F.coalesce(c, F.lit("")))))
        places = {"_text": X.words(F.coalesce("normalized_text", F.lit("")))} | {f"_in_{bit}": once(c) for c, bit in (
            ("chunk_text", IN_TEXT), ("section_heading", IN_HEADING), ("scheme_name", IN_SCHEME), ("department", IN_DEPARTMENT))}
        block = ["batch", "bucket", "collection_id", "block"]
        held = dealt.select(*block, "vector_id", "state", "dl", *(c.alias(n) for n, c in places.items()))
        return held.groupBy(*block).applyInArrow(_block_postings, SCHEMAS["postings"])

    def _remove_earlier(self, payload: DataFrame, batch: int) -> None:
        earlier = self.table("chunks").where(F.col("batch") < batch).select("version_id").distinct()
        self._write(payload.select("version_id").distinct().join(earlier, "version_id", "left_semi").withColumn("batch", F.lit(batch)), "removed")

    def _gone(self, batch: int) -> DataFrame:
        """Chunks that versions of the batch had before."""
        return self.live_chunks(batch).join(self.table("removed").where(F.col("batch") == batch).select("version_id"), "version_id", "left_semi")

    def _total(self, batch: int) -> None:
        """Changes of the totals: what the batch brings, less what its versions had before."""
        gone = self._gone(batch)
        new = self.table("chunks").where(F.col("batch") == batch)
        signed = new.select("collection_id", "state", "dl", F.lit(1).alias("s")).unionByName(gone.select("collection_id", "state", "dl", F.lit(-1).alias("s")))
        totals = signed.groupBy("collection_id").agg(*_by_state("docs", lambda k: F.when(F.col("state") == k, F.col("s")).otherwise(0)),
                                                     *_by_state("words", lambda k: F.when(F.col("state") == k, F.col("s") * F.col("dl")).otherwise(0)))
        self._write(totals.withColumn("batch", F.lit(batch)), "totals")

    def _count(self, batch: int) -> None:
        """Changes of the documents of each word, in the same way."""
        gone = self._gone(batch)
        told = lambda k: F.size(F.filter("entries", lambda e: (e["state"] == k) & (e["tf"] > 0))).cast("bigint")
        brought = self.table("postings").where(F.col("batch") == batch).select("collection_id", "word", *(told(k).alias(f"n{k}") for k in (ACTIVE, HISTORICAL, DELETED)))
        lost = (self.table("postings").where(F.col("batch") < batch).join(gone.select(*KEY).distinct(), KEY, "left_semi")
                .select(*KEY, "word", F.inline("entries")).where("tf > 0").join(gone.select(*KEY, "at"), [*KEY, "at"], "left_semi")
                .select("collection_id", "word", *(F.when(F.col("state") == k, -1).otherwise(0).cast("bigint").alias(f"n{k}") for k in (ACTIVE, HISTORICAL, DELETED))))
        words = brought.unionByName(lost).groupBy("collection_id", "word").agg(*_by_state("df", lambda k: F.col(f"n{k}")))
        self._write(words.withColumn("batch", F.lit(batch)), "words")

    def _spell(self, batch: int) -> None:
        """Words that no earlier batch has, with their grams."""
        known = self.table("vocabulary").where(F.col("batch") < batch).select("word")
        new = self.table("postings").where(F.col("batch") == batch).select("word").distinct().join(known, "word", "left_anti").withColumn("batch", F.lit(batch))
        self._write(new, "vocabulary")
        words = self.table("vocabulary").where(F.col("batch") == batch)
        self._write(words.select("batch", "word", F.explode(_grams("word", [1, 2, GRAM])).alias("gram")), "grams")
        self._write(self.table("grams").where(F.col("batch") == batch).groupBy("batch", "gram").agg(F.count("*").alias("n")), "gram_counts")

    # -- reading --------------------------------------------------------------------------------------------

    def live_chunks(self, before: int | None = None) -> DataFrame:
        """Chunks that no later batch has replaced; with ``before``, as the batches before it have it."""
        chunks, removed = self.table("chunks"), self.table("removed")
        if before is not None:
            chunks, removed = chunks.where(F.col("batch") < before), removed.where(F.col("batch") < before)
        gone = removed.groupBy("version_id").agg(F.max("batch").alias("_gone"))
        return chunks.join(gone, "version_id", "left").where(F.col("_gone").isNull() | (F.col("batch") >= F.col("_gone"))).drop("_gone")

    def within(self, name: str, collections: DataFrame) -> DataFrame:
        """Rows of a table in the buckets of some collections, a partition filter of at most ``buckets`` numbers."""
        wanted = [r[0] for r in collections.select(self.bucket_of().alias("b")).distinct().collect()]
        return self.table(name).where(F.col("bucket").isin(wanted))

    def words_with(self, terms: DataFrame) -> DataFrame:
        """(term, word): every word of the vocabulary that holds a term, by its two rarest grams, then verified."""
        wanted = terms.select("term").distinct().where(F.length("term") > 0)
        grams = self.table("grams").select("gram", "word")
        short = wanted.where(F.length("term") <= GRAM).join(grams.withColumnRenamed("gram", "term"), "term")
        counts = self.table("gram_counts").groupBy("gram").agg(F.sum("n").alias("n"))
        spelled = wanted.where(F.length("term") > GRAM).select("term", F.explode(_grams("term", [GRAM])).alias("gram"))
        rarest = (spelled.join(counts, "gram", "left").groupBy("term")
                  .agg(F.slice(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))), 1, 2).alias("g")))  # a term has few grams
        chosen = rarest.where("g[0].n > 0").select("term", F.size("g").alias("need"), F.explode("g.gram").alias("gram"))
        met = chosen.join(grams, "gram").groupBy("term", "word").agg(F.count("*").alias("got"), F.first("need").alias("need"))
        return short.select("term", "word").unionByName(
            met.where((F.col("got") == F.col("need")) & F.contains("word", "term")).select("term", "word"))

    def word_counts(self, words: DataFrame, collections: bool = True) -> DataFrame:
        """Documents of some words by state, in each collection or in all."""
        held = self.table("words").join(words.select("word").distinct(), "word", "left_semi")
        keys = ["collection_id", "word"] if collections else ["word"]
        return held.groupBy(*keys).agg(*(F.sum(f"df_{s}").alias(f"df_{s}") for s in ("active", "historical", "deleted")))

    def collection_totals(self, collections: bool = True) -> DataFrame:
        names = [f"{p}_{s}" for p in ("docs", "words") for s in ("active", "historical", "deleted")]
        return self.table("totals").groupBy(*["collection_id"] * collections).agg(*(F.sum(n).alias(n) for n in names))


def build(payload: DataFrame, path: str, buckets: int = 8, block: int = 32, words: bool = True) -> SearchIndex:
    """A new index of one batch; without ``words``, its chunks alone."""
    index = SearchIndex.create(payload.sparkSession, path, buckets, block)
    index.add_chunks(payload, 1)
    if words:
        index.add_words(payload, 1)
    return index
