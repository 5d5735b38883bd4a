"""Exact substring joins through equi-joins on grams or word shingles; no cross join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folioground.functions import text as X

SHINGLE_WORDS = 3
KEY = 24
WINDOW = 40


def _spelled(texts: DataFrame, name: str) -> DataFrame:
    """Every substring of up to ``KEY`` characters of each text, a row each: linear in its length.

    A text is first cut into overlapping windows, so no substring is taken far from its start.
    """
    window = F.explode(F.sequence(F.lit(0), F.floor((F.length(name) - 1) / WINDOW).cast("int"))).alias("w")
    start = F.explode(F.sequence(F.lit(1), F.least(F.lit(WINDOW), F.length("part")))).alias("start")
    size = F.explode(F.sequence(F.lit(1), F.least(F.lit(KEY), F.length("part") - F.col("start") + 1))).alias("size")
    parts = texts.filter(F.length(name) > 0).select(name, window).select(
        name, F.substring(name, F.col("w") * WINDOW + 1, F.lit(WINDOW + KEY - 1)).alias("part"))
    return (parts.select(name, "part", start).select(name, "part", "start", size)
            .select(name, F.substring("part", F.col("start"), F.col("size")).alias("key")))


def substring_pairs(needles: DataFrame, haystacks: DataFrame) -> DataFrame:
    """All (needle, haystack) with the needle inside the haystack.

    Both inputs hold one column of distinct strings, named ``needle`` and ``haystack``. Haystacks are
    spelled out into short substrings that meet the first ``KEY`` characters of a needle by plain
    equality; only longer needles are then verified. Nothing is compared all with all.
    """
    keyed = needles.filter(F.length("needle") > 0).withColumn("key", F.substring("needle", 1, KEY))
    # A few bytes of words spell out into many rows: keep every task of the session busy.
    tasks = int(haystacks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (_spelled(haystacks.repartition(tasks, "haystack"), "haystack").join(keyed, "key")
            .filter((F.length("needle") <= KEY) | F.contains("haystack", "needle"))
            .select("needle", "haystack").distinct())


def _shingles(words: str) -> Column:
    """Hashes of every run of three words, from a column of words, by zipping it with itself."""
    n = F.greatest(F.size(words) - SHINGLE_WORDS + 1, F.lit(0))
    first, second, third = (F.slice(words, F.lit(k), n) for k in (1, 2, 3))
    return F.zip_with(F.zip_with(first, second, lambda a, b: F.xxhash64(a, b)), third, lambda h, c: F.xxhash64(h, c))


def passage_pairs(needles: DataFrame, haystacks: DataFrame) -> DataFrame:
    """(needle_id, haystack_id) for every passage that stands verbatim in a long text.

    Inputs: ``needle_id, needle`` and ``haystack_id, haystack``. The inner words of a passage stand
    as whole words in any text that holds it, so passages of five words or more are found by the
    hash of their rarest inner three-word shingle, shorter ones by their longest word.
    Only hashes and ids are joined; texts come back for the surviving pairs.
    """
    wide = needles.withColumn("ws", X.words(F.col("needle")))
    long_enough = F.size("ws") >= SHINGLE_WORDS + 2
    inner = (
        wide.filter(long_enough)
        .withColumn("inside", F.slice("ws", F.lit(2), F.size("ws") - 2))
        .select("needle_id", F.explode(F.array_distinct(_shingles("inside"))).alias("shingle")))
    text_shingles = (
        haystacks.withColumn("ws", X.words(F.col("haystack")))
        .select("haystack_id", F.explode(F.array_distinct(_shingles("ws"))).alias("shingle"))
        .join(inner.select("shingle").distinct(), "shingle", "left_semi"))
    frequency = text_shingles.groupBy("shingle").count()
    anchors = (
        inner.join(frequency, "shingle", "left").groupBy("needle_id")
        .agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), F.col("shingle"))).alias("r"))
        .select("needle_id", F.col("r.shingle").alias("shingle")))
    found = (
        anchors.join(text_shingles, "shingle").select("needle_id", "haystack_id")
        .join(needles, "needle_id").join(haystacks, "haystack_id")
        .filter(F.contains("haystack", "needle")).select("needle_id", "haystack_id"))
    short = wide.filter(~long_enough & (F.size("ws") > 0)).select("needle_id", "needle", "ws")
    if short.isEmpty():
        return found
    return found.unionByName(_short_passages(short, haystacks))


def _short_passages(short: DataFrame, haystacks: DataFrame) -> DataFrame:
    """Passages of few words: their longest word lies inside some word of the text."""
    longest = F.array_max(F.transform("ws", lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))
    anchored = short.select("needle_id", "needle", longest["w"].alias("anchor"))
    postings = haystacks.select("haystack_id", F.explode(F.array_distinct(X.words(F.col("haystack")))).alias("word"))
    pairs = substring_pairs(anchored.select(F.col("anchor").alias("needle")).distinct(),
                            postings.select(F.col("word").alias("haystack")).distinct()).toDF("anchor", "word")
    candidates = (postings.join(pairs, "word").join(anchored, "anchor")
                  .select("needle_id", "needle", "haystack_id").distinct())
    return (candidates.join(haystacks, "haystack_id").filter(F.contains("haystack", "needle"))
            .select("needle_id", "haystack_id"))
