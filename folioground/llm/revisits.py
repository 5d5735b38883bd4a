"""Not-modified revisits of a web archive, resolved to the response they stand for.

A revisit (status 304) carries no body. It is joined as of its time, by canonical URL, to the latest earlier full
response; its validators must agree with those of that response, and the headers that a 304 may bring replace the
stored ones.

The as-of join is a running last value over records sorted by (URL, time, id). The sorted order is dealt to
partitions by ranges of all three, so a URL that a third of the records have spans many partitions; what a partition
needs from those before it is one record for each URL that spans them, found by a window over partitions.

Defined cases: a null URL, or a null time, resolves to nothing (``no_earlier``); a response with the same time as a
revisit counts as earlier if its id is smaller; repeated records: equal ids at equal times are not earlier than each
other; a revisit with an entity tag is checked by that alone, else by its modification time, without either it is
``no_validator``; null headers are empty; an empty table gives no rows; columns other than the named ones are
ignored, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from folioground.llm.base import staged

#: Headers of a 304 that replace those of the stored response. Fixed values.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
#: Query parameters that do not name a resource. Fixed values.
TRACKING = r"^(utm_[^=]*|fbclid|gclid|ref)(=|$)"
_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?"


def canonical_url(url: Column) -> Column:
    """Host in lower case without user, ``www.`` and default port; path without a final slash; sorted parameters
    without those that only track; no scheme and no fragment. What is not an absolute URL stands as it is."""
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(url, _URL, 2)), r"^.*@", ""), r"(:80|:443)$", "")
    host = F.regexp_replace(host, r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(url, _URL, 3), r"/+$", "")
    kept = F.filter(F.split(F.substring(F.regexp_extract(url, _URL, 4), 2, 1 << 30), "&"), lambda p: (p != "") & ~p.rlike(TRACKING))
    query = F.array_join(F.array_sort(kept), "&")
    return F.when(url.rlike(_URL), F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))).otherwise(url)


def _strong(tag: Column) -> Column:
    return F.regexp_replace(F.trim(tag), r"^W/", "")


def resolve(records: DataFrame, record_id: str = "record_id", url: str = "url", time: str = "time", kind: str = "kind",
            etag: str = "etag", last_modified: str = "last_modified", digest: str = "digest", headers: str = "headers") -> DataFrame:
    """(record_id, canonical_url, outcome, refers_to, digest, status, headers) of every revisit.

    ``outcome``: resolved, no_earlier, validator_mismatch or no_validator; only a resolved one has the others filled.
    """
    own = records.select(F.col(record_id).alias("id"), canonical_url(F.col(url)).alias("url"), F.col(time).alias("t"), F.col(kind).alias("kind"), F.col(etag).alias("etag"),
                         F.col(last_modified).alias("modified"), F.col(digest).alias("digest"), F.coalesce(F.col(headers), F.create_map().cast("map<string,string>")).alias("headers"))
    full = F.when((F.col("kind") == "response") & F.col("t").isNotNull() & F.col("url").isNotNull(), F.struct("id", "t", "etag", "modified", "digest", "headers"))
    ordered = own.repartitionByRange("url", "t", "id").sortWithinPartitions("url", "t", "id")
    dealt = staged(ordered.withColumn("full", full).withColumn("part", F.spark_partition_id()), "records")
    # Within a partition: the last response before the record. Ranges keep each of these groups within a partition's size.
    before = W.partitionBy("part", "url").orderBy("t", "id", F.col("kind").desc()).rowsBetween(W.unboundedPreceding, -1)
    # Across partitions: one row for each partition and URL.
    lasts = dealt.groupBy("part", "url").agg(F.max_by("full", F.when(F.col("full").isNotNull(), F.struct("t", "id"))).alias("last"))
    carry = lasts.select("part", "url", F.last("last", True).over(W.partitionBy("url").orderBy("part").rowsBetween(W.unboundedPreceding, -1)).alias("carried")).where("carried is not null")
    seen = dealt.withColumn("near", F.last("full", True).over(before)).where(F.col("kind") == "revisit")
    met = seen.join(carry, ["part", "url"], "left").withColumn("of", F.when(F.col("t").isNotNull(), F.coalesce("near", "carried")))
    agrees = F.when(F.col("etag").isNotNull(), F.coalesce(_strong(F.col("etag")) == _strong(F.col("of.etag")), F.lit(False))).otherwise(F.coalesce(F.col("modified") == F.col("of.modified"), F.lit(False)))
    outcome = (F.when(F.col("of").isNull(), "no_earlier").when(F.col("etag").isNull() & F.col("modified").isNull(), "no_validator").when(agrees, "resolved").otherwise("validator_mismatch"))
    lower = lambda m: F.transform_keys(m, lambda k, _: F.lower(k))
    fresh = F.map_filter(lower(F.col("headers")), lambda k, _: k.isin(PERMITTED))
    stored = F.map_filter(lower(F.col("of.headers")), lambda k, _: ~F.array_contains(F.map_keys(fresh), k))
    done = met.withColumn("outcome", outcome)
    when = lambda c: F.when(F.col("outcome") == "resolved", c)
    return done.select(F.col("id").alias(record_id), F.col("url").alias("canonical_url"), "outcome", when(F.col("of.id")).alias("refers_to"), when(F.col("of.digest")).alias("digest"),
                       when(F.lit(200)).alias("status"), when(F.map_concat(stored, fresh)).alias("headers"))


def crawl_of_pages(pages: DataFrame) -> DataFrame:
    """A crawl that the table of pages implies: pages of a site's section are captures of one address, in order of id.

    A third of them, by the length of the page, are revisits. The entity tag changes every 40 ids; the length also
    decides which records have none and use the modification time, or have neither.
    """
    size = F.coalesce(F.length("html"), F.lit(0))
    section = F.regexp_extract("url", r"^([a-z]+://[^/]*/[^/?#]*)", 1)
    version = F.floor(F.col("page_id") / 40)
    kind = F.when(size % 3 == 0, "revisit").otherwise("response")
    tag = F.when(size % 7 < 5, F.concat(F.when(size % 2 == 0, "W/").otherwise(""), F.lit('"v'), version.cast("string"), F.lit('"')))
    modified = F.when(size % 7 < 6, version * 40)
    headers = F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("ETag"), F.coalesce(tag, F.lit("")), F.lit("Date"), F.col("page_id").cast("string"), F.lit("Content-Length"), F.coalesce(F.octet_length("html"), F.lit(0)).cast("string"))
    return pages.select(F.col("page_id").alias("record_id"), F.concat(section, F.lit("/?utm_source=crawl#"), F.col("page_id").cast("string")).alias("url"), F.col("page_id").alias("time"), kind.alias("kind"),
                        tag.alias("etag"), modified.alias("last_modified"), F.md5(F.coalesce(F.col("html"), F.lit(""))).alias("digest"), headers.alias("headers"))
