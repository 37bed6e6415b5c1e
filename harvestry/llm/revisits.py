"""Not-modified revisit resolution: an as-of join of revisit records to the latest earlier full response.

Records: record_id, url, ts (a long), status, etag, last_modified, headers (map of strings), digest. A record with
status 304 is a revisit, one with status 200 a full response; others take no part. A revisit refers to the response of
the same canonical url with the largest ts below its own (of equal ts the larger record_id). Its validators decide:

- ``resolved``: both have an ETag and they are weakly equal, or (an ETag missing) both have an equal Last-Modified;
- ``mismatch``: a validator that both have differs;
- ``unverified``: no validator is on both sides;
- ``missing``: there is no earlier full response.

Only resolved revisits get headers: the stored ones, overridden by those of the revisit that a 304 may update. Names
are lower-cased; of names that differ in case only, the last in name order wins. Null urls or times are ``missing``;
null headers are empty. Repeated records each keep a row.

The as-of join runs on (canonical url, time range) with ranges cut at the time column's quantiles, so that one url with
a third of all records is split over all ranges; what stands before a range comes from one summary row per url and
range. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import below

#: Fields that a 304 never updates in a stored response (RFC 9111, section 3.2, and framing fields).
FIXED = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade")
#: Query parameters that name a visit, not a resource.
TRACKING = r"^(utm_[a-z]+|fbclid|gclid|dclid|msclkid|sessionid|jsessionid|phpsessid|sid)$"


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, no default port, fragment, tracking parameter or empty query; other parameters
    sorted; an empty path is '/'. What isn't an absolute http url stays as it is, trimmed."""
    text = F.regexp_replace(F.trim(url), "#.*$", "")
    scheme = F.lower(F.regexp_extract(text, "^([A-Za-z]+)://", 1))
    authority = F.regexp_replace(F.lower(F.regexp_extract(text, "^[A-Za-z]+://([^/?]*)", 1)), "^[^@]*@", "")
    authority = F.when(scheme == "http", F.regexp_replace(authority, ":80$", "")).otherwise(F.regexp_replace(authority, ":443$", ""))
    path = F.regexp_extract(text, r"^[A-Za-z]+://[^/?]*(/[^?]*)", 1)
    query = F.regexp_extract(text, r"^[^?]*\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(F.regexp_extract(p, "^([^=]*)", 1)).rlike(TRACKING)))
    rebuilt = F.concat(scheme, F.lit("://"), authority, F.when(path == "", "/").otherwise(path), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))
    return F.when(scheme.isin("http", "https") & (authority != ""), rebuilt).otherwise(text)


def _lowered(headers: Column) -> Column:
    """Header names in lower case; the last in name order wins."""
    entries = F.array_sort(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))))
    lowered = F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    names = F.array_distinct(F.transform(lowered, lambda e: e["key"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(lowered, lambda e: e["key"] == n), -1)["value"]))


def merge_headers(stored: Column, update: Column) -> Column:
    """The stored headers with those of a 304 in their place, but for FIXED ones."""
    new = F.map_filter(_lowered(update), lambda k, _: ~k.isin(*FIXED))
    old = F.map_filter(_lowered(stored), lambda k, _: ~F.coalesce(F.array_contains(F.map_keys(new), k), F.lit(False)))
    return F.map_concat(old, new)


def resolve(records: DataFrame, ranges: int | None = None) -> DataFrame:
    """A row for each revisit: record_id, url, ts, refers_to, digest (of the response), outcome and merged headers."""
    spark = records.sparkSession
    ranges = ranges or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = records.select(
        F.col("record_id").cast("bigint").alias("record_id"), "url", canonical_url(F.col("url")).alias("target"), F.col("ts").cast("bigint").alias("ts"), F.col("status").cast("int").alias("status"), "etag", "last_modified", "headers", "digest"
    ).where("status in (200, 304)")
    cuts = []
    if ranges > 1:
        cuts = sorted({c for c in records.agg(F.percentile_approx(F.col("ts").cast("bigint"), [k / ranges for k in range(1, ranges)], 10_000)).first()[0] or []})
    own = own.withColumn("span", below(F.col("ts"), cuts))
    response = F.struct("record_id", "etag", "last_modified", "headers", "digest")
    is_full = F.col("status") == 200

    # what stands before a range: the last response of each earlier range of the same url
    last = own.where(is_full & F.col("target").isNotNull() & F.col("ts").isNotNull()).groupBy("target", "span").agg(F.max_by(response, F.struct("ts", "record_id")).alias("carried"))
    before = own.where("status = 304").select("target", "span").distinct().join(last, ["target", "span"], "full_outer")
    earlier = Window.partitionBy("target").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("target", "span", F.last("carried", True).over(earlier).alias("carried"))

    # within a range: revisits stand before responses of the same time, so that a response found is an earlier one
    # records without a url refer to nothing: each is a group of its own, or all of them would meet in one task
    alone = F.when(F.col("target").isNull(), F.monotonically_increasing_id())
    inside = Window.partitionBy("target", "alone", "span").orderBy("ts", F.when(is_full, 1).otherwise(0), "record_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = own.withColumn("alone", alone).withColumn("found", F.last(F.when(is_full & F.col("ts").isNotNull(), response), True).over(inside)).drop("alone").where("status = 304")
    rows = rows.join(before, ["target", "span"], "left").withColumn("found", F.when(F.col("ts").isNotNull() & F.col("target").isNotNull(), F.coalesce("found", "carried")))

    weak = lambda c: F.regexp_replace(F.trim(c), "^[Ww]/", "")
    tags = F.col("etag").isNotNull() & F.col("found.etag").isNotNull()
    dates = F.col("last_modified").isNotNull() & F.col("found.last_modified").isNotNull()
    same = F.when(tags, weak(F.col("etag")) == weak(F.col("found.etag"))).when(dates, F.trim("last_modified") == F.trim("found.last_modified"))
    outcome = F.when(F.col("found.record_id").isNull(), "missing").when(same.isNull(), "unverified").when(same, "resolved").otherwise("mismatch")
    merged = F.when(F.col("outcome") == "resolved", merge_headers(F.col("found.headers"), F.col("headers")))
    return rows.withColumn("outcome", outcome).select("record_id", "url", F.col("target").alias("canonical_url"), "ts", F.col("found.record_id").alias("refers_to"), F.when(F.col("outcome") == "resolved", F.col("found.digest")).alias("digest"), "outcome", merged.alias("headers"))


def captures(pages: DataFrame) -> DataFrame:
    """Records of a crawl in which every page was fetched in full once and asked for again later.

    Page p is fetched at 10 p; the second request comes after (p mod 9) * 1000 + 5 and is answered by a 304 whose
    validator is, by p mod 4: the page's ETag, a weak form of it, another one, or the date alone.
    """
    p = F.col("page_id").cast("bigint")
    digest = F.md5(F.coalesce(F.col("html"), F.lit("")).cast("binary"))
    etag = F.concat(F.lit('"'), F.substring("digest", 1, 16), F.lit('"'))
    pages = pages.select(p.alias("page_id"), "url", digest.alias("digest")).withColumn("tag", etag).withColumn("date", F.concat(F.lit("day "), (F.col("page_id") % 365).cast("string")))
    full = pages.select(
        (F.col("page_id") * 2).alias("record_id"), "url", (F.col("page_id") * 10).alias("ts"), F.lit(200).alias("status"), F.col("tag").alias("etag"), F.col("date").alias("last_modified"),
        F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("ETag"), F.col("tag"), F.lit("Cache-Control"), F.lit("max-age=60"), F.lit("X-Page"), F.col("page_id").cast("string")).alias("headers"), "digest",
    )
    kind = F.col("page_id") % 4
    asked = F.when(kind == 0, F.col("tag")).when(kind == 1, F.concat(F.lit("W/"), "tag")).when(kind == 2, F.lit('"other"'))
    again = pages.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), "url", (F.col("page_id") * 10 + 5 + F.col("page_id") % 9 * 1000).alias("ts"), F.lit(304).alias("status"), asked.alias("etag"), F.col("date").alias("last_modified"),
        F.create_map(F.lit("Content-Type"), F.lit("text/plain"), F.lit("cache-control"), F.lit("max-age=600"), F.lit("Date"), F.col("date")).alias("headers"), F.lit(None).cast("string").alias("digest"),
    )
    return full.union(again)
