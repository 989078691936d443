r"""WARC: resolving not-modified revisits by an as-of join on canonical URLs, with DataFrame functions only.

A revisit record says "as before" and has no body. It refers to the latest full response of the
same canonical URL that was captured strictly earlier (of several at one instant, the one with the
largest record id). Its validators are then checked: the entity tags, compared weakly, where both
records have one, else the modification dates. A resolved revisit has the response's headers,
updated by those that a not-modified answer may update (``PERMITTED``).

*As-of join.* Captures are dealt by URL and time slice, and a window looks back inside the slice;
what earlier slices end with is carried over in a table with one row per URL and slice. A slice is a
minute: a URL with a third of all captures is spread over its minutes, its carried rows are no more
than the minutes of the crawl, a task holds what one URL got in one of them, and bodies never move.

Defined cases: a capture without URL (null or empty), time or id is left out; a URL without a scheme and host
names itself only, letter by letter, and what a canonical form of another spells the same; header names are compared in lower
case and later duplicates of a name win; null headers are none; repeated captures are resolved
each; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Headers that a 304 answer may update (RFC 9110, 15.4.5).
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "vary"]
#: Query parameters that only track.
TRACKING = r"^(utm_[a-z]+|ref|gclid|fbclid)="


def canonical_url(url: Column) -> Column:
    """Host in lower case without www, m or default port; path without index file and last slash; sorted untracked parameters.

    What has no scheme and host, such as ``dns:`` records, relative and broken URLs, is kept as it is.
    """
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z]+://([^/?#]*)", 1)), r"^(www|m)\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1), r"/index\.html?$", ""), r"/$", "")
    params = F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda p: (p != "") & ~F.rlike(p, F.lit(TRACKING)))
    query = F.array_join(F.array_sort(params), "&")
    whole = F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(F.rlike(url, F.lit(r"^[A-Za-z]+://[^/?#]")), whole).otherwise(url)


def _entries(headers: Column) -> Column:
    """Name-value structs with lower-case names, sorted, the last of a name."""
    pairs = F.coalesce(F.map_entries(headers), F.array().cast("array<struct<key:string,value:string>>"))
    lower = F.transform(pairs, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    last = F.filter(lower, lambda e, i: ~F.exists(F.slice(lower, i + 2, F.size(lower)), lambda x: x["key"] == e["key"]))
    return F.array_sort(last)


def _header(entries: Column, name: str) -> Column:
    return F.get(F.transform(F.filter(entries, lambda e: e["key"] == name), lambda e: e["value"]), F.lit(0))


def merge_headers(stored: Column, update: Column) -> Column:
    """The stored entries, with the permitted ones of the update in their place; sorted."""
    allowed = F.filter(update, lambda e: e["key"].isin(PERMITTED))
    kept = F.filter(stored, lambda e: ~F.exists(allowed, lambda x: x["key"] == e["key"]))
    return F.array_sort(F.concat(kept, allowed))


def _weak(tag: Column) -> Column:
    return F.regexp_replace(F.trim(tag), "^W/", "")


def resolve_revisits(captures: DataFrame, slice_seconds: int = 60) -> DataFrame:
    """From (record_id, url, ts seconds, kind 'response' or 'revisit', headers map, digest): a row per revisit.

    (record_id, canonical_url, refers_to, status, merged headers as entries, digest); status is
    'resolved', 'mismatch', 'no validator' or 'no earlier response'; without an earlier response
    refers_to, headers and digest are null, and unless resolved so are headers and digest.
    """
    rows = captures.where(F.col("url").isNotNull() & (F.col("url") != "") & F.col("ts").isNotNull() & F.col("record_id").isNotNull()).select(
        "record_id", canonical_url(F.col("url")).alias("canonical_url"), "ts", "kind", _entries(F.col("headers")).alias("h"), "digest"
    ).withColumn("_slice", F.floor(F.col("ts") / slice_seconds))
    full = F.when(F.col("kind") == "response", F.struct("ts", "record_id", "h", "digest"))
    earlier = Window.partitionBy("canonical_url", "_slice").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    within = rows.withColumn("_full", full).withColumn("_in", F.max("_full").over(earlier)).where(F.col("kind") == "revisit")
    ends = rows.withColumn("_full", full).groupBy("canonical_url", "_slice").agg(F.max("_full").alias("_end"))
    before = Window.partitionBy("canonical_url").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(F.col("canonical_url").alias("_u"), F.col("_slice").alias("_s"), F.last("_end", ignorenulls=True).over(before).alias("_end"))
    found = within.join(carried, (F.col("canonical_url") == F.col("_u")) & (F.col("_slice") == F.col("_s")), "left").withColumn("r", F.coalesce("_in", "_end"))
    tag, old_tag = _header(F.col("h"), "etag"), _header(F.col("r.h"), "etag")
    date, old_date = _header(F.col("h"), "last-modified"), _header(F.col("r.h"), "last-modified")
    checked = F.when(tag.isNotNull() & old_tag.isNotNull(), _weak(tag) == _weak(old_tag)).when(date.isNotNull() & old_date.isNotNull(), date == old_date)
    status = F.when(F.col("r").isNull(), "no earlier response").when(checked, "resolved").when(~checked, "mismatch").otherwise("no validator")
    out = found.select("record_id", "canonical_url", F.col("r.record_id").alias("refers_to"), status.alias("status"), "h", F.col("r.h").alias("_rh"), F.col("r.digest").alias("_rd"))
    ok = F.col("status") == "resolved"
    return out.select(
        "record_id", "canonical_url", "refers_to", "status",
        F.when(ok, merge_headers(F.col("_rh"), F.col("h"))).alias("headers"), F.when(ok, F.col("_rd")).alias("digest"),
    )


def captures_of(pages: DataFrame) -> DataFrame:
    """A crawl log derived from ``pages``: each page as a response and three revisits, of which some cannot be resolved."""
    tag = F.concat(F.lit('"'), F.substring(F.md5("html"), 1, 12), F.lit('"'))
    at = F.col("page_id") * 60
    one = lambda i, url, ts, kind, headers: F.struct(
        (F.col("page_id") * 4 + i).alias("record_id"), url.alias("url"), ts.cast("long").alias("ts"), F.lit(kind).alias("kind"), headers.alias("headers"),
        (F.md5("html") if kind == "response" else F.lit(None).cast("string")).alias("digest"),
    )
    stamp = lambda ts: F.concat(F.lit("t"), ts.cast("string"))
    plain = F.create_map(
        F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.length("html").cast("string"), F.lit("ETag"), tag,
        F.lit("Last-Modified"), stamp(at - 600), F.lit("Date"), stamp(at), F.lit("Cache-Control"), F.lit("max-age=60"),
    )
    said = F.when(F.col("page_id") % 5 == 0, F.lit('"stale"')).otherwise(F.concat(F.lit("W/"), tag))
    tagged = F.create_map(F.lit("etag"), said, F.lit("DATE"), stamp(at + 90_000), F.lit("content-length"), F.lit("0"), F.lit("Expires"), stamp(at + 91_000))
    dated = F.create_map(F.lit("Last-Modified"), stamp(F.when(F.col("page_id") % 7 == 0, at).otherwise(at - 600)), F.lit("Date"), stamp(at + 500))
    early = F.create_map(F.lit("Cache-Control"), F.lit("no-cache"))
    variant = F.concat(F.regexp_replace("url", "^https?://(www\\.|m\\.)?", "http://www."), F.lit(""))
    return pages.where(F.col("page_id").isNotNull()).select(F.explode(F.array(
        one(0, F.col("url"), at, "response", plain), one(1, variant, at + 90_000, "revisit", tagged),
        one(2, F.col("url"), at + 500, "revisit", dated), one(3, variant, at - 500, "revisit", early),
    )).alias("c")).select("c.*")
