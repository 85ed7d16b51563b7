"""Not-modified revisit resolution: an as-of join to the latest earlier full response of the same canonical URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import materialise, partitions

# Fields that a 304 response may update in the stored response (RFC 9110, 15.4.5, and Last-Modified).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
# Query parameters that name a visit, not a page.
TRACKING = "utm_[a-z]+|ref|fbclid|gclid|sessionid"


def canonical_url(url: Column) -> Column:
    """Host in lower case without www., default port and user; path without closing slash; query without tracking
    parameters, the rest in order; no scheme and no fragment. Null stays null."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1)), r"^(.*@)?(www\.)?", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(rf"^({TRACKING})(=|$)")))
    return F.when(url.isNotNull(), F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))))


def _weak(tag: Column) -> Column:
    return F.regexp_replace(F.trim(tag), r"^W/", "")


def _latest_before(log: DataFrame, what: list[str]) -> DataFrame:
    """Add ``last``: what (a struct of columns) the latest full response with the same key and a smaller ts has.

    Records are range-partitioned by key and time, so a key with a third of all records spans many partitions:
    windows run per partition and key, and what each partition ends with is carried on by key over the partitions.
    Of responses at the same time the largest record_id counts, then the largest digest and header text.
    """
    part = materialise(log.repartitionByRange(partitions(log.sparkSession), "key", "ts").withColumn("part", F.spark_partition_id()))
    order = F.struct("ts", "record_id", "digest", "sent")
    full = F.when(F.col("full"), F.struct(*what))
    inside = Window.partitionBy("part", "key").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    ends = part.where("full").groupBy("key", "part").agg(F.max(order).alias("at"), F.max_by(F.struct(*what), order).alias("end"))
    begins = part.select("key", "part").distinct().join(ends, ["key", "part"], "left")
    over = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = materialise(begins.select("key", "part", F.last("end", ignorenulls=True).over(over).alias("carry")))
    own = part.withColumn("_own", F.max_by(full, F.when(F.col("full"), order)).over(inside))
    return own.join(carried, ["key", "part"]).withColumn("last", F.coalesce("_own", "carry")).drop("_own", "carry", "part")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Resolve the not-modified revisits among records (record_id, url, ts, kind, headers, digest).

    ``kind`` is 'response' (a full one) or 'revisit'; ``ts`` is a timestamp or a number; ``headers`` maps field
    names to values, names in any case (of names that differ in case only, the first in code point order counts).
    Returns a row for each revisit: record_id, key, ts, refers_to, outcome and merged headers. The reference is the
    latest response of the canonical URL with a smaller ts (of equal ones the largest record_id). Outcomes:
    'resolved', where the first validator that both have agrees (ETag compared weakly, then Last-Modified, then
    payload digest); 'mismatch', where it doesn't; 'unverified', where they have none in common; 'missing', where
    there is no earlier response or url or ts is null. Headers merge only where resolved: the response's, with
    permitted fields replaced by the revisit's. Responses without record_id, url or ts are left out; a response
    that repeats a record_id stands for itself, and so does a revisit. Further columns of records are ignored. An
    empty table gives an empty result. What a revisit needs of its response travels with the window, so no join by
    the response gathers the revisits of a hot URL.
    """
    entries = F.array_sort(F.map_entries("headers"))
    lower = F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    ts = F.col("ts").cast("long")
    if dict(records.dtypes)["ts"].startswith("timestamp"):
        ts = F.unix_micros(F.col("ts").cast("timestamp"))
    named = records.where("kind in ('response', 'revisit')").select("record_id", canonical_url(F.col("url")).alias("key"), ts.alias("ts"), (F.col("kind") == "response").alias("full"), F.coalesce(lower, F.array().cast("array<struct<key:string,value:string>>")).alias("low"), "digest")
    first = F.filter("low", lambda e, i: F.array_position(F.transform("low", lambda x: x["key"]), e["key"]) == i + 1)
    named = named.withColumn("sent", first).drop("low")
    placed = F.col("key").isNotNull() & F.col("ts").isNotNull() & (F.col("record_id").isNotNull() | ~F.col("full"))
    met = _latest_before(named.where(placed), ["record_id", "digest", "sent"]).where("not full")
    empty = F.lit(None).cast(met.schema["last"].dataType)
    both = met.unionByName(named.where(~placed & ~F.col("full")).withColumn("last", empty))
    both = both.select("record_id", "key", "ts", F.col("last.record_id").alias("refers_to"), F.map_from_entries("sent").alias("headers"), "digest", F.map_from_entries("last.sent").alias("stored"), F.col("last.digest").alias("stored_digest"))
    outcome = F.when(F.col("refers_to").isNull(), "missing")
    for a, b in ((_weak(F.col("headers")["etag"]), _weak(F.col("stored")["etag"])), (F.col("headers")["last-modified"], F.col("stored")["last-modified"]), (F.col("digest"), F.col("stored_digest"))):
        outcome = outcome.when(a.isNotNull() & b.isNotNull(), F.when(a == b, "resolved").otherwise("mismatch"))
    new = F.map_filter("headers", lambda k, _: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter("stored", lambda k, _: ~F.coalesce(F.array_contains(F.map_keys(new), k), F.lit(False))), new)
    judged = both.withColumn("outcome", outcome.otherwise("unverified"))
    return judged.select("record_id", "key", "ts", "refers_to", "outcome", F.when(F.col("outcome") == "resolved", merged).alias("headers"))


def with_payload(resolved: DataFrame, responses: DataFrame, payload: str) -> DataFrame:
    """Resolved revisits with the payload of the response that they refer to."""
    own = responses.where("kind = 'response'").select(F.col("record_id").alias("refers_to"), payload).dropDuplicates(["refers_to"])
    return resolved.where("outcome = 'resolved'").join(own, "refers_to")


def crawl_of_pages(pages: DataFrame) -> DataFrame:
    """A crawl log over a table of pages (page_id, url, html): every page is fetched in full at time 10 page_id, and
    revisited twice later and once earlier, through other spellings of its URL. Revisits bring the validators of the
    fetch, those of another version (every third page), or only a digest (every fifth)."""
    tag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"'))
    digest = F.md5(F.coalesce("html", F.lit("")))
    base = pages.where("page_id is not null").select(F.col("page_id").cast("long").alias("p"), "url", tag.alias("tag"), digest.alias("digest"))
    at = lambda t: F.concat(F.lit("t"), t.cast("string"))
    p = F.col("p")
    full = F.struct((4 * p).alias("record_id"), F.col("url").alias("url"), (10 * p).alias("ts"), F.lit("response").alias("kind"), F.map_from_arrays(F.array(F.lit("ETag"), F.lit("Last-Modified"), F.lit("Date"), F.lit("Content-Type"), F.lit("Cache-Control")), F.array("tag", at(p), at(10 * p), F.lit("text/html"), F.lit("max-age=60"))).alias("headers"), F.col("digest").alias("digest"))

    def revisit(n: int, url: Column, t: Column) -> Column:
        sent = F.when(p % 5 == 0, F.array(F.struct(F.lit("date").alias("key"), at(t).alias("value")))).otherwise(
            F.array(F.struct(F.lit("date").alias("key"), at(t).alias("value")), F.struct(F.lit("etag").alias("key"), F.when(p % 3 == 0, F.lit('"other"')).otherwise(F.concat(F.lit("W/"), F.col("tag"))).alias("value")), F.struct(F.lit("content-length").alias("key"), F.lit("0").alias("value")), F.struct(F.lit("expires").alias("key"), at(t + 100).alias("value")))
        )
        return F.struct((4 * p + n).alias("record_id"), url.alias("url"), t.alias("ts"), F.lit("revisit").alias("kind"), F.map_from_entries(sent).alias("headers"), F.col("digest").alias("digest"))

    tracked = F.concat(F.regexp_replace("url", "#.*$", ""), F.when(F.instr(F.col("url"), "?") > 0, F.lit("&utm_source=a")).otherwise(F.lit("?utm_source=a")))
    return base.select(F.explode(F.array(full, revisit(1, F.concat("url", F.lit("#part")), 10 * p + 5), revisit(2, tracked, 10 * p + 50001), revisit(3, F.col("url"), 10 * p - 3))).alias("r")).select("r.*")


def resolved_pages(pages: DataFrame) -> DataFrame:
    """resolve_revisits over ``crawl_of_pages``, with the merged headers as columns."""
    out = resolve_revisits(crawl_of_pages(pages))
    fields = {"etag": "etag", "last_modified": "last-modified", "date": "date", "content_type": "content-type", "cache_control": "cache-control", "expires": "expires", "content_length": "content-length"}
    return out.select("record_id", "key", "ts", "refers_to", "outcome", *(F.col("headers")[v].alias(k) for k, v in fields.items()))
