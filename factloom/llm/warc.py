"""Operator 6: resolution of not-modified revisits in web archives.

A revisit record says that a page had not changed since an earlier capture.
It is joined, as of its time, to the latest earlier full response for the same
canonical URL.  Its validators are checked against that response: the entity
tag if the revisit has one (weak comparison), else the modification date, which
must not be later than the stored one.  Where they agree, the stored headers
are merged with those that a 304 answer may update.

The captures of one URL may be a third of all records.  They are therefore
dealt by URL and span of time: within a span a window finds the last response,
and the last response of earlier spans, one row for each URL and span, is
carried in.

Rows: records without a URL or time, and revisits without any earlier response,
are ``unresolved``; without a validator on either side ``unchecked``; of
records at the same time the one with the larger id is later, and a response
at the time of the revisit with a larger id doesn't count.  Repeated rows are
resolved alike.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: the headers of RFC 9110, 15.4.5, that a 304 answer may carry on.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
# Fixed value: query parameters that only tell where a reader came from.
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid)(=.*)?$"
#: Spans of time that the captures of a URL are dealt over, at least.
SPANS = 512
#: Records of a span, about, where there are more.
SPAN_ROWS = 100_000


def canonical_url(url: Column) -> Column:
    """Host in lower case without ``www.`` and default port, path, sorted query without tracking; no scheme, no fragment."""
    bare = F.regexp_replace(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://|#.*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1)), r"^www\.|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING))), "&")
    return F.concat(host, F.when(path == "", "/").otherwise(path), F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept)))


def resolve(records: DataFrame) -> DataFrame:
    """For each revisit: ``record_id, url_key, refers_to, outcome, headers``.

    ``records`` has ``record_id, kind`` ('response' or 'revisit'), ``url, ts,
    etag, last_modified, headers`` (map with names in lower case).
    """
    bounds = records.agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count("*").alias("n")).first()
    first = int(bounds["a"].timestamp()) if bounds["a"] else 0
    spans = max(SPANS, bounds["n"] // SPAN_ROWS)
    width = max(1.0, ((int(bounds["b"].timestamp()) if bounds["b"] else 0) - first) / spans)
    keyed = records.select("record_id", "kind", canonical_url(F.col("url")).alias("url_key"), "ts", "etag", "last_modified", "headers")
    keyed = keyed.withColumn("span", F.floor((F.unix_seconds("ts") - F.lit(first)) / F.lit(width)))
    # Where a key or a time is missing, nothing is joined; spread such rows.
    lost = F.col("url_key").isNull() | F.col("ts").isNull()
    whole = keyed.filter(~lost)
    stored = F.struct("ts", "record_id", "etag", "last_modified", "headers")
    response = F.when(F.col("kind") == "response", stored)
    latest = F.when(F.col("kind") == "response", F.struct("ts", "record_id"))
    by_span = whole.groupBy("url_key", "span").agg(F.max_by(response, latest).alias("own"))
    earlier = Window.partitionBy("url_key").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carried = by_span.select("url_key", "span", F.last("own", ignorenulls=True).over(earlier).alias("carried"))
    inside = Window.partitionBy("url_key", "span").orderBy("ts", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    found = whole.withColumn("near", F.last(response, ignorenulls=True).over(inside)).filter(F.col("kind") == "revisit")
    joined = found.join(carried, ["url_key", "span"], "left").withColumn("full", F.coalesce("near", "carried"))
    gone = keyed.filter(lost & (F.col("kind") == "revisit")).withColumn("full", F.lit(None).cast(joined.schema["full"].dataType))
    joined = joined.select("record_id", "url_key", "etag", "last_modified", "headers", "full").unionByName(gone.select("record_id", "url_key", "etag", "last_modified", "headers", "full"))

    tag = lambda c: F.regexp_replace(c, r"^W/", "")
    by_tag = F.col("etag").isNotNull() & F.col("full.etag").isNotNull()
    by_date = F.col("last_modified").isNotNull() & F.col("full.last_modified").isNotNull()
    agrees = F.when(by_tag, tag(F.col("etag")) == tag(F.col("full.etag"))).when(by_date, F.col("full.last_modified") <= F.col("last_modified"))
    outcome = F.when(F.col("full").isNull(), "unresolved").when(agrees.isNull(), "unchecked").when(agrees, "resolved").otherwise("mismatch")
    updates = F.map_filter(F.coalesce("headers", F.create_map().cast("map<string,string>")), lambda k, v: k.isin(*PERMITTED) & v.isNotNull())
    base = F.map_filter(F.coalesce("full.headers", F.create_map().cast("map<string,string>")), lambda k, v: ~F.array_contains(F.map_keys("__updates"), k))
    joined = joined.withColumn("outcome", outcome).withColumn("__updates", updates)
    merged = F.when(F.col("outcome").isin("resolved", "unchecked"), F.map_concat(base, F.col("__updates")))
    return joined.select("record_id", "url_key", F.col("full.record_id").alias("refers_to"), "outcome", merged.alias("headers"))


def records_of_pages(pages: DataFrame) -> DataFrame:
    """Two records for each page: a full response at its turn, and a later revisit.

    Revisits come up to a third of the crawl later, write the URL another way,
    and carry an entity tag, a date, or, for one in seven, a tag of another
    version.
    """
    i = F.col("page_id").cast("long")
    taken = F.timestamp_seconds(F.lit(1_704_067_200) + i * 60)
    tag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"'))
    changed = F.timestamp_seconds(F.lit(1_672_531_200) + i * 7)
    plain = lambda t: F.date_format(t, "yyyy-MM-dd HH:mm:ss")
    full = pages.select(
        (i * 2).alias("record_id"),
        F.lit("response").alias("kind"),
        "url",
        taken.alias("ts"),
        tag.alias("etag"),
        changed.alias("last_modified"),
        F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), F.length(F.coalesce("html", F.lit(""))).cast("string"), F.lit("etag"), tag, F.lit("date"), plain(taken)).alias("headers"),
    )
    later = F.timestamp_seconds(F.lit(1_704_067_230) + i * 60 + 60 * F.pmod(i * 7919, F.lit(1009)))
    other = i % 7 == 3
    sent = F.when(other, F.concat(F.lit('"'), i.cast("string"), F.lit('"'))).when(i % 5 != 4, F.concat(F.lit("W/"), tag))
    again = pages.select(
        (i * 2 + 1).alias("record_id"),
        F.lit("revisit").alias("kind"),
        F.concat(F.regexp_replace("url", r"#.*$", ""), F.when(F.col("url").contains("?"), "&utm_source=again").otherwise("?utm_source=again"), F.lit("#seen")).alias("url"),
        later.alias("ts"),
        sent.alias("etag"),
        F.when(i % 5 == 4, later).alias("last_modified"),
        F.create_map(F.lit("date"), plain(later), F.lit("cache-control"), F.lit("max-age=60"), F.lit("content-length"), F.lit("0"), F.lit("connection"), F.lit("close")).alias("headers"),
    )
    return full.unionByName(again)


def digests(pages: DataFrame) -> DataFrame:
    """:func:`resolve` over :func:`records_of_pages`, with the merged headers as one string."""
    out = resolve(records_of_pages(pages))
    listed = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return out.withColumn("headers", F.coalesce(listed, F.lit("")))


SQL = r"""
    WITH p AS (SELECT CAST(page_id AS BIGINT) AS i, url, coalesce(html, '') AS html FROM pages),
    k AS (
        SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), '^www\.', ''), ':(80|443)$', '') AS host,
               regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
               array_to_string(list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)(=.*)?$'))), '&') AS query
        FROM (SELECT *, regexp_replace(regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', '') AS bare FROM p)),
    u AS (SELECT *, host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN query = '' THEN '' ELSE '?' || query END AS url_key,
                 1704067200 + i * 60 AS taken, 1704067230 + i * 60 + 60 * ((i * 7919) % 1009) AS later, '"' || md5(html) || '"' AS tag FROM k),
    m AS (
        SELECT v.i, v.url_key, v.later, v.tag, max(r.i) AS full_i
        FROM u v LEFT JOIN u r ON r.url_key = v.url_key AND r.taken <= v.later GROUP BY ALL),
    j AS (SELECT m.*, r.html AS full_html, r.tag AS full_tag, r.taken AS full_taken FROM m LEFT JOIN u r ON r.i = m.full_i),
    o AS (
        SELECT *, CASE WHEN full_i IS NULL THEN 'unresolved'
                       WHEN i % 7 = 3 THEN CASE WHEN '"' || i || '"' = full_tag THEN 'resolved' ELSE 'mismatch' END
                       WHEN i % 5 <> 4 THEN CASE WHEN tag = full_tag THEN 'resolved' ELSE 'mismatch' END
                       WHEN 1672531200 + full_i * 7 <= later THEN 'resolved' ELSE 'mismatch' END AS outcome FROM j)
    SELECT i * 2 + 1 AS record_id, url_key, full_i * 2 AS refers_to, outcome,
           CASE WHEN outcome IN ('resolved', 'unchecked')
                THEN 'cache-control=max-age=60;content-length=' || length(full_html) || ';content-type=text/html;date=' || strftime(make_timestamp(later * 1000000), '%Y-%m-%d %H:%M:%S') || ';etag=' || full_tag
                ELSE '' END AS headers
    FROM o
"""
