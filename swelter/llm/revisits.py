"""Not-modified revisits of web captures, resolved to the response whose body they stand for.

Every revisit looks for the latest earlier full response of its canonical URL. Captures are
looked at in blocks of an hour: a window finds the response inside the block, and the last
response of earlier blocks enters each block as one more row. So a URL with a large share of
all captures is many small windows. Bodies never move: the result refers to records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swelter.llm.common import pick

BLOCK_SECONDS = 3600
#: Headers of a 304 answer that never replace those of the stored response (connection and body framing).
NOT_UPDATED = (
    "connection", "content-encoding", "content-length", "content-range", "keep-alive", "proxy-authenticate",
    "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade",
)
#: Parameters that only track where a visitor comes from.
TRACKING = r"^(utm_[^=]*|fbclid|gclid)(=|$)"

COLUMNS = ("record_id", "url", "at", "kind", "headers")


def canonical_url(url: Column) -> Column:
    """Host, path and sorted parameters: without scheme, fragment, www., default port, tracking and closing slashes."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), r"^www\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), "/+$", "")
    asked = F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING))
    query = F.array_join(F.array_sort(asked), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def _etag(headers: Column) -> Column:
    return F.regexp_replace(headers["etag"], "^W/", "")


def resolve_revisits(captures: DataFrame) -> DataFrame:
    """Every revisit with the record it refers to and its merged headers.

    ``captures``: record_id, url, at (whole seconds), kind ('response' or 'revisit'), headers
    (a map with lower-case names). Result, one row per revisit: record_id, canonical, at,
    outcome, refers_to, headers.

    outcome: 'resolved'; 'no url' for a NULL url; 'no response' when no full response of the
    URL is earlier; 'no validator' when the revisit names neither etag nor last-modified;
    'mismatch' when the etag (compared weakly), or without one last-modified, is not that of
    the response. Of responses in one second the larger record_id is the later. Unresolved
    revisits keep their own headers and refer to NULL. Responses without a record_id or a
    time are never referred to, revisits without a time have no response. Repeated rows are
    resolved each; other columns are ignored; an empty table gives an empty result.
    """
    own = pick(captures, *COLUMNS).withColumn("canonical", canonical_url(F.col("url")))
    own = own.withColumn("headers", F.coalesce("headers", F.create_map().cast("map<string,string>")))
    place = F.floor(F.col("at") / BLOCK_SECONDS)
    full = own.where("kind = 'response' and canonical is not null and record_id is not null and at is not null")
    known = F.struct("at", "record_id", _etag(F.col("headers")).alias("etag"), F.col("headers")["last-modified"].alias("modified"))
    full = full.withColumn("block", place).withColumn("response", known)
    asked = own.where("kind = 'revisit'").withColumn("block", place)
    open_ = asked.where("canonical is not null and at is not null")
    last = full.groupBy("canonical", "block").agg(F.max("response").alias("response"))
    # one row per URL and hour: carry each block's last response to the next block that has captures
    blocks = last.unionByName(open_.select("canonical", "block", F.lit(None).cast(last.schema["response"].dataType).alias("response")).distinct())
    blocks = blocks.groupBy("canonical", "block").agg(F.max("response").alias("response"))
    earlier = Window.partitionBy("canonical").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.withColumn("response", F.max("response").over(earlier)).where("response is not null")
    rows = (
        full.select("canonical", "block", "at", "response", F.lit(None).cast("struct<id:bigint,headers:map<string,string>>").alias("ask"))
        .unionByName(carried.select("canonical", "block", (F.col("block") * BLOCK_SECONDS - 1).alias("at"), "response", F.lit(None).cast("struct<id:bigint,headers:map<string,string>>").alias("ask")))
        .unionByName(open_.select("canonical", "block", "at", F.lit(None).cast(last.schema["response"].dataType).alias("response"), F.struct(F.col("record_id").alias("id"), "headers").alias("ask")))
    )
    before = Window.partitionBy("canonical", "block").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    found = rows.withColumn("response", F.max("response").over(before)).where("ask is not null")
    found = found.select(F.col("ask.id").alias("record_id"), "canonical", "at", F.col("ask.headers").alias("headers"), "response")
    lost = asked.where("canonical is null or at is null").select("record_id", "canonical", "at", "headers", F.lit(None).cast(last.schema["response"].dataType).alias("response"))
    found = found.unionByName(lost)
    tag, modified = _etag(F.col("headers")), F.col("headers")["last-modified"]
    outcome = (
        F.when(F.col("canonical").isNull(), "no url")
        .when(F.col("response").isNull(), "no response")
        .when(tag.isNull() & modified.isNull(), "no validator")
        .when(F.when(tag.isNotNull(), tag == F.col("response.etag")).otherwise(modified == F.col("response.modified")), "resolved")
        .otherwise("mismatch")
    )
    found = found.withColumn("outcome", outcome).withColumn("refers_to", F.when(F.col("outcome") == "resolved", F.col("response.record_id")))
    stored = full.select(F.col("record_id").alias("refers_to"), F.col("headers").alias("stored")).dropDuplicates(["refers_to"])
    # rows that refer to nothing would all meet at one key
    found = found.where("refers_to is not null").join(stored, "refers_to").unionByName(
        found.where("refers_to is null").withColumn("stored", F.lit(None).cast("map<string,string>"))
    )
    update = F.map_filter("headers", lambda k, _: ~k.isin(*NOT_UPDATED))
    rest = F.map_filter("stored", lambda k, _: ~F.array_contains(F.map_keys(update), k))
    merged = F.when(F.col("outcome") == "resolved", F.map_concat(rest, update)).otherwise(F.col("headers"))
    return found.select("record_id", "canonical", "at", "outcome", "refers_to", merged.alias("headers"))


def captures_of(pages: DataFrame) -> DataFrame:
    """Captures derived from crawled pages: each page a full response, followed by two revisits.

    The first revisit asks with a weak etag. The second, of another spelling of the URL, asks
    with the date, or for every fifth page with nothing, or for every seventh with a foreign
    etag. Only digest and length of the body are used.
    """
    own = pick(pages, "page_id", "url", "html").withColumn("html", F.coalesce("html", F.lit("")))
    own = own.select("page_id", "url", F.md5("html").alias("digest"), F.octet_length("html").alias("size"), F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("k"))
    at = F.lit(1_700_000_000) + F.col("page_id") * 60 + F.element_at(F.array(F.lit(0), F.lit(18_000), F.lit(108_000)), F.col("k") + 1)
    etag = F.concat(F.lit('"'), F.substring("digest", 1, 16), F.lit('"'))
    modified = F.concat(F.lit("t"), (F.lit(1_700_000_000) + F.col("page_id") * 60).cast("string"))
    none = F.lit(None).cast("string")
    own_tag = F.when(F.col("k") == 0, etag).when(F.col("k") == 1, F.concat(F.lit("W/"), etag)).when(F.col("page_id") % 7 == 0, F.lit('"other"'))
    own_date = F.when((F.col("k") == 0) | ((F.col("k") == 2) & (F.col("page_id") % 5 != 0)), modified)
    headers = {
        "etag": own_tag, "last-modified": own_date, "date": F.concat(F.lit("t"), F.col("at").cast("string")),
        "cache-control": F.concat(F.lit("max-age="), (F.col("k") * 60).cast("string")),
        "content-length": F.when(F.col("k") == 0, F.col("size").cast("string")).otherwise("0"),
        "content-type": F.when(F.col("k") == 0, F.lit("text/html")).otherwise(none),
    }
    pairs = F.create_map(*[x for name, value in headers.items() for x in (F.lit(name), value)])
    url = F.when(F.col("k") == 2, F.concat(F.regexp_replace("url", "#.*$", ""), F.when(F.col("url").contains("?"), "&").otherwise("?"), F.lit("utm_id=1#x"))).otherwise(F.col("url"))
    return own.withColumn("at", at).select(
        (F.col("page_id") * 4 + F.col("k")).alias("record_id"), url.alias("url"), "at",
        F.when(F.col("k") == 0, "response").otherwise("revisit").alias("kind"),
        F.map_filter(pairs, lambda _, v: v.isNotNull()).alias("headers"),
    )


def header_lines(headers: Column) -> Column:
    """Headers as text, one per line, by name."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")


_ASKED = "list_filter(string_split(regexp_extract(bare, '\\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|fbclid|gclid)(=|$)'))"

SQL = f"""
WITH k AS (
  SELECT page_id, url, md5(coalesce(html, '')) AS digest, strlen(coalesce(html, '')) AS size, unnest([0, 1, 2]) AS k FROM pages),
c0 AS (
  SELECT page_id * 4 + k AS record_id, k, page_id, size,
         CASE WHEN k = 2 THEN regexp_replace(url, '#.*$', '') || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'utm_id=1#x' ELSE url END AS url,
         1700000000 + page_id * 60 + [0, 18000, 108000][k + 1] AS at_,
         CASE WHEN k < 2 THEN '"' || substr(digest, 1, 16) || '"' WHEN page_id % 7 = 0 THEN '"other"' END AS tag,
         CASE WHEN k = 0 OR (k = 2 AND page_id % 5 <> 0) THEN 't' || (1700000000 + page_id * 60) END AS modified
  FROM k),
c1 AS (SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://', '') AS bare FROM c0),
c AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[^/?]*')), '^www\\.', ''), ':(80|443)$', '')
         || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '')
         || CASE WHEN len({_ASKED}) > 0 THEN '?' || array_to_string(list_sort({_ASKED}), '&') ELSE '' END AS canonical
  FROM c1),
f AS (
  SELECT q.*, r.record_id AS r_id, r.tag AS r_tag, r.modified AS r_modified, r.size AS r_size,
         row_number() OVER (PARTITION BY q.record_id ORDER BY r.at_ DESC NULLS LAST, r.record_id DESC) AS place
  FROM c q LEFT JOIN c r ON r.canonical = q.canonical AND r.k = 0 AND r.at_ < q.at_
  WHERE q.k > 0),
o AS (
  SELECT *, CASE WHEN canonical IS NULL THEN 'no url' WHEN r_id IS NULL THEN 'no response'
                 WHEN tag IS NULL AND modified IS NULL THEN 'no validator'
                 WHEN CASE WHEN tag IS NOT NULL THEN tag = r_tag ELSE modified = r_modified END THEN 'resolved'
                 ELSE 'mismatch' END AS outcome
  FROM f WHERE place = 1)
SELECT record_id, canonical, at_ AS captured_at, outcome, CASE WHEN outcome = 'resolved' THEN r_id END AS refers_to,
       array_to_string([
         'cache-control: max-age=' || (k * 60)::VARCHAR,
         'content-length: ' || CASE WHEN outcome = 'resolved' THEN r_size ELSE 0 END::VARCHAR,
         CASE WHEN outcome = 'resolved' THEN 'content-type: text/html' END,
         'date: t' || at_::VARCHAR,
         'etag: ' || CASE WHEN tag IS NOT NULL AND k = 1 THEN 'W/' || tag WHEN tag IS NOT NULL THEN tag WHEN outcome = 'resolved' THEN r_tag END,
         'last-modified: ' || CASE WHEN modified IS NOT NULL THEN modified WHEN outcome = 'resolved' THEN r_modified END], chr(10)) AS headers
FROM o
"""
