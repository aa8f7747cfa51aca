"""WARC revisit records: a server's "not modified" answers, resolved to the responses they stand for.

A revisit without content refers to the latest earlier full response of its canonical URL. It's resolved where its
validators agree with that response's; permitted headers of the revisit then replace the response's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.shared import park

#: Headers that a 304 answer may renew. Fixed values.
RENEWED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")


def canonical(url: Column) -> Column:
    """Lower-case scheme and host without user, default port, leading www. and final dot; no fragment; an empty path is /;
    the query's parts in order, without those that only track. Null and what isn't a URL: as it is, null counting as empty."""
    u = F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), "#.*$", "")
    pattern = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/@?]*@)?([^/:?]*)(?::([0-9]*))?([^?]*)(?:\?(.*))?$"
    scheme, name, port, path, query = (F.regexp_extract(u, pattern, k) for k in range(1, 6))
    scheme = F.lower(scheme)
    name = F.regexp_replace(F.lower(name), r"^www\.|\.$", "")
    default = (port == "") | (scheme == "http") & (port == "80") | (scheme == "https") & (port == "443")
    parts = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^(utm_[a-z]+|ref|fbclid|gclid|sessionid)(=|$)")))
    rest = F.when(F.size(parts) > 0, F.concat(F.lit("?"), F.array_join(parts, "&"))).otherwise(F.lit(""))
    whole = F.concat(scheme, F.lit("://"), name, F.when(default, "").otherwise(F.concat(F.lit(":"), port)), F.when(path == "", "/").otherwise(path), rest)
    return F.when(u.rlike(pattern), whole).otherwise(u)


def renewed(old: Column, new: Column) -> Column:
    """The response's headers with the revisit's permitted ones in their place; names in lower case."""
    low = lambda m: F.transform_keys(F.coalesce(m, F.create_map().cast("map<string,string>")), lambda k, v: F.lower(k))
    permitted = F.map_filter(low(new), lambda k, v: k.isin(*RENEWED) & v.isNotNull())
    return F.map_concat(F.map_filter(low(old), lambda k, v: ~F.map_contains_key(permitted, k)), permitted)


def slices(key: list[str], records: DataFrame) -> DataFrame:
    """records with `slice`: partitions of equal size in order of key, time and record_id. A URL with more records than fit one
    stands in several, cut by rank, however its times are spread; the numbers are in its records' order."""
    found, _ = park(records.repartitionByRange(*key, "time", "record_id").withColumn("slice", F.spark_partition_id()), "slices")
    return found


def _latest(key: list[str], records: DataFrame) -> DataFrame:
    """records with `found`: the latest response before each in (time, record_id), by key and over all slices."""
    order = [F.col("time"), F.col("record_id")]
    full = F.when(F.col("kind") == "response", F.struct("time", "record_id", "etag", "last_modified", "headers"))
    sliced = slices(key, records)
    before = Window.partitionBy(*key, "slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = sliced.withColumn("within", F.last(full, ignorenulls=True).over(before))
    # Of every slice the last response; one row each, so that the window over a URL's slices is small.
    last = sliced.where("kind = 'response'").groupBy(*key, "slice").agg(F.max(F.struct("time", "record_id")).alias("top"))
    every = sliced.select(*key, "slice").distinct().join(last, [*key, "slice"], "left")
    over = Window.partitionBy(*key).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    ahead = every.withColumn("ahead", F.last("top", ignorenulls=True).over(over)).drop("top")
    ahead = ahead.where(F.col("ahead").isNotNull())
    heads = sliced.where("kind = 'response'").select(*key, F.struct("time", "record_id").alias("ahead"), full.alias("head")).dropDuplicates([*key, "ahead"])
    ahead = ahead.join(heads, [*key, "ahead"]).drop("ahead")
    return within.join(ahead, [*key, "slice"], "left").withColumn("found", F.coalesce("within", "head")).drop("within", "head", "slice")


def resolve(records: DataFrame) -> DataFrame:
    """Every revisit of records (record_id, kind 'response' or 'revisit', url, time as a number, etag, last_modified,
    headers as a map) with canonical_url, refers_to, status and headers.

    status: `resolved` where the latest earlier response of the URL has an equal etag (weak marks aside) or, where either
    has none, an equal last_modified; `changed` where validators differ; `unchecked` where there's nothing to compare;
    `missing` where no response comes before. refers_to is that response, whatever the status; headers are merged where it is
    resolved, and else the permitted ones of the revisit. A null time comes before all others; records of one time go by record_id; of
    responses equal in both any one; repeated revisits stay; an empty table gives an empty one. Other columns are left out.
    """
    plain = records.select("record_id", "kind", canonical(F.col("url")).alias("canonical_url"), F.coalesce("time", F.lit(-(2**62))).cast("long").alias("time"), "etag", "last_modified", "headers")
    found = _latest(["canonical_url"], plain).where("kind = 'revisit'")
    tag = lambda c: F.regexp_replace(c, "^W/", "")
    by_tag, by_time = F.col("etag").isNotNull() & F.col("found.etag").isNotNull(), F.col("last_modified").isNotNull() & F.col("found.last_modified").isNotNull()
    same = F.when(by_tag, tag(F.col("etag")) == tag(F.col("found.etag"))).when(by_time, F.col("last_modified") == F.col("found.last_modified"))
    status = F.when(F.col("found").isNull(), "missing").when(same, "resolved").when(~same, "changed").otherwise("unchecked")
    done = found.withColumn("status", status)
    return done.select("record_id", "canonical_url", "time", F.col("found.record_id").alias("refers_to"), "status", F.when(F.col("status") == "resolved", renewed(F.col("found.headers"), F.col("headers"))).otherwise(renewed(F.lit(None).cast("map<string,string>"), F.col("headers"))).alias("headers"))


def captures(pages: DataFrame) -> DataFrame:
    """Two records of each page: the response at time 2 * page_id, and a later revisit, 2 * (page_id + 5000) + 1, that offers
    the page's own validators. In between, other pages of the same canonical URL may have come: then the revisit has changed.
    A null page_id has a null time."""
    etag, day = F.md5(F.coalesce("html", F.lit("")).cast("binary")), F.concat(F.lit("day "), (F.col("page_id") % 365).cast("string"))
    record = lambda kind, i, time, headers: F.struct(i.alias("record_id"), F.lit(kind).alias("kind"), time.alias("time"), headers.alias("headers"))
    length = F.length(F.coalesce("html", F.lit(""))).cast("string")
    response = record("response", F.col("page_id") * 2, F.col("page_id") * 2, F.create_map(F.lit("Content-Length"), length, F.lit("ETag"), etag, F.lit("Date"), day))
    revisit = record("revisit", F.col("page_id") * 2 + 1, F.col("page_id") * 2 + 10001, F.create_map(F.lit("Content-Length"), F.lit("0"), F.lit("Date"), F.concat(day, F.lit(" later")), F.lit("Server"), F.lit("cache")))
    one = pages.select("url", etag.alias("etag"), F.lit(None).cast("string").alias("last_modified"), F.explode(F.array(response, revisit)).alias("r"))
    return one.select("r.record_id", "r.kind", "url", "r.time", "etag", "last_modified", "r.headers")


SQL = r"""
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS html, regexp_replace(trim(coalesce(url, '')), '#.*$', '') AS u FROM pages),
q AS (
  SELECT *, '^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/@?]*@)?([^/:?]*)(?::([0-9]*))?([^?]*)(?:\?(.*))?$' AS re FROM p),
parts AS (
  SELECT *, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/@?]*@)?([^/:?]*)(?::([0-9]*))?([^?]*)(?:\?(.*))?$', 1)) AS scheme,
    regexp_replace(lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/@?]*@)?([^/:?]*)(?::([0-9]*))?([^?]*)(?:\?(.*))?$', 2)), '^www\.|\.$', '', 'g') AS name,
    regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/@?]*@)?([^/:?]*)(?::([0-9]*))?([^?]*)(?:\?(.*))?$', 3) AS port,
    regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/@?]*@)?([^/:?]*)(?::([0-9]*))?([^?]*)(?:\?(.*))?$', 4) AS path,
    list_sort(list_filter(string_split(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/@?]*@)?([^/:?]*)(?::([0-9]*))?([^?]*)(?:\?(.*))?$', 5), '&'),
      lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid|sessionid)(=|$)'))) AS query
  FROM q),
c AS (
  SELECT page_id, md5(html) AS etag, length(html) AS size, CASE WHEN regexp_matches(u, re) THEN
    scheme || '://' || name || CASE WHEN port = '' OR scheme = 'http' AND port = '80' OR scheme = 'https' AND port = '443' THEN '' ELSE ':' || port END
    || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(query) > 0 THEN '?' || array_to_string(query, '&') ELSE '' END ELSE u END AS canonical_url
  FROM parts),
r AS (SELECT 2 * page_id AS record_id, 2 * page_id AS time, canonical_url, etag, size, page_id, true AS whole FROM c
  UNION ALL SELECT 2 * page_id + 1, 2 * page_id + 10001, canonical_url, etag, size, page_id, false FROM c),
w AS (
  SELECT *, last_value(CASE WHEN whole THEN {'id': record_id, 'etag': etag, 'size': size, 'page_id': page_id} END IGNORE NULLS) OVER (PARTITION BY canonical_url ORDER BY time, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS f FROM r)
SELECT record_id, canonical_url, time, f.id AS refers_to,
  CASE WHEN f IS NULL THEN 'missing' WHEN f.etag = etag THEN 'resolved' ELSE 'changed' END AS status,
  CASE WHEN f.etag = etag THEN 'content-length=' || f.size || ';date=day ' || page_id % 365 || ' later;etag=' || f.etag
    ELSE 'date=day ' || page_id % 365 || ' later' END AS headers
FROM w WHERE NOT whole
"""
