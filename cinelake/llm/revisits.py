"""WARC not-modified revisits: an as-of join to the latest earlier full response of the same canonical URL.

Captures: capture_id, url, kind ('response' or 'revisit'), status, ts (seconds), etag, last_modified, headers (map), payload_digest, payload_length.
A revisit resolves to the latest response with status 200 and a smaller ts (of several at one time, the greatest capture_id). Its validators are then checked: entity tags by weak comparison where
the revisit has one, else the modification dates; without either it is 'unchecked'. The merged headers are the response's, with those that a 304 may update taken from the revisit.

The join is in two levels, so that a URL with a third of all captures is spread by time: inside (URL, period) a window finds the latest
earlier response; for the others a second window runs over one row for each (URL, period).

A null url or ts resolves to nothing ('no_response'); a null header map counts as empty. Repeated rows are answered once each; extra columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of a period.
PERIOD = 3600
#: Header fields that a not-modified answer may update (fixed values, RFC 9110 and 9111).
PERMITTED = ["age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case and without ``www.``, no default port, no fragment, ``/`` for an empty path."""
    bare = F.regexp_replace(url, r"#.*$", "")
    host = F.lower(F.regexp_extract(bare, r"^[A-Za-z]+://([^/?]*)", 1))
    rest = F.regexp_extract(bare, r"^[A-Za-z]+://[^/?]*(.*)$", 1)
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"^www\.", "")
    return F.when(url.isNull(), None).otherwise(F.concat(host, F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))))


def resolve(captures: DataFrame, period: int = PERIOD) -> DataFrame:
    """One row for each revisit: capture_id, url_key, ts, response_id, resolution, payload_digest, payload_length, headers."""
    body = F.struct("ts", "capture_id", "etag", "last_modified", "payload_digest", "payload_length", F.map_entries("headers").alias("headers"))
    full = (F.col("kind") == "response") & (F.col("status") == 200)
    captures = captures.select("capture_id", "url", "kind", "status", "ts", "etag", "last_modified", "payload_digest", "payload_length", "headers")  # extra columns may have names used here
    rows = captures.withColumn("url_key", canonical_url(F.col("url"))).withColumn("period", F.floor(F.col("ts") / period)).withColumn("response", F.when(full, body))
    keyed = rows.where(F.col("url_key").isNotNull() & F.col("ts").isNotNull())
    near = Window.partitionBy("url_key", "period").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    inside = keyed.withColumn("near", F.max("response").over(near)).where(F.col("kind") == "revisit").drop("response")
    last = keyed.where(F.col("response").isNotNull()).groupBy("url_key", "period").agg(F.max("response").alias("last"))
    # Periods with revisits or responses: one row each.
    periods = last.unionByName(inside.select("url_key", "period").distinct().withColumn("last", F.lit(None).cast(last.schema["last"].dataType))).groupBy("url_key", "period").agg(F.max("last").alias("last"))
    before = Window.partitionBy("url_key").orderBy("period").rowsBetween(Window.unboundedPreceding, -1)
    earlier = periods.withColumn("earlier", F.last("last", ignorenulls=True).over(before)).select("url_key", "period", "earlier")
    found = inside.join(earlier, ["url_key", "period"], "left").withColumn("r", F.coalesce("near", "earlier"))
    rest = rows.where((F.col("kind") == "revisit") & (F.col("url_key").isNull() | F.col("ts").isNull()))
    found = found.unionByName(rest.drop("response"), allowMissingColumns=True)
    weak = lambda c: F.regexp_replace(c, "^W/", "")
    resolution = (
        F.when(F.col("r").isNull(), "no_response")
        .when(F.col("etag").isNotNull(), F.when(F.coalesce(weak(F.col("etag")) == weak(F.col("r.etag")), F.lit(False)), "matched").otherwise("mismatched"))
        .when(F.col("last_modified").isNotNull(), F.when(F.coalesce(F.col("last_modified") == F.col("r.last_modified"), F.lit(False)), "matched").otherwise("mismatched"))
        .otherwise("unchecked")
    )
    empty = F.create_map().cast("map<string,string>")
    own, stored = F.coalesce("headers", empty), F.coalesce(F.map_from_entries("r.headers"), empty)
    update = F.map_filter(own, lambda k, v: F.lower(k).isin(PERMITTED))
    names = F.transform(F.map_keys(update), lambda k: F.lower(k))
    merged = F.map_concat(F.map_filter(stored, lambda k, v: ~F.array_contains(names, F.lower(k))), update)
    good = F.col("resolution").isin("matched", "unchecked")
    out = found.withColumn("resolution", resolution)
    return out.select("capture_id", "url_key", "ts", F.col("r.capture_id").alias("response_id"), "resolution", F.when(good, F.col("r.payload_digest")).alias("payload_digest"), F.when(good, F.col("r.payload_length")).alias("payload_length"), F.when(good, merged).alias("headers"))


#: Captures derived from the table of pages, in SQL that Spark and DuckDB both run.
CAPTURES = """
SELECT page_id * 8 + k AS capture_id,
  CASE k WHEN 3 THEN concat(url, '#again') WHEN 4 THEN replace(url, 'https://', 'HTTPS://') ELSE url END AS url,
  CASE WHEN k < 2 THEN 'response' ELSE 'revisit' END AS kind,
  CASE WHEN k = 0 THEN 200 WHEN k = 1 THEN CASE WHEN page_id % 4 = 0 THEN 200 ELSE 500 END ELSE 304 END AS status,
  1700000000 + (page_id * 7919) % 864000 + CASE k WHEN 0 THEN 0 WHEN 1 THEN 60000 WHEN 2 THEN 40000 WHEN 3 THEN 60000 - (page_id % 3) * 70000 ELSE 90000 END AS ts,
  CASE WHEN page_id % 6 = 5 THEN NULL WHEN k = 4 THEN concat('W/', d) WHEN k = 1 OR (k = 3 AND page_id % 5 = 0) THEN concat(d, 'x') ELSE d END AS etag,
  CASE WHEN page_id % 12 = 11 THEN NULL ELSE concat('day ', CAST(page_id % 300 + CASE WHEN k = 1 THEN 1 ELSE 0 END AS VARCHAR(9))) END AS last_modified,
  CASE WHEN k = 0 THEN d WHEN k = 1 THEN concat(d, 'x') END AS payload_digest,
  CASE WHEN k < 2 THEN n END AS payload_length, k
FROM (SELECT page_id, url, d, n, {unnest} FROM (SELECT page_id, url, md5(html) AS d, CAST(length(html) AS BIGINT) AS n FROM pages) p) t
"""


def captures(pages: DataFrame) -> DataFrame:
    """Two responses and three revisits for each page, with headers."""
    rows = pages.sparkSession.sql(CAPTURES.format(unnest="explode(array(0, 1, 2, 3, 4)) AS k").replace("VARCHAR(9)", "STRING").replace("FROM pages", "FROM {pages}"), pages=pages)
    stored = F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), F.col("payload_length").cast("string"), F.lit("date"), F.col("ts").cast("string"), F.lit("cache-control"), F.lit("max-age=60"))
    sent = F.create_map(F.lit("date"), F.col("ts").cast("string"), F.lit("content-length"), F.lit("0"), F.lit("Expires"), (F.col("ts") + 60).cast("string"))
    return rows.withColumn("headers", F.when(F.col("k") < 2, stored).otherwise(sent)).drop("k")


def report(pages: DataFrame) -> DataFrame:
    found = resolve(captures(pages))
    return found.select("capture_id", "url_key", "ts", "response_id", "resolution", "payload_digest", "payload_length", F.size("headers").cast("long").alias("n_headers"), F.col("headers")["date"].alias("merged_date"), F.col("headers")["content-length"].alias("merged_length"))


SQL = (
    "WITH c AS ("
    + CAPTURES.format(unnest="unnest([0, 1, 2, 3, 4]) AS k")
    + r"""),
keyed AS (SELECT *, regexp_replace(url, '#.*$', '') AS bare FROM c),
urls AS (
  SELECT *, concat(regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[A-Za-z]+://([^/?]*)', 1)), ':(80|443)$', ''), '^www\.', ''),
    CASE WHEN starts_with(regexp_extract(bare, '^[A-Za-z]+://[^/?]*(.*)$', 1), '/') THEN '' ELSE '/' END, regexp_extract(bare, '^[A-Za-z]+://[^/?]*(.*)$', 1)) AS url_key FROM keyed),
best AS (
  SELECT v.capture_id, arg_max(r.capture_id, (r.ts, r.capture_id)) AS response_id
  FROM urls v JOIN urls r ON v.url_key = r.url_key AND r.kind = 'response' AND r.status = 200 AND r.ts < v.ts WHERE v.kind = 'revisit' GROUP BY 1),
j AS (
  SELECT v.capture_id, v.url_key, v.ts, r.capture_id AS response_id, r.payload_digest, r.payload_length,
    CASE WHEN r.capture_id IS NULL THEN 'no_response'
      WHEN v.etag IS NOT NULL THEN CASE WHEN coalesce(regexp_replace(v.etag, '^W/', '') = regexp_replace(r.etag, '^W/', ''), false) THEN 'matched' ELSE 'mismatched' END
      WHEN v.last_modified IS NOT NULL THEN CASE WHEN coalesce(v.last_modified = r.last_modified, false) THEN 'matched' ELSE 'mismatched' END
      ELSE 'unchecked' END AS resolution
  FROM urls v LEFT JOIN best USING (capture_id) LEFT JOIN urls r ON r.capture_id = best.response_id WHERE v.kind = 'revisit')
SELECT capture_id, url_key, ts, response_id, resolution, CASE WHEN good THEN payload_digest END AS payload_digest, CASE WHEN good THEN payload_length END AS payload_length,
  CASE WHEN good THEN CAST(5 AS BIGINT) END AS n_headers, CASE WHEN good THEN CAST(ts AS VARCHAR) END AS merged_date, CASE WHEN good THEN CAST(payload_length AS VARCHAR) END AS merged_length
FROM (SELECT *, resolution IN ('matched', 'unchecked') AS good FROM j) z
"""
)
