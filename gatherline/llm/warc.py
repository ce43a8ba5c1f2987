"""WARC revisits: not-modified records get the payload and headers of the response that they confirm."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatherline.llm.shared import held_back, written

#: The headers that a 304 response may carry to update a stored one (RFC 9110, 15.4.5).
MERGED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: A URL's captures are ordered within spans of this length; only each span's last response goes on to the next.
SPAN_SECONDS = 6 * 3600


def canonical_url(url: Column) -> Column:
    """Without scheme, ``www.``, default port and fragment; host in lower case; an empty path is ``/``."""
    bare = F.regexp_replace(url, r"#[\s\S]*$", "")
    rest = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, r"^[^/?]*", 0)), r"^www\d*\.|:(80|443)$", "")
    path = F.regexp_extract(rest, r"^[^/?]*([\s\S]*)$", 1)
    return F.concat(host, F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path)))


def header(headers: str | Column, name: str) -> Column:
    """A header by its name in lower case; of repeated ones, which differ in case alone, the last."""
    return F.try_element_at(lowered(F.col(headers) if isinstance(headers, str) else headers), F.lit(name))


def lowered(headers: Column) -> Column:
    entries = F.map_entries(headers)
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))
    value = lambda n: F.element_at(F.filter(entries, lambda e: F.lower(e["key"]) == n), -1)["value"]
    return F.map_from_arrays(names, F.transform(names, value))


def strong(tag: Column) -> Column:
    """An entity tag for weak comparison."""
    return F.regexp_replace(F.trim(tag), "^W/", "")


def as_of_response(records: DataFrame, span_seconds: int = SPAN_SECONDS) -> DataFrame:
    """``record_id, url_key, at, base_id, base_at`` of every revisit: the latest full response of its URL before it, or null.

    ``records(record_id, url_key, at, full, revisit)``. Before: an earlier time, or the same and a smaller id. Revisits
    that repeat id, URL and time have one row. Time is
    cut into spans; the last response of each span is carried over the spans of a URL, and windows sort single
    spans, so a URL with a third of all captures is spread over many tasks.
    """
    rows = records.select("record_id", "url_key", "at", "full", "revisit").withColumn("span", F.floor(F.unix_micros("at") / (span_seconds * 1_000_000)))
    here = F.when(F.col("full"), F.struct("at", "record_id"))
    ends = rows.groupBy("url_key", "span").agg(F.max(here).alias("last"), F.max("revisit").alias("asked"))
    carried = F.max("last").over(Window.partitionBy("url_key").orderBy("span").rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.withColumn("before", carried).where("asked").select("url_key", "span", "before")
    inside = F.max(here).over(Window.partitionBy("url_key", "span").orderBy("at", "record_id", F.col("revisit").desc()).rowsBetween(Window.unboundedPreceding, -1))
    found = rows.withColumn("inside", inside).where("revisit").join(ends, ["url_key", "span"], "left")
    base = F.coalesce("inside", "before")
    return found.groupBy("url_key", "at", "record_id").agg(F.min(base).alias("b")).select("record_id", "url_key", "at", F.col("b.record_id").alias("base_id"), F.col("b.at").alias("base_at"))


def resolved(records: DataFrame, span_seconds: int = SPAN_SECONDS) -> DataFrame:
    """All records with ``outcome``, ``base_id``, and for resolved revisits the base's payload and merged headers.

    ``records(record_id, uri, at TIMESTAMP, kind, status, headers MAP<STRING,STRING>, payload)``; ``kind`` is
    ``response`` or ``revisit``; a full response has status 200. Outcomes of revisits: ``resolved``;
    ``mismatch`` (entity tags differ, or, where a side has none, the Last-Modified differ); ``unverified`` (no
    validator on both sides); ``missing`` (no earlier full response, or no URL or time). Only resolved revisits take
    over a payload; their headers are the base's, in lower case, updated by those that a 304 may carry. Other records
    keep all they have, outcome ``kept``. Null headers count as none. Each record gives one row, repeated ones too;
    responses that repeat id, URL and time are one base, that of the largest payload digest. An empty table gives no rows. Payloads of any length move whole, and
    only those that some revisit asks for, nearly.
    """
    none = F.from_json(F.lit("{}"), "map<string,string>")
    rows = records.select("record_id", "uri", "at", "kind", "status", F.coalesce("headers", none).alias("headers"), "payload", canonical_url(F.col("uri")).alias("url_key"))
    revisit = F.coalesce(F.col("kind") == "revisit", F.lit(False))
    full = F.coalesce((F.col("kind") == "response") & (F.col("status") == 200), F.lit(False))
    timed = rows.where("url_key IS NOT NULL AND at IS NOT NULL AND record_id IS NOT NULL")
    base_of = as_of_response(timed.select("record_id", "url_key", "at", full.alias("full"), revisit.alias("revisit")), span_seconds)
    base_of = written(base_of, "warc-bases")
    bases = held_back(rows.where(full), F.col("record_id"), base_of.where("base_id IS NOT NULL"), F.col("base_id"))
    same = ["base_id", "url_key", "base_at"]
    digest = F.struct(F.coalesce(F.sha2("payload", 256), F.lit("")), F.array_sort(F.map_entries("headers")))
    bases = bases.groupBy(F.col("record_id").alias("base_id"), "url_key", F.col("at").alias("base_at")).agg(F.max_by(F.struct("headers", "payload"), digest).alias("_b"))
    bases = bases.select(*same, F.col("_b.headers").alias("base_headers"), F.col("_b.payload").alias("base_payload"))
    asked = rows.where(revisit).drop("payload").join(base_of, ["record_id", "url_key", "at"], "left").join(bases, same, "left")
    tags = [strong(header(h, "etag")) for h in ("headers", "base_headers")]
    times = [header(h, "last-modified") for h in ("headers", "base_headers")]
    outcome = (
        F.when(F.col("base_headers").isNull(), "missing")
        .when(tags[0].isNotNull() & tags[1].isNotNull(), F.when(tags[0] == tags[1], "resolved").otherwise("mismatch"))
        .when(times[0].isNotNull() & times[1].isNotNull(), F.when(times[0] == times[1], "resolved").otherwise("mismatch"))
        .otherwise("unverified")
    )
    fresh = F.map_filter(lowered(F.col("headers")), lambda k, v: k.isin(*MERGED))
    kept = F.map_filter(lowered(F.col("base_headers")), lambda k, v: ~F.map_contains_key(F.col("fresh"), k))
    done = F.col("outcome") == "resolved"
    asked = asked.withColumn("outcome", outcome).withColumn("fresh", fresh)
    names = ["record_id", "uri", "url_key", "at", "kind", "status"]
    asked = asked.select(*names, F.when(done, F.map_concat(kept, "fresh")).otherwise(F.col("headers")).alias("headers"), F.when(done, F.col("base_payload")).alias("payload"), "outcome", "base_id")
    rest = rows.where(~revisit).select(*names, "headers", "payload", F.lit("kept").alias("outcome"), F.lit(None).cast(asked.schema["base_id"].dataType).alias("base_id"))
    return asked.unionByName(rest)


def captures(pages: DataFrame) -> DataFrame:
    """``pages`` as captures of their sites' sections, one a minute: each third is a not-modified revisit.

    Section: the URL up to its second path segment. The site's pages change every 500 minutes, with their entity tag.
    """
    page = F.col("page_id")
    tag = F.concat(F.lit('"v'), F.floor(page / 500).cast("string"), F.lit('"'))
    revisit = page % 3 == 2
    lines = F.map_from_arrays(
        F.array(*map(F.lit, ("ETag", "Date", "Content-Type", "Content-Length", "Cache-Control"))),
        F.array(F.when(revisit, F.concat(F.lit("W/"), tag)).otherwise(tag), page.cast("string"), F.when(revisit, "none").otherwise("text/html"), F.coalesce(F.length("html"), F.lit(0)).cast("string"), F.when(revisit, "max-age=60").otherwise("max-age=5")),
    )
    at = F.timestamp_seconds(1_704_067_200 + page * 60)
    return pages.select(page.alias("record_id"), F.regexp_extract("url", r"^[^/?#]*//[^/?#]*(?:/[^/?#]*)?", 0).alias("uri"), at.alias("at"), F.when(revisit, "revisit").otherwise("response").alias("kind"), F.when(revisit, 304).otherwise(200).alias("status"), lines.alias("headers"), F.when(~revisit, F.col("html")).alias("payload"))


def digests(records: DataFrame) -> DataFrame:
    lines = F.array_join(F.transform(F.array_sort(F.map_entries(lowered(F.col("headers")))), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    return records.select("record_id", "url_key", "outcome", "base_id", lines.alias("header_lines"), F.sha2("payload", 256).alias("payload_sha256"))


ORACLE = """
WITH c AS (
  SELECT page_id AS record_id, html, page_id % 3 = 2 AS revisit, '"v' || (page_id // 500) || '"' AS tag,
         regexp_extract(url, '^[^/?#]*//[^/?#]*(?:/[^/?#]*)?') AS uri FROM pages),
k AS (
  SELECT *, regexp_replace(lower(regexp_extract(regexp_replace(uri, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '^[^/?]*')), '^www\\d*\\.|:(80|443)$', '', 'g') AS host,
         regexp_extract(regexp_replace(uri, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '^[^/?]*(.*)$', 1) AS path FROM c),
u AS (SELECT *, host || CASE WHEN starts_with(path, '/') THEN path ELSE '/' || path END AS url_key FROM k),
b AS (
  SELECT *, max(CASE WHEN NOT revisit THEN record_id END) OVER (PARTITION BY url_key ORDER BY record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS base FROM u),
j AS (
  SELECT b.*, p.html AS base_html, CASE WHEN NOT revisit THEN 'kept' WHEN base IS NULL THEN 'missing' WHEN b.tag = '"v' || (base // 500) || '"' THEN 'resolved' ELSE 'mismatch' END AS outcome
  FROM b LEFT JOIN pages p ON p.page_id = base)
SELECT record_id, url_key, outcome, CASE WHEN revisit THEN base END AS base_id,
       concat_ws(chr(10), 'cache-control: ' || CASE WHEN revisit THEN 'max-age=60' ELSE 'max-age=5' END,
         'content-length: ' || CASE WHEN outcome = 'resolved' THEN length(base_html) ELSE length(html) END,
         'content-type: ' || CASE WHEN outcome = 'resolved' OR NOT revisit THEN 'text/html' ELSE 'none' END,
         'date: ' || record_id, 'etag: ' || CASE WHEN revisit THEN 'W/' ELSE '' END || tag) AS header_lines,
       CASE WHEN outcome = 'resolved' THEN sha256(base_html) WHEN outcome = 'kept' THEN sha256(html) END AS payload_sha256
FROM j
"""
