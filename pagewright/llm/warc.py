"""Resolution of not-modified revisits in web archives.

A revisit record says that a page had not changed; its body is that of an earlier response. Each revisit is joined as of its
time to the latest earlier full response with the same canonical URL. If the validators agree, it takes that response's
payload and headers, updated by those headers that a not-modified answer may change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.llm.common import table

#: Headers by which a not-modified answer updates the stored ones (RFC 9110, 15.4.5).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: Query parameters that do not change what a URL shows.
TRACKING = r"(?:utm_[a-z]+|ref)=[^&]*"
#: Seconds of a URL's time line that one window orders.
BUCKET = 4096


def canonical(url: Column) -> Column:
    """Scheme and host in lower case, default port, fragment, tracking parameters, and a bare trailing ``?`` or ``/`` removed; null stays null."""
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    host = F.regexp_extract(bare, r"^([^:/?#]+://[^/?#]*)", 1)
    rest = F.substr(bare, F.char_length(host) + 1)
    host = F.regexp_replace(F.regexp_replace(F.lower(host), r"^(http://[^/]*):80$", "$1"), r"^(https://[^/]*):443$", "$1")
    query = F.regexp_replace(rest, r"([?&])(?:" + TRACKING + r"&?)+", "$1")
    return F.concat(host, F.regexp_replace(query, r"/?[?&]*$", ""))


def _as_of(records: DataFrame, bucket: int) -> DataFrame:
    """records with ``_found``, the latest earlier full response of the same canonical URL.

    A URL's time line is cut into buckets: windows order the records of one bucket, and the last response of each bucket is
    carried over to the later ones, of which a URL has few. So no URL's records are ever ordered in one task.
    """
    full = F.when((F.col("kind") == "response") & (F.col("status") == 200), F.struct("record_id", "etag", "last_modified", "headers", "at"))
    placed = records.withColumn("_bucket", F.floor(F.col("at") / bucket)).withColumn("_full", full)
    # At the same time the record with the lesser id is the earlier one.
    inside = Window.partitionBy("canonical_url", "_bucket").orderBy("at", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    near = placed.withColumn("_near", F.last("_full", ignorenulls=True).over(inside))
    ends = placed.groupBy("canonical_url", "_bucket").agg(F.max_by("_full", F.when(F.col("_full").isNotNull(), F.struct("at", "record_id"))).alias("_end"))
    before = Window.partitionBy("canonical_url").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("_carried", F.last("_end", ignorenulls=True).over(before)).drop("_end")
    revisits = near.filter(F.col("kind") == "revisit")
    return revisits.join(carried, ["canonical_url", "_bucket"], "left").withColumn("_found", F.coalesce("_near", "_carried"))


def _tag(etag: Column) -> Column:
    """Entity tags are compared weakly."""
    return F.regexp_replace(etag, "^W/", "")


def resolve(records: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(record_id, url, at, kind, status, etag, last_modified, headers) -> a row for each revisit.

    Columns: record_id, canonical_url, outcome, response_id, response_at, headers. Outcomes: ``resolved``; ``mismatch`` if the
    validators differ; ``unvalidated`` if the two have no validator in common; ``missing`` if there is no earlier full response,
    the URL or time is null. An entity tag decides where both have one, else the time of the last change. Only resolved revisits
    have a response and headers: those of the response, updated by the permitted ones; names are compared without case and
    keep the one they came with. Repeated rows are resolved each.
    """
    # Other columns go first, so that none of them clashes with what is added.
    known = records.select("record_id", "at", "kind", "status", "etag", "last_modified", "headers", canonical(F.col("url")).alias("canonical_url"))
    placed = _as_of(known.filter("canonical_url is not null and at is not null"), bucket)
    found = F.col("_found")
    both_tags = F.col("etag").isNotNull() & found["etag"].isNotNull()
    both_times = F.col("last_modified").isNotNull() & found["last_modified"].isNotNull()
    outcome = (
        F.when(found.isNull(), "missing")
        .when(both_tags, F.when(_tag(F.col("etag")) == _tag(found["etag"]), "resolved").otherwise("mismatch"))
        .when(both_times, F.when(F.col("last_modified") == found["last_modified"], "resolved").otherwise("mismatch"))
        .otherwise("unvalidated")
    )
    # Header names have no case.
    updates = F.map_filter(F.coalesce("headers", F.create_map().cast("map<string,string>")), lambda k, v: F.lower(k).isin(*PERMITTED))
    updated = F.transform(F.map_keys(updates), F.lower)
    kept = F.map_filter(F.coalesce(found["headers"], F.create_map().cast("map<string,string>")), lambda k, v: ~F.array_contains(updated, F.lower(k)))
    good = F.col("outcome") == "resolved"
    resolved = placed.withColumn("outcome", outcome).select(
        "record_id",
        "canonical_url",
        "outcome",
        F.when(good, found["record_id"]).alias("response_id"),
        F.when(good, found["at"]).alias("response_at"),
        F.when(good, F.map_concat(kept, updates)).alias("headers"),
    )
    unplaced = known.filter("kind = 'revisit' and (canonical_url is null or at is null)").select(
        "record_id", "canonical_url", F.lit("missing").alias("outcome"), F.lit(None).cast("long").alias("response_id"), F.lit(None).cast("long").alias("response_at"), F.lit(None).cast("map<string,string>").alias("headers")
    )
    return resolved.unionByName(unplaced)


def captures(pages: DataFrame) -> DataFrame:
    """A record set made of the pages: a response for each page at three times its id, and revisits around it.

    A revisit follows each response, under another spelling of the URL; every third has the tag of another body, every fifth no
    tag, so that the time of the last change decides, and every eleventh comes before its response.
    """
    p = F.col("page_id")
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.coalesce("html", F.lit(""))), 1, 16), F.lit('"'))
    response = pages.select(
        (2 * p).alias("record_id"),
        "url",
        (3 * p).alias("at"),
        F.lit("response").alias("kind"),
        F.lit(200).alias("status"),
        F.when(p % 5 != 0, tag).alias("etag"),
        (p % 7).cast("string").alias("last_modified"),
        F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("date"), (3 * p).cast("string")).alias("headers"),
    )
    revisit = pages.select(
        (2 * p + 1).alias("record_id"),
        F.concat(F.col("url"), F.lit("#again")).alias("url"),
        F.when(p % 11 == 0, 3 * p - 1).otherwise(3 * p + 1).alias("at"),
        F.lit("revisit").alias("kind"),
        F.lit(304).alias("status"),
        F.when(p % 5 != 0, F.when(p % 3 == 0, F.lit('"other"')).otherwise(F.concat(F.lit("W/"), tag))).alias("etag"),
        (p % 7).cast("string").alias("last_modified"),
        F.create_map(F.lit("date"), (3 * p + 1).cast("string"), F.lit("content-length"), F.lit("0")).alias("headers"),
    )
    return response.unionByName(revisit)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The revisits among the captures made of all pages; headers as text, since maps cannot be compared."""
    resolved = resolve(captures(table(spark, sf_dir, "pages")))
    lines = F.transform(F.array_sort(F.map_keys("headers")), lambda k: F.concat(k, F.lit("="), F.col("headers")[k]))
    return resolved.withColumn("headers", F.array_join(lines, ";"))


OP5_SQL = r"""
WITH base AS (
  SELECT page_id AS p, url, '"' || substr(md5(coalesce(html, '')), 1, 16) || '"' AS tag FROM pages),
named AS (
  SELECT *, regexp_replace(trim(url), '#.*$', '') AS bare FROM base),
parts AS (
  SELECT *, lower(regexp_extract(bare, '^([^:/?#]+://[^/?#]*)', 1)) AS host,
         substr(bare, CAST(length(regexp_extract(bare, '^([^:/?#]+://[^/?#]*)', 1)) + 1 AS BIGINT)) AS rest FROM named),
keyed AS (
  SELECT p, tag,
    regexp_replace(regexp_replace(host, '^(http://[^/]*):80$', '\1'), '^(https://[^/]*):443$', '\1')
    || regexp_replace(regexp_replace(rest, '([?&])(?:(?:utm_[a-z]+|ref)=[^&]*&?)+', '\1', 'g'), '/?[?&]*$', '') AS canonical_url
  FROM parts),
responses AS (SELECT canonical_url, 3 * p AS at, 2 * p AS record_id, CASE WHEN p % 5 <> 0 THEN tag END AS etag, CAST(p % 7 AS VARCHAR) AS changed FROM keyed),
revisits AS (
  SELECT canonical_url, p, 2 * p + 1 AS record_id, CASE WHEN p % 11 = 0 THEN 3 * p - 1 ELSE 3 * p + 1 END AS at,
         CASE WHEN p % 5 <> 0 THEN CASE WHEN p % 3 = 0 THEN '"other"' ELSE tag END END AS etag, CAST(p % 7 AS VARCHAR) AS changed
  FROM keyed),
met AS (
  SELECT v.*, r.record_id AS of, r.at AS of_at, r.etag AS of_etag, r.changed AS of_changed,
         row_number() OVER (PARTITION BY v.record_id ORDER BY r.at DESC NULLS LAST, r.record_id DESC) AS no
  FROM revisits v LEFT JOIN responses r
    ON v.canonical_url = r.canonical_url AND (r.at < v.at OR (r.at = v.at AND r.record_id < v.record_id))),
judged AS (
  SELECT *, CASE WHEN of IS NULL THEN 'missing'
                 WHEN etag IS NOT NULL AND of_etag IS NOT NULL THEN CASE WHEN etag = of_etag THEN 'resolved' ELSE 'mismatch' END
                 WHEN changed = of_changed THEN 'resolved' ELSE 'mismatch' END AS outcome
  FROM met WHERE no = 1)
SELECT record_id, canonical_url, outcome, CASE WHEN outcome = 'resolved' THEN of END AS response_id,
       CASE WHEN outcome = 'resolved' THEN of_at END AS response_at,
       CASE WHEN outcome = 'resolved' THEN 'content-type=text/html;date=' || CAST(3 * p + 1 AS VARCHAR) END AS headers
FROM judged
"""
