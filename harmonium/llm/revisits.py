"""Resolution of not-modified revisit records in web archives (operator 10).

A revisit says that an address was fetched again and had not changed.  Its content is that of the latest earlier full
response of the same canonical address, if the validators agree; its headers are that response's, updated by those headers
which a not-modified answer is allowed to update.

The as-of join works on narrow rows in slices of (address, time span): within a slice a window carries the last full
response forward, and what a slice starts with comes from one row per earlier slice.  An address that holds a third of all
records is therefore spread over its time spans.  Headers are joined afterwards by record, and contents are never moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from harmonium.llm.common import read

#: Seconds of a slice.
SPAN = 86_400
#: Query parameters that do not name content.
TRACKING = r"^(utm_[a-z]+|gclid|fbclid|ref|sessionid|sid|phpsessid)(=|$)"
#: Fixed values (RFC 9110 and 9111): fields about the message or its body, which a 304 answer must not update.
NOT_UPDATED = ["connection", "keep-alive", "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade",
               "content-encoding", "content-length", "content-range", "content-type"]


def canonical_url(url: Column) -> Column:
    """The address without scheme, ``www.``, default port, fragment and tracking parameters; parameters in order.

    Host names are in lower case, an empty path is ``/``, a trailing ``/`` of longer paths is dropped.  Null stays null.
    """
    whole = F.regexp_replace(F.trim(url), r"#.*$", "")
    host = F.lower(F.regexp_extract(whole, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/@?]*@)?([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)?$", ""), r"^www\.", "")
    path = F.regexp_extract(whole, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?[^/?]*([^?]*)", 1)
    path = F.when(path.isin("", "/"), F.lit("/")).otherwise(F.regexp_replace(path, r"/+$", ""))
    parameters = F.split(F.regexp_extract(whole, r"\?(.*)$", 1), "&")
    parameters = F.array_join(F.array_sort(F.filter(parameters, lambda p: (p != "") & ~F.lower(p).rlike(TRACKING))), "&")
    return F.concat(host, path, F.when(parameters != "", F.concat(F.lit("?"), parameters)).otherwise(F.lit("")))


def _lowered(headers: Column) -> Column:
    """Header names in lower case; of equal names the last in order counts."""
    entries = F.coalesce(F.map_entries(headers), F.array().cast("array<struct<key:string,value:string>>"))
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(F.trim(e["key"]))))
    value = lambda n: F.element_at(F.filter(entries, lambda e: F.lower(F.trim(e["key"])) == n), -1)["value"]
    return F.map_from_arrays(names, F.transform(names, lambda n: F.trim(value(n))))


def resolve(records: DataFrame, span: int = SPAN) -> DataFrame:
    """Resolve the revisits of ``records``: record_id, kind (``response`` or ``revisit``), url, ts (seconds), headers (map).

    One row per revisit: record_id, canonical_url, ts, refers_to, outcome, headers.  outcome:

    * ``resolved``: the validators that both carry agree (entity tags by weak comparison; dates only if there is no tag
      in both);
    * ``unvalidated``: no validator is in both;
    * ``changed``: a validator differs; the response is named, its headers are not merged;
    * ``orphan``: no earlier full response (also if the address or time is null).

    Responses of the same second are not earlier.  Of several at one time, the largest record_id counts.  Repeated records
    give repeated rows.  Other columns and kinds are ignored; an empty table gives an empty result.
    """
    rows = records.where(F.col("kind").isin("response", "revisit")).select(
        F.col("record_id").cast("string").alias("record_id"), (F.col("kind") == "response").cast("int").alias("full"), canonical_url(F.col("url")).alias("canonical_url"), F.col("ts").cast("long").alias("ts"), _lowered(F.col("headers")).alias("headers"))
    slice_ = F.floor(F.col("ts") / span).alias("slice")
    narrow = rows.select("record_id", "full", "canonical_url", "ts", slice_, F.col("headers")["etag"].alias("etag"), F.col("headers")["last-modified"].alias("modified"))
    placed = narrow.where("canonical_url is not null and ts is not null and record_id is not null")
    response = F.when(F.col("full") == 1, F.struct("ts", "record_id", "etag", "modified"))
    # a revisit stands before the responses of its second
    before = W.partitionBy("canonical_url", "slice").orderBy("ts", "full", "record_id").rowsBetween(W.unboundedPreceding, -1)
    within = placed.withColumn("found", F.last(response, ignorenulls=True).over(before)).where("full = 0")
    starts = placed.groupBy("canonical_url", "slice").agg(F.max(response).alias("latest"))
    earlier = W.partitionBy("canonical_url").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    starts = starts.withColumn("carried", F.last("latest", ignorenulls=True).over(earlier)).select("canonical_url", "slice", "carried")
    found = within.join(starts, ["canonical_url", "slice"]).withColumn("found", F.coalesce("found", "carried")).drop("carried", "slice", "full")
    nowhere = narrow.where("full = 0 and (canonical_url is null or ts is null or record_id is null)").select("canonical_url", "record_id", "ts", "etag", "modified", F.lit(None).cast(found.schema["found"].dataType).alias("found"))
    found = found.unionByName(nowhere)
    tag = lambda c: F.regexp_replace(F.trim(c), r"^[Ww]/", "")
    by_tag = F.col("etag").isNotNull() & F.col("found.etag").isNotNull()
    by_date = F.col("modified").isNotNull() & F.col("found.modified").isNotNull()
    agrees = F.when(by_tag, tag(F.col("etag")) == tag(F.col("found.etag"))).when(by_date, F.col("modified") == F.col("found.modified"))
    outcome = F.when(F.col("found").isNull(), "orphan").when(agrees.isNull(), "unvalidated").when(agrees, "resolved").otherwise("changed")
    found = found.select("record_id", "canonical_url", "ts", F.col("found.record_id").alias("refers_to"), outcome.alias("outcome"))
    own = rows.where("full = 0").select("record_id", "headers", "ts", "canonical_url").dropDuplicates(["record_id", "ts", "canonical_url"])
    stored = rows.where("full = 1").groupBy("record_id").agg(F.max_by("headers", "ts").alias("stored")).withColumnRenamed("record_id", "refers_to")
    both = found.join(own.withColumnRenamed("headers", "new"), (found.record_id.eqNullSafe(own.record_id)) & found.ts.eqNullSafe(own.ts) & found.canonical_url.eqNullSafe(own.canonical_url), "left").select(found["*"], "new").join(stored, "refers_to", "left")
    permitted = F.map_filter("new", lambda k, _: ~k.isin(NOT_UPDATED))
    kept = F.map_filter("stored", lambda k, _: ~F.map_contains_key(permitted, k))
    merged = F.when(F.col("outcome").isin("resolved", "unvalidated"), F.map_concat(kept, permitted)).otherwise(F.col("new"))
    return both.select("record_id", "canonical_url", "ts", "refers_to", "outcome", merged.alias("headers"))


def derived_records(pages: DataFrame) -> DataFrame:
    """Archive records that Spark derives from ``pages``: each page's response, and later and earlier fetches of it.

    Every page is fetched again a day later from a variant of its address with an equal tag (weak); every third two days
    later, with another tag; every fifth had been asked for an hour before its first response; every seventh is asked for
    on the fourth day by date only.
    """
    at = 1_700_000_000 + F.col("page_id") * 37
    digest = F.md5(F.coalesce("html", F.lit("")))
    text = lambda c: F.concat(F.lit("d"), c.cast("string"))
    known = lambda *pairs: F.map_from_arrays(F.array(*[F.lit(k) for k, _ in pairs]), F.array(*[v for _, v in pairs]))
    weekday = text(at)
    kinds = [
        ("r", "response", True, 0, F.col("url"), known(("ETag", F.concat(F.lit('"'), digest, F.lit('"'))), ("Last-Modified", weekday), ("Content-Type", F.lit("text/html")), ("Content-Length", F.length(F.coalesce("html", F.lit(""))).cast("string")), ("Date", text(at)), ("Cache-Control", F.lit("max-age=60")))),
        ("a", "revisit", True, 86_400, F.concat("url", F.lit("#part")), known(("etag", F.concat(F.lit('W/"'), digest, F.lit('"'))), ("Date", text(at + 86_400)), ("Cache-Control", F.lit("max-age=600")), ("Content-Length", F.lit("0")))),
        ("b", "revisit", F.col("page_id") % 3 == 0, 172_800, F.col("url"), known(("ETag", F.lit('"other"')), ("Date", text(at + 172_800)))),
        ("c", "revisit", F.col("page_id") % 5 == 0, -3_600, F.col("url"), known(("ETag", F.concat(F.lit('"'), digest, F.lit('"'))), ("Date", text(at - 3_600)))),
        ("d", "revisit", F.col("page_id") % 7 == 0, 345_600, F.col("url"), known(("Last-Modified", weekday), ("Date", text(at + 345_600)), ("Connection", F.lit("close")))),
    ]
    every = F.array(*[
        F.when(F.lit(True) if when is True else when, F.struct(F.concat(F.lit(mark), F.col("page_id").cast("string")).alias("record_id"), F.lit(kind).alias("kind"), url.alias("url"), (at + shift).alias("ts"), headers.alias("headers")))
        for mark, kind, when, shift, url, headers in kinds])
    return pages.select(F.explode(F.filter(every, lambda r: r.isNotNull())).alias("r")).select("r.*")


def op10_revisit_resolution(spark: SparkSession, folder: str) -> DataFrame:
    found = resolve(derived_records(read(spark, folder, "pages").select("page_id", "url", "html")))
    lines = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    return found.select("record_id", "canonical_url", "ts", "refers_to", "outcome", lines.alias("headers"))


_T = "(1700000000 + page_id * 37)"
OP10_SQL = f"""
WITH p AS (SELECT page_id, url, md5(coalesce(html, '')) AS digest, length(coalesce(html, '')) AS size, {_T} AS t0 FROM pages),
rec AS (
  SELECT 'r' || page_id AS record_id, 1 AS full_, url, t0 AS ts, '"' || digest || '"' AS etag, 'd' || t0 AS modified, size, page_id FROM p
  UNION ALL SELECT 'a' || page_id, 0, url || '#part', t0 + 86400, '"' || digest || '"', NULL, NULL, page_id FROM p
  UNION ALL SELECT 'b' || page_id, 0, url, t0 + 172800, '"other"', NULL, NULL, page_id FROM p WHERE page_id % 3 = 0
  UNION ALL SELECT 'c' || page_id, 0, url, t0 - 3600, '"' || digest || '"', NULL, NULL, page_id FROM p WHERE page_id % 5 = 0
  UNION ALL SELECT 'd' || page_id, 0, url, t0 + 345600, NULL, 'd' || t0, NULL, page_id FROM p WHERE page_id % 7 = 0),
parts AS (
  SELECT *, regexp_replace(trim(url), '#.*$', '') AS w FROM rec),
split_ AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(w, '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/@?]*@)?([^/?]*)', 1)), ':(80|443)?$', ''), '^www\\.', '') AS host,
    regexp_extract(w, '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?[^/?]*([^?]*)', 1) AS path,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(w, '\\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '{TRACKING}'))), '&') AS q FROM parts),
canon AS (
  SELECT record_id, full_, ts, etag, modified, size, page_id,
    host || CASE WHEN path IN ('', '/') THEN '/' ELSE regexp_replace(path, '/+$', '') END || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS canonical_url FROM split_),
seen AS (
  SELECT *, last_value(CASE WHEN full_ = 1 THEN {{'id': record_id, 'etag': etag, 'modified': modified, 'size': size}} END IGNORE NULLS)
    OVER (PARTITION BY canonical_url ORDER BY ts, full_, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS f FROM canon),
judged AS (
  SELECT *, CASE WHEN f IS NULL THEN 'orphan' WHEN etag IS NOT NULL AND f.etag IS NOT NULL THEN CASE WHEN etag = f.etag THEN 'resolved' ELSE 'changed' END
    WHEN modified IS NOT NULL AND f.modified IS NOT NULL THEN CASE WHEN modified = f.modified THEN 'resolved' ELSE 'changed' END ELSE 'unvalidated' END AS outcome,
    CASE WHEN record_id[1] = 'a' THEN 'W/' || etag ELSE etag END AS sent FROM seen WHERE full_ = 0)
SELECT record_id, canonical_url, ts, f.id AS refers_to, outcome,
  CASE WHEN outcome IN ('resolved', 'unvalidated') THEN concat_ws(chr(10),
    'cache-control: ' || CASE WHEN record_id[1] = 'a' THEN 'max-age=600' ELSE 'max-age=60' END, 'content-length: ' || f.size, 'content-type: text/html',
    'date: d' || ts, 'etag: ' || coalesce(sent, f.etag), 'last-modified: ' || coalesce(modified, f.modified))
  ELSE concat_ws(chr(10), CASE WHEN record_id[1] = 'a' THEN 'cache-control: max-age=600' END, CASE WHEN record_id[1] = 'd' THEN 'connection: close' END,
    CASE WHEN record_id[1] = 'a' THEN 'content-length: 0' END, 'date: d' || ts, 'etag: ' || sent, 'last-modified: ' || modified) END AS headers
FROM judged
"""
