"""WARC not-modified revisits: an as-of join to the latest earlier full response.

Records are keyed by canonical URL. Of every day of a URL only the latest response is
carried on to later days, so the rows of a URL that holds a third of all records are dealt
out by day; inside a day a window looks back. Only keys and times take part in this: the
headers and payload of the chosen response are joined by record id afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webcorpus.plans.storage import stage

#: Header fields of a not-modified answer that never replace stored ones: they are about
#: the connection or the form of the stored payload.
KEPT_FIELDS = [
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive",
    "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "proxy-connection",
    "te", "trailer", "transfer-encoding", "upgrade",
]
#: Microseconds of a day.
DAY = 86_400_000_000


def canonical_url(url: Column) -> Column:
    """Host in lower case without `www.` and default port, no scheme, fragment, tracking
    parameters or closing slash. NULL stays NULL."""
    text = F.regexp_replace(F.trim(url), "#.*$", "")
    text = F.regexp_replace(text, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(text, "^[^/?]*", 0))
    host = F.regexp_replace(F.regexp_replace(host, "^www[.]", ""), ":(80|443)$", "")
    rest = F.regexp_replace(text, "^[^/?]*", "")
    rest = F.regexp_replace(rest, "([?&])utm_[a-z]+=[^&]*", "$1")
    rest = F.regexp_replace(F.regexp_replace(rest, "&&+", "&"), "[?]&", "?")
    rest = F.regexp_replace(rest, "[?&]+$", "")
    rest = F.regexp_replace(rest, "/+([?]|$)", "$1")
    return F.concat(host, rest)


def header_map(headers: Column) -> Column:
    """Names in lower case; of names that differ in case only the last entry counts."""
    entries = F.coalesce(F.map_entries(headers), F.array().cast("array<struct<key:string,value:string>>"))
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))
    last = F.transform(
        names, lambda n: F.element_at(F.filter(entries, lambda e: F.lower(e["key"]) == n), -1)["value"]
    )
    return F.map_from_arrays(names, last)


def _tag(column: str) -> Column:
    return F.regexp_replace(F.trim(F.col(column)), "^W/", "")


def merged_headers(stored: Column, newer: Column) -> Column:
    """Stored headers, replaced and completed by the permitted ones of a newer answer."""
    allowed = F.map_filter(newer, lambda k, v: ~k.isin(KEPT_FIELDS) & v.isNotNull())
    kept = F.map_filter(stored, lambda k, v: ~F.array_contains(F.map_keys(allowed), k))
    return F.map_concat(kept, allowed)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """`(record_id, url, outcome, refers_to, headers, payload)` per not-modified revisit.

    `records` has `(record_id, warc_type, target_uri, date, status, headers, payload)` with
    unique ids. Revisits are rows of type `revisit` with status 304, full responses those of
    type `response` with status 200; others are left out, as are rows without id. The answer
    is the response of the canonical URL with the latest date before that of the revisit (of
    equal dates the greatest record id). Its validators must agree: entity tags without
    weakness marks if the revisit has one, else Last-Modified if it has that, else neither
    may be in the response. `outcome` is `resolved`, `validator mismatch` or `no earlier
    response` (also for a NULL URL or date); only resolved revisits have headers and payload.
    """
    rows = records.where(F.col("record_id").isNotNull()).select(
        "record_id", canonical_url(F.col("target_uri")).alias("url"), F.unix_micros("date").alias("at"),
        ((F.col("warc_type") == "response") & (F.col("status") == 200)).alias("full"),
        ((F.col("warc_type") == "revisit") & (F.col("status") == 304)).alias("asks"),
        header_map(F.col("headers")).alias("headers"), "payload",
    )
    keys = rows.where(F.coalesce("full", F.lit(False)) | F.coalesce("asks", F.lit(False))).select(
        "record_id", "url", "at", F.coalesce("full", F.lit(False)).alias("full"),
        F.element_at("headers", "etag").alias("etag"), F.element_at("headers", "last-modified").alias("changed"),
    )
    keys = stage(keys.withColumn("day", F.floor(F.col("at") / DAY)), "warc-keys")
    known = F.col("url").isNotNull() & F.col("at").isNotNull()
    answer = F.when(F.col("full"), F.struct("at", "record_id", "etag", "changed"))
    days = keys.where(known).groupBy("url", "day").agg(F.max(answer).alias("latest"))
    before = Window.partitionBy("url").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = stage(days.select("url", "day", F.max("latest").over(before).alias("carried")), "warc-days")
    same_day = Window.partitionBy("url", "day").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    looked = keys.where(known).withColumn("today", F.max(answer).over(same_day)).where(~F.col("full"))
    found = looked.join(days, ["url", "day"]).select(
        "record_id", "url", "etag", "changed", F.coalesce("today", "carried").alias("answer")
    ).unionByName(
        keys.where(~known & ~F.col("full")).select("record_id", "url", "etag", "changed"), allowMissingColumns=True
    )
    found = found.select("*", F.col("answer.etag").alias("own_etag"), F.col("answer.changed").alias("own_changed"))
    agree = (
        F.when(F.col("etag").isNotNull(), _tag("etag") == _tag("own_etag"))
        .when(F.col("changed").isNotNull(), F.col("changed") == F.col("own_changed"))
        .otherwise(F.col("own_etag").isNull() & F.col("own_changed").isNull())
    )
    outcome = (
        F.when(F.col("answer").isNull(), "no earlier response")
        .when(F.coalesce(agree, F.lit(False)), "resolved")
        .otherwise("validator mismatch")
    )
    found = stage(
        found.select("record_id", "url", outcome.alias("outcome"), F.col("answer.record_id").alias("refers_to")), "warc-found"
    )
    asked = rows.where("asks").select("record_id", F.col("headers").alias("newer"))
    stored = rows.where("full").select(
        F.col("record_id").alias("refers_to"), F.col("headers").alias("stored"), "payload"
    )
    resolved = found.where("outcome = 'resolved'").join(asked, "record_id").join(stored, "refers_to").select(
        "record_id", "url", "outcome", "refers_to",
        merged_headers(F.col("stored"), F.col("newer")).alias("headers"), "payload",
    )
    return resolved.unionByName(found.where("outcome <> 'resolved'"), allowMissingColumns=True)


def page_records(pages: DataFrame) -> DataFrame:
    """Records of an archive made from pages: each page is fetched, some are fetched again
    after a change, and each is asked for again later, as the remainders of its id say."""
    n, base = F.col("page_id"), F.lit(1_700_000_000)
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.col("html")), 1, 12), F.lit('"'))
    when = lambda seconds: F.timestamp_seconds(base + n % 500 * 3600 + seconds)
    common = [F.col("url").alias("target_uri")]
    first = pages.select(
        F.concat(F.lit("a"), n).alias("record_id"), F.lit("response").alias("warc_type"), *common,
        when(0).alias("date"), F.lit(200).alias("status"),
        F.create_map(
            F.lit("ETag"), tag, F.lit("Content-Type"), F.lit("text/html"), F.lit("Cache-Control"), F.lit("max-age=60"),
            F.lit("Last-Modified"), F.concat(F.lit("day "), (n % 9).cast("string")),
        ).alias("headers"),
        F.col("html").alias("payload"),
    )
    again = pages.where(n % 3 == 0).select(
        F.concat(F.lit("b"), n), F.lit("response"), *common, when(200_000), F.when(n % 6 == 0, 200).otherwise(404),
        F.create_map(F.lit("etag"), F.concat(F.lit("W/"), tag), F.lit("Server"), F.lit("two")),
        F.concat(F.lit("<!-- again -->"), F.col("html")),
    )
    asked = pages.select(
        F.concat(F.lit("c"), n), F.lit("revisit"), *common,
        when(F.when(n % 7 == 0, -5).when(n % 7 == 1, 0).otherwise(400_000)), F.lit(304),
        F.when(n % 5 == 0, F.create_map(F.lit("Last-Modified"), F.concat(F.lit("day "), (n % 9).cast("string")), F.lit("Age"), F.lit("5")))
        .when(n % 5 == 1, F.create_map(F.lit("ETAG"), F.lit('"other"')))
        .otherwise(F.create_map(F.lit("ETag"), tag, F.lit("Content-Length"), F.lit("0"), F.lit("cache-control"), F.lit("no-store"))),
        F.lit(None).cast("string"),
    )
    return first.union(again).union(asked)


def op7_revisits(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    found = resolve_revisits(page_records(pages))
    listed = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])))
    return found.select(
        "record_id", "url", "outcome", "refers_to",
        F.array_join(listed, "\n").alias("headers"),
        F.sha2("payload", 256).alias("payload_sha256"),
    )


OP7_SQL = r"""
WITH p AS (
  SELECT page_id AS n, html, '"' || substr(md5(html), 1, 12) || '"' AS tag, page_id % 500 * 3600 AS base,
         regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS u
  FROM pages
), k AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(u, '^[^/?]*')), '^www[.]', ''), ':(80|443)$', '')
    || regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(u, '^[^/?]*', ''),
         '([?&])utm_[a-z]+=[^&]*', '\1', 'g'), '&&+', '&', 'g'), '[?]&', '?', 'g'), '[?&]+$', ''), '/+([?]|$)', '\1', 'g') AS url
  FROM p
), responses AS (
  SELECT 'a' || n AS record_id, url, base AS at, tag AS etag, 'day ' || n % 9 AS changed, html AS payload, tag AS shown, true AS first FROM k
  UNION ALL
  SELECT 'b' || n, url, base + 200000, tag, NULL, '<!-- again -->' || html, 'W/' || tag, false FROM k WHERE n % 6 = 0
), asked AS (
  SELECT 'c' || n AS record_id, url, n, tag AS page_tag, base + CASE n % 7 WHEN 0 THEN -5 WHEN 1 THEN 0 ELSE 400000 END AS at,
         CASE WHEN n % 5 = 0 THEN NULL WHEN n % 5 = 1 THEN '"other"' ELSE tag END AS etag,
         CASE WHEN n % 5 = 0 THEN 'day ' || n % 9 END AS changed
  FROM k
), ranked AS (
  SELECT q.record_id, q.url, q.n, q.etag, q.changed, q.page_tag, r.record_id AS ref, r.etag AS r_etag, r.changed AS r_changed,
         r.payload, r.shown, r.first,
         row_number() OVER (PARTITION BY q.record_id ORDER BY r.at DESC NULLS LAST, r.record_id DESC) AS place
  FROM asked q LEFT JOIN responses r ON q.url = r.url AND r.at < q.at
), told AS (
  SELECT *, CASE WHEN ref IS NULL THEN 'no earlier response'
                 WHEN etag IS NOT NULL AND etag = r_etag OR etag IS NULL AND changed = r_changed THEN 'resolved'
                 ELSE 'validator mismatch' END AS outcome
  FROM ranked WHERE place = 1
)
SELECT record_id, url, outcome, ref AS refers_to,
  CASE WHEN outcome = 'resolved' THEN
    CASE WHEN first AND etag IS NULL THEN 'age: 5' || chr(10) || 'cache-control: max-age=60' || chr(10) || 'content-type: text/html' || chr(10) || 'etag: ' || shown || chr(10) || 'last-modified: ' || changed
         WHEN first THEN 'cache-control: no-store' || chr(10) || 'content-type: text/html' || chr(10) || 'etag: ' || etag || chr(10) || 'last-modified: ' || r_changed
         ELSE 'cache-control: no-store' || chr(10) || 'etag: ' || etag || chr(10) || 'server: two' END END AS headers,
  CASE WHEN outcome = 'resolved' THEN sha256(payload) END AS payload_sha256
FROM told
"""
