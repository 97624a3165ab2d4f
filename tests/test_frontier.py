"""Frontier operators, outcomes and the multi-hop expansion."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from webcorpus.config import CrawlOptions
from webcorpus.operators import frontier, outcomes
from webcorpus.plans import crawl

LINKS = "url string, priority int, depth int, parent_url string, position int"


def _links(spark, rows):
    return spark.createDataFrame(rows, LINKS)


def test_next_tasks(spark):
    rows = [(i, f"u{i}", i % 3, "d", "pending" if i % 2 else "completed") for i in range(20)]
    df = spark.createDataFrame(rows, "id bigint, url string, priority int, domain string, status string")
    assert [r.id for r in frontier.next_tasks(df, 4).collect()] == [5, 11, 17, 1]
    assert [r.id for r in frontier.next_tasks(df, 2, highest_first=False).collect()] == [3, 9]
    assert frontier.next_tasks(df.where("false"), 10).count() == 0


def test_admit_and_count(spark):
    found = _links(spark, [("a", 50, 1, "p2", 0), ("a", 60, 1, "p1", 3), ("a", 70, 2, "p1", 5), ("b", 50, 1, "p1", 0), ("c", 50, 1, "p1", 1)])
    known = spark.createDataFrame([("b",), ("b",), ("z",)], "url string")
    rows = {r.url: (r.parent_url, r.priority) for r in frontier.admit_links(found, known).collect()}
    assert rows == {"a": ("p1", 60), "c": ("p1", 50)}
    assert frontier.admit_counts(found, known).first().asDict() == {"added": 2, "skipped": 3, "total": 5}
    assert frontier.admit_counts(found.where("false"), known).first().asDict() == {"added": 0, "skipped": 0, "total": 0}


def test_admission_does_not_depend_on_row_order_or_partitions(spark):
    rows = [(f"u{i % 7}", i % 50, 1, f"p{i % 11}", i) for i in range(300)]
    known = spark.createDataFrame([("u3",)], "url string")
    first = sorted(frontier.admit_links(_links(spark, rows), known).collect())
    again = sorted(frontier.admit_links(_links(spark, rows[::-1]).repartition(5), known).collect())
    assert first == again


def test_latest_status(spark):
    t = datetime(2024, 1, 1)
    rows = [(1, "crawling", None, t, 0), (1, "failed", "HTTP 500", t, 1), (2, "pending", None, t, 9), (2, "completed", None, datetime(2024, 1, 2), 0)]
    df = spark.createDataFrame(rows, "task_id bigint, status string, error_message string, ts timestamp, seq bigint")
    got = {r.task_id: (r.status, r.error_message) for r in frontier.latest_status(df).collect()}
    assert got == {1: ("failed", "HTTP 500"), 2: ("completed", None)}


def test_status_transitions(spark):
    df = spark.createDataFrame([(1, "failed", "Test error"), (2, "completed", None)], "id bigint, status string, error_message string")
    got = sorted((r.task_id, r.seq, r.status, r.error_message) for r in frontier.status_transitions(df).collect())
    assert got == [(1, 0, "crawling", None), (1, 1, "failed", "Test error"), (2, 0, "crawling", None), (2, 1, "completed", None)]


@pytest.mark.parametrize("fetch, content, want", [
    ((200, "text/html", None, None), True, None),
    ((204, "TEXT/HTML; charset=x", None, None), True, None),
    ((200, "text/html", None, None), False, "Content extraction failed"),
    ((404, "text/html", None, None), True, "HTTP 404"),
    ((302, None, None, None), True, "HTTP 302"),
    ((200, "application/pdf", None, None), True, "Not HTML: application/pdf"),
    ((200, None, None, None), True, "Not HTML: "),
    ((None, None, "request", "timed out"), False, "Request error: timed out"),
    ((None, None, "other", None), False, "Unexpected error: "),
])
def test_outcomes(spark, fetch, content, want):
    df = spark.createDataFrame([fetch], "http_status int, content_type string, error_kind string, error string")
    row = outcomes.with_outcome(df, F.lit(True), F.lit(content)).first()
    assert (row.status, row.error_message) == ("completed" if want is None else "failed", want)
    refused = outcomes.with_outcome(df, F.lit(False), F.lit(content)).first()
    assert (refused.status, refused.error_message) == ("failed", "Disallowed by robots.txt")


def test_size_guard(spark):
    df = spark.createDataFrame([("x" * 10,), ("é" * 11,), (None,)], "html string")
    assert outcomes.size_guard(df, 10).count() == 2
    assert outcomes.size_guard(df, None).count() == 3


def test_crawl_batch_links_only_where_content_was_found(spark):
    body = "<p>" + "word " * 20 + '</p><a href="/next">n</a><a href="https://www.example.jp/x">s</a>'
    tasks = spark.createDataFrame([(1, "https://h.com/a", 0, 90), (2, "https://h.com/b", 0, 90), (3, "https://h.com/no", 0, 90), (4, "https://h.com/later", 0, 90)],
                                  "id bigint, url string, depth int, parent_score int")
    fetches = spark.createDataFrame([("https://h.com/a", 200, "text/html", body, None, None), ("https://h.com/b", 404, "text/html", body, None, None),
                                     ("https://h.com/no", 200, "text/html", body, None, None)],
                                    "url string, http_status int, content_type string, html string, error_kind string, error string")
    raw = spark.createDataFrame([("https://h.com", 200, "User-agent: *\nDisallow: /no")], "origin string, http_status int, body string")
    from webcorpus.operators import robots
    rules = robots.rules_for_agent(robots.parse_robots(raw), "B/1")
    options = CrawlOptions(allowed_domains=[".*"])
    for join in ({}, {"broadcast_bytes": 0, "hot_rows": 2}):
        batch = crawl.crawl_batch(tasks, rules, fetches, options, **join)
        got = {r.id: (r.status, r.error_message) for r in batch.outcomes.collect()}
        assert got == {1: ("completed", None), 2: ("failed", "HTTP 404"), 3: ("failed", "Disallowed by robots.txt")}
        assert [(r.url, r.priority, r.depth) for r in batch.links.collect()] == [("https://h.com/next", 80, 1)]
        assert [r.id for r in batch.content.collect()] == [1]
        assert batch.status.count() == 6
    everything = CrawlOptions(allowed_domains=[".*"], filter_by_language=False, respect_robots=False)
    batch = crawl.crawl_batch(tasks, rules, fetches, everything)
    assert batch.links.where("parent_url = 'https://h.com/a'").count() == 2
    assert batch.content.count() == 2
    off = crawl.crawl_batch(tasks, rules, fetches, CrawlOptions(extract_links=False))
    assert off.links.count() == 0 and off.content.count() == 1


def test_expansion_stops_at_depth_and_at_known_urls(spark):
    chain = [(f"https://h.com/{i}", f'<a href="/{i + 1}">n</a><a href="/{i}">self</a><a href="/k">k</a>', 80) for i in range(8)]
    pages = spark.createDataFrame(chain, "url string, html string, parent_score int")
    seeds = spark.createDataFrame([("https://h.com/0",)], "url string")
    known = spark.createDataFrame([("https://h.com/k",)], "url string")
    grown = crawl.frontier_expand(seeds, pages, known, CrawlOptions(allowed_domains=[".*"]))
    got = sorted((r.depth, r.url, r.parent_url) for r in grown.collect())
    assert got == [(d, f"https://h.com/{d}", f"https://h.com/{d - 1}") for d in (1, 2, 3)]


def _fetched(spark, n, html="<p>" + "word " * 30):
    rows = [(f"https://h.example/{i}", 200, "text/html", html, None, None) for i in range(n)]
    return spark.createDataFrame(rows, "url string, http_status int, content_type string, html string, error_kind string, error string")


@pytest.mark.parametrize("broadcast_bytes", [64 << 20, 0])
def test_a_batch_reads_each_wanted_page_once(spark, broadcast_bytes):
    options = CrawlOptions(allowed_domains=[".*"], respect_robots=False, max_content_length=100_000, filter_by_language=False)
    many = "".join(f'<a href="/l/{i}">x</a>' for i in range(300))
    fetches = _fetched(spark, 40).union(_fetched(spark, 1, "x" * 100_001).withColumn("url", F.lit("https://h.example/long")))
    fetches = fetches.union(_fetched(spark, 1, many + "<p>" + "word " * 30).withColumn("url", F.lit("https://h.example/many")))
    fetches = fetches.union(_fetched(spark, 1).withColumns({"url": F.lit("https://h.example/none"), "http_status": F.lit(None).cast("int")}))
    names = ["0", "3", "long", "many", "none", "never fetched"]
    tasks = spark.createDataFrame([(i, f"https://h.example/{n}", 0, 80) for i, n in enumerate(names)], "id bigint, url string, depth int, parent_score int")
    batch = crawl.crawl_batch(tasks, None, fetches, options, staged=False, broadcast_bytes=broadcast_bytes)
    got = {r.id: (r.status, r.error_message) for r in batch.outcomes.collect()}
    assert got == {
        0: ("completed", None), 1: ("completed", None), 2: ("failed", "Content too long"), 3: ("completed", None),
        4: ("failed", "Unexpected error: "),
    }
    assert batch.links.count() == 300
    plan = batch.content._jdf.queryExecution().optimizedPlan().toString()
    # the html column is defined by one relation per union branch of this test, each read once
    assert plan.count("LogicalRDD") == plan.count("LogicalRDD [url") + plan.count("LogicalRDD [id")
    assert plan.count("LogicalRDD [url") == 4


def test_bitmap_of_keys_keeps_what_is_in_it(spark):
    from webcorpus.plans import skew

    df = spark.range(20_000).select(F.concat(F.lit("u"), "id").alias("url"), "id")
    kept = skew.likely_in(df, df.where("id % 7 = 0").select("url"), "url")
    rows = {r.id for r in kept.collect()}
    assert {i for i in range(20_000) if i % 7 == 0} <= rows and len(rows) < 3000 and kept.columns == df.columns
    assert skew.likely_in(df, df.limit(0).select("url"), "url").count() == 0
