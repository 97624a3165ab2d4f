"""Several stored answers for one URL: one of them counts, everywhere the same."""

import pytest
from pyspark.sql import functions as F

from webcorpus.config import CrawlOptions
from webcorpus.operators import redirects
from webcorpus.operators.answers import one_per_url
from webcorpus.plans import crawl

ANSWERS = "url string, http_status int, location string"
B = "https://h.com"
PAGE = "<p>A page that is long enough to count as the content of a page, number {}.</p><a href='/n{}'>x</a>"


def test_one_row_of_every_url(spark):
    rows = [(f"{B}/{i % 7}", i, i * 10 % 30) for i in range(21)] + [(f"{B}/single", 5, 1), (None, 1, 1), (None, 1, 1)]
    df = spark.createDataFrame(rows, "url string, page_id int, seconds int")
    timed = df.withColumn("fetched_at", F.timestamp_seconds("seconds")).drop("seconds")
    got = [(r.url, r.page_id) for r in one_per_url(timed).collect()]
    latest = {u: p for u, p, _ in sorted((r for r in rows if r[0]), key=lambda r: r[2])}
    assert sorted(g for g in got if g[0]) == sorted(latest.items()) and len(got) == len(latest) + 2
    # without times: the same rows whatever the order and the partitions are, and none mixed of two
    runs = [sorted(map(tuple, one_per_url(d).where("url is not null").collect())) for d in (df, df.orderBy("page_id").repartition(5))]
    assert runs[0] == runs[1] and len(runs[0]) == 8 and set(runs[0]) <= set(rows)


def test_redirects_of_repeated_urls(spark):
    answers = [(f"{B}/{i}", 301, f"{B}/{i + 1}") for i in range(6)] * 2 + [(f"{B}/6", 200, None)] * 3
    got = {r.url: r for r in redirects.follow_redirects(spark.createDataFrame(answers, ANSWERS)).collect()}
    found = redirects.follow_redirects(spark.createDataFrame(answers, ANSWERS))
    assert found.count() == len(got) == 6
    assert [(got[f"{B}/{i}"].final_url, got[f"{B}/{i}"].hops) for i in range(6)] == [(f"{B}/6", 6 - i) for i in range(6)]


def test_loops_of_repeated_urls_end(spark):
    answers = [(f"{B}/{i}", 301, f"{B}/{(i + 1) % 3}") for i in range(3)] * 2
    got = redirects.follow_redirects(spark.createDataFrame(answers, ANSWERS)).collect()
    assert sorted((r.url, r.error) for r in got) == [(f"{B}/{i}", redirects.LOOP) for i in range(3)]


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_a_task_has_one_outcome(spark, limit):
    kinds = ANSWERS + ", content_type string, html string, error_kind string, error string"
    rows = [(f"{B}/twice", 200, None, "text/html", PAGE.format(1, 1), None, None), (f"{B}/twice", 404, None, "text/html", "", None, None),
            (f"{B}/texts", 200, None, "text/html", PAGE.format(2, 2), None, None), (f"{B}/texts", 200, None, "text/html", PAGE.format(3, 3), None, None),
            (f"{B}/once", 200, None, "text/html", PAGE.format(4, 4), None, None),
            (f"{B}/moved", 301, f"{B}/texts", None, None, None, None)]
    fetches = spark.createDataFrame(rows, kinds)
    names = ["twice", "texts", "texts", "once", "moved"]
    tasks = spark.createDataFrame([(i, f"{B}/{n}", 0 if i != 2 else 9, 90) for i, n in enumerate(names)], "id bigint, url string, depth int, parent_score int")
    options = CrawlOptions(allowed_domains=[".*"], respect_robots=False, filter_by_language=False)
    ends = redirects.follow_redirects(fetches)
    batch = crawl.crawl_batch(tasks, None, fetches, options, redirected=ends, broadcast_bytes=limit)
    assert sorted(r.id for r in batch.outcomes.collect()) == [0, 1, 2, 3, 4]
    texts = {r.id: r.text for r in batch.content.collect()}
    assert batch.content.count() == len(texts) and {1, 2, 3, 4} <= set(texts)
    assert texts[1] == texts[2] == texts[4]
    # task 2 is too deep for its links to be followed, though task 1 has the same URL
    assert {1, 3, 4} <= {r.task_id for r in batch.links.collect()} <= {0, 1, 3, 4}


KINDS = ANSWERS + ", content_type string, html string, error_kind string, error string"
FAILED = [(404, "text/html", PAGE, None), (200, "application/pdf", PAGE, None), (200, "text/html", " \n", None), (None, None, None, "request")]


def _twice(n):
    """Every URL has a page and, before or after it, an answer that fails."""
    rows = []
    for i in range(n):
        status, kind, html, error = FAILED[i % 4]
        both = [(f"{B}/{i}", 200, None, "text/html", PAGE.format(i, i), None, None), (f"{B}/{i}", status, None, kind, html, error, error)]
        rows += both if i % 8 < 4 else both[::-1]
    return rows


def test_no_failure_hides_a_page(spark):
    rows = _twice(32)
    got = one_per_url(spark.createDataFrame(rows, KINDS)).collect()
    assert sorted((r.url, r.html) for r in got) == sorted((f"{B}/{i}", PAGE.format(i, i)) for i in range(32))
    # a failure that is known to be later counts, and a redirect counts before a failure
    timed = spark.createDataFrame(rows, KINDS).withColumn("fetched_at", F.timestamp_seconds(F.when(F.col("html") == PAGE, 2).otherwise(1)))
    late = {r.url for r in one_per_url(timed).collect() if r.html == PAGE}
    assert late == {f"{B}/{i}" for i in range(32) if i % 4 < 2}
    moved = [(f"{B}/{i}", *answer) for i in range(16) for answer in ((301, f"{B}/to", None, None, None, None), (404, None, "text/html", "x", None, None))]
    assert {r.http_status for r in one_per_url(spark.createDataFrame(moved, KINDS)).collect()} == {301}


def test_links_of_repeated_urls_are_reported_by_url(spark):
    tasks = spark.createDataFrame([(i, f"{B}/{i % 16}", 0, 90) for i in range(32)], "id bigint, url string, depth int, parent_score int")
    options = CrawlOptions(allowed_domains=[".*"], respect_robots=False, filter_by_language=False)
    batch = crawl.crawl_batch(tasks, None, spark.createDataFrame(_twice(16), KINDS), options)
    known = spark.createDataFrame([(f"{B}/n3",)], "url string")
    got = {r.parent_url: (r.found, r.added, r.skipped) for r in crawl.report_links(batch.links, known).collect()}
    # two tasks find the link of a page, the frontier gains it once
    assert got == {f"{B}/{i}": (2, 0, 2) if i == 3 else (2, 1, 1) for i in range(16)}
