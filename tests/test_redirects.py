"""Chains of redirects over stored answers."""

import random

import pytest
from pyspark.sql import functions as F

from webcorpus.config import CrawlOptions
from webcorpus.operators import redirects
from webcorpus.plans import crawl

ANSWERS = "url string, http_status int, location string"
B = "https://h.com"


def walk(answers, url, most):
    """Where a client that follows step by step ends."""
    stored = {u: (s, loc) for u, s, loc in answers}
    seen, at, hops = {url}, url, 0
    while at in stored and stored[at][0] in (301, 302, 303, 307, 308) and (stored[at][1] or "").strip():
        at, hops = stored[at][1], hops + 1
        if at in seen:
            return None, None, redirects.LOOP
        seen.add(at)
    error = redirects.TOO_MANY if hops > most else None if at in stored else redirects.NOT_STORED
    return at, hops, error


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    n = 120
    answers = []
    for i in range(n):
        target = rng.choice([i + 1, i + 1, rng.randrange(n), rng.randrange(n * 2), 7])
        status = rng.choice([200, 301, 302, 303, 307, 308, 304, 404, None] if seed > 1 else [200, 301, 302])
        answers.append((f"{B}/{i}", status, rng.choice([f"{B}/{target}"] * 9 + [None, " "])))
    got = redirects.follow_redirects(spark.createDataFrame(answers, ANSWERS), 5, hot_rows=3).collect()
    leads = {u for u, s, loc in answers if s in (301, 302, 303, 307, 308) and (loc or "").strip()}
    assert {r.url for r in got} == leads and len(got) == len(leads)
    for r in got:
        assert (r.final_url, r.hops, r.error) == walk(answers, r.url, 5), r.url


def test_long_chains_and_loops(spark):
    answers = [(f"{B}/{i}", 301, f"{B}/{i + 1}") for i in range(70)] + [(f"{B}/70", 200, None)]
    answers += [(f"{B}/loop{i}", 302, f"{B}/loop{(i + 1) % 9}") for i in range(9)]
    answers += [(f"{B}/into{i}", 302, f"{B}/into{i + 1}" if i < 12 else f"{B}/loop4") for i in range(13)] + [(f"{B}/self", 308, f"{B}/self")]
    got = {r.url: r for r in redirects.follow_redirects(spark.createDataFrame(answers, ANSWERS), 20).collect()}
    for i in range(70):
        r = got[f"{B}/{i}"]
        assert (r.final_url, r.hops, r.error) == (f"{B}/70", 70 - i, redirects.TOO_MANY if 70 - i > 20 else None)
    for name in [f"loop{i}" for i in range(9)] + [f"into{i}" for i in range(13)] + ["self"]:
        assert (got[f"{B}/{name}"].final_url, got[f"{B}/{name}"].error) == (None, redirects.LOOP)


def test_locations_are_resolved(spark):
    cases = {"../c?x=1#frag": f"{B}/c?x=1", "//o.com/y": "https://o.com/y", "z": f"{B}/a/z", "?q": f"{B}/a/b?q", "mailto:a@b": "mailto:a@b"}
    answers = [(f"{B}/a/b", 301, location) for location in cases]
    for (url, status, location), target in zip(answers, cases.values(), strict=True):
        stored = [(url, status, location), (f"{B}/c?x=1", 200, None)]
        (r,) = redirects.follow_redirects(spark.createDataFrame(stored, ANSWERS)).collect()
        assert r.final_url == target
        assert r.error == {"mailto:a@b": redirects.UNSUPPORTED, f"{B}/c?x=1": None}.get(target, redirects.NOT_STORED)


def test_nothing_redirects(spark):
    df = spark.createDataFrame([("u", 200, "v"), ("v", 304, "u"), (None, None, None)], ANSWERS)
    assert redirects.follow_redirects(df).count() == 0
    assert redirects.follow_redirects(df.limit(0)).count() == 0


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_tasks_get_the_page_at_the_end(spark, limit):
    """Links of a redirected task are resolved against its own URL, in both kinds of join."""
    page = "<p>A page that is long enough to count as content of the crawl, with</p><a href='next'>a link</a>"
    rows = [(f"{B}/old/1", 301, "/mid", None), (f"{B}/mid", 302, "/new/dir/page", None), (f"{B}/new/dir/page", 200, None, page),
            (f"{B}/a", 301, "/b", None), (f"{B}/b", 301, "/a", None), (f"{B}/gone", 301, "/nowhere", None), (f"{B}/plain", 301, None, None)]
    fetches = spark.createDataFrame(rows, ANSWERS + ", html string").withColumns(
        {"content_type": F.lit("text/html"), "error_kind": F.lit(None).cast("string"), "error": F.lit(None).cast("string")})
    names = ["old/1", "mid", "new/dir/page", "a", "gone", "plain", "old/1"]
    tasks = spark.createDataFrame([(i, f"{B}/{n}", 0, 90) for i, n in enumerate(names)], "id bigint, url string, depth int, parent_score int")
    options = CrawlOptions(allowed_domains=[".*"], respect_robots=False, filter_by_language=False)
    ends = redirects.follow_redirects(fetches, options.max_redirects)
    batch = crawl.crawl_batch(tasks, None, fetches, options, redirected=ends, broadcast_bytes=limit, hot_rows=1)
    got = {r.id: (r.url, r.status, r.error_message) for r in batch.outcomes.collect()}
    assert [got[i][1] for i in range(7)] == ["completed"] * 3 + ["failed"] * 3 + ["completed"]
    assert [got[i][2] for i in (3, 4, 5)] == ["Request error: Redirect loop", "Request error: Redirect target not stored", "HTTP 301"]
    assert all(got[i][0] == f"{B}/{n}" for i, n in enumerate(names))
    found = sorted((r.parent_url, r.url) for r in batch.links.collect())
    assert found == sorted([(f"{B}/old/1", f"{B}/old/next")] * 2 + [(f"{B}/mid", f"{B}/next"), (f"{B}/new/dir/page", f"{B}/new/dir/next")])


def test_many_tasks_of_one_url(spark):
    page = "<p>A page that is long enough to count as the content of a page, whatever one thinks of it.</p>"
    fetches = spark.createDataFrame([(f"{B}/{i}", 200, "text/html", page, None, None) for i in range(4)],
                                    "url string, http_status int, content_type string, html string, error_kind string, error string")
    tasks = spark.createDataFrame([(i, f"{B}/{0 if i % 3 else i % 4}", 0, 90) for i in range(200)], "id bigint, url string, depth int, parent_score int")
    options = CrawlOptions(respect_robots=False)
    batch = crawl.crawl_batch(tasks, None, fetches, options, broadcast_bytes=0, hot_rows=10)
    assert sorted(r.id for r in batch.content.collect()) == list(range(200))


def test_no_hops_give_an_empty_frontier(spark):
    df = spark.createDataFrame([(B, "<a href=/x>x</a>", 90)], "url string, html string, parent_score int")
    grown = crawl.frontier_expand(df.select("url"), df, df.select("url").limit(0), CrawlOptions(max_depth=0))
    assert grown.columns == ["url", "priority", "depth", "parent_url"] and grown.count() == 0
