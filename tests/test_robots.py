"""Robots rules against the standard library's parser."""

import urllib.robotparser

import pytest
from pyspark.sql import functions as F

from webcorpus.config import CrawlOptions
from webcorpus.operators import robots

# text, agent, path, allowed, delay
VECTORS = [
    ("User-agent: *\nAllow: /\nDisallow: /admin", "B/1", "/admin", True, None),
    ("User-agent: *\nDisallow: *", "B/1", "/x", True, None),
    ("User-agent: *\nDisallow: /*.pdf", "B/1", "/x.pdf", True, None),
    ("User-agent: *\nDisallow: /*.pdf", "B/1", "/*.pdf", False, None),
    ("User-agent: *\n\nDisallow: /", "B/1", "/x", True, None),
    ("User-agent: *\n  \nDisallow: /", "B/1", "/x", False, None),
    ("User-agent: bot\nDisallow: /", "MyBot-X/1", "/x", False, None),
    ("User-agent: *\nCrawl-delay: 3\n\nUser-agent: b\nDisallow: /q", "B/1", "/x", True, None),
    ("User-agent: *\nDisallow:\nDisallow: /", "B/1", "/x", True, None),
    ("User-agent: *\nDisallow: /", "B/1", "", False, None),
    ("User-agent: *\nDisallow: /s?q=", "B/1", "/s?q=1", False, None),
    ("User-agent: *\nDisallow: /c%20d", "B/1", "/c d", False, None),
    ("User-agent:\nDisallow: /", "B/1", "/x", False, None),
    ("\nUser-agent: *\nDisallow: /admin\nDisallow: /private\nAllow: /\n", "T/1", "/page.html", True, None),
    ("\nUser-agent: *\nDisallow: /admin\nDisallow: /private\n", "T/1", "/admin/users", False, None),
    ("\nUser-agent: TestBot\nDisallow: /test\n\nUser-agent: *\nAllow: /\n", "TestBot/1.0", "/test/page", False, None),
    (None, "T/1", "/page.html", True, None),
    ("", "T/1", "/page.html", True, None),
    ("\nUser-agent: *\nCrawl-delay: 5\nDisallow: /admin\n", "TestBot/1.0", "/", True, 5.0),
    ("\nUser-agent: TestBot\nCrawl-delay: 10\n\nUser-agent: *\nCrawl-delay: 2\n", "TestBot/1.0", "/", True, 10.0),
    ("User-agent: *\nCrawl-delay: 0.5", "T/1", "/", True, None),
    ("User-agent: a\nUser-agent: *\nDisallow: /z\nUser-agent: t\nDisallow: /t", "T/1", "/z", True, None),
    ("User-agent: a\nUser-agent: *\nDisallow: /z", "A/1", "/z", False, None),
    ("User-agent: *\nDisallow: /one\n\nUser-agent: *\nDisallow: /two", "T/1", "/two", True, None),
    ("user-AGENT : * # all\r\nDISALLOW: /p # no\r\nRequest-rate: 1/5\r\n", "T/1", "/p/q", False, None),
    ("Sitemap: /s.xml\nDisallow: /a\nUser-agent: *\nSitemap: /t.xml\nDisallow: /b", "T/1", "/a", True, None),
    ("User-agent: *\nRequest-rate: 1/5\nUser-agent: t\nDisallow: /", "T/1", "/a", False, None),
    ("User-agent: t\nRequest-rate: 1/5\nUser-agent: *\nDisallow: /", "T/1", "/a", True, None),
    ("User-agent: *\nDisallow: /a?\nDisallow: /b#", "T/1", "/b", False, None),
    ("User-agent: *\nDisallow: /a%2Fb\nDisallow: /%zz", "T/1", "/%zz/1", False, None),
    ("User-agent: *\nDisallow: /a+b", "T/1", "/a+b", False, None),
    ("User-agent: *\nDisallow: /caf%C3%A9", "T/1", "/café", False, None),
    ("User-agent: *\nDisallow: /x?y#z", "T/1", "/x?y#z", False, None),
    ("User-agent: *\nCrawl-delay: 1\nCrawl-delay: x\nCrawl-delay: 7\nDisallow: /", "T/1", "/", False, 7.0),
]


def _expected(text, agent, url):
    parser = urllib.robotparser.RobotFileParser()
    parser.parse(text.splitlines() if text else [])
    delay = parser.crawl_delay(agent)
    return parser.can_fetch(agent, url), None if delay is None else float(delay)


@pytest.fixture(scope="module")
def decided(spark):
    out = {}
    for agent in {v[1] for v in VECTORS}:
        rows = [(i, f"https://h{i}.com", v[0], v[2]) for i, v in enumerate(VECTORS) if v[1] == agent]
        df = spark.createDataFrame(rows, "id bigint, origin string, body string, path string")
        raw = df.select("origin", F.lit(200).alias("http_status"), "body")
        tasks = df.select("id", F.concat("origin", "path").alias("url"))
        rules = robots.rules_for_agent(robots.parse_robots(raw), agent)
        for r in robots.with_robots(tasks, rules, ["id"]).collect():
            out[r.id] = (r.allowed, r.robots_delay)
    return out


@pytest.mark.parametrize("i", range(len(VECTORS)))
def test_vector(decided, i):
    text, agent, path, allowed, delay = VECTORS[i]
    assert decided[i] == (allowed, delay)
    assert decided[i] == _expected(text, agent, f"https://h{i}.com{path}")


def test_other_status_than_200_allows(spark):
    raw = spark.createDataFrame(
        [("https://a.com", 404, "User-agent: *\nDisallow: /"), ("https://b.com", 200, "User-agent: *\nDisallow: /")],
        "origin string, http_status int, body string",
    )
    tasks = spark.createDataFrame([(1, "https://a.com/x"), (2, "https://b.com/x"), (3, "https://c.com/")], "id bigint, url string")
    rules = robots.rules_for_agent(robots.parse_robots(raw), "T/1")
    got = {r.id: r.allowed for r in robots.with_robots(tasks, rules, ["id"]).collect()}
    assert got == {1: True, 2: False, 3: True}


def test_broadcast_and_salted_join_agree(spark):
    raw = spark.createDataFrame(
        [("https://a.com", 200, "User-agent: *\nDisallow: /1"), ("https://b.com", 200, "User-agent: *\nDisallow: /2")],
        "origin string, http_status int, body string",
    )
    tasks = spark.range(300).select(
        "id",
        F.concat(
            F.when(F.col("id") % 3 == 0, "https://b.com/").when(F.col("id") % 50 == 1, "x").otherwise("https://a.com/"),
            (F.col("id") % 7).cast("string"),
        ).alias("url"),
    )
    rules = robots.rules_for_agent(robots.parse_robots(raw), "T/1")
    small = robots.with_robots(tasks, rules, ["id"])
    large = robots.with_robots(tasks, rules, ["id"], broadcast_bytes=0, hot_rows=20)
    assert sorted(small.collect()) == sorted(large.collect())
    assert large.count() == 300


def test_gate_and_delay(spark):
    raw = spark.createDataFrame(
        [("https://a.com", 200, "User-agent: *\nCrawl-delay: 0\nDisallow: /n"), ("https://b.com", 200, "User-agent: *\nCrawl-delay: 4")],
        "origin string, http_status int, body string",
    )
    tasks = spark.createDataFrame([(1, "https://a.com/x"), (2, "https://b.com/x"), (3, "https://a.com/n")], "id bigint, url string")
    rules = robots.rules_for_agent(robots.parse_robots(raw), "T/1")
    gated = robots.robots_gate(tasks, rules, CrawlOptions(), ["id"])
    assert {r.id: (r.allowed, r.delay) for r in gated.collect()} == {1: (True, 1.0), 2: (True, 4.0), 3: (False, 1.0)}
    off = robots.robots_gate(tasks, rules, CrawlOptions(respect_robots=False), ["id"])
    assert {r.id: (r.allowed, r.delay) for r in off.collect()} == {i: (True, None) for i in (1, 2, 3)}


def test_repeated_origins(spark):
    import pytest
    from pyspark.errors import PySparkException
    from py4j.protocol import Py4JJavaError

    columns = "origin string, http_status int, body string"
    same = spark.createDataFrame([("https://a", 200, "User-agent: *")] * 2 + [("https://b", 404, "x"), ("https://b", 500, "y")], columns)
    assert robots.parse_robots(same).count() == 2
    for other in (("https://a", 200, "User-agent: x"), ("https://a", 404, None)):
        with pytest.raises((PySparkException, Py4JJavaError)):
            robots.parse_robots(same.union(spark.createDataFrame([other], columns))).collect()
    dated = spark.createDataFrame(
        [("https://a", 200, "User-agent: *\nDisallow: /old", 1), ("https://a", 200, "User-agent: *\nDisallow: /new", 2)], columns + ", fetched_at int")
    (row,) = robots.flat_rules(robots.parse_robots(dated)).collect()
    assert row.path == "/new"
