"""Robots rules that change, against a walk over the texts of each origin."""

import datetime as dt
import random
import urllib.robotparser

import pytest
from pyspark.sql import functions as F

from webcorpus.operators import robots

RAW = "origin string, http_status int, body string, fetched_at timestamp"
START = dt.datetime(2024, 1, 1)


def hour(n):
    return None if n is None else START + dt.timedelta(hours=n)


def brute(raw, tasks):
    """(id, allowed) by the last text that is not later than the task."""
    out = []
    for i, url, at in tasks:
        origin, path = url[: url.index("/", 8)], url[url.index("/", 8) :]
        own = [r for r in raw if r[0] == origin and (at is None or r[3] is None or r[3] <= at)]
        body = ""
        if own:
            last = max(r[3] or dt.datetime.min for r in own)
            texts = [r[2] for r in own if (r[3] or dt.datetime.min) == last and r[1] == 200 and r[2] is not None]
            body = max(texts) if texts else ""
        parser = urllib.robotparser.RobotFileParser()
        parser.parse(body.splitlines())
        out.append((i, parser.can_fetch("Bot/1", path)))
    return sorted(out)


def made(seed):
    rng = random.Random(seed)
    text = lambda: "User-agent: *\n" + "".join(f"Disallow: /{rng.choice('abc')}\n" for _ in range(rng.randint(1, 2)))
    raw = [
        (f"https://h{rng.randint(0, 3)}.example.org", rng.choice([200, 200, 200, 404]), rng.choice([text(), text(), "", None]), hour(rng.randint(0, 20)))
        for _ in range(40)
    ]
    raw += [("https://h0.example.org", 200, "User-agent: *\nDisallow: /\n", None), raw[0], raw[1]]
    tasks = [
        (i, f"https://h{rng.randint(0, 5)}.example.org/{rng.choice('abcd')}", hour(rng.choice([None, *range(-2, 24)])))
        for i in range(300)
    ]
    return raw, tasks


@pytest.mark.parametrize("join", [{}, {"broadcast_bytes": 0, "hot_rows": 20}])
def test_same_as_brute_force(spark, join):
    raw, tasks = made(4)
    rules = robots.rules_by_time(spark.createDataFrame(raw, RAW), "Bot/1")
    df = spark.createDataFrame(tasks, "id long, url string, fetched_at timestamp")
    got = robots.with_robots_at(df, rules, ["id"], **join).collect()
    want = brute(raw, tasks)
    assert sorted((r.id, r.allowed) for r in got) == want
    assert {a for _, a in want} == {True, False}


def test_a_fetch_before_a_change_is_judged_by_the_older_text(spark):
    raw = [
        ("https://a.example.org", 200, "User-agent: *\nCrawl-delay: 2\nDisallow: /x", hour(1)),
        ("https://a.example.org", 200, "User-agent: *\nCrawl-delay: 2\nDisallow: /x", hour(2)),
        ("https://a.example.org", 200, "User-agent: *\nCrawl-delay: 5\nAllow: /", hour(3)),
    ]
    rules = robots.rules_by_time(spark.createDataFrame(raw, RAW), "Bot/1")
    assert rules.count() == 2
    times = [(0, hour(0)), (1, hour(1)), (2, hour(2)), (3, hour(3)), (4, None)]
    df = spark.createDataFrame([(i, "https://a.example.org/x", t, "kept") for i, t in times], "id long, url string, fetched_at timestamp, rules string")
    got = robots.with_robots_at(df, rules, ["id"]).orderBy("id").collect()
    assert [(r.allowed, r.robots_delay) for r in got] == [(True, None), (False, 2.0), (False, 2.0), (True, 5.0), (True, 5.0)]
    assert {r.rules for r in got} == {"kept"}


def test_empty_tables(spark):
    none = robots.rules_by_time(spark.createDataFrame([], RAW), "Bot/1")
    df = spark.createDataFrame([(1, "https://a.example.org/x", None), (2, None, hour(1))], "id long, url string, fetched_at timestamp")
    assert [r.allowed for r in robots.with_robots_at(df, none, ["id"]).collect()] == [True, True]
    assert robots.with_robots_at(df.where(F.lit(False)), none, ["id"]).count() == 0
