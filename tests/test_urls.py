"""URL expressions against the standard library."""

import random
from urllib.parse import urldefrag, urljoin, urlparse, unquote

from pyspark.sql import functions as F

from webcorpus.functions import urls

VECTORS = [
    ("https://example.com", "products/item1", "https://example.com/products/item1"),
    ("https://e.com/a/b", "../c/./d", "https://e.com/c/d"),
    ("https://e.com/a/b", "../../../c", "https://e.com/c"),
    ("https://e.com/a?x=1", "?y=2", "https://e.com/a?y=2"),
    ("https://e.com/a/b", "//h.com/x", "https://h.com/x"),
    ("https://e.com/a/b", "#f", "https://e.com/a/b#f"),
    ("https://e.com/a/b", " /x y", "https://e.com/x y"),
    ("http://e.com/", "/a\tb", "http://e.com/ab"),
    ("http://e.com/en/1#top", "/The", "http://e.com/The"),
    ("https://e.com/a", "HTTP://G.com/Z", "HTTP://G.com/Z"),
    ("https://e.com/a", "HTTPS://G.com/Z", "https://G.com/Z"),
    ("https://e.com/a/b", "..", "https://e.com/"),
    ("https://e.com/a/b", ".", "https://e.com/a/"),
    ("https://e.com/a/b", "./", "https://e.com/a/"),
    ("https://e.com/a/b", "x/", "https://e.com/a/x/"),
    ("https://e.com/a/b", "/a//b", "https://e.com/a//b"),
    ("https://e.com/a/b", "a;p?q", "https://e.com/a/a;p?q"),
    ("https://e.com/a/b", "http:x", "http:x"),
    ("https://e.com/a", "mailto:x@y", "mailto:x@y"),
]


def _pairs(count=400):
    rng = random.Random(7)
    pieces = ["a", "b;c", "..", ".", "", "é", "x y", "d.html", ";", "%20"]
    path = lambda: "/".join(rng.choice(pieces) for _ in range(rng.randint(0, 5)))
    ends = ["", "?", "#", "?q=1", "#f", "?q=/../#f/", "?#", "/", "//"]
    bases = ["http://h.com", "https://h.com:8/", "http://h.com/a/b/", "https://h.com/a;x/b?q#f"]
    heads = ["", "/", "//g.org/", "http://g.org/", "https://g.org", "HTTP://G/", " ", "mailto:", "https:"]
    return [(rng.choice(bases), rng.choice(heads) + path() + rng.choice(ends)) for _ in range(count)]


def test_resolve_vectors(spark):
    df = spark.createDataFrame(VECTORS, "base string, href string, want string")
    rows = df.select("*", urls.resolve(F.col("base"), F.col("href")).alias("got")).collect()
    assert [(r.base, r.href, r.got) for r in rows] == [(r.base, r.href, r.want) for r in rows]


def test_resolve_and_normalize_like_the_standard_library(spark):
    df = spark.createDataFrame(_pairs(), "base string, href string")
    base, href = F.col("base"), F.col("href")
    rows = df.select(
        "*", urls.resolve(base, href).alias("url"), urls.normalize(base, href).alias("norm")
    ).collect()
    for r in rows:
        want = urljoin(r.base, r.href)
        assert (r.base, r.href, r.url) == (r.base, r.href, want)
        assert (r.base, r.href, r.norm) == (r.base, r.href, urldefrag(want)[0].rstrip("/"))


def test_parts(spark):
    samples = [
        "https://User:pw@Ex.com:8080/a/b;c?x=1?y#f#g", "HTTP://H", "not-a-url", "", "//h/p",
        "1a:b/c", "https://h.com/%%% x", "mailto:a@b?c#d", "  https://h.com/\t/x\n", "a:b:c",
    ]
    df = spark.createDataFrame([(s,) for s in samples], "url string")
    for r in df.select("url", urls.parts(F.col("url")).alias("p"), urls.origin(F.col("url")).alias("o"),
                       urls.host(F.col("url")).alias("h")).collect():
        want = urlparse(r.url)
        path = want.path + (";" + want.params if want.params else "")
        assert tuple(r.p) == (want.scheme, want.netloc, path, want.query, want.fragment), r.url
        assert r.o == f"{want.scheme}://{want.netloc}"
        assert r.h == want.netloc.split(":")[0].lower()


def test_unquote(spark):
    samples = ["a+b%20c", "%zz%41", "100%", "%C3%A9", "plain", "%", "%2", "%2525"]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    for r in df.select("s", urls.unquote(F.col("s")).alias("got")).collect():
        assert r.got == unquote(r.s)
