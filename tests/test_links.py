"""Link discovery on single pages."""

from pyspark.sql import functions as F

from webcorpus.config import CrawlOptions
from webcorpus.functions import linkrules
from webcorpus.operators import links

TEST = CrawlOptions(allowed_domains=[r".*"], min_parent_score=40)
BASE = "https://example.com"


def discover(spark, html, base=BASE, score=80, depth=0, options=TEST):
    df = spark.createDataFrame([(base, html, score, depth)], "url string, html string, parent_score int, depth int")
    return links.discover_links(df, options).orderBy("position").collect()


def found(spark, html, **kw):
    return [r.url for r in discover(spark, html, **kw)]


def test_absolute_links(spark):
    html = """<ul><li><a href="https://maps.example.org/rivers?id=4">Rivers</a>
      <li><a href='http://example.com/lakes'>Lakes</a><li><a href=https://alps.example.net/>Alps</a></ul>"""
    assert found(spark, html) == ["https://maps.example.org/rivers?id=4", "http://example.com/lakes", "https://alps.example.net"]


def test_relative_links(spark):
    html = '<a href="/up">u</a><a href="down/left">d</a><a href="../right">r</a><a href="//cdn.example.org/x">c</a>'
    got = found(spark, html, base=BASE + "/a/b/c")
    assert got == [BASE + "/up", BASE + "/a/b/down/left", BASE + "/a/right", "https://cdn.example.org/x"]


def test_fragments_are_dropped(spark):
    html = '<a href="https://example.com/page#s1">1</a><a href="https://example.com/page#s2">2</a>'
    assert found(spark, html) == ["https://example.com/page"]


def test_only_http_schemes(spark):
    hrefs = ["tel:+123", "HTTP://example.com/a", "data:text/html,x", "sms:1", "https://example.com/b", "file:///etc/hosts"]
    html = "".join(f'<a href="{h}">x</a>' for h in hrefs)
    assert [u.lower() for u in found(spark, html)] == ["http://example.com/a", "https://example.com/b"]


def test_duplicates_keep_the_first(spark):
    html = '<a href="/b">1</a>' + '<a href="/page">x</a>' * 3 + '<a href="/b/">2</a>'
    assert found(spark, html) == [BASE + "/b", BASE + "/page"]


def test_malformed_html(spark):
    html = '<table><tr><td><a href="/open"><b>never closed<td><a href="/next">x</i></table></p>'
    assert found(spark, html) == [BASE + "/open", BASE + "/next"]


def test_nothing_to_find(spark):
    for html in ("", "   ", None, "<html><body><p>Just text.</p></body></html>"):
        assert found(spark, html) == []


def test_row_format(spark):
    (row,) = discover(spark, '<a href="https://example.com/page">P</a>', score=75, depth=1)
    assert (row.url, row.parent_url, row.depth, row.priority) == ("https://example.com/page", BASE, 2, 60)


def test_gates(spark):
    html = '<a href="/page">P</a>'
    assert found(spark, html, score=20) == []
    assert found(spark, html, score=None) == []
    assert found(spark, html, depth=3) == []
    assert found(spark, html, score=40, depth=2) == [BASE + "/page"]


def test_priority(spark):
    df = spark.createDataFrame([(s,) for s in (100, 90, 80, 79, 70, 60, 59, 50, 40, 0)], "s int")
    assert df.limit(1).select(linkrules.priority(F.lit(None).cast("int"))).first()[0] == 40
    got = {r.s: r.p for r in df.select("s", linkrules.priority(F.col("s")).alias("p")).collect()}
    assert got == {100: 90, 90: 80, 80: 70, 79: 64, 70: 55, 60: 55, 59: 49, 50: 40, 40: 40, 0: 40}


def test_blocked_extensions(spark):
    html = "".join(f'<a href="{u}">x</a>' for u in (
        "/page.html", "/image.jpg", "/doc.pdf", "/video.mp4", "/A.PDF", "/a.pdf?x=1", "/a?f=.pdf",
        "/a.pdf;v=1", "/a;b.pdf", "/x.tar.gz", "/a.pdf/b", "https://files.zip"))
    assert found(spark, html) == [BASE + p for p in ("/page.html", "/a?f=.pdf", "/a;b.pdf", "/a.pdf/b")] + ["https://files.zip"]


def test_blocked_patterns(spark):
    html = "".join(f'<a href="{u}">x</a>' for u in (
        "/ok", "/LOGIN", "/editor", "/api/v1", "/apix", "?page=1", "?page=2", "?a=1&amp;sort=x", "/x/cart"))
    assert found(spark, html) == [BASE + "/ok", BASE + "/apix", BASE + "?page=1"]


def test_default_domains(spark):
    hosts = ["en.wikipedia.org", "wikipedia.org", "github.com", "github.com.evil.com", "docs.python.org",
             "x.github.com", "GITHUB.com", "arxiv.org:80", "a.readthedocs.io"]
    html = "".join(f'<a href="https://{h}/x">x</a>' for h in hosts)
    kept = [u.split("/")[2] for u in found(spark, html, options=CrawlOptions())]
    assert kept == ["en.wikipedia.org", "github.com", "docs.python.org", "a.readthedocs.io"]


def test_anchor_syntax(spark):
    html = """<a class=x data-href="/no" href='/b?x=1&amp;y=2'><A HREF=/c/d><a title="href=/no > x" href="/e">
      <abbr href="/no"><!-- <a href="/no"> --><script>"<!--"; '<a href="/no">'</script><a href="/f">
      <a hreflang=en href = "/g"><a href><a name=x><a href="  "><style>a{}</style><a
      href="/h"><noscript><a href="/i"></noscript><a href="/a b&#233;">"""
    assert found(spark, html) == [BASE + p for p in ("/b?x=1&y=2", "/c/d", "/e", "/f", "/g", "/h", "/i", "/a bé")]


def test_cap_counts_final_links(spark):
    html = "".join(f'<a href="/{i // 2}">x</a><a href="/login{i}">y</a>' for i in range(300))
    df = spark.createDataFrame([(BASE, html, 80, 0)], "url string, html string, parent_score int, depth int")
    capped = links.cap_links(links.discover_links(df, TEST), 100)
    assert sorted(int(r.url.rsplit("/", 1)[1]) for r in capped.collect()) == list(range(100))


def test_no_shuffle(spark):
    df = spark.createDataFrame([(BASE, "", 80, 0)], "url string, html string, parent_score int, depth int")
    plan = links.discover_links(df, TEST)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_adversarial_pages_finish(spark):
    """Long unclosed or repetitive input must neither overflow the stack nor go quadratic."""
    pages = [
        "<a " + "x='1' " * 50_000 + 'href="/end">', "<script" * 100_000, "<!--" * 100_000,
        "<a href='" + "x" * 1_000_000, '<a "' * 100_000, "<nav><footer>" * 50_000,
        "<a href=/x>" * 50_000, "&#" * 200_000, "<h1>" * 100_000, "<meta " * 100_000,
    ]
    for html in pages:
        urls_found = found(spark, html)
        assert len(urls_found) <= 1
