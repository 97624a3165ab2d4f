"""Content extraction on single pages and over sites."""

import html as html_lib

from pyspark.sql import functions as F

from webcorpus.config import CrawlOptions
from webcorpus.functions import html
from webcorpus.operators import content

URL = "https://example.com/page"


def extract(spark, page, options=CrawlOptions(), url=URL):
    df = spark.createDataFrame([(url, page)], "url string, html string")
    return content.extract_content(df, options).first()


def test_title_text_and_language(spark):
    row = extract(spark, """<head><title>Tides | Harbour notes</title><meta name=keywords content="sea"></head>
      <h1>Spring tides at the pier</h1><p>Boats leave two hours before high water.<p>The ferry waits for nobody.""")
    assert row.url == URL and row.title == "Spring tides at the pier" and row.language is None
    assert row.text == "Spring tides at the pier\nBoats leave two hours before high water.\nThe ferry waits for nobody."


def test_no_content(spark):
    for page in ("<html><head><title>Empty</title></head><body></body></html>", "", "  \n", None):
        assert extract(spark, page) is None


def test_malformed_page(spark):
    page = "<div><p>A sentence whose element never ends, <b>nor does the bold one in it"
    assert extract(spark, page).text == "A sentence whose element never ends, nor does the bold one in it"


def test_boilerplate_is_dropped(spark):
    row = extract(spark, """<title>Bread</title><nav><a href=/>Start</a> <a href=/r>Recipes</a></nav><aside>Newsletter</aside>
      <main><h1>Rye with caraway</h1><p>Knead for ten minutes, then let the dough rest.</p></main><footer>Baked by hand</footer>""")
    assert row.text == "Rye with caraway\nKnead for ten minutes, then let the dough rest."


def test_nested_regions_go_as_wholes(spark):
    page = """<DIV class="comments"><div>one<div>two</div></div><ul><li>three</ul></div><p>kept 1</p><nav><nav>x<nav>y</nav></nav>z</nav>
      <p>kept 2</p><ul id=comments><li><ul><li>deep</ul>flat</ul><p>kept 3</p><aside><div>a</div><aside>b</aside>c</aside><p>kept 4</p>
      <footer><footer >x</footer>open to the end<nav>too"""
    df = spark.createDataFrame([(URL, page)], "url string, html string")
    assert " ".join(content.with_blocks(df).first().blocks) == "kept 1 kept 2 kept 3 kept 4"
    deep = "<nav>" * 30 + "in" + "</nav>" * 30 + "out"
    df = spark.createDataFrame([(URL, deep)], "url string, html string")
    assert "out" in content.with_blocks(df).first().blocks


def test_page_of_boilerplate_only_keeps_it(spark):
    row = extract(spark, "<nav>" + "Only navigation, yet it is all the page has to say at all." + "</nav>")
    assert row.text.startswith("Only navigation")


def test_declared_language(spark):
    body = "<body><p>Snow fell over the valley until the last train had to turn back."
    assert extract(spark, "<html class=x lang='DE-at'>" + body).language == "de"
    assert extract(spark, "<head><meta content='sk, cs' http-equiv=Content-Language></head>" + body).language == "sk"
    assert extract(spark, body).language is None


def test_paragraphs_stay_apart(spark):
    page = "<p>Uno.<p>Due.</p><div>Tre<br>quattro</div>"
    assert extract(spark, page, CrawlOptions(min_content_chars=10)).text.split("\n") == ["Uno.", "Due.", "Tre", "quattro"]


def test_minimum_length_is_that_of_the_returned_text(spark):
    for n, kept in ((59, False), (60, True)):
        row = extract(spark, f"<p>{'é' * n}</p>", CrawlOptions(min_content_chars=60), "http://h.com")
        assert (row is not None) == kept
    # with metadata lines (42 characters here) these are part of it
    for n, kept in ((17, False), (18, True)):
        row = extract(spark, f"<p>{'é' * n}</p>", CrawlOptions(min_content_chars=60, metadata_header=True), "http://h.com")
        assert (row is not None) == kept
    assert extract(spark, "<p>hi</p>", url="https://example.com/a") is None


def test_tables_lists_and_breaks(spark):
    page = """<table><tr><td>a<td>b</td></tr><tr><th>c</th>
      <th>d</th></tr></table><ul><li>one<li>two</ul>x<br>y<template>no</template><noscript>no</noscript>
      <div class="post-comments wide">spam</div><section id="comments">spam</section><div class="commentary">kept</div>"""
    df = spark.createDataFrame([(URL, page)], "url string, html string")
    assert content.with_blocks(df).first().blocks == ["a | b", "c | d", "one", "two", "x", "y", "kept"]


def test_metadata(spark):
    page = """<head><meta content='Jo &amp; Co' name="author"><meta property=article:published_time content="2024-01-02T03:04:05Z">
      </head><h1> <b>A</b> &lt;b&gt; </h1><time datetime="2020-01-01">x</time>""" + "<p>" + "word " * 20
    row = extract(spark, page)
    assert (row.title, row.author, row.date) == ("A <b>", "Jo & Co", "2024-01-02")
    other = extract(spark, '<title>T&eacute;</title><h1>a</h1><h1>b</h1><time datetime="2020-01-01T00:00">x</time><p>' + "word " * 20)
    assert (other.title, other.author, other.date) == ("Té", None, "2020-01-01")
    header = extract(spark, page, CrawlOptions(metadata_header=True))
    assert header.text.startswith(
        "---\ntitle: A <b>\nauthor: Jo & Co\nurl: https://example.com/page\nhostname: example.com\n"
        "date: 2024-01-02\n---\nA <b>")


def test_marked_metadata(spark):
    text = "<p>" + "word " * 20
    cases = [
        ('<script type="application/ld+json">{"datePublished":"2024/03/15","author":[{"@type":"Person","name":"Zo\\u00eb Q."}]}</script>', "Zoë Q.", "2024-03-15"),
        ('<script type=application/ld+json>{"author": "Plain \\"Name\\"", "datePublished": "no date"}</script><time datetime=20240102>', 'Plain "Name"', "2024-01-02"),
        ('<div itemprop="author"><span itemprop="name">In &amp; Out</span></div><time itemprop=datePublished datetime="15 March 2024">', "In & Out", "2024-03-15"),
        ('<a class=x rel="author" href="/">Link Er</a><span itemprop="datePublished">Sept. 3rd, 1999</span>', "Link Er", "1999-09-03"),
        ('<a rel="author nofollow"></a><time datetime="2024-02-31">', None, None),
        ('<meta name=date content="Friday, 1 April 2022 10:00">', None, "2022-04-01"),
        ('<script type="application/ld+json">{"author": {"name": "Never closed"', "Never closed", None),
    ]
    for markup, author, date in cases:
        row = extract(spark, text + markup)
        assert (row.author, row.date) == (author, date), markup


def test_unescape(spark):
    samples = ["a &amp; b &lt;x&gt; &#65;&#x42;&#X43;", "&copy;&middot;&nbsp;&eacute;&Eacute;&hearts;", "&amp;lt; &#38;amp;",
               "no reference", "&", "&&amp;&", "&#233;&#128512;&#65279;", "&quot;&apos;", "&#146;&#x80;&#150;",
               "&copy &nbsp! &lt", "&NewLine;&equals;&Tab;&bne;", "&amp;&notin;&not;&not "]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    for r in df.select("s", html.unescape(F.col("s")).alias("got")).collect():
        assert r.got == html_lib.unescape(r.s)
    odd = spark.createDataFrame([("&bogus; &copy2 ?a=1&copy=2 &#0;&#xD800;&#99999999999;|&#65",)], "s string")
    assert odd.select(html.unescape(F.col("s"))).first()[0] == "&bogus; &copy2 ?a=1&copy=2 |A"


def _site(spark):
    filler = "A paragraph that is long enough to count as content of the page"
    rows = [(f"https://big.com/{i}", f"<p>Subscribe now</p><p>{filler} {i}</p>" + ("<p>Half</p>" if i % 2 else "")) for i in range(10)]
    rows += [(f"https://two.com/{i}", f"<p>Shared on two pages only, and long enough to be content</p>") for i in range(2)]
    rows += [(f"https://same.com/{i}", "<p>Every page of this site has this one text and nothing else</p>") for i in range(4)]
    return spark.createDataFrame(rows, "url string, html string")


def test_site_templates(spark):
    pages, options = _site(spark), CrawlOptions()
    for join in ({}, {"broadcast_bytes": 0, "hot_rows": 3}):
        templates = content.site_templates(pages, options, **join)
        assert {r.host: len(r.templates) for r in templates.collect()} == {"big.com": 2, "same.com": 1}
        texts = {r.url: r.text for r in content.extract_content(pages, options, templates, **join).collect()}
        assert len(texts) == 16
        assert texts["https://big.com/1"] == "A paragraph that is long enough to count as content of the page 1"
        assert texts["https://two.com/0"].startswith("Shared on two")
        assert texts["https://same.com/0"].startswith("Every page")


def test_adversarial_pages_finish(spark):
    pages = ["<p " + "x='1' " * 50_000 + ">text", "<nav>" * 100_000, "<script" * 100_000, "<div class=" * 50_000,
             "<h1>" * 100_000, "<meta " * 100_000, "&" * 300_000, "<p>" * 200_000, "<title>" * 100_000, '<p "' * 100_000,
             "<div class='comments'>" * 50_000, "<div class='comments'><div" * 50_000, "<nav>" * 40_000 + "</nav>" * 40_000,
             "<nav><div>" * 40_000 + "<nav <", "<script type=application/ld+json>" * 30_000, "<a rel=author><b" * 50_000,
             "<div id=comments>" + "<div></div>" * 80_000, "<span itemprop=author>" * 40_000, '"author": {' * 50_000]
    df = spark.createDataFrame([(f"https://h.com/{i}", p) for i, p in enumerate(pages)], "url string, html string")
    assert content.with_content(df, CrawlOptions()).count() == len(pages)
    content.with_content(df, CrawlOptions()).write.format("noop").mode("overwrite").save()
