"""Boilerplate regions of any depth, and lists of links told by their neighbours."""

import random
import re
import time
from html.parser import HTMLParser

from pyspark.sql import functions as F

from webcorpus.config import CrawlOptions
from webcorpus.functions import density, html
from webcorpus.functions.scan import scan
from webcorpus.operators import content

URL = "https://alone.example.com/page"


def pages(spark, *texts):
    return spark.createDataFrame([(i, f"{URL}/{i}", t) for i, t in enumerate(texts)], "page_id int, url string, html string")


def blocks(spark, page):
    return content.with_blocks(pages(spark, page)).first().blocks


class Reader(HTMLParser):
    """Words outside of regions, as an event parser sees them."""

    def __init__(self):
        super().__init__()
        self.words, self.open = [], []

    def handle_starttag(self, tag, attrs):
        starts = tag in ("nav", "footer", "aside") or (tag in ("div", "ul", "section", "ol") and dict(attrs).get("id") == "comments")
        if self.open:
            if tag == self.open[0]:
                self.open.append(tag)
        elif starts:
            self.open.append(tag)

    def handle_endtag(self, tag):
        if self.open and tag == self.open[0]:
            self.open.pop()

    def handle_data(self, data):
        if not self.open:
            self.words += data.split()


def test_random_nesting(spark):
    rng = random.Random(1)
    tags = ["<nav>", "</nav>", "<div>", "</div>", '<div id="comments">', '<ul class=x id="comments" >', "<ul>", "</ul >", "<aside class='a>b'>", "</aside>", "<p>", "<b>", "<section>", "</section>"]
    texts = []
    for n in range(150):
        rows = [rng.choice(tags) + f" w{n}x{i} " for i in range(rng.randrange(40))]
        texts.append("start " + "".join(rows))
    got = pages(spark, *texts).select("page_id", html.without_boilerplate(F.col("html")).alias("h")).collect()
    for r in got:
        reader = Reader()
        reader.feed(texts[r.page_id])
        reader.close()
        assert re.sub(r"<[^>]*>", " ", r.h.replace("a>b", "")).split() == reader.words, texts[r.page_id]


def test_deeply_nested_regions_leave_nothing(spark):
    for n in (9, 13, 200, 3000):
        comments = '<div id="comments">' + "<div>leak" * n + "</div>leak" * n + "</div>"
        assert blocks(spark, f"<p>kept 1</p>{comments}<p>kept 2</p>") == ["kept 1", "kept 2"]
        navigation = "<nav>leak" * n + "</nav>" * n
        assert blocks(spark, f"<p>kept 1</p>{navigation}<p>kept 2") == ["kept 1", "kept 2"]


def test_many_regions_take_little_time(spark):
    hostile = ["<nav>x</nav>y" * 60_000, "<div id=comments>" + "<div>" * 60_000, "<aside>" * 60_000 + "</aside>" * 60_000,
               "<nav <nav " * 60_000, '<nav "' * 60_000, "</nav>" * 100_000 + "<footer>", "<div id=comments></div><div>" * 30_000]
    start = time.time()
    got = pages(spark, *hostile).select("page_id", F.length(html.without_boilerplate(F.col("html"))).alias("n")).collect()
    sizes = {r.page_id: r.n for r in got}
    assert sizes[0] == 60_000 and sizes[1] == 0 and sizes[2] == 0
    assert time.time() - start < 60


def test_scan(spark):
    rows = spark.createDataFrame([(list(range(n)),) for n in (0, 1, 2, 3, 4, 5, 9, 10, 100)] + [(None,)], "xs array<int>")
    running = scan(F.col("xs"), F.lit(0), lambda s, x: (s + x, s + x), "int")
    for r in rows.select("xs", running.alias("got")).collect():
        assert r.got == ([sum(r.xs[: i + 1]) for i in range(len(r.xs))] if r.xs is not None else []) or r.xs is None


MENU = "".join(f'<li><a href="/{w}">{w}</a>' for w in ("Start", "Recipes", "Travel", "About us", "Contact"))
TEXT = "Knead the dough for ten minutes, cover it with a cloth and let it rest near the oven."


def test_menus_without_nav_go(spark):
    page = f"""<title>Bread</title><div class="top"><ul>{MENU}</ul></div><h1>Rye with caraway</h1><p>{TEXT}</p>
      <p>{TEXT} See <a href=/x>another loaf</a> for more.</p><table><tr><td><a href=/a>One</a><td><a href=/b>Two</a></tr>
      <tr><td><a href=/c>Three</a></tr><tr><td><a href=/d>Four</a></table><div>{MENU}</div>"""
    assert blocks(spark, page) == ["Rye with caraway", TEXT, f"{TEXT} See another loaf for more."]


def test_labels_between_links_go_with_them(spark):
    page = f"<ul>{MENU}</ul><h3>More</h3><ul>{MENU}</ul><h1>Title</h1><p>{TEXT}"
    assert blocks(spark, page) == ["Title", TEXT]


def test_links_in_texts_stay(spark):
    lone = f"<p>{TEXT}<p><a href=/next>Read the second part</a><p>{TEXT}<p><a href=/a>A</a><p><a href=/b>B</a><p>{TEXT}"
    assert len(blocks(spark, lone)) == 6
    cited = "".join(f"<p>{TEXT} <a href=/{i}>{'source ' * 30}</a>" for i in range(5))
    assert len(blocks(spark, cited)) == 5
    # a page of links only keeps them
    assert len(blocks(spark, f"<ul>{MENU}</ul>")) == 5


def test_anchors_over_several_blocks(spark):
    cards = "".join(f"<a href=/{i}><div>Card {i}</div><div>Price {i}</div></a>" for i in range(4))
    assert blocks(spark, f"{cards}<h1>Shop</h1><p>{TEXT}") == ["Shop", TEXT]
    never_closed = f"<p>{TEXT}<a href=/x>one<a href=/y>two</a><p>{TEXT}"
    assert len(blocks(spark, never_closed)) == 2
    marks = f"<p>{density.OPENED}a{density.CLOSED} {TEXT}"
    assert blocks(spark, marks) == [f"a {TEXT}"]


def brute(kinds):
    """Runs of link blocks between text blocks, by splitting."""
    out, run = [False] * len(kinds), []
    for i, kind in [*enumerate(kinds), (len(kinds), 1)]:
        if kind == 1:
            links = [j for j in run if kinds[j] == 2]
            if len(links) >= density.RUN:
                for j in run:
                    out[j] = links[0] <= j <= links[-1]
            run = []
        else:
            run.append(i)
    return out


def test_runs_of_links(spark):
    rng = random.Random(2)
    cases = [[rng.choice([0, 1, 2, 2]) for _ in range(rng.randrange(25))] for _ in range(200)]
    made = {0: ("short", 0), 1: ("a" * 60, 5), 2: ("linked", 6)}
    rows = [(c, [made[k][0] for k in c], [made[k][1] for k in c]) for c in cases]
    df = spark.createDataFrame(rows, "kinds array<int>, texts array<string>, linked array<int>")
    for r in df.select("kinds", density.is_list_of_links(F.col("texts"), F.col("linked")).alias("got")).collect():
        assert r.got == brute(r.kinds)


def test_seven_kinds_of_pages_lose_no_paragraph(spark):
    paragraph = "The ferry leaves two hours before high water and does not wait for anybody."
    cases = [
        f"<html lang=en><title>T</title><h1>H</h1><p>{paragraph}</p><p>{paragraph} Again.</p>",
        f"<header><h1>H</h1></header><nav>{MENU}</nav><article><p>{paragraph}</p></article><footer>f</footer>",
        f"<div><p>{paragraph}<div><span>{paragraph} Twice.",
        f"<p><a href=/a>Link</a> {paragraph} <a href=/b>Link</a></p>",
        f"<ul><li>{paragraph}<li>{paragraph} Item.</ul>",
        f"<table><tr><td>{paragraph}</td><td>{paragraph} Cell.</td></tr></table>",
        f"<p>{paragraph}</p><a href=/more>{paragraph} Linked.</a><p>{paragraph} Last.</p>",
    ]
    found = content.extract_content(pages(spark, *cases), CrawlOptions()).collect()
    assert len(found) == 7
    for r in found:
        assert r.text.count("The ferry leaves") == cases[int(r.url.rsplit("/", 1)[1])].count("The ferry leaves")


def test_states_are_those_of_a_plain_fold(spark):
    from webcorpus.functions.scan import states

    rows = [(list(range(-n, n)),) for n in (0, 1, 2, 7, 40)] + [(None,)]
    df = spark.createDataFrame(rows, "items array<int>")
    got = df.select("items", states(F.col("items"), lambda state, item: F.when(item % 3 == 0, item).otherwise(state + 1)).alias("states")).collect()
    for r in got:
        state, want = 0, []
        for item in r.items or []:
            state = item if item % 3 == 0 else state + 1
            want.append(state)
        assert (r.states or []) == want


def test_leaf_elements_and_mark_characters_change_no_region(spark):
    cases = {
        "<div a='x\x1e'>q\x1f<div>p</div>\x1a0<div class=comments>z<div>\x1e</div></div>\x1et\x1a2</div>": "<div a='x\x1e'>q\x1f<div>p</div>\x1a0\x1et\x1a2</div>",
        "</div><nav><div></nav>x</div><div class='a comments b'><ul><li><div>": "</div>x</div>",
        "<DIV ID=comments><div>a<Div data-comment=1>b</dIV></div>c</div >d</nav>": "d</nav>",
        "<ul><ul class='comment-list'><ul></ul>x</ul>y</ul>": "<ul>y</ul>",
        '<div class="comment"></div>a<div>b<div>c</div></div><footer>': "a<div>b<div>c</div></div>",
    }
    df = spark.createDataFrame([(k,) for k in cases], "html string")
    for r in df.select("html", html.without_boilerplate(F.col("html")).alias("got")).collect():
        assert r.got == cases[r.html]
