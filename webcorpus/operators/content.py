"""Content extraction over page tables.

A page stays one row throughout: its blocks are an array column. Finding site templates
shuffles counts of (host, hash of a block), not text; leaving them out shuffles the blocks
by host only when the templates measure too large to broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webcorpus.config import CrawlOptions
from webcorpus.functions import html, urls
from webcorpus.functions.binding import computed_once
from webcorpus.plans.skew import lookup_join
from webcorpus.plans.storage import stage

_PAGE_MARK = b""
#: Least share of a site's pages that makes a block a template: it bounds their number.
MIN_TEMPLATE_SHARE = 0.01


def with_blocks(pages: DataFrame) -> DataFrame:
    """Adds `blocks`: the text blocks outside the boilerplate regions and lists of links;
    where that leaves nothing the lists stay, and where the regions hold everything all
    visible blocks do."""
    main = pages.withColumn("__markup", html.without_boilerplate(F.col("html")))
    main = main.withColumn("__main", html.scored_blocks(F.col("__markup"))).drop("__markup")
    main = main.withColumn("__own", F.filter("__main", lambda block: ~block["linked"]))
    return main.withColumn(
        "blocks",
        F.when(F.size("__own") > 0, F.col("__own")["text"])
        .when(F.size("__main") > 0, F.col("__main")["text"])
        .otherwise(html.blocks(html.visible(F.col("html")))),
    ).drop("__main", "__own")


def explode_blocks(pages: DataFrame, *keys: str) -> DataFrame:
    """One row per block, in page order."""
    rows = with_blocks(pages).select(*keys, F.posexplode_outer("blocks").alias("pos", "block"))
    return rows.where(F.col("block").isNotNull())


def block_key(block: Column) -> Column:
    """128-bit stand-in for a block's text."""
    return F.unhex(F.md5(block))


def site_templates(pages: DataFrame, options: CrawlOptions, **join) -> DataFrame:
    """Blocks a site repeats: `(host, templates)`.

    A template occurs on at least `template_min_pages` pages and on at least
    `template_share` of the pages of its host. A host therefore has at most
    (blocks per page / share) of them.
    """
    return templates_of(with_blocks(pages.select("url", "html")), options, **join)


def templates_of(pages: DataFrame, options: CrawlOptions, **join) -> DataFrame:
    """`site_templates` of pages `(url, blocks)`. The lists of a host stay small because
    `template_share` is bounded from below."""
    if not MIN_TEMPLATE_SHARE <= options.template_share <= 1:
        raise ValueError(f"template_share must be from {MIN_TEMPLATE_SHARE} to 1")
    keys = F.array_distinct(F.transform("blocks", block_key))
    none = F.array().cast("array<binary>")
    # every page also emits an empty key: its count is the page count of the host
    counted = (
        pages.select(
            urls.host(F.col("url")).alias("host"),
            F.explode_outer(F.concat(F.array(F.lit(_PAGE_MARK)), F.coalesce(keys, none))).alias("key"),
        )
        .groupBy("host", "key")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= options.template_min_pages)
    )
    counted = stage(counted, "block-counts")
    hosts = counted.where(F.col("key") == F.lit(_PAGE_MARK)).select(
        "host", F.col("n").alias("pages")
    )
    repeated = counted.where(F.col("key") != F.lit(_PAGE_MARK))
    return (
        lookup_join(repeated, hosts, "host", ["key"], "inner", **join)
        .where(F.col("n") >= F.col("pages") * options.template_share)
        .groupBy("host")
        .agg(F.array_sort(F.collect_list("key")).alias("templates"))
    )


def without_templates(pages: DataFrame, templates: DataFrame, **join) -> DataFrame:
    """Pages whose `blocks` lost the templates of their site; a page made of nothing
    else keeps them."""
    keyed = pages.withColumn("host", urls.host(F.col("url")))
    joined = lookup_join(keyed, templates, "host", ["url"], "left", **join)
    kept = F.filter(
        "blocks", lambda block: ~F.array_contains(F.col("templates"), block_key(block))
    )
    return (
        joined.withColumn(
            "__kept", F.when(F.col("templates").isNull(), F.col("blocks")).otherwise(kept)
        )
        .withColumn("blocks", F.when(F.size("__kept") > 0, F.col("__kept")).otherwise(F.col("blocks")))
        .select(*pages.columns)
    )


def with_metadata(pages: DataFrame) -> DataFrame:
    """Adds title, language, author and date."""
    markup, found, tags = F.col("__markup"), F.col("__texts"), F.col("__metas")
    return (
        pages.withColumn("__markup", html.without_raw_text(F.col("html")))
        .withColumn("__data", html.linked_data(F.col("html")))
        .withColumns({"__texts": html.texts(markup), "__metas": html.metas(markup)})
        .withColumns(
            {
                "title": html.title(found),
                "language": html.language(found, tags),
                "author": html.author(tags, markup, F.col("__data")),
                "date": html.date(found, tags, markup, F.col("__data")),
            }
        )
        .drop("__markup", "__data", "__texts", "__metas")
    )


def _with_header(text: Column) -> Column:
    """The text below a block of metadata lines."""
    fields = {
        "title": F.col("title"),
        "author": F.col("author"),
        "url": F.col("url"),
        "hostname": urls.host(F.col("url")),
        "date": F.col("date"),
    }
    lines = [F.concat(F.lit(f"{name}: "), value) for name, value in fields.items()]
    return F.concat_ws("\n", F.lit("---"), *lines, F.lit("---"), text)


def with_content(
    pages: DataFrame, options: CrawlOptions, templates: DataFrame | None = None, **join
) -> DataFrame:
    """Adds `text` and the metadata to pages `(url, html, ...)`; `text` is NULL where it
    would have fewer than `min_content_chars` characters. The html column is dropped."""
    return _with_text(_read(pages), options, templates, **join)


_FIELDS = ["title", "language", "author", "date", "blocks"]


def _read(pages: DataFrame) -> DataFrame:
    """Pages with blocks and metadata in place of html."""
    rest = [c for c in pages.columns if c != "html"]
    return with_metadata(with_blocks(pages)).select(*rest, *_FIELDS)


def _with_text(
    read: DataFrame, options: CrawlOptions, templates: DataFrame | None, **join
) -> DataFrame:
    rest = [c for c in read.columns if c not in _FIELDS]
    if templates is not None:
        read = without_templates(read, templates, **join)
    bare = F.array_join("blocks", "\n")
    read = read.withColumn("__text", F.when(bare != "", bare))
    shown = _with_header(F.col("__text")) if options.metadata_header else F.col("__text")
    read = read.withColumn("__shown", F.when(F.col("__text").isNotNull(), shown))
    enough = F.length("__shown") >= options.min_content_chars
    return read.select(*rest, F.when(enough, F.col("__shown")).alias("text"), *_FIELDS[:-1])


def extract_content(
    pages: DataFrame, options: CrawlOptions, templates: DataFrame | None = None, **join
) -> DataFrame:
    """Content rows of all pages that have content."""
    usable = pages.where(~html.is_blank(F.col("html")))
    read = with_content(usable, options, templates, **join)
    return computed_once(read, "text").where(F.col("text").isNotNull())


def extract_site_content(pages: DataFrame, options: CrawlOptions, **join) -> DataFrame:
    """Content rows of all pages, without the templates their sites repeat.

    Every page is read through once: its blocks and metadata are staged, and templates and
    texts are both made from them.
    """
    read = stage(_read(pages.withColumn("__blank", html.is_blank(F.col("html")))), "page-blocks")
    templates = templates_of(read.select("url", "blocks"), options, **join)
    texts = _with_text(read.where(~F.col("__blank")).drop("__blank"), options, templates, **join)
    return texts.where(F.col("text").isNotNull())
