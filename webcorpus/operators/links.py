"""Link discovery. The links of a page stay in one array until they are final, so
resolving, filtering, de-duplicating and capping them need no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webcorpus.config import CrawlOptions
from webcorpus.functions import html, language, linkrules, urls


def score_gate(pages: DataFrame, options: CrawlOptions) -> DataFrame:
    """Pages good enough to have their links followed; no score counts as 0."""
    return pages.where(F.coalesce(F.col("parent_score"), F.lit(0)) >= options.min_parent_score)


def depth_gate(pages: DataFrame, options: CrawlOptions) -> DataFrame:
    return pages.where(F.coalesce(F.col("depth"), F.lit(0)) < options.max_depth)


def follows_links(options: CrawlOptions) -> Column:
    """Both gates as one condition."""
    return (F.coalesce(F.col("parent_score"), F.lit(0)) >= options.min_parent_score) & (
        F.coalesce(F.col("depth"), F.lit(0)) < options.max_depth
    )


def with_normalized(pages: DataFrame, column: str = "links") -> DataFrame:
    """Adds the absolute URL of every non-blank href, in document order."""
    return (
        pages.withColumn("__base", urls.base_parts(F.col("url")))
        .withColumn(
            "__refs",
            F.transform(
                F.filter(html.hrefs(F.col("html")), lambda href: href.rlike(r"\S")),
                urls.reference_parts,
            ),
        )
        .withColumn(
            column,
            F.transform(
                F.transform("__refs", lambda ref: urls.resolve_parts(F.col("__base"), ref)),
                lambda url: urls.strip_slash(urls.defrag(url)),
            ),
        )
        .drop("__base", "__refs")
    )


def _in_allowed_language(found: Column, options: CrawlOptions) -> Column:
    return F.filter(
        found,
        lambda url: language.keep_language(language.predict_language(url), options.languages()),
    )


def with_links(pages: DataFrame, options: CrawlOptions, by_language: bool = False) -> DataFrame:
    """Adds `links`: the distinct URLs of a page worth crawling, first occurrence first."""
    found = F.filter("links", lambda url: linkrules.should_crawl(url, options))
    if by_language:
        found = _in_allowed_language(found, options)
    return with_normalized(pages).withColumn("links", F.array_distinct(found))


def explode_links(pages: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row per link. `position` counts the final links of the page from 0."""
    score = F.coalesce(F.col("parent_score"), F.lit(0))
    # for the plain posexplode the optimizer adds a filter on the size of the array,
    # which finds all links a second time
    rows = pages.select(
        *keys,
        F.posexplode_outer("links").alias("position", "url"),
        linkrules.priority(score).alias("priority"),
        (F.coalesce(F.col("depth"), F.lit(0)) + 1).cast("int").alias("depth"),
        F.col("url").alias("parent_url"),
    )
    return rows.where(F.col("url").isNotNull())


def discover_links(
    pages: DataFrame, options: CrawlOptions, keys: tuple[str, ...] = ()
) -> DataFrame:
    """Links of the pages `(url, html, parent_score, depth)`, cheap gates first."""
    worth = pages.where(follows_links(options) & ~html.is_blank(F.col("html")))
    return explode_links(with_links(worth, options), keys)


def cap_links(links: DataFrame, limit: int) -> DataFrame:
    """The first `limit` links of every page, in document order."""
    return links.where(F.col("position") < limit)
