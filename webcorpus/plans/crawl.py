"""Whole jobs: a crawl batch, its reports, and the hop-by-hop growth of the frontier."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webcorpus.config import CrawlOptions
from webcorpus.functions import html
from webcorpus.functions.binding import computed_once
from webcorpus.operators import answers, content, frontier, links, outcomes, robots
from webcorpus.plans import skew
from webcorpus.plans.storage import stage


@dataclass(frozen=True)
class CrawlBatch:
    """Results of a batch. All four are views of one processed table."""

    outcomes: DataFrame
    content: DataFrame
    links: DataFrame
    status: DataFrame


_TASK = ["id", "url", "depth", "parent_score"]
_FETCH = ["url", "http_status", "content_type", "error_kind", "error"]
_CONTENT = ["title", "text", "language", "author", "date"]


def _read_pages(
    pages: DataFrame,
    options: CrawlOptions,
    templates: DataFrame | None,
    join: dict,
    link_gate: Column,
) -> DataFrame:
    """Replaces html by content and `links`; links only where `link_gate` holds."""
    # what is not a usable page carries no html from here on
    usable = outcomes.is_usable() & ~F.col("too_long") & ~html.is_blank(F.col("html"))
    read = pages.withColumn("html", F.when(usable, F.col("html")))
    if options.extract_links:
        read = links.with_links(
            read.withColumn("__html", F.col("html")).withColumn(
                "html", F.when(link_gate, F.col("html"))
            ),
            options,
            by_language=options.filter_by_language,
        )
        read = read.withColumn("html", F.col("__html")).drop("__html")
        if options.links_per_page is not None:
            read = read.withColumn("links", F.slice("links", 1, options.links_per_page))
    else:
        read = read.withColumn("links", F.array().cast("array<string>"))
    return computed_once(content.with_content(read, options, templates, **join), "text", "links")


def _processed(
    tasks: DataFrame,
    rules: DataFrame,
    fetches: DataFrame,
    options: CrawlOptions,
    templates: DataFrame | None,
    redirected: DataFrame | None,
    staged: bool,
    join: dict,
) -> DataFrame:
    """One row per task with an outcome: its state, content and links.

    Robots rules are applied to the narrow task table. Only pages of allowed tasks are read
    through, each once: tasks that measure small are broadcast to the fetches; of more, a
    bitmap of hashed URLs of fixed size is, and what was found in the pages that pass it is
    joined to the tasks by URL. Html is shuffled only for tasks that were redirected, and
    only where tasks don't measure small: their links have another base than the page's URL.
    """
    gated = robots.robots_gate(tasks.select(*_TASK), rules, options, ["id"], **join)
    if staged:
        gated = stage(gated, "gated-tasks")
    allowed = gated.where("allowed").select(*_TASK)
    pages = fetches.select(*_FETCH, "html").withColumn("too_long", outcomes.is_too_long(options.max_content_length))
    gate = links.follows_links(options)
    limit = join.get("broadcast_bytes", skew.BROADCAST_BYTES)
    hot = {k: v for k, v in join.items() if k == "hot_rows"}
    broken = None
    moved = allowed.withColumn("fetch_url", F.col("url"))
    if redirected is not None:
        ends = redirected.select("url", "final_url", F.col("error").alias("broken"))
        moved = skew.salted_join(allowed, ends, "url", ["id"], **hot)
        moved = moved.withColumn("fetch_url", F.coalesce("final_url", "url")).drop("final_url")
        if staged:
            moved = stage(moved, "redirected-tasks")
        broken = moved.where(F.col("broken").isNotNull())
        moved = moved.where(F.col("broken").isNull()).drop("broken")
    if skew.measured_bytes(moved) <= limit:
        met = pages.withColumnRenamed("url", "fetch_url").join(F.broadcast(moved), "fetch_url").drop("fetch_url")
        read = _read_pages(met, options, templates, join, gate)
    else:
        direct = moved.where(F.col("fetch_url") == F.col("url")).drop("fetch_url")
        likely = skew.likely_in(pages, direct, "url")
        found = _read_pages(likely, options, templates, join, F.lit(True))
        # many tasks may have one URL; the side of the fetches has one row of it
        read = skew.salted_join(direct, found, "url", ["id"], "inner", **hot)
        read = read.withColumn("links", F.when(gate, F.col("links")))
        if redirected is not None:
            away = moved.where(F.col("fetch_url") != F.col("url"))
            reached = skew.likely_in(pages.withColumnRenamed("url", "fetch_url"), away, "fetch_url")
            met = skew.salted_join(away, reached, "fetch_url", ["id"], "inner", **hot).drop("fetch_url")
            read = read.unionByName(_read_pages(met, options, templates, join, gate))
    done = outcomes.with_outcome(read, F.lit(True), F.col("text").isNotNull(), F.col("too_long"))
    finished = done.select(
        *_TASK, "status", "error_message", *_CONTENT,
        # links count only where content was found
        F.when(F.col("status") == "completed", F.col("links")).alias("links"),
    )
    refused = gated.where(~F.col("allowed")).select(
        *_TASK,
        F.lit("failed").alias("status"),
        F.lit(outcomes.DISALLOWED).alias("error_message"),
    )
    if broken is not None:
        message = F.concat(F.lit(outcomes.REQUEST_ERROR), "broken").alias("error_message")
        refused = refused.unionByName(broken.select(*_TASK, F.lit("failed").alias("status"), message))
    return finished.unionByName(refused, allowMissingColumns=True)


def crawl_batch(
    tasks: DataFrame,
    rules: DataFrame,
    fetches: DataFrame,
    options: CrawlOptions,
    templates: DataFrame | None = None,
    staged: bool = True,
    redirected: DataFrame | None = None,
    **join,
) -> CrawlBatch:
    """Process the tasks for which a fetch is stored, and those robots rules refuse.

    `tasks` has `(id, url, depth, parent_score)`, `rules` comes from
    `operators.robots.rules_for_agent`. Where `fetches` has several answers for a URL, one
    counts (`operators.answers.one_per_url`), so a task has one outcome. With `staged` the
    processed table is written once, and every result reads only its own columns. With
    `redirected`, from `operators.redirects.follow_redirects`, a task whose URL redirects
    gets the answer at the end of its chain, and fails where the chain has none. Its URL
    stays that of the task, also as base of the links.
    """
    fetches = answers.one_per_url(fetches)
    done = _processed(tasks, rules, fetches, options, templates, redirected, staged, join)
    if staged:
        done = stage(done, "crawl-batch")
    completed = done.where(F.col("status") == "completed")
    return CrawlBatch(
        outcomes=done.select("id", "url", "status", "error_message"),
        content=completed.select("id", "url", "title", "text", "language", "author", "date"),
        links=frontier.with_priority(
            links.explode_links(completed.where(F.size("links") > 0), ("id",)).withColumnRenamed("id", "task_id"),
            options.fixed_priority,
        ),
        status=frontier.status_transitions(done.select("id", "status", "error_message")),
    )


def crawl_results(content_rows: DataFrame, max_tasks: int = 100) -> DataFrame:
    """At most `max_tasks` successful contents, by id. Only ids are ranked; the texts
    are then filtered by them."""
    first = content_rows.select("id").orderBy("id").limit(max_tasks)
    return content_rows.join(first, "id", "left_semi")


def report_links(discovered: DataFrame, known: DataFrame) -> DataFrame:
    """Per source page: links found, added to the frontier, skipped."""
    added = frontier.admit_links(discovered, known).select(
        "parent_url", "url", F.lit(0).alias("found"), F.lit(1).alias("added")
    )
    found = discovered.select(
        "parent_url", "url", F.lit(1).alias("found"), F.lit(0).alias("added")
    )
    return (
        found.unionByName(added)
        .groupBy("parent_url")
        .agg(F.sum("found").alias("found"), F.sum("added").alias("added"))
        .select("parent_url", "found", "added", (F.col("found") - F.col("added")).alias("skipped"))
    )


def report_content(content_rows: DataFrame) -> DataFrame:
    """Per page: url, title, text length and language."""
    return content_rows.select(
        "url",
        F.coalesce("title", F.lit("N/A")).alias("title"),
        F.length("text").alias("text_length"),
        "language",
    )


def report_outcomes(outcome_rows: DataFrame) -> DataFrame:
    """Number of tasks per state and message."""
    return outcome_rows.groupBy("status", "error_message").agg(F.count(F.lit(1)).alias("tasks"))


def frontier_expand(
    seeds: DataFrame, pages: DataFrame, known: DataFrame, options: CrawlOptions
) -> DataFrame:
    """Grow the frontier over stored pages, hop by hop, until no URL is new or the
    depth limit is reached. Returns the new frontier rows.

    `seeds` are URLs at depth 0, `pages` has `(url, html, parent_score)`. Pages are read
    once, into a table of unique (page, link) pairs; every hop then joins only URLs.
    """
    found = links.discover_links(pages.withColumn("depth", F.lit(0)), options)
    first = F.min(F.struct("position", "priority")).alias("first")
    edges = stage(
        found.groupBy("parent_url", "url").agg(first).select("parent_url", "url", "first.*"),
        "link-graph",
    )
    seen = stage(known.select("url").union(seeds.select("url")).distinct(), "frontier-seen")
    hop = stage(seeds.select("url").distinct(), "frontier-hop-0")
    grown = seeds.sparkSession.createDataFrame([], "url string, priority int, depth int, parent_url string")
    for depth in range(1, options.max_depth + 1):
        parents = skew.small(hop.select(F.col("url").alias("parent_url")))
        reached = edges.join(parents, "parent_url").withColumn("depth", F.lit(depth))
        fresh = stage(frontier.unique_links(reached), f"frontier-reached-{depth}")
        # the URLs known so far only meet those reached: few of them are broadcast
        met = seen.join(skew.small(fresh.select("url")), "url", "left_semi").distinct()
        admitted = fresh.join(met, "url", "left_anti").select("url", "priority", "depth", "parent_url")
        hop = stage(admitted, f"frontier-hop-{depth}")
        grown = grown.unionByName(hop)
        if hop.isEmpty():
            break
        seen = seen.union(hop.select("url"))
    return grown
