"""The URL frontier: choosing tasks, folding their states, admitting new links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webcorpus.config import CrawlOptions
from webcorpus.functions import urls
from webcorpus.plans.keyed_store import KeyedStore
from webcorpus.plans.storage import stage


def next_tasks(frontier: DataFrame, limit: int = 10, highest_first: bool = True) -> DataFrame:
    """The next pending tasks by priority, then by id."""
    order = F.col("priority").desc() if highest_first else F.col("priority").asc()
    return frontier.where(F.col("status") == "pending").orderBy(order, F.col("id")).limit(limit)


def status_transitions(outcomes: DataFrame, ts: Column | None = None) -> DataFrame:
    """Two events per task `(id, status, error_message)`: crawling, then its outcome."""
    started = F.struct(
        F.lit("crawling").alias("status"),
        F.lit(None).cast("string").alias("error_message"),
        F.lit(0).cast("bigint").alias("seq"),
    )
    finished = F.struct(
        F.col("status").alias("status"),
        F.col("error_message").alias("error_message"),
        F.lit(1).cast("bigint").alias("seq"),
    )
    events = outcomes.select(
        F.col("id").alias("task_id"), F.explode(F.array(started, finished)).alias("event")
    )
    return events.select(
        "task_id",
        "event.status",
        "event.error_message",
        (F.current_timestamp() if ts is None else ts).cast("timestamp").alias("ts"),
        "event.seq",
    )


def latest_status(events: DataFrame) -> DataFrame:
    """Current state per task: the event with the greatest (ts, seq)."""
    last = F.max_by(F.struct("status", "error_message"), F.struct("ts", "seq"))
    return (
        events.groupBy("task_id")
        .agg(last.alias("last"))
        .select("task_id", "last.status", "last.error_message")
    )


def latest_events(events: DataFrame) -> DataFrame:
    """The last event of each task, by (ts, seq); of those alike in both, the one with the
    greatest status and message. Folding some events first changes nothing."""
    last = F.max(F.struct("ts", "seq", "status", "error_message"))
    return events.groupBy("task_id").agg(last.alias("last")).select(
        "task_id", "last.status", "last.error_message", "last.ts", "last.seq"
    )


def with_priority(links: DataFrame, fixed: int | None) -> DataFrame:
    """Priority of new links: the inherited one, or one for all."""
    if fixed is None:
        return links
    return links.withColumn("priority", F.lit(fixed).cast("int"))


def unique_links(links: DataFrame) -> DataFrame:
    """One row per URL, the one with the lowest (parent_url, position).

    The minimum is taken before the shuffle already, so a URL that every page links to
    reaches its task as one row per input split.
    """
    first = F.min(F.struct("parent_url", "position", "priority", "depth"))
    return (
        links.groupBy("url")
        .agg(first.alias("first"))
        .select("url", "first.priority", "first.depth", "first.parent_url", "first.position")
    )


def admit_links(links: DataFrame, known: DataFrame) -> DataFrame:
    """Links to URLs that are not known yet, one row each."""
    return unique_links(links).join(known.select("url").distinct(), "url", "left_anti")


def admit_to_store(links: DataFrame, known: KeyedStore, batch: int) -> DataFrame:
    """Links to URLs that are not in the store before `batch`, one row each. Known URLs are
    not shuffled: the URLs of the links are sent to the slots they hash to."""
    fresh = stage(unique_links(links).where(F.col("url").isNotNull()), "unique-links")
    held = stage(known.lookup(fresh.select("url"), ["url"], before=batch).distinct(), "held-urls")
    return fresh.join(held, "url", "left_anti")


def admit_counts(links: DataFrame, known: DataFrame) -> DataFrame:
    """One row: links added, skipped (known or repeated) and in total."""
    fresh = F.col("known").isNull()
    return (
        links.groupBy("url")
        .agg(F.count(F.lit(1)).alias("copies"))
        .join(known.select("url").distinct().withColumn("known", F.lit(True)), "url", "left")
        .agg(
            F.count_if(fresh).alias("added"),
            F.coalesce(F.sum(F.col("copies")), F.lit(0)).alias("total"),
        )
        .select("added", (F.col("total") - F.col("added")).alias("skipped"), "total")
    )


def url_id(url: Column) -> Column:
    """The id of a task: 60 bits of a hash of its URL, the same whenever it is admitted."""
    return F.conv(F.substring(F.md5(url), 1, 15), 16, 10).cast("bigint")


def to_frontier(links: DataFrame, options: CrawlOptions) -> DataFrame:
    """Admitted links as pending tasks. Until its page is scored, a task has the priority
    its link inherited as score."""
    inherited = links.withColumn("parent_score", F.col("priority"))
    return with_priority(inherited, options.fixed_priority).select(
        url_id(F.col("url")).alias("id"),
        "url",
        "priority",
        urls.domain(F.col("url")).alias("domain"),
        F.lit("pending").alias("status"),
        "depth",
        "parent_score",
        "parent_url",
    )
