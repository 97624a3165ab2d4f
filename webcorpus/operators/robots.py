"""Robots rules as a table, and the decision for every task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webcorpus.config import CrawlOptions
from webcorpus.functions import robotrules, urls
from webcorpus.plans.skew import lookup_join


def usable_body(raw: DataFrame) -> DataFrame:
    """Only an answer with status 200 carries rules; any other leaves NULL."""
    return raw.select("origin", F.when(F.col("http_status") == 200, F.col("body")).alias("body"))


def parse_robots(raw: DataFrame) -> DataFrame:
    """Records per origin. Of a repeated origin the latest text by `fetched_at` counts; without
    such a column, different texts for one origin stop the job."""
    if "fetched_at" in raw.columns:
        usable = F.when(F.col("http_status") == 200, F.col("body"))
        # of equal times the greatest text
        latest = F.max(F.struct("fetched_at", usable.alias("body")))
        texts = raw.groupBy("origin").agg(latest.alias("latest")).select("origin", "latest.body")
    else:
        kinds = usable_body(raw).groupBy("origin").agg(
            F.min("body").alias("least"), F.max("body").alias("body"),
            F.count("body").alias("bodies"), F.count(F.lit(1)).alias("rows"),
        )
        differ = (F.col("least") != F.col("body")) | ~F.col("bodies").isin(0, F.col("rows"))
        refusal = F.raise_error(F.concat(F.lit("different robots texts for "), F.coalesce("origin", F.lit("NULL"))))
        texts = kinds.select("origin", F.when(F.coalesce(differ, F.lit(False)), refusal).otherwise(F.col("body")).alias("body"))
    return texts.select("origin", robotrules.entries(F.col("body")).alias("entries"))


def flat_rules(parsed: DataFrame) -> DataFrame:
    """One row per rule, in file order."""
    entry = parsed.select("origin", F.posexplode("entries").alias("entry_no", "entry"))
    return entry.select(
        "origin", "entry_no", F.posexplode("entry.rules").alias("rule_no", "rule")
    ).select("origin", "entry_no", "rule_no", "rule.allow", "rule.path")


def rules_for_agent(parsed: DataFrame, user_agent: str) -> DataFrame:
    """Rules and delay that hold for one agent: `(origin, crawl_delay, rules)`."""
    return parsed.select(
        "origin", robotrules.select_entry(F.col("entries"), user_agent).alias("entry")
    ).select("origin", F.col("entry.delay").alias("crawl_delay"), F.col("entry.rules").alias("rules"))


def with_robots(tasks: DataFrame, rules: DataFrame, spread: list[str], **join) -> DataFrame:
    """Adds `allowed` and `robots_delay` to tasks that have a `url`."""
    keyed = tasks.withColumn("origin", urls.origin(F.col("url")))
    joined = lookup_join(keyed, rules, "origin", spread, "left", **join)
    return joined.select(
        *tasks.columns,
        robotrules.allows(F.col("rules"), F.col("url")).alias("allowed"),
        F.col("crawl_delay").alias("robots_delay"),
    )


def rules_by_time(raw: DataFrame, user_agent: str) -> DataFrame:
    """Rules for one agent as they changed: `(origin, valid_from, crawl_delay, rules)`.

    A text holds from its `fetched_at` until the next one that differs; of equal times the
    greatest text counts. A text without a time holds before all others.
    """
    usable = F.when(F.col("http_status") == 200, F.col("body"))
    each = raw.groupBy("origin", F.coalesce("fetched_at", F.timestamp_seconds(F.lit(-62135596800))).alias("valid_from"))
    texts = each.agg(F.max(usable).alias("body"))
    earlier = Window.partitionBy("origin").orderBy("valid_from")
    texts = texts.withColumn("__first", F.row_number().over(earlier) == 1).withColumn("__before", F.lag("body").over(earlier))
    changed = texts.where(F.col("__first") | ~F.col("body").eqNullSafe(F.col("__before")))
    entry = robotrules.select_entry(robotrules.entries(F.col("body")), user_agent)
    return changed.select("origin", "valid_from", entry.alias("entry")).select(
        "origin", "valid_from", F.col("entry.delay").alias("crawl_delay"), F.col("entry.rules").alias("rules")
    )


def with_robots_at(tasks: DataFrame, rules: DataFrame, spread: list[str], at: str = "fetched_at", **join) -> DataFrame:
    """Adds `allowed` and `robots_delay` by the rules that held at the time `at` of each task.

    `rules` are those of `rules_by_time`. A task first learns which change of its origin it
    falls under, from the times alone, and then meets that change only, so a task is never
    repeated for the changes of its origin. Before the first text everything is allowed; a
    task without a time meets the latest text.
    """
    version = lambda origin, time: F.concat_ws(" ", origin, F.unix_micros(time).cast("string"))
    # as many times as the texts of one origin changed
    times = rules.where(F.col("origin").isNotNull()).groupBy(F.col("origin").alias("__origin")).agg(
        F.collect_set("valid_from").alias("__times")
    )
    timed = lookup_join(tasks.withColumn("__origin", urls.origin(F.col("url"))), times, "__origin", spread, "left", **join)
    held = F.filter("__times", lambda t: F.col(at).isNull() | (t <= F.col(at)))
    timed = timed.withColumn("__from", F.array_max(held)).withColumn(
        "__version", F.when(F.col("__from").isNotNull(), version(F.col("__origin"), F.col("__from")))
    )
    texts = rules.where(F.col("origin").isNotNull()).select(
        version(F.col("origin"), F.col("valid_from")).alias("__version"), F.col("crawl_delay").alias("__delay"), F.col("rules").alias("__rules")
    )
    met = lookup_join(timed, texts, "__version", spread, "left", **join)
    return met.select(
        *tasks.columns,
        robotrules.allows(F.col("__rules"), F.col("url")).alias("allowed"),
        F.col("__delay").alias("robots_delay"),
    )


def effective_delay(robots_delay: Column, options: CrawlOptions) -> Column:
    """Seconds between fetches: the robots delay unless absent or 0, else the default."""
    if not options.respect_robots:
        return F.lit(None).cast("double")
    return F.coalesce(F.nullif(robots_delay, F.lit(0.0)), F.lit(float(options.crawl_delay)))


def robots_gate(
    tasks: DataFrame, rules: DataFrame, options: CrawlOptions, spread: list[str], **join
) -> DataFrame:
    """Tasks with `allowed` and `delay`; everything passes when robots are ignored."""
    if not options.respect_robots:
        return tasks.withColumn("allowed", F.lit(True)).withColumn(
            "delay", effective_delay(F.lit(None), options)
        )
    decided = with_robots(tasks, rules, spread, **join)
    return decided.withColumn("delay", effective_delay(F.col("robots_delay"), options)).drop(
        "robots_delay"
    )
