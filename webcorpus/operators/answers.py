"""Stored answers of servers: one counts for a URL, however many are stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webcorpus.functions import html
from webcorpus.operators import outcomes
from webcorpus.plans import skew
from webcorpus.plans.storage import stage

#: The answers that lead on if they name a location.
STATUSES = [301, 302, 303, 307, 308]


def leads_on() -> Column:
    """The answer is a redirect that names a location."""
    return F.col("http_status").isin(STATUSES) & F.col("location").rlike(r"\S")


def _brings(columns: list[str]) -> list[Column]:
    """2 for an HTML page that is not blank, 1 for a redirect, 0 for what fails; nothing where
    the columns don't tell."""
    if not {"http_status", "content_type", "error_kind", "html"} <= set(columns):
        return []
    rank = F.when(outcomes.is_usable() & ~html.is_blank(F.col("html")), 2)
    return [(rank.when(leads_on(), 1) if "location" in columns else rank).otherwise(0)]


def one_per_url(fetches: DataFrame) -> DataFrame:
    """The answers with one whole row of every URL; rows without a URL stay as they are.

    The latest by `fetched_at` counts. Without that column, or among equal times, a page counts
    before a redirect and that before an answer that fails, so that no failure hides a stored
    page. Of those left it is the row with the highest hash, so that every job over the same
    table takes the same answer. URLs are counted first, and only rows of those that are stored
    more than once are grouped.
    """
    named = fetches.where(F.col("url").isNotNull())
    counted = named.groupBy("url").agg(F.count(F.lit(1)).alias("n"))
    repeated = stage(counted.where(F.col("n") > 1).select("url"), "repeated-urls")
    if repeated.isEmpty():
        return fetches
    marked = skew.with_likely(fetches, repeated, "url", "__repeated")
    rest = sorted(c for c in fetches.columns if c != "url")
    order = [*_brings(fetches.columns), F.xxhash64(*rest) if rest else F.lit(0)]
    if "fetched_at" in fetches.columns:
        order.insert(0, F.col("fetched_at"))
    row = F.struct(*fetches.columns)
    # the largest row of a group is found before the shuffle, so no URL is too frequent
    latest = marked.where("__repeated").groupBy("url").agg(F.max_by(row, F.struct(*order)).alias("row"))
    return marked.where(~F.col("__repeated")).drop("__repeated").unionByName(latest.select("row.*"))
