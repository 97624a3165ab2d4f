"""Redirect chains over stored answers: where the URL of a task ends.

Chains are followed by pointer doubling: after k rounds a URL points 2 ** k answers ahead,
so the longest chain takes as many rounds as its length has bits. Only URLs take part, never
html, and many URLs that lead to one page (a login form) are salted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webcorpus.functions import urls
from webcorpus.functions.linkrules import valid_scheme
from webcorpus.operators.answers import leads_on, one_per_url
from webcorpus.plans.skew import salted_join
from webcorpus.plans.storage import stage

#: What a chain without a page at its end fails with.
LOOP = "Redirect loop"
TOO_MANY = "Too many redirects"
NOT_STORED = "Redirect target not stored"
UNSUPPORTED = "Unsupported redirect target"


def redirects(fetches: DataFrame) -> DataFrame:
    """`(url, target)` of the answers `(url, http_status, location)` that lead on. A location
    is resolved against the URL that was asked for, and loses its fragment."""
    target = urls.defrag(urls.resolve(F.col("url"), F.col("location")))
    return fetches.where(leads_on()).select("url", target.alias("target"))


def follow_redirects(fetches: DataFrame, max_redirects: int = 20, **hot) -> DataFrame:
    """`(url, final_url, hops, error)` of every URL that redirects.

    Of several answers for a URL one counts (`answers.one_per_url`). `error` is NULL where a stored answer that doesn't lead on
    is reached within `max_redirects` steps; otherwise it says that the chain is a loop or
    leads into one, that it is longer, that its end is not stored, or that it is not a web
    address. `final_url` is the last URL of a chain, NULL for a loop, which has no `hops`.
    """
    fetches = one_per_url(fetches)
    found = redirects(fetches)
    named = found.select(F.col("url").alias("at"), F.lit(True).alias("moves"))
    first = salted_join(found.withColumnRenamed("target", "at"), named, "at", ["url"], **hot)
    steps = stage(
        first.select("url", "at", F.lit(1).cast("long").alias("hops"), F.coalesce("moves", F.lit(False)).alias("moves")),
        "redirects-0",
    )
    moving, before, rounds = steps.where("moves").count(), -1, 0
    # a round settles the chain that is one too long for the last one, so that what stays is loops
    while moving and moving != before:
        rounds += 1
        ahead = steps.select(F.col("url").alias("at"), F.col("at").alias("to"), F.col("hops").alias("more"), F.col("moves").alias("on"))
        jumped = salted_join(steps.where("moves").drop("moves"), ahead, "at", ["url"], "inner", **hot).select(
            "url", F.col("to").alias("at"), (F.col("hops") + F.col("more")).alias("hops"), F.col("on").alias("moves")
        )
        steps = stage(jumped.unionByName(steps.where("not moves")), f"redirects-{rounds}")
        before, moving = moving, steps.where("moves").count()
    stored = fetches.select(F.col("url").alias("at"), F.lit(True).alias("stored")).distinct()
    ends = salted_join(steps, stored, "at", ["url"], **hot)
    error = (
        F.when(F.col("moves"), LOOP)
        .when(F.col("hops") > max_redirects, TOO_MANY)
        .when(~valid_scheme(F.col("at")), UNSUPPORTED)
        .when(F.col("stored").isNull(), NOT_STORED)
    )
    return ends.select(
        "url", F.when(~F.col("moves"), F.col("at")).alias("final_url"),
        F.when(~F.col("moves"), F.col("hops")).alias("hops"), error.alias("error"),
    )
