"""Which links are followed and how they are ranked, as expressions over a URL."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from webcorpus.config import CrawlOptions
from webcorpus.functions import urls


def _any_of(patterns: list[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def valid_scheme(url: Column) -> Column:
    return urls.clean(url).rlike(r"^(?i:https?):")


def allowed_domain(url: Column, patterns: list[str]) -> Column:
    """The authority matches one of the patterns from its start."""
    return urls.netloc(url).rlike(f"^(?:{_any_of(patterns)})")


def blocked_pattern(url: Column, patterns: list[str]) -> Column:
    """One of the patterns occurs anywhere in the URL, in any case."""
    return url.rlike(f"(?iu)(?:{_any_of(patterns)})")


def blocked_extension(url: Column, extensions: list[str]) -> Column:
    """The path, without query and parameters, ends with one of the extensions."""
    endings = "|".join(re.escape(e.lower()) for e in extensions)
    local = r"^[^:/?#]+://[^/?#]*/(?:[^?#]*/)?[^/;?#]*"
    return urls.clean(url).rlike(rf"(?iu){local}(?:{endings})(?:[;?#]|\z)")


def should_crawl(url: Column, options: CrawlOptions) -> Column:
    balanced = ~url.rlike(r"[\[\]]") | ~urls.malformed(url)
    return (
        valid_scheme(url)
        & balanced
        & allowed_domain(url, options.domains())
        & ~blocked_pattern(url, options.patterns())
        & ~blocked_extension(url, options.extensions())
    )


def priority(parent_score: Column) -> Column:
    """Priority of a child link, a little below the score of its page; no score counts as 0."""
    parent_score = F.coalesce(parent_score, F.lit(0))
    return (
        F.when(parent_score >= 80, F.greatest(F.lit(70), parent_score - 10))
        .when(parent_score >= 60, F.greatest(F.lit(55), parent_score - 15))
        .otherwise(F.greatest(F.lit(40), parent_score - 10))
        .cast("int")
    )
