"""Classification of fetches: which tasks completed, which failed and why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DISALLOWED = "Disallowed by robots.txt"
NO_CONTENT = "Content extraction failed"
TOO_LONG = "Content too long"
#: Start of the message of an answer that never came.
REQUEST_ERROR = "Request error: "


def is_request_error() -> Column:
    return F.coalesce(F.col("error_kind") == "request", F.lit(False))


def is_unexpected() -> Column:
    """Another error than one of transport, or a fetch that tells nothing at all."""
    nothing = F.col("http_status").isNull() & F.col("error_kind").isNull()
    return F.coalesce(F.col("error_kind") == "other", F.lit(False)) | nothing


def is_http_error() -> Column:
    return F.coalesce(~F.col("http_status").between(200, 299), F.lit(False))


def is_not_html() -> Column:
    content_type = F.lower(F.coalesce(F.col("content_type"), F.lit("")))
    return ~F.contains(content_type, F.lit("text/html"))


def is_usable() -> Column:
    """The fetch brought an HTML page."""
    return ~(is_request_error() | is_unexpected() | is_http_error() | is_not_html())


def is_too_long(max_length: int | None) -> Column:
    """The page has more than `max_length` characters; None allows any."""
    if max_length is None:
        return F.lit(False)
    return F.coalesce(F.length("html") > max_length, F.lit(False))


def error_message(allowed: Column, has_content: Column, too_long: Column | None = None) -> Column:
    """Message of the first condition that fails a task, NULL if it completed."""
    text = lambda column: F.coalesce(column, F.lit(""))
    return (
        F.when(~allowed, DISALLOWED)
        .when(is_request_error(), F.concat(F.lit(REQUEST_ERROR), text(F.col("error"))))
        .when(is_unexpected(), F.concat(F.lit("Unexpected error: "), text(F.col("error"))))
        .when(is_http_error(), F.concat(F.lit("HTTP "), F.col("http_status").cast("string")))
        .when(is_not_html(), F.concat(F.lit("Not HTML: "), text(F.col("content_type"))))
        .when(F.lit(False) if too_long is None else too_long, TOO_LONG)
        .when(~has_content, NO_CONTENT)
    )


def status_of(message: Column) -> Column:
    return F.when(message.isNull(), "completed").otherwise("failed")


def with_outcome(
    fetches: DataFrame, allowed: Column, has_content: Column, too_long: Column | None = None
) -> DataFrame:
    """Adds `status` and `error_message`."""
    return fetches.withColumn("error_message", error_message(allowed, has_content, too_long)).withColumn(
        "status", status_of(F.col("error_message"))
    )


def size_guard(pages: DataFrame, max_length: int | None) -> DataFrame:
    """Drops pages longer than `max_length` characters; None keeps all."""
    return pages if max_length is None else pages.where(~is_too_long(max_length))
