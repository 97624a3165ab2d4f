"""Language prediction and filtering of URL tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webcorpus.config import CrawlOptions
from webcorpus.functions import language
from webcorpus.functions.binding import computed_once


def with_language(table: DataFrame, column: str = "lang") -> DataFrame:
    """Adds the language predicted from `url`."""
    return table.withColumn(column, language.predict_language(F.col("url")))


def filter_language(table: DataFrame, options: CrawlOptions, column: str = "lang") -> DataFrame:
    """Drops URLs predicted to be in another than the allowed languages."""
    if not options.filter_by_language:
        return table
    return computed_once(table, column).where(language.keep_language(F.col(column), options.languages()))
