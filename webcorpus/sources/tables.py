"""Readers with fixed schemas, for batch and for streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webcorpus import schemas
from webcorpus.operators import robots


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def stream_table(
    spark: SparkSession,
    folder: str,
    schema: T.StructType,
    files: str = "*.parquet",
    files_per_batch: int | None = None,
) -> DataFrame:
    """The Parquet files of a folder as a stream, new files in later batches."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", files)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def scan_pages(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schemas.PAGES)


def scan_fetches(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schemas.FETCHES)


def scan_robots(spark: SparkSession, path: str) -> DataFrame:
    """Robots text per origin; NULL unless the answer had status 200."""
    return robots.usable_body(read_table(spark, path, schemas.ROBOTS_RAW))


def require_fields(tasks: DataFrame) -> DataFrame:
    """Stop the job at a task that lacks one of the mandatory fields. The check is a filter
    over all of them, so it holds whichever columns are read afterwards."""
    names = schemas.TASK_FEED.fieldNames()
    missing = F.lit(False)
    for name in names:
        missing = missing | F.col(name).isNull()
    refusal = F.raise_error(F.lit("crawl task without " + ", ".join(names))).cast("boolean")
    return tasks.where(F.when(missing, refusal).otherwise(F.lit(True)))


def scan_frontier(spark: SparkSession, path: str) -> DataFrame:
    """Tasks as stored by the jobs here."""
    return read_table(spark, path, schemas.FRONTIER)


def scan_task_feed(spark: SparkSession, path: str) -> DataFrame:
    """Tasks as JSON, one per line; broken or incomplete records stop the job."""
    feed = spark.read.schema(schemas.TASK_FEED).option("mode", "FAILFAST").json(path)
    return require_fields(feed)
