"""Writers. Each call owns the folder of one batch, so a repeated call replaces what an
earlier attempt left and never doubles rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _write_batch(rows: DataFrame, folder: str, batch_id: int) -> None:
    rows.write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")


def read_batches(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """All batches of a sink, with their `batch_id`."""
    with_batch = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    return spark.read.schema(with_batch).option("basePath", folder).parquet(folder)


def content_payload(content: DataFrame) -> DataFrame:
    """Rows as they are stored: author and date only when they are not empty."""
    return content.select(
        *[c for c in ("id", "url") if c in content.columns],
        "title",
        F.col("text").alias("content"),
        "language",
        F.nullif("author", F.lit("")).alias("author"),
        F.nullif("date", F.lit("")).alias("date"),
    )


def sink_content(content: DataFrame, folder: str, batch_id: int) -> None:
    _write_batch(content_payload(content), folder, batch_id)


def sink_links(frontier_rows: DataFrame, folder: str, batch_id: int) -> None:
    _write_batch(frontier_rows, folder, batch_id)


def sink_status(events: DataFrame, folder: str, batch_id: int) -> None:
    _write_batch(events, folder, batch_id)
