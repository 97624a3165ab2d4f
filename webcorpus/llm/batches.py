"""Running a function over Arrow batches of whole texts, next to the scan."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# the column of text bytes
_TEXT = "__text"


def text_bytes(column: str = "text") -> Column:
    """The UTF-8 bytes of a text; a NULL text is empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b"")).alias(_TEXT)


def map_texts(
    df: DataFrame,
    keep: list[Column],
    function: Callable[[pa.RecordBatch, pa.Array], Iterator[pa.RecordBatch]],
    schema: str,
    column: str = "text",
) -> DataFrame:
    """Applies `function(batch, texts)` to batches of the `keep` columns and text bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from function(batch, batch.column(batch.schema.get_field_index(_TEXT)))

    return df.select(*keep, text_bytes(column)).mapInArrow(run, schema)


def dealt(bucket, columns: dict) -> dict[str, list]:
    """Numpy columns cut by bucket: lists of bucket numbers and of each column's bytes."""
    order = np.argsort(bucket, kind="stable")
    used, first = np.unique(bucket[order], return_index=True)
    edges = [*first.tolist(), len(order)]
    out: dict[str, list] = {"bucket": used.tolist()}
    for name, values in columns.items():
        values = values[order]
        out[name] = [values[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return out


def by_bucket(
    batches: Iterator[pa.RecordBatch], kinds: dict, function: Callable[[dict], pa.RecordBatch]
) -> Iterator[pa.RecordBatch]:
    """Applies `function` to the joined columns of each bucket; rows come sorted by bucket."""
    held: dict[str, list] = {n: [] for n in kinds}
    bucket = None

    def joined() -> pa.RecordBatch:
        columns = {n: np.concatenate([np.frombuffer(p, dtype=kind) for p in held[n]]) for n, kind in kinds.items()}
        for parts in held.values():
            parts.clear()
        return function(columns)

    for batch in batches:
        for row in batch.to_pylist():
            if row["bucket"] != bucket and bucket is not None:
                yield joined()
            bucket = row["bucket"]
            for n in kinds:
                held[n].append(row[n])
    if bucket is not None:
        yield joined()
