"""Vector codes: every part of a vector becomes the number of its nearest codebook entry.

The nearest entry is found by equal-average search. Entries stand in the order of their
component sums; from the place of a part's own sum the search goes outward, and ends when
the squared gap of the sums, over the dimension, is strictly more than the best squared
distance (no entry beyond can be as near, by the inequality of Cauchy and Schwarz). All
numbers are integers, so ties and ends are exact. Vectors never meet: a round of learning
sends 64 sums per part and task, and the codebooks have a fixed size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webcorpus.llm.topk import scaled_floor, usable
from webcorpus.plans.skew import lookup_join
from webcorpus.plans.storage import stage

#: Parts of a vector, entries of a part's codebook (at most 256), rounds of learning.
PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: A component's scale before it is rounded down.
SCALE = 256
#: Rows whose parts are searched for at once.
_ROWS = 4096
_LONG = (1 << 63) - 1


def integer_vectors(vectors: DataFrame, parts: int = PARTS) -> DataFrame:
    """`(vec_id, label, ints)` of `(vec_id, label, embedding)`: components times 256, floored.

    Vectors that are NULL or hold NULL or non-finite components are left out. So are those
    that can't be cut into equal parts, and those not as long as the one with the smallest
    `vec_id`. A component beyond 64 bits is the nearest long. Rows without `vec_id` or that
    share one stay. The table is staged.
    """
    size = F.size("embedding")
    rows = vectors.where(usable(F.col("embedding")) & (size > 0) & (size % parts == 0)).select(
        F.col("vec_id").cast("long").alias("vec_id"), "label", scaled_floor(F.col("embedding"), SCALE).alias("ints")
    )
    rows = stage(rows, "codes-ints")
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "ints").select(F.size("ints")).first()
    return rows.where(F.size("ints") == first[0]) if first else rows


def _exact(*arrays: np.ndarray) -> list[np.ndarray]:
    """The arrays as they are if all products of a search fit 64 bits, else as Python integers."""
    reach = 2 * max(max(abs(int(a.max(initial=0))), abs(int(a.min(initial=0)))) for a in arrays)
    fits = (arrays[0].shape[-1] * reach) ** 2 <= _LONG
    return list(arrays) if fits else [a.astype(object) for a in arrays]


def nearest(vectors: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes `(rows, parts)` and squared distances of vectors `(rows, parts, width)`, for
    codebooks `(parts, entries, width)`; ties go to the lower entry."""
    vectors, books = _exact(vectors, books)
    rows, parts, width = vectors.shape
    entries = books.shape[1]
    sums = books.sum(axis=2)
    order = np.argsort(sums, axis=1, kind="stable")
    ranked = np.take_along_axis(sums, order, axis=1)
    own = vectors.sum(axis=2)
    right = np.stack([np.searchsorted(ranked[p], own[:, p]) for p in range(parts)], axis=1).reshape(-1)
    left = right - 1
    flat, own = vectors.reshape(-1, width), own.reshape(-1)
    part = np.tile(np.arange(parts), rows)
    code = np.full(rows * parts, -1)
    best = np.zeros(rows * parts, dtype=flat.dtype)
    active = np.arange(rows * parts)
    while len(active):
        p, mine = part[active], own[active]
        low, high = left[active], right[active]
        can_low, can_high = low >= 0, high < entries
        gap_low = mine - ranked[p, np.maximum(low, 0)]
        gap_high = ranked[p, np.minimum(high, entries - 1)] - mine
        down = can_low & (~can_high | (gap_low <= gap_high))
        gap = np.where(down, gap_low, gap_high)
        # the nearer side decides: if it is too far, so is the other
        going = (can_low | can_high) & ((code[active] < 0) | (gap * gap <= best[active] * width))
        active, p, down, low, high = active[going], p[going], down[going], low[going], high[going]
        entry = order[p, np.where(down, low, high)]
        apart = flat[active] - books[p, entry]
        distance = (apart * apart).sum(axis=1)
        held, known = code[active], best[active]
        better = (held < 0) | (distance < known) | ((distance == known) & (entry < held))
        code[active[better]], best[active[better]] = entry[better], distance[better]
        left[active] -= down
        right[active] += ~down
    return code.reshape(rows, parts), best.reshape(rows, parts)


def _matrices(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Pieces of batches with their vectors `(rows, parts, width)`."""
    for batch in batches:
        for low in range(0, batch.num_rows, _ROWS):
            piece = batch.slice(low, _ROWS)
            ints = piece.column(piece.schema.get_field_index("ints")).flatten().to_numpy(zero_copy_only=False)
            yield piece, ints.astype(np.int64).reshape(piece.num_rows, parts, -1)


def _part_sums(values: np.ndarray, codes: np.ndarray, entries: int) -> np.ndarray:
    """Sums of the values `(rows, width)` by code, as Python integers."""
    out = np.zeros((entries, values.shape[1]), dtype=object)
    if int(np.abs(values.astype(float)).max(initial=0)) * len(values) < 1 << 53:
        for k in range(values.shape[1]):  # such sums are exact in floating point
            out[:, k] = [int(s) for s in np.bincount(codes, values[:, k], entries)]
    else:
        np.add.at(out, codes, values.astype(object))
    return out


def learn(ints: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks `(parts, entries, width)` of a table `integer_vectors` gives.

    They start as the parts of the vectors with the smallest `vec_id`s (NULL last; of equal
    ids the smaller vector); with fewer vectors there are fewer entries, without any none. In
    each round every part goes to its nearest entry, and an entry becomes the mean of its
    parts, floored; one without parts stays.
    """
    first = ints.orderBy(F.asc_nulls_last("vec_id"), "ints").limit(entries).select("ints").collect()
    if not first:
        return np.zeros((parts, 0, 0), dtype=np.int64)
    start = np.array([r.ints for r in first], dtype=np.int64).reshape(len(first), parts, -1)
    books = np.ascontiguousarray(start.transpose(1, 0, 2))
    for _ in range(rounds):
        shared = ints.sparkSession.sparkContext.broadcast(books)

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = shared.value
            totals, counts = np.zeros(held.shape, dtype=object), np.zeros(held.shape[:2], dtype=np.int64)
            for _, vectors in _matrices(batches, parts):
                codes, _ = nearest(vectors, held)
                for p in range(parts):
                    totals[p] += _part_sums(vectors[:, p], codes[:, p], held.shape[1])
                    counts[p] += np.bincount(codes[:, p], minlength=held.shape[1])
            p, e, k = (a.reshape(-1) for a in np.indices(held.shape))
            seen = counts[p, e] > 0
            p, e, k = p[seen], e[seen], k[seen]
            total = pa.array([Decimal(int(t)) for t in totals[p, e, k]], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays(
                [pa.array(p), pa.array(e), pa.array(k), total, pa.array(counts[p, e])], names=["p", "e", "k", "total", "n"]
            )

        found = ints.select("ints").mapInArrow(sums, "p long, e long, k long, total decimal(38,0), n long")
        # a row per component of the codebooks, however many vectors there are
        for r in found.groupBy("p", "e", "k").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
            books[r.p, r.e, r.k] = int(r.total) // r.n
    return books


def encode(ints: DataFrame, books: np.ndarray) -> DataFrame:
    """`(vec_id, label, codes, error)`: a byte per part, and the sum of squared distances (of
    what is beyond a long, the greatest long)."""
    parts = books.shape[0]
    shared = ints.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, vectors in _matrices(batches, parts):
            codes, distances = nearest(vectors, shared.value)
            packed = [row.tobytes() for row in codes.astype(np.uint8)]
            error = [min(int(e), _LONG) for e in distances.astype(object).sum(axis=1)]
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), piece.column(1), pa.array(packed, pa.binary()), pa.array(error, pa.int64())],
                names=["vec_id", "label", "codes", "error"],
            )

    label = ints.schema["label"].dataType.simpleString()
    rows = ints.select("vec_id", "label", "ints")
    return rows.mapInArrow(run, f"vec_id long, label {label}, codes binary, error long")


def decode(codes: bytes, books: np.ndarray) -> np.ndarray:
    """The integer vector that a code stands for."""
    return books[np.arange(books.shape[0]), np.frombuffer(codes, dtype=np.uint8)].reshape(-1)


def with_label_error(coded: DataFrame) -> DataFrame:
    """Adds `label_error`: the sum of `error` over equal labels, those without label together."""
    keyed = coded.withColumn("__key", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("null")))
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(Decimal(_LONG))).cast("long")
    sums = keyed.groupBy("__key").agg(total.alias("label_error"))
    return lookup_join(keyed, sums, "__key", ["vec_id", "codes"]).drop("__key")


def books_sha256(books: np.ndarray) -> str:
    """Lowercase SHA-256 of all components by part, entry and place, comma-joined."""
    return hashlib.sha256(",".join(str(int(x)) for x in books.reshape(-1)).encode()).hexdigest()


def op12_vector_codes(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    ints = integer_vectors(vectors.select("vec_id", "label", "embedding"))
    books = learn(ints)
    coded = with_label_error(stage(encode(ints, books), "codes-coded"))
    return coded.select(
        "vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error",
        F.lit(books_sha256(books)).alias("codebooks_sha256"),
    )


def _assigned(name: str, books: str) -> str:
    """Nearest entry and squared distance of every part; both are in one number."""
    return f"""{name} AS (
  SELECT rid, p, any_value(x) AS x, min((xx - 2 * CAST(list_inner_product(x, c) AS BIGINT) + cc) * 64 + e) AS found
  FROM parts JOIN (SELECT *, CAST(list_inner_product(c, c) AS BIGINT) AS cc FROM {books}) USING (p) GROUP BY rid, p
)"""


def _moved(name: str, books: str, assigned: str) -> str:
    return f"""{name} AS (
  SELECT p, e, coalesce(m.c, b.c) AS c FROM {books} b LEFT JOIN (
    SELECT p, e, list(CAST(mean AS DOUBLE) ORDER BY k) AS c FROM (
      SELECT p, e, k, floor(sum(v) / count(*)) AS mean
      FROM (SELECT p, found % 64 AS e, unnest(x) AS v, unnest(range(len(x))) AS k FROM {assigned}) GROUP BY p, e, k
    ) GROUP BY p, e
  ) m USING (p, e)
)"""


OP12_SQL = f"""
WITH kept AS (
  SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS rid FROM (
    SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  )
), parts AS (
  SELECT rid, p, x, CAST(list_inner_product(x, x) AS BIGINT) AS xx FROM (
    SELECT rid, p, v[p * (len(v) // 16) + 1:(p + 1) * (len(v) // 16)] AS x FROM kept, range(16) r(p)
  )
), books0 AS (
  SELECT p, rid AS e, x AS c FROM parts WHERE rid < 64
), {_assigned("assigned0", "books0")}, {_moved("books1", "books0", "assigned0")},
{_assigned("assigned1", "books1")}, {_moved("books2", "books1", "assigned1")}, {_assigned("assigned2", "books2")},
coded AS (
  SELECT rid, string_agg(printf('%02x', found % 64), '' ORDER BY p) AS code, CAST(sum(found // 64) AS BIGINT) AS error
  FROM assigned2 GROUP BY rid
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(CAST(v AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, k))
        FROM (SELECT p, e, unnest(c) AS v, unnest(range(len(c))) AS k FROM books2)) AS codebooks_sha256
FROM kept JOIN coded USING (rid)
"""
