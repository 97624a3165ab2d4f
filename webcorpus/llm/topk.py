"""Exact top-k search by inner product: exhaustive, term at a time.

Every component of a vector is a term with a posting list of (candidate, weight). The table
is dealt into a grid of query blocks by candidate blocks of bounded size. In a cell, each
term scatters its postings, times the weight the term has in the sparse query rows, into
dense score arrays; a partition selection keeps the best of each query, and the cells'
lists are merged by rank.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webcorpus.plans.storage import stage

#: Rows of a block; a cell holds one block of either kind.
CANDIDATES, QUERIES = 2048, 1024
#: Fewest candidate blocks, so that small tables are spread as well.
FEWEST = 16
#: Query rows whose score arrays are held at once.
_ROWS = 64


def scaled_floor(column: Column, scale: int = 64) -> Column:
    """`floor(scale * x)` of each component, x as double; beyond 64 bits the nearest long."""
    return F.transform(column, lambda x: F.floor(x.cast("double") * float(scale)))


def usable(column: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    infinite = float("inf")
    finite = F.forall(
        column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(infinite))
    )
    return column.isNotNull() & F.coalesce(finite, F.lit(False))


def weights(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """`(vec_id, weights)` of the vectors that take part.

    Vectors that are NULL or hold NULL or non-finite components, and rows without `vec_id`,
    take no part. Rows that share a `vec_id` all stay.
    """
    return vectors.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(
        "vec_id", scaled_floor(F.col("embedding"), scale).alias("weights")
    )


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of integer lists; shorter ones end in zeros, which score nothing."""
    lists = column.combine_chunks()
    lengths = np.diff(np.asarray(lists.offsets))
    out = np.zeros((len(lengths), int(lengths.max(initial=0))), dtype=np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = np.asarray(lists.flatten())
    return out


def _cell(candidates: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """The k best candidates of a block for each query of a block."""
    names = ["query_id", "vec_id", "score"]
    found: list[list[np.ndarray]] = [[np.empty(0, np.int64)] for _ in names]
    ids = np.asarray(candidates["vec_id"].combine_chunks(), dtype=np.int64)
    order = np.argsort(ids, kind="stable")
    ids, held = ids[order], _matrix(candidates["weights"])[order]
    asked, rows = np.asarray(queries["vec_id"].combine_chunks(), dtype=np.int64), _matrix(queries["weights"])
    terms = min(held.shape[1], rows.shape[1])
    reach = float(np.abs(held.astype(float)).max(initial=0)) * float(np.abs(rows.astype(float)).max(initial=0)) * max(terms, 1)
    kind = np.int32 if reach < 2**31 - 1 else np.int64
    postings = []
    for t in range(terms):
        at = np.flatnonzero(held[:, t])
        postings.append((at if len(at) < len(ids) else slice(None), held[at, t].astype(kind)[:, None]))
    # more than k, as a query may meet the rows of its own id
    best = min(k + int(np.unique(ids, return_counts=True)[1].max(initial=0)), len(ids))
    for low in range(0, len(asked) if len(ids) else 0, _ROWS):
        block, own = rows[low : low + _ROWS].astype(kind), asked[low : low + _ROWS]
        scores = np.zeros((len(ids), len(own)), dtype=kind)
        for t, (at, weight) in enumerate(postings):
            if len(weight) and block[:, t].any():
                scores[at] += weight * block[:, t]
        scores = np.ascontiguousarray(scores.T)
        least = np.partition(scores, len(ids) - best, axis=1)[:, len(ids) - best]
        row, col = np.nonzero((scores >= least[:, None]) & (ids != own[:, None]))
        score = scores[row, col].astype(np.int64)
        ranked = np.lexsort((col, -score, row))
        row, col, score = row[ranked], col[ranked], score[ranked]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        kept = place < k
        for values, new in zip(found, (own[row], ids[col], score), strict=True):
            values.append(new[kept])
    return pa.table({n: np.concatenate(v) for n, v in zip(names, found, strict=True)})


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 20, blocks: tuple[int, int] = (CANDIDATES, QUERIES)) -> DataFrame:
    """`(query_id, rank, vec_id, score)`: the k best candidates of each query by inner product.

    Both tables are `(vec_id, weights)`. Every row with another id is a candidate, also of
    rows that share an id; queries that share one have k rows together. A query never meets
    its own id. Ties go to the smaller `vec_id`; a query without candidates has no rows.
    """
    n = max(FEWEST, -(-candidates.count() // blocks[0]))
    m = max(1, -(-queries.count() // blocks[1]))
    each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = candidates.select(
        F.pmod(F.xxhash64("vec_id", "weights"), F.lit(n)).cast("int").alias("c"), each(m).alias("q"), "vec_id", "weights"
    )
    right = queries.select(
        each(n).alias("c"), F.pmod(F.xxhash64("vec_id", "weights"), F.lit(m)).cast("int").alias("q"), "vec_id", "weights"
    )

    def cell(held: pa.Table, asked: pa.Table) -> pa.Table:
        return _cell(held, asked, k)

    lists = left.groupBy("c", "q").cogroup(right.groupBy("c", "q")).applyInArrow(
        cell, "query_id long, vec_id long, score long"
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        lists.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def op5_topk(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    table = stage(weights(vectors.select("vec_id", "embedding")), "topk-weights")
    return top_k(table.where(F.col("vec_id") % 20 == 0), table)


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_inner_product(CAST(q.w AS DOUBLE[]), CAST(c.w AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 20
"""
