"""Line dedup by pairwise alignment.

Documents that overlap are found through all lines they share: each document meets the
first document that has the line, never all others that do, so a line in a third of all
documents makes one pair for each of them. A pair is aligned by patience diff: lines that
stand once on either side and keep their order are fixed points, and between them lines
are matched onwards from both ends and again by lines that stand once there. Common
blocks are deleted from the later document.

Only hashes of lines are paired and aligned. Texts are read again when the deletions of a
document are known.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webcorpus.llm import words
from webcorpus.llm.batches import map_texts
from webcorpus.plans.storage import stage

_LAST = (1 << 63) - 1
#: No line is too common to pair documents; the tests read this limit, the code has none.
RARE = _LAST
#: Bytes of text in the lines of a block that is deleted.
BLOCK_BYTES = 40


def _row_key(column: str) -> list[Column]:
    return [
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"),
        F.xxhash64(F.coalesce(F.col(column), F.lit(""))).alias("tag"),
    ]


def cut_lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and size of each line that is not blank, and the first one of each text.

    Lines end at line feeds; white space around a line does not count. A blank line has no
    hash and no number.
    """
    lines = words.split(data, offsets, words.LINES)
    # first and last byte of each line that is not white space
    solid = np.flatnonzero(words.SPACED[data])
    begin, end = np.searchsorted(solid, lines.starts), np.searchsorted(solid, lines.ends)
    full = end > begin
    starts, ends = solid[begin[full]], solid[end[full] - 1] + 1
    first = np.concatenate([[0], np.cumsum(full)])[lines.first]
    return words.hash_spans(data, starts, ends).view(np.int64), ends - starts, first


def matched(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Patience diff: matched positions of two sequences, ascending in both."""
    out: list[tuple[int, int]] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        once_a, once_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {v: j for j, v in enumerate(b[b0:b1], b0) if once_b[v] == 1}
        common = [(i, where[v]) for i, v in enumerate(a[a0:a1], a0) if once_a[v] == 1 and v in where]
        fixed = _rising(common)
        if not fixed:
            continue
        out += fixed
        edges = [(a0 - 1, b0 - 1), *fixed, (a1, b1)]
        work += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges[:-1], edges[1:], strict=True)]
    return sorted(out)


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest chain of pairs, sorted by the first, that rises in the second."""
    piles: list[int] = []
    tops: list[int] = []
    before = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(piles, j)
        if at:
            before[k] = tops[at - 1]
        if at == len(piles):
            piles.append(j)
            tops.append(k)
        else:
            piles[at], tops[at] = j, k
    chain: list[tuple[int, int]] = []
    k = tops[-1] if tops else -1
    while k >= 0:
        chain.append(pairs[k])
        k = before[k]
    return chain[::-1]


def common_blocks(later: list[int], sizes: list[int], earlier: list[int], least: int = BLOCK_BYTES) -> list[tuple[int, int]]:
    """(first, count) of the blocks of `later` that are aligned side by side in both and have
    `least` bytes."""
    blocks: list[list[int]] = []
    last = (-2, -2)
    for i, j in matched(later, earlier):
        if (i - 1, j - 1) == last:
            blocks[-1][1] += 1
        else:
            blocks.append([i, 1])
        last = (i, j)
    return [(i, n) for i, n in blocks if sum(sizes[i : i + n]) >= least]


def line_table(docs: DataFrame, column: str = "text") -> DataFrame:
    """`(doc, tag, lines, sizes)` of each document; blank lines are left out."""

    def run(batch: pa.RecordBatch, texts: pa.Array) -> Iterator[pa.RecordBatch]:
        for low, high, data, offsets in words.steps(texts):
            hashes, sizes, first = cut_lines(data, offsets)
            edges = pa.array(first, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(i).slice(low, high - low) for i in (0, 1)],
                    pa.ListArray.from_arrays(edges, pa.array(hashes)), pa.ListArray.from_arrays(edges, pa.array(sizes, pa.int32())),
                ],
                names=["doc", "tag", "lines", "sizes"],
            )

    return map_texts(docs, _row_key(column), run, "doc long, tag long, lines array<long>, sizes array<int>", column)


def overlapping(lines: DataFrame) -> DataFrame:
    """Pairs of documents `(doc, tag, first)`: `first` is an earlier one (doc, tag) that is
    the first to have a shared line, however many documents have it."""
    each = lines.select("doc", "tag", F.explode(F.array_distinct("lines")).alias("line"))
    shared = stage(
        each.groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "tag")).alias("first")).where("n > 1"),
        "shared-lines",
    )
    met = each.join(shared, "line").where(F.struct("doc", "tag") != F.col("first"))
    return met.select("doc", "tag", "first").distinct()


def repeated_blocks(docs: DataFrame, column: str = "text", least: int = BLOCK_BYTES) -> DataFrame:
    """`(doc, tag, blocks)`: the lines, counted without blank ones, that each document has in
    aligned blocks with earlier documents, as (first, count) arrays.

    Documents are ordered by (doc_id, hash of the text), a NULL id last; rows that share
    both are one document and do not repeat each other.
    """
    lines = stage(line_table(docs, column).dropDuplicates(["doc", "tag"]), "document-lines")
    pairs = stage(overlapping(lines), "line-pairs")
    later = pairs.join(lines, ["doc", "tag"])
    other = lines.select(F.col("doc").alias("o_doc"), F.col("tag").alias("o_tag"), F.col("lines").alias("o_lines"))
    met = later.select("doc", "tag", "lines", "sizes", F.col("first.doc").alias("o_doc"), F.col("first.tag").alias("o_tag"))
    met = met.join(other, ["o_doc", "o_tag"]).select("doc", "tag", "lines", "sizes", "o_lines")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                common_blocks(a, sizes, b, least)
                for a, sizes, b in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([[list(x) for x in f] for f in found], pa.list_(pa.list_(pa.int32())))],
                names=["doc", "tag", "blocks"],
            )

    blocks = met.mapInArrow(run, "doc long, tag long, blocks array<array<int>>").where(F.size("blocks") > 0)
    return blocks.groupBy("doc", "tag").agg(F.flatten(F.collect_list("blocks")).alias("blocks"))


def _kept_text(text: bytes, blocks: list[list[int]]) -> tuple[int, int, bytes]:
    """Lines that are not blank, how many of them are deleted, and the text without them."""
    gone: set[int] = set()
    for first, count in blocks or ():
        gone.update(range(first, first + count))
    kept, number = [], 0
    for line in text.split(b"\n"):
        if line.strip(b" \t\r\x0b\x0c"):
            if number not in gone:
                kept.append(line)
            number += 1
        else:
            kept.append(line)
    return number, len(gone), b"\n".join(kept) if gone else text


def without_repeated_lines(docs: DataFrame, keep: list[str], column: str = "text", least: int = BLOCK_BYTES) -> DataFrame:
    """Per row the `keep` columns in `row`, and `(n_lines, n_removed, kept)`: lines that are
    not blank, those deleted, and what is left of the text (NULL and empty: empty)."""
    found = stage(repeated_blocks(docs, column, least), "line-blocks")
    rows = docs.select(
        F.struct(F.lit(0).alias("__"), *[F.col(f"`{c}`") for c in keep]).alias("row"), *_row_key(column), F.col(column).alias("text")
    )
    joined = rows.join(found, ["doc", "tag"], "left")

    def run(batch: pa.RecordBatch, texts: pa.Array) -> Iterator[pa.RecordBatch]:
        for low, high, data, offsets in words.steps(texts):
            raw = data.tobytes()
            done = [
                _kept_text(raw[a:b], blocks)
                for a, b, blocks in zip(offsets[:-1].tolist(), offsets[1:].tolist(), batch.column(1).slice(low, high - low).to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(low, high - low), pa.array([d[0] for d in done], pa.int64()),
                    pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.binary()).cast(pa.string()),
                ],
                names=["row", "n_lines", "n_removed", "kept"],
            )

    schema = T.StructType([joined.schema["row"], T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
    return map_texts(joined, [F.col("row"), F.col("blocks")], run, schema)


def op1_line_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return without_repeated_lines(docs, ["doc_id"]).select(
        "row.doc_id", "n_lines", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    )
