"""Substring dedup by seed and extend.

Seeds are winnowed: of the 8-word grams inside a window of 20 words the one with the
smallest hash. Equal windows choose the same seed, so all that can match meets where the
seed's bucket is. A seed is extended both ways to every window that chose it, up to 12 words
to either side: the windows, as hashes, travel with their seed, and those that an earlier
place has as well are repeats. Repeats that overlap join to maximal ones.

A group of a thousand copies is never paired. Each shard of texts settles its own repeats
first and sends only the first place of a window, so a passage that a third of all texts
share reaches its bucket once per shard. A phrase shorter than a window, with other words
around it each time, makes as many windows as it has places: windows of such a seed are
dealt by their own hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webcorpus.llm import words
from webcorpus.llm.batches import map_texts

WINDOW, SEED = 20, 8
#: Bytes of text that settle their repeats before anything is sent.
SHARD_BYTES = 6 << 20
#: Bytes of text per bucket of seeds.
BUCKET_BYTES = 8 << 20
#: Windows of one seed that may go to one bucket.
HOT_WINDOWS = 1 << 18
_LAST = (1 << 63) - 1
_NONE = np.empty(0, dtype=np.uint64)


def sliding_minimum(values: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every `size` consecutive values."""
    width, out = 1, values
    while width * 2 <= size:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    rest = size - width
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def seeds(hashes: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """For every window of words its seed's place (leftmost smallest) and hash."""
    grams = words.run_hashes(hashes, seed)
    span = window - seed + 1
    least = sliding_minimum(grams, span)
    place = np.zeros(len(least), dtype=np.int64)
    for k in range(span - 1, -1, -1):
        same = grams[k : k + len(least)] == least
        place[same] = np.flatnonzero(same) + k
    return place, least


def _row_key(column: str) -> list[F.Column]:
    """What tells rows apart: the id, NULL last, and a tag of the text."""
    return [
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("__doc"),
        F.coalesce(F.xxhash64(F.col(column)), F.lit(0)).bitwiseAND(0xFFFFFFFF).alias("__tag"),
    ]


_SENT = T.StructType(
    [T.StructField("bucket", T.IntegerType())]
    # of texts: id, tag; of seeds: text, first window, windows; of windows: 64-bit hash
    + [T.StructField(n, T.BinaryType()) for n in ("docs", "tags", "text", "start", "count", "whole")]
    # repeats that the shard has settled itself
    + [T.StructField("repeats", T.ArrayType(T.StructType([
        T.StructField("doc", T.LongType()), T.StructField("tag", T.LongType()), T.StructField("runs", T.BinaryType())])))]
)
_TYPES = {"docs": np.int64, "tags": np.uint32, "text": np.uint16, "start": np.uint32, "count": np.uint8, "whole": np.uint64}


def _runs_by_text(doc: np.ndarray, tag: np.ndarray, start: np.ndarray) -> list[dict]:
    """Sorted window starts as (first, count) runs, packed per text."""
    if not len(doc):
        return []
    order = np.lexsort((start, tag, doc))
    doc, tag, start = doc[order], tag[order], start[order].astype(np.int64)
    new_text = np.ones(len(doc), dtype=bool)
    new_text[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])
    new_run = new_text.copy()
    new_run[1:] |= start[1:] > start[:-1] + 1
    at = np.flatnonzero(new_run)
    last = np.append(at[1:], len(doc)) - 1
    runs = np.stack([start[at], start[last] - start[at] + 1], axis=1).astype(np.uint32)
    texts = np.flatnonzero(new_text)
    cut = np.searchsorted(at, np.append(texts, len(doc)))
    return [
        {"doc": int(doc[t]), "tag": int(tag[t]), "runs": runs[a:b].tobytes()}
        for t, a, b in zip(texts.tolist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True)
    ]


def _repeated(keys: list[np.ndarray], doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether a window with the same keys has an earlier place (doc, start)."""
    order = np.lexsort((start, doc, *keys))
    new = np.ones(len(order), dtype=bool)
    new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    first = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    out = np.empty(len(order), dtype=bool)
    out[order] = (doc[order] != doc[first]) | (start[order] != start[first])
    return out


def _hot_seeds(docs: DataFrame, column: str, window: int, seed: int, total: int) -> np.ndarray:
    """Hashes of all seeds with `HOT_WINDOWS` windows or more, sorted; some with half as many
    may be among them.

    A shard counts its seeds and reports those with more than its share, by bytes, of half
    that number, so what is not reported of a seed stays below that half.
    """
    half = HOT_WINDOWS / 2

    def run(batch: pa.RecordBatch, texts: pa.Array) -> Iterator[pa.RecordBatch]:
        for _, _, data, offsets in words.steps(texts, SHARD_BYTES):
            found = words.split(data, offsets)
            if len(found.starts) < window:
                continue
            row = found.rows()
            least = seeds(found.hashes(), window, seed)[1]
            least = np.sort(least[row[: len(least)] == row[window - 1 :]])
            new = np.ones(len(least), dtype=bool)
            new[1:] = least[1:] != least[:-1]
            at = np.flatnonzero(new)
            count = np.diff(np.append(at, len(least)))
            many = count >= half * len(data) / total
            yield pa.RecordBatch.from_arrays(
                [pa.array(least[at[many]].view(np.int64)), pa.array(count[many], pa.int64())], names=["seed", "n"]
            )

    if not total:
        return _NONE
    counted = map_texts(docs, [], run, "seed long, n long", column).groupBy("seed").agg(F.sum("n").alias("n"))
    hot = [r.seed for r in counted.where(F.col("n") >= half).select("seed").collect()]
    return np.sort(np.array(hot, dtype=np.int64).view(np.uint64))


def _send(buckets: int, window: int, seed: int, hot: np.ndarray):
    def run(batch: pa.RecordBatch, texts: pa.Array) -> Iterator[pa.RecordBatch]:
        docs = np.asarray(batch.column(0), dtype=np.int64)
        tags = np.asarray(batch.column(1), dtype=np.int64).astype(np.uint32)
        for low, high, data, offsets in words.steps(texts, SHARD_BYTES):
            found = words.split(data, offsets)
            if len(found.starts) < window:
                continue
            hashes, row = found.hashes(), found.rows()
            place, seed_hash = seeds(hashes, window, seed)
            whole = words.run_hashes(hashes, window)
            at = np.flatnonzero(row[: len(whole)] == row[window - 1 :])
            place, seed_hash, whole, text = place[at], seed_hash[at], whole[at], row[at]
            start = at - found.first[text]
            doc, tag = docs[low:high][text], tags[low:high][text]
            again = _repeated([whole, seed_hash], doc, start)
            repeats = _runs_by_text(doc[again], tag[again], start[again])
            keep = np.flatnonzero(~again)
            yield _packed(
                [v[keep] for v in (place, seed_hash, whole, text, start)],
                docs[low:high], tags[low:high], buckets, repeats, hot,
            )

    return run


def _packed(windows: list[np.ndarray], docs: np.ndarray, tags: np.ndarray, buckets: int, repeats: list[dict], hot: np.ndarray = _NONE) -> pa.RecordBatch:
    """Seeds with their windows, one row per bucket. Windows of `hot` seeds are dealt by their
    own hash, others by that of the seed."""
    key = windows[1]
    if len(hot):
        common = hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] == key
        key = np.where(common, windows[2], key)
    bucket = (key % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    place, _, whole, text, start = (w[order] for w in windows)
    new = np.ones(len(place), dtype=bool)
    new[1:] = (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1) | (text[1:] != text[:-1]) | (bucket[1:] != bucket[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(place)))
    used, first = np.unique(bucket, return_index=True)
    edges = np.append(first, len(place))
    seed_edges = np.searchsorted(at, edges)
    rows: dict[str, list] = {n: [] for n in _SENT.fieldNames()}
    for b, i in zip(used.tolist(), range(len(used)), strict=True):
        w, s = slice(edges[i], edges[i + 1]), at[seed_edges[i] : seed_edges[i + 1]]
        names, which = np.unique(text[s], return_inverse=True)
        values = {
            "docs": docs[names], "tags": tags[names], "text": which, "start": start[s],
            "count": count[seed_edges[i] : seed_edges[i + 1]], "whole": whole[w],
        }
        rows["bucket"].append(b)
        rows["repeats"].append([])
        for name, value in values.items():
            rows[name].append(value.astype(_TYPES[name]).tobytes())
    # what is settled already goes along, to any bucket
    rows["bucket"].append(int(docs[0]) % buckets)
    rows["repeats"].append(repeats)
    for name in _TYPES:
        rows[name].append(None)
    kinds = {"bucket": pa.int32(), "repeats": _REPEATS} | {n: pa.binary() for n in _TYPES}
    return pa.RecordBatch.from_arrays([pa.array(rows[n], kinds[n]) for n in rows], names=list(rows))


_RUNS = pa.schema([("doc", pa.int64()), ("tag", pa.int64()), ("runs", pa.binary())])
_REPEATS = pa.list_(pa.struct(list(_RUNS)))


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The repeats among the windows of each bucket; batches are sorted by bucket."""
    held: list[dict] = []
    bucket = None
    for batch in batches:
        for row in batch.to_pylist():
            if row["bucket"] != bucket:
                yield _settled(held)
                bucket, held = row["bucket"], []
            if row["docs"] is None:
                yield pa.RecordBatch.from_pylist(row["repeats"], _RUNS)
            else:
                held.append(row)
    yield _settled(held)


def _settled(rows: list[dict]) -> pa.RecordBatch:
    found: list[dict] = []
    if rows:
        parts: dict[str, list[np.ndarray]] = {n: [] for n in ("doc", "tag", "start", "whole")}
        for row in rows:
            values = {n: np.frombuffer(row[n], dtype=kind) for n, kind in _TYPES.items()}
            count = values["count"].astype(np.int64)
            each = np.repeat(np.arange(len(count)), count)
            text = values["text"][each]
            parts["doc"].append(values["docs"][text])
            parts["tag"].append(values["tags"][text])
            parts["start"].append(values["start"][each] + (np.arange(len(each)) - (np.cumsum(count) - count)[each]).astype(np.uint32))
            parts["whole"].append(values["whole"])
        rows.clear()
        joined = {n: np.concatenate(v) for n, v in parts.items()}
        del parts
        again = _repeated([joined["whole"]], joined["doc"], joined["start"])
        found = _runs_by_text(joined["doc"][again], joined["tag"][again], joined["start"][again])
    return pa.RecordBatch.from_pylist(found, _RUNS)


def repeats(docs: DataFrame, column: str = "text", window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """`(doc, tag, runs)`: starts of the windows that an earlier place has as well.

    Places are ordered by (doc_id, start), a NULL id last. Rows that share a `doc_id` are at
    the same place, so repeated rows are not repeats of each other; different texts under
    one id are told apart by the tag.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(column))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))
    sent = map_texts(docs, _row_key(column), _send(buckets, window, seed, _hot_seeds(docs, column, window, seed, total)), _SENT, column)
    return (
        sent.repartition(buckets, "bucket").sortWithinPartitions("bucket")
        .mapInArrow(_settle, "doc long, tag long, runs binary")
    )


def without_repeats(docs: DataFrame, keep: list[str], column: str = "text", window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """Per row the `keep` columns in `row`, with `(n_words, n_removed, kept)`.

    `kept` are the words that no repeated window covers, with one space between. NULL and
    empty texts have no words.
    """
    found = repeats(docs, column, window, seed).groupBy("doc", "tag").agg(F.collect_list("runs").alias("runs"))
    rows = docs.select(
        F.struct(F.lit(0).alias("__"), *[F.col(f"`{c}`") for c in keep]).alias("row"),
        *_row_key(column), F.col(column).alias("text"),
    )
    joined = rows.join(
        found.select(F.col("doc").alias("__doc"), F.col("tag").alias("__tag"), "runs"), ["__doc", "__tag"], "left"
    )

    def run(batch: pa.RecordBatch, texts: pa.Array) -> Iterator[pa.RecordBatch]:
        runs = batch.column(1)
        for low, high, data, offsets in words.steps(texts):
            raw, kept, counts, removed = data.tobytes(), [], [], []
            for i in range(high - low):
                own = raw[offsets[i] : offsets[i + 1]].split()
                counts.append(len(own))
                packed = runs[low + i].as_py()
                if packed:
                    own = _uncovered(own, packed, window)
                removed.append(counts[-1] - len(own))
                kept.append(b" ".join(own))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(low, high - low), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                ],
                names=["row", "n_words", "n_removed", "kept"],
            )

    schema = T.StructType([joined.schema["row"]] + [
        T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
    return map_texts(joined, [F.col("row"), F.col("runs")], run, schema)


def _uncovered(own: list[bytes], packed: list[bytes], window: int) -> list[bytes]:
    edge = np.zeros(len(own) + 1, dtype=np.int64)
    runs = np.frombuffer(b"".join(packed), dtype=np.uint32).reshape(-1, 2).astype(np.int64)
    np.add.at(edge, runs[:, 0], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1] + window - 1, -1)
    return [w for w, covered in zip(own, np.cumsum(edge)[:-1].tolist(), strict=True) if not covered]


def op6_substring_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return without_repeats(docs, ["doc_id"]).select(
        "row.doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    )
