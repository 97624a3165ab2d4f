"""Quality classifier: a byte-level convolutional network in numpy.

Learned filters slide over every byte of a text. A text is cut into chunks of 256 filter
positions whose windows reach into the next chunk, so the chunks overlap and cover the
whole text. Each filter is max-pooled per chunk; mean and maximum over the chunks go
through one hidden layer to one probability. A filter is a table per window position, so
an activation is a sum of table rows and no window is copied.

The network is fitted on a bounded sample of labelled texts, `SAMPLE` of either label with
`CHUNKS` chunks each, drawn by a hash of the id; every text is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webcorpus.llm import words
from webcorpus.llm.batches import map_texts

#: Filter positions of a chunk, bytes under a filter, filters, hidden units.
CHUNK, WIDTH, FILTERS, HIDDEN = 256, 6, 16, 12
#: Texts of each label to learn from, and chunks of each.
SAMPLE, CHUNKS = 2048, 6
_STEP = 1 << 16
_EPOCHS, _BATCH, _SHORT = 16, 64, 0.3


@dataclass
class Network:
    """`filters[k, b]` is what byte `b` at window position `k` adds to each filter."""

    filters: np.ndarray
    bias: np.ndarray
    inner: np.ndarray
    inner_bias: np.ndarray
    outer: np.ndarray
    outer_bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [self.filters, self.bias, self.inner, self.inner_bias, self.outer, self.outer_bias]

    def activations(self, data: np.ndarray) -> np.ndarray:
        """Filter sums at every position whose window is inside `data`."""
        n = len(data) - WIDTH + 1
        total = self.filters[0].take(data[:n], axis=0)
        for k in range(1, WIDTH):
            total += self.filters[k].take(data[k : k + n], axis=0)
        return total

    def pooled(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Maximum of each filter over the chunks that begin at `starts` (0 first)."""
        return np.maximum.reduceat(self.activations(data), starts, axis=0)

    def head(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        inner = np.tanh(features @ self.inner + self.inner_bias)
        return inner, 1 / (1 + np.exp(-(inner @ self.outer + self.outer_bias)))

    def features(self, chunks: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Mean and maximum over the chunks of each text."""
        lit = np.maximum(chunks + self.bias, 0)
        count = np.diff(np.append(first, len(lit)))[:, None]
        return np.concatenate([np.add.reduceat(lit, first, axis=0) / count, np.maximum.reduceat(lit, first, axis=0)], axis=1)


def chunk_starts(size: int) -> np.ndarray:
    """Where the chunks of a text begin; an empty text has one."""
    return np.arange(0, max(size, 1), CHUNK)


def score_texts(network: Network, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Probability of label 1 for each of the texts `data[offsets[i]:offsets[i + 1]]`."""
    pooled: list[np.ndarray] = []
    counts = np.maximum(1, -(-np.diff(offsets) // CHUNK))
    parts: list[np.ndarray] = []
    starts: list[np.ndarray] = []
    own: list[np.ndarray] = []
    held = 0

    def flush() -> None:
        nonlocal held
        if held:
            edge = np.zeros(WIDTH - 1, dtype=np.uint8)
            found = network.pooled(np.concatenate([*parts, edge]), np.concatenate(starts))
            pooled.append(found[np.concatenate(own)])
            for held_list in (parts, starts, own):
                held_list.clear()
            held = 0

    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        at = a
        while True:
            # a piece of whole chunks, then the bytes its last windows reach into: those of
            # the text, zeros behind its end; windows that begin there are nobody's
            to = min(b, at + _STEP)
            size = max(to - at, 1)
            piece = np.zeros(size + WIDTH - 1, dtype=np.uint8)
            reach = data[at : min(b, to + WIDTH - 1)]
            piece[: len(reach)] = reach
            begin = np.append(chunk_starts(size), size)
            parts.append(piece)
            starts.append(begin + held)
            own.append(np.append(np.ones(len(begin) - 1, dtype=bool), False))
            held += len(piece)
            at = to
            if held >= _STEP:
                flush()
            if at >= b:
                break
    flush()
    if not len(counts):
        return np.zeros(0)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    return network.head(network.features(np.concatenate(pooled), first))[1][:, 0].astype(float)


def fit(texts: list[list[bytes]], labels: np.ndarray, seed: int = 7) -> Network:
    """Adam on the log loss. `texts` are lists of chunks with `WIDTH - 1` bytes of reach.

    Labels weigh alike in sum; with no texts, or one label only, the head's bias alone
    tells: 1/2 without texts, else close to the label seen.
    """
    rng = np.random.default_rng(seed)
    f32 = np.float32
    network = Network(
        rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(f32), np.full(FILTERS, -0.5, f32),
        rng.normal(0, 0.3, (2 * FILTERS, HIDDEN)).astype(f32), np.zeros(HIDDEN, f32),
        rng.normal(0, 0.3, (HIDDEN, 1)).astype(f32), np.zeros(1, f32),
    )
    if len(labels) == 0 or labels.min() == labels.max():
        network.outer[:] = 0
        network.outer_bias[:] = 0 if len(labels) == 0 else (3 if labels[0] else -3)
        return network
    weight = np.where(labels == 1, 0.5 / np.mean(labels == 1), 0.5 / np.mean(labels == 0)).astype(f32)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in network.parameters()]
    step, epochs = 0, max(_EPOCHS, -(-_EPOCHS * 1000 // len(labels)))
    for epoch in range(min(epochs, 8 * _EPOCHS)):
        order = rng.permutation(len(labels))
        for low in range(0, len(order), _BATCH):
            rows = order[low : low + _BATCH]
            drawn = [_shortened(texts[i], rng) for i in rows]
            gradients = _gradients(network, drawn, labels[rows], weight[rows])
            step += 1
            rate = 0.02 * min(1, step / 20) * 0.5 * (1 + np.cos(np.pi * epoch / min(epochs, 8 * _EPOCHS)))
            for p, g, (m, v) in zip(network.parameters(), gradients, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(f32)
    return network


def _shortened(chunks: list[bytes], rng: np.random.Generator) -> list[bytes]:
    """Now and then a few bytes of a text only, so that short texts are learned as well."""
    if rng.random() > _SHORT:
        return chunks
    chunk = chunks[rng.integers(len(chunks))]
    size = min(int(rng.integers(10, 80)), len(chunk) - WIDTH + 1)
    return [chunk[:size] + bytes(WIDTH - 1)]


def _gradients(network: Network, texts: list[list[bytes]], labels: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    chunks = [c for t in texts for c in t]
    count = np.array([len(t) for t in texts])
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    data = np.frombuffer(b"".join(chunks), dtype=np.uint8)
    start = np.concatenate([[0], np.cumsum([len(c) for c in chunks])[:-1]])
    padded = np.concatenate([data, np.zeros(WIDTH - 1, np.uint8)])
    act = network.activations(padded)
    size = np.array([len(c) for c in chunks]) - (WIDTH - 1)
    top = np.empty((len(chunks), FILTERS), dtype=np.int64)
    for i, (s, n) in enumerate(zip(start.tolist(), size.tolist(), strict=True)):
        top[i] = act[s : s + n].argmax(axis=0) + s
    pooled = act[top, np.arange(FILTERS)]
    features = network.features(pooled, first)
    inner, p = network.head(features)
    out = ((p[:, 0] - labels) * weight / len(labels)).astype(np.float32)[:, None]
    d_inner = out @ network.outer.T * (1 - inner**2)
    d_features = d_inner @ network.inner.T
    lit = np.maximum(pooled + network.bias, 0)
    text = np.repeat(np.arange(len(texts)), count)
    d_lit = d_features[text, :FILTERS] / count[text][:, None]
    is_top = lit == np.maximum.reduceat(lit, first, axis=0)[text]
    d_lit = np.where(is_top, d_lit + d_features[text, FILTERS:], d_lit) * (lit > 0)
    d_filters = np.zeros_like(network.filters)
    which = np.broadcast_to(np.arange(FILTERS), top.shape)
    for k in range(WIDTH):
        np.add.at(d_filters[k], (padded[top + k], which), d_lit)
    return [d_filters, d_lit.sum(0), features.T @ d_inner, d_inner.sum(0), inner.T @ out, out.sum(0)]


def _sampled_chunks(text: bytes, key: int) -> list[bytes]:
    """At most `CHUNKS` chunks of a text, with the bytes their windows reach into."""
    starts = chunk_starts(len(text))
    if len(starts) > CHUNKS:
        starts = np.sort(np.random.default_rng(abs(key)).choice(starts, CHUNKS, replace=False))
    whole = text + bytes(WIDTH)  # an empty text is one position of padding
    return [whole[s : min(s + CHUNK, max(len(text), 1)) + WIDTH - 1] for s in starts.tolist()]


def learn(docs: DataFrame, labels: DataFrame, usable: Column, column: str = "text") -> Network:
    """A network from `SAMPLE` labelled texts of either label where `usable` holds.

    Of several labels of a `doc_id` the smallest counts; NULL labels and ids do not.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & usable)
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality")).select("doc_id", "quality")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    drawn = [known.where(F.col("quality") == q).orderBy(*order).limit(SAMPLE) for q in (0, 1)]
    sample = F.broadcast(drawn[0].unionByName(drawn[1]).withColumnRenamed("quality", "__label"))

    def run(batch: pa.RecordBatch, texts: pa.Array) -> Iterator[pa.RecordBatch]:
        ids = batch.column(0).to_pylist()
        cut = [_sampled_chunks(t, i) for t, i in zip(texts.to_pylist(), ids, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(cut, pa.list_(pa.binary()))], names=["doc_id", "label", "chunks"]
        )

    met = docs.select(F.col("doc_id"), F.col(column).alias("text")).join(sample, "doc_id")
    met = met.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("__label").cast("int").alias("label"), "text")
    rows = map_texts(met, [F.col("doc_id"), F.col("label")], run, "doc_id long, label int, chunks array<binary>")
    # repeated rows of a sampled id are no more than one text
    rows = sorted(rows.groupBy("doc_id").agg(F.min(F.struct("label", "chunks")).alias("r")).select("doc_id", "r.*").collect())
    return fit([[bytes(c) for c in r.chunks] for r in rows], np.array([r.label for r in rows], dtype=np.float32))


def score(docs: DataFrame, network: Network, keep: list[str], name: str = "score", column: str = "text") -> DataFrame:
    """Per row the `keep` columns in `row` and the probability of label 1 of its whole text.
    NULL and empty texts get the score of one chunk of padding."""
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # a text that is kept is not sent twice
            texts = pc.struct_field(batch.column(0), column) if column in keep else batch.column(1)
            for low, high, data, offsets in words.steps(pc.fill_null(texts.cast(pa.binary()), b"")) if batch.num_rows else ():
                scores = pa.array(score_texts(shared.value, data, offsets), pa.float64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), scores], names=["row", name])

    row = F.struct(F.lit(0).alias("__"), *[F.col(f"`{c}`") for c in keep]).alias("row")
    kept = docs.select(row) if column in keep else docs.select(row, F.col(column).cast("binary").alias("__text"))
    schema = T.StructType([kept.schema["row"], T.StructField(name, T.DoubleType())])
    return kept.mapInArrow(run, schema)


def remainder(column: Column, parts: int) -> Column:
    """crc32 of an id as text, modulo `parts`; NULL is 0."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % parts, F.lit(0))


def op9_quality(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    network = learn(docs, labels, remainder(F.col("doc_id"), 4) != 2)
    scored = score(docs, network, ["doc_id"]).select("row.doc_id", "score")
    return scored.select(
        "doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score",
        F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"),
    )
