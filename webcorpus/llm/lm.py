"""Language-model scoring with a log-bilinear neural model.

Words are counted exactly over all training texts. The neural model speaks of units: each of
the most frequent words is one, other frequent words share units by their count, and all
remaining words are the last unit. It predicts a unit from the two before it: their vectors
are mapped, added and multiplied with the vector of the predicted unit. It is trained in
numpy with noise-contrastive estimation against the frequencies of units, on the counts of
all (unit, unit, unit) in the training texts, a table of fixed size. Batched matrix
products over all pairs of units then give normalised log probabilities.

The probability of a token is that of its unit times that of the word in the unit: its
share of the counts. In the last unit one event stands for all unknown words, with the
probability that words seen once give it. All events together have probability 1: `score` is
that of the events of a text, as its base is. `text_score` is that of the text itself: an
unknown word has the probability of the event times that of its bytes, each given the one
before, and of its end, learned from rare training words. Over all strings these add up to 1,
so all texts together have at most 1. Texts of random letters are unlikely by `text_score`
only; filter by that.

Frequent words are looked up in a table of bounded size that every task holds. Rare words,
which no text has many of, are dealt by hash to where their counts are, and only sums per
text come back.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webcorpus.llm import words
from webcorpus.llm.batches import by_bucket, dealt, map_texts
from webcorpus.plans.storage import stage

#: Words whose counts every task holds.
FREQUENT = 200_000
#: Units, and units that share words by the power of two of their count.
UNITS, SHARED = 128, 24
#: Length of vectors, noise samples per token, training steps.
VECTOR, NOISE, STEPS = 16, 8, 160
#: Bytes of text whose words are counted together, and per bucket of words.
RUN_BYTES, BUCKET_BYTES = 6 << 20, 8 << 20
#: Added to each count by the base score.
ADDED = 0.1
#: Added to each count of a byte after a byte.
ADDED_BYTES = 0.5
END = np.uint64(0xE4D0F7E478C1A53B)
#: Kinds of bytes in a word's spelling; the last is its start and its end.
_BYTES = 257


@dataclass
class Counts:
    """Exact counts of training tokens: totals, and the frequent words sorted by hash."""

    tokens: int
    types: int
    once: int
    hashes: np.ndarray
    counts: np.ndarray

    def rare(self) -> int:
        return self.tokens - int(self.counts.sum())

    def unknown(self) -> float:
        """Share of the last unit that unknown words have."""
        return (self.once + 1) / (self.rare() + self.once + 2)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + ADDED) / (self.tokens + ADDED * (self.types + 1)))

    def inside_rare(self, counts: np.ndarray) -> np.ndarray:
        """log10 probability of words of the last unit, given that unit; count 0: unknown."""
        u = self.unknown()
        return np.where(counts > 0, np.log10(np.maximum(counts, 1) * (1 - u) / max(self.rare(), 1)), np.log10(u))


@dataclass
class Model:
    """What scoring needs: units and shares of frequent words, log10 P(unit | two units),
    log10 P(byte | byte before) of unknown words."""

    counts: Counts
    units: np.ndarray
    inside: np.ndarray
    table: np.ndarray
    spelling: np.ndarray


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, words.Words, np.ndarray]:
    """Hashes of the tokens of texts, an end after each, the first token of each text, the
    words, and which tokens are ends."""
    found = words.split(words.LOWER[data], offsets)
    first = found.first + np.arange(len(found.first))
    out = np.empty(int(first[-1]), dtype=np.uint64)
    end = np.zeros(len(out), dtype=bool)
    end[first[1:] - 1] = True
    out[~end] = found.hashes()
    out[end] = END
    return out, first, found, end


def _steps_of_bytes(found: words.Words) -> tuple[np.ndarray, np.ndarray]:
    """Per byte of the texts its cell in the table of bytes after bytes, and per word that of its end."""
    cell = found.data.astype(np.int64)
    cell[1:] += found.data[:-1].astype(np.int64) * _BYTES
    cell[found.starts] = found.data[found.starts].astype(np.int64) + (_BYTES - 1) * _BYTES
    return cell, found.data[found.ends - 1].astype(np.int64) * _BYTES + _BYTES - 1


def count_bytes(found: words.Words, chosen: np.ndarray) -> np.ndarray:
    """How often each byte follows each byte in the chosen words, flat."""
    cell, last = _steps_of_bytes(found)
    inside = np.zeros(len(cell) + 1, dtype=np.int64)
    np.add.at(inside, found.starts[chosen], 1)
    np.add.at(inside, found.ends[chosen], -1)
    seen = np.concatenate([cell[np.cumsum(inside)[:-1] > 0], last[chosen]])
    return np.bincount(seen, minlength=_BYTES * _BYTES)


def spelling_of(counts: np.ndarray) -> np.ndarray:
    """log10 P(byte | byte before), flat; without counts all are equally likely."""
    added = counts.reshape(_BYTES, _BYTES) + ADDED_BYTES
    return np.log10(added / added.sum(axis=1, keepdims=True)).ravel()


def spelled(found: words.Words, spelling: np.ndarray) -> np.ndarray:
    """log10 probability of the bytes and the end of each word; over all strings it is 1."""
    cell, last = _steps_of_bytes(found)
    sums = np.concatenate([[0.0], np.cumsum(spelling[cell])])
    return sums[found.ends] - sums[found.starts] + spelling[last]


_COUNT = {"hash": np.uint64, "number": np.int64}


def count_words(docs: DataFrame, learn: Column, buckets: int, column: str = "text") -> DataFrame:
    """`(bucket, hash, number, tokens, types, once, top_hash, top_number)`: packed counts of
    the tokens of the texts where `learn` holds, by bucket of the hash."""

    def send(batch: pa.RecordBatch, texts: pa.Array) -> Iterator[pa.RecordBatch]:
        for _, _, data, offsets in words.steps(texts, RUN_BYTES):
            value, number = np.unique(_tokens(data, offsets)[0], return_counts=True)
            cut = dealt((value % np.uint64(buckets)).astype(np.int64), {"hash": value, "number": number})
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(cut["bucket"], pa.int32()), "hash": cut["hash"], "number": cut["number"]})

    most = -(-FREQUENT // buckets)

    def add(columns: dict) -> pa.RecordBatch:
        value, at = np.unique(columns["hash"], return_inverse=True)
        number = np.zeros(len(value), dtype=np.int64)
        np.add.at(number, at, columns["number"])
        top = np.lexsort((value, -number))[:most]
        top = top[number[top] > 1]
        row = {
            "bucket": int(value[0] % np.uint64(buckets)), "hash": value.tobytes(), "number": number.tobytes(),
            "tokens": int(number.sum()), "types": len(value), "once": int((number == 1).sum()),
            "top_hash": value[top].tobytes(), "top_number": number[top].tobytes(),
        }
        kinds = {"bucket": pa.int32(), **{n: pa.int64() for n in ("tokens", "types", "once")}}
        return pa.RecordBatch.from_arrays([pa.array([v], kinds.get(n, pa.binary())) for n, v in row.items()], names=list(row))

    sent = map_texts(docs.where(learn), [F.lit(0).alias("__")], send, "bucket int, hash binary, number binary", column)
    return (
        sent.repartition(buckets, "bucket").sortWithinPartitions("bucket")
        .mapInArrow(
            lambda batches: by_bucket(batches, _COUNT, add),
            "bucket int, hash binary, number binary, tokens long, types long, once long, top_hash binary, top_number binary",
        )
    )


def totals(table: DataFrame) -> Counts:
    row = table.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "types", "once")]).first()
    tops = table.select("top_hash", "top_number").collect()  # FREQUENT words at most
    hashes = np.concatenate([np.empty(0, np.uint64), *[np.frombuffer(t.top_hash, np.uint64) for t in tops]])
    numbers = np.concatenate([np.empty(0, np.int64), *[np.frombuffer(t.top_number, np.int64) for t in tops]])
    order = np.argsort(hashes)
    return Counts(int(row.tokens), int(row.types), int(row.once), hashes[order], numbers[order])


def units_of(counts: Counts) -> tuple[np.ndarray, np.ndarray]:
    """Unit of each frequent word and its log10 share of the unit."""
    order = np.lexsort((counts.hashes, -counts.counts))
    units = np.empty(len(order), dtype=np.int64)
    own = UNITS - SHARED - 1
    units[order[:own]] = np.arange(len(order[:own]))
    rest = order[own:]
    power = np.floor(np.log2(np.maximum(counts.counts[rest], 1))).astype(np.int64)
    units[rest] = own + np.clip(power, 0, SHARED - 1)
    sums = np.bincount(units, weights=counts.counts, minlength=UNITS)
    return units, np.log10(counts.counts / sums[units]) if len(units) else np.empty(0)


def _looked_up(tokens: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct tokens: values, place among the frequent words (-1: rare), and the inverse."""
    value, inverse = np.unique(tokens, return_inverse=True)
    hashes = model.counts.hashes
    if not len(hashes):
        return value, np.full(len(value), -1), inverse
    at = np.minimum(np.searchsorted(hashes, value), len(hashes) - 1)
    return value, np.where(hashes[at] == value, at, -1), inverse


def _codes(unit: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Context of each token: its two units before, UNITS where the text has not begun."""
    width = UNITS + 1
    one = np.empty(len(unit), dtype=np.int64)
    one[1:] = unit[:-1]
    one[first[:-1]] = UNITS
    two = np.empty(len(unit), dtype=np.int64)
    two[1:] = one[:-1]
    two[first[:-1]] = UNITS
    return two * width + one, unit


def count_units(docs: DataFrame, learn: Column, shared, column: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """How often each unit follows each pair of units, (UNITS + 1)**2 by UNITS, and each byte
    each byte in rare words."""
    units = (UNITS + 1) ** 2 * UNITS
    cells = units + _BYTES * _BYTES
    parts = 16

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        total = np.zeros(cells, dtype=np.int64)
        for batch in batches:
            for _, _, data, offsets in words.steps(batch.column(0)) if batch.num_rows else ():
                tokens, first, found, end = _tokens(data, offsets)
                _, at, inverse = _looked_up(tokens, model)
                total[units:] += count_bytes(found, (at < 0)[inverse[~end]])
                unit = np.full(len(at), UNITS - 1)
                unit[at >= 0] = model.units[at[at >= 0]]
                context, follows = _codes(unit[inverse], first)
                np.add.at(total, context * UNITS + follows, 1)
        used = np.flatnonzero(total)
        cut = dealt(used % parts, {"code": used.astype(np.uint32), "number": total[used]})
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(cut["bucket"], pa.int32()), "code": pa.array(cut["code"], pa.binary()), "number": pa.array(cut["number"], pa.binary())})

    def add(columns: dict) -> pa.RecordBatch:
        code, at = np.unique(columns["code"], return_inverse=True)
        number = np.zeros(len(code), dtype=np.int64)
        np.add.at(number, at, columns["number"])
        return pa.RecordBatch.from_pylist([{"code": code.tobytes(), "number": number.tobytes()}])

    texts = docs.where(learn).select(F.coalesce(F.col(column).cast("binary"), F.lit(b"")).alias("text"))
    kinds = {"code": np.uint32, "number": np.int64}
    rows = (
        texts.mapInArrow(send, "bucket int, code binary, number binary").repartition(parts, "bucket")
        .sortWithinPartitions("bucket").mapInArrow(lambda b: by_bucket(b, kinds, add), "code binary, number binary").collect()
    )
    out = np.zeros(cells, dtype=np.int64)
    for row in rows:
        out[np.frombuffer(row.code, np.uint32)] = np.frombuffer(row.number, np.int64)
    return out[:units].reshape(-1, UNITS), out[units:]


def train(follows: np.ndarray, steps: int = STEPS, seed: int = 3) -> np.ndarray:
    """log10 P(unit | pair of units) of a log-bilinear model fitted to the counts.

    Adam on the noise-contrastive objective with the expectation over `NOISE` noise samples
    per token in place of a draw, so that a second run gives the same model.
    """
    rng = np.random.default_rng(seed)
    width, f32 = UNITS + 1, np.float32
    seen = follows.sum(axis=0)
    noise = (seen + 0.5) / (seen.sum() + 0.5 * UNITS)
    contexts = np.flatnonzero(follows.sum(axis=1))
    data = follows[contexts].astype(f32)
    data /= max(data.sum(), 1)
    of_context = data.sum(axis=1, keepdims=True)
    two, one = contexts // width, contexts % width
    read = rng.normal(0, 0.1, (width, VECTOR)).astype(f32)
    near, far = np.eye(VECTOR, dtype=f32), np.eye(VECTOR, dtype=f32) * f32(0.5)
    said = rng.normal(0, 0.1, (UNITS, VECTOR)).astype(f32)
    bias = np.log(noise).astype(f32)
    parameters = [read, near, far, said, bias]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in parameters]
    apart = np.log(NOISE * noise).astype(f32)
    for step in range(1, steps + 1 if len(contexts) else 1):
        r1, r2 = read[one], read[two]
        state = r1 @ near + r2 @ far
        true = 1 / (1 + np.exp(apart - state @ said.T - bias))
        pull = data * (1 - true) - of_context * (NOISE * noise).astype(f32) * true
        d_state = pull @ said
        d_read = np.zeros_like(read)
        np.add.at(d_read, one, d_state @ near.T)
        np.add.at(d_read, two, d_state @ far.T)
        rate = 0.03 * 0.5 * (1 + np.cos(np.pi * step / steps))
        for p, g, (m, v) in zip(parameters, [d_read, r1.T @ d_state, r2.T @ d_state, pull.T @ state, pull.sum(0)], moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)).astype(f32)
    pairs = np.arange(width * width)
    state = read[pairs % width] @ near + read[pairs // width] @ far
    scores = (state @ said.T + bias).astype(np.float64)
    scores -= scores.max(axis=1, keepdims=True)
    scores -= np.log(np.exp(scores).sum(axis=1, keepdims=True))
    return (scores / np.log(10)).astype(f32)


_LOCAL = {"ids": np.int64, "none": np.uint8, "held": np.uint8, "tokens": np.int64, "known": np.int64, "base": np.float64, "score": np.float64, "spelled": np.float64}
_TAIL = "bucket int, kind int, chunk long, hash binary, number binary, text binary, letters binary, " + ", ".join(f"{n} binary" for n in _LOCAL)


def _score_frequent(shared, buckets: int):
    """Per run of texts: what frequent words add, and the rare words by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        names = [f.split()[0] for f in _TAIL.split(", ")]
        base_of = np.append(model.counts.base(model.counts.counts), 0.0)
        inside_of = np.append(model.inside, 0.0)
        unit_of = np.append(model.units, UNITS - 1)
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for low, high, data, offsets in words.steps(batch.column(2)) if batch.num_rows else ():
                tokens, first, found, end = _tokens(data, offsets)
                value, at, inverse = _looked_up(tokens, model)
                # an end that no training text has counts as the empty word
                likely = np.full(len(value), model.spelling[-1])
                likely[inverse[~end]] = spelled(found, model.spelling)
                unit = unit_of[at][inverse]
                context, _ = _codes(unit, first)
                score = model.table[context, unit].astype(np.float64) + inside_of[at][inverse]
                frequent = (at >= 0)[inverse]
                row = np.repeat(np.arange(high - low), np.diff(first))
                per_row = lambda v: np.bincount(row, weights=v, minlength=high - low)  # noqa: E731, B023
                ids = batch.column(0).slice(low, high - low)
                local = {
                    "ids": np.asarray(ids.fill_null(0)), "none": np.asarray(ids.is_null()),
                    "held": np.asarray(batch.column(1).slice(low, high - low)), "tokens": np.diff(first),
                    "known": per_row(frequent), "base": per_row(base_of[at][inverse]), "score": per_row(score),
                    "spelled": np.zeros(high - low),
                }
                rare = np.flatnonzero(~frequent)
                # a word of a text goes once, with how often it stands there
                pair, number = np.unique(row[rare] * len(value) + inverse[rare], return_counts=True)
                text, which, likely = pair // len(value), value[pair % len(value)], likely[pair % len(value)]
                cut = dealt(
                    (which % np.uint64(buckets)).astype(np.int64),
                    {"hash": which, "number": number.astype(np.uint32), "text": text.astype(np.uint16), "letters": likely.astype(np.float32)},
                )
                n = len(cut["bucket"])
                columns = {"bucket": [*cut["bucket"], chunk % buckets], "kind": [1] * n + [2], "chunk": [chunk] * (n + 1)}
                columns |= {c: [*cut[c], None] for c in ("hash", "number", "text", "letters")}
                columns |= {c: [None] * n + [local[c].astype(kind).tobytes()] for c, kind in _LOCAL.items()}
                kinds = {"bucket": pa.int32(), "kind": pa.int32(), "chunk": pa.int64()}
                yield pa.RecordBatch.from_arrays([pa.array(columns[c], kinds.get(c, pa.binary())) for c in names], names=names)
                chunk += 1

    return run


_SUMS = "chunk long, text binary, " + ", ".join(f"{n} binary" for n in _LOCAL)


def _score_rare(shared):
    """Rows sorted by (bucket, kind): a bucket's counts, then rare words and texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counts = shared.value.counts
        names = [f.split()[0] for f in _SUMS.split(", ")]
        bucket, hashes, numbers = None, np.empty(0, np.uint64), np.empty(0, np.int64)
        for batch in batches:
            out: dict[str, list] = {n: [] for n in names}
            for r in batch.to_pylist():
                if r["bucket"] != bucket:
                    bucket, hashes, numbers = r["bucket"], np.empty(0, np.uint64), np.empty(0, np.int64)
                if r["kind"] == 0:
                    hashes, numbers = np.frombuffer(r["hash"], np.uint64), np.frombuffer(r["number"], np.int64)
                    continue
                new = {n: r[n] for n in names}
                if r["kind"] == 1:
                    value, times = np.frombuffer(r["hash"], np.uint64), np.frombuffer(r["number"], np.uint32)
                    found = np.zeros(len(value), dtype=np.int64)
                    if len(hashes):
                        at = np.minimum(np.searchsorted(hashes, value), len(hashes) - 1)
                        found = np.where(hashes[at] == value, numbers[at], 0)
                    text, at = np.unique(np.frombuffer(r["text"], np.uint16), return_inverse=True)
                    letters = np.where(found > 0, 0, np.frombuffer(r["letters"], np.float32))
                    for name, each in (("known", found > 0), ("base", counts.base(found)), ("score", counts.inside_rare(found)), ("spelled", letters)):
                        new[name] = np.bincount(at, weights=each * times).astype(_LOCAL[name]).tobytes()
                    new["text"] = text.tobytes()
                for n in names:
                    out[n].append(new[n])
            yield pa.RecordBatch.from_arrays([pa.array(out[n], pa.int64() if n == "chunk" else pa.binary()) for n in names], names=names)

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of each text of a run; rows are sorted by run, its texts first."""
    chunk, held = None, {}

    def done() -> pa.RecordBatch:
        held["text_score"] = held["score"] + held["spelled"]
        ids = pa.array(held["ids"], mask=held["none"].astype(bool))
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(held["held"].astype(bool)), *[pa.array(held[n]) for n in ("tokens", "known", "base", "score", "text_score")]],
            names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "text_score"],
        )

    for batch in batches:
        for r in batch.to_pylist():
            if r["chunk"] != chunk:
                if chunk is not None:
                    yield done()
                chunk = r["chunk"]
                held = {n: np.frombuffer(r[n], kind).copy() for n, kind in _LOCAL.items()}
                continue
            text = np.frombuffer(r["text"], np.uint16)
            for name in ("known", "base", "score", "spelled"):
                held[name][text] += np.frombuffer(r[name], _LOCAL[name])
    if chunk is not None:
        yield done()


def score_documents(docs: DataFrame, learn: Column, column: str = "text") -> DataFrame:
    """`(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, text_score)` per row.

    Learns from the rows where `learn` holds. A NULL or empty text is one end; repeated rows
    count and are scored as often as they stand there. Words are told apart by 64-bit
    hashes. Without any training text every word is unknown, and units and bytes are equally likely.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(column))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))
    table = stage(count_words(docs, learn, buckets, column), "word-counts")
    counts = totals(table)
    model = Model(counts, *units_of(counts), np.zeros((1, 1)), np.zeros(1))
    follows, letters = count_units(docs, learn, spark.sparkContext.broadcast(model), column)
    model.table, model.spelling = train(follows), spelling_of(letters)
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (~F.coalesce(learn, F.lit(False))).alias("held"),
        F.coalesce(F.col(column).cast("binary"), F.lit(b"")).alias("text"),
    )
    sent = rows.mapInArrow(_score_frequent(shared, buckets), _TAIL)
    held = table.select("bucket", F.lit(0).alias("kind"), "hash", "number")
    met = sent.unionByName(held, allowMissingColumns=True).repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind")
    sums = met.mapInArrow(_score_rare(shared), _SUMS)
    runs = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    added = sums.repartition(runs, "chunk").sortWithinPartitions("chunk", F.col("ids").isNull()).mapInArrow(
        _added, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, text_score double"
    )
    return added.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(counts.tokens).cast("long").alias("train_tokens"), "base_score", "score", "text_score"
    )


def op2_lm_score(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10
    return score_documents(docs, F.coalesce(remainder != 0, F.lit(False)))
