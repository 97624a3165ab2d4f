"""Benchmark decontamination with an FM-index per shard of training texts.

A task indexes its texts shard by shard: a suffix array over words by prefix doubling, the
Burrows-Wheeler transform in a wavelet matrix for rank queries, and suffix positions
sampled at every eighth word. All test phrases are searched backwards at once, their
occurrences located from the samples, and the spans of a text merged. No text is shuffled.

The alphabet of the index are the words of the benchmark. All other words end a string of
the index, as do the ends of texts, and strings shorter than the shortest phrase, which can
hold none, are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webcorpus.llm import words
from webcorpus.llm.batches import text_bytes
from webcorpus.plans.storage import stage

WINDOW = 10
#: Bytes of text in a shard (or one text), and index symbols built at once (or one string).
SHARD_BYTES, SHARD_SYMBOLS = 3 << 20, 1 << 19
#: Bytes of benchmark texts searched for in one pass over the documents.
PASS_BYTES = 16 << 20
_SAMPLE = 8


class FmIndex:
    """Index of strings over symbols 1..top; 0 ends each string."""

    def __init__(self, text: np.ndarray, top: int):
        self.bits = max(1, int(top).bit_length())
        self.size = len(text)
        order = suffix_order(text, self.bits)
        before = text[order - 1]
        before[order == 0] = 0
        counts = np.bincount(text, minlength=top + 1)
        self.less = np.concatenate([[0], np.cumsum(counts)])
        starts = np.zeros(len(text), dtype=bool)
        starts[0] = True
        starts[1:] = text[:-1] == 0
        # walks towards the front end at the latest where a string starts
        self.sampled = (starts | (np.arange(len(text)) % _SAMPLE == 0))[order]
        self.samples = np.where(self.sampled, order, 0)
        self._build(before)
        self.node = np.zeros(top + 1, dtype=np.int64)
        self.node = self._follow(np.arange(top + 1), np.zeros(top + 1, dtype=np.int64))

    def _build(self, column: np.ndarray) -> None:
        self.levels, self.ones, self.zeros = [], [], []
        for level in range(self.bits - 1, -1, -1):
            bit = (column >> level & 1).astype(bool)
            ones = np.zeros(len(bit) + 1, dtype=np.int32)
            np.cumsum(bit, out=ones[1:])
            self.levels.append(bit)
            self.ones.append(ones)
            self.zeros.append(len(bit) - int(ones[-1]))
            column = np.concatenate([column[~bit], column[bit]])

    def _follow(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        for level, ones, zeros in zip(range(self.bits - 1, -1, -1), self.ones, self.zeros, strict=True):
            bit = (symbols >> level & 1).astype(bool)
            one = ones[places].astype(np.int64)
            places = np.where(bit, zeros + one, places - one)
        return places

    def rank(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """How often each symbol precedes the first `places` suffixes."""
        return self._follow(symbols, places) - self.node[symbols]

    def before(self, places: np.ndarray) -> np.ndarray:
        """The symbol in front of each suffix."""
        symbols = np.zeros(len(places), dtype=np.int64)
        for bits, ones, zeros in zip(self.levels, self.ones, self.zeros, strict=True):
            bit, one = bits[places], ones[places].astype(np.int64)
            symbols = symbols * 2 + bit
            places = np.where(bit, zeros + one, places - one)
        return symbols

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of right-aligned phrases (0 in front of short ones): first and last suffix."""
        low = np.zeros(len(phrases), dtype=np.int64)
        high = np.full(len(phrases), self.size, dtype=np.int64)
        for j in range(phrases.shape[1] - 1, -1, -1):
            live = np.flatnonzero((phrases[:, j] > 0) & (low < high))
            symbol = phrases[live, j]
            low[live] = self.less[symbol] + self.rank(symbol, low[live])
            high[live] = self.less[symbol] + self.rank(symbol, high[live])
        return low, high

    def locate(self, places: np.ndarray) -> np.ndarray:
        """Position in the text of each suffix."""
        places, steps = places.copy(), np.zeros(len(places), dtype=np.int64)
        open_ = np.flatnonzero(~self.sampled[places])
        while len(open_):
            symbol = self.before(places[open_])
            places[open_] = self.less[symbol] + self.rank(symbol, places[open_])
            steps[open_] += 1
            open_ = open_[~self.sampled[places[open_]]]
        return self.samples[places] + steps


def suffix_order(text: np.ndarray, bits: int) -> np.ndarray:
    """Suffix array of strings that end in 0. Each 0 is smaller than every symbol and than
    the zeros after it, so no comparison goes past the end of a string."""
    n = len(text)
    depth = max(1, 62 // bits)
    key = np.zeros(n, dtype=np.int64)
    ended = np.zeros(n, dtype=bool)
    for j in range(depth):
        symbol = np.zeros(n, dtype=np.int64)
        symbol[: max(n - j, 0)] = text[j:]
        symbol[ended] = 0
        ended |= symbol == 0
        key = key << bits | symbol
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    # equal keys with an end inside differ by that end, which is the order of positions
    first = np.ones(n, dtype=bool)
    first[1:] = (ranked[1:] != ranked[:-1]) | ended[order[1:]]
    rank = np.empty(n, dtype=np.int64)
    while True:
        group = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        rank[order] = group
        alone = first & np.append(first[1:], True)
        rest = np.flatnonzero(~alone)
        if not len(rest):
            return order
        at = order[rest]
        pair = group[rest] * (n + 1) + rank[np.minimum(at + depth, n - 1)]
        again = np.argsort(pair, kind="stable")
        order[rest] = at[again]
        pair = pair[again]
        first[rest[1:]] = pair[1:] != pair[:-1]
        depth *= 2


@dataclass
class Phrases:
    """The windows of some benchmark items, ready to be searched for."""

    vocabulary: np.ndarray
    symbols: np.ndarray
    rows: np.ndarray
    lengths: np.ndarray
    items: list[list[str]]


def phrases(rows: list[tuple[object, str | None]], window: int = WINDOW) -> Phrases:
    """Distinct windows of `window` words and the items that have them.

    An item with fewer words is one window; one without words has none. An item without id
    hits words, but is in no list of items.
    """
    raw = [(t or "").encode() for _, t in rows]
    data = words.LOWER[np.frombuffer(b"".join(raw), dtype=np.uint8)]
    found = words.split(data, np.cumsum([0, *map(len, raw)]), words.ALPHANUMERIC)
    hashes = found.hashes()
    vocabulary = np.unique(hashes)
    ids = (np.searchsorted(vocabulary, hashes) + 1).tolist()
    windows: dict[tuple[int, ...], set[str]] = {}
    for (item, _), low, high in zip(rows, found.first[:-1].tolist(), found.first[1:].tolist(), strict=True):
        for at in range(low, max(high - window, low) + 1 if high > low else low):
            held = windows.setdefault(tuple(ids[at : min(at + window, high)]), set())
            if item is not None:
                held.add(str(item))
    lengths = np.array([len(w) for w in windows], dtype=np.int64)
    table = np.zeros((len(windows), window), dtype=np.int64)
    for i, w in enumerate(windows):
        table[i, window - len(w) :] = w
    return Phrases(vocabulary, np.arange(1, len(vocabulary) + 1), table, lengths, [sorted(i) for i in windows.values()])


def _occurrences(found: words.Words, sought: Phrases) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(first word, phrase) of every occurrence in a shard, index by index."""
    if not len(sought.rows) or not len(found.starts):
        return
    hashes = found.hashes()
    at = np.minimum(np.searchsorted(sought.vocabulary, hashes), len(sought.vocabulary) - 1)
    known = sought.vocabulary[at] == hashes
    # strings: known words side by side in one text
    begins = known.copy()
    begins[1:] &= ~known[:-1]
    inner = found.first[:-1][found.first[:-1] < len(known)]
    begins[inner] = known[inner]
    begin = np.flatnonzero(begins)
    gaps = np.flatnonzero(~known | begins)
    end = np.append(gaps, len(known))[np.searchsorted(gaps, begin, "right")]
    long = end - begin >= int(sought.lengths.min())
    begin, end = begin[long], end[long]
    total = np.cumsum(end - begin + 1)
    low = 0
    while low < len(begin):
        done = int(total[low - 1]) if low else 0
        high = max(low + 1, int(np.searchsorted(total, done + SHARD_SYMBOLS, "right")))
        sizes = end[low:high] - begin[low:high] + 1
        place = np.repeat(begin[low:high] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        text = np.zeros(len(place), dtype=np.int64)
        inside = np.ones(len(place), dtype=bool)
        inside[np.cumsum(sizes) - 1] = False
        text[inside] = at[place[inside]] + 1
        index = FmIndex(text, len(sought.vocabulary))
        first, last = index.search(sought.rows)
        count = np.maximum(last - first, 0)
        phrase = np.repeat(np.arange(len(count)), count)
        suffix = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        yield place[index.locate(suffix)], phrase
        low = high


def _search_batch(texts: pa.Array, sought: Phrases) -> Iterator[tuple[int, int, list]]:
    """For runs of rows: per row (words, byte spans that are hit, words hit, items)."""
    for low, high, data, offsets in words.steps(texts, SHARD_BYTES):
        found = words.split(words.LOWER[data], offsets, words.ALPHANUMERIC)
        edge = np.zeros(len(found.starts) + 1, dtype=np.int64)
        pairs = []
        for first, phrase in _occurrences(found, sought):
            edge += np.bincount(first, minlength=len(edge))
            edge -= np.bincount(first + sought.lengths[phrase], minlength=len(edge))
            row = np.searchsorted(found.first, first, "right") - 1
            pairs.append(np.unique(np.stack([row, phrase], axis=1), axis=0))
        hit = np.cumsum(edge)[:-1] > 0
        out = [[int(n), [], 0, []] for n in np.diff(found.first)]
        if hit.any():
            items: dict[int, set[str]] = {}
            for row, phrase in np.concatenate(pairs).tolist():
                items.setdefault(row, set()).update(sought.items[phrase])
            for row, names in items.items():
                a, b = int(found.first[row]), int(found.first[row + 1])
                own = np.concatenate([[0], hit[a:b].astype(np.int8), [0]])
                change = np.diff(own)
                begin, end = np.flatnonzero(change == 1) + a, np.flatnonzero(change == -1) + a - 1
                base = int(offsets[row])
                spans = np.stack([found.starts[begin] - base, found.ends[end] - base], axis=1)
                out[row][1:] = [spans.tolist(), int(hit[a:b].sum()), sorted(names)]
        yield low, high, out


_HITS = "struct<n_words:bigint,n_hit:bigint,spans:array<array<bigint>>,items:array<string>>"


def _joined_spans(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return out


def find_passages(
    docs: DataFrame,
    benchmark: DataFrame,
    keep: list[str],
    window: int = WINDOW,
    pass_bytes: int = PASS_BYTES,
    cut: bool = False,
) -> DataFrame:
    """Per row of `docs` `(row, text, n_words, n_hit, spans, items)`.

    `row` has the `keep` columns and `text` the bytes of the text. `spans` are sorted byte
    ranges that occurrences cover, `items` the sorted ids of the items that occur. NULL and
    empty texts have no words; repeated rows stay. The benchmark is searched for in blocks
    of about `pass_bytes` (or one item), one pass over the documents each, so what is
    broadcast has that bound. With `cut` the spans are cut out of `text` in the last pass.
    """
    spark = docs.sparkSession
    items = benchmark.select("item_id", "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // pass_bytes) or 1
    current = docs.select(
        F.struct(F.lit(0).alias("__"), *[F.col(f"`{c}`") for c in keep]).alias("row"),
        text_bytes().alias("text"),
        F.lit(None).cast(_HITS).alias("hits"),
    )
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    schema = current.schema
    for b in range(blocks):
        rows = [(r.item_id, r.text) for r in items.where(block == b).toLocalIterator()]
        shared = spark.sparkContext.broadcast(phrases(rows, window))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, cut=cut and b == blocks - 1) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield from _with_hits(batch, shared.value, cut)

        current = current.mapInArrow(run, schema)
        if blocks > 1:
            current = stage(current, "decontamination-pass")
    return current.select("row", "text", "hits.*")


def _with_hits(batch: pa.RecordBatch, sought: Phrases, cut: bool) -> Iterator[pa.RecordBatch]:
    """Adds what a pass finds to the hits of earlier passes; cuts them out if asked to."""
    for low, high, found in _search_batch(batch.column(1), sought):
        part = batch.slice(low, high - low)
        rows = []
        for i, ((n, spans, hit, names), old) in enumerate(zip(found, part.column(2).to_pylist(), strict=True)):
            if old and old["spans"]:
                spans = _joined_spans(old["spans"] + spans)
                names = sorted({*old["items"], *names})
                hit = _words_inside(part.column(1)[i].as_py(), spans)
            rows.append({"n_words": n, "n_hit": hit, "spans": spans, "items": names})
        hits = pa.array(rows, batch.schema.field(2).type)
        texts = part.column(1)
        if cut and any(r["spans"] for r in rows):
            pairs = zip(texts.to_pylist(), rows, strict=True)
            texts = pa.array([_without_spans(t, r["spans"]) if r["spans"] else t for t, r in pairs], pa.binary())
        yield pa.RecordBatch.from_arrays([part.column(0), texts, hits], schema=batch.schema)


def _without_spans(text: bytes, spans: list[list[int]]) -> bytes:
    ends, starts = [0, *(e for _, e in spans)], [*(s for s, _ in spans), len(text)]
    return b"".join(text[a:b] for a, b in zip(ends, starts, strict=True))


def _words_inside(text: bytes, spans: list[list[int]]) -> int:
    data = np.frombuffer(b" ".join(text[a:b] for a, b in spans), dtype=np.uint8)
    return len(words.split(data, np.array([0, len(data)]), words.ALPHANUMERIC).starts)


def without_passages(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of `docs`, with the hit spans cut out of `text`; other texts are unchanged."""
    others = [c for c in docs.columns if c != "text"]
    found = find_passages(docs, benchmark, others, window, cut=True)
    return found.select(
        *[(F.col("text").cast("string") if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns]
    )


def op4_decontamination(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return find_passages(docs, benchmark, ["doc_id"]).select(
        "row.doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
