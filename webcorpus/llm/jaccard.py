"""N-gram Jaccard join of documents, exact, and the groups its links make.

A document is its set of distinct 5-word shingles, as 64-bit hashes. Equal sets are one node.
Two sets that are 75 % alike share one of the first quarter of their shingles in any fixed
order, so these make the tiles: sets meet where such a shingle is the same, and only
those of the same or the next band of sizes are compared. A bitmap of hashed shingles, at least two
bits each, bounds the overlap of a pair from above by the bits that differ; what passes
is settled by intersecting sorted arrays.

The order puts shingles last that are frequent in a sample; it decides how much work there
is, never the result. In tiles of more than a few sets not all pairs are made: sets are
linked to leaders first, and only sets of different groups are then compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webcorpus.llm import words
from webcorpus.llm.batches import by_bucket, dealt, map_texts
from webcorpus.llm.components import components
from webcorpus.plans.storage import stage

SHINGLE = 5
#: Percent of the union that two linked sets share.
PERCENT = 75
#: Sets of a tile that are paired at once; more are linked to leaders first.
SMALL_TILE = 4
#: Sets of a tile from which on it is compared as part of a family.
HEAVY = 64
#: Sets of a block in which bitmaps are compared.
BLOCK = 1024
#: One text in so many is looked at for frequent shingles, which at least `OFTEN` of them
#: have; so many shingles at most go last in the order.
SAMPLED, OFTEN, FREQUENT = 16, 3, 500_000
#: Bytes of text per bucket of tiles.
BUCKET_BYTES = 8 << 20
_SIZE_TOP = 65_535
#: Rows of (set, document) that are broadcast to fetch texts; more are joined by shuffle.
BROADCAST_ROWS = 500_000
_LAST = (1 << 63) - 1


def _row_key(column: str) -> list[F.Column]:
    return [
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"),
        F.xxhash64(F.coalesce(F.col(column), F.lit(""))).alias("tag"),
    ]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, and their row."""
    found = words.split(words.LOWER[data], offsets)
    hashes, row = found.hashes(), found.rows()
    grams = words.run_hashes(hashes, size)
    at = np.flatnonzero(row[: len(grams)] == row[size - 1 :]) if len(grams) else np.empty(0, np.int64)
    values, rows = [grams[at]], [row[at]]
    count = np.diff(found.first)
    for few in range(1, size):  # fewer words than a shingle: all of them are one
        short = np.flatnonzero(count == few)
        if len(short):
            values.append(words.run_hashes(hashes, few)[found.first[short]])
            rows.append(short)
    value, row = np.concatenate(values), np.concatenate(rows)
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    new = np.ones(len(value), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    return value[new], row[new]


def set_names(value: np.ndarray, row: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit name of each set, equal for equal sets."""
    sums = np.zeros(len(sizes), dtype=np.uint64)
    used = np.flatnonzero(sizes)
    if len(used):
        first = np.searchsorted(row, used)
        sums[used] = np.add.reduceat(words.mixed(value), first)
    return words.mixed(sums + sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def bitmaps(value: np.ndarray, row: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Per set the parity of the shingles that hash to each bit; a power of two of bits, at
    least 64 and twice the size. A bitmap folds to a smaller one by xor of its halves."""
    width = np.left_shift(64, np.maximum(0, np.ceil(np.log2(np.maximum(sizes, 1) / 32)).astype(np.int64)))
    start = np.concatenate([[0], np.cumsum(width)])
    bit = (value & (width[row] - 1).astype(np.uint64)).astype(np.int64) + start[row]
    parity = (np.bincount(bit, minlength=int(start[-1])) & 1).astype(np.uint8)
    packed = np.packbits(parity, bitorder="little").tobytes()
    return [packed[a // 8 : b // 8] for a, b in zip(start[:-1].tolist(), start[1:].tolist(), strict=True)]


def overlap_bound(a: bytes, b: bytes, size_a: int, size_b: int) -> int:
    """No pair of sets with these bitmaps and sizes shares more shingles than this."""
    x, y, bits_x, bits_y = int.from_bytes(a, "little"), int.from_bytes(b, "little"), len(a) * 8, len(b) * 8
    while bits_x > bits_y:
        bits_x //= 2
        x = (x >> bits_x) ^ (x & ((1 << bits_x) - 1))
    while bits_y > bits_x:
        bits_y //= 2
        y = (y >> bits_y) ^ (y & ((1 << bits_y) - 1))
    return (size_a + size_b - (x ^ y).bit_count()) // 2


def linked(shared: int, size_a: int, size_b: int) -> bool:
    return 100 * shared >= PERCENT * (size_a + size_b - shared)


def frequent_shingles(docs: DataFrame, column: str = "text") -> np.ndarray:
    """At most `FREQUENT` shingles that many texts of a sample have, sorted."""
    sample = docs.where(F.pmod(F.xxhash64(column), F.lit(SAMPLED)) == 0)

    def run(batch: pa.RecordBatch, texts: pa.Array) -> Iterator[pa.RecordBatch]:
        for _, _, data, offsets in words.steps(texts):
            value, count = np.unique(shingle_sets(data, offsets)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(count)], names=["shingle", "n"])

    counted = map_texts(sample, [F.lit(0).alias("__")], run, "shingle long, n long", column)
    often = counted.groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN)
    top = often.orderBy(F.desc("n"), "shingle").limit(FREQUENT).select("shingle").toArrow()
    return np.sort(top.column(0).to_numpy().astype(np.int64).view(np.uint64))


_ENTRY = {"key": np.uint64, "node": np.int64, "size": np.uint16}
_SKETCH = pa.struct([("doc", pa.int64()), ("tag", pa.int64()), ("node", pa.int64()), ("size", pa.int32()), ("bitmap", pa.binary())])
_TILE = pa.struct([("key", pa.int64()), ("node", pa.int64()), ("size", pa.int32())])
_SENT = (
    "bucket int, key binary, node binary, size binary, "
    "sketches array<struct<doc:bigint,tag:bigint,node:bigint,size:int,bitmap:binary>>, frequent array<struct<key:bigint,node:bigint,size:int>>"
)


def _send(buckets: int, shared):
    def run(batch: pa.RecordBatch, texts: pa.Array) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for low, high, data, offsets in words.steps(texts):
            value, row = shingle_sets(data, offsets)
            sizes = np.bincount(row, minlength=high - low)
            names = set_names(value, row, sizes)
            maps = bitmaps(value, row, sizes)
            keys = [batch.column(i).slice(low, high - low) for i in (0, 1)]
            sketches = pa.StructArray.from_arrays(
                [*keys, pa.array(names), pa.array(sizes, pa.int32()), pa.array(maps, pa.binary())], fields=list(_SKETCH)
            )
            # equal sets of this run of texts send their entries once
            once = np.zeros(len(sizes), dtype=bool)
            once[np.unique(names, return_index=True)[1]] = True
            late = np.zeros(len(value), dtype=bool)
            if len(often):
                late = often[np.minimum(np.searchsorted(often, value), len(often) - 1)] == value
            order = np.argsort(row * 2 + late, kind="stable")
            value, row, late = value[order], row[order], late[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            kept = (place < sizes[row] // 4 + 1) & once[row]
            value, row, late = value[kept], row[kept], late[kept]
            early = ~late
            columns = {"key": value[early], "node": names[row[early]], "size": np.minimum(sizes[row[early]], _SIZE_TOP)}
            cut = dealt((value[early] % np.uint64(buckets)).astype(np.int64), {n: v.astype(_ENTRY[n]) for n, v in columns.items()})
            often_rows = pa.StructArray.from_arrays(
                [pa.array(value[late].view(np.int64)), pa.array(names[row[late]]), pa.array(np.minimum(sizes[row[late]], _SIZE_TOP), pa.int32())],
                fields=list(_TILE),
            )
            n = len(cut["bucket"])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([*cut["bucket"], None], pa.int32()),
                    *[pa.array([*cut[c], None], pa.binary()) for c in _ENTRY],
                    pa.ListArray.from_arrays(pa.array([0] * (n + 1) + [len(sketches)], pa.int32()), sketches),
                    pa.ListArray.from_arrays(pa.array([0] * (n + 1) + [len(often_rows)], pa.int32()), often_rows),
                ],
                names=["bucket", "key", "node", "size", "sketches", "frequent"],
            )

    return run


def _alike_sizes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether two sizes allow a link; a size at the top of its range allows any."""
    small, large = np.minimum(a, b).astype(np.int64), np.maximum(a, b).astype(np.int64)
    return (100 * small >= PERCENT * large) | (large == _SIZE_TOP)


def _tiles(columns: dict) -> pa.RecordBatch:
    """Pairs of small tiles and the rows of larger ones, of the tiles in a bucket."""
    order = np.lexsort((columns["node"], columns["key"]))
    key, node, size = (columns[n][order] for n in _ENTRY)
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
    key, node, size = key[new], node[new], size[new]
    start = np.ones(len(key), dtype=bool)
    start[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(start)
    count = np.repeat(np.diff(np.append(at, len(key))), np.diff(np.append(at, len(key))))
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    small = np.flatnonzero((count > 1) & (count <= SMALL_TILE))
    for gap in range(1, SMALL_TILE):
        left = small[small + gap < len(key)]
        left = left[key[left + gap] == key[left]]
        left = left[_alike_sizes(size[left], size[left + gap])]
        a.append(node[left])
        b.append(node[left + gap])
    pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=0)
    large = np.flatnonzero(count > SMALL_TILE)
    n, m = len(pairs), len(large)
    none = np.zeros(n + m, dtype=bool)
    none[n:] = True
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([np.zeros(n, np.int64), key[large].view(np.int64)]), mask=~none),
            pa.array(np.concatenate([pairs[:, 0], node[large]])),
            pa.array(np.concatenate([pairs[:, 1], np.zeros(m, np.int64)]), mask=none),
            pa.array(np.concatenate([np.zeros(n, np.int32), size[large].astype(np.int32)]), mask=~none),
        ],
        names=["key", "a", "b", "size"],
    )


def _sizes_allow(x: str, y: str) -> F.Column:
    small, large = F.least(x, y), F.greatest(x, y)
    return (small * 100 >= large * PERCENT) | (large == _SIZE_TOP)


def _pair(x: str, y: str) -> list[F.Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _leader_pairs(tiles: DataFrame) -> DataFrame:
    """Every set of a tile with two sets that lead it: the first by either of two hashes."""
    first = [
        F.min(F.struct(F.xxhash64("node", F.lit(k)).alias("h"), "node", "size")).alias(f"first{k}") for k in (1, 2)
    ]
    leaders = stage(tiles.groupBy("key", "band").agg(*first), "tile-leaders")
    each = leaders.select("key", F.explode(F.array("band", F.col("band") + 1)).alias("band"), "first1", "first2")
    met = tiles.join(each, ["key", "band"]).select(
        "node", "size", F.explode(F.array("first1", "first2")).alias("lead")
    )
    met = met.select("node", "size", F.col("lead.node").alias("lead"), F.col("lead.size").alias("lead_size"))
    return met.where((F.col("node") != F.col("lead")) & _sizes_allow("size", "lead_size")).select(*_pair("node", "lead"))


def _open_pairs(tiles: DataFrame, groups: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs of sets in different groups that meet in a tile and pass the bitmap bound.

    A tile of fewer than `HEAVY` sets makes its pairs, at most so many for each of its rows.
    Sets that share many shingles meet in many heavy tiles: heavy tiles that hang together
    are one family, and each pair of a family is compared once, block by block.
    """
    rows = tiles.join(groups.withColumnRenamed("root", "group"), "node", "left")
    rows = stage(rows.withColumn("group", F.coalesce("group", "node")), "tile-groups")
    several = rows.groupBy("key").agg(
        F.min("group").alias("g0"), F.max("group").alias("g1"), F.min("node").alias("head"), F.count(F.lit(1)).alias("n")
    )
    several = stage(several.where("g0 <> g1").select("key", "head", (F.col("n") >= HEAVY).alias("heavy")), "tile-heads")
    rows = stage(rows.join(several, "key"), "tiles-open")
    light = rows.where("NOT heavy").select("key", "node", "size", "group")
    other = light.select("key", *[F.col(c).alias(f"y_{c}") for c in ("node", "size", "group")])
    met = light.join(other, "key").where(
        (F.col("node") < F.col("y_node")) & (F.col("group") != F.col("y_group")) & _sizes_allow("size", "y_size")
    )
    few = _bounded(met.select(F.col("node").alias("a"), F.col("y_node").alias("b")).distinct(), nodes)
    return few.union(_family_pairs(rows.where("heavy").select("node", "group", "head").distinct(), nodes))


def _family_pairs(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs of different groups inside families `(node, group, head)` of sets that share a
    head: bands of set sizes are cut into blocks, and a block meets its own band and the
    next one."""
    rows = stage(rows, "family-heads")
    families = components(rows.select(F.col("node").alias("a"), F.col("head").alias("b"))).select(
        "node", F.col("root").alias("family")
    )
    members = rows.select("node", "group").distinct().join(families, "node").join(nodes, "node")
    band = F.floor(F.log(F.col("size").cast("double")) / F.log(F.lit(100 / PERCENT))).cast("int")
    members = stage(members.select("family", "group", "node", "size", "bitmap", band.alias("band")), "family-members")
    blocks = members.groupBy("family", "band").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    blocks = stage(blocks, "family-blocks")
    next_blocks = blocks.select("family", (F.col("band") - 1).alias("band"), F.col("blocks").alias("above"))
    last_blocks = blocks.select("family", (F.col("band") + 1).alias("band"), F.col("blocks").alias("below"))
    sized = blocks.join(next_blocks, ["family", "band"], "left").join(last_blocks, ["family", "band"], "left")
    dealt_rows = members.join(sized, ["family", "band"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))

    def met(lower: Column, mine: str, theirs: Column, is_left: Column) -> Column:
        """Units of work: (band, block of it, block of the same or the next band, which)."""
        return F.transform(
            theirs,
            lambda j: F.struct(
                lower.alias("band"), F.when(is_left, F.col(mine)).otherwise(j).alias("i"),
                F.when(is_left, j).otherwise(F.col(mine)).alias("j"),
            ),
        )

    to = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    yes, no = F.lit(True), F.lit(False)
    none = F.lit(0)
    own = F.col("band")
    # inside a band a pair of blocks is met once, i <= j
    same_left = F.filter(to(F.col("blocks")), lambda j: j >= F.col("block"))
    same_right = F.filter(to(F.col("blocks")), lambda j: j < F.col("block"))
    units = F.concat(
        F.transform(met(own, "block", same_left, yes), lambda u: F.struct(u.alias("u"), none.alias("step"), F.lit(0).alias("side"))),
        F.transform(met(own, "block", same_right, no), lambda u: F.struct(u.alias("u"), none.alias("step"), F.lit(1).alias("side"))),
        F.transform(met(own, "block", to(F.coalesce("above", none)), yes), lambda u: F.struct(u.alias("u"), F.lit(1).alias("step"), F.lit(0).alias("side"))),
        F.transform(met(own - 1, "block", to(F.coalesce("below", none)), no), lambda u: F.struct(u.alias("u"), F.lit(1).alias("step"), F.lit(1).alias("side"))),
    )
    each = dealt_rows.select("family", "group", "node", "size", "bitmap", F.explode(units).alias("m"))
    each = each.select(
        F.xxhash64("family", "m.u.band", "m.u.i", "m.u.j", "m.step").alias("unit"),
        (F.col("m.u.i") == F.col("m.u.j")).alias("alike"), F.col("m.step").alias("step"), F.col("m.side").alias("side"),
        "group", "node", "size", "bitmap",
    )
    return each.repartition("unit").sortWithinPartitions("unit").mapInArrow(_compare_units, "a long, b long")


def _folded(bitmaps: list[bytes], size: int) -> np.ndarray:
    """Bitmaps as rows of 64-bit words, folded to `size` bytes."""
    out = np.empty((len(bitmaps), size // 8), dtype=np.uint64)
    for i, b in enumerate(bitmaps):
        whole = np.frombuffer(b, dtype=np.uint64)
        out[i] = np.bitwise_xor.reduce(whole.reshape(-1, size // 8), axis=0)
    return out


def _compare_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by unit; a unit is two blocks, or one block with itself."""
    unit, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["unit"] != unit and held:
                yield _compared(held)
                held = []
            unit = row["unit"]
            held.append(row)
    if held:
        yield _compared(held)


def _compared(rows: list[dict]) -> pa.RecordBatch:
    inside = rows[0]["alike"] and rows[0]["step"] == 0
    left = [r for r in rows if r["side"] == 0]
    right = left if inside else [r for r in rows if r["side"] == 1]
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    if left and right:
        width = min(len(r["bitmap"]) for r in rows)
        x, y = _folded([r["bitmap"] for r in left], width), _folded([r["bitmap"] for r in right], width)
        column = lambda side, n: np.array([r[n] for r in side], dtype=np.int64)
        y_size, y_group, y_node = (column(right, n) for n in ("size", "group", "node"))
        for i, r in enumerate(left):
            apart = np.bitwise_count(x[i] ^ y).sum(axis=1).astype(np.int64)
            both = r["size"] + y_size
            bound = (both - apart) // 2
            good = (100 * bound >= PERCENT * (both - bound)) & (y_group != r["group"])
            if inside:
                good[: i + 1] = False
            found = y_node[good]
            a.append(np.minimum(found, r["node"]))
            b.append(np.maximum(found, r["node"]))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])


def _within_bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = []
        for r in batch.to_pylist():
            bound = overlap_bound(r["a_map"], r["b_map"], r["a_size"], r["b_size"])
            kept.append(linked(bound, r["a_size"], r["b_size"]))
        yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))


def _sets_of(texts: pa.Array) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for low, high, data, offsets in words.steps(texts):
        value, row = shingle_sets(data, offsets)
        edge = np.searchsorted(row, np.arange(high - low + 1))
        out += [value[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]
    return out


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = _sets_of(batch.column(2)), _sets_of(batch.column(3))
        kept = [
            linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)) for x, y in zip(left, right, strict=True)
        ]
        yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))


def _bounded(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs whose bitmaps allow a link."""
    for side in ("a", "b"):
        own = nodes.select(F.col("node").alias(side), F.col("size").alias(f"{side}_size"), F.col("bitmap").alias(f"{side}_map"))
        pairs = pairs.join(own, side)
    return pairs.select("a", "b", "a_size", "b_size", "a_map", "b_map").mapInArrow(_within_bound, "a long, b long")


def _links(bounded: DataFrame, nodes: DataFrame, docs: DataFrame, column: str) -> DataFrame:
    """The candidate pairs `(a, b)` that are linked."""
    bounded = stage(bounded, "pairs-bounded")
    needed = bounded.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes, "node")
    needed = stage(needed.select("node", "first.*"), "pair-nodes")
    if needed.count() <= BROADCAST_ROWS:
        needed = F.broadcast(needed)
    rows = docs.select(*_row_key(column), F.col(column).alias("text"))
    met = rows.join(needed, ["doc", "tag"])
    texts = stage(met.groupBy("node").agg(F.first("text").cast("binary").alias("text")), "pair-texts")
    for side in ("a", "b"):
        bounded = bounded.join(texts.select(F.col("node").alias(side), F.col("text").alias(f"{side}_text")), side)
    exact = bounded.select("a", "b", "a_text", "b_text").mapInArrow(_settled, "a long, b long")
    return stage(exact, "jaccard-links")


def groups(docs: DataFrame, column: str = "text") -> DataFrame:
    """`(doc, tag, n_shingles, first)` per row: its set size and the first row of its group.

    `doc` is the id, the largest long for NULL, `tag` a hash of the text; `first` is the
    smallest (doc, tag) reachable by links. Equal sets are linked; a text without words
    has no shingles, is linked with nothing and is its own group. Rows that share an id but
    not the text are told apart by the tag; repeated rows are equal sets.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(column))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))
    shared = spark.sparkContext.broadcast(frequent_shingles(docs, column))
    sent = stage(map_texts(docs, _row_key(column), _send(buckets, shared), _SENT, column), "jaccard-sketches")
    sketches = sent.select(F.explode("sketches").alias("s")).select("s.*")
    nodes = stage(
        sketches.where("size > 0").groupBy("node").agg(
            F.min(F.struct("doc", "tag")).alias("first"), F.first("size").alias("size"), F.first("bitmap").alias("bitmap")
        ),
        "jaccard-sets",
    )
    met = (
        sent.where("bucket IS NOT NULL").select("bucket", *_ENTRY)
        .repartition(buckets, "bucket").sortWithinPartitions("bucket")
        .mapInArrow(lambda batches: by_bucket(batches, _ENTRY, _tiles), "key long, a long, b long, size int")
    )
    met = stage(met, "jaccard-tiles")
    band = F.floor(F.log(F.col("size").cast("double")) / F.log(F.lit(100 / PERCENT)))
    # a size at the top of its range stands for all above and has every band from there on
    frequent = sent.select(F.explode("frequent").alias("t")).select("t.*").distinct()
    tiles = met.where("key IS NOT NULL").select("key", F.col("a").alias("node"), "size").union(frequent)
    tiles = stage(tiles.withColumn("band", band.cast("int")), "jaccard-large-tiles")
    first = stage(
        met.where("key IS NULL").select("a", "b").union(_leader_pairs(tiles)).distinct(), "pairs-first"
    )
    links = _links(_bounded(first, nodes), nodes, docs, column)
    later = _open_pairs(tiles, stage(components(links), "groups-first"), nodes)
    links = links.union(_links(later, nodes, docs, column))
    roots = stage(
        nodes.select("node", F.col("first").alias("own")).join(components(links), "node", "left")
        .withColumn("root", F.coalesce("root", "node")),
        "jaccard-roots",
    )
    firsts = stage(roots.groupBy("root").agg(F.min("own").alias("first")), "jaccard-firsts")
    named = stage(roots.join(firsts, "root").select("node", "first"), "jaccard-groups")
    own = F.struct("doc", "tag")
    return sketches.select("doc", "tag", "size", F.when(F.col("size") > 0, F.col("node")).alias("node")).join(
        named, "node", "left"
    ).select("doc", "tag", F.col("size").cast("long").alias("n_shingles"), F.coalesce("first", own).alias("first"))


def one_of_each(docs: DataFrame, column: str = "text") -> DataFrame:
    """The rows of `docs` that are the first of their group; of repeated rows one stays.
    Texts without words all stay."""
    found = groups(docs, column)
    kept = found.where((F.col("n_shingles") == 0) | (F.struct("doc", "tag") == F.col("first")))
    kept = kept.select("doc", "tag", (F.col("n_shingles") == 0).alias("wordless")).distinct()
    keyed = docs.select(F.struct("*").alias("row"), *_row_key(column)).join(kept, ["doc", "tag"])
    once = F.row_number().over(Window.partitionBy("doc", "tag").orderBy(F.lit(0)))
    return keyed.withColumn("once", once).where("wordless OR once = 1").select("row.*")


def op3_jaccard_join(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    missing = lambda c: F.when(F.col(c) != _LAST, F.col(c))
    return groups(docs).select(missing("doc").alias("doc_id"), "n_shingles", missing("first.doc").alias("component_id"))
