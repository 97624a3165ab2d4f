"""Prefix trie of conversations with subtree totals, by depth-band rollup.

The node of a prefix is found without comparing conversations: its key is the exclusive or
of 128-bit hashes of (position, turn), a running total over the turns. Subtree totals go up
in bands of `BAND` depths: a node explodes to its ancestors inside its band and to the root
of the band only. Band roots form a tree of `1 / BAND` of the depth, which is summed in the
same way; the completed totals of band roots then go down to the nodes of the band above.
A tree of depth D takes about 2 * log(D) / log(BAND) rounds, and a node is copied fewer than
2 * BAND times on average, however long the longest conversation is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webcorpus.llm.spaced import words_of
from webcorpus.plans.skew import salted_join
from webcorpus.plans.storage import stage

#: Depths of a band.
BAND = 16
#: Bits of the turns, and of the depths, whose rows are put in order together. Depths of a
#: whole number of bands.
CHUNK_BITS = 12
#: Bits of conversation numbers that are written into one piece of a list.
PIECE_BITS = 8
#: The chunk of turns without a number; below every other.
_NO_TURN = -(1 << 62)
_NOTHING = hashlib.sha256(b"").hexdigest()
_SUMS = ["n_leaves", "saved_tokens"]


def turns_of(rows: DataFrame) -> DataFrame:
    """`(conv_id, chunk, turn, digest, n_words)` of a table `(conv_id, turn, role, text)`.

    Rows without `conv_id` belong to no conversation and are left out. A NULL role or text
    is empty. The digest is SHA-256 of the role's length, the role and the text, so texts go
    no further than this.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    turn = F.col("turn").cast("long")
    return rows.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.coalesce(F.shiftright(turn, CHUNK_BITS), F.lit(_NO_TURN)).alias("chunk"),
        turn.alias("turn"),
        F.unhex(F.sha2(whole, 256)).alias("digest"),
        F.size(words_of(text)).cast("long").alias("n_words"),
    )


def _before(df: DataFrame, aggregate, columns: list[str], by: str, order: str) -> DataFrame:
    """`columns` aggregated over the earlier rows of the same `by`; 0 for the first."""
    earlier = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumns({c: F.coalesce(aggregate(c).over(earlier), F.lit(0)) for c in columns})


def rebuilt(turns: DataFrame, group: int = 20, leads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like a neighbour: `(conv_id, depth, digest, n_words)`, and
    `(conv_id, n_turns)` of every conversation.

    `turns` is what `turns_of` gives, staged. Turns stand in the order (turn, digest), NULL
    first; repeated rows stay. Conversation c takes the first h = crc32(c) % `leads` turns
    of conversation c - c % `group` in place of its own first h; fewer, if that one is
    shorter or absent. Remainders have the sign of c. A conversation may be left without turns.
    """
    lead = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % leads).cast("int")
    counts = stage(turns.groupBy("conv_id", "chunk").agg(F.count(F.lit(1)).alias("n")), "trie-chunks")
    sizes = counts.groupBy("conv_id").agg(F.sum("n").alias("n_own"))
    source = sizes.select(F.col("conv_id").alias("source"), F.col("n_own").alias("n_source"))
    plan = sizes.withColumns({"source": F.col("conv_id") - F.col("conv_id") % group, "h": lead})
    plan = plan.join(source, "source", "left").withColumn(
        "n_lead", F.least(F.col("h").cast("long"), F.coalesce("n_source", F.lit(0)))
    )
    plan = stage(plan.select("conv_id", "source", "h", "n_lead", "n_own"), "trie-plan")
    starts = _before(counts.withColumn("before", F.col("n")), F.sum, ["before"], "conv_id", "chunk")
    starts = starts.join(plan.select("conv_id", "h", "n_lead"), "conv_id")
    order = Window.partitionBy("conv_id", "chunk").orderBy("turn", "digest")
    placed = turns.join(starts, ["conv_id", "chunk"]).withColumn("i", F.col("before") + F.row_number().over(order))
    placed = stage(placed.select("conv_id", "i", "h", "n_lead", "digest", "n_words"), "trie-placed")
    own = placed.where("i > h").select("conv_id", (F.col("i") - F.col("h") + F.col("n_lead")).alias("depth"), "digest", "n_words")
    first = placed.where((F.col("conv_id") % group == 0) & (F.col("i") < leads)).select(
        F.col("conv_id").alias("source"), F.col("i").alias("depth"), "digest", "n_words"
    )
    led = plan.where("n_lead > 0").join(first, "source").where("depth <= n_lead")
    conversations = plan.select("conv_id", (F.col("n_lead") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))).alias("n_turns"))
    return own.unionByName(led.select("conv_id", "depth", "digest", "n_words")), conversations


def _key(a: Column, b: Column) -> Column:
    return F.struct(a.alias("a"), b.alias("b"))


def _root() -> Column:
    """The key of no turns."""
    return _key(F.lit(0).cast("long"), F.lit(0).cast("long"))


def _chain(turns: DataFrame) -> DataFrame:
    """`(conv_id, depth, key, above, root, anc, n_words)` of every turn: the keys of its node,
    of the node above, of its band's root, and of the ancestors between the two."""
    rows = turns.select(
        "conv_id", "depth", F.shiftright(F.col("depth") - 1, CHUNK_BITS).alias("chunk"), "n_words",
        *[F.xxhash64(F.lit(i), "depth", "digest").alias(n) for i, n in ((1, "own_a"), (2, "own_b"))],
    )
    rows = stage(rows, "trie-rows")
    totals = rows.groupBy("conv_id", "chunk").agg(F.bit_xor("own_a").alias("a"), F.bit_xor("own_b").alias("b"))
    carried = _before(totals, F.bit_xor, ["a", "b"], "conv_id", "chunk")
    within = Window.partitionBy("conv_id", "chunk").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(carried, ["conv_id", "chunk"]).withColumns(
        {c: F.col(c).bitwiseXOR(F.bit_xor(f"own_{c}").over(within)) for c in ("a", "b")}
    )
    rows = rows.select(
        "conv_id", "chunk", "depth", "n_words", _key(F.col("a"), F.col("b")).alias("key"),
        _key(F.col("a").bitwiseXOR(F.col("own_a")), F.col("b").bitwiseXOR(F.col("own_b"))).alias("above"),
    )
    return _banded(rows, ["conv_id", "chunk"], BAND)


def _banded(rows: DataFrame, by: list[str], height: int) -> DataFrame:
    """Adds `root` and `anc` inside bands of `height` depths. Bands are open above: a root is
    the node over the band's first row, and the last row may be root of the next band."""
    band = Window.partitionBy(*by, "band").orderBy("depth")
    return rows.withColumn("band", F.floor((F.col("depth") - 1) / height)).withColumns({
        "root": F.first("above").over(band),
        "anc": F.collect_list("key").over(band.rowsBetween(Window.unboundedPreceding, -1)),
    }).drop("band")


def _added(totals: DataFrame, sent: DataFrame) -> DataFrame:
    """Totals `(key, depth, sums)` with what was sent to their keys."""
    both = totals.select("key", "depth", *_SUMS).unionByName(sent, allowMissingColumns=True)
    return both.groupBy("key").agg(F.max("depth").alias("depth"), *[F.sum(c).alias(c) for c in _SUMS])


def _subtree_sums(own: DataFrame, chain: DataFrame, nodes: DataFrame, deepest: int) -> DataFrame:
    """`(key, sums)` over the subtree of every node, its own sums included."""
    levels = [nodes.where("depth > 0").select("key", "depth", "root", "anc")]
    partial: list[DataFrame] = []
    totals, height = own, BAND
    while True:
        level = levels[-1]
        inner = level.where(F.col("depth") % height != 0).drop("depth").join(totals, "key")
        upward = F.explode(F.concat("anc", F.array("root"))).alias("key")
        partial.append(stage(_added(totals, inner.select(upward, *_SUMS)), f"trie-up-{len(levels)}"))
        if deepest < height:
            break
        totals = partial[-1].where(F.col("depth") % height == 0)
        chain = chain.where(F.col("depth") % height == 0).select(
            "conv_id", "depth", "key", F.col("root").alias("above")
        )
        chain = stage(_banded(chain, ["conv_id"], height * BAND), f"trie-level-{len(levels)}")
        found = chain.groupBy("key").agg(F.min(F.struct("conv_id", "depth", "root", "anc")).alias("r"))
        levels.append(stage(found.select("key", "r.depth", "r.root", "r.anc"), f"trie-ancestors-{len(levels)}"))
        height *= BAND
    done = partial[-1]
    for n in reversed(range(len(levels) - 1)):
        height //= BAND
        last = F.col("depth") % height == 0
        given = levels[n].where(last).drop("depth").join(done, "key").select(F.explode("anc").alias("key"), *_SUMS)
        done = done.unionByName(stage(_added(partial[n].where(~last), given), f"trie-down-{n}"))
    return done.select("key", *_SUMS)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the joined pieces of each key; rows come sorted by key and piece."""
    key, digest = None, None
    for batch in batches:
        out = []
        for a, b, piece in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
            if (a, b) != key:
                if key is not None:
                    out.append((*key, digest.hexdigest()))
                key, digest = (a, b), hashlib.sha256(piece.encode())
            else:
                digest.update(b"," + piece.encode())
        yield _digest_rows(out)
    if key is not None:
        yield _digest_rows([(*key, digest.hexdigest())])


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("a", pa.int64()), ("b", pa.int64()), ("ends_sha256", pa.string())]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(kinds)], names=[n for n, _ in kinds]
    )


def ends_digest(ends: DataFrame) -> DataFrame:
    """`(key, ends_sha256)` of a table `(key, conv_id)`: SHA-256 of the ids in ascending order,
    comma-joined. Ids are joined in pieces of `2 ** PIECE_BITS` first; one task then reads the
    pieces of a key one after the other and holds none of them."""
    pieces = ends.groupBy("key", F.shiftright("conv_id", PIECE_BITS).alias("piece")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids")
    )
    # repartition keeps equal keys together and is not merged with the grouping above
    flat = pieces.select("key.a", "key.b", "piece", "ids").repartition("a", "b").sortWithinPartitions("a", "b", "piece")
    found = flat.select("a", "b", "ids").mapInArrow(_digests, "a long, b long, ends_sha256 string")
    return found.select(_key(F.col("a"), F.col("b")).alias("key"), "ends_sha256")


def prefix_trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per distinct prefix of the conversations, the empty one included.

    `turns` is `(conv_id, depth, digest, n_words)`, depths 1, 2, ... without gaps;
    `conversations` is `(conv_id, n_turns)`, also of those without turns. Columns: `conv_id`
    (smallest member), `depth`, `parent_conv_id`, `n_convs`, `n_children`, `n_leaves`,
    `saved_tokens`, `ends_sha256`. An empty table has no prefix and gives no row.
    """
    chain = stage(_chain(turns), "trie-chain")
    rep = F.struct("conv_id", "depth", "n_words", "above", "root", "anc")
    nodes = chain.groupBy("key").agg(F.min(rep).alias("r"), F.count(F.lit(1)).alias("n_convs"))
    nodes = nodes.select("key", "n_convs", "r.*")
    top = conversations.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    top = top.select(_root().alias("key"), "n_convs", "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("n_words"))
    nodes = stage(nodes.unionByName(top, allowMissingColumns=True), "trie-nodes")
    children = nodes.where("depth > 0").groupBy(F.col("above").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    own = nodes.join(children, "key", "left").select(
        "key", "depth", F.coalesce("n_children", F.lit(0)).alias("n_children"),
        F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("n_words")).alias("saved_tokens"),
    )
    own = stage(own, "trie-own")
    deepest = nodes.agg(F.coalesce(F.max("depth"), F.lit(0)).alias("d")).first()["d"]
    sums = _subtree_sums(own.select("key", "depth", *_SUMS), chain, nodes, deepest)
    last = chain.groupBy("conv_id").agg(F.max(F.struct("depth", "key")).alias("last")).select(F.col("last.key").alias("key"), "conv_id")
    turnless = conversations.where("n_turns = 0").select(_root().alias("key"), "conv_id")
    ends = ends_digest(last.unionByName(turnless))
    names = nodes.select(F.col("key").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    whole = nodes.select("key", "conv_id", "depth", "above", "n_convs").join(own.select("key", "n_children"), "key")
    whole = whole.join(sums, "key").join(ends, "key", "left")
    whole = salted_join(whole, names, "above", ["conv_id", "depth"])
    return whole.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", *_SUMS,
        F.coalesce("ends_sha256", F.lit(_NOTHING)).alias("ends_sha256"),
    )


def op11_prefix_trie(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return prefix_trie(*rebuilt(stage(turns_of(rows), "trie-turns")))


OP11_SQL = r"""
WITH raw AS (
  SELECT CAST(conv_id AS BIGINT) AS c, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL
), placed AS (
  SELECT c, digest, words, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, digest) AS i FROM raw
), bytes AS (
  SELECT DISTINCT c, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS b FROM raw
), convs AS (
  SELECT c, c - c % 20 AS source,
         xor(list_reduce(b, lambda s, x: list_reduce(range(8), lambda t, k: xor(t >> 1, 3988292384 * (t & 1)), xor(s, x)), 4294967295),
             4294967295) % 4 AS h
  FROM bytes
), leads AS (
  SELECT v.c, p.i AS d, p.digest, p.words FROM convs v JOIN placed p ON p.c = v.source AND p.i <= v.h
), counted AS (
  SELECT v.c, v.h, (SELECT count(*) FROM leads l WHERE l.c = v.c) AS n FROM convs v
), turns AS (
  SELECT c, d, digest, words FROM leads
  UNION ALL
  SELECT p.c, p.i - v.h + v.n, p.digest, p.words FROM placed p JOIN counted v ON p.c = v.c WHERE p.i > v.h
), chain AS (
  SELECT c, d, words, string_agg(digest, '') OVER (PARTITION BY c ORDER BY d) AS key, max(d) OVER (PARTITION BY c) = d AS last FROM turns
  UNION ALL
  SELECT c, 0, 0, '', c NOT IN (SELECT c FROM turns) FROM convs
), nodes AS (
  SELECT key, any_value(d) AS depth, min(c) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (last), '')) AS ends_sha256
  FROM chain GROUP BY key
), family AS (
  SELECT n.*, p.conv_id AS parent_conv_id, p.key AS above
  FROM nodes n LEFT JOIN nodes p ON n.depth > 0 AND p.key = substr(n.key, 1, length(n.key) - 64)
), children AS (
  SELECT above, count(*) AS n_children FROM family WHERE depth > 0 GROUP BY above
), sums AS (
  SELECT substr(u.key, 1, 64 * u.e) AS key, count(*) FILTER (ch.n_children IS NULL) AS n_leaves, sum((u.n_convs - 1) * u.words) AS saved
  FROM (SELECT *, unnest(range(depth + 1)) AS e FROM nodes) u LEFT JOIN children ch ON ch.above = u.key GROUP BY 1
)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, f.parent_conv_id, f.n_convs, coalesce(ch.n_children, 0) AS n_children,
       s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, f.ends_sha256
FROM family f JOIN sums s ON s.key = f.key LEFT JOIN children ch ON ch.above = f.key
"""
