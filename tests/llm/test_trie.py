import hashlib
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from webcorpus.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def rebuild(rows):
    """Conversations as lists of (role, text), by the words of the contract."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - (abs(c) % 20) * (1 if c >= 0 else -1), [])[:h] + turns[h:]
    return out


def brute(rows):
    built = rebuild(rows)
    nodes = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), set()).add(c)
    kids = {}
    for key in nodes:
        if key:
            kids.setdefault(key[:-1], []).append(key)
    leaves, saved = {k: 0 for k in nodes}, {k: 0 for k in nodes}
    for key, members in nodes.items():
        own = (len(members) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", key[-1][1])) if key else 0
        for d in range(len(key) + 1):
            leaves[key[:d]] += key not in kids
            saved[key[:d]] += own
    out = []
    for key, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(built[c]) == len(key))
        parent = min(nodes[key[:-1]]) if key else None
        out.append((min(members), len(key), parent, len(members), len(kids.get(key, [])), leaves[key], saved[key], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[1], r[0]))


def found(spark, tmp_path, rows, extra=False):
    frame = spark.createDataFrame(rows, SCHEMA)
    if extra:  # columns named like inner ones
        frame = frame.withColumns({n: F.lit("clash") for n in ("key", "depth", "chunk", "digest", "n_words", "a")})
    frame.repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
    return sorted(map(tuple, trie.op11_prefix_trie(spark, str(tmp_path)).collect()), key=lambda r: (r[1], r[0]))


def by_sql(tmp_path):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    names = "conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256"
    return sorted(db.execute(f"SELECT {names} FROM ({trie.OP11_SQL})").fetchall(), key=lambda r: (r[1], r[0]))


def drawn(seed, conversations, longest, texts):
    rng = random.Random(seed)
    rows = []
    for c in conversations:
        for t in range(rng.randrange(longest)):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(texts)))
    return rows


def test_random_conversations(spark, tmp_path):
    rows = drawn(1, [*range(-45, 70), 1000, 2**62], 6, ["a", "b c", "", None, "d\te\n f"])
    rows += [(5, None, None, "first"), (5, 3, None, None), (5, 3, None, None), (None, 0, "user", "no id"), (7, -5, "x", "y")]
    got = found(spark, tmp_path, rows, extra=True)
    assert got == brute(rows)
    assert got == by_sql(tmp_path)


def test_long_conversations_over_many_bands(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(trie, "BAND", 2)
    monkeypatch.setattr(trie, "CHUNK_BITS", 3)
    monkeypatch.setattr(trie, "PIECE_BITS", 1)
    rows = drawn(2, range(12), 5, ["a", "b"])
    # long ones that part late, at, before and after the edges of bands and chunks
    for c, n, part in ((20, 70, 99), (21, 70, 64), (22, 66, 33), (23, 41, 16), (24, 70, 17), (25, 15, 99), (26, 64, 99)):
        rows += [(c, t, "user", f"w{t} x" if t < part else f"other {t % 3}") for t in range(n)]
    assert found(spark, tmp_path, rows) == brute(rows)


def test_copies_of_one_conversation(spark, tmp_path):
    rows = [(c, t, "user", f"same {t}") for c in range(700) for t in range(4)] + [(c, 0, "user", "same 0") for c in range(700, 740)]
    got = found(spark, tmp_path, rows)
    assert got == brute(rows)
    # a conversation shorter than the turns it gives up, with nobody to take them from, is left without turns
    only = [(c, 0, "user", "x") for c in (41, 42, 43)]
    assert found(spark, tmp_path, only) == brute(only)


def test_a_very_long_text(spark, tmp_path):
    rows = [(c, 0, "user", "wörd x " * 300_000) for c in (0, 1, 2)]
    got = found(spark, tmp_path, rows)
    assert got == brute(rows) and got[0][6] >= 300_000


@pytest.mark.parametrize("rows", [[], [(None, 1, "user", "text")]])
def test_no_conversations(spark, tmp_path, rows):
    assert found(spark, tmp_path, rows) == []


def test_a_node_is_copied_to_its_band_only(spark):
    rows = [(1, t, "user", f"t{t}") for t in range(600)]
    turns = trie.turns_of(spark.createDataFrame(rows, SCHEMA)).withColumn("depth", F.col("turn") + 1)
    chain = trie._chain(turns.select("conv_id", "depth", "digest", "n_words"))
    assert chain.agg(F.max(F.size("anc"))).first()[0] == trie.BAND - 1
