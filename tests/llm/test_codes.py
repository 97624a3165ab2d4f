import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from webcorpus.llm import codes

SCHEMA = "vec_id long, label int, embedding array<float>"


def exhaustive(x, book):
    return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))


def brute(rows):
    """The contract in plain Python."""
    kept = []
    for vec_id, label, v in rows:
        if v and all(x is not None and math.isfinite(x) for x in v):
            kept.append((vec_id, label, [math.floor(256 * x) for x in v]))
    if not kept:
        return []
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = len(kept[0][2]) // 16
    cut = [[v[p * width : (p + 1) * width] for p in range(16)] for *_, v in kept]
    books = [[c[p] for c in cut[:64]] for p in range(16)]
    for _ in range(2):
        for p in range(16):
            groups = {}
            for c in cut:
                groups.setdefault(exhaustive(c[p], books[p])[1], []).append(c[p])
            for e, found in groups.items():
                books[p][e] = [sum(col) // len(found) for col in zip(*found, strict=True)]
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    out = []
    for (vec_id, label, _), c in zip(kept, cut, strict=True):
        found = [exhaustive(c[p], books[p]) for p in range(16)]
        out.append([vec_id, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), label])
    sums = {}
    for r in out:
        sums[r[3]] = sums.get(r[3], 0) + r[2]
    return sorted(((r[0], r[1], r[2], sums[r[3]], sha) for r in out), key=str)


def found(spark, tmp_path, rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    # columns named like inner ones
    frame = frame.withColumns({n: F.lit("clash") for n in ("codes", "ints", "error", "__key", "p")})
    frame.repartition(4).write.mode("overwrite").parquet(f"{tmp_path}/embeddings.parquet")
    return sorted(map(tuple, codes.op12_vector_codes(spark, str(tmp_path)).collect()), key=str)


@pytest.mark.parametrize("entries, high", [(1, 5), (7, 3), (64, 3), (64, 200), (40, 2**40)])
def test_search_finds_what_an_exhaustive_one_finds(entries, high):
    rng = np.random.default_rng(entries + high % 97)
    # few distinct values make many ties
    vectors = rng.integers(-high, high, (200, 3, 4))
    books = rng.integers(-high, high, (3, entries, 4))
    books[:, entries // 2] = books[:, 0]
    got, distance = codes.nearest(vectors, books)
    for i in range(200):
        for p in range(3):
            want = exhaustive([int(x) for x in vectors[i, p]], books[p].astype(object).tolist())
            assert (int(distance[i, p]), int(got[i, p])) == want


def test_random_vectors(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i * 3 - 50, rng.choice([1, 2, None]), [rng.uniform(-1, 1) for _ in range(32)]) for i in range(150)]
    rows += [(400, 1, [0.25] * 32)] * 60 + [(500 + i, 3, [rng.choice([0.0, -0.001, 0.5]) for _ in range(32)]) for i in range(60)]
    rows += [(None, 5, [0.1] * 32), (7, None, [0.2] * 32)]
    rows += [(8, 1, None), (9, 1, [None] * 32), (10, 1, [math.inf] * 32), (11, 1, [0.5] * 31 + [math.nan]), (12, 1, []), (13, 1, [1.0] * 31)]
    rows = [(i, lab, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, lab, v in rows]
    want = brute([r for r in rows if r[2] is None or len(r[2]) != 31])
    assert found(spark, tmp_path, rows) == want


def test_fewer_vectors_than_entries(spark, tmp_path):
    rows = [(i, 1, [float(i)] * 16) for i in range(5)]
    got = found(spark, tmp_path, rows)
    assert got == brute(rows) and [r[2] for r in got] == [0] * 5


def test_nothing_to_encode(spark, tmp_path):
    assert found(spark, tmp_path, []) == []
    assert found(spark, tmp_path, [(1, 1, None), (2, 1, [math.nan] * 16)]) == []


def test_huge_components(spark, tmp_path):
    """Squared distances beyond 64 bits are compared exactly and returned as the greatest long."""
    most = 2**63 - 1
    rows = [(i, 1, [(-1.0) ** i * 2.0 ** (10 + i % 44)] * 16) for i in range(64)]
    rows += [(100 + j, 1 + j % 2, [3.0 * 2.0 ** (44 + j)] * 8 + [-(2.0 ** (50 - j)) * 1.5] * 8) for j in range(6)]
    got = found(spark, tmp_path, rows)
    want = brute(rows)
    assert [(r[0], r[1], r[4]) for r in got] == [(r[0], r[1], r[4]) for r in want]
    assert [r[2] for r in got] == [min(r[2], most) for r in want] and max(r[2] for r in got) == most
    assert {r[3] for r in got} == {most}
    # components beyond 64 bits are the nearest long
    assert len(found(spark, tmp_path, [(i, 1, [(-1.0) ** i * 1e30] * 16) for i in range(5)])) == 5


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    want = sorted(db.execute(codes.OP12_SQL).fetchall(), key=str)
    assert sorted(map(tuple, codes.op12_vector_codes(spark, folder).collect()), key=str) == want


def test_codes_stand_for_vectors(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    ints = codes.integer_vectors(vectors)
    books = codes.learn(ints)
    rows = {r.vec_id: (r.codes, r.error) for r in codes.encode(ints, books).collect()}
    for r in ints.limit(50).collect():
        code, error = rows[r.vec_id]
        assert int(((codes.decode(code, books) - np.array(r.ints)) ** 2).sum()) == error
