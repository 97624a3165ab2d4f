import random

from webcorpus.llm import topk


def brute(vectors, k, every):
    out = []
    for q, x in vectors.items():
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(x, y, strict=False)), c) for c, y in vectors.items() if c != q)
            out += [(q, i + 1, c, -s) for i, (s, c) in enumerate(scored[:k])]
    return sorted(out)


def test_ties_blocks_and_sparse_rows(spark):
    rng = random.Random(1)
    vectors = {i: [rng.choice([0, 0, 0, 1, -2, 3]) for _ in range(rng.choice([0, 3, 8]))] for i in range(150)}
    vectors |= {200 + i: [1, 1, 0, -2] for i in range(60)} | {400: [2**40] * 3, 420: [-(2**20)] * 8}
    table = spark.createDataFrame(list(vectors.items()), "vec_id long, weights array<long>")
    got = topk.top_k(table.where("vec_id % 20 = 0"), table, 7, (20, 3))
    assert sorted(map(tuple, got.collect())) == brute(vectors, 7, 20)
    few = table.where("vec_id < 4")
    assert topk.top_k(few.where("vec_id = 0"), few, 20).count() == 3
    assert topk.top_k(few.limit(0), few, 20).count() == 0
    assert topk.top_k(few, few.limit(0), 20).count() == 0


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, -0.01]), (1, None), (2, [0.1, None]), (3, [nan, 1.0]), (4, [1.0, -inf]), (None, [1.0]), (5, []), (6, [1.0, 0.3]), (6, [1.0, 0.3])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, weights string")
    got = {r.vec_id: r.weights for r in topk.weights(df).collect()}
    assert got == {0: [32, -1], 5: [], 6: [64, 19]}


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    import duckdb

    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    want = sorted(db.execute(topk.OP5_SQL).fetchall())
    got = topk.op5_topk(spark, folder)
    assert sorted(map(tuple, got.collect())) == want
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "int", "bigint", "bigint"]


def test_rows_that_share_an_id(spark, tmp_path):
    import duckdb

    rng = random.Random(5)
    rows = [(rng.choice([0, 1, 2, 3, 20, 21, 40]), [rng.choice([0.0, 0.5, -0.25, 1.0]) for _ in range(4)]) for _ in range(90)]
    rows += [(20, [9.0] * 4)] * 40 + [(i, [0.1, 0.2, 0.3, 0.4]) for i in range(50, 60)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(db.execute(topk.OP5_SQL).fetchall())
    assert sorted(map(tuple, topk.op5_topk(spark, str(tmp_path)).collect())) == want
