import random

import numpy as np
import pytest

from webcorpus.llm import components, jaccard


def brute(docs):
    """(doc_id, n_shingles, component_id) per row."""
    sets = []
    for _, text in docs:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    parent = list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 4 * min(len(a), len(b)) >= 3 * max(len(a), len(b)) and 100 * len(a & b) >= 75 * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(docs):
        r = find(i)
        least[r] = min(x for x in (least.get(r, 1 << 63), 1 << 62 if doc is None else doc) if x is not None)
    out = []
    for i, (doc, _) in enumerate(docs):
        c = least[find(i)]
        out.append((doc, len(sets[i]), None if c >= 1 << 62 else c))
    return out


def made(seed, groups=6, members=14):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 3000)}"
    passage = [word() for _ in range(60)]
    docs, n = [], 1000
    for _ in range(groups):
        base = [word() for _ in range(rng.randint(8, 150))]
        for _ in range(rng.randint(1, members)):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 20))):
                own[rng.randrange(len(own))] = word()
            if rng.random() < 0.3:
                own = own[: rng.randint(len(own) // 2, len(own))]
            docs.append((n := n - rng.randint(1, 3), " ".join(own)))
    docs += [(2000 + i, " ".join([word() for _ in range(20)] + passage + [word() for _ in range(rng.randint(0, 30))])) for i in range(25)]
    docs += [(3000, "A b"), (3001, "a  B\n"), (3002, "a b c"), (3003, None), (3004, ""), (None, "a b"), (None, "only here and nowhere else"), (3005, "x x x x x x x x x")]
    docs += [docs[0], docs[1], (docs[0][0], "another text of a known id with words"), (4000, docs[3][1]), (4001, docs[3][1].upper())]
    rng.shuffle(docs)
    return docs


def got(spark, docs):
    import tempfile

    folder = tempfile.mkdtemp()
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, node string")
    df.repartition(3).write.parquet(f"{folder}/documents.parquet")
    return [tuple(r) for r in jaccard.op3_jaccard_join(spark, folder).collect()]


KEY = lambda r: tuple((x is None, x or 0) for x in r)


@pytest.mark.parametrize("seed, often, broadcast", [(1, 3, 500_000), (2, 1, 0)])
def test_same_as_brute_force(spark, monkeypatch, seed, often, broadcast):
    monkeypatch.setattr(jaccard, "OFTEN", often)
    monkeypatch.setattr(jaccard, "SAMPLED", 2)
    monkeypatch.setattr(jaccard, "HEAVY", 5 if often == 1 else 64)
    monkeypatch.setattr(jaccard, "BLOCK", 3)
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", broadcast)
    docs = made(seed)
    assert sorted(got(spark, docs), key=KEY) == sorted(brute(docs), key=KEY)


def test_bitmaps_bound_the_overlap():
    rng = np.random.default_rng(5)
    for _ in range(200):
        pool = rng.integers(0, 2**63, 300).astype(np.uint64)
        a = np.unique(rng.choice(pool, rng.integers(1, 250)))
        b = np.unique(rng.choice(pool, rng.integers(1, 250)))
        sizes = np.array([len(a), len(b)])
        x, y = jaccard.bitmaps(np.concatenate([a, b]), np.repeat([0, 1], sizes), sizes)
        assert jaccard.overlap_bound(x, y, len(a), len(b)) >= len(np.intersect1d(a, b))
        assert jaccard.overlap_bound(x, x, len(a), len(a)) == len(a)


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(150, 190)]
    parent = {}

    def find(i):
        parent.setdefault(i, i)
        return i if parent[i] == i else find(parent[i])

    for a, b in links:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame(links, "a long, b long")
    assert dict(map(tuple, components.components(df).collect())) == {i: find(i) for i in parent}
    assert components.components(df.limit(0)).count() == 0


def test_one_of_each_group_stays(spark):
    docs = made(3, groups=3)
    df = spark.createDataFrame([(d, t, "s") for d, t in docs], "doc_id long, text string, first string")
    kept = jaccard.one_of_each(df)
    assert kept.columns == df.columns
    rows = brute(docs)
    want = {r[2] for r in rows if r[1]} | {r[0] for r in rows if not r[1]}
    assert {r.doc_id for r in kept.collect()} == want
    assert jaccard.one_of_each(df.limit(0)).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    rows = sorted(tuple(r) for r in jaccard.op3_jaccard_join(spark, folder).collect())
    assert rows == sorted(brute(docs)) and any(r[2] != r[0] for r in rows)
