import math
import zlib
from collections import Counter

import numpy as np
import pytest

from webcorpus.llm import lm


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


def base_scores(docs, learned):
    counts = Counter(t for d, text in docs if learned(d) for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    out = []
    for d, text in docs:
        own = tokens(text)
        out.append((d, not learned(d), len(own), sum(counts[t] > 0 for t in own), n, sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in own)))
    return out


def learned(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 != 0


def compare(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    np.testing.assert_allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)


@pytest.mark.parametrize("frequent", [200_000, 40])
def test_base_scores(spark, monkeypatch, frequent):
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    monkeypatch.setattr(lm, "STEPS", 5)
    docs = [(i, " ".join(f"W{(i * 7 + j * j) % 61}" for j in range(i % 40))) for i in range(200)]
    docs += [(500, None), (501, ""), (None, "w1 nowhere w1"), (502, "rare " * 400), (503, "x\ty\nz\x0b W1"), docs[3], docs[3]]
    df = spark.createDataFrame([(d, t, 0.0) for d, t in docs], "doc_id long, text string, score double").repartition(3)
    remainder = lm.F.crc32(lm.F.col("doc_id").cast("string").cast("binary")) % 10
    got = lm.score_documents(df, lm.F.coalesce(remainder != 0, lm.F.lit(False))).collect()
    compare(got, base_scores(docs, learned))
    assert all(-1e9 < r.score < 0 for r in got)


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    rows = lm.score_documents(df, lm.F.lit(False)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0 and math.isfinite(r.score) for r in rows)
    assert lm.score_documents(df.limit(0), lm.F.lit(True)).count() == 0


def test_probabilities_add_up_to_one():
    rng = np.random.default_rng(1)
    follows = np.zeros(((lm.UNITS + 1) ** 2, lm.UNITS), dtype=np.int64)
    follows[rng.integers(0, len(follows), 3000), rng.integers(0, lm.UNITS, 3000)] = rng.integers(1, 50, 3000)
    table = lm.train(follows, 20)
    np.testing.assert_allclose((10.0 ** table.astype(float)).sum(axis=1), 1, rtol=1e-4)
    number = np.sort(rng.zipf(1.5, 3000))[::-1].clip(1, 10**6)
    counts = lm.Counts(int(number.sum()), len(number), int((number == 1).sum()), np.arange(900, dtype=np.uint64), number[:900])
    units, inside = lm.units_of(counts)
    for u in np.unique(units):
        assert (10 ** inside[units == u]).sum() == pytest.approx(1)
    rare = (10 ** counts.inside_rare(number[900:])).sum() + 10 ** counts.inside_rare(np.array([0]))[0]
    assert rare == pytest.approx(1)


def test_model_learns_what_follows():
    follows = np.zeros(((lm.UNITS + 1) ** 2, lm.UNITS), dtype=np.int64)
    width = lm.UNITS + 1
    for a in range(8):
        for b in range(8):
            follows[a * width + b, (b + 1) % 8] = 90
            follows[a * width + b, a] += 10
    p = 10.0 ** lm.train(follows)
    for a in range(8):
        for b in range(8):
            assert p[a * width + b, (b + 1) % 8] > 0.6


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = lm.op2_lm_score(spark, folder).collect()
    compare(got, base_scores(docs, learned))
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > 0.9 * sum(r.base_score for r in held) and held


def spelling(texts):
    """log10 probability of a word's bytes and its end, from the bytes of the words of texts."""
    pairs = Counter()
    for t in texts:
        for w in t.encode().lower().split():
            pairs.update(zip([256, *w], [*w, 256], strict=True))
    of = Counter()
    for (a, _), n in pairs.items():
        of[a] += n
    return lambda w: sum(math.log10((pairs[p] + lm.ADDED_BYTES) / (of[p[0]] + lm.ADDED_BYTES * 257)) for p in zip([256, *w], [*w, 256], strict=True))


def test_spelling_same_as_brute_force():
    texts = ["Ab b\tcafé", "", "zz", "b ab  q"]
    data = "".join(texts).encode()
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    _, _, found, _ = lm._tokens(np.frombuffer(data, np.uint8), offsets)
    table = lm.spelling_of(lm.count_bytes(found, np.ones(len(found.starts), dtype=bool)))
    want = spelling(texts)
    words = [w for t in texts for w in t.encode().lower().split()]
    np.testing.assert_allclose(lm.spelled(found, table), [want(w) for w in words])
    some = np.arange(len(words)) % 2 == 0
    table = lm.spelling_of(lm.count_bytes(found, some))
    want = spelling([b" ".join(w for w, s in zip(words, some, strict=True) if s).decode()])
    np.testing.assert_allclose(lm.spelled(found, table), [want(w) for w in words])


def test_spellings_add_up_to_one():
    counts = np.random.default_rng(2).integers(0, 9, 257 * 257)
    steps = 10.0 ** lm.spelling_of(counts).reshape(257, 257)
    np.testing.assert_allclose(steps.sum(axis=1), 1)
    at = np.zeros(257)
    at[256], ended = 1.0, 0.0
    for _ in range(5000):
        at = at @ steps
        ended, at[256] = ended + at[256], 0.0
    assert ended == pytest.approx(1, abs=1e-6)


def test_score_same_as_brute_force(spark, monkeypatch):
    """Few words are frequent, so most are looked up by bucket or spelled."""
    monkeypatch.setattr(lm, "FREQUENT", 1)
    monkeypatch.setattr(lm, "STEPS", 5)
    docs = [(1, "a a b b c d"), (2, "a b e"), (3, ""), (10, "a zq zq"), (11, "b c b"), (12, None), (13, "x" * 5000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    models = []
    monkeypatch.setattr(lm, "train", lambda follows, real=lm.train: models.append(real(follows)) or models[0])
    got = {r.doc_id: (r.score, r.text_score) for r in lm.score_documents(df, lm.F.col("doc_id") < 10).collect()}
    train = [t for d, t in docs if d < 10]
    counts = Counter(t for x in train for t in tokens(x))
    words_of = lambda text: (text or "").encode().lower().split()
    # the most frequent token of each bucket that stands more than once has a unit of its own
    known = lm.totals(lm.count_words(df, lm.F.col("doc_id") < 10, 8))
    own = {int(h) for h in known.hashes}
    hashed = lambda w: int(lm._tokens(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[0][0])
    rare = [w for x in train for w in words_of(x) if hashed(w) not in own]
    likely = spelling([b" ".join(rare).decode()])
    units, inside = lm.units_of(known)
    place = {int(h): i for i, h in enumerate(known.hashes)}
    for d, text in docs:
        total, letters, context = 0.0, 0.0, (lm.UNITS, lm.UNITS)
        for w in [*words_of(text), None]:
            at = place.get(int(lm.END) if w is None else hashed(w))
            unit = lm.UNITS - 1 if at is None else int(units[at])
            total += models[0][context[0] * (lm.UNITS + 1) + context[1], unit]
            if at is not None:
                total += inside[at]
            else:
                total += float(known.inside_rare(np.array([counts[w]]))[0])
                letters += 0 if counts[w] else likely(w)
            context = (context[1], unit)
        assert got[d] == pytest.approx((total, total + letters), rel=1e-4), d


def test_random_letters_score_below_prose(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    rng = np.random.default_rng(5)
    junk = [(-i, " ".join("".join(map(chr, rng.integers(97, 123, 9))) for _ in range(100))) for i in range(1, 21)]
    both = docs.union(spark.createDataFrame(junk, "doc_id long, text string"))
    remainder = lm.F.crc32(lm.F.col("doc_id").cast("string").cast("binary")) % 10
    rows = lm.score_documents(both, (lm.F.col("doc_id") > 0) & (remainder != 0)).where("held_out").collect()
    each = lambda own: [r.text_score / r.n_tokens for r in rows if own(r)]
    assert max(each(lambda r: r.doc_id < 0)) < min(each(lambda r: r.doc_id > 0 and r.n_tokens > 20))
