import zlib

import numpy as np
import pytest

from webcorpus.llm import quality


def plain_score(network, text):
    """The network's definition, window by window."""
    padded = text + bytes(quality.WIDTH)
    pooled = []
    for start in range(0, max(len(text), 1), quality.CHUNK):
        acts = [
            sum(network.filters[k, padded[i + k]] for k in range(quality.WIDTH))
            for i in range(start, min(start + quality.CHUNK, max(len(text), 1)))
        ]
        pooled.append(np.maximum(np.max(acts, axis=0) + network.bias, 0))
    features = np.concatenate([np.mean(pooled, axis=0), np.max(pooled, axis=0)])
    inner = np.tanh(features @ network.inner + network.inner_bias)
    return float(1 / (1 + np.exp(-(inner @ network.outer + network.outer_bias)))[0])


def random_network():
    return quality.fit([[b"good text here" + bytes(5)], [b"bad!! bad!!" + bytes(5)]] * 3, np.array([1, 0] * 3, np.float32))


def test_whole_texts_are_scored(monkeypatch):
    monkeypatch.setattr(quality, "_STEP", 512)
    network = random_network()
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(0, 256, n, dtype=np.uint8)) for n in (0, 1, 3, 255, 256, 257, 511, 512, 513, 1500, 0, 5)]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    got = quality.score_texts(network, data, offsets)
    np.testing.assert_allclose(got, [plain_score(network, t) for t in texts], atol=1e-5)


def test_gradients():
    network = random_network()
    network.filters, network.inner = network.filters.astype(np.float64), network.inner.astype(np.float64)
    texts = [[b"some text" + bytes(5), b"other" + bytes(5)], [b"x!! y!!" + bytes(5)]]
    labels, weight = np.array([1.0, 0.0]), np.array([1.0, 1.0])

    def loss():
        p = [plain_chunks(network, t) for t in texts]
        return -(np.log(p[0]) + np.log(1 - p[1])) / 2

    gradients = quality._gradients(network, texts, labels, weight)
    rng = np.random.default_rng(0)
    for p, g in zip(network.parameters(), gradients, strict=True):
        strong = np.flatnonzero(np.abs(g.ravel()) > 1e-3)
        for i in rng.choice(strong, min(4, len(strong)), replace=False):
            at = np.unravel_index(i, p.shape)
            kept = p[at]
            p[at] = kept + 1e-3
            up = loss()
            p[at] = kept - 1e-3
            down = loss()
            p[at] = kept
            assert (up - down) / 2e-3 == pytest.approx(g[at], rel=0.1, abs=2e-3)


def plain_chunks(network, chunks):
    pooled = []
    for c in chunks:
        acts = [sum(network.filters[k, c[i + k]] for k in range(quality.WIDTH)) for i in range(len(c) - quality.WIDTH + 1)]
        pooled.append(np.maximum(np.max(acts, axis=0) + network.bias, 0))
    features = np.concatenate([np.mean(pooled, axis=0), np.max(pooled, axis=0)])
    inner = np.tanh(features @ network.inner + network.inner_bias)
    return float(1 / (1 + np.exp(-(inner @ network.outer + network.outer_bias)))[0])


def test_query_on_held_out_texts(spark):
    folder = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in quality.op9_quality(spark, folder).collect()}
    docs = dict(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect())
    assert rows.keys() == docs.keys()
    labels = dict(spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality").collect())
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in rows.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows.values())
    held = [(rows[d].predicted, q) for d, q in labels.items() if rows[d].held_out]
    assert np.mean([p == q for p, q in held]) > 0.9
    assert np.mean([p for p, q in held if q == 1]) > 0.93


def test_odd_rows(spark):
    rows = [(1, "fine text", "a"), (1, "fine text", "a"), (None, "x", "b"), (2, None, None), (3, "", "c"), (4, "z" * 200_000, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None), (2, 0), (9, 1), (4, 1)], "doc_id long, quality int")
    network = quality.learn(docs, labels, quality.remainder(quality.F.col("doc_id"), 4) != 9)
    got = quality.score(docs, network, ["doc_id", "score"]).collect()
    assert [(r.row.doc_id, r.row.score) for r in got] == [(r[0], r[2]) for r in rows]
    assert all(0 <= r.score <= 1 for r in got) and got[3].score == got[4].score and got[0].score == got[1].score
    nothing = quality.learn(docs.limit(0), labels.limit(0), quality.F.lit(True))
    assert [r.score for r in quality.score(docs.limit(1), nothing, ["doc_id"]).collect()] == [0.5]
    assert quality.score(docs.limit(0), network, ["doc_id"]).count() == 0
