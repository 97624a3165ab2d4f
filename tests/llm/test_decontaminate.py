import hashlib
import random
import re

import numpy as np
import pytest

from webcorpus.llm import decontaminate as dc

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall((text or "").encode().lower())


def brute(docs, items, window=10):
    windows = {}
    for item, text in items:
        w = split(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + window]), set()).add(item)
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w, hit, names = split(text), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if (key := tuple(w[i : i + size])) in windows:
                    hit.update(range(i, i + size))
                    names |= windows[key]
        listed = sorted(str(n) for n in names if n is not None)
        out.append((doc, len(w), len(hit), len(listed), hashlib.sha256(",".join(listed).encode()).hexdigest(), bool(hit)))
    return out


def made(seed, n_docs=60, n_items=12):
    rng = random.Random(seed)
    letters = ["a", "b", "Ab", "é", "x1", "the"]
    text = lambda n: rng.choice([" ", "\n", ", "]).join(rng.choice(letters) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 3, 9, 10, 11, 30]))) for i in range(n_items)] + [(99, None), (5, "the the the"), (None, "x1 é x1 é x1 x1")]
    docs = [(i, text(rng.randint(0, 120))) for i in range(n_docs)] + [(7, None), (8, ""), (8, "..."), (None, "b a b")]
    for i in range(15):
        docs.append((200 + i, text(20) + " " + (rng.choice(items)[1] or "") + ". " + text(5)))
    docs += docs[-3:]
    return docs, items


def in_memory(docs, items):
    import pyarrow as pa

    texts = pa.array([(t or "").encode() for _, t in docs], pa.binary())
    found = [r for _, _, rows in dc._search_batch(texts, dc.phrases(items)) for r in rows]
    return [
        (d, n, hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), hit > 0)
        for (d, _), (n, _, hit, names) in zip(docs, found, strict=True)
    ]


@pytest.mark.parametrize("seed", range(6))
def test_same_as_brute_force(seed):
    docs, items = made(seed)
    assert in_memory(docs, items) == brute(docs, items)


def test_small_indexes(monkeypatch):
    monkeypatch.setattr(dc, "SHARD_SYMBOLS", 50)
    monkeypatch.setattr(dc, "SHARD_BYTES", 500)
    docs, items = made(11)
    assert in_memory(docs, items) == brute(docs, items)


def test_suffix_order():
    rng = np.random.default_rng(3)
    for top in (1, 2, 50):
        text = np.append(rng.integers(0, top + 1, 300), 0)
        text = np.concatenate([text, text])
        ends = np.cumsum(text == 0) - (text == 0)
        strings = [[*[(int(v), 0) for v in text[i : i + int(np.argmax(text[i:] == 0))]], (0, int(ends[i:][np.argmax(text[i:] == 0)]))] for i in range(len(text))]
        assert dc.suffix_order(text, int(top).bit_length()).tolist() == sorted(range(len(text)), key=lambda i: strings[i])


def frames(spark, docs, items):
    return (
        spark.createDataFrame([(d, t, "c") for d, t in docs], "doc_id long, text string, row string"),
        spark.createDataFrame(items, "item_id long, text string"),
    )


def test_passes_add_up(spark):
    docs, items = made(21)
    d, b = frames(spark, docs, items)
    want = sorted((str(x[0]), *x[1:4]) for x in brute([(i, t) for i, t in docs], [i for i in items if i[0] is not None]))
    b = b.where("item_id IS NOT NULL")
    for pass_bytes in (dc.PASS_BYTES, 150):
        rows = dc.find_passages(d, b, ["doc_id"], pass_bytes=pass_bytes).collect()
        assert sorted((str(r.row.doc_id), r.n_words, r.n_hit, len(r["items"])) for r in rows) == want


def test_cut_texts_have_no_passage(spark):
    docs, items = made(31)
    d, b = frames(spark, docs, items)
    cut = dc.without_passages(d, b)
    assert cut.columns == d.columns and cut.count() == len(docs)
    for (_, text), row, hits in zip(docs, cut.collect(), brute(docs, items), strict=True):
        assert row.row == "c"
        assert (row.text == (text or "")) if not hits[5] else len(split(row.text)) == hits[1] - hits[2]


def test_empty_tables(spark):
    d, b = frames(spark, [(1, "a b")], [(1, "a b")])
    assert dc.find_passages(d.limit(0), b, ["doc_id"]).count() == 0
    assert dc.find_passages(d, b.limit(0), ["doc_id"]).collect()[0].n_hit == 0


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    got = sorted(tuple(r) for r in dc.op4_decontamination(spark, folder).collect())
    assert got == sorted(brute(docs, items))
    assert any(r[5] for r in got)
