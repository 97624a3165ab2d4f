import importlib.util
import os

import corpus_pipeline
from webcorpus.llm import bpe


def sibling(name):
    """Brute-force versions live in the tests of the operators."""
    path = os.path.join(os.path.dirname(__file__), f"{name}.py")
    spec = importlib.util.spec_from_file_location(f"brute_{name}", path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def cut_passages(text, items):
    dc = sibling("test_decontaminate")
    raw = (text or "").encode()
    spots = [m.span() for m in dc.WORD.finditer(raw.lower())]
    own = [raw.lower()[a:b] for a, b in spots]
    windows = set()
    for _, item in items:
        w = dc.split(item)
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9) if w else 0)}
    hit = set()
    for size in {len(w) for w in windows}:
        for i in range(len(own) - size + 1):
            if tuple(own[i : i + size]) in windows:
                hit.update(range(i, i + size))
    out, at = b"", 0
    for i in sorted(hit):
        if i - 1 not in hit:
            out += raw[at : spots[i][0]]
        if i + 1 not in hit:
            at = spots[i][1]
    return (out + raw[at:]).decode()


def test_stages_and_run(spark):
    from tokenizers import Tokenizer

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    kept = corpus_pipeline.good_quality(spark, docs, folder).select("doc_id", "text").collect()
    rows = [tuple(r) for r in kept]
    assert 0.7 * docs.count() < len(rows) < docs.count()
    lines = sibling("test_line_dedup").brute(rows)
    rows = [(d, k) for d, n, g, k in lines if g == 0 or g < n]
    groups = sibling("test_jaccard").brute(rows)
    rows = [r for r, (d, n, c) in zip(rows, groups, strict=True) if n == 0 or d == c]
    rows = [(d, cut_passages(t, items)) for d, t in rows]
    library = Tokenizer.from_file(bpe.default_path())
    want = sorted((d, library.encode(t, add_special_tokens=False).ids) for d, t in rows)
    got = corpus_pipeline.run(spark, folder).collect()
    unpacked = [(r.doc_id, [int.from_bytes(r.ids[i : i + 4], "little") for i in range(0, len(r.ids), 4)]) for r in got]
    assert sorted(unpacked) == want
    assert all(r.decoded == library.decode(i, skip_special_tokens=False) for r, (_, i) in zip(got, unpacked, strict=True))


def test_odd_tables(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(1, None, "a", 0), (2, "", None, 1), (None, "some words of a text without an id", None, None), (3, "x " * 50_000, "b", 2)]
    rows += [(4, "a repeated row that stands here twice", "c", 3)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, n_chars int")
    for table in (docs, docs.limit(0)):
        for name, function in corpus_pipeline.STAGES[:-1]:
            table = function(spark, table, folder)
            assert table.columns == docs.columns, name
        assert corpus_pipeline.STAGES[-1][1](spark, table, folder).count() == (0 if table.isEmpty() else table.count())


def test_stages_follow_the_contract():
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
