import hashlib
import itertools
import random
import struct
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from webcorpus.llm import bpe

PATH = bpe.default_path()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


CODER = bpe.WordBpe(PATH)
TEXTS = [
    "", "   \n\t", "Hello, World's don't 12345 été ÉTÉ", "a<|endoftext|>B <|StartOfText|> <|startoftext|>x",
    "İİ ΣΣ ß ẞ nbsp here em \x1c\x1f \x85", "你好世界 \U0001f600\U0001f601 क्ष",
    "'''s 're're ''ll'd can'T", "a\ńb ́", "\x00\x01 ﻿​", "thntblere erblesh", "q" * 3000 + "zx" * 500, "||| --- ==> 3.14%",
]


def expected(library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


def check(library, text):
    packed, decoded = CODER.both(text.encode())
    ids, want = expected(library, text)
    assert [int.from_bytes(packed[i : i + 4], "little") for i in range(0, len(packed), 4)] == ids
    assert decoded == want == CODER.decode(packed)


@pytest.mark.parametrize("text", TEXTS)
def test_same_ids_as_the_library(library, text):
    check(library, text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=40))
def test_any_text(library, text):
    check(library, text)


def test_cuts_are_where_no_token_joins():
    word = "".join(CODER._letters[b] for b in "你x好".encode())
    cut = CODER.fragments(word)
    assert "".join(cut) == word and len(cut) > 1


def test_memory_is_bounded():
    """By bytes, and long keys are not remembered."""
    memory = bpe.Remembered(lambda k: (k.encode() * 4, k + " "), 40 * (bpe._ENTRY + 40))
    for i in range(500):
        assert memory[f"w{i % 137}"] == (f"w{i % 137}".encode() * 4, f"w{i % 137} ")
    assert len(memory) <= 50 and 0 < len(memory._older) <= 50
    long = "x" * bpe.LONG
    assert memory[long][1] == long + " " and long not in memory and long not in memory._older


@pytest.mark.parametrize("text", ["a" * 5000, "=" * 4000, "ab" * 3000, "the" * 1500, "é" * 2000, "aé" * 1000, "x" * 63 + " " + "y" * 64 + " " + "z" * 65])
def test_long_words(library, text):
    check(library, text)


def test_heap_merges_as_the_scan_does():
    rng = random.Random(1)
    for _ in range(300):
        word = "".join(rng.choice("theanisoer.") for _ in range(rng.randrange(1, 60)))
        parts = [*word[:-1], word[-1] + CODER.suffix]
        order = [CODER._ranks.get(p, len(CODER._ranks)) for p in itertools.pairwise(parts)]
        assert [CODER.vocabulary[p] for p in CODER._merged_by_heap(parts, order)] == CODER._merged(word, True)


def test_a_megabyte_of_one_letter(library):
    start = time.time()
    packed, decoded = CODER.both(b"a" * (1 << 20))
    assert time.time() - start < 60 and decoded.replace(" ", "").startswith("a" * 1000)
    assert packed == struct.pack(f"<{len(packed) // 4}I", *library.encode("a" * (1 << 20), add_special_tokens=False).ids)


def test_pieces_of_long_texts(library, monkeypatch):
    monkeypatch.setattr(bpe, "_PIECE", 50)
    for text in [*TEXTS, " ".join(TEXTS), "wörd and\x0bmore\x0cwords\r\n" * 40, "a b " * 99 + "<|endoftext|>" + " c" * 99]:
        check(library, text)


def test_documents(spark, library):
    rows = [(1, t, "clash") for t in TEXTS] + [(2, None, None), (None, "x", "y"), (1, "x", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.encode_documents(docs, PATH).collect()
    assert len(got) == len(rows)
    for (_, text, _), row in zip(rows, got, strict=True):
        assert row.decoded == expected(library, text or "")[1]
    assert bpe.encode_documents(docs.limit(0), PATH).count() == 0
    again = bpe.decode_documents(bpe.encode_documents(docs, PATH), PATH).collect()
    assert [r.decoded for r in again] == [r.decoded for r in got]


def test_query(spark, library):
    rows = bpe.op8_bpe(spark, "/root/testdata/sf0.001").collect()
    texts = dict(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect())
    assert len(rows) == len(texts)
    for r in rows:
        ids, text = expected(library, texts[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_latin_texts_are_read_without_the_library():
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    from webcorpus.llm import bpe

    path = public_tokenizers.path("word_bpe_49k.json")
    library, coder = Tokenizer.from_file(path), bpe.WordBpe(path)
    coder._parts = None  # the library's splitter is not needed
    rng = random.Random(3)
    signs = ["a", "B", "é", "É", "ß", "þ", "Þ", "«", "»", "¿", "§", "–", "’", "…", "€", "'", "'LL", "s", "9", " ", "\t", "\n", "\x1c", "-", "Ö", "ÀÁ"]
    for _ in range(2000):
        text = "é" + "".join(rng.choice(signs) for _ in range(rng.randrange(1, 30)))
        want = library.encode(text, add_special_tokens=False).ids
        assert coder.encode(text.encode()) == b"".join(i.to_bytes(4, "little") for i in want), text
