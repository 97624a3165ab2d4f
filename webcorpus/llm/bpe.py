"""BPE encoding and decoding by forced boundaries.

A merge makes a vocabulary token, so two bytes that stand side by side in no token of the
vocabulary are never joined: between them a cut is certain. Words are cut there, fragments
are merged on their own and the ids are put one after the other. No row is shuffled; words
that were seen lately are remembered in a table of bounded bytes.

The vocabulary is a file of the tokenizers library whose words end in a suffix; its
normalizer and the pattern of its words come from that file.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webcorpus.llm import words
from webcorpus.llm.batches import map_texts

#: Bytes of one generation of the words remembered, and of the fragments; two generations
#: of either are held.
WORD_BYTES, FRAGMENT_BYTES = 44 << 20, 4 << 20
#: Letters from which a word or fragment is not remembered, and is merged by a heap.
LONG = 64
#: Bytes of a text that are worked on at once, unless there is no white space to cut at.
_PIECE = 1 << 16
#: What an entry takes beside its texts.
_ENTRY = 250
#: Letters of Latin-1 in pairs of cases, and punctuation that is read without the library.
_LATIN = "À-ÖØ-Þß-öø-þ"
_SIGNS = "¡§©«·»¿‐‑–—‘’‚“”„…€"


class Remembered(dict):
    """Values of a function by key, as pairs of what can be measured; the generation before
    the last is forgotten. Keys of `LONG` letters or more are worked out every time."""

    def __init__(self, function: Callable, limit: int):
        self._function, self._limit, self._held, self._older = function, limit, 0, {}

    def __missing__(self, key):
        value = self._older.get(key)
        if value is None:
            value = self._function(key)
            if len(key) >= LONG:
                return value
        self._held += _ENTRY + 2 * len(key) + len(value[0]) + 2 * len(value[1])
        if self._held >= self._limit:
            self._older, self._held = dict(self), 0
            self.clear()
        self[key] = value
        return value


def byte_letters() -> list[str]:
    """The letter of each byte: printable Latin-1 as it is, the others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class WordBpe:
    """Encodes and decodes with one vocabulary file. Made once per task."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.vocabulary: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self._ranks = {tuple(m): rank for rank, m in enumerate(merges)}
        self._letters = byte_letters()
        self._special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (self.vocabulary | self._special).items()}
        self._spaced = {i: t + " " for i, t in self.tokens.items()}
        self._opening = os.path.commonprefix(list(self._special))
        self._specials = re.compile("(" + "|".join(map(re.escape, self._special)) + ")")
        library = Tokenizer.from_file(path)
        self._normal, self._parts = library.normalizer, library.pre_tokenizer
        # the file's pattern over lower-case ASCII
        self._ascii = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ \t\n\r\f\va-z0-9]+")
        self._control = re.compile(r"[\x00-\x08\x0e-\x1f\x7f]")
        # the same with the letters of Latin-1, for texts of these and of some punctuation, all
        # composed: no character of them is white space, a number or changed but by lower case
        self._latin = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[a-z{_LATIN}]+|[0-9]|[^ \t\n\r\f\va-z0-9{_LATIN}]+")
        self._beyond = re.compile(rf"[^\x00-\x7f{_LATIN}{_SIGNS}]")
        self._lettered = {
            c: "".join([self._letters[b] for b in chr(c).encode()])
            for c in [*range(0x20), *range(0x7F, 0x100), *map(ord, _SIGNS)]
        }
        self._space = re.compile(rb"[ \t\n\r\f\v]")
        self._joined = {
            pair
            for token in self.vocabulary
            for pair in pairwise(token.removesuffix(self.suffix))
        }
        # one table for fragments inside of words, one for those at their ends
        self._inner = Remembered(lambda f: self._packed(self._merged(f, False)), FRAGMENT_BYTES)
        self._last = Remembered(lambda f: self._packed(self._merged(f, True)), FRAGMENT_BYTES)
        self._words = Remembered(self._word, WORD_BYTES)

    def fragments(self, word: str) -> list[str]:
        """A word in byte letters, cut between letters that no token joins."""
        joined = self._joined
        cuts = [i for i, pair in enumerate(pairwise(word), 1) if pair not in joined]
        if not cuts:
            return [word]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)], strict=True)]

    def _merged(self, text: str, last: bool) -> list[int]:
        """Ids of a fragment; `last` says whether it ends a word."""
        parts = list(text)
        if last:
            parts[-1] += self.suffix
        ranks, none = self._ranks, len(self._ranks)
        order = [ranks.get(pair, none) for pair in pairwise(parts)]
        if len(parts) >= LONG:
            parts = self._merged_by_heap(parts, order)
        else:
            while order:
                best = min(order)
                if best == none:
                    break
                i = order.index(best)
                parts[i] += parts.pop(i + 1)
                del order[i]
                if i:
                    order[i - 1] = ranks.get((parts[i - 1], parts[i]), none)
                if i < len(order):
                    order[i] = ranks.get((parts[i], parts[i + 1]), none)
        vocabulary = self.vocabulary
        return [vocabulary[p] for p in parts]

    def _merged_by_heap(self, parts: list[str], order: list[int]) -> list[str]:
        """The same merges, lowest rank and then leftmost first, in n log n steps: parts are
        a linked list, and a heap holds the pairs. One whose parts changed since is skipped."""
        ranks, none = self._ranks, len(self._ranks)
        size = len(parts)
        after, before = [*range(1, size), -1], list(range(-1, size - 1))
        now: list[int] = [*order, none]  # rank of each part with the next one
        heap = [(rank, i) for i, rank in enumerate(order) if rank != none]
        heapify(heap)
        while heap:
            rank, i = heappop(heap)
            if now[i] != rank:
                continue
            j = after[i]
            parts[i] += parts[j]
            parts[j], now[j] = "", none
            after[i] = k = after[j]
            now[i] = none
            if k >= 0:
                before[k] = i
                now[i] = ranks.get((parts[i], parts[k]), none)
                if now[i] != none:
                    heappush(heap, (now[i], i))
            h = before[i]
            if h >= 0:
                now[h] = ranks.get((parts[h], parts[i]), none)
                if now[h] != none:
                    heappush(heap, (now[h], h))
        return [p for p in parts if p]

    def _word(self, word: str) -> tuple[bytes, str]:
        """Packed ids of a word in byte letters, and their tokens with a space after each."""
        cut = self.fragments(word)
        if len(cut) == 1:
            return self._packed(self._merged(word, True))
        found = [*[self._inner[f] for f in cut[:-1]], self._last[cut[-1]]]
        return b"".join([f[0] for f in found]), "".join([f[1] for f in found])

    def _packed(self, ids: list[int]) -> tuple[bytes, str]:
        return struct.pack(f"<{len(ids)}I", *ids), "".join([self._spaced[i] for i in ids])

    def _pieces(self, text: str) -> list[str]:
        """Words of a text without special tokens, in byte letters."""
        if text.isascii():
            found = self._ascii.findall(text.lower())
            if self._control.search(text) is None:
                return found
            letters = self._letters
            return ["".join([letters[ord(c)] for c in w]) for w in found]
        if self._beyond.search(text) is None:
            # words hold no blank
            found = self._latin.findall(text.lower())
            return " ".join(found).translate(self._lettered).split(" ") if found else []
        return [w for w, _ in self._parts.pre_tokenize_str(self._normal.normalize_str(text))]

    def _found(self, text: bytes) -> list[tuple[bytes, str]]:
        """Ids and tokens of the words of a text.

        No merge, no word and no composed character reaches over ASCII white space, so a text
        is cut there into pieces that are encoded by themselves.
        """
        found: list[tuple[bytes, str]] = []
        low = 0
        while low < len(text):
            high = len(text)
            if high - low > _PIECE:
                cut = self._space.search(text, low + _PIECE)
                high = cut.start() if cut else high
            piece = text[low:high].decode("utf-8", "replace")
            for part in self._specials.split(piece) if self._opening in piece else (piece,):
                if part in self._special:
                    found.append(self._packed([self._special[part]]))
                elif part:
                    found += map(self._words.__getitem__, self._pieces(part))
            low = high
        return found

    def encode(self, text: bytes) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join([f[0] for f in self._found(text)])

    def decode(self, packed: bytes) -> str:
        """The tokens of ids with a space between them, as the vocabulary file has no decoder."""
        tokens = self.tokens
        return " ".join(tokens[int.from_bytes(packed[i : i + 4], "little")] for i in range(0, len(packed), 4))

    def both(self, text: bytes) -> tuple[bytes, str]:
        """`encode` and the `decode` of its ids, by word."""
        found = self._found(text)
        return b"".join([f[0] for f in found]), "".join([f[1] for f in found])[:-1]


def encode_documents(docs: DataFrame, path: str, column: str = "text") -> DataFrame:
    """`(doc_id, ids, decoded)` for every row; `ids` are packed as in `WordBpe.encode`.

    A NULL or empty text has no ids and decodes to an empty text. Repeated rows stay.
    """

    def run(batch: pa.RecordBatch, texts: pa.Array) -> Iterator[pa.RecordBatch]:
        coder = _coder(path)
        ids = batch.column(0)
        for low, high, data, offsets in words.steps(texts):
            raw = data.tobytes()
            done = [coder.both(raw[a:b]) for a, b in pairwise(offsets.tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(low, high - low),
                    pa.array([d[0] for d in done], pa.binary()),
                    pa.array([d[1] for d in done], pa.string()),
                ],
                names=["doc_id", "ids", "decoded"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_texts(docs, [F.col("doc_id")], run, f"doc_id {kind}, ids binary, decoded string", column)


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """`(doc_id, decoded)` from `(doc_id, ids)`; NULL ids decode to an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path)
        for batch in batches:
            texts = [coder.decode(b or b"") for b in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "decoded"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, decoded string")


_coders: dict[str, WordBpe] = {}


def _coder(path: str) -> WordBpe:
    if path not in _coders:
        _coders[path] = WordBpe(path)
    return _coders[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_bpe(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_documents(docs, default_path()).select(
        "doc_id",
        F.expr("octet_length(ids) div 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
