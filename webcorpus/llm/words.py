"""Words of whole Arrow batches as numpy arrays: positions and 64-bit hashes, no loop over words.

A batch of texts is one byte buffer with row offsets. Words are maximal runs of bytes that
a table marks as word bytes; a row boundary always ends a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that one step works on, unless a single text is longer.
STEP_BYTES = 2 << 20
#: Rows of a step.
STEP_ROWS = 1 << 16
#: Bytes whose prefix hashes are held at once.
_BLOCK = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_LENGTH = np.uint64(0xD6E8FEB86659FD93)
#: Odd multipliers of the positions inside a run of words.
_PLACES = np.array(
    [pow(0xA0761D6478BD642F, i + 1, 1 << 64) for i in range(64)], dtype=np.uint64
)
_tables: dict[str, np.ndarray] = {}

#: Any byte but the ASCII white space 09-0D and 20.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: ASCII digits and letters, and every byte from 80 on.
ALPHANUMERIC = np.zeros(256, dtype=bool)
ALPHANUMERIC[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Any byte but the line feed.
LINES = np.ones(256, dtype=bool)
LINES[0x0A] = False
#: Byte to byte: A-Z to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


@dataclass
class Words:
    """Words of consecutive rows. `first[i]:first[i + 1]` are those of row `i`."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def rows(self) -> np.ndarray:
        """Row number of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        return hash_spans(self.data, self.starts, self.ends)


def mixed(values: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over all others."""
    x = values ^ (values >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(name: str, base: int, size: int) -> np.ndarray:
    table = _tables.get(name)
    if table is None or len(table) < size:
        table = np.full(size, base, dtype=np.uint64)
        table[0] = 1
        table = _tables[name] = np.multiply.accumulate(table)
    return table


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each of the sorted, disjoint byte spans; equal bytes, equal hash."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        low = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, low + _BLOCK, "right")))
        size = int(ends[j - 1]) - low
        prefix = np.zeros(size + 1, dtype=np.uint64)
        values = data[low : low + size].astype(np.uint64)
        values += np.uint64(1)
        values *= _powers("up", _BASE, max(size, _BLOCK))[:size]
        np.cumsum(values, out=prefix[1:])
        s, e = starts[i:j] - low, ends[i:j] - low
        raw = (prefix[e] - prefix[s]) * _powers("down", _BASE_INVERSE, max(size, _BLOCK) + 1)[s]
        out[i:j] = mixed(raw + (e - s).astype(np.uint64) * _LENGTH)
        i = j
    return out


def run_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every `size` consecutive values (over row boundaries, too)."""
    count = max(0, len(hashes) - size + 1)
    out = np.zeros(count, dtype=np.uint64)
    for k in range(size):
        out += hashes[k : k + count] * _PLACES[k]
    return mixed(out)


def split(data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray = SPACED) -> Words:
    """The words of the rows `data[offsets[i]:offsets[i + 1]]`; offsets start at 0."""
    size = len(data)
    is_word = np.zeros(size + 2, dtype=bool)
    is_word[1:-1] = word_bytes[data]
    starts = is_word[1:] & ~is_word[:-1]
    ends = is_word[:-1] & ~is_word[1:]
    inner = offsets[(offsets > 0) & (offsets < size)]
    cut = inner[is_word[inner] & is_word[inner + 1]]
    starts[cut] = True
    ends[cut] = True
    at, to = np.flatnonzero(starts), np.flatnonzero(ends)
    return Words(data, at, to, np.searchsorted(at, offsets))


def steps(column: pa.Array, limit: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts a binary column into runs of rows: `(from row, to row, bytes, offsets from 0)`.

    A run has at most `limit` bytes and `STEP_ROWS` rows, or one row. NULL rows must have
    been replaced before.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    _, offset_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offset_buffer, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data_buffer, dtype=np.uint8) if data_buffer else np.empty(0, np.uint8)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, min(i + STEP_ROWS, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1))
        own = offsets[i : j + 1] - offsets[i]
        yield i, j, data[offsets[i] : offsets[j]], own
        i = j
