"""Words and their names, for many texts at once, straight from Arrow buffers.

A word is a maximal run of ``[^\\x20\\x09-\\x0D]``, unchanged.  All functions
work on one bounded chunk of an Arrow batch, so memory follows the chunk and
not the partition.

A word's name is 128 bits of BLAKE2b, in two 64-bit halves.  Names of longer
things (shingles, windows, whole texts) are made from these halves; each says
how many bits it has.  ``index`` is no hash: equal words of a chunk have equal
numbers and different words different ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 19
GOLD = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64, on a fresh array."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with at most ``limit`` bytes of text, one row at least."""
    sizes = np.asarray(pc.binary_length(batch.column(column)).fill_null(0), np.int64)
    group = np.cumsum(sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


@dataclass
class Words:
    """Words of a chunk: byte spans, exact numbers, names, and ``first[d]:first[d+1]`` per text."""

    data: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    #: Equal for equal words of this chunk, and only for them.
    index: np.ndarray
    #: The different words, by number.
    distinct: list[bytes]
    first: np.ndarray
    #: Where each text's bytes begin.
    offsets: np.ndarray

    @cached_property
    def names(self) -> np.ndarray:
        """The two halves of each word's 128-bit name, made when they are first asked for."""
        digests = b"".join([hashlib.blake2b(w, digest_size=16).digest() for w in self.distinct])
        return np.frombuffer(digests, "<u8").reshape(-1, 2)[self.index]

    @cached_property
    def hash(self) -> np.ndarray:
        return np.ascontiguousarray(self.names[:, 0])

    @cached_property
    def more(self) -> np.ndarray:
        return np.ascontiguousarray(self.names[:, 1])

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def numbered(data: np.ndarray, keep: np.ndarray, size: np.ndarray) -> pa.DictionaryArray:
    """Dictionary of byte strings: the bytes of ``data`` under ``keep``, cut into pieces of ``size``."""
    cut = np.concatenate([np.zeros(1, np.int64), np.cumsum(size, dtype=np.int64)])
    strings = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(cut), pa.py_buffer(data[keep])])
    return strings.dictionary_encode()


def words_of(column: pa.Array) -> Words:
    """Split and name; a null text has no words."""
    column = column.cast(pa.large_string()).fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    n = len(data)
    none = np.empty(0, np.int64)
    if n == 0:
        return Words(data, none, none, none, [], np.zeros(len(column) + 1, np.int64), offsets)
    inside = ~_SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | cut[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | cut[1:-1]
    begin, end = np.flatnonzero(begin), np.flatnonzero(last) + 1
    coded = numbered(data, inside, end - begin)
    index = np.asarray(coded.indices).astype(np.int64)
    return Words(data, begin, end, index, coded.dictionary.to_pylist(), np.searchsorted(begin, offsets), offsets)


def whole_hash(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each text's word sequence: BLAKE2b over its words' names, as two signed columns."""
    names = words.names
    digests = b"".join([hashlib.blake2b(names[a:b].tobytes(), digest_size=16).digest() for a, b in zip(words.first, words.first[1:])])
    both = np.frombuffer(digests, "<i8").reshape(-1, 2)
    return np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])


def run_hash(h: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """64-bit name of each ``width`` consecutive entries; ``len(h) - width + 1`` values."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, seed, np.uint64)
    for k in range(width):
        out = mix((out + GOLD) ^ h[k : k + n])
    return out


def inner_runs(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """``(text, start word)`` of each run of ``width`` words inside one text."""
    text = words.text_of
    n = max(len(text) - width + 1, 0)
    at = np.flatnonzero(text[:n] == text[width - 1 :][:n])
    return text[at], at


def grams(words: Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(text, start word, 64-bit name)`` of each run of ``width`` words inside one text."""
    text, at = inner_runs(words, width)
    return text, at, run_hash(words.hash, width)[at] if len(at) else np.empty(0, np.uint64)


def exact_grams(words: Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Like ``grams`` with exact numbers in place of names: equal runs, and only these, have equal numbers."""
    text, at = inner_runs(words, width)
    bits = max(len(words.distinct) - 1, 1).bit_length()
    number = words.index[at]
    for k in range(1, width):
        if bits * (k + 1) < 63:
            number = number << bits | words.index[at + k]
        else:
            number = np.unique(number, return_inverse=True)[1] * (len(words.distinct) + 1) + words.index[at + k]
    return text, at, number
