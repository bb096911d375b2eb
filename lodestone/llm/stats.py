"""Counts about whole texts, for the quality operators; one vectorised pass over a chunk.

Words, lines and word runs are compared as they are, not by hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .words import Words, exact_grams, numbered, words_of

#: Counts of ``text_stats``, in order.
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_exclaim", "n_stops", "n_commas", "n_distinct", "n_top_word", "n_marked"]
REPEAT = 3


def _among(characters: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[[ord(c) for c in characters]] = True
    return table


_SYMBOL, _UPPER, _DIGIT = _among("#*$%&|<>"), _among("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _among("0123456789")


def _per_text(words: Words, hit: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(hit, dtype=np.int64)])
    return total[words.offsets[1:]] - total[words.offsets[:-1]]


def _groups(text: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sort order by (text, h), start of each group in it, size of each group."""
    order = np.lexsort((h, text))
    t, x = text[order], h[order]
    new = np.ones(len(order), bool)
    new[1:] = (x[1:] != x[:-1]) | (t[1:] != t[:-1])
    at = np.flatnonzero(new)
    return order, at, np.diff(np.append(at, len(order)))


def text_stats(column: pa.Array) -> np.ndarray:
    """One row of ``COUNTS`` for each text; a null text is empty."""
    words = words_of(column)
    n, data, text = len(column), words.data, words.text_of
    out = np.zeros((n, len(COUNTS)), np.int64)
    if not len(words.index):
        return out
    put = lambda name, x: out.__setitem__((slice(None), COUNTS.index(name)), x)
    put("n_words", np.diff(words.first))
    lead = (data & 0xC0) != 0x80
    space = (data == 32) | ((data >= 9) & (data <= 13))
    put("word_chars", _per_text(words, lead & ~space))
    for name, hit in (("n_symbols", _SYMBOL[data]), ("n_upper", _UPPER[data]), ("n_digits", _DIGIT[data]), ("n_exclaim", data == 33), ("n_stops", data == 46), ("n_commas", data == 44)):
        put(name, _per_text(words, hit))
    ends_odd = _SYMBOL[data[words.end - 1]] | (data[words.end - 1] == 33)
    put("n_marked", np.bincount(text[ends_odd], minlength=n))

    order, at, size = _groups(text, words.index)
    owner = text[order[at]]
    put("n_distinct", np.bincount(owner, minlength=n))
    top = np.zeros(n, np.int64)
    np.maximum.at(top, owner, size)
    put("n_top_word", top)

    # lines: cut at \n and at the ends of texts; those without a word do not count
    cut = np.union1d(words.offsets, np.flatnonzero(data == 10) + 1)
    begin, end = cut[:-1], cut[1:]
    end = end - ((end > begin) & (data[np.maximum(end, 1) - 1] == 10))
    worded = np.searchsorted(words.begin, end) > np.searchsorted(words.begin, begin)
    begin, end = begin[worded], end[worded]
    line_text = np.searchsorted(words.offsets, begin, side="right") - 1
    lines = np.bincount(line_text, minlength=n)
    kept = np.zeros(len(data) + 1, np.int64)
    np.add.at(kept, begin, 1)
    np.add.at(kept, end, -1)
    number = np.asarray(numbered(data, np.cumsum(kept)[:-1] > 0, end - begin).indices)
    order, at, _ = _groups(line_text, number)
    put("n_lines", lines)
    put("n_dup_lines", lines - np.bincount(line_text[order[at]], minlength=n))

    gram_text, gram_at, h = exact_grams(words, REPEAT)
    if len(h):
        order, at, size = _groups(gram_text, h)
        twice = np.repeat(size > 1, size)
        cover = np.zeros(len(words.index) + REPEAT + 1, np.int64)
        where = gram_at[order[twice]]
        np.add.at(cover, where, 1)
        np.add.at(cover, where + REPEAT, -1)
        put("n_repeat_words", np.bincount(text[np.cumsum(cover)[: len(text)] > 0], minlength=n))
    return out
