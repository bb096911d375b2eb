"""The ratio of matching blocks of many pairs of texts at once, as Python's ``difflib`` has it.

Pairs are taken in blocks of similar lengths.  The longest common run of all
pairs of a block is found by one walk over the characters of the left texts,
with the runs that end at each character of the right texts as a matrix; what
is left and right of the runs are the pairs of the next round.
"""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np

#: Longest text of a block, and pairs of a block; longer texts are compared one by one.
LONGEST, BLOCK = 120, 2048


def _codes(texts: list[str]) -> np.ndarray:
    """Code points, one row for each text, filled up with zeros."""
    a = np.array(texts, dtype=np.str_)
    return a.view(np.uint32).reshape(len(texts), -1) if a.dtype.itemsize else np.zeros((len(texts), 1), np.uint32)


def _cut(codes: np.ndarray, start: np.ndarray, size: np.ndarray, fill: int) -> np.ndarray:
    """Columns of the runs of characters at ``start``, as many rows as the longest has, filled up with ``fill``."""
    at = np.arange(size.max())[:, None]
    return np.where(at < size, codes[np.minimum(start + at, codes.shape[0] - 1), np.arange(codes.shape[1])], codes.dtype.type(fill))


def _longest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Length and both starts of the longest common run of each column; of equal ones the first in ``a``, then in ``b``."""
    q, n = b.shape
    # 128 for each character of the run that ends here, plus what a place further left is worth
    run, nearer = np.zeros((q + 1, n), np.int16), np.arange(q - 1, -1, -1, dtype=np.int16)[:, None]
    best, end = np.full(n, 127, np.int32), np.zeros(n, np.int32)
    for i in range(len(a)):
        run[1:] = (run[:-1] + np.int16(128)) * (b == a[i])
        top = (run[1:] + nearer).max(axis=0)
        better = top >> 7 > best >> 7
        best[better], end[better] = top[better], i
    size = np.where(best < 128, 0, best >> 7)
    return size, end - size + 1, q - (best & 127) - size


def _matched(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Characters in matching blocks of each column."""
    out, pair = np.zeros(len(n), np.int64), np.arange(len(n))
    i, j = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
    while len(pair):
        size, x, y = _longest(_cut(a[:, pair], i, n, 0), _cut(b[:, pair], j, m, 1))
        out += np.bincount(pair, weights=size, minlength=len(out)).astype(np.int64)
        some = size > 0
        left = some & (x > 0) & (y > 0)
        right = some & (x + size < n) & (y + size < m)
        after = lambda v, w: (v + w + size)[right]
        pair, i, j, n, m = (
            np.concatenate([pair[left], pair[right]]), np.concatenate([i[left], after(i, x)]), np.concatenate([j[left], after(j, y)]),
            np.concatenate([x[left], (n - x - size)[right]]), np.concatenate([y[left], (m - y - size)[right]]),
        )
    return out


def ratios(left: list[str], right: list[str]) -> np.ndarray:
    """Ratio of each pair; two empty texts are equal."""
    n, m = (np.fromiter(map(len, t), np.int64, len(t)) for t in (left, right))
    out = np.where(n + m == 0, 1.0, 0.0)
    known: dict[tuple[str, str], float] = {}
    matcher = SequenceMatcher(None)
    # the matcher prepares its second string, so pairs of one go together
    for k in sorted(np.flatnonzero((n > LONGEST) | (m > LONGEST)), key=lambda k: right[k]):
        x, y = left[k], right[k]
        if (x, y) not in known:
            if matcher.b != y:
                matcher.set_seq2(y)
            matcher.set_seq1(x)
            known[x, y] = 1.0 if x == y else matcher.ratio()
        out[k] = known[x, y]
    short = np.flatnonzero((n > 0) & (m > 0) & (n <= LONGEST) & (m <= LONGEST))
    short = short[np.lexsort((m[short], n[short]))]
    for at in range(0, len(short), BLOCK):
        k = short[at : at + BLOCK]
        a, b = _codes([left[x] for x in k]), _codes([right[x] for x in k])
        # zero and one fill up short texts, so characters begin at two
        kind = np.uint8 if max(a.max(), b.max()) < 254 else np.uint32
        a, b = ((c + np.uint32(2)).astype(kind).T.copy() for c in (a, b))
        out[k] = 2.0 * _matched(a, b, n[k], m[k]) / (n[k] + m[k])
    return out


#: Longest text whose places are the bits of a number, bits of the number of a remembered pattern.
PLACES, REMEMBERED = 64, 21


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """Numbers of 64 bits spread by their value and ``seed``; 0 stays 0."""
    y = x + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        y = (y ^ (y >> np.uint64(shift))) * np.uint64(by)
    return np.where(x == 0, np.uint64(0), y ^ (y >> np.uint64(31)))


@lru_cache(1)
def _remembered() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both names of patterns and their matched characters, by the first bits of the first name; for the life of a worker."""
    size = 1 << REMEMBERED
    # the name at place 0 is one that belongs elsewhere, or zeros would be a pattern that is known
    return np.append(np.uint64(2**64 - 1), np.zeros(size - 1, np.uint64)), np.zeros(size, np.uint64), np.zeros(size, np.int16)


def _patterns(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two names of 64 bits of where each row of ``a`` has which characters of each row of ``b``; zeros are no characters.

    What matches depends on these places alone, not on the characters.
    """
    chars = np.intersect1d(a, b)
    chars = chars[chars > 0]
    names = np.zeros((2, len(a), len(b)), np.uint64)
    if not len(chars):
        return names[0], names[1]
    number = lambda codes: np.where(chars[k := np.minimum(np.searchsorted(chars, codes), len(chars) - 1)] == codes, k, len(chars))
    places = np.zeros((len(chars) + 1, len(b)), np.uint64)
    for p in range(b.shape[1]):
        places[number(b[:, p]), np.arange(len(b))] |= np.uint64(1 << p)
    places[-1] = 0
    for p in range(a.shape[1]):
        at = number(a[:, p])
        for k in range(2):
            spread = _mixed(places, 2 * p + k + 1)
            if (at == at[0]).all():
                names[k] += spread[at[0]]
            else:
                names[k] += spread[at]
    return names[0], names[1]


def _matched_each(left: list[str], right: list[str]) -> np.ndarray:
    """Characters in matching blocks of each of ``left`` with each of ``right``, all of them of 1 to ``PLACES`` characters.

    Pairs of one pattern are compared once and remembered.
    """
    a, b = _codes(left), _codes(right)
    n, m = (np.fromiter(map(len, t), np.int64, len(t)) for t in (left, right))
    first, second = (x.ravel() for x in _patterns(*(np.where(np.arange(c.shape[1]) < size[:, None], c + np.uint32(1), np.uint32(0)) for c, size in ((a, n), (b, m)))))
    names, checks, matched = _remembered()
    slot = (first >> np.uint64(64 - REMEMBERED)).astype(np.int32)
    out = matched[slot]
    new = np.flatnonzero((names[slot] != first) | (checks[slot] != second))
    if len(new):
        _, rep, kind = np.unique(first[new], return_index=True, return_inverse=True)
        rep = new[rep]
        alike = second[new] == second[rep[kind]]  # or else one first name has two second ones, which is not to be expected
        some = np.concatenate([rep, new[~alike]])
        some = some[np.lexsort((m[some % len(m)], n[some // len(m)]))]
        # zero and one fill up short texts, so characters begin at two
        small = np.uint8 if max(a.max(), b.max()) < 254 else np.uint32
        x, y = ((c + np.uint32(2)).astype(small).T.copy() for c in (a, b))
        for at in range(0, len(some), BLOCK):
            k = some[at : at + BLOCK]
            i, j = k // len(m), k % len(m)
            out[k] = _matched(x[:, i], y[:, j], n[i], m[j])
        out[new[alike]] = out[rep[kind[alike]]]
        names[slot[rep]], checks[slot[rep]], matched[slot[rep]] = first[rep], second[rep], out[rep]
    return out.reshape(len(left), len(right))


def matched_each(left: list[str], right: list[str]) -> np.ndarray:
    """Characters in matching blocks of each of ``left`` with each of ``right``."""
    out = np.zeros((len(left), len(right)), np.int32)
    size = lambda t: np.fromiter(map(len, t), np.int64, len(t))
    n, m = size(left), size(right)
    i, j = np.flatnonzero((n > 0) & (n <= PLACES)), np.flatnonzero((m > 0) & (m <= PLACES))
    if len(i) and len(j):
        out[np.ix_(i, j)] = _matched_each([left[k] for k in i], [right[k] for k in j])
    for k in np.flatnonzero(n > PLACES):
        whole = ratios([left[k]] * len(right), right) * (n[k] + m) / 2
        out[k] = np.rint(whole)
    for k in np.flatnonzero(m > PLACES):
        rest = np.flatnonzero(n <= PLACES)
        out[rest, k] = np.rint(ratios([left[r] for r in rest], [right[k]] * len(rest)) * (n[rest] + m[k]) / 2)
    return out
