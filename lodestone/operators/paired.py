"""All pairs of a block in matrices: rows are dealt in lists, and a task makes the pairs of two lists.

A row crosses to Python once for each list of the other side, as plain texts;
what pairs need is reckoned there for parts of ``PART`` rows, so memory is
that of two lists and of one matrix of a part, however many pairs there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.ratios import matched_each
from ..shared import dealt

#: Rows of a list, about; rows of a part of one; different elements that are multiplied at once.
LISTED, PART, COLUMNS = 2048, 512, 4096

#: The rows of a list by column.
Rows = dict[str, pa.Array]


def listed(df: DataFrame, block: str, side: str, size: int = LISTED) -> DataFrame:
    """``(block, <side>)``: the other columns of about ``size`` rows of a block as a list of rows; null blocks are left out."""
    rows = df.select(F.col(block).alias("block"), F.struct(*(c for c in df.columns if c != block)).alias("row"), F.monotonically_increasing_id().alias("at")).filter("block is not null")
    lists = rows.groupBy("block").agg(F.ceil(F.count("*") / size).alias("lists"))
    return rows.join(F.broadcast(lists), "block").groupBy("block", F.pmod(F.xxhash64("at"), "lists").alias(f"{side}_list")).agg(F.collect_list("row").alias(side))


def made(left: DataFrame, right: DataFrame, block: str, make: Callable[[Rows, Rows], Iterator[pa.RecordBatch]], columns: str, size: int = LISTED) -> DataFrame:
    """What ``make`` gives for each list of ``left`` with each of ``right`` of the same block."""

    def rows(batch: pa.RecordBatch, side: str, k: int) -> Rows:
        part = batch.column(side)[k].values
        return {part.type.field(n).name: part.field(n) for n in range(part.type.num_fields)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield from make(rows(batch, "left", k), rows(batch, "right", k))

    met = listed(left, block, "left", size).join(listed(right, block, "right", size), "block")
    return dealt(met, "block", "left_list", "right_list").select("left", "right").mapInArrow(run, columns)


def parts(rows: Rows, by: str) -> list[Rows]:
    """Rows in the order of a text, ``PART`` at a time, so that texts of a part have much in common."""
    order = pc.sort_indices(rows[by])
    return [{c: v.take(order[a : a + PART]) for c, v in rows.items()} for a in range(0, len(order), PART)]


@lru_cache(8)
def _places(n: int, m: int) -> tuple[pa.Array, pa.Array]:
    return pa.array(np.repeat(np.arange(n), m)), pa.array(np.tile(np.arange(m), n))


def told(ids: dict[str, tuple[pa.Array, int]], columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """One row for each cell of the matrices ``columns``; ``ids`` are told by row (0) or by column (1)."""
    shape = next(iter(columns.values())).shape
    of = _places(*shape)
    return pa.RecordBatch.from_pydict({**{c: v.take(of[axis]) for c, (v, axis) in ids.items()}, **{c: pa.array(x.reshape(-1)) for c, x in columns.items()}})


#: Sets of rows: the row and the number of each different element, and how many each row has.
Sets = tuple[np.ndarray, np.ndarray, np.ndarray]


def _sets(row: np.ndarray, code: np.ndarray, n: int) -> Sets:
    if len(row):
        both = np.unique(row * (code.max() + 1) + code)
        row, code = both // (code.max() + 1), both % (code.max() + 1)
    return row, code, np.bincount(row, minlength=n)


def word_sets(left: pa.Array, right: pa.Array) -> tuple[Sets, Sets]:
    """Different words of texts that single spaces separate, numbered alike on both sides."""
    lists = pc.split_pattern(pa.concat_arrays([left, right]), " ")
    words = lists.flatten().dictionary_encode()
    row, code = np.repeat(np.arange(len(lists)), pc.list_value_length(lists)), np.asarray(words.indices, np.int64)
    some = np.asarray(pc.not_equal(words.dictionary, ""), bool)[code] if len(code) else np.zeros(0, bool)
    row, code, n = row[some], code[some], len(left)
    return _sets(row[row < n], code[row < n], n), _sets(row[row >= n] - n, code[row >= n], len(right))


def whole_sets(left: pa.Array, right: pa.Array) -> tuple[Sets, Sets]:
    """Each text as the one element of its set, numbered alike on both sides; an empty one has none."""
    texts = pa.concat_arrays([left, right])
    code, row = texts.dictionary_encode().indices.to_numpy().astype(np.int64), np.flatnonzero(np.asarray(pc.binary_length(texts)) > 0)
    a, b, n = row[row < len(left)], row[row >= len(left)], len(left)
    return _sets(a, code[a], n), _sets(b - n, code[b], len(right))


def gram_sets(texts: pa.Array, short: bool) -> Sets:
    """Different runs of three characters of texts of ASCII; shorter ones are a run of their own if ``short``, or have none."""
    size = np.asarray(pc.binary_length(texts), np.int64)
    end = np.cumsum(size)
    b = np.frombuffer("".join(texts.to_pylist()).encode(), np.uint8).astype(np.int64)
    runs = np.maximum(size - 2, 0)
    row = np.repeat(np.arange(len(size)), runs)
    at = np.arange(len(row)) + (end - size - np.cumsum(runs) + runs)[row]
    code = (b[at] << 16) | (b[at + 1] << 8) | b[at + 2]
    for n in (1, 2) if short else ():
        k = np.flatnonzero(size == n)
        row = np.concatenate([row, k])
        code = np.concatenate([code, b[end[k] - 1] if n == 1 else (b[end[k] - 2] << 8) | b[end[k] - 1]])
    return _sets(row, code, len(size))


def common(left: Sets, right: Sets) -> np.ndarray:
    """How many elements each row of ``left`` has in common with each of ``right``."""
    out = np.zeros((len(left[2]), len(right[2])), np.float32)
    shared = np.intersect1d(left[1], right[1])
    for a in range(0, len(shared), COLUMNS):
        some = shared[a : a + COLUMNS]
        x, y = (np.zeros((len(n), len(some)), np.float32) for n in (left[2], right[2]))
        for m, (row, code, _) in ((x, left), (y, right)):
            at = np.minimum(np.searchsorted(some, code), len(some) - 1)
            hit = some[at] == code
            m[row[hit], at[hit]] = 1
        out += x @ y.T
    return out.astype(np.int32)


def jaccard(both: np.ndarray, left: Sets, right: Sets) -> tuple[np.ndarray, np.ndarray]:
    """Numerator and denominator of the overlap over the union; 0 over 1 where one is empty."""
    return both, np.maximum(left[2].astype(np.int32)[:, None] + right[2].astype(np.int32)[None, :] - both, 1)


def containment(both: np.ndarray, left: Sets, right: Sets) -> tuple[np.ndarray, np.ndarray]:
    """Numerator and denominator of the overlap over the smaller set; 0 over 1 where one is empty."""
    return both, np.maximum(np.minimum(left[2].astype(np.int32)[:, None], right[2].astype(np.int32)[None, :]), 1)


def share(part: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return part[0] / part[1]


#: Kinds of a matrix that are looked up by their number.
KINDS = 1 << 22


def each_kind(over: np.ndarray, under: np.ndarray, f: Callable[[int, int], float]) -> np.ndarray:
    """``f(over, under)``, taken once for each different pair of numbers."""
    wide = int(under.max(initial=0)) + 1
    number = (int(over.max(initial=0)) + 1) * wide
    if number > KINDS:
        kinds, at = np.unique(over.astype(np.int64) * wide + under, return_inverse=True)
        return np.array([f(int(k) // wide, int(k) % wide) for k in kinds])[at].reshape(over.shape)
    code = over * np.int32(wide) + under
    seen = np.zeros(number, bool)
    seen[code] = True
    table = np.zeros(number)
    kinds = np.flatnonzero(seen)
    table[kinds] = [f(int(k) // wide, int(k) % wide) for k in kinds]
    return table[code]


@lru_cache(1 << 16)
def rounded(over: int, under: int, digits: int) -> float:
    """The quotient as Spark rounds it: half up by its decimal digits."""
    return float(Decimal(repr(over / under)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


#: Share of the pairs of two lists that may be looked at one by one; pairs of classes that are counted at once.
SINGLE, CLASSES = 1 / 32, 1 << 20


def _size_classes(families: list[tuple[Sets, Sets]], side: int) -> tuple[np.ndarray, np.ndarray]:
    """Different rows of the sizes of a side's sets, and the number of each row's."""
    sizes, at = np.unique(np.stack([f[side][2] for f in families], axis=1), axis=0, return_inverse=True)
    return sizes, at.ravel()


def counted(families: list[tuple[Sets, Sets]], marks: tuple[np.ndarray, np.ndarray], times: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """How many pairs of rows have which sizes and common elements in each of some families of sets, without a look at most of them.

    Elements that few pairs share are rare: ``SINGLE`` of the pairs share one
    and are looked at one by one.  All other pairs are those of classes of
    rows, equal in their sizes and frequent elements, and are counted as
    products.  A row counts ``times``; marks are numbers, and below 0 if they
    are missing.  Gives, for each kind of pair, the sizes on both sides and the
    common elements by family, the pairs with equal marks and with different
    ones.
    """
    n, m = len(marks[0]), len(marks[1])
    sizes, size_class = zip(*(_size_classes(families, side) for side in (0, 1)))
    family, rows, elements, number = [], ([], []), ([], []), 0
    for f, both in enumerate(families):
        shared = np.intersect1d(both[0][1], both[1][1])
        for side in (0, 1) if len(shared) else ():
            row, code, _ = both[side]
            at = np.minimum(np.searchsorted(shared, code), len(shared) - 1)
            hit = shared[at] == code
            rows[side].append(row[hit])
            elements[side].append(at[hit] + number)
        family.append(np.full(len(shared), f))
        number += len(shared)
    family = np.concatenate(family)
    rows, elements = ([np.concatenate([np.zeros(0, np.int64), *x]) for x in part] for part in (rows, elements))
    of = [np.bincount(e, minlength=number) for e in elements]
    order = np.argsort(of[0] * of[1], kind="stable")
    rare = np.zeros(number, bool)
    rare[order[np.cumsum((of[0] * of[1])[order]) <= SINGLE * n * m]] = True

    # classes of rows: sizes and frequent elements
    frequent = np.cumsum(~rare) - 1
    has, class_of, first = [], [], []
    for side, count in ((0, n), (1, m)):
        x = np.zeros((count, int((~rare).sum())), bool)
        often = ~rare[elements[side]]
        x[rows[side][often], frequent[elements[side][often]]] = True
        told = np.ascontiguousarray(np.concatenate([size_class[side].astype("<i4")[:, None].view(np.uint8), np.packbits(x, axis=1)], axis=1))
        _, at, kind = np.unique(told.view(np.dtype((np.void, told.shape[1]))).ravel(), return_index=True, return_inverse=True)
        has.append(x[at])
        class_of.append(kind.ravel())
        first.append(at)
    many = [len(f) for f in first]
    n_marks = max(int(max(x.max(initial=-1) for x in marks)) + 1, 1)
    weight = []
    for side in (0, 1):
        known = marks[side] >= 0
        weight.append(np.bincount(class_of[side][known] * n_marks + marks[side][known], weights=times[side][known], minlength=many[side] * n_marks).reshape(many[side], n_marks))

    # pairs that share a rare element
    entries = []
    for side in (0, 1):
        some = rare[elements[side]]
        by = np.argsort(elements[side][some], kind="stable")
        entries.append((rows[side][some][by], elements[side][some][by]))
    (x, e), (y, g) = entries
    begin, wide = np.searchsorted(g, e), of[1][e]
    pair = np.repeat(x * m, wide) + y[np.repeat(begin - np.cumsum(wide) + wide, wide) + np.arange(wide.sum())]
    shares = np.repeat(family[e], wide)
    seen = np.zeros(n * m, bool)
    seen[pair] = True
    single = np.flatnonzero(seen)
    place = np.empty(n * m, np.int32)
    place[single] = np.arange(len(single), dtype=np.int32)
    i, j = single // m, single % m
    alone = [np.bincount(place[pair[shares == f]], minlength=len(single)).astype(np.int32) for f in range(len(families))]
    w = np.where((marks[0][i] >= 0) & (marks[1][j] >= 0), times[0][i] * times[1][j], 0)
    equal = marks[0][i] == marks[1][j]

    def summed(left_size: np.ndarray, right_size: np.ndarray, both: list[np.ndarray], hits: np.ndarray, misses: np.ndarray) -> tuple[np.ndarray, ...]:
        code, kinds = left_size * len(sizes[1]) + right_size, len(sizes[0]) * len(sizes[1])
        for x in both:
            wide = int(x.max(initial=0)) + 1
            code, kinds = code * wide + x, kinds * wide
            if kinds > KINDS:
                known, code = np.unique(code, return_inverse=True)
                code, kinds = code.ravel(), len(known)
        at = np.full(kinds, -1, np.int64)
        at[code] = np.arange(len(code))
        some = np.flatnonzero(at >= 0)
        add = lambda v: np.rint(np.bincount(code, weights=v, minlength=kinds)[some]).astype(np.int64)
        at = at[some]
        return sizes[0][left_size[at]], sizes[1][right_size[at]], np.stack([x[at] for x in both], axis=1), add(hits), add(misses)

    def dense(f: int, part: slice) -> np.ndarray:
        columns, out = np.flatnonzero(family[~rare] == f), np.zeros((len(has[0][part]), many[1]), np.float32)
        for c in range(0, len(columns), COLUMNS):
            x, y = (v[:, columns[c : c + COLUMNS]].astype(np.float32) for v in (has[0][part], has[1]))
            out += x @ y.T
        return out.astype(np.int32)

    of_class, n_rows = [size_class[side][first[side]] for side in (0, 1)], [np.bincount(c) for c in class_of]
    step = max(CLASSES // many[1], 1)
    by = np.argsort(class_of[0][i], kind="stable") if many[0] > step else np.arange(len(i))
    ends = np.searchsorted(class_of[0][i[by]], np.arange(step, many[0], step)).tolist() if many[0] > step else []
    out = []
    for at, one in zip(range(0, many[0], step), np.split(by, ends)):
        part = slice(at, at + step)
        both = [dense(f, part) for f in range(len(families))]
        hits = weight[0][part] @ weight[1].T
        misses = np.outer(weight[0][part].sum(axis=1), weight[1].sum(axis=1)) - hits
        a, b = class_of[0][i[one]] - at, class_of[1][j[one]]
        own = [x[a, b] + y[one] for x, y in zip(both, alone)]
        own_hits, own_misses = w[one] * equal[one], w[one] * ~equal[one]
        less = lambda weights: np.bincount(a * many[1] + b, weights=weights, minlength=hits.size).reshape(hits.shape)  # noqa: B023, E731
        rest = np.outer(n_rows[0][part], n_rows[1]) > less(None)
        x, y = np.nonzero(rest)
        out.append(summed(of_class[0][at + x], of_class[1][y], [v[rest] for v in both], (hits - less(own_hits))[rest], (misses - less(own_misses))[rest]))
        out.append(summed(size_class[0][i[one]], size_class[1][j[one]], own, own_hits, own_misses))
    return tuple(np.concatenate(x) for x in zip(*out))


def title_texts(c: Column | str) -> dict[str, Column]:
    """``words`` and ``letters`` of a title, for ``set_features``."""
    return {"words": F.array_join(T.tokens(c), " "), "letters": F.regexp_replace(T.fold(c), "[^a-z0-9]+", "")}


def set_features(left: DataFrame, right: DataFrame, block: str, left_id: str, right_id: str, digits: int) -> DataFrame:
    """``(left_id, right_id, title_word, title_char, title_containment)`` of every pair of a block, rounded.

    Both sides have the block, their id, ``words`` with single spaces between
    them, and ``letters``, whose runs of three are compared; both are ASCII.
    """
    round_ = lambda part: each_kind(*part, lambda a, b: rounded(a, b, digits))

    def make(a: Rows, b: Rows) -> Iterator[pa.RecordBatch]:
        others = [(r, gram_sets(r["letters"], True)) for r in parts(b, "letters")]
        for x in parts(a, "letters"):
            gx = gram_sets(x["letters"], True)
            for y, gy in others:
                wx, wy = word_sets(x["words"], y["words"])
                words = common(wx, wy)
                features = {"title_word": round_(jaccard(words, wx, wy)), "title_char": round_(jaccard(common(gx, gy), gx, gy)), "title_containment": round_(containment(words, wx, wy))}
                yield told({left_id: (x[left_id], 0), right_id: (y[right_id], 1)}, features)

    types = {**dict(left.dtypes), **dict(right.dtypes)}
    return made(left, right, block, make, f"{left_id} {types[left_id]}, {right_id} {types[right_id]}, title_word double, title_char double, title_containment double")


def sequence_ratios(left: DataFrame, right: DataFrame, block: str, left_key: tuple[str, str], right_key: tuple[str, str], digits: int) -> DataFrame:
    """``(right_id, left_id, ratio)`` of every pair of a block, rounded: the ratio of matching blocks as ``matching.sequence_ratio`` has it.

    A key names the columns of the id and of the text; a null text is empty.
    """
    (left_id, left_text), (right_id, right_text) = left_key, right_key

    def of(rows: Rows, text: str) -> tuple[list[str], np.ndarray]:
        texts = [t or "" for t in rows[text].to_pylist()]
        return texts, np.fromiter(map(len, texts), np.int32, len(texts))

    def make(a: Rows, b: Rows) -> Iterator[pa.RecordBatch]:
        others = [(r, *of(r, right_text)) for r in parts(b, right_text)]
        for x in parts(a, left_text):
            texts, size = of(x, left_text)
            for y, other_texts, other_size in others:
                ratio = each_kind(matched_each(texts, other_texts), size[:, None] + other_size[None, :], lambda m, n: rounded(2 * m, n, digits) if n else 1.0)
                yield told({right_id: (y[right_id], 1), left_id: (x[left_id], 0)}, {"ratio": ratio})

    types = {**dict(left.dtypes), **dict(right.dtypes)}
    return made(left, right, block, make, f"{right_id} {types[right_id]}, {left_id} {types[left_id]}, ratio double")
