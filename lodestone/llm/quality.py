"""Quality scores by a generalised additive model with pairwise interactions.

Counts of a text become features; each feature is cut into quantile bins.
Boosting cycles through the features, and each step fits a tree of at most
four leaves over one feature's bins to the gradient, at a small learning
rate, so that the sum over all steps is one lookup table for each feature.
The pairs that explain most of what is left get tables over two coarser
binnings in the same way.  A score is the sum of looked-up values.

The model is fitted on a bounded sample of labelled rows; every document is
scored, a batch at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled
from .stats import COUNTS, text_stats
from lodestone.shared import written
from .words import chunks

FEATURES = ["length", "word_length", "symbols", "repeats", "dup_lines", "line_length", "upper", "digits", "exclaims", "stops", "commas", "distinct", "top_word", "marked"]
BINS, COARSE, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE, LEAST_LEAF = 300, 100, 0.1, 5


def features(counts: np.ndarray) -> np.ndarray:
    c = {k: counts[:, i].astype(float) for i, k in enumerate(COUNTS)}
    n, chars, lines = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1), np.maximum(c["n_lines"], 1)
    return np.column_stack([
        np.log1p(c["n_words"]), c["word_chars"] / n, c["n_symbols"] / chars, c["n_repeat_words"] / n, c["n_dup_lines"] / lines, np.log1p(c["n_words"] / lines), c["n_upper"] / chars,
        c["n_digits"] / chars, c["n_exclaim"] / n, c["n_stops"] / n, c["n_commas"] / n, c["n_distinct"] / n, c["n_top_word"] / n, c["n_marked"] / n,
    ])


def _cut(gain_of, sums: tuple[np.ndarray, np.ndarray, np.ndarray]) -> int:
    """Best split of bins into ``[0, k)`` and the rest; 0 for none."""
    g, h, n = (np.cumsum(s) for s in sums)
    if len(g) < 2:
        return 0
    left, right = (g[:-1], h[:-1], n[:-1]), (g[-1] - g[:-1], h[-1] - h[:-1], n[-1] - n[:-1])
    gain = gain_of(left[0], left[1]) + gain_of(right[0], right[1]) - gain_of(g[-1], h[-1])
    gain[(left[2] < LEAST_LEAF) | (right[2] < LEAST_LEAF)] = 0
    k = int(gain.argmax())
    return k + 1 if gain[k] > 1e-9 else 0


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, depth: int = 2) -> np.ndarray:
    """Values over bins of a tree of ``2**depth`` leaves at most."""
    gain_of = lambda a, b: a * a / (b + 1.0)
    k = _cut(gain_of, (g, h, n)) if depth else 0
    if not k:
        return np.full(len(g), -g.sum() / (h.sum() + 1.0))
    return np.concatenate([_tree(g[:k], h[:k], n[:k], depth - 1), _tree(g[k:], h[k:], n[k:], depth - 1)])


def _table2(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
    """Values over a grid split once by rows and, in each part, once by columns; and their gain."""
    gain_of = lambda a, b: a * a / (b + 1.0)
    best, out = -1.0, np.zeros_like(g)
    for k in range(1, len(g)):
        values, gain = np.zeros_like(g), 0.0
        for rows in (slice(0, k), slice(k, len(g))):
            a, b, c = g[rows].sum(axis=0), h[rows].sum(axis=0), n[rows].sum(axis=0)
            row = _tree(a, b, c, 1)
            values[rows] = row
            gain += -(a * row).sum() - 0.5 * ((b + 1e-9) * row * row).sum()
        if gain > best:
            best, out = gain, values
    return out, best


@dataclass
class Additive:
    """Bin edges and lookup tables."""

    edges: list[np.ndarray]
    coarse: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    grids: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for k, (e, t) in enumerate(zip(self.edges, self.tables)):
            total += t[np.searchsorted(e, x[:, k], side="right")]
        for (a, b), grid in zip(self.pairs, self.grids):
            total += grid[np.searchsorted(self.coarse[a], x[:, a], side="right"), np.searchsorted(self.coarse[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-total))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def fit(x: np.ndarray, y: np.ndarray) -> Additive:
    d = x.shape[1]
    edges, coarse = [_edges(x[:, k], BINS) for k in range(d)], [_edges(x[:, k], COARSE) for k in range(d)]
    at = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(edges)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    rate = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(rate / (1 - rate)))
    total = np.full(len(y), base)
    slope = lambda: (p := 1 / (1 + np.exp(-total)), p - y, p * (1 - p))[1:]
    for _ in range(ROUNDS):
        for k in range(d):
            g, h = slope()
            size = len(tables[k])
            step = RATE * _tree(np.bincount(at[k], g, size), np.bincount(at[k], h, size), np.bincount(at[k], minlength=size))
            tables[k] += step
            total += step[at[k]]
    at2 = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(coarse)]

    def grid(a: int, b: int):
        g, h = slope()
        shape = len(coarse[a]) + 1, len(coarse[b]) + 1
        cell = at2[a] * shape[1] + at2[b]
        size = shape[0] * shape[1]
        return cell, *_table2(*(np.bincount(cell, w, size).reshape(shape) for w in (g, h, np.ones(len(y)))))

    pairs = sorted(combinations([k for k in range(d) if len(coarse[k])], 2), key=lambda p: -grid(*p)[2])[:PAIRS]
    grids = [np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1)) for a, b in pairs]
    for _ in range(PAIR_ROUNDS):
        for k, (a, b) in enumerate(pairs):
            cell, values, _ = grid(a, b)
            grids[k] += RATE * values
            total += RATE * values.reshape(-1)[cell]
    return Additive(edges, coarse, tables, pairs, grids, base)


def counted(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                counts = text_stats(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(np.ascontiguousarray(counts[:, k])) for k in range(len(COUNTS)))], names=["doc_id", *COUNTS])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row of ``docs``.

    Null and empty texts are scored as texts of no words.  Without any label
    that may be learned from every score is 0.5; an empty table gives an
    empty result.  Rows that repeat an id are scored one by one; one of them at
    most is learned from, that of least counts.  Rows with a null id have no
    label; labels other than 0 and 1, null ones too, are no labels.
    """
    counts = written(counted(docs, id_col, text_col), "counts")
    chosen = written(labelled.sample(labels, label), "sample")  # bounded: SAMPLE rows
    known = counts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct(*COUNTS)).alias("r"))
    rows = known.select("r.*", "y").toPandas()  # bounded: one row for each id of the sample
    model = fit(features(rows[COUNTS].to_numpy()), rows["y"].to_numpy(float)) if len(rows) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(np.column_stack([np.asarray(batch.column(c)) for c in COUNTS]))
            s = model.score(x) if model else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    out = counts.mapInArrow(run, "doc_id long, score double, predicted int")
    return out.select("doc_id", labelled.held_out().alias("held_out"), "score", "predicted")
