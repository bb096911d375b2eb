"""Lexical scores of documents for a stated query set, from one pass over the texts.

``Lexical`` finds the words that any query asks for, as numbers, in the row of
each document, and writes these rows once; no word is shuffled.  Everything
else reads that table: statistics, BM25 for any number of settings at once,
shares of query words, judgements, and scores of stated pairs.  A task puts a
block of documents against a block of queries and sends on the best ``k`` of
each query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from ..functions import text as T
from ..shared import written

DIGITS = 6
#: Documents and queries of a block.
BLOCK, QUERIES = 1024, 1024
#: Terms of a stated query set that are held by every task at most; beyond it, a query set must be asked in parts.
MOST_TERMS = 1 << 20


def head(query_ids: np.ndarray, doc_ids: np.ndarray, scores: np.ndarray, k: int, usable: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(query id, document id, score)`` of the best ``k`` usable documents of each row of ``scores``, by score and then id."""
    scores = np.where(usable, scores, -np.inf)
    if scores.shape[1] > k:
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        q, d = np.nonzero((scores >= least[:, None]) & np.isfinite(scores))
    else:
        q, d = np.nonzero(np.isfinite(scores))
    order = np.lexsort((doc_ids[d], -scores[q, d], q))
    q, d = q[order], d[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    q, d = q[place < k], d[place < k]
    return query_ids[q], doc_ids[d], scores[q, d]


def rounded(x: np.ndarray) -> np.ndarray:
    """``DIGITS`` digits, halves away from zero."""
    return np.sign(x) * np.floor(np.abs(x) * 10**DIGITS + 0.5) / 10**DIGITS


def numbers(lists: pa.Array, known: pa.Array) -> pa.ListArray:
    """For each list of words, the numbers of those that are known, in order and with repeats."""
    coded = lists.flatten().dictionary_encode()
    size = np.asarray(lists.value_lengths().fill_null(0), np.int64)
    number = np.asarray(pc.index_in(coded.dictionary, known).fill_null(-1), np.int64)
    term = number[np.asarray(coded.indices, np.int64)] if len(coded) else np.empty(0, np.int64)
    kept = np.bincount(np.repeat(np.arange(len(size)), size)[term >= 0], minlength=len(size))
    cut = np.concatenate([[0], np.cumsum(kept)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(cut), pa.array(term[term >= 0].astype(np.int32)))


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, BLOCK):
            yield batch.slice(a, BLOCK)


class Lexical:
    """Documents ``(doc_id, text)`` against queries ``(query_id, text)``; ids are integers, a row is a document.

    With ``distinct`` a term of a query counts once, otherwise as often as it
    stands there.  Columns named in ``keep`` stay with the documents.
    """

    def __init__(self, docs: DataFrame, queries: DataFrame, tokens: Callable[[str], Column] = T.retrieval_tokens, distinct: bool = True, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> None:
        asked = queries.select("query_id", F.explode(F.array_distinct(tokens("text")) if distinct else tokens("text")).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qf"))
        rows = asked.orderBy("term", "query_id").limit(MOST_TERMS + 1).collect()  # the stated query set
        if len(rows) > MOST_TERMS:
            raise ValueError(f"a query set may have {MOST_TERMS} terms; ask it in parts")
        self.terms = list(dict.fromkeys(r["term"] for r in rows))
        number = {t: n for n, t in enumerate(self.terms)}
        self.names = np.array(sorted({r["query_id"] for r in rows}), np.int64)
        self.term_of = np.array([number[r["term"]] for r in rows], np.int64)
        self.query_of = np.searchsorted(self.names, np.array([r["query_id"] for r in rows], np.int64))
        self.times = np.array([r["qf"] for r in rows], float)
        self.cut = np.searchsorted(self.term_of, np.arange(len(self.terms) + 1))
        self.size = np.bincount(self.query_of, minlength=len(self.names))
        known = self.terms

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            wanted = pa.array(known, pa.string())
            for part in pieces(batches):
                lists = part.column("w")
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists.value_lengths().fill_null(0).cast(pa.int64()), numbers(lists, wanted), *(part.column(c) for c in keep)], names=["doc_id", "length", "terms", *keep])

        words = docs.select(F.col(id_col).cast("long").alias("doc_id"), tokens(text_col).alias("w"), *keep)
        fields = [StructField("doc_id", LongType()), StructField("length", LongType()), StructField("terms", ArrayType(IntegerType())), *(docs.schema[c] for c in keep)]
        self.hits = written(words.mapInArrow(find, StructType(fields)), "hits")
        self._known: tuple[float, np.ndarray] | None = None

    def __getstate__(self) -> dict:
        """What tasks get: everything but the table."""
        return {k: v for k, v in self.__dict__.items() if k != "hits"}

    def statistics(self) -> tuple[float, np.ndarray]:
        """Average length, and the inverse document frequency ``ln(1 + (N - df + 0.5) / (df + 0.5))`` of every term."""
        if self._known is None:
            size = len(self.terms)

            def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                n, length, df = 0, 0, np.zeros(size, np.int64)
                for part in pieces(batches):
                    n, length = n + part.num_rows, length + (pc.sum(part.column("length")).as_py() or 0)
                    owner, term, _ = self._counted(part)
                    df += np.bincount(term, minlength=size)
                some = np.flatnonzero(df)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1, -2], some])), pa.array(np.concatenate([[n, length], df[some]]))], names=["term", "value"])

            found = {r["term"]: r["value"] for r in self.hits.mapInArrow(count, "term long, value long").groupBy("term").agg(F.sum("value").alias("value")).collect()}  # one row for each asked term
            n, df = found.get(-1, 0), np.array([found.get(t, 0) for t in range(size)], float)
            self._known = max(found.get(-2, 0) / n if n else 0.0, 1e-12), np.log(1 + (n - df + 0.5) / (df + 0.5))
        return self._known

    def _counted(self, part: pa.RecordBatch, column: str = "terms") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(document, term, tf)`` of a block, in order."""
        lists, width = part.column(column), max(len(self.terms), 1)
        owner = np.repeat(np.arange(part.num_rows), np.asarray(lists.value_lengths().fill_null(0), np.int64))
        pair, tf = np.unique(owner * width + np.asarray(lists.flatten(), np.int64), return_counts=True)
        return pair // width, pair % width, tf

    def blocks(self, part: pa.RecordBatch, gains: list[Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]], weights: list[np.ndarray], column: str = "terms") -> Iterator[tuple[slice, list[np.ndarray]]]:
        """For each block of queries, ``queries x documents`` sums of ``gain(document, term, tf) * weight`` of their common terms."""
        owner, term, tf = self._counted(part, column)
        each = self.cut[term + 1] - self.cut[term]
        at = np.repeat(self.cut[term] - np.cumsum(each) + each, each) + np.arange(int(each.sum()))
        doc, query = np.repeat(owner, each), self.query_of[at]
        values = [np.repeat(g(owner, term, tf), each) * w[at] for g, w in zip(gains, weights)]
        for a in range(0, len(self.names), QUERIES):
            b = min(a + QUERIES, len(self.names))
            mine = (query >= a) & (query < b) if len(self.names) > QUERIES else slice(None)
            cell = (query[mine] - a) * part.num_rows + doc[mine]
            yield slice(a, b), [np.bincount(cell, v[mine], (b - a) * part.num_rows).astype(float).reshape(b - a, part.num_rows) for v in values]

    def gain(self, length: np.ndarray, k1: float, b: float) -> Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
        average = self.statistics()[0]
        return lambda owner, term, tf: tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[owner] / average))

    def weights(self) -> np.ndarray:
        """Of each term of each query."""
        return self.times * self.statistics()[1][self.term_of] if len(self.terms) else np.empty(0)

    def grid(self, k: int, settings: list[tuple[float, float]]) -> DataFrame:
        """``(setting, query_id, doc_id, score, rank)``: the best ``k`` by BM25 for every ``(k1, b)``, all from one reading."""
        self.statistics()
        weight = self.weights()

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in pieces(batches):
                ids, length = part.column("doc_id").to_numpy().astype(np.int64), part.column("length").to_numpy().astype(float)
                for at, scores in self.blocks(part, [self.gain(length, k1, b) for k1, b in settings], [weight] * len(settings)):
                    for n, score in enumerate(scores):
                        score = np.round(score, DIGITS)
                        q, d, s = head(self.names[at], ids, score, k, score > 0)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), n, np.int32)), pa.array(q), pa.array(d), pa.array(s)], names=["setting", "query_id", "doc_id", "score"])

        order = Window.partitionBy("setting", "query_id").orderBy(F.desc("score"), "doc_id")
        found = self._lean().mapInArrow(best, "setting int, query_id long, doc_id long, score double")
        return found.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)

    def _lean(self) -> DataFrame:
        """Rows with an asked word."""
        return self.hits.filter(F.size("terms") > 0).select("doc_id", "length", "terms")

    def best(self, k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
        return self.grid(k, [(k1, b)]).drop("setting")

    def _shares(self, emit: Callable[[slice, np.ndarray, np.ndarray], list[pa.Array]], names: list[str], schema: str) -> DataFrame:
        one = np.ones(len(self.term_of))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in pieces(batches):
                ids = part.column("doc_id").to_numpy().astype(np.int64)
                for at, (both,) in self.blocks(part, [lambda owner, term, tf: np.ones(len(tf))], [one]):
                    yield pa.RecordBatch.from_arrays(emit(at, ids, both), names=names)

        return self._lean().mapInArrow(run, schema)

    def coverage(self, k: int) -> DataFrame:
        """The best ``k`` documents of each query by the share of its different words that they have, from one word on."""

        def emit(at: slice, ids: np.ndarray, both: np.ndarray) -> list[pa.Array]:
            return [pa.array(x) for x in head(self.names[at], ids, np.round(both / self.size[at, None], DIGITS), k, both > 0)]

        found = self._shares(emit, ["query_id", "doc_id", "score"], "query_id long, doc_id long, score double")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
        return found.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)

    def judged(self, some: float = 0.6, most: float = 0.9) -> DataFrame:
        """``(query_id, doc_id, gain)`` of documents with at least the share ``some`` of a query's different words; ``most`` counts double."""

        def emit(at: slice, ids: np.ndarray, both: np.ndarray) -> list[pa.Array]:
            q, d = np.nonzero(both >= some * self.size[at, None])
            return [pa.array(self.names[at][q]), pa.array(ids[d]), pa.array(np.where(both[q, d] >= most * self.size[at][q], 2, 1).astype(np.int32))]

        return self._shares(emit, ["query_id", "doc_id", "gain"], "query_id long, doc_id long, gain int")

    def of_pairs(self, pairs: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """BM25 of stated ``pairs(query_id, doc_id)`` alone, 0 without a common term.

        A document's term numbers go to its pairs and are summed there, so the
        work follows the number of pairs and not documents x queries.
        """
        average, weight, width = self.statistics()[0], self.weights(), max(len(self.terms), 1)
        key = self.query_of * width + self.term_of
        order = np.argsort(key)
        key, weight = key[order], weight[order]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in pieces(batches):
                query, length = part.column("query_id").to_numpy().astype(np.int64), part.column("length").to_numpy().astype(float)
                place = np.searchsorted(self.names, query)
                there = (place < len(self.names)) & (self.names[np.minimum(place, len(self.names) - 1)] == query) if len(self.names) else np.zeros(len(query), bool)
                owner, term, tf = self._counted(part)
                wanted = place[owner] * width + term
                at = np.minimum(np.searchsorted(key, wanted), max(len(key) - 1, 0))
                ok = there[owner] & (key[at] == wanted) if len(key) else np.zeros(len(owner), bool)
                owner, tf, at = owner[ok], tf[ok], at[ok]
                gain = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[owner] / average))
                yield pa.RecordBatch.from_arrays([part.column("query_id"), part.column("doc_id"), pa.array(np.round(np.bincount(owner, gain * weight[at], part.num_rows).astype(float), DIGITS))], names=["query_id", "doc_id", "score"])

        met = pairs.select("query_id", "doc_id").distinct().join(self.hits.select("doc_id", "length", "terms"), "doc_id")
        return met.select("query_id", "doc_id", "length", "terms").mapInArrow(run, "query_id long, doc_id long, score double")
