"""Ranked lexical search by max trees over document ranges.

1. One pass over the texts finds each document's terms and keeps, in a table
   of the shared folder, its number of terms and the counts of those that any
   item asks for.  Texts are not read again.
2. A pass over that table sums the number of documents, their length and the
   documents of each asked term: a row for each asked term reaches the driver.
3. A task takes its documents in ranges.  For each term of a range it builds a
   tree: a leaf is a block of ``FAN`` documents and holds the largest score
   that the term gives to one of them; a node holds the largest of its ``FAN``
   children.  An item adds up its terms' values at a node, which bounds every
   document below, and opens the node of the largest bound first.  It stops
   when that bound is below its worst kept score; nodes whose bound equals it
   are still opened, since a document below may win the tie by its id.
4. Each task sends its best documents of each item, and these are ranked.

An item set is asked in blocks of items with ``MOST_TERMS`` terms at most, so
what a task holds for the items is bounded.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.shared import written
from .words import chunks, numbered

#: Documents of a leaf, and children of a node.
FAN = 16
#: Terms of items that are asked at once, terms of a single item at most, and values of a range's lowest tree level.
MOST_TERMS, WIDEST_ITEM, LEVEL_VALUES = 1 << 16, 1 << 15, 1 << 23
DOCUMENTS, LENGTH = -1, -2
_TERM = np.zeros(256, bool)
_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOW = np.arange(256, dtype=np.uint8)
_LOW[0x41:0x5B] += 0x20


def terms_of(column: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Every term of a chunk of texts, in order, and ``first[d]:first[d+1]`` for each text; a null text has none."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    inside = _TERM[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    begin, end = np.flatnonzero(inside & (~before | edge[:-1])), np.flatnonzero(inside & (~after | edge[1:])) + 1
    return numbered(_LOW[data], inside, end - begin), np.searchsorted(begin, offsets)


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, "text"):
            coded, first = terms_of(part.column("text"))
            owner = np.repeat(np.arange(part.num_rows), np.diff(first))
            yield pa.RecordBatch.from_arrays([part.column("item_id").take(pa.array(owner)), coded.dictionary_decode()], names=["item_id", "term"])


def _postings(terms: list[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(terms, pa.large_binary())
        for batch in batches:
            for part in chunks(batch, "text"):
                coded, first = terms_of(part.column("text"))
                number = np.asarray(pc.index_in(coded.dictionary, known).fill_null(-1), np.int64)
                term = number[np.asarray(coded.indices, np.int64)] if len(coded) else np.empty(0, np.int64)
                length = np.diff(first)
                owner = np.repeat(np.arange(part.num_rows), length)[term >= 0]
                pair, tf = np.unique(owner * max(len(terms), 1) + term[term >= 0], return_counts=True)
                some = np.flatnonzero(length)
                cut = np.searchsorted(pair // max(len(terms), 1), np.append(some, part.num_rows)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(cut), pa.array(x.astype(np.int32))) for x in (pair % max(len(terms), 1), tf)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(some)), pa.array(length[some]), *lists], names=["doc_id", "n", "terms", "tfs"])

    return run


def _counts(n_terms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, length, df = 0, 0, np.zeros(n_terms, np.int64)
        for batch in batches:
            docs, length = docs + batch.num_rows, length + (pc.sum(batch.column("n")).as_py() or 0)
            df += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=n_terms)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[DOCUMENTS, LENGTH], some]), pa.int64()), pa.array(np.concatenate([[docs, length], df[some]]), pa.int64())], names=["term", "value"])

    return run


class Ranges:
    """Max trees of one range of documents, by term: ``levels[0]`` is over leaves, the last has at most ``FAN`` nodes."""

    def __init__(self, first: np.ndarray, term: np.ndarray, gain: np.ndarray, n_terms: int) -> None:
        self.first, self.term, self.gain = first, term, gain
        n = len(first) - 1
        leaf = np.repeat(np.arange(n), np.diff(first)) // FAN
        low = np.zeros((-(-n // FAN), n_terms), np.int64)
        np.maximum.at(low.reshape(-1), leaf * n_terms + term, gain)
        self.levels = [low]
        while len(low) > FAN:
            starts = np.arange(0, len(low), FAN)
            low = np.maximum.reduceat(low, starts, axis=0)
            self.levels.append(low)

    def best(self, asked: np.ndarray, mark: np.ndarray, k: int, kept: list[tuple[int, float, int]], base: int, rank: np.ndarray) -> int:
        """Put the best ``k`` documents into the heap ``kept``; ``mark`` is true at ``asked``.  Returns the nodes opened."""
        heap: list[tuple[int, int, int]] = []

        def offer(level: int, a: int, b: int) -> None:
            bounds = self.levels[level][a:b, asked].sum(axis=1)
            for i in np.flatnonzero(bounds).tolist():
                heapq.heappush(heap, (-int(bounds[i]), level, a + i))

        top = len(self.levels) - 1
        offer(top, 0, len(self.levels[top]))
        opened = 0
        while heap and (len(kept) < k or -heap[0][0] >= kept[0][0]):
            _, level, node = heapq.heappop(heap)
            opened += 1
            if level:
                offer(level - 1, node * FAN, min((node + 1) * FAN, len(self.levels[level - 1])))
                continue
            a = node * FAN
            b = min(a + FAN, len(self.first) - 1)
            x, y = self.first[a], self.first[b]
            hit = mark[self.term[x:y]]
            owner = np.repeat(np.arange(b - a), np.diff(self.first[a : b + 1]))[hit]
            score = np.zeros(b - a, np.int64)
            np.add.at(score, owner, self.gain[x:y][hit])
            for d in np.flatnonzero(score).tolist():
                row = (int(score[d]), -float(rank[a + d]), base + a + d)
                if len(kept) < k:
                    heapq.heappush(kept, row)
                elif row > kept[0]:
                    heapq.heapreplace(kept, row)
        return opened


def _gains(weight: np.ndarray, term: np.ndarray, tf: np.ndarray, length: np.ndarray, n: int, total: int) -> np.ndarray:
    """The score that each term gives its document, in 64-bit integers."""
    most = 50 * n * int(length.max(initial=0))
    m = 50 + (50 * n * length // total if most < 1 << 63 else np.array([50 * n * int(x) // total for x in length], np.int64))
    return weight[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m))


def _search(items: list[np.ndarray], weight: np.ndarray, n: int, total: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = max(FAN, LEVEL_VALUES // max(len(weight), 1) * FAN)
        kept: list[list] = [[] for _ in items]
        ids: dict[int, int | None] = {}
        mark, base = np.zeros(len(weight), bool), 0
        for rows in _ranges(batches, size):
            terms = rows["terms"].combine_chunks()
            term, tf = terms.flatten().to_numpy().astype(np.int64), rows["tfs"].combine_chunks().flatten().to_numpy().astype(np.int64)
            count = np.asarray(terms.value_lengths(), np.int64)
            first = np.concatenate([np.zeros(1, np.int64), np.cumsum(count)])
            tree = Ranges(first, term, _gains(weight, term, tf, np.repeat(rows["n"].to_numpy(), count), n, total), len(weight))
            doc = rows["doc_id"].combine_chunks()
            rank = np.where(np.asarray(doc.is_null()), np.inf, np.asarray(doc.fill_null(0), np.int64).astype(float))
            for item, asked in enumerate(items):
                mark[asked] = True
                tree.best(asked, mark, k, kept[item], base, rank)
                mark[asked] = False
            for row in {r for heap in kept for _, _, r in heap if r >= base}:
                ids[row] = doc[row - base].as_py()
            base += len(doc)
        out = [(item, ids[row], score) for item, heap in enumerate(kept) for score, _, row in heap]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64())], names=["item", "doc_id", "score"])

    return run


def _ranges(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Tables of about ``size`` rows, or of 2^22 terms."""
    held, rows, values = [], 0, 0
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            part = batch.slice(a, 256)
            held.append(part)
            rows, values = rows + part.num_rows, values + len(part.column("terms").flatten())
            if rows >= size or values >= 1 << 22:
                yield pa.Table.from_batches(held)
                held, rows, values = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def _asked(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """``(item_id, term, part)``: distinct terms of each item, and the block of items that it is asked with."""
    texts = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).alias("text"))
    pairs = texts.mapInArrow(_item_terms, "item_id long, term binary").distinct()
    sizes = pairs.groupBy("item_id").agg(F.count("*").alias("size"))
    odd = sizes.agg(F.max("size").alias("widest"), F.sum("size").alias("total")).first()
    if (odd["widest"] or 0) > WIDEST_ITEM:
        raise ValueError(f"an item may have {WIDEST_ITEM} different terms, not {odd['widest']}")
    parts = max(1, -(-4 * (odd["total"] or 0) // MOST_TERMS)) if (odd["total"] or 0) > MOST_TERMS else 1
    return written(pairs.withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(parts)).cast("int")), "asked")


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The best ``k`` documents of each item: ``item_id, rank, doc_id, score``.

    Terms are maximal runs of ASCII letters and digits and of characters
    beyond ASCII, with only A to Z in lower case; a null text has none.  With
    N documents that have a term, L terms of theirs, n terms of a document, tf
    and df as usual, a term adds ``w * (10^9 tf div (1000 tf + 20 m))``, where
    ``w = floor(1000 ln((2 N + 2) / (2 df + 1)))`` and ``m = 50 + (50 n N) div
    L``, for every different term of the item.  Only scores above 0 are given;
    ties go to the smaller id, null ids last.  Rows of an id are documents of
    their own; rows of an item are one item with the terms of all, and null
    item ids are one item.  Items without terms, and empty tables, give no
    rows.  Other columns are not read.
    """
    spark = docs.sparkSession
    asked = _asked(items, item_col, text_col)
    parts = sorted(r["part"] for r in asked.select("part").distinct().collect())  # blocks of items
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = [_block(texts, asked.filter(F.col("part") == p), k) for p in parts]
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def _block(texts: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    rows = asked.select("item_id", "term").limit(MOST_TERMS + 1).collect()  # a block of items
    if len(rows) > MOST_TERMS:
        raise ValueError(f"a block of items has more than {MOST_TERMS} terms")
    terms = sorted({bytes(r["term"]) for r in rows})
    number = {t: n for n, t in enumerate(terms)}
    of: dict[int | None, list[int]] = {}
    for r in rows:
        of.setdefault(r["item_id"], []).append(number[bytes(r["term"])])
    names = sorted(of, key=lambda x: (x is None, x))
    postings = written(texts.mapInArrow(_postings(terms), "doc_id long, n long, terms array<int>, tfs array<int>"), "postings")
    stats = {r["term"]: r["value"] for r in postings.mapInArrow(_counts(len(terms)), "term long, value long").groupBy("term").agg(F.sum("value").alias("value")).collect()}  # one row for each asked term
    n, total = stats.get(DOCUMENTS, 0), stats.get(LENGTH, 0)
    weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * stats.get(t, 0) + 1))) for t in range(len(terms))], np.int64)
    best = postings.filter(F.size("terms") > 0).mapInArrow(_search([np.array(sorted(of[i]), np.int64) for i in names], weight, n, max(total, 1), k), "item int, doc_id long, score long")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    top = best.withColumn("rank", place).filter(F.col("rank") <= k)
    named = texts.sparkSession.createDataFrame(list(enumerate(names)), "item int, item_id long")
    return top.join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score")


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = f"""WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents WHERE text IS NOT NULL),
st AS (SELECT count(*) AS nn, sum(len(ws))::BIGINT AS ll FROM d WHERE len(ws) > 0),
q AS (SELECT DISTINCT item_id, unnest({_WORDS}) AS term FROM benchmark WHERE text IS NOT NULL),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(ws) AS n, unnest(ws) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
g AS (SELECT doc_id, term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * nn) // ll))) AS gain FROM tf JOIN df USING (term), st),
s AS (SELECT item_id, doc_id, sum(gain)::BIGINT AS score FROM g JOIN q USING (term) GROUP BY ALL HAVING sum(gain) > 0)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM s QUALIFY rank <= 50"""
