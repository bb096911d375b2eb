"""Ranking of documents for queries: BM25, fusion, cosine search and their evaluation.

Rankings are DataFrames ``(query_id, doc_id, score, rank)``.  Scores are
rounded to ``DIGITS`` before they are ordered, so that the order does not
depend on the order of summation; ties go to the smaller id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..shared import dealt, written
from .lexical import DIGITS, Lexical, head, numbers, rounded

#: Rows of a block of vectors.
BLOCK = 1024


def ranked(scores: DataFrame, k: int | None) -> DataFrame:
    """The best ``k`` rows of each query by score, then id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    out = scores.select("query_id", "doc_id", "score", F.row_number().over(order).cast("long").alias("rank"))
    return out.filter(F.col("rank") <= k) if k else out


def bm25(docs: DataFrame, queries: DataFrame, k: int = 10, k1: float = 1.5, b: float = 0.75, distinct: bool = True, tokens=T.retrieval_tokens, zeros: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Best ``k`` documents ``(doc_id, text)`` of each query ``(query_id, text)`` of a stated set; see ``Lexical``.

    Documents without a common term are ranked only with ``zeros``, by id
    behind the others.  Empty texts count for N and the average length.
    """
    top = Lexical(docs, queries, tokens, distinct, id_col, text_col).best(k, k1, b)
    return _with_zeros(top, docs, queries, k, id_col) if zeros else top


def _with_zeros(top: DataFrame, docs: DataFrame, queries: DataFrame, k: int, id_col: str) -> DataFrame:
    """Rankings filled up to ``k`` with the documents of least id, at score 0."""
    first = docs.select(F.col(id_col).cast("long").alias("doc_id")).distinct().orderBy("doc_id").limit(2 * k)
    rest = queries.select(F.col("query_id").cast("long").alias("query_id")).crossJoin(F.broadcast(first)).join(top, ["query_id", "doc_id"], "left_anti")
    return ranked(top.select("query_id", "doc_id", "score").union(rest.select("query_id", "doc_id", F.lit(0.0))), k)


def rrf(rankings: list[tuple[DataFrame, float]], k: int | None = 10, constant: int = 60) -> DataFrame:
    """Weighted reciprocal rank fusion: the sum of ``weight / (constant + rank)``."""
    parts = [r.select("query_id", "doc_id", (w / (constant + F.col("rank"))).alias("part")) for r, w in rankings]
    joined = parts[0]
    for p in parts[1:]:
        joined = joined.unionByName(p)
    return ranked(joined.groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), DIGITS + 3).alias("score")), k)


def normalised(ranking: DataFrame) -> DataFrame:
    """Scores over the largest of their query, within 0 and 1; 0 where that is not positive."""
    top = F.max("score").over(Window.partitionBy("query_id"))
    return ranking.withColumn("score", F.when(top <= 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score") / top))))


def score_fusion(lexical: DataFrame, dense: DataFrame, k: int | None = 10, weights: tuple[float, float] = (0.55, 0.45)) -> DataFrame:
    """Weighted sum of normalised lexical scores and dense scores; an absent side is 0."""
    a = normalised(lexical).select("query_id", "doc_id", F.col("score").alias("x"))
    b = dense.select("query_id", "doc_id", F.col("score").alias("y"))
    both = a.join(b, ["query_id", "doc_id"], "full_outer")
    total = weights[0] * F.coalesce("x", F.lit(0.0)) + weights[1] * F.coalesce("y", F.lit(0.0))
    return ranked(both.select("query_id", "doc_id", F.round(total, DIGITS).alias("score")), k)


def rerank(ranking: DataFrame, scores: DataFrame, head: int) -> DataFrame:
    """The first ``head`` rows of each query in the order of ``scores``, then the rest as they were."""
    joined = ranking.join(scores.select("query_id", "doc_id", F.col("score").alias("new")), ["query_id", "doc_id"], "left")
    tail = F.col("rank") > head
    order = Window.partitionBy("query_id").orderBy(tail, F.when(~tail, -F.coalesce("new", F.lit(0.0))).otherwise(F.col("rank").cast("double")), "doc_id")
    return joined.select("query_id", "doc_id", "score", F.row_number().over(order).cast("long").alias("rank"))


def hashed_block(lists: pa.Array, dims: int, method: str) -> np.ndarray:
    """Unit vectors of lists of words, one row each; see ``hashed_embeddings``."""

    def cell(word: str) -> tuple[int, float]:
        if method == "md5":
            h = hashlib.md5(word.encode(), usedforsecurity=False).hexdigest()
            return int(h[:7], 16) % dims, 1.0 if int(h[7], 16) < 8 else -1.0
        h = hashlib.blake2b(word.encode(), digest_size=8).digest()
        return int.from_bytes(h[:4], "big") % dims, 1.0 if h[4] % 2 == 0 else -1.0

    coded = lists.flatten().dictionary_encode()
    cells = [cell(w) for w in coded.dictionary.to_pylist()]
    dim, sign = np.array([d for d, _ in cells], np.int64), np.array([s for _, s in cells])
    owner, word = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths().fill_null(0))), np.asarray(coded.indices, np.int64)
    out = np.bincount(owner * dims + dim[word], sign[word], len(lists) * dims).reshape(-1, dims) if len(word) else np.zeros((len(lists), dims))
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.where(norm > 0, norm, 1)


def hashed_embeddings(docs: DataFrame, dims: int = 384, method: str = "blake2b", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, embedding)``: signed feature hashing of words, of length 1; a text without words is all zeros.

    ``blake2b``: the first four bytes of an 8-byte digest give the dimension
    and the parity of the next byte the sign.  ``md5``: seven hexadecimal
    digits and the next one, which SQL can do too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                flat = hashed_block(part.column("w"), dims, method).reshape(-1)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, dims, dtype=np.int32)), pa.array(flat))], names=["doc_id", "embedding"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), T.retrieval_tokens(text_col).alias("w"))
    return texts.mapInArrow(run, "doc_id long, embedding array<double>")


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


def _packed(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, BLOCK):
            part = batch.slice(a, BLOCK)
            ids = part.column("id").to_numpy().astype("<i8")
            flat = part.column("vector").flatten().to_numpy(zero_copy_only=False).astype("<f8").reshape(-1, dims)
            yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()]), pa.array([_unit(flat).tobytes()])], names=["ids", "vectors"])


#: Vectors that a task holds at once, those of a group whose greatest product is looked at, and products that are reckoned again at once.
HELD, GROUP, AGAIN = 16 * BLOCK, 64, 8 * BLOCK


def _blocks(files: list[str], dims: int, least: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(ids, unit vectors)`` of ``least`` rows or a little more from tables that ``_packed`` rows were written to."""
    ids: list[np.ndarray] = []
    rows: list[np.ndarray] = []
    for file in files:
        fs, name = pafs.FileSystem.from_uri(file)
        with fs.open_input_file(name) as f:
            for batch in pq.ParquetFile(f).iter_batches(batch_size=1):
                ids.append(np.frombuffer(batch.column("ids")[0].as_py(), "<i8"))
                rows.append(np.frombuffer(batch.column("vectors")[0].as_py(), "<f8").reshape(-1, dims))
                if sum(map(len, ids)) >= least:
                    yield np.concatenate(ids), np.concatenate(rows)
                    ids, rows = [], []
    if ids:
        yield np.concatenate(ids), np.concatenate(rows)


def nearest(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, d: np.ndarray, d_single: np.ndarray, least: np.ndarray, k: int, itself: bool, score) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(place of query, id, score)`` of the best ``k`` rows of ``d`` for each row of ``q`` by ``score`` of the cosine, then id.

    Products in single precision leave the rows that may be among the best:
    ``k`` groups of ``GROUP`` rows hold one each that is no worse than the
    ``k``-th greatest of their maxima, and nothing below it by more than twice
    the error can be.  Only what is left is reckoned in double precision.
    Cosines below ``least``, one for each query, are left out; ``least`` is
    raised to what can still be among the best ``k``.
    """
    n, groups = len(ids), -(-len(ids) // GROUP)
    error = (q.shape[1] + 8) * 2.0**-23
    x = np.full((groups * GROUP, len(q)), -np.inf, np.float32)
    np.matmul(d_single, q.astype(np.float32).T, out=x[:n])
    if not itself:
        order = np.argsort(ids, kind="stable")
        low, high = np.searchsorted(ids[order], q_ids, "left"), np.searchsorted(ids[order], q_ids, "right")
        for j in np.flatnonzero(high > low):
            x[order[low[j] : high[j]], j] = -np.inf
    x = x.reshape(groups, GROUP, len(q))
    top = x.max(axis=1)
    bound = least - error
    if groups >= k:
        bound = np.maximum(bound, np.partition(top, groups - k, axis=0)[groups - k].astype(float) - 2 * error - SLACK)
    g, j = np.nonzero((top >= bound) & np.isfinite(top))
    members = x[g, :, j]
    hit, inside = np.nonzero((members >= bound[j, None]) & np.isfinite(members))
    row, col = g[hit] * GROUP + inside, j[hit]
    if len(row) * 32 > n * len(q):  # copies, or a short table: products of all are cheaper than those of so many pairs
        cosines = (d @ q.T)[row, col]
    else:
        cosines = np.concatenate([np.einsum("ij,ij->i", d[row[a : a + AGAIN]], q[col[a : a + AGAIN]]) for a in range(0, len(row), AGAIN)] or [np.empty(0)])
    scores = score(cosines)
    order = np.lexsort((ids[row], -scores, col))
    col, row, scores, cosines = col[order], row[order], scores[order], cosines[order]
    place = np.arange(len(col)) - np.searchsorted(col, col)
    last = place == k - 1
    least[col[last]] = np.maximum(least[col[last]], cosines[last] - SLACK)
    return col[place < k], ids[row[place < k]], scores[place < k]


#: Cosines that differ by more have different scores, whichever way these are rounded.
SLACK = 4 * 10.0**-DIGITS


def cosine(vectors: DataFrame, queries: DataFrame, k: int = 10, dims: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", itself: bool = False, half: bool = False) -> DataFrame:
    """Exact best ``k`` vectors by cosine for each row of ``queries``, a row of the same id left out unless ``itself``.

    The queries are written in blocks of ``BLOCK`` rows.  A task holds
    ``HELD`` vectors at a time, reads the blocks one after the other, and sends
    on the best ``k`` of each query that beat those it has sent before; see
    ``nearest``.  No vector is dealt out.  Null vectors and vectors of another
    length are left out; zero vectors have cosine 0.  ``half`` gives
    ``(cos + 1) / 2``.
    """

    def usable(df: DataFrame) -> DataFrame:
        return df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).filter(F.size("vector") == dims).filter("id is not null")

    files = written(usable(queries).mapInArrow(lambda it: _packed(it, dims), "ids binary, vectors binary"), "queries").inputFiles()
    score = lambda x: np.round((x + 1) / 2 if half else x, DIGITS)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[int, np.ndarray] = {}
        for ids, d in _held(batches, dims):
            single = d.astype(np.float32)
            for n, (q_ids, q) in enumerate(_blocks(files, dims)):
                at, found, scores = nearest(q_ids, q, ids, d, single, least.setdefault(n, np.full(len(q), -np.inf)), k, itself, score)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[at]), pa.array(found), pa.array(scores)], names=["query_id", "doc_id", "score"])

    return ranked(usable(vectors).mapInArrow(best, "query_id long, doc_id long, score double"), k)


def cosine_of_each(vectors: DataFrame, k: int = 10, dims: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", itself: bool = False, half: bool = False) -> DataFrame:
    """``cosine`` with every row of ``vectors`` as a query.

    The vectors are written in blocks and the blocks are dealt as queries.  A
    task holds up to ``HELD`` queries, reads all blocks one after the other and
    keeps the best ``k`` of each query, so ``k`` rows of a query leave it.
    """
    usable = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).filter(F.size("vector") == dims).filter("id is not null")
    blocks = written(usable.mapInArrow(lambda it: _packed(it, dims), "ids binary, vectors binary"), "vectors")
    files = blocks.inputFiles()
    score = lambda x: np.round((x + 1) / 2 if half else x, DIGITS)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for q_ids, q in _gathered(batches, dims):
            scores, found, least = np.full((len(q), k), -np.inf), np.zeros((len(q), k), np.int64), np.full(len(q), -np.inf)
            for ids, d in _blocks(files, dims, 4 * BLOCK):
                single = d.astype(np.float32)
                for a in range(0, len(q), BLOCK):
                    part = slice(a, a + BLOCK)
                    at, new, new_scores = nearest(q_ids[part], q[part], ids, d, single, least[part], k, itself, score)
                    some, row = np.unique(at, return_inverse=True)
                    some = some + a
                    row, all_scores, all_ids = np.concatenate([np.repeat(np.arange(len(some)), k), row]), np.concatenate([scores[some].ravel(), new_scores]), np.concatenate([found[some].ravel(), new])
                    order = np.lexsort((all_ids, -all_scores, row))
                    order = order[np.arange(len(row)) - np.searchsorted(row[order], row[order]) < k].reshape(-1, k)
                    scores[some], found[some] = all_scores[order], all_ids[order]
                    last = scores[some, k - 1]
                    least[some] = np.maximum(least[some], (2 * last - 1 if half else last) - SLACK)
            at, place = np.nonzero(np.isfinite(scores))
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[at]), pa.array(found[at, place]), pa.array(scores[at, place])], names=["query_id", "doc_id", "score"])

    return ranked(dealt(blocks, "ids").mapInArrow(best, "query_id long, doc_id long, score double"), k)


def _gathered(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(ids, unit vectors)`` of ``_packed`` rows, as many as are ``HELD`` rows at most."""
    ids: list[np.ndarray] = []
    rows: list[np.ndarray] = []
    for batch in batches:
        for n, v in zip(batch.column("ids").to_pylist(), batch.column("vectors").to_pylist()):
            if ids and sum(map(len, ids)) + len(n) // 8 > HELD:
                yield np.concatenate(ids), np.concatenate(rows)
                ids, rows = [], []
            ids.append(np.frombuffer(n, "<i8"))
            rows.append(np.frombuffer(v, "<f8").reshape(-1, dims))
    if ids:
        yield np.concatenate(ids), np.concatenate(rows)


def _held(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(ids, unit vectors)`` of ``HELD`` rows at most, one block of them held back until it is full."""
    ids, rows, n = np.empty(HELD, np.int64), np.empty((HELD, dims)), 0
    for batch in batches:
        for a in range(0, batch.num_rows, BLOCK):
            part = batch.slice(a, BLOCK)
            if n + part.num_rows > HELD:
                yield ids[:n], rows[:n]
                n = 0
            ids[n : n + part.num_rows] = part.column("id").to_numpy()
            rows[n : n + part.num_rows] = _unit(part.column("vector").flatten().to_numpy(zero_copy_only=False).astype("<f8").reshape(-1, dims))
            n += part.num_rows
    if n:
        yield ids[:n], rows[:n]


#: Queries that are held as vectors by every task at most.
MOST_QUERIES = 1 << 16


def hashing_search(docs: DataFrame, queries: DataFrame, k: int = 10, dims: int = 384, method: str = "blake2b") -> DataFrame:
    """Best documents by hashed vectors, as ``(cos + 1) / 2``.

    A task hashes a block of documents, compares it with the vectors of the
    stated queries and sends on the best ``k`` of each, so no vector leaves
    it.  More than ``MOST_QUERIES`` queries meet the documents in blocks.
    """
    queries = queries.select(F.col("query_id").cast("long").alias("query_id"), "text")
    asked = queries.select("query_id", T.retrieval_tokens("text").alias("w")).filter("query_id is not null").limit(MOST_QUERIES + 1).collect()  # the stated query set
    if len(asked) > MOST_QUERIES:
        return cosine(hashed_embeddings(docs, dims, method), hashed_embeddings(queries.withColumnRenamed("query_id", "doc_id"), dims, method), k, dims, "doc_id", itself=True, half=True)
    names = np.array([r["query_id"] for r in asked], np.int64)
    towards = _unit(hashed_block(pa.array([r["w"] for r in asked], pa.list_(pa.string())), dims, method))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                ids = part.column("doc_id").to_numpy().astype(np.int64)
                vectors = _unit(hashed_block(part.column("w"), dims, method)).T
                for q in range(0, len(names), BLOCK):
                    x = np.round((towards[q : q + BLOCK] @ vectors + 1) / 2, DIGITS)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in head(names[q : q + BLOCK], ids, x, k, np.ones(x.shape, bool))], names=["query_id", "doc_id", "score"])

    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), T.retrieval_tokens("text").alias("w")).filter("doc_id is not null")
    # written, as batches of texts are small only then
    return ranked(written(words.mapInArrow(run, "query_id long, doc_id long, score double"), "hashed"), k)


def coverage_search(docs: DataFrame, queries: DataFrame, k: int = 10, dims: int = 384, method: str = "blake2b") -> DataFrame:
    """``.55`` of the cosine of hashed vectors, at least 0, and ``.30`` of the share of a query's words that a document has.

    Every document that shares a word or a dimension with a query is scored,
    for every query of the stated set: a task hashes a block of documents and
    looks its words up, adds both matrices, and sends on the best ``k`` of
    each query.
    """
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), T.retrieval_tokens("text").alias("w")).orderBy("query_id").limit(MOST_QUERIES + 1).collect()  # the stated query set
    if len(asked) > MOST_QUERIES:
        raise ValueError(f"a query set may have {MOST_QUERIES} queries; ask it in parts")
    names = np.array([r["query_id"] for r in asked], np.int64)
    towards = hashed_block(pa.array([r["w"] for r in asked], pa.list_(pa.string())), dims, method)
    terms = sorted({t for r in asked for t in r["w"]})
    number = {t: n for n, t in enumerate(terms)}
    of = [np.array(sorted({number[t] for t in r["w"]}), np.int64) for r in asked]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(terms, pa.string())
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                lists, ids = part.column("w"), part.column("doc_id").to_numpy().astype(np.int64)
                vectors = hashed_block(lists, dims, method)
                near = np.clip(np.round(towards @ vectors.T, DIGITS), 0.0, 1.0)
                met = numbers(lists, known)
                has = np.zeros((len(terms), part.num_rows), bool)
                has[np.asarray(met.flatten(), np.int64), np.repeat(np.arange(part.num_rows), np.asarray(met.value_lengths()))] = True
                share = np.stack([np.round(has[x].sum(axis=0) / max(len(x), 1), DIGITS) for x in of]) if of else np.zeros((0, part.num_rows))
                score = rounded(0.55 * near + 0.30 * share)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in head(names, ids, score, k, (share > 0) | ((towards != 0).astype(np.float32) @ (vectors != 0).astype(np.float32).T > 0))], names=["query_id", "doc_id", "score"])

    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), T.retrieval_tokens("text").alias("w"))
    return ranked(words.mapInArrow(run, "query_id long, doc_id long, score double"), k)


def word_coverage(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The best ``k`` documents by the share of each query's distinct words that they have, from one word on."""
    return Lexical(docs, queries).coverage(k)


def lexical_rerank(ranking: DataFrame, docs: DataFrame, queries: DataFrame, k: int = 10, lexical: Lexical | None = None) -> DataFrame:
    """The candidates of ``ranking`` by BM25 with the statistics of all documents; candidates without a common term have 0.

    Only the stated pairs are scored.  ``lexical`` may be handed on from an
    earlier search of the same documents and queries.
    """
    lexical = lexical or Lexical(docs, queries, T.service_tokens, distinct=False)
    return ranked(lexical.of_pairs(ranking), k)


def pool_size(k: int, n: int, times: int = 5) -> int:
    return min(n, max(k * times, 20))


def search(docs: DataFrame, queries: DataFrame, method: str = "hybrid", k: int = 10, mode: str = "raw", aliases: dict[str, str] | None = None, dense=None, reranker=None, weights: tuple[float, float] = (0.55, 0.45)) -> DataFrame:
    """The retrieval service: ``bm25``, ``hashing``, ``semantic``, ``hybrid`` or ``hybrid_rerank``.

    ``mode``: ``raw`` asks the query as it is, ``compat`` with its aliases,
    ``rules`` asks every valid variant and fuses their BM25 ranks, whatever
    the method.  ``dense`` is a function ``(docs, queries, k)`` to a ranking
    with scores in 0 to 1; without it feature hashing stands in, which is no
    semantic model.  ``reranker`` is a function ``(ranking, docs, queries,
    k)``; without it BM25 reranks.
    """
    aliases = aliases or {}
    pool = pool_size(k, docs.count())
    service = lambda q, n, x=None: _with_zeros((x or Lexical(docs, q, T.service_tokens, False)).best(n, 1.2, 0.75), docs, q, n, "doc_id")
    if mode == "rules":
        plan = queries.select("query_id", T.valid_variants(T.query_plan("text", aliases), "text")["accepted"].alias("v"))
        several = plan.filter(F.size("v") > 1)
        if several.limit(1).count():
            parts = [(service(plan.filter(F.size("v") > n).select("query_id", F.get("v", F.lit(n)).alias("text")), pool), 1.0) for n in range(3)]
            return rrf(parts, k)
    elif mode == "compat":
        queries = queries.select("query_id", T.expand_query("text", aliases).alias("text"))
    if method == "bm25":
        return ranked(normalised(service(queries, pool)), k)
    near = (dense or hashing_search)(docs, queries, pool)
    if method in ("hashing", "semantic"):
        return ranked(near, k)
    words = Lexical(docs, queries, T.service_tokens, False)
    fused = score_fusion(service(queries, pool, words), near, pool if method == "hybrid_rerank" else k, weights)
    if method == "hybrid":
        return fused
    fused = written(fused, "fused")
    return ranked(normalised(reranker(fused, docs, queries, pool) if reranker else lexical_rerank(fused, docs, queries, pool, words)), k)


def multi_query(docs: DataFrame, queries: DataFrame, aliases: dict[str, str], k: int = 10, depth: int = 100) -> DataFrame:
    """BM25 of every valid variant of a query, fused by rank."""
    plan = queries.select("query_id", T.valid_variants(T.query_plan("text", aliases), "text")["accepted"].alias("v"))
    return rrf([(bm25(docs, plan.filter(F.size("v") > n).select("query_id", F.get("v", F.lit(n)).alias("text")), depth), 1.0) for n in range(3)], k)


#: How much a section of a paper says about methods and data.
SECTION_SCORES = {"methods": 1.0, "data_availability": 0.95, "supplementary": 0.9, "table": 0.88, "cohort": 0.84, "population": 0.82, "variables": 0.82, "outcome_definition": 0.9, "statistical_analysis": 0.86, "results": 0.68, "abstract": 0.56, "title": 0.42}


def evidence(chunks: DataFrame, queries: DataFrame, related: DataFrame | None = None, k: int = 10, dense=None) -> DataFrame:
    """Best chunks for ``queries(query_id, text)``: ``.55`` semantic, ``.30`` lexical, ``.10`` section, ``.05`` graph.

    ``chunks(doc_id, text, section, section_priority, paper_id)``.  The
    lexical side is BM25 over its maximum, or the share of the query's words
    where BM25 is 0 throughout or the query is mostly not ASCII.
    ``related(query_id, paper_id)`` are papers tied to the query's field.
    The semantic side is that of the best ``max(4 k, 20)`` chunks of a query
    and 0 for others; every chunk has its other parts.  A task scores a block
    of chunks for all queries of the stated set and sends on ``k`` of each.
    """
    keep = ("section", "section_priority", "paper_id", "overlap_words")
    lexical = Lexical(chunks.withColumn("overlap_words", T.retrieval_tokens("text")), queries, T.service_tokens, False, keep=keep)
    shared = Lexical(chunks.limit(0), queries)  # the queries' words as the overlap has them
    asked = {r["query_id"]: r["by_overlap"] for r in queries.select(F.col("query_id").cast("long").alias("query_id"), _not_latin(F.col("text")).alias("by_overlap")).limit(MOST_QUERIES + 1).collect()}  # the stated query set
    if len(asked) > MOST_QUERIES:
        raise ValueError(f"a query set may have {MOST_QUERIES} queries; ask it in parts")
    every = np.array(sorted(asked), np.int64)
    top = {r["query_id"]: r["score"] for r in lexical.best(1, 1.2, 0.75).collect()}  # one row for each query
    most = np.array([top.get(q, 0.0) for q in every.tolist()])
    by_overlap = np.array([bool(asked[q]) for q in every.tolist()], bool) | (most <= 0)
    near = (dense or hashing_search)(chunks, queries, max(4 * k, 20)).groupBy("doc_id").agg(F.collect_list(F.struct(F.col("query_id").cast("long").alias("q"), F.col("score").alias("s"))).alias("near"))
    rows = lexical.hits.join(near, "doc_id", "left")
    if related is not None:
        rows = rows.join(related.groupBy("paper_id").agg(F.collect_set(F.col("query_id").cast("long")).alias("tied")), "paper_id", "left")
    else:
        rows = rows.withColumn("tied", F.lit(None).cast("array<long>"))
    rows = rows.select("doc_id", "length", "terms", "section", F.col("section_priority").cast("long").alias("section_priority"), "overlap_words", F.col("near.q").alias("near_q"), F.col("near.s").alias("near_s"), "tied")

    def spread(lists: pa.Array, values: pa.Array | None, n: int) -> np.ndarray:
        """``queries x chunks`` from each chunk's list of queries."""
        out = np.zeros((len(every), n))
        owner = np.repeat(np.arange(n), np.asarray(lists.value_lengths().fill_null(0), np.int64))
        q = np.asarray(lists.flatten(), np.int64)
        at = np.minimum(np.searchsorted(every, q), len(every) - 1)
        ok = every[at] == q
        out[at[ok], owner[ok]] = np.asarray(values.flatten(), float)[ok] if values is not None else 1.0
        return out

    def placed(side: Lexical, blocks: Iterator[tuple[slice, list[np.ndarray]]], n: int) -> np.ndarray:
        out = np.zeros((len(every), n))
        for at, (x,) in blocks:
            out[np.searchsorted(every, side.names[at])] = x
        return out

    lexical.statistics()
    weight, one = lexical.weights(), np.ones(len(shared.term_of))
    sizes = dict(zip(shared.names.tolist(), shared.size.tolist()))
    size = np.array([sizes.get(q, 1) for q in every.tolist()], float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(shared.terms, pa.string())
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK if len(every) else batch.num_rows):
                part = batch.slice(a, BLOCK)
                n = part.num_rows
                bm = placed(lexical, lexical.blocks(part, [lexical.gain(part.column("length").to_numpy().astype(float), 1.2, 0.75)], [weight]), n)
                words = pa.RecordBatch.from_arrays([numbers(part.column("overlap_words"), known)], names=["terms"])
                overlap = np.round(placed(shared, shared.blocks(words, [lambda owner, term, tf: np.ones(len(tf))], [one]), n) / size[:, None], DIGITS)
                bm = np.clip(np.round(bm, DIGITS) / np.where(most > 0, most, 1)[:, None], 0.0, 1.0)
                lex = np.where(by_overlap[:, None], overlap, bm)
                section = np.array([SECTION_SCORES.get(x, 0.35) for x in part.column("section").to_pylist()])
                semantic, graph = spread(part.column("near_q"), part.column("near_s"), n), spread(part.column("tied"), None, n)
                score = np.clip(rounded(0.55 * semantic + 0.30 * lex + 0.10 * section[None, :] + 0.05 * graph), 0.0, 1.0)
                ids = part.column("doc_id").to_numpy().astype(np.int64)
                # the order of score, priority and id as one number for each chunk
                place = np.empty(n, np.int64)
                place[np.lexsort((ids, part.column("section_priority").to_numpy()))] = np.arange(n)
                q, d, s = head(np.arange(len(every)), place, score, k, np.ones(score.shape, bool))
                d = np.argsort(place)[d]
                yield pa.RecordBatch.from_arrays([pa.array(every[q]), pa.array(ids[d]), pa.array(s), part.column("section_priority").take(pa.array(d)), *(pa.array(x) for x in (np.round(semantic[q, d], DIGITS), np.round(lex[q, d], DIGITS), section[d], graph[q, d]))], names=["query_id", "doc_id", "score", "section_priority", "semantic_score", "lexical_score", "section_score", "graph_score"])

    scored = rows.mapInArrow(run, "query_id long, doc_id long, score double, section_priority long, semantic_score double, lexical_score double, section_score double, graph_score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "section_priority", "doc_id")
    out = scored.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)
    return out.select("query_id", "doc_id", "score", "rank", "semantic_score", "lexical_score", "section_score", "graph_score")


def _not_latin(text: Column) -> Column:
    """Whether a query has no ASCII letter, or more than 35 % other characters."""
    other = F.length(F.regexp_replace(text, "[\\x00-\\x7F]", "")) / F.greatest(F.lit(1), F.length(text))
    return ~text.rlike("[A-Za-z]") | (other > 0.35)


def evaluate(ranking: DataFrame, judged: DataFrame, cutoffs: tuple[int, ...] = (1, 3, 5, 10), depth: int = 100) -> DataFrame:
    """Measures of each query that has a judged document ``(query_id, doc_id, gain)``.

    ``ndcg`` at 10 has gain ``2^g - 1`` and discount ``log2(rank + 1)``.
    Queries without a ranking have 0 everywhere.
    """
    gain = F.pow(F.lit(2.0), F.coalesce("gain", F.lit(0))) - 1
    joined = ranking.join(judged, ["query_id", "doc_id"], "left").withColumn("hit", (F.coalesce("gain", F.lit(0)) > 0).cast("int"))
    upto = lambda k: F.coalesce(F.sum(F.when(F.col("rank") <= k, F.col("hit"))), F.lit(0))
    per = joined.groupBy("query_id").agg(
        F.coalesce(F.sum(F.when(F.col("rank") <= 10, gain / F.log2(F.col("rank") + 1))), F.lit(0.0)).alias("dcg"),
        F.min(F.when((F.col("hit") == 1) & (F.col("rank") <= 10), F.col("rank"))).alias("first"),
        *(upto(k).alias(f"h{k}") for k in (*cutoffs, depth)),
    )
    place = Window.partitionBy("query_id").orderBy(F.desc("gain"), "doc_id")
    ideal = judged.filter("gain > 0").withColumn("place", F.row_number().over(place)).groupBy("query_id").agg(F.sum(F.when(F.col("place") <= 10, gain / F.log2(F.col("place") + 1))).alias("ideal"), F.count("*").alias("relevant"))
    out = ideal.join(per, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    rounded = lambda c, name: F.round(c.cast("double"), DIGITS).alias(name)
    return out.select(
        "query_id", rounded(zero("dcg") / F.col("ideal"), "ndcg_10"), rounded(F.coalesce(1 / F.col("first"), F.lit(0.0)), "mrr_10"),
        *(rounded(zero(f"h{k}") / k, f"precision_{k}") for k in cutoffs), *((zero(f"h{k}") > 0).cast("int").alias(f"hit_{k}") for k in cutoffs), rounded(zero(f"h{depth}") / F.col("relevant"), f"recall_{depth}"),
    )


def mean_ndcg(rankings: DataFrame, judged: DataFrame, settings: DataFrame) -> DataFrame:
    """``settings`` with the mean ``ndcg_10`` of each one's ranking, from ``rankings(setting, query_id, doc_id, rank)``.

    Every setting is judged on every query with a judgement; the judgements
    meet the settings once, and no plan is built for each of them.
    """
    key = F.struct("setting", "query_id").alias("query_id")
    asked = judged.crossJoin(F.broadcast(settings.select("setting"))).select(key, "doc_id", "gain")  # a handful of settings
    rated = evaluate(rankings.select(key, "doc_id", "rank"), asked).groupBy(F.col("query_id.setting").alias("setting")).agg(F.round(F.avg("ndcg_10"), DIGITS).alias("ndcg_10"))
    return settings.join(F.broadcast(rated), "setting").drop("setting")


def _settings(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    return spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "setting int, " + names)


def _ranked_settings(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("setting", "query_id").orderBy(F.desc("score"), "doc_id")
    return scores.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)


def tuned(lexical: Lexical, judged: DataFrame, grid: tuple[tuple[float, float], ...] = ((1.2, 0.75), (1.5, 0.75), (1.8, 0.25))) -> DataFrame:
    """Mean nDCG at 10 of each ``(k1, b)``, scored together; the first row is the best, larger values on ties."""
    settings = _settings(judged.sparkSession, list(grid), "k1 double, b double")
    return mean_ndcg(lexical.grid(100, list(grid)), judged, settings).orderBy(F.desc("ndcg_10"), F.desc("k1"), F.desc("b"))


def tuned_fusion(lexical: DataFrame, dense: DataFrame, judged: DataFrame, steps: tuple[float, ...] = (0.0, 0.25, 0.5, 0.75, 1.0)) -> DataFrame:
    """Mean nDCG at 10 of each lexical weight; the first row is the best, the larger weight on ties."""
    settings = _settings(judged.sparkSession, [(w, 1 - w) for w in steps], "lexical double, dense double")
    a = normalised(lexical).select("query_id", "doc_id", F.col("score").alias("x"))
    both = a.join(dense.select("query_id", "doc_id", F.col("score").alias("y")), ["query_id", "doc_id"], "full_outer")
    total = F.col("lexical") * F.coalesce("x", F.lit(0.0)) + F.col("dense") * F.coalesce("y", F.lit(0.0))
    scores = both.crossJoin(F.broadcast(settings)).select("setting", "query_id", "doc_id", F.round(total, DIGITS).alias("score"))
    return mean_ndcg(_ranked_settings(scores, 100), judged, settings).orderBy(F.desc("ndcg_10"), F.desc("lexical"))


def tuned_rrf(lexical: DataFrame, dense: DataFrame, judged: DataFrame, steps: tuple[float, ...] = (0.25, 0.5, 0.75), constants: tuple[int, ...] = (10, 30, 60, 100)) -> DataFrame:
    """Mean nDCG at 10 of each weight and constant; the first row is the best, larger weights and smaller constants on ties."""
    settings = _settings(judged.sparkSession, [(w, 1 - w, c) for w in steps for c in constants], "lexical double, dense double, constant int")
    both = lexical.select("query_id", "doc_id", F.col("rank").alias("x")).join(dense.select("query_id", "doc_id", F.col("rank").alias("y")), ["query_id", "doc_id"], "full_outer")
    part = lambda w, r: F.coalesce(F.col(w) / (F.col("constant") + F.col(r)), F.lit(0.0))
    scores = both.crossJoin(F.broadcast(settings)).select("setting", "query_id", "doc_id", F.round(part("lexical", "x") + part("dense", "y"), DIGITS + 3).alias("score"))
    return mean_ndcg(_ranked_settings(scores, 100), judged, settings).orderBy(F.desc("ndcg_10"), F.desc("lexical"), "constant")


def selected(rankings: dict[str, DataFrame], judged: DataFrame, preferred: str = "semantic") -> DataFrame:
    """Mean nDCG at 10 of each named ranking on development judgements; the first row is chosen, ``preferred`` on ties."""
    settings = _settings(judged.sparkSession, [(n,) for n in rankings], "name string")
    parts = [r.select(F.lit(n).alias("setting"), "query_id", "doc_id", "rank") for n, r in enumerate(rankings.values())]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return mean_ndcg(every, judged, settings).orderBy(F.desc("ndcg_10"), F.desc(F.col("name") == preferred), "name")


def case_metrics(ranks: DataFrame) -> DataFrame:
    """One row of means over ``ranks(case_id, rank, difficulty)``: recall at 1, 3, 5, MRR and nDCG at 3; a null rank is a miss."""
    hit = lambda k: F.coalesce(F.col("rank") <= k, F.lit(False))
    near = F.when(hit(3), 1 / F.col("rank")).otherwise(0.0)
    gain = F.when(hit(3), 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)
    mean = lambda c, name: F.round(F.coalesce(F.avg(c), F.lit(0.0)), DIGITS).alias(name)
    return ranks.agg(F.count("*").alias("n_cases"), *(mean(hit(k).cast("double"), f"recall_{k}") for k in (1, 3, 5)), mean(near, "mrr_3"), mean(gain, "ndcg_3"))


def difficulty_recall(ranks: DataFrame, k: int = 3) -> DataFrame:
    """``(difficulty, n_cases, recall)``."""
    return ranks.groupBy("difficulty").agg(F.count("*").alias("n_cases"), F.round(F.avg(F.coalesce(F.col("rank") <= k, F.lit(False)).cast("double")), DIGITS).alias("recall"))


def source_metrics(ranking: DataFrame, hits: DataFrame, expected: DataFrame, k: int = 10) -> DataFrame:
    """One row of means over the queries of ``expected(query_id, source, section)``: recall, MRR, nDCG by distinct source, and evidence hits.

    ``hits(doc_id, source, section)`` says where a ranked chunk comes from; a
    null expected section takes any.  Names are compared without case.
    """
    low = lambda c: F.lower(c)
    want = expected.select("query_id", low("source").alias("source"), low("section").alias("asked"))
    met = ranking.filter(F.col("rank") <= k).join(hits.select("doc_id", low("source").alias("source"), low("section").alias("section")), "doc_id").join(want, ["query_id", "source"])
    first = met.groupBy("query_id", "source").agg(F.min("rank").alias("rank"), F.max((F.col("asked").isNull() | (F.col("asked") == F.col("section"))).cast("int")).alias("strict"))
    per = first.groupBy("query_id").agg(F.min("rank").alias("best"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"), F.max("strict").alias("strict"))
    sizes = want.groupBy("query_id").agg(F.least(F.count_distinct("source"), F.lit(k)).alias("n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.col("n").cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    out = sizes.withColumn("ideal", ideal).join(per, "query_id", "left")
    mean = lambda c, name: F.round(F.avg(F.coalesce(c.cast("double"), F.lit(0.0))), DIGITS).alias(name)
    return out.agg(F.count("*").alias("n_cases"), mean(F.col("best").isNotNull(), "recall"), mean(1 / F.col("best"), "mrr"), mean(F.col("dcg") / F.col("ideal"), "ndcg"), mean(F.col("strict"), "evidence_hit_rate"))


def final_ids(calls: DataFrame, datasets: DataFrame) -> DataFrame:
    """``(doc_id, ord)``: ids of succeeded calls ``(ord, status, ids)`` and then of ``datasets(ord, id)``, each at its first place."""
    a = calls.filter("status = 'succeeded'").select(F.lit(0).alias("g"), "ord", F.posexplode("ids").alias("n", "doc_id"))
    b = datasets.select(F.lit(1).alias("g"), "ord", F.lit(0).alias("n"), F.col("id").alias("doc_id"))
    return a.union(b).filter("doc_id is not null and doc_id <> ''").groupBy("doc_id").agg(F.min(F.struct("g", "ord", "n")).alias("ord"))


def cross_encoder(logits) -> object:
    """A reranker for ``search`` from a function ``pairs -> logit column`` over ``(query_id, doc_id, query, text)``; scores are its sigmoid."""

    def rerank_by(ranking: DataFrame, docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        pairs = ranking.select("query_id", "doc_id").join(docs.select("doc_id", "text"), "doc_id").join(queries.select("query_id", F.col("text").alias("query")), "query_id")
        scored = pairs.withColumn("score", F.round(1 / (1 + F.exp(-logits(F.col("query"), F.col("text")))), DIGITS))
        return ranked(scored, k)

    return rerank_by


def backend(wanted: str, available: dict[str, object], fallback: str = "hashing") -> tuple[object, list[str]]:
    """The named dense search and no warning, or the fallback and why."""
    if wanted in available:
        return available[wanted], []
    return available.get(fallback, hashing_search), [f"{wanted} is not available; {fallback} stands in and is no semantic model"]
