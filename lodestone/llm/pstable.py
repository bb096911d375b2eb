"""Near-duplicate embeddings by Euclidean p-stable hashing.

Two vectors are linked when their labels are equal and their cosine is 0.93 or
more, which is a distance of 0.374 between the vectors at length 1.

1. Equal vectors of a label are one representative with its number of copies,
   counted before the shuffle, so that any share of the rows may be equal.
2. A table cuts ``projections`` Gaussian projections of the unit vectors into
   cells of width ``WIDTH``, from a random offset; vectors of one label and
   cell share a bucket.  Vectors and projections are taken as integers, so a
   vector has the same cells wherever they are computed again.
3. Buckets of one vector go.  A large bucket is cut into blocks of about
   ``BLOCK`` vectors, and its pairs of blocks are dealt over the tasks.
4. A task takes the cosines of a pair of blocks as one matrix product, in
   doubles.  Every linked pair counts in the first table that it shares, and
   no other.  Counts leave the task, and of the links only a spanning forest.
5. Components of the forests' links are the classes.

``tables`` follows from ``MISS``: the probability that a pair at the threshold
shares no bucket.  Closer pairs are missed far less often (at cosine 0.95 with
1e-6).  ``projections`` grows with the logarithm of the number of vectors, by
one rule for all sizes, so that a bucket of unlike vectors keeps its size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.shared import written
from .minhash import components
from .whiten import usable
from .words import GOLD, mix

THRESHOLD, WIDTH, MISS = 0.93, 2.0, 1e-4
#: Vectors of a block, and of a run that is taken together with others of its size.
BLOCK, SMALL = 512, 64
#: Unlike vectors that share a bucket on average, and projections of a table at least.
CROWD, FEWEST = BLOCK, 8
#: Integer units of a vector entry and of a projection entry.
UNIT, STEP = 1 << 14, 1 << 10
SEED = 12


def collision(distance: float, width: float = WIDTH) -> float:
    """Probability that one projection puts two vectors of this distance into one cell."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(n: int) -> tuple[int, int]:
    """``(projections, tables)`` for ``n`` vectors: unlike ones are at the distance of a right angle."""
    projections = max(FEWEST, math.ceil(math.log(max(n, 1) / CROWD) / -math.log(collision(math.sqrt(2)))))
    return projections, math.ceil(math.log(MISS) / math.log1p(-collision(math.sqrt(2 - 2 * THRESHOLD)) ** projections))


@lru_cache(4)
def _drawn(dims: int, projections: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, dims])
    lines = np.round(rng.standard_normal((dims, tables * projections)) * STEP)
    return lines, np.floor(rng.random(tables * projections) * WIDTH * UNIT * STEP)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows at length 1; a row is scaled by its largest entry first, so that squares neither overflow nor vanish."""
    x = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def buckets(units: np.ndarray, projections: int, tables: int) -> np.ndarray:
    """64-bit bucket names, ``vectors x tables``; all sums are integers below 2^53, so no order of summation changes them."""
    lines, offset = _drawn(units.shape[1], projections, tables)
    cells = np.floor((np.round(units * UNIT) @ lines + offset) / (WIDTH * UNIT * STEP)).astype(np.int64).view(np.uint64).reshape(len(units), tables, projections)
    out = np.broadcast_to(mix(np.arange(1, tables + 1, dtype=np.uint64) * GOLD), cells.shape[:2])
    for k in range(projections):
        out = mix((out + GOLD) ^ cells[:, :, k])
    return out.view(np.int64)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dims)


def _entries(projections: int, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(batch.column("vector").value_lengths())
            for dims in np.unique(sizes):
                rows = batch.take(pa.array(np.flatnonzero(sizes == dims)))
                for a in range(0, rows.num_rows, 1024):
                    part = rows.slice(a, 1024)
                    keys = buckets(unit(_matrix(part.column("vector"), dims)), projections, tables)
                    at = pa.array(np.repeat(np.arange(part.num_rows), tables))
                    yield pa.RecordBatch.from_arrays([part.column("rep").take(at), part.column("label").take(at), pa.array(np.full(len(at), dims, np.int32)), pa.array(np.tile(np.arange(tables, dtype=np.int32), part.num_rows)), pa.array(keys.reshape(-1))], names=["rep", "label", "dims", "turn", "key"])

    return run


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node of each node's component, for links ``a, b`` among ``n`` nodes."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while not np.array_equal(up := root[root], root):
            root = up
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    length = lambda v: np.sqrt((v * v).sum(axis=-1))
    return (x @ np.swapaxes(y, -1, -2)) / (length(x)[..., :, None] * length(y)[..., None, :])


def _near(rows: pa.Table, cuts: list[int], vectors: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the linked pairs inside each run; small runs of a size and width go through one product."""
    get = lambda c: rows[c].to_numpy()
    start, size = np.array(cuts[:-1]), np.diff(cuts)
    block, p, q, dims = get("block"), get("p")[start], get("q")[start], get("dims")[start]
    found = []
    small = (p == q) & (size <= SMALL)
    for d, n in sorted(set(zip(dims[small].tolist(), size[small].tolist()))):
        at = start[small & (dims == d) & (size == n)]
        for part in np.array_split(at, -(-len(at) * n * (n + d) // (1 << 20)) or 1):
            index = part[:, None] + np.arange(n)
            x = np.stack([vectors[k] for k in index.reshape(-1)]).reshape(len(part), n, d)
            run, i, j = np.nonzero(np.triu(_cosines(x, x) >= THRESHOLD, 1))
            found.append((index[run, i], index[run, j]))
    for k in np.flatnonzero(~small):
        own = np.arange(start[k], start[k] + size[k])
        left, right = (own, own) if p[k] == q[k] else (own[block[own] == p[k]], own[block[own] == q[k]])
        if len(left) and len(right):
            near = _cosines(np.stack([vectors[r] for r in left]), np.stack([vectors[r] for r in right])) >= THRESHOLD
            i, j = np.nonzero(np.triu(near, 1) if p[k] == q[k] else near)
            found.append((left[i], right[j]))
    return tuple(np.concatenate([f[side] for f in found]) if found else np.empty(0, np.int64) for side in (0, 1))


def _links_of(rows: pa.Table, cuts: list[int], projections: int, tables: int) -> pa.RecordBatch:
    """Counts and forest links of whole runs."""
    get = lambda c: rows[c].to_numpy()
    rep, copies, turn, dims = get("rep"), get("copies"), get("turn"), get("dims")
    flat = rows["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float)
    ends = np.cumsum(dims)
    vectors = [flat[e - d : e] for e, d in zip(ends.tolist(), dims.tolist())]
    vectors = [v / np.abs(v).max() for v in vectors]
    i, j = _near(rows, cuts, vectors)
    new = turn[i] == 0
    for d in np.unique(dims[i]):
        # the pair counts in the first table that it shares
        of = np.flatnonzero((dims[i] == d) & ~new)
        if len(of):
            some, place = np.unique(np.concatenate([i[of], j[of]]), return_inverse=True)
            keys = buckets(unit(np.stack([vectors[k] for k in some])), projections, tables)
            x, y = place[: len(of)], place[len(of) :]
            for a in range(0, len(of), 65536):
                met = keys[x[a : a + 65536]] == keys[y[a : a + 65536]]
                new[of[a : a + 65536]] = met.argmax(axis=1) == turn[i[of[a : a + 65536]]]
    i, j = i[new], j[new]
    n = np.zeros(len(rep), np.int64)
    np.add.at(n, i, copies[j])
    np.add.at(n, j, copies[i])
    root = forest(len(rep), i, j)
    who, place = np.unique(rep[n > 0], return_inverse=True)
    total = np.zeros(len(who), np.int64)
    np.add.at(total, place, n[n > 0])
    child = np.flatnonzero(root != np.arange(len(rep)))
    none = lambda k: pa.nulls(k, pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([who, rep[root[child]]])), pa.concat_arrays([none(len(who)), pa.array(rep[child])]), pa.concat_arrays([pa.array(total), none(len(child))])], names=["a", "b", "n"])


def _block_links(projections: int, tables: int):
    """Whole runs of rows of equal ``label, dims, key, p, q``; the last run of a batch waits for the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = (pa.concat_tables([held, table]) if held is not None else table).combine_chunks()
            cuts = _cuts(table)
            if cuts[-2]:
                yield _links_of(table.slice(0, cuts[-2]), cuts[:-1], projections, tables)
            held = table.slice(cuts[-2])
        if held is not None and held.num_rows:
            yield _links_of(held, [0, held.num_rows], projections, tables)

    return run


def _cuts(table: pa.Table) -> list[int]:
    change = np.zeros(max(table.num_rows - 1, 0), bool)
    for c in ("label", "dims", "key", "p", "q"):
        x = table[c].to_numpy()
        change |= x[1:] != x[:-1]
    return [0, *(np.flatnonzero(change) + 1).tolist(), table.num_rows] if table.num_rows else [0, 0]


def links(reps: DataFrame, n: int) -> DataFrame:
    """``(a, b, n)`` for ``reps(rep, label, vector, copies)``: rows without ``b`` add ``n`` copies linked to ``a``, the others link ``a`` and ``b``."""
    projections, tables = plan(n)
    entries = written(reps.mapInArrow(_entries(projections, tables), "rep long, label string, dims int, turn int, key long"), "entries")
    bucket = ["label", "dims", "key"]
    blocks = entries.groupBy(*bucket).agg(F.count("*").alias("n")).filter("n > 1").select(*bucket, F.ceil(F.col("n") / BLOCK).alias("blocks"))
    own = F.pmod(F.xxhash64("rep", "key"), F.col("blocks"))
    met = entries.join(blocks, bucket).withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = met.select("rep", *bucket, "turn", "block", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"))
    sent = met.join(reps.select("rep", "vector", "copies"), "rep")
    parts = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*bucket, "p", "q"]
    return sent.repartition(parts, *order).sortWithinPartitions(*order).mapInArrow(_block_links(projections, tables), "a long, b long, n long")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """One row per row of ``vectors``: ``vec_id, n_links, component_id, kept``.

    Vectors that are null, empty, zero or hold null or non-finite entries, and
    rows with a null label, link with nothing: they have no links and are
    their own component.  Vectors of different lengths are not linked.  Rows
    that repeat an id are vectors of their own, and so are rows with a null
    id, whose ``component_id`` is the least id that their links reach, or
    null, and which are not kept.  An empty table gives an empty result; other
    columns are not read.
    """
    v = F.col("vector")
    named = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("vector"))
    fit = usable(named.filter("label is not null"), "vector").filter(F.exists(v, lambda c: c != 0))
    groups = fit.groupBy("label", "vector").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"))
    reps = written(groups.withColumn("rep", F.monotonically_increasing_id()), "vectors")
    found = written(links(reps, reps.count()), "links")
    totals = found.filter("n is not null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    label = components(found.filter("b is not null").select("a", "b"))
    linked = reps.select("rep", "label", "vector", "first_id", "copies").join(totals, "rep", "left").join(label.select(F.col("id").alias("rep"), F.col("label").alias("component")), "rep", "left")
    linked = written(linked.select("label", "vector", "first_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component")), "linked")
    least = linked.groupBy("component").agg(F.min("first_id").alias("component_id"))
    known = linked.join(least, "component").select(F.col("label").alias("rep_label"), F.col("vector").alias("rep_vector"), "n_links", "component_id")
    out = named.join(known, (F.col("label") == F.col("rep_label")) & (F.col("vector") == F.col("rep_vector")), "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
