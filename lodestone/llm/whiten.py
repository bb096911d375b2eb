"""Whitening of embeddings from an exact integer scatter matrix.

Each entry ``c`` becomes the integer ``x = floor(64 c) + SHIFT``; the fit list
holds every distinct ``x`` vector once.  Its sums and cross-products are taken
after ``SHIFT`` is subtracted again, in integers: a task multiplies slices in
doubles only where every product sum is below 2^53, keeps its totals as Python
integers, and sends them as signed limbs of 30 bits, whose sums Spark adds in
64-bit columns.  So no partial result is ever rounded, whatever the size of the
table.  The driver gets one row for each pair of dimensions, forms
``n XtX - S St`` in integers, and only then converts and decomposes it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.shared import written

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Wider vectors are an error: the driver holds one row for each pair of dimensions.
MOST_DIMENSIONS = 4096
#: Vectors of a slice.
SLICE = 1024
#: 30-bit limbs of a total; 63-bit entries, squared, of 2^63 vectors take 190 bits.
LIMBS, LIMB_BITS = 7, 30
#: Entries from here on have no 64-bit ``x``.
LARGEST = 2.0**56
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def usable(vectors: DataFrame, vector_col: str) -> DataFrame:
    """Rows whose vector has entries, all of them finite."""
    v = F.col(vector_col)
    return vectors.filter(F.coalesce(F.size(v), F.lit(0)) > 0).filter(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))


def _integers(column: pa.Array, dims: int) -> np.ndarray:
    """Shifted integers ``x - SHIFT`` of a slice, one row for each vector."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims) - SHIFT


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, SLICE):
            yield batch.slice(a, SLICE)


def products(z: np.ndarray) -> np.ndarray:
    """``zT z`` without rounding, as Python integers."""
    most = int(np.abs(z).max(initial=0))
    if most * most * max(len(z), 1) < 1 << 53:
        f = z.astype(float)
        return (f.T @ f).astype(np.int64).astype(object)
    big = z.astype(object)
    return big.T @ big


def limbs(values: list[int]) -> list[pa.Array]:
    """Columns of signed limbs, the lowest first."""
    mask = (1 << LIMB_BITS) - 1
    return [pa.array([(abs(v) >> LIMB_BITS * k & mask) * (1 if v >= 0 else -1) for v in values], pa.int64()) for k in range(LIMBS)]


def _scatter(dims: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, p = 0, np.zeros(dims, object), np.zeros((dims, dims), object)
        for part in _slices(batches):
            z = _integers(part.column("x"), dims)
            n += len(z)
            s = s + z.astype(object).sum(axis=0) if int(np.abs(z).max(initial=0)) * len(z) >= 1 << 62 else s + z.sum(axis=0).astype(object)
            p = p + products(z)
        if n:
            i, j = np.triu_indices(dims)
            i, j = np.concatenate([[-1], np.full(dims, -1), i]), np.concatenate([[-1], np.arange(dims), j])
            values = [n, *map(int, s), *map(int, p[np.triu_indices(dims)])]
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), *limbs(values)], names=["i", "j", *(f"l{k}" for k in range(LIMBS))])

    return run


def moments(fit: DataFrame, dims: int) -> tuple[int, list[int], np.ndarray]:
    """Exact ``(n, S, XtX)`` of ``fit(x)`` after ``SHIFT`` is subtracted; the matrix holds Python integers."""
    names = [f"l{k}" for k in range(LIMBS)]
    parts = fit.mapInArrow(_scatter(dims), "i int, j int, " + ", ".join(f"{c} long" for c in names))
    n, s, p = 0, [0] * dims, np.zeros((dims, dims), object)
    for r in parts.groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in names)).toLocalIterator():  # one row for each pair of dimensions
        total = sum(r[c] << LIMB_BITS * k for k, c in enumerate(names))
        if r["i"] >= 0:
            p[r["i"], r["j"]] = p[r["j"], r["i"]] = total
        elif r["j"] >= 0:
            s[r["j"]] = total
        else:
            n = total
    return n, s, p


def principal(n: int, s: list[int], p: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, float]:
    """``(eigenvalues, eigenvectors in columns, trace)`` of the covariance, falling; at most ``most``, none that is 0 to double precision.

    The entry of largest size of each eigenvector is positive.
    """
    s = np.array(s, object)
    exact = n * p - np.outer(s, s)
    v = np.array([[x / (n * n) for x in row] for row in exact], float)
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    keep = min(most, int((e > max(e[0], 0.0) * len(e) * np.finfo(float).eps).sum()))
    e, u = e[:keep], u[:, :keep]
    u = u * np.where(u[np.abs(u).argmax(axis=0), np.arange(keep)] < 0, -1.0, 1.0)
    return e, u, sum(int(x) for x in exact.diagonal()) / (n * n)


def _centred(z: np.ndarray, n: int, s: list[int]) -> np.ndarray:
    """``n z - S`` without rounding: 64-bit integers where they suffice."""
    if n * int(np.abs(z).max(initial=0)) + max(map(abs, s)) < 1 << 62:
        return n * z - np.array(s, np.int64)
    return n * z.astype(object) - np.array(s, object)


def _deviation(c: np.ndarray) -> pa.Array:
    if c.dtype != object:
        most = int(np.abs(c).max(initial=0))
        if most * most * c.shape[1] < 1 << 63:
            return pa.array((c * c).sum(axis=1))
        c = c.astype(object)
    return pa.array([x if x < 1 << 63 else None for x in map(int, (c * c).sum(axis=1))], pa.int64())


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``.

    Vectors that are null or empty or hold null or non-finite entries are left
    out, and so are entries of 2^56 and more, which have no 64-bit ``x``, and
    vectors of another length than the commonest (the longer one on ties).
    Rows that repeat an id or a vector, and rows with a null id, each have
    their result; equal ``x`` vectors count once in the fit list.  Components
    whose eigenvalue is 0 are not returned, so one distinct vector, or none,
    gives an empty result.  A ``deviation`` beyond 64 bits is null.  Other
    columns are not read.
    """
    spark = vectors.sparkSession
    v = F.col(vector_col)
    rows = usable(vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias(vector_col)), vector_col).filter(F.forall(v, lambda c: F.abs(c) < LARGEST))
    rows = rows.select("vec_id", F.transform(v, lambda c: F.floor(c * float(SCALE)) + SHIFT).alias("x"))
    common = rows.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    if common is None:
        return spark.createDataFrame([], OUT)
    dims = common["dims"]
    if dims > MOST_DIMENSIONS:
        raise ValueError(f"vectors may have {MOST_DIMENSIONS} dimensions, not {dims}")
    rows = rows.filter(F.size("x") == dims)
    fit = written(rows.select("x").distinct(), "fit")
    n, s, p = moments(fit, dims)
    e, u, trace = principal(n, s, p, components)
    if not len(e):
        return spark.createDataFrame([], OUT)
    onto = u / np.sqrt(e)

    def project(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c = _centred(z, n, s)
        return c, (c / n).astype(float) @ onto

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, total, cross = len(e), np.zeros(len(e)), np.zeros((len(e), len(e)))
        for part in _slices(batches):
            w = project(_integers(part.column("x"), dims))[1]
            total, cross = total + w.sum(axis=0), cross + w.T @ w
        i, j = np.divmod(np.arange(k * k), k)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.full(k, -1), i]), pa.int32()), pa.array(np.concatenate([np.arange(k), j]), pa.int32()), pa.array(np.concatenate([total, cross.reshape(-1)]))], names=["i", "j", "t"])

    mean, cross = np.zeros(len(e)), np.zeros((len(e), len(e)))
    for r in fit.mapInArrow(check, "i int, j int, t double").groupBy("i", "j").agg(F.sum("t").alias("t")).collect():  # one row for each pair of components
        if r["i"] < 0:
            mean[r["j"]] = r["t"] / n
        else:
            cross[r["i"], r["j"]] = r["t"] / n
    error = float(np.abs(cross - np.outer(mean, mean) - np.eye(len(e))).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(e)
        for part in _slices(batches):
            c, w = project(_integers(part.column("x"), dims))
            at = pa.array(np.repeat(np.arange(part.num_rows), k))
            tiled = lambda x: pa.array(np.tile(x, part.num_rows))
            full = lambda x: pa.array(np.full(k * part.num_rows, x))
            yield pa.RecordBatch.from_arrays(
                [part.column("vec_id").take(at), tiled(np.arange(1, k + 1, dtype=np.int32)), full(np.int64(n)), _deviation(c).take(at), pa.array(w.reshape(-1)), tiled(e / trace), full(error)],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, OUT)
