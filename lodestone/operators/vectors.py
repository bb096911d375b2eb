"""A store of vectors that persists: upsert by id, reload, and exact search that skips cells.

A store is a folder that the cluster shares.  ``centres`` holds the cells'
centres, drawn once from the first vectors.  Every upsert writes the cells
that it touches anew under ``data/version=N`` and then a manifest that says
which version of each cell counts, with its size and radius; what has no
manifest is not there, so a write that is cut off changes nothing, and readers
of an older manifest go on undisturbed.

Vectors are stored at length 1.  A vector of a cell is no nearer to a query
than the centre's distance less the cell's radius (triangle inequality), so a
search that knows its ``k``-th distance opens no cell beyond it and is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .lexical import DIGITS, head

#: Cells of a store and queries of a search at most; both are held by every task.
MOST_CELLS, MOST_QUERIES = 4096, 1 << 16
#: The cell of vectors without a direction.
ZERO = -1
SLICE = 1024


def _unit(flat: np.ndarray, dims: int) -> np.ndarray:
    x = flat.astype(float).reshape(-1, dims)
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


class VectorStore:
    """Vectors ``(id, vector)`` with any further columns, in the folder ``path``.

    Ids are integers and not null; rows of an upsert that repeat an id are
    taken once, with the greatest vector.  Vectors of another length than the
    store's, or with null or non-finite entries, are an error for the caller
    to filter: they are left out and counted by ``upsert``'s result.
    """

    def __init__(self, spark: SparkSession, path: str, dims: int, cells: int = 64, id_col: str = "id", vector_col: str = "vector") -> None:
        if not 1 <= cells <= MOST_CELLS:
            raise ValueError(f"a store has 1 to {MOST_CELLS} cells")
        self.spark, self.path, self.dims, self.cells, self.id, self.vector = spark, path.rstrip("/"), dims, cells, id_col, vector_col

    def _there(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/_SUCCESS")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def version(self) -> int:
        """Of the newest whole manifest; 0 for an empty store."""
        fs = self.spark._jvm.org.apache.hadoop.fs
        path = fs.Path(f"{self.path}/manifest")
        system = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in system.listStatus(path)] if system.exists(path) else []
        return max((int(n.split("=")[1]) for n in names if n.startswith("version=") and self._there(f"manifest/{n}")), default=0)

    def manifest(self, version: int | None = None) -> list:
        """``(cell, version, n, radius)`` of every cell, at most one row for each."""
        version = self.version() if version is None else version
        return self.spark.read.parquet(f"{self.path}/manifest/version={version}").collect() if version else []

    def rows(self, cells: list[int] | None = None, version: int | None = None) -> DataFrame | None:
        """The stored rows with their ``cell``, of some cells or of all; none of an empty store."""
        known = [r for r in self.manifest(version) if cells is None or r["cell"] in set(cells)]
        parts: dict[int, list[int]] = {}
        for r in known:
            parts.setdefault(r["version"], []).append(r["cell"])
        out = None
        for v, names in sorted(parts.items()):
            df = self.spark.read.parquet(f"{self.path}/data/version={v}").filter(F.col("cell").isin(names))  # reads these folders alone
            out = df if out is None else out.unionByName(df)
        return out

    def centres(self, rows: DataFrame | None = None) -> np.ndarray:
        """Unit centres in order of their cells; drawn from ``rows`` by a hash of the id if the store has none yet."""
        if not self._there("centres"):
            drawn = rows.filter(F.exists(self.vector, lambda c: c != 0)).orderBy(F.xxhash64(self.id), self.id).limit(self.cells)
            drawn.select(F.col(self.vector).cast("array<double>").alias("centre")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/centres")
        found = self.spark.read.parquet(f"{self.path}/centres").orderBy("centre").limit(MOST_CELLS).collect()
        return _unit(np.array([r["centre"] for r in found], float).reshape(-1), self.dims) if found else np.zeros((0, self.dims))

    def upsert(self, rows: DataFrame) -> int:
        """Put rows in, in place of those of the same id; the new version.

        Reads the ids of the store and the cells that change, nothing else.
        """
        v, version = F.col(self.vector), self.version()
        fit = rows.filter(F.col(self.id).isNotNull()).filter(F.size(v) == self.dims).filter(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
        fit = fit.groupBy(F.col(self.id).alias("_id")).agg(F.max_by(F.struct(*rows.columns), v).alias("row")).select("row.*")
        centres = self.centres(fit)
        dims, vector = self.dims, self.vector

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a in range(0, batch.num_rows, SLICE):
                    part = batch.slice(a, SLICE)
                    x = _unit(part.column(vector).flatten().to_numpy(zero_copy_only=False), dims)
                    near = x @ centres.T if len(centres) else np.zeros((len(x), 1))
                    cell = np.where((x != 0).any(axis=1), near.argmax(axis=1), ZERO)
                    far = np.sqrt(np.maximum(0.0, 2 - 2 * near.max(axis=1)))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array(np.where(cell == ZERO, 0.0, far))], names=[*part.schema.names, "cell", "far"])

        schema = ", ".join(f"`{c}` {t}" for c, t in fit.dtypes) + ", cell int, far double"
        placed = fit.mapInArrow(place, schema)
        old, known = self.rows(version=version), {r["cell"]: r for r in self.manifest(version)}
        fresh = f"{self.path}/data/version={version + 1}"
        if old is None:
            whole = placed
        else:
            ids = fit.select(self.id)
            moved = {r["cell"] for r in old.select(self.id, "cell").join(ids, self.id, "left_semi").select("cell").distinct().collect()}  # cells
            touched = sorted(moved | {r["cell"] for r in placed.select("cell").distinct().collect()})
            kept = self.rows(touched, version)
            kept = kept.join(ids, self.id, "left_anti").select(placed.columns) if kept is not None else None
            whole = placed.unionByName(kept) if kept is not None else placed
            known = {c: r for c, r in known.items() if c not in set(touched)}
        whole.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(fresh)
        now = self.spark.read.schema(placed.schema).parquet(fresh).groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).collect()  # cells
        entries = [(r["cell"], r["version"], r["n"], r["radius"]) for r in known.values()] + [(r["cell"], version + 1, r["n"], r["radius"]) for r in now]
        self.spark.createDataFrame(entries, "cell int, version int, n long, radius double").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/version={version + 1}")
        return version + 1

    def search(self, queries: DataFrame, k: int = 10, query_col: str = "query_id") -> tuple[DataFrame, float]:
        """``(query_id, doc_id, score, rank)`` of the best ``k`` by cosine, and the share of (query, cell) pairs that were opened.

        ``queries(query_id, vector)`` is a stated set.  First the nearest
        cells that hold ``k`` vectors are opened, which gives the ``k``-th
        score; then every other cell that could hold a better or equal one.
        Ties go to the smaller id; scores below 0 are given as 0, in their
        order.  A vector or query without a direction has cosine 0.
        """
        asked = queries.select(F.col(query_col).cast("long").alias("q"), F.col(self.vector).cast("array<double>").alias("v")).filter(F.size("v") == self.dims).orderBy("q").limit(MOST_QUERIES + 1).collect()  # the stated query set
        if len(asked) > MOST_QUERIES:
            raise ValueError(f"a query set may have {MOST_QUERIES} queries; ask it in parts")
        none = self.spark.createDataFrame([], "query_id long, doc_id long, score double, rank long")
        known = sorted(self.manifest(), key=lambda r: r["cell"])
        if not asked or not known:
            return none, 0.0
        names = np.array([r["q"] for r in asked], np.int64)
        towards = _unit(np.array([r["v"] for r in asked], float).reshape(-1), self.dims)
        centres, cells = self.centres(), np.array([r["cell"] for r in known])
        n, radius = np.array([r["n"] for r in known]), np.array([r["radius"] for r in known])
        away = np.sqrt(np.maximum(0.0, 2 - 2 * towards @ np.where((cells == ZERO)[:, None], 0.0, centres[np.maximum(cells, 0)] if len(centres) else 0.0).T))
        bound = np.where((towards != 0).any(axis=1)[:, None], np.maximum(0.0, away - radius), np.sqrt(2.0))
        order = np.argsort(bound, axis=1, kind="stable")
        before = np.cumsum(n[order], axis=1) - n[order]
        first = np.zeros(bound.shape, bool)
        np.put_along_axis(first, order, before < k, axis=1)
        best = self._within(names, towards, cells, first, k)
        last = {r["query_id"]: r["score"] for r in best.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("score")).filter(F.col("n") >= k).collect()}  # one row for each query
        # half a unit of the last digit, and the same again for rounding of the bounds
        reach = np.sqrt(np.maximum(0.0, 2 - 2 * (np.array([last.get(q, -1.0) for q in names.tolist()]) - 10.0**-DIGITS))) + 1e-9
        rest = ~first & (bound <= np.where([q in last for q in names.tolist()], reach, np.inf)[:, None])
        if rest.any():
            best = best.unionByName(self._within(names, towards, cells, rest, k))
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")).cast("long")
        out = best.withColumn("rank", place).filter(F.col("rank") <= k).withColumn("score", F.greatest(F.lit(0.0), "score"))
        return out.select("query_id", "doc_id", "score", "rank"), float((first | rest).mean())

    def _within(self, names: np.ndarray, towards: np.ndarray, cells: np.ndarray, opened: np.ndarray, k: int) -> DataFrame:
        """The best rows of each query among the cells that it opens; a task takes its rows cell by cell."""
        of = {int(c): np.flatnonzero(opened[:, j]) for j, c in enumerate(cells) if opened[:, j].any()}
        dims, ident = self.dims, self.id

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell = batch.column("cell").to_numpy()
                for c in np.unique(cell).tolist():
                    rows = batch.take(pa.array(np.flatnonzero(cell == c)))
                    for a in range(0, rows.num_rows, SLICE):
                        part, q = rows.slice(a, SLICE), of[c]
                        x = np.round(towards[q] @ _unit(part.column("v").flatten().to_numpy(zero_copy_only=False), dims).T, DIGITS)
                        found = head(names[q], part.column(ident).to_numpy().astype(np.int64), x, k, np.ones(x.shape, bool))
                        yield pa.RecordBatch.from_arrays([pa.array(f) for f in found], names=["query_id", "doc_id", "score"])

        rows = self.rows(sorted(of)).select(F.col(ident).cast("long").alias(ident), F.col(self.vector).cast("array<double>").alias("v"), F.col("cell").cast("int").alias("cell"))
        return rows.mapInArrow(run, "query_id long, doc_id long, score double")
