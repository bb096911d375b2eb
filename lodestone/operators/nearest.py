"""The rows of a pool whose names are nearest to a name, by the ratio of matching blocks, exactly.

The ratio of two names is at most twice their common characters, counted with
repeats, over their lengths, and at most what their lengths allow.  Names are
taken once each and packed into blocks of neighbouring lengths.

1. A block of asked names meets the one block of its pool that is nearest in
   length: the ratio of each name's ``k``-th row there is a floor.
2. It then meets the other blocks whose lengths still allow that floor.  A
   task gets the bounds of two blocks as one product of character counts and
   takes names by falling bound until no bound reaches the ``k``-th row.

So the dear ratio is taken for few names, and no row is compared with its
whole pool.  A name's rows go with it as their ``k`` least ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written

#: Names of a block.
BLOCK = 512


def _blocks(names: DataFrame, ids: str | None) -> DataFrame:
    """``(pool, block, low, high, names[, ids])`` of ``names(pool, name[, ids])``, by length."""
    columns = ["pool", "name", *(["ids"] if ids else [])]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def out() -> pa.RecordBatch:
            size = [len(r["name"]) for r in held]
            made = [pa.array([held[0]["pool"]]), pa.array([min(size)]), pa.array([max(size)]), pa.array([[r["name"] for r in held]])]
            return pa.RecordBatch.from_arrays([*made, *([pa.array([[r["ids"] for r in held]])] if ids else [])], names=["pool", "low", "high", "names", *(["ids"] if ids else [])])

        for batch in batches:
            for r in batch.to_pylist():
                if held and (len(held) >= BLOCK or held[0]["pool"] != r["pool"]):
                    yield out()
                    held.clear()
                held.append(r)
        if held:
            yield out()

    size = F.length("name")
    sorted_ = names.select(*columns).repartitionByRange("pool", size, "name").sortWithinPartitions("pool", size, "name")
    schema = "pool string, low long, high long, names array<string>" + (f", ids array<array<{ids}>>" if ids else "")
    return sorted_.mapInArrow(pack, schema).withColumn("block", F.monotonically_increasing_id())


def bounds(left: list[str], right: list[str]) -> np.ndarray:
    """Twice the common characters over the sum of lengths, for every pair; never below the ratio."""

    def counted(names: list[str]) -> dict[tuple[str, int], list[int]]:
        cells: dict[tuple[str, int], list[int]] = {}
        for n, name in enumerate(names):
            seen: dict[str, int] = {}
            for c in name:
                seen[c] = seen.get(c, 0) + 1
                cells.setdefault((c, seen[c]), []).append(n)
        return cells

    a, b = counted(left), counted(right)
    common = [c for c in a if c in b]
    x, y = np.zeros((len(left), len(common)), np.float32), np.zeros((len(right), len(common)), np.float32)
    for k, c in enumerate(common):
        x[a[c], k] = 1
        y[b[c], k] = 1
    size = np.array([len(n) for n in left])[:, None] + np.array([len(n) for n in right])[None, :]
    return 2.0 * (x @ y.T).astype(float) / np.maximum(size, 1)


def nearest_rows(left: list[str], right: list[str], ids: list[list], k: int, floor: list[float]) -> list[list[tuple[float, object]]]:
    """For each name of ``left`` the first ``k`` rows ``(ratio, id)`` of ``right`` by ratio and then id, none of ratio 0 or below its floor."""
    bound, out = bounds(left, right), []
    matcher = SequenceMatcher(None)
    for i, name in enumerate(left):
        order = np.argsort(-bound[i], kind="stable")
        rows: list[tuple[float, object]] = []
        found: list[tuple[float, int]] = []
        least = max(floor[i], 0.0)
        for j in order.tolist():
            u = bound[i, j]
            if u <= 0 or u < least:
                break
            matcher.set_seqs(name, right[j])
            r = 1.0 if name == right[j] else matcher.ratio()
            if r > 0 and r >= least:
                found.append((r, j))
                rows += [(-r, x) for x in ids[j]]
                if len(rows) >= 2 * k or (len(rows) >= k and len(found) % 16 == 0):
                    rows = sorted(rows)[:k]
                    least = max(least, -rows[-1][0]) if len(rows) == k else least
        out.append([(-r, x) for r, x in sorted(rows)[:k]])
    return out


def nearest(asked: DataFrame, pool: DataFrame, k: int = 100) -> DataFrame:
    """``(pool, name, id, ratio)``: the first ``k`` rows of ``pool(pool, name, id)`` for each ``asked(pool, name)``, by ratio and then id.

    Rows of ratio 0 are not given; empty and null names have none.
    """
    kind = dict(pool.dtypes)["id"]
    order = Window.partitionBy("pool", "name").orderBy("id")
    first = pool.filter("name <> ''").withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= k)
    right = written(_blocks(first.groupBy("pool", "name").agg(F.collect_list("id").alias("ids")), kind), "right-names")
    left = written(_blocks(asked.filter("name <> ''").select("pool", "name").distinct(), None), "left-names")
    a = left.select("pool", F.col("block").alias("a"), F.col("low").alias("low_a"), F.col("high").alias("high_a"))
    b = right.select("pool", F.col("block").alias("b"), F.col("low").alias("low_b"), F.col("high").alias("high_b"))
    gap = F.greatest(F.lit(0), F.col("low_b") - F.col("high_a"), F.col("low_a") - F.col("high_b"))
    # twice the shorter length over the sum, at the ends that are nearest
    reach = F.when(gap == 0, 1.0).when(F.col("low_b") > F.col("high_a"), 2 * F.col("high_a") / (F.col("high_a") + F.col("low_b"))).otherwise(2 * F.col("high_b") / (F.col("high_b") + F.col("low_a")))
    pairs = written(a.join(b, "pool").select("a", "b", gap.alias("gap"), reach.alias("reach")), "blocks")  # pairs of blocks, not of names
    start = pairs.groupBy("a").agg(F.min(F.struct("gap", "b")).alias("x")).select("a", F.col("x.b").alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                floor = r["floors"] or [0.0] * len(r["names"])
                found = nearest_rows(r["names"], r["right"], r["ids"], k, floor)
                flat = [{"pool": r["pool"], "a": r["a"], "n": n, "name": name, "id": i, "ratio": s} for n, (name, rows) in enumerate(zip(r["names"], found)) for s, i in rows]
                yield pa.RecordBatch.from_pylist(flat, schema=schema)

    schema = pa.schema([("pool", pa.string()), ("a", pa.int64()), ("n", pa.int64()), ("name", pa.string()), ("id", pa.string() if kind == "string" else pa.int64()), ("ratio", pa.float64())])
    out = f"pool string, a long, n long, name string, id {'string' if kind == 'string' else 'long'}, ratio double"

    def met(which: DataFrame, floors: DataFrame | None) -> DataFrame:
        x = which.select("a", "b").join(left.select(F.col("block").alias("a"), "pool", "names"), "a")
        x = x.join(right.select(F.col("block").alias("b"), F.col("names").alias("right"), "ids"), "b")
        x = x.join(floors, "a", "left") if floors is not None else x.withColumn("floors", F.lit(None).cast("array<double>"))
        return x.select("pool", "a", "names", "right", "ids", "floors").mapInArrow(run, out)

    seed = written(met(start, None), "seed")
    per = seed.groupBy("a", "n").agg(F.when(F.count("*") >= k, F.min("ratio")).otherwise(0.0).alias("floor"))
    size = left.select(F.col("block").alias("a"), F.explode(F.sequence(F.lit(0), F.size("names") - 1)).alias("n"))
    floors = size.join(per.withColumn("n", F.col("n").cast("int")), ["a", "n"], "left").groupBy("a").agg(F.array_sort(F.collect_list(F.struct("n", F.coalesce("floor", F.lit(0.0)).alias("f")))).alias("x"))
    floors = written(floors.select("a", F.col("x.f").alias("floors")), "floors")
    rest = pairs.join(start, ["a", "b"], "left_anti").join(floors, "a").filter(F.col("reach") >= F.array_min("floors")).select("a", "b")
    every = seed.union(met(rest, floors))
    place = F.row_number().over(Window.partitionBy("pool", "name").orderBy(F.desc("ratio"), "id"))
    return every.withColumn("place", place).filter(F.col("place") <= k).select("pool", "name", "id", "ratio")
