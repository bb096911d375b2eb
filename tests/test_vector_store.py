"""The vector store against brute force: upserts, reload, skipped cells."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators.vectors import VectorStore
from lodestone.shared import new_path

ROW = "id long, vector array<double>, note string"


def brute(rows, queries, k):
    out = []
    unit = lambda v: np.array(v) / (np.linalg.norm(v) or 1)
    for q, v in queries:
        scored = sorted((-round(float(unit(v) @ unit(x)), 6) + 0.0, i) for i, x in rows.items())[:k]
        out += [(q, i, max(0.0, -s), n) for n, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def test_search_is_exact_and_skips_cells(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((30, 16))
    rows = {k: (centres[k % 30] + 0.05 * rng.standard_normal(16)).tolist() for k in range(900)}
    rows[900], rows[901] = [0.0] * 16, rows[5]
    path = new_path(spark, "store")
    store = VectorStore(spark, path, 16, cells=24)
    first = [(k, v, "old") for k, v in rows.items() if k < 500] + [(k, (-np.array(rows[k])).tolist(), "wrong") for k in range(500, 600)]
    bad = [(None, rows[0], "x"), (7000, [1.0], "x"), (7001, None, "x"), (7002, [float("nan")] * 16, "x"), (7003, [None] * 16, "x")]
    assert store.upsert(spark.createDataFrame(first + bad, ROW)) == 1
    before = {r["id"] for r in store.rows().collect()}
    assert before == set(range(600))
    assert store.upsert(spark.createDataFrame([(k, v, "new") for k, v in rows.items() if k >= 500], ROW)) == 2
    again = VectorStore(spark, path, 16, cells=24)
    kept = {r["id"]: r for r in again.rows().collect()}
    assert set(kept) == set(rows) and again.rows().count() == len(rows) and all(kept[k]["note"] == ("old" if k < 500 else "new") for k in rows)
    assert {r["id"] for r in again.rows(version=1).collect()} == before  # an older version stays readable
    asked = [(k, (np.array(rows[k]) + 0.01).tolist()) for k in range(0, 900, 60)] + [(9000, [0.0] * 16), (9001, (-centres[3]).tolist())]
    got, share = again.search(spark.createDataFrame(asked, "query_id long, vector array<double>"), 7)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, asked, 7)
    near, share = again.search(spark.createDataFrame(asked[:-2], "query_id long, vector array<double>"), 7)
    assert sorted(tuple(r) for r in near.collect()) == brute(rows, asked[:-2], 7) and share < 0.6


def test_small_stores(spark):
    path = new_path(spark, "store")
    store = VectorStore(spark, path, 2, cells=4)
    query = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<double>")
    assert store.version() == 0 and store.rows() is None and store.search(query)[0].collect() == []
    store.upsert(spark.createDataFrame([(3, [2.0, 0.0], "a"), (3, [1.0, 0.0], "b"), (4, [0.0, 0.0], "c")], ROW))
    assert [tuple(r) for r in store.search(query)[0].orderBy("rank").collect()] == [(1, 3, 1.0, 1), (1, 4, 0.0, 2)]
    store.upsert(spark.createDataFrame([], ROW))
    assert store.rows().count() == 2
    with pytest.raises(ValueError, match="cells"):
        VectorStore(spark, path, 2, cells=0)


def test_a_write_without_its_manifest_changes_nothing(spark, monkeypatch):
    store = VectorStore(spark, new_path(spark, "store"), 2, cells=2)
    store.upsert(spark.createDataFrame([(k, [1.0, float(k)], "a") for k in range(20)], ROW))
    monkeypatch.setattr(store.spark, "createDataFrame", lambda *a, **b: 1 / 0)
    extra = spark.range(5).select(F.col("id"), F.array(F.lit(1.0), F.lit(2.0)).alias("vector"), F.lit("b").alias("note"))
    with pytest.raises(ZeroDivisionError):
        store.upsert(extra)
    assert store.version() == 1 and {r["note"] for r in store.rows().collect()} == {"a"}
    monkeypatch.undo()
    assert store.upsert(extra) == 2 and store.rows().filter("note = 'b'").count() == 5
