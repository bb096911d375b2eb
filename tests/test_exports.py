"""Workbooks and archives read back, and their manifests."""

import csv
import datetime as dt
import hashlib
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestone.sources import exports as E
from lodestone.sources import readers

SF = "/root/testdata/sf0.001"


def manifest(folder):
    return json.loads((folder / "manifest.json").read_text())


def test_letters():
    assert [E.letters(k) for k in (1, 26, 27, 52, 702, 703)] == ["A", "Z", "AA", "AZ", "ZZ", "AAA"]


@pytest.mark.parametrize("rows", [7, E.ROWS])
def test_workbooks_read_back(spark, tmp_path, rows):
    c = spark.read.parquet(f"{SF}/customer.parquet").repartition(3)
    files = E.write_workbooks(c, f"file://{tmp_path}", "Customers: [all]", ["c_custkey"], rows).collect()
    m = manifest(tmp_path)
    assert m["n_rows"] == c.count() == sum(f["n_rows"] for f in files)
    assert all(f["n_rows"] <= rows for f in files) and {f["file"] for f in files} == {f["file"] for f in m["files"]} == {p.name for p in tmp_path.glob("*.xlsx")}
    assert not [p for p in tmp_path.iterdir() if p.name.startswith(".part") and not p.name.endswith(".crc")]
    for f in files:
        assert hashlib.sha256((tmp_path / f["file"]).read_bytes()).hexdigest() == f["sha256"]
    assert m["columns"][3] == {"name": "c_acctbal", "type": "number"}
    cells = readers.workbook_cells(spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(str(tmp_path)))
    got = cells.withColumn("row", F.split_part("location", F.lit(":"), F.lit(2))).groupBy("path", "row").pivot("field", c.columns).agg(F.first("value"))
    back = sorted((int(r["c_custkey"]), r["c_name"], int(r["c_nationkey"]), float(r["c_acctbal"]), r["c_mktsegment"]) for r in got.collect())
    assert back == sorted(tuple(r) for r in c.collect())
    # the files follow the order
    first = [r["c_custkey"] for r in c.orderBy("c_custkey").collect()]
    order = []
    for f in m["files"]:
        part = got.filter(F.col("path").endswith(f["file"])).select(F.col("row").cast("int").alias("n"), "c_custkey").orderBy("n").collect()
        order += [int(r["c_custkey"]) for r in part]
    assert order == first


HARD = [("=1+1", 1.5, True, [1, None], dt.date(2020, 1, 2), 1 << 60), (None, None, None, None, None, None), ("<a> & \"b\"\x01\n乳腺 ", float("nan"), False, [], None, -3), ("-x", -0.0, None, [3], None, 0)]


def test_hard_cells(spark, tmp_path):
    df = spark.createDataFrame(HARD, "t string, f double, b boolean, a array<int>, d date, n long").coalesce(1)
    E.write_workbooks(df, f"file://{tmp_path}/x", order_by=["n"])
    cells = readers.workbook_cells(spark.read.format("binaryFile").load(f"{tmp_path}/x/*.xlsx"))
    got = {(int(r["location"].split(":")[1]), r["field"]): r["value"] for r in cells.collect()}
    # nulls first, then by n
    assert got[3, "t"] == "<a> & \"b\"\n乳腺 " and got[3, "a"] == "[]" and got[3, "f"] is None or got[3, "f"] == "nan"
    assert got[4, "t"] == "'-x" and got[5, "t"] == "'=1+1" and got[5, "a"] == "[1,null]" and got[5, "d"] == "2020-01-02" and got[5, "n"] == str(1 << 60) and got[5, "b"] == "TRUE"
    E.write_archives(df, f"file://{tmp_path}/z", order_by=["n"])
    (name,) = [f["file"] for f in manifest(tmp_path / "z")["files"]]
    with zipfile.ZipFile(tmp_path / "z" / name) as z:
        table = list(csv.reader(io.StringIO(z.read("rows.csv").decode("utf-8-sig"), newline="")))
        lines = [json.loads(x) for x in z.read("rows.json").decode().split("\n") if x]
    assert table[0] == df.columns and [r[0] for r in table[1:]] == ["", HARD[2][0], "'-x", "'=1+1"]
    assert [x["t"] for x in lines] == [None, HARD[2][0], "-x", "=1+1"] and lines[3]["n"] == 1 << 60


def test_errors(spark, tmp_path):
    df = spark.createDataFrame([("x" * (E.CELL_CHARS + 1),)], "t string")
    with pytest.raises(Exception, match="at most"):
        E.write_workbooks(df, f"file://{tmp_path}/a")
    E.write_archives(df, f"file://{tmp_path}/b")
    with pytest.raises(ValueError, match="no row"):
        E.write_archives(df.filter("t = ''"), f"file://{tmp_path}/c")
    with pytest.raises(ValueError, match="rows"):
        E.write_workbooks(df, f"file://{tmp_path}/d", rows=E.SHEET_ROWS)


def test_files_of_bounded_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(E, "FILE_BYTES", 1000)
    df = spark.range(200).select(F.col("id"), F.repeat(F.lit("x"), 40).alias("t")).coalesce(1)
    sizes = [f["n_rows"] for f in E.write_archives(df, f"file://{tmp_path}").collect()]
    assert sum(sizes) == 200 and len(sizes) > 5


def test_sources_stay_apart(spark, tmp_path):
    a, b, none = spark.range(5).toDF("a"), spark.range(3).select(F.lit("=x").alias("b")), spark.range(0).toDF("c")
    out = E.write_sources({"A": a, "none": none, "B": b}, f"file://{tmp_path}", "kept apart")
    got = {}
    for r in out.collect():
        got[r["source"]] = got.get(r["source"], 0) + r["n_rows"]
    assert got == {"A": 5, "B": 3}
    m = manifest(tmp_path)
    assert m["notice"] == "kept apart" and m["n_rows"] == 8 and [d["source"] for d in m["datasets"]] == ["A", "none", "B"]


def test_quality_report(spark):
    df = spark.createDataFrame([("x", None), ("NA", 1)], "a string, b int")
    got = {r["field"]: (r["n_filled"], r["n_rows"], r["share"], r["gate"]) for r in E.quality_report(df, ["a"]).collect()}
    assert got == {"a": (1, 2, 0.5, "REVIEW"), "b": (1, 2, 0.5, "PASS")}
    assert {r["gate"] for r in E.quality_report(df.limit(0), ["a"]).collect()} == {"REVIEW", "PASS"}
