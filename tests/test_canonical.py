"""Canonical JSON against the standard library's, on nested records."""

import datetime as dt
import decimal
import hashlib
import json
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import canonical as J

SCHEMA = "z string, a struct<y:array<double>,x:map<string,bigint>,b:boolean>, m map<bigint,array<string>>, f double, d decimal(10,2), t date, Ts timestamp_ntz, n array<struct<q:int,p:string>>"


def plain(v):
    if isinstance(v, dict):
        return {k: plain(x) for k, x in v.items()}
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


def want(record):
    return json.dumps(plain(record), ensure_ascii=False, sort_keys=True, separators=(",", ":"), default=str)


FLOATS = [0.0, -0.0, 1.0, -1.5, 0.1, 1e15, 1e16, 123456789012345680.0, 1.5e22, 1e-4, 1e-5, 1.25e-7, 5e-324, 1.7976931348623157e308, math.pi, 100.0, 12345.678, 1e300, math.inf, -math.inf, math.nan, 9007199254740993.0]
TEXTS = ["", "plain", 'quo"te', "back\\slash", "line\nfeed\ttab\r", "\x00\x01\x1f\x7f", "乳腺癌 é 😀", " ", "\b\f", "</script>"]


def test_nested_records(spark):
    records = []
    for k, f in enumerate(FLOATS):
        text = TEXTS[k % len(TEXTS)]
        records.append({
            "z": text, "a": {"y": [f, None, -2.5], "x": {"b": 1, "B": None, "": 3, "é": 4, text: 5}, "b": k % 2 == 0}, "m": {10: [text, None], 9: [], -1: None}, "f": f, "d": decimal.Decimal("1.50"),
            "t": dt.date(2020, 1, k + 1), "Ts": dt.datetime(2020, 1, 2, 3, 4, 5, (k % 3) * 1200), "n": [{"q": k, "p": text}, {"q": None, "p": None}],
        })
    records.append({c: None for c in ("z", "a", "m", "f", "d", "t", "Ts", "n")})
    records.append(records[0] | {"a": {"y": None, "x": {}, "b": None}, "n": []})
    df = spark.createDataFrame([(*(r[c] for c in ("z", "a", "m", "f", "d", "t", "Ts", "n")), k) for k, r in enumerate(records)], SCHEMA + ", id int")
    out = {r["id"]: r for r in df.select("id", J.canonical_json(F.struct(*df.columns[:-1]), df.drop("id").schema).alias("j")).collect()}
    for k, r in enumerate(records):
        assert out[k]["j"] == want(r)
    digest = {r["id"]: r["digest"] for r in J.canonical_hash(df, *df.columns[:-1]).collect()}
    assert digest == {k: hashlib.sha256(want(r).encode()).hexdigest() for k, r in enumerate(records)}


def test_many_numbers_and_texts(spark):
    found = []

    @settings(max_examples=300, deadline=None, database=None)
    @given(st.decimals(min_value=-(10**20), max_value=10**20, places=6, allow_nan=False), st.integers(-30, 30), st.text(st.characters(exclude_categories=["Cs"]), max_size=12))
    def draw(x, e, s):
        found.append((float(f"{float(x):.12g}") * 1.0, float(f"{float(x) % 1:.6g}") * 10.0**e, s))

    draw()
    df = spark.createDataFrame(found, "f double, g double, s string")
    kind = df.schema
    for r in df.select("*", J.canonical_json(F.struct("f", "g", "s"), kind).alias("j")).collect():
        got = json.loads(r["j"])
        assert (got["f"], got["g"], got["s"]) == (r["f"], r["g"], r["s"])
        assert r["j"] == want({"f": r["f"], "g": r["g"], "s": r["s"]})


def test_no_form(spark):
    df = spark.createDataFrame([(bytearray(b"x"),)], "b binary")
    with pytest.raises(TypeError):
        J.canonical_hash(df)
    same = spark.createDataFrame([(1, 2)], "a int, `a.b` int")
    row = J.canonical_hash(same).first()
    assert row["digest"] == hashlib.sha256(b'{"a":1,"a.b":2}').hexdigest()


def test_plan_key(spark):
    df = spark.createDataFrame([("q1", 'a "b"', "m"), ("q2", None, None)], "i string, q string, m string")
    got = [r[0] for r in df.select(J.query_plan_key(F.col("i"), F.col("q"), F.col("m"), F.lit("1"), F.lit("2"))).collect()]
    for key, (i, q, m) in zip(got, [("q1", 'a "b"', "m"), ("q2", "", "")]):
        assert key == hashlib.sha256(want({"query_id": i, "query": q, "model_id": m, "prompt_version": "1", "schema_version": "2"}).encode()).hexdigest()
