"""Nearest names and the ratio filter against brute force."""

from collections import defaultdict
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import entities, matching, nearest


def ratio(a, b):
    return SequenceMatcher(None, a, b).ratio()


def names(rng, n, letters="abcdef "):
    return ["".join(rng.choice(list(letters), int(rng.integers(1, 12)))).strip() or "x" for _ in range(n)]


def test_bounds_are_never_below_the_ratio():
    rng = np.random.default_rng(1)
    a, b = names(rng, 60), names(rng, 60)
    u = nearest.bounds(a, b)
    assert all(u[i, j] >= ratio(x, y) - 1e-12 for i, x in enumerate(a) for j, y in enumerate(b))


@pytest.mark.parametrize("block", [4, 512])
def test_nearest_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(nearest, "BLOCK", block)
    rng = np.random.default_rng(2)
    asked = [("p", n) for n in names(rng, 25)] + [("q", n) for n in names(rng, 10)] + [("p", ""), ("none", "abc")]
    rows = [("p", n, k) for k, n in enumerate(names(rng, 80))] + [("q", n, 100 + k) for k, n in enumerate(names(rng, 6))] + [("p", "abba", 200 + k) for k in range(40)] + [("p", "", 300), ("p", None, 301)]
    got = defaultdict(list)
    for r in nearest.nearest(spark.createDataFrame(asked, "pool string, name string"), spark.createDataFrame(rows, "pool string, name string, id long"), 10).collect():
        got[r["pool"], r["name"]].append((-round(r["ratio"], 9), r["id"]))
    want = {}
    for p, n in set(asked):
        best = sorted((-round(ratio(n, x), 9), i) for q, x, i in rows if q == p and x and n and ratio(n, x) > 0)[:10]
        if best:
            want[p, n] = best
    assert {k: sorted(v) for k, v in got.items()} == want


def test_rows_without_a_partner_get_the_nearest_by_name(spark):
    rng = np.random.default_rng(3)
    cols = ["id", "study_id", "patient_id", "name"]
    left = [(k, s, None, n) for k, (s, n) in enumerate(zip(["A", "B", "", "Z"] * 6, names(rng, 24, "abcdef")))] + [(90, "A", "P1", "zzz"), (91, "A", None, None), (92, "B", None, "%%%")]
    right = [(k, s, "P1" if k == 3 else None, n) for k, (s, n) in enumerate(zip(["A", "B", "C"] * 20, names(rng, 60, "abcdef")))]
    a, b = (spark.createDataFrame(x, "id long, study_id string, patient_id string, name string") for x in (left, right))
    got = defaultdict(set)
    for r in entities.candidates(a, b, 5).collect():
        got[r["left_id"]].add(r["right_id"])
    for row in left:
        x = dict(zip(cols, row))
        pool = [dict(zip(cols, r)) for r in right]
        same = [r for r in pool if x["study_id"] and r["study_id"] == x["study_id"]]
        pool = same or pool
        key = lambda r: {(c, r[c].lower()) for c in ("patient_id", "name") if r[c]}
        hit = [r["id"] for r in pool if key(x) & key(r)]
        if not key(x):
            hit = [r["id"] for r in pool][:5]
        elif not hit:
            hit = [r["id"] for r in sorted(pool, key=lambda r: (-(ratio(x["name"], r["name"]) if x["name"] else 0), r["id"]))[:5]]
        assert got[x["id"]] == set(hit), x


def test_ratio_pairs_lose_none(spark):
    rng = np.random.default_rng(4)
    a = [(k, int(rng.integers(2)), n) for k, n in enumerate(names(rng, 150))] + [(200, 0, None), (201, 0, ""), (202, None, "abc")]
    b = [(k, int(rng.integers(2)), n) for k, n in enumerate(names(rng, 150))] + [(203, 1, "")]
    df = [spark.createDataFrame(x, "id long, block int, text string") for x in (a, b)]
    got = {(r["left_id"], r["right_id"]): r["ratio"] for r in matching.ratio_pairs(*df, 0.7).collect()}
    want = {(i, j): round(ratio(x, y), 6) for i, p, x in a for j, q, y in b if p is not None and p == q and x and y and ratio(x, y) >= 0.7}
    assert got == want and len(want) > 20


def test_characters_count_repeats(spark):
    df = spark.createDataFrame([("abab",), ("",), (None,)], "t string")
    assert [sorted(r[0]) for r in df.select(matching.characters(F.col("t"))).collect()] == [["a1", "a2", "b1", "b2"], [], []]
