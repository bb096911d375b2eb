"""Covers of sources in steps against a plain walk."""

import random

import pytest

from lodestone.operators import coverage, graph


def walk(ranked, cells, fields, most, guarded):
    best, out, last = dict.fromkeys(fields, 0.0), [], False
    for name, patient in ranked:
        if len(out) == most:
            break
        gain = sum(max(0.0, cells.get((name, f), 0.0) - best[f]) for f in fields)
        if (guarded and out and last and patient) or (out and gain <= 0):
            continue
        out.append((len(out) + 1, name, gain))
        last = patient
        best = {f: max(v, cells.get((name, f), 0.0)) for f, v in best.items()}
    return out


@pytest.mark.parametrize("seed", range(3))
def test_covers_against_a_plain_walk(spark, monkeypatch, seed):
    monkeypatch.setattr(coverage, "STEPS", 4)
    rng = random.Random(seed)
    fields = [f"f{k}" for k in range(9)]
    rows = [(f"d{k:02}", rng.choice([["patient"], ["study"], ["patient", "study"], [], None]), rng.random(), 0.5, rng.random(), rng.random(), rng.choice(["OPEN_API", "x"]), k) for k in range(30)]
    sources = spark.createDataFrame(rows, "dataset_id string, granularity array<string>, authority double, traceability double, structuredness double, cost double, access_mode string, ord int")
    cells = [(d[0], f, "required" if f < "f7" else "recommended", rng.choice([0.0, 0.0, 0.0, 0.0, 0.25, 0.5, 1.0])) for d in rows for f in fields if rng.random() < 0.8]
    df = spark.createDataFrame(cells + cells[:3], "dataset_id string, field_id string, priority string, coverage double")
    known = {(d, f): c for d, f, _, c in cells}
    level = {r[0]: "patient" in (r[1] or []) for r in rows}
    by_score = [(r["dataset_id"], level[r["dataset_id"]]) for r in sorted(coverage.scores(df, sources).collect(), key=lambda r: (-r["score"], r["dataset_id"]))]
    by_cost = [(r["dataset_id"], level[r["dataset_id"]]) for r in sorted(coverage.costs(df, sources).collect(), key=lambda r: (r["cost"], r["dataset_id"]))]
    for most in (1, 6):
        got = sorted(tuple(r) for r in coverage.selected(df, sources, most).collect())
        assert got == walk(by_score, known, fields[:7], most, False)
        got = sorted(tuple(r) for r in coverage.covered(df, sources, most).collect())
        assert got == walk(by_cost, known, fields[:7], most, True)
    assert len(got) > 2


def test_empty_catalogues(spark):
    cells = spark.createDataFrame([], "dataset_id string, field_id string, priority string, coverage double")
    sources = spark.createDataFrame([("a", ["patient"], 0.1, 0.1, 0.1, 0.1, "x", 1)], "dataset_id string, granularity array<string>, authority double, traceability double, structuredness double, cost double, access_mode string, ord int")
    assert [tuple(r) for r in coverage.selected(cells, sources).collect()] == [(1, "a", 0.0)]
    assert coverage.covered(cells, sources.limit(0)).collect() == []


def test_greedy_cover_against_a_plain_walk(spark):
    rng = random.Random(7)
    offers = [(rng.choice("abcdef"), f"f{rng.randrange(40)}") for _ in range(80)]
    wanted = [f"f{k}" for k in range(5, 45)]
    left, want = set(wanted), []
    for step in range(1, 5):
        gains = {s: len({f for t, f in offers if t == s} & left) for s in "abcdef"}
        best = min(gains, key=lambda s: (-gains[s], s))
        if not gains[best]:
            break
        want.append((step, best, gains[best]))
        left -= {f for t, f in offers if t == best}
    got = graph.greedy_cover(spark.createDataFrame([(f,) for f in wanted + wanted[:3]], "field string"), spark.createDataFrame(offers, "source string, field string"), 4)
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 2
