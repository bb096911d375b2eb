"""Whitening, near-duplicate vectors and ranked search against brute force."""

import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from lodestone.llm import maxtree, pstable, registry, whiten

SF = "/root/testdata/sf0.001"
ROW = "vec_id long, embedding array<double>, label int, n long, component string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, y, 7, "clash") for i, v, y in rows], ROW)


def plain_whitening(rows):
    """``{vec_id: [(deviation, projections)]}`` and the spectrum, in Python integers and one eigh."""
    x = {k: [math.floor(64 * c) + 1_000_000 for c in v] for k, (_, v, _) in enumerate(rows)}
    fit = sorted(set(map(tuple, x.values())))
    n, dims = len(fit), len(fit[0])
    s = [sum(f[d] for f in fit) for d in range(dims)]
    centred = [[n * f[d] - s[d] for d in range(dims)] for f in fit]
    v = np.array([[sum(c[a] * c[b] for c in centred) / n**3 for b in range(dims)] for a in range(dims)])
    e, u = np.linalg.eigh(v)
    deviation = {k: sum((n * a - b) ** 2 for a, b in zip(r, s)) for k, r in x.items()}
    onto = {k: (np.array([n * a - b for a, b in zip(r, s)], float) / n) @ u[:, ::-1] for k, r in x.items()}
    return n, deviation, onto, e[::-1], v


def test_whitening_against_plain_integers(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.standard_normal(20) * np.linspace(3, 0.2, 20)).tolist(), 0) for i in range(300)]
    rows += [(None, rows[0][1], 0), (5, rows[1][1], 0), (5, rows[1][1], 0)]
    bad = [(900, None, 0), (901, [], 0), (902, [*rows[0][1][:-1], None], 0), (903, [*rows[0][1][:-1], math.nan], 0), (904, [*rows[0][1][:-1], math.inf], 0), (905, [1.0] * 7, 0), (906, [1e300] * 20, 0)]
    n, deviation, onto, e, _ = plain_whitening(rows)
    got = whiten.whiten(vectors(spark, rows + bad)).collect()
    assert len(got) == len(rows) * 16 and {r["n"] for r in got} == {n} and n == 300
    assert Counter(r["vec_id"] for r in got) == Counter({k: 16 * c for k, c in Counter(i for i, _, _ in rows).items()})
    assert got[0]["identity_error"] < 1e-9 and len({r["identity_error"] for r in got}) == 1
    want = {i: k for k, (i, _, _) in enumerate(rows)}
    sign = {}
    for r in got:
        k, c = want[r["vec_id"]], r["component"] - 1
        if r["vec_id"] == 5 and r["deviation"] != deviation[k]:
            k = 5
        assert r["deviation"] == deviation[k]
        assert math.isclose(r["explained"], e[c] / e.sum(), rel_tol=1e-9)
        w = onto[k][c] / math.sqrt(e[c])
        sign.setdefault(c, 1 if abs(w - r["whitened"]) < 1e-6 else -1)
        assert abs(w * sign[c] - r["whitened"]) < 1e-6


def test_scatter_stays_exact_where_doubles_do_not(spark):
    rng = np.random.default_rng(2)
    x = [[int(a) for a in row] for row in rng.integers(-(1 << 61), 1 << 61, (40, 3))]
    fit = spark.createDataFrame([([a + whiten.SHIFT for a in row],) for row in x], "x array<long>").repartition(3)
    n, s, p = whiten.moments(fit, 3)
    assert n == 40 and s == [sum(r[d] for r in x) for d in range(3)]
    assert [[int(v) for v in row] for row in p] == [[sum(r[a] * r[b] for r in x) for b in range(3)] for a in range(3)]
    far = [(k, [1e9 + k % 7, 1e9 - k % 5], 0) for k in range(50)]
    _, deviation, _, e, _ = plain_whitening(far)
    got = whiten.whiten(vectors(spark, far)).collect()
    assert {(r["vec_id"], r["deviation"]) for r in got} == set(deviation.items())
    assert got[0]["identity_error"] < 1e-9


def test_whitening_of_little(spark):
    assert whiten.whiten(vectors(spark, [])).collect() == []
    assert whiten.whiten(vectors(spark, [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)])).collect() == []
    got = whiten.whiten(vectors(spark, [(1, [1.0, 2.0], 0), (2, [3.0, 2.0], 0)])).collect()
    assert [(r["vec_id"], r["component"], abs(round(r["whitened"], 9)), r["explained"]) for r in sorted(got, key=lambda r: r["vec_id"])] == [(1, 1, 1.0, 1.0), (2, 1, 1.0, 1.0)]


def plain_links(rows):
    """Links, components by the least id, kept; one entry for each row."""
    ok = [k for k, (_, v, y) in enumerate(rows) if y is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    near, root = Counter(), list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for n, a in enumerate(ok):
        for b in ok[n + 1 :]:
            x, y = np.array(rows[a][1]), np.array(rows[b][1])
            if rows[a][2] == rows[b][2] and len(x) == len(y) and x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= 0.93:
                near[a] += 1
                near[b] += 1
                root[find(b)] = find(a)
    least = {}
    for k in ok:
        i = rows[k][0]
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    out = []
    for k, (i, _, _) in enumerate(rows):
        c = least.get(find(k)) if k in set(ok) else i
        out.append((i, near[k], c, i is not None and c == i))
    return Counter(out)


def clustered(rng, groups, size, spread, dims=24, labels=3, start=0):
    rows = []
    for g in range(groups):
        centre = rng.standard_normal(dims)
        for _ in range(size):
            v = centre + spread * rng.standard_normal(dims)
            rows.append((start + len(rows), (v * rng.uniform(0.1, 9)).tolist(), int(rng.integers(labels))))
    return rows


@pytest.mark.parametrize("block", [8, 512])
def test_near_vectors_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(pstable, "BLOCK", block)
    rng = np.random.default_rng(3)
    rows = clustered(rng, 40, 12, 0.25) + clustered(rng, 1, 60, 0.1, start=1000) + clustered(rng, 60, 1, 0, start=2000)
    rows += [(3000 + k, [0.0, -0.0, 1.5, 2.5], 1) for k in range(30)] + [(3100, [0.0, 0.0, 3.0, 5.0], 1), (3101, [0.0, 0.0, 3.0, 5.0], 2)]
    rows += [(None, rows[0][1], rows[0][2]), (7, rows[100][1], rows[100][2]), (7, rows[7][1], rows[7][2]), (4000, [1e200, 2e200], 0), (4001, [1e-200, 2e-200], 0)]
    rows += [(5000, None, 1), (5001, [], 1), (5002, [0.0, 0.0], 1), (5003, [1.0, None], 1), (5004, [1.0, math.nan], 1), (5005, [1.0, math.inf], 1), (5006, rows[0][1], None), (None, None, None)]
    rows = [r for r in rows if r[0] not in (4000, 4001)] + [(4000, [1e100, 2e100], 0), (4001, [1e-100, 2e-100], 0)]
    got = Counter(tuple(r) for r in pstable.near_vectors(vectors(spark, rows)).select("vec_id", "n_links", "component_id", "kept").collect())
    want = plain_links(rows)
    assert sum(got.values()) == len(rows)
    links = lambda c: sum(n * k for (_, n, _, _), k in c.items())
    assert links(got) >= 0.999 * links(want) and all(got[x] <= 1 or x in want for x in got)
    assert sum((got & want).values()) >= 0.99 * len(rows)


def test_pairs_at_the_threshold_share_a_bucket():
    rng = np.random.default_rng(4)
    a = pstable.unit(rng.standard_normal((4000, 64)))
    side = rng.standard_normal((4000, 64))
    side = pstable.unit(side - (side * a).sum(axis=1, keepdims=True) * a)
    for n in (100, 10_000_000):
        plan = pstable.plan(n)
        met = (pstable.buckets(a, *plan) == pstable.buckets(pstable.unit(0.9301 * a + math.sqrt(1 - 0.9301**2) * side), *plan)).any(axis=1)
        assert met.mean() >= 0.998, n
        assert (pstable.buckets(a[:50], *plan) == pstable.buckets(a, *plan)[:50]).all()


def test_forest():
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 300, 200), rng.integers(0, 300, 200)
    root = list(range(300))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for x, y in zip(a, b):
        u, v = find(x), find(y)
        root[max(u, v)] = min(u, v)
    assert pstable.forest(300, a, b).tolist() == [find(k) for k in range(300)]


def test_near_vectors_of_none(spark):
    assert pstable.near_vectors(vectors(spark, [])).collect() == []
    assert [tuple(r) for r in pstable.near_vectors(vectors(spark, [(1, None, None)])).collect()] == [(1, 0, 1, True)]


TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOW = {c: c + 32 for c in range(65, 91)}


def plain_search(docs, items, k):
    terms = [(i, TERM.findall((t or "").translate(LOW))) for i, t in docs]
    terms = [(i, w) for i, w in terms if w]
    n, total = len(terms), sum(len(w) for _, w in terms)
    df = Counter(t for _, w in terms for t in set(w))
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(TERM.findall((t or "").translate(LOW)))
    out = []
    for i, want in asked.items():
        scores = []
        for d, w in terms:
            tf, m = Counter(w), 50 + (50 * len(w) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 20 * m)) for t in want if tf[t])
            if score:
                scores.append((-score, d is None, d, score))
        out += [(i, r, d, s) for r, (_, _, d, s) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=repr)


ODD = [(9001, None), (9002, ""), (9003, " ,;\n"), (9004, "Ünï ÜNÏ ünï 3x 3X a_b 你好 \x7f z"), (9005, "rare " * 4000 + "word"), (9006, "rare word"), (9007, "rare word"), (None, "rare word"), (9006, "rare word")]
ASKED = [(1, "Rare WORD word"), (2, "Ünï 3x b"), (3, None), (4, "... !"), (5, "nowhere"), (None, "z 你好"), (1, "z")]


@pytest.mark.parametrize(("fan", "values", "terms"), [(16, 1 << 23, 1 << 16), (2, 64, 1 << 16), (4, 1 << 12, 700)])
def test_search_against_brute_force(spark, monkeypatch, fan, values, terms):
    monkeypatch.setattr(maxtree, "FAN", fan)
    monkeypatch.setattr(maxtree, "LEVEL_VALUES", values)
    monkeypatch.setattr(maxtree, "MOST_TERMS", terms)
    docs = [(r["doc_id"], r["text"]) for r in registry.table(spark, SF, "documents").select("doc_id", "text").collect()] + ODD
    items = [(r["item_id"], r["text"]) for r in registry.table(spark, SF, "benchmark").collect()] + ASKED
    df = spark.createDataFrame([(i, t, 1, 2.0) for i, t in docs], "doc_id long, text string, rank int, score double").repartition(3)
    got = maxtree.search(df, spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string"), 20).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_search(docs, items, 20)


def test_search_opens_few_nodes_and_breaks_ties_by_id():
    rng = np.random.default_rng(6)
    n = 4096
    gain = np.where(np.arange(n) == 3000, 900, rng.integers(1, 100, n))
    tree = maxtree.Ranges(np.arange(n + 1), np.zeros(n, np.int64), gain.astype(np.int64), 1)
    kept = []
    opened = tree.best(np.array([0]), np.ones(1, bool), 1, kept, 0, np.arange(n))
    assert kept[0][2] == 3000 and opened <= 4
    tree = maxtree.Ranges(np.arange(n + 1), np.zeros(n, np.int64), np.full(n, 5, np.int64), 1)
    kept = []
    tree.best(np.array([0]), np.ones(1, bool), 3, kept, 0, np.arange(n)[::-1])
    assert sorted(r[2] for r in kept) == [n - 3, n - 2, n - 1]


def test_search_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, item_id long, text string")
    some = spark.createDataFrame([(1, 1, "word")], "doc_id long, item_id long, text string")
    for docs, items in ((none, some), (some, none), (none, none)):
        assert maxtree.search(docs, items).collect() == []


def test_search_as_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = registry.QUERIES["op13_ranked_search"](spark, SF).collect()
    assert sorted(tuple(r) for r in got) == sorted(con.execute(maxtree.SQL).fetchall())
