"""Operators of the llm subpackage against brute force on small tables, with nulls, ties and repeats."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import bpe, counts, dac, decontaminate, labelled, minhash, pii, quality, registry, rules, stats, substring, toxicity

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(-1, None), (-2, ""), (-3, " \n\t "), (-4, "one two three"), (-5, "ﬁne Ünï 你好 <|endoftext|> é \x1c x"), (-6, "a" * 5000 + " " + "word " * 3000), (-7, "mail a.b@c-d.org, +49 (30) 123-4567 or 4111 1111 1111 1111 at 10.0.0.256 and 1.2.3.4"), (-8, "x " + "0" * 5000 + ".1.1.1 y " + "9" * 5000 + ".1.1.1 " + "1" * 6000)]


@pytest.fixture(scope="module")
def docs(spark):
    extra = spark.createDataFrame([(i, t, "en", "odd", 0) for i, t in ODD], "doc_id long, text string, lang string, source string, n_chars long")
    return registry.table(spark, SF, "documents").unionByName(extra).withColumn("score", F.lit("clash")).cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(registry.vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_bpe_as_the_library(docs, texts, library):
    for r in bpe.encode_digests(docs, registry.vocabulary()).collect():
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), sha(" ".join(map(str, ids)))), r["doc_id"]
        assert r["decoded_sha256"] == sha(library.decode(ids, skip_special_tokens=False)), r["doc_id"]


def test_counts_as_the_library(docs, texts, library):
    for r in counts.token_counts(docs, registry.vocabulary()).collect():
        t = texts[r["doc_id"]]
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 2048)


def test_files_round_trip(docs, texts, library):
    files = dac.write_files(docs, registry.vocabulary()).cache()
    start = 0
    for r in sorted(dac.read_digests(files).collect(), key=lambda r: r["doc_id"]):
        ids = [*library.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 1]
        assert (r["start"], r["n_tokens"]) == (start, len(ids))
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert dac.read_token(files, start - 1) == 1


def test_substrings_against_brute_force(docs, texts):
    words = {d: WORD.findall(t) for d, t in texts.items()}
    first = {}
    for d, w in words.items():
        for i in range(len(w) - 12):
            k = tuple(w[i : i + 13])
            first[k] = min(d, first.get(k, d))
    got = {r["doc_id"]: r for r in substring.dedup_digests(docs).collect()}
    assert got.keys() == words.keys()
    for d, w in words.items():
        gone = {j for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < d for j in range(i, i + 13)}
        kept = [x for i, x in enumerate(w) if i not in gone]
        assert (got[d]["n_words"], got[d]["n_removed"], got[d]["kept_sha256"]) == (len(w), len(gone), sha(" ".join(kept))), d


def bag(t):
    w = WORD.findall(t)
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else Counter([tuple(w)] if w else [])


def test_near_classes_against_brute_force(docs, texts):
    bags = {d: bag(t) for d, t in texts.items()}
    ids = sorted(d for d in bags if bags[d])
    root = {d: d for d in bags}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = bags[a], bags[b]
            n, m = sum(x.values()), sum(y.values())
            if min(n, m) >= 0.8 * max(n, m):
                both = sum((x & y).values())
                if both >= 0.8 * (n + m - both) - 1e-9:
                    u, v = find(a), find(b)
                    root[max(u, v)] = min(u, v)
    assert {r["id"]: r["class_id"] for r in minhash.near_classes(docs).collect()} == {d: find(d) for d in bags}


def test_many_near_copies_meet_in_blocks(spark, monkeypatch):
    base = [f"w{k}" for k in range(150)]
    rng = np.random.default_rng(5)
    rows, current = [], list(base)
    for d in range(300):
        current = list(current)
        current[int(rng.integers(150))] = f"n{d}"
        rows.append((d, " ".join(current)))
    monkeypatch.setattr(minhash, "BLOCK", 16)
    chain = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["class_id"] for r in minhash.near_classes(chain).collect()} == {0}


def test_repeated_ids_follow_their_least_content(spark):
    """Each id has two texts, and each of these a near copy of its own."""
    rng = np.random.default_rng(8)
    rows = []
    for d in range(12):
        for side in (0, 1):
            w = [f"t{d}s{side}w{k}" for k in range(60)]
            near = [*w[:-1], "other"]
            rows += [(1000 + d, " ".join(w)), (100 * side + d, " ".join(near))]
    rows += [rows[0], (2000, "same words in it"), (2000, "same words  in it"), (2001, "same words in it")]
    rows = [rows[k] for k in rng.permutation(len(rows))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"h1": F.lit("clash"), "h1_": F.lit(1)}).repartition(3)
    import pyarrow as pa

    from lodestone.llm.words import whole_hash, words_of

    def content(t):
        return tuple(int(x[0]) for x in whole_hash(words_of(pa.array([t]))))

    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(t)
    least = {i: min(ts, key=content) for i, ts in texts.items()}
    bags = {i: bag(t) for i, t in least.items()}
    similar = lambda a, b: sum((a & b).values()) >= 0.8 * (sum(a.values()) + sum(b.values()) - sum((a & b).values()))
    want = {i: min(j for j in bags if similar(bags[i], bags[j])) for i in bags}
    assert {r["id"]: r["class_id"] for r in minhash.near_classes(df).collect()} == want
    kept = minhash.keep_one(df)
    assert kept.columns == df.columns
    assert {(r["doc_id"], content(r["text"])) for r in kept.collect()} == {(i, content(least[i])) for i in want if want[i] == i}
    assert kept.count() == sum(want[i] == i for i in want)


def test_containment_is_exact(spark, docs, texts):
    items = registry.table(spark, SF, "benchmark")
    want = set()
    for it in items.collect():
        q = set(bag(it["text"])) if len(WORD.findall(it["text"])) > 4 else set()
        for d, t in texts.items():
            if q and len(WORD.findall(t)) > 4 and len(q & set(bag(t))) >= 0.8 * len(q) - 1e-9:
                want.add((d, it["item_id"]))
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, items).collect()} == want


def base_spans(t):
    """Leftmost non-overlapping matches of the four base kinds by plain patterns."""
    digits = lambda s: [int(c) for c in s if c.isdigit()]
    luhn = lambda n: sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(reversed(n))) % 10 == 0
    tests = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15),
    }
    return [f"{k}:{m.start()}:{m.end()}" for k, (p, ok) in tests.items() for m in re.finditer(p, t) if ok(m[0])]


def test_base_spans(docs, texts):
    for r in pii.detect(docs).collect():
        want = base_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == sha(",".join(want)), (r["doc_id"], want, r["spans"])


def test_rules_base(docs, texts):
    for r in rules.verdicts(docs).collect():
        t = texts[r["doc_id"]]
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        tri = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        twice = {j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(twice))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, r["doc_id"]
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["base_failed"] and r["kept"])


@pytest.mark.parametrize("operator, label", [(toxicity, "toxic"), (quality, "quality")])
def test_held_out_accuracy(spark, operator, label):
    sf = "/root/testdata/sf0.01"
    labels = registry.table(spark, sf, "labels")
    out = operator.score(registry.table(spark, sf, "documents"), labels).join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r["predicted"] == r[label] for r in out]) > 0.9
    assert all(0 <= r["score"] <= 1 for r in out)


LABELS = "doc_id long, quality int, toxic int"
ALL = {
    "op1": lambda d, l, b: toxicity.score(d, l), "op2": lambda d, l, b: minhash.near_classes(d), "op3": lambda d, l, b: quality.score(d, l), "op4": lambda d, l, b: substring.dedup_digests(d), "op5": lambda d, l, b: pii.detect(d), "op6": lambda d, l, b: dac.read_digests(dac.write_files(d, registry.vocabulary())),
    "op7": lambda d, l, b: decontaminate.leaks(d, b), "op8": lambda d, l, b: bpe.encode_digests(d, registry.vocabulary()), "op9": lambda d, l, b: counts.token_counts(d, registry.vocabulary()), "op10": lambda d, l, b: rules.verdicts(d),
}


@pytest.mark.parametrize("name", ALL)
def test_empty_tables(spark, docs, name):
    none = spark.createDataFrame([], LABELS)
    assert ALL[name](docs.limit(0), none, registry.table(spark, SF, "benchmark").limit(0)).count() == 0


#: Repeated ids, null ids, null language and source, and columns that the operators use inside.
HARD = [(1, "the same words stand here twice and once more for good measure you idiot", None, None), (1, "other words under the same id with mail a@b.cc", "en", "x"), (None, "no id at all but words enough", "en", None), (2, None, None, "x"), (2, "", "en", "x"), (3, "w " * 60, "en", "x"), (4, "w " * 60, "en", "x")]
CLASH = ["id", "label", "key", "words", "group", "start", "place", "score", "bag", "held", "x", "n"]


@pytest.mark.parametrize("name", ALL)
def test_hard_rows(spark, name):
    d = spark.createDataFrame(HARD, "doc_id long, text string, lang string, source string").withColumns({c: F.lit("clash") for c in CLASH})
    labels = spark.createDataFrame([(1, 1, 1), (1, 0, 0), (None, 1, 1), (3, None, None), (4, 7, 0)], LABELS).withColumn("y", F.lit("clash"))
    items = spark.createDataFrame([(1, "words enough to be an item of the test", "c"), (None, "x y z u v w", "c"), (2, None, "c"), (3, "w " * 60, "c")], "item_id long, text string, doc string")
    out = ALL[name](d, labels, items).collect()
    ids = sorted((r[0] for r in out), key=str)
    if name == "op2":
        assert {r["id"]: r["class_id"] for r in out} == {1: 1, 2: 2, 3: 3, 4: 3}
    elif name == "op7":
        assert {(r["doc_id"], r["item_id"]) for r in out} == {(3, 3), (4, 3)}
    else:
        assert ids == sorted((h[0] for h in HARD), key=str)


def thue_morse(n):
    w = [0]
    while len(w) < n:
        w += [1 - x for x in w]
    return "".join("ab"[x] for x in w[:n])


def test_words_that_hash_alike_in_a_ring_stay_apart(spark):
    """Two words of 1,024 letters whose polynomial hashes modulo 2**64 are equal for every odd base."""
    one = thue_morse(1024)
    other = one.translate(str.maketrans("ab", "ba"))
    same = " ".join(f"w{k}" for k in range(12))
    d = spark.createDataFrame([(1, f"{same} {one}"), (2, f"{same} {other}")], "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("x")})
    assert {r["doc_id"]: r["n_removed"] for r in substring.dedup_digests(d).collect()} == {1: 0, 2: 0}
    assert {r["id"]: r["copy_of"] for r in minhash.near_classes(d).collect()} == {1: 1, 2: 2}
    lines = spark.createDataFrame([(1, f"{one}\n{other}\n{one} {one} {one} x {other} {other} {other}")], "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("x")})
    r = rules.verdicts(lines).first()
    assert (r["n_dup_lines"], r["n_repeat_words"]) == (0, 0)


def test_one_passage_in_half_of_the_documents(spark):
    rng = np.random.default_rng(3)
    passage = [f"p{k}" for k in range(20)]
    rows = []
    for d in range(80):
        own = [f"d{d}x{k}" for k in range(int(rng.integers(5, 30)))]
        at = int(rng.integers(0, len(own)))
        rows.append((d, " ".join(own[:at] + passage + own[at:] if d % 2 else own + ["run"] * (10 + d % 8))))
    got = {r["doc_id"]: r["n_removed"] for r in substring.dedup_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    words = {d: t.split() for d, t in rows}
    first = {}
    for d, w in words.items():
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), d)
    for d, w in words.items():
        assert got[d] == len({j for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < d for j in range(i, i + 13)}), d


def test_label_model_recovers_known_tables():
    """Votes drawn from known tables, one voter a copy of another: accuracies, the link and the posterior are found."""
    rng = np.random.default_rng(11)
    n, right = 60000, [0.9, 0.8, 0.85, 0.75]
    y = (rng.random(n) < 0.3).astype(int)
    votes = np.ones((n, 5), int)
    for j, p in enumerate(right):
        said = np.where(rng.random(n) < p, y, 1 - y)
        votes[:, j] = np.where(rng.random(n) < 0.7, 2 * said, 1)
    votes[:, 4] = np.where(rng.random(n) < 0.95, votes[:, 3], 1)
    patterns, at, count = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    model = toxicity.LabelModel(patterns, count.astype(float))
    assert model.accuracy[:4] == pytest.approx(right, abs=0.03)
    assert model.prior[1] == pytest.approx(0.3, abs=0.03)
    assert model.parent[4] == 3 or model.parent[3] == 4
    assert model.correlation[3, 4] > 0.8 > 0.1 > abs(model.correlation[0, 1])
    q = model.posterior(patterns)[at.reshape(-1)]
    for low in (0.0, 0.2, 0.4, 0.6, 0.8):
        part = (q >= low) & (q < low + 0.2)
        if part.sum() > 500:
            assert y[part].mean() == pytest.approx(q[part].mean(), abs=0.05)


def test_linear_fit_and_calibration():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 2))
    p = 1 / (1 + np.exp(-(x @ [2.0, -1.0] + 0.5)))
    w, bias = toxicity.fit_linear(x, p, ridge=1e-3)
    assert [*w, bias] == pytest.approx([2.0, -1.0, 0.5], abs=0.02)
    slope, shift = toxicity.calibration(x @ [1.0, -0.5], (rng.random(4000) < p).astype(int))
    assert (slope, shift) == pytest.approx((2.0, 0.5), abs=0.15)
    assert toxicity.calibration(np.array([1.0]), np.array([1])) == (1.0, 0.0)


def test_additive_scores_are_sums_of_looked_up_values():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 4))
    x[:, 3] = 1.0
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    model = quality.fit(x, y)
    for row, got in zip(x[:50], model.score(x[:50])):
        total = model.base + sum(t[sum(v >= e for e in edges)] for v, edges, t in zip(row, model.edges, model.tables))
        for (a, b), grid in zip(model.pairs, model.grids):
            total += grid[sum(row[a] >= e for e in model.coarse[a]), sum(row[b] >= e for e in model.coarse[b])]
        assert got == pytest.approx(1 / (1 + np.exp(-total)))
    assert (0, 1) in model.pairs and ((model.score(x) > 0.5) == y).mean() > 0.9
    tree = quality._tree(np.array([1.0, 1.0, -5.0, -5.0]), np.full(4, 10.0), np.full(4, 20.0))
    assert len(set(tree)) <= 4 and tree[0] < 0 < tree[3]


def fast_mcd(x, h, rng):
    """Least determinant of concentrated random starts, by plain numpy."""
    best = None
    for _ in range(200):
        at = rng.choice(len(x), 7, replace=False)
        for _ in range(60):
            m, c = x[at].mean(axis=0), np.cov(x[at].T, bias=True) + 1e-9 * np.eye(5)
            new = np.argsort(np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m), kind="stable")[:h]
            if set(new) == set(at):
                break
            at = new
        det = np.linalg.slogdet(np.cov(x[at].T, bias=True))[1]
        if best is None or det < best[0]:
            best = det, x[at].mean(axis=0), np.cov(x[at].T, bias=True)
    return best


@pytest.mark.parametrize("far", [0, 60, 120])
def test_rules_as_plain_fast_mcd(spark, far):
    rng = np.random.default_rng(far)
    unit = np.array([1.0, 0.9, 0.8, 2.0, 1.2])
    x = rng.normal(size=(300, 5)) @ np.linalg.cholesky(0.5 * np.eye(5) + 0.5).T * unit + 5
    x[:far] += np.array([12.0, -9, 10, 0, 8])
    _, mean, cov = fast_mcd(x, 150, rng)
    rows = spark.createDataFrame([("g", *map(float, r)) for r in x], "group string, " + ", ".join(f"{c} double" for c in rules.AXES))
    s = rules.estimates(rows).first()
    diff = x - np.array([s[f"m{i}"] for i in range(5)])
    mine = sum(s[f"v{i}{j}"] * diff[:, i] * diff[:, j] for i in range(5) for j in range(i, 5)) / s["scale"]
    plain = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
    plain *= rules.MIDDLE / np.median(plain)
    assert ((mine > rules.CUT) == (plain > rules.CUT)).mean() > 0.99
    assert (mine[:far] > rules.CUT).all() and (mine[far:] > rules.CUT).mean() < 0.01
    assert np.corrcoef(np.sqrt(mine[far:]), np.sqrt(plain[far:]))[0, 1] > 0.95


def test_rules_constant_columns_tiny_and_nameless_groups(spark):
    words = [" ".join(f"a{d}b{k}" for k in range(60 + d % 5)) for d in range(260)]
    rows = [(d, t, None if d % 2 else "en", "x") for d, t in enumerate(words)] + [(900, words[0], "xx", "tiny"), (901, "# " * 40 + words[1], "xx", None)]
    out = {r["doc_id"]: r for r in rules.verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(out[d]["kept"] for d in range(260)) and out[900]["kept"] and not out[901]["kept"]


def test_tokens_at_random_places():
    ids = np.array([0, 1, 255, 256, 49407, 65535, 65536, 70000, 3, 2**24 + 5] * 120, np.uint32)
    offsets = np.array([0, 7, 7, 600, len(ids)])
    f = dac.DacFile(dac.pack(ids, np.array([1, 2, 3, 4], np.int64), offsets))
    assert len(f.levels) == 4 and f.all().tolist() == ids.tolist()
    assert [f.token(i) for i in range(len(ids))] == ids.tolist()
    content, most = dac.pack(ids, np.array([1, 2, 3, 4], np.int64), offsets), []

    def read_at(count, offset):
        most.append(count)
        return content[offset : offset + count]

    assert [dac.token_at(read_at, i) for i in range(len(ids))] == ids.tolist() and max(most) <= dac.BLOCK // 8
    with pytest.raises(IndexError):
        f.token(len(ids))


def test_tokens_by_ranges_of_the_file(spark, docs, library, texts):
    files = dac.write_files(docs, registry.vocabulary()).cache()
    ids = [i for d in sorted(texts) for i in [*library.encode(texts[d], add_special_tokens=False).ids, 1]]
    for at in range(0, len(ids), max(len(ids) // 40, 1)):
        assert dac.read_token(files, at) == ids[at]


def test_blocks_of_texts_as_the_library(library, monkeypatch):
    texts = [t for _, t in ODD] + ["It's X's 'sam ''s I'LL they'd_ve __a__ #'s ½² 3.14 x²y", "<|ENDOFTEXT|> a<|endoftext|>b<|startoftext|><|endoftext|>", "a\xa0b\xa049407 \xa0 É\xa0Ø ǅ", "\xa049406 你\xa049407", "</w> w</w> ÷</w>", "e\u0301 \u0301e Σας İi ß ẞ \u2028 x\u2029y \x85z \x00 \x7f\x1f", "привет мир, 你好。 😀😀 한글 \u1112\u1161", "tab\tnew\nline\rfeed\x0bv\x0cf", "_" * 300 + "é" * 3000]
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    own = bpe.BlockEncoder(registry.vocabulary())
    assert [x.tolist() for x in own.batch(texts)] == want and own.batch([]) == [] and [len(x) for x in own.batch([None, ""])] == [0, 0]
    monkeypatch.setattr(bpe, "MEMORY", 20)
    assert [x.tolist() for x in own.batch(texts[::-1])] == want[::-1]
    # texts over a segment and a block, and ends of words that say nothing
    monkeypatch.setattr(bpe, "BLOCK", 1000)
    monkeypatch.setattr(bpe.segments, "__defaults__", (100,))
    own.merger.closes[:] = False
    own.words.clear()
    assert [x.tolist() for x in own.batch(texts)] == want


def test_blocks_of_texts_ask_the_library_in_lines(library):
    """Calls of the library and rows of Python follow the different words, not the text."""
    own, asked = bpe.block_encoder.__wrapped__(registry.vocabulary()), []
    ids = own.merger.ids
    own.merger.ids = lambda lines: asked.extend(lines) or ids(lines)
    words = [f"{chr(97 + a)}{chr(97 + b)}q{chr(97 + c)}" for a in range(20) for b in range(20) for c in range(20)]
    texts = [" ".join(words[k:] + words[:k]) for k in range(0, 8000, 1000)]
    found = own.batch(texts)
    assert [x.tolist() for x in found[:2]] == [library.encode(t, add_special_tokens=False).ids for t in texts[:2]]
    assert len(asked) <= len(words) // bpe.LINE + 1 and sum(len(x.split()) for x in asked) == len(words)


def test_sentencepiece_counts(spark):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = [(1, "plain words"), (2, None), (3, "Grüße 你好 " * 200), (4, "<s> special </s>")]
    for r in counts.token_counts(spark.createDataFrame(rows, "doc_id long, text string"), path).collect():
        assert r["n_tokens"] == len(model.encode(dict(rows)[r["doc_id"]] or ""))


@pytest.mark.parametrize("short", [4, 64])
def test_bpe_on_both_sides_of_the_word_size(library, monkeypatch, short):
    monkeypatch.setattr(bpe, "SHORT", short)
    monkeypatch.setattr(bpe, "SEGMENT", 50)
    own = bpe.Encoder(registry.vocabulary())
    texts = ["hello internationalisation of everything " * 20, "a" * 300, "don't stop, it's 12:30!"]
    assert [x.tolist() for x in own.batch(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_texts_longer_than_a_chunk(spark, library):
    long = ("Wörter und mehr words, again and again. " * 16000)[:600000]
    d = spark.createDataFrame([(1, long), (2, "short"), (3, long)], "doc_id long, text string")
    n = len(library.encode(long, add_special_tokens=False).ids)
    assert {r["doc_id"]: r["n_tokens"] for r in counts.token_counts(d, registry.vocabulary()).collect()} == {1: n, 2: 1, 3: n}
    assert {r["id"]: r["class_id"] for r in minhash.near_classes(d).collect()} == {1: 1, 2: 2, 3: 1}
    assert {r["doc_id"]: r["n_removed"] for r in substring.dedup_digests(d).collect()}[3] == len(long.split())


def test_private_spans_and_masks():
    t = "IBAN DE89370400440532013000, account no. 12345678; token = abcdefghij0123456789 and https://me:pw@host.org/x, mail a@b.cd"
    found = pii.find(t)
    assert [t[a:b] for a, b in found["account"]] == ["DE89370400440532013000", "12345678"]
    assert [t[a:b] for a, b in found["secret"]] == ["abcdefghij0123456789"] and [t[a:b] for a, b in found["url"]] == ["https://me:pw@host.org"]
    hidden = pii.mask(t)
    assert not any(x in hidden for x in ("DE89", "12345678", "abcdefghij", "me:pw", "a@b.cd")) and "<EMAIL>" in hidden
    assert pii.mask(None) is None and pii.mask("clean") == "clean"


@pytest.mark.parametrize("rows", [0, 1 << 20])
def test_containment_with_and_without_broadcast(spark, docs, texts, rows, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", rows)
    items = registry.table(spark, SF, "benchmark")
    common = spark.createDataFrame([(10**6 + k, "a line that all of these items share in full " + " ".join(f"i{k}w{j}" for j in range(k % 9))) for k in range(40)], "item_id long, text string")
    planted = spark.createDataFrame([(10**6, "before a line that all of these items share in full after it")], "doc_id long, text string")
    d = docs.select("doc_id", "text").union(planted)
    known = {**texts, 10**6: planted.first()["text"]}
    want = set()
    for it in [*items.select("item_id", "text").collect(), *common.collect()]:
        w = WORD.findall(it["text"])
        q = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        want |= {(i, it["item_id"]) for i, t in known.items() if q and len(q & set(bag(t))) >= 0.8 * len(q) - 1e-9}
    got = decontaminate.leaks(d, items.select("item_id", "text").union(common))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want and any(d == 10**6 for d, _ in want)


def test_rules_far_cluster(spark):
    """A far cluster of up to near half of a group is rejected whole, and the rest is not."""
    rng = np.random.default_rng(7)
    n, unit, groups = 4000, np.array([1.0, 0.9, 0.8, 1.5, 1.2]), {}
    for share, away in [(0.2, 10), (0.35, 10), (0.35, 100), (0.45, 10), (0.45, 100)]:
        x = rng.normal(size=(n, 5)) * unit + 5
        x[: int(n * share)] += away * unit
        groups[f"{share} {away}"] = int(n * share), x
    rows = spark.createDataFrame([(g, *map(float, r)) for g, (_, x) in groups.items() for r in x], "group string, " + ", ".join(f"{c} double" for c in rules.AXES))
    found = {s["group"]: s for s in rules.estimates(rows).collect()}
    for g, (far, x) in groups.items():
        s = found[g]
        diff = x - np.array([s[f"m{i}"] for i in range(5)])
        distance = sum(s[f"v{i}{j}"] * diff[:, i] * diff[:, j] for i in range(5) for j in range(i, 5)) / s["scale"]
        assert (distance[:far] > rules.CUT).all(), g
        assert (distance[far:] > rules.CUT).mean() < 0.001, g


def test_rules_copies_are_not_the_core(docs):
    """Copies of one document, more than all others of its group, do not change what is kept of the others."""
    plain = docs.filter("doc_id >= 0").select("doc_id", "text", F.lit("en").alias("lang"), F.lit("a").alias("source"))
    again = plain.withColumns({"doc_id": F.col("doc_id") + 10**6, "source": F.lit("b")})
    one = again.filter(F.length("text") > 1000).orderBy("doc_id").limit(1)
    copies = one.withColumn("doc_id", F.explode(F.sequence(F.lit(2 * 10**6), F.lit(2 * 10**6 + 999))))
    rows = rules.verdicts(plain.unionByName(again).unionByName(copies)).filter("kept").collect()
    kept = lambda low: {r["doc_id"] - low for r in rows if low <= r["doc_id"] < low + 10**6}
    assert kept(0) and kept(0) == kept(10**6)
