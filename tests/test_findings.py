"""Findings of a review on odd values and larger tables, each with a case that failed before."""

import random
import re
import time
from difflib import SequenceMatcher

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.functions.ratios import ratios
from lodestone.operators import cohort, entities, matching
from lodestone.plans import integration, suite


def same_as_sql(spark, folder, name, **tables):
    """The query on ``tables`` of rows against its SQL."""
    con = duckdb.connect()
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    found = con.execute(suite.ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    got = [tuple(r[c] for c in columns) for r in suite.QUERIES[name](spark, str(folder)).collect()]
    want = found.fetchall()
    assert sorted(got, key=repr) == sorted(want, key=repr)
    return want


CUSTOMER = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


def test_record_digests_of_minus_zero(spark, tmp_path):
    rows = [(k, f"Customer#{k}", 3 + k, b, "BUILDING") for k, b in enumerate([-0.0, 0.0, -999.99, 0.01, 9999.99, 1000.0])]
    assert len(same_as_sql(spark, tmp_path, "record_digests", customer=(rows, CUSTOMER))) == 6


def agreed(x, y):
    x, y = (compacted(v) for v in (x, y))
    return None if not x or not y else 1.0 if x == y else 0.5 if x in y or y in x else 0.0


def compacted(v):
    return re.sub(r"[^\w]+", "", (v or "").lower().replace("ß", "ss"))


@pytest.mark.parametrize("guard", [None, "patient"])
@pytest.mark.parametrize("fields", [["f"], ["f", "g", "h"]])
def test_matches_against_every_pair(spark, fields, guard):
    rng = random.Random(len(fields))
    values = [None, "", "a", "b", "ab", "abc", "bc", "xabcx", "ß", "a-b", "ba"]
    make = lambda n, at: [(at + k, rng.choice([1, 1, 2, 3 + at // 1000, None]), *(rng.choice(values) for _ in range(3)), rng.choice([None, "p", "q"])) for k in range(n)]
    a, b = make(60, 0), make(50, 1000)
    schema = "id long, study int, f string, g string, h string, patient string"
    got = {(r["left_id"], r["right_id"], r["score"], r["verdict"]) for r in matching.all_matches(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), "study", fields, guard=guard).collect()}
    want = set()
    for x in a:
        scored = []
        for y in b:
            if x[1] is not None and x[1] == y[1]:
                known = [s for s in (agreed(x["fgh".index(f) + 2], y["fgh".index(f) + 2]) for f in fields) if s is not None]
                scored.append((sum(known) / len(known) if known else 0.0, -y[0], bool(guard and x[5] and y[5] and x[5] != y[5])))
        verdict = lambda s, bad: "REJECT" if bad or s < 0.65 else "AUTO" if s >= 0.9 else "REVIEW"
        some = [p for p in scored if p[0] >= 0.65] or [max(scored, default=(0.0, None, True))]
        want |= {(x[0], i and -i, round(s, 6), verdict(s, bad)) for s, i, bad in some}
    assert got == want


def test_matches_of_a_large_block_are_not_all_pairs(spark):
    """150 million pairs agree in the digit; none of them in the name."""
    side = lambda n, name: spark.range(n).select("id", F.lit(1).alias("study"), F.concat(F.lit(name), F.col("id").cast("string")).alias("name"), F.lit("7").alias("digit"))
    began = time.monotonic()
    out = matching.all_matches(side(30_000, "left"), side(5_000, "right"), "study", ["name", "digit"])
    assert out.agg(F.count("*"), F.max("right_id"), F.min("score"), F.max("score")).first() == (30_000, 0, 0.5, 0.5)
    assert time.monotonic() - began < 60


def test_equal_rows_are_matched_once(spark):
    """Thirty copies of a row on each side give one pair of classes and 900 pairs of rows."""
    rows = lambda n, at, name: [(at + k, "s", "p1", name, "x") for k in range(n)]
    schema = "id long, study_id string, patient_id string, name string, city string"
    a, b = spark.createDataFrame(rows(30, 0, "Ann Lee"), schema), spark.createDataFrame(rows(30, 100, "Ann Lees"), schema)
    one, members = entities._rows(a)
    assert one.count() == 1 and members.count() == 30
    out = entities.match_v3(a, b).groupBy("decision", "score").agg(F.count_distinct("left_id", "right_id").alias("n"), F.count("*").alias("all")).collect()
    assert [(r["n"], r["all"]) for r in out] == [(900, 900)]


def test_pairs_of_a_block_are_dealt_over_tasks(spark):
    """One block of one partition: its pairs come from many tasks, each pair once, and only equal blocks meet."""
    side = lambda n, key: spark.range(n).select(F.col("id").alias(key), F.when(F.col("id") < n - 1, 1).otherwise(F.lit(None)).alias("block")).coalesce(1)
    out = matching.block_pairs(side(400, "a"), side(30, "b"), "block", "a")
    assert out.count() == out.distinct().count() == 399 * 29
    assert out.select(F.spark_partition_id().alias("p")).distinct().count() > 20


def test_ratios_of_many_pairs_are_those_of_difflib():
    rng = random.Random(5)
    for letters, most in (("ab", 12), ("abcde ", 30), ("aß漢𝒳é\0", 20), ("abcdefgh", 140), ("ab", 260)):
        word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(0, most)))  # noqa: B023, E731
        pairs = [(word(), word()) for _ in range(400)] + [("", ""), ("a", ""), ("b", "b")]
        assert ratios(*zip(*pairs)).tolist() == [SequenceMatcher(None, x, y).ratio() for x, y in pairs]
    assert ratios([], []).tolist() == []


def test_ratios_are_not_taken_one_by_one():
    rng = random.Random(6)
    some = lambda name: [f"{name}#{rng.randrange(10**6):09d}" for _ in range(100_000)]
    a, b = some("Customer"), some("Supplier")
    began = time.process_time()
    ratios(a, b)
    took, began = time.process_time() - began, time.process_time()
    for x, y in zip(a[:10_000], b):
        SequenceMatcher(None, x, y).ratio()
    assert took < 5 * (time.process_time() - began)


def test_copies_of_a_name_are_not_expanded(spark, tmp_path):
    """Copies of two names give one pair of their first rows, and every row its first."""
    schema = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
    rows = [(k, [None, "small green bolts", "small green bolt", "anvil"][k % 4], "b", "t", 1, 1.0) for k in range(1, 201)]
    same_as_sql(spark, tmp_path, "similar_name_members", part=(rows, schema))
    assert [(r["left_id"], r["right_id"]) for r in suite.QUERIES["similar_names"](spark, str(tmp_path)).collect()] == [(1, 2)]


def test_copies_of_traders_are_not_expanded(spark, tmp_path):
    rows = [(k, f"name {k % 3}" if k % 3 else None, k % 2 or None, 1.0, "BUILDING") for k in range(1, 61)]
    same_as_sql(spark, tmp_path, "sequence_ratio_members", customer=(rows, CUSTOMER), supplier=([r[:4] for r in rows], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"))
    got = {(r["s_suppkey"], r["c_custkey"]): r["ratio"] for r in suite.QUERIES["sequence_ratio_pairs"](spark, str(tmp_path)).collect()}
    assert got == {(x, y): round(SequenceMatcher(None, f"name {x % 3}" if x % 3 else "", f"name {y % 3}" if y % 3 else "").ratio(), 4) for x in (1, 3, 5) for y in (1, 3, 5)}


def test_features_of_a_block_are_counted_without_its_pairs(spark):
    """The features of every pair as columns against the counts of blocks; copies, empty texts, missing marks and blocks."""
    rng = random.Random(8)
    texts = [None, "", "ab", "Ann Lee", "Lee Ann", "ann  lee b", "Annie Leeds", "ß Straße 12", "ss strasse 12"]
    make = lambda n: [(rng.choice([1, 1, 2, None]), rng.choice(texts), rng.choice(texts), rng.choice([None, "x y", "y", "z"]), rng.choice([None, 3, 4]), rng.choice([1, 1, 5])) for _ in range(n)]
    schema = "block int, t string, f string, g string, mark int, n long"
    a, b = spark.createDataFrame(make(1300), schema), spark.createDataFrame(make(40), schema)
    side = lambda df: df.select("block", F.array(*map(entities.parts, "tfg")).alias("parts"), "mark", "n")
    got = entities.counted_features(side(a), side(b), "block").collect()
    told = lambda df, s: df.select("block", *(entities.parts(c).alias(s + c) for c in "tfg"), F.col("mark").alias(s + "mark"), F.col("n").alias(s + "n"))
    pairs = told(a, "l").join(told(b, "r"), "block")
    col = lambda c: (F.col("l" + c), F.col("r" + c))
    f = entities.features_of(col("t"), [col("f"), col("g")])
    same = F.col("lmark") == F.col("rmark")
    every = pairs.groupBy(*(c.alias(f"f{k}") for k, c in enumerate(f.values()))).agg(F.coalesce(F.sum(F.when(same, F.col("ln") * F.col("rn"))), F.lit(0)).alias("hits"), F.coalesce(F.sum(F.when(~same, F.col("ln") * F.col("rn"))), F.lit(0)).alias("misses"))
    assert sorted(map(tuple, got)) == sorted(map(tuple, every.collect())) and len(got) > 20
    assert not any("label" in c for c in got[0].asDict())


def test_rule_of_copies_is_that_of_every_pair(spark, tmp_path):
    rng = random.Random(9)
    row = lambda k: (k, rng.choice(["Ann Lee", "Lee", "Bo", None, "Ann Bo"]), rng.choice([1, 2, None]), float(rng.choice([3.5, 13.2, -4.1, 7.0])))
    c, s = [(*row(k), "BUILDING") for k in range(80)], [row(k) for k in range(30)]
    spark.createDataFrame(c, CUSTOMER).write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame(s, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    j, title, others = integration._titles(spark, str(tmp_path))
    label = ((F.floor("c_acctbal") % 10) == (F.floor("s_acctbal") % 10)).cast("int")
    want = entities.fit_rule(j.select(*(x.alias(f"f{k}") for k, x in enumerate(entities.features_of(title, others).values())), label.alias("label")))
    assert suite.QUERIES["entity_rule_fit"](spark, str(tmp_path)).collect() == want.collect()


def test_cohort_rows_are_dealt_once(spark):
    """Attribute rows of odd names and identities, in a plan of few shuffles whose rows are dealt before they are sorted."""
    kinds = "patientId string, sampleId string, clinicalAttributeId string, value string, ord int"
    s = spark.createDataFrame([("p", "s", "age", "4", 1), ("p", "s", "AGE_AT_DIAGNOSIS", "5", 2), ("p", "p", "!!", "x", 1), (None, "q", "OS", "1", 1), (" ", None, "OS", "2", 1), ("q", "q", "zed", "NA", 1)], kinds)
    p = spark.createDataFrame([("p", "OS", None, 1), ("r", "only here", "x", 1), ("q", "Age", "7", 1)], "patientId string, clinicalAttributeId string, value string, ord int")
    out = cohort.clinical(p, s, "st", "src")
    assert out.columns == ["study_id", "patient_id", "sample_id", "source_id", "age", "os_status", "zed"]
    got = sorted((tuple(r)[1:3] + tuple(r)[4:] for r in out.collect()), key=repr)
    assert got == [("p", "p", None, None, None), ("p", "s", "5", None, None), ("q", "q", "7", "1", None)]
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") < 12


def test_archives_are_read_by_many_tasks(spark):
    """Sixteen small archives: reading them is not gathered into one task for the names being short."""
    from lodestone.shared import new_path
    from lodestone.sources import exports

    folder = new_path(spark, "archives")
    back = exports.archive_rows(exports.write_archives(spark.range(160).coalesce(1), folder, rows=10), folder)
    assert back.select("row").distinct().count() == 160
    assert back.select(F.spark_partition_id().alias("p")).groupBy("p").count().count() > 5


def test_hashing_search_sends_no_vectors(spark):
    """One pass over the texts gives what vectors in blocks give; null ids, empty texts and no queries too."""
    from lodestone.operators import retrieval

    rng = random.Random(4)
    text = lambda: rng.choice([None, "", " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) for _ in range(6))])
    docs = spark.createDataFrame([(k if k % 9 else None, text()) for k in range(200)], "doc_id long, text string")
    asked = spark.createDataFrame([(k, text()) for k in range(12)], "query_id int, text string")
    vectors = retrieval.cosine(retrieval.hashed_embeddings(docs), retrieval.hashed_embeddings(asked.withColumnRenamed("query_id", "doc_id")), 7, 384, "doc_id", itself=True, half=True)
    found = retrieval.hashing_search(docs, asked, 7)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, vectors.collect()))
    assert "MapInArrow" not in found._jdf.queryExecution().executedPlan().toString()
    assert retrieval.hashing_search(docs, asked.limit(0)).count() == 0


def test_features_of_tokens_are_dealt_over_tasks(spark):
    """A few small documents: their windows and features are not gathered into one task."""
    from lodestone.operators import sequence

    x = sequence.context_features(spark.createDataFrame([(d, k, f"t{k}", k % 2) for d in range(60) for k in range(3)], "doc long, pos int, token string, label int"))
    assert x.select(F.spark_partition_id().alias("p")).groupBy("p").count().count() > 20
    assert sorted(x.filter("doc = 1 and pos = 0").first()["features"]) == ["left2=<B2>|<B>|t0", "left=<B>|t0", "right2=t0|t1|t2", "right=t0|t1", "token=t0", "window=<B>|t0|t1"]


@pytest.mark.parametrize("itself", [True, False])
def test_cosine_meets_queries_in_tasks(spark, itself):
    """Blocks of queries are read by the tasks that hold the vectors: no join of blocks, and copies, ties and zero vectors as by brute force."""
    import numpy as np
    from lodestone.operators import retrieval

    rng = np.random.default_rng(3)
    rows = rng.integers(-2, 3, (3000, 8)).astype(float)
    rows[::9], rows[5] = rows[0], 0
    ids = rng.permutation(3000)
    v = spark.createDataFrame([(int(i), r.tolist()) for i, r in zip(ids, rows)] + [(3001, None), (None, [1.0] * 8), (3002, [1.0])], "vec_id long, embedding array<double>")
    found = retrieval.cosine(v, v.filter("vec_id % 50 = 0"), 5, 8, itself=itself)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    unit = rows / np.where((norm := np.sqrt((rows * rows).sum(1, keepdims=True))) > 0, norm, 1)
    want = []
    for q in range(0, 3000, 50):
        scores = np.round(unit @ unit[np.flatnonzero(ids == q)[0]], retrieval.DIGITS)
        order = [j for j in np.lexsort((ids, -scores)) if itself or ids[j] != q][:5]
        want += [(q, int(ids[j]), float(scores[j]) + 0.0, n + 1) for n, j in enumerate(order)]
    assert sorted((r["query_id"], r["doc_id"], r["score"] + 0.0, r["rank"]) for r in found.collect()) == sorted(want)


def test_records_are_mapped_without_joins(spark):
    """Attempts of a record meet by one deal of its id; copies of records, null ids and ids with a separator keep each cell once."""
    from lodestone.operators import mapping

    rules = [mapping.Rule("a", "s", "study_id"), mapping.Rule("b", "d", "disease"), mapping.Rule("c", "g", "gene", "gene", source_id="x")]
    rows = [("1", "x", "S", "D", "p53"), ("1", "x", "S", "D", "p53"), ("2|a", "x", "S", "D", None), ("3", "y", "S", "D", "her2"), ("4", "x", "S", "D", None), ("4", "x", "T", "D", None), (None, "x", "S", "D", None)]
    records = spark.createDataFrame([(i, s, f'{{"s": "{a}", "d": "{b}"' + (f', "g": "{g}"' if g else "") + "}") for i, s, a, b, g in rows], "record_id string, source_id string, fields string").selectExpr("record_id", "source_id", "'high' AS authority", "0.9D AS default_confidence", "fields")
    tried = mapping.attempts(records, rules)
    assert sorted(((r["record_id"], r["blocked"]) for r in mapping.contexts(tried).collect()), key=repr) == [("1", False), ("2|a", False), ("3", False), ("4", True), (None, True)]
    mapped = mapping.mapped(tried)
    assert "Join" not in mapped._jdf.queryExecution().executedPlan().toString()
    cells = mapping.evidence(mapped).collect()
    assert len(cells) == len({r["evidence_id"] for r in cells}) == 3 + 2 + 2
    codes = sorted((r["record_id"] or "", r["code"], r["field"]) for r in mapping.issues(tried).filter("code <> 'raw_field_missing'").collect())
    assert codes == [("", "missing_required_context", "disease"), ("", "missing_required_context", "study_id"), ("4", "context_conflict", "study_id"), ("4", "missing_required_context", "study_id")]


def test_repair_loop_classifies_once(spark):
    """Findings of a record are decided by one aggregate: a shared id is no product, and no table is classified more than once."""
    from lodestone.operators import governance

    names = ["source_id", "raw_field", "raw_value", "study_id", "disease", "confidence", "patient_id", "sample_id", "source_authority", "gene"]
    base = ["s", "f", "v", "S", "d", "1", "p"]
    df = spark.createDataFrame([(k, *base, m, "low", g) for k, m, g in [(1, "a", "HER2"), (2, "a", "HER2"), (3, "b", "ERBB2"), (3, "c", "ERBB2"), (4, "d", "herceptin")]], "id long, " + ", ".join(f"{n} string" for n in names))
    out, verdict = governance.repair_loop(df, "id", ["gene"])
    assert sorted((r["id"], r["gene"], r["disposition"]) for r in out.collect()) == [(1, "ERBB2", "repaired"), (2, "ERBB2", "quarantined"), (3, "ERBB2", "clean"), (3, "ERBB2", "clean"), (4, "herceptin", "review")]
    assert tuple(verdict.first()) == (5, 1, 1, 1, 0, 0, "REVIEW")


ODD = [None, "", "a", "ab", "Ann Lee", "Lee Ann", "ann  lee b", "Annie Leeds", "ß Straße 12", "ss strasse 12", "é-9+x_y.", "漢", "12 12 12", " abc", "ab c"]


def traders(spark, folder, n, m):
    """Customers and suppliers with odd names, nations and balances, some of them copies."""
    rng = random.Random(n)
    row = lambda k: (k, rng.choice([*ODD, f"trader {rng.randrange(40)}"]), rng.choice([1, 1, 1, 2, 3 + n % 7, None]), rng.choice([None, 3.5, -0.0, 13.2, -4.1, 7.0]))
    for table, rows, schema in (("customer", [(*row(k), "BUILDING") for k in range(n)], CUSTOMER), ("supplier", [row(k) for k in range(m)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double")):
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{table}.parquet")
    return str(folder)


def test_predictions_are_made_in_matrices(spark, tmp_path):
    """Every pair as the columns of the operator have it, by no function of a pair in the plan; all weights on fields, too."""
    folder = traders(spark, tmp_path, 700, 90)
    j, title, others = integration._titles(spark, folder)
    names = ["exact_title", "title_jaccard", "rule_v1", "weighted_v2"]
    want = lambda p: j.select("c_custkey", "s_suppkey", *(p[k].alias(k) for k in names)).collect()
    got = suite.QUERIES["entity_predictions"](spark, folder)
    assert "array_intersect" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(got.collect()) == sorted(want(entities.predictions_of(title, others)))
    assert all(got.filter(k).count() for k in names)
    rule = (0.1, 0.1, 0.1, 0.4, 0.3, 0.5)
    side = lambda p, key: spark.read.parquet(f"{folder}/{'customer' if p == 'c' else 'supplier'}.parquet").select(key, F.col(f"{p}_nationkey").alias("nation"), entities.plain(f"{p}_name").alias("t"), entities.plain(F.col(f"{p}_nationkey").cast("string")).alias("of"), entities.plain(F.floor(f"{p}_acctbal").cast("string")).alias("has"))
    told = entities.block_predictions(side("c", "c_custkey"), side("s", "s_suppkey"), "nation", "c_custkey", "s_suppkey", ["t", "of", "has"], rule)
    assert sorted(told.collect()) == sorted(want(entities.predictions_of(title, others, rule)))


def test_title_features_are_made_in_matrices(spark, tmp_path, monkeypatch):
    """Every pair as the columns of the operator have it, by no function of a pair in the plan; parts, columns and kinds in several steps, too."""
    from lodestone.operators import paired

    folder = traders(spark, tmp_path, 400, 120)
    side = lambda table, p, key: spark.read.parquet(f"{folder}/{table}.parquet").select(key, F.col(f"{p}_nationkey").alias("nation"), F.col(f"{p}_name").alias(key[0]))
    pairs = side("customer", "c", "c_custkey").join(side("supplier", "s", "s_suppkey"), "nation")
    want = sorted(pairs.select("c_custkey", "s_suppkey", *(F.round(v, 6).alias(k) for k, v in matching.rule_features(F.col("c"), F.col("s")).items())).collect())
    got = suite.QUERIES["entity_rule_features"](spark, folder)
    assert "array_intersect" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(got.collect()) == want and len({r[2:] for r in want}) > 10
    for name, value in (("COLUMNS", 3), ("KINDS", 1)):
        monkeypatch.setattr(paired, name, value)
    texts = pa.array(["b a", "", "c  a b a d e"])
    words = paired.word_sets(texts, texts)
    assert paired.common(*words).tolist() == [[2, 0, 2], [0, 0, 0], [2, 0, 5]]
    assert paired.each_kind(*paired.jaccard(paired.common(*words), *words), lambda a, b: paired.rounded(a, b, 6)).tolist() == [[1.0, 0.0, 0.4], [0.0, 0.0, 0.0], [0.4, 0.0, 1.0]]
    assert (paired.rounded(1, 128, 6), paired.rounded(2, 3, 6)) == (0.007813, 0.666667)


def test_ratios_of_lists_are_those_of_difflib(monkeypatch):
    """Each text of one list with each of another: copies, zero characters, long texts, and names of patterns that clash."""
    from lodestone.functions import ratios as module

    rng = random.Random(7)
    for letters, most in (("ab", 12), ("abcde ", 30), ("aß漢𝒳é\0", 20), ("0123456789", 64), ("ab", 130)):
        word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(0, most)))  # noqa: B023, E731
        a, b = [word() for _ in range(30)] + ["", "a", "a\0", "Name#1", "x" * 64], [word() for _ in range(25)] + ["", "a", "\0a", "Name#2", "x" * 65]
        want = [[round(SequenceMatcher(None, x, y).ratio() * (len(x) + len(y)) / 2) for y in b] for x in a]
        for _ in range(2):  # the second time from what is remembered
            assert module.matched_each(a, b).tolist() == want
        with monkeypatch.context() as m:
            m.setattr(module, "_mixed", lambda x, seed: x * (seed % 2))  # first names clash, second ones are all zero or one
            m.setattr(module, "_patterns", lambda x, y: ((module.np.arange(len(x) * len(y)) % 3).astype("uint64").reshape(len(x), -1), module.np.arange(len(x) * len(y)).astype("uint64").reshape(len(x), -1)))
            module._remembered.cache_clear()
            assert module.matched_each(a, b).tolist() == want
        module._remembered.cache_clear()
    assert module.matched_each([], ["a"]).shape == (0, 1)


def test_pairs_of_traders_are_no_texts(spark, tmp_path):
    """No pair of names goes to Python as two texts, and a million pairs of different names take less than 300,000 one by one."""
    from lodestone.functions.ratios import matched_each

    folder = traders(spark, tmp_path, 300, 100)
    out = suite.QUERIES["sequence_ratio_pairs"](spark, folder)
    assert "ArrowEvalPython" not in out._jdf.queryExecution().executedPlan().toString()
    c, s = ({r[0]: r for r in spark.read.parquet(f"{folder}/{t}.parquet").collect()} for t in ("customer", "supplier"))
    first = lambda rows: {min(r[0] for r in rows.values() if r[1:3] == k) for k in {r[1:3] for r in rows.values()}}
    want = [(x, y, round(SequenceMatcher(None, s[x][1] or "", c[y][1] or "").ratio(), 4)) for x in first(s) for y in first(c) if s[x][2] is not None and s[x][2] == c[y][2]]
    assert sorted(map(tuple, out.collect())) == sorted(want)
    a, b = ([f"{name}#{k * 7:09d}" for k in range(1000)] for name in ("Supplier", "Customer"))
    began = time.process_time()
    matched_each(a, b)
    took, began = time.process_time() - began, time.process_time()
    ratios(a * 300, [y for k in range(300) for y in b[k:] + b[:k]])
    assert took < time.process_time() - began


@pytest.mark.parametrize("single, classes", [(0, 1 << 22), (0, 60), (0.05, 1 << 22), (0.05, 7), (1, 1 << 22)])
def test_kinds_of_pairs_are_counted_by_classes(monkeypatch, single, classes):
    """Sizes, common elements and labels of every pair as by brute force, whichever elements are rare; rows count several times."""
    from collections import Counter

    import numpy as np
    from lodestone.operators import paired

    for name, value in (("SINGLE", single), ("CLASSES", classes), ("COLUMNS", 3)):
        monkeypatch.setattr(paired, name, value)
    rng = random.Random(11)
    for words, most in (("abcdefgh", 4), ([f"w{k}" for k in range(60)], 3), ("xy", 2)):
        side = lambda n, own: ([" ".join(rng.choice([*words, own]) for _ in range(rng.randint(0, most))) for _ in range(n)], [rng.choice(["", "one", "two", own]) for _ in range(n)], [rng.choice([-1, 0, 1, 2]) for _ in range(n)], [rng.choice([1, 1, 3]) for _ in range(n)])  # noqa: B023, E731
        a, b = side(70, "left"), side(40, "right")
        families = [paired.word_sets(pa.array(a[0]), pa.array(b[0])), paired.whole_sets(pa.array(a[1]), pa.array(b[1]))]
        n, m, both, hits, misses = paired.counted(families, (np.array(a[2]), np.array(b[2])), (np.array(a[3], float), np.array(b[3], float)))
        got, want, present = Counter(), Counter(), set()
        for k in range(len(n)):
            got.update({(*n[k], *m[k], *both[k], True): hits[k], (*n[k], *m[k], *both[k], False): misses[k]})
        for t, u, v, w in zip(*a):
            for t2, u2, v2, w2 in zip(*b):
                x, y = set(t.split()), set(t2.split())
                kind = (len(x), int(u != ""), len(y), int(u2 != ""), len(x & y), int(u == u2 != ""))
                present.add(kind)
                if v >= 0 <= v2:
                    want[(*kind, v == v2)] += w * w2
        assert +got == +want and {(*n[k], *m[k], *both[k]) for k in range(len(n))} == present


def test_most_pairs_are_not_looked_at(spark):
    """200 million pairs of different names and balances of one block, each of them counted."""
    side = lambda n, name: spark.range(n).select(F.lit(1).alias("block"), F.array(F.format_string(f"{name} %09d", F.col("id")), F.lit("1"), (F.col("id") * 7 % 9973).cast("string")).alias("texts"), (F.col("id") % 10).alias("mark"), F.lit(1).cast("long").alias("n"))
    began = time.monotonic()
    out = entities.counted_kinds(side(40_000, "customer"), side(5_000, "supplier"), "block").agg(F.sum("hits"), F.sum("misses"), F.count("*")).first()
    assert out[:2] == (20_000_000, 180_000_000) and out[2] > 20
    assert time.monotonic() - began < 40


def test_every_document_is_a_query(spark, tmp_path):
    """Ids that 50 does not divide are asked too, as in SQL; empty, null and copied texts among them."""
    texts = [None, "", "alpha beta", "alpha beta", "beta gamma delta", "!?", "gamma alpha alpha eps"]
    want = same_as_sql(spark, tmp_path, "hashed_embedding_topk", documents=([(k * 7 + 1, texts[k % 7]) for k in range(40)], "doc_id long, text string"))
    assert {r[0] for r in want} == {k * 7 + 1 for k in range(40)} and len(want) == 400


@pytest.mark.parametrize("itself", [True, False])
def test_cosine_of_each_is_that_of_brute_force(spark, itself):
    """Vectors of several blocks on both sides, with copies, ties, zero, null and short ones; no vectors are joined, k rows of a query leave a task."""
    import numpy as np
    from lodestone.operators import retrieval

    rng = np.random.default_rng(4)
    rows = rng.integers(-2, 3, (5000, 8)).astype(float)
    rows[::9], rows[5] = rows[0], 0
    ids = rng.permutation(5000)
    v = spark.createDataFrame([(int(i), r.tolist()) for i, r in zip(ids, rows)] + [(5001, None), (None, [1.0] * 8), (5002, [1.0])], "vec_id long, embedding array<double>").coalesce(1)
    found = retrieval.cosine_of_each(v, 5, 8, itself=itself)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "Join" not in plan
    unit = rows / np.where((norm := np.sqrt((rows * rows).sum(1, keepdims=True))) > 0, norm, 1)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["doc_id"], r["score"] + 0.0, r["rank"]))
    assert len(got) == 5000
    for at in range(0, 5000, 7):
        scores = np.round(unit @ unit[at], retrieval.DIGITS)
        order = [j for j in np.lexsort((ids, -scores)) if itself or j != at][:5]
        assert got[int(ids[at])] == [(int(ids[j]), float(scores[j]) + 0.0, n + 1) for n, j in enumerate(order)]
    small = retrieval.cosine_of_each(v.limit(3), 5, 8, itself=itself)
    assert small.count() == 3 * (3 if itself else 2)
