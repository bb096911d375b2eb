"""Operators on small fixtures: nulls, blanks, ties, cycles and empty tables."""

from pyspark.sql import functions as F

from lodestone.functions import normalise as N
from lodestone.functions import text as T
from lodestone.operators import cleaning, graph, linking, matching, profile, quality, retrieval, sequence
from lodestone.plans import suite
from lodestone.sources import chunks, readers, sinks
from lodestone.streaming import ingest


def values(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column.alias("y")).first()["y"]


def test_receptor_and_her2(spark):
    assert one(spark, N.receptor_polarity("x"), "2+") == "equivocal"
    assert one(spark, N.receptor_polarity("x"), "Pos") == "positive"
    assert one(spark, N.receptor_polarity("x"), None) is None
    assert one(spark, N.her2(F.lit("IHC"), "x"), "2+")["value"] == "Equivocal"
    assert one(spark, N.her2(F.lit("FISH"), "x"), "non-amplified")["value"] == "Negative"
    assert one(spark, N.her2(F.lit(""), "x"), "-")["status"] == "unresolved"


def test_flags(spark):
    assert one(spark, N.mutation_flag("x"), "V600E") == 1
    assert one(spark, N.mutation_flag("x"), "wild type") == 0
    assert one(spark, N.response_flag("x"), "non-pCR") == 0
    assert one(spark, N.response_flag("x"), "pCR") == 1
    assert one(spark, N.response_flag("x"), "") is None
    assert one(spark, T.age_group("x"), "121") is None
    assert one(spark, N.characteristics("x"), "a: 1; b=2 | a: 3") == {"a": "3", "b": "2"}


def test_text(spark):
    assert one(spark, T.cjk_bigrams("x"), "乳腺癌 ok 药") == ["乳腺", "腺癌", "癌药"]
    assert one(spark, T.protected_terms("x"), 'find "big cat" not in TP53 data') == ["big cat", "TP53", "not"]
    assert one(spark, T.csv_safe("x"), "=1+1") == "'=1+1"
    assert one(spark, T.is_filled("x", "trimmed"), " na ") is False
    assert one(spark, T.is_filled("x", "exact"), " na ") is True
    assert one(spark, T.expand_query("x", {"her2": "erbb2"}), "HER2 her2") == "HER2 her2 erbb2"


def test_bm25_empty_and_ties(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "b"), (8, "zzz")], "query_id long, text string")
    assert values(retrieval.bm25(docs, asked), "query_id", "doc_id", "rank") == [(7, 1, 1), (7, 2, 2)]
    assert retrieval.bm25(docs.limit(0), asked).count() == 0


def test_rerank_keeps_tail(spark):
    base = spark.createDataFrame([(1, 10, 3.0, 1), (1, 11, 2.0, 2), (1, 12, 1.0, 3)], "query_id long, doc_id long, score double, rank long")
    new = spark.createDataFrame([(1, 11, 9.0)], "query_id long, doc_id long, score double")
    assert values(retrieval.rerank(base, new, 2), "doc_id", "rank") == [(10, 2), (11, 1), (12, 3)]


def test_components_of_a_chain(spark):
    chain = spark.range(50).select(F.col("id").alias("left"), (F.col("id") + 1).alias("right"))
    assert {r["root"] for r in linking.components(chain).collect()} == {0}
    assert linking.components(chain.limit(0)).count() == 0


def test_decisions(spark):
    ids = spark.createDataFrame([(1, "s", "p1", "a"), (2, "s", "p2", "a"), (3, "s", "p3", None), (4, "s", "p3", " "), (5, "t", "p3", None), (6, None, "p3", "a")], "id long, study string, patient string, sample string")
    assert values(linking.decisions(ids), "name", "decision", "auto_merge") == [("a", "REJECTED", False), ("p3", "LINKED", True)]


def test_merge_never_picks_a_side(spark):
    o = spark.createDataFrame([(1, "f", "x", "resolved", 1), (1, "f", "y", "resolved", 2), (2, "f", "x", "review", 1)], "entity long, field string, value string, status string, ord long")
    assert values(linking.merge(o), "entity", "status", "value") == [(1, "unresolved", None), (2, "review", "x")]


def test_blocking_ignores_blanks(spark):
    a = spark.createDataFrame([(1, "k", ""), (2, None, "")], "id long, p string, q string")
    assert values(matching.blocked_pairs(a, a, {"p": F.col("p"), "q": F.col("q")}), "left_id", "right_id") == [(1, 1)]
    ratio = spark.createDataFrame([("abcd", "bcde")], "a string, b string").select(matching.sequence_ratio(F.col("a"), F.col("b")).alias("r"))
    assert ratio.first()["r"] == 0.75


def test_placeholders(spark):
    df = spark.createDataFrame([(k, "north") for k in range(12)] + [(20, "nxrth"), (21, "xxxxx"), (22, None)], "k long, v string")
    got = dict(values(cleaning.placeholders(df, "v"), "k", "v"))
    assert got[20] == "north" and got[21] == "north" and got[22] is None


def test_keep_first_keeps_blank_keys(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, ""), (4, None)], "o long, k string")
    assert values(profile.keep_first(df, F.col("k"), "o"), "o") == [(1,), (3,), (4,)]


def test_profile_of_empty_table(spark):
    df = spark.createDataFrame([], "a string, b string")
    assert values(profile.completeness(df, ["a"]), "field", "total", "rate") == [("a", 0, None)]
    assert profile.readiness(df, "a", "b", ["a"]).first()["status"] == "not_ready"
    assert profile.pearson(df.select(F.lit(1.0).alias("x"), F.lit(2.0).alias("y")), "x", "y").first()["r"] is None


def test_repairs_only_what_is_safe(spark):
    d = spark.createDataFrame([(1, "f"), (2, "F"), (3, "Q"), (4, None)], "id long, s string")
    rules = [quality.required("s"), *quality.allowed("s", ["F"])]
    fixed = quality.apply(d, quality.decide(quality.findings(d, rules, "id")), ["s"], "id")
    assert values(fixed, "id", "s", "disposition") == [(1, "F", "repaired"), (2, "F", "clean"), (3, "Q", "blocked"), (4, None, "blocked")]


def test_gap_fill(spark):
    df = spark.createDataFrame([(1, k, "w", 0, p) for k, p in enumerate([1, 0, 1, 0, 0, 1])], "doc long, pos int, token string, label int, predicted int")
    assert [r["filled"] for r in sequence.fill_gaps(df, 1).orderBy("pos").collect()] == [1, 1, 1, 0, 0, 1]


def test_reachable_with_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], "src string, dst string")
    start = spark.createDataFrame([("a",)], "node string")
    assert values(graph.reachable(edges, start), "node", "depth") == [("a", 0), ("b", 1), ("c", 2)]


def test_html_tables(spark):
    html = "<table><tr><th>A<th>B</tr><tr><td>1 &amp; 2<td> x </tr><tr><td></td><td></td></tr></table>"
    pages = spark.createDataFrame([(1, html), (2, None), (3, "<p>no")], "page_id long, html string")
    assert values(readers.html_cells(pages), "id", "row_no", "field", "value") == [(1, 1, "A", "1 & 2"), (1, 1, "B", "x")]


def test_sections_and_series(spark):
    got = one(spark, readers.paper_sections("x"), "Title\nAbstract\nshort\n1. Methods:\nlong text")
    assert [(s["section"], s["body"]) for s in got] == [("abstract", "short"), ("methods", "long text")]
    assert one(spark, readers.paper_sections("x"), "plain")[0]["section"] == "body"
    lines = spark.createDataFrame([('!Sample_title\t"a"\t"b"',), ("other",)], "value string")
    assert values(readers.series_matrix(lines), "sample", "key", "value") == [(0, "title", "a"), (1, "title", "b")]


def test_chunks_cover_the_text():
    text = "One sentence here. " * 300
    spans = chunks.spans(text, 200, 20)
    assert spans[0][0] == 0 and spans[-1][1] == len(text.rstrip())
    assert all(b - a <= 200 for a, b in spans) and all(c <= b for (_, b), (c, _) in zip(spans, spans[1:]))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "=x"), (1, "y")], "k long, v string")
    sinks.write_csv(df, f"{tmp_path}/c")
    assert sorted(r["v"] for r in readers.read_any(spark, f"{tmp_path}/c", "csv").collect()) == ["'=x", "y"]
    sinks.append_log(df.filter("v = '=x'").withColumn("t", F.lit(1)), f"{tmp_path}/log")
    sinks.append_log(df.filter("v = 'y'").withColumn("t", F.lit(2)), f"{tmp_path}/log")
    assert values(sinks.newest(spark, f"{tmp_path}/log", "k", "t"), "k", "v") == [(1, "y")]


def test_stream_without_repeats(spark, tmp_path):
    batch = spark.createDataFrame([(1, 1_000_000), (1, 1_000_000), (2, 1_000_005)], "event_id long, s long").select("event_id", F.timestamp_seconds("s").alias("ts"))
    batch.write.parquet(f"{tmp_path}/in/events.parquet")
    stream = spark.readStream.schema(batch.schema).parquet(f"{tmp_path}/in/events.parquet")
    ingest.to_parquet(ingest.once(stream), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(60)
    assert values(spark.read.parquet(f"{tmp_path}/out"), "event_id") == [(1,), (2,)]


def test_identity_conflicts_see_every_line(spark, tmp_path):
    lines = [(1, k, 7) for k in range(1, 4)] + [(1, 4, 8)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert values(suite.QUERIES["identity_conflicts"](spark, str(tmp_path)), "l_orderkey", "n_values", "least", "greatest") == [(1, 2, 7, 8)]


def test_every_text_has_a_representative(spark):
    df = spark.createDataFrame([(1, "red pen"), (2, "pen red"), (3, "Red red PEN"), (4, "ink"), (5, None)], "id long, text string")
    assert values(matching.representatives(df), "id", "representative") == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 5)]


def test_every_match_from_review_on(spark):
    schema = "id long, study string, name string, code string, patient string"
    left = spark.createDataFrame([(1, "s", "Ann", "x1", "p"), (2, "s", "Bob", "y", "p"), (3, None, "Ann", "x1", "p")], schema)
    right = spark.createDataFrame([(10, "s", "ann", "x1", "p"), (11, "s", "Ann.", "x12", "p"), (12, "s", "Ann", "x1", "q"), (13, "t", "Ann", "x1", "p")], schema)
    got = values(matching.all_matches(left, right, "study", ["name", "code"], guard="patient"), "left_id", "right_id", "score", "verdict")
    assert got == [(1, 10, 1.0, "AUTO"), (1, 11, 0.75, "REVIEW"), (1, 12, 1.0, "REJECT"), (2, 10, 0.0, "REJECT"), (3, None, 0.0, "REJECT")]


def test_document_components_are_union_find(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.substring(matching.compact("text"), 1, 40).alias("k")).collect()
    root, first = {r["doc_id"]: r["doc_id"] for r in docs}, {}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in docs:
        if r["k"]:
            a, b = sorted((find(r["doc_id"]), find(first.setdefault(r["k"], r["doc_id"]))))
            root[b] = a
    sizes = {}
    for d in root:
        sizes[find(d)] = sizes.get(find(d), 0) + 1
    want = sorted(((d, find(d)) for d in root if sizes[find(d)] > 1), key=repr)
    assert want and values(suite.QUERIES["document_components"](spark, sf), "id", "root") == want
