"""Saved answers, mapped values and evaluation reports against values worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from lodestone.functions import series
from lodestone.functions import text as T
from lodestone.operators import evaluation
from lodestone.sources import payloads


def saved(spark, *docs):
    return spark.createDataFrame([(k, d if isinstance(d, str) or d is None else json.dumps(d)) for k, d in enumerate(docs)], "ord int, payload string")


def test_papers(spark):
    a = {"resultList": {"result": [
        {"id": "1", "pmid": "9", "title": " T ", "abstractText": "see gse12, GSE12 and nct01234567; TCGA-BRCA.", "pubYear": "2020", "authorList": {"author": [{"fullName": "A"}, {"lastName": "B"}, {"fullName": ""}]}, "inEPMC": "N"},
        {"id": "", "pmid": "", "title": "no id"}, {"id": "2", "title": ""}, {"id": "PMC 3", "source": "pmc", "title": "U", "pubYear": "soon", "authorList": ["X"], "inEPMC": False},
    ]}}
    rows = payloads.papers(saved(spark, a, None, "not json", "{}", {"resultList": {"result": None}})).orderBy("ord", "place").collect()
    assert [r["paper_id"] for r in rows] == ["europepmc:1", "europepmc:PMC 3"]
    x, y = rows
    assert (x["title"], x["publication_year"], x["authors"], x["fulltext_available"], x["source_url"]) == ("T", 2020, ["A", "B"], True, "https://europepmc.org/article/MED/9")
    assert x["dataset_accessions"] == ["GSE12", "NCT01234567", "TCGA-BRCA"]
    assert (y["abstract"], y["publication_year"], y["authors"], y["fulltext_available"], y["dataset_accessions"]) == (None, None, [], False, [])
    assert y["source_url"].startswith("https://europepmc.org/article/PMC/PMC")


def test_bundles(spark):
    a = {"models": [{"ModelID": "M1", "OncotreeLineage": "Breast"}, {"model_id": "M2", "cell_line_name": "L2", "lineage": "breast cancer"}, {"ModelID": "", "lineage": "Breast"}, {"ModelID": "M3", "lineage": "Lung"}], "sensitivity": [{"ModelID": "M1", "Drug": "x", "AUC": 1}, {"model_id": "M1", "drug": "y", "auc": "0.5", "IC50": "bad"}]}
    got = {r["model_id"]: (r["cell_line_name"], r["drug"], r["auc"], r["ic50"]) for r in payloads.cell_line_bundle(saved(spark, a, "{}"), "d").collect()}
    assert got == {"M1": ("M1", "y", 0.5, None), "M2": ("L2", "d", None, None)}


@pytest.mark.parametrize(("parsed", "field", "want"), [
    ({"pcr": "Yes"}, "treatment_response", series.COMPLETE_TEXT), ({"pcr_rd": " rd "}, "treatment_response", series.RESIDUAL_TEXT), ({"response": "NA", "pcr": "0"}, "treatment_response", series.RESIDUAL_TEXT), ({"response": "yes"}, "treatment_response", "yes"),
    ({"pcr": "maybe"}, "treatment_response", "maybe"), ({"pcr": "yes"}, "pcr", "yes"), ({"er_ihc": "+", "er": "-"}, "er_status", "-"), ({"grade": "2"}, "grade", "2"), ({}, "age", None), (None, "age", None), ({"age": ""}, "age", None),
])
def test_mapped_values(spark, parsed, field, want):
    df = spark.createDataFrame([(parsed,)], "parsed map<string,string>")
    assert df.select(series.mapped_value("parsed", field)).first()[0] == want


def test_contains(spark):
    df = spark.createDataFrame([("Primary Tumor",), ("原发灶",), ("normal",), ("NA",), (None,), ("",)], "v string")
    assert [r[0] for r in df.select(T.contains("v", "PRIMARY", "原发")).collect()] == [True, True, False, False, False, False]
    assert not any(r[0] for r in df.select(T.contains("v", "na")).collect()) and not any(r[0] for r in df.select(T.contains("v")).collect())


ITEM = "task_id int, candidate boolean, ord int, dataset_id string, accession string, source_id string, dataset_name string, source_name string, source_database string"


def test_sources_and_ranks(spark):
    items = [(1, False, 1, "D", None, None, None, None, None), (1, True, 2, None, "gse1", None, "N", None, ""), (1, True, 1, None, None, None, None, None, ""), (1, False, 3, None, "GSE1 ", None, "n", None, None), (2, False, 1, "x", None, None, None, None, "GEO")]
    rows = evaluation.source_rows(spark.createDataFrame(items, ITEM))
    assert sorted((r["task_id"], r["place"], r["dataset_id"], r["accession"]) for r in rows.collect()) == [(1, 1, None, "gse1"), (1, 2, "D", None), (2, 1, "x", None)]
    want = spark.createDataFrame([(1, "d"), (1, "zzz"), (2, "geo"), (3, "x")], "task_id int, name string")
    assert sorted(tuple(r) for r in evaluation.source_ranks(rows, want).select("task_id", "rank").collect()) == [(1, 2), (2, 1), (3, None)]


def test_summary(spark):
    score = "struct<overall:double,claim_support_rate:double,faithfulness:double,relevance:double,completeness:double,retrieval_quality:double>"
    schema = f"case_id string, rank int, difficulty string, latency_ms double, scores {score}"
    runs = [("a", 1, "easy", 10.0, (1.0, None, 2.0, None, 3.0, 4.0)), ("a", 4, "easy", None, None), ("b", None, None, 20.0, (None, 1.0, 9.0, 9.0, 9.0, 9.0)), ("c", 3, "hard", 30.0, (0.0, 0.5, 4.0, None, None, 4.0))]
    got = {r["metric"]: r["value"] for r in evaluation.summary(spark.createDataFrame(runs, schema)).collect()}
    assert got == pytest.approx({
        "cases": 4, "recall@1": 0.25, "recall@3": 0.5, "recall@5": 0.75, "mrr@3": (1 + 1 / 3) / 4, "ndcg@3": (1 + 0.5) / 4, "avg_latency_ms": 15.0, "judge_valid_rate": 0.5, "avg_faithfulness": 3.0, "avg_relevance": None, "avg_completeness": 3.0,
        "avg_retrieval_quality": 4.0, "avg_overall": 0.5, "avg_claim_support_rate": 0.25, "recall@3_easy": 0.5, "recall@3_medium": 0.0, "recall@3_hard": 1.0,
    })
    none = {r["metric"]: r["value"] for r in evaluation.summary(spark.createDataFrame([], schema)).collect()}
    assert none["cases"] == 0 and none["recall@1"] == 0 and none["avg_overall"] is None
