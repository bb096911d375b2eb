"""Queries on rule families, repair, gates, coverage, graphs, sequences, payloads and intents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import intent as I
from ..functions import series as B
from ..functions import text as T
from ..operators import cleaning as C
from ..operators import coverage as V
from ..operators import evaluation as Q
from ..operators import governance as G
from ..operators import graph as H
from ..operators import profile as D
from ..operators import retrieval as R
from ..operators import sequence as S
from ..shared import new_path
from ..sources import exports as E
from ..sources import payloads as P
from ..sources import readers, scans
from ..streaming import loops as Z
from .records import _tagged, _TAGGED
from .tables import Suite, read

suite = Suite()
QUERIES, ORACLE_SQL = suite.queries, suite.sql


def _pick(c, *values):
    return F.element_at(F.array(*(F.lit(v) if v is not None else F.lit(None).cast("string") for v in values)), (F.col(c) % len(values) + 1).cast("int"))


def _clinical_records(spark, sf):
    """Orders as canonical records with faults of every family."""
    k = "o_orderkey"
    return read(spark, sf, "orders").select(
        F.col(k).alias("id"), F.concat(F.lit("S"), (F.col(k) % 3).cast("string")).alias("study_id"), (F.col("o_custkey") % 50).cast("string").alias("patient_id"), (F.col(k) % 400).cast("string").alias("sample_id"), F.lit("breast cancer").alias("disease"),
        F.when(F.col(k) % 17 != 0, "src").alias("source_id"), F.lit("her2").alias("raw_field"), _pick(k, "2+", "3+", "unknown", "neg").alias("raw_value"), F.lit("0.9").alias("confidence"), _pick(k, "IHC", "FISH").alias("her2_assay"),
        _pick(k, "Positive", "Positive", "Negative", "Negative").alias("her2_status"), _pick(k, "ERBB2", "HER2", "tp53", "herceptin", None).alias("gene"), _pick(k, "Trastuzumab", "trastuzumab", "Herceptin", "PIK3CA", "other").alias("drug"),
        _pick(k, "auc", "pcr", None).alias("response_type"), _pick(k, "clinical", "preclinical_cell_line").alias("response_domain"), F.when(F.col(k) % 19 == 0, "stge II").otherwise("II").alias("stage"), _pick(k, "high", "low", "high").alias("source_authority"),
    )


_RECORDS = """r AS (SELECT o_orderkey AS id, 'S' || (o_orderkey % 3) AS study_id, (o_custkey % 50)::VARCHAR AS patient_id, (o_orderkey % 400)::VARCHAR AS sample_id, CASE WHEN o_orderkey % 17 <> 0 THEN 'src' END AS source_id, ['2+', '3+', 'unknown', 'neg'][o_orderkey % 4 + 1] AS raw_value,
 ['IHC', 'FISH'][o_orderkey % 2 + 1] AS her2_assay, ['Positive', 'Positive', 'Negative', 'Negative'][o_orderkey % 4 + 1] AS her2_status, ['ERBB2', 'HER2', 'tp53', 'herceptin', NULL][o_orderkey % 5 + 1] AS gene, ['Trastuzumab', 'trastuzumab', 'Herceptin', 'PIK3CA', 'other'][o_orderkey % 5 + 1] AS drug,
 ['auc', 'pcr', NULL][o_orderkey % 3 + 1] AS response_type, ['clinical', 'preclinical_cell_line'][o_orderkey % 2 + 1] AS response_domain, CASE WHEN o_orderkey % 19 = 0 THEN 'stge II' ELSE 'II' END AS stage, ['high', 'low', 'high'][o_orderkey % 3 + 1] AS source_authority FROM orders),
f AS (SELECT id, 'MISSING_EVIDENCE' AS rule, 'provenance_missing' AS kind, 'high' AS risk, 'source_id' AS field, NULL::VARCHAR AS candidate FROM r WHERE source_id IS NULL
 UNION ALL SELECT id, 'UNKNOWN_NOT_NEGATIVE', 'schema_mapping_error', 'medium', 'her2_status', NULL FROM r WHERE her2_status = 'Negative' AND raw_value = 'unknown' UNION ALL SELECT id, 'HER2_IHC_2PLUS', 'her2_assay_error', 'high', 'her2_status', NULL FROM r WHERE her2_assay = 'IHC' AND raw_value = '2+' AND her2_status = 'Positive'
 UNION ALL SELECT id, 'CROSS_DOMAIN_RESPONSE', 'cross_domain_response', 'high', 'response_domain', NULL FROM r WHERE response_type = 'auc' AND response_domain = 'clinical' UNION ALL SELECT id, 'CLINICAL_STAGE_TYPO', 'schema_mapping_error', 'medium', 'stage', NULL FROM r WHERE stage = 'stge II'
 UNION ALL SELECT id, 'GENE_DRUG_DIMENSION', 'schema_mapping_error', 'high', 'gene', NULL FROM r WHERE gene = 'herceptin' UNION ALL SELECT id, 'GENE_ALIAS_EXACT', 'gene_alias', 'low', 'gene', 'ERBB2' FROM r WHERE gene = 'HER2' UNION ALL SELECT id, 'CASING_NORMALIZATION', 'casing', 'low', 'gene', 'TP53' FROM r WHERE gene = 'tp53'
 UNION ALL SELECT id, 'GENE_DRUG_DIMENSION', 'schema_mapping_error', 'high', 'drug', NULL FROM r WHERE drug = 'PIK3CA' UNION ALL SELECT id, 'DRUG_ALIAS_EXACT', 'drug_alias', 'low', 'drug', 'Trastuzumab' FROM r WHERE drug = 'Herceptin' UNION ALL SELECT id, 'CASING_NORMALIZATION', 'casing', 'low', 'drug', 'Trastuzumab' FROM r WHERE drug = 'trastuzumab'
 UNION ALL SELECT id, 'LOW_CONFIDENCE_PATIENT_LINK', 'patient_sample_conflict', 'high', 'patient_id', NULL FROM r WHERE (study_id, sample_id) IN (SELECT (study_id, sample_id) FROM r GROUP BY study_id, sample_id HAVING count(DISTINCT patient_id) > 1)
 UNION ALL SELECT id, 'EXACT_DUPLICATE', 'exact_duplicate', 'low', NULL, 'quarantine' FROM (SELECT id, min(id) OVER (PARTITION BY study_id, patient_id, sample_id, source_id, raw_value, her2_assay, her2_status, gene, drug, response_type, response_domain, stage, source_authority) AS first FROM r) WHERE id > first)"""
_SAFE = "g AS (SELECT *, CASE WHEN kind = 'provenance_missing' THEN 'BLOCK' WHEN risk = 'high' THEN 'REVIEW' WHEN candidate IS NOT NULL THEN 'AUTO' ELSE 'REVIEW' END AS action, bool_or(risk = 'high' OR kind = 'provenance_missing') OVER (PARTITION BY id) AS guarded FROM f)"


@suite.add(f"WITH {_RECORDS} SELECT id, rule, kind, risk, field, candidate FROM f")
def classified_findings(spark, sf):
    return G.classify(_clinical_records(spark, sf), "id").select("id", "rule", "kind", "risk", "field", "candidate")


@suite.add(f"WITH {_RECORDS} SELECT kind, count(*) AS n_findings, count(*) FILTER (risk = 'high') AS n_high, count(candidate) AS n_candidates FROM f GROUP BY kind")
def classified_summary(spark, sf):
    return G.classified_summary(G.classify(_clinical_records(spark, sf), "id"))


@suite.add(f"WITH {_RECORDS}, {_SAFE} SELECT id, rule, field, action, (CASE WHEN candidate IS NOT NULL THEN 0.99 WHEN risk = 'high' THEN 0.82 ELSE 0.72 END)::DOUBLE AS confidence FROM g")
def detected_errors(spark, sf):
    return G.detected(G.classify(_clinical_records(spark, sf), "id")).select("id", "rule", "field", "action", "confidence")


@suite.add(f"WITH {_RECORDS}, {_SAFE} SELECT id, rule, field, CASE WHEN kind = 'exact_duplicate' THEN 'quarantine' ELSE 'replace' END AS operation, candidate, NOT guarded AS safe, guarded AND action <> 'BLOCK' AS review FROM g WHERE candidate IS NOT NULL")
def repair_candidates(spark, sf):
    return G.candidates(G.classify(_clinical_records(spark, sf), "id")).select("id", "rule", "field", "operation", "candidate", "safe", "review")


def _loop(spark, sf):
    return G.repair_loop(_clinical_records(spark, sf), "id", ["gene", "drug"])


@suite.add(f"""WITH {_RECORDS}, {_SAFE}, p AS (SELECT id, bool_or(kind = 'provenance_missing') AS b, bool_or(kind <> 'provenance_missing' AND (guarded OR candidate IS NULL)) AS rv, max(CASE WHEN NOT guarded AND field = 'gene' THEN candidate END) AS ng, max(CASE WHEN NOT guarded AND field = 'drug' THEN candidate END) AS nd, bool_or(NOT guarded AND kind = 'exact_duplicate') AS q FROM g GROUP BY id)
SELECT id, coalesce(ng, gene) AS gene, coalesce(nd, drug) AS drug, CASE WHEN b THEN 'blocked' WHEN rv THEN 'review' WHEN q THEN 'quarantined' WHEN ng IS NOT NULL OR nd IS NOT NULL THEN 'repaired' ELSE 'clean' END AS disposition FROM r LEFT JOIN p USING (id)""")
def repair_loop(spark, sf):
    return _loop(spark, sf)[0].select("id", "gene", "drug", "disposition")


@suite.add(f"""WITH {_RECORDS}, {_SAFE}, p AS (SELECT id, bool_or(kind = 'provenance_missing') AS b, bool_or(kind <> 'provenance_missing' AND (guarded OR candidate IS NULL)) AS rv, bool_or(NOT guarded AND candidate IS NOT NULL AND kind <> 'exact_duplicate') AS fx, bool_or(NOT guarded AND kind = 'exact_duplicate') AS q FROM g GROUP BY id)
SELECT (SELECT count(*) FROM r) AS n_records, count(*) FILTER (fx AND NOT b AND NOT rv AND NOT q) AS n_repaired, count(*) FILTER (q AND NOT b AND NOT rv) AS n_quarantined, count(*) FILTER (rv AND NOT b) AS n_review, count(*) FILTER (b) AS n_blocked, 0 AS n_rolled_back, CASE WHEN count(*) FILTER (b) > 0 THEN 'FAIL' WHEN count(*) FILTER (rv AND NOT b) > 0 THEN 'REVIEW' ELSE 'PASS' END AS gate FROM p""")
def repair_verdict(spark, sf):
    return _loop(spark, sf)[1]


@suite.add(f"WITH {_RECORDS} SELECT (SELECT count(*) FROM r) AS n_records, count(DISTINCT id) AS n_failed, count(*) = 0 AS passed FROM f WHERE rule NOT IN ('LOW_CONFIDENCE_PATIENT_LINK', 'EXACT_DUPLICATE')")
def revalidation(spark, sf):
    return G.validated(_clinical_records(spark, sf), "id")


def _proposals(spark, sf):
    e = "event_id"
    return read(spark, sf, "events").select(F.col(e), (F.col(e) % 100 / 100).alias("confidence"), (F.col(e) % 7).cast("string").alias("n_evidence"), _pick(e, "IHC", "FISH").alias("her2_assay"), _pick(e, "2+", "3+", "1+").alias("raw_value"), _pick(e, "Positive", "Negative").alias("her2_status"), _pick(e, "entity_link", "mapping", "mapping", "mapping", "mapping").alias("task_type"), _pick(e, "LINKED", "REJECTED", "", "REVIEW", "LINKED").alias("patient_sample_linker_status"), _pick(e, "true", "false", "true").alias("auto_merge_allowed"), _pick(e, "AUC", "pcr", "pcr", "pcr", "pcr", "pcr", "pcr", "pcr", "pcr", "pcr", "pcr").alias("response_type"), F.lit("clinical").alias("response_domain"))


@suite.add("""WITH p AS (SELECT event_id, event_id % 100 / 100.0 AS c, event_id % 7 = 0 AS noev, event_id % 2 = 0 AND event_id % 3 = 0 AS ihc, event_id % 5 = 0 AS link, event_id % 3 <> 1 AS am, event_id % 11 = 0 AS dom FROM events)
SELECT event_id, CASE WHEN noev OR ihc OR dom OR c < 0.65 THEN 'REJECT' WHEN (link AND NOT am) OR c < 0.9 THEN 'REVIEW' ELSE 'AUTO' END AS status,
 array_to_string(list_filter([CASE WHEN noev THEN 'MISSING_EVIDENCE' END, CASE WHEN ihc THEN 'HER2_IHC_2PLUS' END, CASE WHEN dom THEN 'CROSS_DOMAIN_RESPONSE' END, CASE WHEN link AND NOT am THEN 'PATIENT_SAMPLE_LINKER_GATE' END], lambda x: x IS NOT NULL), ',') AS rules FROM p""")
def safety_decisions(spark, sf):
    return G.safety(_proposals(spark, sf)).select("event_id", "status", F.array_join("rules", ",").alias("rules"))


@suite.add("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN '' ELSE 'contract_not_frozen,' END || CASE WHEN o_orderkey % 3 = 0 THEN 'provenance_incomplete,' ELSE '' END || CASE WHEN o_orderkey % 5 = 0 THEN 'quality_gate,' ELSE '' END AS failures, o_orderstatus = 'F' AND o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 AS ready FROM orders""")
def publication_gates(spark, sf):
    k = F.col("o_orderkey")
    o = read(spark, sf, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").cast("string").alias("frozen"), (k % 3 != 0).cast("string").alias("provenance_complete"), F.lit("false").alias("unresolved_identity"), F.lit("false").alias("forbidden_join"), F.when(k % 5 == 0, "REVIEW").otherwise("PASS").alias("quality_gate"))
    return G.publication_ready(o).select("o_orderkey", F.concat(F.array_join("failures", ","), F.when(F.size("failures") > 0, ",").otherwise("")).alias("failures"), "ready")


@suite.add("SELECT o_orderkey, list_filter([CASE WHEN o_orderkey % 3 = 0 THEN 'source_id' END, CASE WHEN o_orderkey % 5 = 0 THEN 'raw_field' END, CASE WHEN o_orderkey % 7 = 0 THEN 'raw_value' END], lambda x: x IS NOT NULL) AS missing FROM orders")
def provenance_gaps(spark, sf):
    k = F.col("o_orderkey")
    df = read(spark, sf, "orders").select(k, F.when(k % 3 != 0, "s").alias("source_id"), F.when(k % 5 == 0, " ").otherwise("f").alias("raw_field"), F.when(k % 7 != 0, "v").alias("raw_value"))
    return df.select("o_orderkey", G.missing_provenance(df).alias("missing"))


@suite.add("""WITH c AS (SELECT n_nationkey, ['outcome', 'exposure', 'covariate'][n_nationkey % 3 + 1] AS role, CASE WHEN n_nationkey % 4 = 0 THEN 0 ELSE 1 END AS cov FROM nation)
SELECT 'MISSING_OUTCOME' AS diagnosis, 'blocker' AS severity FROM c WHERE role = 'outcome' AND cov = 0 HAVING count(*) > 0 UNION ALL SELECT 'MISSING_EXPOSURE', 'blocker' FROM c WHERE role = 'exposure' AND cov = 0 HAVING count(*) > 0 UNION ALL SELECT 'MISSING_COVARIATES', 'warning' FROM c WHERE role = 'covariate' AND cov = 0 HAVING count(*) > 0
UNION ALL SELECT 'FORBIDDEN_JOIN', 'blocker' UNION ALL SELECT 'MISSING_EVIDENCE', 'warning'""")
def gap_diagnosis(spark, sf):
    cov = read(spark, sf, "nation").select(F.col("n_name").alias("field"), _pick("n_nationkey", "outcome", "exposure", "covariate").alias("role"), F.when(F.col("n_nationkey") % 4 == 0, 0.0).otherwise(1.0).alias("coverage"))
    state = spark.range(1).select(F.lit(5).alias("row_count"), F.lit(True).alias("target_match"), F.lit(False).alias("unresolved_identity"), F.lit(True).alias("forbidden_join"), F.lit(True).alias("provenance_complete"), F.lit(False).alias("parsing_failed"), F.lit(0).alias("n_literature"))
    return G.critic(cov, state)


@suite.add("""WITH m AS (SELECT n_nationkey AS iteration, least(1.0, n_nationkey / 20.0)::DOUBLE AS cv, (n_nationkey % 3) / 2.0::DOUBLE AS tg, 0.9::DOUBLE AS tr, n_nationkey % 6 AS g FROM nation) SELECT iteration, round(0.45 * cv + 0.25 * tg + 0.2 * tr + 0.1 * (1 - least(1.0, g / 5.0)), 6)::DOUBLE AS progress FROM m""")
def loop_progress(spark, sf):
    return _metrics_rows(spark, sf).transform(G.progress).select("iteration", "progress")


def _metrics_rows(spark, sf):
    n = F.col("n_nationkey")
    return read(spark, sf, "nation").select(n.alias("iteration"), F.least(F.lit(1.0), n / 20.0).alias("coverage"), (n % 3 / 2.0).alias("target"), F.lit(0.9).alias("traceability"), (n % 6).alias("n_gaps"), F.when(n > 20, "PASS").otherwise("REVIEW").alias("quality_gate"), n.cast("string").alias("plan_hash"))


@suite.add("""WITH m AS (SELECT n_nationkey AS iteration, round(0.45 * least(1.0, n_nationkey / 20.0) + 0.25 * (n_nationkey % 3) / 2.0 + 0.2 * 0.9 + 0.1 * (1 - least(1.0, n_nationkey % 6 / 5.0)), 6)::DOUBLE AS progress FROM nation), b AS (SELECT *, progress - lag(progress) OVER (ORDER BY iteration) AS gain FROM m)
SELECT iteration, progress, CASE WHEN progress >= 1 OR (iteration > 20 AND iteration % 6 = 0) THEN 'stop_done' WHEN gain < 0.01 THEN 'stop_no_gain' WHEN iteration >= 5 THEN 'stop_rounds' ELSE 'continue' END AS decision FROM b""")
def loop_decisions(spark, sf):
    return G.decided_steps(_metrics_rows(spark, sf)).select("iteration", "progress", "decision")


@suite.add("""SELECT c_custkey, 'casing' AS fault, lower(c_mktsegment) AS segment FROM customer UNION ALL SELECT c_custkey, 'blank', '' FROM customer UNION ALL SELECT c_custkey, NULL, c_mktsegment FROM customer""")
def injected_faults(spark, sf):
    c = read(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    return G.injected(c, "c_custkey", "segment", {"casing": F.lower("segment"), "blank": F.lit("")}).select("c_custkey", "fault", "segment")


@suite.add("""WITH g AS (SELECT p_partkey % 1900 AS case_id, p_size AS s, p_partkey AS k FROM part)
SELECT case_id, problem FROM (SELECT case_id, unnest([CASE WHEN s = 1 THEN 'unknown_field' END, CASE WHEN s % 7 = 0 THEN 'not_reviewed' END, CASE WHEN s % 5 = 0 AND s % 2 = 0 THEN 'forbidden_repair' END]) AS problem FROM g) WHERE problem IS NOT NULL UNION ALL SELECT case_id, 'repeated_case' FROM g GROUP BY case_id HAVING count(*) > 1""")
def gold_findings(spark, sf):
    s = F.col("p_size")
    g = read(spark, sf, "part").select((F.col("p_partkey") % 1900).alias("case_id"), F.when(s == 1, "other").otherwise("gene").alias("field"), F.when(s % 7 == 0, "draft").otherwise("approved").alias("review_status"), (s % 5 == 0).alias("auto_allowed"), F.when(s % 2 == 0, "high").otherwise("low").alias("risk_level"))
    return G.gold_findings(g, ["gene", "drug"])


@suite.add("SELECT count(*) FILTER (p_size % 2 = 0 AND p_partkey % 3 = 0) AS tp, count(*) FILTER (p_size % 2 <> 0 AND p_partkey % 3 = 0) AS fp, count(*) FILTER (p_size % 2 = 0 AND p_partkey % 3 <> 0) AS fn, count(*) FILTER (p_size % 2 <> 0 AND p_partkey % 3 <> 0) AS tn FROM part")
def gold_counts(spark, sf):
    p = read(spark, sf, "part")
    return G.gold_counts(p.select(F.col("p_partkey").alias("case_id"), (F.col("p_size") % 2 == 0).alias("expected")), p.select(F.col("p_partkey").alias("case_id"), (F.col("p_partkey") % 3 == 0).alias("detected")))


@suite.add("SELECT p_partkey, CASE WHEN p_size = 1 OR p_size % 10 = 3 THEN 'FAIL' WHEN p_size % 5 = 0 OR p_size % 4 = 0 THEN 'REVIEW' ELSE 'PASS' END AS safety FROM part")
def evaluation_safety(spark, sf):
    s = F.col("p_size")
    m = read(spark, sf, "part").select("p_partkey", (s == 1).cast("int").alias("n_forbidden_repairs"), F.when(s % 10 == 3, 0.02).otherwise(0.0).alias("fake_source_rate"), F.when(s % 5 == 0, 0.8).otherwise(0.95).alias("faithfulness"), F.when(s % 4 == 0, 0.9).otherwise(0.99).alias("traceability"), F.lit(0).alias("n_unresolved"))
    return G.assessed(m).select("p_partkey", "safety")


def _catalogue(spark, sf):
    """Nations as datasets that offer some of the regions' fields."""
    n = "n_nationkey"
    hints = F.array_compact(F.array(F.when(F.col(n) % 2 == 0, "mutation"), F.when(F.col(n) % 3 == 0, "survival"), F.when(F.col(n) % 5 == 0, "pcr"), F.when(F.col(n) % 7 == 0, "AGE")))
    sources = read(spark, sf, "nation").select(F.col("n_name").alias("dataset_id"), hints.alias("field_hints"), F.when(F.col(n) % 4 == 0, F.array(F.lit("patient"))).otherwise(F.array(F.lit("study"))).alias("granularity"), (F.col(n) % 10 / 10).alias("authority"), F.lit(0.5).alias("traceability"), (F.col(n) % 6 / 10).alias("structuredness"), (F.col(n) % 9 / 10).alias("cost"), _pick(n, "OPEN_API", "REQUEST").alias("access_mode"), F.col(n).alias("ord"), _pick(n, "live", "planned", "live").alias("status"))
    rows = [("pik3ca_mutation", "pik3ca", "required"), ("os_months", "os", "required"), ("pcr", "pcr", "required"), ("response_domain", "domain", "recommended"), ("age", "age", "recommended")]
    return spark.createDataFrame(rows, "field_id string, canonical_name string, priority string"), sources


_MATRIX = """s AS (SELECT n_name AS dataset_id, n_nationkey AS n FROM nation), c AS (
 SELECT 'pik3ca_mutation' AS field_id, 'required' AS priority, dataset_id, n, CASE WHEN n % 2 = 0 THEN 0.75 ELSE 0 END AS coverage FROM s UNION ALL SELECT 'os_months', 'required', dataset_id, n, CASE WHEN n % 3 = 0 THEN 0.75 ELSE 0 END FROM s
 UNION ALL SELECT 'pcr', 'required', dataset_id, n, CASE WHEN n % 5 = 0 THEN 1 ELSE 0 END FROM s UNION ALL SELECT 'response_domain', 'recommended', dataset_id, n, CASE WHEN n % 5 = 0 THEN 1 ELSE 0 END FROM s UNION ALL SELECT 'age', 'recommended', dataset_id, n, CASE WHEN n % 7 = 0 THEN 1 ELSE 0 END FROM s),
 w AS (SELECT dataset_id, n, round(avg(coverage) FILTER (priority = 'required'), 6) AS rq, round(avg(coverage) FILTER (priority = 'recommended'), 6) AS rc, avg(coverage) FILTER (priority = 'required') AS raw FROM c GROUP BY ALL)"""


@suite.add(f"WITH {_MATRIX} SELECT field_id, priority, dataset_id, coverage::DOUBLE AS coverage FROM c")
def coverage_matrix(spark, sf):
    return V.matrix(*_catalogue(spark, sf)).drop("basis")


@suite.add(f"WITH {_MATRIX} SELECT dataset_id, greatest(0, least(1, round(0.52 * rq + 0.1 * rc + 0.1 * (n % 10 / 10.0) + 0.08 * 0.5 + 0.07 * CASE WHEN n % 4 = 0 THEN 1 ELSE 0.4 END + 0.05 * (n % 6 / 10.0) + 0.05 * CASE WHEN n % 2 = 0 THEN 1 ELSE 0.5 END - 0.03 * (n % 9 / 10.0), 6)))::DOUBLE AS score FROM w")
def dataset_scores(spark, sf):
    fields, sources = _catalogue(spark, sf)
    return V.scores(V.matrix(fields, sources), sources)


@suite.add(f"WITH {_MATRIX} SELECT dataset_id, round(1 - raw + n % 9 / 10.0 + 0.35 * (1 - n % 10 / 10.0) + 0.15 * (1 - n % 6 / 10.0), 9)::DOUBLE AS cost FROM w")
def dataset_costs(spark, sf):
    fields, sources = _catalogue(spark, sf)
    return V.costs(V.matrix(fields, sources), sources)


def _cover_sql(order: str, guarded: bool, steps: int = 3) -> str:
    """The walk down the ranked sources, a step a table; a step without a source leaves the later ones empty."""
    need = "m AS (SELECT dataset_id, n, max(coverage) FILTER (field_id = 'pik3ca_mutation')::DOUBLE AS a, max(coverage) FILTER (field_id = 'os_months')::DOUBLE AS b, max(coverage) FILTER (field_id = 'pcr')::DOUBLE AS c FROM c GROUP BY ALL)"
    parts = [need, f"k AS (SELECT *, n % 4 = 0 AS pt, row_number() OVER (ORDER BY {order}) AS rn FROM m JOIN v USING (dataset_id))", "t1 AS (SELECT *, a + b + c AS gain, a AS ba, b AS bb, c AS bc FROM k WHERE rn = 1)"]
    for i in range(2, steps + 1):
        guard = "AND NOT (t.pt AND k.pt)" if guarded else ""
        parts.append(f"t{i} AS (SELECT * FROM (SELECT k.*, greatest(0, k.a - ba) + greatest(0, k.b - bb) + greatest(0, k.c - bc) AS gain, greatest(k.a, ba) AS ba, greatest(k.b, bb) AS bb, greatest(k.c, bc) AS bc FROM k JOIN t{i - 1} t ON k.rn > t.rn {guard}) WHERE gain > 0 ORDER BY rn LIMIT 1)")
    return ", ".join(parts)


_SCORE = "v AS (SELECT dataset_id, greatest(0, least(1, round(0.52 * rq + 0.1 * rc + 0.1 * (n % 10 / 10.0) + 0.08 * 0.5 + 0.07 * CASE WHEN n % 4 = 0 THEN 1 ELSE 0.4 END + 0.05 * (n % 6 / 10.0) + 0.05 * CASE WHEN n % 2 = 0 THEN 1 ELSE 0.5 END - 0.03 * (n % 9 / 10.0), 6)))::DOUBLE AS score FROM w)"
_COST = "v AS (SELECT dataset_id, round(1 - raw + n % 9 / 10.0 + 0.35 * (1 - n % 10 / 10.0) + 0.15 * (1 - n % 6 / 10.0), 9)::DOUBLE AS cost FROM w)"
_CHOSEN = " UNION ALL ".join(f"SELECT {i}::BIGINT AS step, dataset_id, gain FROM t{i}" for i in (1, 2, 3))
_BY_SCORE = f"{_MATRIX}, {_SCORE}, {_cover_sql('score DESC, dataset_id', False)}"


@suite.add(f"WITH {_BY_SCORE} {_CHOSEN}")
def selected_sources(spark, sf):
    fields, sources = _catalogue(spark, sf)
    return V.selected(V.matrix(fields, sources), sources)


@suite.add(f"WITH {_MATRIX}, {_COST}, {_cover_sql('cost, n', True)} {_CHOSEN}")
def weighted_cover(spark, sf):
    fields, sources = _catalogue(spark, sf)
    return V.covered(V.matrix(fields, sources), sources)


@suite.add(f"""WITH {_BY_SCORE}, x AS (SELECT (ba + bb + bc) / 3 AS share, (ba <= 0)::INT + (bb <= 0)::INT + (bc <= 0)::INT AS none, 1 AS i FROM t1 UNION ALL SELECT (ba + bb + bc) / 3, (ba <= 0)::INT + (bb <= 0)::INT + (bc <= 0)::INT, 2 FROM t2 UNION ALL SELECT (ba + bb + bc) / 3, (ba <= 0)::INT + (bb <= 0)::INT + (bc <= 0)::INT, 3 FROM t3)
SELECT round(min_by(share, i), 6)::DOUBLE AS primary_coverage, round(max_by(share, i), 6)::DOUBLE AS portfolio_coverage, max_by(none, i)::BIGINT AS n_uncovered, CASE WHEN min_by(share, i) < 1 THEN 'PARTIAL' ELSE 'READY' END AS status FROM x""")
def source_plan(spark, sf):
    fields, sources = _catalogue(spark, sf)
    cells = V.matrix(fields, sources)
    return V.plan_summary(cells, V.selected(cells, sources))


@suite.add("SELECT a.n_name AS left, b.n_name AS right, 'FORBIDDEN_PATIENT_JOIN' AS decision FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_nationkey % 4 = 0 AND b.n_nationkey % 4 = 0")
def forbidden_joins(spark, sf):
    _, sources = _catalogue(spark, sf)
    return V.join_policies(sources.select("dataset_id", F.col("ord").alias("step")), sources)


@suite.add("SELECT n_name AS dataset_id, n_name <> 'CHINA' AND n_nationkey % 3 <> 1 AS usable FROM nation")
def usable_sources(spark, sf):
    return V.usable(_catalogue(spark, sf)[1], ["china"]).select("dataset_id", "usable")


@suite.add("""WITH p AS (SELECT DISTINCT c_mktsegment AS profile_id, c_nationkey % 9 + CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE c_custkey % 3 END AS field, c_mktsegment = 'MACHINERY' AS live FROM customer), w AS (SELECT field, 1.0::DOUBLE / count(*) AS w FROM (SELECT DISTINCT profile_id, field FROM p) GROUP BY field)
SELECT profile_id, round(sum(w) / (SELECT sum(w) FROM w), 6) AS coverage, round(round(sum(w) / (SELECT sum(w) FROM w), 6) + CASE WHEN profile_id = 'BUILDING' THEN 2 ELSE 0 END + CASE WHEN bool_or(live) THEN 0.1 ELSE 0 END, 6) AS score FROM p JOIN w USING (field) GROUP BY profile_id""")
def profile_scores(spark, sf):
    c = read(spark, sf, "customer")
    p = c.select(F.col("c_mktsegment").alias("profile_id"), (F.col("c_nationkey") % 9 + F.when(F.col("c_mktsegment") == "BUILDING", 0).otherwise(F.col("c_custkey") % 3)).alias("field"), (F.col("c_mktsegment") == "MACHINERY").alias("live"))
    return V.profile_scores(p, ["BUILDING"])


@suite.add("SELECT o_orderkey AS dataset_id, o_orderstatus = 'F' AS ready, o_orderkey % 4 AS target_match, o_totalprice AS coverage, o_custkey AS n_rows FROM orders ORDER BY ready DESC, target_match DESC, coverage DESC, n_rows DESC, dataset_id LIMIT 1")
def best_dataset(spark, sf):
    return V.best_dataset(read(spark, sf, "orders").select(F.col("o_orderkey").alias("dataset_id"), (F.col("o_orderstatus") == "F").alias("ready"), (F.col("o_orderkey") % 4).alias("target_match"), F.col("o_totalprice").alias("coverage"), F.col("o_custkey").alias("n_rows")))


def _planning(spark, sf):
    d = read(spark, sf, "documents")
    papers = d.select(F.col("doc_id").alias("paper_id"), F.col("source").alias("title"), F.array(F.col("lang")).alias("accessions"))
    questions = read(spark, sf, "benchmark").select(F.col("item_id").alias("candidate_id"), F.lit("q").alias("question"), F.array(F.col("item_id"), F.col("item_id") + 1).alias("paper_ids"))
    chunks = d.select(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("section"), F.lit(0).alias("chunk_index"), F.col("doc_id").alias("paper_id"))
    return papers, questions, chunks


@suite.add("""SELECT 'topic:t' AS src, 'paper:' || doc_id AS dst, 'HAS_EVIDENCE_CANDIDATE' AS relation FROM documents UNION SELECT 'paper:' || doc_id, 'dataset:' || lang, 'USES_DATASET' FROM documents UNION SELECT 'topic:t', 'question:' || item_id, 'FORMULATES' FROM benchmark
UNION SELECT 'paper:' || p, 'question:' || item_id, 'SUPPORTS' FROM (SELECT item_id, unnest([item_id, item_id + 1]) AS p FROM benchmark) UNION SELECT 'chunk:' || doc_id, 'paper:' || doc_id, 'EXTRACTED_FROM' FROM documents""")
def lineage_edges(spark, sf):
    return H.lineage(*_planning(spark, sf), "t")[1]


@suite.add("SELECT 'topic:t' AS node, 'ResearchTopic' AS node_type, 't' AS label UNION SELECT 'paper:' || doc_id, 'Paper', source FROM documents UNION SELECT 'dataset:' || lang, 'Dataset', lang FROM documents UNION SELECT 'question:' || item_id, 'ResearchQuestion', 'q' FROM benchmark UNION SELECT 'chunk:' || doc_id, 'PaperChunk', lang || ' #1' FROM documents")
def lineage_nodes(spark, sf):
    return H.lineage(*_planning(spark, sf), "t")[0]


@suite.add("SELECT DISTINCT n_regionkey::VARCHAR AS paper_id FROM nation WHERE n_nationkey % 4 = 1")
def related_papers(spark, sf):
    n = read(spark, sf, "nation")
    edges = n.select(F.concat(F.lit("paper:"), F.col("n_regionkey").cast("string")).alias("src"), F.concat(F.lit("field:f"), (F.col("n_nationkey") % 4).cast("string")).alias("dst"), F.lit("DEFINES").alias("relation"))
    return H.related_papers(edges, "f1")


def _reasons(spark, sf):
    edges = H.projected(read(spark, sf, "customer").select(F.lit("FLAGGED_BY").alias("edge_type"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("src"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("dst"), F.lit("lives there").alias("reason")).union(read(spark, sf, "nation").select(F.lit("SELECTED"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")), F.lit(""))))
    nodes = read(spark, sf, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"), F.lit("QualityFinding").alias("node_type"), F.col("r_name").alias("label"), F.array(F.lit("regional")).alias("reasons"))
    return nodes, edges


@suite.add("""SELECT 'r1' AS node, 0 AS depth, r_name AS label, 'regional' AS reasons FROM region WHERE r_regionkey = 1 UNION ALL SELECT 'n' || n_nationkey, 1, NULL, '' FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'c' || c_custkey, 2, NULL, 'lives there' FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1""")
def reason_why(spark, sf):
    return H.why(*_reasons(spark, sf), "r1").withColumn("reasons", F.array_join("reasons", ","))


@suite.add(f"""WITH {_TAGGED}, y AS (SELECT *, coalesce(lag(token) OVER w, '<B>') AS l, coalesce(lag(token, 2) OVER w, '<B2>') AS l2, coalesce(lead(token) OVER w, '<E>') AS r, coalesce(lead(token, 2) OVER w, '<E2>') AS r2 FROM x WINDOW w AS (PARTITION BY doc ORDER BY pos)),
f AS (SELECT label, unnest(['token=' || token, 'left=' || l || '|' || token, 'right=' || token || '|' || r, 'window=' || l || '|' || token || '|' || r, 'left2=' || l2 || '|' || l || '|' || token, 'right2=' || token || '|' || r || '|' || r2]) AS feature FROM y)
SELECT feature, round(avg(label), 6) AS p, count(*) AS n FROM f GROUP BY feature HAVING count(*) >= 2""")
def feature_lexicon(spark, sf):
    return S.feature_lexicon(S.context_features(_tagged(spark, sf))).withColumn("p", F.round("p", 6))


@suite.add(f"""WITH {_TAGGED}, y AS (SELECT *, coalesce(lag(token) OVER w, '<B>') AS l, coalesce(lag(token, 2) OVER w, '<B2>') AS l2, coalesce(lead(token) OVER w, '<E>') AS r, coalesce(lead(token, 2) OVER w, '<E2>') AS r2 FROM x WINDOW w AS (PARTITION BY doc ORDER BY pos)),
f AS (SELECT doc, pos, label, unnest(['token=' || token, 'left=' || l || '|' || token, 'right=' || token || '|' || r, 'window=' || l || '|' || token || '|' || r, 'left2=' || l2 || '|' || l || '|' || token, 'right2=' || token || '|' || r || '|' || r2]) AS feature, unnest([1.0, 0.65, 0.65, 1.0, 0.8, 0.8])::DOUBLE AS w FROM y),
fq AS (SELECT feature, avg(label) AS q FROM f GROUP BY feature HAVING count(*) >= 2)
SELECT doc, pos::INT AS pos, round(coalesce(sum(w * q) / sum(CASE WHEN q IS NOT NULL THEN w END), 0), 6) AS p FROM f LEFT JOIN fq USING (feature) GROUP BY doc, pos""")
def feature_tagger(spark, sf):
    x = S.context_features(_tagged(spark, sf))
    return S.predict_features(x, S.feature_lexicon(x)).select("doc", "pos", F.round("p", 6).alias("p"))


@suite.add()
def tagger_config(spark, sf):
    return S.select_config(_tagged(spark, sf), (1, 2), (0.4, 0.6), (0, 1))


def _dirty_table(spark, sf):
    k = F.col("c_custkey")
    return read(spark, sf, "customer").select(k.alias("tid"), F.when(k % 13 == 0, "N/A").otherwise(F.concat((k % 50).cast("string"), F.lit(".0 oz"))).alias("size"), F.when(k % 5 == 0, "Springfield IL").otherwise("Springfield").alias("city"), F.when(k % 5 == 0, "").otherwise("IL").alias("state"), F.when(k % 17 == 0, "at 7:05 P.M. sharp").otherwise("7:05 p.m.").alias("open_time"), F.when(k % 101 == 0, "alxha").otherwise("alpha").alias("kind"), (k % 40).cast("string").alias("flight"), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("g"), (k % 40).cast("string"))).alias("gate"))


_DIRTY = """d AS (SELECT c_custkey AS tid, c_custkey AS k FROM customer)"""


@suite.add(f"WITH {_DIRTY} SELECT tid, CASE WHEN k % 13 = 0 THEN '' ELSE (k % 50)::VARCHAR END AS size, 'Springfield' AS city, 'IL' AS state, '7:05 p.m.' AS open_time, CASE WHEN k % 101 = 0 THEN 'alxha' ELSE 'alpha' END AS kind FROM d")
def clean_profiled_formats(spark, sf):
    return C.format_profile(_dirty_table(spark, sf), ["size", "city", "state", "open_time", "kind", "flight", "gate"], "tid").drop("flight", "gate")


@suite.add(f"WITH {_DIRTY} SELECT tid, CASE WHEN k % 13 = 0 THEN '' ELSE (k % 50)::VARCHAR END AS size, 'IL' AS state, CASE WHEN k % 101 = 0 AND (SELECT count(*) FROM d WHERE k % 101 = 0) >= 10 THEN 'alxha' ELSE 'alpha' END AS kind FROM d")
def clean_fused(spark, sf):
    return C.fused(_dirty_table(spark, sf), ["size", "city", "state", "open_time", "kind"], "tid").select("tid", "size", "state", "kind")


@suite.add(f"WITH {_DIRTY} SELECT tid, CASE WHEN k % 3 <> 0 OR EXISTS (SELECT 1 FROM d e WHERE e.k % 40 = d.k % 40 AND e.k % 3 <> 0) THEN 'g' || (k % 40) ELSE '' END AS gate FROM d")
def clean_context_consensus(spark, sf):
    return C.context_consensus(_dirty_table(spark, sf), ["kind", "flight", "gate"], "flight", "tid").select("tid", "gate")


@suite.add(f"WITH {_DIRTY} SELECT count(*) * 3 - count(*) FILTER (k % 3 = 0) AS n_filled, count(*) FILTER (k % 13 = 0) AS n_dirty, round(1 - count(*) FILTER (k % 13 = 0) / (count(*) * 3 - count(*) FILTER (k % 3 = 0))::DOUBLE, 6) AS score FROM d")
def residual_dirt(spark, sf):
    return C.residual_score(_dirty_table(spark, sf), ["size", "gate", "flight"])


def _trials(spark, sf):
    o, li = read(spark, sf, "orders"), read(spark, sf, "lineitem")
    conditions = li.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: F.concat(F.lit("c"), x["l_partkey"].cast("string"))).alias("conditions"), F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))), lambda x: F.struct(x["l_linenumber"].cast("string").alias("groupId"), x["l_quantity"].cast("int").cast("string").alias("value"))).alias("m"))
    j = o.join(conditions, F.col("o_orderkey") == F.col("l_orderkey"))
    protocol = F.struct(F.struct(F.concat(F.lit("NCT"), F.col("o_orderkey").cast("string")).alias("nctId"), F.col("o_orderpriority").alias("briefTitle")).alias("identificationModule"), F.struct("conditions").alias("conditionsModule"), F.struct(F.array(F.struct(F.lit("DRUG").alias("type"), F.col("o_orderstatus").alias("name"))).alias("interventions")).alias("armsInterventionsModule"), F.struct(F.array(F.struct(F.lit("os").alias("measure"))).alias("primaryOutcomes")).alias("outcomesModule"))
    measures = F.array(F.struct(F.lit("PRIMARY").alias("type"), F.lit("t").alias("title"), F.array(F.struct(F.array(F.struct(F.col("m").alias("measurements"))).alias("categories"))).alias("classes")))
    results = F.when(F.col("o_orderkey") % 2 == 0, F.struct(F.struct(measures.alias("outcomeMeasures")).alias("outcomeMeasuresModule")))
    return P.trials(j.select(F.to_json(F.struct(protocol.alias("protocolSection"), (F.col("o_orderkey") % 3 == 0).alias("hasResults"), results.alias("resultsSection"))).alias("payload")))


_HAVING = "(SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders))"


@suite.add("SELECT 'NCT' || o_orderkey AS nct_id, o_orderpriority AS title, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN 'available' WHEN o_orderkey % 3 <> 0 AND o_orderkey % 2 <> 0 THEN 'not_reported' ELSE 'inconsistent' END AS results_status FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def trial_studies(spark, sf):
    return _trials(spark, sf)["studies"].drop("raw")


@suite.add(f"SELECT 'NCT' || l_orderkey AS nct_id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1)::INT AS condition_index, 'c' || l_partkey AS condition FROM {_HAVING}")
def trial_conditions(spark, sf):
    return _trials(spark, sf)["conditions"]


@suite.add(f"SELECT 'NCT' || l_orderkey AS nct_id, 0 AS measure_index, 0 AS class_index, 0 AS category_index, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) - 1)::INT AS measurement_index, 'PRIMARY' AS outcome_type, l_linenumber::VARCHAR AS group_id, l_quantity::INT::VARCHAR AS value FROM {_HAVING} WHERE l_orderkey % 2 = 0")
def trial_measurements(spark, sf):
    return _trials(spark, sf)["outcome_measurements"].drop("raw", "outcome_title", "class_title", "category_title")


def _evidence(spark, sf):
    k = F.col("o_orderkey")
    entity = lambda i, n: F.struct(i.alias("id"), n.alias("name"))
    gene = F.struct(F.lit("GENE").alias("featureType"), (k % 5).alias("id"), F.concat(F.lit("G"), (k % 5).cast("string")).alias("name"), (k % 5 + 100).alias("entrezId"))
    variant = F.struct((k % 11).alias("id"), F.concat(F.lit("V"), (k % 11).cast("string")).alias("name"), gene.alias("feature"))
    profile = F.struct((k % 7).alias("id"), F.concat(F.lit("P"), (k % 7).cast("string")).alias("name"), F.array(variant).alias("variants"))
    therapies = F.array(entity(k % 3, F.concat(F.lit("T"), (k % 3).cast("string"))), entity(k % 4 + 10, F.concat(F.lit("T"), (k % 4 + 10).cast("string"))))
    source = F.struct((k % 9).alias("id"), F.lit("s").alias("name"), F.concat(F.lit("pm"), (k % 9).cast("string")).alias("citationId"))
    doc = F.struct(k.alias("id"), F.lit("ACCEPTED").alias("status"), F.lit("A").alias("evidenceLevel"), entity(k % 6, F.concat(F.lit("D"), (k % 6).cast("string"))).alias("disease"), profile.alias("molecularProfile"), therapies.alias("therapies"), source.alias("source"))
    return P.evidence(read(spark, sf, "orders").select(k.alias("ord"), F.to_json(doc).alias("payload")))


@suite.add("SELECT o_orderkey AS evidence_id, o_orderkey % 6 AS disease_id, o_orderkey % 7 AS profile_id, o_orderkey % 9 AS source_id, 'pm' || (o_orderkey % 9) AS publication_id, [o_orderkey % 5] AS gene_ids, [o_orderkey % 11] AS variant_ids, [o_orderkey % 3, o_orderkey % 4 + 10] AS therapy_ids FROM orders")
def evidence_relations(spark, sf):
    return _evidence(spark, sf)["relations"]


@suite.add("SELECT DISTINCT o_orderkey % 5 AS gene_id, 'G' || (o_orderkey % 5) AS symbol, o_orderkey % 5 + 100 AS entrez_id FROM orders")
def evidence_genes(spark, sf):
    return _evidence(spark, sf)["genes"]


@suite.add("SELECT DISTINCT o_orderkey % 3 AS therapy_id, 'T' || (o_orderkey % 3) AS name FROM orders UNION SELECT DISTINCT o_orderkey % 4 + 10, 'T' || (o_orderkey % 4 + 10) FROM orders")
def evidence_therapies(spark, sf):
    return _evidence(spark, sf)["therapies"]


@suite.add("""WITH m AS (SELECT p_partkey, 'M' || p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'Breast' ELSE 'Lung' END AS lin FROM part), s AS (SELECT l_partkey, arg_max(l_quantity, l_orderkey * 10 + l_linenumber) AS auc FROM lineitem GROUP BY l_partkey)
SELECT id AS model_id, 'breast line' AS cell_line_name, lin AS lineage, CASE WHEN auc IS NOT NULL THEN 'drug' ELSE 'asked' END AS drug, auc, NULL::DOUBLE AS ic50, 'preclinical_cell_line' AS response_domain, 'depmap:' || id AS source_id FROM m LEFT JOIN s ON l_partkey = p_partkey WHERE lin = 'Breast'""")
def cell_line_records(spark, sf):
    m = read(spark, sf, "part").select(F.concat(F.lit("M"), F.col("p_partkey").cast("string")).alias("ModelID"), F.lit("breast line").alias("CellLineName"), F.when(F.col("p_size") % 2 == 0, "Breast").otherwise("Lung").alias("OncotreeLineage"))
    s = read(spark, sf, "lineitem").select(F.concat(F.lit("M"), F.col("l_partkey").cast("string")).alias("ModelID"), F.lit("drug").alias("Drug"), F.col("l_quantity").cast("string").alias("AUC"), F.lit("").alias("IC50"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    return P.cell_lines(m, s, "asked")


@suite.add("SELECT p_name AS \"molecularProfileId\" FROM part WHERE p_size % 3 = 0 ORDER BY p_name LIMIT 1")
def molecular_profile(spark, sf):
    p = read(spark, sf, "part").select(F.col("p_name").alias("molecularProfileId"), F.when(F.col("p_size") % 3 == 0, "MUTATION_EXTENDED").otherwise("OTHER").alias("molecularAlterationType"), F.lit("MAF").alias("datatype"))
    return P.molecular_profile(p, "MUTATION_EXTENDED", "MAF").select("molecularProfileId")


@suite.add("SELECT min(c_name) AS \"sampleListId\" FROM customer WHERE c_mktsegment = 'BUILDING'")
def sample_list(spark, sf):
    return P.sample_list(read(spark, sf, "customer").select(F.col("c_name").alias("sampleListId"), F.col("c_mktsegment").alias("category")), "BUILDING", "st", "mutation").select("sampleListId")


@suite.add("""WITH h AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'GSE' || page_id || '_series_matrix.txt.gz' WHEN 1 THEN url WHEN 2 THEN '../up_series_matrix.txt.gz' WHEN 3 THEN 'a_series_matrix.txt.gz?x=1' ELSE 'b.soft.gz' END AS href FROM pages) SELECT href AS file_name, href FROM h WHERE page_id % 5 = 0""")
def directory_files(spark, sf):
    h = read(spark, sf, "pages").select(F.col("page_id").alias("ord"), F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("GSE"), F.col("page_id").cast("string"), F.lit("_series_matrix.txt.gz"))).when(F.col("page_id") % 5 == 1, F.col("url")).when(F.col("page_id") % 5 == 2, "../up_series_matrix.txt.gz").when(F.col("page_id") % 5 == 3, "a_series_matrix.txt.gz?x=1").otherwise("b.soft.gz").alias("href"))
    return P.directory_files(h, "series_matrix")


@suite.add("SELECT p_partkey AS file_id, p_size AS file_size FROM part WHERE p_brand = (SELECT min(p_brand) FROM part) AND p_size % 2 = 0 ORDER BY p_size, p_partkey LIMIT 20")
def project_files(spark, sf):
    p = read(spark, sf, "part")
    least = p.agg(F.min("p_brand")).first()[0]
    files = p.select(F.col("p_partkey").alias("file_id"), F.col("p_size").alias("file_size"), F.col("p_brand").alias("project_id"), F.when(F.col("p_size") % 2 == 0, "open").otherwise("controlled").alias("access"), F.lit("clinical").alias("data_type"))
    return P.project_files(files, least, ["clinical"], 20).select("file_id", "file_size")


@suite.add("SELECT 'GSE' || (event_id % 90) AS accession, min_by(event_type, event_id) AS title, min_by((event_id % 70)::INT, event_id) AS n_samples FROM events WHERE event_id % 4 <> 0 GROUP BY 1")
def catalogue_hits(spark, sf):
    e = F.col("event_id")
    r = read(spark, sf, "events").select(e.alias("ord"), F.when(e % 4 != 0, F.concat(F.lit("gse"), (e % 90).cast("string"))).otherwise("GPL5").alias("accession"), F.col("event_type").alias("title"), F.lit("").alias("summary"), (e % 70).cast("string").alias("n_samples"))
    return P.catalogue_hits(r).select("accession", "title", "n_samples")


@suite.add("""SELECT doc_id AS paper_id, CASE WHEN doc_id % 3 = 0 THEN 'methods' WHEN doc_id % 3 = 1 THEN 'results' ELSE 'statistical_analysis' END AS category, sha256(coalesce(text, '') || ' ' || lang) AS digest FROM documents""")
def paper_categories(spark, sf):
    d = read(spark, sf, "documents")
    title = F.when(F.col("doc_id") % 3 == 0, "Materials and Methods").when(F.col("doc_id") % 3 == 1, "3. Results").otherwise("Statistical methods")
    part = lambda n, t, text: d.select(F.col("doc_id").alias("paper_id"), F.lit(n).alias("ord"), t.alias("title"), text.alias("text"))
    sections = part(3, title, F.col("lang")).union(part(1, title, T.text("text"))).union(part(2, F.lit("Acknowledgements"), F.col("source")))
    return P.paper_categories(sections).select("paper_id", "category", F.sha2("text", 256).alias("digest"))


@suite.add("""SELECT 'cat:' || event_id AS observation_id, 'cat:' || user_id AS object_id, CASE WHEN event_id % 8 = 0 OR event_id % 11 = 0 THEN 'rejected' ELSE 'accepted' END AS status, CASE WHEN user_id % 2 = 0 THEN 'catalog_exact' ELSE 'unresolved' END AS metadata_match FROM events""")
def catalogue_observations(spark, sf):
    e = read(spark, sf, "events")
    rows = e.select(F.col("event_id").alias("source_row"), F.col("user_id").cast("string").alias("SN"), F.when(F.col("event_id") % 8 == 0, "nan").otherwise("55000.5").alias("MJD"), F.lit("17.2").alias("mag"), F.when(F.col("event_id") % 11 == 0, "-1").otherwise("0.1").alias("e_mag"), F.lit("r").alias("band"))
    meta = e.filter("user_id % 2 = 0").select(F.col("user_id").cast("string").alias("SN")).distinct().withColumns({"z": F.lit("0.01"), "zCMB": F.lit("")})
    return P.observations(rows, meta, "cat").select("observation_id", "object_id", "status", "metadata_match")


@suite.add("SELECT user_id, max(event_id) AS event_id, min(event_id) AS first_ord FROM events GROUP BY user_id")
def last_registered(spark, sf):
    return P.last_of_each(read(spark, sf, "events").select("user_id", "event_id", F.col("event_id").alias("ord")), "user_id", "ord")


@suite.add("SELECT c_custkey AS k, 'missing' AS side FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT DISTINCT o_custkey, 'unexpected' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)")
def key_differences(spark, sf):
    return P.keys_differ(read(spark, sf, "customer").select(F.col("c_custkey").alias("k")), read(spark, sf, "orders").select(F.col("o_custkey").alias("k")), ["k"])


@suite.add("""WITH q AS (SELECT conv_id, turn, text, lower(text) AS x FROM conversations) SELECT conv_id, turn, regexp_matches(x, '生存|预后|overall survival|disease-free|relapse-free|progression-free|(^|[^\\p{L}\\p{N}_])(os|dfs|rfs|dss)([^\\p{L}\\p{N}_]|$)') AS survival,
 CASE WHEN regexp_matches(x, 'export|download|导出|下载') THEN 'export' WHEN regexp_matches(x, 'why|explain|为什么|解释') THEN 'explain' WHEN regexp_matches(x, 'review|approve|reject|审核|批准') THEN 'review' WHEN regexp_matches(x, 'repair|fix|clean|修复|清洗') THEN 'repair' WHEN regexp_matches(x, 'search|find|dataset|检索|查找|数据集') THEN 'search' WHEN regexp_matches(x, 'build|merge|integrate|构建|整合') THEN 'build' ELSE 'chat' END AS route FROM q WHERE text IS NOT NULL""")
def message_intents(spark, sf):
    return read(spark, sf, "conversations").filter("text is not null").select("conv_id", "turn", I.asks("text", "survival").alias("survival"), I.route("text").alias("route"))


_PROFILES = [("Breast", ["breast cancer", "brca", "乳腺癌"]), ("Lung", ["lung cancer", "luad"])]


@suite.add("""WITH v AS (SELECT event_id, ['brca_tcga study', 'LUAD cohort', '乳腺癌队列', 'brcatest', 'none'][event_id % 5 + 1] AS x, ['Kaplan-Meier curve', 'a heat map', '', 'words'][event_id % 4 + 1] AS c FROM events)
SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'Breast' WHEN 1 THEN 'Lung' WHEN 2 THEN 'Breast' END AS profile, CASE event_id % 4 WHEN 0 THEN 'kaplan_meier' WHEN 1 THEN 'heatmap' ELSE 'unknown' END AS figure, CASE event_id % 4 WHEN 0 THEN 'digitization_possible' WHEN 1 THEN 'axes_only' WHEN 2 THEN 'none' ELSE 'caption_only' END AS extractable FROM v""")
def resolved_profiles(spark, sf):
    x, c = _pick("event_id", "brca_tcga study", "LUAD cohort", "乳腺癌队列", "brcatest", "none"), _pick("event_id", "Kaplan-Meier curve", "a heat map", "", "words")
    # an underline does not part words here: the term ends before it
    return read(spark, sf, "events").select("event_id", I.resolve(x, _PROFILES).alias("profile"), I.figure(c)["kind"].alias("figure"), I.figure(c)["extractability"].alias("extractable"))


@suite.add("""SELECT event_id, event_id % 4 <> 3 AS same FROM events""")
def source_id_matches(spark, sf):
    return read(spark, sf, "events").select("event_id", I.same_source(_pick("event_id", "GSE1", "gse1", "aact", "x"), _pick("event_id", "geo:GSE1", "GSE1", "ClinicalTrials.gov", "y")).alias("same"))


_SAID = ["Breast cancer patients PIK3CA neoadjuvant", "mouse xenograft", "nothing", "HER2 and basal-like tumours, alpelisib"]


@suite.add(f"""WITH v AS (SELECT doc_id, lower(coalesce(text, '') || ' ' || {_SAID!r}[doc_id % 4 + 1]) AS x, n_chars % 40 AS n FROM documents)
SELECT doc_id, (CASE WHEN contains(x, 'breast cancer') THEN 8 ELSE -12 END + 4 * (contains(x, 'pcr')::INT + contains(x, 'pathological complete response')::INT + contains(x, 'treatment response')::INT + contains(x, 'neoadjuvant')::INT + contains(x, 'response')::INT) + 3 * contains(x, 'pik3ca')::INT + 2 * contains(x, 'alpelisib')::INT + 2 * contains(x, 'the')::INT
 + 5 * regexp_matches(x, 'tnbc|triple-negative|triple negative|basal-like|basal like')::INT + contains(x, 'her2')::INT + contains(x, 'erbb2')::INT + contains(x, 'trastuzumab')::INT + contains(x, 'pik3ca')::INT + contains(x, 'brca1')::INT + contains(x, 'brca2')::INT + contains(x, 'breast')::INT
 + CASE WHEN regexp_matches(x, '{I.PRECLINICAL}') THEN -24 WHEN regexp_matches(x, '{I.CLINICAL}') THEN 7 ELSE -4 END + CASE WHEN n < 10 THEN -6 WHEN n < 30 THEN 1 ELSE 5 END)::INT AS score FROM v""")
def series_scores(spark, sf):
    """Scores of every whole document, with a phrase behind it, for a question whose goal names the group of patients."""
    s = I.series_score(F.concat(T.text("text"), F.lit(" "), _pick("doc_id", *_SAID)), ["breast cancer", "BC"], genes=["PIK3CA"], drugs=["Alpelisib"], extra=["The", "x"], outcome="pcr", n_samples=F.col("n_chars") % 40, clinical=True, goal="Response of TNBC")
    return read(spark, sf, "documents").select("doc_id", s.alias("score"))


@suite.add("""WITH v AS (SELECT n_name, regexp_replace(lower(n_name), '[^a-z0-9]+', '_', 'g') AS x, regexp_replace(lower(n_name), '[^a-z0-9]+', '', 'g') AS y FROM nation)
SELECT n_name, CASE WHEN x <> y THEN ['full_' || x, 'full' || y, x, y] ELSE ['full_' || x, 'full' || y, x] END AS variants FROM v""")
def column_variants(spark, sf):
    return read(spark, sf, "nation").select("n_name", I.column_variants(F.concat(F.lit(" Full "), "n_name")).alias("variants"))


@suite.add("""SELECT page_id AS id, 'GSE' || page_id || ',NCT' || lpad(page_id::VARCHAR, 8, '0') AS x, ['NCT' || lpad(page_id::VARCHAR, 8, '0')] AS nct FROM pages""")
def trial_ids(spark, sf):
    p = read(spark, sf, "pages").select(F.col("page_id").alias("id"), F.concat(F.lit("GSE"), F.col("page_id").cast("string"), F.lit(",NCT"), F.lpad(F.col("page_id").cast("string"), 8, "0")).alias("x"))
    return p.withColumn("nct", T.accessions("x", "NCT"))


@suite.add("SELECT page_id AS id, 0 AS table_no, 1 AS row_no, 'name' AS field, 'row ' || page_id AS value FROM pages UNION ALL SELECT page_id, 0, 1, 'column_2', url FROM pages")
def html_page_tables(spark, sf):
    """Cells of tables put into every page."""
    p = read(spark, sf, "pages").select("page_id", F.concat("html", F.lit("<table><tr><th>name</th><th></th></tr><tr><td>  row "), F.col("page_id").cast("string"), F.lit("</td><td>"), F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")), F.lit("</td></tr><tr><td></td></tr></table>")).alias("html"))
    return readers.html_cells(p)


@suite.add()
def article_cells(spark, sf):
    """Table cells, captions and digests of articles made of pages."""
    x = F.concat(F.lit("<article><table-wrap id='t'><table><tr><th>a</th></tr><tr><td>"), F.col("page_id").cast("string"), F.lit("</td></tr></table></table-wrap><fig id='f'><caption><p>Figure "), F.col("page_id").cast("string"), F.lit("</p></caption></fig></article>"))
    return readers.jats_cells(read(spark, sf, "pages").select(F.col("page_id").alias("id"), x.alias("xml")))


@suite.add("SELECT doc_id AS id, 'abstract' AS section, 'short' AS excerpt FROM documents UNION ALL SELECT doc_id, 'methods', 'done so' FROM documents")
def section_excerpts(spark, sf):
    d = read(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.lit("Abstract\nshort\n2 Methods:\ndone so").alias("text"))
    return readers.section_excerpts(d).drop("content_hash")


@suite.add("""WITH d AS (SELECT event_id AS ord, CASE WHEN event_id % 3 = 0 THEN 'D' || (event_id % 50) ELSE '' END AS doi, CASE WHEN event_id % 5 = 0 THEN 'P' || (event_id % 40) END AS pmid, CASE WHEN event_id % 7 <> 0 THEN event_type END AS title FROM events),
k AS (SELECT *, coalesce(CASE WHEN doi <> '' THEN 'doi:' || lower(doi) END, CASE WHEN pmid IS NOT NULL THEN 'pmid:' || lower(pmid) END, CASE WHEN title IS NOT NULL THEN 'title:' || lower(title) END) AS k FROM d)
SELECT ord, doi, pmid, title FROM k WHERE k IS NULL OR ord = (SELECT min(ord) FROM k j WHERE j.k = k.k)""")
def coalesced_papers(spark, sf):
    e = F.col("event_id")
    d = read(spark, sf, "events").select(e.alias("ord"), F.when(e % 3 == 0, F.concat(F.lit("D"), (e % 50).cast("string"))).otherwise("").alias("doi"), F.when(e % 5 == 0, F.concat(F.lit("P"), (e % 40).cast("string"))).alias("pmid"), F.when(e % 7 != 0, F.col("event_type")).alias("title"))
    return D.coalesced_dedup(d, ["doi", "pmid", "title"], "ord")


@suite.add("SELECT min(event_id) AS event_id FROM events GROUP BY lower(event_type), user_id")
def distinct_sources(spark, sf):
    e = read(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type")).alias("kind"), F.col("user_id").cast("string").alias("user"))
    return D.distinct_rows(e, ["kind", "user"], "event_id").select("event_id")


@suite.add("""WITH b AS (SELECT 0 AS g, n_nationkey AS o, 'f' || (n_nationkey % 6) AS name, 'a' AS arguments FROM nation UNION ALL SELECT 1, n_nationkey, 'f' || (n_nationkey % 9), 'a' FROM nation) SELECT name, arguments FROM (SELECT name, arguments, min((g, o)) AS first FROM b GROUP BY ALL) ORDER BY first LIMIT 8""")
def merged_calls(spark, sf):
    n = read(spark, sf, "nation")
    calls = lambda m: n.select(F.col("n_nationkey").alias("ord"), F.concat(F.lit("f"), (F.col("n_nationkey") % m).cast("string")).alias("name"), F.lit("a").alias("arguments"))
    return P.merged_calls(calls(6), calls(9), 8)


@suite.add("""WITH c AS (SELECT 0 AS g, n_nationkey AS o, unnest(range(2)) AS n, unnest(['d' || (n_nationkey % 4), 'e' || n_nationkey]) AS id FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT 1, r_regionkey, 0, 'd' || r_regionkey FROM region) SELECT id AS doc_id, row_number() OVER (ORDER BY min((g, o, n))) AS place FROM c GROUP BY id""")
def final_ids(spark, sf):
    n = F.col("n_nationkey")
    calls = read(spark, sf, "nation").select(n.alias("ord"), F.when(n % 2 == 0, "succeeded").otherwise("failed").alias("status"), F.array(F.concat(F.lit("d"), (n % 4).cast("string")), F.concat(F.lit("e"), n.cast("string"))).alias("ids"))
    sets = read(spark, sf, "region").select(F.col("r_regionkey").alias("ord"), F.concat(F.lit("d"), F.col("r_regionkey").cast("string")).alias("id"))
    return R.final_ids(calls, sets).select("doc_id", F.row_number().over(Window.orderBy("ord")).cast("long").alias("place"))


@suite.add("""WITH r AS (SELECT event_id % 40 AS q, event_id AS doc, row_number() OVER (PARTITION BY event_id % 40 ORDER BY event_id) AS rank FROM events), e AS (SELECT DISTINCT event_id % 40 AS q, 's' || (event_id % 40 % 7) AS s FROM events UNION SELECT DISTINCT event_id % 40, 's8' FROM events),
m AS (SELECT q, s, min(rank) AS rank, max((doc % 3 = 0)::INT) AS strict FROM r JOIN e USING (q) WHERE rank <= 10 AND s = 's' || (doc % 9) GROUP BY q, s), p AS (SELECT q, min(rank) AS best, sum(1.0::DOUBLE / log2(rank + 1)) AS dcg, max(strict) AS strict FROM m GROUP BY q), n AS (SELECT DISTINCT q FROM e)
SELECT count(*) AS n_cases, round(avg(CASE WHEN best IS NULL THEN 0.0 ELSE 1 END), 6) AS recall, round(avg(coalesce(1.0::DOUBLE / best, 0)), 6) AS mrr, round(avg(coalesce(dcg, 0) / (1 + 1.0::DOUBLE / log2(3))), 6) AS ndcg, round(avg(coalesce(strict, 0)), 6) AS evidence_hit_rate FROM n LEFT JOIN p USING (q)""")
def source_metrics(spark, sf):
    e = F.col("event_id")
    ev = read(spark, sf, "events")
    ranking = R.ranked(ev.select((e % 40).alias("query_id"), e.alias("doc_id"), (-e).alias("score")), None)
    hits = ev.select(e.alias("doc_id"), F.concat(F.lit("S"), (e % 9).cast("string")).alias("source"), F.when(e % 3 == 0, "Methods").otherwise("Results").alias("section"))
    want = ev.select((e % 40).alias("query_id"), F.concat(F.lit("s"), (e % 40 % 7).cast("string")).alias("source"), F.lit("methods").alias("section")).union(ev.select((e % 40).alias("query_id"), F.lit("s8"), F.lit("methods"))).distinct()
    return R.source_metrics(ranking, hits, want)


@suite.add("SELECT page_id AS record_id, url AS title, list_sort(list_distinct(['csv', lower(regexp_extract(split_part(url, '/', 3), '[.]([A-Za-z0-9]+)$', 1))])) AS formats FROM pages")
def dataset_formats(spark, sf):
    files = F.array(F.lit("b.CSV"), F.lit("none"), F.split_part("url", F.lit("/"), F.lit(3)), F.lit("c.csv"))
    return P.dataset_formats(read(spark, sf, "pages").select(F.col("page_id").alias("record_id"), F.col("url").alias("title"), files.alias("files")))


@suite.add("SELECT doc_id AS paper_id, ['GSE' || (1000 + doc_id % 7), 'GSE500'] AS accessions FROM documents")
def paper_accessions(spark, sf):
    d = read(spark, sf, "documents")
    first = F.concat(F.lit("see gse"), (F.col("doc_id") % 7 + 1000).cast("string"), F.lit(" and GSE500"))
    return P.paper_accessions(d.select(F.col("doc_id").alias("paper_id"), F.lit(1).alias("ord"), first.alias("text")).union(d.select("doc_id", F.lit(2), F.lit("GSE500 again"))))


@suite.add("SELECT list(f ORDER BY f) AS fields FROM (SELECT role AS f FROM conversations WHERE role IS NOT NULL UNION SELECT 'turn')")
def payload_fields(spark, sf):
    """Fields of saved turns, whose texts stand under the name of their role."""
    c = read(spark, sf, "conversations").filter("role is not null")
    return P.raw_fields(c.select(F.to_json(F.create_map(F.lit("turn"), F.col("turn").cast("string"), F.col("role"), T.text("text"))).alias("payload")))


@suite.add("SELECT least(count(*), 10) AS row_count, count(*) AS upstream_row_count, count(*) > 10 AS truncated FROM pages")
def capped_table(spark, sf):
    return P.capped(read(spark, sf, "pages"), 10, ["page_id"])[1]


def _loop_events(spark, sf):
    e = read(spark, sf, "events")
    return e.select(F.col("user_id").cast("string").alias("loop_id"), F.col("event_id").alias("seq"), F.when(F.col("event_type").isin("signup", "purchase"), "loop").otherwise("memory").alias("kind"), F.lit(None).cast("long").alias("iteration"), F.concat_ws(":", "event_type", "props").alias("payload"))


_LOOPS = "e AS (SELECT user_id::VARCHAR AS loop_id, event_id AS seq, event_type IN ('signup', 'purchase') AS lp, concat_ws(':', event_type, props) AS payload FROM events WHERE user_id IS NOT NULL AND event_id IS NOT NULL AND event_type IS NOT NULL)"


@suite.add(f"""WITH {_LOOPS}, l AS (SELECT loop_id, max(seq) AS last_seq, max_by(payload, seq) AS payload FROM e WHERE lp GROUP BY loop_id),
m AS (SELECT loop_id, string_agg(seq || '=' || payload, ',' ORDER BY seq DESC) AS memories FROM (SELECT *, row_number() OVER (PARTITION BY loop_id ORDER BY seq DESC) AS r FROM e WHERE NOT lp) WHERE r <= 5 GROUP BY loop_id) SELECT loop_id, last_seq, payload, coalesce(memories, '') AS memories FROM l FULL JOIN m USING (loop_id)""")
def loop_states(spark, sf):
    told = F.array_join(F.transform("memories", lambda m: F.concat(m["seq"].cast("string"), F.lit("="), m["payload"])), ",")
    return Z.loop_states(_loop_events(spark, sf), 5).withColumn("memories", told)


@suite.add(f"WITH {_LOOPS} SELECT loop_id, seq, payload FROM e WHERE NOT lp ORDER BY seq DESC, loop_id LIMIT 20")
def recalled_memories(spark, sf):
    return Z.recall(_loop_events(spark, sf)).select("loop_id", "seq", "payload")


@suite.add("SELECT count(*) AS n_rows, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total, count(DISTINCT o_orderkey) AS n_orders FROM orders")
def exported_orders(spark, sf):
    """Orders written as archives by the tasks, and their lines of JSON read back."""
    folder = new_path(spark, "archives")
    files = E.write_archives(read(spark, sf, "orders"), folder, rows=50_000)
    back = E.archive_rows(files, folder)
    n = F.get_json_object("row", "$.o_orderkey").cast("long")
    return back.agg(F.count("*").alias("n_rows"), F.round(F.sum(F.get_json_object("row", "$.o_totalprice").cast("decimal(18,2)")), 2).cast("double").alias("total"), F.count_distinct(n).alias("n_orders"))


@suite.add("""SELECT 'europepmc:' || doc_id AS paper_id, source || ' ' || lang AS title, nullif(trim(text), '') AS abstract, CASE WHEN doc_id % 3 <> 0 THEN doc_id::VARCHAR END AS pmid, 1990 + n_chars::INT % 30 AS publication_year, ['A ' || source, 'B'] AS authors, doc_id % 2 = 0 AS fulltext_available,
 'https://europepmc.org/article/' || CASE WHEN doc_id % 3 <> 0 THEN 'MED' ELSE upper(lang) END || '/' || doc_id AS source_url, len(list_distinct(regexp_extract_all(upper(coalesce(text, '')), '\\b(GSE[0-9]+|NCT[0-9]{8}|TCGA-[A-Z0-9-]+)\\b', 1)))::INT AS n_accessions FROM documents""")
def literature_papers(spark, sf):
    """Saved answers of a literature search whose abstracts are the documents."""
    k = F.col("doc_id")
    author = F.struct(F.struct(F.array(F.struct(F.concat(F.lit("A "), "source").alias("fullName"), F.lit(None).cast("string").alias("lastName")), F.struct(F.lit("").alias("fullName"), F.lit("B").alias("lastName")), F.struct(F.lit(" ").alias("fullName"), F.lit("C").alias("lastName"))).alias("author")).alias("authorList"))
    record = F.struct(k.cast("string").alias("id"), F.when(k % 3 != 0, k.cast("string")).alias("pmid"), F.col("lang").alias("source"), F.concat_ws(" ", "source", "lang").alias("title"), F.col("text").alias("abstractText"), (1990 + F.col("n_chars") % 30).alias("pubYear"), F.when(k % 2 == 0, "Y").alias("isOpenAccess"), author["authorList"].alias("authorList"))
    saved = read(spark, sf, "documents").select(k.alias("ord"), F.to_json(F.struct(F.struct(F.array(record).alias("result")).alias("resultList"))).alias("payload"))
    return P.papers(saved).select("paper_id", "title", "abstract", "pmid", "publication_year", "authors", "fulltext_available", "source_url", F.size("dataset_accessions").alias("n_accessions"))


@suite.add("""WITH s AS (SELECT o_custkey, max_by(o_orderpriority, o_orderkey) AS drug, max_by(o_totalprice, o_orderkey) AS auc FROM orders GROUP BY o_custkey)
SELECT c_custkey::VARCHAR AS model_id, c_name AS cell_line_name, coalesce(drug, 'none') AS drug, auc::DOUBLE AS auc, 'depmap:' || c_custkey AS source_id FROM customer LEFT JOIN s ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'""")
def cell_line_bundles(spark, sf):
    """A bundle for each customer: one model, and a sensitivity row for each order in its order."""
    o = read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", F.col("o_orderpriority").alias("p"), F.col("o_totalprice").alias("t"), F.col("o_custkey").cast("string").alias("m")))), lambda x: F.struct(x["m"].alias("model_id"), x["p"].alias("Drug"), x["t"].alias("auc"))).alias("sensitivity"))
    model = F.struct(F.col("c_custkey").cast("string").alias("ModelID"), F.col("c_name").alias("cell_line_name"), F.when(F.col("c_mktsegment") == "BUILDING", "Breast").otherwise(F.col("c_mktsegment")).alias("lineage"))
    saved = read(spark, sf, "customer").join(o, "c_custkey", "left").select(F.col("c_custkey").alias("ord"), F.to_json(F.struct(F.array(model).alias("models"), "sensitivity")).alias("payload"))
    return P.cell_line_bundle(saved, "none").select("model_id", "cell_line_name", "drug", "auc", "source_id")


@suite.add("""WITH x AS (SELECT o_orderkey, ['yes', 'RD', 'unclear', 'NA', NULL][o_orderkey % 5 + 1] AS p, o_orderpriority AS r FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN r WHEN p = 'yes' THEN '病理完全缓解（pCR）' WHEN p = 'RD' THEN '未达客观缓解' WHEN p = 'unclear' THEN p END AS response, o_orderkey % 80 || '' AS age FROM x""")
def mapped_characteristics(spark, sf):
    k = F.col("o_orderkey")
    parsed = F.create_map(F.lit("pcr_rd"), _pick("o_orderkey", "yes", "RD", "unclear", "NA", None), F.lit("response"), F.when(k % 4 == 0, F.col("o_orderpriority")), F.lit("age_years"), (k % 80).cast("string"))
    x = read(spark, sf, "orders").select(k, parsed.alias("parsed"))
    return x.select("o_orderkey", B.mapped_value("parsed", "treatment_response").alias("response"), B.mapped_value("parsed", "age").alias("age"))


def _runs(spark, sf):
    e = F.col("event_id")
    score = lambda n: ((e % n) / n).cast("double")
    judged = F.when(e % 4 != 0, F.struct(score(5).alias("overall"), F.when(e % 3 != 0, score(2)).alias("claim_support_rate"), score(7).alias("faithfulness"), score(8).alias("relevance"), F.when(e % 2 == 0, score(9)).alias("completeness"), score(10).alias("retrieval_quality")))
    return read(spark, sf, "events").select(e.alias("case_id"), F.when(e % 6 != 0, e % 6).alias("rank"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("difficulty"), F.col("value").alias("latency_ms"), judged.alias("scores"))


@suite.add("""WITH r AS (SELECT event_id AS e, CASE WHEN event_id % 6 <> 0 THEN event_id % 6 END AS k, CASE WHEN event_type = 'view' OR event_type IS NULL THEN 'medium' ELSE event_type END AS d, coalesce(value, 0) AS l, event_id % 4 <> 0 AS ok FROM events), v AS (
 SELECT 'cases' AS metric, count(*)::DOUBLE AS value FROM r UNION ALL SELECT 'recall@1', avg((coalesce(k, 9) <= 1)::INT) FROM r UNION ALL SELECT 'recall@3', avg((coalesce(k, 9) <= 3)::INT) FROM r UNION ALL SELECT 'recall@5', avg((coalesce(k, 9) <= 5)::INT) FROM r
 UNION ALL SELECT 'mrr@3', avg(CASE WHEN k <= 3 THEN 1.0 / k ELSE 0 END) FROM r UNION ALL SELECT 'ndcg@3', avg(CASE WHEN k <= 3 THEN 1 / log2(k + 1) ELSE 0 END) FROM r UNION ALL SELECT 'avg_latency_ms', avg(l) FROM r UNION ALL SELECT 'judge_valid_rate', avg(ok::INT) FROM r
 UNION ALL SELECT 'avg_faithfulness', avg(e % 7 / 7.0) FILTER (ok) FROM r UNION ALL SELECT 'avg_relevance', avg(e % 8 / 8.0) FILTER (ok) FROM r UNION ALL SELECT 'avg_completeness', avg(e % 9 / 9.0) FILTER (ok AND e % 2 = 0) FROM r UNION ALL SELECT 'avg_retrieval_quality', avg(e % 10 / 10.0) FILTER (ok) FROM r
 UNION ALL SELECT 'avg_overall', avg(e % 5 / 5.0) FILTER (ok) FROM r UNION ALL SELECT 'avg_claim_support_rate', avg(CASE WHEN e % 3 <> 0 THEN e % 2 / 2.0 ELSE 0 END) FILTER (ok) FROM r UNION ALL SELECT 'recall@3_' || d, avg((coalesce(k, 9) <= 3)::INT) FROM r GROUP BY d)
SELECT metric, round(value, 6) AS value FROM v""")
def evaluation_summary(spark, sf):
    return Q.summary(_runs(spark, sf)).withColumn("value", F.round("value", 6))


@suite.add("""WITH i AS (SELECT user_id, event_id % 2 = 0 AS late, event_id, lower(event_type) || '|' || user_id AS key, lower(event_type) AS t FROM events WHERE event_type IS NOT NULL AND user_id IS NOT NULL), g AS (SELECT user_id, key, t, min(late::INT * 1000000000000 + event_id) AS o FROM i GROUP BY user_id, key, t), f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY o) AS place FROM g)
SELECT user_id AS task_id, min(place) FILTER (t IN ('purchase', 'error')) AS rank FROM f GROUP BY user_id""")
def expected_source_ranks(spark, sf):
    e = read(spark, sf, "events").filter("event_type is not null and user_id is not null")
    none = F.lit(None).cast("string")
    items = e.select(F.col("user_id").alias("task_id"), (F.col("event_id") % 2 != 0).alias("candidate"), F.col("event_id").alias("ord"), none.alias("dataset_id"), F.upper("event_type").alias("accession"), none.alias("source_id"), F.col("user_id").cast("string").alias("dataset_name"), F.lit("").alias("source_name"), none.alias("source_database"))
    wanted = e.select(F.col("user_id").alias("task_id"), F.explode(F.array(F.lit("Purchase"), F.lit("ERROR"))).alias("name"))
    return Q.source_ranks(Q.source_rows(items), wanted).select("task_id", F.col("rank").cast("long").alias("rank"))


@suite.add("SELECT conv_id, turn, coalesce(role, '') AS role, sha256(coalesce(text, '')) AS digest FROM conversations")
def votable_turns(spark, sf):
    """All turns written as VOTables by the tasks, and read back in splits."""
    folder = new_path(spark, "votables")
    scans.write_votables(read(spark, sf, "conversations"), folder, "turns")
    row = lambda c: F.col("row")[c]
    return scans.votable_rows(spark, folder, "turns").select(row("conv_id").cast("long").alias("conv_id"), row("turn").cast("long").alias("turn"), row("role").alias("role"), F.sha2(row("text"), 256).alias("digest"))
