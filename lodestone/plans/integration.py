"""Queries on identities, candidate pairs, column catalogues, mapped records and cohort tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import normalise as N
from ..functions import text as T
from ..operators import cohort as C
from ..operators import entities as E
from ..operators import linking as L
from ..operators import mapping as M
from ..operators import matching as X
from ..operators import schemas as S
from .tables import Suite, read

suite = Suite()
QUERIES, ORACLE_SQL = suite.queries, suite.sql


def _identities(spark, sf):
    """Events as rows of studies; some lack a patient, some a sample."""
    e = F.col("event_id")
    patient = F.when(e % 9 != 0, (F.col("user_id") % 40).cast("string"))
    return read(spark, sf, "events").select(e.alias("id"), F.col("event_type").alias("study"), patient.alias("patient"), F.when(e % 4 != 0, (e % 700).cast("string")).alias("sample"))


_IDS = "ids AS (SELECT event_id AS id, event_type AS study, CASE WHEN event_id % 9 <> 0 THEN (user_id % 40)::VARCHAR END AS patient, CASE WHEN event_id % 4 <> 0 THEN (event_id % 700)::VARCHAR END AS sample FROM events)"
_CLASSES = f"{_IDS}, cl AS (SELECT *, CASE WHEN patient IS NULL AND sample IS NULL THEN id ELSE min(id) OVER (PARTITION BY study, patient, sample) END AS class_id FROM ids)"
_DECIDED = """CASE WHEN a.sample = b.sample AND a.patient <> b.patient THEN 'identifier_contradiction_v1' WHEN a.sample = b.sample THEN 'exact_study_sample_id_v1' WHEN a.patient = b.patient THEN 'exact_study_patient_id_v1' END"""
_STATUS = """CASE WHEN a.sample = b.sample AND a.patient <> b.patient THEN 'REJECTED' WHEN a.sample = b.sample THEN 'LINKED' WHEN a.sample IS NULL AND b.sample IS NULL THEN 'LINKED' ELSE 'LINKED_PATIENT_ONLY' END"""


@suite.add(f"WITH {_CLASSES} SELECT id, class_id FROM cl")
def identity_classes(spark, sf):
    return L.identity_classes(_identities(spark, sf))


@suite.add(f"""WITH {_CLASSES}, k AS (SELECT * FROM cl WHERE id = class_id),
p AS (SELECT least(a.id::VARCHAR, b.id::VARCHAR) AS "left", greatest(a.id::VARCHAR, b.id::VARCHAR) AS "right", CASE WHEN a.sample = b.sample THEN 'sample' ELSE 'patient' END AS scope, {_DECIDED} AS method, {_STATUS} AS status
 FROM k a JOIN k b ON a.study = b.study AND a.id < b.id AND (a.sample = b.sample OR a.patient = b.patient))
SELECT "left", "right", scope, method, status, status = 'LINKED' AS auto_merge, 1.0::DOUBLE AS confidence, 'link:' || substr(sha256("left" || '|' || "right" || '|' || scope || '|' || method), 1, 24) AS link_id FROM p""")
def class_link_decisions(spark, sf):
    return L.class_decisions(_identities(spark, sf))


def _candidates(spark, sf):
    e = F.col("event_id")
    return read(spark, sf, "events").select(e.alias("left"), ((e * 7) % 997).alias("right"), F.when(e % 2 == 0, "SAMPLE").otherwise("PATIENT").alias("scope"), ((e % 101) / 100).alias("confidence")).filter("left <> right and right > 0")


@suite.add(f"""WITH {_IDS}, c AS (SELECT event_id AS l, (event_id * 7) % 997 AS r, CASE WHEN event_id % 2 = 0 THEN 'sample' ELSE 'patient' END AS scope, (event_id % 101) / 100.0::DOUBLE AS conf FROM events),
j AS (SELECT c.*, a.study = b.study AS same, a.sample = b.sample AS ss, a.patient = b.patient AS sp, a.sample IS NULL AND b.sample IS NULL AS alone, a.patient <> b.patient AS pd, a.sample <> b.sample AS sd FROM c JOIN ids a ON a.id = l JOIN ids b ON b.id = r WHERE l <> r AND r > 0),
d AS (SELECT *, CASE WHEN same AND ss AND pd THEN 'identifier_contradiction_v1' WHEN same AND ss THEN 'exact_study_sample_id_v1' WHEN same AND sp THEN 'exact_study_patient_id_v1' END AS exact FROM j),
m AS (SELECT *, CASE WHEN exact IS NOT NULL THEN exact WHEN NOT same THEN 'candidate_rejected_v1' WHEN coalesce(pd, false) OR (scope = 'sample' AND coalesce(sd, false)) THEN 'candidate_identifier_contradiction_v1' WHEN conf < 0.9 THEN 'candidate_confidence_gate_v1' ELSE 'high_confidence_candidate_v1' END AS method FROM d)
SELECT least(l::VARCHAR, r::VARCHAR) AS "left", greatest(l::VARCHAR, r::VARCHAR) AS "right", method, round(CASE WHEN exact IS NULL THEN conf ELSE 1 END, 6)::DOUBLE AS confidence,
 CASE method WHEN 'identifier_contradiction_v1' THEN 'REJECTED' WHEN 'exact_study_sample_id_v1' THEN 'LINKED' WHEN 'exact_study_patient_id_v1' THEN CASE WHEN alone THEN 'LINKED' ELSE 'LINKED_PATIENT_ONLY' END WHEN 'candidate_confidence_gate_v1' THEN 'UNRESOLVED'
  WHEN 'high_confidence_candidate_v1' THEN CASE WHEN scope = 'patient' AND NOT alone THEN 'LINKED_PATIENT_ONLY' ELSE 'LINKED' END ELSE 'REJECTED' END AS status FROM m""")
def candidate_link_decisions(spark, sf):
    ids = _identities(spark, sf)
    known = ids.select("id")
    c = _candidates(spark, sf)
    c = c.join(known.withColumnRenamed("id", "left"), "left", "left_semi").join(known.withColumnRenamed("id", "right"), "right", "left_semi")
    return L.candidate_links(ids, c).select("left", "right", "method", F.round("confidence", 6).alias("confidence"), "status")


@suite.add()
def linked_entities(spark, sf):
    """Decisions, components over links that may merge, and keys, in one chain; the tests hold it against union-find."""
    return L.entities(_identities(spark, sf))


def _mapped_orders(spark, sf):
    o = read(spark, sf, "orders")
    record = F.create_map(F.lit("response"), F.col("o_orderstatus"), F.lit("response_domain"), F.when(F.col("o_orderkey") % 2 == 0, "clinical").otherwise("trial"), F.lit("stage"), F.col("o_orderpriority"))
    return o.select(F.col("o_custkey").alias("record_id"), F.col("o_orderkey").cast("string").alias("mapped_id"), (F.col("o_orderkey") % 3).cast("string").alias("source_id"), F.when(F.col("o_orderkey") % 5 < 3, "high").otherwise("low").alias("authority"), F.lit("normalized").alias("status"), record.alias("record"), F.array(F.lit("response"), F.lit("stage")).alias("mapped_fields"))


@suite.add("""WITH o AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'clinical' ELSE 'trial' END AS dom, o_orderkey % 3 AS src, o_orderkey % 5 < 3 AS high, o_orderstatus, o_orderpriority FROM orders),
x AS (SELECT o_custkey AS entity, 'response' AS field, 'domain=' || dom || ';type=Unknown' AS dimension, o_orderstatus AS value, src, high FROM o UNION ALL SELECT o_custkey, 'stage', 'default', o_orderpriority, src, high FROM o),
g AS (SELECT entity, field, dimension, count(DISTINCT value) AS n_values, min(value) AS least, max(value) AS greatest, count(DISTINCT src) AS n_sources, count(DISTINCT CASE WHEN high THEN value END) AS hv, count(DISTINCT CASE WHEN high THEN src END) AS hs FROM x GROUP BY ALL HAVING count(DISTINCT value) > 1)
SELECT 'e' || entity AS entity, field || '|' || dimension AS semantic_key, field, dimension, n_values, least, greatest, n_sources, hv > 1 AND hs > 1 AS high_authority, 'conflict:' || substr(sha256('e' || entity || '|' || field || '|' || dimension || '|' || least || '|' || greatest), 1, 24) AS conflict_id FROM g""")
def field_conflicts(spark, sf):
    members = read(spark, sf, "orders").select(F.col("o_custkey").alias("id")).distinct().withColumn("entity_key", F.concat(F.lit("e"), F.col("id").cast("string")))
    return L.conflicts(L.observations(_mapped_orders(spark, sf), members))


def _titles(spark, sf):
    """Pairs of customers and suppliers of a nation, with the parts of their names, nations and balances."""
    side = lambda table, p, key: read(spark, sf, table).select(key, F.col(f"{p}_nationkey").alias("nation"), f"{p}_acctbal", E.parts(f"{p}_name").alias(f"{p}_title"), E.parts(F.col(f"{p}_nationkey").cast("string")).alias(f"{p}_of"), E.parts(F.floor(f"{p}_acctbal").cast("string")).alias(f"{p}_has"))
    j = X.block_pairs(side("customer", "c", "c_custkey"), side("supplier", "s", "s_suppkey"), "nation", "c_custkey")
    return j, (F.col("c_title"), F.col("s_title")), [(F.col("c_of"), F.col("s_of")), (F.col("c_has"), F.col("s_has"))]


_PLAIN = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
_RUNS = "list_distinct([substr({0}, i, 3) FOR i IN range(1, length({0}) - 1)])"
_SET = "list_distinct(list_filter(string_split(" + _PLAIN + ", ' '), lambda w: w <> ''))"
_JAC = "CASE WHEN len({0}) = 0 OR len({1}) = 0 THEN 0 ELSE len(list_intersect({0}, {1})) / (len({0}) + len({1}) - len(list_intersect({0}, {1})))::DOUBLE END"


@suite.add(f"""WITH j AS (SELECT c_custkey, s_suppkey, {_PLAIN.format('c_name')} AS ta, {_PLAIN.format('s_name')} AS tb, {_SET.format('c_name')} AS x, {_SET.format('s_name')} AS y, {_PLAIN.format('floor(c_acctbal)::BIGINT::VARCHAR')} AS m, {_PLAIN.format('floor(s_acctbal)::BIGINT::VARCHAR')} AS n, {_RUNS.format(_PLAIN.format('c_name'))} AS ga, {_RUNS.format(_PLAIN.format('s_name'))} AS gb FROM customer JOIN supplier ON c_nationkey = s_nationkey),
f AS (SELECT c_custkey, s_suppkey, ta, tb, {_JAC.format('x', 'y')} AS tw, {_JAC.format('ga', 'gb')} AS tc, CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0 ELSE len(list_intersect(x, y)) / least(len(x), len(y))::DOUBLE END AS hold, CASE WHEN ta = tb THEN 1.0 ELSE {_JAC.format('x', 'y')} END AS ts, CASE WHEN m = n THEN 1.0 ELSE 0 END AS fs FROM j)
SELECT c_custkey, s_suppkey, ta <> '' AND ta = tb AS exact_title, tw >= 0.8 AS title_jaccard, tw >= 0.72 OR (tw >= 0.45 AND (ts + 1 + fs) / 3 >= 0.62) AS rule_v1,
 0.35::DOUBLE * tw + 0.20::DOUBLE * tc + 0.15::DOUBLE * hold + 0.20::DOUBLE + 0.10::DOUBLE * ((1 + fs) / 2) >= 0.70 AS weighted_v2 FROM f""")
def entity_predictions(spark, sf):
    side = lambda table, p, key: read(spark, sf, table).select(key, F.col(f"{p}_nationkey").alias("nation"), E.plain(f"{p}_name").alias("title"), E.plain(F.col(f"{p}_nationkey").cast("string")).alias("of"), E.plain(F.floor(f"{p}_acctbal").cast("string")).alias("has"))
    return E.block_predictions(side("customer", "c", "c_custkey"), side("supplier", "s", "s_suppkey"), "nation", "c_custkey", "s_suppkey", ["title", "of", "has"])


@suite.add()
def entity_rule_fit(spark, sf):
    """The rule of best F1 on customer and supplier pairs, labelled by equal account digits."""

    def side(table, p):
        x = read(spark, sf, table).groupBy(F.col(f"{p}_nationkey").alias("nation"), F.col(f"{p}_name").alias("name"), F.floor(f"{p}_acctbal").alias("has")).agg(F.count("*").alias("n"))
        return x.select("nation", F.array(E.plain("name"), E.plain(F.col("nation").cast("string")), E.plain(F.col("has").cast("string"))).alias("texts"), (F.col("has") % 10).alias("mark"), "n")

    return E.fit_counted(E.counted_kinds(side("customer", "c"), side("supplier", "s"), "nation"))


def _people(spark, sf):
    c, s = read(spark, sf, "customer"), read(spark, sf, "supplier")
    a = c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("string").alias("study_id"), (F.col("c_custkey") % 60).cast("string").alias("patient_id"), F.concat(F.lit("Trader "), (F.col("c_custkey") % 25).cast("string")).alias("name"), F.col("c_mktsegment").alias("segment"))
    b = s.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("string").alias("study_id"), (F.col("s_suppkey") % 60).cast("string").alias("patient_id"), F.concat(F.lit("Trader "), (F.col("s_suppkey") % 25).cast("string")).alias("name"), F.lit("BUILDING").alias("segment"))
    return a, b


@suite.add("""WITH a AS (SELECT c_custkey AS id, c_nationkey AS study, c_custkey % 60 AS p, c_custkey % 25 AS n FROM customer), b AS (SELECT s_suppkey AS id, s_nationkey AS study, s_suppkey % 60 AS p, s_suppkey % 25 AS n FROM supplier)
SELECT a.id AS left_id, b.id AS right_id FROM a JOIN b ON (a.p = b.p OR a.n = b.n) AND (a.study = b.study OR a.study NOT IN (SELECT study FROM b))""")
def entity_candidates(spark, sf):
    """Candidates by blocking values alone, which SQL can do too."""
    return E.candidates(*_people(spark, sf), fallback=0)


@suite.add()
def entity_nearest_candidates(spark, sf):
    """With the nearest names of the study for customers that have no partner; the tests hold it against brute force."""
    return E.candidates(*_people(spark, sf))


@suite.add()
def entity_match_v3(spark, sf):
    """Ratios of matching blocks have no SQL; the tests hold features and gate against plain Python."""
    return E.match_v3(*_people(spark, sf)).withColumn("hits", F.array_join("hits", ","))


@suite.add()
def entity_match_v2plus(spark, sf):
    a, b = _people(spark, sf)
    return E.match_v2plus(a, b, ["patient_id", "name", "segment"]).withColumn("hits", F.array_join("hits", ","))


def _catalogues(spark, sf):
    return S.profiled(read(spark, sf, "customer"), "c_custkey"), S.profiled(read(spark, sf, "supplier"), "s_suppkey")




@suite.add("""WITH a(source, x) AS (VALUES ('c_custkey', ['c', 'custkey']), ('c_name', ['c', 'name']), ('c_nationkey', ['c', 'nationkey']), ('c_acctbal', ['c', 'acctbal']), ('c_mktsegment', ['c', 'mktsegment'])),
b(target, y) AS (VALUES ('s_suppkey', ['s', 'suppkey']), ('s_name', ['s', 'name']), ('s_nationkey', ['s', 'nationkey']), ('s_acctbal', ['s', 'acctbal']), ('c_acctbal', ['c', 'acctbal'])),
p AS (SELECT source, target, len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y)))::DOUBLE AS score FROM a, b),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, target) AS place, lead(score) OVER (PARTITION BY source ORDER BY score DESC, target) AS nxt FROM p),
k AS (SELECT * FROM r WHERE place = 1 AND score >= 0.5 AND NOT (coalesce(score - nxt < 1e-12, false) AND score < 0.8))
SELECT source, target, round(score, 6) AS score FROM k QUALIFY row_number() OVER (PARTITION BY target ORDER BY score DESC, source) = 1""")
def schema_token_match(spark, sf):
    """Columns of customers against those of suppliers and one of the same name."""
    a = S.profiled(read(spark, sf, "customer"), "c_custkey")
    b = S.profiled(read(spark, sf, "supplier").withColumn("c_acctbal", F.col("s_acctbal")), "s_suppkey")
    return S.predicted(a, b, "token")


@suite.add()
def schema_rule_match(spark, sf):
    return S.predicted(*_catalogues(spark, sf), "rule")


@suite.add()
def schema_profile_match(spark, sf):
    return S.predicted(*_catalogues(spark, sf), "profile")


@suite.add()
def schema_match_v2(spark, sf):
    return S.match_v2(*_catalogues(spark, sf))


@suite.add()
def schema_match_v3(spark, sf):
    return S.match_v3(*_catalogues(spark, sf), "customer", "supplier")


@suite.add()
def schema_match_v2plus(spark, sf):
    return S.match_v2plus(*_catalogues(spark, sf)).withColumn("hits", F.array_join("hits", ","))


def _raw(spark, sf):
    """Orders as nested JSON records; some lack a field, some have two diseases, some a wrong domain."""
    k = F.col("o_orderkey")
    inner = F.struct(F.concat(F.lit("S"), (k % 7).cast("string")).alias("study"), F.concat(F.lit("P"), F.col("o_custkey").cast("string")).alias("patient"))
    fields = F.struct(inner.alias("ids"), F.when(k % 11 != 0, "breast cancer").alias("disease"), F.when(k % 13 == 0, "other").otherwise("breast cancer").alias("diagnosis"), F.element_at(F.array(*map(F.lit, ["HER2", "tp53", "x y"])), (k % 3 + 1).cast("int")).alias("gene"), F.element_at(F.array(*map(F.lit, ["2+", "3+", "neg", "?"])), (k % 4 + 1).cast("int")).alias("her2_ihc"), F.when(k % 5 == 0, "PR").alias("response"), (k % 3).cast("double").alias("ic50"))
    return read(spark, sf, "orders").select(k.alias("record_id"), (k % 2).cast("string").alias("source_id"), F.lit("high").alias("authority"), F.lit(0.95).alias("default_confidence"), F.to_json(fields).alias("fields"))


RULES = [
    M.Rule("m1", "ids.study", "study_id"), M.Rule("m2", "ids.patient", "patient_id"), M.Rule("m3", "disease", "disease"), M.Rule("m4", "diagnosis", "disease", source_id="1"), M.Rule("m5", "gene", "gene", "gene", 0.9),
    M.Rule("m6", "her2_ihc", "her2_status", "biomarker"), M.Rule("m7", "response", "response", response_domain="clinical"), M.Rule("m8", "ic50", "response", response_domain="clinical_trial"), M.Rule("m9", "absent.field", "stage"),
]


@suite.add("""WITH o AS (SELECT o_orderkey AS k, o_orderkey % 11 <> 0 AS has, o_orderkey % 2 = 1 AS second, o_orderkey % 13 = 0 AS other, o_orderkey % 5 = 0 AS resp FROM orders),
c AS (SELECT k, CASE WHEN second AND other AND has THEN ['disease'] ELSE [] END AS conflicts, CASE WHEN NOT has AND NOT second THEN ['disease'] WHEN second AND other AND has THEN ['disease'] ELSE [] END AS missing FROM o)
SELECT k AS record_id, array_to_string(conflicts, ',') AS conflicts, array_to_string(missing, ',') AS missing, len(conflicts) + len(missing) > 0 AS blocked FROM c""")
def record_contexts(spark, sf):
    c = M.contexts(M.attempts(_raw(spark, sf), RULES))
    return c.select("record_id", F.array_join("conflicts", ",").alias("conflicts"), F.array_join("missing", ",").alias("missing"), "blocked")


@suite.add("""WITH o AS (SELECT o_orderkey AS k, o_orderkey % 11 <> 0 AS has, o_orderkey % 2 = 1 AS second, o_orderkey % 13 = 0 AS other, o_orderkey % 5 = 0 AS resp FROM orders),
ok AS (SELECT * FROM o WHERE (has OR second) AND NOT (second AND other AND has)),
m AS (SELECT k, 'ids.study' AS raw_field, 0.95 AS c, 'study_id' AS f, NULL AS unsafe FROM ok UNION ALL SELECT k, 'ids.patient', 0.95, 'patient_id', NULL FROM ok UNION ALL SELECT k, 'disease', 0.95, 'disease', NULL FROM ok WHERE has UNION ALL SELECT k, 'diagnosis', 0.95, 'disease', NULL FROM ok WHERE second
 UNION ALL SELECT k, 'gene', 0.9, 'gene', NULL FROM ok WHERE k % 3 <> 2 UNION ALL SELECT k, 'her2_ihc', CASE WHEN k % 4 = 3 THEN 0.5 ELSE 0.95 END, 'her2_assay,her2_raw_value,her2_status', NULL FROM ok
 UNION ALL SELECT k, 'response', 0.95, 'response,response_domain', NULL FROM ok WHERE resp UNION ALL SELECT k, 'ic50', 0.95, 'response,response_domain', 'cross_domain_response' FROM ok)
SELECT k AS record_id, raw_field, c::DOUBLE AS confidence, f AS mapped_fields, unsafe FROM m""")
def mapped_records(spark, sf):
    m = M.mapped(M.attempts(_raw(spark, sf), RULES))
    return m.select("record_id", "raw_field", "confidence", F.array_join("mapped_fields", ",").alias("mapped_fields"), "unsafe")


@suite.add("""WITH o AS (SELECT o_orderkey AS k, o_orderkey % 11 <> 0 AS has, o_orderkey % 2 = 1 AS second, o_orderkey % 13 = 0 AS other, o_orderkey % 5 = 0 AS resp FROM orders),
i AS (SELECT k, 'raw_field_missing' AS code FROM o UNION ALL SELECT k, 'raw_field_missing' FROM o WHERE NOT has UNION ALL SELECT k, 'raw_field_missing' FROM o WHERE NOT resp
 UNION ALL SELECT k, 'normalization_review' FROM o WHERE k % 3 = 2 UNION ALL SELECT k, 'normalization_review' FROM o WHERE k % 4 = 3 UNION ALL SELECT k, 'context_conflict' FROM o WHERE second AND other AND has UNION ALL SELECT k, 'missing_required_context' FROM o WHERE (NOT has AND NOT second) OR (second AND other AND has)
 UNION ALL SELECT k, 'unsafe_response_domain' FROM o WHERE (has OR second) AND NOT (second AND other AND has))
SELECT code, count(*) AS n FROM i GROUP BY code""")
def mapping_issues(spark, sf):
    return M.issues(M.attempts(_raw(spark, sf), RULES)).groupBy("code").agg(F.count("*").alias("n"))


@suite.add()
def evidence_cells(spark, sf):
    return M.evidence(M.mapped(M.attempts(_raw(spark, sf), RULES)))


@suite.add("""WITH v AS (SELECT event_id, ['0', '1+', '2+', '3+', 'low', 'Pos', 'non-amplified', 'amp', '', 'weird'][event_id % 10 + 1] AS x FROM events)
SELECT event_id, CASE WHEN x IN ('0', '1+') THEN 'Negative' WHEN x = '2+' THEN 'Equivocal' WHEN x IN ('3+', 'Pos') THEN 'Positive' WHEN x = '' THEN NULL ELSE 'Unknown' END AS ihc,
 CASE WHEN x IN ('Pos', 'amp') THEN 'Positive' WHEN x = 'non-amplified' THEN 'Negative' WHEN x = '' THEN NULL ELSE 'Unknown' END AS fish,
 CASE WHEN x = 'amp' THEN 'Amplification' WHEN x <> '' THEN x END AS variant, CASE WHEN x = 'Pos' THEN 'Positive' WHEN x <> '' THEN 'Unknown' END AS er,
 CASE WHEN x = '' THEN 'biomarker_unresolved' WHEN x IN ('non-amplified', 'amp', 'weird') THEN 'her2_ihc_unresolved_v1' ELSE 'her2_ihc_rule_v1' END AS method FROM v""")
def biomarker_values(spark, sf):
    x = F.element_at(F.array(*map(F.lit, ["0", "1+", "2+", "3+", "low", "Pos", "non-amplified", "amp", "", "weird"])), (F.col("event_id") % 10 + 1).cast("int"))
    get = lambda n, k: F.try_element_at(n["values"], F.lit(k))
    ihc = N.biomarker("HER2 IHC", x)
    return read(spark, sf, "events").select("event_id", get(ihc, "her2_status").alias("ihc"), get(N.biomarker("her2_fish", x), "her2_status").alias("fish"), get(N.biomarker("ERBB2_CNA", x), "variant").alias("variant"), get(N.biomarker("ER", x), "er_status").alias("er"), ihc["method"].alias("method"))


@suite.add("""WITH v AS (SELECT event_id, ['Mutated', 'WT', 'wild-type', 'n/a', 'maybe'][event_id % 5 + 1] AS m, ['In vitro', 'patient', 'clinical_trial', 'evidence', 'else'][event_id % 5 + 1] AS d FROM events)
SELECT event_id, CASE WHEN m = 'Mutated' THEN 'Mutated' WHEN m IN ('WT', 'wild-type') THEN 'Wild-type' ELSE 'Unknown' END AS mutation, CASE d WHEN 'In vitro' THEN 'preclinical_cell_line' WHEN 'patient' THEN 'clinical' WHEN 'clinical_trial' THEN 'clinical_trial' WHEN 'evidence' THEN 'knowledge_evidence' END AS domain,
 (CASE m WHEN 'n/a' THEN 0.6 WHEN 'maybe' THEN 0.4 ELSE 1 END)::DOUBLE AS confidence FROM v""")
def status_domains(spark, sf):
    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("event_id") % 5 + 1).cast("int"))
    m, d = N.mutation_status(pick("Mutated", "WT", "wild-type", "n/a", "maybe")), N.response_domain(pick("In vitro", "patient", "clinical_trial", "evidence", "else"))
    return read(spark, sf, "events").select("event_id", F.try_element_at(m["values"], F.lit("mutation_status")).alias("mutation"), F.try_element_at(d["values"], F.lit("response_domain")).alias("domain"), m["confidence"].alias("confidence"))


def _eav(spark, sf):
    """Customers as patients and orders as samples, in attribute rows."""
    c, o = read(spark, sf, "customer"), read(spark, sf, "orders")
    row = lambda a, v: F.struct(F.lit(a).alias("clinicalAttributeId"), v.cast("string").alias("value"))
    patients = c.select(F.col("c_custkey").cast("string").alias("patientId"), F.explode(F.array(row("AGE_AT_DIAGNOSIS", F.col("c_custkey") % 90), row("Cancer Type", F.col("c_mktsegment")), row("ER_STATUS", F.when(F.col("c_custkey") % 2 == 0, "Positive").otherwise("Negative")))).alias("x"), F.lit(1).alias("ord")).select("patientId", "x.*", "ord")
    samples = o.select(F.col("o_custkey").cast("string").alias("patientId"), F.concat(F.lit("s"), F.col("o_orderkey").cast("string")).alias("sampleId"), F.explode(F.array(row("HER2_STATUS", F.element_at(F.array(*map(F.lit, ["2+", "3+", "NA"])), (F.col("o_orderkey") % 3 + 1).cast("int"))), row("PCR", F.when(F.col("o_orderstatus") == "F", "pCR").otherwise("RD")))).alias("x"), F.lit(1).alias("ord")).select("patientId", "sampleId", "x.*", "ord")
    return patients, samples


_COHORT = """co AS (SELECT 'st' AS study_id, o_custkey::VARCHAR AS patient_id, 's' || o_orderkey AS sample_id, 'src' AS source_id, (c_custkey % 90)::VARCHAR AS age, c_mktsegment AS cancer_type, CASE WHEN c_custkey % 2 = 0 THEN 'Positive' WHEN c_custkey IS NOT NULL THEN 'Negative' END AS er_status, CASE o_orderkey % 3 WHEN 0 THEN '2+' WHEN 1 THEN '3+' END AS her2_status, CASE WHEN o_orderstatus = 'F' THEN 'pCR' ELSE 'RD' END AS pcr FROM orders LEFT JOIN customer ON o_custkey = c_custkey)"""


def _clinical(spark, sf):
    return C.clinical(*_eav(spark, sf), "st", "src")


@suite.add(f"WITH {_COHORT} SELECT study_id, patient_id, sample_id, source_id, age, cancer_type, er_status, her2_status, pcr FROM co")
def cohort_wide(spark, sf):
    return _clinical(spark, sf)


def _molecular(spark, sf):
    li = read(spark, sf, "lineitem")
    gene = F.element_at(F.array(*map(F.lit, ["PIK3CA", "TP53", "BRCA1"])), (F.col("l_partkey") % 3 + 1).cast("int"))
    m = li.select(F.lit("").alias("patientId"), F.concat(F.lit("s"), F.col("l_orderkey").cast("string")).alias("sampleId"), gene.alias("gene"), F.concat(F.lit("V"), (F.col("l_partkey") % 5).cast("string")).alias("proteinChange"), F.col("l_partkey").alias("ord"))
    c = li.select(F.lit("").alias("patientId"), F.concat(F.lit("s"), F.col("l_orderkey").cast("string")).alias("sampleId"), F.lit("ERBB2").alias("gene"), (F.col("l_partkey") % 5 - 2).alias("alteration"), F.col("l_partkey").alias("ord"))
    return m, c


_MOLECULAR = """m AS (SELECT DISTINCT 's' || l_orderkey AS sample_id, ['pik3ca', 'tp53', 'brca1'][l_partkey % 3 + 1] AS gene FROM lineitem),
 cn AS (SELECT 's' || l_orderkey AS sample_id, arg_max(l_partkey % 5 - 2, l_partkey)::VARCHAR AS erbb2_cna FROM lineitem GROUP BY l_orderkey)"""


@suite.add(f"""WITH {_COHORT}, {_MOLECULAR} SELECT sample_id, CASE WHEN sample_id IN (SELECT sample_id FROM m WHERE gene = 'pik3ca') THEN '1' ELSE '0' END AS pik3ca_mutation, CASE WHEN sample_id IN (SELECT sample_id FROM m WHERE gene = 'tp53') THEN '1' ELSE '0' END AS tp53_mutation, erbb2_cna FROM co LEFT JOIN cn USING (sample_id)""")
def cohort_molecular(spark, sf):
    return C.with_molecular(_clinical(spark, sf), *_molecular(spark, sf)).select("sample_id", "pik3ca_mutation", "tp53_mutation", "erbb2_cna")


@suite.add(f"WITH {_COHORT}, {_MOLECULAR} SELECT count(*) AS n_orphans FROM (SELECT 's' || l_orderkey AS sample_id FROM lineitem) WHERE sample_id NOT IN (SELECT sample_id FROM co)")
def molecular_orphans(spark, sf):
    return C.orphans(_molecular(spark, sf)[0], _clinical(spark, sf))


@suite.add(f"""WITH {_COHORT} SELECT sample_id, CASE WHEN her2_status = '3+' AND er_status = 'Positive' THEN 'HR-positive/HER2-positive' WHEN her2_status = '3+' THEN 'HER2-positive' END AS derived_ihc_subtype, CASE pcr WHEN 'pCR' THEN 1 ELSE 0 END AS pcr_binary,
 CASE WHEN age::INT < 40 THEN '<40' WHEN age::INT < 50 THEN '40-49' WHEN age::INT < 60 THEN '50-59' WHEN age::INT < 70 THEN '60-69' WHEN age IS NOT NULL THEN '>=70' END AS age_group, pcr AS treatment_response FROM co""")
def cohort_derived(spark, sf):
    d = C.derived(C.outcome_synonyms(C.her2_synonyms(C.canonical_fields(_clinical(spark, sf)))), ["PIK3CA"])
    return d.select("sample_id", "derived_ihc_subtype", "pcr_binary", "age_group", "treatment_response")


@suite.add(f"WITH {_COHORT} SELECT sample_id FROM co WHERE er_status = 'Positive' AND her2_status IS NULL OR er_status IS NULL AND her2_status IS NULL")
def receptor_cohort(spark, sf):
    return C.receptor_filtered(_clinical(spark, sf), hr_positive=True, her2_negative=True).select("sample_id")


@suite.add(f"WITH {_COHORT} SELECT round(1.0 * avg(CASE WHEN pcr IS NOT NULL THEN 1.0 ELSE 0 END), 4)::DOUBLE AS outcome_match FROM co")
def outcome_match_rate(spark, sf):
    return C.outcome_match(_clinical(spark, sf), "pcr")


@suite.add(f"""WITH {_COHORT}, {_MOLECULAR}, s AS (SELECT 'PIK3CA' AS gene, 1.0::DOUBLE AS score UNION ALL SELECT 'ERBB2', round(0.52 * avg(CASE WHEN erbb2_cna IS NULL THEN 0.0 ELSE 1 END), 4) FROM co LEFT JOIN cn USING (sample_id) UNION ALL SELECT 'KRAS', 0) SELECT gene, score FROM s""")
def gene_match_scores(spark, sf):
    return C.gene_scores(C.with_molecular(_clinical(spark, sf), *_molecular(spark, sf)), ["PIK3CA", "ERBB2", "KRAS"])


@suite.add(f"""WITH {_COHORT}, {_MOLECULAR} SELECT round((1.0 + round(0.52 * avg(CASE WHEN erbb2_cna IS NULL THEN 0.0 ELSE 1 END), 4)) / 3, 4) AS gene_coverage FROM co LEFT JOIN cn USING (sample_id)""")
def gene_coverage(spark, sf):
    return C.gene_coverage(C.with_molecular(_clinical(spark, sf), *_molecular(spark, sf)), ["PIK3CA", "ERBB2", "KRAS"])


@suite.add(f"WITH {_COHORT} SELECT 'her2' AS field, round(avg(CASE WHEN her2_status IS NULL THEN 0.0 ELSE 1 END), 6) AS coverage FROM co UNION ALL SELECT 'age', round(avg(CASE WHEN age IS NULL THEN 0.0 ELSE 1 END), 6) FROM co UNION ALL SELECT 'none', 0 FROM (SELECT 1)")
def any_field_coverage(spark, sf):
    return C.any_coverage(_clinical(spark, sf), {"her2": ["her2_ihc", "her2_status"], "age": ["age"], "none": ["absent"]})


@suite.add("""SELECT 'age' AS "column", count(*) AS n_filled, count(*) AS n_numbers, true AS "numeric" FROM customer UNION ALL SELECT 'c_name', count(*), 0, false FROM customer UNION ALL SELECT 'c_acctbal', count(*), count(*), true FROM customer""")
def numeric_columns(spark, sf):
    c = read(spark, sf, "customer").select("c_name", F.concat((F.col("c_custkey") % 90).cast("string"), F.lit(" %")).alias("age"), F.round("c_acctbal", 2).cast("decimal(18,2)").cast("string").alias("c_acctbal"))
    return C.numeric_columns(c, ["age", "c_name", "c_acctbal"])


@suite.add("""WITH e AS (SELECT event_type AS source_id, CASE WHEN event_id % 50 <> 0 THEN (user_id)::VARCHAR END AS p, CASE WHEN event_id % 50 <> 0 AND event_type <> 'view' THEN event_id::VARCHAR END AS s FROM events),
u AS (SELECT source_id, count(*) AS n_rows, count(DISTINCT p) AS n_patients, count(DISTINCT s) AS n_samples, count(p) - count(DISTINCT CASE WHEN p IS NOT NULL THEN concat_ws('|', p, s) END) AS n_repeated, count(*) FILTER (p IS NULL AND s IS NULL) AS nameless FROM e GROUP BY source_id),
r AS (SELECT DISTINCT event_type AS source_id FROM events WHERE event_type < 'p' UNION SELECT 'registered only')
SELECT source_id, coalesce(n_rows, 0) AS n_rows, coalesce(n_patients, 0) AS n_patients, coalesce(n_samples, 0) AS n_samples, coalesce(n_repeated, 0) AS n_repeated,
 CASE WHEN r.source_id IS NULL OR u.source_id IS NULL THEN 'UNMATCH' WHEN nameless > 0 OR n_repeated > 0 THEN 'REVIEW' ELSE 'MATCH' END AS status FROM u FULL JOIN r USING (source_id)""")
def alignment_report(spark, sf):
    e = read(spark, sf, "events")
    rows = e.select(F.col("event_type").alias("source_id"), F.when(F.col("event_id") % 50 != 0, F.col("user_id").cast("string")).alias("patient_id"), F.when((F.col("event_id") % 50 != 0) & (F.col("event_type") != "view"), F.col("event_id").cast("string")).alias("sample_id"))
    sources = e.filter("event_type < 'p'").select(F.col("event_type").alias("source_id")).union(spark.range(1).select(F.lit("registered only")))
    return C.alignment(rows, sources)


@suite.add("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'age' WHEN p_partkey % 4 = 1 THEN 'her2_status' WHEN p_partkey % 4 = 2 THEN 'tumor_size' END AS attribute FROM part""")
def attribute_names(spark, sf):
    x = F.element_at(F.array(*map(F.lit, ["AGE_AT_DIAGNOSIS", "her2_ihc", "Tumor  Size", "!!"])), (F.col("p_partkey") % 4 + 1).cast("int"))
    return read(spark, sf, "part").select("p_partkey", C.attribute(x).alias("attribute"))
