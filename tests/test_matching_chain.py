"""Linking, matching, mapping, cohorts, repair, coverage and graphs against plain Python and small cases."""

import hashlib
from difflib import SequenceMatcher
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from lodestone.operators import cohort, coverage, entities, governance, graph, linking, mapping, schemas


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


IDS = [(1, "a", "p1", "s1"), (2, "a", "p1", "s1"), (3, "a", "p2", "s1"), (4, "a", None, "s1"), (5, "a", "p1", None), (6, "a", "p1", None), (7, "b", "p1", "s1"), (8, "a", None, None), (9, None, "p1", "s1"), (10, "a", " ", "s9"), (11, "a", "p9", "s9"), (12, "c", "x", "y"), (13, "c", "x", "z")]


def exact(a, b):
    """Decision of a pair of rows as the linker makes it, row by row."""
    norm = lambda v: v.strip() or None if v else None
    (_, sa, pa, ma), (_, sb, pb, mb) = a, b
    pa, pb, ma, mb = map(norm, (pa, pb, ma, mb))
    if sa != sb or sa is None:
        return None
    if ma and ma == mb:
        return "REJECTED" if pa and pb and pa != pb else "LINKED"
    if pa and pa == pb:
        return "LINKED" if ma is None and mb is None else "LINKED_PATIENT_ONLY"
    return None


def test_every_pair_of_rows_has_its_decision(spark):
    ids = spark.createDataFrame(IDS, "id long, study string, patient string, sample string")
    of = dict(rows(linking.identity_classes(ids), "id", "class_id"))
    between = {(int(r["left"]), int(r["right"])): r["status"] for r in linking.class_decisions(ids).collect()}
    between |= {(b, a): s for (a, b), s in between.items()}
    for a, b in combinations(IDS, 2):
        x, y = of[a[0]], of[b[0]]
        got = "LINKED" if x == y else between.get((x, y))
        assert got == exact(a, b), (a, b)


def test_chain_of_links_has_the_components_of_all_pairs(spark):
    ids = spark.createDataFrame(IDS, "id long, study string, patient string, sample string")
    asked = [(12, 13, "PATIENT", 0.95), (7, 9, "SAMPLE", 0.99), (5, 8, "PATIENT", 0.95), (1, 3, "SAMPLE", 0.99), (10, 12, "SAMPLE", 0.5)]
    candidates = spark.createDataFrame(asked, "left long, right long, scope string, confidence double")
    root = {i[0]: i[0] for i in IDS}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(IDS, 2):
        if exact(a, b) == "LINKED":
            u, v = find(a[0]), find(b[0])
            root[max(u, v)] = min(u, v)
    root[find(8)] = find(5)  # the only candidate that may merge
    got = {r["id"]: r for r in linking.entities(ids, candidates).collect()}
    assert {i: r["root"] for i, r in got.items()} == {i[0]: find(i[0]) for i in IDS}
    assert len({r["entity_key"] for r in got.values()}) == len({r["root"] for r in got.values()})
    status = {(r["left"], r["right"]): (r["status"], r["method"]) for r in linking.candidate_links(ids, candidates).collect()}
    assert status[("12", "13")] == ("LINKED_PATIENT_ONLY", "exact_study_patient_id_v1")
    assert status[("7", "9")][0] == "REJECTED" and status[("1", "3")] == ("REJECTED", "identifier_contradiction_v1")
    assert status[("5", "8")] == ("LINKED", "high_confidence_candidate_v1")


def test_unknown_candidate_is_an_error(spark):
    ids = spark.createDataFrame(IDS[:2], "id long, study string, patient string, sample string")
    bad = spark.createDataFrame([(1, 99, "SAMPLE", 0.9)], "left long, right long, scope string, confidence double")
    with pytest.raises(Exception, match="not there"):
        linking.candidate_links(ids, bad).collect()


def test_conflicts_stay_in_their_dimension(spark):
    cells = [("r1", "m1", "s1", "high", {"her2_status": "Positive", "her2_assay": "IHC"}), ("r1", "m2", "s2", "high", {"her2_status": "Negative", "her2_assay": "IHC"}), ("r1", "m3", "s3", "low", {"her2_status": "Positive", "her2_assay": "FISH"})]
    m = spark.createDataFrame([(*c[:4], "normalized", c[4], ["her2_status"]) for c in cells], "record_id string, mapped_id string, source_id string, authority string, status string, record map<string,string>, mapped_fields array<string>")
    members = spark.createDataFrame([("r1", "e1")], "id string, entity_key string")
    out = linking.conflicts(linking.observations(m, members)).collect()
    assert [(r["dimension"], r["n_values"], r["high_authority"]) for r in out] == [("assay=IHC", 2, True)]


LEFT = [(1, "s", "p1", "Ann  Lee", "x"), (2, "s", None, "Bob Stone", "y"), (3, "t", "p3", "Cy", None), (4, "s", None, "", "z")]
RIGHT = [(1, "s", "p1", "ann lee", "x"), (2, "s", "p2", "Bob Stones", "y"), (3, "u", "p3", "Cy", "w"), (4, "s", "p4", "bob stone", "q")]
ENTITY = "id long, study_id string, patient_id string, name string, city string"


def test_entity_v3_as_plain_python(spark):
    out = {(r["left_id"], r["right_id"]): r for r in entities.match_v3(spark.createDataFrame(LEFT, ENTITY), spark.createDataFrame(RIGHT, ENTITY)).collect()}
    v = lambda x: " ".join((x or "").lower().split())
    assert set(out) == {(1, 1), (2, 4), (3, 3), (4, 1), (4, 2), (4, 4)}  # a row without values gets its study's rows
    for (a, b), r in out.items():
        x, y = LEFT[a - 1], RIGHT[b - 1]
        n, m = v(x[3]), v(y[3])
        ratio = round(SequenceMatcher(None, n, m).ratio(), 4) if n and m else 0.0
        inside = round(len(set(n.split()) & set(m.split())) / max(1, min(len(set(n.split())), len(set(m.split())))), 4)
        agree = float(v(x[4]) == v(y[4])) if v(x[4]) and v(y[4]) else 0.0
        same = float(v(x[2]) == v(y[2])) if v(x[2]) and v(y[2]) else 0.0
        score = round(0.40 * ratio + 0.25 * inside + 0.25 * agree + 0.10 * same, 4)
        assert (r["name_similarity"], r["name_containment"], r["field_agreement"], r["id_agreement"], r["score"]) == pytest.approx((ratio, inside, agree, same, score))
    assert out[(1, 1)]["decision"] == "LINK" and out[(3, 3)]["decision"] == "REJECT" and out[(3, 3)]["hits"] == ["CROSS_STUDY_JOIN_FORBIDDEN"]
    closed = {(r["left_id"], r["right_id"]): r["decision"] for r in entities.match_v3(spark.createDataFrame(LEFT, ENTITY), spark.createDataFrame(RIGHT, ENTITY), linker=False).collect()}
    assert closed[(1, 1)] == "REVIEW"


def test_entity_fallback_is_by_name(spark):
    a, b = spark.createDataFrame([(1, "s", None, "Bob Stoned", "y")], ENTITY), spark.createDataFrame(RIGHT, ENTITY)
    assert entities.candidates(a, b, 0).count() == 0 and entities.candidates(a, b).count() == 3
    assert rows(entities.candidates(a, b, 1), "left_id", "right_id") == [(1, 4)]


def test_v2plus_only_tightens(spark):
    a = spark.createDataFrame([(1, "s", "p1", "Ann Lee", "x"), (2, "s", "p7", "Bob", "y")], ENTITY)
    b = spark.createDataFrame([(1, "s", "p1", "Ann Lee", "x"), (2, "s", "p8", "Bob", "y")], ENTITY)
    got = {r["left_id"]: r for r in entities.match_v2plus(a, b, ["patient_id", "name", "city"], linker=True).collect()}
    assert got[1]["decision"] == "AUTO" and got[2]["decision"] == "REJECT"
    assert entities.match_v2plus(a, b, ["patient_id", "name", "city"]).filter("left_id = 1").first()["decision"] == "REVIEW"


def plain(s):
    import re

    return " ".join(re.sub("[^a-z0-9]+", " ", (s or "").lower()).split())


def jac(a, b):
    a, b = set(plain(a).split()), set(plain(b).split())
    return len(a & b) / len(a | b) if a and b else 0.0


def kind(values):
    num = sum(1 for v in values if v.replace(".", "", 1).isdigit())
    if not values:
        return "empty"
    if num >= max(1, int(0.8 * len(values))):
        return "numeric"
    if sum(any(c.isdigit() for c in v) for v in values) >= max(1, int(0.5 * len(values))) and any(c.isalpha() for v in values for c in v):
        return "address"
    return "short_text" if all(len(v.split()) <= 3 for v in values) else "text"


COLS_A = [("site address", "text", ["12 Oak St", "9 Elm Rd"]), ("cust name", "text", ["ann", "bob", "cy", "dee"]), ("lat", "number", ["1.5", "2.5"]), ("note", "text", [])]
COLS_B = [("location", "text", ["12 Oak St", "4 Fir Ave"]), ("title", "text", ["ann", "bob", "cy", "eve"]), ("latitude", "number", ["7", "8"]), ("cust", "text", ["a b c d e f"])]


def semantic(s):
    w = set(plain(s).split())
    return w | {p for p in schemas.PARTS for t in w if p != t and p in t}


def alias(a, b):
    x, y = ({v for t in semantic(s) for v in [*schemas.ALIASES.get(t, [t]), t]} for s in (a, b))
    return len(x & y) / min(len(x), len(y)) if x and y else 0.0


def fits(x, y):
    k, m = kind(x), kind(y)
    if "empty" in (k, m) or {k, m} in ({"address", "short_text"}, {"address", "numeric"}):
        return 0.0
    return 1.0 if k == m else 0.25


def overlap(x, y):
    a, b = {plain(v) for v in x} - {""}, {plain(v) for v in y} - {""}
    return len(a & b) / min(len(a), len(b)) * min(1.0, min(len(a), len(b)) / 4) if a and b else 0.0


@pytest.mark.parametrize("method, score", [
    ("token", lambda a, b: jac(a[0], b[0])), ("rule", lambda a, b: 0.5 * jac(a[0], b[0]) + 0.35 * alias(a[0], b[0]) + 0.15 * fits(a[2], b[2])),
    ("profile", lambda a, b: 0.25 * jac(a[0], b[0]) + 0.15 * alias(a[0], b[0]) + 0.10 * fits(a[2], b[2]) + 0.5 * overlap(a[2], b[2])),
])
def test_schema_predictions_as_plain_python(spark, method, score):
    least, want, used = 0.5 if method == "token" else 0.4, {}, []
    for a in COLS_A:
        ranked = sorted(((score(a, b), b[0]) for b in COLS_B), key=lambda x: (-x[0], x[1]))
        if ranked[0][0] >= least and not (ranked[0][0] - ranked[1][0] < 1e-12 and ranked[0][0] < 0.8):
            used.append((-ranked[0][0], a[0], ranked[0][1]))
    for s, a, b in sorted(used):
        if b not in want.values():
            want[a] = b
    cat = lambda cs: spark.createDataFrame(cs, "column string, kind string, values array<string>")
    got = schemas.predicted(cat(COLS_A), cat(COLS_B), method)
    assert {r["source"]: r["target"] for r in got.collect()} == want and (want or method == "token")


def test_schema_evaluation_and_judge(spark):
    pair = lambda *ps: spark.createDataFrame(list(ps), "source string, target string")
    r = schemas.evaluated(pair(("a", "x")), pair(("a", "x"), ("b", "y"))).first()
    assert (r["precision"], r["recall"], r["f1"]) == (1.0, 0.5, 0.666667)
    cat = lambda cs: spark.createDataFrame(cs, "column string, kind string, values array<string>")
    asked = []

    def judge(df):
        asked.append(sorted(r["source"] for r in df.collect()))
        return df.filter("source = 'site address'").select("source", F.lit(0.95).alias("confidence"))

    out = {r["source"]: r for r in schemas.match_v3(cat(COLS_A), cat(COLS_B), judge=judge).collect()}
    assert out["site address"]["decision"] == "AUTO" and out["site address"]["decided_by"] == "judge"
    assert all(out[s]["decision"] == "REVIEW" for s in asked[0] if s != "site address")
    bad = schemas.match_v2plus(cat([("response", "number", ["1"])]), cat([("ic50", "number", ["1"])])).first()
    assert bad["decision"] == "REJECT" and "CROSS_DOMAIN_RESPONSE" in bad["hits"]


def test_records_map_to_evidence(spark):
    rules = [mapping.Rule("a", "study.id", "study_id"), mapping.Rule("b", "disease", "disease"), mapping.Rule("c", "HER2 IHC", "her2_status", "biomarker", 0.8), mapping.Rule("d", "gone", "stage")]
    assert all(mapping.valid_rule(r) for r in rules) and not mapping.valid_rule(mapping.Rule("e", "x", "drug", "gene"))
    docs = [("r1", '{"study": {"id": "S"}, "disease": "d", "HER2 IHC": "2+", "gone": null}'), ("r2", '{"study": {"id": "S"}, "disease": null}'), ("r3", "broken"), ("r4", None)]
    records = spark.createDataFrame([(i, "src", "high", 0.9, f) for i, f in docs], "record_id string, source_id string, authority string, default_confidence double, fields string")
    tried = mapping.attempts(records, rules)
    assert {(r["record_id"], r["mapping_id"]) for r in tried.filter("not found").collect()} == {("r2", "c"), ("r2", "d"), *((i, m) for i in ("r3", "r4") for m in "abcd")}
    out = {(r["field"]): r for r in mapping.evidence(mapping.mapped(tried)).filter("raw_field = 'HER2 IHC'").collect()}
    assert out["her2_status"]["canonical_value"] == "Equivocal" and out["her2_status"]["confidence"] == 0.8 and out["her2_status"]["status"] == "verified"
    assert {r["id"] for r in mapping.identities(tried).collect()} == {"r1"}


def test_cohort_molecular_order_and_orphans(spark):
    base = spark.createDataFrame([("st", "p1", "s1", "x"), ("st", "p1", "s2", "x"), ("st", "p2", None, "x")], "study_id string, patient_id string, sample_id string, source_id string")
    m = spark.createDataFrame([("p1", "s1", "tp53", "B", 2), ("p1", "s1", "TP53", "A", 3), ("p1", "s1", "tp53", "B", 1), ("p2", "", "pten", None, 4), ("p1", "", "kras", "Q", 5), ("", "none", "egfr", "Z", 6)], "patientId string, sampleId string, gene string, proteinChange string, ord int")
    c = spark.createDataFrame([("p1", "s2", "erbb2", 1, 1), ("p1", "s2", "erbb2", 2, 2)], "patientId string, sampleId string, gene string, alteration int, ord int")
    out = {(r["patient_id"], r["sample_id"]): r.asDict() for r in cohort.with_molecular(base, m, c).collect()}
    assert out[("p1", "s1")]["tp53_variants"] == "B;A" and out[("p1", "s2")]["tp53_mutation"] == "0" and out[("p2", None)]["pten_mutation"] == "1" and out[("p1", "s2")]["erbb2_cna"] == "2"
    assert cohort.orphans(m, base).first()["n_orphans"] == 2


def test_cohort_fields_of_one_row(spark):
    df = spark.createDataFrame([("p", "Positive", "neg", "2+", "是", "rd", "45", "V600E", "-2"), ("q", "neg", "neg", "neg", None, None, "130", None, None)], "patient_id string, er_status string, pr_status string, her2_ihc string, chemotherapy string, pcr_status string, age string, pik3ca_mutation string, pik3ca_cna string")
    out = {r["patient_id"]: r for r in cohort.derived(cohort.outcome_synonyms(cohort.her2_synonyms(cohort.canonical_fields(df))), ["PIK3CA"]).collect()}
    assert (out["p"]["her2_status"], out["p"]["raw_field"], out["p"]["treatment"], out["p"]["pcr_binary"], out["p"]["age_group"], out["p"]["pik3ca_altered"]) == ("2+", "her2_ihc", "化疗", 0, "40-49", 1)
    assert out["p"]["derived_ihc_subtype"] is None and out["q"]["derived_ihc_subtype"] == "Triple-negative" and out["q"]["age_group"] is None
    assert cohort.target(df, None, ["PIK3CA"]) == "pik3ca_mutation" and cohort.target(df, "survival") is None
    assert cohort.ordered(df.withColumn("none", F.lit(None).cast("string")), ["age"]).columns[:2] == ["patient_id", "age"]
    assert cohort.outcome_gap(["pcr_status"], "pcr", 0.0) == "unmapped_synonym" and cohort.outcome_gap(["os_months"], "pcr", 0.0) == "wrong_cohort" and cohort.outcome_gap(["x"], "pcr", 0.0) == "missing"
    none = cohort.receptor_filtered(df.withColumn("er_status", F.lit("neg")), hr_positive=True)
    assert none.count() == 2


BASE = {"source_id": "s", "raw_field": "f", "raw_value": "v", "study_id": "S", "disease": "d", "confidence": "1", "patient_id": "p", "source_authority": "low"}


def records(spark, *extra):
    names = sorted({*BASE, "sample_id", *(k for e in extra for k in e)})
    return spark.createDataFrame([(n, *({**BASE, "sample_id": f"m{n}", **e}.get(k) for k in names)) for n, e in enumerate(extra)], "id long, " + ", ".join(f"{c} string" for c in names))


def test_repair_loop_on_copies_and_aliases(spark):
    df = records(spark, {"gene": "HER2", "sample_id": "a"}, {"gene": "HER2", "sample_id": "a"}, {"gene": "ERBB2"}, {"gene": "herceptin"}, {"gene": "tp53", "source_id": None}, {"gene": "p53"})
    out, verdict = governance.repair_loop(df, "id", ["gene"])
    got = {r["id"]: (r["gene"], r["disposition"]) for r in out.collect()}
    assert got == {0: ("ERBB2", "repaired"), 1: ("ERBB2", "quarantined"), 2: ("ERBB2", "clean"), 3: ("herceptin", "review"), 4: ("tp53", "blocked"), 5: ("TP53", "repaired")}
    v = verdict.first()
    assert (v["n_records"], v["n_blocked"], v["gate"]) == (6, 1, "FAIL")


def test_rule_families(spark):
    df = records(spark, {"left": "1", "right": "2", "action": "merge"}, {"match_score": "0.5", "decision": "auto-merge"}, {"rows": "2"}, {"required": "stage", "stage": " "}, {"unit_guess": "years", "age": "0.5"}, {"stage": "Stge I"}, {"er_status": "Negative", "raw_value": "NA"}, {"raw_field": "ERBB2_CNA", "her2_status": "Positive"}, {"response": "pCR"}, {"required": "absent"})
    found = {(r["id"], r["rule"]) for r in governance.record_findings(df, "id").collect()}
    assert found == {(0, "CROSS_STUDY_JOIN_REQUIRES_CROSSWALK"), (1, "LOW_CONFIDENCE_PATIENT_LINK"), (2, "ANALYSIS_GRAIN_DUPLICATE"), (3, "DECLARED_REQUIRED_FIELD"), (4, "AMBIGUOUS_UNIT_CONVERSION"), (5, "CLINICAL_STAGE_TYPO"), (6, "UNKNOWN_NOT_NEGATIVE"), (7, "ERBB2_CNA_NOT_IHC"), (8, "RESPONSE_DOMAIN_REQUIRED"), (9, "DECLARED_REQUIRED_FIELD")}


def test_authority_conflicts_need_two_sources(spark):
    df = records(spark, *({"source_authority": "high", "sample_id": "a", "er_status": v, "source_id": s} for v, s in (("Positive", "x"), ("Negative", "y"))), *({"source_authority": "high", "sample_id": "b", "er_status": v, "source_id": "x"} for v in ("Positive", "Negative")))
    assert {r["id"] for r in governance.authority_findings(df, "id").collect()} == {0, 1}
    assert governance.classify(df.limit(0), "id").count() == 0


def test_gold_cases_must_agree(spark):
    a = spark.createDataFrame([("x", True)], "case_id string, expected boolean")
    b = spark.createDataFrame([("y", True)], "case_id string, detected boolean")
    with pytest.raises(Exception, match="differ"):
        governance.gold_counts(a, b).collect()


def test_covers(spark):
    src = [("full", ["a", "b"], ["study"], 0.9, 0.0, 1), ("pat1", ["a"], ["patient"], 0.9, 0.0, 2), ("pat2", ["b"], ["patient"], 0.8, 0.1, 3), ("lit", ["b"], ["study"], 0.1, 0.9, 4)]
    sources = spark.createDataFrame([(n, h, g, a, 0.5, 0.5, c, "OPEN_API", o) for n, h, g, a, c, o in src], "dataset_id string, field_hints array<string>, granularity array<string>, authority double, traceability double, structuredness double, cost double, access_mode string, ord int")
    fields = spark.createDataFrame([("a", "a", "required"), ("b", "b", "required")], "field_id string, canonical_name string, priority string")
    cells = coverage.matrix(fields, sources)
    assert rows(coverage.selected(cells, sources), "step", "dataset_id") == [(1, "full")]
    rest = sources.filter("dataset_id <> 'full'")
    part = coverage.matrix(fields, rest)
    assert rows(coverage.covered(part, rest), "step", "dataset_id") == [(1, "pat1"), (2, "lit")]
    both = coverage.selected(part, rest)
    assert rows(both, "step", "dataset_id") == [(1, "pat1"), (2, "pat2")]
    assert rows(coverage.join_policies(both, rest), "left", "right") == [("pat1", "pat2")]
    assert coverage.plan_summary(part, both).first()["portfolio_coverage"] == 1.0


def test_reachability_has_no_depth_limit(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(40, 0)], "src long, dst long")
    out = graph.reachable(edges, spark.createDataFrame([(0,)], "node long"))
    assert rows(out, "node", "depth") == sorted(((i, i) for i in range(41)), key=str)


def test_forbidden_edges_are_errors(spark):
    bad = spark.createDataFrame([("SAME_PATIENT", "a", "b", "")], "edge_type string, src string, dst string, reason string")
    with pytest.raises(Exception, match="not allowed"):
        graph.projected(bad).collect()


def test_summed_keys_tell_members_apart(spark):
    m = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 3)], "id long, root long")
    other = spark.createDataFrame([(1, 1), (5, 1)], "id long, root long")
    keys = {r["root"]: r["entity_key"] for r in linking.summed_keys(m).collect()}
    assert keys[1] != keys[3] and linking.summed_keys(other).first()["entity_key"] not in keys.values()
    assert linking.entity_keys(m).filter("root = 1").first()["entity_key"] == "entity:" + hashlib.sha256(b"1|2").hexdigest()[:24]
