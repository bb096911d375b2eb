"""Rules of the domain, the classifier over a table, the repair loop, and gates on proposals.

Records are rows with the canonical columns; a column that is absent reads
as null.  All rules of a record are one projection; rules that compare
records are grouped sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalise as N
from ..functions import text as T
from ..shared import written
from . import quality as Q
from .quality import Rule

#: Provenance and other required columns, and the columns whose values may disagree between sources.
PROVENANCE = ["source_id", "raw_field", "raw_value"]
REQUIRED = ["study_id", "disease", "confidence"]
AUTHORITY_FIELDS = ["er_status", "pr_status", "her2_status", "response"]
KNOWN_GENES = ["PIK3CA", "ESR1", "BRCA1", "BRCA2"]
#: Fields that are never repaired without review, and kinds that may be.
FROZEN = ["her2_status", "her2_assay", "her2_raw_value", "patient_id", "sample_id", "response", "response_domain"]
SAFE = ["gene_alias", "drug_alias", "casing"]
FINDING = "id {id}, rule string, kind string, risk string, field string, observed string, candidate string"


def key(c: Column) -> Column:
    """Lower-case letters and digits alone."""
    return F.regexp_replace(F.lower(T.text(c)), "[^a-z0-9]+", "")


def compact(c: Column) -> Column:
    return F.regexp_replace(F.lower(T.text(c)), r"\s+", "")


class Columns:
    """Columns of a table by name; absent ones are null."""

    def __init__(self, df: DataFrame):
        self.names = set(df.columns)

    def __call__(self, name: str) -> Column:
        return F.col(name) if name in self.names else F.lit(None).cast("string")


def _rule(name: str, kind: str, risk: str, field: str, condition: Column, candidate: Column | None = None) -> Rule:
    return Rule(name, kind, risk, field, condition, candidate)


def provenance_rules(c: Columns) -> list[Rule]:
    out = [_rule("MISSING_EVIDENCE", "provenance_missing", "high", f, F.trim(T.text(c(f))) == "") for f in PROVENANCE]
    return out + [_rule("CANONICAL_REQUIRED_FIELD", "missing_required_field", "high", f, F.trim(T.text(c(f))) == "") for f in REQUIRED]


def missing_provenance(df: DataFrame, fields: list[str] | None = None) -> Column:
    """Names of the provenance fields that are null or blank, in order."""
    c = Columns(df)
    return F.array_compact(F.array(*(F.when(F.trim(T.text(c(f))) == "", f) for f in fields or PROVENANCE)))


def integrity_rules(c: Columns) -> list[Rule]:
    """Joins without crosswalk, merges of low score, repeated grains, declared fields, units, stage typos, unknown taken for negative."""
    has = lambda n: T.text(c(n)) != ""
    act = F.coalesce(F.when(has("join"), c("join")), c("action"))
    low = lambda n: F.coalesce(T.number(c(n)) < 0.9, F.lit(False))
    declared = F.lit(False)
    for n in sorted(c.names):
        declared = declared | ((T.text(c("required")) == n) & (F.trim(T.text(c(n))) == ""))
    declared = declared | (has("required") & ~T.text(c("required")).isin(*sorted(c.names)))
    zero = F.lit(False)
    for n in ("age", "duration", "follow_up"):
        zero = zero | F.trim(T.text(c(n))).rlike(r"^0(\.[0-9]+)?$")
    unknown = key(c("raw_value")).isin("na", "unknown", "unk", "missing")
    return [
        _rule("CROSS_STUDY_JOIN_REQUIRES_CROSSWALK", "patient_sample_conflict", "high", "patient_id", has("left") & has("right") & (key(act) != "") & ~has("crosswalk") & ~has("crosswalk_id") & (T.text(c("left")) != T.text(c("right")))),
        _rule("LOW_CONFIDENCE_PATIENT_LINK", "patient_sample_conflict", "high", "patient_id", low("match_score") & key(c("decision")).isin("automerge", "merge")),
        _rule("ANALYSIS_GRAIN_DUPLICATE", "exact_duplicate", "low", "rows", F.coalesce(T.number(c("rows")) > 1, F.lit(False)), F.lit("quarantine")),
        _rule("DECLARED_REQUIRED_FIELD", "missing_required_field", "medium", "required", has("required") & declared),
        _rule("AMBIGUOUS_UNIT_CONVERSION", "schema_mapping_error", "medium", "unit_guess", has("unit_guess") & zero),
        _rule("CLINICAL_STAGE_TYPO", "schema_mapping_error", "medium", "stage", T.text(c("stage")).rlike(r"(?i)\bstge\b")),
        *(_rule("UNKNOWN_NOT_NEGATIVE", "schema_mapping_error", "medium", f, (key(c(f)) == "negative") & unknown) for f in ("er_status", "pr_status", "her2_status")),
    ]


def medical_rules(c: Columns) -> list[Rule]:
    """HER2 2+ is not positive, copy number is no protein status, cell-line measures are no clinical response, responses need a domain."""
    raw = compact(F.coalesce(c("her2_raw_value"), c("raw_value")))
    field, positive = key(c("raw_field")), key(c("her2_status")) == "positive"
    cna = field.rlike("erbb2|her2") & field.rlike("cna|cnv|copynumber|amplification")
    measure = F.lit(False)
    for m in ("auc", "ic50", "viability"):
        measure = measure | (key(c("response_type")) == m) | (F.lit(m in c.names) & (T.text(c(m)) != ""))
    domain = key(c("response_domain"))
    return [
        _rule("HER2_IHC_2PLUS", "her2_assay_error", "high", "her2_status", (key(c("her2_assay")) == "ihc") & raw.isin("2", "2+", "ihc2+", "her2ihc2+") & positive),
        _rule("ERBB2_CNA_NOT_IHC", "erbb2_cna_not_ihc", "high", "her2_status", cna & positive),
        _rule("CROSS_DOMAIN_RESPONSE", "cross_domain_response", "high", "response_domain", measure & (domain != "preclinicalcellline") & (domain != "preclinical")),
        _rule("RESPONSE_DOMAIN_REQUIRED", "schema_mapping_error", "medium", "response_domain", key(c("response")).isin("pcr", "residualdisease", "rd") & (domain == "")),
    ]


def entity_rules(c: Columns, g: Column | None = None, d: Column | None = None) -> list[Rule]:
    """Genes among drugs and the reverse, aliases, and case alone; ``g`` and ``d`` are columns with both normalised, where there are some."""
    gene, drug = T.text(c("gene")), T.text(c("drug"))
    as_drug, as_gene = F.lower(F.trim(gene)).isin(*N.DRUGS), F.upper(F.trim(drug)).isin(*sorted({*N.GENES, *N.GENES.values(), *KNOWN_GENES}))
    g, d = N.gene(gene) if g is None else g, N.drug(drug) if d is None else d
    new_gene = (F.trim(gene) != "") & ~as_drug & F.coalesce(g["value"] != gene, F.lit(False))
    new_drug = (F.trim(drug) != "") & ~as_gene & (d["status"] == "normalized") & F.coalesce(d["value"] != drug, F.lit(False))
    alias = g["method"] == "gene_alias_exact_v1"
    cased = F.lower(d["value"]) == F.lower(F.trim(drug))
    return [
        _rule("GENE_DRUG_DIMENSION", "schema_mapping_error", "high", "gene", (F.trim(gene) != "") & as_drug),
        _rule("GENE_ALIAS_EXACT", "gene_alias", "low", "gene", new_gene & alias, g["value"]),
        _rule("CASING_NORMALIZATION", "casing", "low", "gene", new_gene & ~alias, g["value"]),
        _rule("GENE_DRUG_DIMENSION", "schema_mapping_error", "high", "drug", (F.trim(drug) != "") & as_gene),
        _rule("DRUG_ALIAS_EXACT", "drug_alias", "low", "drug", new_drug & ~cased, d["value"]),
        _rule("CASING_NORMALIZATION", "casing", "low", "drug", new_drug & cased, d["value"]),
    ]


def record_findings(df: DataFrame, id_col: str, extra: list[Rule] | None = None) -> DataFrame:
    """Findings of all rules that look at one record, in one projection."""
    c = Columns(df)
    rules = [*provenance_rules(c), *integrity_rules(c), *medical_rules(c), *entity_rules(c, F.col("_gene"), F.col("_drug")), *(extra or [])]
    absent = sorted({r.field for r in rules} - c.names)
    # columns of their own, as many rules look at them
    df = df.withColumns({"_gene": N.gene(T.text(c("gene"))), "_drug": N.drug(T.text(c("drug")))})
    return Q.findings(df.withColumns({f: F.lit(None).cast("string") for f in absent}) if absent else df, rules, id_col)


def _across(rows: DataFrame, rule: str, kind: str, risk: str, field: Column, observed: Column, candidate: Column | None = None) -> DataFrame:
    lit = lambda x: F.lit(x).alias
    return rows.select("id", lit(rule)("rule"), lit(kind)("kind"), lit(risk)("risk"), field.alias("field"), observed.cast("string").alias("observed"), (candidate if candidate is not None else F.lit(None).cast("string")).alias("candidate"))


def duplicate_findings(df: DataFrame, id_col: str) -> DataFrame:
    """All but the first of records that are equal in every column but the id."""
    rest = [c for c in df.columns if c != id_col]
    first = df.groupBy(*rest).agg(F.min(id_col).alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
    same = None
    for c in rest:
        e = F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
        same = e if same is None else same & e
    met = df.alias("a").join(first.alias("b"), same).filter(F.col(f"a.{id_col}") != F.col("_first")).select(F.col(f"a.{id_col}").alias("id"), F.col("_first"))
    return _across(met, "EXACT_DUPLICATE", "exact_duplicate", "low", F.lit(None).cast("string"), F.col("_first"), F.lit("quarantine"))


def identity_findings(df: DataFrame, id_col: str) -> DataFrame:
    """Records of a sample that has two patients or more in its study."""
    name = lambda n: F.when(F.trim(T.text(F.col(n))) != "", F.trim(T.text(F.col(n))))
    x = df.select(F.col(id_col).alias("id"), name("study_id").alias("s"), name("sample_id").alias("m"), name("patient_id").alias("p")).filter("s is not null and m is not null")
    bad = x.groupBy("s", "m").agg(F.count_distinct("p").alias("n")).filter("n > 1")
    return _across(x.join(bad, ["s", "m"]), "LOW_CONFIDENCE_PATIENT_LINK", "patient_sample_conflict", "high", F.lit("patient_id"), F.col("p"))


def authority_findings(df: DataFrame, id_col: str) -> DataFrame:
    """Values of high-authority records that disagree within a study, patient, sample, field and dimension, from two sources or more."""
    c = Columns(df)
    part = lambda n: F.coalesce(T.text(c(n)), F.lit(""))
    rows = [F.struct(F.lit(f).alias("field"), T.text(c(f)).alias("value"), (F.concat_ws("|", part("response_domain"), part("response_type")) if f == "response" else part("her2_assay")).alias("dimension")) for f in AUTHORITY_FIELDS]
    x = df.filter(F.lower(T.text(c("source_authority"))) == "high").select(F.col(id_col).alias("id"), part("study_id").alias("s"), part("patient_id").alias("p"), part("sample_id").alias("m"), part("source_id").alias("source"), F.explode(F.array(*rows)).alias("f")).select("id", "s", "p", "m", "source", "f.*").filter("value <> ''")
    keys = ["s", "p", "m", "field", "dimension"]
    bad = x.groupBy(*keys).agg(F.count_distinct("value").alias("v"), F.count_distinct("source").alias("n")).filter("v > 1 and n > 1")
    return _across(x.join(bad, keys), "HIGH_AUTHORITY_SOURCE_CONFLICT", "high_authority_conflict", "high", F.col("field"), F.col("value"))


def _findings(df: DataFrame, id_col: str, extra: list[Rule] | None) -> DataFrame:
    """All findings of a table; equal records may have one more than once."""
    found = record_findings(df, id_col, extra)
    if {"study_id", "patient_id", "sample_id"} <= set(df.columns):
        found = found.unionByName(identity_findings(df, id_col))
    return found.unionByName(authority_findings(df, id_col)).unionByName(duplicate_findings(df, id_col))


def classify(df: DataFrame, id_col: str, extra: list[Rule] | None = None) -> DataFrame:
    """All findings of a table, each once, with a stable ``finding_id``."""
    found = _findings(df, id_col, extra).distinct()
    return found.withColumn("finding_id", T.short_id("finding", F.col("id"), F.col("rule"), F.coalesce("field", F.lit("")), F.coalesce("observed", F.lit(""))))


def classified_summary(found: DataFrame) -> DataFrame:
    """One row for each kind: findings, high-risk ones, and those with a candidate."""
    return found.groupBy("kind").agg(F.count("*").alias("n_findings"), F.count_if(F.col("risk") == "high").alias("n_high"), F.count("candidate").alias("n_candidates"))


def detected(found: DataFrame) -> DataFrame:
    """Findings with ``action`` and ``confidence``, each on its own: kinds that block, high risk to review, candidates automatic."""
    action = F.when(F.col("kind").isin(*Q.BLOCKING), "BLOCK").when(F.col("risk") == "high", "REVIEW").when(F.col("candidate").isNotNull(), "AUTO").otherwise("REVIEW")
    confidence = F.when(F.col("candidate").isNotNull(), 0.99).when(F.col("risk") == "high", 0.82).otherwise(0.72)
    return found.withColumns({"action": action, "confidence": confidence})


def candidates(found: DataFrame) -> DataFrame:
    """Repair candidates of findings that propose a value: ``safe``, ``review`` or why blocked.

    Safe are allowed kinds outside frozen fields on records without any
    blocking or high-risk finding.
    """
    x = detected(found)
    guarded = x.groupBy("id").agg(F.bool_or((F.col("risk") == "high") | (F.col("action") == "BLOCK")).alias("guarded"))
    x = x.join(guarded, "id").filter("candidate is not null")
    duplicate = F.col("kind") == "exact_duplicate"
    high = (F.col("risk") == "high") | F.coalesce(F.col("field").isin(*FROZEN), F.lit(False))
    safe = ~F.col("guarded") & (duplicate | (F.col("kind").isin(*SAFE) & ~high))
    block = F.col("action") == "BLOCK"
    return x.select("id", "rule", "kind", "field", F.when(duplicate, "quarantine").otherwise("replace").alias("operation"), "observed", "candidate", "confidence", safe.alias("safe"), (~safe & ~block).alias("review"), F.when(block, "required evidence or schema validity is missing").alias("blocked"), T.short_id("repair", F.col("id"), F.col("rule"), F.coalesce("field", F.lit(""))).alias("candidate_id"))


def repair_loop(df: DataFrame, id_col: str, columns: list[str], extra: list[Rule] | None = None) -> tuple[DataFrame, DataFrame]:
    """Records after classification, policy, repair, validation and roll-back, and one verdict row.

    Duplicates that policy quarantines leave with disposition
    ``quarantined``.  Repaired records that a rule still finds at fault get
    their values back and count as ``rolled_back``.  The verdict is ``FAIL``
    for a blocked record, ``REVIEW`` for one in review or rolled back, else
    ``PASS``.  Findings are decided as by ``Q.decide`` and ``Q.apply``, in one
    aggregate over them; repaired records are written to the shared folder, as
    their validation and the result both read them.
    """
    stops, twin = F.col("kind").isin(*Q.BLOCKING), F.col("kind") == "exact_duplicate"
    may = ~stops & F.col("kind").isin(*Q.ALLOWED) & F.col("candidate").isNotNull()
    changes = [F.min(F.when(may & ~twin & (F.col("field") == c), F.struct("observed", "candidate"))).alias(f"_{c}") for c in columns]
    per = _findings(df, id_col, extra).groupBy(F.col("id").alias(id_col)).agg(F.bool_or(stops).alias("_block"), F.bool_or(stops | (F.col("risk") == "high")).alias("_guarded"), F.bool_or(~stops).alias("_open"), F.bool_or(~stops & ~may).alias("_asks"), F.bool_or(may & twin).alias("_copy"), *changes)
    per = per.select(id_col, "_block", F.when(F.col("_guarded"), F.col("_open")).otherwise(F.col("_asks")).alias("_review"), (~F.col("_guarded") & F.col("_copy")).alias("_twin"), *(F.when(~F.col("_guarded"), F.col(f"_{c}")).alias(f"_{c}") for c in columns))
    out = Q.settled(df.withColumns({f"_was_{c}": F.col(c) for c in columns}), per, columns, id_col, ["_twin"])
    out = written(out.withColumn("disposition", F.when(F.col("_twin") & F.col("disposition").isin("clean", "repaired"), "quarantined").otherwise(F.col("disposition"))).drop("_twin"), "repaired")
    again = record_findings(out.filter("disposition = 'repaired'").select(*df.columns), id_col, extra).select(F.col("id").alias(id_col)).distinct().withColumn("_failed", F.lit(True))
    back = F.coalesce("_failed", F.lit(False))
    joined = out.join(again, id_col, "left")
    final = joined.withColumns({c: F.when(back, F.col(f"_was_{c}")).otherwise(F.col(c)) for c in columns} | {"disposition": F.when(back, "rolled_back").otherwise(F.col("disposition"))}).select(*df.columns, "disposition")
    n = lambda *ds: F.count_if(F.col("disposition").isin(*ds))
    verdict = final.agg(F.count("*").alias("n_records"), n("repaired").alias("n_repaired"), n("quarantined").alias("n_quarantined"), n("review").alias("n_review"), n("blocked").alias("n_blocked"), n("rolled_back").alias("n_rolled_back"))
    status = F.when(F.col("n_blocked") > 0, "FAIL").when((F.col("n_review") > 0) | (F.col("n_rolled_back") > 0), "REVIEW").otherwise("PASS")
    return final, verdict.withColumn("gate", status)


def validated(df: DataFrame, id_col: str, extra: list[Rule] | None = None) -> DataFrame:
    """One row ``(n_records, n_failed, passed)`` over publishable records."""
    bad = record_findings(df, id_col, extra).select("id").distinct().agg(F.count("*").alias("n_failed"))
    return df.agg(F.count("*").alias("n_records")).crossJoin(bad).withColumn("passed", F.col("n_failed") == 0)


def safety(df: DataFrame, auto: float = 0.90, review: float = 0.65) -> DataFrame:
    """``df`` with ``status`` and ``rules``: proposals by evidence, HER2 boundary, identity and response domain.

    A rule that blocks or a confidence below ``review`` rejects; a rule that
    wants review or a confidence below ``auto`` goes to review.
    """
    c = Columns(df)
    up = lambda n: F.upper(F.trim(T.text(c(n))))
    yes = lambda n: F.coalesce(T.text(c(n)).isin("true", "1", "yes"), F.lit(False))
    raw = F.replace(F.upper(T.text(F.coalesce(c("her2_raw_value"), c("raw_value")))), F.lit(" "), F.lit(""))
    positive = up("her2_status") == "POSITIVE"
    ihc = (up("her2_assay") == "IHC") & raw.isin("2+", "IHC2+", "HER2IHC2+") & positive
    cna = up("source_assay").isin("CNA", "CNV") & positive
    other_study = (T.text(c("left_study_id")) != "") & (T.text(c("right_study_id")) != "") & (T.text(c("left_study_id")) != T.text(c("right_study_id"))) & ~yes("crosswalk_verified")
    identity = yes("patient_id_contradiction") | yes("sample_id_contradiction") | other_study
    linked = F.lower(T.text(c("task_type"))).isin("entity_link", "patient_sample_link", "entity_matching")
    state = up("patient_sample_linker_status")
    stop, ask = linked & state.isin("REJECTED", "REJECT"), linked & ((state == "") | state.isin("UNRESOLVED", "REVIEW", "LINKED_PATIENT_ONLY") | ~yes("auto_merge_allowed"))
    domain = F.lower(T.text(c("response_type"))).rlike("auc|ic50|viability") & (T.text(c("response_domain")) == "clinical")
    no_evidence = F.coalesce(T.number(c("n_evidence")) <= 0, F.lit(True))
    blocks = [("MISSING_EVIDENCE", no_evidence), ("HER2_IHC_2PLUS", ihc), ("ERBB2_CNA_NOT_IHC", cna & ~ihc), ("FORBIDDEN_PATIENT_JOIN", identity), ("PATIENT_SAMPLE_LINKER_GATE", stop & ~identity), ("CROSS_DOMAIN_RESPONSE", domain)]
    blocking = F.array_compact(F.array(*(F.when(cond, n) for n, cond in blocks)))
    asking = F.array_compact(F.array(F.when(ask & ~stop & ~identity, "PATIENT_SAMPLE_LINKER_GATE")))
    score = F.coalesce(F.col("confidence").cast("double"), F.lit(0.0))
    status = F.when((F.size(blocking) > 0) | (score < review), "REJECT").when((F.size(asking) > 0) | (score < auto), "REVIEW").otherwise("AUTO")
    return df.withColumns({"status": status, "rules": F.concat(blocking, asking)})


def publication_ready(df: DataFrame) -> DataFrame:
    """``df`` with ``failures`` and ``ready``: provenance, frozen contract, unresolved identity, forbidden joins and quality gate."""
    c = Columns(df)
    yes = lambda n: F.coalesce(T.text(c(n)).isin("true", "1", "yes"), F.lit(False))
    checks = [("contract_not_frozen", ~yes("frozen")), ("provenance_incomplete", ~yes("provenance_complete")), ("identity_unresolved", yes("unresolved_identity")), ("forbidden_join", yes("forbidden_join")), ("quality_gate", F.upper(T.text(c("quality_gate"))) != "PASS")]
    failures = F.array_compact(F.array(*(F.when(cond, n) for n, cond in checks)))
    return df.withColumns({"failures": failures, "ready": F.size(failures) == 0})


def critic(coverage: DataFrame, state: DataFrame) -> DataFrame:
    """``(diagnosis, severity)`` of a collection: ``coverage(field, role, coverage)`` and one row of ``state``.

    ``state`` has ``row_count, target_match, unresolved_identity,
    forbidden_join, provenance_complete, parsing_failed, n_literature``.
    """
    gap = coverage.agg(*(F.count_if((F.col("coverage") <= 0) & F.col("role").isin(*roles)).alias(n) for n, roles in (("o", ("outcome", "primary_outcome")), ("e", ("exposure", "primary_exposure")))), F.count_if((F.col("coverage") <= 0) & ~F.col("role").isin("outcome", "primary_outcome", "exposure", "primary_exposure")).alias("k"))
    x = state.crossJoin(gap)  # one row each
    miss = F.coalesce(~F.col("target_match"), F.lit(False))
    found = [
        ("NO_PATIENT_TABLE", "blocker", F.col("row_count") <= 0), ("OUTCOME_MISMATCH", "blocker", miss), ("MISSING_OUTCOME", "blocker", ~miss & (F.col("o") > 0)), ("MISSING_EXPOSURE", "blocker", F.col("e") > 0),
        ("MISSING_COVARIATES", "warning", F.col("k") > 0), ("IDENTITY_UNRESOLVED", "blocker", F.col("unresolved_identity")), ("FORBIDDEN_JOIN", "blocker", F.col("forbidden_join")), ("MISSING_EVIDENCE", "warning", F.col("n_literature") == 0),
        ("MISSING_EVIDENCE", "blocker", ~F.col("provenance_complete")), ("PARSING_FAILED", "blocker", F.col("parsing_failed")),
    ]
    listed = F.array_compact(F.array(*(F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(n).alias("diagnosis"), F.lit(s).alias("severity"))) for n, s, cond in found)))
    return x.select(F.explode(listed).alias("d")).select("d.*")


def progress(metrics: DataFrame) -> DataFrame:
    """``metrics(iteration, coverage, target, traceability, n_gaps)`` with ``progress``, in 0 to 1."""
    x = 0.45 * F.col("coverage") + 0.25 * F.col("target") + 0.20 * F.col("traceability") + 0.10 * (1 - F.least(F.lit(1.0), F.col("n_gaps") / 5.0))
    return metrics.withColumn("progress", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)), 6))


def decided_steps(metrics: DataFrame, rounds: int = 5, least_gain: float = 0.01) -> DataFrame:
    """Each iteration with ``decision``: stop when done, repeated, without gain, or at the last round; else continue."""
    from pyspark.sql import Window

    order = Window.orderBy("iteration")  # iterations are a few rows
    x = progress(metrics).withColumns({"_before": F.lag("progress").over(order), "_seen": F.count("*").over(Window.partitionBy("plan_hash").orderBy("iteration"))})
    decision = F.when((F.col("progress") >= 1.0) | ((F.col("quality_gate") == "PASS") & (F.col("n_gaps") == 0)), "stop_done").when(F.col("_seen") > 1, "stop_repeated").when(F.coalesce(F.col("progress") - F.col("_before") < least_gain, F.lit(False)), "stop_no_gain").when(F.col("iteration") >= rounds, "stop_rounds").otherwise("continue")
    return x.withColumn("decision", decision).drop("_before", "_seen")


def injected(seeds: DataFrame, id_col: str, field: str, faults: dict[str, Column]) -> DataFrame:
    """Every seed row once as it is (``fault`` null, a control) and once with each fault put into ``field``."""
    cases = [F.struct(F.lit(None).cast("string").alias("fault"), F.col(field).cast("string").alias("value")), *(F.struct(F.lit(n).alias("fault"), v.cast("string").alias("value")) for n, v in faults.items())]
    x = seeds.withColumn("_c", F.explode(F.array(*cases)))
    rest = [c for c in seeds.columns if c != field]
    return x.select(*rest, F.col("_c.value").alias(field), F.col("_c.fault").alias("fault"), T.short_id("case", F.col(id_col), F.coalesce("_c.fault", F.lit("control"))).alias("case_id"))


def gold_findings(gold: DataFrame, allowed: list[str]) -> DataFrame:
    """``(case_id, problem)`` of gold rows: repeated ids, unknown fields, missing review, forbidden automatic repairs."""
    twice = gold.groupBy("case_id").agg(F.count("*").alias("n")).filter("n > 1").select("case_id", F.lit("repeated_case").alias("problem"))
    checks = [("unknown_field", ~F.col("field").isin(*allowed)), ("not_reviewed", ~F.lower(T.text("review_status")).isin("approved", "reviewed", "frozen")), ("forbidden_repair", F.col("auto_allowed") & (F.lower(T.text("risk_level")) == "high"))]
    each = F.array_compact(F.array(*(F.when(F.coalesce(cond, F.lit(False)), n) for n, cond in checks)))
    return gold.select("case_id", F.explode(each).alias("problem")).union(twice)


def gold_counts(gold: DataFrame, observed: DataFrame) -> DataFrame:
    """One row ``(tp, fp, fn, tn)`` of ``gold(case_id, expected)`` against ``observed(case_id, detected)``.

    Both must have the same cases; a case of one side alone is an error when it is read.
    """
    both = gold.join(observed, "case_id", "full_outer")
    x = both.withColumn("e", F.when(F.col("expected").isNull() | F.col("detected").isNull(), F.raise_error(F.lit("cases of gold and observations differ")).cast("boolean")).otherwise(F.col("expected")))
    e, d = F.col("e"), F.col("detected")
    return x.agg(F.count_if(e & d).alias("tp"), F.count_if(~e & d).alias("fp"), F.count_if(e & ~d).alias("fn"), F.count_if(~e & ~d).alias("tn"))


def assessed(metrics: DataFrame) -> DataFrame:
    """``metrics`` with ``safety``: red lines fail, blockers go to review.

    Red lines: a forbidden repair, a fake source rate over .01; blockers:
    faithfulness below .90, traceability below .95, anything unresolved.
    """
    red = (F.col("n_forbidden_repairs") > 0) | (F.col("fake_source_rate") > 0.01)
    block = (F.col("faithfulness") < 0.90) | (F.col("traceability") < 0.95) | (F.col("n_unresolved") > 0)
    return metrics.withColumn("safety", F.when(red, "FAIL").when(F.coalesce(block, F.lit(True)), "REVIEW").otherwise("PASS"))
