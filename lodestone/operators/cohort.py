"""Wide cohort tables from attribute rows, and fields that follow from others of the same row.

A table may lack any column; an absent column reads as null.  Order columns
(``ord``) say which of several rows came last or first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalise as N
from ..functions import text as T
from ..shared import dealt, written

#: Attribute names that do not become the lower-case name itself.
ATTRIBUTES = {
    "AGE_AT_DIAGNOSIS": "age", "GENDER": "sex", "TUMOR_STAGE": "stage", "AJCC_PATHOLOGIC_TUMOR_STAGE": "stage", "TUMOR_GRADE": "grade",
    "HER2_IHC": "her2_status", "IHC_HER2": "her2_status", "HER2_IHC_SCORE": "her2_status", "HER2_STATUS_IHC": "her2_status",
    "OS": "os_status", "OVERALL_SURVIVAL": "os_months", "OVERALL_SURVIVAL_MONTHS": "os_months", "DFS": "dfs_status", "RFS_STATUS": "dfs_status", "RFS_MONTHS": "dfs_months", "RFS": "dfs_status",
    "DISEASE_FREE_SURVIVAL": "dfs_months", "DISEASE_FREE_SURVIVAL_MONTHS": "dfs_months", "DSS": "dss_status", "DISEASE_SPECIFIC_SURVIVAL": "dss_months",
    "PCR_RESPONSE": "pcr", "PCR_STATUS": "pcr", "PATHOLOGIC_COMPLETE_RESPONSE": "pcr",
    "RESPONSE": "treatment_response", "RECIST_RESPONSE": "treatment_response", "TREATMENT_BEST_RESPONSE": "treatment_response", "BEST_RESPONSE_TO_THERAPY": "treatment_response", "CLINICAL_BENEFIT": "treatment_response", "BEST_RESPONSE": "treatment_response",
    "TREATMENT_ARM": "treatment", "BREAST_CANCER_SUBTYPE": "subtype", "SAMPLE_COLLECTION_TIMEPOINT": "sample_timepoint", "CANCER_TYPE": "disease",
    "PIK3CA_MUT_PRE_TREATMENT_TUMOR": "pik3ca_mutation", "PIK3CA_PRE_TREATMENT_TUMOR": "pik3ca_mutation", "PIK3CA_STATUS": "pik3ca_mutation", "INT_CLUST": "intclust", "INTEGRATIVE_CLUSTER": "intclust",
}
#: Other names of outcome columns, in the order in which they are tried.
SURVIVAL = {"overall_survival": "os_months", "overall_survival_months": "os_months", "os": "os_status", "dss": "dss_status", "rfs": "dfs_status", "rfs_status": "dfs_status", "rfs_months": "dfs_months", "disease_free_survival": "dfs_months", "disease_free_survival_months": "dfs_months", "disease_specific_survival": "dss_months"}
RESPONSES = {"pathological_complete_response": "pcr", "pathologic_complete_response": "pcr", "pathologic_response_pcr_rd": "pcr", "pcr_status": "pcr", "pcr_yes_no": "pcr", "pcr_rd": "pcr", "pathologic_response": "treatment_response", "response_at_surgery": "treatment_response"}
HER2 = ["her2_ihc", "her2_status_ihc", "her2_ihc_status", "her2_ihc_score", "ihc_her2", "erbb2_status"]
#: Weights of outcome fields and priorities of targets by the kind of outcome asked for.
OUTCOME_WEIGHTS = {
    "pcr": {"pcr": 1.0, "pathological_complete_response": 1.0, "pathologic_complete_response": 1.0, "pcr_binary": 0.96, "response_at_surgery": 0.88, "treatment_response": 0.82, "response": 0.76, "trastuzumab_response": 0.72},
    "response": {"treatment_response": 1.0, "response": 0.94, "response_at_surgery": 0.9, "pcr": 0.88, "pcr_binary": 0.84, "trastuzumab_response": 0.8},
    "survival": {"os_status": 1.0, "os_months": 0.9, "dfs_status": 0.94, "dfs_months": 0.88, "dss_status": 0.92, "dss_months": 0.86, "vital_status": 0.52},
}
TARGETS = {
    "pcr": ["pcr", "pcr_binary", "treatment_response", "response"], "survival": ["os_status", "os_months", "dfs_status", "dfs_months", "dss_status", "dss_months", "vital_status"],
    "response": ["treatment_response", "pcr", "pcr_binary", "response", "pathological_complete_response"],
}
IDS = ["study_id", "patient_id", "sample_id", "source_id"]
#: Columns that a pivot may make at most; more is an error, not a cut.
WIDEST = 4000


def column(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def filled(df: DataFrame, name: str) -> Column:
    return T.is_filled(column(df, name))


def attribute(c: Column | str) -> Column:
    """Canonical column name of an attribute; null if nothing is left of it."""
    x = F.upper(F.trim(T.text(c)))
    return F.coalesce(N.lookup(ATTRIBUTES, x), T.snake(x))


def _names(names: DataFrame) -> list[str]:
    found = sorted(r[0] for r in names.distinct().limit(WIDEST + 1).collect())  # names of columns
    if len(found) > WIDEST:
        raise ValueError(f"more than {WIDEST} different attributes")
    return found


def _attributes(rows: DataFrame) -> tuple[DataFrame, list[str]]:
    """``rows`` with ``attribute``, the canonical name of theirs or null, reckoned once for each name; and all of these."""
    ids = written(rows.select("clinicalAttributeId").distinct(), "attribute-ids")
    known = written(ids.withColumn("attribute", attribute("clinicalAttributeId")).filter("attribute is not null"), "attributes")
    return rows.join(F.broadcast(known), "clinicalAttributeId", "left"), _names(known.select("attribute"))  # names of columns


def _wide(rows: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """One row for each of ``keys``: the last cleaned value of each attribute behind a mark, the mark alone where it is missing.

    Rows are dealt by patient before anything is sorted, and stay there.
    """
    last = dealt(rows.select(*keys, F.coalesce("attribute", F.lit("")).alias("attribute"), "value", "ord"), "patient").groupBy(*keys, "attribute").agg(F.max_by("value", "ord").alias("value"))
    return last.withColumn("value", F.concat(F.lit("="), F.coalesce(N.cleaned("value"), F.lit("\0")))).groupBy(*keys).pivot("attribute", names).agg(F.first("value"))


def _value(marked: Column) -> Column:
    return F.when(marked != "=\0", F.substring(marked, 2, 1 << 30))


def clinical(patients: DataFrame, samples: DataFrame, study: str, source: str) -> DataFrame:
    """One row for each sample of the cohort with its attributes and those of its patient, which win.

    ``patients(patientId, clinicalAttributeId, value, ord)``, ``samples`` with
    ``sampleId`` too.  Samples anchor the cohort; without any sample row the
    patients are its rows.  A missing sample name stays missing.
    """
    name = lambda c: F.when(F.trim(F.col(c).cast("string")) != "", F.trim(F.col(c).cast("string")))
    p, own = _attributes(patients.withColumn("patient", name("patientId")).filter("patient is not null"))
    p = p.filter("attribute is not null")
    s = samples.withColumns({"patient_id": name("patientId"), "sample_id": name("sampleId")}).filter("patient_id is not null or sample_id is not null")
    s = s.withColumn("patient", F.coalesce("patient_id", "sample_id"))
    if s.limit(1).count():
        s, names = _attributes(s)
        more = [c for c in own if c not in names]
        if more:  # only those of a patient of the cohort
            more = _names(p.filter(F.col("attribute").isin(more)).join(s.select("patient").distinct(), "patient", "left_semi").select("attribute"))
        own = [c for c in own if c in names or c in more]
        # a sample named as its patient may or may not state one: "=" says that it does
        stated = F.when((F.col("patient") == F.col("sample_id")) & F.col("patient_id").isNotNull(), F.array(F.col("attribute"), F.lit("="))).otherwise(F.array("attribute"))
        wide = _wide(s.withColumn("attribute", F.explode(stated)), ["patient", "sample_id"], [*names, "="])
        rows = wide.select("patient", "sample_id", F.when(F.coalesce(F.col("patient") != F.col("sample_id"), F.lit(True)) | F.col("`=`").isNotNull(), F.col("patient")).alias("_stated"), *(F.col(f"`{c}`").alias(f"s_{c}") for c in names))
        if own:
            rows = rows.join(_wide(p, ["patient"], own).select("patient", *(F.col(f"`{c}`").alias(f"p_{c}") for c in own)), "patient", "left")
        value = lambda c: _value(F.coalesce(*(F.col(f"`{x}_{c}`") for x, some in (("p", own), ("s", names)) if c in some)))
        rows = rows.select(F.col("_stated").alias("patient_id"), "sample_id", *(value(c).alias(c) for c in sorted({*names, *more}) if c not in ("patient", "sample_id", *IDS)))
    else:
        rows = _wide(p, ["patient"], own) if own else p.select("patient").distinct()
        rows = rows.select(F.col("patient").alias("patient_id"), F.lit(None).cast("string").alias("sample_id"), *(_value(F.col(f"`{c}`")).alias(c) for c in own if c not in ("patient", *IDS)))
    return rows.select(F.lit(study).alias("study_id"), "patient_id", "sample_id", F.lit(source).alias("source_id"), *(F.col(f"`{c}`") for c in rows.columns if c not in IDS))


def located(molecular: DataFrame, rows: DataFrame) -> DataFrame:
    """``molecular`` with ``(row_patient, row_sample)`` of its cohort row: by sample, else by a patient with one row; null for orphans."""
    clean = lambda c: F.when(F.trim(F.col(c)) != "", F.trim(F.col(c)))
    key = F.struct(F.col("patient_id").alias("p"), F.col("sample_id").alias("s"))
    by_sample = rows.filter("sample_id is not null").groupBy(F.col("sample_id").alias("ms")).agg(F.min(key).alias("a"))
    by_patient = rows.filter("patient_id is not null").groupBy(F.col("patient_id").alias("mp")).agg(F.min(key).alias("b"), F.count("*").alias("n")).filter("n = 1").drop("n")
    met = molecular.withColumns({"ms": clean("sampleId"), "mp": clean("patientId"), "gene": F.when(F.upper(F.trim("gene")).rlike("^[A-Z0-9][A-Z0-9._-]*$"), F.lower(F.trim("gene")))}).join(by_sample, "ms", "left").join(by_patient, "mp", "left")
    return met.withColumn("row", F.coalesce("a", "b")).withColumns({"row_patient": F.col("row.p"), "row_sample": F.col("row.s"), "found": F.col("row").isNotNull()}).drop("a", "b", "row", "ms", "mp")


def orphans(molecular: DataFrame, rows: DataFrame) -> DataFrame:
    """Number of molecular rows with a gene that have no cohort row."""
    return located(molecular, rows).filter("gene is not null and not found").agg(F.count("*").alias("n_orphans"))


def with_molecular(rows: DataFrame, mutations: DataFrame, cna: DataFrame) -> DataFrame:
    """``rows`` with ``<gene>_mutation`` (0 where the gene was seen elsewhere), ``<gene>_variants`` and ``<gene>_cna``.

    Variants are distinct, in the order in which they came; the last copy
    number of a row wins.  Rows never arise from molecular data.
    """
    rows = written(rows, "cohort")
    keys = ["row_patient", "row_sample"]
    protein = F.when(F.trim(T.text("proteinChange")) != "", F.trim("proteinChange"))
    ords = {True: dict(mutations.dtypes)["ord"], False: dict(cna.dtypes)["ord"]}
    told = lambda df, v, mutated: located(df, rows).filter("gene is not null and found").select(*keys, "gene", F.lit(mutated).alias("mutated"), v.alias("v"), *((F.col("ord") if k == mutated else F.lit(None)).cast(t).alias(f"ord{int(k)}") for k, t in ords.items()))
    # dealt by rows once: all that follows stays there
    x = dealt(told(mutations, protein, True).unionByName(told(cna, F.col("alteration").cast("string"), False)), *keys)
    first = x.groupBy(*keys, "gene", "mutated", "v").agg(F.min("ord1").alias("o"), F.max("ord0").alias("c"))
    listed = first.groupBy(*keys, "gene").agg(
        F.max("mutated").alias("m"), F.array_sort(F.collect_list(F.when(F.col("mutated") & F.col("v").isNotNull(), F.struct("o", "v")))).alias("x"),
        F.min("mutated").alias("no_cna"), F.max_by(F.when(~F.col("mutated"), F.col("v")), F.when(~F.col("mutated"), F.col("c"))).alias("cna"),
    )
    named = lambda cond, suffix, value: F.when(cond, F.struct(F.concat("gene", F.lit(suffix)).alias("name"), value.alias("value")))
    parts = F.array_compact(F.array(named(F.col("m"), "_mutation", F.lit("1")), named(F.size("x") > 0, "_variants", F.array_join(F.transform("x", lambda e: e["v"]), ";")), named(~F.col("no_cna"), "_cna", F.col("cna"))))
    wide = written(listed.groupBy(*keys).agg(F.map_from_entries(F.flatten(F.collect_list(parts))).alias("of")), "molecular")  # the genes of one row
    new = _names(wide.select(F.explode(F.map_keys("of"))))
    met = rows.alias("r").join(wide.alias("w"), F.col("r.patient_id").eqNullSafe(F.col("w.row_patient")) & F.col("r.sample_id").eqNullSafe(F.col("w.row_sample")), "left")
    value = lambda c: F.coalesce(F.col("w.of")[c], F.lit("0")) if c.endswith("_mutation") else F.col("w.of")[c]
    return met.select(*(F.col(f"r.`{c}`") for c in rows.columns if c not in new), *(value(c).alias(c) for c in new))


def receptor_rule(df: DataFrame, hr_positive: bool = False, her2_negative: bool = False, hr_negative: bool = False) -> Column:
    """Whether a row may belong to a receptor group; unknown states do not speak against it."""
    state = lambda c: N.receptor_polarity(column(df, c))
    er, pr, her2 = state("er_status"), state("pr_status"), state("her2_status")
    is_ = lambda s, v: F.coalesce(s == v, F.lit(False))
    positive = is_(er, "positive") | is_(pr, "positive")
    out = F.lit(True)
    if her2_negative:
        out = out & (her2.isNull() | is_(her2, "negative"))
    if hr_positive:
        out = out & ((er.isNull() & pr.isNull()) | positive)
    if hr_negative:
        both = er.isNotNull() & pr.isNotNull()
        out = out & ~positive & ~is_(her2, "equivocal") & (~both | (is_(er, "negative") & is_(pr, "negative")))
    return out


def receptor_filtered(df: DataFrame, **rule: bool) -> DataFrame:
    """Rows of a receptor group; all rows where there is no receptor column or no row would be left."""
    if not {"er_status", "pr_status", "her2_status"} & set(df.columns):
        return df
    keep = receptor_rule(df, **rule)
    return df.filter(keep) if df.filter(keep).limit(1).count() else df


def _put(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``name`` filled with ``value`` where it is not filled."""
    return df.withColumn(name, F.when(filled(df, name), column(df, name).cast("string")).otherwise(value.cast("string")))


def canonical_fields(df: DataFrame, protocol: dict[str, str] | None = None) -> DataFrame:
    """Mutation flags, subtype from HER2, treatment from its kinds or the protocol, response and sample fields from siblings."""
    protocol = protocol or {}
    for c in [c for c in df.columns if c.endswith("_mutation")]:
        df = df.withColumn(c, F.coalesce(N.mutation_flag(c).cast("string"), F.col(c).cast("string")))
    her2 = F.trim(T.text(column(df, "her2_status")))
    df = _put(df, "subtype", F.when(her2.isin("阳性", "Positive", "positive"), "HER2-positive").when(her2.isin("阴性", "Negative", "negative"), "HER2-negative"))
    kinds = {"chemotherapy": "化疗", "hormone_therapy": "内分泌治疗", "radio_therapy": "放射治疗"}
    given = [F.when(filled(df, c), F.when(column(df, c).isin("是", "Yes", "YES", "true"), kind).otherwise(column(df, c))) for c, kind in kinds.items()]
    df = _put(df, "treatment", F.coalesce(*given, F.lit(protocol.get("treatment"))))
    df = _put(df, "treatment_response", F.when(filled(df, "pcr"), column(df, "pcr")))
    df = _put(df, "sample_type", F.lit(protocol.get("sample_type")))
    return _put(df, "sample_timepoint", F.when(filled(df, "timepoint"), column(df, "timepoint")))


def _first_alias(df: DataFrame, names: list[str]) -> tuple[Column, Column]:
    """Name and value of the first filled column of ``names``."""
    pick = [F.when(filled(df, n), F.struct(F.lit(n).alias("n"), column(df, n).cast("string").alias("v"))) for n in names]
    x = F.coalesce(*pick)
    return x["n"], x["v"]


def outcome_synonyms(df: DataFrame, survival: bool = True, response: bool = True) -> DataFrame:
    """Canonical outcome columns filled from their other names; ``raw_field`` and ``raw_value`` say where the first came from."""
    tables = [t for t, on in ((SURVIVAL, survival), (RESPONSES, response)) if on]
    origin = []
    for table in tables:
        for target in dict.fromkeys(table.values()):
            name, value = _first_alias(df, [a for a, c in table.items() if c == target])
            came = F.when(~filled(df, target) & value.isNotNull(), F.struct(name.alias("n"), value.alias("v")))
            mark = f"_from_{target}"
            df = df.withColumn(mark, came)
            df = _put(df, target, F.col(mark)["v"])
            origin.append(mark)
    first = F.coalesce(*(F.col(m) for m in origin)) if origin else None
    if first is not None:
        df = df.withColumn("_origin", first)
        for name, part in (("raw_field", "n"), ("raw_value", "v")):
            df = df.withColumn(name, F.coalesce(column(df, name).cast("string"), F.col("_origin")[part]))
        df = df.drop("_origin", *origin)
    return _put(df, "treatment_response", F.when(filled(df, "pcr"), column(df, "pcr"))) if response else df


def her2_synonyms(df: DataFrame) -> DataFrame:
    """``her2_status`` from the first of its other names that is filled, as it is written."""
    name, value = _first_alias(df, HER2)
    df = df.withColumns({"_n": F.when(~filled(df, "her2_status"), name), "_v": F.when(~filled(df, "her2_status"), value)})
    df = _put(df, "her2_status", F.col("_v"))
    for target, part in (("raw_field", "_n"), ("raw_value", "_v")):
        df = df.withColumn(target, F.coalesce(column(df, target).cast("string"), F.col(part)))
    return df.drop("_n", "_v")


def derived(df: DataFrame, genes: list[str] | None = None) -> DataFrame:
    """Subtype by receptors, binary response, age group, altered genes and any BRCA mutation, all from the same row."""
    genes = [g.lower() for g in genes or []]
    state = lambda c: N.receptor_polarity(column(df, c))
    er, pr, her2 = state("er_status"), state("pr_status"), state("her2_status")
    is_ = lambda s, v: F.coalesce(s == v, F.lit(False))
    hr = is_(er, "positive") | is_(pr, "positive")
    subtype = (
        F.when(is_(er, "negative") & is_(pr, "negative") & is_(her2, "negative"), "Triple-negative").when(is_(her2, "positive") & hr, "HR-positive/HER2-positive")
        .when(is_(her2, "positive"), "HER2-positive").when(is_(her2, "negative") & hr, "HR-positive/HER2-negative")
    )
    flag = F.coalesce(N.response_flag(column(df, "pcr")), N.response_flag(column(df, "treatment_response")))
    df = df.withColumns({"derived_ihc_subtype": subtype, "pcr_binary": flag, "age_group": T.age_group(column(df, "age"))})
    df = _put(df, "subtype", F.col("derived_ihc_subtype"))
    df = _put(df, "pcr", F.when(F.col("pcr_binary") == 1, "病理完全缓解（pCR）").when(F.col("pcr_binary") == 0, "未达病理完全缓解"))
    for g in genes:
        mutated, changed = N.mutation_flag(column(df, f"{g}_mutation")), T.altered(column(df, f"{g}_cna"))
        df = df.withColumn(f"{g}_altered", F.when(mutated.isNotNull() | changed.isNotNull(), (is_(mutated, 1) | F.coalesce(changed, F.lit(False))).cast("int")))
    if {"brca1", "brca2"} <= set(genes):
        a, b = N.mutation_flag(column(df, "brca1_mutation")), N.mutation_flag(column(df, "brca2_mutation"))
        df = df.withColumn("brca_any_mutation", F.when(a.isNotNull() | b.isNotNull(), (is_(a, 1) | is_(b, 1)).cast("int")))
    return df


def filled_columns(df: DataFrame) -> list[str]:
    """Columns with a filled value, in one pass."""
    if not df.columns:
        return []
    row = df.agg(*(F.max(T.is_filled(F.col(f"`{c}`"))).alias(f"c{k}") for k, c in enumerate(df.columns))).first()
    return [c for k, c in enumerate(df.columns) if row[k]]


def ordered(df: DataFrame, priority: list[str]) -> DataFrame:
    """Identifiers, then filled priority columns, then other filled ones by name; columns without any value are left out."""
    have = filled_columns(df)
    fixed = [c for c in IDS if c in df.columns]
    first = [c for c in dict.fromkeys(priority) if c in have and c not in fixed]
    rest = sorted(c for c in have if c not in fixed and c not in first)
    return df.select(*(F.col(f"`{c}`") for c in fixed + first + rest))


def target(df: DataFrame, kind: str | None, genes: list[str] | None = None) -> str | None:
    """The first filled column of the target list of an outcome kind, or of the genes and receptors without one."""
    names = TARGETS.get(kind or "") or [f"{g.lower()}{s}" for g in genes or [] for s in ("_mutation", "_variants", "_altered")] + ["er_status", "her2_status", "subtype", "derived_ihc_subtype"]
    have = set(filled_columns(df.select(*(F.col(f"`{c}`") for c in names if c in df.columns))))
    return next((c for c in names if c in have), None)


def _fill(df: DataFrame, name: str) -> Column:
    return F.avg(T.is_filled(column(df, name), "trimmed").cast("double")) if name in df.columns else F.lit(0.0)


def outcome_match(df: DataFrame, kind: str | None) -> DataFrame:
    """One row ``outcome_match``: the best of weight times share of filled rows; 1 where no outcome is asked for."""
    weights = OUTCOME_WEIGHTS.get(kind or "", {})
    best = F.greatest(F.lit(0.0), F.lit(0.0), *(w * F.coalesce(_fill(df, c), F.lit(0.0)) for c, w in weights.items()))
    return df.agg((F.round(F.least(F.lit(1.0), best), 4) if weights else F.lit(1.0)).alias("outcome_match"))


def gene_scores(df: DataFrame, genes: list[str], copy_number: bool = False) -> DataFrame:
    """``(gene, score)``: the best of mutation, .92 variants, .52 copy number (1 if asked for) and .78 altered, by share of filled rows."""
    def one(g: str) -> Column:
        share = lambda s: F.coalesce(_fill(df, f"{g.lower()}{s}"), F.lit(0.0))
        return F.round(F.least(F.lit(1.0), F.greatest(share("_mutation"), 0.92 * share("_variants"), (1.0 if copy_number else 0.52) * share("_cna"), 0.78 * share("_altered"))), 4)

    row = df.agg(*(one(g).alias(f"g{k}") for k, g in enumerate(genes)))
    return row.select(F.explode(F.array(*(F.struct(F.lit(g).alias("gene"), F.col(f"g{k}").alias("score")) for k, g in enumerate(genes)))).alias("x")).select("x.*")


def gene_coverage(df: DataFrame, genes: list[str], copy_number: bool = False) -> DataFrame:
    """One row ``gene_coverage``: the mean of ``gene_scores``."""
    return gene_scores(df, genes, copy_number).agg(F.round(F.avg("score"), 4).alias("gene_coverage"))


def any_coverage(df: DataFrame, fields: dict[str, list[str]]) -> DataFrame:
    """``(field, coverage)``: share of rows in which one of a field's columns is filled."""
    def one(names: list[str]) -> Column:
        hit = F.lit(False)
        for n in names:
            hit = hit | T.is_filled(column(df, n), "trimmed")
        return F.coalesce(F.avg(hit.cast("double")), F.lit(0.0))

    row = df.agg(*(F.round(one(ns), 6).alias(f"f{k}") for k, ns in enumerate(fields.values())))
    return row.select(F.explode(F.array(*(F.struct(F.lit(n).alias("field"), F.col(f"f{k}").alias("coverage")) for k, n in enumerate(fields)))).alias("x")).select("x.*")


def numeric_columns(df: DataFrame, columns: list[str], least: float = 0.8) -> DataFrame:
    """``(column, n_filled, n_numbers, numeric)``: columns of which ``least`` of the filled values are numbers."""
    blank = lambda c: F.trim(T.text(c)) == ""
    row = df.agg(*(x for k, c in enumerate(columns) for x in (F.count_if(~blank(c)).alias(f"n{k}"), F.count_if(T.loose_number(c).isNotNull()).alias(f"m{k}"))))
    each = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"n{k}").alias("n_filled"), F.col(f"m{k}").alias("n_numbers")) for k, c in enumerate(columns)))
    return row.select(F.explode(each).alias("x")).select("x.*").withColumn("numeric", (F.col("n_filled") > 0) & (F.col("n_numbers") >= least * F.col("n_filled")))


def outcome_gap(columns: list[str], kind: str, match_rate: float, has_cohort: bool = True) -> str:
    """Why an outcome is not there: ``none``, ``unmapped_synonym``, ``wrong_cohort`` or ``missing``."""
    have = {c.lower() for c in columns}
    if match_rate > 0 and have & set(OUTCOME_WEIGHTS.get(kind, {})):
        return "none"
    synonyms = SURVIVAL if kind == "survival" else RESPONSES
    if have & set(synonyms):
        return "unmapped_synonym"
    other = {c for k, ws in OUTCOME_WEIGHTS.items() if k != kind for c in ws} - set(OUTCOME_WEIGHTS.get(kind, {}))
    return "wrong_cohort" if has_cohort and have & other else "missing"


def alignment(df: DataFrame, sources: DataFrame) -> DataFrame:
    """``(source_id, n_rows, n_patients, n_samples, n_repeated, status)`` of registered and used sources.

    ``UNMATCH``: registered and without rows, or with rows and not registered.
    ``REVIEW``: rows without patient and sample, or repeated identities.
    """
    key = F.concat_ws("|", "patient_id", "sample_id")
    has = F.col("patient_id").isNotNull() | F.col("sample_id").isNotNull()
    used = df.groupBy("source_id").agg(F.count("*").alias("n_rows"), F.count_distinct("patient_id").alias("n_patients"), F.count_distinct("sample_id").alias("n_samples"), (F.count_if(has) - F.count_distinct(F.when(has, key))).alias("n_repeated"), F.count_if(~has).alias("n_nameless"))
    both = used.join(sources.select("source_id").distinct().withColumn("registered", F.lit(True)), "source_id", "full_outer")
    status = F.when(F.col("registered").isNull() | F.col("n_rows").isNull(), "UNMATCH").when((F.col("n_nameless") > 0) | (F.col("n_repeated") > 0), "REVIEW").otherwise("MATCH")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return both.select("source_id", zero("n_rows"), zero("n_patients"), zero("n_samples"), zero("n_repeated"), status.alias("status"))
