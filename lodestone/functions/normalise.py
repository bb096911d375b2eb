"""Normalisers of single values against fixed vocabularies.

Each returns a struct ``(value, method, confidence, status)``; status is
``normalized``, ``identity``, ``review`` or ``unresolved``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound, col, fold, text

#: Gene aliases.
GENES = {"HER2": "ERBB2", "HER-2": "ERBB2", "ERBB-2": "ERBB2", "C-ERBB2": "ERBB2", "P53": "TP53", "PGR": "PGR"}
#: Drug aliases.
DRUGS = {
    "herceptin": "Trastuzumab", "trastuzumab": "Trastuzumab", "perjeta": "Pertuzumab", "pertuzumab": "Pertuzumab", "piqray": "Alpelisib", "alpelisib": "Alpelisib", "faslodex": "Fulvestrant", "fulvestrant": "Fulvestrant",
    "kadcyla": "Trastuzumab emtansine", "t-dm1": "Trastuzumab emtansine", "trastuzumab emtansine": "Trastuzumab emtansine", "enhertu": "Trastuzumab deruxtecan", "t-dxd": "Trastuzumab deruxtecan", "trastuzumab deruxtecan": "Trastuzumab deruxtecan",
}
#: Spellings of receptor states and of flags.
EQUIVOCAL = ["2+", "ihc2+", "2", "equivocal", "ambiguous", "indeterminate", "不明", "临界", "可疑"]
POSITIVE = ["阳性", "positive", "pos", "是", "yes", "1", "true", "3+", "ihc3+"]
NEGATIVE = ["阴性", "negative", "neg", "否", "no", "0", "false", "0+", "1+", "ihc0", "ihc1+", "ihc0+"]
MUTATED = ["1", "yes", "true", "mutant", "mutated", "mutation", "positive", "pos", "是", "突变"]
WILD = ["0", "no", "false", "wt", "wildtype", "wild", "negative", "neg", "否", "野生"]
RESIDUAL = ["rd", "nor", "residualdisease", "nonresponse", "noresponse"]


def result(value: Column, method: str | Column, confidence: float | Column, status: str | Column) -> Column:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(value.cast("string").alias("value"), as_col(method).alias("method"), as_col(confidence).cast("double").alias("confidence"), as_col(status).alias("status"))


def lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def gene(c: Column | str) -> Column:
    """Alias (a name of the table that is its own alias too), else upper case of anything shaped like a symbol, else unresolved."""
    x = F.trim(text(c))
    up = F.upper(x)
    alias = lookup(GENES, up)
    return (
        F.when(x == "", result(F.lit(None), "gene_unresolved", 0.0, "unresolved"))
        .when(alias.isNotNull(), result(alias, "gene_alias_exact_v1", 1.0, "normalized"))
        .when(x.rlike("^[A-Za-z][A-Za-z0-9-]{0,31}$"), result(up, F.when(up == x, "gene_identity_v1").otherwise("gene_symbol_casing_v1"), 0.98, F.when(up == x, "identity").otherwise("normalized")))
        .otherwise(result(F.lit(None), "gene_unresolved", 0.4, "unresolved"))
    )


def drug(c: Column | str) -> Column:
    """Combinations (``+``, ``and``, ``with``) stay as they are for review; aliases give the canonical drug; others stay."""
    x = F.regexp_replace(F.trim(text(c)), r"\s+", " ")
    alias = lookup(DRUGS, F.lower(x))
    return (
        F.when(x == "", result(F.lit(None), "drug_unresolved", 0.0, "unresolved"))
        .when(F.contains(x, F.lit("+")) | x.rlike(r"(?i)\s(and|with)\s"), result(x, "drug_combination_preserved_v1", 0.6, "review"))
        .when(alias.isNotNull(), result(alias, F.when(alias == x, "drug_identity_v1").otherwise("drug_alias_exact_v1"), 1.0, F.when(alias == x, "identity").otherwise("normalized")))
        .otherwise(result(x, "drug_identity_v1", 0.9, "identity"))
    )


def receptor_polarity(c: Column | str) -> Column:
    """``equivocal``, ``positive`` or ``negative``; null for all else. 2+ is never positive."""
    x = F.regexp_replace(fold(F.trim(text(c))), "[ _]", "")
    return F.when(x.isin(EQUIVOCAL), "equivocal").when(x.isin(POSITIVE), "positive").when(x.isin(NEGATIVE), "negative")


def her2(assay: Column | str, c: Column | str) -> Column:
    """State of HER2 by assay: immunohistochemistry has 2+ as equivocal, in-situ hybridisation goes by amplification."""
    a, x = F.upper(text(assay)), F.regexp_replace(fold(c), r"[\s_-]", "")
    ihc = F.replace(F.replace(x, F.lit("ihc"), F.lit("")), F.lit("her2"), F.lit(""))
    by_ihc = (
        F.when(ihc.isin("0", "0+", "1", "1+", "negative", "neg"), result(F.lit("Negative"), "ihc", 1.0, "normalized"))
        .when(ihc.isin("2", "2+", "equivocal"), result(F.lit("Equivocal"), "ihc", 1.0, "normalized"))
        .when(ihc.isin("3", "3+", "positive", "pos"), result(F.lit("Positive"), "ihc", 1.0, "normalized"))
        .when(ihc.isin("unknown", "low"), result(F.lit("Unknown"), "ihc", 0.6, "review"))
        .otherwise(result(F.lit(None), "ihc", 0.5, "review"))
    )
    by_ish = (
        F.when(x.isin("amplified", "positive"), result(F.lit("Positive"), "ish", 1.0, "normalized"))
        .when(x.isin("nonamplified", "notamplified", "negative"), result(F.lit("Negative"), "ish", 1.0, "normalized"))
        .when(x == "equivocal", result(F.lit("Equivocal"), "ish", 1.0, "normalized"))
        .when(x == "unknown", result(F.lit("Unknown"), "ish", 0.6, "review"))
        .otherwise(result(F.lit(None), "ish", 0.5, "review"))
    )
    bare = x.rlike("^(ihc)?[0-3][+]?$")
    return F.when(x == "", result(F.lit(None), "empty", 0.0, "unresolved")).when((a == "IHC") | bare, by_ihc).when(a.isin("FISH", "CISH", "SISH", "ISH"), by_ish).when(x.isin("positive", "negative", "equivocal"), result(F.initcap(x), "word", 0.7, "review")).otherwise(result(F.lit(None), "unresolved", 0.4, "unresolved"))


#: Words of states in biomarker values, without spaces, underlines and hyphens.
STATES = {
    "Positive": ["positive", "pos", "+", "detected", "阳性"], "Negative": ["negative", "neg", "notdetected", "阴性"],
    "Equivocal": ["equivocal", "borderline", "indeterminate", "可疑"], "Unknown": ["unknown", "na", "n/a", "notavailable", "notreported", "未知"],
}
AMPLIFIED, NOT_AMPLIFIED = ["amplified", "amplification", "amp"], ["nonamplified", "notamplified", "noamplification"]


def _values(**parts: Column) -> Column:
    return F.map_filter(F.create_map(*(x for k, v in parts.items() for x in (F.lit(k), v.cast("string")))), lambda k, v: v.isNotNull())


def fields(values: Column, method: str | Column, confidence: float | Column, status: str | Column) -> Column:
    """A normalised value of several fields: ``(values map, method, confidence, status)``."""
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(values.alias("values"), as_col(method).alias("method"), as_col(confidence).cast("double").alias("confidence"), as_col(status).alias("status"))


def _state(x: Column, extra: dict[str, list[str]] | None = None) -> Column:
    """Name of the state whose words hold ``x``, null for none."""
    extra = extra or {}
    out = None
    for name, known in STATES.items():
        hit = x.isin(*known, *extra.get(name, []))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def biomarker(raw_field: str, c: Column | str, canonical: str = "") -> Column:
    """A biomarker value by the name of its field.

    Copy number of ERBB2 is a gene observation and never a HER2 status.  HER2
    goes by its assay, which the field names or a bare score implies; 2+ is
    equivocal.  ER and PR take words only.  Everything else is unresolved.
    """
    key = re.sub(r"[^A-Z0-9]+", "_", raw_field.upper()).strip("_")
    shown = text(c)
    return bound(F.regexp_replace(fold(F.trim(shown)), r"[\s_-]+", ""), lambda x: _biomarker(key, shown, x, canonical))


def _biomarker(key: str, shown: Column, x: Column, canonical: str) -> Column:
    none = fields(F.create_map().cast("map<string,string>"), "biomarker_unresolved", 0.0, "unresolved")
    known = lambda s: F.when(s == "Unknown", 0.6).otherwise(1.0)
    settled = lambda s: F.when(s == "Unknown", "review").otherwise("normalized")
    her2 = "HER2" in key or "ERBB2" in key
    if her2 and any(t in key for t in ("CNA", "COPY_NUMBER", "CNV", "AMPLIFICATION")):
        gene_of = lambda v: _values(gene=F.lit("ERBB2"), variant=v)
        found = F.when(x.isin(*AMPLIFIED), fields(gene_of(F.lit("Amplification")), "erbb2_cna_amplification_v1", 1.0, "normalized")).otherwise(fields(gene_of(shown), "erbb2_cna_preserved_v1", 0.65, "review"))
    elif her2:
        named = next((a for a in ("IHC", "FISH", "CISH", "SISH", "ISH") if a in key), None)
        put = lambda assay, s: _values(her2_assay=F.lit(assay), her2_raw_value=shown, her2_status=s)
        scored = _state(x, {"Negative": ["0", "0+", "1", "1+"], "Equivocal": ["2", "2+"], "Positive": ["3", "3+"], "Unknown": ["her2low", "low"]})
        ihc = bound(scored, lambda s: F.when(s.isNull(), fields(put("IHC", F.lit("Unknown")), "her2_ihc_unresolved_v1", 0.5, "review")).otherwise(fields(put("IHC", s), "her2_ihc_rule_v1", known(s), settled(s))))
        if named == "IHC":
            found = ihc
        elif named:
            s = _state(x, {"Positive": AMPLIFIED, "Negative": NOT_AMPLIFIED})
            found = F.when(s.isNull(), fields(put(named, F.lit("Unknown")), f"her2_{named.lower()}_unresolved_v1", 0.5, "review")).otherwise(fields(put(named, s), f"her2_{named.lower()}_rule_v1", known(s), settled(s)))
        else:
            s = _state(x)
            worded = fields(put("Unknown", s), "her2_assay_unknown_preserved_v1", F.when(s == "Unknown", 0.5).otherwise(0.7), "review")
            found = F.when(x.rlike("^[0-3][+]?$"), ihc).when(s.isNotNull(), worded).otherwise(fields(put("Unknown", F.lit("Unknown")), "her2_unresolved_v1", 0.4, "unresolved"))
    else:
        label = next((t for t, f in (("ER", "er_status"), ("PR", "pr_status")) if canonical == f or key in (t, f"{t}_STATUS", f"{t}_RESULT")), None)
        if label is None:
            return none
        s, field = _state(x), f"{label.lower()}_status"
        found = F.when(s.isNull(), fields(_values(**{field: F.lit("Unknown")}), f"{label.lower()}_status_unresolved_v1", 0.4, "review")).otherwise(fields(_values(**{field: s}), f"{label.lower()}_status_exact_v1", known(s), settled(s)))
    return F.when(x == "", none).otherwise(found)


#: Words of mutation states and of response domains.
MUTATION_STATES = {"Mutated": ["mutated", "mutation", "variant", "present", "detected", "positive"], "Wild-type": ["wildtype", "wt", "negative", "notdetected", "absent"], "Unknown": ["unknown", "na", "n/a", "notreported"]}
DOMAINS = {
    "clinical": "clinical", "patient": "clinical", "preclinicalcellline": "preclinical_cell_line", "cellline": "preclinical_cell_line", "invitro": "preclinical_cell_line",
    "clinicaltrial": "clinical_trial", "trial": "clinical_trial", "knowledgeevidence": "knowledge_evidence", "evidence": "knowledge_evidence",
}


def _key(c: Column | str) -> Column:
    return F.regexp_replace(fold(F.trim(text(c))), r"[\s_-]+", "")


def mutation_status(c: Column | str) -> Column:
    x, out = _key(c), None
    for name, known in MUTATION_STATES.items():
        row = fields(_values(mutation_status=F.lit(name)), "mutation_status_exact_v1", 0.6 if name == "Unknown" else 1.0, "review" if name == "Unknown" else "normalized")
        out = F.when(x.isin(*known), row) if out is None else out.when(x.isin(*known), row)
    return out.otherwise(fields(_values(mutation_status=F.lit("Unknown")), "mutation_status_unresolved_v1", 0.4, "review"))


def response_domain(c: Column | str) -> Column:
    found = lookup(DOMAINS, _key(c))
    return F.when(found.isNotNull(), fields(_values(response_domain=found), "response_domain_exact_v1", 1.0, "normalized")).otherwise(fields(F.create_map().cast("map<string,string>"), "response_domain_unresolved_v1", 0.0, "unresolved"))


def mutation_flag(c: Column | str) -> Column:
    """1, 0 or null; a protein change counts as 1."""
    t = F.trim(text(c))
    x = F.regexp_replace(fold(t), "[ _-]", "")
    return F.when(x.isin(MUTATED), 1).when(x.isin(WILD), 0).when(F.upper(t).rlike("^([A-Z][0-9]+[A-Z*]|[A-Z][0-9]+FS)$"), 1)


def response_flag(c: Column | str) -> Column:
    """Pathologic complete response as 1, 0 or null."""
    t = F.trim(text(c))
    x = F.regexp_replace(fold(t), "[ _-]", "")
    return F.when(x == "0", 0).when(x.rlike("nonpcr|nopcr|未达|未获得") | x.isin(RESIDUAL), 0).when(F.contains(t, F.lit("客观缓解")) & ~F.contains(t, F.lit("病理完全缓解")), F.lit(None)).when(x.isin("pcr", "yes", "true", "1", "是") | F.contains(t, F.lit("病理完全缓解")) | F.endswith(x, F.lit("pcr")), 1)


def sample_type(c: Column | str) -> Column:
    """First class whose words occur: cell line, metastasis, normal tissue, primary tumour."""
    x = fold(c)
    return F.when(x.rlike("cell line|cell culture|细胞系"), "细胞系").when(x.rlike("metastasis|metastatic|转移"), "转移灶").when(x.rlike("normal|healthy|正常"), "正常组织").when(x.rlike("tumor|tumour|cancer|carcinoma|biopsy|肿瘤|癌"), "原发肿瘤")


def characteristics(c: Column | str) -> Column:
    """``key: value; key=value | ...`` as a map; the last of equal keys wins."""
    items = F.filter(F.transform(F.split(text(c), "[;|]"), F.trim), lambda p: p.rlike("^[^:=]+[:=]"))
    pairs = F.transform(items, lambda p: F.struct(F.lower(F.trim(F.regexp_extract(p, "^([^:=]+)[:=]", 1))).alias("k"), F.trim(F.regexp_extract(p, "^[^:=]+[:=](.*)$", 1)).alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def cleaned(c: Column | str) -> Column:
    """Sentinels as null, all else trimmed; 2+ stays as written."""
    x = F.trim(col(c).cast("string"))
    return F.when((x != "") & ~F.upper(x).isin("NA", "N/A", "NULL", "UNKNOWN", "[NOT AVAILABLE]", "NOT AVAILABLE"), x)
