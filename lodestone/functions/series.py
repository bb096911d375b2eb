"""Values of series records by the names that submitters give their fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

#: Names of a field in parsed characteristics, in the order in which they are looked up.
NAMES = {
    "treatment_response": [
        "response_at_surgery", "treatment_response", "response", "pcr", "pcr_status", "pathological_complete_response", "pathologic_complete_response", "pathologic_response", "clinical_response", "trastuzumab_response", "herceptin_response",
        "neoadjuvant_response", "chemo_response", "chemotherapy_response", "residual_cancer_burden", "rcb_class", "miller_payne", "pathologic_response_pcr_rd", "pcr_rd", "pcr_vs_rd",
    ],
    "pcr": ["pcr", "pcr_status", "pcr_yes_no", "pathological_complete_response", "pathologic_complete_response", "pathologic_response", "pathologic_response_pcr_rd", "pcr_rd", "pcr_vs_rd", "residual_disease_pcr"],
    "disease": ["patient_status", "disease", "diagnosis", "cancer_type", "disease_state"],
    "treatment": ["treatment", "therapy", "neoadjuvant_treatment", "neoadjuvant_therapy", "drug", "regimen", "treatment_protocol", "her2_therapy"],
    "sample_type": ["sample_type", "sample_type_detailed", "tissue_type", "specimen_type"],
    "sample_source": ["sample_source", "tissue_source_site", "tissue_source", "specimen_source", "sample_origin", "organ", "tissue", "biopsy_site"],
    "sample_timepoint": ["sample_timepoint", "timepoint", "time_point", "collection_timepoint", "sampling_timepoint", "treatment_timepoint"],
    "her2_status": ["her2_status", "her2", "her2_ihc", "erbb2_status", "her2_status_ihc", "her2_ihc_status", "her2_ihc_score", "ihc_her2"],
    "er_status": ["er_status", "er", "estrogen_receptor", "er_status_ihc", "er_ihc"],
    "pr_status": ["pr_status", "pr", "progesterone_receptor", "pr_status_ihc", "pr_ihc"],
    "subtype": ["subtype", "molecular_subtype", "breast_cancer_subtype"],
    "stage": ["stage", "tumor_stage", "ajcc_stage"],
    "age": ["age", "age_at_diagnosis", "age_years"],
}
#: Fields whose values say whether the response was complete, and those values.
COMPLETE_FIELDS = ["pcr", "pcr_status", "pathological_complete_response", "pathologic_complete_response", "pathologic_response_pcr_rd", "pcr_rd", "pcr_vs_rd", "residual_disease_pcr"]
COMPLETE, RESIDUAL = ["是", "1", "YES", "TRUE", "PCR", "POSITIVE"], ["否", "0", "NO", "FALSE", "NEGATIVE", "RD", "NON-PCR"]
COMPLETE_TEXT, RESIDUAL_TEXT = "病理完全缓解（pCR）", "未达客观缓解"


def response_text(field: str, value: Column) -> Column:
    """A value of a response field; those of fields on complete response become one of two texts where they are known."""
    if field not in COMPLETE_FIELDS:
        return value
    x = F.upper(F.trim(value))
    return F.when(x.isin(*COMPLETE), COMPLETE_TEXT).when(x.isin(*RESIDUAL), RESIDUAL_TEXT).otherwise(value)


def mapped_value(parsed: Column | str, canonical: str) -> Column:
    """The first filled value of a canonical field in a map of parsed characteristics; null where there is none.

    A field without a list of names is looked up by its own.
    """
    found = []
    for name in NAMES.get(canonical, [canonical]):
        value = F.try_element_at(T.col(parsed), F.lit(name))
        found.append(F.when(T.is_filled(value), response_text(name, value) if canonical == "treatment_response" else value))
    return F.coalesce(*found)
