"""Raw records with nested fields mapped onto canonical ones, with their context, issues and evidence.

Records are ``(record_id, source_id, authority, default_confidence, fields)``
with ``fields`` as JSON text.  Mapping rules are few and known when the plan
is made, so all of them are one projection over a record.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normalise as N
from ..functions import text as T
from ..shared import dealt
from .linking import evidence_id

#: Fields that all observations of a record share, and measures that belong to cell lines only.
CONTEXT = ["study_id", "patient_id", "sample_id", "disease", "response_domain", "response_type"]
PRECLINICAL = ["auc", "ic50", "viability"]
RESPONSE = ["response", "response_type", "response_domain"]


@dataclass(frozen=True)
class Rule:
    """One mapping: a dotted raw field onto a canonical field through a normaliser."""

    mapping_id: str
    raw_field: str
    canonical_field: str
    normaliser: str = "passthrough"
    confidence: float = 1.0
    source_id: str | None = None
    response_domain: str | None = None
    response_type: str | None = None


def _path(raw_field: str) -> str:
    return "$" + "".join(f'["{p}"]' for p in raw_field.split("."))


def shown(found: Column) -> Column:
    """A variant as text: text as it is, null for a JSON null, else canonical JSON."""
    kind = F.schema_of_variant(found)
    return F.when(kind == "STRING", F.try_variant_get(found, "$", "string")).when(kind != "VOID", F.to_json(found))


def _from_value(field: str, x: Column) -> Column:
    return N.fields(N._values(**{field: x["value"]}), x["method"], x["confidence"], x["status"])


def normalised(rule: Rule, value: Column) -> Column:
    """The rule's normaliser on a value: ``(values, method, confidence, status)``."""
    if rule.normaliser == "gene":
        return T.bound(N.gene(value), lambda x: _from_value("gene", x))
    if rule.normaliser == "drug":
        return T.bound(N.drug(value), lambda x: _from_value("drug", x))
    if rule.normaliser == "biomarker":
        return N.biomarker(rule.raw_field, value, rule.canonical_field)
    if rule.normaliser == "mutation_status":
        return N.mutation_status(value)
    if rule.normaliser == "response_domain":
        return N.response_domain(value)
    blank = F.trim(T.text(value)) == ""
    same = N.fields(N._values(**{rule.canonical_field: value}), "schema_passthrough_v1", 1.0, "identity")
    return F.when(blank, N.fields(F.create_map().cast("map<string,string>"), "schema_passthrough_v1", 0.0, "unresolved")).otherwise(same)


def _gives(rule: Rule) -> str | None:
    """The field of ``CONTEXT`` that a rule's value can have."""
    if rule.normaliser in ("gene", "drug", "biomarker", "mutation_status"):
        return None
    field = "response_domain" if rule.normaliser == "response_domain" else rule.canonical_field
    return field if field in CONTEXT else None


def attempts(records: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row for each record and rule that applies to its source: ``found, raw_value, values, method, confidence, status``.

    Beside them stand what all rows of the record have in common (``context,
    conflicts, missing, blocked``; see ``contexts``), ``lead`` at one row of
    each record id, and ``alone`` where no other row can have the same
    evidence.  Records are dealt by id once; every value is reckoned once for
    each record, in steps that the optimiser keeps apart.
    """
    lit = lambda x: F.lit(x).cast("string")
    applies = [F.lit(True) if r.source_id is None else F.coalesce(F.col("source_id") == F.lit(r.source_id), F.lit(False)) for r in rules]
    x = records if any(r.source_id is None for r in rules) else records.filter(F.col("source_id").isin(*(r.source_id for r in rules)))
    x = dealt(x, "record_id").sortWithinPartitions("record_id").withColumn("_v", F.try_parse_json("fields"))
    x = x.withColumns({f"_f{n}": F.try_variant_get("_v", _path(r.raw_field), "variant") for n, r in enumerate(rules)})
    x = x.withColumns({f"_x{n}": shown(F.col(f"_f{n}")) for n in range(len(rules))})
    values = {n: normalised(r, F.col(f"_x{n}")) for n, r in enumerate(rules)}
    of = {c: [n for n, r in enumerate(rules) if _gives(r) == c] for c in CONTEXT}
    early = {n for ns in of.values() for n in ns}
    x = x.withColumns({f"_n{n}": values[n] for n in sorted(early)})
    same = Window.partitionBy("record_id")
    said = {c: F.array(*(F.when(applies[n] & F.col(f"_f{n}").isNotNull() & F.col("record_id").isNotNull(), F.try_element_at(F.col(f"_n{n}")["values"], F.lit(c))) for n in ns), lit(None)) for c, ns in of.items()}
    x = x.withColumns({f"_{c}_{name}": within(ends(said[c])).over(same) if ns else lit(None) for c, ns in of.items() for name, within, ends in (("low", F.min, F.array_min), ("high", F.max, F.array_max))} | {"_rows": F.count("*").over(same), "_row": F.row_number().over(same.orderBy("record_id"))})
    low, high = lambda c: F.col(f"_{c}_low"), lambda c: F.col(f"_{c}_high")
    context = F.map_filter(F.create_map(*(e for c in CONTEXT for e in (F.lit(c), F.when(low(c) == high(c), low(c))))), lambda k, v: v.isNotNull())
    missing = F.array_compact(F.array(*(F.when(~F.coalesce(low(c) == high(c), F.lit(False)), c) for c in ("study_id", "disease"))))
    against = F.array_compact(F.array(*(F.when(low(c) != high(c), c) for c in CONTEXT)))
    x = x.withColumns({"context": context, "conflicts": against, "missing": missing}).withColumn("blocked", (F.size("missing") > 0) | (F.size("conflicts") > 0))
    x = x.withColumns({f"_n{n}": v for n, v in values.items() if n not in early})
    rows = []
    for n, r in enumerate(rules):
        clear = "|" not in r.mapping_id + r.raw_field and sum((o.mapping_id, o.raw_field) == (r.mapping_id, r.raw_field) for o in rules) == 1
        row = F.struct(lit(r.mapping_id).alias("mapping_id"), lit(r.raw_field).alias("raw_field"), lit(r.response_domain).alias("rule_domain"), lit(r.response_type).alias("rule_type"), F.lit(float(r.confidence)).alias("rule_confidence"), F.col(f"_f{n}").isNotNull().alias("found"), F.col(f"_x{n}").alias("raw_value"), F.col(f"_n{n}").alias("n"), F.lit(clear).alias("clear"))
        rows.append(F.when(applies[n], row))
    first, alone = F.col("_row") == 1, (F.col("_rows") == 1) & ~F.coalesce(F.contains(F.col("record_id").cast("string"), F.lit("|")), F.lit(True))
    each = x.withColumns({"_first": first, "_alone": alone}).select("record_id", "source_id", "authority", "default_confidence", "context", "conflicts", "missing", "blocked", "_first", "_alone", F.posexplode_outer(F.array_compact(F.array(*rows))).alias("_p", "a")).filter("_p is not null")
    return each.select(
        "record_id", "source_id", "authority", "default_confidence", "a.mapping_id", "a.raw_field", "a.rule_domain", "a.rule_type", "a.rule_confidence", "a.found", "a.raw_value", "a.n.values", "a.n.method", F.col("a.n.confidence").alias("confidence"), F.col("a.n.status").alias("status"),
        "context", "conflicts", "missing", "blocked", (F.col("_first") & (F.col("_p") == 0)).alias("lead"), (F.col("_alone") & F.col("a.clear")).alias("alone"),
    )


def contexts(tried: DataFrame) -> DataFrame:
    """``(record_id, context, conflicts, missing, blocked)``: the shared fields of each record.

    A field with two different values is a conflict; a record with a conflict
    or without ``study_id`` or ``disease`` is blocked.
    """
    return tried.filter("lead").select("record_id", "context", "conflicts", "missing", "blocked")


def _safe(tried: DataFrame) -> DataFrame:
    """``tried`` with ``domain``, ``kind`` and ``unsafe`` of what a row says of a response."""
    touches = F.col("_touches")
    of = lambda c: F.coalesce(F.try_element_at("values", F.lit(c)), F.try_element_at("context", F.lit(c)))
    x = tried.withColumn("_touches", F.arrays_overlap(F.map_keys("values"), F.array(*map(F.lit, RESPONSE))))
    x = x.withColumns({"domain": F.when(touches, F.coalesce("rule_domain", of("response_domain"))), "kind": F.when(touches, F.coalesce("rule_type", of("response_type")))})
    measure = F.lower(F.concat_ws(" ", "raw_field", "kind")).rlike("|".join(rf"\b{m}\b" for m in PRECLINICAL))
    unsafe = F.when(touches & F.col("domain").isNull() & F.map_contains_key("values", F.lit("response")), "response_domain_missing").when(touches & measure & ~F.coalesce(F.col("domain") == "preclinical_cell_line", F.lit(False)), "cross_domain_response")
    return x.withColumn("unsafe", unsafe)


#: Rows of attempts that become records.
_KEPT = "found and not blocked and size(values) > 0"


def mapped(tried: DataFrame) -> DataFrame:
    """Atomic canonical records of records that are not blocked.

    ``(record_id, mapped_id, source_id, authority, raw_field, raw_value,
    method, status, confidence, record, mapped_fields, unsafe, alone)``; ``record``
    is a map of canonical fields.  ``unsafe`` names a response without domain
    or a cell-line measure outside cell lines; such rows are no records and
    are kept apart by it.  Confidence is the least of record, rule and value.
    """
    x = _safe(tried.filter(_KEPT))
    x = x.withColumn("_extra", F.map_filter(F.create_map(F.lit("response_domain"), F.col("domain"), F.lit("response_type"), F.col("kind")), lambda k, v: v.isNotNull()))
    x = x.withColumn("_own", F.map_concat(F.map_filter("values", lambda k, v: ~F.map_contains_key("_extra", k)), "_extra"))
    shared = F.map_filter("context", lambda k, v: k.isin("study_id", "patient_id", "sample_id", "disease") & ~F.map_contains_key("_own", k))
    said = F.array_union(F.map_keys("values"), F.array_compact(F.array(F.when(F.col("rule_domain").isNotNull(), "response_domain"), F.when(F.col("rule_type").isNotNull(), "response_type"))))
    x = x.withColumns({"record": F.map_concat(shared, "_own"), "said": said})
    mapped_id = T.short_id("mapped", F.col("record_id"), F.col("mapping_id"), F.col("raw_field"), F.coalesce("raw_value", F.lit("null")))
    return x.select("record_id", mapped_id.alias("mapped_id"), "source_id", "authority", "raw_field", "raw_value", "method", "status", F.least("default_confidence", "rule_confidence", "confidence").alias("confidence"), "record", F.array_sort(F.filter("said", lambda k: F.map_contains_key(F.col("record"), k))).alias("mapped_fields"), "unsafe", "alone")


def issues(tried: DataFrame) -> DataFrame:
    """``(record_id, mapping_id, code, field)``: missing raw fields, values in review, and what blocks a record."""
    one = lambda field, code, mapping: F.struct(mapping.alias("mapping_id"), F.lit(code).alias("code"), field.alias("field"))
    mine, none = lambda code: one(F.col("raw_field"), code, F.col("mapping_id")), F.lit(None).cast("string")
    kept = F.expr(_KEPT) & F.col("unsafe").isNotNull()
    own = F.array_compact(F.array(F.when(~F.col("found"), mine("raw_field_missing")), F.when(F.col("found") & F.col("status").isin("review", "unresolved"), mine("normalization_review")), F.when(kept, one(F.col("raw_field"), "unsafe_response_domain", none))))
    shared = lambda column, code: F.when(F.col("lead"), F.transform(column, lambda f: one(f, code, none))).otherwise(F.slice(F.transform(column, lambda f: one(f, code, none)), 1, 0))
    every = F.concat(own, shared("conflicts", "context_conflict"), shared("missing", "missing_required_context"))
    return _safe(tried).select("record_id", F.explode_outer(every).alias("i")).filter("i is not null").select("record_id", "i.mapping_id", "i.code", "i.field")


def identities(tried: DataFrame) -> DataFrame:
    """``(id, study, patient, sample)`` of the records that are not blocked, for linking."""
    c = contexts(tried).filter("not blocked")
    get = lambda k: F.try_element_at("context", F.lit(k))
    return c.select(F.col("record_id").alias("id"), get("study_id").alias("study"), get("patient_id").alias("patient"), get("sample_id").alias("sample"))


def evidence(records: DataFrame) -> DataFrame:
    """One evidence cell for each mapped field of ``mapped`` records, each id once.

    Only rows that are not ``alone`` can share an id, and only these are dealt by it.
    """
    if "alone" not in records.columns:
        return _cells(records).dropDuplicates(["evidence_id"])
    return _cells(records.filter("alone")).unionByName(_cells(records.filter("not alone")).dropDuplicates(["evidence_id"]))


def _cells(records: DataFrame) -> DataFrame:
    # a filter, and the one that a plain explode brings along, would be reckoned below all steps of `mapped` with their expressions put into each other
    each = records.withColumn("field", F.explode_outer(F.when(F.col("unsafe").isNull(), F.col("mapped_fields")))).filter("field is not null").withColumn("value", F.try_element_at("record", F.col("field")))
    status = F.when(F.col("status").isin("normalized", "identity"), "verified").otherwise("review")
    get = lambda k: F.try_element_at("record", F.lit(k))
    return each.select(evidence_id(F.col("mapped_id"), F.col("field"), F.col("value")).alias("evidence_id"), get("patient_id").alias("patient_id"), get("sample_id").alias("sample_id"), "field", F.col("value").alias("canonical_value"), "raw_field", "raw_value", "source_id", F.col("method").alias("normalization_method"), "confidence", status.alias("status"))


def valid_rule(rule: Rule) -> bool:
    """Whether the normaliser fits the canonical field."""
    fits = {"gene": ("gene",), "drug": ("drug", "treatment"), "mutation_status": ("mutation_status",), "response_domain": ("response_domain",), "biomarker": ("her2_status", "er_status", "pr_status", "her2_raw_value", "her2_assay")}
    return bool(re.fullmatch(r"[^.]+(\.[^.]+)*", rule.raw_field)) and rule.canonical_field in fits.get(rule.normaliser, (rule.canonical_field,))
