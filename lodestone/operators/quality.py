"""Rules, findings, repair policy, safe application and readiness gates.

Rules are column expressions over one record; all rules are checked in one
projection and their findings exploded, so the records are read once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: What stops a record, and what may be repaired without review.
BLOCKING = ["provenance_missing", "missing_required_field", "invalid_schema_value"]
ALLOWED = ["drug_alias", "gene_alias", "casing", "exact_duplicate"]
_RANK = {"low": 1, "medium": 2, "high": 3}


@dataclass(frozen=True)
class Rule:
    """``condition`` holds where a record is at fault; ``candidate`` is the value that would repair ``field``."""

    name: str
    kind: str
    risk: str
    field: str
    condition: Column
    candidate: Column | None = None


def required(field: str, kind: str = "missing_required_field", risk: str = "high") -> Rule:
    return Rule(f"REQUIRED_{field}", kind, risk, field, ~T.is_filled(field, "blank"))


def allowed(field: str, values: list[str], risk: str = "medium") -> list[Rule]:
    """Values outside ``values``: those that differ in case alone can be repaired."""
    right = F.try_element_at(F.create_map(*(F.lit(x) for v in values for x in (v.lower(), v))), F.lower(T.text(field)))
    x = T.text(field)
    return [
        Rule("CASING_NORMALIZATION", "casing", "low", field, ~x.isin(values) & right.isNotNull(), right),
        Rule("FROZEN_SCHEMA_ALLOWED_VALUE", "invalid_schema_value", risk, field, (x != "") & ~x.isin(values) & right.isNull()),
    ]


def in_range(field: str, low: float, high: float) -> Rule:
    x = T.number(field)
    return Rule("FROZEN_SCHEMA_RANGE", "invalid_schema_value", "medium", field, x.isNotNull() & ((x < low) | (x > high)))


def findings(records: DataFrame, rules: list[Rule], id_col: str) -> DataFrame:
    """``(id, rule, kind, risk, field, observed, candidate)`` of every rule that a record breaks."""
    items = [
        F.when(F.coalesce(r.condition, F.lit(False)), F.struct(F.lit(r.name).alias("rule"), F.lit(r.kind).alias("kind"), F.lit(r.risk).alias("risk"), F.lit(r.field).alias("field"), F.col(r.field).cast("string").alias("observed"), (r.candidate.cast("string") if r.candidate is not None else F.lit(None).cast("string")).alias("candidate")))
        for r in rules
    ]
    # a plain explode brings a filter along that would reckon every rule a second time
    return records.select(F.col(id_col).alias("id"), F.explode_outer(F.array_compact(F.array(*items))).alias("f")).filter("f is not null").select("id", "f.*")


def decide(found: DataFrame) -> DataFrame:
    """Each finding with ``BLOCK``, ``REVIEW`` or ``AUTO``.

    Blocking kinds block.  High risk goes to review, and so does anything on
    a record that has a blocking or high-risk finding.  What is left is
    repaired if its kind is allowed and it has a candidate.
    """
    guarded = F.col("kind").isin(BLOCKING) | (F.col("risk") == "high")
    ids = found.groupBy("id").agg(F.bool_or(guarded).alias("guarded"))
    joined = found.join(ids, "id")
    decision = F.when(F.col("kind").isin(BLOCKING), "BLOCK").when(F.col("guarded"), "REVIEW").when(F.col("kind").isin(ALLOWED) & F.col("candidate").isNotNull(), "AUTO").otherwise("REVIEW")
    confidence = F.when(decision == "AUTO", 0.99).when(F.col("risk") == "high", 0.82).otherwise(0.72)
    return joined.select(*found.columns, decision.alias("decision"), confidence.alias("confidence"))


def apply(records: DataFrame, decided: DataFrame, columns: list[str], id_col: str) -> DataFrame:
    """``records`` with automatic repairs, and the ``disposition`` of each.

    A cell changes only while it still has the value that was observed.
    Disposition: ``blocked`` over ``review`` over ``repaired`` over ``clean``.
    """
    auto = F.col("decision") == "AUTO"
    changes = [F.min(F.when(auto & (F.col("field") == c), F.struct("observed", "candidate"))).alias(f"_{c}") for c in columns]
    per = decided.groupBy(F.col("id").alias(id_col)).agg(F.bool_or(F.col("decision") == "BLOCK").alias("_block"), F.bool_or(F.col("decision") == "REVIEW").alias("_review"), *changes)
    return settled(records, per, columns, id_col)


def settled(records: DataFrame, per: DataFrame, columns: list[str], id_col: str, also: list[str] | None = None) -> DataFrame:
    """``records`` with what ``per(id, _block, _review, _column struct<observed, candidate>...)`` decides of each id; columns ``also`` come along."""
    joined = records.join(per, id_col, "left")
    current = lambda c: F.col(c).cast("string").eqNullSafe(F.col(f"_{c}.observed")) & F.col(f"_{c}.candidate").isNotNull()
    out = {c: F.when(current(c), F.col(f"_{c}.candidate")).otherwise(F.col(c)) for c in columns}
    touched = F.lit(False)
    for c in columns:
        touched = touched | current(c)
    disposition = F.when(F.coalesce("_block", F.lit(False)), "blocked").when(F.coalesce("_review", F.lit(False)), "review").when(touched, "repaired").otherwise("clean")
    return joined.withColumns({"disposition": disposition} | out).select(*records.columns, "disposition", *(also or []))


def roll_back(originals: DataFrame, repaired: DataFrame, rules: list[Rule], columns: list[str], id_col: str) -> DataFrame:
    """Repaired rows that still break a rule get their original values and disposition ``rolled_back``."""
    failed = findings(repaired.filter("disposition = 'repaired'"), rules, id_col).select(F.col("id").alias(id_col)).distinct().withColumn("_failed", F.lit(True))
    before = originals.select(id_col, *(F.col(c).alias(f"_{c}") for c in columns))
    joined = repaired.join(failed, id_col, "left").join(before, id_col)
    back = F.coalesce("_failed", F.lit(False))
    return joined.withColumns({c: F.when(back, F.col(f"_{c}")).otherwise(F.col(c)) for c in columns} | {"disposition": F.when(back, "rolled_back").otherwise(F.col("disposition"))}).select(*repaired.columns)


def summary(found: DataFrame) -> DataFrame:
    """``(kind, n)`` of findings."""
    return found.groupBy("kind").agg(F.count("*").alias("n"))


def review_queue(decided: DataFrame) -> DataFrame:
    """Findings that are not automatic, with a stable id; high risk first by ``priority``."""
    rank = F.create_map(*(F.lit(x) for kv in _RANK.items() for x in kv))
    return decided.filter("decision <> 'AUTO'").select(T.short_id("review", F.col("id"), F.col("rule"), F.col("field")).alias("review_id"), "id", "rule", "field", "decision", F.try_element_at(rank, F.col("risk")).alias("priority"))


def hard_gates(records: DataFrame, decided: DataFrame, id_col: str) -> DataFrame:
    """One row: records, blocked and reviewed ones, and ``NOT_READY``, ``REVIEW`` or ``READY``."""
    n = records.agg(F.count("*").alias("n_records"))
    per = decided.groupBy("id").agg(F.bool_or(F.col("decision") == "BLOCK").alias("b"), F.bool_or(F.col("decision") == "REVIEW").alias("r"))
    sums = per.agg(F.count_if("b").alias("n_blocked"), F.count_if(F.col("r") & ~F.col("b")).alias("n_review"))
    status = F.when((F.col("n_records") == 0) | (F.col("n_blocked") > 0), "NOT_READY").when(F.col("n_review") > 0, "REVIEW").otherwise("READY")
    return n.crossJoin(sums).withColumn("status", status)
