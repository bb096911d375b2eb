"""Coverage of required fields by sources, scores of sources, and covers with join rules.

``fields(field_id, canonical_name, priority)``; ``sources(dataset_id,
field_hints, granularity, authority, traceability, structuredness, cost,
access_mode, ord)`` with arrays of names.  Both are catalogues: small, and
stated; their pairs are a matrix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..shared import written


def matrix(fields: DataFrame, sources: DataFrame) -> DataFrame:
    """``(field_id, priority, dataset_id, coverage, basis)`` of every field and source.

    A declared field covers 1, a generic mutation or survival capability
    .75, a response domain 1 where there is a response, and nothing else.
    """
    x = fields.crossJoin(F.broadcast(sources.select("dataset_id", F.transform("field_hints", T.fold).alias("hints"))))  # catalogues
    f = T.fold("field_id")
    has = lambda *names: F.arrays_overlap("hints", F.array(*map(F.lit, names)))
    cases = [
        (F.array_contains("hints", f) | F.array_contains("hints", T.fold("canonical_name")), 1.0, "dataset_specific_seed_field"), (f.endswith("_mutation") & has("mutation"), 0.75, "generic_mutation_capability_requires_gene_verification"),
        (f.endswith("_variants") & has("mutation"), 0.75, "generic_mutation_capability_requires_variant_verification"), (f.isin("os_months", "dfs_months", "rfs_status") & has("survival"), 0.75, "generic_survival_capability_requires_endpoint_verification"),
        ((f == "response_domain") & has("pcr", "treatment_response"), 1.0, "deterministic_pipeline_domain_annotation"),
    ]
    share, basis = None, None
    for cond, value, name in cases:
        share = F.when(cond, value) if share is None else share.when(cond, value)
        basis = F.when(cond, name) if basis is None else basis.when(cond, name)
    return x.select("field_id", "priority", "dataset_id", share.otherwise(0.0).alias("coverage"), basis.otherwise("not_declared").alias("basis"))


def _share(cells: DataFrame, priority: str) -> DataFrame:
    return cells.filter(F.col("priority") == priority).groupBy("dataset_id").agg(F.round(F.avg("coverage"), 6).alias(priority))


def scores(cells: DataFrame, sources: DataFrame, preferred: list[str] | None = None) -> DataFrame:
    """``(dataset_id, score)``: weighted coverage, authority, traceability, granularity, structure, access, cost and preference, in 0 to 1."""
    x = sources.join(_share(cells, "required"), "dataset_id", "left").join(_share(cells, "recommended"), "dataset_id", "left")
    one = lambda c: F.coalesce(F.col(c), F.lit(1.0))  # noqa: E731  nothing asked for is covered
    granular = F.when(F.arrays_overlap("granularity", F.array(F.lit("patient"), F.lit("sample"))), 1.0).otherwise(0.4)
    liked = F.when(F.lower("dataset_id").isin(*[p.lower() for p in preferred or [""]]), 0.05).otherwise(0.0)
    total = 0.52 * one("required") + 0.10 * one("recommended") + 0.10 * F.col("authority") + 0.08 * F.col("traceability") + 0.07 * granular + 0.05 * F.col("structuredness") + 0.05 * F.when(F.col("access_mode") == "OPEN_API", 1.0).otherwise(0.5) - 0.03 * F.col("cost") + liked
    return x.select("dataset_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(total, 6))).alias("score"))


def costs(cells: DataFrame, sources: DataFrame, risk: float = 0.35, latency: float = 0.15) -> DataFrame:
    """``(dataset_id, cost)``: what is not covered, plus cost, and weighted lack of authority and structure."""
    share = cells.filter("priority = 'required'").groupBy("dataset_id").agg(F.avg("coverage").alias("c"))
    total = 1 - F.coalesce("c", F.lit(0.0)) + F.col("cost") + risk * (1 - F.least(F.lit(1.0), F.col("authority"))) + latency * (1 - F.col("structuredness"))
    return sources.join(share, "dataset_id", "left").select("dataset_id", F.round(total, 9).alias("cost"))


def join_allowed(left: Column, right: Column) -> Column:
    """Whether sources of these granularities may share a table: two patient-level ones may not without a crosswalk."""
    return ~(F.array_contains(left, "patient") & F.array_contains(right, "patient"))


#: Steps of a cover between two written states.
STEPS = 8


def _walk(cells: DataFrame, ranked: DataFrame, most: int, guarded: bool) -> DataFrame:
    """``(step, dataset_id, gain)``: down ``ranked(dataset_id, granularity, place)``, the sources that still gain required coverage.

    The first source is always taken.  A step is one aggregate over the
    sources against a state of one row: what each field has so far, and the
    place and level of the last source taken.  Where ``guarded``, a
    patient-level source does not follow another one directly.
    """
    kind = "map<string,double>"
    own = cells.filter("priority = 'required'").groupBy("dataset_id", "field_id").agg(F.max("coverage").alias("c"))
    own = own.groupBy("dataset_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field_id", "c")))).alias("own"))  # the fields of one source
    rows = written(ranked.join(own, "dataset_id", "left").select("dataset_id", "place", F.coalesce(F.array_contains("granularity", "patient"), F.lit(False)).alias("patient"), F.coalesce("own", F.create_map().cast(kind)).alias("own")), "cover")
    place = dict(rows.dtypes)["place"]
    state = cells.sparkSession.range(1).select(F.create_map().cast(kind).alias("best"), F.lit(None).cast(place).alias("last"), F.lit(False).alias("last_patient"), F.array().cast("array<struct<step:bigint,dataset_id:string,gain:double>>").alias("chosen"))
    gain = F.aggregate(F.map_entries("own"), F.lit(0.0), lambda s, e: s + F.greatest(F.lit(0.0), e["value"] - F.coalesce(F.try_element_at("best", e["key"]), F.lit(0.0))))
    for step in range(1, most + 1):
        fits = (F.size("chosen") == 0) | ((F.col("place") > F.col("last")) & (F.col("gain") > 0) & (~(F.col("last_patient") & F.col("patient")) if guarded else F.lit(True)))
        x = rows.crossJoin(F.broadcast(state)).withColumn("gain", gain)  # a state is one row
        x = x.agg(*(F.any_value(c).alias(c) for c in state.columns), F.min_by(F.struct("dataset_id", "gain", "own", "place", "patient"), F.when(fits, F.col("place"))).alias("p"))
        took = F.col("p").isNotNull()
        grown = F.map_zip_with("best", F.coalesce("p.own", F.create_map().cast(kind)), lambda k, a, b: F.greatest(F.coalesce(a, F.lit(0.0)), F.coalesce(b, F.lit(0.0))))
        state = x.select(
            grown.alias("best"), F.coalesce("p.place", "last").alias("last"), F.coalesce("p.patient", "last_patient").alias("last_patient"),
            F.when(took, F.concat("chosen", F.array(F.struct((F.size("chosen") + 1).cast("long").alias("step"), F.col("p.dataset_id").alias("dataset_id"), F.col("p.gain").alias("gain"))))).otherwise(F.col("chosen")).alias("chosen"),
        )
        state = written(state, "cover") if step % STEPS == 0 else state
    return state.select(F.explode("chosen").alias("x")).select("x.*")


def selected(cells: DataFrame, sources: DataFrame, most: int = 3, preferred: list[str] | None = None) -> DataFrame:
    """``(step, dataset_id, gain)``: sources by score that add coverage of required fields, the first always; ties by name."""
    x = scores(cells, sources, preferred).join(sources.select("dataset_id", "granularity"), "dataset_id")
    return _walk(cells, x.select("dataset_id", "granularity", F.struct((-F.col("score")).alias("s"), "dataset_id").alias("place")), most, False)


def covered(cells: DataFrame, sources: DataFrame, most: int = 3, risk: float = 0.35, latency: float = 0.15) -> DataFrame:
    """Like ``selected`` by least cost; a patient-level source never follows another one."""
    x = costs(cells, sources, risk, latency).join(sources.select("dataset_id", "granularity", "ord"), "dataset_id")
    return _walk(cells, x.select("dataset_id", "granularity", F.struct("cost", "ord").alias("place")), most, True)


def join_policies(chosen: DataFrame, sources: DataFrame) -> DataFrame:
    """``(left, right, decision)`` of every pair of chosen sources that may not be joined by patient."""
    x = chosen.join(sources.select("dataset_id", "granularity"), "dataset_id")
    a, b = (x.select(F.col("dataset_id").alias(n), F.col("step").alias(f"s_{n}"), F.col("granularity").alias(f"g_{n}")) for n in ("left", "right"))
    pairs = a.join(b, F.col("s_left") < F.col("s_right")).filter(~join_allowed(F.col("g_left"), F.col("g_right")))
    return pairs.select("left", "right", F.lit("FORBIDDEN_PATIENT_JOIN").alias("decision"))


def plan_summary(cells: DataFrame, chosen: DataFrame) -> DataFrame:
    """One row: required coverage of the first source and of all chosen ones, fields that none covers, and ``PARTIAL`` or ``READY``."""
    need = cells.filter("priority = 'required'").join(F.broadcast(chosen.select("dataset_id", "step")), "dataset_id", "left")
    per = need.groupBy("field_id").agg(F.coalesce(F.max(F.when(F.col("step") == 1, F.col("coverage"))), F.lit(0.0)).alias("a"), F.coalesce(F.max(F.when(F.col("step").isNotNull(), F.col("coverage"))), F.lit(0.0)).alias("b"))
    out = per.agg(F.round(F.coalesce(F.avg("a"), F.lit(1.0)), 6).alias("primary_coverage"), F.round(F.coalesce(F.avg("b"), F.lit(1.0)), 6).alias("portfolio_coverage"), F.count_if(F.col("b") <= 0).alias("n_uncovered"))
    return out.withColumn("status", F.when(F.col("primary_coverage") < 1, "PARTIAL").otherwise("READY"))


def usable(sources: DataFrame, excluded: list[str], statuses: tuple[str, ...] = ("planned", "disabled")) -> DataFrame:
    """``(dataset_id, usable, reason)``: sources that are neither excluded by name nor only planned."""
    out = F.when(F.lower("dataset_id").isin(*[e.lower() for e in excluded or [""]]), "excluded").when(F.lower(T.text("status")).isin(*statuses), "not_available")
    return sources.select("dataset_id", out.isNull().alias("usable"), out.alias("reason"))


def profile_scores(profiles: DataFrame, named: list[str]) -> DataFrame:
    """``(profile_id, coverage, score)`` of ``profiles(profile_id, field, live)``: rarity-weighted coverage, twice for named ones, and a bonus for live ones."""
    weight = profiles.select("profile_id", "field").distinct().groupBy("field").agg((1 / F.count("*")).alias("w"))
    total = weight.agg(F.sum("w").alias("all"))
    per = profiles.select("profile_id", "field").distinct().join(weight, "field").groupBy("profile_id").agg(F.sum("w").alias("w"))
    live = profiles.groupBy("profile_id").agg(F.bool_or("live").alias("live"))
    x = per.join(live, "profile_id").crossJoin(total).withColumn("coverage", F.round(F.col("w") / F.col("all"), 6))
    bonus = F.when(F.col("profile_id").isin(*(named or [""])), 2.0).otherwise(0.0) + F.when(F.col("live"), 0.1).otherwise(0.0)
    return x.select("profile_id", "coverage", F.round(F.col("coverage") + bonus, 6).alias("score"))


def best_dataset(candidates: DataFrame) -> DataFrame:
    """The one row of ``candidates(dataset_id, ready, target_match, coverage, n_rows)`` that is greatest in this order; ties by name."""
    return candidates.orderBy(F.desc("ready"), F.desc("target_match"), F.desc("coverage"), F.desc("n_rows"), "dataset_id").limit(1)
