"""Exact identity links, their connected components, and merging without guesses.

Identities are rows ``(id, study, patient, sample)``.  Rows link only inside
one study; ``None`` and blank names never link.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..shared import written


def _name(c: str) -> Column:
    return F.when(F.trim(F.col(c).cast("string")) != "", F.trim(F.col(c).cast("string")))


def star_links(ids: DataFrame, scope: str) -> DataFrame:
    """``(left, right)``: each row of a (study, ``scope``) group with the group's least id.

    Stars join the same rows as all pairs would, with one link for each row.
    """
    named = ids.select("id", "study", _name(scope).alias("name")).filter("name is not null and study is not null")
    hub = named.groupBy("study", "name").agg(F.min("id").alias("left"))
    return named.join(hub, ["study", "name"]).filter("id <> left").select("left", F.col("id").alias("right"))


def decisions(ids: DataFrame) -> DataFrame:
    """``(study, scope, name, n_rows, n_patients, decision, auto_merge)`` of each group of rows that share a name.

    The same sample with different patients is ``REJECTED``.  The same sample
    otherwise is ``LINKED`` and merges.  The same patient is ``LINKED`` and
    merges where no row has a sample, else ``LINKED_PATIENT_ONLY``.
    """
    x = ids.select("id", "study", _name("patient").alias("patient"), _name("sample").alias("sample")).filter("study is not null")
    by_sample = x.filter("sample is not null").groupBy("study", F.lit("sample").alias("scope"), F.col("sample").alias("name")).agg(F.count("*").alias("n_rows"), F.count_distinct("patient").alias("n_patients"), F.count("sample").alias("n_samples"))
    by_patient = x.filter("patient is not null").groupBy("study", F.lit("patient").alias("scope"), F.col("patient").alias("name")).agg(F.count("*").alias("n_rows"), F.lit(1).cast("long").alias("n_patients"), F.count("sample").alias("n_samples"))
    both = by_sample.unionByName(by_patient).filter("n_rows > 1")
    decision = F.when(F.col("n_patients") > 1, "REJECTED").when((F.col("scope") == "sample") | (F.col("n_samples") == 0), "LINKED").otherwise("LINKED_PATIENT_ONLY")
    return both.select("study", "scope", "name", "n_rows", "n_patients", decision.alias("decision"), (decision == "LINKED").alias("auto_merge"))


def candidate_decision(score: Column, same_study: Column, contradiction: Column, patient_scope: Column, has_sample: Column, automatic: float = 0.9) -> tuple[Column, Column]:
    """Decision and merge flag of a scored pair: other studies and contradictions reject, low scores stay open."""
    decision = F.when(~same_study | contradiction, "REJECTED").when(score < automatic, "UNRESOLVED").when(patient_scope & has_sample, "LINKED_PATIENT_ONLY").otherwise("LINKED")
    return decision, decision == "LINKED"


def pair_decision() -> Column:
    """What the identities of ``l_*`` and ``r_*`` say about a pair: ``(scope, method, status, auto_merge)``, null for nothing."""
    patient = F.col("l_patient") == F.col("r_patient")
    sample = F.coalesce(F.col("l_sample") == F.col("r_sample"), F.lit(False))
    said = lambda scope, method, status, merge: F.struct(F.lit(scope).alias("scope"), F.lit(method).alias("method"), status.alias("status"), merge.alias("auto_merge"))
    alone = F.col("l_sample").isNull() & F.col("r_sample").isNull()
    return F.when(F.col("l_study") == F.col("r_study"), (
        F.when(sample & F.coalesce(~patient, F.lit(False)), said("sample", "identifier_contradiction_v1", F.lit("REJECTED"), F.lit(False)))
        .when(sample, said("sample", "exact_study_sample_id_v1", F.lit("LINKED"), F.lit(True)))
        .when(F.coalesce(patient, F.lit(False)), said("patient", "exact_study_patient_id_v1", F.when(alone, "LINKED").otherwise("LINKED_PATIENT_ONLY"), alone))
    ))


def _identified(ids: DataFrame) -> DataFrame:
    return ids.select("id", F.col("study").cast("string").alias("study"), _name("patient").alias("patient"), _name("sample").alias("sample"))


def identity_classes(ids: DataFrame) -> DataFrame:
    """``(id, class_id)``: rows of equal study, patient and sample are one class, named by its least id; rows without names are alone."""
    x = _identified(ids)
    named = x.filter("study is not null and (patient is not null or sample is not null)")
    least = named.groupBy("study", "patient", "sample").agg(F.min("id").alias("class_id"))
    met = named.alias("a").join(least.alias("b"), (F.col("a.study") == F.col("b.study")) & F.col("a.patient").eqNullSafe(F.col("b.patient")) & F.col("a.sample").eqNullSafe(F.col("b.sample")))
    return x.select("id").join(met.select("a.id", "class_id"), "id", "left").select("id", F.coalesce("class_id", "id").alias("class_id"))


def class_decisions(ids: DataFrame) -> DataFrame:
    """Decisions between the classes of ``identity_classes`` that share a sample or a patient, by pair.

    ``(left, right, scope, method, status, auto_merge, link_id)``.  Rows of
    one class are linked with one another (its decision with itself would be
    ``LINKED``), so every pair of rows has its decision here or inside a
    class.  Its rows grow with the different identities of a name, not with
    the rows that bear it.
    """
    classes = _identified(ids).join(identity_classes(ids).filter("id = class_id").select("id"), "id", "left_semi")
    side = lambda p: classes.select(*(F.col(c).alias(f"{p}_{c}") for c in ("id", "study", "patient", "sample")))
    a, b = side("l"), side("r")
    by = lambda c: a.join(b, (F.col("l_study") == F.col("r_study")) & (F.col(f"l_{c}") == F.col(f"r_{c}")) & (F.col("l_id") < F.col("r_id")))
    pairs = by("sample").union(by("patient").filter("not (l_sample <=> r_sample) or l_sample is null"))
    return _as_links(pairs.withColumn("d", pair_decision()), F.lit(1.0))


def _as_links(pairs: DataFrame, confidence: Column) -> DataFrame:
    left, right = F.least(F.col("l_id").cast("string"), F.col("r_id").cast("string")), F.greatest(F.col("l_id").cast("string"), F.col("r_id").cast("string"))
    return pairs.select(left.alias("left"), right.alias("right"), "d.scope", "d.method", "d.status", "d.auto_merge", confidence.alias("confidence"), T.short_id("link", left, right, F.col("d.scope"), F.col("d.method")).alias("link_id"))


def candidate_links(ids: DataFrame, candidates: DataFrame, automatic: float = 0.9) -> DataFrame:
    """Decisions on ``candidates(left, right, scope, confidence)``; what exact identities say comes first.

    A candidate that names an unknown row is an error when it is read.
    """
    x = _identified(ids)
    side = lambda p: x.select(F.col("id").alias(f"{p}_id"), *(F.col(c).alias(f"{p}_{c}") for c in ("study", "patient", "sample")), F.lit(True).alias(f"{p}_there"))
    met = candidates.select(F.col("left").alias("l_id"), F.col("right").alias("r_id"), F.lower("scope").alias("scope"), "confidence").join(side("l"), "l_id", "left").join(side("r"), "r_id", "left")
    apart = lambda c: F.coalesce(F.col(f"l_{c}") != F.col(f"r_{c}"), F.lit(False))
    against = apart("patient") | ((F.col("scope") == "sample") & apart("sample"))
    same_study = F.coalesce(F.col("l_study") == F.col("r_study"), F.lit(False))
    has_sample = F.col("l_sample").isNotNull() | F.col("r_sample").isNotNull()
    status, merge = candidate_decision(F.col("confidence"), same_study, against, F.col("scope") == "patient", has_sample, automatic)
    method = F.when(~same_study, "candidate_rejected_v1").when(against, "candidate_identifier_contradiction_v1").when(F.col("confidence") < automatic, "candidate_confidence_gate_v1").otherwise("high_confidence_candidate_v1")
    scored = F.struct(F.col("scope"), method.alias("method"), status.alias("status"), merge.alias("auto_merge"))
    known = F.when(F.col("l_there").isNull() | F.col("r_there").isNull(), F.raise_error(F.lit("a link candidate names a row that is not there"))).otherwise(F.coalesce(pair_decision(), scored))
    return _as_links(met.withColumn("d", known), F.when(pair_decision().isNotNull(), 1.0).otherwise(F.col("confidence")))


def merge_links(ids: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """``(left, right)`` links that may merge: the same components as all pairs with ``auto_merge``, one or two links a row.

    Rows of a class with a sample, or without any sample, form a star.  In a
    (study, sample) the rows without a patient link with every class; classes
    of different patients link through them only.
    """
    x = _identified(ids).filter("study is not null")
    star = x.join(identity_classes(ids), "id").filter("sample is not null or patient is not null").filter("id <> class_id").select(F.col("class_id").alias("left"), F.col("id").alias("right"))
    open_ = x.filter("sample is not null and patient is null").groupBy("study", "sample").agg(F.min("id").alias("left"))
    bridge = x.filter("sample is not null and patient is not null").join(open_, ["study", "sample"]).select("left", F.col("id").alias("right"))
    links = star.union(bridge)
    if candidates is not None:
        kind = dict(ids.dtypes)["id"]
        links = links.union(candidate_links(ids, candidates).filter("auto_merge").select(F.col("left").cast(kind), F.col("right").cast(kind)))
    return links.distinct()


def entities(ids: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """``(id, root, entity_key)`` of every row: decisions, components over links that may merge, and keys, as one chain."""
    roots = components(merge_links(ids, candidates))
    members = ids.select("id").distinct().join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("root"))
    return members.join(summed_keys(members).select("root", "entity_key"), "root").select("id", "root", "entity_key")


def components(links: DataFrame) -> DataFrame:
    """``(id, root)`` of every end of ``links(left, right)``; the root is the least id of the component.

    Large-star and small-star rounds: each round sends every node to the
    least id around it, so that the number of rounds grows with the logarithm
    of the longest path.  Rounds are written out and no round holds a node's
    neighbours together.
    """
    edges = written(links.select(F.greatest("left", "right").alias("a"), F.least("left", "right").alias("b")).filter("a <> b").distinct(), "edges")
    nodes = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()
    while True:
        both = edges.union(edges.select(F.col("b"), F.col("a"))).toDF("a", "b")
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.filter("a <> b").distinct(), "large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        new = written(small.filter("a <> b").distinct(), "small")
        if new.exceptAll(edges).limit(1).count() + edges.exceptAll(new).limit(1).count() == 0:
            break
        edges = new
    return nodes.join(edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("root")), "id", "left").select("id", F.coalesce("root", "id").alias("root"))


def entity_keys(members: DataFrame) -> DataFrame:
    """``(root, entity_key, n_members)`` from a digest of the sorted member ids, which are put together in one row."""
    listed = members.groupBy("root").agg(F.array_sort(F.collect_set(F.col("id").cast("string"))).alias("ids"))
    return listed.select("root", T.short_id("entity", F.array_join("ids", "|")).alias("entity_key"), F.size("ids").cast("long").alias("n_members"))


def summed_keys(members: DataFrame) -> DataFrame:
    """Like ``entity_keys`` for components of any size: no task holds the members of one.

    The key is a digest of the root, the number of members and two sums of
    their 64-bit hashes, which combine before they are shuffled; it changes
    with any member, and is another string than that of ``entity_keys``.
    """
    name = F.col("id").cast("string")
    total = lambda seed: F.sum(F.xxhash64(F.lit(seed), name).cast("decimal(38,0)")).cast("string")
    sums = members.select("root", "id").distinct().groupBy("root").agg(F.count("*").alias("n_members"), total("a").alias("a"), total("b").alias("b"))
    return sums.select("root", T.short_id("entity", F.col("root"), F.col("n_members"), F.col("a"), F.col("b")).alias("entity_key"), "n_members")


def merge(observations: DataFrame, order: str = "ord") -> DataFrame:
    """One row for each ``(entity, field)`` of ``(entity, field, value, status, ord)``.

    Two or more values are a conflict: ``unresolved`` and no value.  One
    value with an observation in review is ``review``, else ``resolved``.
    """
    one = observations.groupBy("entity", "field").agg(F.count_distinct("value").alias("n_values"), F.min_by("value", F.col(order)).alias("first"), F.bool_or(F.col("status").isin("review", "unresolved")).alias("open"))
    status = F.when(F.col("n_values") > 1, "unresolved").when(F.col("open"), "review").otherwise("resolved")
    return one.select("entity", "field", "n_values", status.alias("status"), F.when(F.col("n_values") <= 1, F.col("first")).alias("value"))


#: The columns that tell apart observations of a field.
DIMENSIONS = {
    "her2_status": [("assay", "her2_assay")], "her2_raw_value": [("assay", "her2_assay")], "her2_assay": [("assay", "her2_assay")],
    "response": [("domain", "response_domain"), ("type", "response_type")], "response_type": [("domain", "response_domain"), ("type", "response_type")], "response_domain": [("domain", "response_domain"), ("type", "response_type")],
    "variant": [("gene", "gene"), ("variant", "variant")], "mutation_status": [("gene", "gene"), ("variant", "variant")], "gene": [("gene", "gene")], "drug": [("drug", "drug")], "treatment": [("treatment", "treatment")],
}


def dimension(field: Column, record: Column) -> Column:
    """What an observation of ``field`` of a record (a map) is comparable within; ``default`` for most fields."""
    value = lambda c: F.coalesce(F.when(F.try_element_at(record, F.lit(c)) != "", F.try_element_at(record, F.lit(c))), F.lit("Unknown"))
    out = None
    for name, parts in DIMENSIONS.items():
        said = F.concat_ws(";", *(F.concat(F.lit(f"{n}="), value(c)) for n, c in parts))
        out = F.when(field == name, said) if out is None else out.when(field == name, said)
    return out.otherwise("default")


def observations(mapped: DataFrame, members: DataFrame) -> DataFrame:
    """One row for each mapped field of ``mapped(record_id, mapped_id, source_id, authority, status, record, mapped_fields)``, by entity."""
    each = mapped.join(members.select(F.col("id").alias("record_id"), F.col("entity_key").alias("entity")), "record_id").withColumn("field", F.explode("mapped_fields"))
    each = each.withColumns({"dimension": dimension(F.col("field"), F.col("record")), "value": F.try_element_at("record", F.col("field"))})
    return each.select("entity", F.concat_ws("|", "field", "dimension").alias("semantic_key"), "field", "dimension", "value", evidence_id(F.col("mapped_id"), F.col("field"), F.col("value")).alias("evidence_id"), "source_id", "authority", "status", F.col("mapped_id").alias("ord"))


def evidence_id(mapped_id: Column, field: Column, value: Column) -> Column:
    return T.short_id("evidence", mapped_id, field, F.coalesce(value, F.lit("null")))


def conflicts(observed: DataFrame) -> DataFrame:
    """``(entity, semantic_key, field, dimension, n_values, least, greatest, n_sources, high_authority, conflict_id)`` of disagreeing observations.

    A high-authority conflict needs two values and two sources among sources
    of high authority.  Lists of evidence stay in ``observed``, by key.
    """
    high = F.col("authority") == "high"
    one = observed.groupBy("entity", "semantic_key", "field", "dimension").agg(
        F.count_distinct("value").alias("n_values"), F.min("value").alias("least"), F.max("value").alias("greatest"), F.count_distinct("source_id").alias("n_sources"),
        F.count_distinct(F.when(high, F.col("value"))).alias("high_values"), F.count_distinct(F.when(high, F.col("source_id"))).alias("high_sources"),
    )
    return one.filter("n_values > 1").select("entity", "semantic_key", "field", "dimension", "n_values", "least", "greatest", "n_sources", ((F.col("high_values") > 1) & (F.col("high_sources") > 1)).alias("high_authority"), T.short_id("conflict", F.col("entity"), F.col("semantic_key"), F.col("least"), F.col("greatest")).alias("conflict_id"))


def record_status(merged: DataFrame) -> DataFrame:
    """Status of each entity: a conflict, then anything open, else merged."""
    worst = F.when(F.bool_or(F.col("status") == "unresolved"), "unresolved").when(F.bool_or(F.col("status") == "review"), "review").otherwise("merged")
    return merged.groupBy("entity").agg(F.count("*").alias("n_fields"), worst.alias("status"))


def match_to_owner(rows: DataFrame, owners: DataFrame, sample: str, patient: str, owner: str) -> DataFrame:
    """``rows`` with ``owner`` by sample, else by a patient that has exactly one owner, else null."""
    by_sample = owners.filter(F.col(sample).isNotNull()).groupBy(sample).agg(F.min(owner).alias("_s"))
    by_patient = owners.filter(F.col(patient).isNotNull()).groupBy(patient).agg(F.min(owner).alias("_p"), F.count_distinct(owner).alias("_n")).filter("_n = 1").drop("_n")
    return rows.join(by_sample, sample, "left").join(by_patient, patient, "left").withColumn(owner, F.coalesce("_s", "_p")).drop("_s", "_p")
