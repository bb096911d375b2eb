"""Matching of columns by names, aliases, types and sampled values.

A catalogue has one row for each column: ``(column, kind, values)``, with a
bounded sample of its values.  Columns are few, so all pairs of columns of
two catalogues are scored; the tables themselves are read once for the sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .entities import plain, words
from .matching import AUTO, REVIEW, sequence_ratio

#: Values sampled of each column: those of the first rows in the order given.
SAMPLE = 32
_ID = ["id", "code", "number", "num", "key", "identifier"]
_NAME = ["name", "title", "label", "description"]
_DATE = ["date", "time", "day", "year"]
_STATUS = ["status", "state", "flag", "condition"]
_TYPE = ["type", "category", "class", "kind"]
_PLACE = ["location", "address", "street", "site", "place", "borough", "city"]
_URBAN = ["urban", "zone", "city", "town", "borough", "district"]
#: Words that stand for one another in column names.
ALIASES = {
    "id": _ID, "code": _ID, "number": _ID, "name": _NAME, "title": _NAME, "date": _DATE, "time": _DATE, "status": _STATUS, "state": _STATUS, "type": _TYPE, "category": _TYPE,
    "location": _PLACE, "address": _PLACE, "city": [*_PLACE, "urban", "zone", "town", "district"], "urban": _URBAN, "zone": _URBAN,
    "lat": ["lat", "latitude"], "latitude": ["lat", "latitude"], "lon": ["lon", "long", "longitude"], "longitude": ["lon", "long", "longitude"],
}
#: Words that compound names are made of.
PARTS = "latitude longitude address street borough district number school city site state status system code name title date year month class type category problem building block lot id key urban zone sf fac".split()
#: Whole names that mean the same, for the service matchers.
FIELD_ALIASES = {"patient_age": ["age", "age_at_diagnosis"], "her2_status": ["her2", "erbb2", "her2_ihc"], "pcr": ["pathological_complete_response", "pathologic_complete_response", "response"], "patient_id": ["subject_id", "case_id"]}
MEDICAL = ["her2", "erbb2", "pcr", "pathological_complete_response", "patient", "sample", "mutation", "gene"]


def profiled(df: DataFrame, order: str, columns: list[str] | None = None, rows: int = SAMPLE) -> DataFrame:
    """``(column, kind, values)`` from the first ``rows`` rows by ``order``; null and empty values are left out."""
    columns = columns or [c for c in df.columns]
    types = dict(df.dtypes)
    numeric = ("int", "bigint", "double", "float", "decimal", "smallint", "tinyint")
    kind = lambda t: "number" if t.startswith(numeric) else "time" if t.startswith(("date", "timestamp")) else "text"
    head = df.select(order, *(c for c in columns if c != order)).orderBy(order).limit(rows)
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.lit(kind(types[c])).alias("kind"), F.col(c).cast("string").alias("value")) for c in columns)))
    cells = head.select(F.col(order).alias("_o"), each.alias("x")).select("_o", "x.*")
    kept = F.collect_list(F.when(F.coalesce(F.col("value") != "", F.lit(False)), F.struct("_o", "value")))
    return cells.groupBy("column", "kind").agg(F.transform(F.array_sort(kept), lambda x: x["value"]).alias("values"))


def normal(c: Column | str) -> Column:
    """Folded name with underlines for all but letters and digits."""
    return F.regexp_replace(F.regexp_replace(T.fold(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def _semantic(c: Column) -> Column:
    """Words of a name and the known parts of compound ones."""
    w = words(c)
    inside = F.filter(F.array(*map(F.lit, PARTS)), lambda p: F.exists(w, lambda t: (t != p) & F.contains(t, p)))
    return F.array_union(w, inside)


def _expanded(w: Column) -> Column:
    table = F.create_map(*(x for k, vs in ALIASES.items() for x in (F.lit(k), F.array(*map(F.lit, vs)))))
    return F.array_union(w, F.flatten(F.transform(w, lambda t: F.coalesce(F.try_element_at(table, t), F.array(t)))))


def alias_similarity(a: Column, b: Column) -> Column:
    """Overlap of expanded name words over the smaller set."""
    return T.containment(_expanded(_semantic(a)), _expanded(_semantic(b)))


def value_kind(values: Column) -> Column:
    """``empty``, ``numeric``, ``address``, ``short_text`` or ``text`` of a sample of values."""
    n = F.size(values)
    share = lambda part, f: F.size(F.filter(values, f)) >= F.greatest(F.lit(1), F.floor(F.lit(part) * n + 1e-9))
    return (
        F.when(n == 0, "empty").when(share(0.8, lambda v: T.number(v).isNotNull()), "numeric")
        .when(share(0.5, lambda v: v.rlike(r"\p{Nd}")) & F.exists(values, lambda v: v.rlike(r"\p{L}")), "address")
        .when(F.forall(values, lambda v: F.size(F.filter(F.split(v, r"\s+"), lambda w: w != "")) <= 3), "short_text").otherwise("text")
    )


def compatibility(a: Column, b: Column) -> Column:
    x, y = value_kind(a), value_kind(b)
    apart = ((x == "address") & y.isin("short_text", "numeric")) | ((y == "address") & x.isin("short_text", "numeric"))
    return F.when((x == "empty") | (y == "empty") | apart, 0.0).when(x == y, 1.0).otherwise(0.25)


def value_profile(a: Column, b: Column) -> Column:
    """Overlap coefficient of folded, trimmed values."""
    clean = lambda v: F.filter(F.array_distinct(F.transform(v, lambda s: F.trim(T.fold(s)))), lambda s: s != "")
    return T.containment(clean(a), clean(b))


def overlap_profile(a: Column, b: Column) -> Column:
    """Overlap coefficient of plain values, damped where one side has fewer than four."""
    clean = lambda v: F.filter(F.array_distinct(F.transform(v, plain)), lambda s: s != "")
    x, y = clean(a), clean(b)
    return T.containment(x, y) * F.least(F.lit(1.0), F.least(F.size(x), F.size(y)) / 4.0)


def cardinality(a: Column, b: Column) -> Column:
    """One less the difference of the shares of distinct values; 0 without values."""
    share = lambda v: F.size(F.array_distinct(v)) / F.greatest(F.size(v), F.lit(1))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(share(a) - share(b))))


def _pairs(source: DataFrame, target: DataFrame) -> DataFrame:
    a = source.select(F.col("column").alias("source"), F.col("kind").alias("s_kind"), F.col("values").alias("s_values"))
    b = target.select(F.col("column").alias("target"), F.col("kind").alias("t_kind"), F.col("values").alias("t_values"))
    return a.crossJoin(F.broadcast(b))  # columns of two schemas


def _named(pairs: dict[str, list[str]], a: Column, b: Column) -> Column:
    """Whether one name is an alias of the other."""
    either = [((a == k) & b.isin(*v)) | ((b == k) & a.isin(*v)) for k, v in pairs.items()]
    out = F.lit(False)
    for e in either:
        out = out | e
    return out


def rule_score(a: Column, b: Column, x: Column, y: Column) -> Column:
    return 0.50 * T.jaccard(words(a), words(b)) + 0.35 * alias_similarity(a, b) + 0.15 * compatibility(x, y)


def profile_score(a: Column, b: Column, x: Column, y: Column) -> Column:
    return 0.25 * T.jaccard(words(a), words(b)) + 0.15 * alias_similarity(a, b) + 0.10 * compatibility(x, y) + 0.50 * overlap_profile(x, y)


def predicted(source: DataFrame, target: DataFrame, method: str = "profile") -> DataFrame:
    """``(source, target, score)``, one to one: ``exact``, ``token``, ``rule`` or ``profile``.

    A source column proposes its best target, by score and then name, if it
    reaches the threshold and, below 0.8, does not tie with the next one.  A
    target goes to its best proposer; other proposers get nothing.  ``exact``
    gives all pairs of equal names.
    """
    pairs = _pairs(source, target)
    a, b, x, y = F.col("source"), F.col("target"), F.col("s_values"), F.col("t_values")
    if method == "exact":
        return pairs.filter((plain(a) == plain(b)) & (plain(a) != "")).select("source", "target", F.lit(1.0).alias("score"))
    score = {"token": lambda: T.jaccard(words(a), words(b)), "rule": lambda: rule_score(a, b, x, y), "profile": lambda: profile_score(a, b, x, y)}[method]()
    own = Window.partitionBy("source").orderBy(F.desc("score"), "target")
    ranked = pairs.select("source", "target", F.round(score, 9).alias("score")).withColumns({"place": F.row_number().over(own), "next": F.lead("score").over(own)})
    best = ranked.filter("place = 1").filter(F.col("score") >= (0.5 if method == "token" else 0.4)).filter(~F.coalesce((F.col("score") - F.col("next") < 1e-12) & (F.col("score") < 0.8), F.lit(False)))
    turn = F.row_number().over(Window.partitionBy("target").orderBy(F.desc("score"), "source"))
    return best.withColumn("turn", turn).filter("turn = 1").select("source", "target", F.round("score", 6).alias("score"))


def match_v2(source: DataFrame, target: DataFrame) -> DataFrame:
    """Best target of each source column by .45 name ratio, .30 alias, .15 type and .10 shared values, and its decision."""
    s, t = normal("source"), normal("target")
    aliases = {k: v for k, v in FIELD_ALIASES.items() if k != "patient_id"}
    shared = T.containment(F.array_distinct("s_values"), F.array_distinct("t_values"))
    score = 0.45 * sequence_ratio(s, t) + 0.30 * _named(aliases, s, t).cast("double") + 0.15 * F.coalesce((F.col("s_kind") == F.col("t_kind")).cast("double"), F.lit(0.0)) + 0.10 * shared
    return _best(_pairs(source, target).withColumn("score", F.least(F.lit(1.0), score))).select("source", "target", F.round("score", 4).alias("score"), _decided(F.col("score"), F.lit(False)).alias("decision"))


def _best(pairs: DataFrame) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.desc(F.round("score", 4)), "target"))
    return pairs.withColumn("place", place).filter("place = 1").drop("place")


def _decided(score: Column, contradiction: Column) -> Column:
    return F.when((score >= AUTO) & ~contradiction, "AUTO").when(score >= REVIEW, "REVIEW").otherwise("REJECT")


def medical_contradiction(s: Column, t: Column) -> Column:
    return ((s == "her2_status") & (t == "erbb2_cna")) | ((s == "erbb2_cna") & (t == "her2_status")) | ((s == "response") & t.isin("auc", "ic50"))


def evidence_v3(pairs: DataFrame, source_table: str | None = None, target_table: str | None = None) -> DataFrame:
    """``pairs`` with ``score`` and ``contradiction``: the weighted mean of the evidence that is there, halved by a contradiction."""
    s, t = normal("source"), normal("target")
    pairs = pairs.withColumn("lexical", sequence_ratio(s, t))
    typed = F.coalesce((T.text("s_kind") != "") & (T.text("t_kind") != ""), F.lit(False))
    type_score = (T.fold("s_kind") == T.fold("t_kind")).cast("double")
    valued = (F.size("s_values") > 0) & (F.size("t_values") > 0)
    alias, ontology = _named(FIELD_ALIASES, s, t), s.isin(*MEDICAL) & t.isin(*MEDICAL)
    lexical = F.col("lexical")
    # a name is its own description unless one is given
    parts = [(lexical, 0.14, F.lit(True)), (lexical, 0.10, F.lit(True)), (F.lit(1.0), 0.33, alias), (value_profile(F.col("s_values"), F.col("t_values")), 0.10, valued), (cardinality(F.col("s_values"), F.col("t_values")), 0.05, valued), (type_score, 0.22, typed), (F.lit(1.0), 0.03, ontology)]
    if source_table and target_table:
        parts.append((F.when(normal(F.lit(source_table)) == normal(F.lit(target_table)), 1.0).otherwise(0.5), 0.03, F.lit(True)))
    weight = sum((F.when(there, w).otherwise(0.0) for _, w, there in parts), F.lit(0.0))
    total = sum((F.when(there, w * v).otherwise(0.0) for v, w, there in parts), F.lit(0.0))
    contradiction = (typed & (type_score == 0)) | medical_contradiction(s, t)
    score = F.least(F.lit(1.0), total / weight)
    return pairs.withColumns({"contradiction": contradiction, "score": F.when(contradiction, score / 2).otherwise(score)})


def match_v3(source: DataFrame, target: DataFrame, source_table: str | None = None, target_table: str | None = None, judge=None, margin: float = 0.08) -> DataFrame:
    """``(source, target, score, ambiguous, decision, decided_by)``: the best target of each source column.

    ``judge`` may be a function from a DataFrame of the ambiguous or doubtful
    rows to ``(source, confidence)``; it is asked about these alone, its
    confidence is clamped, and a row that it does not answer is ``REVIEW``.
    """
    scored = evidence_v3(_pairs(source, target), source_table, target_table)
    own = Window.partitionBy("source").orderBy(F.desc(F.round("score", 4)), "target")
    best = scored.withColumns({"place": F.row_number().over(own), "next": F.coalesce(F.lead(F.round("score", 4)).over(own), F.lit(0.0))}).filter("place = 1")
    ambiguous = F.round("score", 4) - F.col("next") < margin
    best = best.select("source", "target", F.round("score", 4).alias("score"), "contradiction", ambiguous.alias("ambiguous"), _decided(F.col("score"), F.col("contradiction")).alias("decision"), F.lit("algorithm").alias("decided_by"))
    if judge is not None:
        doubtful = F.col("ambiguous") | F.col("contradiction") | (F.col("decision") == "REVIEW")
        said = judge(best.filter(doubtful)).select("source", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence"))).alias("said"))
        asked = best.join(said, "source", "left").withColumn("asked", doubtful)
        best = asked.withColumns({"decision": F.when(~F.col("asked"), F.col("decision")).when(F.col("said").isNull(), "REVIEW").otherwise(_decided(F.col("said"), F.col("contradiction"))), "score": F.when(F.col("asked"), F.coalesce(F.round("said", 4), F.col("score"))).otherwise(F.col("score")), "decided_by": F.when(F.col("asked") & F.col("said").isNotNull(), "judge").otherwise("algorithm")})
    return best.select("source", "target", "score", "ambiguous", "decision", "decided_by")


def match_v2plus(source: DataFrame, target: DataFrame) -> DataFrame:
    """``match_v2`` with safety rules that may only tighten its decision: ``(source, target, score, decision, hits)``."""
    base = match_v2(source, target)
    full = _pairs(source, target).join(base.select("source", "target", F.col("score").alias("base"), "decision"), ["source", "target"])
    x = evidence_v3(full)
    s, t = normal("source"), normal("target")
    marked = F.array_compact(F.array(
        F.when(F.contains(s, F.lit("erbb2")) & s.rlike("cna|cnv|copy_number") & (t == "her2_status"), "ERBB2_CNA_NOT_IHC"),
        F.when(F.contains(s, F.lit("her2")) & F.contains(s, F.lit("ihc")) & (t == "her2_status") & F.exists("s_values", lambda v: normal(v).isin("2", "2_plus", "2plus")), "HER2_IHC_2PLUS"),
        F.when((s == "response") & t.isin("auc", "ic50", "viability"), "CROSS_DOMAIN_RESPONSE"),
        F.when(F.col("contradiction"), "SEMANTIC_CONTRADICTION"),
    ))
    x = x.withColumn("hits", marked)
    worst = F.arrays_overlap("hits", F.array(F.lit("ERBB2_CNA_NOT_IHC"), F.lit("CROSS_DOMAIN_RESPONSE")))
    decision = F.when(worst, "REJECT").when((F.size("hits") > 0) & (F.col("decision") == "AUTO"), "REVIEW").otherwise(F.col("decision"))
    return x.select("source", "target", F.col("base").alias("score"), decision.alias("decision"), "hits")


def evaluated(found: DataFrame, gold: DataFrame) -> DataFrame:
    """One row ``(tp, fp, fn, precision, recall, f1)`` of ``(source, target)`` pairs against gold ones; 0 where undefined."""
    both = found.select("source", "target").distinct().withColumn("f", F.lit(1)).join(gold.select("source", "target").distinct().withColumn("g", F.lit(1)), ["source", "target"], "full_outer")
    n = both.agg(*(F.count(F.when(c, 1)).alias(k) for k, c in (("tp", F.col("f").isNotNull() & F.col("g").isNotNull()), ("fp", F.col("g").isNull()), ("fn", F.col("f").isNull()))))
    div = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = div(F.col("tp"), F.col("tp") + F.col("fp")), div(F.col("tp"), F.col("tp") + F.col("fn"))
    return n.select("tp", "fp", "fn", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(div(2 * p * r, p + r), 6).alias("f1"))


def field_mapping(source: DataFrame, pack: DataFrame) -> DataFrame:
    """Source columns mapped onto the fields of a schema pack by ``match_v3``; rejected ones have no field."""
    m = match_v3(source, pack)
    return m.select("source", F.when(F.col("decision") != "REJECT", F.col("target")).alias("field"), "score", "decision")
