"""Profiles, duplicates, conflicts, associations and readiness of tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

DIGITS = 6


def unpivot(df: DataFrame, ids: list[str], columns: list[str], name: str = "field", value: str = "value") -> DataFrame:
    """One row for each cell; values as strings."""
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias(name), F.col(c).cast("string").alias(value)) for c in columns)))
    return df.select(*ids, cells.alias("cell")).select(*ids, f"cell.{name}", f"cell.{value}")


def completeness(df: DataFrame, columns: list[str], variant: str = "exact") -> DataFrame:
    """``(field, filled, total, rate)`` of each column, in one pass over the table."""
    sums = df.agg(F.count("*").alias("total"), *(F.count_if(T.is_filled(c, variant)).alias(f"f{k}") for k, c in enumerate(columns)))
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"f{k}").alias("filled"), F.col("total")) for k, c in enumerate(columns))))
    return sums.select(rows.alias("r")).select("r.*", F.round(F.try_divide(F.col("r.filled").cast("double"), F.col("r.total")), DIGITS).alias("rate"))


def fill_rate(columns: list[str], variant: str = "trimmed") -> Column:
    """Aggregate: share of rows in which any of the columns is filled."""
    return F.avg(reduce(lambda a, b: a | b, (T.is_filled(c, variant) for c in columns)).cast("double"))


def distribution(df: DataFrame, column: str, missing: str = "<missing>", top: int | None = None) -> DataFrame:
    """``(category, n)``, most frequent first, with missing values as a category of their own."""
    out = df.groupBy(F.when(T.is_filled(column), F.col(column).cast("string")).otherwise(missing).alias("category")).agg(F.count("*").alias("n"))
    return out.orderBy(F.desc("n"), "category").limit(top) if top else out


def columns_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Type, filled cells and distinct values of each column.

    A column is numeric if 80 % of its filled cells are numbers.  Distinct
    counts are exact; each column is grouped by value.
    """
    cells = unpivot(df, [], columns).withColumn("filled", T.is_filled("value", "blank")).groupBy("field", "value", "filled").agg(F.count("*").alias("n"))
    numeric = F.when(F.col("filled") & T.loose_number("value").isNotNull(), F.col("n"))
    filled = F.when(F.col("filled"), F.col("n"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    out = cells.groupBy("field").agg(zero(filled).alias("n_filled"), F.count_if("filled").alias("n_distinct"), zero(numeric).alias("n_numeric"))
    return out.withColumn("kind", F.when(F.col("n_filled") == 0, "empty").when(10 * F.col("n_numeric") >= 8 * F.col("n_filled"), "numeric").otherwise("text"))


def funnel(df: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """``(step, name, before, after, excluded)`` of conditions applied one after another, in one pass."""
    kept, sums = F.lit(True), [F.count("*").alias("s0")]
    for k, (_, condition) in enumerate(steps):
        kept = kept & F.coalesce(condition, F.lit(False))
        sums.append(F.count_if(kept).alias(f"s{k + 1}"))
    rows = F.explode(F.array(*(F.struct(F.lit(k + 1).alias("step"), F.lit(name).alias("name"), F.col(f"s{k}").alias("before"), F.col(f"s{k + 1}").alias("after")) for k, (name, _) in enumerate(steps))))
    return df.agg(*sums).select(rows.alias("r")).select("r.*", (F.col("r.before") - F.col("r.after")).alias("excluded"))


def keep_first(df: DataFrame, key: Column, order: str, keep_blank: bool = True) -> DataFrame:
    """One row of each key, the first by ``order``; rows with a blank key all stay, or all go.

    The first row is found by an aggregate that is combined before the
    shuffle, so one key may hold any share of the rows.
    """
    keyed = df.withColumn("_key", F.when(F.trim(key.cast("string")) != "", key.cast("string")))
    names = [c for c in df.columns]
    first = keyed.filter("_key is not null").groupBy("_key").agg(F.min_by(F.struct(*names), F.col(order)).alias("row")).select("row.*")
    return first.unionByName(keyed.filter("_key is null").select(*names)) if keep_blank else first


def keep_last(df: DataFrame, key: Column, order: str) -> DataFrame:
    """One row of each key, the last by ``order``."""
    return df.groupBy(key.alias("_key")).agg(F.max_by(F.struct(*df.columns), F.col(order)).alias("row")).select("row.*")


def exact_duplicates(df: DataFrame, columns: list[str], id_col: str) -> DataFrame:
    """``(survivor, n_copies)`` of each group of two or more rows that agree in all columns."""
    content = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    return df.groupBy(content.alias("content")).agg(F.min(id_col).alias("survivor"), F.count("*").alias("n_copies")).filter("n_copies > 1").select("survivor", "n_copies")


def key_conflicts(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """Keys with two or more different values: ``(key..., n_values, least, greatest)``."""
    return df.filter(F.col(value).isNotNull()).groupBy(*key, value).count().groupBy(*key).agg(F.count("*").alias("n_values"), F.min(value).alias("least"), F.max(value).alias("greatest")).filter("n_values > 1")


def authority_conflicts(df: DataFrame, key: list[str], value: str, source: str) -> DataFrame:
    """Keys on which two or more sources give two or more values."""
    cells = df.filter(F.col(value).isNotNull()).groupBy(*key, value, source).count()
    return cells.groupBy(*key).agg(F.count_distinct(value).alias("n_values"), F.count_distinct(source).alias("n_sources")).filter("n_values > 1 and n_sources > 1")


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    """``(n, r)``: null for fewer than 3 pairs or no variance, clamped to -1 and 1."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    r = F.corr(F.col(x).cast("double"), F.col(y).cast("double"))
    valid = (F.count("*") >= 3) & (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return both.agg(F.count("*").alias("n"), F.round(F.when(valid, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))), DIGITS).alias("r"))


def cramers_v(df: DataFrame, x: str, y: str) -> DataFrame:
    """``(n, v)`` of two categorical columns, from their table of counts; null below 3 pairs or 2 categories."""
    cells = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").cast("double").alias("n"))
    rows, columns, total = cells.groupBy("x").agg(F.sum("n").alias("nx")), cells.groupBy("y").agg(F.sum("n").alias("ny")), cells.agg(F.sum("n").alias("all"), F.count_distinct("x").alias("kx"), F.count_distinct("y").alias("ky"))
    # chi squared over n: the sum of n^2 / (nx ny) over the cells that occur, less 1
    share = cells.join(rows, "x").join(columns, "y").agg(F.sum(F.col("n") * F.col("n") / (F.col("nx") * F.col("ny"))).alias("share")).crossJoin(total)
    v = F.sqrt(F.greatest(F.lit(0.0), F.col("share") - 1) / (F.least("kx", "ky") - 1))
    return share.select(F.col("all").cast("long").alias("n"), F.round(F.when((F.col("all") >= 3) & (F.col("kx") > 1) & (F.col("ky") > 1), F.least(F.lit(1.0), v)), DIGITS).alias("v"))


def stratified(df: DataFrame, strata: list[str], measures: dict[str, Column]) -> DataFrame:
    """The measures over all rows and over each stratum of each column, by grouping sets.

    Gives ``(stratum, category, measures...)``; all rows have stratum ``all``.
    """
    sets = [[], *([s] for s in strata)]
    keyed = df.withColumns({f"_{s}": F.coalesce(F.col(s).cast("string"), F.lit("<missing>")) for s in strata})
    out = keyed.groupingSets([[F.col(f"_{c}") for c in s] for s in sets], *(F.col(f"_{s}") for s in strata)).agg(*(m.alias(n) for n, m in measures.items()))
    stratum = reduce(lambda a, s: a.when(F.col(f"_{s}").isNotNull(), s), strata[1:], F.when(F.col(f"_{strata[0]}").isNotNull(), strata[0])).otherwise("all")
    return out.select(stratum.alias("stratum"), F.coalesce(*(F.col(f"_{s}") for s in strata), F.lit("all")).alias("category"), *measures)


def readiness(df: DataFrame, target: str, subject: str, columns: list[str], least_rows: int = 30, most_missing: float = 0.2) -> DataFrame:
    """One row: rows, share of missing cells, classes of the target, repeated subjects, and a status.

    ``not_ready`` without rows or target, ``review`` where a limit is broken, else ``ready``.
    """
    filled = reduce(lambda a, b: a + b, (T.is_filled(c).cast("long") for c in columns))
    one = df.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(filled), F.lit(0)).alias("filled"), F.count_distinct(target).alias("n_classes"), (F.count(subject) - F.count_distinct(subject)).alias("n_repeated"))
    missing = F.round(1 - F.try_divide(F.col("filled").cast("double"), F.col("n_rows") * len(columns)), DIGITS)
    status = F.when((F.col("n_rows") == 0) | (F.col("n_classes") == 0), "not_ready").when((F.col("n_rows") < least_rows) | (missing > most_missing) | (F.col("n_classes") < 2) | (F.col("n_repeated") > 0), "review").otherwise("ready")
    return one.select("n_rows", missing.alias("missing"), "n_classes", "n_repeated", status.alias("status"))


def gates(df: DataFrame, checks: dict[str, tuple[Column, float]]) -> DataFrame:
    """``(gate, value, verdict)``: an aggregate against the least value that passes; null and 0 reject."""
    one = df.agg(*(v.cast("double").alias(n) for n, (v, _) in checks.items()))
    rows = F.explode(F.array(*(F.struct(F.lit(n).alias("gate"), F.round(F.col(n), DIGITS).alias("value"), F.lit(float(least)).alias("least")) for n, (_, least) in checks.items())))
    x = one.select(rows.alias("r")).select("r.*")
    return x.select("gate", "value", F.when(F.coalesce("value", F.lit(0.0)) <= 0, "REJECT").when(F.col("value") < F.col("least"), "REVIEW").otherwise("PASS").alias("verdict"))


def clean_observations(df: DataFrame, group: list[str], value: str, order: str) -> DataFrame:
    """Every observation as ``accepted``, ``duplicate`` or ``review``.

    Rows that repeat all of a group's fields and value are duplicates of the
    first by ``order``.  Of the others, those whose group holds different
    values, and zero or missing values, go to review.  All rows stay, so the
    parts add up to the input.
    """
    keep = df.groupBy(*group, value).agg(F.min(order).alias("first"))
    sizes = keep.groupBy(*group).agg(F.count("*").alias("n_values"))
    same = lambda a, b, cs: reduce(lambda x, y: x & y, (a[c].eqNullSafe(b[c]) for c in cs))
    rows, k, s = df.alias("r"), keep.alias("k"), sizes.alias("s")
    joined = rows.join(k, reduce(lambda x, y: x & y, (F.col(f"r.{c}").eqNullSafe(F.col(f"k.{c}")) for c in [*group, value]))).join(s, reduce(lambda x, y: x & y, (F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in group)))
    status = F.when(F.col(f"r.{order}") != F.col("k.first"), "duplicate").when((F.col("s.n_values") > 1) | F.col(f"r.{value}").isNull() | (F.col(f"r.{value}") == 0), "review").otherwise("accepted")
    return joined.select("r.*", status.alias("status"))


def coalesced_dedup(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row by ``order`` of each key, the first filled of ``keys`` folded; rows without any stay."""
    name = lambda c: F.when(F.trim(T.text(c)) != "", F.concat(F.lit(f"{c}:"), F.trim(T.fold(c))))
    keyed = df.withColumn("_key", F.coalesce(*(name(c) for c in keys)))
    first = keyed.filter("_key is not null").groupBy("_key").agg(F.min(order).alias(order))
    kept = keyed.join(first, ["_key", order], "left_semi")
    return kept.unionByName(keyed.filter("_key is null")).select(*df.columns)


def distinct_rows(df: DataFrame, identity: list[str], order: str) -> DataFrame:
    """The first row by ``order`` of each folded identity, its columns put together by ``|``."""
    key = F.concat_ws("|", *(T.fold(c) for c in identity))
    first = df.groupBy(key.alias("_key")).agg(F.min(order).alias("_first"))
    return df.join(first, (key == F.col("_key")) & (F.col(order) == F.col("_first"))).select(*df.columns)
