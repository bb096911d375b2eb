"""Conservative repairs of cells, each from evidence that the table itself holds.

Every pass profiles the dirty table, not the result of the pass before, and
changes a cell only where the evidence is unique or dominant.  Profiles are
grouped counts; they come back to the rows by equi-joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def normal(c: Column | str) -> Column:
    """Trimmed, lower case, single spaces."""
    return F.regexp_replace(F.trim(T.fold(c)), r"\s+", " ")


def column_mode(df: DataFrame, column: str, order: str, least: int = 3) -> DataFrame:
    """Values that occur once become the most frequent one, if that occurs ``least`` times; ties go to the first seen."""
    seen = df.select(normal(column).alias("v"), F.col(order).alias("o")).filter("v <> ''").groupBy("v").agg(F.count("*").alias("n"), F.min("o").alias("o"))
    mode = seen.agg(F.max(F.struct("n", (-F.col("o")).alias("m"), "v")).alias("x")).select(F.col("x.v").alias("mode"), F.col("x.n").alias("mode_n"))
    joined = df.withColumn("_v", normal(column)).join(seen.select(F.col("v").alias("_v"), F.col("n").alias("_n")), "_v", "left").crossJoin(mode)
    repaired = F.when((F.col("_n") == 1) & (F.col("mode_n") >= least), F.col("mode")).otherwise(F.col(column))
    return joined.withColumn(column, repaired).select(*df.columns)


def context_mode(df: DataFrame, column: str, context: list[str], order: str, least: int = 2) -> DataFrame:
    """Values that occur once among the rows of their context become the context's most frequent one."""
    keys = {f"_k{i}": normal(c) for i, c in enumerate(context)}
    rows = df.withColumns(keys | {"_v": normal(column)})
    usable = rows.filter(reduce(lambda a, b: a & b, (F.col(k) != "" for k in keys))).filter("_v <> ''")
    seen = usable.groupBy(*keys, "_v").agg(F.count("*").alias("_n"), F.min(order).alias("_o"))
    mode = seen.groupBy(*keys).agg(F.max(F.struct("_n", (-F.col("_o")).alias("m"), "_v")).alias("_x"))
    joined = rows.join(seen.drop("_o"), [*keys, "_v"], "left").join(mode, [*keys], "left")
    repaired = F.when((F.col("_n") == 1) & (F.col("_x._n") >= least) & (F.col("_x._v") != F.col("_v")), F.col("_x._v")).otherwise(F.col(column))
    return joined.withColumn(column, repaired).select(*df.columns)


def placeholders(df: DataFrame, column: str, frequent: int = 10, dominance: int = 3) -> DataFrame:
    """Rare values with ``x`` for a character become the frequent value that fits, if it is the only one or ``dominance`` times more frequent.

    Distinct values meet on their length and their first and last characters
    other than the mask, so a masked value sees candidates of its own shape.
    """
    counts = df.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n")).filter("trim(v) <> ''")
    masked = counts.filter(F.col("n") < frequent).filter(F.contains(F.lower("v"), F.lit("x"))).select(F.col("v").alias("bad"))
    good = counts.filter(F.col("n") >= frequent).select(F.col("v").alias("good"), F.col("n").alias("good_n"))
    fits = F.regexp_like(F.lower("good"), F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(F.lower("bad"), r"([^a-z0-9 ])", r"\\$1"), "x", "."), F.lit("$")))
    edge = lambda c, k: F.lower(F.substring(c, k, 1))
    shown = lambda e: F.when(e == "x", "*").otherwise(e)
    masked = masked.select("bad", F.length("bad").alias("size"), shown(edge("bad", 1)).alias("first"), shown(edge("bad", -1)).alias("last"))
    ways = F.explode(F.array_distinct(F.array(*(F.struct(f.alias("first"), e.alias("last")) for f in (edge("good", 1), F.lit("*")) for e in (edge("good", -1), F.lit("*"))))))
    good = good.select("good", "good_n", F.length("good").alias("size"), ways.alias("w")).select("good", "good_n", "size", "w.*")
    found = masked.join(good, ["size", "first", "last"]).filter(fits & (F.col("bad") != F.col("good")))
    place = Window.partitionBy("bad").orderBy(F.desc("good_n"), F.desc("good"))
    top = found.withColumns({"r": F.row_number().over(place), "next": F.lead("good_n").over(place)}).filter("r = 1").filter(F.col("next").isNull() | (F.col("good_n") >= dominance * F.col("next")))
    joined = df.join(top.select(F.col("bad").alias(column), F.col("good").alias("_good")), column, "left")
    return joined.withColumn(column, F.coalesce("_good", column)).select(*df.columns)


def context_fill(df: DataFrame, column: str, key: str) -> DataFrame:
    """Blank cells take the only value that the rows of their key have."""
    value = F.when(T.text(column) != "", F.col(column))
    only = df.filter(T.text(key) != "").groupBy(key).agg(F.min(value).alias("_low"), F.max(value).alias("_high")).filter("_low = _high").drop("_high")
    return df.join(only, key, "left").withColumn(column, F.when(T.text(column) == "", F.coalesce("_low", column)).otherwise(F.col(column))).select(*df.columns)


def rotated_dates(df: DataFrame, column: str, least_rows: int = 20, share: float = 0.7, middle: float = 0.8) -> DataFrame:
    """``a/b/c`` becomes ``b/c/aa`` in the whole column, if most dates have 1 in the middle."""
    form = "^[0-9]+/[0-9]+/[0-9]+$"
    x = F.trim(T.text(column))
    part = F.split(x, "/")
    ok = x.rlike(form)
    seen = df.agg(F.count("*").alias("_all"), F.count_if(ok).alias("_ok"), F.count_if(ok & (F.try_element_at(part, F.lit(2)) == "1")).alias("_one"))
    on = (F.col("_ok") >= F.greatest(F.lit(least_rows), F.floor(F.col("_all") * share))) & (F.col("_one") >= middle * F.col("_ok"))
    number = lambda k: F.try_element_at(part, F.lit(k)).try_cast("int").cast("string")
    first = F.try_element_at(part, F.lit(1))
    turned = F.concat(number(2), F.lit("/"), number(3), F.lit("/"), F.when(F.length(first) < 2, F.lpad(first, 2, "0")).otherwise(first))
    return df.crossJoin(seen).withColumn(column, F.when(on & ok, turned).otherwise(F.col(column))).select(*df.columns)


def missing_markers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Spelled-out missing values become empty."""
    return df.withColumns({c: F.when(F.lower(F.trim(T.text(c))).isin("n/a", "na", "null", "none", "?"), "").otherwise(F.col(c)) for c in columns})


def formatted_number(value: Column, column: str) -> Column:
    """A number in its plain spelling: percent signs stay but for alcohol columns, zip codes and whole numbers as integers, others with 12 digits."""
    shown, n = F.trim(T.text(value)), numeric_candidate(value)
    low = column.lower()
    whole = n.cast("decimal(38,0)").cast("string")
    digits = F.regexp_replace(F.regexp_replace(F.round(n, 12).cast("decimal(38,12)").cast("string"), "0+$", ""), "[.]$", "")
    percent = F.contains(T.text(value), F.lit("%")) if low not in ("abv", "alcohol_by_volume") else F.lit(False)
    integer = F.lit(low == "zip" or low.endswith("_zip")) | (n == F.floor(n))
    return F.when(n.isNull() | percent, shown).when(integer, whole).otherwise(digits)


def numeric_candidate(value: Column | str) -> Column:
    """The number of a value without commas, white space, and a percent sign or ounces behind it; null for none."""
    x = F.regexp_replace(F.lower(F.trim(T.text(value))), r"[,\s]+", "")
    return T.number(F.regexp_replace(x, r"(%|oz\.?|ounces?)$", ""))


def formatted_time(value: Column) -> Column:
    """The first clock time with ``a.m.`` or ``p.m.``, in lower case; other values trimmed."""
    found = F.regexp_extract(T.text(value), r"(?i)([0-9]{1,2}:[0-9]{2}\s*[ap]\.m\.)", 1)
    return F.when(found != "", F.lower(found)).otherwise(F.trim(T.text(value)))


def format_profile(df: DataFrame, columns: list[str], order: str) -> DataFrame:
    """Representations repaired from the table's own profile.

    Missing markers become empty; columns of which four fifths are numbers
    get plain numbers (a padded zip code that repeats often stays), columns
    named after time get plain times, and a blank state takes the two letters
    at the end of its city.
    """
    blank = lambda c: F.trim(T.text(c)) == ""
    profile = df.agg(F.count("*").alias("n"), *(x for k, c in enumerate(columns) for x in (F.count_if(~blank(c)).alias(f"f{k}"), F.count_if(numeric_candidate(c).isNotNull()).alias(f"m{k}")))).first()
    numeric = {c for k, c in enumerate(columns) if profile[f"f{k}"] and profile[f"m{k}"] >= 0.8 * profile[f"f{k}"]}
    out, padded = df, []
    for c in [c for c in columns if c.lower() == "zip" and c in numeric]:
        often = df.groupBy(F.col(c)).agg(F.count("*").alias("_often")).filter(F.col("_often") >= max(10, profile["n"] // 100)).filter(F.trim(T.text(c)).startswith("0")).select(c, F.lit(True).alias(f"_kept_{c}"))
        out = out.join(often, c, "left")
        padded.append(c)
    done = {}
    for c in columns:
        marker = F.lower(F.trim(T.text(c))).isin("n/a", "na", "null", "none", "?")
        if c in numeric:
            value = formatted_number(F.col(c), c)
            value = F.when(F.coalesce(F.col(f"_kept_{c}"), F.lit(False)), F.col(c)).otherwise(value) if c in padded else value
        elif "time" in c.lower():
            value = F.when(T.text(c).rlike("[0-9]{1,2}:[0-9]{2}"), formatted_time(F.col(c))).otherwise(F.col(c))
        else:
            value = F.col(c)
        done[c] = F.when(marker, "").otherwise(value)
    out = out.withColumns(done)
    if {"city", "state"} <= set(columns):
        tail = F.regexp_extract(T.text("city"), r"\s+([A-Za-z]{2})$", 1)
        on = (T.text("state") == "") & (tail != "")
        out = out.withColumns({"_state": F.when(on, F.upper(tail)).otherwise(F.col("state")), "_city": F.when(on, F.regexp_replace(T.text("city"), r"\s+[A-Za-z]{2}$", "")).otherwise(F.col("city"))})
        out = out.withColumns({"state": F.col("_state"), "city": F.col("_city")})
    return out.select(*df.columns)


def fused(df: DataFrame, columns: list[str], order: str) -> DataFrame:
    """``format_profile`` where it changes a cell, else ``placeholders``; both profile the dirty table."""
    masked = df.select(order, *columns)
    for c in columns:
        masked = placeholders(masked, c)
    formatted = format_profile(df, columns, order)
    side = lambda x, s: x.select(order, *(F.col(c).alias(f"{s}_{c}") for c in columns))
    met = df.join(side(formatted, "f"), order).join(side(masked, "m"), order)
    pick = lambda c: F.when(F.col(f"f_{c}").eqNullSafe(F.col(c)), F.col(f"m_{c}")).otherwise(F.col(f"f_{c}"))
    return met.withColumns({c: pick(c) for c in columns}).select(*df.columns)


def context_consensus(df: DataFrame, columns: list[str], key: str, order: str) -> DataFrame:
    """``fused``, then cells that were blank take the only value of their key in the dirty table."""
    filled = df
    for c in [c for c in columns if c != key]:
        filled = context_fill(filled, c, key)
    side = lambda x, s: x.select(order, *(F.col(c).alias(f"{s}_{c}") for c in columns))
    met = fused(df, columns, order).join(side(df, "d"), order).join(side(filled, "c"), order)
    pick = lambda c: F.when((T.text(f"d_{c}") == "") & (T.text(f"c_{c}") != ""), F.col(f"c_{c}")).otherwise(F.col(c))
    return met.withColumns({c: pick(c) for c in columns if c != key}).select(*df.columns)


def residual_score(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row ``(n_filled, n_dirty, score)``: one less the share of filled cells that still are missing markers or unknown."""
    blank = lambda c: F.trim(T.text(c)) == ""
    dirty = lambda c: F.lower(F.trim(T.text(c))).isin("n/a", "na", "null", "none", "?", "unknown", "nan", "-")
    n = df.agg(F.coalesce(F.sum(sum(((~blank(c)).cast("int") for c in columns), F.lit(0))), F.lit(0)).alias("n_filled"), F.coalesce(F.sum(sum((dirty(c).cast("int") for c in columns), F.lit(0))), F.lit(0)).alias("n_dirty"))
    return n.withColumn("score", F.round(1 - F.try_divide(F.col("n_dirty"), F.col("n_filled")), 6))


def integers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Commas, spaces, percent signs and ounces leave whole numbers, and so do decimals of zero."""
    plain = lambda c: F.regexp_replace(F.regexp_replace(F.lower(T.text(c)), "[,% ]|oz\\.?", ""), r"\.0+$", "")
    return df.withColumns({c: F.when(plain(c).rlike("^[0-9]{1,15}$"), plain(c).try_cast("long").cast("string")).otherwise(F.col(c)) for c in columns})


def source_anchor(df: DataFrame, key: str, source: str, columns: list[str], order: str) -> DataFrame:
    """Rows of a key take the filled values of its anchor row, whose source is the key's prefix before a hyphen.

    The anchor is the first such row with all but one of the columns filled,
    else the first such row.
    """
    filled = reduce(lambda a, b: a + b, ((T.text(c) != "").cast("int") for c in columns))
    anchors = df.filter(T.fold(F.substring_index(F.col(key), "-", 1)) == T.fold(source)).filter(T.text(key) != "")
    poor = (filled < max(1, len(columns) - 1)).cast("int")
    best = anchors.groupBy(key).agg(F.min_by(F.struct(*columns), F.struct(poor, F.col(order))).alias("_a"))
    joined = df.join(best, key, "left")
    return joined.withColumns({c: F.when(F.coalesce(F.col(f"_a.{c}") != "", F.lit(False)), F.col(f"_a.{c}")).otherwise(F.col(c)) for c in columns}).select(*df.columns)


def cell_metrics(dirty: DataFrame, clean: DataFrame, repaired: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Counts over all cells: a wrong repair of a wrong cell is a miss, a repair of a right one a false alarm."""
    side = lambda df, s: df.select(key, *(T.text(c).alias(f"{s}_{c}") for c in columns))
    joined = side(dirty, "d").join(side(clean, "c"), key).join(side(repaired, "r"), key)
    tp = fp = fn = changed = wrong = F.lit(0)
    for c in columns:
        d, t, r = F.col(f"d_{c}"), F.col(f"c_{c}"), F.col(f"r_{c}")
        tp, fp, fn = tp + ((d != t) & (r == t)).cast("int"), fp + ((d == t) & (r != d)).cast("int"), fn + ((d != t) & (r != t)).cast("int")
        changed, wrong = changed + (r != d).cast("int"), wrong + (d != t).cast("int")
    return joined.agg(F.coalesce(F.sum(tp), F.lit(0)).alias("tp"), F.coalesce(F.sum(fp), F.lit(0)).alias("fp"), F.coalesce(F.sum(fn), F.lit(0)).alias("fn"), F.coalesce(F.sum(changed), F.lit(0)).alias("n_changed"), F.coalesce(F.sum(wrong), F.lit(0)).alias("n_dirty"))
