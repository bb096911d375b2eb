"""Canonical JSON of nested records, and digests of it, as column expressions.

The text is that of a serialiser with sorted keys, no spaces and characters
left as they are: nulls stay, keys sort by code point on every level, numbers
are written shortest (``1e+16``, ``1e-05``, ``2.0``), and values that JSON has
not (dates, times, decimals) are their text in quotes.  Keys of structs are
sorted while the plan is made and those of maps inside the row, so nothing
leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Y

#: The short escapes of JSON.
SHORT = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def quoted(c: Column) -> Column:
    """A text in quotes, with its control characters escaped."""
    for plain, escape in SHORT.items():
        c = F.replace(c, F.lit(plain), F.lit(escape))
    rest = F.array(*(F.struct(F.lit(chr(k)).alias("c"), F.lit(f"\\u{k:04x}").alias("e")) for k in range(32) if chr(k) not in SHORT))
    # the others are rare: only rows that have one walk the list
    c = F.when(c.rlike(r"[\x00-\x1f]"), F.aggregate(rest, c, lambda s, x: F.replace(s, x["c"], x["e"]))).otherwise(c)
    return F.concat(F.lit('"'), c, F.lit('"'))


def _let(c: Column, use) -> Column:
    """``use(c)`` with ``c`` reckoned once, however often it is named there."""
    return F.element_at(F.transform(F.array(c), use), 1)


def _shortest(c: Column) -> Column:
    """Java's text of a double that is not negative, without a digit too many."""

    def less(s: Column, n: Column) -> Column:
        # below Java 19 a text may have a digit too many: one less that reads back as the same number is taken;
        # normal numbers of up to 15 digits have no shorter text
        one = F.upper(F.call_function("format_string", F.concat(F.lit("%."), F.greatest(F.lit(0), n - 2).cast("string"), F.lit("e")), c))
        return F.when((c < float("inf")) & (n > F.when(c < 2.3e-308, 1).otherwise(15)), _let(one, lambda x: F.when(x.try_cast("double") == c, x).otherwise(s))).otherwise(s)

    return _let(c.cast("string"), lambda s: _let(F.length(F.regexp_replace(F.replace(F.split_part(s, F.lit("E"), F.lit(1)), F.lit("."), F.lit("")), "^0+|0+$", "")), lambda n: less(s, n)))


def _double(c: Column) -> Column:
    """Fixed notation for exponents from -4 to 15, else one with a sign and at least two digits."""
    # minus zero keeps its sign
    sign = F.when((c < 0) | (c.cast("string") == "-0.0"), "-").otherwise("")

    def parts(s: Column) -> Column:
        mantissa, power = F.split_part(s, F.lit("E"), F.lit(1)), F.coalesce(F.split_part(s, F.lit("E"), F.lit(2)).try_cast("int"), F.lit(0))
        return F.struct(F.split_part(mantissa, F.lit("."), F.lit(1)).alias("whole"), F.split_part(mantissa, F.lit("."), F.lit(2)).alias("part"), power.alias("power"))

    def places(x: Column) -> Column:
        every = F.concat(x["whole"], x["part"])
        digits = F.regexp_replace(every, "^0+", "")
        # the point stands before the first digit times ten to ``point``
        return F.struct(F.regexp_replace(digits, "0+$", "").alias("digits"), (x["power"] + F.length(x["whole"]) - (F.length(every) - F.length(digits))).alias("point"))

    def number(x: Column) -> Column:
        digits, point = x["digits"], x["point"]
        n, e = F.length(digits), point - 1
        fixed = (
            F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
            .when(n <= point, F.concat(digits, F.repeat(F.lit("0"), point - n), F.lit(".0")))
            .otherwise(F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, n)))
        )
        tail = F.concat(F.lit("e"), F.when(e < 0, "-").otherwise("+"), F.lpad(F.abs(e).cast("string"), F.greatest(F.lit(2), F.length(F.abs(e).cast("string"))), F.lit("0")))
        short = F.concat(F.substring(digits, 1, 1), F.when(n > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), n))).otherwise(""), tail)
        return F.concat(sign, F.when(c == 0, "0.0").when((e >= -4) & (e < 16), fixed).otherwise(short))

    told = _let(_shortest(F.abs(c)), lambda s: F.when(s == "Infinity", F.concat(sign, s)).otherwise(_let(parts(s), lambda x: _let(places(x), number))))
    return F.when(F.isnan(c), "NaN").when(c.isNotNull(), told)


def _seconds(c: Column) -> Column:
    whole, micros = F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.date_format(c, "SSSSSS")
    return F.concat(whole, F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise(""))


def _joined(items: Column, left: str, right: str) -> Column:
    return F.concat(F.lit(left), F.array_join(items, ","), F.lit(right))


def canonical_json(c: Column, kind: Y.DataType) -> Column:
    """``c`` of type ``kind`` as canonical JSON; a null is ``null``.

    Floats are read as doubles.  Map keys are texts or whole numbers.  Types
    without a JSON form (binary, intervals) are a ``TypeError`` while the plan
    is made.
    """
    if isinstance(kind, Y.StructType):
        fields = [F.concat(quoted(F.lit(f.name)), F.lit(":"), canonical_json(c.getField(f.name), f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name)]
        if len({f.name for f in kind.fields}) < len(kind.fields):
            raise TypeError("a record has one name twice")
        out = F.when(c.isNotNull(), _joined(F.array(*fields), "{", "}") if fields else F.lit("{}"))
    elif isinstance(kind, Y.ArrayType):
        out = _joined(F.transform(c, lambda x: canonical_json(x, kind.elementType)), "[", "]")
    elif isinstance(kind, Y.MapType):
        if not isinstance(kind.keyType, (Y.StringType, Y.IntegerType, Y.LongType)):
            raise TypeError(f"no canonical JSON for keys of {kind.keyType.simpleString()}")
        entries = F.array_sort(F.map_entries(c), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
        out = _joined(F.transform(entries, lambda e: F.concat(quoted(e["key"].cast("string")), F.lit(":"), canonical_json(e["value"], kind.valueType))), "{", "}")
    elif isinstance(kind, (Y.StringType, Y.CharType, Y.VarcharType)):
        out = quoted(c.cast("string"))
    elif isinstance(kind, (Y.BooleanType, Y.ByteType, Y.ShortType, Y.IntegerType, Y.LongType)):
        out = c.cast("string")
    elif isinstance(kind, (Y.DoubleType, Y.FloatType)):
        out = _double(c.cast("double"))
    elif isinstance(kind, (Y.DecimalType, Y.DateType)):
        out = quoted(c.cast("string"))
    elif isinstance(kind, (Y.TimestampType, Y.TimestampNTZType)):
        out = quoted(_seconds(c))
    elif isinstance(kind, Y.NullType):
        out = F.lit("null")
    else:
        raise TypeError(f"no canonical JSON for {kind.simpleString()}")
    return F.coalesce(out, F.lit("null"))


def canonical_hash(df: DataFrame, *columns: str, name: str = "digest") -> DataFrame:
    """``df`` with the SHA-256 of the canonical JSON of a record of ``columns`` (all, if none is named)."""
    kind = Y.StructType([df.schema[k] for k in columns or df.columns])
    return df.withColumn(name, F.sha2(canonical_json(F.struct(*(F.col(f"`{f.name}`") for f in kind.fields)), kind), 256))


def query_plan_key(query_id: Column, query: Column, model: Column, prompt_version: Column, schema_version: Column) -> Column:
    """The name of a cached query plan: a digest of what the plan depends on; nulls are empty."""
    parts = {"query_id": query_id, "query": query, "model_id": model, "prompt_version": prompt_version, "schema_version": schema_version}
    record = F.struct(*(F.coalesce(v.cast("string"), F.lit("")).alias(k) for k, v in parts.items()))
    return F.sha2(canonical_json(record, Y.StructType([Y.StructField(k, Y.StringType()) for k in parts])), 256)
