"""VOTables read by many tasks, and written by them.

A file is cut behind every ``</TR>`` by the text source, which reads a large
file in splits.  One pass finds where the named table begins and ends in each
file, and its fields; the second takes the rows between.  Cells are parsed in
the JVM.  The forms of the format that its writers use are read: elements
without a prefix, no ``>`` in attributes, no comment that holds a tag.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Entities of XML, the ampersand last.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&amp;": "&"}
_NAME = r"""\bname\s*=\s*["']([^"']*)["']"""
_CELL = r"<TD(?:\s[^>]*)?(?:/>|>([^<]*)</TD>)"
_STOPPED = r"""(?is)<INFO\b(?=[^>]*\bname\s*=\s*["']QUERY_STATUS["'])(?=[^>]*\bvalue\s*=\s*["'](ERROR|OVERFLOW)["'])"""


def unescaped(c: Column) -> Column:
    """Text of XML with its entities resolved; numeric ones too, which only few rows have."""
    found = F.array_distinct(F.regexp_extract_all(c, F.lit("&#(x?[0-9A-Fa-f]+);"), F.lit(1)))
    digits = lambda n: F.when(n.startswith("x"), F.conv(F.substring(n, 2, 8), 16, 10)).otherwise(n).cast("int")
    # code points beyond one unit of UTF-16 are decoded from their four bytes
    char = lambda n: F.decode(F.unhex(F.lpad(F.hex(digits(n)), 8, "0")), "UTF-32")
    c = F.when(F.contains(c, F.lit("&#")), F.aggregate(found, c, lambda s, n: F.replace(s, F.concat(F.lit("&#"), n, F.lit(";")), char(n)))).otherwise(c)
    for entity, plain in ENTITIES.items():
        c = F.replace(c, F.lit(entity), F.lit(plain))
    return c


def _records(spark: SparkSession, path: str) -> DataFrame:
    """``(path, block, id, value)``: pieces of the files, in the order of ``(block, id)`` in each file."""
    x = spark.read.text(path, lineSep="</TR>")
    return x.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")


def _tables(records: DataFrame, table: str) -> DataFrame:
    """One row a file: where the first table of the name begins and ends, and its fields; a file without it, or one that says that it is cut short, is an error."""
    here = F.struct("block", "id")
    head = rf"""(?s)<TABLE\b[^>]*\bname\s*=\s*["']{re.escape(table)}["'][^>]*>(.*)"""
    after = F.regexp_extract("value", head, 1)
    begins = F.min(F.when(F.col("value").rlike(head), F.struct("block", "id", after.alias("after"))))
    # tables of one file are few
    x = records.groupBy("path").agg(begins.alias("s"), F.array_sort(F.collect_list(F.when(F.contains("value", F.lit("</TABLE>")), here))).alias("ends"), F.bool_or(F.col("value").rlike(_STOPPED)).alias("stopped"))
    start = F.struct(F.col("s.block").alias("block"), F.col("s.id").alias("id"))
    fields = F.transform(F.regexp_extract_all(F.substring_index("s.after", "<TABLEDATA", 1), F.lit(rf"(<FIELD\b[^>]*>)"), F.lit(1)), lambda f: unescaped(F.regexp_extract(f, _NAME, 1)))
    later = F.filter("ends", lambda e: e > start)
    # a table without rows ends where it begins
    empty = F.coalesce(F.contains(F.substring_index("s.after", "<TR", 1), F.lit("</TABLE>")), F.lit(False))
    fault = F.when(F.col("stopped"), F.concat("path", F.lit(": query status error or overflow"))).when(F.col("s").isNull(), F.concat("path", F.lit(f": no table {table}")))
    begin = F.when(fault.isNull(), start).otherwise(F.raise_error(fault).cast("struct<block:bigint,id:bigint>"))
    return x.select("path", begin.alias("start"), F.when(empty, start).otherwise(F.try_element_at(later, F.lit(1))).alias("end"), fields.alias("fields"))


def votable_rows(spark: SparkSession, path: str, table: str) -> DataFrame:
    """``(path, source_row, row map)`` of a named table of the VOTable files under ``path``, large files in several tasks.

    Errors, when rows are read: a file without the table, one whose status is
    an error or an overflow, a row whose cells are not as many as the fields,
    and a cell with tags of its own.  A table without rows gives none.
    """
    records = _records(spark, path)
    x = records.join(_tables(records, table), "path")
    here = F.struct("block", "id")
    rows = x.filter((here >= F.col("start")) & (F.col("end").isNull() | (here < F.col("end"))) & F.contains("value", F.lit("<TR")))
    line = F.substring_index("value", "<TR", -1)
    rows = rows.select("path", "block", "id", "fields", F.transform(F.regexp_extract_all(line, F.lit(_CELL), F.lit(1)), lambda c: unescaped(c)).alias("cells"), F.size(F.split(line, "<TD[ />]")).alias("n"))
    # a block is a split of bounded size; numbers before a block come from one row a block
    within = F.row_number().over(Window.partitionBy("path", "block").orderBy("id"))
    counts = rows.groupBy("path", "block").agg(F.count("*").alias("k"))
    before = counts.select("path", "block", F.coalesce(F.sum("k").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    out = rows.withColumn("w", within).join(before, ["path", "block"])
    whole = (F.size("cells") == F.size("fields")) & (F.col("n") - 1 == F.size("cells"))
    said = F.concat("path", F.lit(": row "), (F.col("before") + F.col("w")).cast("string"), F.lit(" has "), F.size("cells").cast("string"), F.lit(" cells for "), F.size("fields").cast("string"), F.lit(" fields"))
    row = F.when(whole, F.map_from_arrays("fields", "cells")).otherwise(F.raise_error(said).cast("map<string,string>"))
    return out.select("path", (F.col("before") + F.col("w")).cast("long").alias("source_row"), row.alias("row"))


def write_votables(df: DataFrame, folder: str, table: str) -> None:
    """Each task's rows as one VOTable file; nulls are empty cells, all values text."""
    names = df.columns
    texts = df.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in names))
    fields = "".join(f'<FIELD name={quoteattr(c)} datatype="char" arraysize="*"/>' for c in names)
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<VOTABLE version="1.3"><RESOURCE><TABLE name={quoteattr(table)}>{fields}<DATA><TABLEDATA>'

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"value": [head]})
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
            # line ends inside a cell are references, for a parser would make one kind of them
            cell = lambda v: escape(v, {"\r": "&#13;"})
            yield pa.RecordBatch.from_pydict({"value": pa.array(["<TR>" + "".join(f"<TD>{cell(v)}</TD>" for v in row) + "</TR>" for row in zip(*columns)], pa.string())})
        yield pa.RecordBatch.from_pydict({"value": ["</TABLEDATA></DATA></TABLE></RESOURCE></VOTABLE>"]})

    texts.mapInArrow(run, "value string").write.text(folder)
