"""Workbooks and archives, written by the tasks that hold the rows.

A table becomes as many files as it needs: each task streams its rows into
files of ``ROWS`` rows at most, under a name of the attempt first and then
moved, so a task that runs again replaces its files and no file holds more
than one task's rows in memory.  The driver writes one manifest of file names,
rows and digests.  Order is that of ``order_by`` over all files in the order
of the manifest, if it is given.

Values of a table are scalars: nested ones are written as their JSON.
"""

from __future__ import annotations

import csv
import hashlib
import io
import json
import math
import re
import uuid
import zipfile
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from ..functions import text as T
from ..functions.canonical import canonical_json
from ..shared import dealt, written

#: Rows of a sheet and characters of a cell that a workbook may have.
SHEET_ROWS, CELL_CHARS = 1_048_576, 32_767
#: Rows of a file, its header not counted, and bytes of its text after which the next one begins.
ROWS, FILE_BYTES = SHEET_ROWS - 1, 256 << 20
#: First characters that a spreadsheet takes for a formula.
FORMULA = ("=", "+", "-", "@", "\t", "\r")
PART = "file string, part int, place int, n_rows long, sha256 string"
#: The parts of a workbook beside its sheets, in the office open format.
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_NOT_XML = re.compile("[^\\t\\n\\r\\x20-\\ud7ff\\ue000-\\ufffd\\U00010000-\\U0010ffff]")
_SHEET = "application/vnd.openxmlformats-officedocument.spreadsheetml"


def scalars(df: DataFrame) -> DataFrame:
    """Numbers and booleans as they are, nested values as canonical JSON, everything else as text."""
    kept = (Y.BooleanType, Y.ByteType, Y.ShortType, Y.IntegerType, Y.LongType, Y.FloatType, Y.DoubleType)
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        nested = isinstance(f.dataType, (Y.StructType, Y.ArrayType, Y.MapType))
        out.append(c if isinstance(f.dataType, kept) else (F.when(c.isNotNull(), canonical_json(c, f.dataType)) if nested else c.cast("string")).alias(f.name))
    return df.select(*out)


def letters(k: int) -> str:
    """The name of column ``k``, counted from 1."""
    out = ""
    while k:
        k, r = divmod(k - 1, 26)
        out = chr(65 + r) + out
    return out


def _text(s: str) -> str:
    """Text of a cell: characters that XML has not are left out."""
    return escape(_NOT_XML.sub("", s))


def _cell(where: str, v) -> str:
    if v is None or v == "":
        return ""
    if isinstance(v, bool):
        return f'<c r="{where}" t="b"><v>{int(v)}</v></c>'
    # whole numbers beyond 2^53 are kept as text, for a sheet would round them
    if isinstance(v, (int, float)) and math.isfinite(v) and (isinstance(v, float) or abs(v) <= 1 << 53):
        return f'<c r="{where}"><v>{v!r}</v></c>'
    s = str(v)
    if len(s) > CELL_CHARS:
        raise ValueError(f"a cell of a workbook has at most {CELL_CHARS} characters; write an archive instead")
    return f'<c r="{where}" t="inlineStr"><is><t xml:space="preserve">{_text(s)}</t></is></c>'


class Workbook:
    """A workbook of one sheet, streamed row by row into an open file.

    The header is frozen.  All texts are inline, so that neither the rows nor
    a list of their strings is held.
    """

    def __init__(self, out, columns: list[str], title: str):
        self.zip, self.columns, self.n = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED), columns, 0
        self.size = 0
        name = "".join(" " if ch in "[]:*?/\\" else ch for ch in title)[:31] or "Sheet"
        head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
        self.zip.writestr("[Content_Types].xml", f'{head}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{_SHEET}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{_SHEET}.worksheet+xml"/></Types>')
        self.zip.writestr("_rels/.rels", f'{head}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        self.zip.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{_MAIN}" xmlns:r="{_OFFICE}"><sheets><sheet name={quoteattr(name)} sheetId="1" r:id="rId1"/></sheets></workbook>')
        self.zip.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_OFFICE}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        self.sheet = self.zip.open("xl/worksheets/sheet1.xml", "w", force_zip64=True)
        self._put(f'{head}<worksheet xmlns="{_MAIN}"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews><sheetData>')
        self.names = [letters(k) for k in range(1, len(columns) + 1)]
        self._row(columns)

    def _put(self, s: str) -> None:
        self.size += self.sheet.write(s.encode())

    def _row(self, values) -> None:
        self.n += 1
        self._put(f'<row r="{self.n}">' + "".join(_cell(f"{c}{self.n}", v) for c, v in zip(self.names, values)) + "</row>")

    def add(self, values) -> None:
        # a text that a spreadsheet would run stays a text: inline strings are never formulas, the quote guards later saves as CSV
        self._row("'" + v if isinstance(v, str) and v.startswith(FORMULA) else v for v in values)

    def close(self) -> None:
        self._put("</sheetData>" + (f'<autoFilter ref="A1:{self.names[-1]}{self.n}"/>' if self.names else "") + "</worksheet>")
        self.sheet.close()
        self.zip.close()


class Archive:
    """An archive of one table: ``rows.csv`` safe for spreadsheets and ``rows.json``, a row a line, with the values as they were."""

    def __init__(self, out, columns: list[str], title: str):
        # one entry of a zip is open at a time: the lines of JSON wait, compressed; FILE_BYTES bounds them
        self.zip, self.columns, self.n = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED), columns, 1
        self.size = 0
        self.csv = self.zip.open("rows.csv", "w", force_zip64=True)
        self.json = pa.BufferOutputStream()
        self.spool = pa.CompressedOutputStream(self.json, "gzip")
        self._csv(columns, "\ufeff")

    def _csv(self, values, before: str = "") -> None:
        line = io.StringIO(newline="")
        csv.writer(line).writerow(values)
        self.size += self.csv.write((before + line.getvalue()).encode())

    def add(self, values) -> None:
        values = list(values)
        self._csv("" if v is None else "'" + v if isinstance(v, str) and v.startswith(FORMULA) else v for v in values)
        self.spool.write((json.dumps(dict(zip(self.columns, values)), ensure_ascii=False) + "\n").encode())
        self.n += 1

    def close(self) -> None:
        self.csv.close()
        self.spool.close()
        with self.zip.open("rows.json", "w", force_zip64=True) as out:
            lines = pa.CompressedInputStream(pa.BufferReader(self.json.getvalue()), "gzip")
            while block := lines.read(1 << 20):
                out.write(block)
        self.zip.close()


class _Digest:
    """A file that is written once, front to back, and its digest."""

    def __init__(self, out):
        self.out, self.sha, self.at = out, hashlib.sha256(), 0

    def write(self, b) -> int:
        self.out.write(b)
        self.sha.update(b)
        self.at += len(b)
        return len(b)

    def flush(self) -> None:
        self.out.flush()


def _parts(df: DataFrame, folder: str, kind: Callable, suffix: str, title: str, rows: int, stem: str) -> DataFrame:
    """``PART`` of the files that the tasks of ``df`` have written."""
    columns = df.columns
    if not 1 <= rows <= ROWS:
        raise ValueError(f"a file has 1 to {ROWS} rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, book, done = TaskContext.get().partitionId(), 0, None, []
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)

        def finish() -> None:
            book.close()
            sink.out.close()
            fs.move(attempt, f"{root}/{name}")
            done.append((name, part, place, book.n - 1, sink.sha.hexdigest()))

        for batch in batches:
            values = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
            for row in zip(*values):
                if book is None:
                    name = f"{stem}-{part:06d}-{place:04d}.{suffix}"
                    attempt = f"{root}/.{name}.{uuid.uuid4().hex}"
                    sink = _Digest(fs.open_output_stream(attempt))
                    book = kind(sink, columns, title)
                book.add(row)
                if book.n > rows or book.size >= FILE_BYTES:
                    finish()
                    book, place = None, place + 1
        if book is not None:
            finish()
        yield pa.RecordBatch.from_pylist([dict(zip(("file", "part", "place", "n_rows", "sha256"), d)) for d in done], schema=pa.schema([("file", pa.string()), ("part", pa.int32()), ("place", pa.int32()), ("n_rows", pa.int64()), ("sha256", pa.string())]))

    return written(df.mapInArrow(run, PART), "export")


def _manifest(spark: SparkSession, files: list, folder: str, facts: dict) -> None:
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    attempt = f"{root}/.manifest.{uuid.uuid4().hex}"
    with fs.open_output_stream(attempt) as out:
        out.write(json.dumps(facts | {"files": files}, ensure_ascii=False, indent=2, sort_keys=True).encode())
    fs.move(attempt, f"{root}/manifest.json")


def _ordered(df: DataFrame, order_by: list[str] | None) -> DataFrame:
    return df.orderBy(*order_by) if order_by else df


def _dictionary(df: DataFrame) -> list[dict]:
    return [{"name": f.name, "type": "number" if isinstance(f.dataType, Y.NumericType) else "boolean" if isinstance(f.dataType, Y.BooleanType) else "string"} for f in df.schema.fields]


def write_workbooks(df: DataFrame, folder: str, title: str = "data", order_by: list[str] | None = None, rows: int = ROWS) -> DataFrame:
    """Workbooks of at most ``rows`` rows each, and ``manifest.json``; returns ``(file, n_rows, sha256)``.

    A table without rows is an error, and so is a text longer than a cell.
    ``folder`` is a URI that all executors reach.
    """
    return _written(df, folder, Workbook, "xlsx", title, order_by, rows)


def write_archives(df: DataFrame, folder: str, title: str = "data", order_by: list[str] | None = None, rows: int = ROWS) -> DataFrame:
    """Archives with the rows as CSV and as lines of JSON, as ``write_workbooks``."""
    return _written(df, folder, Archive, "zip", title, order_by, rows)


def _written(df: DataFrame, folder: str, kind: Callable, suffix: str, title: str, order_by: list[str] | None, rows: int) -> DataFrame:
    files = _parts(_ordered(scalars(df), order_by), folder, kind, suffix, title, rows, "part")
    # one row a file, and a file holds up to a sheet of rows
    names = [r.asDict() for r in files.orderBy("part", "place").select("file", "n_rows", "sha256").toLocalIterator()]
    if not names:
        raise ValueError("there is no row to export")
    _manifest(df.sparkSession, names, folder, {"title": title, "n_rows": sum(n["n_rows"] for n in names), "columns": _dictionary(df)})
    return files.select("file", "n_rows", "sha256")


def write_sources(tables: dict[str, DataFrame], folder: str, notice: str = "", rows: int = ROWS) -> DataFrame:
    """Each table of ``tables`` that has rows as archives of its own, never joined, and one manifest; returns ``(source, file, n_rows, sha256)``."""
    out, facts = None, []
    for k, (name, df) in enumerate(tables.items(), 1):
        x = _parts(scalars(df), folder, Archive, "zip", name, rows, f"source-{k}").select(F.lit(name).alias("source"), "file", "n_rows", "sha256")
        out = x if out is None else out.unionByName(x)
        facts.append({"source": name, "columns": _dictionary(df)})
    names = [r.asDict() for r in out.orderBy("file").toLocalIterator()] if out is not None else []
    if not names:
        raise ValueError("there is no row to export")
    _manifest(next(iter(tables.values())).sparkSession, names, folder, {"notice": notice, "datasets": facts, "n_rows": sum(n["n_rows"] for n in names)})
    return out


def archive_rows(files: DataFrame, folder: str) -> DataFrame:
    """``(file, row)``: the lines of JSON of the archives ``(file)`` in ``folder``, read by tasks a block at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                with fs.open_input_file(f"{root}/{name}") as f, zipfile.ZipFile(f) as z, z.open("rows.json") as lines:
                    while block := lines.readlines(1 << 20):
                        yield pa.RecordBatch.from_pydict({"file": [name] * len(block), "row": [x.decode().rstrip("\n") for x in block]})

    return dealt(files.select("file"), "file").mapInArrow(run, "file string, row string")


def quality_report(df: DataFrame, required: list[str]) -> DataFrame:
    """``(field, n_filled, n_rows, share, required, gate)`` of every column: ``REVIEW`` where a required field is not filled throughout."""
    x = df.agg(F.count("*").alias("n"), *(F.count_if(T.is_filled(F.col(f"`{c}`").cast("string"), "trimmed")).alias(f"f{k}") for k, c in enumerate(df.columns)))
    rows = F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"f{k}").alias("n_filled"), F.lit(c in required).alias("required")) for k, c in enumerate(df.columns)))
    y = x.select("n", F.explode(rows).alias("r")).select("r.field", "r.n_filled", F.col("n").alias("n_rows"), F.when(F.col("n") > 0, F.round(F.col("r.n_filled") / F.col("n"), 6)).otherwise(0.0).alias("share"), "r.required")
    return y.withColumn("gate", F.when(F.col("required") & ((F.col("n_filled") < F.col("n_rows")) | (F.col("n_rows") == 0)), "REVIEW").otherwise("PASS"))
