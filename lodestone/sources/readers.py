"""Scans of tabular, HTML, XML and JSON inputs into cell records.

A cell record is ``(location, field, value, confidence)`` with the value as
it stands; missing values are null and have low confidence.
"""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

CELL = "table_no int, row_no int, field string, value string"
#: Section headings of papers, in order.
SECTIONS = ["abstract", "introduction", "background", "methods", "results", "discussion", "conclusion", "references"]


def read_any(spark: SparkSession, path: str, fmt: str | None = None, multi_line: bool = False) -> DataFrame:
    """A reader by suffix: csv, tsv, txt, json, jsonl, parquet, orc, xml, html, xlsx; all columns of text files are strings.

    A ``txt`` file, or one without a known suffix, is looked into: tables and
    articles are markup, else tabs or commas part it, whichever are more in
    its first 4,096 characters.  ``multi_line`` allows line breaks inside
    quoted cells and makes each file one task.
    """
    kind = fmt or path.rstrip("/").rsplit(".", 1)[-1].lower()
    sep = "\t" if kind == "tsv" else ","
    if kind not in ("csv", "tsv", "json", "jsonl", "html", "htm", "xml", "parquet", "pq", "orc", "xlsx", "xlsm"):
        kind, sep = sniffed(spark, path)
    if kind in ("csv", "tsv"):
        if kind == "csv" and fmt is None:
            sep = sniffed(spark, path)[1]
        return spark.read.csv(path, header=True, sep=sep, multiLine=multi_line, escape='"')
    if kind in ("json", "jsonl"):
        return spark.read.json(path)
    if kind in ("html", "htm"):
        return spark.read.text(path, wholetext=True).withColumnRenamed("value", "html")
    if kind == "xml":
        return spark.read.text(path, wholetext=True).withColumnRenamed("value", "xml")
    if kind in ("xlsx", "xlsm"):
        return workbook_cells(spark.read.format("binaryFile").load(path))
    return spark.read.format({"pq": "parquet"}.get(kind, kind)).load(path)


def sniffed(spark: SparkSession, path: str) -> tuple[str, str]:
    """Kind and separator of a text file by its first lines."""
    head = "\n".join(r["value"] for r in spark.read.text(path).limit(200).collect())[:4096]
    low = head.lower()
    if "<article" in low:
        return "xml", ","
    if "<table" in low or "<html" in low:
        return "html", ","
    return "csv", "\t" if head.count("\t") > head.count(",") else ","


def _sheets(content: bytes) -> list[tuple[str, int, int, str, bool]]:
    """Cells ``(sheet, row, column, value, merged)`` of a workbook; text of formulas is their stored value."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    rel = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iterfind(".//m:t", ns)) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iterfind("m:si", ns)]
        targets = {r.get("Id"): r.get("Target", "").lstrip("/") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iterfind("m:sheets/m:sheet", ns):
            target = targets.get(sheet.get(rel), "")
            root = ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
            merged = root.find("m:mergeCells", ns) is not None
            for n, row in enumerate(root.iterfind("m:sheetData/m:row", ns), 1):
                for k, cell in enumerate(row.iterfind("m:c", ns), 1):
                    letters = re.match("[A-Z]+", cell.get("r") or "")
                    column = sum((ord(c) - 64) * 26**i for i, c in enumerate(reversed(letters[0]))) if letters else k
                    value = cell.findtext("m:v", "", ns)
                    if cell.get("t") == "s":
                        value = shared[int(value)] if value else ""
                    elif cell.get("t") == "inlineStr":
                        value = "".join(t.text or "" for t in cell.iterfind(".//m:t", ns))
                    elif cell.get("t") == "b":
                        value = "TRUE" if value == "1" else "FALSE"
                    out.append((sheet.get("name"), int(row.get("r") or n), column, value, merged))
    return out


def workbook_cells(files: DataFrame) -> DataFrame:
    """``(path, location, field, value, confidence, kind, status)`` of the cells of workbooks ``(path, content)``.

    The first row of a sheet names its fields; ``location`` is
    ``sheet:row:column``.  Sheets with merged cells go to review, and so does
    a workbook that cannot be read, as one row without value.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, content in zip(f["path"], f["content"]):
                try:
                    found = _sheets(bytes(content))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError, IndexError):
                    rows.append((path, "", "", None, True))
                    continue
                first = {}
                for sheet, row, column, value, merged in found:
                    if sheet not in first or row == first[sheet][0]:
                        first.setdefault(sheet, (row, {}))[1][column] = value
                    else:
                        rows.append((path, f"{sheet}:{row}:{column}", first[sheet][1].get(column) or f"column_{column}", value, merged))
            yield pd.DataFrame(rows, columns=["path", "location", "field", "value", "merged"])

    x = files.select("path", "content").mapInPandas(run, "path string, location string, field string, value string, merged boolean")
    known = T.is_filled("value", "scan")
    return x.select("path", "location", "field", F.when(known, F.col("value")).alias("value"), F.when(known, 0.9).otherwise(0.4).alias("confidence"), T.value_type("value").alias("kind"), F.when(F.col("merged"), "REVIEW").otherwise("OK").alias("status"))


def parsed(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Cells of a file of any kind that ``read_any`` knows; a file without a cell is one ``REJECTED`` row."""
    df = read_any(spark, path, fmt)
    if df.columns == ["html"]:
        x = html_cells(df.withColumn("page_id", F.monotonically_increasing_id())).select(F.concat_ws(":", F.lit("table"), "table_no", "row_no").alias("location"), "field", "value")
    elif df.columns == ["xml"]:
        x = jats_cells(df.select(F.lit(1).alias("id"), "xml")).select("location", "field", "value")
    elif {"location", "field", "value"} <= set(df.columns):
        x = df.select("location", "field", "value")
    else:
        x = cells(df.withColumn("_row", F.monotonically_increasing_id()), "_row").select("location", "field", "value")
    x = x.withColumn("status", F.lit("OK"))
    return x if x.limit(1).count() else spark.range(1).select(F.lit("").alias("location"), F.lit("").alias("field"), F.lit(None).cast("string").alias("value"), F.lit("REJECTED").alias("status"))


def cells(df: DataFrame, id_col: str, columns: list[str] | None = None) -> DataFrame:
    """One cell record for each cell, with its type; ``location`` is ``row:<id>``."""
    columns = columns or [c for c in df.columns if c != id_col]
    listed = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns)))
    x = df.select(F.concat(F.lit("row:"), F.col(id_col).cast("string")).alias("location"), listed.alias("c")).select("location", "c.field", "c.value")
    known = T.is_filled("value", "scan")
    return x.select("location", "field", F.when(known, F.col("value")).alias("value"), F.when(known, 0.9).otherwise(0.4).alias("confidence"), T.value_type("value").alias("kind"))


class _Tables(HTMLParser):
    """Rows of the tables of one page; cells of nested tables belong to the innermost one."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[str]]] = []
        self.open: list[list[list[str]]] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.open.append([])
        elif tag == "tr" and self.open:
            self.end_cell()
            self.open[-1].append([])
        elif tag in ("td", "th") and self.open:
            self.end_cell()
            self.cell = []

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr", "table"):
            self.end_cell()
        if tag == "table" and self.open:
            self.tables.append(self.open.pop())

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)

    def end_cell(self):
        if self.cell is not None and self.open:
            if not self.open[-1]:
                self.open[-1].append([])
            self.open[-1][-1].append(" ".join("".join(self.cell).split()))
        self.cell = None

    def close(self):
        super().close()
        self.end_cell()
        while self.open:
            self.tables.append(self.open.pop())


def table_cells(html: str | None) -> list[tuple[int, int, str, str]]:
    """Cells of a page; the first row of a table names its fields, rows of empty cells are left out."""
    parser = _Tables()
    parser.feed(html or "")
    parser.close()
    out = []
    for t, rows in enumerate(parser.tables):
        rows = [r for r in rows if any(r)]
        for n, row in enumerate(rows[1:], 1):
            out += [(t, n, rows[0][k] if k < len(rows[0]) and rows[0][k] else f"column_{k + 1}", v) for k, v in enumerate(row)]
    return out


def html_cells(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``(id, table_no, row_no, field, value)`` of every table cell of every page."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(i, *c) for i, h in zip(f["id"], f["html"]) for c in table_cells(h)]
            yield pd.DataFrame(rows, columns=["id", "table_no", "row_no", "field", "value"])

    return pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).mapInPandas(run, f"id long, {CELL}")


def html_title(html: Column | str) -> Column:
    return F.regexp_extract(T.text(html), "<title>([^<]*)</title>", 1)


def html_links(html: Column | str) -> Column:
    """Targets of links in order."""
    return F.regexp_extract_all(T.text(html), F.lit('<a href="([^"]*)"'), F.lit(1))


def html_text(html: Column | str) -> Column:
    """Text between tags, without scripts and styles, in single spaces."""
    x = F.regexp_replace(T.text(html), "(?s)<script.*?</script>|<style.*?</style>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]*>", " "), "[ \t\r\n]+", " "))


def paper_sections(text: Column | str) -> Column:
    """``[(section, body)]``: an extracted text cut at lines that are section headings; ``body`` where there is none."""
    heads = "|".join(SECTIONS)
    x = F.concat(F.lit("\n"), T.text(text), F.lit("\n"))
    marked = F.regexp_replace(x, rf"(?i)\n[ \t0-9.]*({heads})[ \t]*:?[ \t]*(?=\n)", "\u0001$1\u0002")
    parts = F.slice(F.split(marked, "\u0001"), F.lit(2), F.greatest(F.size(F.split(marked, "\u0001")), F.lit(1)))
    found = F.transform(parts, lambda p: F.struct(F.lower(F.substring_index(p, "\u0002", 1)).alias("section"), F.btrim(F.substring_index(p, "\u0002", -1), F.lit(" \t\r\n")).alias("body")))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.struct(F.lit("body").alias("section"), F.btrim(x, F.lit(" \t\r\n")).alias("body"))))


def jats_captions(xml: Column | str) -> Column:
    """Captions of figures of a JATS article, up to 800 characters each; null or broken XML has none."""
    found = F.regexp_extract_all(T.text(xml), F.lit("(?s)<fig[ >].*?<caption>(.*?)</caption>"), F.lit(1))
    return F.transform(found, lambda c: F.substring(F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), r"\s+", " ")), 1, 800))


def jats_cells(articles: DataFrame) -> DataFrame:
    """``(id, location, field, value, status)`` of articles ``(id, xml)``: table cells, figure captions, and the text's digest.

    Captions have up to 800 characters and go to review; broken XML has the
    digest alone.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for i, xml in zip(f["id"], f["xml"]):
                text = xml or ""
                wraps = re.findall(r"(?s)<table-wrap[ >].*?</table-wrap>", text)
                for w, wrap in enumerate(wraps):
                    rows += [(i, f"table-wrap:{w}:{t}:{r}", name, value, "OK") for t, r, name, value in table_cells(wrap)]
                for k, caption in enumerate(re.findall(r"(?s)<fig[ >].*?<caption>(.*?)</caption>", text)):
                    rows.append((i, f"fig:{k}", "caption", " ".join(re.sub("<[^>]*>", " ", caption).split())[:800], "REVIEW"))
                rows.append((i, "document", "content_hash", hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()[:16], "OK"))
            yield pd.DataFrame(rows, columns=["id", "location", "field", "value", "status"])

    return articles.select(F.col("id").cast("string").alias("id"), "xml").mapInPandas(run, "id string, location string, field string, value string, status string")


def section_excerpts(texts: DataFrame, id_col: str = "id", text_col: str = "text", longest: int = 800) -> DataFrame:
    """``(id, section, excerpt, content_hash)`` of each section of extracted texts."""
    each = texts.select(F.col(id_col).alias("id"), F.substring(F.sha2(T.text(text_col), 256), 1, 16).alias("content_hash"), F.explode(paper_sections(text_col)).alias("s"))
    return each.select("id", "s.section", F.substring("s.body", 1, longest).alias("excerpt"), "content_hash")


def votable(files: DataFrame, table: str) -> DataFrame:
    """``(path, source_row, row map)`` of a named table of VOTable files ``(path, content)``.

    A row with another number of cells than fields, a missing table and a
    status of error or overflow are errors when they are read.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        local = lambda e: e.tag.rsplit("}", 1)[-1]
        for f in frames:
            rows = []
            for path, content in zip(f["path"], f["content"]):
                root = ElementTree.fromstring(bytes(content))
                for e in root.iter():
                    if local(e) == "INFO" and e.get("name", "").upper() == "QUERY_STATUS" and e.get("value", "").upper() in ("ERROR", "OVERFLOW"):
                        raise ValueError(f"{path}: query status {e.get('value')}")
                found = next((e for e in root.iter() if local(e) == "TABLE" and e.get("name") == table), None)
                if found is None:
                    raise ValueError(f"{path}: no table {table}")
                names = [e.get("name") for e in found if local(e) == "FIELD"]
                lines = [e for e in found.iter() if local(e) == "TR"]
                for n, line in enumerate(lines, 1):
                    values = [e.text or "" for e in line if local(e) == "TD"]
                    if len(values) != len(names):
                        raise ValueError(f"{path}: row {n} has {len(values)} cells for {len(names)} fields")
                    rows.append((path, n, dict(zip(names, values))))
            yield pd.DataFrame(rows, columns=["path", "source_row", "row"])

    return files.select("path", "content").mapInPandas(run, "path string, source_row int, row map<string,string>")


def votable_fields(files: DataFrame, table: str) -> DataFrame:
    """``(path, field, unit, datatype)`` of a named table."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        local = lambda e: e.tag.rsplit("}", 1)[-1]
        for f in frames:
            rows = []
            for path, content in zip(f["path"], f["content"]):
                for t in ElementTree.fromstring(bytes(content)).iter():
                    if local(t) == "TABLE" and t.get("name") == table:
                        rows += [(path, e.get("name"), e.get("unit"), e.get("datatype")) for e in t if local(e) == "FIELD"]
            yield pd.DataFrame(rows, columns=["path", "field", "unit", "datatype"])

    return files.select("path", "content").mapInPandas(run, "path string, field string, unit string, datatype string")


def cleaning_pair(dirty: DataFrame, clean: DataFrame, key: str = "tid") -> tuple[DataFrame, DataFrame]:
    """A dirty table and its clean one with the same columns.

    ``clean`` is either whole, with columns that may be spelt otherwise (case,
    underlines, a ``full``, ``raw`` or ``original`` before), or the corrected
    cells ``(tid, attribute, correct_val)`` alone.  Different numbers of rows
    are an error.
    """
    if {"attribute", "correct_val"} <= set(clean.columns):
        names = [c for c in dirty.columns if c != key]
        wide = clean.groupBy(F.col(clean.columns[0]).alias(key)).pivot("attribute", names).agg(F.first("correct_val"))
        met = dirty.join(wide.select(key, *(F.col(f"`{c}`").alias(f"_{c}") for c in names)), key, "left")
        return dirty, met.select(key, *(F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) for c in names)).select(*dirty.columns)
    bare = lambda c: re.sub("^(full|raw|original)_?", "", re.sub("[^a-z0-9]+", "_", c.lower()).strip("_")).replace("_", "")
    by_name = {bare(c): c for c in clean.columns}
    absent = [c for c in dirty.columns if bare(c) not in by_name]
    if absent:
        raise ValueError(f"the clean table lacks {absent}")
    if dirty.count() != clean.count():
        raise ValueError("the dirty and the clean table have different numbers of rows")
    return dirty, clean.select(*(F.col(f"`{by_name[bare(c)]}`").alias(c) for c in dirty.columns))


def gold_set(spark: SparkSession, folder: str, name: str, columns: dict[str, str]) -> DataFrame:
    """A gold table of a folder: exactly these columns, booleans as TRUE or FALSE, names in lower case.

    ``columns`` gives the kind of each: ``string``, ``boolean``, ``enum``.
    """
    df = spark.read.csv(f"{folder}/{name}.csv", header=True, escape='"')
    if df.columns != list(columns):
        raise ValueError(f"{name} has columns {df.columns}, expected {list(columns)}")
    flag = lambda c: F.when(F.upper(F.trim(c)) == "TRUE", True).when(F.upper(F.trim(c)) == "FALSE", False).otherwise(F.raise_error(F.lit(f"{name}: neither TRUE nor FALSE")).cast("boolean"))
    kinds = {"string": lambda c: F.trim(c), "boolean": flag, "enum": lambda c: F.lower(F.trim(c))}
    return df.select(*(kinds[k](F.col(c)).alias(c) for c, k in columns.items()))


def table_digest(df: DataFrame) -> DataFrame:
    """One row ``digest``: the same for the same rows in any order."""
    row = F.sha2(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}), 256)
    one = F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.sha2(F.concat_ws("|", F.count("*").cast("string"), F.coalesce(F.sum(one).cast("string"), F.lit("0"))), 256).alias("digest"))


def schema_task(spark: SparkSession, folder: str, order: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Source table, target table and gold pairs ``(source, target)`` of a schema-matching folder; a gold pair of an absent column is an error."""
    a, b = (spark.read.csv(f"{folder}/{n}_table.csv", header=True, escape='"') for n in ("source", "target"))
    gold = spark.read.json(f"{folder}/ground_truth.json", multiLine=True).select(F.explode("matches").alias("m")).select(F.col("m.source_column").alias("source"), F.col("m.target_column").alias("target"))
    bad = gold.filter(~F.col("source").isin(*a.columns) | ~F.col("target").isin(*b.columns))
    if bad.limit(1).count():
        raise ValueError("a gold pair names a column that is not there")
    return a, b, gold.distinct()


def series_matrix(lines: DataFrame) -> DataFrame:
    """``(sample, key, value)`` from ``lines(value)`` of a series matrix: header lines turned into rows of samples."""
    head = lines.filter(F.col("value").startswith("!Sample_")).select(F.split("value", "\t").alias("p"))
    cellsof = head.select(F.expr("substring(p[0], 9)").alias("key"), F.posexplode(F.slice("p", F.lit(2), F.greatest(F.size("p"), F.lit(1)))).alias("sample", "raw"))
    return cellsof.select("sample", "key", F.regexp_replace("raw", '^"|"$', "").alias("value"))


def beir(spark: SparkSession, folder: str, split: str = "test") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Corpus, queries and judgements of a retrieval benchmark folder."""
    corpus = spark.read.json(f"{folder}/corpus.jsonl").select(F.col("_id").alias("doc_id"), F.concat_ws(" ", "title", "text").alias("text"))
    queries = spark.read.json(f"{folder}/queries.jsonl").select(F.col("_id").alias("query_id"), "text")
    judged = spark.read.csv(f"{folder}/qrels/{split}.tsv", header=True, sep="\t").toDF("query_id", "doc_id", "gain").withColumn("gain", F.col("gain").cast("int"))
    return corpus, queries, judged


def entity_pairs(a: DataFrame, b: DataFrame, pairs: DataFrame) -> DataFrame:
    """Labelled pairs joined with both tables; a pair whose row is missing is an error when it is read."""
    x, y = a.select(F.col("id").alias("ltable_id"), F.struct("*").alias("left")), b.select(F.col("id").alias("rtable_id"), F.struct("*").alias("right"))
    joined = pairs.join(x, "ltable_id", "left").join(y, "rtable_id", "left")
    missing = F.col("left").isNull() | F.col("right").isNull()
    return joined.withColumn("label", F.when(missing, F.raise_error(F.lit("a pair names a row that is not there"))).otherwise(F.col("label")))
