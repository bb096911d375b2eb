"""Overlapping chunks of texts that end at sentences where they can."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

SIZE, OVERLAP = 1200, 120


#: Order of sections, and other names of some.
ORDER = {
    "methods": 1, "data_availability": 2, "supplementary": 3, "table": 4, "cohort": 5, "population": 6, "variables": 7, "outcome_definition": 8, "statistical_analysis": 9, "results": 10, "abstract": 11, "title": 12, "limitations": 13,
}
OTHER_NAMES = {
    "method": "methods", "materials_and_methods": "methods", "data_availability_statement": "data_availability", "supplement": "supplementary", "supplemental": "supplementary", "tables": "table", "cohort_description": "cohort", "outcomes": "outcome_definition", "statistics": "statistical_analysis",
}
MARKS = ["。", "！", "？", ". ", "; "]


def spans(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Begins and ends of trimmed chunks; a chunk ends behind the last sentence mark of its second half, if there is one."""
    if len(text) <= size:
        return [(0, len(text))] if text else []
    out, at = [], 0
    while at < len(text):
        end = min(at + size, len(text))
        if end < len(text):
            window = text[at:end]
            stop = max(window.rfind(m) for m in MARKS)
            if stop >= len(window) // 2:
                end = at + stop + (2 if window[stop : stop + 2] in (". ", "; ") else 1)
        piece = text[at:end]
        if piece.strip():
            begin = at + len(piece) - len(piece.lstrip())
            out.append((begin, begin + len(piece.strip())))
        if end >= len(text):
            break
        at = max(at + 1, end - overlap)
    return out


def section_name(c: Column | str) -> Column:
    """Canonical name of a section."""
    x = F.regexp_replace(F.regexp_replace(T.fold(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    table = F.create_map(*(F.lit(v) for kv in OTHER_NAMES.items() for v in kv))
    return F.coalesce(F.try_element_at(table, x), F.when(x != "", x), F.lit("unknown"))


def paper_chunks(papers: DataFrame, topic: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of ``papers(paper_id, title, abstract, sections map)`` in the order of their sections.

    Title and abstract are sections unless the paper has its own; empty
    sections have no chunk, and none is invented.
    """
    none = F.create_map().cast("map<string,string>")
    own = F.coalesce("sections", none)
    extra = F.map_filter(F.create_map(F.lit("title"), F.col("title"), F.lit("abstract"), F.col("abstract")), lambda k, v: v.isNotNull() & ~F.map_contains_key(own, k))
    each = papers.select("paper_id", F.explode(F.map_concat(own, extra)).alias("raw_section", "text"))
    named = each.select("paper_id", "raw_section", section_name("raw_section").alias("section"), F.trim(F.regexp_replace(T.text("text"), r"\s+", " ")).alias("text")).filter("text <> ''")
    keyed = named.select(F.xxhash64("paper_id", "raw_section").alias("doc_id"), "paper_id", "raw_section", "section", "text")
    cut = chunked(keyed, "doc_id", "text", size, overlap).drop("chunk_id")
    rank = F.create_map(*(F.lit(v) for kv in ORDER.items() for v in kv))
    met = cut.join(keyed.drop("text"), "doc_id")
    ident = F.concat(F.lit("chunk-"), F.substring(F.sha2(F.concat_ws("|", F.lit(topic), F.col("paper_id").cast("string"), "section", F.col("chunk_no").cast("string"), "text"), 256), 1, 24))
    return met.select(ident.alias("chunk_id"), "paper_id", "section", F.coalesce(F.try_element_at(rank, F.col("section")), F.lit(99)).alias("section_priority"), F.col("chunk_no").alias("chunk_index"), "text", F.col("raw_section").alias("raw_field"), F.col("begin").alias("start_char"), F.col("end").alias("end_char"))


def chunked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """``(doc_id, chunk_no, begin, end, text, chunk_id)`` of every text; empty texts have none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(i, k, a, b, t[a:b]) for i, t in zip(f["doc_id"], f["text"]) if t for k, (a, b) in enumerate(spans(t, size, overlap))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_no", "begin", "end", "text"])

    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, "doc_id long, chunk_no long, begin long, end long, text string")
    return out.withColumn("chunk_id", T.short_id("chunk", F.col("doc_id"), F.col("chunk_no"), F.col("text")))
