r"""Short benchmark items inside long documents, by size-partitioned MinHash containment search.

A leak is an item of which 0.8 or more of the distinct five-word shingles
stand in a document.  Words are ``[^\x20\x09-\x0D]+``, unchanged.  Only
DataFrame functions are used.

Documents are far longer than items, so their Jaccard similarity says
nothing and a signature of the document would have to grow with it.  The
search is therefore one-sided.  An item of ``n`` shingles leaks only into
documents that hold ``need = ceil(0.8 n)`` of them, so of any
``k = n - need + 1`` of its shingles such a document holds one at least.  An
item's sketch is a bottom-``k`` MinHash sketch: the ``k`` shingles that come
first by the number of items that share them and then by hash.  Items are
partitioned by size, and the size sets ``k``.  A document that holds a shingle
of a sketch is a candidate, so no leak is missed; shingles that most items
share stay out of sketches as long as others are there.

Candidates are then verified on the shingles themselves, as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.shared import written

SHINGLE, THRESHOLD = 5, 0.8
_SPACE = " \t\n\x0b\x0c\r"
#: Rows of the sketches that may be broadcast, about 24 bytes each; more are joined by a shuffle.
BROADCAST_ROWS = 1 << 20


def words(text: Column) -> Column:
    """Array of words; null and blank texts have none."""
    trimmed = F.btrim(text, F.lit(_SPACE))
    return F.when(F.coalesce(F.length(trimmed), F.lit(0)) > 0, F.split(trimmed, "[ \\t\\n\\x0B\\f\\r]+"))


def _shingle_hashes(df: DataFrame, keep: list[str], seed: str) -> DataFrame:
    """One row for each shingle occurrence: ``keep`` and its 64-bit ``h``."""
    listed = df.select(*keep, words(F.col("text")).alias("w")).filter(F.size("w") >= SHINGLE)
    at = listed.select(*keep, "w", F.explode(F.sequence(F.lit(0), F.size("w") - SHINGLE)).alias("i"))
    return at.select(*keep, F.xxhash64(F.lit(seed), *(F.get("w", F.col("i") + k) for k in range(SHINGLE))).alias("h"))


def shingles(w: Column) -> Column:
    """Distinct shingles of an array of words as text, words joined by one space.

    ``w`` must be a column, not ``words(...)`` itself: Spark would split the
    text again for every shingle.
    """
    each = F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: F.array_join(F.slice(w, i + 1, SHINGLE), " "))
    return F.when(F.size(w) >= SHINGLE, F.array_distinct(each))


def sketches(items: DataFrame) -> DataFrame:
    """``(item, h)``: the sketch of each item of ``items(item, text)``.

    Items of fewer than five words, null and empty ones too, have none; of
    rows that repeat an item all shingles count; an empty table has none.
    """
    distinct = _shingle_hashes(items, ["item"], "leak").distinct()
    common = distinct.groupBy("h").agg(F.count("*").alias("n_items"))
    sizes = distinct.groupBy("item").agg(F.count("*").alias("n"))
    ranked = distinct.join(common, "h").withColumn("turn", F.row_number().over(Window.partitionBy("item").orderBy("n_items", F.xxhash64(F.lit("rank"), "h"), "h")))
    k = F.col("n") - F.ceil(F.col("n") * THRESHOLD - 1e-9) + 1
    return ranked.join(sizes, "item").filter(F.col("turn") <= k).select("item", "h")


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(doc_id, item_id, n_shingles, n_shared, containment)`` of every leak.

    Texts and items of fewer than five words (null and empty ones too) have
    no shingle and no leak; rows with a null id are not searched.  Rows that
    repeat a document's id are judged by the one that holds most of the item,
    rows that repeat an item's by the longest text.  Other columns are not
    read, and empty tables have no leak.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")).filter("doc is not null and text is not null")
    items = items.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).cast("string").alias("text")).filter("item is not null and text is not null")
    items = items.groupBy("item").agg(F.max_by("text", F.struct(F.length("text"), "text")).alias("text"))
    sketch = sketches(items)
    if sketch.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        sketch = F.broadcast(sketch)
    candidates = written(_shingle_hashes(docs, ["doc"], "leak").join(sketch, "h").select("doc", "item").distinct(), "candidates")
    asked = candidates.select("doc").distinct()
    if asked.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        asked = F.broadcast(asked)
    # rows that repeat an id are told apart by their text
    held = docs.join(asked, "doc", "left_semi").select("doc", F.xxhash64("text").alias("copy"), words(F.col("text")).alias("w")).select("doc", "copy", F.explode(shingles(F.col("w"))).alias("s"))
    whole = items.select("item", words(F.col("text")).alias("w")).select("item", shingles(F.col("w")).alias("s")).withColumn("n_shingles", F.size("s").cast("long"))
    each = candidates.join(whole, "item").select("doc", "item", "n_shingles", F.explode("s").alias("s"))
    shared = held.join(each, ["doc", "s"]).groupBy("doc", "copy", "item", "n_shingles").agg(F.count("*").alias("n_shared"))
    found = shared.groupBy("doc", "item", "n_shingles").agg(F.max("n_shared").alias("n_shared"))
    return found.filter(F.col("n_shared") >= F.col("n_shingles") * THRESHOLD - 1e-9).select(
        F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "n_shingles", "n_shared", F.round(F.col("n_shared") / F.col("n_shingles"), 6).alias("containment")
    )


def without_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that hold a leak; columns unchanged, rows with a null id stay."""
    found = leaks(docs, items, id_col, text_col).select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(found, id_col, "left_anti")


SQL = """
WITH w AS (
  SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM documents WHERE text IS NOT NULL),
b AS (
  SELECT item_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM benchmark WHERE text IS NOT NULL),
ds AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM w)),
bs AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM b)),
n AS (SELECT item_id, count(*) AS n_shingles FROM bs GROUP BY item_id),
j AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN bs USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shingles, n_shared, round(n_shared / n_shingles, 6) AS containment
FROM j JOIN n USING (item_id) WHERE n_shared >= 0.8 * n_shingles - 1e-9
"""
