"""Which labels may be learned from, and a bounded sample of such rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that a classifier is fitted on at most; chosen by a hash of the id, so the same in every run.
SAMPLE = 20_000


def remainder(id_col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3))


def held_out(id_col: str = "doc_id") -> Column:
    """True for ids whose labels must not be learned from; a null id is not held out but has no label."""
    return F.coalesce(remainder(id_col) == 1, F.lit(False))


def sample(labels: DataFrame, label: str, id_col: str = "doc_id", rows: int = SAMPLE) -> DataFrame:
    """``(doc_id, y)`` of at most ``rows`` labelled rows that may be learned from; repeated ids take the larger label."""
    usable = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)").filter(~held_out())
    return usable.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
