"""Token counts of whole texts: lengths only, from batches balanced by bytes.

Arrow batches are cut into chunks of equal bytes, long texts at white space,
where no word can reach across.  The library encodes the words that a worker
has not met in one batch call, and only lengths are kept, so a row costs one
sum.  Works for ``tokenizers`` files of the word kind (``.json``) and, text
by text, for ``sentencepiece`` models (``.model``).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import LibraryMerger, Remembered
from .words import chunks

LIMIT = 2048


class WordLengths(Remembered):
    """Tokens of a text as the sum of its words' lengths."""

    def __init__(self, path: str):
        library = LibraryMerger(path).library
        many = getattr(library, "encode_batch_fast", None) or library.encode_batch
        super().__init__(path, lambda words: [len(e) for e in many(words, add_special_tokens=False)], sum, lambda i: 1)


class PieceLengths:
    """Tokens by a sentencepiece model, whose merges may reach across spaces: texts stay whole."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def batch(self, texts: list[str | None]) -> list[int]:
        return [len(ids) for ids in self.model.encode([t or "" for t in texts], num_threads=1)]


@lru_cache(maxsize=2)
def lengths(path: str) -> WordLengths | PieceLengths:
    return PieceLengths(path) if path.endswith(".model") else WordLengths(path)


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` of every row; null and empty texts count 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lengths(path)
        for batch in batches:
            for part in chunks(batch, "text"):
                n = np.array(own.batch(part.column("text").to_pylist()), np.int64)
                size = pc.binary_length(part.column("text")).fill_null(0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), size, pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
