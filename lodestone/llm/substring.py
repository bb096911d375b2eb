"""Removal of repeated 13-word windows, found by recompression.

Recompression replaces a text by shorter and shorter strings of symbols:
in a round the alphabet is split in two halves and every pair (left symbol,
right symbol) becomes one new symbol.  Here a symbol's name is a 64-bit hash
of what it stands for and its half is a bit of that name, so equal substrings
get equal symbols in every document, except where a symbol at either end may
pair with a neighbour outside.  Two rounds are run, because a window of 13
words always holds a second-round symbol that its own words determine, with a
first-round neighbour on both sides; a third round would not guarantee one.
A run of one word never pairs (equal symbols are in one half) and so passes
as single symbols; naming whole runs would make the names inside a window
depend on words outside it.

1. Exact copies (by 128-bit BLAKE2b names of their word sequences) of a smaller
   document of 13 words or more lose all words, and add nothing to the search.
2. Anchors: of the second-round symbols that a window determines, the one of
   least hash, leftmost on ties, anchors the window.  An anchor's key is the
   hash of the words that determine it (5 to 10 words), so windows with equal
   words have equal keys at equal places.
3. Keys are counted over all word sequences; a key of one of them reveals
   nothing and leaves with all its windows.
4. Windows on shared keys are verified on 128-bit names of their 13 words,
   two independent halves made from the two halves of the words' BLAKE2b
   names: the least document id of each name, joined back.

A window with a smaller document id elsewhere loses its words.  Keys that a
large part of all rows share are summed before they are shuffled, and the
joins on them are sort-merge joins that adaptive execution splits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.shared import discard, written
from .words import GOLD, chunks, mix, whole_hash, words_of

WINDOW = 13
_FAR = np.uint64(0xFFFFFFFFFFFFFFFF)


def _pair_round(names: np.ndarray, first: np.ndarray, bit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One round of pair compression: new names, start of each new symbol, ``first`` per text."""
    n = len(names)
    left = ((names >> np.uint64(bit)) & np.uint64(1)).astype(bool)
    joined = np.zeros(n, bool)  # symbol i goes into symbol i - 1
    joined[1:] = left[:-1] & ~left[1:]
    inner = first[(first > 0) & (first < n)]
    joined[inner] = False
    at = np.flatnonzero(~joined)
    out = names[at].copy()
    two = np.flatnonzero(np.append(joined, False)[at + 1])
    out[two] = mix((names[at[two]] * GOLD) ^ mix(names[at[two] + 1] + GOLD))
    return out, at, np.searchsorted(at, first)


def anchors(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(key, low, high)``: windows that start in ``low..high`` can be anchored by the symbol; ascending."""
    n = len(h)
    one, at1, first1 = _pair_round(h, first, 11)
    two, at2, first2 = _pair_round(one, first1, 23)
    end1 = np.append(at1, n)
    s, e = at2, np.append(at2, len(one))[1:]
    inside = np.ones(len(two), bool)
    inside[first2[:-1][np.diff(first2) > 0]] = False  # a first symbol has no left neighbour
    inside[(first2[1:] - 1)[np.diff(first2) > 0]] = False
    s, e = s[inside], e[inside]
    # words of the left neighbour and of the right one, and one more on each side
    begin, end = end1[s - 1] - 1, end1[e + 1] + 1
    text = np.searchsorted(first, end1[s], side="right") - 1
    fits = (begin >= first[text]) & (end <= first[text + 1])
    begin, end, text, s = begin[fits], end[fits], text[fits], s[fits]
    # the symbol with its neighbours and the words that settle where these end
    key = np.zeros(len(s), np.uint64)
    for part in (h[begin], one[s - 1], two[inside][fits], one[e[fits]], h[end - 1]):
        key = mix((key + GOLD) ^ part)
    low = np.maximum(end - WINDOW, first[text])
    high = np.minimum(begin, first[text + 1] - WINDOW)
    ok = high >= low
    return key[ok], low[ok], high[ok]


def chosen(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(window start, key)`` of every window of the chunk, and ``(text of window, start in text)``."""
    size = np.maximum(np.diff(first) - WINDOW + 1, 0)
    text = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(text)) - np.repeat(np.cumsum(size) - size, size)
    start = first[text] + place
    key, low, high = anchors(h, first)
    a, b = np.searchsorted(high, start), np.searchsorted(low, start, side="right")
    best = np.full(len(start), _FAR, np.uint64)
    for k in range(int((b - a).max(initial=0))):
        at = a + k
        has = at < b
        best[has] = np.minimum(best[has], key[at[has]])
    return start, best, text, place


def _symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of words, name of the word sequence and keys of the windows of each text, in one pass."""
    for batch in batches:
        for part in chunks(batch, "text"):
            words = words_of(part.column("text"))
            _, key, text, _ = chosen(words.hash, words.first)
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
            cut = np.concatenate([[0], np.cumsum(np.bincount(text[new], minlength=part.num_rows))]).astype(np.int32)
            keys = pa.ListArray.from_arrays(pa.array(cut), pa.array(key[new].view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.diff(words.first)), *map(pa.array, whole_hash(words)), keys], names=["id", "n", "h1", "h2", "keys"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names of the windows on shared keys; a row has a text and the list of its shared keys."""
    for batch in batches:
        for part in chunks(batch, "text"):
            words = words_of(part.column("text"))
            start, key, text, place = chosen(words.hash, words.first)
            if not len(key):
                continue
            lists = part.column("keys")
            shared = np.asarray(lists.flatten()).view(np.uint64)
            owner = np.repeat(np.arange(part.num_rows), np.asarray(lists.value_lengths()))
            mixed = np.sort(mix(shared ^ (owner.astype(np.uint64) * GOLD)))
            mine = mix(key ^ (text.astype(np.uint64) * GOLD))
            at = np.searchsorted(mixed, mine)
            hit = np.flatnonzero((at < len(mixed)) & (mixed[np.minimum(at, len(mixed) - 1)] == mine)) if len(mixed) else np.empty(0, np.int64)
            if not len(hit):
                continue
            name = np.zeros(len(hit), np.uint64)
            tag = np.zeros(len(hit), np.uint64)
            for k in range(WINDOW):
                name = mix((name + GOLD) ^ words.hash[start[hit] + k])
                tag = mix((tag + GOLD) ^ words.more[start[hit] + k])
            yield pa.RecordBatch.from_arrays(
                [part.column("id").take(pa.array(text[hit])), pa.array(place[hit].astype(np.int32)), pa.array(name.view(np.int64)), pa.array(tag.view(np.int64))],
                names=["id", "place", "name", "tag"],
            )


def cut_words(text: str | None, places: list[int] | None) -> tuple[int, str]:
    """Number of words removed and the kept words joined by one space; no places: all words go."""
    words = split_words(text)
    if places is None:
        return len(words), ""
    gone = np.zeros(len(words) + 1, np.int64)
    for p in places:
        gone[p] += 1
        gone[p + WINDOW] -= 1
    keep = np.cumsum(gone)[:-1] == 0
    return int(len(words) - keep.sum()), " ".join(w for w, k in zip(words, keep) if k)


def split_words(text: str | None) -> list[str]:
    r"""Maximal runs of ``[^\x20\x09-\x0D]``: ASCII white space only, unlike ``str.split``."""
    return [w.decode("utf-8", "surrogatepass") for w in (text or "").encode("utf-8", "surrogatepass").split()]


def exact_copies(symbols: DataFrame) -> DataFrame:
    """Ids of ``symbols(id, n, h1, h2)`` whose words are those of a smaller id, from 13 words on."""
    whole = symbols.select("id", "n", "h1", "h2").filter(F.col("n") >= WINDOW)
    least = whole.groupBy("h1", "h2").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low <> high")
    return whole.join(least, ["h1", "h2"]).filter("id > low").select("id").distinct()


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, places)``, as a written table: starts, in words, of the windows that also start in a document of smaller id.

    ``places`` is null for an exact copy, all of whose words go.  Documents
    without such a window, null or short texts, and rows with a null id have
    no row.  Rows that repeat an id are one document's copies: their windows
    never count against that id.  An empty table gives no rows.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id is not null and text is not null")
    symbols = written(texts.mapInArrow(_symbols, "id long, n long, h1 long, h2 long, keys array<long>"), "symbols")
    copies = written(exact_copies(symbols), "copies")
    keys = symbols.select("id", F.col("h1").alias("whole"), F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.min("whole").alias("low"), F.max("whole").alias("high")).filter("low <> high").select("key")
    shared = written(shared, "shared")
    mine = keys.select("id", "key").join(shared, "key").groupBy("id").agg(F.collect_set("key").alias("keys"))
    mine = written(mine.join(copies, "id", "left_anti"), "keys")
    discard(symbols, shared)
    windows = written(texts.join(mine, "id").mapInArrow(_windows, "id long, place int, name long, tag long"), "windows")
    discard(mine)
    least = windows.groupBy("name", "tag").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low <> high")
    late = windows.join(least, ["name", "tag"]).filter("id > low")
    places = late.groupBy("id").agg(F.collect_set("place").alias("places"))
    out = written(places.union(copies.select("id", F.lit(None).cast("array<int>"))), "places")
    discard(windows, copies)
    return out


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_words, n_removed, kept)`` of every row: ``kept`` is the kept words joined by one space.

    Null and empty texts have 0 words and an empty ``kept``; a row with a null
    id is judged by nothing and keeps all its words.
    """
    return _applied(docs, id_col, text_col, False).select("id", "n_words", "n_removed", "kept")


def dedup_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``dedup_substrings`` with the SHA-256 of the kept text in place of the text."""
    return _applied(docs, id_col, text_col, True).select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


def _applied(docs: DataFrame, id_col: str, text_col: str, digest: bool) -> DataFrame:
    places = repeated_windows(docs, id_col, text_col).withColumn("any", F.lit(True))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                n, gone, kept = [], [], []
                for text, at in zip(part.column("text").to_pylist(), part.column("places").to_pylist()):
                    removed, rest = cut_words(text, at)
                    n.append(removed + (rest.count(" ") + 1 if rest else 0))
                    gone.append(removed)
                    kept.append(hashlib.sha256(rest.encode("utf-8", "surrogatepass")).hexdigest() if digest else rest)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["id", "n_words", "n_removed", "kept"])

    marked = texts.join(places, "id", "left").withColumn("places", F.when(F.col("any").isNull(), F.array().cast("array<int>")).otherwise(F.col("places")))
    return marked.select("id", "text", "places").mapInArrow(apply, "id long, n_words long, n_removed long, kept string")
