"""Byte-pair encoding and decoding of whole texts with a vocabulary file.

The vocabulary is a ``tokenizers`` file of the word kind: lower case, white
space dropped, byte-level symbols, an end-of-word suffix.  Encoding is this
module's own: a text falls into words, and a word's parts are merged on a
contiguous array of the ranks of adjacent parts.  Each step scans the array
for its least rank (leftmost on ties), deletes the boundary there and looks
up the two ranks beside it.  The words of a batch are merged together, one
row of the array for each word; words of more than ``SHORT`` symbols are
merged one at a time with a heap instead, as scans would take quadratic time.

Results are remembered by word in a bounded table of each Python worker.

``BlockEncoder`` has the library encode instead: the words that a worker has
not met go to it in lines of many, and ids are put together by Arrow.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import chunks

SHORT = 64
#: Words that a worker remembers; the table starts anew beyond it.
MEMORY = 1 << 19
#: Characters of a text that are split into words at a time.
SEGMENT = 1 << 19
#: Characters that are split, looked up and put together at a time, and words of one line that the library gets.
BLOCK, LINE = 1 << 22, 512
#: Behind each token of a list of words; no id is as large.
BREAK = 0xFFFFFFFF
#: In front of a special token's id in a line; it is white space, so no token has it.
MARK = "\xa0"
_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
_WORD_OR_END = re.compile(_WORD.pattern + r"|\n")
#: Anything where Python's classes or NFC may differ from the library's goes to the library's own splitter.
_ODD = re.compile("[^\t-\r\x20-\x7e\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-įı-ɏ‐-‧‰-⁞]")
_GAP = re.compile(r"[ \t\n\r]")


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    out, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in out:
            out[b] = chr(extra)
            extra += 1
    return [out[b] for b in range(256)]


def segments(text: str, size: int = SEGMENT) -> Iterator[str]:
    """Whole text in pieces that start at white space, so that no word is cut."""
    a = 0
    while len(text) - a > size:
        gap = _GAP.search(text, a + size)
        b = gap.start() if gap else len(text)
        yield text[a:b]
        a = b
    yield text[a:]


class Splitter:
    """Normalisation and word splitting of the vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        spec = json.load(open(path, encoding="utf-8"))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._byte = {s: b for b, s in enumerate(byte_symbols())}

    def plain(self, text: str) -> list[str]:
        """Tokens between white space; a text with odd characters comes in the library's own pieces."""
        if text.isascii() and not any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return text.lower().split()
        if not _ODD.search(text):
            return unicodedata.normalize("NFC", text).lower().split()
        text = self.library.normalizer.normalize_str(text)
        pieces = self.library.pre_tokenizer.pre_tokenize_str(text)
        return [bytes(self._byte[c] for c in p).decode("utf-8") for p, _ in pieces]

    def has_special(self, text: str) -> bool:
        return self._special is not None and any(s in text for s in self.special)

    def tokens(self, text: str) -> list[str | int]:
        """Tokens in order; a special token's string in the text is its id."""
        if self.has_special(text):
            out: list[str | int] = []
            for k, part in enumerate(self._special.split(text)):
                out += [self.special[part]] if k % 2 else self.plain(part)
            return out
        return self.plain(text)

    def line(self, text: str) -> str:
        """``tokens`` as one text with white space between them, a special token as ``MARK`` and its id."""
        if not self.has_special(text):
            if text.isascii() and not any(c in text for c in "\x1c\x1d\x1e\x1f"):
                return text.lower()
            if not _ODD.search(text):
                return unicodedata.normalize("NFC", text).lower().replace("\xa0", " ")
        return " ".join(f"{MARK}{t}" if isinstance(t, int) else t for t in self.tokens(text))

    def pieces(self, token: str) -> list[str]:
        """The words of a token; a token with odd characters is one already, and so is one of letters."""
        if token.isascii() and token.isalpha():
            return [token]
        return [token] if _ODD.search(token) else _WORD.findall(token)


class RankMerger:
    """Ids of words by merging on contiguous rank arrays."""

    def __init__(self, path: str):
        model = json.load(open(path, encoding="utf-8"))["model"]
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        key = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.rank = key[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.none = np.int32(len(merges))
        self.inner = np.array([vocab[s] for s in byte_symbols()], np.int32)
        self.last = np.array([vocab[s + suffix] for s in byte_symbols()], np.int32)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.key, pair), len(self.key) - 1)
        return np.where((self.key[at] == pair) & (left >= 0) & (right >= 0), self.rank[at], self.none)

    def start(self, word: bytes) -> np.ndarray:
        ids = self.inner[np.frombuffer(word, np.uint8)]
        ids[-1] = self.last[word[-1]]
        return ids

    def encode(self, words: list[str]) -> list[bytes]:
        """Ids of each word as little-endian 32-bit bytes."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        out: list = [None] * len(raw)
        size = np.array([len(r) for r in raw])
        low = 0
        for high in (4, 8, 12, 16, 24, 32, SHORT):
            rows = np.flatnonzero((size > low) & (size <= high))
            for a in range(0, len(rows), 4096):
                self._table([raw[i] for i in rows[a : a + 4096]], high, rows[a : a + 4096], out)
            low = high
        for i in np.flatnonzero(size > SHORT):
            out[i] = self._long(self.start(raw[i])).astype("<u4").tobytes()
        return out

    def _table(self, raw: list[bytes], width: int, rows: np.ndarray, out: list) -> None:
        n = len(raw)
        size = np.array([len(r) for r in raw])
        part = np.full((n, width + 1), -1, np.int32)
        inside = np.arange(width + 1) < size[:, None]
        part[inside] = self.inner[np.frombuffer(b"".join(raw), np.uint8)]
        part[np.arange(n), size - 1] = self.last[[r[-1] for r in raw]]
        rank = self.ranks(part[:, :-1], part[:, 1:])
        todo, columns = np.arange(n), np.arange(width + 1)
        while len(todo):
            at = rank.argmin(axis=1)
            least = rank[np.arange(len(at)), at]
            done = least == self.none
            if done.any():
                ends = part[done]
                blob, cut = ends[ends >= 0].astype("<u4").tobytes(), [0, *(np.cumsum((ends >= 0).sum(axis=1)) * 4).tolist()]
                for k, i in enumerate(rows[todo[done]].tolist()):
                    out[i] = blob[cut[k] : cut[k + 1]]
                go = ~done
                part, rank, todo, at, least = part[go], rank[go], todo[go], at[go], least[go]
                if not len(todo):
                    return
            # delete the boundary after `at`, then refresh the ranks beside it
            row = np.arange(len(todo))
            move = np.minimum(columns + (columns > at[:, None]), width)
            part = np.take_along_axis(part, move, 1)
            part[:, width] = -1
            part[row, at] = self.made[least]
            rank = np.take_along_axis(rank, np.minimum(move[:, :-1], width - 1), 1)
            rank[:, width - 1] = self.none
            rank[row, at] = self.ranks(part[row, at], part[row, at + 1])
            before = np.maximum(at - 1, 0)
            rank[row, before] = np.where(at > 0, self.ranks(part[row, before], part[row, at]), rank[row, before])

    def _long(self, ids: np.ndarray) -> np.ndarray:
        n = len(ids)
        ids, after, before = ids.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        table = self.by_pair
        heap = [(r, i) for i in range(n - 1) if (r := table.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else n
            if j >= n or table.get((ids[i], ids[j])) != r:
                continue
            ids[i], ids[j] = int(self.made[r]), -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (x := table.get((ids[i], ids[after[i]]))) is not None:
                    heapq.heappush(heap, (x, i))
            if before[i] >= 0 and (x := table.get((ids[before[i]], ids[i]))) is not None:
                heapq.heappush(heap, (x, before[i]))
        return np.array([x for x in ids if x >= 0], np.int32)

    @property
    def by_pair(self) -> dict[tuple[int, int], int]:
        if not hasattr(self, "_pairs"):
            self._pairs = {(int(k) >> 32, int(k) & 0xFFFFFFFF): int(r) for k, r in zip(self.key, self.rank)}
        return self._pairs


class LibraryMerger:
    """Ids of words by the ``tokenizers`` library, a batch of words in one call."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        # a Spark task has one core: threads of the library's own would contend with other tasks
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        suffix = json.loads(self.library.to_str())["model"].get("end_of_word_suffix")
        last = self.library.get_vocab_size(with_added_tokens=True)
        self.closes = np.array([bool(suffix) and (self.library.id_to_token(i) or "").endswith(suffix) for i in range(last)])

    def ids(self, texts: list[str]) -> list[list[int]]:
        many = self.library.encode_batch_fast if hasattr(self.library, "encode_batch_fast") else self.library.encode_batch
        return [e.ids for e in many(texts, add_special_tokens=False)]

    def encode(self, words: list[str]) -> list[bytes]:
        ids = self.ids(words)
        blob = np.fromiter(chain.from_iterable(ids), "<u4").tobytes()
        cut = [0, *accumulate(4 * len(x) for x in ids)]
        return [blob[a:b] for a, b in pairwise(cut)]

    def encode_lines(self, words: list[str]) -> list[bytes]:
        """``encode`` of words that the splitter leaves whole, many in a line; the id with the end-of-word suffix closes each."""
        out: list[bytes] = []
        for a in range(0, len(words), 64 * LINE):
            part = words[a : a + 64 * LINE]
            ids = np.fromiter(chain.from_iterable(self.ids([" ".join(part[b : b + LINE]) for b in range(0, len(part), LINE)])), "<u4")
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) != len(part):
                out += self.encode(part)
                continue
            blob = ids.tobytes()
            out += [blob[b:c] for b, c in pairwise([0, *(4 * ends).tolist()])]
        return out


class Remembered:
    """Values of tokens from values of their words, each worked out once while it is remembered."""

    def __init__(self, path: str, words_to_values, join, of_special):
        self.splitter = Splitter(path)
        self.words_to_values, self.join, self.of_special = words_to_values, join, of_special
        self.words: dict[str, object] = {}
        self.tokens: dict[str | int, object] = {}

    def learn(self, tokens: set) -> None:
        new = [t for t in tokens if t not in self.tokens]
        if len(self.tokens) + len(new) > MEMORY:
            self.tokens.clear()
            new = list(tokens)
        split = [[] if isinstance(t, int) else self.splitter.pieces(t) for t in new]
        words = {w for ws in split for w in ws}
        ask = [w for w in words if w not in self.words]
        if len(self.words) + len(ask) > MEMORY:
            self.words.clear()
            ask = list(words)
        self.words.update(zip(ask, self.words_to_values(ask)))
        get = self.words.__getitem__
        value = lambda t, ws: get(ws[0]) if len(ws) == 1 else self.of_special(t) if isinstance(t, int) else self.join(map(get, ws))
        self.tokens.update(zip(new, map(value, new, split)))

    def batch(self, texts: list[str | None]) -> list:
        """The joined value of each text of a bounded chunk; null is empty."""
        split = [[self.splitter.tokens(s) for s in segments(t)] if t else [] for t in texts]
        self.learn({w for parts in split for part in parts for w in part})
        get = self.tokens.__getitem__
        return [self.join(self.join(map(get, part)) for part in parts) for parts in split]


class Encoder(Remembered):
    """Ids of whole texts, as little-endian 32-bit bytes while they are put together."""

    def __init__(self, path: str):
        self.merger = RankMerger(path)
        super().__init__(path, self.merger.encode, b"".join, lambda i: np.array([i], "<u4").tobytes())

    def batch(self, texts: list[str | None]) -> list[np.ndarray]:
        return [np.frombuffer(x, "<u4") for x in super().batch(texts)]


class BlockEncoder:
    """Ids of whole texts by the library, a block of texts at once.

    Arrow splits a block and numbers its different tokens.  Only these are
    looked up in Python; Arrow puts their ids together for every occurrence.
    Tokens and words are remembered as in ``Remembered``.
    """

    def __init__(self, path: str):
        self.splitter, self.merger = Splitter(path), LibraryMerger(path)
        self.words: dict[str, bytes] = {}
        self.tokens: dict[str, bytes] = {}

    def learn(self, tokens: list[str]) -> None:
        new = [t for t in tokens if t not in self.tokens]
        if len(self.tokens) + len(new) > MEMORY:
            self.tokens.clear()
            new = tokens
        text = "\n".join(new)
        if MARK in text or _ODD.search(text):
            # a token with odd characters is one piece of the library's already, and goes to it alone
            odd = [t for t in new if _ODD.search(t)]
            self.tokens.update(zip(odd, self.merger.encode(odd)))
            self.tokens.update((t, np.array([int(t[1:])], "<u4").tobytes()) for t in new if t.startswith(MARK))
            new = [t for t in new if t not in self.tokens]
            text = "\n".join(new)
        if not new:
            return
        words = _WORD_OR_END.findall(text + "\n")
        different = {*words} - {"\n"}
        ask = [w for w in different if w not in self.words]
        if len(self.words) + len(ask) > MEMORY:
            self.words.clear()
            ask = list(different)
        self.words.update(zip(ask, self.merger.encode_lines(ask)))
        self.words["\n"] = np.array([BREAK], "<u4").tobytes()
        blob = b"".join(map(self.words.__getitem__, words))
        ends = (4 * np.flatnonzero(np.frombuffer(blob, "<u4") == BREAK)).tolist()
        self.tokens.update(zip(new, (blob[a + 4 : b] for a, b in pairwise([-4, *ends]))))

    def block(self, texts: list[str]) -> list[np.ndarray]:
        # the split has an empty token where a text begins or ends with white space; it has no ids
        split = pc.ascii_split_whitespace(pa.array([self.splitter.line(t) for t in texts], pa.large_string()))
        coded = split.values.dictionary_encode()
        tokens = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        self.learn(tokens)
        values = pa.array(map(self.tokens.__getitem__, tokens), pa.large_binary()).take(coded.indices)
        ends, ids = np.frombuffer(values.buffers()[1], np.int64) // 4, np.frombuffer(values.buffers()[2] or b"", "<u4")
        return [ids[a:b] for a, b in pairwise(ends[split.offsets.to_numpy()].tolist())]

    def batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; null is empty.  A long text is taken in segments, as many as fit into a block."""
        found: list[list[np.ndarray]] = [[] for _ in texts]
        rows: list[int] = []
        held: list[str] = []
        size = 0

        def flush() -> None:
            for k, ids in zip(rows, self.block(held)):
                found[k].append(ids)
            rows.clear()
            held.clear()

        for k, text in enumerate(texts):
            for part in segments(text or ""):
                if size + len(part) > BLOCK and held:
                    flush()
                    size = 0
                rows.append(k)
                held.append(part)
                size += len(part)
        if held:
            flush()
        return [x[0] if len(x) == 1 else np.concatenate(x) for x in found]


class Decoder:
    """Texts of ids; the file names no decoder, so tokens are joined by one space."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        self.token = [library.id_to_token(i) or "" for i in range(library.get_vocab_size(with_added_tokens=True))]
        self.number = [str(i) for i in range(len(self.token))]

    def decode(self, ids: np.ndarray) -> str:
        return " ".join(map(self.token.__getitem__, ids.tolist()))

    def decimals(self, ids: np.ndarray) -> str:
        return " ".join(map(self.number.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


@lru_cache(maxsize=2)
def block_encoder(path: str) -> BlockEncoder:
    return BlockEncoder(path)


@lru_cache(maxsize=2)
def decoder(path: str) -> Decoder:
    return Decoder(path)


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids array<int>, decoded string)`` of every row.

    Null and empty texts have no ids and decode to an empty string; nulls and repeated ids of rows pass through.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, back = encoder(path), decoder(path)
        for batch in batches:
            for part in chunks(batch, "text"):
                ids = own.batch(part.column("text").to_pylist())
                cut = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = np.concatenate([*ids, np.empty(0, "<u4")]).astype(np.int32)
                columns = [part.column("doc_id"), pa.array(np.diff(cut).astype(np.int64)), pa.ListArray.from_arrays(pa.array(cut), pa.array(flat)), pa.array([back.decode(x) for x in ids], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids", "decoded"])

    return _columns(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``encode_decode`` as counts and SHA-256 digests, made where the ids are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, back = encoder(path), decoder(path)
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for batch in batches:
            for part in chunks(batch, "text"):
                ids = own.batch(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array([sha(back.decimals(x)) for x in ids]), pa.array([sha(back.decode(x)) for x in ids])],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return _columns(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _columns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
