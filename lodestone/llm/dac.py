"""Token ids in directly addressable code files.

An id is cut into chunks of ``WIDTH`` bits.  Level 0 holds the lowest chunk of
every token, level 1 the next chunk of those that go on, and so on.  Beside
each level's chunks stands a bitmap that says which tokens go on, and a rank
directory with the number of set bits before every ``BLOCK`` bits.  Token
``i`` is read by following it from level to level, its place in the next one
being the rank of its bit: no block is decoded (Brisaboa, Ladra, Navarro).

File, little-endian: magic ``LDAC0001``; documents, tokens, levels as u64;
document ids as i64; token offsets of documents as u64 (one more than there
are documents); then per level its length as u64, chunks as u8, bitmap bytes
and directory as u64.

Files are written by tasks into the shared folder, under a name of the
attempt first and then moved, so a task that runs again replaces its file.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import BLOCK as TEXT_BLOCK, block_encoder
from lodestone.shared import new_path, written
from .words import chunks

MAGIC, WIDTH, BLOCK, END = b"LDAC0001", 8, 512, 1
#: Tokens of a file, but for one longer document.
FILE_TOKENS = 4 << 20


def pack(ids: np.ndarray, documents: np.ndarray, offsets: np.ndarray) -> bytes:
    """The file of some documents: ``ids[offsets[k]:offsets[k+1]]`` are those of document ``k``."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = (rest >> WIDTH) > 0
        bits = np.packbits(more, bitorder="little")
        ones = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.uint64) if len(more) else np.empty(0, np.uint64)
        rank = np.concatenate([np.zeros(1, np.uint64), np.cumsum(ones, dtype=np.uint64)])
        levels.append(np.uint64(len(rest)).tobytes() + (rest & ((1 << WIDTH) - 1)).astype(np.uint8).tobytes() + bits.tobytes() + rank.astype("<u8").tobytes())
        if not more.any():
            break
        rest = rest[more] >> WIDTH
    head = np.array([len(documents), len(ids), len(levels)], "<u8")
    return b"".join([MAGIC, head.tobytes(), documents.astype("<i8").tobytes(), offsets.astype("<u8").tobytes(), *levels])


class DacFile:
    """A file's content: ``documents``, ``offsets``, any token, or all of them."""

    def __init__(self, content: bytes | memoryview):
        if bytes(content[:8]) != MAGIC:
            raise ValueError("not a directly addressable code file")
        n, self.tokens, levels = (int(x) for x in np.frombuffer(content, "<u8", 3, 8))
        at = 32
        self.documents = np.frombuffer(content, "<i8", n, at)
        self.offsets = np.frombuffer(content, "<u8", n + 1, at + 8 * n).astype(np.int64)
        at += 8 * n + 8 * (n + 1)
        self.levels = []
        for _ in range(levels):
            size = int(np.frombuffer(content, "<u8", 1, at)[0])
            at += 8
            value = np.frombuffer(content, np.uint8, size, at)
            bits = np.frombuffer(content, np.uint8, -(-size // 8), at + size)
            at += size + len(bits)
            rank = np.frombuffer(content, "<u8", -(-size // BLOCK) + 1, at)
            at += 8 * len(rank)
            self.levels.append((value, bits, rank))

    def token(self, i: int) -> int:
        """Token ``i`` of the file, in time of its number of chunks."""
        if not 0 <= i < self.tokens:
            raise IndexError(i)
        out = 0
        for k, (value, bits, rank) in enumerate(self.levels):
            out |= int(value[i]) << (WIDTH * k)
            if not bits[i >> 3] >> (i & 7) & 1:
                return out
            block = i // BLOCK
            inside = np.unpackbits(bits[block * BLOCK // 8 : (i >> 3) + 1], bitorder="little")[: i - block * BLOCK]
            i = int(rank[block]) + int(inside.sum())
        raise ValueError("a token goes on beyond the last level")

    def all(self) -> np.ndarray:
        higher = np.empty(0, np.uint32)
        for value, bits, _ in reversed(self.levels):
            out = np.zeros(len(value), np.uint32)
            out[np.unpackbits(bits, count=len(value), bitorder="little").view(bool)] = higher << np.uint32(WIDTH)
            out |= value
            higher = out
        return higher


def _put(folder: str, name: str, content: bytes) -> None:
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    attempt = f"{root}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(attempt) as f:
        f.write(content)
    fs.move(attempt, f"{root}/{name}")


def write_files(docs: DataFrame, path: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, end each with id 1, and write files in ascending id order.

    Returns ``(part, file, path, documents, tokens, start)`` for each file;
    ``start`` counts the tokens of all files before it.  Null and empty texts
    are the end id alone; rows with a null id come first, under the least id.
    An empty table writes no file.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "dac")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, k = block_encoder(path), TaskContext.get().partitionId(), 0
        documents: list[int] = []
        held: list[np.ndarray] = []
        size, end = 0, np.array([END], np.uint32)

        def flush() -> pa.RecordBatch:
            nonlocal documents, held, size, k
            name = f"part-{part:06d}-{k:06d}.dac"
            counts = np.array([len(x) + 1 for x in held], np.int64)
            offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])
            ids = np.concatenate([y for x in held for y in (x, end)])
            _put(folder, name, pack(ids, np.array(documents, np.int64), offsets))
            row = [[part], [k], [f"{folder}/{name}"], [len(documents)], [len(ids)]]
            documents, held, size, k = [], [], 0, k + 1
            return pa.RecordBatch.from_arrays([pa.array(x) for x in row], names=["part", "file", "path", "documents", "tokens"])

        for batch in batches:
            for piece in chunks(batch, "text", TEXT_BLOCK):
                for doc, ids in zip(piece.column("id").to_pylist(), own.batch(piece.column("text").to_pylist())):
                    documents.append(np.iinfo(np.int64).min if doc is None else doc)
                    held.append(ids)
                    size += len(ids) + 1
                    if size >= FILE_TOKENS:
                        yield flush()
        if documents:
            yield flush()

    # bounds come from the ids alone; a range partitioning would read the texts once more for its sample
    found = texts.agg(F.percentile_approx("id", [k / n for k in range(1, n)], 100 * n).alias("b")).first()["b"] if n > 1 else []
    bounds = F.array(*(F.lit(b) for b in sorted(set(found or [])))).cast("array<long>")
    place = F.when(F.col("id").isNull(), 0).otherwise(F.size(F.filter(bounds, lambda b: b < F.col("id"))))
    ranged = texts.withColumn("place", place.cast("int")).repartitionById(n, F.col("place")).sortWithinPartitions("id").select("id", "text")
    files = written(ranged.mapInArrow(write, "part long, file long, path string, documents long, tokens long"), "files")
    # one sum for each partition of the write, a number set by configuration
    sums = sorted((r["part"], r["n"]) for r in files.groupBy("part").agg(F.sum("tokens").alias("n")).collect())
    starts, total = [], 0
    for part, tokens in sums:
        starts.append((part, total))
        total += tokens
    before = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    base = spark.createDataFrame(starts, "part long, base long")
    return files.join(base, "part").select("part", "file", "path", "documents", "tokens", (F.col("base") + F.coalesce(F.sum("tokens").over(before), F.lit(0))).alias("start"))


def _content(path: str) -> bytes:
    fs, name = pafs.FileSystem.from_uri(path)
    with fs.open_input_file(name) as f:
        return f.read()


def read_digests(files: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of each document, from the files."""
    spark = files.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                f = DacFile(_content(path))
                ids = f.all().astype("<u4").tobytes()
                crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(f.offsets, f.offsets[1:])]
                least = np.iinfo(np.int64).min
                doc = pa.array(f.documents, mask=f.documents == least)
                yield pa.RecordBatch.from_arrays([doc, pa.array(start + f.offsets[:-1]), pa.array(np.diff(f.offsets)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.select("path", "start").repartition(n).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_at(read_at, i: int) -> int:
    """Token ``i`` of a file by ranges of it: ``read_at(count, offset)`` gives bytes.

    The head, and for each level of the token its length, one chunk, one word
    of the rank directory and at most one block of the bitmap are read.
    """
    word = lambda offset: int.from_bytes(read_at(8, offset), "little")
    if read_at(8, 0) != MAGIC:
        raise ValueError("not a directly addressable code file")
    n, tokens, levels = word(8), word(16), word(24)
    if not 0 <= i < tokens:
        raise IndexError(i)
    at, out = 32 + 8 * n + 8 * (n + 1), 0
    for k in range(levels):
        size = word(at)
        chunk, bits, rank = at + 8, at + 8 + size, at + 8 + size + -(-size // 8)
        out |= read_at(1, chunk + i)[0] << (WIDTH * k)
        first = i // BLOCK * BLOCK // 8
        block = read_at((i >> 3) - first + 1, bits + first)
        if not block[-1] >> (i & 7) & 1:
            return out
        before = int.from_bytes(block, "little") & ((1 << (i - first * 8)) - 1)
        i = word(rank + 8 * (i // BLOCK)) + before.bit_count()
        at = rank + 8 * (-(-size // BLOCK) + 1)
    raise ValueError("a token goes on beyond the last level")


def read_token(files: DataFrame, position: int) -> int:
    """The token at a place of the whole sequence, from a few short ranges of one file; a place outside is an ``IndexError``."""
    row = files.filter((F.col("start") <= position) & (F.col("start") + F.col("tokens") > position)).select("path", "start").first()
    if row is None:
        raise IndexError(position)
    fs, name = pafs.FileSystem.from_uri(row["path"])
    with fs.open_input_file(name) as f:
        return token_at(f.read_at, position - row["start"])
