"""Near-duplicate classes by BagMinHash over bags of five-word shingles.

Two texts are linked when the weighted Jaccard similarity of their bags of
five-word shingles is 0.8 or more; a class is a connected component of links,
named by its least document id.

1. One pass hashes each text's words and draws a BagMinHash signature: a
   shingle of weight ``w`` owns the Poisson points whose weight coordinate is
   below ``w``.  The weight axis is cut into dyadic levels ``[0,1) [1,2) [2,4)
   [4,8)...``; a level is a process of its own, and a point's position inside
   its level says whether it lies below ``w``.  Points come in ascending
   order and a process stops once it is above the signature's largest value.
   A register keeps the first point that falls to it, so two registers agree
   with exactly the probability of the weighted Jaccard similarity.
2. Texts with the same words are one copy class and go on as one text.
3. ``BANDS`` bands of ``ROWS`` registers give buckets.  Buckets never emit
   their pairs: in each leader round every bucket elects leaders, those that
   share most buckets with others, and its members meet these alone.  A
   member is compared with the leader of each foreign component that is
   nearest by two bits of each register, if the sizes allow a similarity of
   0.8 and these bits make it likely.  Members of one component need no
   further comparison.
4. What then stays apart inside a bucket is compared, whatever the bits say,
   so that no link between candidates is lost: a bucket is cut into blocks of
   about ``BLOCK`` texts, pairs of blocks are dealt over the tasks, and a task
   looks at the pairs of different components whose first common bucket this
   is.  Only links leave the task.  Blocks of the component that holds most of
   a bucket never meet each other.
5. Comparison counts common (shingle, occurrence) names of 64 bits; exact
   copies go by 128-bit names of whole word sequences.

At similarity 0.8 a pair misses all 25 bands of 5 with probability 5e-5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lodestone.shared import written
from .words import GOLD, Words, chunks, grams, mix, run_hash, whole_hash, words_of

SHINGLE, THRESHOLD, BANDS, ROWS = 5, 0.8, 25, 5
#: Leaders of a bucket in each leader round.
LEADERS = 1, 8
#: Registers whose low two bits differ in pairs that leader rounds leave to the last comparison; 18.75 differ on average at similarity 0.8, with deviation 4.
APART = 40
#: Texts of a block in the last comparison.
BLOCK = 256
BITS = [f"bit{k}" for k in range(4)]


def shingle_bags(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(text, shingle, weight)``, distinct and sorted by text; a text of one to four words is one shingle."""
    text, _, h = grams(words, SHINGLE)
    size = np.diff(words.first)
    short = np.flatnonzero((size > 0) & (size < SHINGLE))
    if len(short):
        whole = [run_hash(words.hash[words.first[d] : words.first[d + 1]], size[d], 7)[0] for d in short]
        text, h = np.concatenate([text, short]), np.concatenate([h, np.array(whole, np.uint64)])
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    return text[at], h[at], np.diff(np.append(at, len(h)))


def signatures(n: int, text: np.ndarray, shingle: np.ndarray, weight: np.ndarray, registers: int) -> np.ndarray:
    """``n x registers`` point names; rows of texts without shingles are 0."""
    parts = [(text, shingle, np.ones(len(text)), np.ones(len(text)), np.zeros(len(text), np.uint64))]
    low, level = 1, 1
    while len(more := np.flatnonzero(weight > low)):
        parts.append((text[more], shingle[more], np.full(len(more), float(low)), np.minimum(weight[more] - low, low).astype(float), np.full(len(more), level, np.uint64)))
        low, level = low * 2, level + 1
    text, shingle, rate, limit, name = (np.concatenate(x) for x in zip(*parts))
    process = mix(shingle ^ mix(name + GOLD))
    first = np.full(n * registers, np.inf)
    names = np.zeros(n * registers, np.uint64)
    t, k = np.zeros(len(text)), 0
    while len(text):
        r = mix(process + np.uint64(2 * k * int(GOLD) % (1 << 64)))
        s = mix(process + np.uint64((2 * k + 1) * int(GOLD) % (1 << 64)))
        t = t - np.log(((r >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / rate
        inside = (s & np.uint64(0xFFFFFFFF)).astype(float) * rate < limit * 2.0**32
        slot = text * registers + ((s >> np.uint64(32)) % np.uint64(registers)).astype(np.int64)
        inside &= t < first[slot]
        at, when, who = slot[inside], t[inside], r[inside]
        np.minimum.at(first, at, when)
        won = first[at] == when
        names[at[won]] = who[won]
        worst = first.reshape(n, registers).max(axis=1)
        stay = t < worst[text]
        text, process, rate, limit, t = text[stay], process[stay], rate[stay], limit[stay], t[stay]
        k += 1
    return names.reshape(n, registers)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, "text"):
            words = words_of(part.column("text"))
            n, size = part.num_rows, np.diff(words.first)
            names = signatures(n, *shingle_bags(words), BANDS * ROWS)
            bands = np.empty((n, BANDS), np.uint64)
            for b in range(BANDS):
                x = np.full(n, b + 1, np.uint64)
                for row in range(ROWS):
                    x = mix((x + GOLD) ^ names[:, b * ROWS + row])
                bands[:, b] = x
            whole = whole_hash(words)
            low = np.zeros((n, 128), np.uint64)
            low[:, : BANDS * ROWS] = names & np.uint64(3)
            bits = (low.reshape(n, 4, 32) << (2 * np.arange(32, dtype=np.uint64))).sum(axis=2, dtype=np.uint64).view(np.int64)
            flat = pa.array(bands.reshape(-1).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(size), pa.array(whole[0]), pa.array(whole[1]), pa.ListArray.from_arrays(pa.array(np.arange(0, n * BANDS + 1, BANDS, dtype=np.int32)), flat), *(pa.array(np.ascontiguousarray(bits[:, k])) for k in range(4))],
                names=["id", "n_words", "h1", "h2", "bands", *BITS],
            )


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted unique 64-bit names of (shingle, occurrence): set overlap of names is bag overlap."""
    for batch in batches:
        for part in chunks(batch, "text"):
            text, h, w = shingle_bags(words_of(part.column("text")))
            turn = np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w)
            atom = mix(np.repeat(h, w) + turn.astype(np.uint64) * GOLD)
            cut = np.searchsorted(np.repeat(text, w), np.arange(part.num_rows + 1))
            bags = [np.sort(atom[a:b]).tobytes() for a, b in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(bags, pa.binary())], names=["id", "bag"])


def _hashed(text_col: str, names: tuple[str, str]):
    """Rows as they are, with the two halves of their text's whole hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text_col):
                h1, h2 = whole_hash(words_of(part.column(text_col)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(h1), pa.array(h2)], names=[*part.schema.names, *names])

    return run


def _similar(a: np.ndarray, b: np.ndarray) -> bool:
    if min(len(a), len(b)) < THRESHOLD * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= THRESHOLD * (len(a) + len(b) - both) - 1e-9


def _overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = batch.column("bag_a"), batch.column("bag_b")
        keep = []
        for k in range(batch.num_rows):
            if _similar(np.frombuffer(x[k].as_buffer(), np.uint64), np.frombuffer(y[k].as_buffer(), np.uint64)):
                keep.append(k)
        yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))


def components(links: DataFrame) -> DataFrame:
    """``(id, label)`` for every end of ``links(a, b)``: label is the least id of its component.

    Each round takes the least label among neighbours and then the label's own
    label, both written out; the number of rounds follows the logarithm of the
    longest path.
    """
    both = written(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, F.col("id") == F.col("a"), "left").select("id", F.least("label", F.coalesce("near", "label")).alias("new"), F.col("label").alias("old"))
        jump = step.select(F.col("id").alias("to"), F.col("new").alias("far"))
        step = step.join(jump, F.col("new") == F.col("to"), "left").select("id", F.least("new", F.coalesce("far", "new")).alias("label"), "old")
        step = written(step, "labels")
        if not step.filter("label <> old").limit(1).count():
            return step.select("id", "label")
        labels = step.select("id", "label")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per distinct non-null id: ``id, class_id, copy_of``.

    ``class_id`` is the least id of the class, ``copy_of`` the least id with
    the same words.  Texts without words (null, empty, white space) are
    never linked and name themselves.  Rows with a null id have no result.
    Of rows that repeat an id, the one of the least content hash (of its words)
    stands for it.  An empty table gives an
    empty result; other columns are not read.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id is not null")
    sketch = written(texts.mapInArrow(_sketches, "id long, n_words long, h1 long, h2 long, bands array<long>, bit0 long, bit1 long, bit2 long, bit3 long"), "sketch")
    several = sketch.groupBy("id").agg(F.count("*").alias("n"), F.min(F.struct("h1", "h2")).alias("h")).filter("n > 1")
    several = written(several.select("id", F.col("h.h1").alias("k1"), F.col("h.h2").alias("k2")), "several")
    if several.limit(1).count():
        least = (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2"))
        sketch = written(sketch.join(several, "id", "left").filter(F.col("k1").isNull() | least).drop("k1", "k2").dropDuplicates(["id"]), "sketch")
        odd = texts.join(several.select("id"), "id", "left_semi").mapInArrow(_hashed("text", ("h1", "h2")), "id long, text string, h1 long, h2 long")
        texts = texts.join(several, "id", "left_anti").union(odd.join(several, "id").filter(least).select("id", "text").dropDuplicates(["id"]))
    copies = sketch.filter("n_words > 0").groupBy("h1", "h2").agg(F.min("id").alias("copy_of"))
    named = written(sketch.select("id", "h1", "h2", "n_words").join(copies, ["h1", "h2"], "left").select("id", F.when(F.col("n_words") > 0, F.col("copy_of")).otherwise(F.col("id")).alias("copy_of")), "copies")

    single = copies.select(F.col("copy_of").alias("id"))
    alone = sketch.filter("n_words > 0").join(single, "id", "left_semi")
    entries = written(alone.select("id", F.explode("bands").alias("key")).distinct(), "entries")
    shared = entries.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    live = written(entries.join(shared, "key"), "live")
    degree = written(live.groupBy("id").agg(F.sum("n").alias("degree")), "degree")
    traits = sketch.join(degree, "id").select("id", "degree", F.greatest(F.lit(1), F.col("n_words") - SHINGLE + 1).alias("size"), *BITS)
    bands = written(alone.join(degree.select("id"), "id", "left_semi").select("id", "bands"), "bands")
    live = written(live.select("key", "id").join(traits, "id"), "live")
    bags = written(texts.join(degree.select("id"), "id", "left_semi").mapInArrow(_bags, "id long, bag binary"), "bags")
    label = _linked(live, bands, bags)
    out = named.join(label.select(F.col("id").alias("copy_of"), "label"), "copy_of", "left")
    return out.select("id", F.coalesce("label", "copy_of").alias("class_id"), "copy_of")


def _verified(pairs: DataFrame, bags: DataFrame) -> DataFrame:
    a = bags.select(F.col("id").alias("a"), F.col("bag").alias("bag_a"))
    b = bags.select(F.col("id").alias("b"), F.col("bag").alias("bag_b"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "bag_a", "bag_b").mapInArrow(_overlap, "a long, b long")


def _named(side: str, df: DataFrame) -> DataFrame:
    return df.select("key", *(F.col(c).alias(f"{c}_{side}") for c in ("id", "label", "size", *BITS)))


def _met(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(a, b, label_b, apart)``: members of a bucket in different components that may be similar."""
    apart = sum((F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555))) for x in (F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b")) for c in BITS)), F.lit(0))
    alike = F.least("size_a", "size_b") >= THRESHOLD * F.greatest("size_a", "size_b")
    found = _named("a", left).join(_named("b", right), "key").filter("label_a <> label_b").filter(alike).filter(apart <= APART)
    return found.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), "label_b", apart.alias("apart"))


def _nearest(met: DataFrame) -> DataFrame:
    best = met.groupBy("a", "label_b").agg(F.min(F.struct("apart", "b")).alias("x"))
    return best.select(F.least("a", "x.b").alias("a"), F.greatest("a", "x.b").alias("b"))


def _apart(now: DataFrame, bands: DataFrame, bags: DataFrame) -> DataFrame:
    """``(a, b)``: links between components of the entries ``now``, as their labels."""
    most = now.groupBy("key", "label").count().groupBy("key").agg(F.max(F.struct("count", "label")).alias("x")).select("key", F.col("x.label").alias("most"))
    marked = now.join(most, "key").withColumn("minor", F.col("label") != F.col("most"))
    blocks = lambda c: F.ceil(F.count_if(c) / BLOCK).alias
    cut = marked.groupBy("key").agg(blocks(F.col("minor"))("minors"), blocks(~F.col("minor"))("majors"))
    own = F.when(F.col("minor"), F.pmod(F.xxhash64("id"), F.col("minors"))).otherwise(F.col("minors") + F.pmod(F.xxhash64("id"), F.col("majors")))
    every = F.when(F.col("minor"), F.sequence(F.lit(0), F.col("minors") + F.col("majors") - 1)).otherwise(F.sequence(F.lit(0), F.col("minors") - 1))
    pairs = marked.join(cut, "key").withColumn("block", own).withColumn("other", F.explode(every))
    sent = pairs.select("key", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "id", "label", "size", *BITS).join(bands, "id").join(bags, "id")
    n = int(now.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sent.repartition(n, "key", "p", "q").sortWithinPartitions("key", "p", "q").mapInArrow(_block_links, "a long, b long").distinct()


def _block_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links inside each run of rows of equal ``key, p, q``; the last run of a batch waits for the next."""
    held: pa.Table | None = None

    def linked(table: pa.Table, last: bool) -> tuple[pa.RecordBatch, pa.Table | None]:
        names = np.column_stack([table[c].to_numpy() for c in ("key", "p", "q")])
        cuts = [0, *(np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1).tolist(), len(names)]
        ends = cuts if last else cuts[:-1]
        found = [x for a, b in zip(ends, ends[1:]) for x in _run_links(table.slice(a, b - a))]
        out = pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], names=["a", "b"])
        return out, None if last else table.slice(ends[-1])

    for batch in batches:
        if batch.num_rows:
            table = pa.Table.from_batches([batch])
            out, held = linked(pa.concat_tables([held, table]) if held is not None else table, False)
            yield out
    if held is not None:
        yield linked(held, True)[0]


def _run_links(rows: pa.Table) -> list[tuple[int, int]]:
    """Links between the labels of one pair of blocks; labels that these links already join are not compared again."""
    rows = rows.combine_chunks()
    get = lambda c: rows[c].to_numpy()
    label, size, block = get("label"), get("size"), get("block")
    if label.min() == label.max():
        return []
    x = np.column_stack([get(c) for c in BITS]).view(np.uint64)
    bands = np.asarray(rows["bands"].combine_chunks().flatten()).reshape(len(label), BANDS)
    bag = rows["bag"]
    key, same_block = get("key")[0], get("p")[0] == get("q")[0]
    todo = []
    for i in range(len(label) - 1):
        ok = (label[i + 1 :] != label[i]) & (np.minimum(size[i + 1 :], size[i]) >= THRESHOLD * np.maximum(size[i + 1 :], size[i]))
        if not same_block:
            ok &= block[i + 1 :] != block[i]
        at = np.flatnonzero(ok) + i + 1
        diff = x[at] ^ x[i]
        apart = np.bitwise_count((diff | (diff >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum(axis=1)
        common = bands[at] == bands[i]
        here = bands[i][common.argmax(axis=1)] == key
        todo += zip(apart[here].tolist(), [i] * int(here.sum()), at[here].tolist())
    root = {int(v): int(v) for v in np.unique(label)}

    def find(v: int) -> int:
        while root[v] != v:
            root[v] = v = root[root[v]]
        return v

    out = []
    atoms = {k: np.frombuffer(bag[k].as_buffer(), np.uint64) for k in {k for _, i, j in todo for k in (i, j)}}
    for _, i, j in sorted(todo):
        u, v = find(int(label[i])), find(int(label[j]))
        if u != v and _similar(atoms[i], atoms[j]):
            root[max(u, v)] = min(u, v)
            out.append((int(label[i]), int(label[j])))
    return out


def _linked(live: DataFrame, bands: DataFrame, bags: DataFrame) -> DataFrame:
    """``(id, label)`` of every id of ``live`` that has a link."""
    spark = live.sparkSession
    label = spark.createDataFrame([], "id long, label long")
    seen = spark.createDataFrame([], "a long, b long")

    def state() -> DataFrame:
        """Entries of the buckets that hold more than one component."""
        named = live.join(label, "id", "left").withColumn("label", F.coalesce("label", "id"))
        split = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("key")
        return written(named.join(split, "key", "left_semi"), "state")

    def compare(pairs: DataFrame) -> None:
        nonlocal seen
        pairs = written(pairs.distinct().join(seen, ["a", "b"], "left_anti"), "pairs")
        if not pairs.limit(1).count():
            return
        seen = written(seen.union(pairs), "seen")
        found = _verified(pairs, bags)
        join(found.join(label.toDF("a", "la"), "a", "left").join(label.toDF("b", "lb"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")))

    def join(found: DataFrame) -> None:
        """Merge components along links between their labels."""
        nonlocal label
        merged = components(written(found.filter("a <> b").distinct(), "links"))
        old = label.join(merged.toDF("label", "to"), "label", "left").select("id", F.coalesce("to", "label").alias("label"))
        label = old.union(merged.join(label.select("id"), "id", "left_anti"))
        label = written(label.groupBy("id").agg(F.min("label").alias("label")), "label")

    for n in LEADERS:
        now = live.withColumn("label", F.col("id")) if n == 1 else state()
        turn = F.pmod(F.xxhash64("id"), F.lit(n))
        lead = now.groupBy("key", turn.alias("turn")).agg(F.max(F.struct("degree", (-F.col("id")).alias("minus"), "label", "size", *BITS)).alias("x"))
        lead = lead.select("key", (-F.col("x.minus")).alias("id"), "x.label", "x.size", *(f"x.{c}" for c in BITS))
        compare(_nearest(_met(now, written(lead, "lead"))))
    join(_apart(state(), bands, bags))
    return label


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each near-duplicate class, the least id; columns unchanged.

    Rows with a null id stay.  Of rows that repeat a kept id, that of the least
    content hash stays, the one that ``near_classes`` has judged.
    """
    keep = near_classes(docs, id_col, text_col).filter("id = class_id").select(F.col("id").alias(id_col))
    with_id = docs.filter(F.col(id_col).isNotNull())
    repeated = with_id.groupBy(id_col).count().filter("count > 1").select(id_col)
    if repeated.limit(1).count():
        names = [f"{c}{'_' * max(map(len, docs.columns))}" for c in ("h1", "h2")]
        hashed = with_id.join(repeated, id_col, "left_semi").mapInArrow(_hashed(text_col, (names[0], names[1])), StructType([*with_id.schema.fields, *(StructField(c, LongType()) for c in names)]))
        one = hashed.groupBy(F.col(id_col).alias("key")).agg(F.min_by(F.struct(*(F.col(c) for c in docs.columns)), F.struct(*names)).alias("row")).select("row.*")
        with_id = with_id.join(repeated, id_col, "left_anti").select(docs.columns).union(one)
    return with_id.join(keep, id_col, "left_semi").select(docs.columns).union(docs.filter(F.col(id_col).isNull()))
