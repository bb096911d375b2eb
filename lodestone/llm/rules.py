"""Quality rules by robust multivariate outliers.

Every document has a vector of transformed statistics.  For each language
and source a minimum-covariance-determinant estimate describes the bulk of
its documents; a document far from it in Mahalanobis distance is rejected.

The estimates are those of the fast algorithm (Rousseeuw and Van Driessen,
1999) with deterministic starts.  A concentration step keeps in each group
the half of least distance and takes its mean and covariance, which never
raises the determinant.  Two steps are run from each of three starts around
the medians; the start of least determinant goes on until the determinant
stops falling, by the parameter ``fall``.  Distances are then scaled so that their median is that of the
chi-squared distribution, the consistency factor of that paper, and cut at
the share 0.99999 of it.  The core is half, so that less than half of a group,
however far and however close together, does not enter it.  Documents with
the same statistics, such as copies, count once in the estimates.

All documents enter the estimates.  A step is one pass of sums for each group
and narrow bin of distance, combined before they are shuffled, so a group may
hold any share of the rows; the bin where the half ends enters by the part of
it that is needed.  Medians are taken the same way: the least value of the
narrow bin where half of the rows is reached, which no order of rows or tasks
changes, and which is exact where the bin holds one value.

Two parameters are part of the method.  Variances below ``floor`` (least
standard deviations of the axes) are raised to it, so that constant columns do
not make a covariance singular.  Groups of fewer than ``least`` different
usable documents are too small for an estimate of their own and use that of
their language, and languages of fewer that of all documents; documents
without language or source form groups of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import COUNTS, text_stats
from lodestone.shared import written
from .words import chunks

CORE, LEAST = 0.5, 200
#: Bins of distance in a doubling of it, and steps that every start gets.
BINS, FIRST_STEPS = 32, 2
#: Shapes that are broadcast at most, about 200 bytes each; more are joined by a shuffle.
BROADCAST_ROWS = 50_000
#: Bins of a unit, or of a doubling of distance, that medians are taken in.
FINE = 1024
#: Concentration goes on while the logarithm of the determinant falls by more than this.
FALL = 1e-6
#: Chi-squared values of five degrees of freedom: the median and the share 0.99999.
MIDDLE, CUT = 4.3515, 30.856
AXES = [f"x{k}" for k in range(5)]
SHAPE = [*(f"m{i}" for i in range(5)), *(f"v{i}{j}" for i in range(5) for j in range(i, 5))]
#: Least standard deviation of each axis, so that a constant one does not make the rest singular.
FLOOR = [0.2, 0.3, 0.3, 0.8, 0.3]
MIN_WORDS, MAX_REPEAT = 50, 50


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keys: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """``doc_id``, group keys and all counts of every row; null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                counts = text_stats(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(part.column(f"g{k}") for k in range(len(keys))), *(pa.array(np.ascontiguousarray(counts[:, k])) for k in range(len(COUNTS)))], names=["doc_id", *(f"g{k}" for k in range(len(keys))), *COUNTS])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), *(F.col(k).cast("string").alias(f"g{i}") for i, k in enumerate(keys)), F.col(text_col).cast("string").alias("text"))
    groups = "".join(f"g{k} string, " for k in range(len(keys)))
    return picked.mapInArrow(run, f"doc_id long, {groups}" + ", ".join(f"{c} long" for c in COUNTS))


def axes() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    rate = lambda c: F.log1p(100 * F.col(c) / n)
    return [F.log1p("n_words"), F.col("word_chars") / n, rate("n_symbols"), rate("n_repeat_words"), F.log1p(F.col("n_words") / F.greatest(F.col("n_lines"), F.lit(1)))]


def _failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))


def _shape(sums: DataFrame, floor: list[float]) -> DataFrame:
    """Mean, inverse covariance and log determinant of each group and start from its sums, a few numbers a group."""
    d, units = len(AXES), np.outer(floor, floor)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = {k: np.asarray(batch.column(k).to_numpy(zero_copy_only=False), float) for k in batch.schema.names if k not in ("group", "start")}
            out = {k: [] for k in ["logdet", *SHAPE]}
            for r in range(batch.num_rows):
                n = max(x["n"][r], 1e-9)
                mean = np.array([x[f"s{i}"][r] for i in range(d)]) / n
                cov = np.zeros((d, d))
                for i in range(d):
                    for j in range(i, d):
                        cov[i, j] = cov[j, i] = x[f"p{i}{j}"][r] / n - mean[i] * mean[j]
                values, vectors = np.linalg.eigh(cov / units)
                values = np.maximum(values, 1.0)
                inverse = (vectors / values) @ vectors.T / units
                out["logdet"].append(np.log(values).sum())
                for i in range(d):
                    out[f"m{i}"].append(mean[i])
                    for j in range(i, d):
                        out[f"v{i}{j}"].append(inverse[i, j] * (1 if i == j else 2))
            yield pa.RecordBatch.from_arrays([batch.column("group"), batch.column("start"), *(pa.array(v, pa.float64()) for v in out.values())], names=["group", "start", *out])

    return sums.mapInArrow(run, "group string, start int, logdet double, " + ", ".join(f"{c} double" for c in SHAPE))


def _distance() -> Column:
    d = len(AXES)
    diff = [F.col(f"x{i}") - F.col(f"m{i}") for i in range(d)]
    return sum((F.col(f"v{i}{j}") * diff[i] * diff[j] for i in range(d) for j in range(i, d)), F.lit(0.0))


def _small(table: DataFrame) -> DataFrame:
    """A written table of a few rows a group, broadcast if it is counted to be small."""
    return F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table


def _moments() -> list[Column]:
    d = len(AXES)
    return [F.count("*").cast("double").alias("n"), *(F.sum(f"x{i}").alias(f"s{i}") for i in range(d)), *(F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}{j}") for i in range(d) for j in range(i, d))]


_SUMS = ["n", *(f"s{i}" for i in range(5)), *(f"p{i}{j}" for i in range(5) for j in range(i, 5))]


def _halves(binned: DataFrame) -> DataFrame:
    """Sums of the share ``CORE`` of least distance of each group and start, from sums of each bin."""
    own = Window.partitionBy("group", "start")
    upto = own.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    part = binned.withColumns({"need": CORE * F.sum("n").over(own), "cum": F.sum("n").over(upto)})
    share = F.least(F.greatest((F.col("need") - (F.col("cum") - F.col("n"))) / F.col("n"), F.lit(0.0)), F.lit(1.0))
    return part.withColumn("share", share).groupBy("group", "start").agg(*(F.sum(F.col(c) * F.col("share")).alias(c) for c in _SUMS))


def _bin(distance: Column) -> Column:
    return F.floor(F.log2(F.greatest(distance, F.lit(1e-6))) * BINS).cast("int")


def _medians(rows: DataFrame, values: list[Column], names: list[str], bins: Callable[[Column], Column]) -> DataFrame:
    """The lower median of each value in each group, from counts of narrow bins."""
    parts = [F.struct(F.lit(k).alias("k"), v.alias("value"), bins(v).alias("fine")) for k, v in enumerate(values)]
    counted = rows.select("group", F.inline(F.array(*parts))).groupBy("group", "k", "fine").agg(F.count("*").alias("n"), F.min("value").alias("value"))
    own = Window.partitionBy("group", "k")
    upto = own.orderBy("fine").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = counted.withColumns({"all": F.sum("n").over(own), "cum": F.sum("n").over(upto)}).filter(2 * F.col("cum") >= F.col("all"))
    return reached.groupBy("group").agg(*(F.min_by(F.when(F.col("k") == k, F.col("value")), F.when(F.col("k") == k, F.col("fine"))).alias(name) for k, name in enumerate(names)))


def _even(value: Column) -> Column:
    return F.floor(value * FINE)


def _doubling(distance: Column) -> Column:
    return F.floor(F.log2(F.greatest(distance, F.lit(1e-6))) * FINE)


def _step(rows: DataFrame, shape: DataFrame, floor: list[float]) -> DataFrame:
    """One concentration step of every group and start of ``shape``."""
    measured = rows.join(_small(shape), "group").withColumn("bin", _bin(_distance()))
    return written(_shape(_halves(measured.groupBy("group", "start", "bin").agg(*_moments())), floor), "shape")


def _starts(rows: DataFrame, floor: list[float]) -> DataFrame:
    """First shape of each group and start: rows drawn in towards the median by their median absolute deviations.

    Start 0 bends each axis by its hyperbolic tangent, start 1 puts every row
    at one distance, and start 2 takes the half of least distance as it is.
    """
    centre = written(_medians(rows, [F.col(x) for x in AXES], [f"c{i}" for i in range(len(AXES))], _even), "centre")
    centred = rows.join(_small(centre), "group")
    spread = written(_medians(centred, [F.abs(F.col(x) - F.col(f"c{i}")) for i, x in enumerate(AXES)], [f"d{i}" for i in range(len(AXES))], _even), "spread")
    unit = [F.greatest(1.4826 * F.col(f"d{i}"), F.lit(floor[i])) for i in range(len(AXES))]
    z = [(F.col(x) - F.col(f"c{i}")) / unit[i] for i, x in enumerate(AXES)]
    scaled = centred.join(_small(spread), "group").withColumn("distance", sum((F.pow(c, 2) for c in z), F.lit(0.0)))
    length = F.greatest(F.sqrt("distance"), F.lit(1e-9)) / len(AXES) ** 0.5
    drawn = [[F.tanh(c) for c in z], [c / length for c in z]]
    parts = [F.struct(F.lit(k).alias("start"), F.lit(0).alias("bin"), *((F.col(f"c{i}") + unit[i] * c).alias(x) for i, (x, c) in enumerate(zip(AXES, cs)))) for k, cs in enumerate(drawn)]
    parts.append(F.struct(F.lit(len(drawn)).alias("start"), _bin(F.col("distance")).alias("bin"), *(F.col(x) for x in AXES)))
    binned = scaled.select("group", F.inline(F.array(*parts))).groupBy("group", "start", "bin").agg(*_moments())
    # drawn rows are one bin and all of them count
    whole = binned.filter("bin = 0 and start < 2").select("group", "start", *_SUMS)
    return written(_shape(whole.union(_halves(binned.filter("start = 2")).select("group", "start", *_SUMS)), floor), "start")


def _least(shapes: DataFrame) -> DataFrame:
    return shapes.groupBy("group").agg(F.min_by(F.struct(*shapes.columns[1:]), F.struct("logdet", "start")).alias("s")).select("group", "s.*")


def estimates(rows: DataFrame, floor: list[float] = FLOOR, fall: float = FALL) -> DataFrame:
    """Shape of each ``group`` of ``rows(group, x0..)``, and ``scale``, its median distance over the expected one.

    The number of steps is bounded only by the determinant, which has a least value.
    """
    shape = _starts(rows, floor)
    for _ in range(FIRST_STEPS):
        shape = _step(rows, shape, floor)
    best = shape = written(_least(shape), "shape")
    while shape.limit(1).count():
        new = _step(rows, shape, floor)
        last = shape.select("group", F.col("logdet").alias("before"))
        shape = written(new.join(last, "group").filter(F.col("logdet") < F.col("before") - fall).select(*new.columns), "shape")
        best = written(_least(best.union(shape)), "best")
    middle = _medians(rows.join(_small(best), "group"), [_distance()], ["middle"], _doubling)
    return written(best.join(middle, "group").withColumn("scale", F.greatest(F.col("middle") / MIDDLE, F.lit(0.05))).drop("start", "logdet"), "estimates")


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keys: tuple[str, str] = ("lang", "source"), least: int = LEAST, floor: list[float] = FLOOR, fall: float = FALL) -> DataFrame:
    """Counts, ``base_failed``, ``distance`` and ``kept`` of every row.

    Rows that fail the base rules (null, empty and short texts among them)
    take no part in the estimates.  Rows with a null or repeated id are
    judged like others.  Where no document passes the base rules nothing is
    kept; an empty table gives an empty result.
    """
    all_rows = written(statistics(docs, id_col, text_col, keys), "statistics")
    all_rows = all_rows.withColumn("base_failed", _failed()).withColumns(dict(zip(AXES, axes())))
    lang = F.concat(F.lit("1:"), F.coalesce(F.to_json(F.struct("g0")), F.lit("")))
    pair = F.concat(F.lit("2:"), F.coalesce(F.to_json(F.struct("g0", "g1")), F.lit("")))
    named = all_rows.withColumns({"lang_group": lang, "pair_group": pair})
    usable = named.filter(~F.col("base_failed")).select("pair_group", "lang_group", *AXES).distinct()
    large_pairs = written(usable.groupBy("pair_group").count().filter(F.col("count") >= least).select("pair_group", F.lit(True).alias("by_pair")), "pairs")
    by_language = usable.select("lang_group", *AXES).distinct()
    large_langs = written(by_language.groupBy("lang_group").count().filter(F.col("count") >= least).select("lang_group", F.lit(True).alias("by_lang")), "languages")
    grouped = named.join(_small(large_pairs), "pair_group", "left").join(_small(large_langs), "lang_group", "left")
    grouped = grouped.withColumn("group", F.when(F.col("by_pair"), F.col("pair_group")).when(F.col("by_lang"), F.col("lang_group")).otherwise(F.lit("0:")))
    # a language's estimate is over all its documents, also those of large sources
    levels = [usable.select(F.col("pair_group").alias("group"), *AXES), by_language.select(F.col("lang_group").alias("group"), *AXES), usable.select(F.lit("0:").alias("group"), *AXES).distinct()]
    needed = written(grouped.select("group").distinct(), "needed")
    rows = levels[0].union(levels[1]).union(levels[2]).join(_small(needed), "group", "left_semi")
    shape = estimates(written(rows, "rows"), floor, fall)
    judged = grouped.join(_small(shape), "group", "left").withColumn("distance", _distance() / F.col("scale"))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= CUT, F.lit(True))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), F.round("distance", 4).alias("distance"))
