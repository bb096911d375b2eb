"""Evaluation measures as column expressions; a zero denominator gives null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def precision(tp: Column, fp: Column) -> Column:
    return ratio(tp, tp + fp)


def recall(tp: Column, fn: Column) -> Column:
    return ratio(tp, tp + fn)


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio(2 * tp, 2 * tp + fp + fn)


def composite(*parts: Column) -> Column:
    """100 times the geometric mean; null if a part is null."""
    return 100 * F.pow(reduce(lambda a, b: a * b, parts), F.lit(1.0 / len(parts)))


def geometric_fitness(*scores: Column, top: float = 4.0) -> Column:
    """Geometric mean of scores of 0 to ``top`` over ``top``; 0 if one of them is 0."""
    return F.when(F.least(*scores) <= 0, F.lit(0.0)).otherwise(F.pow(reduce(lambda a, b: a * b, [s / top for s in scores]), F.lit(1.0 / len(scores))))
