"""Reports of evaluated runs: distinct sources of a task, ranks of the expected ones, and one summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: The names by which a source is known, and the scores that a judge gives.
NAMES = ["dataset_id", "accession", "source_id", "dataset_name", "source_name", "source_database"]
JUDGED = ["faithfulness", "relevance", "completeness", "retrieval_quality"]


def source_rows(items: DataFrame, candidate: str = "candidate") -> DataFrame:
    """Distinct sources of each task, numbered by ``place`` from 1.

    ``items(task_id, candidate boolean, ord, <names>)``: candidates come
    before the sources that were read, each in their order; rows are the same
    source when their filled names, folded and put together, are equal; rows
    without a name are left out.  Tasks have few sources each; repeats go
    before the shuffle by task.
    """
    from pyspark.sql import Window

    key = F.concat_ws("|", *(F.when(T.text(c) != "", F.trim(T.fold(c))) for c in NAMES))
    order = F.struct((~F.col(candidate)).alias("late"), "ord")
    first = items.withColumn("_key", key).filter("_key <> ''").groupBy("task_id", "_key").agg(F.min_by(F.struct(*NAMES), order).alias("r"), F.min(order).alias("o"))
    place = F.row_number().over(Window.partitionBy("task_id").orderBy("o", "_key"))
    return first.select("task_id", place.alias("place"), "r.*")


def source_ranks(rows: DataFrame, expected: DataFrame) -> DataFrame:
    """``(task_id, rank)``: the place of the first of ``rows`` one of whose names is expected; null where none is.

    ``expected(task_id, name)``; every task of ``expected`` has a row.
    """
    wanted = expected.select("task_id", T.fold("name").alias("name")).distinct()
    named = rows.select("task_id", "place", F.explode(F.array_distinct(F.transform(F.array(*(T.text(c) for c in NAMES)), lambda v: F.trim(T.fold(v))))).alias("name"))
    return wanted.join(named, ["task_id", "name"], "left").groupBy("task_id").agg(F.min("place").alias("rank"))


def summary(runs: DataFrame) -> DataFrame:
    """``(metric, value)`` over all runs, repeats of a case counted apart.

    ``runs(case_id, rank, difficulty, latency_ms, scores)``; ``scores`` is a
    struct of ``overall``, ``claim_support_rate`` and the four of ``JUDGED``,
    null where no judge was asked.  Runs without ``overall`` do not count for
    means of scores; a missing support rate is 0; a missing difficulty is
    ``medium``.  A mean over nothing is null, a share over nothing 0.
    """
    share = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    hit = lambda k: F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0))
    within = lambda v: F.when(F.col("rank") <= 3, v).otherwise(0.0)
    x = runs.withColumns({"difficulty": F.coalesce("difficulty", F.lit("medium")), "valid": F.col("scores.overall").isNotNull()})
    judged = lambda c: F.avg(F.when(F.col("valid"), c))
    metrics = {f"recall@{k}": share(hit(k)) for k in (1, 3, 5)}
    metrics |= {"mrr@3": share(within(1 / F.col("rank"))), "ndcg@3": share(within(1 / F.log2(F.col("rank") + 1))), "avg_latency_ms": share(F.coalesce(F.col("latency_ms").cast("double"), F.lit(0.0))), "judge_valid_rate": share(F.col("valid").cast("double"))}
    metrics |= {f"avg_{k}": judged(F.col(f"scores.{k}").cast("double")) for k in [*JUDGED, "overall"]}
    metrics["avg_claim_support_rate"] = judged(F.coalesce(F.col("scores.claim_support_rate").cast("double"), F.lit(0.0)))
    whole = x.agg(F.count("*").cast("double").alias("cases"), *(v.alias(f"m{n}") for n, v in enumerate(metrics.values())))
    named = F.array(F.struct(F.lit("cases").alias("metric"), F.col("cases").alias("value")), *(F.struct(F.lit(k).alias("metric"), F.col(f"m{n}").alias("value")) for n, k in enumerate(metrics)))
    levels = x.groupBy("difficulty").agg(share(hit(3)).alias("value")).select(F.concat(F.lit("recall@3_"), "difficulty").alias("metric"), "value")
    return whole.select(F.explode(named).alias("r")).select("r.*").unionByName(levels)
