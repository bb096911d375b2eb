"""Token taggers from lexicons, with context and gap filling.

Examples are rows ``(doc, pos, token, label)``; every operator keeps one row
for each token.  Windows are over one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import dealt, written


def _doc():
    return Window.partitionBy("doc").orderBy("pos")


def token_lexicon(examples: DataFrame, least: int = 2) -> DataFrame:
    """``(token, p, n)``: share of positive labels of tokens seen ``least`` times."""
    return examples.groupBy("token").agg(F.avg(F.col("label").cast("double")).alias("p"), F.count("*").alias("n")).filter(F.col("n") >= least)


def contexts(examples: DataFrame) -> DataFrame:
    """Examples with ``before`` and ``after``, the neighbouring tokens or ``<s>`` and ``</s>``."""
    return examples.withColumns({"before": F.coalesce(F.lag("token").over(_doc()), F.lit("<s>")), "after": F.coalesce(F.lead("token").over(_doc()), F.lit("</s>"))})


def context_lexicon(examples: DataFrame, least: int = 2) -> DataFrame:
    """``(before, token, p, n)`` of pairs of neighbours."""
    return contexts(examples).groupBy("before", "token").agg(F.avg(F.col("label").cast("double")).alias("p"), F.count("*").alias("n")).filter(F.col("n") >= least)


def features(examples: DataFrame) -> DataFrame:
    """``(doc, pos, label, feature)``: the token and its neighbours up to two places away, named by their place."""
    at = lambda k: F.coalesce((F.lag("token", -k) if k < 0 else F.lead("token", k)).over(_doc()), F.lit("<s>" if k < 0 else "</s>"))
    named = [F.concat(F.lit(f"{k}="), F.col("token") if k == 0 else at(k)) for k in (-2, -1, 0, 1, 2)]
    pair = F.concat(F.lit("-1,0="), at(-1), F.lit(" "), F.col("token"))
    return examples.withColumn("features", F.array(*named, pair)).select("doc", "pos", "label", F.explode("features").alias("feature"))


def predict(examples: DataFrame, lexicon: DataFrame, pairs: DataFrame | None = None, weight: float = 0.5, threshold: float = 0.5) -> DataFrame:
    """Examples with ``p`` and ``predicted``; known pairs are mixed in by ``weight``, unknown tokens are 0."""
    x = contexts(examples) if pairs is not None else examples
    x = x.join(lexicon.select("token", F.col("p").alias("p1")), "token", "left")
    p = F.coalesce("p1", F.lit(0.0))
    if pairs is not None:
        x = x.join(pairs.select("before", "token", F.col("p").alias("p2")), ["before", "token"], "left")
        p = F.when(F.col("p2").isNull(), p).otherwise((1 - weight) * p + weight * F.col("p2"))
    return x.select(*examples.columns, p.alias("p"), (p >= threshold).cast("int").alias("predicted"))


def fill_gaps(predicted: DataFrame, most: int = 1) -> DataFrame:
    """Runs of up to ``most`` negatives between two positives of a document become positive."""
    last = F.last(F.when(F.col("predicted") == 1, F.col("pos")), ignorenulls=True).over(_doc().rowsBetween(Window.unboundedPreceding, 0))
    following = F.first(F.when(F.col("predicted") == 1, F.col("pos")), ignorenulls=True).over(_doc().rowsBetween(0, Window.unboundedFollowing))
    inside = F.coalesce(following - last - 1 <= most, F.lit(False))
    return predicted.withColumn("filled", F.when((F.col("predicted") == 1) | inside, 1).otherwise(0))


def evaluate(predicted: DataFrame, column: str = "predicted") -> DataFrame:
    """Counts of true and false positives and of misses over all tokens."""
    p, y = F.col(column) == 1, F.col("label") == 1
    return predicted.agg(F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn"))


#: Weights of the six context features of a token.
WEIGHTS = [1.0, 0.65, 0.65, 1.0, 0.8, 0.8]


def context_features(examples: DataFrame) -> DataFrame:
    """Examples with ``features``: the token alone, with one or two neighbours to either side, and between both."""
    at = lambda k, edge: F.coalesce((F.lag("token", -k) if k < 0 else F.lead("token", k)).over(_doc()), F.lit(edge))
    x = dealt(examples, "doc").withColumns({"_l": at(-1, "<B>"), "_l2": at(-2, "<B2>"), "_r": at(1, "<E>"), "_r2": at(2, "<E2>")})
    t = F.col("token")
    named = lambda name, *parts: F.concat(F.lit(name + "="), F.concat_ws("|", *parts))
    keys = [named("token", t), named("left", F.col("_l"), t), named("right", t, F.col("_r")), named("window", F.col("_l"), t, F.col("_r")), named("left2", F.col("_l2"), F.col("_l"), t), named("right2", t, F.col("_r"), F.col("_r2"))]
    return x.withColumn("features", F.array(*keys)).drop("_l", "_l2", "_r", "_r2")


def feature_lexicon(featured: DataFrame, least: int = 2) -> DataFrame:
    """``(feature, p, n)``: share of positive labels of features seen ``least`` times."""
    each = featured.select("label", F.explode("features").alias("feature"))
    return each.groupBy("feature").agg(F.avg(F.col("label").cast("double")).alias("p"), F.count("*").alias("n")).filter(F.col("n") >= least)


def predict_features(featured: DataFrame, lexicon: DataFrame, threshold: float = 0.5, gap: int = 0) -> DataFrame:
    """``(doc, pos, label, p, predicted)``: weighted mean of the shares of known features; gaps are filled behind it."""
    p = feature_scores(featured, lexicon)
    out = p.withColumn("predicted", (F.col("p") >= threshold).cast("int"))
    return fill_gaps(out, gap).drop("predicted").withColumnRenamed("filled", "predicted") if gap else out


def feature_scores(featured: DataFrame, lexicon: DataFrame) -> DataFrame:
    each = featured.select("doc", "pos", "label", F.posexplode("features").alias("k", "feature")).join(lexicon.select("feature", F.col("p").alias("q")), "feature", "left")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.col("k") + 1)
    known = F.when(F.col("q").isNotNull(), weight)
    return each.groupBy("doc", "pos", "label").agg(F.coalesce(F.try_divide(F.sum(known * F.col("q")), F.sum(known)), F.lit(0.0)).alias("p"))


def held_in(doc: str = "doc") -> object:
    """Whether a document is of the development fold: the last byte of its SHA-256, by five."""
    return F.conv(F.right(F.sha2(F.col(doc).cast("string"), 256), F.lit(2)), 16, 10).cast("int") % 5 == 0


def select_config(examples: DataFrame, counts: tuple[int, ...] = (1, 2, 3, 5), thresholds: tuple[float, ...] = (0.3, 0.4, 0.5, 0.6, 0.7), gaps: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """F1 of every ``(least, threshold, gap)`` on the development fold, fitted on the rest; the first row is the best.

    Ties go to the larger threshold, count and gap.  Each count is scored
    once; thresholds and gaps are tried on the written scores together.
    """
    featured = written(context_features(examples), "features")
    dev, rest = featured.filter(held_in()), featured.filter(~held_in())
    lexicon = written(feature_lexicon(rest, 1), "lexicon")
    out = None
    for least in counts:
        p = written(feature_scores(dev, lexicon.filter(F.col("n") >= least)), "scores")
        for t in thresholds:
            marked = p.withColumn("predicted", (F.col("p") >= t).cast("int"))
            for gap in gaps:
                x = fill_gaps(marked, gap).withColumn("y", F.col("filled")) if gap else marked.withColumn("y", F.col("predicted"))
                n = evaluate(x, "y").select(F.lit(least).alias("least"), F.lit(t).alias("threshold"), F.lit(gap).alias("gap"), F.round(F.when(F.col("tp") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(0.0), 9).alias("f1"))
                out = n if out is None else out.union(n)
    return out.orderBy(F.desc("f1"), F.desc("threshold"), F.desc("least"), F.desc("gap"))
