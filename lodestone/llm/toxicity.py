"""Toxicity by weak supervision.

1. Voters: given lexicons, two lexicons (of words and of stems) induced from
   a bounded sample of training rows, and patterns; each votes toxic, harmless
   or abstain on a text.
2. Label model: the votes of all documents, counted by vote pattern, are
   explained by a hidden label.  Given the label, votes follow a tree: each
   voter's table depends on the label and on the one voter that it is most
   correlated with given the label, so that voters which move together do not
   count twice.  Expectation maximisation estimates the prior, the tables and
   the tree, without labels; accuracies and correlations follow from them.
3. A logistic regression on densities of the voters' hits is fitted to the
   posterior labels of a bounded sample of training rows.  Its slope and shift
   alone are set on the known labels of these rows, so that a score is the
   chance of label 1.

Patterns number at most 3 to the power of voters, a bound by configuration.
Scores see the text alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled
from lodestone.shared import written
from .words import chunks

#: Seed lexicons.
LEXICONS = {
    "intellect": "idiot idiots moron morons stupid imbecile dumb dumbass fool retard cretin dimwit brainless",
    "worth": "worthless trash garbage scum loser losers pathetic vermin parasite filth useless",
    "contempt": "disgusting clown clowns hate freak creep disgrace ugly jerk coward liar",
    "profanity": "fuck fucking shit bitch bastard asshole crap damn whore slut dick",
    "german": "dumm dummkopf trottel arschloch scheiße abschaum versager widerlich hurensohn schlampe",
    "french": "imbécile crétin connard salope merde ordure nul minable dégoûtant pourri abruti",
    "spanish": "idiota imbécil estúpido mierda basura perdedor asqueroso inútil payaso cabrón puta",
}
PATTERNS = {
    "address": r"\b(?:you|your|you're|du|tu|vous|usted)\W+(?:\w+\W+){0,2}?(?:idiot|moron|stupid|loser|scum|trash|clown|pathetic|worthless|disgusting)",
    "threat": r"\b(?:kill|hurt|beat|destroy)\s+(?:you|them|him|her)\b|\bgo\s+die\b",
    "masked": r"\b(?:[a-z]+[*@#$!]{1,3}[a-z]+|[a-z]*[i1!]d[i1!][o0]t[a-z]*|m[o0]r[o0]n[a-z]*|l[o0]ser[a-z]*|sh[i1!*]t[a-z]*|f[u*]ck[a-z]*)\b",
}
#: Words of which a match of a pattern holds one at least; a text without them is not searched.
NEEDS = {"address": ["idiot", "moron", "stupid", "loser", "scum", "trash", "clown", "pathetic", "worthless", "disgusting"], "threat": ["kill", "hurt", "beat", "destroy", "die"]}
VOTERS = [*LEXICONS, "learned", "stems", *PATTERNS, "breadth"]
#: Toxic training rows that an induced word or stem stands in at least, and its least odds against clean rows.
LEARNED_ROWS, LEARNED_ODDS = 8, 6.0
STEM = 5
THRESHOLD = 0.7
#: Least correlation, given the label, of voters that the label model may link.
CORRELATED = 0.15
_TOKEN = re.compile(r"\w+")


def learned_lexicon(texts: DataFrame) -> tuple[list[str], list[str]]:
    """Words, and stems of ``STEM`` letters, that single out toxic rows of ``texts(text, y)``.

    They stand in ``LEARNED_ROWS`` toxic rows or more and ``LEARNED_ODDS``
    times as often in toxic rows as in clean ones.  All such are taken; the
    bound on the rows bounds them.
    """
    total = texts.agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("c")).first()
    if not total or not total["t"] or not total["c"]:
        return [], []
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}_]+)"), 1)
    stems = F.transform(F.filter(words, lambda w: F.length(w) > STEM), lambda w: F.substring(w, 1, STEM))
    out = []
    for items in (words, stems):
        each = texts.select("y", F.explode(F.array_distinct(items)).alias("w"))
        counts = each.groupBy("w").agg(F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("clean")).filter(F.col("toxic") >= LEARNED_ROWS)
        odds = ((F.col("toxic") + 0.5) / (total["t"] + 1)) / ((F.col("clean") + 0.5) / (total["c"] + 1))
        out.append(sorted(r["w"] for r in counts.filter(odds >= LEARNED_ODDS).collect()))
    return out[0], out[1]


def hits(docs: DataFrame, lexicon: list[str], stems: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, number of words and hits of each voter, for every row; null texts have none."""
    sets = {**{k: frozenset(v.split()) for k, v in LEXICONS.items()}, "learned": frozenset(lexicon)}
    every, starts = frozenset().union(*sets.values()), frozenset(stems)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = {k: re.compile(v) for k, v in PATTERNS.items()}
        for batch in batches:
            for part in chunks(batch, "text"):
                out: dict[str, list[int]] = {k: [] for k in ["words", *VOTERS]}
                for text in part.column("text").to_pylist():
                    low = (text or "").lower()
                    words = _TOKEN.findall(low)
                    found = [w for w in words if w in every]
                    out["words"].append(len(words))
                    for k, s in sets.items():
                        out[k].append(sum(w in s for w in found))
                    out["stems"].append(sum(w[:STEM] in starts for w in words if len(w) > STEM) if starts else 0)
                    for k, p in patterns.items():
                        out[k].append(sum(1 for _ in p.finditer(low)) if k not in NEEDS or any(w in low for w in NEEDS[k]) else 0)
                    out["breadth"].append(len(set(found)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(v, pa.int64()) for v in out.values())], names=["doc_id", *out])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, words long, " + ", ".join(f"{v} long" for v in VOTERS))


def _votes() -> list:
    """0 harmless, 1 abstain, 2 toxic.  A lexicon that is hit once in a long text abstains."""
    out = []
    for v in VOTERS:
        if v == "breadth":
            out.append(F.when(F.col(v) >= 2, 2).when(F.col(v) == 1, 1).otherwise(0))
        elif v in ("learned", "stems"):
            out.append(F.when(F.col(v) * 400 >= F.col("words"), F.when(F.col(v) > 0, 2).otherwise(1)).when(F.col(v) > 0, 1).otherwise(0))
        else:
            out.append(F.when((F.col(v) > 0) & (F.col(v) * 400 >= F.col("words")), 2).otherwise(1))
    return out


class LabelModel:
    """A hidden binary label whose votes follow a tree of voters; all tables have one row for each label.

    ``prior``: chances of the labels.  ``accuracy[j]``: how often voter ``j``
    is right where it does not abstain.  ``correlation``: of the votes given
    the label.  ``parent[j]``: the voter that ``j`` depends on, or -1.
    ``table[j][y, v_parent, v]``: chances of a vote.
    """

    def __init__(self, votes: np.ndarray, count: np.ndarray, rounds: int = 1000, least_change: float = 1e-7):
        """``votes``: patterns x voters, in 0, 1, 2; ``count``: documents of each pattern.

        At first voters are linked that are nearly copies; every fiftieth round
        the tree is chosen anew among voters that are correlated given the label.
        """
        self.n = max(count.sum(), 1.0)
        self.one = np.eye(3)[votes].reshape(len(votes), 3 * votes.shape[1])
        # voters that move together share one say at the start
        x = votes - 1.0 - (count @ (votes - 1.0)) / self.n
        total = (x * count[:, None]).T @ x
        scale = np.sqrt(np.maximum(np.diag(total), 1e-9))
        say = 1 / np.maximum(np.abs(total / np.outer(scale, scale)).sum(axis=1), 1.0)
        start = 3.0 * (votes == 2) @ say - 1.5 * (votes == 0) @ say - 1.0
        q = 1 / (1 + np.exp(-start))
        for k in range(rounds):
            self._tables(votes, np.stack([count * (1 - q), count * q]), k % 50 == 0, CORRELATED if k else 0.5)
            new = self.posterior(votes)
            change, q = np.abs(new - q) @ count / self.n, new
            if change < least_change and k >= 50:
                break
        self._describe(votes, np.stack([count * (1 - q), count * q]))
        if not self.toxic_side():
            self.prior, self.table = self.prior[::-1], [t[::-1] for t in self.table]
            self._describe(votes, np.stack([count * q, count * (1 - q)]))

    def _tables(self, votes: np.ndarray, mass: np.ndarray, choose: bool, least: float) -> None:
        k = votes.shape[1]
        self.prior = (mass.sum(axis=1) + 1) / (mass.sum() + 2)
        joint = np.stack([(self.one * m[:, None]).T @ self.one for m in mass]).reshape(2, k, 3, k, 3)
        alone = np.stack([joint[:, j, :, j, :].diagonal(axis1=1, axis2=2) for j in range(k)], axis=1)
        self.alone = (alone + 1) / (alone + 1).sum(axis=2, keepdims=True)
        if choose:
            self._describe(votes, mass)
            self.parent = self._tree(joint, alone, least)
        self.table = []
        for j, p in enumerate(self.parent):
            if p < 0:
                self.table.append(np.repeat(self.alone[:, j][:, None], 3, axis=1))
            else:
                # a parent's vote that is rare leaves the voter at its own table
                t = joint[:, p, :, j, :] + 2 * self.alone[:, j][:, None]
                self.table.append(t / t.sum(axis=2, keepdims=True))

    def _tree(self, joint: np.ndarray, alone: np.ndarray, least: float) -> list[int]:
        """Parents in the tree of greatest mutual information given the label; links worth less than they cost are left out."""
        k = alone.shape[1]
        total = alone.sum(axis=2)
        gain = np.zeros((k, k))
        for i in range(k):
            for j in range(i):
                x = joint[:, i, :, j, :] + 0.5
                expected = (x.sum(axis=2)[:, :, None] * x.sum(axis=1)[:, None, :]) / x.sum(axis=(1, 2))[:, None, None]
                if abs(self.correlation[i, j]) >= least:
                    gain[i, j] = gain[j, i] = (x * np.log(x / expected)).sum()
        cost = 4 * np.log(self.n + 1)  # eight numbers, as the Bayesian information criterion counts them
        parent, inside = [-1] * k, {0} if total.size else set()
        while len(inside) < k:
            best = max(((gain[i, j], -i, -j) for i in inside for j in range(k) if j not in inside))
            worth, i, j = best[0], -best[1], -best[2]
            parent[j] = i if worth > cost else -1
            inside.add(j)
        return parent

    def _describe(self, votes: np.ndarray, mass: np.ndarray) -> None:
        right = np.array([(mass[1] * (votes[:, j] == 2)).sum() + (mass[0] * (votes[:, j] == 0)).sum() for j in range(votes.shape[1])])
        voted = np.array([(mass.sum(axis=0) * (votes[:, j] != 1)).sum() for j in range(votes.shape[1])])
        self.accuracy = (right + 1) / (voted + 2)
        x, total = votes - 1.0, 0.0
        for m in mass:
            centre = x - (m[:, None] * x).sum(axis=0) / max(m.sum(), 1e-9)
            total = total + (centre * m[:, None]).T @ centre
        scale = np.sqrt(np.maximum(np.diag(total), 1e-9))
        self.correlation = total / np.outer(scale, scale)

    def toxic_side(self) -> bool:
        """Whether label 1 is the one under which voters vote toxic more often."""
        return sum(t[1][:, 2].mean() - t[0][:, 2].mean() for t in self.table) >= 0

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Chance of label 1 of each row of votes."""
        gain = np.full(len(votes), np.log(self.prior[1] / self.prior[0]))
        for j, p in enumerate(self.parent):
            given = votes[:, p] if p >= 0 else np.zeros(len(votes), int)
            gain += np.log(self.table[j][1][given, votes[:, j]] / self.table[j][0][given, votes[:, j]])
        return 1 / (1 + np.exp(-np.clip(gain, -30, 30)))


def calibration(gain: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift that fit log odds to known labels; 1 and 0 without labels of both kinds."""
    if not len(gain) or y.min() == y.max():
        return 1.0, 0.0
    w, shift = fit_linear(gain[:, None], y.astype(float), ridge=0.1)
    return float(max(w[0], 0.1)), shift


def fit_linear(x: np.ndarray, target: np.ndarray, ridge: float = 1.0, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by damped Newton steps."""
    one = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(one.shape[1])
    penalty = np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(one @ w, -30, 30)))
        grad = one.T @ (p - target) + penalty @ w
        hess = (one * (p * (1 - p))[:, None]).T @ one + penalty
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 4 / max(np.abs(step).max(), 1e-9))
    return w[:-1], float(w[-1])


def _features() -> list:
    """Densities of hits, bounded; a text without words has none."""
    n = F.greatest(F.col("words"), F.lit(1))
    dense = [F.least(F.log1p(1000 * F.col(v) / n) / 3, F.lit(2.0)) for v in VOTERS if v != "breadth"]
    return [*dense, F.least(F.col("breadth") / 3, F.lit(2.0))]


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row of ``docs``.

    Null and empty texts get the score of a text without hits.  Rows that
    repeat an id are scored one by one; one of them at most is learned from,
    that with the least hits.  Rows with a null id have no label.  Without any
    label that may be learned from, a sample of documents takes the place of
    the training rows; an empty table gives an empty result.  Labels other
    than 0 and 1, null ones too, are no labels.
    """
    chosen = written(labelled.sample(labels, label), "sample")  # bounded: SAMPLE rows
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = written(named.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).filter("text is not null"), "labelled")
    rows = written(hits(named, *learned_lexicon(known)), "hits")
    rows = rows.withColumn("votes", F.array(*(v.cast("int") for v in _votes()))).withColumn("x", F.array(*_features()))
    patterns = rows.groupBy("votes").count().collect()  # bounded: 3 to the power of voters
    if not patterns:
        return rows.select("doc_id", labelled.held_out().alias("held_out"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    model = LabelModel(np.array([r["votes"] for r in patterns]), np.array([r["count"] for r in patterns], float))
    fit = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct("x", "votes")).alias("r")).select("r.*", "y").collect()
    if not fit:
        fit = rows.select("x", "votes", F.lit(-1).alias("y")).orderBy(F.xxhash64("doc_id"), "x").limit(labelled.SAMPLE).collect()
    x, y = np.array([r["x"] for r in fit]), np.array([r["y"] for r in fit])
    w, bias = fit_linear(x, model.posterior(np.array([r["votes"] for r in fit])))
    slope, shift = calibration((x @ w + bias)[y >= 0], y[y >= 0])
    logit = sum((F.col("x")[k] * float(slope * c) for k, c in enumerate(w)), F.lit(float(slope * bias + shift)))
    out = rows.select("doc_id", labelled.held_out().alias("held_out"), (1 / (1 + F.exp(-logit))).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without documents predicted toxic; columns unchanged, rows with a null id stay.

    Of rows that repeat an id all go if one of them is toxic.
    """
    bad = score(docs, labels, id_col, text_col).filter("predicted = 1 and doc_id is not null").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(bad, id_col, "left_anti")
