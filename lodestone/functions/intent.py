"""What a question, a name or a caption is about, by fixed words."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import fold, text

#: Words that ask for something, by what they ask for.
ASKS = {
    "survival": "生存|预后|overall survival|disease-free|relapse-free|progression-free|\\bos\\b|\\bdfs\\b|\\brfs\\b|\\bdss\\b", "pcr": "\\bpcr\\b|病理完全缓解|pathological complete response|pathologic complete response",
    "response": "response|响应|疗效|缓解", "mutation": "mutation|突变|variant|变异", "copy_number": "copy number|\\bcna\\b|\\bcnv\\b|拷贝数|扩增", "expression": "expression|表达|rna-seq|transcriptom",
    "treatment": "treatment|therapy|治疗|药物|用药", "trial": "clinical trial|临床试验|\\bnct[0-9]", "cell_line": "cell line|细胞系|\\bauc\\b|\\bic50\\b|depmap", "subtype": "subtype|亚型|her2|\\btnbc\\b|三阴性|luminal",
}
#: Kinds of figures by words of their captions, in the order in which they are tried, with axes, extractability and confidence.
FIGURES = [
    ("light_curve", "light curve|光变曲线", "phase_day", "magnitude", "digitization_possible", 0.85), ("kaplan_meier", "kaplan|survival curve|生存曲线", "time", "survival_probability", "digitization_possible", 0.78),
    ("heatmap", "heatmap|heat map|热图", "sample", "gene", "axes_only", 0.72), ("scatter", "scatter|散点", "x", "y", "digitization_possible", 0.70), ("workflow", "workflow|flowchart|flow chart|流程图", "", "", "none", 0.70),
]
#: Intents of messages by words, in the order in which they are tried.
ROUTES = [
    ("export", "export|download|导出|下载"), ("explain", "why|explain|为什么|解释"), ("review", "review|approve|reject|审核|批准"), ("repair", "repair|fix|clean|修复|清洗"),
    ("search", "search|find|dataset|检索|查找|数据集"), ("build", "build|merge|integrate|构建|整合"),
]
#: What speaks for a cohort and against a cell or animal model.
CLINICAL = "patient|cohort|clinical|biopsy|neoadjuvant|tumor samples|患者|队列"
PRECLINICAL = "cell line|xenograft|mouse|mice|in vitro|knockdown|细胞系|小鼠"


def asks(question: Column | str, what: str) -> Column:
    """Whether a question asks for ``what``, a key of ``ASKS``."""
    return fold(question).rlike(ASKS[what])


def resolve(c: Column | str, profiles: list[tuple[str, list[str]]]) -> Column:
    """Name of the first profile with a term in the text; Chinese terms anywhere, others between non-alphanumerics."""
    x, out = fold(c), None
    for name, terms in profiles:
        han = [t for t in terms if re.search("[一-鿿]", t)]
        rest = [re.escape(t.lower()) for t in terms if t not in han]
        hit = F.lit(False)
        for t in han:
            hit = hit | F.contains(x, F.lit(t))
        if rest:
            hit = hit | x.rlike(f"(?<![a-z0-9])({'|'.join(rest)})(?![a-z0-9])")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def figure(c: Column | str) -> Column:
    """``(kind, x_axis, y_axis, extractability, confidence, status)`` of a caption; unknown ones go to review."""
    x, out = fold(c), None
    row = lambda k, a, b, e, p, s: F.struct(F.lit(k).alias("kind"), F.lit(a).alias("x_axis"), F.lit(b).alias("y_axis"), F.lit(e).alias("extractability"), F.lit(p).alias("confidence"), F.lit(s).alias("status"))
    for kind, words, a, b, e, p in FIGURES:
        hit, value = x.rlike(words), row(kind, a, b, e, p, "UNDERSTOOD")
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.when(F.trim(text(c)) != "", row("unknown", "", "", "caption_only", 0.35, "REVIEW")).otherwise(row("unknown", "", "", "none", 0.0, "REVIEW"))


def route(c: Column | str) -> Column:
    """Intent of a message, ``chat`` for none."""
    x, out = fold(c), None
    for name, words in ROUTES:
        out = F.when(x.rlike(words), name) if out is None else out.when(x.rlike(words), name)
    return out.otherwise("chat")


def same_source(gold: Column | str, system: Column | str) -> Column:
    """Whether a source id of the system is the gold one: equal, ending in it, or another name of the same service."""
    g, s = F.trim(fold(gold)), F.trim(fold(system))
    ends = s.endswith(F.concat(F.lit(":"), g)) | s.endswith(F.concat(F.lit("/"), g))
    other = ((g == "civic") & F.contains(s, F.lit("civic"))) | ((g == "depmap") & F.contains(s, F.lit("depmap"))) | ((g == "aact") & s.isin("aact", "clinicaltrials.gov")) | ((g == "tcga-brca") & s.rlike("tcga-brca|brca_tcga"))
    return (g == s) | ends | other


#: Fixed values of ``series_score``: what a question must ask for, the words looked for, their points, and whether each word counts or any one.
SERIES_RULES = [
    ("outcome", ["pcr", "response"], ["pcr", "pathological complete response", "treatment response", "neoadjuvant", "response"], 4, "each"),
    ("outcome", ["survival"], ["overall survival", "relapse-free", "disease-free", "intclust", "integrative cluster"], 4, "each"),
    ("group", ["triple", "tnbc", "三阴性"], ["tnbc", "triple-negative", "triple negative", "basal-like", "basal like"], 5, "any"),
    ("group", ["her2-positive", "her2+", "her2 阳性"], ["her2", "erbb2", "trastuzumab"], 3, "any"),
    ("always", [], ["her2", "erbb2", "trastuzumab", "pik3ca", "brca1", "brca2"], 1, "each"),
    ("always", [], ["breast"], 1, "each"),
]
#: Fixed values of ``series_score``: points of the question's own terms, of the disease, of the cohort, and of the size up to so many samples.
TERM_POINTS = {"genes": 3, "drugs": 2, "extra": 2}
DISEASE_POINTS, COHORT_POINTS = (8, -12), {"preclinical": -24, "clinical": 7, "other": -4}
SIZE_POINTS = [(10, -6), (30, 1), (None, 5)]


def series_score(c: Column | str, disease: list[str], genes: list[str] = (), drugs: list[str] = (), extra: list[str] = (), outcome: str | None = None, n_samples: Column | None = None, clinical: bool = False, subtype: str = "", goal: str = "") -> Column:
    """Whole-number score of a series' title and summary for a question.

    A group of patients is asked for in ``subtype`` or in ``goal``; disease
    terms under four characters and further terms under two do not count; an
    unknown number of samples gives no points.
    """
    x, asked = fold(c), f"{subtype}\n{goal}".lower()
    any_of = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(x, w)) if words else F.lit(False)
    applies = {"always": lambda names: True, "outcome": lambda names: outcome in names, "group": lambda names: any(n in asked for n in names)}
    rules = [(words, points, mode) for kind, names, words, points, mode in SERIES_RULES if applies[kind](names)]
    further = [t.strip().lower() for t in extra if len(t.strip()) > 1]
    rules += [([t.lower() for t in terms], TERM_POINTS[k], "each") for k, terms in (("genes", genes), ("drugs", drugs), ("extra", further))]
    parts = [F.when(any_of(group), points).otherwise(0) for words, points, mode in rules for group in ([words] if mode == "any" else [[w] for w in words])]
    parts.append(F.when(any_of([t.strip().lower() for t in disease if len(t.strip()) >= 4]), DISEASE_POINTS[0]).otherwise(DISEASE_POINTS[1]))
    if clinical:
        parts.append(F.when(x.rlike(PRECLINICAL), COHORT_POINTS["preclinical"]).when(x.rlike(CLINICAL), COHORT_POINTS["clinical"]).otherwise(COHORT_POINTS["other"]))
    if n_samples is not None:
        size = F.when(n_samples.isNull(), 0)
        for below, points in SIZE_POINTS[:-1]:
            size = size.when(n_samples < below, points)
        parts.append(size.otherwise(SIZE_POINTS[-1][1]))
    return sum(parts[1:], parts[0]).cast("int")


def column_variants(c: Column | str) -> Column:
    """Names that a column may go by: with underlines, without them, and both without ``full``, ``raw`` or ``original`` before."""
    x = F.regexp_replace(F.regexp_replace(fold(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    bare = F.regexp_replace(x, "^(full|raw|original)_?", "")
    flat = lambda y: F.replace(y, F.lit("_"), F.lit(""))
    return F.array_distinct(F.array(x, flat(x), bare, flat(bare)))


def observed_normaliser(canonical: str) -> str | None:
    """Which normaliser a canonical field is observed through; none for a source."""
    if canonical == "source_id":
        return None
    if canonical in ("gene", "drug", "mutation_status", "response_domain"):
        return canonical
    return "biomarker" if canonical in ("er_status", "pr_status", "her2_status", "her2_assay", "her2_raw_value") else "passthrough"
