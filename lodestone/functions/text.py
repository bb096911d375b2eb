"""Text and value functions as column expressions.

All of them take columns (or column names) and never look at more than one
row.  A null text is an empty one unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = "[a-z0-9][a-z0-9_+.-]*"
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
#: What counts as missing in each sense.
MISSING = {"trimmed": ["NA", "N/A", "<缺失>"], "exact": ["NA", "N/A", "<缺失>"], "blank": [], "cleaning": ["NA", "N/A", "NULL", "UNKNOWN", "[NOT AVAILABLE]", "NOT AVAILABLE"], "scan": ["na", "n/a", "null", ".", "na."]}
#: Words that turn a query's meaning.
NEGATIONS = ["not", "no", "without", "否", "不", "无", "未"]
#: Chinese terms and the words that they are searched by.
BILINGUAL = {
    "乳腺癌": ["breast", "cancer"], "新辅助": ["neoadjuvant"], "病理完全缓解": ["pathological", "complete", "response", "pcr"], "主要结局": ["primary", "outcome", "endpoint"], "结局": ["outcome", "endpoint"],
    "受体亚型": ["receptor", "subtype"], "基因表达": ["gene", "expression", "transcriptomic"], "数据可用性": ["data", "availability"], "方法": ["method", "methods"], "统计": ["statistical", "statistics"],
}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound(c: Column, f) -> Column:
    """``f(c)`` with ``c`` reckoned once for a row, however often ``f`` uses it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def text(c: Column | str) -> Column:
    return F.coalesce(col(c).cast("string"), F.lit(""))


def fold(c: Column | str) -> Column:
    """Lower case with a long s for the sharp one; other differences from full case folding stay."""
    return F.replace(F.lower(text(c)), F.lit("ß"), F.lit("ss"))


def tokens(c: Column | str) -> Column:
    """Words of lower-case letters, digits and ``_+.-`` in order."""
    return F.regexp_extract_all(fold(c), F.lit(f"({WORD})"), F.lit(1))


def cjk_bigrams(c: Column | str) -> Column:
    """Overlapping pairs of the Chinese characters of a text, all of them put together; fewer than two make none."""
    joined = F.array_join(F.regexp_extract_all(text(c), F.lit("([一-鿿]+)"), F.lit(1)), "")
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(joined) - 1, F.lit(1))), lambda i: F.substr(joined, i, F.lit(2)))
    return F.when(F.length(joined) > 1, pairs).otherwise(F.array().cast("array<string>"))


def retrieval_tokens(c: Column | str) -> Column:
    """Words, pairs of Chinese characters, and the English words of Chinese terms that occur."""
    folded = fold(c)
    none = F.array().cast("array<string>")
    meant = [F.when(F.contains(folded, F.lit(p)), F.array(*map(F.lit, ws))).otherwise(none) for p, ws in BILINGUAL.items()]
    more = F.when(folded.rlike("[一-鿿]"), F.concat(cjk_bigrams(folded), *meant)).otherwise(none)
    return F.concat(tokens(c), more)


def service_tokens(c: Column | str) -> Column:
    """Runs of letters, digits and ``_+-``, and single Chinese characters."""
    return F.regexp_extract_all(fold(c), F.lit("([a-z0-9_+-]+|[一-鿿])"), F.lit(1))


def word_set(c: Column | str) -> Column:
    return F.array_distinct(tokens(c))


def char_grams(c: Column | str, n: int = 3) -> Column:
    """Distinct runs of ``n`` characters of the text without anything but letters and digits; shorter texts are one."""
    x = F.regexp_replace(fold(c), "[^a-z0-9]+", "")
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - n + 1, F.lit(1))), lambda i: F.substr(x, i, F.lit(n)))
    return F.when(F.length(x) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(grams))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two distinct arrays over their union; 0 where one is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def containment(a: Column, b: Column) -> Column:
    """Overlap over the smaller of two distinct arrays; 0 where one is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b)))


def is_filled(c: Column | str, variant: str = "exact") -> Column:
    """False for missing values; ``variant`` is a key of ``MISSING``. Never null."""
    x = col(c).cast("string")
    if variant == "trimmed":
        x = F.trim(x)
        return F.coalesce((x != "") & ~F.upper(x).isin(MISSING[variant]), F.lit(False))
    if variant == "cleaning":
        x = F.trim(x)
        return F.coalesce((x != "") & ~F.upper(x).isin(MISSING[variant]), F.lit(False))
    if variant == "scan":
        x = F.trim(x)
        return F.coalesce((x != "") & ~F.lower(x).isin(MISSING[variant]), F.lit(False))
    return F.coalesce((x != "") & ~x.isin(MISSING[variant]) if MISSING[variant] else x != "", F.lit(False))


def number(c: Column | str) -> Column:
    """A plain decimal number as double, otherwise null."""
    x = F.trim(text(c))
    return F.when(x.rlike(NUMBER), x.try_cast("double"))


def loose_number(c: Column | str) -> Column:
    """A number after commas, spaces, percent signs and ounces are taken away."""
    return number(F.regexp_replace(F.lower(text(c)), "[,% ]|oz\\.?", ""))


def value_type(c: Column | str) -> Column:
    """``boolean``, ``continuous``, ``identifier`` or ``categorical``; null for missing values."""
    x = F.lower(F.trim(text(c)))
    kind = F.when(x.isin("true", "false", "yes", "no"), "boolean").when(number(F.replace(x, F.lit(","), F.lit(""))).isNotNull(), "continuous").when(x.rlike("patient|sample|gse|gsm"), "identifier").otherwise("categorical")
    return F.when(is_filled(c, "scan"), kind)


def snake(c: Column | str) -> Column:
    """Lower case, runs of other characters as one underline; null if nothing is left."""
    x = F.regexp_replace(F.regexp_replace(F.lower(text(c)), "[^a-z0-9]+", "_"), "^_|_$", "")
    return F.when(x != "", x)


def age_group(c: Column | str) -> Column:
    """Five bins; null outside 0 to 120 and for anything but a plain number."""
    x = F.trim(text(c))
    age = F.when(x.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), x.try_cast("double"))
    return F.when(age.isNull() | (age < 0) | (age > 120), F.lit(None)).when(age < 40, "<40").when(age < 50, "40-49").when(age < 60, "50-59").when(age < 70, "60-69").otherwise(">=70")


def altered(c: Column | str) -> Column:
    """Whether a copy-number value is at least 2 away from 0; null for anything but a number."""
    return F.abs(number(c)) >= 2


def accessions(c: Column | str, kind: str = "GSE") -> Column:
    """Distinct accession numbers in order of their first place, upper case; ``kind`` is ``GSE`` or ``NCT``."""
    form = {"GSE": r"\b(GSE[0-9]{3,})\b", "NCT": r"\b(NCT[0-9]{8})\b"}[kind]
    return F.array_distinct(F.regexp_extract_all(F.upper(text(c)), F.lit(form), F.lit(1)))


def protected_terms(c: Column | str, limit: int | None = 32) -> Column:
    """Quoted phrases, then tokens shaped like identifiers, then negations, distinct; ``limit`` is for queries, None for whole documents."""
    quoted = F.filter(F.transform(F.regexp_extract_all(text(c), F.lit("[\"']([^\"']{2,80})[\"']"), F.lit(1)), F.trim), lambda x: x != "")
    words = F.transform(F.regexp_extract_all(text(c), F.lit(r"([A-Z]{2,}[A-Z0-9_+./-]*|[0-9]+(?:\.[0-9]+)?|[A-Za-z][A-Za-z0-9_+./-]+)"), F.lit(1)), lambda x: F.regexp_replace(x, r"[.,;:]+$", ""))
    shaped = F.filter(words, lambda x: x.rlike("[0-9_+./-]") | ((F.length(x) > 1) & x.rlike("[A-Za-z]") & (x == F.upper(x))))
    folded = fold(c)
    said = F.array_compact(F.array(*(F.when(folded.rlike(rf"\b{n}\b") if n.isascii() else F.contains(folded, F.lit(n)), n) for n in NEGATIONS)))
    found = F.array_distinct(F.concat(quoted, shaped, said))
    return found if limit is None else F.slice(found, 1, limit)


def single_spaced(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(text(c), r"\s+", " "))


def query_plan(c: Column | str, aliases: dict[str, str], longest: int = 4000) -> Column:
    """Three variants of a query and what they must keep: ``(concepts, entities, constraints, must_keep, keyword, paraphrase, evidence)``."""
    raw = single_spaced(c)
    wide = single_spaced(expand_query(raw, aliases))
    cut = lambda x: F.rtrim(F.substring(x, 1, longest))
    concepts = F.slice(F.array_distinct(F.regexp_extract_all(raw, F.lit("([A-Za-z][A-Za-z0-9_+./-]+|[一-鿿]{2,})"), F.lit(1))), 1, 8)
    kept = protected_terms(raw)
    against = F.slice(F.array_compact(F.array(*(F.when(F.contains(fold(raw), F.lit(n)), n) for n in NEGATIONS))), 1, 8)
    return F.struct(concepts.alias("concepts"), F.slice(kept, 1, 8).alias("entities"), against.alias("constraints"), kept.alias("must_keep"), cut(wide).alias("keyword"), cut(raw).alias("paraphrase"), cut(F.concat(wide, F.lit(" evidence"))).alias("evidence"))


def valid_variants(plan: Column, c: Column | str, longest: int = 4000) -> Column:
    """``(valid, accepted, rejected, protected)``: variants that keep every protected term; the query itself where none does."""
    raw = single_spaced(c)
    declared = F.filter(F.transform(plan["must_keep"], single_spaced), lambda t: (t != "") & F.contains(fold(raw), fold(t)))
    protected = F.array_distinct(F.concat(protected_terms(raw), declared))
    variants = F.filter(F.transform(F.array(plan["keyword"], plan["paraphrase"], plan["evidence"]), single_spaced), lambda v: (v != "") & (F.length(v) <= longest))
    keeps = lambda v: F.forall(protected, lambda t: F.contains(fold(v), fold(t)))
    good, bad = F.array_distinct(F.filter(variants, keeps)), F.filter(variants, lambda v: ~keeps(v))
    return F.struct((F.size(good) > 0).alias("valid"), F.when(F.size(good) > 0, good).otherwise(F.array(raw)).alias("accepted"), bad.alias("rejected"), protected.alias("protected"))


def contract_queries(disease: Column, subtype: Column, exposure: Column, outcome: Column, treatment: Column) -> Column:
    """Five query texts of a research contract, as ``[(kind, text)]``; null parts are left out."""
    end = F.coalesce(F.when(text(outcome) != "", outcome), F.lit("response"))
    filled_ = lambda x: F.when(text(x) != "", x)
    join = lambda *parts: F.concat_ws(" ", *(filled_(p) for p in parts))
    texts = {
        "exact": join(disease, subtype, exposure, end), "synonym": join(F.when(F.contains(text(subtype), F.lit("HER2")), F.lit("ERBB2")).otherwise(exposure), end, F.lit("pathological complete response")),
        "clinical": join(disease, F.coalesce(filled_(treatment), F.lit("treatment")), end), "dataset": join(disease, exposure, F.lit("GEO GSE cohort"), end), "outcome": join(end, F.lit("pCR ORR survival"), disease),
    }
    return F.filter(F.array(*(F.struct(F.lit(k).alias("kind"), F.trim(v).alias("text")) for k, v in texts.items())), lambda q: q["text"] != "")


def expand_query(c: Column | str, aliases: dict[str, str]) -> Column:
    """The query and, behind it, the alias of each of its words that has one, each once."""
    table = F.create_map(*(F.lit(x) for kv in aliases.items() for x in kv)) if aliases else F.create_map().cast("map<string,string>")
    found = F.filter(F.transform(word_set(c), lambda w: F.try_element_at(table, w)), lambda x: x.isNotNull())
    return F.array_join(F.array_distinct(F.concat(F.array(F.trim(text(c))), found)), " ")


def contains(c: Column | str, *words: str) -> Column:
    """Whether a filled value holds one of the words, case aside; never null."""
    found = F.lit(False)
    for w in words:
        found = found | F.contains(F.lower(text(c)), F.lit(w.lower()))
    return is_filled(c) & found


def csv_safe(c: Column | str) -> Column:
    """A quote before values that a spreadsheet would take for a formula."""
    return F.regexp_replace(text(c), r"^([=+\-@\t\r])", "'$1")


def short_id(prefix: str, *parts: Column, sep: str = "|") -> Column:
    """``prefix:`` and 24 digits of the SHA-256 of the parts."""
    return F.concat(F.lit(prefix + ":"), F.substring(F.sha2(F.concat_ws(sep, *(p.cast("string") for p in parts)), 256), 1, 24))
