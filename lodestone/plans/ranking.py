"""Retrieval queries: benchmark texts against documents, and vectors against vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import retrieval as R
from ..operators.vectors import VectorStore
from ..shared import dealt, new_path, written
from .tables import Suite, read

suite = Suite()
QUERIES, ORACLE_SQL = suite.queries, suite.sql

_FOLD = "replace(lower(coalesce(text, '')), 'ß', 'ss')"
_WORDS = f"regexp_extract_all({_FOLD}, '[a-z0-9][a-z0-9_+.-]*')"
_HAN = f"array_to_string(regexp_extract_all({_FOLD}, '[一-鿿]'), '')"
_MEANT = ", ".join(f"CASE WHEN contains({_FOLD}, '{p}') THEN [{', '.join(repr(w) for w in ws)}] ELSE [] END" for p, ws in T.BILINGUAL.items())
_TOKENS = f"list_concat({_WORDS}, [substr({_HAN}, i, 2) FOR i IN range(1, length({_HAN}))], flatten([{_MEANT}]))"
_SERVICE = f"regexp_extract_all({_FOLD}, '[a-z0-9_+-]+|[一-鿿]')"


def _bm25_sql(k1: float, b: float, distinct: bool, k: int, tokens: str = _TOKENS, zeros: bool = False, name: str = "bm") -> str:
    d = "DISTINCT" if distinct else ""
    rest = f" UNION ALL SELECT query_id, doc_id, 0.0 FROM (SELECT DISTINCT item_id AS query_id FROM benchmark), (SELECT doc_id FROM documents ORDER BY doc_id LIMIT {2 * k}) WHERE (query_id, doc_id) NOT IN (SELECT (query_id, doc_id) FROM p)" if zeros else ""
    return f"""
{name} AS (
 WITH w AS (SELECT doc_id, {tokens} AS ws FROM documents),
 st AS (SELECT count(*)::DOUBLE AS n, avg(len(ws)) AS av FROM w),
 qt AS (SELECT query_id, term, count(*)::DOUBLE AS qf FROM (SELECT {d} item_id AS query_id, unnest({tokens}) AS term FROM benchmark) GROUP BY ALL),
 tf AS (SELECT doc_id, term, count(*)::DOUBLE AS tf, any_value(ln)::DOUBLE AS ln FROM (SELECT doc_id, len(ws) AS ln, unnest(ws) AS term FROM w) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
 df AS (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY term),
 s AS (SELECT query_id, doc_id, round(sum(qf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {k1 + 1} / (tf + {k1} * (1 - {b} + {b} * ln / av))), 6) AS score
   FROM tf JOIN qt USING (term) JOIN df USING (term), st GROUP BY ALL),
 p AS (SELECT * FROM s WHERE score > 0)
 SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT * FROM p{rest})
 QUALIFY rank <= {k}
)"""


_HASH = """
hv AS (
 WITH t AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest({tokens}) AS w FROM {table}) GROUP BY ALL),
 c AS (SELECT doc_id, (('0x' || substr(md5(w), 1, 7))::BIGINT % 384)::BIGINT AS dim, sum(CASE WHEN ('0x' || substr(md5(w), 8, 1))::BIGINT < 8 THEN n ELSE -n END)::DOUBLE AS v FROM t GROUP BY ALL HAVING v <> 0)
 SELECT doc_id, dim, v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)) AS weight FROM c
)"""

_JUDGED = """
judged AS (
 WITH b AS (SELECT item_id, list_distinct({tokens}) AS bw FROM benchmark), d AS (SELECT doc_id, list_distinct({tokens}) AS dw FROM documents)
 SELECT item_id AS query_id, doc_id, CASE WHEN len(list_intersect(bw, dw)) >= 0.9 * len(bw) THEN 2 ELSE 1 END AS gain FROM b, d WHERE len(bw) > 0 AND len(list_intersect(bw, dw)) >= 0.6 * len(bw)
)""".format(tokens=_TOKENS)


def _asked(spark, sf):
    return read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _docs(spark, sf):
    return read(spark, sf, "documents").select("doc_id", "text")


@suite.add(f"WITH {_bm25_sql(1.5, 0.75, True, 10)} SELECT query_id, doc_id, score, rank FROM bm")
def bm25_topk(spark, sf):
    return R.bm25(_docs(spark, sf), _asked(spark, sf))


@suite.add(f"WITH {_bm25_sql(1.2, 0.75, False, 10, _SERVICE, True)} SELECT query_id, doc_id, score, rank FROM bm")
def bm25_service_topk(spark, sf):
    return R.bm25(_docs(spark, sf), _asked(spark, sf), k1=1.2, distinct=False, tokens=T.service_tokens, zeros=True)


@suite.add(f"SELECT doc_id, {_TOKENS} AS tokens, {_SERVICE} AS service FROM documents")
def retrieval_tokens(spark, sf):
    return _docs(spark, sf).select("doc_id", T.retrieval_tokens("text").alias("tokens"), T.service_tokens("text").alias("service"))


_COVERED = f"""cv AS (SELECT query_id, doc_id, round(count(*)::DOUBLE / any_value(size), 6) AS score FROM (SELECT DISTINCT doc_id, unnest({_TOKENS}) AS term FROM documents) d
 JOIN (SELECT *, count(*) OVER (PARTITION BY query_id) AS size FROM (SELECT DISTINCT item_id AS query_id, unnest({_TOKENS}) AS term FROM benchmark)) q USING (term) GROUP BY ALL)"""


@suite.add(f"WITH {_COVERED} SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM cv QUALIFY rank <= 10")
def word_coverage_topk(spark, sf):
    return R.word_coverage(_docs(spark, sf), _asked(spark, sf), 10)


def _short(spark, sf):
    """Documents by their number of characters, as a second ranking of the best 50."""
    best = R.bm25(_docs(spark, sf), _asked(spark, sf), 50)
    chars = read(spark, sf, "documents").select("doc_id", F.col("n_chars").cast("double").alias("new"))
    return best, R.ranked(best.join(chars, "doc_id").select("query_id", "doc_id", (-F.col("new")).alias("score")), None)


@suite.add(f"""WITH {_bm25_sql(1.5, 0.75, True, 50)},
o AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY n_chars, doc_id) AS rank FROM bm JOIN documents USING (doc_id)),
s AS (SELECT query_id, doc_id, round(sum(p), 9) AS score FROM (SELECT query_id, doc_id, 1.0::DOUBLE / (60 + rank) AS p FROM bm UNION ALL SELECT query_id, doc_id, 0.5::DOUBLE / (60 + rank) FROM o) GROUP BY ALL)
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 10""")
def weighted_rrf(spark, sf):
    best, short = _short(spark, sf)
    return R.rrf([(best, 1.0), (short, 0.5)])


@suite.add(f"WITH {_bm25_sql(1.5, 0.75, True, 10)} SELECT query_id, doc_id, round(score / max(score) OVER (PARTITION BY query_id), 6) AS score, rank FROM bm")
def max_normalised(spark, sf):
    return R.normalised(bm25_topk(spark, sf)).withColumn("score", F.round("score", 6))


@suite.add(f"""WITH {_HASH.format(tokens=_TOKENS, table='(SELECT doc_id, text FROM documents)')}, q AS (SELECT * FROM hv), z AS (SELECT doc_id AS query_id FROM documents),
s AS (SELECT query_id, doc_id, round((coalesce(sum(p), 0) + 1) / 2, 6) AS score FROM (SELECT q.doc_id AS query_id, h.doc_id, h.weight * q.weight AS p FROM hv h JOIN q USING (dim) UNION ALL SELECT query_id, doc_id, 0.0 FROM z, documents) GROUP BY ALL)
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 10""")
def hashed_embedding_topk(spark, sf):
    return R.cosine_of_each(R.hashed_embeddings(dealt(_docs(spark, sf)), method="md5"), dims=384, id_col="doc_id", itself=True, half=True)


@suite.add()
def hashing_search(spark, sf):
    """By the first bytes of BLAKE2b, which SQL has not; the tests hold it against plain Python."""
    return R.hashing_search(_docs(spark, sf), _asked(spark, sf))


@suite.add(f"""WITH {_HASH.format(tokens=_TOKENS, table='(SELECT doc_id, text FROM documents UNION ALL SELECT -1 - item_id, text FROM benchmark)')}, {_COVERED},
q AS (SELECT -1 - doc_id AS query_id, dim, weight AS w FROM hv WHERE doc_id < 0),
dn AS (SELECT query_id, doc_id, greatest(0, least(1, round(coalesce(sum(p), 0), 6))) AS x FROM (SELECT query_id, doc_id, weight * w AS p FROM hv JOIN q USING (dim) WHERE doc_id >= 0) GROUP BY ALL),
dk AS (SELECT * FROM dn), ck AS (SELECT * FROM cv),
s AS (SELECT query_id, doc_id, round(0.55::DOUBLE * coalesce(x, 0) + 0.30::DOUBLE * coalesce(score, 0), 6) AS score FROM dk FULL JOIN ck USING (query_id, doc_id))
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 10""")
def coverage_search(spark, sf):
    return R.coverage_search(_docs(spark, sf), _asked(spark, sf), method="md5")


@suite.add(f"""WITH {_bm25_sql(1.5, 0.75, True, 50)},
{_HASH.format(tokens=_TOKENS, table='(SELECT doc_id, text FROM documents UNION ALL SELECT -1 - item_id, text FROM benchmark)')},
q AS (SELECT -1 - doc_id AS query_id, dim, weight AS w FROM hv WHERE doc_id < 0),
dn AS (SELECT query_id, doc_id, round((coalesce(sum(p), 0) + 1) / 2, 6) AS y FROM (SELECT query_id, doc_id, weight * w AS p FROM hv JOIN q USING (dim) WHERE doc_id >= 0 UNION ALL SELECT item_id, doc_id, 0.0 FROM benchmark, documents) GROUP BY ALL),
dk AS (SELECT * FROM dn QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY y DESC, doc_id) <= 50),
nb AS (SELECT query_id, doc_id, score / max(score) OVER (PARTITION BY query_id) AS x FROM bm),
s AS (SELECT query_id, doc_id, round(0.55::DOUBLE * coalesce(x, 0) + 0.45::DOUBLE * coalesce(y, 0), 6) AS score FROM nb FULL JOIN dk USING (query_id, doc_id))
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 10""")
def hybrid_fusion(spark, sf):
    lexical = R.bm25(_docs(spark, sf), _asked(spark, sf), 50)
    return R.score_fusion(lexical, R.hashing_search(_docs(spark, sf), _asked(spark, sf), 50, method="md5"))


@suite.add("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, round(list_cosine_similarity(q.e, d.e), 6) AS score FROM v q, v d WHERE q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id)
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 10""")
def cosine_topk(spark, sf):
    v = read(spark, sf, "embeddings")
    return R.cosine(v, v.filter("vec_id % 50 = 0"))


def _stored(spark, sf):
    """All vectors in a new store, in two upserts, the second of which repeats every third vector of the first with its true value."""
    v = read(spark, sf, "embeddings").select("vec_id", "embedding", "label")
    store = VectorStore(spark, new_path(spark, "store"), 64, id_col="vec_id", vector_col="embedding")
    turned = F.when(F.col("vec_id") % 3 == 0, F.transform("embedding", lambda c: -c)).otherwise(F.col("embedding"))
    store.upsert(v.filter("vec_id % 2 = 0 or vec_id % 3 = 0").withColumn("embedding", turned))
    store.upsert(v.filter("vec_id % 2 = 1 or vec_id % 3 = 0"))
    return VectorStore(spark, store.path, 64, id_col="vec_id", vector_col="embedding")


@suite.add("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, round(list_cosine_similarity(q.e, d.e), 6) AS score FROM v q, v d WHERE q.vec_id % 50 = 0)
SELECT query_id, doc_id, greatest(0, score) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 10""")
def vector_store_topk(spark, sf):
    """Every fiftieth vector against a store that was filled, changed and opened again."""
    return _stored(spark, sf).search(read(spark, sf, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"))[0]


_MEASURES = ", ".join([*(f"round(sum(CASE WHEN rank <= {k} THEN hit ELSE 0 END)::DOUBLE / {k}, 6) AS p{k}, (sum(CASE WHEN rank <= {k} THEN hit ELSE 0 END) > 0)::INT AS h{k}" for k in (1, 3, 5, 10))])


@suite.add(f"""WITH {_bm25_sql(1.5, 0.75, True, 100)}, {_JUDGED},
j AS (SELECT b.*, coalesce(gain, 0) AS gain, (coalesce(gain, 0) > 0)::INT AS hit FROM bm b LEFT JOIN judged USING (query_id, doc_id)),
p AS (SELECT query_id, sum(CASE WHEN rank <= 10 THEN (2.0 ** gain - 1)::DOUBLE / log2(rank + 1) ELSE 0 END) AS dcg, min(CASE WHEN hit = 1 AND rank <= 10 THEN rank END) AS first, sum(hit) AS h100, {_MEASURES} FROM j GROUP BY query_id),
i AS (SELECT query_id, sum(CASE WHEN place <= 10 THEN (2.0 ** gain - 1)::DOUBLE / log2(place + 1) ELSE 0 END) AS ideal, count(*) AS relevant FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC, doc_id) AS place FROM judged) GROUP BY query_id)
SELECT query_id, round(coalesce(dcg, 0) / ideal, 6) AS ndcg_10, round(coalesce(1.0::DOUBLE / first, 0), 6) AS mrr_10, {", ".join(f"coalesce(p{k}, 0) AS precision_{k}, coalesce(h{k}, 0) AS hit_{k}" for k in (1, 3, 5, 10))},
 round(coalesce(h100, 0)::DOUBLE / relevant, 6) AS recall_100 FROM i LEFT JOIN p USING (query_id)""")
def retrieval_eval(spark, sf):
    """Judged are documents that hold at least 60 % of a benchmark text's words; 90 % count double."""
    words = R.Lexical(_docs(spark, sf), _asked(spark, sf))
    return R.evaluate(words.best(100), words.judged(0.6, 0.9))


#: Aliases of the query variants below.
_ALIASES = {"the": "of", "and": "with", "der": "die"}


@suite.add()
def query_plans(spark, sf):
    """Variants of every benchmark text, and those that keep its protected terms."""
    plan = _asked(spark, sf).select("query_id", T.query_plan("text", _ALIASES).alias("p"), "text")
    return plan.select("query_id", F.col("p.keyword").alias("keyword"), F.size("p.must_keep").cast("long").alias("n_kept"), F.size(T.valid_variants(F.col("p"), F.col("text"))["accepted"]).cast("long").alias("n_accepted"))


@suite.add()
def multi_query_topk(spark, sf):
    return R.multi_query(_docs(spark, sf), _asked(spark, sf), _ALIASES)


def _dense_sql(k: int, name: str = "dk") -> str:
    """The best ``k`` by hashed vectors, as ``(cos + 1) / 2``; needs ``hv`` over documents and, below 0, benchmark texts."""
    return f"""{name}q AS (SELECT -1 - doc_id AS query_id, dim, weight AS w FROM hv WHERE doc_id < 0),
{name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, round((coalesce(sum(p), 0) + 1) / 2, 6) AS score
 FROM (SELECT query_id, doc_id, weight * w AS p FROM hv JOIN {name}q USING (dim) WHERE doc_id >= 0 UNION ALL SELECT item_id, doc_id, 0.0 FROM benchmark, documents) GROUP BY ALL) QUALIFY rank <= {k})"""


_BOTH_HASHED = _HASH.format(tokens=_TOKENS, table="(SELECT doc_id, text FROM documents UNION ALL SELECT -1 - item_id, text FROM benchmark)")


def _rated_sql(keys: str) -> str:
    """Mean nDCG at 10 of each setting of ``rk(<keys>, query_id, doc_id, rank)`` over all judged queries."""
    return f"""ideal AS (SELECT query_id, sum(CASE WHEN place <= 10 THEN (2.0 ** gain - 1)::DOUBLE / log2(place + 1) ELSE 0 END) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC, doc_id) AS place FROM judged) GROUP BY query_id),
dcg AS (SELECT {keys}, query_id, sum(CASE WHEN rank <= 10 THEN (2.0 ** gain - 1)::DOUBLE / log2(rank + 1) ELSE 0 END) AS dcg FROM rk JOIN judged USING (query_id, doc_id) GROUP BY ALL)
SELECT {keys}, round(avg(round(coalesce(dcg, 0) / ideal, 6)), 6) AS ndcg_10 FROM (SELECT * FROM (SELECT DISTINCT {keys} FROM rk), ideal) LEFT JOIN dcg USING ({keys}, query_id) GROUP BY ALL"""


_SETTINGS = ((1.2, 0.75), (1.5, 0.75), (1.8, 0.25))


@suite.add(f"""WITH {", ".join(_bm25_sql(k1, b, True, 100, name=f"g{n}") for n, (k1, b) in enumerate(_SETTINGS))}, {_JUDGED},
rk AS ({" UNION ALL ".join(f"SELECT {k1}::DOUBLE AS k1, {b}::DOUBLE AS b, query_id, doc_id, rank FROM g{n}" for n, (k1, b) in enumerate(_SETTINGS))}),
{_rated_sql("k1, b")}""")
def tuned_bm25(spark, sf):
    words = R.Lexical(_docs(spark, sf), _asked(spark, sf))
    return R.tuned(words, words.judged(0.6, 0.9), _SETTINGS)


def _two_sides(spark, sf):
    """Lexical and dense rankings, and judgements."""
    words = R.Lexical(_docs(spark, sf), _asked(spark, sf))
    return written(words.best(100), "lexical"), written(R.hashing_search(_docs(spark, sf), _asked(spark, sf), 100, method="md5"), "dense"), words.judged(0.6, 0.9)


_SIDES = f"{_bm25_sql(1.5, 0.75, True, 100)}, {_BOTH_HASHED}, {_dense_sql(100)}, {_JUDGED}"


@suite.add(f"""WITH {_SIDES},
nb AS (SELECT query_id, doc_id, score / max(score) OVER (PARTITION BY query_id) AS x FROM bm), st AS (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0])::DOUBLE AS lexical),
sc AS (SELECT lexical, 1 - lexical AS dense, query_id, doc_id, round(lexical * coalesce(x, 0) + (1 - lexical) * coalesce(score, 0), 6) AS score FROM nb FULL JOIN dk USING (query_id, doc_id), st),
rk AS (SELECT *, row_number() OVER (PARTITION BY lexical, query_id ORDER BY score DESC, doc_id) AS rank FROM sc QUALIFY rank <= 100),
{_rated_sql("lexical, dense")}""")
def tuned_fusion(spark, sf):
    return R.tuned_fusion(*_two_sides(spark, sf))


@suite.add(f"""WITH {_SIDES},
st AS (SELECT * FROM (SELECT unnest([0.25, 0.5, 0.75])::DOUBLE AS lexical), (SELECT unnest([10, 30, 60, 100]) AS constant)),
sc AS (SELECT lexical, 1 - lexical AS dense, constant, query_id, doc_id, round(coalesce(lexical / (constant + bm.rank), 0) + coalesce((1 - lexical) / (constant + dk.rank), 0), 9) AS score FROM bm FULL JOIN dk USING (query_id, doc_id), st),
rk AS (SELECT *, row_number() OVER (PARTITION BY lexical, constant, query_id ORDER BY score DESC, doc_id) AS rank FROM sc QUALIFY rank <= 100),
{_rated_sql("lexical, dense, constant")}""")
def tuned_rrf(spark, sf):
    return R.tuned_rrf(*_two_sides(spark, sf))


@suite.add(f"""WITH {_SIDES},
rk AS (SELECT 'lexical' AS name, query_id, doc_id, rank FROM bm UNION ALL SELECT 'hashing', query_id, doc_id, rank FROM dk),
{_rated_sql("name")}""")
def selected_retriever(spark, sf):
    lexical, dense, judged = _two_sides(spark, sf)
    return R.selected({"lexical": lexical, "hashing": dense}, judged)


@suite.add(f"""WITH {_bm25_sql(1.5, 0.75, True, 10)},
r AS (SELECT item_id AS case_id, min(rank) AS rank, CASE WHEN item_id % 3 = 0 THEN 'hard' ELSE 'easy' END AS difficulty FROM benchmark LEFT JOIN bm ON item_id = query_id AND score > 60 GROUP BY item_id)
SELECT difficulty, count(*) AS n_cases, round(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0.0 END), 6) AS recall FROM r GROUP BY difficulty""")
def difficulty_recall(spark, sf):
    return R.difficulty_recall(_ranks(spark, sf))


def _ranks(spark, sf):
    best = R.bm25(_docs(spark, sf), _asked(spark, sf)).filter("score > 60").groupBy("query_id").agg(F.min("rank").alias("rank"))
    cases = read(spark, sf, "benchmark").select(F.col("item_id").alias("case_id"), F.when(F.col("item_id") % 3 == 0, "hard").otherwise("easy").alias("difficulty"))
    return cases.join(best, F.col("case_id") == F.col("query_id"), "left").select("case_id", "rank", "difficulty")


@suite.add(f"""WITH {_bm25_sql(1.5, 0.75, True, 10)},
r AS (SELECT item_id, min(rank) AS rank FROM benchmark LEFT JOIN bm ON item_id = query_id AND score > 60 GROUP BY item_id)
SELECT count(*) AS n_cases, {", ".join(f"round(avg(CASE WHEN rank <= {k} THEN 1.0 ELSE 0.0 END), 6) AS recall_{k}" for k in (1, 3, 5))}, round(avg(CASE WHEN rank <= 3 THEN 1.0::DOUBLE / rank ELSE 0 END), 6) AS mrr_3, round(avg(CASE WHEN rank <= 3 THEN 1.0::DOUBLE / log2(rank + 1) ELSE 0 END), 6) AS ndcg_3 FROM r""")
def case_metrics(spark, sf):
    return R.case_metrics(_ranks(spark, sf))


def _chunks(spark, sf):
    """Documents as chunks: their source stands for the paper, their language for the section."""
    section = F.when(F.col("lang") == "en", "methods").when(F.col("lang") == "de", "results").otherwise("body")
    return read(spark, sf, "documents").select("doc_id", "text", section.alias("section"), F.length("lang").alias("section_priority"), F.col("source").alias("paper_id"))


_SECTIONS = "CASE lang WHEN 'en' THEN 1.0 WHEN 'de' THEN 0.68 ELSE 0.35 END"


@suite.add(f"""WITH {_bm25_sql(1.2, 0.75, False, 1 << 40, _SERVICE)}, {_BOTH_HASHED}, {_dense_sql(40)}, {_COVERED},
b AS (SELECT item_id AS query_id, NOT regexp_matches(text, '[A-Za-z]') OR length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g')) / greatest(1, length(text)) > 0.35 AS other FROM benchmark), top AS (SELECT query_id, max(score) AS most FROM bm GROUP BY query_id),
j AS (SELECT b.query_id, d.doc_id, length(lang) AS section_priority, {_SECTIONS}::DOUBLE AS section_score, (source = 'web')::INT::DOUBLE AS graph_score, coalesce(dk.score, 0) AS semantic_score,
  CASE WHEN other OR most IS NULL THEN coalesce(cv.score, 0) ELSE coalesce(bm.score, 0) / most END AS lexical_score
 FROM b CROSS JOIN documents d LEFT JOIN dk ON dk.query_id = b.query_id AND dk.doc_id = d.doc_id LEFT JOIN bm ON bm.query_id = b.query_id AND bm.doc_id = d.doc_id LEFT JOIN cv ON cv.query_id = b.query_id AND cv.doc_id = d.doc_id LEFT JOIN top ON top.query_id = b.query_id),
s AS (SELECT *, greatest(0, least(1, round(0.55::DOUBLE * semantic_score + 0.30::DOUBLE * lexical_score + 0.10::DOUBLE * section_score + 0.05::DOUBLE * graph_score, 6))) AS score FROM j)
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, section_priority, doc_id) AS rank, semantic_score, round(lexical_score, 6) AS lexical_score, section_score, graph_score FROM s QUALIFY rank <= 10""")
def evidence_topk(spark, sf):
    related = _asked(spark, sf).select("query_id", F.lit("web").alias("paper_id"))
    return R.evidence(_chunks(spark, sf), _asked(spark, sf), related, dense=_by_md5)


def _by_md5(docs, queries, k):
    """Feature hashing that SQL can do too."""
    return R.hashing_search(docs, queries, k, method="md5")


@suite.add(f"""WITH {_bm25_sql(1.2, 0.75, False, 50, _SERVICE, True)}, {_bm25_sql(1.2, 0.75, False, 1 << 40, _SERVICE, name="every")}, {_BOTH_HASHED}, {_dense_sql(50)},
nb AS (SELECT query_id, doc_id, coalesce(score / nullif(max(score) OVER (PARTITION BY query_id), 0), 0) AS x FROM bm),
f AS (SELECT query_id, doc_id, round(0.55::DOUBLE * coalesce(x, 0) + 0.45::DOUBLE * coalesce(score, 0), 6) AS fused FROM nb FULL JOIN dk USING (query_id, doc_id)),
p AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, doc_id) <= 50),
r AS (SELECT query_id, doc_id, coalesce(score, 0) AS score FROM p LEFT JOIN every USING (query_id, doc_id)),
n AS (SELECT query_id, doc_id, coalesce(score / nullif(max(score) OVER (PARTITION BY query_id), 0), 0) AS score FROM r)
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM n QUALIFY rank <= 10""")
def service_hybrid_rerank(spark, sf):
    return R.search(_docs(spark, sf), _asked(spark, sf), "hybrid_rerank", dense=_by_md5)
