"""Queries on single values and records: normalisers, rules, taggers, scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import normalise as N
from ..functions import text as T
from ..operators import quality as Q
from ..operators import sequence as S
from ..sources import chunks, readers
from .tables import Suite, read

suite = Suite()
QUERIES, ORACLE_SQL = suite.queries, suite.sql


@suite.add("""WITH a AS (SELECT p_partkey, p_size, p_size * 3 - 10 AS age FROM part)
SELECT p_partkey, CASE WHEN age < 0 OR age > 120 THEN NULL WHEN age < 40 THEN '<40' WHEN age < 50 THEN '40-49' WHEN age < 60 THEN '50-59' WHEN age < 70 THEN '60-69' ELSE '>=70' END AS age_group,
 CASE WHEN p_size % 6 = 2 THEN 'equivocal' WHEN p_size % 6 = 3 THEN 'positive' WHEN p_size % 6 < 2 THEN 'negative' END AS polarity, CASE WHEN p_size % 3 = 1 THEN 1 WHEN p_size % 3 = 0 THEN 0 END AS flag, p_size % 5 >= 2 AS altered FROM a""")
def value_normalise(spark, sf):
    size = F.col("p_size")
    return read(spark, sf, "part").select("p_partkey", T.age_group((size * 3 - 10).cast("string")).alias("age_group"), N.receptor_polarity(F.concat((size % 6).cast("string"), F.lit("+"))).alias("polarity"), N.mutation_flag((size % 3).cast("string")).alias("flag"), T.altered((size % 5).cast("string")).alias("altered"))


_CASES = ["HER2", "tp53", "P53", "BRCA-1", "x y", "", "herceptin", "T-DM1", "alpelisib + fulvestrant"]


@suite.add("""WITH v AS (SELECT event_id, ['HER2', 'tp53', 'P53', 'BRCA-1', 'x y', '', 'herceptin', 'T-DM1', 'alpelisib + fulvestrant'][event_id % 9 + 1] AS x FROM events)
SELECT event_id, CASE x WHEN 'HER2' THEN 'ERBB2' WHEN 'tp53' THEN 'TP53' WHEN 'P53' THEN 'TP53' WHEN 'x y' THEN NULL WHEN '' THEN NULL WHEN 'alpelisib + fulvestrant' THEN NULL ELSE upper(x) END AS gene,
 CASE x WHEN 'herceptin' THEN 'Trastuzumab' WHEN 'T-DM1' THEN 'Trastuzumab emtansine' WHEN '' THEN NULL ELSE x END AS drug,
 (CASE x WHEN '' THEN 0 WHEN 'herceptin' THEN 1 WHEN 'T-DM1' THEN 1 WHEN 'alpelisib + fulvestrant' THEN 0.6 ELSE 0.9 END)::DOUBLE AS drug_confidence FROM v""")
def gene_drug_normalise(spark, sf):
    x = F.element_at(F.array(*map(F.lit, _CASES)), (F.col("event_id") % 9 + 1).cast("int"))
    e = read(spark, sf, "events").select("event_id", x.alias("x"))
    return e.select("event_id", N.gene("x")["value"].alias("gene"), N.drug("x")["value"].alias("drug"), N.drug("x")["confidence"].alias("drug_confidence"))


@suite.add("SELECT page_id, list_distinct(regexp_extract_all(upper('GSE' || (1000 + page_id) || ' ' || url || ' gse77'), '\\bGSE[0-9]{3,}\\b')) AS found, len(regexp_extract_all(html, '<a href=\"([^\"]*)\"')) AS n_links, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def accession_extract(spark, sf):
    p = read(spark, sf, "pages")
    blob = F.concat(F.lit("GSE"), (F.col("page_id") + 1000).cast("string"), F.lit(" "), F.col("url"), F.lit(" gse77"))
    return p.select("page_id", T.accessions(blob).alias("found"), F.size(readers.html_links("html")).cast("long").alias("n_links"), readers.html_title("html").alias("title"))


@suite.add()
def html_table_cells(spark, sf):
    return readers.html_cells(read(spark, sf, "pages"))


@suite.add()
def html_text(spark, sf):
    return read(spark, sf, "pages").select("page_id", readers.html_text("html").alias("text"))


@suite.add()
def chunk_documents(spark, sf):
    return chunks.chunked(read(spark, sf, "documents")).drop("text")


@suite.add("""SELECT 'row:' || c_custkey AS location, field, value, 0.9::DOUBLE AS confidence, CASE field WHEN 'c_name' THEN 'categorical' WHEN 'c_mktsegment' THEN 'categorical' ELSE 'continuous' END AS kind FROM
 (SELECT c_custkey, 'c_name' AS field, c_name AS value FROM customer UNION ALL SELECT c_custkey, 'c_nationkey', c_nationkey::VARCHAR FROM customer UNION ALL SELECT c_custkey, 'c_mktsegment', c_mktsegment FROM customer)""")
def parsed_cells(spark, sf):
    return readers.cells(read(spark, sf, "customer"), "c_custkey", ["c_name", "c_nationkey", "c_mktsegment"])


@suite.add()
def protected_terms(spark, sf):
    return read(spark, sf, "documents").select("doc_id", T.protected_terms("text", None).alias("terms"))


def _faulty(spark, sf):
    k = F.col("o_orderkey")
    return read(spark, sf, "orders").select(k.alias("id"), F.when(k % 11 == 0, F.lower("o_orderstatus")).when(k % 37 == 0, "Z").otherwise(F.col("o_orderstatus")).alias("status"), F.when(k % 53 == 0, "").otherwise(F.col("o_orderpriority")).alias("priority"), F.when(k % 71 == 0, -1).otherwise(k % 100).cast("string").alias("age"))


def _rules():
    return [Q.required("priority"), *Q.allowed("status", ["F", "O", "P"]), Q.in_range("age", 0, 120), Q.Rule("OLD_FINISHED", "cross_domain_response", "high", "age", (T.number("age") > 97) & (F.col("status") == "F"))]


_FAULTY = """d AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN lower(o_orderstatus) WHEN o_orderkey % 37 = 0 THEN 'Z' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 53 = 0 THEN '' ELSE o_orderpriority END AS priority, (CASE WHEN o_orderkey % 71 = 0 THEN -1 ELSE o_orderkey % 100 END)::VARCHAR AS age FROM orders),
fi AS (SELECT id, 'REQUIRED_priority' AS rule, 'missing_required_field' AS kind, 'high' AS risk, 'priority' AS field, priority AS observed, NULL::VARCHAR AS candidate FROM d WHERE priority = ''
 UNION ALL SELECT id, 'CASING_NORMALIZATION', 'casing', 'low', 'status', status, upper(status) FROM d WHERE status NOT IN ('F', 'O', 'P') AND upper(status) IN ('F', 'O', 'P')
 UNION ALL SELECT id, 'FROZEN_SCHEMA_ALLOWED_VALUE', 'invalid_schema_value', 'medium', 'status', status, NULL FROM d WHERE status <> '' AND upper(status) NOT IN ('F', 'O', 'P')
 UNION ALL SELECT id, 'FROZEN_SCHEMA_RANGE', 'invalid_schema_value', 'medium', 'age', age, NULL FROM d WHERE age::INT < 0 OR age::INT > 120
 UNION ALL SELECT id, 'OLD_FINISHED', 'cross_domain_response', 'high', 'age', age, NULL FROM d WHERE age::INT > 97 AND status = 'F')"""
_DECIDED = """de AS (SELECT *, CASE WHEN kind IN ('missing_required_field', 'invalid_schema_value') THEN 'BLOCK' WHEN bool_or(kind IN ('missing_required_field', 'invalid_schema_value') OR risk = 'high') OVER (PARTITION BY id) THEN 'REVIEW' WHEN candidate IS NOT NULL THEN 'AUTO' ELSE 'REVIEW' END AS decision FROM fi)"""
_PER = "pe AS (SELECT id, bool_or(decision = 'BLOCK') AS b, bool_or(decision = 'REVIEW') AS r, max(CASE WHEN decision = 'AUTO' THEN candidate END) AS c FROM de GROUP BY id)"


@suite.add(f"WITH {_FAULTY} SELECT id, rule, kind, risk, field, observed, candidate FROM fi")
def rule_findings(spark, sf):
    return Q.findings(_faulty(spark, sf), _rules(), "id")


@suite.add(f"WITH {_FAULTY} SELECT kind, count(*) AS n FROM fi GROUP BY kind")
def finding_counts(spark, sf):
    return Q.summary(rule_findings(spark, sf))


@suite.add(f"WITH {_FAULTY}, {_DECIDED} SELECT id, rule, decision, (CASE WHEN decision = 'AUTO' THEN 0.99 WHEN risk = 'high' THEN 0.82 ELSE 0.72 END)::DOUBLE AS confidence FROM de")
def policy_decisions(spark, sf):
    return Q.decide(rule_findings(spark, sf)).select("id", "rule", "decision", "confidence")


@suite.add(f"WITH {_FAULTY}, {_DECIDED}, {_PER} SELECT id, coalesce(c, status) AS status, CASE WHEN b THEN 'blocked' WHEN r THEN 'review' WHEN c IS NOT NULL THEN 'repaired' ELSE 'clean' END AS disposition FROM d LEFT JOIN pe USING (id)")
def safe_apply(spark, sf):
    d = _faulty(spark, sf)
    return Q.apply(d, Q.decide(rule_findings(spark, sf)), ["status"], "id").select("id", "status", "disposition")


@suite.add(f"""WITH {_FAULTY}, {_DECIDED}, {_PER}, a AS (SELECT id, coalesce(c, status) AS new, status AS old, age, CASE WHEN b THEN 'blocked' WHEN r THEN 'review' WHEN c IS NOT NULL THEN 'repaired' ELSE 'clean' END AS disposition FROM d LEFT JOIN pe USING (id))
SELECT id, CASE WHEN disposition = 'repaired' AND age::INT > 97 AND new = 'F' THEN old ELSE new END AS status, CASE WHEN disposition = 'repaired' AND age::INT > 97 AND new = 'F' THEN 'rolled_back' ELSE disposition END AS disposition FROM a""")
def repair_and_roll_back(spark, sf):
    d = _faulty(spark, sf)
    repaired = Q.apply(d, Q.decide(rule_findings(spark, sf)), ["status"], "id")
    return Q.roll_back(d, repaired, _rules(), ["status"], "id").select("id", "status", "disposition")


@suite.add(f"WITH {_FAULTY}, {_DECIDED}, {_PER} SELECT (SELECT count(*) FROM d) AS n_records, count(*) FILTER (b) AS n_blocked, count(*) FILTER (r AND NOT b) AS n_review, CASE WHEN count(*) FILTER (b) > 0 THEN 'NOT_READY' WHEN count(*) FILTER (r) > 0 THEN 'REVIEW' ELSE 'READY' END AS status FROM pe")
def hard_gates(spark, sf):
    return Q.hard_gates(_faulty(spark, sf), Q.decide(rule_findings(spark, sf)), "id")


@suite.add(f"WITH {_FAULTY}, {_DECIDED} SELECT 'review:' || substr(sha256(id || '|' || rule || '|' || field), 1, 24) AS review_id, id, rule, field, decision, CASE risk WHEN 'low' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS priority FROM de WHERE decision <> 'AUTO'")
def review_queue(spark, sf):
    return Q.review_queue(Q.decide(rule_findings(spark, sf)))


def _tagged(spark, sf):
    """Tokens of conversations; those of the benchmark are positive."""
    words = read(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc"), F.posexplode(T.tokens("text")).alias("pos", "token"))
    known = read(spark, sf, "benchmark").select(F.explode(T.word_set("text")).alias("token")).distinct().withColumn("label", F.lit(1))
    return words.join(known, "token", "left").select("doc", "pos", "token", F.coalesce("label", F.lit(0)).alias("label"))


_WORDS = "regexp_extract_all(replace(lower(coalesce(text, '')), 'ß', 'ss'), '[a-z0-9][a-z0-9_+.-]*')"
_TAGGED = f"""k AS (SELECT DISTINCT unnest({_WORDS}) AS token FROM benchmark), w AS (SELECT conv_id * 1000 + turn AS doc, unnest({_WORDS}) AS token, unnest(range(len({_WORDS}))) AS pos FROM conversations),
x AS (SELECT doc, pos, w.token, (k.token IS NOT NULL)::INT AS label FROM w LEFT JOIN k ON w.token = k.token)"""


@suite.add(f"WITH {_TAGGED} SELECT token, round(avg(label), 6) AS p, count(*) AS n FROM x GROUP BY token HAVING count(*) >= 2")
def token_lexicon(spark, sf):
    return S.token_lexicon(_tagged(spark, sf)).withColumn("p", F.round("p", 6))


@suite.add(f"WITH {_TAGGED}, y AS (SELECT *, coalesce(lag(token) OVER (PARTITION BY doc ORDER BY pos), '<s>') AS before FROM x) SELECT before, token, round(avg(label), 6) AS p, count(*) AS n FROM y GROUP BY ALL HAVING count(*) >= 2")
def context_lexicon(spark, sf):
    return S.context_lexicon(_tagged(spark, sf)).withColumn("p", F.round("p", 6))


@suite.add(f"""WITH {_TAGGED}, y AS (SELECT doc, pos, label, coalesce(max(CASE WHEN label = 1 THEN pos END) OVER (PARTITION BY doc ORDER BY pos), -99) AS l, min(CASE WHEN label = 1 THEN pos END) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS f FROM x)
SELECT doc, pos::INT AS pos, CASE WHEN label = 1 OR coalesce(l >= 0 AND f - l - 1 <= 2, false) THEN 1 ELSE 0 END AS filled FROM y""")
def gap_fill(spark, sf):
    x = _tagged(spark, sf).withColumn("predicted", F.col("label"))
    return S.fill_gaps(x, 2).select("doc", "pos", "filled")


@suite.add(f"WITH {_TAGGED}, s AS (SELECT token, avg(label) AS p FROM x GROUP BY 1 HAVING count(*) >= 2) SELECT count(*) FILTER (coalesce(p, 0) >= 0.5 AND label = 1) AS tp, count(*) FILTER (coalesce(p, 0) >= 0.5 AND label = 0) AS fp, count(*) FILTER (coalesce(p, 0) < 0.5 AND label = 1) AS fn FROM x LEFT JOIN s USING (token)")
def lexicon_tagger_eval(spark, sf):
    x = _tagged(spark, sf)
    return S.evaluate(S.predict(x, S.token_lexicon(x)))


@suite.add()
def sequence_features(spark, sf):
    return S.features(_tagged(spark, sf)).groupBy("feature").agg(F.count("*").alias("n"), F.sum("label").alias("n_positive"))
