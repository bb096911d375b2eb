"""Profiles, duplicates, conflicts, associations, funnels and readiness."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions import text as T
from ..operators import profile as P
from .tables import Suite, read

suite = Suite()
QUERIES, ORACLE_SQL = suite.queries, suite.sql

_LINE = ["l_returnflag", "l_linestatus", "l_shipdate", "l_quantity"]


@suite.add(" UNION ALL ".join(f"SELECT '{c}' AS field, count(*) FILTER ({c} IS NOT NULL AND {c}::VARCHAR NOT IN ('', 'NA', 'N/A', '<缺失>')) AS filled, count(*) AS total, round(count(*) FILTER ({c} IS NOT NULL AND {c}::VARCHAR NOT IN ('', 'NA', 'N/A', '<缺失>'))::DOUBLE / count(*), 6) AS rate FROM documents" for c in ("text", "lang", "source")))
def field_completeness(spark, sf):
    return P.completeness(read(spark, sf, "documents"), ["text", "lang", "source"])


@suite.add("SELECT lang, round(avg((trim(coalesce(source, '')) <> '' OR trim(coalesce(text, '')) <> '')::INT), 6) AS rate FROM documents GROUP BY lang")
def fill_rate_by_lang(spark, sf):
    return read(spark, sf, "documents").groupBy("lang").agg(F.round(P.fill_rate(["source", "text"]), 6).alias("rate"))


@suite.add("SELECT CASE WHEN o_orderstatus IS NULL OR o_orderstatus IN ('', 'NA', 'N/A', '<缺失>') THEN '<missing>' ELSE o_orderstatus END AS category, count(*) AS n FROM orders GROUP BY ALL")
def class_distribution(spark, sf):
    return P.distribution(read(spark, sf, "orders"), "o_orderstatus")


@suite.add("SELECT source AS category, count(*) AS n FROM documents GROUP BY ALL ORDER BY n DESC, category LIMIT 6")
def category_top6(spark, sf):
    return P.distribution(read(spark, sf, "documents"), "source", top=6)


_NUM = "regexp_matches(trim(value), '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)$')"


@suite.add(f"""WITH c AS ({" UNION ALL ".join(f"SELECT '{c}' AS field, {c}::VARCHAR AS value FROM part" for c in ("p_name", "p_brand", "p_type", "p_size"))}),
s AS (SELECT field, count(*) FILTER (value <> '') AS n_filled, count(DISTINCT value) FILTER (value <> '') AS n_distinct, count(*) FILTER ({_NUM}) AS n_numeric FROM c GROUP BY field)
SELECT *, CASE WHEN n_filled = 0 THEN 'empty' WHEN 10 * n_numeric >= 8 * n_filled THEN 'numeric' ELSE 'text' END AS kind FROM s""")
def column_profile(spark, sf):
    return P.columns_profile(read(spark, sf, "part"), ["p_name", "p_brand", "p_type", "p_size"])


@suite.add("""WITH j AS (SELECT o.*, c_mktsegment, n_regionkey FROM orders o LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey),
s AS (SELECT count(*) AS a, count(*) FILTER (o_orderstatus = 'F') AS b, count(*) FILTER (o_orderstatus = 'F' AND c_mktsegment = 'BUILDING') AS c, count(*) FILTER (o_orderstatus = 'F' AND c_mktsegment = 'BUILDING' AND n_regionkey IN (1, 2)) AS d FROM j)
SELECT 1 AS step, 'finished' AS name, a AS before, b AS after, a - b AS excluded FROM s UNION ALL SELECT 2, 'building', b, c, b - c FROM s UNION ALL SELECT 3, 'regions', c, d, c - d FROM s""")
def cohort_funnel(spark, sf):
    customers = read(spark, sf, "customer").join(read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    joined = read(spark, sf, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"), "left")
    return P.funnel(joined, [("finished", F.col("o_orderstatus") == "F"), ("building", F.col("c_mktsegment") == "BUILDING"), ("regions", F.col("n_regionkey").isin(1, 2))])


@suite.add("SELECT min(doc_id) AS survivor, count(*) AS n_copies FROM documents GROUP BY text, lang HAVING count(*) > 1")
def exact_duplicates(spark, sf):
    return P.exact_duplicates(read(spark, sf, "documents"), ["text", "lang"], "doc_id")


@suite.add("SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1")
def keep_first_dedup(spark, sf):
    e = read(spark, sf, "events").select("event_id", "user_id", "event_type")
    return P.keep_first(e, F.concat_ws("|", "user_id", "event_type"), "event_id")


@suite.add("SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def keep_last_dedup(spark, sf):
    return P.keep_last(read(spark, sf, "events").select("event_id", "user_id", "event_type"), F.col("user_id"), "event_id")


@suite.add("""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE coalesce(source, '') END AS k FROM documents)
SELECT doc_id, k FROM d WHERE trim(k) = '' UNION ALL SELECT min(doc_id), k FROM d WHERE trim(k) <> '' GROUP BY k""")
def blank_key_dedup(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "").otherwise(T.text("source")).alias("k"))
    return P.keep_first(d, F.col("k"), "doc_id")


@suite.add("SELECT l_orderkey, count(DISTINCT l_suppkey) AS n_values, min(l_suppkey) AS least, max(l_suppkey) AS greatest FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_suppkey) > 1")
def identity_conflicts(spark, sf):
    return P.key_conflicts(read(spark, sf, "lineitem"), ["l_orderkey"], "l_suppkey")


@suite.add("SELECT l_orderkey, l_suppkey, count(DISTINCT l_partkey) AS n_values, min(l_partkey) AS least, max(l_partkey) AS greatest FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_partkey) > 1")
def identity_conflicts_by_pair(spark, sf):
    """Orders and suppliers together as the identity, with differing parts."""
    return P.key_conflicts(read(spark, sf, "lineitem"), ["l_orderkey", "l_suppkey"], "l_partkey")


@suite.add("SELECT user_id, count(DISTINCT value) AS n_values, count(DISTINCT event_type) AS n_sources FROM events WHERE value IS NOT NULL GROUP BY user_id HAVING count(DISTINCT value) > 1 AND count(DISTINCT event_type) > 1")
def authority_conflicts(spark, sf):
    return P.authority_conflicts(read(spark, sf, "events"), ["user_id"], "value", "event_type")


@suite.add("SELECT count(*) AS n, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL")
def pearson_assoc(spark, sf):
    return P.pearson(read(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")


@suite.add("""WITH c AS (SELECT o_orderstatus AS x, o_orderpriority AS y, count(*)::DOUBLE AS n FROM orders WHERE o_orderstatus IS NOT NULL AND o_orderpriority IS NOT NULL GROUP BY ALL),
t AS (SELECT sum(n) AS total, count(DISTINCT x) AS kx, count(DISTINCT y) AS ky FROM c), r AS (SELECT x, sum(n) AS nx FROM c GROUP BY x), k AS (SELECT y, sum(n) AS ny FROM c GROUP BY y),
s AS (SELECT sum((n - nx * ny / total) ** 2 / (nx * ny / total)) AS chi FROM (SELECT x, y FROM r, k) JOIN r USING (x) JOIN k USING (y) JOIN (SELECT r.x, k.y, coalesce(c.n, 0) AS n FROM r CROSS JOIN k LEFT JOIN c ON c.x = r.x AND c.y = k.y) USING (x, y), t)
SELECT total::BIGINT AS n, round(least(1, sqrt(chi / total / (least(kx, ky) - 1))), 6) AS v FROM s, t""")
def cramers_v(spark, sf):
    return P.cramers_v(read(spark, sf, "orders"), "o_orderstatus", "o_orderpriority")


@suite.add("""WITH x AS (SELECT 'all' AS stratum, 'all' AS category, * FROM lineitem UNION ALL SELECT 'l_returnflag', l_returnflag, * FROM lineitem UNION ALL SELECT 'l_linestatus', l_linestatus, * FROM lineitem)
SELECT stratum, category, count(*) AS n, round(avg(l_discount), 6) AS discount FROM x GROUP BY ALL""")
def stratified_report(spark, sf):
    return P.stratified(read(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], {"n": F.count("*"), "discount": F.round(F.avg("l_discount"), 6)})


@suite.add("""WITH s AS (SELECT count(*) AS n_rows, count(DISTINCT o_orderstatus) AS n_classes, count(o_custkey) - count(DISTINCT o_custkey) AS n_repeated, count(*) * 2 - count(NULLIF(o_orderpriority, '')) - count(NULLIF(o_orderstatus, '')) AS miss FROM orders),
m AS (SELECT *, round(miss / (n_rows * 2.0::DOUBLE), 6) AS missing FROM s)
SELECT n_rows, missing, n_classes, n_repeated, CASE WHEN n_rows = 0 OR n_classes = 0 THEN 'not_ready' WHEN n_rows < 30 OR missing > 0.2 OR n_classes < 2 OR n_repeated > 0 THEN 'review' ELSE 'ready' END AS status FROM m""")
def readiness_report(spark, sf):
    return P.readiness(read(spark, sf, "orders"), "o_orderstatus", "o_custkey", ["o_orderpriority", "o_orderstatus"])


@suite.add("""WITH s AS (SELECT count(*)::DOUBLE AS a, avg((l_returnflag = 'R')::INT) AS b, avg((l_shipdate IS NOT NULL)::INT) AS c FROM lineitem),
g AS (SELECT 'rows' AS gate, round(a, 6) AS value, 30 AS least FROM s UNION ALL SELECT 'outcome', round(b, 6), 0.75 FROM s UNION ALL SELECT 'field', round(c, 6), 0.45 FROM s)
SELECT gate, value, CASE WHEN coalesce(value, 0) <= 0 THEN 'REJECT' WHEN value < least THEN 'REVIEW' ELSE 'PASS' END AS verdict FROM g""")
def quality_gate_layers(spark, sf):
    rate = lambda c: F.avg(c.cast("double"))
    return P.gates(read(spark, sf, "lineitem"), {"rows": (F.count("*"), 30), "outcome": (rate(F.col("l_returnflag") == "R"), 0.75), "field": (rate(F.col("l_shipdate").isNotNull()), 0.45)})


@suite.add("""WITH e AS (SELECT event_id, user_id, event_type, date_trunc('minute', ts) AS t, value FROM events),
k AS (SELECT user_id, event_type, t, value, min(event_id) AS first FROM e GROUP BY ALL), g AS (SELECT user_id, event_type, t, count(*) AS n FROM k GROUP BY ALL)
SELECT event_id, CASE WHEN event_id <> first THEN 'duplicate' WHEN n > 1 OR e.value IS NULL OR e.value = 0 THEN 'review' ELSE 'accepted' END AS status
FROM e JOIN k ON e.user_id IS NOT DISTINCT FROM k.user_id AND e.event_type IS NOT DISTINCT FROM k.event_type AND e.t IS NOT DISTINCT FROM k.t AND e.value IS NOT DISTINCT FROM k.value
JOIN g ON e.user_id IS NOT DISTINCT FROM g.user_id AND e.event_type IS NOT DISTINCT FROM g.event_type AND e.t IS NOT DISTINCT FROM g.t""")
def observation_clean(spark, sf):
    e = read(spark, sf, "events").select("event_id", "user_id", "event_type", F.date_trunc("minute", "ts").alias("t"), "value")
    return P.clean_observations(e, ["user_id", "event_type", "t"], "value", "event_id").select("event_id", "status")


@suite.add(" UNION ALL ".join(f"SELECT s_suppkey, '{c}' AS field, {c}::VARCHAR AS value FROM supplier" for c in ("s_name", "s_nationkey")))
def unpivot_cells(spark, sf):
    return P.unpivot(read(spark, sf, "supplier"), ["s_suppkey"], ["s_name", "s_nationkey"])


@suite.add("SELECT user_id, max_by(value, event_id) FILTER (event_type = 'click') AS click, max_by(value, event_id) FILTER (event_type = 'error') AS error, max_by(value, event_id) FILTER (event_type = 'view') AS view FROM events GROUP BY user_id")
def eav_pivot_wide(spark, sf):
    last = read(spark, sf, "events").groupBy("user_id").pivot("event_type", ["click", "error", "view"])
    return last.agg(F.max_by("value", "event_id"))


@suite.add("SELECT count(*) AS n_orphans FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def orphan_anti_join(spark, sf):
    return read(spark, sf, "customer").join(read(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").agg(F.count("*").alias("n_orphans"))


@suite.add("SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, 'customer' AS catalogue FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, 'supplier' FROM supplier")
def multi_catalog_union(spark, sf):
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.lit("customer").alias("catalogue"))
    s = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("supplier").alias("catalogue"))
    return c.unionByName(s, allowMissingColumns=True)


@suite.add("""WITH p AS (SELECT lang, count(*) FILTER (quality = 1 AND n_chars >= 500) AS tp, count(*) FILTER (quality = 0 AND n_chars >= 500) AS fp, count(*) FILTER (quality = 1 AND n_chars < 500) AS fn FROM documents JOIN labels USING (doc_id) GROUP BY lang)
SELECT lang, tp, fp, fn, round(tp / NULLIF(tp + fp, 0)::DOUBLE, 6) AS precision, round(tp / NULLIF(tp + fn, 0)::DOUBLE, 6) AS recall, round(2 * tp / NULLIF(2 * tp + fp + fn, 0)::DOUBLE, 6) AS f1 FROM p""")
def confusion_by_lang(spark, sf):
    j = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id")
    good, long = F.col("quality") == 1, F.col("n_chars") >= 500
    p = j.groupBy("lang").agg(F.count_if(good & long).alias("tp"), F.count_if((F.col("quality") == 0) & long).alias("fp"), F.count_if(good & ~long).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return p.select("lang", "tp", "fp", "fn", F.round(M.precision(tp, fp), 6).alias("precision"), F.round(M.recall(tp, fn), 6).alias("recall"), F.round(M.f1(tp, fp, fn), 6).alias("f1"))


@suite.add("""WITH s AS (SELECT l_returnflag, avg(l_discount) * 10 AS a, avg(l_tax) * 10 AS b, avg(l_quantity) / 50 AS c FROM lineitem GROUP BY ALL)
SELECT l_returnflag, round(100 * (a * b * c) ** (1.0::DOUBLE / 3), 4) AS composite, round(CASE WHEN least(a, b, c) <= 0 THEN 0 ELSE (a / 4 * (b / 4) * (c / 4)) ** (1.0::DOUBLE / 3) END, 6) AS fitness FROM s""")
def composite_scores(spark, sf):
    s = read(spark, sf, "lineitem").groupBy("l_returnflag").agg((F.avg("l_discount") * 10).alias("a"), (F.avg("l_tax") * 10).alias("b"), (F.avg("l_quantity") / 50).alias("c"))
    parts = F.col("a"), F.col("b"), F.col("c")
    return s.select("l_returnflag", F.round(M.composite(*parts), 4).alias("composite"), F.round(M.geometric_fitness(*parts), 6).alias("fitness"))
