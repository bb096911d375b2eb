"""Repairs of tables that are corrupted by rule, and how well they do."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cleaning as C
from .tables import Suite, read

suite = Suite()
QUERIES, ORACLE_SQL = suite.queries, suite.sql


def _clean(spark, sf):
    return read(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"), F.col("p_size").cast("string").alias("size"))


def _dirty(spark, sf):
    k = F.col("p_partkey")
    c = _clean(spark, sf)
    masked = F.when(k % 97 == 0, F.concat(F.lit("x"), F.expr("substring(kind, 2)"))).otherwise(F.col("kind"))
    return c.withColumns({"brand": F.when(k % 89 == 0, F.concat(F.lit("typo"), k.cast("string"))).otherwise(F.col("brand")), "kind": masked, "size": F.when(k % 83 == 0, "n/a").when(k % 79 == 0, F.concat("size", F.lit(".0 oz"))).otherwise(F.col("size"))})


_DIRTY = """d AS (SELECT p_partkey, CASE WHEN p_partkey % 89 = 0 THEN 'typo' || p_partkey ELSE p_brand END AS brand, CASE WHEN p_partkey % 97 = 0 THEN 'x' || substr(p_type, 2) ELSE p_type END AS kind,
 CASE WHEN p_partkey % 83 = 0 THEN 'n/a' WHEN p_partkey % 79 = 0 THEN p_size || '.0 oz' ELSE p_size::VARCHAR END AS size FROM part)"""
_MODE = """n AS (SELECT lower(trim(brand)) AS v, count(*) AS n, min(p_partkey) AS o FROM d GROUP BY 1), m AS (SELECT v AS mode, n AS mode_n FROM n WHERE v <> '' ORDER BY n DESC, o LIMIT 1),
moded AS (SELECT p_partkey, CASE WHEN n.n = 1 AND mode_n >= 3 THEN mode ELSE brand END AS brand FROM d JOIN n ON lower(trim(brand)) = v, m)"""


@suite.add(f"WITH {_DIRTY}, {_MODE} SELECT p_partkey, brand FROM moded")
def clean_column_mode(spark, sf):
    return C.column_mode(_dirty(spark, sf), "brand", "p_partkey").select("p_partkey", "brand")


@suite.add(f"""WITH {_DIRTY}, n AS (SELECT lower(kind) AS k, lower(brand) AS v, count(*) AS n, min(p_partkey) AS o FROM d GROUP BY ALL), m AS (SELECT k, v AS mode, n AS mode_n FROM n QUALIFY row_number() OVER (PARTITION BY k ORDER BY n DESC, o) = 1)
SELECT p_partkey, CASE WHEN n.n = 1 AND mode_n >= 2 AND mode <> lower(brand) THEN mode ELSE brand END AS brand FROM d JOIN n ON lower(kind) = n.k AND lower(brand) = n.v JOIN m ON m.k = lower(kind)""")
def clean_context_mode(spark, sf):
    return C.context_mode(_dirty(spark, sf), "brand", ["kind"], "p_partkey").select("p_partkey", "brand")


_MASK = """c AS (SELECT kind AS v, count(*) AS n FROM d WHERE trim(kind) <> '' GROUP BY 1), f AS (SELECT a.v AS bad, b.v AS good, b.n FROM c a JOIN c b ON length(a.v) = length(b.v) WHERE a.n < 10 AND b.n >= 10 AND contains(lower(a.v), 'x') AND a.v <> b.v
  AND len(list_filter(range(1, length(a.v) + 1), lambda i: lower(substr(a.v, i, 1)) <> 'x' AND lower(substr(a.v, i, 1)) <> lower(substr(b.v, i, 1)))) = 0),
t AS (SELECT bad, good, n, lead(n) OVER (PARTITION BY bad ORDER BY n DESC, good DESC) AS nx FROM f QUALIFY row_number() OVER (PARTITION BY bad ORDER BY n DESC, good DESC) = 1),
unmasked AS (SELECT p_partkey, coalesce(good, kind) AS kind FROM d LEFT JOIN (SELECT * FROM t WHERE nx IS NULL OR n >= 3 * nx) ON bad = kind)"""


@suite.add(f"WITH {_DIRTY}, {_MASK} SELECT p_partkey, kind FROM unmasked")
def clean_placeholder(spark, sf):
    return C.placeholders(_dirty(spark, sf), "kind").select("p_partkey", "kind")


_SIZE = "sized AS (SELECT p_partkey, CASE WHEN lower(size) = 'n/a' THEN '' WHEN size LIKE '%.0 oz' THEN replace(size, '.0 oz', '') ELSE size END AS size FROM d)"


@suite.add(f"WITH {_DIRTY}, {_SIZE} SELECT p_partkey, size FROM sized")
def clean_format_profile(spark, sf):
    return C.integers(C.missing_markers(_dirty(spark, sf), ["size"]), ["size"]).select("p_partkey", "size")


@suite.add(f"""WITH {_DIRTY}, {_MODE}, {_MASK}, {_SIZE},
j AS (SELECT d.brand AS d1, d.kind AS d2, d.size AS d3, lower(p_brand) AS c1, p_type AS c2, p_size::VARCHAR AS c3, lower(moded.brand) AS r1, unmasked.kind AS r2, sized.size AS r3, lower(d.brand) AS l1 FROM d JOIN moded USING (p_partkey) JOIN unmasked USING (p_partkey) JOIN sized USING (p_partkey) JOIN part USING (p_partkey)),
x AS (SELECT l1 AS d, c1 AS c, r1 AS r FROM j UNION ALL SELECT d2, c2, r2 FROM j UNION ALL SELECT d3, c3, r3 FROM j)
SELECT count(*) FILTER (d <> c AND r = c) AS tp, count(*) FILTER (d = c AND r <> d) AS fp, count(*) FILTER (d <> c AND r <> c) AS fn, count(*) FILTER (r <> d) AS n_changed, count(*) FILTER (d <> c) AS n_dirty FROM x""")
def cell_metrics(spark, sf):
    low = lambda df: df.withColumn("brand", F.lower("brand"))
    d = _dirty(spark, sf)
    r = C.integers(C.missing_markers(C.placeholders(C.column_mode(d, "brand", "p_partkey"), "kind"), ["size"]), ["size"])
    return C.cell_metrics(low(d), low(_clean(spark, sf)), low(r), "p_partkey", ["brand", "kind", "size"])


def _flights(spark, sf):
    """Orders as reports of flights: four sources for each key, some cells blank or wrong."""
    k = F.col("o_orderkey")
    key = F.concat(F.element_at(F.array(*map(F.lit, ("aa", "bb", "cc"))), (F.floor(k / 4) % 3 + 1).cast("int")), F.lit("-"), F.floor(k / 4).cast("string"))
    src = F.element_at(F.array(*map(F.lit, ("aa", "bb", "cc", "dd"))), (k % 4 + 1).cast("int"))
    base = read(spark, sf, "orders").select(k, key.alias("flight"), src.alias("src"))
    return base.withColumns({"dep": F.when(k % 5 == 0, "").when(k % 11 == 0, F.concat("src", F.lit("!"))).otherwise(F.concat("flight", F.lit("d"))), "arr": F.when(k % 7 == 0, "").otherwise(F.concat("flight", F.lit("a")))})


_FLIGHTS = """b AS (SELECT o_orderkey, ['aa', 'bb', 'cc'][(o_orderkey // 4) % 3 + 1] || '-' || (o_orderkey // 4) AS flight, ['aa', 'bb', 'cc', 'dd'][o_orderkey % 4 + 1] AS src FROM orders),
fl AS (SELECT *, CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN o_orderkey % 11 = 0 THEN src || '!' ELSE flight || 'd' END AS dep, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE flight || 'a' END AS arr FROM b)"""


@suite.add(f"WITH {_FLIGHTS}, g AS (SELECT flight, min(dep) FILTER (dep <> '') AS lo, max(dep) FILTER (dep <> '') AS hi FROM fl GROUP BY 1) SELECT o_orderkey, CASE WHEN dep = '' AND lo = hi THEN lo ELSE dep END AS dep FROM fl JOIN g USING (flight)")
def clean_context_fill(spark, sf):
    return C.context_fill(_flights(spark, sf), "dep", "flight").select("o_orderkey", "dep")


@suite.add(f"""WITH {_FLIGHTS}, a AS (SELECT flight, dep AS d, arr AS r FROM fl WHERE src = split_part(flight, '-', 1) QUALIFY row_number() OVER (PARTITION BY flight ORDER BY ((dep <> '')::INT + (arr <> '')::INT < 1), o_orderkey) = 1)
SELECT o_orderkey, CASE WHEN coalesce(d, '') <> '' THEN d ELSE dep END AS dep, CASE WHEN coalesce(r, '') <> '' THEN r ELSE arr END AS arr FROM fl LEFT JOIN a USING (flight)""")
def clean_source_anchor(spark, sf):
    return C.source_anchor(_flights(spark, sf), "flight", "src", ["dep", "arr"], "o_orderkey").select("o_orderkey", "dep", "arr")


@suite.add("SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE '1/' || day(o_orderdate) || '/' || lpad((year(o_orderdate) % 100)::VARCHAR, 2, '0') END AS created_at FROM orders")
def clean_rotated_date(spark, sf):
    day = F.concat((F.year("o_orderdate") % 100).cast("string"), F.lit("/1/"), F.dayofmonth("o_orderdate").cast("string"))
    dirty = read(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 10 == 0, "").otherwise(day).alias("created_at"))
    return C.rotated_dates(dirty, "created_at")
