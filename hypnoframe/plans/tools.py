"""Registered queries of the table tools and models, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from hypnoframe.functions import learn
from hypnoframe.operators import wide

QUERIES: dict = {}
ORACLE: dict = {}


def _tool(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def _read(spark, d: str, name: str):
    return spark.read.parquet(f"{d}/{name}.parquet")


@_tool("""SELECT o_orderkey, 1 AS pos, 'o_custkey' AS variable, CAST(o_custkey AS VARCHAR) AS value FROM orders UNION ALL SELECT o_orderkey, 2, 'o_orderstatus', o_orderstatus FROM orders UNION ALL SELECT o_orderkey, 3, 'o_orderpriority', o_orderpriority FROM orders""")
def tab_vertical(spark, d):
    return wide.vertical(_read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"), ["o_orderkey"])


@_tool("""SELECT l_suppkey, """ + ", ".join(f"max({v}) FILTER (l_returnflag = '{r}' AND l_linestatus = '{s}') AS \"{v}_l_returnflag_{r}_l_linestatus_{s}\"" for v in ("l_quantity", "l_extendedprice") for r in "ANR" for s in "FO") + " FROM lineitem GROUP BY l_suppkey")
def tab_by_columns(spark, d):
    t = _read(spark, d, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice")
    out = wide.by_columns(t, ["l_suppkey"], {"l_returnflag": list("ANR"), "l_linestatus": list("FO")})
    return out.toDF(*(c.replace(".", "_") for c in out.columns))


@_tool("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def tab_filled_rows(spark, d):
    """Partial rows, each with one of two columns, put together again."""
    c = _read(spark, d, "customer")
    a = c.select("c_custkey", "c_name", F.lit("NA").alias("c_mktsegment"))
    return wide.filled_rows(a.unionByName(c.select("c_custkey", F.lit(".").alias("c_name"), "c_mktsegment")), ["c_custkey"])


@_tool("""SELECT p_partkey, TRY_CAST(CASE WHEN p_size != 7 THEN p_size END AS DOUBLE) AS "SIZE", CASE WHEN p_brand NOT IN ('Brand#11', 'Brand#12') THEN p_brand END AS "BRAND" FROM part""")
def tab_typed(spark, d):
    """Columns of a dictionary with missing codes."""
    p = _read(spark, d, "part").select("p_partkey", F.col("p_size").alias("size"), F.col("p_brand").alias("brand"), "p_name")
    return wide.typed(p, ["p_partkey"], [("SIZE", "num", ["7"]), ("BRAND", "text", ["Brand#11", "Brand#12"]), ("ABSENT", "int", [])])


@_tool("""SELECT label, count(*) AS n FROM (SELECT CASE WHEN regexp_full_match(p, 'AUTO.*|BUILD.*') THEN 'made' WHEN regexp_full_match(p, '.*HOLD') THEN 'home' END AS label FROM (SELECT regexp_replace(upper(trim(c_mktsegment)), '[^A-Z0-9]+', '_', 'g') AS p FROM customer)) GROUP BY label""")
def tab_labels(spark, d):
    return wide.mapped_labels(_read(spark, d, "customer"), "c_mktsegment", [("auto.*|build.*", "made"), (".*hold", "home")]).groupBy("label").agg(F.count("*").alias("n"))


@_tool("""SELECT s_suppkey, s_name, n FROM supplier FULL JOIN (SELECT l_suppkey AS s_suppkey, count(*) AS n FROM lineitem GROUP BY 1) USING (s_suppkey)""")
def tab_joined(spark, d):
    n = _read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"))
    return wide.joined([_read(spark, d, "supplier").select("s_suppkey", "s_name"), n], ["s_suppkey"])


@_tool("""SELECT 'const' AS term, regr_intercept(l_extendedprice, l_quantity) AS coef FROM lineitem UNION ALL SELECT 'l_quantity', regr_slope(l_extendedprice, l_quantity) FROM lineitem UNION ALL SELECT 'R2', regr_r2(l_extendedprice, l_quantity) FROM lineitem""")
def learn_linear(spark, d):
    m = learn.linear(_read(spark, d, "lineitem"), ["l_quantity"], "l_extendedprice")
    return spark.createDataFrame([("const", float(m["coef"][0])), ("l_quantity", float(m["coef"][1])), ("R2", float(m["r2"]))], "term string, coef double")


@_tool("""WITH m AS (SELECT l_returnflag AS c, count(*) AS n, avg(l_quantity) AS a, avg(l_extendedprice) AS b, var_samp(l_quantity) AS aa, covar_samp(l_quantity, l_extendedprice) AS ab, var_samp(l_extendedprice) AS bb FROM lineitem GROUP BY 1),
k AS (SELECT *, aa * bb - ab * ab AS det, ln(n / (SELECT count(*) FROM lineitem)) - 0.5 * ln(aa * bb - ab * ab) AS base FROM m),
t AS (SELECT *, row_number() OVER () AS row FROM lineitem), s AS (SELECT row, l_returnflag AS truth, c, base - 0.5 * (bb * pow(l_quantity - a, 2) - 2 * ab * (l_quantity - a) * (l_extendedprice - b) + aa * pow(l_extendedprice - b, 2)) / det AS s FROM t, k)
SELECT truth, guess, count(*) AS n FROM (SELECT truth, arg_max(c, s) AS guess FROM s GROUP BY row, truth) GROUP BY ALL""")
def learn_quadratic(spark, d):
    """Confusion of quadratic discriminants on two correlated columns."""
    t, xs = _read(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"]
    guess = learn.quadratic_class(learn.quadratic(t, xs, "l_returnflag"), xs)
    return t.select(F.col("l_returnflag").alias("truth"), guess.alias("guess")).groupBy("truth", "guess").agg(F.count("*").alias("n"))


_lloyd = "WITH c0 AS (SELECT * FROM (VALUES (0, 10.0, 920.0), (1, 30.0, 950.0), (2, 40.0, 980.0)) y(k, a, b))" + "".join(
    f""", n{i} AS (SELECT p_partkey, any_value(p_size) AS a, any_value(p_retailprice) AS b, arg_min(k, (pow(p_size - c.a, 2) + pow(p_retailprice - c.b, 2), k)) AS k FROM part, c{i} c GROUP BY p_partkey), c{i + 1} AS (SELECT c.k, coalesce(avg(n.a), c.a) AS a, coalesce(avg(n.b), c.b) AS b FROM c{i} c LEFT JOIN n{i} n ON n.k = c.k GROUP BY c.k, c.a, c.b)"""
    for i in range(5)
)


@_tool(_lloyd + ' SELECT CAST(k AS INTEGER) AS k, a AS "p_size", b AS "p_retailprice" FROM c5')
def learn_k_means(spark, d):
    """Centres after five of Lloyd's steps."""
    c, _ = learn.k_means(_read(spark, d, "part"), ["p_size", "p_retailprice"], [[10, 920], [30, 950], [40, 980]], 5, 0.0)
    return spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(c)], "k int, p_size double, p_retailprice double")
