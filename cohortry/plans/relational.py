"""Scans, joins, set operations and aggregates over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import relational as R
from ..specs import Metric, MetricSource, UnitMetric
from .registry import load, query

ORDERS = MetricSource(
    "orders", "o_custkey",
    (UnitMetric("o_totalprice", "SUM", "revenue"), UnitMetric("o_orderkey", "COUNT", "n_orders")),
    (Metric("revenue", name="revenue"), Metric("revenue", "SUM", "n_orders", "SUM", name="order_value")),
    date_col="o_orderdate",
)
START, END = "1996-01-01", "1998-12-31"
DATES = f"o_orderdate BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'"


@query("SELECT o_orderkey, o_custkey, round(o_totalprice, 2) AS o_totalprice FROM orders WHERE " + DATES + " AND o_custkey % 100 IN (0, 1, 2, 3, 4, 5, 6, 7, 8, 9)")
def date_window_sample(spark: SparkSession, sf: str) -> DataFrame:
    df = R.sample_units(R.in_dates(load(spark, sf, "orders"), "o_orderdate", START, END), "o_custkey", percent=10)
    return df.select("o_orderkey", "o_custkey", F.round("o_totalprice", 2).alias("o_totalprice"))


@query("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_totalprice > 1000 AND o_orderpriority IS NOT NULL GROUP BY 1")
def scan_filter_group(spark: SparkSession, sf: str) -> DataFrame:
    return R.scan(load(spark, sf, "orders"), ["o_orderstatus"], [F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")], ["o_totalprice > 1000", "o_orderpriority is not null"])


def _join(how: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        c, o = load(spark, sf, "customer"), load(spark, sf, "orders")
        return R.join(c, o, [("c_custkey", "o_custkey")], how, ["c_custkey", "c_mktsegment as segment"], ["o_orderkey", "o_orderstatus as status"], ["c_custkey % 3 <> 0"], ["o_totalprice > 200000"])

    run.__name__ = f"join_{how}"
    sql = f"""SELECT c_custkey, c_mktsegment AS segment, o_orderkey, o_orderstatus AS status FROM (SELECT * FROM customer WHERE c_custkey % 3 <> 0) c
              {how} JOIN (SELECT * FROM orders WHERE o_totalprice > 200000) o ON c_custkey = o_custkey"""
    return query(sql)(run)


for _how in ("inner", "left", "right", "full"):
    _join(_how)


@query("SELECT n_name AS nation, r_name AS region FROM nation CROSS JOIN region WHERE n_nationkey < 5 AND r_regionkey <> 2")
def join_cross_prefiltered(spark: SparkSession, sf: str) -> DataFrame:
    return R.join(load(spark, sf, "nation"), load(spark, sf, "region"), (), "cross", ["n_name as nation"], ["r_name as region"], ["n_nationkey < 5"], ["r_regionkey <> 2"])


def _impacted(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf, "customer")
    return M.impacted_units([(c.where("c_custkey % 20 <> 0 and c_nationkey < 10"), "c_custkey"), (c.where("c_custkey % 7 = 3"), "c_custkey")])


IMPACTED = "SELECT DISTINCT c_custkey AS unit FROM customer WHERE (c_custkey % 20 <> 0 AND c_nationkey < 10) OR c_custkey % 7 = 3"


@query(IMPACTED)
def impacted_units(spark: SparkSession, sf: str) -> DataFrame:
    return _impacted(spark, sf)


@query(f"SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey IN ({IMPACTED}) GROUP BY 1")
def swi_semi_impacted(spark: SparkSession, sf: str) -> DataFrame:
    return R.semi(load(spark, sf, "orders"), _impacted(spark, sf), "o_custkey", "unit").groupBy("o_custkey").agg(F.count("*").alias("n"))


@query(f"SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey NOT IN ({IMPACTED}) GROUP BY 1")
def swi_anti_complement(spark: SparkSession, sf: str) -> DataFrame:
    return R.anti(load(spark, sf, "orders"), _impacted(spark, sf), "o_custkey", "unit").groupBy("o_custkey").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, o_custkey, round(o_totalprice, 2) AS o_totalprice FROM orders WHERE o_orderkey % 10 <> 3
          UNION ALL SELECT o_orderkey, o_custkey, round(o_totalprice * 2, 2) FROM orders WHERE o_orderkey % 10 = 3""")
def upsert_by_key(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    new = o.where("o_orderkey % 10 = 3").withColumn("o_totalprice", F.col("o_totalprice") * 2)
    return R.rounded(R.upsert(o, new, ["o_orderkey"]), 2)


_SIDE = "SELECT date_trunc('year', o_orderdate) AS y, sum(o_totalprice) AS total FROM orders WHERE o_orderstatus = '{}' GROUP BY 1"


@query(f"""SELECT y, round(a.total, 2) AS total_o, round(b.total, 2) AS total_f, round(b.total - a.total, 2) AS total_diff
           FROM ({_SIDE.format("O")}) a FULL JOIN ({_SIDE.format("F")}) b USING (y)""")
def compare_on_index(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders")
    side = lambda s: o.where(F.col("o_orderstatus") == s).groupBy(F.date_trunc("year", "o_orderdate").alias("y")).agg(F.sum("o_totalprice").alias("total"))
    return R.rounded(R.compare(side("O"), side("F"), ["y"], ["total"], labels=("o", "f")), 2)


# aggregates


@query(f"SELECT o_custkey, round(sum(o_totalprice), 2) AS revenue, count(o_orderkey) AS n_orders FROM orders WHERE {DATES} GROUP BY 1")
def unit_metrics_orders(spark: SparkSession, sf: str) -> DataFrame:
    return R.rounded(M.unit_metrics(load(spark, sf, "orders"), ORDERS, START, END), 2)


@query("SELECT l_suppkey, count(DISTINCT l_partkey) AS parts, count(CASE WHEN l_quantity > 25 THEN l_orderkey END) AS large, max(l_tax) AS most_tax FROM lineitem GROUP BY 1")
def count_distinct_metric(spark: SparkSession, sf: str) -> DataFrame:
    src = MetricSource("lines", "l_suppkey", (UnitMetric("l_partkey", "COUNT_DISTINCT", "parts"), UnitMetric("l_orderkey", "COUNT", "large", condition="l_quantity > 25"), UnitMetric("l_tax", "MAX", "most_tax")))
    return M.unit_metrics(load(spark, sf, "lineitem"), src)


def _agg_sql(dims: str = "", by: str = "") -> str:
    pre = f"{dims}, " if dims else ""
    return f"""WITH u AS (SELECT o_custkey, {pre}sum(o_totalprice) AS revenue, count(o_orderkey) AS n_orders FROM orders WHERE {DATES} GROUP BY o_custkey{", " + dims if dims else ""})
        SELECT {pre}round(sum(revenue), 2) AS revenue_numer, CAST(NULL AS DOUBLE) AS revenue_denom, round(sum(revenue), 2) AS revenue, count(revenue) AS revenue_sample_count,
               round(sum(revenue), 2) AS order_value_numer, CAST(sum(n_orders) AS DOUBLE) AS order_value_denom, round(sum(revenue) / sum(n_orders), 2) AS order_value,
               count(revenue) AS order_value_sample_count, count(*) AS sample_count FROM u {by}"""


@query(_agg_sql())
def agg_metrics_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return R.rounded(M.agg_metrics(load(spark, sf, "orders"), ORDERS, START, END), 2)


def _with_dims(*dims: str) -> MetricSource:
    from dataclasses import replace

    return replace(ORDERS, dims=dims)


@query(_agg_sql("o_orderpriority", "GROUP BY 1"))
def agg_metrics_dims(spark: SparkSession, sf: str) -> DataFrame:
    return R.rounded(M.agg_metrics(load(spark, sf, "orders"), _with_dims("o_orderpriority"), START, END), 2)


@query(f"""WITH w AS ({_agg_sql("o_orderstatus", "GROUP BY 1")})
    SELECT 'orders' AS metric_family, 'revenue' AS metric, revenue_numer AS numer, revenue_denom AS denom, revenue AS value, revenue_sample_count AS sample_count, o_orderstatus FROM w
    UNION ALL SELECT 'orders', 'order_value', order_value_numer, order_value_denom, order_value, order_value_sample_count, o_orderstatus FROM w""")
def agg_metrics_long(spark: SparkSession, sf: str) -> DataFrame:
    src = _with_dims("o_orderstatus")
    return R.rounded(M.to_long(M.agg_metrics(load(spark, sf, "orders"), src, START, END), src), 2)


@query(f"""WITH u AS (SELECT o_custkey, sum(o_totalprice) AS revenue, count(*) AS n FROM orders GROUP BY 1),
    t AS (SELECT *, CASE WHEN o_custkey IN ({IMPACTED}) THEN 'impacted' ELSE 'complement' END AS segment FROM u)
    SELECT segment, round(sum(revenue), 2) AS revenue, round(sum(revenue) / sum(n), 2) AS order_value, count(*) AS sample_count FROM (SELECT * FROM t UNION ALL SELECT o_custkey, revenue, n, 'raw' FROM u) GROUP BY 1""")
def swi_three_segments(spark: SparkSession, sf: str) -> DataFrame:
    out = M.segments(load(spark, sf, "orders"), _impacted(spark, sf), ORDERS, "unit")
    return R.rounded(out.select("segment", "revenue", "order_value", "sample_count"), 2)


@query("""WITH t AS (SELECT p_brand, p_type, l_returnflag, l_quantity FROM lineitem JOIN part ON l_partkey = p_partkey),
    top AS (SELECT p_brand, p_type FROM t GROUP BY 1, 2 ORDER BY sum(l_quantity) DESC, 1, 2 LIMIT 5)
    SELECT CASE WHEN top.p_brand IS NULL THEN 'Other' ELSE t.p_brand END AS p_brand, CASE WHEN top.p_brand IS NULL THEN 'Other' ELSE t.p_type END AS p_type, l_returnflag, sum(l_quantity) AS l_quantity
    FROM t LEFT JOIN top ON t.p_brand = top.p_brand AND t.p_type = top.p_type GROUP BY 1, 2, 3""")
def dim_collapse_topk(spark: SparkSession, sf: str) -> DataFrame:
    df = load(spark, sf, "lineitem").join(load(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select("p_brand", "p_type", "l_returnflag", "l_quantity")
    return M.collapse_dims(df, ["p_brand", "p_type"], ["l_quantity"], "l_quantity", 5, keep=["l_returnflag"])


@query("""WITH c AS (SELECT coalesce(p_type, 'NA') AS p_type, count(*) AS n FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, p_type) AS k FROM c),
    b AS (SELECT CASE WHEN k <= 3 THEN p_type ELSE 'Other' END AS p_type, CAST(sum(n) AS BIGINT) AS count FROM r GROUP BY 1)
    SELECT p_type, count, round(100.0 * count / sum(count) OVER (), 6) AS percent FROM b""")
def categ_distribution_topn(spark: SparkSession, sf: str) -> DataFrame:
    return R.rounded(M.category_distribution(load(spark, sf, "part"), "p_type", top=3))


@query("SELECT n_values, count(*) AS entities FROM (SELECT user_id, count(DISTINCT event_type) AS n_values FROM events GROUP BY 1) GROUP BY 1")
def distinct_per_entity(spark: SparkSession, sf: str) -> DataFrame:
    return M.distinct_per_entity(load(spark, sf, "events"), ["user_id"], "event_type")


@query("SELECT l_returnflag, l_linestatus, count(*) AS count, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM lineitem GROUP BY 1, 2")
def calc_freq(spark: SparkSession, sf: str) -> DataFrame:
    return R.rounded(M.freq(load(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"]))


@query("""SELECT 'l_returnflag' AS "column", count(*) AS rows, count(DISTINCT l_returnflag) AS n_distinct, count(*) - count(l_returnflag) AS n_null, min(l_returnflag) AS least, max(l_returnflag) AS greatest FROM lineitem
    UNION ALL SELECT 'l_linestatus', count(*), count(DISTINCT l_linestatus), count(*) - count(l_linestatus), min(l_linestatus), max(l_linestatus) FROM lineitem""")
def desc_table_counts(spark: SparkSession, sf: str) -> DataFrame:
    return M.describe(load(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"])
