"""Estimators with joint covariance, regressions from sums of products, and what is built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import changepoints, formula, gram
from ..operators import estimators as A
from ..operators import experiments as X
from ..operators import relational as R
from .experiments import REVENUE, experiments, merged_sql, revenue
from .linear import solved
from .registry import load, query

B = 20
ARMS = ("control", "enabled")
SUMS = ", ".join(f"sum(CASE WHEN variant_2 = '{v}' THEN {k} ELSE 0 END) AS {v[0]}{k}" for v in ARMS for k in "xy")
_NAMES = [f"{v[0]}{k}" for v in ARMS for k in "xy"]
#: Sums of each group (by) and bucket, whole and left without it.
LEFT = f"""{merged_sql(2)}, {REVENUE}, j AS (SELECT unit, variant_1, variant_2, coalesce(revenue, 0) / 1e6 AS x, CAST(coalesce(n_orders, 0) AS DOUBLE) AS y FROM merged LEFT JOIN rev USING (unit)),
    q AS (SELECT *, CAST((row_number() OVER (ORDER BY unit) - 1) // CAST(ceil(count(*) OVER () / {B}.0) AS BIGINT) AS INTEGER) AS b FROM j),
    s AS (SELECT variant_1 AS g, b, {SUMS}, count(*) AS n FROM q GROUP BY 1, 2), t AS (SELECT g, {", ".join(f"sum({k}) AS {k}" for k in [*_NAMES, "n"])} FROM s GROUP BY 1),
    l AS (SELECT t.g, r.b, {", ".join(f"t.{k} - coalesce(s.{k}, 0) AS {k}" for k in [*_NAMES, "n"])} FROM t CROSS JOIN range({B}) r(b) LEFT JOIN s ON s.g = t.g AND s.b = r.b)"""
RATIOS = "ex / nullif(ey, 0) - cx / nullif(cy, 0) AS d, (ex / nullif(ey, 0)) * (cx / nullif(cy, 0)) AS p"


def _replicated(spark: SparkSession, sf: str) -> DataFrame:
    merged = X.merge_experiments(experiments(spark, sf, 2))
    m = X.bucketed(merged.join(revenue(spark, sf), "unit", "left"), ["unit"], B)
    x, y, arm = F.col("revenue") / 1e6, F.col("n_orders"), F.col("variant_2")
    return A.replicated(m, {**A.strata_sums(x, arm, ARMS, "x"), **A.strata_sums(y, arm, ARMS, "y"), "n": F.count("*")}, B, ["variant_1"])


def _ratios() -> A.Estimator:
    of = A.Estimator.of
    treated, control = of("x_enabled") / of("y_enabled"), of("x_control") / of("y_control")
    return A.stacked(treated - control, treated * control)


@query(f"""WITH {LEFT}, v AS (SELECT g, {RATIOS} FROM t), e AS (SELECT g, b, {RATIOS} FROM l), m AS (SELECT g, avg(d) AS md, avg(p) AS mp, var_pop(d) AS vd, var_pop(p) AS vp FROM e GROUP BY 1)
    SELECT g AS variant_1, 'difference' AS component, round(d, 9) AS value, round(d - {B - 1} * (md - d), 9) AS jk_value, round(sqrt({B - 1} * vd), 9) AS se FROM v JOIN m USING (g)
    UNION ALL SELECT g, 'product', round(p, 9), round(p - {B - 1} * (mp - p), 9), round(sqrt({B - 1} * vp), 9) FROM v JOIN m USING (g)""")
def estimator_algebra(spark: SparkSession, sf: str) -> DataFrame:
    """Revenue an order of treated less that of control, and their product, within the arms of another experiment."""
    out = A.summary(_replicated(spark, sf), _ratios(), B, ["variant_1"], ["difference", "product"])
    return R.rounded(out.select("variant_1", "component", "value", "jk_value", "se"), 9)


@query(f"""WITH {LEFT}, e AS (SELECT g, b, {RATIOS} FROM l), m AS (SELECT g, {B - 1} * var_pop(d) AS dd, {B - 1} * var_pop(p) AS pp, {B - 1} * covar_pop(d, p) AS dp FROM e GROUP BY 1)
    SELECT g AS variant_1, a, b, round(1e6 * c, 9) AS covariance FROM (SELECT g, 'difference' AS a, 'difference' AS b, dd AS c FROM m UNION ALL SELECT g, 'product', 'product', pp FROM m
        UNION ALL SELECT g, 'difference', 'product', dp FROM m UNION ALL SELECT g, 'product', 'difference', dp FROM m)""")
def estimator_covariance(spark: SparkSession, sf: str) -> DataFrame:
    """The joint covariance of both."""
    out = A.covariance(_replicated(spark, sf), _ratios(), ["variant_1"], ["difference", "product"])
    return R.rounded(out.withColumn("covariance", 1e6 * F.col("covariance")), 9)


@query(f"""WITH {LEFT}, v AS (SELECT g, 0.25 * cx / n + 0.75 * ex / n AS m, 2 * cx / n + 3 * ey / n AS i FROM t), e AS (SELECT g, b, 0.25 * cx / n + 0.75 * ex / n AS m, 2 * cx / n + 3 * ey / n AS i FROM l),
    z AS (SELECT g, avg(m) AS mm, avg(i) AS mi, var_pop(m) AS vm, var_pop(i) AS vi FROM e GROUP BY 1)
    SELECT g AS variant_1, 'weighted' AS component, round(m - {B - 1} * (mm - m), 9) AS jk_value, round(sqrt({B - 1} * vm), 9) AS se FROM v JOIN z USING (g)
    UNION ALL SELECT g, 'inner', round(i - {B - 1} * (mi - i), 9), round(sqrt({B - 1} * vi), 9) FROM v JOIN z USING (g)""")
def estimator_weighted(spark: SparkSession, sf: str) -> DataFrame:
    """Means of two strata weighted 1 to 3 (a third one isn't there), and an inner product with given numbers."""
    of = A.Estimator.of
    mean = A.weighted({"control": of("x_control") / of("n"), "enabled": of("x_enabled") / of("n"), "none": of("x_control")}, {"control": 500.0, "enabled": 1500.0})
    inner = A.stacked(of("x_control"), of("y_enabled")) / of("n") @ [2.0, 3.0]
    out = A.summary(_replicated(spark, sf), A.stacked(mean, inner), B, ["variant_1"], ["weighted", "inner"])
    return R.rounded(out.select("variant_1", "component", "jk_value", "se"), 9)


# linear models

_PRICES = "p AS (SELECT l_returnflag AS g, l_extendedprice / 1000 AS y, l_quantity AS q, CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE 0.0 END AS o, l_discount * 100 AS d FROM lineitem)"


def _prices(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "lineitem").select(F.col("l_returnflag").alias("g"), (F.col("l_extendedprice") / 1000).alias("y"), F.col("l_quantity").cast("double").alias("q"), F.col("l_linestatus").alias("s"), (F.col("l_discount") * 100).alias("d"))


@query(f"""WITH {_PRICES}, x AS (SELECT 1 AS g, y, 1.0 AS x0, q AS x1, o AS x2, q * o AS x3, ln(q) AS x4 FROM p), {solved("x", 5, [0] * 5)}
    SELECT name, round(CASE name WHEN 'Intercept' THEN b0 WHEN 'log(q)' THEN b4 WHEN 'q' THEN b1 WHEN 's[O]' THEN b2 ELSE b3 END, 5) AS coefficient FROM beta, (VALUES ('Intercept'), ('log(q)'), ('q'), ('s[O]'), ('q:s[O]')) v(name)""")
def formula_regression(spark: SparkSession, sf: str) -> DataFrame:
    """Prices of lines by quantity, status, their product and the quantity's logarithm, as a formula."""
    df = _prices(spark, sf)
    columns, y = formula.design(df, "y ~ log(q) + q * s")
    return R.rounded(gram.coefficients(gram.ridge_models(df, columns, y, alpha=0.0), list(columns)).select("name", "coefficient"), 5)


@query(f"""WITH {_PRICES}, x AS (SELECT g, y, 1.0 AS x0, q AS x1, d AS x2 FROM p), {solved("x", 3, [0, 0, 0])}, e AS (SELECT x.g, count(*) AS n, sum((y - b0 - b1 * x1 - b2 * x2) ** 2) / (count(*) - 3) AS noise, avg(x1) AS m1, avg(x2) AS m2 FROM x JOIN beta USING (g) GROUP BY 1),
    c AS (SELECT x.g, sum((x1 - m1) ** 2) AS s11, sum((x2 - m2) ** 2) AS s22, sum((x1 - m1) * (x2 - m2)) AS s12 FROM x JOIN e USING (g) GROUP BY 1)
    SELECT g, 'q' AS name, round(b1, 6) AS coefficient, round(sqrt(noise * s22 / (s11 * s22 - s12 * s12)), 8) AS se, round(b1 / sqrt(noise * s22 / (s11 * s22 - s12 * s12)), 3) AS t FROM beta JOIN e USING (g) JOIN c USING (g)
    UNION ALL SELECT g, 'd', round(b2, 6), round(sqrt(noise * s11 / (s11 * s22 - s12 * s12)), 8), round(b2 / sqrt(noise * s11 / (s11 * s22 - s12 * s12)), 3) FROM beta JOIN e USING (g) JOIN c USING (g)""")
def regression_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Coefficients with standard errors and t, for each return flag; all of a flag's lines stay where they are."""
    columns = {"one": F.lit(1.0), "q": F.col("q"), "d": F.col("d")}
    out = gram.coefficients(gram.ridge_models(_prices(spark, sf), columns, F.col("y"), ["g"], alpha=0.0), list(columns), ["g"]).where("name <> 'one'")
    return out.select("g", "name", F.round("coefficient", 6).alias("coefficient"), F.round("se", 8).alias("se"), F.round("t", 3).alias("t"))


@query(f"""WITH {_PRICES}, m AS (SELECT g, count(*) AS n, avg(q) AS mq, avg(y) AS my FROM p GROUP BY 1), s AS (SELECT p.g, sum((q - mq) ** 2) AS qq, sum((q - mq) * (y - my)) AS qy FROM p JOIN m USING (g) GROUP BY 1),
    b AS (SELECT g, sign(qy) * greatest(0, abs(qy) - 0.25 * n) / qq AS b FROM s JOIN m USING (g))
    SELECT g, CAST(n AS DOUBLE) AS n, round(my - b * mq, 5) AS intercept, round(b, 6) AS slope FROM b JOIN m USING (g)""")
def lasso_one_column(spark: SparkSession, sf: str) -> DataFrame:
    """An absolute penalty of half a unit a line on one slope, none on the intercept."""
    df = _prices(spark, sf)
    found = []
    for flag in ("A", "N", "R"):
        own = df.where(F.col("g") == flag)
        n = own.count()
        found.append(gram.partial_models(own, {"one": F.lit(1.0), "q": F.col("q")}, F.col("y"), ["q"], [], ["g"], l1_alpha=0.5 * n, l2_alphas=(0.0,)))
    out = R.union(found)
    return out.select("g", "n", F.round(F.col("coefficients")[0], 5).alias("intercept"), F.round(F.col("coefficients")[1], 6).alias("slope"))


@query(f"""WITH {_PRICES}, x AS (SELECT g, y, 1.0 AS x0, q AS x1, d AS x2, o AS x3 FROM p), {solved("x", 4, [0, 0, 50.0, 50.0])} SELECT g, round(b0, 5) AS b0, round(b1, 6) AS b1, round(b2, 6) AS b2, round(b3, 6) AS b3 FROM beta""")
def partly_squared_penalty(spark: SparkSession, sf: str) -> DataFrame:
    """A squared penalty on two columns, none on the others, by coordinate descent."""
    columns = {"one": F.lit(1.0), "q": F.col("q"), "d": F.col("d"), "o": F.when(F.col("s") == "O", 1.0).otherwise(0.0)}
    out = gram.partial_models(_prices(spark, sf), columns, F.col("y"), [], ["d", "o"], ["g"], l1_alpha=0.0, l2_alphas=(50.0,))
    return out.select("g", F.round(F.col("coefficients")[0], 5).alias("b0"), *[F.round(F.col("coefficients")[k], 6).alias(f"b{k}") for k in (1, 2, 3)])


@query("""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, o_orderpriority AS k FROM orders), s AS (SELECT k, date_diff('day', lag(day) OVER (PARTITION BY k ORDER BY day), day) AS step, day FROM d),
    a AS (SELECT k, count(*) AS n, min(step) AS step, date_diff('day', min(day), max(day)) AS span FROM s GROUP BY 1)
    SELECT k, n, CAST(step AS DOUBLE) AS step_days, CAST(CASE WHEN step >= 7 THEN NULL WHEN n * step >= 700 THEN 7 WHEN n * step >= 300 THEN 3 ELSE 1 END AS INTEGER) AS resample_days,
        CAST(least(greatest(CASE WHEN step >= 7 THEN n ELSE span // CASE WHEN n * step >= 700 THEN 7 WHEN n * step >= 300 THEN 3 ELSE 1 END END - 17, 0), 100) AS INTEGER) AS potential,
        CAST(CASE WHEN step = 1 THEN 40 WHEN step = 7 THEN 280 ELSE 40 * step END AS INTEGER) AS end_days, CAST(CASE WHEN step <= 7 THEN greatest(2 * step, 30) ELSE 2 * step END AS INTEGER) AS distance_days FROM a""")
def changepoint_parameters(spark: SparkSession, sf: str) -> DataFrame:
    """How the days with orders of each priority should be searched for changepoints."""
    days = load(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("day"), F.col("o_orderpriority").alias("k")).distinct()
    return changepoints.parameters(days, "day", ["k"], 10)


@query()
def trend_changepoints(spark: SparkSession, sf: str) -> DataFrame:
    """Where the value of orders a day bends, by priority."""
    o = load(spark, sf, "orders").groupBy(F.date_trunc("day", "o_orderdate").alias("ts"), "o_orderpriority").agg(F.sum("o_totalprice").alias("v"))
    return changepoints.trend_changepoints(o, "ts", "v", ["o_orderpriority"], yearly_order=2)


@query()
def season_changepoints(spark: SparkSession, sf: str) -> DataFrame:
    """Where the yearly wave of the value of orders changes in amplitude."""
    o = load(spark, sf, "orders").groupBy(F.date_trunc("day", "o_orderdate").alias("ts")).agg(F.sum("o_totalprice").alias("v"))
    return changepoints.season_changepoints(o, "ts", "v", 365.25, 1, resample_days=7)
