"""Concurrent experiments on customers, with arms from independent digits of the customer key."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import experiments as E
from ..operators import relational as R
from ..specs import ComparisonPair, Experiment, Launch, Metric
from .registry import load, query

C = "c_custkey"
ARMS = {
    1: ("c_custkey % 20 <> 0", "case when c_custkey % 10 < 4 then 'control' when c_custkey % 10 < 7 then 'v1' else 'v2' end"),
    2: ("(c_custkey {div} 10) % 19 <> 0", "case when (c_custkey {div} 10) % 10 < 3 then 'control' else 'enabled' end"),
    3: ("c_custkey % 7 <> 0", "case when (c_custkey {div} 100) % 2 = 0 then 'control' else 'w1' end"),
}
START, END = "1996-01-01", "1998-12-31"


def experiments(spark: SparkSession, sf: str, k: int) -> list[Experiment]:
    c = load(spark, sf, "customer")
    text = lambda s: s.replace("{div}", "div")
    return [Experiment(f"e{i}", c.where(text(ARMS[i][0])).select(F.col(C).alias("unit"), F.expr(text(ARMS[i][1])).alias("variant"))) for i in range(1, k + 1)]


def merged_sql(k: int) -> str:
    text = lambda s: s.replace("{div}", "//")
    parts = [f"e{i} AS (SELECT c_custkey AS unit, {text(ARMS[i][1])} AS v{i} FROM customer WHERE {text(ARMS[i][0])})" for i in range(1, k + 1)]
    joins = "e1 " + " ".join(f"FULL JOIN e{i} USING (unit)" for i in range(2, k + 1))
    columns = ", ".join(f"coalesce(v{i}, 'nan') AS variant_{i}" for i in range(1, k + 1))
    shown = " || '|' || ".join(f"coalesce(v{i}, 'nan')" for i in range(1, k + 1))
    return f"{', '.join(parts)}, merged AS (SELECT unit, {columns}, {shown} AS variant FROM {joins})"


REVENUE = f"rev AS (SELECT o_custkey AS unit, sum(o_totalprice) AS revenue, count(*) AS n_orders FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}' GROUP BY 1)"


def revenue(spark: SparkSession, sf: str) -> DataFrame:
    o = R.in_dates(load(spark, sf, "orders"), "o_orderdate", START, END)
    return o.groupBy(F.col("o_custkey").alias("unit")).agg(F.sum("o_totalprice").alias("revenue"), F.count("*").alias("n_orders"))


def joined(spark: SparkSession, sf: str, k: int) -> DataFrame:
    return E.with_metrics(E.merge_experiments(experiments(spark, sf, k)), revenue(spark, sf))


def text(df: DataFrame, digits: int = 4) -> DataFrame:
    """Arrays as text and doubles rounded, as the SQL gives them."""
    for name, kind in df.dtypes:
        if kind.startswith("array"):
            df = df.withColumn(name, E.shown(F.col(name)))
    return R.rounded(df, digits)


def _merge(k: int):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return text(E.merge_experiments(experiments(spark, sf, k)))

    run.__name__ = f"expt_assignment_merge_{k}way"
    return query(f"WITH {merged_sql(k)} SELECT unit, {', '.join(f'variant_{i}' for i in range(1, k + 1))}, variant FROM merged")(run)


_merge(2), _merge(3)


@query(f"WITH {merged_sql(3)} SELECT variant, count(*) AS variant_count FROM merged GROUP BY 1")
def variant_counts(spark: SparkSession, sf: str) -> DataFrame:
    return text(E.variant_counts(E.merge_experiments(experiments(spark, sf, 3))))


COUNTS = f"""{merged_sql(3)}, c AS (SELECT variant, concat_ws('|', CAST(variant_1 <> 'nan' AS VARCHAR), CAST(variant_2 <> 'nan' AS VARCHAR), CAST(variant_3 <> 'nan' AS VARCHAR)) AS trigger_state,
    variant_1, variant_2, variant_3, count(*) AS variant_count FROM merged GROUP BY ALL),
    ts AS (SELECT *, CAST(sum(variant_count) OVER (PARTITION BY trigger_state) AS BIGINT) AS trigger_state_count FROM c)"""


@query(f"""WITH {COUNTS} SELECT variant, variant_count, round(100.0 * variant_count / sum(variant_count) OVER (), 4) AS variant_percent, trigger_state,
    trigger_state LIKE '%true%' AS trigger_state_overall, trigger_state_count, round(100.0 * trigger_state_count / sum(variant_count) OVER (), 4) AS trigger_state_percent,
    round(100.0 * variant_count / trigger_state_count, 4) AS variant_over_triggered_pcnt FROM ts""")
def trigger_states(spark: SparkSession, sf: str) -> DataFrame:
    return text(E.trigger_stats(E.variant_counts(E.merge_experiments(experiments(spark, sf, 3)))))


@query(f"""WITH {COUNTS}, e AS (SELECT 1 AS experiment, trigger_state, variant_count FROM ts WHERE variant_1 <> 'nan' UNION ALL SELECT 2, trigger_state, variant_count FROM ts WHERE variant_2 <> 'nan'
    UNION ALL SELECT 3, trigger_state, variant_count FROM ts WHERE variant_3 <> 'nan')
    SELECT CAST(experiment AS INTEGER) AS experiment, CAST(sum(variant_count) AS BIGINT) AS triggered,
           round(100.0 * sum(CASE WHEN len(trigger_state) - len(replace(trigger_state, 'true', '')) > 4 THEN variant_count ELSE 0 END) / sum(variant_count), 4) AS overlap_percent FROM e GROUP BY 1""")
def trigger_overlap_rates(spark: SparkSession, sf: str) -> DataFrame:
    return text(E.overlap_rates(E.variant_counts(E.merge_experiments(experiments(spark, sf, 3)))))


STATS = f"""{COUNTS}, {REVENUE}, s AS (SELECT variant, variant_1, variant_2, variant_3, count(*) AS n, coalesce(sum(revenue), 0) AS s1, coalesce(sum(revenue * revenue), 0) AS s2
    FROM merged LEFT JOIN rev USING (unit) GROUP BY ALL)"""


@query(f"""WITH {STATS} SELECT variant, n AS sample_count, round(s1 / n, 4) AS mean, round(s1, 2) AS sum FROM s""")
def mea_variant_stats_3way(spark: SparkSession, sf: str) -> DataFrame:
    out = E.variant_stats(joined(spark, sf, 3), ["revenue"])
    return text(out.select("variant", "sample_count", "mean", F.round("sum", 2).alias("sum")))


@query(f"""WITH {merged_sql(2)}, {REVENUE}, j AS (SELECT * FROM merged LEFT JOIN rev USING (unit)),
    s AS (SELECT variant, 'revenue' AS metric, count(*) AS sample_count, coalesce(sum(revenue), 0) AS s1, coalesce(sum(revenue * revenue), 0) AS s2 FROM j GROUP BY 1
          UNION ALL SELECT variant, 'n_orders', count(*), coalesce(CAST(sum(n_orders) AS DOUBLE), 0), coalesce(CAST(sum(n_orders * n_orders) AS DOUBLE), 0) FROM j GROUP BY 1)
    SELECT variant, metric, sample_count, round(s1 / sample_count, 3) AS mean, round(sqrt(greatest(s2 / sample_count - (s1 / sample_count) * (s1 / sample_count), 0)), 3) AS sd FROM s""")
def mea_variant_stats_sd(spark: SparkSession, sf: str) -> DataFrame:
    out = E.variant_stats(joined(spark, sf, 2), ["revenue", "n_orders"])
    return text(out.select("variant", "metric", "sample_count", "mean", "sd"), 3)


def _launch(k: int) -> ComparisonPair:
    return Launch(("v1", "enabled", "w1")[:k]).against(name="launch")


def _in(side: tuple[tuple[str, ...], ...]) -> str:
    return ", ".join("'" + "|".join(v) + "'" for v in side)


SIDES = f"""sides AS (SELECT *, CASE WHEN variant IN ({_in(_launch(3).treatment)}) THEN 'treatment' WHEN variant IN ({_in(_launch(3).control)}) THEN 'control' END AS side FROM s),
    w AS (SELECT sides.*, s1 / n AS mean, greatest(s2 / n - (s1 / n) * (s1 / n), 0) AS var, trigger_state_count / sum(trigger_state_count) OVER (PARTITION BY side) AS wt
          FROM sides JOIN (SELECT variant, trigger_state_count FROM ts) t USING (variant) WHERE side IS NOT NULL),
    arms AS (SELECT side, CAST(sum(n) AS BIGINT) AS n, sum(wt * mean) AS mean, sum(wt * wt * var / n) AS var FROM w GROUP BY 1)"""


def _arms(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    stats = E.variant_stats(joined(spark, sf, 3), ["revenue"])
    counts = E.trigger_stats(stats.groupBy("variant").agg(F.max("sample_count").alias("variant_count")))
    pairs = E.pair_relation(spark, [_launch(3)])
    return E.arm_stats(stats, pairs, counts), counts, pairs


@query(f"WITH {STATS}, {SIDES} SELECT 'launch' AS pair, side, 'revenue' AS metric, n, round(mean, 3) AS mean, round(var, 1) AS var FROM arms")
def mea_arm_weighted_means(spark: SparkSession, sf: str) -> DataFrame:
    stats = E.with_state_counts(E.variant_stats(joined(spark, sf, 3), ["revenue"]))
    out = E.arm_stats(stats, E.pair_relation(spark, [_launch(3)]))
    return out.select("pair", "side", "metric", "n", F.round("mean", 3).alias("mean"), F.round("var", 1).alias("var"))


@query(f"""WITH {STATS}, {SIDES} SELECT 'launch' AS pair, 'revenue' AS metric, round(t.mean - c.mean, 3) AS delta, round(100 * (t.mean - c.mean) / abs(c.mean), 3) AS percent,
    floor((t.var + c.var) ** 2 / (t.var ** 2 / (t.n - 1) + c.var ** 2 / (c.n - 1))) AS dof, c.n AS control_count, t.n AS treatment_count FROM arms t, arms c WHERE t.side = 'treatment' AND c.side = 'control'""")
def mea_effect_delta(spark: SparkSession, sf: str) -> DataFrame:
    arms, counts, pairs = _arms(spark, sf)
    out = E.effect_frame(spark, E.effects(arms, E.triggered_population(counts, pairs)))
    return out.select("pair", "metric", F.round("delta", 3).alias("delta"), "percent", "dof", "control_count", "treatment_count")


#: Numerical integration of the t density, for p-values in SQL: Simpson's rule with 4000 steps on [0, |t|].
P_VALUE = """1 - 2 * list_sum(list_transform(range(0, 4001), lambda i: (CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * pow(1 + pow(abs(t) * i / 4000.0, 2) / dof, -(dof + 1) / 2))) * abs(t) / 12000.0
    * exp(lgamma((dof + 1) / 2) - lgamma(dof / 2)) / sqrt(dof * pi())"""
#: The 97.5 % quantile of the t law: its expansion in 1 / dof about the normal one.
_Z = NormalDist().inv_cdf(0.975)
_TERMS = (_Z, (_Z**3 + _Z) / 4, (5 * _Z**5 + 16 * _Z**3 + 3 * _Z) / 96, (3 * _Z**7 + 19 * _Z**5 + 17 * _Z**3 - 15 * _Z) / 384, (79 * _Z**9 + 776 * _Z**7 + 1482 * _Z**5 - 1920 * _Z**3 - 945 * _Z) / 92160)
T_QUANTILE = "(" + " + ".join(f"{x!r} / dof ** {i}" for i, x in enumerate(_TERMS)) + ")"

LAUNCHES = [Launch(("v1", "enabled", "w1")), Launch(("v2", "enabled", "w1"))]
_ROWS = ", ".join(f"('{p.name}', '{side}', '{'|'.join(v)}')" for p in (x.against() for x in LAUNCHES) for side in ("treatment", "control") for v in getattr(p, side))


@query(f"""WITH {STATS}, mm AS (SELECT variant, 'revenue' AS metric, n, s1, s2 FROM s UNION ALL SELECT variant, 'n_orders', count(*), coalesce(sum(n_orders), 0), coalesce(sum(n_orders * n_orders), 0) FROM merged LEFT JOIN rev USING (unit) GROUP BY 1),
    l(pair, side, variant) AS (VALUES {_ROWS}), w AS (SELECT pair, side, metric, mm.n, s1 / n AS mean, greatest(s2 / n - (s1 / n) * (s1 / n), 0) AS var, trigger_state_count / sum(trigger_state_count) OVER (PARTITION BY pair, side, metric) AS wt
        FROM mm JOIN l USING (variant) JOIN (SELECT variant, trigger_state_count FROM ts) q USING (variant)),
    arms AS (SELECT pair, side, metric, CAST(sum(n) AS BIGINT) AS n, sum(wt * mean) AS mean, sum(wt * wt * var / n) AS var FROM w GROUP BY ALL),
    pop AS (SELECT pair, side, sum(trigger_state_count) AS k FROM (SELECT DISTINCT pair, side, trigger_state, trigger_state_count FROM l JOIN ts USING (variant)) GROUP BY ALL),
    e AS (SELECT t.pair, t.metric, t.mean - c.mean AS delta, sqrt(t.var + c.var) AS se, c.mean AS base, floor((t.var + c.var) ** 2 / (t.var ** 2 / (t.n - 1) + c.var ** 2 / (c.n - 1))) AS dof, (tp.k + cp.k) / 2.0 AS k, c.n AS cn, t.n AS tn
        FROM arms t JOIN arms c ON c.pair = t.pair AND c.metric = t.metric AND t.side = 'treatment' AND c.side = 'control' JOIN pop tp ON tp.pair = t.pair AND tp.side = 'treatment' JOIN pop cp ON cp.pair = t.pair AND cp.side = 'control'),
    f AS (SELECT *, delta / se AS t FROM e)
    SELECT pair, metric, round(delta, 3) AS delta, round(delta - {T_QUANTILE} * se, 3) AS ci_lower, round(delta + {T_QUANTILE} * se, 3) AS ci_upper, round({P_VALUE}, 6) AS p_value, round(100 * delta / base, 3) AS percent, dof,
        round(k * delta, 1) AS delta_sum, cn AS control_count, tn AS treatment_count FROM f""")
def mea_run(spark: SparkSession, sf: str) -> DataFrame:
    out = E.run_mea(experiments(spark, sf, 3), revenue(spark, sf), ["revenue", "n_orders"], LAUNCHES)
    digits = {"delta": 3, "ci_lower": 3, "ci_upper": 3, "p_value": 6, "delta_sum": 1}
    return out.withColumns({c: F.round(c, k) for c, k in digits.items()})


B = 20
BUCKETS = f"""b AS (SELECT *, (row_number() OVER (ORDER BY unit) - 1) // CAST(ceil(count(*) OVER () / {B}.0) AS BIGINT) AS jk FROM j)"""


@query(f"""WITH {merged_sql(2)}, {REVENUE}, j AS (SELECT unit, coalesce(revenue, 0) AS x, coalesce(n_orders, 0) AS y FROM merged LEFT JOIN rev USING (unit)), {BUCKETS},
    t AS (SELECT sum(x) AS sx, sum(y) AS sy FROM b), k AS (SELECT range AS jk FROM range({B})), p AS (SELECT jk, sum(x) AS sx, sum(y) AS sy FROM b GROUP BY 1),
    r AS (SELECT (t.sx - coalesce(p.sx, 0)) / (t.sy - coalesce(p.sy, 0)) AS rep FROM k LEFT JOIN p USING (jk) CROSS JOIN t)
    SELECT round(t.sx / t.sy, 3) AS estimate, round(t.sx / t.sy - ({B} - 1) * (avg(rep) - t.sx / t.sy), 3) AS jk_estimate, round(({B} - 1) * var_pop(rep), 3) AS jk_var FROM r, t GROUP BY t.sx, t.sy""")
def jackknife_ratio_estimate(spark: SparkSession, sf: str) -> DataFrame:
    df = E.bucketed(joined(spark, sf, 2).select("unit", "revenue", "n_orders"), ["unit"], B)
    sums, estimate = E.ratio_sums(Metric("revenue", "SUM", "n_orders", "SUM"))
    return R.rounded(E.jackknife(df, B, sums, estimate), 3)


@query(f"""WITH {REVENUE} SELECT c_mktsegment, count(*) AS n, round(avg(revenue) / avg(n_orders), 4) AS ratio,
    round((var_samp(revenue) - 2 * (avg(revenue) / avg(n_orders)) * covar_samp(revenue, n_orders) + (avg(revenue) / avg(n_orders)) ** 2 * var_samp(n_orders)) / (count(*) * avg(n_orders) ** 2), 1) AS var
    FROM rev JOIN customer ON unit = c_custkey GROUP BY 1""")
def ratio_delta_method(spark: SparkSession, sf: str) -> DataFrame:
    df = revenue(spark, sf).join(load(spark, sf, "customer"), F.col("unit") == F.col(C))
    out = E.ratio_delta_method(df, "revenue", "n_orders", ["c_mktsegment"])
    return out.select("c_mktsegment", "n", F.round("ratio", 4).alias("ratio"), F.round("var", 1).alias("var"))


SWI = f"""{REVENUE}, a AS (SELECT CASE WHEN c_custkey % 20 <> 0 AND c_nationkey < 10 THEN CASE WHEN c_custkey % 10 < 4 THEN 'control' ELSE 'treatment' END ELSE 'complement' END AS arm,
    coalesce(revenue, 0) AS x, coalesce(n_orders, 0) AS y FROM customer LEFT JOIN rev ON unit = c_custkey),
    m AS (SELECT avg(CASE WHEN arm = 'control' THEN x END) AS cx, avg(CASE WHEN arm = 'treatment' THEN x END) AS tx, avg(CASE WHEN arm = 'control' THEN y END) AS cy, avg(CASE WHEN arm = 'treatment' THEN y END) AS ty,
          count(CASE WHEN arm <> 'complement' THEN 1 END) AS n, sum(CASE WHEN arm = 'complement' THEN x ELSE 0 END) AS ox, sum(CASE WHEN arm = 'complement' THEN y ELSE 0 END) AS oy FROM a)"""


def _swi(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf, "customer").join(revenue(spark, sf), F.col("unit") == F.col(C), "left").fillna({"revenue": 0, "n_orders": 0})
    arm = F.expr("case when c_custkey % 20 <> 0 and c_nationkey < 10 then case when c_custkey % 10 < 4 then 'control' else 'treatment' end else 'complement' end")
    mean = lambda col, a: F.avg(F.when(F.col("arm") == a, F.col(col)))
    rest = lambda col: F.sum(F.when(F.col("arm") == "complement", F.col(col)).otherwise(0))
    return c.withColumn("arm", arm).agg(
        mean("revenue", "control").alias("control_mean"), (mean("revenue", "treatment") - mean("revenue", "control")).alias("delta"), F.count_if(F.col("arm") != "complement").alias("impacted_count"), rest("revenue").alias("complement_total"),
        mean("revenue", "control").alias("control_numer"), mean("n_orders", "control").alias("control_denom"), (mean("revenue", "treatment") - mean("revenue", "control")).alias("delta_numer"),
        (mean("n_orders", "treatment") - mean("n_orders", "control")).alias("delta_denom"), rest("revenue").alias("complement_numer"), rest("n_orders").alias("complement_denom"),
    )


@query(f"WITH {SWI} SELECT n AS impacted_count, round((tx - cx) * n, 2) AS swi_delta, round(100 * (tx - cx) * n / (cx * n + ox), 6) AS swi_percent FROM m")
def swi_simple(spark: SparkSession, sf: str) -> DataFrame:
    return E.swi_simple(_swi(spark, sf)).select("impacted_count", F.round("swi_delta", 2).alias("swi_delta"), F.round("swi_percent", 6).alias("swi_percent"))


@query(f"""WITH {SWI}, r AS (SELECT (cx * n + ox) / (cy * n + oy) AS before, (tx * n + ox) / (ty * n + oy) AS after FROM m)
    SELECT round(before, 4) AS swi_before, round(after, 4) AS swi_after, round(100 * (after - before) / before, 6) AS swi_percent FROM r""")
def swi_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return E.swi_ratio(_swi(spark, sf)).select(F.round("swi_before", 4).alias("swi_before"), F.round("swi_after", 4).alias("swi_after"), F.round("swi_percent", 6).alias("swi_percent"))


@query(f"""WITH {merged_sql(2)}, a AS (SELECT variant_1, variant_2, count(*) AS observed FROM merged GROUP BY 1, 2),
    g AS (SELECT x.variant_1, y.variant_2, coalesce(observed, 0) AS observed FROM (SELECT DISTINCT variant_1 FROM a) x CROSS JOIN (SELECT DISTINCT variant_2 FROM a) y LEFT JOIN a ON a.variant_1 = x.variant_1 AND a.variant_2 = y.variant_2),
    e AS (SELECT *, sum(observed) OVER (PARTITION BY variant_1) * sum(observed) OVER (PARTITION BY variant_2) / sum(observed) OVER () AS expected FROM g)
    SELECT variant_1, variant_2, observed, round(expected, 6) AS expected, round((observed - expected) ** 2 / expected, 6) AS chi2 FROM e""")
def chi2_independence(spark: SparkSession, sf: str) -> DataFrame:
    merged = E.merge_experiments(experiments(spark, sf, 2)).withColumn("variant_count", F.lit(1))
    return R.rounded(E.contingency(merged, ["variant_1", "variant_2"]))


@query(f"""WITH {merged_sql(2)}, {REVENUE} SELECT concat_ws('|', CAST(variant_1 <> 'nan' AS VARCHAR), CAST(variant_2 <> 'nan' AS VARCHAR)) AS trigger_state, variant_1, variant_2, count(*) AS n,
    round(avg(coalesce(revenue, 0)), 3) AS mean, round(stddev_samp(coalesce(revenue, 0)), 3) AS sd FROM merged LEFT JOIN rev USING (unit) GROUP BY ALL""")
def interaction_cells(spark: SparkSession, sf: str) -> DataFrame:
    df = joined(spark, sf, 2).withColumn("trigger_state", E.shown(E.trigger_state(F.col("variant"))))
    x = F.coalesce("revenue", F.lit(0.0))
    return R.rounded(df.groupBy("trigger_state", "variant_1", "variant_2").agg(F.count("*").alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd")), 3)


@query(f"""WITH {merged_sql(3)}, p AS (SELECT 1 AS source, 2 AS target, variant_1 AS r, variant_2 AS c FROM merged UNION ALL SELECT 1, 3, variant_1, variant_3 FROM merged UNION ALL SELECT 2, 1, variant_2, variant_1 FROM merged
    UNION ALL SELECT 2, 3, variant_2, variant_3 FROM merged UNION ALL SELECT 3, 1, variant_3, variant_1 FROM merged UNION ALL SELECT 3, 2, variant_3, variant_2 FROM merged),
    o AS (SELECT source, target, r, c, count(*) AS n FROM p WHERE r <> 'nan' GROUP BY ALL),
    g AS (SELECT a.source, a.target, a.r, b.c, coalesce(o.n, 0) AS n FROM (SELECT DISTINCT source, target, r FROM o) a JOIN (SELECT DISTINCT source, target, c FROM o) b ON a.source = b.source AND a.target = b.target
          LEFT JOIN o ON o.source = a.source AND o.target = a.target AND o.r = a.r AND o.c = b.c),
    e AS (SELECT *, sum(n) OVER (PARTITION BY source, target, r) * sum(n) OVER (PARTITION BY source, target, c) / sum(n) OVER (PARTITION BY source, target) AS x FROM g)
    SELECT source, target, round(sum((n - x) ** 2 / x), 6) AS statistic, CAST((count(DISTINCT r) - 1) * (count(DISTINCT c) - 1) AS BIGINT) AS dof,
           round(sqrt(sum((n - x) ** 2 / x) / (sum(n) * (least(count(DISTINCT r), count(DISTINCT c)) - 1))), 6) AS cramers_v FROM e GROUP BY 1, 2""")
def trigger_invariance_pairs(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.assumptions import trigger_invariance

    _, pairs, _ = trigger_invariance(E.variant_counts(E.merge_experiments(experiments(spark, sf, 3))))
    rows = [(t.source, t.target, t.statistic, t.dof, t.cramers_v) for t in pairs]
    return R.rounded(spark.createDataFrame(rows, "source int, target int, statistic double, dof long, cramers_v double"))


@query(f"""WITH {merged_sql(2)}, {REVENUE}, c AS (SELECT variant_1, variant_2, count(*) AS n, avg(coalesce(revenue, 0)) AS m, var_pop(coalesce(revenue, 0)) * count(*) AS ss FROM merged LEFT JOIN rev USING (unit) WHERE variant_1 <> 'nan' AND variant_2 <> 'nan' GROUP BY 1, 2),
    d AS (SELECT a.m - b.m AS d, a.n * b.n / (a.n + b.n) AS w FROM c a JOIN c b ON a.variant_1 = b.variant_1 AND a.variant_2 = 'control' AND b.variant_2 = 'enabled'),
    i AS (SELECT sum(w * d * d) - sum(w * d) ** 2 / sum(w) AS between_ss, count(*) - 1 AS d1 FROM d), r AS (SELECT sum(ss) AS within_ss, sum(n) - count(*) AS d2 FROM c)
    SELECT 'true|true' AS trigger_state, round(between_ss / d1 / (within_ss / d2), 6) AS f, round(pow(1 + d1 * (between_ss / d1 / (within_ss / d2)) / d2, -d2 / 2.0), 6) AS p_value, CAST(d1 AS BIGINT) AS dof_1, CAST(d2 AS BIGINT) AS dof_2, pow(1 + d1 * (between_ss / d1 / (within_ss / d2)) / d2, -d2 / 2.0) >= 0.001 AS passed FROM i, r""")
def metric_interaction(spark: SparkSession, sf: str) -> DataFrame:
    """With two arms in one experiment and three in the other the F-test's p-value has a closed form."""
    from ..operators.assumptions import metric_interaction as test

    found = test(E.variant_stats(joined(spark, sf, 2), ["revenue"]))
    rows = [("|".join(str(x).lower() for x in t.trigger_state), round(t.f, 6), round(t.p_value, 6), t.dof[0], t.dof[1], t.passed) for t in found]
    return spark.createDataFrame(rows, "trigger_state string, f double, p_value double, dof_1 long, dof_2 long, passed boolean")


@query(f"""WITH {merged_sql(2)}, {REVENUE}, j AS (SELECT unit, variant, coalesce(revenue, 0) AS x, coalesce(n_orders, 0) AS y FROM merged LEFT JOIN rev USING (unit)), {BUCKETS},
    s AS (SELECT CASE WHEN variant IN ({_in(_launch(2).treatment)}) THEN 't' WHEN variant IN ({_in(_launch(2).control)}) THEN 'c' END AS side, variant, jk, x, y FROM b),
    v AS (SELECT side, variant, sum(x) AS x, sum(y) AS y, count(*) AS n FROM s WHERE side IS NOT NULL GROUP BY 1, 2), p AS (SELECT side, variant, jk, sum(x) AS x, sum(y) AS y, count(*) AS n FROM s WHERE side IS NOT NULL GROUP BY 1, 2, 3),
    k AS (SELECT range AS jk FROM range({B})),
    l AS (SELECT k.jk, v.side, v.n AS w, (v.x - coalesce(p.x, 0)) / (v.n - coalesce(p.n, 0)) AS mx, (v.y - coalesce(p.y, 0)) / (v.n - coalesce(p.n, 0)) AS my FROM k CROSS JOIN v LEFT JOIN p ON p.jk = k.jk AND p.variant = v.variant),
    r AS (SELECT jk, sum(CASE WHEN side = 't' THEN w * mx END) / sum(CASE WHEN side = 't' THEN w * my END) - sum(CASE WHEN side = 'c' THEN w * mx END) / sum(CASE WHEN side = 'c' THEN w * my END) AS rep FROM l GROUP BY 1),
    f AS (SELECT sum(CASE WHEN side = 't' THEN x END) / sum(CASE WHEN side = 't' THEN y END) - sum(CASE WHEN side = 'c' THEN x END) / sum(CASE WHEN side = 'c' THEN y END) AS full_delta FROM v)
    SELECT 'launch' AS pair, round(full_delta - ({B} - 1) * (avg(rep) - full_delta), 2) AS delta, round(sqrt(({B} - 1) * var_pop(rep)), 2) AS se FROM r, f GROUP BY full_delta""")
def jackknife_pair_effect(spark: SparkSession, sf: str) -> DataFrame:
    df = E.bucketed(joined(spark, sf, 2).select("unit", "variant", "revenue", "n_orders"), ["unit"], B)
    return R.rounded(E.pair_effects(df, Metric("revenue", denominator="n_orders"), [_launch(2)], B).select("pair", "delta", "se"), 2)
