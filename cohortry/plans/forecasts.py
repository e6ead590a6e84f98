"""Forecasts of daily series, their evaluation and algebra."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import forecast as FC
from ..operators import regression as G
from ..operators import relational as R
from ..streaming import windows as SW
from .linear import solved
from .registry import load, query
from .series import DAILY, daily

Z95, Z80 = FC.z_of(0.95), FC.z_of(0.80)
_I = "i AS (SELECT event_type, ts, v, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS k FROM daily)"


def _seasonal(horizon: int) -> str:
    return f"""n AS (SELECT event_type, max(k) AS n, max(ts) AS last FROM i GROUP BY 1),
    t AS (SELECT event_type, ts, 'fitted' AS stage, v, k FROM i UNION ALL SELECT event_type, last + to_days(CAST(h AS INTEGER)), 'forecast', NULL, n + h FROM n, range(1, {horizon + 1}) r(h)),
    c AS (SELECT t.event_type, t.ts, t.stage, t.v, t.k, p.v AS pv, row_number() OVER (PARTITION BY t.event_type, t.k ORDER BY p.k DESC) AS r FROM t LEFT JOIN i p ON p.event_type = t.event_type AND p.k < t.k AND (t.k - p.k) % 7 = 0),
    f AS (SELECT event_type, ts, stage, any_value(v) AS actual, avg(CASE WHEN r <= 3 THEN pv END) AS forecast, stddev_pop(CASE WHEN r <= 3 THEN pv END) AS std FROM c GROUP BY 1, 2, 3)"""


@query(f"""WITH {DAILY}, {_I}, {_seasonal(10)} SELECT event_type, ts, stage, round(actual, 4) AS actual, round(forecast, 4) AS forecast, round(forecast - {Z95} * std, 4) AS forecast_lower, round(forecast + {Z95} * std, 4) AS forecast_upper, round(std, 4) AS std FROM f""")
def forecast_seasonal_mean(spark: SparkSession, sf: str) -> DataFrame:
    return R.rounded(FC.seasonal_mean(daily(spark, sf), "ts", "v", 7, 3, 10, "D", dims=["event_type"]), 4)


@query(f"""WITH {DAILY}, x AS (SELECT *, isodow(ts) AS dow FROM daily), tr AS (SELECT * FROM x WHERE day(ts) <= 20 AND dow <> 7), te AS (SELECT * FROM x WHERE day(ts) > 20),
    l AS (SELECT event_type, dow, median(v) AS m FROM tr GROUP BY 1, 2), a AS (SELECT event_type, median(v) AS m FROM tr GROUP BY 1)
    SELECT event_type, ts, round(coalesce(l.m, a.m), 4) AS forecast FROM te LEFT JOIN l USING (event_type, dow) LEFT JOIN a USING (event_type)""")
def forecast_similarity(spark: SparkSession, sf: str) -> DataFrame:
    df = daily(spark, sf).withColumn("dow", F.weekday("ts") + 1)
    out = FC.similarity(df.where("dayofmonth(ts) <= 20 and dow <> 7"), df.where("dayofmonth(ts) > 20"), "v", ["dow"], "median", ["event_type"])
    return R.rounded(out.select("event_type", "ts", "forecast"), 4)


@query(f"WITH {DAILY} SELECT event_type, round(quantile_cont(v, 0.9), 4) AS forecast FROM daily GROUP BY 1")
def forecast_null_model(spark: SparkSession, sf: str) -> DataFrame:
    return R.rounded(FC.null_model(daily(spark, sf), "v", "quantile", quantile=0.9, dims=["event_type"]), 4)


CUTS = FC.cutoffs(30, 15, 5, 5)


def _backfilled(spark: SparkSession, sf: str) -> DataFrame:
    make = lambda df, dims: FC.seasonal_mean(df, "ts", "v", 7, 2, 5, "D", dims=dims)
    return FC.backfill(daily(spark, sf), "ts", "v", CUTS, 5, make, dims=["event_type"])


BACK = f"""cuts AS (SELECT unnest([{", ".join(map(str, CUTS))}]) AS cutoff),
    g AS (SELECT event_type, cutoff, h, cutoff + h AS k FROM (SELECT DISTINCT event_type FROM i) CROSS JOIN cuts CROSS JOIN range(1, 6) r(h)),
    b AS (SELECT g.event_type, cutoff, h, g.k, p.v AS pv, row_number() OVER (PARTITION BY g.event_type, cutoff, h ORDER BY p.k DESC) AS r FROM g JOIN i p ON p.event_type = g.event_type AND p.k <= cutoff AND (g.k - p.k) % 7 = 0),
    bf AS (SELECT b.event_type, cutoff, CAST(h AS INTEGER) AS horizon_step, b.k, avg(CASE WHEN r <= 2 THEN pv END) AS forecast, stddev_pop(CASE WHEN r <= 2 THEN pv END) AS std FROM b GROUP BY 1, 2, 3, 4),
    e AS (SELECT bf.event_type, cutoff, horizon_step, forecast, std, i.v AS actual FROM bf LEFT JOIN i ON i.event_type = bf.event_type AND i.k = bf.k)"""


@query(f"WITH {DAILY}, {_I}, {BACK} SELECT event_type, CAST(cutoff AS INTEGER) AS cutoff, horizon_step, round(forecast, 4) AS forecast, round(std, 4) AS std, round(actual, 4) AS actual FROM e")
def backfill_seasonal_mean(spark: SparkSession, sf: str) -> DataFrame:
    return R.rounded(_backfilled(spark, sf).select("event_type", "cutoff", "horizon_step", "forecast", "std", "actual"), 4)


@query(f"""WITH {DAILY}, {_I}, {BACK} SELECT event_type, horizon_step, count(*) AS n, round(avg(abs(actual - forecast)), 4) AS mae, round(sqrt(avg((actual - forecast) ** 2)), 4) AS rmse,
    round(100 * avg(CASE WHEN actual <> 0 THEN abs((actual - forecast) / actual) END), 4) AS mape, round(avg(CASE WHEN actual BETWEEN forecast - {Z95} * std AND forecast + {Z95} * std THEN 1.0 ELSE 0.0 END), 4) AS coverage, round(avg(actual - forecast), 4) AS bias
    FROM e WHERE actual IS NOT NULL GROUP BY 1, 2""")
def eval_by_metric_horizon(spark: SparkSession, sf: str) -> DataFrame:
    out = E.evaluate(_backfilled(spark, sf), ["event_type", "horizon_step"], tie=["cutoff"])
    return R.rounded(out.select("event_type", "horizon_step", "n", "mae", "rmse", "mape", "coverage", "bias"), 4)


#: Line items: quantity as the actual, and a guess from the part.
LINES = "p AS (SELECT l_returnflag AS g, l_quantity AS actual, 20.0 + (l_partkey % 11) AS forecast, l_orderkey AS o, l_linenumber AS ln FROM lineitem)"
KEPT = f"{LINES}, r AS (SELECT *, abs(actual - forecast) AS e, row_number() OVER (PARTITION BY g ORDER BY abs(actual - forecast), o, ln) AS k, count(*) OVER (PARTITION BY g) AS n FROM p)"


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    guess = (F.col("l_partkey") % 11 + 20).cast("double")
    return load(spark, sf, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_quantity").alias("actual"), guess.alias("forecast"), (guess - 12).alias("forecast_lower"), (guess + 12).alias("forecast_upper"), "l_orderkey", "l_linenumber")


@query(f"""WITH {KEPT} SELECT g, any_value(n) AS n, round(avg(e), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse, round(100 * avg(CASE WHEN actual <> 0 THEN e / abs(actual) END), 6) AS mape,
    round(100 * avg(e / ((abs(actual) + abs(forecast)) / 2)), 6) AS smape, round(median(e), 6) AS medae FROM r WHERE k <= n - floor(n * 0.01) GROUP BY 1""")
def eval_trimmed(spark: SparkSession, sf: str) -> DataFrame:
    return R.rounded(E.evaluate(_lines(spark, sf), ["g"], tie=["l_orderkey", "l_linenumber"]).select("g", "n", "mae", "rmse", "mape", "smape", "medae"))


@query(f"""WITH {LINES} SELECT g, round(quantile_cont(actual - forecast, 0.25), 6) AS q25, round(quantile_cont(actual - forecast, 0.5), 6) AS q50, round(quantile_cont(actual - forecast, 0.75), 6) AS q75,
    round(stddev_samp(actual - forecast), 6) AS sigma, round(1 - avg((actual - forecast) ** 2) / var_pop(actual), 6) AS r2 FROM p GROUP BY 1""")
def eval_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    return R.rounded(E.evaluate(_lines(spark, sf), ["g"], tie=["l_orderkey", "l_linenumber"]).select("g", "q25", "q50", "q75", "sigma", "r2"))


@query(f"""WITH {LINES} SELECT g, round(avg(CASE WHEN actual > forecast - 12 AND actual < forecast + 12 THEN 1.0 ELSE 0.0 END), 6) AS within, round(avg(CASE WHEN actual <= forecast - 12 THEN 1.0 ELSE 0.0 END), 6) AS below,
    round(avg(CASE WHEN actual >= forecast + 12 THEN 1.0 ELSE 0.0 END), 6) AS above FROM p GROUP BY 1""")
def coverage(spark: SparkSession, sf: str) -> DataFrame:
    c = E.prediction_coverage(*(F.col(x) for x in ("actual", "forecast", "forecast_lower", "forecast_upper")))
    return R.rounded(_lines(spark, sf).groupBy("g").agg(*[c[k].alias(k) for k in ("within", "below", "above")]))


@query(f"WITH {LINES} SELECT g, round(avg(CASE WHEN actual >= forecast THEN 0.9 * (actual - forecast) ELSE 0.1 * (forecast - actual) END), 6) AS loss FROM p GROUP BY 1")
def quantile_loss(spark: SparkSession, sf: str) -> DataFrame:
    return R.rounded(_lines(spark, sf).groupBy("g").agg(E.quantile_loss(F.col("actual"), F.col("forecast"), 0.9).alias("loss")))


@query(f"WITH {LINES} SELECT g, round(avg(24 + 10 * greatest(forecast - 12 - actual, 0) + 10 * greatest(actual - forecast - 12, 0)), 6) AS score FROM p GROUP BY 1")
def interval_score(spark: SparkSession, sf: str) -> DataFrame:
    return R.rounded(_lines(spark, sf).groupBy("g").agg(E.interval_score(F.col("actual"), F.col("forecast_lower"), F.col("forecast_upper"), 0.8).alias("score")))


@query(f"""WITH {LINES} SELECT g, round(corr(actual, forecast), 6) AS correlation, round(avg((actual - forecast) ** 2), 6) AS mse, round(100 * avg(abs(actual - forecast) / (abs(actual) + abs(forecast))), 6) AS smape FROM p GROUP BY 1""")
def prediction_errors(spark: SparkSession, sf: str) -> DataFrame:
    return R.rounded(E.prediction_errors(_lines(spark, sf), "actual", "forecast", ["g"]).select("g", "correlation", "mse", "smape"))


_AD = "a AS (SELECT event_type, event_id, ts, value > 40 AS t, user_id % 4 = 0 AS p FROM events)"


def _flags(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "events").select("event_type", "event_id", "ts", (F.col("value") > 40).alias("is_anomaly"), (F.col("user_id") % 4 == 0).alias("is_anomaly_predicted"))


@query(f"""WITH {_AD}, c AS (SELECT event_type, count(*) AS n, count_if(t AND p) AS tp, count_if(p) AS pp, count_if(t) AS tt, count_if(t = p) AS ok FROM a GROUP BY 1), d AS (SELECT *, coalesce(tp / nullif(pp, 0), 0) AS pr, coalesce(tp / nullif(tt, 0), 0) AS re FROM c)
    SELECT event_type, n, round(pr, 6) AS precision, round(re, 6) AS recall, round(coalesce(2 * pr * re / nullif(pr + re, 0), 0), 6) AS f1, round(ok / n, 6) AS accuracy FROM d""")
def ad_eval(spark: SparkSession, sf: str) -> DataFrame:
    return R.rounded(E.detection(_flags(spark, sf), ["event_type"]).drop("mcc"))


@query(f"""WITH {_AD}, s AS (SELECT *, bool_or(t) OVER w AS tw, bool_or(p) OVER w AS pw FROM a WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))
    SELECT event_type, round(count_if(p AND tw) / count_if(p), 6) AS precision, round(count_if(t AND pw) / count_if(t), 6) AS recall FROM s WHERE event_type IN (SELECT event_type FROM a GROUP BY 1 HAVING count_if(t) > 0 AND count_if(p) > 0) GROUP BY 1""")
def ad_eval_soft(spark: SparkSession, sf: str) -> DataFrame:
    df = _flags(spark, sf).withColumn("at", F.struct("ts", "event_id"))
    return R.rounded(E.detection(df, ["event_type"], window=1, time_col="at").where("recall > 0 or precision > 0").select("event_type", "precision", "recall"))


PARTS = """fp AS (SELECT 'm' || (o_custkey % 3) AS metric_id, CAST(o_orderdate AS DATE) AS forecasted_date, CAST(o_orderdate AS DATE) - CAST(o_orderkey % 9 AS INTEGER) AS last_training_date,
    CASE WHEN o_orderkey % 5 = 0 THEN 'fitted' ELSE 'forecast' END AS stage, CASE WHEN o_orderkey % 2 = 0 THEN round(o_totalprice, 2) END AS actual, round(o_totalprice * 1.1, 2) AS forecast, o_orderkey AS k FROM orders)"""


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders")
    date = F.col("o_orderdate").cast("date")
    return o.select(
        F.concat(F.lit("m"), (F.col("o_custkey") % 3).cast("string")).alias("metric_id"), date.alias("forecasted_date"), F.date_sub(date, (F.col("o_orderkey") % 9).cast("int")).alias("last_training_date"),
        F.when(F.col("o_orderkey") % 5 == 0, "fitted").otherwise("forecast").alias("stage"), F.when(F.col("o_orderkey") % 2 == 0, F.round("o_totalprice", 2)).alias("actual"), F.round(F.col("o_totalprice") * 1.1, 2).alias("forecast"), F.col("o_orderkey").alias("k"),
    )


@query(f"""WITH {PARTS} SELECT metric_id, forecasted_date, round(avg(actual), 6) AS actual, min(actual) AS actual_min, max(actual) AS actual_max, count(actual) AS n_partitions,
    coalesce(stddev_samp(actual), 0) / abs(avg(actual)) <= 0.001 AS consistent FROM fp WHERE actual IS NOT NULL GROUP BY 1, 2""")
def actuals_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    return R.rounded(E.dedupe_actuals(_parts(spark, sf)).drop("actual_std"), 6)


@query(f"""WITH {PARTS}, a AS (SELECT metric_id, forecasted_date, avg(actual) AS a FROM fp WHERE actual IS NOT NULL GROUP BY 1, 2)
    SELECT metric_id, CAST(forecasted_date - last_training_date AS INTEGER) AS horizon_step, count(a) AS n, round(avg(a - forecast), 2) AS bias FROM fp JOIN a USING (metric_id, forecasted_date) WHERE stage = 'forecast' AND forecasted_date - last_training_date BETWEEN 1 AND 5 GROUP BY 1, 2
    UNION ALL SELECT metric_id, NULL, count(a), round(avg(a - forecast), 2) FROM fp JOIN a USING (metric_id, forecasted_date) WHERE stage = 'forecast' AND forecasted_date - last_training_date BETWEEN 1 AND 5 GROUP BY 1""")
def live_eval_join(spark: SparkSession, sf: str) -> DataFrame:
    df = _parts(spark, sf).withColumn("forecast_lower", F.lit(None).cast("double")).withColumn("forecast_upper", F.lit(None).cast("double"))
    return R.rounded(E.live_eval(df, 5, tie=["k"]).select("metric_id", "horizon_step", "n", "bias"), 2)


#: A forecast frame: fitted to day 20, forecast after; no actuals there.
FRAME = f"{DAILY}, fr AS (SELECT event_type, ts, CASE WHEN day(ts) <= 20 THEN 'fitted' ELSE 'forecast' END AS stage, CASE WHEN day(ts) <= 20 THEN v END AS actual, v * 1.1 AS forecast, n * 1.0 AS std FROM daily)"


def _frame(spark: SparkSession, sf: str) -> DataFrame:
    fitted = F.dayofmonth("ts") <= 20
    return daily(spark, sf).select("event_type", "ts", F.when(fitted, "fitted").otherwise("forecast").alias("stage"), F.when(fitted, F.col("v")).alias("actual"), (F.col("v") * 1.1).alias("forecast"), F.col("n").cast("double").alias("std"))


_SUMS = f"""CASE WHEN bool_or(stage = 'forecast') THEN 'forecast' ELSE 'fitted' END AS stage, round(CASE WHEN count(actual) = count(*) THEN sum(actual) END, 4) AS actual, round(sum(forecast), 4) AS forecast, round(sqrt(sum(std * std)), 4) AS std,
    round(sum(forecast) - {Z80} * sqrt(sum(std * std)), 4) AS forecast_lower, round(sum(forecast) + {Z80} * sqrt(sum(std * std)), 4) AS forecast_upper"""


@query(f"WITH {FRAME} SELECT ts, {_SUMS} FROM fr GROUP BY 1")
def sum_over_dims(spark: SparkSession, sf: str) -> DataFrame:
    return R.rounded(FC.sum_over_dims(_frame(spark, sf), ["ts"]), 4)


@query(f"WITH {FRAME} SELECT event_type, date_trunc('week', ts) AS ts, {_SUMS} FROM fr GROUP BY 1, 2 HAVING count(*) = 7")
def sum_over_period(spark: SparkSession, sf: str) -> DataFrame:
    return R.rounded(FC.sum_over_period(_frame(spark, sf), "ts", "W", dims=["event_type"]), 4)


@query(f"""WITH {FRAME}, w AS (SELECT *, sum(forecast) OVER p AS y, sum(std * std) OVER p AS s, CASE WHEN count(actual) OVER p = count(*) OVER p THEN sum(actual) OVER p END AS a FROM fr WINDOW p AS (PARTITION BY ts))
    SELECT event_type, ts, stage, round(actual / nullif(a, 0), 6) AS actual, round(forecast / y, 6) AS forecast, round(sqrt(std * std + (forecast / y) ** 2 * s) / abs(y), 6) AS std FROM w""")
def weight_over_dims(spark: SparkSession, sf: str) -> DataFrame:
    return R.rounded(FC.weight_over_dims(_frame(spark, sf), ["ts"], "delta").drop("forecast_lower", "forecast_upper"))


@query(f"""WITH {FRAME}, w AS (SELECT *, count(*) OVER p AS k, sum(forecast) OVER p AS y FROM fr WINDOW p AS (PARTITION BY event_type, date_trunc('week', ts)))
    SELECT event_type, ts, round(forecast / y, 6) AS forecast, round(std / abs(y), 6) AS std, round(forecast / y - {Z80} * std / abs(y), 6) AS forecast_lower FROM w WHERE k = 7""")
def weight_over_period(spark: SparkSession, sf: str) -> DataFrame:
    return R.rounded(FC.weight_over_period(_frame(spark, sf), "ts", "W", dims=["event_type"]).select("event_type", "ts", "forecast", "std", "forecast_lower"))


@query(f"""WITH {DAILY}, t AS (SELECT 'all' AS node, 'view' AS leaf UNION ALL SELECT 'all', 'click' UNION ALL SELECT 'all', 'purchase' UNION ALL SELECT 'web', 'view' UNION ALL SELECT 'web', 'click' UNION ALL SELECT 'view', 'view')
    SELECT node, ts, round(sum(v), 4) AS forecast FROM daily JOIN t ON event_type = leaf GROUP BY 1, 2""")
def reconcile_bottom_up(spark: SparkSession, sf: str) -> DataFrame:
    tree = spark.createDataFrame([("all", "view"), ("all", "click"), ("all", "purchase"), ("web", "view"), ("web", "click"), ("view", "view")], "node string, leaf string")
    leaves = daily(spark, sf).select(F.col("event_type").alias("node"), "ts", F.col("v").alias("forecast"))
    return R.rounded(FC.bottom_up(leaves, tree, ["ts"]), 4)


@query(f"""WITH {DAILY}, x AS (SELECT ts, sum(CASE WHEN event_type = 'view' THEN v * 1.2 END) AS a, sum(CASE WHEN event_type = 'click' THEN v END) AS b, sum(CASE WHEN event_type IN ('view', 'click') THEN v END) AS s FROM daily GROUP BY 1),
    r AS (SELECT ts, a + (s - a - b) / 3 AS a, b + (s - a - b) / 3 AS b FROM x)
    SELECT ts, 'view' AS node, round(a, 3) AS forecast FROM r UNION ALL SELECT ts, 'click', round(b, 3) FROM r UNION ALL SELECT ts, 'both', round(a + b, 3) FROM r""")
def reconcile_ols(spark: SparkSession, sf: str) -> DataFrame:
    d = daily(spark, sf).where("event_type in ('view', 'click')")
    leaves = d.select("ts", F.col("event_type").alias("node"), F.when(F.col("event_type") == "view", F.col("v") * 1.2).otherwise(F.col("v")).alias("forecast"))
    both = d.groupBy("ts").agg(F.sum("v").alias("forecast")).select("ts", F.lit("both").alias("node"), "forecast")
    return R.rounded(FC.reconcile(leaves.unionByName(both), ["view", "click", "both"], ["view", "click"], {"both": ["view", "click"]}, "ts"), 3)


@query(f"""WITH {LINES} SELECT g, round(quantile_cont(actual - forecast, 0.025), 6) AS lower, round(quantile_cont(actual - forecast, 0.975), 6) AS upper, count(*) AS n FROM p GROUP BY 1""")
def conditional_interval_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    df = _lines(spark, sf).withColumn("residual", F.col("actual") - F.col("forecast"))
    out = E.empirical_distribution(df, "residual", ["g"], (0.025, 0.975))
    return R.rounded(out.select("g", F.get("quantiles", F.lit(0)).alias("lower"), F.get("quantiles", F.lit(1)).alias("upper"), "n"))


@query(f"WITH {LINES} SELECT g, count_if((actual < forecast - 12 OR actual > forecast + 12) AND 100 * abs((actual - forecast) / actual) > 60) AS anomalies FROM p GROUP BY 1")
def detect_interval_and_ape(spark: SparkSession, sf: str) -> DataFrame:
    return E.detect(_lines(spark, sf), ape=60.0).groupBy("g").agg(F.count_if("is_anomaly_predicted").alias("anomalies"))


WEEKLY = G.Model(changepoints=0, seasons=(("weekly", 7.0, 1),), alpha=0.1)


@query(f"""WITH {DAILY}, w AS (SELECT *, CAST(date_diff('day', DATE '2000-01-01', CAST(ts AS DATE)) AS DOUBLE) AS d FROM daily), e AS (SELECT event_type, min(d) AS a, max(d) AS b, max(ts) AS last FROM w GROUP BY 1),
    r AS (SELECT event_type AS g, ts, 'fitted' AS stage, v AS y, d FROM w UNION ALL SELECT event_type, last + to_days(CAST(h AS INTEGER)), 'forecast', NULL, b + h FROM e, range(1, 8) t(h)),
    x AS (SELECT r.*, 1.0 AS x0, (d - a) / (b - a) AS x1, sin(2 * pi() * d / 7) AS x2, cos(2 * pi() * d / 7) AS x3 FROM r JOIN e ON e.event_type = r.g), {solved("x WHERE y IS NOT NULL", 4, [0, 0.1, 0.1, 0.1])},
    f AS (SELECT x.*, b0 + b1 * x1 AS growth, b2 * x2 + b3 * x3 AS season FROM x JOIN beta USING (g)), s AS (SELECT g, sqrt(avg((y - growth - season) ** 2)) AS sd FROM f GROUP BY 1)
    SELECT g AS event_type, ts, stage, round(y, 4) AS actual, round(growth + season, 4) AS forecast, round(growth + season - {Z95} * sd, 4) AS forecast_lower, round(growth + season + {Z95} * sd, 4) AS forecast_upper, round(sd, 4) AS std,
        round(growth, 4) AS longterm_growth, round(season, 4) AS weekly_seasonality, CAST(0 AS DOUBLE) AS annual_seasonality FROM f JOIN s USING (g)""")
def forecast_regression(spark: SparkSession, sf: str) -> DataFrame:
    """Trend and a weekly wave by ridge, from sums of products."""
    return R.rounded(G.regression_forecast(daily(spark, sf), "ts", "v", 7, model=WEEKLY, dims=["event_type"]), 4)


@query(f"""WITH total AS (SELECT date_trunc('day', ts) AS ts, sum(value) AS v FROM events GROUP BY 1), w AS (SELECT *, CAST(date_diff('day', DATE '2000-01-01', CAST(ts AS DATE)) AS DOUBLE) AS d FROM total), e AS (SELECT min(d) AS a, max(d) AS b FROM w),
    x AS (SELECT 1 AS g, ts, v AS y, d, 1.0 AS x0, (d - a) / (b - a) AS x1, greatest(0, (d - a) / (b - a) - 1 / 3.0) AS x2, greatest(0, (d - a) / (b - a) - 2 / 3.0) AS x3 FROM w, e), {solved("x", 4, [0, 2.0, 2.0, 2.0])}
    SELECT ts, round(y, 3) AS actual, round(b0 + b1 * x1 + b2 * x2 + b3 * x3, 3) AS longterm_growth, round(b0 + b1 * x1 + b2 * x2 + b3 * x3, 3) AS forecast FROM x JOIN beta USING (g)""")
def forecast_regression_one_series(spark: SparkSession, sf: str) -> DataFrame:
    """One series over all rows: a trend that may bend twice."""
    v = load(spark, sf, "events").groupBy(F.date_trunc("day", "ts").alias("ts")).agg(F.sum("value").alias("v"))
    out = G.regression_forecast(v, "ts", "v", 1, model=G.Model(changepoints=2, seasons=(), alpha=2.0)).where("stage = 'fitted'")
    return R.rounded(out.select("ts", "actual", "longterm_growth", "forecast"), 3)


@query("""SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2""")
def stream_tumbling_batch(spark: SparkSession, sf: str) -> DataFrame:
    return R.rounded(SW.tumbling(load(spark, sf, "events"), "ts", "1 hour", ["event_type"], [F.count("*").alias("n"), F.sum("value").alias("value")]).drop("end"), 4)


@query("""WITH l AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events), s AS (SELECT *, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM l)
    SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_sessions_batch(spark: SparkSession, sf: str) -> DataFrame:
    return SW.sessions(load(spark, sf, "events"), "ts", "6 hours", ["user_id"], [F.count("*").alias("n")]).drop("end")
