"""Time series from events and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import relational as R
from ..operators import series as S
from ..specs import Metric, MetricSource, UnitMetric
from .registry import load, query

EVENTS = MetricSource("events", "user_id", (UnitMetric("value", "SUM", "value"), UnitMetric("event_id", "COUNT", "n")), (Metric("value", name="value"), Metric("value", "SUM", "n", "SUM", name="value_per_event")))
DAILY = "daily AS (SELECT date_trunc('day', ts) AS ts, event_type, sum(value) AS v, count(*) AS n FROM events GROUP BY 1, 2)"
TOTAL = "total AS (SELECT date_trunc('day', ts) AS ts, sum(value) AS v FROM events WHERE event_type <> 'error' GROUP BY 1)"
#: Days 5, 6, 13, 20 and 21 of the month are taken out, to have gaps.
HOLED = "holed AS (SELECT * FROM daily WHERE day(ts) NOT IN (5, 6, 13, 20, 21))"


def daily(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "events").groupBy(F.date_trunc("day", "ts").alias("ts"), "event_type").agg(F.sum("value").alias("v"), F.count("*").alias("n"))


def total(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "events").where("event_type <> 'error'").groupBy(F.date_trunc("day", "ts").alias("ts")).agg(F.sum("value").alias("v"))


def holed(spark: SparkSession, sf: str) -> DataFrame:
    return daily(spark, sf).where(~F.dayofmonth("ts").isin(5, 6, 13, 20, 21))


def _metrics(name: str, freq: str, unit: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        out = M.time_metrics(load(spark, sf, "events"), EVENTS, "ts", freq)
        return R.rounded(out.select("ts", "value", "value_per_event", "sample_count"), 8)

    run.__name__ = f"ts_metrics_{name}"
    query(f"""WITH u AS (SELECT user_id, ts, sum(value) AS v, count(*) AS n FROM events GROUP BY 1, 2)
        SELECT date_trunc('{unit}', ts) AS ts, round(sum(v), 8) AS value, round(sum(v) / sum(n), 8) AS value_per_event, count(*) AS sample_count FROM u GROUP BY 1""")(run)


for _n, _f in (("hour", "h"), ("day", "D"), ("week", "W"), ("month", "M")):
    _metrics(_n, _f, _n)


@query("""WITH u AS (SELECT user_id, ts, event_type, sum(value) AS v, count(*) AS n FROM events GROUP BY 1, 2, 3)
    SELECT date_trunc('day', ts) AS ts, event_type, round(sum(v) / sum(n), 8) AS value_per_event, count(*) AS sample_count FROM u GROUP BY 1, 2""")
def ts_metrics_dims_ratio(spark: SparkSession, sf: str) -> DataFrame:
    from dataclasses import replace

    out = M.time_metrics(load(spark, sf, "events"), replace(EVENTS, dims=("event_type",)), "ts", "D")
    return R.rounded(out.select("ts", "event_type", "value_per_event", "sample_count"), 8)


@query(f"""WITH {DAILY}, {HOLED}, e AS (SELECT event_type, min(ts) AS a, max(ts) AS b FROM holed GROUP BY 1), g AS (SELECT event_type, unnest(generate_series(a, b, INTERVAL 1 DAY)) AS ts FROM e)
    SELECT g.event_type, g.ts, round(v, 4) AS v FROM g LEFT JOIN holed USING (event_type, ts)""")
def ts_fill_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return R.rounded(S.regularize(holed(spark, sf), "ts", ["v"], "D", ["event_type"]), 4)


@query(f"""WITH {DAILY}, {HOLED}, g AS (SELECT event_type, ts, lag(ts) OVER (PARTITION BY event_type ORDER BY ts) AS p FROM holed)
    SELECT event_type, p AS gap_start, ts AS gap_end, CAST(date_diff('day', p, ts) - 1 AS DOUBLE) AS gap_size FROM g WHERE date_diff('day', p, ts) > 1""")
def ts_find_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return S.find_gaps(holed(spark, sf), "ts", ["event_type"])


@query(f"""WITH {DAILY}, {HOLED}, g AS (SELECT event_type, ts, CAST(epoch(ts) - epoch(lag(ts) OVER (PARTITION BY event_type ORDER BY ts)) AS BIGINT) AS s FROM holed)
    SELECT event_type, count(*) AS n, min(ts) AS start, max(ts) AS "end", min(s) AS min_step, median(s) AS median_step, max(s) AS max_step, min(s) = max(s) AS regular FROM g GROUP BY 1""")
def ts_describe(spark: SparkSession, sf: str) -> DataFrame:
    return S.describe(holed(spark, sf), "ts", ["event_type"])


@query(f"WITH {DAILY} SELECT event_type, CAST(86400 AS BIGINT) AS step, 'D' AS freq FROM daily GROUP BY 1")
def ts_infer_freq(spark: SparkSession, sf: str) -> DataFrame:
    return S.infer_freq(daily(spark, sf), "ts", ["event_type"])


_SAT = "CAST(ts AS DATE) + CAST((5 - (isodow(ts) - 1) + 7) % 7 AS INTEGER)"


@query(f"WITH {DAILY} SELECT event_type, CAST(date_trunc('week', ts) AS DATE) + 6 AS ts, round(sum(v), 4) AS v, CAST(sum(n) AS BIGINT) AS n FROM daily GROUP BY 1, 2")
def coarsen_week_sum(spark: SparkSession, sf: str) -> DataFrame:
    return R.rounded(S.coarsen(daily(spark, sf), "ts", "W", "sum", ["v", "n"], ["event_type"]), 4)


@query(f"WITH {DAILY} SELECT event_type, {_SAT} AS ts, round(avg(v), 4) AS v FROM daily GROUP BY 1, 2")
def coarsen_week_mean(spark: SparkSession, sf: str) -> DataFrame:
    return R.rounded(S.coarsen(daily(spark, sf), "ts", "W-SAT", "mean", ["v"], ["event_type"]), 4)


@query(f"""WITH {DAILY}, {HOLED}, w AS (SELECT *, count(*) OVER p AS k, sum(v) OVER p AS s FROM holed WINDOW p AS (PARTITION BY event_type, date_trunc('week', ts)))
    SELECT event_type, ts, round(CASE WHEN k = 7 AND s <> 0 THEN v / s END, 6) AS v_share FROM w""")
def weight_within_week(spark: SparkSession, sf: str) -> DataFrame:
    return R.rounded(S.share_within_period(holed(spark, sf), "ts", ["v"], "D", "W", ["event_type"]).select("event_type", "ts", "v_share"))


_PAST = "LEFT JOIN holed p{k} ON p{k}.event_type = h.event_type AND p{k}.ts = h.ts - INTERVAL {d} DAY"


@query(f"WITH {DAILY}, {HOLED} SELECT h.event_type, h.ts, round(h.v - p1.v, 4) AS v_diff FROM holed h {_PAST.format(k=1, d=7)}")
def diff_wow(spark: SparkSession, sf: str) -> DataFrame:
    return R.rounded(S.date_diff(holed(spark, sf), "ts", "v", "W", [1], dims=["event_type"]).select("event_type", "ts", "v_diff"), 4)


@query(f"WITH {DAILY}, {HOLED} SELECT h.event_type, h.ts, round((h.v - p1.v) / nullif(p1.v, 0), 6) AS v_diff FROM holed h {_PAST.format(k=1, d=1)}")
def diff_relative(spark: SparkSession, sf: str) -> DataFrame:
    return R.rounded(S.date_diff(holed(spark, sf), "ts", "v", "D", [1], relative=True, dims=["event_type"]).select("event_type", "ts", "v_diff"))


@query(f"WITH {DAILY}, {HOLED} SELECT h.event_type, h.ts, round(h.v - (p1.v + p2.v + p3.v) / 3, 4) AS v_diff FROM holed h {_PAST.format(k=1, d=7)} {_PAST.format(k=2, d=14)} {_PAST.format(k=3, d=21)}")
def diff_multi_lag_mean(spark: SparkSession, sf: str) -> DataFrame:
    return R.rounded(S.date_diff(holed(spark, sf), "ts", "v", "W", [1, 2, 3], "mean", dims=["event_type"]).select("event_type", "ts", "v_diff"), 4)


MONTHLY = "monthly AS (SELECT date_trunc('month', o_orderdate) AS ts, sum(o_totalprice) AS v FROM orders GROUP BY 1)"


@query(f"WITH {MONTHLY} SELECT m.ts, round(m.v - p.v, 2) AS v_diff FROM monthly m LEFT JOIN monthly p ON p.ts = m.ts - INTERVAL 12 MONTH")
def diff_yoy_month(spark: SparkSession, sf: str) -> DataFrame:
    m = load(spark, sf, "orders").groupBy(F.date_trunc("month", "o_orderdate").alias("ts")).agg(F.sum("o_totalprice").alias("v"))
    return R.rounded(S.date_diff(m, "ts", "v", "M", [12]).select("ts", "v_diff"), 2)


W = "WINDOW w AS (PARTITION BY event_type ORDER BY ts)"


@query(f"WITH {DAILY} SELECT event_type, ts, round(lag(v, 1) OVER w, 4) AS v_lag1, round(lag(v, 7) OVER w, 4) AS v_lag7 FROM daily {W}")
def lags(spark: SparkSession, sf: str) -> DataFrame:
    return R.rounded(S.lags(daily(spark, sf), "ts", "v", [1, 7], ["event_type"]).drop("v", "n"), 4)


@query(f"""WITH {DAILY}, l AS (SELECT event_type, ts, lag(v, 1) OVER w AS a, lag(v, 7) OVER w AS b, avg(v) OVER (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 4 PRECEDING AND 2 PRECEDING) AS m FROM daily {W})
    SELECT event_type, ts, round((coalesce(a, 0) + coalesce(b, 0)) / nullif((a IS NOT NULL)::INT + (b IS NOT NULL)::INT, 0), 4) AS v_meanlag_1_7, round(m, 4) AS v_meanlag_2_to_4 FROM l""")
def agg_lags(spark: SparkSession, sf: str) -> DataFrame:
    return R.rounded(S.agg_lags(daily(spark, sf), "ts", "v", [(1, 7)], [(2, 4)], dims=["event_type"]).drop("v", "n"), 4)


_NULLED = "nulled AS (SELECT event_type, ts, CASE WHEN day(ts) % 5 <> 0 THEN v END AS v FROM daily)"


def nulled(spark: SparkSession, sf: str) -> DataFrame:
    return daily(spark, sf).withColumn("v", F.when(F.dayofmonth("ts") % 5 != 0, F.col("v"))).drop("n")


@query(f"""WITH {DAILY}, {_NULLED}, l AS (SELECT *, lag(v, 1) OVER w AS a, lag(v, 7) OVER w AS b FROM nulled {W})
    SELECT event_type, ts, round(coalesce(v, (coalesce(a, 0) + coalesce(b, 0)) / nullif((a IS NOT NULL)::INT + (b IS NOT NULL)::INT, 0)), 4) AS v FROM l""")
def impute_lags(spark: SparkSession, sf: str) -> DataFrame:
    return R.rounded(S.impute_with_lags(nulled(spark, sf), "ts", "v", [1, 7], dims=["event_type"]), 4)


@query(f"""WITH {DAILY}, {_NULLED}, l AS (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS b FROM nulled {W})
    SELECT event_type, ts, round(coalesce(v, (a + b) / 2, a, b), 4) AS v FROM l""")
def impute_interpolate(spark: SparkSession, sf: str) -> DataFrame:
    return R.rounded(S.interpolate(nulled(spark, sf), "ts", "v", ["event_type"]), 4)


def _norm(method: str, centre: str, width: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return R.rounded(S.normalize(daily(spark, sf), ["v"], method, "ts", ["event_type"]).select("event_type", "ts", "v"))

    run.__name__ = f"normalize_{method}"
    query(f"WITH {DAILY}, s AS (SELECT event_type, {centre} AS c, {width} AS w FROM daily GROUP BY 1) SELECT event_type, ts, round((v - c) / nullif(w, 0), 6) AS v FROM daily JOIN s USING (event_type)")(run)


_norm("statistical", "avg(v)", "stddev_samp(v)")
_norm("zero_to_one", "min(v)", "max(v) - min(v)")
_norm("minus_half_to_half", "(min(v) + max(v)) / 2", "max(v) - min(v)")
_norm("zero_at_origin", "min_by(v, ts)", "max(v) - min(v)")


@query("""WITH q AS (SELECT quantile_cont(value, 0.025) AS a, quantile_cont(value, 0.975) AS b FROM events), s AS (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events, q WHERE value BETWEEN a AND b)
    SELECT event_id, round((value - m) / s, 6) AS score, abs((value - m) / s) > 2 AS is_outlier FROM events, s""")
def outlier_zscore(spark: SparkSession, sf: str) -> DataFrame:
    return R.rounded(S.zscore_outliers(load(spark, sf, "events"), "value", 2.0).select("event_id", "score", "is_outlier"))


@query("""WITH q AS (SELECT quantile_cont(value, 0.025) AS a, quantile_cont(value, 0.975) AS b FROM events), s AS (SELECT quantile_cont(value, 0.1) AS l, quantile_cont(value, 0.9) AS h FROM events, q WHERE value BETWEEN a AND b)
    SELECT event_id, round(CASE WHEN value > h THEN value - h WHEN value < l THEN value - l ELSE 0 END / (h - l), 6) AS score,
           abs(CASE WHEN value > h THEN value - h WHEN value < l THEN value - l ELSE 0 END / (h - l)) > 0.5 AS is_outlier FROM events, s""")
def outlier_tukey(spark: SparkSession, sf: str) -> DataFrame:
    return R.rounded(S.tukey_outliers(load(spark, sf, "events"), "value", 0.5).select("event_id", "score", "is_outlier"))


@query(f"""WITH {DAILY}, d AS (SELECT event_type, ts, v, v - median(v) OVER (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS d FROM daily),
    s AS (SELECT event_type, avg(d) AS m, stddev_pop(d) AS s FROM d GROUP BY 1) SELECT event_type, ts, round((d - m) / s, 6) AS score FROM d JOIN s USING (event_type)""")
def outlier_zscore_differenced(spark: SparkSession, sf: str) -> DataFrame:
    return R.rounded(S.zscore_outliers(daily(spark, sf), "v", trim=0, time_col="ts", baseline=3, dims=["event_type"]).select("event_type", "ts", "score"))


@query("""SELECT event_id, year(ts)::INT AS year, quarter(ts)::INT AS quarter, month(ts)::INT AS month, weekofyear(ts)::INT AS woy, isoyear(ts)::INT AS year_iso, isodow(ts)::INT AS dow, day(ts)::INT AS dom, dayofyear(ts)::INT AS doy, hour(ts)::INT AS hour,
    isodow(ts) > 5 AS is_weekend, strftime(ts, '%Y-%m') AS year_month, round(floor(epoch(ts) - epoch(date_trunc('day', ts))) / 3600.0, 9) AS tod,
    round((isodow(ts) - 1) + floor(epoch(ts) - epoch(date_trunc('day', ts))) / 86400.0, 9) AS tow, round((dayofyear(ts) - 1 + floor(epoch(ts) - epoch(date_trunc('day', ts))) / 86400.0) / 366, 9) AS toy FROM events""")
def time_features(spark: SparkSession, sf: str) -> DataFrame:
    out = S.time_features(load(spark, sf, "events"), "ts")
    return R.rounded(out.select("event_id", "year", "quarter", "month", "woy", "year_iso", "dow", "dom", "doy", "hour", "is_weekend", "year_month", "tod", "tow", "toy"), 9)


@query("""SELECT event_id, round(sin(2 * pi() * hour(ts) / 24), 6) AS sin1_hour_daily, round(cos(2 * pi() * hour(ts) / 24), 6) AS cos1_hour_daily,
    round(sin(4 * pi() * hour(ts) / 24), 6) AS sin2_hour_daily, round(cos(4 * pi() * hour(ts) / 24), 6) AS cos2_hour_daily FROM events""")
def fourier_terms(spark: SparkSession, sf: str) -> DataFrame:
    df = load(spark, sf, "events").select("event_id", F.hour("ts").alias("hour"))
    # 0.0 stands for the signed zeros that rounding leaves
    out = R.rounded(S.fourier(df, "hour", 24.0, 2, "daily").drop("hour"))
    return out.select("event_id", *[(F.col(c) + 0.0).alias(c) for c in out.columns[1:]])


@query("SELECT event_id, greatest(value - 10, 0) AS changepoint0, greatest(value - 50.5, 0) AS changepoint1 FROM events")
def changepoint_features(spark: SparkSession, sf: str) -> DataFrame:
    return S.changepoint_features(load(spark, sf, "events").select("event_id", "value"), "value", [10.0, 50.5]).drop("value")


_HOL = "hol AS (SELECT DATE '2024-01-01' AS d, 'new_year' AS label UNION ALL SELECT DATE '2024-01-15', 'mid'), win AS (SELECT d + CAST(s AS INTEGER) AS d, CASE WHEN s = 0 THEN label WHEN s < 0 THEN label || '_minus_' || -s ELSE label || '_plus_' || s END AS label FROM hol, range(-1, 3) t(s))"


@query(f"WITH {_HOL} SELECT event_id, coalesce(label, '') AS label FROM events LEFT JOIN win ON CAST(ts AS DATE) = d")
def event_window(spark: SparkSession, sf: str) -> DataFrame:
    hol = spark.createDataFrame([("2024-01-01", "new_year"), ("2024-01-15", "mid")], "d string, label string").withColumn("d", F.to_date("d"))
    return S.add_events(load(spark, sf, "events").select("event_id", "ts"), S.event_windows(hol, "d", "label", 1, 2), "ts", "d", "label").drop("ts")


_IV = "iv AS (SELECT ts AS start_ts, ts + INTERVAL 90 MINUTE AS end_ts FROM events WHERE event_type = 'error')"


def intervals(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "events").where("event_type = 'error'").select(F.col("ts").alias("start_ts"), (F.col("ts") + F.expr("interval 90 minutes")).alias("end_ts"))


@query(f"WITH {_IV} SELECT event_id, EXISTS (SELECT 1 FROM iv WHERE ts BETWEEN start_ts AND end_ts) AS is_anomaly FROM events")
def anomaly_label_interval_join(spark: SparkSession, sf: str) -> DataFrame:
    return S.label_intervals(load(spark, sf, "events").select("event_id", "ts"), intervals(spark, sf), "ts").drop("ts")


@query(f"""WITH {DAILY}, f AS (SELECT *, v > avg(v) OVER (PARTITION BY event_type) AS f FROM daily), g AS (SELECT *, sum(CASE WHEN f THEN 0 ELSE 1 END) OVER (PARTITION BY event_type ORDER BY ts) AS k FROM f)
    SELECT event_type, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n FROM g WHERE f GROUP BY event_type, k""")
def anomaly_islands(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql.window import Window

    df = daily(spark, sf).withColumn("f", F.col("v") > F.avg("v").over(Window.partitionBy("event_type")))
    return S.islands(df, "ts", "f", ["event_type"])


@query(f"""WITH {_IV}, s AS (SELECT *, max(end_ts) OVER (ORDER BY start_ts, end_ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM iv),
    g AS (SELECT *, sum(CASE WHEN seen IS NULL OR start_ts > seen + INTERVAL 1 HOUR THEN 1 ELSE 0 END) OVER (ORDER BY start_ts, end_ts ROWS UNBOUNDED PRECEDING) AS k FROM s) SELECT min(start_ts) AS start_ts, max(end_ts) AS end_ts FROM g GROUP BY k""")
def anomaly_merge_intervals(spark: SparkSession, sf: str) -> DataFrame:
    return S.merge_intervals(intervals(spark, sf), gap="interval 1 hour")


@query(f"""WITH {DAILY}, d AS (SELECT event_type, ts, abs(v - lag(v) OVER (PARTITION BY event_type ORDER BY ts)) AS step FROM daily), s AS (SELECT event_type, avg(step) AS m, stddev_samp(step) AS s FROM d GROUP BY 1)
    SELECT event_type, ts, round(step, 4) AS step, coalesce((step - m) / s > 1.5, false) AS is_shift FROM d JOIN s USING (event_type)""")
def level_shift(spark: SparkSession, sf: str) -> DataFrame:
    return R.rounded(S.level_shifts(daily(spark, sf), "ts", "v", 1.5, ["event_type"]).select("event_type", "ts", "step", "is_shift"), 4)
