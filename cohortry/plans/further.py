"""Queries of the operators beyond the first ones: effects of families of metrics, calendars, series, detection and selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import time as T
from ..operators import evaluation as E
from ..operators import experiments as X
from ..operators import forecast as FC
from ..operators import journey as J
from ..operators import metrics as M
from ..operators import relational as R
from ..operators import rewards as W
from ..operators import selection as L
from ..operators import series as S
from ..specs import Launch, Metric, MetricSource, UnitMetric
from .experiments import END, P_VALUE, REVENUE, START, STATS, _in, experiments, joined, merged_sql, revenue
from .forecasts import _AD, BACK, KEPT, LINES, _backfilled, _flags, _I, _lines
from .registry import load, query
from .series import _NULLED, DAILY, HOLED, MONTHLY, daily, holed, nulled

# experiments


@query(f"""WITH {STATS}, ctl AS (SELECT s1 / n AS m, n FROM s WHERE variant = 'control|control|control')
    SELECT variant AS pair, 'revenue' AS metric, round(s1 / s.n - ctl.m, 3) AS delta, round(100 * (s1 / s.n - ctl.m) / ctl.m, 3) AS percent, ctl.n AS control_count, s.n AS treatment_count
    FROM s, ctl WHERE variant NOT LIKE '%nan%' AND variant <> 'control|control|control' AND s.n > 1 AND ctl.n > 1""")
def mea_all_against_control(spark: SparkSession, sf: str) -> DataFrame:
    stats = X.variant_stats(joined(spark, sf, 3), ["revenue"])
    out = X.against_control(stats, ("control",) * 3)
    return out.select("pair", "metric", F.round("delta", 3).alias("delta"), "percent", "control_count", "treatment_count")


ORDERS = MetricSource("orders", "o_custkey", (UnitMetric("o_totalprice", "SUM", "revenue"), UnitMetric("o_orderkey", "COUNT", "n_orders")), (Metric("revenue"), Metric("revenue", denominator="n_orders", name="per_order")), date_col="o_orderdate")


def _families(spark: SparkSession, sf: str) -> X.Analysis:
    o = R.in_dates(load(spark, sf, "orders"), "o_orderdate", START, END)
    return X.run_families(experiments(spark, sf, 2), [(o, ORDERS)], [Launch(("v1", "enabled"))], buckets=30, weighted=False)


_SIDES = f"""side AS (SELECT CASE WHEN variant IN ({_in(Launch(("v1", "enabled")).against().treatment)}) THEN 't' WHEN variant IN ({_in(Launch(("v1", "enabled")).against().control)}) THEN 'c' END AS side, variant, unit, revenue AS x, n_orders AS y
    FROM merged LEFT JOIN rev USING (unit)), a AS (SELECT side, coalesce(sum(x), 0) AS x, coalesce(sum(y), 0) AS y, count(*) AS n FROM side WHERE side IS NOT NULL GROUP BY 1)"""


@query(f"""WITH {merged_sql(2)}, {REVENUE}, {_SIDES}, j AS (SELECT unit, variant, side, coalesce(x, 0) AS x, coalesce(y, 0) AS y FROM side),
    b AS (SELECT *, (row_number() OVER (ORDER BY unit) - 1) // CAST(ceil(count(*) OVER () / 30.0) AS BIGINT) AS jk FROM j), k AS (SELECT range AS jk FROM range(30)),
    v AS (SELECT side, variant, sum(x) AS x, sum(y) AS y, count(*) AS n FROM b WHERE side IS NOT NULL GROUP BY 1, 2), p AS (SELECT variant, jk, sum(x) AS x, sum(y) AS y, count(*) AS n FROM b WHERE side IS NOT NULL GROUP BY 1, 2),
    l AS (SELECT k.jk, v.side, v.n AS w, (v.x - coalesce(p.x, 0)) / (v.n - coalesce(p.n, 0)) AS mx, (v.y - coalesce(p.y, 0)) / (v.n - coalesce(p.n, 0)) AS my FROM k CROSS JOIN v LEFT JOIN p ON p.jk = k.jk AND p.variant = v.variant),
    r AS (SELECT jk, sum(CASE WHEN side = 't' THEN w * mx END) / sum(CASE WHEN side = 't' THEN w * my END) - sum(CASE WHEN side = 'c' THEN w * mx END) / sum(CASE WHEN side = 'c' THEN w * my END) AS rep FROM l GROUP BY 1),
    f AS (SELECT t.x / t.y - c.x / c.y AS full_delta, t.x / t.n - c.x / c.n AS delta FROM a t, a c WHERE t.side = 't' AND c.side = 'c')
    SELECT 'v1|enabled' AS pair, 'orders' AS metric_family, 'revenue' AS metric, 'simple' AS method, round(delta, 2) AS delta FROM f
    UNION ALL SELECT 'v1|enabled', 'orders', 'per_order', 'jackknife', round(full_delta - 29 * (avg(rep) - full_delta), 2) FROM r, f GROUP BY full_delta""")
def mea_families(spark: SparkSession, sf: str) -> DataFrame:
    return _families(spark, sf).effects.select("pair", "metric_family", "metric", "method", F.round("delta", 2).alias("delta"))


@query(f"""WITH {merged_sql(2)}, {REVENUE}, j AS (SELECT variant, revenue AS x, n_orders AS y FROM merged LEFT JOIN rev USING (unit))
    SELECT variant, 'orders' AS metric_family, 'revenue' AS metric, count(*) AS sample_count, round(coalesce(sum(x), 0) / count(*), 3) AS mean FROM j GROUP BY 1
    UNION ALL SELECT variant, 'orders', 'per_order', count(*), round(sum(x) / nullif(sum(y), 0), 3) FROM j GROUP BY 1""")
def mea_families_variant_stats(spark: SparkSession, sf: str) -> DataFrame:
    out = _families(spark, sf).variant_stats
    return out.select(X.shown(F.col("variant")).alias("variant"), "metric_family", "metric", "sample_count", F.round("mean", 3).alias("mean"))


@query(f"""WITH {STATS}, ctl AS (SELECT s1 / n AS m, greatest(s2 / n - (s1 / n) * (s1 / n), 0) / n AS v, n FROM s WHERE variant = 'control|control|control'),
    e AS (SELECT variant, s1 / s.n - ctl.m AS delta, greatest(s2 / s.n - (s1 / s.n) * (s1 / s.n), 0) / s.n AS tv, ctl.v AS cv, s.n AS tn, ctl.n AS cn FROM s, ctl WHERE variant NOT LIKE '%nan%' AND variant <> 'control|control|control' AND s.n > 5 AND ctl.n > 5),
    f AS (SELECT variant, delta / sqrt(tv + cv) AS t, floor((tv + cv) ** 2 / (tv ** 2 / (tn - 1) + cv ** 2 / (cn - 1))) AS dof FROM e)
    SELECT variant AS pair, dof, round({P_VALUE}, 6) AS p_value FROM f""")
def mea_p_values(spark: SparkSession, sf: str) -> DataFrame:
    out = X.against_control(X.variant_stats(joined(spark, sf, 3), ["revenue"]), ("control",) * 3)
    return out.where("p_value is not null").select("pair", "dof", F.round("p_value", 6).alias("p_value"))


@query(f"""WITH {REVENUE}, a AS (SELECT c_mktsegment AS s, avg(revenue) AS m FROM rev JOIN customer ON unit = c_custkey GROUP BY 1), w AS (SELECT c_mktsegment AS s, count(*) AS w FROM customer GROUP BY 1)
    SELECT round(sum(m * w) / sum(w), 4) AS weighted_mean FROM a JOIN w USING (s)""")
def strata_weighted_mean(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf, "customer")
    df = revenue(spark, sf).join(c, F.col("unit") == F.col("c_custkey"))
    return R.rounded(M.weighted_mean(df, "revenue", "c_mktsegment", c.groupBy("c_mktsegment").agg(F.count("*").alias("w")), "w"), 4)


@query("""WITH o AS (SELECT o_orderpriority AS r, o_orderstatus AS c, count(*) AS n FROM orders GROUP BY 1, 2), e AS (SELECT *, sum(n) OVER (PARTITION BY r) * sum(n) OVER (PARTITION BY c) / sum(n) OVER () AS x FROM o)
    SELECT round(2 * sum(n * ln(n / x)), 6) AS g, round(sum((n - x) ** 2 / x), 6) AS pearson, CAST((count(DISTINCT r) - 1) * (count(DISTINCT c) - 1) AS BIGINT) AS dof FROM e""")
def distribution_test(spark: SparkSession, sf: str) -> DataFrame:
    """Whether orders of all priorities have the same distribution of status; the table's cells are few."""
    import numpy as np

    from ..functions.inference import compare_distributions

    cells = load(spark, sf, "orders").groupBy("o_orderpriority", "o_orderstatus").count().collect()
    rows, columns = sorted({r[0] for r in cells}), sorted({r[1] for r in cells})
    table = np.zeros((len(rows), len(columns)))
    for r in cells:
        table[rows.index(r[0]), columns.index(r[1])] = r[2]
    g, x = compare_distributions(table), compare_distributions(table, method="pearson")
    return spark.createDataFrame([(round(g["statistic"], 6), round(x["statistic"], 6), g["dof"])], "g double, pearson double, dof long")


@query(f"""WITH {STATS}, a AS (SELECT CASE WHEN variant = 'control|control|control' THEN 'c' ELSE 't' END AS side, sum(n) AS n, sum(s1) / sum(n) AS m, greatest(sum(s2) / sum(n) - (sum(s1) / sum(n)) ** 2, 0) / sum(n) AS v FROM s WHERE variant IN ('control|control|control', 'v1|enabled|w1') GROUP BY 1)
    SELECT 'pair' AS pair, 'revenue' AS metric, round(t.m - c.m, 3) AS delta, round(t.m - c.m - 1.959963984540054 * sqrt(t.v + c.v), 3) AS ci_lower, round(t.m - c.m + 1.959963984540054 * sqrt(t.v + c.v), 3) AS ci_upper FROM a t, a c WHERE t.side = 't' AND c.side = 'c'""")
def mea_normal_interval(spark: SparkSession, sf: str) -> DataFrame:
    from ..specs import ComparisonPair

    pair = ComparisonPair((("v1", "enabled", "w1"),), (("control",) * 3,), "pair")
    found = X.effects(X.arm_stats(X.variant_stats(joined(spark, sf, 3), ["revenue"]), X.pair_relation(spark, [pair])), law="z")
    return R.rounded(X.effect_frame(spark, found).select("pair", "metric", "delta", "ci_lower", "ci_upper"), 3)


# tables, times, calendars


@query("""SELECT 'nation' AS relation, 'n_name' AS "column", count(*) AS rows, count(DISTINCT n_name) AS n_distinct, CAST(count_if(n_name IS NULL) AS BIGINT) AS n_null, min(n_name) AS least, max(n_name) AS greatest FROM nation
    UNION ALL SELECT 'region', 'r_name', count(*), count(DISTINCT r_name), CAST(count_if(r_name IS NULL) AS BIGINT), min(r_name), max(r_name) FROM region""")
def inspect_two_tables(spark: SparkSession, sf: str) -> DataFrame:
    return M.inspect({"nation": load(spark, sf, "nation"), "region": load(spark, sf, "region")}, {"nation": ["n_name"], "region": ["r_name"]})


@query("SELECT event_id, date_trunc('millisecond', ts) AS ts, epoch_us(ts) // 1000 AS ms FROM events")
def time_from_unix(spark: SparkSession, sf: str) -> DataFrame:
    ms = load(spark, sf, "events").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    return ms.select("event_id", T.normalise_time(F.col("ms"), "unix_ms").alias("ts"), "ms")


@query("""SELECT o_orderkey, strptime(strftime(o_orderdate, '%d.%m.%Y'), '%d.%m.%Y') AS parsed, date_trunc('hour', CAST(o_orderdate AS TIMESTAMP)) AS low, CAST(NULL AS TIMESTAMP) AS bad,
    CAST(o_orderdate AS DATE) >= DATE '1998-08-02' - 60 AS recent FROM orders""")
def time_parsed(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders")
    shown = F.date_format("o_orderdate", "dd.MM.yyyy")
    t = F.col("o_orderdate").cast("timestamp")
    return o.select("o_orderkey", T.parse_time(shown, "dd.MM.yyyy").alias("parsed"), T.ceil_time(F.date_trunc("hour", t), "h").alias("low"), T.parse_time(F.concat(F.lit("x"), shown), "dd.MM.yyyy").alias("bad"), T.recent(t, 60, "1998-08-02").alias("recent"))


_N = "date_diff('day', DATE '0001-01-01', CAST(o_orderdate AS DATE)) + 1"


@query(f"""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, {_N} AS n FROM orders),
    y AS (SELECT day, n, (30 * (n - 227015) + 10646) // 10631 AS y FROM d), s AS (SELECT *, n - (227014 + 354 * (y - 1) + (3 + 11 * y) // 30 + 1) AS p FROM y), m AS (SELECT *, (11 * p + 330) // 325 AS m FROM s)
    SELECT day, CAST(y AS INTEGER) AS year, CAST(m AS INTEGER) AS month, CAST(p - (29 * (m - 1) + (6 * m - 1) // 11) + 1 AS INTEGER) AS day_of_month FROM m""")
def calendar_hijri(spark: SparkSession, sf: str) -> DataFrame:
    days = load(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    return days.select("day", T.hijri(F.col("day")).alias("h")).select("day", "h.year", "h.month", F.col("h.day").alias("day_of_month"))


@query(f"""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, {_N} AS n FROM orders), s AS (SELECT y, 226895 + 365 * (y - 1) + (8 * (y - 1) + 29) // 33 AS start FROM range(1360, 1390) r(y)),
    j AS (SELECT day, n, max(y) AS y, max(start) AS start FROM d JOIN s ON start <= n GROUP BY 1, 2), k AS (SELECT *, n - start AS p FROM j)
    SELECT day, CAST(y AS INTEGER) AS year, CAST(CASE WHEN p < 186 THEN p // 31 + 1 ELSE (p - 186) // 30 + 7 END AS INTEGER) AS month, CAST(CASE WHEN p < 186 THEN p % 31 + 1 ELSE (p - 186) % 30 + 1 END AS INTEGER) AS day_of_month FROM k""")
def calendar_persian(spark: SparkSession, sf: str) -> DataFrame:
    days = load(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    return days.select("day", T.persian(F.col("day")).alias("h")).select("day", "h.year", "h.month", F.col("h.day").alias("day_of_month"))


def _holidays(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("2024-01-10", "feast"), ("2024-01-11", "rest"), ("2024-01-24", "feast")], "date string, holiday string")


@query(f"""WITH {DAILY}, h(d, name) AS (VALUES (DATE '2024-01-10', 'feast'), (DATE '2024-01-11', 'rest'), (DATE '2024-01-24', 'feast')), e AS (SELECT d + CAST(k AS INTEGER) AS d, CASE WHEN k < 0 THEN name || '_minus_' || -k WHEN k > 0 THEN name || '_plus_' || k ELSE name END AS name FROM h, range(-1, 2) r(k))
    SELECT event_type, ts, max(CASE WHEN name = 'feast' THEN 1 ELSE 0 END) AS feast, max(CASE WHEN name = 'rest' THEN 1 ELSE 0 END) AS rest, max(CASE WHEN name = 'feast_minus_1' THEN 1 ELSE 0 END) AS feast_minus_1
    FROM daily LEFT JOIN e ON CAST(ts AS DATE) = e.d GROUP BY 1, 2""")
def holiday_features(spark: SparkSession, sf: str) -> DataFrame:
    out = S.holiday_features(daily(spark, sf), "ts", _holidays(spark), ["feast", "rest", "feast_minus_1"], 1, 1)
    return out.drop("v", "n")


@query(f"""WITH {DAILY}, h AS (SELECT DISTINCT CAST(ts AS DATE) AS d, event_type AS name FROM daily WHERE n > 55 AND event_type IN ('view', 'error')), c(calendar, name, a, b) AS (VALUES ('x', 'view', 1, 1), ('y', 'error', 0, 2))
    SELECT calendar, h.d + CAST(r.k AS INTEGER) AS date, CASE WHEN r.k < 0 THEN h.name || '_minus_' || -r.k WHEN r.k > 0 THEN h.name || '_plus_' || r.k ELSE h.name END AS holiday FROM h JOIN c USING (name), range(-2, 3) r(k) WHERE r.k BETWEEN -a AND b""")
def event_window_multi(spark: SparkSession, sf: str) -> DataFrame:
    """Busy days of two kinds of events as calendars, with the days around them."""
    busy = daily(spark, sf).where("n > 55")
    of = lambda kind: busy.where(F.col("event_type") == kind).select(F.col("ts").cast("date").alias("date"), F.col("event_type").alias("holiday"))
    return S.event_windows_multi({"x": of("view"), "y": of("error")}, "date", "holiday", 1, 1, {"y": (0, 2)})


@query("""SELECT n_nationkey, r_name, count(c_custkey) AS customers FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2""")
def chained_joins(spark: SparkSession, sf: str) -> DataFrame:
    out = R.chained(load(spark, sf, "nation"), [{"right": load(spark, sf, "region"), "on": [("n_regionkey", "r_regionkey")]}, {"right": load(spark, sf, "customer"), "on": [("n_nationkey", "c_nationkey")], "how": "left"}])
    return out.groupBy("n_nationkey", "r_name").agg(F.count("c_custkey").alias("customers"))


@query("SELECT user_id, '{' || string_agg('\"' || event_type || '\":' || n, ',' ORDER BY event_type) || '}' AS counts FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def json_of_counts(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events").select("user_id", F.col("ts").alias("time"), F.col("event_type").alias("event"), F.col("event_id").alias("tie"))
    return J.count_map(e, ["user_id"]).select("user_id", M.json_of(F.col("event_count_map")).alias("counts"))


@query("""WITH r AS (SELECT user_id, event_type AS e, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)
    SELECT user_id, max(CASE WHEN k = 1 THEN e END) AS s1, max(CASE WHEN k = 2 THEN e END) AS s2, max(CASE WHEN k = 3 THEN e END) AS s3 FROM r GROUP BY 1""")
def seq_first_steps(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events").select("user_id", F.col("ts").alias("time"), F.col("event_type").alias("event"), F.col("event_id").alias("tie"))
    return J.first_steps(e, ["user_id"], 3)


@query(f"""WITH {DAILY}, h(d, name) AS (VALUES (DATE '2024-01-10', 'feast'), (DATE '2024-01-11', 'rest'), (DATE '2024-01-24', 'feast')),
    e AS (SELECT a.event_type, h.name, a.v - (coalesce(p.v, 0) + coalesce(q.v, 0)) / nullif((p.v IS NOT NULL)::INT + (q.v IS NOT NULL)::INT, 0) AS s FROM daily a JOIN h ON CAST(a.ts AS DATE) = h.d
        LEFT JOIN daily p ON p.event_type = a.event_type AND p.ts = a.ts - INTERVAL 7 DAY LEFT JOIN daily q ON q.event_type = a.event_type AND q.ts = a.ts + INTERVAL 7 DAY),
    g AS (SELECT event_type, name AS holiday, count(*) AS days, avg(s) AS effect FROM e WHERE s IS NOT NULL GROUP BY 1, 2)
    SELECT event_type, holiday, days, round(effect, 4) AS effect, CAST(ntile(2) OVER (PARTITION BY event_type ORDER BY effect, holiday) AS INTEGER) AS "group" FROM g""")
def holiday_effects(spark: SparkSession, sf: str) -> DataFrame:
    out = S.holiday_effects(daily(spark, sf), "ts", "v", _holidays(spark), dims=["event_type"])
    return R.rounded(S.holiday_groups(out, 2, ["event_type"]), 4)


# series


@query(f"WITH {DAILY}, {_NULLED} SELECT event_type, ts, round(coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING), first_value(v IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 4) AS v FROM nulled")
def fill_forward_back(spark: SparkSession, sf: str) -> DataFrame:
    out = S.fill(nulled(spark, sf), "ts", "v", True, ["event_type"])
    return R.rounded(S.fill(out, "ts", "v", False, ["event_type"]), 4)


@query(f"""WITH {DAILY}, {HOLED}, e AS (SELECT event_type, min(ts) AS a, max(ts) AS b FROM holed GROUP BY 1), g AS (SELECT event_type, unnest(generate_series(a, b, INTERVAL 1 DAY)) AS ts FROM e),
    f AS (SELECT g.event_type, g.ts, CASE WHEN day(g.ts) BETWEEN 10 AND 11 THEN NULL ELSE v END AS y, n FROM g LEFT JOIN holed USING (event_type, ts))
    SELECT event_type, ts, round(CASE WHEN ts <= TIMESTAMP '2024-01-25' THEN y END, 4) AS y, CAST(n AS DOUBLE) AS n, CASE WHEN ts <= least(TIMESTAMP '2024-01-25', max(CASE WHEN y IS NOT NULL THEN ts END) OVER (PARTITION BY event_type)) THEN 'train' ELSE 'future' END AS stage FROM f""")
def canonical_series(spark: SparkSession, sf: str) -> DataFrame:
    df = holed(spark, sf)
    bad = df.select("event_type").distinct().select("event_type", F.expr("timestamp'2024-01-10'").alias("start_ts"), F.expr("timestamp'2024-01-11'").alias("end_ts"))
    return R.rounded(S.canonical(df, "ts", "v", "D", ["event_type"], ["n"], "2024-01-25", bad), 4)


@query(f"""WITH {DAILY}, s AS (SELECT *, ts <= TIMESTAMP '2024-01-20' AS t FROM daily) SELECT event_type, min(ts) AS start, max(CASE WHEN t THEN ts END) AS train_end, max(ts) AS "end", CAST(count_if(t) AS BIGINT) AS n_train, CAST(count_if(NOT t) AS BIGINT) AS n_future, CAST(86400 AS BIGINT) AS step,
    CAST(least(30, count_if(t) // 2) AS INTEGER) AS horizon FROM s GROUP BY 1""")
def series_properties(spark: SparkSession, sf: str) -> DataFrame:
    return S.time_properties(S.canonical(daily(spark, sf), "ts", "v", "D", ["event_type"], train_end="2024-01-20"), dims=["event_type"])


@query(f"WITH {DAILY}, {HOLED} SELECT * FROM (SELECT event_type, ts, count(*) AS count FROM (SELECT event_type, date_trunc('week', ts) AS ts FROM holed) GROUP BY 1, 2) WHERE count > 1")
def duplicated_weeks(spark: SparkSession, sf: str) -> DataFrame:
    return S.duplicated_times(holed(spark, sf).withColumn("ts", F.date_trunc("week", "ts")), "ts", ["event_type"])


@query(f"""WITH {DAILY}, r AS (SELECT *, (row_number() OVER (PARTITION BY event_type ORDER BY ts DESC) - 1) // 7 AS k FROM daily) SELECT event_type, min(ts) OVER (PARTITION BY event_type, k) AS "group", ts FROM r""")
def group_by_runs(spark: SparkSession, sf: str) -> DataFrame:
    return S.with_group(daily(spark, sf), "ts", rows=7, dims=["event_type"]).select("event_type", "group", "ts")


@query(f"WITH {DAILY}, l AS (SELECT event_type, ts, v AS a, lag(v, 1) OVER w AS b, lag(v, 2) OVER w AS c FROM daily WINDOW w AS (PARTITION BY event_type ORDER BY ts)) SELECT event_type, ts, round((a + coalesce(b, 0) * 0.5 + coalesce(c, 0) * 0.25) / (1 + CASE WHEN b IS NULL THEN 0 ELSE 0.5 END + CASE WHEN c IS NULL THEN 0 ELSE 0.25 END), 4) AS v_smooth FROM l")
def exponential_baseline(spark: SparkSession, sf: str) -> DataFrame:
    return R.rounded(S.exponential_baseline(daily(spark, sf), "ts", "v", 0.5, 3, ["event_type"]).select("event_type", "ts", "v_smooth"), 4)


@query(f"WITH {DAILY} SELECT event_type, ts, round(lag(v, 7) OVER w, 4) AS v_lag7, lag(n, 1) OVER w AS n_lag1, lag(n, 7) OVER w AS n_lag7 FROM daily WINDOW w AS (PARTITION BY event_type ORDER BY ts)")
def lags_by_rows(spark: SparkSession, sf: str) -> DataFrame:
    weekly = T.lag_rows([1], "D", "W")
    return R.rounded(S.lags_of(daily(spark, sf), "ts", {"v": weekly, "n": [1, *weekly]}, ["event_type"]).drop("v", "n"), 4)


@query(f"WITH {DAILY} SELECT event_type, ts, CAST(sum(n) OVER (PARTITION BY event_type, k) AS BIGINT) AS n, round(sum(v) OVER (PARTITION BY event_type, k), 4) AS v FROM (SELECT *, (row_number() OVER (PARTITION BY event_type ORDER BY ts DESC) - 1) // 5 AS k FROM daily) QUALIFY row_number() OVER (PARTITION BY event_type, k ORDER BY ts DESC) = 1 AND count(*) OVER (PARTITION BY event_type, k) = 5")
def sums_of_runs(spark: SparkSession, sf: str) -> DataFrame:
    return R.rounded(E.aggregated(daily(spark, sf), ["n", "v"], 5, "ts", ["event_type"]), 4)


@query(f"WITH {DAILY} SELECT event_type, ts, round(10 + 5 / (1 + exp(-0.5 * (day(ts) - 15))), 6) AS curve FROM daily")
def logistic_curve(spark: SparkSession, sf: str) -> DataFrame:
    return R.rounded(daily(spark, sf).select("event_type", "ts", S.logistic(F.dayofmonth("ts"), 0.5, 5.0, 10.0, 15.0).alias("curve")))


@query(f"""WITH {DAILY}, x AS (SELECT event_type, ts, CASE WHEN day(ts) % 5 <> 0 THEN v END AS v, CASE WHEN day(ts) % 4 <> 0 THEN n * 1.0 END AS n FROM daily), l AS (SELECT *, lag(v, 1) OVER w AS va, lag(v, 7) OVER w AS vb, lag(n, 1) OVER w AS na, lag(n, 7) OVER w AS nb FROM x WINDOW w AS (PARTITION BY event_type ORDER BY ts))
    SELECT event_type, ts, round(coalesce(v, (coalesce(va, 0) + coalesce(vb, 0)) / nullif((va IS NOT NULL)::INT + (vb IS NOT NULL)::INT, 0)), 4) AS v, round(coalesce(n, (coalesce(na, 0) + coalesce(nb, 0)) / nullif((na IS NOT NULL)::INT + (nb IS NOT NULL)::INT, 0)), 4) AS n FROM l""")
def impute_two_columns(spark: SparkSession, sf: str) -> DataFrame:
    d = daily(spark, sf)
    holes = d.withColumn("v", F.when(F.dayofmonth("ts") % 5 != 0, F.col("v"))).withColumn("n", F.when(F.dayofmonth("ts") % 4 != 0, F.col("n").cast("double")))
    return R.rounded(S.impute_columns(holes, "ts", ["v", "n"], [1, 7], dims=["event_type"]), 4)


@query(f"""WITH {DAILY}, z AS (SELECT event_type, ts, coalesce(abs((v - avg(v) OVER p) / nullif(stddev_pop(v) OVER p, 0)) > 1.2, false) AS f FROM daily WINDOW p AS (PARTITION BY event_type)),
    r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts) - row_number() OVER (PARTITION BY event_type, f ORDER BY ts) AS k FROM z) SELECT event_type, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n FROM r WHERE f GROUP BY event_type, k""")
def outlier_runs(spark: SparkSession, sf: str) -> DataFrame:
    return S.outlier_intervals(daily(spark, sf), "ts", "v", 1.2, 0.0, ["event_type"])


# forecasts


@query(f"WITH {DAILY}, f AS (SELECT event_type, max(ts) AS last, max(CASE WHEN r = 1 THEN v END) AS a, max(CASE WHEN r = 2 THEN v END) AS b FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC) AS r FROM daily) GROUP BY 1), s AS (SELECT event_type, last, a, b, (a + b) / 2 AS f1 FROM f), t AS (SELECT *, (f1 + a) / 2 AS f2 FROM s) SELECT event_type, last + INTERVAL 1 DAY AS ts, 1 AS horizon_step, round(f1, 4) AS forecast FROM t UNION ALL SELECT event_type, last + INTERVAL 2 DAY, 2, round(f2, 4) FROM t UNION ALL SELECT event_type, last + INTERVAL 3 DAY, 3, round((f1 + f2) / 2, 4) FROM t")
def forecast_recursive_lags(spark: SparkSession, sf: str) -> DataFrame:
    return R.rounded(FC.recursive_lags(daily(spark, sf), "ts", "v", "D", [1, 2], 3, dims=["event_type"]), 4)


@query(f"WITH {DAILY} SELECT event_type, ts, round(v - 1.959963984540054 * sqrt(n), 4) AS lower, round(v + 1.959963984540054 * sqrt(n), 4) AS upper FROM daily")
def normal_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    out = FC.normal_quantiles(daily(spark, sf).withColumn("sd", F.sqrt("n")), "sd", "v")
    return R.rounded(out.select("event_type", "ts", F.get("normal_quantiles", F.lit(0)).alias("lower"), F.get("normal_quantiles", F.lit(1)).alias("upper")), 4)


@query(f"WITH {DAILY}, m AS (SELECT event_type, avg(v) AS m FROM daily GROUP BY 1), q AS (SELECT event_type, ts, lag(v) OVER (PARTITION BY event_type ORDER BY ts) AS f FROM daily) SELECT d.event_type, d.ts, round(v, 4) AS v, round(m, 4) AS forecast_0, round(f, 4) AS forecast_1 FROM daily d JOIN m USING (event_type) JOIN q ON q.event_type = d.event_type AND q.ts = d.ts")
def data_with_forecasts(spark: SparkSession, sf: str) -> DataFrame:
    d = daily(spark, sf)
    flat = d.join(FC.null_model(d, "v", dims=["event_type"]), "event_type").select("event_type", "ts", "forecast")
    naive = S.lags(d, "ts", "v", [1], ["event_type"]).select("event_type", "ts", F.col("v_lag1").alias("forecast"))
    return R.rounded(FC.with_forecasts(d.drop("n"), [flat, naive], ["event_type", "ts"], ["forecast"]), 4)


@query(f"WITH {DAILY}, f AS (SELECT event_type, max(ts) AS last FROM daily GROUP BY 1), t AS (SELECT * FROM daily WHERE day(ts) BETWEEN 5 AND 20 AND day(ts) <> 12), e AS (SELECT event_type, min(ts) AS a, max(ts) AS b FROM t GROUP BY 1) SELECT d.event_type, d.ts, CASE WHEN d.ts > b THEN 'after' WHEN d.ts < a THEN 'before' WHEN t.ts IS NOT NULL THEN 'within' ELSE 'gap' END AS part FROM daily d JOIN e USING (event_type) LEFT JOIN t ON t.event_type = d.event_type AND t.ts = d.ts")
def partition_future(spark: SparkSession, sf: str) -> DataFrame:
    d = daily(spark, sf)
    train = d.where("dayofmonth(ts) between 5 and 20 and dayofmonth(ts) <> 12")
    return FC.partition_future(d, train, "ts", ["event_type"]).select("event_type", "ts", "part")


@query(f"""WITH {DAILY}, e AS (SELECT ts, sum(CASE WHEN event_type = 'view' THEN v * 0.1 END) AS a, sum(CASE WHEN event_type = 'click' THEN n * 1.0 END) AS b, sum(CASE WHEN event_type = 'view' THEN n * 0.5 ELSE 0 END) - sum(CASE WHEN event_type = 'click' THEN v * 0.2 ELSE 0 END) AS c FROM daily WHERE event_type IN ('view', 'click') GROUP BY 1)
    SELECT 'view' AS a, 'view' AS b, round(covar_samp(a, a), 4) AS covariance FROM e UNION ALL SELECT 'view', 'click', round(covar_samp(a, b), 4) FROM e UNION ALL SELECT 'view', 'both', round(covar_samp(a, c), 4) FROM e UNION ALL SELECT 'click', 'view', round(covar_samp(a, b), 4) FROM e
    UNION ALL SELECT 'click', 'click', round(covar_samp(b, b), 4) FROM e UNION ALL SELECT 'click', 'both', round(covar_samp(b, c), 4) FROM e UNION ALL SELECT 'both', 'view', round(covar_samp(a, c), 4) FROM e UNION ALL SELECT 'both', 'click', round(covar_samp(b, c), 4) FROM e UNION ALL SELECT 'both', 'both', round(covar_samp(c, c), 4) FROM e""")
def error_covariance(spark: SparkSession, sf: str) -> DataFrame:
    nodes = ["view", "click", "both"]
    cov = FC.error_covariance(_errors(spark, sf), nodes, "ts")
    return spark.createDataFrame([(a, b, round(cov[i][j], 4)) for i, a in enumerate(nodes) for j, b in enumerate(nodes)], "a string, b string, covariance double")


def _errors(spark: SparkSession, sf: str) -> DataFrame:
    d = daily(spark, sf).where("event_type in ('view', 'click')")
    one = F.when(F.col("event_type") == "view", F.col("v") * 0.1).otherwise(F.col("n") * 1.0)
    both = F.sum(F.when(F.col("event_type") == "view", F.col("n") * 0.5).otherwise(-F.col("v") * 0.2))
    leaves = d.select("ts", F.col("event_type").alias("node"), one.alias("actual"), F.lit(0.0).alias("forecast"))
    return leaves.unionByName(d.groupBy("ts").agg(both.alias("actual")).select("ts", F.lit("both").alias("node"), "actual", F.lit(0.0).alias("forecast")))


# evaluation, detection, selection


@query(f"""WITH {LINES} SELECT g, round(avg(actual - forecast), 6) AS residual, round(max(abs(actual - forecast)), 6) AS absolute_error, round(sqrt(avg((actual - forecast) ** 2)), 6) AS squared_error, round(median(abs(actual - forecast) / abs(actual)), 6) AS absolute_percent_error,
    round(avg(CASE WHEN abs(actual - forecast) > 0.05 * abs(actual) THEN 1.0 ELSE 0.0 END), 6) AS outside_tolerance_5p, round(avg(CASE WHEN actual > forecast - 12 AND actual < forecast + 12 THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM p GROUP BY 1""")
def elementwise_by_group(spark: SparkSession, sf: str) -> DataFrame:
    rows = E.elementwise(*(F.col(c) for c in ("actual", "forecast", "forecast_lower", "forecast_upper")))
    aggs = {"residual": F.avg, "absolute_error": F.max, "squared_error": lambda c: F.sqrt(F.avg(c)), "absolute_percent_error": F.median, "outside_tolerance_5p": F.avg, "coverage": F.avg}
    return R.rounded(E.evaluate_groups(_lines(spark, sf), ["g"], rows, aggs))


@query(f"WITH {LINES} SELECT g, round(1 - sum((actual - forecast) ** 2) / sum((actual - 25) ** 2), 6) AS r2_null_model FROM p GROUP BY 1")
def r2_null_model(spark: SparkSession, sf: str) -> DataFrame:
    return R.rounded(E.r2_null_model(_lines(spark, sf).withColumn("null_forecast", F.lit(25.0)), "actual", "forecast", "null_forecast", ["g"]))


@query(f"WITH {_AD}, c AS (SELECT event_type, CAST(count_if(t AND p) AS BIGINT) AS tp, CAST(count_if(NOT t AND p) AS BIGINT) AS fp, CAST(count_if(t AND NOT p) AS BIGINT) AS fn, CAST(count_if(NOT t AND NOT p) AS BIGINT) AS tn FROM a GROUP BY 1) SELECT *, round(tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0) - 1, 6) AS informedness FROM c")
def confusion_informedness(spark: SparkSession, sf: str) -> DataFrame:
    return R.rounded(E.confusion(_flags(spark, sf), by=["event_type"]))


_RANGES = """t AS (SELECT DISTINCT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS a, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) + 7000 AS b FROM events WHERE value > 90), p AS (SELECT DISTINCT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) + 3000 AS a, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) + 6000 AS b FROM events WHERE value > 80 AND event_type = 'click')"""


@query(f"""WITH {_RANGES}, x AS (SELECT p.a, p.b, sum(CASE WHEN t.a IS NULL THEN 0 ELSE least(p.b, t.b) - greatest(p.a, t.a) + 1 END) AS o, count(t.a) AS k FROM p LEFT JOIN t ON p.a <= t.b AND t.a <= p.b GROUP BY 1, 2),
    y AS (SELECT t.a, t.b, sum(CASE WHEN p.a IS NULL THEN 0 ELSE least(p.b, t.b) - greatest(p.a, t.a) + 1 END) AS o, count(p.a) AS k FROM t LEFT JOIN p ON p.a <= t.b AND t.a <= p.b GROUP BY 1, 2)
    SELECT (SELECT round(avg(0.5 * CASE WHEN k > 0 THEN 1 ELSE 0 END + 0.5 * least(o / (b - a + 1), 1)), 6) FROM x) AS precision, (SELECT round(avg(0.5 * CASE WHEN k > 0 THEN 1 ELSE 0 END + 0.5 * least(o / (b - a + 1), 1)), 6) FROM y) AS recall""")
def range_precision_recall(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events")
    at = F.date_trunc("hour", "ts").cast("long")
    span = lambda df, a, b: df.select(F.timestamp_seconds(at + a).alias("start_ts"), F.timestamp_seconds(at + b).alias("end_ts"))
    return R.rounded(E.range_scores(span(e.where("value > 90"), 0, 7000), span(e.where("value > 80 and event_type = 'click'"), 3000, 6000)))


@query(f"""WITH {DAILY}, m AS (SELECT event_type, avg(v) AS m FROM daily GROUP BY 1), c AS (SELECT event_type, avg(abs(v - m)) AS e0, avg(abs(v - n)) AS e1 FROM daily JOIN m USING (event_type) GROUP BY 1)
    SELECT event_type, CASE WHEN e0 <= e1 THEN 'flat' ELSE 'n' END AS best, round(least(e0, e1), 4) AS mae FROM c""")
def best_of_forecasts(spark: SparkSession, sf: str) -> DataFrame:
    d = daily(spark, sf)
    flat = d.join(FC.null_model(d, "v", dims=["event_type"]).withColumnRenamed("forecast", "flat"), "event_type")
    return R.rounded(E.best_forecast(flat, ["flat", "n"], "v", ["event_type"]), 4)


@query(f"""WITH {_AD}, s AS (SELECT k AS parameter, count_if(e.value > k AND a.t) / nullif(count_if(a.t), 0) AS recall, count_if(e.value > k AND a.t) / nullif(count_if(e.value > k), 0) AS precision FROM a JOIN events e USING (event_id), (VALUES (30.0), (45.0), (60.0)) v(k) GROUP BY 1)
    SELECT CAST(parameter AS DOUBLE) AS parameter, round(CASE WHEN precision < 0.9 THEN -1 ELSE recall END + 0.5 * precision, 6) AS reward FROM s""")
def reward_ranking(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events").crossJoin(F.broadcast(spark.createDataFrame([(30.0,), (45.0,), (60.0,)], "parameter double")))
    hit, true = F.col("value") > F.col("parameter"), F.col("value") > 40
    s = e.groupBy("parameter").agg((F.count_if(hit & true) / F.count_if(true)).alias("recall"), (F.count_if(hit & true) / F.count_if(hit)).alias("precision"))
    recall, precision = W.Reward.of("recall"), W.Reward.of("precision")
    low = (precision.penalized(least=0.9, penalty=float("-inf")) - precision)
    reward = W.Reward(lambda: F.when(low.column() < 0, -1.0).otherwise(recall.column())) + 0.5 * precision
    return R.rounded(W.ranked(s, reward).select("parameter", "reward"))


@query(f"""WITH {DAILY}, {_I}, {BACK}, a AS (SELECT 'seasonal' AS candidate_id, event_type, actual, forecast FROM e UNION ALL SELECT 'half', event_type, actual, forecast / 2 FROM e), m AS (SELECT candidate_id, event_type, avg(abs(actual - forecast)) AS mae FROM a WHERE actual IS NOT NULL AND forecast IS NOT NULL GROUP BY 1, 2)
    SELECT candidate_id, round(avg(mae), 4) AS score FROM m GROUP BY 1""")
def stored_candidates_rescored(spark: SparkSession, sf: str) -> DataFrame:
    made = _backfilled(spark, sf)
    both = made.withColumn("candidate_id", F.lit("seasonal")).unionByName(made.withColumn("candidate_id", F.lit("half")).withColumn("forecast", F.col("forecast") / 2))
    return R.rounded(L.rescore(both, ["event_type"], tie=["cutoff", "ts"]), 4)


@query(f"""WITH {DAILY}, w AS (SELECT ts, max(CASE WHEN event_type = 'view' THEN round(v, 4) END) AS "view", max(CASE WHEN event_type = 'click' THEN round(v, 4) END) AS click FROM daily GROUP BY 1) SELECT * FROM w""")
def wide_by_group(spark: SparkSession, sf: str) -> DataFrame:
    return M.wide(R.rounded(daily(spark, sf), 4), "ts", "event_type", "v", ["view", "click"])


@query("""WITH c AS (SELECT DISTINCT CAST(o_orderdate AS DATE) - CAST(o_orderkey % 9 AS INTEGER) AS last_training_date FROM orders) SELECT last_training_date FROM c WHERE last_training_date >= (SELECT max(last_training_date) FROM c) - 30""")
def training_cutoffs(spark: SparkSession, sf: str) -> DataFrame:
    from .forecasts import _parts

    return E.training_cutoffs(_parts(spark, sf), lookback_days=30)


@query("""WITH s AS (SELECT user_id, list(event_type ORDER BY ts, event_id) AS e FROM events GROUP BY 1), c AS (SELECT user_id % 8 AS d, e[1] AS s1, e[2] AS s2, count(*) AS n FROM s GROUP BY 1, 2, 3),
    t AS (SELECT d FROM c GROUP BY 1 ORDER BY sum(n) DESC, d LIMIT 3)
    SELECT CASE WHEN d IN (SELECT d FROM t) THEN CAST(d AS VARCHAR) ELSE 'Others' END AS d, coalesce(s1, 'end') AS s1, coalesce(s2, 'end') AS s2, CAST(sum(n) AS BIGINT) AS seq_count FROM c GROUP BY 1, 2, 3""")
def sunburst_counts(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events").select("user_id", F.col("ts").alias("time"), F.col("event_type").alias("event"), F.col("event_id").alias("tie"))
    seq = J.undeduped(e, ["user_id"]).withColumn("d", (F.col("user_id") % 8).cast("string"))
    counts = J.count_sequences(seq, 2, by=["d"])
    return J.sunburst(counts, 2, ["d"], 3)


@query(f"WITH {KEPT} SELECT g, round(avg(CASE WHEN abs(forecast - actual) > 0.3 * abs(actual) THEN 1.0 ELSE 0.0 END), 6) AS outside FROM p GROUP BY 1")
def outside_tolerance(spark: SparkSession, sf: str) -> DataFrame:
    return R.rounded(_lines(spark, sf).groupBy("g").agg(E.fraction_outside_tolerance(F.col("actual"), F.col("forecast"), 0.3).alias("outside")))


@query("""WITH f AS (SELECT p_partkey, p_retailprice, p_size FROM part), a AS (SELECT p_partkey, p_retailprice AS score, p_size AS is_low FROM f) SELECT p_partkey, p_size, round(p_retailprice, 2) AS p_retailprice0, round(p_retailprice * 2, 2) AS p_retailprice1 FROM part""")
def frames_side_by_side(spark: SparkSession, sf: str) -> DataFrame:
    p = load(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    return R.rounded(R.side_by_side([p, p.withColumn("p_retailprice", F.col("p_retailprice") * 2)], ["p_partkey"], ["p_retailprice"], ["p_size"]), 2)


@query(f"WITH {MONTHLY}, t AS (SELECT ts, v, lag(v, 12) OVER (ORDER BY ts) AS p FROM monthly) SELECT ts, round(v, 2) AS v, round(p, 2) AS v_lag12 FROM t")
def monthly_lags(spark: SparkSession, sf: str) -> DataFrame:
    m = load(spark, sf, "orders").groupBy(F.date_trunc("month", "o_orderdate").alias("ts")).agg(F.sum("o_totalprice").alias("v"))
    return R.rounded(S.lags(m, "ts", "v", T.lag_rows([12], "M", "M")), 2)
