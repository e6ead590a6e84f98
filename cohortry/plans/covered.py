"""Queries of operators that write tables, and of those that no other query runs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import time as T
from ..operators import evaluation as E
from ..operators import experiments as X
from ..operators import forecast as FC
from ..operators import reconcile as Q
from ..operators import metrics as M
from ..operators import regression as G
from ..operators import relational as R
from ..operators import rewards as W
from ..operators import selection as L
from ..operators import series as S
from ..operators import transforms as N
from ..operators.flow import Flow
from ..sources import tables as K
from ..specs import Metric, MetricSource, UnitMetric, consistent, unique_unit_metrics
from .experiments import STATS, joined, merged_sql
from .forecasts import Z95, _I, _seasonal
from .linear import solved
from .registry import load, query
from .series import DAILY, daily


def _folder(spark: SparkSession) -> str:
    """A new folder that all executors see: the cluster's shared one, or a temporary one on one machine."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="cohortry-")
    return f"{at.rstrip('/')}/sink-{uuid.uuid4().hex}"


def _scratch(spark: SparkSession) -> str:
    """A new database in such a folder."""
    name = f"scratch_{uuid.uuid4().hex[:12]}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{_folder(spark)}'")
    return name


# sinks: written, changed, and read back


@query("SELECT CASE WHEN o_orderstatus = 'F' THEN 'F' ELSE o_orderstatus END AS status, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus <> 'F' OR o_totalprice > 100000 GROUP BY 1")
def sink_overwrite_partition(spark: SparkSession, sf: str) -> DataFrame:
    """Orders by status, one partition each; one is then put in place anew, the others stay."""
    o = load(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    name = f"{_scratch(spark)}.orders_by_status"
    for status in ("F", "O", "P", "F"):
        own = o.where(F.col("o_orderstatus") == status)
        K.overwrite_partition(own, name, "status", status) if not spark.catalog.tableExists(name) or status != "F" else K.overwrite_partition(own.where("o_totalprice > 100000"), name, "status", status)
    return spark.table(name).groupBy("status").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""WITH n AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'MOVED' ELSE c_mktsegment END AS segment, c_nationkey % 3 AS part FROM customer UNION ALL SELECT -c_custkey, 'NEW', c_nationkey % 3 FROM customer WHERE c_custkey % 5 = 0 AND c_custkey % 2 = 0)
    SELECT CAST(part AS INTEGER) AS part, segment, count(*) AS n FROM n GROUP BY 1, 2""")
def sink_upsert_partitions(spark: SparkSession, sf: str) -> DataFrame:
    """Customers in parts; rows with known keys take the place of old ones, rows with new keys come in, in the parts that they touch."""
    c = load(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"), (F.col("c_nationkey") % 3).cast("int").alias("part"))
    name = f"{_scratch(spark)}.customers"
    c.write.partitionBy("part").saveAsTable(name)
    some = c.where("c_custkey % 5 = 0")
    new = some.withColumn("segment", F.lit("MOVED")).union(some.where("c_custkey % 2 = 0").select(-F.col("c_custkey"), F.lit("NEW"), "part"))
    K.upsert_table(new, name, ["c_custkey", "part"], "part")
    return spark.table(name).groupBy("part", "segment").agg(F.count("*").alias("n"))


@query("SELECT s_nationkey, count(*) AS n, round(sum(s_acctbal + 1), 2) AS total FROM supplier GROUP BY 1")
def sink_upsert_whole(spark: SparkSession, sf: str) -> DataFrame:
    """All suppliers' balances raised by an upsert of a table without partitions."""
    s = load(spark, sf, "supplier").select("s_suppkey", "s_nationkey", F.col("s_acctbal").cast("double").alias("s_acctbal"))
    name = f"{_scratch(spark)}.suppliers"
    s.write.saveAsTable(name)
    K.upsert_table(s.withColumn("s_acctbal", F.col("s_acctbal") + 1), name, ["s_suppkey"])
    return spark.table(name).groupBy("s_nationkey").agg(F.count("*").alias("n"), F.round(F.sum("s_acctbal"), 2).alias("total"))


@query("""SELECT 'overwrite' AS kind, count(*) AS n, min(p_size) AS least FROM part WHERE p_size > 20 UNION ALL SELECT 'if_absent', count(*), min(p_size) FROM part WHERE p_size > 20
    UNION ALL SELECT 'temp_view', count(*), min(p_size) FROM part WHERE p_size > 30 UNION ALL SELECT 'incremental', count(*), min(p_size) FROM part WHERE p_size > 40 OR p_size <= 10""")
def sink_materializations(spark: SparkSession, sf: str) -> DataFrame:
    """Each way to keep a relation: rebuilt, made only where absent, as a view, by partition."""
    p, db = load(spark, sf, "part").select("p_partkey", "p_size"), _scratch(spark)
    above = lambda k: p.where(F.col("p_size") > k)
    K.Materialization().apply(above(5), f"{db}.whole")
    kept = {"overwrite": K.Materialization().apply(above(20), f"{db}.whole"), "if_absent": K.Materialization("if_absent").apply(above(40), f"{db}.whole")}
    kept["temp_view"] = K.Materialization("temp_view").apply(above(30), f"view_{db}")
    for day, rows in (("a", above(30)), ("b", p.where("p_size <= 10")), ("a", above(40))):
        kept["incremental"] = K.Materialization("incremental", "day", day).apply(rows, f"{db}.days")
    return R.union([df.agg(F.count("*").alias("n"), F.min("p_size").alias("least")).select(F.lit(k).alias("kind"), "n", "least") for k, df in kept.items()])


@query("SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS total, min(c_name) AS least FROM customer GROUP BY 1")
def sink_csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Customers written as CSV and read back with a schema."""
    c = load(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment", F.col("c_acctbal").cast("double").alias("c_acctbal"))
    path = _folder(spark)
    c.write.option("header", "true").csv(path)
    return K.read_csv(spark, path, c.schema).groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"), F.min("c_name").alias("least"))


@query("SELECT event_type, CAST(day(ts) AS INTEGER) AS day, count(*) AS n FROM events WHERE day(ts) IN (3, 4) GROUP BY 1, 2")
def sink_append_days(spark: SparkSession, sf: str) -> DataFrame:
    """Days of events appended to a table one by one, each with its own partition value."""
    e, name = load(spark, sf, "events").select("event_id", "event_type", "ts"), f"{_scratch(spark)}.event_days"
    for day in (3, 4):
        K.write_table(e.where(F.dayofmonth("ts") == day), name, partition=("day", day))
    return spark.table(name).groupBy("event_type", F.col("day").cast("int").alias("day")).agg(F.count("*").alias("n"))


@query("SELECT r_name, count(*) AS nations FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def local_frame_joined(spark: SparkSession, sf: str) -> DataFrame:
    """A small local frame (the regions) with a schema from its column types, joined with a relation."""
    r = K.from_pandas(spark, load(spark, sf, "region").select("r_regionkey", "r_name").toPandas())
    n = load(spark, sf, "nation")
    return n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.count("*").alias("nations"))


# times


@query("""WITH y AS (SELECT DISTINCT date_trunc('hour', ts) + to_days(CAST(30 * k AS INTEGER)) AS t FROM events, range(12) r(k)), o AS (SELECT t, date_diff('minute', t, timezone('America/New_York', timezone('UTC', t))) AS o,
        date_diff('minute', date_trunc('year', t), timezone('America/New_York', timezone('UTC', date_trunc('year', t)))) AS a, date_diff('minute', date_trunc('year', t) + INTERVAL 6 MONTH, timezone('America/New_York', timezone('UTC', date_trunc('year', t) + INTERVAL 6 MONTH))) AS b FROM y)
    SELECT month(t)::INTEGER AS month, count(*) AS n, count_if(o > least(a, b))::BIGINT AS dst FROM o GROUP BY 1""")
def daylight_saving(spark: SparkSession, sf: str) -> DataFrame:
    """Which hours of events, moved through the year, have daylight saving time."""
    t = load(spark, sf, "events").select(F.date_trunc("hour", "ts").alias("h")).distinct().select(F.explode(F.sequence(F.lit(0), F.lit(11))).alias("k"), "h").select((F.col("h") + F.make_dt_interval(30 * F.col("k"))).alias("t")).distinct()
    return t.groupBy(F.month("t").alias("month")).agg(F.count("*").alias("n"), F.count_if(T.is_dst(F.col("t"), "America/New_York")).alias("dst"))


@query("SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12' GROUP BY 1")
def events_of_a_window(spark: SparkSession, sf: str) -> DataFrame:
    """Events of the seven days from a partition date on."""
    end = T.window_end("2024-01-05", 7)
    return load(spark, sf, "events").where((F.col("ts") >= "2024-01-05") & (F.col("ts") < end)).groupBy("event_type").agg(F.count("*").alias("n"))


@query(f"""WITH {DAILY}, h AS (SELECT DISTINCT CAST(ts AS DATE) AS d, 'error day' AS label FROM daily WHERE event_type = 'error' AND n > 100), c AS (SELECT event_type, coalesce(label, 'usual') AS label, v FROM daily LEFT JOIN h ON CAST(ts AS DATE) = d)
    SELECT event_type, label, count(*) AS days, round(sum(v), 4) AS v FROM c GROUP BY 1, 2""")
def daily_events(spark: SparkSession, sf: str) -> DataFrame:
    """Days with many errors as events of the other series."""
    d = daily(spark, sf)
    events = d.where("event_type = 'error' AND n > 100").select("ts", F.lit("error day").alias("label"))
    return R.rounded(S.add_events(d, events, "ts", "ts", "label", "usual").groupBy("event_type", "label").agg(F.count("*").alias("days"), F.sum("v").alias("v")), 4)


# frames


@query("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")
def constant_columns_dropped(spark: SparkSession, sf: str) -> DataFrame:
    """Columns of one value go, those with more stay; what a query needs is there."""
    n = load(spark, sf, "nation").withColumn("one", F.lit(1)).withColumn("none", F.lit(None).cast("string"))
    out = R.require(R.drop_constant(n, ["n_regionkey", "one", "none"]), ["n_regionkey"])
    if {"one", "none"} & set(out.columns) or R.sample(out, 0).count() or R.sample(out, 3).count() != 3:
        raise AssertionError(out.columns)
    return out.groupBy("n_regionkey").agg(F.count("*").alias("n"))


@query("""SELECT "column", CAST(n AS BIGINT) AS n FROM (SELECT 'l_discount' AS "column", count(DISTINCT l_discount) AS n FROM lineitem UNION ALL SELECT 'l_tax', count(DISTINCT l_tax) FROM lineitem)""")
def matching_columns(spark: SparkSession, sf: str) -> DataFrame:
    """How many values the columns have whose names match a pattern."""
    li = load(spark, sf, "lineitem")
    names = M.matching(li.columns, include="^l_(disc|tax)")
    one = li.agg(*[F.count_distinct(n).alias(n) for n in names])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("column"), F.col(n).alias("n")) for n in names])).alias("x")).select("x.*")


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2")
def grouped_by_series_columns(spark: SparkSession, sf: str) -> DataFrame:
    """A frame grouped by those of its columns that name a series."""
    f = load(spark, sf, "orders").select(F.col("o_orderdate").alias("ts"), "o_orderstatus", "o_orderpriority", F.col("o_totalprice").alias("forecast"), F.lit("fitted").alias("stage"))
    return f.groupBy(*FC.grouping_columns(f)).agg(F.count("*").alias("n"))


@query("SELECT o_custkey AS unit, round(sum(o_totalprice), 2) AS revenue, count(o_orderkey) AS n FROM orders GROUP BY 1")
def repeated_unit_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics that are asked for twice are made once."""
    asked = (UnitMetric("o_totalprice", "SUM", "revenue"), UnitMetric("o_orderkey", "COUNT", "n"), UnitMetric("o_totalprice", "SUM", "revenue"))
    source = MetricSource("orders", "o_custkey", unique_unit_metrics(asked), (Metric("revenue"),))
    out = M.unit_metrics(load(spark, sf, "orders"), source, dims=())
    return out.select(F.col("o_custkey").alias("unit"), F.round("revenue", 2).alias("revenue"), "n")


# experiments


@query(f"WITH {merged_sql(3)} SELECT variant, count(*) AS n FROM merged WHERE variant_1 = 'v1' AND variant_3 = 'control' GROUP BY 1")
def consistent_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Units of the variants that match a pattern, whatever the second arm."""
    counts = X.variant_counts(joined(spark, sf, 3))
    fits = [v for (v,) in counts.select("variant").collect() if consistent(v, ("v1", None, "control"))]  # as many as there are variants
    shown = X.shown(F.col("variant"))
    return counts.where(shown.isin(["|".join(v) for v in fits])).select(shown.alias("variant"), F.col("variant_count").alias("n"))


@query(f"""WITH {STATS}, m AS (SELECT variant, 'revenue' AS metric, n, s1 / n AS mean FROM s UNION ALL SELECT variant, 'twice', n, 2 * s1 / n FROM s) SELECT variant, metric, n AS sample_count, round(mean, 3) AS mean FROM m""")
def combined_analyses(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics of two analyses as one."""
    df = joined(spark, sf, 3).withColumn("twice", 2 * F.col("revenue"))
    parts = [X.Analysis(s := X.variant_stats(df, [c]), s.select("metric").distinct()) for c in ("revenue", "twice")]
    out = parts[0].combined(parts[1])
    return out.variant_stats.select(X.shown(F.col("variant")).alias("variant"), "metric", "sample_count", F.round("mean", 3).alias("mean"))


# forecasts


@query(f"""WITH {DAILY}, {_I}, {_seasonal(7)} SELECT event_type, ts, round(actual, 4) AS actual, round(forecast, 4) AS forecast, coalesce(actual < forecast - {Z95} * std OR actual > forecast + {Z95} * std, false) AS is_anomaly_predicted, 'total' AS metric_id FROM f WHERE stage = 'fitted'""")
def flow_detection(spark: SparkSession, sf: str) -> DataFrame:
    """A flow from events to flagged days: series by type, seasonal means, bounds."""
    source = MetricSource("events", "user_id", (UnitMetric("value", "SUM", "total"),), (Metric("total"),), dims=("event_type",))
    out = Flow(source, "total", "ts", params={"period": 7, "k": 3}).detect(load(spark, sf, "events"))
    return R.rounded(out.select("event_type", "ts", "actual", "forecast", "is_anomaly_predicted", "metric_id"), 4)


@query(f"""WITH {DAILY}, m AS (SELECT *, avg(v) OVER (PARTITION BY event_type, date_trunc('week', ts)) AS level FROM daily), w AS (SELECT *, avg(v - level) OVER (PARTITION BY event_type, isodow(ts)) AS rest FROM m)
    SELECT event_type, ts, round(level + rest, 4) AS forecast FROM w""")
def multistage_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Means of weeks, and of weekdays in what they leave, added up."""
    def coarse(d: DataFrame, dims) -> DataFrame:
        return d.select(*dims, "ts", F.lit("fitted").alias("stage"), F.col("v").alias("forecast"))

    def fine(d: DataFrame, dims) -> DataFrame:
        rows = d.withColumn("dow", F.dayofweek("ts"))
        return rows.join(rows.groupBy(*dims, "dow").agg(F.avg("v").alias("forecast")), [*dims, "dow"]).select(*dims, "ts", F.lit("fitted").alias("stage"), "forecast")

    out = FC.multistage(daily(spark, sf).select("event_type", "ts", "v"), "ts", "v", "week", coarse, fine, ["event_type"])
    return R.rounded(out.select("event_type", "ts", "forecast"), 4)


@query(f"""WITH {DAILY}, l AS (SELECT event_type, max(ts) AS last FROM daily GROUP BY 1), p AS (SELECT event_type, h, avg(v) AS forecast, last FROM daily JOIN l USING (event_type), range(1, 4) r(h) WHERE date_diff('day', ts, last) < 7 * h GROUP BY ALL)
    SELECT event_type, last + to_days(CAST(h AS INTEGER)) AS ts, CAST(h AS INTEGER) AS horizon_step, round(forecast, 4) AS forecast FROM p""")
def one_by_one_forecast(spark: SparkSession, sf: str) -> DataFrame:
    """The first step from the mean of one week, the second from two, the third from three."""
    def mean_of(days: int):
        def run(d: DataFrame, dims) -> DataFrame:
            last = d.groupBy(*dims).agg(F.max("ts").alias("last"))
            level = d.join(last, list(dims)).where(F.date_diff("last", "ts") < days).groupBy(*dims, "last").agg(F.avg("v").alias("forecast"))
            return level.select(*dims, F.explode(F.sequence(F.lit(1), F.lit(3))).alias("h"), "last", "forecast").select(*dims, (F.col("last") + F.make_dt_interval("h")).alias("ts"), F.lit("forecast").alias("stage"), "forecast")

        return run

    out = FC.one_by_one(daily(spark, sf), [mean_of(7), mean_of(14), mean_of(21)], dims=["event_type"])
    return R.rounded(out.select("event_type", "ts", "horizon_step", "forecast"), 4)


@query(f"""WITH {DAILY}, d AS (SELECT ts, sum(CASE WHEN event_type = 'view' THEN v END) AS v, sum(CASE WHEN event_type = 'click' THEN v END) AS c FROM daily GROUP BY 1), e AS (SELECT ts, v - 1.2 * v AS ev, c - 0.9 * c AS ec, (v + c) - (v + c + 10 * (day(ts) % 3)) AS et, 1.2 * v AS fv, 0.9 * c AS fc, v + c + 10 * (day(ts) % 3) AS ft FROM d),
    k AS (SELECT covar_samp(ev, ev) AS vv, covar_samp(ec, ec) AS cc, covar_samp(et, et) AS tt, covar_samp(ev, ec) AS vc, covar_samp(ev, et) AS vt, covar_samp(ec, et) AS ct FROM e),
    g AS (SELECT tt + vv + cc - 2 * vt - 2 * ct + 2 * vc AS q, vt - vv - vc AS wv, ct - vc - cc AS wc, tt - vt - ct AS wt FROM k), r AS (SELECT ts, fv - wv / q * (ft - fv - fc) AS v, fc - wc / q * (ft - fv - fc) AS c, ft - wt / q * (ft - fv - fc) AS t FROM e, g)
    SELECT ts, 'view' AS node, round(v, 3) AS forecast FROM r UNION ALL SELECT ts, 'click', round(c, 3) FROM r UNION ALL SELECT ts, 'both', round(t, 3) FROM r""")
def reconcile_by_error_covariance(spark: SparkSession, sf: str) -> DataFrame:
    """Forecasts of two leaves and their sum, reconciled by the covariance of their errors."""
    d = daily(spark, sf).where("event_type in ('view', 'click')")
    leaves = d.select("ts", F.col("event_type").alias("node"), F.col("v").alias("actual"), F.when(F.col("event_type") == "view", F.col("v") * 1.2).otherwise(F.col("v") * 0.9).alias("forecast"))
    both = d.groupBy("ts").agg(F.sum("v").alias("actual")).select("ts", F.lit("both").alias("node"), "actual", (F.col("actual") + 10 * (F.dayofmonth("ts") % 3)).alias("forecast"))
    every = leaves.unionByName(both)
    out = FC.reconcile_mint(every.select("ts", "node", "forecast"), every, ["view", "click", "both"], ["view", "click"], {"both": ["view", "click"]}, "ts")
    return R.rounded(out, 3)


# choosing detectors

_TRIED = "t AS (SELECT k AS parameter, count_if(value > k AND value > 40) / count_if(value > 40) AS recall, count_if(value > k AND value > 40) / count_if(value > k) AS precision, 100.0 * count_if(value > k) / count(*) AS anomaly_percent FROM events, (VALUES (30.0), (38.0), (45.0), (60.0)) v(k) GROUP BY 1)"


def _tried(df: DataFrame) -> DataFrame:
    hit, true = F.col("value") > F.col("parameter"), F.col("value") > 40
    return df.groupBy("parameter").agg((F.count_if(hit & true) / F.count_if(true)).alias("recall"), (F.count_if(hit & true) / F.count_if(hit)).alias("precision"), (100.0 * F.count_if(hit) / F.count("*")).alias("anomaly_percent"))


@query(f"WITH {_TRIED} SELECT CAST(parameter AS DOUBLE) AS parameter, round(recall, 6) AS recall, round(precision, 6) AS precision FROM t ORDER BY precision >= 0.9 DESC, CASE WHEN precision >= 0.9 THEN recall END DESC, precision DESC LIMIT 1")
def best_threshold(spark: SparkSession, sf: str) -> DataFrame:
    """The threshold of most recall among those of enough precision."""
    found = L.best_parameter(load(spark, sf, "events"), (30.0, 38.0, 45.0, 60.0), "recall", "precision", 0.9, _tried)
    return R.rounded(found.select("parameter", "recall", "precision"))


@query(f"""WITH {_TRIED} SELECT CAST(parameter AS DOUBLE) AS parameter, precision >= 0.9 AS allowed, CASE WHEN precision >= 0.9 THEN round(recall - abs(anomaly_percent - 50) / 100, 6) END AS reward,
    CAST(row_number() OVER (ORDER BY CASE WHEN precision >= 0.9 THEN recall - abs(anomaly_percent - 50) / 100 END DESC NULLS LAST, parameter) AS INTEGER) AS rank FROM t""")
def reward_from_settings(spark: SparkSession, sf: str) -> DataFrame:
    """Thresholds ranked by recall and by how near half of all is flagged; too little precision bars them (minus infinity)."""
    e = load(spark, sf, "events").crossJoin(F.broadcast(spark.createDataFrame([(x,) for x in (30.0, 38.0, 45.0, 60.0)], "parameter double")))
    from pyspark.sql.window import Window

    out = W.ranked(_tried(e), W.reward_of("recall", "precision", 0.9, 50.0), ["parameter"])
    rank = F.row_number().over(Window.orderBy(F.col("reward").desc_nulls_last(), "parameter"))
    allowed = F.col("reward") > float("-inf")
    return out.select("parameter", allowed.alias("allowed"), F.when(allowed, F.round("reward", 6)).alias("reward"), rank.alias("rank"))


@query(f"WITH {DAILY}, d AS (SELECT event_type, v, avg(v) OVER (PARTITION BY event_type) AS f FROM daily) SELECT event_type, round(avg(CASE WHEN abs(f - v) > 0.1 * abs(v) THEN 1.0 ELSE 0.0 END), 6) AS outside FROM d GROUP BY 1")
def outside_tolerance(spark: SparkSession, sf: str) -> DataFrame:
    """How many days are over a tenth off their series' mean."""
    d = daily(spark, sf)
    rows = d.join(d.groupBy("event_type").agg(F.avg("v").alias("f")), "event_type")
    return R.rounded(rows.groupBy("event_type").agg(E.fraction_outside_tolerance(F.col("v"), F.col("f"), 0.1).alias("outside")))


@query()
def quantile_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """Forecasts with bounds from regressions of quantiles (tests hold them against counting)."""
    return G.quantile_forecast(daily(spark, sf).select("event_type", "ts", "v"), "ts", "v", 5, model=G.Model(changepoints=1, seasons=(), alpha=0.1, coverage=0.8), dims=["event_type"])


# reconciliation by quadratic programming, overlays

_TREE = {"both": ["view", "click"]}
_BOTH = f"""{DAILY}, d AS (SELECT ts, sum(CASE WHEN event_type = 'view' THEN v END) AS v, sum(CASE WHEN event_type = 'click' THEN v END) AS c FROM daily GROUP BY 1), e AS (SELECT ts, v, c, 1.2 * v AS fv, 0.9 * c AS fc, v + c + 10 * (day(ts) % 3) AS ft FROM d)"""


def _both(spark: SparkSession, sf: str) -> DataFrame:
    d = daily(spark, sf).where("event_type in ('view', 'click')")
    leaves = d.select("ts", F.col("event_type").alias("node"), F.col("v").alias("actual"), F.when(F.col("event_type") == "view", F.col("v") * 1.2).otherwise(F.col("v") * 0.9).alias("forecast"))
    return leaves.unionByName(d.groupBy("ts").agg(F.sum("v").alias("actual")).select("ts", F.lit("both").alias("node"), "actual", (F.col("actual") + 10 * (F.dayofmonth("ts") % 3)).alias("forecast")))


@query(f"""WITH {_BOTH}, x AS (SELECT 1 AS g, v AS y, fv AS x0, fc AS x1, ft AS x2 FROM e), {solved("x", 3, [0, 0, 0])}, x_c AS (SELECT 1 AS g, c AS y, fv AS x0, fc AS x1, ft AS x2 FROM e), {solved("x_c", 3, [0, 0, 0], "c_")},
    r AS (SELECT ts, b.b0 * fv + b.b1 * fc + b.b2 * ft AS v, k.b0 * fv + k.b1 * fc + k.b2 * ft AS c FROM e, beta b, c_beta k)
    SELECT ts, 'view' AS node, round(v, 2) AS forecast FROM r UNION ALL SELECT ts, 'click', round(c, 2) FROM r UNION ALL SELECT ts, 'both', round(v + c, 2) FROM r""")
def reconcile_by_training_error(spark: SparkSession, sf: str) -> DataFrame:
    """The transformation of least error on the history that adds up: each leaf's regression on all forecasts."""
    out = Q.reconcile_convex(_both(spark, sf), ["both", "view", "click"], _TREE, "ts", Q.Penalties(unbiased=False))
    return R.rounded(out, 2)


@query(f"""WITH {_BOTH}, r AS (SELECT ts, fv + (ft - fv - fc) / 3 AS v, fc + (ft - fv - fc) / 3 AS c FROM e) SELECT ts, 'view' AS node, round(v, 3) AS forecast FROM r UNION ALL SELECT ts, 'click', round(c, 3) FROM r UNION ALL SELECT ts, 'both', round(v + c, 3) FROM r""")
def reconcile_within_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """Least variance with bounds that don't bind, by alternating directions: the plain projection."""
    out = Q.reconcile_convex(_both(spark, sf), ["both", "view", "click"], _TREE, "ts", Q.Penalties(train=0.0, var=1.0, identity_covariance=True, lower=-5.0, upper=5.0))
    return R.rounded(out, 3)


@query(f"""WITH {DAILY}, x AS (SELECT event_type, CAST(isodow(ts) AS INTEGER) AS dow, CAST(day(ts) - 1 AS INTEGER) // 15 AS half, v FROM daily)
    SELECT event_type, dow, round(avg(v), 4) AS mean, round(quantile_cont(v, 0.25), 4) AS q25, round(avg(CASE WHEN half = 0 THEN v END), 4) AS overlay_0, round(avg(CASE WHEN half = 1 THEN v END), 4) AS overlay_1 FROM x GROUP BY 1, 2""")
def weekday_overlays(spark: SparkSession, sf: str) -> DataFrame:
    """Means and quartiles of weekdays, with one overlay for each half of the month."""
    d = daily(spark, sf).withColumn("dow", (F.weekday("ts") + 1).cast("int")).withColumn("half", F.floor((F.dayofmonth("ts") - 1) / 15).cast("int"))
    return R.rounded(S.overlays(d, "v", "dow", "half", [0, 1], quantiles=[0.25], dims=["event_type"]), 4)


@query(f"""WITH {DAILY}, x AS (SELECT event_type, CAST(isodow(ts) AS INTEGER) AS dow, v, row_number() OVER (PARTITION BY event_type, isodow(ts) ORDER BY ts) AS k FROM daily),
    o AS (SELECT event_type, dow, avg(v) AS mean, median(CASE WHEN k = 1 THEN v END) AS a, median(CASE WHEN k = 2 THEN v END) AS b FROM x GROUP BY 1, 2)
    SELECT event_type, dow, round(mean - avg(mean) OVER w, 4) AS mean, round(a - avg(a) OVER w, 4) AS overlay_1, round(b - avg(b) OVER w, 4) AS overlay_2 FROM o WINDOW w AS (PARTITION BY event_type)""")
def centred_overlays(spark: SparkSession, sf: str) -> DataFrame:
    """The first and the second time of each weekday, centred."""
    d = S.with_position(daily(spark, sf).withColumn("dow", (F.weekday("ts") + 1).cast("int")), "ts", "dow", dims=["event_type"])
    return R.rounded(S.overlays(d, "v", "dow", "position", [1, 2], "median", center=True, dims=["event_type"]), 4)


# transforms of metrics


@query(f"""WITH {DAILY}, s AS (SELECT event_type, date_trunc('week', ts) AS p, sum(v) AS total, count(*) AS n FROM daily GROUP BY 1, 2), w AS (SELECT d.event_type, d.ts, d.v / CASE WHEN s.n = 7 THEN s.total END AS x FROM daily d JOIN s ON s.event_type = d.event_type AND s.p = date_trunc('week', d.ts))
    SELECT w.event_type, w.ts, round(w.x - p.x, 6) AS value, 'total_within_week_weight_wow_diff' AS metric FROM w LEFT JOIN w p ON p.event_type = w.event_type AND p.ts = w.ts - INTERVAL 7 DAY""")
def transformed_share_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Days' shares of whole weeks less those of the week before."""
    steps = [N.ShareWithin("W"), N.Diff("W", 1)]
    out = N.transformed(daily(spark, sf), steps, "ts", ["v"], "D", ["event_type"])
    return out.select("event_type", "ts", F.round("v", 6).alias("value"), F.lit(N.metric_name("total", steps)).alias("metric"))


@query("""WITH h AS (SELECT event_type, date_trunc('day', ts) AS ts, avg(value) AS v, count(*) AS n FROM events GROUP BY 1, 2), d AS (SELECT event_type, ts, v, lag(v, 1) OVER w AS a, lag(v, 2) OVER w AS b, lag(v, 3) OVER w AS c FROM h WINDOW w AS (PARTITION BY event_type ORDER BY ts))
    SELECT event_type, ts, round((v - median(x)) / median(x), 6) AS value, 'mean_rel_median_3d_diff' AS metric FROM (SELECT event_type, ts, v, a, b, c, unnest([a, b, c]) AS x FROM d WHERE c IS NOT NULL) GROUP BY event_type, ts, v
    UNION ALL SELECT event_type, ts, NULL, 'mean_rel_median_3d_diff' FROM d WHERE c IS NULL""")
def transformed_relative_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Days' means relative to the median of the three days before."""
    d = load(spark, sf, "events").groupBy("event_type", F.date_trunc("day", "ts").alias("ts")).agg(F.avg("value").alias("v"))
    steps = [N.Diff("D", 3, agg="median", relative=True)]
    return N.transformed(d, steps, "ts", ["v"], "D", ["event_type"]).select("event_type", "ts", F.round("v", 6).alias("value"), F.lit(N.metric_name("mean", steps)).alias("metric"))
