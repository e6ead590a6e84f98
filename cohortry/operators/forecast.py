"""Forecasts, rolling backfills and the algebra of forecast frames."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..functions.time import expected_rows, shift
from .relational import match as joined
from .series import STEP
from .simulate import normal

#: The canonical forecast row.
FORECAST_SCHEMA = T.StructType(
    [T.StructField("ts", T.TimestampType()), T.StructField("metric_id", T.StringType()), T.StructField("metric_name", T.StringType()), T.StructField("stage", T.StringType()), T.StructField("forecasted_date", T.DateType()), T.StructField("last_training_date", T.StringType())]
    + [T.StructField(c, T.DoubleType()) for c in "actual forecast forecast_lower forecast_upper std longterm_growth shortterm_growth daily_seasonality weekly_seasonality annual_seasonality holiday_impact residual".split()]
    + [T.StructField("is_anomaly", T.BooleanType()), T.StructField("is_anomaly_predicted", T.BooleanType()), T.StructField("anomaly_score", T.DoubleType()), T.StructField("anomaly_severity", T.StringType()), T.StructField("extras", T.MapType(T.StringType(), T.DoubleType()))]
    + [T.StructField(c, T.StringType()) for c in ("algo_name", "algo_version", "run_id")] + [T.StructField("run_date", T.DateType())]
)


def z_of(coverage: float) -> float:
    return NormalDist().inv_cdf((1 + coverage) / 2)


def future_rows(df: DataFrame, time_col: str, freq: str, horizon: int, dims: Sequence[str] = ()) -> DataFrame:
    """dims, time of the `horizon` steps after each series' last."""
    last = df.groupBy(*dims).agg(F.max(time_col).alias("_last"))
    return last.select(*dims, F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("horizon_step"), "_last").select(*dims, shift(F.col("_last"), freq, 1).alias("_f"), "_last", "horizon_step").select(
        *dims, F.expr(f"_last + {STEP[freq]} * horizon_step").alias(time_col), "horizon_step")


def seasonal_mean(df: DataFrame, time_col: str, value: str, period: int, k: int = 4, horizon: int = 7, freq: str = "D", agg: str = "mean", coverage: float = 0.95, dims: Sequence[str] = ()) -> DataFrame:
    """Mean (or median) of up to k values at whole periods before, with bounds z * their population sd: fitted and forecast rows.

    Look-backs beyond the history are skipped, never forecast first; a row without any has null estimates. Each row's
    look-backs are found by joins on the row's position in its series, so a long series is spread over tasks.
    """
    w = W.partitionBy(*dims).orderBy(time_col)
    rows = df.select(*dims, time_col, F.col(value).cast("double").alias("actual")).withColumn("_i", F.row_number().over(w))
    n = rows.groupBy(*dims).agg(F.max("_i").alias("_n"), F.max(time_col).alias("_last"))
    ahead = n.select(*dims, F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("_h"), "_n", "_last").select(*dims, F.expr(f"_last + {STEP[freq]} * _h").alias(time_col), F.lit(None).cast("double").alias("actual"), (F.col("_n") + F.col("_h")).alias("_i"), F.lit("forecast").alias("stage"))
    targets = rows.withColumn("stage", F.lit("fitted")).unionByName(ahead)
    wanted = targets.select(*dims, time_col, "actual", "stage", "_i", F.explode(F.array(*[F.col("_i") - j * period for j in range(1, k + 1 + -(-horizon // period))])).alias("_p"))
    # the first k whole periods back that are in the history
    seen = rows.select(*dims, F.col("_i").alias("_p"), F.col("actual").alias("_v"))
    found = joined(wanted, seen, [*dims, "_p"]).withColumn("_r", F.row_number().over(W.partitionBy(*dims, "_i", "stage").orderBy(F.desc("_p")))).where(F.col("_r") <= k)
    best = {"mean": F.avg("_v"), "median": F.median("_v")}[agg]
    past = found.groupBy(*dims, "_i").agg(best.alias("forecast"), F.stddev_pop("_v").alias("std"))
    out = joined(targets, past, [*dims, "_i"], "left")
    z = z_of(coverage)
    return out.select(*dims, time_col, "stage", "actual", "forecast", (F.col("forecast") - z * F.col("std")).alias("forecast_lower"), (F.col("forecast") + z * F.col("std")).alias("forecast_upper"), "std")


def similarity(train: DataFrame, future: DataFrame, value: str, match: Sequence[str], agg: str = "mean", dims: Sequence[str] = (), recent_time: str | None = None) -> DataFrame:
    """future with the aggregate of training values of equal match columns, or of all where none are equal."""
    x = F.col(value).cast("double")
    aggs = {"mean": F.avg(x), "median": F.median(x), "min": F.min(x), "max": F.max(x)}
    pick = F.max_by(x, F.col(recent_time)) if agg == "most_recent" else aggs[agg]
    like = train.groupBy(*dims, *match).agg(pick.alias("_like"))
    every = train.groupBy(*dims).agg(pick.alias("_all"))
    out = joined(future, like, [*dims, *match], "left")
    out = joined(out, every, dims, "left")
    return out.withColumn("forecast", F.coalesce("_like", "_all")).drop("_like", "_all")


def lag_forecast(df: DataFrame, time_col: str, value: str, freq: str, lag: int, horizon: int, n: int = 1, dims: Sequence[str] = ()) -> DataFrame:
    """Means of the last n values at whole lags before each future step. A step beyond the first lag reads the history at its whole-lag positions as well."""
    return seasonal_mean(df, time_col, value, lag, n, horizon, freq, dims=dims).where("stage = 'forecast'")


def null_model(train: DataFrame, value: str, strategy: str = "mean", constant: float | None = None, quantile: float = 0.5, dims: Sequence[str] = ()) -> DataFrame:
    """One number for each series: mean, median, quantile or constant."""
    x = F.col(value).cast("double")
    pick = {"mean": F.avg(x), "median": F.median(x), "quantile": F.percentile(x, F.lit(quantile)), "constant": F.max(F.lit(constant).cast("double"))}[strategy]
    return train.groupBy(*dims).agg(pick.alias("forecast"))


def cutoffs(n: int, initial: int, horizon: int, step: int = 1, last: int | None = None) -> list[int]:
    """Lengths of the training windows of a backfill: initial, initial + step, ... while a whole horizon follows."""
    out = list(range(initial, n - horizon + 1, step))
    return out[-last:] if last else out


def backfill(df: DataFrame, time_col: str, value: str, cut: Sequence[int], horizon: int, forecast: Callable[[DataFrame, Sequence[str]], DataFrame], window: int | None = None, dims: Sequence[str] = ()) -> DataFrame:
    """Forecasts of each cutoff as if made then, next to what came: cutoff, horizon_step, forecast columns, actual.

    Every (series, cutoff) is a series of its own to the forecaster, so all are done in one distributed pass. `window` limits
    training to the rows before the cutoff (a rolling window); otherwise it expands.
    """
    spark = df.sparkSession
    rows = df.withColumn("_i", F.row_number().over(W.partitionBy(*dims).orderBy(time_col)))
    cuts = F.broadcast(spark.createDataFrame([(c,) for c in cut], "cutoff int"))
    first = F.lit(0) if window is None else F.col("cutoff") - window
    train = rows.join(cuts, (F.col("_i") <= F.col("cutoff")) & (F.col("_i") > first)).drop("_i")
    made = forecast(train, [*dims, "cutoff"]).where("stage = 'forecast'").drop("actual")
    steps = F.row_number().over(W.partitionBy(*dims, "cutoff").orderBy(time_col))
    actual = df.select(*dims, F.col(time_col).cast("timestamp").alias(time_col), F.col(value).cast("double").alias("actual"))
    out = made.withColumn("horizon_step", steps).where(F.col("horizon_step") <= horizon).withColumn(time_col, F.col(time_col).cast("timestamp"))
    return joined(out, actual, [*dims, time_col], "left")


def stamp(df: DataFrame, **columns: object) -> DataFrame:
    """df with constant pipeline columns, such as metric_id, algo_name or run_date."""
    return df.withColumns({k: F.lit(v) for k, v in columns.items()})


def grouping_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """The columns that name a series of a forecast frame: all that are neither numbers nor of the pipeline's own."""
    own = {"ts", "stage", "forecasted_date", "last_training_date", "is_anomaly", "is_anomaly_predicted", "anomaly_severity", "extras", "algo_name", "algo_version", "run_id", "run_date", *exclude}
    numbers = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
    return [c for c, kind in df.dtypes if c not in own and not kind.startswith(numbers)]


def normal_quantiles(df: DataFrame, sd: str, mean: str | None = None, fixed_mean: float = 0.0, quantiles: Sequence[float] = (0.025, 0.975), name: str = "normal_quantiles") -> DataFrame:
    """df with the quantiles of a normal law of each row's mean and sd."""
    centre = F.lit(fixed_mean) if mean is None else F.col(mean)
    return df.withColumn(name, F.array(*[centre + NormalDist().inv_cdf(q) * F.col(sd) for q in quantiles]))


def with_forecasts(df: DataFrame, forecasts: Sequence[DataFrame], on: Sequence[str], columns: Sequence[str] = ("forecast", "forecast_lower", "forecast_upper")) -> DataFrame:
    """Data met with several forecasts of it: each one's columns come as <name>_<i>, from 0; rows that a forecast lacks have nulls."""
    for i, f in enumerate(forecasts):
        df = joined(df, f.select(*on, *[F.col(c).alias(f"{c}_{i}") for c in columns]), on, "left")
    return df


def simulate_futures(df: DataFrame, n: int, seed: int = 0, dims: Sequence[str] = (), time_col: str = "ts") -> DataFrame:
    """n futures of each forecast row: simulation (from 1) and value, the forecast and normal noise of its std, the same for a seed."""
    future = df.where("stage = 'forecast'").withColumn("simulation", F.explode(F.sequence(F.lit(1), F.lit(n))))
    key = F.xxhash64(*dims, time_col, "simulation")
    return future.withColumn("value", F.col("forecast") + F.coalesce("std", F.lit(0.0)) * normal(key, seed))


def partition_future(future: DataFrame, train: DataFrame, time_col: str = "ts", dims: Sequence[str] = ()) -> DataFrame:
    """future with where each row lies: before, within (a time of training), gap (missing in it) or after the training rows."""
    ends = train.groupBy(*dims).agg(F.min(time_col).alias("_a"), F.max(time_col).alias("_b"))
    seen = train.select(*dims, time_col).distinct().withColumn("_seen", F.lit(True))
    out = joined(joined(future, ends, dims, "left"), seen, [*dims, time_col], "left")
    where = F.when(F.col("_a").isNull() | (F.col(time_col) > F.col("_b")), "after").when(F.col(time_col) < F.col("_a"), "before").when(F.col("_seen"), "within").otherwise("gap")
    return out.withColumn("part", where).drop("_a", "_b", "_seen")


def recursive_lags(df: DataFrame, time_col: str, value: str, freq: str, orders: Sequence[int], horizon: int, agg: str = "mean", dims: Sequence[str] = ()) -> DataFrame:
    """The mean (or other aggregate) of the values so many rows before, step by step: what is forecast is history to later steps.

    Each series' last max(orders) values are one array, so a series of any length needs but those.
    """
    most = max(orders)
    near = df.withColumn("_r", F.row_number().over(W.partitionBy(*dims).orderBy(F.desc(time_col)))).where(F.col("_r") <= most)
    row = F.struct(F.col(time_col).alias("t"), F.col(value).cast("double").alias("v"))
    last = near.groupBy(*dims).agg(F.sort_array(F.collect_list(row)).alias("_v"), F.max(time_col).alias("_last"))
    past = F.transform("_v", lambda x: x["v"])
    pick = {"mean": lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, b: a + b) / F.size(xs), "min": F.array_min, "max": F.array_max}[agg]

    def step(seen: Column, _: Column) -> Column:
        got = F.array_compact(F.array(*[F.try_element_at(seen, F.lit(-k)) for k in orders]))
        return F.concat(seen, F.array(F.when(F.size(got) > 0, pick(got))))

    made = last.withColumn("_all", F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), past, step))
    out = made.select(*dims, "_last", F.posexplode(F.slice("_all", F.size("_all") - horizon + 1, horizon)).alias("_i", "forecast"))
    return out.select(*dims, F.expr(f"_last + {STEP[freq]} * (_i + 1)").alias(time_col), (F.col("_i") + 1).alias("horizon_step"), "forecast")


def one_by_one(df: DataFrame, models: Sequence[Callable[[DataFrame, Sequence[str]], DataFrame]], time_col: str = "ts", dims: Sequence[str] = ()) -> DataFrame:
    """Each step ahead from a model of its own: of the i-th model's forecast rows the i-th stays, with horizon_step."""
    step = F.row_number().over(W.partitionBy(*dims).orderBy(time_col))
    parts = [m(df, dims).where("stage = 'forecast'").withColumn("horizon_step", step).where(F.col("horizon_step") == i) for i, m in enumerate(models, 1)]
    return reduce(DataFrame.unionByName, parts)


def multistage(df: DataFrame, time_col: str, value: str, period: str, coarse: Callable[[DataFrame, Sequence[str]], DataFrame], fine: Callable[[DataFrame, Sequence[str]], DataFrame], dims: Sequence[str] = ()) -> DataFrame:
    """Two forecasts in turn: one of the series' means by period, then one of what that leaves, added up.

    Both take (series with time_col and `value`, dims) and give time_col, stage, forecast; the first one's times are starts of periods.
    """
    start = F.date_trunc(period, F.col(time_col))
    means = df.groupBy(*dims, start.alias(time_col)).agg(F.avg(value).alias(value))
    level = coarse(means, dims).select(*dims, F.col(time_col).alias("_p"), F.col("forecast").alias("_level"))
    rows = joined(df.withColumn("_p", start), level, [*dims, "_p"], "left")
    rest = fine(rows.select(*dims, time_col, (F.col(value) - F.col("_level")).alias(value)), dims)
    out = joined(rest.withColumn("_p", F.date_trunc(period, F.col(time_col))), level, [*dims, "_p"], "left")
    return out.select(*dims, time_col, "stage", (F.col("_level") + F.col("forecast")).alias("forecast"))


# algebra

POINTS = ("forecast", "longterm_growth", "shortterm_growth", "daily_seasonality", "weekly_seasonality", "annual_seasonality", "holiday_impact")


def strict_sum(c: str) -> Column:
    """The sum, null if any part is."""
    return F.when(F.count(c) == F.count("*"), F.sum(c))


def _stage() -> Column:
    return F.when(F.bool_or(F.col("stage") == "forecast"), "forecast").otherwise("fitted")


def _summed(df: DataFrame, by: Sequence[str], coverage: float) -> DataFrame:
    points = [c for c in POINTS if c in df.columns]
    z = z_of(coverage)
    out = df.groupBy(*by).agg(_stage().alias("stage"), strict_sum("actual").alias("actual"), *[strict_sum(c).alias(c) for c in points], F.sqrt(F.sum(F.col("std") * F.col("std"))).alias("std"), F.count("*").alias("_n"))
    return out.withColumn("forecast_lower", F.col("forecast") - z * F.col("std")).withColumn("forecast_upper", F.col("forecast") + z * F.col("std"))


def sum_over_dims(df: DataFrame, keep: Sequence[str], coverage: float = 0.80) -> DataFrame:
    """Forecasts summed over all dims but those to keep; sigmas add in quadrature, bounds are made anew."""
    return _summed(df, keep, coverage).drop("_n")


def sum_over_period(df: DataFrame, time_col: str, period: str, freq: str = "D", dims: Sequence[str] = (), coverage: float = 0.80) -> DataFrame:
    """Forecasts summed over whole periods, labelled by their start; periods that lack rows go."""
    unit = {"W": "week", "M": "month", "Q": "quarter", "Y": "year"}[period]
    out = _summed(df.withColumn(time_col, F.date_trunc(unit, F.col(time_col))), [*dims, time_col], coverage)
    return out.where(F.col("_n") == expected_rows(F.col(time_col), freq, period)).drop("_n")


def _share(df: DataFrame, by: Sequence[str], sigma: str, coverage: float) -> DataFrame:
    w = W.partitionBy(*by)
    complete = F.count("forecast").over(w) == F.count("*").over(w)
    y = F.when(complete, F.sum("forecast").over(w))
    sy2 = F.sum(F.col("std") * F.col("std")).over(w)
    out = df.withColumn("_y", y).withColumn("_s", sy2).withColumn("_a", F.when(F.count("actual").over(w) == F.count("*").over(w), F.sum("actual").over(w)))
    share = F.try_divide(F.col("forecast"), F.col("_y"))
    std = F.try_divide(F.col("std"), F.abs("_y")) if sigma == "fixed" else F.try_divide(F.sqrt(F.col("std") * F.col("std") + share * share * F.col("_s")), F.abs("_y"))
    z = z_of(coverage)
    out = out.withColumn("_f", share).withColumn("_d", std).withColumn("actual", F.try_divide(F.col("actual"), F.col("_a")))
    out = out.withColumn("forecast", F.col("_f")).withColumn("std", F.col("_d"))
    return out.withColumn("forecast_lower", F.col("forecast") - z * F.col("std")).withColumn("forecast_upper", F.col("forecast") + z * F.col("std")).drop("_y", "_s", "_a", "_f", "_d")


def weight_over_dims(df: DataFrame, within: Sequence[str], sigma: str = "fixed", coverage: float = 0.80) -> DataFrame:
    """Forecasts as shares of their total within the given columns; sigma `fixed` (total taken as known) or `delta`."""
    return _share(df, within, sigma, coverage)


def weight_over_period(df: DataFrame, time_col: str, period: str, freq: str = "D", dims: Sequence[str] = (), sigma: str = "fixed", coverage: float = 0.80) -> DataFrame:
    """Forecasts as shares of their whole period; rows of periods that lack rows go."""
    unit = {"W": "week", "M": "month", "Q": "quarter", "Y": "year"}[period]
    start = F.date_trunc(unit, F.col(time_col))
    whole = df.withColumn("_p", start).withColumn("_n", F.count("*").over(W.partitionBy(*dims, "_p")))
    return _share(whole.where(F.col("_n") == expected_rows(F.col("_p"), freq, period)), [*dims, "_p"], sigma, coverage).drop("_p", "_n")


# reconciliation


def bottom_up(leaves: DataFrame, tree: DataFrame, by: Sequence[str], value: str = "forecast") -> DataFrame:
    """Each node's sum of its leaves; tree (node, leaf) names all leaves under each node, itself included for a leaf."""
    return leaves.withColumnRenamed("node", "leaf").join(tree, "leaf").groupBy("node", *by).agg(F.sum(value).alias(value))


def reconcile(df: DataFrame, nodes: Sequence[str], leaves: Sequence[str], tree: dict[str, Sequence[str]], by: str, value: str = "forecast", weights: dict[str, float] | None = None) -> DataFrame:
    """Forecasts of all nodes projected onto those that add up: least squares, weighted by 1 / variance if weights are given.

    The projection is a small matrix, applied as sums of columns to one row for each `by`.
    """
    import numpy as np

    s = np.array([[1.0 if leaf in tree.get(n, (n,)) else 0.0 for leaf in leaves] for n in nodes])
    w = np.diag([1.0 / (weights or {}).get(n, 1.0) for n in nodes])
    p = s @ np.linalg.solve(s.T @ w @ s, s.T @ w)
    wide = df.groupBy(by).pivot("node", list(nodes)).agg(F.first(value))
    rows = [F.struct(F.lit(n).alias("node"), reduce(lambda a, b: a + b, (F.lit(float(p[i, j])) * F.col(m) for j, m in enumerate(nodes))).alias(value)) for i, n in enumerate(nodes)]
    return wide.select(by, F.explode(F.array(*rows)).alias("x")).select(by, "x.*")


def error_covariance(df: DataFrame, nodes: Sequence[str], by: str, actual: str = "actual", forecast: str = "forecast") -> list[list[float]]:
    """The sample covariance of the nodes' errors, from one aggregation of one row for each `by`; nodes are few."""
    wide = df.withColumn("_e", F.col(actual) - F.col(forecast)).groupBy(by).pivot("node", list(nodes)).agg(F.first("_e"))
    cells = [F.covar_samp(F.col(f"`{a}`"), F.col(f"`{b}`")) for a in nodes for b in nodes]
    got = list(wide.agg(*[c.alias(f"c{i}") for i, c in enumerate(cells)]).first())
    k = len(nodes)
    return [[float(x or 0.0) for x in got[i * k : (i + 1) * k]] for i in range(k)]


def reconcile_mint(df: DataFrame, errors: DataFrame, nodes: Sequence[str], leaves: Sequence[str], tree: dict[str, Sequence[str]], by: str, value: str = "forecast", shrink: float = 0.0) -> DataFrame:
    """Forecasts of all nodes projected onto those that add up so that the errors' total variance is least, by the sample covariance of
    errors (node, actual, forecast, by); shrink moves it towards its diagonal, which helps where errors are few."""
    import numpy as np

    cov = np.array(error_covariance(errors, nodes, by))
    cov = (1 - shrink) * cov + shrink * np.diag(np.diag(cov))
    cov += 1e-9 * max(np.trace(cov) / len(nodes), 1e-12) * np.eye(len(nodes))
    s = np.array([[1.0 if leaf in tree.get(n, (n,)) else 0.0 for leaf in leaves] for n in nodes])
    w = np.linalg.inv(cov)
    p = s @ np.linalg.solve(s.T @ w @ s, s.T @ w)
    wide = df.groupBy(by).pivot("node", list(nodes)).agg(F.first(value))
    rows = [F.struct(F.lit(n).alias("node"), reduce(lambda a, b: a + b, (F.lit(float(p[i, j])) * F.col(f"`{m}`") for j, m in enumerate(nodes))).alias(value)) for i, n in enumerate(nodes)]
    return wide.select(by, F.explode(F.array(*rows)).alias("x")).select(by, "x.*")
