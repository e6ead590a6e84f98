"""Forecast accuracy, detection scores, actuals of several partitions, and live evaluation."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .relational import match

#: Accuracy of the sketch, what it is taken below the cut, and tasks that the rows below it are dealt to.
SKETCH, SURELY, DEALT = 10_000, 0.002, 64
TRIMMED = ("mae", "rmse", "mape", "smape", "medape", "medae")


def evaluate(df: DataFrame, by: Sequence[str], trim: float = 0.01, actual: str = "actual", forecast: str = "forecast", lower: str = "forecast_lower", upper: str = "forecast_upper", tie: Sequence[str] = ()) -> DataFrame:
    """Accuracy of each group. Rows need actual and forecast; groups with a null key go.

    Point errors leave out the floor(n * trim) largest absolute errors (ties by the given columns). r2, coverage, bias, sigma
    and error quantiles use all rows. Error: actual - forecast. Percentage errors skip zero actuals. Quantiles are exact.

    Only rows that may be left out are put in order: those above a sketched quantile that is surely below the cut (its rank is off by n /
    10,000 at most). The others of a group are dealt to many tasks.
    """
    a, p = F.col(actual).cast("double"), F.col(forecast).cast("double")
    rows = df.where(a.isNotNull() & p.isNotNull())
    for c in by:
        rows = rows.where(F.col(c).isNotNull())
    err = a - p
    rows = rows.withColumn("_e", err).withColumn("_abs", F.abs(err))
    sketched = rows.groupBy(*by).agg(F.count("*").alias("_n"), F.percentile_approx("_abs", max(0.0, 1 - trim - SURELY), SKETCH).alias("_low"))
    rows = match(rows, sketched, list(by))
    high = F.col("_abs") >= F.col("_low")
    deal = F.when(high, -1).otherwise(F.pmod(F.xxhash64("_abs", *tie), F.lit(DEALT)))
    order = W.partitionBy(*by, deal).orderBy(F.desc("_abs"), *[F.desc(c) for c in tie])
    kept = ~high | (F.col("_r") > F.floor(F.col("_n") * trim))
    rows = rows.withColumn("_r", F.row_number().over(order))
    ape = F.when(a != 0, F.abs(err / a)) * 100
    sape = F.when((F.abs(a) + F.abs(p)) > 0, F.abs(err) / ((F.abs(a) + F.abs(p)) / 2)) * 100
    inside = F.when(F.col(lower).isNotNull() & F.col(upper).isNotNull(), F.when((a >= F.col(lower)) & (a <= F.col(upper)), 1.0).otherwise(0.0))
    k = lambda c: F.when(kept, c)
    q = lambda x: F.percentile("_e", F.lit(x))
    out = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(k(F.col("_abs"))).alias("mae"), F.sqrt(F.avg(k(F.col("_e") * F.col("_e")))).alias("rmse"), F.avg(k(ape)).alias("mape"), F.avg(k(sape)).alias("smape"),
        F.median(k(ape)).alias("medape"), F.median(k(F.col("_abs"))).alias("medae"), F.when(F.var_pop(a) > 0, 1 - F.avg(F.col("_e") * F.col("_e")) / F.var_pop(a)).alias("r2"),
        F.avg(inside).alias("coverage"), F.avg("_e").alias("bias"), F.stddev_samp("_e").alias("sigma"), q(0.25).alias("q25"), q(0.5).alias("q50"), q(0.75).alias("q75"),
    )
    return out.withColumn("iqr", F.col("q75") - F.col("q25"))


def evaluate_by_horizon(df: DataFrame, metric: str = "metric_id", horizon: str = "horizon_step", **how) -> DataFrame:
    """evaluate by metric and horizon, and by metric overall (horizon null), in one frame."""
    return evaluate(df, [metric, horizon], **how).unionByName(evaluate(df, [metric], **how).withColumn(horizon, F.lit(None).cast("int")), allowMissingColumns=True)


def elementwise(actual: Column, forecast: Column, lower: Column | None = None, upper: Column | None = None) -> dict[str, Column]:
    """Errors of single rows by name; coverage if bounds are given. Percentage errors are shares here, null where the base is 0."""
    e = actual - forecast
    loss = lambda q: F.when(actual >= forecast, q * e).otherwise((q - 1) * e)
    out = {
        "residual": e, "absolute_error": F.abs(e), "squared_error": e * e, "absolute_percent_error": F.try_divide(F.abs(e), F.abs(actual)),
        "symmetric_absolute_percent_error": F.try_divide(F.abs(e), F.abs(actual) + F.abs(forecast)),
        **{f"quantile_loss_{int(100 * q)}": loss(q) for q in (0.80, 0.90, 0.95, 0.99)},
        "outside_tolerance_5p": F.when(F.abs(e) > 0.05 * F.abs(actual), 1.0).otherwise(0.0),
    }
    if lower is not None and upper is not None:
        out["coverage"] = F.when((actual > lower) & (actual < upper), 1.0).otherwise(0.0)
    return out


def evaluate_groups(df: DataFrame, by: Sequence[str], rows: dict[str, Column], aggs: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Values of single rows (by name, such as those of `elementwise`) aggregated by group: aggs has, for a name, what is made of it."""
    named = df.select(*by, *[c.alias(k) for k, c in rows.items()])
    return named.groupBy(*by).agg(*[f(F.col(k)).alias(k) for k, f in aggs.items()])


def quantile_loss(actual: Column, forecast: Column, q: float) -> Column:
    return F.avg(F.when(actual >= forecast, q * (actual - forecast)).otherwise((1 - q) * (forecast - actual)))


def interval_score(actual: Column, lower: Column, upper: Column, coverage: float) -> Column:
    """Width, and 2 / (1 - coverage) times what lies outside, on average."""
    f = 2 / (1 - coverage)
    return F.avg((upper - lower) + f * F.greatest(lower - actual, F.lit(0.0)) + f * F.greatest(actual - upper, F.lit(0.0)))


def prediction_coverage(actual: Column, forecast: Column, lower: Column, upper: Column) -> dict[str, Column]:
    """Shares strictly within the bands, above and below them, and in the bands' halves."""
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return {
        "within": share((actual > lower) & (actual < upper)), "below": share(actual <= lower), "above": share(actual >= upper),
        "lower_half": share((actual > lower) & (actual <= forecast)), "upper_half": share((actual > forecast) & (actual < upper)), "band_width": F.avg(F.abs(F.try_divide(100.0 * (upper - lower), actual))),
    }


def prediction_errors(df: DataFrame, actual: str, forecast: str, by: Sequence[str] = ()) -> DataFrame:
    """The wider library of point errors. Here percentage errors are null if any denominator is 0, and smape lacks the factor 2."""
    a, p = F.col(actual).cast("double"), F.col(forecast).cast("double")
    ok = a.isNotNull() & p.isNotNull() & ~F.isnan(a) & ~F.isnan(p) & (F.abs(a) < float("inf")) & (F.abs(p) < float("inf"))
    e = a - p
    rows = df.where(ok)
    zero, both = F.bool_or(a == 0), F.bool_or(F.abs(a) + F.abs(p) == 0)
    return rows.groupBy(*by).agg(
        F.corr(a, p).alias("correlation"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"), F.median(F.abs(e)).alias("medae"),
        F.when(~zero, F.avg(F.abs(F.try_divide(e, a))) * 100).alias("mape"), F.when(~zero, F.median(F.abs(F.try_divide(e, a))) * 100).alias("medape"), F.when(~both, F.avg(F.try_divide(F.abs(e), F.abs(a) + F.abs(p))) * 100).alias("smape"),
        F.when(F.var_pop(a) > 0, 1 - F.avg(e * e) / F.var_pop(a)).alias("r2"), *[quantile_loss(a, p, q).alias(f"q{int(q * 100)}") for q in (0.8, 0.95, 0.99)],
    )


def r2_null_model(df: DataFrame, actual: str, forecast: str, null: str, by: Sequence[str] = ()) -> DataFrame:
    """1 less the squared error over that of a null model."""
    sq = lambda c: F.sum(F.pow(F.col(actual) - F.col(c), F.lit(2)))
    return df.groupBy(*by).agg((1 - F.try_divide(sq(forecast), sq(null))).alias("r2_null_model"))


def detection(df: DataFrame, by: Sequence[str], true: str = "is_anomaly", pred: str = "is_anomaly_predicted", window: int = 0, time_col: str = "ts") -> DataFrame:
    """Precision, recall, f1, accuracy and MCC; with a window, a hit counts if the other series has one within so many rows."""
    t, p = F.coalesce(F.col(true), F.lit(False)), F.coalesce(F.col(pred), F.lit(False))
    rows = df.withColumn("_t", t).withColumn("_p", p)
    if window:
        near = W.partitionBy(*by).orderBy(time_col).rowsBetween(-window, window)
        rows = rows.withColumn("_tw", F.max(F.col("_t").cast("int")).over(near) == 1).withColumn("_pw", F.max(F.col("_p").cast("int")).over(near) == 1)
    else:
        rows = rows.withColumn("_tw", F.col("_t")).withColumn("_pw", F.col("_p"))
    c = lambda x: F.count_if(x).cast("double")
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), c(F.col("_p") & F.col("_tw")).alias("_tpp"), c(F.col("_p")).alias("_pp"), c(F.col("_t") & F.col("_pw")).alias("_tpr"), c(F.col("_t")).alias("_tt"), c(F.col("_t") == F.col("_p")).alias("_ok"), c(F.col("_t") & F.col("_p")).alias("_tp"))
    z = lambda x: F.coalesce(x, F.lit(0.0))
    out = out.withColumn("precision", z(F.try_divide(F.col("_tpp"), F.col("_pp")))).withColumn("recall", z(F.try_divide(F.col("_tpr"), F.col("_tt"))))
    out = out.withColumn("f1", z(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))).withColumn("accuracy", F.col("_ok") / F.col("n"))
    tp, fp, fn = F.col("_tp"), F.col("_pp") - F.col("_tp"), F.col("_tt") - F.col("_tp")
    tn = F.col("n") - tp - fp - fn
    out = out.withColumn("mcc", z(F.try_divide(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))))
    return out.select(*by, "n", "precision", "recall", "f1", "accuracy", "mcc")


def range_scores(true: DataFrame, pred: DataFrame, alpha: float = 0.5, start: str = "start_ts", end: str = "end_ts") -> DataFrame:
    """Range-based precision and recall of intervals: alpha * whether a range is met at all + (1 - alpha) * the share of it that is."""

    def score(of: DataFrame, others: DataFrame, name: str) -> DataFrame:
        x = of.select(F.col(start).cast("long").alias("a"), F.col(end).cast("long").alias("b")).distinct()
        y = others.select(F.col(start).cast("long").alias("c"), F.col(end).cast("long").alias("d")).distinct()
        # ranges meet on the days that they touch, so it's an equi-join
        days = lambda p, q: F.explode(F.sequence(F.floor(F.col(p) / 86400), F.floor(F.col(q) / 86400))).alias("day")
        met = x.select("*", days("a", "b")).join(y.select("*", days("c", "d")), "day").where("a <= d and c <= b").drop("day").distinct()
        both = x.join(met, ["a", "b"], "left")
        overlap = F.coalesce(F.sum(F.when(F.col("c").isNotNull(), F.least("b", "d") - F.greatest("a", "c") + 1)), F.lit(0))
        each = both.groupBy("a", "b").agg(overlap.alias("o"), F.count("c").alias("k"))
        hit = F.when(F.col("k") > 0, 1.0).otherwise(0.0)
        return each.agg(F.avg(alpha * hit + (1 - alpha) * F.least(F.col("o") / (F.col("b") - F.col("a") + 1), F.lit(1.0))).alias(name))

    return score(pred, true, "precision").crossJoin(score(true, pred, "recall"))


def dedupe_actuals(df: DataFrame, metric: str = "metric_id", time_col: str = "forecasted_date", actual: str = "actual", tolerance: float = 0.001) -> DataFrame:
    """One actual for each metric and date of all partitions that hold one, and whether they agree."""
    out = df.where(F.col(actual).isNotNull()).groupBy(metric, time_col).agg(F.avg(actual).alias("actual"), F.stddev_samp(actual).alias("actual_std"), F.min(actual).alias("actual_min"), F.max(actual).alias("actual_max"), F.count(actual).alias("n_partitions"))
    cv = F.try_divide(F.coalesce("actual_std", F.lit(0.0)), F.abs("actual"))
    return out.withColumn("consistent", F.coalesce(cv <= tolerance, F.col("actual_std").isNull() | (F.col("actual_std") == 0)))


def training_cutoffs(df: DataFrame, cutoff: str = "last_training_date", lookback_days: int | None = None) -> DataFrame:
    """Distinct cutoffs, within so many days of the newest."""
    days = df.select(F.col(cutoff).cast("date").alias(cutoff)).distinct()
    if lookback_days is None:
        return days
    newest = days.agg(F.max(cutoff).alias("_m"))
    return days.crossJoin(F.broadcast(newest)).where(F.date_diff("_m", cutoff) <= lookback_days).drop("_m")


def live_forecasts(df: DataFrame, max_days: int, cutoffs: DataFrame | None = None, cutoff: str = "last_training_date", date: str = "forecasted_date") -> DataFrame:
    """Forecast rows 1 to max_days days after their cutoff, with horizon_step."""
    step = F.date_diff(F.col(date).cast("date"), F.col(cutoff).cast("date"))
    rows = df.where("stage = 'forecast'").withColumn("horizon_step", step).where(F.col("horizon_step").between(1, max_days))
    if cutoffs is not None:
        rows = rows.join(cutoffs.select(F.col(cutoff).alias("_c")), F.col(cutoff).cast("date") == F.col("_c"), "left_semi")
    return rows


def live_eval(df: DataFrame, max_days: int, metric: str = "metric_id", date: str = "forecasted_date", **how) -> DataFrame:
    """Evaluation by metric and horizon of what was forecast against the actuals that all partitions hold since."""
    actuals = dedupe_actuals(df, metric, date).select(metric, date, F.col("actual").alias("_a"))
    rows = live_forecasts(df, max_days, date=date).join(actuals, [metric, date], "left").withColumn("actual", F.col("_a")).drop("_a")
    return evaluate_by_horizon(rows, metric, **how)


def empirical_distribution(df: DataFrame, col: str, by: Sequence[str], quantiles: Sequence[float] = (0.025, 0.5, 0.975), least: int = 5) -> DataFrame:
    """Quantiles, mean, sd and count of residuals for each group; small groups take those of all rows."""
    def aggs(tag: str) -> list[Column]:
        return [F.percentile(F.col(col), F.array(*[F.lit(q) for q in quantiles])).alias(f"{tag}quantiles"), F.avg(col).alias(f"{tag}mean"), F.stddev_samp(col).alias(f"{tag}sd"), F.count(col).alias(f"{tag}n")]

    every = df.agg(*aggs("_"))
    own = df.groupBy(*by).agg(*aggs("")).crossJoin(F.broadcast(every))
    few = F.col("n") < least
    return own.select(*by, *[F.when(few, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in ("quantiles", "mean", "sd")], "n")


def conditional_intervals(df: DataFrame, fitted: DataFrame, residual: str, by: Sequence[str], coverage: float = 0.95, forecast: str = "forecast", least: int = 5) -> DataFrame:
    """Forecasts with bounds from the residuals' quantiles of their group."""
    tail = (1 - coverage) / 2
    law = empirical_distribution(fitted, residual, by, (tail, 1 - tail), least).select(*by, "quantiles", "sd")
    out = match(df, law, by, "left")
    return out.withColumn("forecast_lower", F.col(forecast) + F.get("quantiles", F.lit(0))).withColumn("forecast_upper", F.col(forecast) + F.get("quantiles", F.lit(1))).withColumn("std", F.col("sd")).drop("quantiles", "sd")


def detect(df: DataFrame, actual: str = "actual", forecast: str = "forecast", lower: str = "forecast_lower", upper: str = "forecast_upper", ape: float | None = None, sape: float | None = None, outside: bool = True) -> DataFrame:
    """is_anomaly_predicted: outside the bounds and beyond each threshold that is set (percent), with a score in half-widths."""
    a, p = F.col(actual), F.col(forecast)
    tests = []
    if outside:
        tests.append((a < F.col(lower)) | (a > F.col(upper)))
    if ape is not None:
        tests.append(F.abs(F.try_divide(a - p, a)) * 100 > ape)
    if sape is not None:
        tests.append(F.abs(F.try_divide(a - p, F.abs(a) + F.abs(p))) * 100 > sape)
    flag = F.lit(True)
    for t in tests:
        flag = flag & F.coalesce(t, F.lit(False))
    half = (F.col(upper) - F.col(lower)) / 2
    return df.withColumn("is_anomaly_predicted", flag).withColumn("anomaly_score", F.try_divide(F.abs(a - p), half))


def fraction_outside_tolerance(actual: Column, forecast: Column, tolerance: float = 0.05) -> Column:
    return F.avg(F.when(F.abs(forecast - actual) > tolerance * F.abs(actual), 1.0).otherwise(0.0))


def confusion(df: DataFrame, true: str = "is_anomaly", pred: str = "is_anomaly_predicted", by: Sequence[str] = ()) -> DataFrame:
    """Counts of each combination of truth and prediction, and informedness (recall of both classes less 1)."""
    t, p = F.coalesce(F.col(true), F.lit(False)), F.coalesce(F.col(pred), F.lit(False))
    c = lambda x: F.count_if(x)
    out = df.groupBy(*by).agg(c(t & p).alias("tp"), c(~t & p).alias("fp"), c(t & ~p).alias("fn"), c(~t & ~p).alias("tn"))
    return out.withColumn("informedness", F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col("fn")).cast("double")) + F.try_divide(F.col("tn").cast("double"), (F.col("tn") + F.col("fp")).cast("double")) - 1)


def aggregated(df: DataFrame, columns: Sequence[str], rows: int, time_col: str, by: Sequence[str] = ()) -> DataFrame:
    """Sums over runs of so many rows, counted back from the last; a run that isn't full at the start goes."""
    back = F.row_number().over(W.partitionBy(*by).orderBy(F.desc(time_col))) - 1
    out = df.withColumn("_g", F.floor(back / rows)).groupBy(*by, "_g").agg(F.max(time_col).alias(time_col), *[F.sum(c).alias(c) for c in columns], F.count("*").alias("_n"))
    return out.where(F.col("_n") == rows).drop("_g", "_n")


def best_forecast(df: DataFrame, forecasts: Sequence[str], actual: str = "actual", by: Sequence[str] = ()) -> DataFrame:
    """Of several forecast columns the one of least mean absolute error in each group."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("name"), F.abs(F.col(actual) - F.col(f)).alias("e")) for f in forecasts])).alias("x")
    scored = df.select(*by, each).groupBy(*by, "x.name").agg(F.avg("x.e").alias("mae"))
    return scored.groupBy(*by).agg(F.min_by("name", F.struct("mae", "name")).alias("best"), F.min("mae").alias("mae"))
