"""A null dim is a series like others: every function that takes dims gives it the rows that a named dim gets."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cohortry.operators import evaluation, experiments, forecast, series
from cohortry.specs import Metric

DAY = datetime(2024, 1, 1)
D = ["d"]
CASES = {
    "regularize": lambda df: series.regularize(df, "ts", ["v"], "D", D),
    "find_gaps": lambda df: series.find_gaps(df, "ts", D),
    "describe": lambda df: series.describe(df, "ts", D),
    "infer_freq": lambda df: series.infer_freq(df, "ts", D),
    "coarsen": lambda df: series.coarsen(df, "ts", "W", "sum", ["v"], D),
    "share": lambda df: series.share_within_period(df, "ts", ["v"], "D", "W", D),
    "date_lags": lambda df: series.date_lags(df, "ts", "v", "D", [1], D),
    "date_lags_month": lambda df: series.date_lags(df, "ts", "v", "M", [1], D),
    "date_diff": lambda df: series.date_diff(df, "ts", "v", "D", [1, 2], dims=D),
    "lags": lambda df: series.lags(df, "ts", "v", [1], D),
    "agg_lags": lambda df: series.agg_lags(df, "ts", "v", [(1, 2)], [(1, 3)], dims=D),
    "impute": lambda df: series.impute_with_lags(df, "ts", "v", [1], dims=D),
    "interpolate": lambda df: series.interpolate(df, "ts", "v", D),
    "fill": lambda df: series.fill(df, "ts", "v", dims=D),
    "normalize": lambda df: series.normalize(df, ["v"], "statistical", dims=D),
    "zscore": lambda df: series.zscore_outliers(df, "v", dims=D),
    "tukey": lambda df: series.tukey_outliers(df, "v", dims=D),
    "islands": lambda df: series.islands(df.withColumn("f", F.col("v") > 4), "ts", "f", D),
    "level_shifts": lambda df: series.level_shifts(df, "ts", "v", dims=D),
    "label_intervals": lambda df: series.label_intervals(df, df.where("v < 3").select("d", F.col("ts").alias("start_ts"), F.col("ts").alias("end_ts")), "ts", on=D),
    "seasonal_mean": lambda df: forecast.seasonal_mean(df, "ts", "v", 2, 2, 3, dims=D),
    "similarity": lambda df: forecast.similarity(df, df.select("d", "ts"), "v", [], dims=D),
    "null_model": lambda df: forecast.null_model(df, "v", dims=D),
    "backfill": lambda df: forecast.backfill(df, "ts", "v", [4], 2, lambda x, k: forecast.seasonal_mean(x, "ts", "v", 2, 2, 2, dims=k), dims=D),
    "intervals": lambda df: evaluation.conditional_intervals(df.withColumn("forecast", F.col("v")), df, "v", D),
    "jackknife": lambda df: experiments.jackknife(df.withColumn("jk_bucket", F.dayofmonth("ts") % 3), 3, *experiments.ratio_sums(Metric("v", denominator="v")), by=D),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_null_is_a_series(spark, name):
    days = [i for i in range(9) if i != 5]
    rows = [(d, DAY + timedelta(days=i), float(i * i % 7 + 1)) for d in ("a", None) for i in days]
    out = CASES[name](spark.createDataFrame(rows, "d string, ts timestamp, v double")).collect()
    plain = lambda d: sorted(str([r[c] for c in r.asDict() if c != "d"]) for r in out if r.d == d)
    assert plain("a") == plain(None) and plain("a")
