"""The further operators on a few rows."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortry.functions import time as T
from cohortry.operators import evaluation, experiments, forecast, metrics, relational, rewards, selection, series, simulate
from cohortry.specs import Experiment, Launch, Metric, MetricSource, UnitMetric

DAY = datetime(2024, 1, 1)


def daily(spark, values, **dims):
    return spark.createDataFrame([(DAY + timedelta(days=i), float(v)) for i, v in enumerate(values)], "ts timestamp, v double")


def test_times(spark):
    assert T.lag_rows([1, 2, 3], "D", "W-SAT") == [7, 14, 21] and T.rows_per_period("D", "D") == 1 and T.rows_per_period("s", "min") == 60
    assert [T.default_horizon(s) for s in (60, 600, 604, 3600, 21600, 21781, 86400, 172800, 177121, 604800, 2.6e6, 5.3e6, 7.9e6, 3.18e7, 3.2e7)] == [60, 60, 24, 24, 24, 30, 30, 30, 12, 12, 12, 12, 2, 2, 2] and T.default_horizon(86400, 20) == 10
    assert T.window_end("2024-06-01-00", 7) == "2024-06-08-00" and T.window_end("2024-02-28", 2) == "2024-03-01"
    # whole years of both calendars have months of the right lengths, one after the other, and start where they should
    days = spark.range(20_000).select(F.date_add(F.lit("1990-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    for made, lengths in ((T.hijri, [30, 29] * 6), (T.persian, [31] * 6 + [30] * 5 + [29])):
        got = days.select("d", made(F.col("d")).alias("c")).groupBy("c.year", "c.month").agg(F.count("*").alias("n"), F.min("c.day").alias("a"), F.max("c.day").alias("b")).orderBy("year", "month").collect()[1:-1]
        assert all(r.a == 1 and r.n == r.b and r.n - lengths[r.month - 1] in ((0, 1) if r.month == 12 else (0,)) for r in got)
        assert all(y.month == x.month % 12 + 1 and y.year == x.year + (x.month == 12) for x, y in zip(got, got[1:], strict=False))
    # known days of both calendars
    known = [("2024-03-19", (1402, 12, 29)), ("2024-03-20", (1403, 1, 1)), ("2024-06-21", (1403, 4, 1)), ("2024-06-23", (1403, 4, 3)), ("2000-03-20", (1379, 1, 1)), ("1996-03-20", (1375, 1, 1)), ("1979-03-21", (1358, 1, 1))]
    for day, want in known:
        assert tuple(spark.range(1).select(T.persian(F.lit(day)).alias("p")).first().p) == want, day
    assert tuple(spark.range(1).select(T.hijri(F.lit("2024-07-08")).alias("h")).first().h) == (1446, 1, 1)


def test_families(spark):
    units = simulate.population(spark, 4000)
    arms = [("control", 0.5), ("v1", 0.5)]
    e = [Experiment(f"e{i}", simulate.assign(units, arms, 13 + 10 * i, 0.1)) for i in range(2)]
    merged = experiments.merge_experiments(e)
    rows = simulate.respond(merged, 10, 2, {(1, "v1"): 1.0}, name="x").withColumn("y", F.lit(2.0)).select("unit", "x", "y")
    source = MetricSource("s", "unit", (UnitMetric("x", "SUM", "x"), UnitMetric("y", "SUM", "y")), (Metric("x"), Metric("x", denominator="y", name="rate"), Metric("y")))
    found = experiments.run_families(e, [(rows, source)], [Launch(("v1", "v1"))])
    got = {r.metric: r for r in found.effects.collect()}
    assert set(got) == {"x", "rate", "y"} and got["rate"].method == "jackknife" and got["x"].method == "simple"
    assert 0.4 < got["x"].delta < 1.0 and abs(got["rate"].delta - got["x"].delta / 2) < 0.02 and got["y"].delta == 0
    assert {r.metric for r in found.significant().collect()} == {"x", "rate"}
    both = found.combined(found)
    assert both.effects.count() == 6 and both.variant_stats.count() == 2 * found.variant_stats.count()
    control = experiments.against_control(experiments.variant_stats(experiments.with_metrics(merged, rows), ["x"]), ("control", "control"))
    assert {r.pair for r in control.collect()} == {"v1|control", "control|v1", "v1|v1"}


def test_relations(spark):
    a = spark.createDataFrame([(1, None, 1.0), (2, "x", 2.0)], "k long, d string, v double")
    assert [tuple(r) for r in relational.side_by_side([a, a], ["k", "d"], ["v"]).orderBy("k").collect()] == [(1, None, 1.0, 1.0), (2, "x", 2.0, 2.0)]
    assert relational.sample(a, 0).schema == a.schema and relational.sample(a, 0).count() == 0 and relational.sample(a).count() == 2
    assert {(r.relation, r.column) for r in metrics.inspect({"a": a}).collect()} == {("a", "k"), ("a", "d"), ("a", "v")}
    m = spark.createDataFrame([({"b": 1, "a": 2},)], "m map<string, int>").select(metrics.json_of(F.col("m"))).first()[0]
    assert m == '{"a":2,"b":1}'


def test_futures(spark):
    df = daily(spark, range(10))
    made = forecast.recursive_lags(df, "ts", "v", "D", [1, 3], 4).orderBy("ts").collect()
    seen = [float(i) for i in range(10)]
    for r in made:
        seen.append((seen[-1] + seen[-3]) / 2)
        assert abs(r.forecast - seen[-1]) < 1e-12
    assert made[0].ts == DAY + timedelta(days=10) and [r.horizon_step for r in made] == [1, 2, 3, 4]
    frame = spark.createDataFrame([(DAY, "forecast", 5.0, 2.0), (DAY, "fitted", 1.0, 1.0)], "ts timestamp, stage string, forecast double, std double")
    out = forecast.simulate_futures(frame, 4000, 3)
    r = out.agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.stddev("value").alias("s")).first()
    assert r.n == 4000 and abs(r.m - 5) < 0.15 and abs(r.s - 2) < 0.15
    assert out.agg(F.sum("value")).first() == forecast.simulate_futures(frame, 4000, 3).agg(F.sum("value")).first()
    weekly = daily(spark, [100 * (i // 7) + i % 7 for i in range(28)])
    fit = lambda period, k: lambda d, dims: forecast.seasonal_mean(d, "ts", "v", period, k, 7, "D", dims=dims)
    two = forecast.multistage(weekly, "ts", "v", "week", lambda d, dims: d.select(*dims, "ts", F.lit("fitted").alias("stage"), F.col("v").alias("forecast")), fit(7, 2))
    late = {r.ts.day: r.forecast for r in two.where("stage = 'fitted'").collect()}
    assert all(abs(late[i + 1] - (100 * (i // 7) + i % 7)) < 1e-9 for i in range(7, 28))
    assert forecast.grouping_columns(frame.withColumn("country", F.lit("x"))) == ["country"]


def test_steps_of_their_own_models(spark):
    df = daily(spark, [i % 7 for i in range(28)])
    level = lambda x: lambda d, dims: forecast.seasonal_mean(d, "ts", "v", 7, 1, 3, dims=dims).withColumn("forecast", F.col("forecast") + x)
    out = forecast.one_by_one(df, [level(0), level(10), level(20)]).orderBy("ts").collect()
    assert [(r.horizon_step, r.forecast) for r in out] == [(1, 0.0), (2, 11.0), (3, 22.0)]


def test_detection_flow(spark):
    from cohortry.operators.flow import Flow

    ev = spark.createDataFrame([(0, DAY + timedelta(days=d), float(d % 7 + 1 + (50 if d == 30 else 0))) for d in range(35)], "u long, t timestamp, v double")
    found = Flow(MetricSource("s", "u", (UnitMetric("v", "SUM", "v"),), (Metric("v"),)), "v", "t", params={"k": 2}).detect(ev)
    assert [r.ts.day for r in found.where("is_anomaly_predicted").collect()] == [31]


def test_regression_helpers():
    from cohortry.operators.regression import spaced, summary

    rng = np.random.default_rng(0)
    x = np.stack([np.ones(200), rng.normal(size=200), rng.normal(size=200)], 1)
    got = summary(x, x @ [1.0, 2.0, 0.0] + 0.1 * rng.normal(size=200), ["one", "two", "none"])
    assert abs(got[1]["coefficient"] - 2) < 0.05 and got[1]["p"] < 1e-6 and got[2]["p"] > 0.001 and abs(got[0]["dof"] - 197) < 1e-6
    assert spaced([1, 2, 10, 11], [0.5, 0.9, -2, 1], 3) == [2, 10] and spaced([], [], 1) == []


def test_quantile_bounds_and_free_columns(spark):
    from cohortry.operators.regression import Model, quantile_forecast, ridge

    rng = np.random.default_rng(1)
    df = daily(spark, 5 + rng.exponential(1, 300))
    out = quantile_forecast(df, "ts", "v", 2, model=Model(changepoints=0, seasons=(), alpha=1e-6, coverage=0.8))
    r = out.where("stage = 'fitted'").agg(F.avg((F.col("actual") < F.col("forecast_lower")).cast("int")), F.avg((F.col("actual") > F.col("forecast_upper")).cast("int"))).first()
    assert abs(r[0] - 0.1) < 0.03 and abs(r[1] - 0.1) < 0.03 and out.where("stage = 'forecast'").count() == 2
    x = np.stack([np.ones(50), np.arange(50.0), np.arange(50.0) ** 2], 1)
    held = ridge(x, 3 * x[:, 1], 1e12, free=(0, 1))
    assert abs(held[1] - 3) < 1e-3 and abs(held[2]) < 1e-3


def test_mint_adds_up_and_weighs_errors(spark):
    rng = np.random.default_rng(0)
    days = [(DAY + timedelta(days=i)).isoformat() for i in range(200)]
    rows = []
    for d in days:
        a, b = rng.normal(0, 1), rng.normal(0, 10)
        rows += [(d, "a", a, 0.0), (d, "b", b, 0.0), (d, "all", rng.normal(0, 1), 0.0)]
    errors = spark.createDataFrame(rows, "ts string, node string, actual double, forecast double")
    tree = {"all": ["a", "b"]}
    new = spark.createDataFrame([("t", "a", 10.0), ("t", "b", 20.0), ("t", "all", 36.0)], "ts string, node string, forecast double")
    got = {r.node: r.forecast for r in forecast.reconcile_mint(new, errors, ["all", "a", "b"], ["a", "b"], tree, "ts").collect()}
    assert abs(got["all"] - got["a"] - got["b"]) < 1e-9
    # the leaf with the large errors takes nearly all of what is missing
    assert abs(got["b"] - 26) < 0.5 and abs(got["a"] - 10) < 0.5 and abs(got["all"] - 36) < 0.5


def test_series(spark):
    df = daily(spark, [1, 2, 3, 4])
    with pytest.raises(ValueError):
        series.with_group(df, "ts")
    assert [r.group for r in series.with_group(df, "ts", feature="dow").orderBy("ts").collect()] == [1, 2, 3, 4]
    assert {r.group for r in series.with_group(df, "ts", rows=3).collect()} == {DAY, DAY + timedelta(days=1)}
    made = series.canonical(df.withColumn("x", F.lit(1.0)), "ts", "v", "D", regressors=["x"], train_end="2024-01-02").orderBy("ts").collect()
    assert [(r.y, r.x, r.stage) for r in made] == [(1.0, 1.0, "train"), (2.0, 1.0, "train"), (None, 1.0, "future"), (None, 1.0, "future")]
    assert series.canonical(df.where("v > 9"), "ts", "v", "D").count() == 0


def test_rewards(spark):
    s = spark.createDataFrame([(1, 0.9, 0.5, 4.0), (2, 0.6, 0.9, 6.0), (3, None, 0.95, 50.0)], "k int, recall double, precision double, anomaly_percent double")
    recall, precision = rewards.Reward.of("recall"), rewards.Reward.of("precision")
    f1 = (2 * recall * precision) / (recall + precision)
    got = {r.k: r.reward for r in rewards.ranked(s, f1).collect()}
    assert abs(got[1] - 2 * 0.45 / 1.4) < 1e-12 and got[3] is None
    assert [r.k for r in rewards.ranked(s.where("k < 3"), rewards.reward_of("recall", "precision", 0.8)).collect()] == [2, 1]
    near = {r.k: r.reward for r in rewards.ranked(s, rewards.reward_of(target_percent=5.0)).collect()}
    assert abs(near[1] + 0.01) < 1e-12 and abs(near[3] + 0.45) < 1e-12
    half = {r.k: r.reward for r in rewards.ranked(s, 1 - precision.penalized(least=0.8, penalty=0.5, multiply=True)).collect()}
    assert half[1] == 0.75 and abs(half[2] - 0.1) < 1e-12
    with pytest.raises(ValueError):
        rewards.reward_of()


def test_regression_of_all_frequencies(spark):
    from cohortry.operators.regression import Model, regression_forecast

    steps = {"s": "interval 1 second", "min": "interval 1 minute", "h": "interval 1 hour", "D": "interval 1 day", "W": "interval 7 days", "M": "interval 1 month", "Q": "interval 3 months", "Y": "interval 1 year"}
    for freq, step in steps.items():
        df = spark.range(24).select(F.expr(f"timestamp'2000-01-01' + {step} * id").alias("ts"), (2.0 * F.col("id") + 1).alias("v"))
        out = regression_forecast(df, "ts", "v", 3, freq, Model(changepoints=0, seasons=(), alpha=1e-6)).where("stage = 'forecast'").orderBy("ts").collect()
        want = [r.ts for r in spark.range(24, 27).select(F.expr(f"timestamp'2000-01-01' + {step} * id").alias("ts")).orderBy("ts").collect()]
        assert [r.ts for r in out] == want, freq
        assert all(abs(r.forecast - w) < 4 for r, w in zip(out, (49, 51, 53), strict=True)), freq
    with pytest.raises(ValueError):
        regression_forecast(df, "ts", "v", 3, "x")


def test_upsert_of_tables(spark):
    from cohortry.sources.tables import upsert_table, write_table

    old = spark.createDataFrame([(1, "a", "p"), (2, "b", "p"), (3, "c", "q")], "k long, v string, d string")
    new = spark.createDataFrame([(2, "z", "p"), (4, "y", "p")], "k long, v string, d string")
    want = [(1, "a", "p"), (2, "z", "p"), (3, "c", "q"), (4, "y", "p")]
    for name, partition in (("upsert_whole", None), ("upsert_parts", "d")):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        if partition:
            old.write.partitionBy(partition).saveAsTable(name)
        else:
            write_table(old, name)
        upsert_table(new, name, ["k", "d"], partition)
        assert sorted(map(tuple, spark.table(name).select("k", "v", "d").collect())) == want
        assert not spark.catalog.tableExists(f"{name}_before") and not spark.catalog.tableExists(f"{name}_next")
        spark.sql(f"DROP TABLE {name}")


def test_records_are_scored_again(spark, tmp_path):
    rows = spark.createDataFrame([("a", "g", 1.0, 1.0), ("a", "h", 1.0, 3.0), ("b", "g", 1.0, 2.0), ("b", "h", 1.0, 2.0)], "candidate_id string, g string, actual double, forecast double")
    full = rows.withColumn("forecast_lower", F.lit(None).cast("double")).withColumn("forecast_upper", F.lit(None).cast("double"))
    for run in ("r1", "r2"):
        selection.record(full, str(tmp_path / "log"), run)
    log = spark.read.parquet(str(tmp_path / "log"))
    assert log.count() == 8
    one = log.where("run_id = 'r1'")
    assert [r.score for r in selection.rescore(one, ["g"], reduction="max").collect()] == [1.0, 2.0]
    assert selection.rescore(one, ["g"], reduction="min").first().candidate_id == "a"
    assert math.isclose(evaluation.evaluate_groups(one, ["candidate_id"], evaluation.elementwise(F.col("actual"), F.col("forecast")), {"squared_error": F.avg}).where("candidate_id = 'a'").first().squared_error, 2.0)
