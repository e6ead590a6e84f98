"""Semantics on a few rows: nulls, ties, gaps, missing groups."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortry.functions.time import period_end, rows_per_period, shift
from cohortry.operators import evaluation, experiments, forecast, journey, metrics, regression, relational, selection, series, simulate
from cohortry.specs import ComparisonPair, Experiment, Launch, Metric, MetricSource, UnitMetric, consistent

DAY = datetime(2024, 1, 1)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def days(spark, values, **dims):
    return spark.createDataFrame([(DAY + timedelta(days=i), v) for i, v in values], "ts timestamp, v double")


def test_three_way_merge_is_one_row(spark):
    frames = [spark.createDataFrame(r, "unit string, variant string") for r in ([("u", "a")], [("w", "b")], [("u", "c")])]
    merged = experiments.merge_experiments([Experiment(str(i), f) for i, f in enumerate(frames)])
    assert rows(merged.select("unit", experiments.shown(F.col("variant")))) == [("u", "a|nan|c"), ("w", "nan|b|nan")]


def test_units_without_metrics_count(spark):
    merged = spark.createDataFrame([(i, ["a"]) for i in range(4)], "unit long, variant array<string>")
    values = spark.createDataFrame([(0, 2.0), (1, 4.0)], "unit long, x double")
    for unit in ((), (UnitMetric("x", name="x", fill_na=0.0),)):
        r = experiments.variant_stats(experiments.with_metrics(merged, values, unit), ["x"]).first()
        assert (r.sample_count, r.sum, r.mean) == (4, 6.0, 1.5) and abs(r.sd - math.sqrt(20 / 4 - 1.5**2)) < 1e-12


def test_specs():
    assert len(Launch(("a", "b")).variants()) == 3 and Launch(("a",)).variants() == (("a",),)
    pair = ComparisonPair((("a",), ("b",)), (("b",), ("c",)))
    assert pair.treatment == (("a",),) and pair.control == (("c",),)
    with pytest.raises(ValueError):
        ComparisonPair((("a",),), (("a",),))
    with pytest.raises(ValueError):
        Launch(("nan",))
    assert consistent(("a", "b"), (None, "b")) and not consistent(("a", "b"), ("b", None))


@pytest.mark.parametrize(("n", "b"), [(7, 3), (5, 4), (103, 20)])
def test_jackknife_matches_leave_one_out(spark, n, b):
    rng = np.random.default_rng(n)
    x, y = rng.normal(10, 2, n), rng.integers(1, 5, n).astype(float)
    df = spark.createDataFrame([(i, float(x[i]), float(y[i])) for i in range(n)], "unit long, x double, y double")
    sums, estimate = experiments.ratio_sums(Metric("x", denominator="y"))
    r = experiments.jackknife(experiments.bucketed(df, ["unit"], b), b, sums, estimate).first()
    size = -(-n // b)
    left = np.array([np.delete(x, range(i * size, min(n, (i + 1) * size))).sum() / np.delete(y, range(i * size, min(n, (i + 1) * size))).sum() for i in range(b)])
    whole = x.sum() / y.sum()
    assert abs(r.estimate - whole) < 1e-9 and abs(r.jk_estimate - (whole - (b - 1) * (left.mean() - whole))) < 1e-9 and abs(r.jk_var - (b - 1) * left.var()) < 1e-9


def test_mea_recovers_a_simulated_effect(spark):
    units = simulate.population(spark, 20_000)
    arms = [("control", 0.5), ("v1", 0.5)]
    e = [Experiment(f"e{i}", simulate.assign(units, arms, 13 + 10 * i, 0.1)) for i in range(2)]
    merged = experiments.merge_experiments(e)
    values = simulate.respond(merged, 10, 2, {(1, "v1"): 0.5, (2, "v1"): 0.3}).select("unit", "metric")
    r = experiments.run_mea(e, values, ["metric"], [Launch(("v1", "v1"))]).first()
    assert r.ci_lower < r.delta < r.ci_upper and 0.6 < r.delta < 0.9 and r.p_value < 1e-6


def test_journeys(spark):
    ev = [(0, "a"), (1, "a"), (2, "b"), (3, "b"), (4, "a")]
    df = spark.createDataFrame([(1, DAY + timedelta(minutes=t), e, t) for t, e in ev] + [(2, DAY, None, 0), (2, DAY, "z", 2), (2, DAY, "y", 1)], "k long, time timestamp, event string, tie long")
    seq = lambda m, **o: {r.k: r.event_seq for r in journey.sequences(df, ["k"], m, **o).collect()}
    assert seq("undeduped") == {1: list("aabba"), 2: ["y", "z"]} and seq("consecutive") == {1: list("aba"), 2: ["y", "z"]}
    assert seq("full") == {1: ["a", "b"], 2: ["y", "z"]} and seq("full", order=["b"]) == {1: ["b", "a"], 2: ["y", "z"]}
    assert {r.k: r.event_count_map for r in journey.count_map(df, ["k"]).collect()} == {1: {"a": 3, "b": 2}, 2: {"y": 1, "z": 1}}
    r = journey.consecutive(df, ["k"]).where("k = 1").first()
    assert r.seq_end_time == DAY + timedelta(minutes=4) and r.seq_length == 3
    heads = journey.heads(journey.undeduped(df, ["k"]), 3).where("k = 2").first()
    assert (heads.s1, heads.s2, heads.s3) == ("y", "z", None)
    with pytest.raises(ValueError):
        journey.sequences(df, ["k"], "other")


def test_conversion(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, None), (4, ["a"])], "k long, event_seq array<string>")
    r = journey.conversion(df, ["a", "b", "b"], ["b"], every_numerator=True).first()
    assert (r.numerator_count, r.denominator_count, r.conversion_rate) == (1, 1, 1.0)
    r = journey.conversion(df, ["a"], ["b"]).first()
    assert r.conversion_rate == 2.0 and journey.conversion(df, ["q"], ["q"]).first().conversion_rate is None
    assert journey.conversion(df, None, None).first().numerator_count == 4


def test_anti_join_and_upsert(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (2, "c")], "k long, v string")
    units = spark.createDataFrame([(1,)], "u long")
    assert rows(relational.anti(df, units, "k", "u")) == [(2, "c")]
    new = spark.createDataFrame([(2, "z"), (3, "y")], "k long, v string")
    assert rows(relational.upsert(df.where("k is not null"), new, ["k"])) == [(1, "a"), (2, "z"), (3, "y")]
    with pytest.raises(ValueError):
        relational.join(df, units, (), "inner")


def test_segments_leave_null_units_to_raw(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (None, 4.0)], "k long, x double")
    src = MetricSource("s", "k", (UnitMetric("x", "SUM", "x"),), (Metric("x"),))
    got = {r.segment: r.x for r in metrics.segments(df, spark.createDataFrame([(1,)], "k long"), src).collect()}
    assert got == {"raw": 7.0, "impacted": 1.0, "complement": 2.0}


def test_coarsen_and_share(spark):
    df = days(spark, [(i, None if i < 7 else 1.0) for i in range(-1, 14)])
    got = {str(r.ts): r.v for r in series.coarsen(df, "ts", "W", "sum", ["v"]).collect()}
    assert got == {"2023-12-31": 0.0, "2024-01-07": 0.0, "2024-01-14": 7.0}
    assert {str(r.ts): r.v for r in series.coarsen(df, "ts", "W", "mean", ["v"]).collect()}["2024-01-07"] is None
    share = {r.ts.day: r.v_share for r in series.share_within_period(df, "ts", ["v"], "D", "W").collect() if r.ts.month == 1}
    assert share[1] is None and abs(share[8] - 1 / 7) < 1e-12
    ends = spark.createDataFrame([(DAY,)], "t timestamp").select(period_end(F.col("t"), "W-SAT"), period_end(F.col("t"), "M"), period_end(F.col("t"), "Q")).first()
    assert list(map(str, ends)) == ["2024-01-06", "2024-01-31", "2024-03-31"]
    with pytest.raises(ValueError):
        rows_per_period("D", "M")


def test_date_lags_are_exact(spark):
    df = days(spark, [(0, 1.0), (1, 2.0), (3, 5.0)])
    got = {r.ts.day: r.v_diff for r in series.date_diff(df, "ts", "v", "D").collect()}
    assert got == {1: None, 2: 1.0, 4: None}
    end = spark.createDataFrame([(datetime(2024, 1, 31),)], "t timestamp").select(shift(F.col("t"), "M", 1)).first()[0]
    assert end == datetime(2024, 2, 29)


def test_regularize_and_intervals(spark):
    df = spark.createDataFrame([(DAY, 3.0), (DAY, 1.0), (DAY + timedelta(days=3), float("inf"))], "ts timestamp, v double")
    assert [(r.ts.day, r.v) for r in series.regularize(df, "ts", ["v"], "D").orderBy("ts").collect()] == [(1, 1.0), (2, None), (3, None), (4, None)]
    h = lambda x: DAY + timedelta(hours=x)
    iv = spark.createDataFrame([(h(0), h(2)), (h(2), h(3)), (h(1), h(9)), (h(4), h(5)), (h(12), h(12)), (h(20), h(19)), (h(23), h(50))], "start_ts timestamp, end_ts timestamp")
    assert rows(series.merge_intervals(iv)) == sorted([(h(0), h(9)), (h(12), h(12)), (h(23), h(50))], key=str)
    points = spark.createDataFrame([(h(9),), (h(10),), (h(12),), (h(40),)], "ts timestamp")
    for by_days in (True, False):
        assert [r.is_anomaly for r in series.label_intervals(points, iv, "ts", days=by_days).orderBy("ts").collect()] == [True, False, True, True]


def test_labels_of_times(spark):
    """Against each compared with each: short and very long intervals, ends and times on the borders of spans, times before 1970, nulls."""
    rng = random.Random(4)
    at = lambda: datetime(1969, 12, 31) + timedelta(seconds=300 * rng.randrange(600), microseconds=rng.choice([0, 0, 1, 999999]))
    iv = [(rng.choice(["a", "b", None]), a, a + timedelta(seconds=rng.choice([-60, 0, 1, 599, 600, 3000]))) for a in (at() for _ in range(60))]
    iv += [("a", datetime(1969, 12, 31, 20), datetime(1970, 1, 1, 6)), ("far", datetime(1900, 1, 1), datetime(1970, 1, 1, 0, 0, 1)), ("a", None, datetime(2000, 1, 1)), ("b", datetime(1960, 1, 1), None)]
    points = [(i, rng.choice(["a", "b", None, "far", "none"]), rng.choice([at(), at(), rng.choice(iv)[rng.choice([1, 2])]])) for i in range(400)]
    got = series.label_intervals(spark.createDataFrame(points, "i long, d string, ts timestamp"), spark.createDataFrame(iv, "d string, start_ts timestamp, end_ts timestamp"), "ts", on=["d"])
    want = {i: t is not None and any(d == k and a is not None and b is not None and a <= t <= b for k, a, b in iv) for i, d, t in points}
    rows_ = got.collect()
    assert got.columns == ["i", "d", "ts", "is_anomaly"] and {r.i: r.is_anomaly for r in rows_} == want and len(rows_) == 400
    assert {(r.d, r.is_anomaly) for r in rows_} >= {(d, x) for d in ("a", "b", None, "far") for x in (True, False)}


def test_labels_grow_with_the_rows(spark):
    """No time is compared with each interval of its day, and no interval is copied for each day that it touches."""
    points = spark.range(3000).select("id", F.timestamp_seconds(F.col("id") * 2 + 40001).alias("ts"))
    # all on one day, none over a time; and one of a thousand years
    iv = spark.range(3000).select(F.timestamp_seconds(F.col("id") * 2 + 40000).alias("start_ts"), F.timestamp_seconds(F.col("id") * 2 + 40000.5).alias("end_ts"))
    out = series.label_intervals(points, iv.union(spark.sql("SELECT timestamp'0900-01-01', timestamp'1969-12-31'")), "ts")
    assert out.where("is_anomaly").count() == 0 and out.count() == 3000
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan
    joins = [line.replace("<=>", "=") for line in plan.splitlines() if "Join" in line]
    assert joins and not any("<" in line or ">" in line for line in joins)


def test_evaluate_trims_and_guards(spark):
    for n, kept in ((99, 99), (100, 99)):
        df = spark.createDataFrame([("g", float(i), 0.0, None, None) for i in range(1, n + 1)], "g string, actual double, forecast double, forecast_lower double, forecast_upper double")
        r = evaluation.evaluate(df, ["g"]).first()
        assert r.n == n and abs(r.mae - (kept + 1) / 2) < 1e-12 and r.coverage is None
    flat = spark.createDataFrame([("g", 0.0, 1.0, 0.0, 2.0), ("g", 0.0, 3.0, 1.0, 2.0), (None, 1.0, 1.0, 1.0, 1.0)], "g string, actual double, forecast double, forecast_lower double, forecast_upper double")
    r = evaluation.evaluate(flat, ["g"]).collect()
    assert len(r) == 1 and r[0].mape is None and r[0].r2 is None and r[0].coverage == 0.5


def test_range_scores(spark):
    iv = lambda *x: spark.createDataFrame([(datetime.fromtimestamp(a), datetime.fromtimestamp(b)) for a, b in x], "start_ts timestamp, end_ts timestamp")
    r = evaluation.range_scores(iv((0, 9), (100, 109)), iv((5, 14))).first()
    assert abs(r.precision - (0.5 + 0.5 * 0.5)) < 1e-12 and abs(r.recall - (0.75 + 0) / 2) < 1e-12


def test_algebra_is_strict(spark):
    df = spark.createDataFrame([("a", DAY, "fitted", 1.0, 2.0, 3.0), ("b", DAY, "forecast", None, 4.0, 4.0)], "d string, ts timestamp, stage string, actual double, forecast double, std double")
    r = forecast.sum_over_dims(df, ["ts"]).first()
    assert r.actual is None and r.forecast == 6 and r.std == 5 and r.stage == "forecast" and abs(r.forecast_upper - (6 + 1.2815515655446004 * 5)) < 1e-9
    w = {r.d: r.forecast for r in forecast.weight_over_dims(df, ["ts"]).collect()}
    assert abs(w["a"] - 1 / 3) < 1e-12
    assert forecast.sum_over_period(df, "ts", "W", dims=["d"]).count() == 0


def test_regression_follows_trend_and_week(spark):
    y = [(i, 10 + 0.5 * i + (5.0 if i % 7 in (5, 6) else 0.0)) for i in range(120)]
    out = regression.regression_forecast(days(spark, y), "ts", "v", 14).where("stage = 'forecast'").orderBy("ts").collect()
    want = [10 + 0.5 * i + (5.0 if i % 7 in (5, 6) else 0.0) for i in range(120, 134)]
    assert np.abs(np.array([r.forecast for r in out]) - want).max() < 2.5
    t = np.arange(200.0)
    assert regression.season_order(t, np.sin(2 * np.pi * t / 7) + np.cos(4 * np.pi * t / 7), 7.0, 3) == 2
    found = regression.adaptive_lasso_changepoints(t, np.where(t < 100, t, 100 + 3 * (t - 100)))
    assert found and min(abs(f - 100) for f in found) < 15
    x = np.stack([np.ones(400), np.linspace(0, 1, 400)], 1)
    noise = np.random.default_rng(0).exponential(1, 400)
    assert abs(np.mean(noise <= x @ regression.quantile_regression(x, noise, 0.8)) - 0.8) < 0.03


def test_selection_prefers_the_better(spark):
    df = days(spark, [(i, float(i % 7)) for i in range(40)])
    run = lambda c: forecast.backfill(df, "ts", "v", [28, 33], 5, lambda d, k: forecast.seasonal_mean(d, "ts", "v", c["period"], 2, 5, dims=k))
    found = selection.score(run, selection.grid({"period": [5, 7]}), ["cutoff"], tie=["ts"])
    assert found.first().score == 0 and '"period": 7' in found.first().params
    assert selection.candidate_id({"a": 1, "b": 2}) == selection.candidate_id({"b": 2, "a": 1})
    assert selection.stepwise(run, [{"period": [5, 6]}, {"period": [7]}], {}, ["cutoff"], tie=["ts"])[0] == {"period": 7}


def test_assumptions(spark):
    from cohortry.operators.assumptions import metric_interaction, trigger_invariance

    even = [((a, b), 250.0) for a in ("control", "v1") for b in ("control", "on", "nan")] + [(("nan", b), 900.0) for b in ("control", "on")]
    moved = [(v, n * (2 if v == ("v1", "nan") else 1)) for v, n in even]
    frame = lambda x: spark.createDataFrame([(list(v), int(n)) for v, n in x], "variant array<string>, variant_count long")
    sources, pairs, passed = trigger_invariance(frame(even))
    assert passed and len(sources) == 2 and len(pairs) == 2 and all(t.p_value > 0.9 for t in sources)
    assert not trigger_invariance(frame(moved))[2]
    stats = [(["c", "c"], 100, 100.0, 200.0), (["c", "x"], 100, 200.0, 500.0), (["v", "c"], 100, 200.0, 500.0), (["v", "x"], 100, 500.0, 2600.0), (["v", "nan"], 9, 1.0, 1.0)]
    found = metric_interaction(spark.createDataFrame(stats, "variant array<string>, sample_count long, sum double, sum_sq double"))
    assert len(found) == 1 and not found[0].passed and found[0].dof == (1, 396)


def test_pair_effects_by_jackknife(spark):
    rng = np.random.default_rng(3)
    n = 600
    arm = [["control"], ["v1"]]
    data = [(i, arm[i % 2], float(rng.normal(10 + 2 * (i % 2), 1)), float(rng.integers(1, 4))) for i in range(n)]
    df = spark.createDataFrame(data, "unit long, variant array<string>, x double, y double")
    r = experiments.pair_effects(experiments.bucketed(df, ["unit"], 20), Metric("x", denominator="y"), [ComparisonPair((("v1",),), (("control",),), "p")]).first()
    side = lambda k: sum(d[2] for d in data if d[0] % 2 == k) / sum(d[3] for d in data if d[0] % 2 == k)
    assert abs(r.delta - (side(1) - side(0))) < 0.05 and r.ci_lower < r.delta < r.ci_upper and r.p_value < 1e-3
    m = experiments.pair_effects(experiments.bucketed(df, ["unit"], 20), Metric("x"), [ComparisonPair((("v1",),), (("control",),), "p")]).first()
    assert abs(m.delta - 2) < 0.3


def test_flow(spark):
    from cohortry.operators.flow import Flow

    ev = spark.createDataFrame([(u, DAY + timedelta(days=d, hours=u), float(d % 7 + 1)) for d in range(35) for u in range(3)], "u long, t timestamp, v double")
    flow = Flow(MetricSource("s", "u", (UnitMetric("v", "SUM", "v"),), (Metric("v"),)), "v", "t", params={"k": 2})
    ahead = flow.forecast(ev).where("stage = 'forecast'")
    assert ahead.count() == 7 and ahead.where("metric_id = 'v' and algo_name = 'simple'").count() == 7
    overall = flow.evaluate(ev, 35).where("horizon_step is null").first()
    assert overall.mae == 0 and overall.coverage == 1
    with pytest.raises(ValueError):
        Flow(flow.source, "v", "t", algorithm="other").forecast(ev)


def test_second_tier(spark):
    from cohortry.functions.time import ceil_time, is_dst, parse_time

    one = spark.createDataFrame([(datetime(2024, 7, 1, 10, 30), "2024/01/31", "x")], "t timestamp, a string, b string")
    r = one.select(ceil_time(F.col("t"), "h").alias("c"), is_dst(F.col("t"), "Europe/Berlin").alias("s"), parse_time(F.col("a"), "yyyy/MM/dd").alias("p"), parse_time(F.col("b")).alias("n")).first()
    assert r.c == datetime(2024, 7, 1, 11) and r.s and r.p == datetime(2024, 1, 31) and r.n is None
    assert metrics.matching(["ab", "cd"], include="^a") == ["ab"] and metrics.matching(["ab", "cd"], exclude="a") == ["cd"]
    df = spark.createDataFrame([("g", DAY + timedelta(days=i), float(i), float(i) + 1, 9.0, i % 2 == 0, i % 3 == 0) for i in range(7)], "g string, ts timestamp, actual double, f double, h double, is_anomaly boolean, is_anomaly_predicted boolean")
    assert evaluation.best_forecast(df, ["f", "h"], by=["g"]).first().best == "f"
    c = evaluation.confusion(df).first()
    assert (c.tp, c.fp, c.fn, c.tn) == (2, 1, 2, 2) and abs(c.informedness - (0.5 + 2 / 3 - 1)) < 1e-12
    assert [r.actual for r in evaluation.aggregated(df, ["actual"], 3, "ts", ["g"]).orderBy("ts").collect()] == [6.0, 15.0]
    assert df.agg(evaluation.fraction_outside_tolerance(F.col("actual"), F.col("f"), 0.5)).first()[0] == 2 / 7
    spikes = df.withColumn("actual", F.when(F.dayofmonth("ts").isin(3, 4), 99.0).otherwise(F.col("actual")))
    iv = series.outlier_intervals(spikes, "ts", "actual", 1.0, 0.0).first()
    assert (iv.start_ts.day, iv.end_ts.day, iv.n) == (3, 4, 2)
    counts = spark.createDataFrame([("a", None, "p", 5), ("a", "b", "q", 3), ("b", None, "r", 1)], "s1 string, s2 string, d string, seq_count long")
    assert rows(journey.sunburst(counts, 2, ["d"], 1)) == sorted([("p", "a", "end", 5), ("Others", "a", "b", 3), ("Others", "b", "end", 1)], key=str)
    sim, truth = simulate.click_through(spark, 4000)
    rate = {r["v"]: r["x"] for r in sim.groupBy(experiments.shown(F.col("variant")).alias("v")).agg((F.sum("clicks") / F.sum("impressions")).alias("x")).collect()}
    assert abs(rate["enabled|v1"] - rate["control|control"] - truth) < 0.005
    assert simulate.random_dates(spark.range(100).withColumnRenamed("id", "unit"), "2024-01-01", 31).agg(F.max("date")).first()[0].month == 1
    means = spark.createDataFrame([("x", 1.0), ("x", 3.0), ("y", 10.0)], "s string, v double")
    assert metrics.weighted_mean(means, "v", "s", spark.createDataFrame([("x", 3.0), ("y", 1.0)], "s string, w double"), "w").first()[0] == 4.0
