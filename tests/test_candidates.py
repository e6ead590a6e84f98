"""Searches among candidates."""

import numpy as np
from pyspark.sql import functions as F

from cohortry.operators import candidates as C
from cohortry.operators import gram
from cohortry.operators.selection import candidate_id


def test_beams_reopen_and_read_the_log(spark):
    # least where x = 2 and y = 3 together; alone x = 1 looks better
    value = lambda c: abs(c["x"] - 2) + abs(c["y"] - 3) + (5 if c["x"] == 2 and c["y"] == 0 else 0)
    asked = []

    def score(some):
        asked.append(sorted(candidate_id(c) for c in some))
        return spark.createDataFrame([(candidate_id(c), float(value(c))) for c in some if c["y"] != 1], "candidate_id string, score double")

    groups = [{"x": (0, 1, 2)}, {"y": (0, 1, 3)}]
    narrow, _ = C.beam_search(score, groups, {"x": 0, "y": 0})
    assert narrow == {"x": 1, "y": 3}
    again, found = C.beam_search(score, groups, {"x": 0, "y": 0}, reopen={1: 0})
    assert again == {"x": 2, "y": 3} and found[0]["score"] == 0 and found[-1]["score"] is None
    wide, _ = C.beam_search(score, groups, {"x": 0, "y": 0}, beam=3)
    assert wide == {"x": 2, "y": 3}
    assert all(len(set(some)) == len(some) for some in asked)
    log = spark.createDataFrame([(r["candidate_id"], r["score"]) for r in found], "candidate_id string, score double")
    asked.clear()
    assert C.beam_search(score, groups, {"x": 0, "y": 0}, reopen={1: 0}, log=log)[0] == {"x": 2, "y": 3} and not asked


def test_backtests_don_t_look_ahead(spark):
    rows = [("a", 86_400 * d, float(d)) for d in range(20) if d not in (9, 10)] + [(None, 0, 5.0)]
    df = spark.createDataFrame(rows, "g string, s long, v double").withColumn("ts", F.timestamp_seconds("s"))
    cells = C.relation(spark, [{"period": 2, "k": 2}, {"period": 50, "k": 1}], "period int, k int")
    got = C.seasonal_backtest(df, "ts", "v", cells, [12], 3, dims=["g"]).collect()
    assert sorted((r.g, r.horizon_step, r.forecast, r.actual) for r in got if r.g) == [("a", 1, (11 + 7) / 2, 13.0), ("a", 2, (12 + 8) / 2, 14.0), ("a", 3, (11 + 7) / 2, 15.0)]
    scored = {r.candidate_id: r for r in C.scores(C.seasonal_backtest(df, "ts", "v", cells, [12], 3, dims=["g"]), cells).collect()}
    assert scored[candidate_id({"period": 50, "k": 1})].mae is None and scored[candidate_id({"period": 50, "k": 1})].rank == 2


def test_pipeline_of_rolling_origins(spark):
    rng = np.random.default_rng(2)
    x, seg = rng.normal(size=400), np.arange(400) // 80
    y = 1 + 2 * x + rng.normal(size=400)
    df = spark.createDataFrame([("s", float(a), float(b), int(k)) for a, b, k in zip(x, y, seg, strict=True)] + [("short", 1.0, 1.0, 0), ("short", 2.0, 1.0, 1)], "g string, x double, y double, seg int").repartition(4)
    alphas = (0.1, 10.0, 1000.0)
    (r,) = C.regression_pipeline(df, {"one": F.lit(1.0), "x": F.col("x")}, F.col("y"), F.col("seg"), alphas, ["g"]).collect()

    def fit(upto, a):
        m = np.column_stack([np.ones(400), x])[seg <= upto]
        return np.linalg.solve(m.T @ m + np.diag([0, a]), m.T @ y[seg <= upto])

    def mse(last):
        return [np.concatenate([(y - fit(k - 1, a)[0] - fit(k - 1, a)[1] * x)[seg == k] ** 2 for k in range(1, last + 1)]).mean() for a in alphas]

    assert np.allclose(r.cv_mse, mse(4)) and r.alpha == alphas[int(np.argmin(mse(4)))] and r.backtest_alpha == alphas[int(np.argmin(mse(3)))]
    b = fit(3, r.backtest_alpha)
    assert np.isclose(r.backtest_mse, ((y - b[0] - b[1] * x)[seg == 4] ** 2).mean()) and np.allclose(r.coefficients, fit(4, r.alpha)) and r.n == 400


def test_weights_and_errors_of_sums():
    z = np.array([[1.0, 2.0, 3.0], [1.0, 4.0, 5.0]])
    g = gram.Gram(2, z.T @ z)
    assert np.isclose(g.loss(np.array([0.5, 1.0])), (3 - 2.5) ** 2 + (5 - 4.5) ** 2) and (g - g).n == 0
