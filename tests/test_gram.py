"""Models from sums of products against numpy on all rows, with planted changepoints."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortry.operators import changepoints, gram
from cohortry.operators.gram import Gram


def _data(spark, n=600, groups=("a", "b", None), parts=5):
    rng = np.random.default_rng(3)
    rows = []
    for i, g in enumerate(groups):
        x = rng.normal(size=(n // (1 + 40 * (g == "b")), 3))
        y = 2 + x @ [1.0, -2.0, 0.5] + i + rng.normal(size=len(x)) * 0.1
        rows += [(g, *map(float, r), float(v), int(k * 5 // len(x))) for k, (r, v) in enumerate(zip(x, y, strict=True))]
    return rows, spark.createDataFrame(rows, "g string, u double, v double, w double, y double, f int").repartition(parts)


def _design():
    return {"one": F.lit(1.0), "u": F.col("u"), "v": F.col("v"), "w": F.col("w")}


def _matrix(rows, g):
    own = [r for r in rows if r[0] == g]
    return np.array([[1, *r[1:4]] for r in own]), np.array([r[4] for r in own]), np.array([r[5] for r in own])


def test_ridge_of_each_series(spark):
    rows, df = _data(spark)
    extra = spark.createDataFrame([("a", None, 1.0, 1.0, 5.0, 0), ("a", 1.0, float("nan"), 1.0, 5.0, 0), ("gone", 1.0, 1.0, 1.0, None, 0)], df.schema)
    got = {r.g: r for r in gram.ridge_models(df.union(extra), _design(), F.col("y"), ["g"], alpha=0.7).collect()}
    assert set(got) == {"a", "b", None}
    for g, r in got.items():
        x, y, _ = _matrix(rows, g)
        p = np.diag([0, 0.7, 0.7, 0.7])
        b = np.linalg.solve(x.T @ x + p, x.T @ y)
        h = x @ np.linalg.inv(x.T @ x + p) @ x.T
        dof = len(y) - np.trace(h)
        noise = ((y - x @ b) ** 2).sum() / dof
        inv = np.linalg.inv(x.T @ x + p)
        assert r.n == len(y) and np.allclose(r.coefficients, b) and np.isclose(r.hat_trace, np.trace(h)) and np.isclose(r.dof, dof)
        assert np.isclose(r.sd, np.sqrt(((y - x @ b) ** 2).mean())) and np.allclose(r.se, np.sqrt(np.diag(inv @ x.T @ x @ inv) * noise))
    table = gram.coefficients(gram.ridge_models(df, _design(), F.col("y"), ["g"], alpha=0.0), list(_design()), ["g"]).where("g = 'a' AND name = 'v'").first()
    assert abs(table.coefficient + 2) < 0.05 and table.p_value < 1e-12 and np.isclose(table.t, table.coefficient / table.se)


def test_cross_validation_reads_folds_from_sums(spark):
    rows, df = _data(spark, 150, ("a",))
    alphas = (1e-3, 1.0, 300.0)
    x, y, f = _matrix(rows, "a")
    loss = []
    for a in alphas:
        p, total = np.diag([0.0, a, a, a]), 0.0
        for k in range(5):
            t = f != k
            b = np.linalg.solve(x[t].T @ x[t] + p, x[t].T @ y[t])
            total += ((y[~t] - x[~t] @ b) ** 2).sum()
        loss.append(total)
    r = gram.ridge_models(df, _design(), F.col("y"), ["g"], alphas=alphas, fold=F.col("f")).first()
    assert r.alpha == alphas[int(np.argmin(loss))]
    # many rows of one series in many tasks, without keys, and weights
    w = gram.ridge_models(df, _design(), F.col("y"), alpha=0.0, weight=F.col("f") + 1.0).first()
    b = np.linalg.solve((x * (f + 1)[:, None]).T @ x, (x * (f + 1)[:, None]).T @ y)
    assert np.allclose(w.coefficients, b)
    assert gram.ridge_models(df.where("false"), _design(), F.col("y"), ["g"]).count() == 0


def test_parts_that_are_handed_on_early(spark, monkeypatch):
    rows, df = _data(spark, 300)
    want = {r.g: r.coefficients for r in gram.ridge_models(df, _design(), F.col("y"), ["g"], alpha=0.1).collect()}
    monkeypatch.setattr(gram, "HELD", 8)
    got = {r.g: r.coefficients for r in gram.ridge_models(df, _design(), F.col("y"), ["g"], alpha=0.1).collect()}
    assert all(np.allclose(got[g], want[g]) for g in want)


def test_partly_regularized_meets_its_conditions():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(80, 6))
    x[:, 5] = x[:, 4] + 0.01 * rng.normal(size=80)
    y = x @ [3.0, 0, -1, 0, 2, 0] + rng.normal(size=80)
    z = np.column_stack([x, y])
    g = Gram(80, z.T @ z)
    l1, l2 = np.array([0, 40.0, 40, 40, 0, 0]), np.array([0, 0, 0, 0, 5.0, 5])
    b = gram.partly_regularized(g, l1, l2)
    slope = 2 * (x.T @ (x @ b - y)) + 2 * l2 * b  # of what is smooth
    for j in range(6):
        assert abs(slope[j] + np.sign(b[j]) * l1[j]) < 1e-5 if b[j] else abs(slope[j]) <= l1[j] + 1e-5
    assert b[1] == b[3] == 0 and np.allclose(gram.partly_regularized(g, 0 * l1, 0 * l2), np.linalg.lstsq(x, y, rcond=None)[0], atol=1e-6)
    path = gram.penalties(g, (l1 > 0) * 1.0, l2, 20)
    assert not gram.partly_regularized(g, (l1 > 0) * path[0] * 1.0001, l2)[1:4].any() and gram.partly_regularized(g, (l1 > 0) * path[1], l2)[1:4].any()


def test_partial_models_are_cross_validated(spark):
    rows, df = _data(spark, 200, ("a",))
    design = _design() | {f"noise{k}": F.sin(F.col("u") * (k + 7)) for k in range(4)}
    r = gram.partial_models(df, design, F.col("y"), [f"noise{k}" for k in range(4)], ["u", "v", "w"], ["g"], fold=F.col("f"), n_alphas=12).first()
    assert r.l2_alpha == 1e-3 and max(map(abs, r.coefficients[4:])) < 0.05 and abs(r.coefficients[2] + 2) < 0.05
    with pytest.raises(ValueError, match="one penalty"):
        gram.partial_models(df, design, F.col("y"), ["u"], ["u"])


DAY = datetime.datetime(2020, 1, 1)


def _series(spark, f, n=700, noise=0.2, seed=1):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([("s", DAY + datetime.timedelta(days=i), float(f(i) + noise * rng.normal())) for i in range(n)], "k string, ts timestamp, y double").repartition(4)


def test_planted_bends_are_found(spark):
    df = _series(spark, lambda i: 0.05 * i + (0.15 * (i - 250) if i > 250 else 0) - (0.3 * (i - 450) if i > 450 else 0))
    got = changepoints.trend_changepoints(df, "ts", "y", ["k"], distance_days=60).orderBy("changepoint").collect()
    days = [(r.changepoint - DAY).days for r in got]
    assert any(abs(d - 250) < 35 for d in days) and any(abs(d - 450) < 35 for d in days) and len(days) <= 4
    strongest = max(got, key=lambda r: abs(r.change))
    assert strongest.change < -0.15 and abs((strongest.changepoint - DAY).days - 450) < 35
    straight = _series(spark, lambda i: 0.05 * i)
    assert all(abs(r.change) < 0.05 for r in changepoints.trend_changepoints(straight, "ts", "y", ["k"]).collect())
    assert changepoints.trend_changepoints(df, "ts", "y", ["k"], strength=1.0).count() == 0
    late = changepoints.trend_changepoints(df, "ts", "y", ["k"], end_days=300, strength=0.3).collect()
    assert late and all((r.changepoint - DAY).days <= 400 for r in late)
    assert changepoints.trend_changepoints(df.limit(2), "ts", "y", ["k"]).count() == 0


def test_bends_by_cross_validation_with_yearly_waves(spark):
    df = _series(spark, lambda i: 3 * np.sin(2 * np.pi * i / 365.25) + (0.1 * (i - 600) if i > 600 else 0), 1100)
    got = changepoints.trend_changepoints(df, "ts", "y", ["k"], potential=15, yearly_order=2, strength=None, distance_days=120).collect()
    best = max(got, key=lambda r: abs(r.change))
    assert abs((best.changepoint - DAY).days - 600) < 70 and best.change > 0.05


def test_amplitude_changes_are_found(spark):
    df = _series(spark, lambda i: (1 if i < 400 else 4) * np.sin(2 * np.pi * i / 7), 700)
    got = changepoints.season_changepoints(df, "ts", "y", 7.0, 1, ["k"], potential=8).collect()
    best = max(got, key=lambda r: r.change)
    assert abs((best.changepoint - DAY).days - 400) <= 70 and best.change > 1


def test_parameters_by_length_and_step(spark):
    rows = [(k, DAY + datetime.timedelta(days=step * i)) for k, step, n in (("d", 1, 800), ("short", 1, 120), ("w", 7, 60), ("h", 0.25, 1000)) for i in range(n)]
    got = {r.k: r for r in changepoints.parameters(spark.createDataFrame(rows, "k string, ts timestamp"), "ts", ["k"], 7).collect()}
    assert [(r.resample_days, r.potential, r.end_days) for r in (got["d"], got["short"], got["w"], got["h"])] == [(7, 97, 30), (1, 100, 30), (None, 43, 196), (1, 100, 14)]
    assert [got[k].distance_days for k in ("d", "short", "w", "h")] == [30, 30, 30, 14]
