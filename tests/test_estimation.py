"""Estimator algebra and regressions from sums against numpy on all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortry.operators import estimators as A


def _rows(n=200, buckets=20):
    rng = np.random.default_rng(1)
    return rng.normal(5, 1, n), rng.normal(3, 1, n), np.arange(n) * buckets // n


def test_estimators_against_leaving_rows_out(spark):
    x, y, b = _rows()
    df = spark.createDataFrame([(float(p), float(q), int(k)) for p, q, k in zip(x, y, b, strict=True)], "x double, y double, jk_bucket int")
    r = A.replicated(df, {"x": F.sum("x"), "y": F.sum("y"), "n": F.count("*")}, 20)
    of = A.Estimator.of
    mx, my = of("x") / of("n"), of("y") / of("n")
    e = A.stacked(of("x") / of("y"), mx * my, 2 - mx, 1 / my, A.stacked(mx, my) @ [[1, 2], [3, 4]], A.stacked(mx, my) @ A.stacked(my, mx), A.stacked(mx, my)[1] * 2 + 1 - mx)

    def plain(rows):
        p, q = x[rows].mean(), y[rows].mean()
        return np.array([p / q, p * q, 2 - p, 1 / q, p + 3 * q, 2 * p + 4 * q, 2 * p * q, 2 * q + 1 - p])

    value, left = plain(np.ones(len(x), bool)), np.array([plain(b != k) for k in range(20)])
    corrected, cov = value - 19 * (left.mean(0) - value), 19 / 20 * (left - left.mean(0)).T @ (left - left.mean(0))
    got = A.summary(r, e, 20).collect()
    assert [g.component for g in got] == [str(k) for k in range(8)]
    assert np.allclose([g.value for g in got], value) and np.allclose([g.jk_value for g in got], corrected) and np.allclose([g.se for g in got], np.sqrt(np.diag(cov)))
    t = 2.093024054408263  # Student's quantile of 19 degrees of freedom
    assert np.allclose([g.ci_upper - g.jk_value for g in got], t * np.sqrt(np.diag(cov)))
    assert np.allclose(np.array([g.covariance for g in A.covariance(r, e).collect()]).reshape(8, 8), cov)


def test_estimators_of_odd_groups(spark):
    df = spark.createDataFrame([("a", 1.0, 0), ("a", 2.0, 1), ("b", 4.0, 0), (None, 3.0, 1)], "g string, x double, jk_bucket int")
    r = A.replicated(df, {"x": F.sum("x"), "n": F.count("*")}, 2, ["g"])
    got = {g.g: g for g in A.summary(r, A.Estimator.of("x") / A.Estimator.of("n"), 2, ["g"]).collect()}
    assert got["a"].value == 1.5 and abs(got["a"].se - np.sqrt(0.25)) < 1e-12
    assert got["b"].value == 4.0 and got["b"].se is None and got[None].value == 3.0  # nothing is left without their only bucket
    assert A.replicated(df.where("false"), {"x": F.sum("x")}, 2, ["g"]).count() == 0
    with pytest.raises(ZeroDivisionError):
        A.Estimator.of("x") / 0
    with pytest.raises(ValueError, match="two buckets"):
        A.replicated(df, {"x": F.sum("x")}, 1)


def test_weights_of_strata(spark):
    df = spark.createDataFrame([(10.0, "a", 0), (20.0, "b", 1), (30.0, "b", 2)], "x double, s string, jk_bucket int")
    r = A.replicated(df, A.strata_sums(F.col("x"), F.col("s"), "ab", "x") | A.strata_sums(F.lit(1.0), F.col("s"), "ab", "n"), 3)
    of = A.Estimator.of
    mean = A.weighted({s: of(f"x_{s}") / of(f"n_{s}") for s in "ab"}, {"a": 1.0, "b": 3.0, "gone": 5.0})
    row = r.select(mean.column.alias("m")).first().m
    assert row.value == [0.25 * 10 + 0.75 * 25] and row.left == [[0.75 * 25], [2.5 + 0.75 * 30], [2.5 + 0.75 * 20]]  # a stratum without rows counts as 0
    assert r.select(A.weighted({"a": of("x_a")}, {"a": 4.0}, standardize=False).column.alias("m")).first().m.value == [40.0]
