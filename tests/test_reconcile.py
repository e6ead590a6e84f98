"""Reconciliation by quadratic programming: closed forms, and optimality against random changes."""

import numpy as np
import pytest

from cohortry.operators import reconcile as Q

NODES, TREE = ["all", "a", "b", "c"], {"all": ["a", "b", "c"]}
C = Q.constraints_of(NODES, TREE)


def _values(n=120, seed=1):
    rng = np.random.default_rng(seed)
    leaf = rng.normal([10, 20, 5], [2, 3, 1], (n, 3))
    actual = np.column_stack([leaf.sum(1), leaf])
    return actual, actual * [1.05, 0.9, 1.1, 1.0] + rng.normal(size=(n, 4)) * [2, 1, 2, 0.5]


def _moments(a, f):
    return Q.Moments(len(a), f.T @ f / len(a), a.T @ f / len(a), a.T @ a / len(a))


def _objective(t, a, f, how):
    w = {k: np.asarray(how.weights.get(k, np.ones(4))) for k in ("adj", "bias", "train", "var")}
    e = a - f
    cov = np.eye(4) if how.identity_covariance else e.T @ e / len(a)
    return (
        how.adj * (((f @ t.T - f) ** 2) * w["adj"]).sum(1).mean() + how.bias * (((a @ t.T - a) ** 2) * w["bias"]).sum(1).mean()
        + how.train * (((f @ t.T - a) ** 2) * w["train"]).sum(1).mean() + how.var * (np.diag(t @ cov @ t.T) * w["var"]).sum()
    )


def test_closed_forms():
    a, f = _values()
    s = np.vstack([np.ones(3), np.eye(3)])
    ols = Q.transformation(_moments(a, f), C, Q.Penalties(train=0, var=1, identity_covariance=True))
    assert np.allclose(ols, s @ np.linalg.solve(s.T @ s, s.T))
    e = a - f
    w = np.linalg.inv(e.T @ e)
    assert np.allclose(Q.transformation(_moments(a, f), C, Q.Penalties(train=0, var=1)), s @ np.linalg.solve(s.T @ w @ s, s.T @ w), atol=1e-6)
    free = Q.transformation(_moments(a, f), C, Q.Penalties(unbiased=False))
    assert np.allclose(free, s @ np.linalg.lstsq(f, a[:, 1:], rcond=None)[0].T, atol=1e-6)


@pytest.mark.parametrize("how", [
    Q.Penalties(0.3, 0.2, 1.0, 0.5, {"train": [4, 1, 1, 2], "adj": [1, 2, 1, 1]}, unbiased=False), Q.Penalties(0.3, 0.0, 1.0, 0.5), Q.Penalties(lower=0.0, upper=1.0), Q.Penalties(adj=1.0, unbiased=False, lower=-0.1, upper=0.8),
])
def test_no_allowed_change_is_better(how):
    a, f = _values()
    t = Q.transformation(_moments(a, f), C, how)
    assert np.abs(C @ t).max() < 1e-6
    s = np.vstack([np.ones(3), np.eye(3)])
    if how.unbiased:
        assert np.abs(t @ s - s).max() < 1e-6
    low, high = how.lower if how.lower is not None else -np.inf, how.upper if how.upper is not None else np.inf
    assert t.min() >= low - 1e-6 and t.max() <= high + 1e-6
    rng, best, tried = np.random.default_rng(3), _objective(t, a, f, how), 0
    for _ in range(4000):
        d = s @ rng.normal(size=(3, 4))
        if how.unbiased:
            d -= d @ s @ np.linalg.solve(s.T @ s, s.T)
        other = t + d * 10 ** rng.uniform(-5, -1)
        if other.min() < low or other.max() > high:
            # go to the bounds only as far as they let
            steps = np.where(d > 0, (high - t) / np.where(d == 0, 1, d), np.where(d < 0, (low - t) / np.where(d == 0, 1, d), np.inf))
            other = t + d * max(0.0, min(1e-3, steps.min()))
        tried += 1
        assert _objective(other, a, f, how) >= best - 1e-7 * max(1, best)
    assert tried


def test_bounds_that_can_t_be_kept():
    a, f = _values()
    with pytest.raises(ValueError, match="bounds"):
        Q.transformation(_moments(a, f), C, Q.Penalties(lower=0.0, upper=0.2), rounds=500)


def test_on_frames(spark):
    a, f = _values(40)
    rows = [(k, n, float(a[k, i]), float(f[k, i])) for k in range(40) for i, n in enumerate(NODES)] + [(99, "a", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "t int, node string, actual double, forecast double").repartition(3)
    got = Q.moments(df, NODES, "t")
    assert got.n == 40 and np.allclose(got.ff, _moments(a, f).ff) and np.allclose(got.af, _moments(a, f).af)
    out = {(r.t, r.node): r.forecast for r in Q.reconcile_convex(df, NODES, TREE, "t", Q.Penalties(lower=0.0)).collect()}
    assert len(out) == 41 * 4 and out[99, "a"] is None
    assert all(abs(out[k, "all"] - out[k, "a"] - out[k, "b"] - out[k, "c"]) < 1e-6 for k in range(40))
