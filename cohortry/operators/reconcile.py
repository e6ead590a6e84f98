"""Additive reconciliation as a quadratic programme over aggregated moments.

A transformation T of all nodes' forecasts is sought so that what comes out adds up (the constraints times T are 0) and a sum of
penalties is least: `adj`, how far forecasts are moved; `bias`, how far actual values would be moved; `train`, the error of the moved
forecasts; `var`, the variance of their errors by the covariance of the old ones. Each is a mean over nodes and times with a weight for
each node, so second moments of forecasts and actual values are all that it takes: one aggregation, whatever the number of times. T
may have to leave sums that add up as they are (unbiased), and its entries may be bounded.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gram


@dataclass(frozen=True)
class Penalties:
    """Factors of the penalties, weights of nodes for each (all 1 unless given), and what T has to keep to."""

    adj: float = 0.0
    bias: float = 0.0
    train: float = 1.0
    var: float = 0.0
    weights: dict[str, Sequence[float]] = field(default_factory=dict)
    identity_covariance: bool = False
    unbiased: bool = True
    lower: float | None = None
    upper: float | None = None


@dataclass(frozen=True)
class Moments:
    """Means of products: forecasts with each other, actual values with forecasts, actual values with each other."""

    n: float
    ff: np.ndarray
    af: np.ndarray
    aa: np.ndarray

    @property
    def errors(self) -> np.ndarray:
        """The errors' covariance, taken as having no mean."""
        return self.aa - self.af - self.af.T + self.ff


def constraints_of(nodes: Sequence[str], children: dict[str, Sequence[str]]) -> np.ndarray:
    """A row for each parent: it less its children."""
    place = {n: i for i, n in enumerate(nodes)}
    out = np.zeros((len(children), len(nodes)))
    for row, (parent, own) in zip(out, children.items(), strict=True):
        row[place[parent]] = -1
        for c in own:
            row[place[c]] = 1
    return out


def _wide(df: DataFrame, nodes: Sequence[str], by: str, values: dict[str, str]) -> DataFrame:
    """A row for each `by` with a column <prefix><i> of each value and node."""
    aggs = [F.max(F.when(F.col("node") == n, F.col(v))).cast("double").alias(f"{p}{i}") for p, v in values.items() for i, n in enumerate(nodes)]
    return df.groupBy(by).agg(*aggs)


def moments(df: DataFrame, nodes: Sequence[str], by: str, actual: str = "actual", forecast: str = "forecast") -> Moments:
    """The moments of (node, by, actual, forecast) over the times at which all nodes have both."""
    m = len(nodes)
    wide = _wide(df, nodes, by, {"f": forecast, "a": actual})
    design = {c: F.col(c) for c in [*(f"f{i}" for i in range(m)), *(f"a{i}" for i in range(m))]}
    row = gram.fitted(wide, design, F.lit(1.0), lambda parts: {"n": parts[0].n, "sums": parts[0].xx.ravel()}, "n double, sums array<double>").first()
    if row is None:
        raise ValueError("no time has values of all nodes")
    s = np.array(row["sums"]).reshape(2 * m, 2 * m) / row["n"]
    return Moments(row["n"], s[:m, :m], s[m:, :m], s[m:, m:])


def transformation(found: Moments, constraints: np.ndarray, how: Penalties, rounds: int = 20_000, tolerance: float = 1e-10) -> np.ndarray:
    """T of least penalty."""
    c, m = np.atleast_2d(constraints), len(found.ff)
    _, s, v = np.linalg.svd(c)
    basis = v[int((s > 1e-10 * s.max(initial=0)).sum()) :].T  # of what adds up; T = basis @ g
    q = basis.shape[1]
    weight = {k: np.diag(np.asarray(how.weights.get(k, np.ones(m)), float)) for k in ("adj", "bias", "train", "var")}
    covariance = np.eye(m) if how.identity_covariance else found.errors
    h, b = np.zeros((m * q, m * q)), np.zeros((q, m))
    for k, lam, inner, cross in (("adj", how.adj, found.ff, found.ff), ("bias", how.bias, found.aa, found.aa), ("train", how.train, found.ff, found.af), ("var", how.var, covariance, 0 * found.ff)):
        if lam:
            h += lam * np.kron(inner, basis.T @ weight[k] @ basis)  # of the columns of g, one after the other
            b += lam * basis.T @ weight[k] @ cross
    rhs, equal, value = b.T.ravel(), np.zeros((0, m * q)), np.zeros(0)
    if how.unbiased:
        equal, value = np.kron(basis.T, np.eye(q)), np.eye(q).ravel()  # g @ basis is the identity
    bounded = how.lower is not None or how.upper is not None
    lift = np.kron(np.eye(m), basis)
    scale = max(float(np.trace(h)) / len(h), 1e-300)
    rho = scale if bounded else 0.0
    kkt = np.block([[h + rho * lift.T @ lift, equal.T], [equal, np.zeros((len(value),) * 2)]])
    inverse = np.linalg.pinv(kkt, rcond=1e-13)
    solve = lambda extra: (inverse @ np.concatenate([rhs + extra, value]))[: m * q]
    if not bounded:
        return basis @ solve(0.0).reshape(m, q).T
    low, high = how.lower if how.lower is not None else -np.inf, how.upper if how.upper is not None else np.inf
    z, u = np.clip(np.zeros(m * m), low, high), np.zeros(m * m)
    for _ in range(rounds):  # alternating directions: g meets the equalities, z the bounds, u draws them together
        t = lift @ solve(rho * lift.T @ (z - u))
        before, z = z, np.clip(t + u, low, high)
        u += t - z
        if max(np.abs(t - z).max(), np.abs(z - before).max()) < tolerance:
            break
    else:
        if np.abs(t - z).max() > 1e-4:
            raise ValueError("no transformation keeps to the bounds")
    return z.reshape(m, m).T


def apply(df: DataFrame, nodes: Sequence[str], by: str, t: np.ndarray, value: str = "forecast") -> DataFrame:
    """by, node, value: the transformation of each time's forecasts, as sums of columns; null where a node's forecast is missing."""
    wide = _wide(df, nodes, by, {"f": value})
    rows = [F.struct(F.lit(n).alias("node"), reduce(lambda a, b: a + b, (F.lit(float(t[i, j])) * F.col(f"f{j}") for j in range(len(nodes)))).alias(value)) for i, n in enumerate(nodes)]
    return wide.select(by, F.explode(F.array(*rows)).alias("x")).select(by, "x.*")


def reconcile_convex(df: DataFrame, nodes: Sequence[str], children: dict[str, Sequence[str]], by: str, how: Penalties | None = None, history: DataFrame | None = None, value: str = "forecast") -> DataFrame:
    """Forecasts (node, by, value) reconciled by a transformation learnt on history (with actual; df itself if none is given)."""
    found = moments(history if history is not None else df, nodes, by, forecast=value)
    return apply(df, nodes, by, transformation(found, constraints_of(nodes, children), how or Penalties()), value)
