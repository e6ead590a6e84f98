"""Regression forecasts of each series: trend, changepoints, Fourier seasons, events and lags by ridge; changepoint and season inference.

Forecasts are columns and their models come from distributed sums of products (see `gram`). Only models with lags or of quantiles
are solved from a series' rows, one series a task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dist
from . import gram
from .forecast import future_rows, z_of
from .relational import match


#: The time of so many steps of each frequency.
STEPS = {
    "s": lambda k: pd.Timedelta(seconds=k), "min": lambda k: pd.Timedelta(minutes=k), "h": lambda k: pd.Timedelta(hours=k), "D": lambda k: pd.Timedelta(days=k), "W": lambda k: pd.Timedelta(weeks=k),
    "M": lambda k: pd.DateOffset(months=k), "Q": lambda k: pd.DateOffset(months=3 * k), "Y": lambda k: pd.DateOffset(years=k),
}


@dataclass(frozen=True)
class Model:
    """What a regression forecast is made of. Seasons are (name, period in days, order); alpha None is cross-validated ridge."""

    changepoints: int = 5
    seasons: tuple[tuple[str, float, int], ...] = (("weekly", 7.0, 3), ("yearly", 365.25, 5))
    lags: tuple[int, ...] = ()
    events: tuple[str, ...] = ()
    alpha: float | None = None
    alphas: tuple[float, ...] = (1e-3, 1e-2, 1e-1, 1.0, 10.0, 100.0)
    coverage: float = 0.95
    quantile: float | None = None
    extra: tuple[str, ...] = field(default=())


def _design(days: np.ndarray, model: Model, span: tuple[float, float]) -> tuple[np.ndarray, list[str]]:
    a, b = span
    t = (days - a) / max(b - a, 1e-9)
    columns, names = [np.ones_like(t), t], ["intercept", "trend"]
    for i in range(1, model.changepoints + 1):
        columns.append(np.maximum(0, t - i / (model.changepoints + 1)))
        names.append(f"trend_cp{i}")
    for name, period, order in model.seasons:
        if b - a < period:
            continue
        for k in range(1, order + 1):
            for f, n in ((np.sin, "sin"), (np.cos, "cos")):
                columns.append(f(2 * np.pi * k * days / period))
                names.append(f"{name}_{n}{k}")
    return np.stack(columns, 1), names


def ridge(x: np.ndarray, y: np.ndarray, alpha: float, weights: np.ndarray | None = None, free: Sequence[int] = (0,)) -> np.ndarray:
    """Least squares with a penalty on all columns but the free ones (the first)."""
    penalty = np.full(x.shape[1], alpha)
    penalty[list(free)] = 0
    xw = x if weights is None else x * weights[:, None]
    return np.linalg.lstsq(xw.T @ x + np.diag(penalty), xw.T @ y, rcond=None)[0]


def summary(x: np.ndarray, y: np.ndarray, names: Sequence[str], alpha: float = 0.0) -> list[dict[str, float | str]]:
    """Of each column of a design: coefficient, standard error, t and p, with the degrees of freedom that the penalty leaves."""
    penalty = np.diag([0.0, *[alpha] * (x.shape[1] - 1)])
    inverse = np.linalg.pinv(x.T @ x + penalty)
    beta, hat = inverse @ x.T @ y, x @ inverse @ x.T
    dof = max(1.0, len(y) - float(np.trace(hat)))
    noise = float(((y - x @ beta) ** 2).sum()) / dof
    se = np.sqrt(np.diag(inverse @ x.T @ x @ inverse) * noise)
    out = []
    for n, b, e in zip(names, beta, se, strict=True):
        t = float(b / e) if e > 0 else float("nan")
        out.append({"name": n, "coefficient": float(b), "se": float(e), "t": t, "p": dist.t_two_sided(t, dof) if e > 0 else float("nan"), "dof": dof})
    return out


def spaced(points: Sequence[float], strength: Sequence[float], least: float) -> list[float]:
    """Changepoints no nearer than `least` to each other: of near ones the strongest stays (ties: the first)."""
    kept: list[float] = []
    for p, _ in sorted(zip(points, strength, strict=True), key=lambda x: (-abs(x[1]), x[0])):
        if all(abs(p - k) >= least for k in kept):
            kept.append(p)
    return sorted(kept)


def choose_alpha(x: np.ndarray, y: np.ndarray, alphas: Sequence[float], folds: int = 5) -> float:
    """The penalty of least error over contiguous folds."""
    parts = np.array_split(np.arange(len(y)), min(folds, max(2, len(y) // 10)))

    def loss(alpha: float) -> float:
        total = 0.0
        for p in parts:
            train = np.setdiff1d(np.arange(len(y)), p)
            total += float(((y[p] - x[p] @ ridge(x[train], y[train], alpha)) ** 2).sum())
        return total

    return min(alphas, key=loss)


def quantile_regression(x: np.ndarray, y: np.ndarray, q: float, alpha: float = 1e-3, rounds: int = 60) -> np.ndarray:
    """The q-quantile's coefficients by iteratively reweighted least squares."""
    beta = ridge(x, y, alpha)
    for _ in range(rounds):
        e = y - x @ beta
        w = np.where(e >= 0, q, 1 - q) / np.maximum(np.abs(e), 1e-6)
        new = ridge(x, y, alpha, w)
        if np.max(np.abs(new - beta)) < 1e-8:
            return new
        beta = new
    return beta


def adaptive_lasso_changepoints(days: np.ndarray, y: np.ndarray, potential: int = 20, strength: float = 0.1, rounds: int = 200) -> list[float]:
    """Days at which the trend bends: hinges on an even grid, kept by an adaptive lasso (coordinate descent)."""
    a, b = days.min(), days.max()
    grid = a + (b - a) * np.arange(1, potential + 1) / (potential + 1)
    x = np.stack([(days - a) / max(b - a, 1e-9), *[np.maximum(0, days - g) / max(b - a, 1e-9) for g in grid]], 1)
    x, yc = x - x.mean(0), y - y.mean()
    first = np.linalg.lstsq(x.T @ x + 1e-3 * np.eye(x.shape[1]), x.T @ yc, rcond=None)[0]
    penalty = strength * np.std(yc) * len(y) ** 0.5 / np.maximum(np.abs(first), 1e-6)
    penalty[0] = 0
    penalty = penalty / max(1e-9, np.median(penalty[1:])) * strength * np.abs(x.T @ yc).max()
    beta, sq = np.zeros(x.shape[1]), (x**2).sum(0)
    rest = yc.copy()
    for _ in range(rounds):
        biggest = 0.0
        for j in range(len(beta)):
            if sq[j] == 0:
                continue
            old = beta[j]
            rho = x[:, j] @ rest + sq[j] * old
            beta[j] = np.sign(rho) * max(0.0, abs(rho) - penalty[j]) / sq[j]
            rest += x[:, j] * (old - beta[j])
            biggest = max(biggest, abs(beta[j] - old))
        if biggest < 1e-8:
            break
    return [float(g) for g, c in zip(grid, beta[1:], strict=True) if abs(c) > 1e-9]


def season_order(days: np.ndarray, y: np.ndarray, period: float, most: int = 10, criterion: str = "bic") -> int:
    """How many harmonics of a period the information criterion asks for; 0 for none."""
    best, score = 0, np.inf
    for order in range(most + 1):
        x = np.stack([np.ones_like(days), days, *[f(2 * np.pi * k * days / period) for k in range(1, order + 1) for f in (np.sin, np.cos)]], 1)
        e = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
        n, p = len(y), x.shape[1]
        value = n * np.log(max(1e-12, (e**2).mean())) + p * (np.log(n) if criterion == "bic" else 2)
        if value < score:
            best, score = order, value
    return best


def fit_predict(pdf: pd.DataFrame, time_col: str, value: str, horizon: int, freq: str, model: Model) -> pd.DataFrame:
    """Fitted and forecast rows of one series, with bounds and the parts of the forecast."""
    pdf = pdf.sort_values(time_col).drop_duplicates(time_col)
    ts = pd.to_datetime(pdf[time_col])
    future = pd.Series([ts.iloc[-1] + STEPS[freq](i + 1) for i in range(horizon)])
    times = pd.concat([ts, future], ignore_index=True)
    days = (times - pd.Timestamp("2000-01-01")).dt.total_seconds().to_numpy() / 86400
    n, y = len(pdf), pdf[value].to_numpy(float)
    ok = np.isfinite(y)
    x, names = _design(days, model, (days[0], days[n - 1]))
    if ok.sum() < 2:
        x, names = x[:, :1], names[:1]
    series = np.concatenate([np.where(ok, y, np.nanmean(y) if ok.any() else 0.0), np.full(horizon, np.nan)])

    def lagged(values: np.ndarray) -> np.ndarray:
        return np.stack([np.concatenate([np.full(k, np.nanmean(values[:n])), values[:-k]]) for k in model.lags], 1)

    full = np.hstack([x, lagged(series)]) if model.lags else x
    names = names + [f"lag{k}" for k in model.lags]
    train = np.flatnonzero(ok)
    if model.quantile is not None:
        beta = quantile_regression(full[train], y[train], model.quantile)
    else:
        alpha = model.alpha if model.alpha is not None else (choose_alpha(full[train], y[train], model.alphas) if len(train) >= 20 else 1.0)
        beta = ridge(full[train], y[train], alpha)
    made = full[:n] @ beta
    out = np.concatenate([made, np.zeros(horizon)])
    for i in range(n, n + horizon):
        row = full[i] if not model.lags else np.concatenate([x[i], [series[i - k] for k in model.lags]])
        out[i] = row @ beta
        series[i] = out[i]
        full[i] = row
    sd = float(np.std(y[train] - made[train], ddof=0)) if len(train) else np.nan
    z = z_of(model.coverage)
    part = lambda *keys: (full[:, [i for i, c in enumerate(names) if c.split("_")[0] in keys]] @ beta[[i for i, c in enumerate(names) if c.split("_")[0] in keys]])
    return pd.DataFrame(
        {
            time_col: times, "stage": ["fitted"] * n + ["forecast"] * horizon, "actual": np.concatenate([y, np.full(horizon, np.nan)]), "forecast": out,
            "forecast_lower": out - z * sd, "forecast_upper": out + z * sd, "std": sd, "longterm_growth": part("intercept", "trend"), "weekly_seasonality": part("weekly"), "annual_seasonality": part("yearly"),
        }
    )


EPOCH = 946_684_800  # 2000-01-01, from which days count


def design_of(time_col: str, model: Model, a: Column, b: Column) -> dict[str, Column]:
    """The columns of a model's design; a and b are the ends of the series' training in days. Seasons longer than it are zeros."""
    days = (F.unix_micros(F.col(time_col).cast("timestamp")) / 1e6 - EPOCH) / 86400
    t = (days - a) / F.greatest(b - a, F.lit(1e-9))
    out = {"intercept": F.lit(1.0), "trend": t}
    for i in range(1, model.changepoints + 1):
        out[f"trend_cp{i}"] = F.greatest(F.lit(0.0), t - i / (model.changepoints + 1))
    for name, period, order in model.seasons:
        for k in range(1, order + 1):
            for f, n in ((F.sin, "sin"), (F.cos, "cos")):
                out[f"{name}_{n}{k}"] = F.when(b - a >= period, f(2 * np.pi * k * days / period)).otherwise(0.0)
    return out | {c: F.col(c) for c in (*model.events, *model.extra)}


def regression_forecast(df: DataFrame, time_col: str, value: str, horizon: int, freq: str = "D", model: Model | None = None, dims: Sequence[str] = (), future: DataFrame | None = None) -> DataFrame:
    """Fitted and forecast rows of each series' ridge, with bounds and the parts of the forecast.

    A series' model comes from its sums of products, so no series is gathered, however long. Models with lags (whose forecasts feed on
    each other) or of quantiles are solved in a task for each series. Times of a series aren't repeated; future gives
    the forecast rows' times and the model's events and extra columns, else the `horizon` steps after each series' last time are forecast.
    """
    model = model or Model()
    if freq not in STEPS:
        raise ValueError(f"unknown frequency {freq}; known: {', '.join(STEPS)}")
    if model.lags or model.quantile is not None:
        return _gathered_forecast(df, time_col, value, horizon, freq, model, dims)
    more = [*model.events, *model.extra]
    rows = df.select(*dims, F.col(time_col).cast("timestamp").alias(time_col), F.col(value).cast("double").alias("actual"), *more)
    day = (F.unix_micros(time_col) / 1e6 - EPOCH) / 86400
    spans = rows.groupBy(*dims).agg(F.min(day).alias("_a"), F.max(day).alias("_b"))
    full = match(rows, spans, list(dims))
    design = design_of(time_col, model, F.col("_a"), F.col("_b"))
    fold = F.least(F.lit(4), F.floor(5 * (day - F.col("_a")) / F.greatest(F.col("_b") - F.col("_a"), F.lit(1e-9))))
    models = gram.ridge_models(full, design, F.col("actual"), dims, model.alpha, model.alphas, fold)
    if future is None:
        if more:
            raise ValueError("a model with events or extra columns needs their future")
        future = future_rows(rows, time_col, freq, horizon, dims).drop("horizon_step")
    ahead = future.select(*dims, F.col(time_col).cast("timestamp").alias(time_col), F.lit(None).cast("double").alias("actual"), *more)
    every = rows.withColumn("stage", F.lit("fitted")).unionByName(ahead.withColumn("stage", F.lit("forecast")))
    known = match(spans, models.select(*dims, F.col("coefficients").alias("_w"), F.col("sd").alias("std")), list(dims), "left")
    out = match(every, known, list(dims))
    part = lambda *keys: gram.product(design, F.col("_w"), lambda n: n.split("_")[0] in keys)
    made, z = gram.product(design, F.col("_w")), z_of(model.coverage)
    return out.select(
        *dims, time_col, "stage", "actual", made.alias("forecast"), (made - z * F.col("std")).alias("forecast_lower"), (made + z * F.col("std")).alias("forecast_upper"), "std",
        part("intercept", "trend").alias("longterm_growth"), part("weekly").alias("weekly_seasonality"), part("yearly").alias("annual_seasonality"),
    )


def _gathered_forecast(df: DataFrame, time_col: str, value: str, horizon: int, freq: str, model: Model, dims: Sequence[str]) -> DataFrame:
    kinds = dict(df.dtypes)
    schema = ", ".join([*[f"{d} {kinds[d]}" for d in dims], f"{time_col} timestamp, stage string, actual double, forecast double, forecast_lower double, forecast_upper double, std double, longterm_growth double, weekly_seasonality double, annual_seasonality double"])
    names = list(dims)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        out = fit_predict(pdf, time_col, value, horizon, freq, model)
        for d in reversed(names):
            out.insert(0, d, pdf[d].iloc[0])
        return out

    return df.select(*dims, time_col, value).groupBy(*dims).applyInPandas(one, schema)


def quantile_forecast(df: DataFrame, time_col: str, value: str, horizon: int, freq: str = "D", model: Model | None = None, dims: Sequence[str] = ()) -> DataFrame:
    """The regression forecast with bounds from regressions of the quantiles that the model's coverage leaves out on each side; all three
    of a series in one task."""
    model = model or Model()
    tail = (1 - model.coverage) / 2
    names, kinds = list(dims), dict(df.dtypes)
    schema = ", ".join([*[f"{d} {kinds[d]}" for d in dims], f"{time_col} timestamp, stage string, actual double, forecast double, std double, longterm_growth double, weekly_seasonality double, annual_seasonality double, forecast_lower double, forecast_upper double"])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        made = [fit_predict(pdf, time_col, value, horizon, freq, m) for m in (model, replace(model, quantile=tail), replace(model, quantile=1 - tail))]
        out = made[0].drop(columns=["forecast_lower", "forecast_upper"]).assign(forecast_lower=made[1]["forecast"], forecast_upper=made[2]["forecast"])
        for d in reversed(names):
            out.insert(0, d, pdf[d].iloc[0])
        return out

    return df.select(*dims, time_col, value).groupBy(*dims).applyInPandas(one, schema)
