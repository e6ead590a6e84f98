"""From a source to a scored forecast in one call, with algorithms by name."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..specs import MetricSource
from .evaluation import detect, evaluate_by_horizon
from .forecast import backfill, cutoffs, seasonal_mean, stamp
from .metrics import time_metrics
from .regression import Model, regression_forecast
from .series import regularize

Algorithm = Callable[[DataFrame, Sequence[str]], DataFrame]


def _seasonal(period: int = 7, k: int = 4, horizon: int = 7, freq: str = "D", coverage: float = 0.95) -> Algorithm:
    return lambda df, dims: seasonal_mean(df, "ts", "value", period, k, horizon, freq, coverage=coverage, dims=dims)


def _regression(horizon: int = 7, freq: str = "D", **how) -> Algorithm:
    return lambda df, dims: regression_forecast(df, "ts", "value", horizon, freq, Model(**how), dims)


#: More can be put here: a function of parameters that gives a function of (series, dims).
ALGORITHMS: dict[str, Callable[..., Algorithm]] = {"simple": _seasonal, "regression": _regression}


@dataclass(frozen=True)
class Flow:
    source: MetricSource
    metric: str
    time_col: str
    freq: str = "D"
    algorithm: str = "simple"
    horizon: int = 7
    params: dict = field(default_factory=dict)
    initial: int = 14
    step: int = 7

    def series(self, df: DataFrame) -> DataFrame:
        """ts, dims, value: the metric by bucket, without gaps."""
        wide = time_metrics(df, self.source, self.time_col, self.freq)
        return regularize(wide.select("ts", *self.source.dims, F.col(self.metric).alias("value")), "ts", ["value"], self.freq, self.source.dims)

    def _made(self) -> Algorithm:
        if self.algorithm not in ALGORITHMS:
            raise ValueError(f"unknown algorithm {self.algorithm}; known: {', '.join(ALGORITHMS)}")
        return ALGORITHMS[self.algorithm](horizon=self.horizon, freq=self.freq, **self.params)

    def forecast(self, df: DataFrame) -> DataFrame:
        return stamp(self._made()(self.series(df), self.source.dims), metric_id=self.metric, algo_name=self.algorithm)

    def evaluate(self, df: DataFrame, n: int) -> DataFrame:
        """Backfilled accuracy by horizon and overall; n is the series' length, for the schedule of cutoffs."""
        cut = cutoffs(n, self.initial, self.horizon, self.step)
        made = backfill(self.series(df), "ts", "value", cut, self.horizon, self._made(), dims=self.source.dims)
        return evaluate_by_horizon(stamp(made, metric_id=self.metric), tie=("cutoff", "ts"))

    def detect(self, df: DataFrame, ape: float | None = None) -> DataFrame:
        """The series with its fitted forecast and whether each value is outside the bounds (and, if given, over so many percent off)."""
        made = self._made()(self.series(df), self.source.dims).where("stage = 'fitted'")
        return stamp(detect(made, ape=ape), metric_id=self.metric, algo_name=self.algorithm)
