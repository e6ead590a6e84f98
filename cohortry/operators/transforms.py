"""Transformations of time-bucketed metrics, in a list, with the names that they give to the metrics made."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.time import expected_rows
from .relational import match
from .series import coarsen, date_lags

#: How frequencies are called in names (fixed values).
EVERY = {"D": "daily", "W": "weekly", "M": "monthly"}
ONE = {"h": "hour", "D": "day", "W": "week", "M": "month"}
SHORT = {"s": "s", "min": "min", "h": "h", "D": "d", "W": "w", "M": "m", "Q": "q", "Y": "y"}
AGGS = ("mean", "sum", "median", "min", "max")


@dataclass(frozen=True)
class Coarsen:
    """Sums (or other aggregates) by a coarser frequency."""

    freq: str
    agg: str = "sum"

    @property
    def name(self) -> str:
        word = EVERY.get(self.freq, self.freq.lower())
        return word if self.agg == "sum" else f"{word}_{self.agg}"

    def apply(self, df: DataFrame, time_col: str, values: Sequence[str], freq: str, dims: Sequence[str]) -> tuple[DataFrame, str]:
        return coarsen(df, time_col, self.freq, self.agg, values, dims), self.freq


@dataclass(frozen=True)
class ShareWithin:
    """Each value over the total of its period (starting on Mondays for weeks); null where rows of the period are missing or it sums up to 0."""

    period: str

    @property
    def name(self) -> str:
        return f"within_{ONE.get(self.period, self.period.lower())}_weight"

    def apply(self, df: DataFrame, time_col: str, values: Sequence[str], freq: str, dims: Sequence[str]) -> tuple[DataFrame, str]:
        unit = {"D": "day", "W": "week", "M": "month", "Q": "quarter", "Y": "year", "h": "hour"}[self.period]
        out = df.withColumn("_p", F.date_trunc(unit, F.col(time_col)))
        # summed up by period and joined back, so a series isn't one window
        sums = out.groupBy(*dims, "_p").agg(F.count("*").alias("_n"), *[F.sum(v).alias(f"_{v}") for v in values])
        out = match(out, sums.where(F.col("_n") == expected_rows(F.col("_p"), freq, self.period)), [*dims, "_p"], "left")
        return out.withColumns({v: F.try_divide(F.col(v), F.col(f"_{v}")) for v in values}).drop("_p", "_n", *[f"_{v}" for v in values]), freq


@dataclass(frozen=True)
class Diff:
    """Each value less that of so many periods before, or less the aggregate of several; relative to it if asked for. Null where one of
    them is missing. Name a number of periods (1 to n) or the orders."""

    period: str
    n: int | None = None
    orders: tuple[int, ...] | None = None
    agg: str | None = None
    relative: bool = False

    def __post_init__(self) -> None:
        if (self.n is None) == (self.orders is None) or (self.n is not None and self.n < 1) or self.orders == ():
            raise ValueError("name either a number of periods, from 1 on, or orders")
        if len(self.lags) > 1 and self.agg not in AGGS:
            raise ValueError(f"several lags need an aggregate of {', '.join(AGGS)}")

    @property
    def lags(self) -> list[int]:
        return list(range(1, self.n + 1)) if self.n is not None else list(self.orders)

    @property
    def name(self) -> str:
        short, k = SHORT.get(self.period, self.period.lower()), len(self.lags)
        return ("rel_" if self.relative else "") + (f"{short}o{short}_diff" if k == 1 else f"{self.agg}_{k}{short}_diff")

    def apply(self, df: DataFrame, time_col: str, values: Sequence[str], freq: str, dims: Sequence[str]) -> tuple[DataFrame, str]:
        days = self.period == "W"
        orders = [7 * k for k in self.lags] if days else self.lags
        for v in values:
            held = date_lags(df.select(*dims, time_col, v), time_col, v, "D" if days else self.period, orders, dims)
            past = F.array(*[F.col(f"{v}_lag{k}").cast("double") for k in orders])
            total, some = F.aggregate(past, F.lit(0.0), lambda a, b: a + b), F.forall(past, lambda x: x.isNotNull())
            s = F.array_sort(past)
            middle = (F.get(s, F.lit((len(orders) - 1) // 2)) + F.get(s, F.lit(len(orders) // 2))) / 2
            base = {"sum": total, "min": F.array_min(past), "max": F.array_max(past), "median": middle}.get(self.agg or "mean", total / len(orders))
            base = F.when(some, base)
            gap = F.col(v).cast("double") - base
            made = held.select(*dims, time_col, (F.try_divide(gap, base) if self.relative else gap).alias(f"_{v}"))
            df = match(df, made, [*dims, time_col], "left").drop(v).withColumnRenamed(f"_{v}", v)
        return df, freq


Transform = Coarsen | ShareWithin | Diff


def transformed(df: DataFrame, transforms: Sequence[Transform], time_col: str, values: Sequence[str], freq: str = "D", dims: Sequence[str] = ()) -> DataFrame:
    """dims, time and each value after all transforms in turn; df has a row for each series and time of the frequency."""
    out = df.select(*dims, time_col, *values)
    for t in transforms:
        out, freq = t.apply(out, time_col, values, freq, dims)
    return out.select(*dims, time_col, *values)


def metric_name(base: str, transforms: Sequence[Transform]) -> str:
    """A metric's name with those of its transforms."""
    return reduce(lambda a, t: f"{a}_{t.name}", transforms, base)

