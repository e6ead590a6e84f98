"""Changepoints of trend and of seasonal amplitude, by adaptive lasso on sums of products of an averaged series.

A series is averaged over runs of days, so that noise within them doesn't look like a bend. Its design has an intercept, a trend, yearly
waves and a hinge at each of `potential` places, evenly from its start to where an exclusion zone at its end begins. A light ridge gives
first coefficients; hinges are then penalized by the reciprocals of theirs, the other columns not at all. Of the hinges that are left,
those nearer to each other than a least distance stand for one bend, the strongest. All models of all series come from one
aggregation (see `gram`).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import gram
from .gram import Gram
from .regression import EPOCH, spaced
from .relational import match

YEAR = 365.25
#: From the least penalty to the one that leaves no hinge; the usual place between them by logarithm.
SPAN_OF_PENALTIES, STRENGTH = 1e6, 0.6


def _days(time_col: str) -> Column:
    return (F.unix_micros(F.col(time_col).cast("timestamp")) / 1e6 - EPOCH) / 86400


def parameters(df: DataFrame, time_col: str, by: Sequence[str] = (), horizon: int = 1, yearly_order: int = 8, least: int = 100, cap: int = 100) -> DataFrame:
    """by, n, step_days, resample_days, potential, end_days, distance_days: what suits each series by its length and least step.

    resample_days is the longest of 7, 3 and 1 that leaves `least` points (null for steps of a week and more: no averaging); potential leaves
    the waves and the intercept a point each, up to cap; end_days and distance_days grow with the step (fixed values).
    """
    step = _days(time_col) - F.lag(_days(time_col)).over(W.partitionBy(*by).orderBy(time_col))
    found = df.withColumn("_s", step).groupBy(*by).agg(F.count("*").alias("n"), F.min("_s").alias("step_days"), (F.max(_days(time_col)) - F.min(_days(time_col))).alias("_span"))
    s, whole = F.col("step_days"), F.floor("step_days")
    length = F.col("n") * s
    runs = F.when(s >= 7, None).when(length >= 7 * least, 7).when(length >= 3 * least, 3).otherwise(1)
    points = F.when(s >= 7, F.col("n")).otherwise(F.floor(F.col("_span") / runs))
    ahead = F.greatest(F.floor(s * horizon), F.lit(1))
    end = F.when(whole == 365, F.least(F.greatest(whole, 2 * ahead, F.lit(3 * 365)), F.lit(20 * 366))).when(whole > 365, F.greatest(whole, 2 * ahead))
    month = F.least(F.greatest(whole, 3 * ahead), F.lit(6 * 366))
    end = end.when(whole == 90, F.greatest(month, F.lit(4 * 90))).when(whole == 28, F.greatest(month, F.lit(3 * 28))).when(whole >= 28, month)
    near = F.greatest(whole, 4 * ahead)
    end = end.when(whole == 7, F.least(F.greatest(near, F.lit(56)), F.lit(728))).when(whole == 1, F.least(F.greatest(near, F.lit(30)), F.lit(365))).when(whole < 1, F.least(F.greatest(near, F.lit(14)), F.lit(365))).otherwise(near)
    distance = F.when(s < 1, F.greatest(2 * whole, F.lit(14))).when(s <= 7, F.greatest(2 * whole, F.lit(30))).otherwise(2 * whole)
    return found.select(*by, "n", "step_days", runs.cast("int").alias("resample_days"), F.least(F.greatest(points - 2 * yearly_order - 1, F.lit(0)), F.lit(cap)).cast("int").alias("potential"), end.cast("int").alias("end_days"), distance.cast("int").alias("distance_days"))


def _averaged(df: DataFrame, time_col: str, value: str, by: Sequence[str], resample_days: float | None, end_days: float | None, end_share: float) -> DataFrame:
    """by, _d (days), _v, _a and _z: the ends of the places for changepoints, _fold (fifths of the series)."""
    rows = df.select(*by, _days(time_col).alias("_d"), F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL AND NOT isnan(_v)")
    spans = rows.groupBy(*by).agg(F.min("_d").alias("_a"), F.max("_d").alias("_b"))
    off = F.lit(float(end_days)) if end_days is not None else end_share * (F.col("_b") - F.col("_a"))
    out = match(rows, spans.select(*by, "_a", "_b", F.greatest(F.col("_b") - off, F.col("_a")).alias("_z")), list(by))
    if resample_days:
        run = F.floor((F.col("_d") - F.col("_a")) / resample_days)
        out = out.groupBy(*by, "_a", "_b", "_z", run.alias("_run")).agg(F.min("_d").alias("_d"), F.avg("_v").alias("_v")).drop("_run")
    return out.withColumn("_fold", F.least(F.lit(4), F.floor(5 * (F.col("_d") - F.col("_a")) / F.greatest(F.col("_b") - F.col("_a"), F.lit(1e-9)))))


def _waves(prefix: str, period: float, order: int) -> dict[str, Column]:
    return {f"{prefix}_{n}{k}": f(2 * np.pi * k * F.col("_d") / period) for k in range(1, order + 1) for f, n in ((F.sin, "sin"), (F.cos, "cos"))}


def _share() -> Column:
    return (F.col("_d") - F.col("_a")) / F.greatest(F.col("_b") - F.col("_a"), F.lit(1e-9))


def _place(i: int, potential: int) -> Column:
    """The i-th place of a changepoint, as a share of the series."""
    return i / (potential + 1) * (F.col("_z") - F.col("_a")) / F.greatest(F.col("_b") - F.col("_a"), F.lit(1e-9))


def adaptive(folds: list[Gram], penalized: np.ndarray, strength: float | None, alphas: int = 12) -> np.ndarray:
    """Adaptive lasso: coefficients with some columns penalized by the reciprocals of a light ridge's.

    strength goes from 0 (the ridge itself) to 1 (no penalized column is left), evenly by logarithm between; None is cross-validated.
    """
    whole = sum(folds[1:], folds[0])
    first = gram.ridge(whole, np.where(penalized, 1e-3, 1e-9) * np.maximum(np.diag(whole.xx), 1e-12))
    if strength == 0:
        return first
    l1 = np.where(penalized, 1 / np.maximum(np.abs(first), 1e-16), 0.0)
    path = gram.penalties(whole, l1, np.zeros(len(l1)), alphas, 1 / SPAN_OF_PENALTIES)
    if strength == 1:
        top = path[0] * (1 + 1e-9)
    elif strength is None:
        top = gram.cross_validated(folds, list(path), lambda g, a, b: gram.partly_regularized(g, l1 * a, 0 * l1, b, 2000, 1e-7))[0]
    else:
        top = path[0] * SPAN_OF_PENALTIES ** (strength - 1)
    return gram.partly_regularized(whole, l1 * top, 0 * l1, None, 20_000, 1e-8)


def trend_changepoints(df: DataFrame, time_col: str, value: str, by: Sequence[str] = (), potential: int = 25, resample_days: float | None = 7, end_days: float | None = None, end_share: float = 0.1, yearly_order: int = 0, strength: float | None = STRENGTH, distance_days: float = 30) -> DataFrame:
    """by, changepoint (timestamp), change: where each series' trend bends, and by how much a day its slope changes there.

    Series that are too short, or don't bend, have no rows.
    """
    rows = _averaged(df, time_col, value, by, resample_days, end_days, end_share)
    design = {"intercept": F.lit(1.0), "trend": _share()} | _waves("yearly", YEAR, yearly_order)
    base = len(design)
    design |= {f"bend{i}": F.greatest(F.lit(0.0), _share() - _place(i, potential)) for i in range(1, potential + 1)}
    penalized = np.arange(len(design)) >= base

    def solve(folds: list[Gram]) -> dict | None:
        if sum(f.n for f in folds) < 4:
            return None
        b = adaptive(folds, penalized, strength)[base:]
        at = np.flatnonzero(np.abs(b) > 1e-9 * max(1e-300, np.abs(b).max(initial=0.0)))
        return {"at": at + 1, "change": b[at]}

    found = gram.fitted(rows, design, F.col("_v"), solve, "at array<int>, change array<double>", by, F.col("_fold"))
    return _kept(match(found, rows.select(*by, "_a", "_b", "_z").distinct(), list(by)), by, potential, distance_days)


def _kept(found: DataFrame, by: Sequence[str], potential: int, distance_days: float) -> DataFrame:
    """The changes as rows, without those nearer than the distance to a stronger one; a series' changes are in one row."""
    kinds = dict(found.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "day double, change double"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for *own, at, change, a, b, z in pdf.itertuples(index=False, name=None):
                days = [k / (potential + 1) * (z - a) + a for k in at]
                changes = [c / max(b - a, 1e-9) for c in change]
                stay = set(spaced(days, changes, distance_days))
                out += [(*own, d, c) for d, c in zip(days, changes, strict=True) if d in stay]
            yield pd.DataFrame(out, columns=[*by, "day", "change"])

    rows = found.select(*by, "at", "change", F.col("_a").alias("a"), F.col("_b").alias("b"), F.col("_z").alias("z")).mapInPandas(run, schema)
    return rows.select(*by, F.timestamp_micros(F.round((F.col("day") * 86400 + EPOCH) * 1e6).cast("long")).alias("changepoint"), "change")


def season_changepoints(df: DataFrame, time_col: str, value: str, period: float, order: int = 2, by: Sequence[str] = (), potential: int = 6, trend: int = 5, resample_days: float | None = None, end_days: float | None = None, end_share: float = 0.1, strength: float | None = STRENGTH, distance_days: float = 30) -> DataFrame:
    """by, changepoint, change: where the waves of a period change in amplitude, and the length of the change of their coefficients.

    The trend (with bends at even places) and the waves as they start aren't penalized; waves that set in at a place are.
    """
    rows = _averaged(df, time_col, value, by, resample_days, end_days, end_share)
    design = {"intercept": F.lit(1.0), "trend": _share()} | {f"trend{i}": F.greatest(F.lit(0.0), _share() - i / (trend + 1)) for i in range(1, trend + 1)}
    waves = _waves("wave", period, order)
    design |= waves
    base = len(design)
    for i in range(1, potential + 1):
        design |= {f"{n}_from{i}": F.when(_share() > _place(i, potential), c).otherwise(0.0) for n, c in waves.items()}
    penalized = np.arange(len(design)) >= base

    def solve(folds: list[Gram]) -> dict | None:
        if sum(f.n for f in folds) < 4:
            return None
        b = adaptive(folds, penalized, strength)[base:].reshape(potential, 2 * order)
        size = np.sqrt((b * b).sum(1))
        at = np.flatnonzero(size > 1e-9 * max(1e-300, size.max(initial=0.0)))
        return {"at": at + 1, "change": size[at]}

    found = gram.fitted(rows, design, F.col("_v"), solve, "at array<int>, change array<double>", by, F.col("_fold"))
    ends = rows.select(*by, "_a", "_z").distinct()
    one = match(found, ends, list(by)).withColumn("_b", F.col("_a") + 1)  # changes are as they are, not by the day
    return _kept(one, by, potential, distance_days)
