"""Linear models from sums of products: data are read once, and what a model needs of a series is one small matrix.

A design is named columns. Each task adds up the products of all design columns and the target for each series (and fold) that it
meets, or hands on the rows themselves while they are fewer than the matrix has; Spark brings the parts of a series together, and a solver
sees their sums: X'X, X'y and y'y, whole and by fold. No series is gathered, so one series may have any number of rows, in any
number of tasks; cross-validation takes a fold's sums from the whole instead of reading again. Predictions are columns.

Rows with a null in the design or the target don't train. A series without any rows to train has no model (null coefficients).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..functions import dist
from .relational import match

#: Numbers that a task holds at most before it hands its parts on.
HELD = 4 << 20


@dataclass(frozen=True)
class Gram:
    """Sums over n rows (their weights, if weighted) of products of the design and, last, the target."""

    n: float
    sums: np.ndarray

    def __add__(self, other: Gram) -> Gram:
        return Gram(self.n + other.n, self.sums + other.sums)

    def __sub__(self, other: Gram) -> Gram:
        return Gram(self.n - other.n, self.sums - other.sums)

    @property
    def xx(self) -> np.ndarray:
        return self.sums[:-1, :-1]

    @property
    def xy(self) -> np.ndarray:
        return self.sums[:-1, -1]

    def loss(self, beta: np.ndarray) -> float:
        """The sum of squared errors of coefficients."""
        return max(0.0, float(self.sums[-1, -1] - 2 * beta @ self.xy + beta @ self.xx @ beta))


Solver = Callable[[list[Gram]], dict | None]


def _of(rows: np.ndarray) -> np.ndarray:
    """The sums of rows of (design, target, weight)."""
    z = rows[:, :-1]
    return np.append((z * rows[:, -1:]).T @ z, rows[:, -1].sum())


def fitted(df: DataFrame, design: dict[str, Column], y: Column, solve: Solver, schema: str, by: Sequence[str] = (), fold: Column | None = None, weight: Column | None = None) -> DataFrame:
    """by and the columns of schema: what solve makes of each series' sums, one for each fold in order; none where it gives None."""
    width = len(design) + 1
    kinds = dict(df.dtypes)
    shape = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "_key string, _fold int, _rows binary, _whole boolean"])
    types = {f.name: to_arrow_type(f.dataType) for f in StructType.fromDDL(schema)}
    numbers = F.array(*[c.cast("double") for c in (*design.values(), y, F.lit(1.0) if weight is None else weight)])
    rows = df.select(*by, F.to_json(F.struct(*by)).alias("_key") if by else F.lit("").alias("_key"), (F.lit(0) if fold is None else fold.cast("int")).alias("_fold"), numbers.alias("_x"))
    rows = rows.where(F.forall("_x", lambda x: x.isNotNull() & ~F.isnan(x)))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list] = {}
        size = 0

        def handed_on() -> pa.RecordBatch:
            keys = pa.Table.from_batches([first for first, _, _ in held.values()])
            payload = [(x if rows is None else np.concatenate(rows)).astype("<f8").tobytes() for _, x, rows in held.values()]
            columns = [*(keys[c].combine_chunks() for c in by), pa.array([k for k, _ in held], pa.string()), pa.array([f for _, f in held], pa.int32()), pa.array(payload, pa.binary()), pa.array([rows is None for _, _, rows in held.values()])]
            return pa.RecordBatch.from_arrays(columns, [*by, "_key", "_fold", "_rows", "_whole"])

        for batch in batches:
            x = np.asarray(pc.list_flatten(batch["_x"])).reshape(len(batch), width + 1)
            coded = batch["_key"].dictionary_encode()
            code, folds = np.asarray(coded.indices), np.asarray(batch["_fold"])
            order = np.lexsort((folds, code))
            cuts = np.flatnonzero(np.diff(code[order]) | np.diff(folds[order])) + 1
            for own in np.split(order, cuts) if len(order) else []:
                at = (coded.dictionary[int(code[own[0]])].as_py(), int(folds[own[0]]))
                if at not in held:
                    held[at] = [batch.slice(int(own[0]), 1), None, []]
                part = held[at]
                if part[2] is None:
                    part[1] = part[1] + _of(x[own])
                    continue
                part[2].append(x[own])
                size += x[own].size
                if sum(map(len, part[2])) > width:
                    size -= sum(a.size for a in part[2]) - width * width
                    part[1], part[2] = _of(np.concatenate(part[2])), None
            if size > HELD:
                yield handed_on()
                held, size = {}, 0
        if held:
            yield handed_on()

    def whole(table: pa.Table) -> pa.Table:
        sums: dict[int, np.ndarray] = {}
        for f, raw, is_sum in zip(table["_fold"].to_pylist(), table["_rows"].to_pylist(), table["_whole"].to_pylist(), strict=True):
            x = np.frombuffer(raw, "<f8")
            sums[f] = sums.get(f, 0) + (x if is_sum else _of(x.reshape(-1, width + 1)))
        out = solve([Gram(float(s[-1]), s[:-1].reshape(width, width)) for _, s in sorted(sums.items())])
        made = {c: table[c].slice(0, 0 if out is None else 1) for c in by}
        return pa.table(made | {c: pa.array([] if out is None else [v.tolist() if isinstance(v := out[c], np.ndarray) else v], t) for c, t in types.items()})

    out = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), schema])
    return rows.mapInArrow(parts, shape).groupBy("_key").applyInArrow(whole, out)


def ridge(g: Gram, penalty: np.ndarray | float, free: Sequence[int] = (0,)) -> np.ndarray:
    """Least squares with a penalty on the squares of all coefficients but the free ones (the first); of least norm where several are best."""
    p = np.full(len(g.xy), 1.0) * penalty
    if np.isscalar(penalty):
        p[list(free)] = 0
    return np.linalg.lstsq(g.xx + np.diag(p), g.xy, rcond=None)[0]


def partly_regularized(g: Gram, l1: np.ndarray, l2: np.ndarray, start: np.ndarray | None = None, sweeps: int = 20_000, tolerance: float = 1e-10) -> np.ndarray:
    """Coefficients b of least |y - Xb|^2 + sum l1 |b| + sum l2 b^2, by coordinate descent on the sums; l1 and l2 are given by column.

    Every now and then the coefficients with the signs reached are solved for exactly; if that keeps the signs, and no column left out
    has a reason to come in, it is the answer.
    """
    a, c = g.xx, g.xy
    b = np.zeros(len(c)) if start is None else start.copy()
    scale, slope = np.diag(a) + l2, a @ b - c  # slope: half the gradient of the squares
    small = 1e-9 * max(1e-300, float(np.abs(c).max(initial=0.0)))
    for sweep in range(1, sweeps + 1):
        most = 0.0
        for j in np.flatnonzero(scale > 0):
            rho = a[j, j] * b[j] - slope[j]
            new = np.sign(rho) * max(0.0, abs(rho) - l1[j] / 2) / scale[j]
            if new != b[j]:
                step = new - b[j]
                slope += a[:, j] * step
                b[j] = new
                most = max(most, abs(step) * np.sqrt(scale[j]))
        if most <= tolerance * max(1e-300, np.sqrt(g.sums[-1, -1])):
            break
        if sweep % 20 == 0:
            on = np.flatnonzero((b != 0) | (l1 == 0))
            exact = np.zeros(len(b))
            exact[on] = np.linalg.lstsq(a[np.ix_(on, on)] + np.diag(l2[on]), c[on] - np.sign(b[on]) * l1[on] / 2, rcond=None)[0]
            rest = np.abs(a @ exact - c) <= l1 / 2 + small
            rest[on] = (l1[on] == 0) | (np.sign(exact[on]) == np.sign(b[on]))
            if rest.all():
                return exact
    return b


def penalties(g: Gram, l1: np.ndarray, l2: np.ndarray, n: int = 50, ratio: float = 1e-3) -> np.ndarray:
    """Factors of l1 from that which leaves no penalized column down to `ratio` of it, evenly by logarithm."""
    own = l1 > 0
    b = np.zeros(len(l1))
    rest = np.flatnonzero(~own)
    if len(rest):
        b[rest] = np.linalg.lstsq(g.xx[np.ix_(rest, rest)] + np.diag(l2[rest]), g.xy[rest], rcond=None)[0]
    top = float(np.max(2 * np.abs(g.xy - g.xx @ b)[own] / l1[own], initial=0.0))
    return top * np.geomspace(1, ratio, n) if top > 0 else np.zeros(1)


def cross_validated(folds: list[Gram], candidates: Sequence, fit: Callable[[Gram, object, np.ndarray | None], np.ndarray]) -> tuple[object, list[float]]:
    """The candidate of least error over the folds, each fitted to the others' sums (ties: the first), and all errors.

    fit gets the sums, the candidate and the coefficients of the candidate before (for a path, else ignored).
    """
    whole = sum(folds[1:], folds[0])
    loss = np.zeros(len(candidates))
    for f in folds:
        train, b = whole - f, None
        for i, c in enumerate(candidates):
            b = fit(train, c, b)
            loss[i] += f.loss(b)
    return candidates[int(np.argmin(loss))], loss.tolist()


def details(g: Gram, beta: np.ndarray, penalty: np.ndarray | float = 0.0, free: Sequence[int] = (0,)) -> dict:
    """Residual variance, degrees of freedom that a ridge leaves (n less the trace of its hat matrix), and standard errors."""
    p = np.full(len(beta), 1.0) * penalty
    if np.isscalar(penalty):
        p[list(free)] = 0
    inverse = np.linalg.pinv(g.xx + np.diag(p))
    used = float(np.trace(g.xx @ inverse))
    dof = max(1.0, g.n - used)
    noise = g.loss(beta) / dof
    return {"dof": dof, "hat_trace": used, "noise": noise, "se": np.sqrt(np.maximum(np.diag(inverse @ g.xx @ inverse) * noise, 0.0))}


MODEL = "n double, alpha double, sd double, dof double, hat_trace double, coefficients array<double>, se array<double>"


def ridge_models(df: DataFrame, design: dict[str, Column], y: Column, by: Sequence[str] = (), alpha: float | None = None, alphas: Sequence[float] = (1e-3, 1e-2, 1e-1, 1.0, 10.0, 100.0), fold: Column | None = None, free: Sequence[int] = (0,), weight: Column | None = None, least: int = 20) -> DataFrame:
    """by, n, alpha, sd (of all residuals), dof, hat_trace, coefficients, se of each series' ridge; alpha None is cross-validated over
    the folds, or 1 for series of fewer than `least` rows or of one fold."""

    def solve(folds: list[Gram]) -> dict:
        whole = sum(folds[1:], folds[0])
        best = alpha if alpha is not None else 1.0
        if alpha is None and whole.n >= least and len(folds) > 1:
            best = cross_validated(folds, list(alphas), lambda g, a, _: ridge(g, a, free))[0]
        b = ridge(whole, float(best), free)
        found = details(whole, b, float(best), free)
        return {"n": whole.n, "alpha": float(best), "sd": float(np.sqrt(whole.loss(b) / whole.n)), "dof": found["dof"], "hat_trace": found["hat_trace"], "coefficients": b, "se": found["se"]}

    return fitted(df, design, y, solve, MODEL, by, fold if alpha is None else None, weight)


def partial_models(df: DataFrame, design: dict[str, Column], y: Column, l1: Sequence[str], l2: Sequence[str], by: Sequence[str] = (), l1_alpha: float | None = None, l2_alphas: Sequence[float] = (1e-3, 0.1, 10.0), n_alphas: int = 50, fold: Column | None = None) -> DataFrame:
    """by, n, l1_alpha, l2_alpha, loss, coefficients of models with absolute penalties on some columns and squared ones on others.

    Given one l2_alpha and l1_alpha, the model of these; else the pair of least cross-validated error, each l2_alpha with its own path
    of l1_alphas; data are read once in any case.
    """
    names = list(design)
    if set(l1) & set(l2) or set(l1) | set(l2) > set(names):
        raise ValueError("a column has one penalty at most, and is in the design")
    on1, on2 = (np.array([float(c in some) for c in names]) for some in (l1, l2))

    def solve(folds: list[Gram]) -> dict:
        whole, best = sum(folds[1:], folds[0]), None
        for a2 in l2_alphas:
            path = [l1_alpha] if l1_alpha is not None else list(penalties(whole, on1, on2 * a2, n_alphas))
            if len(path) == 1 == len(l2_alphas):
                best = (0.0, path[0], a2)
                break
            if len(folds) < 2:
                raise ValueError("cross-validation takes two folds at least")
            a1, losses = cross_validated(folds, path, lambda g, a, b, a2=a2: partly_regularized(g, on1 * a, on2 * a2, b))
            if best is None or min(losses) < best[0]:
                best = (min(losses), a1, a2)
        b = partly_regularized(whole, on1 * best[1], on2 * best[2])
        return {"n": whole.n, "l1_alpha": float(best[1]), "l2_alpha": float(best[2]), "loss": whole.loss(b), "coefficients": b}

    return fitted(df, design, y, solve, "n double, l1_alpha double, l2_alpha double, loss double, coefficients array<double>", by, fold)


def coefficients(models: DataFrame, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """by, name, coefficient, se, t, p_value: a row for each column of the design of ridge models."""
    @F.pandas_udf("double")
    def p_of(t: pd.Series, dof: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) else dist.t_two_sided(a, d) for a, d in zip(t, dof, strict=True)])

    label = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("_k") + 1)
    rows = models.select(*by, "dof", F.posexplode(F.arrays_zip("coefficients", "se")).alias("_k", "x")).select(*by, label.alias("name"), F.col("x.coefficients").alias("coefficient"), "x.se", "dof")
    out = rows.withColumn("t", F.try_divide("coefficient", "se"))
    return out.withColumn("p_value", p_of("t", "dof")).drop("dof")


def product(design: dict[str, Column], coefficients: Column, only: Callable[[str], bool] = lambda name: True) -> Column:
    """The sum of some design columns times their coefficients."""
    some = [(k, c) for k, (name, c) in enumerate(design.items()) if only(name)]
    out = F.lit(0.0)
    for k, c in some:
        out = out + c.cast("double") * coefficients[k]
    return out


def predicted(df: DataFrame, design: dict[str, Column], models: DataFrame, by: Sequence[str] = (), name: str = "predicted") -> DataFrame:
    """df with each row's prediction by its series' model; null where there is none."""
    out = match(df, models.select(*by, F.col("coefficients").alias("_b")), list(by), "left")
    return out.withColumn(name, product(design, F.col("_b"))).drop("_b")
