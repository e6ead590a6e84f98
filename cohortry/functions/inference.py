"""Tests and intervals on the few numbers that aggregation leaves."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np

from . import dist

NAN = float("nan")
Interval = tuple[float, float]


@dataclass(frozen=True)
class Arm:
    """An arm's mean, variance of the mean, number of units, and number of units that its trigger state counts."""

    mean: float
    var: float
    n: float
    triggered: float | None = None


@dataclass(frozen=True)
class Effect:
    delta: float
    ci: Interval
    p_value: float
    percent: float
    ci_percent: Interval
    dof: float
    delta_sum: float
    ci_sum: Interval = (NAN, NAN)
    #: Of (control, treatment).
    sample_counts: tuple[float, float] = field(default=(NAN, NAN))
    impacted_counts: tuple[float, float] = field(default=(NAN, NAN))


def student_ci(mean: float, se: float, dof: float, coverage: float = 0.95) -> tuple[Interval, float]:
    """(interval, p) of a mean against 0; not a number where there is no spread."""
    if not se > 0 or not dof > 0:
        return (NAN, NAN), NAN
    q = dist.t_ppf((1 + coverage) / 2, dof)
    return (mean - q * se, mean + q * se), dist.t_two_sided(mean / se, dof)


def normal_ci(mean: float, se: float, coverage: float = 0.95) -> tuple[Interval, float]:
    if not se > 0:
        return (NAN, NAN), NAN
    q = dist.normal_ppf((1 + coverage) / 2)
    return (mean - q * se, mean + q * se), 2 * (1 - dist.normal_cdf(abs(mean / se)))


def _impact(treatment: Arm, control: Arm, spread: float, same_population: bool, tolerance: float) -> tuple[float, float]:
    """(effect on all triggered units, its variance): on the arms' common population, or on each arm's own. spread: the difference's variance."""
    t, c = treatment.triggered, control.triggered
    if t is None or c is None:
        return NAN, NAN
    if not same_population:
        return t * treatment.mean - c * control.mean, t * t * treatment.var + c * c * control.var
    if abs(t - c) / (t + c) > tolerance:
        raise ValueError(f"triggered populations differ: {c} and {t}")
    n = (t + c) / 2
    return n * (treatment.mean - control.mean), n * n * spread


def two_sample(treatment: Arm, control: Arm, coverage: float = 0.95, law: str = "t", same_population: bool = True, tolerance: float = 0.1) -> Effect:
    """Welch's test (degrees of freedom rounded down) or the normal test.

    An arm of one unit is an error; five units or fewer leave the intervals open. Where one variance is unknown, the difference's is three
    times the other, with that arm's degrees of freedom. Without any variance p is 1 if the means are equal, else 0. Percentages are of
    the control's mean, whatever its sign.
    """
    if treatment.n <= 1 or control.n <= 1:
        raise ValueError("each arm needs two units at least")
    delta = treatment.mean - control.mean
    vt, vc = treatment.var, control.var
    if math.isnan(vt) or math.isnan(vc):
        known, n = (vc, control.n) if math.isnan(vt) else (vt, treatment.n)
        spread, free = 3 * known, n - 1.0
    else:
        spread = vt + vc
        free = math.floor(spread**2 / (vt**2 / (treatment.n - 1) + vc**2 / (control.n - 1))) if spread > 0 else NAN
    total, total_var = _impact(treatment, control, spread, same_population, tolerance)
    ci, ci_sum, p, dof = (NAN, NAN), (NAN, NAN), NAN, NAN
    if min(treatment.n, control.n) > 5:
        if not spread > 0:
            ci, p = (delta, delta), float(delta == 0)
        else:
            dof = free
            law_ci = (lambda x, se: student_ci(x, se, dof, coverage)) if law == "t" else (lambda x, se: normal_ci(x, se, coverage))
            ci, p = law_ci(delta, math.sqrt(spread))
            if total_var > 0:
                ci_sum, _ = law_ci(total, math.sqrt(total_var))
            elif total_var == 0:
                ci_sum = total, total
    share = lambda x: NAN if control.mean == 0 or math.isnan(x) else round(100 * x / control.mean, 3)
    return Effect(
        delta, ci, p, share(delta), (share(ci[0]), share(ci[1])), dof, total, ci_sum,
        (control.n, treatment.n), (NAN if control.triggered is None else control.triggered, NAN if treatment.triggered is None else treatment.triggered),
    )


def chi2_independence(counts: np.ndarray, excluded: Sequence[tuple[int, ...]] = ()) -> tuple[float, float, int, float]:
    """(statistic, p, degrees of freedom, Cramer's V) of mutual independence in a table of any number of dimensions."""
    counts = np.asarray(counts, float)
    total, k, shape = counts.sum(), counts.ndim, counts.shape
    expected = np.full(shape, 1.0)
    for axis in range(k):
        margin = counts.sum(tuple(i for i in range(k) if i != axis))
        expected = expected * margin.reshape([-1 if i == axis else 1 for i in range(k)])
    expected /= total ** (k - 1)
    use = expected > 0
    for cell in excluded:
        use[tuple(cell)] = False
    x = float((((counts - expected) ** 2)[use] / expected[use]).sum())
    dof = max(1, math.prod(shape) - sum(shape) + k - 1 - len(excluded))
    least = min(shape) - 1
    return x, dist.chi2_tail(x, dof), dof, math.sqrt(x / (total * least)) if least and total else NAN


def additive_fit(means: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, int]:
    """(fitted cell means, number of parameters) of the additive model, weighted by counts; cells without units don't count."""
    shape = means.shape
    cells = np.array(list(np.ndindex(shape)))
    columns = [np.ones(len(cells))] + [(cells[:, a] == v).astype(float) for a, n in enumerate(shape) for v in range(1, n)]
    x, w = np.stack(columns, 1), np.sqrt(counts.reshape(-1))
    y = np.where(counts.reshape(-1) > 0, np.nan_to_num(means.reshape(-1)), 0)
    beta, _, rank, _ = np.linalg.lstsq(x * w[:, None], y * w, rcond=None)
    return (x @ beta).reshape(shape), int(rank)


def interaction_f(means: np.ndarray, sds: np.ndarray, counts: np.ndarray) -> tuple[float, float, int, int]:
    """(F, p, degrees of freedom) of interaction against the additive model, from cells' means, sds (n - 1) and counts."""
    means, sds, counts = (np.asarray(x, float) for x in (means, sds, counts))
    fit, rank = additive_fit(means, counts)
    some = counts > 0
    between = float((counts * (np.where(some, means, 0) - fit) ** 2)[some].sum())
    within = float(np.where(counts > 1, (counts - 1) * np.nan_to_num(sds) ** 2, 0).sum())
    d1, d2 = int(some.sum()) - rank, int(counts.sum() - some.sum())
    if d1 <= 0 or d2 <= 0:
        return NAN, NAN, d1, d2
    if within == 0:
        return (0.0, 1.0, d1, d2) if between == 0 else (math.inf, 0.0, d1, d2)
    f = between / d1 / (within / d2)
    return f, dist.f_tail(f, d1, d2), d1, d2


def compare_distributions(counts: np.ndarray, truth: Sequence[float] | None = None, method: str = "g") -> dict[str, float]:
    """Likelihood-ratio (g) or Pearson test of one distribution against a true one, or of the rows of a table for homogeneity.

    dof_cells and p_cells take cells - 1 degrees of freedom, dof and p the right number for homogeneity.
    """
    counts = np.atleast_2d(np.asarray(counts, float))
    total = counts.sum()
    if truth is not None:
        expected = counts.sum(1, keepdims=True) * (np.asarray(truth, float) / np.sum(truth))
        dof = counts.shape[0] * (counts.shape[1] - 1)
    else:
        expected = counts.sum(1, keepdims=True) * counts.sum(0, keepdims=True) / total
        dof = (counts.shape[0] - 1) * (counts.shape[1] - 1)
    some = expected > 0
    if method == "g":
        ratio = np.where(counts > 0, counts / np.where(some, expected, 1), 1)
        x = float(2 * (counts * np.log(ratio))[some].sum())
    else:
        x = float(((counts - expected) ** 2 / np.where(some, expected, 1))[some].sum())
    cells = max(1, counts.size - 1)
    return {"statistic": x, "dof": dof, "p": dist.chi2_tail(x, max(1, dof)), "dof_cells": cells, "p_cells": dist.chi2_tail(x, cells)}
