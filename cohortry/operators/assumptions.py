"""Whether concurrent experiments can be analysed together: arms that move other experiments' triggers, and interactions of arms.

Tables come from the variant counts, whose rows the arms bound, so they are tested on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from ..functions.inference import chi2_independence, interaction_f
from ..specs import NOT_TRIGGERED


@dataclass(frozen=True)
class Independence:
    source: int
    target: int | None
    statistic: float
    p_value: float
    dof: int
    cramers_v: float
    passed: bool


def _table(cells: dict[tuple, float], rows: list, columns: list) -> np.ndarray:
    return np.array([[cells.get((r, c), 0.0) for c in columns] for r in rows])


def _test(counts: list[tuple[tuple[str, ...], float]], source: int, others: Sequence[int], level: float, least_v: float, target: int | None) -> Independence:
    cells: dict[tuple, float] = {}
    for variant, n in counts:
        if variant[source] != NOT_TRIGGERED:
            key = variant[source], tuple(variant[i] for i in others)
            cells[key] = cells.get(key, 0.0) + n
    rows, columns = sorted({r for r, _ in cells}), sorted({c for _, c in cells})
    if len(rows) < 2 or len(columns) < 2:
        return Independence(source, target, 0.0, 1.0, 1, 0.0, True)
    x, p, dof, v = chi2_independence(_table(cells, rows, columns))
    return Independence(source, target, x, p, dof, v, not (p < level and v > least_v))


def trigger_invariance(counts: DataFrame, alpha: float = 0.001, least_v: float = 0.01, variant: str = "variant", count: str = "variant_count") -> tuple[list[Independence], list[Independence], bool]:
    """(by source, by ordered pair, all sources passed).

    For each experiment: whether its arm, among units that it triggered, shifts the joint variants of the others; and for each
    other experiment, whether it shifts that one's. Not passed: p below alpha over the number of tests of its kind, and Cramer's
    V above the least that matters. Experiments are numbered from 1.
    """
    held = [(tuple(r[variant]), float(r[count])) for r in counts.select(variant, count).collect()]
    k = len(held[0][0]) if held else 0
    number = lambda t: Independence(t.source + 1, None if t.target is None else t.target + 1, t.statistic, t.p_value, t.dof, t.cramers_v, t.passed)
    sources = [number(_test(held, i, [j for j in range(k) if j != i], alpha / k, least_v, None)) for i in range(k) if k > 1]
    pairs = [number(_test(held, i, [j], alpha / (k * (k - 1)), least_v, j)) for i in range(k) for j in range(k) if i != j]
    return sources, pairs, all(t.passed for t in sources)


@dataclass(frozen=True)
class Interaction:
    trigger_state: tuple[bool, ...]
    experiments: tuple[int, ...]
    f: float
    p_value: float
    dof: tuple[int, int]
    passed: bool


def metric_interaction(stats: DataFrame, alpha: float = 0.001, variant: str = "variant") -> list[Interaction]:
    """For each trigger state of two experiments or more: whether arms' effects on a metric add up (F-test of cell means).

    stats has variant, sample_count, sum and sum_sq of one metric. Significance is alpha over the number of tests.
    """
    by: dict[tuple[bool, ...], list] = {}
    for r in stats.select(variant, "sample_count", "sum", "sum_sq").collect():
        by.setdefault(tuple(v != NOT_TRIGGERED for v in r[0]), []).append(r)
    states = sorted(s for s in by if sum(s) > 1)
    out = []
    for state in states:
        on = [i for i, x in enumerate(state) if x]
        labels = [sorted({r[0][i] for r in by[state]}) for i in on]
        shape = tuple(map(len, labels))
        means, sds, n = np.zeros(shape), np.zeros(shape), np.zeros(shape)
        for v, count, total, square in by[state]:
            at = tuple(names.index(v[i]) for names, i in zip(labels, on, strict=True))
            means[at], n[at] = total / count, count
            sds[at] = np.sqrt(max(0.0, (square - total * total / count) / (count - 1))) if count > 1 else 0.0
        f, p, d1, d2 = interaction_f(means, sds, n)
        out.append(Interaction(state, tuple(i + 1 for i in on), f, p, (d1, d2), not p < alpha / len(states)))
    return out
