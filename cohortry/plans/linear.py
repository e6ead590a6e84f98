"""SQL that solves small linear systems, for queries of linear models."""

from __future__ import annotations

from collections.abc import Sequence


def solved(rows: str, p: int, penalty: Sequence[float], prefix: str = "") -> str:
    """CTEs up to `beta` (g, b0 to b{p-1}): for each g the ridge of y on x0 to x{p-1} over rows, by elimination on the normal equations."""
    n = range(p)
    sums = ", ".join([*(f"sum(x{i} * x{j}) AS s{i}_{j}" for i in n for j in n), *(f"sum(x{i} * y) AS s{i}_{p}" for i in n)])
    cells = " UNION ALL ".join(f"SELECT g, {i} AS i, {j} AS j, s{i}_{j}{f' + {penalty[i]}' if i == j and penalty[i] else ''} AS v FROM {prefix}sums" for i in n for j in range(p + 1))
    steps = [f"{prefix}sums AS (SELECT g, {sums} FROM {rows} GROUP BY g)", f"{prefix}m0 AS ({cells})"]
    for k in n:
        steps.append(
            f"{prefix}m{k + 1} AS (SELECT a.g, a.i, a.j, CASE WHEN a.i = {k} THEN a.v / q.v ELSE a.v - r.v * c.v / q.v END AS v FROM {prefix}m{k} a JOIN {prefix}m{k} q ON q.g = a.g AND q.i = {k} AND q.j = {k} "
            f"JOIN {prefix}m{k} r ON r.g = a.g AND r.i = a.i AND r.j = {k} JOIN {prefix}m{k} c ON c.g = a.g AND c.i = {k} AND c.j = a.j)"
        )
    steps.append(f"{prefix}beta AS (SELECT g, {', '.join(f'max(CASE WHEN i = {i} THEN v END) AS b{i}' for i in n)} FROM {prefix}m{p} WHERE j = {p} GROUP BY g)")
    return ", ".join(steps)
