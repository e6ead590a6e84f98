"""Rewards for choosing detectors: expressions over score columns that add, multiply and penalise."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Number = int | float


@dataclass(frozen=True)
class Reward:
    """A score as a Column of a frame of scores (one row a candidate). Arithmetic on rewards and numbers gives rewards."""

    column: Callable[[], Column]

    @staticmethod
    def of(name: str) -> Reward:
        return Reward(lambda: F.col(name).cast("double"))

    def penalized(self, least: float = float("-inf"), most: float = float("inf"), penalty: float | None = None, multiply: bool = False) -> Reward:
        """The score, with a penalty added (or multiplied) where it is outside of its range."""
        amount = F.lit(float(penalty if penalty is not None else (1.0 if multiply else 0.0)))

        def made() -> Column:
            x = self.column()
            outside = (x < least) | (x > most)
            return F.when(outside, x * amount if multiply else x + amount).otherwise(x)

        return Reward(made)

    def _with(self, other: Reward | Number, how: Callable[[Column, Column], Column], swapped: bool = False) -> Reward:
        def made() -> Column:
            a, b = self.column(), other.column() if isinstance(other, Reward) else F.lit(float(other))
            return how(b, a) if swapped else how(a, b)

        return Reward(made)

    def __add__(self, other: Reward | Number) -> Reward:
        return self._with(other, lambda a, b: a + b)

    def __sub__(self, other: Reward | Number) -> Reward:
        return self._with(other, lambda a, b: a - b)

    def __mul__(self, other: Reward | Number) -> Reward:
        return self._with(other, lambda a, b: a * b)

    def __truediv__(self, other: Reward | Number) -> Reward:
        return self._with(other, F.try_divide)

    __radd__, __rmul__ = __add__, __mul__

    def __rsub__(self, other: Reward | Number) -> Reward:
        return self._with(other, lambda a, b: a - b, True)

    def __rtruediv__(self, other: Reward | Number) -> Reward:
        return self._with(other, F.try_divide, True)


def anomaly_percent(share: str = "anomaly_percent", target: float = 5.0, low: float = 0.0, high: float = 100.0, penalty: float = -1.0) -> Reward:
    """How near the percentage of anomalies is to what is expected, with a penalty outside of a range; 0 at best."""
    near = Reward(lambda: -F.abs(F.col(share) - target) / 100.0)
    kept = Reward.of(share).penalized(low, high, penalty) - Reward.of(share)
    return near + kept


def reward_of(objective: str | None = None, constraint: str | None = None, least: float | None = None, target_percent: float | None = None) -> Reward:
    """A reward from settings: an objective, at least so much of another score (else -inf), and an expected percentage of anomalies."""
    parts: list[Reward] = []
    if objective:
        parts.append(Reward.of(objective))
    if constraint:
        held = Reward.of(constraint).penalized(least=least if least is not None else 0.0, penalty=float("-inf"))
        parts.append(held - Reward.of(constraint))
    if target_percent is not None:
        parts.append(anomaly_percent(target=target_percent))
    if not parts:
        raise ValueError("a reward needs an objective, a constraint or a percentage")
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def ranked(scores: DataFrame, reward: Reward, tie: Sequence[str] = ()) -> DataFrame:
    """scores with reward, the best first; null last."""
    return scores.withColumn("reward", reward.column()).orderBy(F.col("reward").desc_nulls_last(), *tie)
