"""Specifications: what to measure, on whom, and what to compare. Frozen values without any data."""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The label of a unit that an experiment did not trigger for, and of the control arm.
NOT_TRIGGERED = "nan"
CONTROL = "control"

AGGREGATES = {
    "SUM": F.sum,
    "AVG": F.avg,
    "MEAN": F.avg,
    "COUNT": F.count,
    "COUNT_DISTINCT": F.count_distinct,
    "MAX": F.max,
    "MIN": F.min,
    "STDDEV": F.stddev_samp,
    "FIRST": F.first,
    "LAST": F.last,
}


def aggregate(name: str, column: Column) -> Column:
    try:
        return AGGREGATES[name.upper()](column)
    except KeyError:
        raise ValueError(f"unknown aggregate {name}; known: {', '.join(AGGREGATES)}") from None


@dataclass(frozen=True)
class UnitMetric:
    """One value for each unit: an aggregate of the unit's rows, of those that meet the condition if there is one."""

    col: str
    agg: str = "SUM"
    name: str | None = None
    fill_na: float | None = None
    condition: str | None = None

    @property
    def alias(self) -> str:
        return self.name or f"{self.col}_{self.agg.lower()}"

    def column(self) -> Column:
        value = F.expr(self.col)
        return aggregate(self.agg, F.when(F.expr(self.condition), value) if self.condition else value).alias(self.alias)


@dataclass(frozen=True)
class Metric:
    """An aggregate over units, or the ratio of two."""

    numerator: str
    numerator_agg: str = "SUM"
    denominator: str | None = None
    denominator_agg: str = "SUM"
    name: str | None = None
    condition: str | None = None

    @property
    def alias(self) -> str:
        return self.name or (self.numerator if self.denominator is None else f"{self.numerator}_per_{self.denominator}")

    def _part(self, col: str, agg: str) -> Column:
        return aggregate(agg, F.when(F.expr(self.condition), F.col(col)) if self.condition else F.col(col))

    def numer(self) -> Column:
        return self._part(self.numerator, self.numerator_agg)

    def denom(self) -> Column | None:
        return None if self.denominator is None else self._part(self.denominator, self.denominator_agg)

    def value(self) -> Column:
        numer, denom = self.numer().cast("double"), self.denom()
        return numer if denom is None else F.try_divide(numer, denom.cast("double"))


@dataclass(frozen=True)
class MetricSource:
    """Metrics with the relation that they come from. Dates are inclusive; conditions are joined by AND."""

    name: str
    unit: str
    unit_metrics: tuple[UnitMetric, ...]
    metrics: tuple[Metric, ...] = ()
    date_col: str | None = None
    dims: tuple[str, ...] = ()
    condition: str | None = None


@dataclass(frozen=True)
class Experiment:
    """An assignment relation of (unit, variant)."""

    name: str
    assignment: DataFrame
    unit: str = "unit"
    variant: str = "variant"
    control: str = CONTROL
    start_date: str | None = None
    end_date: str | None = None


@dataclass(frozen=True)
class ComparisonPair:
    """Variants against variants; those in both sides are taken out of both, which must leave some on each."""

    treatment: tuple[tuple[str, ...], ...]
    control: tuple[tuple[str, ...], ...]
    name: str = ""

    def __post_init__(self) -> None:
        both = set(self.treatment) & set(self.control)
        if both:
            for side in ("treatment", "control"):
                object.__setattr__(self, side, tuple(v for v in getattr(self, side) if v not in both))
        if not self.treatment or not self.control:
            raise ValueError("a side of the comparison is empty once common variants are removed")


@dataclass(frozen=True)
class Launch:
    """The combination of arms to ship; one for each experiment, none missing."""

    arms: tuple[str, ...]

    def __post_init__(self) -> None:
        if NOT_TRIGGERED in self.arms:
            raise ValueError("a launch names an arm of every experiment")

    def variants(self) -> tuple[tuple[str, ...], ...]:
        """Every variant that the launch reaches: each arm kept or not triggered, but for none triggered at all."""
        if len(self.arms) == 1:
            return (self.arms,)
        some = itertools.product(*((a, NOT_TRIGGERED) for a in self.arms))
        return tuple(v for v in some if any(x != NOT_TRIGGERED for x in v))

    def against(self, control: Launch | None = None, name: str = "") -> ComparisonPair:
        control = control or Launch((CONTROL,) * len(self.arms))
        return ComparisonPair(self.variants(), control.variants(), name or "|".join(self.arms))


def consistent(variant: Sequence[str], pattern: Sequence[str | None]) -> bool:
    """Whether a variant matches a pattern in which None stands for anything."""
    return len(variant) == len(pattern) and all(p is None or p == v for v, p in zip(variant, pattern, strict=True))


@dataclass(frozen=True)
class EventSource:
    """A relation of events: its columns, a label or a column for the event, a filter and a window of dates."""

    frame: DataFrame
    label: str | None = None
    event_col: str | None = None
    time_col: str = "ts"
    keys: tuple[str, ...] = ("user_id",)
    tie_col: str | None = None
    date_col: str | None = None
    start_date: str | None = None
    end_date: str | None = None
    conditions: tuple[str, ...] = ()
    extra: tuple[str, ...] = ()


@dataclass(frozen=True)
class EventSources:
    """Event sources with what they have in common; a source's own settings win."""

    sources: tuple[EventSource, ...]
    common: dict = field(default_factory=dict)

    def resolved(self) -> tuple[EventSource, ...]:
        plain = {f: EventSource.__dataclass_fields__[f].default for f in self.common}
        return tuple(replace(s, **{f: v for f, v in self.common.items() if getattr(s, f) == plain[f]}) for s in self.sources)


def unique_unit_metrics(metrics: Sequence[UnitMetric]) -> tuple[UnitMetric, ...]:
    """Metrics without those that repeat another's column, aggregate and name."""
    seen: dict = {}
    for m in metrics:
        seen.setdefault((m.col, m.agg, m.name), m)
    return tuple(seen.values())
