"""Time expressions: buckets, parsing, shifting."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bucket codes and their truncation units.
UNITS = {"s": "second", "min": "minute", "h": "hour", "D": "day", "W": "week", "M": "month", "Q": "quarter", "Y": "year"}
WEEKDAYS = ("MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN")


def bucket(col: Column, freq: str = "D") -> Column:
    """The start of the bucket that holds col; weeks start on Monday."""
    try:
        return F.date_trunc(UNITS[freq], col)
    except KeyError:
        raise ValueError(f"unknown frequency {freq}; known: {', '.join(UNITS)}") from None


def normalise_time(col: Column, form: str = "timestamp", unit: str | None = None) -> Column:
    """A timestamp from unix_ms, unix_s, string or timestamp, truncated to the unit if one is given; bad strings are null."""
    forms = {"unix_ms": F.timestamp_millis, "unix_s": lambda c: F.timestamp_seconds(c), "string": lambda c: c.try_cast("timestamp"), "timestamp": lambda c: c.cast("timestamp")}
    if form not in forms:
        raise ValueError(f"unknown time form {form}")
    out = forms[form](col)
    return F.date_trunc(unit, out) if unit else out


def shift(col: Column, freq: str, n: int = 1) -> Column:
    """col moved by n periods; months, quarters and years clamp to the end of the month."""
    if freq in ("M", "Q", "Y"):
        months = n * {"M": 1, "Q": 3, "Y": 12}[freq]
        return col + F.make_ym_interval(F.lit(0), F.lit(months))
    seconds = n * {"s": 1, "min": 60, "h": 3600, "D": 86400, "W": 604800}[freq]
    return col + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds))


def period_end(col: Column, freq: str) -> Column:
    """The date that a period ends on: D, W (on Sunday), W-MON to W-SUN, M, Q, Y."""
    if freq.startswith("W"):
        last = WEEKDAYS.index(freq.partition("-")[2] or "SUN")
        return F.date_add(col.cast("date"), F.pmod(F.lit(last) - F.weekday(col), F.lit(7)))
    if freq == "D":
        return col.cast("date")
    return F.date_sub(shift(bucket(col, freq), freq).cast("date"), 1)


def rows_per_period(source: str, target: str) -> int:
    """How many rows of one frequency make a whole period of another."""
    table = {("D", "W"): 7, ("h", "D"): 24, ("h", "W"): 168, ("min", "h"): 60, ("min", "D"): 1440, ("s", "min"): 60, ("s", "h"): 3600}
    pair = source.partition("-")[0], target.partition("-")[0]
    if pair[0] == pair[1]:
        return 1
    if pair not in table:
        raise ValueError(f"no fixed number of {source} rows in {target}")
    return table[pair]


def lag_rows(orders: Sequence[int], source: str, period: str) -> list[int]:
    """Orders in whole periods as numbers of rows of the source's frequency."""
    return [k * rows_per_period(source, period) for k in orders]


#: How many steps to forecast by default, for steps of up to so many seconds: 10.05 minutes, 6.05 hours, 2.05 days, weeks and
#: months of 30 days, 1.01 years of 365 days, and longer ones (fixed values).
HORIZONS = ((10.05 * 60, 60), (6.05 * 3600, 24), (2.05 * 86400, 30), (2.05 * 604800, 12), (2.05 * 2592000, 12), (1.01 * 31536000, 2), (math.inf, 2))


def default_horizon(seconds: float, n: int | None = None) -> int:
    """The steps to forecast for steps of a length, at most half of the n observations."""
    steps = next(h for most, h in HORIZONS if seconds <= most)
    return steps if n is None else min(steps, n // 2)


def horizon_of(seconds: Column) -> Column:
    """`default_horizon` as a column; null for null."""
    out = F.when(seconds.isNull(), None)
    for most, steps in HORIZONS[:-1]:
        out = out.when(seconds <= most, steps)
    return out.otherwise(HORIZONS[-1][1])


def expected_rows(start: Column, freq: str, period: str) -> Column:
    """How many rows of freq the period that starts at start holds."""
    end = shift(start, period)
    seconds = end.cast("timestamp").cast("long") - start.cast("timestamp").cast("long")
    return (seconds / {"s": 1, "min": 60, "h": 3600, "D": 86400, "W": 604800}[freq]).cast("long")


def parse_time(col: Column, form: str | None = None) -> Column:
    """A timestamp from text in a Java pattern (or ISO); null where it doesn't parse."""
    return F.try_to_timestamp(col, F.lit(form)) if form else col.try_cast("timestamp")


def floor_time(col: Column, freq: str) -> Column:
    return bucket(col, freq)


def ceil_time(col: Column, freq: str) -> Column:
    """The next bucket's start, or col itself if it is one."""
    low = bucket(col, freq)
    return F.when(low == col, col).otherwise(shift(low, freq))


def is_dst(col: Column, zone: str) -> Column:
    """Whether daylight saving holds in a zone at a UTC time: its offset is above that of the year's least."""
    offset = lambda t: F.from_utc_timestamp(t, zone).cast("long") - t.cast("long")
    start = F.date_trunc("year", col)
    winter = F.least(offset(start), offset(start + F.expr("interval 6 months")))
    return offset(col) > winter


def window_end(start: str, days: int) -> str:
    """The date so many days after a partition date, `-00` at the end kept."""
    from datetime import date, timedelta

    tail = "-00" if start.endswith("-00") and len(start) > 10 else ""
    return f"{date.fromisoformat(start.removesuffix(tail) if tail else start) + timedelta(days=days)}{tail}"


def recent(col: Column, days: int, as_of: str | None = None) -> Column:
    """Whether a time is on or after the day so many days before a given day (today if none is given)."""
    day = F.current_date() if as_of is None else F.lit(as_of).cast("date")
    return col.cast("date") >= F.date_sub(day, days)


def _day_number(col: Column) -> Column:
    """Days since 31 December of the year before year 1."""
    return F.date_diff(col.cast("date"), F.lit("0001-01-01").cast("date")).cast("long") + 1


#: The day numbers of the first days of the civil Islamic and the Persian calendar (fixed values).
HIJRI_START, PERSIAN_START = 227015, 226895


def hijri(col: Column) -> Column:
    """year, month, day in the civil Islamic calendar: cycles of 30 years with 10,631 days, months of 30 and 29 days in turn."""
    days = _day_number(col) - HIJRI_START
    year = F.floor((30 * days + 10646) / 10631)
    at = days - (354 * (year - 1) + F.floor((3 + 11 * year) / 30))
    month = F.floor((11 * at + 330) / 325)
    day = at - (29 * (month - 1) + F.floor((6 * month - 1) / 11)) + 1
    return F.struct(year.cast("int").alias("year"), month.cast("int").alias("month"), day.cast("int").alias("day"))


def persian(col: Column) -> Column:
    """year, month, day in the arithmetic Persian calendar (Dershowitz and Reingold, Calendrical Calculations): cycles of 33 years with 8 leap days, six months of 31 days, then of 30."""
    days = _day_number(col) - PERSIAN_START
    starts = lambda year: 365 * (year - 1) + F.floor((8 * (year - 1) + 29) / 33)
    near = F.floor((33 * days + 3) / 12053) + 1
    near = F.when(starts(near + 1) <= days, near + 1).otherwise(near)
    year = F.when(starts(near) > days, near - 1).otherwise(near)
    at = days - starts(year)
    long = at < 186
    month = F.when(long, F.floor(at / 31) + 1).otherwise(F.floor((at - 186) / 30) + 7)
    day = F.when(long, at % 31 + 1).otherwise((at - 186) % 30 + 1)
    return F.struct(year.cast("int").alias("year"), month.cast("int").alias("month"), day.cast("int").alias("day"))
