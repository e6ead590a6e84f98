"""Holidays by rule, and which of them a series should tell apart.

A rule is a day of a month, the n-th weekday of a month (from its end if negative), so many days from Easter Sunday, or a day of the
civil Islamic calendar; it may hold in some countries and years only. Dates are column expressions over years, so a calendar of
any span is one small plan. Effects of holidays (see `series.holiday_effects`) are grouped by exact one-dimensional clustering.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.time import hijri

MON, TUE, WED, THU, FRI, SAT, SUN = range(7)


@dataclass(frozen=True)
class Rule:
    """One holiday. kind: fixed (month, day), nth (month, weekday, n), easter (offset in days) or hijri (month, day)."""

    holiday: str
    kind: str
    month: int | None = None
    day: int | None = None
    weekday: int | None = None
    n: int | None = None
    offset: int = 0
    country: str | None = None
    category: str = "public"
    first_year: int | None = None
    last_year: int | None = None

    def __post_init__(self) -> None:
        needed = {"fixed": ("month", "day"), "nth": ("month", "weekday", "n"), "easter": (), "hijri": ("month", "day")}
        if self.kind not in needed:
            raise ValueError(f"unknown kind of rule {self.kind}; known: {', '.join(needed)}")
        if any(getattr(self, f) is None for f in needed[self.kind]):
            raise ValueError(f"a rule of kind {self.kind} needs {', '.join(needed[self.kind])}")


#: Some countries' holidays (fixed values).
RULES = (
    Rule("New Year's Day", "fixed", 1, 1, country="US"), Rule("Martin Luther King Jr. Day", "nth", 1, weekday=MON, n=3, country="US", first_year=1986), Rule("Presidents' Day", "nth", 2, weekday=MON, n=3, country="US"),
    Rule("Memorial Day", "nth", 5, weekday=MON, n=-1, country="US"), Rule("Juneteenth", "fixed", 6, 19, country="US", first_year=2021), Rule("Independence Day", "fixed", 7, 4, country="US"), Rule("Labor Day", "nth", 9, weekday=MON, n=1, country="US"),
    Rule("Columbus Day", "nth", 10, weekday=MON, n=2, country="US"), Rule("Halloween", "fixed", 10, 31, country="US", category="observance"), Rule("Veterans Day", "fixed", 11, 11, country="US"), Rule("Thanksgiving", "nth", 11, weekday=THU, n=4, country="US"),
    Rule("Christmas Day", "fixed", 12, 25, country="US"), Rule("New Year's Day", "fixed", 1, 1, country="GB"), Rule("Good Friday", "easter", offset=-2, country="GB"), Rule("Easter Monday", "easter", offset=1, country="GB"),
    Rule("Early May Bank Holiday", "nth", 5, weekday=MON, n=1, country="GB"), Rule("Summer Bank Holiday", "nth", 8, weekday=MON, n=-1, country="GB"), Rule("Christmas Day", "fixed", 12, 25, country="GB"), Rule("Boxing Day", "fixed", 12, 26, country="GB"),
    Rule("Neujahr", "fixed", 1, 1, country="DE"), Rule("Karfreitag", "easter", offset=-2, country="DE"), Rule("Ostermontag", "easter", offset=1, country="DE"), Rule("Tag der Arbeit", "fixed", 5, 1, country="DE"), Rule("Christi Himmelfahrt", "easter", offset=39, country="DE"),
    Rule("Pfingstmontag", "easter", offset=50, country="DE"), Rule("Tag der Deutschen Einheit", "fixed", 10, 3, country="DE", first_year=1990), Rule("1. Weihnachtstag", "fixed", 12, 25, country="DE"), Rule("2. Weihnachtstag", "fixed", 12, 26, country="DE"),
    Rule("Easter Sunday", "easter", category="christian"), Rule("Islamic New Year", "hijri", 1, 1, category="islamic"), Rule("Eid al-Fitr", "hijri", 10, 1, category="islamic"), Rule("Eid al-Adha", "hijri", 12, 10, category="islamic"),
)


def easter(year: Column) -> Column:
    """Easter Sunday of a Gregorian year, from the age of the moon and the day of the week (the published ecclesiastical rule)."""
    y = year.cast("long")
    golden, century = y % 19, F.floor(y / 100)
    leapless, moon = century - F.floor(century / 4), F.floor((8 * century + 13) / 25)
    age = F.pmod(19 * golden + leapless - moon + 15, F.lit(30))
    age = age - F.when((age == 29) | ((age == 28) & (golden > 10)), 1).otherwise(0)
    full = F.date_add(F.make_date(year.cast("int"), F.lit(3), F.lit(21)), age.cast("int"))
    return F.date_add(full, F.lit(7) - F.pmod(F.weekday(full) + 1, F.lit(7)))  # the Sunday after it


def nth_weekday(year: Column, month: Column, weekday: Column, n: Column) -> Column:
    """The n-th weekday (Monday is 0) of a month, from its end if n is negative; null if the month has fewer."""
    first = F.make_date(year.cast("int"), month, F.lit(1))
    last = F.last_day(first)
    ahead = F.date_add(first, (F.pmod(weekday - F.weekday(first), F.lit(7)) + 7 * (n - 1)).cast("int"))
    back = F.date_sub(last, (F.pmod(F.weekday(last) - weekday, F.lit(7)) + 7 * (-n - 1)).cast("int"))
    made = F.when(n > 0, ahead).otherwise(back)
    return F.when(F.month(made) == month, made)


def holidays(years: DataFrame, rules: Sequence[Rule] = RULES, countries: Sequence[str] | None = None, categories: Sequence[str] | None = None, observed: bool = False) -> DataFrame:
    """date, holiday, country, category of the rules' days in the years (a column `year`); null country: everywhere.

    countries and categories keep rules of these (rules without a country hold in all). With observed, a public holiday on a Saturday also
    has the Friday before, one on a Sunday the Monday after, as `<name> (observed)`. Years and rules are few; days that don't exist are left out.
    """
    some = [r for r in rules if (countries is None or r.country is None or r.country in countries) and (categories is None or r.category in categories)]
    spark = years.sparkSession
    schema = "holiday string, kind string, month int, day int, weekday int, n int, offset int, country string, category string, first_year int, last_year int"
    table = spark.createDataFrame([tuple(asdict(r).values()) for r in some], schema)
    every = years.select(F.col("year").cast("int").alias("year")).where("year IS NOT NULL").distinct().crossJoin(F.broadcast(table))
    every = every.where((F.col("first_year").isNull() | (F.col("year") >= F.col("first_year"))) & (F.col("last_year").isNull() | (F.col("year") <= F.col("last_year"))))
    y, month, day = F.col("year"), F.col("month"), F.col("day")
    of_year = F.sequence(F.make_date(y, F.lit(1), F.lit(1)), F.make_date(y, F.lit(12), F.lit(31)))
    fixed = F.try_to_date(F.format_string("%04d-%02d-%02d", y, month, day), "yyyy-MM-dd")
    lunar = F.filter(of_year, lambda d: (hijri(d)["month"] == month) & (hijri(d)["day"] == day))
    dates = F.when(F.col("kind") == "hijri", lunar).otherwise(F.array(F.when(F.col("kind") == "fixed", fixed).when(F.col("kind") == "nth", nth_weekday(y, month, F.col("weekday"), F.col("n"))).otherwise(F.date_add(easter(y), F.col("offset")))))
    out = every.select(F.explode(dates).alias("date"), "holiday", "country", "category").where("date IS NOT NULL")
    if observed:
        moved = F.when(F.weekday("date") == SAT, F.date_sub("date", 1)).when(F.weekday("date") == SUN, F.date_add("date", 1))
        out = out.unionByName(out.where("category = 'public'").select(moved.alias("date"), F.concat("holiday", F.lit(" (observed)")).alias("holiday"), "country", "category").where("date IS NOT NULL"))
    return out


# groups of holidays by effect


def split_points(values: np.ndarray, k: int) -> list[int]:
    """Where sorted values are cut into k runs of least squares within them: exact k-means of one dimension, by dynamic programming."""
    n = len(values)
    k = min(k, len(np.unique(values)))
    s, q = np.concatenate([[0], np.cumsum(values)]), np.concatenate([[0], np.cumsum(values**2)])
    cost = lambda a, b: q[b] - q[a] - (s[b] - s[a]) ** 2 / (b - a)
    best = np.array([0.0, *(cost(0, b) for b in range(1, n + 1))])
    came = []
    for level in range(2, k + 1):
        new, at = np.full(n + 1, np.inf), np.zeros(n + 1, int)
        for b in range(level, n + 1):
            own = np.array([best[a] + cost(a, b) for a in range(level - 1, b)])
            at[b] = level - 1 + int(np.argmin(own))
            new[b] = own.min()
        best = new
        came.append(at)
    cuts, b = [], n
    for at in reversed(came):
        b = int(at[b])
        cuts.append(b)
    return cuts[::-1]


def valleys(values: np.ndarray, width: float | None = None, points: int = 512) -> list[float]:
    """Where the density of some values has its valleys (normal kernels, of Silverman's width if none is given)."""
    if len(values) < 2 or values.std() == 0:
        return []
    h = width or 0.9 * min(values.std(ddof=1), (np.subtract(*np.percentile(values, [75, 25])) or np.inf) / 1.34) * len(values) ** -0.2
    x = np.linspace(values.min() - 3 * h, values.max() + 3 * h, points)
    y = np.exp(-0.5 * ((x[:, None] - values[None]) / h) ** 2).sum(1)
    return [float(x[i]) for i in range(1, points - 1) if y[i] < y[i - 1] and y[i] <= y[i + 1]]


def holiday_clusters(effects: DataFrame, k: int | None = None, by: Sequence[str] = (), least_days: int = 1, least_effect: float = 0.0, same_sign: float = 0.0, width: float | None = None) -> DataFrame:
    """effects (holiday, days, effect, and `same_sign` where that is asked for) with group and group_effect: from 1 by rising effect, null for
    holidays with too few days, too little effect or too mixed signs.

    Given k, groups are those of least squares within (exact); else they part at the valleys of the effects' density. A series' holidays
    are few; each series is one task.
    """
    kinds = dict(effects.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in effects.columns), "`group` int, group_effect double"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ok = (pdf["days"] >= least_days) & (pdf["effect"].abs() >= least_effect) & pdf["effect"].notna()
        if same_sign > 0:
            ok &= pdf["same_sign"] >= same_sign
        own = pdf[ok].sort_values(["effect", "holiday"])
        values = own["effect"].to_numpy(float)
        if len(values) and k is not None:
            group = 1 + np.searchsorted(split_points(values, k), np.arange(len(values)), "right")
        else:
            group = 1 + np.searchsorted(valleys(values, width), values, "left")
        own = own.assign(group=np.unique(group, return_inverse=True)[1] + 1 if len(group) else group)
        own = own.assign(group_effect=own.groupby("group")["effect"].transform("mean"))
        rest = pdf[~ok].assign(group=None, group_effect=None)
        out = pd.concat([own, rest]) if len(own) and len(rest) else own if len(own) else rest
        return out.assign(group=out["group"].astype("Int32"))

    return effects.groupBy(*by).applyInPandas(run, schema)


def holiday_roles(effects: DataFrame, alone: float = 0.85, kept: float = 1.0, by: Sequence[str] = ()) -> DataFrame:
    """effects with role: `alone` for the holidays of most absolute effect that together make up a share of all, `positive` or `negative` for
    those that follow up to the share kept (to be told apart by sign only), `none` for the rest. Ties go by name."""
    size = F.abs("effect") * F.col("days")
    order = W.partitionBy(*by).orderBy(F.desc(size), "holiday")
    before = F.coalesce(F.sum(size).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    share = F.try_divide(before, F.sum(size).over(W.partitionBy(*by)))
    sign = F.when(F.col("effect") > 0, "positive").otherwise("negative")
    return effects.withColumn("role", F.when(size.isNull() | (size == 0), "none").when(share < alone, "alone").when(share < kept, sign).otherwise("none"))
