"""Time series: regular grids, coarsening, shares, date-aware lags, imputation, normalisation, outliers, features, intervals.

A series is the rows of one combination of dims, ordered by a time column. Nothing here gathers a series beyond what a window
over its dims does, and lags by date are equi-joins, which split a long series over tasks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.time import expected_rows, horizon_of, period_end, rows_per_period, shift
from .relational import match, union

AGGS = {"mean": F.avg, "median": F.median, "max": F.max, "min": F.min, "sum": F.sum}
STEP = {"s": "interval 1 second", "min": "interval 1 minute", "h": "interval 1 hour", "D": "interval 1 day", "W": "interval 7 days", "M": "interval 1 month", "Q": "interval 3 months", "Y": "interval 1 year"}
#: Seconds of time that label_intervals puts in order at once.
SPAN_S = 600


def _finite(c: str) -> Column:
    x = F.col(c).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def regularize(df: DataFrame, time_col: str, values: Sequence[str], freq: str, dims: Sequence[str] = ()) -> DataFrame:
    """One row for each step from the first to the last of each series: of repeated times the least values by order stay,
    infinities become null, steps that were missing have null values."""
    one = df.where(F.col(time_col).isNotNull()).groupBy(*dims, F.col(time_col).cast("timestamp").alias(time_col)).agg(F.min(F.struct(*[_finite(v).alias(v) for v in values])).alias("_v"))
    one = one.select(*dims, time_col, "_v.*")
    ends = one.groupBy(*dims).agg(F.min(time_col).alias("_a"), F.max(time_col).alias("_b"))
    grid = ends.select(*dims, F.explode(F.expr(f"sequence(_a, _b, {STEP[freq]})")).alias(time_col))
    return match(grid, one, [*dims, time_col], "left")


def find_gaps(df: DataFrame, time_col: str, dims: Sequence[str] = ()) -> DataFrame:
    """Gaps of each series: where they start and end, and how many steps of the series' least step are missing."""
    before = F.lag(time_col).over(W.partitionBy(*dims).orderBy(time_col))
    steps = df.select(*dims, time_col).distinct().withColumn("gap_start", before).where("gap_start is not null")
    steps = steps.withColumn("_s", F.col(time_col).cast("timestamp").cast("long") - F.col("gap_start").cast("timestamp").cast("long"))
    least = steps.groupBy(*dims).agg(F.min("_s").alias("_least"))
    both = match(steps, least, dims)
    return both.where("_s > _least").select(*dims, "gap_start", F.col(time_col).alias("gap_end"), (F.col("_s") / F.col("_least") - 1).alias("gap_size"))


def describe(df: DataFrame, time_col: str, dims: Sequence[str] = ()) -> DataFrame:
    """Points, ends, and least, median and greatest step in seconds of each series; regular if all steps are equal."""
    before = F.lag(time_col).over(W.partitionBy(*dims).orderBy(time_col))
    steps = df.select(*dims, time_col).withColumn("_s", F.col(time_col).cast("timestamp").cast("long") - before.cast("timestamp").cast("long"))
    out = steps.groupBy(*dims).agg(F.count("*").alias("n"), F.min(time_col).alias("start"), F.max(time_col).alias("end"), F.min("_s").alias("min_step"), F.median("_s").alias("median_step"), F.max("_s").alias("max_step"))
    return out.withColumn("regular", F.coalesce(F.col("min_step") == F.col("max_step"), F.lit(True)))


def infer_freq(df: DataFrame, time_col: str, dims: Sequence[str] = ()) -> DataFrame:
    """The most frequent step of each series as a frequency, where it is one."""
    before = F.lag(time_col).over(W.partitionBy(*dims).orderBy(time_col))
    steps = df.select(*dims, time_col).distinct().withColumn("_s", F.col(time_col).cast("timestamp").cast("long") - before.cast("timestamp").cast("long")).where("_s is not null")
    top = steps.groupBy(*dims).agg(F.mode("_s", True).alias("step"))
    known = {1: "s", 60: "min", 3600: "h", 86400: "D", 604800: "W"}
    code = reduce(lambda c, k: c.when(F.col("step") == k, known[k]), known, F.when(F.col("step") < 1, None))
    days = F.col("step") / 86400
    return top.withColumn("freq", code.when(days.between(28, 31), "M").when(days.between(90, 92), "Q").when(days.between(365, 366), "Y"))


def duplicated_times(df: DataFrame, time_col: str, dims: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*dims, time_col).count().where("count > 1")


def coarsen(df: DataFrame, time_col: str, freq: str, agg: str = "sum", values: Sequence[str] = (), dims: Sequence[str] = ()) -> DataFrame:
    """Values by period, labelled with the date that ends it; the sum of nothing is 0, other aggregates of nothing are null."""
    out = [AGGS[agg](v) for v in values]
    out = [F.coalesce(x, F.lit(0)) if agg == "sum" else x for x in out]
    return df.groupBy(*dims, period_end(F.col(time_col), freq).alias(time_col)).agg(*[x.alias(v) for x, v in zip(out, values, strict=True)])


def share_within_period(df: DataFrame, time_col: str, values: Sequence[str], freq: str, period: str, dims: Sequence[str] = ()) -> DataFrame:
    """Each value over its period's total; null where the period lacks rows or the total is 0."""
    end = F.date_trunc(freq_unit(period), F.col(time_col)) if not period.startswith("W") else period_end(F.col(time_col), period)
    w = W.partitionBy(*dims, "_p")
    out, full = df.withColumn("_p", end), expected_rows(F.col("_p"), freq, period) if period in ("M", "Q", "Y") else rows_per_period(freq, period)
    for v in values:
        total = F.sum(v).over(w)
        out = out.withColumn(f"{v}_share", F.when((F.count("*").over(w) == full) & (total != 0), F.col(v) / total))
    return out.drop("_p")


def freq_unit(freq: str) -> str:
    return {"D": "day", "h": "hour", "min": "minute", "M": "month", "Q": "quarter", "Y": "year"}[freq]


def date_lags(df: DataFrame, time_col: str, value: str, freq: str, orders: Sequence[int], dims: Sequence[str] = ()) -> DataFrame:
    """df with <value>_lag<k>: the value exactly k periods before, null if that time isn't there. One equi-join, no windows."""
    kind = dict(df.dtypes)[time_col]
    moved = reduce(lambda c, k: c.when(F.col("_k") == k, shift(F.col(time_col), freq, k).cast(kind)), orders[1:], F.when(F.col("_k") == orders[0], shift(F.col(time_col), freq, orders[0]).cast(kind)))
    past = df.select(*dims, time_col, F.col(value).alias("_v"), F.explode(F.array(*[F.lit(k) for k in orders])).alias("_k"))
    # all orders meet in one join; the ends of months can meet when they move: the last of them counts
    past = past.select(*dims, moved.alias("_t"), F.col(time_col).alias("_o"), "_v", "_k").groupBy(*dims, F.col("_t").alias(time_col)).agg(
        *[F.max_by(F.when(F.col("_k") == k, F.col("_v")), F.when(F.col("_k") == k, F.col("_o"))).alias(f"{value}_lag{k}") for k in orders]
    )
    return match(df, past, [*dims, time_col], "left")


def date_diff(df: DataFrame, time_col: str, value: str, freq: str, orders: Sequence[int] = (1,), agg: str = "mean", relative: bool = False, dims: Sequence[str] = ()) -> DataFrame:
    """<value>_diff: the value less that of earlier dates (their aggregate if there are several; null if one is missing)."""
    lagged = date_lags(df, time_col, value, freq, orders, dims)
    names = [F.col(f"{value}_lag{k}").cast("double") for k in orders]
    some = reduce(lambda a, b: a & b, (n.isNotNull() for n in names))
    array = F.array(*names)
    past = {"mean": reduce(lambda a, b: a + b, names) / len(names), "sum": reduce(lambda a, b: a + b, names), "max": F.array_max(array), "min": F.array_min(array)}
    if agg == "median":
        s = F.array_sort(array)
        past["median"] = (F.get(s, F.lit((len(names) - 1) // 2)) + F.get(s, F.lit(len(names) // 2))) / 2
    x = F.when(some, past[agg])
    diff = F.col(value) - x
    return lagged.withColumn(f"{value}_diff", F.try_divide(diff, x) if relative else diff).drop(*[f"{value}_lag{k}" for k in orders])


def lags(df: DataFrame, time_col: str, value: str, orders: Sequence[int], dims: Sequence[str] = ()) -> DataFrame:
    """Values so many rows before, by position."""
    w = W.partitionBy(*dims).orderBy(time_col)
    return df.select("*", *[F.lag(value, k).over(w).alias(f"{value}_lag{k}") for k in orders])


def agg_lags(df: DataFrame, time_col: str, value: str, orders: Sequence[Sequence[int]] = (), intervals: Sequence[tuple[int, int]] = (), agg: str = "mean", dims: Sequence[str] = ()) -> DataFrame:
    """Aggregates of chosen lags, and of runs of lags from a to b."""
    w = W.partitionBy(*dims).orderBy(time_col)
    out = []
    for some in orders:
        xs = F.array_compact(F.array(*[F.lag(F.col(value).cast("double"), k).over(w) for k in some]))
        total = F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
        pick = {"mean": F.try_divide(total, F.size(xs).cast("double")), "sum": F.when(F.size(xs) > 0, total), "max": F.array_max(xs), "min": F.array_min(xs)}[agg]
        out.append(pick.alias(f"{value}_{agg}lag_{'_'.join(map(str, some))}"))
    for a, b in intervals:
        out.append(AGGS[agg](F.col(value).cast("double")).over(w.rowsBetween(-b, -a)).alias(f"{value}_{agg}lag_{a}_to_{b}"))
    return df.select("*", *out)


def impute_with_lags(df: DataFrame, time_col: str, value: str, orders: Sequence[int], rounds: int = 1, dims: Sequence[str] = ()) -> DataFrame:
    """Null values become the mean of the row's lags that are there; again so many times."""
    w = W.partitionBy(*dims).orderBy(time_col)
    for i in range(rounds):
        xs = F.array_compact(F.array(*[F.lag(F.col(value).cast("double"), k).over(w) for k in orders]))
        mean = F.try_divide(F.aggregate(xs, F.lit(0.0), lambda s, x: s + x), F.size(xs).cast("double"))
        df = df.withColumn("_m", mean).withColumn(value, F.coalesce(F.col(value).cast("double"), "_m")).drop("_m")
    return df


def interpolate(df: DataFrame, time_col: str, value: str, dims: Sequence[str] = ()) -> DataFrame:
    """Null values on the line between their neighbours by position; beyond the ends the nearest value."""
    w = W.partitionBy(*dims).orderBy(time_col)
    back, ahead = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(0, W.unboundedFollowing)
    x = F.col(value).cast("double")
    at = F.row_number().over(w)
    out = df.withColumn("_i", at).withColumn("_k", F.when(x.isNotNull(), F.col("_i")))
    out = out.select("*", F.last(x, True).over(back).alias("_a"), F.first(x, True).over(ahead).alias("_b"), F.last("_k", True).over(back).alias("_ia"), F.first("_k", True).over(ahead).alias("_ib"))
    line = F.col("_a") + (F.col("_b") - F.col("_a")) * F.try_divide((F.col("_i") - F.col("_ia")).cast("double"), (F.col("_ib") - F.col("_ia")).cast("double"))
    return out.withColumn(value, F.coalesce(x, line, "_a", "_b")).drop("_i", "_k", "_a", "_b", "_ia", "_ib")


def fill(df: DataFrame, time_col: str, value: str, forward: bool = True, dims: Sequence[str] = ()) -> DataFrame:
    w = W.partitionBy(*dims).orderBy(time_col)
    x = F.last(value, True).over(w.rowsBetween(W.unboundedPreceding, 0)) if forward else F.first(value, True).over(w.rowsBetween(0, W.unboundedFollowing))
    return df.withColumn(value, x)


METHODS = ("statistical", "zero_to_one", "minus_half_to_half", "zero_at_origin")


def normalize(df: DataFrame, values: Sequence[str], method: str = "zero_to_one", time_col: str | None = None, dims: Sequence[str] = ()) -> DataFrame:
    """Values less a centre over a width, of the whole series: statistics come from one aggregation and are joined back."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method}; known: {', '.join(METHODS)}")
    aggs = []
    for v in values:
        x = F.col(v).cast("double")
        low, high = F.min(x), F.max(x)
        centre = {"statistical": F.avg(x), "zero_to_one": low, "minus_half_to_half": (low + high) / 2, "zero_at_origin": F.min_by(x, F.col(time_col)) if time_col else F.first(x)}[method]
        width = F.stddev_samp(x) if method == "statistical" else high - low
        aggs += [centre.alias(f"_c_{v}"), width.alias(f"_w_{v}")]
    stats = df.groupBy(*dims).agg(*aggs)
    out = match(df, stats, dims)
    for v in values:
        out = out.withColumn(v, F.try_divide(F.col(v).cast("double") - F.col(f"_c_{v}"), F.col(f"_w_{v}")))
    return out.drop(*[f"_{k}_{v}" for v in values for k in "cw"])


def _differenced(df: DataFrame, value: str, time_col: str | None, baseline: int | None, dims: Sequence[str]) -> DataFrame:
    """_d: the value, or the value less the centred rolling median of 2 * baseline + 1 rows."""
    x = F.col(value).cast("double")
    if baseline is not None:
        near = F.sort_array(F.collect_list(x).over(W.partitionBy(*dims).orderBy(time_col).rowsBetween(-baseline, baseline)))
        df = df.withColumn("_near", near)
        middle = (F.get("_near", F.floor((F.size("_near") - 1) / 2).cast("int")) + F.get("_near", F.floor(F.size("_near") / 2).cast("int"))) / 2
        return df.withColumn("_d", x - middle).drop("_near")
    return df.withColumn("_d", x)


def _trimmed(df: DataFrame, trim: float, dims: Sequence[str]) -> DataFrame:
    if not trim:
        return df.where("_d is not null")
    ends = df.groupBy(*dims).agg(F.percentile("_d", F.array(F.lit(trim / 2), F.lit(1 - trim / 2))).alias("_q"))
    both = match(df, ends, dims)
    return both.where((F.col("_d") >= F.get("_q", F.lit(0))) & (F.col("_d") <= F.get("_q", F.lit(1))))


def zscore_outliers(df: DataFrame, value: str, cutoff: float = 5.0, trim: float = 0.05, time_col: str | None = None, baseline: int | None = None, dims: Sequence[str] = ()) -> DataFrame:
    """score and is_outlier by mean and population sd of the trimmed values."""
    base = _differenced(df, value, time_col, baseline, dims)
    stats = _trimmed(base, trim, dims).groupBy(*dims).agg(F.avg("_d").alias("_m"), F.stddev_pop("_d").alias("_s"))
    out = match(base, stats, dims, "left")
    out = out.withColumn("score", F.try_divide(F.col("_d") - F.col("_m"), F.col("_s")))
    return out.withColumn("is_outlier", F.coalesce(F.abs("score") > cutoff, F.lit(False))).drop("_d", "_m", "_s")


def tukey_outliers(df: DataFrame, value: str, cutoff: float = 1.0, lower: float = 0.1, upper: float = 0.9, trim: float = 0.05, time_col: str | None = None, baseline: int | None = None, dims: Sequence[str] = ()) -> DataFrame:
    """score: the distance beyond the quantiles over their difference; 0 between them."""
    base = _differenced(df, value, time_col, baseline, dims)
    stats = _trimmed(base, trim, dims).groupBy(*dims).agg(F.percentile("_d", F.array(F.lit(lower), F.lit(upper))).alias("_t"))
    out = match(base, stats, dims, "left")
    a, b = F.get("_t", F.lit(0)), F.get("_t", F.lit(1))
    beyond = F.when(F.col("_d") > b, F.col("_d") - b).when(F.col("_d") < a, F.col("_d") - a).otherwise(0.0)
    out = out.withColumn("score", F.try_divide(beyond, b - a))
    return out.withColumn("is_outlier", F.coalesce(F.abs("score") > cutoff, F.lit(False))).drop("_d", "_t")


def time_features(df: DataFrame, time_col: str, origin: str = "2000-01-01") -> DataFrame:
    """Calendar features of a time, whole and as fractions of day, week, month, quarter and year, and years since the origin with powers."""
    t = F.col(time_col).cast("timestamp")
    day = (F.hour(t) + F.minute(t) / 60 + F.second(t) / 3600) / 24
    last = F.dayofmonth(F.last_day(t))
    year = F.when(F.dayofyear(F.make_date(F.year(t), F.lit(12), F.lit(31))) == 366, 366).otherwise(365)
    quarter = F.date_diff(t.cast("date"), F.date_trunc("quarter", t).cast("date"))
    quarter_days = F.date_diff(F.add_months(F.date_trunc("quarter", t).cast("date"), 3), F.date_trunc("quarter", t).cast("date"))
    ct = (t.cast("long") - F.lit(origin).cast("timestamp").cast("long")) / (86400 * 365.25)
    dow = F.weekday(t) + 1
    features = {
        "year": F.year(t), "quarter": F.quarter(t), "month": F.month(t), "woy": F.weekofyear(t), "woy_iso": F.weekofyear(t), "year_iso": F.extract(F.lit("YEAROFWEEK"), t), "dow": dow,
        "dom": F.dayofmonth(t), "doq": quarter + 1, "doy": F.dayofyear(t), "hour": F.hour(t), "minute": F.minute(t), "second": F.second(t).cast("int"),
        "str_dow": F.concat(dow.cast("string"), F.lit("-"), F.date_format(t, "EEE")), "is_weekend": dow > 5, "days_in_month": last, "days_in_year": year,
        "month_start": F.dayofmonth(t) == 1, "month_end": F.dayofmonth(t) == last, "quarter_start": quarter == 0, "year_start": F.dayofyear(t) == 1, "is_leap": year == 366,
        "tod": 24 * day, "tow": dow - 1 + day, "tom": (F.dayofmonth(t) - 1 + day) / last, "toq": (quarter + day) / quarter_days, "toy": (F.dayofyear(t) - 1 + day) / year,
        "dow_hour": F.concat(dow.cast("string"), F.lit("_"), F.lpad(F.hour(t).cast("string"), 2, "0")), "year_month": F.date_format(t, "yyyy-MM"), "year_quarter": F.concat(F.year(t).cast("string"), F.lit("-"), F.quarter(t).cast("string")),
        "ct1": ct, "ct2": signed_pow(ct, 2), "ct3": signed_pow(ct, 3), "ct_sqrt": signed_pow(ct, 0.5), "ct_root3": signed_pow(ct, 1 / 3),
    }
    return df.select("*", *[c.alias(k) for k, c in features.items()])


def signed_pow(x: Column, power: float) -> Column:
    return F.signum(x) * F.pow(F.abs(x), F.lit(float(power)))


def logistic(x: Column, rate: float = 1.0, capacity: float = 1.0, floor: float = 0.0, inflection: float = 0.0) -> Column:
    return F.lit(floor) + F.lit(capacity) / (1 + F.exp(-F.lit(rate) * (x - F.lit(inflection))))


def fourier(df: DataFrame, col: str, period: float, order: int, name: str = "") -> DataFrame:
    """sin and cos of the first so many harmonics."""
    at = lambda k: F.lit(2 * math.pi * k / period) * F.col(col)
    return df.select("*", *[f(at(k)).alias(f"{n}{k}_{col}{'_' + name if name else ''}") for k in range(1, order + 1) for n, f in (("sin", F.sin), ("cos", F.cos))])


def changepoint_features(df: DataFrame, col: str, points: Sequence[float]) -> DataFrame:
    """How far each row is beyond each changepoint; 0 before it."""
    return df.select("*", *[F.greatest(F.col(col) - p, F.lit(0.0)).alias(f"changepoint{i}") for i, p in enumerate(points)])


def event_windows(events: DataFrame, date_col: str, label: str, before: int, after: int) -> DataFrame:
    """Each event's day and the days around it, labelled with their distance."""
    out = events.select(date_col, label, F.explode(F.sequence(F.lit(-before), F.lit(after))).alias("shift"))
    tag = F.when(F.col("shift") == 0, F.col(label)).when(F.col("shift") < 0, F.concat(label, F.lit("_minus_"), F.abs("shift").cast("string"))).otherwise(F.concat(label, F.lit("_plus_"), F.col("shift").cast("string")))
    return out.select(F.date_add(F.col(date_col).cast("date"), F.col("shift")).alias(date_col), tag.alias(label))


def event_windows_multi(events: dict[str, DataFrame], date_col: str, label: str, before: int = 1, after: int = 1, spans: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """event_windows of several calendars in one frame, with the calendar's name; spans: days before and after of some calendars."""
    out = [event_windows(df, date_col, label, *(spans or {}).get(name, (before, after))).withColumn("calendar", F.lit(name)) for name, df in events.items()]
    return union(out)


def holiday_features(df: DataFrame, date_col: str, holidays: DataFrame, names: Sequence[str] | None = None, before: int = 0, after: int = 0, holiday_date: str = "date", holiday: str = "holiday") -> DataFrame:
    """df with a column for each holiday that says whether a row's day is one (1 or 0), or so many days from one."""
    around = event_windows(holidays, holiday_date, holiday, before, after)
    names = list(names) if names is not None else sorted(r[0] for r in around.select(holiday).distinct().collect())
    marks = around.groupBy(F.col(holiday_date).alias("_day")).agg(*[F.max(F.when(F.col(holiday) == n, 1).otherwise(0)).alias(n) for n in names])
    return df.join(marks, F.col(date_col).cast("date") == F.col("_day"), "left").drop("_day").fillna(0, names)


def holiday_effects(df: DataFrame, time_col: str, value: str, holidays: DataFrame, offsets: Sequence[int] = (-7, 7), before: int = 0, after: int = 0, holiday_date: str = "date", holiday: str = "holiday", dims: Sequence[str] = ()) -> DataFrame:
    """For each holiday (and the days around it): on how many days, and by how much on average, the value differs from the mean of the
    days so many days from it. Days whose offset days are all missing don't count."""
    near = reduce(lambda d, k: date_lags(d, time_col, value, "D", [k], dims), [-k for k in offsets], df.select(*dims, time_col, value))
    past = [F.col(f"{value}_lag{-k}").cast("double") for k in offsets]
    n = reduce(lambda a, b: a + b, [x.isNotNull().cast("int") for x in past])
    base = F.try_divide(reduce(lambda a, b: a + b, [F.coalesce(x, F.lit(0.0)) for x in past]), n)
    scored = near.select(*dims, F.col(time_col).cast("date").alias("_day"), (F.col(value) - base).alias("score"))
    around = event_windows(holidays, holiday_date, holiday, before, after).select(F.col(holiday_date).alias("_day"), holiday)
    return scored.where("score is not null").join(around, "_day").groupBy(*dims, holiday).agg(F.count("*").alias("days"), F.avg("score").alias("effect"))


def holiday_groups(effects: DataFrame, groups: int, dims: Sequence[str] = ()) -> DataFrame:
    """effects with group: from 1, equally many holidays in each by rising effect (ties by name)."""
    name = next(c for c in effects.columns if c not in (*dims, "days", "effect"))
    return effects.withColumn("group", F.ntile(groups).over(W.partitionBy(*dims).orderBy("effect", name)))


def canonical(df: DataFrame, time_col: str, value: str, freq: str, dims: Sequence[str] = (), regressors: Sequence[str] = (), train_end: str | None = None, anomalies: DataFrame | None = None, delta: str | None = None) -> DataFrame:
    """A series ready to forecast: dims, ts, y, regressors, stage, on a regular grid.

    Values in anomalies (start_ts, end_ts and dims) are nulled, or moved by the column delta. Training ends at train_end or at the
    last value; later rows are `future` and keep their regressors only.
    """
    rows = df.select(*dims, F.col(time_col).cast("timestamp").alias("ts"), F.col(value).cast("double").alias("y"), *regressors, *([delta] if delta else []))
    if anomalies is not None:
        rows = adjust(label_intervals(rows, anomalies, "ts", on=dims), "y", delta).withColumn("y", F.col("adjusted_y"))
    full = regularize(rows, "ts", ["y", *regressors], freq, dims)
    last = F.max(F.when(F.col("y").isNotNull(), F.col("ts"))).over(W.partitionBy(*dims))
    end = last if train_end is None else F.least(last, F.lit(train_end).cast("timestamp"))
    full = full.withColumn("stage", F.when(F.col("ts") <= end, "train").otherwise("future"))
    return full.withColumn("y", F.when(F.col("stage") == "train", F.col("y"))).select(*dims, "ts", "y", *regressors, "stage")


def time_properties(df: DataFrame, time_col: str = "ts", dims: Sequence[str] = ()) -> DataFrame:
    """Of each canonical series: the ends of training and of all rows, their numbers, the step in seconds and rows to forecast."""
    train = F.col("stage") == "train"
    step = F.col(time_col).cast("long") - F.lag(time_col).over(W.partitionBy(*dims).orderBy(time_col)).cast("long")
    out = df.withColumn("_s", step).groupBy(*dims).agg(
        F.min(time_col).alias("start"), F.max(F.when(train, F.col(time_col))).alias("train_end"), F.max(time_col).alias("end"),
        F.count_if(train).alias("n_train"), F.count_if(~train).alias("n_future"), F.min("_s").alias("step"),
    )
    return out.withColumn("horizon", F.least(horizon_of(F.col("step")), F.floor(F.col("n_train") / 2).cast("int")))


def with_group(df: DataFrame, time_col: str, feature: str | None = None, rows: int | None = None, column: Column | None = None, name: str = "group", dims: Sequence[str] = ()) -> DataFrame:
    """df with a column to group by: a calendar feature, the first time of each run of so many rows (the last run whole), or any column."""
    if sum(x is not None for x in (feature, rows, column)) != 1:
        raise ValueError("name a feature, a number of rows or a column")
    if feature is not None:
        made = time_features(df, time_col)
        return made.select(*df.columns, F.col(feature).alias(name))
    if column is not None:
        return df.withColumn(name, column)
    back = F.row_number().over(W.partitionBy(*dims).orderBy(F.desc(time_col))) - 1
    out = df.withColumn("_run", F.floor(back / rows))
    return out.withColumn(name, F.min(time_col).over(W.partitionBy(*dims, "_run"))).drop("_run")


def exponential_baseline(df: DataFrame, time_col: str, value: str, alpha: float = 0.5, depth: int = 30, dims: Sequence[str] = ()) -> DataFrame:
    """<value>_smooth: the mean of a row and those before it, each weighing 1 - alpha times the next; the first `depth` of them."""
    w = W.partitionBy(*dims).orderBy(time_col)
    parts = [(F.lag(F.col(value).cast("double"), k).over(w), (1 - alpha) ** k) for k in range(depth)]
    total = reduce(lambda a, b: a + b, [F.coalesce(x * q, F.lit(0.0)) for x, q in parts])
    weight = reduce(lambda a, b: a + b, [F.when(x.isNotNull(), q).otherwise(0.0) for x, q in parts])
    return df.withColumn(f"{value}_smooth", F.try_divide(total, weight))


def add_events(df: DataFrame, events: DataFrame, date_col: str, event_date: str, label: str, regular: str = "") -> DataFrame:
    """df with the event of its day, or the regular label. Events are days of a calendar; the first by name where several meet."""
    one = events.groupBy(F.col(event_date).cast("date").alias("_d")).agg(F.min(label).alias(label))
    return df.join(one, F.col(date_col).cast("date") == F.col("_d"), "left").drop("_d").withColumn(label, F.coalesce(label, F.lit(regular)))


# intervals


def label_intervals(points: DataFrame, intervals: DataFrame, time_col: str, start: str = "start_ts", end: str = "end_ts", on: Sequence[str] = (), days: bool = True) -> DataFrame:
    """points with is_anomaly: inside an interval, ends included, of the same values of `on`.

    A time is inside one if the latest end of the intervals that start by then isn't earlier. Times and starts are put in order within spans
    of ten minutes, and the latest end of all earlier spans is carried into each, so the work grows with the rows, however many intervals
    overlap and however long they are; `days=False` compares each with each, for a handful of intervals.
    """
    iv = intervals.select(*on, F.col(start).cast("timestamp").alias("_a"), F.col(end).cast("timestamp").alias("_b")).where("_a <= _b")
    rows = points.withColumn("_t", F.col(time_col).cast("timestamp"))
    keys = [*on, "_t"]
    times = rows.where("_t is not null").select(*keys)
    if days:
        # each time once, with the latest end of the intervals that start at it
        ends = times.withColumn("_b", F.lit(None).cast("timestamp")).union(iv.select(*on, "_a", "_b")).groupBy(*keys).agg(F.max("_b").alias("_b"))
        ends = ends.withColumn("_span", F.floor(F.col("_t").cast("long") / SPAN_S))
        before = F.max("_b").over(W.partitionBy(*on).orderBy("_span").rowsBetween(W.unboundedPreceding, -1))
        carried = ends.groupBy(*on, "_span").agg(F.max("_b").alias("_b")).select(*on, F.lit(None).cast("timestamp").alias("_t"), before.alias("_b"), "_span")
        # what is carried has no time and so comes first
        seen = F.max("_b").over(W.partitionBy(*on, "_span").orderBy(F.asc_nulls_first("_t")).rowsBetween(W.unboundedPreceding, 0))
        hits = ends.union(carried).withColumn("_seen", seen).where("_seen >= _t")
    else:
        hits = times.distinct().alias("r").join(iv.alias("i"), [F.col(f"r.{k}").eqNullSafe(F.col(f"i.{k}")) for k in on] + [F.col("_t") >= F.col("_a"), F.col("_t") <= F.col("_b")], "left_semi")
    out = match(rows, hits.select(*keys).withColumn("is_anomaly", F.lit(True)), keys, "left")
    return out.withColumn("is_anomaly", F.coalesce("is_anomaly", F.lit(False))).drop("_t")


def adjust(points: DataFrame, value: str, delta: str | None = None, flag: str = "is_anomaly") -> DataFrame:
    """Flagged values null, or moved by a delta column."""
    new = F.lit(None).cast("double") if delta is None else F.col(value) + F.coalesce(F.col(delta), F.lit(0.0))
    return points.withColumn(f"adjusted_{value}", F.when(F.col(flag), new).otherwise(F.col(value).cast("double")))


def islands(df: DataFrame, time_col: str, flag: str, dims: Sequence[str] = ()) -> DataFrame:
    """start_ts and end_ts of each run of flagged rows."""
    w = W.partitionBy(*dims).orderBy(time_col)
    first = df.withColumn("_on", F.coalesce(F.col(flag), F.lit(False))).withColumn("_new", F.col("_on") & ~F.coalesce(F.lag("_on").over(w), F.lit(False)))
    first = first.withColumn("_run", F.sum(F.col("_new").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return first.where("_on").groupBy(*dims, "_run").agg(F.min(time_col).alias("start_ts"), F.max(time_col).alias("end_ts"), F.count("*").alias("n")).drop("_run")


def merge_intervals(df: DataFrame, start: str = "start_ts", end: str = "end_ts", gap: str = "interval 0 seconds", dims: Sequence[str] = ()) -> DataFrame:
    """Intervals that overlap, or are no further apart than the gap, as one; invalid ones (end before start) go."""
    good = df.where(F.col(start) <= F.col(end)).select(*dims, F.col(start).alias("start_ts"), F.col(end).alias("end_ts"))
    w = W.partitionBy(*dims).orderBy("start_ts", "end_ts")
    seen = F.max("end_ts").over(w.rowsBetween(W.unboundedPreceding, -1))
    out = good.withColumn("_seen", seen).withColumn("_new", F.coalesce(F.col("start_ts") > F.col("_seen") + F.expr(gap), F.lit(True)).cast("int"))
    out = out.withColumn("_i", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return out.groupBy(*dims, "_i").agg(F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts")).drop("_i")


def level_shifts(df: DataFrame, time_col: str, value: str, cutoff: float = 3.0, dims: Sequence[str] = ()) -> DataFrame:
    """is_shift where the absolute step to a row is over so many sample sds beyond the mean step."""
    step = F.abs(F.col(value) - F.lag(value).over(W.partitionBy(*dims).orderBy(time_col)))
    rows = df.withColumn("step", step)
    stats = rows.groupBy(*dims).agg(F.avg("step").alias("_m"), F.stddev_samp("step").alias("_s"))
    out = match(rows, stats, dims)
    return out.withColumn("is_shift", F.coalesce((F.col("step") - F.col("_m")) / F.col("_s") > cutoff, F.lit(False))).drop("_m", "_s")


def lags_of(df: DataFrame, time_col: str, orders: dict[str, Sequence[int]], dims: Sequence[str] = ()) -> DataFrame:
    """lags for several columns, each with orders of its own."""
    for value, some in orders.items():
        df = lags(df, time_col, value, some, dims)
    return df


def impute_columns(df: DataFrame, time_col: str, values: Sequence[str], orders: Sequence[int], rounds: int = 1, dims: Sequence[str] = ()) -> DataFrame:
    return reduce(lambda d, v: impute_with_lags(d, time_col, v, orders, rounds, dims), values, df)


def outlier_intervals(df: DataFrame, time_col: str, value: str, cutoff: float = 3.0, trim: float = 0.01, dims: Sequence[str] = ()) -> DataFrame:
    """Runs of z-score outliers as intervals."""
    return islands(zscore_outliers(df, value, cutoff, trim, dims=dims), time_col, "is_outlier", dims)


def overlays(df: DataFrame, value: str, group: str, label: str, labels: Sequence[object], agg: str = "avg", quantiles: Sequence[float] = (), center: bool = False, dims: Sequence[str] = ()) -> DataFrame:
    """A row for each group (a column, such as the day of the week) with the mean and quantiles (q25 for 0.25) of all values, and a column for each label
    (a column, such as the year) with the aggregate of its values; null where a label has none.

    With center, each label's column is moved so that its groups' mean is 0, and the mean and quantiles together so that the mean's is.
    """
    how = {"avg": F.avg, "median": F.median, "sum": F.sum, "max": F.max, "min": F.min}[agg]
    x = F.col(value).cast("double")
    named = {f"overlay_{v}": how(F.when(F.col(label) == F.lit(v), x)) for v in labels}
    spread = {f"q{100 * q:g}": F.percentile(x, F.lit(float(q))) for q in quantiles}
    out = df.groupBy(*dims, group).agg(F.avg(x).alias("mean"), *[c.alias(k) for k, c in (spread | named).items()])
    if not center:
        return out
    whole = W.partitionBy(*dims)
    middle = F.avg("mean").over(whole)
    return out.select(*dims, group, *[(F.col(f"`{k}`") - middle).alias(k) for k in ("mean", *spread)], *[(F.col(k) - F.avg(k).over(whole)).alias(k) for k in named])


def with_position(df: DataFrame, time_col: str, group: str, name: str = "position", dims: Sequence[str] = ()) -> DataFrame:
    """df with each row's place, from 1, within its group by time; a label for overlays."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*dims, group).orderBy(time_col)))
