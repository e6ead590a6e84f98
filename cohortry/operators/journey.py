"""Journeys: event sources to per-key sequences, and what can be asked of them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.time import bucket
from ..specs import EventSource, EventSources
from .relational import in_dates, union

METHODS = ("undeduped", "consecutive", "full", "count_map")


def events(source: EventSource) -> DataFrame:
    """keys, time, event, tie and extra columns of a source, filtered to its dates and conditions."""
    df = source.frame
    if source.date_col:
        df = in_dates(df, source.date_col, source.start_date, source.end_date)
    for c in source.conditions:
        df = df.where(c)
    event = F.lit(source.label) if source.label is not None else F.col(source.event_col).cast("string")
    tie = F.col(source.tie_col) if source.tie_col else F.lit(None)
    return df.select(*source.keys, F.col(source.time_col).alias("time"), event.alias("event"), tie.cast("long").alias("tie"), *source.extra)


def union_events(sources: EventSources) -> DataFrame:
    return union([events(s) for s in sources.resolved()])


def _gathered(df: DataFrame, keys: Sequence[str], order: Sequence[str] | None = None) -> DataFrame:
    """Events of each key as an array in order of the given list (others last), time, tie and name."""
    rank = F.lit(0)
    if order:
        rank = reduce(lambda c, i: c.when(F.col("event") == order[i], i), range(1, len(order)), F.when(F.col("event") == order[0], 0)).otherwise(len(order))
    item = F.struct(rank.alias("rank"), "time", "tie", "event")
    out = df.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("items"), F.min("time").alias("seq_start_time"), F.max("time").alias("seq_end_time"))
    return out.select(*keys, F.transform("items", lambda x: x["event"]).alias("event_seq"), "seq_start_time", "seq_end_time", F.size("items").alias("seq_length"))


def undeduped(df: DataFrame, keys: Sequence[str], order: Sequence[str] | None = None) -> DataFrame:
    return _gathered(df.where("event is not null"), keys, order)


def consecutive(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Runs of one event become one; times are of the events kept, so the end is the start of the last run.

    A null event goes, and one after a null is kept.
    """
    before = F.lag("event").over(W.partitionBy(*keys).orderBy("time", "tie", "event"))
    kept = df.withColumn("_before", before).where(F.col("event").isNotNull() & (F.col("_before").isNull() | (F.col("event") != F.col("_before"))))
    return _gathered(kept.drop("_before"), keys)


def fully_deduped(df: DataFrame, keys: Sequence[str], order: Sequence[str] | None = None) -> DataFrame:
    """The first of each event. Summed up by key and event before it travels on, so long journeys don't."""
    first = df.where("event is not null").groupBy(*keys, "event").agg(F.min(F.struct("time", "tie")).alias("f"))
    return _gathered(first.select(*keys, "event", "f.time", "f.tie"), keys, order)


def count_map(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The number of each event as a map (entries by name), with the journey's times."""
    each = df.where("event is not null").groupBy(*keys, "event").agg(F.count("*").alias("n"), F.min("time").alias("a"), F.max("time").alias("b"))
    out = each.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("event", "n"))).alias("e"), F.min("a").alias("seq_start_time"), F.max("b").alias("seq_end_time"), F.sum("n").alias("seq_length"))
    return out.select(*keys, F.map_from_entries("e").alias("event_count_map"), "seq_start_time", "seq_end_time", F.col("seq_length").cast("int").alias("seq_length"))


def sequences(df: DataFrame, keys: Sequence[str], method: str = "consecutive", order: Sequence[str] | None = None) -> DataFrame:
    if method not in METHODS:
        raise ValueError(f"unknown method {method}; known: {', '.join(METHODS)}")
    if method == "consecutive":
        return consecutive(df, keys)
    return count_map(df, keys) if method == "count_map" else {"undeduped": undeduped, "full": fully_deduped}[method](df, keys, order)


def heads(seq: DataFrame, n: int) -> DataFrame:
    """seq with its first n events as s1, ..., sn; null beyond its end."""
    return seq.select("*", *[F.get("event_seq", F.lit(i)).alias(f"s{i + 1}") for i in range(n)])


def first_steps(df: DataFrame, keys: Sequence[str], n: int, method: str = "undeduped") -> DataFrame:
    """keys, s1, ..., sn: the first n events of each journey, by method undeduped, consecutive or full. Ranks are cut off before anything
    is gathered, so a journey of any length (a bot's) is n rows and never one array; journeys without events have no row."""
    order = W.partitionBy(*keys).orderBy("time", "tie", "event")
    if method == "consecutive":
        before = F.lag("event").over(order)
        rows = df.withColumn("_before", before).where(F.col("event").isNotNull() & (F.col("_before").isNull() | (F.col("event") != F.col("_before"))))
    elif method == "full":
        rows = df.where("event is not null").groupBy(*keys, "event").agg(F.min(F.struct("time", "tie")).alias("f")).select(*keys, "event", "f.time", "f.tie")
    elif method == "undeduped":
        rows = df.where("event is not null")
    else:
        raise ValueError(f"no first steps by method {method}")
    some = rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n)
    return some.groupBy(*keys).agg(*[F.max(F.when(F.col("_r") == i + 1, F.col("event"))).alias(f"s{i + 1}") for i in range(n)])


def count_sequences(seq: DataFrame, n: int, distinct: str | None = None, end: str | None = None, by: Sequence[str] = (), conditions: Sequence[str] = ()) -> DataFrame:
    """How many journeys (or distinct values) begin with each s1..sn, and what percent of the total that is.

    With an end value, steps beyond the end show it; a journey that really holds that event stays a row of its own.
    """
    for c in conditions:
        seq = seq.where(c)
    steps = [f"s{i + 1}" for i in range(n)]
    base = heads(seq, n) if "s1" not in seq.columns else seq
    counted = base.groupBy(*steps, *by).agg((F.count_distinct(distinct) if distinct else F.count("*")).alias("seq_count"))
    out = counted.withColumn("percent", 100.0 * F.col("seq_count") / F.sum("seq_count").over(W.partitionBy()).cast("double"))
    return out.select(*[F.coalesce(s, F.lit(end)).alias(s) if end is not None else F.col(s) for s in steps], *by, "seq_count", "percent")


def holds(array: Column, wanted: Sequence[str] | None, every: bool = False) -> Column:
    """Whether an array has any, or every one, of the wanted values; true if none are named, false for a null array."""
    if wanted is None:
        return F.lit(True)
    names = list(dict.fromkeys(wanted))
    n = F.size(F.array_intersect(array, F.array(*[F.lit(x) for x in names])))
    return F.coalesce(n == len(names) if every else n > 0, F.lit(False))


def conversion(seq: DataFrame, numerator: Sequence[str] | None, denominator: Sequence[str] | None, every_numerator: bool = False, every_denominator: bool = False, distinct: str | None = None, by: Sequence[Column | str] = (), array: str = "event_seq") -> DataFrame:
    """Journeys (or distinct values) that hold the numerator over those that hold the denominator.

    The numerator isn't restricted to the denominator, so rates above 1 can be.
    """
    a, b = holds(F.col(array), numerator, every_numerator), holds(F.col(array), denominator, every_denominator)
    count = (lambda c: F.count_distinct(F.when(c, F.col(distinct)))) if distinct else F.count_if
    out = seq.groupBy(*by).agg(count(a).alias("numerator_count"), count(b).alias("denominator_count"))
    return out.withColumn("conversion_rate", F.try_divide(F.col("numerator_count").cast("double"), F.col("denominator_count").cast("double")))


def adoption(seq: DataFrame, wanted: Sequence[str], denominator: Sequence[str] | None = None, **how) -> DataFrame:
    """Conversion to every one of the wanted events."""
    return conversion(seq, wanted, denominator, every_numerator=True, **how)


def with_bucket(seq: DataFrame, freq: str = "D", time_col: str = "seq_start_time") -> DataFrame:
    return seq.withColumn("agg_time", bucket(F.col(time_col), freq))


def summary(seq: DataFrame, distinct: str, unit: str = "MINUTE", by: Sequence[str] = ()) -> DataFrame:
    """Distinct units, journeys, average length and duration in whole units."""
    span = F.timestamp_diff(unit, F.col("seq_start_time"), F.col("seq_end_time"))
    return seq.groupBy(*by).agg(F.count_distinct(distinct).alias("count"), F.count("*").alias("seq_count"), F.avg("seq_length").alias("avg_seq_length"), F.avg(span).alias("avg_seq_time"))


def slice_diff(df: DataFrame, response: str, slice_col: str, a: str, b: str, by: Sequence[str] = (), normalize: bool = False) -> DataFrame:
    """The response of two slices side by side and their difference, in percent of each slice's sum if normalised."""
    x = F.col(response).cast("double")
    if normalize:
        x = 100.0 * F.try_divide(x, F.sum(x).over(W.partitionBy(slice_col)))
    own = df.where(F.col(slice_col).isin(a, b)).withColumn("_x", x)
    one = own.where(F.col(slice_col) == a).select(*by, F.col("_x").alias(f"{response}_1"))
    two = own.where(F.col(slice_col) == b).select(*by, F.col("_x").alias(f"{response}_2"))
    both = one.join(two, list(by)) if by else one.crossJoin(two)
    return both.withColumn(f"{response}_diff", F.col(f"{response}_2") - F.col(f"{response}_1"))


def links(counts: DataFrame, n: int, value: str = "seq_count", end: str | None = None) -> DataFrame:
    """source, target, value of each step from one event to the next; a journey of one step links to itself (or to the end)."""
    steps = F.array(*[f"s{i + 1}" for i in range(n)])
    held = counts.select(F.filter(steps, lambda x: x.isNotNull()).alias("e"), F.col(value).alias("v")).where("size(e) > 0")
    if end is not None:
        held = held.withColumn("e", F.when(F.size("e") < n, F.concat("e", F.array(F.lit(end)))).otherwise(F.col("e")))
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.size("e") - 2, F.lit(0))))
    pairs = held.select("e", "v", at.alias("i"))
    tag = lambda x, i: F.concat(x, F.lit("_"), i.cast("string"))
    to = F.coalesce(F.get("e", F.col("i") + 1), F.get("e", F.col("i")))
    hop = F.when(F.size("e") == 1, F.col("i") + 1).otherwise(F.col("i") + 2)
    out = pairs.select(tag(F.get("e", F.col("i")), F.col("i") + 1).alias("source"), tag(to, hop).alias("target"), "v")
    return out.groupBy("source", "target").agg(F.sum("v").alias("value"))


def filter_sequences(counts: DataFrame, n: int, keep: Sequence[str], value: str = "seq_count") -> DataFrame:
    """Sequence counts with only the events to keep, moved up, summed again and with their percent anew; empty ones go."""
    steps = F.filter(F.array(*[f"s{i + 1}" for i in range(n)]), lambda x: x.isin(*keep))
    held = counts.withColumn("_e", steps).where("size(_e) > 0")
    out = held.groupBy(*[F.get("_e", F.lit(i)).alias(f"s{i + 1}") for i in range(n)]).agg(F.sum(value).alias(value))
    return out.withColumn("percent", 100.0 * F.col(value) / F.sum(value).over(W.partitionBy()).cast("double"))


def shown_sequences(seq: DataFrame, keep: Sequence[str] | None = None, sort: bool = False, top: int = 20) -> DataFrame:
    """The most frequent sequences as text with their counts, the others as one row."""
    from .metrics import category_distribution

    array = F.col("event_seq")
    array = F.filter(array, lambda x: x.isin(*keep)) if keep else array
    return category_distribution(seq.select(F.array_join(F.array_sort(array) if sort else array, ">").alias("sequence")), "sequence", top=top)


def sunburst(counts: DataFrame, n: int, dims: Sequence[str] = (), top: int = 5, value: str = "seq_count", end: str = "end") -> DataFrame:
    """Sequence counts by dims and steps: steps beyond the end filled, dim values beyond the top ones as Others."""
    for d in dims:
        best = counts.groupBy(F.col(d).alias(f"_{d}")).agg(F.sum(value).alias("_v")).orderBy(F.desc("_v"), f"_{d}").limit(top).select(f"_{d}", F.lit(True).alias("_top"))
        counts = counts.join(F.broadcast(best), F.col(d).eqNullSafe(F.col(f"_{d}")), "left").withColumn(d, F.when(F.col("_top"), F.col(d)).otherwise("Others")).drop(f"_{d}", "_top")
    steps = [f"s{i + 1}" for i in range(n)]
    out = counts.select(*dims, *[F.coalesce(s, F.lit(end)).alias(s) for s in steps], value)
    return out.groupBy(*dims, *steps).agg(F.sum(value).alias(value))
