"""Unit metrics, aggregates across units, time-bucketed metrics, segments and distributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.time import bucket
from ..specs import Metric, MetricSource, UnitMetric, unique_unit_metrics
from .relational import in_dates, union


def unit_metrics(df: DataFrame, source: MetricSource, start: str | None = None, end: str | None = None, dims: Sequence[str] | None = None, condition: str | None = None) -> DataFrame:
    """One row for each unit (and dims): the first of two aggregations, with filters and dates below it."""
    if source.date_col:
        df = in_dates(df, source.date_col, start, end)
    for c in (source.condition, condition):
        df = df.where(c) if c else df
    keys = [source.unit, *(source.dims if dims is None else dims)]
    return df.groupBy(*keys).agg(*[m.column() for m in unique_unit_metrics(source.unit_metrics)])


def _across(metrics: Sequence[Metric]) -> list[Column]:
    out = []
    for m in metrics:
        denom = m.denom()
        out.append(m.numer().cast("double").alias(f"{m.alias}_numer"))
        out.append((F.lit(None) if denom is None else denom).cast("double").alias(f"{m.alias}_denom"))
        out.append(m.value().alias(m.alias))
        out.append(F.count(F.col(m.numerator)).alias(f"{m.alias}_sample_count"))
    return [*out, F.count("*").alias("sample_count")]


def agg_metrics(df: DataFrame, source: MetricSource, start: str | None = None, end: str | None = None, condition: str | None = None) -> DataFrame:
    """Two layers: to units, then across units for each combination of dims. A ratio is null where its denominator is 0."""
    units = unit_metrics(df, source, start, end, condition=condition)
    columns = _across(source.metrics)
    return units.groupBy(*source.dims).agg(*columns) if source.dims else units.agg(*columns)


def to_long(wide: DataFrame, source: MetricSource) -> DataFrame:
    """metric_family, metric, numer, denom, value, sample_count and dims: a row for each metric."""
    each = [F.struct(F.lit(m.alias).alias("metric"), F.col(f"{m.alias}_numer").alias("numer"), F.col(f"{m.alias}_denom").alias("denom"), F.col(m.alias).alias("value"), F.col(f"{m.alias}_sample_count").alias("sample_count")) for m in source.metrics]
    return wide.select(*source.dims, F.lit(source.name).alias("metric_family"), F.explode(F.array(*each)).alias("m")).select("metric_family", "m.*", *source.dims)


def time_metrics(df: DataFrame, source: MetricSource, time_col: str, freq: str = "D", start: str | None = None, end: str | None = None) -> DataFrame:
    """agg_metrics by time bucket (ts): units are summed up for each raw time first, then raw times fall into buckets."""
    units = unit_metrics(df, source, start, end, dims=[time_col, *source.dims])
    return units.groupBy(bucket(F.col(time_col), freq).alias("ts"), *source.dims).agg(*_across(source.metrics))


def segments(df: DataFrame, impacted: DataFrame, source: MetricSource, key: str | None = None) -> DataFrame:
    """agg_metrics of all units (raw), of impacted ones and of the others (complement), in one pass over the data.

    Units are tagged by one join after the first aggregation; a null unit is in raw alone.
    """
    units = unit_metrics(df, source)
    marks = impacted.select(F.col(key or source.unit).alias(source.unit)).where(F.col(source.unit).isNotNull()).distinct().withColumn("segment", F.lit("impacted"))
    tagged = units.join(marks, source.unit, "left").withColumn("segment", F.when(F.col(source.unit).isNull(), None).otherwise(F.coalesce("segment", F.lit("complement"))))
    both = tagged.withColumn("segment", F.explode(F.array(F.lit("raw"), "segment"))).where("segment is not null")
    return both.groupBy("segment", *source.dims).agg(*_across(source.metrics))


def impacted_units(assignments: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    """Each unit of any experiment, once."""
    out = None
    for df, unit in assignments:
        units = df.select(F.col(unit).alias("unit"))
        out = units if out is None else out.unionAll(units)
    return out.where("unit is not null").distinct()


def freq(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count and percentage of each combination."""
    return df.groupBy(*columns).count().withColumn("percent", 100.0 * F.col("count") / F.sum("count").over(W.partitionBy()))


def collapse_dims(df: DataFrame, dims: Sequence[str], values: Sequence[str], rank_by: str, k: int, fallback: str = "Other", keep: Sequence[str] = ()) -> DataFrame:
    """Top k combinations of dims by their total; the rest become the fallback in every dim, and values are summed again.

    Ties go to the first combination by dims. Only the k winners are broadcast.
    """
    totals = df.groupBy(*dims).agg(F.sum(rank_by).alias("_total"))
    top = totals.orderBy(F.desc("_total"), *dims).limit(k).select(*[F.col(d).alias(f"_{d}") for d in dims], F.lit(True).alias("_top"))
    cond = [F.col(d).eqNullSafe(F.col(f"_{d}")) for d in dims]
    marked = df.join(F.broadcast(top), cond, "left").select(*[F.when(F.col("_top"), F.col(d)).otherwise(F.lit(fallback)).alias(d) for d in dims], *keep, *values)
    return marked.groupBy(*dims, *keep).agg(*[F.sum(v).alias(v) for v in values])


def category_distribution(df: DataFrame, col: str, distinct: str | None = None, top: int = 20, other: str = "Other") -> DataFrame:
    """Counts of a column's values (null as NA), largest first; those beyond the top are one row. Ties go by name."""
    n = F.count_distinct(distinct) if distinct else F.count("*")
    counts = df.groupBy(F.coalesce(F.col(col).cast("string"), F.lit("NA")).alias(col)).agg(n.alias("count"))
    best = counts.orderBy(F.desc("count"), col).limit(top)
    rest = counts.join(F.broadcast(best.select(col)), col, "left_anti").agg(F.lit(other).alias(col), F.sum("count").alias("count")).where("count is not null")
    both = best.union(rest.select(col, "count"))
    return both.withColumn("percent", 100.0 * F.col("count") / F.sum("count").over(W.partitionBy()))


def distinct_per_entity(df: DataFrame, entity: Sequence[str], col: str) -> DataFrame:
    """How many entities have each number of distinct values."""
    return df.groupBy(*entity).agg(F.count_distinct(col).alias("n_values")).groupBy("n_values").agg(F.count("*").alias("entities"))


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows, and distinct values, nulls, least and greatest of each column, from one pass over the data."""
    aggs = [F.count("*").alias("rows")]
    for c in columns:
        aggs += [F.count_distinct(c).alias(f"{c}_n"), F.count_if(F.col(c).isNull()).alias(f"{c}_nulls"), F.min(F.col(c).cast("string")).alias(f"{c}_min"), F.max(F.col(c).cast("string")).alias(f"{c}_max")]
    each = [F.struct(F.lit(c).alias("column"), F.col("rows"), F.col(f"{c}_n").alias("n_distinct"), F.col(f"{c}_nulls").alias("n_null"), F.col(f"{c}_min").alias("least"), F.col(f"{c}_max").alias("greatest")) for c in columns]
    return df.agg(*aggs).select(F.explode(F.array(*each)).alias("x")).select("x.*")


def inspect(frames: dict[str, DataFrame], columns: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """describe of several relations in one frame, with the relation's name; all columns where none are named."""
    out = [describe(df, (columns or {}).get(name) or df.columns).withColumn("relation", F.lit(name)) for name, df in frames.items()]
    return union(out)


def json_of(counts: Column) -> Column:
    """A map as JSON text with its keys in order, so that equal maps have equal texts."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(counts))))


def matching(names: Sequence[str], include: str | None = None, exclude: str | None = None) -> list[str]:
    """Names that match the pattern to include, or else don't match the one to exclude."""
    import re

    if include:
        return [n for n in names if re.search(include, n)]
    return [n for n in names if not (exclude and re.search(exclude, n))]


def weighted_mean(df: DataFrame, col: str, by: str, strata: DataFrame, weight: str) -> DataFrame:
    """The mean of strata's means by their weights; strata that df lacks don't count."""
    means = df.groupBy(by).agg(F.avg(col).alias("_m")).join(strata.select(by, weight), by)
    return means.agg((F.sum(F.col("_m") * F.col(weight)) / F.sum(weight)).alias("weighted_mean"))


def wide(df: DataFrame, x: str, group: str, value: str, names: Sequence[str] | None = None) -> DataFrame:
    """One column for each group."""
    return df.groupBy(x).pivot(group, list(names) if names else None).agg(F.first(value))


__all__ = ["UnitMetric", "agg_metrics", "category_distribution", "collapse_dims", "describe", "distinct_per_entity", "freq", "impacted_units", "segments", "time_metrics", "to_long", "unit_metrics"]
