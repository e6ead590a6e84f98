"""Scans, filters, joins, set operations and upserts on DataFrames."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _all(conditions: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.expr(c) for c in conditions), F.lit(True))


def in_dates(df: DataFrame, col: str, start: str | None, end: str | None) -> DataFrame:
    """Rows with start <= col <= end; a bound that is None is open. Partition strings that carry an hour compare as text."""
    if start is not None:
        df = df.where(F.col(col) >= F.lit(start))
    if end is not None:
        df = df.where(F.col(col) <= F.lit(end))
    return df


def scan(df: DataFrame, columns: Sequence[str] = (), aggregations: Sequence[Column] = (), conditions: Sequence[str] = ()) -> DataFrame:
    """Filter, then project or group: grouped only if there are both columns and aggregations."""
    df = df.where(_all(conditions)) if conditions else df
    if columns and aggregations:
        return df.groupBy(*columns).agg(*aggregations)
    if aggregations:
        return df.agg(*aggregations)
    return df.select(*columns) if columns else df


def sample_units(df: DataFrame, unit: str, residues: Sequence[int] | None = None, percent: int | None = None) -> DataFrame:
    """Units whose id modulo 100 is among the residues, or among the first `percent`; all if neither is given.

    The same units come out every time, in every table: unlike a random sample.
    """
    if residues is None and percent is None:
        return df
    return df.where(F.pmod(F.col(unit), F.lit(100)).isin(list(residues if residues is not None else range(percent))))


def require(df: DataFrame, columns: Sequence[str], what: str = "frame") -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks columns {missing}")
    return df


def join(
    left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]] = (), how: str = "inner",
    left_columns: Sequence[str] | None = None, right_columns: Sequence[str] | None = None, left_conditions: Sequence[str] = (), right_conditions: Sequence[str] = (),
) -> DataFrame:
    """An equi-join of prefiltered sides. Columns are "name" or "name as alias"; a cross join takes no keys, all others some.

    Filters are put below the join, so they reach the scans whatever the kind of join.
    """
    if (how == "cross") == bool(on):
        raise ValueError("a cross join has no keys; other joins need some")
    l, r = left.where(_all(left_conditions)).alias("l"), right.where(_all(right_conditions)).alias("r")  # noqa: E741

    def chosen(df: DataFrame, side: str, columns: Sequence[str] | None, but: set[str]) -> list[Column]:
        out = []
        for c in columns if columns is not None else [c for c in df.columns if c not in but]:
            name, _, alias = c.partition(" as ")
            out.append(F.col(f"{side}.{name.strip()}").alias(alias.strip() or name.strip()))
        return out

    joined = l.crossJoin(r) if how == "cross" else l.join(r, reduce(lambda a, b: a & b, (F.col(f"l.{a}") == F.col(f"r.{b}") for a, b in on)), how)
    if how in ("left_semi", "left_anti"):
        return joined.select(*chosen(left, "l", left_columns, set()))
    return joined.select(*chosen(left, "l", left_columns, set()), *chosen(right, "r", right_columns, set(left.columns)))


def match(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """A join on keys of the same names in which null is a value like others; without keys, all rows with the one row of right."""
    if not keys:
        return left.crossJoin(F.broadcast(right))
    named = right.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    out = left.join(named, reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys)), how)
    return out.drop(*[f"_key_{k}" for k in keys])


def semi(df: DataFrame, units: DataFrame, unit: str, key: str | None = None) -> DataFrame:
    """Rows of the given units."""
    return df.join(units.select(F.col(key or unit).alias(unit)), unit, "left_semi")


def anti(df: DataFrame, units: DataFrame, unit: str, key: str | None = None) -> DataFrame:
    """Rows of other units; a null unit is neither in nor out of a set, so its rows go."""
    return df.where(F.col(unit).isNotNull()).join(units.select(F.col(key or unit).alias(unit)), unit, "left_anti")


def upsert(target: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """target with the rows of new in place of those that share their key."""
    return target.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new.select(*target.columns))


def union(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows, by column name; columns that a frame lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def compare(a: DataFrame, b: DataFrame, keys: Sequence[str], columns: Sequence[str], relative: bool = False, labels: tuple[str, str] = ("a", "b")) -> DataFrame:
    """Both frames' columns side by side on their keys, with the difference of each."""
    x = a.select(*keys, *[F.col(c).alias(f"{c}_{labels[0]}") for c in columns])
    y = b.select(*keys, *[F.col(c).alias(f"{c}_{labels[1]}") for c in columns])
    out = x.join(y, list(keys), "full")
    for c in columns:
        one, other = F.col(f"{c}_{labels[0]}"), F.col(f"{c}_{labels[1]}")
        out = out.withColumn(f"{c}_diff", F.try_divide(other - one, one) if relative else other - one)
    return out


def rounded(df: DataFrame, digits: int = 6, columns: Sequence[str] | None = None) -> DataFrame:
    """Doubles, and arrays of them, to so many digits."""
    out = df
    for name, kind in df.dtypes:
        if columns is not None and name not in columns:
            continue
        if kind in ("double", "float"):
            out = out.withColumn(name, F.round(name, digits))
        elif kind in ("array<double>", "array<float>"):
            out = out.withColumn(name, F.transform(name, lambda x: F.round(x, digits)))
    return out


def drop_constant(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """df without those columns that hold one value or none."""
    counts = df.agg(*[F.count_distinct(c).alias(c) for c in columns]).first()
    return df.drop(*[c for c in columns if counts[c] <= 1])


def side_by_side(frames: Sequence[DataFrame], on: Sequence[str], differing: Sequence[str], common: Sequence[str] = ()) -> DataFrame:
    """Frames joined on shared keys: columns that differ come as <name>0, <name>1, ..., common ones from the first frame."""
    parts = [f.select(*on, *(common if i == 0 else ()), *[F.col(c).alias(f"{c}{i}") for c in differing]) for i, f in enumerate(frames)]
    return reduce(lambda a, b: match(a, b, on), parts)


def chained(df: DataFrame, joins: Sequence[dict]) -> DataFrame:
    """df joined with one relation after the other; each of joins has the arguments of `join` but the left side."""
    return reduce(lambda a, j: join(a, **j), joins, df)


def sample(df: DataFrame, n: int = 10) -> DataFrame:
    """Some n rows, for a look at them; 0 for the schema alone."""
    return df.limit(n)
