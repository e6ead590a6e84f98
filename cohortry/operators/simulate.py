"""Simulated populations, assignments and metrics, made by hashing ids: any size, the same every time, without a driver's rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..specs import NOT_TRIGGERED


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) from a key."""
    return (F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))).cast("double")


def normal(key: Column, seed: int) -> Column:
    """A standard normal number from a key (Box and Muller)."""
    import math

    return F.sqrt(-2 * F.log(1 - uniform(key, seed))) * F.cos(2 * math.pi * uniform(key, seed + 1))


def pick(u: Column, arms: Sequence[tuple[str, float]]) -> Column:
    out, total = None, 0.0
    for name, p in arms:
        total += p
        out = F.when(u < total, name) if out is None else out.when(u < total, name)
    return out.otherwise(arms[-1][0])


def population(spark: SparkSession, n: int, seed: int = 42, attributes: dict[str, Sequence[tuple[str, float]]] | None = None) -> DataFrame:
    out = spark.range(n).withColumnRenamed("id", "unit")
    for i, (name, values) in enumerate((attributes or {}).items()):
        out = out.withColumn(name, pick(uniform(F.col("unit"), seed + 10 * i), values))
    return out


def assign(units: DataFrame, arms: Sequence[tuple[str, float]], seed: int, not_triggered: float = 0.0) -> DataFrame:
    """(unit, variant) of the units that trigger."""
    some = units.where(uniform(F.col("unit"), seed + 1) >= not_triggered)
    return some.select("unit", pick(uniform(F.col("unit"), seed), arms).alias("variant"))


def respond(merged: DataFrame, base: float, sd: float, lifts: dict[tuple[int, str], float], interactions: dict[tuple[str, ...], float] | None = None, seed: int = 7, name: str = "metric") -> DataFrame:
    """A metric for merged assignments: base, noise, a lift for each (experiment, arm) held, and one for whole variants."""
    parts = [F.when(F.col(f"variant_{i}") == arm, lift).otherwise(0.0) for (i, arm), lift in lifts.items()]
    for variant, lift in (interactions or {}).items():
        hit = reduce(lambda a, b: a & b, (F.col(f"variant_{i}") == v for i, v in enumerate(variant, 1) if v != NOT_TRIGGERED))
        parts.append(F.when(hit, lift).otherwise(0.0))
    return merged.withColumn(name, F.lit(base) + sd * normal(F.col("unit"), seed) + sum(parts, F.lit(0.0)))


def random_dates(df: DataFrame, start: str, days: int, key: str = "unit", seed: int = 5, name: str = "date") -> DataFrame:
    """df with a date within so many days of the start, always the same for a key."""
    return df.withColumn(name, F.date_add(F.lit(start).cast("date"), F.floor(uniform(F.col(key), seed) * days).cast("int")))


def click_through(spark: SparkSession, n: int, seed: int = 1317) -> tuple[DataFrame, float]:
    """(units with variant_1, variant_2, impressions, clicks; the true difference of rates of (enabled, v1) and (control, control))."""
    units = population(spark, n, seed)
    from .experiments import merge_numbered

    arms = [[("control", 0.5), ("enabled", 0.5)], [("control", 0.5), ("v1", 0.5)]]
    merged = merge_numbered([assign(units, a, seed + i, 0.1) for i, a in enumerate(arms)], ["unit"], ["variant"])
    rate = F.lit(0.10) + F.when(F.col("variant_1") == "enabled", 0.02).otherwise(0.0) + F.when(F.col("variant_2") == "v1", 0.01).otherwise(0.0)
    rate = rate + F.when((F.col("variant_1") == "enabled") & (F.col("variant_2") == "v1"), 0.01).otherwise(0.0)
    out = merged.withColumn("impressions", (5 + F.floor(uniform(F.col("unit"), seed + 50) * 10)).cast("double"))
    return out.withColumn("clicks", F.round(F.col("impressions") * rate + 0.3 * normal(F.col("unit"), seed + 60), 3)), 0.04
