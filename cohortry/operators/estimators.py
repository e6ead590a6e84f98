"""Estimators that carry their leave-one-bucket-out values, so that any arithmetic of them has a joint jackknife covariance.

One aggregation makes the sums of each group and bucket; a group's sums and what is left of them without each bucket stand in one
row. An estimator is a column of (value, left): a vector, and the same vector without each bucket. Sums, differences, products,
quotients (of vectors of one length, a vector and a vector of one, or a number), inner products and products with a matrix are taken of both
alike, so the result is an estimator again. Where a divisor is 0 the value is null, and so are the moments that it enters.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dist

Binary = Callable[[Column, Column], Column]


@dataclass(frozen=True)
class Estimator:
    """A column of struct<value: array<double>, left: array<array<double>>>."""

    column: Column

    @staticmethod
    def of(name: str) -> Estimator:
        return Estimator(F.col(name))

    def _each(self, f: Callable[[Column], Column]) -> Estimator:
        """f of the vector itself and of the vector without each bucket."""
        return Estimator(F.struct(f(self.column["value"]).alias("value"), F.transform(self.column["left"], f).alias("left")))

    def _both(self, other: Estimator, f: Callable[[Column, Column], Column]) -> Estimator:
        a, b = self.column, other.column
        return Estimator(F.struct(f(a["value"], b["value"]).alias("value"), F.zip_with(a["left"], b["left"], f).alias("left")))

    def _with(self, other: Estimator | float, f: Binary) -> Estimator:
        if not isinstance(other, Estimator):
            return self._each(lambda v: F.transform(v, lambda x: f(x, F.lit(float(other)))))

        def pairs(x: Column, y: Column) -> Column:
            one_x, one_y = F.size(x) == 1, F.size(y) == 1
            return F.when(one_y, F.transform(x, lambda a: f(a, y[0]))).when(one_x, F.transform(y, lambda b: f(x[0], b))).otherwise(F.zip_with(x, y, f))

        return self._both(other, pairs)

    def __add__(self, other: Estimator | float) -> Estimator:
        return self._with(other, lambda a, b: a + b)

    def __sub__(self, other: Estimator | float) -> Estimator:
        return self._with(other, lambda a, b: a - b)

    def __mul__(self, other: Estimator | float) -> Estimator:
        return self._with(other, lambda a, b: a * b)

    def __truediv__(self, other: Estimator | float) -> Estimator:
        if not isinstance(other, Estimator) and other == 0:
            raise ZeroDivisionError("an estimator can't be divided by the number 0")
        return self._with(other, F.try_divide)

    __radd__, __rmul__ = __add__, __mul__

    def __rsub__(self, other: float) -> Estimator:
        return self._with(other, lambda a, b: b - a)

    def __rtruediv__(self, other: float) -> Estimator:
        return self._with(other, lambda a, b: F.try_divide(b, a))

    def __matmul__(self, other: Estimator | Sequence[float] | Sequence[Sequence[float]]) -> Estimator:
        """The inner product with an estimator or numbers (one value), or with each column of a matrix given by rows."""
        if isinstance(other, Estimator):
            return self._both(other, lambda x, y: F.array(_dot(x, y)))
        rows = [list(r) if isinstance(r, Sequence) else [r] for r in other]
        columns = [F.array(*[F.lit(float(r[k])) for r in rows]) for k in range(len(rows[0]))]
        return self._each(lambda v: F.array(*[_dot(v, c) for c in columns]))

    __rmatmul__ = __matmul__

    def __getitem__(self, k: int) -> Estimator:
        return self._each(lambda v: F.array(v[k]))


def _dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, p: s + p)


def stacked(*estimators: Estimator) -> Estimator:
    """One vector of all their values."""
    first, *rest = estimators
    for e in rest:
        first = first._both(e, lambda x, y: F.concat(x, y))
    return first


def weighted(strata: dict[str, Estimator], counts: dict[str, float], standardize: bool = True) -> Estimator:
    """The mean over strata by their counts: a stratum without a count weighs nothing, one without a value counts as 0.

    Weights are shares of the given strata's counts, so they add up to 1 whichever strata there are; or the counts themselves.
    """
    total = sum(counts.get(k, 0.0) for k in strata)
    some = [e._each(lambda v: F.transform(v, lambda x: F.coalesce(x, F.lit(0.0)))) * (counts.get(k, 0.0) / (total or 1.0) if standardize else counts.get(k, 0.0)) for k, e in strata.items()]
    out = some[0]
    for e in some[1:]:
        out = out + e
    return out


def strata_sums(value: Column, stratum: Column, values: Sequence[str], name: str) -> dict[str, Column]:
    """The sum of value over each stratum's rows, missing ones as 0, named `name_stratum`; for `replicated`."""
    return {f"{name}_{v}": F.sum(F.when(stratum == v, F.coalesce(value.cast("double"), F.lit(0.0))).otherwise(0.0)) for v in values}


def replicated(df: DataFrame, sums: dict[str, Column], buckets: int, by: Sequence[str] = ()) -> DataFrame:
    """A row for each group with an estimator of one value for each sum. df has jk_bucket (see `experiments.bucketed`).

    A group's row holds `buckets` values for each sum, however many rows it has. Buckets without rows count as replicates.
    """
    if buckets < 2:
        raise ValueError("a jackknife takes two buckets at least")
    cells = df.groupBy(*by, "jk_bucket").agg(*[F.coalesce(c.cast("double"), F.lit(0.0)).alias(k) for k, c in sums.items()])
    whole = cells.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("jk_bucket", F.struct(*sums)))).alias("_cells"), *[F.sum(k).alias(k) for k in sums])
    every = F.sequence(F.lit(0), F.lit(buckets - 1))

    def leave(k: str) -> Column:
        return F.transform(every, lambda b: F.array(F.col(k) - F.coalesce(F.try_element_at(F.col("_cells"), b)[k], F.lit(0.0))))

    return whole.select(*by, *[F.struct(F.array(F.col(k)).alias("value"), leave(k).alias("left")).alias(k) for k in sums])


def _moments(e: Estimator) -> tuple[Column, Column]:
    """The bias-corrected vector, and the covariance by rows."""
    value, left = e.column["value"], e.column["left"]
    n, at = F.size(left), F.sequence(F.lit(0), F.size(value) - 1)
    # a sum over all buckets is null if one of them has no value
    total = lambda f: F.aggregate(left, F.lit(0.0), lambda s, v: s + f(v))
    mean = F.transform(at, lambda k: total(lambda v: v[k]) / n)
    corrected = F.transform(at, lambda k: value[k] - (n - 1) * (mean[k] - value[k]))
    return corrected, F.transform(at, lambda i: F.transform(at, lambda j: (n - 1) / n * total(lambda v: (v[i] - mean[i]) * (v[j] - mean[j]))))


def summary(df: DataFrame, e: Estimator, buckets: int, by: Sequence[str] = (), names: Sequence[str] | None = None, coverage: float = 0.95) -> DataFrame:
    """by, component, value, jk_value, se, ci_lower, ci_upper, p_value (two-sided, against 0) of each value of the vector, by Student's law
    with buckets - 1 degrees of freedom."""

    @F.pandas_udf("double")
    def p_of(t: pd.Series) -> pd.Series:
        return t.map(lambda x: None if pd.isna(x) else dist.t_two_sided(x, buckets - 1))

    corrected, cov = _moments(Estimator(F.col("_e")))
    full = df.select(*by, e.column.alias("_e")).select(*by, "_e", corrected.alias("_c"), cov.alias("_v"))
    rows = full.select(*by, F.posexplode(F.arrays_zip(F.col("_e")["value"].alias("value"), F.col("_c").alias("jk_value"), F.col("_v").alias("row"))).alias("_k", "x"))
    label = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("_k") + 1) if names else F.col("_k").cast("string")
    half = float(dist.t_ppf(0.5 + coverage / 2, buckets - 1)) * F.col("se")
    out = rows.select(*by, label.alias("component"), "x.value", "x.jk_value", F.sqrt(F.col("x.row")[F.col("_k")]).alias("se"))
    return out.select("*", (F.col("jk_value") - half).alias("ci_lower"), (F.col("jk_value") + half).alias("ci_upper"), p_of(F.try_divide("jk_value", "se")).alias("p_value"))


def covariance(df: DataFrame, e: Estimator, by: Sequence[str] = (), names: Sequence[str] | None = None) -> DataFrame:
    """by, a, b, covariance of each two values of the vector."""
    _, cov = _moments(Estimator(F.col("_e")))
    label = lambda k: F.element_at(F.array(*[F.lit(n) for n in names]), F.col(k) + 1) if names else F.col(k).cast("string")
    rows = df.select(*by, e.column.alias("_e")).select(*by, F.posexplode(cov).alias("_i", "_row")).select(*by, "_i", F.posexplode("_row").alias("_j", "covariance"))
    return rows.select(*by, label("_i").alias("a"), label("_j").alias("b"), "covariance")
