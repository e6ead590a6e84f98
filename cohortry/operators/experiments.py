"""Concurrent experiments: merged assignments, trigger states, variant statistics, effects and site-wide impact.

All per-unit work is declarative and stays distributed; what reaches the driver is one row per variant (or per variant and
jackknife bucket), whose number the experiments' arms bound.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.inference import Arm, Effect, two_sample
from ..specs import NOT_TRIGGERED, ComparisonPair, Experiment, Launch, Metric, MetricSource, UnitMetric
from .metrics import unit_metrics
from .relational import match, union

SEP = "|"


def assignments(experiment: Experiment, condition: str | None = None) -> DataFrame:
    """(unit, variant) of an experiment, a unit once: the first variant by name where it has several."""
    df = experiment.assignment.where(condition) if condition else experiment.assignment
    return df.groupBy(F.col(experiment.unit).alias("unit")).agg(F.min(F.col(experiment.variant).cast("string")).alias("variant"))


def merge_numbered(frames: Sequence[DataFrame], on: Sequence[str], common: Sequence[str], how: str = "full", missing: str = NOT_TRIGGERED, add_tuple: bool = True) -> DataFrame:
    """The frames joined on shared keys; each common column c becomes c_1, ..., c_k with missing ones filled, and the array c.

    Keys are shared by all frames, so a unit of the first and third alone is one row. Joins on one key reuse its partitioning.
    """
    parts = [f.select(*on, *[F.col(c).alias(f"{c}_{i}") for c in common]) for i, f in enumerate(frames, 1)]
    out = reduce(lambda a, b: a.join(b, list(on), how), parts)
    filled = [F.coalesce(F.col(f"{c}_{i}").cast("string"), F.lit(missing)).alias(f"{c}_{i}") for i in range(1, len(frames) + 1) for c in common]
    out = out.select(*on, *filled)
    if add_tuple:
        for c in common:
            out = out.withColumn(c, F.array(*[f"{c}_{i}" for i in range(1, len(frames) + 1)]))
    return out


def merge_experiments(experiments: Sequence[Experiment], condition: str | None = None) -> DataFrame:
    """unit, variant_1, ..., variant_k, variant (array)."""
    return merge_numbered([assignments(e, condition) for e in experiments], ["unit"], ["variant"])


def trigger_state(variant: Column) -> Column:
    return F.transform(variant, lambda v: v != NOT_TRIGGERED)


def shown(array: Column) -> Column:
    return F.array_join(F.transform(array, lambda x: x.cast("string")), SEP)


def with_metrics(merged: DataFrame, metrics: DataFrame, unit_metrics: Sequence[UnitMetric] = (), key: str = "unit") -> DataFrame:
    """Every assigned unit with its metrics; missing ones stay null unless the metric says what to fill in."""
    out = merged.join(metrics.withColumnRenamed(key, "unit"), "unit", "left")
    fill = {m.alias: m.fill_na for m in unit_metrics if m.fill_na is not None}
    return out.fillna(fill) if fill else out


def variant_counts(merged: DataFrame) -> DataFrame:
    return merged.groupBy("variant").agg(F.count("*").alias("variant_count"))


def trigger_stats(counts: DataFrame) -> DataFrame:
    """variant_counts with percentages, trigger states and how much of its state each variant is."""
    state = W.partitionBy("trigger_state")
    out = counts.withColumn("variant_percent", 100.0 * F.col("variant_count") / F.sum("variant_count").over(W.partitionBy()))
    out = out.withColumn("trigger_state", trigger_state(F.col("variant")))
    out = out.withColumn("trigger_state_overall", F.exists("trigger_state", lambda x: x))
    out = out.withColumn("trigger_state_count", F.sum("variant_count").over(state))
    out = out.withColumn("trigger_state_percent", 100.0 * F.col("trigger_state_count") / F.sum("variant_count").over(W.partitionBy()))
    return out.withColumn("variant_over_triggered_pcnt", 100.0 * F.col("variant_count") / F.col("trigger_state_count"))


def overlap_rates(counts: DataFrame) -> DataFrame:
    """For each experiment (from 1): its triggered units, and the percentage of them that other experiments triggered as well."""
    each = counts.select("variant_count", F.posexplode(trigger_state(F.col("variant"))).alias("i", "on"), trigger_state(F.col("variant")).alias("state")).where("on")
    alone = F.size(F.filter("state", lambda x: x)) == 1
    out = each.groupBy((F.col("i") + 1).alias("experiment")).agg(F.sum("variant_count").alias("triggered"), F.sum(F.when(alone, F.col("variant_count")).otherwise(0)).alias("alone"))
    return out.select("experiment", "triggered", (100.0 * (F.col("triggered") - F.col("alone")) / F.col("triggered")).alias("overlap_percent"))


def variant_stats(joined: DataFrame, columns: Sequence[str], by: Sequence[str] = ("variant",)) -> DataFrame:
    """For each variant and metric column: units, sum, sum of squares, mean over all units and population sd.

    Units without a value count as units, not as values: the mean is the sum over all units.
    """
    aggs = [F.count("*").alias("sample_count")]
    for c in columns:
        x = F.col(c).cast("double")
        aggs += [F.sum(x).alias(f"{c}_sum"), F.sum(x * x).alias(f"{c}_sum_sq")]
    wide = joined.groupBy(*by).agg(*aggs)
    each = [F.struct(F.lit(c).alias("metric"), F.coalesce(F.col(f"{c}_sum"), F.lit(0.0)).alias("sum"), F.coalesce(F.col(f"{c}_sum_sq"), F.lit(0.0)).alias("sum_sq")) for c in columns]
    out = wide.select(*by, "sample_count", F.explode(F.array(*each)).alias("m")).select(*by, "m.metric", "sample_count", "m.sum", "m.sum_sq")
    out = out.withColumn("mean", F.col("sum") / F.col("sample_count"))
    return out.withColumn("sd", F.sqrt(F.greatest(F.col("sum_sq") / F.col("sample_count") - F.col("mean") * F.col("mean"), F.lit(0.0))))


def pair_relation(spark, pairs: Sequence[ComparisonPair]) -> DataFrame:
    """pair, side, variant: one row for each variant of each side."""
    rows = [(p.name, side, list(v)) for p in pairs for side in ("treatment", "control") for v in getattr(p, side)]
    return spark.createDataFrame(rows, "pair string, side string, variant array<string>")


def with_state_counts(stats: DataFrame) -> DataFrame:
    """stats (of `variant_stats`) with trigger_state_count, the units of each variant's trigger state; no second pass over units."""
    return stats.withColumn("trigger_state_count", F.sum("sample_count").over(W.partitionBy("metric", trigger_state(F.col("variant")))))


def arm_stats(stats: DataFrame, pairs: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """pair, side, metric: units, mean, variance of the mean.

    Pooled over the side's variants; or, given trigger-state counts (as a frame, or in stats by `with_state_counts`), the mean weighted
    by each variant's state among those that exist, with variance sum of w^2 sd^2 / n.
    """
    both = stats.join(F.broadcast(pairs), "variant")
    keys = ("pair", "side", "metric")
    if counts is None and "trigger_state_count" not in stats.columns:
        pooled = both.groupBy(*keys).agg(F.sum("sample_count").alias("n"), F.sum("sum").alias("sum"), F.sum("sum_sq").alias("sum_sq"))
        mean = F.col("sum") / F.col("n")
        var = F.greatest(F.col("sum_sq") / F.col("n") - mean * mean, F.lit(0.0)) / F.col("n")
        return pooled.select(*keys, "n", mean.alias("mean"), var.alias("var"))
    weighted = both if counts is None else both.join(counts.select("variant", "trigger_state_count"), "variant")
    w = F.col("trigger_state_count") / F.sum("trigger_state_count").over(W.partitionBy(*keys))
    weighted = weighted.withColumn("w", w)
    return weighted.groupBy(*keys).agg(F.sum("sample_count").alias("n"), F.sum(F.col("w") * F.col("mean")).alias("mean"), F.sum(F.col("w") * F.col("w") * F.col("sd") * F.col("sd") / F.col("sample_count")).alias("var"))


def effects(arms: DataFrame, triggered: dict[tuple[str, str], float] | None = None, coverage: float = 0.95, law: str = "t") -> list[tuple[str, str, Effect]]:
    """(pair, metric, effect) of each pair; arms has one row for each pair, side and metric."""
    sides: dict = {}
    for r in arms.collect():
        sides[r["pair"], r["metric"], r["side"]] = Arm(r["mean"], r["var"], r["n"], (triggered or {}).get((r["pair"], r["side"])))
    names = sorted({(p, m) for p, m, _ in sides})
    return [(p, m, two_sample(sides[p, m, "treatment"], sides[p, m, "control"], coverage, law)) for p, m in names if (p, m, "treatment") in sides and (p, m, "control") in sides]


def triggered_population(counts: DataFrame, pairs: DataFrame) -> dict[tuple[str, str], float]:
    """Units in the trigger states of each pair's sides."""
    states = counts.join(F.broadcast(pairs), "variant").select("pair", "side", "trigger_state", "trigger_state_count").distinct()
    return {(r["pair"], r["side"]): r["n"] for r in states.groupBy("pair", "side").agg(F.sum("trigger_state_count").alias("n")).collect()}


def effect_frame(spark, found: Sequence[tuple[str, str, Effect]]) -> DataFrame:
    rows = [(p, m, e.delta, e.ci[0], e.ci[1], e.p_value, e.percent, float(e.dof), e.delta_sum, e.sample_counts[0], e.sample_counts[1]) for p, m, e in found]
    rows = [tuple(None if isinstance(x, float) and math.isnan(x) else x for x in r) for r in rows]
    return spark.createDataFrame(rows, "pair string, metric string, delta double, ci_lower double, ci_upper double, p_value double, percent double, dof double, delta_sum double, control_count long, treatment_count long")


def run_mea(experiments: Sequence[Experiment], metrics: DataFrame, columns: Sequence[str], launches: Sequence[Launch], key: str = "unit", control: Launch | None = None, weighted: bool = True, coverage: float = 0.95) -> DataFrame:
    """The launches' effects on all metric columns at once: one pass over units, one row of statistics for each variant."""
    merged = merge_experiments(experiments)
    joined = with_metrics(merged, metrics, key=key)
    spark = joined.sparkSession
    pairs = pair_relation(spark, [x.against(control) for x in launches])
    stats = variant_stats(joined, columns).persist()
    counts = trigger_stats(stats.groupBy("variant").agg(F.max("sample_count").alias("variant_count")))
    arms = arm_stats(stats, pairs, counts if weighted else None)
    out = effect_frame(spark, effects(arms, triggered_population(counts, pairs), coverage))
    stats.unpersist()
    return out


def against_control(stats: DataFrame, control: Sequence[str], counts: DataFrame | None = None, coverage: float = 0.95) -> DataFrame:
    """The effect of every variant with an arm of each experiment against one control variant, for each metric of `variant_stats`."""
    control, stats = tuple(control), stats.persist()  # a few rows, read twice
    variants = sorted({tuple(r[0]) for r in stats.select("variant").distinct().collect()})
    pairs = [ComparisonPair((v,), (control,), SEP.join(v)) for v in variants if v != control and NOT_TRIGGERED not in v]
    spark = stats.sparkSession
    relation = pair_relation(spark, pairs)
    out = effect_frame(spark, effects(arm_stats(stats, relation, counts), triggered_population(counts, relation) if counts is not None else None, coverage))
    stats.unpersist()
    return out


@dataclass(frozen=True)
class Analysis:
    """The statistics of variants, and the effects of launches, of all metrics of all families."""

    variant_stats: DataFrame
    effects: DataFrame

    def significant(self, level: float = 0.10) -> DataFrame:
        return self.effects.where(F.col("p_value") < level)

    def combined(self, other: Analysis) -> Analysis:
        return Analysis(self.variant_stats.unionByName(other.variant_stats), self.effects.unionByName(other.effects))


def run_families(experiments: Sequence[Experiment], families: Sequence[tuple[DataFrame, MetricSource]], launches: Sequence[Launch], control: Launch | None = None, buckets: int = 30, weighted: bool = True, coverage: float = 0.95) -> Analysis:
    """Launches' effects on the metrics of several families, each a relation with its unit metrics and metrics.

    A plain metric is tested by its variants' means and variances, a ratio of two by the grouped jackknife over `buckets` slices of units.
    Each family is summed up by unit and joined with the assignments once. The effects say which method they are by.
    """
    merged = settled(merge_experiments(experiments))  # joined once, whatever the number of families
    spark = merged.sparkSession
    pairs = [x.against(control) for x in launches]
    relation, counts = pair_relation(spark, pairs), trigger_stats(variant_counts(merged)).persist()
    population = triggered_population(counts, relation)
    stats, found = [], []
    for df, source in families:
        joined = with_metrics(merged, unit_metrics(df, source, dims=()), source.unit_metrics, source.unit)
        plain = [m for m in source.metrics if m.denominator is None]
        if plain:
            named = joined.select("unit", "variant", *[F.col(m.numerator).alias(m.alias) for m in plain])
            own = variant_stats(named, [m.alias for m in plain]).withColumn("metric_family", F.lit(source.name)).persist()
            stats.append(own)
            one = effect_frame(spark, effects(arm_stats(own.drop("metric_family"), relation, counts if weighted else None), population, coverage))
            found.append(one.select("pair", "metric", F.lit("simple").alias("method"), "delta", "percent", "ci_lower", "ci_upper", "p_value").withColumn("metric_family", F.lit(source.name)))
        ratios = [m for m in source.metrics if m.denominator is not None]
        sliced = bucketed(joined, ["unit"], buckets) if ratios else None
        for m in ratios:
            own = ratio_stats(sliced, m)
            stats.append(own.withColumn("metric_family", F.lit(source.name)))
            one = pair_effects(sliced, m, pairs, buckets, coverage, counts if weighted else None)
            found.append(one.select("pair", F.lit(m.alias).alias("metric"), F.lit("jackknife").alias("method"), "delta", "percent", "ci_lower", "ci_upper", "p_value").withColumn("metric_family", F.lit(source.name)))
    counts.unpersist()  # the statistics that are returned stay kept until their caller lets go of them
    return Analysis(union(stats), union(found))


def ratio_stats(df: DataFrame, metric: Metric) -> DataFrame:
    """variant, metric, sample_count, sum (of the numerator), mean (the ratio) of each variant."""
    sums, ratio = ratio_sums(metric)
    out = df.groupBy("variant").agg(F.count("*").alias("sample_count"), *[c.alias(k) for k, c in sums.items()])
    return out.select("variant", F.lit(metric.alias).alias("metric"), "sample_count", F.col("sx").alias("sum"), ratio.alias("mean"))


# grouped jackknife


def settled(df: DataFrame) -> DataFrame:
    """df made once, so that every use sees the same rows in the same places: a checkpoint where the cluster names a folder for them."""
    sc = df.sparkSession.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named and not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return df.checkpoint() if sc.getCheckpointDir() else df.persist()


def bucketed(df: DataFrame, order: Sequence[str], buckets: int) -> DataFrame:
    """df with jk_bucket: contiguous slices of ceil(n / buckets) rows in the given order, which has to be total.

    Rows are dealt by ranges of the order and sorted in each; a row's position is its range's start, from the ranges' counts, and its
    place there. So no task orders more than its range, whatever the number of rows, and nothing is counted on the driver.
    """
    at = settled(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = at.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    size = F.ceil(F.sum("_n").over(W.partitionBy()) / buckets)
    starts = counts.select("_part", before.alias("_start"), size.alias("_size"))
    out = at.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return out.withColumn("jk_bucket", F.floor((F.col("_start") + place) / F.col("_size")).cast("int")).drop("_at", "_part", "_start", "_size")


def jackknife(df: DataFrame, buckets: int, sums: dict[str, Column], estimate: Column, by: Sequence[str] = ()) -> DataFrame:
    """Grouped jackknife of an estimator that is an expression of sums: estimate, jk_estimate, jk_var for each group.

    One pass makes the sums of each bucket; leaving a bucket out is a subtraction. All buckets count as replicates, also those
    without rows. df has jk_bucket.
    """
    spark = df.sparkSession
    cells = df.groupBy(*by, "jk_bucket").agg(*[c.alias(k) for k, c in sums.items()])
    totals = cells.groupBy(*by).agg(*[F.sum(k).alias(f"_{k}") for k in sums])
    every = totals.crossJoin(F.broadcast(spark.range(buckets).select(F.col("id").cast("int").alias("jk_bucket"))))
    left = match(every, cells, [*by, "jk_bucket"], "left")
    out = left.select(*by, *[F.col(f"_{k}").alias(f"_{k}") for k in sums], *[(F.col(f"_{k}") - F.coalesce(F.col(k), F.lit(0))).alias(k) for k in sums]).withColumn("replicate", estimate)
    whole = totals.select(*by, *[F.col(f"_{k}").alias(k) for k in sums]).withColumn("estimate", estimate).select(*by, "estimate")
    spread = out.groupBy(*by).agg(F.avg("replicate").alias("m"), F.var_pop("replicate").alias("v"))
    joined = match(whole, spread, by)
    b = float(buckets)
    return joined.select(*by, "estimate", (F.col("estimate") - (b - 1) * (F.col("m") - F.col("estimate"))).alias("jk_estimate"), ((b - 1) * F.col("v")).alias("jk_var"))


def ratio_sums(metric: Metric) -> tuple[dict[str, Column], Column]:
    """Sums of a ratio metric's parts, missing values as 0, and the ratio of them."""
    x, y = F.coalesce(F.col(metric.numerator).cast("double"), F.lit(0.0)), F.coalesce(F.col(metric.denominator).cast("double"), F.lit(0.0))
    return {"sx": F.sum(x), "sy": F.sum(y)}, F.try_divide(F.col("sx"), F.col("sy"))


def pair_effects(df: DataFrame, metric: Metric, pairs: Sequence[ComparisonPair], buckets: int = 20, coverage: float = 0.95, weights: DataFrame | None = None) -> DataFrame:
    """Differences of a ratio (or mean) metric for each pair by grouped jackknife: pair, delta, percent, se, ci_lower, ci_upper, p_value.

    df has variant, jk_bucket and the metric's columns. Each side is the mean over its variants, weighted by the trigger-state
    counts of `weights` (variant, trigger_state_count) or by units; missing values count as 0. One pass sums up each variant and
    bucket; replicates are those sums less a bucket's, so the driver gets variants x buckets rows at most.
    """
    import numpy as np

    from ..functions.inference import student_ci

    x = F.coalesce(F.col(metric.numerator).cast("double"), F.lit(0.0))
    y = F.coalesce(F.col(metric.denominator).cast("double"), F.lit(0.0)) if metric.denominator else F.lit(1.0)
    cells = df.groupBy("variant", "jk_bucket").agg(F.sum(x).alias("x"), F.sum(y).alias("y"), F.count("*").alias("n")).collect()
    variants = sorted({tuple(r["variant"]) for r in cells})
    sums = {v: np.zeros((buckets, 3)) for v in variants}
    for r in cells:
        sums[tuple(r["variant"])][r["jk_bucket"]] = (r["x"], r["y"], r["n"])
    held = {tuple(r["variant"]): float(r["trigger_state_count"]) for r in weights.collect()} if weights is not None else {v: float(s[:, 2].sum()) for v, s in sums.items()}

    def side(names: Sequence[tuple[str, ...]], left_out: int | None) -> float:
        top = bottom = total = 0.0
        for v in names:
            if v in sums and v in held:
                s = sums[v].sum(0) - (sums[v][left_out] if left_out is not None else 0)
                n = s[2]
                total += held[v]
                if n > 0:
                    top += held[v] * s[0] / n
                    bottom += held[v] * s[1] / n
        if not total or not bottom:
            return float("nan")
        return top / bottom

    rows = []
    for p in pairs:
        estimate = lambda b: (side(p.treatment, b) - side(p.control, b), side(p.control, b))  # noqa: B023, E731
        whole, control = estimate(None)
        reps = np.array([estimate(b)[0] for b in range(buckets)])
        delta = whole - (buckets - 1) * (reps.mean() - whole)
        se = float(np.sqrt((buckets - 1) / buckets * ((reps - reps.mean()) ** 2).sum()))
        ci, p_value = student_ci(delta, se, buckets - 1, coverage)
        rows.append((p.name, float(delta), float(100 * delta / control) if control else None, se, *map(float, ci), float(p_value)))
    clean = [tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r) for r in rows]
    return df.sparkSession.createDataFrame(clean, "pair string, delta double, percent double, se double, ci_lower double, ci_upper double, p_value double")


def ratio_delta_method(df: DataFrame, numer: str, denom: str, by: Sequence[str] = ()) -> DataFrame:
    """The ratio of means with its variance by the delta method (sample variances)."""
    x, y = F.col(numer).cast("double"), F.col(denom).cast("double")
    aggs = df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_samp(x).alias("vx"), F.var_samp(y).alias("vy"), F.covar_samp(x, y).alias("cxy"))
    r = F.try_divide(F.col("mx"), F.col("my"))
    var = F.try_divide(F.col("vx") - 2 * F.col("ratio") * F.col("cxy") + F.col("ratio") * F.col("ratio") * F.col("vy"), F.col("n") * F.col("my") * F.col("my"))
    return aggs.withColumn("ratio", r).withColumn("var", var).select(*by, "n", "ratio", "var")


# site-wide impact


def swi_simple(effects: DataFrame) -> DataFrame:
    """Adds swi_percent: the effect on all units, impacted or not, as a share of what all would be without it.

    effects has delta, impacted_count, control_mean (of impacted units) and complement_total.
    """
    base = F.col("control_mean") * F.col("impacted_count") + F.col("complement_total")
    return effects.withColumn("swi_delta", F.col("delta") * F.col("impacted_count")).withColumn("swi_percent", 100.0 * F.try_divide(F.col("delta") * F.col("impacted_count"), base))


def swi_ratio(effects: DataFrame) -> DataFrame:
    """The same for a ratio: delta_numer and delta_denom, control and complement totals of both parts."""
    n = F.col("impacted_count")
    before = F.try_divide(F.col("control_numer") * n + F.col("complement_numer"), F.col("control_denom") * n + F.col("complement_denom"))
    after = F.try_divide((F.col("control_numer") + F.col("delta_numer")) * n + F.col("complement_numer"), (F.col("control_denom") + F.col("delta_denom")) * n + F.col("complement_denom"))
    return effects.withColumn("swi_before", before).withColumn("swi_after", after).withColumn("swi_percent", 100.0 * F.try_divide(F.col("swi_after") - F.col("swi_before"), F.col("swi_before")))


# contingency


def contingency(counts: DataFrame, dims: Sequence[str], count: str = "variant_count") -> DataFrame:
    """Observed and expected count of each cell under mutual independence, and its part of chi-squared."""
    cells = counts.groupBy(*dims).agg(F.sum(count).alias("observed"))
    values = [counts.select(d).distinct() for d in dims]
    grid = reduce(lambda a, b: a.crossJoin(b), values)
    cells = grid.join(cells, list(dims), "left").fillna({"observed": 0})
    total = F.sum("observed").over(W.partitionBy())
    expected = reduce(lambda a, b: a * b, (F.sum("observed").over(W.partitionBy(d)).cast("double") for d in dims)) / F.pow(total.cast("double"), F.lit(len(dims) - 1))
    cells = cells.withColumn("expected", expected)
    return cells.withColumn("chi2", F.try_divide(F.pow(F.col("observed") - F.col("expected"), F.lit(2)), F.col("expected")))
