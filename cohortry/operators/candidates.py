"""Choosing among candidates in one plan: candidates as a relation, backtests from joins or from sums of products, beam search with a log."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import gram
from .gram import Gram
from .relational import match
from .selection import Candidate, candidate_id, grid


def relation(spark: SparkSession, candidates: Sequence[Candidate], schema: str) -> DataFrame:
    """candidate_id and the parameters of each candidate as columns (schema: their names and kinds)."""
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame([(candidate_id(c), *(c.get(n) for n in names)) for c in candidates], f"candidate_id string, {schema}")


def seasonal_backtest(df: DataFrame, time_col: str, value: str, candidates: DataFrame, cutoffs: Sequence[int], horizon: int, step_seconds: int = 86_400, dims: Sequence[str] = (), look_back: int = 12) -> DataFrame:
    """dims, candidate_id, cutoff, horizon_step, forecast, actual: seasonal means of all candidates (columns period and k, in steps) after
    each cutoff (a number of steps from the series' start), as one plan whatever the number of candidates.

    A forecast is the mean of the last k values at whole periods before its step, up to the cutoff; look_back bounds how many periods
    are looked through. Steps are counted on the clock, so gaps are gaps. Candidates, cutoffs and steps are few and broadcast.
    """
    spark = df.sparkSession
    rows = df.select(*dims, F.unix_seconds(F.col(time_col).cast("timestamp")).alias("_s"), F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL")
    starts = rows.groupBy(*dims).agg(F.min("_s").alias("_start"), F.max("_s").alias("_end"))
    placed = match(rows, starts, list(dims)).select(*dims, F.floor((F.col("_s") - F.col("_start")) / step_seconds).alias("_i"), "_v")
    wanted = spark.createDataFrame([(int(c), h) for c in cutoffs for h in range(1, horizon + 1)], "cutoff int, horizon_step int").crossJoin(F.broadcast(candidates.select("candidate_id", "period", "k")))
    back = F.sequence(F.lit(1), F.least(F.lit(look_back), F.floor((F.col("cutoff") + F.col("horizon_step")) / F.col("period")).cast("int")))
    wanted = wanted.withColumn("_j", F.explode(F.when(F.element_at(back, -1) >= 1, back))).withColumn("_i", F.col("cutoff") + F.col("horizon_step") - F.col("_j") * F.col("period")).where("_i BETWEEN 0 AND cutoff")
    seen = placed.join(F.broadcast(wanted), "_i")
    ranked = seen.withColumn("_r", F.row_number().over(W.partitionBy(*dims, "candidate_id", "cutoff", "horizon_step").orderBy(F.desc("_i")))).where("_r <= k")
    made = ranked.groupBy(*dims, "candidate_id", "cutoff", "horizon_step").agg(F.avg("_v").alias("forecast")).withColumn("_i", F.col("cutoff") + F.col("horizon_step"))
    return match(made, placed.select(*dims, "_i", F.col("_v").alias("actual")), [*dims, "_i"], "left").drop("_i")


def scores(backtest: DataFrame, candidates: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, candidate_id, n, mae, rmse, rank of each candidate over its backtest (least mae first, ties by id; null last)."""
    e = F.col("actual") - F.col("forecast")
    found = backtest.groupBy(*by, "candidate_id").agg(F.count(e).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))
    every = candidates.select("candidate_id")
    if by:
        every = every.crossJoin(backtest.select(*by).distinct())
    out = match(every, found, [*by, "candidate_id"], "left").fillna({"n": 0})
    return out.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.col("mae").asc_nulls_last(), "candidate_id")))


PIPELINE = "alpha double, cv_mse array<double>, backtest_mse double, backtest_alpha double, n double, coefficients array<double>"


def regression_pipeline(df: DataFrame, design: dict[str, Column], y: Column, segment: Column, alphas: Sequence[float], by: Sequence[str] = (), free: Sequence[int] = (0,), first: int = 1) -> DataFrame:
    """by, alpha, cv_mse (of each alpha), backtest_mse, backtest_alpha, n, coefficients: a rolling-origin search, a backtest and the final
    fit of each series from one reading of it.

    Segments (0, 1, ..) follow each other in time. An alpha's error is that of models of all segments before one, on that one, for
    every segment from `first` on, as mean over their rows. The backtest chooses an alpha without the last segment, fits all but the
    last, and is measured on it; the final model is of all. Series of fewer than first + 2 segments have no rows.
    """

    def choose(parts: list[Gram]) -> tuple[float, np.ndarray]:
        loss, n = np.zeros(len(alphas)), 0.0
        for k in range(first, len(parts)):
            train = sum(parts[1:k], parts[0])
            loss += [parts[k].loss(gram.ridge(train, float(a), free)) for a in alphas]
            n += parts[k].n
        return float(alphas[int(np.argmin(loss))]), loss / n

    def solve(parts: list[Gram]) -> dict | None:
        if len(parts) < first + 2:
            return None
        early, (best, errors) = choose(parts[:-1])[0], choose(parts)
        held = gram.ridge(sum(parts[1:-1], parts[0]), early, free)
        whole = sum(parts[1:], parts[0])
        return {"alpha": best, "cv_mse": errors, "backtest_mse": parts[-1].loss(held) / parts[-1].n, "backtest_alpha": early, "n": whole.n, "coefficients": gram.ridge(whole, best, free)}

    return gram.fitted(df, design, y, solve, PIPELINE, by, segment)


def beam_search(score: Callable[[list[Candidate]], DataFrame], groups: Sequence[dict[str, Sequence]], start: Candidate, beam: int = 1, reopen: dict[int, int] | None = None, log: DataFrame | None = None) -> tuple[Candidate, list[dict]]:
    """Searches groups of parameters one after the other, from the `beam` best so far; (winner, everything scored, best first).

    score makes one frame (candidate_id, score) for all candidates of a stage, so a stage is one job, of which only the scores (as many
    as candidates) come back. reopen says after which stage (by number) which earlier group is searched again. log (candidate_id, score)
    holds scores of earlier runs: what is in it isn't scored again. Candidates without a score come last, ties in the order of candidates.
    """
    known: dict[str, float | None] = {}
    seen: dict[str, Candidate] = {}
    order: list[int] = []
    for i in range(len(groups)):
        order.append(i)
        if reopen and i in reopen:
            order.append(reopen[i])
    ahead = [dict(start)]
    place = lambda c: (known[candidate_id(c)] is None, known[candidate_id(c)] or 0.0)
    for stage in order:
        made = {candidate_id(c): c for base in ahead for c in [base, *({**base, **more} for more in grid(groups[stage]))]}
        seen |= {k: c for k, c in made.items() if k not in seen}
        fresh = [k for k in made if k not in known]
        if fresh and log is not None:
            known |= {r["candidate_id"]: r["score"] for r in log.where(F.col("candidate_id").isin(fresh)).select("candidate_id", "score").collect()}
            fresh = [k for k in fresh if k not in known]
        if fresh:
            found = {r["candidate_id"]: r["score"] for r in score([made[k] for k in fresh]).select("candidate_id", "score").collect()}
            known |= {k: found.get(k) for k in fresh}
        ahead = sorted(made.values(), key=place)[:beam]
    every = sorted(seen.values(), key=place)
    return ahead[0], [{"candidate_id": candidate_id(c), "params": c, "score": known[candidate_id(c)]} for c in every]
