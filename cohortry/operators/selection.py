"""Choosing forecasters by backfilled error: grids of candidates, and stages that carry the winner on."""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .evaluation import evaluate

Candidate = dict[str, object]


def candidate_id(params: Candidate) -> str:
    """The same parameters have the same id, in any order."""
    return hashlib.sha256(json.dumps(params, sort_keys=True, default=str).encode()).hexdigest()[:16]


def grid(space: dict[str, Sequence]) -> list[Candidate]:
    return [dict(zip(space, values, strict=True)) for values in itertools.product(*space.values())]


def score(run: Callable[[Candidate], DataFrame], candidates: Sequence[Candidate], by: Sequence[str], metric: str = "mae", reduction: str = "mean", tie: Sequence[str] = ()) -> DataFrame:
    """candidate_id, params, score, rank: each candidate's backfill scored by group, reduced over groups, least first (null last).

    All candidates' predictions are one frame, so they are made and scored by one distributed query.
    """
    frames = [run(c).withColumn("candidate_id", F.lit(candidate_id(c))) for c in candidates]
    every = reduce(lambda a, b: a.unionByName(b), frames)
    scored = evaluate(every, ["candidate_id", *by], tie=tie)
    how = {"mean": F.avg, "median": F.median, "max": F.max, "min": F.min, "sum": F.sum}[reduction]
    params = every.sparkSession.createDataFrame([(candidate_id(c), json.dumps(c, sort_keys=True, default=str), i) for i, c in enumerate(candidates)], "candidate_id string, params string, seq int")
    out = scored.groupBy("candidate_id").agg(how(metric).alias("score"))
    return F.broadcast(params).join(out, "candidate_id", "left").orderBy(F.col("score").asc_nulls_last(), "seq").drop("seq")


def record(found: DataFrame, path: str, run_id: str) -> None:
    """Appends candidates' predictions or scores to a log under path, with the run that made them."""
    found.withColumn("run_id", F.lit(run_id)).write.mode("append").parquet(path)


def rescore(stored: DataFrame, by: Sequence[str], metric: str = "mae", reduction: str = "mean", tie: Sequence[str] = ()) -> DataFrame:
    """candidate_id, score: stored predictions (candidate_id, actual, forecast, by) ranked anew by other criteria."""
    how = {"mean": F.avg, "median": F.median, "max": F.max, "min": F.min, "sum": F.sum}[reduction]
    scored = evaluate(stored, ["candidate_id", *by], tie=tie)
    return scored.groupBy("candidate_id").agg(how(metric).alias("score")).orderBy(F.col("score").asc_nulls_last(), "candidate_id")


def stepwise(run: Callable[[Candidate], DataFrame], groups: Sequence[dict[str, Sequence]], start: Candidate, by: Sequence[str], **how) -> tuple[Candidate, list[DataFrame]]:
    """Searches one group of parameters after the other, each from the best so far; (winner, the scores of each stage)."""
    best, stages = dict(start), []
    for space in groups:
        found = score(run, [best | c for c in grid(space)], by, **how)
        stages.append(found)
        best = json.loads(found.first()["params"])
    return best, stages


def best_parameter(df: DataFrame, parameters: Sequence[float], objective: str, constraint: str, least: float, test: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """For detectors: of all parameters (rows met with each by a join), the one with the best objective among those whose constraint
    is met, or with the best constraint if none is. `test` scores a frame that has the column `parameter` by it."""
    spark = df.sparkSession
    every = df.crossJoin(F.broadcast(spark.createDataFrame([(float(p),) for p in parameters], "parameter double")))
    scores = test(every)
    ok = F.col(constraint) >= least
    return scores.orderBy(F.desc(ok), F.when(ok, F.col(objective)).desc_nulls_last(), F.col(constraint).desc(), "parameter").limit(1)
