"""Searches among candidates, each in one plan."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import candidates as C
from ..operators import relational as R
from ..operators import selection
from .linear import solved
from .registry import query
from .series import DAILY, daily

GRID = {"period": (7, 3), "k": (1, 2, 3)}
CUTOFFS, AHEAD = (13, 20), 5
_CELLS = [selection.candidate_id(c) for c in selection.grid(GRID)]
#: All candidates' backtests, and their scores.
TRIED = f"""{DAILY}, s AS (SELECT event_type, min(ts) AS start FROM daily GROUP BY 1), i AS (SELECT event_type, date_diff('day', start, ts) AS i, v FROM daily JOIN s USING (event_type)),
    cand(candidate_id, period, k) AS (VALUES {", ".join(f"('{key}', {c['period']}, {c['k']})" for key, c in zip(_CELLS, selection.grid(GRID), strict=True))}),
    w AS (SELECT candidate_id, period, k, cutoff, h, cutoff + h - j * period AS i FROM cand, (VALUES {", ".join(f"({c})" for c in CUTOFFS)}) c(cutoff), range(1, {AHEAD + 1}) a(h), range(1, 13) b(j) WHERE cutoff + h - j * period BETWEEN 0 AND cutoff),
    r AS (SELECT w.*, event_type, v, row_number() OVER (PARTITION BY event_type, candidate_id, cutoff, h ORDER BY w.i DESC) AS r FROM w JOIN i USING (i)),
    f AS (SELECT event_type, candidate_id, cutoff, h, avg(v) AS forecast FROM r WHERE r <= k GROUP BY ALL), t AS (SELECT f.*, i.v AS actual FROM f LEFT JOIN i ON i.event_type = f.event_type AND i.i = f.cutoff + f.h)"""


def _tried(spark: SparkSession, sf: str, some: list[dict]) -> tuple[DataFrame, DataFrame]:
    cells = C.relation(spark, some, "period int, k int")
    return C.seasonal_backtest(daily(spark, sf), "ts", "v", cells, CUTOFFS, AHEAD, dims=["event_type"]), cells


@query(f"WITH {TRIED} SELECT event_type, candidate_id, cutoff, CAST(h AS INTEGER) AS horizon_step, round(forecast, 4) AS forecast, round(actual, 4) AS actual FROM t")
def candidate_backtests(spark: SparkSession, sf: str) -> DataFrame:
    """Forecasts of all seasonal means of a grid after two cutoffs, in one plan."""
    return R.rounded(_tried(spark, sf, selection.grid(GRID))[0].select("event_type", "candidate_id", "cutoff", "horizon_step", "forecast", "actual"), 4)


@query(f"""WITH {TRIED}, m AS (SELECT event_type, candidate_id, count(actual - forecast) AS n, avg(abs(actual - forecast)) AS mae, sqrt(avg((actual - forecast) ** 2)) AS rmse FROM t GROUP BY 1, 2)
    SELECT event_type, candidate_id, n, round(mae, 4) AS mae, round(rmse, 4) AS rmse, CAST(row_number() OVER (PARTITION BY event_type ORDER BY mae, candidate_id) AS INTEGER) AS rank FROM m""")
def candidate_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Their errors and ranks for each series."""
    tried, cells = _tried(spark, sf, selection.grid(GRID))
    return R.rounded(C.scores(tried, cells, ["event_type"]), 4)


@query(f"""WITH {TRIED}, m AS (SELECT candidate_id, avg(abs(actual - forecast)) AS mae FROM t GROUP BY 1)
    SELECT candidate_id, CAST(period AS INTEGER) AS period, CAST(k AS INTEGER) AS k, round(mae, 4) AS score FROM m JOIN cand USING (candidate_id)""")
def candidate_beam_search(spark: SparkSession, sf: str) -> DataFrame:
    """The grid searched group by group with a beam of two that reopens the first group; all that was scored."""

    def score(some: list[dict]) -> DataFrame:
        tried, cells = _tried(spark, sf, some)
        return C.scores(tried, cells).select("candidate_id", F.col("mae").alias("score"))

    _, found = C.beam_search(score, [{"k": GRID["k"]}, {"period": GRID["period"]}], {"period": 7, "k": 1}, beam=3, reopen={1: 0})
    return spark.createDataFrame([(r["candidate_id"], r["params"]["period"], r["params"]["k"], round(r["score"], 4)) for r in found], "candidate_id string, period int, k int, score double")


def _split(alpha: float, prefix: str, upto: int) -> str:
    return solved(f"x WHERE seg <= {upto}", 2, [0, alpha], prefix)


_A = (0.0, 500.0)
_MODELS = [(f"a{i}c{c}", a, c) for i, a in enumerate(_A) for c in range(4)]
_LOSS = " UNION ALL ".join(f"SELECT x.g, {i} AS a, {c + 1} AS seg, sum((y - b0 - b1 * x1) ** 2) AS l, count(*) AS n FROM x JOIN a{i}c{c}beta b ON b.g = x.g WHERE seg = {c + 1} GROUP BY 1" for i, _ in enumerate(_A) for c in range(3))


@query(f"""WITH {DAILY}, x AS (SELECT event_type AS g, v AS y, 1.0 AS x0, CAST(day(ts) AS DOUBLE) AS x1, least(3, (day(ts) - 1) // 7) AS seg FROM daily), {", ".join(_split(a, p, c) for p, a, c in _MODELS)}, l AS ({_LOSS}),
    cv AS (SELECT g, a, sum(l) / sum(n) AS mse FROM l GROUP BY 1, 2), early AS (SELECT g, a, sum(l) / sum(n) AS mse FROM l WHERE seg < 3 GROUP BY 1, 2),
    best AS (SELECT g, arg_min(a, mse) AS a, min(mse) AS mse FROM cv GROUP BY 1), be AS (SELECT g, arg_min(a, mse) AS a FROM early GROUP BY 1),
    fin AS (SELECT g, 0 AS a, b0, b1 FROM a0c3beta UNION ALL SELECT g, 1, b0, b1 FROM a1c3beta)
    SELECT g AS event_type, CAST(CASE best.a WHEN 0 THEN {_A[0]} ELSE {_A[1]} END AS DOUBLE) AS alpha, round(best.mse, 3) AS cv_mse, round(l.l / l.n, 3) AS backtest_mse, CAST(CASE be.a WHEN 0 THEN {_A[0]} ELSE {_A[1]} END AS DOUBLE) AS backtest_alpha, round(b0, 4) AS b0, round(b1, 5) AS b1
    FROM best JOIN be USING (g) JOIN l ON l.g = best.g AND l.a = be.a AND l.seg = 3 JOIN fin ON fin.g = best.g AND fin.a = best.a""")
def forecast_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """Rolling search, backtest and final fit of a trend by weeks, each series read once."""
    df = daily(spark, sf).withColumn("day", F.dayofmonth("ts").cast("double"))
    out = C.regression_pipeline(df, {"one": F.lit(1.0), "day": F.col("day")}, F.col("v"), F.least(F.lit(3), F.floor((F.col("day") - 1) / 7)), _A, ["event_type"])
    b = F.col("coefficients")
    return out.select("event_type", "alpha", F.round(F.array_min("cv_mse"), 3).alias("cv_mse"), F.round("backtest_mse", 3).alias("backtest_mse"), "backtest_alpha", F.round(b[0], 4).alias("b0"), F.round(b[1], 5).alias("b1"))


@query(f"""WITH {TRIED}, m AS (SELECT candidate_id, avg(abs(actual - forecast)) AS mae FROM t GROUP BY 1) SELECT candidate_id, round(mae, 4) AS score FROM m""")
def candidate_log(spark: SparkSession, sf: str) -> DataFrame:
    """Backtests of a grid written to a log, read back, and scored anew from there."""
    import tempfile
    import uuid

    tried, _ = _tried(spark, sf, selection.grid(GRID))
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="cohortry-")
    path = f"{folder.rstrip('/')}/candidates-{uuid.uuid4().hex}"
    selection.record(tried, path, json.dumps(GRID))
    found = C.scores(spark.read.parquet(path), tried.select("candidate_id").distinct())
    return R.rounded(found.select("candidate_id", F.col("mae").alias("score")), 4)
