"""Trimmed errors of groups of any size."""

import numpy as np
from pyspark.sql import functions as F
from cohortry.operators import evaluation as E

def test_trimmed_means_of_large_and_tied_groups(spark):
    rng = np.random.default_rng(1)
    rows = [("big", float(i), float(a), 0.0) for i, a in enumerate(np.round(rng.normal(size=20_000), 2))] + [("same", float(i), 3.0, 1.0) for i in range(300)] + [("few", 0.0, 5.0, 1.0), ("few", 1.0, 100.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, k double, actual double, forecast double").withColumns({c: F.lit(None).cast("double") for c in ("forecast_lower", "forecast_upper")}).repartition(6)
    for trim in (0.0, 0.01, 0.25, 0.6):
        got = {r.g: r for r in E.evaluate(df, ["g"], trim, tie=["k"]).collect()}
        for g in ("big", "same", "few"):
            e = np.sort(np.abs([a - f for h, _, a, f in rows if h == g]))
            own = e[: len(e) - int(np.floor(len(e) * trim))]
            assert got[g].n == len(e) and np.isclose(got[g].mae, own.mean()) and np.isclose(got[g].medae, np.median(own)) and np.isclose(got[g].rmse, np.sqrt((own**2).mean()))
