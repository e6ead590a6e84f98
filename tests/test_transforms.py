"""Names and values of transforms of metrics."""

import datetime

import pytest

from cohortry.operators import series
from cohortry.operators import transforms as N

DAY = datetime.datetime(2024, 1, 1)  # a Monday


def test_names():
    made = [N.Coarsen("W"), N.Coarsen("M", "mean"), N.ShareWithin("W"), N.Diff("W", 1), N.Diff("D", 1, relative=True), N.Diff("W", 3, agg="median"), N.Diff("Y", orders=(2,)), N.Diff("M", orders=(1, 2, 4), agg="mean")]
    assert [t.name for t in made] == ["weekly", "monthly_mean", "within_week_weight", "wow_diff", "rel_dod_diff", "median_3w_diff", "yoy_diff", "mean_3m_diff"]
    assert N.metric_name("sales", made[:1] + made[3:4]) == "sales_weekly_wow_diff"
    for bad in ({}, {"n": 0}, {"n": 1, "orders": (1,)}, {"n": 2}, {"orders": ()}, {"n": 2, "agg": "mode"}):
        with pytest.raises(ValueError):
            N.Diff("D", **bad)


def test_values(spark):
    rows = [("a", DAY + datetime.timedelta(days=i), float(i + 1), 1.0) for i in range(21) if i != 15] + [(None, DAY + datetime.timedelta(days=i), 2.0, 0.0) for i in range(7)]
    df = spark.createDataFrame(rows, "g string, ts timestamp, x double, y double")
    share = {(r.g, r.ts): (r.x, r.y) for r in N.transformed(df, [N.ShareWithin("W")], "ts", ["x", "y"], "D", ["g"]).collect()}
    assert share["a", DAY] == (1 / 28, 1 / 7) and share[None, DAY] == (1 / 7, None) and share["a", DAY + datetime.timedelta(days=16)] == (None, None)
    diff = {(r.g, r.ts): r.x for r in N.transformed(df, [N.Diff("D", orders=(1, 2), agg="max")], "ts", ["x"], "D", ["g"]).collect()}
    assert diff["a", DAY] is None and diff["a", DAY + datetime.timedelta(days=5)] == 1.0 and diff["a", DAY + datetime.timedelta(days=17)] is None and diff[None, DAY + datetime.timedelta(days=2)] == 0.0
    weeks = {(r.g, str(r.ts)[:10]): r.x for r in N.transformed(df, [N.Coarsen("W"), N.Diff("W", 1)], "ts", ["x"], "D", ["g"]).collect()}  # weeks end on Sundays
    assert weeks["a", "2024-01-14"] == 49.0 and weeks["a", "2024-01-07"] is None and (None, "2024-01-07") in weeks


def test_shares_of_months(spark):
    """A month is whole by its own number of days."""
    days = [("a", datetime.datetime(2024, 2, 1) + datetime.timedelta(days=i), 1.0) for i in range(29 + 30)]  # March lacks a day
    df = spark.createDataFrame(days, "g string, ts timestamp, x double")
    got = {str(r.ts)[:10]: r.x_share for r in series.share_within_period(df, "ts", ["x"], "D", "M", ["g"]).collect()}
    assert got["2024-02-29"] == 1 / 29 and got["2024-03-01"] is None
