"""Holidays by rule against known days; clusters against all ways to cut."""

import datetime
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortry.operators import calendars as K

D = datetime.date.fromisoformat


def test_known_days(spark):
    years = spark.createDataFrame([(y,) for y in (1818, 1943, 1954, 1981, 2000, 2019, 2024, 2025, 2049)], "year int")
    easter = {r.y: r.d for r in years.select(F.col("year").alias("y"), K.easter(F.col("year")).alias("d")).collect()}
    want = {1818: "1818-03-22", 1943: "1943-04-25", 1954: "1954-04-18", 1981: "1981-04-19", 2000: "2000-04-23", 2019: "2019-04-21", 2024: "2024-03-31", 2025: "2025-04-20", 2049: "2049-04-18"}
    assert easter == {y: D(d) for y, d in want.items()}
    got = {(r.country, r.holiday): r.date for r in K.holidays(years.where("year = 2024")).collect()}
    for key, day in {("US", "Thanksgiving"): "2024-11-28", ("US", "Memorial Day"): "2024-05-27", ("US", "Juneteenth"): "2024-06-19", ("GB", "Good Friday"): "2024-03-29", ("DE", "Pfingstmontag"): "2024-05-20", (None, "Eid al-Fitr"): "2024-04-10", (None, "Islamic New Year"): "2024-07-08"}.items():
        assert got[key] == D(day), key
    assert ("US", "Juneteenth") not in {(r.country, r.holiday) for r in K.holidays(years.where("year = 2019")).collect()}


def test_rules_of_odd_days(spark):
    years = spark.createDataFrame([(2023,), (2024,), (None,), (2024,)], "year int")
    rules = [K.Rule("leap", "fixed", 2, 29), K.Rule("fifth", "nth", 2, weekday=K.THU, n=5), K.Rule("last", "nth", 2, weekday=K.WED, n=-4, first_year=2024), K.Rule("fest", "fixed", 6, 1, country="X")]
    out = sorted((str(r.date), r.holiday) for r in K.holidays(years, rules, observed=True).collect())
    assert out == [("2024-02-07", "last"), ("2024-02-29", "fifth"), ("2024-02-29", "leap"), ("2024-05-31", "fest (observed)"), ("2024-06-01", "fest"), ("2023-06-01", "fest")][-1:] + [("2024-02-07", "last"), ("2024-02-29", "fifth"), ("2024-02-29", "leap"), ("2024-05-31", "fest (observed)"), ("2024-06-01", "fest")]
    assert K.holidays(years, rules, countries=["Y"]).where("holiday = 'fest'").count() == 0 and K.holidays(years.where("false")).count() == 0
    with pytest.raises(ValueError, match="needs"):
        K.Rule("x", "nth", 1)
    with pytest.raises(ValueError, match="unknown kind"):
        K.Rule("x", "moon")


def test_splits_are_the_best():
    rng = np.random.default_rng(1)
    for n, k in itertools.product((1, 4, 8), (1, 2, 3)):
        x = np.sort(rng.normal(size=n).round(1))
        sse = lambda cuts: sum(((p - p.mean()) ** 2).sum() for p in np.split(x, cuts) if len(p))  # noqa: B023, E731
        found = K.split_points(x, k)
        assert len(found) <= k - 1 and abs(sse(found) - min(sse(list(c)) for c in itertools.combinations(range(n + 1), k - 1))) < 1e-9
    assert len(K.valleys(np.array([0, 0.1, 0.2, 5, 5.1, 5.2]))) == 1 and K.valleys(np.array([1.0])) == [] and K.valleys(np.array([2.0, 2.0])) == []


def test_clusters_and_roles(spark):
    rows = [("a", 5, 10.0, 1.0), ("b", 5, 11.0, 1.0), ("c", 5, -4.0, 0.9), ("d", 1, 50.0, 1.0), ("e", 5, 10.5, 0.5), ("f", 5, None, 1.0), ("g", 5, -4.2, 1.0)]
    df = spark.createDataFrame(rows, "holiday string, days int, effect double, same_sign double")
    got = {r.holiday: r.group for r in K.holiday_clusters(df, 2, least_days=2, same_sign=0.7).collect()}
    assert got == {"a": 2, "b": 2, "c": 1, "g": 1, "d": None, "e": None, "f": None}
    assert {r.holiday: r.group for r in K.holiday_clusters(df.where("holiday <> 'd'"), width=1.0).collect()} == {"a": 2, "b": 2, "e": 2, "c": 1, "g": 1, "f": None}
    assert {r.group for r in K.holiday_clusters(df.where("holiday = 'f'"), 2).collect()} == {None}
    roles = {r.holiday: r.role for r in K.holiday_roles(df, 0.5, 0.9).collect()}
    assert roles == {"b": "alone", "e": "alone", "a": "alone", "d": "positive", "g": "negative", "c": "none", "f": "none"}
