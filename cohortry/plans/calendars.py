"""Holidays by rule and groups of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calendars as K
from ..operators import relational as R
from .registry import load, query

#: Known dates of the years that the orders are in, which the rules have to give.
EASTER = {1992: "04-19", 1993: "04-11", 1994: "04-03", 1995: "04-16", 1996: "04-07", 1997: "03-30", 1998: "04-12", 1999: "04-04", 2000: "04-23", 2001: "04-15", 2002: "03-31", 2003: "04-20"}
_EASTER = ", ".join(f"(DATE '{y}-{d}')" for y, d in EASTER.items())
US = f"""y AS (SELECT DISTINCT year(o_orderdate) AS y FROM orders), d AS (SELECT CAST(unnest(generate_series(DATE '1992-01-01', DATE '2003-12-31', INTERVAL 1 DAY)) AS DATE) AS d), w AS (SELECT d, isodow(d) AS w, row_number() OVER (PARTITION BY year(d), month(d), isodow(d) ORDER BY d) AS n, row_number() OVER (PARTITION BY year(d), month(d), isodow(d) ORDER BY d DESC) AS r FROM d),
    h AS (SELECT d AS date, CASE WHEN month(d) = 11 THEN 'Thanksgiving' WHEN month(d) = 5 THEN 'Memorial Day' WHEN month(d) = 9 THEN 'Labor Day' WHEN month(d) = 1 THEN 'Martin Luther King Jr. Day' WHEN month(d) = 2 THEN 'Presidents'' Day' ELSE 'Columbus Day' END AS holiday FROM w
        WHERE (month(d) = 11 AND w = 4 AND n = 4) OR (w = 1 AND (month(d) = 5 AND r = 1 OR month(d) = 9 AND n = 1 OR month(d) IN (1, 2) AND n = 3 OR month(d) = 10 AND n = 2))
        UNION ALL SELECT d, CASE strftime(d, '%m-%d') WHEN '01-01' THEN 'New Year''s Day' WHEN '07-04' THEN 'Independence Day' WHEN '10-31' THEN 'Halloween' WHEN '11-11' THEN 'Veterans Day' ELSE 'Christmas Day' END FROM d WHERE strftime(d, '%m-%d') IN ('01-01', '07-04', '10-31', '11-11', '12-25')
        UNION ALL SELECT d, 'Easter Sunday' FROM (VALUES {_EASTER}) v(d))"""


def _years(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "orders").select(F.year("o_orderdate").alias("year"))


@query(f"WITH {US} SELECT date, holiday FROM h WHERE year(date) IN (SELECT y FROM y)")
def holidays_by_rule(spark: SparkSession, sf: str) -> DataFrame:
    """A country's holidays, and Easter, in the years of the orders."""
    return K.holidays(_years(spark, sf), countries=["US"], categories=["public", "observance", "christian"]).select("date", "holiday")


@query(f"""WITH e(d) AS (VALUES {_EASTER}) SELECT d + k AS date, CASE k WHEN -2 THEN 'Karfreitag' WHEN 1 THEN 'Ostermontag' WHEN 39 THEN 'Christi Himmelfahrt' ELSE 'Pfingstmontag' END AS holiday, count(o_orderkey) AS orders
    FROM e, (VALUES (-2), (1), (39), (50)) v(k) LEFT JOIN orders ON CAST(o_orderdate AS DATE) = d + k WHERE year(d) IN (SELECT year(o_orderdate) FROM orders) GROUP BY 1, 2""")
def orders_on_movable_holidays(spark: SparkSession, sf: str) -> DataFrame:
    """Orders on the days that move with Easter."""
    days = K.holidays(_years(spark, sf), [r for r in K.RULES if r.kind == "easter" and r.country == "DE"]).select("date", "holiday")
    o = load(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("date"), "o_orderkey")
    return days.join(o, "date", "left").groupBy("date", "holiday").agg(F.count("o_orderkey").alias("orders"))


_SCORES = f"""{US}, v AS (SELECT CAST(o_orderdate AS DATE) AS date, sum(o_totalprice) / 1000 AS v FROM orders GROUP BY 1), s AS (SELECT holiday, count(*) AS days, avg(a.v - (p.v + q.v) / 2) AS effect FROM h JOIN v a USING (date) JOIN v p ON p.date = h.date - 7 JOIN v q ON q.date = h.date + 7 GROUP BY 1)"""


def _effects(spark: SparkSession, sf: str) -> DataFrame:
    v = load(spark, sf, "orders").groupBy(F.col("o_orderdate").cast("date").alias("date")).agg((F.sum("o_totalprice") / 1000).alias("v"))
    days = K.holidays(_years(spark, sf), countries=["US"], categories=["public", "observance", "christian"]).select("date", "holiday")
    near = lambda k, n: v.select(F.date_add("date", k).alias("date"), F.col("v").alias(n))
    both = days.join(v, "date").join(near(7, "p"), "date").join(near(-7, "q"), "date")
    return both.groupBy("holiday").agg(F.count("*").alias("days"), F.avg(F.col("v") - (F.col("p") + F.col("q")) / 2).alias("effect"))


@query(f"""WITH {_SCORES}, r AS (SELECT *, row_number() OVER (ORDER BY effect, holiday) AS k, count(*) OVER () AS n FROM s WHERE days >= 3), c AS (SELECT b.k AS cut, sum(CASE WHEN r.k <= b.k THEN r.effect END) AS s1, sum(CASE WHEN r.k <= b.k THEN r.effect ** 2 END) AS q1, b.k AS n1, sum(CASE WHEN r.k > b.k THEN r.effect END) AS s2, sum(CASE WHEN r.k > b.k THEN r.effect ** 2 END) AS q2, any_value(r.n) - b.k AS n2 FROM r, r b WHERE b.k < b.n GROUP BY b.k),
    best AS (SELECT arg_min(cut, q1 - s1 ** 2 / n1 + q2 - s2 ** 2 / n2) AS cut FROM c), g AS (SELECT holiday, days, effect, CASE WHEN k <= cut THEN 1 ELSE 2 END AS "group" FROM r, best)
    SELECT s.holiday, s.days, round(s.effect, 4) AS effect, CAST(g."group" AS INTEGER) AS "group", round(CASE WHEN g.holiday IS NOT NULL THEN avg(g.effect) OVER (PARTITION BY g."group") END, 4) AS group_effect FROM s LEFT JOIN g USING (holiday)""")
def holiday_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Holidays in two groups of least squares by their effect on the value of orders."""
    return R.rounded(K.holiday_clusters(_effects(spark, sf), 2, least_days=3), 4)


@query(f"""WITH {_SCORES}, z AS (SELECT *, abs(effect) * days AS size FROM s), o AS (SELECT *, coalesce(sum(size) OVER (ORDER BY size DESC, holiday ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(size) OVER () AS share FROM z)
    SELECT holiday, round(effect, 4) AS effect, CASE WHEN size = 0 THEN 'none' WHEN share < 0.6 THEN 'alone' WHEN share < 0.95 AND effect > 0 THEN 'positive' WHEN share < 0.95 THEN 'negative' ELSE 'none' END AS role FROM o""")
def holiday_roles(spark: SparkSession, sf: str) -> DataFrame:
    """Which holidays stand alone, and which only by sign."""
    return R.rounded(K.holiday_roles(_effects(spark, sf), 0.6, 0.95).select("holiday", "effect", "role"), 4)
