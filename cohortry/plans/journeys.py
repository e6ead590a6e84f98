"""Journeys over the events table: keys are users, ties go by event id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import journey as J
from ..operators import relational as R
from ..specs import EventSource, EventSources
from .registry import load, query

KEYS = ["user_id"]
ORDER = ["signup", "view", "click"]


def source(spark: SparkSession, sf: str, **more) -> EventSource:
    return EventSource(load(spark, sf, "events"), event_col="event_type", tie_col="event_id", **more)


def base(spark: SparkSession, sf: str) -> DataFrame:
    return J.events(source(spark, sf))


EV = "e AS (SELECT user_id, ts, event_type AS event, event_id FROM events)"
UND = f"{EV}, seq AS (SELECT user_id, list(event ORDER BY ts, event_id) AS l, min(ts) AS a, max(ts) AS b FROM e GROUP BY 1)"
CON = f"""{EV}, k AS (SELECT *, lag(event) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM e),
    seq AS (SELECT user_id, list(event ORDER BY ts, event_id) AS l, min(ts) AS a, max(ts) AS b FROM k WHERE p IS NULL OR event <> p GROUP BY 1)"""
FULL = f"""{EV}, k AS (SELECT *, row_number() OVER (PARTITION BY user_id, event ORDER BY ts, event_id) AS r FROM e),
    seq AS (SELECT user_id, list(event ORDER BY ts, event_id) AS l, min(ts) AS a, max(ts) AS b FROM k WHERE r = 1 GROUP BY 1)"""
SHOW = "SELECT user_id, array_to_string(l, '>') AS event_seq, a AS seq_start_time, b AS seq_end_time, CAST(len(l) AS INTEGER) AS seq_length FROM seq"


def show(df: DataFrame) -> DataFrame:
    return df.withColumn("event_seq", F.array_join("event_seq", ">"))


@query("SELECT user_id, ts AS time, 'purchase' AS event, event_id AS tie FROM events WHERE event_type = 'purchase' AND value > 20 UNION ALL SELECT user_id, ts, 'visit', event_id FROM events WHERE event_type IN ('view', 'click')")
def union_event_sources(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events")
    sources = (EventSource(e, label="purchase", conditions=("event_type = 'purchase'", "value > 20")), EventSource(e, label="visit", conditions=("event_type in ('view', 'click')",)))
    return J.union_events(EventSources(sources, {"tie_col": "event_id"}))


@query(f"WITH {UND} {SHOW}")
def seq_undeduped(spark: SparkSession, sf: str) -> DataFrame:
    return show(J.undeduped(base(spark, sf), KEYS))


@query(f"WITH {CON} {SHOW}")
def seq_consecutive_deduped(spark: SparkSession, sf: str) -> DataFrame:
    return show(J.consecutive(base(spark, sf), KEYS))


@query(f"WITH {FULL} {SHOW}")
def seq_fully_deduped(spark: SparkSession, sf: str) -> DataFrame:
    return show(J.fully_deduped(base(spark, sf), KEYS))


@query(f"""WITH {EV}, k AS (SELECT *, row_number() OVER (PARTITION BY user_id, event ORDER BY ts, event_id) AS r, CASE event WHEN 'signup' THEN 0 WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 3 END AS o FROM e),
    seq AS (SELECT user_id, list(event ORDER BY o, ts, event_id) AS l, min(ts) AS a, max(ts) AS b FROM k WHERE r = 1 GROUP BY 1) {SHOW}""")
def seq_custom_order(spark: SparkSession, sf: str) -> DataFrame:
    return show(J.fully_deduped(base(spark, sf), KEYS, ORDER))


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n, min(ts) AS a, max(ts) AS b FROM events GROUP BY 1, 2)
    SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS events, min(a) AS seq_start_time, max(b) AS seq_end_time, CAST(sum(n) AS INTEGER) AS seq_length FROM c GROUP BY 1""")
def seq_event_count_map(spark: SparkSession, sf: str) -> DataFrame:
    out = J.count_map(base(spark, sf), KEYS)
    entry = lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))
    return out.select("user_id", F.array_join(F.transform(F.array_sort(F.map_entries("event_count_map")), entry), ",").alias("events"), "seq_start_time", "seq_end_time", "seq_length")


@query(f"WITH {CON} SELECT user_id, l[1] AS s1, l[2] AS s2, l[3] AS s3, l[200] AS s200 FROM seq")
def seq_heads(spark: SparkSession, sf: str) -> DataFrame:
    return J.heads(J.consecutive(base(spark, sf), KEYS), 200).select("user_id", "s1", "s2", "s3", "s200")


@query(f"WITH {FULL} SELECT l[1] AS s1, l[2] AS s2, l[3] AS s3, count(*) AS seq_count, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM seq GROUP BY 1, 2, 3")
def seq_counts_percent(spark: SparkSession, sf: str) -> DataFrame:
    return R.rounded(J.count_sequences(J.first_steps(base(spark, sf), KEYS, 3, "full"), 3))


DAY = "date_trunc('day', ts)"
DAYS = f"""d AS (SELECT user_id, {DAY} AS day, ts, event_type AS event, event_id, lag(event_type) OVER (PARTITION BY user_id, {DAY} ORDER BY ts, event_id) AS p FROM events),
    seq AS (SELECT user_id, day, list(event ORDER BY ts, event_id) AS l, min(ts) AS a, max(ts) AS b FROM d WHERE p IS NULL OR event <> p GROUP BY 1, 2)"""


def daily(spark: SparkSession, sf: str) -> DataFrame:
    return J.consecutive(_by_day(spark, sf), ["user_id", "day"])


def _by_day(spark: SparkSession, sf: str) -> DataFrame:
    return base(spark, sf).withColumn("day", F.date_trunc("day", "time"))


@query(f"""WITH {DAYS}, c AS (SELECT l[1] AS s1, l[2] AS s2, count(DISTINCT user_id) AS seq_count FROM seq GROUP BY 1, 2)
    SELECT coalesce(s1, 'END') AS s1, coalesce(s2, 'END') AS s2, seq_count, round(100.0 * seq_count / sum(seq_count) OVER (), 6) AS percent FROM c""")
def seq_counts_distinct_end(spark: SparkSession, sf: str) -> DataFrame:
    return R.rounded(J.count_sequences(J.first_steps(_by_day(spark, sf), ["user_id", "day"], 2, "consecutive"), 2, distinct="user_id", end="END"))


def _rate(n: str, d: str, by: str = "") -> str:
    pre = f"{by} AS agg_time, " if by else ""
    return f"SELECT {pre}{n} AS numerator_count, {d} AS denominator_count, round({n} / CAST({d} AS DOUBLE), 6) AS conversion_rate FROM seq {'GROUP BY 1' if by else ''}"


@query(f"WITH {DAYS} " + _rate("count(CASE WHEN list_has_any(l, ['purchase', 'click']) THEN 1 END)", "count(CASE WHEN list_has_any(l, ['view']) THEN 1 END)"))
def conversion_any(spark: SparkSession, sf: str) -> DataFrame:
    return R.rounded(J.conversion(daily(spark, sf), ["purchase", "click"], ["view"]))


@query(f"WITH {DAYS} " + _rate("count(DISTINCT CASE WHEN list_has_all(l, ['purchase', 'click']) THEN user_id END)", "count(DISTINCT CASE WHEN list_has_all(l, ['view', 'click']) THEN user_id END)"))
def conversion_all(spark: SparkSession, sf: str) -> DataFrame:
    return R.rounded(J.conversion(daily(spark, sf), ["purchase", "click", "purchase"], ["view", "click"], True, True, "user_id"))


@query(f"WITH {DAYS} " + _rate("count(CASE WHEN list_has_any(l, ['purchase']) THEN 1 END)", "count(CASE WHEN list_has_any(l, ['view']) THEN 1 END)", "date_trunc('day', a)"))
def conversion_by_day(spark: SparkSession, sf: str) -> DataFrame:
    return R.rounded(J.conversion(J.with_bucket(daily(spark, sf)), ["purchase"], ["view"], by=["agg_time"]))


@query(f"WITH {DAYS} " + _rate("count(CASE WHEN list_has_all(l, ['view', 'purchase']) THEN 1 END)", "count(*)"))
def adoption(spark: SparkSession, sf: str) -> DataFrame:
    return R.rounded(J.adoption(daily(spark, sf), ["view", "purchase"]))


_SUM = "count(DISTINCT user_id) AS count, count(*) AS seq_count, round(avg(len(l)), 6) AS avg_seq_length, round(avg(date_sub('minute', a, b)), 4) AS avg_seq_time"


@query(f"WITH {DAYS} SELECT {_SUM} FROM seq")
def seq_summary(spark: SparkSession, sf: str) -> DataFrame:
    return J.summary(daily(spark, sf), "user_id").withColumn("avg_seq_length", F.round("avg_seq_length", 6)).withColumn("avg_seq_time", F.round("avg_seq_time", 4))


@query(f"WITH {DAYS} SELECT date_trunc('week', a) AS agg_time, {_SUM} FROM seq GROUP BY 1")
def seq_summary_by_time(spark: SparkSession, sf: str) -> DataFrame:
    out = J.summary(J.with_bucket(daily(spark, sf), "W"), "user_id", by=["agg_time"])
    return out.withColumn("avg_seq_length", F.round("avg_seq_length", 6)).withColumn("avg_seq_time", F.round("avg_seq_time", 4))


_SL = "x AS (SELECT event_type, CASE WHEN ts < TIMESTAMP '2024-01-15' THEN 'early' ELSE 'late' END AS half, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY 1, 2)"


def _halves(spark: SparkSession, sf: str) -> DataFrame:
    half = F.when(F.col("ts") < F.lit("2024-01-15").cast("timestamp"), "early").otherwise("late").alias("half")
    return load(spark, sf, "events").groupBy("event_type", half).agg(F.count("*").alias("n"))


@query(f"WITH {_SL} SELECT event_type, a.n AS n_1, b.n AS n_2, b.n - a.n AS n_diff FROM x a JOIN x b USING (event_type) WHERE a.half = 'early' AND b.half = 'late'")
def slice_diff(spark: SparkSession, sf: str) -> DataFrame:
    return J.slice_diff(_halves(spark, sf), "n", "half", "early", "late", ["event_type"])


@query(f"""WITH {_SL}, y AS (SELECT event_type, half, 100 * n / sum(n) OVER (PARTITION BY half) AS n FROM x)
    SELECT event_type, round(a.n, 6) AS n_1, round(b.n, 6) AS n_2, round(b.n - a.n, 6) AS n_diff FROM y a JOIN y b USING (event_type) WHERE a.half = 'early' AND b.half = 'late'""")
def slice_diff_normalized(spark: SparkSession, sf: str) -> DataFrame:
    return R.rounded(J.slice_diff(_halves(spark, sf), "n", "half", "early", "late", ["event_type"], normalize=True))


_C3 = f"{DAYS}, c AS (SELECT l[1] AS s1, l[2] AS s2, l[3] AS s3, count(*) AS n FROM seq GROUP BY 1, 2, 3)"


def _counts(spark: SparkSession, sf: str) -> DataFrame:
    return J.count_sequences(J.first_steps(_by_day(spark, sf), ["user_id", "day"], 3, "consecutive"), 3)


@query(f"""WITH {_C3}, p AS (SELECT s1 || '_1' AS source, s2 || '_2' AS target, n FROM c WHERE s2 IS NOT NULL UNION ALL SELECT s2 || '_2', s3 || '_3', n FROM c WHERE s3 IS NOT NULL UNION ALL SELECT s1 || '_1', s1 || '_1', n FROM c WHERE s2 IS NULL)
    SELECT source, target, CAST(sum(n) AS BIGINT) AS value FROM p GROUP BY 1, 2""")
def sankey_links(spark: SparkSession, sf: str) -> DataFrame:
    return J.links(_counts(spark, sf), 3)


@query(f"""WITH {_C3}, p AS (SELECT s1 || '_1' AS source, coalesce(s2, 'End') || '_2' AS target, n FROM c UNION ALL SELECT s2 || '_2', coalesce(s3, 'End') || '_3', n FROM c WHERE s2 IS NOT NULL)
    SELECT source, target, CAST(sum(n) AS BIGINT) AS value FROM p GROUP BY 1, 2""")
def sankey_links_end(spark: SparkSession, sf: str) -> DataFrame:
    return J.links(_counts(spark, sf), 3, end="End")


@query(f"""WITH {_C3}, f AS (SELECT list_filter([s1, s2, s3], lambda x: x IN ('view', 'purchase')) AS e, n FROM c), g AS (SELECT e[1] AS s1, e[2] AS s2, e[3] AS s3, CAST(sum(n) AS BIGINT) AS seq_count FROM f WHERE len(e) > 0 GROUP BY 1, 2, 3)
    SELECT s1, s2, s3, seq_count, round(100.0 * seq_count / sum(seq_count) OVER (), 6) AS percent FROM g""")
def sequence_filter_reagg(spark: SparkSession, sf: str) -> DataFrame:
    return R.rounded(J.filter_sequences(_counts(spark, sf), 3, ["view", "purchase"]))


@query(f"""WITH {FULL}, c AS (SELECT array_to_string(list_sort(l), '>') AS sequence, count(*) AS n FROM seq GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, sequence) AS k FROM c),
    b AS (SELECT CASE WHEN k <= 4 THEN sequence ELSE 'Other' END AS sequence, CAST(sum(n) AS BIGINT) AS count FROM r GROUP BY 1) SELECT sequence, count, round(100.0 * count / sum(count) OVER (), 6) AS percent FROM b""")
def seq_barchart_topn(spark: SparkSession, sf: str) -> DataFrame:
    return R.rounded(J.shown_sequences(J.fully_deduped(base(spark, sf), KEYS), sort=True, top=4))
