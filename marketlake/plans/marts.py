"""Daily marts and time series over articles and ticks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import marts
from ..sources.tables import articles, ticks
from .common import rounded, sql

START, END = "2024-01-05 06:00:00", "2024-01-25 18:00:00"


def timeseries_hour(spark, sf_dir):
    return marts.timeseries_count(articles(spark, sf_dir), START, END, "hour")


def timeseries_day(spark, sf_dir):
    return marts.timeseries_count(articles(spark, sf_dir), START, END, "day")


def top_sources(spark, sf_dir):
    return marts.top_sources(articles(spark, sf_dir), START, END, 3)


def period_by_source(spark, sf_dir):
    return rounded(marts.period_aggregate(ticks(spark, sf_dir), START, END)["by_source"])


def period_by_symbol(spark, sf_dir):
    return rounded(marts.period_aggregate(ticks(spark, sf_dir), START, END)["by_symbol"])


def availability(spark, sf_dir):
    return marts.availability(ticks(spark, sf_dir), min_points=10, usable=True)


def daily_windows(spark, sf_dir):
    return marts.daily_windows(articles(spark, sf_dir))


def daily_delta(spark, sf_dir):
    return rounded(marts.daily_delta(articles(spark, sf_dir)))


def sources_daily(spark, sf_dir):
    return marts.sources_daily(articles(spark, sf_dir))


def latest_snapshot(spark, sf_dir):
    return marts.latest_snapshot(articles(spark, sf_dir))


def daily_trending(spark, sf_dir):
    return marts.daily_trending(articles(spark, sf_dir), 3)


def dedupe_latest(spark, sf_dir):
    return marts.dedupe_latest(articles(spark, sf_dir))


def bucketed_price(spark, sf_dir):
    return rounded(marts.bucketed_price(ticks(spark, sf_dir), "hour", START, END))


def align_periods(spark, sf_dir):
    rows = articles(spark, sf_dir)
    side = lambda a, b, bucket: marts.timeseries_count(rows, a, b, bucket).select(F.col("bucket").alias("t"), "value")
    return marts.align_periods(side("2024-01-05 00:00:00", "2024-01-12 00:00:00", "hour"), side("2024-01-08 00:00:00", "2024-01-15 00:00:00", "day"), "hour", "day")


QUERIES = {
    f.__name__: f
    for f in (timeseries_hour, timeseries_day, top_sources, period_by_source, period_by_symbol, availability, daily_windows, daily_delta, sources_daily, latest_snapshot, daily_trending, dedupe_latest, bucketed_price, align_periods)
}

_INSIDE = f"BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'"
_SERIES = f"SELECT date_trunc('{{0}}', ts) AS bucket, count(*) AS value FROM articles WHERE ts {_INSIDE} GROUP BY 1"

ORACLE_SQL = {
    "timeseries_hour": sql(_SERIES.format("hour"), articles=True),
    "timeseries_day": sql(_SERIES.format("day"), articles=True),
    "top_sources": sql(f"SELECT source, count(*) AS value FROM articles WHERE ts >= TIMESTAMP '{START}' AND ts < TIMESTAMP '{END}' AND source IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3", articles=True),
    "period_by_source": sql(f"""SELECT source, count(*) AS n_rows, arg_min(id, (fetched_at, id)) AS oldest_id, min(fetched_at) AS oldest_fetched_at, round(arg_min(price, (fetched_at, id)), 6) AS oldest_price,
  arg_max(id, (fetched_at, id)) AS newest_id, max(fetched_at) AS newest_fetched_at, round(arg_max(price, (fetched_at, id)), 6) AS newest_price FROM ticks WHERE fetched_at {_INSIDE} GROUP BY 1"""),
    "period_by_symbol": sql(f"SELECT symbol, count(*) AS n_rows, round(avg(price), 6) AS avg_price FROM ticks WHERE fetched_at {_INSIDE} AND symbol IS NOT NULL GROUP BY 1"),
    "availability": sql("SELECT symbol, count(*) AS points, min(fetched_at) AS first_ts, max(fetched_at) AS last_ts FROM ticks WHERE price IS NOT NULL AND volume_24h IS NOT NULL GROUP BY 1 HAVING count(*) > 10"),
    "daily_windows": sql("SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, count(*) AS value, date_trunc('day', ts)::TIMESTAMP + INTERVAL 1 DAY AS window_end FROM articles GROUP BY 1, 3", articles=True),
    "daily_delta": sql("""
, c AS (SELECT date, count(*) AS value FROM articles GROUP BY 1), l AS (SELECT *, lag(value) OVER (ORDER BY date) AS previous FROM c)
SELECT date, value, coalesce(value - previous, 0) AS delta, round((value - previous) * 100.0::DOUBLE / nullif(previous, 0), 6) AS delta_pct FROM l""", articles=True),
    "sources_daily": sql("SELECT date, source, count(*) AS value FROM articles GROUP BY 1, 2", articles=True),
    "latest_snapshot": sql("SELECT 'source:' || coalesce(source, 'unknown') AS metric, count(*) AS count, max(ts) AS updated_at FROM articles GROUP BY source UNION ALL SELECT 'total', count(*), max(ts) FROM articles", articles=True),
    "daily_trending": sql("SELECT * FROM (SELECT date, source, value, row_number() OVER (PARTITION BY date ORDER BY value DESC, source) AS rank FROM (SELECT date, source, count(*) AS value FROM articles GROUP BY 1, 2)) WHERE rank <= 3", articles=True),
    "dedupe_latest": sql("SELECT id, ts, date, title, url, source, fetched_at FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts DESC) AS r FROM articles) WHERE r = 1", articles=True),
    "bucketed_price": sql(f"SELECT symbol, date_trunc('hour', fetched_at) AS t, round(avg(price), 6) AS price FROM ticks WHERE fetched_at {_INSIDE} GROUP BY 1, 2"),
    "align_periods": sql("""
, a AS (SELECT date_trunc('hour', ts) AS t, count(*) AS value_a FROM articles WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12' GROUP BY 1),
b AS (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS t, count(*) AS value_b FROM articles WHERE ts BETWEEN TIMESTAMP '2024-01-08' AND TIMESTAMP '2024-01-15' GROUP BY 1)
SELECT coalesce(a.t, b.t) AS t, value_a, value_b FROM a FULL JOIN b ON a.t = b.t""", articles=True),
}
