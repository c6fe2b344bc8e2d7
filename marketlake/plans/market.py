"""Windows, movers and market summaries over the ticks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import market, windows
from ..sources.tables import ticks
from .common import AS_OF, DELTAS_SQL, rounded, sql

SYMBOLS = ("S1", "S2", "S3", "S5", "S8")


def windows_10m(spark, sf_dir):
    return rounded(windows.compute_window(ticks(spark, sf_dir), "10 minutes"))


def windows_1h(spark, sf_dir):
    return rounded(windows.compute_window(ticks(spark, sf_dir), "1 hour"))


def windows_sliding(spark, sf_dir):
    return rounded(windows.compute_window(ticks(spark, sf_dir), "30 minutes", "1 hour"))


def delta_1h(spark, sf_dir):
    return rounded(windows.compute_delta(windows.compute_window(ticks(spark, sf_dir), "1 hour")))


def trending_rank(spark, sf_dir):
    return rounded(windows.trending_rank(windows.compute_window(ticks(spark, sf_dir), "1 day"), 100))


def price_moves(spark, sf_dir):
    return rounded(market.price_moves(ticks(spark, sf_dir)).select("id", "symbol", "price", "prev_price", "pct"))


def top_gainers(spark, sf_dir):
    return rounded(market.top_gainers(ticks(spark, sf_dir), 5))


def top_losers(spark, sf_dir):
    return rounded(market.top_losers(ticks(spark, sf_dir), 5))


def movers_summary(spark, sf_dir):
    return rounded(market.movers_summary(market.top_gainers(ticks(spark, sf_dir), 5)), 4)


def market_overview(spark, sf_dir):
    day = windows.compute_delta(windows.compute_window(ticks(spark, sf_dir), "1 day")).withColumn("window_label", F.lit("1d"))
    return rounded(market.market_overview(ticks(spark, sf_dir), day, SYMBOLS))


def total_market_cap(spark, sf_dir):
    return rounded(market.total_market_cap(ticks(spark, sf_dir)), 4)


def market_stats(spark, sf_dir):
    return rounded(market.market_stats(ticks(spark, sf_dir), AS_OF))


def trending_symbols(spark, sf_dir):
    return rounded(market.trending_symbols(ticks(spark, sf_dir), AS_OF, 24, 20))


def trending_between(spark, sf_dir):
    rows = windows.trending_changes(windows.compute_window(ticks(spark, sf_dir), "1 day"))
    rows = rows.select("source", "value", "delta_pct", F.lit("1d").alias("window_label"), F.col("window_start").cast("timestamp").alias("as_of"))
    return rounded(market.trending_between(rows, "1d", "2024-01-10 00:00:00", "2024-01-20 00:00:00", 20).withColumn("as_of", F.col("as_of").cast("timestamp_ntz")))


def latest_per_symbol(spark, sf_dir):
    return rounded(market.latest_per_symbol(ticks(spark, sf_dir), ["id", "price", "fetched_at"]))


def latest_row(spark, sf_dir):
    return rounded(market.latest_row(ticks(spark, sf_dir)).select("id", "symbol", "price", "fetched_at"))


def last_n_per_symbol(spark, sf_dir):
    return rounded(market.last_n_per_symbol(ticks(spark, sf_dir), 25).select("id", "symbol", "price", "fetched_at"))


def list_symbols(spark, sf_dir):
    return market.list_symbols(ticks(spark, sf_dir))


def table_profile(spark, sf_dir):
    return market.table_profile(ticks(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (windows_10m, windows_1h, windows_sliding, delta_1h, trending_rank, price_moves, top_gainers, top_losers, movers_summary, market_overview, total_market_cap, market_stats, trending_symbols, trending_between, latest_per_symbol, latest_row, last_n_per_symbol, list_symbols, table_profile)
}

_WINDOW = "SELECT symbol, {start} AS window_start, {start} + INTERVAL {size} AS window_end, count(*) AS count, round(arg_max(price, (fetched_at, id)), 6) AS price FROM ticks GROUP BY 1, 2"
_MOVES = """, moves AS (SELECT *, CASE WHEN prev_price IS NULL THEN 0.0 ELSE (price - prev_price) / nullif(prev_price, 0) * 100 END AS pct
  FROM (SELECT *, lag(price) OVER (PARTITION BY symbol ORDER BY fetched_at, id) AS prev_price FROM ticks WHERE price IS NOT NULL)),
movers AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY fetched_at DESC, id DESC) AS r FROM moves WHERE pct {sign} 0) WHERE r = 1 ORDER BY pct {order}, symbol LIMIT 5)"""
_MOVER = "SELECT symbol, name, round(price, 6) AS price, round(prev_price, 6) AS prev_price, round(pct, 6) AS pct, round(market_cap, 6) AS market_cap, round(volume_24h, 6) AS volume_24h, fetched_at FROM movers"
_DAYS = """, dw AS (SELECT symbol, date_trunc('day', fetched_at) AS window_start, count(*) AS value, arg_max(price, (fetched_at, id)) AS price FROM ticks GROUP BY 1, 2),
dd AS (SELECT *, lag(value) OVER w AS previous, lag(price) OVER w AS prev_price FROM dw WINDOW w AS (PARTITION BY symbol ORDER BY window_start)),
ranked AS (SELECT symbol AS source, window_start, window_start + INTERVAL 1 DAY AS window_end, value, value - previous AS delta, (value - previous) * 1.0::DOUBLE / nullif(previous, 0) * 100 AS delta_pct FROM dd)"""

ORACLE_SQL = {
    "windows_10m": sql(_WINDOW.format(start="time_bucket(INTERVAL 10 MINUTE, fetched_at)", size="10 MINUTE")),
    "windows_1h": sql(_WINDOW.format(start="date_trunc('hour', fetched_at)", size="1 HOUR")),
    "windows_sliding": sql("""
, slots AS (SELECT *, time_bucket(INTERVAL 30 MINUTE, fetched_at) AS slot FROM ticks),
each AS (SELECT *, slot AS window_start FROM slots UNION ALL SELECT *, slot - INTERVAL 30 MINUTE AS window_start FROM slots),
firsts AS (SELECT symbol, min(slot) AS first_slot FROM slots GROUP BY 1)
SELECT symbol, window_start, window_start + INTERVAL 1 HOUR AS window_end, count(*) AS count, round(arg_max(price, (fetched_at, id)), 6) AS price
FROM each JOIN firsts USING (symbol) WHERE window_start >= first_slot GROUP BY 1, 2"""),
    "delta_1h": sql(DELTAS_SQL + """
SELECT symbol, window_start, window_end, round(price, 6) AS price, round(prev_price, 6) AS prev_price, round(delta, 6) AS delta,
       round(delta_pct, 6) AS delta_pct, coalesce(delta_pct > 50, false) AS trending_up FROM d"""),
    "trending_rank": sql(_DAYS + """
SELECT source, window_start, window_end, value, delta, round(delta_pct, 6) AS delta_pct, dense_rank() OVER (ORDER BY delta_pct DESC) AS rank
FROM (SELECT * FROM ranked WHERE delta_pct IS NOT NULL ORDER BY delta_pct DESC, value DESC, source, window_start LIMIT 100)"""),
    "price_moves": sql(_MOVES.format(sign=">", order="DESC") + " SELECT id, symbol, round(price, 6) AS price, round(prev_price, 6) AS prev_price, round(pct, 6) AS pct FROM moves"),
    "top_gainers": sql(_MOVES.format(sign=">", order="DESC") + _MOVER),
    "top_losers": sql(_MOVES.format(sign="<", order="ASC") + _MOVER),
    "movers_summary": sql(_MOVES.format(sign=">", order="DESC") + """
SELECT arg_max(symbol, (pct, symbol)) AS best_symbol, round(max(pct), 4) AS best_pct, arg_min(symbol, (pct, symbol)) AS worst_symbol, round(min(pct), 4) AS worst_pct,
       round(sum(market_cap), 4) AS total_market_cap, round(avg(pct), 4) AS avg_pct FROM movers"""),
    "market_overview": sql(_DAYS + """
, change AS (SELECT symbol, arg_max((price - prev_price) / nullif(prev_price, 0) * 100, window_start) AS delta_pct FROM dd WHERE (price - prev_price) / nullif(prev_price, 0) IS NOT NULL GROUP BY 1),
newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY fetched_at DESC, id DESC) AS r FROM ticks WHERE symbol IN ('S1', 'S2', 'S3', 'S5', 'S8')) WHERE r = 1)
SELECT symbol, name, round(price, 6) AS price, round(market_cap, 6) AS market_cap, round(volume_24h, 6) AS volume_24h, fetched_at, round(coalesce(delta_pct, 0), 6) AS delta_pct
FROM newest LEFT JOIN change USING (symbol)"""),
    "total_market_cap": sql("SELECT round(sum(cap), 4) AS total_market_cap, count(*) AS symbols FROM (SELECT symbol, arg_max(market_cap, (fetched_at, id)) AS cap FROM ticks WHERE market_cap IS NOT NULL GROUP BY 1)"),
    "market_stats": sql(f"""
, s AS (SELECT count(DISTINCT CASE WHEN lower(url) LIKE '%coinmarketcap%' THEN 'coinmarketcap' WHEN lower(url) LIKE '%coingecko%' THEN 'coingecko' WHEN lower(url) LIKE '%binance%' THEN 'binance'
       WHEN lower(url) LIKE '%crypto%' THEN 'crypto_news' ELSE regexp_extract(url, '^[^/]*//[^/]*') END) AS sources, count(DISTINCT nullif(upper(trim(symbol)), '')) AS symbols, count(*) AS total,
       count(*) FILTER (WHERE CAST(fetched_at AS DATE) = DATE '{AS_OF[:10]}') AS today, count(*) FILTER (WHERE CAST(fetched_at AS DATE) = DATE '{AS_OF[:10]}' - 1) AS yesterday,
       count(*) FILTER (WHERE date_trunc('month', fetched_at) = date_trunc('month', DATE '{AS_OF[:10]}')) AS this_month FROM ticks)
SELECT *, round(CASE WHEN yesterday > 0 THEN (today - yesterday) * 100.0::DOUBLE / yesterday WHEN today > 0 THEN 100.0 ELSE 0.0 END, 6) AS change_pct FROM s"""),
    "trending_symbols": sql(f"""
, c AS (SELECT upper(trim(symbol)) AS source, count(*) FILTER (WHERE fetched_at >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR) AS value,
       count(*) FILTER (WHERE fetched_at < TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR) AS previous
       FROM ticks WHERE fetched_at >= TIMESTAMP '{AS_OF}' - INTERVAL 48 HOUR AND fetched_at < TIMESTAMP '{AS_OF}' GROUP BY 1),
p AS (SELECT *, value - previous AS delta, CASE WHEN previous = 0 THEN 100.0 ELSE (value - previous) * 100.0::DOUBLE / previous END AS pct FROM c)
SELECT source, value, previous, delta, round(pct, 6) AS delta_pct FROM p ORDER BY abs(pct) DESC, value DESC, source LIMIT 20"""),
    "trending_between": sql(_DAYS + """
, top AS (SELECT * FROM ranked WHERE delta_pct IS NOT NULL)
SELECT source, value, round(delta_pct, 6) AS delta_pct, '1d' AS window_label, CAST(window_start AS TIMESTAMP) AS as_of FROM top
WHERE window_start BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20' ORDER BY delta_pct DESC NULLS LAST, value DESC, source, window_start LIMIT 20"""),
    "latest_per_symbol": sql("SELECT symbol, max_by(id, (fetched_at, id)) AS id, round(max_by(price, (fetched_at, id)), 6) AS price, max(fetched_at) AS fetched_at FROM ticks GROUP BY 1"),
    "latest_row": sql("SELECT id, symbol, round(price, 6) AS price, fetched_at FROM ticks ORDER BY fetched_at DESC, id DESC LIMIT 1"),
    "last_n_per_symbol": sql("SELECT id, symbol, round(price, 6) AS price, fetched_at FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY fetched_at DESC, id DESC) AS r FROM ticks) WHERE r <= 25"),
    "list_symbols": sql("SELECT DISTINCT upper(trim(symbol)) AS symbol FROM ticks WHERE trim(symbol) <> ''"),
    "table_profile": sql("SELECT count(*) AS n_rows, count(DISTINCT symbol) AS n_symbols, count(DISTINCT CAST(fetched_at AS DATE)) AS n_dates, count(price) AS with_price, count(volume_24h) AS with_volume, min(fetched_at) AS first_ts, max(fetched_at) AS last_ts FROM ticks"),
}
