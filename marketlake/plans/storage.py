"""Sources and sinks over the tables: each query writes what it derives from them, reads it back and returns that."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs
from ..operators import indicators, ingest, market, marts, models, news, windows
from ..sources import dated, payloads, raw
from ..sources.shared import new_path
from ..sources.tables import articles, ticks
from . import indicators as indicator_plans
from .common import AS_OF, rounded, sql
from .lake import news_rows, raw_ticks

_PATTERN = "*.txt"


def _lines(df: DataFrame, name: str) -> str:
    """Write the rows as JSON lines; the folder."""
    path = new_path(df.sparkSession, name)
    df.select(F.to_json(F.struct("*"))).write.text(path)
    return path


def raw_records(spark, sf_dir):
    """Lines with byte-order marks, blank lines and broken ones among them."""
    rows = raw_ticks(spark, sf_dir)
    n, whole = F.col("id").cast("long"), F.to_json(F.struct("*"))
    line = F.when(n % 11 == 0, F.lit('{"id": "broken')).when(n % 13 == 0, F.lit("  ")).when(n % 7 == 0, F.concat(F.lit("﻿"), whole)).otherwise(whole)
    path = new_path(spark, "raw-lines")
    rows.select(line).write.text(path)
    return raw.read_raw_ndjson(spark, path, pattern=_PATTERN).select("id", "symbol", "url")


def _dated(spark, sf_dir):
    return ticks(spark, sf_dir).withColumn("date", F.date_format("fetched_at", "yyyy-MM-dd"))


def lake_rows(spark, sf_dir):
    """Two writes of different columns, read as one table between two dates."""
    path, t = new_path(spark, "lake"), _dated(spark, sf_dir)
    raw.write_lake(t.where("id % 2 = 0").drop("coin_circulating"), path)
    raw.write_lake(t.where("id % 2 = 1"), path, files_per_date=2)
    found = raw.read_lake(spark, path, "2024-01-05", "2024-01-12")
    return rounded(found.select("id", "symbol", "price", "coin_circulating", F.col("date").cast("string").alias("date")))


def reject_lines(spark, sf_dir):
    path = new_path(spark, "rejects")
    raw.write_rejects(ingest.split_valid(raw_ticks(spark, sf_dir))[1], path)
    return spark.read.schema("id string, _corrupt_record string").option("columnNameOfCorruptRecord", "_none").json(path)


def stored_windows(spark, sf_dir):
    path, t = new_path(spark, "metrics"), ticks(spark, sf_dir)
    for granularity, size in (("tumbling-10m", "10 minutes"), ("tumbling-1h", "1 hour"), ("tumbling-1h", "1 day")):
        raw.write_metrics(windows.compute_window(t, size), path, granularity)
    found = spark.read.parquet(path)
    return found.groupBy(F.col("granularity").cast("string").alias("granularity"), "symbol").agg(F.count("*").alias("n_windows"), F.sum("count").alias("n_ticks"))


def patched_windows(spark, sf_dir):
    """Hourly windows from three batches, the second late and come twice."""
    path, t = new_path(spark, "windows"), ticks(spark, sf_dir)
    for batch, remainders in (("first", [0, 1, 2, 3]), ("late", [4, 5]), ("late", [4, 5]), ("last", [6])):
        windows.merge_window_parts(t.where((F.col("id") % 7).isin(remainders)), path, batch)
    return rounded(windows.merged_windows(spark.read.parquet(path)))


def totals_by_days(spark, sf_dir):
    """Partials of the first weeks, then of the last days again with what came since; the estimate is within 5 % of the ids counted."""
    path, a = new_path(spark, "partials"), articles(spark, sf_dir)
    marts.refresh_partials(a.where("date < '2024-01-20' OR id % 3 = 0"), path)
    marts.refresh_partials(a.where("date >= '2024-01-20'"), path)
    found = marts.totals_of_days(dated.table_at(spark, path), "2024-01-03", "2024-01-28")
    ids = a.where("date BETWEEN '2024-01-03' AND '2024-01-28'").groupBy("source").agg(F.countDistinct("id").alias("n_ids"))
    return found.join(ids, "source").select("source", "n_articles", "first_ts", "last_ts", (F.abs(F.col("about_ids") - F.col("n_ids")) <= 0.05 * F.col("n_ids")).alias("near"))


def loaded_ticks(spark, sf_dir):
    path = new_path(spark, "ticks")
    ticks(spark, sf_dir).write.parquet(path)
    return rounded(raw.load_ticks(spark, path, "s4").select("id", "symbol", "price", "volume_24h"))


def stored_rsi(spark, sf_dir):
    path = new_path(spark, "rsi")
    for t in (ticks(spark, sf_dir).where("symbol < 'S3'"), ticks(spark, sf_dir)):
        raw.overwrite_result(rounded(indicators.latest_rsi(indicators.build_rsi(t)), 4), path)
    return raw.read_result(spark, path, "symbol")


def published_records(spark, sf_dir):
    sent = raw.publish_records(raw_ticks(spark, sf_dir))
    return sent.select("key", *(F.get_json_object("value", f"$.{c}").alias(c) for c in ("id", "symbol", "url")))


def news_lines(spark, sf_dir):
    found = raw.read_news(spark, _lines(news_rows(spark, sf_dir), "news"), _PATTERN)
    return found.select("url", "source", "published_at", F.length("content").alias("n_chars"))


def raw_partitions(spark, sf_dir):
    """Each record twice, and a fourth of the ids seen before."""
    path, rows = new_path(spark, "raw"), raw_ticks(spark, sf_dir)
    seen = rows.where(F.col("id").cast("long") % 4 == 0).select("id", F.to_date(F.substring("fetched_at", 1, 10)).alias("date"))
    raw.write_raw_partition(rows.unionByName(rows), seen, path)
    found = spark.read.schema("id string, symbol string, year int, month int, day int").json(path)
    return found


def refreshed_marts(spark, sf_dir):
    """The daily marts as they were written."""
    paths = marts.refresh_marts(articles(spark, sf_dir), new_path(spark, "marts"))
    read = lambda name: spark.read.parquet(paths[name])
    rows = read("sources_daily").select(F.lit("sources_daily").alias("mart"), F.col("date").cast("string").alias("label"), "source", "value")
    rows = rows.unionByName(read("trending").select(F.lit("trending").alias("mart"), F.col("date").cast("string").alias("label"), "source", F.col("rank").cast("long").alias("value")))
    rows = rows.unionByName(read("latest").select(F.lit("latest").alias("mart"), F.col("metric").alias("label"), F.lit(None).cast("string").alias("source"), F.col("count").alias("value")))
    rows = rows.unionByName(read("windowed").select(F.lit("windowed").alias("mart"), F.date_format("window_start", "yyyy-MM-dd").alias("label"), F.lit(None).cast("string").alias("source"), "value"))
    return rows.unionByName(read("delta").select(F.lit("delta").alias("mart"), F.col("date").cast("string").alias("label"), F.lit(None).cast("string").alias("source"), F.col("delta").alias("value")))


def _hourly(spark, sf_dir, *columns) -> DataFrame:
    """The ticks' columns in lists, one for each symbol and hour."""
    t = ticks(spark, sf_dir)
    return t.groupBy("symbol", F.date_trunc("hour", "fetched_at").alias("hour")).agg(F.collect_list(F.struct(*columns)).alias("each"))


def _stamp():
    return F.date_format("fetched_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")


def coin_listing(spark, sf_dir):
    quotes = F.array(F.struct(F.col("volume_24h").alias("volume24h"), F.col("market_cap").alias("marketCap"), "price"))
    sent = _hourly(spark, sf_dir, "name", "symbol", F.col("coin_circulating").alias("circulatingSupply"), _stamp().alias("lastUpdated"), quotes.alias("quotes"))
    value = F.to_json(F.struct(F.struct(F.col("each").alias("cryptoCurrencyList")).alias("data"))).alias("value")
    return rounded(payloads.parse_coin_listing(sent.select(value)), 4)


def exchange_products(spark, sf_dir):
    """Of each symbol the pair of most volume; the volumes differ by the tick's id."""
    quote = F.when(F.col("source") == "purchase", "USDT").when(F.col("source") == "click", "USDC").when(F.col("source") == "view", "EUR").otherwise("BUSD")
    volume = (F.col("volume_24h") * 1_000_000 + F.col("id")).alias("qv")
    sent = _hourly(spark, sf_dir, quote.alias("q"), F.col("symbol").alias("b"), F.col("price").alias("c"), F.col("coin_circulating").alias("cs"), volume, F.col("name").alias("an"))
    return rounded(payloads.parse_exchange_products(sent.select(F.to_json(F.struct(F.col("each").alias("data"))).alias("value"))), 4)


def coin_markets(spark, sf_dir):
    sent = _hourly(spark, sf_dir, F.concat(F.lit("coin-"), F.col("id")).alias("id"), "name", F.lower("symbol").alias("symbol"), F.col("price").alias("current_price"), "market_cap", F.col("volume_24h").alias("total_volume"))
    out = payloads.parse_coin_markets(sent.select(F.to_json("each").alias("value")), AS_OF)
    return rounded(out.select("id", "name", "symbol", "price", "market_cap", "volume_24h", "source"), 4)


def rss_items(spark, sf_dir):
    title = F.when(F.col("id") % 9 != 0, F.col("name")).otherwise("")
    item = F.concat(F.lit("<item><title> "), title, F.lit("</title><link>"), F.col("url"), F.lit("</link><pubDate>"), _stamp(), F.lit("</pubDate></item>"))
    sent = _hourly(spark, sf_dir, item.alias("item"))
    return payloads.parse_rss(sent.select(F.concat(F.lit("<rss><channel>"), F.array_join("each.item", ""), F.lit("</channel></rss>")).alias("value"))).select("title", "link", "published")


def flexible_times(spark, sf_dir):
    """Times in four formats, and what isn't a time."""
    kind = F.col("id") % 5
    text = F.when(kind == 0, _stamp()).when(kind == 1, F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss")).when(kind == 2, F.date_format("fetched_at", "EEE, dd MMM yyyy HH:mm:ss 'GMT'")).when(kind == 3, F.date_format("fetched_at", "dd-MM-yyyy HH:mm")).otherwise("soon")
    rows = ticks(spark, sf_dir).select("id", text.alias("text"))
    return rows.select("id", exprs.parse_flexible_utc("text", AS_OF).cast("timestamp_ntz").alias("at"))


def valid_articles(spark, sf_dir):
    found = ingest.validate_articles(news_rows(spark, sf_dir))
    return found.select("url", "title", "source", F.length("content").alias("n_chars"))


def news_section_names(spark, sf_dir):
    return news.news_sections(news.news_feed(news_rows(spark, sf_dir)))


def known_symbols(spark, sf_dir):
    t = ticks(spark, sf_dir)
    hourly = windows.compute_window(t, "1 hour")
    return ingest.known_symbols(hourly, market.list_symbols(t.where("symbol > 'S5'"))).select("symbol", "window_start", "count")


def symbol_files(spark, sf_dir):
    """How many files of the lake hold a symbol with 1, with 4, and with both."""
    path = new_path(spark, "lake")
    raw.write_lake(_dated(spark, sf_dir).where("symbol <> 'S1' OR day(fetched_at) % 3 = 0"), path)
    return market.presence_totals(market.symbol_presence_by_file(raw.read_lake(spark, path), ("S1", "S4")))


def market_home(spark, sf_dir):
    """The dashboard's frames, one below the other."""
    t = ticks(spark, sf_dir)
    day = windows.compute_delta(windows.compute_window(t, "1 day")).withColumn("window_label", F.lit("1d"))
    home = market.market_home(t, day, AS_OF, 3, ("S1", "S2", "S3"))
    part = lambda name, symbol, value: home[name].select(F.lit(name).alias("frame"), symbol.alias("symbol"), value.cast("double").alias("value"))
    none = F.lit(None).cast("string")
    rows = part("overview", F.col("symbol"), F.col("price")).unionByName(part("stats", none, F.col("today"))).unionByName(part("cap", none, F.col("total_market_cap")))
    rows = rows.unionByName(part("gainers", F.col("symbol"), F.col("pct"))).unionByName(part("losers", F.col("symbol"), F.col("pct")))
    return rounded(rows.unionByName(part("gainers_summary", F.col("best_symbol"), F.col("avg_pct"))).unionByName(part("losers_summary", F.col("best_symbol"), F.col("avg_pct"))), 4)


def top_features(spark, sf_dir):
    found = ticks(spark, sf_dir).groupBy(F.concat("symbol", F.lit("/"), "source").alias("feature")).agg(F.round(F.avg("price"), 6).alias("importance"))
    return models.top_features(found, 10)


def verdict_of_moves(spark, sf_dir):
    """The verdict over the ticks' own moves as if they were predictions."""
    moves = market.price_moves(ticks(spark, sf_dir)).where("prev_price IS NOT NULL")
    direction = F.when(F.col("price") > F.col("prev_price"), "HAUSSE").otherwise("BAISSE")
    return rounded(models.prediction_verdict(moves.select(direction.alias("direction"), (F.col("price") / (F.col("price") + F.col("prev_price"))).alias("probability_up"))), 6)


QUERIES = {
    f.__name__: f
    for f in (patched_windows, totals_by_days, raw_records, lake_rows, reject_lines, stored_windows, loaded_ticks, stored_rsi, published_records, news_lines, raw_partitions, refreshed_marts, coin_listing, exchange_products, coin_markets, rss_items, flexible_times,
              valid_articles, news_section_names, known_symbols, symbol_files, market_home, top_features, verdict_of_moves)
}

_MOVES = """, moves AS (SELECT *, CASE WHEN prev_price IS NULL THEN 0.0 ELSE (price - prev_price) / nullif(prev_price, 0) * 100 END AS pct
  FROM (SELECT *, lag(price) OVER (PARTITION BY symbol ORDER BY fetched_at, id) AS prev_price FROM ticks WHERE price IS NOT NULL)),
up AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY fetched_at DESC, id DESC) AS r FROM moves WHERE pct > 0) WHERE r = 1 ORDER BY pct DESC, symbol LIMIT 3),
down AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY fetched_at DESC, id DESC) AS r FROM moves WHERE pct < 0) WHERE r = 1 ORDER BY pct, symbol LIMIT 3)"""
_NEWS = r"""(SELECT doc_id, substr(text, 1, 40) AS title, upper(source) AS source, text, strftime(DATE '2024-01-01' + CAST(doc_id % 28 AS INTEGER), '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM documents)"""
_ZULU = "strftime(fetched_at, '%Y-%m-%dT%H:%M:%SZ')"

ORACLE_SQL = {
    "patched_windows": sql("SELECT symbol, date_trunc('hour', fetched_at) AS window_start, date_trunc('hour', fetched_at) + INTERVAL 1 HOUR AS window_end, count(*) AS count, round(arg_max(price, (fetched_at, id)), 6) AS price FROM ticks GROUP BY 1, 2, 3"),
    "totals_by_days": sql("SELECT source, count(*) AS n_articles, min(ts) AS first_ts, max(ts) AS last_ts, true AS near FROM articles WHERE date BETWEEN DATE '2024-01-03' AND DATE '2024-01-28' GROUP BY 1", articles=True),
    "raw_records": sql("SELECT CAST(id AS VARCHAR) AS id, symbol, url FROM ticks WHERE id % 11 <> 0 AND id % 13 <> 0"),
    "lake_rows": sql("SELECT id, symbol, round(price, 6) AS price, CASE WHEN id % 2 = 1 THEN coin_circulating END AS coin_circulating, strftime(fetched_at, '%Y-%m-%d') AS date FROM ticks WHERE CAST(fetched_at AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-12'"),
    "reject_lines": sql("SELECT CAST(id AS VARCHAR) AS id, strftime(published_at, '%d-%m-%Y %H:%M') AS _corrupt_record FROM ticks WHERE id % 3 = 0"),
    "stored_windows": sql("""
, w AS (SELECT 'tumbling-10m' AS granularity, symbol, time_bucket(INTERVAL 10 MINUTE, fetched_at) AS at, count(*) AS n FROM ticks GROUP BY 1, 2, 3 UNION ALL
  SELECT 'tumbling-1h', symbol, date_trunc('hour', fetched_at), count(*) FROM ticks GROUP BY 1, 2, 3 UNION ALL SELECT 'tumbling-1h', symbol, date_trunc('day', fetched_at), count(*) FROM ticks GROUP BY 1, 2, 3)
SELECT granularity, symbol, count(*) AS n_windows, CAST(sum(n) AS BIGINT) AS n_ticks FROM w GROUP BY 1, 2"""),
    "loaded_ticks": sql("SELECT id, symbol, round(price, 6) AS price, volume_24h FROM ticks WHERE symbol = 'S4' AND price IS NOT NULL AND volume_24h IS NOT NULL"),
    "stored_rsi": indicator_plans.ORACLE_SQL["rsi_latest"],
    "published_records": sql("SELECT sha1(url || CASE WHEN id % 2 = 1 THEN '' ELSE '  ' || name || chr(9) || ' x ' END) AS key, CAST(id AS VARCHAR) AS id, symbol, url FROM ticks"),
    "news_lines": f"SELECT 'https://news.example.com/' || doc_id AS url, source, stamp AS published_at, length(text) AS n_chars FROM {_NEWS}",
    "raw_partitions": sql("SELECT CAST(id AS VARCHAR) AS id, symbol, CAST(year(fetched_at) AS INTEGER) AS year, CAST(month(fetched_at) AS INTEGER) AS month, CAST(day(fetched_at) AS INTEGER) AS day FROM ticks WHERE id % 4 <> 0"),
    "refreshed_marts": sql("""
, a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts DESC) AS r FROM articles) WHERE r = 1),
s AS (SELECT strftime(date, '%Y-%m-%d') AS label, source, count(*) AS value FROM a GROUP BY 1, 2),
d AS (SELECT label, sum(value) AS value FROM s GROUP BY 1)
SELECT 'sources_daily' AS mart, label, source, value FROM s
UNION ALL SELECT 'trending', label, source, k FROM (SELECT label, source, row_number() OVER (PARTITION BY label ORDER BY value DESC, source) AS k FROM s) WHERE k <= 10
UNION ALL SELECT 'latest', 'source:' || source, NULL, count(*) FROM a GROUP BY source UNION ALL SELECT 'latest', 'total', NULL, count(*) FROM a
UNION ALL SELECT 'windowed', label, NULL, CAST(value AS BIGINT) FROM d
UNION ALL SELECT 'delta', label, NULL, CAST(coalesce(value - lag(value) OVER (ORDER BY label), 0) AS BIGINT) FROM d""", articles=True),
    "coin_listing": sql(f"SELECT name, symbol, round(price, 4) AS price, round(market_cap, 4) AS market_cap, volume_24h, coin_circulating, {_ZULU} AS published_at FROM ticks"),
    "exchange_products": sql("""
, p AS (SELECT *, CASE source WHEN 'purchase' THEN 'USDT' WHEN 'click' THEN 'USDC' WHEN 'view' THEN 'EUR' ELSE 'BUSD' END AS quote, volume_24h * 1000000 + id AS qv FROM ticks)
SELECT name, symbol, quote, round(price, 4) AS price, round(price * coin_circulating, 4) AS market_cap, qv AS volume_24h, coin_circulating
FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY qv DESC NULLS LAST, quote) AS r FROM p WHERE quote <> 'EUR') WHERE r = 1"""),
    "coin_markets": sql(f"SELECT 'coingecko_coin-' || id || '_{AS_OF[:10].replace('-', '')}_{AS_OF[11:16].replace(':', '')}' AS id, name, upper(symbol) AS symbol, round(price, 4) AS price, round(market_cap, 4) AS market_cap, volume_24h, 'coingecko' AS source FROM ticks"),
    "rss_items": sql(f"SELECT name AS title, url AS link, {_ZULU} AS published FROM ticks WHERE id % 9 <> 0"),
    "flexible_times": sql(f"SELECT id, CASE id % 5 WHEN 3 THEN date_trunc('minute', fetched_at) WHEN 4 THEN TIMESTAMP '{AS_OF}' ELSE date_trunc('second', fetched_at) END AS at FROM ticks"),
    "valid_articles": f"SELECT 'https://news.example.com/' || doc_id AS url, trim(title) AS title, lower(trim(source)) AS source, length(nullif(trim(text), '')) AS n_chars FROM {_NEWS} WHERE doc_id % 7 <> 0 AND trim(title) <> '' AND trim(source) <> ''",
    "news_section_names": "SELECT DISTINCT lower(source) AS section FROM documents WHERE trim(text) <> '' AND source <> ''",
    "known_symbols": sql("SELECT symbol, date_trunc('hour', fetched_at) AS window_start, count(*) AS count FROM ticks WHERE symbol > 'S5' GROUP BY 1, 2"),
    "symbol_files": sql("""
, f AS (SELECT CAST(fetched_at AS DATE) AS file, bool_or(symbol = 'S1' AND day(fetched_at) % 3 = 0) AS a, bool_or(symbol = 'S4') AS b FROM ticks GROUP BY 1)
SELECT count(*) AS files, count(*) FILTER (WHERE a) AS has_s1, count(*) FILTER (WHERE b) AS has_s4, count(*) FILTER (WHERE a AND b) AS has_all FROM f"""),
    "market_home": sql(_MOVES + f"""
, f AS (SELECT 'overview' AS frame, symbol, max_by(price, (fetched_at, id)) AS value FROM ticks WHERE symbol IN ('S1', 'S2', 'S3') GROUP BY 2
  UNION ALL SELECT 'stats', NULL, count(*) FROM ticks WHERE CAST(fetched_at AS DATE) = DATE '{AS_OF[:10]}'
  UNION ALL SELECT 'cap', NULL, sum(cap) FROM (SELECT max_by(market_cap, (fetched_at, id)) AS cap FROM ticks WHERE market_cap IS NOT NULL GROUP BY symbol)
  UNION ALL SELECT 'gainers', symbol, pct FROM up UNION ALL SELECT 'losers', symbol, pct FROM down
  UNION ALL SELECT 'gainers_summary', arg_max(symbol, (pct, symbol)), avg(pct) FROM up UNION ALL SELECT 'losers_summary', arg_max(symbol, (pct, symbol)), avg(pct) FROM down)
SELECT frame, symbol, round(value::DOUBLE, 4) AS value FROM f"""),
    "top_features": sql("SELECT symbol || '/' || source AS feature, round(avg(price), 6) AS importance FROM ticks GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"),
    "verdict_of_moves": sql("""
, m AS (SELECT price, lag(price) OVER (PARTITION BY symbol ORDER BY fetched_at, id) AS prev FROM ticks WHERE price IS NOT NULL),
v AS (SELECT count(*) FILTER (WHERE price > prev) AS n_up, count(*) FILTER (WHERE price <= prev) AS n_down, round(avg(price / (price + prev)), 6) AS avg_probability FROM m WHERE prev IS NOT NULL)
SELECT *, round(n_up * 100.0::DOUBLE / (n_up + n_down), 6) AS pct_up, round(n_down * 100.0::DOUBLE / (n_up + n_down), 6) AS pct_down, CASE WHEN n_up > n_down THEN 'HAUSSE' WHEN n_up < n_down THEN 'BAISSE' ELSE 'NEUTRE' END AS verdict FROM v"""),
}
