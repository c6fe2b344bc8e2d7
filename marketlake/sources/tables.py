"""The tick and article views over the tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The tick view in SQL; ``ticks`` builds the same rows with columns.
TICKS_SQL = """
SELECT event_id AS id, concat('S', user_id % 10) AS symbol, concat('name-', user_id % 10) AS name,
       event_type AS source,
       concat('https://www.', CASE event_type WHEN 'click' THEN 'coingecko' WHEN 'view' THEN 'coinmarketcap'
              WHEN 'purchase' THEN 'binance' WHEN 'signup' THEN 'crypto-wire' ELSE 'example' END, '.com/item/', event_id) AS url,
       ts AS fetched_at, ts AS published_at, value AS price, value * (1000 + user_id) AS market_cap,
       CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS volume_24h, CAST(1000 + user_id AS DOUBLE) AS coin_circulating
FROM events
"""

ARTICLES_SQL = """
SELECT id, ts, date, title, url, source, fetched_at FROM (
  SELECT id, fetched_at AS ts, CAST(fetched_at AS DATE) AS date, name AS title, url, source, fetched_at FROM ticks
  UNION ALL
  SELECT id, fetched_at + INTERVAL 1 HOUR AS ts, CAST(fetched_at + INTERVAL 1 HOUR AS DATE) AS date, name AS title, url, source, fetched_at
  FROM ticks WHERE id % 10 = 0)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tick per event: ten symbols, prices and volumes from the event's value and properties."""
    e = table(spark, sf_dir, "events")
    site = F.when(F.col("event_type") == "click", "coingecko").when(F.col("event_type") == "view", "coinmarketcap").when(F.col("event_type") == "purchase", "binance").when(F.col("event_type") == "signup", "crypto-wire").otherwise("example")
    digit = (F.col("user_id") % 10).cast("string")
    return e.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("S"), digit).alias("symbol"),
        F.concat(F.lit("name-"), digit).alias("name"),
        F.col("event_type").alias("source"),
        F.concat(F.lit("https://www."), site, F.lit(".com/item/"), F.col("event_id")).alias("url"),
        F.col("ts").alias("fetched_at"),
        F.col("ts").alias("published_at"),
        F.col("value").alias("price"),
        (F.col("value") * (1000 + F.col("user_id"))).alias("market_cap"),
        F.regexp_extract("props", "([0-9]+)", 1).try_cast("double").alias("volume_24h"),
        (1000 + F.col("user_id")).cast("double").alias("coin_circulating"),
    )


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles with every tenth row once more, an hour later."""
    t = ticks(spark, sf_dir)
    row = lambda ts: [F.col("id"), ts.alias("ts"), ts.cast("date").alias("date"), F.col("name").alias("title"), "url", "source", "fetched_at"]
    later = F.col("fetched_at") + F.expr("INTERVAL 1 HOUR")
    return t.select(row(F.col("fetched_at"))).unionByName(t.where("id % 10 = 0").select(row(later)))
