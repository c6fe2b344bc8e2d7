"""Upstream payloads (column value) to rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions.exprs import to_number

#: Quote currencies of which products are kept.
STABLECOINS = ("USDT", "USDC", "BUSD", "FDUSD", "TUSD")


def parse_coin_listing(payloads: DataFrame) -> DataFrame:
    """One row for each coin of a listing, with its first quote."""
    coins = payloads.select(F.explode(F.from_json("value", schemas.LISTING)["data"]["cryptoCurrencyList"]).alias("c"))
    quote = F.try_element_at("c.quotes", F.lit(1))
    return coins.select(
        F.col("c.name").alias("name"), F.col("c.symbol").alias("symbol"), to_number(quote["price"]).alias("price"), to_number(quote["marketCap"]).alias("market_cap"),
        to_number(quote["volume24h"]).alias("volume_24h"), to_number("c.circulatingSupply").alias("coin_circulating"), F.col("c.lastUpdated").alias("published_at"),
    )


def parse_exchange_products(payloads: DataFrame, dedupe: bool = True) -> DataFrame:
    """One row for each product quoted in a stablecoin; with ``dedupe`` the pair of most volume for each symbol."""
    rows = payloads.select(F.explode(F.from_json("value", schemas.PRODUCTS)["data"]).alias("p")).where(F.col("p.q").isin(*STABLECOINS))
    price, supply = to_number("p.c"), to_number("p.cs")
    out = rows.select(F.coalesce("p.an", "p.b").alias("name"), F.col("p.b").alias("symbol"), F.col("p.q").alias("quote"), price.alias("price"), (price * supply).alias("market_cap"), to_number("p.qv").alias("volume_24h"), supply.alias("coin_circulating"))
    if not dedupe:
        return out
    w = Window.partitionBy("symbol").orderBy(F.desc_nulls_last("volume_24h"), "quote")
    return out.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def parse_coin_markets(payloads: DataFrame, fetched_at: str, source: str = "coingecko") -> DataFrame:
    """One row for each coin; ids from the coin's id and the fetch minute."""
    at = F.lit(fetched_at).cast("timestamp")
    rows = payloads.select(F.explode(F.from_json("value", schemas.COINS)).alias("c"))
    return rows.select(
        F.concat_ws("_", F.lit(source), F.col("c.id"), F.date_format(at, "yyyyMMdd_HHmm")).alias("id"), F.col("c.name").alias("name"), F.upper("c.symbol").alias("symbol"),
        to_number("c.current_price").alias("price"), to_number("c.market_cap").alias("market_cap"), F.col("c.market_cap_rank").try_cast("int").alias("market_cap_rank"),
        to_number("c.total_volume").alias("volume_24h"), to_number("c.price_change_24h").alias("price_change_24h"), to_number("c.price_change_percentage_24h").alias("price_change_pct_24h"), at.alias("fetched_at"), F.lit(source).alias("source"),
    )


def parse_rss(feeds: DataFrame) -> DataFrame:
    """Items of a channel or of the root that have a title and a link."""
    parsed = feeds.select(F.from_xml("value", schemas.RSS).alias("f"))
    items = parsed.select(F.explode(F.concat(F.coalesce("f.channel.item", F.array().cast(schemas.RSS_ITEM)), F.coalesce("f.item", F.array().cast(schemas.RSS_ITEM)))).alias("i"))
    out = items.select(F.trim("i.title").alias("title"), F.trim("i.link").alias("link"), F.trim("i.pubDate").alias("published"), F.trim("i.description").alias("description"))
    return out.where("title <> '' AND link <> ''")
