"""Schemas of raw records, ticks, articles and payloads."""

from __future__ import annotations

_TEXTS = lambda names: ", ".join(f"{n} string" for n in names.split())

#: Names in records and payloads.  Raw records have any producer's keys, all as text.
RAW = _TEXTS("id name title url source content published_at fetched_at symbol price price_usd market_cap market_cap_usd volume_24h coin_circulating")
NEWS = _TEXTS("id title url source published_at fetched_at content scraped_at symbol price_usd market_cap_usd")
LISTING = "data struct<cryptoCurrencyList: array<struct<name: string, symbol: string, circulatingSupply: string, lastUpdated: string, quotes: array<struct<volume24h: string, marketCap: string, price: string>>>>>"
PRODUCTS = "data array<struct<q: string, b: string, c: string, cs: string, qv: string, an: string>>"
COINS = "array<struct<id: string, name: string, symbol: string, current_price: string, market_cap: string, market_cap_rank: string, total_volume: string, price_change_24h: string, price_change_percentage_24h: string>>"
RSS_ITEM = "array<struct<title: string, link: string, pubDate: string, description: string>>"
RSS = f"channel struct<item: {RSS_ITEM}>, item {RSS_ITEM}"
