"""Ingest, ids, merges, news and pages over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs
from ..operators import indicators, ingest, market, models, news, windows
from ..sources import pages as page_source
from ..sources import raw
from ..sources.tables import table, ticks
from .common import AS_OF, DELTAS_SQL, rounded, sql


def clean_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", exprs.clean_text("text").alias("text"))


def article_id(spark, sf_dir):
    rows = ticks(spark, sf_dir).select(F.col("id").alias("tick"), "url", F.col("name").alias("title"), "name", "symbol", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at"), F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss").alias("fetched_at"))
    return rows.select("tick", exprs.article_id("url_title").alias("url_title"), exprs.article_id("json").alias("json"), exprs.article_id("listing").alias("listing"), exprs.article_id("folded").alias("folded"))


def url_sources(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", exprs.source_of_url("url").alias("source"))


def raw_ticks(spark, sf_dir):
    """The ticks as raw records of two producers, numbers as text with signs."""
    t = ticks(spark, sf_dir)
    odd = F.col("id") % 2 == 1
    money = F.concat(F.lit("$"), F.format_number("price", 2))
    return t.select(
        F.col("id").cast("string").alias("id"), F.when(odd, F.col("name")).alias("name"), F.when(~odd, F.concat(F.lit("  "), F.col("name"), F.lit("\t x "))).alias("title"), "url", "source",
        F.when(odd, money).otherwise("0").alias("price"), F.when(~odd, F.col("price").cast("decimal(18,2)").cast("string")).alias("price_usd"), F.col("volume_24h").cast("int").cast("string").alias("volume_24h"),
        F.when(F.col("id") % 5 != 0, F.col("coin_circulating").cast("int").cast("string")).alias("coin_circulating"), "symbol", F.date_format("fetched_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("fetched_at"),
        F.when(F.col("id") % 3 == 0, F.date_format("published_at", "dd-MM-yyyy HH:mm")).otherwise(F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("published_at"),
    )


def normalize_tick(spark, sf_dir):
    lines = raw_ticks(spark, sf_dir).select(F.to_json(F.struct("*")).alias("value"))
    out = ingest.require_market_fields(ingest.normalize_tick(raw.parse_lines(lines)))
    return rounded(out.select("id", "name", "symbol", "price", "volume_24h", "coin_circulating", "date"))


def split_valid_counts(spark, sf_dir):
    valid, rejects = ingest.split_valid(raw_ticks(spark, sf_dir))
    of = lambda df, name: df.groupBy("source").agg(F.count("*").alias("n_rows"), F.min("id").alias("first_id")).withColumn("side", F.lit(name))
    return of(valid, "valid").unionByName(of(rejects, "rejected"))


def merge_ticks(spark, sf_dir):
    t = ticks(spark, sf_dir)
    return rounded(ingest.merge_ticks(t.where("id % 3 = 0"), t.where("id % 2 = 0").union(t.where("id % 4 = 0"))).select("id", "symbol", "price", "fetched_at"))


def upsert_ticks(spark, sf_dir):
    t = ticks(spark, sf_dir)
    later = t.where("id % 10 = 0").withColumn("fetched_at", F.col("fetched_at") + F.expr("INTERVAL 1 HOUR")).withColumn("price", F.col("price") + 1)
    return rounded(ingest.upsert_ticks(t, later).select("id", "price", "fetched_at"))


def merge_deltas(spark, sf_dir):
    d = windows.compute_delta(windows.compute_window(ticks(spark, sf_dir), "1 hour"))
    existing = d.where("hour(window_start) < 12").withColumn("window_label", F.lit("1h")).withColumn("trending_up", F.lit(True))
    return rounded(ingest.merge_deltas(existing, d).select("symbol", "window_start", "delta", "delta_pct", "trending_up", "window_label"), 4)


def merge_symbols(spark, sf_dir):
    t = ticks(spark, sf_dir)
    return ingest.merge_symbols(market.list_symbols(t.where("symbol < 'S4'")), t)


def filter_ticks(spark, sf_dir):
    return rounded(ingest.filter_ticks(ticks(spark, sf_dir), "s4", "2024-01-05", "2024-01-09").select("id", "symbol", "price", "fetched_at"))


def news_rows(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 28).cast("int")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return d.select(F.substring("text", 1, 40).alias("title"), F.concat(F.lit("https://news.example.com/"), F.col("doc_id")).alias("url"), F.upper("source").alias("source"), day.alias("published_at"), F.when(F.col("doc_id") % 7 != 0, day).alias("fetched_at"), F.col("text").alias("content"))


def filter_news(spark, sf_dir):
    feed = news.news_feed(news_rows(spark, sf_dir))
    return news.filter_news(feed, search="IDIOT", date_from="2024-01-03", date_to="2024-01-20").select("link", "section", "timestamp", "scraped_at")


def news_stats(spark, sf_dir):
    return news.news_stats(news.news_feed(news_rows(spark, sf_dir)), AS_OF[:8] + "05")


def article_links(spark, sf_dir):
    return page_source.extract_article_links(table(spark, sf_dir, "pages"))


def news_pages(spark, sf_dir):
    out = page_source.extract_news_page(table(spark, sf_dir, "pages"))
    return out.select("page_id", "title", F.length("content").alias("n_chars"), F.sha2("content", 256).alias("content_sha256"))


def forest_verdict(spark, sf_dir):
    rows = indicators.technical_features(indicators.next_up_target(ticks(spark, sf_dir)))
    fitted, _ = models.train_forest(rows)
    return rounded(models.prediction_verdict(models.predict_direction(fitted.model, ticks(spark, sf_dir), 20)))


QUERIES = {
    f.__name__: f
    for f in (clean_text, article_id, url_sources, normalize_tick, split_valid_counts, merge_ticks, upsert_ticks, merge_deltas, merge_symbols, filter_ticks, filter_news, news_stats, article_links, news_pages, forest_verdict)
}

ORACLE_SQL = {
    "clean_text": r"SELECT doc_id, trim(regexp_replace(text, '[\t-\r \x{85}\p{Z}]+', ' ', 'g')) AS text FROM documents",
    "article_id": sql("""
, x AS (SELECT id AS tick, url, name, symbol, strftime(fetched_at, '%Y-%m-%d %H:%M:%S') AS stamp FROM ticks)
SELECT tick, sha1(url || name) AS url_title, sha1('{"fetched_at": "' || stamp || '", "name": "' || name || '", "published_at": "' || stamp || '", "symbol": "' || symbol || '", "title": "' || name || '", "url": "' || url || '"}') AS json,
  sha256(url || '|' || symbol || '|' || name || '|' || stamp) AS listing, sha1(lower(trim(url)) || '|' || lower(trim(name))) AS folded FROM x"""),
    "url_sources": r"SELECT page_id, CASE WHEN lower(url) LIKE '%coinmarketcap%' THEN 'coinmarketcap' WHEN lower(url) LIKE '%coingecko%' THEN 'coingecko' WHEN lower(url) LIKE '%binance%' THEN 'binance' WHEN lower(url) LIKE '%crypto%' THEN 'crypto_news' ELSE regexp_extract(url, '^[^/]*/[^/]*/[^/]*') END AS source FROM pages",
    "normalize_tick": sql("""SELECT CAST(id AS VARCHAR) AS id, CASE WHEN id % 2 = 1 THEN name ELSE name || ' x' END AS name, symbol, round(price, 6) AS price, CAST(CAST(volume_24h AS INTEGER) AS DOUBLE) AS volume_24h, coin_circulating,
  strftime(fetched_at, '%Y-%m-%d') AS date FROM ticks WHERE id % 5 <> 0 AND price IS NOT NULL AND volume_24h IS NOT NULL"""),
    "split_valid_counts": sql("SELECT source, count(*) AS n_rows, min(CAST(id AS VARCHAR)) AS first_id, CASE WHEN id % 3 = 0 THEN 'rejected' ELSE 'valid' END AS side FROM ticks GROUP BY 1, 4"),
    "merge_ticks": sql("SELECT id, symbol, round(price, 6) AS price, fetched_at FROM ticks WHERE id % 2 = 0 AND id % 3 <> 0 AND volume_24h IS NOT NULL"),
    "upsert_ticks": sql("SELECT id, round(CASE WHEN id % 10 = 0 AND volume_24h IS NOT NULL THEN price + 1 ELSE price END, 6) AS price, CASE WHEN id % 10 = 0 AND volume_24h IS NOT NULL THEN fetched_at + INTERVAL 1 HOUR ELSE fetched_at END AS fetched_at FROM ticks"),
    "merge_deltas": sql(DELTAS_SQL + """ SELECT symbol, window_start, round(delta, 4) AS delta, round(delta_pct, 4) AS delta_pct, CASE WHEN coalesce(delta <> 0 AND delta_pct <> 0, false) THEN coalesce(delta_pct > 50, false) ELSE true END AS trending_up, '1h' AS window_label
  FROM d WHERE hour(window_start) < 12 OR (delta <> 0 AND delta_pct <> 0)"""),
    "merge_symbols": sql("SELECT DISTINCT symbol FROM ticks"),
    "filter_ticks": sql("SELECT id, symbol, round(price, 6) AS price, fetched_at FROM ticks WHERE symbol = 'S4' AND CAST(fetched_at AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-09'"),
    "filter_news": r"""SELECT 'https://news.example.com/' || doc_id AS link, lower(source) AS section, stamp AS timestamp, CASE WHEN doc_id % 7 <> 0 THEN stamp ELSE '' END AS scraped_at
  FROM (SELECT *, strftime(DATE '2024-01-01' + CAST(doc_id % 28 AS INTEGER), '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM documents) WHERE trim(text) <> '' AND lower(text) LIKE '%idiot%' AND stamp >= '2024-01-03' AND stamp < '2024-01-21'""",
    "news_stats": "SELECT count(*) AS total, count(*) FILTER (WHERE doc_id % 28 = 4) AS today, count(DISTINCT lower(source)) AS sections FROM documents WHERE trim(text) <> ''",
    "news_pages": r"""
WITH p AS (SELECT page_id, regexp_extract(html, '(?is)<h1\b[^>]*>(.*?)</h1>', 1) AS h1, regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title>', 1) AS title, regexp_extract_all(html, '(?is)<article\b[^>]*>(.*?)</article>', 1) AS articles, html FROM pages),
b AS (SELECT *, regexp_extract_all(CASE WHEN len(articles) > 0 THEN array_to_string(articles, '<end>') ELSE html END, '(?i)<(?:p|h2|h3|blockquote)(?: [^>]*)?>([^<]+)', 1) AS texts FROM p),
t AS (SELECT page_id, i, regexp_replace(replace(replace(texts[i], '&quot;', '"'), '&amp;', '&'), '^[\s\x{85}\p{Z}]+|[\s\x{85}\p{Z}]+$', '', 'g') AS text FROM b, unnest(range(1, len(texts) + 1)) AS u(i)),
c AS (SELECT page_id, string_agg(text, chr(10) ORDER BY i) AS content FROM t WHERE text <> '' GROUP BY 1),
n AS (SELECT page_id, trim(regexp_replace(regexp_replace(h1, '(?s)<[^>]+>', ' ', 'g'), '[\t-\r \x{85}\p{Z}]+', ' ', 'g')) AS h1, trim(regexp_replace(regexp_replace(title, '(?s)<[^>]+>', ' ', 'g'), '[\t-\r \x{85}\p{Z}]+', ' ', 'g')) AS title FROM p)
SELECT page_id, coalesce(nullif(h1, ''), nullif(title, '')) AS title, length(coalesce(content, '')) AS n_chars, sha256(coalesce(content, '')) AS content_sha256 FROM n LEFT JOIN c USING (page_id)""",
    "article_links": r"""
WITH h AS (SELECT url, unnest(regexp_extract_all(html, '(?i)<a\b[^>]*?href=["'']([^"''#]+)', 1)) AS href FROM pages),
l AS (SELECT url, CASE WHEN regexp_matches(href, '(?i)^https?://') THEN href WHEN href LIKE '//%' THEN split_part(url, ':', 1) || ':' || href WHEN href LIKE '/%' THEN regexp_extract(url, '^(https?://[^/?#]+)', 1) || href END AS link FROM h)
SELECT DISTINCT url, trim(link) AS link FROM l WHERE link IS NOT NULL AND link NOT LIKE '%/tag/%'""",
}
