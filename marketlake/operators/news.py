"""News lists: feed, filters and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import parse_flexible_utc


def news_feed(articles: DataFrame, limit: int | None = None) -> DataFrame:
    """title, link, section, timestamp, scraped_at, content of articles with content, newest first if limited."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    out = articles.where(F.trim(text("content")) != "").select(text("title").alias("title"), text("url").alias("link"), F.lower(text("source")).alias("section"), text("published_at").alias("timestamp"), text("fetched_at").alias("scraped_at"), text("content").alias("content"))
    return out if limit is None else out.orderBy(F.desc("timestamp"), "link").limit(limit)


def filter_news(news: DataFrame, section: str | None = None, since: str | None = None, search: str | None = None, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """By section, time and words; rows without a usable time stay within a range, whose end is a whole day."""
    at = parse_flexible_utc(F.coalesce(F.nullif("scraped_at", F.lit("")), F.col("timestamp")))
    if section:
        news = news.where(F.lower("section") == section.lower())
    if since:
        news = news.where(at >= F.lit(since).cast("timestamp"))
    if search and search.strip():
        word = search.strip().lower()
        news = news.where(F.lower("title").contains(word) | F.lower("content").contains(word))
    if date_from:
        news = news.where(at.isNull() | (at >= F.lit(date_from).cast("timestamp")))
    if date_to:
        news = news.where(at.isNull() | (at < F.date_add(F.lit(date_to).cast("date"), 1).cast("timestamp")))
    return news


def news_stats(news: DataFrame, as_of: str) -> DataFrame:
    """All articles, those of the day, and sections."""
    at = parse_flexible_utc(F.coalesce(F.nullif("scraped_at", F.lit("")), F.col("timestamp")))
    return news.agg(F.count("*").alias("total"), F.count_if(F.to_date(at) == F.lit(as_of).cast("date")).alias("today"), F.countDistinct("section").alias("sections"))


def news_sections(news: DataFrame) -> DataFrame:
    return news.select("section").where("section <> ''").distinct().orderBy("section")
