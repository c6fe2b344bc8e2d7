"""Counts, buckets and daily marts over articles and ticks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import percent
from ..sources import dated

MOST_DAYS = 180


def _at(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def timeseries_count(df: DataFrame, start: str, end: str, bucket: str = "hour", time: str = "ts") -> DataFrame:
    """Rows per hour or day, both ends included; no more than 180 days."""
    import datetime

    if bucket not in ("hour", "day"):
        raise ValueError("bucket is hour or day")
    if datetime.datetime.fromisoformat(end) - datetime.datetime.fromisoformat(start) > datetime.timedelta(days=MOST_DAYS):
        raise ValueError(f"more than {MOST_DAYS} days")
    inside = df.where(F.col(time).between(_at(start), _at(end)))
    return inside.groupBy(F.date_trunc(bucket, F.col(time)).alias("bucket")).agg(F.count("*").alias("value")).orderBy("bucket")


def top_sources(df: DataFrame, start: str, end: str, limit: int = 10, time: str = "ts") -> DataFrame:
    """Rows per source from ``start`` to before ``end``."""
    inside = df.where((F.col(time) >= _at(start)) & (F.col(time) < _at(end)) & F.col("source").isNotNull())
    return inside.groupBy("source").agg(F.count("*").alias("value")).orderBy(F.desc("value"), "source").limit(limit)


def period_aggregate(df: DataFrame, start: str, end: str, time: str = "fetched_at") -> dict[str, DataFrame]:
    """by_source: oldest and newest row of each source; by_symbol: rows and mean price; both ends included."""
    inside = df.where(F.col(time).between(_at(start), _at(end)))
    place, row = F.struct(time, "id"), F.struct("id", time, "price")
    sources = inside.groupBy("source").agg(F.min_by(row, place).alias("o"), F.max_by(row, place).alias("n"), F.count("*").alias("n_rows"))
    by_source = sources.select("source", "n_rows", *(F.col(f"{s}.{c}").alias(f"{name}_{c}") for s, name in (("o", "oldest"), ("n", "newest")) for c in ("id", time, "price")))
    by_symbol = inside.where("symbol IS NOT NULL").groupBy("symbol").agg(F.count("*").alias("n_rows"), F.avg("price").alias("avg_price"))
    return {"by_source": by_source, "by_symbol": by_symbol}


def availability(ticks: DataFrame, symbol: str | None = None, min_points: int = 0, usable: bool = False) -> DataFrame:
    """Rows, first and last time per symbol with more than ``min_points``; ``usable`` counts rows with price and volume."""
    rows = ticks.where("price IS NOT NULL AND volume_24h IS NOT NULL") if usable else ticks
    rows = rows if symbol is None else rows.where(F.upper("symbol") == symbol.upper())
    out = rows.groupBy("symbol").agg(F.count("*").alias("points"), F.min("fetched_at").alias("first_ts"), F.max("fetched_at").alias("last_ts"))
    return out.where(F.col("points") > min_points).orderBy(F.desc("points"), "symbol")


def daily_windows(articles: DataFrame) -> DataFrame:
    start = F.date_trunc("day", F.col("ts"))
    return articles.groupBy(start.alias("window_start")).agg(F.count("*").alias("value")).withColumn("window_end", F.col("window_start") + F.expr("INTERVAL 1 DAY"))


def daily_delta(articles: DataFrame) -> DataFrame:
    """Rows per present day, the difference from the one before (0 for the first) and its percent.

    The global order is over one row for each day.
    """
    w = Window.orderBy("date")
    days = articles.groupBy("date").agg(F.count("*").alias("value"))
    days = days.withColumn("previous", F.lag("value").over(w))
    delta = F.col("value") - F.col("previous")
    return days.select("date", "value", F.coalesce(delta, F.lit(0)).alias("delta"), percent(delta, F.col("previous")).alias("delta_pct"))


def sources_daily(articles: DataFrame) -> DataFrame:
    return articles.groupBy("date", "source").agg(F.count("*").alias("value"))


def latest_snapshot(articles: DataFrame) -> DataFrame:
    """Rows and newest time per source (null is a source), and a total row."""
    rolled = articles.rollup("source").agg(F.grouping("source").alias("g"), F.count("*").alias("count"), F.max("ts").alias("updated_at"))
    metric = F.when(F.col("g") == 1, "total").otherwise(F.concat(F.lit("source:"), F.coalesce("source", F.lit("unknown"))))
    return rolled.select(metric.alias("metric"), "count", "updated_at")


def daily_trending(articles: DataFrame, k: int = 10) -> DataFrame:
    """The k sources with most rows of each day."""
    w = Window.partitionBy("date").orderBy(F.desc("value"), "source")
    return sources_daily(articles).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def dedupe_latest(articles: DataFrame) -> DataFrame:
    """One row for each id, the newest; its date where that is missing.  A maximum, so no id's rows are sorted."""
    rest = [c for c in articles.columns if c != "id"]
    text = F.struct(*(F.col(c) for c in rest))
    out = articles.groupBy("id").agg(F.max_by(text, F.struct("ts", text)).alias("r")).select("id", "r.*")
    return out.withColumn("date", F.coalesce("date", F.to_date("ts"))).select(articles.columns)


def bucketed_price(ticks: DataFrame, bucket: str = "hour", start: str | None = None, end: str | None = None) -> DataFrame:
    """Mean price of each symbol and minute, hour or day."""
    rows = ticks.where("price IS NOT NULL")
    if start:
        rows = rows.where(F.col("fetched_at") >= _at(start))
    if end:
        rows = rows.where(F.col("fetched_at") <= _at(end))
    return rows.groupBy("symbol", F.date_trunc(bucket, F.col("fetched_at")).alias("t")).agg(F.avg("price").alias("price"))


def align_periods(a: DataFrame, b: DataFrame, bucket_a: str = "hour", bucket_b: str = "hour") -> DataFrame:
    """Two series (t, value) on one time line: by hour if either is; the last value of a bucket counts, 0 as absent."""
    bucket = "hour" if "hour" in (bucket_a, bucket_b) else "day"
    fold = lambda df, name: df.groupBy(F.date_trunc(bucket, F.col("t")).alias("t")).agg(F.nullif(F.max_by("value", F.struct("t", "value")), F.lit(0)).alias(name))
    return fold(a, "value_a").join(fold(b, "value_b"), "t", "full").orderBy("t")


def mart_frames(lake: DataFrame) -> dict[str, DataFrame]:
    return {"windowed": daily_windows(lake), "delta": daily_delta(lake), "sources_daily": sources_daily(lake), "trending": daily_trending(lake), "latest": latest_snapshot(lake)}


def refresh_marts(lake: DataFrame, out: str) -> dict[str, str]:
    """Dedupe once, then write every mart below ``out``; returns the paths.

    The deduplicated table is written too, so that the marts read it instead of
    deduplicating five times, and survive a lost executor.
    """
    spark = lake.sparkSession
    dedupe_latest(lake).write.mode("overwrite").parquet(f"{out}/articles")
    paths = {"articles": f"{out}/articles"}
    for name, frame in mart_frames(spark.read.parquet(paths["articles"])).items():
        paths[name] = f"{out}/{name}"
        frame.write.mode("overwrite").parquet(paths[name])
    return paths


#: Registers of a day's distinct sketch, as a power of two: the estimate's relative standard error is about 1.04 / 2 ** (LG_K / 2),
#: 0.8 %, so that an error of 5 % is more than six of them.  A sketch takes 16 KB at most, one of few ids less.
LG_K = 14


def daily_partials(articles: DataFrame) -> DataFrame:
    """date, source, n_articles, first_ts, last_ts and a sketch of the different ids of each day: what totals over any days are made of."""
    rows = articles.where("ts IS NOT NULL")
    return rows.groupBy(dated.date_of("ts").alias("date"), "source").agg(F.count("*").alias("n_articles"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.hll_sketch_agg(F.col("id").cast("string"), LG_K).alias("ids"))


def refresh_partials(articles: DataFrame, path: str) -> list[str]:
    """Store the partials of all days of ``articles`` in the place of those that were there; other days stay as they are."""
    return dated.merge_dated(daily_partials(articles), path, lambda existing, new: new)


def totals_of_days(partials: DataFrame, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """source, n_articles, first_ts, last_ts and about how many different ids, from the days' partials alone; dates included."""
    if date_from is not None:
        partials = partials.where(F.col("date") >= date_from)
    if date_to is not None:
        partials = partials.where(F.col("date") <= date_to)
    found = partials.groupBy("source").agg(F.sum("n_articles").alias("n_articles"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.hll_union_agg("ids").alias("ids"))
    return found.select("source", "n_articles", "first_ts", "last_ts", F.hll_sketch_estimate("ids").alias("about_ids"))
