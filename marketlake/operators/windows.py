"""Time windows per symbol and the price change from one window to the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import dated


def compute_window(ticks: DataFrame, every: str, period: str | None = None) -> DataFrame:
    """Rows and last price by time of each symbol's windows ``[start, start + period)``.

    Windows that begin before the first tick's own slot are left out.
    """
    period = period or every
    rows = ticks.where(F.col("fetched_at").isNotNull())
    last = F.max_by("price", F.struct("fetched_at", "id"))
    found = rows.groupBy("symbol", F.window("fetched_at", period, every).alias("w")).agg(F.count("*").alias("count"), last.alias("price"), F.min("fetched_at").alias("first_ts"))
    out = found.select("symbol", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "count", "price", "first_ts")
    if period != every:
        first = F.min("first_ts").over(Window.partitionBy("symbol"))
        # starts are whole slots, so those after the slot before the first tick's
        out = out.withColumn("first_ts", first).where(F.col("window_start") > F.col("first_ts") - F.expr(f"INTERVAL {every}"))
    return out.drop("first_ts")


def window_parts(ticks: DataFrame, every: str, batch: str) -> DataFrame:
    """What one batch of ticks adds to each window: rows, and the last row's time, id and price; with the batch's name and the window's date."""
    rows = ticks.where("fetched_at IS NOT NULL AND symbol IS NOT NULL")
    last = F.max(F.struct("fetched_at", "id", "price")).alias("last")
    found = rows.groupBy("symbol", F.window("fetched_at", every).alias("w")).agg(F.count("*").alias("count"), last)
    return found.select("symbol", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "count", "last", F.lit(batch).alias("batch"), dated.date_of("w.start").alias("date"))


def merge_window_parts(ticks: DataFrame, path: str, batch: str, every: str = "1 hour") -> list[str]:
    """Bring a batch, however late its rows, to the stored windows at ``path``; returns the dates written.

    A window is stored in parts, one for each batch that had rows of it, so a batch
    that comes again replaces its own part.  Only the dates of the batch's windows
    are read and written.
    """
    def merge(existing: DataFrame, new: DataFrame) -> DataFrame:
        return existing.where(F.col("batch") != batch).unionByName(new)

    return dated.merge_dated(window_parts(ticks, every, batch), path, merge)


def merged_windows(parts: DataFrame) -> DataFrame:
    """The windows of stored parts: rows and last price of each, as ``compute_window`` has them."""
    found = parts.groupBy("symbol", "window_start", "window_end").agg(F.sum("count").alias("count"), F.max("last").alias("last"))
    return found.select("symbol", "window_start", "window_end", "count", F.col("last.price").alias("price"))


def compute_delta(windows: DataFrame, threshold: float = 50.0) -> DataFrame:
    """Change from the symbol's previous present window; no percent where that price is null or 0."""
    w = Window.partitionBy("symbol").orderBy("window_start")
    return windows.select(
        "symbol", "window_start", "window_end", "price", F.lag("price").over(w).alias("prev_price"),
    ).withColumns({
        "delta": F.col("price") - F.col("prev_price"),
    }).withColumn(
        "delta_pct", F.try_divide(F.col("delta"), F.when(F.col("prev_price") != 0, F.col("prev_price"))) * 100,
    ).withColumn("trending_up", F.coalesce(F.col("delta_pct") > threshold, F.lit(False)))


def trending_changes(windows: DataFrame) -> DataFrame:
    """Change of the row count from the symbol's previous window, where there is one with rows."""
    w = Window.partitionBy("symbol").orderBy("window_start")
    rows = windows.withColumn("previous", F.lag("count").over(w)).withColumn("delta", F.col("count") - F.col("previous"))
    rows = rows.withColumn("delta_pct", F.try_divide(F.col("delta"), F.when(F.col("previous") != 0, F.col("previous"))) * 100).where("delta_pct IS NOT NULL")
    return rows.select(F.coalesce("symbol", F.lit("GLOBAL")).alias("source"), "window_start", "window_end", F.col("count").alias("value"), "delta", "delta_pct")


def trending_rank(windows: DataFrame, limit: int = 100) -> DataFrame:
    """The first ``limit`` changes, ranked densely by percent.

    Their rank needs those rows only, so the global order is over them.
    """
    top = trending_changes(windows).orderBy(F.desc("delta_pct"), F.desc("value"), "source", "window_start").limit(limit)
    return top.withColumn("rank", F.dense_rank().over(Window.orderBy(F.desc("delta_pct"))))
