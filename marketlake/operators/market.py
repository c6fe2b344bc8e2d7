"""Movers, overview, trending and market totals over ticks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import percent, source_of_url, symbol_key
from .series import rolling

#: The symbols of the overview.
MAJOR = ("BTC", "ETH", "SOL", "ADA", "DOT", "AVAX")


def _newest():
    return F.struct("fetched_at", "id")


def latest_per_symbol(ticks: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Each symbol's newest row; a maximum that is taken before the shuffle, no sort."""
    columns = [c for c in (columns or ticks.columns) if c != "symbol"]
    return ticks.groupBy("symbol").agg(F.max_by(F.struct(*columns), _newest()).alias("r")).select("symbol", "r.*")


def price_moves(ticks: DataFrame) -> DataFrame:
    """prev_price and pct against the symbol's previous row: 0 for the first, null where that price is 0."""

    def compute(df: DataFrame, w) -> DataFrame:
        return df.withColumn("prev_price", F.lag("price").over(w))

    out = rolling(ticks.where("price IS NOT NULL"), 1, compute)
    previous = F.col("prev_price")
    return out.withColumn("pct", F.when(previous.isNull(), 0.0).otherwise(percent(F.col("price") - previous, previous))).drop("_i")


def _movers(ticks: DataFrame, k: int, up: bool) -> DataFrame:
    moved = price_moves(ticks).where(F.col("pct") > 0 if up else F.col("pct") < 0)
    best = latest_per_symbol(moved, ["name", "price", "prev_price", "pct", "market_cap", "volume_24h", "fetched_at"])
    return best.orderBy(F.desc("pct") if up else F.asc("pct"), "symbol").limit(k)


def top_gainers(ticks: DataFrame, k: int = 10) -> DataFrame:
    """Each symbol's last rise, not its last move; the k largest."""
    return _movers(ticks, k, True)


def top_losers(ticks: DataFrame, k: int = 10) -> DataFrame:
    return _movers(ticks, k, False)


def movers_summary(movers: DataFrame) -> DataFrame:
    """Best and worst of the given movers, their summed cap and mean change."""
    return movers.agg(F.max_by("symbol", F.struct("pct", "symbol")).alias("best_symbol"), F.max("pct").alias("best_pct"), F.min_by("symbol", F.struct("pct", "symbol")).alias("worst_symbol"), F.min("pct").alias("worst_pct"), F.sum("market_cap").alias("total_market_cap"), F.avg("pct").alias("avg_pct"))


def market_overview(ticks: DataFrame, deltas: DataFrame, symbols: Iterable[str] = MAJOR, label: str = "1d") -> DataFrame:
    """Newest tick of each major symbol with its newest delta of the label, 0 where there is none; by cap."""
    wanted = [s.upper() for s in symbols]
    now = latest_per_symbol(ticks.where(F.upper("symbol").isin(wanted)), ["name", "price", "market_cap", "volume_24h", "fetched_at"])
    change = deltas.where((F.col("window_label") == label) & F.upper("symbol").isin(wanted)).groupBy("symbol").agg(F.max_by("delta_pct", "window_start").alias("delta_pct"))
    return now.join(change, "symbol", "left").withColumn("delta_pct", F.coalesce("delta_pct", F.lit(0.0))).orderBy(F.desc("market_cap"), "symbol")


def total_market_cap(ticks: DataFrame) -> DataFrame:
    """Sum of each symbol's newest known cap."""
    newest = ticks.where("market_cap IS NOT NULL").groupBy("symbol").agg(F.max_by("market_cap", _newest()).alias("cap"))
    return newest.agg(F.sum("cap").alias("total_market_cap"), F.count("*").alias("symbols"))


def market_stats(ticks: DataFrame, as_of: str, approximate: bool = False) -> DataFrame:
    """Sources, symbols, and rows today, yesterday, this month and in all, in one pass."""
    day, now = F.to_date("fetched_at"), F.to_date(F.lit(as_of).cast("timestamp"))
    distinct = F.approx_count_distinct if approximate else F.countDistinct
    out = ticks.agg(
        distinct(source_of_url("url")).alias("sources"), distinct(symbol_key()).alias("symbols"), F.count("*").alias("total"),
        F.count_if(day == now).alias("today"), F.count_if(day == F.date_sub(now, 1)).alias("yesterday"), F.count_if(F.trunc(day, "month") == F.trunc(now, "month")).alias("this_month"),
    )
    today, before = F.col("today"), F.col("yesterday")
    return out.withColumn("change_pct", F.when(before > 0, (today - before) * 100 / F.when(before > 0, before)).when(today > 0, 100.0).otherwise(0.0))


def trending_symbols(ticks: DataFrame, as_of: str, hours: int = 24, limit: int = 20) -> DataFrame:
    """Rows per symbol in the last and the previous ``hours``, in one pass over both."""
    end = F.lit(as_of).cast("timestamp")
    step = F.make_interval(hours=F.lit(hours))
    at, key = F.col("fetched_at").cast("timestamp"), symbol_key()
    both = ticks.where((at >= end - step - step) & (at < end) & key.isNotNull())
    counts = both.groupBy(key.alias("source")).agg(F.count_if(at >= end - step).alias("value"), F.count_if(at < end - step).alias("previous"))
    counts = counts.withColumn("delta", F.col("value") - F.col("previous"))
    pct = F.when(F.col("previous") == 0, 100.0).otherwise(F.try_divide("delta", "previous") * 100)
    return counts.withColumn("delta_pct", pct).orderBy(F.abs("delta_pct").desc(), F.desc("value"), "source").limit(limit)


def trending_between(trending: DataFrame, label: str, start: str, end: str, k: int = 20) -> DataFrame:
    inside = (F.col("window_label") == label) & F.col("as_of").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))
    return trending.where(inside).orderBy(F.desc_nulls_last("delta_pct"), F.desc("value"), "source", "as_of").limit(k)


def latest_row(df: DataFrame, time: str = "fetched_at") -> DataFrame:
    return df.orderBy(F.desc(time), F.desc("id")).limit(1)


def last_n_per_symbol(df: DataFrame, n: int, order: tuple[str, ...] = ("fetched_at", "id")) -> DataFrame:
    """The last n rows of each series: the last n of each day first, then of those."""
    newest = [F.desc(c) for c in order]
    by_day = F.row_number().over(Window.partitionBy("symbol", F.date_trunc("day", F.col(order[0]))).orderBy(*newest))
    few = df.withColumn("_rank", by_day).where(F.col("_rank") <= n)
    return few.withColumn("_rank", F.row_number().over(Window.partitionBy("symbol").orderBy(*newest))).where(F.col("_rank") <= n).drop("_rank")


def list_symbols(ticks: DataFrame) -> DataFrame:
    return ticks.select(symbol_key().alias("symbol")).where("symbol IS NOT NULL").distinct()


def table_profile(ticks: DataFrame) -> DataFrame:
    return ticks.agg(
        F.count("*").alias("n_rows"), F.countDistinct("symbol").alias("n_symbols"), F.countDistinct(F.to_date("fetched_at")).alias("n_dates"),
        F.count("price").alias("with_price"), F.count("volume_24h").alias("with_volume"), F.min("fetched_at").alias("first_ts"), F.max("fetched_at").alias("last_ts"),
    )


def symbol_presence_by_file(lake: DataFrame, needles: Iterable[str] = ("BTC", "ETH")) -> DataFrame:
    """For each file: does any symbol contain each of the needles, and all of them."""
    needles = list(needles)
    name = F.upper("symbol")
    found = lake.groupBy(F.col("_metadata.file_path").alias("file")).agg(*(F.coalesce(F.bool_or(name.contains(n)), F.lit(False)).alias(f"has_{n.lower()}") for n in needles))
    every = F.col(f"has_{needles[0].lower()}")
    for n in needles[1:]:
        every = every & F.col(f"has_{n.lower()}")
    return found.withColumn("has_all", every)


def presence_totals(by_file: DataFrame) -> DataFrame:
    return by_file.agg(F.count("*").alias("files"), *(F.count_if(c).alias(c) for c in by_file.columns if c.startswith("has_")))


def market_home(ticks: DataFrame, deltas: DataFrame, as_of: str, k: int = 5, symbols: Iterable[str] = MAJOR) -> dict[str, DataFrame]:
    """The dashboard's frames."""
    gainers, losers = top_gainers(ticks, k), top_losers(ticks, k)
    return {
        "overview": market_overview(ticks, deltas, symbols), "stats": market_stats(ticks, as_of), "cap": total_market_cap(ticks),
        "gainers": gainers, "losers": losers, "gainers_summary": movers_summary(gainers), "losers_summary": movers_summary(losers),
    }
