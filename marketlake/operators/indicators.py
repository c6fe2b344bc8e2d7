"""Technical indicators: RSI, volatility, moving averages, model features and signals."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.exprs import finite_or_zero, ieee_div, percent
from ..sources.shared import stored
from . import ema
from .series import BLOCK_ROWS, indexed, last, rolling, run_sums


def priced(ticks: DataFrame) -> DataFrame:
    return ticks.where(F.col("price").isNotNull())


def _full(c: Column, w: WindowSpec, period: int, f=F.avg) -> Column:
    """f over the last ``period`` rows, null until all of them hold a value."""
    frame = last(w, period)
    return F.when(F.count(c).over(frame) >= period, f(c).over(frame))


def build_rsi(ticks: DataFrame, period: int = 14) -> DataFrame:
    """Gain, loss, their simple means over ``period`` rows, rs, rsi, signal, strength and momentum.

    The first row's gain and loss are 0, so the first RSI stands at row ``period``.
    No loss gives 100; neither gain nor loss gives NaN, which compares above all.
    """

    def compute(df: DataFrame, w: WindowSpec) -> DataFrame:
        change = F.col("price") - F.lag("price").over(w)
        df = df.withColumn("gain", F.when(change > 0, change).otherwise(0.0)).withColumn("loss", F.when(change < 0, -change).otherwise(0.0))
        df = df.withColumn("avg_gain", _full(F.col("gain"), w, period)).withColumn("avg_loss", _full(F.col("loss"), w, period))
        df = df.withColumn("rs", ieee_div(F.col("avg_gain"), F.col("avg_loss"))).withColumn("rsi", 100 - 100 / (1 + F.col("rs")))
        return df.withColumn("rsi_momentum", F.col("rsi") - F.lag("rsi").over(w))

    rsi = F.col("rsi")
    # fixed values: zones and their labels
    signal = F.when(rsi >= 70, "overbought").when(rsi <= 30, "oversold").otherwise("neutral")
    strength = F.when(rsi >= 80, "very_strong_buy").when(rsi >= 70, "strong_buy").when(rsi >= 50, "bullish").when(rsi >= 30, "bearish").when(rsi >= 20, "strong_sell").otherwise("very_strong_sell")
    out = rolling(priced(ticks), period + 2, compute)
    return out.withColumns({"rsi_signal": signal, "rsi_strength": strength, "rsi_period": F.lit(period)})


def build_volatility(ticks: DataFrame, period: int = 14) -> DataFrame:
    """Percent change and log return, their rolling deviations, z-score, category and extreme flag.

    The category compares with the symbol's own quartiles of the deviation (nearest rank).
    """

    def compute(df: DataFrame, w: WindowSpec) -> DataFrame:
        previous = F.lag("price").over(w)
        df = df.withColumn("price_change_pct", percent(F.col("price") - previous, previous))
        df = df.withColumn("log_returns", F.when((F.col("price") > 0) & (previous > 0), F.ln("price") - F.ln(previous)))
        df = df.withColumn("price_volatility_std", _full(F.col("price_change_pct"), w, period, F.stddev_samp))
        df = df.withColumn("log_returns_std", _full(F.col("log_returns"), w, period, F.stddev_samp))
        return df.withColumn("price_change_mean", _full(F.col("price_change_pct"), w, period))

    out = rolling(priced(ticks), period + 1, compute)
    std = F.col("price_volatility_std")
    out = stored(out.withColumn("price_change_zscore", F.when(std > 0, (F.col("price_change_pct") - F.col("price_change_mean")) / std)), "volatility")
    limits = quartiles(out, "price_volatility_std")
    out = out.join(limits, "symbol", "left")
    category = F.when(std > F.col("q75"), "high").when(std > F.col("q25"), "medium").when(std.isNotNull(), "low")
    extreme = F.coalesce(F.abs("price_change_zscore") > 2, F.lit(False))
    return out.withColumns({"volatility_category": category, "extreme_movement": extreme, "period": F.lit(period)}).drop("q25", "q75")


#: Approximate quantiles are this exact: ranks are off by a part in so many at most.
ACCURACY = 10_000


def quartiles(df: DataFrame, value: str, by: str = "symbol") -> DataFrame:
    """q25 and q75 per group: the element at floor((n - 1) q + 0.5) of the sorted values.

    In groups of more than ACCURACY values, approximate quantiles on either side
    enclose each of the two elements.  What lies outside is only counted, so a few
    parts in ACCURACY of a group are ranked, and equal values once.  Two passes
    over ``df``.
    """
    rows = df.where(F.col(value).isNotNull()).select(by, F.col(value).alias("v"))
    slack = 2 / ACCURACY
    near = F.percentile_approx("v", [0.25 - slack, 0.25 + slack, 0.75 - slack, 0.75 + slack], ACCURACY)
    ends = rows.groupBy(by).agg(near.alias("near"), F.count("*").alias("n"))
    low, high, low3, high3 = (F.col("near")[i] for i in range(4))
    v, inf = F.col("v"), F.lit(float("inf"))
    cell = F.when(F.col("n") <= ACCURACY, v).when(v < low, -inf).when(v <= high, v).when(v < low3, high).when(v <= high3, v).otherwise(inf)
    counted = rows.join(ends, by).select(by, "n", cell.alias("v")).groupBy(by, "v").agg(F.max("n").alias("n"), F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(by).orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    index = lambda q: F.floor((F.col("n") - 1) * q + 0.5)
    pick = lambda q: F.min(F.when(F.col("upto") > index(q), F.col("v")))
    return counted.withColumn("upto", upto).groupBy(by).agg(pick(0.25).alias("q25"), pick(0.75).alias("q75"))


def _weighted(w: WindowSpec, value: str, n: int) -> Column:
    """Mean of the last n values with weights 1 to n."""
    total = sum((F.lag(value, n - i).over(w) if n > i else F.col(value)) * i for i in range(1, n + 1))
    return F.when(F.count(value).over(last(w, n)) >= n, total / (n * (n + 1) / 2))


def with_averages(df: DataFrame, window: int, types: Iterable[str] = ("sma", "wma", "ema"), seed: str = "sma", value: str = "price", order: tuple[str, ...] = ("fetched_at", "id")) -> DataFrame:
    """Add sma, wma and ema of the last ``window`` values, null before there are as many."""
    types = list(types)
    unknown = set(types) - {"sma", "wma", "ema"}
    if unknown or window < 1:
        raise ValueError(f"no averages {sorted(unknown)} over {window} rows")

    def compute(rows: DataFrame, w: WindowSpec) -> DataFrame:
        if "sma" in types:
            rows = rows.withColumn("sma", _full(F.col(value), w, window))
        if "wma" in types:
            rows = rows.withColumn("wma", _weighted(w, value, window))
        return ema.in_block(rows, {"ema": window}, value, seed) if "ema" in types else rows

    if seed not in ("first", "sma"):
        raise ValueError(f"no seed {seed!r}")
    reach = max(window, ema.lookback(window) if "ema" in types else 0)
    return rolling(indexed(df.where(F.col(value).isNotNull()), order), reach, compute, block_rows=max(BLOCK_ROWS, reach))


def moving_averages(bucketed: DataFrame, window: int, types: Iterable[str] = ("sma", "wma", "ema"), places: int = 4) -> DataFrame:
    """symbol, t, price and the averages, to ``places``, from the window-th point on; ema starts at the first mean."""
    out = with_averages(bucketed, window, types, "sma", order=("t", "price"))
    return out.where(F.col("_i") >= window - 1).withColumns({t: F.round(t, places) for t in types}).drop("_i")


def build_moving_averages(ticks: DataFrame, window: int, types: Iterable[str] = ("sma", "ema")) -> DataFrame:
    """Averages of the tick prices; ema starts at the first price."""
    out = with_averages(ticks, window, types, "first")
    return out.withColumns({"ma_window": F.lit(window), "ma_types": F.lit(",".join(types))}).drop("_i")


#: The names of the model's columns.
FEATURES = [
    "price", "volume_24h", "market_cap", "coin_circulating", "price_ma_5", "price_ma_10", "price_ma_20", "price_ma_50", "volume_ma_5", "volume_ma_20",
    "price_change_1", "price_change_5", "price_change_10", "volume_change", "rsi", "macd", "macd_signal", "macd_diff", "bb_position", "volatility",
    "price_to_ma5", "price_to_ma20", "volume_ratio",
]


def technical_features(ticks: DataFrame) -> DataFrame:
    """The model's FEATURES for every priced tick; windows may be partial, and what isn't finite is 0."""

    def compute(df: DataFrame, w: WindowSpec) -> DataFrame:
        mean = lambda c, n: F.avg(c).over(last(w, n))
        change = lambda c, n: ieee_div(F.col(c) - F.lag(c, n).over(w), F.lag(c, n).over(w))
        df = df.withColumns({f"price_ma_{n}": mean("price", n) for n in (5, 10, 20, 50)} | {f"volume_ma_{n}": mean("volume_24h", n) for n in (5, 20)})
        df = df.withColumns({f"price_change_{n}": change("price", n) for n in (1, 5, 10)} | {"volume_change": change("volume_24h", 1)})
        step = F.col("price") - F.lag("price").over(w)
        df = df.withColumns({"_gain": F.when(step > 0, step).otherwise(0.0), "_loss": F.when(step < 0, -step).otherwise(0.0)})
        gain, loss = F.avg("_gain").over(last(w, 14)), F.avg("_loss").over(last(w, 14))
        df = ema.in_block(df, {"ema_12": 12, "ema_26": 26}, "price").withColumn("macd", F.col("ema_12") - F.col("ema_26"))
        df = ema.in_block(df, {"macd_signal": 9}, "macd")
        df = df.withColumn("rsi", F.coalesce(100 - 100 / (1 + F.try_divide(gain, loss)), F.lit(50.0)))
        return df.withColumns({"bb_std": F.stddev_samp("price").over(last(w, 20)), "volatility": F.stddev_samp("price").over(last(w, 10))}).drop("_gain", "_loss")

    out = rolling(indexed(priced(ticks)), ema.lookback(26, 9), compute).withColumn("macd_diff", F.col("macd") - F.col("macd_signal"))
    lower, upper = F.col("price_ma_20") - 2 * F.col("bb_std"), F.col("price_ma_20") + 2 * F.col("bb_std")
    out = out.withColumns({
        "bb_middle": F.col("price_ma_20"), "bb_upper": upper, "bb_lower": lower, "bb_position": F.try_divide(F.col("price") - lower, upper - lower),
        "price_to_ma5": F.try_divide("price", "price_ma_5"), "price_to_ma20": F.try_divide("price", "price_ma_20"), "volume_ratio": F.try_divide("volume_24h", "volume_ma_5"),
    })
    return out.withColumns({c: finite_or_zero(F.col(c).cast("double")) for c in [*FEATURES, "bb_middle", "bb_std", "bb_upper", "bb_lower", "ema_12", "ema_26"]})


def next_up_target(ticks: DataFrame, keep_last: bool = True) -> DataFrame:
    """target 1 where the symbol's next price is higher; its last row has none and counts as 0, or goes."""

    def compute(df: DataFrame, w: WindowSpec) -> DataFrame:
        return df.withColumn("price_next", F.lead("price").over(w))

    out = rolling(priced(ticks), 0, compute, lookahead=1)
    out = out if keep_last else out.where("price_next IS NOT NULL")
    return out.withColumn("target", F.coalesce((F.col("price_next") > F.col("price")).cast("int"), F.lit(0)))


def ma_signals(ticks: DataFrame, rsi_period: int = 14) -> DataFrame:
    """Flags of averages that cross, support and resistance at the 20-row mean, alignment, and RSI leaving its zones."""

    def compute(df: DataFrame, w: WindowSpec) -> DataFrame:
        # means that are equal but for the last bit decide flags: the order of the additions is part of the result
        df = run_sums(df, w, "price", {f"ma_{n}": n for n in (5, 20, 50, 200)})
        df = df.withColumns({f"ma_{n}": F.when(F.col("_i") >= n - 1, F.col(f"ma_{n}") / n) for n in (5, 20, 50, 200)})
        before, mean_before = F.lag("price").over(w), F.lag("ma_20").over(w)
        price, m20, m50, m200 = (F.col(c) for c in ("price", "ma_20", "ma_50", "ma_200"))
        flag = lambda c: F.coalesce(c, F.lit(False))
        df = df.withColumns({
            "ma_cross_flag": flag(F.col("ma_5") > m20).cast("int"),
            "is_support": flag((price < m20) & (before > mean_before)), "is_resistance": flag((price > m20) & (before < mean_before)),
            "bullish": flag((price > m20) & (m20 > m50) & (m50 > m200)), "bearish": flag((price < m20) & (m20 < m50) & (m50 < m200)),
        })
        change = price - before
        df = df.withColumns({"_gain": F.when(change > 0, change).otherwise(0.0), "_loss": F.when(change < 0, -change).otherwise(0.0)})
        rs = ieee_div(_full(F.col("_gain"), w, rsi_period), _full(F.col("_loss"), w, rsi_period))
        df = df.withColumn("rsi", 100 - 100 / (1 + rs))
        rsi, rsi_before = F.col("rsi"), F.lag("rsi").over(w)
        leaves = F.when((rsi_before <= 30) & (rsi > 30), "buy").when((rsi_before >= 70) & (rsi < 70), "sell").otherwise("none")
        df = ema.in_block(df, {"ema_10": 10, "ema_50": 50}, "price")
        df = df.withColumn("signal", (F.col("ema_10") > F.col("ema_50")).cast("int"))
        crossover = F.coalesce(F.col("signal") != F.lag("signal").over(w), F.lit(False))
        return df.withColumns({"rsi_exit": leaves, "crossover": crossover}).drop("_gain", "_loss")

    return rolling(indexed(priced(ticks)), ema.lookback(50), compute)


def rsi_summary(rsi: DataFrame) -> DataFrame:
    """Per symbol: mean, extremes, deviation, zone counts, commonest signal (smallest of ties) and rows."""
    number = F.when(~F.isnan("rsi"), F.col("rsi"))
    return rsi.where("rsi IS NOT NULL").groupBy("symbol").agg(
        F.avg("rsi").alias("avg_rsi"), F.max(number).alias("max_rsi"), F.min(number).alias("min_rsi"), F.stddev_samp("rsi").alias("rsi_volatility"),
        F.count_if(F.col("rsi_signal") == "overbought").alias("overbought_periods"), F.count_if(F.col("rsi_signal") == "oversold").alias("oversold_periods"),
        F.mode("rsi_signal", True).alias("dominant_signal"), F.count("*").alias("data_points"),
    ).orderBy(F.desc("avg_rsi"), "symbol")


def volatility_summary(volatility: DataFrame) -> DataFrame:
    return volatility.where("price_volatility_std IS NOT NULL").groupBy("symbol").agg(
        F.avg("price_volatility_std").alias("avg_volatility"), F.max("price_volatility_std").alias("max_volatility"), F.min("price_volatility_std").alias("min_volatility"),
        F.count_if("extreme_movement").alias("extreme_movements"), F.mode("volatility_category", True).alias("dominant_category"), F.count("*").alias("data_points"),
    ).orderBy(F.desc("avg_volatility"), "symbol")


def latest_with(df: DataFrame, indicator: str, columns: list[str]) -> DataFrame:
    """Each symbol's last row by time whose ``indicator`` isn't null."""
    best = F.max_by(F.struct(*columns), F.struct("fetched_at", "id")).alias("r")
    return df.where(F.col(indicator).isNotNull()).groupBy("symbol").agg(best).select("symbol", "r.*")


def latest_rsi(rsi: DataFrame) -> DataFrame:
    return latest_with(rsi, "rsi", ["fetched_at", "price", "rsi", "rsi_signal", "rsi_strength", "rsi_momentum"])


def latest_volatility(volatility: DataFrame) -> DataFrame:
    return latest_with(volatility, "price_volatility_std", ["fetched_at", "price", "price_volatility_std", "price_change_zscore", "volatility_category", "extreme_movement"])


def symbol_series(df: DataFrame, symbol: str, indicator: str) -> DataFrame:
    """One symbol's ordered rows that have the indicator."""
    return df.where((F.upper("symbol") == symbol.upper()) & F.col(indicator).isNotNull()).orderBy("fetched_at", "id")


def symbol_rsi_series(ticks: DataFrame, symbol: str, period: int = 14) -> DataFrame:
    return symbol_series(build_rsi(ticks.where(F.upper("symbol") == symbol.upper()), period), symbol, "rsi")


def symbol_volatility_series(ticks: DataFrame, symbol: str, period: int = 14) -> DataFrame:
    return symbol_series(build_volatility(ticks.where(F.upper("symbol") == symbol.upper()), period), symbol, "price_volatility_std")


def series_status(found: DataFrame, period: int) -> DataFrame:
    """Points, time range and status ("insufficient data" below ``period`` points) of an indicator series."""
    n = F.count("*")
    return found.agg(n.alias("total_points"), F.min("fetched_at").alias("first_ts"), F.max("fetched_at").alias("last_ts"), F.when(n < period, "insufficient data").otherwise("ok").alias("status"))


