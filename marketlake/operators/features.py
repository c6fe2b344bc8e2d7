"""Measures of the ticks within windows, and rows for training."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import window_seconds
from ..sources.shared import stored
from . import ranges

MEASURES = ("price", "market_cap", "volume_24h", "coin_circulating")
KEY = ("symbol", "date_start", "date_end", "delta_pct")


def _ranges(deltas: DataFrame) -> DataFrame:
    """The windows with their ends as numbers."""
    return deltas.withColumns({"start": ranges.micros("date_start"), "stop": ranges.micros("date_end")})


def window_means(deltas: DataFrame, ticks: DataFrame, bucket_seconds: int = 3600) -> DataFrame:
    """symbol, start, stop, n_ticks and four means of the windows [date_start, date_end) with ticks."""
    rows = ticks.select("symbol", ranges.micros("fetched_at").alias("at"), *(F.col(c).cast("double").alias(c) for c in MEASURES))
    return ranges.range_means(_ranges(deltas), rows, MEASURES, bucket_seconds)


def with_end(deltas: DataFrame) -> DataFrame:
    """Add date_end from the window label."""
    return deltas.withColumn("date_end", F.col("date_start") + F.make_dt_interval(secs=window_seconds("window_label")))


def window_features(deltas: DataFrame, ticks: DataFrame, bucket_seconds: int = 3600) -> DataFrame:
    """For each delta (symbol, date_start, window_label, delta_pct) with ticks: their count, four means and the targets."""
    keys = deltas.select("symbol", "date_start", "window_label", "delta_pct").distinct()
    windows = _ranges(with_end(keys))
    out = windows.join(window_means(with_end(keys), ticks, bucket_seconds), ranges.KEY).drop("start", "stop", "date_end")
    return out.withColumns({"target_pct": F.col("delta_pct"), "target_up": (F.col("delta_pct") > 0).cast("int")})


def ml_features_view(deltas: DataFrame, ticks: DataFrame, bucket_seconds: int = 3600) -> DataFrame:
    """As window_features on [date_start, date_end), with a row of count 0 for deltas without ticks."""
    keys = deltas.select(*KEY).distinct()
    found = _ranges(keys).join(window_means(keys, ticks, bucket_seconds), ranges.KEY, "left").drop("start", "stop")
    return found.withColumn("n_ticks", F.coalesce("n_ticks", F.lit(0)))


def clean_training_rows(features: DataFrame, columns: list[str], target: str, most: float = 1000.0, least_rows: int = 10) -> DataFrame:
    """Rows with a target within +-most and any feature, nulls as 0, stored once; ValueError below ``least_rows`` rows."""
    some = F.coalesce(*(F.col(c).cast("double") for c in columns)).isNotNull()
    out = stored(features.where(F.col(target).isNotNull() & some & (F.abs(target) <= most)).fillna(0, subset=columns), "training-rows")
    if len(out.select(target).head(least_rows)) < least_rows:
        raise ValueError(f"fewer than {least_rows} usable rows")
    return out


def split(df: DataFrame, fractions: list[float], seed: int = 42, key: str = "id", stratify: str | None = None, cells: int = 1024) -> DataFrame:
    """Add ``part``, 0 for the first fraction and so on: exact shares within each stratum, whatever the partitions.

    Rows are ordered by a hash of the key; ranks come from counts of ``cells``
    hash ranges, so that a stratum isn't sorted in one task.
    """
    h = F.xxhash64(F.col(key), F.lit(seed))
    stratum = F.col(stratify) if stratify else F.lit(0)
    rows = df.withColumn("_s", stratum).withColumn("_h", h).withColumn("_cell", F.floor((F.col("_h") / 2.0**63 + 1) * (cells / 2)).cast("int"))
    counts = rows.groupBy("_s", "_cell").agg(F.count("*").alias("_n"))
    whole = Window.partitionBy("_s")
    bases = counts.select(F.col("_s").alias("_bs"), F.col("_cell").alias("_bc"), (F.sum("_n").over(whole.orderBy("_cell")) - F.col("_n")).alias("_base"), F.sum("_n").over(whole).alias("_total"))
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy("_s", "_cell").orderBy("_h", key)))
    ranked = ranked.join(bases, F.col("_s").eqNullSafe(F.col("_bs")) & (F.col("_cell") == F.col("_bc")))
    place, part, upto = (F.col("_base") + F.col("_r") - 0.5) / F.col("_total"), F.lit(len(fractions) - 1), 1.0
    for i in range(len(fractions) - 1, 0, -1):
        upto -= fractions[i]
        part = F.when(place <= upto, i - 1).otherwise(part)
    return ranked.withColumn("part", part).drop("_s", "_h", "_cell", "_r", "_bs", "_bc", "_base", "_total")
