"""Helpers of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import windows
from ..sources.tables import ARTICLES_SQL, TICKS_SQL, ticks

#: The time that stands for now in the registered queries.
AS_OF = "2024-01-30 12:00:00"


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to ``places``, since sums run in another order elsewhere; NaN as null."""
    doubles = [c for c, kind in df.dtypes if kind == "double"]
    return df.withColumns({c: F.round(F.when(~F.isnan(c), F.col(c)), places) for c in doubles})


def sql(body: str, *, articles: bool = False) -> str:
    """``body`` with the ticks view (and the articles view) in front."""
    more = f", articles AS ({ARTICLES_SQL})" if articles else ""
    return f"WITH RECURSIVE ticks AS ({TICKS_SQL}){more}{body if body.lstrip().startswith(',') else ' ' + body}"


def deltas(spark, sf_dir) -> DataFrame:
    """Hourly deltas as the feature operators take them."""
    out = windows.compute_delta(windows.compute_window(ticks(spark, sf_dir), "1 hour"))
    return out.select("symbol", F.col("window_start").alias("date_start"), F.col("window_end").alias("date_end"), "delta_pct", F.lit("1h").alias("window_label"))


#: w: hourly windows; d: their deltas.
DELTAS_SQL = """, w AS (SELECT symbol, date_trunc('hour', fetched_at) AS window_start, arg_max(price, (fetched_at, id)) AS price, count(*) AS n FROM ticks GROUP BY 1, 2),
d AS (SELECT symbol, window_start, window_start + INTERVAL 1 HOUR AS window_end, price, n, prev_price, price - prev_price AS delta, (price - prev_price) / nullif(prev_price, 0) * 100 AS delta_pct
      FROM (SELECT *, lag(price) OVER (PARTITION BY symbol ORDER BY window_start) AS prev_price FROM w))"""
