"""Rolling work on long series, cut into blocks so that no symbol is one task.

A row's place in its symbol's series comes from counts by hour, which are small,
and its rank within the hour.  Blocks of a fixed number of rows then take the
last ``lookback`` rows of the block before with them as context.  A look-back is
bounded, so results equal those over the whole series.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BLOCK_ROWS = 100_000
#: Rows of a run, whose sum is taken once for all frames that hold it.
RUN = 16


def indexed(df: DataFrame, order: tuple[str, ...] = ("fetched_at", "id"), by: str = "symbol", bucket: str = "hour") -> DataFrame:
    """Add ``_i``, the row's place from 0 in its series; times that are null come first."""
    bucket_of = F.date_trunc(bucket, F.col(order[0]))
    counts = df.groupBy(by, bucket_of.alias("_bucket")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(F.col(by).alias("_by"), F.col("_bucket").alias("_base_bucket"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = F.row_number().over(Window.partitionBy(by, "_bucket").orderBy(*order)) - 1
    ranked = df.withColumn("_bucket", bucket_of).withColumn("_i", within)
    joined = ranked.join(bases, F.col(by).eqNullSafe(F.col("_by")) & F.col("_bucket").eqNullSafe(F.col("_base_bucket")))
    return joined.withColumn("_i", F.col("_i") + F.col("_base")).drop("_bucket", "_by", "_base_bucket", "_base")


def blocked(df: DataFrame, lookback: int, lookahead: int = 0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Of rows with ``_i``: add ``_block``, and copies with ``_context`` that lead or follow a block."""
    if max(lookback, lookahead) > block_rows:
        raise ValueError("a block must hold the look-back")
    own, at = F.floor(F.col("_i") / block_rows), F.col("_i") % block_rows
    homes = F.array_compact(F.array(own, F.when(at >= block_rows - lookback, own + 1), F.when((at < lookahead) & (own > 0), own - 1)))
    return df.withColumn("_own", own).withColumn("_block", F.explode(homes)).withColumn("_context", F.col("_block") != F.col("_own")).drop("_own")


def rolling(df: DataFrame, lookback: int, compute: Callable[[DataFrame, WindowSpec], DataFrame], lookahead: int = 0, block_rows: int = BLOCK_ROWS, order: tuple[str, ...] = ("fetched_at", "id"), by: str = "symbol") -> DataFrame:
    """``compute(rows, window)`` over every series, by blocks; keeps ``_i``."""
    rows = df if "_i" in df.columns else indexed(df, order, by)
    w = Window.partitionBy(by, "_block").orderBy("_i")
    return compute(blocked(rows, lookback, lookahead, block_rows), w).where("NOT _context").drop("_block", "_context")


def last(w: WindowSpec, n: int) -> WindowSpec:
    """The frame of the last n rows."""
    return w.rowsBetween(-(n - 1), 0)


def run_sums(df: DataFrame, w: WindowSpec, value: str, frames: dict[str, int]) -> DataFrame:
    """Add for each of ``frames`` (name -> n) the sum of the last n values, where there are as many and none is null.

    A frame's rows are added in this order: those before its first whole run, the
    sums of its whole runs, those after the last.  Runs are counted from the
    series' start, so the last bits depend neither on the blocks nor on where a
    frame begins, and a frame of n rows takes n / RUN + 2 RUN additions at most.
    """
    after = ((F.col("_i") + 1) % RUN).cast("int")
    newest = F.array(*((F.lag(value, k).over(w) if k else F.col(value)) for k in range(RUN - 2, -1, -1)))
    df = df.withColumns({"_newest": newest, "_whole": F.when(after == 0, F.sum(value).over(last(w, RUN)))})
    long = {name: n for name, n in frames.items() if n >= RUN}
    oldest = {f"_oldest_{name}": F.lag("_newest", n - RUN + 1).over(w) for name, n in long.items()}
    df = df.withColumns({"_run": F.last("_whole", True).over(last(w, RUN))} | oldest | {name: F.sum(value).over(last(w, n)) for name, n in frames.items() if n < RUN})
    most = max(long.values(), default=0) // RUN
    df = df.withColumn("_runs", F.array(*(F.lag("_run", RUN * k).over(w) if k else F.col("_run") for k in range(most - 1, -1, -1))))
    for name, n in long.items():
        before, runs = F.pmod(n - after, F.lit(RUN)), F.floor((n - after) / RUN).cast("int")
        parts = F.concat(F.slice(f"_oldest_{name}", F.lit(1), before), F.slice("_runs", most + 1 - runs, runs), F.slice("_newest", RUN - after, after))
        df = df.withColumn(name, F.aggregate(parts, F.lit(0.0), lambda total, x: total + x))
    return df.drop("_newest", "_whole", "_run", "_runs", *oldest)
