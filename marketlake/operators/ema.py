"""Exponential moving averages over blocks of a series, with window functions only.

An average forgets: after REACH * (span + 1) rows the weight of what came before
is below the last bit of a double.  A series is cut into stretches of so many
rows.  Within one, an average is a running sum of values weighted by powers of
1 / (1 - alpha), which stay below 2 ** 1000; what comes from before is the
average at the end of the stretch before, faded.  A block that takes a stretch of
the block before with it therefore has its averages without waiting for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from . import series

#: (1 - 2 / (span + 1)) ** (REACH * (span + 1)) is below 2 ** -60.
REACH = 21
#: Spans of one stretch differ by this factor at most, so that weights stay within a double.
RATIO = 16


def lookback(*spans: int) -> int:
    """Rows that averages of these spans need, each of the one before's results."""
    return sum(REACH * (span + 1) for span in spans)


def _seeded(value: str, span: int, seed: str, w: WindowSpec) -> Column:
    """Each row's share of the average: the first one counts in full."""
    alpha = 2 / (span + 1)
    if seed == "first":
        return F.when(F.col("_i") == 0, F.col(value)).otherwise(F.col(value) * alpha)
    mean = F.avg(value).over(w.rowsBetween(-(span - 1), 0))
    return F.when(F.col("_i") < span - 1, 0.0).when(F.col("_i") == span - 1, mean).otherwise(F.col(value) * alpha)


def in_block(df: DataFrame, spans: dict[str, int], value: str, seed: str = "first", by: str = "symbol") -> DataFrame:
    """Add a column for each of ``spans`` (name -> span) to rows with ``_block`` and ``_i``.

    Right for rows that have ``lookback`` rows of ``value`` before them in the block, or all there are.
    """
    if max(spans.values()) + 1 >= RATIO * (min(spans.values()) + 1):
        for name, span in spans.items():
            df = in_block(df, {name: span}, value, seed, by)
        return df
    length = lookback(max(spans.values()))
    df = df.withColumn("_stretch", F.floor(F.col("_i") / length)).withColumn("_at", F.col("_i") % length)
    block = Window.partitionBy(by, "_block")
    within = Window.partitionBy(by, "_block", "_stretch").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    before = block.orderBy("_stretch").rangeBetween(-1, -1)
    fade = {name: 1 - 2 / (span + 1) for name, span in spans.items()}
    own = {name: _seeded(value, span, seed, block.orderBy("_i")) for name, span in spans.items()}
    df = df.withColumns({f"_own_{name}": own[name] / F.pow(F.lit(fade[name]), "_at") for name in spans})
    df = df.withColumns({f"_own_{name}": F.sum(f"_own_{name}").over(within) * F.pow(F.lit(fade[name]), "_at") for name in spans})
    df = df.withColumns({f"_end_{name}": F.max_by(f"_own_{name}", "_i").over(before) for name in spans})
    for name, span in spans.items():
        both = F.col(f"_own_{name}") + F.coalesce(f"_end_{name}", F.lit(0.0)) * F.pow(F.lit(fade[name]), F.col("_at") + 1)
        df = df.withColumn(name, both if seed == "first" else F.when(F.col("_i") >= span - 1, both))
    return df.drop("_stretch", "_at", *(f"_{k}_{name}" for k in ("own", "end") for name in spans))


def with_ema(df: DataFrame, spans: dict[str, int], value: str = "price", seed: str = "first", by: str = "symbol", block_rows: int = series.BLOCK_ROWS) -> DataFrame:
    """Add a column for each of ``spans`` (name -> span) over rows that have ``_i`` and no null ``value``.

    seed "first" starts at the first value; "sma" at the mean of the first span
    rows, with null before.
    """
    if seed not in ("first", "sma"):
        raise ValueError(f"no seed {seed!r}")
    reach = lookback(max(spans.values()))
    return series.rolling(df, reach, lambda rows, w: in_block(rows, spans, value, seed, by), block_rows=max(block_rows, reach), by=by)
