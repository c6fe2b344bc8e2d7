"""Sums over time ranges, and the last row before a time, without joining rows with ranges.

A range is cut into whole buckets and two edges.  Whole buckets are covered by
nodes of a dyadic tree, sums of 2 ** level buckets each, so a long range is a few
nodes.  An edge needs the rows of its own bucket only, as a running sum there.
What is joined grows with the rows plus the ranges, not with their product, and
no total over all time is subtracted from another, which would lose digits.

Times are microseconds since 1970 here.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Levels of the tree; longer ranges take several nodes of the last one.
LEVELS = 16
KEY = ["symbol", "start", "stop"]


def micros(time: str | Column) -> Column:
    return F.unix_micros((F.col(time) if isinstance(time, str) else time).cast("timestamp"))


def _dyadic(first: Column, end: Column) -> Column:
    """The nodes (level, node) that cover the buckets from ``first`` to before ``end``."""
    node = lambda level, at: F.array(F.struct(level.cast("int").alias("level"), at.cast("long").alias("node")))
    none = F.array().cast("array<struct<level:int,node:long>>")

    def step(done: Column, level: Column) -> Column:
        left = (done.a < done.b) & (done.a.bitwiseAND(F.lit(1)) == 1)
        a = F.when(left, done.a + 1).otherwise(done.a)
        right = (a < done.b) & (done.b.bitwiseAND(F.lit(1)) == 1)
        b = F.when(right, done.b - 1).otherwise(done.b)
        more = F.concat(done.nodes, F.when(left, node(level, done.a)).otherwise(none), F.when(right, node(level, b)).otherwise(none))
        return F.struct(F.shiftright(a, 1).alias("a"), F.shiftright(b, 1).alias("b"), more.alias("nodes"))

    def rest(done: Column) -> Column:
        top = F.transform(F.sequence(done.a, done.b - 1), lambda x: F.struct(F.lit(LEVELS).alias("level"), x.alias("node")))
        return F.concat(done.nodes, F.when(done.a < done.b, top).otherwise(none))

    start = F.struct(first.cast("long").alias("a"), end.cast("long").alias("b"), none.alias("nodes"))
    return F.when(first < end, F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS - 1)), start, step, rest)).otherwise(none)


def range_means(ranges: DataFrame, rows: DataFrame, measures: Iterable[str], bucket_seconds: int = 3600) -> DataFrame:
    """symbol, start, stop, n_ticks and avg_<measure> of the ranges [start, stop) that hold rows (symbol, at, measures) of their symbol."""
    measures = list(measures)
    size = bucket_seconds * 1_000_000
    bucket = F.floor(F.col("at") / size)
    spans = ranges.select(*KEY).where("stop > start AND symbol IS NOT NULL").distinct()
    points = rows.select("symbol", "at", F.lit(1).cast("long").alias("n"), *(F.coalesce(m, F.lit(0.0)).alias(f"s_{m}") for m in measures), *(F.col(m).isNotNull().cast("long").alias(f"c_{m}") for m in measures)).where("at IS NOT NULL AND symbol IS NOT NULL")
    sums = [c for c in points.columns if c not in ("symbol", "at")]
    added = lambda df, *by: df.groupBy(*by).agg(*(F.sum(c).alias(c) for c in sums))

    each = added(points.withColumn("bucket", bucket), "symbol", "bucket")
    tree = added(each.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS)))).withColumn("node", F.expr("shiftright(bucket, level)")), "symbol", "level", "node")
    first, end = F.ceil(F.col("start") / size), F.floor(F.col("stop") / size)
    whole = spans.withColumn("nodes", F.explode(_dyadic(first, end))).select(*KEY, "nodes.level", "nodes.node").join(tree, ["symbol", "level", "node"]).select(*KEY, *sums)

    # an edge is what stands before it in its bucket; at a range's start, unless its stop is in that bucket too, what stands behind
    one = first > end
    ends = F.array(
        F.struct(F.col("start").alias("at"), (F.col("start") % size != 0).alias("cuts"), F.lit(-1).alias("sign"), (~one).alias("behind")),
        F.struct(F.col("stop").alias("at"), (F.col("stop") % size != 0).alias("cuts"), F.lit(1).alias("sign"), F.lit(False).alias("behind")),
    )
    edges = spans.withColumn("e", F.explode(ends)).where("e.cuts").select(*KEY, "e.at", "e.sign", "e.behind").withColumn("bucket", bucket)
    near = points.withColumn("bucket", bucket).join(edges.select("symbol", "bucket").distinct(), ["symbol", "bucket"], "left_semi")
    both = near.unionByName(edges, allowMissingColumns=True)
    w = Window.partitionBy("symbol", "bucket")
    # a row at the very time of an edge stands behind it
    before = w.orderBy("at", F.col("sign").isNull()).rowsBetween(Window.unboundedPreceding, -1)
    summed = both.select(*KEY, "sign", "behind", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in sums), *(F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"all_{c}") for c in sums))
    part = lambda c: F.when(F.col("behind"), F.col(f"all_{c}")).otherwise(0) + F.col("sign") * F.col(c)
    cut = summed.where("sign IS NOT NULL").select(*KEY, *(part(c).alias(c) for c in sums))

    total = added(whole.unionByName(cut), *KEY).where("n > 0")
    return total.select(*KEY, F.col("n").alias("n_ticks"), *(F.try_divide(f"s_{m}", F.col(f"c_{m}")).alias(f"avg_{m}") for m in measures))


def as_of(times: DataFrame, rows: DataFrame, value: Column, bucket_seconds: int = 3600) -> DataFrame:
    """symbol, at and ``last``, the value of the last of ``rows`` (symbol, at) before each of ``times`` (symbol, at), if there is any.

    Blocks of time pass their last value to those that follow, which answers a
    time at a block's start.  Only where a time is within a block, the block's rows
    are laid together with its times and carry the last value on.
    """
    size = bucket_seconds * 1_000_000
    block = F.floor(F.col("at") / size).alias("block")
    asked = times.select("symbol", "at").where("symbol IS NOT NULL AND at IS NOT NULL").distinct()
    known = rows.where("symbol IS NOT NULL AND at IS NOT NULL").select("symbol", "at", value.alias("value"))
    known, asked = (df.withColumn("block", block) for df in (known, asked))
    cut = asked.where(F.col("at") % size != 0).select("symbol", "block").distinct()
    both = known.join(cut, ["symbol", "block"], "left_semi").unionByName(asked, allowMissingColumns=True)
    within = Window.partitionBy("symbol", "block").orderBy("at", F.col("value").isNotNull(), "value").rowsBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("last", F.last("value", True).over(within)).where("value IS NULL").select("symbol", "at", "block", "last")
    newest = F.max_by("value", F.when(F.col("value").isNotNull(), F.struct("at", "value")))
    chain = Window.partitionBy("symbol").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    every = known.unionByName(asked, allowMissingColumns=True)
    carried = every.groupBy("symbol", "block").agg(newest.alias("value")).select("symbol", "block", F.last("value", True).over(chain).alias("carry"))
    return found.join(carried, ["symbol", "block"]).select("symbol", "at", F.coalesce("last", "carry").alias("last"))
