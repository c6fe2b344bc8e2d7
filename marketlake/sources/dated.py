"""Tables in folders date=YYYY-MM-DD that take batches: only the dates that a batch touches are read and written.

A merge is copy-on-write.  The batch's rows and the rows of its dates become the
new content of these dates, which dynamic partition overwrite puts in the place
of the old; files of other dates stay as they are.  A batch that comes again
finds its own rows and leaves the same ones, so a job may start over anywhere.

Where ids stay with their date (``bound``), a batch looks into its own dates only.
Else the dates that hold any of its ids are looked up first: of all other dates
the id column is read, and a bitmap of the batch's ids, of bounded size, lets few
rows go on to the join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import stored

#: The folder of rows without a time.
UNDATED = "undated"
#: An id's bit is one of so many; a bitmap of this size takes 2 MB.
ID_BITS = 1 << 24
#: Columns that an update of a tick leaves as they were; with the date, so that an id stays in the folder where it came first.
FIXED = ("url", "symbol", "name", "date")


def date_of(time: str | Column = "fetched_at") -> Column:
    return F.coalesce(F.date_format(time, "yyyy-MM-dd"), F.lit(UNDATED))


def table_at(spark: SparkSession, path: str) -> DataFrame | None:
    """The table with its dates as text, or None where there is none yet."""
    try:
        found = spark.read.parquet(path)
    except Exception as absent:
        if "PATH_NOT_FOUND" not in str(absent) and "UNABLE_TO_INFER_SCHEMA" not in str(absent):
            raise
        return None
    # a folder's name is text, whatever it looks like
    fields = [F.col(c) for c in found.columns if c != "date"]
    return spark.read.schema(found.select(fields).withColumn("date", F.lit("").cast("string")).schema).parquet(path) if "date" in found.columns else found


def dates_in(df: DataFrame) -> list[str]:
    """The different dates: as many as a batch or a table has days."""
    return [r[0] for r in df.select("date").distinct().collect()]


def maybe_among(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``column`` may be among that of ``keys``; none that is there is left out.

    The keys' bits come as bitmaps of 32768 bits, ID_BITS / 32768 rows at most.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(ID_BITS))
    number = F.bitmap_bucket_number(place(F.col(column)))
    bits = keys.select(place(F.col(column)).alias("_place")).groupBy(F.bitmap_bucket_number("_place").alias("_number")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_place")).alias("_bits"))
    at = F.bitmap_bit_position(place(F.col(column)))
    byte = F.conv(F.hex(F.substr("_bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.expr("shiftright(_byte, CAST(_at % 8 AS INT)) & 1") == 1
    joined = df.withColumn("_number", number).join(F.broadcast(bits), "_number").withColumn("_byte", byte).withColumn("_at", at)
    return joined.where(hit).select(df.columns)


def homes_of(table: DataFrame, batch: DataFrame, key: str) -> list[str]:
    """The dates of ``table`` that hold a key of ``batch``."""
    near = maybe_among(table.select(key, "date"), key, batch.select(key))
    return dates_in(near.join(batch.select(key), key, "left_semi"))


def merge_dated(batch: DataFrame, path: str, merge: Callable[[DataFrame, DataFrame], DataFrame], key: str = "id", bound: bool = True) -> list[str]:
    """Put ``merge(rows of the batch's dates, batch)`` in the place of these dates; returns the dates written.

    ``batch`` and what ``merge`` returns have the table's columns, ``date`` among them.
    """
    spark = batch.sparkSession
    batch = stored(batch, "batch")  # read several times
    table, touched = table_at(spark, path), set(dates_in(batch))
    if not touched:
        return []
    if table is None:
        existing = batch.limit(0)
    else:
        if not bound:
            touched |= set(homes_of(table.where(~F.col("date").isin(list(touched))), batch, key))
        existing = table.where(F.col("date").isin(list(touched)))
    merged = merge(existing, batch)
    merged.repartition("date").write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("date").parquet(path)
    return sorted(touched)


def newest(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """Of each id the measures of the newest row, the batch's where times are equal; an id that was there keeps its FIXED columns."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    fixed = [c for c in FIXED if c in batch.columns]
    rest = [c for c in batch.columns if c not in ("id", *fixed)]
    values, kept = F.struct(*rest), F.struct(*fixed)
    found = both.groupBy("id").agg(F.max_by(values, F.struct("fetched_at", "_new", values)).alias("_v"), F.min_by(kept, F.struct("_new", "fetched_at", kept)).alias("_f"))
    return found.select("id", "_f.*", "_v.*").select(batch.columns)


def dated(ticks: DataFrame) -> DataFrame:
    """Usable ticks, one for each id, the newest, with their date."""
    usable = ticks.dropna(subset=["volume_24h", "coin_circulating"])
    rest = F.struct(*(c for c in ticks.columns if c != "id"))
    one = usable.groupBy("id").agg(F.max_by(rest, F.struct("fetched_at", rest)).alias("_r")).select("id", "_r.*").select(ticks.columns)
    return one.withColumn("date", date_of())


def upsert_dated(ticks: DataFrame, path: str, bound: bool = True) -> list[str]:
    """New ids come to the table, known ones take the newest measures and stay in the folder of their first date.

    With ``bound`` an id must never come with another date.
    """
    return merge_dated(dated(ticks), path, newest, bound=bound)


def append_dated(ticks: DataFrame, path: str, bound: bool = True) -> None:
    """Append the rows of ids that the table hasn't; known ids stay as they are."""
    batch = stored(dated(ticks), "batch")
    table = table_at(batch.sparkSession, path)
    if table is not None:
        seen = table.where(F.col("date").isin(dates_in(batch))) if bound else maybe_among(table, "id", batch)
        batch = batch.join(seen.select("id"), "id", "left_anti").select(batch.columns)
    batch.repartition("date").write.mode("append").partitionBy("date").parquet(path)
