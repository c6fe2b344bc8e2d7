"""Readers and writers of raw records, the lake and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.exprs import article_id, parse_flexible_utc


def parse_lines(lines: DataFrame, schema: str = schemas.RAW) -> DataFrame:
    """Records of text lines (column value): no byte-order mark, blank and broken lines left out."""
    text = F.regexp_replace(F.make_valid_utf8("value"), "^\\uFEFF", "")
    parsed = lines.select(text.alias("value")).where(F.trim("value") != "").select(F.from_json("value", schema + ", _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}).alias("r"))
    return parsed.select("r.*").where("_broken IS NULL").drop("_broken")


def read_raw_ndjson(spark: SparkSession, path: str, schema: str = schemas.RAW, pattern: str = "*.ndjson") -> DataFrame:
    """All files of the ``pattern`` below ``path``."""
    return parse_lines(spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path), schema)


def read_news(spark: SparkSession, path: str, pattern: str = "*.ndjson") -> DataFrame:
    return read_raw_ndjson(spark, path, schemas.NEWS, pattern)


def write_lake(df: DataFrame, path: str, mode: str = "append", files_per_date: int = 1) -> None:
    """Parquet in folders date=YYYY-MM-DD; a date with many rows is dealt to ``files_per_date`` tasks."""
    salt = F.pmod(F.xxhash64("id"), F.lit(files_per_date))
    df.repartition("date", salt).write.partitionBy("date").mode(mode).parquet(path)


def read_lake(spark: SparkSession, path: str, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """The lake, whatever columns its files had; date bounds prune folders."""
    df = spark.read.option("mergeSchema", True).parquet(path)
    if date_from:
        df = df.where(F.col("date") >= date_from)
    if date_to:
        df = df.where(F.col("date") <= date_to)
    return df


def write_rejects(df: DataFrame, path: str) -> None:
    """Rejected records as JSON lines; _corrupt_record holds the time text that was refused."""
    df.write.mode("append").json(path)


def write_metrics(df: DataFrame, root: str, granularity: str) -> None:
    """Append window or delta rows below granularity=...; nothing is deleted."""
    df.withColumn("granularity", F.lit(granularity)).write.partitionBy("granularity").mode("append").parquet(root)


def usable_ticks(df: DataFrame, symbol: str | None = None) -> DataFrame:
    """Ticks with price, symbol and volume; one symbol in any case."""
    df = df.where("price IS NOT NULL AND symbol IS NOT NULL AND volume_24h IS NOT NULL")
    return df if symbol is None else df.where(F.upper("symbol") == symbol.upper())


def load_ticks(spark: SparkSession, path: str, symbol: str | None = None) -> DataFrame:
    return usable_ticks(spark.read.parquet(path), symbol)


def load_ticks_jdbc(spark: SparkSession, url: str, table: str, partitions: int = 16, bounds: tuple[str, str] | None = None, symbol: str | None = None) -> DataFrame:
    """Ticks of a database table, read in ``partitions`` ranges of fetched_at; filters reach the database.

    Needs the database's driver on the class path.
    """
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    if bounds:
        reader = reader.options(partitionColumn="fetched_at", lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions)
    return usable_ticks(reader.load(), symbol)


def overwrite_result(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_result(spark: SparkSession, path: str, *order: str) -> DataFrame:
    return spark.read.parquet(path).orderBy(*order)


def publish_records(df: DataFrame) -> DataFrame:
    """key (SHA-1 of url and title) and value (the record as JSON), as a topic sink takes them."""
    return df.select(article_id("url_title").alias("key"), F.to_json(F.struct("*")).alias("value"))


def write_topic(df: DataFrame, servers: str, topic: str) -> None:
    """Needs the connector on the class path."""
    publish_records(df).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()


def new_raw_records(df: DataFrame, seen: DataFrame) -> DataFrame:
    """One record of each id that ``seen`` (id, date) doesn't hold for its date, with date and its parts."""
    date = F.to_date(parse_flexible_utc("fetched_at"))
    rows = df.withColumn("date", date).dropDuplicates(["id", "date"]).join(seen.select("id", "date").distinct(), ["id", "date"], "left_anti")
    return rows.withColumns({"year": F.date_format("date", "yyyy"), "month": F.date_format("date", "MM"), "day": F.date_format("date", "dd")})


def write_raw_partition(df: DataFrame, seen: DataFrame, path: str) -> None:
    """New raw records as JSON lines in year, month and day folders."""
    new_raw_records(df, seen).drop("date").write.partitionBy("year", "month", "day").mode("append").json(path)
