"""The streaming jobs over the tables, run until nothing new is there, twice, so that a restart must add nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import market, windows
from ..sources.shared import new_path
from ..sources.tables import ticks
from ..streaming import jobs
from .common import DELTAS_SQL, rounded, sql
from .lake import raw_ticks

_PATTERN = "*.txt"


def _paths(spark, *names: str) -> list[str]:
    root = new_path(spark, "stream")
    return [f"{root}/{n}" for n in names]


def _lines(spark, sf_dir, path: str) -> None:
    raw_ticks(spark, sf_dir).select(F.to_json(F.struct("*"))).write.text(path)


def _ticks(spark, sf_dir, path: str) -> DataFrame:
    """The ticks as a stream of files; a watermark needs times with a zone."""
    rows = ticks(spark, sf_dir).withColumn("fetched_at", F.col("fetched_at").cast("timestamp")).withColumn("published_at", F.col("published_at").cast("timestamp"))
    rows.write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


def streamed_articles(spark, sf_dir):
    source, lake, rejects, state = _paths(spark, "in", "lake", "rejects", "state")
    _lines(spark, sf_dir, source)
    for _ in range(2):
        jobs.stream_ingest(spark, source, lake, rejects, state, None, _PATTERN).awaitTermination()
    valid = spark.read.parquet(lake).select("id", F.lit(None).cast("string").alias("refused"))
    return valid.unionByName(spark.read.schema("id string, published_at string").json(rejects).select("id", F.col("published_at").alias("refused")))


def streamed_ticks(spark, sf_dir):
    source, lake, state = _paths(spark, "in", "lake", "state")
    _lines(spark, sf_dir, source)
    for _ in range(2):
        jobs.stream_ticks(spark, source, lake, state, None, _PATTERN).awaitTermination()
    return spark.read.parquet(lake).select("id", "symbol", "volume_24h", F.col("date").cast("string").alias("date"))


def streamed_dedupe(spark, sf_dir):
    """Every tick comes twice within the watermark."""
    source, out, state = _paths(spark, "in", "out", "state")
    _ticks(spark, sf_dir, source)
    stream = jobs.stream_dedupe(_ticks(spark, sf_dir, source), "60 days")
    jobs.write_windows(stream, out, state).awaitTermination()
    return spark.read.parquet(out).groupBy("symbol").agg(F.count("*").alias("n_rows"), F.countDistinct("id").alias("n_ids"))


def streamed_windows(spark, sf_dir):
    """Windows that are past the watermark of one hour; the last ones are still open."""
    source, out, state = _paths(spark, "in", "out", "state")
    stream = _ticks(spark, sf_dir, source)
    for _ in range(2):
        jobs.write_windows(jobs.stream_windows(stream, "1 hour"), out, state).awaitTermination()
    found = spark.read.parquet(out)
    return rounded(found.select("symbol", F.col("window_start").cast("timestamp_ntz").alias("window_start"), F.col("window_end").cast("timestamp_ntz").alias("window_end"), "count", "price"))


def streamed_merge(spark, sf_dir):
    """Every tick comes twice; ids merge once."""
    source, out, state = _paths(spark, "in", "out", "state")
    _ticks(spark, sf_dir, source)
    stream = _ticks(spark, sf_dir, source)
    for _ in range(2):
        jobs.stream_merge(stream, out, state, None).awaitTermination()
    return rounded(spark.read.parquet(out).select("id", "symbol", "price"))


def streamed_symbols(spark, sf_dir):
    source, out, state = _paths(spark, "in", "out", "state")
    for _ in range(2):
        jobs.stream_merge_symbols(_ticks(spark, sf_dir, source), out, state, None).awaitTermination()
    return spark.read.parquet(out).select("symbol")


def streamed_deltas(spark, sf_dir):
    """Hourly deltas come as they are, then again from prices one higher; the later row of a key counts."""
    source, out, state = _paths(spark, "in", "out", "state")
    t = ticks(spark, sf_dir)
    for rows in (t, t.where("symbol < 'S5'").withColumn("price", F.col("price") + 1)):
        found = windows.compute_delta(windows.compute_window(rows, "1 hour"))
        found.write.mode("append").parquet(source)
        jobs.stream_merge_deltas(spark.readStream.schema(found.schema).parquet(source), out, state, None).awaitTermination()
    merged = jobs.merged_deltas(spark, out, market.list_symbols(t.where("symbol <> 'S0'")))
    return rounded(merged.select("symbol", "window_start", "window_label", "delta", "delta_pct"), 4)


def _parts(spark, sf_dir, path: str, parts: int) -> DataFrame:
    """The ticks in ``parts`` files by time, one for each micro-batch."""
    rows = ticks(spark, sf_dir)
    rows = rows.withColumns({c: F.col(c).cast("timestamp") for c in ("fetched_at", "published_at")})
    ends = rows.agg(F.min("fetched_at").alias("a"), F.max("fetched_at").alias("b")).first()
    part = F.floor((F.unix_micros("fetched_at") - F.unix_micros(F.lit(ends.a))) * parts / (F.unix_micros(F.lit(ends.b)) - F.unix_micros(F.lit(ends.a)) + 1))
    for i in range(parts):
        rows.where(part == i).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def streamed_delta_table(spark, sf_dir):
    """Ticks in three micro-batches through keyed state; a restart goes on with the state."""
    source, out, state = _paths(spark, "in", "out", "state")
    stream = _parts(spark, sf_dir, source, 3)
    for _ in range(2):
        jobs.stream_delta_table(stream, out, state, None).awaitTermination()
    found = jobs.merged_deltas(spark, out)
    plain = [F.col(c).cast("timestamp_ntz").alias(c) for c in ("window_start", "window_end")]
    return rounded(found.select("symbol", *plain, "price", "prev_price", "delta", "delta_pct", "trending_up"), 4)


def streamed_upserts(spark, sf_dir):
    """Ticks come as they are, then a third of them again, a minute later and a price higher."""
    source, out, state = _paths(spark, "in", "out", "state")
    jobs.stream_merge(_ticks(spark, sf_dir, source), out, state, None, update=True, bound=False).awaitTermination()
    t = ticks(spark, sf_dir).where("id % 3 = 0").withColumn("price", F.col("price") + 1)
    later = t.withColumns({"fetched_at": (F.col("fetched_at") + F.expr("INTERVAL 1 MINUTE")).cast("timestamp"), "published_at": F.col("published_at").cast("timestamp"), "url": F.lit("another")})
    later.write.mode("append").parquet(source)
    stream = spark.readStream.schema(later.schema).parquet(source)
    for _ in range(2):
        jobs.stream_merge(stream, out, state, None, update=True, bound=False).awaitTermination()
    found = spark.read.parquet(out)
    return rounded(found.select("id", "symbol", "price", F.col("fetched_at").cast("timestamp_ntz").alias("fetched_at"), F.col("date").cast("string").alias("date"), "url"))


QUERIES = {f.__name__: f for f in (streamed_delta_table, streamed_upserts, streamed_articles, streamed_ticks, streamed_dedupe, streamed_windows, streamed_merge, streamed_symbols, streamed_deltas)}

ORACLE_SQL = {
    "streamed_delta_table": sql(DELTAS_SQL + """ SELECT symbol, window_start, window_end, round(price, 4) AS price, round(prev_price, 4) AS prev_price, round(delta, 4) AS delta, round(delta_pct, 4) AS delta_pct, coalesce(delta_pct > 50, false) AS trending_up FROM d"""),
    "streamed_upserts": sql("""
, m AS (SELECT id, symbol, CASE WHEN id % 3 = 0 THEN price + 1 ELSE price END AS price, CASE WHEN id % 3 = 0 THEN fetched_at + INTERVAL 1 MINUTE ELSE fetched_at END AS fetched_at, fetched_at AS first_at, url FROM ticks WHERE volume_24h IS NOT NULL AND coin_circulating IS NOT NULL)
SELECT id, symbol, round(price, 6) AS price, fetched_at, strftime(first_at, '%Y-%m-%d') AS date, url FROM m"""),
    "streamed_articles": sql("SELECT CAST(id AS VARCHAR) AS id, CASE WHEN id % 3 = 0 THEN strftime(published_at, '%d-%m-%Y %H:%M') END AS refused FROM ticks"),
    "streamed_ticks": sql("SELECT CAST(id AS VARCHAR) AS id, symbol, CAST(CAST(volume_24h AS INTEGER) AS DOUBLE) AS volume_24h, strftime(fetched_at, '%Y-%m-%d') AS date FROM ticks WHERE id % 5 <> 0 AND price IS NOT NULL AND volume_24h IS NOT NULL"),
    "streamed_dedupe": sql("SELECT symbol, count(*) AS n_rows, count(*) AS n_ids FROM ticks GROUP BY 1"),
    "streamed_windows": sql("""
, w AS (SELECT symbol, date_trunc('hour', fetched_at) AS window_start, date_trunc('hour', fetched_at) + INTERVAL 1 HOUR AS window_end, count(*) AS count, round(arg_max(price, (fetched_at, id)), 6) AS price FROM ticks GROUP BY 1, 2, 3)
SELECT * FROM w WHERE window_end <= (SELECT date_trunc('millisecond', max(fetched_at)) FROM ticks) - INTERVAL 1 HOUR"""),
    "streamed_merge": sql("SELECT id, symbol, round(price, 6) AS price FROM ticks WHERE volume_24h IS NOT NULL AND coin_circulating IS NOT NULL"),
    "streamed_symbols": sql("SELECT DISTINCT symbol FROM ticks"),
    "streamed_deltas": sql(DELTAS_SQL + """
, e AS (SELECT symbol, window_start, price + 1 AS price, lag(price + 1) OVER (PARTITION BY symbol ORDER BY window_start) AS prev_price FROM w WHERE symbol < 'S5'),
e2 AS (SELECT symbol, window_start, price - prev_price AS delta, (price - prev_price) / nullif(prev_price, 0) * 100 AS delta_pct FROM e),
f AS (SELECT * FROM e2 WHERE delta <> 0 AND delta_pct <> 0)
SELECT symbol, window_start, '1h' AS window_label, round(delta, 4) AS delta, round(delta_pct, 4) AS delta_pct FROM f WHERE symbol <> 'S0'
UNION ALL SELECT symbol, window_start, '1h', round(delta, 4), round(delta_pct, 4) FROM d WHERE symbol <> 'S0' AND delta <> 0 AND delta_pct <> 0 AND (symbol, window_start) NOT IN (SELECT (symbol, window_start) FROM f)"""),
}
