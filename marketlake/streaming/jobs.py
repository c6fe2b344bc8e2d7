"""Streaming ingest, windows, dedupe and merges.

Every job takes a checkpoint folder, so that a restart goes on where the last
committed batch ended.  Rows later than the watermark are left out of streaming
windows; they still reach the lake, where the next batch run counts them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import schemas
from ..operators import ingest
from ..sources import dated, raw


def _lines(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.readStream.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path)


def _place(batch: DataFrame, number: int) -> str:
    """The folder of a batch: batch numbers start at 0 with every new checkpoint folder, which the query's id tells apart."""
    return f"query={batch.sparkSession.sparkContext.getLocalProperty('sql.streaming.queryId')}/batch={number}"


def _run(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, trigger: str | None) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)).start()


def stream_ingest(spark: SparkSession, source: str, lake: str, rejects: str, checkpoint: str, trigger: str | None = "5 seconds", pattern: str = "*.ndjson") -> StreamingQuery:
    """News files to the lake and the rejects, each file once; all there is now if there is no trigger.

    A batch that is run again replaces its own folder, so that no row comes twice.
    """

    def each(batch: DataFrame, number: int) -> None:
        valid, refused = ingest.split_valid(batch)
        valid.write.partitionBy("date").mode("overwrite").parquet(f"{lake}/{_place(batch, number)}")
        refused.write.mode("overwrite").json(f"{rejects}/{_place(batch, number)}")

    return _run(raw.parse_lines(_lines(spark, source, pattern), schemas.NEWS), each, checkpoint, trigger)


def stream_ticks(spark: SparkSession, source: str, lake: str, checkpoint: str, trigger: str | None = "60 seconds", pattern: str = "*.ndjson") -> StreamingQuery:
    """Raw market records to the date-partitioned tick lake."""
    ticks = ingest.require_market_fields(ingest.normalize_tick(raw.parse_lines(_lines(spark, source, pattern))))
    writer = ticks.writeStream.format("parquet").partitionBy("date").option("path", lake).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)).start()


def with_event_time(stream: DataFrame, watermark: str, time: str = "fetched_at") -> DataFrame:
    """A watermark needs a timestamp with a zone."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, watermark)


def stream_dedupe(stream: DataFrame, watermark: str = "1 hour", time: str = "fetched_at") -> DataFrame:
    """One row for each id within the watermark."""
    return with_event_time(stream, watermark, time).dropDuplicatesWithinWatermark(["id"])


def stream_windows(stream: DataFrame, every: str, period: str | None = None, watermark: str = "1 hour") -> DataFrame:
    """Rows and last price of each symbol's windows, tumbling or sliding, once they are past the watermark."""
    w = F.window("fetched_at", period or every, every)
    last = F.max_by("price", F.struct("fetched_at", "id")).alias("price")
    found = with_event_time(stream, watermark).groupBy(w.alias("w"), "symbol").agg(F.count("*").alias("count"), last)
    return found.select("symbol", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "count", "price")


def write_windows(windows: DataFrame, path: str, checkpoint: str, trigger: str | None = None) -> StreamingQuery:
    writer = windows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)).start()


def stream_merge(stream: DataFrame, table: str, checkpoint: str, trigger: str | None = "60 seconds", update: bool = False, bound: bool = True) -> StreamingQuery:
    """Merge each batch into the tick table in date folders, of which only the batch's are read.

    New ids are appended and known ones stay; with ``update`` known ids take the
    newest measures, and the batch's dates are written anew.  A batch that is run
    again finds its own ids there, so that nothing comes twice.  Where an id may
    come with another date than before, say ``bound=False``.
    """

    def each(batch: DataFrame, number: int) -> None:
        if update:
            dated.upsert_dated(batch, table, bound)
        else:
            dated.append_dated(batch, table, bound)

    return _run(stream, each, checkpoint, trigger)


def _table(batch: DataFrame, path: str) -> DataFrame | None:
    return dated.table_at(batch.sparkSession, path)


def stream_merge_symbols(stream: DataFrame, table: str, checkpoint: str, trigger: str | None = "60 seconds") -> StreamingQuery:
    """Each batch's new symbols in a folder of its own, which a batch that is run again replaces."""

    def each(batch: DataFrame, number: int) -> None:
        new = ingest.new_symbols(batch)
        known = _table(batch, table)
        if known is not None:
            own = F.concat_ws("/", F.concat(F.lit("query="), "query"), F.concat(F.lit("batch="), "batch")) == _place(batch, number)
            new = new.join(known.where(~own).select("symbol"), "symbol", "left_anti")
        new.write.mode("overwrite").parquet(f"{table}/{_place(batch, number)}")

    return _run(stream, each, checkpoint, trigger)


#: What a symbol's state keeps of its newest windows: start (microseconds), rows, time and id of the last row, and its price.
_STATE = "starts array<long>, counts array<long>, times array<long>, ids array<string>, prices array<double>"
_DELTAS = "symbol string, window_start timestamp, window_end timestamp, price double, prev_price double, delta double, delta_pct double, trending_up boolean"


def stream_deltas(ticks: DataFrame, every: str = "1 hour", keep: int = 48, threshold: float = 50.0) -> DataFrame:
    """The change of each symbol's windows from its previous present window, as ticks come in.

    A task first sums up its rows by symbol and window, so a busy symbol is a few
    rows for each task.  Keyed state then holds a symbol's ``keep`` newest windows
    with their last row; every batch gives the windows that it changed, and the
    one that follows each of them, anew.  Rows of windows that the state has
    dropped are left out: ``windows.merge_window_parts`` takes those.
    """
    micros = int(ticks.sparkSession.sql(f"SELECT unix_micros(timestamp'1970-01-01' + INTERVAL {every})").first()[0])
    rows = ticks.where("fetched_at IS NOT NULL AND symbol IS NOT NULL").select("symbol", F.unix_micros(F.col("fetched_at").cast("timestamp")).alias("at"), F.col("id").cast("string").alias("id"), "price")

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["start"] = pdf["at"] - pdf["at"] % micros
            # ids are numbers in some tables: the longer one is the larger one
            pdf = pdf.assign(width=pdf["id"].str.len()).sort_values(["at", "width", "id"], na_position="first")
            by = pdf.groupby(["symbol", "start"], sort=False)
            yield by.tail(1).assign(n=lambda x: by["start"].transform("size"))[["symbol", "start", "n", "at", "id", "price"]]

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        windows = {w[0]: w[1:] for w in zip(*state.get, strict=True)} if state.exists else {}
        oldest, changed = min(windows, default=0) if len(windows) >= keep else None, set()
        for pdf in pdfs:
            for start, n, at, name, price in zip(*(pdf[c] for c in ("start", "n", "at", "id", "price")), strict=True):
                if oldest is not None and start < oldest:
                    continue
                count, *last = windows.get(start, (0, -(1 << 62), "", None))
                new = (int(at), name or "", None if pd.isna(price) else float(price))
                order = lambda x: (x[0], len(x[1]), x[1])
                windows[int(start)] = (count + int(n), *max(tuple(last), new, key=order))
                changed.add(int(start))
        starts = sorted(windows)
        out = []
        for before, start in zip([None, *starts], starts):
            if start in changed or before in changed:
                out.append((key[0], start, windows[start][3], None if before is None else windows[before][3]))
        kept = starts[-keep:]
        state.update(([*kept], *([windows[s][i] for s in kept] for i in range(4))))
        found = pd.DataFrame(out, columns=["symbol", "start", "price", "prev_price"]).astype({"price": "float64", "prev_price": "float64"})
        delta = found["price"] - found["prev_price"]
        pct = (delta / found["prev_price"].where(found["prev_price"] != 0) * 100).astype("float64")
        stamp = lambda x: pd.to_datetime(x, unit="us", utc=True).dt.tz_localize(None)
        yield pd.DataFrame({"symbol": found["symbol"], "window_start": stamp(found["start"]), "window_end": stamp(found["start"] + micros), "price": found["price"], "prev_price": found["prev_price"], "delta": delta, "delta_pct": pct, "trending_up": pct > threshold})

    partial = rows.mapInPandas(summed, "symbol string, start long, n long, at long, id string, price double")
    return partial.groupBy("symbol").applyInPandasWithState(step, _DELTAS, _STATE, "update", GroupStateTimeout.NoTimeout)


def stream_delta_table(ticks: DataFrame, table: str, checkpoint: str, trigger: str | None = "1 hour", every: str = "1 hour", keep: int = 48, label: str = "1h") -> StreamingQuery:
    """Ticks to windows to changed deltas to the delta table, as one job; ``merged_deltas`` reads it."""
    stream = stream_deltas(ticks, every, keep)

    def each(batch: DataFrame, number: int) -> None:
        # a window whose price has come back to the one before must replace its earlier row, so unchanged rows are kept here
        rows = batch.withColumns({"window_label": F.lit(label), "merged_at": F.current_timestamp()})
        rows.write.mode("overwrite").parquet(f"{table}/{_place(batch, number)}")

    writer = stream.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)).start()


def stream_merge_deltas(stream: DataFrame, table: str, checkpoint: str, trigger: str | None = "1 hour", label: str = "1h") -> StreamingQuery:
    """Each batch's changed deltas in a folder of its own; ``merged_deltas`` reads the newest row of each key.

    So a merge writes the batch and not the table.
    """

    def each(batch: DataFrame, number: int) -> None:
        rows = ingest.moved_deltas(batch, label).withColumn("merged_at", F.current_timestamp())
        rows.write.mode("overwrite").parquet(f"{table}/{_place(batch, number)}")

    return _run(stream, each, checkpoint, trigger)


def merged_deltas(spark: SparkSession, table: str, symbols: DataFrame | None = None) -> DataFrame:
    """The delta table: of each key the row that was merged last; of known symbols only, if those are given."""
    rows = spark.read.parquet(table)
    rest = [c for c in rows.columns if c not in (*ingest.DELTA_KEY, "query", "batch", "merged_at")]
    found = rows.groupBy(*ingest.DELTA_KEY).agg(F.max_by(F.struct(*rest), F.struct("merged_at", "batch", F.struct(*rest))).alias("r")).select(*ingest.DELTA_KEY, "r.*")
    return found if symbols is None else ingest.known_symbols(found, symbols)
