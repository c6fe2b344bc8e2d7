"""Cleaning of raw records, rejects, and merges into the tick, delta and symbol tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import exprs


def ensure_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add what is absent (name -> type) as null."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})


def normalize_tick(raw: DataFrame) -> DataFrame:
    """Raw records of any producer as tick columns, numbers cast leniently, with id and date."""
    rows = ensure_columns(raw, {c.split()[0]: "string" for c in schemas.RAW.split(", ")})
    rows = rows.withColumn("id", exprs.with_id("json"))
    out = rows.select(
        "id", exprs.clean_text(exprs.first_filled("name", "title")).alias("name"), exprs.clean_text("url").alias("url"), exprs.clean_text("source").alias("source"), "published_at", "fetched_at", exprs.clean_text("symbol").alias("symbol"),
        exprs.to_number(exprs.first_filled("price", "price_usd")).alias("price"), exprs.to_number(exprs.first_filled("market_cap", "market_cap_usd")).alias("market_cap"), exprs.to_number("volume_24h").alias("volume_24h"), exprs.to_number("coin_circulating").alias("coin_circulating"),
    )
    return out.withColumn("date", exprs.partition_date())


def require_market_fields(df: DataFrame) -> DataFrame:
    return df.dropna(subset=["price", "volume_24h", "coin_circulating"])


def split_valid(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid articles, rejects): valid ones have strict UTC times; a reject keeps its time text in _corrupt_record."""
    rows = ensure_columns(raw, {c.split()[0]: "string" for c in schemas.NEWS.split(", ")})
    rows = rows.withColumns({c: exprs.clean_text(c) for c in ("title", "url", "source")}).withColumn("id", exprs.with_id("url_title"))
    rows = rows.withColumn("ts", exprs.parse_strict_utc("published_at"))
    valid = rows.where("ts IS NOT NULL").select(
        "id", "ts", F.to_date("ts").alias("date"), "title", "url", "source", F.coalesce(exprs.parse_strict_utc("fetched_at"), F.col("ts")).alias("fetched_at"),
        "symbol", exprs.to_number("price_usd").alias("price_usd"), exprs.to_number("market_cap_usd").alias("market_cap_usd"),
    )
    rejects = rows.where("ts IS NULL").withColumn("_corrupt_record", F.col("published_at")).drop("ts")
    return valid, rejects


def validate_articles(raw: DataFrame) -> DataFrame:
    """Articles with title, source and both dates; source lower-cased, blank content null."""
    rows = ensure_columns(raw, {c.split()[0]: "string" for c in schemas.NEWS.split(", ")})
    rows = rows.withColumns({"title": exprs.blank_to_null("title"), "source": F.lower(exprs.blank_to_null("source")), "content": exprs.blank_to_null("content")})
    rows = rows.withColumns({"published_at": exprs.parse_flexible_utc("published_at"), "fetched_at": exprs.parse_flexible_utc("fetched_at")})
    kept = rows.where("title IS NOT NULL AND source IS NOT NULL AND published_at IS NOT NULL AND fetched_at IS NOT NULL")
    return kept.withColumn("id", F.coalesce(F.nullif("id", F.lit("")), exprs.article_id("folded"))).select("id", "title", "url", "source", "published_at", "fetched_at", "content")


def filter_ticks(ticks: DataFrame, symbol: str | None = None, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """A symbol in any case and calendar dates, both included."""
    if symbol is not None:
        ticks = ticks.where(F.upper("symbol") == symbol.upper())
    if date_from is not None:
        ticks = ticks.where(F.to_date("fetched_at") >= F.lit(date_from).cast("date"))
    if date_to is not None:
        ticks = ticks.where(F.to_date("fetched_at") <= F.lit(date_to).cast("date"))
    return ticks


def _one_per_id(batch: DataFrame) -> DataFrame:
    rest = F.struct(*(c for c in batch.columns if c != "id"))
    return batch.groupBy("id").agg(F.max_by(rest, F.struct("fetched_at", rest)).alias("r")).select("id", "r.*").select(batch.columns)


def merge_ticks(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """The batch's rows to append: with volume and supply, one for each id, of ids that aren't there yet.

    The table is reduced to the batch's ids first, for which Spark sends a small
    batch to the table's files; so history is read, one column of it, but not
    shuffled.  Where an id is bound to its date, pass the dates of ``existing``
    that the batch has, and the others aren't read.
    """
    usable = batch.dropna(subset=["volume_24h", "coin_circulating"])
    seen = existing.select("id").join(usable.select("id"), "id", "left_semi")
    return _one_per_id(usable).join(seen, "id", "left_anti")


def upsert_ticks(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """The whole table after the batch: of each id the newest row."""
    return _one_per_id(existing.unionByName(batch.dropna(subset=["volume_24h", "coin_circulating"])))


DELTA_KEY = ["symbol", "window_start", "window_label"]


def moved_deltas(batch: DataFrame, label: str = "1h") -> DataFrame:
    """Rows whose price changed, with the label."""
    return batch.where("delta IS NOT NULL AND delta_pct IS NOT NULL AND delta <> 0 AND delta_pct <> 0").withColumn("window_label", F.lit(label))


def merge_deltas(existing: DataFrame, batch: DataFrame, label: str = "1h") -> DataFrame:
    """The delta table after the batch: changed rows only, the batch's row for a key that is there already."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(moved_deltas(batch, label).withColumn("_new", F.lit(1)))
    rest = [c for c in both.columns if c not in (*DELTA_KEY, "_new")]
    out = both.groupBy(*DELTA_KEY).agg(F.max_by(F.struct(*rest), F.struct("_new", F.struct(*rest))).alias("r"))
    return out.select(*DELTA_KEY, "r.*").select(existing.columns)


def new_symbols(batch: DataFrame) -> DataFrame:
    """The keys of a batch's symbols, once each."""
    return batch.select(exprs.symbol_key().alias("symbol")).where("symbol IS NOT NULL").distinct()


def merge_symbols(dimension: DataFrame, batch: DataFrame) -> DataFrame:
    """The symbol column after the batch: what was there and every new key."""
    return dimension.select("symbol").union(new_symbols(batch).join(dimension.select("symbol"), "symbol", "left_anti"))


def known_symbols(deltas: DataFrame, dimension: DataFrame) -> DataFrame:
    return deltas.join(dimension.select("symbol"), "symbol", "left_semi")
