"""What the operators share: tables in the shared folder, row identities, and filters of bounded size."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import new_path, shared_dir, stored

__all__ = ["Bitmap", "blocks", "free_name", "identity", "maybe_in", "new_path", "shared_dir", "stored", "text_or_empty", "with_row_id", "without"]

#: Text bytes that a Python task works on at once.
TEXT_BLOCK = 4 << 20
#: For bytes.translate: lower-cases A-Z and blanks all ASCII but digits and letters, so that split() gives words of digits, letters and non-ASCII characters.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def with_row_id(df: DataFrame, name: str = "_row") -> DataFrame:
    """A number for each row; store the frame before it is used twice."""
    return df.withColumn(name, F.monotonically_increasing_id())


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def blocks(lengths: np.ndarray, size: int = TEXT_BLOCK) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes, at least one row each."""
    start, n = 0, len(lengths)
    ends = np.cumsum(lengths)
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + size, side="right")))
        yield start, stop
        start = stop


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Jobs that run within send texts to Python in batches of so many rows: less memory for a task's buffers on either side."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: A bitmap never takes more bits than this (16 MB).
BITMAP_BITS = 1 << 27
#: Words of a bitmap that come to the driver as one row.
CHUNK = 1 << 13
_MIX = 0x9E3779B97F4A7C15


class Bitmap:
    """A one-hash filter over 64-bit keys, of a size that doesn't grow beyond BITMAP_BITS.

    It may let foreign keys pass, never holds a key back; what passes is checked
    by a join afterwards.  Each task sets bits, Spark ORs the words and lays them
    end to end in chunks, and at most BITMAP_BITS / 8 bytes reach the driver.
    """

    def __init__(self, words: np.ndarray) -> None:
        self.words = words
        self.shift = np.uint64(64 - int(len(words) * 64).bit_length() + 1)

    @classmethod
    def of(cls, keys: DataFrame, column: str, per_key: int = 64) -> Bitmap:
        n = keys.count()
        bits = 1 << 16
        while bits < min(n * per_key, BITMAP_BITS):
            bits *= 2
        shift = 64 - bits.bit_length() + 1

        def place(batches):
            import pyarrow as pa

            for batch in batches:
                key = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), np.int64).view(np.uint64)
                at = (key * np.uint64(_MIX)) >> np.uint64(shift)
                word, bit = (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63))
                order = np.argsort(word, kind="stable")
                word, bit = word[order], bit[order]
                first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else np.zeros(0, np.int64)
                ored = np.bitwise_or.reduceat(bit, first).view(np.int64) if len(word) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(word[first]), pa.array(ored)], names=["word", "bits"])

        rows = keys.select(F.col(column).cast("long")).where(F.col(column).isNotNull()).mapInArrow(place, "word long, bits long")

        def chunks(batches):
            import pyarrow as pa

            held: dict[int, np.ndarray] = {}
            for batch in batches:
                word, ored = batch.column("word").to_numpy(), batch.column("bits").to_numpy()
                for chunk in np.unique(word // CHUNK).tolist():
                    here = word // CHUNK == chunk
                    held.setdefault(chunk, np.zeros(CHUNK, np.int64))[word[here] % CHUNK] = ored[here]
            for chunk, content in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([content.tobytes()], pa.binary())], names=["chunk", "content"])

        ored = rows.groupBy("word").agg(F.bit_or("bits").alias("bits")).repartition(F.floor(F.col("word") / CHUNK))
        words = np.zeros(max(bits // 64, CHUNK), np.uint64)
        for chunk, content in ored.mapInArrow(chunks, "chunk long, content binary").collect():
            words[chunk * CHUNK : (chunk + 1) * CHUNK] = np.frombuffer(content, np.uint64)
        return cls(words[: bits // 64])

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = (keys.astype(np.uint64, copy=False) * np.uint64(_MIX)) >> self.shift
        return (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def maybe_in(df: DataFrame, key: Column, keys: DataFrame, per_key: int = 16) -> tuple[DataFrame, Column]:
    """``df`` with helper columns, and a condition on it: may ``key`` be among the 64-bit ``keys`` (column key).

    The same filter as a Bitmap, within the JVM: its words are at most
    BITMAP_BITS / 64 rows, which is what is broadcast however many keys there are.
    """
    n, size = keys.count(), 16
    while (1 << size) < min(n * per_key, BITMAP_BITS):
        size += 1
    placed = lambda k: (F.shiftrightunsigned(F.xxhash64(k), 64 - size + 6), F.shiftrightunsigned(F.xxhash64(k), 64 - size).bitwiseAND(F.lit(63)).cast("int"))
    word, bit, bits = (free_name(df, c) for c in ("_word", "_bit", "_bits"))
    own_word, own_bit = placed(F.col("key"))
    words = keys.select(own_word.alias(word), own_bit.alias(bit)).groupBy(word).agg(F.bit_or(F.expr(f"shiftleft(1L, {bit})")).alias(bits))
    key_word, key_bit = placed(key)
    joined = df.withColumn(word, key_word).withColumn(bit, key_bit).join(F.broadcast(words), word, "left")
    return joined, F.coalesce(F.expr(f"shiftrightunsigned({bits}, {bit}) & 1") == 1, F.lit(False))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with more underscores where the frame has such a column."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def identity(docs: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """The rows of ``docs`` with a hash of their text, and that column's free name.

    doc_id and this hash tell rows apart across two reads of a table, in which
    row numbers need not agree.
    """
    name = free_name(docs, "_text_hash")
    return docs.withColumn(name, F.xxhash64(text_or_empty(text))), name


def without(docs: DataFrame, losers: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``losers`` (doc_id, _h) doesn't name, in the columns of ``docs``.

    Only rows that a bitmap of bounded size lets pass take part in the join, so
    the texts of most documents stay where they are.
    """
    losers = losers.select("doc_id", "_h").distinct()
    marked, h = identity(docs, text)
    marked, touched = maybe_in(marked, F.xxhash64(F.col("doc_id"), F.col(h)), losers.select(F.xxhash64("doc_id", "_h").alias("key")))
    same = marked.where(~touched).select(docs.columns)
    out_id, out_h = free_name(marked, "_out_id"), free_name(marked, "_out_hash")
    out = losers.select(F.col("doc_id").alias(out_id), F.col("_h").alias(out_h))
    cut = marked.where(touched).join(out, (F.col(h) == F.col(out_h)) & F.col("doc_id").eqNullSafe(F.col(out_id)), "left_anti")
    return same.unionByName(cut.select(docs.columns))
