"""Importance resampling towards a target distribution: array-scored weights and a distributed quickselect.

Features are runs of 1 to 2 consecutive words, hashed into ``buckets``.  A
bucket's gain is the log ratio of its smoothed shares in the target and in the
corpus, in thousandths; all gains are one array that goes to every task.  A
document's weight is the mean gain of its features, and with a Gumbel draw of its
doc_id added, the highest scores are a sample without replacement in proportion
to exp(weight / 1000).

The k-th highest score is found by quickselect: some pivot keys are drawn from the
rows still in question, one pass counts what lies below and at each of them, and
only the rows between two neighbouring pivots go on.  Keys are (score, doc_id,
hash of the text, row), so no two are equal and exactly k rows win.  The winners
alone are sorted and ranked.

Defined cases: a null or wordless text has no features and weight 0; a null doc_id
draws like the text "7:" and comes after all others of its score; repeated rows
each take part; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain, repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

#: Text bytes whose words are listed at once.
PIECE = 1 << 20
#: Pivot keys of a round.
PIVOTS = 15
#: The columns of a row's key, all long: lower comes first.
KEY = ["lost", "no_id", "id", "tie", "row"]


def word_lists(text: bytes, piece: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text, some at a time."""
    text, start = text.translate(shared.WORD_BYTES), 0
    while start < len(text):
        stop = text.find(b" ", start + piece)
        stop = len(text) if stop < 0 else stop
        if words := text[start:stop].split():
            yield words
        start = stop


def features(text: bytes, buckets: int, piece: int = PIECE) -> Iterator[tuple[int, np.ndarray]]:
    """The number of words and the buckets of the features of each part of a text; a pair's hash goes on from its first word's."""
    before: list[int] = []
    for words in word_lists(text, piece):
        single = list(map(crc32, words))
        firsts = map(crc32, repeat(b" "), before + single)
        pairs = map(crc32, words if before else words[1:], firsts)
        yield len(words), np.fromiter(chain(single, pairs), np.uint32) % np.uint32(buckets)
        before = single[-1:]


def _bodies(docs: DataFrame, text: str, *columns: Column) -> DataFrame:
    return docs.select(*columns, shared.text_or_empty(text).cast("binary").alias("body"))


def bucket_counts(docs: DataFrame, buckets: int, text: str = "text") -> np.ndarray:
    """How many features of all texts fall in each bucket: a sum for each task, added up by Spark."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for body in batch.column("body"):
                for _, found in features(body.as_py(), buckets):
                    total += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    found = _bodies(docs, text).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(buckets, np.int64)
    out[found["bucket"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket, the floored thousandths of the log ratio of the smoothed shares."""
    n = len(corpus)
    ratio = (target + 1.0) * (float(corpus.sum()) + n) / ((corpus + 1.0) * (float(target.sum()) + n))
    return np.floor(1000.0 * np.log(ratio)).astype(np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, text: str = "text") -> DataFrame:
    """row, doc_id, tie (hash of the text), n_words, n_features and weight of every document."""
    shared_gain = docs.sparkSession.sparkContext.broadcast(gain)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared_gain.value
        for batch in batches:
            sums = np.zeros((3, batch.num_rows), np.int64)
            for i, body in enumerate(batch.column("body")):
                for n_words, found in features(body.as_py(), len(gain)):
                    sums[:, i] += n_words, len(found), gain[found].sum()
            weight = np.floor_divide(sums[2], np.maximum(sums[1], 1))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "doc_id", "tie")), pa.array(sums[0]), pa.array(sums[1]), pa.array(weight)], names=["row", "doc_id", "tie", "n_words", "n_features", "weight"])

    rows = _bodies(docs, text, F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(shared.text_or_empty(text)).alias("tie"))
    return rows.mapInArrow(scan, "row long, doc_id long, tie long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int = 7) -> Column:
    """A Gumbel draw in floored thousandths, the same for the same doc_id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def smallest(rows: DataFrame, key: list[str], k: int, pivots: int = PIVOTS) -> DataFrame:
    """The ``k`` rows of smallest ``key``, by quickselect; keys are long, never null and all different."""
    place = F.struct(*key)
    at = lambda values: F.struct(*(F.lit(v).cast("long").alias(c) for c, v in zip(key, values, strict=True)))
    active, left, turn = rows, k, 0
    if k <= 0:
        return rows.where("false")
    while True:
        turn += 1
        drawn = active.orderBy(F.xxhash64(F.lit(turn), *key), *key).limit(pivots).select(*key).collect()  # ``pivots`` rows at most
        drawn = sorted(tuple(r) for r in drawn)
        if not drawn:  # there are fewer than k rows
            return rows
        parts = active.agg(*(e for p in drawn for e in (F.count_if(place < at(p)), F.count_if(place == at(p))))).first()
        below, equal = parts[0::2], parts[1::2]
        low = high = None
        for p, less, same in zip(drawn, below, equal, strict=True):
            if less < left <= less + same:
                return rows.where(place <= at(p))
            if less + same < left:
                low, passed = p, less + same
            elif high is None:
                high = p
        if low is not None:
            active, left = active.where((F.col(key[0]) >= low[0]) & (place > at(low))), left - passed
        if high is not None:
            active = active.where((F.col(key[0]) <= high[0]) & (place < at(high)))


def ranked(rows: DataFrame, key: list[str]) -> DataFrame:
    """The ``key`` columns with their rank 1, 2, 3 ...: sorted in ranges, each range going on where the one before ends."""
    placed = shared.stored(rows.select(*key).orderBy(*key).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_at", 33)
    # a row for each range, of which there are as many as shuffle partitions
    starts, done = [], 0
    for number, n in sorted(placed.groupBy(part.alias("part")).count().collect()):
        starts.append((number, done))
        done += n
    starts = rows.sparkSession.createDataFrame(starts, "part long, before long")
    within = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("part", part).join(F.broadcast(starts), "part").select(*key, (F.col("before") + within + 1).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, buckets: int = 10_000, least_words: int = 20, percent: int = 25, seed: int = 7, text: str = "text") -> DataFrame:
    """row, doc_id, n_words, n_features, weight, score and rank (null where not drawn) of every document.

    Of the N documents of ``least_words`` words, ``percent * N // 100`` are drawn.
    """
    gain = gains(bucket_counts(docs, buckets, text), bucket_counts(target, buckets, text))
    scored = weighted(docs, gain, text).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    scored = shared.stored(scored, "scored")
    fit = scored.where(F.col("n_words") >= least_words)
    keyed = fit.select((-F.col("score")).alias("lost"), F.col("doc_id").isNull().cast("long").alias("no_id"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"), "tie", "row")
    drawn = ranked(smallest(keyed, KEY, percent * fit.count() // 100), KEY).select("row", "rank")
    return scored.join(drawn, "row", "left").select("row", "doc_id", "n_words", "n_features", "weight", "score", "rank")
