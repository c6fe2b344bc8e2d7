"""Substring dedup: FM-indexes of shards, past which the documents stream.

A window is ``window`` consecutive words.  Its minimizer, the least hash of the
runs of ``gram`` words in it, is the same wherever the window stands.  Neighbouring
windows of one minimizer are a segment of a document, and all segments of a
minimizer go to one shard, so a document streams past those shards only that can
hold its windows.  A minimizer that one document alone has needs no shard; a
bitmap of bounded size keeps nearly all of those back.

Of equal texts the one of the smallest doc_id streams for all: the others hold
its windows only, so all of their words go.  A segment that many documents hold is
one row, with the smallest of their ids.  A shard is indexed in parts of about
SHARD words: the FM-index of its segments gives, for each place of a segment, how
many words up to there occur elsewhere too (matching statistics, by backward
search), and for those that reach the window the smallest doc_id among the rows
found.  Minimizers of more than HOT segments give
their windows one by one to shards of their own.  What stands in a smaller doc_id
too comes back to the documents as bits of window starts.

Defined cases: null, empty and blank texts have no words; a null doc_id counts as
larger than all others; rows of one doc_id don't remove each other's words, and
repeated rows each get the same result; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import decontaminate, shared
from .fmindex import FMIndex

WINDOW = 13
#: Words of the runs whose least hash is the minimizer.
GRAM = 6
#: Windows of a segment at most.
RUN = 64
#: Distinct segments of a minimizer at most that are searched as they are.
HOT = 4000
#: Words of an index, about.
SHARD = 400_000
#: Text bytes whose windows are looked at at once.
BLOCK = 1 << 18
#: A null doc_id.
LAST = (1 << 63) - 1
#: For bytes.translate: white space is a blank, all else stays.
SPACES = bytes(32 if c == 32 or 9 <= c <= 13 else c for c in range(256))


def _bodies(docs: DataFrame, text: str) -> DataFrame:
    whole = shared.text_or_empty(text)
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(whole).alias("_h"), whole.cast("binary").alias("body"))


def _runs(words: decontaminate.Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and minimizer of each segment."""
    at, key = words.minimizers(window, gram)
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (key[1:] != key[:-1])]) if len(at) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[new, len(at)])
    cuts = -(-sizes // RUN)
    part = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
    first = at[np.repeat(new, cuts)] + part * RUN
    return first, np.minimum(np.repeat(sizes, cuts) - part * RUN, RUN), key[np.repeat(new, cuts)]


def shared_minimizers(docs: DataFrame, window: int, gram: int, text: str = "text") -> DataFrame:
    """key: the minimizers that documents of different ids have; stored."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, words in decontaminate.pieces(batch, table=SPACES, size=BLOCK):
                first, _, key = _runs(words, window, gram)
                doc = batch.column("doc").to_numpy()[start:stop][np.searchsorted(words.bounds, first, side="right") - 1]
                order = np.lexsort((doc, key))
                key, doc = key[order], doc[order]
                new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
                last = np.r_[new[1:], len(key)] - 1 if len(key) else new
                yield pa.RecordBatch.from_arrays([pa.array(key[new].view(np.int64)), pa.array(doc[new]), pa.array(doc[last])], names=["key", "low", "high"])

    found = _bodies(docs, text).select("doc", "body").mapInArrow(scan, "key long, low long, high long")
    return shared.stored(found.groupBy("key").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select("key"), "minimizers")


def segments(docs: DataFrame, keys: DataFrame, window: int, gram: int, text: str = "text") -> DataFrame:
    """doc, _h, start (word), key, digest and words of every segment whose minimizer may be shared; stored.

    A segment's words have one minimizer, so key and digest name them together.
    """
    bitmap = docs.sparkSession.sparkContext.broadcast(shared.Bitmap.of(keys, "key", 16))

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, _, words in decontaminate.pieces(batch, table=SPACES, size=BLOCK):
                first, n, key = _runs(words, window, gram)
                kept = bitmap.value.has(key)
                first, n, key = first[kept], n[kept], key[kept]
                of = np.searchsorted(words.bounds, first, side="right") - 1
                texts = [words.text(i, j) for i, j in zip(first.tolist(), (first + n + window - 1).tolist(), strict=True)]
                digests = np.fromiter(map(xxhash.xxh3_64_intdigest, texts), np.uint64, len(texts)).view(np.int64)
                row = pa.array(of + start)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc").take(row), batch.column("_h").take(row), pa.array(first - words.bounds[of]), pa.array(key.view(np.int64)), pa.array(digests), pa.array(texts, pa.string())],
                    names=["doc", "_h", "start", "key", "digest", "words"],
                )

    return shared.stored(_bodies(docs, text).mapInArrow(scan, "doc long, _h long, start long, key long, digest long, words string"), "segments")


def first_owners(texts: list[str], own: np.ndarray, window: int) -> list[np.ndarray]:
    """For each window of each text, the least of the ``own`` numbers of the texts that hold it."""
    numbers: dict[str, int] = {}
    split = [x.split(" ") for x in texts]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    symbols = np.fromiter((numbers.setdefault(w, len(numbers) + 1) if w else 0 for words in split for w in (*words, "")), np.int64, int(sizes.sum()) + len(sizes))
    docs, rank = np.unique(own, return_inverse=True)
    owner = np.repeat(rank, sizes + 1)
    index = FMIndex(symbols, owner, window)
    length, low, high = index.statistics(symbols, window, rows=2)  # every text finds itself
    least = owner.copy()
    reached = np.flatnonzero(length == window)
    least[reached] = index.owners.least(low[reached], high[reached])
    ends = np.cumsum(sizes + 1) - 1
    return [docs[least[end - size + window - 1 : end]] for end, size in zip(ends.tolist(), sizes.tolist(), strict=True)]


def searched(table: DataFrame, window: int, shard: int = SHARD) -> DataFrame:
    """key, digest and owners (of each window the smallest doc) of the segments (key, digest, words, low, high) that some document loses words of."""
    n = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = ("key", "digest", "words", "low", "high")
    kind = pa.schema([("key", pa.int64()), ("digest", pa.int64()), ("owners", pa.list_(pa.int64()))])

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def found() -> pa.RecordBatch:
            keys, place, members = np.unique(np.array([r[0] for r in held], np.int64), return_inverse=True, return_counts=True)
            several = np.flatnonzero(members[place] > 1).tolist()  # a minimizer's only segment meets no other
            owners = [np.full(r[2].count(" ") + 2 - window, r[3], np.int64) for r in held]
            low = np.array([held[i][3] for i in several], np.int64)
            for i, own in zip(several, first_owners([held[i][2] for i in several], low, window) if several else [], strict=True):
                owners[i] = own
            lost = [i for i, r in enumerate(held) if (owners[i] < r[4]).any()]
            return pa.RecordBatch.from_pydict({"key": [held[i][0] for i in lost], "digest": [held[i][1] for i in lost], "owners": [owners[i] for i in lost]}, kind)

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if size >= shard and row[0] != held[-1][0]:
                    yield found()
                    held, size = [], 0
                held.append(row)
                size += row[2].count(" ") + 2
        if size:
            yield found()

    return table.select(*columns).repartition(n, "key").sortWithinPartitions("key").mapInArrow(search, "key long, digest long, owners array<long>")


def window_owners(found: DataFrame, window: int, hot: int = HOT) -> DataFrame:
    """key, digest, owners of the distinct segments that lose words somewhere, stored."""
    distinct = found.groupBy("key", "digest", "words").agg(F.min("doc").alias("low"), F.max("doc").alias("high"))
    distinct = shared.stored(distinct, "segments-distinct")
    crowded = shared.stored(distinct.groupBy("key").count().where(F.col("count") > hot).select("key"), "minimizers-hot")
    if crowded.isEmpty():
        return shared.stored(searched(distinct, window), "owners")
    # a hot minimizer's windows, each by itself
    each = F.split("words", " ")
    places = F.sequence(F.lit(1), F.size(each) - (window - 1))
    single = distinct.join(crowded, "key", "left_semi").select("key", "digest", "low", "high", F.posexplode(F.transform(places, lambda i: F.array_join(F.slice(each, i, window), " "))).alias("i", "window"))
    single = shared.stored(single.withColumn("k", F.xxhash64("window")).withColumn("d", F.xxhash64(F.lit(1), "window")), "windows-hot")
    alone = single.groupBy("window", "k", "d").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    table = distinct.join(crowded, "key", "left_anti").unionByName(alone.select(F.col("k").alias("key"), F.col("d").alias("digest"), F.col("window").alias("words"), "low", "high"))
    owners = shared.stored(searched(table, window), "owners")
    of_window = owners.select(F.col("key").alias("k"), F.col("digest").alias("d"), F.col("owners")[0].alias("first"))
    back = single.join(of_window.hint("merge"), ["k", "d"], "left").select("key", "digest", F.struct("i", F.coalesce("first", F.lit(LAST)).alias("first")).alias("at"))
    whole = back.groupBy("key", "digest").agg(F.transform(F.sort_array(F.collect_list("at")), lambda x: x.first).alias("owners"))  # RUN at most
    return shared.stored(owners.unionByName(whole), "owners-all")


def copies(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, _h of the rows whose text stands in a row of a smaller doc_id too; stored."""
    whole = shared.text_or_empty(text)
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    rows = docs.select(order.alias("doc"), F.xxhash64(whole).alias("_h"), F.xxhash64(F.lit(1), whole).alias("_g"))
    first = rows.groupBy("_h", "_g").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high").select("_h", "_g", "low")
    found = rows.join(shared.stored(first, "texts-repeated").hint("merge"), ["_h", "_g"]).where("doc > low").select("doc", "_h").distinct()
    return shared.stored(found.select(F.when(F.col("doc") != LAST, F.col("doc")).alias("doc_id"), "_h"), "copies")


def removals(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT, text: str = "text") -> DataFrame:
    """doc (null: LAST), _h and bits: (word, bits) of the window starts whose words go, 64 to a word, of the documents that lose any.

    Of documents that are copies of others, bits is null: all windows go.
    """
    again = copies(docs, text)
    docs = shared.without(docs.select("doc_id", text), again, text)
    with shared.small_batches(docs.sparkSession):
        found = segments(docs, shared_minimizers(docs, window, gram, text), window, gram, text)
    owners = window_owners(found, window, hot)

    def starts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("owners")
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            of = np.repeat(np.arange(batch.num_rows), sizes)
            place = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            doc, h, start = (batch.column(c).to_numpy() for c in ("doc", "_h", "start"))
            gone = lists.flatten().to_numpy() < doc[of]
            of, at = of[gone], start[of[gone]] + place[gone]
            new = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (at[1:] >> 6 != at[:-1] >> 6)]) if len(of) else np.zeros(0, np.int64)
            bits = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), new) if len(of) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(doc[of[new]]), pa.array(h[of[new]]), pa.array(at[new] >> 6), pa.array(bits.view(np.int64))], names=["doc", "_h", "word", "bits"])

    lost = found.select("doc", "_h", "start", "key", "digest").join(owners.hint("merge"), ["key", "digest"]).select("doc", "_h", "start", "owners")
    words = lost.mapInArrow(starts, "doc long, _h long, word long, bits long").groupBy("doc", "_h", "word").agg(F.bit_or("bits").alias("bits"))
    parts = words.groupBy("doc", "_h").agg(F.collect_list(F.struct("word", "bits")).alias("bits"))
    none = F.lit(None).cast("array<struct<word:long,bits:long>>")
    gone = parts.unionByName(again.select(F.coalesce("doc_id", F.lit(LAST)).alias("doc"), "_h", none.alias("bits")))
    return shared.stored(gone, "removals")


def dedup_substrings(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT, text: str = "text") -> DataFrame:
    """doc_id, text (the words that stay, joined by one space), n_words and n_removed of every document.

    A word goes that is covered by a window whose words stand in a document of a smaller doc_id too.
    """
    gone = removals(docs, window, gram, hot, text)
    marked, touched = shared.maybe_in(_bodies(docs, text), F.xxhash64("doc", "_h"), gone.select(F.xxhash64("doc", "_h").alias("key")))
    bodies = marked.select("doc", "_h", "body", touched.alias("touched"))
    nothing = F.array().cast("array<struct<word:long,bits:long>>")
    same = bodies.where("NOT touched").select("doc", "body", nothing.alias("bits"))
    cut_here = bodies.where("touched").join(gone.withColumn("found", F.lit(True)), ["doc", "_h"], "left")
    both = same.unionByName(cut_here.select("doc", "body", F.when(F.col("found"), F.col("bits")).otherwise(nothing).alias("bits")))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in shared.blocks(np.array([len(x.as_buffer()) for x in batch.column("body")], np.int64)):
                texts, counts = [], []
                for body, bits in zip(batch.column("body").slice(start, stop - start), batch.column("bits").slice(start, stop - start), strict=True):
                    words = body.as_py().split()
                    total = len(words)
                    if not bits.is_valid:
                        words = words if total < window else []
                    elif len(bits):
                        flags = np.zeros(total // 64 + 1, np.uint64)
                        flags[bits.values.field("word").to_numpy()] = bits.values.field("bits").to_numpy().view(np.uint64)
                        begun = np.unpackbits(flags.view(np.uint8), bitorder="little")[:total].astype(np.int64)
                        sums = np.cumsum(begun)
                        sums[window:] -= sums[:-window].copy()
                        words = [words[i] for i in np.flatnonzero(sums == 0).tolist()]
                    texts.append(b" ".join(words).decode())
                    counts.append((total, total - len(words)))
                total, lost = zip(*counts, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("doc").slice(start, stop - start), pa.array(texts, pa.string()), pa.array(total, pa.int64()), pa.array(lost, pa.int64())], names=["doc", "text", "n_words", "n_removed"])

    done = both.mapInArrow(cut, "doc long, text string, n_words long, n_removed long")
    return done.select(F.when(F.col("doc") != LAST, F.col("doc")).alias("doc_id"), "text", "n_words", "n_removed")
