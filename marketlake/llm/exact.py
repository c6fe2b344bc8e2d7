"""Exact duplicates through an extendible-hash index on shared files.

The pseudo-key of a text is the XXH64 of its normalised form.  A directory over
the leading key bits points to buckets; a bucket over capacity splits by its
next bit, and the directory doubles when the bucket is as deep as the directory.
Contiguous bucket ranges belong to owner tasks.  An owner walks its buckets in
key order, chains the entries that share a key, compares their bytes, and so
makes the groups and picks the row of each that stays; it writes them to its
file of the index, and every row looks its own entry up there.

What moves: one small entry for each text of a scan task, with the text's bytes
only where its key occurs more than once.  A key that more than FAN tasks send
is first merged in blocks of about FAN entries, by the same comparison, so that
no owner gets all copies of a text.

Defined cases: a null text counts as empty; among equal rows of one doc_id the
first read stays; a null doc_id comes after all others; other columns and their
names don't matter; an empty table gives an empty result; different texts of one
key, or of one digest, are different groups.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

#: Entries that a bucket holds before it splits.
CAPACITY = 4096
#: The directory never has more than 2 ** MOST_DEPTH slots; deeper buckets chain.
MOST_DEPTH = 20
#: Bytes of texts that a scan task remembers in order not to send one twice.
REMEMBERED = 32 << 20
#: Entries of one key that meet in one task.
FAN = 64
_ENTRY = "ref long, key long, n long, points int, doc_id long, row long, sha string, body binary"
_ROW = "is_row boolean, h long, " + _ENTRY
_FOUND = "ref long, bucket long, key long, chain int, head boolean, keep_id long, keep_row long, group_size long, sha string"


def normalised(text: Column) -> Column:
    """The text without the characters of ``[\\x20\\x09-\\x0D]``."""
    return reduce(lambda c, white: F.replace(c, F.lit(white), F.lit("")), " \n\t\r\x0b\x0c", text)


def pseudo_key(bare: Column) -> Column:
    return F.xxhash64(bare)


def scanned(docs: DataFrame, text: str = "text", key: Callable[[Column], Column] = pseudo_key) -> DataFrame:
    """A row for each document (is_row) and an entry for each text of a scan task, both with its ``ref``; stored.

    An entry has the number of its rows and the best of them (most code points,
    smallest doc_id, first read), and the bytes where the key repeats.
    """
    whole = shared.text_or_empty(text)
    bare = normalised(whole)
    repeated = docs.select(key(bare).alias("key")).groupBy("key").count().where("count > 1").select("key")
    repeated = shared.stored(repeated, "exact-keys")
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(whole).alias("h"), F.length(whole).alias("points"), key(bare).alias("key"), F.sha2(bare, 256).alias("sha"), bare.alias("bare")]
    marked, maybe = shared.maybe_in(docs.select(columns), F.col("key"), repeated)
    rows = marked.select("doc_id", "h", "points", "key", "sha", F.when(maybe, F.col("bare")).cast("binary").alias("body"))
    names = [c.split()[0] for c in _ROW.split(", ")]
    kinds = [pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def record(columns: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=names)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 33
        next_row, held, size = first, {}, 0

        def entries() -> pa.RecordBatch:
            own = [(False, None, ref, k, n, -best[0], best[2], best[3], sha, body) for (k, body), (ref, n, best, sha) in held.items()]
            return record([list(c) for c in zip(*own, strict=True)])

        for batch in batches:
            m = batch.num_rows
            row = np.arange(next_row, next_row + m)
            ref = row.copy()
            next_row += m
            sent = np.flatnonzero(batch.column("body").is_valid().to_numpy(zero_copy_only=False))
            asked = batch.take(pa.array(sent)).to_pydict()
            for i, k, body, points, doc_id, sha in zip(sent.tolist(), asked["key"], asked["body"], asked["points"], asked["doc_id"], asked["sha"], strict=True):
                best = (-points, doc_id is None, doc_id, int(row[i]))
                known = held.get((k, body))
                if known is None:
                    held[k, body] = [int(row[i]), 1, best, sha]
                    size += len(body) + 300
                else:
                    ref[i] = known[0]
                    known[1] += 1
                    known[2] = min(known[2], best)
            alone = np.ones(m, bool)
            alone[sent] = False
            small = [batch.column(c) for c in ("doc_id", "sha")]
            none = pa.nulls(m, pa.binary())
            yield record([np.ones(m, bool), batch.column("h"), ref, batch.column("key"), np.ones(m, np.int64), batch.column("points"), small[0], row, small[1], none])
            own = record([np.zeros(m, bool), batch.column("h"), ref, batch.column("key"), np.ones(m, np.int64), batch.column("points"), small[0], row, small[1], none])
            yield own.filter(pa.array(alone))
            if size > REMEMBERED:
                yield entries()
                held, size = {}, 0
        if held:
            yield entries()

    return shared.stored(rows.mapInArrow(scan, _ROW), "exact-rows")


@dataclass
class Directory:
    """slots[leading bits of a key] is the number of its bucket; buckets are numbered in key order."""

    depth: int
    slots: np.ndarray
    loads: np.ndarray

    def owners(self, n: int) -> np.ndarray:
        """The owner of each bucket: contiguous ranges of about equal load."""
        before = np.cumsum(self.loads) - self.loads
        return np.minimum(n - 1, before * n // max(1, int(self.loads.sum())))

    def table(self, spark, n_owners: int) -> DataFrame:
        """slot, bucket, owner: 2 ** MOST_DEPTH rows at most, so it can be broadcast."""
        owner = self.owners(n_owners)[self.slots]
        return spark.createDataFrame(pd.DataFrame({"slot": np.arange(len(self.slots)), "bucket": self.slots, "owner": owner}), "slot long, bucket long, owner int")


def grow_directory(loads: np.ndarray, capacity: int = CAPACITY) -> Directory:
    """Split overfull buckets, doubling the directory, over the loads of the deepest cells."""
    limit = len(loads).bit_length() - 1
    sums = np.concatenate([[0], np.cumsum(loads)])
    depth, buckets, overfull = 0, [], [(0, 0)]
    while overfull:
        prefix, own = overfull.pop()
        width = 1 << (limit - own)
        load = sums[(prefix + 1) * width] - sums[prefix * width]
        if load > capacity and own < limit:
            depth = max(depth, own + 1)
            overfull += [(2 * prefix + 1, own + 1), (2 * prefix, own + 1)]
        else:
            buckets.append((prefix, own, load))
    spans = [1 << (depth - own) for _, own, _ in buckets]
    return Directory(depth, np.repeat(np.arange(len(buckets)), spans), np.array([x[2] for x in buckets], np.int64))


def slot_of(key: Column, depth: int) -> Column:
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")


def chains(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[tuple[dict, list[list]]]:
    """Runs of rows of one ``key`` in batches sorted by it, chained: [body, rows, best, refs, first row] for each different text."""
    at, chain = None, []
    for batch in batches:
        for r in batch.to_pylist():
            if chain and r[key] != at:
                yield chain
                chain = []
            at = r[key]
            best = (-r["points"], r["doc_id"] is None, r["doc_id"], r["row"])
            for link in chain:
                if link[0] == r["body"]:
                    link[1] += r["n"]
                    link[2] = min(link[2], best)
                    link[3].append(r["ref"])
                    break
            else:
                chain.append([r["body"], r["n"], best, [r["ref"]], r])
    if chain:
        yield chain


def _batches(rows: Iterable[tuple], schema: pa.Schema, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of about ``most`` bytes."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += 120 + sum(len(x) for x in r if isinstance(x, bytes))
        if size > most:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in held], schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in held], schema)


_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}


def _arrow(schema: str) -> pa.Schema:
    return pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in schema.split(", ")])


def premerged(entries: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Entries of keys that more than FAN have, merged in blocks until no key shrinks further; and (ref, rep) of each round."""
    n, moved, before = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")), [], None
    schema = _arrow(_ENTRY + ", rep long")

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for chain in chains(batches, "block"):
                for body, n, best, refs, r in chain:
                    yield (refs[0], r["key"], n, -best[0], best[2], best[3], r["sha"], body, refs[0])
                    yield from ((ref, None, 0, None, None, None, None, None, refs[0]) for ref in refs[1:])

        yield from _batches(rows(), schema)

    while True:
        crowded = shared.stored(entries.where("body IS NOT NULL").groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > FAN), "exact-crowded")
        now = crowded.agg(F.sum("size")).first()[0]
        if now is None or (before is not None and now >= before):
            return entries, moved
        before = now
        block = F.xxhash64("key", F.pmod(F.xxhash64("ref"), F.ceil(F.col("size") / FAN)))
        asked = entries.where("body IS NOT NULL").join(crowded, "key").withColumn("block", block).drop("size")
        # one hash for a key's block: entries of another key that fall together by chance differ in their bytes
        met = asked.repartition(n, "block").sortWithinPartitions("block", "ref").mapInArrow(merge, _ENTRY + ", rep long")
        met = shared.stored(met, "exact-merged")
        moved.append(met.select("ref", "rep"))
        rest = entries.join(crowded, "key", "left_anti")
        entries = rest.unionByName(met.where("ref = rep").drop("rep"))


@dataclass
class Index:
    """The owners' files: a row for each entry, with its bucket, key, place in the key's chain and group; and the directory."""

    found: DataFrame
    directory: Directory

    def find(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """For other documents: the entry of the text of that key and digest, if the index has one."""
        bare = normalised(shared.text_or_empty(text))
        asked = docs.select("doc_id", pseudo_key(bare).alias("key"), F.sha2(bare, 256).alias("sha"))
        return asked.join(self.found.where("head").select("key", "sha", "keep_id", "group_size"), ["key", "sha"], "left")


def build_index(entries: DataFrame, capacity: int = CAPACITY) -> Index:
    """Send the entries to the owners of their buckets, who chain them, and write the owners' files."""
    spark = entries.sparkSession
    entries, moved = premerged(entries)
    limit = min(MOST_DEPTH, max(4, (entries.count() // capacity).bit_length() + 3))
    cells = entries.groupBy(slot_of(F.col("key"), limit).alias("cell")).count().toPandas()  # 2 ** MOST_DEPTH rows at most
    loads = np.zeros(1 << limit, np.int64)
    loads[cells["cell"].to_numpy(np.int64)] = cells["count"].to_numpy(np.int64)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    directory = grow_directory(loads, capacity)
    schema = _arrow(_FOUND)

    def own(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for chain in chains(batches, "key"):
                for at, (_, size, best, refs, r) in enumerate(chain):
                    for ref in refs:
                        yield (ref, r["bucket"], r["key"], at, ref == refs[0], best[2], best[3], size, r["sha"])

        yield from _batches(rows(), schema)

    placed = entries.withColumn("slot", slot_of(F.col("key"), directory.depth)).join(F.broadcast(directory.table(spark, n)), "slot").drop("slot")
    owned = placed.repartitionById(n, F.col("owner")).sortWithinPartitions("bucket", "key", "ref")
    found = shared.stored(owned.mapInArrow(own, _FOUND), "exact-index")
    for names in reversed(moved):
        # what was merged into another entry has that entry's group
        others = names.where("ref <> rep").join(found.withColumnRenamed("ref", "rep"), "rep").drop("rep").withColumn("head", F.lit(False))
        found = shared.stored(found.unionByName(others), "exact-index")
    return Index(found, directory)


def dedup(docs: DataFrame, text: str = "text", capacity: int = CAPACITY, key: Callable[[Column], Column] = pseudo_key) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and the text's hash ``_h`` for every row.

    Of equal texts the row with the most code points stays, then the smallest doc_id.
    """
    rows = scanned(docs, text, key)
    index = build_index(rows.where("NOT is_row").select([c.split()[0] for c in _ENTRY.split(", ")]), capacity)
    own = rows.where("is_row").select("ref", "doc_id", "row", "sha", "h")
    out = own.join(index.found.select("ref", "keep_id", "keep_row", "group_size"), "ref")
    return out.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.col("sha").alias("text_sha256"), F.col("h").alias("_h"))


def deduped(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one of each group, in their own columns."""
    rows = shared.stored(dedup(docs, text).groupBy("doc_id", "_h").agg(F.max("kept").alias("kept"), F.count("*").alias("n")), "exact-identities")
    out = shared.without(docs, rows.where("NOT kept"), text)
    repeated = rows.where("kept AND n > 1").select("doc_id", "_h")
    if repeated.isEmpty():
        return out
    # the very same row more than once: only these are grouped whole
    marked, h = shared.identity(docs, text)
    out_id, out_h = shared.free_name(marked, "_out_id"), shared.free_name(marked, "_out_hash")
    names = repeated.select(F.col("doc_id").alias(out_id), F.col("_h").alias(out_h))
    once = marked.join(names, F.col("doc_id").eqNullSafe(F.col(out_id)) & (F.col(h) == F.col(out_h)), "left_semi").dropDuplicates(["doc_id", h])
    return shared.without(out, repeated, text).unionByName(once.select(docs.columns))
