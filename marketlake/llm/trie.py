"""A prefix trie of conversations, with count-min screening of prefix digests.

A node is a sequence of first turns; its digest is the XOR of 128-bit hashes of
its (place, role, text), so that prefixes come from running sums within blocks of
a conversation and carries between blocks, however long one is.  Texts never
move, only digests of turns do.

Every task counts its prefix digests in a small count-min sketch of two rows of
counters that stop at two; Spark adds the sketches up.  A digest that some row
counts once is a singleton for certain: its node has one conversation, and the row
is emitted where it stands.  Only prefixes that may be shared are shuffled and
grouped exactly.  Beyond some 10^7 prefixes the sketch, whose size is bounded, lets
more and more singletons pass to the grouping; the nodes stay the same.

A node's subtree is summed along conversations, without walking the trie: every
leaf is counted by the smallest conversation that ends in it in all its prefixes,
and every node's savings are counted by its smallest member likewise.

Defined cases: null roles and texts are empty; a null turn comes first; turns of
the same number are ordered by a digest of role and text; repeated rows are
repeated turns; rows without a conv_id belong to no conversation; an empty table
gives no nodes; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared

#: Running sums go over blocks of so many turns.
BLOCK = 4096
#: Ids of so wide a range of a node's ends are joined at once.
IDS = 256
#: Counters of a row of the sketch never take more bits than this for each plane (8 MB).
SKETCH_BITS = 1 << 26
_MIX = np.uint64(0x9E3779B97F4A7C15)
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def numbered(conversations: DataFrame) -> DataFrame:
    """conv, pos (from 1), t1, t2 (digest of role and text) and words of every turn, stored.

    Turns are sorted in ranges, and a range goes on counting a conversation where the ones before end.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    half = lambda start: F.conv(F.substring(digest, start, 15), 16, 10).cast("long")
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), half(1).alias("t1"), half(16).alias("t2"), words.alias("words"), F.monotonically_increasing_id().alias("row"))
    placed = rows.orderBy("conv", F.asc_nulls_first("turn"), "t1", "t2", "row").select("conv", "t1", "t2", "words", F.monotonically_increasing_id().alias("at"))
    placed = shared.stored(placed, "turns-sorted").withColumn("part", F.shiftright("at", 33))
    spans = placed.groupBy("conv", "part").agg(F.min("at").alias("start"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.select("conv", "part", (F.coalesce(before, F.lit(0)) - F.col("start") + 1).alias("shift"))
    return shared.stored(placed.join(spans, ["conv", "part"]).select("conv", (F.col("at") + F.col("shift")).alias("pos"), "t1", "t2", "words"), "turns")


def spliced(turns: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like the one before them whose id is a multiple of ``every``: (turns, conversations with their length).

    The first h turns come from there, h being the hash of the id modulo ``most``, and take the place of as many own ones.
    """
    lengths = shared.stored(turns.groupBy("conv").agg(F.max("pos").alias("own")), "lengths")
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % most
    bases = lengths.select(F.col("conv").alias("base"), F.col("own").alias("base_own"))
    known = lengths.select("conv", "own", h.alias("h"), (F.col("conv") - F.col("conv") % every).alias("base")).join(bases, "base", "left")
    known = known.withColumn("taken", F.least("h", F.coalesce("base_own", F.lit(0)))).withColumn("len", F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    known = shared.stored(known.select("conv", "base", "h", "taken", "len"), "lengths-spliced")
    own = turns.join(known.hint("merge"), "conv").where("pos > h").select("conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "t1", "t2", "words", "len")
    heads = turns.where((F.col("pos") < most) & (F.col("conv") % every == 0)).select(F.col("conv").alias("base"), "pos", "t1", "t2", "words")
    first = known.join(heads.hint("merge"), "base").where("pos <= taken").select("conv", "pos", "t1", "t2", "words", "len")
    return own.unionByName(first), known.select("conv", "len")


def whole(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations as they are: (turns, conversations with their length)."""
    lengths = shared.stored(turns.groupBy("conv").agg(F.max("pos").alias("len")), "lengths")
    return turns.join(lengths.hint("merge"), "conv"), lengths


def _carried(rows: DataFrame, columns: list[str], fold, backwards: bool = False) -> DataFrame:
    """``rows`` (conv, pos) with running folds of ``columns`` along each conversation, in blocks with carries."""
    rows = rows.withColumn("block", F.floor((F.col("pos") - 1) / BLOCK))
    order = F.desc if backwards else F.asc
    within = Window.partitionBy("conv", "block").orderBy(order("pos")).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv").orderBy(order("block")).rowsBetween(Window.unboundedPreceding, -1)
    # one row for each block of the conversations that have several
    long = rows.where(F.col("pos") > BLOCK).select("conv").distinct()
    sums = rows.join(long, "conv", "left_semi").groupBy("conv", "block").agg(*(fold(c).alias(c) for c in columns))
    carry = sums.select("conv", "block", *(fold(c).over(before).alias(f"_{c}") for c in columns))
    running = rows.select(*(c for c in rows.columns if c not in columns), *(fold(c).over(within).alias(c) for c in columns))
    joined = running.join(carry, ["conv", "block"], "left")
    both = (lambda a, b: a.bitwiseXOR(b)) if fold is F.bit_xor else (lambda a, b: a + b)
    return joined.select(*(c for c in running.columns if c not in ("block", *columns)), *(both(F.col(c), F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in columns))


def prefixes(turns: DataFrame) -> DataFrame:
    """conv, depth, len, words, p1, p2 (digest of the first ``depth`` turns) and q1, q2 (of those but the last), stored."""
    each = turns.select("conv", "pos", "len", "words", F.xxhash64("t1", "t2", "pos").alias("e1"), F.xxhash64(F.lit(1), "t1", "t2", "pos").alias("e2"))
    running = _carried(each.withColumn("p1", F.col("e1")).withColumn("p2", F.col("e2")), ["p1", "p2"], F.bit_xor)
    parent = [F.col(p).bitwiseXOR(F.col(e)).alias(q) for p, e, q in (("p1", "e1", "q1"), ("p2", "e2", "q2"))]
    return shared.stored(running.select("conv", F.col("pos").alias("depth"), "len", "words", "p1", "p2", *parent), "prefixes")


def count_min(keys: DataFrame, columns: tuple[str, str]) -> list[np.ndarray]:
    """For both columns, the cells that count two or more of ``keys``, as bits: a count-min sketch whose counters stop at two."""
    n, bits = keys.count(), 1 << 16
    while bits < min(16 * n, SKETCH_BITS):
        bits *= 2
    size, shift = bits // 64, np.uint64(64 - bits.bit_length() + 1)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(2 * size, np.uint64), np.zeros(2 * size, np.uint64)
        for batch in batches:
            for r, column in enumerate(columns):
                cell, times = np.unique(batch.column(column).to_numpy().view(np.uint64) * _MIX >> shift, return_counts=True)
                word, bit = (cell >> np.uint64(6)).astype(np.int64) + r * size, np.uint64(1) << (cell & np.uint64(63))
                again = (times > 1) | (once[word] & bit != 0)
                np.bitwise_or.at(twice, word[again], bit[again])
                np.bitwise_or.at(once, word, bit)
        at = np.flatnonzero(once)
        for start in range(0, len(at), 100_000):
            some = at[start : start + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(once[some].view(np.int64)), pa.array(twice[some].view(np.int64))], names=["word", "once", "twice"])

    def added(a, b):
        return F.struct(a.once.bitwiseOR(b.once).alias("once"), a.twice.bitwiseOR(b.twice).bitwiseOR(a.once.bitwiseAND(b.once)).alias("twice"))

    nothing = F.struct(F.lit(0).cast("long").alias("once"), F.lit(0).cast("long").alias("twice"))
    words = keys.select(*columns).mapInArrow(count, "word long, once long, twice long")
    # a word has one row for each task at most
    total = words.groupBy("word").agg(F.aggregate(F.collect_list(F.struct("once", "twice")), nothing, added, lambda a: a.twice).alias("twice"))
    found = total.where("twice <> 0").toPandas()  # 2 * SKETCH_BITS / 64 rows at most
    out = np.zeros(2 * size, np.uint64)
    out[found["word"].to_numpy(np.int64)] = found["twice"].to_numpy(np.int64).view(np.uint64)
    return [out[:size], out[size:]]


def screened(rows: DataFrame) -> DataFrame:
    """The prefixes with ``single`` and ``parent_single``: one conversation has it for certain; stored."""
    sketch = rows.sparkSession.sparkContext.broadcast(count_min(rows, ("p1", "p2")))

    def ones(keys: list[np.ndarray]) -> np.ndarray:
        out = np.zeros(len(keys[0]), bool)
        for twice, key in zip(sketch.value, keys, strict=True):
            cell = key.view(np.uint64) * _MIX >> np.uint64(64 - (len(twice) * 64).bit_length() + 1)
            out |= twice[(cell >> np.uint64(6)).astype(np.int64)] >> (cell & np.uint64(63)) & np.uint64(1) == 0
        return out

    def mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = lambda *names: ones([batch.column(c).to_numpy() for c in names])  # noqa: E731, B023
            parent = of("q1", "q2") & (batch.column("depth").to_numpy() > 1)  # the root is everyone's
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(of("p1", "p2")), pa.array(parent)], names=[*batch.schema.names, "single", "parent_single"])

    schema = ", ".join(f"{c} long" for c in rows.columns) + ", single boolean, parent_single boolean"
    return shared.stored(rows.mapInArrow(mark, schema), "prefixes-screened")


def ends_digests(ends: DataFrame) -> DataFrame:
    """p1, p2, ends_sha256: the SHA-256 of each node's conv_ids, ascending and comma-joined; a node's ids pass by in blocks."""
    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    listed = F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    blocks = ends.groupBy("p1", "p2", F.floor(F.col("conv") / IDS).alias("block")).agg(listed.alias("ids"))

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, out = None, None, []
        for batch in batches:
            for p1, p2, ids in zip(*(batch.column(c).to_pylist() for c in ("p1", "p2", "ids")), strict=True):
                if node == (p1, p2):
                    state.update(b"," + ids.encode())
                    continue
                if node is not None:
                    out.append((*node, state.hexdigest()))
                node, state = (p1, p2), hashlib.sha256(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=["p1", "p2", "ends_sha256"])
                out = []
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, state.hexdigest())], names=["p1", "p2", "ends_sha256"])

    return blocks.repartition(n, "p1", "p2").sortWithinPartitions("p1", "p2", "block").select("p1", "p2", "ids").mapInArrow(digest, "p1 long, p2 long, ends_sha256 string")


def prefix_trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of every node.

    ``turns``: conv, pos, t1, t2, words, len; ``conversations``: conv, len of all, those without turns too.
    """
    spark = turns.sparkSession
    root = conversations.agg(F.min("conv").alias("first"), F.count("*").alias("n")).first()
    if not root.n:
        return spark.createDataFrame([], NODE)
    rows = screened(prefixes(turns))
    key, nothing = ["p1", "p2"], hashlib.sha256().hexdigest()

    # only what may be shared is grouped
    shared_rows = rows.where("NOT single").select("conv", "depth", "len", "words", "p1", "p2", "q1", "q2")
    nodes = shared_rows.groupBy(*key).agg(F.min("conv").alias("first"), F.count("*").alias("n"), F.count_if(F.col("depth") == F.col("len")).alias("ended"), *(F.min(c).alias(c) for c in ("depth", "words", "q1", "q2")))
    nodes = shared.stored(nodes, "nodes")
    member = shared.stored(shared_rows.select("conv", "depth", "len", "words", *key).join(nodes.select(*key, "first", "n", "ended").hint("merge"), key), "members")

    # tails
    tail = rows.where("single")
    boundary = tail.where("NOT parent_single")
    above = member.select("conv", (F.col("depth") + 1).alias("depth"), "first")
    named = boundary.join(above.hint("merge"), ["conv", "depth"], "left").select("conv", "depth", "len", F.coalesce("first", F.lit(root.first)).alias("parent"))
    named = named.unionByName(tail.where("parent_single").select("conv", "depth", "len", F.col("conv").alias("parent")))
    ends = F.col("depth") == F.col("len")
    one = F.lit(1).cast("long")
    tails = named.select(F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), one.alias("n_convs"), F.when(ends, 0).otherwise(1).cast("long").alias("n_children"), one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.when(ends, F.sha2(F.col("conv").cast("string").cast("binary"), 256)).otherwise(nothing).alias("ends_sha256"))

    # subtree sums, along conversations
    leaf = tail.where(ends).select("conv").unionByName(member.where(ends & (F.col("n") == F.col("ended")) & (F.col("conv") == F.col("first"))).select("conv"))
    leaf = shared.stored(leaf, "leaves")
    own = member.select("conv", F.col("depth").alias("pos"), *key, F.when(F.col("conv") == F.col("first"), (F.col("n") - 1) * F.col("words")).otherwise(0).alias("saved"))
    none = F.lit(0).cast("long")
    parts = nodes.where("depth > 1").select(F.col("q1").alias("p1"), F.col("q2").alias("p2"), one.alias("children"), none.alias("leaves"), none.alias("saved"))
    parts = parts.unionByName(boundary.where("depth > 1").select(F.col("q1").alias("p1"), F.col("q2").alias("p2"), one.alias("children"), none.alias("leaves"), none.alias("saved")))
    parts = parts.unionByName(member.join(leaf.hint("merge"), "conv", "left_semi").select(*key, none.alias("children"), one.alias("leaves"), none.alias("saved")))
    parts = parts.unionByName(_carried(own, ["saved"], F.sum, backwards=True).where("saved > 0").select(*key, none.alias("children"), none.alias("leaves"), F.col("saved")))
    sums = parts.groupBy(*key).agg(*(F.sum(c).alias(c) for c in ("children", "leaves", "saved")))
    ended = member.where(ends).select("conv", *key)
    digests = ends_digests(ended.unionByName(conversations.where("len = 0").select("conv", none.alias("p1"), none.alias("p2"))))
    digests = shared.stored(digests, "node-ends")
    # the sketch may pass a node that one conversation has though its parent is a singleton: the parent is that conversation's too
    parents = nodes.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("first").alias("parent"))
    found = nodes.join(sums, key, "left").join(digests, key, "left").join(parents.hint("merge"), ["q1", "q2"], "left")
    count = lambda c: F.coalesce(c, F.lit(0)).alias
    inner = found.select(F.col("first").alias("conv_id"), "depth", F.when(F.col("depth") == 1, root.first).otherwise(F.coalesce("parent", "first")).alias("parent_conv_id"), F.col("n").alias("n_convs"), count("children")("n_children"), count("leaves")("n_leaves"), count("saved")("saved_tokens"), F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))

    # the root
    n_children = nodes.where("depth = 1").count() + tail.where("depth = 1").count()
    saved = nodes.agg(F.sum((F.col("n") - 1) * F.col("words"))).first()[0] or 0
    at_root = digests.where("p1 = 0 AND p2 = 0").first()
    top = (root.first, 0, None, root.n, n_children, max(leaf.count(), 1), saved, at_root.ends_sha256 if at_root else nothing)
    return spark.createDataFrame([top], NODE).unionByName(inner).unionByName(tails)
