"""Line dedup: a suffix array over line-ID sequences by distributed prefix doubling.

A document is the sequence of its non-blank lines; a line's id is a 128-bit
digest of its trimmed text, and every line has a position, so that a document is
a range of positions.  Round k ranks the suffixes by their first 2 ** k lines: the
pair of a suffix's rank and the rank 2 ** (k - 1) lines on is sorted and numbered,
and only suffixes that still share their rank go on, until none does.  A suffix
that is alone needs no further rank: the order of all is then known.

Suffixes that share their first d lines are an interval of the suffix array, in
which the longest common prefix is nowhere below d.  Intervals are named from
``least_words`` words on; a member has a later copy of what stands at the
interval's first position where the two don't overlap.  Neighbours that are
copied from neighbours are one run, and the longest common prefix of the two
suffixes, found from the highest power of two down, is its length: a maximal
repeated run.  Later copies are deleted; the earliest, by doc_id and line,
stays, and so does a copy that overlaps it.

Defined cases: null and empty texts have no lines and come back as empty; blank
lines never match, and stay; of repeated rows the later ones lose their runs; a
null doc_id comes after all others; of equal lines one below another the first
``least_words`` words stay; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared

LEAST_WORDS = 50
#: Neighbouring positions meet in blocks of 2 ** BLOCK.
BLOCK = 13
#: A task numbers its lines from here on.
_PER_TASK = 1 << 38


def line_table(rows: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """pos, row, doc_id, line (index among all), left (lines to the end), id, id2, n; stored.

    ``n`` has the numbers of lines from here on of the runs of ``least_words``
    words that are the shortest to start or to end where they do.  Every line of
    a longer run lies in such a run within it.
    """
    kinds = {"pos": pa.int64(), "row": pa.int64(), "doc_id": pa.int64(), "line": pa.int32(), "left": pa.int32(), "id": pa.int64(), "id2": pa.int64(), "n": pa.list_(pa.int32())}
    schema = pa.schema(list(kinds.items()))

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pos = TaskContext.get().partitionId() * _PER_TASK
        for batch in batches:
            out: dict[str, list] = {c: [] for c in kinds}
            for row, doc_id, body in zip(batch.column("_row").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("body"), strict=True):
                kept = [(i, bare) for i, line in enumerate(body.as_py().split(b"\n")) if (bare := line.strip())]
                m = len(kept)
                total = np.concatenate([[0], np.cumsum([len(line.split()) for _, line in kept], dtype=np.int64)])
                ends = np.searchsorted(total, total[:-1] + least_words).tolist()
                starts = (np.searchsorted(total, total[1:] - least_words, side="right") - 1).tolist()
                runs = [[end - i] if end <= m else [] for i, end in enumerate(ends)]
                for i, start in enumerate(starts):
                    if start >= 0 and ends[start] != i + 1:
                        runs[start].append(i + 1 - start)
                digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(line) for _, line in kept), np.int64).reshape(-1, 2)
                out["pos"].append(np.arange(pos, pos + m))
                out["row"].append(np.full(m, row))
                out["doc_id"] += [doc_id] * m
                out["line"].append(np.fromiter((i for i, _ in kept), np.int32, m))
                out["left"].append(np.arange(m, 0, -1))
                out["id"].append(digests[:, 0])
                out["id2"].append(digests[:, 1])
                out["n"] += runs
                pos += m + 1  # the place between two documents has no line, so no run reaches over it
                if len(out["doc_id"]) > 100_000:
                    yield _batch(out)
                    out = {c: [] for c in kinds}
            if out["doc_id"]:
                yield _batch(out)

    def _batch(out: dict[str, list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x if c in ("doc_id", "n") else np.concatenate(x), kinds[c]) for c, x in out.items()], schema=schema)

    bodies = rows.select("_row", F.col("doc_id").cast("long").alias("doc_id"), shared.text_or_empty().cast("binary").alias("body"))
    return shared.stored(bodies.mapInArrow(scan, "pos long, row long, doc_id long, line int, left int, id long, id2 long, n array<int>"), "lines")


def _numbered(keys: DataFrame, *columns: str) -> DataFrame:
    """The distinct rows that occur more than once, with a number that rises with their order."""
    shared_keys = keys.groupBy(*columns).count().where("count > 1").drop("count")
    return shared.stored(shared_keys.orderBy(*columns).withColumn("rank", F.monotonically_increasing_id()), "ranks")


def suffix_ranks(lines: DataFrame) -> list[DataFrame]:
    """For k = 0, 1, ...: pos, doc_id, left, n and rank of the suffixes that share their first 2 ** k lines with another."""
    columns = ["pos", "doc_id", "left", "n"]
    # ranks grow with the corpus, so they are never broadcast
    ranked = shared.stored(lines.select(*columns, "id", "id2").join(_numbered(lines, "id", "id2").hint("merge"), ["id", "id2"]).select(*columns, "rank"), "suffixes")
    levels, reach = [], 1
    while not ranked.isEmpty():
        levels.append(ranked)
        # a position meets the one ``reach`` lines on in its own block
        block = F.array_distinct(F.array(F.shiftright("pos", BLOCK), F.shiftright(F.col("pos") - reach, BLOCK)))
        here = Window.partitionBy("block").orderBy("pos").rangeBetween(reach, reach)
        rows = ranked.select(*columns, F.col("rank").alias("first"), F.explode(block).alias("block")).withColumn("second", F.max("first").over(here))
        pairs = rows.where((F.col("left") >= 2 * reach) & F.col("second").isNotNull() & (F.col("block") == F.shiftright("pos", BLOCK)))
        pairs = shared.stored(pairs.select(*columns, "first", "second"), "suffix-pairs")
        ranked = shared.stored(pairs.join(_numbered(pairs, "first", "second").hint("merge"), ["first", "second"]).select(*columns, "rank"), "suffixes")
        reach *= 2
    return levels


def window_copies(levels: list[DataFrame]) -> DataFrame:
    """pos, n, source: the runs of ``n`` that stand at ``source`` before, by doc_id and line, apart from theirs; stored.

    The ranks of the first and last 2 ** k lines name the interval of a run of n lines.
    """
    found = None
    for k, ranked in enumerate(levels):
        own = ranked.select("pos", "doc_id", F.col("rank").alias("a"), F.explode("n").alias("n")).where(F.col("n").between(1 << k, (2 << k) - 1)).withColumn("at", F.col("pos") + F.col("n") - (1 << k))
        behind = ranked.select(F.col("pos").alias("at"), F.col("rank").alias("b"))
        both = own.join(behind.hint("merge"), "at").select("pos", "doc_id", "n", "a", "b")
        found = both if found is None else found.unionByName(both)
    found = shared.stored(found, "windows")
    key = ["n", "a", "b"]
    earliest = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "pos")).alias("first")
    first = found.groupBy(*key).agg(earliest, F.count("*").alias("copies")).where("copies > 1").select(*key, F.col("first.pos").alias("source"))
    later = found.join(shared.stored(first, "windows-first").hint("merge"), key)
    # a position within the earliest copy is of the same document
    return shared.stored(later.where("source > pos OR source + n <= pos").select("pos", "n", "source"), "window-copies")


def runs_of(copies: DataFrame) -> DataFrame:
    """pos, source, depth: neighbours copied from neighbours as one run; a block's end cuts it."""
    apart = (F.col("pos") - F.col("source")).alias("apart")
    w = Window.partitionBy("block", "apart").orderBy("pos")
    one = copies.groupBy("pos", "source").agg(F.max("n").alias("n")).select("pos", "source", "n", F.shiftright("pos", BLOCK).alias("block"), apart)
    marked = one.withColumn("new", F.when(F.lag("pos").over(w) == F.col("pos") - 1, 0).otherwise(1)).withColumn("run", F.sum("new").over(w))
    ends = marked.groupBy("block", "apart", "run").agg(F.min("pos").alias("pos"), F.min("source").alias("source"), F.max(F.col("pos") + F.col("n")).alias("end"))
    return shared.stored(ends.select("pos", "source", (F.col("end") - F.col("pos")).cast("long").alias("depth")), "runs")


def common_prefixes(runs: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """The same runs, as long as the suffixes at pos and source share their lines without overlapping."""
    shared_lines = runs.select("pos", "source", "depth", F.col("depth").alias("d"))
    for k in range(len(levels) - 1, -1, -1):
        ranked = levels[k].select(F.col("pos").alias("at"), "rank")
        ends = shared_lines.select("pos", "source", F.explode(F.array(F.col("pos") + F.col("d"), F.col("source") + F.col("d"))).alias("at"))
        same = ends.join(ranked.hint("merge"), "at").groupBy("pos", "source").agg((F.count("*") == 2).alias("both"), (F.min("rank") == F.max("rank")).alias("same")).where("both AND same").select("pos", "source", F.lit(1 << k).alias("more"))
        shared_lines = shared.stored(shared_lines.join(same, ["pos", "source"], "left").select("pos", "source", "depth", (F.col("d") + F.coalesce("more", F.lit(0))).alias("d")), "runs")
    apart = F.when(F.col("source") < F.col("pos"), F.least("d", F.col("pos") - F.col("source"))).otherwise(F.col("d"))
    return shared_lines.select("pos", "source", F.greatest("depth", apart).alias("depth"))


def repeated_runs(lines: DataFrame) -> DataFrame:
    """row, doc_id, pos, depth (lines), source (position of the earliest copy) of every maximal later copy."""
    levels = suffix_ranks(lines)
    if not levels:
        return lines.where("false").select("row", "doc_id", "pos", F.col("pos").alias("depth"), F.col("pos").alias("source"))
    found = common_prefixes(runs_of(window_copies(levels)), levels)
    return lines.select("row", "doc_id", "pos").join(found, "pos").select("row", "doc_id", "pos", "depth", "source")


def deletions(lines: DataFrame) -> DataFrame:
    """row, gone: the line numbers to delete, for each row that loses any."""
    end = F.col("pos") + F.col("depth")
    before = Window.partitionBy("row").orderBy("pos", "depth").rowsBetween(Window.unboundedPreceding, -1)
    runs = repeated_runs(lines).withColumn("begin", F.greatest("pos", F.coalesce(F.max(end).over(before), F.lit(0)))).where(F.col("begin") < end)
    at = runs.select(F.explode(F.sequence("begin", end - 1)).alias("pos"))
    return at.join(lines.select("row", "pos", "line"), "pos").groupBy("row").agg(F.sort_array(F.collect_list("line")).alias("gone"))


def dedup_lines(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, text without later copies, n_lines, n_deleted for every document."""
    rows = shared.stored(shared.with_row_id(docs.select(F.col("doc_id").cast("long").alias("doc_id"), shared.text_or_empty().alias("text"))), "line-docs")
    gone = shared.stored(deletions(line_table(rows, least_words)).withColumnRenamed("row", "_row"), "line-deletions")
    each = F.split("text", "\n", -1)
    kept = F.array_join(F.filter(each, lambda _, i: ~F.array_contains("gone", i)), "\n")
    # texts that lose nothing stay where they are
    marked, touched = shared.maybe_in(rows, F.col("_row"), gone.select(F.col("_row").alias("key")))
    n_lines = F.when(F.col("text") == "", 0).otherwise(F.size(each)).cast("long").alias("n_lines")
    same = marked.where(~touched).select("doc_id", "text", n_lines, F.lit(0).cast("long").alias("n_deleted"))
    cut = marked.where(touched).join(gone, "_row", "left").select("doc_id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("text"), n_lines, F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_deleted"))
    return same.unionByName(cut)
