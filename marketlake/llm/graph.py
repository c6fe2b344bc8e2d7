"""Connected components of an edge table by stars within tasks and alternating star contractions."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: Edges that a task turns into stars at once.
AT_ONCE = 1 << 20
#: So many edges at most are one task's.
ROWS_EACH = 100_000


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for each node of the edges but the roots, the smallest nodes of their components: fewer edges than nodes."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    low, high = np.minimum(ends[: len(a)], ends[len(a) :]), np.maximum(ends[: len(a)], ends[len(a) :])
    root = np.arange(len(nodes))
    while len(low):
        np.minimum.at(root, high, low)
        while (further := root[root]).tobytes() != root.tobytes():
            root = further
        low, high = np.minimum(root[low], root[high]), np.maximum(root[low], root[high])
        low, high = low[low != high], high[low != high]
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def thinned(edges: DataFrame, tasks: int) -> DataFrame:
    """Edges (a > b) of the same components: the stars of what each of ``tasks`` tasks has, a larger node's edges together."""

    def thin(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= AT_ONCE:
                yield joined(held)
                held, n = [], 0
        if n:
            yield joined(held)

    def joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        found = stars(*(np.concatenate([x.column(c).to_numpy() for x in held]) for c in ("a", "b")))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["a", "b"])

    dealt = edges.select("a", "b").repartition(tasks, "a") if tasks > 1 else edges.select("a", "b").coalesce(1)
    return dealt.mapInArrow(thin, "a long, b long")


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", F.lit(1), "a"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of the edges (a, b); root is the smallest node that can be reached.

    Tasks first turn the edges they have into stars, so that texts which link in
    many ways leave about an edge each; what fits one task of ROWS_EACH edges is
    done then.  Of more, each round is two grouped minima, joined back and written
    to the shared folder.  A hub's edges meet only in a minimum that is taken on
    both sides of the shuffle, and in a join that Spark can split.
    """
    low, high = F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")
    edges = shared.stored(edges.where("a <> b").select(high, low).distinct(), "edges")  # a > b
    n, tasks = edges.count(), None
    while tasks != 1:
        tasks, more = n // ROWS_EACH + 1, n
        edges = shared.stored(thinned(edges, tasks), "edges", n)
        n = edges.count()
        if tasks != 1 and 2 * n > more:
            break
    before = None
    while tasks != 1 and (now := _signature(edges)) != before:
        before = now
        # every larger neighbour moves to the smallest neighbour
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        least = shared.stored(least, "least", 2 * now[0])  # so that the join stands alone and a hub's edges can be split
        edges = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # every smaller neighbour, and the node itself, moves to the smallest neighbour
        edges = shared.stored(edges, "edges", now[0])
        least = shared.stored(edges.groupBy("a").agg(F.min("b").alias("m")), "least", now[0])
        moved = edges.join(least, "a").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        edges = shared.stored(moved.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "edges", now[0])
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
