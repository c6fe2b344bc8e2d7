"""A random forest of two classes, whose large nodes are split from counts and whose subtrees are grown in tasks.

Values are bins of at most BINS quantiles.  Nodes of more than SUBTREE_ROWS rows
are split level by level: tasks count their rows by node, feature, bin and label,
the sums give the splits.  Rows of a smaller node then move once, to the task
that grows all that is below.  So work and what moves grow with rows times trees,
not with nodes times tasks.  How often a tree's bootstrap sample holds a row, and
which features a node may use, are hashes, so that trees depend neither on the
partitions nor on where a node is split.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.util import MLWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import new_path, stored

BINS = 32
#: Rows of a node, repeats included, whose subtree one task grows.
SUBTREE_ROWS = 65_536
#: Nodes whose counts are evaluated at once.
NODES_EACH = 512
#: Rows of a task that are looked at together.
CHUNK = 65_536
#: Gains up to this one are rounding.
NO_GAIN = 1e-12
NODE = "tree int, node int, feature int, cut int, gain double, c0 long, c1 long"
#: How often a bootstrap sample holds a row (Poisson of mean 1), by 16 random bits.
TIMES = np.searchsorted(np.cumsum(np.exp(-1) / np.cumprod([1, 1, 2, 3, 4, 5, 6, 7, 8])), (np.arange(65536) + 0.5) / 65536).astype(np.uint8)


@dataclass(frozen=True)
class Plan:
    """What every node's split depends on."""

    trees: int
    depth: int
    least: int
    chosen: int
    features: int
    weights: tuple[float, float]
    seed: int

    @property
    def cells(self) -> int:
        """Counts of a node."""
        return self.chosen * BINS * 2


def _mixed(x: np.ndarray) -> np.ndarray:
    """Well mixed 64 bits (splitmix64)."""
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def draws(keys: np.ndarray, trees: int) -> np.ndarray:
    """How often the sample of each tree (column) holds each row."""
    words = _mixed(keys.view(np.uint64)[:, None] + np.arange(-(-trees // 4), dtype=np.uint64))
    return TIMES[words.view(np.uint16)][:, :trees]


def choices(plan: Plan, tree: int, nodes: np.ndarray) -> np.ndarray:
    """The features that each of a tree's nodes may use, in order."""
    keys = _mixed(nodes.astype(np.uint64) + np.uint64((plan.seed % 2**24 << 40) + (tree << 32 & (1 << 40) - 1)))
    order = np.argsort(_mixed(keys[:, None] + np.arange(plan.features, dtype=np.uint64)), axis=1)
    return np.sort(order[:, : plan.chosen], axis=1)


def node_counts(plan: Plan, x: np.ndarray, rows: np.ndarray, label: np.ndarray, times: np.ndarray, slot: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Of ``rows`` of bins with their labels, repeats and slots: the counts of each slot by chosen feature, bin and label."""
    flat, start, size = x.reshape(-1), rows * x.shape[1], len(chosen) * plan.cells
    base, times, counts = slot * plan.cells + label, times.astype(float), np.zeros(size)
    for j in range(plan.chosen):
        bins = flat.take(start + chosen[:, j].take(slot))
        counts += np.bincount(base + (2 * j * BINS + np.multiply(bins, 2, dtype=np.int64)), times, size)
    return counts.reshape(len(chosen), plan.chosen, BINS, 2)


def best_splits(plan: Plan, counts: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """feature (-1: none), last bin to the left, gain of weighted Gini impurity, and counts to the left."""
    total, left = counts[:, 0].sum(1), counts.cumsum(2)[:, :, :-1]

    def mass(c):  # impurity times weight
        a, b = c[..., 0] * plan.weights[0], c[..., 1] * plan.weights[1]
        return 2 * a * b / np.maximum(a + b, 1e-300)

    right = total[:, None, None] - left
    enough = (left.sum(-1) >= plan.least) & (right.sum(-1) >= plan.least)
    gain = np.where(enough, mass(total)[:, None, None] - mass(left) - mass(right), 0).reshape(len(counts), -1)
    best, row = gain.argmax(1), np.arange(len(counts))
    gain = gain[row, best] / np.maximum(total @ np.array(plan.weights), 1e-300)
    j, cut = best // (BINS - 1), best % (BINS - 1)
    return np.where(gain > NO_GAIN, chosen[row, j], -1), cut, gain, left[row, j, cut]


def may_split(plan: Plan, nodes: np.ndarray, totals: np.ndarray) -> np.ndarray:
    return (totals.min(1) > 0) & (totals.sum(1) >= 2 * plan.least) & (nodes < 1 << plan.depth)


def subtree(plan: Plan, tree: int, root: int, x: np.ndarray, label: np.ndarray, times: np.ndarray) -> list[tuple]:
    """Arrays (node, feature, cut, gain, counts) of all nodes from ``root`` on, a level at a time."""
    out, nodes, totals = [], np.array([root]), np.bincount(label, times, 2)[None, :]
    rows, slot = np.arange(len(x)), np.zeros(len(x), np.int64)
    while len(nodes):
        may = may_split(plan, nodes, totals)
        feature, cut, gain, left = np.full(len(nodes), -1), np.zeros(len(nodes), np.int64), np.zeros(len(nodes)), np.zeros((len(nodes), 2))
        open_, stays = np.flatnonzero(may), may[slot]
        rows, slot = rows[stays], (may.cumsum() - 1)[slot[stays]]
        for i in range(0, len(open_), NODES_EACH):  # rows are in the order of their slots
            some = open_[i : i + NODES_EACH]
            a, b = np.searchsorted(slot, [i, i + len(some)])
            chosen, r = choices(plan, tree, nodes[some]), rows[a:b]
            feature[some], cut[some], gain[some], left[some] = best_splits(plan, node_counts(plan, x, r, label[r], times[r], slot[a:b] - i, chosen), chosen)
        out.append((nodes, feature, cut, gain, totals))
        split = feature >= 0
        slot = open_[slot]
        rows, slot = rows[split[slot]], slot[split[slot]]
        slot = 2 * (split.cumsum() - 1)[slot] + (x[rows, feature.take(slot)] > cut.take(slot))
        order = np.argsort(slot.astype(np.uint16), kind="stable")
        rows, slot = rows[order], slot[order]
        nodes = (2 * nodes[split][:, None] + np.arange(2)).ravel()
        totals = np.stack([left[split], totals[split] - left[split]], 1).reshape(-1, 2)
    return out


def node_of(x: np.ndarray, rows: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """Where ``rows`` of bins come to in a tree of arrays by node, where feature -1 ends a path."""
    node, flat, start = np.ones(len(rows), np.int64), x.reshape(-1), rows * x.shape[1]
    for _ in range(levels):
        f = feature.take(node)
        node = np.where(f >= 0, 2 * node + (flat.take(start + np.maximum(f, 0)) > cut.take(node)), node)
    return node


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _chunks(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Bins, labels and draws of CHUNK rows or more at once."""
    held = []
    for batch in itertools.chain(batches, [None]):
        held += [batch] if batch is not None else []
        if held and (batch is None or sum(b.num_rows for b in held) >= CHUNK):
            table, held = pa.Table.from_batches(held).combine_chunks(), []
            yield _matrix(table["bins"], plan.features), table["label"].to_numpy().astype(np.int64), draws(table["key"].to_numpy(), plan.trees)


def _nodes_table(tree: int, parts: list[tuple]) -> pa.Table:
    node, feature, cut, gain, c = (np.concatenate(p) for p in zip(*parts, strict=True))
    arrays = [np.full(len(node), tree, np.int32), node.astype(np.int32), feature.astype(np.int32), cut.astype(np.int32), gain, c[:, 0].astype(np.int64), c[:, 1].astype(np.int64)]
    return pa.table([pa.array(a) for a in arrays], ["tree", "node", "feature", "cut", "gain", "c0", "c1"])


def to_bins(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """The number of thresholds below each value."""
    return np.stack([np.searchsorted(c, x[:, i]) for i, c in enumerate(cuts)], 1).astype(np.uint8)


def binned(rows: DataFrame, columns: int, key: str) -> tuple[DataFrame, list[np.ndarray]]:
    """part, label, key and the bins of ``features`` as bytes; and each feature's thresholds."""
    rows = rows.withColumn("_x", vector_to_array("features"))
    shares = [i / BINS for i in range(1, BINS)]
    found = rows.where("part = 0").agg(*(F.percentile_approx(F.col("_x")[i], shares, 10_000).alias(f"q{i}") for i in range(columns))).first()
    cuts = [np.unique(found[i]) for i in range(columns)]

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = to_bins(batch["_x"].flatten().to_numpy().reshape(-1, columns), cuts)
            yield pa.RecordBatch.from_arrays([batch["part"], batch["label"], batch[key], pa.array([r.tobytes() for r in bins], pa.binary())], ["part", "label", "key", "bins"])

    rows = rows.select("part", F.col("label").cast("int").alias("label"), key, "_x")
    return stored(rows.mapInArrow(convert, "part int, label int, key long, bins binary"), "forest-rows"), cuts


def _split_level(rows: DataFrame, plan: Plan, feature: np.ndarray, cut: np.ndarray, levels: int, open_: dict[int, np.ndarray]):
    """Splits of the open nodes (of each tree, in order) as pandas rows of NODE and counts to the left."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = {t: choices(plan, t, nodes) for t, nodes in open_.items()}
        sums = {t: np.zeros((len(nodes), plan.chosen, BINS, 2)) for t, nodes in open_.items()}
        for x, label, times in _chunks(batches, plan):
            for t, nodes in open_.items():
                r = np.flatnonzero(times[:, t])
                at = node_of(x, r, feature[t], cut[t], levels)
                slot = np.minimum(np.searchsorted(nodes, at), len(nodes) - 1)
                here = nodes[slot] == at
                r, slot = r[here], slot[here]
                sums[t] += node_counts(plan, x, r, label[r], times[r, t], slot, chosen[t])
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.astype(np.int64).tobytes() for s in sums.values()], pa.binary())], ["tree", "counts"])

    def split(key: tuple, table: pa.Table) -> pa.Table:
        tree = key[0].as_py()
        counts = sum(np.frombuffer(b, np.int64) for b in table["counts"].to_pylist()).reshape(-1, plan.chosen, BINS, 2)
        f, c, gain, left = best_splits(plan, counts, choices(plan, tree, open_[tree]))
        out = _nodes_table(tree, [(open_[tree], f, c, gain, counts[:, 0].sum(1))])
        return out.append_column("l0", pa.array(left[:, 0].astype(np.int64))).append_column("l1", pa.array(left[:, 1].astype(np.int64)))

    return rows.mapInArrow(count, "tree int, counts binary").groupBy("tree").applyInArrow(split, f"{NODE}, l0 long, l1 long").toPandas()


def grow(rows: DataFrame, n: int, plan: Plan, megabytes: int) -> DataFrame:
    """All nodes of all trees from ``rows`` (label, key, bins; n of them), numbered 1 and 2 i, 2 i + 1 below node i."""
    feature, cut, moves = np.full((plan.trees, 2), -1, np.int16), np.zeros((plan.trees, 2), np.uint8), np.zeros((plan.trees, 2), bool)
    open_ = {t: np.array([1]) for t in range(plan.trees)} if n > SUBTREE_ROWS else {}
    moves[:, 1] = not open_
    top, levels = [], 0
    while open_:
        wider = lambda a, fill: np.concatenate([a, np.full_like(a, fill)], 1)
        grown, groups, held = [], [{}], 0
        for t, nodes in open_.items():  # as many trees at once as their counts fit
            held += len(nodes) * plan.cells * 8
            if held > megabytes << 20 and groups[-1]:
                groups.append({})
                held = len(nodes) * plan.cells * 8
            groups[-1][t] = nodes
        for group in groups:
            grown.append(_split_level(rows, plan, feature, cut, levels, group))
        feature, cut, moves, open_, levels = wider(feature, -1), wider(cut, 0), wider(moves, False), {}, levels + 1
        for pdf in grown:
            for tree, own in pdf.sort_values(["tree", "node"]).groupby("tree"):
                nodes, f, totals, left = own.node.to_numpy(), own.feature.to_numpy(), own[["c0", "c1"]].to_numpy(), own[["l0", "l1"]].to_numpy()
                top.append(_nodes_table(tree, [(nodes, f, own.cut.to_numpy(), own.gain.to_numpy(), totals)]))
                feature[tree, nodes], cut[tree, nodes] = f, own.cut
                s = f >= 0
                below = (2 * nodes[s][:, None] + np.arange(2)).ravel()
                counts = np.stack([left[s], totals[s] - left[s]], 1).reshape(-1, 2)
                may = may_split(plan, below, counts)
                large = may & (counts.sum(1) > SUBTREE_ROWS)
                moves[tree, below[may & ~large]] = True
                leaves, zero = ~may, np.zeros((~may).sum())
                if leaves.any():
                    top.append(_nodes_table(tree, [(below[leaves], zero - 1, zero, zero, counts[leaves])]))
                if large.any():
                    open_[tree] = below[large]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, label, times in _chunks(batches, plan):
            for t in range(plan.trees):
                r = np.flatnonzero(times[:, t])
                at = node_of(x, r, feature[t], cut[t], levels)
                r, at = r[moves[t, at]], at[moves[t, at]]
                order = np.argsort(at, kind="stable")
                r, at = r[order], at[order]
                nodes, first, lengths = np.unique(at, return_index=True, return_counts=True)
                own = np.column_stack([x[r], (times[r, t] * 2 + label[r]).astype(np.uint8)])
                packed = [pa.compress(own[a : a + n].tobytes(), "zstd", asbytes=True) for a, n in zip(first, lengths, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(nodes), t, np.int32)), pa.array(nodes.astype(np.int32)), pa.array(lengths.astype(np.int32)), pa.array(packed, pa.binary())], ["tree", "node", "n", "rows"])

    def finish(key: tuple, table: pa.Table) -> pa.Table:
        width, tree, root = plan.features + 1, key[0].as_py(), key[1].as_py()
        blocks = zip(table["rows"].to_pylist(), table["n"].to_pylist(), strict=True)
        x = np.frombuffer(b"".join(pa.decompress(b, n * width, "zstd", asbytes=True) for b, n in blocks), np.uint8).reshape(-1, width)
        return _nodes_table(tree, subtree(plan, tree, root, x, (x[:, -1] & 1).astype(np.int64), x[:, -1] >> 1))

    below = rows.mapInArrow(send, "tree int, node int, n int, rows binary").groupBy("tree", "node").applyInArrow(finish, NODE)
    nodes = stored(below.unionByName(rows.sparkSession.createDataFrame(pa.concat_tables(top))) if top else below, "forest-nodes")
    # a sample that holds no row at all is a leaf without counts
    missing = set(range(plan.trees)) - {r.tree for r in nodes.select("tree").distinct().collect()}
    return nodes.union(rows.sparkSession.createDataFrame([(t, 1, -1, 0, 0.0, 0, 0) for t in missing], NODE)) if missing else nodes


def pruned(nodes: np.ndarray, feature: np.ndarray, up: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of a tree's nodes (in order) stay, and their features, where leaves side by side that say the same become one."""
    feature, stays = feature.copy(), np.ones(len(nodes), bool)
    for level in range(depth - 1, -1, -1):
        own = np.flatnonzero((nodes >= 1 << level) & (nodes < 2 << level) & (feature >= 0))
        left = np.searchsorted(nodes, 2 * nodes[own])
        same = (feature[left] < 0) & (feature[left + 1] < 0) & (up[left] == up[left + 1])
        feature[own[same]] = -1
        stays[left[same]] = stays[left[same] + 1] = False
    return stays, feature


def numbered(nodes: DataFrame, plan: Plan, cuts: list[np.ndarray]) -> DataFrame:
    """The trees' nodes after pruning, ids from 0 on in each tree, with children, threshold, class weights (a, b) and gain."""

    def tree_rows(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        node, feature, cut, gain, c0, c1 = (table[c].to_numpy() for c in ("node", "feature", "cut", "gain", "c0", "c1"))
        stays, feature = pruned(node, feature, c1 * plan.weights[1] > c0 * plan.weights[0], plan.depth)
        node, feature, cut, gain, c0, c1 = (v[stays] for v in (node, feature, cut, gain, c0, c1))
        inner = feature >= 0
        left = np.where(inner, np.searchsorted(node, 2 * node), -1).astype(np.int32)
        threshold = [cuts[f][c] if f >= 0 else 0.0 for f, c in zip(feature.tolist(), cut.tolist(), strict=True)]
        arrays = [np.full(len(node), key[0].as_py(), np.int32), np.arange(len(node), dtype=np.int32), left, feature, cut, threshold, c0 * plan.weights[0], c1 * plan.weights[1], c0 + c1, np.where(inner, gain, -1.0)]
        return pa.table([pa.array(v) for v in arrays], ["tree", "id", "left", "feature", "cut", "threshold", "a", "b", "n", "gain"])

    return stored(nodes.groupBy("tree").applyInArrow(tree_rows, "tree int, id int, left int, feature int, cut int, threshold double, a double, b double, n long, gain double"), "forest-trees")


def importances(trees: DataFrame, features: int) -> list[float]:
    """Each feature's share of the gains: shares within a tree, and the trees' mean."""
    found = trees.where("feature >= 0").groupBy("tree", "feature").agg(F.sum(F.col("gain") * (F.col("a") + F.col("b"))).alias("gain")).collect()
    gains = np.zeros((max((r.tree for r in found), default=0) + 1, features))
    for r in found:
        gains[r.tree, r.feature] = r.gain
    shares = (gains / np.maximum(gains.sum(1, keepdims=True), 1e-300)).sum(0)
    return (shares / max(shares.sum(), 1e-300)).tolist()


class GrownForest(Model, MLWritable):
    """The trees as a stage that predicts; Spark's own model of them is loaded when something else is asked for.

    The driver holds some 15 bytes for a node, as arrays, until then.
    """

    def __init__(self, trees: DataFrame, plan: Plan, cuts: list[np.ndarray], estimator: RandomForestClassifier):
        super().__init__()
        self._held = {"trees": trees, "plan": plan, "cuts": cuts, "estimator": estimator}

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        return getattr(self.as_spark(), name)

    def write(self):
        return self.as_spark().write()

    def as_spark(self) -> RandomForestClassificationModel:
        held = self._held
        if "model" not in held:
            held["model"] = RandomForestClassificationModel.load(saved(held["trees"], held["plan"], held["estimator"]))
        return held["model"]

    def _arrays(self):
        """feature, cut, child to the left and lead of class 1 (-1 to 1) by node, of each tree."""
        held = self._held
        if "arrays" not in held:
            lead = (F.col("b") - F.col("a")) / F.greatest(F.col("a") + F.col("b"), F.lit(1e-300))
            table = held["trees"].select("tree", "id", "left", F.col("feature").cast("short").alias("feature"), F.col("cut").cast("byte").alias("cut"), lead.alias("lead")).toArrow()
            order = np.lexsort((table["id"].to_numpy(), table["tree"].to_numpy()))
            ends = np.cumsum(np.bincount(table["tree"].to_numpy()))
            columns = [np.split(table[c].to_numpy()[order], ends[:-1]) for c in ("feature", "cut", "left", "lead")]
            held["arrays"] = held["trees"].sparkSession.sparkContext.broadcast(list(zip(*columns, strict=True)))
        return held["arrays"]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        plan, cuts, arrays = self._held["plan"], self._held["cuts"], self._arrays()

        @F.pandas_udf("double")
        def lead(x: pd.Series) -> pd.Series:
            return pd.Series(leads(plan, to_bins(np.stack(x.to_numpy()), cuts), arrays.value) if len(x) else [], dtype=float)

        rows = dataset.withColumn("_lead", lead(vector_to_array("features")))
        share = (1 + F.col("_lead") / plan.trees) / 2
        both = lambda c, total: array_to_vector(F.array(total - c, c))
        return rows.withColumns({"rawPrediction": both(share * plan.trees, F.lit(float(plan.trees))), "probability": both(share, F.lit(1.0)), "prediction": (F.col("_lead") > 0).cast("double")}).drop("_lead")

    def verdicts(self, rows: DataFrame) -> DataFrame:
        """Of rows of ``binned``: part, label, prediction and how many rows."""
        plan, arrays = self._held["plan"], self._arrays()

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                up = leads(plan, _matrix(batch["bins"], plan.features), arrays.value) > 0
                yield pa.RecordBatch.from_arrays([batch["part"], batch["label"], pa.array(up.astype(np.int32))], ["part", "label", "prediction"])

        return rows.mapInArrow(count, "part int, label int, prediction int").groupBy("part", "label", "prediction").agg(F.count("*").alias("n"))


def leads(plan: Plan, x: np.ndarray, arrays: list[tuple]) -> np.ndarray:
    """Summed over the trees, by how much class 1 leads in the leaf of each row of bins."""
    total, flat, start = np.zeros(len(x)), x.reshape(-1), np.arange(len(x)) * plan.features
    for feature, cut, left, lead in arrays:
        at = np.zeros(len(x), np.int64)
        for _ in range(plan.depth):
            f = feature.take(at)
            at = np.where(f >= 0, left.take(at) + (flat.take(start + np.maximum(f, 0)) > cut.take(at)), at)
        total += lead.take(at)
    return total


def saved(trees: DataFrame, plan: Plan, estimator: RandomForestClassifier) -> str:
    """Where the trees are saved as Spark's own model: the form of the estimator's stumps, with these nodes in their place."""
    spark, path = trees.sparkSession, new_path(trees.sparkSession, "forest-model")
    two = spark.createDataFrame([(Vectors.dense([0.0] * plan.features), label, 1.0) for label in (0.0, 1.0)], ["features", "label", estimator.getWeightCol()])
    estimator.fit(two, {estimator.maxDepth: 0}).save(f"{path}/stumps")
    deep = lambda c: F.regexp_replace(c, '"maxDepth":0', f'"maxDepth":{plan.depth}')
    inner, share = F.col("feature") >= 0, F.col("a") / F.greatest(F.col("a") + F.col("b"), F.lit(1e-300))
    split = F.struct("feature", F.when(inner, F.array("threshold")).otherwise(F.array().cast("array<double>")), F.lit(-1))
    node = F.struct("id", (F.col("b") > F.col("a")).cast("double"), 2 * share * (1 - share), F.array("a", "b"), "n", "gain", "left", F.when(inner, F.col("left") + 1).otherwise(-1), split)
    form = spark.read.parquet(f"{path}/stumps/data").schema
    trees.select(F.col("tree").alias("treeID"), node.cast(form["nodeData"].dataType).alias("nodeData")).write.parquet(f"{path}/trees/data")
    about = spark.read.parquet(f"{path}/stumps/treesMetadata")
    about.withColumn(about.columns[1], deep(about.columns[1])).coalesce(1).write.parquet(f"{path}/trees/treesMetadata")
    spark.read.text(f"{path}/stumps/metadata").select(deep("value")).coalesce(1).write.text(f"{path}/trees/metadata")
    return f"{path}/trees"
