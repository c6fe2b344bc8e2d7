"""Quality scores: ridge regression on random Fourier features, then isotonic calibration.

Each text becomes a vector of statistics of its characters, words and lines.
Random Fourier features of the standardised vector approximate a Gaussian
kernel; every partition sums its part of the normal equations, Spark adds the
parts cell by cell, and the driver solves a system of fixed size.  Isotonic
regression over a fixed number of score bins makes scores probabilities.

Training takes a bounded sample of labelled rows (``sample``, by hash of the
doc_id); means and deviations come from all documents.

Defined cases: null and empty texts are scored from all-zero statistics; rows
without a doc_id are scored, never learned from; if no row is labelled every
score is 0.5; repeated rows get equal scores; extra columns are ignored.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

#: Labelled rows to learn from at most.
SAMPLE = 200_000
COMPONENTS = 128
BINS = 1024
_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "space": b" \t\n\r\x0b\x0c",
    "stops": b".,;:?",
    "shout": b"!",
    "signs": b"#$%&*@^~",
    "frames": b"|<>{}[]()/\\=_+-\"'`",
    "high": bytes(range(128, 256)),
}
_SHARES = np.zeros((256, len(_CLASSES)))
for _i, _c in enumerate(_CLASSES.values()):
    _SHARES[list(_c), _i] = 1
NAMES = [*_CLASSES, "bytes", "words", "word_length", "word_spread", "distinct", "top_word", "echo", "lines", "line_copies", "line_length", "line_starts"]


def statistics(text: bytes) -> np.ndarray:
    """The vector of NAMES; zeros for a text without words."""
    words = text.split()
    if not words:
        return np.zeros(len(NAMES))
    n = len(words)
    shares = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _SHARES / len(text)
    lengths = np.fromiter(map(len, words), float, n)
    counts = Counter(words)
    lines = [line for line in text.split(b"\n") if line.strip()]
    opens = sum(line[:1].isupper() for line in lines) / len(lines)
    rest = [
        np.log1p(len(text)), np.log1p(n), lengths.mean(), lengths.std(),
        np.log1p(len(counts)) / np.log1p(n), max(counts.values()) / n, sum(map(operator.eq, words, words[1:])) / n,
        np.log1p(len(lines)), 1 - len(set(lines)) / len(lines), np.log1p(len(text) / len(lines)), opens,
    ]
    return np.concatenate([shares, rest])


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and the statistics x of every document, stored."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([statistics(t.as_py()) for t in batch.column("body")]) if batch.num_rows else np.zeros((0, len(NAMES)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(NAMES), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], names=["doc_id", "x"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), shared.text_or_empty(text).cast("binary").alias("body"))
    return shared.stored(rows.mapInArrow(scan, "doc_id long, x array<double>"), "statistics")


def fold(doc_id: Column | str) -> Column:
    """crc32 of the doc_id as text, mod 3; rows of fold 1 are held out."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 if isinstance(doc_id, str) else F.crc32(doc_id.cast("string").cast("binary")) % 3


def training_labels(labels: DataFrame, column: str, sample: int) -> DataFrame:
    """doc_id, y: at most ``sample`` labelled rows outside the held-out fold, chosen by hash."""
    known = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).where(fold("doc_id") != 1)
    one = known.groupBy("doc_id").agg(F.max(column).cast("double").alias("y"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)


class Kernel:
    """Standardisation and random Fourier features of fixed seed."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, components: int = COMPONENTS, seed: int = 7) -> None:
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, 1.0)
        rng = np.random.default_rng(seed)
        self.frequencies = rng.normal(0, 1 / np.sqrt(len(mean)), (len(mean), components))
        self.phases = rng.uniform(0, 2 * np.pi, components)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -5, 5)
        waves = np.cos(z @ self.frequencies + self.phases) * np.sqrt(2 / len(self.phases))
        return np.hstack([waves, np.ones((len(x), 1))])


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)


def isotonic(scores: np.ndarray, hits: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: block centres and their rising means."""
    blocks: list[list[float]] = []
    for s, h, w in zip(scores, hits, weights, strict=True):
        blocks.append([s * w, h, w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


class Model:
    def __init__(self, kernel: Kernel, weights: np.ndarray, centres: np.ndarray, means: np.ndarray) -> None:
        self.kernel, self.weights, self.centres, self.means = kernel, weights, centres, means

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.kernel(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.raw(x)
        if not len(self.centres):
            return np.full(len(x), 0.5)
        # a trace of the raw score keeps the order within a block
        return 0.999 * np.interp(raw, self.centres, self.means) + 0.001 / (1 + np.exp(-np.clip(4 * raw - 2, -30, 30)))


def fit(stats: DataFrame, labels: DataFrame, column: str = "quality", sample: int = SAMPLE, ridge: float = 1e-3) -> Model:
    spark, width = stats.sparkSession, len(NAMES)
    moments = stats.select([F.expr(f"avg(x[{i}])").alias(f"m{i}") for i in range(width)] + [F.expr(f"stddev_pop(x[{i}])").alias(f"s{i}") for i in range(width)]).first()
    found = np.array([0.0 if v is None else v for v in moments])
    kernel = Kernel(found[:width], found[width:])
    chosen = F.broadcast(training_labels(labels, column, sample))  # two numbers for each of ``sample`` rows at most: some 30 bytes each in a broadcast, 6 MB in all
    rows = shared.stored(stats.join(chosen, "doc_id").select("x", "y"), "quality-training")
    size = COMPONENTS + 2
    upper = np.triu_indices(size)

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            z = np.hstack([kernel(_matrix(batch)), batch.column("y").to_numpy()[:, None]])
            total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(upper[0]))), pa.array(total[upper])], names=["cell", "value"])

    cells = rows.mapInArrow(sums, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).toPandas()
    total = np.zeros((size, size))
    where = cells["cell"].to_numpy(np.int64)
    total[upper[0][where], upper[1][where]] = cells["value"].to_numpy()
    total = np.triu(total) + np.triu(total, 1).T
    n = total[-2, -2]
    if not n:
        return Model(kernel, np.zeros(size - 1), np.zeros(0), np.zeros(0))
    penalty = np.eye(size - 1) * ridge * n
    penalty[-1, -1] = 1e-9
    weights = np.linalg.solve(total[:-1, :-1] + penalty, total[:-1, -1])
    model = Model(kernel, weights, np.zeros(0), np.zeros(0))

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.clip(model.raw(_matrix(batch)), -0.5, 1.5)), batch.column("y")], names=["raw", "y"])

    raw = rows.mapInArrow(score, "raw double, y double")
    binned = raw.groupBy(F.floor((F.col("raw") + 0.5) * (BINS // 2)).alias("bin")).agg(F.avg("raw").alias("raw"), F.sum("y").alias("hits"), F.count("*").alias("n")).orderBy("bin").toPandas()
    centres, means = isotonic(binned["raw"].to_numpy(), binned["hits"].to_numpy(), binned["n"].to_numpy(float))
    return Model(kernel, weights, centres, means)


def score(stats: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.clip(model.score(_matrix(batch)), 0, 1) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s)], names=["doc_id", "score"])

    scored = stats.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(fold("doc_id") == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", sample: int = SAMPLE) -> DataFrame:
    stats = features(docs, text)
    return score(stats, fit(stats, labels, sample=sample))
