"""Toxicity by cumulative-link ordinal regression on sparse text features.

Features are words and word beginnings.  From a bounded sample of labelled rows
(``sample``, by hash of the doc_id) those are kept that toxic texts favour most.
Labels say only toxic or not, so the grades' order comes from a second opinion:
the sample has two folds, and a model of each, with features of its own, says
how strongly it finds the toxic rows of the other, whose labels it never saw.
Grade 0 are texts not marked toxic, grades 1 to 3 are thirds of the marked ones
by that log-odds; marked rows in which nothing speaks for it are grade 1.

The final model has one weight for each feature, shared by the ordered
thresholds between the grades: P(grade >= k) = sigmoid(w x - t_k).  Expected
severity is the sum of these.

Defined cases: null, empty and wordless texts have no features and get the
severity of the thresholds alone; if no labelled row is toxic nothing is
rejected; rows without a doc_id are scored; repeated rows get equal scores;
extra columns are carried by ``filtered`` and ignored elsewhere.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import quality, shared
from .simhash import shingle_set

SAMPLE = 20_000
FEATURES = 384
BEGINNINGS = (4, 5, 6, 7)
GRADES = 3
#: A feature must stand in so many toxic rows, and be so many deviations more usual there.
LEAST_ROWS, LEAST_Z, LEAST_ODDS = 3, 3.0, 1.5
REMEMBERED = 200_000
#: Names that a counting task holds before it passes them on.
HELD = 100_000
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def names_of(word: bytes) -> list[str]:
    """The word, marked as whole, and its beginnings."""
    text = word.decode("utf-8", "replace")
    return [text + "$", *(text[:n] for n in BEGINNINGS if len(text) >= n)]


class Counts:
    """Counts the wanted features of texts; remembers which of them a word has."""

    def __init__(self, wanted: dict[str, int]) -> None:
        self.wanted, self.known = wanted, {}

    def _features(self, word: bytes) -> tuple[int, ...]:
        found = self.known.get(word)
        if found is None:
            found = tuple(self.wanted[x] for x in names_of(word) if x in self.wanted)
            if len(self.known) < REMEMBERED:
                self.known[word] = found
        return found

    def __call__(self, text: bytes) -> dict[int, float]:
        """{feature: 1 + log(1 + its percent of words)}: that it stands there counts most, also in a long text"""
        words = words_of(text)
        found = list(map(self.known.get, words))
        if None in found:
            found = list(map(self._features, words))
        marked = [x for x in found if x]
        if not marked:
            return {}
        counts = Counter(i for x in marked for i in x)
        return {i: 1 + float(np.log1p(100 * n / len(words))) for i, n in counts.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit_ordinal(x: np.ndarray, grades: np.ndarray, weights: np.ndarray, most: int = GRADES, ridge: float = 2.0, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Feature weights and rising thresholds below the grades 1 to ``most``, by Adam on the cumulative-link likelihood."""
    n_features = x.shape[1]
    w, first, gaps = np.zeros(n_features), 2.0, np.zeros(most - 1)
    theta = np.concatenate([w, [first], gaps])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    total = weights.sum()
    for step in range(1, steps + 1):
        w, cuts = theta[:n_features], theta[n_features] + np.concatenate([[0], np.cumsum(np.exp(theta[n_features + 1 :]))])
        above = _sigmoid((x @ w)[:, None] - cuts)  # P(grade >= 1..most)
        full = np.hstack([np.ones((len(x), 1)), above, np.zeros((len(x), 1))])
        at = np.arange(len(x))
        p = np.maximum(full[at, grades] - full[at, grades + 1], 1e-9)
        slope = full * (1 - full)
        scale = weights / p
        by_score = (slope[at, grades] - slope[at, grades + 1]) * scale
        by_cut = np.zeros((len(x), most + 2))
        by_cut[at, grades] -= slope[at, grades] * scale
        by_cut[at, grades + 1] += slope[at, grades + 1] * scale
        cut_sums = by_cut[:, 1:-1].sum(0)
        tail = np.cumsum(cut_sums[::-1])[::-1]  # a gap moves all later thresholds
        g = -np.concatenate([x.T @ by_score, [tail[0]], tail[1:] * np.exp(theta[n_features + 1 :])]) / total
        g[:n_features] += ridge * w / total
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:n_features], theta[n_features] + np.concatenate([[0], np.cumsum(np.exp(theta[n_features + 1 :]))])


class Model:
    def __init__(self, wanted: dict[str, int], weights: np.ndarray, cuts: np.ndarray) -> None:
        self.wanted, self.weights, self.cuts = wanted, weights, cuts

    def above(self, totals: np.ndarray) -> np.ndarray:
        """P(grade >= 1..GRADES) for each weighted sum of features."""
        return _sigmoid(totals[:, None] - self.cuts)


def _telling(n_toxic: int, n_clean: int, f: str) -> Column:
    """How many deviations beyond chance a name stands in toxic rows (t and c count toxic and clean ones), null where too few or too little."""
    a, b = F.col(f"t{f}") + 0.5, F.col(f"c{f}") + 0.5
    odds = F.log(a / (n_toxic + 1.5 - a)) - F.log(b / (n_clean + 1.5 - b))
    z = odds / F.sqrt(1 / a + 1 / b)
    return F.when((F.col(f"t{f}") >= LEAST_ROWS) & (z >= LEAST_Z) & (odds >= LEAST_ODDS), z)


def select_features(rows: DataFrame) -> list[list[str]]:
    """The features that toxic rows (y = 1) favour most: in fold 0, in fold 1 and in both.

    Counted and ranked in Spark: FEATURES names of each list reach the driver, and
    a bitmap of bounded size of the names that enough toxic rows have, by which
    tasks leave most names of clean rows out.
    """

    def counted(bitmap):
        def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts: list[Counter[str]] = [Counter(), Counter()]

            def held() -> pa.RecordBatch:
                names = [x for c in counts for x in c]
                if bitmap is not None and names:
                    # the hash that Spark's xxhash64 gives
                    kept = bitmap.value.has(np.fromiter((xxhash.xxh64_intdigest(x.encode(), 42) for x in names), np.uint64, len(names))).tolist()
                else:
                    kept = [True] * len(names)
                found = [(x, f, n) for (x, f, n), k in zip(((x, f, n) for f, c in enumerate(counts) for x, n in c.items()), kept, strict=True) if k]
                return pa.RecordBatch.from_pydict({"name": [x for x, _, _ in found], "fold": [f for _, f, _ in found], "n": [n for _, _, n in found]}, pa.schema([("name", pa.string()), ("fold", pa.int64()), ("n", pa.int64())]))

            for batch in batches:
                for body, fold in zip(batch.column("body"), batch.column("fold").to_pylist(), strict=True):
                    counts[fold].update({x for w in set(words_of(body.as_py())) for x in names_of(w)})
                    if sum(map(len, counts)) > HELD:
                        yield held()
                        counts = [Counter(), Counter()]
            yield held()

        return count

    def names_in(part: DataFrame, kind: str, bitmap=None) -> DataFrame:
        of = lambda f: F.sum(F.when(F.col("fold") == f, F.col("n")).otherwise(0)).alias(f"{kind}{f}")
        return part.select("body", "fold").mapInArrow(counted(bitmap), "name string, fold long, n long").groupBy("name").agg(of(0), of(1))

    toxic = shared.stored(names_in(rows.where("y > 0"), "t").where(F.col("t0") + F.col("t1") >= LEAST_ROWS), "toxicity-names")
    bitmap = rows.sparkSession.sparkContext.broadcast(shared.Bitmap.of(toxic.select(F.xxhash64("name").alias("key")), "key"))
    clean = names_in(rows.where("y = 0"), "c", bitmap)
    both = toxic.join(clean, "name", "left").fillna(0, subset=["c0", "c1"]).withColumns({"t": F.col("t0") + F.col("t1"), "c": F.col("c0") + F.col("c1")})
    both = shared.stored(both, "toxicity-names")
    sizes = {(y > 0, fold): n for y, fold, n in rows.groupBy("y", "fold").count().collect()}  # four rows
    n = {y: [sizes.get((y, 0), 0), sizes.get((y, 1), 0)] for y in (True, False)}
    chosen = []
    for f, n_toxic, n_clean in (("0", n[True][0], n[False][0]), ("1", n[True][1], n[False][1]), ("", sum(n[True]), sum(n[False]))):
        best = both.select("name", _telling(n_toxic, n_clean, f).alias("z")).where("z IS NOT NULL").orderBy(F.desc("z"), "name").limit(FEATURES)
        chosen.append([r.name for r in best.collect()])
    return chosen


def second_opinion(x: np.ndarray, toxic: np.ndarray, folds: np.ndarray, weights: np.ndarray, columns: list[list[int]]) -> np.ndarray:
    """For each row the log-odds that a binary model of the other fold, with that fold's features, gives it."""
    opinion = np.zeros(len(x))
    for f in (0, 1):
        others = folds == 1 - f
        if weights[others & toxic].sum() and weights[others & ~toxic].sum():
            w, cut = fit_ordinal(x[others][:, columns[1 - f]], toxic[others].astype(int), weights[others], most=1)
            opinion[folds == f] = x[folds == f][:, columns[1 - f]] @ w - cut[0]
    return opinion


def grades_of(opinion: np.ndarray, toxic: np.ndarray, known: np.ndarray, folds: np.ndarray) -> np.ndarray:
    """0 for rows not toxic, 1 to GRADES for equal parts of the toxic ones of a fold by the other fold's opinion; 1 where none is known."""
    grades = toxic.astype(int)
    for f in (0, 1):
        own = toxic & known & (folds == f)
        if own.any():
            levels = np.quantile(opinion[own], np.arange(1, GRADES) / GRADES)
            grades[own] = 1 + np.searchsorted(levels, opinion[own], side="right")
    return grades


def one_of_kin(rows: DataFrame) -> DataFrame:
    """body, y and fold: of copies and most near copies one row, so that a text that was copied often doesn't make the rules.

    Texts whose least shingle of five words is the same are kin; kin are of one fold.
    """

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = [int(found[0]) if len(found := shingle_set(x.as_py(), 5)) else 0 for x in batch.column("body")]
            yield pa.RecordBatch.from_arrays([batch.column("body"), batch.column("y"), pa.array(np.array(least, np.uint64).view(np.int64))], names=["body", "y", "kin"])

    each = rows.mapInArrow(scan, "body binary, y double, kin long").groupBy("kin", "y").agg(F.min("body").alias("body"))
    return each.select("body", "y", F.pmod(F.xxhash64("kin"), F.lit(2)).alias("fold"))


def fit(docs: DataFrame, labels: DataFrame, column: str = "toxic", sample: int = SAMPLE, text: str = "text") -> Model:
    chosen = F.broadcast(quality.training_labels(labels, column, sample))  # two numbers for each of ``sample`` rows at most
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), shared.text_or_empty(text).cast("binary").alias("body"))
    rows = shared.stored(one_of_kin(rows.join(chosen, "doc_id").select("body", "y")), "toxicity-training")
    chosen_names = select_features(rows)
    wanted = {x: i for i, x in enumerate(chosen_names[2])}
    every = wanted | {x: len(wanted) + i for i, x in enumerate(sorted({*chosen_names[0], *chosen_names[1]} - wanted.keys()))}
    none = Model(wanted, np.zeros(len(wanted)), np.full(GRADES, 30.0))
    if not wanted:
        return none

    def vectors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counts(every)
        for batch in batches:
            found = [count(x.as_py()) for x in batch.column("body")]
            out = {"at": [list(f) for f in found], "value": [list(f.values()) for f in found], "y": batch.column("y"), "fold": batch.column("fold")}
            yield pa.RecordBatch.from_pydict(out, pa.schema([("at", pa.list_(pa.int32())), ("value", pa.list_(pa.float64())), ("y", pa.float64()), ("fold", pa.int64())]))

    # rows without features differ in their label and fold alone, so they come as counts
    made = shared.stored(rows.mapInArrow(vectors, "at array<int>, value array<double>, y double, fold long"), "toxicity-vectors")
    blank = {(y > 0, f): n for y, f, n in made.where("size(at) = 0").groupBy("y", "fold").count().collect()}
    marked = made.where("size(at) > 0").orderBy(F.xxhash64("at", "value"), "y", "fold").collect()  # within the sample's bound
    x = np.zeros((len(marked) + 4, len(every)))
    for i, row in enumerate(marked):
        x[i, row["at"]] = row["value"]
    sorts = [(False, 0), (False, 1), (True, 0), (True, 1)]
    toxic = np.array([r["y"] > 0 for r in marked] + [y for y, _ in sorts])
    folds = np.array([r["fold"] for r in marked] + [f for _, f in sorts])
    weights = np.array([1.0] * len(marked) + [blank.get(s, 0) for s in sorts])
    if not (weights[toxic].sum() and weights[~toxic].sum()):
        return none
    opinion = second_opinion(x, toxic, folds, weights, [[every[n] for n in names] for names in chosen_names[:2]])
    grades = grades_of(opinion, toxic, x.any(1), folds)
    w, cuts = fit_ordinal(x[:, : len(wanted)], grades, weights)
    return Model(wanted, w, cuts)


def _scan(docs: DataFrame, model: Model, text: str) -> tuple[DataFrame, str, str]:
    """The rows of ``docs`` with two more columns, and their names: P(grade >= 1) and the expected grade."""
    p_toxic, severity = shared.free_name(docs, "_p_toxic"), shared.free_name(docs, "_severity")
    fields = StructType([*docs.schema.fields, StructField(p_toxic, DoubleType()), StructField(severity, DoubleType())])

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counts(model.wanted)
        for batch in batches:
            sums = np.zeros(batch.num_rows)
            for i, x in enumerate(batch.column(text)):
                raw = x.as_py()
                found = count(raw if isinstance(raw, bytes) else (raw or "").encode())
                sums[i] = sum(model.weights[k] * v for k, v in found.items())
            above = model.above(sums)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(above[:, 0]), pa.array(above.sum(1))], names=[*batch.schema.names, p_toxic, severity])

    return docs.mapInArrow(scan, fields), p_toxic, severity


def classify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """doc_id, p_toxic, severity (expected grade, 0 to GRADES), grade (its nearest), rejected."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), shared.text_or_empty(text).cast("binary").alias("body"))
    scored, p_toxic, severity = _scan(rows, model, "body")
    grade = F.round(severity).cast("int").alias("grade")
    return scored.select("doc_id", F.col(p_toxic).alias("p_toxic"), F.col(severity).alias("severity"), grade, (F.col(p_toxic) >= 0.5).alias("rejected"))


def filtered(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that aren't rejected, with their own columns."""
    scored, p_toxic, _ = _scan(docs, model, text)
    return scored.where(F.col(p_toxic) < 0.5).select(docs.columns)
