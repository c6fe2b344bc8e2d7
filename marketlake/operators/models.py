"""Models on tick features: regression, classification, forests, predictions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import stored
from . import features as tick_features
from . import forest, indicators, market, ranges

#: What the window models learn from.
WINDOW_FEATURES = ["n_ticks", "avg_price", "avg_market_cap", "avg_volume_24h", "avg_coin_circulating"]
#: Megabytes of a task for the counts of the nodes that a forest grows at once.
FOREST_MB = 512


@dataclass
class Fitted:
    model: PipelineModel
    metrics: dict[str, float]


def _scaled(columns: list[str]) -> list:
    return [VectorAssembler(inputCols=columns, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="features", withMean=True)]


def _stages(columns: list[str], last) -> Pipeline:
    return Pipeline(stages=[*_scaled(columns), last])


def classification_metrics(predicted: DataFrame, label: str = "label") -> dict[str, float]:
    """Confusion counts, accuracy, precision, recall and F1 from one grouped count of four rows at most."""
    return _metrics({(int(r[0]), int(r[1])): r[2] for r in predicted.groupBy(label, "prediction").count().collect()})


def _metrics(cells: dict[tuple[int, int], int]) -> dict[str, float]:
    tp, fp, fn, tn = (cells.get(k, 0) for k in ((1, 1), (0, 1), (1, 0), (0, 0)))
    ratio = lambda a, b: a / b if b else 0.0
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return {"tp": tp, "fp": fp, "fn": fn, "tn": tn, "accuracy": ratio(tp + tn, tp + fp + fn + tn), "precision": precision, "recall": recall, "f1": ratio(2 * precision * recall, precision + recall)}


def train_regression(rows: DataFrame, target: str = "target_pct", columns: list[str] = WINDOW_FEATURES, key: str = "id", seed: int = 42) -> Fitted:
    """Linear regression on standardised features; R2 and MAE on the test part of 70/20/10."""
    parts = tick_features.split(rows.withColumn("label", F.col(target).cast("double")), [0.7, 0.2, 0.1], seed, key).persist()
    model = _stages(columns, LinearRegression()).fit(parts.where("part = 0"))
    metrics = {}
    for name, part in (("validation", 1), ("test", 2)):
        predicted = model.transform(parts.where(F.col("part") == part))
        metrics |= {f"{name}_{m}": RegressionEvaluator(metricName=m).evaluate(predicted) for m in ("r2", "mae")}
    parts.unpersist()
    return Fitted(model, metrics)


def train_classifier(rows: DataFrame, target: str = "target_up", columns: list[str] = WINDOW_FEATURES, key: str = "id", seed: int = 42) -> Fitted:
    """Logistic regression of 1000 iterations at most; accuracy and F1."""
    parts = tick_features.split(rows.withColumn("label", F.col(target).cast("double")), [0.7, 0.2, 0.1], seed, key, stratify="label").persist()
    model = _stages(columns, LogisticRegression(maxIter=1000)).fit(parts.where("part = 0"))
    metrics = {f"{name}_{k}": v for name, part in (("validation", 1), ("test", 2)) for k, v in classification_metrics(model.transform(parts.where(F.col("part") == part))).items()}
    parts.unpersist()
    return Fitted(model, metrics)


def train_forest(rows: DataFrame, columns: list[str] | None = None, trees: int = 200, depth: int = 15, seed: int = 42, key: str = "id", least_rows: int = 100) -> tuple[Fitted, DataFrame]:
    """Forest on 80/20 stratified rows (column target) with balanced weights; (fitted, importances)."""
    columns = columns or indicators.FEATURES
    drawn = F.xxhash64(F.col(key), F.lit(seed), "target", *columns).alias("_key")
    parts = tick_features.split(rows.withColumn("label", F.col("target").cast("double")), [0.8, 0.2], seed, key, stratify="label").select(*columns, "label", "part", drawn).persist()
    try:
        cells = {(int(r[0]), int(r[1])): r[2] for r in parts.groupBy("label", "part").count().collect()}
        n = sum(cells.values())
        if n < least_rows:
            raise ValueError(f"{n} rows; a forest needs {least_rows}")
        weights = tuple(n / (2 * max(1, sum(c for (label, _), c in cells.items() if label == k))) for k in (0, 1))
        prepared = Pipeline(stages=_scaled(columns)).fit(parts.where("part = 0"))
        bins, cuts = forest.binned(prepared.transform(parts), len(columns), "_key")
    finally:
        parts.unpersist()
    # a pass over the rows counts as many nodes as fit into FOREST_MB, and rows of smaller nodes stay with them
    estimator = RandomForestClassifier(numTrees=trees, maxDepth=depth, minInstancesPerNode=2, featureSubsetStrategy="sqrt", weightCol="weight", seed=seed, maxMemoryInMB=FOREST_MB, cacheNodeIds=True)
    plan = forest.Plan(trees, depth, estimator.getMinInstancesPerNode(), math.ceil(math.sqrt(len(columns))), len(columns), weights, seed)
    nodes = forest.grow(bins.where("part = 0"), sum(c for (_, part), c in cells.items() if part == 0), plan, FOREST_MB)
    grown = forest.numbered(nodes, plan, cuts)
    last = forest.GrownForest(grown, plan, cuts, estimator)
    said = last.verdicts(bins).collect()
    metrics = {f"{name}_{k}": v for name, part in (("train", 0), ("test", 1)) for k, v in _metrics({(r.label, r.prediction): r.n for r in said if r.part == part}).items()}
    found = list(zip(columns, forest.importances(grown, len(columns)), strict=True))
    return Fitted(PipelineModel([*prepared.stages, last]), metrics), rows.sparkSession.createDataFrame(found, "feature string, importance double")


def top_features(importances: DataFrame, k: int = 10) -> DataFrame:
    return importances.orderBy(F.desc("importance"), "feature").limit(k)


def predict_direction(model: PipelineModel, ticks: DataFrame, n: int = 20) -> DataFrame:
    """id, symbol, fetched_at, price, direction and probability of rising for each symbol's last n ticks."""
    rows = market.last_n_per_symbol(indicators.technical_features(ticks), n)
    up = vector_to_array("probability")[1]
    return model.transform(rows).select("id", "symbol", "fetched_at", "price", F.when(F.col("prediction") == 1, "HAUSSE").otherwise("BAISSE").alias("direction"), up.alias("probability_up"))


def prediction_verdict(predictions: DataFrame) -> DataFrame:
    """Counts and shares of both directions, the majority and the mean probability."""
    up, n = F.count_if(F.col("direction") == "HAUSSE"), F.count("*")
    out = predictions.agg(up.alias("n_up"), (n - up).alias("n_down"), F.avg("probability_up").alias("avg_probability"))
    share = lambda c: F.try_divide(F.col(c) * 100.0, F.col("n_up") + F.col("n_down"))
    return out.withColumns({"pct_up": share("n_up"), "pct_down": share("n_down"), "verdict": F.when(F.col("n_up") > F.col("n_down"), "HAUSSE").when(F.col("n_up") < F.col("n_down"), "BAISSE").otherwise("NEUTRE")})


def predict_next_price(regression: PipelineModel, classifier: PipelineModel, deltas: DataFrame, ticks: DataFrame, date_start: str | None = None) -> DataFrame:
    """From each symbol's newest window that has priced ticks, or the one given: percent, up probability and price.

    The windows and the newest ones are stored first, as they are read several times.
    """
    windows = tick_features.with_end(deltas).select("symbol", "date_start", "date_end").distinct()
    if date_start is not None:
        windows = windows.where(F.col("date_start") == F.lit(date_start).cast("timestamp"))
    windows = stored(windows.withColumns({"start": ranges.micros("date_start"), "at": ranges.micros("date_end")}), "windows")
    priced = ticks.where("price IS NOT NULL").withColumn("at", ranges.micros("fetched_at"))
    # the last priced tick before a window's end is within the window, or none is
    last = ranges.as_of(windows, priced, F.struct("at", "id", "price")).where("last IS NOT NULL")
    held = windows.join(last, ["symbol", "at"]).where(F.col("last.at") >= F.col("start"))
    newest = held.groupBy("symbol").agg(F.max_by(F.struct("date_start", "date_end", F.col("last.price").alias("price_now")), F.struct("date_start", "date_end")).alias("w")).select("symbol", "w.*")
    newest = stored(newest, "windows-newest")
    means = tick_features.window_means(newest, priced)
    newest = newest.withColumns({"start": ranges.micros("date_start"), "stop": ranges.micros("date_end")}).join(means, ranges.KEY).fillna(0, subset=WINDOW_FEATURES)
    keep = ["symbol", "date_start", "price_now"]
    pct = regression.transform(newest).select(*keep, *WINDOW_FEATURES, F.col("prediction").alias("predicted_pct"))
    both = classifier.transform(pct).withColumn("probability_up", vector_to_array("probability")[1])
    return both.select(*keep, "predicted_pct", "probability_up", (F.col("price_now") * (1 + F.col("predicted_pct") / 100)).alias("predicted_price"))


def save_model(fitted: Fitted, path: str, spark: SparkSession) -> None:
    """Model and metrics below ``path``."""
    fitted.model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(k, float(v)) for k, v in fitted.metrics.items()], "name string, value double").coalesce(1).write.mode("overwrite").parquet(f"{path}/metrics")


def load_model(spark: SparkSession, path: str) -> Fitted:
    return Fitted(PipelineModel.load(f"{path}/model"), {r.name: r.value for r in spark.read.parquet(f"{path}/metrics").collect()})
