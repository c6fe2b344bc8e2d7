"""Models against plain numpy, and the forest at its defaults on held-out rows."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from marketlake.operators import features, forest, indicators, models
from marketlake.plans.common import deltas
from marketlake.sources.tables import ticks

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def windows(spark):
    """Training rows of the hourly windows, once for all tests."""
    rows = features.window_features(deltas(spark, SF).drop("date_end"), ticks(spark, SF))
    rows = features.clean_training_rows(rows, models.WINDOW_FEATURES, "target_pct").withColumn("id", F.xxhash64("symbol", "date_start"))
    return spark.createDataFrame(rows.toPandas(), rows.schema)


def matrix(pdf):
    return pdf[models.WINDOW_FEATURES].to_numpy(float)


def parts_of(windows, target, stratify=None):
    rows = features.split(windows.withColumn("label", F.col(target).cast("double")), [0.7, 0.2, 0.1], 42, "id", stratify=stratify)
    pdf = rows.toPandas()
    return [pdf[pdf.part == i] for i in range(3)]


def test_regression_is_least_squares(spark, windows):
    fitted = models.train_regression(windows)
    train, validation, test = parts_of(windows, "target_pct")
    scale = lambda x: (x - matrix(train).mean(0)) / np.maximum(matrix(train).std(0, ddof=1), 1e-300)
    with_one = lambda pdf: np.c_[np.ones(len(pdf)), scale(matrix(pdf))]
    solution, *_ = np.linalg.lstsq(with_one(train), train.label.to_numpy(), rcond=None)
    linear = fitted.model.stages[-1]
    assert fitted.model.stages[-1].intercept == pytest.approx(solution[0], rel=1e-6)
    assert linear.coefficients.toArray() == pytest.approx(solution[1:], rel=1e-4, abs=1e-6)
    for name, part in (("validation", validation), ("test", test)):
        y, predicted = part.label.to_numpy(), with_one(part) @ solution
        assert fitted.metrics[f"{name}_mae"] == pytest.approx(np.abs(y - predicted).mean(), rel=1e-4)
        assert fitted.metrics[f"{name}_r2"] == pytest.approx(1 - ((y - predicted) ** 2).sum() / ((y - y.mean()) ** 2).sum(), abs=1e-4)


def test_classifier_is_the_likeliest_logistic(spark, windows):
    fitted = models.train_classifier(windows)
    train, _, test = parts_of(windows, "target_up", "label")
    mean, std = matrix(train).mean(0), matrix(train).std(0, ddof=1)
    x = np.c_[np.ones(len(train)), (matrix(train) - mean) / std]
    y, w = train.label.to_numpy(), np.zeros(x.shape[1])
    for _ in range(50):  # Newton's method
        p = 1 / (1 + np.exp(-x @ w))
        w += np.linalg.lstsq(x.T @ (x * (p * (1 - p))[:, None]), x.T @ (y - p), rcond=None)[0]
    rows = spark.createDataFrame(test[["id", *models.WINDOW_FEATURES]])
    got = fitted.model.transform(rows).select("id", vector_to_array("probability")[1].alias("p")).toPandas().set_index("id").p
    want = 1 / (1 + np.exp(-np.c_[np.ones(len(test)), (matrix(test) - mean) / std] @ w))
    assert np.abs(got[test.id].to_numpy() - want).max() < 2e-3
    right = ((want > 0.5) == (test.label.to_numpy() == 1)).mean()
    assert fitted.metrics["test_accuracy"] == pytest.approx(right, abs=2 / len(test))


def test_next_price_of_each_symbol(spark, windows):
    """From the newest window with a priced tick, whose ticks are averaged here again."""
    regression, classifier = models.train_regression(windows), models.train_classifier(windows)
    d = deltas(spark, SF).drop("date_end")
    t = ticks(spark, SF)
    # the newest windows of three symbols have no price
    newest = {r.symbol: r.t for r in d.groupBy("symbol").agg(F.max("date_start").alias("t")).collect()}
    holes = F.col("symbol").isin("S1", "S2", "S3") & (F.col("fetched_at") >= F.element_at(F.create_map(*(F.lit(x) for k in newest.items() for x in k)), F.col("symbol")))
    t = t.withColumn("price", F.when(~holes, F.col("price")))
    got = {r.symbol: r for r in models.predict_next_price(regression.model, classifier.model, d, t).collect()}
    ticks_there, starts = t.where("price IS NOT NULL").toPandas(), d.select("symbol", "date_start").distinct().toPandas()
    assert len(got) == 10
    for symbol, r in got.items():
        own = ticks_there[ticks_there.symbol == symbol]
        for start in sorted(starts[starts.symbol == symbol].date_start, reverse=True):
            inside = own[(own.fetched_at >= start) & (own.fetched_at < start + np.timedelta64(1, "h"))]
            if len(inside):
                break
        assert r.date_start == start and (symbol in ("S1", "S2", "S3")) == (r.date_start < newest[symbol])
        last = inside.sort_values(["fetched_at", "id"]).iloc[-1]
        row = spark.createDataFrame([(float(len(inside)), *(float(inside[c].mean()) for c in features.MEASURES))], ", ".join(f"{c} double" for c in models.WINDOW_FEATURES))
        pct = regression.model.transform(row).first().prediction
        assert r.price_now == pytest.approx(last.price) and r.predicted_pct == pytest.approx(pct, rel=1e-6, abs=1e-9)
        assert r.predicted_price == pytest.approx(last.price * (1 + pct / 100), rel=1e-6) and 0 <= r.probability_up <= 1


def test_forest_at_its_defaults(spark):
    """200 trees of depth 15 do better than chance on held-out rows, whose shares the metrics are."""
    rows = indicators.technical_features(indicators.next_up_target(ticks(spark, "/root/testdata/sf0.001")))
    fitted, importances = models.train_forest(rows)
    forest = fitted.model.stages[-1]
    assert forest.getNumTrees == 200 and max(t.depth for t in forest.trees) > 8
    m = fitted.metrics
    assert m["test_accuracy"] == pytest.approx((m["test_tp"] + m["test_tn"]) / sum(m[f"test_{k}"] for k in ("tp", "fp", "fn", "tn")))
    assert m["test_accuracy"] > 0.65 and m["test_f1"] == pytest.approx(2 * m["test_tp"] / (2 * m["test_tp"] + m["test_fp"] + m["test_fn"]))
    assert sum(r.importance for r in importances.collect()) == pytest.approx(1)


def test_training_rows_are_computed_once(spark):
    """However often they are read: here by two counts, and before them to see whether there are enough."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def price(x):
        seen.add(1)
        return float(x)

    rows = features.clean_training_rows(spark.range(0, 40, 1, 4).select("id", price.asNondeterministic()("id").alias("avg_price"), F.lit(1.0).alias("target")), ["avg_price"], "target")
    assert rows.where("avg_price > 5").count() == 34 and rows.where("avg_price > 7").count() == 32
    assert seen.value == 40


def test_forest_grows_many_nodes_in_a_pass(spark, monkeypatch):
    """Rows know their nodes and a pass has room for more than Spark's default; the trees don't depend on the room."""
    rows = spark.range(0, 300, 1, 2).select("id", *((F.pmod(F.xxhash64("id", F.lit(k)), F.lit(97)) * 1.0).alias(f"x{k}") for k in range(4)), F.pmod(F.xxhash64("id"), F.lit(2)).alias("target"))
    grown = lambda: models.train_forest(rows, [f"x{k}" for k in range(4)], trees=3)[0].model.stages[-1]
    forest = grown()
    assert forest.getCacheNodeIds() and forest.getMaxMemoryInMB() == models.FOREST_MB > 256
    monkeypatch.setattr(models, "FOREST_MB", 256)
    trees = lambda model: model.toDebugString.split("\n", 1)[1]
    assert forest.totalNumNodes > 50 and trees(grown()) == trees(forest)


def noise(spark, n, parts=4):
    """Rows of four values, 97 different ones each, and a target that has little to do with them."""
    values = (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(97)).cast("double").alias(f"x{k}") for k in range(4))
    return spark.range(0, n, 1, parts).select("id", *values, F.pmod(F.xxhash64("id"), F.lit(2)).cast("int").alias("target"))


def written(spark):
    """Bytes that the tasks of all stages wrote for shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_forest_moves_rows_not_counts_of_nodes(spark):
    """A task sends each tree's rows once, not the counts of every node."""
    rows, before = noise(spark, 2000).localCheckpoint(), written(spark)
    model = models.train_forest(rows, [f"x{k}" for k in range(4)], trees=20)[0].model.stages[-1]
    assert model.totalNumNodes > 5000
    assert written(spark) - before < 2000 * 20 * 30


def test_forest_against_plain_growth(spark, monkeypatch):
    """Every node is the best split of its sample's rows, whether counts of all tasks or one task find it."""
    plan = forest.Plan(5, 6, 2, 2, 4, (0.9, 1.2), 7)
    rows = noise(spark, 400).withColumns({"features": array_to_vector(F.array(*(f"x{k}" for k in range(4)))), "label": F.col("target"), "part": F.lit(0), "_key": F.xxhash64("id")})
    bins, cuts = forest.binned(rows, 4, "_key")
    got = bins.toPandas()
    x, y, times = np.stack([np.frombuffer(b, np.uint8) for b in got.bins]), got.label.to_numpy(), forest.draws(got.key.to_numpy(), plan.trees)
    values = rows.select("_key", *(f"x{k}" for k in range(4))).toPandas().set_index("_key").loc[got.key].to_numpy()
    for k in range(4):
        assert ((x[:, [k]] > np.arange(len(cuts[k]))) == (values[:, [k]] > cuts[k])).all()
    want = {}

    def counts(some, tree):
        return tuple(int(times[some & (y == c), tree].sum()) for c in (0, 1))

    def mass(c):
        a, b = c[0] * plan.weights[0], c[1] * plan.weights[1]
        return 2 * a * b / max(a + b, 1e-300)

    def grow(tree, node, some):
        own, best = counts(some, tree), (0, -1, 0)
        if min(own) and node < 1 << plan.depth:
            for f in forest.choices(plan, tree, np.array([node]))[0]:
                for cut in range(forest.BINS - 1):
                    left, right = counts(some & (x[:, f] <= cut), tree), counts(some & (x[:, f] > cut), tree)
                    gain = mass(own) - mass(left) - mass(right)
                    if min(sum(left), sum(right)) >= plan.least and gain > max(best[0], 1e-9):
                        best = (gain, int(f), cut)
        want[tree, node] = (*best[1:], *own)
        if best[1] >= 0:
            grow(tree, 2 * node, some & (x[:, best[1]] <= best[2]))
            grow(tree, 2 * node + 1, some & (x[:, best[1]] > best[2]))

    for tree in range(plan.trees):
        grow(tree, 1, np.ones(len(x), bool))
    for most, megabytes in ((1 << 16, 512), (60, 512), (60, 0)):
        monkeypatch.setattr(forest, "SUBTREE_ROWS", most)
        nodes = forest.grow(bins, 400, plan, megabytes).collect()
        assert {(r.tree, r.node): (r.feature, r.cut if r.feature >= 0 else 0, r.c0, r.c1) for r in nodes} == want and len(nodes) == len(want) > 100


def test_forest_metrics_are_the_models(spark, tmp_path):
    """Bins, the stage and Spark's own model say the same; samples without rows are leaves without a vote."""
    rows = noise(spark, 200)
    fitted, importances = models.train_forest(rows, [f"x{k}" for k in range(4)], trees=7)
    assert "model" not in fitted.model.stages[-1]._held  # nothing has loaded it into the driver
    models.save_model(fitted, str(tmp_path), spark)
    again = models.load_model(spark, str(tmp_path))
    read = lambda model: [(r.id, r.prediction, *np.round([*r.probability, *r.rawPrediction], 9)) for r in model.transform(rows).orderBy("id").collect()]
    assert read(again.model) == read(fitted.model) and again.metrics == fitted.metrics
    assert [r.importance for r in importances.collect()] == pytest.approx(again.model.stages[-1].featureImportances.toArray().tolist())
    said = {(r.target, int(r.prediction)): r["count"] for r in fitted.model.transform(rows).groupBy("target", "prediction").count().collect()}
    for name, cell in (("tp", (1, 1)), ("fp", (0, 1)), ("fn", (1, 0)), ("tn", (0, 0))):
        assert fitted.metrics[f"train_{name}"] + fitted.metrics[f"test_{name}"] == said.get(cell, 0)
    alike = spark.range(120).select(F.lit(1).alias("id"), F.lit(2.0).alias("x0"), F.lit(1).alias("target"))
    fitted, _ = models.train_forest(alike, ["x0"], trees=20)
    assert fitted.model.stages[-1].totalNumNodes == 20 and fitted.metrics["train_accuracy"] == 1
    assert fitted.model.transform(alike).where("prediction = 1").count() == 120
