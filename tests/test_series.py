import datetime
import functools
import operator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from oracle import compare
from pyspark.sql import functions as F

from marketlake.operators import correlate, features, indicators, market, series, windows
from marketlake.operators.ema import with_ema
from marketlake.plans import indicators as indicators_plan

T0 = datetime.datetime(2024, 1, 1)


def ticks(spark, prices, symbol="A", step=3600, volumes=None):
    rows = [(i, symbol, T0 + datetime.timedelta(seconds=step * i), float(p), 1.0 if volumes is None else float(volumes[i]), 10.0, 5.0, "n") for i, p in enumerate(prices)]
    return spark.createDataFrame(rows, "id long, symbol string, fetched_at timestamp_ntz, price double, volume_24h double, market_cap double, coin_circulating double, name string")


def values(df, *columns, order="id"):
    rows = df.orderBy(order).select(*columns).collect()
    return [r[0] for r in rows] if len(columns) == 1 else [tuple(r) for r in rows]


def test_rsi_of_rising_and_flat_series(spark):
    rising = values(indicators.build_rsi(ticks(spark, [float(i) for i in range(1, 8)]), 3), "rsi")
    assert rising[:2] == [None, None] and rising[2:] == [100.0] * 5
    flat = indicators.build_rsi(ticks(spark, [5.0] * 6), 3)
    got = values(flat, "rsi", "rsi_signal", "rsi_strength")
    assert got[1][0] is None and got[2][0] != got[2][0] and got[2][1:] == ("overbought", "very_strong_buy")


def test_volatility_starts_after_period_plus_one_and_constant_growth_has_no_score(spark):
    got = values(indicators.build_volatility(ticks(spark, [2.0**i for i in range(7)]), 3), "price_volatility_std", "price_change_zscore", "extreme_movement")
    assert got[2][0] is None and got[3] == (0.0, None, False)


def test_ema_seeds_and_wma(spark):
    rows = series.indexed(ticks(spark, [1.0, 2.0, 3.0, 4.0]))
    assert values(with_ema(rows, {"e": 2}, seed="sma"), "e") == pytest.approx([None, 1.5, 2.5, 3.5])
    assert values(with_ema(rows, {"e": 2}, seed="first"), "e") == pytest.approx([1, 1.666667, 2.555556, 3.518519], abs=1e-6)
    assert values(indicators.with_averages(ticks(spark, [1.0, 2.0, 3.0]), 3, ["wma"]), "wma")[-1] == pytest.approx(14 / 6)


def test_ema_by_blocks_equals_pandas(spark):
    rng = np.random.default_rng(3)
    prices = (100 + rng.normal(0, 1, 237).cumsum()).tolist()
    rows = series.indexed(ticks(spark, prices).union(ticks(spark, prices[:31], "B")))
    got = with_ema(rows, {"fast": 5, "slow": 12}, block_rows=20).where("symbol = 'A'")
    want = pd.Series(prices)
    for name, span in (("fast", 5), ("slow", 12)):
        assert values(got, name) == pytest.approx(want.ewm(span=span, adjust=False).mean().tolist())
    sma = values(with_ema(rows, {"e": 7}, seed="sma", block_rows=20).where("symbol = 'A'"), "e")
    assert sma[:6] == [None] * 6 and sma[6] == pytest.approx(np.mean(prices[:7]))


def test_rolling_by_blocks_equals_whole(spark):
    rng = np.random.default_rng(4)
    df = ticks(spark, (50 + rng.normal(0, 1, 143).cumsum()).tolist(), step=1800)
    compute = lambda rows, w: rows.withColumn("m", F.avg("price").over(series.last(w, 9))).withColumn("n", F.lead("price").over(w))
    small = values(series.rolling(df, 9, compute, lookahead=1, block_rows=11), "m", "n")
    whole = values(series.rolling(df, 9, compute, lookahead=1, block_rows=10_000), "m", "n")
    assert len(small) == 143 and [x for r in small for x in r if x is not None] == pytest.approx([x for r in whole for x in r if x is not None])
    with pytest.raises(ValueError):
        series.blocked(series.indexed(df), 20, block_rows=10)


def test_index_orders_by_time_then_id(spark):
    df = spark.createDataFrame([(2, "A", T0), (1, "A", T0), (3, "A", T0 + datetime.timedelta(days=2)), (4, "A", None), (5, None, T0)], "id long, symbol string, fetched_at timestamp_ntz")
    got = {r.id: r._i for r in series.indexed(df).collect()}
    assert got == {4: 0, 1: 1, 2: 2, 3: 3, 5: 0}


def test_technical_features_against_pandas(spark):
    rng = np.random.default_rng(5)
    p = pd.Series(np.abs((20 + rng.normal(0, 1, 90).cumsum()).round(2)) + 1)
    got = indicators.technical_features(ticks(spark, p.tolist())).orderBy("id").toPandas()
    macd = p.ewm(span=12, adjust=False).mean() - p.ewm(span=26, adjust=False).mean()
    assert np.allclose(got.macd_signal, macd.ewm(span=9, adjust=False).mean())
    assert np.allclose(got.volatility, p.rolling(10, min_periods=1).std().fillna(0))
    change = p.diff()
    gain, loss = change.where(change > 0, 0).rolling(14, min_periods=1).mean(), (-change.where(change < 0, 0)).rolling(14, min_periods=1).mean()
    assert np.allclose(got.rsi, (100 - 100 / (1 + gain / loss.replace(0, np.nan))).fillna(50))


def test_movers_take_the_last_rise_and_the_last_fall(spark):
    df = ticks(spark, [10.0, 12.0, 11.0])
    assert values(market.top_gainers(df), "pct", order="pct") == [pytest.approx(20.0)]
    assert values(market.top_losers(df), "pct", order="pct") == [pytest.approx(-100 / 12)]
    assert values(market.price_moves(ticks(spark, [0.0, 3.0])), "pct") == [0.0, None]


def test_trending_counts(spark):
    at = lambda hours: T0 - datetime.timedelta(hours=hours)
    rows = [(i, " new ", at(1), 1.0) for i in range(3)] + [(i, "gone", at(30), 1.0) for i in range(4)] + [(9, None, at(1), 1.0), (10, " ", at(1), 1.0)]
    df = spark.createDataFrame(rows, "id long, symbol string, fetched_at timestamp_ntz, price double")
    got = {r.source: (r.value, r.previous, r.delta_pct) for r in market.trending_symbols(df, str(T0), 24).collect()}
    assert got == {"NEW": (3, 0, 100.0), "GONE": (0, 4, -100.0)}


def test_delta_of_zero_and_missing_previous(spark):
    got = values(windows.compute_delta(windows.compute_window(ticks(spark, [0.0, 4.0, 8.0]), "1 hour")), "delta_pct", "trending_up", order="window_start")
    assert got == [(None, False), (None, False), (100.0, True)]


def test_cross_correlation_sign_and_limits(spark):
    price, volume = [0.0, 0, 1, 0, 0, 2, 0, 0, 1, 0, 0, 3], [0.0, 1, 0, 0, 2, 0, 0, 1, 0, 0, 3, 0]
    df = ticks(spark, price, volumes=volume)
    best = correlate.optimal_lag(correlate.cross_correlation(df, 3)).first()
    assert best.lag == 1 and best.interpretation.endswith("Le volume précède le prix de 1 période(s).")
    z = lambda x: (np.array(x) - np.mean(x)) / np.std(x, ddof=1)
    full = np.correlate(z(price), z(volume), "full")[11 - 3 : 11 + 4] / 12
    assert values(correlate.cross_correlation(df, 3), "corr", order="lag") == pytest.approx(full.round(4).tolist(), abs=1e-4)
    assert correlate.cross_correlation(ticks(spark, [1.0] * 20), 3).count() == 0
    assert correlate.cross_correlation(ticks(spark, [1.0, 2.0]), 3).count() == 0


def test_pearson_needs_three_points_and_drops_repeats(spark):
    b = spark.createDataFrame([("A", T0, 1.0), ("A", T0 + datetime.timedelta(hours=1), 2.0), ("B", T0, 2.0), ("B", T0 + datetime.timedelta(hours=1), 2.0)], "symbol string, t timestamp_ntz, price double")
    assert correlate.pearson_pair(b, "a", "b").count() == 0
    assert correlate.drop_repeated_values(b).count() == 3


def test_interval_join_keeps_half_open_ends(spark):
    deltas = spark.createDataFrame([("A", T0, 5.0, "2h"), ("A", T0 + datetime.timedelta(hours=2), None, "1h"), ("Z", T0, 1.0, "1d")], "symbol string, date_start timestamp_ntz, delta_pct double, window_label string")
    df = ticks(spark, [1.0, 2.0, 3.0, 4.0])
    got = {(r.symbol, r.date_start.hour): (r.n_ticks, r.avg_price) for r in features.window_features(deltas, df).collect()}
    assert got == {("A", 0): (2, 1.5), ("A", 2): (1, 3.0)}
    view = {(r.symbol, r.date_start.hour): (r.n_ticks, r.avg_price) for r in features.ml_features_view(features.with_end(deltas), df).collect()}
    assert view == got | {("Z", 0): (0, None)}


def test_split_is_exact_and_independent_of_partitions(spark):
    df = spark.range(1000).withColumn("label", (F.col("id") % 10 == 0).cast("int"))
    one = features.split(df.repartition(7), [0.7, 0.2, 0.1], stratify="label")
    counts = {(r.label, r.part): r["count"] for r in one.groupBy("label", "part").count().collect()}
    assert counts == {(0, 0): 630, (0, 1): 180, (0, 2): 90, (1, 0): 70, (1, 1): 20, (1, 2): 10}
    two = features.split(df.coalesce(1), [0.7, 0.2, 0.1], stratify="label")
    assert sorted(map(tuple, one.select("id", "part").collect())) == sorted(map(tuple, two.select("id", "part").collect()))


def test_clean_training_rows(spark):
    df = spark.createDataFrame([(float(i), None if i % 2 else 1.0, None, 5000.0 if i == 0 else 1.0) for i in range(30)], "id double, a double, b double, t double")
    assert features.clean_training_rows(df, ["a", "b"], "t").count() == 14
    with pytest.raises(ValueError):
        features.clean_training_rows(df.limit(3), ["a", "b"], "t")


def test_summaries_of_nothing(spark):
    empty = ticks(spark, [1.0]).where("false")
    assert indicators.rsi_summary(indicators.build_rsi(empty)).count() == 0
    assert indicators.technical_features(empty).count() == 0
    assert indicators.series_status(indicators.build_rsi(empty), 14).first().status == "insufficient data"


def test_quartiles_of_large_groups_are_exact(spark, monkeypatch):
    rng = np.random.default_rng(8)
    values_of = {"A": rng.normal(size=30_011).round(3), "B": np.r_[rng.normal(size=20_000), 1e9], "C": np.full(15_000, 2.0), "D": rng.normal(size=87)}
    df = spark.createDataFrame(pd.concat([pd.DataFrame({"symbol": s, "v": v}) for s, v in values_of.items()]))
    got = {r.symbol: (r.q25, r.q75) for r in indicators.quartiles(df, "v").collect()}
    for s, v in values_of.items():
        ranked = np.sort(v)
        assert got[s] == tuple(ranked[int(np.floor((len(v) - 1) * q + 0.5))] for q in (0.25, 0.75))


def test_sums_of_frames_by_runs(spark):
    """Rows before the first whole run, whole runs, rows after, to the last bit and whatever the blocks."""
    rng = np.random.default_rng(5)
    values = np.round(rng.uniform(1, 500, 700), 2).tolist()
    df = spark.createDataFrame([("A", i, v) for i, v in enumerate(values)], "symbol string, _i long, v double").repartition(3)
    frames = {f"s{n}": n for n in (1, 5, 15, 16, 17, 20, 31, 32, 33, 50, 200)}
    for block_rows in (1000, 256):
        got = series.rolling(df, 250, lambda rows, w: series.run_sums(rows, w, "v", frames), block_rows=block_rows).orderBy("_i").collect()
        assert [r._i for r in got] == list(range(700)) and set(got[0].asDict()) == {"symbol", "_i", "v", *frames}
        for name, n in frames.items():
            for i in range(n - 1, 700):
                first, stop = -(-(i - n + 1) // 16) * 16, (i + 1) // 16 * 16
                rows = values[i - n + 1 : i + 1] if first >= stop else [*values[i - n + 1 : first], *(functools.reduce(operator.add, values[k : k + 16]) for k in range(first, stop, 16)), *values[stop : i + 1]]
                assert got[i][name] == functools.reduce(operator.add, rows), (name, i)


def test_signals_of_means_that_are_equal(spark, tmp_path):
    """Prices of a few cents, so that many means are equal but for the last bit of their sums."""
    rng, n = np.random.default_rng(3), 4000
    columns = {
        "event_id": np.arange(n), "ts": (np.datetime64("2024-01-01", "us") + rng.integers(0, 10**12, n)), "user_id": rng.integers(0, 20, n),
        "event_type": ["click"] * n, "value": rng.integers(1, 5, n) / 10, "props": ['{"k": 7}'] * n,
    }
    pq.write_table(pa.table(columns), tmp_path / "events.parquet")
    assert compare(spark, indicators_plan.ma_signals, indicators_plan.ORACLE_SQL["ma_signals"], str(tmp_path)) is None
