"""Correlations against numpy."""

import numpy as np
import pytest

from marketlake.operators import correlate


def series_of(seed, symbols, times):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=times).cumsum()
    return [(f"s{k}", int(t), float(1e6 * k + 50 + base[t] * (k % 3) + rng.normal())) for k in range(symbols) for t in range(times) if rng.random() < 0.7]


@pytest.mark.parametrize("tile, times", [(256, 4096), (3, 7), (1, 100)])
def test_pearson_matrix_of_tiles(spark, tile, times):
    rows = series_of(1, 8, 60) + [("flat", t, 3.0) for t in range(40)] + [("few", 0, 1.0), ("few", 1, 2.0), (None, 3, 1.0), ("s1", None, 2.0), ("s2", 999, None)]
    table = spark.createDataFrame(rows, "symbol string, t long, price double")
    got = {(r.symbol_a, r.symbol_b): r for r in correlate.pearson_matrix(table, tile=tile, times=times, places=9).collect()}
    by = {}
    for symbol, t, price in rows:
        if symbol is not None and t is not None and price is not None:
            by.setdefault(symbol, {})[t] = price
    want = 0
    for a in by:
        for b in by:
            both = sorted(by[a].keys() & by[b].keys())
            if a < b and len(both) >= 3:
                want += 1
                x, y, r = np.array([by[a][t] for t in both]), np.array([by[b][t] for t in both]), got[a, b]
                assert r.n_points == len(both)
                assert (r.mean_a, r.mean_b) == (pytest.approx(x.mean()), pytest.approx(y.mean()))
                assert r.std_a == pytest.approx(x.std(ddof=1), rel=1e-6, abs=1e-6) and r.std_b == pytest.approx(y.std(ddof=1), rel=1e-6, abs=1e-6)
                if x.std() > 0 and y.std() > 0:
                    assert r.correlation_pearson == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-6)
                else:
                    assert r.correlation_pearson is None
    assert len(got) == want
    assert {r.symbol_a for r in correlate.pearson_matrix(table, top=2).collect()} <= set(by)
    assert correlate.pearson_matrix(table.where("false")).count() == 0


@pytest.mark.parametrize("stretch", [7, 64, 1 << 15])
def test_all_lags_against_numpy(spark, stretch):
    rng = np.random.default_rng(3)
    rows = [(s, i, float(rng.normal()), float(rng.normal())) for s in ("A", "B") for i in range(150 if s == "A" else 33)] + [("few", 1, 1.0, 2.0)] + [("flat", i, 1.0, float(i)) for i in range(20)]
    table = spark.createDataFrame(rows, "symbol string, id long, price double, volume_24h double").selectExpr("*", "timestamp_seconds(id * 1000) AS fetched_at")
    got = {(r.symbol, r.lag): r.corr for r in correlate.full_correlation(table, stretch=stretch).collect()}
    want = {}
    for s in ("A", "B"):
        price, volume = (np.array([r[i] for r in rows if r[0] == s]) for i in (2, 3))
        z = lambda x: (x - x.mean()) / x.std(ddof=1)
        full = np.correlate(z(price), z(volume), "full") / len(price)
        want |= {(s, k - len(price) + 1): c for k, c in enumerate(full)}
    assert got.keys() == want.keys()
    assert max(abs(got[k] - want[k]) for k in want) < 1e-4


def test_stretches_get_longer_with_the_series(spark, monkeypatch):
    """A long series has STRETCHES stretches, until they are of LONGEST rows; its lags are the same."""
    monkeypatch.setattr(correlate, "STRETCHES", 3)
    monkeypatch.setattr(correlate, "LONGEST", 64)
    rows = spark.range(300).selectExpr("id", "if(id < 40, 'A', 'B') AS symbol", "timestamp_seconds(id) AS fetched_at", "CAST(id * id % 17 AS double) AS price", "CAST(id * 7 % 23 AS double) AS volume_24h")
    of = lambda n: {(r.symbol, r.lag): r.corr for r in correlate.full_correlation(rows, stretch=n).collect()}
    got, want = of(8), of(1000)
    assert len(got) == 79 + 519 and got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 2e-4 for k in want)
