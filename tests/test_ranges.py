"""Range means and as-of values against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from marketlake.operators import ranges

HOUR = 3_600_000_000


def made(seed):
    rng = random.Random(seed)
    times = [rng.randrange(-5 * HOUR, 80 * HOUR) for _ in range(60)] + [k * HOUR for k in range(-2, 6)]
    rows = [(rng.choice("AB"), rng.choice(times), rng.choice([None, 1.5, 2.0, -7.0]), rng.uniform(0, 1e9)) for _ in range(400)]
    spans = [(rng.choice("ABC"), *sorted(rng.sample(times, 2))) for _ in range(80)] + [("A", 0, HOUR), ("A", 5, 5), ("B", 9, 3), (None, 0, HOUR), ("B", -HOUR, 70 * HOUR), ("A", 0, 1)]
    return rows + [(None, 3, 1.0, 1.0), ("A", None, 1.0, 1.0)], spans


@pytest.mark.parametrize("seed, bucket, levels", [(0, 3600, 16), (1, 600, 16), (2, 86400, 16), (3, 3600, 2)])
def test_range_means(spark, seed, bucket, levels, monkeypatch):
    monkeypatch.setattr(ranges, "LEVELS", levels)
    rows, spans = made(seed)
    table = spark.createDataFrame(rows, "symbol string, at long, x double, y double")
    asked = spark.createDataFrame(spans, "symbol string, start long, stop long")
    got = {(r.symbol, r.start, r.stop): (r.n_ticks, r.avg_x, r.avg_y) for r in ranges.range_means(asked, table, ["x", "y"], bucket).collect()}
    want = {}
    for symbol, start, stop in spans:
        inside = [r for r in rows if r[0] is not None and r[0] == symbol and r[1] is not None and start <= r[1] < stop]
        mean = lambda i: (lambda v: sum(v) / len(v) if v else None)([r[i] for r in inside if r[i] is not None])  # noqa: B023, E731
        if inside:
            want[symbol, start, stop] = (len(inside), mean(2), mean(3))
    assert got.keys() == want.keys()
    for k, (n, x, y) in want.items():
        assert got[k][0] == n and got[k][1] == pytest.approx(x, rel=1e-9, abs=1e-12) and got[k][2] == pytest.approx(y, rel=1e-9)


def test_no_row_meets_a_range(spark):
    rows, spans = made(5)
    table = spark.createDataFrame(rows, "symbol string, at long, x double, y double")
    asked = spark.createDataFrame(spans, "symbol string, start long, stop long")
    plan = ranges.range_means(asked, table, ["x"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert ranges.range_means(asked.where("false"), table, ["x"]).count() == 0
    assert ranges.range_means(asked, table.where("false"), ["x"]).count() == 0


@pytest.mark.parametrize("bucket", [600, 3600, 864000])
def test_as_of(spark, bucket):
    rows, spans = made(9)
    table = spark.createDataFrame(rows, "symbol string, at long, x double, y double")
    asked = spark.createDataFrame([(s, t) for s, a, b in spans for t in (a, b)], "symbol string, at long")
    got = {(r.symbol, r.at): r.last for r in ranges.as_of(asked, table, F.struct("at", "y"), bucket).collect()}
    for symbol, *times in spans:
        for t in times:
            if symbol is None:
                continue
            before = [(r[1], r[3]) for r in rows if r[0] == symbol and r[1] is not None and r[1] < t]
            last = got[symbol, t]
            assert (None if last is None else tuple(last)) == max(before, default=None)
