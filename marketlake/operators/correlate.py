"""Correlations of pairs of series, and of price and volume over lags."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import correlation_strength, correlation_text
from .series import indexed, rolling


def drop_repeated_values(bucketed: DataFrame) -> DataFrame:
    """Keep a price's first bucket in its symbol's series, wherever it comes again."""
    return bucketed.groupBy("symbol", "price").agg(F.min("t").alias("t")).select("symbol", "t", "price")


def pair_series(bucketed: DataFrame, a: str, b: str) -> DataFrame:
    """t, price_a and price_b where both have a bucket."""
    side = lambda s, name: bucketed.where(F.upper("symbol") == s.upper()).select("t", F.col("price").alias(name))
    return side(a, "price_a").join(side(b, "price_b"), "t")


def _statistics(places: int):
    rounded = lambda c: F.round(c, places)
    return [
        rounded(F.corr("price_a", "price_b")).alias("correlation_pearson"), F.count("*").alias("n_points"),
        rounded(F.avg("price_a")).alias("mean_a"), rounded(F.avg("price_b")).alias("mean_b"), rounded(F.stddev_samp("price_a")).alias("std_a"), rounded(F.stddev_samp("price_b")).alias("std_b"),
    ]


def pearson_pair(bucketed: DataFrame, a: str, b: str, least: int = 3, places: int = 4) -> DataFrame:
    out = pair_series(bucketed, a, b).agg(*_statistics(places)).where(F.col("n_points") >= least)
    return out.withColumn("strength", correlation_strength("correlation_pearson", "pearson"))


#: Symbols of a tile, and times whose products are summed at once.
TILE, TIMES = 256, 4096
_SUMS = ["n", "a", "b", "aa", "bb", "ab"]


def _tile_sums(pdf: pd.DataFrame) -> pd.DataFrame:
    """The sums over a group's times of every pair of symbols of its two tiles: a times x symbols matrix for each, multiplied."""
    p, q = int(pdf["p"].iloc[0]), int(pdf["q"].iloc[0])
    times = {t: i for i, t in enumerate(pdf["t"].unique())}

    def matrices(tile: int) -> tuple[list[str], np.ndarray, np.ndarray]:
        rows = pdf[pdf["tile"] == tile]
        names = sorted({x["symbol"] for found in rows["found"] for x in found})
        at = {name: i for i, name in enumerate(names)}
        x, there = np.zeros((len(times), len(names))), np.zeros((len(times), len(names)))
        for t, found in zip(rows["t"], rows["found"], strict=True):
            for each in found:
                x[times[t], at[each["symbol"]]], there[times[t], at[each["symbol"]]] = each["x"], 1
        return names, x, there

    left, x, m = matrices(p)
    right, y, k = (left, x, m) if p == q else matrices(q)
    sums = {"n": m.T @ k, "a": x.T @ k, "b": m.T @ y, "aa": (x * x).T @ k, "bb": m.T @ (y * y), "ab": x.T @ y}
    i, j = np.nonzero(sums["n"])
    found = pd.DataFrame({"symbol_a": np.array(left, object)[i], "symbol_b": np.array(right, object)[j], **{c: v[i, j] for c, v in sums.items()}})
    if p == q:
        return found[found["symbol_a"] < found["symbol_b"]]
    turned = found["symbol_a"] > found["symbol_b"]
    found.loc[turned, ["symbol_a", "symbol_b", "a", "b", "aa", "bb"]] = found.loc[turned, ["symbol_b", "symbol_a", "b", "a", "bb", "aa"]].to_numpy()
    return found


def pearson_matrix(bucketed: DataFrame, least: int = 3, top: int | None = None, places: int = 4, tile: int = TILE, times: int = TIMES) -> DataFrame:
    """Every pair of symbols that share ``least`` buckets; with ``top``, a report on the symbols of most points.

    ``bucketed`` has one row for each symbol and bucket.  A bucket's symbols are
    sparse vectors of ``tile`` symbols; each goes to the tile pairs that it belongs
    to, where the products of ``times`` buckets are summed as matrices.  So rows
    grow with the points times the number of tiles, and pairs only appear as sums.
    Prices are taken from the symbol's own mean first, so that sums keep their
    digits.  Two counts are made when this is called.
    """
    rows = bucketed.where("price IS NOT NULL AND symbol IS NOT NULL AND t IS NOT NULL")
    means = rows.groupBy("symbol").agg(F.avg("price").alias("mean"), F.count("*").alias("points"))
    if top is not None:
        means = means.orderBy(F.desc("points"), "symbol").limit(top)
    counts = rows.agg(F.approx_count_distinct("symbol").alias("symbols"), F.approx_count_distinct("t").alias("times")).first()
    tiles, cuts = counts.symbols // tile + 1, counts.times // times + 1
    centred = rows.join(means, "symbol").select("t", "symbol", (F.col("price") - F.col("mean")).alias("x"), F.pmod(F.xxhash64("symbol"), F.lit(tiles)).cast("int").alias("tile"))
    vectors = centred.groupBy("t", "tile").agg(F.collect_list(F.struct("symbol", "x")).alias("found"))
    other = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))
    dealt = vectors.withColumn("other", other).select(F.least("tile", "other").alias("p"), F.greatest("tile", "other").alias("q"), F.pmod(F.xxhash64("t"), F.lit(cuts)).alias("cut"), F.col("t").cast("string").alias("t"), "tile", "found")
    schema = "symbol_a string, symbol_b string, " + ", ".join(f"{c} double" for c in _SUMS)
    sums = dealt.groupBy("p", "q", "cut").applyInPandas(_tile_sums, schema).groupBy("symbol_a", "symbol_b").agg(*(F.sum(c).alias(c) for c in _SUMS))
    for side in "ab":
        sums = sums.join(means.select(F.col("symbol").alias(f"symbol_{side}"), F.col("mean").alias(f"m_{side}")), f"symbol_{side}")
    n, rounded = F.col("n"), lambda c: F.round(c, places)
    spread = lambda s: F.greatest(F.col(s + s) - F.col(s) * F.col(s) / n, F.lit(0.0))
    # what is left of equal prices is rounding
    flat = lambda s: spread(s) <= F.col(s + s) * 1e-14
    r = F.when(~flat("a") & ~flat("b"), (F.col("ab") - F.col("a") * F.col("b") / n) / F.sqrt(spread("a") * spread("b")))
    std = lambda s: F.when(n > 1, F.when(flat(s), F.lit(0.0)).otherwise(F.sqrt(spread(s) / (n - 1))))
    out = sums.select(
        "symbol_a", "symbol_b", rounded(r).alias("correlation_pearson"), n.cast("long").alias("n_points"),
        rounded(F.col("m_a") + F.col("a") / n).alias("mean_a"), rounded(F.col("m_b") + F.col("b") / n).alias("mean_b"), rounded(std("a")).alias("std_a"), rounded(std("b")).alias("std_b"),
    )
    return out.where(F.col("n_points") >= least).withColumn("strength", correlation_strength("correlation_pearson", "pearson"))


def _standardised(ticks: DataFrame, least: int) -> DataFrame:
    """symbol, fetched_at, id, n, pz and vz: prices and volumes of symbols of ``least`` rows that vary, standardised."""
    rows = ticks.where("price IS NOT NULL AND volume_24h IS NOT NULL")
    moments = rows.groupBy("symbol").agg(F.count("*").alias("n"), *(f(c).alias(f"{k}_{c}") for c in ("price", "volume_24h") for k, f in (("m", F.avg), ("s", F.stddev_samp))))
    moments = moments.where((F.col("n") >= least) & (F.col("s_price") > 0) & (F.col("s_volume_24h") > 0))
    return rows.join(moments, "symbol").select("symbol", "fetched_at", "id", "n", ((F.col("price") - F.col("m_price")) / F.col("s_price")).alias("pz"), ((F.col("volume_24h") - F.col("m_volume_24h")) / F.col("s_volume_24h")).alias("vz"))


#: Rows of a series whose products over all lags come from one transform: at least, and at most.
STRETCH, LONGEST = 1 << 15, 1 << 21
#: Stretches of a series, until they are of LONGEST rows.
STRETCHES = 16


def full_correlation(ticks: DataFrame, least: int = 10, stretch: int = STRETCH) -> DataFrame:
    """As ``cross_correlation``, at every lag that the series has.

    The series is cut into stretches.  Each stretch of prices meets each of volumes
    and gives, by fast Fourier transforms of twice the length, its part of the lags
    that the two have between them; parts of a lag are added up.  Stretches get
    longer with the series, so that what moves grows with its rows and not with
    their square; pairs that are equally far apart, whose lags are the same, go to
    one task.
    """
    long = F.least(F.lit(max(stretch, LONGEST)), F.greatest(F.lit(stretch), F.ceil(F.col("n") / STRETCHES))).cast("long")
    placed = indexed(_standardised(ticks, least)).withColumn("stretch", long)
    placed = placed.select("symbol", "n", "stretch", F.floor(F.col("_i") / F.col("stretch")).alias("own"), (F.col("_i") % F.col("stretch")).cast("int").alias("at"), "pz", "vz")
    cut = placed.groupBy("symbol", "n", "stretch", "own").agg(F.sort_array(F.collect_list(F.struct("at", "pz", "vz"))).alias("found"))
    prices = cut.select("symbol", "n", "stretch", F.col("own").alias("p"), F.col("found.pz").alias("prices"))
    volumes = cut.select("symbol", F.col("own").alias("v"), F.col("found.vz").alias("volumes"))
    pairs = prices.join(volumes, "symbol").repartition("symbol", F.col("p") - F.col("v"))
    schema = "symbol string, n long, lag long, total double"

    def transform(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for symbol, n, stretch, p, prices, v, volumes in zip(*(pdf[c] for c in ("symbol", "n", "stretch", "p", "prices", "v", "volumes")), strict=True):
                size = 1 << (len(prices) + len(volumes) - 1).bit_length()
                both = np.fft.irfft(np.fft.rfft(prices, size) * np.conj(np.fft.rfft(volumes, size)), size)
                lags = np.arange(1 - len(volumes), len(prices))
                yield pd.DataFrame({"symbol": symbol, "n": n, "lag": lags + (p - v) * stretch, "total": both[lags]})

    sums = pairs.mapInPandas(transform, schema).groupBy("symbol", "n", "lag").agg(F.sum("total").alias("total"))
    return sums.select("symbol", "lag", (F.round(F.col("total") / F.col("n"), 4) + 0.0).alias("corr"), "n")  # no minus zero


def cross_correlation(ticks: DataFrame, max_lag: int = 12, least: int = 10) -> DataFrame:
    """symbol, lag, corr, n: sum of price_z[t + lag] * volume_z[t] over n, to 4 places; positive lags: volume leads.

    Means and deviations come from one grouped pass; 2 * max_lag + 1 shifted
    products are summed in another, over blocks of the series.
    """
    z = _standardised(ticks, least)
    lags = list(range(-max_lag, max_lag + 1))

    def compute(df: DataFrame, w) -> DataFrame:
        shifted = lambda k: F.lead("pz", k).over(w) if k > 0 else F.lag("pz", -k).over(w) if k < 0 else F.col("pz")
        return df.withColumn("_products", F.array(*(F.coalesce(shifted(k) * F.col("vz"), F.lit(0.0)) for k in lags)))

    products = rolling(z, max_lag, compute, lookahead=max_lag)
    sums = products.groupBy("symbol").agg(F.first("n").alias("n"), *(F.sum(F.col("_products")[i]).alias(f"s{i}") for i in range(len(lags))))
    long = sums.select("symbol", "n", F.explode(F.array(*(F.struct(F.lit(k).alias("lag"), F.col(f"s{i}").alias("total")) for i, k in enumerate(lags)))).alias("x"))
    return long.select("symbol", "x.lag", F.round(F.col("x.total") / F.col("n"), 4).alias("corr"), "n").where(F.abs("lag") < F.col("n"))


def lag_map(ccf: DataFrame) -> DataFrame:
    """symbol and a map from lag to correlation."""
    return ccf.groupBy("symbol").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("lag", "corr")))).alias("correlations"))


def optimal_lag(ccf: DataFrame) -> DataFrame:
    """The lag with the largest absolute rounded correlation, the smallest of ties."""
    w = Window.partitionBy("symbol").orderBy(F.abs("corr").desc(), "lag")
    best = ccf.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")
    return best.withColumn("strength", correlation_strength("corr")).withColumn("interpretation", correlation_text("corr", "lag"))
