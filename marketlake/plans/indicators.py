"""Indicators, correlations and model features over the ticks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import correlate, features, indicators, marts, models
from ..sources.shared import new_path, stored
from ..sources.tables import ticks
from .common import DELTAS_SQL, deltas, rounded, sql

_KEY = ["id", "symbol", "fetched_at"]


def rsi(spark, sf_dir):
    out = indicators.build_rsi(ticks(spark, sf_dir))
    return rounded(out.select(*_KEY, "price", "avg_gain", "avg_loss", "rsi", "rsi_momentum", "rsi_signal", "rsi_strength", "rsi_period"), 4)


def rsi_summary(spark, sf_dir):
    return rounded(indicators.rsi_summary(indicators.build_rsi(ticks(spark, sf_dir))), 4)


def rsi_latest(spark, sf_dir):
    return rounded(indicators.latest_rsi(indicators.build_rsi(ticks(spark, sf_dir))), 4)


def symbol_rsi(spark, sf_dir):
    return rounded(indicators.symbol_rsi_series(ticks(spark, sf_dir), "s3").select(*_KEY, "rsi", "rsi_signal"), 4)


def volatility(spark, sf_dir):
    out = indicators.build_volatility(ticks(spark, sf_dir))
    return rounded(out.select(*_KEY, "price_change_pct", "log_returns", "price_volatility_std", "log_returns_std", "price_change_mean", "price_change_zscore", "volatility_category", "extreme_movement", "period"), 4)


def volatility_summary(spark, sf_dir):
    return rounded(indicators.volatility_summary(indicators.build_volatility(ticks(spark, sf_dir))), 4)


def volatility_latest(spark, sf_dir):
    return rounded(indicators.latest_volatility(indicators.build_volatility(ticks(spark, sf_dir))), 4)


def _hourly(spark, sf_dir):
    return marts.bucketed_price(ticks(spark, sf_dir), "hour")


def moving_averages(spark, sf_dir):
    return rounded(indicators.moving_averages(_hourly(spark, sf_dir), 10, places=6))


def build_moving_averages(spark, sf_dir):
    out = indicators.build_moving_averages(ticks(spark, sf_dir), 12, ("sma", "wma", "ema"))
    return rounded(out.select(*_KEY, "price", "sma", "wma", "ema", "ma_window", "ma_types"), 4)


def technical_features(spark, sf_dir):
    out = indicators.technical_features(ticks(spark, sf_dir))
    return rounded(out.select(*_KEY, *indicators.FEATURES))


def next_up_target(spark, sf_dir):
    return indicators.next_up_target(ticks(spark, sf_dir)).select(*_KEY, "target")


def ma_signals(spark, sf_dir):
    out = indicators.ma_signals(ticks(spark, sf_dir))
    return out.select(*_KEY, "ma_cross_flag", "signal", "crossover", "is_support", "is_resistance", "bullish", "bearish", "rsi_exit")


def drop_repeated_values(spark, sf_dir):
    return rounded(correlate.drop_repeated_values(_hourly(spark, sf_dir).withColumn("price", F.round("price", 0))))


def pearson_pair(spark, sf_dir):
    return correlate.pearson_pair(_hourly(spark, sf_dir), "S1", "S2", places=6)


def pearson_matrix(spark, sf_dir):
    return correlate.pearson_matrix(_hourly(spark, sf_dir), places=6)


def cross_correlation(spark, sf_dir):
    return correlate.cross_correlation(ticks(spark, sf_dir), 12)


def full_correlation(spark, sf_dir):
    return correlate.full_correlation(ticks(spark, sf_dir))


def optimal_lag(spark, sf_dir):
    return correlate.optimal_lag(correlate.cross_correlation(ticks(spark, sf_dir), 12))


def window_features(spark, sf_dir):
    return rounded(features.window_features(deltas(spark, sf_dir).drop("date_end"), ticks(spark, sf_dir)), 4)


def ml_features_view(spark, sf_dir):
    return rounded(features.ml_features_view(deltas(spark, sf_dir), ticks(spark, sf_dir)), 4)


def symbol_volatility(spark, sf_dir):
    return rounded(indicators.symbol_volatility_series(ticks(spark, sf_dir), "s3").select(*_KEY, "price_volatility_std", "volatility_category", "extreme_movement"), 4)


def lag_map(spark, sf_dir):
    """The map of every symbol, and its entries as rows."""
    found = correlate.lag_map(correlate.cross_correlation(ticks(spark, sf_dir), 12))
    return found.select("symbol", F.explode("correlations").alias("lag", "corr"))


def clean_training_rows(spark, sf_dir):
    """Rows of which some features are missing, all features missing, or the target is out of range."""
    rows = features.window_features(deltas(spark, sf_dir).drop("date_end"), ticks(spark, sf_dir))
    odd = F.hour("date_start") % 5 == 0
    rows = rows.withColumns({"avg_price": F.when(~odd, F.col("avg_price")), "avg_volume_24h": F.when(F.hour("date_start") % 3 > 0, F.col("avg_volume_24h"))})
    found = features.clean_training_rows(rows, ["avg_price", "avg_volume_24h"], "target_pct", 300.0)
    return rounded(found.select("symbol", "date_start", "target_pct", "avg_price", "avg_volume_24h"), 4)


def _training_rows(found, ticks):
    rows = features.window_features(found, ticks)
    return features.clean_training_rows(rows, models.WINDOW_FEATURES, "target_pct").withColumn("id", F.xxhash64("symbol", "date_start"))


def next_price(spark, sf_dir):
    """Prices of each symbol's next window, from models that were fitted, saved and read back."""
    found = stored(deltas(spark, sf_dir).drop("date_end"), "deltas")
    rows, path = _training_rows(found, ticks(spark, sf_dir)), new_path(spark, "models")
    for name, fitted in (("percent", models.train_regression(rows)), ("up", models.train_classifier(rows))):
        models.save_model(fitted, f"{path}/{name}", spark)
    percent, up = (models.load_model(spark, f"{path}/{name}").model for name in ("percent", "up"))
    return rounded(models.predict_next_price(percent, up, found, ticks(spark, sf_dir)), 4)


def stratified_split(spark, sf_dir):
    rows = indicators.next_up_target(ticks(spark, sf_dir))
    return features.split(rows, [0.7, 0.2, 0.1], stratify="target").groupBy("target", "part").agg(F.count("*").alias("n_rows"))


QUERIES = {
    f.__name__: f
    for f in (rsi, rsi_summary, rsi_latest, symbol_rsi, volatility, volatility_summary, volatility_latest, moving_averages, build_moving_averages, technical_features, next_up_target, ma_signals, drop_repeated_values, pearson_pair, pearson_matrix, cross_correlation, full_correlation, optimal_lag, window_features, ml_features_view, symbol_volatility, lag_map, clean_training_rows, next_price, stratified_split)
}

_RSI = """, r0 AS (SELECT *, price - lag(price) OVER (PARTITION BY symbol ORDER BY fetched_at, id) AS step, row_number() OVER (PARTITION BY symbol ORDER BY fetched_at, id) AS i FROM ticks WHERE price IS NOT NULL),
r1 AS (SELECT *, CASE WHEN step > 0 THEN step ELSE 0 END AS gain, CASE WHEN step < 0 THEN -step ELSE 0 END AS loss FROM r0),
r2 AS (SELECT *, CASE WHEN i >= 14 THEN avg(gain) OVER f END AS avg_gain, CASE WHEN i >= 14 THEN avg(loss) OVER f END AS avg_loss FROM r1 WINDOW f AS (PARTITION BY symbol ORDER BY fetched_at, id ROWS 13 PRECEDING)),
r3 AS (SELECT *, CASE WHEN avg_gain IS NULL THEN NULL WHEN avg_loss <> 0 THEN 100 - 100 / (1 + avg_gain / avg_loss) WHEN avg_gain > 0 THEN 100.0 ELSE 'NaN'::DOUBLE END AS rsi FROM r2),
r AS (SELECT *, rsi - lag(rsi) OVER (PARTITION BY symbol ORDER BY fetched_at, id) AS rsi_momentum,
  CASE WHEN rsi >= 70 THEN 'overbought' WHEN rsi <= 30 THEN 'oversold' ELSE 'neutral' END AS rsi_signal,
  CASE WHEN rsi >= 80 THEN 'very_strong_buy' WHEN rsi >= 70 THEN 'strong_buy' WHEN rsi >= 50 THEN 'bullish' WHEN rsi >= 30 THEN 'bearish' WHEN rsi >= 20 THEN 'strong_sell' ELSE 'very_strong_sell' END AS rsi_strength FROM r3)"""
_VOL = """, v0 AS (SELECT *, lag(price) OVER (PARTITION BY symbol ORDER BY fetched_at, id) AS prev FROM ticks WHERE price IS NOT NULL),
v1 AS (SELECT *, (price - prev) / nullif(prev, 0) * 100 AS price_change_pct, CASE WHEN price > 0 AND prev > 0 THEN ln(price) - ln(prev) END AS log_returns FROM v0),
v2 AS (SELECT *, CASE WHEN count(price_change_pct) OVER f >= 14 THEN stddev_samp(price_change_pct) OVER f END AS price_volatility_std,
  CASE WHEN count(log_returns) OVER f >= 14 THEN stddev_samp(log_returns) OVER f END AS log_returns_std, CASE WHEN count(price_change_pct) OVER f >= 14 THEN avg(price_change_pct) OVER f END AS price_change_mean
  FROM v1 WINDOW f AS (PARTITION BY symbol ORDER BY fetched_at, id ROWS 13 PRECEDING)),
q0 AS (SELECT symbol, price_volatility_std AS s, row_number() OVER (PARTITION BY symbol ORDER BY price_volatility_std) - 1 AS k, count(*) OVER (PARTITION BY symbol) AS n FROM v2 WHERE price_volatility_std IS NOT NULL),
q AS (SELECT symbol, max(s) FILTER (WHERE k = floor((n - 1) * 0.25 + 0.5)) AS q25, max(s) FILTER (WHERE k = floor((n - 1) * 0.75 + 0.5)) AS q75 FROM q0 GROUP BY 1),
v AS (SELECT v2.*, CASE WHEN price_volatility_std > 0 THEN (price_change_pct - price_change_mean) / price_volatility_std END AS price_change_zscore,
  CASE WHEN price_volatility_std > q75 THEN 'high' WHEN price_volatility_std > q25 THEN 'medium' WHEN price_volatility_std IS NOT NULL THEN 'low' END AS volatility_category,
  coalesce(abs(CASE WHEN price_volatility_std > 0 THEN (price_change_pct - price_change_mean) / price_volatility_std END) > 2, false) AS extreme_movement FROM v2 LEFT JOIN q USING (symbol))"""
_MODE = "SELECT symbol, {0} AS label FROM (SELECT symbol, {0}, row_number() OVER (PARTITION BY symbol ORDER BY count(*) DESC, {0}) AS k FROM {1} GROUP BY 1, 2) WHERE k = 1"
_EMA = """, {name} AS (SELECT symbol, i, {start} AS y FROM {rows} WHERE i = {first}
  UNION ALL SELECT n.symbol, n.i, 2.0::DOUBLE / ({span} + 1) * n.{value} + (1 - 2.0::DOUBLE / ({span} + 1)) * e.y FROM {name} e JOIN {rows} n ON n.symbol = e.symbol AND n.i = e.i + 1)"""


def _ema(name, span, rows="p", value="price", first=1, start=None):
    return _EMA.format(name=name, span=span, rows=rows, value=value, first=first, start=start or value)


_P = ", p AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY fetched_at, id) AS i FROM ticks WHERE price IS NOT NULL)"
_HOURS = ", h AS (SELECT symbol, date_trunc('hour', fetched_at) AS t, avg(price) AS price FROM ticks WHERE price IS NOT NULL GROUP BY 1, 2)"
_PEARSON = """round(corr(a.price, b.price), 6) AS correlation_pearson, count(*) AS n_points, round(avg(a.price), 6) AS mean_a, round(avg(b.price), 6) AS mean_b, round(stddev_samp(a.price), 6) AS std_a, round(stddev_samp(b.price), 6) AS std_b"""
_STRENGTH = "CASE WHEN abs(correlation_pearson) >= 0.9 THEN 'very strong' WHEN abs(correlation_pearson) >= 0.7 THEN 'strong' WHEN abs(correlation_pearson) >= 0.5 THEN 'moderate' WHEN abs(correlation_pearson) >= 0.3 THEN 'weak' ELSE 'very weak' END AS strength"
_CCF = """, z0 AS (SELECT symbol, price, volume_24h, row_number() OVER (PARTITION BY symbol ORDER BY fetched_at, id) AS i, count(*) OVER s AS n, avg(price) OVER s AS mp, stddev_samp(price) OVER s AS sp, avg(volume_24h) OVER s AS mv, stddev_samp(volume_24h) OVER s AS sv
  FROM ticks WHERE price IS NOT NULL AND volume_24h IS NOT NULL WINDOW s AS (PARTITION BY symbol)),
z AS (SELECT symbol, i, n, (price - mp) / sp AS pz, (volume_24h - mv) / sv AS vz FROM z0 WHERE n >= 10 AND sp > 0 AND sv > 0),
ccf AS (SELECT v.symbol, CAST(k AS INTEGER) AS lag, round(coalesce(sum(p.pz * v.vz), 0) / v.n, 4) AS corr, v.n FROM z v CROSS JOIN (SELECT unnest(range(-12, 13)) AS k) LEFT JOIN z p ON p.symbol = v.symbol AND p.i = v.i + k WHERE abs(k) < v.n GROUP BY 1, 2, 4)"""
_MEASURES = "count(t.id) AS n_ticks, round(avg(t.price), 4) AS avg_price, round(avg(t.market_cap), 4) AS avg_market_cap, round(avg(t.volume_24h), 4) AS avg_volume_24h, round(avg(t.coin_circulating), 4) AS avg_coin_circulating"
_Z = lambda x: f"CASE WHEN {x} IS NULL OR isnan({x}) OR isinf({x}) THEN 0.0 ELSE round({x}, 6) END"

ORACLE_SQL = {
    "rsi": sql(_RSI + """ SELECT id, symbol, fetched_at, round(price, 4) AS price, round(avg_gain, 4) AS avg_gain, round(avg_loss, 4) AS avg_loss, round(CASE WHEN NOT isnan(rsi) THEN rsi END, 4) AS rsi,
  round(CASE WHEN NOT isnan(rsi_momentum) THEN rsi_momentum END, 4) AS rsi_momentum, rsi_signal, rsi_strength, 14 AS rsi_period FROM r"""),
    "rsi_summary": sql(_RSI + f", m AS ({_MODE.format('rsi_signal', '(SELECT * FROM r WHERE rsi IS NOT NULL)')})" + """
SELECT symbol, round(avg(rsi), 4) AS avg_rsi, round(max(rsi), 4) AS max_rsi, round(min(rsi), 4) AS min_rsi, round(stddev_samp(rsi), 4) AS rsi_volatility, count(*) FILTER (WHERE rsi_signal = 'overbought') AS overbought_periods,
  count(*) FILTER (WHERE rsi_signal = 'oversold') AS oversold_periods, any_value(label) AS dominant_signal, count(*) AS data_points FROM r JOIN m USING (symbol) WHERE rsi IS NOT NULL GROUP BY 1"""),
    "rsi_latest": sql(_RSI + """ SELECT symbol, fetched_at, round(price, 4) AS price, round(rsi, 4) AS rsi, rsi_signal, rsi_strength, round(rsi_momentum, 4) AS rsi_momentum
  FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY fetched_at DESC, id DESC) AS k FROM r WHERE rsi IS NOT NULL) WHERE k = 1"""),
    "symbol_rsi": sql(_RSI + " SELECT id, symbol, fetched_at, round(CASE WHEN NOT isnan(rsi) THEN rsi END, 4) AS rsi, rsi_signal FROM r WHERE symbol = 'S3' AND rsi IS NOT NULL"),
    "volatility": sql(_VOL + """ SELECT id, symbol, fetched_at, round(price_change_pct, 4) AS price_change_pct, round(log_returns, 4) AS log_returns, round(price_volatility_std, 4) AS price_volatility_std, round(log_returns_std, 4) AS log_returns_std,
  round(price_change_mean, 4) AS price_change_mean, round(price_change_zscore, 4) AS price_change_zscore, volatility_category, extreme_movement, 14 AS period FROM v"""),
    "volatility_summary": sql(_VOL + f", m AS ({_MODE.format('volatility_category', '(SELECT * FROM v WHERE price_volatility_std IS NOT NULL)')})" + """
SELECT symbol, round(avg(price_volatility_std), 4) AS avg_volatility, round(max(price_volatility_std), 4) AS max_volatility, round(min(price_volatility_std), 4) AS min_volatility, count(*) FILTER (WHERE extreme_movement) AS extreme_movements,
  any_value(label) AS dominant_category, count(*) AS data_points FROM v JOIN m USING (symbol) WHERE price_volatility_std IS NOT NULL GROUP BY 1"""),
    "volatility_latest": sql(_VOL + """ SELECT symbol, fetched_at, round(price, 4) AS price, round(price_volatility_std, 4) AS price_volatility_std, round(price_change_zscore, 4) AS price_change_zscore, volatility_category, extreme_movement
  FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY fetched_at DESC, id DESC) AS k FROM v WHERE price_volatility_std IS NOT NULL) WHERE k = 1"""),
    "moving_averages": sql(_HOURS + ", p AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY t) AS i FROM h)" + _ema("e", 10, first=10, start="(SELECT avg(q.price) FROM p q WHERE q.symbol = p.symbol AND q.i <= 10)") + """
, s AS (SELECT *, avg(price) OVER f AS sma, list(price) OVER f AS l FROM p WINDOW f AS (PARTITION BY symbol ORDER BY t ROWS 9 PRECEDING))
SELECT symbol, t, round(price, 6) AS price, round(sma, 6) AS sma, round(list_sum([l[k] * k FOR k IN range(1, 11)]) / 55, 6) AS wma, round(y, 6) AS ema FROM s JOIN e USING (symbol, i) WHERE i >= 10"""),
    "build_moving_averages": sql(_P + _ema("e", 12) + """
, s AS (SELECT *, avg(price) OVER f AS sma, list(price) OVER f AS l FROM p WINDOW f AS (PARTITION BY symbol ORDER BY i ROWS 11 PRECEDING))
SELECT id, symbol, fetched_at, round(price, 4) AS price, CASE WHEN i >= 12 THEN round(sma, 4) END AS sma, CASE WHEN i >= 12 THEN round(list_sum([l[k] * k FOR k IN range(1, 13)]) / 78, 4) END AS wma, round(y, 4) AS ema, 12 AS ma_window, 'sma,wma,ema' AS ma_types
FROM s JOIN e USING (symbol, i)"""),
    "technical_features": sql(_P + _ema("e12", 12) + _ema("e26", 26) + ", m0 AS (SELECT symbol, i, e12.y - e26.y AS macd FROM e12 JOIN e26 USING (symbol, i))" + _ema("e9", 9, "m0", "macd") + """
, g AS (SELECT *, price - lag(price) OVER (PARTITION BY symbol ORDER BY i) AS step FROM p),
f AS (SELECT g.*, """ + ", ".join(f"avg(price) OVER (PARTITION BY symbol ORDER BY i ROWS {n - 1} PRECEDING) AS price_ma_{n}" for n in (5, 10, 20, 50)) + ", " + ", ".join(f"avg(volume_24h) OVER (PARTITION BY symbol ORDER BY i ROWS {n - 1} PRECEDING) AS volume_ma_{n}" for n in (5, 20)) + ", " + ", ".join(f"price / nullif(lag(price, {n}) OVER (PARTITION BY symbol ORDER BY i), 0) - 1 AS price_change_{n}" for n in (1, 5, 10)) + """,
  volume_24h / nullif(lag(volume_24h) OVER (PARTITION BY symbol ORDER BY i), 0) - 1 AS volume_change,
  avg(CASE WHEN step > 0 THEN step ELSE 0 END) OVER (PARTITION BY symbol ORDER BY i ROWS 13 PRECEDING) AS gain, avg(CASE WHEN step < 0 THEN -step ELSE 0 END) OVER (PARTITION BY symbol ORDER BY i ROWS 13 PRECEDING) AS loss,
  stddev_samp(price) OVER (PARTITION BY symbol ORDER BY i ROWS 19 PRECEDING) AS bb_std, stddev_samp(price) OVER (PARTITION BY symbol ORDER BY i ROWS 9 PRECEDING) AS volatility FROM g)
SELECT id, symbol, fetched_at, """ + ", ".join(f"{_Z(c)} AS {c}" for c in ("price", "volume_24h", "market_cap", "coin_circulating", "price_ma_5", "price_ma_10", "price_ma_20", "price_ma_50", "volume_ma_5", "volume_ma_20", "price_change_1", "price_change_5", "price_change_10", "volume_change", "volatility")) + f"""
, round(coalesce(100 - 100 / (1 + gain / nullif(loss, 0)), 50), 6) AS rsi, {_Z('macd')} AS macd, {_Z('e9.y')} AS macd_signal, {_Z('(macd - e9.y)')} AS macd_diff,
  {_Z('((price - price_ma_20 + 2 * bb_std) / nullif(4 * bb_std, 0))')} AS bb_position, {_Z('(price / nullif(price_ma_5, 0))')} AS price_to_ma5, {_Z('(price / nullif(price_ma_20, 0))')} AS price_to_ma20, {_Z('(volume_24h / nullif(volume_ma_5, 0))')} AS volume_ratio
FROM f JOIN m0 USING (symbol, i) JOIN e9 USING (symbol, i)"""),
    "next_up_target": sql("SELECT id, symbol, fetched_at, coalesce(CAST(lead(price) OVER (PARTITION BY symbol ORDER BY fetched_at, id) > price AS INTEGER), 0) AS target FROM ticks WHERE price IS NOT NULL"),
    "ma_signals": sql(_RSI + ", p AS (SELECT * FROM r)" + _ema("e10", 10) + _ema("e50", 50) + """
, a AS (SELECT p.*, e10.y > e50.y AS up, """ + ", ".join(f"CASE WHEN i >= {n} THEN avg(price) OVER (PARTITION BY symbol ORDER BY i ROWS {n - 1} PRECEDING) END AS m{n}" for n in (5, 20, 50, 200)) + """ FROM p JOIN e10 USING (symbol, i) JOIN e50 USING (symbol, i)),
b AS (SELECT *, lag(price) OVER w AS pb, lag(m20) OVER w AS mb, lag(rsi) OVER w AS rb, lag(up) OVER w AS ub FROM a WINDOW w AS (PARTITION BY symbol ORDER BY i))
SELECT id, symbol, fetched_at, CAST(coalesce(m5 > m20, false) AS INTEGER) AS ma_cross_flag, CAST(up AS INTEGER) AS signal, coalesce(up <> ub, false) AS crossover, coalesce(price < m20 AND pb > mb, false) AS is_support, coalesce(price > m20 AND pb < mb, false) AS is_resistance,
  coalesce(price > m20 AND m20 > m50 AND m50 > m200, false) AS bullish, coalesce(price < m20 AND m20 < m50 AND m50 < m200, false) AS bearish,
  CASE WHEN rb <= 30 AND rsi > 30 THEN 'buy' WHEN rb >= 70 AND rsi < 70 THEN 'sell' ELSE 'none' END AS rsi_exit FROM b"""),
    "drop_repeated_values": sql(_HOURS + " SELECT symbol, min(t) AS t, price FROM (SELECT symbol, t, round(price, 0) AS price FROM h) GROUP BY 1, 3"),
    "pearson_pair": sql(_HOURS + f", r AS (SELECT {_PEARSON} FROM h a JOIN h b USING (t) WHERE a.symbol = 'S1' AND b.symbol = 'S2') SELECT *, {_STRENGTH} FROM r"),
    "pearson_matrix": sql(_HOURS + f", r AS (SELECT a.symbol AS symbol_a, b.symbol AS symbol_b, {_PEARSON} FROM h a JOIN h b USING (t) WHERE a.symbol < b.symbol GROUP BY 1, 2 HAVING count(*) >= 3) SELECT *, {_STRENGTH} FROM r"),
    "cross_correlation": sql(_CCF + " SELECT * FROM ccf"),
    "full_correlation": sql(_CCF + " SELECT p.symbol, p.i - v.i AS lag, round(sum(p.pz * v.vz) / p.n, 4) + 0.0 AS corr, p.n FROM z p JOIN z v USING (symbol) GROUP BY p.symbol, p.i - v.i, p.n"),
    "lag_map": sql(_CCF + " SELECT symbol, lag, corr FROM ccf"),
    "symbol_volatility": sql(_VOL + " SELECT id, symbol, fetched_at, round(price_volatility_std, 4) AS price_volatility_std, volatility_category, extreme_movement FROM v WHERE symbol = 'S3' AND price_volatility_std IS NOT NULL"),
    "clean_training_rows": sql(DELTAS_SQL + f"""
, f AS (SELECT d.symbol, window_start AS date_start, delta_pct AS target_pct, CASE WHEN hour(window_start) % 5 <> 0 THEN avg(t.price) END AS a, CASE WHEN hour(window_start) % 3 > 0 THEN avg(t.volume_24h) END AS b
  FROM d JOIN ticks t ON t.symbol = d.symbol AND t.fetched_at >= window_start AND t.fetched_at < window_end GROUP BY 1, 2, 3)
SELECT symbol, date_start, round(target_pct, 4) AS target_pct, round(coalesce(a, 0), 4) AS avg_price, round(coalesce(b, 0), 4) AS avg_volume_24h FROM f WHERE target_pct IS NOT NULL AND abs(target_pct) <= 300 AND (a IS NOT NULL OR b IS NOT NULL)"""),
    "stratified_split": sql("""
, t AS (SELECT coalesce(CAST(lead(price) OVER (PARTITION BY symbol ORDER BY fetched_at, id) > price AS INTEGER), 0) AS target FROM ticks WHERE price IS NOT NULL),
r AS (SELECT target, row_number() OVER (PARTITION BY target) AS r, count(*) OVER (PARTITION BY target) AS n FROM t)
SELECT target, CASE WHEN (r - 0.5::DOUBLE) / n <= 1.0::DOUBLE - 0.1::DOUBLE - 0.2::DOUBLE THEN 0 WHEN (r - 0.5::DOUBLE) / n <= 1.0::DOUBLE - 0.1::DOUBLE THEN 1 ELSE 2 END AS part, count(*) AS n_rows FROM r GROUP BY 1, 2"""),
    "optimal_lag": sql(_CCF + """ SELECT symbol, lag, corr, n, CASE WHEN abs(corr) >= 0.5 THEN 'strong' WHEN abs(corr) >= 0.3 THEN 'moderate' WHEN abs(corr) >= 0.1 THEN 'weak' ELSE 'negligible' END AS strength,
  'Corrélation ' || CASE WHEN abs(corr) < 0.1 THEN 'négligeable' WHEN abs(corr) < 0.3 THEN 'faible' WHEN abs(corr) < 0.5 THEN 'modérée' WHEN abs(corr) < 0.7 THEN 'forte' ELSE 'très forte' END || ' (' || CASE WHEN corr > 0 THEN 'positive' ELSE 'négative' END || '). '
  || CASE WHEN lag > 0 THEN 'Le volume précède le prix de ' || lag || ' période(s)' WHEN lag < 0 THEN 'Le prix précède le volume de ' || -lag || ' période(s)' ELSE 'Volume et prix sont synchronisés' END || '.' AS interpretation
  FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY abs(corr) DESC, lag) AS k FROM ccf) WHERE k = 1"""),
    "window_features": sql(DELTAS_SQL + f""" SELECT d.symbol, window_start AS date_start, '1h' AS window_label, round(delta_pct, 4) AS delta_pct, {_MEASURES}, round(delta_pct, 4) AS target_pct, CAST(delta_pct > 0 AS INTEGER) AS target_up
  FROM d JOIN ticks t ON t.symbol = d.symbol AND t.fetched_at >= window_start AND t.fetched_at < window_end GROUP BY d.symbol, window_start, delta_pct"""),
    "ml_features_view": sql(DELTAS_SQL + f""" SELECT d.symbol, window_start AS date_start, window_end AS date_end, round(delta_pct, 4) AS delta_pct, {_MEASURES}
  FROM d LEFT JOIN ticks t ON t.symbol = d.symbol AND t.fetched_at >= window_start AND t.fetched_at < window_end GROUP BY d.symbol, window_start, window_end, delta_pct"""),
}
