import datetime
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from marketlake.functions import exprs


def column(spark, values, expression, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"v {kind}").select(expression).collect()]


def test_strict_times_refuse_fractions_naive_and_other_formats(spark):
    got = column(spark, ["2025-09-18T10:00:00.123Z", "2025-09-18T10:00:00", "18-09-2025 10:00", "2025-09-18T10:00:00Z", "2025-09-18T10:00:00+02:00", "2025-09-18T10:00:00+0200", None, ""], exprs.parse_strict_utc("v"))
    assert got[:3] == [None] * 3 and got[6:] == [None] * 2
    assert [t.hour for t in got[3:6]] == [10, 8, 8]


def test_flexible_times_and_fallback(spark):
    values = ["2025-09-18T10:00:00.123456", "Tue, 02 Sep 2025 10:00:00 GMT", "Sep 2, 2025", "18-09-2025 10:00", "nonsense", None]
    got = column(spark, values, exprs.parse_flexible_utc("v", "2020-01-01 00:00:00"))
    assert got[0].microsecond == 123456 and got[1] == datetime.datetime(2025, 9, 2, 10) and got[2] == datetime.datetime(2025, 9, 2)
    assert got[3] == datetime.datetime(2025, 9, 18, 10) and got[4] == got[5] == datetime.datetime(2020, 1, 1)


def test_clean_text_and_numbers(spark):
    assert column(spark, ["  a\t\n b  c ", None, ""], exprs.clean_text("v")) == ["a b c", None, ""]
    assert column(spark, ["$1,234.5", "x", None, "7"], exprs.to_number("v")) == [1234.5, None, None, 7.0]


def test_ids_match_their_definitions(spark):
    row = {"url": 'http://x/"q"', "title": "Ünï\tcode", "name": None, "symbol": "BTC", "published_at": None, "fetched_at": "2025-01-01"}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row))
    got = df.select(*(exprs.article_id(v).alias(v) for v in ("url_title", "json", "listing", "folded"))).first()
    sha1 = lambda t: hashlib.sha1(t.encode()).hexdigest()
    assert got.url_title == sha1(row["url"] + row["title"])
    assert got.json == sha1(json.dumps(row, sort_keys=True, ensure_ascii=False))
    assert got.listing == hashlib.sha256(f"{row['url']}|BTC||2025-01-01".encode()).hexdigest()
    assert got.folded == sha1(f"{row['url']}|ünï\tcode")
    with pytest.raises(ValueError):
        exprs.article_id("other")


def test_first_filled_treats_zero_and_empty_as_absent(spark):
    df = spark.createDataFrame([("0", "5"), ("", "6"), (None, "7"), ("3", "8"), ("0.0", None), ("abc", "x")], "a string, b string")
    assert [r[0] for r in df.select(exprs.first_filled("a", "b")).collect()] == ["5", "6", "7", "3", None, "abc"]


def test_window_labels_sources_and_symbols(spark):
    assert column(spark, ["10m", "1h", "7d", "x", None, "2H"], exprs.window_seconds("v")) == [600, 3600, 604800, 3600, 3600, 7200]
    urls = ["https://WWW.CoinGecko.com/x", "https://a.b/c/d", None, "https://crypto-wire.com/a", "https://www.CryptoNews.net/b", "https://www.coindesk.com/c"]
    assert column(spark, urls, exprs.source_of_url("v")) == ["coingecko", "https://a.b", None, "crypto_news", "crypto_news", "https://www.coindesk.com"]
    assert column(spark, [" btc ", "", None, "Eth"], exprs.symbol_key("v")) == ["BTC", None, None, "ETH"]


def test_partition_date(spark):
    df = spark.createDataFrame([("2025-01-02T03", None), ("x", "2025-02-03 1"), (None, None)], "fetched_at string, published_at string")
    assert [r[0] for r in df.select(exprs.partition_date()).collect()] == ["2025-01-02", "2025-02-03", "unknown"]


def test_division_and_correlation_labels(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (6.0, 3.0), (None, 1.0)], "a double, b double")
    got = [r[0] for r in df.select(exprs.ieee_div(F.col("a"), F.col("b"))).collect()]
    assert got[:2] == [float("inf"), float("-inf")] and got[2] != got[2] and got[3] == 2 and got[4] is None
    assert column(spark, [0.95, -0.55, 0.05], exprs.correlation_strength("v"), "double") == ["strong", "strong", "negligible"]
    assert column(spark, [0.95, -0.55, 0.05], exprs.correlation_strength("v", "pearson"), "double") == ["very strong", "moderate", "very weak"]
    assert column(spark, [-0.8], exprs.correlation_text("v", F.lit(-2)), "double") == ["Corrélation très forte (négative). Le prix précède le volume de 2 période(s)."]
    assert column(spark, [0.2], exprs.correlation_text("v", F.lit(0)), "double") == ["Corrélation faible (positive). Volume et prix sont synchronisés."]
