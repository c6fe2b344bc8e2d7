"""Importance resampling against a brute-force version."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from marketlake.llm import queries, resample

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features_of(text):
    words = WORD.findall((text or "").translate(LOWER))
    return len(words), [*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]


def brute(docs, target, buckets=10_000, least_words=20, percent=25):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(bucket, features_of(text)[1]))
    for text in target:
        t.update(map(bucket, features_of(text)[1]))
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets)))) for b in range(buckets)]
    rows, fit = [], []
    for i, (doc_id, text) in enumerate(docs):
        n_words, found = features_of(text)
        weight = sum(gain[bucket(f)] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(found), weight, score, None])
        if n_words >= least_words:
            fit.append((-score, doc_id is None, doc_id or 0, i))
    for rank, (*_, i) in enumerate(sorted(fit)[: percent * len(fit) // 100], 1):
        rows[i][-1] = rank
    return rows


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    target = [r[0] for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("text").collect()]
    got = queries.QUERIES["op12_importance_resampling"](spark, sf)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
    assert ordered(got.collect()) == ordered(brute(docs, target))


def test_edge_rows(spark, edges, nothing):
    target = spark.createDataFrame([(1, "alpha beta gamma"), (2, None)], "item_id long, text string")
    rows = [(r.doc_id, r.text) for r in edges.collect()]
    got = resample.resample(edges, target, least_words=1, percent=50).select("doc_id", "n_features", "weight", "score", "rank").collect()
    want = brute(rows, ["alpha beta gamma", None], least_words=1, percent=50)
    assert ordered(got) == ordered(want)
    assert resample.resample(nothing, target).count() == 0
    assert resample.resample(edges, target.where("false")).count() == edges.count()
    assert all(r.rank is None for r in resample.resample(edges, target, percent=0).collect())


@pytest.mark.parametrize("k", [1, 2, 77, 499, 500, 501, 1000, 2000])
def test_quickselect_of_ties(spark, k):
    rows = spark.range(1000).select((F_col("id") % 3).alias("a"), (F_col("id") % 7).alias("b"), "id")
    want = sorted((r.a, r.b, r.id) for r in rows.collect())[:k]
    assert sorted((r.a, r.b, r.id) for r in resample.smallest(rows, ["a", "b", "id"], k, pivots=3).collect()) == want


def F_col(name):
    from pyspark.sql import functions as F

    return F.col(name)


def test_words_cut_in_pieces_give_the_same_features():
    text = "Alpha beta-gamma, δelta  epsilon zeta7 eta".encode() * 5
    whole = list(resample.features(text, 97))
    for piece in (1, 3, 8, 1000):
        parts = list(resample.features(text, 97, piece))
        assert sum(n for n, _ in parts) == sum(n for n, _ in whole)
        assert Counter(x for _, f in parts for x in f.tolist()) == Counter(x for _, f in whole for x in f.tolist())
