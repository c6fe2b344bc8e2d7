"""Substring dedup and its FM-index against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from oracle import compare

from marketlake.llm import fmindex, queries, substrings

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(docs, window=13):
    """(doc_id, text, n_words, n_removed) of each (doc_id, text)."""
    first = {}
    split = [(float("inf") if i is None else i, WORD.findall(t or "")) for i, t in docs]
    for i, words in split:
        for at in range(len(words) - window + 1):
            key = tuple(words[at : at + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for (doc_id, _), (i, words) in zip(docs, split, strict=True):
        gone = {p for at in range(len(words) - window + 1) if first[tuple(words[at : at + window])] < i for p in range(at, at + window)}
        out.append((doc_id, " ".join(w for p, w in enumerate(words) if p not in gone), len(words), len(gone)))
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("seed", range(5))
def test_statistics_against_search(seed):
    rng = random.Random(seed)
    texts = [[rng.randint(1, 3 + seed) for _ in range(rng.randint(1, 40))] for _ in range(12)]
    symbols = np.array([x for t in texts for x in (*t, 0)])
    owner = np.repeat(np.arange(12)[::-1], [len(t) + 1 for t in texts])
    index = fmindex.FMIndex(symbols, owner, 6)
    stream = np.array([rng.randint(0, 5 + seed) for _ in range(200)])
    flat = symbols.tolist()
    starts = defaultdict(list)
    for n in range(1, 7):
        for i in range(len(flat) - n + 1):
            starts[tuple(flat[i : i + n])].append(i)
    for rows in (1, 2, 5):
        length, low, high = index.statistics(stream, 6, rows)
        for e in range(200):
            n, at = 0, None
            while n < 6 and e - n >= 0 and stream[e - n] and len(starts[tuple(stream[e - n : e + 1].tolist())]) >= rows:
                at = starts[tuple(stream[e - n : e + 1].tolist())]
                n += 1
            assert length[e] == n
            if n:
                assert high[e] - low[e] == len(at)
                assert index.owners.least(low[e : e + 1], high[e : e + 1])[0] == min(owner[i] for i in at)


def test_bits_and_tree():
    rng = np.random.default_rng(0)
    for n in (0, 1, 63, 64, 65, 500):
        values = rng.integers(0, 11, n)
        bits = fmindex.Bits(values > 4)
        assert bits.rank(np.arange(n + 1)).tolist() == [int((values[:i] > 4).sum()) for i in range(n + 1)]
        tree = fmindex.WaveletTree(values)
        for symbol in range(11):
            if symbol.bit_length() <= tree.height:
                at = tree.leaf(np.full(n + 1, symbol), np.arange(n + 1))
                assert (at - at[0]).tolist() == [int((values[:i] == symbol).sum()) for i in range(n + 1)]


def shared_passages(n=120):
    rng = random.Random(1)
    passages = [[f"p{k}w{j}" for j in range(30)] for k in range(3)]
    docs = []
    for i in range(n):
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(0, 30))]
        words += passages[i % 3][rng.randint(0, 12) : rng.randint(15, 30)]
        words += [f"w{rng.randint(0, 40)}" for _ in range(rng.randint(0, 20))]
        if i % 5 == 0:
            words += ["again"] * rng.randint(1, 90)
        docs.append((i * 7 % n, rng.choice([" ", "\n", "\t \x0b"]).join(words)))
    return docs


@pytest.mark.parametrize("hot", [substrings.HOT, 3])
def test_shared_passages_against_brute_force(spark, hot, monkeypatch):
    docs = shared_passages() + [(None, " ".join(f"p0w{j}" for j in range(30))), (5, "repeated " * 20), (5, "repeated " * 20)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = substrings.dedup_substrings(frame, hot=hot)
    assert ordered(got.collect()) == ordered(brute(docs))
    monkeypatch.setattr(substrings, "RUN", 2)
    got = substrings.dedup_substrings(frame, window=5, gram=2, hot=hot)
    assert ordered(got.collect()) == ordered(brute(docs, 5))


def test_small_shards_give_the_same(spark):
    docs = shared_passages(60)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = substrings.segments(frame, substrings.shared_minimizers(frame, 13, 8), 13, 8)
    distinct = found.selectExpr("key", "digest", "words", "doc AS low", "doc AS high").dropDuplicates(["key", "digest"])
    both = [ordered((r.key, r.digest, tuple(r.owners)) for r in substrings.searched(distinct.withColumn("high", distinct.high + 1000), 13, shard).collect()) for shard in (1, 10**6)]
    assert both[0] == both[1] and both[0]


def test_edge_rows(spark, edges, nothing):
    rows = [(r.doc_id, r.text) for r in edges.collect()]
    got = substrings.dedup_substrings(edges)
    assert got.columns == ["doc_id", "text", "n_words", "n_removed"]
    assert ordered(got.collect()) == ordered(brute(rows))
    assert substrings.dedup_substrings(nothing).count() == 0


def test_query_against_sql(spark):
    name = "op11_substring_dedup"
    assert compare(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], "/root/testdata/sf0.001") is None
