"""The conversation trie against a brute-force version."""

import hashlib
import re
import zlib
from collections import defaultdict

import pytest

from marketlake.llm import queries, trie

WORD = re.compile("[^\x20\x09-\x0d]+")


def rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own[conv].append((role or "", text or ""))
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    return out


def brute(convs):
    members = defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
        own = (len(members[node]) - 1) * len(WORD.findall(node[-1][1])) if node else 0
        saved[node] = own + sum(saved[x] for x in children[node])
    rows = []
    for node, who in members.items():
        ends = sorted(c for c in who if len(convs[c]) == len(node))
        digest = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        rows.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), len(children[node]), leaves[node], saved[node], digest))
    return rows


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie_of(spark, rows, splice=True):
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, len int, pos string, p1 string") if rows and len(rows[0]) > 4 else spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = trie.numbered(frame)
    return trie.prefix_trie(*(trie.spliced(turns) if splice else trie.whole(turns)))


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_against_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.QUERIES["op13_conversation_trie"](spark, sf)
    assert got.columns == COLUMNS
    assert ordered(got.collect()) == ordered(brute(rebuilt(rows)))


def test_edge_rows(spark):
    rows = [
        (0, 0, "user", "a b"), (0, 1, None, "c"), (0, None, "system", "s  s\ts"), (0, 2, "user", None),
        *((c, t, "user", f"turn {t} of {c % 3}") for c in range(1, 45) for t in range(c % 6)),
        *((c, t, "user", "same text") for c in range(100, 140) for t in range(3)),
        (None, 1, "user", "no conversation"), (None, None, None, None), (7, 0, "", ""), (-25, 0, "user", "minus"), (-20, 0, "user", "base"), (61, 0, "user", "alone"),
    ]
    rows = [r for i, r in enumerate(rows) if r[:2] not in {x[:2] for x in rows[:i]}]
    extra = [(*r, 1, "x", "y") for r in rows]
    want = rebuilt([r for r in rows if r[0] is None or r[0] >= 0])
    got = trie_of(spark, [r for r in extra if r[0] is None or r[0] >= 0])
    assert ordered(got.collect()) == ordered(brute(want))
    assert trie_of(spark, extra).count() > 0
    assert trie_of(spark, []).count() == 0
    assert trie_of(spark, [(None, 1, "user", "x")]).count() == 0


def test_repeated_rows_are_repeated_turns(spark):
    rows = [(1, 0, "user", "x"), (1, 0, "user", "x"), (2, 0, "user", "x")]
    got = trie_of(spark, rows, splice=False)
    assert ordered(got.collect()) == ordered(brute({1: [("user", "x")] * 2, 2: [("user", "x")]}))


def test_long_conversations_go_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 4)
    monkeypatch.setattr(trie, "IDS", 3)
    rows = [(c, t, "user", f"t{t}" if t != 17 else f"t{t} of {c % 2}") for c in range(9) for t in range(11 + 2 * c)]
    convs = defaultdict(list)
    for c, _, role, text in rows:
        convs[c].append((role, text))
    got = trie_of(spark, rows, splice=False)
    assert ordered(got.collect()) == ordered(brute(convs))
    ends = [(c, 0, "user", "all end here") for c in range(50)]
    assert ordered(trie_of(spark, ends, splice=False).collect()) == ordered(brute({c: [("user", "all end here")] for c in range(50)}))


def test_a_full_sketch_changes_nothing(spark, monkeypatch):
    rows = [(c, t, "user", f"{t} {c // (t + 1)}") for c in range(40) for t in range(5)]
    want = ordered(trie_of(spark, rows).collect())
    assert want == ordered(brute(rebuilt(rows)))
    import numpy as np

    full = lambda keys, columns: [np.full(1 << 10, 2**64 - 1, np.uint64)] * 2
    monkeypatch.setattr(trie, "count_min", full)
    assert ordered(trie_of(spark, rows).collect()) == want


@pytest.mark.parametrize("seed", [1, 2])
def test_a_sketch_that_passes_some_singletons_changes_nothing(spark, monkeypatch, seed):
    """Nodes of one conversation that are grouped though their parents are singletons, and the other way round."""
    rows = [(c, t, "user", f"{t} {c // (t + 1)}" if t < 3 else f"{c} {t}") for c in range(40) for t in range(7)]
    import numpy as np

    exact, rng = trie.count_min, np.random.default_rng(seed)

    def crowded(keys, columns):
        return [row | rng.integers(0, 2**63, len(row), np.uint64) for row in exact(keys, columns)]

    monkeypatch.setattr(trie, "count_min", crowded)
    assert ordered(trie_of(spark, rows).collect()) == ordered(brute(rebuilt(rows)))


def test_sketch_names_no_shared_prefix_single(spark):
    rows = trie.prefixes(trie.whole(trie.numbered(spark.createDataFrame([(c, t, "u", f"{min(c, 3)}") for c in range(30) for t in range(4)], "conv_id long, turn long, role string, text string")))[0])
    marked = trie.screened(rows)
    assert marked.where("single").count() == 12  # conversations 0 to 2
    assert marked.where("NOT single").count() == 27 * 4
