"""Components of edge tables, and how few edges many links leave."""

import numpy as np
import pandas as pd
import pytest

from marketlake.llm import graph, simhash


def smallest_of(edges):
    """The smallest node of each node's component, by union and find."""
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


def graphs():
    rng = np.random.default_rng(3)
    yield "random", rng.integers(-500, 500, (600, 2)).tolist()
    yield "sparse", rng.integers(0, 2000, (500, 2)).tolist()
    yield "chain", [(i, i + 1) for i in rng.permutation(300).tolist()]
    yield "hub", [(i, 7) for i in range(400)] + [(i, 10**9 + i) for i in range(400)]
    yield "all pairs", [(i, j) for i in range(40) for j in range(i)]


@pytest.mark.parametrize("rows_each", [100_000, 50])
@pytest.mark.parametrize(("name", "edges"), list(graphs()), ids=[n for n, _ in graphs()])
def test_components_are_those_of_union_and_find(spark, monkeypatch, name, edges, rows_each):
    monkeypatch.setattr(graph, "ROWS_EACH", rows_each)
    edges = [(a, b) for a, b in edges if a != b]
    got = graph.components(spark.createDataFrame(edges, "a long, b long").repartition(3)).collect()
    assert {r.node: r.root for r in got} == smallest_of(edges) and len(got) == len({x for e in edges for x in e})


def test_no_edges_no_components(spark):
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_stars_say_less_than_an_edge_for_each_node():
    for _, edges in graphs():
        a, b = np.array(edges).T
        node, root = graph.stars(a, b)
        want = smallest_of(edges)
        assert dict(zip(node.tolist(), root.tolist(), strict=True)) == {x: r for x, r in want.items() if x != r}


def test_texts_that_link_under_many_keys_leave_few_edges(spark):
    """A fingerprint of a large group meets the others under each of its 66 keys."""
    rng = np.random.default_rng(5)
    fps = np.uint64(0x0123456789ABCDEF) ^ np.unique(np.array([sum(1 << int(b) for b in rng.choice(64, 3, False)) for _ in range(3000)], np.uint64))
    found = simhash.links(spark.createDataFrame(pd.DataFrame({"fp": fps.view(np.int64)})).repartition(3)).distinct().toPandas()
    assert len(found) < 8 * len(fps)
    assert len(set(smallest_of(found.to_numpy().tolist()).values())) == 1
