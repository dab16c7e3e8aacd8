import random

import pytest

from gneiss.operators.graph import connected_components, k_hop, subgraph

EDGES = "src_node string, dst_node string, edge_type string"


def truth(edges):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return {n: root(n) for n in list(up)}


def graphs():
    rng = random.Random(4)
    yield [(f"n{i:03}", f"n{i + 1:03}") for i in range(60)]
    yield [("hub", f"s{i}") for i in range(40)] + [(f"s{i}", f"t{i}") for i in range(0, 40, 3)]
    yield [(f"x{rng.randrange(90)}", f"x{rng.randrange(90)}") for _ in range(70)]
    yield [("a", "a"), ("b", "c"), ("c", "b"), ("b", "c")]


@pytest.mark.parametrize("local", [0, 10_000])
@pytest.mark.parametrize("k", range(4))
def test_components(spark, k, local):
    edges = list(graphs())[k]
    df = spark.createDataFrame([(a, b, 1) for a, b in edges] + [(None, "q", 1)], "src string, dst string, node int")
    assert {r.node: r.component for r in connected_components(df, local_links=local).collect()} == truth(edges)


def test_empty_components(spark):
    assert connected_components(spark.createDataFrame([], "src string, dst string")).count() == 0
    longs = spark.createDataFrame([(3, 2), (2, 9), (7, 8)], "src long, dst long")
    assert {r.node: r.component for r in connected_components(longs).collect()} == {2: 2, 3: 2, 9: 2, 7: 7, 8: 7}


def test_hops(spark):
    rows = [("a", "b", "calls"), ("c", "b", "calls"), ("c", "d", "calls"), ("d", "e", "calls"), ("a", "z", "extends")]
    df = spark.createDataFrame(rows, EDGES)
    seeds = spark.createDataFrame([("a",)], "node string")
    assert {r.node: r.hop for r in k_hop(df, seeds, "calls", 2).collect()} == {"a": 0, "b": 1, "c": 2}
    assert {r.node for r in k_hop(df, seeds, "calls", 0).collect()} == {"a", "b"}
    nodes = spark.createDataFrame([(n,) for n in "abde"], "node_id string")
    assert {tuple(r) for r in subgraph(df, nodes, seeds, "calls", 3).collect()} == {("a", "b", "calls")}
    with pytest.raises(ValueError):
        k_hop(df, seeds, "annotated_with", 1)
