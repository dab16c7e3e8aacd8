from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gneiss.operators.tree_aggregate import distinct_degrees, incoming_edges, tree_aggregate, wrong_fan_in

EDGES = "edge_id string, src_node string, dst_node string, n long, k1 string"
NODES = "node_id string, fan_in int, edge_id string"


def truth(edges):
    out = defaultdict(set)
    for e, _, d, *_ in edges:
        if d is not None and e is not None:
            out[d].add(e)
    return {k: len(v) for k, v in out.items()}


def test_skewed_counts_match(spark):
    edges = [(f"e{i % 3000}", "s", "hot" if i % 3000 < 2000 else f"d{i % 7}", i, "x") for i in range(4000)] + [(None, "s", "hot", 1, "x"), ("e", "s", None, 1, "x"), ("e1", "s", "other", 1, "x")]
    df = spark.createDataFrame(edges, EDGES)
    got = {r.node_id: r.n_edges for r in incoming_edges(spark.createDataFrame([], NODES), df).collect()}
    assert got == truth(edges)
    for rows in (40, 700, 1 << 20):
        assert sorted(r.n for r in distinct_degrees(df, chunk_rows=rows, fan_in=2).collect()) == sorted(truth(edges).values())


def test_wrong_fan_in(spark):
    edges = spark.createDataFrame([("e1", "a", "b", 1, ""), ("e1", "a", "b", 1, ""), ("e2", "a", "b", 1, "")], EDGES)
    nodes = spark.createDataFrame([("b", 2, "z"), ("b", 2, "z"), ("c", 1, "z"), ("d", 0, "z"), ("e", None, "z"), (None, 4, "z"), ("f", 3, "z"), ("f", 3, "z")], NODES)
    assert sorted(r.node_id for r in wrong_fan_in(nodes, edges).collect()) == ["c", "f"]


def test_empty(spark):
    e, n = spark.createDataFrame([], EDGES), spark.createDataFrame([], NODES)
    assert wrong_fan_in(n, e).count() == 0 and incoming_edges(n, e).count() == 0
    assert [r.node_id for r in wrong_fan_in(spark.createDataFrame([("x", 1, "")], NODES), e).collect()] == ["x"]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(-9, 9)), min_size=1, max_size=60), st.integers(1, 40), st.integers(2, 5))
def test_tree_equals_group_by(spark, rows, chunks, fan_in):
    df = spark.createDataFrame(rows, "k int, v int")
    tree = tree_aggregate(df, ["k"], ["v"], {"s": F.sum("v"), "m": F.max("v"), "c": F.count("*")}, {"s": F.sum, "m": F.max, "c": F.sum}, chunks, fan_in)
    plain = df.groupBy("k").agg(F.sum("v").alias("s"), F.max("v").alias("m"), F.count("*").alias("c"))
    assert sorted(map(tuple, tree.select("k", "s", "m", "c").collect())) == sorted(map(tuple, plain.collect()))
