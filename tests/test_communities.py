import random

import numpy as np
import pytest

import __spark_entry__ as entry
from gneiss.operators import communities as com
from gneiss.operators import vectors

SMALL = "/root/testdata/sf0.001"


def nearest(rows, k):
    """Per node its k most similar others by inner product, equal ones by id, by brute force."""
    unit = {n: np.array(v) for n, v in rows}
    out = {}
    for n, v in unit.items():
        ranked = sorted((-round(float(v @ w), 9), m) for m, w in unit.items() if m != n)
        out[n] = [(m, -s) for s, m in ranked[:k]]
    return out


@pytest.mark.parametrize(("n", "block"), [(1, 16), (150, 16), (150, 2048)])
def test_nearest_vectors_equal_brute_force(spark, monkeypatch, n, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 3 * block)
    rng = random.Random(n)
    shared = [rng.gauss(0, 1) for _ in range(8)]
    # A third of all nodes have one and the same vector, so ranks hang on the ids.
    rows = [(f"n{i:03}", shared if i % 3 == 0 else [rng.gauss(0, 1) for _ in range(8)]) for i in range(n)]
    rng.shuffle(rows)
    got = {}
    for r in vectors.nearest_vectors(spark.createDataFrame(rows, "node string, vec array<double>"), 7).orderBy("node", "rank").collect():
        got.setdefault(r.node, []).append((r.neighbour, r.sim))
        assert r.rank == len(got[r.node])
    want = {k: v for k, v in nearest(rows, 7).items() if v}
    assert {k: [m for m, _ in v] for k, v in got.items()} == {k: [m for m, _ in v] for k, v in want.items()}
    assert all(abs(a - b) < 1e-8 for k in want for (_, a), (_, b) in zip(got[k], want[k], strict=True))


def test_semantic_pairs_cross_folders(spark):
    rows = [("a", [1.0, 0.0]), ("b", [1.0, 0.1]), ("c", [0.0, 1.0])]
    f = spark.createDataFrame(rows, "node string, vec array<double>")
    pairs = {(r.a, r.b) for r in com.semantic_pairs(f, 1).collect()}
    assert pairs == {("a", "b"), ("b", "c")}


def test_candidate_graph_of_tables_has_all_neighbours(spark):
    from gneiss.plans import graph_queries as q

    f = [(r.node, r.vec) for r in q._functions(spark, SMALL).collect()]
    want = {(min(n, m), max(n, m)) for n, v in nearest(f, 20).items() for m, _ in v} | {(r.a, r.b) for r in q._topology(spark, SMALL).collect()}
    got = {(r.a, r.b): r.weight for r in entry.queries()["g_candidate_graph"](spark, SMALL).collect()}
    assert set(got) <= want
    dots = {(a, b): float(np.dot(dict(f)[a], dict(f)[b])) for a, b in want}
    assert all(p in got for p in want if 0.4 * dots[p] > 0.0501)


def test_modular_communities_find_planted_groups(spark):
    rng = random.Random(3)
    nodes = [(f"n{i:02}",) for i in range(60)]
    links = [(a, b, 1.0) for i, (a,) in enumerate(nodes) for j, (b,) in enumerate(nodes) if i < j and rng.random() < (0.5 if i // 20 == j // 20 else 0.02)]
    g, n = spark.createDataFrame(links, "a string, b string, weight double"), spark.createDataFrame([*nodes, ("alone",)], "node string")
    found = com.modular_communities(g, n)
    got = {r.node: r.community for r in found.collect()}
    assert len(got) == 61 and got["alone"] == "alone"
    groups = [[got[f"n{i:02}"] for i in range(k, k + 20)] for k in (0, 20, 40)]
    assert all(max(map(x.count, x)) >= 17 for x in groups)
    planted = spark.createDataFrame([(f"n{i:02}", str(i // 20)) for i in range(60)], "node string, community string")
    q, best = (com.modularity(g, m).first()[0] for m in (found, planted))
    strength = {}
    for a, b, _ in links:
        strength[a], strength[b] = strength.get(a, 0) + 1, strength.get(b, 0) + 1
    total = 2 * len(links)
    plain = sum((2 if int(a[1:]) // 20 == int(b[1:]) // 20 else 0) for a, b, _ in links) / total - sum((sum(v for x, v in strength.items() if int(x[1:]) // 20 == k) / total) ** 2 for k in range(3))
    assert abs(best - plain) < 1e-6 and q >= 0.9 * best
    assert com.modular_communities(g.limit(0), n.limit(0)).count() == 0
