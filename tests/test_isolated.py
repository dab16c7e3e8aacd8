from gneiss.operators import communities as com
from gneiss.plans import canonical, graph_queries

VEC = "[" + ", ".join(["1.0"] + ["0.0"] * 31) + "]"
OFF = "[" + ", ".join(["0.0", "1.0"] + ["0.0"] * 30) + "]"


def test_isolated_is_without_any_edge(spark, monkeypatch):
    nodes = spark.createDataFrame([(n, f"src/{n}.java") for n in ("bare", "caller", "called", "lone", "odd")], "node_id string, path string")
    edges = spark.createDataFrame([("caller", "called", "calls", 1.0)], "src_node string, dst_node string, edge_type string, confidence double")
    # 'bare' has no intent, the call gives 'caller' and 'called' a degree, 'odd' resembles nothing.
    intents = spark.createDataFrame([("caller", VEC), ("called", VEC), ("lone", VEC), ("odd", OFF)], "node_id string, semantic_vec_json string")
    for name, table in (("nodes", nodes), ("edges", edges), ("intents", intents)):
        monkeypatch.setattr(canonical, name, lambda s, d, t=table: t)
    # Means over the three others: lone (1 + 1 + 0) / 3, odd 0.
    got = {r.node_id: r.isolated_type for r in graph_queries.g_isolated(spark, "").collect()}
    assert got == {"bare": "NoiseNode", "lone": "MissingEdge", "odd": "NoiseNode"}
    # lone meets both others alike (0.85 and half of the path): two edges each, the reverse ones with 0.9 of the confidence.
    found = {(r.src_node, r.dst_node): (r.confidence, r.source) for r in graph_queries.g_repair(spark, "").collect()}
    assert found == {("lone", "called"): (0.605, "repair_missing_edge"), ("lone", "caller"): (0.605, "repair_missing_edge")} | {(x, "lone"): (0.5445, "repair_missing_edge_reverse") for x in ("called", "caller")}


def test_assignments(spark):
    e = [1.0, 0.0]
    isolated = [("ext", e, "third_party/x", "BoundaryExternal"), ("leaf", e, "a/b", "TrueLeaf"), ("noise", e, "a/b", "NoiseNode"), ("unsure", e, "a/b/c/d", "Uncertain"), ("near", e, "q", "MissingEdge"), ("far", [0.0, 1.0], "q", "MissingEdge"), ("linked", [0.5, 0.5], "q", "MissingEdge")]
    members = [("m1", "A", e, "a/b/c/d"), ("m2", "A", e, "z"), ("m3", "B", [0.8, 0.0], "q"), ("m4", "B", [0.8, 0.2], "q/r")]
    edges = [("linked", "m3", "calls"), ("m4", "linked", "calls"), ("linked", "m1", "field_refs")]
    got = {r.node: (r.community, r.score, r.mode) for r in com.assign_isolated(
        spark.createDataFrame(isolated, "node string, vec array<double>, path string, isolated_type string"),
        spark.createDataFrame(members, "node string, community string, vec array<double>, path string"),
        spark.createDataFrame(edges, "src_node string, dst_node string, edge_type string"),
    ).collect()}
    # near: 0.6 with A, 0.48 + 0.025 with B; linked: 0.6 * (0.4 + 0.05) + 0.3 + 0.025 with B.
    assert got == {"ext": (com.EXTERNAL, 1.0, "external_boundary"), "unsure": ("A", 0.7, "forced"), "near": ("A", 0.6, "forced"), "linked": ("B", 0.595, "forced")}


def test_runs(spark):
    graph = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.4), ("d", "e", 0.9)], "a string, b string, weight double")
    nodes = spark.createDataFrame([(x,) for x in "abcdef"], "node string")
    records, members = com.sweep(graph, nodes, [0.35, 0.45])
    got = [tuple(r) for r in records.orderBy("resolution").collect()]
    assert got == [(0.35, 3, 1, 0.516667, 0.0, 0.23417, True), (0.45, 4, 2, 0.45, 0.0, 0.1725, False)]
    history = com.record_run(None, "r1", members[0.35], 0.2, True, "2024-01-01 00:00:00")
    history = com.record_run(history, "r2", members[0.45], 0.3, True, "2024-01-02 00:00:00")
    history = com.record_run(history, "r3", members[0.35], 0.9, False, "2024-01-03 00:00:00")
    assert {(r.node, r.community) for r in com.latest_selected(history).collect()} == {("a", "a"), ("b", "a"), ("c", "c"), ("d", "d"), ("e", "d"), ("f", "f")}
    assert com.record_run(history, "r2", members[0.35], 0.3, True, "2024-01-02 00:00:00").count() == history.count()
