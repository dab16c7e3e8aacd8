"""Function intents, communities, isolated nodes and edge repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gneiss import runtime
from gneiss.operators import text, vectors
from gneiss.operators.graph import connected_components


def role_in_chain(fan_in: Column, fan_out: Column) -> Column:
    return (
        F.when((fan_in == 0) & (fan_out == 0), "isolated").when((fan_in == 0) & (fan_out > 0), "entrypoint").when((fan_out == 0) & (fan_in > 0), "leaf").when(fan_out >= 5, "orchestrator").otherwise("core")
    )


def fused_vectors(intents: DataFrame, dim: int = 32) -> DataFrame:
    """(node_id, semantic, topology, fused): the hash vector of the intent text, the four topology values - degrees and chain depth
    over ten, at most 1, and whether the node is an entry - and both in one list.

    ``intents`` is (node_id, intent_text, fan_in, fan_out, chain_depth).
    """
    from gneiss.operators.retrieval_index import record_vectors

    norm = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.col(c), F.lit(0)) / 10.0))
    topology = F.array(norm("fan_in"), norm("fan_out"), norm("chain_depth"), F.when((F.col("fan_in") == 0) & (F.col("fan_out") > 0), 1.0).otherwise(0.0))
    semantic = record_vectors(intents, "node_id", "intent_text", dim).withColumnRenamed("id", "node_id").withColumnRenamed("vec", "semantic")
    zeros = F.array_repeat(F.lit(0.0), dim)
    joined = intents.select("node_id", topology.alias("topology")).join(semantic, "node_id", "left").withColumn("semantic", F.coalesce("semantic", zeros))
    return joined.select("node_id", "semantic", "topology", F.concat("semantic", "topology").alias("fused"))


def topology_pairs(edges: DataFrame) -> DataFrame:
    """(a, b), a < b: nodes joined by a call in either direction."""
    calls = edges.filter("edge_type = 'calls' and src_node <> dst_node")
    return calls.select(F.least("src_node", "dst_node").alias("a"), F.greatest("src_node", "dst_node").alias("b")).distinct()


def semantic_pairs(intents: DataFrame, top: int = 20) -> DataFrame:
    """(a, b, sim), a < b: one is among the ``top`` most similar of the other, over all of ``intents`` (node, vec)."""
    near = vectors.nearest_vectors(intents, top)
    pairs = near.groupBy(F.least("node", "neighbour").alias("a"), F.greatest("node", "neighbour").alias("b")).agg(F.max("sim").alias("sim"))
    return runtime.materialise(pairs, "neighbours")


def candidate_graph(pairs: DataFrame, topology: DataFrame, intents: DataFrame, paths: DataFrame, alpha: float = 0.5, beta: float = 0.4, gamma: float = 0.1, least: float = 0.05) -> DataFrame:
    """(a, b, weight): topology, similarity and common path of candidate pairs, kept above ``least``.

    ``intents`` is (node, vec), ``paths`` is (node, path), ``pairs`` the semantic neighbours (a, b, sim); topology pairs
    join them, and only those that are no neighbours fetch their vectors.
    """
    more = topology.select("a", "b").join(pairs.select("a", "b"), ["a", "b"], "left_anti")
    more = more.join(intents.select(F.col("node").alias("a"), F.col("vec").alias("va")), "a").join(intents.select(F.col("node").alias("b"), F.col("vec").alias("vb")), "b")
    every = pairs.select("a", "b", "sim").unionByName(more.select("a", "b", F.round(vectors.dot("va", "vb"), 9).alias("sim")))
    called = topology.select("a", "b", F.lit(1.0).alias("t"))
    scored = every.join(paths.select(F.col("node").alias("a"), F.col("path").alias("pa")), "a").join(paths.select(F.col("node").alias("b"), F.col("path").alias("pb")), "b").join(called, ["a", "b"], "left")
    weight = alpha * F.coalesce("t", F.lit(0.0)) + beta * F.greatest(F.lit(0.0), F.col("sim")) + gamma * text.path_prior("pa", "pb")
    return scored.select("a", "b", F.round(weight, 6).alias("weight")).filter(F.col("weight") > least)


def communities(graph: DataFrame, nodes: DataFrame, least: float = 0.35) -> DataFrame:
    """(node, community): components over links of at least ``least``; nodes without one stand alone.  A community is named by its least node."""
    found = connected_components(graph.filter(F.col("weight") >= least), "a", "b")
    return nodes.select("node").distinct().join(found, "node", "left").select("node", F.coalesce("component", "node").alias("community"))


#: Rounds of local moving at most.
MOVE_ROUNDS = 30


def modular_communities(graph: DataFrame, nodes: DataFrame, resolution: float = 1.0, rounds: int = MOVE_ROUNDS) -> DataFrame:
    """(node, community): communities by modularity with a resolution, by local moving.

    Every node starts alone; in each round a half of the nodes, chosen by a hash that changes with the round, moves to the
    community among its neighbours' that gains most over its own: weight of the links to it - resolution * own strength * strength
    of it / total strength; of equal gains to the least.  It ends when neither half moves.  Joins on hubs and on large
    communities are salted; a community is named by its least node.
    """
    both = graph.filter("a <> b").select("a", "b", "weight").unionByName(graph.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    links = runtime.materialise(both.groupBy("a", "b").agg(F.sum("weight").alias("w")), "links")
    own = links.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("k"))
    total = links.agg(F.sum("w")).first()[0] or 1.0
    labels = runtime.materialise(nodes.select("node").distinct().join(own, "node", "left").select("node", F.coalesce("k", F.lit(0.0)).alias("k"), F.col("node").alias("label")), "labels")
    hubs = runtime.heavy_keys(links, ["b"])
    still = 0
    for round_no in range(rounds):
        strength = labels.groupBy("label").agg(F.sum("k").alias("s"))
        near = runtime.join_heavy(links, labels.select(F.col("node").alias("b"), "label"), ["b"], ["a"], hubs).groupBy(F.col("a").alias("node"), "label").agg(F.sum("w").alias("w"))
        # A node may stay where it is, with or without links into it.
        stay = labels.select("node", "label", F.lit(0.0).alias("w"))
        options = near.unionByName(stay).groupBy("node", "label").agg(F.sum("w").alias("w"))
        options = runtime.join_salted(options, strength, ["label"], ["node"]).join(labels.select("node", "k", F.col("label").alias("now")), "node")
        gain = F.col("w") - resolution * F.col("k") * (F.col("s") - F.when(F.col("label") == F.col("now"), F.col("k")).otherwise(0.0)) / total
        best = options.groupBy("node").agg(F.min(F.struct((-F.round(gain, 9)).alias("g"), "label")).alias("m"), F.max(F.when(F.col("label") == F.col("now"), F.round(gain, 9))).alias("now_gain"))
        turn = F.pmod(F.xxhash64("node", F.lit(round_no // 2)), F.lit(2)) == round_no % 2
        moves = best.filter(turn & (-F.col("m.g") > F.col("now_gain"))).select("node", F.col("m.label").alias("to"))
        labels = runtime.materialise(labels.join(moves, "node", "left").select("node", "k", F.coalesce("to", "label").alias("label"), F.col("to").isNotNull().alias("moved")), "labels")
        still = 0 if labels.filter("moved").limit(1).count() else still + 1
        labels = labels.drop("moved")
        if still == 2:
            break
    least = labels.groupBy("label").agg(F.min("node").alias("community"))
    return runtime.join_salted(labels, least, ["label"], ["node"]).select("node", "community")


def modularity(graph: DataFrame, members: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(modularity): share of the weight inside communities less the resolution times what chance would put there."""
    both = graph.filter("a <> b").select("a", "b", "weight").unionByName(graph.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    x, y = members.select(F.col("node").alias("a"), F.col("community").alias("ca")), members.select(F.col("node").alias("b"), F.col("community").alias("cb"))
    met = both.join(x, "a").join(y, "b")
    total = met.agg(F.sum("weight").alias("t"))
    inside = met.groupBy("ca").agg(F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0.0)).alias("i"), F.sum("weight").alias("s"))
    return inside.crossJoin(F.broadcast(total)).agg(F.round(F.sum(F.col("i") / F.col("t") - resolution * F.pow(F.col("s") / F.col("t"), 2)), 6).alias("modularity"))


def cohesion(members: DataFrame, graph: DataFrame) -> DataFrame:
    """(community, size, cohesion): mean weight of the candidate links inside, 0 without any."""
    a, b = members.select(F.col("node").alias("a"), F.col("community").alias("ca")), members.select(F.col("node").alias("b"), F.col("community").alias("cb"))
    inside = graph.join(a, "a").join(b, "b").filter("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.avg("weight").alias("w"))
    size = members.groupBy("community").agg(F.count("*").alias("size"))
    return size.join(inside, "community", "left").select("community", "size", F.round(F.coalesce("w", F.lit(0.0)), 6).alias("cohesion"))


def dominant(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(community, role): the commonest label of the members, the lesser of equal ones."""
    counted = members.join(labels, "node").groupBy("community", "role").agg(F.count("*").alias("c"))
    best = counted.groupBy("community").agg(F.min(F.struct((-F.col("c")).alias("m"), "role")).alias("x"))
    return best.select("community", F.col("x.role").alias("role"))


def stability(before: DataFrame, after: DataFrame, window: int = 50) -> float | DataFrame:
    """(pairs, stability): share of node pairs, at most ``window`` apart in id order, that both runs treat alike."""
    both = before.select("node", F.col("community").alias("x")).join(after.select("node", F.col("community").alias("y")), "node")
    # A numbering over all nodes: counts per range partition, then rows within it.
    ordered = both.repartitionByRange("node").sortWithinPartitions("node").withColumn("part", F.spark_partition_id())
    inner = ordered.withColumn("rn", F.row_number().over(Window.partitionBy("part").orderBy("node")))
    shift = inner.groupBy("part").agg(F.count("*").alias("c")).withColumn("before", F.sum("c").over(Window.orderBy("part")) - F.col("c"))
    numbered = inner.join(F.broadcast(shift.select("part", "before")), "part").select((F.col("rn") + F.col("before")).alias("i"), "x", "y")
    other = numbered.select(F.explode(F.sequence(F.col("i") - window, F.col("i") - 1)).alias("i"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    alike = ((F.col("x") == F.col("x2")) == (F.col("y") == F.col("y2"))).cast("double")
    return numbered.join(other, "i").agg(F.count("*").alias("pairs"), F.round(F.avg(alike), 6).alias("stability"))


def sweep(graph: DataFrame, nodes: DataFrame, resolutions: list[float], previous: DataFrame | None = None) -> tuple[DataFrame, dict[float, DataFrame]]:
    """One run record per resolution, and the memberships (node, community) of each.

    A record is (resolution, n_communities, n_singletons, avg_cohesion, stability, objective, selected); the objective is 0.55 *
    mean cohesion + 0.30 * stability against ``previous`` (0 without one) - 0.15 * share of singletons.  The best is
    selected, the first of equal ones in the order given.
    """
    records, members = None, {}
    for i, x in enumerate(resolutions):
        members[x] = runtime.materialise(communities(graph, nodes, x), "members")
        stats = cohesion(members[x], graph).agg(F.count("*").alias("n_communities"), F.sum((F.col("size") == 1).cast("long")).alias("n_singletons"), F.avg("cohesion").alias("avg_cohesion"))
        alike = stability(previous, members[x]).select("stability") if previous is not None else graph.sparkSession.createDataFrame([(0.0,)], "stability double")
        row = stats.crossJoin(F.broadcast(alike)).select(F.lit(i).alias("i"), F.lit(float(x)).alias("resolution"), "n_communities", F.coalesce("n_singletons", F.lit(0)).alias("n_singletons"), F.coalesce("avg_cohesion", F.lit(0.0)).alias("avg_cohesion"), F.coalesce("stability", F.lit(0.0)).alias("stability"))
        records = row if records is None else records.unionByName(row)
    value = F.round(0.55 * F.col("avg_cohesion") + 0.30 * F.col("stability") - 0.15 * F.col("n_singletons") / F.greatest(F.lit(1), F.col("n_communities")), 5)
    # One row per resolution given, so the window over all of them is small.
    first = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("objective"), "i"))
    scored = records.withColumn("objective", value).withColumn("selected", first == 1)
    return scored.select("resolution", "n_communities", "n_singletons", F.round("avg_cohesion", 6).alias("avg_cohesion"), "stability", "objective", "selected"), members


def record_run(history: DataFrame | None, run_id: str, members: DataFrame, objective: float, selected: bool, created_at: object) -> DataFrame:
    """(run_id, node, community, objective, selected, created_at): the history with the memberships of the run put in
    the place of those it had under the same id."""
    rows = members.select(F.lit(run_id).alias("run_id"), "node", "community", F.lit(float(objective)).alias("objective"), F.lit(selected).alias("selected"), F.lit(created_at).cast("timestamp").alias("created_at"))
    return rows if history is None else history.filter(F.col("run_id") != run_id).unionByName(rows)


def latest_selected(history: DataFrame) -> DataFrame:
    """(node, community) of the selected run that was recorded last; the greater id of runs of one time."""
    last = history.filter("selected").agg(F.max(F.struct("created_at", "run_id")).alias("last")).select(F.col("last.run_id").alias("run_id"))
    return history.join(F.broadcast(last), "run_id", "left_semi").select("node", "community")


def community_summary(members: DataFrame, graph: DataFrame, intents: DataFrame) -> DataFrame:
    """(community, size, cohesion, role, summary, tags): what the community store keeps of each community.

    ``intents`` is (node, role, tags): ``tags`` are the distinct tags of the members, in order.
    """
    role = dominant(members, intents.select("node", "role"))
    tags = members.join(intents, "node", "left").select("community", F.explode_outer("tags").alias("t")).groupBy("community").agg(F.sort_array(F.collect_set("t")).alias("tags"))
    joined = cohesion(members, graph).join(role, "community", "left").join(tags, "community", "left")
    summary = F.concat(F.lit("Community of "), F.col("size").cast("string"), F.lit(" functions, mostly "), F.coalesce("role", F.lit("unknown")))
    return joined.select("community", "size", "cohesion", "role", summary.alias("summary"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))


def isolated_types(nodes: DataFrame, similarity: DataFrame) -> DataFrame:
    """(node_id, isolated_type, confidence) of nodes without edges.

    ``similarity`` is (node_id, sim), the mean of the five largest similarities; 0 where it is missing.  Fixed values: the
    types, their scores and limits.
    """
    sim = F.coalesce("sim", F.lit(0.0))
    alone = nodes.filter("fan_in + fan_out = 0").join(similarity, "node_id", "left").withColumn("sim", sim)
    scores = {
        "BoundaryExternal": F.when(F.col("path").contains("third_party/"), 0.7).otherwise(0.0),
        "Entrypoint": F.when((F.col("fan_in") == 0) & (F.col("fan_out") >= 3), 1.0).otherwise(0.0),
        "TrueLeaf": F.when((F.col("fan_out") == 0) & (F.col("fan_in") >= 1), 1.0).otherwise(0.0) + F.when(F.col("sim") >= 0.5, 0.2).otherwise(0.0),
        "MissingEdge": F.when(F.col("sim") >= 0.65, 1.0).otherwise(0.0),
        "NoiseNode": F.when(F.col("sim") < 0.35, 1.0).otherwise(0.0),
    }
    # Best first; equal scores in the order of the list above.
    ranked = F.array_sort(F.array(*(F.struct((-s).alias("m"), F.lit(i).alias("i"), F.lit(n).alias("t")) for i, (n, s) in enumerate(scores.items()))))
    scored = alone.withColumn("r", ranked).withColumn("best", -F.col("r")[0]["m"]).withColumn("second", -F.col("r")[1]["m"])
    unsure = (F.col("best") < 0.5) | (F.round(F.col("best") - F.col("second"), 9) < 0.1)
    return scored.select("node_id", F.when(unsure, "Uncertain").otherwise(F.col("r")[0]["t"]).alias("isolated_type"), F.least(F.lit(1.0), F.when(unsure, F.greatest("best", F.lit(0.45))).otherwise(F.col("best"))).alias("confidence"))


def repair_edges(lost: DataFrame, others: DataFrame, existing: DataFrame, top: int = 6, least: float = 0.58, most_edges: int = 3) -> DataFrame:
    """(src_node, dst_node, confidence, source): call edges proposed for isolated nodes, in both directions.

    ``lost`` and ``others`` are (node, vec, path).  The candidates of a node are the ``top`` best others by 0.85 * cosine (0 at
    least) + 0.15 * common path, at or above ``least``; each takes two edges, the reverse one with 0.9 of the confidence,
    until ``most_edges`` are reached.  Edges that ``existing`` (src_node, dst_node) has are left out; a forward edge goes
    before a reverse one between the same nodes, and the more confident before the less.
    """
    near = vectors.nearest_vectors(others, min(top, -(-most_edges // 2)), lost, 0.85, 0.15, True, 6).filter(F.col("sim") >= least)
    confidence = F.least(F.lit(0.69), 0.25 + 0.4 * F.col("sim"))
    forward = near.select(F.col("node").alias("src_node"), F.col("neighbour").alias("dst_node"), F.round(confidence, 6).alias("confidence"), F.lit(0).alias("order"))
    back = near.select(F.col("neighbour").alias("src_node"), F.col("node").alias("dst_node"), F.round(0.9 * confidence, 6).alias("confidence"), F.lit(1).alias("order"))
    best = forward.unionByName(back).groupBy("src_node", "dst_node").agg(F.min(F.struct("order", (-F.col("confidence")).alias("m"))).alias("x"))
    new = best.join(existing.select("src_node", "dst_node").distinct(), ["src_node", "dst_node"], "left_anti")
    return new.select("src_node", "dst_node", (-F.col("x.m")).alias("confidence"), F.when(F.col("x.order") == 0, "repair_missing_edge").otherwise("repair_missing_edge_reverse").alias("source"))


#: Community of everything that lies outside.
EXTERNAL = "intent:community:ExternalBoundary"
#: Least scores for an assignment, by isolated type; other types take the first.
ASSIGN_LEAST = {"": 0.55, "Uncertain": 0.65, "Entrypoint": 0.60}


def assign_isolated(isolated: DataFrame, members: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, community, score, mode): the community of every isolated node that gets one.

    ``isolated`` is (node, vec, path, isolated_type), ``members`` (node, community, vec, path).  A boundary node goes to the
    virtual community ``EXTERNAL``; a true leaf or noise gets none; any other goes to the community with the best 0.6 * mean
    cosine + 0.3 * share of its calls + 0.1 * best common path (the lesser id of equals), at or above its least score.

    The mean cosine to a community is the product with its mean vector, so a node meets one row per community and distinct
    path, in blocks; communities it has calls to, the only ones where the second term counts, are scored apart.
    """
    place = members.select("community", F.posexplode("vec").alias("i", "x")).groupBy("community", "i").agg(F.avg("x").alias("x"))
    centre = place.groupBy("community").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("centre"))
    centre = runtime.materialise(centre, "centres")
    paths = runtime.materialise(members.select("community", "path").distinct(), "paths")
    open_ = runtime.materialise(isolated.filter(~F.col("isolated_type").isin("BoundaryExternal", "TrueLeaf", "NoiseNode")), "open")
    split = "\u0001"
    rows = paths.join(centre, "community").select(F.concat("community", F.lit(split), F.coalesce("path", F.lit(""))).alias("node"), F.col("centre").alias("vec"), "path")
    apart = vectors.nearest_vectors(rows, 1, open_.select("node", "vec", "path"), 0.6, 0.1, False, 6)
    apart = apart.select("node", F.substring_index("neighbour", split, 1).alias("community"), F.col("sim").alias("score"))
    calls = edges.filter("edge_type = 'calls'")
    ends = calls.select(F.col("src_node").alias("node"), F.col("dst_node").alias("m")).unionByName(calls.select(F.col("dst_node").alias("node"), F.col("src_node").alias("m")))
    own = runtime.materialise(ends.join(open_.select("node"), "node", "left_semi"), "ends")
    degree = own.groupBy("node").agg(F.count("*").alias("degree"))
    links = own.join(members.select(F.col("node").alias("m"), "community"), "m").groupBy("node", "community").agg(F.count("*").alias("links"))
    met = links.join(degree, "node").join(open_.select("node", "vec", F.col("path").alias("p")), "node").join(centre, "community")
    prior = met.select("node", "community", "p").join(paths, "community").groupBy("node", "community").agg(F.max(text.path_prior("p", "path")).alias("prior"))
    score = 0.6 * vectors.dot("vec", "centre") + 0.3 * F.col("links") / F.greatest(F.lit(1), F.col("degree")) + 0.1 * F.coalesce("prior", F.lit(0.0))
    linked = met.join(prior, ["node", "community"], "left").select("node", "community", F.round(score, 6).alias("score"))
    best = apart.unionByName(linked).groupBy("node").agg(F.min(F.struct((-F.col("score")).alias("m"), "community")).alias("b"))
    least = F.lit(ASSIGN_LEAST[""])
    for kind, x in ASSIGN_LEAST.items():
        least = F.when(F.col("isolated_type") == kind, x).otherwise(least) if kind else least
    forced = best.join(open_.select("node", "isolated_type"), "node").withColumn("score", -F.col("b.m")).filter(F.col("score") >= least)
    outside = isolated.filter("isolated_type = 'BoundaryExternal'").select("node", F.lit(EXTERNAL).alias("community"), F.lit(1.0).alias("score"), F.lit("external_boundary").alias("mode"))
    return forced.select("node", F.col("b.community").alias("community"), "score", F.lit("forced").alias("mode")).unionByName(outside)
