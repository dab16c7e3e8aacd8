"""Exploration of the code graph from seeds found by module, function and semantic search.

A channel of seeds is (node_id, score); modules are communities (community, intent, tags, backbone, cohesion); members are
(community, node_id, assign_score, cohesion).  Defined results: null ids are left out, equal scores go by id, empty tables
give no seeds, and then the reason says so.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gneiss import runtime
from gneiss.operators import graph, text

# Weights of the channels in a linear fusion, in the order of the channels.
SEED_WEIGHTS = {"module": 0.45, "function": 0.30, "semantic": 0.25}


def search_modules(modules: DataFrame, query: str, top_k: int) -> DataFrame:
    """(community, score, cohesion): communities whose intent matches the query, with half a point for every term in a tag and
    0.35 of the score of the backbone text; best first, then by cohesion and id."""
    score = text.intent_score("intent", query) + 0.35 * text.intent_score("backbone", query)
    tags = F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.lower(t))
    for term in (t for t in re.split(r"[^A-Za-z0-9_]+", query.lower()) if t):
        score = score + 0.5 * holds(tags, term).cast("double")
    hits = modules.filter("community is not null").select("community", score.alias("score"), "cohesion").filter("score > 0")
    return hits.orderBy(F.desc("score"), F.desc("cohesion"), "community").limit(top_k)


def holds(tags, term: str):
    return F.exists(tags, lambda t: t.contains(term))


def community_seeds(members: DataFrame, degrees: DataFrame, k: int) -> DataFrame:
    """(community, node_id, assign_score, r): the ``k`` first members by assignment, cohesion, degree and id."""
    joined = members.join(degrees.select("node_id", (F.col("fan_in") + F.col("fan_out")).alias("degree")), "node_id")
    order = Window.partitionBy("community").orderBy(F.desc("assign_score"), F.desc("cohesion"), F.desc("degree"), "node_id")
    return joined.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).select("community", "node_id", "assign_score", "r")


def module_seeds(hits: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node_id, score): members of the modules found, each scored by its module and a fifth of its assignment."""
    met = hits.join(seeds, "community").select("node_id", (F.col("score") + 0.2 * F.coalesce("assign_score", F.lit(0.0))).alias("score"))
    return met.groupBy("node_id").agg(F.max("score").alias("score"))


def semantic_seeds(hits: DataFrame, chunks: DataFrame, nodes: DataFrame, top_k: int) -> DataFrame:
    """(node_id, score): nodes of the symbols that the chunks found are about, with their best score; a symbol without a node
    stands for itself.  ``hits`` is (chunk_id, score), ``chunks`` (chunk_id, primary_symbols)."""
    symbols = hits.join(chunks, "chunk_id").select(F.explode("primary_symbols").alias("symbol_id"), "score")
    met = symbols.join(nodes.select("symbol_id", F.col("node_id").alias("known")), "symbol_id", "left")
    best = met.groupBy(F.coalesce("known", "symbol_id").alias("node_id")).agg(F.max("score").alias("score"))
    return best.orderBy(F.desc("score"), "node_id").limit(top_k)


def fuse_seeds(channels: dict[str, DataFrame], how: str = "rrf", k: int = 60) -> DataFrame:
    """(node_id, score, sources): reciprocal ranks or weighted scores of the channels, summed per node."""
    if how not in ("rrf", "linear"):
        raise ValueError("seeds are fused by 'rrf' or 'linear'")

    def part(name: str, rows: DataFrame) -> DataFrame:
        if how == "linear":
            return rows.select("node_id", (F.col("score") * SEED_WEIGHTS.get(name, 0.0)).alias("s"), F.lit(name).alias("source"))
        # Channels are top-k lists, so ranking them is a small sort.
        return rows.select("node_id", (1.0 / (k + F.row_number().over(Window.orderBy(F.desc("score"), "node_id")))).alias("s"), F.lit(name).alias("source"))

    stacked = reduce(DataFrame.unionByName, (part(n, c) for n, c in channels.items()))
    return stacked.groupBy("node_id").agg(F.sum("s").alias("score"), F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"))


def select_seeds(fused: DataFrame, least: float, limit: int) -> DataFrame:
    return fused.filter(F.col("score") >= least).orderBy(F.desc(F.round("score", 9)), "node_id").limit(max(1, limit))


def explore(edges: DataFrame, seeds: DataFrame, module_hits: bool, edge_type: str = "calls", hops: int | None = None) -> tuple[DataFrame, str]:
    """((node, hop), reason): the nodes around the seeds, two hops where a module was found and one otherwise; the reason is
    '' or why nothing came out."""
    seeds = runtime.materialise(seeds.select("node_id"), "seeds")
    reached = graph.k_hop(edges, seeds, edge_type, hops if hops is not None else 2 if module_hits else 1)
    return reached, "" if seeds.limit(1).count() else "no_seed_hits_after_fusion"


def explore_symbol(edges: DataFrame, nodes: DataFrame, symbol_id: str, edge_type: str = "calls") -> DataFrame:
    """(node, hop): two hops around the node of a symbol; a symbol without a node stands for itself."""
    known = nodes.filter(F.col("symbol_id") == symbol_id).select("node_id").limit(1)
    own = edges.sparkSession.createDataFrame([(symbol_id,)], "symbol_id string")
    seed = own.crossJoin(F.broadcast(known.agg(F.min("node_id").alias("node_id")))).select(F.coalesce("node_id", "symbol_id").alias("node_id"))
    return graph.k_hop(edges, seed, edge_type, 2)


def intent_subgraph(members: DataFrame, modules: DataFrame, communities: list[str]) -> DataFrame:
    """(node_id, community, intent, cohesion, assign_score): members of the communities with what is known of these; such a
    subgraph has no edges."""
    kept = members.filter(F.col("community").isin(communities))
    return kept.join(modules.select("community", "intent"), "community", "left").select("node_id", "community", "intent", "cohesion", "assign_score")
