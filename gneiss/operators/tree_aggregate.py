"""Per-key results when a few keys hold most records: multi-level tree aggregation (problem 6).

Rows go to chunks by a hash of the row itself, never by key, so all chunks have about ``CHUNK_ROWS`` rows whatever
the keys and however large the input.  Each chunk combines its rows locally into one state per key; the states of a key
then merge in rounds, ``fan_in`` chunks at a time, until one is left.  No task receives more than ``fan_in`` states of
a key per round, instead of one reducer receiving all partial states; a key that few rows name has few states and
merges with the rest.  All of it is built-in aggregation, which spills, so a task needs no more memory than Spark grants.

Defined results: a null key is a group of its own unless filtered out by the caller; extra columns are ignored; empty
tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss import runtime

#: States of a key merged per round.
FAN_IN = 8
#: Rows of the input per chunk.
CHUNK_ROWS = 1 << 20


def chunk_count(rows: DataFrame, chunk_rows: int = CHUNK_ROWS) -> int:
    """Chunks of ``chunk_rows`` rows that the input fills."""
    return max(1, math.ceil(rows.count() / chunk_rows))


def tree_aggregate(rows: DataFrame, keys: list[str], chunk_by: list[str], first: dict[str, Column], merge: dict[str, Callable[[str], Column]], chunks: int, fan_in: int = FAN_IN) -> DataFrame:
    """(keys..., states...): aggregates ``rows`` by ``keys`` through chunks of ``chunk_by`` hashes.

    ``first`` has the local aggregate of each state column, ``merge`` how states of one column are merged.
    """
    level = rows.withColumn("_chunk", F.pmod(F.xxhash64(*chunk_by), F.lit(chunks)).cast("int")).groupBy(*keys, "_chunk").agg(*(c.alias(n) for n, c in first.items()))
    while chunks > 1:
        chunks = math.ceil(chunks / fan_in)
        level = level.withColumn("_chunk", F.floor(F.col("_chunk") / fan_in).cast("int")).groupBy(*keys, "_chunk").agg(*(m(n).alias(n) for n, m in merge.items()))
    return level.drop("_chunk")


def distinct_degrees(edges: DataFrame, node_col: str = "dst_node", edge_col: str = "edge_id", chunk_rows: int = CHUNK_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """(k1, k2, n): distinct edges per node.

    Nodes and edges travel as 128-bit hashes.  Copies of an edge are combined before the shuffle and meet in their
    chunk, which is chosen by a hash of the edge; every chunk counts the edges per node, and the counts merge in the tree.
    """
    valid = edges.filter(F.col(node_col).isNotNull() & F.col(edge_col).isNotNull())
    chunks = chunk_count(valid, chunk_rows)
    e1, e2 = F.xxhash64(edge_col), F.xxhash64(F.lit(7), F.col(edge_col))
    pairs = valid.select(*runtime.key128(node_col), e1.alias("e1"), e2.alias("e2")).distinct()
    return tree_aggregate(pairs, ["k1", "k2"], ["e1"], {"n": F.count("*")}, {"n": F.sum}, chunks, fan_in)


def wrong_fan_in(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id): nodes with a ``fan_in`` that differs from their number of distinct incoming edges."""
    counted = distinct_degrees(edges)
    stated = nodes.filter(F.col("fan_in").isNotNull() & F.col("node_id").isNotNull()).select("node_id", F.col("fan_in").cast("long").alias("fan_in")).distinct()
    keyed = stated.select(*runtime.key128("node_id"), "node_id", "fan_in")
    return keyed.join(counted, ["k1", "k2"], "left").filter(F.col("fan_in") != F.coalesce("n", F.lit(0))).select("node_id").distinct()


def incoming_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, fan_in, n_edges): every node named by either table, with its stated and its counted incoming edges."""
    counted = distinct_degrees(edges)
    stated = nodes.filter(F.col("node_id").isNotNull()).groupBy("node_id").agg(F.max("fan_in").alias("fan_in"))
    named = edges.filter(F.col("dst_node").isNotNull()).select(F.col("dst_node").alias("node_id")).distinct()
    both = stated.join(named, "node_id", "full")
    return both.select(*runtime.key128("node_id"), "node_id", "fan_in").join(counted, ["k1", "k2"], "left").select("node_id", "fan_in", F.coalesce("n", F.lit(0)).cast("long").alias("n_edges"))
