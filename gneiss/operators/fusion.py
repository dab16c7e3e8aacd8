"""Fusion of ranked channels.  A channel is (result_id, score), best first by score then id, or carries ``rank``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gneiss.operators import text

#: Rows of a ranked channel.
MOST_RESULTS = 10_000
WEIGHTS = {"structure": 0.5, "keyword": 0.2, "semantic": 0.3}


def ranked(channel: DataFrame) -> DataFrame:
    """Adds ``rank`` to a channel, which has ``MOST_RESULTS`` rows at most: fusion reads it several times, so these become a local table."""
    rows = channel.select("result_id", "score").orderBy(F.desc("score"), "result_id").limit(MOST_RESULTS + 1).collect()
    if len(rows) > MOST_RESULTS:
        raise ValueError(f"a ranked channel has {MOST_RESULTS} rows at most; limit it")
    return channel.sparkSession.createDataFrame([(*r, i) for i, r in enumerate(rows, 1)], "result_id string, score double, rank int")


def _stacked(channels: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, (c.select("result_id", "score", "rank", F.lit(name).alias("channel"), F.lit(i).alias("ord")) for i, (name, c) in enumerate(channels.items())))


def linear(channels: dict[str, DataFrame], top_k: int) -> DataFrame:
    """(result_id, score): weighted sum of the raw scores; equal scores keep the order of the channels."""
    weight = reduce(lambda a, kv: F.when(F.col("channel") == kv[0], kv[1]).otherwise(a), WEIGHTS.items(), F.lit(0.0))
    fused = _stacked(channels).groupBy("result_id").agg(F.sum(F.col("score") * weight).alias("score"), F.min(F.struct("ord", "rank")).alias("first"))
    return fused.orderBy(F.desc(F.round("score", 9)), "first").limit(top_k).select("result_id", "score")


def rrf(channels: dict[str, DataFrame], top_k: int, k: int = 60) -> DataFrame:
    """(result_id, score): reciprocal ranks summed."""
    fused = _stacked(channels).groupBy("result_id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.min(F.struct("ord", "rank")).alias("first"))
    return fused.orderBy(F.desc(F.round("score", 9)), "first").limit(top_k).select("result_id", "score")


def dense_guarded(structured: DataFrame, keyword: DataFrame, semantic: DataFrame, paths: DataFrame, top_k: int) -> DataFrame:
    """(result_id, score, position): the semantic list with small boosts, and at most two inserts before its tail.

    ``paths`` maps result_id to path; keyword inserts must add a file that the top of the semantic list lacks.
    """
    limit = max(1, int(top_k))
    inserts = min(2, limit // 10)
    k, s = keyword.select("result_id", F.col("rank").alias("kr")), structured.select("result_id", F.col("rank").alias("sr"))
    boosted = semantic.join(k, "result_id", "left").join(s, "result_id", "left")
    boost = F.coalesce(0.01 / F.col("kr"), F.lit(0.0)) + F.coalesce(0.015 / F.col("sr"), F.lit(0.0))
    backbone = boosted.select("result_id", (F.col("score") + boost).alias("score"), F.col("rank").alias("r"))
    if inserts == 0:
        return backbone.select("result_id", "score", F.col("r").cast("double").alias("position")).orderBy("position")
    top_paths = backbone.filter(F.col("r") <= limit).join(paths, "result_id").select("path").distinct()
    fresh = structured.filter("rank <= 2").select("result_id", (0.02 / F.col("rank")).alias("score"), F.lit(0).alias("ord"), "rank")
    words = keyword.filter(F.col("rank") <= max(1, min(3, limit // 3))).join(paths, "result_id", "left").join(top_paths, "path", "left_anti").select("result_id", (0.01 / F.col("rank")).alias("score"), F.lit(1).alias("ord"), "rank")
    chosen = fresh.unionByName(words).join(semantic.select("result_id"), "result_id", "left_anti")
    chosen = chosen.withColumn("n", F.row_number().over(Window.partitionBy("result_id").orderBy("ord", "rank"))).filter("n = 1").orderBy("ord", "rank").limit(inserts)
    chosen = chosen.select("result_id", "score", F.row_number().over(Window.orderBy("ord", "rank")).alias("i"))
    keep = F.greatest(F.lit(1), F.lit(limit) - F.col("c"))
    counted = backbone.crossJoin(F.broadcast(chosen.agg(F.count("*").alias("c"))))
    main = counted.select("result_id", "score", F.when(F.col("r") <= keep, F.col("r")).otherwise(F.col("r") + F.col("c")).cast("double").alias("position"))
    added = chosen.crossJoin(F.broadcast(chosen.agg(F.count("*").alias("c")))).select("result_id", "score", (keep + F.col("i")).cast("double").alias("position"))
    return main.unionByName(added).orderBy("position")


def prefer_source(results: DataFrame, paths: DataFrame, query: str, factor: float = 0.55) -> DataFrame:
    """(result_id, score): scores of likely test code times (below zero: divided by) the factor, unless the query asks for tests."""
    if factor >= 0.999 or text.asks_for_tests(query):
        return results.select("result_id", "score")
    joined = results.join(paths, "result_id", "left")
    lowered = F.when(F.col("score") >= 0, F.col("score") * factor).otherwise(F.col("score") / factor)
    return joined.select("result_id", F.when(text.is_test_path("path"), lowered).otherwise(F.col("score")).alias("score"))


def with_payload(fused: DataFrame, channels: list[DataFrame]) -> DataFrame:
    """``fused`` with the payload of the first channel (result_id, payload) that has one for the result."""
    stacked = reduce(DataFrame.unionByName, (c.select("result_id", "payload", F.lit(i).alias("o")) for i, c in enumerate(channels)))
    first = stacked.filter("payload is not null").groupBy("result_id").agg(F.min(F.struct("o", "payload")).alias("p"))
    return fused.join(first, "result_id", "left").select(*fused.columns, F.col("p.payload").alias("payload"))
