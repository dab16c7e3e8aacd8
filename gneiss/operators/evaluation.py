"""Retrieval metrics: ranked rows (query_id, result_id, rank) against relevant rows (query_id, result_id)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gneiss import runtime


def judged(ranked: DataFrame, relevant: DataFrame) -> DataFrame:
    """Ranked rows with ``rel`` 1 for a relevant result."""
    marks = relevant.select("query_id", "result_id").distinct().withColumn("rel", F.lit(1))
    return ranked.join(marks, ["query_id", "result_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))


def _ideal(n: Column, k: int) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(n, F.lit(k)).cast("int"))), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))


def per_query(ranked: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, hit, recall, precision, mrr, ndcg) at k; the ideal of nDCG has min(relevant, k) hits.  Queries without relevant results are left out."""
    top = judged(ranked.filter(F.col("rank") <= k), relevant)
    found = top.groupBy("query_id").agg(F.sum("rel").alias("hits"), F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"), F.sum(F.col("rel") / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    size = relevant.select("query_id", "result_id").distinct().groupBy("query_id").agg(F.count("*").alias("n"))
    zero = F.lit(0)
    joined = size.join(found, "query_id", "left").select("query_id", "n", F.coalesce("hits", zero).alias("hits"), "first", F.coalesce("dcg", F.lit(0.0)).alias("dcg"))
    return joined.select(
        "query_id",
        (F.col("hits") > 0).cast("double").alias("hit"),
        F.round(F.col("hits") / F.col("n"), 6).alias("recall"),
        F.round(F.col("hits") / F.lit(float(k)), 6).alias("precision"),
        F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("mrr"),
        F.round(F.col("dcg") / _ideal(F.col("n"), k), 6).alias("ndcg"),
    )


METRICS = ("hit", "recall", "precision", "mrr", "ndcg")


def summary(metrics: DataFrame, facets: list[str]) -> DataFrame:
    """(facet, value, n, metrics...): means over all queries and per value of each facet, in one pass of grouping sets."""
    keyed = metrics.select(*(F.coalesce(F.col(f).cast("string"), F.lit("__missing__")).alias(f) for f in facets), *METRICS)
    means = [F.count("*").alias("n"), *(F.round(F.avg(m), 6).alias(m) for m in METRICS)]
    spread = keyed.select(F.explode(F.array(F.struct(F.lit("all").alias("facet"), F.lit("").alias("value")), *(F.struct(F.lit(f).alias("facet"), F.col(f).alias("value")) for f in facets))).alias("g"), *METRICS)
    return spread.groupBy(F.col("g.facet").alias("facet"), F.col("g.value").alias("value")).agg(*means)


def first_units(rows: DataFrame) -> DataFrame:
    """Rows (query_id, rank, unit) where a unit counts at its first rank only."""
    return rows.groupBy("query_id", "unit").agg(F.min("rank").alias("rank"))


def union_of(channels: list[DataFrame]) -> DataFrame:
    """(query_id, result_id, rank): the best rank of each result over all channels."""
    return reduce(DataFrame.unionByName, channels).groupBy("query_id", "result_id").agg(F.min("rank").alias("rank"))


def lower_percentile(values: DataFrame, group: str, value: str, share: float) -> DataFrame:
    """(group, value): the element at int(share * (n - 1)) of the sorted values.

    Equal values are counted first; counts are summed within range partitions of (group, value), shifted by the partitions before,
    so no task sorts a whole group.
    """
    counts = values.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("c"))
    ordered = runtime.materialise(counts.repartitionByRange(group, value).withColumn("part", F.spark_partition_id()), "counts")
    sums = ordered.groupBy(group, "part").agg(F.sum("c").alias("s"))
    whole = Window.partitionBy(group)
    shift = sums.select(group, "part", (F.sum("s").over(whole.orderBy("part")) - F.col("s")).alias("before"), F.sum("s").over(whole).alias("n"))
    inside = F.sum("c").over(Window.partitionBy("part", group).orderBy(value))
    placed = ordered.withColumn("reach", inside).join(F.broadcast(shift), [group, "part"]).withColumn("reach", F.col("reach") + F.col("before"))
    at = F.floor(F.lit(share) * (F.col("n") - 1))
    return placed.filter((at < F.col("reach")) & (at >= F.col("reach") - F.col("c"))).select(group, value)


def grep(documents: DataFrame, pattern: str) -> DataFrame:
    """(relative_path, rank): paths of the documents that match, in order of path."""
    hits = documents.filter(F.col("content").rlike(pattern)).select("relative_path").distinct()
    return runtime.numbered(hits, ["relative_path"])


def unmatched(found: DataFrame, expected: DataFrame, column: str) -> DataFrame:
    """(column, side): what only the search found ('extra') and what only was expected ('missing')."""
    extra = found.select(column).distinct().join(expected.select(column), column, "left_anti").withColumn("side", F.lit("extra"))
    missing = expected.select(column).distinct().join(found.select(column), column, "left_anti").withColumn("side", F.lit("missing"))
    return extra.unionByName(missing)


def graded_gain(graded: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, dcg): sum of (2^rel - 1) / log2(rank + 1) over (query_id, rank, rel) down to rank ``k``."""
    return graded.filter(F.col("rank") <= k).groupBy("query_id").agg(F.round(F.sum((F.pow(F.lit(2.0), "rel") - 1) / F.log2(F.col("rank") + 1.0)), 6).alias("dcg"))


def missing_gold(relevant: DataFrame, ranked: DataFrame) -> DataFrame:
    return relevant.select("query_id", "result_id").distinct().join(ranked, ["query_id", "result_id"], "left_anti")
