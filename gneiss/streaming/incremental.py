"""Incremental processing: a stream of index lines into keyed tables, and vectors for chunks that have none."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss import runtime
from gneiss.operators import text
from gneiss.sources import records


def index_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Stream of index records out of the line files that arrive in a folder."""
    return records.parse_lines(spark.readStream.schema("value string").format("text").load(folder))


def hash_vectors(chunks: DataFrame, dim: int = 128) -> DataFrame:
    """(chunk_id, vec): dense hash vectors of chunks."""
    sparse = text.hash_vector(chunks, "chunk_id", "content", dim)
    packed = sparse.groupBy(F.col("id").alias("chunk_id")).agg(F.map_from_entries(F.collect_list(F.struct("idx", "v"))).alias("m"))
    return packed.select("chunk_id", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("vec"))


def embed_new(spark: SparkSession, chunks: DataFrame, table: str, checkpoint: str, embed: Callable[[DataFrame], DataFrame] = hash_vectors):
    """Starts a run over the available chunks that appends the vectors the table lacks; repeating a batch adds nothing.

    ``chunks`` is a stream of (chunk_id, content); ``embed`` maps it to (chunk_id, vec).
    """

    def write(batch: DataFrame, _: int) -> None:
        fresh = batch.dropDuplicates(["chunk_id"])
        if runtime.exists(spark, table):
            fresh = fresh.join(spark.read.parquet(table).select("chunk_id"), "chunk_id", "left_anti")
        embed(fresh).write.mode("append").parquet(table)

    return chunks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """(start, event_type, n, total): windowed counts of an event stream with a bound on lateness; also runs on a table."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", window).alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
        .select(F.col("w.start").alias("start"), "event_type", "n", "total")
    )
