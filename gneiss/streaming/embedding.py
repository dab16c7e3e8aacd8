"""Embedding runs: vectors for the chunks that have none, by a provider that may fail.

The pending chunks (an anti-join) are embedded batch by batch inside the tasks; a failed call is repeated by its kind of error,
a batch that fails for good is counted and left for the next run, and the run goes on.  Vectors and failures are tables, so a
repeated run starts where the last one ended; the number of partitions bounds the calls at one time.
"""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss import runtime
from gneiss.operators import vectors

_RESULT = "chunk_id string, vec array<double>, batch string, attempts int, error string"
#: Kinds of error after which a call is repeated.
RETRIED = frozenset({"rate_limit", "timeout", "network", "server_error"})


class ProviderError(Exception):
    """A failed call, with the status and the wait the provider asks for, if any."""

    def __init__(self, message: str, status: int | None = None, retry_after: float | None = None) -> None:
        super().__init__(message)
        self.status, self.retry_after = status, retry_after


def error_kind(error: Exception) -> str:
    """rate_limit, server_error, http_error, timeout, network or other."""
    status = getattr(error, "status", None)
    if status is not None:
        return "rate_limit" if status == 429 else "server_error" if status >= 500 else "http_error"
    words = f"{type(error).__name__} {error}".lower()
    for kind, marks in (("rate_limit", ("rate limit", "too many requests")), ("timeout", ("timeout", "timed out")), ("network", ("connection", "network", "unreachable", "dns"))):
        if any(m in words for m in marks):
            return kind
    return "other"


@dataclass(frozen=True)
class Policy:
    attempts: int = 3
    wait: float = 0.5
    statuses: frozenset[int] = frozenset()

    def call(self, embed: Callable[[list[str]], list[list[float]]], texts: list[str], sleep: Callable[[float], None] = time.sleep) -> tuple[list[list[float]] | None, int, str | None]:
        """(vectors or None, attempts, kind of the last error)."""
        kind = None
        for attempt in range(1, self.attempts + 1):
            try:
                found = embed(texts)
                if len(found) != len(texts):
                    raise ValueError(f"{len(found)} vectors for {len(texts)} texts")
                return found, attempt, None
            except Exception as error:  # noqa: BLE001 - a provider may raise anything; the kind decides
                kind = error_kind(error)
                again = kind in RETRIED or getattr(error, "status", None) in self.statuses
                if not again or attempt == self.attempts:
                    return None, attempt, kind
                sleep(max(self.wait * 2 ** (attempt - 1), getattr(error, "retry_after", None) or 0.0))
        return None, self.attempts, kind


def embed_pending(spark: SparkSession, chunks: DataFrame, path: str, embed: Callable[[list[str]], list[list[float]]], version: str, batch: int = 32, policy: Policy = Policy(), tasks: int | None = None) -> DataFrame:
    """(n_pending, n_embedded, n_failed, n_batches, n_failed_batches, n_retries, success_rate, errors) of one run over (chunk_id, content).

    Vectors are appended to the table at ``path`` as (chunk_id, vec, embedding_version); ``errors`` has up to five kinds.
    """
    have = spark.read.parquet(path) if runtime.exists(spark, path) else None
    fresh = chunks.select("chunk_id", "content").dropDuplicates(["chunk_id"])
    pending = vectors.missing(fresh, have, version=version) if have is not None else fresh
    if tasks:
        pending = pending.repartition(tasks, "chunk_id")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for i in range(0, rows.num_rows, batch):
                part = rows.slice(i, batch)
                ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                found, attempts, error = policy.call(embed, [t or "" for t in texts])
                n = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.string()), pa.array(found or [None] * n, pa.list_(pa.float64())), pa.array([ids[0]] * n, pa.string()), pa.array([attempts] * n, pa.int32()), pa.array([error] * n, pa.string())],
                    names=["chunk_id", "vec", "batch", "attempts", "error"],
                )

    done = runtime.materialise(pending.mapInArrow(work, _RESULT), "embedded")
    done.filter("vec is not null").select("chunk_id", "vec", F.lit(version).alias("embedding_version")).write.mode("append").parquet(path)
    each = done.groupBy("batch").agg(F.count("*").alias("n"), F.max("attempts").alias("a"), F.max("error").alias("e"))
    stats = each.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_pending"), F.coalesce(F.sum(F.when(F.col("e").isNull(), F.col("n"))), F.lit(0)).alias("n_embedded"), F.coalesce(F.sum(F.when(F.col("e").isNotNull(), F.col("n"))), F.lit(0)).alias("n_failed"),
        F.count("*").alias("n_batches"), F.sum(F.col("e").isNotNull().cast("long")).alias("n_failed_batches"), F.coalesce(F.sum(F.col("a") - 1), F.lit(0)).alias("n_retries"), F.slice(F.sort_array(F.collect_set("e")), 1, 5).alias("errors"),
    )
    rate = F.when(F.col("n_pending") > 0, F.round(F.col("n_embedded") / F.col("n_pending"), 4)).otherwise(1.0)
    return stats.select("n_pending", "n_embedded", "n_failed", "n_batches", F.coalesce("n_failed_batches", F.lit(0)).alias("n_failed_batches"), "n_retries", rate.alias("success_rate"), "errors")


class QueryVectors:
    """Vectors of query texts by version, remembered for a while; a provider that fails gives None, and the search then nothing."""

    def __init__(self, embed: Callable[[str], list[float]], most: int = 256, seconds: float = 600.0, clock: Callable[[], float] = time.monotonic) -> None:
        self.embed, self.most, self.seconds, self.clock = embed, most, seconds, clock
        self.held: OrderedDict[tuple[str, str], tuple[float, list[float]]] = OrderedDict()
        self.hits = self.misses = self.failures = 0

    def get(self, version: str, query: str) -> list[float] | None:
        key, now = (version, query), self.clock()
        known = self.held.get(key)
        if known and now - known[0] < self.seconds:
            self.held.move_to_end(key)
            self.hits += 1
            return known[1]
        self.misses += 1
        try:
            vector = self.embed(query)
        except Exception:  # noqa: BLE001 - fails open
            self.failures += 1
            return None
        self.held[key] = (now, vector)
        self.held.move_to_end(key)
        while len(self.held) > self.most:
            self.held.popitem(last=False)
        return vector

    def rates(self) -> dict[str, float]:
        asked = self.hits + self.misses
        return {"requests": asked, "hit_rate": round(self.hits / asked, 4) if asked else 0.0, "failures": self.failures}
