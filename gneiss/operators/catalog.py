"""Canonical views of the raw tables: the valid version of every record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def last_wins(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Keyed upsert: the row that comes first in ``order`` per key; null keys are left out."""
    for k in keys:
        rows = rows.filter(F.col(k).isNotNull())
    ranked = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter("_rn = 1").drop("_rn")


def current_documents(documents: DataFrame) -> DataFrame:
    """The latest version of every document unless deleted; only keys are reduced, texts meet the chosen keys."""
    latest = documents.filter("document_id is not null").groupBy("document_id").agg(F.max(F.struct("ingested_at", "doc_id")).alias("at"))
    return documents.filter("deleted_at is null").join(latest.select(F.col("at.doc_id").alias("doc_id")), "doc_id", "left_semi")


def current_symbols(symbols: DataFrame) -> DataFrame:
    return last_wins(symbols, ["symbol_id"], [F.desc("ingested_at")]).filter("deleted_at is null")


def current_nodes(nodes: DataFrame) -> DataFrame:
    return last_wins(nodes, ["node_id"], [F.desc("ingested_at")]).filter("deleted_at is null")


def current_edges(edges: DataFrame) -> DataFrame:
    """One row per edge with two ends; copies of an edge are equal."""
    return edges.filter("src_node <> '' and dst_node <> '' and edge_id is not null").dropDuplicates(["edge_id"])


def current_occurrences(occurrences: DataFrame) -> DataFrame:
    """Occurrences with both references; a retried batch repeats a row under a new id, the least id stays."""
    kept = ["document_id", "symbol_id", "role", "syntax_kind"] + [f"{p}range_{e}_{c}" for p in ("", "enclosing_") for e in ("start", "end") for c in ("line", "col")]
    return occurrences.filter("document_id <> '' and symbol_id <> ''").groupBy(*kept).agg(F.min("id").alias("id"))


def current_intents(intents: DataFrame) -> DataFrame:
    return intents.filter("node_id is not null").dropDuplicates(["node_id"])
