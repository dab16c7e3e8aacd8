"""Canonical inputs of the reference queries, in Spark and as SQL, with the same rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.operators import catalog
from gneiss.plans.tables import table


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.current_documents(table(spark, folder, "documents"))


def symbols(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.current_symbols(table(spark, folder, "symbols"))


def nodes(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.current_nodes(table(spark, folder, "code_nodes"))


def edges(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.current_edges(table(spark, folder, "code_edges"))


def occurrences(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.current_occurrences(table(spark, folder, "occurrences"))


def intents(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.current_intents(table(spark, folder, "function_intents"))


def busiest_symbol(spark: SparkSession, folder: str) -> DataFrame:
    """(symbol_id): the symbol of a current node with the most outgoing and incoming calls, the least id of equals."""
    ends = edges(spark, folder).filter("edge_type = 'calls'").select(F.explode(F.array("src_node", "dst_node")).alias("node_id")).groupBy("node_id").agg(F.count("*").alias("c"))
    return ends.join(nodes(spark, folder).select("node_id", "symbol_id"), "node_id").orderBy(F.desc("c"), "symbol_id").limit(1).select("symbol_id")


def busiest_caller(spark: SparkSession, folder: str) -> DataFrame:
    """(symbol_id): the symbol of a current node with the most outgoing calls, the least id of equals."""
    calls = edges(spark, folder).filter("edge_type = 'calls'").groupBy(F.col("src_node").alias("node_id")).agg(F.count("*").alias("c"))
    return calls.join(nodes(spark, folder).select("node_id", "symbol_id"), "node_id").orderBy(F.desc("c"), "symbol_id").limit(1).select("symbol_id")


def most_referenced(spark: SparkSession, folder: str) -> DataFrame:
    """(symbol_id): of the symbols defined in current documents the one with the most occurrences in them."""
    found = occurrences(spark, folder).join(documents(spark, folder).select("document_id"), "document_id", "left_semi")
    counted = found.groupBy("symbol_id").agg(F.count("*").alias("c"), F.max(F.col("role") == "definition").alias("defined"))
    return counted.filter("defined").orderBy(F.desc("c"), "symbol_id").limit(1).select("symbol_id")


_RANGES = ", ".join(f"{p}range_{e}_{c}" for p in ("", "enclosing_") for e in ("start", "end") for c in ("line", "col"))

SQL = {
    "d": "d as (select * exclude (rn) from (select *, row_number() over (partition by document_id order by ingested_at desc, doc_id desc) as rn from documents where document_id is not null) where rn = 1 and deleted_at is null)",
    "s": "s as (select * exclude (rn) from (select *, row_number() over (partition by symbol_id order by ingested_at desc) as rn from symbols where symbol_id is not null) where rn = 1 and deleted_at is null)",
    "n": "n as (select * exclude (rn) from (select *, row_number() over (partition by node_id order by ingested_at desc) as rn from code_nodes where node_id is not null) where rn = 1 and deleted_at is null)",
    "e": "e as (select distinct on (edge_id) * from code_edges where src_node <> '' and dst_node <> '' and edge_id is not null)",
    "o": f"o as (select document_id, symbol_id, role, syntax_kind, {_RANGES}, min(id) as id from occurrences where document_id <> '' and symbol_id <> '' group by all)",
    "i": "i as (select distinct on (node_id) * from function_intents where node_id is not null)",
    "busy": "busy as (select n.symbol_id from (select x, count(*) as c from (select unnest([src_node, dst_node]) as x from e where edge_type = 'calls') group by 1) join n on n.node_id = x order by c desc, n.symbol_id limit 1)",
    "top": "top as (select symbol_id from o where document_id in (select document_id from d) group by 1 having bool_or(role = 'definition') order by count(*) desc, symbol_id limit 1)",
    "caller": "caller as (select n.symbol_id from (select src_node as x, count(*) as c from e where edge_type = 'calls' group by 1) join n on n.node_id = x order by c desc, n.symbol_id limit 1)",
}


def with_sql(names: str, body: str, more: str = "", recursive: bool = False) -> str:
    """The body after the common table expressions named (space-separated) and those of ``more``."""
    parts = [SQL[n] for n in names.split()] + ([more] if more else [])
    return f"with {'recursive ' if recursive else ''}{', '.join(parts)} {body}"


def bm25_sql(source: str, id_col: str, text: str, query: str, name: str = "bm") -> str:
    """CTEs ending in ``name`` (id, score): the full-text score in SQL."""
    from gneiss.operators.text import query_phrases

    phrases = query_phrases(query)
    terms = f"list_filter(regexp_split_to_array(translate(lower(coalesce({text}, '')), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"
    counts = ", ".join(
        f"len(list_filter(t, lambda x: x = '{p[0]}')) as f{i}" if len(p) == 1 else f"len(list_filter(range(1, len(t) - {len(p)} + 2), lambda k: t[k] = '{p[0]}' and t[k:k+{len(p) - 1}] = {p!r})) as f{i}" for i, p in enumerate(phrases)
    )
    score = " + ".join(f"greatest(ln((n - n{i} + 0.5) / (n{i} + 0.5)), 1e-6) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(len(phrases)))
    return f"""{name}_t as (select {id_col} as id, {terms} as t from {source}), {name}_c as (select id, len(t) as dl, {counts} from {name}_t),
      {name}_s as (select count(*) as n, avg(dl) as avgdl, {", ".join(f"count(*) filter (f{i} > 0) as n{i}" for i in range(len(phrases)))} from {name}_c),
      {name} as (select id, {score} as score from {name}_c, {name}_s where {" or ".join(f"f{i} > 0" for i in range(len(phrases)))})"""
