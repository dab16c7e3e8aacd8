"""Queries of the general data problems: orphan references, skewed aggregation, hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.operators import hierarchy, references, tree_aggregate
from gneiss.plans.tables import table


def _all(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {n: table(spark, folder, n) for n in ("occurrences", "code_edges", "symbols", "documents", "code_nodes")}


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return references.orphans(_all(spark, folder))


def p4_by_period(spark: SparkSession, folder: str) -> DataFrame:
    return references.orphan_report(_all(spark, folder))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return tree_aggregate.wrong_fan_in(table(spark, folder, "code_nodes"), table(spark, folder, "code_edges"))


def p6_incoming(spark: SparkSession, folder: str) -> DataFrame:
    return tree_aggregate.incoming_edges(table(spark, folder, "code_nodes"), table(spark, folder, "code_edges"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    tree = hierarchy.hierarchy(hierarchy.latest_links(table(spark, folder, "symbols")), paths=False)
    return tree.filter("in_loop").select(F.col("node").alias("symbol_id"))


def p7_tree(spark: SparkSession, folder: str) -> DataFrame:
    tree = hierarchy.hierarchy(hierarchy.latest_links(table(spark, folder, "symbols")))
    return hierarchy.hierarchy_report(tree).withColumnRenamed("node", "symbol_id")


def p7_descendants(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchy.descendants(hierarchy.hierarchy(hierarchy.latest_links(table(spark, folder, "symbols"))))


def _orphan_sql(r: references.Reference) -> str:
    return f"""select '{r.table}' as ref_table, '{r.field}' as ref_field, cast(c.{r.row_key} as varchar) as row_key, c.{r.field} as key, c.ingested_at as "at"
      from {r.table} c where c.{r.field} <> '' and c.{r.row_key} is not null and not exists
      (select 1 from (select {r.parent_key} as k, min(ingested_at) as since from {r.parent_table} where deleted_at is null group by 1) p
       where p.k = c.{r.field} and p.since <= c.ingested_at)"""


_ORPHANS = " union all ".join(map(_orphan_sql, references.REFERENCES))
_LATEST = """latest as (select symbol_id as node, max(struct_pack(t := ingested_at, p := enclosing_symbol)).p as parent from symbols where symbol_id is not null group by 1),
  down as (select l.node, l.node as root, 0::bigint as depth, l.node as path from latest l left join latest p on l.parent = p.node where p.node is null
    union all select l.node, d.root, d.depth + 1, d.path || ' > ' || l.node from latest l join down d on l.parent = d.node)"""
_CLOSURE = """pairs as (select l.parent as ancestor, l.node as descendant, 1::bigint as distance from latest l join down d on l.parent = d.node
    union all select l.parent, p.descendant, p.distance + 1 from pairs p join latest l on l.node = p.ancestor join down d on d.node = l.parent)"""

QUERIES = {f.__name__: f for f in (p4_found, p4_by_period, p6_found, p6_incoming, p7_found, p7_tree, p7_descendants)}
ORACLES = {
    "p4_found": f"select distinct ref_table, ref_field, row_key from ({_ORPHANS})",
    "p4_by_period": f"""select ref_table, ref_field, strftime("at", '%Y-%m') as period, count(*) as n_rows, count(distinct key) as n_keys from ({_ORPHANS}) group by 1, 2, 3""",
    "p6_found": """select distinct n.node_id from code_nodes n left join
      (select dst_node, count(distinct edge_id) as c from code_edges where dst_node is not null group by 1) e on e.dst_node = n.node_id
      where n.fan_in is not null and n.fan_in <> coalesce(e.c, 0)""",
    "p6_incoming": """with e as (select dst_node as node_id, count(distinct edge_id) as c from code_edges where dst_node is not null group by 1),
      n as (select node_id, max(fan_in) as fan_in from code_nodes where node_id is not null group by 1)
      select coalesce(n.node_id, e.node_id) as node_id, n.fan_in, coalesce(e.c, 0) as n_edges from n full join e on n.node_id = e.node_id""",
    "p7_found": f"with recursive {_LATEST} select node as symbol_id from latest where node not in (select node from down)",
    "p7_tree": f"""with recursive {_LATEST}, {_CLOSURE}
      select l.node as symbol_id, d.root, d.depth, d.path, d.node is null as in_loop, coalesce(c.n, 0) as n_descendants
      from latest l left join down d on d.node = l.node left join (select ancestor, count(*) as n from pairs group by 1) c on c.ancestor = l.node""",
    "p7_descendants": f"with recursive {_LATEST}, {_CLOSURE} select ancestor, descendant, distance from pairs",
}
