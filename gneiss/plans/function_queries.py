"""Queries of name functions, Java resolution, gold lookup and dataset handling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.operators import java
from gneiss.plans import canonical as c
from gneiss.plans.canonical import with_sql
from gneiss.sources import datasets


def f_descriptor(s: SparkSession, d: str) -> DataFrame:
    return c.symbols(s, d).select("symbol_id", java.descriptor("symbol_id").alias("descriptor"), java.package_path("symbol_id").alias("package_path"), java.owner_of("symbol_id", F.lit("")).alias("owner"))


def f_java_imports(s: SparkSession, d: str) -> DataFrame:
    return java.imports(c.documents(s, d), "document_id", "content").withColumnRenamed("id", "document_id")


def f_source_suffix(s: SparkSession, d: str) -> DataFrame:
    return c.symbols(s, d).select("symbol_id", java.source_suffix("symbol_id").alias("suffix")).filter("suffix is not null")


def _gold(s: SparkSession, d: str) -> DataFrame:
    """Gold names out of symbol ids: package.Type#method/arity."""
    sym = c.symbols(s, d).filter("kind = 'Method' and package <> ''")
    kind = F.regexp_extract("symbol_id", r"#?(\w+)[#.]\w+", 1)
    return sym.select(F.col("symbol_id").alias("query_id"), F.concat("package", F.lit("."), kind, F.lit("#"), "display_name", F.lit("/0")).alias("gold"))


def f_gold_names(s: SparkSession, d: str) -> DataFrame:
    return _gold(s, d).select("query_id", java.type_name("gold").alias("type_name"), java.method_hint("gold").alias("method"))


def j_gold_documents(s: SparkSession, d: str) -> DataFrame:
    return java.gold_documents(_gold(s, d), c.documents(s, d))


def f_symbol_match(s: SparkSession, d: str) -> DataFrame:
    """Chunks of documents whose symbols match the gold name of one of them, per document and name."""
    o = c.occurrences(s, d).filter("role = 'definition'").select("document_id", "symbol_id")
    primary = o.groupBy("document_id").agg(F.sort_array(F.collect_set("symbol_id")).alias("symbols"))
    gold = _gold(s, d).join(o, F.col("query_id") == F.col("symbol_id")).select("document_id", "gold").distinct()
    return gold.join(primary, "document_id").filter(java.symbol_matches("document_id", "symbols", "gold")).select("document_id", "gold")


def j_type_resolution(s: SparkSession, d: str) -> DataFrame:
    types = c.symbols(s, d).filter("kind in ('Class', 'Interface', 'Enum', 'Record')").select("symbol_id", "package", F.col("display_name").alias("name"))
    docs = c.documents(s, d).filter("relative_path like '%.java'").select("document_id", F.regexp_extract("content", r"(?m)^package ([\w.]+)", 1).alias("package"), F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit(r"(?:extends|implements|new) (\w+)"), F.lit(1)))).alias("name"))
    imported = java.imports(c.documents(s, d), "document_id", "content").select(F.col("id").alias("document_id"), F.col("short").alias("name"), F.col("name").alias("qualified"), "wildcard")
    own = c.documents(s, d).filter("relative_path like '%.java'").select("document_id", F.regexp_extract("content", r"(?m)^package ([\w.]+)", 1).alias("package"), F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit(r"class (\w+)"), F.lit(1)))).alias("name"))
    return java.resolve_types(docs.union(own).distinct(), imported, types)


def j_member_resolution(s: SparkSession, d: str) -> DataFrame:
    """Methods and fields by owner and name: every name that its owner has once meets its symbol, the others none."""
    members = c.symbols(s, d).filter("lower(kind) in ('method', 'constructor', 'field', 'staticmethod', 'staticfield') and enclosing_symbol <> ''").select("symbol_id", F.col("enclosing_symbol").alias("owner"), F.col("display_name").alias("name"))
    return java.resolve_members(members.select("owner", "name").distinct(), members, ["owner", "name"])


def f_bar_lists(s: SparkSession, d: str) -> DataFrame:
    """Texts cut at bars, trimmed, without empty parts."""
    joined = c.symbols(s, d).select("symbol_id", F.concat_ws(" | ", "package", F.lit(" "), "display_name", "kind").alias("t"))
    return joined.select("symbol_id", F.explode(F.filter(F.split("t", r"\s*\|\s*"), lambda x: F.trim(x) != "")).alias("part")).distinct()


def s_prune_dataset(s: SparkSession, d: str) -> DataFrame:
    rows = _gold(s, d)
    return datasets.prune(rows, java.gold_documents(rows, c.documents(s, d))).select("query_id")


def x_override_merge(s: SparkSession, d: str) -> DataFrame:
    """Settings per snapshot: of the snapshot, else of the repository, else the default."""
    docs = c.documents(s, d).filter("repo is not null and commit_hash is not null")
    snap = docs.select("repo", "commit_hash").distinct()
    by_repo = docs.groupBy("repo").agg(F.max("language").alias("v1"))
    by_snap = docs.filter("language like 'r%'").groupBy("repo", "commit_hash").agg(F.max("language").alias("v2"))
    return snap.join(by_repo, "repo", "left").join(by_snap, ["repo", "commit_hash"], "left").select("repo", "commit_hash", F.coalesce("v2", "v1", F.lit("default")).alias("value"))


QUERIES = {f.__name__: f for f in (f_descriptor, f_java_imports, f_source_suffix, f_gold_names, j_gold_documents, f_symbol_match, j_type_resolution, j_member_resolution, f_bar_lists, s_prune_dataset, x_override_merge)}

_DESC = "case when len(string_split(symbol_id, ' ')) >= 5 then array_to_string(string_split(symbol_id, ' ')[5:], ' ') else '' end"
_GOLD = "gold as (select symbol_id as query_id, package || '.' || regexp_extract(symbol_id, '#?(\\w+)[#.]\\w+', 1) || '#' || display_name || '/0' as gold from s where kind = 'Method' and package <> '')"
_TYPE = "split_part(replace(trim(gold), '`', ''), '#', 1)"
_HINT = "nullif(split_part(split_part(replace(trim(regexp_extract(gold, '#(.*)$', 1)), '`', ''), '/', 1), '(', 1), '')"
_STEMS = """dk as (select document_id, case when j <> '' then j else k end as stem, (j = '')::int as kt from (select document_id, regexp_extract(relative_path, '(^|/)main/java/(.+)\\.java$', 2) as j, regexp_extract(relative_path, '(^|/)main/kotlin/(.+)\\.kt$', 2) as k from d) where j <> '' or k <> ''),
  gp as (select query_id, k, array_to_string(p[1:k], '/') as stem from (select query_id, p, unnest(range(1, len(p) + 1)) as k from (select query_id, string_split({t}, '.') as p from gold))),
  gd as (select distinct query_id, document_id from (select query_id, document_id, rank() over (partition by query_id order by k desc, kt) as r from gp join dk using (stem)) where r = 1)""".format(t=_TYPE)
_IMPORTS = """im as (select distinct document_id, case when wildcard then left(w, length(w) - 2) else w end as name, case when not wildcard then split_part(w, '.', -1) end as short, wildcard
  from (select document_id, w, w like '%.*' as wildcard from (select document_id, regexp_replace(regexp_replace(unnest(regexp_extract_all(content, '(?m)^[ \\t]*import\\s+([^;()=]*);', 1)), '^static\\s+', ''), '\\s+', '', 'g') as w from d where content is not null))
  where regexp_full_match(w, '[\\p{L}_$][\\p{L}\\p{N}_$]*([.][\\p{L}_$][\\p{L}\\p{N}_$]*)*([.][*])?'))"""

ORACLES = {
    "f_descriptor": with_sql("s", """select symbol_id, ds as descriptor, case when ds like '%/' then rtrim(ds, '/') when contains(ds, '/') then regexp_extract(ds, '^(.*)/[^/]*$', 1) else '' end as package_path,
      case when not starts_with(symbol_id, 'local ') and not ds like '%/' and instr(ds, '#') > 0 and instr(ds, '#') < length(ds) then symbol_id[1:length(symbol_id) - length(ds) + instr(ds, '#')] else '' end as owner from x""", f"x as (select symbol_id, {_DESC} as ds from s)"),
    "f_java_imports": with_sql("d", "select document_id, name, short, wildcard from im", _IMPORTS),
    "f_source_suffix": with_sql("s", "select symbol_id, case when b like '%.java' then b else b || '.java' end as suffix from (select symbol_id, trim(split_part(regexp_extract(symbol_id, '((?:org|com|io|javax|java)/.*)$', 1), '#', 1)) as b from s where contains(symbol_id, '#')) where b <> ''"),
    "f_gold_names": with_sql("s", f"select query_id, {_TYPE} as type_name, {_HINT} as method from gold", _GOLD),
    "j_gold_documents": with_sql("s d", "select query_id, document_id from gd", f"{_GOLD}, {_STEMS}"),
    "f_symbol_match": with_sql("s o", """select document_id, gold from (select distinct od.document_id, gold from gold join od on od.symbol_id = gold.query_id) g join (select document_id, list(symbol_id) as symbols from od group by 1) using (document_id)
      where len(list_filter(list_append(symbols, document_id), lambda h: contains(h, gold) or contains(gold, h) or contains(h, split_part(split_part(gold, '#', 2), '/', 1)))) > 0""", f"{_GOLD}, od as (select distinct document_id, symbol_id from o where role = 'definition')"),
    "j_type_resolution": with_sql("d s", """select distinct document_id, name, coalesce(b1.symbol_id, b2.symbol_id, b3.symbol_id, b5.symbol_id, b4.symbol_id) as symbol_id from u left join bf b1 on b1.q = u.name
      left join (select document_id, name, symbol_id from (select document_id, short as name, min(im.name) as q from im where not wildcard group by 1, 2 having count(distinct im.name) = 1) join bf using (q)) b2 using (document_id, name)
      left join (select package, name, min(symbol_id) as symbol_id from ty group by 1, 2 having count(distinct symbol_id) = 1) b3 using (package, name)
      left join (select name, min(symbol_id) as symbol_id from ty group by 1 having count(distinct symbol_id) = 1) b4 using (name)
      left join (select document_id, name, min(symbol_id) as symbol_id from (select distinct u.document_id, u.name, bp.package, bp.symbol_id from u join im on im.document_id = u.document_id and im.wildcard join (select package, name, min(symbol_id) as symbol_id from ty group by 1, 2 having count(distinct symbol_id) = 1) bp on bp.package = im.name and bp.name = u.name) group by 1, 2 having count(*) = 1) b5 using (document_id, name)
      where coalesce(b1.symbol_id, b2.symbol_id, b3.symbol_id, b5.symbol_id, b4.symbol_id) is not null""", _IMPORTS + """,
      ty as (select symbol_id, package, display_name as name from s where kind in ('Class', 'Interface', 'Enum', 'Record')), bf as (select concat_ws('.', package, name) as q, min(symbol_id) as symbol_id from ty group by 1 having count(distinct symbol_id) = 1),
      u as (select distinct document_id, regexp_extract(content, '(?m)^package ([\\w.]+)', 1) as package, unnest(list_concat(regexp_extract_all(content, '(?:extends|implements|new) (\\w+)', 1), regexp_extract_all(content, 'class (\\w+)', 1))) as name from d where relative_path like '%.java' and content is not null)"""),
    "j_member_resolution": with_sql("s", "select owner, name, case when min(symbol_id) = max(symbol_id) then min(symbol_id) end as symbol_id from (select enclosing_symbol as owner, display_name as name, symbol_id from s where lower(kind) in ('method', 'constructor', 'field', 'staticmethod', 'staticfield') and enclosing_symbol <> '') group by 1, 2"),
    "f_bar_lists": with_sql("s", "select distinct symbol_id, part from (select symbol_id, unnest(regexp_split_to_array(concat_ws(' | ', package, ' ', display_name, kind), '\\s*\\|\\s*')) as part from s) where trim(part) <> ''"),
    "s_prune_dataset": with_sql("s d", "select query_id from gold where query_id in (select query_id from gd)", f"{_GOLD}, {_STEMS}"),
    "x_override_merge": with_sql("d", "select repo, commit_hash, coalesce(max(case when language like 'r%' then language end), any_value(v1), 'default') as value from d join (select repo, max(language) as v1 from d group by 1) using (repo) where commit_hash is not null group by 1, 2"),
}
