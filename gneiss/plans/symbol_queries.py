"""Queries of the structured symbol operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.operators import symbols as ops
from gneiss.operators import text
from gneiss.plans import canonical as c
from gneiss.plans.canonical import bm25_sql, with_sql

_Q = "offset lexer"
_INTENT = "frozen catalog"


def q_find_entity_exact(s: SparkSession, d: str) -> DataFrame:
    return ops.find_entity(c.symbols(s, d), "method", "run", "exact")


def q_find_entity_contains(s: SparkSession, d: str) -> DataFrame:
    return ops.find_entity(c.symbols(s, d), "type", "Lexer")


def q_find_entity_package(s: SparkSession, d: str) -> DataFrame:
    return ops.find_entity(c.symbols(s, d), "any", "cache", package_contains="lodestone", limit=20)


def q_symbol_exact(s: SparkSession, d: str) -> DataFrame:
    return ops.symbol_exact(c.symbols(s, d), _Q, 10)


def j_def_of(s: SparkSession, d: str) -> DataFrame:
    return ops.definitions_of(c.occurrences(s, d), c.documents(s, d), c.most_referenced(s, d), 50)


def a_refs_of(s: SparkSession, d: str) -> DataFrame:
    return ops.references_of(c.occurrences(s, d), c.documents(s, d), c.most_referenced(s, d), 50)


def a_callers_of(s: SparkSession, d: str) -> DataFrame:
    return ops.callers_of(c.edges(s, d), c.nodes(s, d), c.busiest_symbol(s, d), 25)


def a_callees_of(s: SparkSession, d: str) -> DataFrame:
    return ops.callees_of(c.edges(s, d), c.nodes(s, d), c.busiest_caller(s, d), 25)


def q_merge_ranked(s: SparkSession, d: str) -> DataFrame:
    near = [q(s, d).select(F.col("symbol_id").alias("result_id"), F.col("confidence").alias("score")) for q in (a_callers_of, a_callees_of)]
    return ops.merge_ranked(*near, 30)


def q_intent_search(s: SparkSession, d: str) -> DataFrame:
    return ops.search_intents(c.intents(s, d), c.nodes(s, d), _INTENT, 20)


def j_symbol_signature(s: SparkSession, d: str) -> DataFrame:
    """Signature of every defined symbol: the node's, else the display name; definitions counted."""
    defined = c.occurrences(s, d).filter("role = 'definition'").groupBy("symbol_id").agg(F.count("*").alias("n_definitions"))
    n = c.nodes(s, d).groupBy("symbol_id").agg(F.max("signature").alias("signature"))
    return c.symbols(s, d).join(defined, "symbol_id").join(n, "symbol_id", "left").select("symbol_id", F.coalesce("signature", "display_name").alias("signature"), "n_definitions")


def w_first_definition(s: SparkSession, d: str) -> DataFrame:
    places = c.occurrences(s, d).filter("role = 'definition'").join(c.documents(s, d).select("document_id", "relative_path"), "document_id")
    first = places.groupBy("symbol_id").agg(F.min(F.struct("relative_path", "range_start_line", "range_start_col")).alias("m"))
    return first.select("symbol_id", F.col("m.relative_path").alias("path"), F.col("m.range_start_line").alias("line"), F.col("m.range_start_col").alias("col"))


def x_document_symbols(s: SparkSession, d: str) -> DataFrame:
    found = c.occurrences(s, d).select("document_id", "symbol_id").distinct().groupBy("document_id").agg(F.count("*").alias("n_symbols"), F.min("symbol_id").alias("first_symbol"))
    return found.join(c.documents(s, d).select("document_id"), "document_id", "left_semi")


def a_occurrence_counts(s: SparkSession, d: str) -> DataFrame:
    n = c.occurrences(s, d).groupBy("document_id").agg(F.count("*").alias("n"))
    return c.documents(s, d).select("document_id", "occurrence_count").join(n, "document_id", "left").select("document_id", "occurrence_count", F.coalesce("n", F.lit(0)).cast("long").alias("counted"))


def p_kind_class(s: SparkSession, d: str) -> DataFrame:
    flags = [text.node_type("kind").alias("node_type"), text.is_function_kind("kind").alias("is_function"), text.is_declared_kind("kind").alias("is_declared"), text.is_container_kind("kind").alias("is_container")]
    return c.symbols(s, d).select(F.coalesce("kind", F.lit("")).alias("kind"), *flags).groupBy("kind", "node_type", "is_function", "is_declared", "is_container").agg(F.count("*").alias("n"))


def p_node_id(s: SparkSession, d: str) -> DataFrame:
    return c.symbols(s, d).select("symbol_id", text.node_id("symbol_id", text.node_type("kind")).alias("node_id"))


def p_code_filter(s: SparkSession, d: str) -> DataFrame:
    return c.documents(s, d).filter(text.is_code("relative_path", "language")).groupBy("repo").agg(F.count("*").alias("n"))


def p_language(s: SparkSession, d: str) -> DataFrame:
    return c.documents(s, d).select(text.language_of("relative_path", "language").alias("language")).groupBy("language").agg(F.count("*").alias("n"))


def p_test_path(s: SparkSession, d: str) -> DataFrame:
    """Test sources among the paths, each also as it would lie below a test folder and under test names."""
    base = c.documents(s, d).select(F.explode(F.array("relative_path", F.concat(F.lit("src/test/"), "relative_path"), F.concat(F.lit("a/src/test/"), "relative_path"), F.regexp_replace("relative_path", r"\.(\w+)$", "Test.$1"), F.regexp_replace("relative_path", r"\.(\w+)$", "_test.$1"), F.regexp_replace("relative_path", r"\.(\w+)$", "IT.$1"))).alias("path")).distinct()
    return base.filter(text.is_test_path("path"))


def p_test_symbol(s: SparkSession, d: str) -> DataFrame:
    base = c.symbols(s, d).select(F.explode(F.array("symbol_id", F.regexp_replace("symbol_id", r"\.java", "Tests.java"), F.concat(F.lit("x/src/test/"), "symbol_id"))).alias("symbol")).distinct()
    return base.filter(text.is_test_symbol("symbol"))


def p_path_suffix(s: SparkSession, d: str) -> DataFrame:
    """Documents whose path ends with the normalised last two segments of another repository's path."""
    docs = c.documents(s, d).select("document_id", "repo", F.regexp_replace(F.regexp_replace("relative_path", r"\\", "/"), r"^[./]+", "").alias("path"))
    tail = docs.select("repo", F.substring_index("path", "/", -2).alias("tail")).distinct().groupBy("tail").agg(F.count("*").alias("repos")).filter("repos > 1")
    return docs.withColumn("tail", F.substring_index("path", "/", -2)).join(tail, "tail").select("document_id", "tail", "repos")


def f_symbol_ids(s: SparkSession, d: str) -> DataFrame:
    return c.symbols(s, d).select("symbol_id", F.sha1(F.concat_ws("|", "symbol_id", "display_name", "kind")).alias("fingerprint"))


def f_path_prior(s: SparkSession, d: str) -> DataFrame:
    n = c.nodes(s, d).select("node_id", "path")
    e = c.edges(s, d).filter("edge_type = 'calls'").select("edge_id", "src_node", "dst_node")
    both = e.join(n.select(F.col("node_id").alias("src_node"), F.col("path").alias("p")), "src_node").join(n.select(F.col("node_id").alias("dst_node"), F.col("path").alias("q")), "dst_node")
    return both.filter("p is not null and q is not null").select("edge_id", text.path_prior("p", "q").alias("prior"))


QUERIES = {f.__name__: f for f in (
    q_find_entity_exact, q_find_entity_contains, q_find_entity_package, q_symbol_exact, j_def_of, a_refs_of, a_callers_of, a_callees_of, q_merge_ranked, q_intent_search,
    j_symbol_signature, w_first_definition, x_document_symbols, a_occurrence_counts, p_kind_class, p_node_id, p_code_filter, p_language, p_test_path, p_test_symbol, p_path_suffix, f_symbol_ids, f_path_prior,
)}

_SHOWN = ", ".join(f"coalesce({x}, '') as {x}" for x in ops._SHOWN)


def _cands(query: str, limit: int) -> str:
    low = query.lower()
    return bm25_sql("s", "symbol_id", "concat_ws(' ', display_name, package)", query) + f""",
      f1 as (select symbol_id, row_number() over (order by case when lower(display_name) = '{low}' then 0 else 1 end, length(display_name), symbol_id) as pos
        from s where lower(display_name) like '%{low}%' or lower(symbol_id) like '%{low}%' qualify pos <= {limit}),
      f2 as (select id as symbol_id, {limit} + row_number() over (order by score desc, id) as pos from bm qualify pos <= {2 * limit}),
      cand as (select s.*, pos from (select * from f1 union all select * from f2 where symbol_id not in (select symbol_id from f1)) x join s using (symbol_id))"""


def _near(a: str, b: str, pick: str = "busy") -> str:
    return f"""select t.symbol_id, max(e.confidence) as confidence, max(t.node_type) as node_type, min(t.path) as path from e join n p on p.node_id = e.{a} join n t on t.node_id = e.{b}
      where e.edge_type = 'calls' and p.symbol_id in (select symbol_id from {pick}) group by 1 order by confidence desc nulls last, symbol_id limit 25"""


_KIND = """case when k like '%package%' or k = 'module' then 'package' when k like '%annotation%' or k like '%interface%' then 'interface' when regexp_matches(k, 'constructor|method|function') then 'method'
  when regexp_matches(k, 'field|property|constant') then 'field' when regexp_matches(k, 'class|enum|struct|object|type') then 'class' else 'symbol' end"""
_SUFFIXES = ", ".join(f"'{x}'" for x in text.CODE_SUFFIXES)
_LANGUAGES = ", ".join(f"'{x}'" for x in text.CODE_LANGUAGES)
_TEST = "(" + " or ".join(f"contains(p, '{x}')" for x in text.TEST_FOLDERS) + ")"
_TEST_SYMBOL = "(" + " or ".join(f"contains(p, '{x}')" for x in text.TEST_SYMBOL_FOLDERS) + ")"

ORACLES = {
    "q_find_entity_exact": with_sql("s", f"select {_SHOWN} from (select * from s where lower(display_name) = 'run' or lower(symbol_id) = 'run' order by length(display_name), symbol_id limit 50) where kind in ('Method', 'StaticMethod', 'AbstractMethod')"),
    "q_find_entity_contains": with_sql("s", f"select {_SHOWN} from cand where kind in ('Class', 'Interface', 'Enum', 'Record', 'Annotation') order by pos limit 50", _cands("Lexer", 100)),
    "q_find_entity_package": with_sql("s", f"select {_SHOWN} from cand where contains(lower(coalesce(package, '')), 'lodestone') or contains(lower(symbol_id), 'lodestone') order by pos limit 20", _cands("cache", 100)),
    "q_symbol_exact": with_sql("s", f"""select symbol_id, score from (select symbol_id, case when contains(h, '{_Q}') then case when lower(display_name) = '{_Q}' then 4.0 else 2.0 end else {" + ".join(f"contains(h, '{t}')::double" for t in _Q.split())} end::double as score
        from (select *, concat_ws(' ', lower(display_name), lower(symbol_id)) as h from cand)) where score > 0 order by score desc, symbol_id desc limit 10""", _cands(_Q, 80)),
    "j_def_of": with_sql("d o top", "select concat_ws(':', o.document_id, o.range_start_line, o.range_start_col) as result_id, o.symbol_id, o.document_id, d.relative_path as path, o.range_start_line as start_line, o.range_start_col as start_col from o join d using (document_id) where o.role = 'definition' and o.symbol_id in (select symbol_id from top) order by 3, 5, 6, 1 limit 50"),
    "a_refs_of": with_sql("d o top", "select o.document_id, count(*) as reference_count, count(*) filter (role = 'reference') as explicit_count, count(*) filter (role = 'unknown') as inferred_count, d.relative_path as path from o join d using (document_id) where role <> 'definition' and symbol_id in (select symbol_id from top) group by 1, 5 order by 2 desc, 1 limit 50"),
    "a_callers_of": with_sql("n e busy", _near("dst_node", "src_node")),
    "a_callees_of": with_sql("n e caller", _near("src_node", "dst_node", "caller")),
    "q_merge_ranked": with_sql("n e busy caller", f"select symbol_id as result_id, max(confidence) as score from ((select * from ({_near('dst_node', 'src_node')})) union all (select * from ({_near('src_node', 'dst_node', 'caller')}))) group by 1 order by 2 desc nulls last, 1 desc limit 30"),
    "q_intent_search": with_sql("n i", f"""select * from (select i.node_id, i.quality_score, (case when contains(lower(intent_text), '{_INTENT}') then 2.0 else 0.0 end + {" + ".join(f"contains(lower(coalesce(intent_text, '')), '{t}')::double" for t in _INTENT.split())})::double as score, n.path
      from i join n on n.node_id = i.node_id) where score > 0 order by score desc, quality_score desc nulls last, node_id limit 20"""),
    "j_symbol_signature": with_sql("s n o", "select s.symbol_id, coalesce(m.signature, s.display_name) as signature, f.c as n_definitions from s join (select symbol_id, count(*) as c from o where role = 'definition' group by 1) f using (symbol_id) left join (select symbol_id, max(signature) as signature from n group by 1) m on m.symbol_id = s.symbol_id"),
    "w_first_definition": with_sql("d o", "select symbol_id, relative_path as path, range_start_line as line, range_start_col as col from (select o.*, d.relative_path, row_number() over (partition by symbol_id order by relative_path, range_start_line, range_start_col) as rn from o join d using (document_id) where role = 'definition') where rn = 1"),
    "x_document_symbols": with_sql("d o", "select document_id, count(distinct symbol_id) as n_symbols, min(symbol_id) as first_symbol from o where document_id in (select document_id from d) group by 1"),
    "a_occurrence_counts": with_sql("d o", "select d.document_id, d.occurrence_count, coalesce(x.c, 0) as counted from d left join (select document_id, count(*) as c from o group by 1) x using (document_id)"),
    "p_kind_class": with_sql("s", f"""select kind, {_KIND} as node_type, regexp_matches(k, 'constructor|method') or (contains(k, 'function') and not contains(k, 'interface')) as is_function,
      regexp_matches(k, 'constructor|method|function|class|interface|annotation|enum|record|type|field|property|constant') as is_declared, regexp_matches(k, 'class|interface|enum|record|annotation') as is_container, count(*) as n
      from (select coalesce(kind, '') as kind, lower(coalesce(kind, '')) as k from s) group by 1, 2, 3, 4, 5"""),
    "p_node_id": with_sql("s", f"""select symbol_id, case when t = 'package' and starts_with(symbol_id, 'pkg:') then symbol_id else case when t = 'package' then 'pkg' when t in ('class', 'interface') then 'type' when t in ('method', 'field') then t else 'sym' end || ':' || symbol_id end as node_id
      from (select symbol_id, {_KIND} as t from (select symbol_id, lower(coalesce(kind, '')) as k from s))"""),
    "p_code_filter": with_sql("d", f"select repo, count(*) as n from d where lower(regexp_extract(coalesce(relative_path, ''), '\\.([^./]+)$', 1)) in ({_SUFFIXES}) or lower(coalesce(language, '')) in ({_LANGUAGES}) group by 1"),
    "p_language": with_sql("d", "select case when trim(coalesce(language, '')) <> '' then language when p like '%.java' then 'java' when regexp_matches(p, '\\.kts?$') then 'kotlin' when p like '%.scala' then 'scala' when regexp_matches(p, '\\.(cc|cpp|cxx|hpp|hh|h)$') then 'cpp' else '' end as language, count(*) as n from (select language, lower(coalesce(relative_path, '')) as p from d) group by 1"),
    "p_test_path": with_sql("d", f"""select path from (select path, lower(path) as p, split_part(lower(path), '/', -1) as b, split_part(path, '/', -1) as own, regexp_replace(split_part(lower(path), '/', -1), '\\.(java|kt)$', '') as st from
      (select distinct unnest([relative_path, 'src/test/' || relative_path, 'a/src/test/' || relative_path, regexp_replace(relative_path, '\\.(\\w+)$', 'Test.\\1'), regexp_replace(relative_path, '\\.(\\w+)$', '_test.\\1'), regexp_replace(relative_path, '\\.(\\w+)$', 'IT.\\1')]) as path from d))
      where {_TEST} or (starts_with(p, 'test/') and not contains(p, '/src/')) or b like '%\\_test.go' escape '\\' or (starts_with(b, 'test_') and b like '%.py') or b like '%\\_test.py' escape '\\'
      or (regexp_matches(b, '\\.(java|kt)$') and (regexp_matches(own, '(IT|ITCase)\\.java$') or regexp_matches(st, '^.+tests$') or (regexp_matches(st, '^.+test$') and not st like '%latest') or regexp_matches(st, '^test.+$')))"""),
    "p_test_symbol": with_sql("s", f"""select symbol from (select symbol, p, regexp_replace(split_part(split_part(p, '/', -1), '#', 1), '\\.[^.]*$', '') as st from (select symbol, lower(symbol) as p from
      (select distinct unnest([symbol_id, regexp_replace(symbol_id, '\\.java', 'Tests.java', 'g'), 'x/src/test/' || symbol_id]) as symbol from s))) where {_TEST_SYMBOL} or (length(st) >= 5 and regexp_matches(st, '(tests?$)|(^test.)'))"""),
    "p_path_suffix": with_sql("d", """select document_id, tail, repos from (select document_id, array_to_string(string_split(path, '/')[-2:], '/') as tail from x) join
      (select tail, count(*) as repos from (select distinct repo, array_to_string(string_split(path, '/')[-2:], '/') as tail from x) group by 1 having count(*) > 1) using (tail)""", "x as (select document_id, repo, regexp_replace(relative_path, '^[./]+', '') as path from d)"),
    "f_symbol_ids": with_sql("s", "select symbol_id, sha1(concat_ws('|', symbol_id, display_name, kind)) as fingerprint from s"),
    "f_path_prior": with_sql("n e", "select e.edge_id, least(1.0, len(list_filter(range(1, 1 + least(len(a), len(b))), lambda k: a[1:k] = b[1:k])) / 4.0)::double as prior from (select e.edge_id, string_split(p.path, '/') as a, string_split(q.path, '/') as b from e join n p on p.node_id = e.src_node join n q on q.node_id = e.dst_node where e.edge_type = 'calls') e where a is not null and b is not null"),
}
