"""Queries of line spans, chunks, evaluation metrics and table upkeep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gneiss.operators import catalog, chunking, code_chunks, evaluation, graph, text, upkeep
from gneiss.plans import canonical as c
from gneiss.plans.canonical import with_sql
from gneiss.plans.tables import table
from gneiss.sources import records


def _definitions(s: SparkSession, d: str) -> DataFrame:
    """(document_id, id, symbol_id, start, end, max_line) of the definitions in current documents."""
    start, end, _ = chunking.effective_span()
    o = c.occurrences(s, d).filter("role = 'definition'").join(c.documents(s, d).select("document_id"), "document_id", "left_semi")
    spans = o.select("document_id", "id", "symbol_id", start.alias("start"), end.alias("end"))
    return spans.withColumn("max_line", F.max("end").over(Window.partitionBy("document_id")))


def p_effective_span(s: SparkSession, d: str) -> DataFrame:
    start, end, use = chunking.effective_span()
    return c.occurrences(s, d).select("id", start.alias("start"), end.alias("end"), use.alias("enclosed"))


def w_expand_spans(s: SparkSession, d: str) -> DataFrame:
    return chunking.to_next_sibling(_definitions(s, d), ["document_id"])


def w_definition_spans(s: SparkSession, d: str) -> DataFrame:
    return chunking.definition_spans(_definitions(s, d))


def w_merge_intervals(s: SparkSession, d: str) -> DataFrame:
    return chunking.merge_intervals(_definitions(s, d), ["document_id"])


def w_gaps(s: SparkSession, d: str) -> DataFrame:
    defs = _definitions(s, d)
    ranges = defs.groupBy("document_id").agg(F.lit(0).alias("lo"), (F.max("end") + 10).alias("hi"))
    return chunking.gaps(ranges, defs.select("document_id", "start", "end"), ["document_id"])


def j_container_anti(s: SparkSession, d: str) -> DataFrame:
    return chunking.leaf_preferred(_definitions(s, d)).select("document_id", "id", "start", "end")


def j_point_in_interval(s: SparkSession, d: str) -> DataFrame:
    from gneiss.operators.symbols import innermost

    o = c.occurrences(s, d)
    points = o.filter("role <> 'definition'").select("document_id", F.col("id").alias("point_id"), F.col("range_start_line").alias("line"), F.col("range_start_col").alias("col"))
    p = "enclosing_range_"
    spans = o.filter(f"role = 'definition' and {p}start_line >= 0").select("document_id", F.col("id").alias("span_id"), F.col(f"{p}start_line").alias("sl"), F.col(f"{p}start_col").alias("sc"), F.col(f"{p}end_line").alias("el"), F.col(f"{p}end_col").alias("ec"))
    return innermost(points, spans)


def c_split(s: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_documents(c.documents(s, d))


def c_split_exact(s: SparkSession, d: str) -> DataFrame:
    """Chunks without overlap hold every line once: token sums agree with the documents'."""
    chunks = chunking.chunk_documents(c.documents(s, d), overlap=0).groupBy("document_id").agg(F.sum("n_tokens").alias("n_tokens"))
    return chunks


def w_pack_siblings(s: SparkSession, d: str) -> DataFrame:
    defs = _definitions(s, d).join(c.symbols(s, d).select("symbol_id", "enclosing_symbol", "kind"), "symbol_id").filter(text.is_function_kind("kind"))
    # Tokens of the lines of each span, at least one per line.
    costs = F.transform(F.split("content", "\n", -1), lambda x: F.greatest(F.lit(1), text.heuristic_tokens(x)))
    lined = c.documents(s, d).filter("content <> ''").select("document_id", costs.alias("costs"))
    inside = F.slice("costs", F.col("start") + 1, F.greatest(F.lit(0), F.col("end") - F.col("start") + 1))
    sized = defs.join(lined, "document_id").select("document_id", F.coalesce("enclosing_symbol", F.lit("")).alias("enclosing_symbol"), "symbol_id", "start", "end", F.aggregate(inside, F.lit(0), lambda a, x: a + x).alias("n_tokens"))
    return chunking.packed_functions(sized)


def _contexts(s: SparkSession, d: str) -> DataFrame:
    sym, o, docs, n, e = c.symbols(s, d), c.occurrences(s, d), c.documents(s, d), c.nodes(s, d), c.edges(s, d)
    return code_chunks.symbol_contexts(sym, o, docs, n, e, chunking.caller_labels(e, n, sym))


def c_code_chunks(s: SparkSession, d: str) -> DataFrame:
    return code_chunks.code_chunks(c.documents(s, d), c.occurrences(s, d), c.symbols(s, d), _contexts(s, d)).withColumn("primary_symbols", F.array_join("primary_symbols", "|"))


def c_contexts(s: SparkSession, d: str) -> DataFrame:
    ctx = _contexts(s, d)
    return ctx.select(*(F.array_join(x, ",").alias(x) if t.startswith("array") else F.col(x) for x, t in ctx.dtypes))


def c_symbol_cards(s: SparkSession, d: str) -> DataFrame:
    return code_chunks.symbol_card_chunks(c.symbols(s, d), _contexts(s, d))


def c_cards(s: SparkSession, d: str) -> DataFrame:
    sym = c.symbols(s, d)
    return chunking.symbol_cards(sym, chunking.caller_labels(c.edges(s, d), c.nodes(s, d), sym))


def c_call_context(s: SparkSession, d: str) -> DataFrame:
    return chunking.caller_labels(c.edges(s, d), c.nodes(s, d), c.symbols(s, d)).select("symbol_id", F.array_join("callers", ",").alias("callers"))


def _chunks(s: SparkSession, d: str) -> DataFrame:
    return c.documents(s, d).select(F.concat("document_id", F.lit(":doc:p1")).alias("chunk_id"), "document_id", "content")


def j_missing_embeddings(s: SparkSession, d: str) -> DataFrame:
    from gneiss.operators import vectors

    e = table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return vectors.missing(table(s, d, "documents").select("doc_id"), e, "doc_id")


# Evaluation: every repository asks for its languages; ranked are its documents by occurrence count, relevant those of the asked language.


def _ranked(s: SparkSession, d: str) -> DataFrame:
    docs = c.documents(s, d).filter("repo is not null")
    w = Window.partitionBy("query_id").orderBy(F.desc("occurrence_count"), "result_id")
    return docs.select(F.col("repo").alias("query_id"), F.col("document_id").alias("result_id"), "occurrence_count").withColumn("rank", F.row_number().over(w)).select("query_id", "result_id", "rank")


def _relevant(s: SparkSession, d: str) -> DataFrame:
    return c.documents(s, d).filter("repo is not null and lower(trim(language)) in ('java', 'rust')").select(F.col("repo").alias("query_id"), F.col("document_id").alias("result_id"))


def e_metrics(s: SparkSession, d: str) -> DataFrame:
    return evaluation.per_query(_ranked(s, d), _relevant(s, d))


def e_summary(s: SparkSession, d: str) -> DataFrame:
    m = evaluation.per_query(_ranked(s, d), _relevant(s, d)).withColumn("owner", F.substring_index("query_id", "/", 1)).withColumn("initial", F.substring("query_id", 1, 1))
    return evaluation.summary(m, ["owner", "initial"])


def e_first_units(s: SparkSession, d: str) -> DataFrame:
    r = _ranked(s, d).join(c.documents(s, d).select(F.col("document_id").alias("result_id"), F.col("relative_path").alias("unit")), "result_id")
    return evaluation.first_units(r.filter("rank <= 20"))


def e_union(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy("result_id")
    other = _ranked(s, d).withColumn("rank", F.row_number().over(w))
    return evaluation.union_of([_ranked(s, d), other]).filter("rank <= 5")


def e_missing_gold(s: SparkSession, d: str) -> DataFrame:
    return evaluation.missing_gold(_relevant(s, d), _ranked(s, d).filter("rank <= 10"))


def a_p95(s: SparkSession, d: str) -> DataFrame:
    return evaluation.lower_percentile(table(s, d, "events"), "event_type", "value", 0.95)


def q_grep(s: SparkSession, d: str) -> DataFrame:
    return evaluation.grep(c.documents(s, d), r"(?i)lexer\w*\(")


# Sources and upkeep.


def s_ndjson_split(s: SparkSession, d: str) -> DataFrame:
    """Documents written as index lines and parsed back, with lines that are no records between them."""
    docs = c.documents(s, d).filter("relative_path is not null")
    lines = docs.select(F.to_json(F.struct(F.lit("document").alias("type"), "relative_path", "language", "occurrence_count", "content", "repo", "commit_hash")).alias("value"))
    broken = docs.select(F.concat(F.lit("{broken "), "document_id").alias("value")).unionByName(docs.select(F.lit("").alias("value")))
    parsed = records.parse_lines(lines.unionByName(broken))
    return records.of_type(parsed, "document").groupBy("language").agg(F.count("*").alias("n"), F.sum("occurrence_count").alias("occurrences"), F.sum(F.length("content")).alias("chars"))


def s_upsert_last_wins(s: SparkSession, d: str) -> DataFrame:
    return catalog.current_symbols(table(s, d, "symbols")).select("symbol_id", "display_name", "kind", "enclosing_symbol")


def s_upsert_tables(s: SparkSession, d: str) -> DataFrame:
    sym = table(s, d, "symbols").filter("symbol_id is not null").select("symbol_id", "kind")
    old = sym.filter("kind = 'Method'").distinct()
    new = sym.filter("symbol_id like 'ts:%'").select("symbol_id", F.lit("replaced").alias("kind")).distinct()
    return upkeep.upsert(old, new, ["symbol_id"])


def s_insert_or_ignore(s: SparkSession, d: str) -> DataFrame:
    e = c.edges(s, d)
    return upkeep.insert_or_ignore(e.filter("edge_type = 'calls'").select("edge_id", F.lit("old").alias("origin")), e.filter("weight >= 0.5").select("edge_id", F.lit("new").alias("origin")), ["edge_id"])


def s_delete_snapshot(s: SparkSession, d: str) -> DataFrame:
    ch = _chunks(s, d).join(c.documents(s, d).select("document_id", "repo", "commit_hash"), "document_id")
    doomed = ch.groupBy("repo", "commit_hash").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "repo", "commit_hash").limit(1)
    return upkeep.delete_where(ch, doomed, ["repo", "commit_hash"]).select("chunk_id", "repo")


def s_purge_choice(s: SparkSession, d: str) -> DataFrame:
    """For the largest snapshot and for the table cut down to it."""
    ch = _chunks(s, d)
    top = c.documents(s, d).filter("repo is not null and commit_hash is not null").groupBy("repo", "commit_hash").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "repo", "commit_hash").first()
    own = ch.filter(F.col("document_id").startswith(f"{top['repo']}:{top['commit_hash']}:"))
    return upkeep.purge_choice(ch, top["repo"], top["commit_hash"]).select(F.lit("all").alias("chunks"), "choice").unionByName(upkeep.purge_choice(own, top["repo"], top["commit_hash"]).select(F.lit("snapshot").alias("chunks"), "choice"))


def s_table_counts(s: SparkSession, d: str) -> DataFrame:
    return upkeep.table_counts({n: table(s, d, n) for n in ("documents", "symbols", "occurrences", "code_nodes", "code_edges")})


def s_smoke_symbol(s: SparkSession, d: str) -> DataFrame:
    return upkeep.smoke_symbol(c.symbols(s, d))


def s_targets(s: SparkSession, d: str) -> DataFrame:
    m = table(s, d, "documents").filter("repo is not null").select(F.col("repo"), F.col("commit_hash").alias("base_sha"), F.col("source").alias("id"))
    return upkeep.targets(m)


def s_ports(s: SparkSession, d: str) -> DataFrame:
    return upkeep.ports(c.documents(s, d).filter("repo is not null and commit_hash is not null").select(upkeep.slug("repo", "commit_hash").alias("slug")), 9100)


def s_job_states(s: SparkSession, d: str) -> DataFrame:
    return upkeep.job_states(table(s, d, "events")).withColumn("last_ts", F.date_format("last_ts", "yyyy-MM-dd HH:mm:ss"))


def s_meta_json(s: SparkSession, d: str) -> DataFrame:
    """Nodes per snapshot and kind out of their JSON metadata."""
    meta = F.from_json("meta_json", "repo string, commit string, symbol_kind string")
    return c.nodes(s, d).select(meta.alias("m")).groupBy(F.col("m.repo").alias("repo"), F.col("m.symbol_kind").alias("symbol_kind")).agg(F.count("*").alias("n"))


def s_degree_refresh(s: SparkSession, d: str) -> DataFrame:
    """Nodes with the stated degrees replaced by counted ones; how many changed."""
    deg = graph.degrees(c.nodes(s, d), c.edges(s, d)).withColumnRenamed("fan_in", "new_in")
    j = c.nodes(s, d).select("node_id", "fan_in").join(deg, "node_id")
    return j.agg(F.count("*").alias("n_nodes"), F.sum((~F.col("fan_in").cast("long").eqNullSafe(F.col("new_in"))).cast("long")).alias("n_changed"))


QUERIES = {f.__name__: f for f in (
    p_effective_span, w_expand_spans, w_definition_spans, w_merge_intervals, w_gaps, j_container_anti, j_point_in_interval, c_split, c_split_exact, w_pack_siblings, c_code_chunks, c_contexts, c_symbol_cards, c_cards, c_call_context, j_missing_embeddings,
    e_metrics, e_summary, e_first_units, e_union, e_missing_gold, a_p95, q_grep, s_ndjson_split, s_upsert_last_wins, s_upsert_tables, s_insert_or_ignore, s_delete_snapshot, s_purge_choice, s_table_counts,
    s_smoke_symbol, s_targets, s_ports, s_job_states, s_meta_json, s_degree_refresh,
)}

_USE = "coalesce(enclosing_range_start_line >= 0 and enclosing_range_end_line > enclosing_range_start_line, false)"
_START, _END = f"case when {_USE} then enclosing_range_start_line else range_start_line end", f"case when {_USE} then enclosing_range_end_line else range_end_line end"
_DEFS = f'df as (select document_id, id, symbol_id, {_START} as start, {_END} as "end", max({_END}) over (partition by document_id) as max_line from o where role = \'definition\' and document_id in (select document_id from d))'
_MERGED = """mi_a as (select document_id, least(start, "end") as s, greatest(start, "end") as e from df where start <> "end"),
  mi_b as (select *, case when max(e) over (partition by document_id order by s, e rows between unbounded preceding and 1 preceding) >= s then 0 else 1 end as new from mi_a),
  mi_c as (select *, sum(new) over (partition by document_id order by s, e rows unbounded preceding) as island from mi_b), mi as (select document_id, min(s) as start, max(e) as "end" from mi_c group by document_id, island)"""
_EVAL = """rk as (select repo as query_id, document_id as result_id, row_number() over (partition by repo order by occurrence_count desc, document_id) as rank from d where repo is not null),
  rel as (select distinct repo as query_id, document_id as result_id from d where repo is not null and lower(trim(language)) in ('java', 'rust')),
  pq as (select z.query_id, (coalesce(h, 0) > 0)::int::double as hit, round(coalesce(h, 0) / n, 6) as recall, round(coalesce(h, 0) / 10.0::double, 6) as precision, round(coalesce(1.0::double / first, 0), 6) as mrr,
    round(coalesce(dcg, 0) / list_sum(list_transform(range(1, 1 + least(n, 10)), lambda i: 1.0::double / log2(i + 1))), 6) as ndcg
    from (select query_id, count(*) as n from rel group by 1) z left join (select rk.query_id, count(rel.result_id) as h, min(case when rel.result_id is not null then rank end) as first, sum(case when rel.result_id is not null then 1.0::double / log2(rank + 1) else 0 end) as dcg
      from rk left join rel using (query_id, result_id) where rank <= 10 group by 1) y using (query_id))"""
_MEANS = "count(*) as n, round(avg(hit), 6) as hit, round(avg(recall), 6) as recall, round(avg(precision), 6) as precision, round(avg(mrr), 6) as mrr, round(avg(ndcg), 6) as ndcg"
_CALLERS = """cl as (select symbol_id, list(caller order by caller)[1:8] as callers from (select distinct q.symbol_id, p.display_name as caller from e
  join (select node_id, display_name from n join s using (symbol_id)) p on p.node_id = e.src_node join (select node_id, symbol_id from n where symbol_id in (select symbol_id from s)) q on q.node_id = e.dst_node where e.edge_type = 'calls') where caller is not null group by 1)"""

_COSTS = r"""lc as (select document_id, string_split(content, chr(10)) as l, list_transform(string_split(content, chr(10)), lambda x: greatest(1, len(regexp_extract_all(x, '[\p{L}\p{N}\p{M}_]+|[^\p{L}\p{N}\p{M}_\s]')))) as k from d where content <> '')"""
_SPLIT = _COSTS + """, cum as (select document_id, l, k, list_concat([0], list_transform(range(1, len(k) + 1), lambda i: list_sum(k[1:i])::bigint)) as c from lc),
  cut as (select document_id, 0::bigint as i, 0::bigint as j, 0 as p from cum union all
    select document_id, nxt, greatest(nxt + 1, len(list_filter(c, lambda x: x <= c[nxt + 1] + 256)) - 1), p + 1 from (select cut.document_id, c, p, case when p = 0 then 0 else greatest(i + 1, len(list_filter(c[1:j + 1], lambda x: x < c[j + 1] - 32))) end as nxt from cut join cum using (document_id) where p = 0 or j < len(k)))"""

ORACLES = {
    "c_split": with_sql("d", """select document_id || ':doc:p' || p as chunk_id, document_id, p as part, (i + 1)::int as start_line, j::int as end_line, list_sum(k[i + 1:j])::int as n_tokens, array_to_string(l[i + 1:j], chr(10)) as content from cut join cum using (document_id) where p > 0""", _SPLIT, True),
    "c_contexts": with_sql("d s o n e", """select s.symbol_id, p.path, s.package, s.kind, ow.display_name as owner, s.display_name as signature, coalesce(an, '') as annotations, coalesce(ex, '') as "extends", coalesce(im, '') as implements, coalesce(ft, '') as field_type, coalesce(cl, '') as incoming_calls
      from s left join (select symbol_id, min(struct_pack(l := range_start_line, p := relative_path)).p as path from o join d using (document_id) where role = 'definition' group by 1) p on p.symbol_id = s.symbol_id left join s ow on ow.symbol_id = s.enclosing_symbol left join ty on ty.symbol_id = s.symbol_id left join ca on ca.symbol_id = s.symbol_id""",
      """nm as (select n.node_id, s.symbol_id, s.display_name from n join s using (symbol_id)), re as (select distinct a.symbol_id, edge_type, b.display_name as name from e join nm a on a.node_id = src_node join nm b on b.node_id = dst_node),
      ty as (select symbol_id, string_agg(case when edge_type = 'annotated_with' then '@' || name end, ',' order by name) as an, string_agg(case when edge_type = 'extends' then name end, ',' order by name) as ex,
        string_agg(case when edge_type = 'implements' then name end, ',' order by name) as im, string_agg(case when edge_type = 'field_type' then name end, ',' order by name) as ft from re group by 1),
      ca as (select symbol_id, string_agg(name, ',' order by name) as cl from (select *, row_number() over (partition by symbol_id order by name) as r from (select distinct b.symbol_id, a.display_name as name from e join nm a on a.node_id = src_node join nm b on b.node_id = dst_node where edge_type = 'calls')) where r <= 8 group by 1)"""),
    "w_pack_siblings": with_sql("d s o", "select document_id, enc as enclosing_symbol, pack::int as pack, symbol_id from st", _COSTS + """,
      fs as (select distinct o.document_id, coalesce(s.enclosing_symbol, '') as enc, o.symbol_id, case when enclosing_range_start_line >= 0 and enclosing_range_end_line > enclosing_range_start_line then enclosing_range_start_line else range_start_line end as a,
        case when enclosing_range_start_line >= 0 and enclosing_range_end_line > enclosing_range_start_line then enclosing_range_end_line else range_end_line end as b, o.id from o join s using (symbol_id) where role = 'definition' and (regexp_matches(lower(coalesce(kind, '')), 'constructor|method') or (contains(lower(coalesce(kind, '')), 'function') and not contains(lower(coalesce(kind, '')), 'interface')))),
      fz as (select fs.*, coalesce(list_sum(k[a + 1:b + 1]), 0)::bigint as n from fs join lc using (document_id)),
      fr as (select *, row_number() over (partition by document_id, enc order by a, b, n, symbol_id) as rn from fz),
      st as (select document_id, enc, rn, symbol_id, b, n as held, n <= 60 as is_open, 0 as pack from fr where rn = 1 union all
        select document_id, enc, rn, symbol_id, b, case when n > 60 then 0 when joins then held + n else n end, n <= 60, case when joins then pack else pack + 1 end
          from (select fr.*, st.held, st.pack, st.is_open and fr.n <= 60 and fr.a - st.b <= 3 and st.held < 160 as joins from st join fr on fr.document_id = st.document_id and fr.enc = st.enc and fr.rn = st.rn + 1))""", True),
    "p_effective_span": with_sql("o", f'select id, {_START} as start, {_END} as "end", {_USE} as enclosed from o'),
    "w_expand_spans": with_sql("d o", 'select document_id, id, start, greatest("end", case when nx is null then max_line else greatest(start, nx - 1) end) as "end" from (select *, lead(start) over (partition by document_id order by start, id) as nx from df)', _DEFS),
    "w_definition_spans": with_sql("d o", 'select document_id, id, start, coalesce(nx, max_line + 1) as "end" from (select *, lead(start) over (partition by document_id order by start, id) as nx from df) where coalesce(nx, max_line + 1) > start', _DEFS),
    "w_merge_intervals": with_sql("d o", 'select document_id, start, "end" from mi', f"{_DEFS}, {_MERGED}"),
    "w_gaps": with_sql("d o", """select document_id, "end" as start, coalesce(lead(start) over (partition by document_id order by start), hi) as "end" from mi join rg using (document_id) qualify coalesce(lead(start) over (partition by document_id order by start), hi) > mi."end"
      union all select document_id, 0, coalesce(f, hi) from rg left join (select document_id, min(start) as f from mi group by 1) using (document_id) where coalesce(f, hi) > 0""", f"{_DEFS}, {_MERGED}, rg as (select document_id, max(\"end\") + 10 as hi from df group by 1)"),
    "j_container_anti": with_sql("d o", 'select document_id, id, start, "end" from df a where not exists (select 1 from df b where a.document_id = b.document_id and a.start <= b.start and a."end" >= b."end" and (a.start < b.start or a."end" > b."end"))', _DEFS),
    "j_point_in_interval": with_sql("o", """select document_id, point_id, span_id, extent from (select p.document_id, p.id as point_id, w.id as span_id, (w.el - w.sl)::bigint * 1000000 + (w.ec - w.sc) as extent, row_number() over (partition by p.document_id, p.id order by (w.el - w.sl)::bigint * 1000000 + (w.ec - w.sc), w.sl, w.sc, w.id) as rn
      from (select document_id, id, range_start_line as line, range_start_col as col from o where role <> 'definition') p join (select document_id, id, enclosing_range_start_line as sl, enclosing_range_start_col as sc, enclosing_range_end_line as el, enclosing_range_end_col as ec from o where role = 'definition' and enclosing_range_start_line >= 0) w
      on p.document_id = w.document_id and (p.line > w.sl or (p.line = w.sl and p.col >= w.sc)) and (p.line < w.el or (p.line = w.el and p.col <= w.ec))) where rn = 1"""),
    "c_split_exact": with_sql("d", r"select document_id, list_sum(list_transform(string_split(content, chr(10)), lambda l: greatest(1, len(regexp_extract_all(l, '[\p{L}\p{N}\p{M}_]+|[^\p{L}\p{N}\p{M}_\s]')))))::bigint as n_tokens from d where coalesce(content, '') <> ''"),
    "c_cards": with_sql("s n e", """select 'symbol_card:' || symbol_id as chunk_id, symbol_id, concat_ws(chr(10), 'content_type: symbol_card', case when coalesce(package, '') <> '' then 'package: ' || package end, case when coalesce(kind, '') <> '' then 'kind: ' || kind end,
      case when coalesce(display_name, '') <> '' then 'symbol: ' || display_name end, case when coalesce(owner, '') <> '' then 'owner: ' || owner end, case when len(callers) > 0 then 'incoming_calls: ' || array_to_string(callers, ', ') end) as content
      from (select s.*, p.display_name as owner, cl.callers from s left join s p on p.symbol_id = s.enclosing_symbol left join cl on cl.symbol_id = s.symbol_id)
      where regexp_matches(lower(coalesce(kind, '')), 'constructor|method|function|class|interface|annotation|enum|record|type|field|property|constant')""", _CALLERS),
    "c_call_context": with_sql("s n e", "select symbol_id, array_to_string(callers, ',') as callers from cl", _CALLERS),
    "j_missing_embeddings": "select doc_id from documents where doc_id not in (select vec_id from embeddings)",
    "e_metrics": with_sql("d", "select * from pq", _EVAL),
    "e_summary": with_sql("d", f"select 'all' as facet, '' as value, {_MEANS} from pq union all select 'owner', split_part(query_id, '/', 1), {_MEANS} from pq group by 2 union all select 'initial', query_id[1:1], {_MEANS} from pq group by 2", _EVAL),
    "e_first_units": with_sql("d", "select query_id, relative_path as unit, min(rank)::int as rank from rk join d on d.document_id = rk.result_id where rank <= 20 group by 1, 2", _EVAL),
    "e_union": with_sql("d", "select query_id, result_id, min(rank)::int as rank from (select * from rk union all select query_id, result_id, row_number() over (partition by query_id order by result_id) from rk) group by 1, 2 having min(rank) <= 5", _EVAL),
    "e_missing_gold": with_sql("d", "select query_id, result_id from rel where (query_id, result_id) not in (select (query_id, result_id) from rk where rank <= 10)", _EVAL),
    "a_p95": "select event_type, value from (select event_type, value, row_number() over (partition by event_type order by value) - 1 as i, count(*) over (partition by event_type) as n from events where value is not null) where i = floor(0.95 * (n - 1))",
    "q_grep": with_sql("d", "select relative_path, row_number() over (order by relative_path)::int as rank from (select distinct relative_path from d where regexp_matches(content, '(?i)lexer\\w*\\('))"),
    "s_ndjson_split": with_sql("d", "select coalesce(language, '') as language, count(*) as n, sum(coalesce(occurrence_count, 0))::bigint as occurrences, sum(length(coalesce(content, '')))::bigint as chars from d where relative_path is not null group by 1"),
    "s_upsert_last_wins": with_sql("s", "select symbol_id, display_name, kind, enclosing_symbol from s"),
    "s_upsert_tables": "with b as (select distinct symbol_id, 'replaced' as kind from symbols where symbol_id like 'ts:%') select distinct symbol_id, kind from symbols where kind = 'Method' and symbol_id is not null and symbol_id not in (select symbol_id from b) union all select * from b",
    "s_insert_or_ignore": with_sql("e", "select edge_id, 'old' as origin from e where edge_type = 'calls' union all select edge_id, 'new' from e where weight >= 0.5 and edge_id not in (select edge_id from e where edge_type = 'calls')"),
    "s_delete_snapshot": with_sql("d", "select document_id || ':doc:p1' as chunk_id, repo from d left join (select repo, commit_hash, 1 as hit from d group by 1, 2 order by count(*) desc, 1, 2 limit 1) x using (repo, commit_hash) where x.hit is null"),
    "s_purge_choice": with_sql("d", "select 'all' as chunks, case when count(*) filter (not starts_with(document_id, (select p from t))) > 0 then 'delete_prefix' else 'drop_table' end as choice from d union all select 'snapshot', case when count(*) filter (not starts_with(document_id, (select p from t))) > 0 then 'delete_prefix' else 'drop_table' end from d where starts_with(document_id, (select p from t))",
      "t as (select repo || ':' || commit_hash || ':' as p from (select repo, commit_hash, count(*) as n from d where repo is not null and commit_hash is not null group by 1, 2 order by n desc, repo, commit_hash limit 1))"),
    "s_table_counts": " union all ".join(f"select '{n}' as table_name, count(*) as n_rows from {n}" for n in ("documents", "symbols", "occurrences", "code_nodes", "code_edges")),
    "s_smoke_symbol": with_sql("s", "select symbol_id, display_name from s where display_name <> '<init>' order by length(display_name) desc, display_name, symbol_id limit 1"),
    "s_targets": "select repo, commit_hash as base_sha, count(*) as n_samples, array_to_string(list_sort(list_distinct(list(source))), ',') as sample_ids from documents where repo is not null group by 1, 2",
    "s_ports": with_sql("d", "select slug, (row_number() over (order by slug) - 1 + 9100)::int as port from (select distinct regexp_replace(regexp_replace(lower(trim(repo)), '[^a-z0-9]+', '-', 'g'), '(^-+|-+$)', '', 'g') || '-' || lower(commit_hash)[1:8] as slug from d where repo is not null and commit_hash is not null)"),
    "s_job_states": "select user_id, last_type, strftime(last_ts, '%Y-%m-%d %H:%M:%S') as last_ts, n_errors from (select user_id, arg_max(event_type, (ts, event_id)) as last_type, max(ts) as last_ts, count(*) filter (event_type = 'error') as n_errors from events group by 1)",
    "s_meta_json": with_sql("n", "select json_extract_string(meta_json, '$.repo') as repo, json_extract_string(meta_json, '$.symbol_kind') as symbol_kind, count(*) as n from n group by 1, 2"),
    "s_degree_refresh": with_sql("n e", "select count(*) as n_nodes, count(*) filter (n.fan_in is distinct from coalesce(x.c, 0)) as n_changed from n left join (select dst_node, count(*) as c from e group by 1) x on x.dst_node = n.node_id"),
}
