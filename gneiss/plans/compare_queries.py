"""Queries that compare retrievers: every repository is a case, a chunk is a current document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gneiss.operators import compare
from gneiss.plans import canonical as c
from gneiss.plans.canonical import with_sql
from gneiss.runtime import materialise

_KS = [5, 10]


def _chunks(s: SparkSession, d: str) -> DataFrame:
    symbols = c.occurrences(s, d).filter("role = 'definition'").groupBy("document_id").agg(F.sort_array(F.collect_set("symbol_id")).alias("primary_symbols"))
    docs = c.documents(s, d).filter("repo is not null").select("document_id", "repo", F.col("relative_path").alias("path"), "language", "occurrence_count", "n_chars")
    return materialise(docs.join(symbols, "document_id", "left").withColumnRenamed("document_id", "chunk_id"), "chunks")


def _cases(s: SparkSession, d: str, chunks: DataFrame) -> DataFrame:
    """Gold are the paths of Rust files, the classes of C++ and the documents in Go of each repository."""
    lang = F.lower(F.trim("language"))
    classes = F.filter("primary_symbols", lambda x: x.startswith("scip-cpp") & x.endswith("#"))
    gold = lambda value, when: F.sort_array(F.collect_set(F.when(when, value)))
    symbols = chunks.select("repo", F.explode(classes).alias("x")).groupBy("repo").agg(F.sort_array(F.collect_set("x")).alias("gold_symbols"))
    return chunks.groupBy("repo").agg(gold(F.col("path"), lang == "rust").alias("gold_files"), gold(F.col("chunk_id"), lang == "go").alias("gold_chunks")).join(symbols, "repo", "left").withColumnRenamed("repo", "query_id")


def _ranked(chunks: DataFrame) -> DataFrame:
    out = None
    for name, order in (("dense", "occurrence_count"), ("keyword", "n_chars")):
        rank = F.row_number().over(Window.partitionBy("repo").orderBy(F.desc(order), "chunk_id"))
        rows = chunks.select(F.lit(name).alias("retriever"), F.col("repo").alias("query_id"), "chunk_id", rank.alias("rank")).filter("rank <= 20")
        out = rows if out is None else out.unionByName(rows)
    return out


def _setting(s: SparkSession, d: str) -> tuple[DataFrame, ...]:
    chunks = _chunks(s, d)
    cases = materialise(_cases(s, d, chunks), "cases")
    return chunks, cases, materialise(compare.targets(cases, chunks), "targets"), materialise(_ranked(chunks), "ranked")


def e_targets(s: SparkSession, d: str) -> DataFrame:
    return _setting(s, d)[2]


def e_compare(s: SparkSession, d: str) -> DataFrame:
    chunks, cases, expected, ranked = _setting(s, d)
    return compare.metrics(ranked, cases, expected, _KS)


def e_compare_union(s: SparkSession, d: str) -> DataFrame:
    chunks, cases, expected, ranked = _setting(s, d)
    return compare.union_metrics(ranked, cases, expected, _KS, compare.metrics(ranked, cases, expected, _KS))


def e_compare_summary(s: SparkSession, d: str) -> DataFrame:
    chunks, cases, expected, ranked = _setting(s, d)
    measured = materialise(compare.metrics(ranked, cases, expected, _KS), "measured")
    return compare.compare_summary(measured, compare.outcomes(measured, ranked, cases, expected))


def e_diagnostics(s: SparkSession, d: str) -> DataFrame:
    chunks, cases, expected, ranked = _setting(s, d)
    found = compare.diagnostics(compare.metrics(ranked, cases, expected, _KS), ranked, expected, "dense", "keyword")
    return found.withColumn("missing_files", F.array_join("missing_files", "|")).withColumn("missing_symbols", F.array_join("missing_symbols", "|"))


def _sides(ranked: DataFrame) -> tuple[DataFrame, DataFrame]:
    return tuple(ranked.filter(F.col("retriever") == r).drop("retriever") for r in ("dense", "keyword"))


def q_eval_rrf(s: SparkSession, d: str) -> DataFrame:
    return compare.fused_rrf(*_sides(_ranked(_chunks(s, d))), 10)


def q_eval_guarded(s: SparkSession, d: str) -> DataFrame:
    chunks = _chunks(s, d)
    return compare.fused_guarded(*_sides(_ranked(chunks)), chunks.select("chunk_id", "path"), 10)


def e_units(s: SparkSession, d: str) -> DataFrame:
    """Accuracy by units: the expected units of a repository are the paths of its Rust files."""
    chunks, cases, expected, ranked = _setting(s, d)
    files = expected.filter("kind = 'file' and chunk_id is not null").select("query_id", "chunk_id", F.col("target").alias("unit"))
    matches = ranked.filter("retriever = 'dense'").join(files, ["query_id", "chunk_id"], "left").select("query_id", "rank", "unit")
    return compare.unit_metrics(matches, cases.select("query_id", F.size("gold_files").alias("n")), 10)


QUERIES = {f.__name__: f for f in (e_targets, e_compare, e_compare_union, e_compare_summary, e_diagnostics, q_eval_rrf, q_eval_guarded, e_units)}

_SET = """sy as (select document_id, list_sort(list(distinct symbol_id)) as ps from o where role = 'definition' group by 1),
  ch as (select d.document_id as chunk_id, repo, relative_path as path, lower(trim(language)) as lang, occurrence_count, n_chars, coalesce(ps, []) as ps from d left join sy using (document_id) where repo is not null),
  ca as (select distinct repo as query_id from ch),
  go as (select distinct repo as query_id, 'file' as kind, path as target from ch where lang = 'rust' and path is not null union all select distinct repo, 'chunk', chunk_id from ch where lang = 'go'
    union all select distinct repo, 'symbol', x from (select repo, unnest(ps) as x from ch) where starts_with(x, 'scip-cpp') and x like '%#'),
  sh as (select distinct query_id, kind, target, chunk_id from (select go.*, ch.chunk_id from go join ch on kind = 'file' and (ch.path = target or ends_with(ch.path, '/' || target)) union all
    select go.*, ch.chunk_id from go join ch on kind = 'symbol' and (contains(chunk_id, target) or contains(target, chunk_id) or len(list_filter(ps, lambda h: contains(h, replace(target, '`', '')) or contains(replace(target, '`', ''), h))) > 0) union all select *, target from go where kind = 'chunk')),
  ta as (select go.*, sh.chunk_id from go left join sh using (query_id, kind, target)),
  ra as (select * from (select 'dense' as retriever, repo as query_id, chunk_id, row_number() over (partition by repo order by occurrence_count desc nulls last, chunk_id)::int as rank from ch union all select 'keyword', repo, chunk_id, row_number() over (partition by repo order by n_chars desc nulls last, chunk_id)::int from ch) where rank <= 20)"""
_COUNTS = _SET + """, nn as (select query_id, count(distinct case when kind = 'file' then target end) as nf, count(distinct case when kind = 'symbol' then target end) as ns, count(distinct case when kind = 'chunk' then target end) as nc, count(distinct chunk_id) as nr from ca left join ta using (query_id) group by 1),
  ks as (select unnest([5, 10]) as k),
  jo as (select ra.retriever, ra.query_id, k, ra.rank, ra.chunk_id, sh.kind, sh.target from ra join ks on rank <= k left join sh using (query_id, chunk_id)),
  ag as (select retriever, query_id, k, count(distinct case when kind is not null then chunk_id end) as seen, min(case when kind is not null then rank end) as fr, count(distinct case when kind = 'file' then target end) as f, count(distinct case when kind = 'symbol' then target end) as sm, count(distinct case when kind = 'chunk' then target end) as cc from jo group by 1, 2, 3),
  dc as (select retriever, query_id, k, sum(1 / log2(rank + 1.0)) as dcg, count(*) as rr from (select distinct retriever, query_id, k, rank from jo where kind is not null) group by 1, 2, 3),
  fa as (select *, case when nf > 0 then f / nf else 0 end as fx, case when ns > 0 then sm / ns else 0 end as sx, case when nc > 0 then cc / nc else 0 end as cx from ag join nn using (query_id))"""
_OF = "(select sum(1 / log2(i + 1.0)) from range(1, 1 + greatest(1, least(nr, k))::bigint) t(i))"
_ROW = """round((seen > 0)::int::double, 6) as hit, round((seen > 0)::int::double, 6) as recall, {mrr} as mrr, round({p}, 6) as precision, {ndcg} as ndcg, round(case when nr > 0 then seen / nr else 0 end::double, 6) as chunk_recall, (f > 0)::int::double as file_hit, round(fx::double, 6) as file_recall,
  (sm > 0)::int::double as symbol_hit, round(sx::double, 6) as symbol_recall, round(cx::double, 6) as direct_chunk_recall, round((case when (nf > 0)::int + (ns > 0)::int + (nc > 0)::int > 0 then (fx + sx + cx) / ((nf > 0)::int + (ns > 0)::int + (nc > 0)::int) else 0 end)::double, 6) as target_recall"""
_MEASURED = _COUNTS + f""", me as (select fa.retriever, fa.query_id, fa.k, {_ROW.format(mrr="round(coalesce(1.0 / fr, 0), 6)::double", p="coalesce(rr, 0) / fa.k::double", ndcg="0::double").replace("0::double as ndcg", "round(case when nr > 0 then coalesce(dcg, 0) / " + _OF.replace("least(nr, k)", "least(nr, fa.k)") + " else 0 end::double, 6) as ndcg")}
  from fa left join dc using (retriever, query_id, k))"""
_MEANS = ", ".join(f"round(avg({x}), 6) as {x}" for x in compare.FAMILIES)

ORACLES = {
    "e_targets": with_sql("d o", "select query_id, kind, target, chunk_id from ta", _SET),
    "e_compare": with_sql("d o", "select * from me", _MEASURED),
    "e_compare_union": with_sql("d o", f"""select 'union' as retriever, query_id, k, {_ROW.format(mrr="bm", p="seen / greatest(1, ret)::double", ndcg="bn")} from uf join (select query_id, k, max(mrr) as bm, max(ndcg) as bn from me group by 1, 2) b using (query_id, k)""", _MEASURED + """,
      ua as (select query_id, k, count(distinct case when kind is not null then chunk_id end) as seen, count(distinct chunk_id) as ret, count(distinct case when kind = 'file' then target end) as f, count(distinct case when kind = 'symbol' then target end) as sm, count(distinct case when kind = 'chunk' then target end) as cc from jo group by 1, 2),
      uf as (select *, case when nf > 0 then f / nf else 0 end as fx, case when ns > 0 then sm / ns else 0 end as sx, case when nc > 0 then cc / nc else 0 end as cx from ua join nn using (query_id))"""),
    "e_compare_summary": with_sql("d o", f"""select retriever, k, cases, er as empty_relevant, 0::bigint as no_results, 0::bigint as case_errors, {', '.join(compare.FAMILIES)} from (select retriever, k, count(*) as cases, {_MEANS} from me group by 1, 2), (select count(*) as er from nn where nr = 0)""", _MEASURED),
    "e_diagnostics": with_sql("d o", """select h.query_id, dh > 0 and wh = 0 as dense_only_hit, wh > 0 and dh = 0 as keyword_only_hit, dh > 0 and wh > 0 as both_hit, coalesce(mf, '') as missing_files, coalesce(ms, '') as missing_symbols
      from (select query_id, max(case when retriever = 'dense' then hit end) as dh, max(case when retriever = 'keyword' then hit end) as wh from me where k = 10 group by 1) h
      left join (select query_id, string_agg(case when kind = 'file' then target end, '|' order by target) as mf, string_agg(case when kind = 'symbol' then target end, '|' order by target) as ms from go where (query_id, kind, target) not in (select (query_id, kind, target) from jo where k = 10 and kind is not null) group by 1) m using (query_id)""", _MEASURED),
    "q_eval_rrf": with_sql("d o", "select query_id, chunk_id, rank from (select query_id, chunk_id, row_number() over (partition by query_id order by round(sum(1.0::double / (60 + rank)), 12) desc, chunk_id)::int as rank from ra group by 1, 2) where rank <= 10", _SET),
    "q_eval_guarded": with_sql("d o", """select query_id, chunk_id, rank from (select query_id, chunk_id, row_number() over (partition by query_id order by pos)::int as rank from
      (select query_id, chunk_id, case when rank <= greatest(1, 10 - coalesce(n, 0)) then rank else rank + coalesce(n, 0) end as pos from (select * from ra where retriever = 'dense') left join nx using (query_id) union all select query_id, chunk_id, greatest(1, 10 - n) + i from fr join nx using (query_id))) where rank <= 10""", _SET + """,
      tp as (select distinct query_id, path from ra join ch using (chunk_id) where retriever = 'dense' and rank <= 10 and path <> ''),
      fr as (select query_id, chunk_id, i from (select ra.query_id, ra.chunk_id, row_number() over (partition by ra.query_id order by ra.rank) as i from ra join ch using (chunk_id) where retriever = 'keyword' and rank <= 3 and (ra.query_id, ra.chunk_id) not in (select (query_id, chunk_id) from ra where retriever = 'dense') and (ra.query_id, path) not in (select (query_id, path) from tp)) where i <= 1),
      nx as (select query_id, count(*) as n from fr group by 1)"""),
    "e_units": with_sql("d o", """select query_id, case when n > 0 and m > 0 then 1.0 else 0.0 end::double as success, round(case when n > 0 then m / n else 0 end::double, 6) as recall, round(case when n > 0 then coalesce(1.0 / fr, 0) else 0 end::double, 6) as mrr,
      round(case when n > 0 then coalesce(dcg, 0) / (select sum(1 / log2(i + 1.0)) from range(1, 1 + greatest(1, least(n, 10))::bigint) t(i)) else 0 end::double, 6) as ndcg, case when n = 0 then 'empty_expected' when m = 0 then 'no_relevant_hit' else '' end as reason
      from (select ca.query_id, (select count(distinct target) from go where go.query_id = ca.query_id and kind = 'file') as n, coalesce(m, 0) as m, fr, dcg from ca left join (select query_id, count(*) as m, min(rank) as fr from u1 group by 1) using (query_id) left join (select query_id, sum(1 / log2(rank + 1.0)) as dcg from (select distinct query_id, rank from u1) group by 1) using (query_id))""", _SET + """,
      u1 as (select ra.query_id, target, min(rank) as rank from ra join sh using (query_id, chunk_id) where retriever = 'dense' and kind = 'file' and rank <= 10 group by 1, 2)"""),
}
