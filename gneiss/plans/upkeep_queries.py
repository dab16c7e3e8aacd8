"""Queries of registries, jobs, reports, projections and small functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.operators import evaluation, symbols, text, upkeep, vectors
from gneiss.plans import canonical as c
from gneiss.plans.canonical import with_sql
from gneiss.plans.tables import table
from gneiss.sources import registry


def s_latest_jobs(s: SparkSession, d: str) -> DataFrame:
    jobs = table(s, d, "events").select(F.col("event_id").alias("job_id"), F.col("ts").alias("created_at"), "event_type")
    return upkeep.latest_jobs(jobs, 25).select("job_id", "event_type")


def s_check_jobs(s: SparkSession, d: str) -> DataFrame:
    """Every user is a job; what they did stands for the states."""
    state = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "succeeded").when(F.col("event_type") == "view", "queued").otherwise("running")
    return upkeep.check_jobs(table(s, d, "events").select(F.col("user_id").alias("job_id"), "ts", state.alias("state")))


def s_messages(s: SparkSession, d: str) -> DataFrame:
    return upkeep.last_messages(table(s, d, "events").select(F.col("user_id").alias("job_id"), "ts", F.concat_ws(":", "event_type", F.col("event_id").cast("string")).alias("message")), 3)


def f_progress(s: SparkSession, d: str) -> DataFrame:
    stage = F.element_at(F.array(F.lit("chunk"), F.lit("embed"), F.lit("graph"), F.lit("done"), F.lit("x")), (F.col("doc_id") % 5 + 1).cast("int"))
    m = F.concat(F.lit("stage="), stage, F.lit(" done="), F.col("doc_id") % 100, F.lit(" total=100"))
    return table(s, d, "documents").select("doc_id", upkeep.progress(m).alias("percent"))


def j_routes(s: SparkSession, d: str) -> DataFrame:
    """Documents as samples, and the repositories' even-numbered snapshots as the registry."""
    docs = table(s, d, "documents").filter("repo is not null and commit_hash is not null")
    registry = docs.filter("doc_id % 2 = 0").select(upkeep.slug("repo", "commit_hash").alias("slug"), F.concat(F.lit("/indexes/"), "repo").alias("path"))
    return upkeep.route_targets(docs.filter("doc_id % 3 = 0").select(F.col("doc_id").alias("id"), "repo", F.col("commit_hash").alias("base_sha")), registry)


def a_status_counts(s: SparkSession, d: str) -> DataFrame:
    return upkeep.status_counts(table(s, d, "documents"), "language")


def f_commits(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents")
    mixed = F.when(F.col("doc_id") % 3 == 0, F.upper("commit_hash")).when(F.col("doc_id") % 3 == 1, F.substring("commit_hash", 1, 6)).otherwise(F.col("commit_hash"))
    return docs.select("doc_id", upkeep.normal_commit(mixed).alias("commit"))


def w_first_path(s: SparkSession, d: str) -> DataFrame:
    return symbols.first_paths(c.occurrences(s, d), c.documents(s, d))


def p_snapshot(s: SparkSession, d: str) -> DataFrame:
    top = c.documents(s, d).filter("repo is not null").groupBy("repo", "commit_hash").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "repo", "commit_hash").first()
    return symbols.in_snapshot(c.nodes(s, d), top["repo"], top["commit_hash"]).select("node_id")


def p_snippet(s: SparkSession, d: str) -> DataFrame:
    defs = c.occurrences(s, d).filter("role = 'definition'").join(c.documents(s, d).select("document_id", "content"), "document_id")
    return defs.select("id", text.snippet("content", "range_start_line").alias("snippet"))


def p_version_filter(s: SparkSession, d: str) -> DataFrame:
    """Records without a vector of the version that the even labels stand for."""
    have = table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.when(F.col("label") % 2 == 0, "v2").otherwise("v1").alias("embedding_version"))
    return vectors.missing(table(s, d, "documents").select("doc_id"), have, "doc_id", "v2")


def u_unmatched(s: SparkSession, d: str) -> DataFrame:
    docs = c.documents(s, d)
    found = docs.filter(F.col("content").rlike(r"(?i)lexer")).select("relative_path")
    return evaluation.unmatched(found, docs.filter("lower(trim(language)) = 'java'").select("relative_path"), "relative_path")


def u_shared_symbols(s: SparkSession, d: str) -> DataFrame:
    """Symbols that a document both defines and refers to, and all its symbols in order of first mention."""
    o = c.occurrences(s, d)
    gathered = o.groupBy("document_id").agg(
        F.collect_set(F.when(F.col("role") == "definition", F.col("symbol_id"))).alias("own"), F.collect_set(F.when(F.col("role") != "definition", F.col("symbol_id"))).alias("named"), F.sort_array(F.collect_list(F.struct("id", "symbol_id"))).alias("all")
    )
    ordered = F.array_distinct(F.transform("all", lambda x: x["symbol_id"]))
    return gathered.select("document_id", F.array_join(F.sort_array(F.array_intersect("own", "named")), "|").alias("shared"), F.array_join(ordered, "|").alias("mentioned"))


def f_graded_gain(s: SparkSession, d: str) -> DataFrame:
    from gneiss.plans.chunk_queries import _ranked

    graded = _ranked(s, d).join(c.documents(s, d).select(F.col("document_id").alias("result_id"), (F.col("doc_id") % 4).alias("rel")), "result_id")
    return evaluation.graded_gain(graded)


def f_intent_tags(s: SparkSession, d: str) -> DataFrame:
    i = c.intents(s, d).join(c.nodes(s, d).select("node_id", "path"), "node_id")
    return i.select("node_id", F.array_join(text.intent_tags("role_in_chain", "path"), ",").alias("tags"), text.intent_quality(F.when(F.col("fan_out") > 2, F.concat("node_id", F.lit(" acts as hub"))).otherwise(F.col("intent_text"))).alias("quality"))


def f_globs(s: SparkSession, d: str) -> DataFrame:
    return c.symbols(s, d).filter("package <> ''").select("symbol_id", text.package_glob("package").alias("glob"))


def q_merge_payloads(s: SparkSession, d: str) -> DataFrame:
    sym = c.symbols(s, d)
    hits = lambda word, score, why: sym.filter(F.lower("display_name").contains(word)).select(F.col("symbol_id").alias("result_id"), (F.lit(score) + F.length("display_name") / 100.0).alias("score"), F.when(F.length("display_name") % 2 == 0, F.col("kind")).alias("payload"), F.lit(why).alias("explain"))
    return symbols.merge_payloads(hits("lexer", 2.0, "by name"), hits("load", 1.0, "by part").unionByName(hits("lexer", 1.5, "by part")), 60).withColumn("score", F.round("score", 6))


def s_vector_upsert(s: SparkSession, d: str) -> DataFrame:
    """Vectors are keyed by record and version: new ones replace those of both keys only."""
    e = table(s, d, "embeddings").select("vec_id", (F.col("label") % 3).alias("version"), "label")
    old = e.filter("vec_id % 2 = 0").select("vec_id", "version", F.lit("old").alias("origin"))
    new = e.filter("vec_id % 3 = 0").select("vec_id", F.when(F.col("vec_id") % 4 == 0, F.col("version")).otherwise(F.col("version") + 10).alias("version"), F.lit("new").alias("origin"))
    return upkeep.upsert(old, new, ["vec_id", "version"])


def q_many_topk(s: SparkSession, d: str) -> DataFrame:
    """The five nearest of every twentieth vector among all, by inner product; the score is the negative distance."""
    e = table(s, d, "embeddings").select(F.lpad(F.col("vec_id").cast("string"), 9, "0").alias("node"), F.col("embedding").cast("array<double>").alias("vec"), "vec_id")
    near = vectors.nearest_vectors(e, 5, e.filter("vec_id % 20 = 0"))
    return near.select("node", "neighbour", F.round(F.col("sim") - 1, 6).alias("score"), "rank")


def s_index_status(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").filter("repo is not null and commit_hash is not null")
    named = docs.groupBy(upkeep.slug("repo", "commit_hash").alias("slug")).agg(F.min("doc_id").alias("i"))
    registered = named.filter("i % 3 > 0").select("slug", F.when(F.col("i") % 2 == 0, "ready").otherwise("building").alias("status"), (F.col("i") % 5 > 1).alias("db_exists"))
    return registry.statuses(named.select("slug", (F.col("i") % 7 > 2).alias("computed_exists")), registered)


QUERIES = {f.__name__: f for f in (
    s_latest_jobs, s_check_jobs, s_messages, f_progress, j_routes, a_status_counts, f_commits, w_first_path, p_snapshot, p_snippet, p_version_filter, u_unmatched, u_shared_symbols, f_graded_gain, f_intent_tags, f_globs,
    q_merge_payloads, s_vector_upsert, q_many_topk, s_index_status,
)}

_SLUG = "trim(regexp_replace(lower(trim(repo)), '[^a-z0-9]+', '-', 'g'), '-') || '-' || substr(lower(commit_hash), 1, 8)"

ORACLES = {
    "s_vector_upsert": """with e as (select vec_id, label % 3 as version from embeddings), n as (select vec_id, (case when vec_id % 4 = 0 then version else version + 10 end)::int as version from e where vec_id % 3 = 0)
      select vec_id, version, 'old' as origin from e where vec_id % 2 = 0 and (vec_id, version) not in (select (vec_id, version) from n) union all select vec_id, version, 'new' from n""",
    "q_many_topk": """select node, neighbour, round(sim - 1, 6) as score, r::int as rank from (select lpad(x.vec_id::varchar, 9, '0') as node, lpad(y.vec_id::varchar, 9, '0') as neighbour, round(list_inner_product(x.embedding::double[], y.embedding::double[]), 9) as sim,
      row_number() over (partition by x.vec_id order by round(list_inner_product(x.embedding::double[], y.embedding::double[]), 9) desc, y.vec_id) as r from embeddings x join embeddings y on x.vec_id <> y.vec_id where x.vec_id % 20 = 0) where r <= 5""",
    "s_index_status": f"""with n as (select {_SLUG} as slug, min(doc_id) as i from documents where repo is not null and commit_hash is not null group by 1)
      select slug, case when i % 3 > 0 and i % 5 > 1 and i % 2 = 0 then 'ready' when i % 3 > 0 and i % 5 <= 1 then 'stale_metadata' when i % 7 > 2 then 'db_only' else 'missing' end as status from n""",
    "s_latest_jobs": "select event_id as job_id, event_type from events order by ts desc, event_id desc limit 25",
    "s_check_jobs": """with l as (select user_id as job_id, ts, case event_type when 'error' then 'failed' when 'purchase' then 'succeeded' when 'view' then 'queued' else 'running' end as state from events),
      p as (select *, lag(state) over (partition by job_id order by ts, state) as b from l),
      k as (select *, case when b is null then state <> 'queued' else not ((b = 'queued' and state in ('running', 'failed')) or (b = 'running' and state in ('succeeded', 'failed'))) end as broken from p)
      select job_id, max(struct_pack(ts := ts, state := state)).state as state, count(*) as n_steps, sum(broken::int)::bigint as n_broken from k group by 1""",
    "s_messages": "select job_id, message, r::int as r from (select user_id as job_id, event_type || ':' || event_id as message, row_number() over (partition by user_id order by ts desc, event_type || ':' || event_id) as r from events) where r <= 3",
    "f_progress": "select doc_id, (case doc_id % 5 when 0 then 15 when 1 then floor(30 + 40 * ((doc_id % 100) / 100.0)) when 2 then 70 when 3 then 100 else 0 end)::int as percent from documents",
    "j_routes": f"""with docs as (select *, {_SLUG} as slug from documents where repo is not null and commit_hash is not null)
      select doc_id as id, slug, path from docs left join (select slug, max('/indexes/' || repo) as path from docs where doc_id % 2 = 0 group by 1) using (slug) where doc_id % 3 = 0""",
    "a_status_counts": "select case when trim(coalesce(language, '')) = '' then 'unknown' else language end as status, count(*) as n from documents group by 1",
    "f_commits": "select doc_id, case when regexp_full_match(v, '[0-9a-f]{7,40}') then v end as commit from (select doc_id, lower(trim(case doc_id % 3 when 0 then upper(commit_hash) when 1 then substr(commit_hash, 1, 6) else commit_hash end)) as v from documents)",
    "w_first_path": with_sql("d o", "select symbol_id, min(struct_pack(l := range_start_line, p := relative_path)).p as path from o join d using (document_id) where role = 'definition' and relative_path <> '' group by 1"),
    "p_snapshot": with_sql("d n", "select node_id from n, t where json_extract_string(meta_json, '$.repo') = t.repo and json_extract_string(meta_json, '$.commit') = t.commit_hash", "t as (select repo, commit_hash, count(*) as n from d where repo is not null group by 1, 2 order by n desc, repo, commit_hash limit 1)"),
    "p_snippet": with_sql("d o", "select id, array_to_string(string_split(coalesce(content, ''), chr(10))[greatest(0, range_start_line - 8) + 1:range_start_line + 9], chr(10)) as snippet from o join d using (document_id) where role = 'definition'"),
    "p_version_filter": "select doc_id from documents where doc_id not in (select vec_id from embeddings where label % 2 = 0)",
    "u_unmatched": with_sql("d", "select * from (select relative_path, 'extra' as side from f where relative_path not in (select relative_path from x) union all select relative_path, 'missing' from x where relative_path not in (select relative_path from f))",
      "f as (select distinct relative_path from d where relative_path is not null and regexp_matches(content, '(?i)lexer')), x as (select distinct relative_path from d where relative_path is not null and lower(trim(language)) = 'java')"),
    "u_shared_symbols": with_sql("o", """select document_id, coalesce(sh, '') as shared, m as mentioned from (select document_id, string_agg(symbol_id, '|' order by f) as m from (select document_id, symbol_id, min(id) as f from o group by 1, 2) group by 1)
      left join (select document_id, string_agg(symbol_id, '|' order by symbol_id) as sh from (select document_id, symbol_id from o group by 1, 2 having bool_or(role = 'definition') and bool_or(role <> 'definition')) group by 1) using (document_id)"""),
    "f_graded_gain": with_sql("d", "select query_id, round(sum((pow(2, rel) - 1) / log2(rank + 1.0)), 6) as dcg from r where rank <= 10 group by 1", "r as (select repo as query_id, doc_id % 4 as rel, row_number() over (partition by repo order by occurrence_count desc nulls last, document_id) as rank from d where repo is not null)"),
    "f_intent_tags": with_sql("n i", "select i.node_id, array_to_string(list_filter([role_in_chain, split_part(coalesce(path, ''), '/', 1)], lambda t: trim(coalesce(t, '')) <> ''), ',') as tags, (case when contains(coalesce(case when i.fan_out > 2 then i.node_id || ' acts as hub' else intent_text end, ''), 'acts as') then 0.65 else 0.85 end)::double as quality from i join n using (node_id)"),
    "f_globs": with_sql("s", "select symbol_id, '**/' || replace(trim(package), '.', '/') || '/**/*.java' as glob from s where package <> ''"),
    "q_merge_payloads": with_sql("s", """select result_id, round(max(score), 6)::double as score, min(case when coalesce(payload, '') <> '' then struct_pack(o := o, payload := payload) end).payload as payload, array_to_string(list_transform(list_sort(list(distinct struct_pack(o := o, e := e))), lambda x: x.e), '; ') as explain from h group by 1 order by max(score) desc, result_id desc limit 60""",
      """h as (select symbol_id as result_id, 2.0::double + length(display_name) / 100.0 as score, case when length(display_name) % 2 = 0 then kind end as payload, 'by name' as e, 0 as o from s where contains(lower(display_name), 'lexer') union all
        select symbol_id, 1.0::double + length(display_name) / 100.0, case when length(display_name) % 2 = 0 then kind end, 'by part', 1 from s where contains(lower(display_name), 'load') union all select symbol_id, 1.5::double + length(display_name) / 100.0, case when length(display_name) % 2 = 0 then kind end, 'by part', 1 from s where contains(lower(display_name), 'lexer'))"""),
}
