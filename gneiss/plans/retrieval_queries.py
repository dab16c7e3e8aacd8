"""Queries of keyword, vector and fused retrieval.  A chunk is a current document; its vector is the hash embedding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.operators import fusion, retrieval_index, symbols, text, vectors
from gneiss.plans import canonical as c
from gneiss.plans.canonical import bm25_sql, with_sql
from gneiss.plans.tables import table

_Q = "load ledger lexer"
_PHRASE = "load_ledger frozen"
_SYMBOL = "lexer"
_DEPTH = 40


def _channel(hits: DataFrame, id_col: str, n: int = _DEPTH) -> DataFrame:
    kept = hits.select(F.col(id_col).alias("result_id"), F.round("score", 6).alias("score"))
    return kept.orderBy(F.desc("score"), "result_id").limit(n)


def _postings(s: SparkSession, d: str) -> DataFrame:
    return retrieval_index.stored(s, "postings", f"{d}/documents.parquet", lambda: retrieval_index.postings(c.documents(s, d).select("document_id", "content"), "document_id", ["content"]))


def _vectors(s: SparkSession, d: str) -> DataFrame:
    return retrieval_index.stored(s, "vectors", f"{d}/documents.parquet", lambda: retrieval_index.record_vectors(c.documents(s, d).select("document_id", "content"), "document_id", "content"))


def _keyword(s: SparkSession, d: str, query: str = _Q) -> DataFrame:
    return _channel(retrieval_index.search(_postings(s, d), query), "id")


def _semantic(s: SparkSession, d: str, query: str = _Q) -> DataFrame:
    return _channel(retrieval_index.nearest_to(_vectors(s, d), retrieval_index.query_vector(query)), "id")


def _structure(s: SparkSession, d: str) -> DataFrame:
    """Documents that define the symbols found for the query, with the best symbol score."""
    hits = symbols.symbol_exact(c.symbols(s, d), _SYMBOL, 20)
    docs = c.occurrences(s, d).filter("role = 'definition'").join(hits, "symbol_id").groupBy("document_id").agg(F.max("score").alias("score"))
    return _channel(docs.join(c.documents(s, d).select("document_id"), "document_id", "left_semi"), "document_id", 10)


def _channels(s: SparkSession, d: str) -> dict[str, DataFrame]:
    return {"structure": fusion.ranked(_structure(s, d)), "keyword": fusion.ranked(_keyword(s, d)), "semantic": fusion.ranked(_semantic(s, d))}


def _paths(s: SparkSession, d: str) -> DataFrame:
    return c.documents(s, d).select(F.col("document_id").alias("result_id"), F.col("relative_path").alias("path"))


def _tidy(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


def q_bm25(s: SparkSession, d: str) -> DataFrame:
    return _keyword(s, d)


def q_bm25_phrase(s: SparkSession, d: str) -> DataFrame:
    return _keyword(s, d, _PHRASE)


def q_dense_topk(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings")
    return vectors.dense_top_k(e, "vec_id", "embedding", e.filter("vec_id = 0").select(F.col("embedding").alias("q")), "q", 20)


def q_semantic(s: SparkSession, d: str) -> DataFrame:
    return _semantic(s, d)


def f_hash_vector(s: SparkSession, d: str) -> DataFrame:
    v = text.hash_vector(c.documents(s, d).select("document_id", "content"), "document_id", "content")
    return v.groupBy("idx").agg(F.count("*").alias("n"), F.round(F.sum("v"), 4).alias("total"))


def q_linear_fusion(s: SparkSession, d: str) -> DataFrame:
    return _tidy(fusion.linear(_channels(s, d), 20))


def q_rrf(s: SparkSession, d: str) -> DataFrame:
    return _tidy(fusion.rrf(_channels(s, d), 20))


def q_dense_guarded(s: SparkSession, d: str) -> DataFrame:
    ch = _channels(s, d)
    return _tidy(fusion.dense_guarded(ch["structure"], ch["keyword"], ch["semantic"], _paths(s, d), 20)).withColumn("position", F.col("position").cast("int"))


def q_test_depref(s: SparkSession, d: str) -> DataFrame:
    paths = _paths(s, d).withColumn("path", F.when(F.col("path").like("%.java"), F.regexp_replace("path", "^src/main/", "m/src/test/")).otherwise(F.col("path")))
    return _tidy(fusion.prefer_source(_keyword(s, d), paths, _Q))


def p_code_projection(s: SparkSession, d: str) -> DataFrame:
    """Results with their code, cut to 200 characters, as a feature of the display."""
    cut = 200
    docs = c.documents(s, d).select(F.col("document_id").alias("result_id"), F.substring("content", 1, cut).alias("code"), (F.length("content") > cut).alias("truncated"))
    return _keyword(s, d).join(docs, "result_id").select("result_id", "code", "truncated")


def f_tokens(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", text.heuristic_tokens("content").alias("n_tokens"))


def a_bm25_stats(s: SparkSession, d: str) -> DataFrame:
    """Corpus statistics of the full-text index: documents, total and mean length."""
    n = c.documents(s, d).select(F.size(text.index_terms("content")).cast("long").alias("dl"))
    return n.agg(F.count("*").alias("n_docs"), F.sum("dl").alias("n_terms"), F.round(F.avg("dl"), 4).alias("avg_terms"))


QUERIES = {f.__name__: f for f in (q_bm25, q_bm25_phrase, q_dense_topk, q_semantic, f_hash_vector, q_linear_fusion, q_rrf, q_dense_guarded, q_test_depref, p_code_projection, f_tokens, a_bm25_stats)}

_HASHED = """hv_t as (select document_id as id, unnest(list_filter(regexp_split_to_array(coalesce(content, ''), '[\\s\\x{0085}\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+'), lambda t: t <> '')) as t from d),
  hv_s as (select id, ('0x' || substr(h, 1, 8))::bigint % 128 as idx, sum(case when ('0x' || substr(h, 9, 2))::bigint % 2 = 0 then 1.0::double else -1.0::double end) as v from (select id, sha1(t) as h from hv_t) group by 1, 2),
  hv as (select id, idx, v / sqrt(sum(v * v) over (partition by id)) as v from hv_s where v <> 0)"""
_QV = f"""qv as (select idx, v / sqrt(sum(v * v) over ()) as w from (select ('0x' || substr(h, 1, 8))::bigint % 128 as idx, sum(case when ('0x' || substr(h, 9, 2))::bigint % 2 = 0 then 1.0::double else -1.0::double end) as v
  from (select sha1(unnest(string_split('{_Q}', ' '))) as h) group by 1))"""
_SEM = f"{_HASHED}, {_QV}, sem as (select id as result_id, round(sum(v * w), 6) as score from hv join qv using (idx) group by 1 order by 2 desc, 1 limit {_DEPTH})"


def _key(query: str = _Q) -> str:
    return bm25_sql("d", "document_id", "content", query, "kb") + f", key as (select id as result_id, round(score, 6) as score from kb order by 2 desc, 1 limit {_DEPTH})"


def _str() -> str:
    from gneiss.plans.symbol_queries import _cands

    return _cands(_SYMBOL, 160) + f""", sx as (select symbol_id, score from (select symbol_id, case when contains(h, '{_SYMBOL}') then case when lower(display_name) = '{_SYMBOL}' then 4.0 else 2.0 end else 0.0 end as score
      from (select *, concat_ws(' ', lower(display_name), lower(symbol_id)) as h from cand)) where score > 0 order by score desc, symbol_id desc limit 20),
      struc as (select document_id as result_id, max(score)::double as score from o join sx using (symbol_id) where role = 'definition' and document_id in (select document_id from d) group by 1 order by 2 desc, 1 limit 10)"""


def _all() -> str:
    rank = "row_number() over (order by score desc, result_id) as rank"
    return f"""{_str()}, {_key()}, {_SEM}, ch as (select *, 'structure' as channel, 0 as ord, 0.5 as w, {rank} from struc union all select *, 'keyword', 1, 0.2, {rank} from key union all select *, 'semantic', 2, 0.3, {rank} from sem)"""


ORACLES = {
    "q_bm25": with_sql("d", "select result_id, score from key", _key()),
    "q_bm25_phrase": with_sql("d", "select result_id, score from key", _key(_PHRASE)),
    "q_dense_topk": "select vec_id as result_id, round(list_inner_product(embedding::double[], (select embedding::double[] from embeddings where vec_id = 0)), 6) as score from embeddings order by 2 desc, 1 limit 20",
    "q_semantic": with_sql("d", "select result_id, score from sem", _SEM),
    "f_hash_vector": with_sql("d", "select idx::int as idx, count(*) as n, round(sum(v), 4) as total from hv group by 1", _HASHED),
    "q_linear_fusion": with_sql("d s o", "select result_id, round(sc, 6) as score from (select result_id, sum(score * w)::double as sc, min(ord * 1000 + rank) as f from ch group by 1) order by round(sc, 9) desc, f limit 20", _all()),
    "q_rrf": with_sql("d s o", "select result_id, round(sc, 6) as score from (select result_id, sum(1.0::double / (60 + rank)) as sc, min(ord * 1000 + rank) as f from ch group by 1) order by round(sc, 9) desc, f limit 20", _all()),
    "q_dense_guarded": with_sql("d s o", """select result_id, round(score, 6) as score, (case when kind = 1 then keep + i when i <= keep then i else i + n end)::int as position from
      (select result_id, score, 0 as kind, rank as i from back union all select result_id, score, 1, row_number() over (order by ord, rank) from ins) , (select count(*) as n, greatest(1, 20 - count(*)) as keep from ins)""", _all() + """,
      back as (select m.result_id, m.score + coalesce(0.01::double / k.rank, 0) + coalesce(0.015::double / t.rank, 0) as score, m.rank from (select * from ch where ord = 2) m left join (select * from ch where ord = 1) k using (result_id) left join (select * from ch where ord = 0) t on t.result_id = m.result_id),
      tp as (select distinct relative_path as path from back join d on d.document_id = back.result_id where rank <= 20),
      ins as (select * from (select result_id, 0.02::double / rank as score, ord, rank from ch where ord = 0 and rank <= 2 union all
        select result_id, 0.01::double / rank, ord, rank from ch join d on d.document_id = result_id where ord = 1 and rank <= 3 and relative_path not in (select path from tp))
        where result_id not in (select result_id from ch where ord = 2) qualify row_number() over (partition by result_id order by ord, rank) = 1 order by ord, rank limit 2)"""),
    "q_test_depref": with_sql("d", "select k.result_id, round(case when d.relative_path like 'src/main/%.java' or contains(lower(d.relative_path), '/src/test/') then case when score >= 0 then score * 0.55 else score / 0.55 end else score end, 6)::double as score from key k join d on d.document_id = k.result_id", _key()),
    "p_code_projection": with_sql("d", "select k.result_id, content[1:200] as code, length(content) > 200 as truncated from key k join d on d.document_id = k.result_id", _key()),
    "f_tokens": r"""select doc_id, (case when coalesce(content, '') = '' then 0 else list_sum(list_transform(string_split(content, chr(10)), lambda l: greatest(1, len(regexp_extract_all(l, '[\p{L}\p{N}\p{M}_]+|[^\p{L}\p{N}\p{M}_\s]'))))) end)::int as n_tokens from documents""",
    "a_bm25_stats": with_sql("d", "select count(*) as n_docs, sum(dl)::bigint as n_terms, round(avg(dl), 4) as avg_terms from st_c", "st_c as (select len(list_filter(regexp_split_to_array(lower(coalesce(content, '')), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')) as dl from d)"),
}
