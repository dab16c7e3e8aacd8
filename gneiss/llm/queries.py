"""Queries of the training-data operators and the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm import handwritten, leakage, near_duplicates, neighbours, packing, shared_spans, tokens


def _t(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.similar_pairs(_t(spark, folder, "documents"), threshold=0.6)


def p1_groups(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.similarity_groups(_t(spark, folder, "documents"), threshold=0.6)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return handwritten.not_handwritten(_t(spark, folder, "documents")).select("doc_id")


def p2_kinds(spark: SparkSession, folder: str) -> DataFrame:
    return handwritten.not_handwritten(_t(spark, folder, "documents"))


def p2_by_path(spark: SparkSession, folder: str) -> DataFrame:
    return handwritten.shown_by_path(_t(spark, folder, "documents"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest_pairs(_t(spark, folder, "function_intents"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.wrong_totals(_t(spark, folder, "documents"), _t(spark, folder, "snapshot_tokens"))


def p5_budget(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.token_totals(_t(spark, folder, "documents"), ["source", "language", "repo", "commit_hash"])


def p5_subwords(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.token_totals(_t(spark, folder, "documents"), ["source", "language"], vocabulary=tokens.VOCABULARY)


def _packed(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(_t(spark, folder, "documents"), _t(spark, folder, "token_windows"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return _packed(spark, folder).filter("n_pieces > 1").select("window_id", "doc_id").distinct()


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Containers used per window, and the least possible by the dual of the program."""
    docs, windows = _t(spark, folder, "documents"), packing.window_list(_t(spark, folder, "token_windows"))
    least = packing.least_containers(packing.document_sizes(docs), windows)
    return packing.fill_report(_packed(spark, folder)).join(least, "window_id", "left")


def p8_check(spark: SparkSession, folder: str) -> DataFrame:
    return packing.fill_check(_packed(spark, folder), packing.window_list(_t(spark, folder, "token_windows")))


def p8_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return _packed(spark, folder).drop("container")


def p8_places(spark: SparkSession, folder: str) -> DataFrame:
    return _packed(spark, folder)


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaked_documents(_t(spark, folder, "documents"), _t(spark, folder, "eval_items")).select("doc_id", "item_id")


def p9_spans(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaked_spans(_t(spark, folder, "documents"), _t(spark, folder, "eval_items"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return shared_spans.shared_spans(_t(spark, folder, "documents")).select("doc_id").distinct()


def p10_spans(spark: SparkSession, folder: str) -> DataFrame:
    return shared_spans.shared_spans(_t(spark, folder, "documents"))


def p10_amounts(spark: SparkSession, folder: str) -> DataFrame:
    return shared_spans.shared_amounts(_t(spark, folder, "documents"))


_COUNTED = r"""counted as (select *, case when content is null or content = '' then 0 else
  list_sum(list_transform(string_split(content, chr(10)), lambda l: greatest(1, len(regexp_extract_all(l, '[\p{L}\p{N}\p{M}_]+|[^\p{L}\p{N}\p{M}_\s]'))))) end::bigint as n from documents)"""
_SHINGLES = """words as (select distinct doc_id, regexp_extract_all(lower(content), '[a-z0-9_]+') as w from documents where content is not null),
  shingles as (select distinct doc_id, w[i:i+4] as s from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from words where len(w) >= 5)),
  sizes as (select doc_id, count(*) as n from shingles group by 1),
  common as (select a.doc_id as x, b.doc_id as y, count(*) as c from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2)"""

#: White space as the pieces of ``tokens.PIECE`` see it.
_BLANK = r"\t-\r\x1c-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_SUBWORDS = rf"""v as (select distinct lower(hex(from_base64(split_part(line, ' ', 1)))) as w from read_csv('{tokens.VOCABULARY}', header = false, delim = '\t', quote = '', escape = '', columns = {{'line': 'varchar'}})),
  lens as (select distinct len(w) as l from v union select 2),
  pieces as (select doc_id, unnest(regexp_extract_all(content, ' ?[^{_BLANK}]+|[{_BLANK}]+')) as p from documents),
  known as (select distinct p, lower(hex(encode(p))) as h from pieces),
  walk as (select p, h, 1::bigint as pos, 0::bigint as n from known
    union all select p, h, pos + best, n + 1 from (select walk.p, walk.h, walk.pos, walk.n, max(case when l = 2 or v.w is not null then l end) as best
      from walk join lens on walk.pos + l <= len(walk.h) + 1 left join v on v.w = substr(walk.h, walk.pos, l) group by all)),
  lengths as (select p, max(n) as n from walk where pos > len(h) group by p),
  subwords as (select doc_id, sum(n)::bigint as s from pieces join lengths using (p) group by 1)"""
_LEAKED = """d as (select doc_id, i, w[i:i+11] as s from (select doc_id, w, unnest(range(1, len(w) - 10)) as i from
        (select doc_id, regexp_extract_all(lower(text), '[a-z0-9_]+') as w from documents) where len(w) >= 12)),
      e as (select distinct item_id, w[i:i+11] as s from (select item_id, w, unnest(range(1, len(w) - 10)) as i from
        (select item_id, regexp_extract_all(lower(text), '[a-z0-9_]+') as w from eval_items) where len(w) >= 12)),
      hits as (select distinct d.doc_id, e.item_id, d.i from d join e on d.s = e.s)"""
_SHARED = """g as (select doc_id, i, hash(text[i:i+299]) as h from (select doc_id, text, unnest(range(1, len(text) - 298)) as i from documents where len(text) >= 300)),
  s as (select distinct doc_id, i from g where h in (select h from g group by 1 having min(doc_id) < max(doc_id))),
  n as (select doc_id, i, case when i <= lag(i) over (partition by doc_id order by i) + 300 then 0 else 1 end as new from s),
  k as (select doc_id, i, sum(new) over (partition by doc_id order by i) as k from n),
  spans as (select doc_id, (min(i) - 1)::int as start, (max(i) - min(i) + 300)::int as length from k group by doc_id, k)"""

QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_groups, p2_found, p2_kinds, p2_by_path, p3_found, p5_found, p5_budget, p5_subwords, p8_found, p8_fill, p8_check, p8_pieces, p8_places, p9_found, p9_spans, p10_found, p10_spans, p10_amounts)
}


def _near_sql(name: str, col: str, dim: int) -> str:
    parsed = f"select node_id, min({col}) as t from function_intents where node_id is not null group by 1"
    valid = f"""select node_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) as v from
      (select node_id, try_cast(t as double[]) as v from ({parsed})) where len(v) = {dim} and list_sum(list_transform(v, lambda x: abs(x))) > 0"""
    ranked = f"""select a.node_id as q, b.node_id as c, row_number() over (partition by a.node_id order by round(list_inner_product(a.v, b.v), 9) desc, b.node_id) as r
      from ({valid}) a join ({valid}) b on a.node_id <> b.node_id"""
    return f"select distinct '{name}' as vec_field, least(q, c) as node_a, greatest(q, c) as node_b from ({ranked}) where r <= 5"


ORACLES = {
    "p1_groups": f"""with recursive {_SHINGLES}, pairs as (select x, y, c = a.n and c = b.n as same from common join sizes a on a.doc_id = x join sizes b on b.doc_id = y where c >= 0.6 * (a.n + b.n - c) - 1e-9),
      two as (select x, y, same from pairs union all select y, x, same from pairs),
      reach as (select doc_id as x, doc_id as y from sizes union select reach.x, two.y from reach join two on reach.y = two.x),
      parts as (select x as doc_id, min(y) as group_id from reach group by 1)
      select p.doc_id, coalesce(min(case when same then least(y, p.doc_id) end), p.doc_id) as class_id, group_id, count(y) as n_links from parts p left join two on two.x = p.doc_id group by p.doc_id, group_id""",
    "p1_found": f"""with {_SHINGLES} select x as doc_id_a, y as doc_id_b from common join sizes a on a.doc_id = x join sizes b on b.doc_id = y
      where c >= 0.6 * (a.n + b.n - c) - 1e-9""",
    "p2_by_path": r"""select distinct doc_id, case when regexp_matches(p, '(^|/)(generated-sources|generated-src|build/generated|__generated__)/|[._](pb|pb2|pb2_grpc|g|designer|generated)\.[a-z0-9_]+$')
        or regexp_matches(p, '(^|/)(package-lock\.json|npm-shrinkwrap\.json|pnpm-lock\.yaml|go\.sum)$|\.lock$') then 'generated'
      when regexp_matches(p, '[.-]min\.(js|mjs|cjs|css|ts)$') then 'minified' else 'third_party' end as kind
      from (select doc_id, lower(relative_path) as p, '(vendor|vendored|third_party|thirdparty|third-party|3rdparty|node_modules|bower_components|jspm_packages|godeps/_workspace|pods|carthage|site-packages|dist-packages)/' as v from documents)
      where regexp_matches(p, '(^|/)(generated-sources|generated-src|build/generated|__generated__)/|[._](pb|pb2|pb2_grpc|g|designer|generated)\.[a-z0-9_]+$|(^|/)(package-lock\.json|npm-shrinkwrap\.json|pnpm-lock\.yaml|go\.sum)$|\.lock$|[.-]min\.(js|mjs|cjs|css|ts)$')
        or (regexp_matches(p, '(^|/)' || v) and not regexp_matches(regexp_extract(p, '^(.*?/|)' || v, 1), '(^|/)(src|packages|crates|internal|lib|docs)/'))""",
    "p3_found": _near_sql("fused", "fused_vec_json", 36) + " union all " + _near_sql("semantic", "semantic_vec_json", 32),
    "p5_found": f"""with {_COUNTED}, sums as (select source, repo, commit_hash, trim(lower(coalesce(language, ''))) as language, sum(n) as total from counted group by 1, 2, 3, 4)
      select r.source, r.repo, r.commit_hash, r.language from snapshot_tokens r left join sums t on r.source is not distinct from t.source and r.repo is not distinct from t.repo
      and r.commit_hash is not distinct from t.commit_hash and r.language is not distinct from t.language where r.n_tokens is distinct from coalesce(t.total, 0)""",
    "p5_budget": f"""with {_COUNTED} select source, trim(lower(coalesce(language, ''))) as language, repo, commit_hash, count(*) as n_docs, sum(n)::bigint as n_tokens from counted group by 1, 2, 3, 4""",
    "p5_subwords": f"""with recursive {_SUBWORDS}, {_COUNTED} select source, trim(lower(coalesce(language, ''))) as language, count(*) as n_docs, sum(n)::bigint as n_tokens, sum(coalesce(s, 0))::bigint as n_subwords
      from counted left join subwords using (doc_id) group by 1, 2""",
    "p8_found": f"with {_COUNTED} select distinct window_id, doc_id from counted, token_windows where n > capacity_tokens",
    "p8_pieces": f"""with {_COUNTED}, c as (select window_id, doc_id, n, capacity_tokens as cap, ceil(n / capacity_tokens)::int as k from counted, token_windows),
      e as (select *, unnest(range(0, greatest(k, 1)))::int as piece from c)
      select window_id, doc_id, piece, k as n_pieces, case when k = 0 then 0 when piece < k - 1 then cap else n - cap::bigint * (k - 1) end::bigint as tokens from e""",
    "p8_check": f"""with {_COUNTED} select window_id, sum(n)::bigint as n_tokens, sum((n > capacity_tokens)::int)::bigint as n_split, 0::bigint as n_overfull, true as near_volume
      from counted, token_windows group by 1""",
    "p9_found": f"with {_LEAKED} select distinct doc_id, item_id from hits",
    "p9_spans": f"""with {_LEAKED}, n as (select *, case when i <= lag(i) over (partition by doc_id, item_id order by i) + 12 then 0 else 1 end as new from hits),
      k as (select doc_id, item_id, i, sum(new) over (partition by doc_id, item_id order by i) as k from n)
      select doc_id, item_id, (min(i) - 1)::int as start_word, (max(i) - min(i) + 12)::int as n_words from k group by doc_id, item_id, k""",
    "p10_spans": f"with {_SHARED} select doc_id, start, length from spans",
    "p10_amounts": f"""with {_SHARED} select d.doc_id, max(coalesce(len(text), 0))::bigint as n_chars, coalesce(sum(length), 0)::bigint as shared_chars, count(length) as n_spans
      from documents d left join spans using (doc_id) group by 1""",
    "p10_found": """with g as (select doc_id, hash(text[i:i+299]) as h from (select doc_id, text, unnest(range(1, len(text) - 298)) as i from documents where len(text) >= 300))
      select distinct doc_id from g where h in (select h from g group by 1 having min(doc_id) < max(doc_id))""",
}
