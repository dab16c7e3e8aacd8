"""Queries of the code graph, communities, isolated nodes and edge repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gneiss.operators import communities as com
from gneiss.operators import explore, graph, text, vectors
from gneiss.plans import canonical as c
from gneiss.plans.canonical import with_sql
from gneiss.runtime import materialise

_LEAST = 0.35
_FINE = 0.6
_SURE_CALLS = "edge_type = 'calls' and confidence >= 0.95"


def g_nodes(s: SparkSession, d: str) -> DataFrame:
    return graph.build_nodes(c.symbols(s, d), c.occurrences(s, d), c.documents(s, d))


def g_belongs_to(s: SparkSession, d: str) -> DataFrame:
    return graph.belongs_to(c.symbols(s, d), c.nodes(s, d))


def g_relation_edges(s: SparkSession, d: str) -> DataFrame:
    return graph.relation_edges(c.edges(s, d), c.nodes(s, d))


def g_occurrence_edges(s: SparkSession, d: str) -> DataFrame:
    return graph.occurrence_edges(c.occurrences(s, d), c.nodes(s, d))


def g_new_edges(s: SparkSession, d: str) -> DataFrame:
    """Occurrence edges that the edge table does not have yet."""
    return graph.occurrence_edges(c.occurrences(s, d), c.nodes(s, d), c.edges(s, d))


def g_degrees(s: SparkSession, d: str) -> DataFrame:
    return graph.degrees(c.nodes(s, d), c.edges(s, d))


def g_degrees_calls(s: SparkSession, d: str) -> DataFrame:
    return graph.degrees(c.nodes(s, d), c.edges(s, d), "calls")


def _seed(s: SparkSession, d: str) -> DataFrame:
    return c.nodes(s, d).join(c.busiest_symbol(s, d), "symbol_id", "left_semi").select("node_id")


def g_khop(s: SparkSession, d: str) -> DataFrame:
    return graph.k_hop(c.edges(s, d), _seed(s, d), "calls", 2)


def g_subgraph(s: SparkSession, d: str) -> DataFrame:
    return graph.subgraph(c.edges(s, d), c.nodes(s, d), _seed(s, d), "field_refs", 1)


def g_components(s: SparkSession, d: str) -> DataFrame:
    e = c.edges(s, d).filter("edge_type in ('belongs_to', 'extends', 'implements')")
    return graph.connected_components(e, "src_node", "dst_node")


def g_edge_ids(s: SparkSession, d: str) -> DataFrame:
    e = c.edges(s, d)
    return e.select("edge_id", (graph.edge_id("src_node", "dst_node", "edge_type") == F.col("edge_id")).alias("matches")).groupBy("matches").agg(F.count("*").alias("n"))


def _functions(s: SparkSession, d: str) -> DataFrame:
    """(node, vec, path) of the functions with a valid semantic vector and a current node."""
    i = c.intents(s, d).select(F.col("node_id").alias("node"), vectors.parsed_vector("semantic_vec_json", 32).alias("vec")).filter("vec is not null")
    return i.join(c.nodes(s, d).select(F.col("node_id").alias("node"), "path"), "node")


def _topology(s: SparkSession, d: str) -> DataFrame:
    f = _functions(s, d).select("node")
    t = com.topology_pairs(c.edges(s, d))
    return t.join(f.select(F.col("node").alias("a")), "a", "left_semi").join(f.select(F.col("node").alias("b")), "b", "left_semi")


def _graph(s: SparkSession, d: str) -> DataFrame:
    """Candidates by meaning (the 20 nearest of every function over all functions) and by calls; written once."""
    f = materialise(_functions(s, d), "functions")
    return materialise(com.candidate_graph(com.semantic_pairs(f.select("node", "vec")), _topology(s, d), f.select("node", "vec"), f.select("node", "path")), "candidates")


def g_topology(s: SparkSession, d: str) -> DataFrame:
    return _topology(s, d)


def g_candidate_graph(s: SparkSession, d: str) -> DataFrame:
    return _graph(s, d)


def g_communities(s: SparkSession, d: str) -> DataFrame:
    return com.communities(_graph(s, d), _functions(s, d), _LEAST)


def g_cohesion(s: SparkSession, d: str) -> DataFrame:
    g = _graph(s, d)
    return com.cohesion(com.communities(g, _functions(s, d), _LEAST), g)


def g_dominant_role(s: SparkSession, d: str) -> DataFrame:
    labels = c.intents(s, d).select(F.col("node_id").alias("node"), F.col("role_in_chain").alias("role"))
    return com.dominant(com.communities(_graph(s, d), _functions(s, d), _LEAST), labels)


def g_metrics(s: SparkSession, d: str) -> DataFrame:
    """Communities, singletons and their share."""
    m = com.communities(_graph(s, d), _functions(s, d), _LEAST).groupBy("community").agg(F.count("*").alias("n"))
    return m.agg(F.count("*").alias("n_communities"), F.sum((F.col("n") == 1).cast("long")).alias("n_singletons"), F.sum("n").alias("n_nodes"), F.round(F.avg((F.col("n") == 1).cast("double")), 6).alias("singleton_ratio"))


def g_modular_communities(s: SparkSession, d: str) -> DataFrame:
    return com.modular_communities(_graph(s, d), _functions(s, d))


def g_modularity(s: SparkSession, d: str) -> DataFrame:
    """Modularity of the communities by close links."""
    g = _graph(s, d)
    return com.modularity(g, com.communities(g, _functions(s, d), _FINE))


def g_stability(s: SparkSession, d: str) -> DataFrame:
    g, f = _graph(s, d), _functions(s, d)
    return com.stability(*(com.communities(g, f, x) for x in (_LEAST, 0.45)))


def g_objective(s: SparkSession, d: str) -> DataFrame:
    """The run records of two resolutions, against an earlier run with another; the better one is selected."""
    g, f = _graph(s, d), materialise(_functions(s, d), "functions")
    return com.sweep(g, f, [_LEAST, 0.45], com.communities(g, f, 0.4))[0]


def g_summary(s: SparkSession, d: str) -> DataFrame:
    """What the community store keeps of each community."""
    g = _graph(s, d)
    labels = c.intents(s, d).select(F.col("node_id").alias("node"), F.col("role_in_chain").alias("role"), F.from_json("intent_tags_json", "array<string>").alias("tags"))
    return com.community_summary(com.communities(g, _functions(s, d), _LEAST), g, labels).withColumn("tags", F.array_join("tags", ","))


def g_intent_roles(s: SparkSession, d: str) -> DataFrame:
    deg = graph.degrees(c.nodes(s, d), c.edges(s, d), "calls")
    n = c.nodes(s, d).filter("node_type = 'method'").select("node_id", "path", "signature")
    role = com.role_in_chain(F.col("fan_in"), F.col("fan_out"))
    norm = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(x) / 10.0))
    joined = n.join(deg, "node_id").withColumn("role", role)
    intent = F.concat("signature", F.lit(" acts as "), "role", F.lit(" in "), "path")
    return joined.select("node_id", "role", "fan_in", "fan_out", norm("fan_in").alias("t_in"), norm("fan_out").alias("t_out"), intent.alias("intent_text"), F.sha1(F.concat_ws("|", "node_id", "signature", F.lit("sketch-v1"), F.lit("p1"))).alias("cache_key"))


def g_intent_vectors(s: SparkSession, d: str) -> DataFrame:
    """The fused vector of every function intent, place by place, and the sum of its semantic part."""
    v = com.fused_vectors(c.intents(s, d).select("node_id", "intent_text", "fan_in", "fan_out", "chain_depth"))
    return v.select("node_id", F.round(F.aggregate("semantic", F.lit(0.0), lambda a, x: a + x), 6).alias("semantic_sum"), *(F.col("fused")[32 + i].alias(f"t{i}") for i in range(4)), F.size("fused").alias("dim"))


def j_neighbour_context(s: SparkSession, d: str) -> DataFrame:
    """The three heaviest callees of every function, with their intent where there is one."""
    calls = c.edges(s, d).filter("edge_type = 'calls'").join(c.nodes(s, d).select(F.col("node_id").alias("dst_node"), "signature"), "dst_node", "left").join(c.intents(s, d).select(F.col("node_id").alias("dst_node"), "intent_text"), "dst_node", "left")
    ranked = calls.withColumn("r", F.row_number().over(Window.partitionBy("src_node").orderBy(F.desc("weight"), "dst_node", "edge_id"))).filter("r <= 3")
    return ranked.select("src_node", "dst_node", "r", "signature", "intent_text")


def _similarity(s: SparkSession, d: str, alone: DataFrame) -> DataFrame:
    """Mean of the five largest similarities of the isolated nodes that have a vector to all functions."""
    f = materialise(_functions(s, d).select("node", "vec"), "functions")
    asked = f.join(alone.select(F.col("node_id").alias("node")), "node", "left_semi")
    near = vectors.nearest_vectors(f, 5, asked)
    return near.groupBy(F.col("node").alias("node_id")).agg(F.round(F.avg("sim"), 6).alias("sim"))


def _alone(s: SparkSession, d: str, edges: str = "true") -> DataFrame:
    """Current nodes that no edge (of the condition) touches."""
    deg = graph.degrees(c.nodes(s, d), c.edges(s, d).filter(edges)).filter("fan_in + fan_out = 0")
    return c.nodes(s, d).select("node_id", "path").join(deg, "node_id")


def g_isolated(s: SparkSession, d: str) -> DataFrame:
    alone = materialise(_alone(s, d), "alone")
    return com.isolated_types(alone, _similarity(s, d, alone))


def g_isolated_calls(s: SparkSession, d: str) -> DataFrame:
    """Classified anew over calls alone, as for a repair, and of these over the sure ones."""
    alone = materialise(_alone(s, d, _SURE_CALLS), "alone")
    return com.isolated_types(alone, _similarity(s, d, alone))


def _classified(s: SparkSession, d: str) -> DataFrame:
    """(node, vec, path, isolated_type) of the functions that no sure call touches."""
    kinds = g_isolated_calls(s, d).select(F.col("node_id").alias("node"), "isolated_type")
    return materialise(_functions(s, d).join(kinds, "node"), "classified")


def g_repair(s: SparkSession, d: str) -> DataFrame:
    """Edges proposed for the functions classified as MissingEdge."""
    lost = _classified(s, d).filter("isolated_type = 'MissingEdge'").select("node", "vec", "path")
    return com.repair_edges(lost, _functions(s, d), c.edges(s, d).filter("edge_type = 'calls'"))


def g_singletons(s: SparkSession, d: str) -> DataFrame:
    """Communities of the functions that no sure call touches, among the communities of two or more others."""
    f = materialise(_functions(s, d), "functions")
    m = com.communities(_graph(s, d), f, _FINE)
    lone = _classified(s, d)
    inside = m.join(lone.select("node"), "node", "left_anti")
    large = inside.groupBy("community").agg(F.count("*").alias("n")).filter("n > 1").select("community")
    return com.assign_isolated(lone, inside.join(large, "community").join(f, "node"), c.edges(s, d))


def g_ratios(s: SparkSession, d: str) -> DataFrame:
    """Shares of isolated, uncertain and forced nodes among all current ones, by calls."""
    kinds, forced = g_isolated_calls(s, d), g_singletons(s, d).agg(F.count("*").alias("n_forced"))
    n = c.nodes(s, d).agg(F.count("*").alias("n_nodes"))
    k = kinds.agg(F.count("*").alias("n_isolated"), F.sum((F.col("isolated_type") == "Uncertain").cast("long")).alias("n_uncertain"))
    joined = n.crossJoin(F.broadcast(k)).crossJoin(F.broadcast(forced))
    share = lambda x, y: F.round(F.coalesce(F.col(x), F.lit(0)) / F.greatest(F.lit(1), F.col(y)), 6).alias(x.replace("n_", "") + "_ratio")
    return joined.select("n_nodes", "n_isolated", "n_uncertain", "n_forced", share("n_isolated", "n_nodes"), share("n_uncertain", "n_isolated"), share("n_forced", "n_isolated"))


def g_seed_nodes(s: SparkSession, d: str) -> DataFrame:
    """The three best connected members of every community of two or more."""
    m = com.communities(_graph(s, d), _functions(s, d), _LEAST).withColumnRenamed("node", "node_id")
    deg = graph.degrees(c.nodes(s, d), c.edges(s, d)).select("node_id", (F.col("fan_in") + F.col("fan_out")).alias("degree"))
    r = m.join(deg, "node_id").withColumn("r", F.row_number().over(Window.partitionBy("community").orderBy(F.desc("degree"), "node_id")))
    return r.filter("r <= 3").select("community", "node_id", "degree", "r")


def g_explore(s: SparkSession, d: str) -> DataFrame:
    """Functions found by intent, fused over two query parts by reciprocal rank, and the nodes one call around the best three."""
    from gneiss.operators import fusion, symbols

    parts = {"structure": "frozen catalog", "keyword": "buffer queue"}
    channels = {k: fusion.ranked(symbols.search_intents(c.intents(s, d), c.nodes(s, d), q, 20).select(F.col("node_id").alias("result_id"), "score")) for k, q in parts.items()}
    seeds = fusion.rrf(channels, 3).select("result_id")
    return graph.k_hop(c.edges(s, d), seeds, "calls", 1)


def _modules(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Communities of functions by close links, as modules and members."""
    g, f = _graph(s, d), materialise(_functions(s, d), "functions")
    m = materialise(com.communities(g, f, _FINE), "members")
    labels = c.intents(s, d).select(F.col("node_id").alias("node"), F.col("role_in_chain").alias("role"), F.from_json("intent_tags_json", "array<string>").alias("tags"))
    kept = materialise(com.community_summary(m, g, labels), "modules")
    modules = kept.select("community", F.col("summary").alias("intent"), "tags", F.array_join("tags", " ").alias("backbone"), "cohesion")
    return modules, m.join(kept.select("community", "cohesion"), "community").select("community", F.col("node").alias("node_id"), F.lit(1.0).alias("assign_score"), "cohesion")


_MODULE_Q = "entry leaf"


def _module_channel(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    modules, members = _modules(s, d)
    hits = materialise(explore.search_modules(modules, _MODULE_Q, 5), "hits")
    seeds = explore.community_seeds(members.join(hits.select("community"), "community", "left_semi"), graph.degrees(c.nodes(s, d), c.edges(s, d)), 3)
    return hits, explore.module_seeds(hits, seeds)


def g_module_search(s: SparkSession, d: str) -> DataFrame:
    return _module_channel(s, d)[0]


def g_module_seeds(s: SparkSession, d: str) -> DataFrame:
    return _module_channel(s, d)[1]


def g_semantic_seeds(s: SparkSession, d: str) -> DataFrame:
    from gneiss.plans.retrieval_queries import _semantic

    symbols = c.occurrences(s, d).filter("role = 'definition'").groupBy(F.col("document_id").alias("chunk_id")).agg(F.collect_set("symbol_id").alias("primary_symbols"))
    hits = _semantic(s, d).withColumnRenamed("result_id", "chunk_id")
    return explore.semantic_seeds(hits, symbols, c.nodes(s, d), 8)


def _fused_seeds(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    from gneiss.operators import symbols

    hits, modules = _module_channel(s, d)
    functions = symbols.search_intents(c.intents(s, d), c.nodes(s, d), "frozen catalog", 8).select("node_id", "score")
    channels = {"module": modules, "function": functions, "semantic": g_semantic_seeds(s, d)}
    return hits, explore.select_seeds(explore.fuse_seeds(channels), 0.0, 13)


def g_explore_seeds(s: SparkSession, d: str) -> DataFrame:
    return _fused_seeds(s, d)[1].withColumn("score", F.round("score", 9))


def g_explore_all(s: SparkSession, d: str) -> DataFrame:
    hits, seeds = _fused_seeds(s, d)
    return explore.explore(c.edges(s, d), seeds, hits.limit(1).count() > 0)[0]


def g_explore_symbol(s: SparkSession, d: str) -> DataFrame:
    return explore.explore_symbol(c.edges(s, d), c.nodes(s, d), c.busiest_symbol(s, d).first()[0])


def g_intent_subgraph(s: SparkSession, d: str) -> DataFrame:
    """Members of the three largest communities."""
    modules, members = _modules(s, d)
    largest = [r[0] for r in members.groupBy("community").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "community").limit(3).collect()]
    return explore.intent_subgraph(members, modules, largest)


QUERIES = {f.__name__: f for f in (
    g_nodes, g_belongs_to, g_relation_edges, g_occurrence_edges, g_new_edges, g_degrees, g_degrees_calls, g_khop, g_subgraph, g_components, g_edge_ids, g_topology, g_candidate_graph, g_communities, g_cohesion,
    g_dominant_role, g_modular_communities, g_modularity, g_metrics, g_stability, g_objective, g_intent_roles, g_intent_vectors, j_neighbour_context, g_summary, g_isolated, g_isolated_calls, g_repair, g_singletons, g_ratios, g_seed_nodes, g_explore,
    g_module_search, g_module_seeds, g_semantic_seeds, g_explore_seeds, g_explore_all, g_explore_symbol, g_intent_subgraph,
)}

_INSIDE = "(r.line > w.sl or (r.line = w.sl and r.col >= w.sc)) and (r.line < w.el or (r.line = w.el and r.col <= w.ec))"
_OCC = f"""tn as (select symbol_id, node_id, node_type from n where node_type in ('method', 'field')),
  r as (select o.document_id, o.id, range_start_line as line, range_start_col as col, tn.node_id as dst_node, tn.node_type as t from o join tn using (symbol_id) where role <> 'definition'),
  sn as (select symbol_id, node_id, case when node_type = 'method' then 'm' else 't' end as sort from n where node_type in ('method', 'class', 'interface')),
  lw as (select document_id, max(greatest(range_end_line, enclosing_range_end_line)) as last from o group by 1),
  w0 as (select o.document_id, sort, sn.node_id as src, enclosing_range_start_line >= 0 and enclosing_range_end_line >= enclosing_range_start_line as has, o.* exclude (document_id) from o join sn using (symbol_id) where role = 'definition'),
  w1 as (select document_id, sort, src, has, case when has then enclosing_range_start_line else range_start_line end as sl, case when has then enclosing_range_start_col else range_start_col end as sc,
    case when has then enclosing_range_end_line else range_end_line end as el, case when has then enclosing_range_end_col else range_end_col end as ec from w0),
  w as (select document_id, sort, src, sl, case when has then sc else 0 end as sc, case when has then el else greatest(el, coalesce(greatest(sl, nxt - 1), last)) end as el, case when has then ec else 1000000 end as ec
    from (select *, lead(sl) over (partition by document_id, sort order by sl, sc, src) as nxt from w1) join lw using (document_id)),
  bm as (select r.*, w.src, w.sort from r join w on r.document_id = w.document_id and {_INSIDE} qualify row_number() over (partition by r.document_id, r.id, r.dst_node, w.sort order by (w.el - w.sl) * 1000000 + (w.ec - w.sc), w.sl, w.sc, w.src) = 1),
  b as (select document_id, id, dst_node, t, case when t = 'field' then coalesce(max(case when sort = 'm' then src end), max(case when sort = 't' then src end)) else max(case when sort = 'm' then src end) end as src from bm group by 1, 2, 3, 4)"""
_HOPS = """bo as (select src_node as a, dst_node as b from e where edge_type = '{t}' union select dst_node, src_node from e where edge_type = '{t}'),
  seed as (select node_id from n where symbol_id in (select symbol_id from busy)), h0 as (select node_id as node from seed), h1 as (select distinct b as node from bo where a in (select node from h0)), h2 as (select distinct b as node from bo where a in (select node from h1)),
  hops as (select node, min(h)::int as hop from (select node, 0 as h from h0 union all select node, 1 from h1 union all select node, 2 from h2) group by 1)"""
_F = """f as (select i.node_id as node, v as vec, n.path from (select node_id, try_cast(semantic_vec_json as double[]) as v from i) i join n on n.node_id = i.node_id where len(v) = 32 and len(list_filter(v, lambda x: x is null)) = 0 and len(list_filter(v, lambda x: x <> 0)) > 0),
  topo as (select distinct least(src_node, dst_node) as a, greatest(src_node, dst_node) as b from e where edge_type = 'calls' and src_node <> dst_node and src_node in (select node from f) and dst_node in (select node from f))"""
_PRIOR = "least(1.0::double, len(list_filter(range(1, 1 + least(len(string_split({a}, '/')), len(string_split({b}, '/')))), lambda k: string_split({a}, '/')[1:k] = string_split({b}, '/')[1:k])) / 4.0)::double"
_NEAR = """nb as (select x.node as q, y.node as c, round(list_inner_product(x.vec, y.vec), 9) as sim, row_number() over (partition by x.node order by round(list_inner_product(x.vec, y.vec), 9) desc, y.node) as r from f x join f y on x.node <> y.node)"""
_G = f"""{_F}, {_NEAR}, pr as (select distinct least(q, c) as a, greatest(q, c) as b from nb where r <= 20 union select a, b from topo),
  g as (select * from (select pr.a, pr.b, round(0.5::double * (t.a is not null)::int + 0.4::double * greatest(0.0, round(list_inner_product(x.vec, y.vec), 9)) + 0.1::double * {_PRIOR.format(a='x.path', b='y.path')}, 6) as weight
    from pr join f x on x.node = pr.a join f y on y.node = pr.b left join topo t on t.a = pr.a and t.b = pr.b) where weight > 0.05)"""


def _comm(name: str, least: float) -> str:
    return f"""{name}_l as (select a, b from g where weight >= {least} union select b, a from g where weight >= {least}),
      {name}_r as (select node as a, node as b from f union select r.a, l.b from {name}_r r join {name}_l l on l.a = r.b), {name} as (select a as node, min(b) as community from {name}_r group by 1)"""


_COH = """{n}_k as (select z.community, z.size, round(coalesce(w.w, 0.0), 6) as cohesion from (select community, count(*) as size from {n} group by 1) z
  left join (select x.community, avg(weight) as w from g join {n} x on x.node = g.a join {n} y on y.node = g.b where x.community = y.community group by 1) w on w.community = z.community)"""
_ALONE = "alone as (select n.node_id, n.path from n where node_id not in (select src_node from e where {t}) and node_id not in (select dst_node from e where {t}))"
_TYPES = """kinds as (select node_id, case when unsure then 'Uncertain' else t end as isolated_type, least(1.0, case when unsure then greatest(best, 0.45) else best end)::double as confidence from
  (select *, best < 0.5 or round(best - second, 9) < 0.1 as unsure from (select node_id, sc[1].s as best, sc[2].s as second, sc[1].t as t from (select node_id, list_sort([struct_pack(m := -be, i := 0, t := 'BoundaryExternal', s := be), struct_pack(m := 0.0::double, i := 1, t := 'Entrypoint', s := 0.0::double),
    struct_pack(m := -tl, i := 2, t := 'TrueLeaf', s := tl), struct_pack(m := -me, i := 3, t := 'MissingEdge', s := me), struct_pack(m := -nn, i := 4, t := 'NoiseNode', s := nn)]) as sc from
    (select a.node_id, case when contains(a.path, 'third_party/') then 0.7::double else 0.0::double end as be, case when coalesce(sim, 0) >= 0.5 then 0.2::double else 0.0::double end as tl, case when coalesce(sim, 0) >= 0.65 then 1.0::double else 0.0::double end as me, case when coalesce(sim, 0) < 0.35 then 1.0::double else 0.0::double end as nn
     from alone a left join (select q as node_id, round(avg(sim), 6) as sim from nb where r <= 5 group by 1) using (node_id)))))),
  lone as (select f.*, isolated_type from f join kinds on kinds.node_id = f.node)"""
_ASSIGNED = f"""ins as (select c1.node, c1.community, f.vec, f.path from c1 join f using (node) where node not in (select node from lone) and community in (select community from c1 where node not in (select node from lone) group by 1 having count(*) > 1)),
  mean as (select l.node, m.community, avg(list_inner_product(l.vec, m.vec)) as cos, max({_PRIOR.format(a='l.path', b='m.path')}) as prior from lone l, ins m where isolated_type not in ('BoundaryExternal', 'TrueLeaf', 'NoiseNode') group by 1, 2),
  best as (select node, community, score, row_number() over (partition by node order by score desc, community) as r from (select node, community, round(0.6 * cos + 0.1 * prior, 6) as score from mean)),
  given as (select node, community, score, 'forced' as mode from best join lone using (node) where r = 1 and score >= case isolated_type when 'Uncertain' then 0.65 when 'Entrypoint' then 0.60 else 0.55 end
    union all select node, 'intent:community:ExternalBoundary', 1.0, 'external_boundary' from lone where isolated_type = 'BoundaryExternal')"""
_CALLS_ALONE = _ALONE.format(t=_SURE_CALLS)
_ROLE = "case when deg.fan_in = 0 and deg.fan_out = 0 then 'isolated' when deg.fan_in = 0 then 'entrypoint' when deg.fan_out = 0 then 'leaf' when deg.fan_out >= 5 then 'orchestrator' else 'core' end"


def _deg(t: str = "true") -> str:
    return f"deg as (select n.node_id, coalesce(x.c, 0) as fan_in, coalesce(y.c, 0) as fan_out from n left join (select dst_node, count(*) as c from e where {t} group by 1) x on x.dst_node = n.node_id left join (select src_node, count(*) as c from e where {t} group by 1) y on y.src_node = n.node_id)"


def _intent(q: str) -> str:
    terms = " + ".join(f"contains(lower(coalesce(intent_text, '')), '{t}')::double" for t in q.split())
    return f"select node_id, row_number() over (order by score desc, node_id) as rank from (select * from (select i.node_id, quality_score, case when contains(lower(coalesce(intent_text, '')), '{q}') then 2.0 else 0.0 end + {terms} as score from i join n using (node_id)) where score > 0 order by score desc, quality_score desc nulls last, node_id limit 20)"


_KIND = """case when k like '%package%' or k = 'module' then 'package' when k like '%annotation%' or k like '%interface%' then 'interface' when regexp_matches(k, 'constructor|method|function') then 'method'
  when regexp_matches(k, 'field|property|constant') then 'field' when regexp_matches(k, 'class|enum|struct|object|type') then 'class' else 'symbol' end"""

_MODULES = f"""{_G}, {_comm('c1', _FINE)}, {_COH.format(n='c1')}, {_deg()},
  mt as (select community, list_sort(list(distinct t)) as tags from (select community, unnest(try_cast(intent_tags_json as varchar[])) as t from c1 join i on i.node_id = c1.node) where t is not null group by 1),
  mr as (select community, role from (select community, role_in_chain as role, row_number() over (partition by community order by count(*) desc, role_in_chain) as rn from c1 join i on i.node_id = c1.node group by 1, 2) where rn = 1),
  mo as (select k.community, 'Community of ' || k.size || ' functions, mostly ' || coalesce(mr.role, 'unknown') as intent, coalesce(tags, []) as tags, k.cohesion, k.size from c1_k k left join mr on mr.community = k.community left join mt on mt.community = k.community)"""
_MODULE_HITS = _MODULES + ", mh as (select community, score, cohesion from (select community, cohesion, " + " + ".join(
    [f"{w} * (case when contains(lower({x}), '{_MODULE_Q}') then 2.0 else 0.0 end + " + " + ".join(f"contains(lower({x}), '{t}')::double" for t in _MODULE_Q.split()) + ")" for w, x in ((1.0, "intent"), (0.35, "array_to_string(tags, ' ')"))]
    + [f"0.5 * (len(list_filter(tags, lambda t: contains(lower(t), '{t}'))) > 0)::double" for t in _MODULE_Q.split()]
) + """ as score from mo) where score > 0 order by score desc, cohesion desc, community limit 5),
  ms as (select node_id, max(score + 0.2) as score from (select mh.community, mh.score, c1.node as node_id, row_number() over (partition by mh.community order by fan_in + fan_out desc, c1.node) as r from mh join c1 on c1.community = mh.community join deg on deg.node_id = c1.node) where r <= 3 group by 1)"""


def _semantic_seed_sql() -> str:
    from gneiss.plans.retrieval_queries import _SEM

    return f"""{_SEM}, ss as (select coalesce(n.node_id, o.symbol_id) as node_id, max(score) as score from sem sh join o on o.document_id = sh.result_id left join n on n.symbol_id = o.symbol_id where role = 'definition' group by 1 order by 2 desc, 1 limit 8)"""


def _fused_sql() -> str:
    return f"""{_MODULE_HITS}, {_semantic_seed_sql()}, fn as ({_intent('frozen catalog').replace('limit 20', 'limit 8').replace('row_number() over (order by score desc, node_id) as rank', 'score')}),
      ac as (select node_id, 1.0 / (60 + row_number() over (order by score desc, node_id)) as s, 'module' as src from ms union all select node_id, 1.0 / (60 + row_number() over (order by score desc, node_id)), 'function' from fn union all select node_id, 1.0 / (60 + row_number() over (order by score desc, node_id)), 'semantic' from ss),
      fu as (select node_id, sum(s)::double as score, string_agg(distinct src, ',' order by src) as sources from ac group by 1 order by round(sum(s)::double, 9) desc, node_id limit 13)"""


ORACLES = {
    "g_module_search": with_sql("n e i", "select community, score::double as score, cohesion from mh", _MODULE_HITS, True),
    "g_module_seeds": with_sql("n e i", "select node_id, score::double as score from ms", _MODULE_HITS, True),
    "g_semantic_seeds": with_sql("d n o", "select node_id, score from ss", _semantic_seed_sql()),
    "g_explore_seeds": with_sql("d o n e i", "select node_id, round(score, 9) as score, sources from fu", _fused_sql(), True),
    "g_explore_all": with_sql("d o n e i", "select node, min(h)::int as hop from (select node, 0 as h from x0 union all select node, 1 from x1 union all select node, 2 from x2) group by 1", _fused_sql() + """,
      bo as (select src_node as a, dst_node as b from e where edge_type = 'calls' union select dst_node, src_node from e where edge_type = 'calls'), x0 as (select node_id as node from fu), x1 as (select distinct b as node from bo where a in (select node from x0)), x2 as (select distinct b as node from bo where a in (select node from x1))""", True),
    "g_explore_symbol": with_sql("n e busy", "select node, hop from hops", _HOPS.format(t="calls")),
    "g_intent_subgraph": with_sql("n e i", "select c1.node as node_id, mo.community, mo.intent, mo.cohesion, 1.0::double as assign_score from c1 join mo on mo.community = c1.community where mo.community in (select community from mo order by size desc, community limit 3)", _MODULES, True),
    "g_nodes": with_sql("d s o", """select node_id, symbol_id, node_type, path, signature from every union all
      select * from (select 'pkg:' || package as node_id, 'pkg:' || package as symbol_id, 'package' as node_type, min(path) as path, replace(package, '/', '.') as signature from own where t in ('class', 'interface') and coalesce(trim(enclosing_symbol), '') = '' and coalesce(package, '') <> '' group by package) where node_id not in (select node_id from every)""",
      f"""ks as (select *, {_KIND} as t from (select *, lower(coalesce(kind, '')) as k from s)),
      own as (select ks.*, p.path from ks join (select symbol_id, min(relative_path) as path from o join d using (document_id) where role = 'definition' group by 1) p using (symbol_id) where t <> 'symbol'),
      up as (select enclosing_symbol as symbol_id, path from own where enclosing_symbol <> '' union select ks.enclosing_symbol, up.path from up join ks using (symbol_id) where t <> 'symbol' and ks.enclosing_symbol <> '' and symbol_id not in (select symbol_id from own)),
      owners as (select symbol_id, t, min(path) as path, any_value(display_name) as display_name from up join ks using (symbol_id) where t <> 'symbol' and symbol_id not in (select symbol_id from own) group by 1, 2),
      every as (select case when t = 'package' and starts_with(symbol_id, 'pkg:') then symbol_id else case when t = 'package' then 'pkg' when t in ('class', 'interface') then 'type' else t end || ':' || symbol_id end as node_id, symbol_id, t as node_type, path, display_name as signature
        from (select symbol_id, t, path, display_name from own union all select symbol_id, t, path, display_name from owners))""", True),
    "g_belongs_to": with_sql("s n", """select c.node_id as src_node, p.node_id as dst_node from s join n c on c.symbol_id = s.symbol_id join n p on p.symbol_id = s.enclosing_symbol where s.enclosing_symbol <> ''
      union all select c.node_id, 'pkg:' || trim(s.package, '/') from s join n c on c.symbol_id = s.symbol_id where coalesce(s.enclosing_symbol, '') = '' and s.package <> '' and c.node_type in ('class', 'interface')"""),
    "g_relation_edges": with_sql("n e", """select src_node, dst_node, edge_type, max(confidence) as confidence, min(evidence_json) as evidence from (select e.src_node, e.dst_node, case when edge_type = 'implements' and q.node_type <> 'interface' and p.node_type in ('class', 'interface') then 'extends' else edge_type end as edge_type, confidence, evidence_json
      from e join n p on p.node_id = e.src_node join n q on q.node_id = e.dst_node) group by 1, 2, 3"""),
    "g_occurrence_edges": with_sql("n o", "select src as src_node, dst_node, case when t = 'method' then 'calls' else 'field_refs' end as edge_type, count(*) as n, round(least(1.0, 0.35 + 0.1 * count(*))::double, 6) as weight, round(least(0.95, 0.35 + 0.1 * count(*))::double, 6) as confidence from b where src <> dst_node group by 1, 2, 3", _OCC),
    "g_new_edges": with_sql("n o e", "select src as src_node, dst_node, case when t = 'method' then 'calls' else 'field_refs' end as edge_type, count(*) as n, round(least(1.0, 0.35 + 0.1 * count(*))::double, 6) as weight, round(least(0.95, 0.35 + 0.1 * count(*))::double, 6) as confidence from b where src <> dst_node and (src, dst_node, case when t = 'method' then 'calls' else 'field_refs' end) not in (select (src_node, dst_node, edge_type) from e) group by 1, 2, 3", _OCC),
    "g_degrees": with_sql("n e", "select * from deg", _deg()),
    "g_degrees_calls": with_sql("n e", "select * from deg", _deg("edge_type = 'calls'")),
    "g_khop": with_sql("n e busy", "select node, hop from hops", _HOPS.format(t="calls")),
    "g_subgraph": with_sql("n e busy", "select distinct src_node, dst_node, edge_type from e where edge_type = 'field_refs' and src_node in (select node from ok) and dst_node in (select node from ok)", _HOPS.format(t="field_refs") + ", ok as (select node from hops where hop <= 1 and node in (select node_id from n))"),
    "g_components": with_sql("e", "select a as node, min(b) as component from r group by 1", """l as (select src_node as a, dst_node as b from e where edge_type in ('belongs_to', 'extends', 'implements') union select dst_node, src_node from e where edge_type in ('belongs_to', 'extends', 'implements')),
      r as (select a, a as b from l union select r.a, l.b from r join l on l.a = r.b)""", True),
    "g_edge_ids": with_sql("e", "select sha1(concat_ws('|', src_node, dst_node, edge_type)) = edge_id as matches, count(*) as n from e group by 1"),
    "g_topology": with_sql("n e i", "select a, b from topo", _F),
    "g_candidate_graph": with_sql("n e i", "select a, b, weight from g", _G),
    "g_communities": with_sql("n e i", "select node, community from c1", f"{_G}, {_comm('c1', _LEAST)}", True),
    "g_cohesion": with_sql("n e i", "select community, size, cohesion from c1_k", f"{_G}, {_comm('c1', _LEAST)}, {_COH.format(n='c1')}", True),
    "g_dominant_role": with_sql("n e i", "select community, role from (select community, role_in_chain as role, row_number() over (partition by community order by count(*) desc, role_in_chain) as rn from c1 join i on i.node_id = c1.node group by 1, 2) where rn = 1", f"{_G}, {_comm('c1', _LEAST)}", True),
    "g_modularity": with_sql("n e i", "select round(sum(i / t - pow(s / t, 2)), 6) as modularity from (select x.community, sum(case when x.community = y.community then w else 0 end) as i, sum(w) as s from two join c1 x on x.node = a join c1 y on y.node = b group by 1), (select sum(w) as t from two)", f"{_G}, {_comm('c1', _FINE)}, two as (select a, b, weight as w from g union all select b, a, weight from g)", True),
    "g_metrics": with_sql("n e i", "select count(*) as n_communities, count(*) filter (c = 1) as n_singletons, sum(c)::bigint as n_nodes, round(avg((c = 1)::int), 6) as singleton_ratio from (select community, count(*) as c from c1 group by 1)", f"{_G}, {_comm('c1', _LEAST)}", True),
    "g_stability": with_sql("n e i", "select count(*) as pairs, round(avg(((p.x = q.x) = (p.y = q.y))::int), 6) as stability from m p join m q on p.rn - q.rn between 1 and 50", f"{_G}, {_comm('c1', _LEAST)}, {_comm('c2', 0.45)}, m as (select c1.community as x, c2.community as y, row_number() over (order by c1.node) as rn from c1 join c2 using (node))", True),
    "g_objective": with_sql("n e i", """select resolution, n_communities, n_singletons, round(avg_cohesion, 6) as avg_cohesion, stability, objective, row_number() over (order by objective desc, resolution) = 1 as selected
      from (select *, round(0.55 * avg_cohesion + 0.30 * stability - 0.15 * n_singletons / n_communities, 5) as objective from (select * from run1 union all select * from run2))""",
      f"{_G}, {_comm('c0', 0.4)}, {_comm('c1', _LEAST)}, {_comm('c2', 0.45)}, {_COH.format(n='c1')}, {_COH.format(n='c2')}, " + ", ".join(f"""m{k} as (select c0.community as x, c{k}.community as y, row_number() over (order by c0.node) as rn from c0 join c{k} using (node)),
      run{k} as (select {x}::double as resolution, count(*) as n_communities, count(*) filter (size = 1) as n_singletons, avg(cohesion) as avg_cohesion, (select round(avg(((p.x = q.x) = (p.y = q.y))::int), 6) from m{k} p join m{k} q on p.rn - q.rn between 1 and 50) as stability from c{k}_k)""" for k, x in ((1, _LEAST), (2, 0.45))), True),
    "g_intent_roles": with_sql("n e", f"""select n.node_id, {_ROLE} as role, deg.fan_in, deg.fan_out, least(1.0, deg.fan_in / 10.0)::double as t_in, least(1.0, deg.fan_out / 10.0)::double as t_out, n.signature || ' acts as ' || {_ROLE} || ' in ' || n.path as intent_text, sha1(concat_ws('|', n.node_id, n.signature, 'sketch-v1', 'p1')) as cache_key
      from n join deg using (node_id) where n.node_type = 'method'""", _deg("edge_type = 'calls'")),
    "g_intent_vectors": with_sql("i", """select i.node_id, round(coalesce(sv, 0), 6)::double as semantic_sum, least(1.0, coalesce(fan_in, 0) / 10.0)::double as t0, least(1.0, coalesce(fan_out, 0) / 10.0)::double as t1, least(1.0, coalesce(chain_depth, 0) / 10.0)::double as t2,
      case when fan_in = 0 and fan_out > 0 then 1.0 else 0.0 end::double as t3, 36 as dim from i left join (select node_id, sum(v) / sqrt(sum(v * v)) as sv from (select node_id, ('0x' || substr(h, 1, 8))::bigint % 32 as idx, sum(case when ('0x' || substr(h, 9, 2))::bigint % 2 = 0 then 1.0::double else -1.0::double end) as v
        from (select node_id, sha1(unnest(list_filter(regexp_split_to_array(coalesce(intent_text, ''), '\\s+'), lambda t: t <> ''))) as h from i) group by 1, 2) where v <> 0 group by 1) using (node_id)"""),
    "j_neighbour_context": with_sql("n e i", "select src_node, dst_node, r::int as r, signature, intent_text from (select e.src_node, e.dst_node, n.signature, i.intent_text, row_number() over (partition by e.src_node order by e.weight desc nulls last, e.dst_node, e.edge_id) as r from e left join n on n.node_id = e.dst_node left join i on i.node_id = e.dst_node where e.edge_type = 'calls') where r <= 3"),
    "g_isolated": with_sql("n e i", "select * from kinds", f"{_F}, {_NEAR}, {_ALONE.format(t='true')}, {_TYPES}"),
    "g_isolated_calls": with_sql("n e i", "select * from kinds", f"{_F}, {_NEAR}, {_CALLS_ALONE}, {_TYPES}"),
    "g_repair": with_sql("n e i", """select src_node, dst_node, -x.m as confidence, case when x.o = 0 then 'repair_missing_edge' else 'repair_missing_edge_reverse' end as source from (select src_node, dst_node, min(struct_pack(o := o, m := -confidence)) as x from two group by 1, 2)
      where (src_node, dst_node) not in (select (src_node, dst_node) from e where edge_type = 'calls')""", f"""{_F}, {_NEAR}, {_CALLS_ALONE}, {_TYPES},
      cand as (select * from (select *, row_number() over (partition by src_node order by score desc, dst_node) as r from (select x.node as src_node, y.node as dst_node, round(0.85::double * greatest(0.0, list_inner_product(y.vec, x.vec)) + 0.15::double * {_PRIOR.format(a='y.path', b='x.path')}, 6) as score
        from lone x join f y on x.node <> y.node where isolated_type = 'MissingEdge')) where r <= 2 and score >= 0.58),
      two as (select src_node, dst_node, round(least(0.69::double, 0.25 + 0.4::double * score), 6) as confidence, 0 as o from cand union all select dst_node, src_node, round(0.9::double * least(0.69::double, 0.25 + 0.4::double * score), 6), 1 from cand)"""),
    "g_singletons": with_sql("n e i", "select node, community, score::double as score, mode from given", f"{_G}, {_comm('c1', _FINE)}, {_CALLS_ALONE}, {_TYPES}, {_ASSIGNED}", True),
    "g_ratios": with_sql("n e i", """select n_nodes, n_isolated, n_uncertain::bigint as n_uncertain, n_forced, round(n_isolated / greatest(1, n_nodes), 6) as isolated_ratio, round(n_uncertain / greatest(1, n_isolated), 6) as uncertain_ratio, round(n_forced / greatest(1, n_isolated), 6) as forced_ratio
      from (select count(*) as n_nodes from n), (select count(*) as n_isolated, count(*) filter (isolated_type = 'Uncertain') as n_uncertain from kinds), (select count(*) as n_forced from given)""", f"{_G}, {_comm('c1', _FINE)}, {_CALLS_ALONE}, {_TYPES}, {_ASSIGNED}", True),
    "g_summary": with_sql("n e i", """select k.community, k.size, k.cohesion, ro.role, 'Community of ' || k.size || ' functions, mostly ' || coalesce(ro.role, 'unknown') as summary, coalesce(ta.tags, '') as tags from c1_k k
      left join (select community, role from (select community, role_in_chain as role, row_number() over (partition by community order by count(*) desc, role_in_chain) as rn from c1 join i on i.node_id = c1.node group by 1, 2) where rn = 1) ro on ro.community = k.community
      left join (select community, string_agg(t, ',' order by t) as tags from (select distinct community, unnest(try_cast(intent_tags_json as varchar[])) as t from c1 join i on i.node_id = c1.node) where t is not null group by 1) ta on ta.community = k.community""", f"{_G}, {_comm('c1', _LEAST)}, {_COH.format(n='c1')}", True),
    "g_seed_nodes": with_sql("n e i", "select community, node_id, degree, r::int as r from (select c1.community, c1.node as node_id, fan_in + fan_out as degree, row_number() over (partition by c1.community order by fan_in + fan_out desc, c1.node) as r from c1 join deg on deg.node_id = c1.node) where r <= 3", f"{_G}, {_comm('c1', _LEAST)}, {_deg()}", True),
    "g_explore": with_sql("n e i", "select node, min(h)::int as hop from (select id as node, 0 as h from seeds union all select b, 1 from (select src_node as a, dst_node as b from e where edge_type = 'calls' union select dst_node, src_node from e where edge_type = 'calls') where a in (select id from seeds)) group by 1",
      f"q0 as ({_intent('frozen catalog')}), q1 as ({_intent('buffer queue')}), seeds as (select id from (select node_id as id, sum(1.0::double / (60 + rank)) as sc, min(o * 1000 + rank) as f from (select *, 0 as o from q0 union all select *, 1 from q1) group by 1) order by round(sc, 9) desc, f limit 3)"),
}
