"""Graph operators on edge lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gneiss import runtime

#: Links that one task may finish.
LOCAL_LINKS = 20_000


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", local_links: int = LOCAL_LINKS) -> DataFrame:
    """(node, component) with the least node of each undirected component, by alternating large and small stars.

    Every round links nodes to the least node seen from their neighbourhood, which halves path lengths; rounds end when
    the links no longer change, or when at most ``local_links`` (a fixed bound) are left, which one task finishes by
    union-find with the same result.  Links are combined by node before each shuffle, and the centre of a large star is
    joined in salted parts.  Null ends are left out.
    """
    pairs = runtime.materialise(edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a is not null and b is not null"), "pairs")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    links = runtime.materialise(pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    kind = links.schema["a"].dataType.simpleString()
    seen = None
    while True:
        state = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state["n"] <= local_links:
            links = links.coalesce(1).mapInArrow(_union_find, f"a {kind}, b {kind}")
            break
        if seen == state:
            break
        seen = state
        both = links.union(links.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # Large star: every larger neighbour of a node links to the node's least neighbour.
        large = runtime.join_salted(both.filter("b > a"), least, ["a"], ["b"]).filter("b <> m").select(F.col("m").alias("a"), "b").distinct()
        # Small star: a node and its smaller neighbours link to the least of them.
        low = large.groupBy(F.col("b").alias("n")).agg(F.min("a").alias("m"))
        small = large.join(low, large["b"] == low["n"]).select(F.col("m"), F.explode(F.array("a", "b")).alias("b")).filter("b <> m").select(F.col("m").alias("a"), "b").distinct()
        links = runtime.materialise(small, "links")
    return nodes.join(links.select(F.col("b").alias("node"), F.col("a").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _union_find(batches):
    """Links (a, b) of one task as (root, node) for every node that is not its own root."""
    import pyarrow as pa

    up: dict = {}

    def root(x):
        path = []
        while up.setdefault(x, x) != x:
            path.append(x)
            x = up[x]
        for p in path:
            up[p] = x
        return x

    for batch in batches:
        kind = batch.schema.types[0]
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = root(a), root(b)
            if x != y:
                up[max(x, y)] = min(x, y)
    if up:
        rows = [(root(x), x) for x in list(up) if root(x) != x]
        yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in rows], kind), pa.array([x for _, x in rows], kind)], names=["a", "b"])


#: Edge types that graph queries may follow.
QUERYABLE = ("calls", "field_refs", "belongs_to", "extends", "implements")


def k_hop(edges: DataFrame, seeds: DataFrame, edge_type: str, hops: int) -> DataFrame:
    """(node, hop): nodes within ``hops`` undirected steps over one edge type, with the fewest steps; seeds have 0.

    The frontier grows by one join per hop; each hop is written once, so the plan stays flat.
    """
    if edge_type not in QUERYABLE:
        raise ValueError(f"edge type {edge_type!r} can't be queried; one of {', '.join(QUERYABLE)}")
    steps = edges.filter(F.col("edge_type") == edge_type).select(F.col("src_node").alias("a"), F.col("dst_node").alias("b"))
    both = runtime.materialise(steps.unionByName(steps.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "steps")
    seen = seeds.select(F.col(seeds.columns[0]).alias("node"), F.lit(0).alias("hop")).distinct()
    frontier = seen
    for hop in range(1, max(1, hops) + 1):
        near = both.join(frontier.select(F.col("node").alias("a")), "a", "left_semi").select(F.col("b").alias("node")).distinct()
        frontier = runtime.materialise(near.join(seen.select("node"), "node", "left_anti").select("node", F.lit(hop).alias("hop")), "hop")
        seen = seen.unionByName(frontier)
    return seen


def subgraph(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, edge_type: str, hops: int) -> DataFrame:
    """(src_node, dst_node, edge_type): edges of the type between nodes within ``hops`` steps that the node table has."""
    reached = k_hop(edges, seeds, edge_type, hops).select("node").join(nodes.select(F.col("node_id").alias("node")), "node", "left_semi")
    inside = edges.filter(F.col("edge_type") == edge_type).join(reached.select(F.col("node").alias("src_node")), "src_node", "left_semi").join(reached.select(F.col("node").alias("dst_node")), "dst_node", "left_semi")
    return inside.select("src_node", "dst_node", "edge_type").distinct()


def degrees(nodes: DataFrame, edges: DataFrame, edge_type: str | None = None) -> DataFrame:
    """(node_id, fan_in, fan_out) of every node, over all edges or one type; both ends are counted in one pass."""
    kept = edges if edge_type is None else edges.filter(F.col("edge_type") == edge_type)
    ends = kept.select(F.explode(F.array(F.struct(F.col("dst_node").alias("node_id"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("src_node").alias("node_id"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("e"))
    counted = ends.groupBy(F.col("e.node_id").alias("node_id")).agg(F.sum("e.i").alias("fan_in"), F.sum("e.o").alias("fan_out"))
    zero = F.lit(0).cast("long")
    return nodes.select("node_id").join(counted, "node_id", "left").select("node_id", F.coalesce("fan_in", zero).alias("fan_in"), F.coalesce("fan_out", zero).alias("fan_out"))


def edge_id(src: str, dst: str, kind: str):
    return F.sha1(F.concat_ws("|", src, dst, kind))


def build_nodes(symbols: DataFrame, occurrences: DataFrame, documents: DataFrame) -> DataFrame:
    """(node_id, symbol_id, node_type, path, signature): one node per symbol with a definition, at the first of them by
    path, line and column; symbols of no node type are left out; types without an owner add their package's node.

    Owners of nodes get nodes too, and theirs, at the least path of what they own; a round of joins per level of nesting.
    """
    from gneiss.operators import text

    places = occurrences.filter("role = 'definition'").join(documents.select("document_id", "relative_path"), "document_id")
    first = places.groupBy("symbol_id").agg(F.min(F.struct(F.col("relative_path").alias("path"), "range_start_line", "range_start_col")).alias("at"))
    kinds = symbols.withColumn("node_type", text.node_type("kind")).filter("node_type <> 'symbol'")
    made = ["symbol_id", "node_type", "path", "display_name", "enclosing_symbol"]
    typed = kinds.join(first, "symbol_id").select(*made[:2], F.col("at.path").alias("path"), *made[3:], "package")
    nodes = runtime.materialise(typed.select(*made), "nodes")
    parts, latest = nodes, nodes
    while True:
        owners = latest.filter("enclosing_symbol <> ''").groupBy(F.col("enclosing_symbol").alias("symbol_id")).agg(F.min("path").alias("path"))
        missing = owners.join(parts.select("symbol_id"), "symbol_id", "left_anti").join(kinds.select("symbol_id", "node_type", "display_name", "enclosing_symbol"), "symbol_id").select(*made)
        latest = runtime.materialise(missing, "owners")
        if not latest.limit(1).count():
            break
        parts = parts.unionByName(latest)
    own = parts.select(text.node_id("symbol_id", F.col("node_type")).alias("node_id"), "symbol_id", "node_type", "path", F.col("display_name").alias("signature"))
    top = typed.filter("node_type in ('class', 'interface') and coalesce(trim(enclosing_symbol), '') = '' and coalesce(package, '') <> ''")
    pkg = top.groupBy("package").agg(F.min("path").alias("path")).select(F.concat(F.lit("pkg:"), "package").alias("node_id"), F.concat(F.lit("pkg:"), "package").alias("symbol_id"), F.lit("package").alias("node_type"), "path", F.translate("package", "/", ".").alias("signature"))
    return own.unionByName(pkg.join(own.select("node_id"), "node_id", "left_anti"))


def belongs_to(symbols: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src_node, dst_node): child node to the node of its enclosing symbol; a type without one to its package."""
    child = nodes.select(F.col("node_id").alias("src_node"), "symbol_id", "node_type")
    parent = nodes.select(F.col("node_id").alias("dst_node"), F.col("symbol_id").alias("enclosing_symbol"))
    owned = symbols.select("symbol_id", "enclosing_symbol").filter("enclosing_symbol <> ''").join(child, "symbol_id").join(parent, "enclosing_symbol").select("src_node", "dst_node")
    free = symbols.filter("coalesce(enclosing_symbol, '') = '' and package <> ''").select("symbol_id", F.concat(F.lit("pkg:"), F.regexp_replace("package", "^/+|/+$", "")).alias("dst_node"))
    top = free.join(child.filter("node_type in ('class', 'interface')"), "symbol_id").select("src_node", "dst_node")
    return owned.unionByName(top)


def relation_edges(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src_node, dst_node, edge_type, confidence, evidence): relations between known nodes, best confidence and least evidence each; an ``implements``
    from a type to something that is no interface is an ``extends``."""
    evidence = F.min("evidence_json").alias("evidence") if "evidence_json" in relations.columns else F.lit(None).cast("string").alias("evidence")
    best = relations.groupBy("src_node", "dst_node", "edge_type").agg(F.max("confidence").alias("confidence"), evidence)
    s = nodes.select(F.col("node_id").alias("src_node"), F.col("node_type").alias("s_type"))
    d = nodes.select(F.col("node_id").alias("dst_node"), F.col("node_type").alias("d_type"))
    known = best.join(s, "src_node").join(d, "dst_node")
    kind = F.when((F.col("edge_type") == "implements") & (F.col("d_type") != "interface") & F.col("s_type").isin("class", "interface"), "extends").otherwise(F.col("edge_type"))
    return known.select("src_node", "dst_node", kind.alias("edge_type"), "confidence", "evidence").groupBy("src_node", "dst_node", "edge_type").agg(F.max("confidence").alias("confidence"), F.min("evidence").alias("evidence"))


def occurrence_edges(occurrences: DataFrame, nodes: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """(src_node, dst_node, edge_type, n, weight, confidence): references to methods inside a method, and to fields inside a
    method or else a type, from the smallest such definition around the reference.

    A definition without an enclosing range reaches up to the next one of its sort (methods, types) in the document, the last
    to the document's last occurrence.  Edges that ``existing`` (src_node, dst_node, edge_type) has are left out.
    """
    from gneiss.operators.symbols import innermost

    sort = F.when(F.col("node_type") == "method", "method").when(F.col("node_type").isin("class", "interface"), "type")
    typed = nodes.filter("node_type in ('method', 'field', 'class', 'interface')").select("symbol_id", "node_id", "node_type", sort.alias("sort"))
    refs = occurrences.filter("role <> 'definition'").join(typed.filter("node_type in ('method', 'field')"), "symbol_id").select("document_id", F.col("id").alias("point_id"), F.col("range_start_line").alias("line"), F.col("range_start_col").alias("col"), F.col("node_id").alias("dst_node"), F.col("node_type").alias("dst_type"))
    has = (F.col("enclosing_range_start_line") >= 0) & (F.col("enclosing_range_end_line") >= F.col("enclosing_range_start_line"))
    pick = lambda end, axis: F.when(has, F.col(f"enclosing_range_{end}_{axis}")).otherwise(F.col(f"range_{end}_{axis}"))
    last = occurrences.groupBy("document_id").agg(F.max(F.greatest("range_end_line", "enclosing_range_end_line")).alias("last"))
    spans = occurrences.filter("role = 'definition'").join(typed.filter("sort is not null"), "symbol_id").select("document_id", "sort", F.col("node_id").alias("span_id"), has.alias("has"), *(pick(e, a).alias(f"{e[0]}{a[0]}") for e in ("start", "end") for a in ("line", "col")))
    following = F.lead("sl").over(Window.partitionBy("document_id", "sort").orderBy("sl", "sc", "span_id"))
    reach = F.coalesce(F.greatest("sl", following - 1), F.col("last"))
    spans = spans.join(last, "document_id").withColumn("reach", reach)
    spans = spans.select("document_id", "sort", "span_id", "sl", F.when(F.col("has"), F.col("sc")).otherwise(0).alias("sc"), F.when(F.col("has"), F.col("el")).otherwise(F.greatest("el", "reach")).alias("el"), F.when(F.col("has"), F.col("ec")).otherwise(1_000_000).alias("ec"))
    points = refs.select("document_id", "point_id", "line", "col")
    method = innermost(points, spans.filter("sort = 'method'").drop("sort")).select("document_id", "point_id", F.col("span_id").alias("method"))
    kind = innermost(points, spans.filter("sort = 'type'").drop("sort")).select("document_id", "point_id", F.col("span_id").alias("type"))
    met = refs.join(method, ["document_id", "point_id"], "left").join(kind, ["document_id", "point_id"], "left")
    source = F.when(F.col("dst_type") == "field", F.coalesce("method", "type")).otherwise(F.col("method"))
    found = met.withColumn("src_node", source).filter("src_node is not null and src_node <> dst_node")
    edge = F.when(F.col("dst_type") == "method", "calls").otherwise("field_refs")
    n = found.groupBy("src_node", "dst_node", edge.alias("edge_type")).agg(F.count("*").alias("n"))
    if existing is not None:
        n = n.join(existing.select("src_node", "dst_node", "edge_type").distinct(), ["src_node", "dst_node", "edge_type"], "left_anti")
    weight = F.least(F.lit(1.0), 0.35 + 0.1 * F.col("n"))
    return n.select("*", F.round(weight, 6).alias("weight"), F.round(F.least(F.lit(0.95), weight), 6).alias("confidence"))
