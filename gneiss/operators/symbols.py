"""Structured symbol operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gneiss.operators import text

# Symbol kinds of each entity type; None is no limit.
ENTITY_KINDS: dict[str, list[str] | None] = {
    "package": ["Package"],
    "import": ["Import"],
    "class": ["Class", "Record"],
    "interface": ["Interface"],
    "enum": ["Enum"],
    "annotation": ["Annotation"],
    "type": ["Class", "Interface", "Enum", "Record", "Annotation"],
    "method": ["Method", "StaticMethod", "AbstractMethod"],
    "field": ["Field", "StaticField"],
    "constructor": ["Constructor"],
    "variable": ["Variable"],
    "type_parameter": ["TypeParameter"],
    "any": None,
}
_SHOWN = ["symbol_id", "display_name", "kind", "package", "language", "enclosing_symbol"]


def _like(column: Column, needle: str) -> Column:
    """Substring match in which % and _ of the needle are wildcards."""
    return F.lower(column).like("%" + needle.replace("\\", "\\\\") + "%")


def candidates(symbols: DataFrame, query: str, limit: int) -> DataFrame:
    """Symbols whose name or id contains the query, then those the full-text index ranks, each up to the limit, in that order (``pos``)."""
    low = query.strip().lower()
    order = [F.when(F.lower("display_name") == low, 0).otherwise(1), F.length("display_name"), F.col("symbol_id")]
    contained = symbols.filter(_like(F.col("display_name"), low) | _like(F.col("symbol_id"), low)).orderBy(*order).limit(limit)
    first = contained.withColumn("pos", F.row_number().over(Window.orderBy(*order)))
    ranked = text.bm25(symbols, "symbol_id", ["display_name", "package"], query).orderBy(F.desc("score"), "id").limit(limit)
    second = ranked.withColumn("pos", F.lit(limit) + F.row_number().over(Window.orderBy(F.desc("score"), "id"))).select(F.col("id").alias("symbol_id"), "pos")
    more = second.join(symbols.select(*_SHOWN), "symbol_id").join(first.select("symbol_id"), "symbol_id", "left_anti")
    return first.select(*_SHOWN, "pos").unionByName(more.select(*_SHOWN, "pos"))


def find_entity(symbols: DataFrame, entity_type: str, name: str, match: str = "contains", package_contains: str = "", limit: int = 50) -> DataFrame:
    """Symbols of an entity type by name.  The type and package filters apply to the limited candidates, not before."""
    kind = (entity_type or "").strip().lower()
    if kind not in ENTITY_KINDS:
        raise ValueError(f"unknown entity type {entity_type!r}; one of {', '.join(sorted(ENTITY_KINDS))}")
    low, wanted = name.strip().lower(), package_contains.strip().lower()
    if match == "exact":
        order = [F.length("display_name"), F.col("symbol_id")]
        hits = symbols.filter((F.lower("display_name") == low) | (F.lower("symbol_id") == low)).orderBy(*order).limit(max(limit, 50)).withColumn("pos", F.row_number().over(Window.orderBy(*order)))
    else:
        hits = candidates(symbols, name, max(limit, 100))
    if ENTITY_KINDS[kind] is not None:
        hits = hits.filter(F.col("kind").isin(ENTITY_KINDS[kind]))
    if wanted:
        hits = hits.filter(F.lower(F.coalesce("package", F.lit(""))).contains(wanted) | F.lower("symbol_id").contains(wanted))
    return hits.orderBy("pos").limit(limit).select(*(F.coalesce(c, F.lit("")).alias(c) for c in _SHOWN))


def symbol_exact(symbols: DataFrame, query: str, top_k: int) -> DataFrame:
    """(symbol_id, score): 2 when name and id together contain the query (4 for the name itself), else the number of its words contained."""
    low = query.lower().strip()
    name = F.lower("display_name")
    hay = F.concat_ws(" ", name, F.lower("symbol_id"))
    words = F.lit(0.0)
    for term in (t for t in low.split() if t):
        words = words + hay.contains(term).cast("double")
    score = F.when(hay.contains(low), F.when(name == low, 4.0).otherwise(2.0)).otherwise(words)
    scored = candidates(symbols, query, max(50, top_k * 8)).select("symbol_id", score.alias("score")).filter("score > 0")
    return scored.orderBy(F.desc("score"), F.desc("symbol_id")).limit(top_k)


def definitions_of(occurrences: DataFrame, documents: DataFrame, symbol: DataFrame, top_k: int) -> DataFrame:
    """Places that define the symbols of the one-column frame ``symbol``; the first by document and place."""
    hits = occurrences.filter("role = 'definition'").join(symbol, "symbol_id", "left_semi").join(documents.select("document_id", "relative_path"), "document_id")
    place = F.concat_ws(":", "document_id", F.col("range_start_line").cast("string"), F.col("range_start_col").cast("string"))
    shown = hits.select(place.alias("result_id"), "symbol_id", "document_id", F.col("relative_path").alias("path"), F.col("range_start_line").alias("start_line"), F.col("range_start_col").alias("start_col"))
    return shown.orderBy("document_id", "start_line", "start_col", "result_id").limit(top_k)


def references_of(occurrences: DataFrame, documents: DataFrame, symbol: DataFrame, top_k: int) -> DataFrame:
    """Documents that refer to the symbols, with the numbers of explicit and inferred references."""
    hits = occurrences.filter("role <> 'definition'").join(symbol, "symbol_id", "left_semi").groupBy("document_id").agg(
        F.count("*").alias("reference_count"), F.sum((F.col("role") == "reference").cast("long")).alias("explicit_count"), F.sum((F.col("role") == "unknown").cast("long")).alias("inferred_count")
    )
    found = hits.join(documents.select("document_id", F.col("relative_path").alias("path")), "document_id")
    return found.orderBy(F.desc("reference_count"), "document_id").limit(top_k)


def _neighbours(edges: DataFrame, nodes: DataFrame, symbol: DataFrame, near: str, far: str, top_k: int) -> DataFrame:
    calls = edges.filter("edge_type = 'calls'").select(near, far, "confidence")
    pivot = nodes.join(symbol, "symbol_id", "left_semi").select(F.col("node_id").alias(near))
    other = nodes.select(F.col("node_id").alias(far), "symbol_id", "node_type", "path")
    hits = calls.join(pivot, near, "left_semi").join(other, far)
    return hits.groupBy("symbol_id").agg(F.max("confidence").alias("confidence"), F.max("node_type").alias("node_type"), F.min("path").alias("path")).orderBy(F.desc("confidence"), "symbol_id").limit(top_k)


def callers_of(edges: DataFrame, nodes: DataFrame, symbol: DataFrame, top_k: int) -> DataFrame:
    return _neighbours(edges, nodes, symbol, "dst_node", "src_node", top_k)


def callees_of(edges: DataFrame, nodes: DataFrame, symbol: DataFrame, top_k: int) -> DataFrame:
    return _neighbours(edges, nodes, symbol, "src_node", "dst_node", top_k)


def merge_ranked(primary: DataFrame, fallback: DataFrame, top_k: int) -> DataFrame:
    """(result_id, score): union with the best score of each result, scores then ids descending."""
    return primary.select("result_id", "score").unionByName(fallback.select("result_id", "score")).groupBy("result_id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), F.desc("result_id")).limit(top_k)


def search_intents(intents: DataFrame, nodes: DataFrame, query: str, top_k: int) -> DataFrame:
    """(node_id, score, quality_score, path) of the functions whose intent text matches the query best."""
    scored = intents.select("node_id", "quality_score", text.intent_score("intent_text", query).alias("score")).filter("score > 0")
    found = scored.join(nodes.select("node_id", "path"), "node_id")
    return found.orderBy(F.desc("score"), F.desc("quality_score"), "node_id").limit(top_k)


def innermost(points: DataFrame, spans: DataFrame, key: str = "document_id") -> DataFrame:
    """The smallest span around each point, ties by start: points (key, point_id, line, col), spans (key, span_id, sl, sc, el, ec).

    The document bounds the theta join; within it spans are bucketed by the blocks of lines they touch, so a point meets
    only spans of its block.
    """
    size = 64
    lo, hi = F.floor(F.col("sl") / size), F.floor(F.col("el") / size)
    s = spans.filter("el >= sl").withColumn("block", F.explode(F.sequence(lo, hi)))
    p = points.withColumn("block", F.floor(F.col("line") / size))
    inside = ((F.col("line") > F.col("sl")) | ((F.col("line") == F.col("sl")) & (F.col("col") >= F.col("sc")))) & ((F.col("line") < F.col("el")) | ((F.col("line") == F.col("el")) & (F.col("col") <= F.col("ec"))))
    extent = (F.col("el") - F.col("sl")).cast("long") * 1_000_000 + (F.col("ec") - F.col("sc"))
    hits = p.join(s, [key, "block"]).filter(inside)
    # One pass of map-side combining instead of a sort per point.
    best = hits.groupBy(key, "point_id").agg(F.min(F.struct(extent.alias("extent"), F.col("sl"), F.col("sc"), F.col("span_id"))).alias("m"))
    return best.select(key, "point_id", F.col("m.span_id").alias("span_id"), F.col("m.extent").alias("extent"))


def first_paths(occurrences: DataFrame, documents: DataFrame) -> DataFrame:
    """(symbol_id, path): the first non-empty path among the definitions of a symbol, by line."""
    met = occurrences.filter("role = 'definition'").join(documents.select("document_id", "relative_path"), "document_id").filter("relative_path <> ''")
    return met.groupBy("symbol_id").agg(F.min(F.struct("range_start_line", "relative_path")).alias("m")).select("symbol_id", F.col("m.relative_path").alias("path"))


def in_snapshot(nodes: DataFrame, repo: str, commit: str) -> DataFrame:
    """Nodes whose JSON metadata name the snapshot, compared as values."""
    meta = F.from_json("meta_json", "repo string, commit string")
    return nodes.filter((meta["repo"] == repo) & (meta["commit"] == commit))


def merge_payloads(primary: DataFrame, fallback: DataFrame, top_k: int) -> DataFrame:
    """(result_id, score, payload, explain): best score of each result of two lists; the payload of the first that has one, and
    the explanations of both."""
    both = primary.withColumn("_o", F.lit(0)).unionByName(fallback.withColumn("_o", F.lit(1)))
    filled = F.min(F.when(F.coalesce("payload", F.lit("")) != "", F.struct("_o", "payload")))
    explained = F.array_join(F.transform(F.sort_array(F.collect_set(F.when(F.coalesce("explain", F.lit("")) != "", F.struct("_o", "explain")))), lambda x: x["explain"]), "; ")
    merged = both.groupBy("result_id").agg(F.max("score").alias("score"), filled.alias("p"), explained.alias("explain"))
    return merged.select("result_id", "score", F.col("p.payload").alias("payload"), "explain").orderBy(F.desc("score"), F.desc("result_id")).limit(top_k)
