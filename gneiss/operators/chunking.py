"""Line spans, gaps, packing and token-budgeted chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gneiss import runtime

_TOKEN = re.compile(r"\w+|[^\w\s]")


def effective_span(prefix: str = "") -> tuple[Column, Column, Column]:
    """(start, end, enclosed): the enclosing range when it starts at 0 or later and ends after its start, else the own range."""
    es, ee = F.col(f"{prefix}enclosing_range_start_line"), F.col(f"{prefix}enclosing_range_end_line")
    use = F.coalesce((es >= 0) & (ee > es), F.lit(False))
    return F.when(use, es).otherwise(F.col(f"{prefix}range_start_line")), F.when(use, ee).otherwise(F.col(f"{prefix}range_end_line")), use


def to_next_sibling(spans: DataFrame, key: list[str], last: str = "max_line") -> DataFrame:
    """(key..., id, start, end): every span reaches the line before the next one of its key, the last one to ``last``."""
    following = F.lead("start").over(Window.partitionBy(*key).orderBy("start", "id"))
    end = F.when(following.isNull(), F.col(last)).otherwise(F.greatest("start", following - 1))
    return spans.select(*key, "id", "start", F.greatest("end", end).alias("end"))


def definition_spans(definitions: DataFrame) -> DataFrame:
    """(document_id, id, start, end): half-open spans from one definition to the next in the document; empty ones fall out."""
    following = F.lead("start").over(Window.partitionBy("document_id").orderBy("start", "id"))
    return definitions.select("document_id", "id", "start", F.coalesce(following, F.col("max_line") + 1).alias("end")).filter("`end` > start")


def merge_intervals(spans: DataFrame, key: list[str]) -> DataFrame:
    """(key..., start, end): union of half-open intervals; touching ones join, empty ones fall out."""
    clean = spans.select(*key, F.least("start", "end").alias("s"), F.greatest("start", "end").alias("e")).filter("s < e")
    w = Window.partitionBy(*key).orderBy("s", "e")
    reach = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = clean.withColumn("new", F.when(reach.isNull() | (F.col("s") > reach), 1).otherwise(0)).withColumn("island", F.sum("new").over(w))
    return marked.groupBy(*key, "island").agg(F.min("s").alias("start"), F.max("e").alias("end")).drop("island")


def gaps(ranges: DataFrame, covered: DataFrame, key: list[str]) -> DataFrame:
    """(key..., start, end): parts of each half-open range (lo, hi) that no covered interval touches."""
    inside = ranges.join(covered, key, "left").select(*key, "lo", "hi", F.greatest("lo", "start").alias("s"), F.least("hi", "end").alias("e"))
    merged = merge_intervals(inside.filter("s < e").select(*key, "lo", "hi", F.col("s").alias("start"), F.col("e").alias("end")), [*key, "lo", "hi"])
    w = Window.partitionBy(*key, "lo", "hi").orderBy("start")
    after = merged.select(*key, F.col("end").alias("start"), F.coalesce(F.lead("start").over(w), F.col("hi")).alias("end"))
    head = ranges.join(merged.groupBy(*key, "lo", "hi").agg(F.min("start").alias("first")), [*key, "lo", "hi"], "left").select(*key, F.col("lo").alias("start"), F.coalesce("first", F.col("hi")).alias("end"))
    return after.unionByName(head).filter("start < `end`")


def leaf_preferred(spans: DataFrame, key: str = "document_id") -> DataFrame:
    """Spans that do not strictly contain another span of their key.

    Sorted by start, longer first, a span strictly contains another one exactly when the least end among the distinct spans
    after it is not beyond its own; so one window pass per key decides, without pairs.
    """
    distinct = spans.select(key, "start", "end").distinct()
    order = Window.partitionBy(key).orderBy(F.col("start"), F.desc("end"))
    least = F.min("end").over(order.rowsBetween(1, Window.unboundedFollowing))
    leaves = distinct.withColumn("_least", least).filter(F.col("_least").isNull() | (F.col("_least") > F.col("end"))).select(key, "start", "end")
    return spans.join(leaves, [key, "start", "end"], "left_semi").select(*spans.columns)


def count_tokens(text: str) -> int:
    return sum(max(1, len(_TOKEN.findall(line))) for line in text.split("\n")) if text else 0


def split_lines(text: str, target: int, overlap: int = 0) -> list[tuple[int, int]]:
    """Half-open line spans of at most ``target`` tokens (one line at least); the next begins up to ``overlap`` tokens back."""
    target = max(64, target)
    costs = [max(1, len(_TOKEN.findall(line))) for line in text.split("\n")] if text else []
    out, i, n = [], 0, len(costs)
    overlap = min(overlap, target // 2)
    while i < n:
        j, used = i, 0
        while j < n and (j == i or used + costs[j] <= target):
            used += costs[j]
            j += 1
        out.append((i, j))
        if j >= n:
            break
        k, back = j, 0
        while k > i + 1 and back + costs[k - 1] <= overlap:
            k -= 1
            back += costs[k]
        i = max(i + 1, k)
    return out


def chunk_documents(documents: DataFrame, target: int = 256, overlap: int = 32) -> DataFrame:
    """(chunk_id, document_id, part, start_line, end_line, n_tokens, content): whole documents cut by token budget, lines never split."""
    runtime.text_batches(documents.sparkSession)
    schema = pa.schema([("chunk_id", pa.string()), ("document_id", pa.string()), ("part", pa.int32()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("n_tokens", pa.int32()), ("content", pa.string())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True):
                lines = text.split("\n")
                for p, (a, b) in enumerate(split_lines(text, target, overlap), start=1):
                    piece = "\n".join(lines[a:b])
                    rows.append((f"{doc}:doc:p{p}", doc, p, a + 1, b, max(1, count_tokens(piece)), piece))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)

    texts = documents.filter("document_id is not null and content <> ''").select("document_id", "content")
    return texts.mapInArrow(cut, "chunk_id string, document_id string, part int, start_line int, end_line int, n_tokens int, content string")


def pack_siblings(spans: list[tuple[int, int, int]], small: int, target: int, max_gap: int) -> list[list[int]]:
    """Groups of neighbouring small spans (start, end, tokens): a group grows until ``target`` tokens, and ends at a big
    span or a gap of more than ``max_gap`` lines.  Indices in order of start."""
    groups: list[list[int]] = []
    open_group: list[int] = []
    held = 0
    for i in sorted(range(len(spans)), key=lambda k: spans[k]):
        start, _, tokens = spans[i]
        big = tokens > small
        far = bool(open_group) and start - spans[open_group[-1]][1] > max_gap
        if open_group and (big or far or held >= target):
            groups.append(open_group)
            open_group, held = [], 0
        if big:
            groups.append([i])
        else:
            open_group.append(i)
            held += tokens
    return groups + ([open_group] if open_group else [])


def packed_functions(functions: DataFrame, small: int = 60, target: int = 160, max_gap: int = 3) -> DataFrame:
    """(document_id, enclosing_symbol, pack, symbol_id): small sibling functions packed per document and owner.

    ``functions`` has document_id, enclosing_symbol, symbol_id, start, end, n_tokens; the siblings of one owner in one
    document are what a group holds, which the length of the document bounds.
    """

    def pack(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("start", "end", "n_tokens", "symbol_id")), strict=True))
        groups = pack_siblings([r[:3] for r in rows], small, target, max_gap)
        flat = [(g, rows[i][3]) for g, members in enumerate(groups) for i in members]
        n = len(flat)
        first = table.slice(0, 1)
        return pa.table({"document_id": [first.column("document_id")[0].as_py()] * n, "enclosing_symbol": pa.array([first.column("enclosing_symbol")[0].as_py()] * n, pa.string()), "pack": pa.array([g for g, _ in flat], pa.int32()), "symbol_id": [s for _, s in flat]})

    return functions.groupBy("document_id", "enclosing_symbol").applyInArrow(pack, "document_id string, enclosing_symbol string, pack int, symbol_id string")


def symbol_cards(symbols: DataFrame, context: DataFrame, max_labels: int = 8) -> DataFrame:
    """(chunk_id, symbol_id, content): one descriptive chunk per declared symbol: name, kind, package, owner, callers."""
    from gneiss.operators.text import is_declared_kind

    owner = symbols.select(F.col("symbol_id").alias("enclosing_symbol"), F.col("display_name").alias("owner"))
    base = symbols.filter(is_declared_kind("kind")).select("symbol_id", "display_name", "kind", "package", "enclosing_symbol").join(owner, "enclosing_symbol", "left").join(context, "symbol_id", "left")

    def field(name: str, value: Column) -> Column:
        return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{name}: "), value))

    callers = F.array_join(F.slice("callers", 1, max_labels), ", ")
    content = F.concat_ws("\n", F.lit("content_type: symbol_card"), field("package", F.col("package")), field("kind", F.col("kind")), field("symbol", F.col("display_name")), field("owner", F.col("owner")), field("incoming_calls", callers))
    return base.select(F.concat(F.lit("symbol_card:"), "symbol_id").alias("chunk_id"), "symbol_id", content.alias("content"))


def caller_labels(edges: DataFrame, nodes: DataFrame, symbols: DataFrame) -> DataFrame:
    """(symbol_id, callers): sorted distinct display names of the callers of every symbol."""
    named = nodes.join(symbols.select("symbol_id", "display_name"), "symbol_id").select("node_id", "symbol_id", "display_name")
    calls = edges.filter("edge_type = 'calls'").select("src_node", "dst_node")
    src = named.select(F.col("node_id").alias("src_node"), F.col("display_name").alias("caller"))
    dst = named.select(F.col("node_id").alias("dst_node"), "symbol_id")
    distinct = calls.join(src, "src_node").join(dst, "dst_node").select("symbol_id", "caller").distinct()
    # The least names only, ranked before they are gathered: a symbol that everything calls gathers no long list.
    ranked = distinct.withColumn("r", F.row_number().over(Window.partitionBy("symbol_id").orderBy("caller"))).filter("r <= 8")
    return ranked.groupBy("symbol_id").agg(F.sort_array(F.collect_list("caller")).alias("callers"))
