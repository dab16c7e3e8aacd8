"""Chunks of code along its definitions, with a block of metadata in front of each.

A document and its definitions travel in one row; per document the builder tries, in this order, chunks along the spans of
definitions, spans from one definition to the next, and the whole document.  Along definitions: spans of fewer than
``min_lines`` fall out; a span takes in the comments and annotations above it; a container falls out when another span lies
inside it; small neighbouring functions of one owner are packed; what containers hold besides their functions becomes
chunks of its own where it is long enough.  Every span is cut at lines by a token budget, part of which is the
metadata's.

Defined results: documents without text have no chunks; definitions beyond the text are ignored; repeated definitions are
one; null ids are left out; extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss import runtime
from gneiss.operators import text as kinds
from gneiss.operators.chunking import count_tokens, effective_span

#: Fields of a symbol's context, in the order in which the metadata block lists them.
FIELDS = ["path", "package", "kind", "symbol", "owner", "signature", "annotations", "extends", "implements", "field_type", "incoming_calls"]
_CHUNK = pa.schema([("chunk_id", pa.string()), ("document_id", pa.string()), ("part", pa.int32()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("n_tokens", pa.int32()), ("primary_symbols", pa.list_(pa.string())), ("content", pa.string())])
CHUNK = "chunk_id string, document_id string, part int, start_line int, end_line int, n_tokens int, primary_symbols array<string>, content string"


@dataclass(frozen=True)
class Options:
    target: int = 512
    overlap: int = 48
    min_lines: int = 5
    lookback: int = 120
    leaf_preferred: bool = True
    functions_only: bool = True
    small: int = 60
    pack_target: int = 160
    pack_gap: int = 3
    gap_lines: int = 8
    gap_tokens: int = 100
    context_tokens: int = 120
    count: Callable[[str], int] = count_tokens
    #: Syntax spans (start, end, kind) of a text, for definitions that come without a range of their own.
    syntax: Callable[[str], list[tuple[int, int, str]]] | None = None


@dataclass
class Span:
    """Lines [start, end) of a document, the definition line, and the symbols that it is about."""

    symbols: list[str]
    start: int
    end: int
    shown: int
    container: bool
    owner: str


def comment_start(lines: list[str], line: int, lookback: int) -> int:
    """First line of the blank, comment and annotation lines right above ``line``, at most ``lookback`` of them."""
    marks = ("@", "/*", "*", "//", '"""', "'''")
    first = min(line, len(lines))
    while first > max(0, line - lookback) and (not lines[first - 1].strip() or lines[first - 1].strip().startswith(marks)):
        first -= 1
    return first


def shortened(value: str, budget: int, count: Callable[[str], int]) -> str:
    """The text within a token budget: cut by an eighth (four characters at least) at a time, with ' ...' at the end."""
    value = value.strip()
    if budget <= 0 or not value or count(value) <= budget:
        return value if budget > 0 else ""
    while value and count(value + " ...") > budget:
        value = value[: -max(4, len(value) // 8)].rstrip()
    return value + " ..." if value else ""


def metadata(contexts: list[dict], budget: int, count: Callable[[str], int]) -> str:
    """Lines 'field: values' in the order of ``FIELDS``, distinct values of all symbols, within the budget."""
    out, left = [], budget
    for field in FIELDS:
        found = [context.get(field) for context in contexts]
        values = list(dict.fromkeys(v.strip() for x in found for v in (x if isinstance(x, list) else [x]) if v and v.strip()))
        body = shortened(", ".join(values), left - count(f"{field}: "), count) if values and left > 0 else ""
        if body:
            out.append(f"{field}: {body}")
            left -= count(out[-1])
    return "\n".join(out)


def windows(lines: list[str], budget: int, overlap: int, count: Callable[[str], int]) -> Iterator[tuple[int, int]]:
    """Half-open line ranges of at most ``budget`` tokens (one line at least), each beginning up to ``overlap`` tokens back."""
    costs = [max(1, count(x)) for x in lines]
    total = [0]
    for x in costs:
        total.append(total[-1] + x)
    begin = 0
    while begin < len(lines):
        end = begin + 1
        while end < len(lines) and total[end + 1] - total[begin] <= budget:
            end += 1
        yield begin, end
        if end == len(lines):
            return
        back = end
        while back > begin + 1 and total[end] - total[back - 1] <= overlap:
            back -= 1
        begin = back


def packed(spans: list[Span], lines: list[str], options: Options) -> list[Span]:
    """Small functions of one owner that follow each other closely, as one span; others as they are."""
    out: list[Span] = []
    by_owner: dict[str, list[Span]] = {}
    for span in spans:
        by_owner.setdefault(span.owner, []).append(span)
    for group in by_owner.values():
        open_: Span | None = None
        held = 0
        for span in sorted(group, key=lambda s: (s.start, s.end)):
            size = options.count("\n".join(lines[span.shown : span.end]))
            joins = open_ is not None and size < options.small and held < options.pack_target and span.start - open_.end <= options.pack_gap
            if joins:
                open_ = Span(open_.symbols + span.symbols, open_.start, max(open_.end, span.end), min(open_.shown, span.shown), False, span.owner)
                out[-1], held = open_, held + size
            else:
                out.append(span)
                open_, held = (span, size) if size < options.small else (None, 0)
    return sorted(out, key=lambda s: (s.shown, s.start))


def uncovered(begin: int, end: int, covered: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out, at = [], begin
    for a, b in sorted(covered):
        if a > at:
            out.append((at, min(a, end)))
        at = max(at, b)
    return [(a, b) for a, b in [*out, (at, end)] if a < b]


def smallest_around(spans: list[tuple[int, int, str]], kind: str, line: int) -> tuple[int, int] | None:
    """The syntax span around a definition line: of the definition's kind if any is, then the smallest, then the one
    that starts nearest to the line, then the first."""
    around = [s for s in spans if s[0] <= line < s[1]]
    around = [s for s in around if s[2] == kind] or around
    ranked = sorted((b - a, abs(a - line), a, b) for a, b, _ in around)
    return ranked[0][2:] if ranked else None


def chunk_document(doc: str, text: str, definitions: list[dict], options: Options) -> list[tuple]:
    """Rows of ``CHUNK`` for one document."""
    lines = text.splitlines()
    if not lines:
        return []
    rows: list[tuple] = []
    contexts = {d["symbol_id"]: d for d in definitions}

    def emit(name: str, start: int, end: int, symbols: list[str], described: bool = True) -> None:
        target = max(64, options.target)
        own = [contexts[s] | {"symbol": s} for s in symbols if s in contexts] if described else []
        block = metadata(own, min(target // 5, options.context_tokens), options.count)
        budget = max(1, target * 4 // 5) if block else target
        for part, (a, b) in enumerate(windows(lines[start:end], budget, min(options.overlap, budget // 2), options.count), 1):
            body = "\n".join(lines[start + a : start + b])
            content = f"{block}\n{body}" if block else body
            rows.append((f"{name}:p{part}", doc, part, start + a + 1, start + b, max(1, options.count(content)), symbols, content))

    if options.syntax and not all(d.get("enclosed", True) for d in definitions):
        blocks = options.syntax(text)
        around = [None if d.get("enclosed", True) else smallest_around(blocks, "type" if d["container"] else "method", d["line"]) for d in definitions]
        definitions = [d | ({"start": a[0], "end": a[1]} if a else {}) for d, a in zip(definitions, around, strict=True)]
    known = sorted({(d["start"], d["end"], d["symbol_id"]): d for d in definitions if 0 <= d["start"] < len(lines)}.items())
    spans = [Span([s], a, min(len(lines), max(a + 1, b)), min(a, comment_start(lines, d["line"], options.lookback)), bool(d["container"]), d["owner_symbol"] or "") for (a, b, s), d in known if d["function"] or d["container"]]
    spans = [s for s in spans if s.end - s.start >= options.min_lines]
    containers = [s for s in spans if s.container]
    chosen = [s for s in spans if not (s.container and options.functions_only)]
    if options.leaf_preferred:
        leaves = [(s.start, s.end) for s in chosen if not s.container]
        chosen = [s for s in chosen if not s.container or not any(s.start <= a and b <= s.end and (a, b) != (s.start, s.end) for a, b in leaves)]
    functions = packed([s for s in chosen if not s.container], lines, options)
    for span in [s for s in chosen if s.container] + functions:
        name = f"{doc}:ast_pack:{span.shown}-{span.end}:{span.symbols[0]}" if len(span.symbols) > 1 else f"{doc}:ast:{span.symbols[0]}:{span.start}-{span.end}"
        emit(name, span.shown, span.end, span.symbols)
    if options.functions_only:
        for box in sorted(containers, key=lambda s: (s.end - s.start, s.start)):
            inner = [(max(box.start, s.start), min(box.end, s.end)) for s in functions] + [(s.start, s.end) for s in containers if (s.start, s.end) != (box.start, box.end) and box.start <= s.start and s.end <= box.end]
            for a, b in uncovered(box.start, box.end, [(x, y) for x, y in inner if x < y]):
                if b - a >= options.gap_lines and options.count("\n".join(lines[a:b])) >= options.gap_tokens:
                    emit(f"{doc}:ast_parent:{box.symbols[0]}:{a}-{b}", a, b, box.symbols)
    if not rows:
        starts = [(max(0, d["line"]), d["symbol_id"]) for _, d in known if d["function"] or d["container"]]
        starts = sorted(dict.fromkeys(x for x in starts if x[0] < len(lines)))
        ends = [a for a, _ in starts[1:]] + [len(lines)] * bool(starts)
        for (a, symbol), b in zip(starts, ends, strict=True):
            if a < b:
                emit(f"{doc}:fn:{symbol}:{a}-{b}", a, b, [symbol])
    if not rows:
        emit(f"{doc}:doc", 0, len(lines), sorted(contexts)[:20], described=False)
    return rows


def symbol_contexts(symbols: DataFrame, occurrences: DataFrame, documents: DataFrame, nodes: DataFrame, edges: DataFrame, callers: DataFrame) -> DataFrame:
    """(symbol_id, path, package, kind, owner, signature, annotations, extends, implements, field_type, incoming_calls).

    ``path`` is that of the first definition; the related types are the distinct names by edge type, in order; ``callers`` is
    (symbol_id, callers).
    """
    first = occurrences.filter("role = 'definition'").join(documents.select("document_id", "relative_path"), "document_id").groupBy("symbol_id").agg(F.min(F.struct(F.col("range_start_line").alias("line"), F.col("relative_path").alias("path"))).alias("at"))
    owner = symbols.select(F.col("symbol_id").alias("enclosing_symbol"), F.col("display_name").alias("owner"))
    named = nodes.join(symbols.select("symbol_id", "display_name"), "symbol_id").select("node_id", "symbol_id", "display_name")
    related = edges.filter("edge_type in ('annotated_with', 'extends', 'implements', 'field_type')").join(named.select(F.col("node_id").alias("src_node"), "symbol_id"), "src_node").join(named.select(F.col("node_id").alias("dst_node"), F.col("display_name").alias("name")), "dst_node")

    def names(kind: str, prefix: str = "") -> Column:
        return F.sort_array(F.collect_set(F.when(F.col("edge_type") == kind, F.concat(F.lit(prefix), "name"))))

    types = related.groupBy("symbol_id").agg(names("annotated_with", "@").alias("annotations"), names("extends").alias("extends"), names("implements").alias("implements"), names("field_type").alias("field_type"))
    none = F.array().cast("array<string>")
    joined = symbols.join(first, "symbol_id", "left").join(owner, "enclosing_symbol", "left").join(types, "symbol_id", "left").join(callers, "symbol_id", "left")
    return joined.select("symbol_id", F.col("at.path").alias("path"), "package", "kind", "owner", F.col("display_name").alias("signature"), *(F.coalesce(c, none).alias(c) for c in ("annotations", "extends", "implements", "field_type")), F.coalesce("callers", none).alias("incoming_calls"))


def code_chunks(documents: DataFrame, occurrences: DataFrame, symbols: DataFrame, contexts: DataFrame, options: Options = Options()) -> DataFrame:
    """Rows of ``CHUNK``: the chunks of every code document (see the module)."""
    runtime.text_batches(documents.sparkSession)
    start, end, enclosed = effective_span()
    place = occurrences.filter("role = 'definition'").select("document_id", "symbol_id", F.col("range_start_line").alias("line"), start.alias("start"), (end + 1).alias("end"), enclosed.alias("enclosed"))
    info = symbols.select("symbol_id", F.col("enclosing_symbol").alias("owner_symbol"), kinds.is_function_kind("kind").alias("function"), kinds.is_container_kind("kind").alias("container"))
    row = F.struct("symbol_id", "line", "start", "end", "enclosed", "owner_symbol", "function", "container", *[c for c in contexts.columns if c != "symbol_id"])
    gathered = place.join(info, "symbol_id").join(contexts, "symbol_id", "left").groupBy("document_id").agg(F.collect_set(row).alias("definitions"))
    code = documents.filter(F.col("document_id").isNotNull() & (F.col("content") != "") & kinds.is_code("relative_path", "language")).select("document_id", "content")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, content, definitions in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = chunk_document(doc, content, definitions or [], options)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _CHUNK, strict=True)], schema=_CHUNK)

    return code.join(gathered, "document_id", "left").select("document_id", "content", "definitions").mapInArrow(build, CHUNK)


def symbol_card_chunks(symbols: DataFrame, contexts: DataFrame, budget: int = 120) -> DataFrame:
    """(chunk_id, symbol_id, content): one card per declared symbol, its metadata block within the budget (64 at least)."""
    declared = symbols.filter(kinds.is_declared_kind("kind")).select("symbol_id").distinct().join(contexts, "symbol_id")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            ids = [r["symbol_id"] for r in rows]
            cards = ["content_type: symbol_card\n" + metadata([r | {"symbol": r["symbol_id"]}], max(64, budget), count_tokens) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([f"symbol_card:{i}" for i in ids], pa.string()), pa.array(ids, pa.string()), pa.array(cards, pa.string())], names=["chunk_id", "symbol_id", "content"])

    return declared.mapInArrow(build, "chunk_id string, symbol_id string, content string")
