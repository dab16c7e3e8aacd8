"""Syntax backend for Java sources: declarations, references and relations without a compiler.

A scan per file blanks comments and literals and walks the braces; it knows which blocks are types and methods, so every
declaration gets its place and its span.  What a file mentions - super types, field types, annotations, created types, calls -
comes out by name and is resolved by joins over all files: types by the import rules, methods by owner, name and number of
arguments, fields by owner and name.  A call without a receiver, or on ``this``, belongs to the own type; one on a field or a
parameter to the type of that; anything else stays unresolved.

Defined results: files that do not parse to the end yield what was closed; null texts nothing; names that stay unresolved are
dropped, repeated mentions count as occurrences but are one relation; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss import runtime
from gneiss.operators import java

_NOISE = re.compile(r'//[^\n]*|/\*.*?\*/|"""(?:\\.|[^\\])*?"""|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'', re.S)
_TYPE = re.compile(r"(?<!\w)(class|@interface|interface|enum|record)\s+(\w+)")
_CALLABLE = re.compile(r"(\w+)\s*\(((?:[^()]|\([^()]*\))*)\)\s*(?:throws\s+[\w.,\s]+)?$")
_FIELD = re.compile(r"([\w.]+(?:\s*<[^;=]*>)?(?:\s*\[\s*\])*)\s+(\w+)\s*(?:=.*)?$", re.S)
_ANNOTATION = re.compile(r"@(?!interface\b)([\w.]+)(?:\s*\((?:[^()]|\([^()]*\))*\))?")
_CALL = re.compile(r"(?:\b(\w+)\s*\.\s*)?\b(\w+)\s*\(")
_NOT_CALLED = frozenset("if for while switch catch return new super this synchronized try do else assert throw case yield".split())
_KINDS = {"class": "Class", "interface": "Interface", "enum": "Enum", "record": "Record", "@interface": "Annotation"}
_ROW = ["what", "symbol", "name", "kind", "owner", "package", "sl", "sc", "el", "ec", "arity", "receiver", "relation"]
SCAN = "path string, what string, symbol string, name string, kind string, owner string, package string, sl int, sc int, el int, ec int, arity int, receiver string, relation string"


def blanked(text: str) -> str:
    """The text with comments and literals as spaces, so places stay."""
    return _NOISE.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def arguments(text: str) -> list[str]:
    """Parts between the commas of an argument or parameter list that stand in no bracket."""
    parts, depth, at = [], 0, 0
    for i, ch in enumerate(text):
        if ch in "([{<":
            depth += 1
        elif ch in ")]}>":
            depth -= 1
        elif ch == "," and depth <= 0:
            parts.append(text[at:i])
            at = i + 1
    return [p.strip() for p in [*parts, text[at:]] if p.strip()]


def scan(text: str) -> Iterator[dict]:
    """Declarations ('declare') and mentions ('mention') of one file, with 0-based places."""
    code = blanked(text)
    starts = [0, *(m.end() for m in re.finditer("\n", code))]
    found = re.search(r"^\s*package\s+([\w.\s]+);", code, re.M)
    package = re.sub(r"\s", "", found[1]) if found else ""

    def place(at: int) -> tuple[int, int]:
        import bisect

        line = bisect.bisect_right(starts, at) - 1
        return line, at - starts[line]

    def declare(symbol: str, name: str, kind: str, owner: str, at: int, arity: int = -1, type_name: str | None = None) -> dict:
        line, col = place(at)
        return {"what": "declare", "symbol": symbol, "name": name, "kind": kind, "owner": owner, "package": package, "sl": line, "sc": col, "arity": arity, "receiver": type_name, "el": -1, "ec": -1}

    def mention(symbol: str, name: str, relation: str, at: int, arity: int = -1, receiver: str | None = None) -> dict:
        line, col = place(at)
        return {"what": "mention", "symbol": symbol, "name": name, "relation": relation, "package": package, "sl": line, "sc": col, "arity": arity, "receiver": receiver}

    # Open blocks: (declaration or None, start of the block, names of parameters by type).
    stack: list[tuple[dict | None, int, dict[str, str]]] = []
    head = 0
    for m in re.finditer(r"[{};]", code):
        at, header = m.start(), code[head : m.start()]
        owner = next((d for d, _, _ in reversed(stack) if d), None)
        inside = stack[-1][0] if stack else None
        in_type = inside is not None and inside["kind"] in _KINDS.values()
        base = (owner["symbol"] if owner else package) if not stack or in_type else ""
        bare = _ANNOTATION.sub(lambda a: " " * len(a[0]), header)
        row, parameters = None, {}
        kind = _TYPE.search(bare) if m[0] == "{" and (not stack or in_type) else None
        call = _CALLABLE.search(bare.rstrip()) if in_type and m[0] != "}" else None
        if kind:
            row = declare(f"{base}.{kind[2]}".lstrip("."), kind[2], _KINDS[kind[1]], base if owner else "", head + kind.start(2))
            yield row
            rest = bare[kind.end() :]
            for word, relation in (("extends", "extends"), ("implements", "implements")):
                part = re.search(rf"\b{word}\b(.*?)(?:\bimplements\b|\bpermits\b|$)", java.without_generics(rest), re.S)
                for name in java.type_references(part[1]) if part else []:
                    yield mention(row["symbol"], name, relation, head + bare.find(name))
        elif call and "=" not in bare[: call.start()] and not bare[: call.start()].rstrip().endswith("."):
            maker = call[1] == owner["name"]
            if maker or bare[: call.start(1)].split():
                args = arguments(call[2])
                parameters = {p.split()[-1]: java.without_generics(" ".join(p.split()[:-1])).split()[-1] for p in args if len(p.split()) > 1}
                row = declare(f"{owner['symbol']}#{call[1]}/{len(args)}", call[1], "Constructor" if maker else "Method", owner["symbol"], head + call.start(1), len(args))
                yield row
        elif in_type and m[0] == ";" and (field := _FIELD.search(bare.strip())) and field[1] not in ("return", "package", "import"):
            type_name = (java.type_references(field[1]) or [""])[0]
            row = declare(f"{owner['symbol']}#{field[2]}", field[2], "Field", owner["symbol"], head + bare.find(field[2]), type_name=type_name)
            yield row
            yield mention(row["symbol"], type_name, "field_type", head + bare.find(field[1]))
        if row:
            for a in _ANNOTATION.finditer(header):
                yield mention(row["symbol"], a[1], "annotated_with", head + a.start())
        elif owner and owner["kind"] in ("Method", "Constructor"):
            known = next((p for d, _, p in reversed(stack) if d), {})
            for c in _CALL.finditer(bare):
                created = re.search(r"\bnew\s+$", bare[: c.start(2)])
                if c[2] in _NOT_CALLED:
                    continue
                depth, end = 1, c.end()
                while end < len(bare) and depth:
                    depth += (bare[end] == "(") - (bare[end] == ")")
                    end += 1
                n = len(arguments(bare[c.end() : end - 1]))
                receiver = c[1] if c[1] not in (None, "this", "new") else None
                chained = c[1] is None and bare[: c.start(2)].rstrip().endswith(".")
                if created:
                    yield mention(owner["symbol"], c[2], "creates", head + c.start(2), n)
                elif not chained:
                    yield mention(owner["symbol"], c[2], "calls", head + c.start(2), n, known.get(receiver, receiver) if receiver else None)
            for used in re.finditer(r"(?:\bthis\s*\.\s*)?\b(\w+)\b(?!\s*\()", bare):
                yield mention(owner["symbol"], used[1], "uses", head + used.start(1))
        if m[0] == "{":
            stack.append((row, at, parameters))
        elif m[0] == "}" and stack:
            closed = stack.pop()[0]
            if closed:
                line, col = place(at + 1)
                yield {"what": "close", "symbol": closed["symbol"], "sl": closed["sl"], "sc": closed["sc"], "el": line, "ec": col}
        head = m.end()


def spans(text: str) -> list[tuple[int, int, str]]:
    """Half-open line spans (start, end, kind) of the types and methods of one file; kind is 'type' or 'method'."""
    rows = list(scan(text))
    kinds = {(r["symbol"], r["sl"], r["sc"]): "type" if r["kind"] in _KINDS.values() else "method" for r in rows if r["what"] == "declare"}
    return [(r["sl"], r["el"] + 1, kinds[r["symbol"], r["sl"], r["sc"]]) for r in rows if r["what"] == "close"]


def scan_files(files: DataFrame) -> DataFrame:
    """Rows of ``SCAN`` of every file (path, content); the end of a span is on the row of its declaration."""
    runtime.text_batches(files.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {n: pa.int32() if n in ("sl", "sc", "el", "ec", "arity") else pa.string() for n in _ROW}
        for batch in batches:
            for path, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = list(scan(text))
                ends = {(r["symbol"], r["sl"], r["sc"]): r for r in rows if r["what"] == "close"}
                rows = [r | ({"el": e["el"], "ec": e["ec"]} if r["what"] == "declare" and (e := ends.get((r["symbol"], r["sl"], r["sc"]))) else {}) for r in rows if r["what"] != "close"]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), *(pa.array([r.get(n) for r in rows], t) for n, t in types.items())], names=["path", *_ROW])

    return files.filter("content is not null").select("path", "content").mapInArrow(work, SCAN)


def index_sources(files: DataFrame) -> dict[str, DataFrame]:
    """The tables documents, symbols, occurrences and relations of Java sources (path, content)."""
    rows = runtime.materialise(scan_files(files), "scan")
    declared = rows.filter("what = 'declare'")
    symbols = declared.groupBy("symbol").agg(*(F.min(c).alias(c) for c in ("name", "kind", "owner", "package", "arity", "receiver")))
    symbols = runtime.materialise(symbols, "symbols")
    types = symbols.filter("kind in ('Class', 'Interface', 'Enum', 'Record', 'Annotation')").select(F.col("symbol").alias("symbol_id"), "package", "name")
    imported = java.imports(files, "path", "content").select(F.col("id").alias("document_id"), F.col("short").alias("name"), F.col("name").alias("qualified"), "wildcard")
    mentions = rows.filter("what = 'mention'")
    named = mentions.filter("relation in ('extends', 'implements', 'field_type', 'annotated_with', 'creates')").select(F.col("path").alias("document_id"), "package", "name")
    typed = declared.filter("receiver is not null").select(F.col("path").alias("document_id"), "package", F.col("receiver").alias("name"))
    through = mentions.filter("relation = 'calls' and receiver is not null").select(F.col("path").alias("document_id"), "package", F.col("receiver").alias("name"))
    resolved = runtime.materialise(java.resolve_types(named.unionByName(typed).unionByName(through).distinct(), imported, types), "types").withColumnRenamed("document_id", "path")
    to_type = mentions.filter("relation in ('extends', 'implements', 'field_type', 'annotated_with', 'creates')").join(resolved, ["path", "name"]).withColumn("relation", F.when(F.col("relation") == "creates", "calls").otherwise(F.col("relation")))
    owner = symbols.select(F.col("symbol"), F.col("owner").alias("type"))
    members = symbols.filter("kind in ('Method', 'Constructor')").select(F.col("symbol").alias("symbol_id"), F.col("owner").alias("type"), "name", "arity")
    fields = symbols.filter("kind = 'Field'").select(F.col("symbol").alias("symbol_id"), F.col("owner").alias("type"), "name", F.col("receiver").alias("field_type"))
    # The receiver of a call is a field of the own type, or a name of a type (of a parameter, or static); without one the own type.
    calls = mentions.filter("relation = 'calls'").join(owner, "symbol")
    held = fields.select("type", F.col("name").alias("receiver"), F.col("field_type"))
    calls = calls.join(held, ["type", "receiver"], "left").withColumn("_name", F.coalesce("field_type", "receiver"))
    calls = calls.join(resolved.select("path", F.col("name").alias("_name"), F.col("symbol_id").alias("other")), ["path", "_name"], "left")
    calls = calls.withColumn("type", F.when(F.col("receiver").isNull(), F.col("type")).otherwise(F.col("other"))).filter("type is not null")
    called = java.resolve_members(calls.select("path", "symbol", "type", "name", "arity", "relation", "sl", "sc"), members, ["type", "name", "arity"]).filter("symbol_id is not null")
    used = java.resolve_members(mentions.filter("relation = 'uses'").join(owner, "symbol").select("path", "symbol", "type", "name", "sl", "sc"), fields, ["type", "name"]).filter("symbol_id is not null").withColumn("relation", F.lit("field_refs"))
    columns = ["path", "symbol", "symbol_id", "name", "relation", "sl", "sc"]
    met = runtime.materialise(to_type.select(*columns).unionByName(called.select(*columns)).unionByName(used.select(*columns)), "met")
    own = [F.col("path").alias("document_id"), F.col("symbol").alias("symbol_id"), F.lit("definition").alias("role"), F.col("sl").alias("range_start_line"), F.col("sc").alias("range_start_col"), F.col("sl").alias("range_end_line"), (F.col("sc") + F.length("name")).alias("range_end_col")]
    span = [F.when(F.col("el") >= 0, F.col(a)).otherwise(-1).alias(f"enclosing_range_{b}") for a, b in (("sl", "start_line"), ("sc", "start_col"), ("el", "end_line"), ("ec", "end_col"))]
    definitions = declared.select(*own, *span)
    none = [F.lit(-1).alias(f"enclosing_range_{b}") for b in ("start_line", "start_col", "end_line", "end_col")]
    references = met.select("path", F.col("symbol_id").alias("symbol"), "name", "sl", "sc").select(own[0], own[1], F.lit("reference").alias("role"), *own[3:], *none)
    return {
        "documents": files.select(F.col("path").alias("document_id"), F.col("path").alias("relative_path"), F.lit("java").alias("language"), "content"),
        "symbols": symbols.select(F.col("symbol").alias("symbol_id"), F.col("name").alias("display_name"), "kind", "package", F.col("owner").alias("enclosing_symbol")),
        "occurrences": definitions.unionByName(references).distinct(),
        "relations": met.filter("symbol <> symbol_id").select(F.col("symbol").alias("from_symbol"), F.col("symbol_id").alias("to_symbol"), F.col("relation").alias("relation_type")).distinct(),
    }
