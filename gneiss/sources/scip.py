"""Binary code indexes (the public SCIP protobuf schema) read without a protobuf library.

Files are scanned as binary; one file is one message, so large indexes should come as several files.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gneiss.sources.records import parse_lines

#: Bit of ``symbol_roles`` that marks a definition.
DEFINITION = 1


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a message: integers for varints, bytes for length-delimited and fixed fields."""
    at, end = 0, len(data)
    while at < end:
        tag, at = varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(data, at)
        else:
            if kind == 2:
                size, at = varint(data, at)
            elif kind in (1, 5):
                size = 8 if kind == 1 else 4
            else:
                raise ValueError(f"wire type {kind} at {at}")
            value, at = data[at : at + size], at + size
            if len(value) != size:
                raise ValueError("the message ends early")
        yield tag >> 3, value


def varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data):
            raise ValueError("the message ends early")
        byte = data[at]
        value |= (byte & 127) << shift
        at += 1
        if byte < 128:
            return value, at
        shift += 7


def _ints(value: int | bytes) -> list[int]:
    if isinstance(value, int):
        return [value]
    out, at = [], 0
    while at < len(value):
        n, at = varint(value, at)
        out.append(n)
    return out


def _text(value: int | bytes) -> str:
    return value.decode("utf-8", "replace") if isinstance(value, bytes) else str(value)


def _symbol(data: bytes, path: str) -> Iterator[dict]:
    out, links = {"type": "symbol", "relative_path": path}, []
    for n, v in fields(data):
        if n == 1:
            out["symbol_id"] = _text(v)
        elif n == 4:
            links.append(dict(fields(v)))
        elif n == 5:
            out["kind"] = str(v)
        elif n == 6:
            out["display_name"] = _text(v)
        elif n == 8:
            out["enclosing_symbol"] = _text(v)
    if "symbol_id" not in out:
        return
    yield out
    for link in links:
        kind = "implements" if link.get(3) else "type_definition" if link.get(4) else "references"
        if 1 in link:
            yield {"type": "relation", "from_symbol": out["symbol_id"], "to_symbol": _text(link[1]), "relation_type": kind, "evidence_relative_path": path}


def index_records(data: bytes, repo: str, commit: str) -> Iterator[dict]:
    """The four record types of one index file."""
    for n, v in fields(data):
        if n == 3:
            yield from _symbol(v, "")
        if n != 2:
            continue
        parts = list(fields(v))
        first = {k: x for k, x in reversed(parts) if k in (1, 4, 5)}
        path = _text(first.get(1, b""))
        snapshot = {"relative_path": path, "repo": repo, "commit_hash": commit}
        occurrences = [dict(_occurrence(x)) for k, x in parts if k == 2]
        yield {"type": "document", "language": _text(first.get(4, b"")).lower(), "content": _text(first.get(5, b"")), "occurrence_count": len(occurrences)} | snapshot
        for o in occurrences:
            if "symbol_id" in o:
                yield o | snapshot
        for k, x in parts:
            if k == 3:
                yield from _symbol(x, path)


def _occurrence(data: bytes) -> Iterator[tuple[str, object]]:
    own: dict[int, list[int]] = {1: [], 7: []}
    roles = 0
    for n, v in fields(data):
        if n in own:
            own[n] += _ints(v)
        elif n == 2:
            yield "symbol_id", _text(v)
        elif n == 3:
            roles = int(v)
        elif n == 5:
            yield "syntax_kind", str(v)
    yield "type", "occurrence"
    yield "range", own[1]
    yield "enclosing_range", own[7]
    yield "role", "definition" if roles & DEFINITION else "reference"


def read_scip(spark: SparkSession, path: str, repo: str, commit: str) -> DataFrame:
    """Index records of the binary files at a path; a damaged file fails the read."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                lines = []
                for record in index_records(data, repo, commit):
                    lines.append(json.dumps(record))
                    if len(lines) >= 2000:
                        yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
                        lines = []
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("content")
    return parse_lines(files.mapInArrow(decode, "value string"))
