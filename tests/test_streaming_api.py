import json

import pytest

from gneiss.api import Index, Query, UnsupportedCapability
from gneiss.operators import chunking, text
from gneiss.sources import records
from gneiss.streaming import incremental


def test_stream_of_lines_and_vectors(spark, tmp_path):
    lines = tmp_path / "in"
    lines.mkdir()
    docs = [{"type": "document", "relative_path": f"a{i}.py", "content": f"def f{i} value", "repo": "r", "commit_hash": "c"} for i in range(5)]
    (lines / "1.ndjson").write_text("\n".join(map(json.dumps, docs)) + "\n{broken\n\n[1]\n")
    out, mark = str(tmp_path / "vectors"), str(tmp_path / "mark")

    def run():
        chunks = records.of_type(incremental.index_lines(spark, str(lines)), "document").selectExpr("document_id as chunk_id", "content")
        incremental.embed_new(spark, chunks, out, mark).awaitTermination()
        return {r.chunk_id: r.vec for r in spark.read.parquet(out).collect()}

    first = run()
    assert len(first) == 5 and all(abs(sum(x * x for x in v) - 1) < 1e-9 and len(v) == 128 for v in first.values())
    (lines / "2.ndjson").write_text(json.dumps(docs[0]) + "\n" + json.dumps(docs[0] | {"relative_path": "new.py"}) + "\n")
    assert set(run()) == set(first) | {"r:c:new.py"} and spark.read.parquet(out).count() == 6


def test_event_windows_on_a_stream(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{i:02}:00", "click", 1.0) for i in range(20)]
    df = spark.createDataFrame(rows, "event_id int, t string, event_type string, value double").selectExpr("event_id", "cast(t as timestamp) as ts", "event_type", "value")
    df.write.parquet(str(tmp_path / "e"))
    stream = incremental.event_windows(spark.readStream.schema(df.schema).parquet(str(tmp_path / "e")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.n, r.total) for r in spark.sql("select * from w").collect()) == [(5, 5.0)] * 4
    assert incremental.event_windows(df).count() == 4


def test_records_of_all_types(spark):
    lines = [
        {"type": "symbol", "symbol_id": "scip-java maven a 1 a/B#run().", "relative_path": "x"},
        {"type": "symbol", "symbol_id": "local 4", "display_name": "v", "kind": "Variable", "enclosing_symbol": "a"},
        {"type": "occurrence", "relative_path": "x", "symbol_id": "s", "range": [1, 2, 3], "repo": "r", "commit_hash": "c"},
        {"type": "occurrence", "relative_path": "x", "symbol_id": "s", "range": [1, 2, 3, 4], "enclosing_range": [1, 0, 9, 1], "role": "definition"},
        {"type": "relation", "from_symbol": "a", "to_symbol": "b"},
        {"type": "other"},
    ]
    parsed = records.parse_lines(spark.createDataFrame([(json.dumps(x),) for x in lines] + [("nonsense",), ("",), (None,)], "value string"))
    symbols = {r.symbol_id: r for r in records.of_type(parsed, "symbol").collect()}
    assert symbols["scip-java maven a 1 a/B#run()."].enclosing_symbol == "scip-java maven a 1 a/B#" and symbols["scip-java maven a 1 a/B#run()."].kind == "unknown" and symbols["local 4"].enclosing_symbol == "a"
    found = sorted(tuple(r)[2:6] for r in records.of_type(parsed, "occurrence").collect())
    assert found == [(1, 2, 1, 3), (1, 2, 3, 4)]
    assert [tuple(r)[:4] for r in records.of_type(parsed, "relation").collect()] == [("a", "b", "references", 1.0)]
    with pytest.raises(ValueError):
        records.of_type(parsed, "x")


@pytest.fixture(scope="module")
def index(spark):
    docs = spark.createDataFrame([("r:c:src/Buffer.java", "src/Buffer.java", "capacity expansion expands byte buffer", "r"), ("r:c:src/View.java", "src/View.java", "render view template", "r"), ("r:c:a/src/test/BufferTest.java", "a/src/test/BufferTest.java", "capacity expansion buffer test", "r")], "document_id string, relative_path string, content string, repo string")
    symbols = spark.createDataFrame([("com.acme.Buffer#expand().", "expand", "Method", "com.acme", "java", ""), ("com.acme.View#render().", "render", "Method", "com.acme", "java", "")], "symbol_id string, display_name string, kind string, package string, language string, enclosing_symbol string")
    occ = spark.createDataFrame([(1, "r:c:src/Buffer.java", "com.acme.Buffer#expand().", "definition", 3, 4), (2, "r:c:src/View.java", "com.acme.Buffer#expand().", "reference", 7, 1)], "id long, document_id string, symbol_id string, role string, range_start_line int, range_start_col int")
    nodes = spark.createDataFrame([("m1", "com.acme.Buffer#expand().", "method", "src/Buffer.java"), ("m2", "com.acme.View#render().", "method", "src/View.java")], "node_id string, symbol_id string, node_type string, path string")
    edges = spark.createDataFrame([("e1", "m2", "m1", "calls", 0.9)], "edge_id string, src_node string, dst_node string, edge_type string, confidence double")
    return {"documents": docs, "symbols": symbols, "occurrences": occ, "code_nodes": nodes, "code_edges": edges}


def test_queries(index):
    ix = Index(index)
    ids = lambda q: [r[0] for r in ix.run(q).collect()]
    assert ids(Query("capacity expansion", blend="rrf", top_k=2))[0] == "r:c:src/Buffer.java"
    assert ids(Query("render template", mode="semantic"))[0] == "r:c:src/View.java"
    assert "r:c:a/src/test/BufferTest.java" in ids(Query("capacity expansion", blend="dense_guarded", top_k=20))
    assert ids(Query("expand", structured_op="symbol_exact")) == ["com.acme.Buffer#expand()."]
    assert ids(Query(structured_op="callers_of", symbol_id="com.acme.Buffer#expand().")) == ["com.acme.View#render()."]
    assert ids(Query(structured_op="def_of", symbol_id="com.acme.Buffer#expand().")) == ["r:c:src/Buffer.java:3:4"]
    assert ids(Query(structured_op="refs_of", symbol_id="com.acme.Buffer#expand().")) == ["r:c:src/View.java"]
    assert ids(Query("capacity", filters={"relative_path": "src/View.java"})) in ([], ["com.acme.View#render()."])
    with pytest.raises(UnsupportedCapability):
        Index(index, "document").run(Query(structured_op="def_of", symbol_id="x"))
    for bad in (Query(""), Query("x", mode="y"), Query("x", top_k=0), Query("x", blend="z"), Query("x", structured_op="w"), Query(structured_op="def_of")):
        with pytest.raises(ValueError):
            ix.run(bad)


def test_described_results(spark, index):
    ix = Index(index)
    r = {x.result_id: x for x in ix.described(ix.run(Query("capacity expansion", blend="rrf")), 8).collect()}
    doc = r["r:c:src/Buffer.java"]
    assert (doc.type, doc.path, doc.code, doc.truncated, doc.source_mode) == ("document", "src/Buffer.java", "capacity", True, "scip")
    s = ix.described(ix.run(Query("expand", structured_op="symbol_exact"))).first()
    assert (s.type, s.name, s.path, s.code) == ("symbol", "expand", "src/Buffer.java", None)
    from gneiss.operators import fusion

    channel = lambda *x: spark.createDataFrame(list(x), "result_id string, payload string")
    fused = spark.createDataFrame([("a", 1.0), ("b", 0.5), ("c", 0.1)], "result_id string, score double")
    got = fusion.with_payload(fused, [channel(("a", None), ("b", "one")), channel(("a", "two"), ("b", "three"))])
    assert {x.result_id: x.payload for x in got.collect()} == {"a": "two", "b": "one", "c": None}


def test_errors_as_values():
    from gneiss import errors
    from gneiss.streaming.embedding import ProviderError

    code = lambda e: errors.described(e)["code"]
    assert [code(x) for x in (UnsupportedCapability("x"), ValueError("mode must be one of a"), ValueError("text is empty"), ProviderError("x", 429), TimeoutError("x"), ConnectionError("x"), FileNotFoundError("x"), PermissionError("x"), KeyError("x"))] == [
        "UNSUPPORTED_CAPABILITY", "UNSUPPORTED_OPERATION", "INPUT_VALIDATION", "RATE_LIMITED", "TIMEOUT", "UPSTREAM_ERROR", "RESOURCE_NOT_FOUND", "PERMISSION_DENIED", "INTERNAL_ERROR",
    ]
    shown = errors.described(ConnectionError("at /data/x: refused"), ("/data/x",))
    assert shown["retryable"] and shown["message"] == "at <path>: refused" and shown["next_steps"]
    assert set(errors.CODES) == set(errors._STEPS)


def test_bm25_equals_sqlite(spark):
    import sqlite3

    docs = ["parse options now", "parse the options", "parse_options parse_options x", "nothing here", "options options options parse", "Café ärger", ""] + [f"filler {i}" for i in range(12)]
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(c)")
    con.executemany("insert into t(rowid, c) values (?, ?)", enumerate(docs, 1))
    for query in ("parse_options", "parse options", "options options", "cafe", "filler here"):
        match = " OR ".join(f'"{w}"' for w in query.split())
        want = {r: -s for r, s in con.execute("select rowid, bm25(t) from t where t match ?", (match,))}
        got = {r["id"]: r["score"] for r in text.bm25(spark.createDataFrame(list(enumerate(docs, 1)), "id long, c string"), "id", ["c"], query).collect()}
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want), query


def test_split_and_pack():
    assert chunking.split_lines("", 100) == []
    body = "\n".join("a b c d e f g h" for _ in range(50))
    spans = chunking.split_lines(body, 80, 16)
    assert spans[0] == (0, 10) and spans[1][0] == 8 and spans[-1][1] == 50
    assert chunking.split_lines("x " * 500 + "\ny", 64) == [(0, 1), (1, 2)]
    spans = [(0, 5, 10), (6, 9, 10), (20, 25, 10), (26, 60, 500), (61, 63, 5)]
    assert chunking.pack_siblings(spans, 60, 160, 3) == [[0, 1], [2], [3], [4]]
