from hypothesis import given, settings
from hypothesis import strategies as st

from gneiss.operators import code_chunks as cc
from gneiss.operators.chunking import leaf_preferred

BODY = ["class Buffer {", "  /** Adds up. */", "  @Fast", "  int add(int a, int b) {", "    int c = a + b;", "    log(c);", "    check(c);", "    return c;", "  }"]
FILLER = [f"  int field{i} = compute({i}, {i + 1}, {i + 2}) + base * {i};" for i in range(12)]
SMALL = ["  int one() {", "    return 1;", "", "", "  }"]
TEXT = "\n".join(BODY + FILLER + SMALL + SMALL + ["}"])


def definition(symbol, line, start, end, kind="function", owner="Buffer", **context):
    return {"symbol_id": symbol, "line": line, "start": start, "end": end, "function": kind == "function", "container": kind == "container", "owner_symbol": owner} | context


DEFS = [definition("Buffer", 0, 0, 32, "container", ""), definition("add", 3, 3, 9, signature="add", incoming_calls=["main"]), definition("one", 21, 21, 26), definition("two", 26, 26, 31)]
PLAIN = cc.Options(context_tokens=0)


def test_chunks_along_definitions():
    rows = {r[0]: r for r in cc.chunk_document("d", TEXT, DEFS, PLAIN)}
    assert set(rows) == {"d:ast:add:3-9:p1", "d:ast_pack:21-31:one:p1", "d:ast_parent:Buffer:9-21:p1"}
    add = rows["d:ast:add:3-9:p1"]
    assert add[3:5] == (2, 9) and add[7].startswith("  /** Adds up. */")  # the comment and annotation above belong to it
    assert rows["d:ast_pack:21-31:one:p1"][6] == ["one", "two"]
    assert rows["d:ast_parent:Buffer:9-21:p1"][7] == "\n".join(FILLER)


def test_containers_and_leaves():
    both = cc.Options(functions_only=False, context_tokens=0)
    assert {r[0].split(":")[2] for r in cc.chunk_document("d", TEXT, DEFS, both)} == {"add", "21-31"}
    kept = cc.Options(functions_only=False, leaf_preferred=False, context_tokens=0)
    assert any(r[0].startswith("d:ast:Buffer:0-32") for r in cc.chunk_document("d", TEXT, DEFS, kept))


def test_fallbacks():
    short = [definition("a", 1, 1, 2), definition("b", 4, 4, 6)]
    assert [r[0] for r in cc.chunk_document("d", "\n".join("abcdefgh"), short, PLAIN)] == ["d:fn:a:1-4:p1", "d:fn:b:4-8:p1"]
    assert [(r[0], r[6]) for r in cc.chunk_document("d", "x\ny", [definition("v", 0, 0, 1, "field")], PLAIN)] == [("d:doc:p1", ["v"])]
    assert cc.chunk_document("d", "", DEFS, PLAIN) == []
    assert [r[0] for r in cc.chunk_document("d", "x", [definition("far", 90, 90, 99)], PLAIN)] == ["d:doc:p1"]


def test_metadata_and_budgets():
    block = cc.metadata([{"path": "a/B.java", "symbol": "s", "annotations": ["@x", "@y", "@x"], "extends": []}, {"path": "a/B.java", "symbol": "t"}], 100, cc.count_tokens)
    assert block == "path: a/B.java\nsymbol: s, t\nannotations: @x, @y"
    assert cc.metadata([{"path": "a"}], 0, cc.count_tokens) == ""
    long = cc.shortened("word " * 100, 20, cc.count_tokens)
    assert cc.count_tokens(long) <= 20 and long.endswith(" ...")
    rows = cc.chunk_document("d", TEXT, DEFS, cc.Options(target=64, context_tokens=20))
    assert all(r[5] <= 64 for r in rows)
    assert any("signature: add" in r[7] and "incoming_calls: main" in r[7] for r in rows)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=40), st.integers(1, 60), st.integers(0, 20))
def test_windows_hold_the_budget(sizes, budget, overlap):
    lines = ["x " * n for n in sizes]
    spans = list(cc.windows(lines, budget, overlap, cc.count_tokens))
    if not lines:
        assert not spans
        return
    assert sorted({i for a, b in spans for i in range(a, b)}) == list(range(len(lines)))
    for (a, b), following in zip(spans, [*spans[1:], None], strict=True):
        assert b == a + 1 or sum(max(1, n) for n in sizes[a:b]) <= budget
        assert following is None or a < following[0] <= b and sum(max(1, n) for n in sizes[following[0] : b]) <= overlap


def test_syntax_span():
    spans = [(0, 30, "class"), (2, 9, "method"), (2, 20, "class"), (4, 6, "lambda")]
    assert cc.smallest_around(spans, "method", 5) == (2, 9)
    assert cc.smallest_around(spans, "field", 5) == (4, 6)
    assert cc.smallest_around(spans, "method", 40) is None


def test_definitions_without_range_take_syntax_spans():
    from gneiss.sources import java_syntax

    bare = [d | {"end": d["line"] + 1, "enclosed": False} for d in DEFS]
    assert (3, 9, "method") in java_syntax.spans(TEXT) and (0, 32, "type") in java_syntax.spans(TEXT)
    assert cc.chunk_document("d", TEXT, bare, cc.Options(context_tokens=0, syntax=java_syntax.spans)) == cc.chunk_document("d", TEXT, DEFS, PLAIN)


def test_leaves_equal_brute_force(spark):
    import random

    rng = random.Random(4)
    rows = [(f"d{rng.randrange(4)}", i, a, a + rng.randrange(0, 12)) for i in range(200) for a in [rng.randrange(30)]]
    strict = lambda x, y: x[0] == y[0] and x[2] <= y[2] and x[3] >= y[3] and x[2:] != y[2:]
    want = {r[1] for r in rows if not any(strict(r, o) for o in rows)}
    df = spark.createDataFrame(rows, "document_id string, id int, start int, end int")
    assert {r.id for r in leaf_preferred(df).collect()} == want


def test_operator_on_frames(spark):
    docs = spark.createDataFrame([("d", TEXT, "a/B.java", "java"), ("e", None, "x.java", "java"), ("f", "# prose", "r.md", "markdown"), (None, "x", "y.java", "java")], "document_id string, content string, relative_path string, language string")
    occ = [("d", s, "definition", d["line"], d["line"], d["start"], d["end"] - 1) for s, d in ((d["symbol_id"], d) for d in DEFS)]
    occurrences = spark.createDataFrame(occ, "document_id string, symbol_id string, role string, range_start_line int, range_end_line int, enclosing_range_start_line int, enclosing_range_end_line int")
    symbols = spark.createDataFrame([("Buffer", "Buffer", "Class", "", "p")] + [(x, x, "Method", "Buffer", "p") for x in ("add", "one", "two")], "symbol_id string, display_name string, kind string, enclosing_symbol string, package string")
    contexts = symbols.select("symbol_id", "package")
    got = cc.code_chunks(docs, occurrences, symbols, contexts, cc.Options()).collect()
    assert {r.document_id for r in got} == {"d"} and {r.chunk_id.split(":")[1] for r in got} == {"ast", "ast_pack", "ast_parent"}
    assert all(r.content.startswith("package: p") for r in got)
    assert cc.code_chunks(docs.limit(0), occurrences, symbols, contexts).count() == 0
