import json

import pytest

from gneiss.operators import java
from gneiss.sources import datasets, records, scip


def varint(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def field(number, value):
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    data = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(data)) + data


def sample():
    ints = lambda *x: b"".join(map(varint, x))
    occ = field(1, ints(3, 4, 300)) + field(2, "s1") + field(3, 1) + field(7, ints(3, 0, 9, 1))
    ref = field(1, 5) + field(1, 6) + field(1, 7) + field(2, "s2") + field(3, 8)
    sym = field(1, "s1") + field(6, "run") + field(5, 26) + field(4, field(1, "s0") + field(3, 1))
    doc = field(1, "a/B.java") + field(4, "JAVA") + field(5, "class B {}") + field(2, occ) + field(2, ref) + field(3, sym)
    return field(1, b"") + field(2, doc) + field(3, field(1, "ext"))


def test_binary_index(spark, tmp_path):
    (tmp_path / "i.scip").write_bytes(sample())
    parsed = scip.read_scip(spark, str(tmp_path), "r", "c").cache()
    d = records.of_type(parsed, "document").collect()
    assert [(x.document_id, x.language, x.content, x.occurrence_count) for x in d] == [("r:c:a/B.java", "java", "class B {}", 2)]
    o = sorted((x.symbol_id, x.role, x.range_start_line, x.range_end_col, x.enclosing_range_end_line) for x in records.of_type(parsed, "occurrence").collect())
    assert o == [("s1", "definition", 3, 300, 9), ("s2", "reference", 5, 7, -1)]
    assert sorted(x.symbol_id for x in records.of_type(parsed, "symbol").collect()) == ["ext", "s1"]
    assert [tuple(x)[:3] for x in records.of_type(parsed, "relation").collect()] == [("s1", "s0", "implements")]


def test_damaged_binary_index():
    for cut in (3, 20, len(sample()) - 1):
        with pytest.raises(ValueError):
            list(scip.index_records(sample()[:cut], "r", "c"))
    assert list(scip.index_records(b"", "r", "c")) == []


def test_datasets(spark, tmp_path):
    def rows(text):
        path = tmp_path / "d.json"
        path.write_text(text)
        return [tuple(r) for r in datasets.read_dataset(spark, str(path)).collect()]

    assert rows('{"samples": [{"query": "a", "relevant_ids": ["x"]}]}') == [("1", "a", [], ["x"], None)]
    assert rows('[{"id": 7, "query": "a", "gold_files": "f | g |", "repo_sha": "s"}]') == [("7", "a", ["f", "g"], [], "s")]
    assert rows('{"query": "a", "ground_truth": {"gold_files": ["f"]}}\n\n{"query": "b"}\n') == [("1", "a", ["f"], [], None), ("2", "b", [], [], None)]
    for bad in ('{"query": "a"}\n{oops\n', '{"query": "a"}\n{"x": 1}\n', '[1]'):
        with pytest.raises(ValueError, match=":[12]:"):
            rows(bad)


def test_source_tree_and_reader(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "X.java").write_text("class X {\n}\n")
    (tmp_path / "a" / "y.py").write_text("pass")
    files = records.source_tree(spark, str(tmp_path)).collect()
    assert [(f.path.rsplit("/", 1)[-1], f.content) for f in files] == [("X.java", "class X {\n}\n")]
    with pytest.raises(ValueError):
        records.read_index(spark, "x.txt")
    (tmp_path / "i.ndjson").write_text(json.dumps({"type": "document", "relative_path": "p"}) + "\nbad\n")
    assert records.read_index(spark, str(tmp_path / "i.ndjson")).count() == 1


def test_java_names(spark):
    assert java.without_generics("Map<String, List<X>> a, B<C>") == "Map a, B"
    assert java.without_generics("> x < y") == " x "
    df = spark.createDataFrame([("semanticdb maven a 1 org/x/Foo#run().", "org.x.Foo#run/0"), ("local 4", "org.x.Foo"), ("scip-java maven a 1 org/x/", "`Foo`#`go`(int)")], "s string, g string")
    got = [tuple(r) for r in df.select(java.descriptor("s"), java.package_path("s"), java.source_suffix("s"), java.type_name("g"), java.method_hint("g")).collect()]
    assert got == [("org/x/Foo#run().", "org/x", "org/x/Foo.java", "org.x.Foo", "run"), ("", "", None, "org.x.Foo", None), ("org/x/", "org/x", None, "Foo", "go")]
