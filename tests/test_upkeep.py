import pytest

from gneiss import runtime
from gneiss.operators import evaluation, symbols, text, upkeep


def test_snapshots_and_routes(spark, tmp_path):
    path = str(tmp_path / "docs")
    rows = lambda *x: spark.createDataFrame(list(x), "repo string, commit string, n int")
    upkeep.replace_snapshot(rows(("a", "1", 1), ("a", "1", 2), ("b", "1", 3)), path, ["repo", "commit"])
    upkeep.replace_snapshot(rows(("a", "1", 9)), path, ["repo", "commit"])
    assert sorted((r.repo, r.n) for r in spark.read.parquet(path).collect()) == [("a", 9), ("b", 3)]
    routes = {"primary": str(tmp_path / "p"), "secondary": str(tmp_path / "s")}
    assert upkeep.write_both(rows(("a", "1", 1)), routes, "dual") == list(routes.values())
    assert upkeep.write_both(rows(("a", "1", 1)), {"primary": routes["primary"], "secondary": routes["primary"]}, "dual") == [routes["primary"]]
    assert spark.read.parquet(routes["primary"]).count() == 2
    with pytest.raises(ValueError):
        upkeep.write_both(rows(("a", "1", 1)), routes, "both")
    upkeep.truncate(rows(("a", "1", 1)), str(tmp_path / "empty"))
    assert spark.read.parquet(str(tmp_path / "empty")).count() == 0
    one = upkeep.append_missing(spark, rows(("a", "1", 1)), str(tmp_path / "m"), "n")
    assert one.count() == 1 and upkeep.append_missing(spark, rows(("a", "1", 1), ("a", "1", 2)), str(tmp_path / "m"), "n").count() == 1


def test_contract(spark):
    contract = spark.createDataFrame([("3",)], "schema_version string")
    full, empty = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([], "x int")
    assert upkeep.contract_problems(contract, "3", {"a": full}) == []
    assert "schema version" in upkeep.contract_problems(contract, "4", {})[0]
    assert upkeep.contract_problems(contract.limit(0), "3", {"a": full, "b": empty}) == ["a has data without a contract"]
    assert upkeep.contract_problems(contract.union(contract), "3", {}) == ["more than one contract row"]


def test_reports(spark, tmp_path):
    a = spark.createDataFrame([("x", 0.5, "secret")], "retriever string, hit double, key string")
    rows = upkeep.report_rows(a, ["retriever", "hit", "none"])
    assert rows == [{"retriever": "x", "hit": 0.5}]
    assert upkeep.markdown_table(rows, ["retriever", "hit"]) == "| retriever | hit |\n| --- | --- |\n| x | 0.5000 |"
    merged = upkeep.merged_reports({"one": a, "two": spark.createDataFrame([("y", 1.0)], "retriever string, hit double")}, "hit", "retriever")
    assert sorted(map(tuple, merged.collect())) == [("x", 0.5, None), ("y", None, 1.0)]
    assert upkeep.allowed_path(str(tmp_path / "a"), [str(tmp_path)]) and not upkeep.allowed_path(str(tmp_path / ".." / "x"), [str(tmp_path)])


def test_numbers_and_percentiles(spark):
    df = spark.createDataFrame([(i * 7 % 100,) for i in range(100)], "x int")
    got = {r.x: r.rank for r in runtime.numbered(df, ["x"]).collect()}
    assert got == {i: i + 1 for i in range(100)}
    values = spark.createDataFrame([("a", float(i % 10)) for i in range(101)] + [("b", 1.0), ("c", None)], "g string, v double")
    want = {"a": sorted(i % 10 for i in range(101))[int(0.95 * 100)], "b": 1.0}
    assert {r.g: r.v for r in evaluation.lower_percentile(values, "g", "v", 0.95).collect()} == want


def test_joins_with_heavy_keys(spark):
    big = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 99), (None, 3), (4, 4)], "k int, v int")
    small = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (5, "d")], "k int, w string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        plain = sorted(map(repr, big.join(small, ["k"], how).collect()))
        assert sorted(map(repr, runtime.join_salted(big, small, ["k"], ["v"], how, 4, 10).collect())) == plain


def test_small_functions(spark):
    df = spark.createDataFrame([("a\nb\nc\nd\ne", 2, "m.n")], "t string, i int, p string")
    r = df.select(text.snippet("t", "i", 1).alias("s"), text.package_glob("p").alias("g")).first()
    assert (r.s, r.g) == ("b\nc\nd", "**/m/n/**/*.java")
    assert text.entity_pattern("class", "A$") == r"\b(?:class|interface|enum|record|@interface)\s+A\$\b"
    assert text.asks_for_tests("unit  tests of x") and text.asks_for_tests("查看单元测试") and not text.asks_for_tests("latest contest")
    p = spark.createDataFrame([("x", 1.0, "", "one"), ("y", 5.0, "py", "")], "result_id string, score double, payload string, explain string")
    f = spark.createDataFrame([("x", 2.0, "px", "two")], p.schema)
    assert [tuple(r) for r in symbols.merge_payloads(p, f, 5).collect()] == [("y", 5.0, "py", ""), ("x", 2.0, "px", "one; two")]


def test_registry_file(spark, tmp_path):
    from gneiss.sources import registry

    path = str(tmp_path / "r" / "index.json")
    assert registry.load(path) == [] and not registry.remove("a", path)
    for slug, status in (("b", "ready"), ("a", "building"), ("b", "failed"), ("c", "ready")):
        registry.put({"slug": slug, "status": status, "mcp_path": f"/{slug}/"}, path)
    assert [(e["slug"], e["status"]) for e in registry.load(path)] == [("a", "building"), ("b", "failed"), ("c", "ready")]
    assert registry.remove("a", path) and registry.frame(spark, path).count() == 2
    conf = registry.gateway(registry.load(path), 80, 9000)
    assert "location /c {" in conf and "127.0.0.1:9000" in conf and "/b" not in conf
    assert [x.name for x in (tmp_path / "r").iterdir()] == ["index.json"]
