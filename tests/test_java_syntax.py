from gneiss.operators import java
from gneiss.sources import backends, java_syntax

APP = """package demo.app;
import demo.service.*;
import demo.anno.Autowired;
public class App implements Runner {
  @Autowired
  private Service service; // "x {"
  private int n = 0;
  public App(int n) { this.n = n; }
  @Bean("a{b")
  public int run(int x, Other o) {
    helper(x, g(1, 2));
    if (n > 3) { return service.total(); }
    return new Service(2).size() + o.value();
  }
  private void helper(int a, int b) { String s = "} {"; }
  int g(int a, int b) { return a; }
}
"""
FILES = [
    ("src/demo/app/App.java", APP),
    ("src/demo/app/Runner.java", "package demo.app;\ninterface Runner {\n  int run(int x, Other o);\n}\n"),
    ("src/demo/app/Other.java", "package demo.app;\nclass Other {\n  int value() { return 1; }\n}\n"),
    ("src/demo/service/Service.java", "package demo.service;\npublic class Service {\n  public Service(int k) {}\n  public int total() { return 1; }\n}\n"),
    ("src/demo/anno/Autowired.java", "package demo.anno;\npublic @interface Autowired {}\n"),
    ("src/demo/app/Bean.java", "package demo.app;\n@interface Bean { String value(); }\n"),
    ("src/broken/B.java", "package broken;\nclass B { void f() { if (x) {"),
    ("src/empty/E.java", ""),
    ("src/none/N.java", None),
]


def tables(spark):
    return java_syntax.index_sources(spark.createDataFrame(FILES, "path string, content string"))


def test_declarations_and_spans(spark):
    t = tables(spark)
    symbols = {r.symbol_id: (r.kind, r.enclosing_symbol) for r in t["symbols"].collect()}
    assert symbols["demo.app.App"] == ("Class", "") and symbols["demo.app.Runner"][0] == "Interface" and symbols["demo.anno.Autowired"][0] == "Annotation"
    assert symbols["demo.app.App#App/1"] == ("Constructor", "demo.app.App") and symbols["demo.app.App#service"] == ("Field", "demo.app.App")
    assert {"demo.app.App#run/2", "demo.app.App#helper/2", "demo.app.Runner#run/2", "broken.B", "broken.B#f/0"} <= set(symbols)
    spans = {r.symbol_id: (r.range_start_line, r.enclosing_range_start_line, r.enclosing_range_end_line) for r in t["occurrences"].filter("role = 'definition'").collect()}
    assert spans["demo.app.App#run/2"] == (9, 9, 13) and spans["demo.app.App"] == (3, 3, 16) and spans["broken.B"] == (1, -1, -1)


def test_relations(spark):
    got = {(r.from_symbol, r.relation_type, r.to_symbol) for r in tables(spark)["relations"].collect()}
    assert {
        ("demo.app.App", "implements", "demo.app.Runner"), ("demo.app.App#service", "annotated_with", "demo.anno.Autowired"), ("demo.app.App#service", "field_type", "demo.service.Service"), ("demo.app.App#run/2", "annotated_with", "demo.app.Bean"),
        ("demo.app.App#run/2", "calls", "demo.app.App#helper/2"), ("demo.app.App#run/2", "calls", "demo.app.App#g/2"), ("demo.app.App#run/2", "calls", "demo.service.Service#total/0"), ("demo.app.App#run/2", "calls", "demo.app.Other#value/0"),
        ("demo.app.App#run/2", "calls", "demo.service.Service"), ("demo.app.App#run/2", "field_refs", "demo.app.App#service"), ("demo.app.App#App/1", "field_refs", "demo.app.App#n"),
    } <= got
    assert not any(to.startswith("java.") or to == "" for _, _, to in got)


def test_wildcards_before_global_names(spark):
    types = spark.createDataFrame([("a.X", "a", "X"), ("b.X", "b", "X"), ("c.Y", "c", "Y"), ("b.Z", "b", "Z"), ("a.Z", "a", "Z")], "symbol_id string, package string, name string")
    uses = spark.createDataFrame([("d", "own", x) for x in ("X", "Y", "Z", "None")], "document_id string, package string, name string")
    imported = spark.createDataFrame([("d", None, "b", True), ("d", "Z", "a.Z", False)], "document_id string, name string, qualified string, wildcard boolean")
    assert {(r.name, r.symbol_id) for r in java.resolve_types(uses, imported, types).collect()} == {("X", "b.X"), ("Y", "c.Y"), ("Z", "a.Z")}
    both = imported.unionByName(spark.createDataFrame([("d", None, "a", True)], imported.schema))
    assert ("X", "b.X") not in {(r.name, r.symbol_id) for r in java.resolve_types(uses, both, types).collect()}


def test_names():
    assert java.type_references("Map<String, List<a.B>>, c.D & E") == ["Map", "E"]
    assert java.annotation_name("@Bean(name = 1)", {"Bean": "x.Bean"}, []) == "x.Bean"
    assert java.annotation_name("y.Bean", {}, ["p"]) == "y.Bean" and java.annotation_name("Bean", {}, ["p"]) == "p.Bean" and java.annotation_name("Bean", {}, ["p", "q"]) == ""


def test_backends(spark, tmp_path):
    for path, text in FILES[:5]:
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    found, mode, reasons = backends.load_index(spark, "auto", str(tmp_path / "no.scip"), str(tmp_path))
    assert mode == "syntax" and reasons and found["symbols"].filter("symbol_id = 'demo.app.App'").count() == 1
    assert backends.load_index(spark, "document", None, str(tmp_path))[0]["documents"].count() == 5
    docs = spark.createDataFrame([("r:c:demo/app/App.java", "demo/app/App.java", ""), ("x", "y/Z.java", "kept")], "document_id string, relative_path string, content string")
    files = spark.createDataFrame([("/tmp/src/demo/app/App.java", "text"), ("/tmp/y/Z.java", "other")], "path string, content string")
    assert {(r.document_id, r.content) for r in backends.with_texts(docs, files).collect()} == {("r:c:demo/app/App.java", "text"), ("x", "kept")}
