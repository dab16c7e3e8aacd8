from gneiss.operators import retrieval_index as ri
from gneiss.operators import text

DOCS = [("a", "load_ledger frozen load ledger"), ("b", "Ledger of the frozen: load"), ("c", ""), ("d", None), ("e", "other words"), (None, "load ledger"), ("f", "load load_ledger load_ledger")]


def frame(spark):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in DOCS], "id string, body string, term string, tf int")


def test_search_equals_the_scan(spark):
    docs = frame(spark)
    index = ri.postings(docs, "id", ["body"])
    for query in ("load", "load ledger", "load_ledger frozen", "nothing", "ledger_of_the", "load load", "", "load_load"):
        want = {r.id: round(r.score, 9) for r in text.bm25(docs.filter("id is not null"), "id", ["body"], query).collect()} if query else {}
        assert {r.id: round(r.score, 9) for r in ri.search(index, query).collect()} == want, query


def test_only_rows_of_the_terms_are_read(spark):
    plan = ri.search(ri.stored(spark, "test", __file__, lambda: ri.postings(frame(spark), "id", ["body"])), "ledger")._jdf.queryExecution().toString()
    assert "In(term, [ledger])" in plan or "EqualTo(term,ledger)" in plan


def test_stored_once_per_state(spark, tmp_path):
    source, built = tmp_path / "docs.txt", []

    def build():
        built.append(1)
        return spark.createDataFrame([(len(built),)], "n int")

    source.write_text("one")
    assert [ri.stored(spark, "state", str(source), build).first().n for _ in range(2)] == [1, 1]
    source.write_text("three")
    assert ri.stored(spark, "state", str(source), build).first().n == 2


def test_vectors(spark):
    docs = frame(spark)
    vectors = ri.record_vectors(docs, "id", "body")
    query = ri.query_vector("frozen ledger")
    sparse = {}
    for r in text.hash_vector(docs.filter("id is not null"), "id", "body").collect():
        sparse.setdefault(r.id, {})[r.idx] = r.v
    want = {i: round(sum(x * query[k] for k, x in v.items()), 9) for i, v in sparse.items()}
    assert {r.id: round(r.score, 9) for r in ri.nearest_to(vectors, query).collect()} == want
    assert ri.query_vector("") == [0.0] * 128
