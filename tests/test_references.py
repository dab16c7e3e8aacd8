from datetime import datetime

from gneiss.operators.references import Reference, orphan_report, orphan_rows, orphans

T = [datetime(2024, m, 1) for m in range(1, 13)]
REF = Reference("child", "parent_id", "id", "parent", "key")
CHILD = "id long, parent_id string, ingested_at timestamp, key string, since string"
PARENT = "key string, ingested_at timestamp, deleted_at timestamp, n int"


def run(spark, child, parent):
    c, p = spark.createDataFrame(child, CHILD), spark.createDataFrame(parent, PARENT)
    return sorted((r.row_key, r.key) for r in orphan_rows(c, p, REF).collect())


def test_missing_late_and_deleted_parents(spark):
    child = [(1, "a", T[5], "x", "y"), (2, "b", T[5], None, None), (3, "c", T[5], None, None), (4, "d", T[5], None, None), (5, None, T[5], None, None), (6, "", T[5], None, None)]
    parent = [("a", T[1], None, 1), ("b", T[6], None, 1), ("c", T[1], T[2], 1)]
    assert run(spark, child, parent) == [("2", "b"), ("3", "c"), ("4", "d")]


def test_older_versions_and_equal_times_count(spark):
    child = [(1, "a", T[3], None, None), (2, "a", T[1], None, None)]
    parent = [("a", T[3], None, 1), ("a", T[5], None, 2), ("a", T[0], T[1], 3)]
    assert run(spark, child, parent) == [("2", "a")]


def test_null_times_are_never_in_time(spark):
    child = [(1, "a", None, None, None), (2, "a", T[4], None, None)]
    assert run(spark, child, [("a", T[1], None, 1)]) == [("1", "a")]
    assert run(spark, child, [("a", None, None, 1)]) == [("1", "a"), ("2", "a")]


def test_keys_match_exactly(spark):
    assert run(spark, [(1, "a ", T[4], None, None), (2, "A", T[4], None, None)], [("a", T[1], None, 1)]) == [("1", "a "), ("2", "A")]


def test_empty_tables(spark):
    assert run(spark, [], []) == []
    assert run(spark, [], [("a", T[1], None, 1)]) == []
    assert run(spark, [(1, "a", T[1], None, None)], []) == [("1", "a")]


def test_repeated_rows_and_hot_key(spark):
    child = [(i % 50, "gone", T[i % 12], None, None) for i in range(400)] + [(1000, "a", T[4], None, None)] * 3
    tables = {"child": spark.createDataFrame(child, CHILD), "parent": spark.createDataFrame([("a", T[1], None, 1)], PARENT)}
    found = orphans(tables, (REF,)).collect()
    assert sorted(int(r.row_key) for r in found) == list(range(50))
    report = {r.period: (r.n_rows, r.n_keys) for r in orphan_report(tables, (REF,)).collect()}
    assert sum(n for n, _ in report.values()) == 400 and set(k for _, k in report.values()) == {1} and len(report) == 12
