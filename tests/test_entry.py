import os
import re

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are missing")
def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["result_id", "score"] and df.count() > 0


def test_core_does_not_import_llm():
    root = os.path.join(os.path.dirname(entry.__file__), "gneiss")
    for folder, _, files in os.walk(root):
        if os.sep + "llm" in folder:
            continue
        for name in files:
            if name.endswith(".py"):
                text = open(os.path.join(folder, name), encoding="utf-8").read()
                assert not re.search(r"^\s*(from|import)\s+gneiss\.llm", text, re.M), name
