import os
import re
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gneiss.llm import tokens

DOCS = "content string, source string, repo string, commit_hash string, language string, n_tokens long"


def plain(text):
    return sum(max(1, len(re.findall(r"\w+|[^\w\s]", line))) for line in text.split("\n")) if text else 0


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text("ab_ .\n\t\r\x0b\x85  é中", max_size=60))
def test_counter_equals_the_pattern(text):
    assert tokens.count_tokens(text) == plain(text)


def greedy(words, data):
    n = i = 0
    while i < len(data):
        i += next(k for k in range(len(data) - i, 0, -1) if k == 1 or data[i : i + k] in words)
        n += 1
    return n


@settings(max_examples=200, deadline=None)
@given(st.sets(st.binary(min_size=1, max_size=5).map(lambda b: bytes(x % 3 + 97 for x in b)), max_size=12), st.binary(max_size=40).map(lambda b: bytes(x % 3 + 97 for x in b)))
def test_longest_match_equals_greedy(words, data):
    machine = tokens.LongestMatch([[(w, 1, 0) for w in [*(bytes([b]) for b in range(256)), *sorted(words)]]])
    assert machine.count(data) == greedy(words, data)


def test_lines_run_through_the_trie():
    """The table over three symbols says what the machine emits symbol by symbol."""
    machine, kinds = tokens.line_machine(), [0, 2, 2, 1, 3, 3, 2, 0, 0, 1, 2, 0]
    node, total = 0, 0
    for k in kinds:
        node, emitted = machine.step(node, k)
        total += emitted
    assert total == machine.count(kinds) == 5
    padded = [0, 0, *kinds]
    assert sum(int(machine.emissions(4)[tuple(padded[i : i + 3])]) for i in range(len(kinds))) == total


@pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="vocabulary file is missing")
def test_public_vocabulary(spark):
    with open(tokens.VOCABULARY, "rb") as file:
        m = tokens.byte_machine(file.read())
    assert m.count(b" the") == 1 and m.count(b"") == 0 and m.count("日本".encode()) >= 1
    df = spark.createDataFrame([("def f(x):\n  return x",), ("",), (None,), ("é中",)], "content string")
    found = [r[0] for r in df.select(tokens.subword_counts(spark, "content")).collect()]
    assert found[1:3] == [0, 0] and found[0] > 5 and found[3] > 0


def test_totals_and_wrong_totals(spark):
    rows = [("a b", "s", "r", "c", " Java ", 9), ("a b", "s", "r", "c", "java", 9), (None, "s", "r", "c", "JAVA", 9), ("x", "s", "r", "c", None, 9), ("y\n\nz", None, "r", None, "", 9), ("w " * 100_000, "s", "big", "c", "go", 9)]
    docs = spark.createDataFrame(rows, DOCS)
    totals = {(r.source, r.repo, r.commit_hash, r.language): (r.n_docs, r.n_tokens) for r in tokens.token_totals(docs, ["source", "repo", "commit_hash", "language"]).collect()}
    assert totals == {("s", "r", "c", "java"): (3, 4), ("s", "r", "c", ""): (1, 1), (None, "r", None, ""): (1, 3), ("s", "big", "c", "go"): (1, 100_000)}
    t = datetime(2024, 1, 1)
    reported = [("s", "r", "c", "java", None, 4, t), ("s", "r", "c", "", 1, 2, t), (None, "r", None, "", 1, 3, t), ("s", "none", "c", "x", 1, 0, t), ("s", "none", "c", "y", 1, 5, t), ("s", "big", "c", "go", 1, None, t)]
    snapshot = spark.createDataFrame(reported, "source string, repo string, commit_hash string, language string, n_docs long, n_tokens long, reported_at timestamp")
    wrong = sorted((r.repo, r.language) for r in tokens.wrong_totals(docs, snapshot).collect())
    assert wrong == [("big", "go"), ("none", "y"), ("r", "")]


def test_empty(spark):
    docs = spark.createDataFrame([], DOCS)
    snapshot = spark.createDataFrame([], "source string, repo string, commit_hash string, language string, n_tokens long")
    assert tokens.token_totals(docs, ["source"]).count() == 0 and tokens.wrong_totals(docs, snapshot).count() == 0
