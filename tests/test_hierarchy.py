import random
from datetime import datetime

import pytest

from gneiss.operators.hierarchy import descendants, hierarchy, hierarchy_report, latest_links


def truth(parent):
    out = {}
    for start in parent:
        path, at = [start], start
        while parent.get(at) in parent:
            at = parent[at]
            if at in path:
                path = None
                break
            path.append(at)
        out[start] = (None, None, None, True) if path is None else (path[-1], len(path) - 1, list(reversed(path)), False)
    return out


def run(spark, parent, heavy):
    df = spark.createDataFrame([(k, v, "x", 1) for k, v in parent.items()], "node string, parent string, root string, depth int")
    return {r.node: (r.root, r.depth, r.path, r.in_loop) for r in hierarchy(df.select("node", "parent"), heavy_rows=heavy).collect()}


SHAPES = {
    "chain": {f"c{i:03}": f"c{i - 1:03}" if i else None for i in range(70)},
    "star": {"hub": None} | {f"s{i}": "hub" for i in range(50)},
    "loops": {"a": "b", "b": "a", "c": "c", "d": "c", "e": "d", "f": "a", "g": "f", "x": "y", "y": "z", "z": "x", "ok": "gone", "kid": "ok", "blank": "", "long0": "x"} | {f"long{i}": f"long{i - 1}" for i in range(1, 15)},
    "mixed": {f"n{i}": (f"n{random.Random(i).randrange(i)}" if i % 11 else None) for i in range(1, 120)} | {"n0": None},
}


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("heavy", [3, 10_000])
def test_shapes(spark, shape, heavy):
    parent = SHAPES[shape]
    assert run(spark, parent, heavy) == truth(parent)


def test_descendants_and_report(spark):
    parent = {"r": None, "a": "r", "b": "a", "c": "a", "l": "l", "m": "l"}
    df = spark.createDataFrame(list(parent.items()), "node string, parent string")
    tree = hierarchy(df)
    pairs = sorted((r.ancestor, r.descendant, r.distance) for r in descendants(tree).collect())
    assert pairs == [("a", "b", 1), ("a", "c", 1), ("r", "a", 1), ("r", "b", 2), ("r", "c", 2)]
    report = {r.node: (r.path, r.n_descendants, r.in_loop) for r in hierarchy_report(tree).collect()}
    assert report["b"] == ("r > a > b", 0, False) and report["r"] == ("r", 3, False) and report["m"] == (None, 0, True)


def test_latest_version_wins_and_copies(spark):
    t = [datetime(2024, 1, d) for d in range(1, 9)]
    rows = [("a", "b", t[1], 1), ("a", "", t[3], 1), ("a", "", t[3], 1), ("b", "a", t[2], 1), (None, "a", t[2], 1), ("c", None, t[2], 1)]
    df = spark.createDataFrame(rows, "symbol_id string, enclosing_symbol string, ingested_at timestamp, parent int")
    got = {r.node: (r.root, r.depth, r.in_loop) for r in hierarchy(latest_links(df), paths=False).collect()}
    assert got == {"a": ("a", 0, False), "b": ("a", 1, False), "c": ("c", 0, False)}


def test_empty(spark):
    empty = spark.createDataFrame([], "node string, parent string")
    assert hierarchy(empty).count() == 0
    assert descendants(hierarchy(empty)).count() == 0
