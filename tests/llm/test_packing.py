import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gneiss.llm import packing

ITEMS = "doc_id long, n_tokens long, piece int, kind int, rest string"


def check(rows, packed, windows):
    for w, capacity in windows:
        mine = [r for r in packed if r.window_id == w]
        by_doc, room = defaultdict(list), defaultdict(int)
        for r in mine:
            by_doc[r.doc_id].append(r)
            if r.container is not None:
                room[r.container] += r.tokens
        assert max(room.values(), default=0) <= capacity
        for i, n in rows:
            pieces = by_doc[i]
            assert sum(p.tokens for p in pieces) == (n or 0)
            assert len(pieces) == max(1, -(-(n or 0) // capacity))
            assert all(p.n_pieces == (len(pieces) if n else 0) for p in pieces)
        yield len(room), sum(room.values())


def run(spark, rows, windows):
    df = spark.createDataFrame([(i, n, 0, 0, "") for i, n in rows], ITEMS)
    return packing.pack(df, windows).collect()


def test_many_items_fill_well(spark):
    rng = random.Random(1)
    rows = [(i, min(9000, int(rng.lognormvariate(5, 1)))) for i in range(4000)]
    windows = [(1, 1024), (2, 1000), (3, 4096), (4, 3073)]
    for (w, capacity), (n, total) in zip(windows, check(rows, run(spark, rows, windows), windows), strict=True):
        assert n <= 1.03 * total / capacity + 1, (w, n, total / capacity)


def test_edges(spark):
    rows = [(1, None), (2, 0), (3, 1), (4, 10), (5, 11), (6, 25), (7, 10), (8, 30), (9, 10**6)]
    windows = [(1, 10)]
    list(check(rows, run(spark, rows, windows), windows))
    assert len(run(spark, [*rows, (None, 25), (None, None)], windows)) == len(run(spark, rows, windows))
    assert run(spark, rows, [(1, None), (2, 0), (3, -4)]) == []
    assert run(spark, [], windows) == []
    assert run(spark, [], []) == []


def test_one_length_for_all(spark):
    rows = [(i, 300) for i in range(1000)]
    (n, _), = check(rows, run(spark, rows, [(1, 1024)]), [(1, 1024)])
    assert n == 334


def test_repeated_rows_are_items(spark):
    packed = run(spark, [(1, 6), (1, 6), (1, 6)], [(1, 10)])
    assert len(packed) == 3 and len({r.container for r in packed}) == 3


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 50), min_size=1, max_size=12), st.integers(40, 60))
def test_configurations_cover_exactly(histogram, capacity):
    import numpy as np

    sizes = np.array(sorted(histogram))
    counts = np.array([histogram[s] for s in sizes.tolist()])
    used = defaultdict(int)
    plan, least = packing.configurations(sizes, counts, capacity)
    assert -(-int(sizes @ counts) // capacity) <= least <= sum(times for _, times in plan)
    for config, times in plan:
        assert times > 0 and sum(int(sizes[i]) * n for i, n in config.items()) <= capacity
        for i, n in config.items():
            used[i] += n * times
    assert [used[i] for i in range(len(sizes))] == counts.tolist()


@pytest.mark.parametrize("capacity", [7, 100])
def test_knapsack_is_optimal(capacity):
    import numpy as np

    rng = np.random.default_rng(capacity)
    sizes, weights = np.arange(2, 8), rng.random(6)
    best = np.zeros(capacity + 1)
    for c in range(1, capacity + 1):
        best[c] = max([best[c - 1]] + [best[c - s] + w for s, w in zip(sizes, weights, strict=True) if s <= c])
    found, value = packing.knapsack(weights, sizes, capacity)
    assert abs(value - best[capacity]) < 1e-9 and abs(sum(weights[i] * n for i, n in found.items()) - best[capacity]) < 1e-9


def test_dual_bound_and_program():
    """600 items of 399 and 1,200 of 297: two of 399 do not leave room, 399 + 2 * 297 is the only good combination."""
    import numpy as np

    sizes, counts = np.array([297, 399]), np.array([1200, 600])
    plan, least = packing.configurations(sizes, counts, 1024)
    assert sum(times for _, times in plan) == 600 and 582 <= least <= 600
    times, bound = packing.solve_program(sizes, counts.astype(float), 1024)
    assert bound <= sum(times.values()) + 18.2  # what is not covered yet needs the rest
    for config, x in times.items():
        assert x > 0 and sum(int(sizes[i]) * n for i, n in config) <= 1024


def test_reports(spark):
    rows = [(1, 25), (2, 4), (3, 6), (4, 0)]
    df = spark.createDataFrame([(i, n, 0, 0, "") for i, n in rows], ITEMS)
    packed = packing.pack(df, [(1, 10)])
    assert [tuple(r) for r in packing.fill_report(packed).collect()] == [(1, 4, 35, 1)]
    assert [tuple(r) for r in packing.fill_check(packed, [(1, 10)]).collect()] == [(1, 35, 1, 0, True)]
    assert [tuple(r) for r in packing.least_containers(df, [(1, 10)]).collect()] == [(1, 4)]
    assert sorted(r.tokens for r in packing.container_report(packed).collect()) == [5, 10, 10, 10]
