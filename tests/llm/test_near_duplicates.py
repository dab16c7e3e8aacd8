import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from gneiss.llm import near_duplicates as nd
from gneiss.llm import textcore

DOCS = "doc_id long, content string, id long, n int, key string, bits string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 7, 7, "k", "b") for i, t in rows], DOCS)


def shingles(text):
    w = textcore.words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def truth(rows, t):
    sets = [(i, shingles(x)) for i, x in dict(rows).items()]
    return sorted((min(a, b), max(a, b)) for k, (a, x) in enumerate(sets) for b, y in sets[:k] if x and y and len(x & y) >= t * len(x | y) - 1e-12)


def corpus(seed, n, words):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    header = [rng.choice(vocabulary) for _ in range(30)]
    out = []
    for i in range(n):
        if i and rng.random() < 0.6:
            base = list(out[rng.randrange(len(out))][1].split())
            for _ in range(rng.randrange(0, 6)):
                k = rng.randrange(len(base))
                base[k : k + 1] = [rng.choice(vocabulary)] * rng.randrange(0, 3)
        else:
            base = (header if rng.random() < 0.5 else []) + [rng.choice(vocabulary) for _ in range(rng.randrange(5, words))]
        out.append((i, " ".join(base)))
    return out


def pairs(df):
    return sorted((r.doc_id_a, r.doc_id_b) for r in df.collect())


def test_equals_brute_force(spark):
    rows = corpus(1, 150, 120)
    for t in (0.6, 0.8):
        assert pairs(nd.similar_pairs(frame(spark, rows), threshold=t)) == truth(rows, t)


def test_hot_cells_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(nd, "HOT_FLOOR", 3)
    monkeypatch.setattr(nd, "HOT_MEAN", 0)
    monkeypatch.setattr(nd, "SKETCH_FAN_IN", 2)
    monkeypatch.setattr(nd.runtime.heavy_keys, "__defaults__", (3,))
    rows = corpus(2, 120, 60)
    assert pairs(nd.similar_pairs(frame(spark, rows), threshold=0.6)) == truth(rows, 0.6)


def test_edges(spark):
    text = "one two three four five six"
    rows = [(1, None), (2, ""), (3, "a b c d"), (4, text), (5, text.upper()), (6, "ONE, two;three\nfour five six!"), (7, "x " * 20_000), (8, "x " * 15_000), (9, "ü ö ä ß é"), (10, "K" + " b c d e f")]
    got = pairs(nd.similar_pairs(frame(spark, rows), threshold=0.6))
    assert got == truth(rows, 0.6)
    assert (4, 5) in got and (7, 8) in got
    assert pairs(nd.similar_pairs(frame(spark, []))) == []
    twice = rows + rows
    assert pairs(nd.similar_pairs(frame(spark, twice), threshold=0.6)) == got


def test_groups_count_links(spark):
    rows = corpus(3, 80, 60) + [(1000 + i, "same text of six whole words here") for i in range(9)]
    linked = truth(rows, 0.6)
    got = {r.doc_id: (r.class_id, r.group_id, r.n_links) for r in nd.similarity_groups(frame(spark, rows), threshold=0.6).collect()}
    for i, text in rows:
        if shingles(text):
            assert got[i][2] == sum(i in p for p in linked)
    assert {got[1000 + i][:2] for i in range(9)} == {(1000, 1000)} and got[1000][2] == 8
    for a, b in linked:
        assert got[a][1] == got[b][1]


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**48 - 1), min_size=1, max_size=200), st.sets(st.integers(0, 2**48 - 1), min_size=1, max_size=200))
def test_manhattan_bounds_hamming(a, b):
    x, y = (nd.segment_counts(np.array(sorted(s), np.uint64)) for s in (a, b))
    assert nd.manhattan(x, y) <= len(a ^ b)


def test_packing_round_trip():
    values = np.unique(np.random.default_rng(1).integers(0, 2**48, 100).astype(np.uint64))
    assert (nd._unpack(nd._pack(values)) == values).all()
