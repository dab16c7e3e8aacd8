import json

import numpy as np

from gneiss.llm import neighbours as nb

TABLE = "node_id string, vec string, key long, ids string, list int"


def frame(spark, rows):
    return spark.createDataFrame([(n, v, 1, "", 2) for n, v in rows], TABLE)


def truth(rows, dim, k):
    vecs = {}
    for n, t in sorted((n, t) for n, t in rows if n is not None and t is not None):
        vecs.setdefault(n, t)
    valid = {n: v for n, t in vecs.items() if (v := nb.parse_vector(t, dim)) is not None}
    names = sorted(valid)
    if not names:
        return {}
    x = np.stack([valid[n] for n in names])
    cos = np.round(x @ x.T, 9)
    return {n: [m for _, m in sorted((-cos[i, j], m) for j, m in enumerate(names) if j != i)[:k]] for i, n in enumerate(names)}


def found(spark, rows, dim, k=5, **options):
    out = {}
    for r in nb.nearest_nodes(frame(spark, rows), "vec", dim, k, **options).collect():
        out.setdefault(r.node, []).append((r.rank, r.neighbour))
    return {n: [m for _, m in sorted(v)] for n, v in out.items()}


def vectors(seed, n, dim):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, dim))
    return [(f"n{i:05}", json.dumps([round(float(v), 6) for v in centres[rng.integers(20)] + rng.normal(size=dim) * 0.4])) for i in range(n)]


def test_recall(spark):
    rows = vectors(1, 2500, 16)
    want, got = truth(rows, 16, 5), found(spark, rows, 16, probes=6)
    assert set(got) == set(want)
    assert sum(len(set(got[n]) & set(want[n])) for n in want) / (5 * len(want)) >= 0.9


def test_exact_setting_and_blocks(spark, monkeypatch):
    """All probes and all candidates give the exact answer, whatever the sizes of groups and blocks."""
    rows = vectors(2, 500, 8)
    want = truth(rows, 8, 5)
    assert found(spark, rows, 8, probes=None, rerank=None) == want
    monkeypatch.setattr(nb, "GROUP_QUERIES", 100)
    monkeypatch.setattr(nb, "QUERY_BLOCK", 60)
    monkeypatch.setattr(nb, "CODE_BLOCK", 150)
    assert found(spark, rows, 8, probes=None, rerank=None) == want


def test_lists_are_scored_for_their_queries_only(monkeypatch):
    rng = np.random.default_rng(5)
    data = rng.normal(size=(300, 8))
    model = nb.Model(data, 12, 3)
    home, codes = model.encode(data)
    order = np.argsort(home, kind="stable")
    homes, lengths = np.unique(home, return_counts=True)
    probed = model.probes(data, 4)
    centre, table = model.tables(data)
    scores = centre[:, home] + sum(t[:, codes[:, m]] for m, t in enumerate(table))
    scores[~(probed[:, :, None] == home).any(axis=1)] = -np.inf
    for held in (1 << 22, 200):
        monkeypatch.setattr(nb, "HELD_SCORES", held)
        q, c, s = nb.search_lists(model, data, probed, homes, lengths, codes[order], 7)
        for i in range(300):
            assert np.allclose(np.sort(s[q == i]), np.sort(scores[i])[-7:], atol=1e-4)
        assert np.allclose(scores[q, order[c]], s, atol=1e-4)


def test_shared_vector_in_salted_parts(spark, monkeypatch):
    same = json.dumps([1.0, 2.0, 0.0, 0.0])
    rows = [(f"s{i:03}", same) for i in range(200)] + vectors(4, 100, 4)
    monkeypatch.setattr(nb.runtime.join_salted, "__defaults__", ("inner", 8, 50))
    assert found(spark, rows, 4, probes=None, rerank=None) == truth(rows, 4, 5)


def test_ties_copies_and_invalid(spark):
    same = json.dumps([1.0, 2.0, 0.0, 0.0])
    rows = [(f"s{i:02}", same) for i in range(40)] + [("t1", "[2,4,0,0]"), ("t2", "[0,0,1,1]"), ("t2", "[0,0,1,1]"), ("zero", "[0,0,0,0]"), ("short", "[1,2]"), ("bad", "[1,2,"), ("text", '["1","2","3","4"]'), ("none", None), (None, same), ("nan", "[NaN,1,1,1]"), ("inf", "[1e999,1,1,1]"), ("bool", "[true,1,1,1]"), ("obj", '{"a":1}'), ("big", "[1e300,1e300,0,0]")]
    assert found(spark, rows, 4) == truth(rows, 4, 5)
    assert found(spark, rows, 4)["s00"] == ["s01", "s02", "s03", "s04", "s05"]


def test_small_and_empty(spark):
    assert found(spark, [], 4) == {}
    assert found(spark, [("a", "[1,0,0,0]")], 4) == {}
    assert found(spark, [("a", "[1,0,0,0]"), ("b", "[0,1,0,0]")], 4) == {"a": ["b"], "b": ["a"]}
