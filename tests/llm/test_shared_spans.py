import random

import numpy as np

from gneiss.llm import shared_spans as sp
from gneiss.llm import textcore

DOCS = "doc_id long, text string, rec long, start int, id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, 1, "x") for i, t in rows], DOCS)


def truth(rows, span):
    """Per record the merged stretches that another record holds, by brute force."""
    owners = {}
    for i, t in rows:
        for k in range(len(t or "") - span + 1):
            owners.setdefault(t[k : k + span], set()).add(i)
    out = set()
    for i, t in dict(rows).items():
        starts = np.array([k for k in range(len(t or "") - span + 1) if len(owners[t[k : k + span]]) > 1], np.int64)
        for a, b in zip(*textcore.merge_intervals(starts, starts + span), strict=True):
            out.add((i, int(a), int(b - a)))
    return out


def corpus(seed, n, size, letters="abcdefgh \n"):
    rng = random.Random(seed)
    header = "".join(rng.choice(letters) for _ in range(90))
    out = []
    for i in range(n):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(10, size)))
        if out and rng.random() < 0.7:
            source = rng.choice(out)[1]
            a = rng.randrange(len(source))
            text = text[: len(text) // 2] + source[a : a + rng.randrange(20, 200)] + text[len(text) // 2 :]
        out.append((i, (header if rng.random() < 0.4 else "") + text))
    return out


def got(spark, rows, span, seed, **options):
    return {(r.doc_id, r.start, r.length) for r in sp.shared_spans(frame(spark, rows), span=span, seed=seed, **options).collect()}


def test_equals_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed, 60, 400)
        assert got(spark, rows, 40, 12) == truth(rows, 40)


def test_periodic_texts_and_repeats(spark):
    rows = [(1, "ab" * 200), (2, "ba" * 150), (3, "=" * 500), (4, "x" + "=" * 90), (5, "=" * 39), (6, "q" * 60 + "r" * 60), (7, "r" * 60 + "q" * 60), (8, "z" * 300)]
    assert got(spark, rows, 40, 12) == truth(rows, 40)


def test_block_repeated_in_one_record(spark):
    """A block four times in one record, and edited in another: every place of it counts."""
    for seed in range(3):
        rng = random.Random(seed)
        block = "".join(rng.choices("abcdefghijklmnop", k=280))
        edited = "".join("#" if k % 70 == 35 else c for k, c in enumerate(block))
        between = ["".join(rng.choices("qrstuvw", k=50)) for _ in range(5)]
        rows = [(1, between[0] + "".join(block + b for b in between[1:])), (2, edited), (3, "x" * 30), (4, between[2] + block[100:160])]
        want = truth(rows, 40)
        assert got(spark, rows, 40, 12) == want
        assert sum(1 for i, _, _ in want if i == 1) >= 8


def test_group_bound_changes_nothing(spark):
    rows = corpus(7, 60, 300)
    want = truth(rows, 40)
    for bound in (0, 1, 1 << 30):
        assert got(spark, rows, 40, 12, group_runs=bound) == want


def test_copies_and_edges(spark):
    text = "".join(chr(97 + (i * i * 7 + i // 3) % 26) for i in range(500))
    rows = [(1, None), (2, ""), (3, "short"), (4, text), (5, text), (6, text), (7, "é" * 20 + text[100:300] + "日本語" * 30), (8, text[:39])]
    found = got(spark, rows, 40, 12)
    assert found == truth(rows, 40)
    assert (4, 0, 500) in found and (7, 20, 200) in found
    assert got(spark, rows + rows, 40, 12) == found
    assert got(spark, [], 40, 12) == set()
    assert got(spark, rows + [(None, text), (None, "z" * 90)], 40, 12) == found
    only = [(1, text), (1, text)]
    assert got(spark, only, 40, 12) == set()


def test_amounts(spark):
    text = "".join(random.Random(9).choices("abcdefghij", k=900))
    rows = [(1, text), (2, "y" * 100 + text[200:700]), (3, None)]
    amounts = {r.doc_id: (r.n_chars, r.shared_chars, r.n_spans) for r in sp.shared_amounts(frame(spark, rows)).collect()}
    assert amounts == {1: (900, 500, 1), 2: (600, 500, 1), 3: (0, 0, 0)}


def test_long_texts_are_cut_without_loss(spark, monkeypatch):
    monkeypatch.setattr(sp, "CHUNK_CHARS", 100)
    rows = corpus(5, 12, 1500)
    pieces = list(sp._pieces(textcore.code_points(rows[3][1] * 3), 40))
    assert len(pieces) > 1 or len(rows[3][1]) * 3 <= 400
    a, b = textcore.code_points("".join(chr(65 + i % 50) for i in range(2000))), 40
    covered = [k + base for base, p in sp._pieces(a, b) for k in range(len(p) - b + 1)]
    assert covered == list(range(len(a) - b + 1))


def test_window_minima():
    values = textcore.mix64(np.arange(1000, dtype=np.uint64) % np.uint64(17))
    for width in (1, 2, 7, 50, 1000):
        found = sp.window_minima(values, width)
        want = [max(range(k, k + width), key=lambda i: (-(int(values[i]) >> 24), i)) for k in range(1000 - width + 1)]
        assert found.tolist() == want
