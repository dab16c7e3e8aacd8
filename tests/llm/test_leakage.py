import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from gneiss.llm import leakage, textcore

DOCS, ITEMS = "doc_id long, text string, item_id long", "item_id long, text string, doc_id long"


def frames(spark, docs, items):
    return spark.createDataFrame([(i, t, 1) for i, t in docs], DOCS), spark.createDataFrame([(i, t, 1) for i, t in items], ITEMS)


def truth(docs, items, n):
    grams = lambda t: {tuple(w[i : i + n]) for w in [textcore.words(t)] for i in range(len(w) - n + 1)}
    return sorted({(d, i) for d, t in docs for i, u in items if grams(t) & grams(u)})


def run(spark, docs, items, n=12):
    return sorted((r.doc_id, r.item_id) for r in leakage.leaked_documents(*frames(spark, docs, items), phrase=n).collect())


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(60)}"
    items = [(i, " ".join(word() for _ in range(rng.randrange(2, 30)))) for i in range(30)]
    docs = []
    for d in range(80):
        w = [word() for _ in range(rng.randrange(0, 80))]
        if rng.random() < 0.5:
            source = textcore.words(rng.choice(items)[1])
            a = rng.randrange(len(source))
            k = rng.randrange(len(w) + 1)
            w[k:k] = source[a : a + rng.randrange(1, 25)]
        docs.append((d, ", ".join(w)))
    return docs, items


def test_equals_brute_force(spark, monkeypatch):
    docs, items = corpus(1)
    assert run(spark, docs, items, 5) == truth(docs, items, 5)
    monkeypatch.setattr(leakage, "BLOCK_WORDS", 100)
    assert run(spark, docs, items, 3) == truth(docs, items, 3)


def test_blocks_share_an_index(monkeypatch):
    """One index, searched block by block, finds what one block finds, also with a bitmap that lets every word pass."""
    docs, items = corpus(3)
    held = [(d, textcore.word_hashes(t)) for d, t in docs]
    everything = np.ones(1 << leakage.BITMAP_BITS, bool)
    shard = leakage.Shard(held, everything, 4)
    whole = sorted(shard.search(leakage.Phrases(items, 4)))
    assert {(d, i) for d, i, _, _ in whole} == set(truth(docs, items, 4))
    assert sorted(x for k in range(0, 30, 7) for x in shard.search(leakage.Phrases(items[k : k + 7], 4))) == whole


def test_spans(spark):
    item = " ".join(f"a{i}" for i in range(20))
    docs = [(1, "x y " + item.upper() + " z"), (2, "b " + " ".join(f"a{i}" for i in range(3, 16)) + "\nc"), (3, " ".join(f"a{i}" for i in range(11))), (4, item + " q " + item)]
    spans = sorted(tuple(r) for r in leakage.leaked_spans(*frames(spark, docs, [(7, item)])).collect())
    assert spans == [(1, 7, 2, 20), (2, 7, 1, 13), (4, 7, 0, 20), (4, 7, 21, 20)]


def test_edges(spark):
    item = " ".join(f"a{i}" for i in range(12))
    docs = [(1, None), (2, ""), (3, item), (3, item), (4, item), (5, "w " * 50_000 + item)]
    items = [(1, item), (2, item), (3, None), (4, ""), (5, "too short")]
    assert run(spark, docs, items) == [(d, i) for d in (3, 4, 5) for i in (1, 2)]
    assert run(spark, [], items) == [] and run(spark, docs, []) == [] and run(spark, [], []) == []


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=80), st.lists(st.integers(1, 4), min_size=1, max_size=4))
def test_index_counts_and_places(text, phrase):
    index = leakage.FMIndex(np.array(text), 5)
    low, high = index.search(np.array([phrase]))
    want = [i for i in range(len(text) - len(phrase) + 1) if text[i : i + len(phrase)] == phrase]
    assert high[0] - low[0] == len(want) or not want and low[0] >= high[0]
    if want:
        assert sorted(index.locate(np.arange(low[0], high[0])).tolist()) == want
