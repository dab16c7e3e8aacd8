"""Token counts and token budgets (problem 5).

Both counters run one longest-match machine: a vocabulary held as a trie whose nodes have failure links.  A link tells
where matching goes on when the next symbol does not fit, and how many tokens are emitted on the way, so a text is
counted in one pass without going back.  An entry of the vocabulary may lead to another trie, for pieces that only
continue a token.

* ``subword_counts``: symbols are bytes, the vocabulary is that of a public tokenizer (its file is a parameter; the
  driver reads it and sends it with the job).  Texts are cut into words first, and counts of words are remembered.
* ``token_counts``: the project's own counter.  Symbols are classes of characters; a word character begins a token and
  leads to the trie in which further word characters continue it for nothing, any other visible character is a token, white
  space is none; a line without any counts one.  In this machine two symbols fix the state, so its emissions become
  a table over three neighbouring symbols, derived from the links and applied to whole arrays.

Defined results: null and empty texts have 0 tokens; repeated rows count each time; null and blank keys are groups
of their own; extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import base64
import os
import re
from collections import deque
from collections.abc import Iterable
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss import runtime
from gneiss.llm import textcore

#: Classes of characters, with Python's Unicode meaning of \\w and \\s.
LINE_END, SPACE, WORD, OTHER = range(4)
#: Distinct pieces of text whose counts a worker remembers.
PIECE_CACHE = 1 << 18
PIECE = re.compile(r" ?[^\s]+|\s+")
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Largest vocabulary file that is sent to the tasks.
MOST_VOCABULARY = 64 << 20


class LongestMatch:
    """Tries over sequences of symbols with failure links; a link carries the tokens emitted when it is taken.

    ``tries`` lists vocabularies of entries (symbols, tokens it counts, trie in which matching goes on); matching begins in
    trie 0, and what a later trie does not know goes on in trie 0.  Every symbol must be an entry of trie 0.
    """

    def __init__(self, tries: list[Iterable[tuple[Iterable[int], int, int]]]) -> None:
        roots = list(range(len(tries)))
        self.next: dict[tuple[int, int], int] = {}
        ends: list[tuple[int, int] | None] = [None for _ in roots]
        children: list[list[tuple[int, int]]] = [[] for _ in roots]
        for root, entries in zip(roots, tries, strict=True):
            for symbols, counts, then in entries:
                node = root
                for symbol in symbols:
                    if (node, symbol) not in self.next:
                        self.next[node, symbol] = len(ends)
                        children[node].append((symbol, len(ends)))
                        ends.append(None)
                        children.append([])
                    node = self.next[node, symbol]
                if node not in roots:
                    ends[node] = (then, counts)
        self.fail, self.emit = [0] * len(ends), [0] * len(ends)
        todo = deque((root, symbol, node) for root in roots for symbol, node in children[root])
        while todo:
            parent, symbol, node = todo.popleft()
            if ends[node] is not None:
                self.fail[node], self.emit[node] = ends[node]
            else:
                place, emitted = self.fail[parent], self.emit[parent]
                while (place, symbol) not in self.next:
                    emitted += self.emit[place]
                    place = self.fail[place]
                self.fail[node], self.emit[node] = self.next[place, symbol], emitted
            todo.extend((node, s, child) for s, child in children[node])

    def step(self, node: int, symbol: int) -> tuple[int, int]:
        """The node after one more symbol, and the tokens emitted."""
        emitted = 0
        while (following := self.next.get((node, symbol))) is None:
            emitted += self.emit[node]
            node = self.fail[node]
        return following, emitted

    def count(self, symbols: Iterable[int]) -> int:
        """Tokens of the longest-match split."""
        after, fail, emit = self.next, self.fail, self.emit
        node = total = 0
        for symbol in symbols:
            while (following := after.get((node, symbol))) is None:
                total += emit[node]
                node = fail[node]
            node = following
        while node:
            total += emit[node]
            node = fail[node]
        return total

    def emissions(self, symbols: int) -> np.ndarray:
        """Tokens emitted on reading z after x and y, as [x, y, z], for a machine whose state two symbols fix."""
        nodes = range(len(self.fail))
        table = np.zeros((symbols,) * 3, np.uint8)
        for x, y in product(range(symbols), repeat=2):
            (state,) = {self.step(self.step(node, x)[0], y)[0] for node in nodes}
            for z in range(symbols):
                table[x, y, z] = self.step(state, z)[1]
        return table


@lru_cache(maxsize=1)
def line_machine() -> LongestMatch:
    """The project's counter: trie 0 has every class, trie 1 what continues a run of word characters."""
    return LongestMatch([[((LINE_END,), 0, 0), ((SPACE,), 0, 0), ((WORD,), 1, 1), ((OTHER,), 1, 0)], [((WORD,), 0, 1)]])


@lru_cache(maxsize=1)
def _line_emissions() -> np.ndarray:
    return line_machine().emissions(4).ravel()


@lru_cache(maxsize=1)
def character_classes() -> np.ndarray:
    every = "".join(map(chr, range(0x110000)))
    table = np.full(0x110000, OTHER, np.uint8)
    for pattern, kind in ((r"\w", WORD), (r"\s", SPACE)):
        table[[m.start() for m in re.finditer(pattern, every)]] = kind
    table[ord("\n")] = LINE_END
    return table


def count_tokens(text: str | None) -> int:
    if not text:
        return 0
    kinds = np.full(len(text) + 3, LINE_END, np.uint8)
    kinds[2:-1] = character_classes()[textcore.code_points(text)]
    emitted = _line_emissions()[kinds[:-2] * np.uint8(16) + kinds[1:-1] * np.uint8(4) + kinds[2:]]
    # What is emitted up to and with a line end belongs to that line.
    ends = np.nonzero(kinds[2:] == LINE_END)[0]
    lines = np.add.reduceat(emitted, np.r_[0, ends[:-1] + 1], dtype=np.int64)
    return int(np.maximum(lines, 1).sum())


def token_counts(column: Column | str) -> Column:
    """Tokens of each text under the project's own counter."""

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        return pa.array(map(count_tokens, texts.to_pylist()), pa.int64())

    return count(column)


@lru_cache(maxsize=2)
def byte_machine(data: bytes) -> LongestMatch:
    """The machine of a vocabulary file (base64 word and rank per line); every single byte counts as a word too."""
    words = (base64.b64decode(line.split()[0]) for line in data.splitlines() if line.strip())
    return LongestMatch([[(w, 1, 0) for w in (*(bytes([b]) for b in range(256)), *words)]])


class _Counts(dict):
    def __init__(self, machine: LongestMatch) -> None:
        self.machine = machine

    def __missing__(self, piece: str) -> int:
        if len(self) >= PIECE_CACHE:
            self.clear()
        n = self[piece] = self.machine.count(piece.encode("utf-8", "surrogatepass"))
        return n


@lru_cache(maxsize=2)
def _remembered(data: bytes) -> _Counts:
    return _Counts(byte_machine(data))


def subword_counts(spark: SparkSession, column: Column | str, vocabulary: str = VOCABULARY) -> Column:
    """Tokens of each text by longest match over a byte vocabulary, where text is first cut into words with one leading
    space and runs of white space.  The file is read by the driver; it may have ``MOST_VOCABULARY`` bytes."""
    if os.path.getsize(vocabulary) > MOST_VOCABULARY:
        raise ValueError(f"{vocabulary} is larger than {MOST_VOCABULARY} bytes")
    with open(vocabulary, "rb") as file:
        sent = spark.sparkContext.broadcast(file.read())

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        known = _remembered(sent.value)
        return pa.array((sum(map(known.__getitem__, PIECE.findall(t))) if t else 0 for t in texts.to_pylist()), pa.int64())

    return count(column)


def language_key(column: Column | str) -> Column:
    return F.trim(F.lower(F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))))


def token_totals(docs: DataFrame, keys: list[str], text_col: str = "content", language_col: str = "language", vocabulary: str | None = None) -> DataFrame:
    """(keys..., n_docs, n_tokens): totals per slice; ``language`` among the keys is trimmed and lower-cased, '' for null.

    With ``vocabulary`` also ``n_subwords``, the longest-match tokens under that vocabulary.
    """
    runtime.text_batches(docs.sparkSession)
    named = [language_key(language_col).alias(k) if k == "language" else F.col(k) for k in keys]
    counted = docs.select(*named, token_counts(F.col(text_col)).alias("_n"), *([subword_counts(docs.sparkSession, F.col(text_col), vocabulary).alias("_s")] if vocabulary else []))
    sums = [F.count("*").alias("n_docs"), F.sum("_n").alias("n_tokens")] + ([F.sum("_s").alias("n_subwords")] if vocabulary else [])
    return counted.groupBy(*keys).agg(*sums)


def wrong_totals(docs: DataFrame, reported: DataFrame) -> DataFrame:
    """(source, repo, commit_hash, language): reported slices whose total is not the sum over the documents."""
    keys = ["source", "repo", "commit_hash", "language"]
    t = token_totals(docs, keys).alias("t")
    r = reported.alias("r")
    same = F.lit(True)
    for k in keys:
        same &= F.col(f"r.{k}").eqNullSafe(F.col(f"t.{k}"))
    total = F.coalesce(F.col("t.n_tokens"), F.lit(0))
    return r.join(t, same, "left").filter(~F.col("r.n_tokens").eqNullSafe(total)).select(*(F.col(f"r.{k}") for k in keys))
