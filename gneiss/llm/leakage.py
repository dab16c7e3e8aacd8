"""Evaluation texts inside training texts: an FM-index per shard of the corpus (problem 9).

A shard is a bounded number of words of consecutive documents.  Words travel as 64-bit hashes, whose equality stands for
equality of words; words that no evaluation item uses, by a bitmap of fixed size, become separators, and stretches
between separators that are too short to hold a phrase are left out.  The rest of a shard gets symbols of its own.
Its suffix array gives the Burrows-Wheeler transform, kept as a wavelet matrix with rank counts; all phrases (every
window of ``phrase`` consecutive item words) are searched backwards at once, the rows found are located by walking back
to sampled suffix positions, and hits at consecutive positions of one item merge into removal spans.

The items are the given side: the driver reads them in blocks of at most ``BLOCK_WORDS`` words and sends each block on
its own.  Every shard is indexed once and searched for the phrases of all blocks in turn, so the corpus is read once
whatever the number of blocks.

Defined results: null or shorter texts (in words) match nothing; items repeated under other ids are reported for
each id; repeated documents are reported for each; extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss import runtime
from gneiss.llm import textcore

PHRASE = 12
#: Words of one FM-index, and distance of the sampled suffix positions.
SHARD_WORDS = 200_000
SAMPLE = 8
#: Item words sent and searched together; bits of the bitmap of item words, as a power of two.
BLOCK_WORDS = 500_000
BITMAP_BITS = 24

_HITS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start_word", pa.int32()), ("n_words", pa.int32())])


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes of an integer text in order, by prefix doubling; the text's last symbol must be its least and unique."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    width = 1
    while True:
        after = np.full(n, -1, np.int64)
        if width < n:
            after[:-width] = rank[width:]
        key = rank * (n + 1) + after + 1
        order = np.argsort(key, kind="stable")
        step = np.r_[False, key[order][1:] != key[order][:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(step)
        if rank[order[-1]] == n - 1:
            return order
        width *= 2


class WaveletMatrix:
    """Ranks of the symbols of a sequence, one bit level at a time, for many queries together."""

    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        self.levels = []
        for b in range(bits - 1, -1, -1):
            bit = (symbols >> b) & 1
            ones = np.zeros(len(bit) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            zeros = len(bit) - int(ones[-1])
            self.levels.append((b, ones, zeros))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        low, high = np.zeros_like(place), place.copy()
        for b, ones, zeros in self.levels:
            one = ((symbol >> b) & 1).astype(bool)
            low = np.where(one, zeros + ones[low], low - ones[low])
            high = np.where(one, zeros + ones[high], high - ones[high])
        return high - low

    def access(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place and its rank there."""
        symbol, low, high = np.zeros_like(place), np.zeros_like(place), place.copy()
        for b, ones, zeros in self.levels:
            one = ones[high + 1] - ones[high]
            symbol |= one.astype(symbol.dtype) << b
            low = np.where(one == 1, zeros + ones[low], low - ones[low])
            high = np.where(one == 1, zeros + ones[high], high - ones[high])
        return symbol, high - low


class FMIndex:
    """Full-text index over a text of symbols 1..sigma-1; 0 ends it."""

    def __init__(self, text: np.ndarray, sigma: int) -> None:
        text = np.r_[text, 0]
        order = suffix_array(text)
        self.wavelet = WaveletMatrix(text[order - 1].astype(np.int64), max(1, int(sigma - 1).bit_length()))
        self.before = np.r_[0, np.cumsum(np.bincount(text, minlength=sigma))]
        sampled = order % SAMPLE == 0
        self.sampled = sampled
        self.sample_no = np.cumsum(sampled) - 1
        self.samples = order[sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last + 1 row of each phrase (one per line of the matrix)."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), len(self.sampled), np.int64)
        alive = np.arange(len(phrases))
        for column in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[alive, column]
            low[alive] = self.before[symbol] + self.wavelet.rank(symbol, low[alive])
            high[alive] = self.before[symbol] + self.wavelet.rank(symbol, high[alive])
            alive = alive[low[alive] < high[alive]]
            if not len(alive):
                break
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each row: steps back until a sampled suffix, at most SAMPLE - 1 of them."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        todo = np.nonzero(~self.sampled[rows])[0]
        while len(todo):
            symbol, rank = self.wavelet.access(rows[todo])
            rows[todo] = self.before[symbol] + rank
            steps[todo] += 1
            todo = todo[~self.sampled[rows[todo]]]
        return self.samples[self.sample_no[rows]] + steps


class Phrases:
    """All windows of ``width`` words of the items, as word hashes."""

    def __init__(self, items: list[tuple[int, str | None]], width: int) -> None:
        self.width = width
        lines, owners = [np.empty((0, width), np.uint64)], [np.empty(0, np.int64)]
        for item, text in items:
            found = textcore.word_hashes(text)
            if len(found) >= width:
                lines.append(np.lib.stride_tricks.sliding_window_view(found, width))
                owners.append(np.full(len(found) - width + 1, item, np.int64))
        self.matrix, inverse = np.unique(np.concatenate(lines), axis=0, return_inverse=True)
        order = np.argsort(inverse.ravel(), kind="stable")
        self.owners = np.concatenate(owners)[order]
        self.first = np.searchsorted(inverse.ravel()[order], np.arange(len(self.matrix) + 1))


class Shard:
    """The FM-index over the stretches of a shard's documents that consist of item words."""

    def __init__(self, docs: list[tuple[int, np.ndarray]], bitmap: np.ndarray, width: int) -> None:
        self.docs, self.width = docs, width
        pieces, doc_no, offset = [], [], []
        for no, (_, hashes) in enumerate(docs):
            known = bitmap[(hashes & np.uint64((1 << BITMAP_BITS) - 1)).astype(np.int64)]
            edges = np.r_[-1, np.nonzero(~known)[0], len(hashes)]
            for a, b in zip(edges[:-1] + 1, edges[1:], strict=True):
                if b - a >= width:
                    pieces.append(hashes[a:b])
                    doc_no.append(no)
                    offset.append(a)
        self.index = None
        if pieces:
            lengths = np.array([len(p) for p in pieces])
            self.starts = np.r_[0, np.cumsum(lengths + 1)]
            self.doc_no, self.offset = np.array(doc_no), np.array(offset)
            self.words, codes = np.unique(np.concatenate(pieces), return_inverse=True)
            text = np.ones(int(self.starts[-1]), np.int64)  # 1 ends a stretch
            text[np.arange(len(codes)) + np.repeat(np.arange(len(pieces)), lengths)] = codes.ravel() + 2
            self.index = FMIndex(text, len(self.words) + 2)

    def search(self, phrases: Phrases) -> Iterator[tuple[int, int, int, int]]:
        """(doc, item, first word, words) of the merged hits."""
        if self.index is None or not len(phrases.matrix):
            return
        at = np.minimum(np.searchsorted(self.words, phrases.matrix), len(self.words) - 1)
        here = np.nonzero((self.words[at] == phrases.matrix).all(axis=1))[0]
        low, high = self.index.search(at[here] + 2)
        found = np.nonzero(low < high)[0]
        if not len(found):
            return
        n = high[found] - low[found]
        phrase = np.repeat(here[found], n)
        rows = np.repeat(low[found] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        at = self.index.locate(rows)
        piece = np.searchsorted(self.starts, at, side="right") - 1
        doc, word = self.doc_no[piece], at - self.starts[piece] + self.offset[piece]
        per = phrases.first[phrase + 1] - phrases.first[phrase]
        pick = np.repeat(phrases.first[phrase] - np.r_[0, np.cumsum(per)[:-1]], per) + np.arange(per.sum())
        item = phrases.owners[pick]
        doc, word = np.repeat(doc, per), np.repeat(word, per)
        order = np.lexsort((word, item, doc))
        doc, item, word = doc[order], item[order], word[order]
        new = np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (word[1:] > word[:-1] + self.width)]
        last = np.r_[np.nonzero(new)[0][1:] - 1, len(word) - 1]
        for d, i, a, b in zip(doc[new], item[new], word[new], word[last] + self.width, strict=True):
            yield self.docs[d][0], int(i), int(a), int(b - a)


def _item_blocks(items: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[int, str | None]]]:
    block: list[tuple[int, str | None]] = []
    size = 0
    for row in items.select(F.col(item_col).cast("long"), F.col(text_col)).filter(F.col(item_col).isNotNull()).toLocalIterator():
        n = len(textcore.words(row[1]))
        if block and size + n > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += n
    yield block


def leaked_spans(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", phrase: int = PHRASE) -> DataFrame:
    """(doc_id, item_id, start_word, n_words): the removal spans, in words of the document, that consist of
    phrases of the item; spans of one item that touch are one."""
    spark = docs.sparkSession
    runtime.text_batches(spark)
    texts = docs.select(F.col(id_col).cast("long"), F.col(text_col)).filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    bitmap = np.zeros(1 << BITMAP_BITS, bool)
    blocks = []
    for block in _item_blocks(items, item_col, item_text_col):
        for _, text in block:
            bitmap[(textcore.word_hashes(text) & np.uint64((1 << BITMAP_BITS) - 1)).astype(np.int64)] = True
        blocks.append(spark.sparkContext.broadcast(block))
    known = spark.sparkContext.broadcast(np.packbits(bitmap))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used = np.unpackbits(known.value).astype(bool)
        # The phrases of a single block are kept; of several, one block's at a time.
        only = Phrases(blocks[0].value, phrase) if len(blocks) == 1 else None
        held: list[tuple[int, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            shard = Shard(held, used, phrase)
            for block in blocks:
                rows = list(shard.search(only or Phrases(block.value, phrase))) if shard.index else []
                if rows:
                    yield textcore.to_batch(dict(zip(_HITS.names, zip(*rows, strict=True), strict=True)), _HITS)

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                hashes = textcore.word_hashes(text)
                if len(hashes) < phrase:
                    continue
                held.append((i, hashes))
                size += len(hashes)
                if size >= SHARD_WORDS:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return texts.mapInArrow(search, "doc_id long, item_id long, start_word int, n_words int").distinct()


def leaked_documents(docs: DataFrame, items: DataFrame, **options: object) -> DataFrame:
    """(doc_id, item_id, n_spans, n_words): how much of each item each affected document holds."""
    return leaked_spans(docs, items, **options).groupBy("doc_id", "item_id").agg(F.count("*").alias("n_spans"), F.sum("n_words").cast("long").alias("n_words"))
