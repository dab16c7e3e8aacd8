"""NumPy building blocks shared by the text operators."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

WORD = re.compile(r"[a-z0-9_]+")
#: Distinct words remembered per worker before the table starts again.
WORD_CACHE = 1 << 20


def words(text: str | None) -> list[str]:
    """Maximal runs of a-z, 0-9 and _ of the lower-cased text; none for null."""
    return WORD.findall(text.lower()) if text else []


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = _Hashes()


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words of a text, in order."""
    found = words(text)
    return np.fromiter(map(_hashes.__getitem__, found), np.uint64, len(found))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """One 64-bit hash per window of ``width`` consecutive words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n]
        out ^= out >> np.uint64(31)
    return mix64(out)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def batches_of_chars(ids: list, texts: list, limit: int) -> Iterator[tuple[list, list]]:
    """Groups (id, text) rows so that a group has about ``limit`` characters at most; a longer text is alone."""
    own_ids: list = []
    own: list = []
    size = 0
    for i, t in zip(ids, texts, strict=True):
        if own and size + len(t) > limit:
            yield own_ids, own
            own_ids, own, size = [], [], 0
        own_ids.append(i)
        own.append(t)
        size += len(t)
    if own:
        yield own_ids, own


def to_batch(columns: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def merge_intervals(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open intervals; touching ones join."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    first = np.r_[True, s[1:] > e[:-1]]
    last = np.r_[np.nonzero(first)[0][1:] - 1, len(s) - 1]
    return s[first], e[last]
