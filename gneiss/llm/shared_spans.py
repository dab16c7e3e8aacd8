"""Long exact spans shared between records: winnowed seeds, extended both ways (problem 10).

*Seed*: of every window of ``span - seed + 1`` consecutive ``seed``-character grams the one with the least hash
is an anchor, so any stretch of ``span`` characters contains the anchor that its own characters select, at the
same place in every record that holds the stretch.  *Extend*: all stretches of ``span`` characters that select
one anchor occurrence form a run around it, which is widened to both sides as far as the anchor stays the
least.  Runs are first compared whole by hash; runs that agree with another record's are shared to their
full width.  The other runs (next to an edit, or unique) are opened: every stretch of a run whose anchor
gram also occurs in another record is compared on its own, among the distinct runs of that anchor; an anchor with
more than ``group_runs`` distinct runs is spread by stretch instead (both ways give the same result).  What is found in
one run holds at every place where that run stands.  Neighbouring shared stretches merge into *maximal* spans.  Nothing
is compared in pairs: every step groups equal hashes with map-side combining, so a header held by a third of all
records costs one row per record and task; the joins back are salted where one run or anchor has many rows.

Equality of 64-bit hashes of (anchor, stretch) stands for equality of text.  Characters are code points.

Defined results: null and short texts share nothing; records with an equal text are one class, which shares its text
whole; repeated rows with one id are one record; null ids are left out; extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss import runtime
from gneiss.llm import textcore

SPAN = 300
SEED = 48
#: Characters hashed at once.
CHUNK_CHARS = 1 << 20
#: An anchor with more distinct runs than this is compared stretch by stretch, spread over all tasks, instead of in one group.
GROUP_RUNS = 256
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))

_RUNS = pa.schema([("run", pa.int64()), ("anchor", pa.int64()), ("rec", pa.int64()), ("id", pa.int64()), ("start", pa.int32()), ("width", pa.int32())])

_OPENED = pa.schema([("key", pa.int64()), ("run", pa.int64()), ("anchor", pa.int64()), ("rec", pa.int64()), ("many", pa.bool_()), ("start", pa.int32()), ("width", pa.int32()), ("slice", pa.string())])
_FOUND = "run long, anchor long, start int, width int"


class _Powers:
    """Powers of the base and of its inverse modulo 2^64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, _BASE)], dtype=np.uint64)
                self.down = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, _INVERSE)], dtype=np.uint64)
        return self.up[:n], self.down[:n]


_powers = _Powers()


class Rolling:
    """Hash of any stretch of a text from prefix sums of ``c_i * base^i`` modulo 2^64."""

    def __init__(self, points: np.ndarray) -> None:
        up, self.down = _powers.of(len(points) + 1)
        self.prefix = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(textcore.mix64(points.astype(np.uint64) + np.uint64(1)) * up[:-1], out=self.prefix[1:])

    def grams(self, width: int) -> np.ndarray:
        n = len(self.prefix) - width
        return textcore.mix64((self.prefix[width:] - self.prefix[:n]) * self.down[:n])

    def stretches(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return textcore.mix64((self.prefix[end] - self.prefix[start]) * self.down[start])


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the least value of every window; the last of equal ones."""
    n = len(values)
    # The upper bits of the hash order the grams; the lower 24 hold the position, later ones being less.
    place = np.uint64((1 << 24) - 1)
    keyed = (values & ~place) | (place - np.arange(n, dtype=np.uint64))
    pad = -n % width
    rows = np.concatenate([keyed, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    forward = np.minimum.accumulate(rows, axis=1).ravel()
    backward = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - width + 1
    least = np.minimum(backward[:m], forward[width - 1 : width - 1 + m])
    return (place - (least & place)).astype(np.int64)


def runs_of(points: np.ndarray, span: int, seed: int) -> tuple[np.ndarray, ...]:
    """(run hash, anchor hash, first stretch, number of stretches) of each anchor's run in one text."""
    roll = Rolling(points)
    grams = roll.grams(seed)
    anchors = window_minima(grams, span - seed + 1)
    first = np.nonzero(np.r_[True, anchors[1:] != anchors[:-1]])[0]
    last = np.r_[first[1:], len(anchors)] - 1
    at = anchors[first]
    whole = roll.stretches(first, last + span)
    # The place of the anchor in the run is part of the hash: equal hashes are aligned.
    whole = textcore.mix64(whole + (at - first).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + (last - first).astype(np.uint64))
    return whole, grams[at], first, last - first + 1


def _pieces(points: np.ndarray, span: int) -> Iterator[tuple[int, np.ndarray]]:
    """Long texts in pieces that overlap by all but one character of a stretch, so each stretch is in one piece."""
    if len(points) <= 4 * CHUNK_CHARS:
        yield 0, points
        return
    for start in range(0, len(points) - span + 1, CHUNK_CHARS):
        yield start, points[start : start + CHUNK_CHARS + span - 1]


def _texts(docs: DataFrame, id_col: str, text_col: str, span: int) -> DataFrame:
    """(rec, id, n_chars): the record class (equal texts) of every record long enough."""
    return docs.filter(F.length(text_col) >= span).select(F.xxhash64(text_col, F.length(text_col)).alias("rec"), F.col(id_col).cast("long").alias("id"), F.length(text_col).alias("n_chars")).distinct()


def _runs(lead: DataFrame, span: int, seed: int) -> DataFrame:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in _RUNS}
            size = 0
            for rec, i, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                for base, points in _pieces(textcore.code_points(text), span):
                    whole, anchor, first, width = runs_of(points, span, seed)
                    out["run"].append(whole.view(np.int64))
                    out["anchor"].append(anchor.view(np.int64))
                    out["rec"].append(np.full(len(whole), rec, np.int64))
                    out["id"].append(np.full(len(whole), i, np.int64))
                    out["start"].append(first + base)
                    out["width"].append(width)
                    size += len(whole)
                    if size > 1 << 18:
                        yield textcore.to_batch({k: np.concatenate(v) for k, v in out.items()}, _RUNS)
                        out, size = {f.name: [] for f in _RUNS}, 0
            if size:
                yield textcore.to_batch({k: np.concatenate(v) for k, v in out.items()}, _RUNS)

    return lead.mapInArrow(find, "run long, anchor long, rec long, id long, start int, width int")


def _opened(docs: DataFrame, runs: DataFrame, span: int, group_runs: int) -> DataFrame:
    """(key, run, anchor, rec, many, start, width, slice): the characters of each run under its anchor, or, for an anchor
    with more than ``group_runs`` runs, one row per stretch under the stretch's hash, without characters.

    ``start`` counts from the start of the run.  ``many`` marks runs that several records hold.
    """

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rec, text, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                few = [x for x in spans if x["n"] <= group_runs]
                if few:
                    same = {k: [x[k] for x in few] for k in ("run", "anchor", "many", "width")}
                    slices = [text[x["start"] : x["start"] + x["width"] + span - 1] for x in few]
                    yield textcore.to_batch(same | {"key": same["anchor"], "rec": [rec] * len(few), "start": [0] * len(few), "slice": slices}, _OPENED)
                many = [x for x in spans if x["n"] > group_runs]
                if not many:
                    continue
                roll = Rolling(textcore.code_points(text))
                for x in many:
                    for k in range(0, x["width"], 1 << 18):
                        inner = np.arange(k, min(x["width"], k + (1 << 18)), dtype=np.int64)
                        at, n = inner + x["start"], len(inner)
                        found = textcore.mix64(roll.stretches(at, at + span) + np.uint64(x["anchor"] & 0xFFFFFFFFFFFFFFFF))
                        one = {k2: np.full(n, x[k2]) for k2 in ("run", "anchor", "many")}
                        yield textcore.to_batch(one | {"key": found.view(np.int64), "rec": np.full(n, rec, np.int64), "start": inner, "width": np.ones(n, np.int32), "slice": pa.nulls(n, pa.string())}, _OPENED)

    by_record = runs.groupBy("rec", "id").agg(F.collect_list(F.struct("run", "anchor", "many", "start", "width", "n")).alias("spans"))
    return docs.join(by_record, ["id", "rec"]).select("rec", "text", "spans").mapInArrow(expand, "key long, run long, anchor long, rec long, many boolean, start int, width int, slice string")


def shared_in_groups(keys: np.ndarray, recs: np.ndarray, many: np.ndarray, slices: list[str], span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start in it, width) of the stretches that two records hold under one key, neighbours joined."""
    sizes = np.array([len(x) for x in slices], np.int64)
    width = sizes - span + 1
    roll = Rolling(textcore.code_points("".join(slices)))
    row = np.repeat(np.arange(len(slices)), width)
    inner = np.arange(len(row)) - np.repeat(np.r_[0, np.cumsum(width)[:-1]], width)
    at = np.repeat(np.r_[0, np.cumsum(sizes)[:-1]], width) + inner
    # The key is part of what must agree; so is, by the selection of anchors, the place of the stretch.
    found = textcore.mix64(roll.stretches(at, at + span) + textcore.mix64(keys[row].view(np.uint64)))
    order = np.argsort(found, kind="stable")
    new = np.r_[True, found[order][1:] != found[order][:-1]]
    group = np.cumsum(new) - 1
    first = np.nonzero(new)[0]
    rec = recs[row]
    mixed = (np.minimum.reduceat(rec[order], first) != np.maximum.reduceat(rec[order], first)) | np.logical_or.reduceat(many[row][order], first)
    shared = np.zeros(len(row), bool)
    shared[order] = mixed[group]
    shared &= ~many[row]
    pick = np.nonzero(shared)[0]
    if not len(pick):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    begin = np.r_[True, (pick[1:] != pick[:-1] + 1) | (row[pick][1:] != row[pick][:-1])]
    lead = np.nonzero(begin)[0]
    return row[pick[lead]], inner[pick[lead]], np.diff(np.r_[lead, len(pick)])


def _compared(opened: DataFrame, span: int) -> DataFrame:
    """(run, anchor, start, width): shared stretches of the runs that came with their characters, anchor by anchor."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        chars = 0

        def flush(rows: pa.Table) -> pa.RecordBatch:
            keys, recs = (rows.column(k).to_numpy().astype(np.int64) for k in (0, 2))
            row, start, width = shared_in_groups(keys, recs, rows.column(3).to_numpy().astype(bool), rows.column(4).to_pylist(), span)
            run = rows.column(1).to_numpy()[row]
            return pa.RecordBatch.from_arrays([pa.array(run), pa.array(keys[row]), pa.array(start.astype(np.int32)), pa.array(width.astype(np.int32))], names=["run", "anchor", "start", "width"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            chars += batch.nbytes
            if chars < CHUNK_CHARS:
                continue
            rows = pa.Table.from_batches(held)
            keys = rows.column(0).to_numpy()
            # The last key may go on in the next batch.
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut:
                yield flush(rows.slice(0, cut))
                held = rows.slice(cut).to_batches()
                chars = sum(b.nbytes for b in held)
        if held:
            yield flush(pa.Table.from_batches(held))

    sorted_rows = opened.filter("slice is not null").select("key", "run", "rec", "many", "slice").repartition("key").sortWithinPartitions("key")
    return sorted_rows.mapInArrow(compare, _FOUND)


def shared_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, seed: int = SEED, group_runs: int = GROUP_RUNS) -> DataFrame:
    """(doc_id, start, length): the maximal stretches of each record, ``span`` characters or more, covered by
    stretches that occur in the text of another record; ``start`` counts code points from 0."""
    runtime.text_batches(docs.sparkSession)
    docs = docs.filter(F.col(id_col).isNotNull())
    records = runtime.materialise(_texts(docs, id_col, text_col, span), "records")
    keyed = docs.filter(F.length(text_col) >= span).select(F.xxhash64(text_col, F.length(text_col)).alias("rec"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sizes = records.groupBy("rec").agg(F.count("*").alias("copies"), F.min("id").alias("id"), F.max("n_chars").alias("n_chars"))
    copies = sizes.filter("copies > 1").select("rec", "id")
    copied = runtime.join_salted(records, copies.select("rec"), ["rec"], ["id"], "left_semi").select(F.col("id").alias("doc_id"), F.lit(0).alias("start"), F.col("n_chars").cast("int").alias("length"))

    runs = runtime.materialise(_runs(keyed, span, seed), "runs")
    # One row per distinct run: its anchor, whether several records hold it, and a place where it stands.
    place = F.struct("rec", "id", "start", "width")
    known = runs.groupBy("run", "anchor").agg(F.min("rec").alias("lo"), F.max("rec").alias("hi"), F.min(place).alias("at"))
    known = runtime.materialise(known.select("run", "anchor", "lo", "hi", (F.col("lo") < F.col("hi")).alias("many"), "at.*"), "known")
    heavy = runtime.heavy_keys(runs, ["run", "anchor"])
    kept = runtime.join_heavy(runs, known.filter("many").select("run", "anchor"), ["run", "anchor"], ["rec", "start"], heavy, "left_semi").select("rec", "start", "width")
    # Anchors that two records have, and among whose runs one is not shared whole.
    anchors = known.groupBy("anchor").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("n"), F.min("many").alias("all")).filter("lo < hi and not all").select("anchor", "n")
    broken = runtime.join_salted(known.drop("lo", "hi"), anchors, ["anchor"], ["run"])
    opened = runtime.materialise(_opened(keyed, broken, span, group_runs), "opened")
    apart = opened.filter("slice is null")
    met = apart.groupBy("key").agg(F.min("rec").alias("lo"), F.max("rec").alias("hi"), F.max("many").alias("any")).filter("lo < hi or any").select("key")
    single = runtime.join_salted(apart.filter("not many"), met, ["key"], ["run", "start"], "left_semi").select("run", "anchor", "start", "width")
    # Back to every place of a run.
    found = single.unionByName(_compared(opened, span)).select("run", "anchor", F.col("start").alias("inner"), F.col("width").alias("part"))
    everywhere = runtime.join_heavy(runs, found, ["run", "anchor"], ["rec", "start"], heavy).select("rec", (F.col("start") + F.col("inner")).alias("start"), F.col("part").alias("width"))
    covered = _merged(kept.unionByName(everywhere).distinct(), span)
    firsts = records.join(copies.select("rec"), "rec", "left_anti").select("rec", "id")
    return firsts.join(covered, "rec").select(F.col("id").alias("doc_id"), "start", "length").unionByName(copied)


def _merged(stretches: DataFrame, span: int) -> DataFrame:
    """Union per record of [start, start + width - 1 + span)."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            recs, starts, lengths = [], [], []
            for rec, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = np.array([x["start"] for x in spans], np.int64)
                w = np.array([x["width"] for x in spans], np.int64)
                a, e = textcore.merge_intervals(s, s + w - 1 + span)
                recs.append(np.full(len(a), rec, np.int64))
                starts.append(a)
                lengths.append(e - a)
            if recs:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(recs)), pa.array(np.concatenate(starts).astype(np.int32)), pa.array(np.concatenate(lengths).astype(np.int32))], names=["rec", "start", "length"]
                )

    return stretches.groupBy("rec").agg(F.collect_list(F.struct("start", "width")).alias("spans")).mapInArrow(merge, "rec long, start int, length int")


def shared_amounts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN) -> DataFrame:
    """(doc_id, n_chars, shared_chars, n_spans): for every record how much of it is shared elsewhere."""
    spans = shared_spans(docs, id_col, text_col, span).groupBy("doc_id").agg(F.sum("length").cast("long").alias("shared_chars"), F.count("*").alias("n_spans"))
    every = docs.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(F.coalesce(F.length(text_col), F.lit(0))).cast("long").alias("n_chars"))
    zero = F.lit(0).cast("long")
    return every.join(spans, "doc_id", "left").select("doc_id", "n_chars", F.coalesce("shared_chars", zero).alias("shared_chars"), F.coalesce("n_spans", zero).alias("n_spans"))
