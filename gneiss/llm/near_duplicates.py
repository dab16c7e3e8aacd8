"""Near-duplicate records: a segment-popcount embedding with a grid range-join (problem 1).

A record's *fingerprint* is the bitmap of its word shingles in a space of 2^48 positions.  Cutting that
space into equal segments and counting the set bits of each gives an integer vector; for any number of
segments the Manhattan distance of two vectors is at most the Hamming distance of the fingerprints,
``|A xor B|``, and ``jaccard >= t`` holds exactly when ``|A xor B| <= (1-t)/(1+t) * (|A|+|B|)``.  So the
join within that radius loses nothing:

1. *Fingerprints*: one pass over the texts; records with the same set collapse into one representative.
2. *Range-join on the finest grid*: on coarse grids, cells of the radius' side separate records hardly more than their lengths do (the
   README has the figures), so the join runs on the finest one (one position per segment), where a vector
   occupies one cell per shingle, and with the lowest cells of each record (bottom-k selection).  Two vectors within the radius agree in at least a share ``t`` of the cells either occupies, so
   the ``k`` lowest cells (in one fixed order for all records) of both have one in common but with
   probability ``(1-t)^k``; ``k`` is chosen so that this is below ``MISS`` (1e-9), and records with at most
   ``k`` shingles emit them all, which is exact.  Cells that very many records occupy go last in the
   order, with a ``k`` computed for the rest of the record; only records made mostly of such cells emit
   them too, salted into blocks, so no cell is joined in one task.
3. *Lower bound*: candidates meet with vectors of about ``n/2`` segments; pairs whose Manhattan distance is
   beyond the radius are dropped.
4. *Exact check*: the remaining pairs are compared on the whole sets.

The bounds for hot cells (``HOT_FLOOR``, ``HOT_MEAN``) choose which cells are emitted, never which pairs are found.

Defined results: null or empty content, and fewer than ``width`` words, gives no fingerprint and no pair;
repeated rows are records of their own (same id twice: counted once); extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss import runtime
from gneiss.llm import textcore

#: Probability of losing one pair at the threshold.
MISS = 1e-9
#: Positions of the fingerprint and counters of the occupancy sketch, as powers of two.
POSITION_BITS = 48
SKETCH_BITS = 20
SKETCH_PARTS = 16
#: Sketches merged by one task per round.
SKETCH_FAN_IN = 16
#: A counter above HOT_FLOOR + HOT_MEAN * (mean counter) marks its cells as hot.
HOT_FLOOR = 256
HOT_MEAN = 2
#: Blocks into which each hot cell is cut, per side.
SALTS = 32
#: The least similarity of the cold parts for which the cold cells alone are used.
COLD_LEAST = 0.3

_SETS = pa.schema([("id", pa.int64()), ("n", pa.int32()), ("key", pa.int64()), ("bits", pa.binary()), ("counts", pa.binary())])
_CELLS = pa.schema([("cell", pa.int64()), ("hot", pa.bool_()), ("id", pa.int64()), ("n", pa.int32())])


def _pack(values: np.ndarray) -> bytes:
    """Sorted 48-bit positions as six bytes each."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, 6)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :6] = raw
    return wide.view("<u8").ravel()


def segment_level(n: int) -> int:
    """Number of segments, as a power of two, of the coarse vector of a set of ``n``: about n/2."""
    return max(4, (max(n, 1) - 1).bit_length() - 1)


def segment_counts(values: np.ndarray) -> np.ndarray:
    level = segment_level(len(values))
    return np.bincount((values >> np.uint64(POSITION_BITS - level)).astype(np.int64), minlength=1 << level)


def manhattan(a: np.ndarray, b: np.ndarray) -> int:
    """Distance of two count vectors, the finer one folded to the coarser grid."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) != len(b):
        a = a.reshape(len(b), -1).sum(axis=1)
    return int(np.abs(a - b).sum())


def radius(n_a: int, n_b: int, threshold: float) -> float:
    return (1 - threshold) / (1 + threshold) * (n_a + n_b) + 1e-9


def fingerprints(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, n, key, bits, counts): the shingle set of every record that has one."""
    runtime.text_batches(docs.sparkSession)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in _SETS}
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = textcore.shingle_hashes(textcore.word_hashes(text), width)
                if i is None or not len(found):
                    continue
                values = np.unique(found >> np.uint64(64 - POSITION_BITS))
                bits = _pack(values)
                out["id"].append(i)
                out["n"].append(len(values))
                out["key"].append(int.from_bytes(xxhash.xxh3_64_digest(bits), "little", signed=True))
                out["bits"].append(bits)
                out["counts"].append(np.minimum(segment_counts(values), 255).astype(np.uint8).tobytes())
            yield textcore.to_batch(out, _SETS)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(build, "id long, n int, key long, bits binary, counts binary")


def _occupancy(sets: DataFrame) -> np.ndarray:
    """Which counters of the occupancy sketch are hot: one bit per counter, a fixed 2^SKETCH_BITS of them.

    Every task sketches its sets; the sketches merge in rounds of ``SKETCH_FAN_IN``, cut into parts, so no task receives
    more than that many parts.  ``sets`` is a written table, so its partitions are the same each time.
    """
    part = 1 << (SKETCH_BITS - 4)
    schema = "task int, part int, counts binary"
    names = ["task", "part", "counts"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.uint32)
        task = 0
        for batch in batches:
            if batch.num_rows:
                task = batch.column(1)[0].as_py()
                total += np.bincount((_unpack(b"".join(batch.column(0).to_pylist())) & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64), minlength=1 << SKETCH_BITS).astype(np.uint32)
        yield pa.RecordBatch.from_arrays(
            [pa.array([task] * SKETCH_PARTS, pa.int32()), pa.array(range(SKETCH_PARTS), pa.int32()), pa.array([total[p * part : (p + 1) * part].tobytes() for p in range(SKETCH_PARTS)], pa.binary())], names=names
        )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for task, p, data in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                sums[task, p] = sums.get((task, p), 0) + np.frombuffer(data, np.uint32)
        yield pa.RecordBatch.from_arrays(
            [pa.array([t for t, _ in sums], pa.int32()), pa.array([p for _, p in sums], pa.int32()), pa.array([v.astype(np.uint32).tobytes() for v in sums.values()], pa.binary())], names=names
        )

    tasks = max(1, sets.rdd.getNumPartitions())
    level = sets.select("bits", F.spark_partition_id().alias("task")).mapInArrow(count, schema)
    while tasks > 1:
        tasks = math.ceil(tasks / SKETCH_FAN_IN)
        level = level.withColumn("task", F.floor(F.col("task") / SKETCH_FAN_IN).cast("int")).repartition(SKETCH_PARTS * tasks, "task", "part").mapInArrow(merge, schema)
    total = np.zeros((SKETCH_PARTS, part), np.uint64)
    for row in level.collect():
        total[row["part"]] += np.frombuffer(row["counts"], np.uint32)
    return np.packbits(total.ravel() > HOT_FLOOR + HOT_MEAN * total.mean())


def cells_needed(threshold: float) -> int:
    return max(1, math.ceil(math.log(MISS) / math.log(1 - threshold))) if threshold < 1 else 1


def choose_cells(values: np.ndarray, hot: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The cold and hot cells that a record emits; ``values`` is sorted, ``hot`` marks its hot cells.

    With ``h`` hot and ``c`` cold shingles, any partner within the threshold shares at least
    ``threshold - (1-threshold)*h/c`` of the cold union.  While that is COLD_LEAST or more, the cold cells
    suffice; otherwise either the cold or the hot parts alone reach the threshold.
    """
    cold = values[~hot]
    h, c = len(values) - len(cold), len(cold)
    least = threshold - (1 - threshold) * h / c if c else 0.0
    if least >= COLD_LEAST:
        return cold[: cells_needed(least)], values[:0]
    return cold[: cells_needed(COLD_LEAST)], values[hot][: cells_needed(threshold)]


def similar_sets(sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, common, n_a, n_b), a < b: the pairs of distinct sets within the threshold, each once.

    ``sets`` has one row per distinct set: id, n, bits, counts.  Counts stop at 255, which about
    n/2 segments do not reach.
    """
    mask = _occupancy(sets)
    low = np.uint64((1 << SKETCH_BITS) - 1)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.unpackbits(mask).astype(bool)
        for batch in batches:
            cells, hots, ids, sizes = [], [], [], []
            for i, n, data in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                values = _unpack(data)
                cold, warm = choose_cells(values, flags[(values & low).astype(np.int64)], threshold)
                k = len(cold) + len(warm)
                cells += [cold, warm]
                hots += [np.zeros(len(cold), bool), np.ones(len(warm), bool)]
                ids.append(np.full(k, i, np.int64))
                sizes.append(np.full(k, n, np.int32))
            if cells:
                yield textcore.to_batch({"cell": np.concatenate(cells).astype(np.int64), "hot": np.concatenate(hots), "id": np.concatenate(ids), "n": np.concatenate(sizes)}, _CELLS)

    cells = sets.select("id", "n", "bits").mapInArrow(emit, "cell long, hot boolean, id long, n int")
    # Cold cells have one block; hot ones SALTS blocks, where a row is in one block on the left and in all on the right.
    left = cells.withColumn("block", F.when(F.col("hot"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0)))
    right = cells.withColumn("block", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    a, b = left.alias("a"), right.alias("b")
    close = F.least("a.n", "b.n") >= F.lit(threshold) * F.greatest("a.n", "b.n") - F.lit(1e-9)
    candidates = (
        a.join(b, (F.col("a.cell") == F.col("b.cell")) & (F.col("a.hot") == F.col("b.hot")) & (F.col("a.block") == F.col("b.block")) & (F.col("a.id") < F.col("b.id")) & close)
        .select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))
        .distinct()
    )

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n_a, n_b, u, v in zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True):
                x, y = (np.frombuffer(z, np.uint8).astype(np.int64) for z in (u, v))
                keep.append(manhattan(x, y) <= radius(n_a, n_b, threshold))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    vectors = sets.select("id", "n", "counts")
    near = _with_both(candidates, vectors, "counts").mapInArrow(within, "a long, b long")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            common = [len(np.intersect1d(_unpack(u), _unpack(v), assume_unique=True)) for u, v in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)]
            shared, n_a, n_b = np.array(common, np.int64), batch.column(2).to_numpy(), batch.column(3).to_numpy()
            keep = shared >= threshold * (n_a + n_b - shared) - 1e-9
            whole = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared, pa.int32()), batch.column(2), batch.column(3)], names=["a", "b", "common", "n_a", "n_b"])
            yield whole.filter(pa.array(keep, pa.bool_()))

    near = runtime.materialise(near, "near")
    return _with_both(near, sets.select("id", "n", "bits"), "bits").mapInArrow(check, "a long, b long, common int, n_a int, n_b int")


def _with_both(pairs: DataFrame, sets: DataFrame, payload: str) -> DataFrame:
    """(a, b, n_a, n_b, payload of a, payload of b)."""
    one = sets.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col(payload).alias("p_a"))
    two = sets.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col(payload).alias("p_b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "n_a", "n_b", "p_a", "p_b")


def _classes(docs: DataFrame, id_col: str, text_col: str, width: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Members (rep, id) of every class of equal sets, and the links between classes; rep is the set's 64-bit key."""
    sets = runtime.materialise(fingerprints(docs, id_col, text_col, width), "sets")
    members = sets.select(F.col("key").alias("rep"), "id").distinct()
    lead = sets.groupBy(F.col("key").alias("id")).agg(*(F.first(c).alias(c) for c in ("n", "bits", "counts")))
    return members, similar_sets(runtime.materialise(lead, "lead"), threshold)


def similar_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "content", width: int = 5, threshold: float = 0.8) -> DataFrame:
    """(doc_id_a, doc_id_b), a < b: every pair of records whose shingle sets reach the threshold."""
    members, links = _classes(docs, id_col, text_col, width, threshold)
    members = runtime.materialise(members, "members")
    heavy = runtime.heavy_keys(members, ["rep"])
    by_a, by_b = (heavy.withColumnRenamed("rep", k) if heavy is not None else None for k in ("a", "b"))
    x, y = members.select(F.col("rep").alias("a"), F.col("id").alias("x")), members.select(F.col("rep").alias("b"), F.col("id").alias("y"))
    half = runtime.join_heavy(x, links.select("a", "b"), ["a"], ["x"], by_a)
    across = runtime.join_heavy(half, y, ["b"], ["x"], by_b).select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")
    mates = members.groupBy("rep").agg(F.count("*").alias("c")).filter("c > 1").select("rep")
    own = members.join(mates, "rep", "left_semi")
    spread = own.select("rep", F.col("id").alias("y"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    inside = own.select("rep", F.col("id").alias("x"), salt.alias("salt")).join(spread, ["rep", "salt"]).filter("x < y").select(F.col("x").alias("doc_id_a"), F.col("y").alias("doc_id_b"))
    return across.filter("doc_id_a < doc_id_b").union(inside)


def similarity_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "content", width: int = 5, threshold: float = 0.8) -> DataFrame:
    """(doc_id, class_id, group_id, n_links): one row per record with a fingerprint.

    ``class_id`` names the records with an equal shingle set, ``group_id`` the connected group of classes,
    ``n_links`` counts the other records within the threshold; copies are not expanded into pairs.
    """
    from gneiss.operators.graph import connected_components

    members, links = _classes(docs, id_col, text_col, width, threshold)
    members, links = runtime.materialise(members, "members"), runtime.materialise(links.select("a", "b"), "links")
    sizes = members.groupBy(F.col("rep")).agg(F.count("*").alias("size"))
    both = links.select("a", "b").union(links.select(F.col("b"), F.col("a")))
    partners = runtime.join_salted(both, sizes.select(F.col("rep").alias("b"), "size"), ["b"], ["a"]).groupBy(F.col("a").alias("rep")).agg(F.sum("size").alias("partners"))
    groups = connected_components(links, "a", "b").select(F.col("node").alias("rep"), F.col("component").alias("group_id"))
    least = members.groupBy("rep").agg(F.min("id").alias("class_id"))
    classes = (
        sizes.join(partners, "rep", "left")
        .join(groups, "rep", "left")
        .join(least, "rep")
        .select("rep", "class_id", F.coalesce("group_id", "rep").alias("part"), (F.col("size") - 1 + F.coalesce("partners", F.lit(0))).alias("n_links"))
    )
    named = classes.groupBy("part").agg(F.min("class_id").alias("group_id"))
    grouped = runtime.join_salted(classes, named, ["part"], ["rep"])
    return runtime.join_salted(members, grouped, ["rep"], ["id"]).select(F.col("id").alias("doc_id"), "class_id", "group_id", "n_links")
