"""Exact vector operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss import runtime

#: Vectors and queries in one block of the exact neighbour search, and queries scored at a time.
BLOCK = 2048
QUERY_BLOCK = 8192
STEP = 512


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product over the shorter length, in double; 0 for empty vectors.  Null for null."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    n = F.least(F.size(x), F.size(y))
    return F.aggregate(F.zip_with(F.slice(x, 1, n), F.slice(y, 1, n), lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def dense_top_k(vectors: DataFrame, id_col: str, vec_col: str, query: DataFrame, query_col: str, top_k: int) -> DataFrame:
    """(result_id, score): the largest inner products with the one vector of ``query``; equal scores by id."""
    one = F.broadcast(query.select(F.col(query_col).alias("_q")).limit(1))
    scored = vectors.crossJoin(one).select(F.col(id_col).alias("result_id"), F.round(dot(vec_col, "_q"), 6).alias("score"))
    return scored.orderBy(F.desc("score"), "result_id").limit(top_k)


def parsed_vector(column: str, dim: int) -> Column:
    """The JSON array as array<double>, or null unless it has exactly ``dim`` numbers that are not all zero."""
    v = F.from_json(F.col(column), "array<double>")
    return F.when((F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull()) & F.exists(v, lambda x: x != 0), v)


def missing(chunks: DataFrame, embedded: DataFrame, id_col: str = "chunk_id", version: str | None = None) -> DataFrame:
    """Chunks without a vector (of the version)."""
    have = embedded if version is None else embedded.filter(F.col("embedding_version") == version)
    return chunks.join(have.select(id_col), id_col, "left_anti")


def path_prefixes(path: Column | str, depth: int = 4) -> Column:
    """Hashes of the first 1..``depth`` segments of a path, 0 where it has fewer (or is null)."""
    parts = F.split(F.col(path) if isinstance(path, str) else path, "/")
    return F.transform(F.sequence(F.lit(1), F.lit(depth)), lambda i: F.when(F.size(parts) >= i, F.xxhash64(F.array_join(F.slice(parts, 1, i), "\u0000"))).otherwise(F.lit(0)).cast("long"))


def nearest_vectors(vectors: DataFrame, k: int = 20, queries: DataFrame | None = None, cosine: float = 1.0, prior: float = 0.0, clip: bool = False, digits: int = 9) -> DataFrame:
    """(node, neighbour, sim, rank): the k most similar other nodes of every node of ``queries`` (or of all), exactly.

    ``vectors`` and ``queries`` are (node, vec), one row per node, vectors of one length, and with ``prior`` also path.  The
    similarity is ``cosine`` times the inner product (with ``clip`` not below 0) plus ``prior`` times the share of the first
    four path segments in common, rounded to ``digits`` decimals, equal ones ranked by id.  Every block of queries meets all
    blocks of vectors in the order of their ids and keeps its best ``k`` on the way, so a task holds two blocks, no pair
    is ever written, and nothing is merged afterwards; work is the product of both sides.
    """
    wanted = ["node", "vec", (path_prefixes("path") if prior else F.array().cast("array<bigint>")).alias("prefixes")]
    every = runtime.materialise(vectors.filter("node is not null and vec is not null").select(*wanted), "vectors")
    asking = every if queries is None else runtime.materialise(queries.filter("node is not null and vec is not null").select(*wanted), "queries")

    def packed(rows: DataFrame, size: int) -> tuple[DataFrame, int]:
        """One block per range of ids, numbered by it, and the number of ranges."""
        ranges = max(1, -(-rows.count() // size))

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [b for b in batches if b.num_rows]
            if held:
                nodes, vecs, prefixes = (c.to_pylist() for c in pa.Table.from_batches(held).columns)
                columns = [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([nodes[0]], pa.string()), pa.array([nodes], pa.list_(pa.string())), *(pa.array([np.array(x, t).tobytes()], pa.binary()) for x, t in ((vecs, np.float64), (prefixes, np.int64)))]
                yield pa.RecordBatch.from_arrays(columns, names=["no", "first", "nodes", "data", "prefixes"])

        ordered = rows.repartitionByRange(ranges, "node").sortWithinPartitions("node")
        return runtime.materialise(ordered.mapInArrow(pack, "no int, first string, nodes array<string>, data binary, prefixes binary"), "blocks"), ranges

    blocks, n = packed(asking, QUERY_BLOCK)
    payload = ["first", "nodes", "data", "prefixes"]
    asked = blocks.select(F.col("no").alias("q"), F.lit(0).alias("role"), *payload)
    # Every block goes to every range of queries: the product of the two numbers of blocks, never of rows.
    met = packed(every, BLOCK)[0].select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("q"), F.lit(1).alias("role"), *payload)
    # Without a number of partitions small blocks would be put together in one task.
    width = max(1, min(n, runtime.shuffle_width(vectors.sparkSession)))
    ordered = asked.unionByName(met).repartition(width, "q").sortWithinPartitions("q", "role", "first")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = None, -1
        for batch in batches:
            for i in range(batch.num_rows):
                q = batch.column(0)[i].as_py()
                if batch.column(1)[i].as_py() and q != at:
                    continue  # no queries in this range of ids
                nodes = np.array(batch.column(3)[i].as_py(), object)
                data, prefixes = (np.frombuffer(batch.column(c)[i].as_py(), t).reshape(len(nodes), -1) for c, t in ((4, np.float64), (5, np.int64)))
                if batch.column(1)[i].as_py() == 0:
                    if held is not None:
                        yield held.rows()
                    held, at = _Best(nodes, data, prefixes, k, (cosine, prior, clip, digits)), q
                else:
                    held.meet(nodes, data, prefixes)
        if held is not None:
            yield held.rows()

    return ordered.mapInArrow(search, "node string, neighbour string, sim double, rank int")


class _Best:
    """The best ``k`` neighbours of a block of queries among the blocks met so far, which come in the order of their ids."""

    def __init__(self, nodes: np.ndarray, data: np.ndarray, prefixes: np.ndarray, k: int, measure: tuple[float, float, bool, int] = (1.0, 0.0, False, 9)) -> None:
        self.nodes, self.data, self.prefixes, self.k, self.at = nodes, data, prefixes, k, {x: i for i, x in enumerate(nodes)}
        self.measure = measure
        self.sim = np.full((len(nodes), k), -np.inf)
        self.name = np.full((len(nodes), k), None, object)

    def _scores(self, a: int, b: int, data: np.ndarray, prefixes: np.ndarray) -> np.ndarray:
        cosine, prior, clip, digits = self.measure
        s = self.data[a:b] @ data.T
        if clip:
            s = np.maximum(s, 0.0)
        s *= cosine
        if prior:
            depth = prefixes.shape[1]
            for level in range(depth):
                own = self.prefixes[a:b, level][:, None]
                s += prior / depth * ((own == prefixes[:, level]) & (own != 0))
        return np.round(s, digits) + 0.0

    def meet(self, nodes: np.ndarray, data: np.ndarray, prefixes: np.ndarray) -> None:
        own = np.array([self.at.get(x, -1) for x in nodes], np.int64)
        for a in range(0, len(self.nodes), STEP):
            b = min(a + STEP, len(self.nodes))
            s = self._scores(a, b, data, prefixes)
            here = np.nonzero((own >= a) & (own < b))[0]
            s[own[here] - a, here] = -np.inf
            # A later node never displaces an equal one, as ids only grow.
            keep = s > self.sim[a:b, -1:]
            if s.shape[1] > self.k:
                keep &= s >= np.partition(s, -self.k, axis=1)[:, -self.k][:, None]
            r, c = np.nonzero(keep)
            if not len(r):
                continue
            row = np.r_[np.repeat(np.arange(b - a), self.k), r]
            place = np.r_[np.tile(np.arange(self.k), b - a), self.k + c]
            sim = np.r_[self.sim[a:b].ravel(), s[r, c]]
            name = np.r_[self.name[a:b].ravel(), nodes[c]]
            order = np.lexsort((place, -sim, row))
            row = row[order]
            rank = np.arange(len(row)) - np.searchsorted(row, np.arange(b - a))[row]
            order = order[rank < self.k]
            self.sim[a:b] = sim[order].reshape(b - a, self.k)
            self.name[a:b] = name[order].reshape(b - a, self.k)

    def rows(self) -> pa.RecordBatch:
        r, c = np.nonzero(np.isfinite(self.sim))
        return pa.RecordBatch.from_arrays(
            [pa.array(self.nodes[r], pa.string()), pa.array(self.name[r, c], pa.string()), pa.array(self.sim[r, c]), pa.array((c + 1).astype(np.int32))], names=["node", "neighbour", "sim", "rank"]
        )
