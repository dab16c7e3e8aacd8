"""Most similar vectors for every vector: inverted file, product-quantised residuals, exact reranking (problem 3).

* About ``LISTS_PER_ROOT * sqrt(n)`` coarse centroids and the residual codebooks are fitted on a hash-ordered sample of
  at most ``SAMPLE_PER_LIST`` vectors per list and ``MOST_SAMPLE`` in all; every vector is then assigned and coded.
* Each query probes the ``probes`` lists whose centroids are nearest to it.  Queries of neighbouring lists form a
  group that is searched together: the lists that any of them probes travel to the group packed as codes (one
  byte per subspace), and each list is scored only for the queries that probe it, by asymmetric distance tables
  (exact query times codebook).
* The best ``rerank`` candidates of each query are reranked with the exact vectors by cosine, rounded to 9 decimals,
  ties in favour of the smaller node id.

``probes=None`` probes every list and ``rerank=None`` reranks every candidate: together they are the exact search.
With lists of about ``sqrt(n) / LISTS_PER_ROOT`` vectors the work grows as ``n ** 1.5``.

Nodes with an identical vector are one entry of the index that carries their ``k + 1`` smallest ids, which is all
any ranking can use, so a vector shared by a third of all nodes makes no list larger.  Groups with many queries
or codes are cut into blocks of bounded size, and the members of a much shared vector are joined in salted parts.

Defined results: invalid vectors (null, unreadable, wrong length, non-finite or non-number entries, all zero) are
left out; copies of a node count once (the least text if they differ); null node ids are left out; fewer than
``k`` other nodes give fewer neighbours; extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gneiss import runtime

#: Lists per square root of the number of vectors; vectors fitted per list and in all.
LISTS_PER_ROOT = 2
SAMPLE_PER_LIST = 32
MOST_SAMPLE = 1 << 20
#: Lists probed by each query, candidates reranked per query.
PROBES = 32
RERANK = 64
#: Dimensions per subspace and codes per subspace.
SUB = 4
CODES = 256
#: Queries aimed at per group; queries and codes in one block of work; codes of a list packed in one row.
GROUP_QUERIES = 2048
QUERY_BLOCK = 8192
CODE_BLOCK = 1 << 20
PACK = 4096
#: Scores held at once while a block is searched.
HELD_SCORES = 1 << 22
#: Blocks in which the ids of one vector are ranked.
SALTS = 16
ROUND = 9

_INDEX = "key long, list int, grp int, probes array<int>, code binary, vec binary, ids array<string>"


def parse_vector(text: str | None, dim: int) -> np.ndarray | None:
    """The unit vector of a JSON array of exactly ``dim`` numbers, not all zero; otherwise None."""
    if not text:
        return None
    try:
        values = json.loads(text)
    except ValueError:
        return None
    if not isinstance(values, list) or len(values) != dim or any(type(x) not in (int, float) for x in values):
        return None
    try:
        vector = np.array(values, np.float64)
    except OverflowError:
        return None
    largest = np.abs(vector).max() if np.isfinite(vector).all() else 0.0
    if not largest:
        return None
    vector = vector / largest
    return vector / math.sqrt(float(vector @ vector))


def kmeans(data: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = data[rng.choice(len(data), k, replace=len(data) < k)].copy()
    for _ in range(rounds):
        near = nearest(data, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, data)
        n = np.bincount(near, minlength=k)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
        centres[n == 0] = data[rng.choice(len(data), int((n == 0).sum()))]
    return centres


def nearest(data: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres * centres).sum(axis=1) / 2
    return np.concatenate([(data[i : i + 4096] @ centres.T - half).argmax(axis=1) for i in range(0, len(data), 4096)]) if len(data) else np.empty(0, np.int64)


class Model:
    """Coarse centroids, the groups they form, and residual codebooks."""

    def __init__(self, sample: np.ndarray, lists: int, groups: int = 1) -> None:
        self.centres = kmeans(sample, lists, 12, 1)
        self.group = nearest(self.centres, kmeans(self.centres, min(groups, lists), 8, 7)).astype(np.int32)
        rest = sample - self.centres[nearest(sample, self.centres)]
        self.cuts = list(range(0, sample.shape[1], SUB))
        k = min(CODES, len(sample))
        self.books = [kmeans(rest[:, c : c + SUB], k, 8, 2 + c) for c in self.cuts]

    def encode(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        home = nearest(data, self.centres)
        rest = data - self.centres[home]
        return home, np.stack([nearest(rest[:, c : c + SUB], b) for c, b in zip(self.cuts, self.books, strict=True)], axis=1).astype(np.uint8)

    def probes(self, data: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` nearest lists of each vector."""
        half = (self.centres * self.centres).sum(axis=1) / 2
        n = min(n, len(half))
        return np.concatenate([np.argpartition(half - data[i : i + 1024] @ self.centres.T, n - 1, axis=1)[:, :n] for i in range(0, len(data), 1024)]).astype(np.int32)

    def tables(self, queries: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Inner products of exact queries with every centroid, and with every code of every subspace."""
        q = queries.astype(np.float32)
        return q @ self.centres.T.astype(np.float32), [q[:, c : c + SUB] @ b.T.astype(np.float32) for c, b in zip(self.cuts, self.books, strict=True)]


def search_lists(model: Model, queries: np.ndarray, probes: np.ndarray, homes: np.ndarray, lengths: np.ndarray, codes: np.ndarray, rerank: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, code row, score) of the best ``rerank`` codes of each query, among the lists that it probes.

    ``codes`` holds packs of lists one after the other; pack j has ``lengths[j]`` codes of list ``homes[j]``.
    """
    first = np.r_[0, np.cumsum(lengths)]
    # Codes that each query will meet, for the width of the buffer.
    per_list = np.zeros(len(model.centres), np.int64)
    np.add.at(per_list, homes, lengths)
    meets = per_list[probes].sum(axis=1)
    out_q, out_c, out_s = [], [], []
    step = max(1, min(len(queries), HELD_SCORES // max(1, int(meets.max(initial=0)))))
    for i in range(0, len(queries), step):
        centre, table = model.tables(queries[i : i + step])
        own = probes[i : i + step]
        n, width = len(own), int(meets[i : i + step].max())
        if not width:
            continue
        order = np.argsort(own.ravel(), kind="stable")
        by_list, asking = own.ravel()[order], order // own.shape[1]
        begin, end = np.searchsorted(by_list, homes), np.searchsorted(by_list, homes, side="right")
        held, place, fill = np.full((n, width), -np.inf, np.float32), np.zeros((n, width), np.int32), np.zeros(n, np.int64)
        for j in np.nonzero(begin < end)[0]:
            rows = asking[begin[j] : end[j]]
            part = codes[first[j] : first[j + 1]]
            s = np.repeat(centre[rows, homes[j]][:, None], len(part), axis=1)
            for m, t in enumerate(table):
                s += t[rows[:, None], part[None, :, m]]
            at = fill[rows][:, None] + np.arange(len(part))
            held[rows[:, None], at] = s
            place[rows[:, None], at] = np.arange(first[j], first[j + 1])
            fill[rows] += len(part)
        r = width if rerank is None else min(rerank, width)
        top = np.argpartition(-held, r - 1, axis=1)[:, :r]
        score = np.take_along_axis(held, top, axis=1)
        real = np.isfinite(score)
        out_q.append(np.repeat(np.arange(i, i + n), r).reshape(n, r)[real])
        out_c.append(np.take_along_axis(place, top, axis=1)[real])
        out_s.append(score[real])
    if not out_q:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32)
    return np.concatenate(out_q), np.concatenate(out_c), np.concatenate(out_s)


def distinct_vectors(table: DataFrame, node_col: str, vec_col: str, dim: int, k: int) -> tuple[DataFrame, DataFrame]:
    """Distinct unit vectors (key, vec, ids: the k+1 least node ids) and memberships (key, node)."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, vecs = [], []
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                vector = parse_vector(text, dim)
                if vector is not None:
                    nodes.append(node)
                    vecs.append((vector + 0.0).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.string()), pa.array(vecs, pa.binary())], names=["node", "vec"])

    one = table.filter(F.col(node_col).isNotNull()).groupBy(F.col(node_col).alias("node")).agg(F.min(vec_col).alias("text"))
    parsed = runtime.materialise(one.mapInArrow(parse, "node string, vec binary").withColumn("key", F.xxhash64("vec")), "vectors")
    # The least k+1 ids of a group, found in salted blocks first.
    blocks = Window.partitionBy("key", F.pmod(F.xxhash64("node"), F.lit(SALTS))).orderBy("node")
    least = parsed.withColumn("r", F.row_number().over(blocks)).filter(F.col("r") <= k + 1)
    whole = least.groupBy("key").agg(F.first("vec").alias("vec"), F.slice(F.sort_array(F.collect_list("node")), 1, k + 1).alias("ids"))
    return whole, parsed.select("key", "node")


def nearest_nodes(table: DataFrame, vec_col: str, dim: int, k: int = 5, node_col: str = "node_id", probes: int | None = PROBES, rerank: int | None = RERANK) -> DataFrame:
    """(node, neighbour, cosine, rank): the k most similar other nodes of every node with a valid vector."""
    spark = table.sparkSession
    runtime.text_batches(spark)
    whole, members = distinct_vectors(table, node_col, vec_col, dim, k)
    whole = runtime.materialise(whole, "distinct")
    n = whole.count()
    lists = max(1, min(int(LISTS_PER_ROOT * math.sqrt(n)), n // 8, MOST_SAMPLE // 8))
    fitted = whole.select("vec").orderBy(F.xxhash64("key")).limit(min(MOST_SAMPLE, max(1024, lists * SAMPLE_PER_LIST))).collect()
    if not fitted:
        return spark.createDataFrame([], "node string, neighbour string, cosine double, rank int")
    model = Model(np.frombuffer(b"".join(r["vec"] for r in fitted)).reshape(-1, dim), lists, max(1, n // GROUP_QUERIES))
    sent = spark.sparkContext.broadcast(model)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs = batch.column(1).to_pylist()
            if vecs:
                data = np.frombuffer(b"".join(vecs)).reshape(-1, dim)
                home, codes = sent.value.encode(data)
                near = pa.array(list(sent.value.probes(data, probes or lists)), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(home.astype(np.int32)), pa.array(sent.value.group[home]), near, pa.array([c.tobytes() for c in codes], pa.binary()), batch.column(1), batch.column(2)],
                    names=["key", "list", "grp", "probes", "code", "vec", "ids"],
                )

    index = runtime.materialise(whole.select("key", "vec", "ids").mapInArrow(encode, _INDEX), "index")
    size = index.groupBy(F.col("list").alias("home")).agg(F.count("*").alias("n"))
    # One row per list that some query of a group probes, and the blocks of every group.
    routes = runtime.materialise(index.select("grp", F.explode("probes").alias("home")).distinct(), "routes")
    asking = index.groupBy("grp").agg(F.count("*").alias("n"))
    blocks = routes.join(size, "home").groupBy("grp").agg(F.sum("n").alias("codes")).join(asking, "grp")
    blocks = blocks.select("grp", F.ceil(F.col("n") / QUERY_BLOCK).cast("int").alias("nq"), F.ceil(F.col("codes") / CODE_BLOCK).cast("int").alias("nc"))
    blocks = runtime.materialise(blocks, "blocks")
    row = F.pmod(F.xxhash64("key"), F.col("nq")).cast("int")
    asked = index.join(blocks, "grp").select("grp", row.alias("qb"), F.explode(F.sequence(F.lit(0), F.col("nc") - 1)).alias("cb"), "key", "probes", "vec")

    def pack_list(rows: pa.Table) -> pa.Table:
        first = rows.column("home")[0].as_py()
        return pa.table({"home": pa.array([first], pa.int32()), "part": pa.array([rows.column("part")[0].as_py()], pa.int32()), "keys": [rows.column("key").to_numpy().tobytes()], "codes": [b"".join(rows.column("code").to_pylist())]})

    sized = index.select(F.col("list").alias("home"), "key", "code").join(size, "home")
    parts = sized.select("home", F.pmod(F.xxhash64("key", F.lit(3)), F.ceil(F.col("n") / PACK)).cast("int").alias("part"), "key", "code")
    packed = parts.groupBy("home", "part").applyInArrow(pack_list, "home int, part int, keys binary, codes binary")
    to = routes.join(blocks, "grp").select(F.col("grp").alias("g_grp"), "home", "nc", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("g_qb"))
    given = packed.join(to, "home").select("g_grp", "g_qb", F.pmod(F.xxhash64("home", "part"), F.col("nc")).cast("int").alias("g_cb"), "home", "keys", "codes")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({n: pa.array([], t) for n, t in _CANDIDATES})
        vecs = np.frombuffer(b"".join(left.column("vec").to_pylist())).reshape(-1, dim)
        probed = left.column("probes").combine_chunks().flatten().to_numpy().reshape(left.num_rows, -1)
        c_keys = np.frombuffer(b"".join(right.column("keys").to_pylist()), np.int64)
        coded = np.frombuffer(b"".join(right.column("codes").to_pylist()), np.uint8).reshape(len(c_keys), -1)
        lengths = np.array([len(x) // 8 for x in right.column("keys").to_pylist()], np.int64)
        q, c, s = search_lists(sent.value, vecs, probed, right.column("home").to_numpy(), lengths, coded, rerank)
        grp, qb = left.column("grp")[0].as_py(), left.column("qb")[0].as_py()
        return pa.table({"grp": pa.array(np.full(len(q), grp, np.int32)), "qb": pa.array(np.full(len(q), qb, np.int32)), "q": left.column("key").to_numpy()[q], "c": c_keys[c], "score": s})

    found = asked.groupBy("grp", "qb", "cb").cogroup(given.groupBy("g_grp", "g_qb", "g_cb")).applyInArrow(score, "grp int, qb int, q long, c long, score float")
    if rerank is not None and blocks.filter("nc > 1").limit(1).count():
        found = found.withColumn("_r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "c"))).filter(F.col("_r") <= rerank).drop("_r")
    found = runtime.materialise(found.select("grp", "qb", "q", "c"), "candidates")
    exact = index.select("key", "vec", "ids")
    wanted = found.select("grp", "qb", F.col("c").alias("key")).union(found.select("grp", "qb", F.col("q").alias("key"))).distinct().join(exact, "key").select(F.col("grp").alias("w_grp"), F.col("qb").alias("w_qb"), "key", "vec", "ids")

    def rank(pairs: pa.Table, vectors: pa.Table) -> pa.Table:
        if not pairs.num_rows:
            return pa.table({"key": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.string())), "cosines": pa.array([], pa.list_(pa.float64()))})
        keys = vectors.column("key").to_numpy()
        order = np.argsort(keys)
        vecs = np.frombuffer(b"".join(vectors.column("vec").to_pylist())).reshape(-1, dim)[order]
        ids = vectors.column("ids").to_pylist()
        keys_sorted = keys[order]
        q, c = (np.searchsorted(keys_sorted, pairs.column(x).to_numpy()) for x in ("q", "c"))
        by_q = np.argsort(q, kind="stable")
        q, c = q[by_q], c[by_q]
        cos = np.round(np.concatenate([(vecs[q[i : i + 65536]] * vecs[c[i : i + 65536]]).sum(axis=1) for i in range(0, len(q), 65536)]), ROUND)
        edges = np.r_[np.nonzero(np.r_[True, q[1:] != q[:-1]])[0], len(q)]
        out_k, out_i, out_s = [], [], []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            # Every candidate group has at least one id, so groups beyond the (k+1)th cosine can't matter.
            best = np.sort(-cos[a:b])[min(k, b - a - 1)]
            ranked = sorted((-s, i) for s, g in zip(cos[a:b].tolist(), c[a:b].tolist(), strict=True) if -s <= best for i in ids[order[g]])[: k + 1]
            out_k.append(keys_sorted[q[a]])
            out_i.append([i for _, i in ranked])
            out_s.append([-s for s, _ in ranked])
        return pa.table({"key": pa.array(out_k, pa.int64()), "ids": pa.array(out_i, pa.list_(pa.string())), "cosines": pa.array(out_s, pa.list_(pa.float64()))})

    ranked = found.groupBy("grp", "qb").cogroup(wanted.groupBy("w_grp", "w_qb")).applyInArrow(rank, "key long, ids array<string>, cosines array<double>")
    ranked = runtime.materialise(ranked, "ranked")
    listed = runtime.join_salted(members, ranked, ["key"], ["node"]).select("node", F.arrays_zip(F.col("ids").alias("neighbour"), F.col("cosines").alias("cosine")).alias("z"))
    others = listed.select("node", F.slice(F.filter("z", lambda x: x["neighbour"] != F.col("node")), 1, k).alias("z"))
    return others.select("node", F.posexplode("z").alias("p", "x")).select("node", F.col("x.neighbour").alias("neighbour"), F.col("x.cosine").alias("cosine"), (F.col("p") + 1).alias("rank"))


_CANDIDATES = [("grp", pa.int32()), ("qb", pa.int32()), ("q", pa.int64()), ("c", pa.int64()), ("score", pa.float32())]


def nearest_pairs(table: DataFrame, k: int = 5, node_col: str = "node_id") -> DataFrame:
    """(vec_field, node_a, node_b), node_a < node_b: one is among the k most similar of the other, by either vector."""
    out = None
    for name, column, dim in (("fused", "fused_vec_json", 36), ("semantic", "semantic_vec_json", 32)):
        near = nearest_nodes(table, column, dim, k, node_col)
        pairs = near.select(F.lit(name).alias("vec_field"), F.least("node", "neighbour").alias("node_a"), F.greatest("node", "neighbour").alias("node_b")).distinct()
        out = pairs if out is None else out.unionByName(pairs)
    return out
