"""Persisted retrieval tables: postings for keyword search and one hash vector per record, built once per state of the source.

*Postings* are (term, id, tf, dl, positions), sorted by term and id over range partitions of both, so a query reads the
row groups of its own terms only and a term that most records have is spread over many files.  *Vectors* are (id, vec).
The folder's name holds a digest of the source files' names, sizes and times, so a changed source gets new tables; they
stay where the session names ``spark.checkpoint.dir``.

Defined results: a null id is left out; null and empty texts count as records of length 0; an empty table gives no hits.
"""

from __future__ import annotations

import atexit
import hashlib
import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss import runtime
from gneiss.operators import text

#: Postings per file, about.
FILE_ROWS = 4_000_000
#: Distinct tokens whose places a worker remembers.
KNOWN_TOKENS = 1 << 18


def source_state(spark: SparkSession, path: str) -> str:
    """Digest of names, sizes and modification times of the files at ``path``."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found, files = fs.listFiles(target, True), []
    while found.hasNext():
        f = found.next()
        files.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha1("\n".join(sorted(files)).encode()).hexdigest()


def stored(spark: SparkSession, name: str, source: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table ``name`` for the present state of ``source``, built and written where it is missing."""
    path = f"{runtime.shared_dir(spark).rstrip('/')}/gneiss-index-{name}-{source_state(spark, source)}"
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        build().write.mode("overwrite").parquet(path)
        if spark.sparkContext.getConf().get("spark.checkpoint.dir") is None:
            atexit.register(runtime._forget, spark, path)
    return spark.read.parquet(path)


def postings(docs: DataFrame, id_col: str, text_cols: list[str]) -> DataFrame:
    """(term, id, tf, dl, positions) of every record's terms, and one row with a null term per record for the statistics.

    A record's terms are gathered within its own row, so only finished postings are shuffled, once, for the order.
    """
    runtime.text_batches(docs.sparkSession)
    kept = docs.filter(F.col(id_col).isNotNull())
    terms = kept.select(F.col(id_col).cast("string").alias("id"), F.filter(F.split(F.concat_ws(" ", *(text.index_text(c) for c in text_cols)), r"[^\p{L}\p{N}]+"), lambda t: t != "").alias("w"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[], [], [], [], []]
            for i, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found: dict[str, list[int]] = {}
                for position, word in enumerate(words):
                    found.setdefault(word, []).append(position)
                n = len(found) + 1
                for column, values in zip(columns, ([None, *found], [i] * n, [0, *map(len, found.values())], [len(words)] * n, [[], *found.values()]), strict=True):
                    column += values
            types = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["term", "id", "tf", "dl", "positions"])

    rows = runtime.materialise(terms.mapInArrow(gather, "term string, id string, tf int, dl int, positions array<int>"), "postings")
    return rows.repartitionByRange(max(1, -(-rows.count() // FILE_ROWS)), "term", "id").sortWithinPartitions("term", "id")


def search(index: DataFrame, query: str) -> DataFrame:
    """(id, score): BM25 of the query's phrases, OR-ed, from the postings of its terms; records without any hit are left out."""
    phrases = text.query_phrases(query)
    words = sorted({w for p in phrases for w in p})
    if not words:
        return index.limit(0).select("id", F.lit(0.0).alias("score"))
    at = {w: F.max(F.when(F.col("term") == w, F.col("positions"))) for w in words}
    hits = index.filter(F.col("term").isin(words)).groupBy("id").agg(F.first("dl").alias("dl"), *(c.alias(f"w{i}") for i, c in enumerate(at.values())))
    place = {w: f"w{i}" for i, w in enumerate(words)}

    def moved(positions: Column, by: int) -> Column:
        return F.transform(positions, lambda p: p - by)

    def frequency(phrase: list[str]) -> Column:
        starts = F.coalesce(F.col(place[phrase[0]]), F.array().cast("array<int>"))
        for k, w in enumerate(phrase[1:], 1):
            starts = F.array_intersect(starts, moved(F.coalesce(F.col(place[w]), F.array().cast("array<int>")), k))
        return F.size(starts)

    counted = hits.select("id", "dl", *(frequency(p).alias(f"f{i}") for i, p in enumerate(phrases)))
    corpus = index.filter("term is null").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    stats = corpus.crossJoin(F.broadcast(counted.agg(*(F.sum((F.col(f"f{i}") > 0).cast("long")).alias(f"n{i}") for i in range(len(phrases))))))
    hit, score = F.lit(False), F.lit(0.0)
    for i in range(len(phrases)):
        f, n = F.col(f"f{i}"), F.coalesce(F.col(f"n{i}"), F.lit(0))
        hit = hit | (f > 0)
        idf = F.greatest(F.log((F.col("n") - n + 0.5) / (n + 0.5)), F.lit(text.IDF_FLOOR))
        score = score + idf * (f * (text.K1 + 1)) / (f + text.K1 * (1 - text.B + text.B * F.col("dl") / F.col("avgdl")))
    return counted.filter(hit).crossJoin(F.broadcast(stats)).select("id", score.alias("score"))


class _Places(dict):
    """Place and sign of a token in a hash vector."""

    def __init__(self, dim: int) -> None:
        self.dim = dim

    def __missing__(self, token: str) -> tuple[int, float]:
        if len(self) >= KNOWN_TOKENS:
            self.clear()
        digest = hashlib.sha1(token.encode("utf-8", "surrogatepass")).digest()
        found = self[token] = int.from_bytes(digest[:4], "big") % self.dim, 1.0 if digest[4] % 2 == 0 else -1.0
        return found


def _hashed(tokens: list[str], places: _Places) -> list[float] | None:
    v = [0.0] * places.dim
    for t in tokens:
        place, sign = places[t]
        v[place] += sign
    length = math.sqrt(sum(x * x for x in v))
    return [x / length for x in v] if length else None


def record_vectors(docs: DataFrame, id_col: str, text_col: str, dim: int = 128) -> DataFrame:
    """(id, vec): the dense hash vector of every record that has one; the places are those of ``text.hash_vector``."""
    runtime.text_batches(docs.sparkSession)
    tokens = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), r"(?U)\s+"), lambda t: t != "")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = _Places(dim)
        for batch in batches:
            vectors = [_hashed(words, places) for words in batch.column(1).to_pylist()]
            keep = pa.array([v is not None for v in vectors], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vectors, pa.list_(pa.float64()))], names=["id", "vec"]).filter(keep)

    return docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), tokens.alias("w")).mapInArrow(hashed, "id string, vec array<double>")


def query_vector(query: str, dim: int = 128) -> list[float]:
    """The hash vector of a query text, as the operator builds it for records."""
    return _hashed(query.split(), _Places(dim)) or [0.0] * dim


def nearest_to(vectors: DataFrame, query: list[float]) -> DataFrame:
    """(id, score): inner product of every record's vector with the query, over the places where that is not zero."""
    score = F.lit(0.0)
    for i, x in enumerate(query):
        if x:
            score = score + F.col("vec")[i] * F.lit(x)
    return vectors.select("id", score.alias("score"))
