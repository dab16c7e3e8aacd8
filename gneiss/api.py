"""Queries as values: what to ask, checked once, and turned into one lazy plan."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.operators import fusion, symbols, text

MODES = ("structure", "semantic", "hybrid")
BLENDS = ("linear", "rrf", "dense_guarded")
STRUCTURED = ("symbol_exact", "def_of", "refs_of", "callers_of", "callees_of")
# What each kind of index can answer.
CAPABILITIES = {
    "scip": {"find_entity", "def", "ref", "call", "hierarchy", "keyword", "hybrid", "semantic"},
    "syntax": {"find_entity", "def", "ref", "call", "hierarchy", "keyword", "hybrid", "semantic"},
    "document": {"keyword", "hybrid", "semantic"},
}
NEEDED = {"symbol_exact": "find_entity", "def_of": "def", "refs_of": "ref", "callers_of": "call", "callees_of": "call"}


class UnsupportedCapability(ValueError):
    pass


@dataclass(frozen=True)
class Query:
    text: str = ""
    mode: str = "hybrid"
    top_k: int = 10
    blend: str = "linear"
    structured_op: str | None = None
    symbol_id: str | None = None
    filters: dict[str, str] = field(default_factory=dict)

    def checked(self) -> Query:
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {', '.join(MODES)}")
        if self.blend not in BLENDS:
            raise ValueError(f"blend must be one of {', '.join(BLENDS)}")
        if self.top_k <= 0:
            raise ValueError("top_k must be positive")
        if self.structured_op is not None and self.structured_op not in STRUCTURED:
            raise ValueError(f"structured_op must be one of {', '.join(STRUCTURED)}")
        if self.structured_op in (None, "symbol_exact") and not self.text.strip():
            raise ValueError("text is empty")
        if self.structured_op not in (None, "symbol_exact") and not (self.symbol_id or "").strip():
            raise ValueError("symbol_id is empty")
        return self


@dataclass(frozen=True)
class Index:
    """Tables of one index: documents, symbols, occurrences, code_nodes and code_edges in canonical form."""

    tables: dict[str, DataFrame]
    source_mode: str = "scip"

    def require(self, capability: str) -> None:
        if capability not in CAPABILITIES[self.source_mode]:
            raise UnsupportedCapability(f"{capability} is not available for a {self.source_mode} index")

    def run(self, query: Query) -> DataFrame:
        q = query.checked()
        t = self.tables
        if q.structured_op is not None:
            self.require(NEEDED[q.structured_op])
            if q.structured_op == "symbol_exact":
                return symbols.symbol_exact(t["symbols"], q.text, q.top_k)
            one = t["symbols"].filter(F.col("symbol_id") == q.symbol_id).select("symbol_id").limit(1)
            if q.structured_op == "def_of":
                return symbols.definitions_of(t["occurrences"], t["documents"], one, q.top_k)
            if q.structured_op == "refs_of":
                return symbols.references_of(t["occurrences"], t["documents"], one, q.top_k)
            step = symbols.callers_of if q.structured_op == "callers_of" else symbols.callees_of
            return step(t["code_edges"], t["code_nodes"], one, q.top_k)
        self.require({"structure": "find_entity"}.get(q.mode, q.mode))
        docs = t["documents"]
        for column, value in q.filters.items():
            docs = docs.filter(F.col(column) == value)
        depth = q.top_k * (2 if q.blend == "dense_guarded" else 1)
        if q.mode == "structure":
            return symbols.symbol_exact(t["symbols"], q.text, q.top_k)
        semantic = self._semantic(docs, q.text, depth)
        if q.mode == "semantic":
            fused = semantic
        else:
            keyword = self._limited(text.bm25(docs, "document_id", ["content"], q.text), "id", depth)
            # Without the capability the structured channel of a hybrid query is empty, not an error.
            structured = self._limited(symbols.symbol_exact(t["symbols"], q.text, depth), "symbol_id", depth) if "find_entity" in CAPABILITIES[self.source_mode] else keyword.limit(0)
            channels = {"structure": fusion.ranked(structured), "keyword": fusion.ranked(keyword), "semantic": fusion.ranked(semantic)}
            if q.blend == "linear":
                fused = fusion.linear(channels, depth)
            elif q.blend == "rrf":
                fused = fusion.rrf(channels, depth)
            else:
                fused = fusion.dense_guarded(channels["structure"], channels["keyword"], channels["semantic"], self._paths(docs), q.top_k)
        final = fusion.prefer_source(fused, self._paths(docs), q.text)
        return final.orderBy(F.desc("score"), "result_id").limit(q.top_k)

    def described(self, results: DataFrame, code_chars: int = 200) -> DataFrame:
        """Results with what is known of them: (result_id, score, type, path, name, code, truncated, source_mode).

        A result is a document, with its first characters, or a symbol, with its name and the path of its first definition.
        """
        t = self.tables
        if "result_id" not in results.columns:
            results = results.withColumnRenamed("symbol_id", "result_id")
        code, truncated = text.projected("content", code_chars)
        docs = t["documents"].select(F.col("document_id").alias("result_id"), F.lit("document").alias("type"), F.col("relative_path").alias("path"), F.lit(None).cast("string").alias("name"), code.alias("code"), truncated.alias("truncated"))
        known = docs
        if "symbols" in t:
            first = symbols.first_paths(t["occurrences"], t["documents"])
            named = t["symbols"].join(first, "symbol_id", "left").select(F.col("symbol_id").alias("result_id"), F.lit("symbol").alias("type"), "path", F.col("display_name").alias("name"), F.lit(None).cast("string").alias("code"), F.lit(None).cast("boolean").alias("truncated"))
            known = docs.unionByName(named)
        return results.join(known, "result_id", "left").withColumn("source_mode", F.lit(self.source_mode))

    @staticmethod
    def _paths(docs: DataFrame) -> DataFrame:
        return docs.select(F.col("document_id").alias("result_id"), F.col("relative_path").alias("path"))

    @staticmethod
    def _limited(hits: DataFrame, id_col: str, n: int) -> DataFrame:
        return hits.select(F.col(id_col).alias("result_id"), "score").orderBy(F.desc("score"), "result_id").limit(n)

    def _semantic(self, docs: DataFrame, query: str, n: int) -> DataFrame:
        spark = docs.sparkSession
        vectors = text.hash_vector(docs, "document_id", "content")
        asked = text.hash_vector(spark.createDataFrame([(0, query)], "id int, q string"), "id", "q").select("idx", F.col("v").alias("w"))
        return self._limited(vectors.join(F.broadcast(asked), "idx").groupBy("id").agg(F.sum(F.col("v") * F.col("w")).alias("score")), "id", n)
