"""Choice of the source backend: a precise index where there is one, else a syntax scan, else the documents alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.sources import java_syntax, records, scip

MODES = ("scip", "syntax", "document")


def read_any(spark: SparkSession, path: str, repo: str = "", commit: str = "") -> DataFrame:
    """Index records of a path by its suffix: lines of JSON, or binary index files."""
    if path.endswith((".ndjson", ".jsonl", ".json")):
        return records.read_index(spark, path)
    if path.endswith(".scip"):
        return scip.read_scip(spark, path, repo, commit)
    raise ValueError(f"neither index lines nor a binary index: {path}")


def with_texts(documents: DataFrame, files: DataFrame) -> DataFrame:
    """Documents with the text of the file whose path ends with theirs, where they have none; the shortest such path."""
    named = documents.withColumn("_suffix", F.col("relative_path"))
    parts = F.split("path", "/")
    suffix = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/")))
    texts = files.select("path", F.col("content").alias("_text"), suffix.alias("_suffix"))
    found = named.select("document_id", "_suffix").join(texts, "_suffix").groupBy("document_id").agg(F.min(F.struct(F.length("path").alias("n"), "path", "_text")).alias("m"))
    joined = documents.join(found, "document_id", "left")
    return joined.select(*[F.when(F.coalesce("content", F.lit("")) == "", F.coalesce("m._text", F.lit(""))).otherwise(F.col("content")).alias(c) if c == "content" else F.col(c) for c in documents.columns])


def load_index(spark: SparkSession, mode: str, index_path: str | None, tree: str | None, repo: str = "", commit: str = "") -> tuple[dict[str, DataFrame], str, list[str]]:
    """(tables, mode used, why others were not): ``auto`` tries scip, syntax and document in this order; a named mode is not
    replaced by another one."""
    if mode not in (*MODES, "auto"):
        raise ValueError(f"mode must be auto or one of {', '.join(MODES)}")

    def precise() -> dict[str, DataFrame]:
        parsed = read_any(spark, index_path or "", repo, commit)
        tables = {k: records.of_type(parsed, k.rstrip("s")) for k in ("documents", "symbols", "occurrences", "relations")}
        if not tables["symbols"].limit(1).count():
            raise ValueError("the index has no symbols")
        return tables | ({"documents": with_texts(tables["documents"], records.source_tree(spark, tree))} if tree else {})

    def syntax() -> dict[str, DataFrame]:
        tables = java_syntax.index_sources(records.source_tree(spark, tree or ""))
        if not tables["symbols"].limit(1).count():
            raise ValueError("no declarations found")
        return tables

    def plain() -> dict[str, DataFrame]:
        files = records.source_tree(spark, tree or "", "*")
        return {"documents": files.select(F.col("path").alias("document_id"), F.col("path").alias("relative_path"), F.lit("").alias("language"), "content")}

    steps: dict[str, Callable[[], dict[str, DataFrame]]] = {"scip": precise, "syntax": syntax, "document": plain}
    reasons = []
    for name in MODES if mode == "auto" else (mode,):
        try:
            return steps[name](), name, reasons
        except Exception as error:  # any failure of a backend is a reason to try the next
            if mode != "auto" or name == MODES[-1]:
                raise
            reasons.append(f"{name}: {type(error).__name__}: {str(error)[:200]}")
    raise AssertionError
