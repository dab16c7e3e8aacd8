"""Index records: one JSON object per line, four record types.  Lines that are no record are skipped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.operators.java import owner_of

SCHEMA = (
    "type string, repo string, commit_hash string, relative_path string, language string, occurrence_count int, content string, symbol_id string, display_name string, kind string, package string, "
    "signature_hash string, enclosing_symbol string, range array<int>, enclosing_range array<int>, role string, syntax_kind string, from_symbol string, to_symbol string, relation_type string, "
    "confidence double, evidence_relative_path string"
)
TYPES = ("document", "symbol", "occurrence", "relation")


def parse_lines(lines: DataFrame) -> DataFrame:
    """Records out of a frame with one line per ``value``."""
    parsed = lines.select(F.from_json("value", SCHEMA, {"mode": "PERMISSIVE"}).alias("r")).select("r.*")
    return parsed.filter(F.col("type").isin(*TYPES))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    if not path.endswith((".ndjson", ".jsonl", ".json")):
        raise ValueError(f"not an index file: {path}")
    return parse_lines(spark.read.text(path))


def _range(column: str):
    """(start line, start column, end line, end column): four numbers as they are, three on one line, anything else zeros."""
    r = F.col(column)
    n = F.coalesce(F.size(r), F.lit(0))
    part = lambda four, three: F.when(n == 4, r[four]).when(n == 3, r[three]).otherwise(0)
    return [part(0, 0).alias("range_start_line"), part(1, 1).alias("range_start_col"), part(2, 0).alias("range_end_line"), part(3, 2).alias("range_end_col")]


def _enclosing(column: str):
    r = F.col(column)
    n = F.coalesce(F.size(r), F.lit(0))
    part = lambda four, three: F.when(n == 4, r[four]).when(n == 3, r[three]).otherwise(-1)
    return [part(0, 0).alias("enclosing_range_start_line"), part(1, 1).alias("enclosing_range_start_col"), part(2, 0).alias("enclosing_range_end_line"), part(3, 2).alias("enclosing_range_end_col")]


def of_type(records: DataFrame, kind: str) -> DataFrame:
    """The records of one type with its columns and defaults."""
    own = records.filter(F.col("type") == kind)
    document = F.concat_ws(":", F.coalesce("repo", F.lit("")), F.coalesce("commit_hash", F.lit("")), "relative_path").alias("document_id")
    if kind == "document":
        return own.filter("relative_path is not null").select(document, "repo", "commit_hash", "relative_path", F.coalesce("language", F.lit("")).alias("language"), F.coalesce("occurrence_count", F.lit(0)).alias("occurrence_count"), F.coalesce("content", F.lit("")).alias("content"))
    if kind == "symbol":
        name, what = F.coalesce("display_name", "symbol_id"), F.coalesce("kind", F.lit("unknown"))
        return own.filter("symbol_id is not null").select("symbol_id", name.alias("display_name"), what.alias("kind"), "package", owner_of("symbol_id", "enclosing_symbol").alias("enclosing_symbol"), "language", "signature_hash", F.sha1(F.concat_ws("|", "symbol_id", name, what)).alias("symbol_fingerprint"))
    if kind == "occurrence":
        return own.filter("relative_path is not null and symbol_id is not null").select(document, "symbol_id", *_range("range"), F.coalesce("role", F.lit("unknown")).alias("role"), "syntax_kind", *_enclosing("enclosing_range"))
    if kind == "relation":
        return own.filter("from_symbol is not null and to_symbol is not null").select("from_symbol", "to_symbol", F.coalesce("relation_type", F.lit("references")).alias("relation_type"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"), "evidence_relative_path")
    raise ValueError(f"unknown record type {kind!r}; one of {', '.join(TYPES)}")


def source_tree(spark: SparkSession, root: str, suffix: str = "java") -> DataFrame:
    """(path, content) of every file below the root with the suffix."""
    files = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{suffix}").load(root)
    return files.select(F.input_file_name().alias("path"), F.col("value").alias("content"))
