"""Evaluation datasets: JSON with ``samples``, JSON arrays, or one JSON object per line.  Bad rows are errors, with their line."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "query_id string, query string, gold_files array<string>, gold_symbols array<string>, repo_sha string"


def _names(value: object) -> list[str]:
    """A list as it is, a text cut at bars."""
    items = value if isinstance(value, list) else str(value or "").split("|")
    return [s for s in (str(x).strip() for x in items) if s]


def load_rows(path: str) -> list[dict]:
    """The rows of a dataset file; evaluation sets are small and read on the driver."""
    text = Path(path).read_text(encoding="utf-8")
    try:
        whole = json.loads(text)
    except ValueError:
        whole = None
    if isinstance(whole, dict) and "samples" in whole:
        whole = whole["samples"]
    if isinstance(whole, list):
        rows = list(enumerate(whole, 1))
    else:
        rows = []
        for n, line in enumerate(text.splitlines(), 1):
            if line.strip():
                try:
                    rows.append((n, json.loads(line)))
                except ValueError as e:
                    raise ValueError(f"{path}:{n}: not JSON: {e}") from e
    for n, row in rows:
        if not isinstance(row, dict) or not str(row.get("query", "")).strip():
            raise ValueError(f"{path}:{n}: a sample needs a query")
    return [row for _, row in rows]


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, query, gold_files, gold_symbols, repo_sha)."""
    out = []
    for i, row in enumerate(load_rows(path), 1):
        truth = row.get("ground_truth") or row
        out.append((str(row.get("sample_id") or row.get("id") or i), row["query"].strip(), _names(truth.get("gold_files")), _names(truth.get("gold_symbols") or row.get("golden") or row.get("relevant_ids")), row.get("repo_sha")))
    return spark.createDataFrame(out, SCHEMA)


def prune(lines: DataFrame, resolved: DataFrame) -> DataFrame:
    """Dataset rows (query_id, ...) of which at least one relevant result was resolved."""
    return lines.join(resolved.select("query_id").distinct(), "query_id", "left_semi")
