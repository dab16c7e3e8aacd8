"""The registry of built indexes: a small JSON file with one entry per slug, read and written on the driver."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = ("slug", "repo", "commit", "db_path", "mcp_path", "config_path", "status", "updated_at")
SCHEMA = ", ".join(f"{f} string" for f in FIELDS)


def load(path: str) -> list[dict]:
    """The entries of the file, none where it is missing."""
    if not os.path.exists(path):
        return []
    with open(path, encoding="utf-8") as file:
        return [{f: e.get(f) for f in FIELDS} for e in json.load(file).get("entries", [])]


def save(entries: list[dict], path: str) -> None:
    """Writes beside the file and then takes its place, so a reader never sees half a registry."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=folder, prefix=".registry-")
    with os.fdopen(handle, "w", encoding="utf-8") as file:
        json.dump({"version": 1, "entries": sorted(entries, key=lambda e: e["slug"])}, file, indent=2, ensure_ascii=False)
    os.replace(name, path)


def put(entry: dict, path: str) -> None:
    save([e for e in load(path) if e["slug"] != entry["slug"]] + [{f: entry.get(f) for f in FIELDS}], path)


def remove(slug: str, path: str) -> bool:
    entries = load(path)
    kept = [e for e in entries if e["slug"] != slug]
    if len(kept) < len(entries):
        save(kept, path)
    return len(kept) < len(entries)


def frame(spark: SparkSession, path: str) -> DataFrame:
    return spark.createDataFrame([tuple(e[f] for f in FIELDS) for e in load(path)], SCHEMA)


def statuses(targets: DataFrame, registered: DataFrame) -> DataFrame:
    """(slug, status): 'ready' where the entry says so and its index exists, 'stale_metadata' where an entry's index is gone,
    'db_only' for an index without a good entry, else 'missing'.

    ``targets`` is (slug, computed_exists), ``registered`` (slug, status, db_exists), one row per slug.
    """
    met = targets.join(registered.select("slug", F.col("status").alias("stated"), "db_exists"), "slug", "left")
    found = F.coalesce("db_exists", F.lit(False))
    status = F.when(found & (F.col("stated") == "ready"), "ready").when(F.col("db_exists").isNotNull() & ~found, "stale_metadata").when(F.coalesce("computed_exists", F.lit(False)), "db_only").otherwise("missing")
    return met.select("slug", status.alias("status"))


def gateway(entries: list[dict], listen: int = 8765, base: int = 28065) -> str:
    """A proxy configuration that maps the path of every ready entry, in order of slug, to the next port from ``base``."""
    lines = ["events {}", "http {", "  server {", f"    listen {listen};"]
    for port, entry in enumerate(sorted((e for e in entries if e["status"] == "ready"), key=lambda e: e["slug"]), base):
        lines += [f"    location {(entry['mcp_path'] or '').rstrip('/') or '/mcp'} {{", f"      proxy_pass http://127.0.0.1:{port};", f"      proxy_set_header Host 127.0.0.1:{port};", "      proxy_buffering off;", "    }"]
    return "\n".join([*lines, "  }", "}"]) + "\n"
