"""Maintenance of stored tables: keyed upserts, anti-join deletes, validation and small registries."""

from __future__ import annotations

import os
import time
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gneiss import runtime


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``new`` rows replace ``old`` rows of the same key."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.join(old.select(*keys).distinct(), keys, "left_anti"))


def delete_where(rows: DataFrame, doomed: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(doomed.select(*keys).distinct(), keys, "left_anti")


def purge_choice(chunks: DataFrame, repo: str, commit: str) -> DataFrame:
    """(choice): 'drop_table' if every chunk belongs to the snapshot, else 'delete_prefix'."""
    prefix = f"{repo}:{commit}:"
    return chunks.agg(F.when(F.sum((~F.col("document_id").startswith(prefix)).cast("long")) > 0, "delete_prefix").otherwise("drop_table").alias("choice"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n_rows)."""
    return reduce(DataFrame.unionByName, (t.agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows") for n, t in tables.items()))


def smoke_symbol(symbols: DataFrame) -> DataFrame:
    """The symbol with the longest name other than <init>; of equal ones the least name and id."""
    return symbols.filter("display_name <> '<init>'").select("symbol_id", "display_name").orderBy(F.desc(F.length("display_name")), "display_name", "symbol_id").limit(1)


def targets(manifest: DataFrame) -> DataFrame:
    """(repo, base_sha, n_samples, sample_ids): samples grouped by snapshot."""
    return manifest.groupBy("repo", "base_sha").agg(F.count("*").alias("n_samples"), F.array_join(F.sort_array(F.collect_set("id")), ",").alias("sample_ids"))


def slug(repo: str, commit: str):
    clean = F.regexp_replace(F.lower(F.trim(F.col(repo))), r"[^a-z0-9]+", "-")
    return F.concat(F.regexp_replace(clean, r"(^-+|-+$)", ""), F.lit("-"), F.substring(F.lower(commit), 1, 8))


def ports(registry: DataFrame, base: int) -> DataFrame:
    """(slug, port): ports in order of slug; the registry is a list of indexes, one row each."""
    return registry.select("slug").distinct().select("slug", (F.row_number().over(Window.orderBy("slug")) - 1 + base).alias("port"))


def job_states(events: DataFrame) -> DataFrame:
    """(user_id, last_type, last_ts, n_errors): latest state per key of an event log."""
    return events.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("m"), F.sum((F.col("event_type") == "error").cast("long")).alias("n_errors")).select("user_id", F.col("m.event_type").alias("last_type"), F.col("m.ts").alias("last_ts"), "n_errors")


def append_missing(spark: SparkSession, source: DataFrame, path: str, key: str) -> DataFrame:
    """Appends the rows of ``source`` whose key the table at ``path`` lacks and returns them; safe to repeat."""
    fresh = source.join(spark.read.parquet(path).select(key), key, "left_anti") if runtime.exists(spark, path) else source
    fresh = runtime.materialise(fresh, "fresh")
    fresh.write.mode("append").parquet(path)
    return fresh


def replace_snapshot(rows: DataFrame, path: str, keys: list[str], attempts: int = 3, wait: float = 0.5) -> None:
    """Writes ``rows`` so that they replace the partitions of their snapshots (``keys``) and leave all others; a failed write
    is repeated with twice the wait each time."""
    for attempt in range(attempts):
        try:
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)
            return
        except Exception:
            if attempt + 1 == attempts:
                raise
            time.sleep(wait * 2**attempt)


def truncate(table: DataFrame, path: str) -> None:
    """An empty table of the same columns at ``path``."""
    table.limit(0).write.mode("overwrite").parquet(path)


def write_both(rows: DataFrame, routes: dict[str, str], mode: str) -> list[str]:
    """Appends ``rows`` where the mode says - 'primary_only', 'dual' or 'secondary_only' - and returns the paths; routes to one
    and the same path are written once."""
    wanted = {"primary_only": ["primary"], "dual": ["primary", "secondary"], "secondary_only": ["secondary"]}
    if mode not in wanted:
        raise ValueError(f"mode must be one of {', '.join(wanted)}")
    paths = list(dict.fromkeys(routes[r] for r in wanted[mode]))
    for path in paths:
        rows.write.mode("append").parquet(path)
    return paths


def contract_problems(contract: DataFrame, version: str, tables: dict[str, DataFrame]) -> list[str]:
    """What is wrong with an index: more than one contract row, another schema version, or data without a contract.

    Tables are probed for one row, not counted.
    """
    rows = contract.select("schema_version").limit(2).collect()
    if len(rows) > 1:
        return ["more than one contract row"]
    if not rows:
        return [f"{name} has data without a contract" for name, t in tables.items() if t.limit(1).count()]
    return [] if rows[0][0] == version else [f"schema version {rows[0][0]!r} instead of {version!r}"]


def latest_jobs(jobs: DataFrame, limit: int) -> DataFrame:
    """The jobs created last, of equal times the greater id first."""
    return jobs.orderBy(F.desc("created_at"), F.desc("job_id")).limit(limit)


#: States of a job, and which may follow which.
TRANSITIONS = {"queued": ("running", "failed"), "running": ("succeeded", "failed"), "succeeded": (), "failed": ()}


def check_jobs(log: DataFrame) -> DataFrame:
    """(job_id, state, n_steps, n_broken): the last state of every job of a log (job_id, ts, state), and steps that may not
    follow their predecessor."""
    before = F.lag("state").over(Window.partitionBy("job_id").orderBy("ts", "state"))
    allowed = F.lit(False)
    for state, following in TRANSITIONS.items():
        allowed = allowed | ((F.col("before") == state) & F.col("state").isin(list(following)))
    steps = log.withColumn("before", before).withColumn("broken", F.when(F.col("before").isNull(), F.col("state") != "queued").otherwise(~allowed))
    return steps.groupBy("job_id").agg(F.max(F.struct("ts", "state")).alias("m"), F.count("*").alias("n_steps"), F.sum(F.col("broken").cast("long")).alias("n_broken")).select("job_id", F.col("m.state").alias("state"), "n_steps", "n_broken")


def last_messages(log: DataFrame, most: int = 30) -> DataFrame:
    """(job_id, message, r): the last messages of every job, newest first; keeping few is the feature."""
    return log.withColumn("r", F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("ts"), "message"))).filter(F.col("r") <= most).select("job_id", "message", "r")


def progress(message: Column | str) -> Column:
    """Percent done that a progress message 'stage=... done=... total=...' shows.  Fixed values: 15 at chunking, 30 to 70 while
    embedding, 70 at the graph, 100 at the end."""
    m = F.col(message) if isinstance(message, str) else message
    stage = F.regexp_extract(m, r"stage=(\w+)", 1)
    done, total = (F.regexp_extract(m, rf"{x}=(\d+)", 1).cast("double") for x in ("done", "total"))
    part = F.when(total > 0, F.least(F.lit(1.0), done / total)).otherwise(0.0)
    return F.when(stage == "chunk", 15).when(stage == "embed", (30 + 40 * part).cast("int")).when(stage == "graph", 70).when(stage == "done", 100).otherwise(0)


def route_targets(samples: DataFrame, registry: DataFrame) -> DataFrame:
    """(id, slug, path): every sample with the path under which its index is registered, null where it is not."""
    named = samples.select("id", slug("repo", "base_sha").alias("slug"))
    return named.join(registry.groupBy("slug").agg(F.max("path").alias("path")), "slug", "left").select("id", "slug", "path")


def status_counts(rows: DataFrame, column: str) -> DataFrame:
    """(status, n): rows per status, blank and null ones as 'unknown'."""
    status = F.when(F.trim(F.coalesce(F.col(column).cast("string"), F.lit(""))) == "", "unknown").otherwise(F.col(column).cast("string"))
    return rows.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def normal_commit(commit: Column | str) -> Column:
    """A commit of 7 to 40 hexadecimal digits in lower case; null for anything else."""
    value = F.lower(F.trim(F.col(commit) if isinstance(commit, str) else commit))
    return F.when(value.rlike("^[0-9a-f]{7,40}$"), value)


def allowed_path(path: str, roots: list[str]) -> bool:
    """Whether a path, with links and dots resolved, lies below one of the roots."""
    own = os.path.realpath(path)
    return any(own == r or own.startswith(r.rstrip("/") + "/") for r in map(os.path.realpath, roots))


def report_rows(summary: DataFrame, kept: list[str]) -> list[dict]:
    """The rows of a summary (bounded by its groups) as plain values, only the columns ``kept``: nothing else leaves in a report."""
    return [r.asDict() for r in summary.select(*[c for c in kept if c in summary.columns]).toLocalIterator()]


def markdown_table(rows: list[dict], columns: list[str]) -> str:
    cell = lambda v: f"{v:.4f}" if isinstance(v, float) else "" if v is None else str(v).replace("|", "\\|")
    lines = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(r.get(c)) for c in columns) + " |" for r in rows])


def merged_reports(reports: dict[str, DataFrame], metric: str, key: str) -> DataFrame:
    """(key, one column per report): a metric of several summaries side by side."""
    out = None
    for name, report in reports.items():
        part = report.groupBy(key).agg(F.max(metric).alias(name))
        out = part if out is None else out.join(part, key, "full")
    return out
