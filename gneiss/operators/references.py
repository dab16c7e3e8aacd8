"""References to records that do not exist (problem 4).

The distinct non-null foreign keys of a field, each with its earliest reference, are anti-joined with the
parent keys, each with the time it became valid.  What is left are the keys with orphan references: keys no
valid parent has, and keys whose parent arrived after a reference.  Joined back to the references they give
the orphans and their counts per table, field and period.

Keys are combined before every shuffle, so a parent that half of all references name costs one row per task; the
join back meets suspicious keys only, and a suspicious key that many references name is salted.

Defined results: null and empty keys are no references; a parent row counts when its deletion time is null and its
own time is not later than the reference's; a null time on either side never counts as in time; repeated rows
of a reference key count once in ``orphans``; extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Blocks of one suspicious key in the join back.
SALTS = 16


@dataclass(frozen=True)
class Reference:
    """A field of a table whose values are keys of another table."""

    table: str
    field: str
    row_key: str
    parent_table: str
    parent_key: str


REFERENCES = (
    Reference("occurrences", "symbol_id", "id", "symbols", "symbol_id"),
    Reference("occurrences", "document_id", "id", "documents", "document_id"),
    Reference("code_edges", "src_node", "edge_id", "code_nodes", "node_id"),
    Reference("code_edges", "dst_node", "edge_id", "code_nodes", "node_id"),
)


def orphan_rows(child: DataFrame, parent: DataFrame, ref: Reference, time_col: str = "ingested_at", deleted_col: str = "deleted_at") -> DataFrame:
    """(row_key, key, at) of every reference without a valid parent; repeated rows stay."""
    refs = child.filter((F.col(ref.field) != "") & F.col(ref.row_key).isNotNull()).select(F.col(ref.row_key).cast("string").alias("row_key"), F.col(ref.field).alias("key"), F.col(time_col).alias("at"))
    since = parent.filter(F.col(ref.parent_key).isNotNull() & F.col(deleted_col).isNull() & F.col(time_col).isNotNull()).groupBy(F.col(ref.parent_key).alias("key")).agg(F.min(time_col).alias("since"))
    # Distinct keys with their earliest reference; one without a time is earlier than any parent.
    keys = refs.groupBy("key").agg(F.min("at").alias("first"), F.count("*").alias("n"), F.count("at").alias("timed"))
    valid = since.select("key", F.col("since"))
    lost = keys.alias("k").join(valid.alias("p"), (F.col("k.key") == F.col("p.key")) & (F.col("p.since") <= F.col("k.first")) & (F.col("k.n") == F.col("k.timed")), "left_anti")
    suspicious = lost.join(valid, "key", "left").select("key", "since", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = refs.withColumn("salt", F.pmod(F.xxhash64("row_key", "at"), F.lit(SALTS)).cast("int"))
    back = salted.join(suspicious, ["key", "salt"])
    return back.filter(F.col("since").isNull() | F.col("at").isNull() | (F.col("since") > F.col("at"))).select("row_key", "key", "at")


def orphans(tables: dict[str, DataFrame], references: tuple[Reference, ...] = REFERENCES) -> DataFrame:
    """(ref_table, ref_field, row_key): every orphan reference once."""
    out = None
    for r in references:
        one = orphan_rows(tables[r.table], tables[r.parent_table], r).select("row_key").distinct().select(F.lit(r.table).alias("ref_table"), F.lit(r.field).alias("ref_field"), "row_key")
        out = one if out is None else out.unionByName(one)
    return out


def orphan_report(tables: dict[str, DataFrame], references: tuple[Reference, ...] = REFERENCES) -> DataFrame:
    """(ref_table, ref_field, period, n_rows, n_keys): orphan reference rows and distinct missing keys per month ('yyyy-MM', null without a time)."""
    out = None
    for r in references:
        rows = orphan_rows(tables[r.table], tables[r.parent_table], r).select("key", F.date_format("at", "yyyy-MM").alias("period"))
        # Two steps instead of a distinct count: rows per (period, key) are combined before they meet.
        per_key = rows.groupBy("period", "key").agg(F.count("*").alias("n"))
        one = per_key.groupBy("period").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_keys")).select(F.lit(r.table).alias("ref_table"), F.lit(r.field).alias("ref_field"), "period", "n_rows", "n_keys")
        out = one if out is None else out.unionByName(one)
    return out
