"""Parent-child links to full hierarchies by tree contraction (problem 7).

Every round first *rakes* (every leaf goes) and then *compresses*: of every chain of nodes with one child an
independent set - the nodes whose hash, new each round, is above those of their neighbours - is bypassed, the child
taking over the link, its length and the nodes on it.  Each removal is recorded.  A forest of any shape is gone after a
number of rounds logarithmic in its size; what cannot be removed are links of a node to itself, each the core of a
loop.  Reversing the recorded removals, latest first, hands every node its root, depth and path from the parent it
had when it went; whatever hangs below a core is on or below a loop.

A round is one job that writes the links left and the links gone.  Children are counted with map-side combining, and
the joins of children to a parent that has very many of them are salted; contraction never adds children to a node,
so the heavy parents of the first table are those of all rounds.

Defined results: a link counts when its parent is a node of the table; a node without such a link is a root (null
and blank parents too); a node that is its own parent is a loop; a null node is left out; of repeated nodes the caller
chooses the row (``latest_links``); extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss import runtime

_LINK = ["node", "parent", "length", "between"]
#: Rows that a task of a round should at least have; a round with fewer is one task and shuffles nothing.
TASK_ROWS = 50_000


def _sized(rows: DataFrame, n: int) -> DataFrame:
    return rows.coalesce(1) if n <= TASK_ROWS else rows


def latest_links(table: DataFrame, id_col: str = "symbol_id", parent_col: str = "enclosing_symbol", time_col: str = "ingested_at") -> DataFrame:
    """(node, parent): the row with the latest time per id; rows of one id with equal times are copies."""
    latest = table.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("node")).agg(F.max(F.struct(F.col(time_col), F.col(parent_col).alias("parent"))).alias("row"))
    return latest.select("node", F.col("row.parent").alias("parent"))


def _rank(node: Column, round_no: int) -> Column:
    return F.xxhash64(node, F.lit(round_no))


def _contract(links: DataFrame, round_no: int) -> DataFrame:
    """One round: the links with ``gone`` = 'raked' or 'bypassed' as they were, and null for those left (relinked)."""
    parents = links.select(F.col("parent").alias("node")).distinct().withColumn("_up", F.lit(True))
    marked = links.join(parents, "node", "left")
    raked, inner = marked.filter("_up is null").drop("_up"), marked.filter("_up").drop("_up")
    only = inner.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("c"), F.min("node").alias("child")).filter("c = 1").select("node", "child")
    mine = _rank(F.col("node"), round_no)
    chosen = (F.col("node") != F.col("parent")) & (mine > _rank(F.col("parent"), round_no)) & (mine > _rank(F.col("child"), round_no))
    flagged = inner.join(only, "node", "left").withColumn("_off", F.coalesce(F.col("child").isNotNull() & chosen, F.lit(False)))
    bypassed = flagged.filter("_off")
    over = bypassed.select(F.col("child").alias("node"), F.col("node").alias("b_node"), F.col("parent").alias("b_parent"), F.col("length").alias("b_length"), F.col("between").alias("b_between"))
    moved = flagged.filter("not _off").join(over, "node", "left")
    hit = F.col("b_node").isNotNull()
    left = moved.select(
        "node",
        F.when(hit, F.col("b_parent")).otherwise(F.col("parent")).alias("parent"),
        F.when(hit, F.col("length") + F.col("b_length")).otherwise(F.col("length")).alias("length"),
        F.when(hit, F.concat("b_between", F.when(F.col("kept"), F.array("b_node")).otherwise(F.array().cast("array<string>")), "between")).otherwise(F.col("between")).alias("between"),
        "kept",
        F.lit(None).cast("string").alias("gone"),
    )
    out = (raked.withColumn("gone", F.lit("raked")), bypassed.select(*_LINK, "kept", F.lit("bypassed").alias("gone")))
    return left.unionByName(out[0].select(*_LINK, "kept", "gone")).unionByName(out[1])


def _undo(gone: DataFrame, done: DataFrame, heavy: DataFrame | None) -> DataFrame:
    """(node, root, depth, path) of removed links from what their parents have; a parent without a link is a root."""
    up = done.select(F.col("node").alias("parent"), F.col("root").alias("u_root"), F.col("depth").alias("u_depth"), F.col("path").alias("u_path"), F.lit(True).alias("u_known"))
    met = runtime.join_heavy(gone, up, ["parent"], ["node"], heavy, "left")
    top = F.col("u_known").isNull()
    return met.select(
        "node",
        F.when(top, F.col("parent")).otherwise(F.col("u_root")).alias("root"),
        F.when(top, F.col("length")).otherwise(F.col("u_depth") + F.col("length")).alias("depth"),
        F.when(F.col("kept"), F.concat(F.when(top, F.array("parent")).otherwise(F.col("u_path")), "between", F.array("node"))).otherwise(F.lit(None).cast("array<string>")).alias("path"),
    )


def hierarchy(nodes: DataFrame, paths: bool = True, heavy_rows: int = runtime.HEAVY_ROWS) -> DataFrame:
    """(node, root, depth, path, in_loop) for every row (node, parent) of ``nodes``.

    ``path`` lists the ids from the root to the node (null without ``paths``); on and below loops root, depth and path
    are null and ``in_loop`` is true.
    """
    named = nodes.filter("node is not null and parent is not null").select("node", "parent")
    heavy = runtime.heavy_keys(named, ["parent"], heavy_rows)
    links = runtime.join_heavy(named, nodes.select(F.col("node").alias("parent")).distinct(), ["parent"], ["node"], heavy, "left_semi")
    live = runtime.materialise(links.select("node", "parent", F.lit(1).cast("long").alias("length"), F.array().cast("array<string>").alias("between"), F.lit(paths).alias("kept")), "links")
    records: list[tuple[DataFrame, int]] = []
    while True:
        size = live.agg(F.count("*").alias("n"), F.sum((F.col("node") != F.col("parent")).cast("long")).alias("open")).first()
        if not size["open"]:
            break
        after = runtime.materialise(_contract(_sized(live, size["n"]), len(records)), "round")
        records.append((after, size["n"]))
        live = after.filter("gone is null").drop("gone")
    done = runtime.materialise(live.select("node", F.lit(None).cast("string").alias("root"), F.lit(None).cast("long").alias("depth"), F.lit(None).cast("array<string>").alias("path")), "done")
    for after, n in reversed(records):
        # Of one round, the nodes raked hang below those bypassed or below older ones; what is done so far are the links it left.
        # The whole is written anew each time, so plans stay small; the sizes grow like a geometric series.
        old = _sized(done, n)
        bypassed, raked = (_sized(after.filter(F.col("gone") == how).drop("gone"), n) for how in ("bypassed", "raked"))
        back = _undo(bypassed, old, heavy)
        known = _sized(old.unionByName(back), n)
        done = runtime.materialise(known.unionByName(_undo(raked, known, heavy)), "done")
    linked = done.select("node", "root", "depth", F.when(F.lit(paths), F.col("path")).alias("path"), F.col("root").isNull().alias("in_loop"))
    roots = nodes.filter("node is not null").select("node").join(done.select("node"), "node", "left_anti")
    own = roots.select("node", F.col("node").alias("root"), F.lit(0).cast("long").alias("depth"), (F.array("node") if paths else F.lit(None).cast("array<string>")).alias("path"), F.lit(False).alias("in_loop"))
    return linked.unionByName(own)


def descendants(tree: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance): the closure of a ``hierarchy`` result with paths; nodes of loops have none."""
    steps = tree.filter(~F.col("in_loop")).select(F.col("node").alias("descendant"), "depth", F.posexplode("path").alias("at", "ancestor"))
    return steps.filter(F.col("at") < F.col("depth")).select("ancestor", "descendant", (F.col("depth") - F.col("at")).alias("distance"))


def hierarchy_report(tree: DataFrame) -> DataFrame:
    """(node, root, depth, path, in_loop, n_descendants): ``path`` as text, ids joined by ' > '."""
    below = descendants(tree).groupBy(F.col("ancestor").alias("node")).agg(F.count("*").alias("n_descendants"))
    return tree.join(below, "node", "left").select("node", "root", "depth", F.when(~F.col("in_loop"), F.concat_ws(" > ", "path")).alias("path"), "in_loop", F.coalesce("n_descendants", F.lit(0)).cast("long").alias("n_descendants"))
