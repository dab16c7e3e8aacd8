"""Filling fixed-capacity containers: a configuration linear program over the length histogram (problem 8).

Only the histogram of lengths (at most ``UNITS`` classes per window, a bound independent of the data) is needed to
plan a window, so one task per window plans it.  The configuration LP - how often to use each combination of lengths
that fits, so that every length is covered - is solved by multiplicative weights: a length weighs its size, times a
factor that falls with the share of it already covered; a knapsack dynamic program prices the heaviest combination; the
combination is used for a small step, never beyond what its scarcest length needs.  The steps add up to a fractional solution,
which is rounded down.  The remainder is a smaller program of the same kind, solved the same way until rounding gives
nothing more, and what then remains is packed on the histogram by first-fit decreasing.  The weights of every round are
a dual solution, so the best of them bounds the number of containers from below.

The plan is a table of slots per length; every record finds its container from its rank among records of its length,
computed in salted blocks, so a length that a third of all records have is no hot spot.

Lengths count in units of ``capacity / UNITS`` (rounded up), one token where the capacity is at most ``UNITS``.
A record longer than the capacity is cut into full containers and a rest, which is packed like any other.

Defined results: null, empty and zero-length records need no room and get container null; capacities that are null
or not positive are left out; repeated rows are items of their own; null ids are left out; extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gneiss import runtime
from gneiss.llm import tokens

#: Units into which a capacity is divided; steps of a program at most and, while it is large, at least; programs at most.
UNITS = 2048
ROUNDS = 400
LEAST_STEPS = 100
PROGRAMS = 2
#: How much more a length weighs, for its size, when it fills a container alone.
LARGE = 0.02
#: Strength of the weights.
STEP = 0.35
#: Tasks over which the windows are spread for planning.
PLAN_TASKS = 64
#: Rows per block when ranks are computed, and blocks at least.
BLOCK_ROWS = 1 << 20
SALTS = 32


def knapsack(weights: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[dict[int, int], float]:
    """Heaviest combination of sizes within the capacity, as index -> count, and its weight."""
    best = np.zeros(capacity + 1)
    pick = np.full(capacity + 1, -1, np.int64)
    order = np.argsort(sizes, kind="stable")
    s, w = sizes[order], weights[order]
    upto = np.searchsorted(s, np.arange(capacity + 1), side="right").tolist()
    for c in range(int(s[0]), capacity + 1):
        value = best[c - s[: upto[c]]] + w[: upto[c]]
        k = int(value.argmax())
        if value[k] > best[c - 1]:
            best[c], pick[c] = value[k], k
        else:
            best[c] = best[c - 1]
    chosen: dict[int, int] = {}
    c = capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
            continue
        i = int(order[pick[c]])
        chosen[i] = chosen.get(i, 0) + 1
        c -= int(s[pick[c]])
    return chosen, float(best[capacity])


def solve_program(sizes: np.ndarray, need: np.ndarray, capacity: int, rounds: int = ROUNDS) -> tuple[dict[tuple[tuple[int, int], ...], float], float]:
    """A fractional solution of the configuration LP, as combination -> times, and the dual bound on the containers.

    ``need`` has the positive number of items of each size.  A step takes at most half of what its scarcest
    length still needs, so that the weights can react.  The steps end when they fill the volume bound, or after ``rounds``
    of them; a length that is covered weighs next to nothing.
    """
    goal = float((sizes * need).sum()) / capacity
    covered = np.zeros(len(sizes))
    times: dict[tuple[tuple[int, int], ...], float] = {}
    bound, used = goal, 0.0  # the sizes themselves are a dual solution
    for _ in range(rounds):
        weights = sizes / capacity * (1 + LARGE * sizes / capacity) * np.exp(-STEP * (covered / need - used / goal))
        weights[covered >= need] *= 1e-6
        found, value = knapsack(weights, sizes, capacity)
        bound = max(bound, float(weights @ need) / value)
        config = tuple(sorted(found.items()))
        missing = min((need[i] - covered[i]) / n for i, n in config)
        step = min(max(1.0, goal / LEAST_STEPS), missing if missing < 2 else missing / 2)
        if step <= 1e-9:
            break
        times[config] = times.get(config, 0.0) + step
        for i, n in config:
            covered[i] += n * step
        used += step
        if used >= goal or (covered >= need).all():
            break
    return times, bound


def configurations(sizes: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = ROUNDS) -> tuple[list[tuple[dict[int, int], int]], int]:
    """(index -> count, times): combinations that together hold exactly ``counts`` items of each size; and the least number
    of containers by the dual bound of the whole program."""
    left = counts.astype(np.int64).copy()
    out: list[tuple[dict[int, int], int]] = []
    least = 0.0
    for program in range(PROGRAMS):
        live = np.nonzero(left)[0]
        if not len(live):
            break
        times, bound = solve_program(sizes[live], left[live].astype(float), capacity, rounds)
        if program == 0:
            least = bound
        placed = 0
        for config, x in sorted(times.items(), key=lambda kv: -kv[1]):
            whole = min([math.floor(x + 1e-9), *(int(left[live[i]]) // n for i, n in config)])
            if whole < 1:
                continue
            for i, n in config:
                left[live[i]] -= n * whole
            out.append(({int(live[i]): n for i, n in config}, whole))
            placed += whole
        if not placed:
            break
    return out + first_fit(sizes, left, capacity), max(math.ceil(least - 1e-6), 0)


def first_fit(sizes: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """First-fit decreasing on the histogram: one combination at a time, used as often as the counts allow."""
    left, order, out = left.copy(), np.argsort(-sizes, kind="stable"), []
    while left.any():
        room, config = capacity, {}
        for i in order[left[order] > 0]:
            n = min(int(left[i]), room // int(sizes[i]))
            if n:
                config[int(i)] = n
                room -= n * int(sizes[i])
        times = min(int(left[i]) // n for i, n in config.items())
        for i, n in config.items():
            left[i] -= n * times
        out.append((config, times))
    return out


def unit_of(capacity: int) -> int:
    return max(1, -(-capacity // UNITS))


def slots(classes: np.ndarray, counts: np.ndarray, room: int) -> tuple[np.ndarray, int]:
    """Sorted rows (size, first rank, first container, times) that place the r-th item of a size, and the dual bound."""
    used = np.zeros(len(classes), np.int64)
    rows: list[tuple[int, int, int, int]] = []
    container = 0
    plan, least = configurations(classes, counts, room)
    for config, times in plan:
        for i, n in config.items():
            for _ in range(n):
                rows.append((int(classes[i]), int(used[i]), container, times))
                used[i] += times
        container += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4), least


_PLACED = "window_id int, doc_id long, piece int, n_pieces int, tokens long, container string"
_SLOTS = "window_id int, kind long, first long, container long, times long, least long"


def _cut(items: DataFrame, windows: list[tuple[int, int]], id_col: str, size_col: str) -> DataFrame:
    """(window_id, capacity, doc_id, n, full, rest, kind): every record per window, its full pieces and the class of its rest."""
    sized = items.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(size_col), F.lit(0)).cast("long").alias("n"))
    sized = runtime.materialise(sized, "sizes")
    each = F.explode(F.array(*(F.struct(F.lit(int(w)).alias("window_id"), F.lit(int(c)).cast("long").alias("capacity"), F.lit(unit_of(c)).alias("unit")) for w, c in windows)))
    cut = sized.select("doc_id", "n", each.alias("w")).select("w.*", "doc_id", "n")
    rest = F.col("n") % F.col("capacity")
    kind = F.least(F.ceil(rest / F.col("unit")), F.floor(F.col("capacity") / F.col("unit"))).cast("int")
    return cut.select("window_id", "capacity", "doc_id", "n", F.floor(F.col("n") / F.col("capacity")).cast("int").alias("full"), rest.alias("rest"), kind.alias("kind"))


def _plan(cut: DataFrame) -> DataFrame:
    """(window_id, kind, first, container, times, least): the slots of every window, planned by one task each."""

    def solve(rows: pa.Table) -> pa.Table:
        capacity = rows.column("capacity")[0].as_py()
        kinds = rows.column("kind").to_numpy().astype(np.int64)
        order = np.argsort(kinds)
        table, least = slots(kinds[order], rows.column("count").to_numpy()[order], capacity // unit_of(capacity))
        names = ["kind", "first", "container", "times"]
        return pa.table({"window_id": pa.array(np.full(len(table), rows.column("window_id")[0].as_py(), np.int32))} | {n: table[:, k] for k, n in enumerate(names)} | {"least": np.full(len(table), least, np.int64)})

    histogram = cut.filter("rest > 0").groupBy("window_id", "capacity", "kind").count()
    # A fixed number of partitions, so that windows are not put together into one task.
    return histogram.repartition(PLAN_TASKS, "window_id").groupBy("window_id").applyInArrow(solve, _SLOTS)


def pack(items: DataFrame, windows: list[tuple[int, int]], id_col: str = "doc_id", size_col: str = "n_tokens") -> DataFrame:
    """(window_id, doc_id, piece, n_pieces, tokens, container): where each piece of each record goes, per window.

    ``windows`` lists (window_id, capacity).  ``container`` is 'p<n>' for packed containers and
    'f<doc_id>.<piece>' for those that one piece fills alone.
    """
    windows = [(w, c) for w, c in windows if c is not None and c > 0]
    spark = items.sparkSession
    if not windows:
        return spark.createDataFrame([], _PLACED)
    cut = _cut(items, windows, id_col, size_col)
    # The plan's size is bounded by the capacities, not by the records.
    plan: dict[int, np.ndarray] = {}
    for row in _plan(cut).select("window_id", "kind", "first", "container", "times").collect():
        plan.setdefault(row[0], []).append(row[1:])
    sent = spark.sparkContext.broadcast({w: np.array(sorted(rows), np.int64) for w, rows in plan.items()})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            window, kind, rank = (batch.column(k).to_numpy().astype(np.int64) for k in (0, 5, 6))
            which = np.zeros(len(window), np.int64)
            for w in np.unique(window).tolist():
                table, own = sent.value[w], window == w
                at = np.searchsorted(table[:, 0] << 40 | table[:, 1], kind[own] << 40 | rank[own], side="right") - 1
                which[own] = table[at, 2] + rank[own] - table[at, 1]
            names = pa.array([f"p{x}" for x in which.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(5)), names], names=["window_id", "doc_id", "piece", "n_pieces", "tokens", "container"])

    # Ranks within a size: numbered inside salted blocks, shifted by the blocks before.
    salts = max(SALTS, math.ceil(cut.count() / BLOCK_ROWS))
    pieces = (F.col("full") + (F.col("rest") > 0).cast("int")).alias("n_pieces")
    rests = cut.filter("rest > 0").select("window_id", "doc_id", F.col("full").alias("piece"), pieces, F.col("rest").alias("tokens"), "kind", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"))
    blocks = rests.groupBy("window_id", "kind", "salt").agg(F.count("*").alias("c"))
    blocks = blocks.select("window_id", "kind", "salt", (F.sum("c").over(Window.partitionBy("window_id", "kind").orderBy("salt")) - F.col("c")).alias("shift"))
    ranked = rests.withColumn("rn", F.row_number().over(Window.partitionBy("window_id", "kind", "salt").orderBy("doc_id"))).join(blocks, ["window_id", "kind", "salt"])
    packed = ranked.select("window_id", "doc_id", "piece", "n_pieces", "tokens", "kind", (F.col("shift") + F.col("rn") - 1).alias("rank")).mapInArrow(place, _PLACED)
    alone = (
        cut.filter("full > 0")
        .select("window_id", "doc_id", F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("piece"), pieces, F.col("capacity").alias("tokens"))
        .withColumn("container", F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit("."), F.col("piece").cast("string")))
    )
    none = cut.filter("n <= 0").select("window_id", "doc_id", F.lit(0).alias("piece"), F.lit(0).alias("n_pieces"), F.lit(0).cast("long").alias("tokens"), F.lit(None).cast("string").alias("container"))
    return packed.unionByName(alone).unionByName(none)


def least_containers(items: DataFrame, windows: list[tuple[int, int]], id_col: str = "doc_id", size_col: str = "n_tokens") -> DataFrame:
    """(window_id, least): containers that no packing of the rests can do without, by the dual of the configuration LP
    (in whole units), plus those that one piece fills alone."""
    windows = [(w, c) for w, c in windows if c is not None and c > 0]
    if not windows:
        return items.sparkSession.createDataFrame([], "window_id int, least long")
    cut = _cut(items, windows, id_col, size_col)
    planned = _plan(cut).groupBy("window_id").agg(F.max("least").alias("rests"))
    alone = cut.groupBy("window_id").agg(F.sum("full").alias("alone"))
    return alone.join(planned, "window_id", "left").select("window_id", (F.col("alone") + F.coalesce("rests", F.lit(0))).alias("least"))


def window_list(windows: DataFrame) -> list[tuple[int, int]]:
    """The table ``windows`` (window_id, capacity_tokens) lists the containers on offer; it is read on the driver row by row."""
    return [(r["window_id"], r["capacity_tokens"]) for r in windows.select("window_id", "capacity_tokens").distinct().orderBy("window_id").toLocalIterator()]


def document_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "content") -> DataFrame:
    """(doc_id, n_tokens) by the project's token counter."""
    runtime.text_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), tokens.token_counts(F.col(text_col)).alias("n_tokens"))


def pack_documents(docs: DataFrame, windows: DataFrame, id_col: str = "doc_id", text_col: str = "content") -> DataFrame:
    """Packs the texts into every window of the table ``windows``."""
    return pack(document_sizes(docs, id_col, text_col), window_list(windows))


def container_report(packed: DataFrame) -> DataFrame:
    """(window_id, container, n_pieces, tokens): what every container holds."""
    return packed.filter("container is not null").groupBy("window_id", "container").agg(F.count("*").alias("n_pieces"), F.sum("tokens").alias("tokens"))


def fill_report(packed: DataFrame) -> DataFrame:
    """(window_id, n_containers, n_tokens, n_split): per window; unused room is n_containers * capacity - n_tokens."""
    held = container_report(packed).groupBy("window_id").agg(F.count("*").alias("n_containers"), F.sum("tokens").alias("n_tokens"))
    split = packed.groupBy("window_id").agg(F.sum(((F.col("n_pieces") > 1) & (F.col("piece") == 0)).cast("long")).alias("n_split"))
    return split.join(held, "window_id", "left").select("window_id", F.coalesce("n_containers", F.lit(0)).alias("n_containers"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), "n_split")


def fill_check(packed: DataFrame, windows: list[tuple[int, int]], slack: float = 0.01) -> DataFrame:
    """(window_id, n_tokens, n_split, n_overfull, near_volume): ``near_volume`` tells that no more than ``slack`` (and one)
    containers above the volume bound are used."""
    capacity = packed.sparkSession.createDataFrame([(int(w), int(c)) for w, c in windows if c and c > 0], "window_id int, capacity long")
    over = container_report(packed).join(F.broadcast(capacity), "window_id").groupBy("window_id").agg(F.sum((F.col("tokens") > F.col("capacity")).cast("long")).alias("n_overfull"))
    whole = fill_report(packed).join(F.broadcast(capacity), "window_id").join(over, "window_id", "left")
    near = F.col("n_containers") <= (1 + slack) * F.ceil(F.col("n_tokens") / F.col("capacity")) + 1
    return whole.select("window_id", "n_tokens", "n_split", F.coalesce("n_overfull", F.lit(0)).alias("n_overfull"), near.alias("near_volume"))
