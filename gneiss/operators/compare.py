"""Comparison of retrievers on cases with gold files, symbols and chunks.

A case is (query_id, gold_files, gold_symbols, gold_chunks), a chunk (chunk_id, path, primary_symbols), a ranked row (retriever,
query_id, chunk_id, rank).  All that a case expects becomes rows (query_id, kind, target, chunk_id): the chunks that show
a target.  Everything else is joins and aggregates of these with the ranked rows.

Defined results: null gold lists are empty; null ids are left out; a chunk counts once per retriever and case; cases without
any relevant chunk have all metrics 0; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gneiss.operators import java

FAMILIES = ["hit", "recall", "mrr", "precision", "ndcg", "chunk_recall", "file_hit", "file_recall", "symbol_hit", "symbol_recall", "direct_chunk_recall", "target_recall"]
#: Distinct gold symbols that are compared with every chunk.
MOST_SYMBOLS = 100_000


def top_k_list(values: Iterable[int] | None) -> list[int]:
    """Positive distinct cut-offs in order; 5 and 10 without any."""
    return sorted({int(v) for v in values or [] if int(v) > 0}) or [5, 10]


def eligible(cases: DataFrame, commit: str, include_mismatches: bool = False) -> tuple[DataFrame, DataFrame]:
    """The cases of the commit, and those left out as (query_id, repo_sha, reason); a case without a commit always counts."""
    off = F.lit(False) if include_mismatches or not commit else F.coalesce((F.col("repo_sha") != "") & (F.col("repo_sha") != commit), F.lit(False))
    return cases.filter(~off), cases.filter(off).select("query_id", "repo_sha", F.lit("commit_mismatch").alias("reason"))


def normal_path(path: Column | str) -> Column:
    """A path with forward slashes, without leading './' and '/'."""
    p = F.col(path) if isinstance(path, str) else path
    return F.regexp_replace(F.regexp_replace(F.trim(p), r"\\", "/"), r"^(\./|/)+", "")


def path_suffixes(path: Column | str) -> Column:
    """All trailing parts of a path: 'a/b/c', 'b/c', 'c'."""
    parts = F.split(normal_path(path), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def match_paths(expected: DataFrame, paths: DataFrame, path_col: str = "path") -> DataFrame:
    """``expected`` (..., target) joined to the rows of ``paths`` whose path is the target or ends with '/' and the target.

    Suffixes of paths meet targets in one equi-join.
    """
    suffixes = paths.withColumn("_suffix", F.explode(path_suffixes(path_col)))
    return expected.withColumn("_suffix", normal_path("target")).filter("_suffix <> ''").join(suffixes, "_suffix").drop("_suffix")


def targets(cases: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, kind, target, chunk_id): chunks that show each gold file, symbol or chunk; null where none does."""
    gold = reduce(DataFrame.unionByName, (cases.select("query_id", F.lit(kind).alias("kind"), F.explode(F.array_distinct(column)).alias("target")) for kind, column in (("file", "gold_files"), ("symbol", "gold_symbols"), ("chunk", "gold_chunks"))))
    gold = gold.filter("trim(target) <> ''").distinct()
    files = match_paths(gold.filter("kind = 'file'"), chunks.select("chunk_id", "path")).select("query_id", "kind", "target", "chunk_id")
    symbols = gold.filter("kind = 'symbol'").select("target").distinct()
    if symbols.limit(MOST_SYMBOLS + 1).count() > MOST_SYMBOLS:
        raise ValueError(f"more than {MOST_SYMBOLS} distinct gold symbols")
    held = chunks.select("chunk_id", "primary_symbols").join(F.broadcast(symbols), java.symbol_matches("chunk_id", "primary_symbols", "target")).select("target", "chunk_id")
    named = gold.filter("kind = 'symbol'").join(held, "target").select("query_id", "kind", "target", "chunk_id")
    direct = gold.filter("kind = 'chunk'").select("query_id", "kind", "target", F.col("target").alias("chunk_id"))
    shown = files.unionByName(named).unionByName(direct).distinct()
    return gold.join(shown, ["query_id", "kind", "target"], "left").select("query_id", "kind", "target", "chunk_id")


def annotate(ranked: DataFrame, expected: DataFrame) -> DataFrame:
    """Ranked rows with ``is_relevant`` and the distinct gold files, symbols and chunks that each shows."""
    shown = expected.filter("chunk_id is not null").groupBy("query_id", "chunk_id").agg(*(F.sort_array(F.collect_set(F.when(F.col("kind") == kind, F.col("target")))).alias(f"matched_{kind}s") for kind in ("file", "symbol", "chunk")))
    none = F.array().cast("array<string>")
    met = ranked.join(shown.withColumn("is_relevant", F.lit(True)), ["query_id", "chunk_id"], "left")
    return met.select(*ranked.columns, F.coalesce("is_relevant", F.lit(False)).alias("is_relevant"), *(F.coalesce(c, none).alias(c) for c in ("matched_files", "matched_symbols", "matched_chunks")))


def _share(x: str, y: str) -> Column:
    return F.when(F.col(y) > 0, F.col(x) / F.col(y)).otherwise(0.0)


def _sizes(cases: DataFrame, expected: DataFrame) -> DataFrame:
    """(query_id, n_files, n_symbols, n_chunks, n_relevant) of every case."""
    n = expected.groupBy("query_id").agg(*(F.count_distinct(F.when(F.col("kind") == kind, F.col("target"))).alias(f"n_{kind}s") for kind in ("file", "symbol", "chunk")), F.count_distinct("chunk_id").alias("n_relevant"))
    return cases.select("query_id").distinct().join(n, "query_id", "left").na.fill(0)


def _families(joined: DataFrame) -> DataFrame:
    """The twelve families from the counts of one row per retriever, case and cut-off."""
    k = F.col("k")
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least("n_relevant", k).cast("int"))), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    hit = (F.col("seen") > 0).cast("double")
    file, symbol, direct = _share("files", "n_files"), _share("symbols", "n_symbols"), _share("chunks", "n_chunks")
    active = sum((F.col(n) > 0).cast("int") for n in ("n_files", "n_symbols", "n_chunks"))
    target = F.when(active > 0, (file + symbol + direct) / active).otherwise(0.0)
    values = {
        "hit": hit, "recall": hit, "mrr": F.coalesce(1.0 / F.col("first"), F.lit(0.0)), "precision": F.col("relevant_rows") / F.col("returned"), "ndcg": F.when(F.col("n_relevant") > 0, F.col("dcg") / ideal).otherwise(0.0),
        "chunk_recall": _share("seen", "n_relevant"), "file_hit": (F.col("files") > 0).cast("double"), "file_recall": file, "symbol_hit": (F.col("symbols") > 0).cast("double"), "symbol_recall": symbol,
        "direct_chunk_recall": direct, "target_recall": target,
    }
    return joined.select("retriever", "query_id", "k", *(F.round(values[name], 6).alias(name) for name in FAMILIES))


def metrics(ranked: DataFrame, cases: DataFrame, expected: DataFrame, top_ks: list[int]) -> DataFrame:
    """(retriever, query_id, k, twelve families): every case has a row for every retriever that ranked anything at all."""
    rows = annotate(ranked, expected).withColumn("k", F.explode(F.array(*(F.lit(k) for k in top_ks)))).filter(F.col("rank") <= F.col("k"))
    relevant = F.col("is_relevant")
    found = rows.groupBy("retriever", "query_id", "k").agg(
        F.count_distinct(F.when(relevant, F.col("chunk_id"))).alias("seen"), F.sum(relevant.cast("int")).alias("relevant_rows"), F.min(F.when(relevant, F.col("rank"))).alias("first"),
        F.sum(F.when(relevant, 1.0 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"), *(F.size(F.array_distinct(F.flatten(F.collect_list(f"matched_{x}")))).alias(x) for x in ("files", "symbols", "chunks")),
    )
    grid = ranked.select("retriever").distinct().crossJoin(_sizes(cases, expected)).withColumn("k", F.explode(F.array(*(F.lit(k) for k in top_ks)))).withColumn("returned", F.col("k"))
    return _families(grid.join(found, ["retriever", "query_id", "k"], "left").na.fill(0, ["seen", "relevant_rows", "dcg", "files", "symbols", "chunks"]))


def union_metrics(ranked: DataFrame, cases: DataFrame, expected: DataFrame, top_ks: list[int], single: DataFrame) -> DataFrame:
    """The families for what all retrievers return together: coverage over the union, the precision among the distinct chunks
    returned, and of mrr and ndcg the best of ``single``, the retrievers' own metrics."""
    rows = annotate(ranked, expected).withColumn("k", F.explode(F.array(*(F.lit(k) for k in top_ks)))).filter(F.col("rank") <= F.col("k"))
    found = rows.groupBy("query_id", "k").agg(
        F.count_distinct(F.when(F.col("is_relevant"), F.col("chunk_id"))).alias("seen"), F.count_distinct("chunk_id").alias("returned"), *(F.size(F.array_distinct(F.flatten(F.collect_list(f"matched_{x}")))).alias(x) for x in ("files", "symbols", "chunks"))
    )
    best = single.groupBy("query_id", "k").agg(F.max("mrr").alias("best_mrr"), F.max("ndcg").alias("best_ndcg"))
    grid = _sizes(cases, expected).withColumn("k", F.explode(F.array(*(F.lit(k) for k in top_ks)))).withColumn("retriever", F.lit("union"))
    joined = grid.join(found, ["query_id", "k"], "left").na.fill(0, ["seen", "files", "symbols", "chunks"]).withColumn("returned", F.greatest(F.lit(1), F.coalesce("returned", F.lit(1))))
    whole = _families(joined.withColumn("relevant_rows", F.col("seen")).withColumn("first", F.lit(None).cast("int")).withColumn("dcg", F.lit(0.0)))
    return whole.drop("mrr", "ndcg").join(best.withColumnRenamed("best_mrr", "mrr").withColumnRenamed("best_ndcg", "ndcg"), ["query_id", "k"], "left").select("retriever", "query_id", "k", *(F.coalesce(x, F.lit(0.0)).alias(x) for x in FAMILIES))


def fused_rrf(dense: DataFrame, keyword: DataFrame, most: int, k: int = 60) -> DataFrame:
    """(query_id, chunk_id, rank): reciprocal ranks of both, summed; equal sums by id; the first ``most``."""
    scored = dense.select("query_id", "chunk_id", "rank").unionByName(keyword.select("query_id", "chunk_id", "rank")).groupBy("query_id", "chunk_id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))
    numbered = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "chunk_id")))
    return numbered.filter(F.col("rank") <= most).select("query_id", "chunk_id", "rank")


def fused_guarded(dense: DataFrame, keyword: DataFrame, paths: DataFrame, most: int) -> DataFrame:
    """(query_id, chunk_id, rank): the dense list with at most two keyword results of new files before its tail; where the
    dense list is empty, the keyword list.  ``paths`` is (chunk_id, path)."""
    inserts = min(2, max(0, most // 10))
    kept = dense.select("query_id", "chunk_id", "rank").filter(F.col("rank") <= 2 * most)
    words = keyword.select("query_id", "chunk_id", "rank").filter(F.col("rank") <= 2 * most)
    alone = words.join(kept.select("query_id").distinct(), "query_id", "left_anti").filter(F.col("rank") <= most)
    seen = kept.filter(F.col("rank") <= most).join(paths, "chunk_id").filter("path <> ''").select("query_id", "path").distinct()
    fresh = words.filter(F.col("rank") <= max(1, min(3, most // 3))).join(kept.select("query_id").distinct(), "query_id", "left_semi").join(kept.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    fresh = fresh.join(paths, "chunk_id", "left").join(seen, ["query_id", "path"], "left_anti")
    fresh = fresh.withColumn("i", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).filter(F.col("i") <= inserts).select("query_id", "chunk_id", "i")
    n = fresh.groupBy("query_id").agg(F.count("*").alias("n"))
    main = kept.join(n, "query_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    head = F.greatest(F.lit(1), F.lit(most) - F.col("n"))
    main = main.select("query_id", "chunk_id", F.when(F.col("rank") <= head, F.col("rank")).otherwise(F.col("rank") + F.col("n")).alias("at"))
    added = fresh.join(n, "query_id").select("query_id", "chunk_id", (head + F.col("i")).alias("at"))
    both = main.unionByName(added).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("at"))).filter(F.col("rank") <= most).select("query_id", "chunk_id", "rank")
    return both.unionByName(alone.select("query_id", "chunk_id", "rank"))


def outcomes(measured: DataFrame, ranked: DataFrame, cases: DataFrame, expected: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """(retriever, query_id, reason): why a case failed at the largest cut-off; '' where it did not.  ``errors`` lists
    (retriever, query_id) that broke off."""
    most = measured.agg(F.max("k")).first()[0]
    n = ranked.groupBy("retriever", "query_id").agg(F.count("*").alias("returned"))
    rows = measured.filter(F.col("k") == F.lit(most)).select("retriever", "query_id", "hit").join(n, ["retriever", "query_id"], "left").join(_sizes(cases, expected).select("query_id", "n_relevant"), "query_id")
    failed = F.lit(False)
    if errors is not None:
        rows = rows.join(errors.select("retriever", "query_id", F.lit(True).alias("error")).distinct(), ["retriever", "query_id"], "left")
        failed = F.coalesce("error", F.lit(False))
    reason = F.when(failed, "case_error").when(F.col("n_relevant") == 0, "empty_relevant").when(F.coalesce("returned", F.lit(0)) == 0, "no_results").when(F.col("hit") == 0, "no_relevant_hit").otherwise("")
    return rows.select("retriever", "query_id", reason.alias("reason"))


def compare_summary(measured: DataFrame, reasons: DataFrame) -> DataFrame:
    """(retriever, k, cases, empty_relevant, no_results, case_errors, twelve means)."""
    counts = reasons.groupBy("retriever").agg(*(F.sum((F.col("reason") == r).cast("long")).alias(n) for r, n in (("empty_relevant", "empty_relevant"), ("no_results", "no_results"), ("case_error", "case_errors"))))
    means = measured.groupBy("retriever", "k").agg(F.count("*").alias("cases"), *(F.round(F.avg(x), 6).alias(x) for x in FAMILIES))
    return means.join(counts, "retriever", "left").select("retriever", "k", "cases", "empty_relevant", "no_results", "case_errors", *FAMILIES)


def diagnostics(measured: DataFrame, ranked: DataFrame, expected: DataFrame, dense: str, keyword: str) -> DataFrame:
    """(query_id, dense_only_hit, keyword_only_hit, both_hit, missing_files, missing_symbols) at the largest cut-off."""
    most = measured.agg(F.max("k")).first()[0]
    hits = measured.filter(F.col("k") == F.lit(most)).groupBy("query_id").agg(*(F.max(F.when(F.col("retriever") == r, F.col("hit"))).alias(n) for r, n in ((dense, "d"), (keyword, "w"))))
    seen = ranked.filter(F.col("rank") <= F.lit(most)).select("query_id", "chunk_id").distinct()
    shown = expected.join(seen, ["query_id", "chunk_id"]).select("query_id", "kind", "target").distinct()
    lost = expected.select("query_id", "kind", "target").distinct().join(shown, ["query_id", "kind", "target"], "left_anti")
    lost = lost.groupBy("query_id").agg(*(F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.col("target")))).alias(f"missing_{kind}s") for kind in ("file", "symbol")))
    d, w, none = F.coalesce("d", F.lit(0.0)) > 0, F.coalesce("w", F.lit(0.0)) > 0, F.array().cast("array<string>")
    return hits.join(lost, "query_id", "left").select("query_id", (d & ~w).alias("dense_only_hit"), (w & ~d).alias("keyword_only_hit"), (d & w).alias("both_hit"), F.coalesce("missing_files", none).alias("missing_files"), F.coalesce("missing_symbols", none).alias("missing_symbols"))


def expected_units(chunks: Column, symbols: Column, files: Column) -> tuple[Column, Column]:
    """(kind, units): the first non-empty of chunks, symbols and files; 'none' without any."""
    filled = [(n, F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(x) != "")) for n, c in (("chunks", chunks), ("symbols", symbols), ("files", files))]
    kind, units = F.lit("none"), F.array().cast("array<string>")
    for name, column in reversed(filled):
        kind, units = F.when(F.size(column) > 0, name).otherwise(kind), F.when(F.size(column) > 0, column).otherwise(units)
    return kind, units


def unit_metrics(matches: DataFrame, sizes: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, success, recall, mrr, ndcg, reason) where a unit counts at its first rank only.

    ``matches`` is (query_id, rank, unit), a null unit for a result that matches nothing; ``sizes`` (query_id, n) has the number
    of expected units.  The reciprocal rank is that of the first result that matches anything; gains are cut at ten.
    """
    top = matches.filter(F.col("rank") <= k)
    first = top.filter("unit is not null").groupBy("query_id", "unit").agg(F.min("rank").alias("rank"))
    gains = first.select("query_id", "rank").distinct().groupBy("query_id").agg(F.sum(F.when(F.col("rank") <= 10, 1.0 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"))
    found = first.groupBy("query_id").agg(F.count("*").alias("matched"), F.min("rank").alias("first"))
    returned = matches.groupBy("query_id").agg(F.count("*").alias("returned"))
    j = sizes.join(found, "query_id", "left").join(gains, "query_id", "left").join(returned, "query_id", "left").withColumn("matched", F.coalesce("matched", F.lit(0)))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least("n", F.lit(min(k, 10))).cast("int"))), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    some = F.col("n") > 0
    reason = F.when(~some, "empty_expected").when(F.coalesce("returned", F.lit(0)) == 0, "no_results").when(F.col("matched") == 0, "no_relevant_hit").otherwise("")
    value = lambda x: F.round(F.when(some, F.coalesce(x, F.lit(0.0))).otherwise(0.0), 6)
    return j.select("query_id", value((F.col("matched") > 0).cast("double")).alias("success"), value(F.col("matched") / F.greatest(F.lit(1), "n")).alias("recall"), value(1.0 / F.col("first")).alias("mrr"), value(F.col("dcg") / ideal).alias("ndcg"), reason.alias("reason"))
