"""Evaluation jobs: workloads, estimate quality, method comparison, telemetry roll-up."""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellsieve.operators.histogram import PREDICATE_STRUCT, Histogram2D
from cellsieve.operators.ivf import IvfIndex
from cellsieve.operators.predicates import Predicate, text_of, workload_survivors
from cellsieve.plans.hybrid import METHODS, filtered_search

Workload = Mapping[int, list[Predicate]]

# Result sizes of the evaluation sweep and the timed sections.
K_VALUES = (5, 10, 50, 100, 200, 500, 1000, 2500, 5000, 6000, 7000, 10000)
MEASURED_SECTIONS = ("DB_SEARCH", "HISTO_FILTER", "FAISS_SEARCH", "UD_PARAMS", "INTERSECT", "FINALIZE")
SEARCH_SECTION = "FAISS_SEARCH"
TOTAL_SECTION = "TOTAL"


def workload_frame(spark, workload: Workload, kind: str) -> DataFrame:
    """(wid, kind, predicates text, preds array) of a workload given as predicate lists."""
    rows = [
        (wid, kind, text_of(predicates), [(p.key, p.operator, p.numbers()) for p in predicates])
        for wid, predicates in sorted(workload.items())
    ]
    schema = f"wid int, kind string, predicates string, preds array<{PREDICATE_STRUCT}>"
    return spark.createDataFrame(rows, schema)


def workload_grid(workload: DataFrame, ks: Sequence[int], methods: Sequence[str]) -> DataFrame:
    """Every workload entry for every k and method; an explode, not a join."""
    return workload.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).withColumn(
        "method", F.explode(F.array(*[F.lit(m) for m in methods]))
    )


def estimate_workload(workload: DataFrame, histogram: Histogram2D) -> DataFrame:
    """Add `est` to a workload with `preds`; row-local, no shuffle."""
    return workload.withColumn("est", histogram.estimate_column("preds"))


def estimates_and_actuals(items: DataFrame, workload: DataFrame, lists: Workload, histogram: Histogram2D) -> DataFrame:
    """Estimated and true survivors per workload entry with their errors."""
    actual = workload_survivors(items, lists)
    error = F.col("est") - F.col("actual")
    return (
        estimate_workload(workload, histogram)
        .join(actual.withColumnRenamed("survivors", "actual"), "wid")
        .select(
            "wid",
            "predicates",
            "est",
            "actual",
            error.alias("error"),
            F.when(F.col("actual") > 0, F.abs(error) / F.col("actual")).alias("relative_error"),
        )
    )


def sweep(
    index: IvfIndex,
    queries: DataFrame,
    lists: Workload,
    ks: Sequence[int],
    methods: Sequence[str] = METHODS,
    histogram: Histogram2D | None = None,
    items: DataFrame | None = None,
) -> DataFrame:
    """Search with every predicate list, k and method: (wid, k, method, found, full_queries), where found
    counts result rows of all queries and full_queries those queries that got k rows."""
    parts = [
        filtered_search(index, queries, predicates, k, method, histogram, items)
        .agg(
            F.count(F.lit(1)).alias("found"),
            F.count_if(F.col("is_k") & (F.col("rank") == 1)).alias("full_queries"),
        )
        .select(F.lit(wid).alias("wid"), F.lit(k).alias("k"), F.lit(method).alias("method"), "found", "full_queries")
        for wid, predicates in lists.items()
        for k in ks
        for method in methods
    ]
    return functools.reduce(DataFrame.unionByName, parts)


def recall_at_k(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of each query's exact top-k that the approximate result holds."""
    wanted = exact.groupBy("qid").agg(F.count(F.lit(1)).alias("wanted"))
    hits = (
        approximate.select("qid", "item_id")
        .join(exact.select("qid", "item_id"), ["qid", "item_id"])
        .groupBy("qid")
        .agg(F.count(F.lit(1)).alias("hits"))
    )
    return wanted.join(hits, "qid", "left").select(
        "qid", (F.coalesce("hits", F.lit(0)) / F.col("wanted")).alias("recall")
    )


def compare_methods(results: Mapping[str, DataFrame]) -> DataFrame:
    """Per method pair and query: sizes and overlap of the id sets.

    One grouping by (qid, item_id) tells which methods found a row; no pair of result sets is joined.
    """
    names = list(results)
    tagged = functools.reduce(
        DataFrame.unionByName,
        [df.select("qid", "item_id", F.lit(name).alias("method")) for name, df in results.items()],
    )
    found = tagged.groupBy("qid", "item_id").agg(
        *[F.max((F.col("method") == n).cast("int")).alias(n) for n in names]
    )
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    both = found.groupBy("qid").agg(
        *[F.sum(n).alias(f"n_{n}") for n in names],
        *[F.sum(F.col(a) * F.col(b)).alias(f"{a}__{b}") for a, b in pairs],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(a).alias("method_a"),
                F.lit(b).alias("method_b"),
                F.col(f"n_{a}").alias("found_a"),
                F.col(f"n_{b}").alias("found_b"),
                F.col(f"{a}__{b}").alias("overlap"),
            )
            for a, b in pairs
        ]
    )
    return both.select("qid", F.explode(rows).alias("r")).select("qid", "r.*")


ORDER_SCHEMA = "qid bigint, method_a string, method_b string, found_a bigint, found_b bigint, overlap bigint, first_difference int, inversions bigint"


def compare_orders(results: Mapping[str, DataFrame], queries: DataFrame) -> DataFrame:
    """Per method pair and query (ORDER_SCHEMA): sizes and overlap of the results, the first rank at which they hold
    different items or only one holds any (null if there is none), and how many pairs of common items they put in
    opposite order. Queries that no method answered have a row of zeros."""
    names = list(results)
    tagged = [df.select("qid", "item_id", "rank", F.lit(n).alias("method")) for n, df in enumerate(results.values())]
    nothing = queries.select("qid", F.lit(None).cast("bigint").alias("item_id"), F.lit(0).alias("rank"), F.lit(-1).alias("method"))
    every = functools.reduce(DataFrame.unionByName, [*tagged, nothing]).select(
        "qid", "item_id", F.col("rank").cast("int").alias("rank"), "method"
    )

    def compare(table: pa.Table) -> pa.Table:
        method, rank, item = (table.column(c).to_numpy() for c in ("method", "rank", "item_id"))
        lists = []
        for n in range(len(names)):
            own = np.flatnonzero(method == n)
            lists.append(item[own[np.argsort(rank[own])]].astype(np.int64))
        rows = []
        for a in range(len(names)):
            for b in range(a + 1, len(names)):
                x, y = lists[a], lists[b]
                common, _, at = np.intersect1d(x, y, return_indices=True)
                place = dict(zip(common.tolist(), at.tolist()))
                order = [place[i] for i in x.tolist() if i in place]
                short = min(len(x), len(y))
                off = np.flatnonzero(x[:short] != y[:short])
                first = int(off[0]) + 1 if len(off) else short + 1 if len(x) != len(y) else None
                rows.append((names[a], names[b], len(x), len(y), len(common), first, inversions(order)))
        columns = list(zip(*rows)) or [()] * 7
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
        head = pa.array([table.column("qid")[0].as_py()] * len(rows), pa.int64())
        fields = ["qid", "method_a", "method_b", "found_a", "found_b", "overlap", "first_difference", "inversions"]
        return pa.table([head, *(pa.array(c, k) for c, k in zip(columns, kinds))], fields)

    return every.groupBy("qid").applyInArrow(compare, ORDER_SCHEMA)


def inversions(order: Sequence[int]) -> int:
    """How many pairs stand in falling order, by merging sorted runs."""
    values, count, width = np.asarray(order, np.int64), 0, 1
    while width < len(values):
        for at in range(0, len(values), 2 * width):
            left, right = values[at : at + width], values[at + width : at + 2 * width]
            count += int((len(left) - np.searchsorted(left, right, side="right")).sum())
            values[at : at + 2 * width] = np.sort(values[at : at + 2 * width])
        width *= 2
    return count


# --------------------------------------------------------------------------------------------------- telemetry


def _time_of(*sections: str) -> Column:
    return F.sum(F.when(F.col("section").isin(*sections), F.col("ms")).otherwise(0.0))


def telemetry_rollup(telemetry: DataFrame, keys: Sequence[str] = ("method",)) -> DataFrame:
    """Averages over runs from rows (keys, run_id, section, ms), per method unless more keys are given.

    The residual is what the total leaves unexplained, never negative. Runs of one group should take the
    same number of search rounds; `iterations_consistent` says whether they did.
    """
    per_run = telemetry.groupBy(*keys, "run_id").agg(
        F.count_if(F.col("section") == SEARCH_SECTION).alias("iterations"),
        _time_of(TOTAL_SECTION).alias("total"),
        *[_time_of(s).alias(s.lower()) for s in MEASURED_SECTIONS],
    )
    names = [s.lower() for s in MEASURED_SECTIONS]
    summed = per_run.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_runs"),
        F.min("iterations").alias("iterations"),
        (F.min("iterations") == F.max("iterations")).alias("iterations_consistent"),
        *[F.sum(n).alias(n) for n in ("total", *names)],
    )
    measured = functools.reduce(lambda a, b: a + b, [F.col(n) for n in names])
    residual = F.greatest(F.lit(0.0), F.col("total") - measured)
    return summed.withColumn("residual", residual).select(
        *[F.regexp_replace(k, "_SEARCH", "").alias(k) if k == "method" else F.col(k) for k in keys],
        "num_runs",
        "iterations",
        "iterations_consistent",
        *[(F.col(n) / F.col("num_runs")).alias(n) for n in ("total", *names, "residual")],
    )


def telemetry_frame(telemetry: DataFrame, workload: DataFrame, survivors: DataFrame) -> DataFrame:
    """One row per method, predicate list and k: averages over runs (method, wid, k, run_id, section, ms), with the
    list's text (wid, predicates) and its number of surviving items (wid, survivors)."""
    rolled = telemetry_rollup(telemetry, ("method", "wid", "k"))
    return rolled.join(workload.select("wid", "predicates"), "wid").join(survivors, "wid")
