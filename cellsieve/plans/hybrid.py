"""Filtered vector search: filter before or after the vector search, with fixed or adaptive probe sizes.

All methods take queries (qid bigint, qvec array) and return (qid, rank, item_id, similarity, is_k), every
query of the batch in the same plan.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellsieve import limits
from cellsieve.operators.histogram import Histogram2D
from cellsieve.operators.ivf import IvfIndex
from cellsieve.operators.predicates import Predicate, predicate_filter, with_passes
from cellsieve.operators.scoring import best_per_query, global_positions, rank_per_query, scan_tasks, unit_queries
from cellsieve.operators.tiered import EVERY_ROW, Pool, Tier, TieredBlock, answer_pools, block_of, needed_tiers, query_bytes, tiered_pools
from cellsieve.plans import probing
from cellsieve.session import cut

BASE_PRE, ADAP_PRE, BASE_POS, ADAP_POS = METHODS = (
    "base_pre_search",
    "adap_pre_search",
    "base_pos_search",
    "adap_pos_search",
)
PROBE_COLUMNS = ("qid", "qvec", "cells", "cell_sims")
RESULT_COLUMNS = ("qid", "rank", "item_id", "similarity", "is_k")


def _covered(index: IvfIndex, predicates: list[Predicate], items: DataFrame | None) -> bool:
    covered = all(p.key in index.vectors.columns for p in predicates)
    if not covered and items is None:
        raise ValueError("the index lacks a tested column: pass the item table")
    return covered


def restrict(index: IvfIndex, predicates: list[Predicate], items: DataFrame | None = None) -> DataFrame:
    """Vectors whose metadata pass. Where the index carries the tested columns this is a filter on its scan;
    otherwise the passing ids of `items` restrict it by semi join."""
    if _covered(index, predicates, items):
        return predicate_filter(index.vectors, predicates)
    allowed = predicate_filter(items, predicates).select("item_id")
    return index.vectors.join(allowed, "item_id", "left_semi")


def flagged(index: IvfIndex, predicates: list[Predicate], items: DataFrame | None = None) -> DataFrame:
    """All vectors, with `passes` telling whether their metadata pass."""
    if _covered(index, predicates, items):
        return with_passes(index.vectors, predicates)
    allowed = predicate_filter(items, predicates).select("item_id", F.lit(True).alias("passes"))
    return index.vectors.join(allowed, "item_id", "left")


def _finish(best: DataFrame, k: int) -> DataFrame:
    found = F.count(F.lit(1)).over(Window.partitionBy("qid"))
    return best.withColumn("is_k", found == k).select(*RESULT_COLUMNS)


# ------------------------------------------------------------------------------------------- filter, then search


def pre_filter_probes(
    index: IvfIndex, queries: DataFrame, survivors: DataFrame, k: int, adaptive: bool
) -> DataFrame:
    """Queries with their cells cut to the first probe width that holds min(k, survivors) survivors.

    A restricted search of width p finds what the p nearest cells hold, so counting survivors per cell
    settles the whole widening loop before a single vector is scored. Queries without survivors drop out.
    """
    nlist = index.nlist
    per_cell = survivors.groupBy("cell_id").agg(F.count(F.lit(1)).alias("n"))
    # The rule runs beside the search for the nearest cells, so only the cells that are probed leave a task.
    probes = index.probe(queries, nlist, per_cell, probing.settled_width(nlist, k, adaptive))
    return probes.filter(F.size("cells") > 0).select(*PROBE_COLUMNS, F.size("cells").alias("nprobe"))


def pre_filter_search(
    index: IvfIndex,
    queries: DataFrame,
    predicates: Iterable[Predicate],
    k: int,
    adaptive: bool = False,
    items: DataFrame | None = None,
    scoring: str = "exact",
) -> DataFrame:
    """Filter first, then search only the survivors, at the first sufficient probe width."""
    survivors = restrict(index, list(predicates), items)
    probes = cut(pre_filter_probes(index, cut(unit_queries(queries)), survivors, k, adaptive))
    best = best_per_query(
        survivors, probes.drop("nprobe"), k, index.scores(scoring), dim=index.dim, width=index.nlist
    )
    return _finish(best, k)


# ------------------------------------------------------------------------------------------- search, then filter

# Candidate lists up to this length are ranked row by row; longer ones are only counted.
RANKED_CANDIDATES = 10_000
ROUND_SCHEMA = "qid bigint, rank int, item_id bigint, similarity double, search_k bigint, nprobe bigint"


def post_filter_search(
    index: IvfIndex,
    queries: DataFrame,
    predicates: Iterable[Predicate],
    k: int,
    histogram: Histogram2D | None = None,
    items: DataFrame | None = None,
    scoring: str = "exact",
    ranked: int | None = None,
) -> DataFrame:
    """Search unrestricted, then filter the candidates, widening for the queries that still miss results.

    With a histogram the sizes follow its survivor estimate, else they start fixed and triple. One scan keeps the
    candidates of all rounds of up to `ranked` candidates, and the rounds are walked through where a query's candidates
    meet. Once a query probes all cells its answer is the best k passing rows whatever the length of the candidate list,
    so the filter moves below the search and the rounds end for it: a second scan for these queries alone. Rounds of more
    candidates, and batches beyond the block bound, are searched round by round and counted.
    """
    predicates = list(predicates)
    scores, nlist, total = index.scores(scoring), index.nlist, index.total
    most = RANKED_CANDIDATES if ranked is None else ranked
    est = None
    if histogram is not None:
        est = histogram.estimate([p for p in predicates if p.key != "item_id"])
    rule = probing.PostRule(k, est, nlist, total)
    tiers = rule.tiers(most)
    restricted = functools.partial(restrict, index, predicates, items)
    unit = unit_queries(queries)
    if rule.sizes()[1] >= nlist:
        return _finish(_search_all_cells(index, restricted(), unit, k, scores), k)
    block = None
    if tiers:
        block, tiers = _block_of_rounds(index, unit, tiers, scores)
    if block is None:
        first = dict(zip(("search_k", "nprobe"), (F.lit(n).cast("bigint") for n in rule.sizes())))
        sized = cut(unit).withColumns(first)
        return _finish(_rounds(index, restricted(), flagged(index, predicates, items), sized, k, est, scores, most), k)
    state = _walked(index, flagged(index, predicates, items), block, rule, tiers, scores)
    answers = [state.filter("rank > 0").select(*RESULT_COLUMNS[:-1], F.lit(True).alias("is_k"))]
    heads = state.filter("rank <= 1").select("qid", "rank", "search_k", "nprobe").toArrow()
    # Queries whose probed cells hold no row at all have no candidates and no state.
    left = dict.fromkeys(set(block.qids.tolist()) - set(heads.column("qid").to_pylist()), rule.walk(*_nothing(), tiers).sizes)
    left |= {r["qid"]: (r["search_k"], r["nprobe"]) for r in heads.to_pylist() if r["rank"] == 0}
    if left:
        rows = [(q, block.vectors[i].tolist(), *left[q]) for i, q in enumerate(block.qids.tolist()) if q in left]
        wide = [r for r in rows if r[3] >= nlist]
        narrow = [r for r in rows if r[3] < nlist]
        frame = lambda some: queries.sparkSession.createDataFrame(some, "qid bigint, qvec array<double>, search_k bigint, nprobe bigint")
        more = [_search_all_cells(index, restricted(), frame(wide), k, scores)] if wide else []
        if narrow:
            more.append(_rounds(index, restricted(), flagged(index, predicates, items), cut(frame(narrow)), k, est, scores, most))
        columns = ("qid", "item_id", "similarity", "rank")
        answers.append(_finish(functools.reduce(DataFrame.unionByName, [m.select(*columns) for m in more]), k))
    return functools.reduce(DataFrame.unionByName, answers)


def _nothing():
    return np.zeros(0, np.int64), np.zeros(0, bool)


def _block_of_rounds(index: IvfIndex, unit: DataFrame, tiers: list[Tier], scores) -> tuple[TieredBlock | None, list[Tier]]:
    """The queries with the cells of their rounds, and the first rounds, as many as fit the block bound; None if not even
    one round does."""
    width = tiers[-1].outer

    def bound(some: list[Tier]) -> int:
        size = query_bytes(index.dim, width, {EVERY_ROW: needed_tiers(some)}) + scores.bytes_per_query
        return limits.rows_within(limits.QUERY_BLOCK_BYTES, size)

    head = index.probe(unit, width).limit(bound(tiers[:1]) + 1).toArrow()
    while tiers and head.num_rows > bound(tiers):
        tiers = tiers[:-1]
    return (block_of(head, [{EVERY_ROW: needed_tiers(tiers)}] * head.num_rows) if tiers else None), tiers


def _walked(index: IvfIndex, everything: DataFrame, block: TieredBlock, rule: probing.PostRule, tiers: list[Tier], scores) -> DataFrame:
    """ROUND_SCHEMA: the ranked answer of each query, or one row of rank 0 with the sizes of the round that is due."""
    bits = F.coalesce("passes", F.lit(False)).cast("int").cast("bigint")
    pools = tiered_pools(everything.withColumn("bits", bits), block, scores)
    qids = block.qids

    def answer(query: int, found: dict[int, Pool]) -> Iterable[pa.Table]:
        pool = found[EVERY_ROW]
        walk = rule.walk(pool.cell_rank, pool.bits > 0, tiers)
        hits = np.zeros(0, np.int64) if walk.hits is None else walk.hits
        n = max(1, len(hits))
        yield pa.table(
            {
                "qid": np.full(n, qids[query]),
                "rank": pa.array(np.arange(1, n + 1) if len(hits) else [0], pa.int32()),
                "item_id": pa.array(pool.item_id[hits] if len(hits) else [None], pa.int64()),
                "similarity": pa.array(pool.similarity[hits] if len(hits) else [None], pa.float64()),
                "search_k": np.full(n, walk.search_k),
                "nprobe": np.full(n, walk.nprobe),
            }
        )

    return cut(answer_pools(pools, block, answer, ROUND_SCHEMA, scan_tasks(index.vectors)))


def _rounds(index: IvfIndex, passing: DataFrame, everything: DataFrame, open_queries: DataFrame, k: int, est: int | None, scores, most: int) -> DataFrame:
    """(qid, item_id, similarity, rank) by one round after the other, from queries with the sizes of their first."""
    nlist, total = index.nlist, index.total
    answers = []
    while True:
        narrow = F.col("nprobe") < nlist
        todo = open_queries.agg(
            F.count_if(~narrow).alias("wide"),
            F.max(F.when(narrow, F.col("nprobe"))).alias("nprobe"),
            F.max(F.when(narrow, F.col("search_k"))).alias("search_k"),
        ).head()
        if todo["wide"]:
            answers.append(_search_all_cells(index, passing, open_queries.filter(~narrow), k, scores))
        if todo["nprobe"] is None:
            break
        sized = open_queries.filter(narrow)
        probes = index.probe(sized, "nprobe").select(*PROBE_COLUMNS)
        if todo["search_k"] <= most:
            kept = _ranked_round(everything, probes, sized, k, scores, index.dim, todo)
        else:
            kept = _counted_round(index.vectors, passing, probes, sized, k, scores, index.dim, todo)
        hits = kept.groupBy("qid").agg(F.collect_list(F.struct("item_id", "similarity", "rank")).alias("hits"))
        # At most k hits per query: one row per query carries its state and its answer so far.
        state = cut(sized.join(hits, "qid", "left")).withColumn(
            "found", F.coalesce(F.array_size("hits"), F.lit(0)).cast("bigint")
        )
        answers.append(state.filter(F.col("found") >= k).select("qid", F.inline("hits")))
        open_queries = state.filter(F.col("found") < k).withColumns(_next_sizes(k, est, nlist, total))
        open_queries = open_queries.drop("found", "hits")
    if not answers:
        answers = [_search_all_cells(index, passing, open_queries.limit(0), k, scores)]
    columns = ("qid", "item_id", "similarity", "rank")
    return functools.reduce(DataFrame.unionByName, [a.select(*columns) for a in answers])


def _next_sizes(k: int, est: int | None, nlist: int, total: int) -> dict[str, Column]:
    """Candidate list length and probe width of the next round."""
    if est is not None:
        estimate = F.lit(est).cast("bigint")
        search_k = probing.post_search_k(estimate, F.lit(k) - F.col("found"), F.col("search_k"), total)
        nprobe = probing.post_nprobe(estimate, search_k, F.lit(0).cast("bigint"), nlist)
    else:
        search_k = F.least(F.lit(total), F.col("search_k") * probing.GROWTH)
        nprobe = F.least(F.lit(nlist), F.col("nprobe") * probing.GROWTH)
    # A candidate list as long as the index means searching every cell.
    nprobe = F.when(search_k >= total, F.lit(nlist)).otherwise(nprobe).cast("bigint")
    return {"search_k": search_k.cast("bigint"), "nprobe": nprobe}


def _ranked_round(everything, probes, sized, k, scores, dim, todo) -> DataFrame:
    """Best search_k candidates per query with their pass flag, cut to the first k that pass."""
    candidates = best_per_query(
        everything, probes, todo["search_k"], scores, dim=dim, width=todo["nprobe"]
    )
    within = candidates.join(sized.select("qid", "search_k"), "qid").filter(
        F.col("passes") & (F.col("rank") <= F.col("search_k"))
    )
    return rank_per_query(within.select("qid", "item_id", "similarity"), k)


def _counted_round(vectors, passing, probes, sized, k, scores, dim, todo) -> DataFrame:
    """The same without the list: best k passing rows per query, and by counting how far down the full list
    each of them stands. Costs the same for a list of a million candidates as for one of a hundred."""
    best = cut(best_per_query(passing, probes, k, scores, dim=dim, width=todo["nprobe"]))
    placed = global_positions(vectors, probes, best, scores, k=k, dim=dim, width=todo["nprobe"])
    within = placed.join(sized.select("qid", "search_k"), "qid")
    return within.filter(F.col("position") <= F.col("search_k")).select("qid", "item_id", "similarity", "rank")


def _search_all_cells(index, passing, queries, k, scores) -> DataFrame:
    queries = queries.select("qid", "qvec")
    if scores.column == "code":
        # Scores from codes start from the similarity to the centroid, so they need the probe lists.
        queries = index.probe(queries, index.nlist)
    return best_per_query(passing, queries, k, scores, dim=index.dim, width=index.nlist)


# ------------------------------------------------------------------------------------------------------ dispatch


def filtered_search(
    index: IvfIndex,
    queries: DataFrame,
    predicates: Iterable[Predicate],
    k: int,
    method: str,
    histogram: Histogram2D | None = None,
    items: DataFrame | None = None,
    scoring: str = "exact",
) -> DataFrame:
    """One of the four methods by name."""
    predicates = list(predicates)
    if method in (BASE_PRE, ADAP_PRE):
        return pre_filter_search(index, queries, predicates, k, method == ADAP_PRE, items, scoring)
    if method == BASE_POS:
        return post_filter_search(index, queries, predicates, k, None, items, scoring)
    if method == ADAP_POS:
        if histogram is None:
            raise ValueError(f"{ADAP_POS} sizes its rounds with a histogram")
        return post_filter_search(index, queries, predicates, k, histogram, items, scoring)
    raise ValueError(f"invalid method: {method}; use one of {', '.join(METHODS)}")


def with_items(found: DataFrame, items: DataFrame) -> DataFrame:
    """Results with the display columns of their items.

    The ranked rows are settled first: while they name few items, the ids go to the scan of the item table
    as literals, where statistics and Bloom filters skip row groups; otherwise the tables are joined.
    """
    found = cut(found.select(*RESULT_COLUMNS))
    shown = items.select("item_id", "title", "revdate", "token_count")
    ids = [r["item_id"] for r in found.select("item_id").distinct().limit(limits.IN_LIST_LITERALS + 1).collect()]
    if 0 < len(ids) <= limits.IN_LIST_LITERALS:
        shown = shown.filter(f"item_id IN ({', '.join(map(str, sorted(ids)))})")
    return found.join(shown, "item_id").select(
        "qid", "rank", "item_id", "title", "revdate", "token_count", "similarity", "is_k"
    )
