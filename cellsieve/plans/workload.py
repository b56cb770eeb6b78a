"""A workload as a table: a batch whose entries have their own query, predicate list and k, in one scan of the vectors."""

from __future__ import annotations

import functools
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellsieve import limits
from cellsieve.operators.ivf import IvfIndex
from cellsieve.operators.predicates import Predicate, conditions
from cellsieve.operators.scoring import BEST_SCHEMA, BestPerQuery, ExactScores, matrix_of, rank_per_query
from cellsieve.functions.vectors import l2_normalize
from cellsieve.session import cut

# One bit of a bigint for each predicate list of a scan.
LISTS_PER_SCAN = 63


def workload_search(
    index: IvfIndex, entries: DataFrame, lists: Mapping[int, list[Predicate]], block_bytes: int | None = None
) -> DataFrame:
    """(eid, rank, item_id, similarity, is_k) of each entry (eid, qvec, wid, k): its k most similar items among those
    that pass predicate list `wid`.

    Every vector carries one bit per list; a task multiplies its rows with the entries of a list whose bit they have,
    and keeps the largest k of the batch per entry, cut to the entry's own k at the end. Entries are broadcast in
    blocks within `block_bytes` (QUERY_BLOCK_BYTES unless given), each block and each LISTS_PER_SCAN lists one scan.
    """
    entries = cut(entries.select("eid", l2_normalize("qvec").alias("qvec"), "wid", "k"))
    n, most = entries.agg(F.count(F.lit(1)), F.max("k")).head()
    limit = limits.QUERY_BLOCK_BYTES if block_bytes is None else block_bytes
    blocks = -(-n // limits.rows_within(limit, 8 * index.dim + 96 * (most or 1)))
    ids = sorted(lists)
    found = [
        _scan(index, entries, {w: lists[w] for w in ids[at : at + LISTS_PER_SCAN]}, most, block, blocks)
        for at in range(0, len(ids), LISTS_PER_SCAN)
        for block in range(blocks)
    ]
    if not found:
        return entries.select("eid", F.lit(0).alias("rank"), F.lit(0).cast("bigint").alias("item_id"), F.lit(0.0).alias("similarity"), F.lit(True).alias("is_k")).limit(0)
    ranked = rank_per_query(functools.reduce(DataFrame.unionByName, found), most)
    own = ranked.join(entries.select(F.col("eid").alias("qid"), "k"), "qid").filter(F.col("rank") <= F.col("k"))
    sizes = own.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    return own.join(sizes, "qid").select(
        F.col("qid").alias("eid"), "rank", "item_id", "similarity", (F.col("n") == F.col("k")).alias("is_k")
    )


def _scan(index: IvfIndex, entries: DataFrame, lists: Mapping[int, list[Predicate]], most: int, block: int, blocks: int) -> DataFrame:
    places = {w: bit for bit, w in enumerate(lists)}
    wanted = entries.filter(F.col("wid").isin(list(places)))
    if blocks > 1:
        wanted = wanted.filter(F.pmod(F.xxhash64("eid"), F.lit(blocks)) == block)
    rows = wanted.select("eid", "qvec", "wid").toArrow()
    of_list: dict[int, list[int]] = {}
    for n, w in enumerate(rows.column("wid").to_pylist()):
        of_list.setdefault(places[w], []).append(n)
    eids = rows.column("eid").to_numpy().astype("int64")
    queries = matrix_of(rows.column("qvec"))
    shared = entries.sparkSession.sparkContext.broadcast((eids, queries, {b: np.array(v) for b, v in of_list.items()}))
    vectors, passes = conditions(index.vectors, lists)
    bits = functools.reduce(
        lambda a, b: a.bitwiseOR(b),
        [F.when(passes[w], F.lit(1 << bit).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for w, bit in places.items()],
    )
    scores = ExactScores()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, wanted, groups = shared.value
        sink = BestPerQuery(names, most)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.asarray(batch.column("item_id")).astype("int64")
            held = np.asarray(batch.column("bits")).astype("int64")
            data = matrix_of(batch.column("embedding"))
            for bit, which in groups.items():
                passing = np.flatnonzero(held >> bit & 1)
                step = max(64, limits.TILE_ENTRIES // len(which))
                for at in range(0, len(passing), step):
                    part = passing[at : at + step]
                    sims = scores.score(wanted[which], data[part], None)
                    sink.offer(which, ids[part], sims, np.ones(len(part), dtype=bool), -1)
        yield sink.result()

    flagged = vectors.select("item_id", "embedding", bits.alias("bits")).filter("bits <> 0 AND embedding IS NOT NULL")
    return flagged.mapInArrow(run, BEST_SCHEMA)
