"""Exact top-k search by inner product: a three-phase uniform threshold over lists of partial scores.

Every vector is split into LISTS runs of components; each run makes one list of partial scores per query.

1. Each task gathers, per query, the best k entries of each of its lists and resolves their whole scores. The k-th
   best of all that is a score that k candidates are known to reach.
2. That cutoff goes back to the tasks. A candidate that reaches it has, in at least one list, a partial score of at
   least cutoff / LISTS, so the entries at or above that are sufficient.
3. Entries found in all lists are summed. For the others the missing part is below cutoff / LISTS; those that can
   still reach the cutoff are resolved from the vectors themselves.

Equal vectors are told apart only by id, so at most k + 1 of them, those with the smallest ids, can be needed by
any query; the others leave before scoring, by a window whose limit is applied before the shuffle as well.
Queries are broadcast in blocks of at most QUERY_BLOCK_BYTES. Their number grows with the table, so beyond one
block the vectors are scanned once per block.

Defined cases: a vector that is null, or holds a null or a non-finite component, takes no part, and neither does a row
without an id; an empty table gives no rows; components missing from a shorter vector count as zero; repeated ids
are one candidate each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellsieve.session import cut

LISTS = 2
QUERY_BLOCK_BYTES = 8 * 1024 * 1024
TILE = 2_000_000
LEAST = np.iinfo(np.int64).min


def whole_numbers(vectors: DataFrame, id_col: str, vector_col: str, scale: int = 1024) -> DataFrame:
    """(vec_id, v): floor(scale * x) of usable vectors."""
    parts = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    bad = F.exists(parts, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & ~bad)
    return usable.select(
        F.col(id_col).cast("long").alias("vec_id"), F.transform(parts, lambda x: F.floor(x * F.lit(float(scale)))).alias("v")
    )


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    column = column.cast(pa.list_(pa.int64()))
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == dim).all():
        return flat.reshape(len(lengths), dim)
    out = np.zeros((len(lengths), dim), np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    keep = at < dim
    out[row[keep], at[keep]] = flat[keep]
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products: through doubles where those are exact, else in 64-bit integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def _scored(batches: Iterator[pa.RecordBatch], queries: np.ndarray) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Ids of a tile of candidates, and its partial scores by list, queries x candidates."""
    dim = queries.shape[1]
    cuts = [dim * k // LISTS for k in range(LISTS + 1)]
    tile = max(1, TILE // max(1, len(queries)))
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        rows = _matrix(batch.column(1), dim)
        for at in range(0, len(ids), tile):
            part = rows[at : at + tile]
            yield ids[at : at + tile], [_products(queries[:, a:b], part[:, a:b]) for a, b in zip(cuts, cuts[1:])]


def gather(candidates: DataFrame, query_ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """Phase 1: (query_id, vec_id, score) of each task's best k entries of each list, scores whole."""
    shared = candidates.sparkSession.sparkContext.broadcast((query_ids, queries))

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, q = shared.value
        best = [[np.zeros((len(own), 0), np.int64)] * 3 for _ in range(LISTS)]  # partial, id, whole
        for ids, parts in _scored(batches, q):
            whole = sum(parts)
            mask = ids[None, :] == own[:, None]
            for n, partial in enumerate(parts):
                partial = np.where(mask, LEAST, partial)
                cols = [partial, np.broadcast_to(ids, partial.shape), whole]
                joined = [np.concatenate([a, b], axis=1) for a, b in zip(best[n], cols)]
                if joined[0].shape[1] > k:
                    top = np.argpartition(-joined[0], k - 1, axis=1)[:, :k]
                    joined = [np.take_along_axis(x, top, axis=1) for x in joined]
                best[n] = joined
        for partial, ids, whole in best:
            keep = partial > LEAST
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.broadcast_to(own[:, None], ids.shape)[keep]), pa.array(ids[keep]), pa.array(whole[keep])],
                names=["query_id", "vec_id", "score"],
            )

    return candidates.mapInArrow(job, "query_id long, vec_id long, score long")


def sufficient(candidates: DataFrame, query_ids: np.ndarray, queries: np.ndarray, cutoffs: np.ndarray) -> DataFrame:
    """Phase 2: (query_id, vec_id, part, list) of all entries that reach the query's share of the cutoff."""
    shared = candidates.sparkSession.sparkContext.broadcast((query_ids, queries, cutoffs))

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, q, low = shared.value
        for ids, parts in _scored(batches, q):
            other = ids[None, :] != own[:, None]
            for n, partial in enumerate(parts):
                row, col = np.nonzero((partial >= low[:, None]) & other)
                if len(row):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own[row]), pa.array(ids[col]), pa.array(partial[row, col]), pa.array(np.full(len(row), n, np.int32))],
                        names=["query_id", "vec_id", "part", "list"],
                    )

    return candidates.mapInArrow(job, "query_id long, vec_id long, part long, list int")


def _block(all_candidates: DataFrame, block: DataFrame, k: int) -> DataFrame:
    rows = block.orderBy("vec_id").toArrow()
    dim = max([0, *(len(v) for v in rows.column("v").to_pylist())])
    query_ids = rows.column("vec_id").to_numpy()
    queries = _matrix(rows.column("v").combine_chunks(), dim)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = gather(all_candidates, query_ids, queries, k).distinct()
    kth = found.withColumn("rank", F.row_number().over(best)).where(f"rank = {k}").select("query_id", "score").toArrow()
    reached = dict(zip(kth.column(0).to_pylist(), kth.column(1).to_pylist()))
    # Without k candidates there is no cutoff: everything is sufficient.
    cutoffs = np.array([reached.get(q, LEAST) for q in query_ids.tolist()], np.int64)
    low = np.where(cutoffs == LEAST, LEAST, -(-cutoffs // LISTS))
    spark = all_candidates.sparkSession
    bounds = spark.createDataFrame(
        pa.table({"query_id": query_ids, "cutoff": cutoffs, "low": low, "q": rows.column("v").combine_chunks()})
    )
    entries = sufficient(all_candidates, query_ids, queries, low)
    sums = entries.groupBy("query_id", "vec_id").agg(F.sum("part").alias("seen"), F.count("*").alias("lists"))
    sums = cut(sums.join(F.broadcast(bounds), "query_id"))
    complete = sums.where(F.col("lists") == LISTS).select("query_id", "vec_id", F.col("seen").alias("score"))
    # A part that was not sent is at most low - 1.
    open_ = sums.where(
        (F.col("lists") < LISTS) & (F.col("seen") + (LISTS - F.col("lists")) * (F.col("low") - 1) >= F.col("cutoff"))
    )
    product = F.aggregate(
        F.zip_with("q", "v", lambda a, b: F.coalesce(a * b, F.lit(0))), F.lit(0).cast("long"), lambda total, x: total + x
    )
    resolved = (
        open_.select("query_id", "vec_id", "q").join(all_candidates, "vec_id").select("query_id", "vec_id", product.alias("score"))
    )
    scored = complete.unionByName(resolved)
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact_topk(vectors: DataFrame, query_rows: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best other rows, ties to the smaller id."""
    same = Window.partitionBy("v").orderBy("vec_id")
    numbers = whole_numbers(vectors, id_col, vector_col).dropDuplicates(["vec_id"])
    candidates = cut(numbers.withColumn("copy", F.row_number().over(same)).where(F.col("copy") <= k + 1).drop("copy"))
    queries = cut(whole_numbers(query_rows, id_col, vector_col).dropDuplicates(["vec_id"]))
    size = queries.agg(F.count("*"), F.sum(F.size("v") * 8 + 16)).head()
    blocks = max(1, -(-int(size[1] or 0) // QUERY_BLOCK_BYTES))
    out = None
    for b in range(blocks):
        block = queries if blocks == 1 else queries.where(f"pmod(xxhash64(vec_id), {blocks}) = {b}")
        part = _block(candidates, block, k)
        out = part if out is None else out.unionByName(part)
    return out
