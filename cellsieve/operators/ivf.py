"""Cells: nearest-centroid lookup, assignment, training and the cell-partitioned index."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellsieve import limits
from cellsieve.functions.vectors import (
    NORM_EPSILON,
    SETTLED_DECIMALS,
    inner_product,
    l2_normalize,
    settle,
)
from cellsieve.operators import pq
from cellsieve.operators.cell_tree import CellTree, Groups, nearest_middles
from cellsieve.operators.scoring import (
    BEST_SCHEMA,
    PROBE_BYTES,
    BestPerQuery,
    ExactScores,
    _joined_scan,
    best_per_query,
    matrix_of,
    rank_per_query,
    sum_arrays,
    unit_queries,
    within_cells,
)
from cellsieve.schemas import CENTROIDS
from cellsieve.session import cut

# Seed of every sampled or trained step, default probe width, smallest useful training factor.
SEED = 6400
DEFAULT_NPROBE = 16
TRAIN_PER_CELL = 100

# Tasks per core that points are dealt to before they meet many centroids.
TASKS_PER_CORE = 4


class Cells:
    """Centroids (cell_id, centroid) with the matrix that is broadcast when it fits the bound."""

    def __init__(self, frame: DataFrame, matrix_bytes: int | None = None, tree_cells: int | None = None):
        self.frame = frame.select("cell_id", "centroid")
        self.matrix_bytes = matrix_bytes
        self.tree_cells = limits.TREE_CELLS if tree_cells is None else tree_cells

    @classmethod
    def of(cls, centroids: DataFrame | Cells) -> Cells:
        return centroids if isinstance(centroids, Cells) else cls(centroids)

    @cached_property
    def matrix(self) -> tuple[np.ndarray, np.ndarray] | None:
        """(cell ids ascending, matrix), or None beyond `matrix_bytes`, by default MATRIX_BYTES."""
        size = limits.MATRIX_BYTES if self.matrix_bytes is None else self.matrix_bytes
        bound = limits.rows_within(size, 8 * self.dim)
        table = self.frame.limit(bound + 1).toArrow()
        if table.num_rows > bound:
            return None
        ids = table.column("cell_id").to_numpy().astype("int64")
        order = np.argsort(ids)
        return ids[order], matrix_of(table.column("centroid"))[order]

    @cached_property
    def shared(self):
        """The broadcast matrix, or None beyond the bound."""
        return None if self.matrix is None else self.frame.sparkSession.sparkContext.broadcast(self.matrix)

    @cached_property
    def tree(self):
        """From `tree_cells` centroids on, they are grouped and searched by group: the broadcast tree, else None."""
        if self.matrix is None or len(self.matrix[0]) < self.tree_cells:
            return None
        return self.frame.sparkSession.sparkContext.broadcast(CellTree.of(self.matrix[1], SEED))

    @cached_property
    def grouped(self) -> tuple[Groups, DataFrame]:
        """Groups of a set beyond the bound, and its centroids with their group_id. Middles are a sample of about
        the square root of their number."""
        middles = matrix_of(train_sample(self.frame, "cell_id", max(1, math.isqrt(self.count))).select("centroid").toArrow().column(0))

        def place(batches):
            for batch in batches:
                points = matrix_of(batch.column("centroid"))
                group = nearest_middles(points, middles) if len(points) else np.zeros(0, np.int64)
                off = np.sqrt(((points - middles[group]) ** 2).sum(axis=1)) if len(points) else np.zeros(0)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(group), pa.array(off)], [*batch.schema.names, "group_id", "off"])

        kind = self.frame.schema["centroid"].dataType.simpleString()
        placed = cut(self.frame.mapInArrow(place, f"cell_id bigint, centroid {kind}, group_id bigint, off double"))
        found = placed.groupBy("group_id").agg(F.max("off").alias("radius"), F.count(F.lit(1)).alias("n")).toArrow()
        at = found.column("group_id").to_numpy()
        radii, sizes = np.zeros(len(middles)), np.zeros(len(middles), np.int64)
        radii[at], sizes[at] = found.column("radius").to_numpy(), found.column("n").to_numpy()
        return Groups(middles, radii, sizes), placed.drop("off")

    @cached_property
    def dim(self) -> int:
        first = self.frame.select(F.size("centroid").alias("dim")).head()
        if first is None:
            raise ValueError("the index has no centroids: train it first")
        return first["dim"]

    @cached_property
    def count(self) -> int:
        return self.frame.count() if self.matrix is None else len(self.matrix[0])


def nearest_cells(
    points: DataFrame,
    centroids: DataFrame | Cells,
    vector: str,
    n: int | str,
    id_column: str,
    weights: DataFrame | None = None,
    width: Callable[[np.ndarray], int] | None = None,
) -> DataFrame:
    """Add `cells` and `cell_sims`: the n most similar centroids per row, best first, lowest id on ties.

    `n` is a number or the name of an integer column. With `weights` (cell_id, n) also `seen`: the running
    total of n over those cells. `width` takes these totals and says how many of the cells a row keeps. Rows stay in their partition; only the centroid matrix is broadcast, behind
    a size check; a large matrix is searched by groups of centroids. Centroid sets beyond the bound are joined, each row
    with the groups that may hold one of its cells.
    """
    cells = Cells.of(centroids)
    shared = cells.shared
    if shared is None:
        joined = _nearest_cells_joined(points, cells, vector, n, id_column, weights)
        return joined if width is None else _cut_to_width(joined, width)
    weighted = weights is not None
    tree = None if weighted else cells.tree
    per_cell = None
    if weighted:
        # At most one row per centroid, so within the bound just checked.
        known = weights.select("cell_id", "n").toArrow()
        per_cell = np.zeros(cells.count, dtype="int64")
        at = np.searchsorted(cells.matrix[0], known.column("cell_id").to_numpy())
        per_cell[at] = known.column("n").to_numpy()
    added = [("cells", T.LongType()), ("cell_sims", T.DoubleType())] + ([("seen", T.LongType())] if weighted else [])
    schema = T.StructType(points.schema.fields + [T.StructField(c, T.ArrayType(t)) for c, t in added])

    def run(batches):
        ids, matrix = shared.value
        for batch in batches:
            rows = batch.num_rows
            points = matrix_of(batch.column(vector))
            wanted = (
                np.full(rows, n) if isinstance(n, int) else np.asarray(batch.column(n)).astype("int64")
            )
            wanted = np.minimum(wanted, len(ids))
            chosen, sims = [np.zeros(0, "int64")], [np.zeros(0)]
            seen = [np.zeros(0, "int64")]
            by_group = tree is not None and 0 < int(wanted.max(initial=0)) <= len(ids) // 4
            # By groups, a row is bounded against groups alone; otherwise against every centroid.
            step = max(16, limits.TILE_ENTRIES // (len(tree.value.members) if by_group else len(ids)))
            for at in range(0, rows, step):
                most = int(wanted[at : at + step].max(initial=0))
                if by_group and most:
                    near, near_sims, _ = tree.value.nearest(points[at : at + step], most)
                    held = np.arange(most) < wanted[at : at + step, None]
                    chosen.append(near[held])
                    sims.append(near_sims[held])
                    continue
                tile = np.round(points[at : at + step] @ matrix.T, SETTLED_DECIMALS)
                if most == 1 and not weighted and wanted[at : at + step].min() == 1:
                    best = tile.argmax(axis=1)
                    chosen.append(best)
                    sims.append(tile[np.arange(len(best)), best])
                    continue
                order = np.argsort(-tile, axis=1, kind="stable")[:, :most]
                for row, count in enumerate(wanted[at : at + step]):
                    own = order[row, :count]
                    if weighted:
                        totals = np.cumsum(per_cell[own])
                        if width is not None:
                            wanted[at + row] = count = width(totals)
                            own, totals = own[:count], totals[:count]
                        seen.append(totals)
                    chosen.append(own)
                    sims.append(tile[row, own])
            offsets = pa.array(np.concatenate([[0], np.cumsum(wanted)]), pa.int32())
            lists = [pa.array(ids[np.concatenate(chosen)], pa.int64()), pa.array(np.concatenate(sims), pa.float64())]
            if weighted:
                lists.append(pa.array(np.concatenate(seen), pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *[pa.ListArray.from_arrays(offsets, values) for values in lists]],
                schema.fieldNames(),
            )

    return points.mapInArrow(run, schema)


def _cut_to_width(probes: DataFrame, width: Callable[[np.ndarray], int]) -> DataFrame:
    """Rows with the first cells of their lists, as many as `width` says."""
    names = probes.columns

    def run(batches):
        for batch in batches:
            totals = batch.column("seen").to_pylist()
            keep = [width(np.asarray(t, dtype="int64")) for t in totals]
            columns = []
            for name in names:
                column = batch.column(name)
                if name in ("cells", "cell_sims", "seen"):
                    column = pa.array([v[:k] for v, k in zip(column.to_pylist(), keep)], column.type)
                columns.append(column)
            yield pa.RecordBatch.from_arrays(columns, names)

    return probes.mapInArrow(run, probes.schema)


def _nearest_cells_joined(points, cells, vector, n, id_column, weights):
    widest = n if isinstance(n, int) else points.agg(F.max(n)).head()[0] or 1
    groups, placed = cells.grouped
    as_vectors = placed.select(F.col("cell_id").alias("item_id"), F.col("centroid").alias("embedding"), F.col("group_id").alias("cell_id"))
    as_queries = _with_groups(points.select(F.col(id_column).alias("qid"), F.col(vector).alias("qvec")), groups, widest)
    found = _joined_scan(
        as_vectors, as_queries, ExactScores(), lambda qids, marks: BestPerQuery(qids, widest), BEST_SCHEMA
    )
    ranked = rank_per_query(found, widest)
    parts = ["rank", "item_id", "similarity"]
    if weights is not None:
        parts.append("seen")
        by_rank = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
        ranked = ranked.join(
            weights.select(F.col("cell_id").alias("item_id"), "n"), "item_id", "left"
        ).withColumn("seen", F.sum(F.coalesce("n", F.lit(0))).over(by_rank))
    lists = ranked.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct(*parts))).alias("near"))
    width = F.lit(n) if isinstance(n, int) else F.col(n).cast("int")
    names = {"item_id": "cells", "similarity": "cell_sims", "seen": "seen"}
    joined = points.join(lists.withColumnRenamed("qid", id_column), id_column)
    return joined.select(
        *points.columns, *[F.slice(F.col(f"near.{p}"), F.lit(1), width).alias(names[p]) for p in parts[1:]]
    )


def _with_groups(queries: DataFrame, groups: Groups, n: int) -> DataFrame:
    """Queries with the groups of centroids that may hold one of their n nearest, as the cells of a joined scan."""
    shared = queries.sparkSession.sparkContext.broadcast(groups)
    schema = T.StructType([*queries.schema.fields, T.StructField("cells", T.ArrayType(T.LongType())), T.StructField("cell_sims", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for batch in batches:
            vectors = matrix_of(batch.column("qvec"))
            wanted = shared.value.candidates(vectors, n) if len(vectors) else []
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(w) for w in wanted])]), pa.int32())
            flat = pa.array(np.concatenate([np.zeros(0, np.int64), *wanted]), pa.int64())
            lists = [pa.ListArray.from_arrays(offsets, v) for v in (flat, pa.array(np.zeros(len(flat))))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *lists], schema.fieldNames())

    return queries.mapInArrow(run, schema)


def _dealt(points: DataFrame, cells: Cells) -> DataFrame:
    """Points dealt evenly to several tasks per core where each meets so many centroids that this outweighs the shuffle
    of a vector: files are read by row group, and the vectors of a file may all lie in one."""
    if cells.tree is None:
        return points
    spark = points.sparkSession
    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return points.repartition(max(TASKS_PER_CORE * spark.sparkContext.defaultParallelism, shuffled))


def assign_cells(points: DataFrame, centroids: DataFrame | Cells, vector: str = "embedding") -> DataFrame:
    """Add `cell_id`, the cell of the most similar centroid."""
    cells = Cells.of(centroids)
    return (
        nearest_cells(_dealt(points, cells), cells, vector, 1, "item_id")
        .withColumn("cell_id", F.col("cells")[0])
        .drop("cells", "cell_sims")
    )


# -------------------------------------------------------------------------------------------------- training


def ticket(key: str, seed: int = SEED) -> Column:
    """The seeded hash of a row's key, in whose order samples are drawn."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))


def train_sample(points: DataFrame, key: str, size: int, seed: int = SEED) -> DataFrame:
    """Uniform sample of `size` rows: those with the smallest seeded hashes.

    A bound on the hash lets somewhat more than `size` ids pass; only these are put in order, and other columns
    are read for the chosen ids alone. Should too few pass, the bound is widened.
    """
    total = points.count()
    if total <= size:
        return points
    ids = points.select(key, ticket(key, seed).alias("ticket"))
    share = (size + 6 * size**0.5 + 10) / total
    while True:
        bound = f"{min(int(share * 16**12), 16**12 - 1):012x}"
        # Hex digits order as the numbers they write.
        some = ids if share >= 1 else ids.filter(F.substring("ticket", 1, 12) <= bound)
        chosen = cut(some.orderBy("ticket", key).limit(size).select(F.col(key).alias("__chosen")))
        if share >= 1 or chosen.count() == size:
            return points.join(chosen, F.col(key) == F.col("__chosen"), "left_semi")
        share *= 4


def train_centroids(
    sample: DataFrame, nlist: int, vector: str = "embedding", seed: int = SEED, max_iter: int = 20
) -> DataFrame:
    """Spherical k-means over a training sample; returns (cell_id, centroid)."""
    features = sample.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    model = KMeans(k=nlist, seed=seed, distanceMeasure="cosine", maxIter=max_iter).fit(features)
    rows = []
    for cell, center in enumerate(model.clusterCenters()):
        unit = center / (np.linalg.norm(center) + NORM_EPSILON)
        rows.append((cell, [float(x) for x in unit]))
    return sample.sparkSession.createDataFrame(rows, CENTROIDS)


def kmeans_step(points: DataFrame, centroids: DataFrame, vector: str = "embedding") -> DataFrame:
    """One Lloyd step: assign, average per cell, normalise. A cell without members keeps its centroid.

    Each task emits one partial sum per cell, so a crowded cell moves no more rows than an empty one.
    """
    cells = Cells.of(centroids)
    assigned = assign_cells(points, cells, vector).select("cell_id", vector)

    def partial_sums(batches):
        sums: dict[int, np.ndarray] = {}
        counts: dict[int, int] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = np.asarray(batch.column("cell_id")).astype("int64")
            data = matrix_of(batch.column(vector))
            names, owner = np.unique(cells, return_inverse=True)
            totals = np.zeros((len(names), data.shape[1]))
            np.add.at(totals, owner, data)
            for name, total, count in zip(names, totals, np.bincount(owner)):
                name = int(name)
                sums[name] = sums[name] + total if name in sums else total
                counts[name] = counts.get(name, 0) + int(count)
        names = sorted(sums)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(names, pa.int64()),
                pa.array([counts[n] for n in names], pa.int64()),
                pa.array([sums[n].tolist() for n in names], pa.list_(pa.float64())),
            ],
            ["cell_id", "n", "sums"],
        )

    partial = assigned.mapInArrow(partial_sums, "cell_id bigint, n bigint, sums array<double>")
    means = sum_arrays(partial, ["cell_id"]).select(
        "cell_id", F.transform("sums", lambda x: x / F.col("n")).alias("mean"), "n"
    )
    norm = F.sqrt(F.aggregate("mean", F.lit(0.0), lambda t, x: t + x * x)) + F.lit(NORM_EPSILON)
    updated = F.transform("mean", lambda x: x / norm)
    return cells.frame.join(means, "cell_id", "left").select(
        "cell_id",
        F.coalesce(updated, F.col("centroid")).alias("centroid"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("members"),
    )


# ----------------------------------------------------------------------------------------------------- index


@dataclass(frozen=True)
class IvfIndex:
    """Centroids, vectors(item_id, cell_id, embedding, [code], carried columns) and, when codes are kept,
    codebooks(m, j, codeword).

    `vectors` carries the columns that predicates may test, so a filter reaches the scan of the vectors and
    needs no join with the item table. Stored vectors are unit length.
    """

    cells: Cells
    vectors: DataFrame
    codebooks: DataFrame | None = None
    pq_m: int | None = None
    pq_bits: int = 8
    counted: int | None = None

    @property
    def dim(self) -> int:
        return self.cells.dim

    @property
    def nlist(self) -> int:
        return self.cells.count

    @cached_property
    def total(self) -> int:
        return self.vectors.count() if self.counted is None else self.counted

    def scores(self, scoring: str = "exact"):
        if scoring == "exact":
            return ExactScores()
        if scoring == "codes":
            if self.codebooks is None:
                raise ValueError("this index keeps no codes")
            return pq.code_scores(self.codebooks)
        raise ValueError(f"unknown scoring: {scoring}")

    def probe(self, queries: DataFrame, nprobe: int | str, weights: DataFrame | None = None, width=None) -> DataFrame:
        """Unit queries with the `nprobe` cells nearest to each, or as many of these as `width` says."""
        return nearest_cells(queries, self.cells, "qvec", nprobe, "qid", weights, width)

    def search(
        self,
        queries: DataFrame,
        k: int,
        nprobe: int = DEFAULT_NPROBE,
        scoring: str = "exact",
        allowed: DataFrame | None = None,
        where: Column | None = None,
        block_bytes: int | None = None,
    ) -> DataFrame:
        """(qid, item_id, cell_id, similarity, rank) of the best k rows within the probed cells.

        `allowed` restricts to an id set (an empty one finds nothing); `where` to rows passing a condition.
        """
        vectors = self.vectors if where is None else self.vectors.filter(where)
        if allowed is not None:
            vectors = vectors.join(allowed.select("item_id"), "item_id", "left_semi")
        probes = self.probe(unit_queries(queries), nprobe)
        found = best_per_query(
            vectors, probes, k, self.scores(scoring), dim=self.dim, width=min(nprobe, self.nlist), block_bytes=block_bytes
        )
        return found.drop("passes")

    def rerank(self, found: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        """Exact similarities for a candidate list of `search`, cut to k; reads vectors only from the cells
        the candidates lie in."""
        found = cut(found.select("qid", "item_id", "cell_id"))
        vectors = self.vectors.select("item_id", "cell_id", "embedding")
        bound = limits.rows_within(limits.QUERY_BLOCK_BYTES, PROBE_BYTES)
        touched = [r["cell_id"] for r in found.select("cell_id").distinct().limit(bound + 1).collect()]
        if len(touched) <= bound:
            vectors = within_cells(vectors, touched)
        pairs = found.join(vectors, ["cell_id", "item_id"])
        pairs = pairs.join(unit_queries(queries), "qid")
        exact = settle(inner_product(F.col("qvec"), F.col("embedding")))
        return rank_per_query(pairs.select("qid", "item_id", exact.alias("similarity")), k)

    def cell_sizes(self) -> DataFrame:
        """Rows per cell, empty cells included."""
        counted = self.vectors.groupBy("cell_id").agg(F.count(F.lit(1)).alias("n"))
        return self.cells.frame.select("cell_id").join(counted, "cell_id", "left").select(
            "cell_id", F.coalesce("n", F.lit(0)).alias("n")
        )

    def assign(self, items: DataFrame) -> DataFrame:
        """Items as stored in `vectors`: unit length, with cell and, if the index keeps codes, code."""
        placed = assign_cells(items.withColumn("embedding", l2_normalize("embedding")), self.cells)
        if self.codebooks is not None:
            placed = pq.encode(placed, self.cells, self.codebooks)
        return placed

    def add(self, items: DataFrame) -> IvfIndex:
        """The index with further items (item_id, embedding, carried columns)."""
        return replace(self, vectors=self.vectors.unionByName(self.assign(items)), counted=None)


def index_items(
    items: DataFrame, centroids: DataFrame | Cells, codebooks: DataFrame | None = None
) -> IvfIndex:
    """Place (and encode) items (item_id, embedding, carried columns) with given quantizers."""
    shape = {}
    if codebooks is not None:
        last = codebooks.agg(F.max("m").alias("m"), F.max("j").alias("j")).head()
        shape = {"pq_m": last["m"] + 1, "pq_bits": int(last["j"]).bit_length()}
    empty = IvfIndex(Cells.of(centroids), items.limit(0), codebooks, **shape)
    return replace(empty, vectors=empty.assign(items))
