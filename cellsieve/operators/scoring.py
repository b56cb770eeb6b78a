"""Top-k scoring of vectors against batches of queries.

Vectors stream through Arrow batches once, are multiplied with every query that wants their cell, and only
the best k per query leave a task. Nothing is grouped by cell, so a cell that holds a third of all rows is
scored by as many tasks as its files have splits. Three ways share the arithmetic:

* a query block that fits `QUERY_BLOCK_BYTES` is broadcast and the vectors are scanned in place;
* a larger set of probing queries is cut into blocks of neighbours, each broadcast to the cells it probes;
* any still larger query set is packed per cell and joined with chunks of vectors on the cell, a shuffle join
  whose hot cells AQE may split.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellsieve import limits
from cellsieve.functions.vectors import SETTLED_DECIMALS, l2_normalize
from cellsieve.session import cut

BEST_SCHEMA = "qid bigint, item_id bigint, cell_id bigint, similarity double, passes boolean"
# Memory of one probed cell of one query: id, similarity and their place in the per-cell lists.
PROBE_BYTES = 32

# Chunks' worth of rows that a task groups by cell at once.
GROUPED_CHUNKS = 16

# Memory of one held row and of one query in a sink.
ROW_BYTES, QUERY_BYTES = 48, 200

# Rows per query that one task merges without a salted step before it.
MERGE_AT_ONCE = 20_000
MERGED_TASKS = 64
# Rows of one query that all tasks together may send before a cutoff is exchanged, and the share (1 in so many) of the
# vectors that gives it.
CUTOFF_ROWS = 2_000_000
CUTOFF_SHARE = 64
# Query blocks scanned one after the other before vectors are shuffled to the queries instead.
MOST_BLOCKS = 64
SLOT_SCHEMA = "qid bigint, slot int, n bigint"


# ---------------------------------------------------------------------------------------------- arithmetic


def matrix_of(column: pa.Array, dtype: str = "float64") -> np.ndarray:
    """A list column of equal lengths as a 2-D array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros((0, 0), dtype=dtype)
    return np.asarray(column.flatten()).astype(dtype).reshape(len(column), -1)


def flags_of(column: pa.Array) -> np.ndarray:
    """A boolean column with NULL as false."""
    return np.asarray(pc.fill_null(column, False).to_numpy(zero_copy_only=False)).astype(bool)


@dataclass(frozen=True)
class ExactScores:
    """Inner products with the stored vectors."""

    column: str = "embedding"
    dtype: str = "float64"
    bytes_per_query: int = 0

    def prepare(self, queries: np.ndarray) -> np.ndarray:
        return queries

    def score(self, prepared: np.ndarray, data: np.ndarray, base: np.ndarray) -> np.ndarray:
        return np.round(prepared @ data.T, SETTLED_DECIMALS)


@dataclass(frozen=True)
class CodeScores:
    """Inner products approximated from product-quantizer codes: the query's similarity to the centroid plus
    one looked-up term per sub-vector."""

    codebooks: np.ndarray  # (m, codes, width)
    column: str = "code"
    dtype: str = "int64"

    @property
    def bytes_per_query(self) -> int:
        """Size of one query's look-up table."""
        return 8 * self.codebooks.shape[0] * self.codebooks.shape[1]

    def prepare(self, queries: np.ndarray) -> np.ndarray:
        m, _, width = self.codebooks.shape
        return np.einsum("qmw,mcw->qmc", queries.reshape(len(queries), m, width), self.codebooks)

    def score(self, prepared: np.ndarray, data: np.ndarray, base: np.ndarray) -> np.ndarray:
        total = np.repeat(base[:, None], len(data), axis=1)
        for m in range(self.codebooks.shape[0]):
            total += prepared[:, m, :][:, data[:, m]]
        return np.round(total, SETTLED_DECIMALS)


class BestPerQuery:
    """Running top-k per query by (similarity descending, item_id ascending); rows keep their pass flag."""

    def __init__(self, qids: np.ndarray, k: int):
        self.k = k
        self.at: dict[int, int] = {}
        self.floor = np.zeros(0)
        self.parts: list[list[tuple[np.ndarray, ...]]] = []
        self.held = np.zeros(0, dtype=np.int64)
        self.places(qids)

    def places(self, qids: np.ndarray, marks=None) -> np.ndarray:
        """The numbers of these queries here; new ones are added."""
        out = np.array([self.at.setdefault(int(q), len(self.at)) for q in qids], dtype=np.int64)
        new = len(self.at) - len(self.parts)
        self.parts += [[] for _ in range(new)]
        self.floor = np.append(self.floor, np.full(new, -np.inf))
        self.held = np.append(self.held, np.zeros(new, dtype=np.int64))
        return out

    def raise_floor(self, which: np.ndarray, least: np.ndarray) -> None:
        """Rows below `least` are known not to rank."""
        self.floor[which] = np.maximum(self.floor[which], least)

    @property
    def bytes(self) -> int:
        return int(self.held.sum()) * ROW_BYTES + len(self.at) * QUERY_BYTES

    def offer(self, which, ids: np.ndarray, sims: np.ndarray, passes: np.ndarray, cell: int) -> None:
        hits = sims >= self.floor[which][:, None]
        for row in np.flatnonzero(hits.any(axis=1)):
            q, mask = which[row], hits[row]
            some = ids[mask]
            self.parts[q].append((sims[row, mask], some, passes[mask], np.full(len(some), cell)))
            self.held[q] += len(some)
            if self.held[q] > 2 * self.k:
                self._settle(q)

    def _settle(self, q: int) -> None:
        columns = [np.concatenate(column) for column in zip(*self.parts[q])]
        keep = np.lexsort((columns[1], -columns[0]))[: self.k]
        self.parts[q] = [tuple(column[keep] for column in columns)]
        self.held[q] = len(keep)
        if len(keep) == self.k:
            self.floor[q] = columns[0][keep[-1]]

    def result(self) -> pa.RecordBatch:
        qids, columns = [], []
        names = list(self.at)
        for q in np.flatnonzero(self.held):
            self._settle(q)
            columns.append(self.parts[q][0])
            qids.append(np.full(self.held[q], names[q]))
        sims, ids, passes, cells = zip(*columns) if columns else ((), (), (), ())
        return pa.RecordBatch.from_arrays(
            [
                pa.array(_joined(qids, "int64"), pa.int64()),
                pa.array(_joined(ids, "int64"), pa.int64()),
                pa.array(_joined(cells, "int64"), pa.int64()),
                pa.array(_joined(sims, "float64"), pa.float64()),
                pa.array(_joined(passes, "bool"), pa.bool_()),
            ],
            ["qid", "item_id", "cell_id", "similarity", "passes"],
        )


class SlotCounts:
    """For every query, how many scored vectors fall between consecutive marks of its ordered mark list."""

    def __init__(self, qids: np.ndarray, marks: list[tuple[np.ndarray, np.ndarray]]):
        self.at: dict[int, int] = {}
        self.marks: list[tuple[np.ndarray, np.ndarray]] = []
        self.counts: list[np.ndarray] = []
        self.bytes = 0
        self.places(qids, marks)

    def places(self, qids: np.ndarray, marks) -> np.ndarray:
        """The numbers of these queries here; new ones are added with their marks."""
        out = []
        for q, (sims, ids) in zip(qids, marks or ()):
            n = self.at.setdefault(int(q), len(self.at))
            if n == len(self.marks):
                self.marks.append((-np.asarray(sims, dtype="float64"), np.asarray(ids, dtype="int64")))
                self.counts.append(np.zeros(len(sims), dtype=np.int64))
                self.bytes += ROW_BYTES * len(sims) + QUERY_BYTES
            out.append(n)
        return np.array(out, dtype=np.int64)

    def offer(self, which, ids: np.ndarray, sims: np.ndarray, passes: np.ndarray, cell: int) -> None:
        for row, q in enumerate(which):
            falling, mark_ids = self.marks[q]
            if not len(falling):
                continue
            values = -sims[row]
            mask = values <= falling[-1]
            values, own = values[mask], ids[mask]
            slots = np.searchsorted(falling, values, side="left")
            ends = np.searchsorted(falling, values, side="right")
            for tied in np.flatnonzero(ends > slots):
                lo, hi = slots[tied], ends[tied]
                slots[tied] = lo + np.searchsorted(mark_ids[lo:hi], own[tied], side="left")
            size = len(falling)
            self.counts[q] += np.bincount(slots[slots < size], minlength=size)

    def result(self) -> pa.RecordBatch:
        qids, slots, counts = [], [], []
        for q, n in zip(self.at, self.counts):
            used = np.flatnonzero(n)
            qids.append(np.full(len(used), q))
            slots.append(used)
            counts.append(n[used])
        return pa.RecordBatch.from_arrays(
            [
                pa.array(_joined(qids, "int64"), pa.int64()),
                pa.array(_joined(slots, "int32"), pa.int32()),
                pa.array(_joined(counts, "int64"), pa.int64()),
            ],
            ["qid", "slot", "n"],
        )


def _joined(parts, dtype: str) -> np.ndarray:
    return np.concatenate(parts).astype(dtype) if parts else np.zeros(0, dtype=dtype)


def _tiles(rows: int, queries: int):
    step = max(64, limits.TILE_ENTRIES // max(1, queries))
    return (slice(at, min(rows, at + step)) for at in range(0, rows, step))


# ------------------------------------------------------------------------------------- broadcast query block


@dataclass(frozen=True)
class QueryBlock:
    """A bounded batch of queries on the driver. `cells` is None when every query wants every row; `least` is a similarity
    that the rows of a query must reach."""

    qids: np.ndarray
    vectors: np.ndarray
    cells: dict[int, tuple[np.ndarray, np.ndarray]] | None
    marks: list[tuple[np.ndarray, np.ndarray]] | None
    least: np.ndarray | None = None


def _block_of(table: pa.Table) -> QueryBlock:
    qids = table.column("qid").to_numpy().astype("int64")
    vectors = matrix_of(table.column("qvec"))
    cells = marks = None
    if "cells" in table.column_names:
        lists = table.column("cells").combine_chunks()
        flat = np.asarray(lists.flatten()).astype("int64")
        sizes = np.asarray(pc.list_value_length(lists)).astype("int64")
        owner = np.repeat(np.arange(len(qids)), sizes)
        base = np.asarray(table.column("cell_sims").combine_chunks().flatten()).astype("float64")
        order = np.argsort(flat, kind="stable")
        names, starts = np.unique(flat[order], return_index=True)
        cells = {
            int(name): (owner[part], base[part])
            for name, part in zip(names, np.split(order, starts[1:]))
        }
    if "mark_sims" in table.column_names:
        marks = list(
            zip(
                [np.asarray(s, dtype="float64") for s in table.column("mark_sims").to_pylist()],
                [np.asarray(i, dtype="int64") for i in table.column("mark_ids").to_pylist()],
            )
        )
    least = table.column("least").to_numpy() if "least" in table.column_names else None
    return QueryBlock(qids, vectors, cells, marks, least)


def within_cells(vectors: DataFrame, cells: list[int]) -> DataFrame:
    """Vectors of these cells, which the caller holds on the driver within a checked bound.

    A literal list prunes the cell partitions while planning; a longer one is joined, and the broadcast ids prune
    them at run time."""
    if not cells:
        return vectors
    if len(cells) <= limits.PRUNE_CELLS:
        return vectors.filter(f"cell_id IN ({', '.join(map(str, sorted(cells)))})")
    wanted = cut(vectors.sparkSession.createDataFrame(pa.table({"cell_id": pa.array(sorted(cells), pa.int64())})))
    # Run-time pruning wants a condition on the side that prunes.
    return vectors.join(F.broadcast(wanted.filter(F.col("cell_id") >= min(cells))), "cell_id", "left_semi")


def _scan(vectors: DataFrame, block: QueryBlock, scores, make_sink: Callable, schema: str) -> DataFrame:
    """Score every row of `vectors` against the broadcast block; a task emits only what its sink keeps."""
    flagged = "passes" in vectors.columns
    columns = ["item_id", scores.column, *(["passes"] if flagged else [])]
    if block.cells is not None:
        columns.insert(1, "cell_id")
        vectors = within_cells(vectors, list(block.cells))
    payload = (block.qids, block.vectors, block.cells, block.marks, block.least)
    shared = vectors.sparkSession.sparkContext.broadcast(payload)
    data_column, dtype = scores.column, scores.dtype

    def run(batches):
        qids, queries, cells, marks, least = shared.value
        prepared = scores.prepare(queries)
        sink = make_sink(qids, marks)
        if least is not None:
            sink.raise_floor(np.arange(len(qids)), least)
        everyone = np.arange(len(qids))
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.asarray(batch.column("item_id")).astype("int64")
            data = matrix_of(batch.column(data_column), dtype)
            passes = flags_of(batch.column("passes")) if flagged else np.ones(len(ids), dtype=bool)
            if cells is None:
                groups = [(-1, slice(None))]
            else:
                here = np.asarray(batch.column("cell_id")).astype("int64")
                order = np.argsort(here, kind="stable")
                names, starts = np.unique(here[order], return_index=True)
                groups = [
                    (int(name), rows)
                    for name, rows in zip(names, np.split(order, starts[1:]))
                    if int(name) in cells
                ]
            for cell, rows in groups:
                which, base = (everyone, None) if cells is None else cells[cell]
                mine = prepared if cells is None else prepared[which]
                some_ids, some_data, some_passes = ids[rows], data[rows], passes[rows]
                for tile in _tiles(len(some_ids), len(which)):
                    sims = scores.score(mine, some_data[tile], base)
                    sink.offer(which, some_ids[tile], sims, some_passes[tile], cell)
        yield sink.result()

    return vectors.select(*columns).filter(F.col(data_column).isNotNull()).mapInArrow(run, schema)


# ------------------------------------------------------------------------------------ joined chunks and packs


def _chunks(vectors: DataFrame, scores) -> DataFrame:
    """Rows of one cell within a task packed into arrays; no shuffle."""
    data_column = scores.column
    kind = vectors.schema[data_column].dataType.elementType.simpleString()
    passes = F.col("passes") if "passes" in vectors.columns else F.lit(True)

    def gathered(batches):
        """Batches of one task together, until they are worth a grouping by cell."""
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= GROUPED_CHUNKS * limits.CHUNK_ROWS:
                yield pa.Table.from_batches(held)
                held, rows = [], 0
        if held:
            yield pa.Table.from_batches(held)

    def pack(batches):
        for table in gathered(batches):
            cells = np.asarray(table.column("cell_id")).astype("int64")
            order = np.argsort(cells, kind="stable")
            names, starts = np.unique(cells[order], return_index=True)
            for name, rows in zip(names, np.split(order, starts[1:])):
                for at in range(0, len(rows), limits.CHUNK_ROWS):
                    part = table.take(pa.array(rows[at : at + limits.CHUNK_ROWS]))
                    flat = part.column(data_column).combine_chunks().flatten()
                    ids = part.column("item_id").combine_chunks()
                    flags = part.column("passes").combine_chunks()
                    one = lambda values: pa.ListArray.from_arrays(
                        pa.array([0, len(values)], pa.int32()), values
                    )
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(name)], pa.int64()), one(ids), one(flat), one(flags)],
                        ["cell_id", "item_ids", "data", "flags"],
                    )

    return (
        vectors.select("item_id", "cell_id", data_column, F.coalesce(passes, F.lit(False)).alias("passes"))
        .filter(F.col(data_column).isNotNull())
        .mapInArrow(
            pack, f"cell_id bigint, item_ids array<bigint>, data array<{kind}>, flags array<boolean>"
        )
    )


def _joined_scan(
    vectors: DataFrame, probes: DataFrame, scores, make_sink: Callable, schema: str
) -> DataFrame:
    """Score by joining chunks of vectors with packs of at most about PACK_QUERIES queries on the cell."""
    marked, bounded = "mark_sims" in probes.columns, "least" in probes.columns
    extra = ["mark_sims", "mark_ids"] * marked + ["least"] * bounded
    if "cells" in probes.columns:
        wanted = probes.select(
            "qid", "qvec", *extra, F.explode(F.arrays_zip("cells", "cell_sims")).alias("probe")
        ).select(
            "qid",
            "qvec",
            *extra,
            F.col("probe.cells").alias("cell_id"),
            F.col("probe.cell_sims").alias("base"),
        )
    else:
        # Every query wants every row: spread the rows over even buckets and give each bucket all packs.
        fan = vectors.sparkSession.sparkContext.defaultParallelism
        vectors = vectors.withColumn("cell_id", F.pmod(F.xxhash64("item_id"), F.lit(fan)))
        wanted = probes.select(
            "qid",
            "qvec",
            *extra,
            F.explode(F.expr(f"sequence(0L, {fan - 1}L)")).alias("cell_id"),
            F.lit(0.0).alias("base"),
        )
    bound = limits.QUERY_BLOCK_BYTES
    packs_needed = max(1, -(-probes.count() // limits.PACK_QUERIES))
    packs = (
        wanted.withColumn("pack", F.pmod(F.xxhash64("qid"), F.lit(packs_needed)))
        .groupBy("cell_id", "pack")
        .agg(F.collect_list(F.struct("qid", "qvec", "base", *extra)).alias("members"))
    )

    dtype = scores.dtype

    def run(batches):
        # One sink for the whole task: at most k rows per query leave it, unless memory makes it send early.
        nobody = np.zeros(0, dtype="int64")
        sink = make_sink(nobody, [])
        for batch in batches:
            columns = [batch.column(c) for c in ("cell_id", "item_ids", "data", "flags", "members")]
            for cell, item_ids, data, flags, members in zip(*columns):
                ids = np.asarray(item_ids.values).astype("int64")
                rows = np.asarray(data.values).astype(dtype).reshape(len(ids), -1)
                struct = members.values
                qids = np.asarray(struct.field("qid")).astype("int64")
                queries = matrix_of(struct.field("qvec"))
                base = np.asarray(struct.field("base")).astype("float64")
                marks = None
                if marked:
                    marks = list(
                        zip(struct.field("mark_sims").to_pylist(), struct.field("mark_ids").to_pylist())
                    )
                which = sink.places(qids, marks)
                if bounded:
                    sink.raise_floor(which, np.asarray(struct.field("least")).astype("float64"))
                sims = scores.score(scores.prepare(queries), rows, base)
                sink.offer(which, ids, sims, flags_of(flags.values), cell.as_py())
                if sink.bytes > bound:
                    yield sink.result()
                    sink = make_sink(nobody, [])
        yield sink.result()

    return (
        _chunks(vectors, scores)
        .join(packs, "cell_id")
        .select("cell_id", "item_ids", "data", "flags", "members")
        .mapInArrow(run, schema)
    )


# ------------------------------------------------------------------------------------------------- operators


def _run(vectors, probes, scores, make_sink, schema, k: int, dim: int, width: int, block_bytes=None) -> DataFrame:
    per_query = 8 * dim + 96 * k + scores.bytes_per_query
    block = limits.QUERY_BLOCK_BYTES if block_bytes is None else block_bytes
    bound = limits.rows_within(block, per_query + PROBE_BYTES * width) if block else 0
    head = probes.limit(bound + 1).toArrow()
    if head.num_rows <= bound:
        return _scan(vectors, _block_of(head), scores, make_sink, schema)
    if "cells" in probes.columns:
        # Probe lists are often far shorter than `width`: measure them before giving up the broadcast.
        rows, cells = probes.agg(F.count(F.lit(1)), F.sum(F.size("cells"))).head()
        size = rows * per_query + cells * PROBE_BYTES
        if block and size <= block:
            return _scan(vectors, _block_of(probes.toArrow()), scores, make_sink, schema)
        blocks = -(-size // block) if block else MOST_BLOCKS + 1
        if blocks <= MOST_BLOCKS:
            return _block_scans(vectors, probes, scores, make_sink, schema, blocks, max(1, rows // blocks))
    return _joined_scan(vectors, probes, scores, make_sink, schema)


def _block_scans(vectors, probes, scores, make_sink, schema, blocks: int, rows: int) -> DataFrame:
    """Blocks of queries one after the other, each broadcast to a scan of the cells it probes. Queries with the same
    nearest cell share a block, so most cells are read for few blocks, and no vector is shuffled."""
    ranged = probes.repartitionByRange(blocks, F.get("cells", F.lit(0)), "qid").withColumn("block", F.spark_partition_id())
    ranged = cut(ranged)
    found = []
    for b in range(blocks):
        table = ranged.filter(F.col("block") == b).drop("block").toArrow()
        # A sampled range may hold somewhat more than its share.
        for at in range(0, table.num_rows, 2 * rows):
            part = _block_of(table.slice(at, 2 * rows))
            found.append(cut(_scan(vectors, part, scores, make_sink, schema)))
    if not found:
        return vectors.sparkSession.createDataFrame([], schema)
    return functools.reduce(DataFrame.unionByName, found)


def _with_least(vectors: DataFrame, probes: DataFrame, k: int, scores, dim: int, width: int, block_bytes: int | None) -> DataFrame:
    """Probes with `least`: the kth similarity among a share of the vectors, which the kth of all can't be below."""
    share = vectors.filter(F.pmod(F.xxhash64("item_id"), F.lit(CUTOFF_SHARE)) == 0)
    found = _run(share, probes, scores, lambda qids, marks: BestPerQuery(qids, k), BEST_SCHEMA, k, dim, width, block_bytes)
    kth = rank_per_query(found, k, scan_tasks(vectors)).filter(F.col("rank") == k).select("qid", F.col("similarity").alias("least"))
    return cut(probes.join(kth, "qid", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf")))))


def best_per_query(
    vectors: DataFrame,
    probes: DataFrame,
    k: int,
    scores=None,
    *,
    dim: int = 1024,
    width: int = 0,
    block_bytes: int | None = None,
) -> DataFrame:
    """Top-k rows per query as (qid, item_id, [cell_id], similarity, passes, rank).

    A boolean column `passes` of the vectors is handed through (true without one). `probes` has one row per query: qid bigint, qvec array, and optionally cells array<bigint> with
    cell_sims array<double>; without cells every vector is scored. `width` bounds the cells per query,
    `block_bytes` (QUERY_BLOCK_BYTES unless given) the query block that may be broadcast.

    Where tasks could send more than CUTOFF_ROWS rows of one query, a light pass over a share of the vectors first
    finds a similarity that k rows are known to reach; tasks send no row below it.
    """
    scores = scores or ExactScores()
    if k * scan_tasks(vectors) > CUTOFF_ROWS:
        probes = _with_least(vectors, cut(probes), k, scores, dim, width, block_bytes)
    found = _run(
        vectors, probes, scores, lambda qids, marks: BestPerQuery(qids, k), BEST_SCHEMA, k, dim, width, block_bytes
    )
    return rank_per_query(found if "cells" in probes.columns else found.drop("cell_id"), k, scan_tasks(vectors))


def scan_tasks(df: DataFrame) -> int:
    """About how many tasks read df: its size and files over the split size, at least one per core."""
    spark = df.sparkSession
    plan = df._jdf.queryExecution().optimizedPlan()
    conf = spark._jsparkSession.sessionState().conf()
    size = int(str(plan.stats().sizeInBytes()))
    if size >= 1 << 62:  # Spark's word for unknown
        return limits.MANY_TASKS
    files = len(df.inputFiles()) * conf.filesOpenCostInBytes()
    return max(spark.sparkContext.defaultParallelism, -(-(size + files) // conf.filesMaxPartitionBytes()))


def rank_per_query(found: DataFrame, k: int, tasks: int | None = None) -> DataFrame:
    """Keep and number the best k rows per query.

    Every one of the `tasks` scoring tasks (unknown: one per core) sends up to k rows per query. Where that is a lot
    for one task, the lists of MERGED_TASKS tasks at a time are merged first.
    """
    order = [F.col("similarity").desc(), F.col("item_id")]
    if k * (tasks or found.sparkSession.sparkContext.defaultParallelism) > MERGE_AT_ONCE:
        salted = Window.partitionBy("qid", "salt").orderBy(*order)
        found = (
            found.withColumn("salt", F.floor(F.spark_partition_id() / MERGED_TASKS))
            .withColumn("rank", F.row_number().over(salted))
            .filter(F.col("rank") <= k)
            .drop("salt", "rank")
        )
    by_query = Window.partitionBy("qid").orderBy(*order)
    return found.withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") <= k)


def global_positions(
    vectors: DataFrame, probes: DataFrame, best: DataFrame, scores=None, *, k: int, dim: int, width: int
) -> DataFrame:
    """Add to `best` the position each row has among *all* scored rows of its query.

    Only counts between consecutive marks travel, so the position of a row far down the list costs no more
    than that of the first.
    """
    scores = scores or ExactScores()
    marks = (
        best.groupBy("qid")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "similarity", "item_id"))).alias("m"))
        .select(
            "qid",
            F.col("m.similarity").alias("mark_sims"),
            F.col("m.item_id").alias("mark_ids"),
        )
    )
    marked = probes.join(marks, "qid")
    counts = _run(vectors, marked, scores, SlotCounts, SLOT_SCHEMA, k, dim, width)
    by_query = Window.partitionBy("qid").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    slots = (
        counts.groupBy("qid", "slot")
        .agg(F.sum("n").alias("n"))
        .withColumn("position", F.sum("n").over(by_query))
        .select("qid", (F.col("slot") + 1).alias("rank"), "position")
    )
    return best.join(slots, ["qid", "rank"])


def exact_knn(
    vectors: DataFrame, queries: DataFrame, k: int, dim: int = 1024, block_bytes: int | None = None
) -> DataFrame:
    """Exact cosine top-k of every query (qid, qvec) over all unit vectors (item_id, embedding)."""
    return best_per_query(vectors, unit_queries(queries), k, dim=dim, block_bytes=block_bytes).drop("passes")


def unit_queries(queries: DataFrame) -> DataFrame:
    return queries.select("qid", l2_normalize("qvec").alias("qvec"))


# ------------------------------------------------------------------------------------------ sums of whole arrays


def sum_arrays(partial: DataFrame, keys: list[str]) -> DataFrame:
    """Merge partial sums (keys, n, sums array<double>) from many tasks, in salted groups first, so that no
    group holds more than a share of one row per task."""

    def merge(table: pa.Table) -> pa.Table:
        first = [table.column(k).slice(0, 1) for k in keys]
        total = matrix_of(table.column("sums")).sum(axis=0)
        n = pa.array([pc.sum(table.column("n")).as_py()], pa.int64())
        return pa.table([*first, n, pa.array([total.tolist()], pa.list_(pa.float64()))], [*keys, "n", "sums"])

    schema = partial.select(*keys, "n", "sums").schema
    salted = partial.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(32)))
    return salted.groupBy(*keys, "salt").applyInArrow(merge, schema).groupBy(*keys).applyInArrow(merge, schema)
