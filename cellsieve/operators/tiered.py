"""One pass over the vectors for searches of several widths.

A query ranks the cells by nearness. A *tier* asks for the best `cap` rows of its nearest cells: the rows of the `outer`
nearest cells that have fewer than `cap` better ones within the `inner` nearest. With inner = outer that is a plain top
list; with inner < outer it holds every top list of up to `cap` rows whose width lies between the two, for widths that
are not known beforehand. All tiers of a query share one pool of rows, so narrower and wider searches, and smaller and
larger k, are answered from one scan.

A query may have several *parts*: part -1 is about all rows, part b only about rows whose bit b is set. A row that
several parts keep is held and sent once. Pools leave a task when they are full or it ends, are merged for MERGED_TASKS
tasks at a time, then by query.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellsieve import limits
from cellsieve.operators.scoring import MERGED_TASKS, ROW_BYTES, matrix_of, within_cells

EVERY_ROW = -1
UNPROBED = np.iinfo(np.int32).max - 1
ALL_CELLS = UNPROBED + 1
# Rows of a pool travel packed with the number of their query in its block: Spark handles one row for PACKED of them.
POOL_SCHEMA = "query int, similarity binary, item_id binary, cell_rank binary, bits binary"
POOL_TYPES = {"similarity": np.float64, "item_id": np.int64, "cell_rank": np.int32, "bits": np.int64}
PACKED = 512
# Rows that a part may add before a pool is settled; tasks per core that groups are dealt to.
FRESH_ROWS = 256
GROUP_TASKS = 4
# Queries of more parts than this meet rows one part after the other, not all parts as one matrix.
MANY_PARTS = 8
# Pools are left as they are where a tier that isn't full keeps more than this share of them.
WORTH_SETTLING = 0.9


class Tier(NamedTuple):
    inner: int
    outer: int
    cap: int


Parts = Mapping[int, tuple[Tier, ...]]


def needed_tiers(tiers: Iterable[Tier]) -> tuple[Tier, ...]:
    """The tiers without those whose rows another one keeps anyway."""
    kept: list[Tier] = []
    for t in sorted(set(tiers), key=lambda t: (t.inner, -t.outer, -t.cap)):
        if not any(o.inner <= t.inner and o.outer >= t.outer and o.cap >= t.cap for o in kept):
            kept.append(t)
    return tuple(kept)


def settled(sims: np.ndarray, ids: np.ndarray, ranks: np.ndarray, tiers: tuple[Tier, ...]) -> tuple[np.ndarray, list[float]]:
    """Which rows some tier keeps, best first, and the similarity that a further row needs in each tier."""
    order = np.lexsort((ids, -sims))
    keep, floors = _kept(sims[order], ranks[order], tiers)
    return order[keep], floors


def _kept(sims: np.ndarray, ranks: np.ndarray, tiers: tuple[Tier, ...]) -> tuple[np.ndarray, list[float]]:
    """`settled` of rows that come best first: a mark per row."""
    keep, floors = np.zeros(len(sims), bool), []
    for tier in tiers:
        if len(sims) <= tier.cap:
            # Even the worst row has fewer better ones than the tier holds.
            keep |= ranks < tier.outer
            inner = int(np.count_nonzero(ranks < tier.inner)) if len(sims) == tier.cap else 0
            floors.append(float(sims[-1]) if tier.cap and inner == tier.cap else -np.inf)
            continue
        inner = ranks < tier.inner
        better = np.cumsum(inner)
        last = int(np.searchsorted(better, tier.cap)) if tier.cap else 0
        # Up to the row that fills the tier, all have fewer better ones.
        keep[: last + 1] |= ranks[: last + 1] < tier.outer if tier.cap else False
        floors.append(float(sims[last]) if last < len(sims) else -np.inf)
    return keep, floors


def settled_parts(sims: np.ndarray, ids: np.ndarray, ranks: np.ndarray, bits: np.ndarray, parts: Parts) -> tuple[np.ndarray, dict[int, list[float]]]:
    """Which rows some part of a query keeps, and the floors of each part's tiers. While a tier over all rows isn't full,
    hardly a row could go: all stay, and no floor is worked out."""
    unfilled = max((t.outer for t in parts.get(EVERY_ROW, ()) if t.cap >= len(sims)), default=0)
    if np.count_nonzero(ranks < unfilled) > WORTH_SETTLING * len(ranks):
        return np.arange(len(ranks)), {}
    order = np.lexsort((ids, -sims))
    sims, ranks, bits = sims[order], ranks[order], bits[order]
    keep, floors = np.zeros(len(order), bool), {}
    for part, tiers in parts.items():
        if part == EVERY_ROW:
            own, floors[part] = _kept(sims, ranks, tiers)
            keep |= own
            continue
        rows = np.flatnonzero(bits >> part & 1)
        own, floors[part] = _kept(sims[rows], ranks[rows], tiers)
        keep[rows[own]] = True
    return order[keep], floors


class TierPools:
    """The pools of a block of queries within one task, one for all parts of a query."""

    def __init__(self, parts: list[Parts]):
        self.parts = parts
        self.names = [(q, part) for q, own in enumerate(parts) for part in sorted(own)]
        self.first = np.searchsorted([q for q, _ in self.names], np.arange(len(parts) + 1))
        self.bit = np.array([part for _, part in self.names], np.int64)
        tiers = [parts[q][part] for q, part in self.names]
        deepest = max([1, *map(len, tiers)])
        self.outer = np.full((len(self.names), deepest), -1, np.int64)
        for g, own in enumerate(tiers):
            self.outer[g, : len(own)] = [t.outer for t in own]
        self.floor = np.full((len(self.names), deepest), -np.inf)
        self.pool: list[list[tuple[np.ndarray, ...]]] = [[] for _ in parts]
        self.held = np.zeros(len(parts), np.int64)
        self.due = FRESH_ROWS * np.diff(self.first)

    @property
    def bytes(self) -> int:
        return int(self.held.sum()) * ROW_BYTES

    def offer(self, which: np.ndarray, ids: np.ndarray, sims: np.ndarray, ranks: np.ndarray, bits: np.ndarray) -> None:
        """Rows with their similarities and cell ranks for the queries `which` (queries x rows)."""
        sizes = self.first[which + 1] - self.first[which]
        many = sizes > MANY_PARTS
        if many.any():
            for n in np.flatnonzero(many).tolist():
                self._offer_one(int(which[n]), ids, sims[n], ranks[n], bits)
            if many.all():
                return
            which, sims, ranks, sizes = which[~many], sims[~many], ranks[~many], sizes[~many]
        row = np.repeat(np.arange(len(which)), sizes)
        groups = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + self.first[which][row]
        step = max(64, limits.TILE_ENTRIES // max(1, len(groups)))
        for at in range(0, len(ids), step):
            part = slice(at, at + step)
            self._offer(groups, row, which, ids[part], sims[:, part], ranks[:, part], bits[part])

    def _offer_one(self, q: int, ids, sims, ranks, bits) -> None:
        """The same for one query of many parts: a row that one of them keeps is not held against the others."""
        open_ = np.ones(len(ids), bool)
        wanted = np.zeros(len(ids), bool)
        for g in range(self.first[q], self.first[q + 1]):
            part = self.names[g][1]
            some = np.flatnonzero(open_ if part == EVERY_ROW else open_ & (bits >> part & 1).astype(bool))
            if not len(some):
                continue
            own_sims, own_ranks = sims[some], ranks[some]
            hits = np.zeros(len(some), bool)
            for floor, outer in zip(self.floor[g].tolist(), self.outer[g].tolist()):
                if outer < 0:
                    break
                hits |= (own_sims >= floor) & (own_ranks < outer)
            kept = some[hits]
            wanted[kept], open_[kept] = True, False
        self._hold(q, np.flatnonzero(wanted), ids, sims, ranks, bits)

    def _hold(self, q: int, wanted, ids, sims, ranks, bits) -> None:
        if not len(wanted):
            return
        self.pool[q].append((sims[wanted], ids[wanted], ranks[wanted], bits[wanted]))
        self.held[q] += len(wanted)
        if self.held[q] >= self.due[q]:
            self._settle(q)

    def _offer(self, groups, row, which, ids, sims, ranks, bits) -> None:
        if not len(groups):
            return
        hits = np.zeros((len(groups), len(ids)), bool)
        for t in range(self.outer.shape[1]):
            used = np.flatnonzero(self.outer[groups, t] >= 0)
            if not len(used):
                continue
            g, r = groups[used], row[used]
            hits[used] |= (sims[r] >= self.floor[g, t][:, None]) & (ranks[r] < self.outer[g, t][:, None])
        for b in np.unique(self.bit[groups]).tolist():
            if b != EVERY_ROW:
                hits[self.bit[groups] == b] &= (bits >> b & 1).astype(bool)
        starts = np.flatnonzero(np.diff(row, prepend=-1))
        for n, mask in zip(row[starts].tolist(), np.logical_or.reduceat(hits, starts, axis=0)):
            self._hold(int(which[n]), np.flatnonzero(mask), ids, sims[n], ranks[n], bits)

    def _settle(self, q: int) -> None:
        columns = [np.concatenate(c) for c in zip(*self.pool[q])]
        keep, floors = settled_parts(*columns, self.parts[q])
        self.pool[q] = [tuple(c[keep] for c in columns)]
        for g in range(self.first[q], self.first[q + 1]):
            own = floors.get(self.names[g][1], [])
            self.floor[g, : len(own)] = np.maximum(self.floor[g, : len(own)], own)
        self.held[q] = len(keep)
        self.due[q] = 2 * len(keep) + FRESH_ROWS * (self.first[q + 1] - self.first[q])

    def result(self) -> pa.RecordBatch:
        """What is held, which goes from here; the floors stay, since the rows that prove them are sent."""
        full = np.flatnonzero(self.held).tolist()
        for q in full:
            self._settle(q)
        found = _packed([(q, self.pool[q][0]) for q in full])
        for q in full:
            self.pool[q], self.held[q], self.due[q] = [], 0, FRESH_ROWS * (self.first[q + 1] - self.first[q])
        return found


def _packed(pools: list[tuple[int, tuple[np.ndarray, ...]]]) -> pa.RecordBatch:
    """POOL_SCHEMA rows of the pools (similarity, item_id, cell_rank, bits) of queries."""
    parts = [(q, slice(at, at + PACKED), pool) for q, pool in pools for at in range(0, len(pool[0]), PACKED)]
    columns = [pa.array([q for q, _, _ in parts], pa.int32())]
    for c, kind in enumerate(POOL_TYPES.values()):
        columns.append(pa.array([pool[c][part].astype(kind).tobytes() for _, part, pool in parts], pa.binary()))
    return pa.RecordBatch.from_arrays(columns, ["query", *POOL_TYPES])


def unpacked(table: pa.Table) -> list[np.ndarray]:
    """similarity, item_id, cell_rank and bits of all rows of POOL_SCHEMA rows."""
    return [np.frombuffer(b"".join(table.column(c).to_pylist()), kind) for c, kind in POOL_TYPES.items()]


@dataclass(frozen=True)
class TieredBlock:
    """Queries on the driver within a checked bound. cells: of each query the nearest cells in order, as many as
    its tiers use, with the similarities to their centroids; parts: the tiers of each query."""

    qids: np.ndarray
    vectors: np.ndarray
    cells: list[np.ndarray]
    cell_sims: list[np.ndarray]
    parts: list[Parts]

    @property
    def pruned(self) -> bool:
        """Whether rows outside the named cells are wanted by nobody."""
        return all(t.outer < ALL_CELLS for own in self.parts for tiers in own.values() for t in tiers)


def query_bytes(dim: int, width: int, parts: Parts) -> int:
    """What one query takes in a task: vector, cells, and pools before they settle."""
    return 8 * dim + 32 * width + sum(2 * t.cap * ROW_BYTES for tiers in parts.values() for t in tiers)


def block_of(table: pa.Table, parts: list[Parts]) -> TieredBlock:
    """From rows (qid, qvec, cells, cell_sims)."""
    split = lambda name: [np.asarray(v.values) for v in table.column(name)]
    return TieredBlock(
        table.column("qid").to_numpy().astype("int64"), matrix_of(table.column("qvec")), split("cells"), split("cell_sims"), parts
    )


def tiered_pools(vectors: DataFrame, block: TieredBlock, scores) -> DataFrame:
    """POOL_SCHEMA rows of every task: what some tier of a query keeps. vectors: item_id, cell_id, the column of
    `scores`, bits bigint. Only the probed cells are read, unless a tier wants all."""
    data_column, dtype, exact = scores.column, scores.dtype, scores.column == "embedding"
    pruned = block.pruned
    if pruned:
        named = np.unique(np.concatenate([np.zeros(0, np.int64), *block.cells])).tolist()
        vectors = within_cells(vectors, named)
    shared = vectors.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        own: TieredBlock = shared.value
        prepared, pools = scores.prepare(own.vectors), TierPools(own.parts)
        everyone = np.arange(len(own.qids))
        who = np.repeat(everyone, [len(c) for c in own.cells])
        flat = np.concatenate([np.zeros(0, np.int64), *own.cells]).astype(np.int64)
        near = np.concatenate([np.zeros(0), *own.cell_sims])
        place = np.concatenate([np.zeros(0, np.int64), *[np.arange(len(c)) for c in own.cells]]).astype(np.int64)
        order = np.argsort(flat, kind="stable")
        flat, who, near, place = flat[order], who[order], near[order], place[order]
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.asarray(batch.column("item_id")).astype("int64")
            data = matrix_of(batch.column(data_column), dtype)
            bits = np.asarray(batch.column("bits")).astype("int64")
            names, owner = np.unique(np.asarray(batch.column("cell_id")).astype("int64"), return_inverse=True)
            low, high = np.searchsorted(flat, names), np.searchsorted(flat, names, side="right")
            if exact and (not pruned or len(everyone) * len(ids) <= limits.TILE_ENTRIES):
                step = max(64, limits.TILE_ENTRIES // len(everyone))
                rank_of = np.full((len(everyone), len(names)), UNPROBED, np.int64)
                for n, (a, b) in enumerate(zip(low, high)):
                    rank_of[who[a:b], n] = place[a:b]
                for at in range(0, len(ids), step):
                    part = slice(at, at + step)
                    pools.offer(everyone, ids[part], scores.score(prepared, data[part], None), rank_of[:, owner[part]], bits[part])
                if pools.bytes > limits.QUERY_BLOCK_BYTES:
                    yield pools.result()
                continue
            by_cell = np.argsort(owner, kind="stable")
            for n, rows in enumerate(np.split(by_cell, np.searchsorted(owner[by_cell], np.arange(1, len(names))))):
                a, b = low[n], high[n]
                if a == b:
                    continue
                which = who[a:b]
                step = max(64, limits.TILE_ENTRIES // len(which))
                for at in range(0, len(rows), step):
                    some = rows[at : at + step]
                    sims = scores.score(prepared[which], data[some], near[a:b])
                    pools.offer(which, ids[some], sims, np.broadcast_to(place[a:b][:, None], sims.shape), bits[some])
            if pools.bytes > limits.QUERY_BLOCK_BYTES:
                yield pools.result()
        yield pools.result()

    wanted = vectors.select("item_id", "cell_id", data_column, "bits").filter(F.col(data_column).isNotNull())
    return wanted.mapInArrow(run, POOL_SCHEMA)


class Pool(NamedTuple):
    """A settled pool, best first."""

    similarity: np.ndarray
    item_id: np.ndarray
    cell_rank: np.ndarray
    bits: np.ndarray


class Pools(Mapping):
    """The pools of a query by part, from its rows best first. Only the last list asked for is held beside all rows."""

    def __init__(self, rows: Pool, parts: Parts):
        self.rows, self.parts, self.last = rows, parts, (EVERY_ROW, rows)

    def __getitem__(self, part: int) -> Pool:
        if part not in self.parts:
            raise KeyError(part)
        if part == EVERY_ROW:
            return self.rows
        if self.last[0] != part:
            own = np.flatnonzero(self.rows.bits >> part & 1)
            self.last = part, Pool(*[c[own] for c in self.rows])
        return self.last[1]

    def __iter__(self) -> Iterator[int]:
        return iter(self.parts)

    def __len__(self) -> int:
        return len(self.parts)


def answer_pools(
    pools: DataFrame, block: TieredBlock, answer: Callable[[int, Mapping[int, Pool]], Iterable[pa.Table]], schema: str, tasks: int
) -> DataFrame:
    """`answer` (query number in the block, its pools by part) for every query that got rows. Pools may hold more rows than
    their tiers ask for. Where more than MERGED_TASKS tasks sent pools, these are merged for so many tasks at a time before
    all of a query's rows meet."""
    shared = pools.sparkSession.sparkContext.broadcast(block.parts)

    def merge(table: pa.Table) -> Iterable[pa.Table]:
        query, values = table.column("query")[0].as_py(), unpacked(table)
        keep = settled_parts(*values, shared.value[query])[0]
        return [pa.Table.from_batches([_packed([(query, tuple(v[keep] for v in values))])])]

    def last(table: pa.Table) -> Iterable[pa.Table]:
        query, values = table.column("query")[0].as_py(), unpacked(table)
        order = np.lexsort((values[1], -values[0]))
        return answer(query, Pools(Pool(*[v[order] for v in values]), shared.value[query]))

    if tasks > MERGED_TASKS:
        salted = pools.withColumn("salt", F.floor(F.spark_partition_id() / MERGED_TASKS).cast("int"))
        pools = by_group(salted, ["query", "salt"], merge, POOL_SCHEMA)
    return by_group(pools, ["query"], last, schema)


def by_group(rows: DataFrame, keys: list[str], f: Callable[[pa.Table], Iterable[pa.Table]], schema: str) -> DataFrame:
    """f of all rows of each key, numbers from 0, which come sorted through one Arrow stream per task. Groups are dealt out
    by number: a few heavy ones don't meet in a task, and small ones are not put together, since what f makes of them may
    be far more."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        current = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k).to_numpy() for k in keys]
            change = np.zeros(batch.num_rows, bool)
            for c in columns:
                change[1:] |= c[1:] != c[:-1]
            starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
            for a, b in zip(starts, starts[1:]):
                key = tuple(c[a] for c in columns)
                if held and key != current:
                    for found in f(pa.Table.from_batches(held)):
                        yield from found.combine_chunks().to_batches()
                    held = []
                current = key
                held.append(batch.slice(a, b - a))
        if held:
            for found in f(pa.Table.from_batches(held)):
                yield from found.combine_chunks().to_batches()

    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), GROUP_TASKS * spark.sparkContext.defaultParallelism)
    place = F.pmod(functools.reduce(operator.add, [F.col(k) for k in keys]), F.lit(tasks))
    return rows.repartitionById(tasks, place).sortWithinPartitions(*keys).mapInArrow(run, schema)
