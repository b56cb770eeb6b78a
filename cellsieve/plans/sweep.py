"""A whole evaluation grid at once: every query with every predicate list, k and method from one scan of the vectors."""

from __future__ import annotations

import functools
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellsieve import limits
from cellsieve.operators.histogram import Histogram2D
from cellsieve.operators.ivf import IvfIndex
from cellsieve.operators.predicates import Predicate, conditions
from cellsieve.operators.scoring import ExactScores, ROW_BYTES, scan_tasks, unit_queries
from cellsieve.operators.tiered import ALL_CELLS, EVERY_ROW, FRESH_ROWS, Parts, Pool, Tier, TieredBlock, answer_pools, block_of, needed_tiers, tiered_pools
from cellsieve.plans import probing
from cellsieve.plans.hybrid import ADAP_POS, ADAP_PRE, BASE_POS, BASE_PRE, METHODS, post_filter_search
from cellsieve.plans.workload import LISTS_PER_SCAN
from cellsieve.session import cut

# Candidate lists of the post methods up to this length are kept in the scan.
SWEEP_CANDIDATES = 1_000_000
SWEEP_SCHEMA = "qid bigint, wid int, k int, method string, rank int, item_id bigint, similarity double, is_k boolean"
# One row per entry: its hits, best first, or NULL where rounds of more candidates are due. Rows lie in such tables until
# they are wanted one by one.
ENTRY_SCHEMA = "qid bigint, wid int, k int, method string, is_k boolean, hits array<struct<item_id: bigint, similarity: double>>"
HIT = pa.struct([("item_id", pa.int64()), ("similarity", pa.float64())])
# Widths whose rows are kept while the rounds of a query are walked through, and entries sent at once.
WIDTHS_KEPT = 8
TIER_BYTES = 200
ENTRIES_AT_ONCE = 32


def sweep_search(
    index: IvfIndex,
    queries: DataFrame,
    lists: Mapping[int, list[Predicate]],
    ks: Sequence[int],
    methods: Sequence[str] = METHODS,
    histogram: Histogram2D | None = None,
    candidates: int | None = None,
    block_bytes: int | None = None,
) -> DataFrame:
    """SWEEP_SCHEMA: what `filtered_search` finds for every query, predicate list (wid), k and method.

    The lists are bits of a vector. Survivors per cell and list, counted in one scan of the metadata, settle the probe
    widths of the pre methods; each width, and each round of the post methods, is a tier of the query's pools, which one scan
    of the vectors fills: LISTS_PER_SCAN lists and the queries of a block (`block_bytes`, else QUERY_BLOCK_BYTES) at a
    time, whatever the number of k and methods. Post entries with rounds of more than `candidates` candidates are searched
    one by one. Vectors must carry the tested columns.
    """
    unknown = set(methods) - set(METHODS)
    if unknown:
        raise ValueError(f"invalid method: {', '.join(sorted(unknown))}")
    if ADAP_POS in methods and histogram is None:
        raise ValueError(f"{ADAP_POS} sizes its rounds with a histogram")
    most = SWEEP_CANDIDATES if candidates is None else candidates
    unit = cut(unit_queries(queries))
    n = unit.count()
    at_once = min(LISTS_PER_SCAN, limits.rows_within(limits.MATRIX_BYTES, 8 * index.nlist))
    ids = sorted(lists)
    parts = []
    for at in range(0, len(ids), at_once):
        grid = Grid.of(index, {w: lists[w] for w in ids[at : at + at_once]}, ks, methods, histogram, most)
        size = limits.QUERY_BLOCK_BYTES if block_bytes is None else block_bytes
        blocks = -(-n // limits.rows_within(size, grid.query_bytes(index.dim)))
        for b in range(blocks):
            block = unit if blocks == 1 else unit.filter(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b)
            parts += grid.search(index, block)
    empty = unit.sparkSession.createDataFrame([], SWEEP_SCHEMA)
    return functools.reduce(DataFrame.unionByName, parts) if parts else empty


class Grid:
    """The predicate lists of one scan with what the methods need to know of them."""

    def __init__(self, lists, ks, methods, histogram, most, nlist, total, cells, counts, estimates):
        self.lists, self.ks, self.methods, self.histogram, self.most = lists, sorted(set(ks)), tuple(methods), histogram, most
        self.nlist, self.total, self.cells, self.counts, self.estimates = nlist, total, cells, counts, estimates

    @classmethod
    def of(cls, index: IvfIndex, lists, ks, methods, histogram, most) -> Grid:
        estimates = {}
        if ADAP_POS in methods:
            estimates = {w: histogram.estimate([p for p in own if p.key != "item_id"]) for w, own in lists.items()}
        marked, passes = conditions(index.vectors, lists)
        counted = marked.groupBy("cell_id").agg(*[F.count_if(passes[w]).alias(f"w{w}") for w in lists]).toArrow()
        cells = counted.column("cell_id").to_numpy().astype("int64")
        order = np.argsort(cells)
        counts = {w: counted.column(f"w{w}").to_numpy()[order] for w in lists}
        return cls(lists, ks, methods, histogram, most, index.nlist, index.total, cells[order], counts, estimates)

    def query_bytes(self, dim: int) -> int:
        """What one query takes in a task besides its pool, which is sent when the pools of a task are full: its vector,
        cells, tiers and the rows of a pool that was never settled."""
        tiers = len(self.lists) * len(self.ks) * (len(self.methods) + 1)
        return 8 * dim + 32 * self.nlist + TIER_BYTES * tiers + 2 * ROW_BYTES * FRESH_ROWS * (len(self.lists) + 1)

    def rule(self, w: int, k: int, method: str) -> probing.PostRule:
        return probing.PostRule(k, self.estimates[w] if method == ADAP_POS else None, self.nlist, self.total)

    def widths(self, near: np.ndarray) -> dict[tuple[int, int, str], int]:
        """The final probe width of each pre entry (list, k, method) with survivors, for one order of cells."""
        out = {}
        place = np.searchsorted(self.cells, near)
        held = (place < len(self.cells)) & (self.cells[np.minimum(place, len(self.cells) - 1)] == near) if len(self.cells) else np.zeros(len(near), bool)
        for w, counts in self.counts.items():
            seen = np.cumsum(np.where(held, counts[np.minimum(place, len(counts) - 1)] if len(counts) else 0, 0))
            if not len(seen) or not seen[-1]:
                continue
            for method in {BASE_PRE, ADAP_PRE} & set(self.methods):
                for k in self.ks:
                    out[w, k, method] = probing.settled_width(self.nlist, k, method == ADAP_PRE)(seen)
        return out

    @functools.cached_property
    def post_tiers(self) -> dict[tuple[int, int, str], list[Tier]]:
        return {(w, k, m): self.rule(w, k, m).tiers(self.most) for m in self.methods if m in (BASE_POS, ADAP_POS) for w in self.lists for k in self.ks}

    def parts(self, widths: Mapping[tuple[int, int, str], int]) -> Parts:
        """The tiers of one query: pre widths and searches of all cells by list, rounds over all rows."""
        bit = {w: b for b, w in enumerate(self.lists)}
        wanted: dict[int, list[Tier]] = {}
        for (w, k, _), width in widths.items():
            outer = ALL_CELLS if width >= self.nlist else width
            wanted.setdefault(bit[w], []).append(Tier(outer, outer, k))
        for (w, k, _), tiers in self.post_tiers.items():
            wanted.setdefault(bit[w], []).append(Tier(ALL_CELLS, ALL_CELLS, k))
            wanted.setdefault(EVERY_ROW, []).extend(tiers)
        return {part: kept for part, tiers in wanted.items() if (kept := needed_tiers(tiers))}

    def search(self, index: IvfIndex, unit: DataFrame) -> list[DataFrame]:
        spark = unit.sparkSession
        head = index.probe(unit, self.nlist).toArrow()
        if not head.num_rows:
            return []
        widths = [self.widths(np.asarray(cells.values)) for cells in head.column("cells")]
        block = block_of(head, [self.parts(w) for w in widths])
        marked, passes = conditions(index.vectors, self.lists)
        flags = [F.when(passes[w], F.lit(1 << b).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for b, w in enumerate(self.lists)]
        bits = functools.reduce(lambda a, b: a.bitwiseOR(b), flags)
        pools = tiered_pools(marked.withColumn("bits", bits), block, ExactScores())
        found = answer_pools(pools, block, self.answers(block, widths), ENTRY_SCHEMA, scan_tasks(index.vectors))
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
        # Few queries may have very many hits: their entries are dealt to all tasks.
        found = found.repartition(tasks)
        due = []
        if any(self.rule(*entry).clipped(tiers) for entry, tiers in self.post_tiers.items()):
            found = cut(found)
            due = found.filter("hits IS NULL").select("wid", "k", "method").distinct().collect()
        hits = found.filter("hits IS NOT NULL").select("qid", "wid", "k", "method", "is_k", F.posexplode("hits").alias("pos", "hit"))
        ranked = {"rank": F.col("pos") + 1, "item_id": F.col("hit.item_id"), "similarity": F.col("hit.similarity")}
        columns = spark.createDataFrame([], SWEEP_SCHEMA).columns
        out = [hits.withColumns(ranked).select(*columns)]
        for w, k, method in due:
            open_ = found.filter(f"hits IS NULL AND wid = {w} AND k = {k} AND method = '{method}'").select("qid")
            one = unit.join(open_, "qid", "left_semi")
            again = post_filter_search(index, one, self.lists[w], k, self.histogram if method == ADAP_POS else None)
            named = {"wid": F.lit(w).cast("int"), "k": F.lit(k).cast("int"), "method": F.lit(method)}
            out.append(again.withColumns(named).select(*columns))
        return out

    def answers(self, block: TieredBlock, widths: list[Mapping]):
        """The function that answers all entries of a query from its pools."""
        qids, bit = block.qids, {w: b for b, w in enumerate(self.lists)}
        tiers, rules, most = self.post_tiers, {e: self.rule(*e) for e in self.post_tiers}, self.most

        def entries(query: int, found: Mapping[int, Pool]) -> Iterator[tuple[tuple[int, int, str], Pool, np.ndarray | None]]:
            """(entry, pool, its hits there); None where a round is due."""
            cells = len(block.cells[query])
            for entry, width in widths[query].items():
                pool = found[bit[entry[0]]]
                yield entry, pool, np.flatnonzero(pool.cell_rank < width)[: entry[1]] if width < cells else np.arange(min(entry[1], len(pool.item_id)))
            if not rules:
                return
            every = found.get(EVERY_ROW)
            ranks = np.zeros(0, np.int64) if every is None else every.cell_rank
            # No round has more than `most` candidates.
            near = functools.lru_cache(WIDTHS_KEPT)(lambda nprobe: np.flatnonzero(ranks < nprobe)[:most].copy())
            of, passes = None, np.zeros(0, bool)
            for entry, rule in rules.items():
                w, k, _ = entry
                if every is not None and of != w:
                    of, passes = w, (every.bits >> bit[w] & 1).astype(bool)
                walk = rule.walk(ranks, passes, tiers[entry], near)
                if walk.hits is not None:
                    yield entry, every, walk.hits
                elif walk.nprobe < rule.nlist:
                    yield entry, every, None
                else:
                    pool = found[bit[w]]
                    yield entry, pool, np.arange(min(k, len(pool.item_id)))

        def table(query: int, some: list) -> pa.Table:
            empty = np.zeros(0, np.int64)
            sizes = [0 if hits is None else len(hits) for _, _, hits in some]
            ids = np.concatenate([empty, *[pool.item_id[hits] for _, pool, hits in some if hits is not None]])
            sims = np.concatenate([np.zeros(0), *[pool.similarity[hits] for _, pool, hits in some if hits is not None]])
            pairs = pa.StructArray.from_arrays([pa.array(ids), pa.array(sims)], fields=list(HIT))
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32(), mask=np.array([h is None for _, _, h in some] + [False]))
            return pa.table(
                {
                    "qid": np.full(len(some), qids[query]),
                    "wid": pa.array([e[0] for e, _, _ in some], pa.int32()),
                    "k": pa.array([e[1] for e, _, _ in some], pa.int32()),
                    "method": pa.array([e[2] for e, _, _ in some], pa.string()),
                    "is_k": pa.array([n == e[1] for (e, _, _), n in zip(some, sizes)]),
                    "hits": pa.ListArray.from_arrays(offsets, pairs),
                }
            )

        def answer(query: int, found: Mapping[int, Pool]) -> Iterator[pa.Table]:
            held = []
            for entry, pool, hits in entries(query, found):
                if hits is None or len(hits):
                    held.append((entry, pool, hits))
                if len(held) == ENTRIES_AT_ONCE:
                    yield table(query, held)
                    held = []
            if held:
                yield table(query, held)

        return answer
