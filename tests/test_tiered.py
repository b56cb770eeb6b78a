"""Pools of several widths from one scan, against brute force."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from cellsieve import limits
from cellsieve.operators.histogram import Histogram2D
from cellsieve.operators.predicates import Predicate
from cellsieve.operators.scoring import ExactScores, rank_per_query, scan_tasks, unit_queries
from cellsieve.operators.tiered import ALL_CELLS, EVERY_ROW, Tier, TierPools, answer_pools, block_of, needed_tiers, settled, tiered_pools, unpacked
from cellsieve.plans import hybrid, probing
from cellsieve.plans.sweep import SWEEP_SCHEMA, sweep_search

LISTS = {
    1: [Predicate("token_count", 500, "<"), Predicate("revdate", "2024-01-01 02:00", ">=")],
    2: [],
    3: [Predicate("token_count", 1200, ">")],
    7: [Predicate("item_id", list(range(3, 60)), "IN")],
    9: [Predicate("token_count", 1, "<")],
}


@pytest.fixture(scope="module")
def histogram(fine):
    return Histogram2D.build(fine.vectors).collected()


@pytest.mark.parametrize("seed", range(20))
def test_settled_rows_hold_every_list_of_the_tier(seed):
    rng = np.random.default_rng(seed)
    sims, ids, ranks = rng.integers(0, 9, 200) / 9, rng.permutation(200), rng.integers(0, 12, 200)
    tiers = (Tier(2, 5, 7), Tier(6, 6, 3), Tier(ALL_CELLS, ALL_CELLS, 4))
    keep, floors = settled(sims, ids, ranks, tiers)
    kept = set(keep.tolist())
    for inner, outer, cap in tiers:
        for width in range(inner, min(outer, 12) + 1):
            order = [i for i in np.lexsort((ids, -sims)) if ranks[i] < width]
            assert set(order[:cap]) <= kept
    # In parts, what is kept of what was kept is the same.
    first = settled(sims[:90], ids[:90], ranks[:90], tiers)[0]
    again = np.concatenate([first, np.arange(90, 200)])
    assert set(again[settled(sims[again], ids[again], ranks[again], tiers)[0]].tolist()) == kept
    assert len(floors) == 3


def test_needed_tiers():
    assert needed_tiers([Tier(4, 4, 5), Tier(4, 4, 9), Tier(3, 6, 9), Tier(8, 8, 1)]) == (Tier(3, 6, 9), Tier(8, 8, 1))


@pytest.mark.parametrize("tile", [limits.TILE_ENTRIES, 50])
@pytest.mark.parametrize("tasks", [1, 1000])
def test_pools_of_all_parts(fine, queries, local, query_vectors, tile, tasks, monkeypatch):
    monkeypatch.setattr(limits, "TILE_ENTRIES", tile)
    head = fine.probe(unit_queries(queries), 12).toArrow()
    parts = {EVERY_ROW: (Tier(3, 5, 8), Tier(12, 12, 20)), 0: (Tier(6, 6, 4),)}
    block = block_of(head, [parts] * head.num_rows)
    marked = fine.vectors.repartition(7).withColumn("bits", (F.col("token_count") < 300).cast("int").cast("bigint"))

    def answer(query, found):
        for part, pool in found.items():
            n = len(pool.item_id)
            yield pa.table({"qid": np.full(n, block.qids[query]), "part": np.full(n, part, np.int32), "item_id": pool.item_id, "cell_rank": pool.cell_rank})

    pools = tiered_pools(marked, block, ExactScores())
    got = answer_pools(pools, block, answer, "qid bigint, part int, item_id bigint, cell_rank int", tasks).collect()
    cell_of = dict(zip(local["ids"].tolist(), local["cells"].tolist()))
    tokens = dict(zip(local["ids"].tolist(), local["token_count"].tolist()))
    for i, qid in enumerate(block.qids.tolist()):
        rank = {c: n for n, c in enumerate(block.cells[i].tolist())}
        sims = dict(zip(local["ids"].tolist(), np.round(local["vectors"] @ query_vectors[qid], 9).tolist()))
        for part, tiers in parts.items():
            rows = {r["item_id"]: r["cell_rank"] for r in got if r["qid"] == qid and r["part"] == part}
            own = [j for j in sims if rank.get(cell_of[j], 99) < 12 and (part == EVERY_ROW or tokens[j] < 300)]
            own.sort(key=lambda j: (-sims[j], j))
            want = set()
            for inner, outer, cap in tiers:
                for width in range(inner, outer + 1):
                    want |= set([j for j in own if rank[cell_of[j]] < width][:cap])
            assert want <= set(rows)
            assert all(rows[j] == rank[cell_of[j]] for j in rows)


@pytest.mark.parametrize("est", [None, 0, 3, 40, 900, 5000])
@pytest.mark.parametrize("k", [1, 10, 200])
def test_rounds_stay_within_their_tiers(est, k):
    """Whatever the hits of each round, the candidates of the next one were kept."""
    rule = probing.PostRule(k, est, 700, 6000)
    tiers = rule.tiers(10**9)
    rng = np.random.default_rng(1)
    for _ in range(50):
        search_k, nprobe = rule.sizes()
        while nprobe < rule.nlist:
            assert any(t.inner <= nprobe <= t.outer and search_k <= t.cap for t in tiers)
            search_k, nprobe = rule.sizes(int(rng.integers(0, k)), search_k, nprobe)


KS = (1, 6, 90)


@pytest.fixture(scope="module")
def single_searches(fine, queries, histogram):
    found = {}
    for w, predicates in LISTS.items():
        for k in KS:
            for method in hybrid.METHODS:
                want = hybrid.filtered_search(fine, queries, predicates, k, method, histogram).select(*hybrid.RESULT_COLUMNS)
                found[w, k, method] = {tuple(r) for r in want.collect()}
    return found


@pytest.mark.parametrize("block_bytes, candidates", [(None, None), (1, None), (None, 40)])
def test_sweep_equals_single_searches(fine, queries, histogram, single_searches, block_bytes, candidates):
    swept = sweep_search(fine, queries, LISTS, KS, histogram=histogram, candidates=candidates, block_bytes=block_bytes)
    assert swept.dtypes == [tuple(c.split(" ")) for c in SWEEP_SCHEMA.split(", ")]
    got = {entry: set() for entry in single_searches}
    for r in swept.collect():
        got[r["wid"], r["k"], r["method"]].add((r["qid"], r["rank"], r["item_id"], r["similarity"], r["is_k"]))
    assert got == single_searches


def test_scans_do_not_grow_with_entries(spark, fine, queries, histogram):
    def jobs(lists, ks, methods):
        context = spark.sparkContext
        context.setJobGroup("sweep", "sweep")
        sweep_search(fine, queries, lists, ks, methods, histogram).count()
        found = context.statusTracker().getJobIdsForGroup("sweep")
        context.setJobGroup("", "")
        return len(found)

    before = jobs({1: LISTS[1]}, (5,), (hybrid.BASE_PRE,))
    first = jobs({1: LISTS[1], 2: []}, (5,), hybrid.METHODS) - before
    assert jobs(LISTS, (1, 2, 5, 10, 50, 90), hybrid.METHODS) - before - first <= first + 1


def test_sweep_refuses_unknown_methods(fine, queries):
    with pytest.raises(ValueError):
        sweep_search(fine, queries, LISTS, (5,), ("pre_search",))
    with pytest.raises(ValueError):
        sweep_search(fine, queries, LISTS, (5,))


def test_estimates_on_the_driver(spark, histogram):
    from cellsieve.operators.histogram import PREDICATE_STRUCT

    lists = list(LISTS.values()) + [
        [Predicate("token_count", v, op)] for v in (0, 80, 81, 300, 10**6) for op in ("=", "<", ">", "<=", ">=")
    ] + [[Predicate("token_count", [5, 200], "IN"), Predicate("revdate", "2024-01-01", ">")]]
    rows = [(n, [(p.key, p.operator, p.numbers()) for p in own if p.key != "item_id"]) for n, own in enumerate(lists)]
    frame = spark.createDataFrame(rows, f"n int, preds array<{PREDICATE_STRUCT}>")
    want = {r["n"]: r["est"] for r in frame.withColumn("est", histogram.estimate_column("preds")).collect()}
    assert [histogram.estimate([p for p in own if p.key != "item_id"]) for own in lists] == [want[n] for n in range(len(lists))]


def test_scan_tasks_and_salted_ranks(spark, fine, queries):
    assert scan_tasks(fine.vectors) >= spark.sparkContext.defaultParallelism
    rows = spark.range(3000).selectExpr("id % 3 AS qid", "id AS item_id", "(id * 7919 % 1000) / 1000D AS similarity").repartition(90)
    plain = {tuple(r) for r in rank_per_query(rows, 20).select("qid", "rank", "item_id").collect()}
    assert {tuple(r) for r in rank_per_query(rows, 20, 10_000).select("qid", "rank", "item_id").collect()} == plain


def test_rows_of_many_parts_are_sent_once():
    """However many lists want a row, a task holds and sends it once; what is sent early is not lost."""
    rng = np.random.default_rng(5)
    n, parts = 3000, {EVERY_ROW: (Tier(4, 9, 300),)} | {b: (Tier(7, 7, 50), Tier(ALL_CELLS, ALL_CELLS, 80)) for b in range(30)}
    ids, sims, ranks = np.arange(n), np.round(rng.random((2, n)), 2), rng.integers(0, 12, (2, n))
    bits = rng.integers(0, 1 << 30, n) | 1
    whole, early, sent = TierPools([parts, parts]), TierPools([parts, parts]), []
    for at in range(0, n, 500):
        part = slice(at, at + 500)
        for pools in (whole, early):
            pools.offer(np.arange(2), ids[part], sims[:, part], ranks[:, part], bits[part])
        sent.append(early.result())
        assert early.bytes == 0
    batches = [[whole.result()], sent]
    for tables in batches:
        rows = [(q, i) for t in tables for q in range(2) for i in unpacked(pa.Table.from_batches([t]).filter(pc.equal(t["query"], q)))[1].tolist()]
        assert len(rows) == len(set(rows))
        for q in range(2):
            for part, tiers in parts.items():
                own = np.flatnonzero(bits >> part & 1) if part != EVERY_ROW else ids
                kept = own[settled(sims[q][own], own, ranks[q][own], tiers)[0]]
                assert {(q, i) for i in kept.tolist()} <= set(rows)


def test_clipped_rounds():
    """Only where rounds may ask for more candidates than are kept can a search be due once more."""
    rule = probing.PostRule(10, 900, 700, 6000)
    assert not rule.clipped(rule.tiers(6000)) and rule.clipped(rule.tiers(80)) and rule.clipped(rule.tiers(1))
    rng = np.random.default_rng(2)
    for most in (60, 100, 300, 1000, 6000):
        tiers = rule.tiers(most)
        for _ in range(50):
            cell_rank, passes = rng.integers(0, 700, 6000), rng.random(6000) < rng.choice([0.001, 0.01, 0.2])
            walk = rule.walk(cell_rank, passes, tiers)
            assert rule.clipped(tiers) or walk.hits is not None or walk.nprobe >= rule.nlist


def test_queries_of_long_lists_share_a_scan(fine, queries, histogram):
    """Pools are sent when a task is full, so long lists don't make a scan of the vectors for each query."""
    from cellsieve.plans.sweep import Grid

    lists = {w: [Predicate("token_count", w, ">=")] for w in range(35)}
    grid = Grid.of(fine, lists, (10, 1000, 10000), hybrid.METHODS, histogram, 10**6)
    grid.counts = {w: np.full_like(n, 10**6) for w, n in grid.counts.items()}
    grid.total = 10**8
    assert limits.rows_within(limits.QUERY_BLOCK_BYTES, grid.query_bytes(fine.dim)) >= 100
