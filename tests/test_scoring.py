import numpy as np
import pytest
from pyspark.sql import functions as F

from cellsieve import limits
from cellsieve.operators import ivf, pq
from cellsieve.operators.ivf import Cells
from cellsieve.operators.scoring import best_per_query, exact_knn, global_positions, unit_queries


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


RANKED = ("qid", "rank", "item_id", "similarity")


def brute(local, query_vectors, k, allowed=None):
    out = []
    for qid, q in query_vectors.items():
        sims = np.round(local["vectors"] @ q, 9)
        keep = np.arange(len(sims)) if allowed is None else np.flatnonzero(allowed)
        order = sorted(keep, key=lambda i: (-sims[i], local["ids"][i]))[:k]
        out += [(qid, n + 1, int(local["ids"][i]), sims[i]) for n, i in enumerate(order)]
    return sorted(out)


@pytest.mark.parametrize("k", [1, 7, 1000])
def test_exact_matches_brute_force(fine, queries, local, query_vectors, k):
    assert rows(exact_knn(fine.vectors, queries, k, fine.dim), *RANKED) == brute(local, query_vectors, k)


def test_large_query_sets_take_the_joined_way(fine, queries, local, query_vectors, monkeypatch):
    monkeypatch.setattr(limits, "QUERY_BLOCK_BYTES", 1)
    monkeypatch.setattr(limits, "PACK_QUERIES", 3)
    monkeypatch.setattr(limits, "CHUNK_ROWS", 16)
    found = exact_knn(fine.vectors, queries, 7, fine.dim)
    assert "Join" in found._jdf.queryExecution().toString()
    assert rows(found, *RANKED) == brute(local, query_vectors, 7)


def test_both_ways_agree_on_cells_and_codes(spark, fine, queries, monkeypatch):
    sample = fine.vectors.select("item_id", "cell_id", "embedding")
    books = pq.codebook_frame(spark, pq.seed_codebooks(pq.residuals(sample, fine.cells), 8, 4, 1, "item_id"))
    coded = ivf.index_items(fine.vectors.drop("cell_id"), fine.cells, books)
    expected = {s: rows(coded.search(queries, 9, 5, scoring=s), *RANKED) for s in ("exact", "codes")}
    monkeypatch.setattr(limits, "QUERY_BLOCK_BYTES", 1)
    for scoring, answer in expected.items():
        assert rows(coded.search(queries, 9, 5, scoring=scoring), *RANKED) == answer


def test_centroids_beyond_the_bound_are_joined(fine, queries, monkeypatch):
    expected = rows(fine.probe(unit_queries(queries), 6), "qid", "cells", "cell_sims")
    assigned = rows(ivf.assign_cells(fine.vectors.drop("cell_id"), fine.cells), "item_id", "cell_id")
    per_cell = fine.vectors.groupBy("cell_id").agg(F.count(F.lit(1)).alias("n"))
    seen = rows(fine.probe(unit_queries(queries), fine.nlist, per_cell), "qid", "cells", "seen")
    monkeypatch.setattr(limits, "MATRIX_BYTES", 1)
    joined = Cells(fine.cells.frame)
    assert fine.cells.frame.schema["centroid"].dataType.elementType.simpleString() == "double"
    assert joined.shared is None
    index = ivf.replace(fine, cells=joined)
    assert rows(index.probe(unit_queries(queries), 6), "qid", "cells", "cell_sims") == expected
    assert rows(ivf.assign_cells(fine.vectors.drop("cell_id"), joined), "item_id", "cell_id") == assigned
    assert rows(index.probe(unit_queries(queries), fine.nlist, per_cell), "qid", "cells", "seen") == seen


def test_ties_go_to_the_lowest_id(spark):
    vectors = spark.createDataFrame(
        [(i, [1.0, 0.0]) for i in range(40)] + [(99, [0.0, 1.0])], "item_id bigint, embedding array<float>"
    ).repartition(5)
    found = exact_knn(vectors, spark.createDataFrame([(1, [2.0, 0.0])], "qid bigint, qvec array<double>"), 3, 2)
    assert rows(found, *RANKED) == [(1, 1, 0, 1.0), (1, 2, 1, 1.0), (1, 3, 2, 1.0)]


def test_crowded_cell_gives_whole_results(spark, fine, queries, local, query_vectors):
    crowded = fine.vectors.withColumn(
        "cell_id", F.when(F.col("item_id") % 3 < 2, F.lit(fine.cells.matrix[0][0])).otherwise(F.col("cell_id"))
    )
    index = ivf.replace(fine, vectors=crowded)
    found = index.search(queries, 12, index.nlist)
    assert rows(found, *RANKED) == brute(local, query_vectors, 12)


def test_positions_count_the_whole_list(fine, queries, local, query_vectors):
    probes = fine.probe(unit_queries(queries), fine.nlist)
    passing = fine.vectors.filter("token_count < 300")
    best = best_per_query(passing, probes, 8, dim=fine.dim)
    placed = global_positions(fine.vectors, probes, best, k=8, dim=fine.dim, width=fine.nlist)
    whole = {(q, i): r for q, r, i, _ in brute(local, query_vectors, 10_000)}
    got = rows(placed, "qid", "item_id", "position")
    assert len(got) == best.count()
    assert all(whole[(q, i)] == position for q, i, position in got)


def test_allowed_ids(spark, fine, queries):
    some = spark.createDataFrame([(5,), (9,), (10**9,)], "item_id bigint")
    found = fine.search(queries, 5, fine.nlist, allowed=some)
    assert {r["item_id"] for r in found.collect()} == {5, 9}
    assert fine.search(queries, 5, fine.nlist, allowed=some.limit(0)).isEmpty()


def test_scores_are_ordered_cosines(fine, queries):
    got = exact_knn(fine.vectors, queries, 1000, fine.dim).orderBy("qid", "rank").collect()
    for before, after in zip(got, got[1:]):
        assert -1.0001 <= after["similarity"] <= 1.0001
        assert before["qid"] != after["qid"] or before["similarity"] >= after["similarity"]


def test_code_scores_equal_reconstructed_vectors(spark, fine, queries, query_vectors):
    books = pq.train_codebooks(fine.vectors.select("item_id", "cell_id", "embedding"), fine.cells, 8, 4, iterations=3)
    coded = ivf.index_items(fine.vectors.drop("cell_id"), fine.cells, books)
    words = pq.codebook_array(books)
    ids, matrix = fine.cells.matrix
    rebuilt = {}
    for r in coded.vectors.collect():
        residual = np.concatenate([words[m, c] for m, c in enumerate(r["code"])])
        rebuilt[r["item_id"]] = matrix[np.searchsorted(ids, r["cell_id"])] + residual
    for r in coded.search(queries, 20, coded.nlist, scoring="codes").collect():
        assert abs(r["similarity"] - rebuilt[r["item_id"]] @ query_vectors[r["qid"]]) < 1e-8
    exact = {(r["qid"], r["item_id"]): r["similarity"] for r in fine.search(queries, 1000, fine.nlist).collect()}
    for r in coded.rerank(coded.search(queries, 50, 9, scoring="codes"), queries, 5).collect():
        assert abs(r["similarity"] - exact[(r["qid"], r["item_id"])]) < 1e-6


def test_codebook_training_lowers_the_error(spark, fine):
    sample = pq.residuals(fine.vectors, fine.cells)
    data = np.array([r["residual"] for r in sample.collect()])

    def error(books):
        codes = pq._nearest_codes(data, books)
        rebuilt = np.stack([books[m][codes[:, m]] for m in range(books.shape[0])], axis=1).reshape(data.shape)
        return ((data - rebuilt) ** 2).sum()

    first = pq.seed_codebooks(sample, 8, 4, 6400, "item_id")
    stepped = pq.codebook_array(pq.codebook_step(sample, first))
    assert error(stepped) < error(first)


@pytest.mark.parametrize("dim, m, bits", [(64, None, 8), (64, 7, 8), (64, 8, 3), (64, 8, 9)])
def test_code_shape_is_checked(dim, m, bits):
    with pytest.raises(ValueError):
        pq.check_shape(dim, m, bits)


def test_untrained_index_is_an_error(spark, fine):
    with pytest.raises(ValueError):
        ivf.assign_cells(fine.vectors.drop("cell_id"), fine.cells.frame.limit(0))


def test_adding_in_parts_equals_adding_at_once(fine):
    items = fine.vectors.drop("cell_id")
    whole = ivf.index_items(items, fine.cells)
    parts = ivf.index_items(items.filter("item_id < 70"), fine.cells).add(items.filter("item_id >= 70"))
    assert parts.total == whole.total == fine.total
    assert rows(parts.vectors, "item_id", "cell_id") == rows(whole.vectors, "item_id", "cell_id")


def test_short_probe_lists_stay_broadcast_whatever_the_width(fine, queries):
    probes = fine.probe(unit_queries(queries), 4)
    expected = rows(best_per_query(fine.vectors, probes, 6, dim=fine.dim, width=4), *RANKED)
    found = best_per_query(fine.vectors, probes, 6, dim=fine.dim, width=10**7)
    assert "Join" not in found._jdf.queryExecution().toString()
    assert rows(found, *RANKED) == expected


def test_blocks_of_queries_read_their_cells_in_place(spark, fine, queries, tmp_path, monkeypatch):
    """No exchange above the scan of the vectors, and only partitions of probed cells are read."""
    from cellsieve.operators import scoring
    from cellsieve.sources.tables import load_index, save_index

    save_index(fine, str(tmp_path / "index"))
    index = load_index(spark, str(tmp_path / "index"))
    expected = rows(index.search(queries, 6, 3), *RANKED)
    plans, seen = [], []
    scan = scoring._scan

    def kept(vectors, block, *rest):
        found = scan(vectors, block, *rest)
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        seen.append((set(block.qids.tolist()), set(block.cells)))
        return found

    monkeypatch.setattr(scoring, "_scan", kept)
    assert rows(index.search(queries, 6, 3, block_bytes=4000), *RANKED) == expected
    assert len(plans) > 2
    for plan in plans:
        assert "Exchange" not in plan and "PartitionFilters: [" in plan and "cell_id" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert sum(len(q) for q, _ in seen) == len(set().union(*(q for q, _ in seen)))
    assert max(len(c) for _, c in seen) < index.nlist / 2


def test_large_k_sends_few_rows(spark, monkeypatch):
    """With a cutoff from a share of the vectors, tasks no longer send k rows each."""
    from cellsieve.operators import scoring

    rng = np.random.default_rng(8)
    data = rng.normal(size=(4000, 8))
    data /= np.linalg.norm(data, axis=1, keepdims=True)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "item_id bigint, embedding array<double>").repartition(40)
    asked = spark.createDataFrame([(q, rng.normal(size=8).tolist()) for q in range(3)], "qid bigint, qvec array<double>")
    sent = {}

    def search(name):
        run = scoring._run

        def counted(*args):
            found = run(*args)
            sent[name] = found.count()
            return found

        monkeypatch.setattr(scoring, "_run", counted)
        out = rows(exact_knn(vectors, asked, 100, 8), *RANKED)
        monkeypatch.setattr(scoring, "_run", run)
        return out

    plain = search("plain")
    monkeypatch.setattr(scoring, "CUTOFF_ROWS", 1)
    monkeypatch.setattr(scoring, "CUTOFF_SHARE", 8)
    assert search("cutoff") == plain
    assert sent["plain"] == 3 * 40 * 100
    assert sent["cutoff"] < sent["plain"] / 3
    monkeypatch.setattr(limits, "QUERY_BLOCK_BYTES", 1)
    assert search("joined") == plain
