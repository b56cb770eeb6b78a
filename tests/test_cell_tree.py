"""Nearest cells by groups of centroids against the flat search."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellsieve import limits
from cellsieve.functions.vectors import l2_normalize
from cellsieve.operators import ivf
from cellsieve.operators.cell_tree import CellTree
from cellsieve.operators.ivf import Cells
from cellsieve.operators.scoring import unit_queries


def clustered(rng, n, dim, clusters, spread=0.05):
    middles = rng.normal(size=(clusters, dim))
    rows = middles[rng.integers(0, clusters, n)] + spread * rng.normal(size=(n, dim))
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def flat(points, matrix, n):
    sims = np.round(points @ matrix.T, 9)
    order = np.lexsort((np.broadcast_to(np.arange(len(matrix)), sims.shape), -sims), axis=1)[:, :n]
    return order, np.take_along_axis(sims, order, axis=1)


@pytest.mark.parametrize("n", [1, 4, 30])
@pytest.mark.parametrize("kind", ["clustered", "uniform", "equal", "zero"])
def test_tree_equals_flat_search(kind, n):
    rng = np.random.default_rng(n)
    matrix = clustered(rng, 600, 16, 30) if kind != "uniform" else clustered(rng, 600, 16, 600, 1.0)
    if kind == "equal":
        matrix[100:200] = matrix[7]
    points = clustered(rng, 90, 16, 12)
    if kind == "zero":
        points[3] = 0
        matrix[5] = 0
    rows, sims, compared = CellTree.of(matrix, 1).nearest(points, n)
    want = flat(points, matrix, n)
    assert np.array_equal(rows, want[0]) and np.array_equal(sims, want[1])
    assert compared <= len(points) * len(matrix)


def test_few_centroids_are_compared():
    """Rows near their centroids meet about a group or two of the square root of all centroids."""
    rng = np.random.default_rng(3)
    matrix = clustered(rng, 10_000, 32, 100, 0.02)
    points = matrix[rng.integers(0, len(matrix), 500)] + 0.002 * rng.normal(size=(500, 32))
    rows, _, compared = CellTree.of(matrix, 1).nearest(points, 1)
    assert np.array_equal(rows, flat(points, matrix, 1)[0])
    assert compared < 500 * len(matrix) / 10


def test_indexes_with_a_tree(fine, queries):
    rows = lambda df, *c: sorted(tuple(r) for r in df.select(*c).collect())
    tree = ivf.replace(fine, cells=Cells(fine.cells.frame, tree_cells=1))
    assert tree.cells.tree is not None and fine.cells.tree is None
    for n in (1, 5):
        assert rows(tree.probe(unit_queries(queries), n), "qid", "cells", "cell_sims") == rows(fine.probe(unit_queries(queries), n), "qid", "cells", "cell_sims")
    flat_cells = rows(ivf.assign_cells(fine.vectors.drop("cell_id"), fine.cells), "item_id", "cell_id")
    assert rows(ivf.assign_cells(fine.vectors.drop("cell_id"), tree.cells), "item_id", "cell_id") == flat_cells


def test_joined_rows_meet_candidate_groups_only(spark):
    rng = np.random.default_rng(5)
    matrix = clustered(rng, 400, 8, 20, 0.02)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(matrix)], "cell_id bigint, centroid array<double>")
    points = clustered(rng, 60, 8, 20, 0.02)
    cells = Cells(frame, matrix_bytes=0)
    groups, placed = cells.grouped
    wanted = groups.candidates(points, 3)
    order, _ = flat(points, matrix, 3)
    group_of = {r["cell_id"]: r["group_id"] for r in placed.collect()}
    assert all(group_of[c] in w for row, w in zip(order, wanted) for c in row.tolist())
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(points)], "qid bigint, qvec array<double>")
    near = ivf.nearest_cells(asked, cells, "qvec", 3, "qid")
    assert {r["qid"]: r["cells"] for r in near.collect()} == {i: row.tolist() for i, row in enumerate(order)}
    own = matrix + 0.001 * rng.normal(size=matrix.shape)
    assert np.mean([len(w) for w in groups.candidates(own, 1)]) < len(groups.sizes) / 2


def test_bound_is_a_setting(monkeypatch, fine):
    monkeypatch.setattr(limits, "TREE_CELLS", 1)
    assert Cells(fine.cells.frame).tree is not None


def test_groups_that_nothing_excludes_cost_no_sort():
    """Where no bound excludes a group, the search costs a fraction of sorting all similarities."""
    rng = np.random.default_rng(7)
    matrix, points = clustered(rng, 8000, 64, 8000, 1.0), clustered(rng, 1200, 64, 1200, 1.0)
    tree = CellTree.of(matrix, 1)
    begun = time.process_time()
    want = flat(points, matrix, 4)
    sorted_, begun = time.process_time() - begun, time.process_time()
    rows, sims, compared = tree.nearest(points, 4)
    taken = time.process_time() - begun
    assert np.array_equal(rows, want[0]) and np.array_equal(sims, want[1])
    assert compared == len(points) * len(matrix)
    assert taken < sorted_ / 2


@pytest.mark.parametrize("scale", [1.0, 1e25])
def test_centroids_closer_than_single_precision(scale):
    rng = np.random.default_rng(8)
    matrix = np.repeat(clustered(rng, 40, 16, 40, 1.0), 30, axis=0) + 1e-8 * rng.normal(size=(1200, 16))
    points = clustered(rng, 50, 16, 50, 1.0)
    if scale > 1:  # beyond the largest single-precision product
        matrix, points = matrix * scale, points * scale
    rows, _, _ = CellTree.of(matrix, 1).nearest(points, 5)
    if scale == 1:
        assert np.array_equal(rows, flat(points, matrix, 5)[0])
    else:
        sims = np.take_along_axis(points @ matrix.T, rows, axis=1)
        assert np.allclose(sims, flat(points, matrix, 5)[1], rtol=1e-12)


def test_points_of_one_file_are_dealt_to_all_cores(spark, fine):
    points = fine.vectors.drop("cell_id").coalesce(1)
    tasks = lambda cells: ivf.assign_cells(points, cells).select(F.spark_partition_id().alias("t")).distinct().count()
    assert tasks(Cells(fine.cells.frame, tree_cells=1)) >= spark.sparkContext.defaultParallelism
    assert tasks(fine.cells) == 1


def test_length_of_a_vector_is_summed_once(spark):
    """Summed up anew for every component, 30,000 of them take 900 million steps."""
    vector = np.arange(1, 30_001, dtype=np.float32)
    rows = spark.createDataFrame([(1, vector.tolist()), (2, None), (3, []), (4, [0.0, 0.0]), (5, [None, 1.0])], "i int, v array<float>")
    begun = time.perf_counter()
    got = {r["i"]: r["u"] for r in rows.select("i", l2_normalize("v").alias("u")).collect()}
    assert time.perf_counter() - begun < 20
    wide = vector.astype(np.float64)
    assert np.allclose(got.pop(1), wide / np.sqrt((wide * wide).sum()), rtol=1e-6)
    assert got == {2: None, 3: [], 4: [0.0, 0.0], 5: [None, None]}
