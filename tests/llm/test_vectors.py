"""Whitening against numpy, over odd rows."""

import math

import numpy as np
import pytest

from cellsieve.llm import whitening
from cellsieve.llm.common import table
from cellsieve.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, n int, x string, task long"


def usable(v, dim):
    return [math.floor(64 * float(c)) + 1000000 for c in v] + [1000000] * (dim - len(v))


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("dim", [1, 2, 3, 17, 64])
def test_components_are_eigenvectors(seed, dim):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(dim, dim))
    v = {
        0: a @ a.T,
        1: np.eye(dim) * 3.0,
        2: np.diag(np.repeat(np.arange(1.0, dim // 2 + 2), 2)[:dim]),
        3: (q := np.linalg.qr(a)[0]) @ np.diag(np.round(rng.uniform(1, 3, dim))) @ q.T,
    }[seed]
    v = (v + v.T) / 2
    values, vectors = whitening.leading_components(v, 16)
    want = np.linalg.eigvalsh(v)[::-1][:16]
    assert np.allclose(values, want, rtol=1e-12, atol=1e-13 * np.abs(want).max())
    assert np.allclose(vectors @ vectors.T, np.eye(len(values)), atol=1e-12)
    assert np.abs(vectors @ v - values[:, None] * vectors).max() < 1e-12 * np.abs(v).max() * dim


def test_sturm_counts():
    rng = np.random.default_rng(5)
    d, e = rng.normal(size=9), rng.normal(size=8)
    e[3] = 0.0
    values = np.linalg.eigvalsh(np.diag(d) + np.diag(e, 1) + np.diag(e, -1))
    shifts = np.concatenate([(values[1:] + values[:-1]) / 2, [values[0] - 1, values[-1] + 1]])
    assert whitening.sturm_counts(d, e, shifts).tolist() == [int((values < s).sum()) for s in shifts]


def brute(rows, k=16):
    dim = max([0, *(len(v) for _, v in rows)])
    x = {i: np.array(usable(v, dim)) for i, (_, v) in enumerate(rows)}
    each = np.array(sorted({tuple(v) for v in x.values()}))
    n, sums = len(each), each.sum(axis=0)
    c = (n * each - sums) / n
    cov = c.T @ c / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    out = {}
    for i, v in x.items():
        deviation = sum(int(t) ** 2 for t in n * v - sums)
        out[i] = (deviation, np.abs((n * v - sums) / n @ vectors / np.sqrt(np.maximum(values, 1e-300))))
    return n, out, values / np.trace(cov)


def check(found, rows):
    n, want, explained = brute(rows)
    by_id = {}
    for r in found:
        by_id.setdefault(r["vec_id"], []).append(r)
    assert set(by_id) == {i for i, _ in rows}
    for i, (own, _) in enumerate(rows):
        got = {r["component"]: r for r in by_id[own]}
        assert {r["deviation"] for r in by_id[own]} == {want[i][0]} and {r["n"] for r in by_id[own]} == {n}
        for c, r in got.items():
            assert abs(abs(r["whitened"]) - want[i][1][c - 1]) < 1e-8
            assert abs(r["explained"] - explained[c - 1]) < 1e-10
            assert 0 <= r["identity_error"] < 1e-9


def test_whole_table(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, sf_dir, "embeddings").collect()]
    found = QUERIES["op13_whitening"](spark, sf_dir).collect()
    assert len(found) == 16 * len(rows)
    check(found, rows)
    assert len({r["identity_error"] for r in found}) == 1


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    good = [(k, rng.normal(size=3).round(3).tolist()) for k in range(30)]
    good += [(30, good[0][1]), (31, [0.5]), (32, []), (33, [0.5, 0.0, 0.0])]
    bad = [(90, None), (91, [1.0, None, 2.0]), (92, [float("nan"), 0.0, 0.0]), (93, [float("inf"), 0.0, 1.0]), (94, [1e30, 0.0, 0.0])]
    frame = spark.createDataFrame([(i, v, 1, "a", 2) for i, v in good + bad], SCHEMA).repartition(5)
    found = whitening.whiten(frame).collect()
    assert len(found) == 3 * len(good)  # no more components than dimensions
    check(found, good)


def test_repeats_empty_and_flat(spark):
    frame = lambda rows: spark.createDataFrame([(i, v, 1, "a", 2) for i, v in rows], SCHEMA)
    assert whitening.whiten(frame([])).collect() == []
    assert whitening.whiten(frame([(1, None)])).collect() == []
    assert whitening.whiten(frame([(1, [])])).collect() == []
    assert whitening.whiten(frame([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []  # one distinct vector: no variance
    found = whitening.whiten(frame([(1, [0.0, 2.0]), (1, [0.0, 2.0]), (None, [1.0, 2.0])])).collect()
    assert sorted((r["vec_id"] or 0, r["component"], r["n"], r["deviation"], round(r["whitened"], 9), r["explained"]) for r in found) == [
        (0, 1, 2, 64**2, 1.0, 1.0), (1, 1, 2, 64**2, -1.0, 1.0), (1, 1, 2, 64**2, -1.0, 1.0),
    ]
    with pytest.raises(ValueError):
        whitening.whiten(frame([(1, [0.0] * 3000)]))


def test_partial_matrices_add_in_a_tree(spark):
    rng = np.random.default_rng(2)
    rows = [(k, rng.normal(size=4).round(3).tolist()) for k in range(400)]
    frame = spark.createDataFrame([(i, v, 1, "a", 2) for i, v in rows], SCHEMA)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "70")
    try:
        numbers = whitening.whole_numbers(frame.repartition(70), "vec_id", "embedding")
        total = whitening.tree_sum(numbers, np.zeros(5, np.int64), lambda x: np.concatenate([[len(x)], x.sum(axis=0)]), 4)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = np.array([usable(v, 4) for _, v in rows])
    assert total.tolist() == [400, *want.sum(axis=0).tolist()]


def test_long_deviations():
    x = np.array([[2**31 - 1, 0], [5, 5]])
    off = 10**9 * x - np.array([1, 1])
    assert whitening.deviations(x, 10**9, np.array([1, 1])).to_pylist() == [None, sum(int(v) ** 2 for v in off[1]) if sum(int(v) ** 2 for v in off[1]) < 2**63 else None]
