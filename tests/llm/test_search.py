"""Ranked lexical search against brute force, over odd rows."""

import gc
import math
import re
from collections import Counter

import numpy as np
import pytest

from cellsieve.llm import dual_tree

DOCS = "doc_id long, text string, item_id long, n long, query long, score int"
ITEMS = "item_id long, text string, doc_id long, item_text string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(docs, items, k=10):
    docs = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs if terms(t)]
    n, length = len(docs), sum(size for _, _, size in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, size in docs:
            m = 25 + (75 * size * n) // length
            total = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t]
            )
            if total > 0:
                scored.append((-total, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def run(spark, docs, items, k=10, parts=3):
    left = spark.createDataFrame([(i, t, 1, 2, 3, 4) for i, t in docs], DOCS).repartition(parts)
    right = spark.createDataFrame([(i, t, 1, "x") for i, t in items], ITEMS)
    return sorted(map(tuple, dual_tree.lexical_topk(left, right, k).collect()), key=repr)


def words(rng, n, vocabulary=60):
    return " ".join(f"w{int(v)}" for v in rng.zipf(1.4, n) % vocabulary)


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed, monkeypatch):
    rng = np.random.default_rng(seed)
    docs = [(k, words(rng, int(rng.integers(1, 60)))) for k in range(400)]
    items = [(k, words(rng, int(rng.integers(1, 12)))) for k in range(40)]
    if seed == 1:  # many small hierarchies
        monkeypatch.setattr(dual_tree, "ROOT_ITEMS", 7)
        monkeypatch.setattr(dual_tree, "BATCH_DOCS", 33)
    if seed == 2:  # several blocks of items, several pieces of text
        monkeypatch.setattr(dual_tree, "ITEM_BYTES", 1500)
        monkeypatch.setattr(dual_tree, "ROOT_TERMS", 9)
    assert run(spark, docs, items) == brute(docs, items)


def test_odd_rows(spark):
    docs = [
        (1, "Alpha beta"), (2, "alpha BETA"), (3, "alpha, beta!"), (3, "alpha beta"), (None, "alpha beta"), (4, None), (5, ""), (6, "... --- \x00\x7f"),
        (7, "É É é Ärger straße 日本語 日本語"), (8, "gamma " * 30000 + "delta"), (9, "x" * 200000 + " alpha"), (10, "12 ½ 12"), (11, "nothing here"),
    ] + [(100 + k, "same text alpha") for k in range(50)]
    items = [(1, "alpha"), (1, "alpha"), (2, "BETA alpha alpha"), (3, None), (4, "?!"), (None, "gamma"), (6, "É 日本語 é"), (7, "absent"), (8, "x" * 200000), (9, "12 same")]
    assert run(spark, docs, items, k=10) == brute(docs, items)
    assert run(spark, docs, items, k=1, parts=1) == brute(docs, items, k=1)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "alpha")]) == []
    assert run(spark, [(1, "alpha")], []) == []
    assert run(spark, [(1, None)], [(1, "alpha")]) == []
    assert run(spark, [(1, "alpha")], [(1, None), (2, "!")]) == []


def test_pieces_cut_no_term():
    text = b"alpha beta " * 50 + b"y" * 400 + b" z"
    rows = [b"", b"one two", text, b"", b"three"]
    data = np.frombuffer(b"".join(rows), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    found = {k: [] for k in range(len(rows))}
    for at, part, bounds in dual_tree.pieces(data, offsets, limit=64):
        assert bounds[0] == 0 and bounds[-1] == len(part)
        for row, a, b in zip(at.tolist(), bounds[:-1], bounds[1:]):
            found[row] += part[a:b].tobytes().split()
    assert [found[k] for k in range(len(rows))] == [r.split() for r in rows]


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(dual_tree, "span_hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64))
    known = dual_tree.Vocabulary([b"ab", b"cd", b"efg"])
    data = np.frombuffer(b"cdxxefgab", np.uint8)
    assert known.numbers(data, np.array([0, 2, 4, 7]), np.array([2, 4, 7, 9])).tolist() == [1, -1, 2, 0]


def test_pairs_of_nodes_are_pruned():
    """Documents of other topics than an item's are not scored one by one, and nothing that ranks is lost."""
    rng = np.random.default_rng(7)
    topic = rng.integers(0, 40, 4096)
    rows = np.zeros((4096, 400))
    for r, t in enumerate(topic):
        rows[r, 10 * t + rng.integers(0, 10, 5)] = rng.integers(1, 1000, 5)
    items = [(np.arange(10 * t, 10 * t + 10), np.ones(10, np.int64)) for t in range(40)]
    roots = dual_tree.build_roots(items, np.ones(400, np.int64))
    best = dual_tree.Best(np.zeros(40, np.int64), 10)
    offered = 0
    offer = best.offer

    def counted(item, scores, ids):
        nonlocal offered
        offered += len(scores)
        offer(item, scores, ids)

    best.offer = counted
    for at in range(0, 4096, 512):
        dual_tree.search_batch(roots[0], rows[at : at + 512], np.arange(at, at + 512), best)
    assert offered < 4096 * 40 / 20
    for t in range(40):
        scores = rows[:, 10 * t : 10 * t + 10].sum(axis=1).astype(int)
        want = sorted(range(4096), key=lambda i: (-scores[i], i))[:10]
        assert best.ids[t].tolist() == want


def test_a_batch_leaves_nothing_to_the_collector():
    """What only a collection of cycles frees piles up in a task, as arrays don't set one off."""
    rng = np.random.default_rng(12)
    items = [(np.arange(10 * t, 10 * t + 10), np.ones(10, np.int64)) for t in range(20)]
    root = dual_tree.build_roots(items, np.ones(200, np.int64))[0]
    best = dual_tree.Best(np.zeros(20, np.int64), 10)
    rows = rng.integers(0, 50, (64, 200)).astype(root.levels[0].dtype)
    gc.collect()
    gc.disable()
    try:
        dual_tree.search_batch(root, rows, np.arange(64), best)
        assert gc.collect() == 0
    finally:
        gc.enable()
